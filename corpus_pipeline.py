"""Training-corpus pipeline: language ID, near-duplicates, repeated strings, benchmark passages, BPE.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, all columns of its input with them; the last
one returns the encoded documents. Null and repeated ids follow each operator's own definition.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cragline.llm import bpe, decontaminate, langid, neardup, suffixdedup
from cragline.llm.common import fresh
from cragline.session import materialize

#: A document goes whose text has no letter, or no language with at least this share.
LEAST_SHARE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a main language; the model learns from its input's labelled training rows."""
    model = langid.fit(langid.train_rows(docs))
    p = fresh(docs.columns)
    out = langid.identify(docs, model, docs.columns, prefix=p)
    return out.filter((F.col(p + "lang_pred") != "und") & (F.col(p + "score") >= LEAST_SHARE)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each component."""
    gone = fresh(docs.columns) + "gone"
    lost = neardup.cluster(docs).filter("not kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(lost, F.col("doc_id") == F.col(gone), "left_anti")


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts 50-byte strings that a document with a smaller id has; texts that lose everything go."""
    p = fresh(docs.columns)
    new_id, sha, kept, was_cut, null, key = (p + x for x in ("id", "sha", "text", "cut", "null", "key"))
    cut = suffixdedup.dedup(docs, with_text=True).select(F.col("doc_id").alias(new_id), F.col("text_sha256").alias(sha), F.col("kept_text").alias(kept), (F.col("n_removed") > 0).alias(was_cut)).dropDuplicates([new_id, sha])
    left = docs.select(*(c for c in docs.columns if c != "text"), F.col("text").isNull().alias(null), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias(key))
    both = left.join(cut, F.col("doc_id").eqNullSafe(F.col(new_id)) & (F.col(key) == F.col(sha)))
    both = both.filter(~(F.col(was_cut) & (F.trim(F.col(kept)) == ""))).withColumn("text", F.when(~F.col(null), F.col(kept)))
    if "n_chars" in docs.columns:
        both = both.withColumn("n_chars", F.when(F.col(was_cut), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return both.select(docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without a passage of the benchmark."""
    p = fresh(docs.columns)
    out = decontaminate.scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=docs.columns, prefix=p)
    return out.filter(~F.col(p + "contaminated")).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids of what is left."""
    return bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [("language_id", language), ("near_dup", near_duplicates), ("suffix_dedup", repeated_strings), ("decontamination", benchmark_passages), ("bpe", encode)]

#: Expectation-maximisation, suffix cutting and merge rounds are beyond SQL; the stages and their composition are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
