"""The operators applied to their whole tables with production parameters, and the SQL of those that SQL expresses."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, chat, ctw, decontaminate, langid, lexical, neardup, ordermin, repair, suffixdedup, tokenfile, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(langid.train_rows(docs))
    marked = docs.select("doc_id", "text", langid.held("doc_id", 4, 2).alias("held_out"))
    return langid.identify(marked, model, ["doc_id", "held_out"])


def op2_bpe(spark, sf_dir):
    return bpe.encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_lm_score(spark, sf_dir):
    return ctw.score(_table(spark, sf_dir, "documents"))


def op4_chat(spark, sf_dir):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = _table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text")
    extra = spark.sql("select -1L conv_id, 0L turn, 'user' role, '</s>[INST] ok [/INST]' text union all select -1L, 1L, 'assistant', '</s>[INST] ok [/INST]'")
    return chat.digest(chat.read_turns(chat.format_turns(rows.unionByName(extra), path, pattern), path, pattern))


def op5_suffix_dedup(spark, sf_dir):
    return suffixdedup.dedup(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op7_near_dup(spark, sf_dir):
    return neardup.cluster(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark, sf_dir):
    return decontaminate.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_token_files(spark, sf_dir):
    folder = tokenfile.write(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return tokenfile.read(spark, folder)


def op10_nearest(spark, sf_dir):
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op11_conversation_repair(spark, sf_dir):
    return repair.report(repair.damage(_table(spark, sf_dir, "conversations")), copies="n")


def op12_lexical_search(spark, sf_dir):
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 10)


def op13_order_minhash(spark, sf_dir):
    return ordermin.edited(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_bpe, op3_lm_score, op4_chat, op5_suffix_dedup, op6_toxicity, op7_near_dup, op8_decontamination, op9_token_files, op10_nearest, op11_conversation_repair, op12_lexical_search, op13_order_minhash)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"
_COUNT = lambda s: f"(length(text) - length(replace(text, '{s}', ''))) // {len(s)}"

_ASCII_ALNUM = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
#: crc32 of an ASCII text t.
_CRC = "xor(4294967295::BIGINT, list_reduce(list_transform(string_split(t, ''), lambda ch: ascii(ch)::BIGINT), lambda acc, b: list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295::BIGINT))"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: The cheapest (cost, edits) at a state after a row: from state s by an edit.
_STEP = lambda s, c, e: f"{{'c': s{s}.c + {c} + x, 'e': s{s}.e || '{e}'}}"
_PUT = lambda s, n, e: f"{{'c': {s}.c + {n}, 'e': {s}.e || '{e}'}}"


def _edits(live: str) -> str:
    """One row's edits on the four states after the inserts before it; x is what a kept row costs more."""
    gone = lambda s: f"{{'c': s{s}.c + 2, 'e': s{s}.e || 'D'}}"
    user = lambda s: f"CASE WHEN i = 'u' THEN {_STEP(s, 0, 'K')} ELSE {_STEP(s, 1, 'R')} END"
    kept = f"CASE WHEN i = 'a' THEN {_STEP(2, 0, 'K')} ELSE {_STEP(2, 1, 'R')} END"
    far = "{'c': 1000000000000, 'e': ''}"
    s1 = f"CASE WHEN {live} AND i = 's' THEN {_STEP(0, 0, 'K')} ELSE {far} END"
    s2 = f"CASE WHEN {live} THEN least({user(0)}, {user(1)}, {user(3)}) ELSE {far} END"
    s3 = f"CASE WHEN {live} THEN {kept} ELSE {far} END"
    return f"{gone(0)} AS s0, least({gone(1)}, {s1}) AS s1, least({gone(2)}, {s2}) AS s2, least({gone(3)}, {s3}) AS s3"


SQL = {
    "op11_conversation_repair": f"""
WITH RECURSIVE said AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  concat_ws(':', coalesce(CAST(conv_id AS VARCHAR), ' '), coalesce(CAST(turn AS VARCHAR), ' ')) AS t FROM conversations),
kinds AS (SELECT *, {_CRC} % 20 AS kind FROM said),
damaged AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds),
lined AS (SELECT *, rtrim(text, {_BLANK}) AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k FROM damaged),
seen AS (SELECT *, left(role, 1) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM lined),
r AS (SELECT *, CASE WHEN body = '' THEN 'b' WHEN again THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM seen),
stat AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
  count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
step AS (SELECT conv_id, 0::BIGINT AS k, {{'c': 0::BIGINT, 'e': ''}} AS s0, {{'c': 1000000000000, 'e': ''}} AS s1, {{'c': 1000000000000, 'e': ''}} AS s2, {{'c': 1000000000000, 'e': ''}} AS s3 FROM stat
  UNION ALL SELECT conv_id, k, {_edits("fault IN ('', 't')")} FROM (
    SELECT conv_id, k, i, x, fault, s0, s1, least(t2, {_PUT("t3", 5, "I")}) AS s2, least(s3, {_PUT("t2", 5, "I")}) AS s3 FROM (
      SELECT step.conv_id, r.k, r.i, r.fault, CASE r.fault WHEN 't' THEN 5 ELSE 0 END AS x, s0, s1, s3, least(s2, {_PUT("s0", 5, "I")}, {_PUT("s1", 5, "I")}) AS t2, s3 AS t3
      FROM step JOIN r ON r.conv_id IS NOT DISTINCT FROM step.conv_id AND r.k = step.k + 1))),
best AS (SELECT step.conv_id, least(s0, s3, {_PUT("s2", 5, "I")}, {_PUT("s1", 10, "II")}) AS b FROM step JOIN stat ON stat.conv_id IS NOT DISTINCT FROM step.conv_id AND stat.n = step.k),
ops AS (SELECT conv_id, j, e, count(*) FILTER (e <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS k FROM (SELECT conv_id, unnest(string_split(b.e, '')) AS e, generate_subscripts(string_split(b.e, ''), 1) AS j FROM best WHERE b.e <> '')),
outs AS (SELECT o.conv_id, o.j, o.e, CASE WHEN o.e = 'I' THEN '' ELSE r.text END AS text, r.role, (row_number() OVER w) - coalesce(max(CASE WHEN o.e = 'K' AND r.i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY o.conv_id), 0) AS place
  FROM ops o LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM o.conv_id AND r.k = o.k WHERE o.e <> 'D' WINDOW w AS (PARTITION BY o.conv_id ORDER BY o.j)),
texts AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j) AS s FROM outs GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(b.c, 0) AS cost, coalesce(b.e, '') AS audit, sha256(coalesce(texts.s, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN stat ON stat.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN texts ON texts.conv_id IS NOT DISTINCT FROM c.conv_id""",
    "op12_lexical_search": f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_ASCII_ALNUM} AS w FROM documents),
size AS (SELECT row, doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM size),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({_ASCII_ALNUM}) AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
tf AS (SELECT row, t, count(*) AS tf FROM (SELECT row, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
weight AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, total GROUP BY t, docs),
part AS (SELECT tf.row, t, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words)) AS part FROM tf JOIN size ON tf.row = size.row, total),
score AS (SELECT item_id, part.row, CAST(sum(times * weight * part) AS BIGINT) AS score FROM q JOIN weight ON q.t = weight.t JOIN part ON q.t = part.t GROUP BY item_id, part.row),
ranked AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM score JOIN size ON score.row = size.row WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10""",
    "op4_chat": f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
u AS (SELECT *, length(text) + {_COUNT(chr(92))} + {" + ".join(_COUNT(s) for s in chat.CONTROL)} AS escaped FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(escaped + CASE role WHEN 'user' THEN 16 WHEN 'assistant' THEN 4 ELSE 17 + length(role) END) AS BIGINT) AS formatted_chars
FROM u GROUP BY conv_id""",
    "op7_near_dup": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_SPACED} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM s UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a)
SELECT s.doc_id, len(any_value(sh)) AS n_shingles, min(r) AS component_id, s.doc_id = min(r) AS kept
FROM s JOIN reach ON s.doc_id = reach.doc_id GROUP BY s.doc_id""",
    "op8_decontamination": f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_ALNUM} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dp AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, item, p, bw.n FROM dp JOIN bw ON dp.n = bw.n AND dp.s = bw.s),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(its.s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN its ON d.doc_id = its.doc_id""",
}
