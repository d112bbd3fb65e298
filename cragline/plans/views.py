"""Adapter views: grids, summits, reference rows, names and areas from the driver tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dem(spark, sf_dir, rows: int | None = None) -> DataFrame:
    """pix, r, c, z of the embeddings as a grid, heights in ten-thousandths; rows: its upper part."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("r"), F.posexplode("embedding").alias("c", "e"))
    g = e.select((F.col("r") * 64 + F.col("c")).alias("pix"), "r", F.col("c").cast("long").alias("c"), F.floor(F.col("e").cast("double") * 10000 + 0.5).cast("int").alias("z"))
    return g if rows is None else g.filter(F.col("r") < rows)


DEM = "dem AS (SELECT r * 64 + c AS pix, r, c, CAST(floor(CAST(e AS DOUBLE) * 10000 + 0.5) AS INT) AS z FROM (SELECT vec_id AS r, unnest(range(64)) AS c, unnest(embedding) AS e FROM embeddings))"


def pick(expr: str, *labels: str | None) -> str:
    """CASE text that spreads rows over labels."""
    return f"CASE ({expr}) % {len(labels)} " + " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else f"'{v}'") for i, v in enumerate(labels)) + " END"


#: name: (table, column texts), the same text for both engines.
VIEWS = {
    "peaks": ("customer", {"fid": "c_custkey", "x": "(c_custkey * 7919) % 20011", "y": "(c_custkey * 10007) % 20021", "z": "CAST(floor(c_acctbal / 4) AS INT)", "prom": "(c_custkey * 31) % 300", "kx": "(c_custkey * 7919) % 20011 + (c_custkey % 7) * 60 - 180", "ky": "(c_custkey * 10007) % 20021 + (c_custkey % 5) * 60 - 120", "name": "c_name"}),
    "refdb": ("part", {"bid": "p_partkey", "qx": "(p_partkey * 7907) % 20011", "qy": "(p_partkey * 10009) % 20021", "alt": "CAST(floor(p_retailprice) AS INT)", "is_foreign": "CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END", "ref_name": "p_name", "code": "concat(" + pick("p_partkey", "OE/BL", "OE/KT", "OE/NO", "OE/OO", "OE/SB", "OE/ST", "OE/TI", "OE/VB", "OE/WI", "OE/XX", "OE/TL") + ", '-', CAST(p_partkey AS VARCHAR(20)))"}),
    "names": ("part", {"bid": "p_partkey", "qx": "(p_partkey * 7901) % 20011", "qy": "(p_partkey * 10037) % 20021", "f_code": "7301 + p_partkey % 3", "place": "p_name"}),
    "lands": ("nation", {"land_id": "n_nationkey", "land": "n_name", "country": "n_regionkey", "x0": "(n_nationkey % 5) * 4000", "y0": "CAST(floor(n_nationkey / 5.0) AS INT) * 4000", "x1": "(n_nationkey % 5) * 4000 + 4000", "y1": "CAST(floor(n_nationkey / 5.0) AS INT) * 4000 + 4000"}),
    "cases": (
        "customer",
        {
            "k": "c_custkey",
            "d": "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE (c_custkey * 37) % 331 END",
            "far": "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE (c_custkey * 53) % 1009 END",
            "dz": "CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE (c_custkey * 29) % 31 END",
            "kd": "CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE (c_custkey * 23) % 61 END",
            "z1": "CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE 1000 + (c_custkey * 7) % 41 END",
            "z2": "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 1000 + (c_custkey * 11) % 43 END",
            "z3": "CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE 1000 + (c_custkey * 13) % 47 END",
            "prom": "(c_custkey * 41) % 401",
            "b1": "c_custkey % 2",
            "b2": "CAST(floor(c_custkey / 2.0) AS INT) % 2",
            "b3": "CAST(floor(c_custkey / 4.0) AS INT) % 2",
            "b4": "CAST(floor(c_custkey / 8.0) AS INT) % 2",
            "status": pick("c_custkey * 3", "MATCH_OK", "MATCH_ELEV", "NEW_CALC", "MATCH_ELEV", "DB_NO_PEAK", "FOREIGN_PEAK", "OTHER"),
            "pos": pick("c_custkey * 5", "EXACT_POS", "VERY_NEAR_POS", "NEAR_POS", "RIDGE_OFFSET", "REMOTE_OFFSET", None),
            "support": pick("c_custkey * 7 + 1", "BEV_SUPPORTS_CALC", "BEV_SUPPORTS_DB", "BEV_EQUAL", "NO_BEV_AT_CALC_POINT"),
            "hint": pick("c_custkey * 2 + 1", "LIKELY_DB_ELEV_ISSUE", "POSSIBLE_WRONG_SUMMIT_MATCH", "MANUAL_REVIEW", None, "POSSIBLE_WRONG_SUMMIT_MATCH"),
            "zone1": pick("c_custkey", "INNER", "BORDER_ZONE", "OUTER", None),
            "zone2": pick("c_custkey * 3 + 2", "INNER", "BORDER_ZONE", None, "BORDER_ZONE", "OUTER"),
            "code1": "CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE 7301 + c_custkey % 4 END",
            "code2": "CASE WHEN c_custkey % 5 > 2 THEN NULL ELSE 7301 + c_custkey % 5 END",
            "sev1": pick("c_custkey", "NO_DATA", "NONE", "MINOR", "REVIEW", "STRONG", "SEVERE"),
            "sev2": pick("c_custkey * 5 + 3", "NONE", "MINOR", "REVIEW", "SEVERE", "NO_DATA"),
            "sev3": pick("c_custkey * 3 + 1", "NONE", "REVIEW", "MINOR", "STRONG", "NONE", "NO_DATA", "NONE"),
            "pref": pick("c_custkey", "OFFICIAL_SUMMIT_PREFERRED", "CALC_POINT_SUPPORTED", "DB_HEIGHT_SUPPORTED", None),
            "origin": pick("c_custkey * 3", "CALC_PEAK", "SOTA_DB", "OTHER"),
            "refined": pick("c_custkey * 17 + 5", "NEW_CALC_STRONG", "NEW_CALC_STRONG_BORDER", "NEW_CALC_NEAR_DB_REVIEW", "NEW_CALC_LOW_REFERENCE", "MATCH_ELEV_EXACT_POS_DB_ISSUE", "MATCH_ELEV_POS_OK_CALC_HEIGHT_ISSUE", "DB_NO_PEAK_RAW_ONLY", "DB_NO_PEAK_NEAR_CALC", "DB_NO_PEAK_NO_RAW_NO_CALC", None, "DB_NO_PEAK_NEAR_CALC_NO_KEYCOL"),
            "role": pick("c_custkey", "REVIEW_REQUIRED", "UNRESOLVED_REFERENCE", "FINAL_SOTA_SUMMIT", "SECONDARY_SHARED_KEYCOL", "FOREIGN_CONTEXT", "FINAL_SOTA_SUMMIT_REVIEW", "REPLAY_REQUIRED"),
            "tags": pick("c_custkey * 3 + 1", "NO_COORDINATE_FLAG", "CALC_POINT_NOT_ON_LOCAL_MAX", "BEV_REFERENCE_POSITION_CONFLICT;DB_NAME_OR_REFERENCE_CHECK", "DB_COORD_SHIFT_CALC_SUPPORT", None),
            "anchor": pick("c_custkey", None, "BEV_NAME", None, "BEV_COORD", None),
        },
    ),
}


def view(spark, sf_dir, name: str) -> DataFrame:
    source, cols = VIEWS[name]
    return table(spark, sf_dir, source).selectExpr(*[f"{e.replace('VARCHAR(20)', 'STRING')} AS {c}" for c, e in cols.items()])


def with_sql(*names: str, more: str = "", recursive: bool = False) -> str:
    """WITH clause of the named views."""
    parts = [DEM if n == "dem" else f"{n} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in VIEWS[n][1].items())} FROM {VIEWS[n][0]})" for n in names]
    return "WITH " + "RECURSIVE " * recursive + ",\n".join([*parts, *([more] if more else [])]) + "\n"
