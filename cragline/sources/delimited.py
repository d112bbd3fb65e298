"""Reference tables from delimited text with loosely named headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_number, strip

#: The columns of a reference table and the header names that stand for them, in order; case doesn't count.
ALIASES = {
    "association": ["AssociationName", "Association"],
    "valid_to": ["ValidTo", "valid_to"],
    "code": ["SummitCode", "summit_code", "Code"],
    "name": ["SummitName", "summit_name", "Name"],
    "alt": ["AltM", "Altitude", "elev_m"],
    "lat": ["Latitude", "lat"],
    "lon": ["Longitude", "lon", "lng"],
}
OPEN_END = "31/12/2099"


def headers(found: list[str], wanted: dict[str, list[str]] = ALIASES) -> dict[str, str]:
    """Which header stands for each wanted column: the first alias that occurs, case, blanks around and a byte-order mark aside.

    Raises if a column has none.
    """
    plain = {h.replace("﻿", "").strip().lower(): h for h in reversed(found)}
    out = {c: next((plain[a.lower()] for a in names if a.lower() in plain), None) for c, names in wanted.items()}
    missing = [c for c, h in out.items() if h is None]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)} among {', '.join(found)}")
    return out


def read_table(spark: SparkSession, path: str, wanted: dict[str, list[str]] = ALIASES) -> DataFrame:
    """The wanted columns of delimited files with a header line, all of them text; empty and absent fields are null.

    Quoted fields may hold commas, doubled quotes and line breaks. As a line break can lie in a field, a file is read by
    one task, record by record; a large table comes in several files.
    """
    raw = spark.read.options(header=True, encoding="UTF-8", multiLine=True, quote='"', escape='"', inferSchema=False).csv(path)
    return raw.select(*[F.col(f"`{h}`").alias(c) for c, h in headers(raw.columns, wanted).items()])


def reference_rows(table: DataFrame, domestic: Column, with_neighbours: bool = False) -> DataFrame:
    """code, name, alt, lat, lon, is_foreign of the rows in force.

    Codes and names lose the blanks around them and are empty where they are missing. Rows without a usable position go,
    and so do rows whose height is there but no number; an empty height is null. Repeated rows stay; an empty table gives
    an empty result; further columns are not looked at.
    """
    lat, lon = clean_number(F.col("lat")), clean_number(F.col("lon"))
    rows = table.filter((strip(F.col("valid_to")) == OPEN_END) & (domestic | F.lit(with_neighbours)))
    alt_ok = F.col("alt").isNull() | (F.col("alt") == "") | clean_number(F.col("alt")).isNotNull()
    rows = rows.filter(lat.isNotNull() & lon.isNotNull() & alt_ok)
    plain = lambda c: strip(F.coalesce(c, F.lit(""))).alias(c)
    return rows.select(plain("code"), plain("name"), clean_number(F.col("alt")).alias("alt"), lat.alias("lat"), lon.alias("lon"), F.when(domestic, 0).otherwise(1).alias("is_foreign"))
