"""Name normalisation and repair; a null text stays null, and flags of null texts are 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def norm_name(s: Column) -> Column:
    """Lower case, umlauts spelled out, anything else but letters and digits one blank."""
    s = F.lower(strip(s))
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))


def mojibake(s: Column) -> Column:
    """Undoes UTF-8 read as Latin-1 where that is possible, else the text itself."""
    broken = s.rlike("[ÃÂâ]") & s.rlike("^[\\x00-\\xFF]*$")
    return F.coalesce(F.when(broken, F.try_validate_utf8(F.encode(F.when(broken, s), "ISO-8859-1").cast("string"))), s)


def name_match(a: Column, b: Column) -> Column:
    a, b = norm_name(a), norm_name(b)
    return F.when((a != "") & (b != "") & (a == b), 1).otherwise(0)


def clip(s: Column, length: int) -> Column:
    return F.substring(s, 1, length)


def clean_text(s: Column, null_word: bool = True) -> Column:
    """Trimmed text; '' and, if asked, the word NULL are missing."""
    t = strip(s)
    return F.when((t == "") | ((F.upper(t) == "NULL") if null_word else F.lit(False)), None).otherwise(t)


def clean_number(s: Column) -> Column:
    """A finite double or NULL."""
    d = s.cast("string").try_cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def whole_number(s: Column) -> Column:
    return clean_number(s).cast("int")


def parse_codes(s: Column) -> Column:
    """Sorted distinct integers of a comma-separated list, joined by commas."""
    codes = F.array_compact(F.transform(F.split(s, ","), lambda x: F.trim(x).try_cast("int")))
    return F.array_join(F.array_sort(F.array_distinct(codes)), ",")


def display(s: Column) -> Column:
    """A name for display: repaired and trimmed, '' missing."""
    return clean_text(mojibake(s), null_word=False)


def differ(a: Column, b: Column) -> Column:
    """1 if both texts are there and differ but for case."""
    return F.when((a != "") & (b != "") & (F.lower(a) != F.lower(b)), 1).otherwise(0)
