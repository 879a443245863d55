"""Canonical spellings of hosts, users and codes, and the choice of one row per source record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blanks of all kinds, and the two characters without width that stand for one.
BLANKS = " \t\n\x0b\x0c\r\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\u200b\ufeff"


def trimmed(value: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.btrim(value, F.lit(BLANKS))


def present(value: Column) -> Column:
    """Null for the spellings of a missing value: null, '-' and empty."""
    return F.nullif(F.nullif(value, F.lit("")), F.lit("-"))


def host_key(host: Column) -> Column:
    """First label of the host name, trimmed, upper case; null where missing."""
    return present(F.upper(trimmed(F.split_part(trimmed(host), F.lit("."), F.lit(1)))))


def user_key(user: Column, domains: tuple[str, ...] = ("quillmere.example", "quillmere")) -> Column:
    """Trimmed lower-case account without the estate's domain; other prefixes are kept."""
    names = "|".join(d.replace(".", r"\.") for d in domains)
    bare = F.regexp_replace(trimmed(user), rf"(?i)^(?:{names})\\|@(?:{names})$", "")
    return present(F.lower(trimmed(bare)))


def code_key(code: Column) -> Column:
    """Trimmed event code; null where missing."""
    return present(trimmed(code))


def one_per_record(df: DataFrame, record: str, *order: str) -> DataFrame:
    """Keep the first row, by order, of every source record; rows without a record key all stay.

    Ranking with a limit of one is applied before the shuffle as well as after it, so a record
    delivered very often does not gather in one task.
    """
    key = F.coalesce(F.col(record), F.concat_ws("\u0000", F.lit(""), *(F.col(c).cast("string") for c in order)))
    by = Window.partitionBy("__record").orderBy(*order)
    ranked = df.withColumn("__record", key).withColumn("__rank", F.row_number().over(by))
    return ranked.where("__rank = 1").drop("__rank", "__record")
