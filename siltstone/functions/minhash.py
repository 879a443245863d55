"""MinHash signatures over command-line tokens, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signatures must agree with stored ones.
PERMUTATIONS = 64
PRIME = 4294967311
MULTIPLIERS = tuple((i * 10007 + 12345) % 100000 + 1 for i in range(PERMUTATIONS))
OFFSETS = tuple((i * 32452843 + 98765) % 100000 + 1 for i in range(PERMUTATIONS))
TOKEN = r"[a-zA-Z0-9_\-\.\:\\]+"


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens of at least two characters, in order of appearance; empty for null."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({TOKEN})"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, F.lower), lambda t: F.length(t) > 1))


def _hash(token: Column) -> Column:
    """First four bytes of the MD5 digest, least significant first."""
    hex_ = F.md5(token)
    swapped = F.concat(*(F.substring(hex_, i, 2) for i in (7, 5, 3, 1)))
    return F.conv(swapped, 16, 10).cast("bigint")


def signature(token_set: Column) -> Column:
    """64 minima of (a * h + b) mod p; zeros for an empty set."""
    hashes = F.transform(token_set, _hash)
    pairs = F.array(*(F.struct(F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for a, b in zip(MULTIPLIERS, OFFSETS)))
    lows = F.transform(pairs, lambda p: F.coalesce(F.array_min(F.transform(hashes, lambda h: F.pmod(p["a"] * h + p["b"], F.lit(PRIME)))), F.lit(0).cast("bigint")))
    return lows


def similarity(a: Column, b: Column) -> Column:
    """Share of equal positions, the estimate of the Jaccard similarity."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.lit(PERMUTATIONS)
