"""Stable identifiers, hash orders and hash scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Joins the parts of a stable id.
SEPARATOR = "␟"


def stable_id(prefix: str, *parts: Column, length: int = 20) -> Column:
    """``prefix`` and the first hex digits of the SHA-256 of the joined parts; null parts are empty."""
    joined = F.concat_ws(SEPARATOR, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, length))


def hash_rank(seed: str, salt: str, key: Column) -> Column:
    """What to sort by for an order that depends on seed and salt alone."""
    return F.sha2(F.concat_ws(SEPARATOR, F.lit(seed), F.lit(salt), key.cast("string")), 256)


def hash_score(key: Column) -> Column:
    """A number in [0, 1) from the first 13 hex digits of the SHA-256, exact as a double."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(16**13))


def seeded_score(seed: str, key: Column) -> Column:
    """A number in [0, 1) from the first 16 hex digits of the SHA-256 of seed and key: 64 unsigned bits, as a double."""
    bits = F.conv(F.substring(F.sha2(F.concat_ws(SEPARATOR, F.lit(seed), key), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return bits.cast("double") / F.lit(float(16**16))


def split_by_score(score: Column, shares: list[tuple[str, float]]) -> Column:
    """The split whose cumulative share first exceeds the score; the last takes the rest."""
    total, chain = 0.0, None
    for name, share in shares[:-1]:
        total += share
        chain = F.when(score < total, name) if chain is None else chain.when(score < total, name)
    return chain.otherwise(shares[-1][0]) if chain is not None else F.lit(shares[-1][0])
