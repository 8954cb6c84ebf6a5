"""Joins that keep their balance when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is heavy when it holds more than this share of the rows, so at most 1 / share keys are.
HEAVY_SHARE = 0.001


def heavy_keys(rows: DataFrame, key: str, share: float = HEAVY_SHARE) -> DataFrame:
    """The keys that each hold more than ``share`` of the rows: at most 1 / share of them."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return counts.crossJoin(F.broadcast(total)).where(F.col("n") > F.greatest(F.col("total") * share, F.lit(1000))).select(key)


def skewed_lookup(rows: DataFrame, lookup: DataFrame, key: str, heavy: DataFrame, how: str = "left") -> DataFrame:
    """Join ``lookup`` (one row per key) to ``rows`` whose heavy keys are listed in ``heavy``.

    Rows of heavy keys stay where they are and meet a broadcast of those keys' entries, whose number
    is bounded by ``heavy_keys``; all other rows are joined by shuffle.  Null keys match nothing.
    """
    listed = F.broadcast(heavy.withColumn("__heavy", F.lit(True)))
    marked = rows.join(listed, key, "left")
    hot_entries = F.broadcast(lookup.join(F.broadcast(heavy), key, "left_semi"))
    hot = marked.where("__heavy").drop("__heavy").join(hot_entries, key, how)
    cold = marked.where("__heavy IS NULL").drop("__heavy").join(lookup, key, how)
    return hot.unionByName(cold)


def salted(column: Column, buckets: int) -> Column:
    """A stable salt below ``buckets`` made from a column's value."""
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def salted_join(rows: DataFrame, members: DataFrame, key: str, heavy: DataFrame, member: str, salts: int = 64) -> DataFrame:
    """Inner join of ``rows`` and the ``members`` of their keys, where both may have many rows per key.

    Members of a heavy key (see ``heavy_keys``) are dealt over ``salts`` buckets by a hash of ``member``,
    and the rows of such a key go to every bucket, so no task meets all of a hot key.
    """
    listed = F.broadcast(heavy.withColumn("__heavy", F.lit(True)))
    dealt = members.join(listed, key, "left").withColumn("__salt", F.when(F.col("__heavy"), salted(F.col(member), salts)).otherwise(0)).drop("__heavy")
    copies = F.when(F.col("__heavy"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    spread_rows = rows.join(listed, key, "left").withColumn("__salt", F.explode(copies)).drop("__heavy")
    return spread_rows.join(dealt, [key, "__salt"]).drop("__salt")
