"""Operators over array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique_strings(rows: DataFrame, key: str, array: str, into: str) -> DataFrame:
    """One row per key with the array's strings, first wins by lower-case key, blanks dropped.

    Rows whose array is null or holds only blanks give no row.
    """
    items = rows.select(key, F.posexplode(array).alias("pos", "item")).where("trim(item) <> ''")
    first = items.groupBy(key, F.lower(F.trim("item")).alias("k")).agg(F.min(F.struct("pos", F.trim("item").alias("item"))).alias("first"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("first")), lambda x: x["item"]).alias(into))


def common_prefix_length(first: Column, *others: Column) -> Column:
    """How many leading items all arrays share."""
    shortest = F.least(F.size(first), *[F.size(o) for o in others])
    places = F.sequence(F.lit(1), F.greatest(shortest, F.lit(1)))
    same = lambda i: F.array_max(F.transform(F.array(*others), lambda o: F.when(F.get(o, i - 1) == F.get(first, i - 1), 0).otherwise(1))) == 0
    differs = F.filter(places, lambda i: ~F.coalesce(same(i), F.lit(False)))
    return F.when(shortest == 0, 0).when(F.size(differs) == 0, shortest).otherwise(F.element_at(differs, 1) - 1)


def mean_vectors(rows: DataFrame, keys: list[str], vector: str, into: str) -> DataFrame:
    """The mean vector of each group, item by item, in the vector's order."""
    items = rows.select(*keys, F.posexplode(vector).alias("pos", "x"))
    means = items.groupBy(*keys, "pos").agg(F.avg("x").alias("m"))
    return means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias(into))


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
