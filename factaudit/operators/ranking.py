"""Allocation, sampling, ranking and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factaudit.operators.prefix import row_number, running_sum


def top_per_group(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark keeps only ``n`` per group and task before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def largest_remainder(weights: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """(key, allocated): whole parts of a total by weight; what is left goes to the largest fractions.

    ``weights`` has one row per key (strata, not records).
    """
    whole = weights.agg(F.sum(weight).alias("__sum"))
    shares = weights.crossJoin(F.broadcast(whole)).withColumn("__exact", F.lit(total) * F.col(weight) / F.col("__sum")).withColumn("__floor", F.floor("__exact"))
    rest = shares.agg((F.lit(total) - F.sum("__floor")).alias("__rest"))
    ranked = shares.crossJoin(F.broadcast(rest)).withColumn("__rn", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round(F.col("__exact") - F.col("__floor"), 9)), key)))
    return ranked.select(key, (F.col("__floor") + (F.col("__rn") <= F.col("__rest")).cast("int")).cast("bigint").alias("allocated"))


def balanced_allocation(capacities: DataFrame, key: str, capacity: str, total: int) -> DataFrame:
    """(key, allocated): one unit at a time in key order until the total is met, within capacities.

    Round after round every key that still has room takes one.  Each unit a key could take is a row and
    one window orders them all, so this is for strata and quotas of small size (keys times ``total``).
    """
    rounds = capacities.select(key, F.explode(F.sequence(F.lit(1), F.least(F.col(capacity), F.lit(total)))).alias("round")).where(F.col("round") >= 1)
    ranked = rounds.withColumn("rn", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("round", key))).where(F.col("rn") <= total)
    return ranked.groupBy(key).agg(F.count(F.lit(1)).alias("allocated"))


def round_robin(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``rows`` with ``turn`` (1 for each group's first): sorting by (turn, group) interleaves them."""
    return row_number(rows, [group], order, "turn")


def stratified_sample(rows: DataFrame, stratum: str, per_stratum: int, rank: Column, key: str) -> DataFrame:
    """The first ``per_stratum`` rows of each stratum in hash order."""
    return top_per_group(rows, [stratum], [rank, F.asc(key)], per_stratum)


def seeded_sample(rows: DataFrame, stratum: str, key: str, per_stratum: int, seed: int) -> DataFrame:
    """A shuffle with the standard library's generator per stratum, for parity with older samples.

    Each stratum is one task; use it for strata of bounded size, else ``stratified_sample``.
    """
    import hashlib
    import random

    import pandas as pd

    def draw(group: pd.DataFrame) -> pd.DataFrame:
        name = str(group[stratum].iloc[0])
        keys = sorted(group[key].astype(str))
        random.Random(int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest(), 16)).shuffle(keys)
        return pd.DataFrame({stratum: name, key: keys[:per_stratum], "rank": range(1, len(keys[:per_stratum]) + 1)})

    return rows.select(stratum, F.col(key).cast("string").alias(key)).where(f"{stratum} IS NOT NULL").groupBy(stratum).applyInPandas(draw, f"{stratum} string, {key} string, rank int")


def hash_sample(rows: DataFrame, rank: Column, key: str, n: int) -> DataFrame:
    """The first ``n`` rows in hash order, with the weight each stands for."""
    total = rows.agg(F.count(F.lit(1)).alias("__total"))
    taken = rows.orderBy(rank, key).limit(n)
    return taken.crossJoin(F.broadcast(total)).withColumn("weight", F.col("__total") / F.least(F.col("__total"), F.lit(n))).drop("__total")


def first_occurrence(rows: DataFrame, key: str, order: list[str], row_id: str) -> DataFrame:
    """(row_id, kept, duplicate_of): the first row of each key is kept; null keys are all kept."""
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(row_id, F.struct(*order)).alias("__first"))
    marked = rows.join(first, key, "left")
    kept = F.col("__first").isNull() | (F.col("__first") == F.col(row_id))
    return marked.select(row_id, kept.alias("kept"), F.when(~kept, F.col("__first")).alias("duplicate_of"))


def argmax_with_margin(rows: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """Best label per key (ties: the smaller label), whether it is tied, and its lead on the second."""
    best = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(label).alias("l"))))
    top = rows.groupBy(*keys).agg(F.slice(best, 1, 2).alias("__top"))
    second = F.get("__top", 1)["s"]
    return top.select(*keys, F.get("__top", 0)["l"].alias("best"), F.coalesce(second == F.get("__top", 0)["s"], F.lit(False)).alias("tied"), (second - F.get("__top", 0)["s"]).alias("margin"))


def batches(rows: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """``rows`` with ``batch``: chunks of fixed size within each group, in order."""
    return row_number(rows, [group], [F.asc(order)], "__rn").withColumn("batch", F.floor((F.col("__rn") - 1) / size)).drop("__rn")


def quota_scan(rows: DataFrame, group: str, rank: str, accepted: str, quota: int) -> DataFrame:
    """(group, taken, gap): accepted rows up to the quota; ``gap`` where an undecided row comes before.

    ``accepted`` is true, false or null (undecided).
    """
    run = running_sum(rows, [group], [F.asc(rank)], F.coalesce(F.col(accepted), F.lit(False)).cast("int"), "__n")
    inside = run.where((F.col("__n") < quota) | ((F.col("__n") == quota) & F.coalesce(F.col(accepted), F.lit(False))))
    return inside.groupBy(group).agg(F.sum(F.coalesce(F.col(accepted), F.lit(False)).cast("bigint")).alias("taken"), F.bool_or(F.col(accepted).isNull()).alias("gap"))
