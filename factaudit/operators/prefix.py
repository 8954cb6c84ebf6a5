"""Row numbers, running sums and exact percentiles of groups of any size.

A window over a few large groups puts each group into one task.  Here rows are range-partitioned by group
and order, so a group is many partitions; each partition is numbered by itself, and what the partitions
before it hold of the same group is added.  That table has one row per group and partition it reaches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factaudit.session import cut

#: Offsets are broadcast only up to this many rows.
BROADCAST_ROWS = 100_000


def _dealt(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    keys = [F.asc(g) for g in group] + order
    return cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)))


def _joined(dealt: DataFrame, parts: DataFrame, group: list[str]) -> DataFrame:
    small = parts.select("__part", *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], "__before", "__first")
    small = F.broadcast(small) if small.count() <= BROADCAST_ROWS else small
    small = small.withColumnRenamed("__part", "__p")
    met = F.col("__part") == F.col("__p")
    for i, g in enumerate(group):
        met = met & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return dealt.join(small, met).drop("__p", *[f"__g{i}" for i in range(len(group))])


def row_number(rows: DataFrame, group: list[str], order: list[Column], into: str) -> DataFrame:
    """``rows`` with ``into``: 1 for the first row of its group in ``order``, and so on.

    ``order`` must leave no ties, else tied rows are numbered in any order.  Null keys form a group.
    """
    dealt = _dealt(rows, group, order)
    parts = dealt.groupBy(*group, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut(parts.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))))
    return _joined(dealt, parts, group).withColumn(into, F.col("__at") - F.col("__first") + F.col("__before") + 1).drop("__at", "__part", "__before", "__first")


def running_sum(rows: DataFrame, group: list[str], order: list[Column], value: Column, into: str) -> DataFrame:
    """``rows`` with ``into``: the sum of ``value`` over its group up to and including the row."""
    dealt = _dealt(rows.withColumn("__v", value), group, order)
    parts = dealt.groupBy(*group, "__part").agg(F.sum("__v").alias("__n"), F.min("__at").alias("__first"))
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut(parts.withColumn("__before", F.sum("__n").over(earlier)))
    inside = Window.partitionBy(*group, "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = dealt.withColumn("__inside", F.sum("__v").over(inside))
    out = _joined(summed, parts, group)
    whole = F.when(F.col("__inside").isNull() & F.col("__before").isNull(), None).otherwise(F.coalesce("__inside", F.lit(0)) + F.coalesce("__before", F.lit(0)))
    return out.withColumn(into, whole).drop("__at", "__part", "__before", "__first", "__inside", "__v")


def percentiles(rows: DataFrame, group: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """(*group, *at): exact percentiles with linear interpolation; null values do not count.

    Values are counted before they are ordered, so a value that comes often is one row.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("__c"))
    summed = running_sum(counts, group, [F.asc(value)], F.col("__c"), "__upto")
    total = summed.groupBy(*group).agg(F.max("__upto").alias("__total")).select(*[F.col(g).alias(f"__k{i}") for i, g in enumerate(group)], "__total")
    met = F.lit(True)
    for i, g in enumerate(group):
        met = met & F.col(g).eqNullSafe(F.col(f"__k{i}"))
    both = summed.join(total, met) if group else summed.crossJoin(F.broadcast(total))
    out = []
    for name, p in at.items():
        place = F.lit(p) * (F.col("__total") - 1)
        low, high = (F.min(F.when(F.col("__upto") > f(place), F.col(value))) for f in (F.floor, F.ceil))
        share = F.max(place - F.floor(place))
        out.append((low + (high - low) * share).alias(name))
    return both.groupBy(*group).agg(*out)
