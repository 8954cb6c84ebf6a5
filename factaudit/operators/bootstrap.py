"""Block bootstrap with draws fixed by a hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factaudit.operators.prefix import row_number
from factaudit.session import cut


def block_bootstrap(rows: DataFrame, block: str, value: str, draws: int = 2000, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(facts, components, draws, low, high): interval of the mean when whole blocks are drawn with replacement.

    ``rows`` has one value per fact.  Blocks are reduced to sums before they are drawn, so a draw touches
    one row per block.  The k-th pick of a draw is the hash of (draw, k) modulo the number of blocks, the
    same on every run; ``low`` and ``high`` are order statistics of the draws, not interpolated.
    """
    sums = rows.groupBy(block).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("double")).alias("s"))
    numbered = cut(row_number(sums, [], [F.asc(block)], "i").withColumn("i", F.col("i") - 1))
    total = numbered.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("facts"))
    picks = rows.sparkSession.range(draws).withColumnRenamed("id", "draw").crossJoin(F.broadcast(total)).where("k > 0").select("draw", "k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)).alias("j"))
    hashed = F.conv(F.substring(F.sha2(F.concat_ws("␟", F.col("draw").cast("string"), F.col("j").cast("string")), 256), 1, 12), 16, 10).cast("bigint")
    picked = picks.select("draw", F.pmod(hashed, F.col("k")).alias("i"))
    means = picked.join(numbered, "i").groupBy("draw").agg((F.sum("s") / F.sum("n")).alias("m"))
    # One mean per draw: as many rows as draws.
    ordered = means.agg(F.array_sort(F.collect_list("m")).alias("m"))
    at = lambda p: F.round(F.get("m", F.greatest(F.lit(0), F.ceil(F.size("m") * p).cast("int") - 1)), 9)
    return ordered.crossJoin(F.broadcast(total)).select("facts", F.col("k").alias("components"), F.size("m").cast("bigint").alias("draws"), at(low).alias("low"), at(high).alias("high"))
