"""Measures over model answers: rates, three-valued flags, arms, fact-weighted means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reward(original: Column, translated: Column, p: float = 2, q: float = 2, r: float = 3, alpha: float = 20) -> Column:
    """High where a question is answered well as it was and badly when translated."""
    return F.log1p(F.pow(original, F.lit(p)) / (F.pow(translated, F.lit(q)) + 0.001)) - alpha * F.pow(1 - original, F.lit(r))


def any_known(column: str) -> Column:
    """OR over a group: true if any is, unknown if none is and one is unknown, else false."""
    c = F.col(column)
    return F.when(F.bool_or(c), True).when(F.count(F.lit(1)) > F.count(c), F.lit(None).cast("boolean")).otherwise(False)


def all_known(column: str) -> Column:
    """AND over a group: false if any is, unknown if none is and one is unknown, else true."""
    c = F.col(column)
    return F.when(~F.bool_and(c), False).when(F.count(F.lit(1)) > F.count(c), F.lit(None).cast("boolean")).otherwise(True)


def panel_rate(score: Column, succeeded: Column) -> Column:
    """Mean score of the replies that succeeded; 0.0 if none did."""
    return F.coalesce(F.avg(F.when(succeeded, score.cast("double"))), F.lit(0.0))


def fact_weighted(rows: DataFrame, keys: list[str], fact: str, value: Column, into: str) -> DataFrame:
    """The mean over facts of each fact's mean, so that a fact counts once whatever its variants."""
    inner = rows.groupBy(*keys, fact).agg(F.avg(value).alias("m"))
    return inner.groupBy(*keys).agg(F.avg("m").alias(into), F.count(F.lit(1)).alias("facts"))


def adjudicated_only(rows: DataFrame, keys: list[str], fact: str, verdict: str, into: str) -> DataFrame:
    """Fact-weighted accuracy over facts that have no unknown verdict."""
    inner = rows.groupBy(*keys, fact).agg(F.avg(F.col(verdict).cast("double")).alias("m"), F.count(F.lit(1)).alias("n"), F.count(verdict).alias("known"))
    return inner.where("n = known").groupBy(*keys).agg(F.avg("m").alias(into), F.count(F.lit(1)).alias("facts"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the order columns; an aggregate, so partial on the map side."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def arms(rows: DataFrame, keys: list[str], arm: str, names: list[str], value: str) -> DataFrame:
    """One row per key with a column per arm; an arm that is missing is null."""
    return rows.groupBy(*keys).agg(*[F.max(F.when(F.col(arm) == n, F.col(value))).alias(n) for n in names])


def share_of(column: str, *partition: str) -> Column:
    return F.col(column) / F.sum(column).over(Window.partitionBy(*partition))


def frozen_candidates(cells: DataFrame, candidate: str, english_floor: float) -> DataFrame:
    """(candidate, badcase): candidates with results in every cell whose treatment does harm in Chinese only.

    ``cells`` (candidate, language, variant, correct).  The control floor is the lower of the original's and
    the neutral arm's accuracy: a perfect floor that breaks is induced, a lower one that falls is amplified.
    """
    names = [f"{lang}_{variant}" for lang in ("en", "zh") for variant in ("original", "neutral", "targeted")]
    name = F.concat_ws("_", "language", "variant")
    acc = cells.groupBy(candidate).agg(*[F.avg(F.when(name == n, F.col("correct").cast("int"))).alias(n) for n in names])
    whole = acc.where(" AND ".join(f"{n} IS NOT NULL" for n in names)).withColumn("floor", F.least("zh_original", "zh_neutral"))
    induced, amplified = (F.col("floor") == 1.0) & (F.col("zh_targeted") < 1.0), (F.col("floor") < 1.0) & (F.col("zh_targeted") < F.col("floor"))
    kept = whole.where((F.col("en_targeted") >= english_floor) & (induced | amplified))
    return kept.select(candidate, F.when(induced, "induced").otherwise("amplified").alias("badcase"))
