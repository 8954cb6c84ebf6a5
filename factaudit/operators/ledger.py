"""Run ledgers: what is pending, histories of attempts, progress by model, budgets and tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factaudit.operators.prefix import running_sum
from factaudit.session import shuffled


def pending(due: DataFrame, runs: DataFrame, key: str, outcome: str, order: list[str], failed: list) -> DataFrame:
    """(key, pending): keys never run, or whose last run failed."""
    last = runs.groupBy(key).agg(F.max_by(outcome, F.struct(*order)).alias("last"))
    state = F.when(F.col("last").isNull(), "never_run").when(F.col("last").isin(*failed), "retry")
    return due.join(last, key, "left").select(key, state.alias("pending")).where("pending IS NOT NULL")


def retry_history(runs: DataFrame, key: str, attempt: str, order: str) -> DataFrame:
    """(key, attempts, attempt_count, resumed): all attempts of a key in order, and their sum."""
    tries = F.array_sort(F.collect_list(F.struct(F.col(attempt).alias("n"), F.col(order).alias("o"))))
    return runs.groupBy(key).agg(F.array_join(F.transform(tries, lambda s: s["n"].cast("string")), ",").alias("attempts"), F.sum(attempt).alias("attempt_count"), (F.count(F.lit(1)) - 1).alias("resumed"))


def merge_progress(runs: DataFrame, key: str, model: str) -> DataFrame:
    """(key, results, models): the results of several models' runs side by side."""
    return runs.groupBy(key).agg(F.count(F.lit(1)).alias("results"), F.array_join(F.array_sort(F.collect_set(model)), ",").alias("models"))


def total_if_all_known(value: Column) -> Column:
    """The sum, or null where any part is unknown."""
    return F.when(F.count_if(value.isNull()) == 0, F.sum(value))


def attempts_in_window(events: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """``events`` with the number of the key's events in the last ``seconds``, itself included.

    An event counts from its time on and no more one microsecond after its window, so the number is a running
    sum over the times of both, dealt by range: neither the events of a key nor those of a window are gathered.
    Events without a time count each other, as those without a key do.
    """
    clock = F.unix_micros(F.col(at).cast("timestamp"))
    times = events.select(F.col(key).alias("__k"), clock.alias("__t")).groupBy("__k", "__t").agg(F.count(F.lit(1)).alias("__c"))
    steps = F.array(F.struct(F.col("__t"), F.col("__c").alias("d"), F.lit(1).alias("own")), F.struct((F.col("__t") + seconds * 1_000_000 + 1).alias("__t"), (-F.col("__c")).alias("d"), F.lit(0).alias("own")))
    moves = times.where("__t IS NOT NULL").select("__k", F.explode(steps).alias("s")).groupBy("__k", "s.__t").agg(F.sum("s.d").alias("__d"), F.max("s.own").alias("__own"))
    summed = running_sum(moves, ["__k"], [F.asc("__t")], F.col("__d"), "in_window").where("__own = 1").select("__k", "__t", "in_window")
    counted = summed.unionByName(times.where("__t IS NULL").select("__k", "__t", F.col("__c").alias("in_window")))
    met = F.col(key).eqNullSafe(F.col("__k")) & clock.eqNullSafe(F.col("__t"))
    return events.join(shuffled(counted), met).drop("__k", "__t")


def backoff(failures: Column, base: float = 2.0, most: float = 300.0) -> Column:
    """Seconds to wait after so many failures in a row."""
    return F.least(F.lit(most), F.pow(F.lit(base), failures.cast("double")))
