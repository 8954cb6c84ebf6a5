"""Row rules: error arrays, first failing reason, violations as rows, uniqueness and cover."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rules = list[tuple[str, Column]]


def reasons(rules: Rules) -> Column:
    """The names of the rules that hold, in order; a rule that is unknown does not hold."""
    return F.array_compact(F.array(*[F.when(test, name) for name, test in rules]))


def first_reason(rules: Rules) -> Column:
    """The first rule that holds, or null."""
    return F.coalesce(*[F.when(test, name) for name, test in rules])


def zoned_timestamp(text: Column) -> Column:
    """Whether a text is an ISO 8601 time with a zone."""
    return text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$")


def violations(checks: list[tuple[str, DataFrame]]) -> DataFrame:
    """(check, id) over all checks; each frame holds the ids that fail one. Empty means valid."""
    return reduce(DataFrame.unionByName, [f.select(F.lit(name).alias("check_name"), F.col(f.columns[0]).cast("string").alias("id")) for name, f in checks])


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Keys that more than one row has."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key)


def missing_references(rows: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """Non-null keys of ``rows`` that ``known`` lacks."""
    return rows.where(F.col(key).isNotNull()).select(key).join(known.select(F.col(known_key).alias(key)).distinct(), key, "left_anti").distinct()


def exact_cover(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """(key, problem): keys decided twice, not at all, or outside what was expected."""
    counts = observed.groupBy(key).agg(F.count(F.lit(1)).alias("seen"))
    both = expected.select(key).distinct().withColumn("due", F.lit(True)).join(counts, key, "full_outer")
    problem = F.when(F.col("due").isNull(), "unexpected").when(F.col("seen").isNull(), "missing").when(F.col("seen") > 1, "repeated")
    return both.select(key, problem.alias("problem")).where("problem IS NOT NULL")
