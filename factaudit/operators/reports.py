"""Reports over checks and ordered assembly of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factaudit.operators.validation import violations


def preflight(checks: list[tuple[str, DataFrame]], examples: int) -> DataFrame:
    """(blocker, n, examples): how many ids each check blocks, and the first few of them."""
    rows = violations(checks)
    counts = rows.groupBy(F.col("check_name").alias("blocker")).agg(F.count(F.lit(1)).alias("n"))
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy("check_name").orderBy("id"))).where(F.col("rn") <= examples)
    few = ranked.groupBy(F.col("check_name").alias("blocker")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "id"))), lambda s: s["id"]), "|").alias("examples"))
    return counts.join(few, "blocker")


def markdown_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One line of a markdown table per row."""
    cells = F.concat_ws(" | ", *[F.col(c).cast("string") for c in columns])
    return rows.select(F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))


def assemble(parts: DataFrame, key: str, order: list[str], text: str, glue: str) -> DataFrame:
    """(key, stream, deltas): the parts of each key joined in order; a key's parts fit one row."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__t")))), lambda s: s["__t"]), glue)
    return parts.groupBy(key).agg(joined.alias("stream"), F.count(F.lit(1)).alias("deltas"))
