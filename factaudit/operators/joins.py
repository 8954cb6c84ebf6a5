"""Joins of the engine: full cover, mapping, rules, overlap, donors, grids and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reconcile(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, status, conflicts): two extractions side by side, null-safe field by field.

    ``status``: consensus, conflict, only_left, only_right.  Keys are unique on either side.
    """
    a = left.select(key, F.lit(True).alias("__l"), *[F.col(f).alias(f"__l_{f}") for f in fields])
    b = right.select(key, F.lit(True).alias("__r"), *[F.col(f).alias(f"__r_{f}") for f in fields])
    both = a.join(b, key, "full_outer")
    differ = F.array_compact(F.array(*[F.when(~F.col(f"__l_{f}").eqNullSafe(F.col(f"__r_{f}")), f) for f in fields]))
    status = F.when(F.col("__r").isNull(), "only_left").when(F.col("__l").isNull(), "only_right").when(F.size("conflicts") == 0, "consensus").otherwise("conflict")
    return both.withColumn("conflicts", differ).select(key, status.alias("status"), F.when(F.col("__l") & F.col("__r"), F.col("conflicts")).otherwise(F.array().cast("array<string>")).alias("conflicts"))


def override(base: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``base`` with the non-null fields of ``changes`` in place of its own."""
    c = changes.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    out = base.join(c, key, "left")
    return out.select(*[F.coalesce(f"__{f}", f).alias(f) if f in fields else F.col(f) for f in base.columns])


def classify(value: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """The label of the first pattern that is found in the value; generated code, no join."""
    chain = None
    for label, pattern in rules:
        chain = F.when(value.rlike(pattern), label) if chain is None else chain.when(value.rlike(pattern), label)
    return chain.otherwise(otherwise)


def key_overlap(left: DataFrame, right: DataFrame, keys: dict[str, list[Column]]) -> DataFrame:
    """(key_name, left_records, shared_keys) per composite key; a key with a null part is none.

    Only distinct keys of the right side travel; the left side is counted per key first.
    """
    out = None
    for name, parts in keys.items():
        full = F.when(~F.greatest(*[p.isNull().cast("int") for p in parts], F.lit(0)).cast("boolean"), F.concat_ws("␟", *parts))
        l = left.select(full.alias("k")).where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n"))  # noqa: E741
        r = right.select(full.alias("k")).where("k IS NOT NULL").distinct()
        one = l.join(r, "k", "left_semi").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("left_records"), F.count(F.lit(1)).alias("shared_keys")).select(F.lit(name).alias("key_name"), "left_records", "shared_keys")
        out = one if out is None else out.unionByName(one)
    return out


def align(rows: DataFrame, question: str, answer: str, external: DataFrame, ext_question: str, ext_answers: str) -> DataFrame:
    """``rows`` with ``alignment``: aligned (one external row has the question and the answer), ambiguous
    (several), conflict (the question only) or pending (neither).

    External rows are counted per question and answer; no question's rows are gathered.
    """
    asked = external.select(F.col(ext_question).alias("__q")).where("__q IS NOT NULL").distinct().withColumn("__asked", F.lit(True))
    each = external.select(F.col(ext_question).alias("__p"), F.explode(F.array_distinct(ext_answers)).alias("__a")).groupBy("__p", "__a").agg(F.count(F.lit(1)).alias("__n"))
    met = rows.join(asked, F.col(question) == F.col("__q"), "left").join(each, (F.col(question) == F.col("__p")) & (F.col(answer) == F.col("__a")), "left")
    status = F.when(F.col("__n") == 1, "aligned").when(F.col("__n") > 1, "ambiguous").when(F.col("__asked"), "conflict").otherwise("pending")
    return met.withColumn("alignment", status).drop("__q", "__asked", "__p", "__a", "__n")


def donors(targets: DataFrame, pool: DataFrame, on: list[str], key: str, differ: list[str], take: int, order: Column) -> DataFrame:
    """(key, donor, rank): for each target up to ``take`` donors that share ``on`` and differ elsewhere.

    Donors of a bucket are ranked once by ``order``; a target looks at the first few of its bucket
    only: enough that ``take`` of them must differ, so no bucket is paired with itself in full.
    """
    if len(differ) != 1:
        raise ValueError("donors differ in one column; join several into one")
    window = Window.partitionBy(*on).orderBy(order, key)
    # One candidate per differing value suffices: a target excludes at most one value per column.
    first = pool.withColumn("__rn", F.row_number().over(Window.partitionBy(*on, *differ).orderBy(order, key))).where("__rn = 1")
    near = first.withColumn("__rank", F.row_number().over(window)).where(F.col("__rank") <= take + len(differ) * take + 1)
    d = near.select(*on, F.col(key).alias("donor"), "__rank", *[F.col(c).alias(f"__{c}") for c in differ])
    joined = targets.select(key, *on, *differ).join(d, on)
    for c in differ:
        joined = joined.where(F.col(c) != F.col(f"__{c}"))
    ranked = joined.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("__rank")))
    return ranked.where(F.col("rank") <= take).select(key, "donor", "rank")


#: A dimension of a grid has at most this many rows.
MOST_LEVELS = 10_000


def grid(*dimensions: DataFrame) -> DataFrame:
    """All combinations of a table with small dimensions (names of models, languages, arms)."""
    out = dimensions[0]
    for dim in dimensions[1:]:
        if dim.limit(MOST_LEVELS + 1).count() > MOST_LEVELS:
            raise ValueError(f"a dimension has more than {MOST_LEVELS} rows")
        out = out.crossJoin(F.broadcast(dim))
    return out


def drift(previous: DataFrame, current: DataFrame, key: str, label: str) -> DataFrame:
    """(before, after, n): how labels of the keys of both rounds moved."""
    both = previous.select(key, F.col(label).alias("before")).join(current.select(key, F.col(label).alias("after")), key)
    return both.groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))


def symmetric_difference(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of one side only, with the side."""
    a, b = left.select(*columns), right.select(*columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def overlap_audit(rows: DataFrame, current: Column, comparison: Column, keys: dict[str, list[str]]) -> DataFrame:
    """Per named key: valid records and unique keys of both sides, and what of the current side the other has.

    All keys are counted in one pass: each row gives one (name, key) per key without nulls, and rows of the
    same key are summed before and after the shuffle, so a frequent key is no hot task.
    """
    named = F.array(*[F.struct(F.lit(name).alias("key_name"), F.when(F.greatest(*[F.col(c).isNull() for c in columns], F.lit(False)), None).otherwise(F.concat_ws("\x1f", *columns)).alias("k")) for name, columns in keys.items()])
    counts = rows.select(current.alias("cur"), comparison.alias("cmp"), F.explode(named).alias("x")).where("x.k IS NOT NULL").groupBy("x.key_name", "x.k").agg(F.count_if("cur").alias("cur"), F.count_if("cmp").alias("cmp"))
    return counts.groupBy("key_name").agg(
        F.sum("cur").alias("current_valid"), F.sum("cmp").alias("comparison_valid"), F.count_if(F.col("cur") > 0).alias("current_unique"), F.count_if(F.col("cmp") > 0).alias("comparison_unique"),
        F.coalesce(F.sum(F.when(F.col("cmp") > 0, F.col("cur"))), F.lit(0)).alias("record_overlap"), F.count_if((F.col("cur") > 0) & (F.col("cmp") > 0)).alias("unique_overlap"))
