"""Inventories, clusters and complete sets of facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def relation_inventory(rows: DataFrame, relation: Column, subject: str, answer: str, order: str, examples: int) -> DataFrame:
    """One row per relation: counts, first values, a few examples in order, place by frequency.

    Examples are the first few by order within the group: candidates are cut by rank before they are
    gathered, so a frequent relation does not fill one task.
    """
    keyed = rows.withColumn("relation", relation)
    counts = keyed.groupBy("relation").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(subject).alias("subjects"), F.min(order).alias("first_line"), F.min_by(answer, F.when(F.col(answer).isNotNull(), F.col(order))).alias("first_answer"))
    ranked = keyed.where(F.col(answer).isNotNull()).withColumn("rn", F.row_number().over(Window.partitionBy("relation").orderBy(order))).where(F.col("rn") <= examples)
    few = ranked.groupBy("relation").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", F.col(answer).alias("a")))), lambda s: s["a"]), "|").alias("examples"))
    out = counts.join(few, "relation", "left")
    # The place needs one order over all relations: as many rows as there are relations.
    return out.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "relation")).cast("bigint"))


def cluster(records: DataFrame) -> DataFrame:
    """One row per base fact: members, groups, conflict of answers, representative and aliases."""
    rank = F.struct(F.when(F.col("split_assignment").isNull(), 1).otherwise(0), F.length("question"), "audit_record_id")
    facts = records.groupBy("base_fact_id").agg(
        F.count(F.lit(1)).alias("members"), F.count_distinct(F.coalesce("split_group_id", F.lit("<null>"))).alias("groups"),
        (F.count_distinct("answer_normalized") > 1).alias("conflict"), F.min_by("audit_record_id", rank).alias("representative"))
    aliases = records.select("base_fact_id", F.explode("answer_aliases").alias("a")).distinct().groupBy("base_fact_id").agg(F.array_join(F.array_sort(F.collect_list("a")), "|").alias("aliases"))
    return facts.join(aliases, "base_fact_id", "left")


def complete(rows: DataFrame, key: str, item: str, expected: DataFrame) -> DataFrame:
    """Keys that have every expected item (relational division); ``expected`` is a short list."""
    due = F.broadcast(expected.select(item).distinct())
    total = expected.select(item).distinct().agg(F.count(F.lit(1)).alias("__due"))
    have = rows.select(key, item).join(due, item).groupBy(key).agg(F.count_distinct(item).alias("__have"))
    return have.crossJoin(F.broadcast(total)).where("__have = __due").select(key)
