"""The pN_ queries: each applies one operator to its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factaudit.llm import answer_defects, consensus, group_splits, mixing, personal_information, split_overlap, tokenizer, value_mapping, visual_form
from factaudit.llm.fact_subject import subject_of
from factaudit.llm.oracle import ORACLE
from factaudit.session import cut, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = table(spark, sf_dir, "normalized_candidates").where("decision = 'ready'").select(
        F.lit("normalized_candidates").alias("table_name"), "line_number",
        answer_defects.defects(F.col("prompt_en"), F.col("answer"), F.col("canonical_fact"), "en").alias("defect"))
    zh = table(spark, sf_dir, "zh_translations").select(
        F.lit("zh_translations").alias("table_name"), "line_number",
        answer_defects.defects(F.col("prompt_zh"), F.col("answer_zh"), F.col("canonical_fact_zh"), "zh").alias("defect"))
    return ready.unionByName(zh).where("defect IS NOT NULL")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = split_overlap.overlapping_pairs(
        table(spark, sf_dir, "audit_records"), "audit_record_id", "question_normalized", "canonical_fact_normalized", "answer",
        "split_assignment", "development", ["validation", "sealed"])
    return pairs.selectExpr("record_a AS audit_record_id_a", "record_b AS audit_record_id_b")


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping pairs and records per evaluation split and source dataset."""
    counts = split_overlap.overlap_counts(
        table(spark, sf_dir, "audit_records"), "audit_record_id", "question_normalized", "canonical_fact_normalized", "answer",
        "split_assignment", "source_dataset", "development", ["validation", "sealed"])
    return counts.withColumnRenamed("split", "split_assignment").withColumnRenamed("source", "source_dataset")


def _tie_keys() -> list:
    return [F.col("split_group_id"), F.col("source_id"), subject_of(F.col("canonical_fact"), F.col("answer"))]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_splits.divided_records(table(spark, sf_dir, "audit_records"), "audit_record_id", "split_assignment", _tie_keys())


def p3_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "split_targets").selectExpr("split_assignment AS split", "target_share AS share")
    return group_splits.grouped_splits(table(spark, sf_dir, "audit_records"), "audit_record_id", _tie_keys(), targets)


def p3_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of the records per split."""
    reached = p3_assigned(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("component").alias("components"))
    whole = reached.agg(F.sum("records").alias("all"))
    targets = table(spark, sf_dir, "split_targets").selectExpr("split_assignment AS split", "target_share")
    return (targets.join(reached, "split", "left").fillna(0, ["records", "components"]).crossJoin(whole)
            .select("split", "target_share", (F.col("records") / F.col("all")).alias("reached_share"), "records", "components"))


def _annotated_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = consensus.last_votes(table(spark, sf_dir, "model_annotations"), "source_id", "model_name", "canonical_decision",
                                 "created_at", "received_at", "annotation_id", "field_conflicts")
    return cut(consensus.items_of(votes))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _annotated_items(spark, sf_dir)
    decided = consensus.consensus(items)
    return decided.where("labels >= 3 AND most < labels").selectExpr("item AS source_id", "label AS canonical_decision")


def p4_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _annotated_items(spark, sf_dir)
    decided = consensus.consensus(items)
    return decided.selectExpr("item AS source_id", "label AS canonical_decision", "confidence", "agreement", "labels", "support")


def p4_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.reliability(_annotated_items(spark, sf_dir)).withColumnRenamed("annotator", "model_name")


def _visual_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_name, line_number, field_name, values, context): one row per value of problem 5, as an array."""
    zh = table(spark, sf_dir, "zh_translations")
    said = "concat_ws(' ', answer_zh, prompt_zh, canonical_fact_zh, array_join(answer_aliases_zh, ' '))"
    aliases = table(spark, sf_dir, "audit_records").where("answer_aliases IS NOT NULL").selectExpr(
        "'audit_records' AS table_name", "line_number", "'answer_aliases' AS field_name",
        "answer_aliases AS values", "concat_ws(' ', answer, canonical_fact) AS context")
    for field in ("prompt_zh", "answer_zh"):
        aliases = aliases.unionByName(zh.where(f"{field} IS NOT NULL").selectExpr(
            "'zh_translations' AS table_name", "line_number", f"'{field}' AS field_name", f"array({field}) AS values", f"{said} AS context"))
    return aliases


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = _visual_values(spark, sf_dir)
    return values.where(visual_form.looks_alike(F.col("values"), F.col("context"))).select("table_name", "line_number", "field_name")


def p5_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visual_form.canonical_values(_visual_values(spark, sf_dir), "values", "canonical", "context").select("table_name", "line_number", "field_name", "canonical")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    references = value_mapping.relation_references(table(spark, sf_dir, "relation_catalog"))
    raw = table(spark, sf_dir, "raw_candidates").selectExpr(
        "'raw_candidates' AS table_name", "line_number", "source_snapshot.relation_raw AS value")
    ready = table(spark, sf_dir, "normalized_candidates").where("decision = 'ready'").selectExpr(
        "'normalized_candidates' AS table_name", "line_number", "relation_id AS value", "relation_definition AS definition")
    both = value_mapping.map_values(raw, "value", references).unionByName(
        value_mapping.map_values(ready, "value", references, fallback="definition").drop("definition"))
    return both.selectExpr("table_name", "line_number", "mapped_entry AS relation_id")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode_corpus(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", tokenizer.vocabulary_path(spark))


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text decoded from its ids, beside whether it equals the text that was encoded."""
    path = tokenizer.vocabulary_path(spark)
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = tokenizer.decode_corpus(cut(tokenizer.encode_corpus(documents, "doc_id", "text", path)), "doc_id", path)
    return (decoded.withColumnRenamed("text", "decoded").join(documents, "doc_id")
            .select("doc_id", "decoded", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("equal")))


def _token_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(F.struct("doc_id", "source").alias("doc"), "text")
    sizes = tokenizer.count_tokens(documents, "doc", "text", tokenizer.vocabulary_path(spark))
    return cut(sizes.select(F.col("doc.doc_id").alias("doc"), "doc.source", "tokens"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_token_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets"))
    return mixed.withColumnRenamed("doc", "doc_id")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, targets = _token_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    return mixing.shares(documents, targets, cut(mixing.mix(documents, targets)))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_information.find(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_information.redact(table(spark, sf_dir, "documents"), "doc_id", "text")


def queries() -> dict:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
