"""One decision per source record from two extractions and a reviewer, and the checks of a finished run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factaudit.functions import text as T
from factaudit.operators.validation import duplicates, violations

FIELDS = "subject relation answer fact".split()


def decided(pairs: DataFrame, key: str) -> DataFrame:
    """(key, decision, reason, chosen, conflicts, confidence) per pair of extractions.

    ``pairs`` has per side (``p_`` preferred, ``s_`` secondary) ok, the FIELDS and confidence, and ``review``
    (accept, reject or null).  Two failed sides exclude the record.  One failed side, or answers that do not
    compare as equal and filled, wait for a review, which rejects the record or accepts the preferred side if
    it is sound, else the other.  Two sound sides that agree keep the record, with the preferred fields.
    """
    p, s = F.col("p_ok"), F.col("s_ok")
    left, right = T.comparable_text(F.col("p_answer")), T.comparable_text(F.col("s_answer"))
    case = F.when(p != s, "single_model_extraction").when(p & ((left == "") | (left != right)), "dual_model_answer_conflict")
    review = F.col("review")
    neither = ~p & ~s
    decision = F.when(neither, "exclude").when(case.isNull(), "keep").when(review.isNull(), "pending_review").when(review == "reject", "exclude").otherwise("keep")
    reason = (
        F.when(neither, "both_models_not_extracted_or_invalid").when(case.isNull(), "dual_model_extraction_and_answer_consensus").when(review.isNull(), F.concat(case, F.lit("_requires_review")))
        .when(review == "reject", F.concat(F.lit("rejected_"), case)).otherwise(F.concat(F.lit("accepted_"), case))
    )
    kept = decision == "keep"
    # Where both agree on the answer it is no conflict by definition; under review it may be one.
    differ = [F.when((T.comparable_text(F.col(f"p_{f}")) != T.comparable_text(F.col(f"s_{f}"))) & (case.isNotNull() if f == "answer" else F.lit(True)), f) for f in FIELDS]
    confidence = F.when(case.isNull(), F.least(F.coalesce("p_confidence", F.lit(0.0)), F.coalesce("s_confidence", F.lit(0.0)))).otherwise(F.coalesce(F.when(p, F.col("p_confidence")).otherwise(F.col("s_confidence")), F.lit(0.0)))
    return pairs.select(
        key, decision.alias("decision"), reason.alias("reason"), F.when(kept, F.when(p, "preferred").otherwise("secondary")).alias("chosen"),
        F.when(kept, F.array_compact(F.array(*differ))).alias("conflicts"), F.when(kept, confidence).alias("confidence"))


def _differ(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that one side has and the other lacks."""
    one, two = left.select(key).distinct(), right.select(key).distinct()
    return one.join(two, key, "left_anti").unionByName(two.join(one, key, "left_anti"))


def run_violations(source: DataFrame, canonical: DataFrame, normalised: DataFrame, prompts: DataFrame, distractors: DataFrame) -> DataFrame:
    """(check_name, id): every violation of a run's contracts; no rows mean that the run is sound.

    ``source`` (source_id, choices), ``canonical`` (source_id, choices), ``normalised`` (source_id, status,
    relation), ``prompts`` (source_id, status, prompt, expected, rejection), ``distractors`` (source_id,
    choices, source_answer, answer, wrong_options, candidates).
    """
    known = canonical.join(source.withColumnRenamed("choices", "own"), "source_id")
    mapped, generated = F.col("status") == "mapped", F.col("status") == "generated"
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    keys = lambda: F.array(T.comparable_text(F.col("source_answer")), T.comparable_text(F.col("answer")))
    options = distractors.select("source_id", "choices", "wrong_options", "candidates", keys().alias("keys"))
    each = options.select("source_id", "keys", F.posexplode("choices").alias("at", "choice")).withColumn("plain", T.comparable_text(F.col("choice")))
    wrong = each.where(~F.array_contains("keys", F.col("plain"))).groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("at", "choice"))).alias("w")).select("source_id", F.col("w.choice").alias("due"))
    none = F.array().cast("array<string>")
    offered = options.select("source_id", "keys", "choices", F.explode("candidates").alias("candidate")).withColumn("plain", T.comparable_text(F.col("candidate")))
    ids = lambda df: df.select("source_id").distinct()
    return violations([
        ("duplicate_canonical", duplicates(canonical, "source_id")),
        ("canonical_without_source", ids(canonical.join(source, "source_id", "left_anti"))),
        ("source_choices_changed", ids(known.where(~F.col("choices").eqNullSafe(F.col("own"))))),
        ("normalised_ids_differ", _differ(canonical, normalised, "source_id")),
        ("prompt_ids_differ", _differ(canonical, prompts, "source_id")),
        ("status_relation_mismatch", ids(normalised.where(F.coalesce(mapped, F.lit(False)) == blank("relation")))),
        ("generated_prompt_incomplete", ids(prompts.where(generated & (blank("prompt") | blank("expected"))))),
        ("rejected_prompt_without_reason", ids(prompts.where(~F.coalesce(generated, F.lit(False)) & blank("rejection")))),
        ("distractor_ids_differ", _differ(prompts.where(generated), distractors, "source_id")),
        ("wrong_options_mismatch", ids(options.join(wrong, "source_id", "left").where(F.coalesce("wrong_options", none) != F.coalesce("due", none)))),
        ("distractor_absent_from_choices", ids(offered.where(~F.coalesce(F.array_contains("choices", F.col("candidate")), F.lit(False))))),
        ("answer_leaked_into_distractors", ids(offered.where(F.array_contains("keys", F.col("plain"))))),
    ])
