"""Rules against expected rows stated by hand."""

import pytest
from pyspark.sql import functions as F

from factaudit.functions import text
from factaudit.operators import canonical, extraction, prefix, ranking, relations


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_normalisers_fold_beyond_ascii(spark):
    rows = [("Ｆｕｌｌ　Width STRASSE ß",), ("The  Café-Bar_9",), ("中文，AB",), (None,), ("",)]
    got = values(spark, rows, "t string", text.normalize_text(F.col("t")), text.normalize_lexical(F.col("t")), text.normalize_match_text(F.col("t")), text.alnum_key(F.col("t")), text.comparable_text(F.col("t")))
    assert got == [
        ("full width strasse ss", "full width strasse ss", "full width strasse ss", "fullwidthstrassess", "fullwidthstrassess"),
        ("the café-bar_9", "the café bar 9", "the café bar_9", "thecafébar9", "cafbar9"),
        ("中文,ab", "中文 ab", "中文 ab", "中文ab", "ab"), ("", None, None, None, ""), ("", "", "", "", "")]


@pytest.fixture(scope="module")
def answers(spark):
    rows = [
        ("Paris", "the Paris"), ("the Paris", "Paris."), ("river Seine", "the Seine is a river"), ("Lyon", "Paris"), ("", "Paris"), ("melting pont of iron", "melting point of iron"),
        ("gravity", "It pulls all the things on earth down to it"), ("heat", "The sun warms the ground all day."), ("x", "a b c d e f g h i: j"), ("energy", "One two three four five six seven eight nine ten eleven twelve thirteen"),
    ]
    return spark.createDataFrame(rows, "answer string, source string")


def test_suitability_and_grounding(answers):
    got = [tuple(r) for r in answers.select(extraction.answer_unsuitable(F.col("source")), extraction.grounded(F.col("answer"), F.col("source"))).collect()]
    assert got == [(False, True), (False, True), (False, True), (False, False), (False, False), (False, False), (True, False), (True, False), (True, False), (True, False)]


def test_repair_replaces_near_matches_and_downgrades_sentences(answers):
    fixed = extraction.repaired(F.lit("extracted"), F.col("answer"), F.col("source"))
    got = [tuple(r.x) for r in answers.select(fixed.alias("x")).collect()]
    near, down = "answer_near_match_replaced_with_source_answer", "ungrounded_sentence_answer_downgraded_to_not_extractable"
    assert got[0] == ("extracted", "Paris", None) and got[3] == ("extracted", "Lyon", None)
    assert got[5] == ("extracted", "melting point of iron", near)
    assert got[6:] == [("not_extractable", None, down)] * 4
    assert answers.select(extraction.repaired(F.lit("failed"), F.col("answer"), F.col("source")).alias("x")).first().x.change is None


def test_completions_and_tiers(spark):
    rows = [("The capital of France is Paris.", "paris", "Q?"), ("The capital is: Paris", "Paris", "Q?"), ("It is Comparis", "Paris", " Which? "), ("Paris", "Paris", "Q?"), ("Paris is big", "Paris", "Q?"), (None, "Paris", "Q?")]
    made = extraction.prompt(F.col("f"), F.col("a"), F.col("q"))
    got = values(spark, rows, "f string, a string, q string", extraction.fact_completion(F.col("f"), F.col("a")), made["prompt"], made["tier"])
    strict, fallback = extraction.STRICT, extraction.FALLBACK
    assert got == [("The capital of France is", "The capital of France is", strict), ("The capital is", "The capital is", strict), (None, "Factual question: Which?\nAnswer:", fallback)] + [(None, "Factual question: Q?\nAnswer:", fallback)] * 3


def test_risk_flags_need_a_choice_question_without_completion(spark):
    rows = [("multiple_choice", "open_answer_fallback", "Which of the following is NOT a metal?"), ("open_qa", "open_answer_fallback", "Which of the following is not?"), ("multiple_choice", "strict_factual_completion", "Fill the ____"), ("multiple_choice", "open_answer_fallback", "A cell has")]
    got = values(spark, rows, "f string, t string, q string", extraction.risk_flags(F.col("f"), F.col("t"), F.col("q")))
    risk = extraction.STRUCTURE_RISK
    assert [x[0] for x in got] == [[risk, "mcq_fallback_explicit_choice_reference", "mcq_fallback_negative_or_exception"], [], [], [risk, "mcq_fallback_incomplete"]]


def test_reply_errors_and_filter(spark):
    fields = {c: F.col(c) for c in extraction.TRIPLE_FIELDS}
    schema = "status string, confidence double, reason string, subject string, subject_type string, relation_raw string, answer string, answer_type string, canonical_fact string, source string"
    rows = [
        ("extracted", 0.9, None, "France", "country", "capital", "Paris", "city", "The capital of France is Paris", "Paris"),
        ("extracted", 1.2, "other", "Paris", "city", " ", "Paris", "city", "x", "London"),
        ("not_extractable", 0.5, "no such reason", None, None, None, "Paris", None, None, "Paris"),
        ("defer", None, None, None, None, None, None, None, None, None),
    ]
    errors = extraction.reply_errors(F.col("status"), F.col("confidence"), F.col("reason"), fields, F.col("source"))
    got = values(spark, rows, schema, errors, extraction.filter_reason(F.lit("completed"), F.col("status"), errors))
    assert got[0] == ([], None)
    assert got[1] == (["invalid_extraction_confidence", "extracted_has_exclusion_reason", "invalid_relation_raw", "answer_not_grounded_in_source", "subject_matches_answer"], "validation_errors_present")
    assert got[2] == (["invalid_exclusion_reason", "not_extractable_has_answer"], "extraction_status_not_extracted")
    assert got[3] == (["invalid_extraction_status", "invalid_extraction_confidence"], "extraction_status_not_extracted")


def test_relation_rules(spark):
    rows = [("Located in", "x"), ("formed by", "x"), ("classification", "taxonomic class"), ("classification", "place"), ("is", "x"), ("colour", "x"), ("sits upon the", "x"), ("converts light into", "x")]
    got = values(spark, rows, "r string, t string", relations.classified(F.col("r"), F.col("t")))
    assert [tuple(x[0]) for x in got] == [
        ("mapped", "entity_location", 0.95), ("mapped", "effect_cause", 0.96), ("mapped", "entity_classification", 0.9), ("ambiguous", None, None), ("ambiguous", None, None), ("ambiguous", None, None),
        ("out_of_taxonomy", None, None), ("mapped", "entity_transformation", 0.94)]


def test_prefix_operators_against_windows(spark):
    rows = spark.range(500).selectExpr("CASE WHEN id % 7 = 0 THEN NULL WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS g", "id", "(id * 37) % 101 AS v", "id AS clash")
    from pyspark.sql import Window

    w = Window.partitionBy("g").orderBy("v", "id")
    due = rows.withColumn("n", F.row_number().over(w).cast("bigint")).withColumn("s", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    order = [F.asc("v"), F.asc("id")]
    assert prefix.row_number(rows, ["g"], order, "n").select("id", "n").exceptAll(due.select("id", "n")).isEmpty()
    assert prefix.running_sum(rows, ["g"], order, F.col("v"), "s").select("id", "s").exceptAll(due.select("id", "s")).isEmpty()
    assert [r.n for r in prefix.row_number(rows, [], [F.asc("id")], "n").orderBy("id").limit(3).collect()] == [1, 2, 3]
    got = {r.g: (r.p, r.q) for r in prefix.percentiles(rows, ["g"], "v", {"p": 0.3, "q": 1.0}).collect()}
    assert got == {r.g: (pytest.approx(r.p), r.q) for r in rows.groupBy("g").agg(F.percentile("v", 0.3).alias("p"), F.percentile("v", 1.0).alias("q")).collect()}
    assert prefix.row_number(rows.where("false"), ["g"], order, "n").count() == 0 and prefix.percentiles(rows.where("false"), ["g"], "v", {"p": 0.5}).count() == 0


def test_canonical_decisions(spark):
    schema = "id string, p_ok boolean, s_ok boolean, p_subject string, s_subject string, p_relation string, s_relation string, p_answer string, s_answer string, p_fact string, s_fact string, p_confidence double, s_confidence double, review string"
    def row(i, p, s, a, b, review=None):
        return (i, p, s, "X", "x ", "r", "q", a, b, "f", "f", 0.9, 0.7, review)

    rows = [row("neither", False, False, "Paris", "Paris", "accept"), row("agree", True, True, "Paris", "the Paris"), row("wait", True, True, "Paris", "Lyon"), row("cjk", True, True, "巴黎", "巴黎"),
            row("one", True, False, "Paris", "Paris", "accept"), row("other", False, True, "Lyon", "Paris", "accept"), row("no", False, True, "Paris", "Paris", "reject")]
    got = {r.id: tuple(r)[1:] for r in canonical.decided(spark.createDataFrame(rows, schema), "id").collect()}
    assert got == {
        "neither": ("exclude", "both_models_not_extracted_or_invalid", None, None, None),
        "agree": ("keep", "dual_model_extraction_and_answer_consensus", "preferred", ["relation"], 0.7),
        "wait": ("pending_review", "dual_model_answer_conflict_requires_review", None, None, None),
        "cjk": ("pending_review", "dual_model_answer_conflict_requires_review", None, None, None),
        "one": ("keep", "accepted_single_model_extraction", "preferred", ["relation"], 0.9),
        "other": ("keep", "accepted_single_model_extraction", "secondary", ["relation", "answer"], 0.7),
        "no": ("exclude", "rejected_single_model_extraction", None, None, None),
    }


def test_run_violations_find_what_was_planted(spark):
    make = spark.createDataFrame
    source = make([("a", ["P", "L"]), ("b", ["M", "N"]), ("c", None)], "source_id string, choices array<string>")
    held = make([("a", ["P", "L"]), ("b", ["M", "N"])], "source_id string, choices array<string>")
    normalised = make([("a", "mapped", "r"), ("b", "ambiguous", None)], "source_id string, status string, relation string")
    prompts = make([("a", "generated", "P is", "P", None), ("b", "rejected", None, None, "too long")], "source_id string, status string, prompt string, expected string, rejection string")
    shape = "source_id string, choices array<string>, source_answer string, answer string, wrong_options array<string>, candidates array<string>"
    distractors = make([("a", ["P", "L"], "P", "p", ["L"], ["L"])], shape)
    assert canonical.run_violations(source, held, normalised, prompts, distractors).count() == 0
    bad = [
        make([("a", ["L", "P"]), ("b", ["M", "N"]), ("b", ["M", "N"]), ("x", None)], held.schema), make([("a", "mapped", " "), ("z", "out", None)], normalised.schema),
        make([("a", "generated", "", "P", None), ("b", "rejected", None, None, None), ("x", "rejected", None, None, "r")], prompts.schema), make([("b", ["M", "N"], "M", "M", ["M"], ["m", "Q"])], shape)]
    got = sorted(map(tuple, canonical.run_violations(source, *bad).collect()))
    assert got == sorted([
        ("duplicate_canonical", "b"), ("canonical_without_source", "x"), ("source_choices_changed", "a"), ("normalised_ids_differ", "b"), ("normalised_ids_differ", "x"), ("normalised_ids_differ", "z"), ("status_relation_mismatch", "a"),
        ("generated_prompt_incomplete", "a"), ("rejected_prompt_without_reason", "b"), ("distractor_ids_differ", "a"), ("distractor_ids_differ", "b"), ("wrong_options_mismatch", "b"),
        ("distractor_absent_from_choices", "b"), ("answer_leaked_into_distractors", "b")])


def test_seeded_sample_is_the_library_shuffle(spark):
    import hashlib
    import random

    rows = spark.createDataFrame([(s, f"{s}{i}") for s in "xy" for i in range(9)] + [(None, "n")], "s string, k string")
    got = sorted((r.s, r["rank"], r.k) for r in ranking.seeded_sample(rows, "s", "k", 3, 5).collect())
    due = []
    for s in "xy":
        keys = sorted(f"{s}{i}" for i in range(9))
        random.Random(int(hashlib.sha256(f"5:{s}".encode()).hexdigest(), 16)).shuffle(keys)
        due += [(s, n + 1, k) for n, k in enumerate(keys[:3])]
    assert got == due
