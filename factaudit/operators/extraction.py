"""Rules of the extraction pipeline: suitability, grounding and repair of answers, prompts, review routing.

All are column expressions over one row; only the near-match ratio of a repair runs in Python, and only
for rows that get that far.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factaudit.functions import text as T
from factaudit.operators.validation import Rules, first_reason, reasons

# A word, edge punctuation, words that ground nothing, and the reasons for leaving a record out.
WORD = r"[\p{L}\p{N}_'-]+"
EDGES = " .,:;!?\"'()[]"
STOPWORDS = "a an the is are was were to of for".split()
EXCLUSION_REASONS = (
    "not_factual option_dependent negative_question multi_step_reasoning calculation causal_reasoning contextual_inference scenario_classification clue_solving "
    "typical_action_or_location subjective_or_normative ambiguous_subject ambiguous_relation non_unique_answer time_sensitive malformed_question long_context_comprehension "
    "answer_not_suitable other"
).split()
TRIPLE_FIELDS = "subject subject_type relation_raw answer answer_type canonical_fact".split()
NEAR_MATCH = 0.85
# What makes the question behind a fallback prompt risky.
RISKS = [
    ("mcq_fallback_explicit_choice_reference", r"(?i)\b(?:which|one) of the following\b|\bfollowing (?:terms|statements|describes|is|person)\b|\bbest described as\b|\bchoose\b"),
    ("mcq_fallback_blank", r"(?i)_{2,}|\bblank\b"),
    ("mcq_fallback_negative_or_exception", r"(?i)\b(?:not|except|incorrect|false)\b|\bleast likely\b"),
    ("mcq_fallback_incomplete", r"(?i):\s*$|\b(?:is|are|was|were|refers to|includes|called|has|contain|means)\s*$"),
]
STRUCTURE_RISK = "mcq_fallback_structure_risk"
STRICT, FALLBACK = "strict_factual_completion", "open_answer_fallback"


def answer_unsuitable(answer: Column) -> Column:
    """Sentence-like or overlong answers."""
    said, n = F.trim(answer), F.regexp_count(answer, F.lit(WORD))
    return (
        (n > 12) | ((n > 5) & said.rlike(r"[.!?][\"')\]]?$")) | ((n > 8) & said.rlike("[:;]"))
        | ((n > 5) & said.rlike(r"(?i)^(?:it|they|he|she|you|we|there)\b"))
    )


def _grounding_tokens(text: Column) -> Column:
    return F.array_except(F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0)), F.array(*[F.lit(w) for w in STOPWORDS]))


def grounded(answer: Column, source: Column) -> Column:
    """Whether the source answer states the answer: as a part, without its article, or by all its content words."""
    a, s = (F.trim(T.normalize_text(x), F.lit(EDGES)) for x in (answer, source))
    bare = F.regexp_replace(a, r"^(a|an|the)\s+", "")
    mine = _grounding_tokens(a)
    inside = F.contains(s, a) | ((bare != "") & F.contains(s, bare)) | ((F.size(mine) > 0) & (F.size(F.array_except(mine, _grounding_tokens(s))) == 0))
    return (a != "") & inside


def repaired(status: Column, answer: Column, source: Column) -> Column:
    """Struct (status, answer, change): an extracted answer that its source does not ground is replaced by
    a near-equal suitable source answer, or the row is no longer extracted where the source answer is
    unsuitable; every other row stays as it is, with a null change.
    """
    asked = (status == "extracted") & answer.isNotNull() & ~grounded(answer, source)
    unsuitable = F.coalesce(answer_unsuitable(source), F.lit(False))
    close = F.when(asked & ~unsuitable, answer)
    ratio = T.sequence_ratio(T.normalize_text(close), T.normalize_text(F.when(close.isNotNull(), F.coalesce(source, F.lit("")))))
    near = F.coalesce(close.isNotNull() & (ratio >= NEAR_MATCH), F.lit(False))
    asked = F.coalesce(asked, F.lit(False))
    return (
        F.when(near, F.struct(status.alias("status"), source.alias("answer"), F.lit("answer_near_match_replaced_with_source_answer").alias("change")))
        .when(asked & unsuitable, F.struct(F.lit("not_extractable").alias("status"), F.lit(None).cast("string").alias("answer"), F.lit("ungrounded_sentence_answer_downgraded_to_not_extractable").alias("change")))
        .otherwise(F.struct(status.alias("status"), answer.alias("answer"), F.lit(None).cast("string").alias("change")))
    )


def fact_completion(fact: Column, answer: Column) -> Column:
    """The fact without its closing answer and the marks before it; null where it does not end with the
    answer as words, or nothing is left."""
    base = F.regexp_replace(F.trim(fact), r"[\s.!?]+$", "")
    said = F.trim(answer)
    head = F.substring(base, F.lit(1), F.length(base) - F.length(said))
    starts_word, after_word = said.rlike(r"^[\p{L}\p{N}_]"), head.rlike(r"[\p{L}\p{N}_]$")
    ends = F.endswith(F.lower(base), F.lower(said)) & (F.length(said) > 0) & (starts_word != after_word)
    return F.when(ends, F.nullif(F.rtrim(head, F.lit(" :,-")), F.lit("")))


def prompt(fact: Column, answer: Column, question: Column) -> Column:
    """Struct (prompt, tier): the completion, else the question as an open one."""
    strict = fact_completion(fact, answer)
    return F.when(strict.isNotNull(), F.struct(strict.alias("prompt"), F.lit(STRICT).alias("tier"))).otherwise(
        F.struct(F.concat(F.lit("Factual question: "), F.trim(question), F.lit("\nAnswer:")).alias("prompt"), F.lit(FALLBACK).alias("tier")))


def source_format(stated: Column, choices: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(stated), F.lit("")), F.when(F.size(F.coalesce(choices, F.array().cast("array<string>"))) > 0, "multiple_choice").otherwise("open_qa"))


def risk_flags(form: Column, tier: Column, question: Column) -> Column:
    """Review hints for fallback prompts of multiple-choice records; empty for all others."""
    details = F.array_compact(F.array(*[F.when(F.trim(question).rlike(pattern), name) for name, pattern in RISKS]))
    risky = (form == "multiple_choice") & (tier == FALLBACK) & (F.size(details) > 0)
    return F.when(risky, F.concat(F.array(F.lit(STRUCTURE_RISK)), details)).otherwise(F.array().cast("array<string>"))


def review_reasons(members: Column, tier: Column, relation: Column, answer: Column, subject: Column, candidate: Column, direction: Column, flags: Column) -> Column:
    """Why a cluster's representative needs review, in a fixed order."""
    said, about = T.normalize_text(answer), T.normalize_text(subject)
    within = F.regexp_like(about, F.concat(F.lit(r"(^|[^\p{L}\p{N}_])"), T.literal_pattern(said), F.lit(r"($|[^\p{L}\p{N}_])")))
    rules: Rules = [
        ("single_model_extraction_requires_independent_semantic_review", F.lit(True)),
        ("duplicate_source_records_clustered", members > 1),
        ("canonical_fact_not_answer_suffix", tier == FALLBACK),
        ("relation_phrase_long", F.regexp_count(relation, F.lit(r"\S+")) > 4),
        ("answer_phrase_long", F.regexp_count(answer, F.lit(WORD)) > 12),
        ("answer_phrase_occurs_in_subject", (F.length(said) >= 4) & within),
        ("probe_relation_candidate_requires_semantic_and_balance_review", candidate.isNotNull()),
        ("probe_relation_candidate_direction_unresolved", direction == "unresolved"),
        ("mcq_fallback_structure_risk_requires_review", F.size(flags) > 0),
    ]
    return reasons(rules)


def filter_reason(terminal: Column, status: Column, errors: Column) -> Column:
    """Why a reply is not eligible, or null; ``errors`` is the array of its validation errors."""
    return first_reason([
        ("terminal_status_not_completed", ~F.coalesce(terminal == "completed", F.lit(False))), ("extraction_status_not_extracted", ~F.coalesce(status == "extracted", F.lit(False))),
        ("validation_errors_not_a_list", errors.isNull()), ("validation_errors_present", F.size(errors) > 0)])


def reply_errors(status: Column, confidence: Column, reason: Column, fields: dict[str, Column], source: Column) -> Column:
    """The error codes of an extraction reply, in order; ``fields`` are the TRIPLE_FIELDS."""
    extracted, not_extractable = status == "extracted", status == "not_extractable"
    rules: Rules = [
        ("invalid_extraction_status", ~F.coalesce(status.isin("extracted", "not_extractable"), F.lit(False))),
        ("invalid_extraction_confidence", ~F.coalesce(confidence.between(0, 1), F.lit(False))),
        ("extracted_has_exclusion_reason", extracted & reason.isNotNull()),
        *[(f"invalid_{name}", extracted & (F.coalesce(F.trim(fields[name]), F.lit("")) == "")) for name in TRIPLE_FIELDS],
        ("answer_not_grounded_in_source", extracted & fields["answer"].isNotNull() & ~F.coalesce(grounded(fields["answer"], F.coalesce(source, F.lit(""))), F.lit(False))),
        ("subject_matches_answer", extracted & fields["subject"].isNotNull() & fields["answer"].isNotNull() & (T.normalize_text(fields["subject"]) == T.normalize_text(fields["answer"]))),
        ("invalid_exclusion_reason", not_extractable & ~F.coalesce(reason.isin(*EXCLUSION_REASONS), F.lit(False))),
        *[(f"not_extractable_has_{name}", not_extractable & fields[name].isNotNull()) for name in TRIPLE_FIELDS],
    ]
    return reasons(rules)
