"""The extraction pipeline's rules over replies built from the project's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factaudit.functions import text
from factaudit.operators import extraction as E
from factaudit.queries.registry import Registry, folded_sql
from factaudit.session import table

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql


def replies(spark, d):
    """Extraction replies: decided candidates beside the source record (its first line) they were read from."""
    r = "source_snapshot.record."
    source = table(spark, d, "raw_candidates").groupBy(F.col("candidate_id").alias("record_id")).agg(F.min_by(F.struct(
        F.col(r + "question").alias("question"), F.col(r + "choices").alias("choices"), F.col(r + "answer").alias("source_answer"), F.col(r + "subject").alias("subject_type"),
        F.col(r + "source_format").alias("stated_format")), "line_number").alias("s"))
    n = table(spark, d, "normalized_candidates")
    status = F.when(F.col("decision") == "ready", "extracted").when(F.col("decision") == "reject", "not_extractable").otherwise(F.col("decision"))
    return n.join(source, "record_id", "left").select(
        "line_number", "record_id", F.when(F.col("decision") == "defer", "failed").otherwise("completed").alias("terminal_status"), status.alias("status"),
        F.when(F.col("decision") != "ready", F.col("reason")).alias("exclusion_reason"), (F.lit(1.0) / F.col("attempt_number")).alias("confidence"), "subject", "s.subject_type",
        F.col("relation_id").alias("relation_raw"), "answer", F.col("direction").alias("answer_type"), "canonical_fact", "s.question", "s.choices", "s.source_answer", "s.stated_format")


_REPLIES = """(SELECT n.line_number, n.record_id, CASE WHEN decision = 'defer' THEN 'failed' ELSE 'completed' END AS terminal_status, CASE decision WHEN 'ready' THEN 'extracted' WHEN 'reject' THEN 'not_extractable' ELSE decision END AS status,
  CASE WHEN decision <> 'ready' THEN reason END AS exclusion_reason, 1.0::DOUBLE / attempt_number AS confidence, n.subject, s.r.record.subject AS subject_type, relation_id AS relation_raw, n.answer, direction AS answer_type, canonical_fact,
  s.r.record.question AS question, s.r.record.choices AS choices, s.r.record.answer AS source_answer, s.r.record.source_format AS stated_format
  FROM normalized_candidates n LEFT JOIN (SELECT candidate_id, arg_min(source_snapshot, line_number) AS r FROM raw_candidates GROUP BY 1) s ON n.record_id = s.candidate_id)"""


def _norm(c: str) -> str:
    return rf"coalesce(trim(regexp_replace({folded_sql(c)}, '\s+', ' ', 'g')), '')"


_EDGES = """' .,:;!?"''()[]'"""
_WORDS = r"[\p{L}\p{N}_''-]+"


def _count(c: str) -> str:
    return f"len(regexp_extract_all({c}, '{_WORDS}'))"


def _unsuitable_sql(c: str) -> str:
    ends = r"""regexp_matches(trim(%s), '[.!?]["'')\]]?$')""" % c
    speaks = rf"regexp_matches(trim({c}), '(?i)^(?:it|they|he|she|you|we|there)\b')"
    return f"(({_count(c)} > 12) OR ({_count(c)} > 5 AND {ends}) OR ({_count(c)} > 8 AND regexp_matches(trim({c}), '[:;]')) OR ({_count(c)} > 5 AND {speaks}))"


def _grounded_sql(a: str, s: str) -> str:
    """Grounding over the columns ``a`` and ``s``, already normalised and without edge punctuation."""
    stop = "['a','an','the','is','are','was','were','to','of','for']"
    mine = f"list_filter(regexp_extract_all({a}, '[a-z0-9]+'), lambda x: NOT list_contains({stop}, x))"
    bare = rf"regexp_replace({a}, '^(a|an|the)\s+', '')"
    return f"({a} <> '' AND (contains({s}, {a}) OR ({bare} <> '' AND contains({s}, {bare})) OR (len({mine}) > 0 AND len(list_filter({mine}, lambda x: NOT list_contains(regexp_extract_all({s}, '[a-z0-9]+'), x))) = 0)))"


_GROUNDING = f"(SELECT *, trim({_norm('answer')}, {_EDGES}) AS a, trim({_norm('source_answer')}, {_EDGES}) AS s FROM {_REPLIES})"

_COMPLETION = r"""(SELECT *, CASE WHEN length(said) > 0 AND ends_with(lower(base), lower(said)) AND regexp_matches(said, '^[\p{L}\p{N}_]') <> regexp_matches(substr(base, 1, length(base) - length(said)), '[\p{L}\p{N}_]$')
  THEN nullif(rtrim(substr(base, 1, length(base) - length(said)), ' :,-'), '') END AS strict FROM (SELECT *, regexp_replace(trim(canonical_fact), '[\s.!?]+$', '') AS base, trim(answer) AS said FROM """ + _REPLIES + "))"
_FORM = "coalesce(nullif(trim(stated_format), ''), CASE WHEN len(coalesce(choices, [])) > 0 THEN 'multiple_choice' ELSE 'open_qa' END)"
_DETAILS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(trim(question), '{pattern}') THEN '{name}' END" for name, pattern in E.RISKS) + "], lambda x: x IS NOT NULL)"
_FLAGS = f"CASE WHEN {_FORM} = 'multiple_choice' AND strict IS NULL AND len({_DETAILS}) > 0 THEN list_concat(['{E.STRUCTURE_RISK}'], {_DETAILS}) ELSE [] END"


@R.add("b15_answer_suffix_prompt", f"SELECT line_number, strict AS prompt, CASE WHEN strict IS NULL THEN 'Factual question: ' || trim(question) || chr(10) || 'Answer:' ELSE strict END AS used, CASE WHEN strict IS NULL THEN '{E.FALLBACK}' ELSE '{E.STRICT}' END AS tier FROM {_COMPLETION}")
def _(spark, d):
    fact, answer = F.col("canonical_fact"), F.col("answer")
    made = E.prompt(fact, answer, F.col("question"))
    return replies(spark, d).select("line_number", E.fact_completion(fact, answer).alias("prompt"), made["prompt"].alias("used"), made["tier"].alias("tier"))


@R.add("b16_prompt_risk_flags", f"SELECT line_number, array_to_string({_FLAGS}, '|') AS flags FROM {_COMPLETION}")
def _(spark, d):
    form = E.source_format(F.col("stated_format"), F.col("choices"))
    flags = E.risk_flags(form, E.prompt(F.col("canonical_fact"), F.col("answer"), F.col("question"))["tier"], F.col("question"))
    return replies(spark, d).select("line_number", F.array_join(flags, "|").alias("flags"))


def _clusters(spark, d):
    """Extracted replies with the number of rows that state the same fact and the catalog's entry."""
    rows = replies(spark, d).where("status = 'extracted'").withColumn("fact_key", F.xxhash64(*[text.normalize_text(F.col(c)) for c in ("subject", "relation_raw", "answer")]))
    sizes = rows.groupBy("fact_key").agg(F.count(F.lit(1)).alias("members"))
    catalog = table(spark, d, "relation_catalog").select(F.col("relation_id").alias("relation_raw"), F.col("relation_id").alias("candidate"), F.col("direction").alias("candidate_direction"))
    return rows.join(sizes, "fact_key").join(catalog, "relation_raw", "left")


@R.add("b17_review_reasons", rf"""
    WITH k AS (SELECT *, {_norm('subject')} AS ns, {_norm('relation_raw')} AS nr, {_norm('answer')} AS na FROM {_COMPLETION} WHERE status = 'extracted'),
    m AS (SELECT k.*, count(*) OVER (PARTITION BY ns, nr, na) AS members, c.relation_id AS candidate, c.direction AS candidate_direction FROM k LEFT JOIN relation_catalog c ON k.relation_raw = c.relation_id)
    SELECT line_number, array_to_string(list_filter(['single_model_extraction_requires_independent_semantic_review', CASE WHEN members > 1 THEN 'duplicate_source_records_clustered' END, CASE WHEN strict IS NULL THEN 'canonical_fact_not_answer_suffix' END,
      CASE WHEN len(regexp_extract_all(relation_raw, '\S+')) > 4 THEN 'relation_phrase_long' END, CASE WHEN {_count('answer')} > 12 THEN 'answer_phrase_long' END,
      CASE WHEN length(na) >= 4 AND regexp_matches(ns, '(^|[^\p{{L}}\p{{N}}_])' || regexp_escape(na) || '($|[^\p{{L}}\p{{N}}_])') THEN 'answer_phrase_occurs_in_subject' END, CASE WHEN candidate IS NOT NULL THEN 'probe_relation_candidate_requires_semantic_and_balance_review' END,
      CASE WHEN candidate_direction = 'unresolved' THEN 'probe_relation_candidate_direction_unresolved' END, CASE WHEN len({_FLAGS}) > 0 THEN 'mcq_fallback_structure_risk_requires_review' END], lambda x: x IS NOT NULL), '|') AS reasons FROM m""")
def _(spark, d):
    tier = E.prompt(F.col("canonical_fact"), F.col("answer"), F.col("question"))["tier"]
    flags = E.risk_flags(E.source_format(F.col("stated_format"), F.col("choices")), tier, F.col("question"))
    why = E.review_reasons(F.col("members"), tier, F.col("relation_raw"), F.col("answer"), F.col("subject"), F.col("candidate"), F.col("candidate_direction"), flags)
    return _clusters(spark, d).select("line_number", F.array_join(why, "|").alias("reasons"))


@R.add("b18_answer_unsuitable", f"SELECT line_number, {_unsuitable_sql('source_answer')} AS unsuitable FROM {_REPLIES} WHERE source_answer IS NOT NULL")
def _(spark, d):
    return replies(spark, d).where("source_answer IS NOT NULL").select("line_number", E.answer_unsuitable(F.col("source_answer")).alias("unsuitable"))


@R.add("b19_answer_grounded", f"SELECT line_number, {_grounded_sql('a', 's')} AS grounded FROM {_GROUNDING} WHERE answer IS NOT NULL AND source_answer IS NOT NULL")
def _(spark, d):
    rows = replies(spark, d).where("answer IS NOT NULL AND source_answer IS NOT NULL")
    return rows.select("line_number", E.grounded(F.col("answer"), F.col("source_answer")).alias("grounded"))


@R.add("b20_grounding_repair")
def _(spark, d):
    """Not SQL: the near-match ratio is the standard library's; its tests hold the expected rows."""
    fixed = E.repaired(F.col("status"), F.col("answer"), F.col("source_answer"))
    return replies(spark, d).withColumn("fixed", fixed).select("line_number", "fixed.*")


def _errors(rows):
    return E.reply_errors(F.col("status"), F.col("confidence"), F.col("exclusion_reason"), {c: F.col(c) for c in E.TRIPLE_FIELDS}, F.col("source_answer"))


_ERRORS = "list_filter([" + ", ".join([
    "CASE WHEN status IS NULL OR status NOT IN ('extracted', 'not_extractable') THEN 'invalid_extraction_status' END", "CASE WHEN NOT coalesce(confidence BETWEEN 0 AND 1, false) THEN 'invalid_extraction_confidence' END",
    "CASE WHEN status = 'extracted' AND exclusion_reason IS NOT NULL THEN 'extracted_has_exclusion_reason' END",
    *[f"CASE WHEN status = 'extracted' AND coalesce(trim({c}), '') = '' THEN 'invalid_{c}' END" for c in E.TRIPLE_FIELDS],
    f"CASE WHEN status = 'extracted' AND answer IS NOT NULL AND NOT coalesce({_grounded_sql('a', 's')}, false) THEN 'answer_not_grounded_in_source' END",
    f"CASE WHEN status = 'extracted' AND subject IS NOT NULL AND answer IS NOT NULL AND {_norm('subject')} = {_norm('answer')} THEN 'subject_matches_answer' END",
    "CASE WHEN status = 'not_extractable' AND (exclusion_reason IS NULL OR exclusion_reason NOT IN (" + ", ".join(f"'{r}'" for r in E.EXCLUSION_REASONS) + ")) THEN 'invalid_exclusion_reason' END",
    *[f"CASE WHEN status = 'not_extractable' AND {c} IS NOT NULL THEN 'not_extractable_has_{c}' END" for c in E.TRIPLE_FIELDS]]) + "], lambda x: x IS NOT NULL)"


@R.add("b22_row_validators", f"SELECT line_number, array_to_string({_ERRORS}, '|') AS errors FROM {_GROUNDING}")
def _(spark, d):
    rows = replies(spark, d)
    return rows.select("line_number", F.array_join(_errors(rows), "|").alias("errors"))


@R.add("b23_filter_reason", f"""
    SELECT line_number, CASE WHEN terminal_status <> 'completed' THEN 'terminal_status_not_completed' WHEN status <> 'extracted' THEN 'extraction_status_not_extracted' WHEN len({_ERRORS}) > 0 THEN 'validation_errors_present' END AS reason FROM {_GROUNDING}""")
def _(spark, d):
    rows = replies(spark, d)
    return rows.select("line_number", E.filter_reason(F.col("terminal_status"), F.col("status"), _errors(rows)).alias("reason"))
