"""Filters, selection, sources and joins, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factaudit.functions import text
from factaudit.operators import evaluation, joins, relations, validation
from factaudit.queries.registry import Registry
from factaudit.session import table

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql


def _raw(spark, d):
    """Raw candidates with the fields of their snapshot as columns."""
    s, r = "source_snapshot.", "source_snapshot.record."
    return table(spark, d, "raw_candidates").select(
        "line_number", "candidate_id", "stratum", F.col(s + "dataset").alias("dataset"), F.col(s + "original_index").alias("original_index"), F.col(s + "relation_raw").alias("relation_raw"),
        F.col(r + "question").alias("question"), F.col(r + "choices").alias("choices"), F.col(r + "answer").alias("answer"), F.col(r + "subject").alias("subject"), F.col(r + "source_format").alias("source_format"), "received_at")


_RAW = """(SELECT line_number, candidate_id, stratum, source_snapshot.dataset AS dataset, source_snapshot.original_index AS original_index, source_snapshot.relation_raw AS relation_raw, source_snapshot.record.question AS question,
  source_snapshot.record.choices AS choices, source_snapshot.record.answer AS answer, source_snapshot.record.subject AS subject, source_snapshot.record.source_format AS source_format, received_at FROM raw_candidates)"""


_A08 = f"""(SELECT dataset, line_number, question, answer, CASE WHEN dataset IN ('mmlu_like', 'openbook_like') THEN choices END AS choices, CASE WHEN dataset IN ('mmlu_like', 'openbook_like') THEN 'multiple_choice' ELSE 'open_qa' END AS form, source_format, subject FROM {_RAW} WHERE dataset IN ('mmlu_like', 'openbook_like', 'mkqa_like', 'msqa_like'))"""


@R.add("a08_source_normalisers", rf"""
    WITH c AS (SELECT *, nullif(trim(regexp_replace(question, '\s+', ' ', 'g')), '') AS q, nullif(trim(regexp_replace(answer, '\s+', ' ', 'g')), '') AS a0, CASE WHEN dataset = 'mmlu_like' THEN [choices[1], choices[2], choices[3], choices[4]] ELSE choices END AS ch FROM {_A08}),
    d AS (SELECT *, CASE WHEN dataset IN ('mmlu_like', 'openbook_like') AND NOT coalesce(list_contains(ch, answer), false) THEN NULL ELSE a0 END AS a, list_transform(coalesce(ch, []), lambda x: nullif(trim(regexp_replace(x, '\s+', ' ', 'g')), '')) AS cc FROM c)
    SELECT dataset AS source, line_number::VARCHAR AS upstream_id, q AS question, a AS answer, CASE WHEN dataset = 'openbook_like' THEN 'openbook_test' ELSE subject END AS subject,
      CASE WHEN dataset = 'mkqa_like' AND NOT coalesce(subject IN ('town', 'river', 'species', 'mineral'), false) THEN 'answer_type:' || coalesce(subject, 'missing') WHEN dataset = 'msqa_like' AND NOT coalesce(source_format = 'open_qa', false) THEN 'non_target_language' WHEN q IS NULL THEN 'missing_or_empty_question' WHEN a IS NULL THEN 'missing_or_empty_answer'
        WHEN len(list_filter(cc, lambda x: x IS NULL)) > 0 THEN 'invalid_choice' WHEN form = 'multiple_choice' AND len(cc) = 0 THEN 'missing_or_empty_choices' WHEN form = 'multiple_choice' AND NOT list_contains(cc, a) THEN 'answer_not_in_choices' END AS excluded FROM d""")
def _(spark, d):
    """The rows of four datasets in the shapes their sources have, each through its own normaliser."""
    from factaudit.sources import readers

    raw = _raw(spark, d)
    of = lambda name: raw.where(F.col("dataset") == name)
    letters = F.array(*[F.lit(x) for x in "ABCD"])
    four = F.slice("choices", 1, 4)
    lettered = of("mmlu_like").select("question", *[F.get("choices", i).alias(f"option_{x}") for i, x in enumerate("abcd")], F.get(letters, F.array_position(four, F.col("answer")).cast("int") - 1).alias("answer"), "subject", F.col("line_number").alias("sample_id"))
    typed = of("mkqa_like").select(F.struct(F.col("question").alias("en")).alias("queries"), F.struct(F.array(F.struct(F.col("subject").alias("type"), F.col("answer").alias("text"))).alias("en")).alias("answers"), F.col("line_number").alias("example_id"))
    spoken = of("msqa_like").select("question", "answer", F.when(F.col("source_format") == "open_qa", "en").alias("language"), F.col("subject").alias("category"), F.col("line_number").alias("id"))
    labelled = F.transform("choices", lambda c, i: F.struct(i.cast("string").alias("label"), c.alias("text")))
    stems = of("openbook_like").select(F.struct(F.col("question").alias("stem"), labelled.alias("choices")).alias("question"), (F.array_position("choices", F.col("answer")) - 1).cast("string").alias("answerKey"), F.col("line_number").alias("id"))
    parts = {"mmlu_like": readers.normalise_lettered(lettered), "mkqa_like": readers.normalise_typed_answers(typed, ["town", "river", "species", "mineral"]),
             "msqa_like": readers.normalise_by_language(spoken, "en"), "openbook_like": readers.normalise_stems(stems, "openbook_test")}
    out = None
    for name, part in parts.items():
        part = part.select(F.lit(name).alias("source"), "upstream_id", "question", "answer", "subject", "excluded")
        out = part if out is None else out.unionByName(part)
    return out



@R.add("a09_row_fingerprint", "SELECT line_number, sha256(audit_record_id || '␟' || coalesce(question, '') || '␟' || coalesce(answer, '') || '␟' || coalesce(split_assignment, '')) AS fingerprint FROM audit_records")
def _(spark, d):
    from factaudit.sources.artifacts import row_fingerprint

    return table(spark, d, "audit_records").select("line_number", row_fingerprint("audit_record_id", "question", "answer", "split_assignment").alias("fingerprint"))


@R.add("a10_artifact_manifest", """
    SELECT source_dataset, count(*) AS record_count, sum(('0x' || substr(sha256(audit_record_id), 1, 12))::BIGINT)::VARCHAR AS id_digest FROM audit_records GROUP BY source_dataset""")
def _(spark, d):
    from factaudit.sources.artifacts import manifest

    return manifest(table(spark, d, "audit_records"), ["source_dataset"], "audit_record_id")


@R.add("a11_version_gate", "SELECT record_role, count(DISTINCT input_path) AS versions, count(DISTINCT input_path) = 1 AS single FROM audit_records GROUP BY record_role")
def _(spark, d):
    out = table(spark, d, "audit_records").groupBy("record_role").agg(F.count_distinct("input_path").alias("versions"))
    return out.withColumn("single", F.col("versions") == 1)


@R.add("a12_progress_split_merge", """
    SELECT source_id, count(*) AS results, string_agg(DISTINCT model_name, ',' ORDER BY model_name) AS models FROM model_annotations WHERE model_name IN ('orrin-3', 'pelt-9') AND canonical_decision IS NOT NULL GROUP BY source_id""")
def _(spark, d):
    from factaudit.operators.ledger import merge_progress

    rows = table(spark, d, "model_annotations").where("model_name IN ('orrin-3', 'pelt-9') AND canonical_decision IS NOT NULL")
    return merge_progress(rows, "source_id", "model_name")


@R.add("a13_resume_pending", """
    WITH latest AS (SELECT source_id, arg_max(coalesce(canonical_decision, ''), (created_at, annotation_id)) AS last FROM model_annotations GROUP BY source_id), due AS (SELECT DISTINCT candidate_id AS source_id FROM raw_candidates)
    SELECT source_id, CASE WHEN last IS NULL THEN 'never_run' ELSE 'retry' END AS pending FROM due LEFT JOIN latest USING (source_id) WHERE last IS NULL OR last = ''""")
def _(spark, d):
    from factaudit.operators.ledger import pending

    runs = table(spark, d, "model_annotations").select("source_id", F.coalesce("canonical_decision", F.lit("")).alias("outcome"), "created_at", "annotation_id")
    due = table(spark, d, "raw_candidates").select(F.col("candidate_id").alias("source_id")).distinct()
    return pending(due, runs, "source_id", "outcome", ["created_at", "annotation_id"], failed=[""])


@R.add("a14_retry_history", """
    SELECT record_id, string_agg(attempt_number::VARCHAR, ',' ORDER BY attempt_number, line_number) AS attempts, sum(attempt_number)::BIGINT AS attempt_count, count(*) - 1 AS resumed FROM normalized_candidates GROUP BY record_id""")
def _(spark, d):
    from factaudit.operators.ledger import retry_history

    return retry_history(table(spark, d, "normalized_candidates"), "record_id", "attempt_number", "line_number")


@R.add("c01_weakness_filter", "WITH m AS (SELECT source_id, avg(CASE WHEN canonical_decision IS NULL THEN NULL WHEN lower(trim(canonical_decision)) = 'keep' THEN 1.0 ELSE 0.0 END) AS rate FROM model_annotations GROUP BY source_id) SELECT source_id, round(rate, 6) AS rate FROM m WHERE rate <= 0.2")
def _(spark, d):
    kept = F.when(F.col("canonical_decision").isNotNull(), (F.lower(F.trim("canonical_decision")) == "keep").cast("double"))
    return table(spark, d, "model_annotations").groupBy("source_id").agg(F.avg(kept).alias("rate")).where("rate <= 0.2").select("source_id", F.round("rate", 6).alias("rate"))


@R.add("c02_good_question_filter", """
    WITH r AS (SELECT source_id, split_part(source_id, '_', 2) AS origin, round(avg(CASE WHEN model_name < 'n' THEN (lower(trim(canonical_decision)) = 'keep')::INT END), 6) AS ori, round(avg(CASE WHEN model_name >= 'n' THEN (lower(trim(canonical_decision)) = 'keep')::INT END), 6) AS trans FROM model_annotations WHERE canonical_decision IS NOT NULL GROUP BY 1),
    g AS (SELECT * FROM r WHERE ori = 1 AND trans IS NOT NULL), n AS (SELECT origin, count(*) FILTER (trans <= 0.2) AS weak FROM g GROUP BY 1)
    SELECT source_id, g.origin, trans AS rate_trans, trans <= 0.4 AS good, trans > 0 AND weak < 40 AS searched_on FROM g JOIN n USING (origin)""")
def _(spark, d):
    from factaudit.plans.beam import judged

    correct = (F.lower(F.trim("canonical_decision")) == "keep").cast("int")
    rate = lambda test, name: F.round(F.avg(F.when(test, correct)), 6).alias(name)
    rates = table(spark, d, "model_annotations").where("canonical_decision IS NOT NULL").groupBy("source_id").agg(rate(F.col("model_name") < "n", "rate_ori"), rate(F.col("model_name") >= "n", "rate_trans"))
    rates = rates.withColumn("origin", F.split("source_id", "_")[1])
    return judged(rates, "origin", most_good=40).select("source_id", "origin", "rate_trans", "good", "searched_on")



@R.add("c03_wrong_options", f"""
    WITH o AS (SELECT line_number, answer, unnest(choices) AS option, unnest(range(len(choices))) AS position FROM {_RAW} WHERE choices IS NOT NULL)
    SELECT line_number, position::INT AS position, option FROM o WHERE lower(trim(option)) <> lower(trim(answer)) QUALIFY row_number() OVER (PARTITION BY line_number, lower(trim(option)) ORDER BY position) = 1""")
def _(spark, d):
    options = _raw(spark, d).select("line_number", "answer", F.posexplode("choices").alias("position", "option")).where("lower(trim(option)) <> lower(trim(answer))")
    first = options.groupBy("line_number", F.lower(F.trim("option")).alias("k")).agg(F.min(F.struct("position", "option")).alias("o"))
    return first.select("line_number", "o.position", "o.option")


@R.add("c04_exclude_ids", "SELECT candidate_id, CASE WHEN candidate_id IN (SELECT record_id FROM normalized_candidates WHERE decision = 'reject') THEN 'rejected_before' END AS reason FROM (SELECT DISTINCT candidate_id FROM raw_candidates)")
def _(spark, d):
    rejected = table(spark, d, "normalized_candidates").where("decision = 'reject'").select(F.col("record_id").alias("candidate_id"), F.lit("rejected_before").alias("reason")).distinct()
    return table(spark, d, "raw_candidates").select("candidate_id").distinct().join(rejected, "candidate_id", "left")


@R.add("c05_allowed_splits", "SELECT split_assignment, count(*) AS n FROM audit_records WHERE split_assignment IN ('development', 'validation') GROUP BY split_assignment")
def _(spark, d):
    return table(spark, d, "audit_records").where(F.col("split_assignment").isin("development", "validation")).groupBy("split_assignment").agg(F.count(F.lit(1)).alias("n"))


@R.add("c06_route_rows", "SELECT CASE WHEN decision = 'reject' THEN 'excluded' WHEN decision = 'defer' OR answer IS NULL THEN 'review' ELSE 'ready' END AS route, decision, count(*) AS n FROM normalized_candidates GROUP BY ALL")
def _(spark, d):
    route = F.when(F.col("decision") == "reject", "excluded").when((F.col("decision") == "defer") | F.col("answer").isNull(), "review").otherwise("ready")
    return table(spark, d, "normalized_candidates").groupBy(route.alias("route"), "decision").agg(F.count(F.lit(1)).alias("n"))


@R.add("c07_accepted_items", """
    SELECT source_id FROM model_annotations GROUP BY source_id HAVING count(*) >= 3 AND bool_and(coalesce(lower(trim(canonical_decision)) = 'keep', false)) AND source_id IN (SELECT record_id FROM normalized_candidates WHERE decision = 'ready')""")
def _(spark, d):
    kept = F.coalesce(F.lower(F.trim("canonical_decision")) == "keep", F.lit(False))
    checked = table(spark, d, "model_annotations").groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(kept).alias("ok")).where("n >= 3 AND ok")
    allowed = table(spark, d, "normalized_candidates").where("decision = 'ready'").select(F.col("record_id").alias("source_id"))
    return checked.join(allowed, "source_id", "left_semi").select("source_id")


@R.add("c08_exposure_scan", r"""
    WITH m AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, 'raw_[a-z_]+_\d+'))) AS id FROM documents)
    SELECT regexp_replace(id, '_\d+$', '') AS family, count(*) AS mentions, count(DISTINCT doc_id) AS documents FROM m GROUP BY 1""")
def _(spark, d):
    from factaudit.sources.artifacts import mentioned_ids

    found = mentioned_ids(table(spark, d, "documents"), "doc_id", "text", r"raw_[a-z_]+_\d+")
    return found.groupBy(F.regexp_replace("identifier", r"_\d+$", "").alias("family")).agg(F.count(F.lit(1)).alias("mentions"), F.count_distinct("doc_id").alias("documents"))


def _latest_votes(spark, d, model):
    rows = table(spark, d, "model_annotations").where((F.col("model_name") == model) & F.col("canonical_decision").isNotNull())
    one = evaluation.latest(rows.select("source_id", "canonical_decision", "created_at", "annotation_id"), ["source_id"], ["created_at", "annotation_id"])
    return one.select("source_id", F.regexp_replace(F.lower(F.trim(F.regexp_replace("canonical_decision", r"\s", " "))), "[ -]", "_").alias("decision"))


_VOTES = """(SELECT source_id, regexp_replace(lower(trim(regexp_replace(arg_max(canonical_decision, (created_at, annotation_id)), '\\s', ' ', 'g'))), '[ -]', '_', 'g') AS decision FROM model_annotations WHERE model_name = '{}' AND canonical_decision IS NOT NULL GROUP BY source_id)"""


@R.add("d01_two_extractor_join", f"""
    SELECT coalesce(a.source_id, b.source_id) AS source_id, CASE WHEN b.source_id IS NULL THEN 'only_left' WHEN a.source_id IS NULL THEN 'only_right' WHEN a.decision IS NOT DISTINCT FROM b.decision THEN 'consensus' ELSE 'conflict' END AS status
    FROM {_VOTES.format('orrin-3')} a FULL JOIN {_VOTES.format('yarrow-2')} b ON a.source_id = b.source_id""")
def _(spark, d):
    return joins.reconcile(_latest_votes(spark, d, "orrin-3"), _latest_votes(spark, d, "yarrow-2"), "source_id", ["decision"]).select("source_id", "status")


@R.add("d02_n_way_agreement", f"""
    WITH v AS (SELECT * FROM {_VOTES.format('orrin-3')} UNION ALL SELECT * FROM {_VOTES.format('yarrow-2')} UNION ALL SELECT * FROM {_VOTES.format('veld-xl')})
    SELECT source_id, count(*) AS voters, count(DISTINCT decision) = 1 AS agree FROM v GROUP BY source_id""")
def _(spark, d):
    votes = None
    for model in ("orrin-3", "yarrow-2", "veld-xl"):
        one = _latest_votes(spark, d, model)
        votes = one if votes is None else votes.unionByName(one)
    return votes.groupBy("source_id").agg(F.count(F.lit(1)).alias("voters"), (F.count_distinct("decision") == 1).alias("agree"))


@R.add("d03_reference_check", f"""
    WITH r AS (SELECT record_id AS source_id, min(decision) AS expected FROM normalized_candidates GROUP BY record_id), v AS {_VOTES.format('tassel-lite')}
    SELECT CASE WHEN v.source_id IS NULL THEN 'missing' WHEN r.source_id IS NULL THEN 'unexpected' WHEN (r.expected = 'ready') = (v.decision = 'keep') THEN 'match' ELSE 'disagree' END AS outcome, count(*) AS n FROM r FULL JOIN v ON r.source_id = v.source_id GROUP BY 1""")
def _(spark, d):
    reference = table(spark, d, "normalized_candidates").groupBy(F.col("record_id").alias("source_id")).agg(F.min("decision").alias("expected"))
    both = reference.join(_latest_votes(spark, d, "tassel-lite"), "source_id", "full_outer")
    outcome = F.when(F.col("decision").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").when((F.col("expected") == "ready") == (F.col("decision") == "keep"), "match").otherwise("disagree")
    return both.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@R.add("d04_override_join", """
    WITH o AS (SELECT audit_record_id, upper(answer) AS answer FROM audit_records WHERE split_assignment = 'sealed')
    SELECT a.audit_record_id, coalesce(o.answer, a.answer) AS answer FROM audit_records a LEFT JOIN o ON a.audit_record_id = o.audit_record_id""")
def _(spark, d):
    rows = table(spark, d, "audit_records").select("audit_record_id", "answer")
    changes = table(spark, d, "audit_records").where("split_assignment = 'sealed'").select("audit_record_id", F.upper("answer").alias("answer"))
    return joins.override(rows, changes, "audit_record_id", ["answer"])


@R.add("d05_mapping_lookup", """
    SELECT n.line_number, CASE WHEN n.decision <> 'ready' THEN 'not_applicable' ELSE coalesce(c.subject_type, 'out_of_taxonomy') END AS mapped FROM normalized_candidates n LEFT JOIN relation_catalog c ON n.relation_id = c.relation_id""")
def _(spark, d):
    catalog = table(spark, d, "relation_catalog").select("relation_id", "subject_type")
    rows = table(spark, d, "normalized_candidates").select("line_number", "decision", "relation_id").join(catalog, "relation_id", "left")
    return rows.select("line_number", F.when(F.col("decision") != "ready", "not_applicable").otherwise(F.coalesce("subject_type", F.lit("out_of_taxonomy"))).alias("mapped"))


@R.add("d06_mapping_validation", """
    SELECT 'unknown_relation' AS check_name, relation_id AS id FROM (SELECT DISTINCT relation_id FROM normalized_candidates WHERE relation_id IS NOT NULL) WHERE relation_id NOT IN (SELECT relation_id FROM relation_catalog)
    UNION ALL SELECT 'direction_differs', n.relation_id FROM normalized_candidates n JOIN relation_catalog c USING (relation_id) WHERE n.direction <> c.direction GROUP BY n.relation_id
    UNION ALL SELECT 'duplicate_relation', relation_id FROM relation_catalog GROUP BY relation_id HAVING count(*) > 1""")
def _(spark, d):
    rows, catalog = table(spark, d, "normalized_candidates"), table(spark, d, "relation_catalog")
    differs = rows.select("relation_id", "direction").join(catalog.select("relation_id", F.col("direction").alias("due")), "relation_id").where("direction <> due").select("relation_id").distinct()
    return validation.violations([("unknown_relation", validation.missing_references(rows, "relation_id", catalog, "relation_id")), ("direction_differs", differs), ("duplicate_relation", validation.duplicates(catalog, "relation_id"))])


@R.add("d07_policy_rules", """
    WITH p AS (SELECT * FROM (VALUES ('date_rule', 'subject_to_date', NULL), ('river_quantity', 'subject_to_quantity', 'river'), ('town_entity', 'subject_to_entity', 'town')) t(rule, direction, subject_type)),
    m AS (SELECT c.relation_id, p.rule FROM relation_catalog c JOIN p ON c.direction = p.direction AND (p.subject_type IS NULL OR p.subject_type = c.subject_type))
    SELECT c.relation_id, max(m.rule) AS rule, count(m.rule) AS matches FROM relation_catalog c LEFT JOIN m USING (relation_id) GROUP BY c.relation_id""")
def _(spark, d):
    rules = spark.createDataFrame([("date_rule", "subject_to_date", None), ("river_quantity", "subject_to_quantity", "river"), ("town_entity", "subject_to_entity", "town")], "rule string, r_direction string, r_type string")
    catalog = table(spark, d, "relation_catalog").select("relation_id", "direction", "subject_type")
    met = catalog.join(F.broadcast(rules), (F.col("direction") == F.col("r_direction")) & (F.col("r_type").isNull() | (F.col("r_type") == F.col("subject_type"))), "left")
    return met.groupBy("relation_id").agg(F.max("rule").alias("rule"), F.count("rule").alias("matches"))


_D08 = " ".join(f"WHEN regexp_full_match(raw, '{labels}') THEN struct_pack(status := 'mapped', relation := '{relation}', confidence := {confidence}::DOUBLE)" for relation, labels, confidence in relations.RULES)


@R.add("d08_first_match_classification", rf"""
    SELECT line_number, c.status AS status, c.relation AS relation, c.confidence AS confidence FROM (SELECT line_number, CASE WHEN raw = 'classification' AND regexp_matches(lower(subject), '{relations.CLASS_LIKE}') THEN struct_pack(status := 'mapped', relation := 'entity_classification', confidence := {relations.CLASS_CONFIDENCE}::DOUBLE)
      WHEN raw = 'classification' THEN struct_pack(status := 'ambiguous', relation := NULL::VARCHAR, confidence := NULL::DOUBLE) {_D08} WHEN regexp_full_match(raw, '{relations.AMBIGUOUS}') OR len(regexp_extract_all(raw, '\S+')) <= 1 THEN struct_pack(status := 'ambiguous', relation := NULL::VARCHAR, confidence := NULL::DOUBLE)
      ELSE struct_pack(status := 'out_of_taxonomy', relation := NULL::VARCHAR, confidence := NULL::DOUBLE) END AS c FROM (SELECT *, lower(trim(relation_raw)) AS raw FROM {_RAW} WHERE relation_raw IS NOT NULL))""")
def _(spark, d):
    rows = _raw(spark, d).where("relation_raw IS NOT NULL")
    return rows.select("line_number", relations.classified(F.col("relation_raw"), F.col("subject")).alias("c")).select("line_number", "c.*")



_OVERLAP_KEYS = {
    "source_id": ["source_id"], "normalized_question": ["question_normalized"], "normalized_question_answer": ["question_normalized", "answer_normalized"], "normalized_subject_answer": ["subject", "answer_normalized"],
    "normalized_raw_triple": ["subject", "relation_id", "answer_normalized"], "normalized_canonical_fact": ["canonical_fact_normalized"]}
_D09 = " UNION ALL ".join(f"SELECT '{name}' AS key_name, side, {' || chr(31) || '.join(columns)} AS k FROM t" for name, columns in _OVERLAP_KEYS.items())


@R.add("d09_exact_overlap", f"""
    WITH s AS (SELECT record_id, lower(trim(arg_min(struct_pack(x := subject), line_number).x)) AS subject, lower(trim(arg_min(struct_pack(x := relation_id), line_number).x)) AS relation_id FROM normalized_candidates GROUP BY 1),
    t AS (SELECT a.* EXCLUDE (source_subset), s.subject, s.relation_id, a.record_role AS side FROM audit_records a LEFT JOIN s ON a.source_id = s.record_id),
    k AS (SELECT key_name, k, count(*) FILTER (side = 'current_bundle') AS cur, count(*) FILTER (side = 'comparison_canonical') AS cmp FROM ({_D09}) WHERE k IS NOT NULL GROUP BY 1, 2)
    SELECT key_name, sum(cur)::BIGINT AS current_valid, sum(cmp)::BIGINT AS comparison_valid, count(*) FILTER (cur > 0) AS current_unique, count(*) FILTER (cmp > 0) AS comparison_unique, coalesce(sum(cur) FILTER (cmp > 0), 0)::BIGINT AS record_overlap, count(*) FILTER (cur > 0 AND cmp > 0) AS unique_overlap FROM k GROUP BY 1""")
def _(spark, d):
    # Subject and relation of a record are those of the first decision on its source.
    first = table(spark, d, "normalized_candidates").groupBy(F.col("record_id").alias("source_id")).agg(F.min_by(F.struct("subject", "relation_id"), "line_number").alias("s"))
    first = first.select("source_id", F.lower(F.trim("s.subject")).alias("subject"), F.lower(F.trim("s.relation_id")).alias("relation_id"))
    rows = table(spark, d, "audit_records").join(first, "source_id", "left")
    return joins.overlap_audit(rows, F.col("record_role") == "current_bundle", F.col("record_role") == "comparison_canonical", _OVERLAP_KEYS)



@R.add("d10_external_alignment", """
    WITH e AS (SELECT question_normalized AS q, list(list_transform(coalesce(answer_aliases, []), lambda x: lower(x))) AS sets FROM audit_records WHERE record_role = 'comparison_canonical' GROUP BY 1)
    SELECT a.audit_record_id, CASE WHEN sets IS NULL THEN 'pending' WHEN len(list_filter(sets, lambda s: list_contains(s, lower(a.answer)))) = 1 THEN 'aligned' WHEN len(list_filter(sets, lambda s: list_contains(s, lower(a.answer)))) > 1 THEN 'ambiguous' ELSE 'conflict' END AS alignment
    FROM audit_records a LEFT JOIN e ON a.question_normalized = e.q WHERE a.record_role = 'current_bundle'""")
def _(spark, d):
    rows = table(spark, d, "audit_records")
    current = rows.where("record_role = 'current_bundle'").select("audit_record_id", "question_normalized", F.lower("answer").alias("a"))
    external = rows.where("record_role = 'comparison_canonical'").select(F.col("question_normalized").alias("eq"), F.transform(F.coalesce("answer_aliases", F.array().cast("array<string>")), lambda x: F.lower(x)).alias("ea"))
    return joins.align(current, "question_normalized", "a", external, "eq", "ea").select("audit_record_id", "alignment")


_FACTS = "(SELECT record_id, min(relation_id) AS relation, min(answer) AS answer, min(subject) AS subject FROM normalized_candidates WHERE decision = 'ready' AND answer IS NOT NULL AND relation_id IN (SELECT relation_id FROM relation_catalog) GROUP BY record_id)"


def _facts(spark, d):
    catalog = table(spark, d, "relation_catalog").select("relation_id")
    ready = table(spark, d, "normalized_candidates").where("decision = 'ready' AND answer IS NOT NULL").join(catalog, "relation_id", "left_semi")
    return ready.groupBy("record_id").agg(F.min("relation_id").alias("relation"), F.min("answer").alias("answer"), F.min("subject").alias("subject"))


@R.add("d15_donor_join", f"""
    WITH f AS {_FACTS}, p AS (SELECT *, row_number() OVER (PARTITION BY relation, answer ORDER BY sha256(record_id), record_id) AS rn FROM f)
    SELECT t.record_id, p.record_id AS donor, row_number() OVER (PARTITION BY t.record_id ORDER BY sha256(p.record_id), p.record_id)::INT AS rank FROM f t JOIN p ON t.relation = p.relation AND t.answer <> p.answer AND p.rn = 1
    QUALIFY row_number() OVER (PARTITION BY t.record_id ORDER BY sha256(p.record_id), p.record_id) <= 2""")
def _(spark, d):
    facts = _facts(spark, d)
    return joins.donors(facts, facts, ["relation"], "record_id", ["answer"], 2, F.sha2("record_id", 256))


@R.add("d16_icl_donors", f"""
    WITH f AS {_FACTS}, p AS (SELECT *, row_number() OVER (PARTITION BY relation, subject ORDER BY sha256('icl' || record_id), record_id) AS rn FROM f)
    SELECT t.record_id, count(*) AS donors, min(p.record_id) AS least_donor FROM f t JOIN LATERAL (SELECT p.record_id FROM p WHERE p.relation = t.relation AND p.subject <> t.subject AND p.rn = 1 ORDER BY sha256('icl' || p.record_id), p.record_id LIMIT 5) p ON true GROUP BY t.record_id""")
def _(spark, d):
    facts = _facts(spark, d).where("subject IS NOT NULL")
    found = joins.donors(facts, facts, ["relation"], "record_id", ["subject"], 5, F.sha2(F.concat(F.lit("icl"), "record_id"), 256))
    return found.groupBy("record_id").agg(F.count(F.lit(1)).alias("donors"), F.min("donor").alias("least_donor"))


@R.add("d17_matched_controls", f"""
    WITH f AS {_FACTS} SELECT t.record_id, (SELECT count(*) FROM f c WHERE c.relation = t.relation AND length(c.answer) = length(t.answer)) - (SELECT count(*) FROM f c WHERE c.relation = t.relation AND length(c.answer) = length(t.answer) AND c.subject IS NOT DISTINCT FROM t.subject) AS controls FROM f t""")
def _(spark, d):
    # Matched controls are counted per bucket and subject, never listed pair by pair.
    facts = _facts(spark, d).withColumn("size", F.length("answer"))
    whole = F.count(F.lit(1)).over(Window.partitionBy("relation", "size"))
    own = F.count(F.lit(1)).over(Window.partitionBy("relation", "size", "subject"))
    return facts.select("record_id", (whole - own).alias("controls"))


@R.add("d18_three_arm_pivot", """
    SELECT user_id, round(max(CASE WHEN event_type = 'view' THEN value END), 6) AS original, round(max(CASE WHEN event_type = 'click' THEN value END), 6) AS neutral, round(max(CASE WHEN event_type = 'purchase' THEN value END), 6) AS targeted FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY user_id""")
def _(spark, d):
    rows = table(spark, d, "events").where("event_type IN ('view', 'click', 'purchase')").withColumn("arm", F.expr("CASE event_type WHEN 'view' THEN 'original' WHEN 'click' THEN 'neutral' ELSE 'targeted' END"))
    out = evaluation.arms(rows, ["user_id"], "arm", ["original", "neutral", "targeted"], "value")
    return out.select("user_id", *[F.round(c, 6).alias(c) for c in ("original", "neutral", "targeted")])


@R.add("d19_simulation_grid", """
    SELECT r.relation_id, m.model_name, l.lang, a.arm, substr(sha256(r.relation_id || '␟' || m.model_name || '␟' || l.lang || '␟' || a.arm), 1, 16) AS simulation_id
    FROM relation_catalog r, (SELECT DISTINCT model_name FROM model_annotations) m, (SELECT * FROM (VALUES ('en'), ('zh')) t(lang)) l, (SELECT * FROM (VALUES ('original'), ('neutral'), ('targeted')) t(arm)) a""")
def _(spark, d):
    languages, arms = spark.createDataFrame([("en",), ("zh",)], "lang string"), spark.createDataFrame([("original",), ("neutral",), ("targeted",)], "arm string")
    models = table(spark, d, "model_annotations").select("model_name").distinct()
    cells = joins.grid(table(spark, d, "relation_catalog").select("relation_id"), models, languages, arms)
    return cells.withColumn("simulation_id", F.substring(F.sha2(F.concat_ws("␟", "relation_id", "model_name", "lang", "arm"), 256), 1, 16)).dropDuplicates(["simulation_id"])


@R.add("d20_repeat_run_comparison", f"""
    WITH a AS {_VOTES.format('sorrel-4')}, b AS {_VOTES.format('dune-base')}
    SELECT side, count(*) AS n FROM ((SELECT source_id, decision, 'left' AS side FROM a EXCEPT ALL SELECT source_id, decision, 'left' FROM b) UNION ALL (SELECT source_id, decision, 'right' FROM b EXCEPT ALL SELECT source_id, decision, 'right' FROM a)) GROUP BY side""")
def _(spark, d):
    out = joins.symmetric_difference(_latest_votes(spark, d, "sorrel-4"), _latest_votes(spark, d, "dune-base"), ["source_id", "decision"])
    return out.groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@R.add("d21_decision_cover", """
    WITH due AS (SELECT DISTINCT record_id AS id FROM normalized_candidates WHERE decision = 'ready'), seen AS (SELECT record_id AS id, count(*) AS n FROM zh_translations GROUP BY 1)
    SELECT coalesce(due.id, seen.id) AS id, CASE WHEN due.id IS NULL THEN 'unexpected' WHEN n IS NULL THEN 'missing' ELSE 'repeated' END AS problem FROM due FULL JOIN seen ON due.id = seen.id WHERE due.id IS NULL OR n IS NULL OR n > 1""")
def _(spark, d):
    due = table(spark, d, "normalized_candidates").where("decision = 'ready'").select(F.col("record_id").alias("id"))
    return validation.exact_cover(due, table(spark, d, "zh_translations").select(F.col("record_id").alias("id")), "id")


@R.add("d22_cohort_guard", """
    WITH c AS (SELECT * FROM audit_records WHERE split_assignment = 'sealed'), k AS (SELECT * FROM audit_records WHERE split_assignment = 'validation')
    SELECT 'id' AS guard, count(*) AS overlap FROM k WHERE base_fact_id IN (SELECT base_fact_id FROM c) UNION ALL SELECT 'prompt', count(*) FROM k WHERE question_normalized IN (SELECT question_normalized FROM c) UNION ALL SELECT 'answer', count(*) FROM k WHERE answer_normalized IN (SELECT answer_normalized FROM c)""")
def _(spark, d):
    rows = table(spark, d, "audit_records")
    cohort, controls, out = rows.where("split_assignment = 'sealed'"), rows.where("split_assignment = 'validation'"), None
    for guard, column in (("id", "base_fact_id"), ("prompt", "question_normalized"), ("answer", "answer_normalized")):
        one = controls.select(column).join(cohort.select(column).distinct(), column, "left_semi").agg(F.count(F.lit(1)).alias("overlap")).select(F.lit(guard).alias("guard"), "overlap")
        out = one if out is None else out.unionByName(one)
    return out


@R.add("d24_alias_disjoint_donors", f"""
    WITH f AS {_FACTS}, p AS (SELECT *, row_number() OVER (PARTITION BY relation, lower(answer) ORDER BY sha256('alias' || record_id), record_id) AS rn FROM f)
    SELECT t.record_id, arg_min(p.record_id, (sha256('alias' || p.record_id), p.record_id)) AS donor FROM f t JOIN p ON t.relation = p.relation AND lower(t.answer) <> lower(p.answer) AND p.rn = 1 GROUP BY t.record_id""")
def _(spark, d):
    facts = _facts(spark, d).withColumn("alias", F.lower("answer"))
    return joins.donors(facts, facts, ["relation"], "record_id", ["alias"], 1, F.sha2(F.concat(F.lit("alias"), "record_id"), 256)).select("record_id", "donor")


@R.add("d25_round_drift", """
    WITH a AS (SELECT source_id, arg_min(coalesce(canonical_decision, '-'), (created_at, annotation_id)) AS x FROM model_annotations GROUP BY source_id), b AS (SELECT source_id, arg_max(coalesce(canonical_decision, '-'), (created_at, annotation_id)) AS x FROM model_annotations GROUP BY source_id)
    SELECT a.x AS before, b.x AS after, count(*) AS n FROM a JOIN b USING (source_id) GROUP BY 1, 2""")
def _(spark, d):
    rows = table(spark, d, "model_annotations").select("source_id", F.coalesce("canonical_decision", F.lit("-")).alias("x"), F.struct("created_at", "annotation_id").alias("o"))
    return joins.drift(rows.groupBy("source_id").agg(F.min_by("x", "o").alias("x")), rows.groupBy("source_id").agg(F.max_by("x", "o").alias("x")), "source_id", "x")


@R.add("d26_leave_one_fold_out", """
    WITH f AS (SELECT relation_id, subject_type FROM relation_catalog), folds AS (SELECT DISTINCT subject_type AS fold FROM f)
    SELECT fold, count(*) AS sources FROM folds JOIN f ON fold <> subject_type GROUP BY fold UNION ALL SELECT 'full', count(*) FROM f""")
def _(spark, d):
    facts = table(spark, d, "relation_catalog").select("relation_id", "subject_type")
    folds = facts.select(F.col("subject_type").alias("fold")).distinct()
    others = joins.grid(facts, folds).where("fold <> subject_type")
    return others.unionByName(facts.withColumn("fold", F.lit("full"))).groupBy("fold").agg(F.count(F.lit(1)).alias("sources"))


@R.add("d27_pair_rebinding", """
    WITH c AS (SELECT base_fact_id AS p, lag(base_fact_id) OVER (PARTITION BY source_id ORDER BY line_number) AS q, coalesce(split_group_id, lag(split_group_id) OVER (PARTITION BY source_id ORDER BY line_number)) AS old FROM audit_records)
    SELECT x, y, CASE WHEN x = y THEN 'same_fact' ELSE coalesce(old, 'unreviewed') END AS decision FROM (SELECT least(p, q) AS x, greatest(p, q) AS y, min(old) AS old FROM c WHERE q IS NOT NULL GROUP BY 1, 2)""")
def _(spark, d):
    # Pairs of a source form a chain: old decisions are re-attached to as many pairs as rows.
    w = Window.partitionBy("source_id").orderBy("line_number")
    rows = table(spark, d, "audit_records").select(F.col("base_fact_id").alias("x"), F.lag("base_fact_id").over(w).alias("y"), F.coalesce("split_group_id", F.lag("split_group_id").over(w)).alias("old")).where("y IS NOT NULL")
    pairs = rows.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min("old").alias("old"))
    return pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), F.when(F.col("a") == F.col("b"), "same_fact").otherwise(F.coalesce("old", F.lit("unreviewed"))).alias("decision"))
