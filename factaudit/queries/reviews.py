"""Review, gate and admission operators, call outcomes and event windows, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factaudit.operators import canonical, evaluation, joins, ledger, validation
from factaudit.queries.registry import Registry, folded_sql
from factaudit.session import table

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql

_PLAIN = "regexp_replace(lower(trim(regexp_replace({}, '\\s', ' ', 'g'))), '[ -]', '_', 'g')"


def _plain(column):
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(column, r"\s", " "))), "[ -]", "_")


def _two(spark, d):
    """The last labels of two annotators per item, with their conflicts and confidence."""
    def one(model, side):
        rows = table(spark, d, "model_annotations").where((F.col("model_name") == model) & F.col("canonical_decision").isNotNull())
        last = evaluation.latest(rows.select("source_id", "canonical_decision", "extraction_confidence", "created_at", "annotation_id"), ["source_id"], ["created_at", "annotation_id"])
        return last.select("source_id", _plain("canonical_decision").alias(f"d{side}"), F.col("extraction_confidence").alias(f"c{side}"))

    return one("orrin-3", 1).join(one("yarrow-2", 2), "source_id", "full_outer")


_ONE = "(SELECT source_id, " + _PLAIN.format("arg_max(canonical_decision, (created_at, annotation_id))") + " AS d, arg_max(struct_pack(c := extraction_confidence), (created_at, annotation_id)).c AS c FROM model_annotations WHERE model_name = '{}' AND canonical_decision IS NOT NULL GROUP BY source_id)"


_COMPARE = lambda c: rf"regexp_replace(regexp_replace(coalesce(trim(regexp_replace({folded_sql(c)}, '\s+', ' ', 'g')), ''), '^(a|an|the)\s+', ''), '[^a-z0-9]+', '', 'g')"
_CASE = f"CASE WHEN p_ok <> s_ok THEN 'single_model_extraction' WHEN p_ok AND ({_COMPARE('p_answer')} = '' OR {_COMPARE('p_answer')} <> {_COMPARE('s_answer')}) THEN 'dual_model_answer_conflict' END"


@R.add("h01_canonical_decision", f"""
    WITH n AS (SELECT record_id, arg_min(struct_pack(decision, subject, relation_id, answer, canonical_fact), line_number) AS v FROM normalized_candidates GROUP BY 1), a AS (SELECT source_id, arg_min(struct_pack(source_subset, answer, canonical_fact), line_number) AS v FROM audit_records GROUP BY 1),
    r AS (SELECT source_id, arg_max(lower(trim(canonical_decision)), (created_at, annotation_id)) AS d FROM model_annotations WHERE model_name = 'orrin-3' AND canonical_decision IS NOT NULL GROUP BY 1),
    p AS (SELECT n.record_id AS source_id, n.v.decision = 'ready' AND n.v.answer IS NOT NULL AS p_ok, a.v.canonical_fact IS NOT NULL AS s_ok, n.v.subject AS p_subject, a.v.source_subset AS s_subject, n.v.relation_id AS p_relation, NULL AS s_relation, n.v.answer AS p_answer, a.v.answer AS s_answer, n.v.canonical_fact AS p_fact, a.v.canonical_fact AS s_fact,
      0.9::DOUBLE AS p_confidence, 0.8::DOUBLE AS s_confidence, CASE r.d WHEN 'keep' THEN 'accept' WHEN 'exclude' THEN 'reject' END AS review FROM n JOIN a ON n.record_id = a.source_id LEFT JOIN r ON r.source_id = n.record_id),
    c AS (SELECT *, {_CASE} AS k FROM p), d AS (SELECT *, CASE WHEN NOT p_ok AND NOT s_ok THEN 'exclude' WHEN k IS NULL THEN 'keep' WHEN review IS NULL THEN 'pending_review' WHEN review = 'reject' THEN 'exclude' ELSE 'keep' END AS decision FROM c)
    SELECT source_id, decision, CASE WHEN NOT p_ok AND NOT s_ok THEN 'both_models_not_extracted_or_invalid' WHEN k IS NULL THEN 'dual_model_extraction_and_answer_consensus' WHEN review IS NULL THEN k || '_requires_review' WHEN review = 'reject' THEN 'rejected_' || k ELSE 'accepted_' || k END AS reason,
      CASE WHEN decision = 'keep' THEN CASE WHEN p_ok THEN 'preferred' ELSE 'secondary' END END AS chosen,
      CASE WHEN decision = 'keep' THEN array_to_string(list_filter([CASE WHEN {_COMPARE('p_subject')} <> {_COMPARE('s_subject')} THEN 'subject' END, CASE WHEN {_COMPARE('p_relation')} <> '' THEN 'relation' END, CASE WHEN k IS NOT NULL AND {_COMPARE('p_answer')} <> {_COMPARE('s_answer')} THEN 'answer' END, CASE WHEN {_COMPARE('p_fact')} <> {_COMPARE('s_fact')} THEN 'fact' END], lambda x: x IS NOT NULL), '|') END AS conflicts,
      CASE WHEN decision = 'keep' THEN CASE WHEN k IS NULL THEN 0.8 WHEN p_ok THEN 0.9 ELSE 0.8 END::DOUBLE END AS confidence FROM d""")
def _(spark, d):
    """The first decision on a record is the preferred extraction, its first audit record the secondary one, an annotator's last label the review."""
    first = lambda rows, key, *columns: rows.groupBy(F.col(key).alias("source_id")).agg(F.min_by(F.struct(*columns), "line_number").alias("v"))
    n = first(table(spark, d, "normalized_candidates"), "record_id", "decision", "subject", "relation_id", "answer", "canonical_fact").select(
        "source_id", ((F.col("v.decision") == "ready") & F.col("v.answer").isNotNull()).alias("p_ok"), F.col("v.subject").alias("p_subject"), F.col("v.relation_id").alias("p_relation"), F.col("v.answer").alias("p_answer"), F.col("v.canonical_fact").alias("p_fact"), F.lit(0.9).alias("p_confidence"))
    a = first(table(spark, d, "audit_records"), "source_id", "source_subset", "answer", "canonical_fact").select(
        "source_id", F.col("v.canonical_fact").isNotNull().alias("s_ok"), F.col("v.source_subset").alias("s_subject"), F.lit(None).cast("string").alias("s_relation"), F.col("v.answer").alias("s_answer"), F.col("v.canonical_fact").alias("s_fact"), F.lit(0.8).alias("s_confidence"))
    said = table(spark, d, "model_annotations").where("model_name = 'orrin-3' AND canonical_decision IS NOT NULL").groupBy("source_id").agg(F.max_by(F.lower(F.trim("canonical_decision")), F.struct("created_at", "annotation_id")).alias("d"))
    review = said.select("source_id", F.when(F.col("d") == "keep", "accept").when(F.col("d") == "exclude", "reject").alias("review"))
    out = canonical.decided(n.join(a, "source_id").join(review, "source_id", "left"), "source_id")
    return out.withColumn("conflicts", F.array_join("conflicts", "|"))



@R.add("h02_taxonomy_build", "SELECT subject_type, count(*) AS relations, string_agg(relation_id, '|' ORDER BY relation_id) AS ids, sum(len(examples))::BIGINT AS examples FROM relation_catalog GROUP BY subject_type")
def _(spark, d):
    c = table(spark, d, "relation_catalog")
    return c.groupBy("subject_type").agg(F.count(F.lit(1)).alias("relations"), F.array_join(F.array_sort(F.collect_list("relation_id")), "|").alias("ids"), F.sum(F.size("examples")).alias("examples"))


@R.add("h03_output_validation", f"""
    WITH src AS (SELECT candidate_id AS source_id, arg_min(struct_pack(c := source_snapshot.record.choices), line_number).c AS choices, arg_min(struct_pack(c := source_snapshot.record.answer), line_number).c AS source_answer FROM raw_candidates GROUP BY 1),
    can AS (SELECT a.source_id, s.choices FROM audit_records a LEFT JOIN src s USING (source_id)), nor AS (SELECT record_id AS source_id, CASE WHEN relation_id IN (SELECT relation_id FROM relation_catalog) THEN 'mapped' WHEN decision = 'ready' THEN 'ambiguous' ELSE 'out' END AS status, CASE WHEN decision = 'ready' THEN relation_id END AS relation, prompt_en, answer, decision, reason FROM normalized_candidates),
    pro AS (SELECT source_id, CASE WHEN decision = 'ready' THEN 'generated' ELSE 'rejected' END AS status, prompt_en AS prompt, answer AS expected, CASE WHEN decision <> 'ready' THEN reason END AS rejection FROM nor),
    dis AS (SELECT s.source_id, s.choices, s.source_answer, p.answer FROM src s JOIN (SELECT record_id, min(answer) AS answer FROM normalized_candidates WHERE decision = 'ready' GROUP BY 1) p ON p.record_id = s.source_id WHERE len(coalesce(s.choices, [])) > 0),
    opt AS (SELECT *, {_COMPARE('source_answer')} AS k1, {_COMPARE('answer')} AS k2 FROM dis)
    SELECT 'duplicate_canonical' AS check_name, source_id AS id FROM can GROUP BY source_id HAVING count(*) > 1
    UNION ALL SELECT DISTINCT 'canonical_without_source', source_id FROM can WHERE source_id NOT IN (SELECT source_id FROM src)
    UNION ALL (SELECT 'normalised_ids_differ', source_id FROM (SELECT source_id FROM can EXCEPT SELECT source_id FROM nor) UNION ALL SELECT 'normalised_ids_differ', source_id FROM (SELECT source_id FROM nor EXCEPT SELECT source_id FROM can))
    UNION ALL (SELECT 'prompt_ids_differ', source_id FROM (SELECT source_id FROM can EXCEPT SELECT source_id FROM pro) UNION ALL SELECT 'prompt_ids_differ', source_id FROM (SELECT source_id FROM pro EXCEPT SELECT source_id FROM can))
    UNION ALL SELECT DISTINCT 'status_relation_mismatch', source_id FROM nor WHERE (status = 'mapped') = (coalesce(trim(relation), '') = '')
    UNION ALL SELECT DISTINCT 'generated_prompt_incomplete', source_id FROM pro WHERE status = 'generated' AND (coalesce(trim(prompt), '') = '' OR coalesce(trim(expected), '') = '')
    UNION ALL SELECT DISTINCT 'rejected_prompt_without_reason', source_id FROM pro WHERE status <> 'generated' AND coalesce(trim(rejection), '') = ''
    UNION ALL (SELECT 'distractor_ids_differ', source_id FROM (SELECT source_id FROM pro WHERE status = 'generated' EXCEPT SELECT source_id FROM dis) UNION ALL SELECT 'distractor_ids_differ', source_id FROM (SELECT source_id FROM dis EXCEPT SELECT source_id FROM pro WHERE status = 'generated'))
    UNION ALL SELECT DISTINCT 'wrong_options_mismatch', source_id FROM (SELECT source_id, list_filter(choices, lambda c: c IS DISTINCT FROM source_answer) AS w, choices, k1, k2 FROM opt) o WHERE w <> list_filter(choices, lambda c: {_COMPARE('c')} NOT IN (k1, k2))
    UNION ALL SELECT DISTINCT 'answer_leaked_into_distractors', source_id FROM (SELECT o.source_id, o.k1, o.k2, unnest(list_filter(o.choices, lambda c: c IS DISTINCT FROM o.source_answer)) AS choice FROM opt o) WHERE {_COMPARE('choice')} IN (k1, k2)""")
def _(spark, d):
    rec = "source_snapshot.record."
    source = table(spark, d, "raw_candidates").groupBy(F.col("candidate_id").alias("source_id")).agg(F.min_by(F.struct(F.col(rec + "choices").alias("choices"), F.col(rec + "answer").alias("source_answer")), "line_number").alias("v")).select("source_id", "v.*")
    n = table(spark, d, "normalized_candidates").withColumnRenamed("record_id", "source_id")
    listed = table(spark, d, "relation_catalog").select("relation_id", F.lit(True).alias("listed"))
    ready = F.col("decision") == "ready"
    normalised = n.join(listed, "relation_id", "left").select("source_id", F.when(F.col("listed"), "mapped").when(ready, "ambiguous").otherwise("out").alias("status"), F.when(ready, F.col("relation_id")).alias("relation"))
    prompts = n.select("source_id", F.when(ready, "generated").otherwise("rejected").alias("status"), F.col("prompt_en").alias("prompt"), F.col("answer").alias("expected"), F.when(~ready, F.col("reason")).alias("rejection"))
    answers = n.where(ready).groupBy("source_id").agg(F.min("answer").alias("answer"))
    distractors = source.where("size(choices) > 0").join(answers, "source_id")
    others = F.filter("choices", lambda c: ~c.eqNullSafe(F.col("source_answer")))
    distractors = distractors.withColumn("wrong_options", others).withColumn("candidates", others)
    held = table(spark, d, "audit_records").select("source_id").join(source.select("source_id", "choices"), "source_id", "left")
    return canonical.run_violations(source.select("source_id", "choices"), held, normalised, prompts, distractors)



@R.add("h04_review_scope", """
    SELECT n.record_id, count(*) AS proposals, coalesce(max(v.outcome), 'missing') AS outcome FROM normalized_candidates n LEFT JOIN (SELECT source_id, CASE WHEN bool_and(lower(trim(canonical_decision)) = 'keep') THEN 'accept' WHEN bool_or(lower(trim(canonical_decision)) = 'exclude') THEN 'reject' ELSE 'defer' END AS outcome FROM model_annotations WHERE canonical_decision IS NOT NULL GROUP BY 1) v ON n.record_id = v.source_id GROUP BY 1""")
def _(spark, d):
    said = F.lower(F.trim("canonical_decision"))
    outcome = F.when(F.bool_and(said == "keep"), "accept").when(F.bool_or(said == "exclude"), "reject").otherwise("defer")
    votes = table(spark, d, "model_annotations").where("canonical_decision IS NOT NULL").groupBy(F.col("source_id").alias("record_id")).agg(outcome.alias("outcome"))
    scope = table(spark, d, "normalized_candidates").groupBy("record_id").agg(F.count(F.lit(1)).alias("proposals"))
    return scope.join(votes, "record_id", "left").select("record_id", "proposals", F.coalesce("outcome", F.lit("missing")).alias("outcome"))


@R.add("h05_consolidation", """
    WITH a AS (SELECT record_id, min(decision) AS d FROM normalized_candidates WHERE attempt_number = 1 GROUP BY 1), b AS (SELECT record_id, max(decision) AS d FROM normalized_candidates WHERE attempt_number > 1 GROUP BY 1)
    SELECT coalesce(a.record_id, b.record_id) AS record_id, coalesce(b.d, a.d) AS decision, CASE WHEN a.d IS NOT NULL AND b.d IS NOT NULL THEN 'resolved' WHEN b.d IS NOT NULL THEN 'later' ELSE 'first' END AS origin FROM a FULL JOIN b ON a.record_id = b.record_id""")
def _(spark, d):
    n = table(spark, d, "normalized_candidates")
    a = n.where("attempt_number = 1").groupBy("record_id").agg(F.min("decision").alias("a"))
    b = n.where("attempt_number > 1").groupBy("record_id").agg(F.max("decision").alias("b"))
    origin = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), "resolved").when(F.col("b").isNotNull(), "later").otherwise("first")
    return a.join(b, "record_id", "full_outer").select("record_id", F.coalesce("b", "a").alias("decision"), origin.alias("origin"))


@R.add("h06_composite_authority", """
    SELECT record_id, 'parent' AS authority FROM (SELECT DISTINCT record_id FROM normalized_candidates WHERE decision = 'ready') UNION ALL SELECT record_id, 'supplement' FROM (SELECT DISTINCT record_id FROM normalized_candidates WHERE decision <> 'ready') WHERE record_id NOT IN (SELECT record_id FROM normalized_candidates WHERE decision = 'ready')""")
def _(spark, d):
    n = table(spark, d, "normalized_candidates")
    parent = n.where("decision = 'ready'").select("record_id").distinct()
    rest = n.where("decision <> 'ready'").select("record_id").distinct().join(parent, "record_id", "left_anti")
    return parent.withColumn("authority", F.lit("parent")).unionByName(rest.withColumn("authority", F.lit("supplement")))


@R.add("h07_revision_application", "SELECT n.line_number, coalesce(c.relation_definition, n.relation_definition) AS definition, 'pbf_' || substr(sha256(coalesce(n.record_id, '') || '␟' || coalesce(c.relation_definition, n.relation_definition, '')), 1, 20) AS revised_id FROM normalized_candidates n LEFT JOIN relation_catalog c USING (relation_id)")
def _(spark, d):
    from factaudit.functions.ids import stable_id

    changes = table(spark, d, "relation_catalog").select("relation_id", "relation_definition")
    rows = joins.override(table(spark, d, "normalized_candidates").select("line_number", "record_id", "relation_id", "relation_definition"), changes, "relation_id", ["relation_definition"])
    return rows.select("line_number", F.col("relation_definition").alias("definition"), stable_id("pbf_", F.col("record_id"), F.col("relation_definition")).alias("revised_id"))


@R.add("h08_pair_decisions", """
    WITH p AS (SELECT source_id, lag(canonical_fact_normalized) OVER (PARTITION BY source_id ORDER BY line_number) AS x, canonical_fact_normalized AS y FROM audit_records) SELECT source_id, CASE WHEN x = y THEN 'same_fact' WHEN x IS NULL OR y IS NULL THEN 'undecided' ELSE 'distinct' END AS relationship FROM p WHERE x IS NOT NULL""")
def _(spark, d):
    w = Window.partitionBy("source_id").orderBy("line_number")
    p = table(spark, d, "audit_records").select("source_id", F.lag("canonical_fact_normalized").over(w).alias("x"), F.col("canonical_fact_normalized").alias("y")).where("x IS NOT NULL")
    return p.select("source_id", F.when(F.col("x") == F.col("y"), "same_fact").when(F.col("y").isNull(), "undecided").otherwise("distinct").alias("relationship"))


@R.add("h09_formal_admission", """
    SELECT audit_record_id, array_to_string(list_filter([CASE WHEN split_assignment IS NULL THEN 'unassigned' END, CASE WHEN split_group_id IS NULL THEN 'no_group' END, CASE WHEN canonical_fact IS NULL THEN 'no_fact' END, CASE WHEN record_role <> 'current_bundle' THEN 'not_current' END], lambda x: x IS NOT NULL), '|') AS blockers FROM audit_records""")
def _(spark, d):
    rules = [("unassigned", F.col("split_assignment").isNull()), ("no_group", F.col("split_group_id").isNull()), ("no_fact", F.col("canonical_fact").isNull()), ("not_current", F.col("record_role") != "current_bundle")]
    return table(spark, d, "audit_records").select("audit_record_id", F.array_join(validation.reasons(rules), "|").alias("blockers"))


@R.add("h10_split_group_contract", "SELECT split_group_id, count(DISTINCT split_assignment) AS splits FROM audit_records WHERE split_group_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split_assignment) > 1")
def _(spark, d):
    rows = table(spark, d, "audit_records").where("split_group_id IS NOT NULL")
    return rows.groupBy("split_group_id").agg(F.count_distinct("split_assignment").alias("splits")).where("splits > 1")


@R.add("h11_preflight_report", """
    WITH b AS (SELECT 'no_fact' AS blocker, audit_record_id AS id FROM audit_records WHERE canonical_fact IS NULL UNION ALL SELECT 'no_group', audit_record_id FROM audit_records WHERE split_group_id IS NULL UNION ALL SELECT 'no_split', audit_record_id FROM audit_records WHERE split_assignment IS NULL), r AS (SELECT *, row_number() OVER (PARTITION BY blocker ORDER BY id) AS rn FROM b)
    SELECT blocker, count(*) AS n, string_agg(CASE WHEN rn <= 3 THEN id END, '|' ORDER BY rn) AS examples FROM r GROUP BY blocker""")
def _(spark, d):
    from factaudit.operators.reports import preflight

    a = table(spark, d, "audit_records")
    checks = [(n, a.where(F.col(c).isNull()).select("audit_record_id")) for n, c in (("no_fact", "canonical_fact"), ("no_group", "split_group_id"), ("no_split", "split_assignment"))]
    return preflight(checks, 3)


@R.add("h12_funnel", """
    SELECT status, count(*) AS n FROM (SELECT r.candidate_id, CASE WHEN max(z.record_id) IS NOT NULL THEN '4_translated' WHEN bool_or(n.decision = 'ready') THEN '3_ready' WHEN max(n.record_id) IS NOT NULL THEN '2_decided' ELSE '1_raw' END AS status FROM raw_candidates r LEFT JOIN normalized_candidates n ON r.candidate_id = n.record_id LEFT JOIN (SELECT DISTINCT record_id FROM zh_translations) z ON r.candidate_id = z.record_id GROUP BY 1) GROUP BY status""")
def _(spark, d):
    n = table(spark, d, "normalized_candidates").groupBy(F.col("record_id").alias("candidate_id")).agg(F.bool_or(F.col("decision") == "ready").alias("ready"))
    z = table(spark, d, "zh_translations").select(F.col("record_id").alias("candidate_id"), F.lit(True).alias("zh")).distinct()
    rows = table(spark, d, "raw_candidates").select("candidate_id").distinct().join(n, "candidate_id", "left").join(z, "candidate_id", "left")
    status = F.when(F.col("zh"), "4_translated").when(F.col("ready"), "3_ready").when(F.col("ready").isNotNull(), "2_decided").otherwise("1_raw")
    return rows.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@R.add("h13_review_action", "SELECT packet_id, CASE WHEN count(canonical_decision) = 0 THEN 'start' WHEN count(canonical_decision) < count(*) THEN 'resume' ELSE 'close' END AS action, count(*) - count(canonical_decision) AS open FROM model_annotations GROUP BY packet_id")
def _(spark, d):
    g = table(spark, d, "model_annotations").groupBy("packet_id").agg(F.count(F.lit(1)).alias("n"), F.count("canonical_decision").alias("done"))
    return g.select("packet_id", F.when(F.col("done") == 0, "start").when(F.col("done") < F.col("n"), "resume").otherwise("close").alias("action"), (F.col("n") - F.col("done")).alias("open"))


@R.add("h14_watchdog_budget", """
    SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS in_window, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) > 60 AS exhausted FROM events WHERE event_type IN ('error', 'signup')""")
def _(spark, d):
    rows = table(spark, d, "events").where("event_type IN ('error', 'signup')").select("event_id", "event_type", "ts")
    return ledger.attempts_in_window(rows, "event_type", "ts", 86400).select("event_id", "in_window", (F.col("in_window") > 60).alias("exhausted"))


@R.add("h15_report_rows", "SELECT '| ' || source_dataset || ' | ' || count(*)::VARCHAR || ' |' AS line FROM audit_records GROUP BY source_dataset")
def _(spark, d):
    from factaudit.operators.reports import markdown_rows

    return markdown_rows(table(spark, d, "audit_records").groupBy("source_dataset").agg(F.count(F.lit(1)).alias("n")), ["source_dataset", "n"])


@R.add("h16_proxy_plan", "SELECT a.audit_record_id, CASE WHEN a.canonical_fact IS NULL THEN 'defer' ELSE 'accept' END AS decision, CASE WHEN a.canonical_fact IS NULL THEN 'override' ELSE 'default' END AS origin FROM audit_records a")
def _(spark, d):
    a = table(spark, d, "audit_records").select("audit_record_id", "canonical_fact")
    overrides = a.where("canonical_fact IS NULL").select("audit_record_id", F.lit("defer").alias("o"))
    return a.join(overrides, "audit_record_id", "left").select("audit_record_id", F.coalesce("o", F.lit("accept")).alias("decision"), F.when(F.col("o").isNotNull(), "override").otherwise("default").alias("origin"))


@R.add("h17_exposure_contract", r"""
    WITH m AS (SELECT DISTINCT unnest(regexp_extract_all(text, 'raw_[a-z_]+_\d+')) AS id FROM documents) SELECT CASE WHEN candidate_id IS NULL THEN 'foreign' ELSE 'exposed' END AS status, count(*) AS n FROM m LEFT JOIN (SELECT DISTINCT candidate_id FROM raw_candidates) r ON m.id = r.candidate_id GROUP BY 1""")
def _(spark, d):
    from factaudit.sources.artifacts import mentioned_ids

    ids = mentioned_ids(table(spark, d, "documents"), "doc_id", "text", r"raw_[a-z_]+_\d+").select("identifier").distinct()
    known = table(spark, d, "raw_candidates").select(F.col("candidate_id").alias("identifier")).distinct().withColumn("known", F.lit(True))
    return ids.join(known, "identifier", "left").groupBy(F.when(F.col("known"), "exposed").otherwise("foreign").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@R.add("h18_release_freeze", "SELECT split_assignment, count(*) AS records, count(DISTINCT base_fact_id) AS facts, sum(('0x' || substr(sha256(audit_record_id), 1, 12))::BIGINT)::VARCHAR AS digest, count(canonical_fact) = count(*) AS complete FROM audit_records WHERE split_assignment IS NOT NULL GROUP BY 1")
def _(spark, d):
    from factaudit.sources.artifacts import set_digest

    rows = table(spark, d, "audit_records").where("split_assignment IS NOT NULL")
    return rows.groupBy("split_assignment").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("base_fact_id").alias("facts"), set_digest("audit_record_id").alias("digest"), (F.count("canonical_fact") == F.count(F.lit(1))).alias("complete"))


@R.add("h19_language_cover", """
    WITH due AS (SELECT DISTINCT source, l AS lang FROM documents, (SELECT unnest(['en', 'zh', 'de', 'fr', 'es']) AS l) WHERE source IS NOT NULL), seen AS (SELECT source, lang, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1, 2)
    SELECT due.source, due.lang, coalesce(n, 0) AS n, n IS NOT NULL AS covered FROM due LEFT JOIN seen ON due.source = seen.source AND due.lang = seen.lang""")
def _(spark, d):
    docs = table(spark, d, "documents").where("source IS NOT NULL")
    due = docs.select("source").distinct().withColumn("lang", F.explode(F.array(*[F.lit(x) for x in ("en", "zh", "de", "fr", "es")])))
    seen = docs.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return due.join(seen, ["source", "lang"], "left").select("source", "lang", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("covered"))


@R.add("h20_two_stage_resolution", f"""
    SELECT a.source_id, CASE WHEN b.d IS NULL THEN 'unreviewed' WHEN a.d = b.d THEN 'confirmed' WHEN b.d = 'pending_review' THEN 'deferred' ELSE 'overruled' END AS resolution FROM {_ONE.format('orrin-3')} a LEFT JOIN {_ONE.format('yarrow-2')} b ON a.source_id = b.source_id""")
def _(spark, d):
    both = _two(spark, d).where("d1 IS NOT NULL")
    return both.select("source_id", F.when(F.col("d2").isNull(), "unreviewed").when(F.col("d1") == F.col("d2"), "confirmed").when(F.col("d2") == "pending_review", "deferred").otherwise("overruled").alias("resolution"))


@R.add("i04_delta_assembly", "SELECT user_id, string_agg(event_type, '>' ORDER BY ts, event_id) AS stream, count(*) AS deltas FROM events WHERE event_type <> 'error' GROUP BY user_id")
def _(spark, d):
    from factaudit.operators.reports import assemble

    return assemble(table(spark, d, "events").where("event_type <> 'error'"), "user_id", ["ts", "event_id"], "event_type", ">")


@R.add("i10_generation_labels", """
    SELECT audit_record_id, CASE WHEN trim(answer) = '' THEN false WHEN n = 1 THEN true END AS correct FROM (SELECT audit_record_id, answer, len(list_filter(list_distinct(list_transform(coalesce(answer_aliases, []), lambda x: regexp_replace(lower(x), '[^\\p{L}\\p{N}]', '', 'g'))), lambda x: x = regexp_replace(lower(answer), '[^\\p{L}\\p{N}]', '', 'g'))) AS n FROM audit_records)""")
def _(spark, d):
    from factaudit.functions.text import alnum_key

    groups = F.array_distinct(F.transform(F.coalesce("answer_aliases", F.array().cast("array<string>")), lambda x: alnum_key(x, F.lower)))
    n = F.size(F.filter(groups, lambda x: x == alnum_key(F.col("answer"), F.lower)))
    return table(spark, d, "audit_records").select("audit_record_id", F.when(F.trim("answer") == "", False).when(n == 1, True).alias("correct"))


@R.add("i12_tumbling_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(spark, d):
    from factaudit.streaming.events import windowed_counts

    return windowed_counts(table(spark, d, "events"), "1 hour", watermark=None)
