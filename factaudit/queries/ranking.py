"""Allocation, sampling, ranking and top-k, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factaudit.functions import ids
from factaudit.operators import evaluation, ranking
from factaudit.queries.registry import Registry
from factaudit.session import table

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql


def _strata(spark, d):
    return table(spark, d, "raw_candidates").groupBy(F.col("source_snapshot.dataset").alias("dataset")).agg(F.count(F.lit(1)).alias("n"))


_STRATA = "(SELECT source_snapshot.dataset AS dataset, count(*) AS n FROM raw_candidates GROUP BY 1)"


@R.add("f01_largest_remainder", f"""
    WITH s AS (SELECT dataset, 500 * n / (SELECT sum(n) FROM {_STRATA})::DOUBLE AS exact FROM {_STRATA}), r AS (SELECT *, floor(exact) AS fl, row_number() OVER (ORDER BY round(exact - floor(exact), 9) DESC, dataset) AS rn FROM s)
    SELECT dataset, (fl + (rn <= 500 - (SELECT sum(fl) FROM r))::INT)::BIGINT AS allocated FROM r""")
def _(spark, d):
    return ranking.largest_remainder(_strata(spark, d), "dataset", "n", 500)


@R.add("f02_balanced_allocation", f"WITH r AS (SELECT dataset, unnest(range(1, least(n, 120)::BIGINT + 1)) AS rnd FROM {_STRATA}), k AS (SELECT *, row_number() OVER (ORDER BY rnd, dataset) AS rn FROM r) SELECT dataset, count(*) AS allocated FROM k WHERE rn <= 120 GROUP BY dataset")
def _(spark, d):
    return ranking.balanced_allocation(_strata(spark, d), "dataset", "n", 120)


@R.add("f03_round_robin", "SELECT audit_record_id, source_dataset, row_number() OVER (PARTITION BY source_dataset ORDER BY line_number) AS turn FROM audit_records")
def _(spark, d):
    out = ranking.round_robin(table(spark, d, "audit_records"), "source_dataset", [F.asc("line_number")])
    return out.select("audit_record_id", "source_dataset", F.col("turn").cast("bigint").alias("turn"))


@R.add("f04_stratified_sample", "SELECT stratum, line_number FROM raw_candidates WHERE stratum IS NOT NULL QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY sha256('42␟sample␟' || line_number), line_number) <= 10")
def _(spark, d):
    rows = table(spark, d, "raw_candidates").where("stratum IS NOT NULL")
    return ranking.stratified_sample(rows, "stratum", 10, ids.hash_rank("42", "sample", F.col("line_number")), "line_number").select("stratum", "line_number")


@R.add("f04_seeded_sample")
def _(spark, d):
    return ranking.seeded_sample(table(spark, d, "raw_candidates"), "stratum", "candidate_id", 10, 42)


@R.add("f05_hash_round_robin", """
    WITH r AS (SELECT audit_record_id, source_dataset, source_subset, row_number() OVER (PARTITION BY source_dataset, source_subset ORDER BY sha256(audit_record_id), audit_record_id) AS rn FROM audit_records)
    SELECT audit_record_id, rn FROM r ORDER BY rn, sha256(coalesce(source_dataset, '') || '␟' || coalesce(source_subset, '')), audit_record_id LIMIT 100""")
def _(spark, d):
    rows = ranking.round_robin(table(spark, d, "audit_records").withColumn("s", F.concat_ws("␟", F.coalesce("source_dataset", F.lit("")), F.coalesce("source_subset", F.lit("")))), "s", [F.sha2("audit_record_id", 256), F.col("audit_record_id")])
    return rows.orderBy("turn", F.sha2("s", 256), "audit_record_id").limit(100).select("audit_record_id", F.col("turn").cast("bigint").alias("rn"))


@R.add("f06_hash_sample", "SELECT audit_record_id, (SELECT count(*) / least(count(*), 200)::DOUBLE FROM audit_records) AS weight FROM audit_records ORDER BY sha256('9␟uniform␟' || audit_record_id), audit_record_id LIMIT 200")
def _(spark, d):
    return ranking.hash_sample(table(spark, d, "audit_records"), ids.hash_rank("9", "uniform", F.col("audit_record_id")), "audit_record_id", 200).select("audit_record_id", "weight")


@R.add("f07_risk_flag_round_robin", """
    WITH f AS (SELECT line_number, unnest(list_filter([CASE WHEN canonical_fact IS NULL THEN 'a_no_fact' END, CASE WHEN split_group_id IS NULL THEN 'b_no_group' END, CASE WHEN length(answer) > 60 THEN 'c_long' END], lambda x: x IS NOT NULL)) AS flag FROM audit_records),
    o AS (SELECT line_number, min(flag) AS flag FROM f GROUP BY line_number), r AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY sha256(line_number::VARCHAR), line_number) AS rn FROM o)
    SELECT line_number, flag FROM r ORDER BY rn, flag LIMIT 60""")
def _(spark, d):
    from factaudit.operators.validation import reasons

    rules = [("a_no_fact", F.col("canonical_fact").isNull()), ("b_no_group", F.col("split_group_id").isNull()), ("c_long", F.length("answer") > 60)]
    # An item with several flags is taken under its first.
    one = table(spark, d, "audit_records").select("line_number", F.get(reasons(rules), 0).alias("flag")).where("flag IS NOT NULL")
    return ranking.round_robin(one, "flag", [F.sha2(F.col("line_number").cast("string"), 256), F.col("line_number")]).orderBy("turn", "flag").limit(60).select("line_number", "flag")


@R.add("f08_nested_cyclic_sample", """
    WITH a AS (SELECT audit_record_id, source_dataset, source_subset, row_number() OVER (PARTITION BY source_dataset, source_subset ORDER BY audit_record_id) AS k FROM audit_records WHERE source_subset IS NOT NULL),
    b AS (SELECT *, row_number() OVER (PARTITION BY source_dataset ORDER BY k, source_subset, audit_record_id) AS t FROM a) SELECT audit_record_id, t FROM b ORDER BY t, source_dataset LIMIT 150""")
def _(spark, d):
    inner = ranking.round_robin(table(spark, d, "audit_records").where("source_subset IS NOT NULL").withColumn("s", F.concat_ws("␟", "source_dataset", "source_subset")), "s", [F.asc("audit_record_id")]).withColumnRenamed("turn", "k")
    outer = ranking.round_robin(inner, "source_dataset", [F.asc("k"), F.asc("source_subset"), F.asc("audit_record_id")])
    return outer.orderBy("turn", "source_dataset").limit(150).select("audit_record_id", F.col("turn").cast("bigint").alias("t"))


@R.add("f09_review_frame", """
    WITH g AS (SELECT *, row_number() OVER (PARTITION BY source_subset, split_assignment, split_group_id ORDER BY sha256(base_fact_id), audit_record_id) AS gr FROM audit_records WHERE split_assignment IS NOT NULL AND split_group_id IS NOT NULL AND NOT contains(lower(question), lower(answer)))
    SELECT source_subset, split_assignment, audit_record_id FROM g WHERE gr = 1 QUALIFY row_number() OVER (PARTITION BY source_subset, split_assignment ORDER BY sha256(base_fact_id), audit_record_id) <= 5""")
def _(spark, d):
    rows = table(spark, d, "audit_records").where("split_assignment IS NOT NULL AND split_group_id IS NOT NULL AND NOT contains(lower(question), lower(answer))")
    order = [F.sha2("base_fact_id", 256), F.col("audit_record_id")]
    one = ranking.top_per_group(rows, ["source_subset", "split_assignment", "split_group_id"], order, 1)
    return ranking.top_per_group(one, ["source_subset", "split_assignment"], order, 5).select("source_subset", "split_assignment", "audit_record_id")


@R.add("f10_per_source_choice", """
    SELECT source_id, arg_min(audit_record_id, (CASE WHEN record_role = 'current_bundle' THEN 0 ELSE 1 END, sha256(audit_record_id), audit_record_id)) AS chosen FROM audit_records GROUP BY source_id""")
def _(spark, d):
    rank = F.struct(F.when(F.col("record_role") == "current_bundle", 0).otherwise(1), F.sha2("audit_record_id", 256), "audit_record_id")
    return table(spark, d, "audit_records").groupBy("source_id").agg(F.min_by("audit_record_id", rank).alias("chosen"))


@R.add("f11_distractor_ranking", """
    WITH o AS (SELECT line_number, source_snapshot.record.answer AS a, unnest(source_snapshot.record.choices) AS c, unnest(range(len(source_snapshot.record.choices))) AS i FROM raw_candidates), s AS (SELECT *, levenshtein(a, c) AS dist FROM o WHERE a IS NOT NULL AND c <> a)
    SELECT line_number, arg_min(c, (dist, i)) AS distractor, min(dist) AS edits FROM s GROUP BY line_number""")
def _(spark, d):
    r = "source_snapshot.record."
    o = table(spark, d, "raw_candidates").select("line_number", F.col(r + "answer").alias("a"), F.posexplode(r + "choices").alias("i", "c")).where("a IS NOT NULL AND c <> a").withColumn("dist", F.levenshtein("a", "c").cast("bigint"))
    return o.groupBy("line_number").agg(F.min_by("c", F.struct("dist", "i")).alias("distractor"), F.min("dist").alias("edits"))


@R.add("f12_hash_threshold_split", """
    WITH h AS (SELECT audit_record_id, sha256('20260920' || '␟' || coalesce(answer_normalized, '')) AS h FROM audit_records), s AS (SELECT audit_record_id, (('0x' || substr(h, 1, 8))::BIGINT::HUGEINT * 4294967296 + ('0x' || substr(h, 9, 8))::BIGINT)::DOUBLE / 18446744073709551616.0::DOUBLE AS score FROM h)
    SELECT audit_record_id, round(score, 12) AS score, CASE WHEN score < 0.6::DOUBLE THEN 'development' WHEN score < 0.6::DOUBLE + 0.2::DOUBLE THEN 'validation' ELSE 'sealed' END AS split FROM s""")
def _(spark, d):
    score = ids.seeded_score("20260920", F.coalesce("answer_normalized", F.lit("")))
    return table(spark, d, "audit_records").select("audit_record_id", F.round(score, 12).alias("score"), ids.split_by_score(score, [("development", 0.6), ("validation", 0.2), ("sealed", 0.2)]).alias("split"))



@R.add("f13_first_occurrence", """
    WITH f AS (SELECT question_normalized, arg_min(audit_record_id, (record_role, line_number)) AS keep FROM audit_records WHERE question_normalized IS NOT NULL GROUP BY 1)
    SELECT a.audit_record_id, f.keep IS NULL OR f.keep = a.audit_record_id AS kept, CASE WHEN f.keep <> a.audit_record_id THEN f.keep END AS duplicate_of FROM audit_records a LEFT JOIN f USING (question_normalized)""")
def _(spark, d):
    return ranking.first_occurrence(table(spark, d, "audit_records"), "question_normalized", ["record_role", "line_number"], "audit_record_id")


@R.add("f13_latest_per_key", "SELECT source_id, model_name, arg_max(annotation_id, (created_at, annotation_id)) AS annotation_id FROM model_annotations GROUP BY 1, 2")
def _(spark, d):
    return evaluation.latest(table(spark, d, "model_annotations").select("source_id", "model_name", "annotation_id", "created_at"), ["source_id", "model_name"], ["created_at", "annotation_id"]).select("source_id", "model_name", "annotation_id")


@R.add("f14_argmax_margin", """
    WITH v AS (SELECT source_id, lower(trim(canonical_decision)) AS label, count(*) AS n FROM model_annotations WHERE canonical_decision IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY n DESC, label) AS rn FROM v)
    SELECT a.source_id, a.label AS best, coalesce(a.n = b.n, false) AS tied, a.n - b.n AS margin FROM (SELECT * FROM r WHERE rn = 1) a LEFT JOIN (SELECT * FROM r WHERE rn = 2) b USING (source_id)""")
def _(spark, d):
    votes = table(spark, d, "model_annotations").where("canonical_decision IS NOT NULL").groupBy("source_id", F.lower(F.trim("canonical_decision")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return ranking.argmax_with_margin(votes, ["source_id"], "label", "n")


@R.add("f15_beam_search")
def _(spark, d):
    """A search over wordings of the catalog's relations; a hash stands in for the models that answer."""
    from factaudit.operators.evaluation import reward
    from factaudit.plans.beam import beam_search

    start = table(spark, d, "relation_catalog").select(F.col("relation_definition").alias("question"), F.col("relation_id").alias("origin"))
    openings = spark.createDataFrame([("As recorded, ",), ("In the register, ",), ("By the survey, ",)], "opening string")

    def grow(queue):
        return queue.crossJoin(F.broadcast(openings)).select(F.concat("opening", "question").alias("question"), "origin")

    def evaluate(rows):
        digit = lambda salt, n: F.pmod(F.crc32(F.concat(F.lit(salt), "question").cast("binary")), F.lit(n)).cast("double")
        rated = rows.withColumn("rate_ori", F.when(digit("o", 5) > 0, 1.0).otherwise(0.8)).withColumn("rate_trans", digit("t", 6) / 5)
        return rated.withColumn("value", F.round(reward(F.col("rate_ori"), F.col("rate_trans")), 6))

    return beam_search(start, grow, evaluate, width=16, most_good=3)



@R.add("f16_batches", "WITH r AS (SELECT packet_id, annotation_id, row_number() OVER (PARTITION BY packet_id ORDER BY annotation_id) - 1 AS rn FROM model_annotations) SELECT packet_id, rn // 25 AS batch, count(*) AS n FROM r GROUP BY 1, 2")
def _(spark, d):
    return ranking.batches(table(spark, d, "model_annotations"), "packet_id", "annotation_id", 25).groupBy("packet_id", "batch").agg(F.count(F.lit(1)).alias("n"))


@R.add("f17_slot_choice", "SELECT record_id, arg_min(line_number, (attempt_number, line_number)) AS slot FROM normalized_candidates WHERE decision = 'ready' GROUP BY record_id")
def _(spark, d):
    return table(spark, d, "normalized_candidates").where("decision = 'ready'").groupBy("record_id").agg(F.min_by("line_number", F.struct("attempt_number", "line_number")).alias("slot"))


@R.add("f18_quota_scan", """
    WITH r AS (SELECT direction, line_number, CASE WHEN decision = 'defer' THEN NULL ELSE decision = 'ready' END AS ok FROM (SELECT coalesce(direction, 'none') AS direction, line_number, decision FROM normalized_candidates)),
    c AS (SELECT *, sum(coalesce(ok, false)::INT) OVER (PARTITION BY direction ORDER BY line_number ROWS UNBOUNDED PRECEDING) AS n FROM r)
    SELECT direction, sum(coalesce(ok, false)::INT)::BIGINT AS taken, bool_or(ok IS NULL) AS gap FROM c WHERE n < 30 OR (n = 30 AND coalesce(ok, false)) GROUP BY direction""")
def _(spark, d):
    ok = F.when(F.col("decision") == "defer", F.lit(None).cast("boolean")).otherwise(F.col("decision") == "ready")
    rows = table(spark, d, "normalized_candidates").select(F.coalesce("direction", F.lit("none")).alias("direction"), "line_number", ok.alias("ok"))
    return ranking.quota_scan(rows, "direction", "line_number", "ok", 30)
