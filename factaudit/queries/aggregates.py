"""Grouping and aggregation over model results, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factaudit.operators import arrays, evaluation, ledger
from factaudit.operators.prefix import percentiles, running_sum
from factaudit.queries.registry import Registry
from factaudit.session import cut, table

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql

# One result per annotation: the model answered item by item; "keep" is a correct answer, null unknown.
_RESULTS = """(SELECT source_id AS fact, model_name AS model, split_part(source_id, '_', 2) AS lang, CASE WHEN canonical_decision IS NULL THEN NULL ELSE lower(trim(canonical_decision)) = 'keep' END AS correct, extraction_confidence AS confidence, packet_id, annotation_id FROM model_annotations)"""


def _results(spark, d):
    kept = F.lower(F.trim("canonical_decision")) == "keep"
    return table(spark, d, "model_annotations").select(
        F.col("source_id").alias("fact"), F.col("model_name").alias("model"), F.split("source_id", "_")[1].alias("lang"), kept.alias("correct"), F.col("extraction_confidence").alias("confidence"), "packet_id", "annotation_id")


@R.add("e01_score_sums", f"SELECT lang, model, sum(CASE WHEN correct THEN 1 ELSE 0 END)::BIGINT AS score, count(correct) AS completed, count(*) AS total FROM {_RESULTS} GROUP BY lang, model")
def _(spark, d):
    return _results(spark, d).groupBy("lang", "model").agg(F.count_if("correct").alias("score"), F.count("correct").alias("completed"), F.count(F.lit(1)).alias("total"))


@R.add("e02_legacy_scores", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k')::DOUBLE ELSE value END AS score FROM events")
def _(spark, d):
    nested = F.get_json_object("props", "$.k").try_cast("double")
    return table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, nested).otherwise(F.col("value")).alias("score"))


@R.add("e03_panel_rate", f"SELECT fact, round(coalesce(avg(CASE WHEN correct IS NOT NULL THEN correct::INT::DOUBLE END), 0.0), 6) AS rate FROM {_RESULTS} GROUP BY fact")
def _(spark, d):
    return _results(spark, d).groupBy("fact").agg(F.round(evaluation.panel_rate(F.col("correct").cast("int"), F.col("correct").isNotNull()), 6).alias("rate"))


_LANGS = ["mkqa", "mmlu", "msqa", "openbook", "legacy", "pitfall"]


@R.add("e04_accuracy_pivot", "SELECT model, " + ", ".join(f"round(100.0 * sum(CASE WHEN lang = '{x}' AND correct THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN lang = '{x}' THEN 1 ELSE 0 END), 0), 4) AS {x}" for x in _LANGS) + f" FROM {_RESULTS} GROUP BY model")
def _(spark, d):
    pivoted = _results(spark, d).groupBy("model").pivot("lang", _LANGS).agg(F.try_divide(100.0 * F.count_if("correct"), F.count(F.lit(1)).cast("double")))
    return pivoted.select("model", *[F.round(x, 4).alias(x) for x in _LANGS])


@R.add("e05_questions_per_file", "SELECT input_path, count(*) AS questions, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM audit_records GROUP BY input_path")
def _(spark, d):
    counted = table(spark, d, "audit_records").groupBy("input_path").agg(F.count(F.lit(1)).alias("questions"))
    total = counted.agg(F.sum("questions").alias("all"))
    return counted.crossJoin(F.broadcast(total)).select("input_path", "questions", F.round(F.col("questions") / F.col("all"), 6).alias("share"))


@R.add("e06_counters", """
    SELECT 'decision' AS counter, coalesce(decision, '-') AS item, count(*) AS n FROM normalized_candidates GROUP BY 1, 2 UNION ALL SELECT 'conflict', f, count(*) FROM (SELECT unnest(field_conflicts) AS f FROM model_annotations) GROUP BY 1, 2""")
def _(spark, d):
    decisions = table(spark, d, "normalized_candidates").groupBy(F.coalesce("decision", F.lit("-")).alias("item")).agg(F.count(F.lit(1)).alias("n"))
    conflicts = table(spark, d, "model_annotations").select(F.explode("field_conflicts").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    return decisions.select(F.lit("decision").alias("counter"), "item", "n").unionByName(conflicts.select(F.lit("conflict").alias("counter"), "item", "n"))


@R.add("e07_relation_inventory", """
    WITH g AS (SELECT lower(trim(relation_id)) AS relation, count(*) AS n, count(DISTINCT subject) AS subjects, min(line_number) AS first_line, arg_min(answer, line_number) AS first_answer,
      array_to_string(list_slice(list(answer ORDER BY line_number) FILTER (answer IS NOT NULL), 1, 3), '|') AS examples FROM normalized_candidates WHERE relation_id IS NOT NULL GROUP BY 1)
    SELECT *, row_number() OVER (ORDER BY n DESC, relation) AS place FROM g""")
def _(spark, d):
    from factaudit.operators.facts import relation_inventory

    return relation_inventory(table(spark, d, "normalized_candidates").where("relation_id IS NOT NULL"), F.lower(F.trim("relation_id")), "subject", "answer", "line_number", 3)


@R.add("e08_mapping_coverage", """
    WITH s AS (SELECT relation_id, count(*) AS n FROM normalized_candidates WHERE relation_id IS NOT NULL GROUP BY 1), m AS (SELECT s.*, CASE WHEN c.relation_id IS NULL THEN 'out' ELSE 'mapped' END AS status FROM s LEFT JOIN relation_catalog c USING (relation_id))
    SELECT status, count(*) AS signatures, sum(n)::BIGINT AS records, round(count(*)::DOUBLE / (SELECT count(*) FROM m), 6) AS signature_share, round(sum(n)::DOUBLE / (SELECT sum(n) FROM m), 6) AS record_share FROM m GROUP BY status""")
def _(spark, d):
    signatures = table(spark, d, "normalized_candidates").where("relation_id IS NOT NULL").groupBy("relation_id").agg(F.count(F.lit(1)).alias("n"))
    known = table(spark, d, "relation_catalog").select("relation_id", F.lit("mapped").alias("status"))
    out = signatures.join(known, "relation_id", "left").groupBy(F.coalesce("status", F.lit("out")).alias("status")).agg(F.count(F.lit(1)).alias("signatures"), F.sum("n").alias("records"))
    whole = out.agg(F.sum("signatures").alias("s"), F.sum("records").alias("r"))
    return out.crossJoin(F.broadcast(whole)).select("status", "signatures", "records", F.round(F.col("signatures") / F.col("s"), 6).alias("signature_share"), F.round(F.col("records") / F.col("r"), 6).alias("record_share"))


@R.add("e09_fact_clustering", """
    SELECT base_fact_id, count(*) AS members, count(DISTINCT coalesce(split_group_id, '<null>')) AS groups, count(DISTINCT answer_normalized) > 1 AS conflict, arg_min(audit_record_id, (CASE WHEN split_assignment IS NULL THEN 1 ELSE 0 END, length(question), audit_record_id)) AS representative,
      (SELECT string_agg(DISTINCT a, '|' ORDER BY a) FROM audit_records r, unnest(r.answer_aliases) t(a) WHERE r.base_fact_id = o.base_fact_id) AS aliases FROM audit_records o GROUP BY base_fact_id""")
def _(spark, d):
    from factaudit.operators.facts import cluster

    return cluster(table(spark, d, "audit_records"))


@R.add("e10_baseline_inconsistency", f"SELECT fact, model, count(DISTINCT correct) AS outcomes FROM {_RESULTS} GROUP BY fact, model HAVING count(DISTINCT correct) > 1")
def _(spark, d):
    return _results(spark, d).groupBy("fact", "model").agg(F.count_distinct("correct").alias("outcomes")).where("outcomes > 1")


@R.add("e11_fully_simulated", f"SELECT fact FROM {_RESULTS} WHERE model IN ('tassel-lite', 'orrin-3', 'brome-mini') AND correct IS NOT NULL GROUP BY fact HAVING count(DISTINCT model) = 3")
def _(spark, d):
    from factaudit.operators.facts import complete

    rows = _results(spark, d).where("correct IS NOT NULL")
    expected = spark.createDataFrame([("tassel-lite",), ("orrin-3",), ("brome-mini",)], "model string")
    return complete(rows, "fact", "model", expected)


@R.add("e12_run_summary", f"""
    SELECT coalesce(model, '<all>') AS model, count(*) AS attempts, sum(CASE WHEN correct IS NULL THEN 1 ELSE 0 END)::BIGINT AS failures, round(avg(confidence), 6) AS mean_confidence, max(confidence) AS max_confidence,
      CASE WHEN avg(CASE WHEN correct IS NULL THEN 1.0 ELSE 0 END) > 0.02 THEN 'failure_rate' END AS gate FROM {_RESULTS} GROUP BY ROLLUP (model)""")
def _(spark, d):
    out = _results(spark, d).rollup("model").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("correct").isNull()).alias("failures"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.max("confidence").alias("max_confidence"))
    return out.select(F.coalesce("model", F.lit("<all>")).alias("model"), "attempts", "failures", "mean_confidence", "max_confidence", F.when(F.col("failures") / F.col("attempts") > 0.02, "failure_rate").alias("gate"))


# Three arms per user: views stand for the original, clicks for the neutral, purchases for the targeted arm.
_ARMS = """(SELECT user_id AS fact, event_id % 3 AS model, bool_or(CASE WHEN event_type = 'view' THEN value > 50 END) AS original, bool_or(CASE WHEN event_type = 'click' THEN value > 50 END) AS neutral, bool_or(CASE WHEN event_type = 'purchase' THEN value > 50 END) AS targeted
  FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1, 2)"""


def _arms(spark, d):
    rows = table(spark, d, "events").where("event_type IN ('view', 'click', 'purchase')").withColumn("hit", F.col("value") > 50).withColumn("model", F.col("event_id") % 3)
    return evaluation.arms(rows.withColumnRenamed("user_id", "fact"), ["fact", "model"], "event_type", ["view", "click", "purchase"], "hit").toDF("fact", "model", "original", "neutral", "targeted")


@R.add("e13_three_arm_analysis", f"""
    SELECT model, count(*) AS cells, sum((original AND neutral AND NOT targeted)::INT)::BIGINT AS directed, sum((original <> neutral)::INT)::BIGINT AS unstable, round(avg(original::INT), 6) AS original_rate, round(avg(neutral::INT), 6) AS neutral_rate, round(avg(targeted::INT), 6) AS targeted_rate
    FROM {_ARMS} WHERE original IS NOT NULL AND neutral IS NOT NULL AND targeted IS NOT NULL GROUP BY model""")
def _(spark, d):
    whole = _arms(spark, d).where("original IS NOT NULL AND neutral IS NOT NULL AND targeted IS NOT NULL")
    rate = lambda c: F.round(F.avg(F.col(c).cast("int")), 6).alias(f"{c}_rate")
    return whole.groupBy("model").agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.expr("original AND neutral AND NOT targeted")).alias("directed"), F.count_if(F.expr("original <> neutral")).alias("unstable"), rate("original"), rate("neutral"), rate("targeted"))


_CELLS = "(SELECT user_id, CASE WHEN event_id % 2 = 0 THEN 'en' ELSE 'zh' END || '_' || CASE event_type WHEN 'view' THEN 'original' WHEN 'click' THEN 'neutral' WHEN 'purchase' THEN 'targeted' END AS cell, value >= 20 AS correct FROM events WHERE event_type IN ('view', 'click', 'purchase') AND value IS NOT NULL)"


@R.add("e14_candidate_freeze", f"""
    WITH a AS (PIVOT (SELECT user_id, cell, avg(correct::INT) AS acc FROM {_CELLS} GROUP BY 1, 2) ON cell IN ('en_original', 'en_neutral', 'en_targeted', 'zh_original', 'zh_neutral', 'zh_targeted') USING first(acc) GROUP BY user_id),
    f AS (SELECT *, least(zh_original, zh_neutral) AS floor FROM a WHERE en_original IS NOT NULL AND en_neutral IS NOT NULL AND en_targeted IS NOT NULL AND zh_original IS NOT NULL AND zh_neutral IS NOT NULL AND zh_targeted IS NOT NULL)
    SELECT user_id, CASE WHEN floor = 1.0 AND zh_targeted < 1.0 THEN 'induced' ELSE 'amplified' END AS badcase FROM f WHERE en_targeted >= 0.5 AND ((floor = 1.0 AND zh_targeted < 1.0) OR (floor < 1.0 AND zh_targeted < floor))""")
def _(spark, d):
    kind = F.create_map(*[F.lit(x) for x in ("view", "original", "click", "neutral", "purchase", "targeted")])[F.col("event_type")]
    cells = table(spark, d, "events").where("value IS NOT NULL").select("user_id", F.when(F.col("event_id") % 2 == 0, "en").otherwise("zh").alias("language"), kind.alias("variant"), (F.col("value") >= 20).alias("correct"))
    return evaluation.frozen_candidates(cells.where("variant IS NOT NULL"), "user_id", 0.5)



@R.add("e15_open_defect_labels", f"SELECT fact, model, (original AND NOT targeted) AS directed, (NOT original OR NOT neutral OR NOT targeted) AS any_defect, (NOT original) AS baseline, (original <> neutral) AS unstable FROM {_ARMS}")
def _(spark, d):
    return _arms(spark, d).selectExpr("fact", "model", "(original AND NOT targeted) AS directed", "(NOT original OR NOT neutral OR NOT targeted) AS any_defect", "(NOT original) AS baseline", "(original <> neutral) AS unstable")


@R.add("e16_fact_weighted_mean", f"SELECT model, round(avg(m), 6) AS mean, count(*) AS facts FROM (SELECT model, fact, avg(confidence) AS m FROM {_RESULTS} GROUP BY 1, 2) GROUP BY model")
def _(spark, d):
    out = evaluation.fact_weighted(_results(spark, d), ["model"], "fact", F.col("confidence"), "mean")
    return out.withColumn("mean", F.round("mean", 6))


@R.add("e17_adjudicated_accuracy", f"SELECT model, round(avg(m), 6) AS accuracy, count(*) AS facts FROM (SELECT model, fact, avg(correct::INT) AS m FROM {_RESULTS} GROUP BY 1, 2 HAVING count(*) = count(correct)) GROUP BY model")
def _(spark, d):
    rows = _results(spark, d).withColumn("v", F.col("correct").cast("int"))
    return evaluation.adjudicated_only(rows, ["model"], "fact", "v", "accuracy").withColumn("accuracy", F.round("accuracy", 6))


@R.add("e18_retention_harm", f"""
    WITH b AS (SELECT fact, bool_or(correct) AS before FROM {_RESULTS} WHERE model = 'orrin-3' GROUP BY fact), a AS (SELECT fact, bool_or(correct) AS after FROM {_RESULTS} WHERE model = 'veld-xl' GROUP BY fact)
    SELECT count(*) AS facts, sum((before IS TRUE AND after IS TRUE)::INT)::BIGINT AS retained, sum((before IS TRUE AND after IS FALSE)::INT)::BIGINT AS harmed, sum((before IS TRUE AND after IS NULL)::INT)::BIGINT AS unknown, sum((before IS NOT TRUE AND after IS TRUE)::INT)::BIGINT AS gained FROM b JOIN a USING (fact)""")
def _(spark, d):
    one = lambda m, n: _results(spark, d).where(F.col("model") == m).groupBy("fact").agg(F.bool_or("correct").alias(n))
    both = one("orrin-3", "before").join(one("veld-xl", "after"), "fact")
    count = lambda e, n: F.count_if(F.expr(e)).alias(n)
    return both.agg(F.count(F.lit(1)).alias("facts"), count("before IS TRUE AND after IS TRUE", "retained"), count("before IS TRUE AND after IS FALSE", "harmed"), count("before IS TRUE AND after IS NULL", "unknown"), count("before IS NOT TRUE AND after IS TRUE", "gained"))


@R.add("e19_contingency", f"""
    WITH p AS (SELECT fact, CASE WHEN bool_or(correct) THEN 'yes' WHEN count(*) > count(correct) THEN 'unknown' ELSE 'no' END AS x FROM {_RESULTS} WHERE model = 'hask-1' GROUP BY fact), q AS (SELECT fact, CASE WHEN bool_or(correct) THEN 'yes' WHEN count(*) > count(correct) THEN 'unknown' ELSE 'no' END AS y FROM {_RESULTS} WHERE model = 'pelt-9' GROUP BY fact)
    SELECT x, y, count(*) AS n FROM p JOIN q USING (fact) GROUP BY x, y""")
def _(spark, d):
    state = lambda n: F.when(F.bool_or("correct"), "yes").when(F.count(F.lit(1)) > F.count("correct"), "unknown").otherwise("no").alias(n)
    p = _results(spark, d).where("model = 'hask-1'").groupBy("fact").agg(state("x"))
    q = _results(spark, d).where("model = 'pelt-9'").groupBy("fact").agg(state("y"))
    return p.join(q, "fact").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


_LAST = "(SELECT source_id, lower(trim(arg_max(canonical_decision, (created_at, annotation_id)))) = 'keep' AS x FROM model_annotations WHERE model_name = '{}' AND canonical_decision IS NOT NULL GROUP BY 1)"


@R.add("e20_block_bootstrap", f"""
    WITH g AS (SELECT regexp_extract(a.source_id, '^raw_(.*)_[0-9]+$', 1) AS block, a.x::INT - b.x::INT AS gain FROM {_LAST.format('orrin-3')} a JOIN {_LAST.format('yarrow-2')} b USING (source_id)),
    b AS (SELECT block, count(*) AS n, sum(gain)::DOUBLE AS s, row_number() OVER (ORDER BY block) - 1 AS i FROM g GROUP BY 1),
    k AS (SELECT count(*) AS k FROM b), picks AS (SELECT r AS draw, j, (('0x' || substr(sha256(r::VARCHAR || '␟' || j::VARCHAR), 1, 12))::BIGINT % k) AS i FROM range(0, 2000) t(r), k, range(0, 50) u(j) WHERE j < k),
    d AS (SELECT draw, sum(s) / sum(n) AS m FROM picks JOIN b USING (i) GROUP BY draw), o AS (SELECT m, row_number() OVER (ORDER BY m) AS rn FROM d)
    SELECT (SELECT sum(n) FROM b)::BIGINT AS facts, (SELECT k FROM k) AS components, (SELECT count(*) FROM d) AS draws, round(max(CASE WHEN rn = 50 THEN m END), 9) AS low, round(max(CASE WHEN rn = 1950 THEN m END), 9) AS high FROM o""")
def _(spark, d):
    from factaudit.operators.bootstrap import block_bootstrap

    def last(model, name):
        rows = table(spark, d, "model_annotations").where((F.col("model_name") == model) & F.col("canonical_decision").isNotNull())
        return rows.groupBy("source_id").agg((F.lower(F.trim(F.max_by("canonical_decision", F.struct("created_at", "annotation_id")))) == "keep").cast("int").alias(name))

    gains = last("orrin-3", "a").join(last("yarrow-2", "b"), "source_id").select(F.regexp_extract("source_id", "^raw_(.*)_[0-9]+$", 1).alias("block"), (F.col("a") - F.col("b")).alias("gain"))
    return block_bootstrap(gains, "block", "gain", 2000)



@R.add("e21_layer_vector_means", """
    WITH v AS (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings), m AS (SELECT label, pos, avg(x::DOUBLE) AS m FROM v GROUP BY 1, 2)
    SELECT a.pos::INT AS pos, round(a.m - b.m, 5) AS contrast FROM m a JOIN m b ON a.pos = b.pos AND a.label = 0 AND b.label = 1""")
def _(spark, d):
    # Means are kept as rows (label, position): a vector of any width stays distributed.
    v = table(spark, d, "embeddings").where("label IN (0, 1)").select("label", F.posexplode("embedding").alias("pos", "x"))
    m = v.groupBy("pos").agg(F.avg(F.when(F.col("label") == 0, F.col("x").cast("double"))).alias("a"), F.avg(F.when(F.col("label") == 1, F.col("x").cast("double"))).alias("b"))
    return m.select("pos", F.round(F.col("a") - F.col("b"), 5).alias("contrast"))


@R.add("e22_length_distribution", """
    SELECT lang, count(*) AS n, min(n_chars) AS least, quantile_cont(n_chars::DOUBLE, 0.25) AS p25, quantile_cont(n_chars::DOUBLE, 0.5) AS median, quantile_cont(n_chars::DOUBLE, 0.95) AS p95, max(n_chars) AS most, round(avg(n_chars), 6) AS mean, sum((n_chars > 1000)::INT)::BIGINT AS above FROM documents WHERE lang IS NOT NULL AND n_chars IS NOT NULL GROUP BY lang""")
def _(spark, d):
    rows = table(spark, d, "documents").where("lang IS NOT NULL AND n_chars IS NOT NULL").select("lang", "n_chars")
    whole = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.round(F.avg("n_chars"), 6).alias("mean"), F.count_if(F.col("n_chars") > 1000).alias("above"))
    return whole.join(percentiles(rows, ["lang"], "n_chars", {"p25": 0.25, "median": 0.5, "p95": 0.95}), "lang")


@R.add("e23_discovery_ledger", """
    SELECT event_type, count(*) AS requests, count(DISTINCT user_id) AS facts, CASE WHEN count(*) = count(json_extract_string(props, '$.k')) THEN sum(json_extract_string(props, '$.k')::BIGINT) END::BIGINT AS tokens, round(100.0 * count(DISTINCT user_id) / count(*), 6) AS per_100 FROM events GROUP BY event_type""")
def _(spark, d):
    rows = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("bigint"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("requests"), F.count_distinct("user_id").alias("facts"), ledger.total_if_all_known(F.col("k")).alias("tokens"), F.round(100.0 * F.count_distinct("user_id") / F.count(F.lit(1)), 6).alias("per_100"))


@R.add("e24_cross_split_violations", "SELECT key_kind, count(*) AS groups, sum(n)::BIGINT AS records FROM (" + " UNION ALL ".join(
    f"SELECT '{k}' AS key_kind, {k} AS v, count(*) AS n FROM audit_records WHERE split_assignment IS NOT NULL AND {k} IS NOT NULL GROUP BY {k} HAVING count(DISTINCT split_assignment) > 1" for k in ("question_normalized", "canonical_fact_normalized", "source_id", "base_fact_id", "split_group_id")) + ") GROUP BY key_kind")
def _(spark, d):
    # All kinds of key in one pass: rows are unpivoted, then grouped once.
    kinds = ["question_normalized", "canonical_fact_normalized", "source_id", "base_fact_id", "split_group_id"]
    rows = table(spark, d, "audit_records").where("split_assignment IS NOT NULL").select("split_assignment", F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in kinds]), F.array(*kinds))).alias("key_kind", "v")).where("v IS NOT NULL")
    broken = rows.groupBy("key_kind", "v").agg(F.count(F.lit(1)).alias("n"), F.min("split_assignment").alias("a"), F.max("split_assignment").alias("b")).where("a <> b")
    return broken.groupBy("key_kind").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("records"))


@R.add("e25_component_sizes", "SELECT members, count(*) AS components FROM (SELECT split_group_id, count(*) AS members FROM audit_records WHERE split_group_id IS NOT NULL GROUP BY 1) GROUP BY members")
def _(spark, d):
    sizes = table(spark, d, "audit_records").where("split_group_id IS NOT NULL").groupBy("split_group_id").agg(F.count(F.lit(1)).alias("members"))
    return sizes.groupBy("members").agg(F.count(F.lit(1)).alias("components"))


@R.add("e26_rate_pairs", f"""
    WITH r AS (SELECT fact, round(avg(CASE WHEN model < 'n' THEN correct::INT END), 1) AS rate_a, round(avg(CASE WHEN model >= 'n' THEN correct::INT END), 1) AS rate_b FROM {_RESULTS} GROUP BY fact)
    SELECT rate_a, rate_b, count(*) AS n, bool_and(rate_b <= 0.4) AS all_weak FROM r WHERE rate_a IS NOT NULL AND rate_b IS NOT NULL GROUP BY 1, 2""")
def _(spark, d):
    side = lambda e: F.round(F.avg(F.when(F.expr(e), F.col("correct").cast("int"))), 1)
    r = _results(spark, d).groupBy("fact").agg(side("model < 'n'").alias("rate_a"), side("model >= 'n'").alias("rate_b")).where("rate_a IS NOT NULL AND rate_b IS NOT NULL")
    return r.groupBy("rate_a", "rate_b").agg(F.count(F.lit(1)).alias("n"), F.every(F.col("rate_b") <= 0.4).alias("all_weak"))


@R.add("e27_token_usage", "SELECT event_type, event_id, sum(json_extract_string(props, '$.k')::BIGINT) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS tokens_so_far FROM events")
def _(spark, d):
    rows = table(spark, d, "events").select("event_type", "event_id", "ts", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return running_sum(rows, ["event_type"], [F.asc("ts"), F.asc("event_id")], F.col("k"), "tokens_so_far").select("event_type", "event_id", "tokens_so_far")


@R.add("e29_natural_gap", f"""
    WITH p AS (SELECT fact, bool_or(CASE WHEN model = 'orrin-3' THEN correct END) AS en, bool_or(CASE WHEN model = 'sorrel-4' THEN correct END) AS zh FROM {_RESULTS} GROUP BY fact)
    SELECT fact, coalesce(en AND NOT zh, false) AS gap, coalesce(NOT en, false) AS en_failure, en IS NOT NULL AND zh IS NOT NULL AS eligible FROM p""")
def _(spark, d):
    p = _results(spark, d).groupBy("fact").agg(F.bool_or(F.when(F.col("model") == "orrin-3", F.col("correct"))).alias("en"), F.bool_or(F.when(F.col("model") == "sorrel-4", F.col("correct"))).alias("zh"))
    return p.selectExpr("fact", "coalesce(en AND NOT zh, false) AS gap", "coalesce(NOT en, false) AS en_failure", "en IS NOT NULL AND zh IS NOT NULL AS eligible")


@R.add("e30_throughput", """
    SELECT event_id % 4 AS level, count(*) AS requests, sum((event_type <> 'error')::INT)::BIGINT AS successes, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(60.0 * sum((event_type <> 'error')::INT) / nullif(sum(value), 0), 6) AS per_minute FROM events GROUP BY 1""")
def _(spark, d):
    ok = F.count_if(F.col("event_type") != "error")
    rows = table(spark, d, "events").withColumn("level", F.col("event_id") % 4)
    whole = rows.groupBy("level").agg(F.count(F.lit(1)).alias("requests"), ok.alias("successes"), F.round(F.try_divide(60.0 * ok, F.sum("value")), 6).alias("per_minute"))
    found = percentiles(rows.select("level", "value"), ["level"], "value", {"median": 0.5, "p95": 0.95}).select("level", F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"))
    return whole.join(found, "level", "left")


@R.add("e31_config_screen", """
    WITH g AS (SELECT p_brand AS family, p_type AS spec, p_size AS layer, avg(gain) AS gain FROM (SELECT p_brand, p_type, p_size, p_partkey % 50 AS fact, avg(p_retailprice) AS gain FROM part GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)
    SELECT family, arg_min(spec, (-round(gain, 6), layer, spec)) AS spec, round(max(gain), 6) AS gain FROM g GROUP BY family""")
def _(spark, d):
    rows = table(spark, d, "part").withColumn("fact", F.col("p_partkey") % 50)
    g = evaluation.fact_weighted(rows, ["p_brand", "p_type", "p_size"], "fact", F.col("p_retailprice"), "gain")
    return g.groupBy(F.col("p_brand").alias("family")).agg(F.min_by("p_type", F.struct(-F.round("gain", 6), "p_size", "p_type")).alias("spec"), F.round(F.max("gain"), 6).alias("gain"))


@R.add("e32_direction_norms", """
    WITH x AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS pos, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings WHERE label IS NOT NULL),
    m AS (SELECT label, pos, avg(v) AS mean FROM x GROUP BY 1, 2), o AS (SELECT pos, avg(v) AS mean FROM x GROUP BY 1), d AS (SELECT m.label, m.pos, m.mean - o.mean AS delta FROM m JOIN o USING (pos)),
    s AS (SELECT label, sqrt(sum(delta * delta)) AS norm FROM d GROUP BY 1), q AS (SELECT label, quantile_cont(norm, 0.5) AS median FROM (SELECT DISTINCT label, vec_id, norm FROM x) GROUP BY 1)
    SELECT d.label, d.pos::INT AS pos, round(delta * median / s.norm, 5) AS value FROM d JOIN s USING (label) JOIN q USING (label) WHERE s.norm >= 1e-8""")
def _(spark, d):
    """Each label's direction: its mean less the mean of all, at the median length of the label's vectors."""
    rows = table(spark, d, "embeddings").where("label IS NOT NULL").select("label", "embedding")
    each = rows.select("label", F.posexplode("embedding").alias("pos", "v")).groupBy("label", "pos").agg(F.sum(F.col("v").cast("double")).alias("s"), F.count("v").alias("n"))
    each = cut(each)
    whole = each.groupBy("pos").agg((F.sum("s") / F.sum("n")).alias("all"))
    delta = each.join(whole, "pos").select("label", "pos", (F.col("s") / F.col("n") - F.col("all")).alias("delta"))
    lengths = delta.groupBy("label").agg(F.sqrt(F.sum(F.col("delta") * F.col("delta"))).alias("norm")).where("norm >= 1e-8")
    median = percentiles(rows.select("label", arrays.l2_norm(F.col("embedding")).alias("x")), ["label"], "x", {"median": 0.5})
    return delta.join(lengths, "label").join(median, "label").select("label", "pos", F.round(F.col("delta") * F.col("median") / F.col("norm"), 5).alias("value"))



@R.add("e33_replicate_confirmation", f"""
    SELECT fact, count(*) AS runs, count(DISTINCT correct) <= 1 AND count(correct) = count(*) AS confirmed FROM {_RESULTS} WHERE model = 'tassel-lite' GROUP BY fact HAVING count(*) > 1""")
def _(spark, d):
    rows = _results(spark, d).where("model = 'tassel-lite'").groupBy("fact").agg(F.count(F.lit(1)).alias("runs"), F.count_distinct("correct").alias("kinds"), F.count("correct").alias("known"))
    return rows.where("runs > 1").selectExpr("fact", "runs", "kinds <= 1 AND known = runs AS confirmed")
