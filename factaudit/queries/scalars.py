"""Scalar expressions over text, hashes and JSON, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factaudit.functions import ids, text
from factaudit.queries.registry import Registry, folded_sql
from factaudit.session import spread, table

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql


@R.add("b01_normalize_text", rf"SELECT doc_id, coalesce(trim(regexp_replace({folded_sql('text')}, '\s+', ' ', 'g')), '') AS normalized FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("normalized"))


@R.add("b02_casefold_exact", r"SELECT line_number, coalesce(trim(regexp_replace(replace(lower(source_snapshot.record.question), 'ß', 'ss'), '\s+', ' ', 'g')), '') AS folded FROM raw_candidates")
def _(spark, d):
    return table(spark, d, "raw_candidates").select("line_number", text.casefold_exact("source_snapshot.record.question").alias("folded"))


@R.add("b03_normalize_lexical", r"SELECT line_number, trim(regexp_replace(lower(question), '[^\p{L}\p{N}]+', ' ', 'g')) AS lexical FROM audit_records")
def _(spark, d):
    return table(spark, d, "audit_records").select("line_number", text.normalize_lexical(F.col("question")).alias("lexical"))


@R.add("b04_normalize_match_text", r"SELECT line_number, trim(regexp_replace(lower(relation_id), '[^\p{L}\p{N}_]+', ' ', 'g')) AS matched FROM normalized_candidates WHERE relation_id IS NOT NULL")
def _(spark, d):
    rows = table(spark, d, "normalized_candidates").where("relation_id IS NOT NULL")
    return rows.select("line_number", text.normalize_match_text(F.col("relation_id")).alias("matched"))


@R.add("b05_alnum_key", r"SELECT line_number, regexp_replace(lower(answer), '[^\p{L}\p{N}]', '', 'g') AS k FROM audit_records WHERE answer IS NOT NULL")
def _(spark, d):
    return table(spark, d, "audit_records").where("answer IS NOT NULL").select("line_number", text.alnum_key(F.col("answer")).alias("k"))


@R.add("b06_comparable_text", rf"SELECT line_number, regexp_replace(regexp_replace(coalesce(trim(regexp_replace({folded_sql('answer')}, '\s+', ' ', 'g')), ''), '^(a|an|the)\s+', ''), '[^a-z0-9]+', '', 'g') AS comparable FROM normalized_candidates")
def _(spark, d):
    return table(spark, d, "normalized_candidates").select("line_number", text.comparable_text(F.col("answer")).alias("comparable"))


@R.add("b07_clean_text", r"SELECT doc_id, nullif(trim(regexp_replace(text, '\s+', ' ', 'g')), '') AS cleaned FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


@R.add("b08_unique_strings", """
    WITH x AS (SELECT line_number, unnest(answer_aliases) AS a, unnest(range(len(answer_aliases))) AS pos FROM audit_records),
    k AS (SELECT *, row_number() OVER (PARTITION BY line_number, lower(trim(a, ' ')) ORDER BY pos) AS rn FROM x WHERE trim(a, ' ') <> '')
    SELECT line_number, string_agg(trim(a, ' '), '|' ORDER BY pos) AS aliases, count(*) AS n FROM k WHERE rn = 1 GROUP BY line_number""")
def _(spark, d):
    from factaudit.operators.arrays import unique_strings

    out = unique_strings(table(spark, d, "audit_records"), "line_number", "answer_aliases", "aliases")
    return out.select("line_number", F.array_join("aliases", "|").alias("aliases"), F.size("aliases").cast("bigint").alias("n"))


@R.add("b09_answer_aliases", """
    SELECT line_number, array_to_string(list_sort(list_distinct(list_filter(list_concat([trim(answer, ' ')], list_transform(coalesce(answer_aliases, []), lambda x: trim(x, ' '))), lambda x: x IS NOT NULL AND x <> ''))), '|') AS aliases FROM audit_records""")
def _(spark, d):
    everything = F.concat(F.array(F.trim("answer")), F.transform(F.coalesce("answer_aliases", F.array().cast("array<string>")), lambda x: F.trim(x)))
    named = F.array_sort(F.array_distinct(F.filter(everything, lambda x: x.isNotNull() & (x != ""))))
    return table(spark, d, "audit_records").select("line_number", F.array_join(named, "|").alias("aliases"))


@R.add("b10_first_filled", "SELECT line_number, coalesce(nullif(trim(canonical_fact), ''), nullif(trim(question), ''), nullif(trim(answer), '')) AS label FROM audit_records")
def _(spark, d):
    return table(spark, d, "audit_records").select("line_number", text.first_filled(F.col("canonical_fact"), F.col("question"), F.col("answer")).alias("label"))


@R.add("b11_stable_id", """
    SELECT line_number, 'pbf_' || substr(sha256(coalesce(lower(trim(subject)), '') || '␟' || coalesce(lower(trim(relation_id)), '') || '␟' || coalesce(lower(trim(answer)), '')), 1, 20) AS fact_id FROM normalized_candidates""")
def _(spark, d):
    parts = [F.lower(F.trim(c)) for c in ("subject", "relation_id", "answer")]
    return table(spark, d, "normalized_candidates").select("line_number", ids.stable_id("pbf_", *parts).alias("fact_id"))


@R.add("b12_hash_rank", """
    SELECT line_number, row_number() OVER (PARTITION BY source_dataset ORDER BY sha256('7␟review␟' || audit_record_id), line_number) AS hash_rank FROM audit_records""")
def _(spark, d):
    from factaudit.operators.prefix import row_number

    rows = table(spark, d, "audit_records").select("line_number", "source_dataset", ids.hash_rank("7", "review", F.col("audit_record_id")).alias("h"))
    return row_number(rows, ["source_dataset"], [F.asc("h"), F.asc("line_number")], "hash_rank").select("line_number", "hash_rank")


@R.add("b13_option_layout", """
    WITH o AS (SELECT line_number, source_snapshot.record.answer AS answer, unnest(list_distinct(source_snapshot.record.choices)) AS choice FROM raw_candidates WHERE source_snapshot.record.choices IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY line_number ORDER BY sha256(line_number::VARCHAR || '␟' || choice), choice) AS rn FROM o)
    SELECT line_number, string_agg(substr('ABCDEFGH', rn::INT, 1) || '=' || choice, ';' ORDER BY rn) AS layout, max(CASE WHEN choice = answer THEN substr('ABCDEFGH', rn::INT, 1) END) AS correct FROM r GROUP BY line_number""")
def _(spark, d):
    from factaudit.operators.prompts import option_layout

    rows = table(spark, d, "raw_candidates").select("line_number", F.col("source_snapshot.record.answer").alias("answer"), F.col("source_snapshot.record.choices").alias("choices"))
    return option_layout(rows, "line_number", "answer", "choices")


@R.add("b13_binary_layout", """
    WITH w AS (SELECT line_number, source_snapshot.record.answer AS answer, list_filter(source_snapshot.record.choices, lambda c: c IS DISTINCT FROM source_snapshot.record.answer)[1] AS other FROM raw_candidates WHERE source_snapshot.record.choices IS NOT NULL),
    h AS (SELECT *, ('0x' || substr(sha256(line_number::VARCHAR || '␟' || other || '␟en'), 1, 2))::INT % 2 = 0 AS ahead FROM w WHERE answer IS NOT NULL AND other IS NOT NULL)
    SELECT line_number, CASE WHEN ahead THEN answer ELSE other END AS a, CASE WHEN ahead THEN other ELSE answer END AS b, CASE WHEN ahead THEN 'A' ELSE 'B' END AS correct FROM h""")
def _(spark, d):
    """Each answer beside the first choice that is another, in an order that a hash decides."""
    from factaudit.operators.prompts import binary_layout

    rec = "source_snapshot.record."
    rows = table(spark, d, "raw_candidates").select("line_number", F.col(rec + "answer").alias("answer"), F.get(F.filter(rec + "choices", lambda c: ~c.eqNullSafe(F.col(rec + "answer"))), 0).alias("other")).where("answer IS NOT NULL AND other IS NOT NULL")
    return rows.select("line_number", binary_layout(F.col("line_number").cast("string"), F.col("other"), F.lit("en"), F.col("answer"), F.col("other")).alias("o")).select("line_number", "o.*")


@R.add("b13_target_layout", """
    WITH w AS (SELECT line_number::VARCHAR AS k, line_number, source_snapshot.record.answer AS answer, list_distinct(list_filter(source_snapshot.record.choices, lambda c: c <> source_snapshot.record.answer)) AS ds, list_sort(list_distinct(list_filter(source_snapshot.record.choices, lambda c: c <> source_snapshot.record.answer)))[1] AS target FROM raw_candidates WHERE source_snapshot.record.choices IS NOT NULL AND source_snapshot.record.answer IS NOT NULL),
    f AS (SELECT line_number, x, row_number() OVER (PARTITION BY line_number ORDER BY sha256(k || '␟' || target || '␟foil␟' || x)) AS rn FROM (SELECT *, unnest(ds) AS x FROM w) WHERE x <> target),
    c AS (SELECT w.*, list_concat([target], coalesce((SELECT list(x) FROM f WHERE f.line_number = w.line_number AND rn <= 2), [])) AS ids FROM w WHERE len(ds) >= 2),
    n AS (SELECT *, substr(sha256(k || '␟' || array_to_string(list_sort(ids), ',')), 1, 16) AS named FROM c), e AS (SELECT line_number, k, named, answer, target, unnest(list_concat(['__answer__'], ids)) AS id FROM n),
    r AS (SELECT *, row_number() OVER (PARTITION BY line_number ORDER BY sha256(k || '␟' || named || '␟option-order␟' || id)) AS rn FROM e)
    SELECT line_number, string_agg(CASE WHEN id = '__answer__' THEN answer ELSE id END, '|' ORDER BY rn) AS texts, max(CASE WHEN id = '__answer__' THEN substr('ABCDE', rn::INT, 1) END) AS correct, max(CASE WHEN id = target THEN substr('ABCDE', rn::INT, 1) END) AS target FROM r GROUP BY line_number""")
def _(spark, d):
    """Four options per row: the answer, the target (its least other choice) and two foils."""
    from factaudit.operators.prompts import target_layout

    rec = "source_snapshot.record."
    rows = table(spark, d, "raw_candidates").where(f"{rec}choices IS NOT NULL AND {rec}answer IS NOT NULL").select("line_number", F.col(rec + "answer").alias("answer"), F.array_distinct(F.filter(rec + "choices", lambda c: c != F.col(rec + "answer"))).alias("ds"))
    laid = target_layout(F.col("line_number").cast("string"), F.array_min("ds"), F.col("answer"), F.transform("ds", lambda x: F.struct(x.alias("id"), x.alias("text"))), 4)
    return rows.select("line_number", laid.alias("o")).where("o IS NOT NULL").select("line_number", F.array_join("o.texts", "|").alias("texts"), "o.correct", "o.target")


@R.add("b14_prompt_rendering", r"""
    SELECT line_number, CASE WHEN source_snapshot.record.choices IS NULL THEN 'Question: ' || source_snapshot.record.question || E'\nAnswer:'
      ELSE 'Question: ' || source_snapshot.record.question || E'\nOptions: ' || array_to_string(source_snapshot.record.choices, '; ') || E'\nAnswer:' END AS prompt FROM raw_candidates""")
def _(spark, d):
    from factaudit.operators.prompts import render_question

    rec = "source_snapshot.record."
    return table(spark, d, "raw_candidates").select("line_number", render_question(F.col(rec + "question"), F.col(rec + "choices")).alias("prompt"))


@R.add("b21_reply_json", r"""
    SELECT event_id, nullif(regexp_extract(regexp_replace('Reply: ```json ' || props || ' ```', '^```(?:json)?\s*|\s*```$', '', 'g'), '(?s)(\{.*\})', 1), '') AS reply,
      (json_extract_string(props, '$.k'))::BIGINT AS k FROM events""")
def _(spark, d):
    said = F.concat(F.lit("Reply: ```json "), F.col("props"), F.lit(" ```"))
    reply = text.reply_json(said)
    return table(spark, d, "events").select("event_id", reply.alias("reply"), F.from_json(reply, "k bigint")["k"].alias("k"))


@R.add("b24_lengths", r"""
    SELECT doc_id, CASE WHEN trim(text) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) END::INT AS words, length(regexp_replace(text, '\s', '', 'g'))::INT AS characters FROM documents WHERE text IS NOT NULL""")
def _(spark, d):
    rows = table(spark, d, "documents").where("text IS NOT NULL")
    return rows.select("doc_id", text.word_count(F.col("text")).alias("words"), text.nonspace_length(F.col("text")).alias("characters"))


@R.add("b25_token_estimate", r"SELECT doc_id, ceil(octet_length(encode(coalesce(text, ''))) / 4.0)::BIGINT AS tokens FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.ceil(F.octet_length(F.coalesce("text", F.lit(""))) / F.lit(4.0)).alias("tokens"))


@R.add("b26_common_prefix_length", """
    SELECT line_number, (SELECT count(*) FROM range(1, length(question) + 1) t(i) WHERE substr(question, 1, i::INT) = substr(canonical_fact, 1, i::INT) AND i <= length(canonical_fact)) AS prefix FROM audit_records WHERE question IS NOT NULL AND canonical_fact IS NOT NULL""")
def _(spark, d):
    from factaudit.operators.arrays import common_prefix_length

    chars = [F.filter(F.split(c, ""), lambda x: x != "") for c in ("question", "canonical_fact")]
    rows = table(spark, d, "audit_records").where("question IS NOT NULL AND canonical_fact IS NOT NULL")
    return rows.select("line_number", common_prefix_length(*chars).cast("bigint").alias("prefix"))


@R.add("b27_lexical_similarity", r"""
    WITH t AS (SELECT line_number, trim(regexp_replace(lower(question), '[^\p{L}\p{N}]+', ' ', 'g')) AS q, trim(regexp_replace(lower(canonical_fact), '[^\p{L}\p{N}]+', ' ', 'g')) AS f FROM audit_records WHERE canonical_fact IS NOT NULL),
    s AS (SELECT *, list_distinct(string_split(q, ' ')) AS tq, list_distinct(string_split(f, ' ')) AS tf, list_distinct(list_transform(range(1, length(q) + 3), lambda i: substr('  ' || q || '  ', i::INT, 3))) AS gq, list_distinct(list_transform(range(1, length(f) + 3), lambda i: substr('  ' || f || '  ', i::INT, 3))) AS gf FROM t)
    SELECT line_number, round(len(list_intersect(tq, tf)) / len(list_distinct(list_concat(tq, tf)))::DOUBLE, 6) AS token_jaccard, round(len(list_intersect(gq, gf)) / len(list_distinct(list_concat(gq, gf)))::DOUBLE, 6) AS char_jaccard,
      round(len(list_intersect(tq, tf)) / least(len(tq), len(tf))::DOUBLE, 6) AS token_containment, round(least(length(q), length(f)) / greatest(length(q), length(f))::DOUBLE, 6) AS ratio FROM s""")
def _(spark, d):
    rows = spread(table(spark, d, "audit_records").where("canonical_fact IS NOT NULL").select("line_number", "question", "canonical_fact")).select("line_number", text.normalize_lexical(F.col("question")).alias("q"), text.normalize_lexical(F.col("canonical_fact")).alias("f"))
    tq, tf, gq, gf = text.tokens(F.col("q")), text.tokens(F.col("f")), text.char_ngrams(F.col("q")), text.char_ngrams(F.col("f"))
    return rows.select("line_number", text.jaccard(tq, tf).alias("token_jaccard"), text.jaccard(gq, gf).alias("char_jaccard"), text.containment(tq, tf).alias("token_containment"), text.length_ratio(F.col("q"), F.col("f")).alias("ratio"))


@R.add("b28_minhash", r"""
    WITH t AS (SELECT line_number, unnest(list_distinct(string_split(trim(regexp_replace(lower(question), '[^\p{L}\p{N}]+', ' ', 'g')), ' '))) AS tok FROM audit_records),
    h AS (SELECT line_number, c AS component, min(substr(sha256(c::VARCHAR || '␟' || tok), 1, 16)) AS m FROM t, range(0, 16) r(c) GROUP BY ALL)
    SELECT line_number, string_agg(m, ',' ORDER BY component) AS signature FROM h GROUP BY line_number""")
def _(spark, d):
    from factaudit.operators.near_duplicates import minhash_signature

    rows = spread(table(spark, d, "audit_records").select("line_number", "question")).select("line_number", text.normalize_lexical(F.col("question")).alias("t"))
    return rows.select("line_number", F.array_join(minhash_signature(text.tokens(F.col("t"))), ",").alias("signature"))


@R.add("b29_reward", "SELECT event_id, round(ln(1 + pow(value / 100, 2) / (pow(value / 200, 2) + 0.001)) - 20 * pow(1 - value / 100, 3), 6) AS reward FROM events WHERE value IS NOT NULL")
def _(spark, d):
    from factaudit.operators.evaluation import reward

    rows = table(spark, d, "events").where("value IS NOT NULL")
    return rows.select("event_id", F.round(reward(F.col("value") / 100, F.col("value") / 200), 6).alias("reward"))


@R.add("b30_percentile", "SELECT event_type, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def _(spark, d):
    from factaudit.operators.prefix import percentiles

    found = percentiles(table(spark, d, "events").select("event_type", "value"), ["event_type"], "value", {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    return found.select("event_type", *[F.round(n, 6).alias(n) for n in ("p05", "p50", "p95")])


@R.add("b31_url_and_slug", r"""
    SELECT DISTINCT model_name, regexp_replace(regexp_replace(regexp_replace(lower(trim(u)), '^https?://', ''), ':(80|443)(/|$)', '\2'), '[?#].*$|/+$', '') AS endpoint, regexp_replace(regexp_replace(lower(model_name || ' v1/Beta'), '[^a-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug
    FROM (SELECT model_name, ' HTTPS://API.' || model_name || '.test:443/v1/' AS u FROM model_annotations)""")
def _(spark, d):
    url = F.concat(F.lit(" HTTPS://API."), F.col("model_name"), F.lit(".test:443/v1/"))
    return table(spark, d, "model_annotations").select("model_name", text.url_key(url).alias("endpoint"), text.slug(F.concat("model_name", F.lit(" v1/Beta"))).alias("slug")).distinct()


@R.add("b32_three_valued", """
    WITH v AS (SELECT source_id, CASE WHEN canonical_decision IS NULL THEN NULL ELSE lower(trim(canonical_decision)) = 'keep' END AS x FROM model_annotations)
    SELECT source_id, CASE WHEN bool_or(x) THEN true WHEN count(*) > count(x) THEN NULL ELSE false END AS any_known, CASE WHEN NOT bool_and(x) THEN false WHEN count(*) > count(x) THEN NULL ELSE true END AS all_known FROM v GROUP BY source_id""")
def _(spark, d):
    from factaudit.operators.evaluation import all_known, any_known

    kept = F.lower(F.trim("canonical_decision")) == "keep"
    return table(spark, d, "model_annotations").withColumn("x", kept).groupBy("source_id").agg(any_known("x").alias("any_known"), all_known("x").alias("all_known"))


@R.add("b33_timestamp_validation", r"""
    SELECT event_id, regexp_matches(s, '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$') AS has_zone, try_strptime(substr(s, 1, 19), '%Y-%m-%dT%H:%M:%S') IS NOT NULL AS parses
    FROM (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN event_id % 3 = 0 THEN 'Z' WHEN event_id % 3 = 1 THEN '' ELSE '+02:00' END AS s FROM events)""")
def _(spark, d):
    from factaudit.operators.validation import zoned_timestamp

    zone = F.when(F.col("event_id") % 3 == 0, "Z").when(F.col("event_id") % 3 == 1, "").otherwise("+02:00")
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), zone)
    return table(spark, d, "events").select("event_id", zoned_timestamp(stamp).alias("has_zone"), F.try_to_timestamp(F.substring(stamp, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).isNotNull().alias("parses"))


@R.add("b34_prompt_templates", """
    SELECT doc_id, CASE lang WHEN 'zh' THEN '请翻译：' WHEN 'de' THEN 'Bitte übersetzen: ' WHEN 'fr' THEN 'Veuillez traduire : ' WHEN 'es' THEN 'Por favor, traduzca: ' ELSE 'Please translate: ' END || substr(text, 1, 80) AS prompt FROM documents WHERE text IS NOT NULL""")
def _(spark, d):
    from factaudit.operators.prompts import translation_prompts

    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "lang", F.substring("text", 1, 80).alias("head"))
    return translation_prompts(rows, "lang", "head").select("doc_id", "prompt")


@R.add("b34_whole_prompts", """
    SELECT doc_id, CASE lang WHEN 'zh' THEN '请翻译：' WHEN 'de' THEN 'Bitte übersetzen: ' WHEN 'fr' THEN 'Veuillez traduire : ' WHEN 'es' THEN 'Por favor, traduzca: ' ELSE 'Please translate: ' END || text AS prompt FROM documents WHERE text IS NOT NULL""")
def _(spark, d):
    """As b34_prompt_templates, whose SQL holds it to the first 80 characters, with the whole text."""
    from factaudit.operators.prompts import translation_prompts

    return translation_prompts(table(spark, d, "documents").where("text IS NOT NULL"), "lang", "text").select("doc_id", "prompt")


@R.add("b35_prompt_leak_check", r"""
    SELECT line_number, len(list_filter(list_distinct(list_concat([lower(answer)], list_transform(coalesce(answer_aliases, []), lambda x: lower(x)))), lambda t: length(t) > 2 AND contains(lower(question), t))) > 0 AS leaks FROM audit_records""")
def _(spark, d):
    terms = F.array_distinct(F.concat(F.array(F.lower("answer")), F.transform(F.coalesce("answer_aliases", F.array().cast("array<string>")), lambda x: F.lower(x))))
    return table(spark, d, "audit_records").select("line_number", F.exists(terms, lambda t: (F.length(t) > 2) & F.contains(F.lower("question"), t)).alias("leaks"))


@R.add("b36_error_codes", r"""
    SELECT event_id, CASE WHEN event_type = 'error' AND value > 80 THEN 'http_' || (400 + (value::INT % 5))::VARCHAR WHEN event_type = 'error' AND value IS NULL THEN 'unknown' WHEN event_type = 'error' THEN 'transient' END AS code FROM events""")
def _(spark, d):
    error = F.col("event_type") == "error"
    code = F.when(error & (F.col("value") > 80), F.concat(F.lit("http_"), (400 + F.bround("value").cast("int") % 5).cast("string"))).when(error & F.col("value").isNull(), "unknown").when(error, "transient")
    return table(spark, d, "events").select("event_id", code.alias("code"))
