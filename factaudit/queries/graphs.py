"""Near duplicates, components, closures and splits, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factaudit.functions import text
from factaudit.operators import graph, joins, near_duplicates
from factaudit.queries.registry import Registry
from factaudit.session import cut, table

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql


def _texts(spark, d):
    """One row per distinct lexical question, under its least record id."""
    rows = table(spark, d, "audit_records").select(text.normalize_lexical(F.col("question")).alias("t"), "audit_record_id").where("t <> ''")
    return rows.groupBy("t").agg(F.min("audit_record_id").alias("id"))


@R.add("d11_lsh_blocked_pairs")
def _(spark, d):
    """Near-duplicate questions: pairs of class representatives with their measured similarity."""
    texts = _texts(spark, d).withColumn("tok", text.tokens(F.col("t")))
    return near_duplicates.banded_pairs(texts, "id", "t", F.col("tok"))


def _brute_near(column: str) -> str:
    """All pairs, compared one by one."""
    grams = lambda c: f"list_distinct(list_transform(range(1, length({c}) + 3), lambda i: substr('  ' || {c} || '  ', i::INT, 3)))"
    share = lambda x: f"len(list_intersect(l.{x}, r.{x}))"
    return rf"""
    WITH t AS (SELECT t, min(audit_record_id) AS id FROM (SELECT trim(regexp_replace(lower({column}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS t, audit_record_id FROM audit_records) WHERE t <> '' GROUP BY 1),
    s AS (SELECT *, length(t) AS n, list_distinct(string_split(t, ' ')) AS tok, {grams('t')} AS g FROM t),
    p AS (SELECT l.id AS x, r.id AS y, round(least(l.n, r.n) / greatest(l.n, r.n)::DOUBLE, 6) AS ratio, {share('tok')} AS st, len(l.tok) AS lt, len(r.tok) AS rt, {share('g')} AS sg, len(l.g) AS lg, len(r.g) AS rg FROM s l JOIN s r ON l.id < r.id AND least(l.n, r.n) * 2 >= greatest(l.n, r.n) - 1),
    v AS (SELECT x AS a, y AS b, greatest(round(st / (lt + rt - st)::DOUBLE, 6), round(sg / (lg + rg - sg)::DOUBLE, 6)) AS similarity, round(st / least(lt, rt)::DOUBLE, 6) AS containment, ratio FROM p)
    SELECT * FROM v WHERE ratio >= 0.5 AND (similarity >= 0.8 OR (containment >= 0.9 AND ratio >= 0.6))"""


def _near(spark, d, column):
    rows = table(spark, d, "audit_records").select(text.normalize_lexical(F.col(column)).alias("t"), "audit_record_id").where("t <> ''")
    least = rows.groupBy("t").agg(F.min("audit_record_id").alias("id")).withColumn("tok", text.tokens(F.col("t")))
    return near_duplicates.near_pairs(least, "id", "t", F.col("tok"))


@R.add("d11_near_questions", _brute_near("question"))
def _(spark, d):
    """Every pair of near questions by the exact join, bands or not; equal questions stand under their least id."""
    return _near(spark, d, "question")


@R.add("d11_near_facts", _brute_near("canonical_fact"))
def _(spark, d):
    return _near(spark, d, "canonical_fact")


@R.add("d11_bucket_members")
def _(spark, d):
    """The bucket of every band each question is in."""
    return near_duplicates.band_members(_texts(spark, d), "id", text.tokens(F.col("t")))


@R.add("d12_spanning_pairs", "SELECT canonical_fact_normalized AS fact, lag(audit_record_id) OVER w AS a, audit_record_id AS b FROM audit_records WHERE canonical_fact_normalized IS NOT NULL WINDOW w AS (PARTITION BY canonical_fact_normalized ORDER BY line_number, audit_record_id) QUALIFY lag(audit_record_id) OVER w IS NOT NULL")
def _(spark, d):
    rows = table(spark, d, "audit_records").withColumnRenamed("canonical_fact_normalized", "fact")
    return near_duplicates.spanning_pairs(rows, "fact", "audit_record_id", "line_number")


@R.add("d13_representative_pairs", rf"""
    WITH near AS ({_brute_near('question')}), t AS (SELECT trim(regexp_replace(lower(question), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS t, * FROM audit_records), k AS (SELECT *, min(audit_record_id) OVER (PARTITION BY t) AS id FROM t WHERE t <> ''),
    c AS (SELECT * FROM k WHERE record_role = 'current_bundle'), m AS (SELECT * FROM k WHERE record_role = 'comparison_canonical'),
    x AS (SELECT n.a AS l, n.b AS r, c.audit_record_id AS a, e.audit_record_id AS b, row_number() OVER (PARTITION BY n.a, n.b ORDER BY NOT coalesce(c.split_assignment <> e.split_assignment, false), c.line_number, e.line_number) AS rn, coalesce(c.split_assignment <> e.split_assignment, false) AS crossed FROM near n JOIN c ON c.id = n.a JOIN c e ON e.id = n.b)
    SELECT l, r, CASE WHEN crossed THEN 'cross_split' ELSE 'current' END AS kind, a, b FROM x WHERE rn = 1
    UNION ALL SELECT n.a, n.b, 'comparison', arg_min(c.audit_record_id, c.line_number), arg_min(m.audit_record_id, m.line_number) FROM near n JOIN c ON c.id = n.a JOIN m ON m.id = n.b GROUP BY n.a, n.b
    UNION ALL SELECT n.a, n.b, 'comparison', arg_min(c.audit_record_id, c.line_number), arg_min(m.audit_record_id, m.line_number) FROM near n JOIN c ON c.id = n.b JOIN m ON m.id = n.a GROUP BY n.a, n.b""")
def _(spark, d):
    """The records that stand for each pair of near questions; a class is named by its least record."""
    rows = table(spark, d, "audit_records").withColumn("t", text.normalize_lexical(F.col("question"))).where("t <> ''")
    named = cut(rows.groupBy("t").agg(F.min("audit_record_id").alias("id")))
    pairs = _near(spark, d, "question").select(F.col("a").alias("l"), F.col("b").alias("r"))
    firsts = near_duplicates.class_firsts(rows.join(named, "t"), "id", "audit_record_id", "line_number", "record_role", "split_assignment", "current_bundle", "comparison_canonical", ["development", "validation", "sealed"])
    return near_duplicates.representatives(pairs, cut(firsts), "id", "audit_record_id")


@R.add("d14_bucket_risk", """
    WITH k AS (SELECT audit_record_id, split_group_id, 'canonical_fact_exact' AS kind, canonical_fact_normalized AS v FROM audit_records UNION ALL SELECT audit_record_id, split_group_id, 'prompt_answer_exact', question_normalized || chr(31) || answer_normalized FROM audit_records
      UNION ALL SELECT audit_record_id, split_group_id, 'answer_alias_exact', unnest(list_distinct(list_transform(coalesce(answer_aliases, []), lambda x: trim(lower(x))))) FROM audit_records),
    m AS (SELECT DISTINCT * FROM k WHERE v IS NOT NULL AND v <> ''), b AS (SELECT kind, v, count(*) AS n, count(DISTINCT split_group_id) + count(*) FILTER (split_group_id IS NULL) AS parts FROM m GROUP BY 1, 2)
    SELECT m.audit_record_id, string_agg(DISTINCT m.kind, '|' ORDER BY m.kind) AS reasons, count(*) AS buckets FROM m JOIN b USING (kind, v) WHERE b.n > 1 AND b.parts > 1 GROUP BY 1""")
def _(spark, d):
    """Rows of buckets (equal fact, question with answer, or alias) that cut across split groups.

    Two rows are at risk when they share a bucket and not a group; a row without a group is one of its own.
    The bucket membership stands for the pairs, which a frequent alias would make too many of.
    """
    rows = table(spark, d, "audit_records")
    own = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("v"))
    aliases = F.transform(F.array_distinct(F.transform(F.coalesce("answer_aliases", F.array().cast("array<string>")), lambda x: F.trim(F.lower(x)))), lambda x: own("answer_alias_exact", x))
    keys = F.concat(F.array(own("canonical_fact_exact", F.col("canonical_fact_normalized")), own("prompt_answer_exact", F.concat("question_normalized", F.lit("\x1f"), "answer_normalized"))), aliases)
    k = rows.select("audit_record_id", "split_group_id", F.explode(keys).alias("k")).select("audit_record_id", "split_group_id", "k.*").where("v IS NOT NULL AND v <> ''")
    group = F.coalesce(F.concat(F.lit("g"), "split_group_id"), F.concat(F.lit("r"), "audit_record_id"))
    b = k.groupBy("kind", "v").agg(F.min(group).alias("x"), F.max(group).alias("y")).where("x <> y").select("kind", "v")
    return k.join(b, ["kind", "v"], "left_semi").groupBy("audit_record_id").agg(F.array_join(F.array_sort(F.collect_set("kind")), "|").alias("reasons"), F.count(F.lit(1)).alias("buckets"))


@R.add("g01_pair_evidence", """
    WITH p AS (SELECT lag(audit_record_id) OVER (PARTITION BY canonical_fact_normalized ORDER BY line_number) AS a, audit_record_id AS b, 'fact' AS kind FROM audit_records WHERE canonical_fact_normalized IS NOT NULL UNION ALL SELECT lag(audit_record_id) OVER (PARTITION BY question_normalized ORDER BY line_number), audit_record_id, 'question' FROM audit_records WHERE question_normalized IS NOT NULL)
    SELECT least(a, b) AS a, greatest(a, b) AS b, string_agg(DISTINCT kind, '|' ORDER BY kind) AS evidence FROM p WHERE p.a IS NOT NULL GROUP BY least(p.a, p.b), greatest(p.a, p.b)""".replace("least(a, b) AS a, greatest(a, b) AS b", "least(p.a, p.b) AS a, greatest(p.a, p.b) AS b"))
def _(spark, d):
    rows, pairs = table(spark, d, "audit_records"), None
    for kind, column in (("fact", "canonical_fact_normalized"), ("question", "question_normalized")):
        one = near_duplicates.spanning_pairs(rows, column, "audit_record_id", "line_number").select("a", "b", F.lit(kind).alias("kind"))
        pairs = one if pairs is None else pairs.unionByName(one)
    merged = near_duplicates.merge_evidence(pairs)
    return merged.select("a", "b", F.array_join("evidence", "|").alias("evidence"))


@R.add("g02_set_difference", """
    SELECT side, count(*) AS n FROM ((SELECT record_id, 'left' AS side FROM normalized_candidates WHERE decision = 'ready' EXCEPT ALL SELECT record_id, 'left' FROM zh_translations) UNION ALL (SELECT record_id, 'right' FROM zh_translations EXCEPT ALL SELECT record_id, 'right' FROM normalized_candidates WHERE decision = 'ready')) GROUP BY side""")
def _(spark, d):
    ready = table(spark, d, "normalized_candidates").where("decision = 'ready'")
    return joins.symmetric_difference(ready, table(spark, d, "zh_translations"), ["record_id"]).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


# Facts are tied by source and by group; a key is linked to its first fact only.


def _edges(spark, d):
    rows, out = table(spark, d, "audit_records"), None
    for key in ("source_id", "split_group_id"):
        least = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("base_fact_id").alias("src"))
        one = rows.select(key, F.col("base_fact_id").alias("dst")).distinct().join(least, key).select("src", "dst").where("src <> dst")
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def _closure(edges: str, then: str = "SELECT node, min(other) AS component FROM r GROUP BY node") -> str:
    """SQL of the components of an edge table: every node with every node it reaches."""
    return f"WITH RECURSIVE x AS {edges}, e AS (SELECT src, dst FROM x UNION SELECT dst, src FROM x), r(node, other) AS (SELECT src, src FROM e UNION SELECT r.node, e.dst FROM r JOIN e ON r.other = e.src) {then}"


_EDGES = """(SELECT DISTINCT src, dst FROM (SELECT min(base_fact_id) OVER (PARTITION BY source_id) AS src, base_fact_id AS dst FROM audit_records WHERE source_id IS NOT NULL UNION ALL SELECT min(base_fact_id) OVER (PARTITION BY split_group_id), base_fact_id FROM audit_records WHERE split_group_id IS NOT NULL) WHERE src <> dst)"""


@R.add("g03_connected_components", _closure(_EDGES))
def _(spark, d):
    return graph.components(_edges(spark, d))


# On a small set of keys the closure can be written as recursive SQL: sources only.
_SOURCE_EDGES = "(SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM (SELECT base_fact_id AS a, lag(base_fact_id) OVER (PARTITION BY source_id ORDER BY base_fact_id) AS b FROM audit_records) WHERE b IS NOT NULL AND a <> b)"


def _source_edges(spark, d):
    w = Window.partitionBy("source_id").orderBy("base_fact_id")
    pairs = table(spark, d, "audit_records").select(F.col("base_fact_id").alias("a"), F.lag("base_fact_id").over(w).alias("b")).where("b IS NOT NULL AND a <> b")
    return pairs.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()


@R.add("g03_source_components", f"""
    WITH RECURSIVE e AS (SELECT src, dst FROM {_SOURCE_EDGES} UNION SELECT dst, src FROM {_SOURCE_EDGES}), r(node, other) AS (SELECT src, src FROM e UNION SELECT r.node, e.dst FROM r JOIN e ON r.other = e.src)
    SELECT node, min(other) AS component FROM r GROUP BY node""")
def _(spark, d):
    return graph.components(_source_edges(spark, d))


@R.add("g04_reachability", f"""
    WITH RECURSIVE e AS (SELECT src, dst FROM {_SOURCE_EDGES} UNION SELECT dst, src FROM {_SOURCE_EDGES}), r(node) AS (SELECT DISTINCT base_fact_id FROM audit_records WHERE split_assignment = 'sealed' UNION SELECT e.dst FROM r JOIN e ON r.node = e.src) SELECT node FROM r""")
def _(spark, d):
    seeds = table(spark, d, "audit_records").where("split_assignment = 'sealed'").select(F.col("base_fact_id").alias("node"))
    return graph.reachable(seeds, _source_edges(spark, d)).select("node")


def _support(spark, d):
    """Relations supported by other relations of their subject type with a longer definition."""
    c = table(spark, d, "relation_catalog").select("relation_id", "subject_type", F.length("relation_definition").alias("n"))
    o = c.select(F.col("relation_id").alias("donor"), "subject_type", F.col("n").alias("m"))
    return c, c.join(o, "subject_type").where("m > n").select("relation_id", "donor")


_ROUNDS = "SELECT relation_id, dense_rank() OVER (PARTITION BY subject_type ORDER BY length(relation_definition) DESC)::INT AS round FROM relation_catalog"


@R.add("g05_candidate_fixed_point", _ROUNDS)
def _(spark, d):
    items, donors = _support(spark, d)
    return graph.supported(items, donors, "relation_id", "donor")


@R.add("g06_accepted_projection", _ROUNDS)
def _(spark, d):
    items, donors = _support(spark, d)
    return graph.supported(items, donors, "relation_id", "donor").where("round IS NOT NULL")


@R.add("g07_pair_exclusions", "SELECT DISTINCT record_id, reason, false AS asserted_false FROM normalized_candidates WHERE decision IN ('reject', 'defer')")
def _(spark, d):
    return table(spark, d, "normalized_candidates").where("decision IN ('reject', 'defer')").select("record_id", "reason", F.lit(False).alias("asserted_false")).distinct()


@R.add("g08_greedy_splits")
def _(spark, d):
    """Split groups balanced by size, subset, dataset and role; groups that lie in one split only stay there."""
    rows = table(spark, d, "audit_records").where("split_group_id IS NOT NULL")
    features = {"relation_counts": ("source_subset", 3.0), "dataset_counts": ("source_dataset", 1.5), "role_counts": ("record_role", 1.5)}
    whole = rows.groupBy("split_group_id").agg(F.count(F.lit(1)).alias("n"), F.min("split_assignment").alias("low"), F.max("split_assignment").alias("high"))
    whole = whole.withColumn("pinned", F.when((F.col("low") == F.col("high")) & (F.col("n") >= 5), F.col("low")))
    for name, (column, _) in features.items():
        counted = rows.where(F.col(column).isNotNull()).groupBy("split_group_id", column).agg(F.count(F.lit(1)).alias("c"))
        whole = whole.join(counted.groupBy("split_group_id").agg(F.map_from_entries(F.collect_list(F.struct(column, "c"))).alias(name)), "split_group_id", "left")
    return graph.greedy_splits(whole, "split_group_id", "n", "pinned", {k: w for k, (_, w) in features.items()}, {"development": 0.6, "validation": 0.2, "sealed": 0.2}, "splits-1")



@R.add("g09_exact_fold_search")
def _(spark, d):
    """The catalog's relations as facts of their subject type, tied where they share their Chinese label."""
    from factaudit.plans.folds import exact_folds

    facts = table(spark, d, "relation_catalog").select("relation_id", F.coalesce("label_zh", "relation_id").alias("component"), "subject_type")
    return exact_folds(facts, "relation_id", "component", "subject_type", ["fold_1", "fold_2", "fold_3"], "folds-1", strict=False)



@R.add("g10_component_rebuild", _closure("(SELECT * FROM " + _EDGES + " WHERE src IN (SELECT base_fact_id FROM audit_records WHERE split_assignment IS NOT NULL) AND dst IN (SELECT base_fact_id FROM audit_records WHERE split_assignment IS NOT NULL))",
    ", c AS (SELECT node, min(other) AS component FROM r GROUP BY node) SELECT component, count(DISTINCT node) AS facts, count(DISTINCT split_assignment) AS pins FROM c JOIN audit_records a ON a.base_fact_id = c.node WHERE split_assignment IS NOT NULL GROUP BY component"))
def _(spark, d):
    retained = table(spark, d, "audit_records").where("split_assignment IS NOT NULL").select(F.col("base_fact_id").alias("src")).distinct()
    kept = _edges(spark, d).join(retained, "src", "left_semi").join(retained.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst")
    parts = graph.components(kept)
    pins = table(spark, d, "audit_records").select(F.col("base_fact_id").alias("node"), "split_assignment").where("split_assignment IS NOT NULL")
    return parts.join(pins, "node").groupBy("component").agg(F.count_distinct("node").alias("facts"), F.count_distinct("split_assignment").alias("pins"))


@R.add("g11_component_projection", "SELECT split_group_id, count(*) AS before, count(split_assignment) AS retained FROM audit_records WHERE split_group_id IS NOT NULL GROUP BY 1 HAVING count(split_assignment) > 0")
def _(spark, d):
    rows = table(spark, d, "audit_records").where("split_group_id IS NOT NULL")
    return rows.groupBy("split_group_id").agg(F.count(F.lit(1)).alias("before"), F.count("split_assignment").alias("retained")).where("retained > 0")


@R.add("g12_fact_regrouping", _closure(r"(SELECT * FROM (SELECT DISTINCT min(base_fact_id) OVER (PARTITION BY regexp_replace(lower(canonical_fact), '[^\p{L}\p{N}]', '', 'g')) AS src, base_fact_id AS dst FROM audit_records WHERE canonical_fact IS NOT NULL) WHERE src <> dst UNION SELECT * FROM " + _SOURCE_EDGES + ")"))
def _(spark, d):
    rows = table(spark, d, "audit_records").select(F.col("base_fact_id").alias("node"), text.alnum_key(F.col("canonical_fact")).alias("k")).where("k IS NOT NULL").distinct()
    least = rows.groupBy("k").agg(F.min("node").alias("src"))
    lexical = rows.join(least, "k").select("src", F.col("node").alias("dst")).where("src <> dst")
    return graph.components(lexical.unionByName(_source_edges(spark, d)))


@R.add("g13_accepted_translation_projection", """
    SELECT z.record_id, bool_or(n.decision = 'ready') AS retained FROM zh_translations z LEFT JOIN normalized_candidates n ON z.record_id = n.record_id WHERE z.record_id NOT IN (SELECT record_id FROM normalized_candidates WHERE decision = 'reject') GROUP BY z.record_id""")
def _(spark, d):
    n = table(spark, d, "normalized_candidates")
    ready = n.groupBy("record_id").agg(F.bool_or(F.col("decision") == "ready").alias("retained"))
    z = table(spark, d, "zh_translations").select("record_id").distinct().join(n.where("decision = 'reject'").select("record_id"), "record_id", "left_anti")
    return z.join(ready, "record_id", "left")


@R.add("g14_replacement_screen", """
    WITH r AS (SELECT DISTINCT canonical_fact_normalized AS f FROM audit_records WHERE record_role = 'comparison_canonical' AND canonical_fact_normalized IS NOT NULL)
    SELECT a.audit_record_id FROM audit_records a JOIN r ON a.canonical_fact_normalized = r.f WHERE a.record_role = 'current_bundle'""")
def _(spark, d):
    rows = table(spark, d, "audit_records")
    replaced = rows.where("record_role = 'comparison_canonical'").select("canonical_fact_normalized")
    return rows.where("record_role = 'current_bundle'").join(replaced, "canonical_fact_normalized", "left_semi").select("audit_record_id")


@R.add("g14_replacement_pairs")
def _(spark, d):
    """Replaced facts against all rows: every pair that matches, and whether d11 has it as a near question."""
    aliases = F.transform(F.concat(F.array("answer"), F.coalesce("answer_aliases", F.array().cast("array<string>"))), lambda x: text.normalize_text(x, F.lower))
    rows = table(spark, d, "audit_records").select(
        "audit_record_id", (F.col("record_role") == "comparison_canonical").alias("replaced"), text.normalize_lexical(F.col("question")).alias("question"),
        text.normalize_lexical(F.col("canonical_fact")).alias("fact"), aliases.alias("aliases"))
    pairs = near_duplicates.screened_pairs(rows, "audit_record_id", "replaced", {"question": "question", "fact": "fact"}, "aliases")
    return pairs.select("a", "b", F.array_join("match_types", "|").alias("match_types"), F.col("banded").alias("in_d11"))


@R.add("g15_full_pool_projection", _closure(_SOURCE_EDGES, "SELECT node, min(other) AS component FROM r WHERE node IN (SELECT base_fact_id FROM audit_records WHERE split_assignment = 'validation') GROUP BY node"))
def _(spark, d):
    parts = graph.components(_source_edges(spark, d))
    cohort = table(spark, d, "audit_records").where("split_assignment = 'validation'").select(F.col("base_fact_id").alias("node")).distinct()
    return parts.join(cohort, "node", "left_semi")
