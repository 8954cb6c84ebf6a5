import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from factaudit.functions import text
from factaudit.operators import arrays, evaluation, graph, joins, ledger, near_duplicates, ranking, skew, validation


def union_find(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def test_components_match_union_find(spark):
    r = random.Random(5)
    edges = [(r.randrange(120), r.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(7, 7)]
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert got == union_find(edges)
    assert graph.components(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_reachable_and_supported(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (8, 9)], "src int, dst int")
    got = {r.node: r.hops for r in graph.reachable(spark.createDataFrame([(1,)], "node int"), edges).collect()}
    assert got == {1: 0, 2: 1, 3: 2}
    items = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "k string")
    donors = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d")], "k string, donor string")
    assert {r.k: r["round"] for r in graph.supported(items, donors, "k", "donor").collect()} == {"a": None, "b": None, "c": 2, "d": 1}


def test_three_valued_groups(spark):
    rows = spark.createDataFrame([("t", True), ("t", None), ("u", None), ("u", False), ("f", False), ("a", True)], "g string, x boolean")
    out = {r.g: (r.any, r.all) for r in rows.groupBy("g").agg(evaluation.any_known("x").alias("any"), evaluation.all_known("x").alias("all")).collect()}
    assert out == {"t": (True, None), "u": (None, False), "f": (False, False), "a": (True, True)}


def test_skewed_lookup_equals_join(spark):
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 500).cast("string"))).alias("k"), "id").unionByName(spark.createDataFrame([(None, -1)], "k string, id bigint"))
    lookup = rows.select("k").where("k IS NOT NULL").distinct().withColumn("v", F.length("k"))
    heavy = skew.heavy_keys(rows, "k", 0.1)
    assert [r.k for r in heavy.collect()] == ["hot"]
    a = skew.skewed_lookup(rows, lookup, "k", heavy).select("id", "v")
    b = rows.join(lookup, "k", "left").select("id", "v")
    assert a.exceptAll(b).count() == 0 and a.count() == b.count() == 6001


def test_allocation_bounds(spark):
    caps = spark.createDataFrame([("a", 1), ("b", 5), ("c", 9)], "k string, n int")
    assert {r.k: r.allocated for r in ranking.balanced_allocation(caps, "k", "n", 8).collect()} == {"a": 1, "b": 4, "c": 3}
    assert sum(r.allocated for r in ranking.largest_remainder(caps, "k", "n", 7).collect()) == 7


def test_exact_text_forms(spark):
    rows = spark.createDataFrame([("Straße  ﬁn",), (None,), ("",)], "t string")
    assert [r.n for r in rows.select(text.normalize_text(F.col("t")).alias("n")).collect()] == ["strasse fin", "", ""]
    assert [r.n for r in rows.select(text.casefold_exact("t").alias("n")).collect()] == ["strasse fin".replace("fin", "fin"), "", ""]


def test_prefix_and_similarity_edges(spark):
    rows = spark.createDataFrame([(["a", "b"], ["a", "c"]), ([], ["a"]), (["x"], ["x"])], "a array<string>, b array<string>")
    assert [r.n for r in rows.select(arrays.common_prefix_length(F.col("a"), F.col("b")).alias("n")).collect()] == [1, 0, 1]
    assert [r.n for r in rows.select(text.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("n")).distinct().collect()] == [0.0]


def test_banded_pairs_find_near_texts(spark):
    base = "which melting point is recorded for the mineral"
    texts = [(f"id{i}", f"{base} zan{i}ter vom{i}lo") for i in range(40)] + [("dup", f"{base} zan7ter vom7lo please"), ("short", "two words")]
    frame = spark.createDataFrame(texts, "id string, t string")
    pairs = {(r.a, r.b) for r in near_duplicates.banded_pairs(frame, "id", "t", text.tokens(F.col("t"))).collect()}
    assert ("dup", "id7") in pairs and not any("short" in p for p in pairs)


def test_cover_and_donors(spark):
    due, seen = spark.createDataFrame([("a",), ("b",), ("c",)], "k string"), spark.createDataFrame([("a",), ("a",), ("b",), ("z",)], "k string")
    assert {r.k: r.problem for r in validation.exact_cover(due, seen, "k").collect()} == {"a": "repeated", "c": "missing", "z": "unexpected"}
    pool = spark.createDataFrame([(f"r{i}", "rel", str(i % 4)) for i in range(20)], "k string, rel string, answer string")
    got = joins.donors(pool, pool, ["rel"], "k", ["answer"], 2, F.sha2("k", 256)).collect()
    assert len(got) == 40 and all(r["rank"] in (1, 2) for r in got)


def test_ledger_window(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP '2024-01-01 00:00:00'), (1, TIMESTAMP '2024-01-01 12:00:00'), (1, TIMESTAMP '2024-01-03 00:00:00') t(k, at)")
    assert sorted(r.in_window for r in ledger.attempts_in_window(rows, "k", "at", 86400).collect()) == [1, 1, 2]


def test_greedy_splits_place_by_cost(spark):
    shares = {"dev": 0.6, "val": 0.2, "sealed": 0.2}
    sizes = spark.createDataFrame([("a", 4), ("b", 3), ("c", 2), ("d", 1)], "k string, n int")
    assert graph.whole_targets(11, shares) == {"dev": 7, "val": 2, "sealed": 2}
    got = {r.k: r.split for r in graph.greedy_splits(sizes, "k", "n", None, {}, shares, "s").collect()}
    assert got["a"] == got["d"] == "dev" and {got["b"], got["c"]} == {"val", "sealed"}
    with pytest.raises(ValueError):
        graph.greedy_splits(sizes, "k", "n", None, {}, shares, "s", limit=2)
    # A pin holds whatever it costs, and a feature pulls its values apart.
    rows = [("a", 2, "val", {"x": 2}), ("b", 2, None, {"x": 2}), ("c", 2, None, {"y": 2}), ("d", 2, None, {"y": 2})]
    frame = spark.createDataFrame(rows, "k string, n int, pin string, f map<string,int>")
    got = {r.k: r.split for r in graph.greedy_splits(frame, "k", "n", "pin", {"f": 3.0}, {"dev": 0.5, "val": 0.5}, "s").collect()}
    assert got["a"] == "val" and got["b"] == "dev" and {got["c"], got["d"]} == {"dev", "val"}
    assert graph.greedy_splits(sizes.where("false"), "k", "n", None, {}, shares, "s").count() == 0


def test_exact_folds_keep_components_and_quotas(spark):
    from factaudit.plans.folds import exact_folds

    rows = [("f1", "c1", "r"), ("f2", "c1", "s"), ("f3", "c2", "r"), ("f4", "c3", "s"), ("f5", "c4", "s"), ("f6", "c4", "r"), ("f7", "c5", "r"), ("f8", "c6", "s")]
    frame = spark.createDataFrame(rows, "fact string, comp string, rel string")
    got = {r.fact: r.fold for r in exact_folds(frame, "fact", "comp", "rel", ["x", "y"], "seed").collect()}
    # Two coupled components with one surplus fact each go to different folds; two of each relation per fold.
    assert got["f1"] == got["f2"] != got["f5"] == got["f6"]
    assert all(sum(got[f] == fold and r == rel for f, _, r in rows) == 2 for fold in "xy" for rel in "rs")
    with pytest.raises(Exception, match="slots"):
        exact_folds(frame.where("fact <> 'f8'"), "fact", "comp", "rel", ["x", "y"], "seed").collect()
    assert exact_folds(frame.where("fact <> 'f8'"), "fact", "comp", "rel", ["x", "y"], "seed", strict=False).count() == 7


def test_beam_search_extends_after_a_hit(spark):
    from factaudit.plans.beam import beam_search

    start = spark.createDataFrame([("q", "o"), ("p", "p")], "question string, origin string")
    grow = lambda queue: queue.select(F.concat("question", F.lit("x")).alias("question"), "origin")
    depth = F.length("question") - 1

    def evaluate(rate):
        return lambda rows: rows.withColumn("rate_ori", F.when(F.col("origin") == "p", 0.5).otherwise(1.0)).withColumn("rate_trans", rate).withColumn("value", F.lit(1.0))

    search = lambda rate, **more: [(r.question, r.round) for r in beam_search(start, grow, evaluate(rate), 5, **more).orderBy("round").collect()]
    assert search(F.lit(0.9), most_good=9) == []
    # A hit in the second round carries the search from three to six rounds.
    assert search(F.when(depth == 2, 0.4).otherwise(0.9), most_good=9) == [("qxx", 1)]
    assert search(F.when(depth >= 2, 0.4).otherwise(0.9), most_good=9) == [("q" + "x" * n, n - 1) for n in range(2, 7)]
    # No model knows it any more: good, but searched no further.  Weak questions count towards the cap.
    assert search(F.when(depth == 2, 0.0).otherwise(0.3), most_good=9) == [("qx", 0), ("qxx", 1)]
    assert search(F.lit(0.2), most_good=2) == [("qx", 0), ("qxx", 1)]



def test_banded_pairs_of_a_hot_bucket_and_near_pairs_against_brute_force(spark):
    r = random.Random(7)
    frame_words = "according to the 1894 survey name the channel length recorded for the great river".split()
    names = ["".join(r.choice(["za", "vo", "mi", "kre", "tul", "ba"]) for _ in range(4)) for _ in range(90)]
    texts = [(f"n{i}", " ".join([*frame_words, n])) for i, n in enumerate(names)] + [(f"m{i}", " ".join(["quick check", *frame_words, n])) for i, n in enumerate(names)]
    texts += [(f"s{i}", f"opening year of {n} {names[-i]}") for i, n in enumerate(names[:30])] + [(f"u{i}", f"openning year off {n} {names[-i]}") for i, n in enumerate(names[:30])]
    frame = spark.createDataFrame(texts, "id string, t string")

    def near(a, b):
        wa, wb, ga, gb = *(set(x.split()) for x in (a, b)), *({f"  {x}  "[i : i + 3] for i in range(len(x) + 2)} for x in (a, b))
        ratio, same = min(len(a), len(b)) / max(len(a), len(b)), len(wa & wb)
        return ratio >= 0.5 and (max(same / len(wa | wb), len(ga & gb) / len(ga | gb)) >= 0.8 or ratio >= 0.6 and same / min(len(wa), len(wb)) >= 0.9)

    due = {(min(i, j), max(i, j)) for k, (i, a) in enumerate(texts) for j, b in texts[k + 1 :] if near(a, b)}
    words = text.tokens(F.col("t"))
    assert {(x.a, x.b) for x in near_duplicates.near_pairs(frame, "id", "t", words).collect()} == due
    members = {}
    for x in near_duplicates.band_members(frame, "id", words).collect():
        members.setdefault(x.id, set()).add((x.band, x.bucket))
    got = {(x.a, x.b) for x in near_duplicates.banded_pairs(frame, "id", "t", words).collect()}
    assert got == {p for p in due if members[p[0]] & members[p[1]]} and len(got) > 24 * 180


def test_screened_pairs_list_every_match_of_a_replaced_row(spark):
    rows = [
        ("r1", True, "name the channel length of the river zanter vomilo", "fact one of zanter vomilo here", ["12 km", ""]),
        ("c1", False, "quick check name the channel length of the river zanter vomilo", "x", ["13 km"]),
        ("c2", False, "name the channel length of the river zanter vomilo", "y", ["14 km", "twelve"]),
        ("c3", False, "unlike", "fact one of zanter vomilo hare", ["15 km"]),
        ("c4", False, "other", "fact one of zanter vomilo hare", ["12 km"]),
        ("c5", False, "other", "", ["15 km"]),
        ("r2", True, None, None, ["twelve", None]),
    ]
    frame = spark.createDataFrame(rows, "id string, replaced boolean, q string, f string, v array<string>")
    got = {(x.a, x.b): (x.match_types, x.banded) for x in near_duplicates.screened_pairs(frame, "id", "replaced", {"question": "q", "fact": "f"}, "v").collect()}
    assert {k: v[0] for k, v in got.items()} == {
        ("c1", "r1"): ["question_near"], ("c2", "r1"): ["question_exact"], ("c3", "r1"): ["fact_near"], ("c4", "r1"): ["fact_near", "value_exact"], ("c2", "r2"): ["value_exact"]}
    given = {(x.a, x.b) for x in near_duplicates.banded_pairs(frame.where("id IN ('r1', 'c1')"), "id", "q", text.tokens(F.col("q"))).collect()}
    assert got["c1", "r1"][1] == (("c1", "r1") in given) and not got["c3", "r1"][1]


def broadcasts(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


def test_near_pairs_broadcast_nothing_that_is_taken_for_small(spark, monkeypatch, tmp_path):
    # Estimates by compressed files are far too low, so the joins must not trust them.
    plans = []
    monkeypatch.setattr(near_duplicates, "cut", lambda df: plans.append(broadcasts(df)) or df.checkpoint())
    frame = spark.createDataFrame([("a", "name the zanter river length"), ("b", "name the zanter river lengths"), ("c", "other")], "id string, t string")
    frame.write.parquet(f"{tmp_path}/texts")
    frame = spark.read.parquet(f"{tmp_path}/texts")
    near = near_duplicates.near_pairs(frame, "id", "t", text.tokens(F.col("t")))
    plans.append(broadcasts(near))
    plans.append(broadcasts(near_duplicates.with_shared_band(near, frame, "id", text.tokens(F.col("t")))))
    assert not any(plans) and [(r.a, r.b) for r in near.collect()] == [("a", "b")]


def test_screened_pairs_broadcast_nothing_that_is_taken_for_small(spark, monkeypatch, tmp_path):
    plans = []
    monkeypatch.setattr(near_duplicates, "cut", lambda df: plans.append(broadcasts(df)) or df.checkpoint())
    rows = [("r1", True, "name the zanter river length", ["12 km"]), ("c1", False, "name the zanter river lengths", ["12 km"]), ("c2", False, "other", None)]
    spark.createDataFrame(rows, "id string, replaced boolean, q string, v array<string>").write.parquet(f"{tmp_path}/rows")
    pairs = near_duplicates.screened_pairs(spark.read.parquet(f"{tmp_path}/rows"), "id", "replaced", {"question": "q"}, "v")
    plans.append(broadcasts(pairs))
    assert not any(plans) and [(r.a, r.b, r.match_types) for r in pairs.collect()] == [("c1", "r1", ["question_near", "value_exact"])]


def test_screened_pairs_of_a_value_are_formed_once_and_never_shuffled(spark, monkeypatch):
    # Rows that share several values, replaced rows on both sides, and a value dealt out in parts.
    monkeypatch.setattr(near_duplicates, "PART_PAIRS", 7, raising=False)
    r = random.Random(5)
    rows = [(f"k{n:02}", r.random() < 0.4, r.choice(["name the zanter river length", "name the zanter river lengths", "unlike", None]), [r.choice(["hot", "tin", "ash", "", None]) for _ in range(r.randrange(4))]) for n in range(40)]
    rows.append(("k40", True, "name the zanter river length", None))
    pairs = near_duplicates.screened_pairs(spark.createDataFrame(rows, "id string, replaced boolean, q string, v array<string>"), "id", "replaced", {"question": "q"}, "v")
    due = {}
    for n, (a, x, q, v) in enumerate(rows):
        for b, y, p, w in rows[n + 1 :]:
            texts = {q, p}
            kinds = [k for k, found in (("question_exact", q is not None and q == p), ("question_near", texts == {"name the zanter river length", "name the zanter river lengths"}), ("value_exact", {*(v or ())} & {*(w or ())} - {"", None})) if found]
            if (x or y) and kinds:
                due[a, b] = kinds
    got = [((t.a, t.b), t.match_types) for t in pairs.collect()]
    assert len(got) == len(due) and dict(got) == due
    assert pairs._jdf.queryExecution().optimizedPlan().nodeName() == "Union"  # not a sum over all pairs


def test_greedy_splits_walk_any_number_of_components(spark):
    many = spark.range(100_001).select(F.concat(F.lit("c"), "id").alias("k"), F.lit(1).alias("n"))
    placed = graph.greedy_splits(many, "k", "n", None, {}, {"dev": 0.6, "val": 0.2, "sealed": 0.2}, "s")
    assert {r.split: r["count"] for r in placed.groupBy("split").count().collect()} == {"dev": 60_001, "val": 20_000, "sealed": 20_000}


def test_ledger_window_gathers_no_window(spark):
    # Ties, windows that end on the microsecond, and events without time or key, against the windows themselves.
    r = random.Random(3)
    rows = spark.createDataFrame([(r.choice(["a", "b", None]), r.choice([None, *range(40)])) for _ in range(600)], "k string, s int").withColumn("at", F.timestamp_seconds("s"))
    w = Window.partitionBy("k").orderBy(F.unix_micros("at")).rangeBetween(-10_000_000, Window.currentRow)
    got = ledger.attempts_in_window(rows, "k", "at", 10)
    due = rows.withColumn("in_window", F.count(F.lit(1)).over(w))
    assert got.columns == due.columns and got.exceptAll(due).isEmpty() and got.count() == due.count() == 600
    assert "RangeFrame" not in got._jdf.queryExecution().executedPlan().toString()
