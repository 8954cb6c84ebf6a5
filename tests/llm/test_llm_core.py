"""Small tests of the training-data operators: brute force, round trips and edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factaudit.llm import answer_defects, consensus, group_splits, mixing, split_overlap, tokenizer, value_mapping, visual_form
from factaudit.llm.fact_subject import subject_of
from factaudit.llm.fm_index import BackwardIndex, maximal_matches


# 1 ---------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    "prompt, answer, fact, language, expected",
    [
        ("What is the melting point of Zan Vom?", None, None, "en", "empty_answer"),
        ("What is the melting point of Zan Vom?", "  N/A ", None, "en", "empty_answer"),
        ("What is the melting point of Zan Vom?", "I cannot answer this question.", None, "en", "refusal"),
        ("What is the theme song of Zan Vom?", "I Cannot Recall the Harbour", "The theme song of Zan Vom is I Cannot Recall the Harbour.", "en", None),
        ("What is the melting point of Zan Vom?", "what is the melting point of zan vom", None, "en", "copies_question"),
        ("What is the melting point of Zan Vom?", "the melting point of Zan Vom", None, "en", "copies_question"),
        ("What is the melting point of Zan Vom?", "The melting point of Zan Vom is", None, "en", "truncated_answer"),
        ("Name the source lake of Zan Vom.", "Kostre Li", "The source lake of Zan Vom is Kostre Lirabo.", "en", "truncated_answer"),
        ("Name the source lake of Zan Vom.", "Kostre Lirabo", "Kostre Lirabo is the source lake of Zan Vom.", "en", None),
        ("Name the source lake of Zan Vom.", "болотный ирис", None, "en", "wrong_language"),
        ("Name the source lake of Zan Vom.", "la pierre grise", None, "en", "wrong_language"),
        ("Name the theme song of Zan Vom.", "Le Petit Phare Gris", "The theme song of Zan Vom is Le Petit Phare Gris.", "en", None),
        ("赞·沃姆的熔点是什么？", "无", None, "zh", "empty_answer"),
        ("赞·沃姆的熔点是什么？", "抱歉，我无法回答这个问题。", None, "zh", "refusal"),
        ("赞·沃姆的主题曲是什么？", "《抱歉，冬天之前不行》", "赞·沃姆的主题曲是《抱歉，冬天之前不行》。", "zh", None),
        ("赞·沃姆的熔点是什么？", "赞·沃姆的熔点，根据", None, "zh", "truncated_answer"),
        ("赞·沃姆的馆藏是什么？", "一批手绘瓷砖（靠近", None, "zh", "truncated_answer"),
        ("赞·沃姆的熔点是什么？", "赞·沃姆的熔点就是赞·沃姆的熔点。", None, "zh", "copies_question"),
        ("赞·沃姆的母公司是什么？", "Bestisol Labrilo", None, "zh", "wrong_language"),
        ("赞·沃姆的登记编号是什么？", "KMO 257", "赞·沃姆的登记编号是KMO 257。", "zh", None),
        (None, "1985", None, "en", None),
        ("What does it do?", "It converts light energy into chemical ener", None, "en", "truncated_answer"),
        ("What does the leaf do?", "a change of light into chemical ener", "The leaf does a change of light into chemical energy.", "en", "truncated_answer"),
        ("Where does it stand?", "near the school", None, "en", None),
        ("Where does it stand?", "schooner harbour", None, "en", None),
        ("Where does it stand?", "beside a café", None, "en", None),
        ("Where does it stand?", "In de stad Utrecht gesloten", None, "en", "wrong_language"),
        ("What is it made of?", "pizarra gris", None, "en", "wrong_language"),
        ("What was said?", "I'm going to pass on that one.", None, "en", "refusal"),
        ("What was said?", "My apologies, that is confidential.", None, "en", "refusal"),
    ],
)
def test_defects(prompt, answer, fact, language, expected):
    assert answer_defects.defect(prompt, answer, fact, language) == expected


def test_parser_and_long_text():
    assert answer_defects.left_open("a (b [c] d") == [")"]
    assert answer_defects.left_open("```json\n{") == ["```"]
    assert answer_defects.left_open("<b>x</b> (y)") == []
    assert answer_defects.defect("What is x?", "word " * 20000, None, "en") is None


def test_tiles_are_used_once():
    assert answer_defects.tiled(list("abcab"), list("xabcx"), 2) == [True] * 3 + [False] * 2
    assert answer_defects.tiled(list("abcabc"), list("abc"), 4) == [False] * 6


# 2 ---------------------------------------------------------------------------------------------
def test_backward_search_against_brute_force():
    r = random.Random(1)
    texts = ["".join(r.choice("abc ") for _ in range(r.randint(0, 12))) for _ in range(60)]
    patterns = ["".join(r.choice("abcd ") for _ in range(r.randint(0, 14))) for _ in range(40)]
    tk, pk = np.array([r.randint(0, 3) for _ in texts]), np.array([r.randint(0, 5) for _ in patterns])
    got = set(map(tuple, np.stack(maximal_matches(BackwardIndex(texts, tk), patterns, pk, 2, 10**9)).T))
    due = set()
    for o, p in enumerate(patterns):
        for d, t in enumerate(texts):
            if tk[d] != pk[o]:
                continue
            for b in range(1, len(p) + 1):
                for i in range(1, len(t) + 1):
                    k = 0
                    while k < b and k < i and p[b - 1 - k] == t[i - 1 - k]:
                        k += 1
                    if k >= 2:
                        due.add((o, b - k, b, d))
    assert got == due


COLUMNS = "id string, question string, fact string, answer string, split string, id_extra int"


def overlap(spark, rows, **kw):
    frame = spark.createDataFrame(rows, COLUMNS)
    out = split_overlap.overlapping_pairs(frame, "id", "question", "fact", "answer", "split", "development", ["validation", "sealed"], **kw)
    return {tuple(r) for r in out.collect()}


def test_overlaps_and_their_limits(spark):
    q = "according to the 1984 registry what is the melting point of the mineral zanuter vomilo"
    rows = [
        ("a", q, "the melting point of the mineral zanuter vomilo is 12 degrees", "12 degrees", "development", 1),
        ("b", q, None, "12 degrees", "validation", 1),
        ("c", "what is the the melting pont of zanutre vomilo according to the 1984 registry", None, "12 degrees", "sealed", 1),
        ("d", q.replace("1984", "1985"), None, "12 degrees", "validation", 1),
        ("e", q, None, "13 degrees", "validation", 1),
        ("f", q.replace("vomilo", "kribara"), None, "12 degrees", "validation", 1),
        ("g", q.replace("melting point", "crystal colour"), None, "12 degrees", "sealed", 1),
        ("h", q, None, "12 degrees", None, 1),
        ("i", None, None, None, "validation", 1),
        ("j", "", "", "", "development", 1),
        ("k", q, None, "12 degrees", "development", 1),
    ]
    due = {("a", "b"), ("a", "c"), ("b", "k"), ("c", "k")}
    assert overlap(spark, rows) == due
    assert overlap(spark, rows, shard_wordings=4) == due  # the grid of blocks gives the same pairs
    assert overlap(spark, rows, exact=True) == due
    assert overlap(spark, rows + [(f"copy{i}", *rows[1][1:]) for i in range(3)]) == due | {(x, f"copy{i}") for x in "a" for i in range(3)} | {(f"copy{i}", "k") for i in range(3)}
    assert overlap(spark, rows[:1]) == set()


def test_overlaps_of_a_hot_subject(spark):
    q = "what is the melting point of zanuter vomilo"
    rows = [(f"hot{i}", f"{q} nr{i}", None, f"{i} degrees", "development", 1) for i in range(60)]
    rows += [
        ("a", q.replace("point", "pont"), None, "12 crowns", "development", 1),
        ("b", q, None, "12 crowns", "validation", 1),
        ("c", f"{q} reccoded", None, "12 crowns", "sealed", 1),
        ("d", q.replace("vomilo", "kribara"), None, "12 crowns", "validation", 1),
        ("e", q.replace("zanuter", "zanutre"), None, "12 crowns", "validation", 1),
    ]
    assert overlap(spark, rows) == {("a", "b"), ("a", "c"), ("a", "e")}


# 3 ---------------------------------------------------------------------------------------------
def test_divided_records_against_union_find(spark):
    r = random.Random(3)
    rows = [(f"r{i}", r.choice(["development", "validation", None]), r.choice([None, *[f"g{j}" for j in range(40)]]), f"s{r.randrange(90)}", "extra") for i in range(150)]
    frame = spark.createDataFrame(rows, "id string, split string, g string, s string, component string")
    got = {x.id for x in group_splits.divided_records(frame, "id", "split", [F.col("g"), F.col("s")]).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    used = [x for x in rows if x[1]]
    for x in used:
        for k in (("g", x[2]), ("s", x[3])):
            if k[1] is not None:
                parent[find(x[0])] = find(k)
    splits = {}
    for x in used:
        splits.setdefault(find(x[0]), set()).add(x[1])
    assert got == {x[0] for x in used if len(splits[find(x[0])]) > 1}


def test_assignment_keeps_groups_and_shares(spark):
    rows = spark.range(4000).select(F.concat(F.lit("r"), "id").alias("id"), F.when(F.col("id") < 400, "big").otherwise((F.col("id") % 900).cast("string")).alias("g"))
    targets = spark.createDataFrame([("development", 0.7), ("validation", 0.15), ("sealed", 0.15)], "split string, share double")
    out = group_splits.grouped_splits(rows, "id", [F.col("g")], targets).join(rows, "id")
    assert out.count() == 4000
    assert out.groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    share = {r.split: r.n / 4000 for r in out.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert abs(share["development"] - 0.7) < 0.05 and abs(share["sealed"] - 0.15) < 0.05


def test_subjects(spark):
    facts = [("The home province of the town Zan Vom is Kos Lir in the 1984 atlas.", "Kos Lir", "zan vom"), ("Kos Lir is the home province of Zan Vom.", "Kos Lir", "zan vom"), ("For the river Zan Vom, the length is given as 5 km.", "5 km", "zan vom"),
             ("Zan Vom has What Is the Tide as its song.", "What Is the Tide", "zan vom"), (None, "x", None), ("1881 is the year of first description of Zan Vom in the 1881 handbook.", "1881", "zan vom")]
    rows = spark.createDataFrame(facts, "f string, a string, due string")
    assert [(r.s, r.due) for r in rows.select(subject_of(F.col("f"), F.col("a")).alias("s"), "due").collect() if r.s != r.due] == []


# 4 ---------------------------------------------------------------------------------------------
def test_consensus_sees_through_a_spammer_and_a_swapper(spark):
    r = random.Random(4)
    truth = {f"i{k}": r.choice(["keep", "exclude", "pending_review"]) for k in range(300)}
    rows, n = [], 0
    for item, t in truth.items():
        for who in ("good1", "good2", "spam1", "spam2", "swap"):
            said = {"g": t if r.random() < 0.93 else "keep", "s": "keep"}[who[0]] if who != "swap" else {"keep": "exclude", "exclude": "keep"}.get(t, t)
            n += 1
            rows.append((item, who, said.upper() if n % 7 == 0 else f" {said.replace('_', '-')} ", n, n, n, None, "clash"))
    rows += [("i0", "good1", None, 10**6, 1, 10**6, [], "clash"), ("only_null", "good1", None, 1, 1, 1, [], "clash"), rows[5]]
    frame = spark.createDataFrame(rows, "source string, who string, label string, at int, arrived int, id int, conflicts array<string>, item string")
    items = consensus.items_of(consensus.last_votes(frame, "source", "who", "label", "at", "arrived", "id", "conflicts"))
    reliable = {x.annotator: x.reliability for x in consensus.reliability(items).collect()}
    assert min(reliable["good1"], reliable["good2"]) > max(abs(reliable["spam1"]), abs(reliable["spam2"]))
    out = {x.item: x.label for x in consensus.consensus(items).collect()}
    assert "only_null" not in out and sum(out[k] == v for k, v in truth.items()) > 280
    skills = {(x.label, x.annotator): x.reliability for x in consensus.reliabilities(items).collect()}
    # The one who swaps two labels tells against them and for the third.
    assert skills["keep", "swap"] < 0 and skills["exclude", "swap"] < 0 < skills["pending_review", "swap"]


def test_consensus_of_nothing_and_of_strangers(spark):
    empty = spark.createDataFrame([], "item string, votes array<struct<annotator:string,label:string,conflicts:int>>")
    assert consensus.consensus(empty).count() == 0
    lone = spark.createDataFrame([("i", [("a", "keep", 0)]), ("j", [("b", "exclude", 0)])], empty.schema)
    assert {(x.item, x.label, x.agreement) for x in consensus.consensus(lone).collect()} == {("i", "keep", None), ("j", "exclude", None)}


def test_plain_labels(spark):
    rows = spark.createDataFrame([("  Pending review\t",), ("PENDING-REVIEW",), ("",), (None,)], "l string")
    assert [x.p for x in rows.select(consensus.plain_label(F.col("l")).alias("p")).collect()] == ["pending_review", "pending_review", None, None]


# 5 ---------------------------------------------------------------------------------------------
def test_visual_forms():
    same = ["café", "café", "ｃａｆé", "ca​fé", "cаfé"]
    assert {visual_form.canonical_form(x) for x in same} == {"café"}
    assert [visual_form.has_variant_characters(x) for x in same] == [False, True, True, True, True]
    assert visual_form.canonical_form(None) is None and visual_form.canonical_form("​") == "" and visual_form.canonical_form("") == ""
    assert not visual_form.has_variant_characters("请问，这是什么？（例）") and visual_form.has_variant_characters("１９８４年") and visual_form.has_variant_characters("⼀个")
    assert not visual_form.has_variant_characters("Гашязу β-80") and not visual_form.has_variant_characters(None) and not visual_form.has_variant_characters("👩‍🔬")
    assert visual_form.plain_form("НОЕН187", "of HOEH187") == "HOEH187" and visual_form.plain_form("β-80", "b-80") == "β-80"
    assert visual_form.plain_form("Ｆull１ 👩‍🔬 q̂ 例（é）…", None) == "Full1 👩‍🔬 q 例（é）…"


def test_imitation_needs_its_context(spark):
    rows = spark.createDataFrame([("ССХ-709", "CCX-709"), ("Гашязу", "Tisomil"), (None, None), ("x" * 50000, "x")], "v string, c string")
    assert [r.f for r in rows.select(visual_form.looks_alike(F.array("v"), F.col("c")).alias("f")).collect()] == [True, False, False, False]


def test_wholly_imitated_words_take_the_form_of_their_context(spark):
    rows = [(["МТХ-283", "ВКМ448", "x"], "MTX-283 and BKM448"), (["МТХ-283"], "Tisomil"), (["Гашязу β", None], "b"), (None, "MTX")]
    frame = spark.createDataFrame(rows, "v array<string>, c string")
    assert [r.f for r in visual_form.canonical_values(frame, "v", "f", "c").collect()] == [["mtx-283", "bkm448", "x"], ["мтх-283"], ["гашязу β", None], None]
    single = frame.select(F.col("v")[0].alias("v"), "c")
    assert [r.f for r in visual_form.canonical_values(single, "v", "f", "c").collect()] == ["mtx-283", "мтх-283", "гашязу β", None]
    assert visual_form.canonical_form("М\u200bТХ", "MTX") == "mtx" and visual_form.canonical_form("МТХ") == "мтх"


# 6 ---------------------------------------------------------------------------------------------
def test_values_find_their_entry(spark):
    references = spark.createDataFrame([("melting_point", "melting point"), ("melting_point", "熔点"), ("source_lake", "source lake"), ("first_navigation", "year of first navigation")], "entry string, reference string")
    rows = spark.createDataFrame([("mleting ponits", 1), ("MeltingPoint", 2), ("的熔点", 3), ("lake of source", 4), ("navigation, year of first", 5), ("parking fee", 6), ("", 7), (None, 8), ("has source lake (per source)", 9), ("has source lake (per source)", 9), ("x" * 4000, 10)], "v string, entry int")
    got = {(r.v, r.mapped_entry) for r in value_mapping.map_values(rows, "v", references).collect()}
    assert got == {("mleting ponits", "melting_point"), ("MeltingPoint", "melting_point"), ("的熔点", "melting_point"), ("lake of source", "source_lake"), ("navigation, year of first", "first_navigation"), ("parking fee", "unmatched"), ("", "unmatched"),
                   ("has source lake (per source)", "source_lake"), ("x" * 4000, "unmatched")}
    assert value_mapping.map_values(rows, "v", references).count() == 10
    empty = value_mapping.map_values(rows.where("false"), "v", references)
    assert empty.count() == 0


def test_pigeonhole_loses_nothing_against_brute_force(spark):
    r = random.Random(6)
    refs = ["".join(r.choice("abcd") for _ in range(n)) for n in (4, 6, 9, 12, 16, 20) for _ in range(3)]

    def spoil(s):
        s = list(s)
        for _ in range(r.randint(0, 5)):
            k = r.randrange(len(s))
            s[k : k + 1] = r.choice([[], [r.choice("abcd")], [s[k], r.choice("abcd")]]) if len(s) > 2 else [s[k]]
        return "".join(s)

    values = sorted({spoil(x) for x in refs for _ in range(12)})
    lev = lambda a, b: None
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    got = {x.v: x.edits for x in value_mapping.closest_entries(frame, "v", spark.createDataFrame([(x, x) for x in refs], "entry string, reference string")).collect()}
    pairs = frame.crossJoin(spark.createDataFrame([(x,) for x in refs], "r string")).selectExpr("v", "levenshtein(v, r) AS e", "length(r) AS L")
    due = {x.v: x.e for x in pairs.where(f"e <= {value_mapping.EDITS_SQL}").groupBy("v").agg(F.min("e").alias("e")).collect()}
    assert got == due


# 7, 8 ------------------------------------------------------------------------------------------
TEXTS = [(1, "Hello   world, it's 2024!\n\n  ok"), (2, ""), (3, None), (4, "中文，測試 👩‍🔬 naïve"), (5, "a " * 3000), (6, "Hello   world, it's 2024!\n\n  ok"), (7, " \t "), (8, "<|endoftext|> x")]


def test_encoding_equals_the_library_and_decodes(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer.vocabulary_path(spark)
    reference = tokenizers.Tokenizer.from_file(path.replace(".tiktoken", ".json"))
    reference.encode_special_tokens = True
    frame = spark.createDataFrame(TEXTS, "doc bigint, text string").withColumn("ids", F.lit("clash")).select("doc", "text", "ids")
    encoded = tokenizer.encode_corpus(frame, "doc", "text", path)
    got = {r.doc: list(r.ids) for r in encoded.collect()}
    assert got == {i: reference.encode(t, add_special_tokens=False).ids if t else [] for i, t in TEXTS}
    assert {r.doc: r.text for r in tokenizer.decode_corpus(encoded, "doc", path).collect()} == {i: t or "" for i, t in TEXTS}
    assert {r.doc: r.tokens for r in tokenizer.count_tokens(frame, "doc", "text", path).collect()} == {k: len(v) for k, v in got.items()}
    assert tokenizer.encode_corpus(frame.where("false"), "doc", "text", path).count() == 0


def test_mix_meets_shares_and_caps(spark):
    docs = spark.range(3000).selectExpr("id AS doc", "CASE WHEN id < 2000 THEN 'big' WHEN id < 2990 THEN 'mid' WHEN id < 2995 THEN 'tiny' END AS source", "50 + id % 37 AS tokens")
    targets = spark.createDataFrame([("big", 0.4, 3), ("mid", 0.4, 3), ("tiny", 0.1, 2), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(docs, targets)
    report = {r.source: r for r in mixing.shares(docs, targets, mixed).collect()}
    assert report["none"].status == "no documents" and report["tiny"].status == "too small" and report["tiny"].most_copies == 2
    for s in ("big", "mid"):
        assert abs(report[s].mixed_tokens - report[s].wanted_tokens) < 100 and report[s].most_copies <= 3
    assert mixed.count() == 2995 and mixed.exceptAll(mixing.mix(docs, targets)).count() == 0
    assert mixing.mix(docs.where("false"), targets).count() == 0
