"""Near duplicates by MinHash bands and verification, and pairs within exact groups."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factaudit.functions.text import char_ngrams, containment, jaccard, length_ratio
from factaudit.functions.text import tokens as tokens_of
from factaudit.session import cut, shuffle_partitions, shuffled, spread

COMPONENTS = 16
BANDS = 8
#: Slots of the table of item counts, and the rows of an item that make one salt.
SLOTS, HOT_ROWS = 1 << 16, 20_000
#: Pairs of a value that make one part, and pairs of a task.
PART_PAIRS, TASK_PAIRS = 500_000, 2_000_000
PREFIX_SCHEMA = "rule string, item string, salt int, probe boolean, at int, n bigint, side boolean, length int, size int, s0 bigint, s1 bigint, s2 bigint, s3 bigint"
PREFIX_COLUMNS = [c.split()[0] for c in PREFIX_SCHEMA.split(", ")]


def minhash_signature(tokens: Column, components: int = COMPONENTS) -> Column:
    """The least hash of a token set under each of ``components`` hashes, within the row."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(components - 1)),
        lambda c: F.array_min(F.transform(tokens, lambda t: F.substring(F.sha2(F.concat_ws("␟", c.cast("string"), t), 256), 1, 16))))


def fast_signature(tokens: Column, components: int = COMPONENTS) -> Column:
    """As ``minhash_signature`` with 64-bit hashes, for blocking."""
    return F.transform(F.sequence(F.lit(0), F.lit(components - 1)), lambda c: F.array_min(F.transform(tokens, lambda t: F.xxhash64(c, t))))


def band_members(rows: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, band, bucket): the bucket of every band a text is in; fewer than three distinct tokens give none."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(b.alias("band"), _bucket(F.col("sig"), b).alias("bucket")))
    signed = rows.select(key, tokens.alias("tok")).where("size(tok) >= 3").select(key, fast_signature(F.col("tok")).alias("sig"))
    return signed.select(key, F.explode(bands).alias("x")).select(key, "x.band", "x.bucket")


def _bucket(signature: Column, band: Column) -> Column:
    width = COMPONENTS // BANDS
    return F.xxhash64(F.slice(signature, band * width + 1, width))


def banded_pairs(rows: DataFrame, key: str, text: str, tokens: Column) -> DataFrame:
    """(a, b, similarity, containment, ratio), a < b: the near pairs of keys whose texts share a band.

    All pairs of a bucket are held against the rule of ``near_pairs``, whatever the bucket's size: the
    pairs come from that exact join, so a hot bucket is never enumerated.  Texts with fewer than three
    distinct tokens take no part.
    """
    eligible = rows.where(F.size(tokens) >= 3)
    near = with_shared_band(near_pairs(eligible, key, text, tokens), eligible, key, tokens)
    return near.where("shared_band").drop("shared_band")


def with_shared_band(near: DataFrame, rows: DataFrame, key: str, tokens: Column) -> DataFrame:
    """``near`` with ``shared_band``: whether the texts of a and b, both of three tokens or more, share a band."""
    near = cut(near)
    ends = near.select(F.col("a").alias(key)).unionByName(near.select(F.col("b").alias(key))).distinct()
    signed = cut(rows.join(shuffled(ends), key, "left_semi").select(key, F.when(F.size(tokens) >= 3, fast_signature(tokens)).alias("sig")))
    end = lambda p: shuffled(signed.select(F.col(key).alias(p), F.col("sig").alias(f"sig_{p}")))
    both = near.join(end("a"), "a").join(end("b"), "b")
    shared = F.exists(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda x: _bucket(F.col("sig_a"), x) == _bucket(F.col("sig_b"), x))
    return both.select(*near.columns, F.coalesce(shared & F.col("sig_a").isNotNull() & F.col("sig_b").isNotNull(), F.lit(False)).alias("shared_band"))


def _slots(items: Column) -> Column:
    return F.pmod(F.crc32(items.cast("binary")), F.lit(SLOTS))


def _prefixes(counts: dict[int, int]):
    """Index and probe rows of texts: see ``near_pairs``."""

    def salts(count: int) -> int:
        return 1 + count // HOT_ROWS

    def sketch(items: list[str]) -> list[int]:
        words = [0, 0, 0, 0]
        for x in items:
            h = crc32(x.encode("utf-8"), 7) & 255
            words[h >> 6] |= 1 << (h & 63)
        return [w - (1 << 64) if w >> 63 else w for w in words]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight: dict[str, int] = {}
        for batch in batches:
            out: list[tuple] = []
            for n, side, length, tok, grams in zip(batch["n"], batch["side"], batch["length"], batch["tok"], batch["grams"]):
                for kind, items in (("t", tok), ("g", grams)):
                    size = len(items)
                    if not size:
                        continue
                    for x in items:
                        if x not in weight:
                            weight[x] = counts.get(crc32(x.encode("utf-8")) % SLOTS, 0)
                    order = sorted(items, key=lambda x: (weight[x], x))
                    own = (n, side, length, size, *sketch(order))
                    # Of the smaller text of a pair, then of the larger: the rarest items that must hold a shared one.
                    smaller, larger = size - (8 * size + 8) // 9 + 1, size - (4 * size + 4) // 5 + 1
                    rules = [(kind, smaller, larger)] + ([("c", size - (9 * size + 9) // 10 + 1, size)] if kind == "t" else [])
                    for rule, index, probe in rules:
                        for at, x in enumerate(order[: max(index, probe)]):
                            parts = salts(weight[x])
                            if at < index:
                                out += [(rule, x, salt, False, at, *own) for salt in range(parts)]
                            if at < probe:
                                out.append((rule, x, n % parts, True, at, *own))
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=PREFIX_COLUMNS)
                    out = []
            yield pd.DataFrame(out, columns=PREFIX_COLUMNS)

    return run


def near_pairs(rows: DataFrame, key: str, text: str, tokens: Column, side: Column | None = None) -> DataFrame:
    """(a, b, similarity, containment, ratio), a < b: every pair of keys with near texts, by an exact join.

    Near: the shorter text has at least half the length of the longer, and tokens or character n-grams
    have a similarity of 0.8, or one holds 0.9 of the other's tokens at a length ratio of 0.6.  With
    ``side`` (a boolean) only pairs that hold a key of that side are formed.

    Sets that share so much share one of their rarest items (prefix filter: in a common order of all
    items, the smaller set's first ``n - 8n/9 + 1`` and the larger's first ``n - 4n/5 + 1`` meet; for
    containment the smaller's first ``n - 9n/10 + 1`` meet any item of the larger).  The order is by the
    count of an item's slot, a table of fixed size.  Rows of a hot item are salted.  A pair that meets
    goes on only if its places in the order and a sketch of 256 bits allow the threshold; both are
    bounds, so nothing that qualifies is lost (for sets below 400 000 items, where rounding to six
    places changes no decision).
    """
    spread_rows = spread(rows).select(F.col(key).alias("id"), F.col(text).alias("t"), tokens.alias("tok"), char_ngrams(F.col(text)).alias("grams"), (F.lit(False) if side is None else side).alias("side"))
    texts = cut(spread_rows.withColumn("n", F.monotonically_increasing_id()).withColumn("length", F.length("t")))
    counted = texts.select(F.explode(F.concat("tok", "grams")).alias("x")).groupBy(_slots(F.col("x")).cast("int").alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    counts = {r["slot"]: r["n"] for r in counted.collect()}  # at most SLOTS rows
    placed = cut(texts.select("n", "side", "length", "tok", "grams").mapInPandas(_prefixes(counts), PREFIX_SCHEMA))
    columns = ["n", "side", "length", "size", "at", "s0", "s1", "s2", "s3"]
    half = lambda probe, p: placed.where(F.col("probe") == probe).select("rule", "item", "salt", *[F.col(c).alias(f"{p}_{c}") for c in columns])
    least = "CASE rule WHEN 'c' THEN (9 * x_size + 9) DIV 10 ELSE (4 * (x_size + y_size) + 8) DIV 9 END"  # items to share
    differ = " + ".join(f"bit_count(x_s{i} & ~y_s{i})" for i in range(4))
    back = " + ".join(f"bit_count(y_s{i} & ~x_s{i})" for i in range(4))
    meet = [
        "x_n <> y_n", "x_size < y_size OR (x_size = y_size AND (rule = 'c' OR x_n < y_n))",
        "rule = 'c' OR 5 * x_size >= 4 * y_size",
        "least(x_length, y_length) * 10 >= greatest(x_length, y_length) * IF(rule = 'c', 6, 5) - 1",
        f"least(x_size - x_at, y_size - y_at) >= {least}",
        f"{differ} <= x_size - ({least})", f"rule = 'c' OR {back} <= y_size - ({least})",
    ]
    if side is not None:
        meet.insert(0, "x_side OR y_side")
    met = half(False, "x").join(shuffled(half(True, "y")), ["rule", "item", "salt"]).where(" AND ".join(f"({m})" for m in meet))
    met = met.selectExpr("least(x_n, y_n) AS p", "greatest(x_n, y_n) AS q").distinct()
    end = lambda n, p: texts.select(F.col("n").alias(n), *[F.col(c).alias(f"{p}_{c}") for c in ("id", "t", "tok", "grams")])
    both = met.join(shuffled(end("p", "l")), "p").join(shuffled(end("q", "r")), "q")
    token, grams = (F.col("l_tok"), F.col("r_tok")), (F.col("l_grams"), F.col("r_grams"))
    scored = both.select(
        F.least("l_id", "r_id").alias("a"), F.greatest("l_id", "r_id").alias("b"), F.greatest(jaccard(*token), jaccard(*grams)).alias("similarity"),
        containment(*token).alias("containment"), length_ratio(F.col("l_t"), F.col("r_t")).alias("ratio"))
    return scored.where("ratio >= 0.5 AND (similarity >= 0.8 OR (containment >= 0.9 AND ratio >= 0.6))")


def screened_pairs(rows: DataFrame, key: str, side: str, texts: dict[str, str], values: str) -> DataFrame:
    """(a, b, match_types, banded), a < b: pairs of a row of ``side`` (a boolean) with any other row that match.

    ``texts`` names text columns by kind: equal texts match as kind_exact, near ones (``near_pairs``, no
    bands) as kind_near; a value both rows have in the array ``values`` matches as value_exact.  ``banded``
    is whether a near match of the first kind is one that ``banded_pairs`` gives.  Empty and null texts
    and values match nothing.  The result has every pair: a value that many rows have gives the product.
    """
    none = F.array().cast("array<string>")
    own = F.coalesce(F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != ""))), none)
    base = rows.select(F.col(key).alias("x"), F.coalesce(side, F.lit(False)).alias("side"), own.alias("xs"), *[F.col(c).alias(f"t_{k}") for k, c in texts.items()])
    full, links = base, {}
    for kind in texts:
        t = f"t_{kind}"
        least = cut(base.where(F.col(t) != "").groupBy(t).agg(F.bool_or("side").alias("side")).withColumn("rep", F.monotonically_increasing_id()))
        full = full.join(shuffled(least.select(t, F.col("rep").alias(f"x_{kind}"))), t, "left").drop(t)
        least = least.withColumn("tok", tokens_of(F.col(t)))
        near = cut(with_shared_band(near_pairs(least, "rep", t, F.col("tok"), F.col("side")), least, "rep", F.col("tok")))
        links[kind] = near.selectExpr(f"a AS x_{kind}", f"b AS y_{kind}", "shared_band").unionByName(near.selectExpr(f"b AS x_{kind}", f"a AS y_{kind}", "shared_band"))
    full = cut(full)
    mine = full.where("side").drop("side")
    other = full.select(*[F.col(c).alias("y_side" if c == "side" else f"y{c[1:]}") for c in full.columns])
    worded = _pairs_by_text(mine, other, links)
    return _pairs_by_value(mine, full, other, links).unionByName(worded)


def _pairs_by_text(mine: DataFrame, other: DataFrame, links: dict[str, DataFrame]) -> DataFrame:
    """The pairs of ``screened_pairs`` that share no value."""
    found, first = [], next(iter(links))
    for kind, near in links.items():
        x, y = f"x_{kind}", f"y_{kind}"
        left, right = mine.select("x", "xs", x), shuffled(other.select("y", "ys", y))
        exact = left.withColumn(y, F.col(x)).join(right, y).select("x", "y", "xs", "ys", F.lit(f"{kind}_exact").alias("kind"), F.lit(False).alias("banded"))
        close = left.join(shuffled(near), x).join(right, y).select("x", "y", "xs", "ys", F.lit(f"{kind}_near").alias("kind"), F.col("shared_band") & F.lit(kind == first))
        found += [exact, close]
    every = found[0]
    for one in found[1:]:
        every = every.union(one)
    pairs = every.where("x <> y AND NOT arrays_overlap(xs, ys)").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return pairs.agg(F.array_sort(F.collect_set("kind")).alias("match_types"), F.bool_or("banded").alias("banded"))


def _pairs_by_value(mine: DataFrame, full: DataFrame, other: DataFrame, links: dict[str, DataFrame]) -> DataFrame:
    """The pairs of ``screened_pairs`` that share a value, each formed once and complete: the product is not shuffled.

    A pair comes from the first of x's values that y has.  What else the two share is told from the numbers of
    their texts, and from those of the texts near to x's.  A value of many pairs is dealt out by parts of y.
    """
    first = next(iter(links))
    for kind, near in links.items():
        lists = near.groupBy(f"x_{kind}").agg(F.collect_list(f"y_{kind}").alias(f"near_{kind}"), F.collect_list(F.when(F.col("shared_band"), F.col(f"y_{kind}"))).alias(f"banded_{kind}"))
        mine = mine.join(shuffled(lists if kind == first else lists.drop(f"banded_{kind}")), f"x_{kind}", "left")
    counts = full.select("side", F.explode("xs").alias("v")).groupBy("v").agg(F.count_if("side").alias("m"), F.count(F.lit(1)).alias("n"))
    parts = cut(counts.where("m > 0").selectExpr("v", "m * n AS pairs", f"CAST(1 + (m * n) DIV {PART_PAIRS} AS int) AS parts"))
    total = parts.agg(F.sum("pairs")).first()[0] or 0
    n = max(shuffle_partitions(full.sparkSession), 1 + total // TASK_PAIRS)
    left = mine.select("*", F.posexplode("xs").alias("at", "v")).withColumn("before", F.slice("xs", F.lit(1), F.col("at"))).drop("xs", "at").join(shuffled(parts), "v")
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("pairs", "parts")
    right = other.select("*", F.explode("ys").alias("v")).join(shuffled(parts), "v").withColumn("part", F.expr("CAST(pmod(xxhash64(y), parts) AS int)")).drop("pairs", "parts")
    met = left.repartition(n, "v", "part").join(shuffled(right.repartition(n, "v", "part")), ["v", "part"])
    met = met.where("x <> y AND (NOT y_side OR x < y) AND NOT arrays_overlap(before, ys)")
    kinds = {"value_exact": F.lit(True)}
    for kind in links:
        kinds |= {f"{kind}_exact": F.col(f"x_{kind}") == F.col(f"y_{kind}"), f"{kind}_near": F.array_contains(f"near_{kind}", F.col(f"y_{kind}"))}
    told = F.array_compact(F.array(*[F.when(kinds[k], F.lit(k)) for k in sorted(kinds)]))
    banded = F.coalesce(F.array_contains(f"banded_{first}", F.col(f"y_{first}")), F.lit(False))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), told.alias("match_types"), banded.alias("banded"))


def class_firsts(rows: DataFrame, group: str, key: str, order: str, role: str, split: str, current: str, comparison: str, splits: list[str]) -> DataFrame:
    """Per class the first record of the current role, in all and per split, and of the comparison role."""
    first = lambda test: F.min(F.when(test, F.struct(order, key)))
    mine = F.col(role) == current
    return rows.where(F.col(group).isNotNull()).groupBy(group).agg(
        first(mine).alias("any"), first(F.col(role) == comparison).alias("other"), F.array(*[first(mine & (F.col(split) == s)) for s in splits]).alias("by_split"))


def representatives(pairs: DataFrame, firsts: DataFrame, group: str, key: str) -> DataFrame:
    """(l, r, kind, a, b) for pairs (l, r) of classes: the records that stand for the pair.

    Of the current role the first records of the two classes in different splits, where there are any
    (``cross_split``), else their first records (``current``); and a class's first current record with the
    other's first comparison record (``comparison``), both ways.
    """
    side = lambda p: firsts.select(F.col(group).alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("any", "other", "by_split")])
    met = pairs.select("l", "r").join(side("l"), "l").join(side("r"), "r")
    crossed = F.flatten(F.transform("l_by_split", lambda x, i: F.transform("r_by_split", lambda y, j: F.when((i != j) & x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y"))))))
    best = F.array_min(F.array_compact(crossed))
    plain = F.when(F.col("l_any").isNotNull() & F.col("r_any").isNotNull(), F.struct(F.col("l_any").alias("x"), F.col("r_any").alias("y")))
    told = lambda kind, x, y: F.when(x.isNotNull() & y.isNotNull(), F.struct(F.lit(kind).alias("kind"), x[key].alias("a"), y[key].alias("b")))
    chosen = F.array_compact(F.array(
        F.when(best.isNotNull(), told("cross_split", best["x"], best["y"])).otherwise(told("current", plain["x"], plain["y"])),
        told("comparison", F.col("l_any"), F.col("r_other")), told("comparison", F.col("r_any"), F.col("l_other"))))
    return met.select("l", "r", F.explode(chosen).alias("c")).select("l", "r", "c.*")


def spanning_pairs(rows: DataFrame, group: str, key: str, order: str) -> DataFrame:
    """(group, a, b): a chain through each group in order: n - 1 pairs that connect n members."""
    w = Window.partitionBy(group).orderBy(order, key)
    return rows.where(F.col(group).isNotNull()).select(group, F.lag(key).over(w).alias("a"), F.col(key).alias("b")).where("a IS NOT NULL")


def merge_evidence(pairs: DataFrame) -> DataFrame:
    """(a, b, evidence): unordered pairs with all kinds of match that tie them."""
    return pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.array_sort(F.collect_set("kind")).alias("evidence"))
