"""Records that appear, exactly or almost, in both a training and an evaluation split.

Evaluation texts are indexed shard by shard in a Burrows-Wheeler index; the training texts of the same
shard stream through backward search, which gives the maximal matches; the matches of a pair are merged, and pairs
whose merged spans cover enough of the shorter text are checked word by word.

What must be equal (value and years) is the routing key: it picks the shard, so a text meets only the
shard it can have partners in and the work grows with the data.  What is indexed of a wording are the
words that tell it from others - those that fewer than one text in ``COMMON_SHARE`` has - in
alphabetical order, so that turned wordings read alike; the check reads all words.  Rare words that may
be slips of common ones tell nothing: a wording with fewer than ``SOLID_WORDS`` others (a hot subject, or
no rare word) is searched with all its words, and against all words of every wording of its key.  No
match is passed over for being wide.  ``exact=True`` searches every wording that way.  Texts are indexed
once per distinct wording.  A key with more wordings than fit one shard is dealt over a grid of blocks: its
evaluation wordings are cut into blocks, its training wordings into blocks, and each cell of the grid is a
shard of its own.

Records of one role that say the same are one class.  Wordings match wordings, classes follow, and only
``overlapping_pairs`` spells out rows, hot classes dealt over salts; ``overlap_counts`` multiplies sizes.

Defined results: a null text has no wording and gives no pair; a null value or year set equals only
another null; records without a split take no part; exact copies give one pair per pair of rows; rows
that come twice are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factaudit.llm.fact_subject import KINDS, plain_words
from factaudit.llm.fm_index import BackwardIndex, maximal_matches
from factaudit.operators.skew import heavy_keys, salted_join, skewed_lookup
from factaudit.session import cut

# Words that frame a question or a fact without naming what it is about.
FRAME_WORDS = (
    "according to the an as per in of for what which is was are were does do did record records recorded give gives given "
    "name state stated tell me please note so item quick check exactly then whats has have had its it and by on at from with "
    "yearbook almanac atlas survey registry gazetteer handbook inventory annual " + KINDS.replace("|", " ")
).split()

YEAR = r"^(1[0-9]|20)\d\d$"
LEAST_MATCH = 5
LEAST_COVER = 0.4
SHARD_WORDINGS = 6000
#: A word is common when more than one text in so many has it, and at least COMMON_LEAST texts do.
COMMON_SHARE, COMMON_LEAST = 500, 50
#: Rare words that are no slip of a common one, and their letters, that a wording must have to be searched by its rare words.
SOLID_WORDS, SOLID_LETTERS = 2, 2 * LEAST_MATCH
STREAMED = 1000


def _content(words: Column, drop: Column | None = None) -> Column:
    tokens = F.filter(F.split(words, " "), lambda t: (F.length(t) > 1) & ~t.isin(*FRAME_WORDS) & ~t.rlike(YEAR))
    return tokens if drop is None else F.array_except(tokens, drop)


def records_with_wordings(rows: DataFrame, record_id: str, question: str, fact: str, value: str, split: str, training: str, evaluation: list[str]) -> DataFrame:
    """(record, training, class, wordings): what each record says, as up to two wordings.

    Records of the same role with the same wordings are of one class: they overlap with the same others.
    """
    q, f = plain_words(F.col(question)), plain_words(F.col(fact))
    years = F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(q, " "), lambda t: t.rlike(YEAR)))), " ")
    compact = F.regexp_replace(F.lower(F.col(value)), r"[^\p{L}\p{N}]+", "")
    base = rows.where(F.col(split).isin(training, *evaluation)).select(
        F.col(record_id).alias("record"), (F.col(split) == training).alias("training"),
        F.xxhash64(compact, compact.isNull(), years, years.isNull()).alias("routed"),
        F.coalesce(plain_words(F.col(value)), F.lit("")).alias("value"), q.alias("q"), f.alias("f"))

    def said(kind: str, tokens: Column) -> Column:
        words = F.array_sort(tokens)
        return F.struct(F.xxhash64(F.lit(kind), "routed", F.array_join(words, " ")).alias("wording"), F.lit(kind).alias("kind"), words.alias("words"), F.array_join(tokens, " ").alias("ordered"))

    both = F.filter(F.array(said("q", _content(F.col("q"))), said("f", _content(F.col("f"), F.split("value", " ")))), lambda w: F.size(w["words"]) > 0)
    told = base.select("record", "training", "routed", "value", both.alias("wordings"))
    return told.withColumn("class", F.xxhash64("training", F.transform("wordings", lambda w: w["wording"])))


def common_words(texts: DataFrame) -> list[str]:
    """The words that more than one text in ``COMMON_SHARE`` has.

    Their number is bounded by COMMON_SHARE times the mean number of words of a text, whatever the
    size of the data, so they may be collected.
    """
    total = texts.count()
    counts = texts.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return [r["word"] for r in counts.where(F.col("n") > max(COMMON_LEAST, total / COMMON_SHARE)).collect()]


def _spoilt(word: str, most: int) -> set[str]:
    """The word with up to ``most`` letters taken out: words within so many edits have one in common."""
    out = level = {word}
    for _ in range(most):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out = out | level
    return out


def lacks_solid_words(words: Column, common: list[str]) -> Column:
    """Whether a wording has too few rare words that are no slip of a common or framing word."""
    usual = set(common)
    near = {x for w in {*common, *FRAME_WORDS} for x in _spoilt(w, _slips(w))}

    @F.pandas_udf(T.BooleanType())
    def lacks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        solid: dict[str, int] = {}
        for batch in batches:
            out = []
            for ws in batch:
                for w in ws:
                    if w not in solid:
                        solid[w] = 0 if w in usual or not near.isdisjoint(_spoilt(w, _slips(w))) else len(w)
                letters = [solid[w] for w in ws if solid[w]]
                out.append(len(letters) < SOLID_WORDS or sum(letters) < SOLID_LETTERS)
            yield pd.Series(out, dtype=bool)

    return lacks(words)


def _close(a: str, b: str, most: int) -> bool:
    """Whether a takes at most ``most`` edits to b, a swap of neighbours being one."""
    if abs(len(a) - len(b)) > most:
        return False
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        if min(row) > most:
            return False
        before, last = last, row
    return last[-1] <= most


def _slips(word: str) -> int:
    return 0 if len(word) < 3 or any(c.isdigit() for c in word) else 1 if len(word) < 6 else 2


def _frames(word: str, known: dict) -> bool:
    """Whether a word is a framing word but for a slip; ``known`` remembers words already seen."""
    if word not in known:
        known[word] = any(_close(word, v, min(_slips(word), 2 if len(v) > 4 else 1)) for v in FRAME_WORDS)
    return known[word]


def same_wording(a: str, b: str, value_a: str = "", value_b: str = "", known: dict | None = None) -> bool:
    """Whether two wordings name the same things but for slips of spelling and framing words."""
    known = {} if known is None else known
    left, right = a.split(), b.split()
    for w in list(left):
        if w in right:
            left.remove(w)
            right.remove(w)
    for w in list(left):
        partner = next((v for v in right if _close(w, v, min(_slips(w), _slips(v)))), None)
        if partner is not None:
            left.remove(w)
            right.remove(partner)
    if left and right and _close("".join(left), "".join(right), 1):
        return True
    values = value_a.split() + value_b.split()

    def matters(w: str) -> bool:
        return not (_frames(w, known) or any(_close(w, v, min(_slips(w), 2 if len(v) > 4 else 1)) for v in values))

    rest = [w for w in left if matters(w)], [w for w in right if matters(w)]
    if not rest[0] and not rest[1]:
        return True
    return bool(rest[0] and rest[1]) and _close("".join(rest[0]), "".join(rest[1]), 1)


def _search(evaluation: pd.DataFrame, training: pd.DataFrame, column: str, known: dict, out_a: list, out_b: list) -> None:
    """Add the wordings of the two sides that match in ``column`` and pass the check."""
    if evaluation.empty or training.empty:
        return
    key_e, key_t = evaluation["key"].to_numpy(), training["key"].to_numpy()
    index = BackwardIndex(evaluation[column].tolist(), key_e)
    size_e, size_t = evaluation[column].str.len().to_numpy(), training[column].str.len().to_numpy()
    ordered_e, ordered_t = evaluation["ordered"].tolist(), training["ordered"].tolist()
    value_e, value_t = evaluation["value"].tolist(), training["value"].tolist()
    id_e, id_t = evaluation["wording"].to_numpy(), training["wording"].to_numpy()
    texts = training[column].tolist()
    for begin in range(0, len(texts), STREAMED):
        t, s, e, doc = maximal_matches(index, texts[begin : begin + STREAMED], key_t[begin : begin + STREAMED], LEAST_MATCH, index.size)
        if not len(t):
            continue
        t += begin
        order = np.lexsort((s, doc, t))
        t, doc, s, e = t[order], doc[order], s[order], e[order]
        fresh = np.concatenate([[True], (t[1:] != t[:-1]) | (doc[1:] != doc[:-1])])
        pair = np.cumsum(fresh) - 1
        # Merge spans: what each adds beyond the furthest end so far within its pair.
        wide = int(e.max()) + 1
        furthest = np.maximum.accumulate(pair * wide + e)
        reached = np.concatenate([[0], furthest[:-1] - pair[1:] * wide]).clip(min=0)
        reached[fresh] = 0
        covered = np.bincount(pair, weights=(e - np.maximum(s, reached)).clip(min=0))
        t, doc = t[fresh], doc[fresh]
        enough = covered >= LEAST_COVER * np.minimum(size_t[t], size_e[doc])
        for i, j in zip(t[enough], doc[enough]):
            if same_wording(ordered_t[i], ordered_e[j], value_t[i], value_e[j], known):
                out_a.append(id_t[i])
                out_b.append(id_e[j])


def _search_shard(shard: pd.DataFrame) -> pd.DataFrame:
    """(a, b): wordings of the two sides that pass the check, within one shard."""
    evaluation, training = shard[~shard["training"]], shard[shard["training"]]
    nothing = pd.DataFrame({"a": np.zeros(0, dtype=np.int64), "b": np.zeros(0, dtype=np.int64)})
    # A text whose key has no partner in the shard can have none in the data.
    routed = set(evaluation["routed"]) & set(training["routed"])
    evaluation = evaluation[evaluation["routed"].isin(routed)].reset_index(drop=True)
    training = training[training["routed"].isin(routed)].reset_index(drop=True)
    if evaluation.empty or training.empty:
        return nothing
    # Questions and facts of one key are told apart as well.
    for side in (evaluation, training):
        side["key"] = side["routed"].to_numpy() ^ side["kind"].eq("f").to_numpy()
    # Wordings without solid words meet all of their key, with all words; the others meet by their rare words.
    out_a, out_b, known = [], [], {}
    for e, t, column in ((~evaluation["weak"], ~training["weak"], "content"), (evaluation["weak"], training["key"].notna(), "full"), (~evaluation["weak"], training["weak"], "full")):
        shared = set(evaluation["key"][e]) & set(training["key"][t])
        _search(evaluation[e & evaluation["key"].isin(shared)], training[t & training["key"].isin(shared)], column, known, out_a, out_b)
    return pd.DataFrame({"a": np.array(out_a, dtype=np.int64), "b": np.array(out_b, dtype=np.int64)})


def matching_wordings(told: DataFrame, shard_wordings: int = SHARD_WORDINGS, exact: bool = False) -> DataFrame:
    """(a, b): the wordings of training and evaluation records that match.

    ``exact`` searches every wording with all its words, however common, among all of its key: work grows
    with the square of a key's wordings, and the result does not depend on which words are common.
    """
    texts = told.select("training", "routed", "value", F.explode("wordings").alias("w")).select("training", "routed", "value", "w.*")
    common = [] if exact else common_words(texts)
    rare = F.filter("words", lambda w: ~w.isin(*common)) if common else F.col("words")
    distinct = texts.groupBy("wording", "training").agg(
        F.first("routed").alias("routed"), F.first("kind").alias("kind"), F.first("words").alias("words"),
        F.min("ordered").alias("ordered"), F.min("value").alias("value"))
    weak = F.lit(True) if exact else lacks_solid_words(F.col("words"), common)
    distinct = cut(distinct.withColumn("weak", weak).select(
        "wording", "training", "routed", "kind", "ordered", "value", "weak", F.array_join("words", " ").alias("full"), F.array_join(rare, " ").alias("content")))
    # Only keys seen on both sides can give pairs.
    keys = cut(distinct.groupBy("routed").agg(
        F.sum(F.col("training").cast("bigint")).alias("nt"), F.sum((~F.col("training")).cast("bigint")).alias("ne")).where("nt > 0 AND ne > 0"))
    total = keys.agg(F.sum(F.col("nt") + F.col("ne"))).first()[0] or 0
    shards = max(1, -(-total // shard_wordings))
    # A key that fits no shard is a grid: its evaluation wordings are dealt over ``be`` blocks, its training
    # wordings over ``bt``, and each row goes to the cells of its block; other keys are a grid of one cell.
    large = F.col("nt") + F.col("ne") > shard_wordings
    keys = keys.select("routed", F.when(large, F.ceil(F.col("ne") / (shard_wordings // 4))).otherwise(1).cast("int").alias("be"), F.when(large, F.ceil(F.col("nt") / shard_wordings)).otherwise(1).cast("int").alias("bt"))
    met = skewed_lookup(distinct, keys, "routed", cut(heavy_keys(distinct, "routed")), "inner")
    mine = F.pmod("wording", F.when(F.col("training"), F.col("bt")).otherwise(F.col("be")).cast("bigint")).cast("int")
    met = met.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("training"), F.col("be")).otherwise(F.col("bt")) - 1)))
    cell = F.concat_ws(":", F.col("routed").cast("string"), F.when(F.col("training"), F.col("other")).otherwise(F.col("mine")).cast("string"), F.when(F.col("training"), F.col("mine")).otherwise(F.col("other")).cast("string"))
    shard = F.when(F.col("be") * F.col("bt") == 1, F.pmod(F.xxhash64("routed", F.lit(7)), F.lit(shards)).cast("string")).otherwise(cell)
    return met.withColumn("shard", shard).drop("be", "bt", "mine", "other").groupBy("shard").applyInPandas(_search_shard, "a bigint, b bigint").distinct()


def class_pairs(told: DataFrame, shard_wordings: int = SHARD_WORDINGS, exact: bool = False) -> DataFrame:
    """(t, e): classes of training and of evaluation records that overlap by one wording or both."""
    found = cut(matching_wordings(told, shard_wordings, exact))
    named = told.select("class", "training", F.explode("wordings.wording").alias("wording")).distinct()
    return cut(
        found.join(named.where("training").select(F.col("wording").alias("a"), F.col("class").alias("t")), "a")
        .join(named.where("NOT training").select(F.col("wording").alias("b"), F.col("class").alias("e")), "b").select("t", "e").distinct())


def overlapping_pairs(rows: DataFrame, record_id: str, question: str, fact: str, value: str, split: str,
                      training: str, evaluation: list[str], shard_wordings: int = SHARD_WORDINGS, exact: bool = False) -> DataFrame:
    """(record_a, record_b), a < b: rows of a training and an evaluation split that overlap."""
    told = cut(records_with_wordings(rows, record_id, question, fact, value, split, training, evaluation))
    pairs = class_pairs(told, shard_wordings, exact)
    for role, column, name in (("training", "t", "x"), ("NOT training", "e", "y")):
        members = told.where(role).select(F.col("class").alias(column), F.col("record").alias(name))
        pairs = salted_join(pairs, members, column, cut(heavy_keys(members, column)), name)
    return pairs.select(F.least("x", "y").alias("record_a"), F.greatest("x", "y").alias("record_b"))


def overlap_counts(rows: DataFrame, record_id: str, question: str, fact: str, value: str, split: str, source: str,
                   training: str, evaluation: list[str], shard_wordings: int = SHARD_WORDINGS) -> DataFrame:
    """(split, source, records, overlapping_records, overlapping_pairs) over the evaluation splits.

    Pairs are counted by class and never spelled out.
    """
    told = cut(records_with_wordings(rows, record_id, question, fact, value, split, training, evaluation))
    sizes = told.where("training").groupBy(F.col("class").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    partners = class_pairs(told, shard_wordings).join(sizes, "t").groupBy(F.col("e").alias("class")).agg(F.sum("n").alias("pairs"))
    named = rows.where(F.col(split).isin(*evaluation)).select(F.col(record_id).alias("record"), F.col(split).alias("split"), F.col(source).alias("source"))
    groups = told.where("NOT training").select("record", "class").join(named, "record").groupBy("class", "split", "source").agg(F.count(F.lit(1)).alias("records"))
    return groups.join(partners, "class", "left").groupBy("split", "source").agg(
        F.sum("records").alias("records"), F.sum(F.when(F.col("pairs").isNotNull(), F.col("records")).otherwise(0)).alias("overlapping_records"),
        F.sum(F.col("records") * F.coalesce("pairs", F.lit(0))).alias("overlapping_pairs"))
