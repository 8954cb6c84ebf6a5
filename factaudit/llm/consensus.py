"""Consensus of disagreeing annotators by spectral reliability.

For each label the annotators' answers are read as "this label" or "another one".  The chance-centred
agreement of two annotators - how often both say the label, less what chance gives, over the items
they share - is the product of what each knows of the label, so the leading eigenvector of the
agreement matrix is every annotator's reliability on that label.  One who swaps two labels has negative
reliability on both and a positive one on the rest; one who always says the same has none.  Rows of the
matrix are weighted by overlap.  Power iteration runs as sparse joins over (label, annotator,
annotator) rows until nothing moves by more than ``TOLERANCE``.

With the share of items a label is true for, reliability gives the odds that an annotator says the label
where it is true and where it is not; their logarithms weight the votes, and the label with the most
weight is the consensus.  The shares start as shares of votes and are those of the consensus as soon as
they settle.  Field conflicts noted beside a vote add their own log odds, counted once over all items;
only where these differ from chance by more than ``NOTE_ERRORS`` standard errors.

Per annotator and item only the last non-null label by ``created_at`` counts (ties: the later arrival,
then the greater id).  Spelling of labels is ignored (case, outer blanks, blanks and hyphens between
words).

Defined results: a null label, item or annotator gives no vote; rows that come twice count once; an
item with one label, or whose labels agree, keeps that label; exact ties go to the label with more
votes, then to the smaller label; an annotator who shares no item with another has a reliability of 0
and their votes weigh nothing; empty input gives empty results.

Scale: votes are aggregated to one row per (item, annotator) before anything is grouped by item, so a
hot packet, annotator or item is no hot key of a shuffle.  Pairs are counted within an item's array;
the counts have at most (annotators x labels) squared rows.  Weights are broadcast only while their
number, which is counted, is at most ``BROADCAST_ROWS``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factaudit.session import cut

#: A reliability has settled when a round moves none by more than this.
TOLERANCE = 1e-4
#: Rounds between two tests of that, and the most rounds before giving up with an error.
ROUNDS, MOST_ROUNDS = 6, 600
#: The shares of the labels have settled when none moves by more than this; the most rounds of it.
SHARE_TOLERANCE, MOST_SHARE_ROUNDS = 1e-3, 50
NOTE_ERRORS = 4.0
#: More labels than this are no set of labels.
MOST_LABELS = 200
BROADCAST_ROWS = 100_000
#: Edges that one task holds with ease; beyond, they are dealt out.
ONE_TASK_EDGES = 1_000_000
#: Stands for all labels together.
ALL = "*"


def plain_label(label: Column) -> Column:
    """A label without differences of case, outer blanks, and blanks or hyphens between words."""
    trimmed = F.regexp_replace(F.lower(label), r"^[\s ]+|[\s ]+$", "")
    return F.nullif(F.regexp_replace(trimmed, r"[\s _-]+", "_"), F.lit(""))


def last_votes(rows: DataFrame, item: str, annotator: str, label: str, at: str, arrived: str, row_id: str, conflicts: str | None = None) -> DataFrame:
    """(item, annotator, label, conflicts): the last label each annotator gave each item.

    ``conflicts`` is the number of field conflicts noted there (0 to 3 and more, -1 for null).
    """
    number = F.coalesce(F.least(F.size(F.col(conflicts)), F.lit(3)), F.lit(-1)) if conflicts else F.lit(-1)
    return (
        rows.select(F.col(item).alias("item"), F.col(annotator).alias("annotator"), plain_label(F.col(label)).alias("label"),
                    number.alias("n"), F.col(at).alias("t"), F.col(arrived).alias("u"), F.col(row_id).alias("i"))
        .where("item IS NOT NULL AND annotator IS NOT NULL AND label IS NOT NULL")
        .groupBy("item", "annotator").agg(F.max_by(F.struct("label", "n"), F.struct("t", "u", "i")).alias("v"))
        .select("item", "annotator", "v.label", F.col("v.n").alias("conflicts"))
    )


def items_of(votes: DataFrame) -> DataFrame:
    """One row per item with its votes as an array; an item has at most one vote per annotator."""
    return votes.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("annotator", "label", "conflicts"))).alias("votes"))


def _in_one_task(rows: DataFrame) -> DataFrame:
    """A small table as a single partition, so that joins and sums over it need no shuffle."""
    return rows.coalesce(1) if rows.count() <= ONE_TASK_EDGES else rows


def _labels(items: DataFrame) -> list[str]:
    """All labels, in order; a column with more than MOST_LABELS of them is refused."""
    found = [r["label"] for r in items.select(F.explode("votes.label").alias("label")).distinct().limit(MOST_LABELS + 1).collect()]
    if len(found) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} different labels")
    return sorted(found)


def agreement(items: DataFrame) -> DataFrame:
    """(label, a, b, shared, centred): chance-centred agreement per label and over all of them.

    ``shared`` is the number of items that both annotators labelled.
    """
    others = F.filter("votes", lambda v: v["annotator"] > F.col("x.annotator"))
    counts = (
        items.where("size(votes) >= 2").select(F.explode("votes").alias("x"), "votes").select("x", F.explode(others).alias("y"))
        .groupBy(F.col("x.annotator").alias("a"), F.col("x.label").alias("la"), F.col("y.annotator").alias("b"), F.col("y.label").alias("lb"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    counts = _in_one_task(cut(counts))
    counts = counts.unionByName(counts.select(F.col("b").alias("a"), F.col("lb").alias("la"), F.col("a").alias("b"), F.col("la").alias("lb"), "n"))
    told = counts.select("a", "b", "la", "lb", "n", F.explode(F.array_distinct(F.array("la", "lb"))).alias("label")).groupBy("a", "b", "label").agg(
        F.sum(F.when(F.col("la") == F.col("label"), F.col("n")).otherwise(0)).alias("na"), F.sum(F.when(F.col("lb") == F.col("label"), F.col("n")).otherwise(0)).alias("nb"),
        F.sum(F.when((F.col("la") == F.col("label")) & (F.col("lb") == F.col("label")), F.col("n")).otherwise(0)).alias("both"))
    shared = counts.groupBy("a", "b").agg(F.sum("n").alias("shared"))
    # A pair that never says a label shares its items all the same.
    grid = shared.crossJoin(F.broadcast(counts.select(F.col("la").alias("label")).distinct()))
    chance = F.col("na") / F.col("shared") * (F.col("nb") / F.col("shared"))
    each = grid.join(told, ["a", "b", "label"], "left").fillna(0, ["na", "nb", "both"]).select("label", "a", "b", "shared", (F.col("both") / F.col("shared") - chance).alias("centred"))
    return each.unionByName(each.groupBy("a", "b").agg(F.first("shared").alias("shared"), F.sum("centred").alias("centred")).select(F.lit(ALL).alias("label"), "a", "b", "shared", "centred"))


def reliabilities(items: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(label, annotator, reliability, shared): leading eigenvectors of the agreement matrices.

    Overlap correction: an entry is weighted by shared / (shared + mean overlap), so that a pair with
    few common items says little.  The diagonal, which says nothing, is left out: a step is the least
    squares of centred(a, b) = r(a) r(b) in r(a), a power step on the matrix with its diagonal filled
    from the current estimate.  Steps are halved, which damps swings and moves no fixed point.
    """
    _labels(items)
    edges = agreement(items)
    mean = edges.agg(F.avg("shared").alias("m"))
    edges = edges.crossJoin(F.broadcast(mean)).select("label", "a", "b", "shared", F.col("centred").alias("c"), (F.col("shared") / (F.col("shared") + F.col("m"))).alias("w"))
    # An edge of no weight from each annotator to itself carries the old value through a step, so that a
    # step reads the vector once and the plan of several steps grows with their number only.  Both sides
    # of a small join are one partition already, so a hash join there needs no exchange.
    own = edges.select("label", "a").distinct().select("label", "a", F.col("a").alias("b"), F.lit(0).cast("bigint").alias("shared"), F.lit(0.0).alias("c"), F.lit(0.0).alias("w"))
    edges = _in_one_task(cut(edges.unionByName(own)))
    vector = edges.groupBy("label", "a").agg(F.lit(1.0).alias("r"), F.lit(1.0).alias("old"), F.lit(1.0).alias("older"))
    done = 0
    while True:
        for _ in range(ROUNDS):
            vector = (
                edges.join(vector.select("label", F.col("a").alias("b"), F.col("r").alias("rb"), F.col("old").alias("ob")).hint("shuffle_hash"), ["label", "b"])
                .groupBy("label", "a").agg(
                    F.try_divide(F.sum(F.col("w") * F.col("c") * F.col("rb")), F.sum(F.col("w") * F.col("rb") * F.col("rb"))).alias("new"),
                    F.max(F.when(F.col("a") == F.col("b"), F.col("rb"))).alias("old"), F.max(F.when(F.col("a") == F.col("b"), F.col("ob"))).alias("older"))
                .select("label", "a", ((F.coalesce(F.col("new"), F.lit(0.0)) + F.col("old")) / 2).alias("r"), "old", "older")
            )
        vector = cut(vector)
        done += ROUNDS
        if (vector.agg(F.max(F.abs(F.col("r") - F.col("old")))).first()[0] or 0.0) <= tolerance:
            shared = edges.groupBy("label", "a").agg(F.sum("shared").alias("shared"))
            return vector.join(shared, ["label", "a"]).select("label", F.col("a").alias("annotator"), F.col("r").alias("reliability"), "shared")
        if done >= MOST_ROUNDS:
            raise RuntimeError(f"reliabilities have not settled after {done} rounds")
        # Steps that shrink by a steady factor are summed to their limit (Aitken's extrapolation).
        step = F.col("r") - F.col("old")
        factor = F.greatest(F.lit(0.0), F.least(F.lit(0.95), F.coalesce(F.try_divide(step, F.col("old") - F.col("older")), F.lit(0.0))))
        vector = vector.withColumn("r", F.col("r") + step * factor / (1 - factor))


def reliability(items: DataFrame) -> DataFrame:
    """(annotator, reliability, shared): the leading eigenvector of the agreement over all labels."""
    return reliabilities(items).where(F.col("label") == ALL).select("annotator", "reliability", "shared")


def _clipped(p: Column) -> Column:
    return F.greatest(F.lit(0.005), F.least(F.lit(0.995), p))


def _weights(skill: DataFrame, labels: list[str], shares: dict[str, float], small: bool) -> DataFrame:
    """(annotator, label, w): log odds, in the order of ``labels``, that a vote gives each label.

    ``skill`` has (annotator, r, p): per label the reliability and how often the annotator says it.
    """
    yes, no = [], []
    for name in labels:
        share = F.lit(min(max(shares[name], 1e-6), 1 - 1e-6))
        r, p = F.coalesce(F.col("r")[name], F.lit(0.0)) / F.sqrt(share * (1 - share)), F.coalesce(F.col("p")[name], F.lit(0.0))
        true, false = _clipped(p + (1 - share) * r), _clipped(p - share * r)
        yes.append(F.log(true / false))
        no.append(F.log((1 - true) / (1 - false)))
    said = F.explode(F.array(*[
        F.struct(F.lit(name).alias("label"), F.array(*[y if i == j else n for j, (y, n) in enumerate(zip(yes, no))]).alias("w")) for i, name in enumerate(labels)])).alias("said")
    rows = skill.select("annotator", said).select("annotator", "said.label", "said.w")
    return F.broadcast(rows) if small else rows


def _scored(items: DataFrame, labels: list[str], shares: dict[str, float], weights: DataFrame, notes: dict | None = None) -> DataFrame:
    """(item, votes, score, p, n): per item and label (in order) the log odds, posterior and votes."""
    votes = items.select("item", F.explode("votes").alias("x")).select("item", "x.annotator", "x.label", "x.conflicts")
    met = votes.join(weights, ["annotator", "label"])
    sums = [F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(len(labels))] + [F.sum((F.col("label") == name).cast("int")).alias(f"n{i}") for i, name in enumerate(labels)]
    if notes:
        for i, name in enumerate(labels):
            told = F.lit(0.0)
            for (said, conflicts, label), weight in sorted(notes.items()):
                if label == name:
                    told = F.when((F.col("label") == said) & (F.col("conflicts") == conflicts), weight).otherwise(told)
            sums.append(F.sum(told).alias(f"t{i}"))
    scores = met.groupBy("item").agg(*sums)
    odds = []
    for i, name in enumerate(labels):
        share = min(max(shares[name], 1e-6), 1 - 1e-6)
        whole = F.col(f"s{i}") + F.log(F.lit(share / (1 - share)))
        odds.append(whole + F.col(f"t{i}") if notes else whole)
    scores = scores.select("item", F.array(*odds).alias("score"), F.array(*[F.col(f"n{i}") for i in range(len(labels))]).alias("n"))
    scores = scores.withColumn("e", F.transform("score", lambda s: F.exp(s - F.array_max("score"))))
    return scores.select("item", "score", "n", F.transform("e", lambda e: e / F.aggregate("e", F.lit(0.0), lambda a, x: a + x)).alias("p"))


def _note_weights(items: DataFrame, labels: list[str], scored: DataFrame) -> dict:
    """{(said, conflicts, label): log odds} of what notes beside a vote tell, where it is no chance."""
    votes = items.select("item", F.explode("votes").alias("x")).select("item", F.col("x.label").alias("said"), "x.conflicts")
    mass = votes.join(scored, "item").groupBy("said", "conflicts").agg(*[F.sum(F.col("p")[i]).alias(f"c{i}") for i in range(len(labels))])
    # One row per label and number of conflicts (-1 to 3): at most five times MOST_LABELS.
    table = {(r["said"], r["conflicts"]): [r[f"c{i}"] for i in range(len(labels))] for r in mass.collect()}
    out = {}
    for said in {s for s, _ in table}:
        rows = {k: v for (s, k), v in table.items() if s == said}
        by_label = [sum(v[i] for v in rows.values()) for i in range(len(labels))]
        everything = sum(by_label)
        for k, v in rows.items():
            for i, name in enumerate(labels):
                if v[i] >= 1.0 and by_label[i] > v[i]:
                    odds = (v[i] / by_label[i]) / (sum(v) / everything)
                    error = (1 / v[i] - 1 / by_label[i]) ** 0.5
                    if abs(math.log(odds)) > NOTE_ERRORS * error:
                        out[said, k, name] = math.log(odds)
    return out


def consensus(items: DataFrame, skills: DataFrame | None = None) -> DataFrame:
    """(item, label, confidence, support, agreement, labels, most): one consensus label per item.

    ``skills`` are the ``reliabilities`` of the annotators.  ``agreement`` is the share of the item's
    label pairs that agree (null for a single label); ``confidence`` the posterior of the label;
    ``support`` the number of labels that equal it, ``most`` the largest number of labels that are the
    same.
    """
    labels = _labels(items)
    if not labels:
        return items.sparkSession.createDataFrame([], "item string, label string, confidence double, support bigint, agreement double, labels bigint, most bigint")
    skills = reliabilities(items) if skills is None else skills
    said = items.select(F.explode("votes").alias("x")).groupBy(F.col("x.annotator").alias("annotator"), F.col("x.label").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    said = cut(said)
    votes = {r["label"]: r["n"] for r in said.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    shares = {name: votes[name] / sum(votes.values()) for name in labels}
    total = F.aggregate(F.map_values("n"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    usual = said.groupBy("annotator").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("n")).select("annotator", F.transform_values("n", lambda _, n: n / total).alias("p"))
    known = skills.where(F.col("label") != ALL).groupBy("annotator").agg(F.map_from_entries(F.collect_list(F.struct("label", "reliability"))).alias("r"))
    skill = cut(usual.join(known, "annotator", "left"))
    small = skill.count() * len(labels) <= BROADCAST_ROWS
    for _ in range(MOST_SHARE_ROUNDS):
        scored = _scored(items, labels, shares, _weights(skill, labels, shares, small))
        means = scored.agg(*[F.avg(F.col("p")[i]).alias(f"m{i}") for i in range(len(labels))]).first()
        before, shares = shares, {name: means[f"m{i}"] for i, name in enumerate(labels)}
        if max(abs(shares[name] - before[name]) for name in labels) <= SHARE_TOLERANCE:
            break
    else:
        raise RuntimeError(f"shares of labels have not settled after {MOST_SHARE_ROUNDS} rounds")
    weights = _weights(skill, labels, shares, small)
    notes = _note_weights(items, labels, _scored(items, labels, shares, weights))
    scored = _scored(items, labels, shares, weights, notes)
    many = F.aggregate("n", F.lit(0).cast("bigint"), lambda a, x: a + x)
    options = F.array(*[
        F.struct(F.round(F.col("p")[i], 9).alias("p"), F.col("n")[i].alias("n"), F.lit(-i).alias("order"), F.lit(name).alias("label")) for i, name in enumerate(labels)])
    same = F.aggregate("n", F.lit(0).cast("bigint"), lambda a, x: a + x * (x - 1))
    decided = scored.select("item", "n", many.alias("labels"), F.array_max("n").alias("most"), same.alias("same"), options.alias("options"))
    # Where all labels agree there is nothing to decide.
    undisputed = F.filter("options", lambda o: o["n"] == F.col("labels"))
    chosen = F.when(F.size(undisputed) == 1, undisputed[0]).otherwise(F.array_max("options"))
    return decided.withColumn("best", chosen).select(
        "item", F.col("best.label").alias("label"), F.col("best.p").alias("confidence"), F.col("best.n").alias("support"),
        F.try_divide(F.col("same").cast("double"), F.col("labels") * (F.col("labels") - 1)).alias("agreement"), "labels", "most")
