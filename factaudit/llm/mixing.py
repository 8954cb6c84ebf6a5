"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source is wanted c times, c being the source's share of the mix over the source's
size, at most its cap of repeats.  The whole part of c is given to every document; of the rest, a
fraction f per document, pairs of documents are played against each other: mass (in tokens) moves from
one to the other, in a direction drawn so that each keeps its expectation, until one of them is out or
in.  So every document's expected copies are c, and the tokens of the mix are met but for one document
per source.  Each block of documents is played out by itself and leaves one undecided document per
source; the undecided ones of several blocks are played out together, in a reduction tree.

The draw uses hashes of document ids, blocks hold about ``BLOCK`` documents whatever the session's settings,
and each is sorted, so the mix depends on the documents alone and a task that is run again decides alike.

Defined results: a document without a listed source is left out; a document without tokens gets no
copy; a source without documents contributes nothing, and one too small gives all it may (its cap of
repeats for every document); shares reached are reported against the whole mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factaudit.session import cut

#: How many blocks are played out together at each level of the reduction tree.
FAN_IN = 16
#: About how many documents a block of the first level holds.
BLOCK = 20_000


def _draw(a: str, b: str) -> float:
    from xxhash import xxh64_intdigest

    return (xxh64_intdigest(f"{a}\x1f{b}") >> 11) / float(1 << 53)


def _play(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rounds fractions to 0 or 1 within each block; one row per block and source may stay undecided."""
    held: dict[str, list] = {}
    now = None
    for batch in batches:
        done = []
        for block, doc, source, tokens, f in zip(batch["block"], batch["doc"], batch["source"], batch["tokens"], batch["f"]):
            if block != now:
                done += [(d, s, n, g, False) for s, (d, n, g) in held.items()]
                held, now = {}, block
            tokens, f = int(tokens), float(f)
            if f <= 0.0 or f >= 1.0:
                done.append((doc, source, tokens, float(f >= 1.0), True))
                continue
            other = held.pop(source, None)
            if other is None:
                held[source] = [doc, tokens, f]
                continue
            doc0, tokens0, f0 = other
            # Tokens that may move from the new one to the held one, and the other way.
            up = min(f * tokens, (1 - f0) * tokens0)
            down = min(f0 * tokens0, (1 - f) * tokens)
            if _draw(str(doc0), str(doc)) * (up + down) < down:
                move = up
            else:
                move = -down
            f0, f = f0 + move / tokens0, f - move / tokens
            for d, n, g in ((doc0, tokens0, f0), (doc, tokens, f)):
                if g < 1e-9 or g > 1 - 1e-9:
                    done.append((d, source, n, float(g > 0.5), True))
                else:
                    held[source] = [d, n, g]
        yield pd.DataFrame(done, columns=["doc", "source", "tokens", "f", "settled"])
    yield pd.DataFrame([(d, s, n, f, False) for s, (d, n, f) in held.items()], columns=["doc", "source", "tokens", "f", "settled"])


def _settle_last(column: str = "f"):
    """A single undecided document per source: in or out by a draw that keeps its expectation."""
    u = (F.pmod(F.xxhash64("doc", F.lit("last")), F.lit(2**52)).cast("double") + 0.5) / float(2**52)
    return F.when(F.col("settled"), F.col(column)).otherwise((u < F.col(column)).cast("double"))


def wanted_copies(documents: DataFrame, targets: DataFrame, budget: int | None = None) -> DataFrame:
    """(source, available, documents, wanted, copies, target_share, max_repeats) per target source.

    ``documents`` (doc, source, tokens); ``targets`` (source, target_share, max_repeats).  ``budget``
    is the size of the mix in tokens; by default the size of all documents of the listed sources.
    """
    sizes = documents.groupBy("source").agg(F.sum("tokens").alias("available"), F.count(F.lit(1)).alias("documents"))
    stated = targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    known = cut(stated.join(sizes, "source", "left").fillna(0, ["available", "documents"]))
    whole = known.agg(F.sum("available").alias("whole"), F.sum("target_share").alias("shares"))
    size = F.lit(budget) if budget is not None else F.col("whole")
    return known.crossJoin(whole).select(
        "source", "available", "documents", "target_share", "max_repeats",
        (size * F.col("target_share") / F.col("shares")).alias("wanted")
    ).withColumn("copies", F.least(F.coalesce(F.try_divide("wanted", "available"), F.lit(0.0)), F.col("max_repeats").cast("double")))


def mix(documents: DataFrame, targets: DataFrame, budget: int | None = None) -> DataFrame:
    """(doc, source, tokens, copies): how often each document of a listed source is used."""
    plan = cut(wanted_copies(documents, targets, budget)).select("source", "copies")
    # One row per source of the target list, a list written by hand.
    listed = documents.where("tokens > 0").join(plan, "source").withColumn("base", F.floor("copies")).withColumn("f", F.col("copies") - F.floor("copies"))
    listed = cut(listed.select("doc", "source", "tokens", "base", "f"))
    blocks = max(1, -(-listed.count() // BLOCK))
    open_rows = listed.select("doc", "source", "tokens", "f")
    settled, level = [], 0
    schema = "doc {}, source string, tokens bigint, f double, settled boolean".format(documents.schema["doc"].dataType.simpleString())
    while True:
        dealt = open_rows.withColumn("block", F.pmod(F.xxhash64("doc", F.lit(level)), F.lit(blocks)))
        played = cut(dealt.repartition("block").sortWithinPartitions("block", "source", "tokens", "doc").mapInPandas(_play, schema))
        settled.append(played.where("settled"))
        open_rows = played.where("NOT settled").drop("settled")
        if blocks == 1:
            settled.append(played.where("NOT settled").withColumn("f", _settle_last()).withColumn("settled", F.lit(True)))
            break
        blocks, level = max(1, -(-blocks // FAN_IN)), level + 1
    rounded = settled[0]
    for more in settled[1:]:
        rounded = rounded.unionByName(more)
    return (listed.select("doc", "source", "tokens", "base").join(rounded.select("doc", F.col("f").alias("extra")), "doc")
            .select("doc", "source", "tokens", (F.col("base") + F.col("extra")).cast("int").alias("copies")))


def shares(documents: DataFrame, targets: DataFrame, mixed: DataFrame, budget: int | None = None) -> DataFrame:
    """Target and reached share per listed source, with what limited it."""
    plan = wanted_copies(documents, targets, budget)
    used = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    whole = used.agg(F.sum("mixed_tokens").alias("mix"))
    status = (F.when(F.col("available") == 0, "no documents").when(F.col("wanted") > F.col("available") * F.col("max_repeats"), "too small").otherwise("met"))
    return plan.join(used, "source", "left").fillna(0, ["mixed_tokens", "most_copies"]).crossJoin(whole).select(
        "source", "target_share", F.coalesce(F.try_divide(F.col("mixed_tokens").cast("double"), F.col("mix")), F.lit(0.0)).alias("reached_share"),
        "available", "documents", F.round("wanted", 3).alias("wanted_tokens"), "mixed_tokens", "max_repeats", "most_copies", status.alias("status"))
