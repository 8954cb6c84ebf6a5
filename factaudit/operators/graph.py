"""Components, reachability and fixed points over edge tables.

Labels move by joins of rows; each round is written to the checkpoint folder, so that no plan grows
with the number of rounds, and rounds stop when nothing changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factaudit.session import cut


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node of each node's component; edges are (src, dst), undirected.

    Each round a node takes the least label among its neighbours' and then the label of that label
    (pointer jumping), so long chains halve.
    """
    both = cut(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    labels = cut(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("component")))
    for _ in range(max_rounds):
        heard = both.join(labels.select(F.col("node").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("m"))
        met = labels.join(heard, "node").select("node", F.least("component", "m").alias("c"), F.col("component").alias("old"))
        jump = met.join(labels.select(F.col("node").alias("c"), F.col("component").alias("j")), "c", "left")
        new = cut(jump.select("node", F.least("c", F.coalesce("j", "c")).alias("component"), "old"))
        changed = new.where("component <> old").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels
    raise RuntimeError(f"no stable components after {max_rounds} rounds")


def reachable(seeds: DataFrame, edges: DataFrame, node: str = "node", max_rounds: int = 60) -> DataFrame:
    """(node, hops) of all nodes reached from the seeds along undirected edges, seeds at 0."""
    both = cut(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    seen = cut(seeds.select(F.col(node).alias("node")).distinct().withColumn("hops", F.lit(0)))
    frontier = seen
    for hop in range(1, max_rounds + 1):
        step = both.join(frontier.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen, "node", "left_anti").withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            return seen
        seen = cut(seen.unionByName(frontier))
    raise RuntimeError(f"frontier not empty after {max_rounds} rounds")


def supported(items: DataFrame, donors: DataFrame, key: str, donor: str, max_rounds: int = 60) -> DataFrame:
    """(key, round): items left when those without a remaining donor are dropped, again and again.

    ``donors`` (key, donor) names what supports what.  ``round`` is null for items that stay, else the
    synchronous round in which the item was dropped.
    """
    state = cut(items.select(key).distinct().withColumn("round", F.lit(None).cast("int")))
    for n in range(1, max_rounds + 1):
        alive = state.where("round IS NULL").select(key)
        held = donors.join(alive.withColumnRenamed(key, donor), donor, "left_semi").select(key).distinct().withColumn("held", F.lit(True))
        new = cut(state.join(held, key, "left").select(key, F.coalesce("round", F.when(F.col("held").isNull(), F.lit(n))).alias("round")))
        dropped = new.where(F.col("round") == n).limit(1).count()
        state = new
        if not dropped:
            return state
    raise RuntimeError(f"still dropping after {max_rounds} rounds")


#: Weights of the costs of a placement: all members, members beyond the target, and each named feature.
SIZE_WEIGHT, OVERFLOW_WEIGHT = 12.0, 25.0


def whole_targets(total: int, shares: dict[str, float]) -> dict[str, int]:
    """Whole numbers nearest the shares of a total: what is left goes to the largest fractions, first split first."""
    import math

    targets = {s: math.floor(total * w) for s, w in shares.items()}
    order = sorted(shares, key=lambda s: (-(total * shares[s] - targets[s]), list(shares).index(s)))
    for s in order[: total - sum(targets.values())]:
        targets[s] += 1
    return targets


def greedy_splits(components: DataFrame, key: str, size: str, pinned: str | None, features: dict[str, float], shares: dict[str, float], seed: str, limit: int | None = None) -> DataFrame:
    """(key, split): components placed one by one where they cost least.

    Pinned components go first, to their split.  The others follow by size, ties by a hash of seed and key.
    The cost of a split is the change of the squared relative distance from its target, for all members and
    for every value of each feature (a map column value -> members, with its weight), plus a penalty on what
    goes beyond the target; equal costs are decided by a hash of seed, key and split.

    Every choice depends on the ones before, so one task walks the components that are not pinned.  They are
    sorted by Spark and stream through it; it holds the counts per split and value of a feature only, so
    their number is bounded by time alone.  A ``limit`` refuses more components than that.
    """
    import hashlib
    from collections.abc import Iterator

    import pandas as pd

    made = cut(components.select(F.col(key).cast("string").alias(key), F.col(size).cast("bigint").alias("__n"), (F.col(pinned) if pinned else F.lit(None)).cast("string").alias("__pin"), *features))
    whole = made.agg(F.count(F.lit(1)).alias("components"), F.coalesce(F.sum("__n"), F.lit(0)).alias("members")).first()
    if limit is not None and whole["components"] > limit:
        raise ValueError(f"{whole['components']} components are more than one task should walk ({limit})")
    targets = whole_targets(int(whole["members"]), shares)
    fixed_sizes = {r["__pin"]: int(r["n"]) for r in made.where("__pin IS NOT NULL").groupBy("__pin").agg(F.sum("__n").alias("n")).collect()}
    if unknown := set(fixed_sizes) - set(shares):
        raise ValueError(f"pinned to splits without a share: {sorted(unknown)}")
    totals: dict = {}
    fixed_counts: dict = {}
    for f in features:
        for r in made.select("__pin", F.explode(f).alias("value", "c")).groupBy("__pin", "value").agg(F.sum("c").alias("c")).collect():
            totals[f, r["value"]] = totals.get((f, r["value"]), 0) + int(r["c"])
            if r["__pin"] is not None:
                fixed_counts[f, r["value"], r["__pin"]] = int(r["c"])

    def digest(*parts: str) -> str:
        return hashlib.sha256("\x1f".join(parts).encode()).hexdigest()

    def change(now: float, more: float, target: float) -> float:
        scale = max(1.0, target)
        return ((now + more - target) / scale) ** 2 - ((now - target) / scale) ** 2

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, counts = {s: fixed_sizes.get(s, 0) for s in shares}, dict(fixed_counts)
        for rows in batches:
            keys, out = rows[key].tolist(), []
            maps = {f: [sorted(dict(m).items()) if m is not None else [] for m in rows[f]] for f in features}
            for i, n in enumerate(rows["__n"].tolist()):
                costs = {}
                for split, share in shares.items():
                    cost = SIZE_WEIGHT * change(held[split], n, targets[split])
                    for f, weight in features.items():
                        cost += weight * sum(change(counts.get((f, value, split), 0), c, totals[f, value] * share) for value, c in maps[f][i])
                    beyond = max(0, held[split] + n - targets[split])
                    costs[split] = cost + OVERFLOW_WEIGHT * (beyond / max(1, targets[split])) ** 2
                least = min(costs.values())
                equal = [s for s in costs if costs[s] == least]
                split = equal[0] if len(equal) == 1 else min(equal, key=lambda s: (digest(seed, keys[i], s), s))
                held[split] += n
                for f in features:
                    for value, c in maps[f][i]:
                        counts[f, value, split] = counts.get((f, value, split), 0) + c
                out.append(split)
            yield pd.DataFrame({key: keys, "split": out})

    ordered = made.where("__pin IS NULL").repartition(1).sortWithinPartitions(F.desc("__n"), F.sha2(F.concat(F.lit(seed + "\x1f"), key), 256), key)
    placed = ordered.select(key, "__n", *features).mapInPandas(walk, f"{key} string, split string")
    return made.where("__pin IS NOT NULL").select(key, F.col("__pin").alias("split")).unionByName(placed)
