"""Splits that keep related records together: hash-to-min components, weighted rendezvous hashing.

Records that share a key (group, source, subject) are tied, and ties carry over.  The graph is built
on the keys: a record links its first key to its others, so a key that holds a third of all rows is
one node.  Hash-to-min runs on (node, member) rows: each node sends its cluster to the cluster's
minimum and the minimum to every member, until nothing changes.  The cluster of a large component is
never one value: it is many rows, and its minimum meets them by a broadcast of the few heavy nodes.

Defined results: null keys tie nothing, and a record without keys is a component of its own; repeated
rows share their keys, hence their component; empty input gives empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factaudit.operators.skew import heavy_keys, skewed_lookup
from factaudit.session import cut, release

#: A component with more than this share of the records is placed by hand, before the hashing: at
#: most 1 / LARGE of them exist.
LARGE = 0.01


def hash_to_min(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (src, dst); the component is its least node.

    A node whose only edge leads to itself is a component of one.
    """
    clusters = cut(
        edges.select(F.col("src").alias("v"), F.col("dst").alias("u"))
        .unionByName(edges.select(F.col("dst").alias("v"), F.col("src").alias("u")))
        .unionByName(edges.select(F.col("src").alias("v"), F.col("src").alias("u")))
        .unionByName(edges.select(F.col("dst").alias("v"), F.col("dst").alias("u"))).distinct())
    before = None
    for _ in range(max_rounds):
        mins = cut(clusters.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("size")))
        now = mins.agg(F.sum(F.xxhash64("v", "m", "size").cast("decimal(38,0)")), F.sum("size"), F.max("size")).first()
        if now == before:
            return mins.select(F.col("v").alias("node"), F.col("m").alias("component"))
        before = now
        total = now[1] or 0
        bound = max(1000, total / 1000)
        if (now[2] or 0) > bound:
            heavy = mins.where(F.col("size") > bound).select("v")
            met = skewed_lookup(clusters, mins.select("v", "m"), "v", heavy, "inner")
        else:
            met = clusters.join(mins.select("v", "m"), "v")
        read = clusters, mins
        clusters = cut(
            met.select(F.col("m").alias("v"), "u").unionByName(met.select(F.col("u").alias("v"), F.col("m").alias("u")))
            .unionByName(met.select("v", F.col("m").alias("u"))).distinct())
        release(*read)
    raise RuntimeError(f"no stable components after {max_rounds} rounds")


def tied(rows: DataFrame, record_id: str, keys: list[Column], kept: list[str]) -> DataFrame:
    """The columns ``kept`` and ``component``: each record's component over its non-null ``keys``."""
    named = [F.when(k.isNotNull(), F.concat(F.lit(f"{i}:"), k.cast("string"))) for i, k in enumerate(keys)]
    alone = F.concat(F.lit("r:"), F.coalesce(F.col(record_id).cast("string"), F.lit("")))
    linked = rows.withColumn("__keys", F.array_compact(F.array(*named)))
    # Written once: keys may be costly to read from texts, and they are used several times below.
    linked = cut(linked.withColumn("__keys", F.when(F.size("__keys") == 0, F.array(alone)).otherwise(F.col("__keys"))).select(*kept, "__keys"))
    pairs = linked.select(F.col("__keys")[0].alias("src"), F.explode("__keys").alias("dst"))
    # A key of one record alone ties nothing; only keys that come again are nodes beside the first.
    again = pairs.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("dst")
    edges = pairs.where("src = dst").distinct().unionByName(pairs.where("src <> dst").distinct().join(again, "dst", "left_semi").select("src", "dst"))
    components = hash_to_min(edges)
    keyed = linked.withColumn("node", F.col("__keys")[0]).drop("__keys")
    return skewed_lookup(keyed, components, "node", cut(heavy_keys(keyed, "node")), "left").drop("node")


def divided_records(rows: DataFrame, record_id: str, split: str, keys: list[Column]) -> DataFrame:
    """The records of tied sets that now lie in more than one split."""
    parts = cut(tied(rows.where(F.col(split).isNotNull()), record_id, keys, [record_id, split]))
    mixed = parts.groupBy("component").agg(F.min(split).alias("a"), F.max(split).alias("b")).where("a <> b").select("component", F.lit(True).alias("divided"))
    heavy = cut(heavy_keys(parts, "component"))
    return skewed_lookup(parts, mixed, "component", heavy, "inner").select(record_id)


def assign(components: DataFrame, targets: DataFrame) -> DataFrame:
    """(component, split): each component's split by weighted rendezvous hashing.

    ``components`` (component, n) and ``targets`` (split, share).  The few components with more than
    ``LARGE`` of all records go first, largest to the split that lacks most; the weights of the
    hashing are what they leave of each share.
    """
    total = components.agg(F.sum("n")).first()[0] or 0
    shares = {r["split"]: float(r["share"]) for r in targets.where("split IS NOT NULL AND share > 0").collect()}
    if not shares:
        raise ValueError("no split has a positive share")
    whole = sum(shares.values())
    left = {s: total * w / whole for s, w in shares.items()}
    placed = []
    for row in components.where(F.col("n") > total * LARGE).orderBy(F.desc("n"), "component").collect():
        split = max(sorted(left), key=lambda s: left[s])
        left[split] -= row["n"]
        placed.append((row["component"], split))
    spark = components.sparkSession
    fixed = spark.createDataFrame(placed, "component string, fixed string")
    options = []
    for split, want in sorted(left.items()):
        if want > 0:
            # A uniform number in (0, 1) from the hash; -ln(u) / weight is least with odds by weight.
            u = (F.pmod(F.xxhash64(F.col("component"), F.lit(split)), F.lit(2**52)).cast("double") + 0.5) / float(2**52)
            options.append(F.struct((-F.log(u) / F.lit(float(want))).alias("score"), F.lit(split).alias("split")))
    hashed = F.array_min(F.array(*options))["split"] if options else F.lit(max(sorted(left), key=lambda s: left[s]))
    return components.join(F.broadcast(fixed), "component", "left").select("component", F.coalesce("fixed", hashed).alias("split"))


def grouped_splits(rows: DataFrame, record_id: str, keys: list[Column], targets: DataFrame) -> DataFrame:
    """(record_id, component, split) for every record, no component in two splits."""
    parts = cut(tied(rows, record_id, keys, [record_id]))
    sizes = cut(parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")))
    heavy = sizes.where(F.col("n") > 1000).orderBy(F.desc("n")).limit(1000).select("component")
    return skewed_lookup(parts, assign(sizes, targets), "component", heavy, "left")
