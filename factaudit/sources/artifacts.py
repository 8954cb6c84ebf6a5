"""Writers, fingerprints and manifests of artifacts."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factaudit.session import file_system


def write_jsonl(rows: DataFrame, path: str, files: int | None = None) -> None:
    """JSON lines in a new folder; an existing one is never overwritten. The commit is atomic."""
    (rows if files is None else rows.coalesce(files)).write.mode("errorifexists").json(path)


def publish(frames: dict[str, DataFrame], folder: str) -> DataFrame:
    """Write all frames and a manifest beside ``folder``, then give them its name in one rename.

    An existing folder is never touched, and a release that fails leaves nothing behind, so it can be tried
    again.
    """
    from uuid import uuid4

    spark = next(iter(frames.values())).sparkSession
    fs, target = file_system(spark, folder)
    if fs.exists(target):
        raise FileExistsError(folder)
    staged = f"{folder.rstrip('/')}.staged-{uuid4().hex}"
    try:
        counts = []
        for name, frame in sorted(frames.items()):
            frame.write.mode("errorifexists").parquet(f"{staged}/{name}")
            counts.append((name, spark.read.parquet(f"{staged}/{name}").count()))
        spark.createDataFrame(counts, "artifact string, record_count bigint").coalesce(1).write.mode("errorifexists").json(f"{staged}/_manifest")
        if fs.exists(target) or not fs.rename(file_system(spark, staged)[1], target):
            raise FileExistsError(folder)
    except BaseException:
        fs.delete(file_system(spark, staged)[1], True)
        raise
    return spark.read.schema("artifact string, record_count bigint").json(f"{folder}/_manifest")


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def row_fingerprint(*columns: str) -> Column:
    """SHA-256 of a row's values in order; null counts as empty."""
    return F.sha2(F.concat_ws("␟", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def set_digest(key: str) -> Column:
    """A digest of a group's ids that does not depend on their order.

    The ids' hashes are added up, so the digest is partial on the map side and no group is gathered.
    """
    return F.sum(F.conv(F.substring(F.sha2(F.col(key), 256), 1, 12), 16, 10).cast("decimal(38,0)")).cast("string")


def manifest(rows: DataFrame, by: list[str], key: str) -> DataFrame:
    """One row per artifact: number of records and digest of the set of ids."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("record_count"), set_digest(key).alias("id_digest"))


@F.pandas_udf(T.StringType())
def canonical_json(values: pd.Series) -> pd.Series:
    """JSON text with sorted keys, nulls kept, no spaces and no escapes beyond need."""
    return values.map(lambda v: None if v is None else json.dumps(json.loads(v), sort_keys=True, ensure_ascii=False, separators=(",", ":")))


def mentioned_ids(texts: DataFrame, text_id: str, text: str, pattern: str) -> DataFrame:
    """(text_id, identifier): the distinct identifiers that each text mentions."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return texts.where(F.col(text).isNotNull()).select(text_id, F.explode(found).alias("identifier"))
