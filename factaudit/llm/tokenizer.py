"""Encoding a corpus with a byte-level BPE vocabulary: each distinct word is encoded once.

Texts are cut into the pre-tokens of the vocabulary's pattern by a built-in expression.  The pre-tokens of
the whole corpus are exploded and shuffled together, and each distinct one is encoded by the vocabulary's
merge ranks.  The ids are joined back by position: words with more than ``COMMON_SHARE`` of all
occurrences - at most 1 / COMMON_SHARE of them, whatever the corpus - meet their ids where the text lies,
by a broadcast of that bounded table; all other occurrences, none of them hot, are shuffled by word, meet
their ids and are put in at their position.

Defined results: a null or empty text has no ids (an empty list); special tokens are ordinary text;
texts are taken whole; each row has its own result, also where rows or ids repeat.  Letters and numbers
are those of the Unicode version of the Java runtime.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factaudit.session import cut, spread

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
VOCABULARY_SETTING = "spark.factaudit.tokenizer.path"

#: A word is common when it holds more than this share of all occurrences: at most 1 / share words are.
COMMON_SHARE = 1e-5
#: Longer words are never broadcast, which bounds the table in bytes.
COMMON_LETTERS = 64

# The pattern of the vocabulary; white space is the Unicode property.
_SPACE = r"\t-\r\x20\x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def vocabulary_path(spark: SparkSession) -> str:
    """The vocabulary file: the session's setting, else the usual place."""
    return spark.conf.get(VOCABULARY_SETTING, os.environ.get("FACTAUDIT_TOKENIZER", DEFAULT_VOCABULARY))


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ids, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def pre_tokens(text: Column) -> Column:
    """The pre-tokens of a text, in order; their concatenation is the text."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """(word, n, ids): each word of (word, n) encoded by the merge ranks of ``path``."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        encoder = None
        for batch in batches:
            encoder = encoder or tiktoken.Encoding("ranks", pat_str=r"(?s).+", mergeable_ranks=read_ranks(path), special_tokens={})
            yield pd.DataFrame({"word": batch["word"], "n": batch["n"], "ids": [encoder.encode_ordinary(w) for w in batch["word"]]})

    return words.select("word", "n").mapInPandas(encode, "word string, n bigint, ids array<int>")


def vocabulary(texts: DataFrame, text: str, path: str) -> DataFrame:
    """(word, n, ids): the distinct pre-tokens of a column of texts, how often they occur, their ids."""
    words = spread(texts.select(F.col(text).alias("text"))).select(F.explode(pre_tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return cut(encode_words(words, path))


def _common(known: DataFrame) -> pa.Table:
    """The words that hold more than COMMON_SHARE of all occurrences, with their ids: bounded by it."""
    total = known.agg(F.sum("n")).first()[0] or 0
    rows = known.where((F.col("n") > total * COMMON_SHARE) & (F.length("word") <= COMMON_LETTERS)).select("word", "ids")
    return rows.toArrow().combine_chunks()


def _placed(batches: Iterator[pa.RecordBatch], common: pa.Table, counted: bool) -> Iterator[pa.RecordBatch]:
    """Per text the ids of its common words in order, and its other words with where they go."""
    words = common["word"].combine_chunks() if common.num_rows else pa.array([], pa.string())
    lists = common["ids"].combine_chunks() if common.num_rows else pa.array([], pa.list_(pa.int32()))
    sizes = np.diff(lists.offsets.to_numpy()) if common.num_rows else np.zeros(0, dtype=np.int64)
    starts, values = np.append(0, np.cumsum(sizes)), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
    for batch in batches:
        column = batch.column("words")
        column = pc.if_else(column.is_null(), pa.scalar([], column.type), column) if column.null_count else column
        offsets = column.offsets.to_numpy() - column.offsets[0].as_py()
        flat = column.flatten()
        code = pc.index_in(flat, value_set=words)
        rare = np.flatnonzero(code.is_null().to_numpy(zero_copy_only=False))
        code = pc.fill_null(code, len(words)).to_numpy(zero_copy_only=False).astype(np.int64)
        size = np.append(sizes, 0)[code]
        before = np.append(0, np.cumsum(size))
        ends = before[offsets]
        # Where the rare words of each text begin in the list of all of them.
        of_text = np.searchsorted(rare, offsets)
        names = flat.take(pa.array(rare))
        if counted:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(np.diff(ends), pa.int64()), pa.ListArray.from_arrays(pa.array(of_text, pa.int32()), names)], names=[*batch.schema.names[:-1], "known", "rare"])
            continue
        at = np.repeat(starts[code] - before[:-1], size) + np.arange(before[-1])
        text_of = np.searchsorted(offsets, rare, side="right") - 1
        places = pa.array(before[rare] - ends[text_of], pa.int32())
        struct = pa.StructArray.from_arrays([places, names], ["at", "word"])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[at], pa.int32())), pa.ListArray.from_arrays(pa.array(of_text, pa.int32()), struct)],
            names=[*batch.schema.names[:-1], "known", "rare"])


def _with_rare(texts: DataFrame, text_id: str, text: str, known: DataFrame, counted: bool) -> DataFrame:
    """(row, id, known, rare) of every row; written, since two joins read it."""
    common = _common(known)
    kind = texts.schema[text_id].dataType.simpleString()
    rows = spread(texts.select(F.col(text_id).alias("id"), F.col(text).alias("text"))).select("id", pre_tokens(F.col("text")).alias("words"))
    out = f"id {kind}, known bigint, rare array<string>" if counted else f"id {kind}, known array<int>, rare array<struct<at:int,word:string>>"
    return cut(rows.mapInArrow(lambda batches: _placed(batches, common, counted), out).withColumn("row", F.monotonically_increasing_id()))


def encode_corpus(texts: DataFrame, text_id: str, text: str, path: str) -> DataFrame:
    """(text_id, ids): the token ids of every row's text, without special tokens."""
    known = vocabulary(texts, text, path)
    placed = _with_rare(texts, text_id, text, known, counted=False)
    rare = placed.where("size(rare) > 0").select("row", F.posexplode("rare").alias("k", "r")).select("row", "k", "r.at", "r.word")
    met = rare.join(known.select("word", "ids"), "word").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("k", "at", "ids"))).alias("parts"))
    open_rows = placed.where("size(rare) > 0").select("row", "id", "known").join(met, "row")
    # The common ids up to each rare word, the rare word's ids, and so on, then the common ids left.
    pieces = F.transform("parts", lambda p, i: F.concat(
        F.slice("known", F.when(i == 0, 0).otherwise(F.get("parts", i - 1)["at"]) + 1, p["at"] - F.when(i == 0, 0).otherwise(F.get("parts", i - 1)["at"])), p["ids"]))
    last = F.element_at("parts", -1)["at"]
    whole = F.concat(F.flatten(pieces), F.slice("known", last + 1, F.size("known") - last))
    return placed.where("size(rare) = 0").select(F.col("id").alias(text_id), F.col("known").alias("ids")).unionByName(open_rows.select(F.col("id").alias(text_id), whole.alias("ids")))


def count_tokens(texts: DataFrame, text_id: str, text: str, path: str) -> DataFrame:
    """(text_id, tokens): the number of tokens of every row's text; 0 for null and empty texts."""
    known = vocabulary(texts, text, path)
    placed = _with_rare(texts, text_id, text, known, counted=True)
    more = placed.select("row", F.explode("rare").alias("word")).join(known.select("word", F.size("ids").alias("n")), "word").groupBy("row").agg(F.sum("n").alias("n"))
    return placed.select("row", "id", "known").join(more, "row", "left").select(F.col("id").alias(text_id), (F.col("known") + F.coalesce("n", F.lit(0))).alias("tokens"))


def token_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(token, bytes): the vocabulary as a table; its size is that of the vocabulary."""
    ranks = read_ranks(path)
    return spark.createDataFrame(pd.DataFrame({"token": list(ranks.values()), "bytes": [k.hex() for k in ranks]}), "token int, bytes string")


def decode_corpus(encoded: DataFrame, text_id: str, path: str) -> DataFrame:
    """(text_id, text): the text of each row's ids; an empty list gives an empty text."""
    table = F.broadcast(token_bytes(encoded.sparkSession, path))
    tokens = encoded.select(text_id, F.posexplode("ids").alias("at", "token")).join(table, "token")
    joined = tokens.groupBy(text_id).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "bytes"))), lambda x: x["bytes"]), "").alias("hex"))
    texts = joined.select(F.col(text_id).alias("__id"), F.decode(F.unhex("hex"), "UTF-8").alias("text"))
    rows = encoded.select(text_id)
    return rows.join(texts, rows[text_id] == texts["__id"], "left").select(text_id, F.coalesce("text", F.lit("")).alias("text"))
