"""Readers: JSON arrays, JSON lines (strict, lenient, with line numbers), bundles, archives; normalisers."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A file that holds one list of objects; anything else fails the read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """One object per line, gzip included. Strict: a bad line fails. Lenient: bad lines are dropped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_jsonl_with_rejects(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): rejects holds the lines that are no object of the schema."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = lines.select("value", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return parsed.where("r._corrupt IS NULL").select("r.*").drop("_corrupt"), parsed.where("r._corrupt IS NOT NULL").select(F.col("value").alias("line"))


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_number, line): each file's lines, numbered from 1, blank lines kept.

    Files are split like any text input: a line's place is its file, the start of its split and its order in
    the split, and numbers are prefix counts over them, so a file of any size is many tasks.
    """
    from factaudit.operators.prefix import row_number

    placed = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__order"), F.col("value").alias("line"))
    return row_number(placed, ["path"], [F.asc("__start"), F.asc("__order")], "line_number").select("path", "line_number", "line")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_number, line, sha256): each file's lines, numbered from 1, blank lines kept.

    The digest of a file needs all its bytes in order, so a file is one record of the scan (at most 2 GB);
    ``read_numbered_lines`` has no such bound and no digest.
    """
    import hashlib

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                digest = hashlib.sha256(content).hexdigest()
                lines = content.decode("utf-8").split("\n")
                if lines and lines[-1] == "":
                    lines.pop()
                for at in range(0, len(lines), 10_000):
                    part = lines[at : at + 10_000]
                    yield pd.DataFrame({"path": name, "line_number": range(at + 1, at + 1 + len(part)), "line": part, "sha256": digest})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(split, "path string, line_number bigint, line string, sha256 string")


def read_zip_members(spark: SparkSession, path: str, suffix: str = ".jsonl") -> DataFrame:
    """(member, line): the lines of all members of zip archives whose names end in ``suffix``."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for name in sorted(archive.namelist()):
                        if name.endswith(suffix):
                            lines = [x for x in archive.read(name).decode("utf-8").splitlines() if x.strip()]
                            yield pd.DataFrame({"member": name, "line": lines})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(members, "member string, line string")


def load_config(path: str, _seen: tuple[str, ...] = ()) -> dict:
    """A JSON configuration with its ``extends`` chain merged, the child winning."""
    import os

    if path in _seen:
        raise ValueError(f"configuration extends itself: {path}")
    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    parent = config.pop("extends", None)
    if parent is None:
        return config
    base = load_config(os.path.join(os.path.dirname(path), parent), (*_seen, path))
    return deep_merge(base, config)


def deep_merge(base: dict, override: dict) -> dict:
    """Nested merge of two mappings; lists and scalars are replaced."""
    out = dict(base)
    for k, v in override.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def normalised_record(rows: DataFrame) -> DataFrame:
    """``rows`` (question, answer, choices, source_format, ...) cleaned, with ``excluded``: why a record
    cannot be used, or null.  Texts are cleaned to single spaces; null choices are no choices."""
    from factaudit.functions.text import clean_text

    choices = F.transform(F.coalesce("choices", F.array().cast("array<string>")), clean_text)
    clean = rows.withColumn("question", clean_text(F.col("question"))).withColumn("answer", clean_text(F.col("answer"))).withColumn("choices", choices)
    some = F.size("choices") > 0
    excluded = (
        F.when(F.col("question").isNull(), "missing_or_empty_question").when(F.col("answer").isNull(), "missing_or_empty_answer")
        .when(F.exists("choices", lambda c: c.isNull()), "invalid_choice")
        .when((F.col("source_format") == "multiple_choice") & ~some, "missing_or_empty_choices")
        .when((F.col("source_format") == "multiple_choice") & ~F.array_contains("choices", F.col("answer")), "answer_not_in_choices")
        .when((F.col("source_format") == "open_qa") & some, "open_qa_choices_must_be_empty")
        .when(~F.coalesce(F.col("source_format").isin("multiple_choice", "open_qa"), F.lit(False)), "unsupported_source_format")
    )
    return clean.withColumn("excluded", excluded)


def _shaped(rows: DataFrame, question: Column, answer: Column, choices: Column | None, form: str, subject: Column, upstream_id: Column, wrong: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("array<string>")
    out = normalised_record(rows.select(
        question.alias("question"), answer.alias("answer"), (none if choices is None else choices).alias("choices"), F.lit(form).alias("source_format"), subject.alias("subject"), upstream_id.cast("string").alias("upstream_id"),
        (F.lit(None).cast("string") if wrong is None else wrong).alias("__wrong")))
    return out.withColumn("excluded", F.coalesce("__wrong", "excluded")).drop("__wrong")


def normalise_lettered(rows: DataFrame) -> DataFrame:
    """Multiple-choice rows with option_a to option_d and the letter of the answer."""
    options = F.array("option_a", "option_b", "option_c", "option_d")
    at = F.instr(F.lit("ABCD"), F.upper(F.trim("answer")))
    answer = F.when((at > 0) & (F.length(F.trim("answer")) == 1), F.get(options, at - 1))
    return _shaped(rows, F.col("question"), answer, options, "multiple_choice", F.col("subject"), F.col("sample_id"))


def normalise_typed_answers(rows: DataFrame, accepted: list[str]) -> DataFrame:
    """Open questions whose first English answer has a type; other types are left out by name."""
    first = F.get("answers.en", 0)
    kind = first["type"]
    wrong = F.when(~F.coalesce(kind.isin(*accepted), F.lit(False)), F.concat(F.lit("answer_type:"), F.coalesce(kind, F.lit("missing"))))
    return _shaped(rows, F.col("queries.en"), first["text"], None, "open_qa", kind, F.col("example_id"), wrong)


def normalise_by_language(rows: DataFrame, language: str) -> DataFrame:
    """Open questions of one language."""
    wrong = F.when(~F.coalesce(F.col("language") == language, F.lit(False)), "non_target_language")
    return _shaped(rows, F.col("question"), F.col("answer"), None, "open_qa", F.col("category"), F.col("id"), wrong)


def normalise_stems(rows: DataFrame, subject: str) -> DataFrame:
    """Multiple-choice rows with a stem, labelled choices and the label of the answer."""
    answer = F.get(F.filter("question.choices", lambda c: c["label"] == F.col("answerKey")), 0)["text"]
    choices = F.transform("question.choices", lambda c: c["text"])
    return _shaped(rows, F.col("question.stem"), answer, choices, "multiple_choice", F.lit(subject), F.col("id"))
