import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from factaudit.sources import artifacts, readers

SCHEMA = "id bigint, question string, choices array<string>"


def test_json_array_and_failfast(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "question": "q", "choices": ["x"]}, {"id": 2, "question": None}]))
    assert readers.read_json_array(spark, str(tmp_path / "a.json"), SCHEMA).count() == 2
    (tmp_path / "b.json").write_text('[{"id": "no number"}]')
    with pytest.raises(Exception):
        readers.read_json_array(spark, str(tmp_path / "b.json"), SCHEMA).collect()


def test_jsonl_strict_lenient_gzip(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": 1}\n\n{"id": broken\n{"id": 2}\n')
    assert readers.read_jsonl(spark, str(tmp_path / "x.jsonl"), SCHEMA, strict=False).count() == 2
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(tmp_path / "x.jsonl"), SCHEMA).collect()
    with gzip.open(tmp_path / "y.jsonl.gz", "wt") as f:
        f.write('{"id": 5}\n')
    assert [r.id for r in readers.read_jsonl(spark, str(tmp_path / "y.jsonl.gz"), SCHEMA).collect()] == [5]
    from pyspark.sql.types import LongType, StructField, StructType

    rows, rejects = readers.read_jsonl_with_rejects(spark, str(tmp_path / "x.jsonl"), StructType([StructField("id", LongType())]))
    assert sorted(r.id for r in rows.collect()) == [1, 2]
    assert rejects.count() == 1


def test_lines_keep_numbers_and_digest(spark, tmp_path):
    (tmp_path / "l.txt").write_text("a\n\nb\n")
    rows = sorted(readers.read_lines(spark, str(tmp_path / "l.txt")).collect(), key=lambda r: r.line_number)
    assert [(r.line_number, r.line) for r in rows] == [(1, "a"), (2, ""), (3, "b")]
    (digest,) = {r.sha256 for r in rows}
    assert digest == artifacts.file_fingerprints(spark, str(tmp_path / "l.txt")).first().sha256


def test_numbered_lines_of_split_files(spark, tmp_path):
    (tmp_path / "n").mkdir()
    for name, n in (("a.txt", 5000), ("b.txt", 3)):
        (tmp_path / "n" / name).write_text("".join(f"line {i}\n" if i % 5 else "\n" for i in range(1, n + 1)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
        rows = readers.read_numbered_lines(spark, str(tmp_path / "n")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 5003 and all(r.line == (f"line {r.line_number}" if r.line_number % 5 else "") for r in rows)


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a.jsonl", "1\n2\n")
        z.writestr("b.txt", "3\n")
    assert sorted(r.line for r in readers.read_zip_members(spark, str(tmp_path / "z.zip")).collect()) == ["1", "2"]


def test_config_inheritance(tmp_path):
    (tmp_path / "base.json").write_text('{"a": {"x": 1, "y": 2}, "b": [1]}')
    (tmp_path / "child.json").write_text('{"extends": "base.json", "a": {"y": 3}, "b": [2]}')
    assert readers.load_config(str(tmp_path / "child.json")) == {"a": {"x": 1, "y": 3}, "b": [2]}
    (tmp_path / "loop.json").write_text('{"extends": "loop.json"}')
    with pytest.raises(ValueError):
        readers.load_config(str(tmp_path / "loop.json"))


def test_publish_never_overwrites(spark, tmp_path):
    frames = {"facts": spark.range(3), "pairs": spark.range(0)}
    manifest = artifacts.publish(frames, str(tmp_path / "out"))
    assert {r.artifact: r.record_count for r in manifest.collect()} == {"facts": 3, "pairs": 0}
    with pytest.raises(Exception):
        artifacts.publish(frames, str(tmp_path / "out"))
    # A release that fails leaves nothing behind and can be tried again.
    broken = {"a": spark.range(2), "b": spark.range(2).selectExpr("raise_error('no') AS x")}
    with pytest.raises(Exception):
        artifacts.publish(broken, str(tmp_path / "again"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"]
    assert artifacts.publish({"a": spark.range(2)}, str(tmp_path / "again")).count() == 1


def test_canonical_json(spark):
    rows = spark.createDataFrame([('{"b": null, "a": "é"}',), (None,)], "j string")
    assert [r.c for r in rows.select(artifacts.canonical_json("j").alias("c")).collect()] == ['{"a":"é","b":null}', None]


def test_write_jsonl(spark, tmp_path):
    artifacts.write_jsonl(spark.range(2).withColumn("n", F.lit("x")), str(tmp_path / "j"), files=1)
    assert spark.read.json(str(tmp_path / "j")).count() == 2
