import datetime

import pytest
from pyspark.sql import functions as F

from factaudit.streaming import calls, events


def rows(n):
    start = datetime.datetime(2024, 1, 1)
    kinds = ["view", "click", "error"]
    return [(i, start + datetime.timedelta(minutes=7 * i), i % 3, kinds[i % 3], float(i), "{}") for i in range(n)]


@pytest.fixture
def folder(spark, tmp_path):
    frame = spark.createDataFrame(rows(60), events.EVENT_SCHEMA)
    frame.repartition(3).write.parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def run(spark, frame, name, mode):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_windows_agree_with_the_table(spark, folder):
    table = events.windowed_counts(spark.read.parquet(folder), "1 hour")
    stream = run(spark, events.windowed_counts(events.read_event_stream(spark, folder), "1 hour", watermark="30 days"), "w1", "complete")
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, table.collect()))


def test_duplicates_and_sessions(spark, folder):
    twice = spark.read.parquet(folder).union(spark.read.parquet(folder))
    assert events.first_arrivals(twice, "event_id").count() == 60
    assert events.sessions(spark.read.parquet(folder), "10 minutes").count() == 60
    assert events.sessions(spark.read.parquet(folder), "30 minutes").count() == 3


def test_upsert_survives_a_batch_run_again(spark, tmp_path):
    step = events.upsert_latest(str(tmp_path), "k", ["t"])
    step(spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, t int, v string"), 0)
    late = spark.createDataFrame([(1, 2, "c"), (2, 0, "old")], "k int, t int, v string")
    step(late, 1)
    step(late, 1)
    out = spark.read.parquet(str(tmp_path / "version-00000001"))
    assert sorted((r.k, r.v) for r in out.collect()) == [(1, "c"), (2, "b")]


def test_watchdog_counts_per_run(spark, folder):
    out = run(spark, events.watchdog(events.read_event_stream(spark, folder)), "w2", "update")
    last = {r.user_id: (r.attempts, r.failures) for r in out.orderBy("attempts").collect()}
    assert last == {0: (20, 0), 1: (20, 0), 2: (20, 20)}


def test_requests_split_and_retry(spark):
    def respond(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("bad")
        return [p.upper() for p in prompts]

    requests = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c"), (4, "d")], "id bigint, prompt string").coalesce(1)
    got = {r.id: (r.reply, r.error) for r in calls.map_requests(requests, "id", "prompt", respond).collect()}
    assert got == {1: ("A", None), 2: (None, "RuntimeError"), 3: ("C", None), 4: ("D", None)}
    assert calls.map_requests(requests.where(F.lit(False)), "id", "prompt", respond).count() == 0


def test_only_transient_errors_and_invalid_replies_are_tried_again(spark):
    def respond(prompts):
        if "net" in prompts:
            raise TimeoutError
        if "bad" in prompts:
            raise RuntimeError
        return [p.upper() for p in prompts]

    requests = spark.createDataFrame([(1, "ok"), (2, "net"), (3, "bad"), (4, "odd")], "id int, prompt string")
    got = {r.id: (r.reply, r.attempts, r.error) for r in calls.map_requests(requests, "id", "prompt", respond, valid=lambda r: r != "ODD", workers=1).collect()}
    assert got == {1: ("OK", 1, None), 2: (None, 3, "TimeoutError"), 3: (None, 1, "RuntimeError"), 4: (None, 3, "InvalidReply")}
