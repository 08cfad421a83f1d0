"""Streams give what batches give."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.streaming import queues

SCHEMA = "event_id long, ts timestamp, user_id long, action string"


@pytest.fixture
def log(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=37 * i), i % 3, "click" if i % 4 else "view") for i in range(60)]
    half = len(rows) // 2
    for k, part in enumerate((rows[:half], rows[half:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return rows, stream, tmp_path


def test_registry_stream_equals_batch(spark, log):
    rows, stream, path = log
    out = {}
    queues.run_once(queues.registry(stream), lambda df, _: out.update({r["action"]: r["uses"] for r in df.collect()}), str(path / "c1"), "update")
    want = {r["action"]: r["uses"] for r in queues.registry(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == want


def test_limiter_window_opens_at_the_first_event(spark):
    base = datetime(2024, 1, 1, 0, 59)
    rows = [(i, base + timedelta(seconds=20 * i), 1, "x") for i in range(6)]
    got = [r["allowed"] for r in queues.rate_limited(spark.createDataFrame(rows, SCHEMA), 2, 60).orderBy("event_id").collect()]
    assert got == [True, True, False, True, True, False]


def test_limiter_stream_keeps_state(spark, log):
    rows, stream, path = log
    out = []
    queues.run_once(queues.rate_limited(stream, 2, 3 * 3600), lambda df, _: out.extend((r[0], r[2]) for r in df.collect()), str(path / "c2"))
    want = queues.rate_limited(spark.createDataFrame(rows, SCHEMA), 2, 3 * 3600)
    assert sorted(out) == sorted((r[0], r[2]) for r in want.collect())


def test_deduplicated_and_windowed_streams(spark, log):
    rows, stream, path = log
    doubled = stream.union(stream)
    out = []
    queues.run_once(queues.deduplicated(doubled, ["event_id"]), lambda df, _: out.extend(r[0] for r in df.collect()), str(path / "c3"))
    assert sorted(out) == list(range(60))
    counts = {}
    queues.run_once(queues.tumbling(stream, "1 hour"), lambda df, _: counts.update({(r[0], r[1]): r[2] for r in df.collect()}), str(path / "c4"), "update")
    want = {(r[0], r[1]): r[2] for r in queues.tumbling(spark.createDataFrame(rows, SCHEMA), "1 hour").collect()}
    assert counts == want


def test_claim_takes_due_and_lost_rows(spark):
    rows = [(1, "PENDING", "2024-01-01"), (2, "PENDING", "2024-01-03"), (3, "RUNNING", "2024-01-01"), (4, "DONE", "2024-01-01")]
    queue = spark.createDataFrame(rows, "event_id long, state string, t string").withColumn("next_at", F.to_timestamp("t"))
    assert [r["event_id"] for r in queues.claim(queue, "2024-01-02 00:00:00", 10).collect()] == [1, 3]


def fed(spark, folder, batches, schema):
    """A stream of one micro-batch for each list of rows."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))


def drained(stream, folder):
    """The rows of all micro-batches, and how many states were left after the last one."""
    out = []
    query = stream.writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(folder / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    return out, [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]][-1]


def test_timer_gives_up_an_attempt_and_its_state_goes(spark, tmp_path):
    schema = "job_id long, attempt int, state string, ts timestamp"
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    batches = [[(1, 1, "RUNNING", at(0)), (2, 1, "RUNNING", at(0)), (2, 1, "DONE", at(5)), (3, 1, "RUNNING", at(1)), (3, 1, "OTHER", at(2))], [(3, 2, "RUNNING", at(10)), (4, 1, "RUNNING", at(12))], [(9, 1, "DONE", at(90))], [(9, 1, "DONE", at(91))]]
    found, left = drained(queues.recovered(fed(spark, tmp_path, batches, schema)), tmp_path)
    assert sorted((r["job_id"], r["attempt"], r["given_up"]) for r in found) == [(1, 1, at(15)), (3, 2, at(25)), (4, 1, at(27))]
    assert left == 0
    batch = queues.recovered(spark.createDataFrame([r for b in batches for r in b], schema)).collect()
    assert sorted(map(tuple, batch)) == sorted((r["job_id"], r["attempt"], r["given_up"]) for r in found)


def test_limiter_state_expires(spark, tmp_path):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    batches = [[(1, at(0), 7, "x"), (2, at(1), 7, "x"), (3, at(2), 7, "x")], [(4, at(300), 8, "x")], [(5, at(301), 8, "x"), (6, at(302), 7, "x")], [(7, at(900), 9, "x")], [(8, at(901), 9, "x")]]
    found, left = drained(queues.rate_limited(fed(spark, tmp_path, batches, SCHEMA), 2, 600, "10 minutes"), tmp_path)
    assert {r["event_id"]: r["allowed"] for r in found} == {1: True, 2: True, 3: False, 4: True, 5: True, 6: True, 7: True, 8: True}
    assert left == 1


def test_stages_skip_repeat_and_refuse(spark):
    log = ["ENTER PARSING", "ENTER ANALYZING", "COMPLETE", "ENTER IMPORTING", "FAIL", "ENTER PARSING", "RETRY", "ENTER ANALYZING", "COMPLETE", "ENTER PARSING", "ENTER IMPORTING", "FINISH", "COMPLETE", "FINISH", "RETRY"]
    rows = [(1, k, datetime(2024, 1, 1) + timedelta(seconds=k), *(e.split() + [None])[:2]) for k, e in enumerate(log)] + [(2, 99, datetime(2024, 1, 1), "ENTER", "NOWHERE"), (3, 98, datetime(2024, 1, 1), "ENTER", "VERIFYING"), (None, 97, datetime(2024, 1, 1), "FAIL", None)]
    got = [tuple(r) for r in queues.stage_runs(spark.createDataFrame(rows, "job_id long, event_id long, ts timestamp, what string, stage string")).orderBy("job_id", "event_id", "stage").collect()]
    second = 1_000_000
    assert got == [
        (1, 1, 1, None, "ILLEGAL", None), (1, 2, 1, "PARSING", "COMPLETED", 2 * second), (1, 4, 1, "IMPORTING", "FAILED", second), (1, 5, 1, None, "ILLEGAL", None), (1, 8, 2, "ANALYZING", "COMPLETED", second), (1, 9, 2, None, "ILLEGAL", None),
        (1, 11, 2, None, "ILLEGAL", None), (1, 12, 2, "IMPORTING", "COMPLETED", 2 * second), (1, 13, 2, "PARSING", "SKIPPED", None), (1, 13, 2, "VERIFYING", "SKIPPED", None), (1, 14, 2, None, "ILLEGAL", None),
        (2, 99, 1, None, "ILLEGAL", None), (3, None, 1, "VERIFYING", "RUNNING", None),
    ]
