"""Scans that are paced, stopped, killed and resumed."""

import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from quillon.streaming import upsert, watch

SCHEMA = "k long, confidence double, seq long"


@pytest.fixture
def landed(spark, tmp_path):
    """Five files of ten rows; every seventh has no confidence."""
    for n in range(5):
        rows = [((n * 10 + i) % 12, None if (n * 10 + i) % 7 == 0 else float((n * 10 + i) % 9), n * 10 + i) for i in range(10)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.02)
    return str(tmp_path)


def scan(spark, place, name, every=None):
    stream = upsert.polite(spark.readStream.schema(SCHEMA)).parquet(f"{place}/in")
    return upsert.upsert_stream(watch.counted(stream, F.col("confidence").isNull()), place, ["k"], every=every, name=name)


def state(spark, place):
    return sorted((r["k"], r["confidence"], r["seq"]) for r in upsert.current_state(spark, place, spark.createDataFrame([], SCHEMA).schema).collect())


def expected(spark, place):
    rows = spark.read.schema(SCHEMA).parquet(f"{place}/in")
    return sorted((r["k"], r["confidence"], r["seq"]) for r in upsert.merged(rows.limit(0), rows, ["k"]).collect())


def test_batches_and_errors_are_counted(spark, landed):
    seen = watch.watched(spark, "counted")
    try:
        scan(spark, landed, "counted").awaitTermination()
        assert seen.wait_for(4)
        assert (seen.seen.rows, seen.seen.errors) == (50, 8)
        assert [(b.number, b.rows) for b in seen.seen.batches if b.rows] == [(n, 10) for n in range(5)]
        assert sum(b.errors for b in seen.seen.batches) == 8
    finally:
        spark.streams.removeListener(seen)


def test_stop_behind_a_batch_and_resume(spark, landed):
    seen = watch.watched(spark, "stopped")
    try:
        watch.stop_after(scan(spark, landed, "stopped", every="1 second"), seen, 1)
        stopped = seen.last()
        assert 1 <= stopped < 4
        part = state(spark, landed)
        scan(spark, landed, "stopped").awaitTermination()
        assert seen.wait_for(4)
        # no batch is read twice
        assert seen.seen.rows == 50
        assert state(spark, landed) == expected(spark, landed) != part
    finally:
        spark.streams.removeListener(seen)


def test_a_trigger_is_a_wait_between_batches(spark, landed):
    seen = watch.watched(spark, "paced")
    began = time.perf_counter()
    try:
        watch.stop_after(scan(spark, landed, "paced", every="3 seconds"), seen, 2)
        assert time.perf_counter() - began > 5
    finally:
        spark.streams.removeListener(seen)


def test_a_killed_batch_is_made_again(spark, landed, monkeypatch):
    real, calls, slept = upsert.merged, [], []

    def failing(*a):
        calls.append(1)
        if len(calls) in (3, 4):
            raise RuntimeError("executor lost")
        return real(*a)

    monkeypatch.setattr(upsert, "merged", failing)
    seen = watch.watched(spark, "killed")
    try:
        watch.patiently(lambda: scan(spark, landed, "killed"), seen, sleep=slept.append)
        assert seen.wait_for(4)
        assert len(seen.seen.failures) == 2 and slept == [watch.WAIT] * 2
        monkeypatch.undo()
        assert state(spark, landed) == expected(spark, landed)
    finally:
        spark.streams.removeListener(seen)


def test_three_failures_without_a_batch_end_the_scan(spark, landed, monkeypatch):
    monkeypatch.setattr(upsert, "merged", lambda *_: 1 / 0)
    seen, slept = watch.watched(spark, "hopeless"), []
    try:
        with pytest.raises(StreamingQueryException):
            watch.patiently(lambda: scan(spark, landed, "hopeless"), seen, sleep=slept.append)
        assert len(slept) == 2
    finally:
        spark.streams.removeListener(seen)
