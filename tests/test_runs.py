"""Keyed state in runs: last write wins, whole versions, writes that follow the batch."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillon.streaming import runs
from quillon.streaming.runs import Runs

SCHEMA = StructType().add("k", "long").add("name", "string").add("value", "double")


def size(folder):
    return sum(f.stat().st_size for f in Path(folder).rglob("*.parquet"))


def contents(frame):
    return {r["k"]: (r["name"], r["value"]) for r in frame.collect()}


def test_last_write_wins_over_random_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "PART_ROWS", 40)
    store, want, rng = Runs(spark, str(tmp_path), SCHEMA, ["k"]), {}, random.Random(3)
    assert store.read().count() == 0 and store.runs() == []
    for version in range(9):
        keys = rng.sample(range(120), rng.choice([1, 5, 60]))
        gone, kept = keys[: len(keys) // 3], keys[len(keys) // 3 :]
        rows = [(k, f"n{version}" if k % 5 else None, rng.random()) for k in kept]
        store.write(version, spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(k,) for k in gone], "k long"))
        want = {k: v for k, v in want.items() if k not in gone} | {r[0]: r[1:] for r in rows}
        assert contents(store.read()) == want
        asked = spark.createDataFrame([(k,) for k in (3, 7, 7, 500)], "k long")
        assert contents(store.read(keys=asked)) == {k: v for k, v in want.items() if k in (3, 7, 500)}
        sizes = [r.rows for r in store.runs()]
        assert all(a > 2 * b for a, b in zip(sizes, sizes[1:]))


def test_a_version_written_again_is_the_same(spark, tmp_path):
    store = Runs(spark, str(tmp_path), SCHEMA, ["k"])
    row = lambda k, v: spark.createDataFrame([(k, "x", v)], SCHEMA)
    store.write(0, row(1, 1.0))
    store.write(1, row(2, 2.0))
    store.write(1, row(3, 3.0))
    assert contents(store.read()) == {1: ("x", 1.0), 3: ("x", 3.0)}
    assert contents(store.read(0)) == {1: ("x", 1.0)}


def test_a_batch_that_fails_leaves_the_last_version(spark, tmp_path, monkeypatch):
    store = Runs(spark, str(tmp_path), SCHEMA, ["k"])
    store.write(0, spark.createDataFrame([(1, "x", 1.0)], SCHEMA))
    monkeypatch.setattr(Runs, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.write(1, spark.createDataFrame([(1, "y", 2.0)], SCHEMA))
    assert contents(store.read()) == {1: ("x", 1.0)}
    monkeypatch.undo()
    store.write(1, spark.createDataFrame([(1, "z", 3.0)], SCHEMA))
    assert contents(store.read()) == {1: ("z", 3.0)}
    assert len(list((tmp_path / "runs").iterdir())) <= 2 * runs.KEPT


def test_bytes_written_follow_the_batch(spark, tmp_path):
    store = Runs(spark, str(tmp_path), SCHEMA, ["k"])
    store.write(0, spark.range(200_000).select(F.col("id").alias("k"), F.sha1(F.col("id").cast("string")).alias("name"), F.rand(1).alias("value")))
    whole = size(tmp_path)
    for version in range(1, 4):
        before = size(tmp_path)
        store.write(version, spark.createDataFrame([(version * 1000 + n, "new", 1.0) for n in range(20)], SCHEMA))
        assert size(tmp_path) - before < whole / 100
    assert store.runs()[0].parts == 2
    assert store.read().count() == 200_000
    # one key opens one part of the large run
    opened = store._rows(store.runs()[0], spark.createDataFrame([(5,)], "k long"))
    assert opened.select(F.input_file_name()).distinct().count() == 1
    assert 50_000 < opened.count() < 150_000
