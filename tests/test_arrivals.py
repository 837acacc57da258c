"""Results as artists arrive: blocks, batch and stream against one loop over everything."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import blocks
from quillon.streaming import arrivals as ar

NAMES = ["fox", "foxy", "foxyart", "foxyartist", "bluewolf", "BlueWolf.bsky.social", "blue_wolf", "wolfblue", "bluewolf1", "kira", "kira_draws", "ki", "kirakira", "莉", "莉莉", "owl", "OWL!", "nightowl", "night.owl.art"]


def people(n, seed):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        rows.append((seq * 3 + 1, rng.choice(NAMES), rng.choice([*NAMES, None, "", "Someone Else", "somebody"]), rng.choice(["fa", "bsky", "third"]), rng.choice(["open", "closed", "unclear", None]), rng.choice([0.2, 0.5, 0.5, 0.9, None]), rng.choice([1, 2, 3, None])))
    return rows


def one_loop(rows):
    results = {}
    for r in sorted(rows):
        ar.absorb(results, dict(zip([f.split()[0] for f in ar.ARRIVAL.split(", ")], r, strict=True)))
    return shaped({"id": i, **r} for i, r in results.items())


def shaped(rows):
    return {r["id"]: (*(r[k] for k in ar.FIELDS[:6]), tuple(json.loads(r["platforms"] or "[]")), json.dumps(json.loads(r["platform_data"] or "{}"), sort_keys=True)) for r in rows}


def collected(frame):
    return shaped(r.asDict() for r in frame.collect())


def test_similar_is_the_rule_of_the_columns(spark):
    from quillon.functions.scalars import similar_names

    pairs = [(a, b) for a in [*NAMES, None, ""] for b in NAMES]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similar_names(F.col("a"), F.col("b")).alias("s")).collect()
    assert all(ar.similar(r["a"], r["b"]) == r["s"] for r in rows)


@pytest.mark.parametrize("length", [1, 2, 3, 200])
def test_components_of_chains_and_stars(spark, length):
    rng = random.Random(length)
    ids = rng.sample(range(10_000), length + 1)
    edges = list(zip(ids, ids[1:])) + [(20_000, 20_000 + k) for k in range(1, 6)] + [(9_999_999, 9_999_999)]
    rng.shuffle(edges)
    got = {r["v"]: r["component"] for r in blocks.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: min(ids) for i in ids} | {20_000 + k: 20_000 for k in range(6)} | {9_999_999: 9_999_999}


def test_similar_names_share_a_block(spark):
    rows = [(n, m) for n in NAMES for m in (None, "", n)]
    people_ = spark.createDataFrame(rows, "username string, display_name string")
    found = blocks.with_blocks(people_, blocks.name_blocks(people_)).select("username", "block").distinct().collect()
    of = {r["username"]: r["block"] for r in found}
    assert len(found) == len(of) == len(set(NAMES))
    assert all(of[a] == of[b] for a in NAMES for b in NAMES if ar.similar(a, b))
    assert of["莉"] != of["莉莉"] and of["ki"] != of["owl"]
    assert blocks.name_blocks(people_.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_batch_equals_one_loop(spark, seed):
    rows = people(150, seed)
    frame = spark.createDataFrame(rows, ar.ARRIVAL).repartition(5)
    known = blocks.name_blocks(frame.select("username", "display_name"))
    assert collected(ar.merge_arrivals(frame, known)) == one_loop(rows)
    assert ar.merge_arrivals(frame.limit(0), known).count() == 0


def test_stream_with_a_restart_equals_one_loop(spark, tmp_path):
    """Three files, one a batch; the query ends after the first and after the second, and goes on from its offsets."""
    rows = people(90, 5)
    known = blocks.name_blocks(spark.createDataFrame(rows, ar.ARRIVAL).select("username", "display_name"))
    place = str(tmp_path)
    for n, part in enumerate((rows[:30], rows[30:60], rows[60:])):
        spark.createDataFrame(part, ar.ARRIVAL).coalesce(1).write.mode("append").parquet(f"{place}/in")
        stream = spark.readStream.schema(ar.ARRIVAL).option("maxFilesPerTrigger", 1).parquet(f"{place}/in")
        running = ar.merge_stream(stream, known, place)
        running.awaitTermination()
        assert running.exception() is None
        assert collected(ar.merged_results(spark, place)) == one_loop(rows[: 30 * (n + 1)])


def test_a_batch_writes_the_results_of_its_own_keys(spark, tmp_path):
    rows = [(k, f"artist{k:04d}x", None, "fa", "open", 0.5, 1) for k in range(400)]
    known = blocks.name_blocks(spark.createDataFrame(rows, ar.ARRIVAL).select("username", "display_name"))
    place = str(tmp_path)
    for part in (rows, [(1000, "artist0007x", None, "bsky", "closed", 0.9, 2), (1001, "artist0009x", None, "fa", "open", 0.6, 2), (1002, "artist0010x", None, "fa", "open", 0.1, 2)]):
        spark.createDataFrame(part, ar.ARRIVAL).coalesce(1).write.mode("append").parquet(f"{place}/in")
        ar.merge_stream(spark.readStream.schema(ar.ARRIVAL).option("maxFilesPerTrigger", 1).parquet(f"{place}/in"), known, place).awaitTermination()
    assert [r.rows for r in ar._store(spark, place).runs()] == [400, 2]
    got = collected(ar.merged_results(spark, place))
    assert len(got) == 400 and got[7][6] == ("fa", "bsky") and got[9][4] == 0.6 and got[10][4] == 0.5


def test_a_group_takes_many_blocks(spark):
    """The number of groups grows with the arrivals, not with their blocks, and the results are those of one block a group."""
    rows = [(k, f"name{k:05d}x", None, "furaffinity" if k % 2 else "bluesky", "open", (k % 7) / 10, k) for k in range(300)]
    rows += [(1000 + k, f"name{k:05d}x", None, "furaffinity", "closed", 0.65, k) for k in range(0, 300, 3)]
    given = spark.createDataFrame(rows, ar.ARRIVAL)
    blocks = spark.createDataFrame([], "name_key long, block long")
    out = ar.merge_arrivals(given, blocks)
    assert "pmod(" in out._jdf.queryExecution().optimizedPlan().toString()
    one = ar.merge_arrivals(given, blocks, each=1)
    assert sorted(map(str, out.collect())) == sorted(map(str, one.collect()))


def test_a_call_of_the_stream_takes_many_blocks():
    """Blocks of one call don't meet, and state is read and written for the call's blocks only."""
    import pandas as pd

    held, asked = {}, []

    class State:
        def containsKey(self, key):
            asked.append(key)
            return key in held

        def getValue(self, key):
            return held[key]

        def updateValue(self, key, value):
            held[key] = value

    class Handle:
        def getMapState(self, *_):
            return State()

    names = [f.split()[0] for f in ar.ARRIVAL.split(", ")]
    rows = [(*r, r[0] % 2) for r in people(60, 9)]
    for part in (rows[:30], rows[30:]):
        merging = ar.Merging()
        merging.init(Handle())
        list(merging.handleInputRows((0,), iter([pd.DataFrame(part, columns=[*names, "block"])]), None))
    got = {i: values for block in held.values() for i, *values in json.loads(block[0])}
    want = {block: one_loop([r[:-1] for r in rows if r[-1] == block]) for block in (0, 1)}
    assert shaped({"id": i, **dict(zip(ar.FIELDS, v, strict=True))} for i, v in got.items()) == want[0] | want[1]
    assert len(asked) == 4
