"""Queries with SQL, on the smallest tables, and the edge cases of the table operators."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import kdtree, mixing, queries, rabitq
from quillon.llm.shared import connected_components

from ..oracle import rows_of, sql_rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [
    (1, "a b c d e", "en", "s1", 9), (1, "a b c d e", "en", "s1", 9), (None, "a b c d e", None, None, None), (2, None, "en", "s1", None), (3, "", "en", None, 0), (4, "x " * 30_000, "en", "s2", 60_000),
    (5, f"{chr(233)}{chr(0x1F600)} \n\n|", "fr", "s1", 7), (-7, "A B C D E", "en", "s1", 9),
]


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, repeats, empty and long texts, and extra columns with clashing names."""
    frame = spark.createDataFrame(AWKWARD, DOCS)
    return frame.withColumns({c: F.lit(9) for c in ("copy", "n_copies", "shuffle_key", "row", "size", "v", "fp", "leaf", "node", "bucket", "text_", "digest", "term", "word", "salt", "key", "file")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, folder, name):
    assert rows_of(queries.queries()[name](spark, folder)) == sql_rows(folder, queries.oracle_sql()[name])


def test_components_of_a_long_path_and_a_star(spark):
    path = [(k, k + 1) for k in range(0, 400)]
    star = [(1000, 1000 + k) for k in range(1, 50)]
    random.Random(1).shuffle(path)
    got = {r["v"]: r["component"] for r in connected_components(spark.createDataFrame(path + star + [(7, 7)], "src long, dst long")).collect()}
    assert got == {k: 0 for k in range(401)} | {1000 + k: 1000 for k in range(50)}


# ----------------------------------------------------------- embeddings


def brute(vectors, threshold=0.9):
    ok = {i: np.array(v, float) for i, v in vectors if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    near = collections.defaultdict(list)
    for i in ok:
        for j in ok:
            if i != j and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / np.linalg.norm(ok[i]) / np.linalg.norm(ok[j]) >= threshold:
                near[i].append(j)
    least = {i: i for i, _ in vectors}
    for _ in vectors:
        for i in near:
            least[i] = min([least[i], *(least[j] for j in near[i])])
    return {i: (len(near[i]), least[i]) for i, _ in vectors}


def test_rabitq_finds_every_link(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 24))
    vectors = [(k, (base[k % 40] + rng.standard_normal(24) * rng.choice([0, 0.2, 0.35, 0.5])).tolist()) for k in range(400)]
    vectors += [(500, None), (501, [0.0] * 24), (502, [1.0, None] * 12), (503, [float("nan")] * 24), (504, [1.0, 2.0]), (505, [2.0, 4.0]), (506, [])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rabitq.near_duplicates(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()}
    assert got == brute(vectors)


def test_rabitq_decides_pairs_at_the_threshold(spark, monkeypatch):
    """Several groups, and pairs whose cosine is the threshold but for rounding."""
    monkeypatch.setattr(rabitq, "GROUP_ROWS", 40)
    rng = np.random.default_rng(5)
    vectors = []
    for k in range(60):
        a, b = np.linalg.qr(rng.standard_normal((16, 2)))[0].T
        for c in (0.9 + 1e-13, 0.9 - 1e-13, 0.9 + 1e-6, 0.9 - 1e-6):
            vectors += [(len(vectors), a.tolist()), (len(vectors) + 1, (c * a + math.sqrt(1 - c * c) * b).tolist())]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rabitq.near_duplicates(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()}
    assert got == brute(vectors)


def test_rabitq_estimate_is_unbiased_and_bounded():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 64))
    unit, bits, factor = rabitq.encode(x, 1)
    turned = unit @ rabitq.rotation(64, 1)
    code = (np.unpackbits(bits, axis=1, count=64) * 2.0 - 1) / 8
    true, raw = unit @ unit.T, code @ turned.T
    assert abs((raw / factor[:, None] - true)[~np.eye(300, dtype=bool)].mean()) < 0.01
    # whatever a pair's cosine is, its product reaches the certain cut of that cosine
    q = unit[:1] * 0.95 + 0.05 * unit
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    cosine = (unit[0] * q).sum(axis=1)
    product = (code[0] * (q @ rabitq.rotation(64, 1))).sum(axis=1)
    assert all(p >= rabitq.lower_cut(factor[:1], c, 64, None)[0] - 1e-9 for p, c in zip(product, cosine, strict=True))


def test_rabitq_repeats_and_empty(spark):
    got = rabitq.near_duplicates(spark.createDataFrame([(3, [1.0, 0.0])] * 2 + [(2, [1.0, 0.0]), (None, [0.0, 1.0])], "vec_id long, embedding array<float>").withColumn("v", F.lit(1)))
    rows = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in got.collect())
    assert rows == [(-1, 0, None, True), (2, 2, 2, True), (3, 2, 2, False), (3, 2, 2, False)]
    assert rabitq.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# ------------------------------------------------------------- sharding


def brute_kd(rows, leaves, scale, whole):
    """Exact weighted medians by sorting; the rows of the crossing (metadata, CRC) go together if they are small."""
    if leaves == 1:
        return [rows]
    spread = [(max(r[4][k] for r in rows) - min(r[4][k] for r in rows)) / scale[k] for k in range(3)] if rows else [0] * 3
    k = max(range(3), key=lambda d: (spread[d], -d))
    rows = sorted(rows, key=lambda r: (r[4][k], r[2], r[0]))
    target, left, at = sum(r[1] for r in rows) * (leaves // 2) / leaves, 0, 0
    while at < len(rows) and left + rows[at][1] < target:
        left += rows[at][1]
        at += 1
    if at < len(rows):
        point = [n for n, r in enumerate(rows) if (r[4][k], r[2]) == (rows[at][4][k], rows[at][2])]
        size = sum(rows[n][1] for n in point)
        if size > whole:
            point, size = [at], rows[at][1]
        before = sum(r[1] for r in rows[: point[0]])
        at = point[-1] + 1 if before + size / 2 <= target else point[0]
    return brute_kd(rows[:at], leaves // 2, scale, whole) + brute_kd(rows[at:], leaves - leaves // 2, scale, whole)


@pytest.mark.parametrize(("shards", "literal", "whole"), [(8, 64, 0.01), (5, 64, 0.0), (5, 0, 0.01)])
def test_kd_tree_equals_sorting(spark, folder, shards, literal, whole, monkeypatch):
    monkeypatch.setattr(kdtree, "LITERAL_NODES", literal)
    monkeypatch.setattr(kdtree, "WHOLE", whole)
    docs = spark.read.parquet(f"{folder}/documents.parquet").dropDuplicates(["doc_id"])
    code = lambda s: zlib.crc32(s.encode())
    held = docs.collect()
    least = {}
    for r in held:
        own = (r["n_chars"], code(r["source"]), code(r["lang"]))
        least[r["text"]] = tuple(map(min, least.get(r["text"], own), own))
    rows = [(r["doc_id"], len(r["text"].encode()) + 1, zlib.crc32(r["text"].encode()), 0, least[r["text"]]) for r in held]
    scale = [max(r[4][k] for r in rows) - min(r[4][k] for r in rows) or 1 for k in range(3)]
    want = {r[0]: n for n, leaf in enumerate(brute_kd(rows, shards, scale, whole * sum(r[1] for r in rows) / shards)) for r in leaf}
    got = kdtree.kd_shards(docs, shards=shards).collect()
    assert {r["doc_id"]: r["shard"] for r in got} == want
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_kd_tree_keeps_equal_texts_together(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = kdtree.kd_shards(docs, shards=8).join(docs.select("doc_id", "text"), "doc_id")
    sizes = [r["b"] for r in got.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert max(sizes) - min(sizes) <= 0.06 * sum(sizes) / 8
    groups = got.groupBy("text").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.countDistinct("shard").alias("shards")).where("n > 1").collect()
    assert len(groups) > 20
    assert all(g["shards"] == 1 for g in groups if g["bytes"] <= 0.01 * sum(sizes) / 8)


def test_kd_tree_on_awkward_rows(awkward, empty):
    rows = kdtree.kd_shards(awkward, shards=3).collect()
    assert len(rows) == len(AWKWARD)
    assert sorted(r["size"] for r in rows)[0] == 1
    assert kdtree.kd_shards(empty, shards=8).count() == 0
    assert 0 < kdtree.kd_shards(awkward, target_bytes=30_000).agg(F.max("shard")).first()[0] <= 2  # one text is larger than a leaf


def test_kd_tree_divides_a_group_of_copies(spark):
    rows = [(k, "same text", "en", "s", 9) for k in range(800)] + [(1000 + k, f"other {k}", "en", "s", 8) for k in range(400)]
    got = kdtree.kd_shards(spark.createDataFrame(rows, DOCS), shards=8).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    sizes = [r["b"] for r in got]
    assert len(sizes) == 8
    assert max(sizes) - min(sizes) <= 3 * 10


# --------------------------------------------------------------- mixing


def test_mixing_meets_its_targets(spark):
    rows = [(k, "x" * 99, "en", "hot" if k % 3 else "cold", 99) for k in range(6000)]
    out = mixing.mix(spark.createDataFrame(rows, DOCS), weights={"hot": 1.0, "cold": 3.0, "absent": 0.0})
    n = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert n["cold"] / 6000 == pytest.approx(0.75, abs=0.05)
    assert n["hot"] / 6000 == pytest.approx(0.25, abs=0.03)


def test_mixing_draws_poisson_counts(spark):
    rows = [(k, "x", "en", "s", 1) for k in range(20_000)]
    counts = collections.Counter(r["mix_copies"] for r in mixing.mix(spark.createDataFrame(rows, DOCS), total_bytes=2 * 2 * 20_000).where("mix_copy = 1").collect())
    for k in range(1, 6):
        assert counts[k] / 20_000 == pytest.approx(math.exp(-2) * 2**k / math.factorial(k), abs=0.012)


def test_mixing_of_large_rates_and_awkward_rows(spark, awkward, empty):
    rows = [(k, "x", "en", "s", 1) for k in range(400)]
    mean = mixing.mix(spark.createDataFrame(rows, DOCS), total_bytes=100 * 2 * 400).count() / 400
    assert mean == pytest.approx(100, abs=2)
    clash = mixing.mix(awkward.withColumn("mix_copy", F.lit("mine")).withColumn("mix_source", F.lit("too")))
    assert {r["mix_copy"] for r in clash.collect()} == {"mine"} and "mix_copy_" in clash.columns
    out = mixing.mix(awkward)
    assert {*awkward.columns, "mix_copy", "mix_key"} <= set(out.columns)
    pairs = collections.Counter((r["doc_id"], r["mix_copy"]) for r in out.collect())
    assert pairs[(1, 1)] in (0, 2)
    assert mixing.mix(empty).count() == 0
