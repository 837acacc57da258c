"""SimHash near-duplicates found through vantage-point trees.

Fingerprints (64 bits) are voted by the XXH64 of every word shingle.  Distinct
fingerprints are partitioned by a small forest of vantage-point trees.  Tree i
measures Hamming distance on the i-th of m disjoint bit blocks, a
pseudo-metric no larger than the full distance; two fingerprints within
``max_bits`` are within r = floor(max_bits / m) on at least one block, so a
search of radius r in every tree loses no pair.  A node sends points with
d(v, x) <= t inward and the others outward; the triangle bound says that only
points with t < d <= t + r have to visit the inner side as well.  A leaf is a
shard: it compares its own points with each other and with its visitors on all
64 bits, and passes on a spanning forest of its links, never all of them.

The trees are grown on a bounded sample of fingerprints (``SAMPLE_MOST``); the sample
decides only where shards begin, not what is found.  Where the triangle bound
prunes nothing (wide radii) a tree stays a single leaf, which is cut into blocks.

Edge cases: null or empty text has no words and the fingerprint 0, linked like
any other; texts shorter than a shingle are one shingle; repeated rows share
their fingerprint; a null id takes part, is never the smallest id unless all
ids of the group are null; empty tables give empty results; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import connected_components, local_components, materialise, slices, tidy

SEED = 42
#: Fingerprints on which the trees are grown: these, or a 64th of all up to the second number.
SAMPLE, SAMPLE_MOST = 65_536, 1 << 20
#: Points of a leaf that the growth aims at, and of a block that one task compares with another.
LEAF, CHUNK = 1024, 32_768
#: 64-bit words of a set's parity sketch.
SKETCH = 8
#: Sets on which shingles are counted, and shingles whose counts travel, at most; common shingles
#: come last in the order of prefixes, which decides where sets meet, not what is found.
COUNTED, COMMON = 20_000, 1 << 18
#: Ids that are broadcast, at most.
BROADCAST_IDS = 1 << 19
#: Shingles of their prefixes that similar sets share at least.
SHARED = 3
#: No tree has more leaves; this bounds what the driver holds.
MOST_LEAVES = 65_536


# ------------------------------------------------------------- fingerprints


def shingle_hashes(text: bytes, width: int) -> list[int]:
    """XXH64 of all shingles, repeats included, of the ASCII-lowered words."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - width].tolist()]
    stops = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)]


def vote(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of the number of shingles in each of 64 * SKETCH buckets, as words.

    A shingle of one set alone changes one bit, so the Hamming distance of two
    sketches is at most the number of shingles that the sets don't share.
    """
    odd = np.bincount(shingles & np.uint32(64 * SKETCH - 1), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, with_set: bool = False) -> DataFrame:
    """(doc_id, fp long) per row; ``with_set`` adds the text's MD5, the sorted
    distinct low words of the shingle hashes (uint32, little-endian) for set
    similarity and their sketch, and lets each shingle vote once."""
    schema = "doc_id long, fp long" + (", digest string, shingles binary" + "".join(f", s{k} long" for k in range(SKETCH)) if with_set else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps, digests, sets, words = [], [], [], []
            for text in batch.column("text").to_pylist():
                h = np.array(shingle_hashes((text or "").encode(), width), dtype=np.uint64)
                fps.append(vote(np.unique(h) if with_set else h))
                if with_set:
                    low = np.unique(h.astype(np.uint32))
                    digests.append(hashlib.md5((text or "").encode()).hexdigest())
                    sets.append(low.astype("<u4").tobytes())
                    words.append(sketch(low))
            columns = [batch.column("doc_id"), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))]
            names = ["doc_id", "fp"]
            if with_set:
                columns += [pa.array(digests), pa.array(sets, pa.binary()), *[pa.array(np.ascontiguousarray(c)) for c in np.stack(words, axis=1)]]
                names += ["digest", "shingles", *[f"s{k}" for k in range(SKETCH)]]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


# -------------------------------------------------------------------- trees


def _distance(a: np.ndarray, b: np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class Tree:
    """A vantage-point tree on one bit block, kept as flat lists."""

    def __init__(self, mask: int, radius: int, sample: np.ndarray, points: int) -> None:
        self.mask, self.radius = np.uint64(mask), radius
        self.vantage: list[int] = []
        self.cut: list[int] = []
        self.child: list[tuple[int, int]] = []  # >= 0: node, < 0: leaf -(x + 1)
        self.leaves = 0
        self.scale = points / max(1, len(sample))
        self.rng = np.random.default_rng(mask % (2**32))
        self.root = self._grow(sample & self.mask, 0)

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _grow(self, own: np.ndarray, depth: int) -> int:
        if len(own) * self.scale <= LEAF or self.leaves >= MOST_LEAVES or depth >= 24 or len(own) < 8:
            return self._leaf()
        best = None
        for v in self.rng.choice(own, 4):
            # the point opposite to a member spreads as well; a random far point spreads clusters
            for w in (v, v ^ self.mask):
                d = _distance(own, w)
                for t in np.unique(np.quantile(d, (0.4, 0.5, 0.6)).astype(int)):
                    inner = d <= t
                    a, b, visits = inner.sum(), (~inner).sum(), ((d > t) & (d <= t + self.radius)).sum()
                    cost = a * (a / 2 + visits) + b * b / 2
                    if a and b and (best is None or cost < best[0]):
                        best = (cost, w, int(t), inner)
        if best is None or best[0] > 0.45 * len(own) ** 2:  # without a split: 0.5 n^2
            return self._leaf()
        at = len(self.vantage)
        self.vantage.append(int(best[1]))
        self.cut.append(best[2])
        self.child.append((0, 0))
        self.child[at] = (self._grow(own[best[3]], depth + 1), self._grow(own[~best[3]], depth + 1))
        return at

    def route(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(leaf, indices, whether they are at home there) for all points."""
        x = points & self.mask
        todo = [(self.root, np.arange(len(x)), True)]
        while todo:
            node, idx, home = todo.pop()
            if not len(idx):
                continue
            if node < 0:
                yield -node - 1, idx, home
                continue
            d, t = _distance(x[idx], np.uint64(self.vantage[node])), self.cut[node]
            inner, outer = self.child[node]
            if home:
                todo += [(inner, idx[d <= t], True), (outer, idx[d > t], True), (inner, idx[(d > t) & (d <= t + self.radius)], False)]
            else:
                todo += [(inner, idx[d <= t + self.radius], False), (outer, idx[d > t - self.radius], False)]


def grow_forest(distinct: DataFrame, max_bits: int, blocks: int) -> list[Tree]:
    """Trees over ``blocks`` disjoint bit blocks, from a bounded sample of fp."""
    n = distinct.count()
    most = max(SAMPLE, min(SAMPLE_MOST, n // 64))
    share = min(1.0, 1.2 * most / max(1, n))
    picked = distinct.select("fp") if share == 1.0 else distinct.select("fp").where(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < int(share * (1 << 20)))
    sample = np.array([r[0] for r in picked.limit(most).collect()], dtype=np.int64).view(np.uint64)
    edges = [64 * k // blocks for k in range(blocks + 1)]
    return [Tree((1 << edges[k + 1]) - (1 << edges[k]), max_bits // blocks, sample, n) for k in range(blocks)]


def near_pairs_in(home: np.ndarray, others: np.ndarray, max_bits: int, own: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into home, into home + others) within max_bits, each once;
    without ``own`` the points of home aren't compared with each other."""
    every, step = np.concatenate((home, others)), max(1, (1 << 22) // max(1, len(home) + len(others)))
    for at in range(0, len(home), step):
        first = at if own else len(home)
        i, j = np.nonzero(np.bitwise_count(home[at : at + step][:, None] ^ every[None, first:]) <= max_bits)
        i, j = i + at, j + first
        keep = j > i
        yield i[keep], j[keep]


def cells(rows: DataFrame, block: str, home: str, parts: str, visiting: str) -> DataFrame:
    """Send blocks to the cells (i, j) in which each pair of blocks meets once.

    ``parts`` own blocks and ``visiting`` blocks of visitors: cell (i, i) holds
    own block i and visitor block 0, (i, j) with j > i two own blocks, (i, -k) own
    block i and visitor block k.  ``first`` marks the rows of own block i.  So a
    cell holds two blocks, however large the whole is.
    """
    o, p, v, none = F.col(block), F.col(parts), F.col(visiting), F.array().cast("array<struct<i:int,j:int,first:boolean>>")
    cell = lambda i, j, first: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(first).alias("first"))
    left = F.transform(F.sequence(o, p - 1), lambda j: cell(o, j, True))
    right = F.when(o > 0, F.transform(F.sequence(F.lit(0), o - 1), lambda i: cell(i, o, False))).otherwise(none)
    cross = F.when(v > 1, F.transform(F.sequence(F.lit(1), v - 1), lambda k: cell(o, -k, True))).otherwise(none)
    visits = F.when(p > 0, F.transform(F.sequence(F.lit(0), p - 1), lambda i: cell(i, F.when(o == 0, i).otherwise(-o), False))).otherwise(none)
    return rows.withColumn("cell", F.explode(F.when(F.col(home), F.concat(left, right, cross)).otherwise(visits))).drop(block, home, parts, visiting).select("*", "cell.*").drop("cell")


def links(distinct: DataFrame, max_bits: int = 4, blocks: int = 3) -> DataFrame:
    """Spanning links (src, dst) between the distinct fingerprints ``fp``."""
    forest = grow_forest(distinct, max_bits, blocks)
    base = np.cumsum([0, *[t.leaves for t in forest]])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False)
            for k, tree in enumerate(forest):
                parts = [(base[k] + leaf, idx, home) for leaf, idx, home in tree.route(fps.view(np.uint64))]
                if parts:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate([np.full(len(i), leaf, np.int32) for leaf, i, _ in parts])),
                            pa.array(np.concatenate([fps[i] for _, i, _ in parts])),
                            pa.array(np.concatenate([np.full(len(i), home) for _, i, home in parts])),
                        ],
                        ["leaf", "fp", "home"],
                    )

    routed = materialise(distinct.select("fp").mapInArrow(route, "leaf int, fp long, home boolean"), "vp-routed")
    # a row for each leaf, of which there are MOST_LEAVES a tree at most
    counts = routed.groupBy("leaf").agg(*[F.greatest(F.lit(1), F.ceil(F.count(F.when(c, 1)) / F.lit(CHUNK))).cast("int").alias(n) for n, c in (("parts", F.col("home")), ("visiting", ~F.col("home")))])
    dealt = routed.join(F.broadcast(counts), "leaf")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("fp"), F.when(F.col("home"), F.col("parts")).otherwise(F.col("visiting"))).cast("int"))

    def compare(group: pa.Table) -> pa.Table:
        fps, first = group.column("fp").to_numpy().view(np.uint64), group.column("first").to_numpy(zero_copy_only=False).astype(bool)
        order = np.concatenate((np.nonzero(first)[0], np.nonzero(~first)[0]))
        label = np.arange(len(order))
        for i, j in near_pairs_in(fps[first], fps[~first], max_bits, group.column("i")[0] == group.column("j")[0]):
            local_components(label, i, j)
        out = np.nonzero(label != np.arange(len(order)))[0]
        point = fps[order].view(np.int64)
        return pa.table({"src": point[out], "dst": point[label[out]]})

    return cells(dealt, "block", "home", "parts", "visiting").groupBy("leaf", "i", "j").applyInArrow(compare, "src long, dst long")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, max_bits: int = 4, blocks: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) per row: classes of fingerprints linked at
    ``max_bits`` or fewer differing bits, named by their smallest id."""
    with tidy(docs.sparkSession):
        prints = materialise(fingerprints(docs, id_col, text_col, width), "simhash")
        distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
        component = connected_components(links(distinct, max_bits, blocks)).withColumnRenamed("v", "fp")
        named = distinct.join(component, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
        least = named.groupBy("component").agg(F.min("least").alias("component_id"))
        by_print = named.join(least, "component").select("fp", "component_id")
        return materialise(prints.join(by_print, "fp").select("doc_id", "fp", "component_id"), "simhash-groups", keep=True)


# ----------------------------------------------- similarity of shingle sets


def _prefixes(sets: DataFrame, n: int, similarity: float) -> DataFrame:
    """(shingle, v, place): the shingles of each of the ``n`` sets' prefixes that
    another set's prefix has, too.

    Similar sets of a and b shingles share at least o = similarity * max(a, b), so
    in any common order of shingles the first a - o + SHARED of one and b - o +
    SHARED of the other have SHARED of them in common (all, if o is less).
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "shingles"):
            values, counts = np.unique(np.frombuffer(b"".join(batch.column("shingles").to_pylist()), dtype="<u4"), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.int64)), pa.array(counts.astype(np.int64))], ["shingle", "n"])

    share = min(1.0, COUNTED / max(1, n))
    counted = sets.select("shingles") if share == 1.0 else sets.select("shingles").where(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < int(share * (1 << 20)))
    counts = counted.mapInArrow(tally, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "shingle").limit(COMMON).toArrow().sort_by("shingle")
    common = counts["shingle"].to_numpy().astype(np.uint32)
    often = counts["n"].to_numpy().astype(np.int64)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "shingles", 1 << 20):
            kept = []
            for raw in batch.column("shingles").to_pylist():
                x = np.frombuffer(raw, dtype="<u4")
                if len(common):
                    at = np.minimum(np.searchsorted(common, x), len(common) - 1)
                    x = x[np.lexsort((x, np.where(common[at] == x, often[at], 0)))]
                kept.append(x[: len(x) - int(np.ceil(len(x) * similarity - 1e-6)) + SHARED])
            taken = np.array([len(x) for x in kept])
            if taken.sum():
                place = np.concatenate([np.arange(k, dtype=np.int32) for k in taken])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(kept).view(np.int32)), pa.array(np.repeat(batch.column("v").to_numpy(), taken)), pa.array(place)], ["shingle", "v", "place"])

    # most shingles of prefixes are in one set only; they end here, before anything is attached to them
    rows = sets.select("v", "shingles").mapInArrow(first, "shingle int, v long, place int")
    return materialise(rows.withColumn("sets", F.count("*").over(Window.partitionBy("shingle"))).where("sets > 1").drop("sets"), "near-prefixes")


def may_be_similar(similarity: float) -> Column:
    """Whether sketches and sizes of rows a and b allow the similarity; it never
    rules a similar pair out."""
    apart = sum((F.bit_count(F.col(f"a.s{k}").bitwiseXOR(F.col(f"b.s{k}"))) for k in range(SKETCH)), F.lit(0))
    return (F.least("a.size", "b.size") >= F.greatest("a.size", "b.size") * F.lit(similarity) - F.lit(1e-6)) & (apart <= (F.col("a.size") + F.col("b.size")) * F.lit((1 - similarity) / (1 + similarity)) + F.lit(1e-6))


def _open(prefixes: DataFrame, points: DataFrame) -> DataFrame:
    """Prefix rows with their component, of shingles that several components have."""
    rows = materialise(prefixes.join(points.select("v", "component"), "v"), "near-rows")
    several = rows.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("shingle")
    return materialise(rows.join(several, "shingle", "left_semi"), "near-open")


def hub_pairs(prefixes: DataFrame, points: DataFrame, similarity: float, each: bool = False) -> DataFrame:
    """(src, dst): each set with two sets of each of its prefix shingles, the first and
    the last by a hash, where the pair may be similar; at most two pairs a row,
    however common a shingle is.  The hash is of the set, so that few sets are hubs,
    or with ``each`` of set and shingle, so that a set meets many others of its group."""
    order = F.xxhash64("v", "shingle") if each else F.xxhash64("v")
    rows = _open(prefixes, points).select("shingle", "v").withColumn("u", order)
    ends = rows.groupBy("shingle").agg(F.min("u").alias("low"), F.max("u").alias("high"))
    hubs = rows.join(ends, "shingle").where("u = low or u = high").select("shingle", F.col("v").alias("hub"))
    met = materialise(rows.select("shingle", "v").join(hubs, "shingle").where("v <> hub").select(F.least("v", "hub").alias("src"), F.greatest("v", "hub").alias("dst")).distinct(), "near-hubs")
    met = met.join(points.alias("a"), F.col("src") == F.col("a.v")).join(points.alias("b"), F.col("dst") == F.col("b.v"))
    return met.where(F.col("a.component") != F.col("b.component")).where(may_be_similar(similarity)).select("src", "dst")


def meetings(rows: DataFrame, similarity: float) -> DataFrame:
    """(src, dst, a, b, i, j): rows (shingle, v, place, size, component, sketch) of two components that meet on
    a shingle, with sizes and places, where sizes, sketches and places allow the similarity.

    A similar pair has at least ``need`` shingles in common, so the first ``SHARED`` of them lie before
    size - need + SHARED on both sides.  Prefixes are longer, as their length is for the smallest partner;
    what they share farther on lies behind, so it is bounded by the sizes as everything there is.
    """
    need = F.ceil((F.col("a.size") + F.col("b.size")) * F.lit(similarity / (1 + similarity)) - F.lit(1e-6))
    early = (F.col("a.place") < F.col("a.size") - need + SHARED) & (F.col("b.place") < F.col("b.size") - need + SHARED)
    met = rows.alias("a").join(rows.alias("b"), F.col("a.shingle") == F.col("b.shingle")).where("a.v < b.v and a.component <> b.component").where(early & may_be_similar(similarity))
    return met.select(F.col("a.v").alias("src"), F.col("b.v").alias("dst"), F.col("a.size").alias("a"), F.col("b.size").alias("b"), F.col("a.place").alias("i"), F.col("b.place").alias("j"))


def prefix_pairs(prefixes: DataFrame, points: DataFrame, similarity: float) -> DataFrame:
    """(src, dst): all pairs of different components whose sets may have the
    similarity, each once.  The shingles after the last one shared in the prefixes
    bound what else is shared."""
    least = lambda size: F.ceil(size * F.lit(similarity) - F.lit(1e-6))
    rows = materialise(_open(prefixes, points).drop("component").join(points, "v"), "near-sketched")
    shared = meetings(rows, similarity).groupBy("src", "dst", "a", "b").agg(F.count("*").alias("n"), F.max("i").alias("i"), F.max("j").alias("j"))
    most = F.col("n") + F.least(F.col("a") - F.col("i"), F.col("b") - F.col("j")) - 1
    return shared.where((F.col("n") >= F.least(F.lit(SHARED), least(F.greatest("a", "b")))) & (most >= (F.col("a") + F.col("b")) * F.lit(similarity / (1 + similarity)) - F.lit(1e-6))).select("src", "dst")


def decide(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (src, dst) whose sets in (v, shingles) have the similarity."""
    pairs = materialise(pairs, "near-pairs")
    asked = materialise(pairs.select(F.col("src").alias("v")).unionByName(pairs.select(F.col("dst").alias("v"))).distinct(), "near-asked")
    # only sets that a pair names are shuffled; the ids are broadcast while they are few
    sets = sets.select("v", "shingles").join(F.broadcast(asked) if asked.count() <= BROADCAST_IDS else asked, "v", "left_semi")
    x, y = (sets.select(F.col("v").alias(end), F.col("shingles").alias(name)) for end, name in (("src", "x"), ("dst", "y")))

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "x"):
            keep = []
            for a, b in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                common = len(np.intersect1d(np.frombuffer(a, dtype="<u4"), np.frombuffer(b, dtype="<u4"), assume_unique=True))
                keep.append(common >= similarity * ((len(a) + len(b)) // 4 - common))
            yield batch.select(["src", "dst"]).filter(pa.array(keep))

    return materialise(pairs.join(x, "src").join(y, "dst").select("src", "dst", "x", "y").mapInArrow(similar, "src long, dst long"), "near-links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, max_bits: int = 4, blocks: int = 3) -> DataFrame:
    """(doc_id, digest, n_rows, component_id, component_digest), a row for each
    different shingle set: classes of documents whose sets (32 bits of each
    shingle's hash) have a Jaccard similarity of ``similarity`` or more.

    A set and a class are named by their smallest id, and among rows of that id by
    the smallest MD5 of a text.

    Three steps propose pairs, and each pair is decided on the sets before the
    next step runs: the vantage-point trees, which link fingerprints within
    ``max_bits`` as everywhere in this module; in two rounds two hubs of each
    prefix shingle with all other sets that have it; at last all pairs of
    different classes that share enough of their prefixes and whose sketches
    allow the similarity.  The last step alone would find every pair; the steps
    before it make it small, as what they have joined isn't compared again.
    """
    spark = docs.sparkSession
    words = [f"s{k}" for k in range(SKETCH)]
    with tidy(spark):
        prints = fingerprints(docs, id_col, text_col, width, with_set=True)
        least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("least")
        distinct = materialise(
            prints.groupBy("fp", "shingles").agg(least, F.count("*").alias("n_rows"), *[F.first(w).alias(w) for w in words]).withColumn("v", F.monotonically_increasing_id()), "near-distinct"
        )
        by_print = materialise(distinct.groupBy("fp").agg(F.min("v").alias("v")), "near-by-print")
        ends = links(by_print, max_bits, blocks).join(by_print.select(F.col("fp").alias("src"), F.col("v").alias("a")), "src").join(by_print.select(F.col("fp").alias("dst"), F.col("v").alias("b")), "dst")
        same = distinct.select("fp", F.col("v").alias("a")).join(by_print.select("fp", F.col("v").alias("b")), "fp").where("a <> b")
        close = ends.select("a", "b").unionByName(same.select("a", "b")).select(F.col("a").alias("src"), F.col("b").alias("dst"))
        found = decide(close, distinct, similarity)
        prefixes = _prefixes(distinct, distinct.count(), similarity)
        size = F.octet_length("shingles").cast("int").alias("size")
        for propose in (hub_pairs, partial(hub_pairs, each=True), prefix_pairs):
            points = distinct.select("v", (size / 4).cast("int").alias("size"), *words).join(connected_components(found), "v", "left").withColumn("component", F.coalesce("component", "v"))
            found = found.unionByName(decide(propose(prefixes, materialise(points, "near-points"), similarity), distinct, similarity))
        named = distinct.select("v", "least", "n_rows").join(connected_components(found), "v", "left").withColumn("component", F.coalesce("component", "v"))
        first = named.groupBy("component").agg(F.min("least").alias("first"))
        out = named.join(first, "component").select("least.doc_id", "least.digest", "n_rows", F.col("first.doc_id").alias("component_id"), F.col("first.digest").alias("component_digest"))
        return materialise(out, "near-duplicates", keep=True)
