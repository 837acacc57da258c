"""Embedding near-duplicates with randomised-rotation binary codes.

Every unit vector o is rotated by a random orthogonal matrix and coded by the
signs of its coordinates; the code is itself a unit vector o', and the stored
correction factor is f = <o', o>.  For a unit vector q, <o', q> / f estimates
<o, q> without bias.  Its error is bounded by the angle between o' and o: a pair
with cosine of at least t has <o', q> >= cos(acos f + acos t), always.  With
``epsilon`` a confidence bound replaces that certain one (the error then is at
most epsilon standard deviations).  Pairs above the bound are compared by the
rotated vectors in 16-bit steps, whose stored error bounds that cosine from both
sides, and those pairs whose bounds hold the threshold between them, and only those,
are recomputed in double precision from the vectors; so by default no link is lost.

The distinct vectors are dealt into G groups, each written once to the shared
folder; the task of cell (a, b), a <= b, reads two of them and compares them in
blocks.  Every pair meets in one task, and no vector is shuffled for it, however
many groups there are.  A task returns link counts, a spanning forest and the few
undecided pairs, never the others.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors of different length are not compared;
equal vectors are one point with a weight, so a third of all rows may be equal;
repeated ids are separate rows; a null id takes part in counts, its own
component_id is the smallest id of its component, if any; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, local_components, materialise, scratch, tidy

BLOCK = 2048
#: Rows of a group, at least and at most; between them the number of groups stays at 128.
GROUP_ROWS, GROUP_MOST = 8192, 65_536


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors (double), signs as packed bits, and correction factors."""
    unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    turned = unit @ rotation(unit.shape[1], seed)
    factor = np.abs(turned).sum(axis=1) / math.sqrt(unit.shape[1])
    return unit, np.packbits(turned >= 0, axis=1), factor


def lower_cut(factor: np.ndarray, threshold: float, dim: int, epsilon: float | None) -> np.ndarray:
    """Least <o', q> of a pair whose cosine reaches the threshold."""
    error = 1.0 if epsilon is None else min(1.0, epsilon / math.sqrt(max(1, dim - 1)))
    return factor * threshold - np.sqrt(np.maximum(0, 1 - factor**2)) * math.sqrt(max(0.0, 1 - threshold**2)) * error


def codes(points: DataFrame, seed: int) -> DataFrame:
    """(v, weight, dim, code, turned, scale, error, factor) of (v, weight, vec).

    ``turned`` is the rotated unit vector in 16-bit steps of ``scale``; ``error`` bounds
    how far that is from it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column("vec")
            size = np.diff(np.asarray(vec.offsets))
            flat = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            at = np.concatenate(([0], np.cumsum(size)))
            code, steps, numbers = np.empty(len(size), object), np.empty(len(size), object), np.empty((3, len(size)))
            for dim in np.unique(size):
                rows = np.nonzero(size == dim)[0]
                unit, bits, factor = encode(flat[at[rows][:, None] + np.arange(dim)], seed)
                turned = unit @ rotation(dim, seed)
                scale = np.abs(turned).max(axis=1) / 32767
                whole = np.rint(turned / scale[:, None]).astype("<i2")
                numbers[:, rows] = scale, np.linalg.norm(turned - whole * scale[:, None], axis=1) + 1e-12, factor
                for row, b, w in zip(rows, bits, whole, strict=True):
                    code[row], steps[row] = b.tobytes(), w.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("v"), batch.column("weight"), pa.array(size.astype(np.int32)), pa.array(code.tolist(), pa.binary()), pa.array(steps.tolist(), pa.binary()), *map(pa.array, numbers)],
                ["v", "weight", "dim", "code", "turned", "scale", "error", "factor"],
            )

    return points.select("v", "weight", "vec").mapInArrow(run, "v long, weight long, dim int, code binary, turned binary, scale double, error double, factor double")


class Block:
    """One group of coded vectors, read from the shared folder."""

    def __init__(self, uri: str, dim: int) -> None:
        import pyarrow.fs as fs
        import pyarrow.parquet as pq

        system, path = fs.FileSystem.from_uri(uri)
        table = pq.ParquetDataset(path, filesystem=system, partitioning=None).read(use_threads=False)
        self.v, self.weight, self.scale, self.error, self.factor = (table[c].to_numpy() for c in ("v", "weight", "scale", "error", "factor"))
        self.bits = np.frombuffer(b"".join(table["code"].to_pylist()), np.uint8).reshape(len(self.v), -1)
        self.turned = np.frombuffer(b"".join(table["turned"].to_pylist()), "<i2").reshape(len(self.v), dim)
        self.dim = dim

    def vectors(self, rows: slice | np.ndarray, kind: type = np.float64) -> np.ndarray:
        return self.turned[rows].astype(kind) * self.scale[rows].astype(kind)[:, None]

    def signs(self, rows: slice) -> np.ndarray:
        return (np.unpackbits(self.bits[rows], axis=1, count=self.dim).astype(np.float32) * 2 - 1) / math.sqrt(self.dim)


def compare(x: Block, y: Block, same: bool, threshold: float, epsilon: float | None) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Weights of the linked others and component labels over the rows of x, then y,
    and the pairs that only exact recomputation can decide."""
    n, label_at = len(x.v), 0 if same else len(x.v)
    count, label, unsure = np.zeros(n if same else n + len(y.v), np.int64), np.arange(n if same else n + len(y.v)), []
    weight = x.weight if same else np.concatenate((x.weight, y.weight))
    # what the steps of y's vectors leave out moves an estimate by their error at most
    cut = (lower_cut(x.factor, threshold, x.dim, epsilon) - 1e-5).astype(np.float32)
    for a in range(0, n, BLOCK):
        rows = slice(a, a + BLOCK)
        signs = x.signs(rows)
        for b in range(a if same else 0, len(y.v), BLOCK):
            cols = slice(b, b + BLOCK)
            i, j = np.nonzero(signs @ y.vectors(cols, np.float32).T >= cut[rows][:, None] - y.error[cols].astype(np.float32))
            if same and a == b:
                i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            i, j = i + a, j + b
            cosine = _cosines(x, y, i, j)
            slack = x.error[i] + y.error[j] + x.error[i] * y.error[j] + 1e-9
            sure, open_ = cosine - slack >= threshold, np.abs(cosine - threshold) <= slack
            unsure.append((x.v[i[open_]], y.v[j[open_]]))
            p, q = i[sure], j[sure] + label_at
            np.add.at(count, p, weight[q])
            np.add.at(count, q, weight[p])
            local_components(label, p, q)
    return count, label, unsure


def _cosines(x: Block, y: Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of the stepped vectors: dense where most rows and columns occur, else pair by pair."""
    ri, cj = np.unique(i), np.unique(j)
    if len(ri) * len(cj) <= 8 * len(i):
        return (x.vectors(ri) @ y.vectors(cj).T)[np.searchsorted(ri, i), np.searchsorted(cj, j)]
    return np.concatenate([np.einsum("ij,ij->i", x.vectors(i[k : k + 65536]), y.vectors(j[k : k + 65536])) for k in range(0, len(i), 65536)])


def cosine_links(points: DataFrame, threshold: float = 0.9, seed: int = 42, epsilon: float | None = None) -> DataFrame:
    """(v, links, root): weight of the linked other points per cell, and a forest edge."""
    spark = points.sparkSession
    n = points.count()
    groups = max(-(-n // GROUP_ROWS), min(8, -(-n // 1024)), 1)
    groups = groups if groups <= 128 else max(128, -(-n // GROUP_MOST))
    path = scratch(spark, "rabitq-codes", temporary=True)
    # each group is a folder of its own, written once; cells read two of them
    coded = codes(points, seed).withColumn("own", F.pmod(F.xxhash64("v"), F.lit(groups)).cast("int"))
    coded.repartition(groups, "own").write.partitionBy("dim", "own").parquet(path)
    held = spark.read.schema("dim int, own int").parquet(path).groupBy("dim").agg(F.collect_set("own").alias("own"))  # group numbers: n / GROUP_MOST of them
    cells = held.select("dim", F.explode("own").alias("a"), "own").select("dim", "a", F.explode("own").alias("b")).where("a <= b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, a, b in zip(*(batch.column(c).to_pylist() for c in ("dim", "a", "b")), strict=True):
                x = Block(f"{path}/dim={dim}/own={a}", dim)
                y = x if a == b else Block(f"{path}/dim={dim}/own={b}", dim)
                count, label, unsure = compare(x, y, a == b, threshold, epsilon)
                v = x.v if a == b else np.concatenate((x.v, y.v))
                out = np.nonzero(count)[0]
                for of, to, links, pair in [(v[out], v[label[out]], count[out], False), *((p, q, np.zeros(len(p), np.int64), True) for p, q in unsure)]:
                    yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(to), pa.array(links), pa.array(np.full(len(of), pair))], ["v", "root", "links", "pair"])

    most = spark.sparkContext.defaultParallelism * 4
    found = materialise(cells.repartition(max(1, min(groups * (groups + 1) // 2, max(most, groups)))).mapInArrow(run, "v long, root long, links long, pair boolean"), "rabitq-cells")
    ends = [points.select(F.col("v").alias(v), F.col("weight").alias(f"{v}_weight"), F.col("vec").alias(f"{v}_vec")) for v in ("v", "root")]
    pairs = found.where("pair").select("v", "root").join(ends[0], "v").join(ends[1], "root")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    near = pairs.where(dot("v_vec", "root_vec") >= F.lit(threshold) * F.sqrt(dot("v_vec", "v_vec")) * F.sqrt(dot("root_vec", "root_vec")))
    exact = near.select("v", F.col("root_weight").alias("links"), "root").unionByName(near.select(F.col("root").alias("v"), F.col("v_weight").alias("links"), F.col("v").alias("root")))
    return found.where("not pair").select("v", "links", "root").unionByName(exact)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, seed: int = 42, epsilon: float | None = None) -> DataFrame:
    """One row per input row: (vec_id, n_links, component_id, kept)."""
    vec = F.col(vec_col).cast("array<double>")
    finite = F.forall(vec, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    usable = F.coalesce((F.size(vec) > 0) & finite & F.exists(vec, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(usable, vec).alias("vec"))
    rows = rows.withColumn("digest", F.xxhash64("vec"))
    with tidy(vectors.sparkSession):
        points = materialise(
            rows.where("vec is not null")
            .groupBy("digest", "vec")
            .agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"))
            .withColumn("v", F.monotonically_increasing_id()),
            "rabitq-points",
        )
        found = materialise(cosine_links(points, threshold, seed, epsilon), "rabitq-links")
        component = connected_components(found.select(F.col("v").alias("src"), F.col("root").alias("dst")))
        counts = found.groupBy("v").agg(F.sum("links").alias("links"))
        named = points.select("digest", "vec", "weight", "least", "v").join(counts, "v", "left").join(component, "v", "left").withColumn("component", F.coalesce("component", "v"))
        least = named.groupBy("component").agg(F.min("least").alias("component_id"))
        # only points with links or repeats tell a row something new
        told = named.where("links is not null or weight > 1").join(least, "component")
        told = told.select("digest", "vec", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"), "component_id")
        joined = rows.join(told, ["digest", "vec"], "left").select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
            F.coalesce("component_id", "vec_id").eqNullSafe(F.col("vec_id")).alias("kept"),
        )
        return materialise(joined, "rabitq-rows", keep=True)


#: DuckDB, over the view ``embeddings``; every pair, so for small tables.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CASE WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
                      THEN list_transform(embedding, lambda x: x::DOUBLE) END AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE e IS NOT NULL),
p AS (SELECT a.vec_id AS i, b.vec_id AS j FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) >= 0.9::DOUBLE * a.n * b.n),
r AS (SELECT vec_id AS i, vec_id AS j FROM embeddings UNION SELECT r.i, p.j FROM r JOIN p ON r.j = p.i),
c AS (SELECT i, min(j) AS component_id FROM r GROUP BY i),
d AS (SELECT i, count(*) AS n FROM p GROUP BY i)
SELECT vec_id, coalesce(d.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings e JOIN c ON c.i = vec_id LEFT JOIN d ON d.i = vec_id
"""
