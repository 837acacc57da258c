"""Exact centroid clustering of whole-number vectors with grouped bounds.

Components become integers floor(scale * x), so every distance, sum and mean is
exact and the result doesn't depend on how rows are dealt to tasks.  Centroids
are put into groups once, when they start.  A vector carries its cluster, an
upper bound of its distance to that centroid and one lower bound for each group
(the nearest other centroid in it).  After an update the bounds move by the drift
of the centroids: a vector whose upper bound is below all its lower bounds stays
without any distance (global filter); else its own distance is computed and only
the groups whose lower bound isn't above it are scanned, exactly (group filter).

A round is one pass in Arrow batches over the state of the last one.  At its end
a task adds one row for each cluster that won or lost vectors, with the change of
its component sums; those rows, not vectors, are added up by Spark.  Nothing is
shuffled per vector, so a hot vector or label costs nothing; k * dims numbers
(checked against ``LARGEST``) travel with the code.  Each state is a table in the
shared folder, so a lost executor repeats one pass over a part.

Edge cases: vectors that are null, of another length, or hold null or non-finite
components are left out; a null ``vec_id`` is clustered but never starts a
cluster; repeated rows are rows; equal hashes are taken in order of their
components; fewer vectors than k give fewer centroids; an empty table gives an
empty result; components too large for 64-bit squares are computed in unbounded
integers, and a distance or inertia beyond a long is given as the largest long;
sums have 38 digits.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import claim, materialise, remove, scratch, small_batches, tidy

#: Largest k * dims, which the driver and every task hold.
LARGEST = 1 << 20
#: Relative slack of the bounds, far above the rounding of doubles.
SLACK = 1e-9
MOST = (1 << 63) - 1
#: Bytes of a component beyond 64 bits: any finite double times a scale up to 2 ** 40.
WIDE = 136
STATE = "vec_id long, v binary, cluster int, upper double, lower array<double>, distance long, n long, sums array<string>"


# ------------------------------------------------------- whole-number vectors


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): int64 where products of the result fit, else Python integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values.astype(np.float64) * scale)
    if not scaled.size or np.abs(scaled).max() < 1 << 27:
        return scaled.astype(np.int64)
    flat = [int(np.floor(x * scale)) if abs(x) < 1 << 53 else int(x) * scale for x in values.astype(np.float64).ravel().tolist()]
    return np.array(flat, dtype=object).reshape(values.shape)


def pack(x: np.ndarray) -> list[bytes]:
    """Bytes of each row in the narrowest form that holds all of them."""
    if x.dtype == object:
        return [b"".join(int(c).to_bytes(WIDE, "little", signed=True) for c in row) for row in x]
    top = int(np.abs(x).max()) if x.size else 0
    return [row.tobytes() for row in x.astype(next(t for t, most in ((np.int8, 127), (np.int16, 32767), (np.int64, MOST)) if top <= most))]


def unpack(rows: list[bytes], dims: int) -> np.ndarray:
    width = len(rows[0]) // dims
    if width == WIDE:
        return np.array([[int.from_bytes(r[at : at + WIDE], "little", signed=True) for at in range(0, len(r), WIDE)] for r in rows], dtype=object)
    return np.frombuffer(b"".join(rows), dtype={1: np.int8, 2: np.int16, 8: np.int64}[width]).reshape(-1, dims).astype(np.int64)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exact: in doubles where all partial sums are below 2 ** 53."""
    if a.dtype == object or b.dtype == object:
        return a.astype(object) @ b.astype(object).T
    top = (int(np.abs(a).max()) if a.size else 0) * (int(np.abs(b).max()) if b.size else 0) * max(1, a.shape[1])
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if top < 1 << 52 else a @ b.T


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all rows of c."""
    return (x * x).sum(axis=1)[:, None] - 2 * product(x, c) + (c * c).sum(axis=1)[None, :]


def root(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64))


# -------------------------------------------------------------------- rounds


def group_centroids(centroids: np.ndarray, groups: int, steps: int = 5) -> np.ndarray:
    """Group of each centroid, by a few steps of clustering the centroids themselves."""
    x = centroids.astype(np.float64)
    centre = x[np.linspace(0, len(x) - 1, min(groups, len(x))).astype(int)]
    for _ in range(steps):
        own = ((x[:, None, :] - centre[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
        centre = np.array([x[own == g].mean(axis=0) if (own == g).any() else centre[g] for g in range(len(centre))])
    return np.unique(own, return_inverse=True)[1]


class Bounds:
    """One pass over vectors: exact nearest centroids, with as few distances as the bounds allow."""

    def __init__(self, centroids: np.ndarray, group: np.ndarray, moved: np.ndarray | None) -> None:
        self.c, self.group = centroids, group
        self.members = [np.flatnonzero(group == g) for g in range(int(group.max()) + 1)]
        self.moved = moved
        self.most = None if moved is None else np.array([moved[m].max() for m in self.members])
        self.scanned = 0

    def scan(self, x: np.ndarray, g: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centroid of group g, its squared distance, and that of the group's second."""
        self.scanned += len(x) * len(self.members[g])
        d2 = squared(x, self.c[self.members[g]])
        at = d2.argmin(axis=1)
        first = d2[np.arange(len(x)), at]
        if d2.shape[1] == 1:
            return self.members[g][at], first, np.full(len(x), np.inf)
        d2[np.arange(len(x)), at] = d2.max() + 1
        return self.members[g][at], first, root(d2.min(axis=1))

    def pick(self, x: np.ndarray, own: np.ndarray, d2: np.ndarray, lower: np.ndarray, open_: np.ndarray) -> None:
        """Scan the groups that are open for a row; own, d2 and lower are updated in place."""
        found = []
        for g in range(len(self.members)):
            rows = np.flatnonzero(open_[:, g])
            if len(rows):
                found.append((g, rows, *self.scan(x[rows], g)))
        start = own.copy()
        for _, rows, at, near, _ in found:
            better = (near < d2[rows]) | ((near == d2[rows]) & (at < own[rows]))
            own[rows[better]], d2[rows[better]] = at[better], near[better]
        for g, rows, at, near, second in found:
            lower[rows, g] = np.where(own[rows] == at, second, root(near))
        # a group that wasn't scanned and has lost its vector holds the old centroid again
        left = np.flatnonzero((own != start) & (start >= 0))
        g = self.group[start[left]]
        closed = ~open_[left, g]
        left, g = left[closed], g[closed]
        lower[left, g] = np.minimum(lower[left, g], self.old[left])

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own, lower = np.full(len(x), -1), np.full((len(x), len(self.members)), np.inf)
        d2 = np.full(len(x), 1 << 2100, dtype=object) if x.dtype == object or self.c.dtype == object else np.full(len(x), MOST)
        self.old = np.full(len(x), np.inf)
        self.pick(x, own, d2, lower, np.ones(lower.shape, bool))
        return own, root(d2), lower

    def again(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own, upper, lower = own.copy(), upper + self.moved[own], np.maximum(lower - self.most[None, :], 0)
        least = lower.min(axis=1)
        rows = np.flatnonzero(~(upper * (1 + SLACK) < least * (1 - SLACK)))  # global filter
        if len(rows):
            d2 = distances(x[rows], self.c, own[rows])
            self.scanned += len(rows)
            self.old = upper[rows] = root(d2)
            some, part = own[rows], lower[rows]
            self.pick(x[rows], some, d2, part, ~(upper[rows, None] * (1 + SLACK) < part * (1 - SLACK)))  # group filter
            own[rows], upper[rows], lower[rows] = some, root(d2), part
        return own, upper, lower


def distances(x: np.ndarray, c: np.ndarray, own: np.ndarray) -> np.ndarray:
    gap = x - c[own]
    return (gap * gap).sum(axis=1)


def by_width(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    width = np.array([len(v) for v in batch.column("v").to_pylist()])
    for w in np.unique(width):
        yield batch.filter(pa.array(width == w)) if (width != w).any() else batch


def one_pass(centroids: np.ndarray, group: np.ndarray, moved: np.ndarray | None, scale: int, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A round as a function of Arrow batches: the first reads embeddings, later ones the state."""
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.binary()), ("cluster", pa.int32()), ("upper", pa.float64()), ("lower", pa.list_(pa.float64())), ("distance", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.string()))])
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        bounds, n = Bounds(centroids, group, moved), np.zeros(k, np.int64)
        sums = np.zeros((k, dims), dtype=object)
        for whole_batch in batches:
            if not whole_batch.num_rows:
                continue
            for batch in [whole_batch] if moved is None else by_width(whole_batch):
                if moved is None:
                    flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
                    x = whole(flat.reshape(-1, dims), scale)
                    was, (own, upper, lower) = None, bounds.first(x)
                else:
                    x = unpack(batch.column("v").to_pylist(), dims)
                    was = batch.column("cluster").to_numpy().astype(np.int64)
                    flat = batch.column("lower").flatten().to_numpy().reshape(batch.num_rows, -1)
                    own, upper, lower = bounds.again(x, was, batch.column("upper").to_numpy().copy(), flat)
                changed = np.arange(len(x)) if was is None else np.flatnonzero(own != was)
                for at, sign in ((own, 1), (was, -1)):
                    if at is not None and len(changed):
                        hot = np.zeros((k, len(changed)), np.int64)
                        hot[at[changed], np.arange(len(changed))] = 1
                        n += sign * hot.sum(axis=1)
                        sums += sign * product(hot, x[changed].T).astype(object)
                rows = len(x)
                away = pa.array([min(int(d), MOST) for d in distances(x, centroids, own)], pa.int64()) if last else pa.nulls(rows, pa.int64())
                kept = pa.nulls(rows, pa.binary()) if last else pa.array(pack(x), pa.binary())
                lists = pa.ListArray.from_arrays(np.arange(rows + 1, dtype=np.int32) * lower.shape[1], pa.array(lower.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), kept, pa.array(own, pa.int32()), pa.array(upper), lists, away, pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.list_(pa.string()))], schema=schema)
        if not last:
            some = [c for c in range(k) if n[c] or any(sums[c])]
            yield pa.RecordBatch.from_pylist([{"cluster": c, "n": int(n[c]), "sums": [str(s) for s in sums[c]]} for c in some], schema=schema)

    return run


def starts(vectors: DataFrame, k: int, seed: str, scale: int) -> np.ndarray:
    """The k vectors with the smallest hashes of seed and id."""
    named = vectors.where("vec_id is not null").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    rows = named.orderBy("h", "embedding").limit(k).collect()
    return whole(np.array([r["embedding"] for r in rows], dtype=np.float64), scale) if rows else np.zeros((0, 0), np.int64)


def cluster(embeddings: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, groups: int = 4, scale: int = 64, seed: str = "1") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector with ``dims`` finite components.

    ``rounds`` times all vectors go to their nearest centroid (squared Euclidean
    distance, ties to the smaller number) and every centroid that has vectors
    becomes the floor of their mean; then they are assigned once more.
    """
    if k * dims > LARGEST:
        raise ValueError(f"{k} centroids of {dims} components are over {LARGEST} numbers")
    spark = embeddings.sparkSession
    small_batches(spark)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    vectors = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where((F.size("embedding") == dims) & finite)
    centroids = starts(vectors, k, seed, scale)
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], out)
    group = group_centroids(centroids, groups)
    sums, n = np.zeros((len(centroids), dims), dtype=object), np.zeros(len(centroids), dtype=object)
    state, moved, old = vectors, None, []
    with tidy(spark):
        for step in range(rounds + 1):
            last = step == rounds
            path = scratch(spark, "vectors", temporary=True)
            state.mapInArrow(one_pass(centroids, group, moved, scale, last), STATE).write.parquet(path)
            remove(spark, old)
            table, old = spark.read.schema(STATE).parquet(path), [path]
            if last:
                break
            changes = table.where("sums is not null").select("cluster", "n", F.posexplode("sums").alias("pos", "s"))
            for r in changes.groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
                sums[r["cluster"], r["pos"]] += int(r["s"])
                n[r["cluster"]] += r["n"] if r["pos"] == 0 else 0
            new = np.array([[s // n[c] for s in sums[c]] if n[c] else list(centroids[c]) for c in range(len(centroids))], dtype=object)
            moved = root(((new - centroids.astype(object)) ** 2).sum(axis=1)) * (1 + SLACK)
            centroids = new.astype(np.int64) if max(abs(v) for v in new.ravel()) < 1 << 27 else new
            state = table.where("v is not null").select("vec_id", "v", "cluster", "upper", "lower")
        rows = table.select("vec_id", "cluster", "distance")
        cost = {r["cluster"]: int(r["d"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
        named = [(c, min(d, MOST), min(sum(cost.values()), MOST), hashlib.sha256(",".join(str(int(v)) for v in centroids[c]).encode()).hexdigest()) for c, d in sorted(cost.items())]
        names = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # at most k rows
        return materialise(rows.join(F.broadcast(names), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), "clusters", keep=True)


def _sql(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: str = "1") -> str:
    parts = [
        f"""kept as materialized (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) as v
  from embeddings
  where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dims})""",
        f"""c0 as materialized (
  select cast(row_number() over (order by h, v) - 1 as integer) as c, v
  from (select sha256('{seed}:' || vec_id) as h, v from kept where vec_id is not null order by h, v limit {k}))""",
    ]
    for n in range(rounds + 1):
        parts.append(f"""a{n} as materialized (
  select r, min(vec_id) as vec_id, min(struct_pack(d := d, c := c)) as best
  from (select kept.r, kept.vec_id, c{n}.c, cast(list_sum(list_transform(list_zip(kept.v, c{n}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as bigint) as d from kept, c{n})
  group by r)""")
        if n < rounds:
            parts.append(f"""m{n} as materialized (
  select c, list(cast(s // n - case when s % n < 0 then 1 else 0 end as bigint) order by pos) as v
  from (select best.c as c, pos, sum(v[pos]) as s, count(*) as n from a{n} join kept using (r), range(1, {dims + 1}) t(pos) group by best.c, pos)
  group by c)""")
            parts.append(f"""c{n + 1} as materialized (select c{n}.c as c, coalesce(m{n}.v, c{n}.v) as v from c{n} left join m{n} on m{n}.c = c{n}.c)""")
    return (
        "with "
        + ",\n".join(parts)
        + f"""
select vec_id, best.c as cluster, best.d as distance,
  cast(sum(best.d) over (partition by best.c) as bigint) as cluster_inertia, cast(sum(best.d) over () as bigint) as inertia,
  sha256(array_to_string(c{rounds}.v, ',')) as centroid_sha256
from a{rounds} join c{rounds} on c{rounds}.c = best.c"""
    )


SQL = _sql()
