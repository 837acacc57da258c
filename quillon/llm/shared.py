"""Helpers shared by the training-data operators.

Nothing outside ``quillon.llm`` imports this module.  Everything that has to
outlive one job (cut lineage, binary archives, token files) goes to the folder
that the session names in ``spark.checkpoint.dir``; executors and driver see the
same files there.
"""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of an Arrow batch, unless the session asks for another number.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Whole texts are long, so Spark's default of 10,000 rows is too many for a batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; only Spark opens input paths."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is missing in a local session (tests, a notebook) a folder of
    this machine is made once and set as the context's checkpoint directory; on a
    cluster that is an error, as executors don't see such a folder.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-"))
        base = context.getCheckpointDir()
    return base if "://" in base or base.startswith("file:") else f"file://{base}"


#: Paths written inside each open ``tidy`` block of this thread.
_written: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("written", default=())


def scratch(spark: SparkSession, name: str, temporary: bool = False) -> str:
    """A fresh path in the shared folder; a temporary one goes with the ``tidy`` block."""
    path = f"{shared_dir(spark).rstrip('/')}/quillon/{name}-{uuid.uuid4().hex}"
    if temporary and _written.get():
        _written.get()[-1].append(path)
    return path


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what ``materialise`` has written inside, but for what it was told to keep."""
    paths: list[str] = []
    before = _written.set((*_written.get(), paths))
    try:
        yield
    finally:
        _written.reset(before)
        remove(spark, paths)


def remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialise(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there,
    and a lost executor costs a re-read, not a recomputation.

    Inside ``tidy`` the table goes when the block ends; with ``keep`` it is left
    to the block around that one, or to the caller.
    """
    small_batches(df.sparkSession)
    path = scratch(df.sparkSession, name)
    blocks = _written.get()
    owner = len(blocks) - 1 - keep
    if owner >= 0:
        blocks[owner].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id has none (null)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % F.lit(modulus)


# --------------------------------------------------------------------- Arrow


#: What Python workers keep between tasks: how to let go of it, by owner.
CACHES: dict[str, Callable[[], None]] = {}


def claim(owner: str = "") -> None:
    """Let go of what other operators have kept in this Python worker."""
    others = [CACHES.pop(k) for k in list(CACHES) if k != owner]
    for clear in others:
        clear()
    if others:
        gc.collect()
        give_back()


# Arrow's own allocators keep what they have freed; workers wait between tasks
# beside a JVM, so buffers come from the system and go back to it.
pa.set_memory_pool(pa.system_memory_pool())


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20, owner: str = "") -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``limit`` bytes in each.

    A longer single text stays whole in a slice of its own.
    """
    claim(owner)
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(at, at[start] + limit, side="right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def plain(text: pa.Array) -> pa.Array:
    """Large strings without nulls that begin at the start of their buffers.

    Some kernels of pyarrow misread the offsets of slices, so the bytes are copied.
    """
    text = pc.fill_null(text.cast(pa.large_string()), "")
    return pa.concat_arrays([text, pa.array([""], pa.large_string())]).slice(0, len(text))


def split_words(text: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
    """Words of every text (null: none): offsets of n + 1 values and the flat words.

    Arrow's ASCII kernels split at blank and \\t..\\r and fold A-Z alone, as wanted.
    """
    text = plain(text)
    lists = pc.ascii_split_whitespace(pc.ascii_lower(text) if lower else text)
    flat = lists.flatten()
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0)
    if len(flat) and not pc.all(full).as_py():
        kept = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)))
        flat, offsets = flat.filter(full), kept[offsets]
    return offsets, flat


def encode_dictionary(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes (int64) of the values and the distinct values."""
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def sums_between(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i + 1]] for each i (0 for empty ranges)."""
    total = np.concatenate((np.zeros(1, dtype=values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)))
    return total[offsets[1:]] - total[offsets[:-1]]


def bytes_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and raw UTF-8 bytes of a string array."""
    array = plain(array)
    _, offsets, data = array.buffers()
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, dtype=np.int64)[array.offset : array.offset + len(array) + 1] if offsets is not None else np.zeros(1, np.int64)
    return at, raw


# ------------------------------------------------------------ components


def local_components(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Merge the classes in ``label`` along the links i-j; labels are smallest members."""
    while len(i):
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            break
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label[:] = jumped
    return label


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Component of every vertex that has an edge.

    ``edges(src long, dst long)`` -> ``(v long, component long)``, the component
    being the smallest vertex id reachable.  Vertices go by a one-to-one hash of
    their ids, so that long chains in the order of ids are short slopes here.
    Each round maps every vertex to the smallest of its closed neighbourhood and
    jumps the pointers twice, rewrites the edges to those images and drops loops
    and repeats.  A vertex that has a smaller neighbour is no image when its jumps
    have ended, so the graph shrinks geometrically; the per-round maps are then
    composed backwards.  Minima are combined before the shuffle.  Hubs are hot
    keys of joins; each such join stands alone between written tables or
    shuffles, so that adaptive execution can split it.
    """
    spark = edges.sparkSession
    with tidy(spark):
        ends = materialise(edges.where("src <> dst").select("src", "dst").distinct(), "edges")
        if ends.isEmpty():
            return spark.createDataFrame([], "v long, component long")
        a, b = F.xxhash64("src"), F.xxhash64("dst")
        links = ends.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"))
        maps: list[DataFrame] = []
        for _ in range(rounds):
            both = links.select(F.col("src").alias("v"), F.col("src").alias("to")).unionByName(links.select(F.col("dst").alias("v"), F.col("src").alias("to")))
            near = materialise(both.groupBy("v").agg(F.min("to").alias("to")), "parents")
            for _ in range(2):
                hop = near.select(F.col("v").alias("to"), F.col("to").alias("next"))
                near = materialise(near.join(hop, "to", "left").select("v", F.coalesce("next", "to").alias("to")), "parents")
            maps.append(near)
            left = near.select(F.col("v").alias("src"), F.col("to").alias("a"))
            right = near.select(F.col("v").alias("dst"), F.col("to").alias("b"))
            links = materialise(
                links.join(left, "src").join(right, "dst").where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(),
                "edges",
            )
            if links.isEmpty():
                break
        else:
            raise RuntimeError("components did not settle")
        out = maps[-1]
        for near in reversed(maps[:-1]):
            out = materialise(near.join(out.select(F.col("v").alias("to"), F.col("to").alias("root")), "to", "left").select("v", F.coalesce("root", "to").alias("to")), "parents")
        names = ends.select(F.col("src").alias("id")).unionByName(ends.select(F.col("dst").alias("id"))).distinct().withColumn("v", F.xxhash64("id"))
        named = materialise(names.join(out, "v").select("id", "to"), "rooted")
        least = materialise(named.groupBy("to").agg(F.min("id").alias("component")), "roots")
        return materialise(named.join(least, "to").select(F.col("id").alias("v"), "component"), "components", keep=True)
