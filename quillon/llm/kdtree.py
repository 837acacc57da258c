"""Sharding by a k-d tree over document metadata, with DataFrame operations only.

Every node is split at the weighted median (weights: bytes) of the metadata
dimension that is widest inside the node, until a leaf holds the target bytes.
The median is exact and distributed: a histogram pass finds the bucket in which
the weight crosses the target, the next pass looks into that bucket alone, and
so on through the ordering (dimension, CRC-32 of the text, id, row number) until
the bucket holds one row.  All nodes of a level share each pass; the driver only
sees ``nodes x BUCKETS`` sums, whatever the input.

Edge cases: a null text has size 1 and CRC 0; a null id orders before all
others; null metadata is the value -1; equal texts (size, CRC-32 and XXH64) take the
smallest metadata of their group, so they are one point and stay in one shard, but
for a group of more than ``WHOLE`` of a leaf's bytes that lies on a boundary, which is
divided so that sizes stay near equal; identical rows are told apart by the row number of
the written metadata table; an empty table gives an empty result.  Extra columns are
ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, tidy

#: Buckets of one histogram pass and node.
BUCKETS = 1024
#: Nodes that are looked up in a literal instead of a table.
LITERAL_NODES = 64
#: Share of a leaf's bytes up to which a group of equal texts isn't divided.
WHOLE = 0.01
#: Rows of a shard that are numbered in one task.
SLOT_ROWS = 4096


def metadata(docs: DataFrame, id_col: str, text_col: str, dims: list[str]) -> DataFrame:
    """Compact rows (doc_id, size, text_crc32, d0..) with a stable row number;
    equal texts have the same metadata."""
    kinds = dict(docs.dtypes)

    def code(name: str) -> Column:
        c = F.col(name)
        if kinds[name] in ("bigint", "int", "smallint", "tinyint"):
            return F.coalesce(c.cast("long"), F.lit(-1))
        return F.coalesce(F.crc32(c.cast("string").cast("binary")), F.lit(-1))

    text = F.col(text_col).cast("binary")
    own = materialise(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
            F.xxhash64(text).alias("hash"),
            *[code(d).alias(f"d{k}") for k, d in enumerate(dims)],
            F.monotonically_increasing_id().alias("rid"),
        ),
        "kd-own",
    )
    group, dim = ["size", "text_crc32", "hash"], [f"d{k}" for k in range(len(dims))]
    # only groups whose metadata differ have to tell their rows; sums are partial before the shuffle
    told = own.groupBy(*group).agg(*[F.min(d).alias(f"g{d}") for d in dim], *[F.max(d).alias(f"h{d}") for d in dim])
    told = told.where(" or ".join(["false", *[f"g{d} < h{d}" for d in dim]])).drop(*[f"h{d}" for d in dim])
    joined = own.join(told, group, "left").select("doc_id", "size", "text_crc32", *[F.coalesce(f"g{d}", d).alias(d) for d in dim], "rid")
    return materialise(joined, "kd-meta")


def _told(rows: DataFrame, nodes: list[dict], schema: str) -> DataFrame:
    """Rows of the listed nodes with what the driver knows of their node.

    There are at most as many nodes as shards: a few are looked up in a literal,
    more are a small table that is broadcast.
    """
    parsed = F.from_json(F.lit(json.dumps(nodes)), f"array<struct<node:int,{schema}>>")
    if len(nodes) <= LITERAL_NODES:
        found = rows.withColumn("told", F.get(F.filter(parsed, lambda n: n["node"] == F.col("node")), F.lit(0))).where("told is not null")
        return found.select(*rows.columns, *[f"told.{field.split(':')[0]}" for field in schema.split(",")])
    told = rows.sparkSession.range(1).select(F.explode(parsed).alias("n")).select("n.*")
    return rows.join(F.broadcast(told), "node")


def _split_level(rows: DataFrame, leaves: list[int], n_dims: int, scale: list[float], whole: float) -> tuple[DataFrame, list[int]]:
    """Split every node that still stands for several leaves; returns rows with their new nodes.

    Rows with the crossing metadata and CRC go to one side if they hold ``whole`` bytes at most."""
    spans = [f(f"d{k}").alias(f"{n}{k}") for k in range(n_dims) for n, f in (("lo", F.min), ("hi", F.max))]
    stats = {r["node"]: r for r in rows.groupBy("node").agg(F.sum("size").alias("w"), *spans).collect()}
    split = [n for n in range(len(leaves)) if n in stats and leaves[n] > 1]
    widest = {n: max(range(n_dims), key=lambda k, n=n: ((stats[n][f"hi{k}"] - stats[n][f"lo{k}"]) / scale[k], -k)) for n in split}
    target = {n: stats[n]["w"] * (leaves[n] // 2) / leaves[n] for n in split}

    # order of the rows of a node: widest dimension, CRC of the text, id, row number
    keyed = _told(rows, [{"node": n, "dim": widest.get(n, 0)} for n in range(len(leaves))], "dim:int")
    keyed = keyed.withColumns({"k0": F.element_at(F.array(*[F.col(f"d{k}") for k in range(n_dims)]), F.col("dim") + 1), "k1": F.col("text_crc32"), "k2": F.coalesce("doc_id", F.lit(-(2**62))), "k3": F.col("rid")}).drop("dim")
    pinned: dict[int, list[int]] = {n: [] for n in split}  # parts of the key of the crossing row
    left = dict.fromkeys(split, 0.0)  # bytes known to lie left of the open range
    fixed = "f0:bigint,f1:bigint,f2:bigint,f3:bigint"
    pins = lambda n: {f"f{q}": v for q, v in enumerate(pinned.get(n, ()))}
    open_ = set(split)
    for part in range(4):
        if not open_:
            break
        key, here = F.col(f"k{part}"), " and ".join(["true", *[f"k{q} = f{q}" for q in range(part)]])
        inside = _told(keyed, [{"node": n, **pins(n)} for n in sorted(open_)], fixed).where(here)
        ranges = {r["node"]: (r["lo"], r["hi"]) for r in inside.groupBy("node").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).collect()}
        seeking = set(open_)
        while seeking:
            asked = [{"node": n, "lo": ranges[n][0], "hi": ranges[n][1], "width": max(1, -(-(ranges[n][1] - ranges[n][0] + 1) // BUCKETS)), **pins(n)} for n in sorted(seeking)]
            sums = (
                _told(keyed, asked, f"lo:bigint,hi:bigint,width:bigint,{fixed}")
                .where(F.expr(here) & key.between(F.col("lo"), F.col("hi")))
                .select("node", "size", key.alias("key"), (key - F.col("lo")).alias("past"), "width")
                .groupBy("node", F.expr("past div width").alias("bucket"))
                .agg(F.sum("size").alias("w"), F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
                .collect()
            )
            by: dict[int, list] = {}
            for r in sums:
                by.setdefault(r["node"], []).append((r["bucket"], r["w"], r["n"], r["lo"], r["hi"]))
            for n in list(seeking):
                buckets = sorted(by[n])
                for at, (_, w, count, low_key, high_key) in enumerate(buckets):
                    if left[n] + w >= target[n] or at == len(buckets) - 1:
                        break
                    left[n] += w
                ranges[n] = (low_key, high_key)
                if low_key == high_key:
                    pinned[n].append(low_key)
                    seeking.discard(n)
                    if count == 1 or (part == 1 and w <= whole):
                        open_.discard(n)
    # the crossing row itself goes to the side that it brings nearer to the target
    told = [{"node": n, "pinned": len(pinned[n]), **pins(n)} for n in split]
    at_cut = " and ".join(f"(pinned <= {q} or k{q} = f{q})" for q in range(4))
    last = dict.fromkeys(split, True)
    if split:
        for r in _told(keyed, told, f"pinned:int,{fixed}").where(at_cut).groupBy("node").agg(F.sum("size").alias("w")).collect():
            last[r["node"]] = left[r["node"]] + r["w"] / 2 <= target[r["node"]]
    numbers, after = [], []
    for n, x in enumerate(leaves):
        numbers.append(len(after))
        after += [x // 2, x - x // 2] if x > 1 else [x]
    nodes = [{"node": n, "pinned": len(pinned.get(n, ())), "first": numbers[n], "divided": n in last, "last": last.get(n, True), **pins(n)} for n in range(len(leaves))]
    goes_left = F.col("last")
    for q in reversed(range(4)):  # lexicographic comparison with the pinned key
        k, f = F.col(f"k{q}"), F.col(f"f{q}")
        goes_left = F.when(F.col("pinned") <= q, F.col("last")).when(k < f, True).when(k > f, False).otherwise(goes_left)
    child = F.col("first") + F.when(F.col("divided") & ~goes_left, 1).otherwise(0)
    moved = _told(keyed, nodes, f"pinned:int,first:int,divided:boolean,last:boolean,{fixed}").withColumn("node", child.cast("int"))
    return materialise(moved.select(rows.columns), "kd-level"), after


def kd_shards(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    dims: tuple[str, ...] = ("n_chars", "source", "lang"),
    shards: int | None = None,
    target_bytes: int | None = None,
) -> DataFrame:
    """Assign every document to a leaf of the tree.

    Give ``shards`` or the ``target_bytes`` of a leaf.  Returns doc_id, size,
    text_crc32, shard (0 .. leaves - 1) and slot (0 .. rows of the shard - 1).
    """
    with tidy(docs.sparkSession):
        n_dims = len(dims)
        rows = metadata(docs, id_col, text_col, list(dims)).withColumn("node", F.lit(0))
        total = rows.agg(F.sum("size").alias("w"), F.count("*").alias("n"), *[(F.max(f"d{k}") - F.min(f"d{k}")).alias(f"s{k}") for k in range(n_dims)]).first()
        if shards is None:
            shards = max(1, math.ceil((total["w"] or 0) / target_bytes)) if target_bytes else 1
        leaves = [shards]
        scale = [float(total[f"s{k}"] or 0) or 1.0 for k in range(n_dims)]
        while max(leaves) > 1:
            rows, leaves = _split_level(rows, leaves, n_dims, scale, WHOLE * (total["w"] or 0) / shards)
        # gapless slots: number the rows inside (shard, bucket), then add the rows of the buckets before
        buckets = max(1, math.ceil(total["n"] / (shards * SLOT_ROWS)))
        rows = rows.select("doc_id", "size", "text_crc32", "rid", F.col("node").alias("shard"), F.pmod(F.xxhash64("doc_id", "rid"), F.lit(buckets)).alias("bucket"))
        before = (
            rows.groupBy("shard", "bucket")
            .agg(F.count("*").alias("n"))
            .withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .drop("n")
        )
        inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "rid")) - 1
        out = rows.withColumn("inside", inside).join(before, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("inside")).cast("long").alias("slot"))
        return materialise(out, "kd-shards", keep=True)
