"""Results as artists arrive: duplicates updated, platforms merged, in arrival order.

An arrival updates the result of its username on its platform if it is strictly
more confident; else it merges with the first stored result of another platform
that has a similar name; else it is a new result.  Which results can meet is known
beforehand: the follow lists name everybody before profiles arrive, and their names
fall into blocks (``operators.blocks``).  A block is a key: its results lie in the
state store, arrivals of a block are taken in order of ``seq``, and blocks have
nothing to do with each other.  A batch therefore touches the blocks of its own
arrivals only.  Most blocks hold few results, so blocks are dealt into ``BUCKETS``, which are what
Spark groups by and Python is called for.  Names that no list has are blocks of their own.

The same steps run as a batch (``merge_arrivals``) and as a stream
(``merge_stream``), whose changed results go to a table of runs.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..operators.blocks import with_blocks
from ..operators.resolve import RANK
from .runs import Runs

#: An arrival: ``seq`` is unique and gives the order; ``updated`` is in microseconds.
ARRIVAL = "seq long, username string, display_name string, platform string, status string, confidence double, updated long"
VALUE = "username string, display_name string, platform string, status string, confidence double, updated long, platforms string, platform_data string"
RESULT = f"id long, {VALUE}"
FIELDS = [f.split()[0] for f in VALUE.split(", ")]
# built from names, as Python workers have no session to parse with
BLOCK_TYPE, RESULTS_TYPE = StructType().add("block", "long"), StructType().add("results", "string")
#: Groups that blocks are dealt into; part of what a checkpoint holds.
BUCKETS = 1024
DATA = "map<string,struct<username:string,status:string,confidence:double,updated:long>>"


def plain_name(name: str | None) -> str:
    return re.sub("[^a-z0-9]", "", (name or "").lower())


def similar(a: str | None, b: str | None) -> bool:
    """The rule of ``scalars.similar_names`` for two names."""
    x, y = plain_name(a), plain_name(b)
    if not x or not y:
        return False
    short, long = sorted((len(x), len(y)))
    return x == y or ((x in y or y in x) and short / long >= (0.6 if short < 6 else 0.7))


def entry(r: dict) -> dict:
    return {k: r[k] for k in ("username", "status", "confidence", "updated")}


def stands_on(r: dict, platform: str) -> bool:
    return r["platform"] == platform or platform in json.loads(r["platforms"] or "[]")


def absorb(results: dict[int, dict], a: dict) -> int | None:
    """Take an arrival into the results of its block, which are in stored order; the id of what has changed."""
    new = {k: a[k] for k in FIELDS[:6]} | {"platforms": None, "platform_data": None}
    for i, r in results.items():
        if r["username"] == a["username"] and stands_on(r, a["platform"]):
            if not (a["confidence"] or 0) > (r["confidence"] or 0):
                return None
            data = json.loads(r["platform_data"] or "{}") | {a["platform"]: entry(a)}
            results[i] = new | {"platforms": r["platforms"], "platform_data": json.dumps(data, sort_keys=True)}
            return i
    for i, r in results.items():
        if not stands_on(r, a["platform"]) and (similar(r["username"], a["username"]) or similar(r["display_name"], a["display_name"])):
            rank = lambda x: (RANK.get(x["status"], 0), x["confidence"] or 0, x["updated"] or 0)
            base, other = (new, r) if rank(new) > rank(r) else (r, new)
            platforms = json.loads(base["platforms"] or "null") or [base["platform"]]
            platforms += [other["platform"]] if other["platform"] not in platforms else []
            data = json.loads(base["platform_data"] or "{}") | {base["platform"]: entry(base)} | {other["platform"]: entry(other)}
            results[i] = base | {"platforms": json.dumps(platforms), "platform_data": json.dumps(data, sort_keys=True)}
            return i
    results[a["seq"]] = new
    return a["seq"]


def frame(results: dict[int, dict], ids: list[int]) -> pd.DataFrame:
    out = pd.DataFrame([(i, *(results[i][k] for k in FIELDS)) for i in ids], columns=["id", *FIELDS])
    return out.astype({"id": "int64", "confidence": "float64", "updated": "Int64"})


def clean(rows: pd.DataFrame) -> list[dict]:
    """Arrivals in order, missing values as None; whole numbers beside missing ones come as doubles."""
    ordered = rows.sort_values("seq")
    records = ordered.astype(object).where(ordered.notna(), None).to_dict("records")
    return [r | {"seq": int(r["seq"]), "updated": None if r["updated"] is None else int(r["updated"])} for r in records]


def arrived(rows: DataFrame) -> DataFrame:
    """Arrivals with ``last_updated`` as a timestamp, in the form that both ways take."""
    return rows.select("seq", "username", "display_name", "platform", "status", F.col("confidence").cast("double").alias("confidence"), F.unix_micros("last_updated").alias("updated")).where("seq is not null and username is not null and platform is not null")


def results_of(rows: DataFrame) -> DataFrame:
    """Results with time, platforms and the data of each platform as columns of their own types."""
    platforms = F.coalesce(F.from_json("platforms", "array<string>"), F.array("platform"))
    return rows.select("id", "username", "display_name", "platform", "status", "confidence", F.timestamp_micros("updated").alias("last_updated"), platforms.alias("platforms"), F.from_json("platform_data", DATA).alias("platform_data"))


def merge_arrivals(arrivals: DataFrame, blocks: DataFrame, each: int = 5000) -> DataFrame:
    """All results after all arrivals, as one batch; most blocks hold few rows, so a group takes many, of about ``each`` arrivals together."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        results: dict[int, dict[int, dict]] = {}
        for a in clean(rows):
            absorb(results.setdefault(a["block"], {}), a)
        whole = {i: r for block in results.values() for i, r in block.items()}
        return frame(whole, list(whole))

    groups = max(1, -(-arrivals.count() // each))
    return with_blocks(arrivals, blocks).groupBy(F.pmod("block", F.lit(groups)).alias("group")).applyInPandas(fold, RESULT)


class Merging(StatefulProcessor):
    """Results of a bucket's blocks in a map state by block, those of a block in stored order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.results = handle.getMapState("blocks", BLOCK_TYPE, RESULTS_TYPE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        blocks: dict[int, dict[int, dict]] = {}
        changed: dict[int, int] = {}
        for a in clean(pd.concat(list(rows))):
            block = int(a["block"])
            if block not in blocks:
                held = json.loads(self.results.getValue((block,))[0]) if self.results.containsKey((block,)) else []
                blocks[block] = {i: dict(zip(FIELDS, values, strict=True)) for i, *values in held}
            if (i := absorb(blocks[block], a)) is not None:
                changed[i] = block
        for block in dict.fromkeys(changed.values()):
            self.results.updateValue((block,), (json.dumps([(i, *(r[k] for k in FIELDS)) for i, r in sorted(blocks[block].items())]),))
        yield frame({i: blocks[block][i] for i, block in changed.items()}, list(changed))

    def close(self) -> None:
        pass


def merge_stream(arrivals: DataFrame, blocks: DataFrame, folder: str, every: str | None = None, name: str | None = None) -> StreamingQuery:
    """Merge arrivals as they come; results are read with ``merged_results``.

    State and offsets lie in the folder's checkpoint, so a query that is stopped or
    killed goes on behind its last whole batch.
    """
    spark = arrivals.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    store = _store(spark, folder)
    changed = with_blocks(arrivals, blocks).withColumn("bucket", F.pmod("block", F.lit(BUCKETS))).groupBy("bucket").transformWithStateInPandas(statefulProcessor=Merging(), outputStructType=StructType.fromDDL(RESULT), outputMode="Update", timeMode="None")
    sink = changed.writeStream.outputMode("update").foreachBatch(lambda batch, number: store.write(number, batch) and None).option("checkpointLocation", f"{folder}/checkpoint")
    return (sink.queryName(name) if name else sink).trigger(**({"processingTime": every} if every else {"availableNow": True})).start()


def _store(spark: SparkSession, folder: str) -> Runs:
    return Runs(spark, f"{folder}/results", StructType.fromDDL(RESULT), ["id"])


def merged_results(spark: SparkSession, folder: str) -> DataFrame:
    return _store(spark, folder).read()
