"""Streams of results: upserts in arrival order, latest progress, bad rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader, StreamingQuery
from pyspark.sql.types import StructType

from ..functions.scalars import row_errors


def latest(progress: DataFrame, key: str = "platform", seq: str = "seq") -> DataFrame:
    """Last row of each key; also as a stream in complete or update mode."""
    rest = [c for c in progress.columns if c != key]
    return progress.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("p")).select(key, "p.*")


def merged(state: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """State after a batch: a row replaces only with strictly greater confidence,
    of equal ones the earliest stays, so the result doesn't depend on batches."""
    rest = [c for c in state.columns if c not in keys]
    both = state.unionByName(batch.select(state.columns))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("confidence", -F.col("seq"))).alias("r")).select(*keys, "r.*").select(state.columns)


#: Versions of the state that are kept, and hash parts in which it lies.
VERSIONS, PARTS = 2, 16


def upsert_stream(source: DataFrame, folder: str, keys: list[str], every: str | None = None, parts: int = PARTS, name: str | None = None) -> StreamingQuery:
    """Merge every micro-batch into a Parquet state of its own version.

    Version n is a function of version n - 1 and batch n, so a batch that is
    repeated after a failure writes the same state; read it with current_state.
    The state lies in hash parts of its keys: a batch rewrites those that it
    touches and takes over the others by name.  ``every`` is a trigger interval; without one
    the query ends when all input is read.
    """
    spark = source.sparkSession
    part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")

    def apply(batch: DataFrame, number: int) -> None:
        known = _versions(spark, folder).get(number - 1, {}) if number else {}
        dealt = batch.withColumn("state_part", part).persist()
        try:
            touched = sorted(r[0] for r in dealt.select("state_part").distinct().collect())  # at most ``parts``
            old = [known[p] for p in touched if p in known]
            state = spark.read.schema(batch.schema).parquet(*old) if old else batch.limit(0)
            path = f"{folder}/state/{number}"
            merged(state, dealt, keys).withColumn("state_part", part).repartition(parts, "state_part").write.mode("overwrite").partitionBy("state_part").parquet(path)
            listed = {**known, **{p: f"{path}/state_part={p}" for p in touched}}
            rows = [(p, listed[p]) for p in sorted(listed)]
            spark.createDataFrame(rows, "part int, path string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/versions/{number}")
        finally:
            dealt.unpersist()
        _drop_old(spark, folder, number, {x for v in _versions(spark, folder, number - VERSIONS + 1).values() for x in v.values()})

    trigger = {"processingTime": every} if every else {"availableNow": True}
    sink = source.writeStream.foreachBatch(apply).option("checkpointLocation", f"{folder}/checkpoint")
    return (sink.queryName(name) if name else sink).trigger(**trigger).start()


def _listed(spark: SparkSession, path: str) -> list[str]:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in system.listStatus(place)] if system.exists(place) else []


def _versions(spark: SparkSession, folder: str, least: int = 0) -> dict[int, dict[int, str]]:
    """Paths of the parts of every whole version that is still there."""
    whole = [n for n in map(int, _listed(spark, f"{folder}/versions")) if n >= least and "_SUCCESS" in _listed(spark, f"{folder}/versions/{n}")]
    return {n: {r["part"]: r["path"] for r in spark.read.parquet(f"{folder}/versions/{n}").collect()} for n in whole}


def _drop_old(spark: SparkSession, folder: str, number: int, used: set[str]) -> None:
    """Remove versions but the last, and parts that none of them names."""
    gone = [f"{folder}/versions/{n}" for n in map(int, _listed(spark, f"{folder}/versions")) if n <= number - VERSIONS]
    for n in map(int, _listed(spark, f"{folder}/state")):
        gone += [p for p in (f"{folder}/state/{n}/{x}" for x in _listed(spark, f"{folder}/state/{n}") if x.startswith("state_part=")) if n < number and p not in used]
    for path in gone:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def current_state(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The last whole version; empty before the first batch."""
    known = _versions(spark, folder)
    paths = list(known[max(known)].values()) if known else []
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def counted_errors(rows: DataFrame, bad: Column, name: str = "errors") -> tuple[DataFrame, Observation]:
    """The rows, and a counter of bad ones that fills while any action runs on them."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("total"), F.count(F.when(bad, 1)).alias("errors")), seen


def polite(reader: DataStreamReader, files: int = 1, age: str = "7d") -> DataStreamReader:
    """Rate of a file source: so many files a batch, none older than ``age``; with the
    trigger interval of ``upsert_stream`` this is the wait between requests.  Failed tasks
    are tried again by Spark (spark.task.maxFailures)."""
    return reader.option("maxFilesPerTrigger", files).option("maxFileAge", age)


def dead_letters(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and invalid ones with their errors, so that one bad row stops nothing."""
    checked = rows.withColumn("errors", row_errors(F.col("username"), F.col("platform"), F.col("profile_url"), F.col("confidence")))
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def with_fallback(rows: DataFrame) -> DataFrame:
    """The model's verdict where there is one, else the rules' under the name pattern-fallback."""
    missing = F.col("model").isNull()
    return rows.withColumn("verdict", F.when(missing, F.struct("rules.status", "rules.confidence", F.lit("pattern-fallback").alias("method"))).otherwise(F.struct("model.status", "model.confidence", F.lit("model").alias("method"))))


def scan_complete(completed: DataFrame, active: DataFrame) -> DataFrame:
    """One row: whether at least as many platforms are completed as are active."""
    n = lambda df, name: df.select("platform").distinct().agg(F.count("*").alias(name))
    return n(completed, "completed").crossJoin(n(active, "active")).withColumn("complete", F.col("completed") >= F.col("active"))  # one row each
