"""Keyed state as sorted-out runs of changes: what a batch writes follows the batch.

A version is one batch of changes: rows to set and keys to remove, one row a key.
It is written as a run of its own, dealt to hash parts by its size.  Two last runs
are merged while the older isn't more than twice as large, so there are
logarithmically many runs and a row is rewritten logarithmically often; a merge
that reaches the oldest run drops what was removed.  A version is a small list of
runs, put in place by one rename, so readers see whole versions only, and a batch
that is repeated after a failure writes the same version again.  A read for given
keys opens only the parts that they fall into.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of a hash part, parts up to which a read looks for those of its keys, and versions that are kept.
PART_ROWS, PRUNED, KEPT = 100_000, 4096, 2
VERSION, GONE, PART = "run_version", "run_gone", "run_part"


@dataclass
class Run:
    """Changes of some versions: where they lie, how many rows and hash parts they are."""

    path: str
    rows: int
    parts: int


class Runs:
    """State of rows with the columns of ``schema``, one for each value of ``keys``."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, keys: list[str]) -> None:
        self.spark, self.folder, self.schema, self.keys = spark, folder.rstrip("/"), schema, keys

    # ---------------------------------------------------------------- versions

    def _files(self):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        files, path = self._files()
        place = path(f"{self.folder}/versions")
        return sorted(int(f.getPath().getName()) for f in files.listStatus(place) if f.getPath().getName().isdigit()) if files.exists(place) else []

    def runs(self, version: int | None = None) -> list[Run]:
        """Runs of a version (the last one unless given), oldest first."""
        known = self.versions()
        if not known:
            return []
        text = self.spark.read.text(f"{self.folder}/versions/{known[-1] if version is None else version}", wholetext=True).first()[0]
        return [Run(**r) for r in json.loads(text)]

    def _commit(self, version: int, runs: list[Run]) -> None:
        files, path = self._files()
        draft, final = path(f"{self.folder}/drafts/{uuid.uuid4().hex}"), path(f"{self.folder}/versions/{version}")
        out = files.create(draft, True)
        out.write(bytearray(json.dumps([asdict(r) for r in runs]).encode()))
        out.close()
        files.mkdirs(final.getParent())
        files.delete(final, False)
        if not files.rename(draft, final):
            raise RuntimeError(f"version {version} of {self.folder} could not be put in place")

    # ------------------------------------------------------------------- reads

    def _part(self, parts: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(parts)).cast("int")

    def _rows(self, run: Run, keys: DataFrame | None = None) -> DataFrame:
        schema = StructType(list(self.schema.fields)).add(VERSION, "long").add(GONE, "boolean").add(PART, "integer")
        rows = self.spark.read.schema(schema).parquet(run.path)
        if keys is not None and 1 < run.parts <= PRUNED:
            touched = [r[0] for r in keys.select(self._part(run.parts)).distinct().collect()]  # at most PRUNED numbers
            rows = rows.where(F.col(PART).isin(touched))
        return rows.drop(PART)

    def _last(self, runs: list[Run], keys: DataFrame | None = None) -> DataFrame | None:
        """The last change of each key among the runs."""
        rows = None
        for run in runs:
            rows = self._rows(run, keys) if rows is None else rows.unionByName(self._rows(run, keys))
        if rows is None or len(runs) == 1:
            return rows
        rest = [c for c in rows.columns if c not in self.keys]
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), VERSION).alias("r")).select(*self.keys, "r.*")

    def read(self, version: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """Rows of a version (the last one unless given), of the given keys only if there are any."""
        rows = self._last(self.runs(version), keys)
        if rows is None:
            return self.spark.createDataFrame([], self.schema)
        rows = rows.where(~F.col(GONE)).select(self.schema.names)
        return rows if keys is None else rows.join(keys.select(*self.keys).distinct(), self.keys, "left_semi")

    # ------------------------------------------------------------------ writes

    def write(self, version: int, rows: DataFrame, removed: DataFrame | None = None) -> list[Run]:
        """Make a version: ``rows`` replace those of their keys, ``removed`` keys go.

        Both hold a key once, and no key is in both.  Writing a version again replaces it.
        """
        changes = rows.select(self.schema.names).withColumn(GONE, F.lit(False))
        if removed is not None:
            empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields if f.name not in self.keys]
            changes = changes.unionByName(removed.select(*self.keys, *empty, F.lit(True).alias(GONE)))
        # a version that is made again starts from the one before it
        before = [v for v in self.versions() if v < version]
        runs = self.runs(before[-1]) if before else []
        new = self._write(changes.withColumn(VERSION, F.lit(version).cast("long")), f"{version}-{uuid.uuid4().hex[:8]}")
        runs = [*runs, new] if new.rows else runs
        while len(runs) > 1 and runs[-2].rows <= 2 * runs[-1].rows:
            whole = self._last(runs[-2:])
            whole = whole.where(~F.col(GONE)) if len(runs) == 2 else whole
            runs = [*runs[:-2], self._write(whole, f"{version}-{uuid.uuid4().hex[:8]}")]
        self._commit(version, runs)
        self._sweep()
        return runs

    def _write(self, changes: DataFrame, name: str) -> Run:
        """A run; its rows are counted while they are written, so parts follow an estimate that a second look mends."""
        path = f"{self.folder}/runs/{name}"
        held = changes.persist()
        try:
            n = held.count()
            parts = max(1, -(-n // PART_ROWS))
            dealt = held.withColumn(PART, self._part(parts))
            (dealt.repartition(parts, PART) if parts > 1 else dealt.coalesce(1)).sortWithinPartitions(PART, *self.keys).write.mode("overwrite").partitionBy(PART).parquet(path)
        finally:
            held.unpersist()
        return Run(path, n, parts)

    def _sweep(self) -> None:
        """Remove versions but the last ones, and runs that none of those name."""
        files, path = self._files()
        known = self.versions()
        for v in known[:-KEPT]:
            files.delete(path(f"{self.folder}/versions/{v}"), False)
        used = {r.path.rsplit("/", 1)[1] for v in known[-KEPT:] for r in self.runs(v)}
        place = path(f"{self.folder}/runs")
        for f in files.listStatus(place) if files.exists(place) else []:
            if f.getPath().getName() not in used:
                files.delete(f.getPath(), True)
