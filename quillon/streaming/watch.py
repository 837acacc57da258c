"""Watching, pacing, stopping and resuming scans that run as streaming queries.

A scan asks for so many files a batch and waits between batches (its trigger); a
failed batch is waited for longer and tried again a few times; a scan that is
stopped goes on behind its last whole batch, as offsets and state are saved there.
Bad rows are counted batch by batch, they stop nothing.
"""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

#: Progress of so many batches is remembered; counters cover all.
REMEMBERED = 1000
# Tries of a failing scan, and seconds before the next one.
TRIES, WAIT = 3, 30.0
COUNTED = "scan_rows"


class Batch(NamedTuple):
    """Progress of one batch: rows read, rows that are bad, and milliseconds it took."""

    number: int
    rows: int
    errors: int
    millis: int


def counted(rows: DataFrame, bad: Column) -> DataFrame:
    """The rows of a stream, counted with the bad ones in every batch's progress."""
    return rows.observe(COUNTED, F.count(F.lit(1)).alias("total"), F.count(F.when(bad, 1)).alias("errors"))


@dataclass
class Seen:
    batches: deque[Batch] = field(default_factory=lambda: deque(maxlen=REMEMBERED))
    rows: int = 0
    errors: int = 0
    failures: list[str] = field(default_factory=list)


class Watch(StreamingQueryListener):
    """Collects the progress of the queries of one name; any thread may wait for a batch."""

    def __init__(self, name: str) -> None:
        self.name, self.seen, self.change = name, Seen(), threading.Condition()
        self.ids: set[str] = set()

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.ids.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name != self.name:
            return
        metrics = p.observedMetrics.get(COUNTED)
        with self.change:
            # a batch without rows has no metrics, and its progress may come again while the query idles
            if p.numInputRows or not self.seen.batches or self.seen.batches[-1].number != p.batchId:
                errors = metrics["errors"] if metrics is not None else 0
                self.seen.batches.append(Batch(p.batchId, p.numInputRows, errors, p.batchDuration))
                self.seen.rows += p.numInputRows
                self.seen.errors += errors
            self.change.notify_all()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) in self.ids:
            with self.change:
                if event.exception:
                    self.seen.failures.append(event.exception)
                self.change.notify_all()

    def last(self) -> int:
        return max((b.number for b in self.seen.batches), default=-1)

    def wait_for(self, batch: int, seconds: float = 300.0) -> bool:
        """Until that batch is whole; False when time is over."""
        with self.change:
            return self.change.wait_for(lambda: self.last() >= batch, seconds)


def watched(spark: SparkSession, name: str) -> Watch:
    """A listener for queries of that name; remove it with ``spark.streams.removeListener``."""
    watch = Watch(name)
    spark.streams.addListener(watch)
    return watch


def stop_after(query: StreamingQuery, watch: Watch, batch: int, seconds: float = 300.0) -> None:
    """Stop a scan behind a batch; what is whole by then stays, what isn't is made again on resuming."""
    try:
        if not watch.wait_for(batch, seconds):
            raise TimeoutError(f"batch {batch} of {watch.name} didn't end in {seconds} s")
    finally:
        query.stop()
        query.awaitTermination(60)


def patiently(start: Callable[[], StreamingQuery], watch: Watch, tries: int = TRIES, wait: float = WAIT, sleep: Callable[[float], None] = time.sleep) -> StreamingQuery:
    """Run a scan to its end; after a failure wait, and go on from its saved offsets.

    ``tries`` failures without a whole batch between them end it with the last error.
    """
    failed, reached = 0, watch.last()
    while True:
        query = start()
        try:
            query.awaitTermination()
            return query
        except StreamingQueryException:
            failed, reached = (1 if watch.last() > reached else failed + 1), watch.last()
            if failed >= tries:
                raise
            sleep(wait)
