"""Reading and writing tables, CSV in and out, and model artefacts."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import iso_millis, percent

# Model variants in the order in which they are tried, and files that make one complete.
MODEL_ORDER = ("fp16", "full", "int8")
MODEL_FILES = ("config.json", "tokenizer.json", "tokenizer_config.json", "special_tokens_map.json", "vocab.txt")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local session without one gets a folder of this machine."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-"))
        base = context.getCheckpointDir()
    return base if "://" in base or base.startswith("file:") else f"file://{base}"


def settled(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder, without their lineage."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame, each: int = 5000) -> DataFrame:
    """Rows dealt evenly over tasks, about ``each`` rows to a task.

    A table of few bytes is one task, however long its rows take; call this on narrow rows,
    before they are made wide or go through Python.
    """
    return rows.repartition(max(1, -(-rows.count() // each)))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; quoted fields may hold line breaks and doubled quotes."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def export_columns(rows: DataFrame) -> DataFrame:
    """artist, username, platform, confidence (NN%), profileUrl, triggers, scanDate."""
    return rows.select(
        F.coalesce(F.nullif("display_name", F.lit("")), "username").alias("artist"), "username", "platform",
        F.concat(percent(F.col("confidence")).cast("string"), F.lit("%")).alias("confidence"), F.col("profile_url").alias("profileUrl"),
        F.array_join("triggers", ", ").alias("triggers"), iso_millis(F.col("last_updated")).alias("scanDate"),
    )


def csv_line(*columns: Column) -> Column:
    """One line: every value quoted, quotes doubled, null as an empty value."""
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns]
    return F.concat_ws(",", *quoted)


def csv_lines(rows: DataFrame) -> DataFrame:
    return rows.select(csv_line(*[F.col(c) for c in rows.columns]).alias("line"))


def write_csv(rows: DataFrame, path: str) -> None:
    """Sharded CSV, every value quoted; use csv_lines for the exact bytes of one file."""
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def csv_document(rows: DataFrame) -> str:
    """A small export as one document: plain header, no final line break; no rows is an error.

    The export is a download for a person; larger ones go through write_csv.
    """
    lines = [r["line"] for r in csv_lines(rows).toLocalIterator()]
    if not lines:
        raise ValueError("nothing to export")
    return "\n".join([",".join(rows.columns), *lines])


def model_path(folder: str, order: tuple[str, ...] = MODEL_ORDER) -> str | None:
    """First model variant whose files are all there; None turns the model off."""
    for variant in order:
        if all((Path(folder) / variant / f).is_file() for f in MODEL_FILES) and any((Path(folder) / variant).glob("*.onnx")):
            return str(Path(folder) / variant)
    return None
