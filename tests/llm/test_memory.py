"""Memory of a Python worker, in a session of one core in a process of its own."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TOKENS = """
import sys
from pyspark.sql import SparkSession, functions as F
from quillon.llm import bpe
from quillon.llm.queries import byte_bpe
from quillon.llm.shared import small_batches

spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
small_batches(spark)

def most(batches):
    import pyarrow as pa
    for _ in batches:
        pass
    lines = dict(x.split(":") for x in open("/proc/self/status"))
    yield pa.RecordBatch.from_pydict({"pid": [int(lines["Pid"])], "mb": [int(lines["VmHWM"].split()[0]) // 1024]})

def worker():
    return spark.range(1).coalesce(1).mapInArrow(most, "pid long, mb long").collect()[0]

# almost every word is a piece of its own
words = F.transform(F.sequence(F.lit(1), F.lit(160)), lambda k: F.translate(F.substring(F.sha1(F.concat_ws("-", "id", k).cast("binary")), 1, 9), "0123456789", "ghijklmnop"))
docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", words).alias("text"))
before = worker()
rows = bpe.bpe_encode(docs, *byte_bpe()).select(F.count("*"), F.min("round_trip")).first()
after = worker()
assert before["pid"] == after["pid"] and tuple(rows) == (4000, True), (before, after, rows)
print("grown by", after["mb"] - before["mb"])
"""


def test_a_worker_that_encodes_stays_small():
    env = os.environ | {"PYTHONPATH": ROOT, "OMP_NUM_THREADS": "1"}
    done = subprocess.run([sys.executable, "-c", TOKENS], env=env, capture_output=True, text=True, timeout=400)
    assert done.returncode == 0, done.stderr[-2000:]
    grown = int(done.stdout.split("grown by")[1])
    assert grown < 240, grown
