"""Blocks of names: names that may meet, directly or over others, share one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import normal_name
from ..sources.tables import settled
from .resolve import name_pairs


def components(edges: DataFrame) -> DataFrame:
    """(v, component) of all ends of edges (a long, b long): the smallest id that can be reached.

    Every round takes the smallest label among neighbours, also for the label's own
    vertex, and jumps to the label's label, so a chain of n vertices takes about
    log n rounds.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = settled(both)
    labels = settled(both.groupBy(F.col("a").alias("v")).agg(F.least("v", F.min("b")).alias("c")))
    while True:
        other = labels.select(F.col("v").alias("b"), F.col("c").alias("near"))
        own = labels.select(F.col("v").alias("a"), F.col("c").alias("mine"))
        seen = both.join(other, "b").join(own, "a")
        hooks = seen.select(F.col("mine").alias("v"), F.col("near").alias("c")).unionByName(seen.select(F.col("a").alias("v"), F.col("near").alias("c")))
        least = labels.unionByName(hooks).groupBy("v").agg(F.min("c").alias("c"))
        jump = least.select(F.col("v").alias("c"), F.col("c").alias("next"))
        new = settled(least.join(jump, "c", "left").select("v", F.least("c", F.coalesce("next", "c")).alias("c")))
        if new.join(labels.withColumnRenamed("c", "was"), "v").where("c <> was").isEmpty():
            return new.select("v", F.col("c").alias("component"))
        labels = new


def name_key(name: Column) -> Column:
    """Vertex of a name: its normal form, or the name itself where that is empty; null has none."""
    plain = normal_name(name)
    return F.when(plain != "", F.xxhash64(F.lit("n"), plain)).when(name != "", F.xxhash64(F.lit("u"), name))


def name_blocks(people: DataFrame) -> DataFrame:
    """(name_key, block) for the names of people (username, display_name).

    Both names of a person are linked, and so are similar names of any two; names
    are compared once each, as ``name_pairs`` does.
    """
    keys = people.select(name_key(F.col("username")).alias("a"), F.coalesce(name_key(F.col("display_name")), name_key(F.col("username"))).alias("b")).where("a is not null").distinct()
    # each name once; ids are the vertices
    found = []
    for c in ("username", "display_name"):
        names = people.select(normal_name(F.col(c)).alias("username"), F.lit(None).cast("string").alias("display_name")).where("username <> ''").distinct()
        one = names.select(name_key(F.col("username")).alias("id"), "username", "display_name")
        found.append(name_pairs(one, one, ("username",)).select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))
    edges = keys.unionByName(found[0]).unionByName(found[1])
    return components(edges).select(F.col("v").alias("name_key"), F.col("component").alias("block"))


def with_blocks(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows with the block of their username; a name that isn't listed is a block of its own."""
    listed = rows.withColumn("name_key", F.coalesce(name_key(F.col("username")), F.lit(0))).join(blocks, "name_key", "left")
    return listed.withColumn("block", F.coalesce("block", "name_key")).drop("name_key")
