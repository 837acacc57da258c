"""How the driver's tables stand in for profiles, posts, galleries and pages.

Customers and suppliers are the profiles of two platforms, orders journals,
line items gallery items, events posts, and documents texts.  The tables hold
none of the lexicon's words, so texts carry one of 21 sentences by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

AS_OF = "2024-01-31 00:00:00"
PHRASES = (
    "My commissions are open this week", "comms open, message me", "c0mms 0pen", "taking comms again", "comm slots available for May", "open for commissions",
    "Commission: open / price list below", "queue is open", "DM me for comms, slots available, accepting commissions", "commissions closed until spring", "comms are full", "not taking commissions",
    "no comms please", "on hiatus", "fully booked", "queue is full and waitlist is closed", "com closed", "not accepting commissions", "I paint landscapes",
    "commissions open! edit: commissions closed", "nothing to see here",
)


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def phrase(key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in PHRASES]), F.pmod(key, F.lit(len(PHRASES))).cast("int") + 1)


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, source, text): sentence by id, a blank, and the whole text."""
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", "source", F.concat(phrase(F.col("doc_id")), F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"))


def components(spark: SparkSession, folder: str) -> DataFrame:
    """Components of customers: name, bio, stated status, journals, items, posts."""
    key = F.col("c_custkey")
    none = F.lit(None)
    profile = table(spark, folder, "customer").select(
        key.alias("profile_id"),
        F.explode(
            F.array(
                F.struct(F.lit("display_name").alias("kind"), F.when(key % 3 == 0, phrase(key)).otherwise(F.col("c_name")).alias("text")),
                F.struct(F.lit("bio").alias("kind"), F.when(key % 4 != 3, phrase(key * 7 + 18)).otherwise("").alias("text")),
                F.struct(F.lit("commission_status").alias("kind"), F.when(key % 5 == 0, "open").when(key % 5 == 1, "closed").otherwise("").alias("text")),
            )
        ).alias("c"),
    )
    fixed = dict(pos=F.lit(0).cast("long"), event_time=none.cast("timestamp"), is_pinned=F.lit(False), date_present=F.lit(False))
    out = profile.select("profile_id", "c.kind", fixed["pos"].alias("pos"), "c.text", fixed["event_time"].alias("event_time"), fixed["is_pinned"].alias("is_pinned"), fixed["date_present"].alias("date_present"))
    orders = table(spark, folder, "orders")
    # the journal is the latest order; its date is moved into the months before AS_OF
    latest = orders.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("o")).select("o_custkey", "o.o_orderkey")
    journals = latest.select(
        F.col("o_custkey").alias("profile_id"), F.lit("journal").alias("kind"), F.col("o_orderkey").alias("pos"), phrase(F.col("o_orderkey")).alias("text"),
        (as_of() - F.make_dt_interval((F.col("o_orderkey") % 120).cast("int"))).alias("event_time"), F.lit(False).alias("is_pinned"), F.lit(True).alias("date_present"),
    )
    items = table(spark, folder, "lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    item_key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    gallery = items.select(
        F.col("o_custkey").alias("profile_id"), F.lit("gallery").alias("kind"), item_key.alias("pos"), phrase(item_key).alias("text"),
        F.when(item_key % 11 != 0, as_of() - F.make_dt_interval((item_key % 100).cast("int"))).alias("event_time"), F.lit(False).alias("is_pinned"), (item_key % 22 != 0).alias("date_present"),
    )
    events = table(spark, folder, "events")
    posts = events.select(
        F.col("user_id").alias("profile_id"), F.lit("post").alias("kind"), F.col("event_id").alias("pos"), phrase(F.col("event_id")).alias("text"),
        F.col("ts").cast("timestamp").alias("event_time"), (F.col("event_id") % 7 == 0).alias("is_pinned"), F.lit(True).alias("date_present"),
    )
    return out.unionByName(journals).unionByName(gallery).unionByName(posts)


def scored_posts(spark: SparkSession, folder: str) -> DataFrame:
    """Events as posts with a given verdict: (profile_id, kind, pos, status, confidence, tw, s, ...)."""
    from ..functions.scalars import label_score, time_weight

    status = F.when(F.col("event_type") == "purchase", "open").when(F.col("event_type") == "error", "closed").otherwise("unclear")
    events = table(spark, folder, "events").select(
        F.col("user_id").alias("profile_id"), F.lit("post").alias("kind"), F.col("event_id").alias("pos"), status.alias("status"), F.least(F.lit(1.0), F.col("value") / 100.0).alias("confidence"),
        time_weight(F.col("ts").cast("timestamp"), as_of()).alias("tw"), (F.col("event_id") % 7 == 0).alias("is_pinned"),
    )
    return events.withColumn("s", label_score(F.col("status"), F.col("confidence")))


def scored_gallery(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as gallery items with a given verdict."""
    from ..functions.scalars import label_score, time_weight

    status = F.when(F.col("l_returnflag") == "A", "open").when(F.col("l_returnflag") == "R", "closed").otherwise("unclear")
    when = as_of() - F.make_dt_interval((F.col("l_partkey") % 100).cast("int"))
    items = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("profile_id"), F.lit("gallery").alias("kind"), F.col("l_linenumber").alias("pos"), status.alias("status"), (F.lit(1.0) - F.col("l_discount")).alias("confidence"), time_weight(when, as_of()).alias("tw"),
    )
    return items.withColumn("s", label_score(F.col("status"), F.col("confidence")))


def platform_a(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        key.alias("id"), F.lit("furaffinity").alias("platform"), F.concat(F.lit("Maker"), F.lpad(key.cast("string"), 6, "0")).alias("username"),
        F.when(key % 5 == 0, F.concat(F.lit("Supplier#"), F.lpad(key.cast("string"), 9, "0"))).otherwise(F.col("c_name")).alias("display_name"),
        F.when(key % 3 == 0, "open").when(key % 3 == 1, "closed").otherwise("unclear").alias("status"), (F.pmod(key * 37, F.lit(101)) / 100.0).alias("confidence"),
        (as_of() - F.make_dt_interval((key % 50).cast("int"))).alias("last_updated"), key.alias("seq"),
    )


def platform_b(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("s_suppkey")
    suffix = F.when(key % 3 == 0, "").when(key % 3 == 1, ".bsky.social").otherwise("_art")
    return table(spark, folder, "supplier").select(
        key.alias("id"), F.lit("bluesky").alias("platform"), F.concat(F.lit("maker"), F.lpad(key.cast("string"), 6, "0"), suffix).alias("username"), F.col("s_name").alias("display_name"),
        F.when(key % 2 == 0, "open").otherwise("closed").alias("status"), (F.pmod(key * 53, F.lit(101)) / 100.0).alias("confidence"),
        (as_of() - F.make_dt_interval((key % 40).cast("int"))).alias("last_updated"), key.alias("seq"),
    )


def results(spark: SparkSession, folder: str) -> DataFrame:
    """Result rows: customers, every seventh merged with a second platform."""
    key = F.col("id")
    a = platform_a(spark, folder)
    merged = key % 7 == 0
    own = F.struct(F.col("status").alias("status"), F.col("confidence").alias("confidence"))
    other = F.struct(F.when(key % 2 == 0, "open").otherwise("closed").alias("status"), (F.pmod(key * 11, F.lit(101)) / 100.0).alias("confidence"))
    return a.withColumns(
        {
            "platforms": F.when(merged, F.array(F.lit("furaffinity"), F.lit("bluesky"))).otherwise(F.array(F.lit("furaffinity"))),
            "platform_data": F.when(merged, F.create_map(F.lit("furaffinity"), own, F.lit("bluesky"), other)).otherwise(F.create_map(F.lit("furaffinity"), own)),
            "triggers": F.array(phrase(key), F.lit("queue")),
            "profile_url": F.when(key % 13 == 0, F.lit("ftp://x")).otherwise(F.concat(F.lit("https://www.example.com/user/"), F.lower("username"))),
        }
    )


def favourites(spark: SparkSession, folder: str) -> DataFrame:
    return platform_a(spark, folder).where(F.col("id") % 10 == 0).select(F.concat_ws("_", "platform", "username").alias("artist_id"))


def blacklist(spark: SparkSession, folder: str) -> DataFrame:
    return platform_a(spark, folder).where(F.col("id") % 17 == 0).select(F.concat_ws("_", "platform", "username").alias("artist_id"))
