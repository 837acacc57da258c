"""Profiles and feeds of a JSON API, landed as JSON lines or given as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FEED_LIMIT, PAGE_LIMIT, PAGE_ROWS = 5, 10, 100
POST = "struct<uri:string,cid:string,url:string,text:string,created_at:timestamp,author:struct<did:string,handle:string,display_name:string>,reply_count:bigint,repost_count:bigint,like_count:bigint,embed:string,is_pinned:boolean>"
POST_URI = r"^at://([^/]+)/app\.bsky\.feed\.post/(.+)$"


def last_segment(uri: Column) -> Column:
    return F.element_at(F.split(uri, "/"), -1)


def post_url(handle: Column, uri: Column) -> Column:
    return F.concat(F.lit("https://bsky.app/profile/"), handle, F.lit("/post/"), last_segment(uri))


def first_posts(feed: Column, most: int = FEED_LIMIT) -> Column:
    """The first posts of a feed, each with its address."""
    return F.transform(F.slice(feed, 1, most), lambda p: F.struct(p["uri"].alias("uri"), p["text"].alias("text"), p["created_at"].alias("created_at"), post_url(p["handle"], p["uri"]).alias("url"), F.coalesce(p["is_pinned"], F.lit(False)).alias("is_pinned")))


def promoted(pinned: Column, posts: Column) -> Column:
    """The pinned post, if its address is one, before the others of the feed."""
    valid = F.coalesce(F.regexp_like(pinned["uri"], F.lit(POST_URI)), F.lit(False))
    rest = F.filter(posts, lambda p: ~p["uri"].eqNullSafe(pinned["uri"]))
    return F.when(valid, F.concat(F.array(pinned), rest)).otherwise(posts)


def latest_unpinned(posts: Column) -> Column:
    return F.get(F.filter(posts, lambda p: ~F.coalesce(p["is_pinned"], F.lit(False))), F.lit(0))


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profiles of landed JSON; counts default to 0 and the display name to the handle."""
    schema = "did string, handle string, displayName string, description string, avatar string, followersCount bigint, followsCount bigint, postsCount bigint"
    raw = spark.read.schema(schema).json(path)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return raw.select(
        "did", F.col("handle").alias("username"), F.coalesce(F.nullif("displayName", F.lit("")), "handle").alias("display_name"), F.col("description").alias("bio"), F.col("avatar").alias("avatar_url"),
        zero("followersCount").alias("follower_count"), zero("followsCount").alias("following_count"), zero("postsCount").alias("posts_count"),
    )


def follow_pages(spark: SparkSession, path: str, page_limit: int = PAGE_LIMIT, page_rows: int = PAGE_ROWS) -> DataFrame:
    """(account, page, pos, did, handle) of landed pages of follow lists.

    A page is a JSON line with ``account``, ``page``, ``cursor`` and ``follows``; accounts are any
    text, paths whatever Spark reads.  An account has at most ``page_limit`` pages of
    ``page_rows`` rows, and its list ends behind the first page without a cursor, or
    before the first that is missing; a page that landed twice counts once.
    """
    schema = "account string, page int, cursor string, follows array<struct<did:string,handle:string>>"
    pages = spark.read.schema(schema).json(path).where((F.col("page") >= 0) & (F.col("page") < page_limit) & F.col("account").isNotNull())
    once = pages.groupBy("account", "page").agg(F.max_by(F.struct("cursor", "follows"), F.struct(F.size("follows"), "cursor")).alias("p"))
    # at most page_limit rows of an account
    before = Window.partitionBy("account").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    led = F.count(F.when(F.coalesce(F.length("p.cursor"), F.lit(0)) > 0, 1)).over(before)
    kept = once.withColumn("led", led).where("led = page")
    rows = kept.select("account", "page", F.posexplode(F.slice("p.follows", 1, page_rows)).alias("pos", "row"))
    return rows.select("account", "page", "pos", "row.did", "row.handle")
