"""Profiles to component rows, and small lookups around results.

Component rows are (profile_id, kind, pos, text, event_time, is_pinned,
date_present, url, likes, reposts, replies), one per text to classify.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import item_text

COMPONENT = "struct<kind:string,pos:bigint,text:string,event_time:timestamp,is_pinned:boolean,date_present:boolean,url:string,likes:bigint,reposts:bigint,replies:bigint>"
# Name, colour and address of platforms; what another one has.
PLATFORMS = {"furaffinity": ("FurAffinity", "#ff6f46", "https://www.furaffinity.net"), "bluesky": ("Bluesky", "#0085ff", "https://bsky.app"), "twitter": ("Twitter/X", "#1da1f2", "https://twitter.com")}
OTHER_COLOUR, OTHER_ADDRESS = "#666666", ""
# What a status is called.
STATUS_LABELS = {"open": "\u2705 Open", "closed": "\u274c Closed", "unclear": "\u2753 Unclear"}


def _row(kind: str, text: Column, pos: Column | None = None, when: Column | None = None, pinned: Column | None = None, present: Column | None = None, url: Column | None = None, likes: Column | None = None, reposts: Column | None = None, replies: Column | None = None) -> Column:
    zero = lambda c: F.coalesce(c, F.lit(0)) if c is not None else F.lit(None)
    null = F.lit(None)
    parts = (
        F.lit(kind), F.lit(0) if pos is None else pos, text, null if when is None else when, F.lit(False) if pinned is None else pinned, F.lit(False) if present is None else present,
        null if url is None else url, zero(likes), zero(reposts), zero(replies),
    )
    return F.struct(*[p.alias(f"c{k}") for k, p in enumerate(parts)]).cast(COMPONENT)


def _exploded(rows: DataFrame, parts: Column) -> DataFrame:
    return rows.select("profile_id", F.explode(parts).alias("c")).select("profile_id", "c.*").where("text <> ''")


def of_gallery_profiles(profiles: DataFrame) -> DataFrame:
    """Profiles of a gallery site (bio, journal, commission_status, last_updated,
    items array of title, description, tags, event_time, url).

    The status unknown is empty, journal and undated items take the profile's
    time, and there is no display name among the components.
    """
    when = F.col("last_updated")
    items = F.transform("items", lambda i, k: _row("gallery", item_text(i["title"], i["description"], i["tags"]), k, F.coalesce(i["event_time"], when), present=F.lit(True), url=i["url"]))
    stated = F.when(F.col("commission_status") == "unknown", "").otherwise(F.col("commission_status"))
    return _exploded(profiles, F.concat(F.array(_row("bio", F.col("bio")), _row("commission_status", stated), _row("journal", F.col("journal"), when=when, present=F.lit(True))), items))


def of_feed_profiles(profiles: DataFrame) -> DataFrame:
    """Profiles of a feed site (display_name, bio, pinned_uri, posts array of uri,
    text, created_at, url, like_count, repost_count, reply_count); a post is pinned by its address."""
    posts = F.transform(
        "posts",
        lambda p, k: _row("post", p["text"], k, p["created_at"], F.coalesce(p["uri"] == F.col("pinned_uri"), F.lit(False)), p["created_at"].isNotNull(), p["url"], p["like_count"], p["repost_count"], p["reply_count"]),
    )
    return _exploded(profiles, F.concat(F.array(_row("display_name", F.col("display_name")), _row("bio", F.col("bio"))), posts))


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def platform_info(platform: Column) -> Column:
    """struct(name, colour, base_url); an unknown platform is its own name."""
    name, colour, base = (F.try_element_at(_map({k: v[n] for k, v in PLATFORMS.items()}), platform) for n in range(3))
    return F.struct(F.coalesce(name, platform).alias("name"), F.coalesce(colour, F.lit(OTHER_COLOUR)).alias("colour"), F.coalesce(base, F.lit(OTHER_ADDRESS)).alias("base_url"))


def status_label(status: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(STATUS_LABELS), status), F.lit(STATUS_LABELS["unclear"]))


def enabled(platforms: Column) -> Column:
    """Keys of a map of switches that are on, in the order of the map."""
    return F.map_keys(F.map_filter(platforms, lambda _, on: F.coalesce(on, F.lit(False))))


def resumed(items: Column, last: Column) -> Column:
    """The list from the last handled item on, that one included; whole if it isn't there."""
    at = F.coalesce(F.array_position(items, last), F.lit(0)).cast("int")
    return F.slice(items, F.greatest(at, F.lit(1)), F.greatest(F.size(items), F.lit(1)))


def originals(found: DataFrame, rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows found by a search with columns of their originals; the first original
    counts, and a row without one keeps its own values."""
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*columns), "seq").alias("original"))
    out = found.join(first, keys, "left")
    return out.withColumns({c: F.coalesce(f"original.{c}", c) for c in columns}).drop("original")
