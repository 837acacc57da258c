"""Extraction of profiles, lists and galleries from landed HTML pages.

Pages are rows (url, html).  Links are pulled out with built-in regular expressions;
everything else goes through one Arrow pass a page, in which selectors run over the
markup's events: nested elements, references and unclosed tags are read as browsers
read them.  A page whose html is null couldn't be fetched.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .select import find, inside

JOURNAL_LIMIT, DESCRIPTION_LIMIT, GALLERY_LIMIT, LAST_PAGE = 5000, 1000, 10, 10


def per_page(pages: DataFrame, keep: list[str], read: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """Columns ``keep`` of each page with the rows (of texts, lists of texts and ints) that ``read`` makes of its html; pages without html have none."""
    fields = [f for f in pages.schema.fields if f.name in keep]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    names = [f.name for f in fields]
    columns = [c.split()[0] for c in schema.split(",")]
    types = {"int": pa.int32(), "array<string>": pa.list_(pa.string())}
    kinds = [types.get(c.split()[1], pa.string()) for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[] if html is None else read(html) for html in batch.column("html").to_pylist()]
            places = pa.array([n for n, rows in enumerate(found) for _ in rows], pa.int64())
            rows = [r for some in found for r in some]
            if rows:
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(places) for c in names], *[pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]], [*names, *columns])

    return pages.select(*names, "html").mapInArrow(run, f"{kept}, {schema}")


def _user(match: object) -> str | None:
    found = re.search("/user/([^/]+)", match.attributes.get("href", "")) if match else None
    return found[1] if found else None


def _numbered(names: list[str | None]) -> list[tuple[int, str]]:
    return list(enumerate(dict.fromkeys(n for n in names if n)))


def links(pages: DataFrame, pattern: str, html: str = "html") -> DataFrame:
    """Distinct captures of a pattern per page, in order of appearance:
    the page's columns but the html, pos and link."""
    rest = [c for c in pages.columns if c != html]
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(pattern), F.lit(1)))
    return pages.select(*rest, F.posexplode(found).alias("pos", "link"))


def favourites_page(pages: DataFrame) -> DataFrame:
    """Artists of a favourites page: the first link in the third paragraph of each figure's label."""

    def read(html: str) -> list[tuple]:
        got = find(html, {"figure": 'section figure[id^="sid-"]', "link": "figcaption label p:nth-child(3) a"})
        return _numbered([_user(next(iter(inside(f, got["link"])), None)) for f in got["figure"]])

    return per_page(pages, ["page"], read, "pos int, username string")


def watchlist_page(pages: DataFrame) -> DataFrame:
    """Artists of a watchlist page: user links inside its items, however deep."""

    def read(html: str) -> list[tuple]:
        return _numbered([_user(m) for m in find(html, {"link": '.flex-watchlist .flex-item-watchlist a[href^="/user/"]'})["link"]])

    return per_page(pages, ["page"], read, "pos int, username string")


def scanned_lists(favourites: DataFrame, watchlist: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both lists of pages (page, html) as one, and (list, errors).

    A page that couldn't be fetched ends its list, is counted as its error if the
    list has come as far, and doesn't touch the other list.
    """
    rows = [favourites_page(favourites), watchlist_page(watchlist)]
    errors = []
    for number, (pages, found) in enumerate(zip((favourites, watchlist), rows, strict=True)):
        last = _bounded(found, number).agg(F.max("page").alias("last"))
        lost = pages.where("html is null").select("page").crossJoin(F.broadcast(last)).where(F.col("page") == F.coalesce(F.col("last") + 1, F.lit(number)))  # one row on the right
        errors.append(lost.agg(F.lit(number).alias("list"), F.count_distinct("page").alias("errors")))
    return two_lists(*rows), errors[0].unionByName(errors[1])


def _bounded(rows: DataFrame, number: int) -> DataFrame:
    """Rows of a list up to its end, with its number; favourites count from page 0, the watchlist from 1."""
    rows = rows.where(F.col("page") <= LAST_PAGE)
    first = rows.groupBy("username").agg(F.min("page").alias("page"))
    new = first.groupBy("page").agg(F.count("*").alias("n"))  # at most 11 pages
    last = new.select("page", (F.col("page") - F.row_number().over(Window.orderBy("page"))).alias("gap")).where(F.col("gap") == number - 1).agg(F.max("page").alias("last"))
    return rows.crossJoin(F.broadcast(last)).where("page <= last").drop("last").withColumn("list", F.lit(number))


def two_lists(favourites: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Union of both lists (list, page, pos, username): first place of each name.

    A list ends before an empty page, before a page without a name new to it, and
    after page 10, favourites counting from 0 and the watchlist from 1.
    """
    both = _bounded(favourites, 0).unionByName(_bounded(watchlist, 1))
    return both.groupBy("username").agg(F.min(F.struct("list", "page", "pos")).alias("p")).select("p.*", "username")


def stated_status(row_text: Column) -> Column:
    """Text of the row on accepting work: Yes, then No, case-sensitive."""
    return F.when(F.contains(row_text, F.lit("Yes")), "open").when(F.contains(row_text, F.lit("No")), "closed").otherwise("unknown")


_PROFILE = {
    "avatar": "userpage-nav-avatar img", "name": "span.js-displayName", "bio": ".userpage-profile.section-body", "row": ".table-row", "question": ".table-row .userpage-profile-question",
    "journal": ".user-submitted-links",
}


def profile_pages(pages: DataFrame) -> DataFrame:
    """(url, username, display_name, avatar_url, bio, journal, commission_status) of profile pages.

    Texts are trimmed; bio and journal are empty where a page has none.  A page that
    couldn't be fetched gives nulls and the status unknown.
    """

    def read(html: str) -> list[tuple]:
        got = find(html, _PROFILE, raw_text=True)
        text = lambda name: got[name][0].text.strip() if got[name] else ""
        asked = next((r for r in got["row"] if any("Accepting Commissions" in q.text for q in inside(r, got["question"]))), None)
        avatar = got["avatar"][0].attributes.get("src") if got["avatar"] else None
        return [(text("name"), "https:" + avatar if avatar and avatar.startswith("//") else avatar, text("bio"), text("journal")[:JOURNAL_LIMIT], asked.text if asked else None)]

    schema = "shown string, avatar_url string, bio string, journal string, accepting string"
    read_pages = per_page(pages.where("html is not null"), ["url"], read, schema)
    none = [F.lit(None).cast("string").alias(c) for c in ("shown", "avatar_url", "bio", "journal", "accepting")]
    rows = read_pages.unionByName(pages.where("html is null").select("url", *none))
    user = F.nullif(F.regexp_extract("url", "/user/([^/?#]+)", 1), F.lit(""))
    return rows.select(
        "url", user.alias("username"), F.coalesce(F.nullif("shown", F.lit("")), user).alias("display_name"), "avatar_url", "bio", "journal", stated_status(F.coalesce("accepting", F.lit(""))).alias("commission_status"),
    )


SUBMISSIONS = "map<string,struct<title:string,date_full:string,date_fuzzy:string,username:string,lower:string,icon_rating:string>>"


def submissions(json_text: Column) -> Column:
    """Metadata of submissions by id; bad JSON gives an empty map."""
    return F.coalesce(F.from_json(json_text, SUBMISSIONS), F.create_map().cast(SUBMISSIONS))


def gallery(pages: DataFrame, base_url: str) -> DataFrame:
    """Of the first ten figures of a page's latest submissions, those with an image that has tags, be they empty:
    (url, pos, id, title, tags, date_raw, event_time, item_url)."""

    def read(html: str) -> list[tuple]:
        got = find(html, {"data": "#js-submissionData", "part": "#gallery-latest-submissions", "figure": 'figure[id^="sid-"]', "image": "img[data-tags]", "link": "a"}, raw_text=True)
        figures = inside(got["part"][0], got["figure"])[:GALLERY_LIMIT] if got["part"] else []
        data = got["data"][0].text if got["data"] else None
        ids, tags, hrefs = [], [], []
        for f in figures:
            images, links = inside(f, got["image"]), inside(f, got["link"])
            if images:
                ids.append(f.attributes["id"].replace("sid-", "", 1))
                tags.append(images[0].attributes["data-tags"])
                hrefs.append(links[0].attributes.get("href", "") if links else "")
        return [(ids, tags, hrefs, got["data"][0].text if got["data"] else None)] if ids else []

    # the metadata of a page is parsed once, before its items part
    whole = per_page(pages, ["url"], read, "ids array<string>, tags array<string>, hrefs array<string>, data string")
    parsed = whole.select("url", submissions(F.col("data")).alias("known"), "ids", "tags", "hrefs")
    items = parsed.select("url", "known", F.posexplode(F.arrays_zip("ids", "tags", "hrefs")).alias("pos", "item"))
    rows = items.select("url", "pos", F.col("item.ids").alias("id"), F.col("item.tags").alias("tags"), F.col("item.hrefs").alias("href"), F.try_element_at("known", F.col("item.ids")).alias("meta"))
    date = F.nullif("meta.date_full", F.lit(""))
    item_url = F.when(F.startswith("href", F.lit("/")), F.concat(F.lit(base_url), "href")).otherwise(F.col("href"))
    return rows.select("url", "pos", "id", F.coalesce("meta.title", F.lit("")).alias("title"), "tags", date.alias("date_raw"), F.try_to_timestamp(date, F.lit("MMM d, yyyy hh:mm a")).alias("event_time"), item_url.alias("item_url"))


def submission_pages(pages: DataFrame) -> DataFrame:
    """(item_url, title, tags, description, event_time) of submissions' own pages (item_url, html)."""

    def read(html: str) -> list[tuple]:
        got = find(html, {"title": "div.submission-title h2 p", "date": "span.popup_date", "description": "div.submission-description", "tag": "section.tags-row a"}, raw_text=True)
        text = lambda name: got[name][0].text.strip() if got[name] else ""
        return [(text("title"), ", ".join(m.text.strip() for m in got["tag"]), text("description")[:DESCRIPTION_LIMIT], got["date"][0].attributes.get("title", "") if got["date"] else "")]

    rows = per_page(pages, ["item_url"], read, "title string, tags string, description string, date_raw string")
    return rows.select("item_url", "title", "tags", "description", F.try_to_timestamp("date_raw", F.lit("MMM d, yyyy hh:mm a")).alias("event_time"))


def enriched(items: DataFrame, details: DataFrame) -> DataFrame:
    """Items whose list has under ten get title, date, tags and description of the
    first min(10 - n, 3) from their own pages, where those were read."""
    n = F.count("*").over(Window.partitionBy("profile_id"))
    wanted = (F.col("n") < GALLERY_LIMIT) & (F.col("pos") < F.least(F.lit(GALLERY_LIMIT) - F.col("n"), F.lit(3)))
    new = details.select(F.col("item_url").alias("item_url"), *[F.col(c).alias(f"new_{c}") for c in ("title", "tags", "description", "event_time")], F.lit(True).alias("read"))
    joined = items.withColumn("n", n).join(new, "item_url", "left").withColumn("use", wanted & F.coalesce("read", F.lit(False)))
    pick = lambda c: F.when(F.col("use"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
    described = F.when(F.col("use"), F.substring("new_description", 1, DESCRIPTION_LIMIT)).alias("description")
    return joined.select("profile_id", "pos", "item_url", pick("title"), pick("tags"), described, pick("event_time"))
