"""Main text of web pages by template deduction over equivalence classes.

Pages of one host come from few templates.  A token is an element, told apart by
its path with classes, or a block of text with its path.  Tokens with the same
occurrence vector over a host's pages form an equivalence class.  The vector is
kept as two sums over pages of count times a hash of the page, which tasks add up
for themselves before anything is shuffled, so a hot host is no hot group.  Classes that hold an element and occur on at least half of
the host's pages and on ``LEAST`` different ones are candidates.  A second pass
keeps those that are ordered (their tokens follow each other alike on every page)
and nested (all inside one slot of the root class, the same on every page): the
template.  What remains are slots.

Extraction keeps the slots of the article: blocks inside ``article`` or ``main``
where the page has one, else blocks of slots that aren't mostly links; never
blocks of the template itself nor slots of elements that by their tag, role,
class or id are menus, headers, footers, sidebars, notices, adverts, forms or
comments.  A host with fewer different pages has no template, and slots alone
decide.

Templates are joined to pages by host: as a broadcast when their rows were
counted up to ``BROADCAST_HOSTS``, else by a shuffle that adaptive execution
splits at hot hosts.

Edge cases: null html and empty pages give an empty text; a null URL or one
without a host belongs to the host ''; repeated rows and copies are pages of their
own but count once for ``LEAST``; text outside elements is a slot; very long
pages are read whole; elements nested deeper than ``DEPTH`` lie beside each other; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.sources.markup import INLINE, RAW, VOID, attributes, events, explicit_end, implied_end

from .shared import materialise, slices, small_batches, tidy

#: Different pages on which a token must occur, and the share of the host's pages.
LEAST, SHARE = 8, 0.5
#: Share of a slot's characters inside links from which it is a list of links.
LINKS = 0.5
#: Hosts with a template, of some kilobytes each, up to which templates are broadcast.
BROADCAST_HOSTS = 4096

# Words of tags, roles, classes and ids by what they mark.
DROPPED_TAGS = RAW | frozenset("head title nav footer aside form button select option textarea noscript template dialog menu canvas svg object audio video map datalist fieldset".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
DROPPED_WORDS = frozenset("""ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner menu menus nav navbar navigation
breadcrumb breadcrumbs sidebar sidebars aside widget widgets footer masthead topbar cookie cookies consent gdpr notice notices notification alert popup modal overlay
newsletter subscribe subscription signup share sharing social related recommended recommendations comment comments discussion disqus reply replies respond
pagination pager login search toolbar""".split())
MAIN_TAGS, OWN_TAGS = frozenset(("article", "main")), frozenset(("html", "body", "article", "main"))
MASK = (1 << 63) - 1
#: Open elements; deeper ones lie beside each other, as in browsers.
DEPTH = 512


class Block(NamedTuple):
    slot: int
    text: str
    token: int
    links: int
    main: bool


@lru_cache(maxsize=4096)
def _judge(tag: str, raw: str) -> tuple[int, bool, bool]:
    """Hash of the element's kind, whether it is boilerplate, whether it is the main part."""
    own = attributes(raw) if raw else {}
    names = sorted(set((own.get("class") or "").lower().split()))
    kind = xxhash.xxh64_intdigest(f"{tag}.{'.'.join(re.sub('[0-9]+', '0', n) for n in names)}") & MASK
    role = (own.get("role") or "").lower()
    main = tag in MAIN_TAGS or role == "main"
    hidden = "hidden" in own or own.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", own.get("style") or "", re.I))
    words = {w for n in (*names, (own.get("id") or "").lower()) for w in re.split("[^a-z0-9]+", re.sub("[0-9]+$", "", n))} if tag not in ("html", "body") else set()
    dropped = hidden or tag in DROPPED_TAGS or role in DROPPED_ROLES or bool(words & DROPPED_WORDS) or ("header" in words and not words & {"article", "entry", "post", "content", "title"})
    return kind, dropped, main


def read_page(html: str) -> tuple[list[int], list[Block]]:
    """Tokens in page order (elements even, blocks of text odd), and the blocks outside dropped elements."""
    tags: list[str] = []
    frames: list[tuple[int, bool, bool, bool]] = [(0, False, False, False)]  # path, dropped, main, inside a link
    order: list[int] = []
    found: list[Block] = []
    pieces: list[str] = []
    links, at = 0, frames[0]

    def flush() -> None:
        nonlocal links
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            token = (at[0] * 31 + xxhash.xxh64_intdigest(text)) & MASK | 1
            order.append(token)
            found.append(Block(at[0], text, token, min(links, len(text)), at[2]))
        links = 0

    for kind, tag, raw in events(html):
        if kind == "text":
            frame = frames[-1]
            if not frame[1]:
                if not pieces:
                    at = frame
                pieces.append(raw)
                if frame[3]:
                    links += len(raw)
            continue
        inline = tag in INLINE
        if pieces and not inline:
            flush()
        length = explicit_end(tags, tag) if kind == "end" else implied_end(tags, tag)
        if length < len(tags):
            del tags[length:], frames[length + 1 :]
        if kind == "start":
            path, dropped, main, linked = frames[-1]
            own, bad, is_main = _judge(tag, raw)
            if tag == "header" and not main:
                bad = True
            if not inline:
                path = ((path ^ own) * 0x9E3779B97F4A7C15 + own) & MASK & ~1
                order.append(path)
            if tag not in VOID and len(tags) < DEPTH:
                tags.append(tag)
                frames.append((path, dropped or bad, main or is_main, linked or tag == "a"))
    if pieces:
        flush()
    return order, found


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


READ = "page_id long, url string, host string, page long, tokens array<long>, times array<long>, in_order array<long>, blocks array<struct<slot:long,text:string,token:long,links:long,main:boolean>>"


def _lists(rows: list[list], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array([x for r in rows for x in r], kind))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "host", "page", "tokens", "times", "in_order", "blocks"]
    for batch in slices(batches, "html", 4 << 20):
        orders, blocks, pages = [], [], []
        for html in batch.column("html").to_pylist():
            order, found = read_page(html or "")
            orders.append(order)
            blocks.append(found)
            pages.append(xxhash.xxh64_intdigest(html or "") & MASK)
        counts = [Counter(o) for o in orders]
        fields = [pa.array([x for found in blocks for x in (b[k] for b in found)], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()))]
        ends = np.concatenate(([0], np.cumsum([len(found) for found in blocks]))).astype(np.int32)
        listed = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, ["slot", "text", "token", "links", "main"]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), batch.column("host"), pa.array(pages, pa.int64()), _lists([list(c) for c in counts], pa.int64()), _lists([list(c.values()) for c in counts], pa.int64()), _lists(orders, pa.int64()), listed],
            names=names,
        )


# ----------------------------------------------------------------- template


def candidates(pages: DataFrame) -> DataFrame:
    """(host, tokens of (token, class), lists: slots that are mostly links) from pages as read.

    Class 0 is the root class, whose tokens occur once on every page.
    """
    low, high = F.col("page").bitwiseAND(F.lit(0x7FFFFFFF)), F.shiftright("page", 33)
    bit = F.expr("shiftleft(1L, cast(page % 62 as int))").alias("bit")
    own = [F.xxhash64("host").alias("h"), low.alias("low"), high.alias("high"), bit]
    seen = pages.select(*own, F.explode(F.arrays_zip("tokens", "times")).alias("t")).select("h", "t.tokens", "t.times", "low", "high", "bit")
    whole = pages.select(*own).select("h", F.lit(-2).cast("long").alias("tokens"), F.lit(1).cast("long").alias("times"), "low", "high", "bit")
    counted = seen.unionByName(whole).groupBy("h", F.col("tokens").alias("token")).agg(F.count("*").alias("pages"), F.sum(F.col("times") * F.col("low")).alias("sig1"), F.sum(F.col("times") * F.col("high")).alias("sig2"), F.bit_or("bit").alias("mask"))
    often = materialise(counted.where(f"bit_count(mask) >= {LEAST}"), "tokens")
    root = often.where("token = -2").select("h", F.col("pages").alias("all_pages"), F.col("sig1").alias("root1"), F.col("sig2").alias("root2"))
    kept = often.where("token <> -2").join(root, "h").where(F.col("pages") >= SHARE * F.col("all_pages"))
    element = F.col("token") % 2 == 0
    structural = kept.where(element).groupBy("h", "sig1", "sig2").agg(F.lit(True).alias("structural"))
    cls = F.when((F.col("sig1") == F.col("root1")) & (F.col("sig2") == F.col("root2")), F.lit(0)).otherwise(F.xxhash64("sig1", "sig2")).alias("class")
    classes = kept.join(structural, ["h", "sig1", "sig2"]).select("h", "token", cls)
    filled = pages.select(F.xxhash64("host").alias("h"), F.explode("blocks").alias("b")).groupBy("h", F.col("b.slot").alias("token")).agg(F.sum(F.char_length("b.text")).alias("chars"), F.sum("b.links").alias("links"))
    lists = kept.where(element).join(filled.where(F.col("links") >= LINKS * F.col("chars")), ["h", "token"]).groupBy("h").agg(F.collect_list("token").alias("lists"))
    # a token on half of the pages: a host has at most the tokens of two pages here
    return classes.groupBy("h").agg(F.collect_list(F.struct("token", "class")).alias("tokens")).join(lists, "h", "left")


VALID = "h long, class long, low long, high long, slot_low long, slot_high long"


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each class: the order of its tokens on a page, and the slot of the root class that holds them."""
    for batch in batches:
        span: dict[tuple[int, int], list[int]] = {}
        for h, seen, tokens in zip(*(batch.column(c).to_pylist() for c in ("h", "in_order", "tokens")), strict=True):
            of = {t["token"]: t["class"] for t in tokens}
            orders: dict[int, list[int]] = {}
            slots: dict[int, list[int]] = {}
            passed = 0
            for t in seen:
                c = of.get(t)
                if c is None:
                    continue
                orders.setdefault(c, []).append(t)
                if c == 0:
                    passed += 1
                else:
                    slots.setdefault(c, []).append(passed)
            for c, own in orders.items():
                # repeats of the class follow each other as its first round does
                rounds = len(own) // len(set(own))
                digest = xxhash.xxh64_intdigest(np.array(own[: len(own) // rounds], np.int64).tobytes()) & MASK if own == own[: len(own) // rounds] * rounds else -len(own)
                at = slots.get(c, [0])
                now = span.setdefault((h, c), [digest, digest, min(at), max(at)])
                now[:] = min(now[0], digest), max(now[1], digest), min(now[2], *at), max(now[3], *at)
        columns = list(zip(*((h, c, *v) for (h, c), v in span.items()), strict=True))
        if columns:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["h", "class", "low", "high", "slot_low", "slot_high"])


def with_templates(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """Pages (host) with the columns of their host's template (h), null where there is none."""
    small = templates.count() <= BROADCAST_HOSTS
    return pages.withColumn("h", F.xxhash64("host")).join(F.broadcast(templates) if small else templates, "h", "left")


def deduce(pages: DataFrame) -> DataFrame:
    """(h, fixed: blocks of text of the template, lists: slots of links) of each host that has a template."""
    with tidy(pages.sparkSession):
        found = materialise(candidates(pages), "classes")
        seen = with_templates(pages.select("host", "in_order"), found.select("h", "tokens")).where("tokens is not null").select("h", "in_order", "tokens")
        agree = seen.mapInArrow(_orders, VALID).groupBy("h", "class").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("slot_low").alias("slot_low"), F.max("slot_high").alias("slot_high"))
        valid = agree.where("low = high and low >= 0 and slot_low = slot_high").select("h", "class")
        tokens = found.select("h", F.explode("tokens").alias("t")).select("h", "t.token", "t.class").where("token % 2 = 1")
        fixed = tokens.join(valid, ["h", "class"]).groupBy("h").agg(F.collect_list("token").alias("fixed"))
        return materialise(found.select("h", "lists").join(fixed, "h", "left"), "templates", keep=True)


# ---------------------------------------------------------------- extraction


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page (page_id, url, html).

    Pages are read once into a table of tokens and blocks in the shared folder,
    from which templates are deduced and texts put together.
    """
    small_batches(pages.sparkSession)
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host(url).alias("host"), F.col("html").cast("string").alias("html"))
    read = materialise(rows.mapInArrow(_read, READ), "pages-read")
    joined = with_templates(read, deduce(read)).select("page_id", "url", "blocks", *[F.coalesce(c, F.array().cast("array<long>")).alias(c) for c in ("fixed", "lists")])
    main = F.exists("blocks", lambda b: b["main"])
    open_ = F.filter("blocks", lambda b: F.when(main, b["main"]).otherwise(~F.array_contains("lists", b["slot"])) & ~F.array_contains("fixed", b["token"]))
    text = F.array_join(F.transform(open_, lambda b: b["text"]), " ")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
