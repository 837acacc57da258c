"""Exact ranked search over dual-sorted inverted lists in wavelet trees.

An index shard holds whole documents of one input partition, numbered in order
of doc_id.  Its inverted lists stand behind each other, each by falling impact
of the term in the document, and the sequence of document numbers is kept as a
wavelet tree (as a matrix of bit rows with counts): a list is a range of the
root, and going down to a child maps a range in constant time without changing
the order of impacts.  So the first posting of a term's range bounds what the
term adds to any document below the node, while nodes are ranges of doc_id.

A query starts at the root with the ranges of its terms.  Nodes are opened best
bound first, a few dozen of each query in one step of array operations; a leaf's
bound is its document's score.  Nodes below the score of the k-th best document
so far are dropped; at an equal score those whose smallest doc_id comes later
are dropped, too, so thousands of equal copies cost what k do.  A task keeps the
best documents of a query from shard to shard, so later shards start with a high
bar.  The best k of each task meet in two windows, the first salted.

Impacts depend on the corpus (mean length, number of documents), which one pass
counts first; weights of terms come from the lengths of their lists.  Queries are
taken in blocks of bounded bytes, against the whole index.

Edge cases: null texts and texts without a term are no documents and, as items,
have no rows; a null doc_id comes last among equal scores; repeated rows are
documents of their own; repeated items each get their rows; very long texts are
whole in a shard of their own; empty tables give an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import bytes_of, claim, encode_dictionary, materialise, scratch, slices, small_batches, split_words, tidy

#: Text bytes and documents of an index shard.
SHARD_BYTES, SHARD_DOCS = 8 << 20, 1 << 16
#: Text bytes of a block of queries, and how many of it are searched together.
BLOCK_BYTES, TOGETHER = 8 << 20, 32
#: Nodes of a query opened in one step.
STEP = 48
SALTS = 64
SHARD = "docs array<long>, levels int, zeros array<int>, bits binary, impacts binary, terms array<string>, starts binary"
SHARD_ARROW = pa.schema([("docs", pa.list_(pa.int64())), ("levels", pa.int32()), ("zeros", pa.list_(pa.int32())), ("bits", pa.binary()), ("impacts", pa.binary()), ("terms", pa.list_(pa.string())), ("starts", pa.binary())])

# Bytes outside terms become blanks, A-Z become a-z; UTF-8 beyond ASCII stays.
_FOLD = np.array([b if b > 127 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256)], dtype=np.uint8)
_ONES = np.array([bin(b).count("1") for b in range(256)], dtype=np.int64)
_BEFORE = np.array([(0xFF << (8 - k)) & 0xFF for k in range(8)], dtype=np.uint8)


def terms_of(text: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets of each text's terms, and the flat terms."""
    at, raw = bytes_of(text)
    folded = pa.LargeStringArray.from_buffers(len(text), pa.py_buffer(np.ascontiguousarray(at)), pa.py_buffer(_FOLD[raw[: at[-1]]]))
    return split_words(folded)


# --------------------------------------------------------------------- index


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = total = 0
    for batch in slices(batches, "text"):
        at, raw = bytes_of(batch.column("text"))
        inside = _FOLD[raw] != 32
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        first[at[:-1][at[:-1] < len(raw)]] = inside[at[:-1][at[:-1] < len(raw)]]
        begins = np.concatenate(([0], np.cumsum(first)))
        n = np.diff(begins[at])
        docs, total = docs + int((n > 0).sum()), total + int(n.sum())
    yield pa.RecordBatch.from_pydict({"docs": pa.array([docs], pa.int64()), "total": pa.array([total], pa.int64())})


def corpus_counts(documents: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all terms with repeats."""
    row = documents.select("text").mapInArrow(_count, "docs long, total long").agg(F.sum("docs").alias("docs"), F.sum("total").alias("total")).first()
    return int(row["docs"] or 0), int(row["total"] or 0)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def build_shard(ids: pa.Array, text: pa.Array, n_docs: int, n_terms: int) -> dict | None:
    """The dual-sorted lists of some documents as one row."""
    order = pc.sort_indices(ids, null_placement="at_end")
    ids, text = ids.take(order), text.take(order)
    offsets, flat = terms_of(text)
    n = np.diff(offsets)
    if not len(flat):
        return None
    full = np.flatnonzero(n)
    lengths, docs = n[full], len(full)
    m = np.array([75 + 25 * int(x) * n_docs // n_terms for x in lengths], dtype=np.int64)
    codes, words = encode_dictionary(flat)
    ranks = np.empty(len(words), np.int64)
    by_name = pc.sort_indices(words)
    ranks[by_name.to_numpy()] = np.arange(len(words))
    pairs, tf = np.unique(ranks[codes] * docs + np.repeat(np.arange(docs), lengths), return_counts=True)
    term, doc = np.divmod(pairs, docs)
    worth = impact(tf.astype(np.int64), m[doc])
    order = np.argsort((term << 20) | ((1 << 20) - 1 - worth), kind="stable")
    seq, worth = doc[order], worth[order]
    starts = np.searchsorted(term, np.arange(len(words) + 1))
    levels, zeros, bits = max(1, int(docs - 1).bit_length()), [], []
    for level in range(levels):
        one = (seq >> (levels - 1 - level)) & 1 == 1
        bits.append(np.packbits(one).tobytes())
        seq = np.concatenate((seq[~one], seq[one]))
        zeros.append(int((~one).sum()))
    return {"docs": ids.take(pa.array(full)), "levels": levels, "zeros": zeros, "bits": b"".join(bits), "impacts": worth.astype(np.int32).tobytes(), "terms": words.take(by_name).cast(pa.string()), "starts": starts.astype(np.int32).tobytes()}


def _build(n_docs: int, n_terms: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def row(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pa.Table.from_batches(held).combine_chunks()
        made = build_shard(both.column("doc_id").combine_chunks(), both.column("text").cast(pa.large_string()).combine_chunks(), n_docs, n_terms)
        if made:
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(v)], v) if isinstance(v, pa.Array) else pa.array([v], f.type) for v, f in zip(made.values(), SHARD_ARROW, strict=True)], schema=SHARD_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, rows = [], 0, 0
        for batch in slices(batches, "text", SHARD_BYTES // 2):
            held.append(batch)
            size += pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
            rows += batch.num_rows
            if size >= SHARD_BYTES or rows >= SHARD_DOCS:
                yield from row(held)
                held, size, rows = [], 0, 0
        if held:
            yield from row(held)

    return run


class Index(NamedTuple):
    shards: DataFrame
    docs: int
    terms: int


def build_index(documents: DataFrame) -> Index:
    """Index of all documents (doc_id, text) as a table of shards in the shared folder."""
    spark = documents.sparkSession
    small_batches(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_docs, n_terms = corpus_counts(docs)
    path = scratch(spark, "lists", temporary=True)
    # rows are a few megabytes, so the writer looks at its memory after each
    docs.mapInArrow(_build(n_docs, n_terms), SHARD).write.option("parquet.page.size.row.check.min", "1").option("parquet.page.size.row.check.max", "4").parquet(path)
    return Index(spark.read.schema(SHARD).parquet(path), n_docs, n_terms)


# -------------------------------------------------------------------- search


class Query(NamedTuple):
    row: int
    item_id: object
    terms: list[str]
    weights: list[int]


class Best:
    """The k best documents of each query so far: highest score, then smallest id, null ids last."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.found: list[list[tuple[int, bool, int]]] = [[] for _ in range(queries)]  # (-score, id is null, id)
        self.score = np.zeros(queries, np.int64)
        self.doc = np.full(queries, np.iinfo(np.int64).max)

    def add(self, q: int, scores: list[int], docs: list[int | None]) -> None:
        both = self.found[q] + [(-s, d is None, d or 0) for s, d in zip(scores, docs, strict=True)]
        self.found[q] = both = sorted(both)[: self.k]
        if len(both) == self.k:
            s, null, d = both[-1]
            self.score[q], self.doc[q] = -s, np.iinfo(np.int64).max if null else d


class Shard:
    """An opened shard: bit rows with counts, and the impacts in the order of every level."""

    def __init__(self, row: dict) -> None:
        self.levels, self.zeros = row["levels"], np.array(row["zeros"], np.int64)
        worth = np.frombuffer(row["impacts"], np.int32)
        bits = np.frombuffer(row["bits"], np.uint8).reshape(self.levels, -1)
        self.stride = bits.shape[1] + 1
        self.bits = np.concatenate((bits, np.zeros((self.levels, 1), np.uint8)), axis=1).ravel()
        counts = np.zeros((self.levels, self.stride), np.int32)
        np.cumsum(_ONES[bits], axis=1, out=counts[:, 1:])
        self.counts, self.size = counts.ravel(), len(worth)
        by_level = [worth]
        for level in range(self.levels):
            one = np.unpackbits(bits[level], count=len(worth)).astype(bool)
            by_level.append(np.concatenate((by_level[-1][~one], by_level[-1][one])))
        self.impacts = np.concatenate(by_level)
        self.docs: pa.Array = row["docs"]
        self.ids = pc.fill_null(self.docs, np.iinfo(np.int64).max).to_numpy()
        self.starts = np.frombuffer(row["starts"], np.int32).astype(np.int64)
        self.terms: pa.Array = row["terms"]

    def ones(self, level: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ones before a place of a level's bit row."""
        byte = level * self.stride + (at >> 3)
        return self.counts[byte] + _ONES[self.bits[byte] & _BEFORE[at & 7]]

    def search(self, queries: list[Query], first: int, best: Best) -> int:
        """Put this shard's documents among the best of queries[first : first + TOGETHER]; the nodes opened."""
        some = queries[first : first + TOGETHER]
        names = pa.array([t for q in some for t in q.terms], pa.string())
        place = pc.fill_null(pc.index_in(names, self.terms), -1).to_numpy()
        number = np.repeat(np.arange(first, first + len(some)), [len(q.terms) for q in some])
        weight = np.array([w for q in some for w in q.weights], np.int64)
        here = (place >= 0) & (weight > 0)
        place, number, weight = place[here], number[here], weight[here]
        # entries are nodes of a query; pairs are the ranges of its terms there, entry after entry
        owner, size = np.unique(number, return_counts=True)
        level, node = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64)
        left, right = self.starts[place], self.starts[place + 1]
        bound = np.add.reduceat(weight * self.impacts[left], np.concatenate(([0], np.cumsum(size)[:-1]))) if len(owner) else np.zeros(0, np.int64)
        opened = 0
        while True:
            low = self.ids[np.minimum(node << (self.levels - level), len(self.ids) - 1)]
            keep = (bound > 0) & ((bound > best.score[owner]) | ((bound == best.score[owner]) & (low <= best.doc[owner])))
            if not keep.any():
                return opened
            order = np.lexsort((low, -bound, owner))
            order = order[keep[order]]
            begin = np.flatnonzero(np.concatenate(([True], owner[order][1:] != owner[order][:-1])))
            nth = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
            chosen = np.zeros(len(owner), bool)
            chosen[order[nth < STEP]] = True
            stay = keep & ~chosen
            opened += int(chosen.sum())
            mine, rest = np.repeat(chosen, size), np.repeat(stay, size)
            # both children of the chosen nodes
            entry = np.repeat(np.arange(int(chosen.sum())), size[chosen])
            lv = level[chosen][entry]
            l, r, w = left[mine], right[mine], weight[mine]  # noqa: E741
            l1, r1 = self.ones(lv, l), self.ones(lv, r)
            zero = self.zeros[lv]
            child = np.concatenate((2 * entry, 2 * entry + 1))
            cl, cr, cw, lv = np.concatenate((l - l1, zero + l1)), np.concatenate((r - r1, zero + r1)), np.concatenate((w, w)), np.concatenate((lv, lv)) + 1
            inside = np.flatnonzero(cr > cl)
            inside = inside[np.argsort(child[inside], kind="stable")]
            child, cl, cr, cw, lv = child[inside], cl[inside], cr[inside], cw[inside], lv[inside]
            made, at, csize = np.unique(child, return_index=True, return_counts=True)
            cbound = np.add.reduceat(cw * self.impacts[lv * self.size + cl], at) if len(made) else np.zeros(0, np.int64)
            cowner, clevel, cnode = owner[chosen][made >> 1], level[chosen][made >> 1] + 1, 2 * node[chosen][made >> 1] + (made & 1)
            leaf = clevel == self.levels
            if leaf.any():
                good = np.flatnonzero(leaf & (cbound > 0))
                for q in np.unique(cowner[good]).tolist():
                    at_q = good[cowner[good] == q]
                    best.add(q, cbound[at_q].tolist(), self.docs.take(pa.array(cnode[at_q])).to_pylist())
            inner = np.repeat(~leaf, csize)
            owner, level, node, bound = (np.concatenate((x[stay], y[~leaf])) for x, y in ((owner, cowner), (level, clevel), (node, cnode), (bound, cbound)))
            left, right, weight = (np.concatenate((x[rest], y[inner])) for x, y in ((left, cl), (right, cr), (weight, cw)))
            size = np.concatenate((size[stay], csize[~leaf]))


def _search(queries: list[Query], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        best = Best(len(queries), k)
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at] for c in batch.schema.names}
                shard = Shard({c: v.values if c in ("docs", "terms") else v.as_py() for c, v in row.items()})
                for first in range(0, len(queries), TOGETHER):
                    shard.search(queries, first, best)
        rows = [(q.row, q.item_id, None if null else d, -s) for q, found in zip(queries, best.found, strict=True) for s, null, d in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], names=["row", "item_id", "doc_id", "score"])

    return run


def _lengths(names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, df = pa.array(names, pa.string()), np.zeros(len(names), np.int64)
        for batch in batches:
            for terms, starts in zip(batch.column("terms"), batch.column("starts"), strict=True):
                place = pc.index_in(wanted, terms.values)
                there = pc.is_valid(place).to_numpy(zero_copy_only=False)
                df[there] += np.diff(np.frombuffer(starts.as_py(), np.int32))[place.drop_null().to_numpy()]
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(df)), pa.array(df[df > 0])], names=["term", "df"])

    return run


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def search(index: Index, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item (item_id, text) with a score above 0."""
    spark = items.sparkSession
    with tidy(spark):
        asked = materialise(items.select(F.monotonically_increasing_id().alias("row"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null"), "items")
        size = asked.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        blocks = -(-size // BLOCK_BYTES)
        found = None
        for b in range(blocks):
            part = materialise(_block(spark, index, asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).collect(), k), "found")
            found = part if found is None else found.unionByName(part)
        best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        if found is None:
            return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
        few = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).withColumn("rank", best("row", "salt")).where(F.col("rank") <= k)
        top = few.withColumn("rank", best("row")).where(F.col("rank") <= k)
        return materialise(top.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked", keep=True)


def _block(spark: SparkSession, index: Index, rows: list, k: int) -> DataFrame:
    offsets, flat = terms_of(pa.array([r["text"] for r in rows], pa.large_string()))
    words, counts = flat.to_pylist(), []
    for at in range(len(rows)):
        mine: dict[str, int] = {}
        for w in words[offsets[at] : offsets[at + 1]]:
            mine[w] = mine.get(w, 0) + 1
        counts.append(mine)
    names = sorted({w for mine in counts for w in mine})
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "4")  # rows of the index are a few megabytes
    try:
        lists = index.shards.select("terms", "starts").mapInArrow(_lengths(names), "term long, df long")
        df = {names[r["term"]]: r["df"] for r in lists.groupBy("term").agg(F.sum("df").alias("df")).collect()}
        queries = [Query(r["row"], r["item_id"], list(mine), [c * weight(index.docs, df[w]) if w in df else 0 for w, c in mine.items()]) for r, mine in zip(rows, counts, strict=True) if mine]
        return materialise(index.shards.mapInArrow(_search(queries, k), "row long, item_id long, doc_id long, score long"), "best")
    finally:
        spark.conf.set(key, before)


def ranked(documents: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """Index all documents and rank them for every item."""
    with tidy(documents.sparkSession):
        return materialise(search(build_index(documents), items, k), "ranked", keep=True)


SQL = r"""with docs as materialized (
  select row_number() over () as d, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents where text is not null),
full_docs as materialized (select d, doc_id, cast(len(terms) as bigint) as n, terms from docs where len(terms) > 0),
corpus as materialized (select count(*) as big_n, cast(sum(n) as bigint) as big_l from full_docs),
postings as materialized (select d, term, count(*) as tf from (select d, unnest(terms) as term from full_docs) group by d, term),
weights as materialized (select term, cast(floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1))) as bigint) as w from postings, corpus group by term),
items as materialized (
  select r, item_id, term, count(*) as qf
  from (select row_number() over () as r, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark)
  group by r, item_id, term),
scores as (
  select r, item_id, doc_id, d, cast(sum(qf * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * big_n) // big_l)))) as bigint) as score
  from items join weights using (term) join postings using (term) join full_docs using (d), corpus
  group by r, item_id, doc_id, d)
select item_id, cast(rank as integer) as rank, doc_id, score
from (select *, row_number() over (partition by r order by score desc, doc_id) as rank from scores where score > 0)
where rank <= 20"""
