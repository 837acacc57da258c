"""Byte-level BPE encoding and decoding with DuckDB recursive queries.

A partition's texts are cut by the tokenizer's pattern; each distinct piece is
contracted once.  Pieces that are tokens themselves need no merging.  For the
others a recursive query keeps one row per open piece: its tokens are unnested
into token-position rows, adjacent rows join the merge table, the smallest
(rank, position) of each piece is contracted, and pieces without a mergeable
pair leave the recursion.  Each text is decoded from its own ids: they are
position rows again, joined with the tokens' bytes, sorted, and put together in that
order by an aggregation.

Long pieces are cut first where two bytes stand together in no token, as no merge
crosses such a place.  What is still long goes through the query in short
overlapping windows.  Two windows are joined at a place where both have a border
and the tokens beside it stay apart when their bytes are encoded alone: a sequence
of tokens is the encoding of its bytes exactly if that holds for all neighbours.
Where windows have no such place (repetitive texts, whose windows are out of step),
a wide window is encoded from a border of the last one, by a query that contracts
all places of a piece's smallest rank in one step.  Time grows with the length, and
memory is that of a window's query and of the ids.

Pieces are worked off in batches of bounded size, so memory does not grow with
the partition; a batch of rows is bounded by bytes, a long text is a batch of
its own.

Edge cases: a null or empty text has no ids, encodes to '' and decodes to b'';
the texts of special tokens are ordinary text; repeated rows give repeated
results; any columns to carry are named by the caller; empty tables give empty
results.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import CACHES, slices

#: Distinct pieces of one recursive query, and of each of the two generations kept between batches.
PIECES, REMEMBERED = 20_000, 100_000
#: Bytes of texts that are encoded at once.
SLICE = 1 << 20
#: Bytes from which a piece is a long one, and of the long pieces of one query.
LONG, LONG_BYTES = 128, 1 << 18
#: Bytes of the windows of a long piece, and of what two of them share; bytes of a wide window.
WINDOW, OVERLAP, WIDE = 120, 48, 1 << 15
#: Parts of a long piece that are encoded together, and ids of one decoded group.
PARTS, DECODED = 50_000, 1 << 14

CONTRACT = """
WITH RECURSIVE state(w, ids, done) AS (
  SELECT w, ids, false FROM pieces
  UNION ALL
  SELECT s.w, CASE WHEN best.v IS NULL THEN s.ids ELSE s.ids[:p - 1] || [r] || s.ids[p + 2:] END, best.v IS NULL
  FROM state s LEFT JOIN (
    SELECT w, min(v) AS v, (min(v) >> 32)::INT AS r, (min(v) & 4294967295)::INT AS p
    FROM (SELECT near.w, (m.rank::BIGINT << 32) | near.pos AS v
          FROM (SELECT w, unnest(ids[:-2]) AS a, unnest(ids[2:]) AS b, generate_subscripts(ids[2:], 1) AS pos FROM state WHERE NOT done) near
          JOIN merges m ON m.pair = near.a::BIGINT * 4294967296 + near.b)
    GROUP BY w) best USING (w)
  WHERE NOT s.done)
SELECT w, ids FROM state WHERE done
"""
#: Long pieces: in each step the places of a piece's smallest rank are contracted from left to
#: right, up to the first after which a pair of a smaller rank lies beside the new token.  The
#: state keeps one row per piece, so a step costs a piece's length, and there are hardly more
#: steps than ranks that the piece uses.
CONTRACT_LONG = """
WITH RECURSIVE state(w, ids, done) USING KEY (w) AS (
  SELECT w, ids, false FROM pieces
  UNION
  (WITH near AS (SELECT w, unnest(ids[:-2]) AS a, unnest(ids[2:]) AS b, generate_subscripts(ids[2:], 1) AS pos FROM state WHERE NOT done),
   found AS (SELECT near.w, near.pos, m.rank FROM near JOIN merges m ON m.pair = near.a::BIGINT * 4294967296 + near.b),
   best AS (SELECT w, min(rank) AS r FROM found GROUP BY w),
   hits AS (SELECT found.w, r, pos, pos - row_number() OVER (PARTITION BY found.w ORDER BY pos) AS run FROM found JOIN best ON best.w = found.w AND found.rank = best.r),
   taken AS (SELECT w, r, pos, row_number() OVER (PARTITION BY w, run ORDER BY pos) AS k FROM hits),
   apart AS (SELECT w, r, pos, pos - lag(pos) OVER (PARTITION BY w ORDER BY pos) AS gap FROM taken WHERE k % 2 = 1),
   sides AS (SELECT p.w, p.r, p.pos, unnest([(CASE WHEN gap = 2 THEN p.r ELSE s.ids[p.pos - 1] END)::BIGINT * 4294967296 + p.r, p.r::BIGINT * 4294967296 + s.ids[p.pos + 2]]) AS pair FROM apart p JOIN state s ON s.w = p.w),
   stops AS (SELECT d.w, min(d.pos) AS stop FROM sides d JOIN early e ON e.pair = d.pair WHERE e.rank < d.r GROUP BY d.w),
   chosen AS (SELECT p.w, r, pos FROM apart p LEFT JOIN stops ON stops.w = p.w WHERE stop IS NULL OR pos <= stop),
   listed AS (SELECT w, any_value(r) AS r, count(*) AS n, list(pos ORDER BY pos) AS cuts FROM chosen GROUP BY w),
   few AS (SELECT w, r, cuts FROM listed WHERE n <= 16),
   spread AS (SELECT w, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM state WHERE NOT done AND w IN (SELECT w FROM listed WHERE n > 16)),
   many AS (SELECT x.w, list(coalesce(c.r, x.id) ORDER BY x.pos) AS ids FROM spread x LEFT JOIN chosen c ON c.w = x.w AND c.pos = x.pos LEFT JOIN chosen d ON d.w = x.w AND d.pos = x.pos - 1 WHERE d.pos IS NULL GROUP BY x.w)
   SELECT s.w, CASE WHEN m.w IS NOT NULL THEN m.ids WHEN c.w IS NULL THEN s.ids ELSE
     flatten(list_transform(range(1, len(c.cuts) + 2), lambda k:
       s.ids[(CASE WHEN k = 1 THEN 1 ELSE c.cuts[k - 1] + 2 END):(CASE WHEN k > len(c.cuts) THEN len(s.ids) ELSE c.cuts[k] - 1 END)] || (CASE WHEN k > len(c.cuts) THEN []::INT[] ELSE [c.r] END))) END, c.w IS NULL AND m.w IS NULL
   FROM state s LEFT JOIN few c ON c.w = s.w LEFT JOIN many m ON m.w = s.w WHERE NOT s.done))
SELECT w, ids FROM state
"""
#: Rows are sorted by text and place and put together in that order: one thread reads them as they
#: come, which costs a fifth of an order inside the aggregate.
DECODE = """
SELECT w, string_agg(bytes, '') AS bytes
FROM (SELECT w, pos, t.bytes FROM (SELECT w, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM encoded) x JOIN tokens t USING (id) ORDER BY w, pos)
GROUP BY w
"""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Encodes pieces through an in-process DuckDB that holds the merge table."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        self.ranks = load_ranks(path)
        self.cut = regex.compile(pattern).findall
        self.byte = [self.ranks[bytes([b])] for b in range(256)]
        self.db = connect()
        #: bytes of a token as characters 0 to 255
        tokens = pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "bytes": [t.decode("latin-1") for t in self.ranks]})
        pairs = [(self.ranks[t[:i]] << 32 | self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        merges = pa.table({"pair": pa.array([p for p, _ in pairs], pa.int64()), "rank": pa.array([r for _, r in pairs], pa.int32())})
        first = [(p, r) for p, r in pairs if r < max(p >> 32, p & 0xFFFFFFFF)]  # tokens of smaller rank than one of their parts
        early = pa.table({"pair": pa.array([p for p, _ in first], pa.int64()), "rank": pa.array([r for _, r in first], pa.int32())})
        self.size = np.zeros(max(self.ranks.values()) + 1, np.int64)
        self.together = np.zeros(1 << 16, bool)  # bytes that are neighbours in a token
        self.by_id = dict(zip(self.ranks.values(), self.ranks, strict=True))
        for t, r in self.ranks.items():
            self.size[r] = len(t)
            for a, b in zip(t, t[1:]):
                self.together[a << 8 | b] = True
        for name, rows in (("tokens", tokens), ("merges", merges), ("early", early)):
            self.db.register("given", rows)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        #: piece -> its ids as decimal text, of this and the last generation
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}
        #: whether two tokens stay apart, in this piece
        self.apart: dict[tuple[int, int], bool] = {}

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces that are not known yet."""
        for at in range(0, len(pieces), PIECES):
            raw = [(p, p.encode()) for p in pieces[at : at + PIECES]]
            short = [(p, r) for p, r in raw if len(r) < LONG or r in self.ranks]
            for (p, _), ids in zip(short, self.merge([r for _, r in short]), strict=True):
                self.known[p] = ",".join(map(str, ids.tolist()))
            for p, r in raw:
                if len(r) >= LONG and r not in self.ranks:
                    self.known[p] = ",".join(map(str, self.encode_long(r).tolist()))

    def merge(self, raw: list[bytes]) -> list[np.ndarray]:
        """Ids of byte strings, by the recursive queries."""
        whole = [self.ranks.get(r) for r in raw]
        out: list[np.ndarray] = [np.array([w], np.int32) if w is not None else np.zeros(0, np.int32) for w in whole]
        todo = [k for k, w in enumerate(whole) if w is None and raw[k]]
        starts = {k: [self.byte[b] for b in raw[k]] for k in todo}
        merged = [self._contract(CONTRACT, [k for k in todo if len(raw[k]) < LONG], starts)]
        merged += [self._contract(CONTRACT_LONG, some, starts) for some in _bundles([k for k in todo if len(raw[k]) >= LONG], raw)]
        for table in merged:
            for part in table.to_batches():
                flat, ends = part["ids"].flatten().to_numpy(), np.concatenate(([0], np.cumsum(part["ids"].value_lengths().to_numpy())))
                for n, k in enumerate(part["w"].to_pylist()):
                    out[k] = flat[ends[n] : ends[n + 1]]
        return out

    # ------------------------------------------------------------ long pieces

    def encode_long(self, raw: bytes) -> np.ndarray:
        """Ids of a long piece, part by part."""
        data = np.frombuffer(raw, np.uint8).astype(np.int32)
        cuts = np.flatnonzero(~self.together[data[:-1] << 8 | data[1:]]) + 1
        ends = [0, *cuts.tolist(), len(raw)]
        found: list[np.ndarray] = []
        for at in range(0, len(ends) - 1, PARTS):
            parts = [raw[a:b] for a, b in zip(ends[at : at + PARTS], ends[at + 1 : at + PARTS + 1])]
            short = list({p for p in parts if len(p) < LONG})
            known = dict(zip(short, self.merge(short), strict=True))
            found += [known[p] if p in known else self._windows(p) for p in parts]
        self.apart.clear()
        return np.concatenate(found)

    def _apart(self, pairs: set[tuple[int, int]]) -> None:
        """Learn of pairs of tokens whether they stay apart when they are encoded together."""
        new = [p for p in pairs if p not in self.apart]
        for (a, b), ids in zip(new, self.merge([self.by_id[a] + self.by_id[b] for a, b in new]), strict=True):
            self.apart[a, b] = ids.tolist() == [a, b]

    def _windows(self, raw: bytes) -> np.ndarray:
        """Ids of a part without sure cuts, from windows that overlap."""
        starts = list(range(0, max(1, len(raw) - OVERLAP), WINDOW - OVERLAP))
        texts = [raw[s : s + WINDOW] for s in starts]
        ids: dict[bytes, np.ndarray] = {}
        distinct = list(set(texts))
        for at in range(0, len(distinct), PIECES):
            ids |= zip(distinct[at : at + PIECES], self.merge(distinct[at : at + PIECES]), strict=True)
        ends = {t: np.cumsum(self.size[i]) for t, i in ids.items()}
        step, cache = WINDOW - OVERLAP, {}
        for a, b in zip(texts, texts[1:]):
            if (a, b) not in cache:
                cache[a, b] = _borders(ids[a], ends[a], ids[b], ends[b] + step)
        self._apart({(int(ids[a][i]), int(ids[b][j])) for (a, b), places in cache.items() for i, j in places})
        out: list[np.ndarray] = []
        k, mine, first, begin = 0, ids[texts[0]], 0, 0  # the window in hand, its ids, those already given out, its place
        while True:
            wide = begin != starts[k] or mine is not ids[texts[k]]
            if not wide and k + 1 == len(texts):
                break
            if wide:
                end = begin + int(self.size[mine].sum())
                if end >= len(raw):
                    break
                nxt = max(0, end - OVERLAP) // step
                places = _borders(mine, begin + np.cumsum(self.size[mine]), ids[texts[nxt]], starts[nxt] + ends[texts[nxt]])
                self._apart({(int(mine[i]), int(ids[texts[nxt]][j])) for i, j in places})
            else:
                nxt, places = k + 1, cache[texts[k], texts[k + 1]]
            good = next(((i, j) for i, j in places if i >= first and self.apart[int(mine[i]), int(ids[texts[nxt]][j])]), None)
            if good:
                out.append(mine[first : good[0] + 1])
                k, mine, first, begin = nxt, ids[texts[nxt]], good[1], starts[nxt]
                continue
            # out of step: go on from a border of the window in hand
            last, i, own = begin + np.cumsum(self.size[mine]), len(mine) - 2, None
            while i >= first and own is None:
                at = int(last[i])
                text = raw[at : at + WIDE]
                if text not in ids:
                    ids[text] = self.merge([text])[0]
                pair = int(mine[i]), int(ids[text][0])
                self._apart({pair})
                own = ids[text] if self.apart[pair] and (at + len(text) == len(raw) or len(ids[text]) > 1) else None
                i -= own is None
            if own is None:  # no border will do: the rest at once
                out.append(self.merge([raw[begin + int(self.size[mine[:first]].sum()) :]])[0])
                return np.concatenate(out)
            out.append(mine[first : i + 1])
            mine, first, begin = own.copy(), 0, at
        out.append(mine[first:])
        return np.concatenate(out)

    def _contract(self, query: str, todo: list[int], starts: dict[int, list[int]]) -> pa.Table:
        """(w, ids) of the pieces in ``todo``, by the recursive query."""
        schema = pa.schema([("w", pa.int32()), ("ids", pa.list_(pa.int32()))])
        given = pa.table({"w": pa.array(todo, pa.int32()), "ids": pa.array([starts[k] for k in todo], pa.list_(pa.int32()))}, schema)
        if not todo:
            return given
        self.db.register("pieces", given)
        try:
            return self.db.sql(query).to_arrow_table().cast(schema)
        finally:
            self.db.unregister("pieces")

    def encode(self, texts: list[str | None]) -> Iterator[tuple[str, bytes]]:
        """(decimal ids joined by commas, bytes that the ids decode to) of each text."""
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        cut = [self.cut(t) if t else [] for t in texts]
        new = set().union(*cut).difference(self.known)
        for p in self.older.keys() & new:
            self.known[p] = self.older[p]
        self.learn(list(new.difference(self.older)))
        said = [",".join(map(self.known.__getitem__, pieces)) for pieces in cut]
        yield from zip(said, decode(self.db, [ids_of(x) for x in said]), strict=True)


def ids_of(said: str) -> np.ndarray:
    return np.fromstring(said, dtype=np.int32, sep=",") if said else np.zeros(0, np.int32)


def decode(db, ids: list[np.ndarray]) -> list[bytes]:
    """Bytes of each list of ids, by the ordered aggregation over the tokens' table."""
    parts = [(k, i[at : at + DECODED]) for k, i in enumerate(ids) for at in range(0, len(i), DECODED)]
    out: list[list[bytes]] = [[] for _ in ids]
    for some in _by_size(parts):
        lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(i) for _, i in some]))).astype(np.int32), np.concatenate([i for _, i in some]))
        db.register("encoded", pa.table({"w": pa.array(range(len(some)), pa.int32()), "ids": lists}))
        found = db.sql(DECODE).to_arrow_table()
        text = dict(zip(found["w"].to_pylist(), found["bytes"].to_pylist(), strict=True))
        db.unregister("encoded")
        for n, (k, _) in enumerate(some):
            out[k].append(text[n].encode("latin-1"))
    return [b"".join(x) for x in out]


def _by_size(parts: list[tuple[int, np.ndarray]]) -> Iterator[list[tuple[int, np.ndarray]]]:
    some, size = [], 0
    for part in parts:
        if some and size + len(part[1]) > 4 * DECODED:
            yield some
            some, size = [], 0
        some.append(part)
        size += len(part[1])
    if some:
        yield some


def _borders(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> list[tuple[int, int]]:
    """(token of a, token of b) beside up to four places where both windows have a border, the middle ones first."""
    _, i, j = np.intersect1d(a_ends[:-1], b_ends[:-1], assume_unique=True, return_indices=True)
    middle = np.argsort(np.abs(np.arange(len(i)) - len(i) // 2), kind="stable")[:4]
    return [(int(i[m]), int(j[m]) + 1) for m in middle]


def connect():
    """A database in memory that never writes: what doesn't fit is an error, not a file beside the worker.

    Its allocator gives freed memory back after each task; by its defaults it keeps more than 100 MB."""
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "800MB", "temp_directory": "", "allocator_flush_threshold": "1MB", "allocator_bulk_deallocation_flush_threshold": "1MB"})


def _bundles(places: list[int], raw: list[bytes]) -> Iterator[list[int]]:
    """The places in lists of about ``LONG_BYTES`` bytes."""
    some, size = [], 0
    for k in places:
        if some and size + len(raw[k]) > LONG_BYTES:
            yield some
            some, size = [], 0
        some.append(k)
        size += len(raw[k])
    if some:
        yield some


def count_ids(said: str) -> int:
    return said.count(",") + 1 if said else 0


@lru_cache(maxsize=1)
def encoder(path: str, pattern: str) -> Encoder:
    """One per Python worker, kept between tasks."""
    CACHES["bpe"] = encoder.cache_clear
    return Encoder(path, pattern)


def bpe_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE, "bpe"):
            n, ids, decoded = [], [], []
            for said, raw in encoder(path, pattern).encode(batch.column("text").to_pylist()):
                n.append(count_ids(said))
                ids.append(hashlib.sha256(said.encode()).hexdigest())
                decoded.append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, n_tokens, token_ids array<int> and round_trip: whether
    the ids decode to the text's bytes."""
    carried = [f for f in docs.schema.fields if f.name in carry]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried) + ", n_tokens long, token_ids array<int>, round_trip boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bpe_text", SLICE, "bpe"):
            texts = batch.column("bpe_text").to_pylist()
            n, ids, same = [], [], []
            for text, (said, raw) in zip(texts, encoder(path, pattern).encode(texts), strict=True):
                n.append(count_ids(said))
                ids.append(ids_of(said))
                same.append(raw == (text or "").encode())
            names = [f.name for f in carried]
            lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(n))).astype(np.int32), np.concatenate(ids))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(n, pa.int64()), lists, pa.array(same)], [*names, "n_tokens", "token_ids", "round_trip"])

    return docs.select(*[F.col(f.name) for f in carried], F.col(text_col).cast("string").alias("bpe_text")).mapInArrow(run, schema)


def bpe_decode(encoded: DataFrame, path: str, ids_col: str = "token_ids", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns and text, decoded from an array of ids (invalid UTF-8 is replaced)."""
    carried = [f for f in encoded.schema.fields if f.name in carry]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried) + ", text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = connect()
        ranks = load_ranks(path)
        db.register("tokens", pa.table({"id": pa.array(ranks.values(), pa.int32()), "bytes": [t.decode("latin-1") for t in ranks]}))
        for batch in batches:
            texts = [raw.decode("utf-8", "replace") for raw in decode(db, [np.array(x or [], np.int32) for x in batch.column("bpe_ids").to_pylist()])]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in carried], pa.array(texts, pa.string())], [*[f.name for f in carried], "text"])

    return encoded.select(*[F.col(f.name) for f in carried], F.col(ids_col).alias("bpe_ids")).mapInArrow(run, schema)
