"""Token-id files with Elias-Fano coded document boundaries.

Rows are range-partitioned by id, rows of an id by a hash of their text, sorted, tokenised and streamed into one file
per partition: the ids of all documents as one array (two bytes each while the
vocabulary allows it), then the document boundaries and the document ids as
Elias-Fano sequences, then a footer.  A boundary costs 2 + log2(tokens / documents)
bits; select finds the i-th one through sampled ranks and a scan of at most one
sample's span, without a table of 64-bit offsets.  Global starts are the prefix
sums of the files' token counts (one number per file).

A task writes under a name of its own attempt and reports it in the manifest,
which is written as a table before anything reads the files.

Edge cases: a null or empty text is the end id alone; a null id orders first
(their number is in the footer); repeated rows are repeated documents, rows of one
id stand in the order of their texts' hashes and may lie in several files; an empty
table makes no file and an empty result; extra columns are ignored; a document
may be longer than any buffer, since ids are streamed.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import CACHES, encode_dictionary, materialise, scratch, slices, split_words
from .warc import _input, _output

#: Ones between two sampled positions of the upper bits.
SAMPLE = 512
#: Ids that a reader holds at once (a longer document is read alone).
READ_IDS, READ_DOCS = 1 << 20, 1 << 14


class EliasFano:
    """A non-decreasing sequence of n numbers in [0, universe]."""

    def __init__(self, n: int, low_bits: int, lower: bytes, upper: bytes, samples: bytes) -> None:
        self.n, self.low_bits, self.samples = n, low_bits, np.frombuffer(samples, "<u4")
        self.lower, self.upper = np.frombuffer(lower, np.uint8), np.frombuffer(upper, np.uint8)

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        universe = int(values[-1]) if n else 0
        low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
        low = values & np.uint64((1 << low_bits) - 1)
        bits = ((low[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        unary[places] = 1
        return cls(n, low_bits, np.packbits(bits.ravel(), bitorder="little").tobytes(), np.packbits(unary, bitorder="little").tobytes(), places[::SAMPLE].astype("<u4").tobytes())

    def _low(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for b in range(self.low_bits):
            place = at * self.low_bits + b
            out |= ((self.lower[place >> 3] >> (place & 7)) & 1).astype(np.int64) << b
        return out

    def select(self, i: int) -> int:
        """The i-th number."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        start = int(self.samples[i // SAMPLE])
        stop = int(self.samples[i // SAMPLE + 1]) + 1 if i // SAMPLE + 1 < len(self.samples) else len(self.upper) * 8
        ones = np.nonzero(np.unpackbits(self.upper[start >> 3 : (stop + 7) >> 3], bitorder="little")[start & 7 :])[0]
        return (int(ones[i % SAMPLE]) + start - i) << self.low_bits | int(self._low(np.array([i]))[0])

    def between(self, i: int, j: int) -> np.ndarray:
        """Numbers i to j - 1, by one select; only the upper bits from it on are read."""
        if not 0 <= i <= j <= self.n:
            raise IndexError((i, j))
        if i == j:
            return np.zeros(0, np.int64)
        start, last = int(self.samples[i // SAMPLE]), (j - 1) // SAMPLE + 1
        stop = int(self.samples[last]) + 1 if last < len(self.samples) else len(self.upper) * 8
        ones = np.nonzero(np.unpackbits(self.upper[start >> 3 : (stop + 7) >> 3], bitorder="little")[start & 7 :])[0]
        at = np.arange(i, j)
        return (ones[at - i // SAMPLE * SAMPLE] + start - at) << self.low_bits | self._low(at)

    def parts(self) -> list[bytes]:
        return [self.lower.tobytes(), self.upper.tobytes(), self.samples.tobytes()]


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


# What the words of a tokenizer file must rest on if they are to be encoded apart.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def encodes_words_apart(path: str) -> bool:
    """Whether the tokenizer in the file is of the kind that ``WordIds`` takes for granted."""
    with open(path, encoding="utf-8") as f:
        form = json.load(f)
    cut = (form.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return (
        form.get("normalizer") == NORMALIZER
        and [c.get("type") for c in cut] == ["Split", "ByteLevel"]
        and cut[0].get("pattern") == {"Regex": SPLIT}
        and not cut[1].get("add_prefix_space") and not cut[1].get("use_regex")
        and not any(c.isspace() for t in form.get("added_tokens") or [] for c in t["content"])
    )


class WordIds:
    """Ids of words, each encoded once by the tokenizers library and kept for later batches.

    ``encodes_words_apart`` has found that the tokenizer drops white space, never
    joins across it, folds case, and cuts letters from punctuation; so a word of letters with punctuation behind it
    is two parts, and ASCII letters are folded before they are looked up.  New
    parts are encoded many at a time, in one text with the word NUL between them;
    a part that holds NUL itself is encoded alone.
    """

    #: Parts kept, about; parts of one text.
    MOST, AT_ONCE = 600_000, 1000
    MARKS = ".,!?;:"

    def __init__(self, path: str) -> None:
        self.encode = tokenizer(path).encode_batch_fast
        mark = self.encode(["\0"], add_special_tokens=False)[0].ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {"": 0}
        self.at, self.pool = np.zeros(2, np.int64), np.zeros(0, np.int32)

    def parts(self, word: str) -> tuple[str, str]:
        body = word.rstrip(self.MARKS)
        if body.isalpha() and "\u0130" not in body:
            return body.lower() if body.isascii() else body, word[len(body) :]
        return word, ""

    def _learn(self, new: list[str]) -> None:
        plain = [w for w in new if "\0" not in w] if self.mark is not None else []
        odd = [w for w in new if "\0" in w] if self.mark is not None else new
        ids, sizes = [], []
        texts = [" \0 ".join(plain[k : k + self.AT_ONCE]) for k in range(0, len(plain), self.AT_ONCE)]
        for e in self.encode(texts, add_special_tokens=False):
            row = np.array(e.ids, dtype=np.int32)
            cuts = np.nonzero(row == self.mark)[0]
            sizes.append(np.diff(np.concatenate(([-1], cuts, [len(row)]))) - 1)
            ids.append(np.delete(row, cuts))
        for e in self.encode(odd, add_special_tokens=False):
            ids.append(np.array(e.ids, dtype=np.int32))
            sizes.append(np.array([len(e.ids)]))
        first = len(self.place)
        self.place.update(zip(plain + odd, range(first, first + len(new)), strict=True))
        self.pool = np.concatenate((self.pool, *ids))
        self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(np.concatenate(sizes))))

    def places(self, words: list[str]) -> np.ndarray:
        """Places of both parts of every word, [words, 2]."""
        if len(self.place) > self.MOST:
            self.clear()
        both = [p for w in words for p in self.parts(w)]
        if new := list(set(both).difference(self.place)):
            self._learn(new)
        return np.fromiter(map(self.place.__getitem__, both), np.int64, len(both)).reshape(-1, 2)


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One per Python worker, kept between tasks."""
    CACHES["words"] = word_ids.cache_clear
    return WordIds(path)


def token_ids(text: pa.Array, path: str, end_id: int, by_words: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Number of ids of every text, the end id included, and all ids in a row.

    Without ``by_words`` the library encodes whole texts."""
    if not by_words:
        rows = [np.array([*e.ids, end_id], np.uint32) for e in tokenizer(path).encode_batch_fast([t or "" for t in text.to_pylist()], add_special_tokens=False)]
        return np.array([len(r) for r in rows], np.int64), np.concatenate(rows)
    known = word_ids(path)
    offsets, flat = split_words(text)
    codes, words = encode_dictionary(flat)
    place = known.places(words.to_pylist())[codes].ravel()
    size = np.diff(known.at)[place]
    ends = np.concatenate(([0], np.cumsum(size)))
    source = np.arange(ends[-1])
    source += np.repeat(known.at[place] - ends[:-1], size)
    lengths = ends[2 * offsets[1:]] - ends[2 * offsets[:-1]]
    out = np.full(len(source) + len(lengths), end_id, np.uint32)
    inside = np.ones(len(out), bool)
    inside[np.cumsum(lengths + 1) - 1] = False
    out[inside] = known.pool[source]
    return lengths + 1, out


def write_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> DataFrame:
    """Write the files; returns the manifest (part, uri, n_docs, n_tokens)."""
    folder = scratch(docs.sparkSession, "tokens")
    wide = tokenizer(path).get_vocab_size() > 1 << 16 or end_id >= 1 << 16
    dtype, by_words = "<u4" if wide else "<u2", encodes_words_apart(path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, sizes, ids_of, nulls = f"{uuid.uuid4().hex}.ids", None, [], [], 0
        for batch in slices(batches, "text", owner="words"):
            out = out or _output(folder, name)
            lengths, ids = token_ids(batch.column("text"), path, end_id, by_words)
            out.write(ids.astype(dtype).tobytes())
            sizes.append(lengths)
            doc_ids = batch.column("doc_id")
            nulls += doc_ids.null_count
            ids_of.append(pc.drop_null(doc_ids).to_numpy(zero_copy_only=False))
        if out is None:
            return
        lengths, doc_ids = np.concatenate(sizes), np.concatenate(ids_of)
        bounds, names = EliasFano.encode(np.concatenate(([0], np.cumsum(lengths)))), EliasFano.encode((doc_ids - doc_ids[:1]).astype(np.uint64))
        parts = [*bounds.parts(), *names.parts()]
        footer = {"dtype": dtype, "docs": len(lengths), "tokens": int(lengths.sum()), "nulls": nulls, "first": int(doc_ids[0]) if len(doc_ids) else 0, "low": [bounds.low_bits, names.low_bits], "sizes": [len(p) for p in parts]}
        tail = json.dumps(footer).encode()
        out.write(b"".join(parts) + tail + len(tail).to_bytes(8, "little"))
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([len(lengths)], pa.int64()), pa.array([footer["tokens"]], pa.int64())], ["part", "uri", "n_docs", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # rows of one id are dealt on by their text, equal rows by their place, so a hot id is many files
    keys = ("doc_id", "by_text")
    placed = rows.withColumns({"by_text": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    ordered = placed.repartitionByRange(*keys, "place").sortWithinPartitions(*keys, "text").select("doc_id", "text")
    return materialise(ordered.mapInArrow(write, "part int, uri string, n_docs long, n_tokens long"), "token-manifest")


class TokenFile:
    """Random access to one file."""

    def __init__(self, uri: str) -> None:
        self.file = _input(uri)
        size = self.file.size()
        length = int.from_bytes(self.file.read_at(8, size - 8), "little")
        self.footer = json.loads(self.file.read_at(length, size - 8 - length))
        at = np.cumsum([0, *self.footer["sizes"]])
        start = size - 8 - length - int(at[-1])
        parts = [self.file.read_at(int(b - a), start + int(a)) for a, b in zip(at[:-1], at[1:], strict=True)]
        n = self.footer["docs"]
        self.bounds = EliasFano(n + 1, self.footer["low"][0], *parts[:3])
        self.names = EliasFano(n - self.footer["nulls"], self.footer["low"][1], *parts[3:])

    def ids(self, start: int, stop: int) -> np.ndarray:
        width = int(self.footer["dtype"][2])
        return np.frombuffer(self.file.read_at((stop - start) * width, start * width), self.footer["dtype"])

    def document(self, i: int) -> np.ndarray:
        return self.ids(self.bounds.select(i), self.bounds.select(i + 1))


def read_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    spark = manifest.sparkSession
    files, before = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r["part"]):  # one row per file
        files.append((r["uri"], before))
        before += r["n_tokens"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column("uri").to_pylist(), batch.column("base").to_pylist(), strict=True):
                file = TokenFile(uri)
                i, n, nulls = 0, file.footer["docs"], file.footer["nulls"]
                while i < n:
                    bounds = file.bounds.between(i, min(n, i + READ_DOCS) + 1)
                    k = max(1, int(np.searchsorted(bounds, bounds[0] + READ_IDS, side="right")) - 1)
                    ids, bounds = file.ids(int(bounds[0]), int(bounds[k])).astype("<u4"), bounds[: k + 1]
                    at = (bounds - bounds[0]).tolist()
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                    none = min(k, max(0, nulls - i))  # null ids come first
                    named = file.names.between(max(0, i - nulls), max(0, i + k - nulls)) + file.footer["first"]
                    names = pa.concat_arrays([pa.nulls(none, pa.int64()), pa.array(named, pa.int64())])
                    yield pa.RecordBatch.from_arrays([names, pa.array(bounds[:-1] + base, pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    i += k

    listed = spark.createDataFrame(files, "uri string, base long").repartition(max(1, len(files)))
    return listed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
