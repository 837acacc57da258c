"""Quality rules by line sequence labelling.

A linear-chain conditional random field with two states, content and
boilerplate, reads the lines of a text (those with a word); Viterbi decoding
labels them, and a text is kept if the words of its content lines are at least
``CONTENT_SHARE`` of all.  Counts that rule a text out at once (too few words,
too many repeated five-word windows) are taken over the whole text.

The field is trained in numpy, in one executor task, on a bounded sample of texts
with a quality label (``MOST_LABELS`` ids, one text each, and whole texts in the order
of a hash up to ``MOST_LINES`` lines).  Such labels are of texts, not lines: all lines of good texts
are content; in bad texts a line is boilerplate if a logistic regression over
line features finds it so, else content.  These line labels train the field by
maximum likelihood (forward-backward over padded batches, Adam).

Edge cases: a null text has no words and fails the base rules; lines without a
word are no part of the sequence; without quality labels of both kinds every
line is content; repeated rows and null ids are labelled like any other; extra
columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bytes_of, encode_dictionary, plain, slices, split_words, sums_between

MOST_LABELS, MOST_LINES = 8_000, 1_000_000
CONTENT_SHARE = 0.5
WINDOW = 5
# Symbols that count as noise.
SYMBOLS = "#*$%&|<>"
FEATURES = ("symbols", "pipes", "capitals", "exclamations", "duplicate", "stutter", "repeated", "length", "short", "digits", "sameness", "piped", "noisy", "shouted", "bias")


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[[ord(c) for c in chars]] = 1
    return out


def _count(raw: np.ndarray, at: np.ndarray, table: np.ndarray) -> np.ndarray:
    out, some = np.zeros(len(at) - 1, np.int64), at[1:] > at[:-1]
    if some.any():
        # the last byte of a slice belongs to it alone: slices are adjacent
        out[some] = np.add.reduceat(table[raw], at[:-1][some], dtype=np.int64)
    return out


class Lines:
    """Lines, words and counts of a batch of texts."""

    def __init__(self, text: pa.Array) -> None:
        text = plain(text)
        lists = pc.split_pattern(text, "\n")
        lines = lists.flatten()
        first = np.asarray(lists.offsets, dtype=np.int64)
        self.of_doc = first - first[0]  # lines of each text
        self.words_at, flat = split_words(lines)  # words of each line
        codes, distinct = encode_dictionary(flat)
        chars = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
        self.n = len(text)
        self.doc_words = self.words_at[self.of_doc]  # words of each text
        self.n_words = np.diff(self.doc_words)
        self.word_chars = sums_between(chars[codes], self.doc_words)
        self.line_words = np.diff(self.words_at)
        at, raw = bytes_of(lines)
        self.at, self.raw = at - at[0], raw[at[0] : at[-1]]
        self.symbols = _count(self.raw, self.at, _table(SYMBOLS))
        self.n_symbols = sums_between(self.symbols, self.of_doc)
        # equal to an earlier line of the text
        doc = np.repeat(np.arange(self.n), np.diff(self.of_doc))
        line_codes, _ = encode_dictionary(lines)
        order = np.lexsort((np.arange(len(line_codes)), line_codes, doc))
        same = np.zeros(len(order), bool)
        same[order[1:]] = (line_codes[order[1:]] == line_codes[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
        self.duplicate = same & (self.line_words > 0)
        self.n_dup_lines = sums_between(self.duplicate.astype(np.int64), self.of_doc)
        # words inside windows that the text holds twice
        self.repeated = self._repeated(codes)
        self.n_repeat_words = sums_between(self.repeated, self.doc_words)
        self.codes = codes

    def _repeated(self, codes: np.ndarray) -> np.ndarray:
        n, out = len(codes), np.zeros(len(codes), np.int64)
        if n < WINDOW:
            return out
        doc = np.repeat(np.arange(self.n), self.n_words)
        m = n - WINDOW + 1
        key = doc[:m].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(WINDOW):
            key = (key ^ codes[k : m + k].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            key ^= key >> np.uint64(32)
        starts = np.nonzero(doc[:m] == doc[WINDOW - 1 :])[0]
        order = starts[np.argsort(key[starts], kind="stable")]
        a, b = order[:-1], order[1:]
        same = (key[a] == key[b]) & (doc[a] == doc[b])
        a, b = a[same], b[same]
        for k in range(WINDOW):  # the key only finds candidates
            keep = codes[a + k] == codes[b + k]
            a, b = a[keep], b[keep]
        edge = np.zeros(n + 1, np.int64)
        twice = np.unique(np.concatenate((a, b)))
        np.add.at(edge, twice, 1)
        np.add.at(edge, twice + WINDOW, -1)
        return (np.cumsum(edge[:-1]) > 0).astype(np.int64)

    def features(self) -> np.ndarray:
        """One row of FEATURES for every line (also those without a word)."""
        words = np.maximum(1, self.line_words)
        upper = _count(self.raw, self.at, _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        lower = _count(self.raw, self.at, _table("abcdefghijklmnopqrstuvwxyz"))
        size = np.maximum(1, np.diff(self.at))
        stutter = np.zeros(len(self.codes))
        stutter[1:] = self.codes[1:] == self.codes[:-1]
        starts = self.words_at[:-1][self.line_words > 0]
        stutter[starts] = 0
        line = np.repeat(np.arange(len(self.line_words)), self.line_words)
        pairs = np.sort(line * np.int64(len(self.codes) + 1) + self.codes)
        kinds = np.bincount(pairs[np.concatenate(([True], pairs[1:] != pairs[:-1]))] // (len(self.codes) + 1), minlength=len(words)) if len(pairs) else np.zeros(len(words))
        pipes, capitals = _count(self.raw, self.at, _table("|")), upper / np.maximum(1, upper + lower)
        return np.stack(
            (
                np.minimum(3, self.symbols / words), np.minimum(1, pipes / words), capitals, np.minimum(3, _count(self.raw, self.at, _table("!")) / words),
                self.duplicate, sums_between(stutter, self.words_at) / words, sums_between(self.repeated, self.words_at) / words, np.log1p(words) / 5, self.line_words < 4, _count(self.raw, self.at, _table("0123456789")) / size,
                1 - kinds / words, pipes > 0, self.symbols >= 0.3 * words, (capitals > 0.7) & (words > 2), np.ones(len(words)),
            ),
            axis=1,
        ).astype(np.float64)


# -------------------------------------------------------------------- field


class Field:
    """Weights: emission of boilerplate over content, and transitions."""

    def __init__(self, weights: np.ndarray | None = None, moves: np.ndarray | None = None) -> None:
        self.weights = np.zeros(len(FEATURES)) if weights is None else weights
        self.moves = np.zeros((2, 2)) if moves is None else moves
        if weights is None:
            self.weights[-1] = -1.0

    def viterbi(self, x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """State of every row, 1 for boilerplate; sequence i is x[offsets[i]:offsets[i + 1]].

        All sequences advance together, so the loop is as long as the longest one.
        """
        emission = x @ self.weights
        state = np.zeros(len(x), np.int8)
        size = np.diff(offsets)
        order = np.argsort(-size, kind="stable")
        starts, size = offsets[:-1][order], size[order]
        back = np.zeros((len(x), 2), np.int8)
        best = np.zeros((len(order), 2))
        live = int((size > 0).sum())
        if not live:
            return state
        best[:live, 1] = emission[starts[:live]]
        for t in range(1, int(size[0])):
            live = int(np.searchsorted(-size, -t, side="left"))  # sequences longer than t
            paths = best[:live, :, None] + self.moves[None]
            back[starts[:live] + t] = paths.argmax(axis=1)
            best[:live] = paths.max(axis=1)
            best[:live, 1] += emission[starts[:live] + t]
        now = best.argmax(axis=1)
        for t in range(int(size[0]) - 1, -1, -1):
            live = int(np.searchsorted(-size, -t, side="left"))
            rows = starts[:live] + t
            state[rows] = now[:live]
            now[:live] = back[rows, now[:live]]
        return state

    def fit(self, x: np.ndarray, offsets: np.ndarray, y: np.ndarray, steps: int = 150, rate: float = 0.1, ridge: float = 1e-3) -> None:
        """Maximum likelihood by forward-backward, all sequences advancing together."""
        size = np.diff(offsets)
        order = np.argsort(-size, kind="stable")
        starts, size = offsets[:-1][order], size[order]
        longest, n = int(size[0]), len(x)
        lives = [int(np.searchsorted(-size, -t, side="left")) for t in range(longest)]
        inside = np.ones(n, bool)
        inside[offsets[:-1][np.diff(offsets) > 0]] = False
        seen = np.zeros((2, 2))
        later = np.nonzero(inside)[0]
        np.add.at(seen, (y[later - 1], y[later]), 1)
        m = v = np.zeros(len(self.weights) + 4)
        for step in range(1, steps + 1):
            emission = np.stack((np.zeros(n), x @ self.weights), axis=1)
            forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
            for t in range(longest):
                rows = starts[: lives[t]] + t
                if t == 0:
                    forward[rows] = emission[rows]
                else:
                    forward[rows] = np.logaddexp.reduce(forward[rows - 1][:, :, None] + self.moves[None], axis=1) + emission[rows]
            for t in range(longest - 2, -1, -1):
                rows = starts[: lives[t + 1]] + t
                backward[rows] = np.logaddexp.reduce(self.moves[None] + (emission[rows + 1] + backward[rows + 1])[:, None, :], axis=2)
            both = forward + backward
            total = np.logaddexp.reduce(both, axis=1)
            marginal = np.exp(both[:, 1] - total)
            edge = np.exp(forward[later - 1][:, :, None] + self.moves[None] + (emission[later] + backward[later])[:, None, :] - total[later][:, None, None]).sum(axis=0)
            gradient = np.concatenate(((x.T @ (y - marginal)) / n - ridge * self.weights, ((seen - edge) / n - ridge * self.moves).ravel()))
            m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            self.weights = self.weights + move[: len(self.weights)]
            self.moves = self.moves + move[len(self.weights) :].reshape(2, 2)


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 25, ridge: float = 1e-2) -> np.ndarray:
    """Weights by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(x.shape[1]) * 0.1
        step = np.linalg.solve(h, x.T @ (y - p) / len(y) - ridge * 0.1 * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST_LABELS) -> Field:
    """Fit the field on a bounded sample of labelled texts."""
    sample = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("doc_id"))
        .agg(F.min(F.col(label_col).cast("int")).alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            got = Lines(batch.column("text"))
            x, full = got.features().astype(np.float32), got.line_words > 0
            parts = [x[a:b][full[a:b]].tobytes() for a, b in zip(got.of_doc[:-1], got.of_doc[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(parts, pa.binary())], ["doc_id", "quality", "x"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    # an id may be repeated: its smallest text is learned from, so there are ``most`` texts at most
    once = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, bad, n = [], [], 0
        for batch in batches:
            for q, raw in zip(batch.column("quality").to_pylist(), batch.column("x").to_pylist(), strict=True):
                x = np.frombuffer(raw, np.float32).reshape(-1, len(FEATURES))
                if len(x) and (n + len(x) <= MOST_LINES or not parts):
                    parts.append(x)
                    bad.append(q == 0)
                    n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_lines(parts, np.array(bad)))], pa.binary())], ["field"])

    lined = once.select("doc_id", "quality", "text").mapInArrow(lines, "doc_id long, quality int, x binary")
    row = lined.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").select("quality", "x").mapInArrow(fit, "field binary").first()
    return pickle.loads(row["field"]) if row else Field()


def fit_lines(parts: list[np.ndarray], bad: np.ndarray) -> Field:
    """The field of texts' line features, and which texts are bad."""
    if len(set(bad.tolist())) < 2:
        return Field()
    x, size = np.concatenate(parts).astype(np.float64), np.array([len(p) for p in parts])
    offsets, of_bad = np.concatenate(([0], np.cumsum(size))), np.repeat(bad, size)
    first = logistic(x, of_bad.astype(np.float64))
    y = (of_bad & (x @ first > 0)).astype(np.int64)
    if not y.any():
        return Field()
    field = Field(first.copy())
    field.fit(x, offsets, y)
    return field


def judge(text: pa.Array, field: Field) -> tuple[Lines, np.ndarray, np.ndarray]:
    """Lines, whether the base rules fail, and whether the text is kept."""
    got = Lines(text)
    failed = (got.n_words < 10) | (100 * got.n_repeat_words > 20 * got.n_words)
    full = np.nonzero(got.line_words > 0)[0]
    offsets = np.searchsorted(full, got.of_doc)
    state = field.viterbi(got.features()[full], offsets)
    content = sums_between(np.where(state == 0, got.line_words[full], 0), offsets)
    return got, failed, ~failed & (content >= CONTENT_SHARE * got.n_words)


def report(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)."""
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            got, failed, kept = judge(batch.column("text"), field)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(getattr(got, c), pa.int64()) for c in counts], pa.array(failed), pa.array(kept)], ["doc_id", *counts, "base_failed", "kept"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in counts) + ", base_failed boolean, kept boolean"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that are kept."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            kept = judge(batch.column(text_col), field)[2]
            if kept.any():
                yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, schema)
