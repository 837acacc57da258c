"""Toxicity: gradient-boosted trees over dense features, calibrated isotonically.

Labels come from a bounded sample of labelled rows (``MOST_LABELS`` ids, taken by a
hash of the id, one text each).  From the toxic ones a lexicon is learned: words and word stems
(prefixes) that occur in many different toxic texts and are far rarer in the
others; support counts distinct min-hash signatures, so a text copied fifty
times is one witness.  Features are densities of lexicon words and stems, their
proximity to second-person words, rates of capitals, punctuation, symbols,
digits and obfuscated spellings, and length.  Trees are grown in numpy on
histograms; rows of one fold, which neither lexicon nor trees have seen, calibrate
the scores with pool-adjacent violators.
Every text is scored as a whole in one pass that never leaves its partition.

Edge cases: a null text is empty; empty texts have zero features and get the
score those earn; ids that are null or held out are never learned from;
repeated label rows count as toxic if any of them does; without usable labels
of both kinds every score is 0; extra columns are ignored.
"""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bytes_of, encode_dictionary, materialise, plain, remainder, slices, split_words, sums_between, tidy

#: Labelled rows that are learned from, at most; they bound the lexicon, too.
MOST_LABELS = 20_000
#: Share of toxic signatures that must hold a term, its least count, and its least lift.
SUPPORT, LEAST, LIFT = 0.02, 3, 8.0
STEMS = (4, 5, 6, 7, 8)
#: Log lift from which a term counts as strong.
STRONG = 4.0
THRESHOLD = 0.3
# Second-person words of the four languages.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch euer tu toi te ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
# Look-alike characters of obfuscated spellings.
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
EDGES = " .,;:!?\"'()[]{}<>|*#$%&@~`^_-+=/\\…«»“”‘’¡¿"
OBFUSCATED = re.compile(r"[^\W\d_][\d@$*#!|.\-_]+[^\W\d_]")
FEATURES = ("length", "strong", "weak", "strong_count", "weak_count", "kinds", "weight", "person", "near_person", "capitals", "punctuation", "exclamation", "question", "symbols", "digits", "obfuscated", "capital_words")


def normal(word: str) -> str:
    """A lower-case word without edge punctuation, look-alikes undone if it holds letters."""
    word = word.strip(EDGES)
    return word.translate(LOOKALIKE) if not word.isalpha() and any(c.isalpha() for c in word) else word


def terms_of(word: str) -> list[str]:
    """The word itself and its stems, marked with a leading ^."""
    return [word, *["^" + word[:k] for k in STEMS if len(word) > k]] if len(word) > 2 else []


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)
    edges: list[np.ndarray] = field(default_factory=list)  # bin edges of each feature
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # feature, bin, leaf values
    base: float = 0.0
    knots: tuple[np.ndarray, np.ndarray] = (np.zeros(1), np.zeros(1))


def features(text: pa.Array, lexicon: dict[str, float]) -> np.ndarray:
    """One row of FEATURES per text."""
    text = plain(text)
    at, raw = bytes_of(text)
    at, raw = at - at[0], raw[at[0] : at[-1]]
    n = len(text)

    def count(table: np.ndarray) -> np.ndarray:
        out = np.zeros(n, np.int64)
        some = at[1:] > at[:-1]
        if some.any():
            out[some] = np.add.reduceat(table[raw], at[:-1][some], dtype=np.int64)
        return out

    def of(chars: str) -> np.ndarray:
        table = np.zeros(256, np.uint8)
        table[[ord(c) for c in chars]] = 1
        return table

    upper, lower = of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), of("abcdefghijklmnopqrstuvwxyz")
    capitals, letters = count(upper), count(upper | lower)
    size = np.maximum(1, at[1:] - at[:-1])

    offsets, flat = split_words(text)
    words = np.maximum(1, offsets[1:] - offsets[:-1])
    codes, distinct = encode_dictionary(flat)
    table = np.zeros((len(distinct), 6))  # strong, weak, weight, person, obfuscated, capitals
    gate = {t.lstrip("^")[:3] for t in lexicon}
    for k, word in enumerate(distinct.to_pylist()):
        low = normal(word.lower())
        if low[:3] in gate and (weight := max((lexicon.get(t, 0.0) for t in terms_of(low)), default=0.0)):
            table[k, :3] = weight >= STRONG, weight < STRONG, weight
        table[k, 3] = low in SECOND_PERSON
        table[k, 5] = len(word) > 2 and word.isupper()
        if not word.isalpha() and OBFUSCATED.search(word.strip(EDGES)):
            table[k, 4] = 1
    hit = table[:, 0] > 0
    sums = [sums_between(table[codes, k], offsets) for k in range(6)] if len(codes) else [np.zeros(n)] * 6
    places = np.nonzero(hit[codes])[0] if len(codes) else np.zeros(0, np.int64)
    doc = np.searchsorted(offsets, places, side="right") - 1
    hits = np.bincount(doc, minlength=n)
    pairs = np.unique(np.stack((doc, codes[places])), axis=1) if len(places) else np.zeros((2, 0), np.int64)
    kinds = np.bincount(pairs[0], minlength=n)
    person = np.concatenate(([0], np.cumsum(table[codes, 3]))) if len(codes) else np.zeros(1)
    near = person[np.minimum(places + 6, offsets[doc + 1])] - person[np.maximum(places - 5, offsets[doc])] > 0
    near_person = np.bincount(doc[near], minlength=n)
    columns = (
        np.log1p(offsets[1:] - offsets[:-1]), sums[0] / words, sums[1] / words, np.log1p(hits), np.log1p(sums[1]), np.log1p(kinds), sums[2] / np.sqrt(words), sums[3] / words, near_person / words,
        capitals / np.maximum(1, letters), count(of(".,;:'\"()-")) / size, count(of("!")) / size, count(of("?")) / size, count(of("#*$%&|<>@")) / size, count(of("0123456789")) / size, sums[4] / words, sums[5] / words,
    )
    return np.stack(columns, axis=1)


# -------------------------------------------------------------------- trees


def grow(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.2, penalty: float = 1.0, bins: int = 32) -> Model:
    """Boosted trees of fixed depth with logistic loss, split by histograms."""
    model = Model()
    model.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(model.edges)], axis=1)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model.base = math.log(share / (1 - share))
    score = np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        split_on, split_at = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, bins, np.int64)
        for level in range(depth):
            m, first = 2**level, 2**level - 1
            best = np.full(m, 1e-9)
            for k in range(x.shape[1]):
                cell = node * bins + binned[:, k]
                gs = np.bincount(cell, g, m * bins).reshape(m, bins).cumsum(axis=1)
                hs = np.bincount(cell, h, m * bins).reshape(m, bins).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + penalty) + (gt - gs) ** 2 / (ht - hs + penalty) - gt**2 / (ht + penalty)
                gain[(hs < 1) | (ht - hs < 1)] = 0
                at = gain.argmax(axis=1)
                value = gain[np.arange(m), at]
                better = value > best
                best[better] = value[better]
                split_on[first : first + m][better], split_at[first : first + m][better] = k, at[better]
            node = node * 2 + (binned[np.arange(len(y)), split_on[first + node]] > split_at[first + node])
        leaf = rate * np.bincount(node, g, 2**depth) / (np.bincount(node, h, 2**depth) + penalty)
        model.trees.append((split_on, split_at, leaf))
        score += leaf[node]
    return model


def margin(model: Model, x: np.ndarray) -> np.ndarray:
    binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(model.edges)], axis=1)
    out, rows = np.full(len(x), model.base), np.arange(len(x))
    for split_on, split_at, leaf in model.trees:
        node = np.zeros(len(x), np.int64)
        for level in range(int(math.log2(len(leaf)))):
            first = 2**level - 1
            node = node * 2 + (binned[rows, split_on[first + node]] > split_at[first + node])
        out += leaf[node]
    return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit (pool adjacent violators)."""
    xs, where = np.unique(x, return_inverse=True)
    sums, sizes = np.bincount(where, y), np.bincount(where)
    blocks: list[list[float]] = []  # sum, size, first x, last x
    for s, n, v in zip(sums, sizes, xs, strict=True):
        blocks.append([s, n, v, v])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    knots = [(v, s / n) for s, n, a, b in blocks for v in ((a, b) if b > a else (a,))]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


def predict(model: Model, text: pa.Array) -> np.ndarray:
    if not model.trees:
        return np.zeros(len(text))
    return np.clip(np.interp(margin(model, features(text, model.lexicon)), *model.knots), 0.0, 1.0)


# ----------------------------------------------------------------- training


def _signed_terms(batch: pa.RecordBatch) -> Iterator[tuple[int, set[str]]]:
    """(min-hash signature, normal words) of every text."""
    for text in batch.column("text").to_pylist():
        words = {normal(w) for w in (text or "").lower().split()}
        yield min((xxhash.xxh64_intdigest(w) >> 1 for w in words), default=0), words


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MOST_LABELS) -> Model:
    """Fit on labelled rows whose crc32(id) mod 4 is not 2.

    Rows with 0 and 3 give the lexicon and the trees; rows with 1 have no part in
    either and only calibrate, so the knots are fitted on margins of unseen texts.
    """
    with tidy(docs.sparkSession):
        return _train(docs, labels, id_col, text_col, label_col, most)


def _train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> Model:
    fold = remainder(id_col, 4)
    sample = (
        labels.where(F.col(label_col).isNotNull())
        .select(F.col(id_col).cast("long").alias("doc_id"), fold.alias("fold"), F.col(label_col).cast("int").alias("toxic"))
        .where("fold <> 2")
        .groupBy("doc_id", "fold")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # an id may be repeated: its smallest text is learned from, so there are ``most`` rows at most
    rows = materialise(rows.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "fold", "toxic").agg(F.min("text").alias("text")), "toxic-labelled")

    def toxic_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            got = list(_signed_terms(batch))
            out = {("", s) for s, _ in got}
            for s, words in got:
                out.update((t, s) for w in words for t in terms_of(w))
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in out], pa.string()), pa.array([s for _, s in out], pa.int64())], ["term", "signature"])

    counted = materialise(rows.where("toxic = 1 and fold <> 1").select("text").mapInArrow(toxic_terms, "term string, signature long").distinct().groupBy("term").agg(F.count("*").alias("n")), "toxic-terms")
    n_toxic = (counted.where("term = ''").first() or {"n": 0})["n"]
    least = max(LEAST, SUPPORT * n_toxic)
    support = {r["term"]: r["n"] for r in counted.where((F.col("term") != "") & (F.col("n") >= least)).orderBy(F.desc("n"), "term").collect()}

    def clean_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts: dict[str, int] = {}
            for _, words in _signed_terms(batch):
                for t in {t for w in words for t in terms_of(w)}:
                    if t in support:
                        counts[t] = counts.get(t, 0) + 1
            counts[""] = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

    clean = {r["term"]: r["n"] for r in rows.where("toxic = 0 and fold <> 1").select("text").mapInArrow(clean_terms, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n_clean = max(1, clean.pop("", 0))
    lift = {t: (n / n_toxic) / ((clean.get(t, 0) + 0.5) / n_clean) for t, n in support.items()}
    lexicon = {t: math.log(v) for t, v in lift.items() if v >= LIFT}

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = features(batch.column("text"), lexicon)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("fold"), batch.column("toxic"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "fold", "toxic", "x"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        x = np.array(table["x"].to_pylist(), dtype=np.float64).reshape(table.num_rows, len(FEATURES))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_dense(x, table["toxic"].to_numpy().astype(np.float64), table["fold"].to_numpy() == 1))], pa.binary())], ["model"])

    dense_rows = rows.select("doc_id", "text", F.col("fold").cast("long").alias("fold"), "toxic").mapInArrow(dense, "doc_id long, fold long, toxic int, x array<double>")
    row = dense_rows.repartition(1).sortWithinPartitions("doc_id").mapInArrow(fit, "model binary").first()
    model = pickle.loads(row["model"]) if row else Model()
    model.lexicon = lexicon if model.trees else {}
    return model


def fit_dense(x: np.ndarray, y: np.ndarray, hold: np.ndarray) -> Model:
    """Trees on the rows that aren't held back, calibrated on those that are."""
    if len(set(y[~hold].tolist())) < 2:
        return Model()
    model = grow(x[~hold], y[~hold])
    hold = hold if len(set(y[hold].tolist())) == 2 else np.ones(len(y), bool)
    model.knots = isotonic(margin(model, x[hold]), y[hold])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            s = predict(model, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(remainder(id_col, 4) == 2, F.lit(True)).alias("held_out")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held, F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, that score below the threshold."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            keep = predict(model, batch.column(text_col)) < threshold
            if keep.any():
                yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, schema)
