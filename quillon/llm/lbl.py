"""Language-model scoring with a log-bilinear model.

The model predicts units: each of the ``HEAD`` most frequent training words is
one, other words fall into ``SUFFIXES`` units by a hash of their last bytes, and the
end of a text is one.  The vectors of the two units before are mapped by a matrix
each to a predicted vector, whose product with a unit's vector, plus the unit's
bias, is its score.  Units lie in ``GROUPS`` groups of similar vectors, which have
vectors and biases of their own; the probability of a unit is that of its group
times its share in it, so two batched matrix products per context give normalised
log-probabilities.  A word's own probability inside a suffix unit is its smoothed
share of the unit's training tokens, so the model is a distribution over words.

Training is by noise-contrastive estimation in numpy.  In each of ``ROUNDS`` rounds
every task trains a copy of the model on the places of its own texts that are the
round's turn, so all places are learned from once, the steps grow with the corpus
and no task sees more than its split; the copies
are averaged, weighted by their places, in two levels of tasks.  After the
first round the units are grouped by halving the set of their vectors.

The passes over the texts: word counts, training rounds, scores.  The counts of
the ``FREQUENT`` most frequent words travel with the code (a fixed bound); the
rarer words of each text, whose frequency is bounded by those, are joined with
the count table on the word.

Edge cases: a null text is empty, that is one end token; a null id is held out;
without training texts all counts are zero and the model is uniform; repeated
rows are scored apart; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bytes_of, encode_dictionary, materialise, remainder, slices, split_words, sums_between, tidy

HEAD, SUFFIXES = 8192, 1023
UNITS = HEAD + SUFFIXES + 1
END = UNITS - 1
GROUPS = 128
FREQUENT = 65_536
DIM, NOISE, BATCH = 24, 64, 512
#: Rounds of training, which share out all places.
ROUNDS = 2
#: Places that are scored together, and rows of one product, which stays in a core's cache.
CONTEXTS, PRODUCT = 1 << 17, 1 << 12
SMOOTH = 0.1


@dataclass
class Model:
    """Unit vectors r and biases b, position matrices c (one per context word),
    group vectors g and biases h, and the group of every unit."""

    r: np.ndarray
    b: np.ndarray
    c: np.ndarray
    g: np.ndarray
    h: np.ndarray
    of: np.ndarray

    @classmethod
    def start(cls, unigram: np.ndarray, seed: int = 7) -> Model:
        r = 0.1 * np.random.default_rng(seed).standard_normal((UNITS, DIM))
        model = cls(r.astype(np.float32), np.log(unigram).astype(np.float32), np.stack([np.eye(DIM, dtype=np.float32) * 0.5] * 2), np.zeros((GROUPS, DIM), np.float32), np.zeros(GROUPS, np.float32), np.arange(UNITS) % GROUPS)
        model.group(unigram)
        return model

    def group(self, unigram: np.ndarray) -> None:
        """Halve the set of units again and again, along its widest direction."""
        parts = [np.arange(UNITS)]
        while len(parts) < GROUPS:
            halves = []
            for part in parts:
                x = self.r[part] - self.r[part].mean(axis=0)
                order = part[np.argsort(x @ np.linalg.eigh((x.T @ x).astype(np.float64))[1][:, -1], kind="stable")]
                halves += [order[: len(order) // 2], order[len(order) // 2 :]]
            parts = halves
        for k, part in enumerate(parts):
            self.of[part] = k
        mass = np.bincount(self.of, unigram, GROUPS)
        self.h = np.log(mass).astype(np.float32)
        self.g = np.stack([np.bincount(self.of, unigram * self.r[:, d], GROUPS) / mass for d in range(DIM)], axis=1).astype(np.float32)

    def parameters(self) -> tuple[np.ndarray, ...]:
        return self.r, self.b, self.c, self.g, self.h

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """What a unit adds to the predicted vector from two places before, and from one."""
        return self.r @ self.c[0], self.r @ self.c[1]

    def logs(self, two: np.ndarray, one: np.ndarray, now: np.ndarray) -> np.ndarray:
        """log10 P(now | two, one) of every place, by matrix products; of places with equal units once."""
        key, at = np.unique((two * UNITS + one) * UNITS + now, return_inverse=True)
        before, now = np.divmod(key, UNITS)
        return self._logs(*np.divmod(before, UNITS), now)[at]

    def _logs(self, two: np.ndarray, one: np.ndarray, now: np.ndarray) -> np.ndarray:
        """The same of places in the order of their contexts."""
        far, near = self.contexts()
        of_groups = np.column_stack((self.g, self.h)).T.copy()
        of_members = [np.column_stack((self.r[m], self.b[m])).T.copy() for m in self.members]
        out = np.zeros(len(now))
        for at in range(0, len(now), CONTEXTS):
            part = slice(at, at + CONTEXTS)
            a, b, unit, got = two[part], one[part], now[part], out[part]
            group, own = self.of[unit], self.place[unit]
            predicted = np.ones((len(unit), DIM + 1), np.float32)  # biases are the tables' last rows
            np.add(far.take(a, axis=0), near.take(b, axis=0), out=predicted[:, :DIM])
            starts = np.flatnonzero(np.concatenate(([True], (np.diff(a) != 0) | (np.diff(b) != 0))))
            ends = np.append(starts[1:], len(unit))
            for k in range(0, len(starts), PRODUCT):
                heads, tails = starts[k : k + PRODUCT], ends[k : k + PRODUCT]
                score = predicted.take(heads, axis=0) @ of_groups
                context, places = np.repeat(np.arange(len(heads)), tails - heads), slice(heads[0], tails[-1])
                got[places] = score[context, group[places]] - _log_sum(score)[context]
            order = np.argsort(group.astype(np.uint8), kind="stable")
            cuts = np.searchsorted(group[order], np.arange(GROUPS + 1))
            for k in np.flatnonzero(np.diff(cuts)):
                for start in range(cuts[k], cuts[k + 1], PRODUCT):
                    places = order[start : min(start + PRODUCT, cuts[k + 1])]
                    score = predicted.take(places, axis=0) @ of_members[k]
                    got[places] += score[np.arange(len(places)), own[places]] - _log_sum(score)
        return out / np.log(10)

    @property
    def members(self) -> list[np.ndarray]:
        if not hasattr(self, "_members"):
            self._members = [np.nonzero(self.of == k)[0] for k in range(GROUPS)]
            self.place = np.zeros(UNITS, np.int64)
            for m in self._members:
                self.place[m] = np.arange(len(m))
        return self._members


def _log_sum(score: np.ndarray) -> np.ndarray:
    """Logarithm of the sum of exponentials of every row, as doubles; the scores stay."""
    with np.errstate(over="ignore"):
        total = np.exp(score) @ np.ones(score.shape[1], np.float32)
    if total.min(initial=1) > 1e-30 and total.max(initial=1) < 1e30:  # else something overflows or vanishes
        return np.log(total.astype(np.float64))
    most = score.max(axis=1, keepdims=True)
    return np.log(np.exp(score - most).sum(axis=1).astype(np.float64)) + most[:, 0]


class Trainer:
    """Noise-contrastive estimation on one copy of the model, with Adagrad.

    A batch shares its noise, drawn from the unigram distribution; an
    unnormalised log-probability, less the log of the expected noise, is
    classified as data or noise.  Units and groups are learned side by side.
    """

    def __init__(self, model: Model, unigram: np.ndarray, seed: int) -> None:
        self.model, self.rng = model, np.random.default_rng(seed)
        # a vector and its bias are one row, so a batch reads and moves both at once
        self.units, self.groups = np.column_stack((model.r, model.b)), np.column_stack((model.g, model.h))
        model.r, model.b, model.g, model.h = self.units[:, :DIM], self.units[:, DIM], self.groups[:, :DIM], self.groups[:, DIM]
        mass = np.bincount(model.of, unigram, GROUPS)
        self.ladder, self.group_ladder = np.cumsum(unigram), np.cumsum(mass)
        self.log_noise, self.log_group = np.log(NOISE * unigram).astype(np.float32), np.log(NOISE * mass).astype(np.float32)
        self.squares = [np.full_like(p, 1e-3) for p in (self.units, self.groups, model.c)]
        self.places = 0

    def step(self, two: np.ndarray, one: np.ndarray, now: np.ndarray, rate: float) -> None:
        with np.errstate(over="ignore"):  # an exponential beyond all numbers is a probability of zero
            self._step(two, one, now, rate)

    def _step(self, two: np.ndarray, one: np.ndarray, now: np.ndarray, rate: float) -> None:
        c, n = self.model.c, len(now)
        self.places += n
        noise, other, group = self._draw(self.ladder), self._draw(self.group_ladder), self.model.of[now]
        # units and groups are told from their noise in the same products
        rows = np.concatenate((now, noise, two, one))
        around, mine = self.units.take(rows, axis=0), self.groups.take(group, axis=0)
        first, second = n + NOISE, 2 * n + NOISE
        own, ra, rb = around[:n], around[first:second, :DIM], around[second:, :DIM]
        others = -np.concatenate((around[n:first], self.groups[other]))
        others[:, DIM] += np.concatenate((self.log_noise[noise], self.log_group[other]))
        predicted = np.ones((n, DIM + 1), np.float32)
        np.add(ra @ c[0], rb @ c[1], out=predicted[:, :DIM])
        false = _inverse(predicted @ others.T)
        data = _inverse(self.log_noise[now] - np.einsum("ij,ij->i", predicted, own))[:, None] - 1
        more = _inverse(self.log_group[group] - np.einsum("ij,ij->i", predicted, mine))[:, None] - 1
        d_pred = data * own[:, :DIM] + more * mine[:, :DIM] - (false @ others)[:, :DIM]
        of_noise = false.T @ predicted
        moves = np.stack((ra.T @ d_pred, rb.T @ d_pred)) / n
        # biases of the units before aren't used, so their part is zero
        gradient = np.zeros((len(rows), DIM + 1), np.float32)
        np.multiply(data, predicted, out=gradient[:n])
        gradient[n:first], gradient[first:second, :DIM], gradient[second:, :DIM] = of_noise[:NOISE], d_pred @ c[0].T, d_pred @ c[1].T
        hit = np.zeros((GROUPS, first), np.float32)
        hit[group, np.arange(n)], hit[other, np.arange(n, first)] = more[:, 0], 1
        _move(self.groups, self.squares[1], hit @ np.concatenate((predicted, of_noise[NOISE:])) / n, rate)
        self._move_units(*_sums_of(rows, gradient), n, rate)
        _move(c, self.squares[2], moves, rate)

    def _draw(self, ladder: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(ladder, self.rng.random(NOISE)), len(ladder) - 1)

    def _move_units(self, rows: np.ndarray, gradient: np.ndarray, n: int, rate: float) -> None:
        gradient /= n
        table, squares = self.units.take(rows, axis=0), self.squares[0].take(rows, axis=0)
        _move(table, squares, gradient, rate)
        self.units[rows], self.squares[0][rows] = table, squares


def _move(table: np.ndarray, squares: np.ndarray, gradient: np.ndarray, rate: float) -> None:
    squares += gradient * gradient
    table -= rate * gradient / np.sqrt(squares)


def _sums_of(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sum of the values of each; most rows are there once and are only copied."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")  # a radix sort, as for all numbers of 16 bits
    rows = rows[order]
    bounds = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1], [True])))
    once = np.diff(bounds) == 1
    alone, firsts = bounds[:-1][once], bounds[:-1][~once]
    repeated = np.ones(len(rows), bool)
    repeated[alone] = False
    sums = values.take(order[alone], axis=0)
    if len(firsts):
        sums = np.concatenate((sums, np.add.reduceat(values.take(order[repeated], axis=0), (np.cumsum(repeated) - 1)[firsts], axis=0)))
    return rows[np.concatenate((alone, firsts))], sums


def _inverse(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)) of float32, in place."""
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


# -------------------------------------------------------------------- units


class Vocabulary:
    """What travels with the code: the frequent words, their counts and places."""

    def __init__(self, words: list[str], counts: list[int]) -> None:
        self.words, self.counts = pa.array(words, pa.large_string()), np.array(counts, dtype=np.int64)

    def find(self, distinct: pa.Array) -> np.ndarray:
        """Place of every word among the frequent ones, or -1."""
        if not len(self.words):
            return np.full(len(distinct), -1, np.int64)
        return pc.fill_null(pc.index_in(distinct, self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def suffix_unit(distinct: pa.Array) -> np.ndarray:
    """Unit of every word by its last three bytes."""
    at, raw = bytes_of(distinct)
    out = np.zeros(len(distinct), np.uint32)
    for k in range(1, 4):
        place = at[1:] - k
        some = place >= at[:-1]
        last = np.zeros(len(distinct), np.uint32)
        last[some] = raw[place[some]]
        out = out * np.uint32(257) + last
    return HEAD + ((out * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64) % SUFFIXES


def units(distinct: pa.Array, place: np.ndarray) -> np.ndarray:
    return np.where((place >= 0) & (place < HEAD), place, suffix_unit(distinct)) if len(distinct) else np.zeros(0, np.int64)


def with_ends(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit sequence with an end after each text, and the two units before each place."""
    n = len(offsets) - 1
    at = offsets + np.arange(n + 1)
    out = np.full(len(codes) + n, END, np.int64)
    inside = np.ones(len(out), bool)
    inside[at[1:] - 1] = False
    out[inside] = codes
    one, two = np.full(len(out), END, np.int64), np.full(len(out), END, np.int64)
    one[1:], two[2:] = out[:-1], out[:-2]
    one[at[:-1]] = END
    two[at[:-1]] = END
    second = at[:-1] + 1
    second = second[second < at[1:]]
    two[second] = END
    return out, one, two


# -------------------------------------------------------------------- passes


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    held = F.coalesce(remainder(id_col, 10) == 0, F.lit(True)).alias("held_out")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held, F.col(text_col).cast("string").alias("text"))


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n, class) of all training words, in the shared folder."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in slices(batches, "text"):
            _, flat = split_words(batch.column("text"), lower=True)
            got = pc.value_counts(flat)
            held.append(pa.table({"word": got.field("values"), "n": got.field("counts")}))
            if sum(t.num_rows for t in held) > 600_000:
                held = [_merged(held)]
                if held[0].num_rows > 300_000:
                    yield from held.pop().to_batches()
        if held:
            yield from _merged(held).to_batches()

    counted = texts.where("not held_out").select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return materialise(counted, "lbl-counts")


def _merged(parts: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("n", "sum")])
    return pa.table({"word": out["word"].cast(pa.string()).combine_chunks(), "n": out["n_sum"].combine_chunks()})


def unit_sums(counts: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Training tokens and distinct words of every unit, [UNITS, 2]."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(UNITS, np.int64), np.zeros(UNITS, np.int64)
        for batch in batches:
            words = batch.column("word").cast(pa.large_string())
            of = units(words, vocabulary.find(words))
            n += np.bincount(of, batch.column("n").to_numpy(zero_copy_only=False), UNITS).astype(np.int64)
            v += np.bincount(of, minlength=UNITS)
        full = np.nonzero(v)[0]
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(n[full]), pa.array(v[full])], ["unit", "n", "v"])

    out = np.zeros((UNITS, 2), np.int64)
    for r in counts.mapInArrow(add, "unit long, n long, v long").groupBy("unit").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():  # at most UNITS rows
        out[r["unit"]] = r["n"], r["v"]
    return out


def averaged(copies: DataFrame, model: Model) -> Model:
    """The mean of the rows (block, part, places, values), weighted by places.

    Blocks are averaged apart, first among a 64th of the parts each, so a task holds
    a running sum of one block."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, places, total = 0, 0, None
        for batch in batches:
            for k, n, values in zip(*(batch.column(c).to_pylist() for c in ("block", "places", "values")), strict=True):
                x = np.frombuffer(values, np.float32).astype(np.float64) * n
                block, places, total = k, places + n, x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([0], pa.int32()), pa.array([places], pa.int64()), pa.array([(total / max(1, places)).astype(np.float32).tobytes()], pa.binary())], ["block", "part", "places", "values"])

    schema = "block int, part int, places long, values binary"

    def grouped(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return add(batches)

    some = copies.withColumn("part", F.pmod("part", F.lit(64))).groupBy("block", "part").applyInArrow(grouped, schema)
    whole = {r["block"]: r["values"] for r in some.groupBy("block").applyInArrow(grouped, schema).collect()}  # one row for each block of the model
    if not whole:
        return model
    flat, at, out = np.concatenate([np.frombuffer(whole[k], np.float32) for k in sorted(whole)]), 0, []
    for p in model.parameters():
        out.append(flat[at : at + p.size].reshape(p.shape).copy())
        at += p.size
    return Model(*out, model.of)


#: Numbers of the model that are averaged together.
BLOCK = 1 << 15


def turn(seen: int, n: int, at_round: int) -> np.ndarray:
    """Of the ``n`` places behind the first ``seen`` ones of a task, those that are a round's turn; each is the turn of one round."""
    return np.arange((at_round - seen) % ROUNDS, n, ROUNDS)


def fitted(texts: DataFrame, vocabulary: Vocabulary, unigram: np.ndarray) -> Model:
    """The model after ``ROUNDS`` rounds over the training texts."""
    model = Model.start(unigram)

    def trained(at_round: int, model: Model):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            copy = Model(*[p.copy() for p in model.parameters()], model.of)
            trainer = Trainer(copy, unigram, 1000 * part + at_round)
            seen = 0
            for batch in slices(batches, "text"):
                offsets, flat = split_words(batch.column("text"), lower=True)
                codes, distinct = encode_dictionary(flat)
                now, one, two = with_ends(units(distinct, vocabulary.find(distinct))[codes], offsets)
                chosen = turn(seen, len(now), at_round)
                seen += len(now)
                trainer.rng.shuffle(chosen)
                for k in range(0, len(chosen), BATCH):
                    at = chosen[k : k + BATCH]
                    trainer.step(two[at], one[at], now[at], 0.1 / (1 + at_round))
            if trainer.places:
                flat = np.concatenate([p.ravel() for p in copy.parameters()]).astype(np.float32)
                blocks = [flat[k : k + BLOCK].tobytes() for k in range(0, len(flat), BLOCK)]
                n = len(blocks)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array([part] * n, pa.int32()), pa.array([trainer.places] * n, pa.int64()), pa.array(blocks, pa.binary())], ["block", "part", "places", "values"])

        return run

    learned = texts.where("not held_out").select("text")
    for k in range(ROUNDS):
        model = averaged(learned.mapInArrow(trained(k, model), "block int, part int, places long, values binary"), model)
        if k == 0:
            model.group(unigram)
    return model


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row."""
    with tidy(docs.sparkSession):
        return materialise(_score(_texts(docs, id_col, text_col)), "lbl-scores", keep=True)


def _score(texts: DataFrame) -> DataFrame:
    counts = count_words(texts)
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n_ends = texts.where("not held_out").count()
    head = counts.orderBy(F.desc("n"), "word").limit(FREQUENT).toArrow()
    vocabulary = Vocabulary(head["word"].to_pylist(), head["n"].to_pylist())
    n_all, v_all = (sums["n"] or 0) + n_ends, sums["v"] + (n_ends > 0)
    by_unit = unit_sums(counts, vocabulary)
    tokens = by_unit[:, 0].astype(np.float64)
    tokens[END] = n_ends
    model = fitted(texts, vocabulary, (tokens + SMOOTH) / (tokens.sum() + SMOOTH * UNITS))

    base_all = float(np.log10(n_all + SMOOTH * (v_all + 1)))
    # log10 of a suffix unit's mass: its tokens, smoothed, and one unknown word
    mass = np.log10(by_unit[:, 0] + SMOOTH * (by_unit[:, 1] + 1))
    log_head = np.log10(vocabulary.counts + SMOOTH)
    log_end, n_frequent = float(np.log10(n_ends + SMOOTH)), len(vocabulary.counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in slices(batches, "text"):
            n = batch.num_rows
            offsets, flat = split_words(batch.column("text"), lower=True)
            codes, distinct = encode_dictionary(flat)
            place = vocabulary.find(distinct)
            of = units(distinct, place)
            now, one, two = with_ends(of[codes], offsets)
            chain = sums_between(model.logs(two, one, now), offsets + np.arange(n + 1))
            # inside a unit: words of the head are alone in theirs, the end as well
            log_count = np.where(place >= 0, log_head[place], 0.0) if n_frequent else np.zeros(len(distinct))
            base_part = sums_between(log_count[codes], offsets)
            alone = (place >= 0) & (place < HEAD)
            own_part = sums_between(np.where(alone, 0.0, log_count - mass[of])[codes], offsets)
            known = sums_between((place >= 0).astype(np.int64)[codes], offsets)
            # rare words of each text, once each with their count
            rare = np.nonzero(place[codes] < 0)[0] if len(codes) else np.zeros(0, np.int64)
            doc = np.searchsorted(offsets, rare, side="right") - 1
            keys, times = np.unique(doc * max(1, len(distinct)) + codes[rare], return_counts=True)
            owner, word = keys // max(1, len(distinct)), keys % max(1, len(distinct))
            at = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
            pairs = pa.StructArray.from_arrays([distinct.take(pa.array(word)).cast(pa.string()), pa.array(times, pa.int64())], ["word", "times"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row + np.arange(n)), batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(offsets) + 1),
                    pa.array(known + (n_ends > 0)), pa.array(base_part + log_end), pa.array(own_part + chain), pa.ListArray.from_arrays(pa.array(at), pairs),
                ],
                ["row", "doc_id", "held_out", "n_tokens", "known", "base", "own", "rare"],
            )
            row += n

    schema = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, own double, rare array<struct<word:string,times:long>>"
    scored = materialise(texts.mapInArrow(run, schema), "lbl-scored")
    least = int(vocabulary.counts[-1]) if n_frequent == FREQUENT else 0
    tail = counts.where(F.col("n") <= least) if least else counts.where("false")
    rare = (
        scored.select("row", F.explode("rare").alias("x"))
        .select("row", F.col("x.word").alias("word"), F.col("x.times").alias("times"))
        .join(tail, "word", "left")
        .groupBy("row")
        .agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(SMOOTH))).alias("logs"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("found"))
    )
    logs = F.coalesce("logs", F.lit(0.0))
    return (
        scored.drop("rare")
        .join(rare, "row", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("known") + F.coalesce("found", F.lit(0))).cast("long").alias("n_known"),
            F.lit(int(n_all)).cast("long").alias("train_tokens"),
            (F.col("base") + logs - F.col("n_tokens") * F.lit(base_all)).alias("base_score"),
            (F.col("own") + logs).alias("score"),
        )
    )
