"""The language model learns from every place of the training texts, once."""

import time

import numpy as np

from quillon.llm import lbl


def test_rounds_share_out_all_places():
    sizes, seen, learned = [5, 0, 1, 8, 3, 7], 0, []
    for n in sizes:
        learned += [seen + p for k in range(lbl.ROUNDS) for p in lbl.turn(seen, n, k)]
        seen += n
    assert sorted(learned) == list(range(sum(sizes)))


def test_all_training_places_are_learned_from(spark, monkeypatch):
    """The averaged copies are weighted by their places; their sum over the rounds is the number of training tokens."""
    rows = [(k, "a b c d " * (k % 7 + 1)) for k in range(60)] + [(60, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counted, averaged = [], lbl.averaged

    def counting(parts, model):
        counted.append(sum(r["places"] for r in parts.where("block = 0").select("places").collect()))
        return averaged(parts, model)

    monkeypatch.setattr(lbl, "averaged", counting)
    out = lbl.score(docs).collect()
    assert sum(counted) == out[0]["train_tokens"] == sum(r["n_tokens"] for r in out if not r["held_out"])
    assert np.isfinite([r["score"] for r in out]).all()


def test_equal_places_are_scored_once(monkeypatch):
    rng = np.random.default_rng(3)
    model = lbl.Model.start(rng.random(lbl.UNITS) / lbl.UNITS)
    two, one, now = (rng.integers(0, 4, 500) for _ in range(3))
    seen, logs = [], lbl.Model._logs
    monkeypatch.setattr(lbl.Model, "_logs", lambda self, *units: seen.append(len(units[0])) or logs(self, *units))
    got = model.logs(two, one, now)
    assert seen == [64]
    monkeypatch.undo()
    assert np.allclose(got, [model.logs(two[k : k + 1], one[k : k + 1], now[k : k + 1])[0] for k in range(500)], atol=1e-5)
    assert len(model.logs(two[:0], one[:0], now[:0])) == 0


class Plain(lbl.Trainer):
    """The step with every gradient on its own."""

    def step(self, two, one, now, rate):
        c, n, d = self.model.c, len(now), lbl.DIM
        noise = self._draw(self.ladder)
        around = self.units[np.concatenate((two, one))]
        ra, rb = around[:n, :d], around[n:, :d]
        predicted = np.ones((n, d + 1), np.float32)
        predicted[:, :d] = ra @ c[0] + rb @ c[1]
        group, other = self.model.of[now], self._draw(self.group_ladder)
        d_pred, of_units = self.apart(self.units, self.log_noise, predicted, now, noise)
        more, of_groups = self.apart(self.groups, self.log_group, predicted, group, other)
        d_pred = (d_pred + more)[:, :d]
        moves = np.stack((ra.T @ d_pred, rb.T @ d_pred)) / n
        before = np.zeros((2 * n, d + 1), np.float32)
        before[:n, :d], before[n:, :d] = d_pred @ c[0].T, d_pred @ c[1].T
        hit = np.zeros((lbl.GROUPS, n + lbl.NOISE), np.float32)
        hit[np.concatenate((group, other)), np.arange(n + lbl.NOISE)] = 1
        self.move(self.groups, self.squares[1], slice(None), hit @ np.concatenate(of_groups) / n, rate)
        rows = np.concatenate((now, noise, two, one))
        order = np.argsort(rows.astype(np.uint16), kind="stable")
        rows = rows[order]
        starts = np.concatenate(([0], np.nonzero(np.diff(rows))[0] + 1))
        self.move(self.units, self.squares[0], rows[starts], np.add.reduceat(np.concatenate((*of_units, before))[order], starts, axis=0) / n, rate)
        self.move(c, self.squares[2], slice(None), moves, rate)

    @staticmethod
    def apart(table, log_noise, predicted, now, noise):
        own, others = table[now], table[noise]
        data = 1 / (1 + np.exp(-np.maximum(np.einsum("ij,ij->i", predicted, own) - log_noise[now], -30)))[:, None] - 1
        false = 1 / (1 + np.exp(-np.maximum(predicted @ others.T - log_noise[noise], -30)))
        return data * own + false @ others, (data * predicted, false.T @ predicted)

    @staticmethod
    def move(table, squares, rows, gradient, rate):
        seen = squares[rows] + gradient * gradient
        squares[rows] = seen
        table[rows] -= rate * gradient / np.sqrt(seen)


def test_a_step_is_the_plain_one_and_cheaper():
    rng = np.random.default_rng(5)
    unigram = 1 / np.arange(10, lbl.UNITS + 10)
    unigram /= unigram.sum()
    plain, own = (kind(lbl.Model.start(unigram), unigram, 1) for kind in (Plain, lbl.Trainer))
    took = {plain: [], own: []}
    for _ in range(60):
        places = rng.choice(lbl.UNITS, (5, 3, lbl.BATCH), p=unigram)
        for trainer in (plain, own):
            began = time.process_time()
            for two, one, now in places:
                trainer.step(two, one, now, 0.1)
            took[trainer].append(time.process_time() - began)
    for a, b in zip(plain.model.parameters(), own.model.parameters(), strict=True):
        assert np.allclose(a, b, atol=1e-4)
    assert np.median(took[own]) < 0.87 * np.median(took[plain])
