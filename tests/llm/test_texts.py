"""Operators on texts against brute force, exact round trips and held-out accuracy."""

import base64
import collections
import hashlib
import math
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quillon.llm import bpe, lbl, line_crf, queries, simhash, token_files, toxicity, warc

from .test_queries import AWKWARD, DOCS, awkward, empty  # noqa: F401


def crc_mod(i, m):
    return zlib.crc32(str(i).encode()) % m


@pytest.fixture(scope="module")
def docs(spark, folder):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


# --------------------------------------------------------------- SimHash


def fingerprint(text, width=4):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + width]), 42) for k in range(max(1, len(w) - width + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closed(ids, linked):
    least = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i, j in linked:
            low = min(least[i], least[j])
            if least[i] != low or least[j] != low:
                least[i] = least[j] = low
                changed = True
    return least


def test_simhash_equals_brute_force(spark, folder, docs):
    rows = queries.op3_simhash(spark, folder).collect()
    prints = {i: fingerprint(r["text"]) for i, r in docs.items()}
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {i: f"{p:016x}" for i, p in prints.items()}
    ids = sorted(prints)
    linked = [(i, j) for k, i in enumerate(ids) for j in ids[k + 1 :] if (prints[i] ^ prints[j]).bit_count() <= 4]
    assert {r["doc_id"]: r["component_id"] for r in rows} == closed(ids, linked)


@pytest.mark.parametrize(("max_bits", "blocks"), [(4, 3), (4, 2), (3, 3), (7, 3)])
def test_trees_lose_no_pair(spark, max_bits, blocks, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 32)
    monkeypatch.setattr(simhash, "CHUNK", 64)
    rng = random.Random(max_bits)
    points = {rng.getrandbits(64) for _ in range(700)}
    for p in list(points)[:300]:
        for b in rng.sample(range(64), rng.randrange(1, max_bits + 3)):
            p ^= 1 << b
        points.add(p)
    points = sorted(points)
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    forest = simhash.grow_forest(frame, max_bits, blocks)
    assert all(t.leaves > 1 for t in forest)
    found = [(r["src"], r["dst"]) for r in simhash.links(frame, max_bits, blocks).collect()]
    want = [(a, b) for k, a in enumerate(signed) for b in signed[k + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= max_bits]
    assert closed(signed, found) == closed(signed, want)


def test_simhash_on_awkward_rows(spark, awkward, empty):  # noqa: F811
    rows = simhash.groups(awkward).collect()
    assert len(rows) == len(AWKWARD)
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["fp"] == by[3]["fp"] == 0
    assert by[1]["component_id"] == by[None]["component_id"] == by[-7]["component_id"] == -7
    assert simhash.groups(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = {}
    for g in range(30):
        base = [word() for _ in range(rng.choice([30, 80, 200]))]
        for c in range(4):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5]) * len(base) // 200 + (c == 3)):
                copy[rng.randrange(len(copy))] = word()
            texts[g * 10 + c] = " ".join(copy)
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in texts.items()}
    similar = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    ids = sorted(texts)
    want = closed(ids, [(i, j) for k, i in enumerate(ids) for j in ids[k + 1 :] if similar(i, j) >= 0.8])
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts.items()], DOCS)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(frame, max_bits=20).collect()}
    assert {i: want[i] for i in got} == got
    assert set(got.values()) == set(want.values())


def test_near_duplicates_of_one_id(spark):
    import corpus_pipeline

    same, other = "one two three four five six seven", "another text that has nothing to do with it"
    rows = [(5, same, "en", "a", 1), (5, same + ".", "en", "b", 1), (5, other, "en", "c", 1), (5, other, "en", "c", 1), (7, same, "en", "d", 1), (7, other + "!", "en", "e", 1), (None, same, "en", "f", 1), (8, None, "en", "g", 1), (9, "", "en", "h", 1)]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == sorted([(5, same), (5, same + "."), (5, other), (7, other + "!"), (0, same), (8, "")])


def test_prefixes_and_sketches_keep_every_similar_pair(spark):
    rng = np.random.default_rng(11)
    for n in (1, 2, 9, 60, 700):
        a = np.unique(rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32))
        b = np.unique(np.concatenate((a[len(a) // 9 :], rng.integers(0, 1 << 32, n // 10, dtype=np.uint64).astype(np.uint32))))
        apart = len(np.setxor1d(a, b))
        x, y = simhash.sketch(a).view(np.uint64), simhash.sketch(b).view(np.uint64)
        assert int(np.bitwise_count(x ^ y).sum()) <= apart


@pytest.mark.parametrize("bits", [{}, {"max_bits": 0}])
def test_near_duplicates_lose_no_pair(spark, bits):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = {}
    for g in range(120):
        base = [word() for _ in range(rng.choice([1, 12, 31, 84]))]
        texts[g * 10] = " ".join(base)
        texts[g * 10 + 1] = " ".join(base + [word()] * 20)
        texts[g * 10 + 2] = " ".join(base[: len(base) - len(base) // 12] + [word() for _ in range(len(base) // 12)])
        texts[g * 10 + 3] = " ".join(["all pages begin with these same words and go on"] + base)
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in texts.items()}
    ids = sorted(texts)
    pairs = [(i, j) for k, i in enumerate(ids) for j in ids[k + 1 :] if i // 10 == j // 10 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    far = sum((fingerprint(texts[i], 5) ^ fingerprint(texts[j], 5)).bit_count() > 16 for i, j in pairs)
    assert far > 20
    want = closed(ids, pairs)
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts.items()], DOCS)
    got = simhash.near_duplicates(frame, **bits).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {r["doc_id"]: want[r["doc_id"]] for r in got}
    assert {r["component_id"] for r in got} == set(want.values())


def test_sets_meet_where_their_own_sizes_allow_it(spark):
    """Of two sets of 900 and one of 720, the first places are 183; two of 900 can be similar only if they share one before 103."""
    rows = [(1, 0, 10, 900), (1, 1, 10, 900), (2, 0, 102, 900), (2, 1, 102, 900), (3, 0, 103, 900), (3, 1, 90, 900), (4, 0, 150, 900), (4, 2, 2, 720), (5, 0, 150, 900), (5, 2, 60, 720)]
    frame = spark.createDataFrame([(s, v, p, n, v, *[0] * simhash.SKETCH) for s, v, p, n in rows], "shingle int, v long, place int, size int, component long, " + ", ".join(f"s{k} long" for k in range(simhash.SKETCH)))
    assert sorted((r["src"], r["dst"], r["i"], r["j"]) for r in simhash.meetings(frame, 0.8).collect()) == [(0, 1, 10, 10), (0, 1, 102, 102), (0, 2, 150, 2)]


# ------------------------------------------------------------------ WARC


def test_warc_record_round_trip():
    for page, refers, revisit in ((5, None, False), (-5, None, False), (None, 3, True)):
        got = warc.parse_record(warc.build_record(page, "http://a.b/x y\r\nz", b"\r\n\r\nhi", "d", refers, revisit))
        assert warc.page_of(got["headers"]["WARC-Record-ID"]) == page
        assert got["payload"] == (b"" if revisit else b"\r\n\r\nhi")
        assert got["length"] == 6
        if revisit:
            assert warc.page_of(got["headers"]["WARC-Refers-To"]) == 3


@pytest.mark.parametrize(("url", "key"), [("http://www.A.org:80/x?y", "org,a,www)/x?y"), ("https://a.b", "b,a)/"), ("http://a:8080/", "a:8080)/"), (None, ""), ("no url", "no%20url"), ("http://[bad", "http://[bad")])
def test_url_key(url, key):
    assert warc.url_key(url) == key


def test_warc_on_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    long = "<p>" + "x" * 200
    rows = [(1, "http://a.b/1", long), (2, "http://a.b/1", long), (2, "http://a.b/1", long), (3, None, None), (4, "", ""), (None, "http://a.b/\t", long), (5, "http://a.b/2", "short"), (6, "http://a.b/2", "short")]
    rows += [(100 + k, f"http://h{k % 3}.c/{k}", f"<b>{k}" * 50) for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    out = warc.read_back(pages, warc.write_index(warc.write_archives(pages))).collect()
    got = collections.Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in out)
    first = {}
    for i, _, h in rows:
        if h and len(h) >= 100 and i is not None:
            first[h] = min(i, first.get(h, i))
    want = collections.Counter()
    for i, _, h in rows:
        ref = first.get(h) if h and len(h) >= 100 and first.get(h) != i else None
        want[(i, "revisit" if ref is not None else "response", ref, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest())] += 1
    assert got == want
    assert all(r["html"] == (dict((a, c) for a, _, c in rows)[r["page_id"]] or "") for r in out if r["record_type"] == "response" and r["page_id"] is not None)
    none = pages.limit(0)
    assert warc.read_back(none, warc.write_index(warc.write_archives(none))).count() == 0


# ---------------------------------------------------------------- quality


def base_counts(text):
    w = [x.decode() for x in (text or "").encode().split()]
    windows = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {q for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for q in range(k, k + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_quality_counts_and_accuracy(spark, folder, docs):
    rows = queries.op5_quality_crf(spark, folder).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    right = []
    for r in rows:
        counts = base_counts(docs[r["doc_id"]]["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts
        assert r["base_failed"] == (counts[0] < 10 or 100 * counts[4] > 20 * counts[0])
        assert not (r["base_failed"] and r["kept"])
        if r["doc_id"] in labels and not r["base_failed"]:
            right.append(r["kept"] == (labels[r["doc_id"]] == 1))
    assert np.mean(right) > 0.9


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(1)
    field = line_crf.Field(rng.standard_normal(len(line_crf.FEATURES)), rng.standard_normal((2, 2)))
    sizes = [0, 1, 4, 6, 0, 3]
    x, offsets = rng.standard_normal((sum(sizes), len(line_crf.FEATURES))), np.concatenate(([0], np.cumsum(sizes)))
    state = field.viterbi(x, offsets)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        e = x[a:b] @ field.weights
        value = lambda s, e=e: sum(v * q for v, q in zip(e, s, strict=True)) + sum(field.moves[p, q] for p, q in zip(s[:-1], s[1:], strict=True))
        best = max(value([n >> k & 1 for k in range(b - a)]) for n in range(1 << (b - a)))
        assert value(state[a:b].tolist()) == pytest.approx(best)


def test_field_learns_transitions():
    rng = np.random.default_rng(2)
    y = np.repeat(rng.integers(0, 2, 300), 6)
    x = np.zeros((len(y), len(line_crf.FEATURES)))
    x[:, 0], x[:, -1] = y + rng.standard_normal(len(y)) * 0.8, 1
    offsets = np.arange(0, len(y) + 1, 30)
    field = line_crf.Field()
    field.fit(x, offsets, y)
    assert field.moves[0, 0] + field.moves[1, 1] > field.moves[0, 1] + field.moves[1, 0]
    assert (field.viterbi(x, offsets) == y).mean() > ((x[:, 0] > 0.5) == y).mean() + 0.05


def test_quality_on_awkward_rows(spark, awkward, empty):  # noqa: F811
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    field = line_crf.train(awkward, none)
    rows = line_crf.report(awkward, field).collect()
    assert sorted(base_counts(a[1]) for a in AWKWARD) == sorted((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows)
    assert line_crf.keep_good(awkward, field).columns == awkward.columns
    assert line_crf.report(empty, field).count() == 0


# ---------------------------------------------------------- language model


def test_lm_counts_and_scores(spark, folder, docs):
    rows = queries.op7_lbl_scoring(spark, folder).collect()
    words = {i: [*((r["text"] or "").encode().lower().split()), None] for i, r in docs.items()}
    counts = collections.Counter(w for i, ws in words.items() if crc_mod(i, 10) for w in ws)
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        ws = words[r["doc_id"]]
        assert r["held_out"] == (crc_mod(r["doc_id"], 10) == 0)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel=1e-9)
        assert math.isfinite(r["score"])
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def plain_log(model, two, one, now):
    """log10 P(now | two, one) by plain loops."""
    predicted = [sum(model.r[two][e] * model.c[0][e][d] + model.r[one][e] * model.c[1][e][d] for e in range(lbl.DIM)) for d in range(lbl.DIM)]
    dot = lambda v: sum(float(x) * float(y) for x, y in zip(predicted, v, strict=True))
    group = [math.exp(dot(model.g[k]) + float(model.h[k])) for k in range(lbl.GROUPS)]
    share = {u: math.exp(dot(model.r[u]) + float(model.b[u])) for u in range(lbl.UNITS) if model.of[u] == model.of[now]}
    return math.log10(group[model.of[now]] / sum(group)) + math.log10(share[now] / sum(share.values()))


def test_lm_is_normalised_and_equals_plain_loops():
    rng = np.random.default_rng(0)
    unigram = rng.random(lbl.UNITS)
    unigram /= unigram.sum()
    model = lbl.Model.start(unigram)
    assert sorted(np.bincount(model.of).tolist())[:: lbl.GROUPS - 1] == [lbl.UNITS // lbl.GROUPS] * 2
    model.r *= 5
    every = np.arange(lbl.UNITS)
    for two, one in ((3, 9000), (lbl.END, lbl.END)):
        logs = model.logs(np.full(lbl.UNITS, two), np.full(lbl.UNITS, one), every)
        assert (10**logs).sum() == pytest.approx(1, abs=1e-4)
        for now in (0, 17, lbl.HEAD + 5, lbl.END):
            assert logs[now] == pytest.approx(plain_log(model, two, one, now), abs=1e-4)


def test_lm_learns_a_chain():
    unigram = np.full(lbl.UNITS, 0.1 / lbl.UNITS)
    unigram[:8] += 0.9 / 8
    unigram /= unigram.sum()
    trainer = lbl.Trainer(lbl.Model.start(unigram), unigram, 1)
    rng = np.random.default_rng(5)
    for _ in range(300):
        two, one = rng.integers(0, 8, (2, lbl.BATCH))
        trainer.step(two, one, (one + 1) % 8, 0.1)
    assert np.mean(10 ** trainer.model.logs(two, one, (one + 1) % 8)) > 0.6


def test_lm_scores_equal_plain_loops(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(12)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 12)))) for i in range(60)] + [(61, "unseen words W1")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {}
    real = lbl.fitted
    monkeypatch.setattr(lbl, "fitted", lambda t, v, u: kept.setdefault("model", real(t, v, u)))
    got = {r["doc_id"]: r["score"] for r in lbl.score(frame).collect()}
    counts = collections.Counter(w for i, t in rows if crc_mod(i, 10) for w in t.lower().split())
    head = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
    unseen = lambda w: int(lbl.suffix_unit(__import__("pyarrow").array([w]))[0])
    for i, t in rows[::10] + rows[-1:]:
        units = [head.index(w) if w in head else unseen(w) for w in t.lower().split()] + [lbl.END]
        total = 0.0
        for k, u in enumerate(units):
            total += plain_log(kept["model"], units[k - 2] if k > 1 else lbl.END, units[k - 1] if k else lbl.END, u)
            if lbl.HEAD <= u < lbl.END:  # no training word is in a suffix unit here: an unseen word has all of its mass
                total += math.log10(0.1) - math.log10(0.1)
        assert got[i] == pytest.approx(total, abs=1e-3)


def test_lm_on_awkward_rows(spark, awkward, empty):  # noqa: F811
    rows = lbl.score(awkward).collect()
    assert sorted(r["n_tokens"] for r in rows) == sorted(len((a[1] or "").encode().split()) + 1 for a in AWKWARD)
    assert all(r["held_out"] for r in rows if r["doc_id"] is None)
    assert lbl.score(empty).count() == 0
    nothing = spark.createDataFrame([(None, "a b", "en", "s", 1)], DOCS)
    assert lbl.score(nothing).first()["base_score"] == 0.0


# ------------------------------------------------------------------ tokens


def test_byte_bpe_equals_tiktoken(spark, folder, docs, awkward, empty):  # noqa: F811
    import tiktoken

    path, pattern = queries.byte_bpe()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    given = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for rows, texts in ((queries.op8_byte_bpe(spark, folder).collect(), [(i, r["text"]) for i, r in docs.items()]), (bpe.bpe_digests(awkward, path, pattern).collect(), [(a[0], a[1]) for a in AWKWARD])):
        want = collections.Counter()
        for i, t in texts:
            ids = given.encode_ordinary(t or "")
            want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
        assert collections.Counter(map(tuple, rows)) == want
    encoded = bpe.bpe_encode(awkward, path, pattern)
    assert all(r["round_trip"] for r in encoded.collect())
    assert sorted(r["text"] for r in bpe.bpe_decode(encoded, path).collect()) == sorted(a[1] or "" for a in AWKWARD)
    assert bpe.bpe_digests(empty, path, pattern).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(3)
    for values in ([], [0], [5], [0, 0, 0], np.sort(rng.integers(0, 10**7, 5000)), np.arange(2000), [0, 10**12]):
        ef = token_files.EliasFano.encode(np.array(values, dtype=np.uint64))
        assert ef.between(0, len(values)).tolist() == list(values)
        for i in range(0, len(values), 700):
            assert ef.between(i, min(len(values), i + 900)).tolist() == list(values)[i : i + 900]
        for i in range(0, len(values), 97):
            assert ef.select(i) == values[i]
        with pytest.raises(IndexError):
            ef.select(len(values))
    big = np.sort(rng.integers(0, 10**7, 5000))
    assert sum(map(len, token_files.EliasFano.encode(big).parts())) * 8 < 5000 * (2.2 + math.log2(2000))


def test_token_files_equal_the_library(spark, folder, docs, awkward, empty):  # noqa: F811
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    given = Tokenizer.from_file(path)
    extra = [(7, f"don't STOP,  caf{chr(233)}!! {chr(0x130)}x, a\u0000b \u0000 e{chr(769)}; <|endoftext|> 12,34 'tis", "en", "s", 1)]
    for frame, texts in (
        (spark.read.parquet(f"{folder}/documents.parquet"), [(i, r["text"]) for i, r in docs.items()]),
        (spark.createDataFrame(AWKWARD + extra, DOCS), [(a[0], a[1]) for a in AWKWARD + extra]),
    ):
        rows = sorted(token_files.read_files(token_files.write_files(frame, path)).collect(), key=lambda r: r["start"])
        at, got, want = 0, collections.Counter(), collections.Counter()
        for r in rows:
            assert r["start"] == at
            at += r["n_tokens"]
            got[(r["doc_id"], r["n_tokens"], r["ids_crc32"])] += 1
        for i, t in texts:
            ids = np.array([*given.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
            want[(i, len(ids), zlib.crc32(ids.tobytes()))] += 1
        assert got == want
        order = [-(1 << 62) if r["doc_id"] is None else r["doc_id"] for r in rows]
        assert order == sorted(order)
    assert token_files.read_files(token_files.write_files(empty, path)).count() == 0


def test_random_access(spark, folder, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    manifest = token_files.write_files(spark.read.parquet(f"{folder}/documents.parquet"), path).collect()
    file = token_files.TokenFile(sorted(manifest, key=lambda r: r["part"])[0]["uri"])
    name = file.names.select(1) + file.footer["first"]
    assert file.document(1).tolist() == [*Tokenizer.from_file(path).encode(docs[name]["text"], add_special_tokens=False).ids, 1]


def test_tokenizers_of_another_kind_encode_whole_texts(spark, tmp_path):
    import json

    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    form = json.load(open(path))
    assert token_files.encodes_words_apart(path)
    form["normalizer"]["normalizers"].append({"type": "Replace", "pattern": {"String": " b"}, "content": "zz"})
    other = str(tmp_path / "other.json")
    json.dump(form, open(other, "w"))
    assert not token_files.encodes_words_apart(other)
    rows = [(1, "a b c"), (2, None), (None, "b b")]
    out = token_files.read_files(token_files.write_files(spark.createDataFrame(rows, "doc_id long, text string"), other)).collect()
    want = {i: zlib.crc32(np.array([*Tokenizer.from_file(other).encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in rows}
    assert {r["doc_id"]: r["ids_crc32"] for r in out} == want


def test_token_files_split_a_hot_id(spark):
    """A third of the rows without an id, and equal rows among them, are dealt to several files."""
    docs = spark.range(600).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("text number "), F.col("id").cast("string"))).otherwise("the same text").alias("text"))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = token_files.write_files(docs, queries.word_bpe())
        sizes = [r["n_docs"] for r in manifest.collect()]
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert len(sizes) == 8 and sum(sizes) == 600 and max(sizes) < 150
    rows = token_files.read_files(manifest).orderBy("start").collect()
    names = [r["doc_id"] for r in rows]
    assert names == sorted(names, key=lambda i: (i is not None, i or 0)) and names.count(None) == 200
    assert [r["start"] for r in rows] == [sum(r["n_tokens"] for r in rows[:k]) for k in range(600)]


def test_blocks_of_threads_are_their_own(spark):
    """A block that ends in one thread leaves another thread's tables alone."""
    import threading

    from quillon.llm.shared import materialise, tidy

    inside, ended, seen = threading.Event(), threading.Event(), []

    def other():
        with tidy(spark):
            table = materialise(spark.range(5), "other")
            inside.set()
            ended.wait(60)
            seen.append(table.count())

    worker = threading.Thread(target=other)
    worker.start()
    inside.wait(60)
    with tidy(spark):
        materialise(spark.range(3), "mine")
    ended.set()
    worker.join(60)
    assert seen == [5]


def test_bpe_of_long_pieces():
    import tiktoken

    encoder = bpe.Encoder(*queries.byte_bpe())
    given = tiktoken.Encoding("own", pat_str=queries.byte_bpe()[1], mergeable_ranks=encoder.ranks, special_tokens={})
    rng = random.Random(6)
    letters = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    texts = ["x" * 100_001, "ab" * 50_000, "=" * 100_000, letters(3000, "abcdefghijklmnopqrstuvwxyzABC"), " ".join(letters(rng.randrange(60, 400), "abcd") for _ in range(40)), chr(233) * 3000 + chr(0x4E2D) * 700]
    for text, (said, raw) in zip(texts, encoder.encode(texts), strict=True):
        assert said == ",".join(map(str, given.encode_ordinary(text)))
        assert raw == text.encode()


def own_tokenizer(encoder):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=queries.byte_bpe()[1], mergeable_ranks=encoder.ranks, special_tokens={})


def test_bpe_of_pieces_of_any_shape():
    """Random, repetitive and mixed long pieces over small and large alphabets."""
    encoder = bpe.Encoder(*queries.byte_bpe())
    given, rng = own_tokenizer(encoder), random.Random(8)
    for _ in range(120):
        of = rng.choice(["ab", "abc", "aaaaab", "theandingofion", "abcdefghijklmnopqrstuvwxyz", chr(233) + chr(224) + "a", "=-", chr(0x4E2D) + chr(0x6587)])
        n = rng.randrange(120, 900)
        unit = "".join(rng.choice(of) for _ in range(rng.randrange(1, 9)))
        loose = "".join(rng.choice(of) for _ in range(n))
        text = rng.choice([loose, (unit * n)[:n], (unit * n)[:n] + loose, loose + (unit * n)[:n] + loose])
        said, raw = next(encoder.encode([text]))
        assert (said, raw) == (",".join(map(str, given.encode_ordinary(text))), text.encode())


def test_bpe_of_windows_out_of_step(monkeypatch):
    """Wide windows and the last resort give the same ids."""
    monkeypatch.setattr(bpe, "WIDE", 400)
    encoder = bpe.Encoder(*queries.byte_bpe())
    given = own_tokenizer(encoder)
    for unit in ("a", "abc", "the", "=", "xyzzy", "ing"):
        text = unit * (6000 // len(unit))
        assert next(encoder.encode([text]))[0] == ",".join(map(str, given.encode_ordinary(text)))
    monkeypatch.setattr(bpe, "_borders", lambda *_: [])
    for text in ("xyzzy" * 300, "".join(random.Random(2).choice("etaoin") for _ in range(2000))):
        assert next(encoder.encode([text]))[0] == ",".join(map(str, given.encode_ordinary(text)))


@pytest.mark.parametrize(("make", "limit"), [(lambda: "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000)), 60), (lambda: "a" * 10_000_000, 60), (lambda: "abc" * 1_000_000, 60)])
def test_bpe_of_very_long_pieces_in_time(make, limit):
    encoder, text = bpe.Encoder(*queries.byte_bpe()), make()
    began = time.perf_counter()
    said, raw = next(encoder.encode([text]))
    assert time.perf_counter() - began < limit
    assert raw == text.encode()
    assert said == ",".join(map(str, own_tokenizer(encoder).encode_ordinary(text)))


def test_token_stage_takes_a_very_long_piece(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "a" * 10_000_000), (2, "".join(random.Random(3).choices("abcdefghijklmnopqrstuvwxyz", k=300_000))), (3, None)], "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    rows = corpus_pipeline.tokens(spark, docs, str(tmp_path)).select("doc_id", "round_trip", F.size("token_ids").alias("n"), "n_tokens").collect()
    assert len(rows) == 3 and all(r["round_trip"] and r["n"] == r["n_tokens"] for r in rows)


def test_bpe_decodes_each_text_from_its_own_ids():
    encoder = bpe.Encoder(*queries.byte_bpe())
    text = "Ein kleiner Ring, größer als fünf."
    assert [raw for _, raw in encoder.encode([text, None, ""])] == [text.encode(), b"", b""]
    encoder.known[" kleiner"], encoder.known[" Ring"] = encoder.known[" Ring"], encoder.known[" kleiner"]
    assert [raw for _, raw in encoder.encode([text])] == ["Ein Ring kleiner, größer als fünf.".encode()]


# ---------------------------------------------------------------- toxicity


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in queries.op10_toxicity(spark, folder).collect() if r["held_out"] and r["doc_id"] in labels]
    hits = [r["predicted"] for r in rows if labels[r["doc_id"]] == 1]
    assert np.mean(hits) > 0.5
    assert np.mean([r["predicted"] for r in rows if labels[r["doc_id"]] == 0]) < 0.05
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_toxicity_calibration_labels_move_only_the_knots(spark):
    folder = "/root/testdata/sf0.01"
    frame, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    turned = labels.withColumn("toxic", F.when(fold == 1, (F.xxhash64("doc_id") % 2 == 0).cast("int")).otherwise(F.col("toxic")))
    a, b = toxicity.train(frame, labels), toxicity.train(frame, turned)
    assert a.lexicon == b.lexicon and len(a.trees) == len(b.trees)
    assert all((x[0] == y[0]).all() and (x[1] == y[1]).all() and (x[2] == y[2]).all() for x, y in zip(a.trees, b.trees, strict=True))
    assert [k.tolist() for k in a.knots] != [k.tolist() for k in b.knots]


def plain_margin(model, row):
    """A margin by walking each tree with plain comparisons."""
    out = model.base
    for split_on, split_at, leaf in model.trees:
        node = 0
        for level in range(int(math.log2(len(leaf)))):
            k, at = int(split_on[2**level - 1 + node]), int(split_at[2**level - 1 + node])
            node = 2 * node + (sum(1 for e in model.edges[k] if e < row[k]) > at)
        out += float(leaf[node])
    return out


def test_toxicity_scores_equal_plain_loops(spark):
    folder = "/root/testdata/sf0.001"
    frame, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels)
    assert len(model.trees[0][2]) == 8  # depth 3
    texts = {r["doc_id"]: r["text"] for r in frame.collect()}
    for r in toxicity.score(frame, model).collect():
        row = toxicity.features(pa.array([texts[r["doc_id"]]], pa.string()), model.lexicon)[0].tolist()
        m, (xs, ys) = plain_margin(model, row), model.knots
        at = sum(1 for x in xs if x <= m)
        want = ys[0] if at == 0 else ys[-1] if at == len(xs) else ys[at - 1] + (ys[at] - ys[at - 1]) * (m - xs[at - 1]) / (xs[at] - xs[at - 1])
        assert abs(r["score"] - min(1, max(0, want))) < 1e-9


def test_toxicity_ignores_held_out_labels(spark):
    folder = "/root/testdata/sf0.001"
    frame, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [sorted(map(tuple, toxicity.score(frame, toxicity.train(frame, x)).collect())) for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_toxicity_lexicon_is_not_crowded_out(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    common, toxic = [word(9) for _ in range(600)], ["q" + word(7) for _ in range(30)]
    rows = []
    for i in range(360):
        words = rng.sample(common, 150) + [word(6) for _ in range(300)] + (rng.sample(toxic, 4) if i % 3 == 0 else [])
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.train(frame.select("doc_id", "text"), frame.select("doc_id", "toxic")).lexicon
    assert sum(w in lexicon for w in toxic) >= 28


def test_isotonic_is_monotone_and_exact():
    x, y = isotonic_case = toxicity.isotonic(np.array([1, 2, 2, 3, 4.0]), np.array([0, 1, 1, 0, 1.0]))
    assert len(isotonic_case) == 2
    assert np.interp([1, 2, 3, 4], x, y).tolist() == pytest.approx([0, 2 / 3, 2 / 3, 1])


def test_toxicity_learns_from_one_text_of_an_id(spark):
    rows = [(i % 40, f"word{i} " * (3 + i % 5) + ("vile" if i % 40 < 20 else "kind"), None) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, extra string")
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(40)] * 3, "doc_id long, toxic int")
    seen = {}
    real = toxicity.materialise

    def written(df, name, **how):
        out = real(df, name, **how)
        seen[name] = out.collect()  # the table goes when training ends
        return out

    toxicity.materialise = written
    try:
        toxicity.train(frame, labels)
    finally:
        toxicity.materialise = real
    learned = seen["toxic-labelled"]
    assert len(learned) == len({r["doc_id"] for r in learned}) <= 40
    assert all(r["text"] == min(t for i, t, _ in rows if i == r["doc_id"]) for r in learned)


def test_features_equal_plain_loops():
    lexicon = {"idiot": 5.0, "^trot": 2.0}
    texts = ["You IDIOT, you trottel! 1d10t #1", "a quiet day", "", "Trotte du", "so many words before an idiot comes and then you"]
    for text, row in zip(texts, toxicity.features(__import__("pyarrow").array(texts), lexicon), strict=True):
        words = text.split()
        got = dict(zip(toxicity.FEATURES, row, strict=True))
        normal = [toxicity.normal(w.lower()) for w in words]
        weight = [max([lexicon.get(w, 0), *(lexicon.get("^" + w[:k], 0) for k in range(4, 9) if len(w) > k)]) if len(w) > 2 else 0 for w in normal]
        person = [w in toxicity.SECOND_PERSON for w in normal]
        n, letters, size = max(1, len(words)), max(1, sum(c.isascii() and c.isalpha() for c in text)), max(1, len(text.encode()))
        assert got["length"] == pytest.approx(math.log1p(len(words)))
        assert got["strong"] == pytest.approx(sum(w >= 4 for w in weight) / n)
        assert got["weak"] == pytest.approx(sum(0 < w < 4 for w in weight) / n)
        assert got["person"] == pytest.approx(sum(person) / n)
        assert got["near_person"] == pytest.approx(sum(w >= 4 and any(person[max(0, k - 5) : k + 6]) for k, w in enumerate(weight)) / n)
        assert got["capitals"] == pytest.approx(sum("A" <= c <= "Z" for c in text) / letters)
        assert got["exclamation"] == pytest.approx(text.count("!") / size)
        assert got["digits"] == pytest.approx(sum(c in "0123456789" for c in text) / size)


def test_first_split_equals_plain_search():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 6, (80, 3)).astype(float)
    y = ((x[:, 1] > 2) ^ (rng.random(80) < 0.1)).astype(float)
    model = toxicity.grow(x, y, rounds=1, depth=1)
    p = y.mean()
    best = None
    for k in range(3):
        for at, edge in enumerate(model.edges[k]):
            left = x[:, k] <= edge
            sums = [((y[s] - p).sum(), (p * (1 - p) * s).sum()) for s in (left, ~left)]
            if min(h for _, h in sums) >= 1:
                gain = sum(g * g / (h + 1) for g, h in sums)
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, k, at, [0.2 * g / (h + 1) for g, h in sums])
    split_on, split_at, leaf = model.trees[0]
    assert (split_on[0], split_at[0]) == best[1:3]
    assert leaf.tolist() == pytest.approx(best[3])


def test_isotonic_equals_plain_pooling():
    rng = np.random.default_rng(9)
    x, y = rng.permutation(40).astype(float), (rng.random(40) < 0.4).astype(float)
    order = np.argsort(x)
    # max over starts of min over ends of the means, at each place
    s = y[order]
    want = [max(min(s[a : b + 1].mean() for b in range(k, 40)) for a in range(k + 1)) for k in range(40)]
    assert np.interp(x[order], *toxicity.isotonic(x, y)).tolist() == pytest.approx(want)


def test_toxicity_on_awkward_rows(spark, awkward, empty):  # noqa: F811
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.score(awkward, toxicity.train(awkward, none)).collect()
    assert len(rows) == len(AWKWARD)
    assert {r["score"] for r in rows} == {0.0}
    model = toxicity.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    assert toxicity.score(awkward, model).count() == len(AWKWARD)
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.drop_toxic(awkward, model).columns == awkward.columns
