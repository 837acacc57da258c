"""Template extraction, exact clustering and ranked search against plain loops."""

import hashlib
import math
import random
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import queries, template, wavelet, yinyang

# ------------------------------------------------------------ templates


class Article(HTMLParser):
    """Text inside article, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.parts = False, []

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        if tag != "b":
            self.parts.append(" ")

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "article"
        if tag != "b":
            self.parts.append(" ")

    def handle_data(self, data):
        if self.inside:
            self.parts.append(data)


def test_pages_equal_a_plain_parser(spark, folder):
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in queries.op11_html_template(spark, folder).collect()}
    assert got.keys() == html.keys()
    for page, h in html.items():
        reader = Article()
        reader.feed(h)
        want = " ".join("".join(reader.parts).split())
        assert (got[page]["text"], got[page]["n_chars"]) == (want, len(want))


PARTS = [
    ("<p>a &amp; b &lt;c&gt; &nbsp;&#233;&copy d</p>", f"a & b <c> {chr(233)}{chr(169)} d"),
    ("<p>x<b>y</b>z<br>w</p>\n<p>\t q \n r</p>", "xyz w q r"),
    ('<article><h1>T</h1><p>one<p>two</article><aside>no</aside><div class="comments"><p>no</p></div>', "T one two"),
    ('<nav><a href="x">m</a></nav><main><p title="a > b">k</p><form><p>f</p></form><div id="cookie-notice">c</div></main><footer>f</footer>', "k"),
    ('<script>var t="</p>";</script><style>p{}</style><noscript>n</noscript><p>1 < 2 <!-- c <p> -->3</p>', "1 < 2 3"),
    ("<header><p>site</p></header><article><header><h1>in</h1></header>body</article>", "in body"),
    ('<article><p>keep <span class="ad">drop</span> this</p><div hidden>h</div><ul><li>i<li>j</ul></article>', "keep this i j"),
    ('<div role="navigation">n</div><table><tr><td>c1<td>c2<tr><td>c3</table>', "c1 c2 c3"),
    ("<p>open <i>never closed", "open never closed"),
    ("plain text", "plain text"),
    ("<p", "<p"),
    ("", ""),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    ('<a href="1">li</a><p>text</p></div></div></nope>', "li text"),
    ("<article>a</article><article class='comment'>b</article><article>c</article>", "a c"),
    ("<textarea>no</textarea><title>no</title><p>é\U0001f600</p>", "é\U0001f600"),
]


def test_markup_cases(spark):
    rows = [(k, f"http://h{k}.org/", html) for k, (html, _) in enumerate(PARTS)] + [(97, None, None), (98, "no url", "<p>u</p>"), (None, "http://h1.org", "<p>v</p>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "h", "text", "tokens", "blocks", "page", "fixed")})
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in template.extract(frame).collect()}
    assert got == {k: (text, len(text)) for k, (_, text) in enumerate(PARTS)} | {97: ("", 0), 98: ("u", 1), None: ("v", 1)}
    assert template.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.fixture(scope="module")
def sites(spark):
    """One host with fixed text in plain blocks, an optional part and a list of links; another of copies; a small one."""
    words = random.Random(4)
    say = lambda n: " ".join("".join(words.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    rows = []
    for k in range(24):
        extra = "<div class='x7'><p>We changed our terms.</p></div>" if k % 3 else ""
        linked = "".join(f'<li><a href="/{i}">{say(3)}</a></li>' for i in range(4))
        text = [say(8) for _ in range(3)] + (["A line that many share."] if k % 2 else [])
        html = f"<html><body><div><span>The Daily Site</span></div>{extra}<div><ul>{linked}</ul></div><div class='t'>" + "".join(f"<p>{t}</p>" for t in text) + "</div><div><em>All rights reserved</em></div></body></html>"
        rows += [(len(rows), f"https://User@Big.example:8080/{k}", html, " ".join(text))]
    copy = "<html><body><section>same</section><p>copied text</p></body></html>"
    rows += [(len(rows) + k, "http://copies.example/x", copy, "same copied text") for k in range(30)]
    rows += [(len(rows) + k, "http://small.example/", f"<p>fixed</p><p>own {k}</p>", f"fixed own {k}") for k in range(3)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, want string")


def test_template_text_goes_and_copies_stay(sites):
    got = {r["page_id"]: r["text"] for r in template.extract(sites).collect()}
    assert got == {r["page_id"]: r["want"] for r in sites.collect()}


def test_templates_by_shuffle(spark, sites, monkeypatch):
    monkeypatch.setattr(template, "BROADCAST_HOSTS", -1)
    assert {r["page_id"]: r["text"] for r in template.extract(sites).collect()} == {r["page_id"]: r["want"] for r in sites.collect()}


def test_classes_out_of_order_or_in_several_slots_are_no_template():
    def batch(orders, tokens):
        return pa.RecordBatch.from_pylist([{"h": 1, "in_order": o, "tokens": tokens} for o in orders])

    tokens = [{"token": t, "class": c} for t, c in ((2, 0), (4, 0), (6, 5), (7, 5))]
    rows = {r["class"]: r for b in template._orders(iter([batch([[2, 6, 7, 4], [2, 7, 6, 4]], tokens)])) for r in b.to_pylist()}
    assert rows[0]["low"] == rows[0]["high"] and rows[5]["low"] != rows[5]["high"]
    rows = {r["class"]: r for b in template._orders(iter([batch([[2, 6, 7, 4], [2, 4, 6, 7]], tokens)])) for r in b.to_pylist()}
    assert rows[5]["low"] == rows[5]["high"] and rows[5]["slot_low"] != rows[5]["slot_high"]
    rows = {r["class"]: r for b in template._orders(iter([batch([[2, 6, 7, 6, 7, 4], [2, 6, 7, 4]], tokens)])) for r in b.to_pylist()}
    assert rows[5]["low"] == rows[5]["high"] and rows[5]["slot_low"] == rows[5]["slot_high"]


# ----------------------------------------------------------- clustering


def brute_clusters(vectors, k, rounds, dims, scale, seed):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in vectors if v and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [v for _, v in first[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for c in range(len(centres)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
            if mine:
                centres[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [(i, *near(v)) for i, v in kept]
    cost = {c: sum(d for _, d, o in found if o == c) for c in range(len(centres))}
    most = (1 << 63) - 1
    return sorted(((i is None, i or 0), o, min(d, most), min(cost[o], most), min(sum(cost.values()), most), hashlib.sha256(",".join(map(str, centres[o])).encode()).hexdigest()) for i, d, o in found)


def clustered(frame, **how):
    rows = yinyang.cluster(frame, **how).collect()
    return sorted(((r["vec_id"] is None, r["vec_id"] or 0), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in rows)


@pytest.mark.parametrize(("k", "rounds", "groups", "spread"), [(16, 3, 4, 1.0), (16, 5, 4, 0.1), (7, 4, 1, 1.0), (12, 3, 12, 0.02)])
def test_clusters_equal_plain_loops(spark, k, rounds, groups, spread):
    rng = np.random.default_rng(k + rounds)
    base = rng.standard_normal((9, 8))
    vectors = [(n, (base[n % 9] + spread * rng.standard_normal(8)).tolist()) for n in range(400)]
    # whole steps on a grid give many equal distances; repeats, null ids and rows that are left out
    vectors += [(1000 + n, [float(x) / 64 for x in rng.integers(-2, 3, 8)]) for n in range(200)]
    vectors += [(5, vectors[5][1]), (None, vectors[6][1]), (2000, None), (2001, [1.0] * 7), (2002, [1.0] * 7 + [None]), (2003, [float("inf")] * 8), (2004, [float("nan")] * 8), (2005, [0.0] * 8), (2006, [])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("v", "cluster", "n", "sums")})
    assert clustered(frame, k=k, rounds=rounds, dims=8, groups=groups) == brute_clusters(vectors, k, rounds, 8, 64, "1")


def test_huge_components_are_exact(spark):
    rng = np.random.default_rng(3)
    vectors = [(n, (rng.standard_normal(4) * 10.0 ** (n % 19)).tolist()) for n in range(120)]
    assert clustered(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), k=6, dims=4) == brute_clusters(vectors, 6, 3, 4, 64, "1")


def test_fewer_vectors_than_centroids_and_none(spark):
    vectors = [(n, [float(n), 1.0]) for n in range(3)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    assert clustered(frame, k=16, dims=2) == brute_clusters(vectors, 16, 3, 2, 64, "1")
    assert clustered(frame, k=16, dims=64) == [] == clustered(frame.limit(0), k=16, dims=2)


def test_bounds_save_distances_and_lose_none():
    rng = np.random.default_rng(1)
    base = rng.integers(-300, 300, (16, 64))
    x = base[rng.integers(0, 16, 4000)] + rng.integers(-9, 9, (4000, 64))
    centres = x[:16].copy()
    group = yinyang.group_centroids(centres, 4)
    own, upper, lower = yinyang.Bounds(centres, group, None).first(x)
    scanned = []
    for _ in range(4):
        new = np.array([x[own == c].sum(axis=0) // max(1, (own == c).sum()) if (own == c).any() else centres[c] for c in range(16)])
        moved = yinyang.root(((new - centres) ** 2).sum(axis=1)) * (1 + yinyang.SLACK)
        centres = new
        bounds = yinyang.Bounds(centres, group, moved)
        own, upper, lower = bounds.again(x, own, upper, lower)
        scanned.append(bounds.scanned)
        assert (own == yinyang.squared(x, centres).argmin(axis=1)).all()
    assert scanned[-1] < len(x)  # a full scan takes 16 distances a vector


# ----------------------------------------------------------------- search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute_ranks(docs, items, k=20):
    bags = [(i, terms(t)) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(len(b) for _, b in bags)
    df = {}
    for _, b in bags:
        for t in set(b):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for i, b in bags:
            m = 75 + 25 * len(b) * n // total
            scores.append((-sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b.count(t) // (1000 * b.count(t) + 12 * m)) for t in terms(text) if t in df), i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(x for x in scores if x[0] < 0)[:k])]
    return out


def corpus():
    rng = random.Random(7)
    words = [f"w{n}" for n in range(40)] + ["Ab", "Été", "été", "9x", "\U0001f600"]
    docs = [(n, rng.choice([" ", ",", "\n", "_", "\x7f"]).join(rng.choices(words, k=rng.randint(1, 60)))) for n in range(150)]
    docs += [(500 - n, "copy of w1 w2 w3 Ab") for n in range(60)] + [(500, "copy of w1 w2 w3 Ab")] * 3
    docs += [(None, "w1 w2 rare"), (None, "w1 w2 rare"), (900, None), (901, ""), (902, " .,-"), (903, "w5 " * 20_000), (-4, "copy of w1 w2 w3 Ab")]
    items = [(1, "w1 w2"), (1, "w1 w2"), (2, "copy copy AB, ab"), (3, "été ÉTÉ \U0001f600"), (4, "nowhere"), (5, None), (6, ""), (None, "rare w3"), (7, " ".join(words)), (8, "w5")]
    return docs, items


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3], r[2] is None, r[2] or 0))


def test_ranks_equal_plain_loops(spark, monkeypatch):
    docs, items = corpus()
    monkeypatch.setattr(wavelet, "BLOCK_BYTES", 40)
    clash = {c: F.lit(1) for c in ("row", "score", "rank", "terms", "docs", "salt")}
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumns(clash), spark.createDataFrame(items, "item_id long, text string").withColumns(clash)
    got = [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in wavelet.ranked(*frames).collect()]
    assert order(got) == order(brute_ranks(docs, items))


def test_no_documents_or_items(spark):
    docs, items = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert wavelet.ranked(docs.where("text is null"), items).count() == 0
    assert wavelet.ranked(docs.limit(0), items).count() == 0
    assert wavelet.ranked(docs, items.limit(0)).count() == 0
    assert wavelet.ranked(docs, items).count() == 1


@pytest.mark.parametrize(("size", "step", "k"), [(200, 1, 20), (1500, 3, 5), (1 << 20, 48, 20), (1 << 20, 48, 500)])
def test_shards_of_any_size_give_the_same_ranks(monkeypatch, size, step, k):
    docs, items = corpus()
    docs = [(n if i is None else i, t) for n, (i, t) in enumerate(docs)]
    monkeypatch.setattr(wavelet, "SHARD_BYTES", size)
    monkeypatch.setattr(wavelet, "STEP", step)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([d[0] for d in docs], pa.int64()), "text": pa.array([d[1] for d in docs], pa.string())})
    counts = next(wavelet._count(iter([batch]))).to_pylist()[0]
    bags = [set(terms(t)) for _, t in docs]
    assert counts == {"docs": sum(map(bool, bags)), "total": sum(len(terms(t)) for _, t in docs)}
    asked = []
    for row, (item, text) in enumerate(items):
        bag = terms(text)
        weight = {t: bag.count(t) * wavelet.weight(counts["docs"], df) for t in dict.fromkeys(bag) if (df := sum(t in b for b in bags))}
        asked.append(wavelet.Query(row, item, list(weight), list(weight.values())))
    shards = list(wavelet._build(counts["docs"], counts["total"])(iter([batch])))
    assert size > 1500 or len(shards) > 3
    got = [(asked[r["row"]].item_id, r["doc_id"], r["score"]) for b in wavelet._search(asked, k)(iter(shards)) for r in b.to_pylist()]
    assert sorted(map(repr, got)) == sorted(repr((i, d, s)) for i, _, d, s in brute_ranks(docs, items, k))


def test_copies_are_not_opened_one_by_one():
    docs = pa.array(range(4096), pa.int64())
    made = wavelet.build_shard(docs, pa.array(["the same few words"] * 4096, pa.large_string()), 8192, 8192 * 4)
    shard = wavelet.Shard(made)
    best = wavelet.Best(1, 20)
    opened = shard.search([wavelet.Query(0, 0, ["same", "few"], [500, 500])], 0, best)
    assert [d for _, _, d in best.found[0]] == list(range(20))
    assert opened < 1500
