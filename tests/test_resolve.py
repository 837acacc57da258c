"""Entity resolution, sources and streams against plain Python."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import resolve
from quillon.plans import fixtures as fx
from quillon.sources import feeds, html, tables
from quillon.streaming import upsert


def people(spark, rows):
    return spark.createDataFrame(rows, "id long, platform string, username string, display_name string, status string, confidence double, last_updated timestamp, seq long")


def test_greedy_matching_equals_one_by_one(spark):
    random.seed(3)
    pairs = sorted({(random.randrange(12), random.randrange(12)) for _ in range(40)})
    a = people(spark, [(k, "a", "x", "x", "open", 0.5, None, 11 - k) for k in range(12)])
    b = people(spark, [(k, "b", "x", "x", "open", 0.5, None, (k * 5) % 12) for k in range(12)])
    got = {(r["a_id"], r["b_id"]) for r in resolve.greedy_pairs(a, b, spark.createDataFrame(pairs, "a_id long, b_id long")).collect()}
    free, want = set(range(12)), set()
    for k in sorted(range(12), key=lambda k: (k * 5) % 12):
        found = [x for x, y in pairs if y == k and x in free]
        if found:
            best = min(found, key=lambda x: 11 - x)
            free.discard(best)
            want.add((best, k))
    assert got == want


def test_greedy_matching_of_many_equal_names(spark):
    random.seed(7)
    pairs = {(x, y) for x in range(130) for y in range(120)} | {(200 + x, 200 + y) for x in range(110) for y in range(115)}
    pairs |= {(random.randrange(260, 400), random.randrange(200, 300)) for _ in range(60)}
    at_a, at_b = {k: (k * 7) % 401 for k in range(400)}, {k: (k * 11) % 311 for k in range(320)}
    a = people(spark, [(k, "a", "x", "x", "open", 0.5, None, s) for k, s in at_a.items()])
    b = people(spark, [(k, "b", "x", "x", "open", 0.5, None, s) for k, s in at_b.items()])
    got = {(r["a_id"], r["b_id"]) for r in resolve.greedy_pairs(a, b, spark.createDataFrame(sorted(pairs), "a_id long, b_id long")).collect()}
    free, want = set(at_a), set()
    for y in sorted(at_b, key=at_b.get):
        found = [x for x in free if (x, y) in pairs]
        if found:
            best = min(found, key=at_a.get)
            free.discard(best)
            want.add((best, y))
    assert len(want) > 200
    assert got == want


def test_exact_dedupe_keeps_the_first_of_equals(spark):
    rows = spark.createDataFrame([("p", "u", 0.5, 1), ("p", "u", 0.7, 2), ("p", "u", 0.7, 3)], "platform string, username string, confidence double, seq long")
    assert resolve.exact_dedupe(rows, ["platform", "username"]).first()["seq"] == 2


def test_merge_is_independent_of_partitioning(spark, folder):
    a, b = fx.platform_a(spark, folder), fx.platform_b(spark, folder)
    found = [sorted(map(tuple, resolve.name_pairs(a.repartition(n), b.repartition(n)).collect())) for n in (1, 7)]
    assert found[0] == found[1]


def test_stream_state_equals_batch(spark, tmp_path):
    rows = [(k, f"u{k % 5}", random.random(), k) for k in range(60)]
    frame = spark.createDataFrame(rows, "id long, username string, confidence double, seq long")
    frame.repartition(6).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = upsert.upsert_stream(stream, str(tmp_path), ["username"])
    query.awaitTermination()
    state = {tuple(r) for r in upsert.current_state(spark, str(tmp_path), frame.schema).collect()}
    assert state == {tuple(r) for r in resolve.exact_dedupe(frame, ["username"]).collect()}


def test_lists_from_html(spark):
    figure = '<section><figure id="sid-{n}"><figcaption><label><p>a</p><p>b</p><p><a href="/user/{u}/">x</a></p></label></figcaption></figure></section>'
    pages = [(0, figure.format(n=1, u="ann") + figure.format(n=2, u="bob")), (1, figure.format(n=3, u="ann"))]
    favourites = html.favourites_page(spark.createDataFrame(pages, "page long, html string"))
    watch = html.watchlist_page(spark.createDataFrame([(1, '<div class="flex-watchlist"><div class="flex-item-watchlist"><a href="/user/cy/">c</a></div></div>')], "page long, html string"))
    assert [(r["list"], r["username"]) for r in html.two_lists(favourites, watch).orderBy("list", "pos").collect()] == [(0, "ann"), (0, "bob"), (1, "cy")]


def test_profile_page(spark):
    page = '<userpage-nav-avatar><img src="//a.x/1.gif"></userpage-nav-avatar><span class="js-displayName">Ann B</span><div class="userpage-profile section-body">My <b>bio</b></div><div class="table-row"><div class="userpage-profile-question">Accepting Commissions</div><span>No</span></div>'
    rows = html.profile_pages(spark.createDataFrame([("https://x/user/ann", page), ("https://x/user/bob", None)], "url string, html string")).collect()
    assert (rows[0]["display_name"], rows[0]["bio"], rows[0]["commission_status"], rows[0]["avatar_url"]) == ("Ann B", "My bio", "closed", "https://a.x/1.gif")
    assert (rows[1]["display_name"], rows[1]["commission_status"]) == ("bob", "unknown")


def test_gallery(spark):
    page = '<figure id="sid-6"><img data-tags="x"></figure><div id="gallery-latest-submissions"><figure id="sid-7" class="r"><a href="/view/7/"><img data-tags="fox red"></a></figure><figure id="sid-8"><img></figure></div><script id="js-submissionData" type="application/json">{"7": {"title": "T", "date_full": "Jan 5, 2024 03:04 PM"}}</script>'
    rows = html.gallery(spark.createDataFrame([("u", page)], "url string, html string"), "https://x").collect()
    assert len(rows) == 1
    assert (rows[0]["id"], rows[0]["title"], rows[0]["tags"], rows[0]["item_url"], rows[0]["event_time"].hour) == ("7", "T", "fox red", "https://x/view/7/", 15)


def test_follow_pages(spark, tmp_path):
    page = lambda account, n, did, cursor="": f'{{"account": "{account}", "page": {n}, "follows": [{{"did": "{did}", "handle": "h"}}], "cursor": "{cursor}"}}'
    lines = [page("me", 0, "d1", "x"), page("me", 1, "d2"), page("me", 2, "d3"), page("a.b.social", 0, "d4", "x"), page("a.b.social", 2, "d5", "x"), page("a.b.social", 0, "d4", "x")]
    (tmp_path / "one.json").write_text("\n".join(lines[:3]))
    (tmp_path / "two.json").write_text("\n".join([*lines[3:], "no json"]))
    assert sorted(r["did"] for r in feeds.follow_pages(spark, str(tmp_path)).collect()) == ["d1", "d2", "d4"]


def test_stream_state_is_kept_in_parts(spark, tmp_path):
    schema = "k long, confidence double, seq long"
    rows = [(k % 7, k * 37 % 11 / 11, k) for k in range(60)]
    for n in range(6):
        spark.createDataFrame(rows[n * 10 : n * 10 + 10], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = upsert.polite(spark.readStream.schema(schema)).parquet(f"{tmp_path}/in/*")
        running = upsert.upsert_stream(stream, str(tmp_path / "out"), ["k"])  # stopped and resumed each time
        running.awaitTermination()
    want = {}
    for k, c, s in rows:
        if k not in want or c > want[k][0]:
            want[k] = (c, s)
    got = upsert.current_state(spark, str(tmp_path / "out"), stream.schema)
    assert {r["k"]: (r["confidence"], r["seq"]) for r in got.collect()} == want
    assert len(list((tmp_path / "out" / "versions").iterdir())) == upsert.VERSIONS
    assert upsert.current_state(spark, str(tmp_path / "none"), stream.schema).count() == 0


def test_errors_are_counted(spark):
    from pyspark.sql import functions as F

    rows, seen = upsert.counted_errors(spark.range(10), F.col("id") % 3 == 0)
    assert rows.count() == 10
    assert seen.get == {"total": 10, "errors": 4}


def test_long_names_meet_on_grams(spark):
    random.seed(9)
    base = "".join(random.choice("abcdefgh") for _ in range(90))
    names = [base, base[:60], base[20:], base[:40], base[5:52], base[:30], "x" * 70, "x" * 50, base[10:45]] + [base] * 4
    frame = people(spark, [(k, "a", n, n, "open", 0.5, None, k) for k, n in enumerate(names)])
    got = {tuple(r) for r in resolve.name_pairs(frame, frame).collect()}
    similar = lambda x, y: (x in y or y in x) and min(len(x), len(y)) / max(len(x), len(y)) >= 0.7
    assert got == {(i, j) for (i, x), (j, y) in itertools.product(enumerate(names), repeat=2) if similar(x, y)}


@pytest.mark.parametrize("form", ["NFC", "NFD", "NFKC", "NFKD"])
def test_normal_forms(spark, form):
    import unicodedata

    from pyspark.sql import functions as F

    from quillon.functions import unicode as uni

    texts = [None, "", "abc", "e" + chr(769) + chr(0xE9), chr(0xFB01) + " " + chr(0x2460), chr(0xAC00)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", uni.normalise(F.col("t"), form).alias("n")).collect()
    assert all(r["n"] == (r["t"] if r["t"] is None else unicodedata.normalize(form, r["t"])) for r in rows)


def test_csv(spark, tmp_path):
    rows = spark.createDataFrame([('a"b', None), ("c", "d")], "x string, y string")
    assert tables.csv_document(rows.coalesce(1)) == 'x,y\n"a""b",""\n"c","d"'
    with pytest.raises(ValueError):
        tables.csv_document(rows.limit(0))
    tables.write_csv(rows, f"{tmp_path}/out")
    assert tables.read_csv(spark, f"{tmp_path}/out").where("x = 'a\"b'").count() == 1


def test_model_variants(tmp_path):
    assert tables.model_path(str(tmp_path)) is None
    for name in (*tables.MODEL_FILES, "m.onnx"):
        (tmp_path / "int8").mkdir(exist_ok=True)
        (tmp_path / "int8" / name).touch()
    assert tables.model_path(str(tmp_path)).endswith("int8")


def test_scorer_table_overrides_rules(spark):
    from quillon.operators import ensemble

    parts = spark.createDataFrame([(1, "bio", 0, "comms open"), (2, "bio", 0, "comms open")], "profile_id long, kind string, pos long, text string")
    scores = spark.createDataFrame([(1, "bio", 0, "LABEL_1", 0.8)], "profile_id long, kind string, pos long, label string, score double")
    got = {r["profile_id"]: (r["model_status"], r["model_confidence"]) for r in ensemble.table_scorer(scores)(parts).collect()}
    assert got[1] == ("closed", 0.8)
    assert got[2][0] == "open"


def test_fallback_method(spark):
    rows = spark.createDataFrame([(None, ("open", 0.6)), (("closed", 0.9), ("open", 0.6))], "model struct<status:string,confidence:double>, rules struct<status:string,confidence:double>")
    assert [r["verdict"]["method"] for r in upsert.with_fallback(rows).collect()] == ["pattern-fallback", "model"]


def test_substring_blocking_loses_nothing(spark):
    random.seed(5)
    names = sorted({"".join(random.choice("ab") for _ in range(random.randrange(1, 9))) for _ in range(40)})
    frame = people(spark, [(k, "a", n, n, "open", 0.5, None, k) for k, n in enumerate(names)])
    got = {tuple(r) for r in resolve.name_pairs(frame, frame).collect()}

    def similar(x, y):
        short, long = sorted((x, y), key=len)
        return x == y or (short in long and len(short) / len(long) >= (0.6 if len(short) < 6 else 0.7))

    assert got == {(i, j) for (i, x), (j, y) in itertools.product(enumerate(names), repeat=2) if similar(x, y)}


def test_approximate_search_leaves_nothing_out(spark):
    from quillon.operators import browse

    random.seed(11)
    for term in ("a", "ab", "fox art", "fuchs zeichnet tiere"):
        texts = ["", None, "İ" + term, term.upper(), *("".join(random.choice(term + "xyZ ") for _ in range(random.randrange(1, 40))) for _ in range(150))]
        texts += ["".join(random.choice(term) if random.random() < 0.25 else c for c in term) for _ in range(50)]
        rows = spark.createDataFrame(list(enumerate(texts)), "k long, display_name string")
        want = {k for k, t in enumerate(texts) if t and browse.approximate_score(t.lower(), term) is not None}
        assert {r["k"] for r in browse.fuzzy_search(rows, term).collect()} == want
