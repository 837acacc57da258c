"""Landed pages read in batch and as a stream, people in one read, one-file CSV."""

import json
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillon.sources import landing, tables


def page(n, cursor, start=0):
    return json.dumps({"cursor": cursor, "follows": [{"did": f"d{start + k}", "handle": f"h{start + k}.a", "more": 1} for k in range(n)]})


LISTS = {
    "a.b/c d": [page(3, "x"), page(2, "y", 3), page(1, None, 5), page(9, "never", 90)],  # ends behind its third page
    "plain": [page(2, None)],
    "empty": [page(0, "x"), page(1, "", 7)],
    "long": [page(1, "c", 10 * k) for k in range(12)],  # ten pages at most
    "wide": [page(130, None)],  # a hundred rows at most
}


def land_lists(spark, place, most=99, least=0):
    rows = [(a, str(k), body) for a, bodies in LISTS.items() for k, body in enumerate(bodies) if least <= k < most]
    landing.land(spark.createDataFrame(rows, "account string, page string, body string").repartition(3), place)


def expected():
    out = []
    for a, bodies in LISTS.items():
        for k, body in enumerate(bodies[:10]):
            out += [(a, k, pos, r["did"], r["handle"]) for pos, r in enumerate(json.loads(body)["follows"][:100])]
            if not json.loads(body)["cursor"]:
                break
    return sorted(out)


def test_follow_lists_of_all_and_of_some_accounts(spark, tmp_path):
    place = f"{tmp_path}/in"
    land_lists(spark, place)
    assert not list(Path(place).glob("_*"))
    frame = landing.follows(spark, place)
    assert sorted(map(tuple, frame.collect())) == expected()
    some = ["plain", "a.b/c d", "nobody"]
    assert sorted(map(tuple, landing.follows(spark, place, some).collect())) == [r for r in expected() if r[0] in some]
    assert frame.where("account = 'plain' and pos > 0").count() == 1
    assert frame.count() == len(expected())  # a filtered frame of a load changes no other
    # a file of another account isn't opened
    Path(f"{place}/wide/0.json").write_text("no JSON")
    assert landing.follows(spark, place, ["plain"]).count() == 2
    assert landing.follows(spark, place, []).count() == 0
    with pytest.raises(PySparkException):
        landing.follows(spark, place).count()


def test_stream_goes_on_at_its_cursors(spark, tmp_path):
    place, out = f"{tmp_path}/in", f"{tmp_path}/out"

    def run():
        rows = landing.follow_stream(spark, place)
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination()

    for least, most in ((0, 1), (1, 2), (2, 2), (2, 99)):
        land_lists(spark, place, most, least) if most > least else None
        run()
    assert sorted(map(tuple, spark.read.parquet(out).select("account", "page", "pos", "did", "handle").collect())) == expected()
    offsets = [json.loads(line) for f in Path(f"{tmp_path}/at/offsets").iterdir() if f.name.isdigit() for line in f.read_text().splitlines() if "next" in line]
    assert max(o["next"]["long"] for o in offsets) == 10


def post(n, **more):
    return {"uri": f"at://did:1/app.bsky.feed.post/p{n}", "cid": f"c{n}", "author": {"did": "did:1", "handle": "ann.a", "displayName": "Ann"}, "record": {"text": f"post {n}", "createdAt": f"2024-01-0{n + 1}T00:00:00Z"}, **more}


def test_people_with_feed_and_pinned_post(spark, tmp_path):
    feed = {"feed": [{"post": post(n, likeCount=n)} for n in range(7)]}
    pages = {
        "ann.a": {"profile": {"did": "did:1", "handle": "ann.a", "displayName": "", "followersCount": 4, "pinnedPost": {"uri": post(2)["uri"]}}, "feed": feed, "pinned": {"thread": {"post": post(2, replyCount=3)}}},
        "bob": {"profile": {"handle": "bob", "displayName": "Bob", "description": "hi"}, "feed": {"feed": []}, "pinned": {"thread": {"post": post(1)}}},
        "bad": {"profile": {"handle": "bad"}},
        "odd": {"profile": [1], "feed": {"feed": []}},
    }
    rows = [(a, name, json.dumps(body)) for a, some in pages.items() for name, body in some.items()]
    landing.land(spark.createDataFrame(rows, "account string, page string, body string"), f"{tmp_path}/p")
    got = {r["account"]: r for r in landing.people(spark, f"{tmp_path}/p").collect()}
    ann = got["ann.a"]
    assert [p["text"] for p in ann["posts"]] == ["post 2", "post 0", "post 1", "post 3", "post 4"]
    assert (ann["display_name"], ann["follower_count"], ann["posts_count"], ann["pinned_post"]["reply_count"], ann["recent_post"]["text"]) == ("ann.a", 4, 0, 3, "post 0")
    assert ann["posts"][1]["url"] == "https://bsky.app/profile/ann.a/post/p0"
    bob = got["bob"]
    assert (bob["display_name"], bob["bio"], bob["pinned_post"], bob["recent_post"], bob["posts"]) == ("Bob", "hi", None, None, [])
    assert got["bad"]["error"] == "no feed" and got["odd"]["error"] and ann["error"] is None
    assert landing.people(spark, f"{tmp_path}/p", ["bob"]).count() == 1


def test_people_that_land_together_are_a_few_files(spark, tmp_path):
    body = {"profile": lambda k: {"handle": f"h{k}", "followersCount": k}, "feed": lambda k: {"feed": [{"post": post(n)} for n in range(k % 3)]}, "pinned": lambda k: {}}
    rows = [(f"a/{k}", page, json.dumps(make(k))) for k in range(50) for page, make in body.items() if (k, page) != (7, "feed")] + [("bad", "profile", "no JSON"), ("bad", "feed", "{}")]
    frame = spark.createDataFrame(rows, "account string, page string, body string").repartition(3)
    one, many = f"{tmp_path}/one", f"{tmp_path}/many"
    landing.land(frame, one, together=True)
    landing.land(frame, many)
    assert [p.name for p in Path(one).iterdir()] == ["_together"] and len(list(Path(f"{one}/_together").iterdir())) == 1
    want = sorted(map(str, landing.people(spark, many).collect()))
    assert len(want) == 51 and sorted(map(str, landing.people(spark, one).collect())) == want
    assert {r["account"]: r["error"] for r in landing.people(spark, one, ["a/7", "a/8", "x"]).collect()} == {"a/7": "no feed", "a/8": None}
    for again in (True, False):
        with pytest.raises(ValueError, match="alone"):
            landing.land(frame, one, together=again)
    with pytest.raises(ValueError, match="alone"):
        landing.land(frame, many, together=True)


def test_csv_in_one_file(spark, tmp_path):
    rows = [(n, f'say "{n}",\nok' if n % 2 else None) for n in range(40)]
    frame = spark.createDataFrame(rows, "k int, text string").repartitionByRange(4, "k").sortWithinPartitions("k")
    path = f"{tmp_path}/out/export.csv"
    landing.write_csv_file(frame, path)
    assert Path(path).read_bytes().decode() == tables.csv_document(frame)
    assert [f.name for f in Path(f"{tmp_path}/out").iterdir()] == ["export.csv"]
    with pytest.raises(PySparkException, match="nothing to export"):
        landing.write_csv_file(frame.limit(0), f"{tmp_path}/out/none.csv")
    bad = frame.select("k", F.expr("if(k = 39, raise_error('lost'), text)").alias("text"))
    with pytest.raises(PySparkException):
        landing.write_csv_file(bad, f"{tmp_path}/out/bad.csv")
    assert [f.name for f in Path(f"{tmp_path}/out").iterdir()] == ["export.csv"]
