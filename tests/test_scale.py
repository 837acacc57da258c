"""Work is dealt over tasks by rows, not by bytes of a file, and grows with the rows only."""

from html import unescape

import pytest
from pyspark.sql import functions as F

from quillon.functions import scalars
from quillon.functions import unicode as uni
from quillon.operators import ensemble
from quillon.plans import catalogue
from quillon.plans import fixtures as fx
from quillon.sources import html, tables
from quillon.sources.markup import decoded


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_one_small_file_are_spread(spark, tmp_path):
    spark.range(12_000).coalesce(1).write.parquet(f"{tmp_path}/one")
    sizes = [r["count"] for r in tables.spread(spark.read.parquet(f"{tmp_path}/one")).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 3 and max(sizes) < 4_200
    assert tables.spread(spark.range(0)).count() == 0


@pytest.mark.parametrize("name", ["profile_extract", "anonymise"])
def test_rows_are_spread_before_they_are_made_wide(spark, folder, name):
    assert "Repartition" in plan(catalogue.queries()[name](spark, folder))


@pytest.mark.parametrize("text", ["", "a & b", "&lt;&gt;&amp;lt;", "&notit;&notin;&not", "&#65;&#x41;&#0;&#x110000;&#150;", "&;&&amp&copy&nope;&" + "x" * 40, "&lt;1&gt; " * 100])
def test_references_are_decoded_as_html_does(text):
    assert decoded(text) == unescape(text)


def test_long_journals_are_cut_in_the_task(spark):
    page = '<div class="user-submitted-links">\n ' + "&lt;é&gt; " * 3000 + "</div>"
    frame = html.profile_pages(spark.createDataFrame([("https://x.example/user/a", page), ("https://x.example/user/b", None)], "url string, html string"))
    got = {r["username"]: r["journal"] for r in frame.collect()}
    assert got == {"a": ("<é> " * 3000)[:5000], "b": None}
    assert "whole_journal" not in plan(frame)


def test_log_odds_are_of_scores_between_nought_and_one(spark):
    scores = spark.createDataFrame([(-0.1,), (0.0,), (0.5,), (1.0,), (1.12,), (None,)], "s double")
    got = [r["o"] for r in scores.select(scalars.temperature_log_odds(F.col("s"), F.lit(2.0)).alias("o")).collect()]
    assert got == [None, None, 0.5, None, None, None]


@pytest.mark.parametrize("sign", [1.0, -1.0])
def test_a_mean_on_the_border_is_unclear_in_any_order(spark, sign):
    """(0.1 + 0.2 + 0.3) / 3 is above 0.2 in doubles, (0.3 + 0.2 + 0.1) / 3 is not."""
    rows = [(k, "gallery", sign * s, 1.0, abs(s)) for k, order in enumerate([(0.1, 0.2, 0.3), (0.3, 0.2, 0.1)]) for s in order]
    items = spark.createDataFrame(rows, "profile_id long, kind string, s double, tw double, confidence double").coalesce(1)
    assert [r["gallery_status"] for r in ensemble.gallery_ensemble(items).collect()] == ["unclear", "unclear"]


def test_a_name_is_hashed_once_for_each_use(spark, folder):
    """Two of three columns need the hash, and lengths of filler are no work of a row."""
    said = plan(catalogue.queries()["anonymise"](spark, folder))
    assert said.count("aggregate(") == 2 and "sequence(" not in said


def test_hash_of_characters_beyond_the_base_plane(spark):
    """Two units each, as in UTF-16."""
    got = spark.createDataFrame([("a\U0001f600b",), ("",), (None,)], "t string").select(scalars.string_hash32(F.col("t")).alias("h")).collect()
    want = 0
    for unit in (0x61, 0xD83D, 0xDE00, 0x62):
        want = (want * 31 + unit) & 0xFFFFFFFF
    assert [r["h"] for r in got] == [want - 2**32 if want >= 2**31 else want, 0, 0]


def test_metadata_of_a_page_are_parsed_once(spark):
    """Below the explosion into items, not above it."""
    figures = "".join(f'<figure id="sid-{k}"><a href="/v/{k}"><img data-tags="t{k}"></a></figure>' for k in range(12))
    page = f'<section id="gallery-latest-submissions">{figures}</section><script id="js-submissionData">{{"3": {{"title": "x"}}}}</script>'
    out = html.gallery(spark.createDataFrame([("u", page)], "url string, html string"), "https://h")
    assert [(r["pos"], r["id"], r["title"], r["tags"], r["item_url"]) for r in out.orderBy("pos").collect()] == [(k, str(k), "x" if k == 3 else "", f"t{k}", f"https://h/v/{k}") for k in range(10)]
    said = plan(out)
    assert said.count("from_json(") == 1 and said.index("Generate") < said.index("from_json("), said


def test_texts_go_to_python_in_small_batches(spark):
    """A worker's memory is bounded by a batch; a number that the session was given stays."""
    key, docs = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.createDataFrame([("e\u0301",)], "t string")
    before = spark.conf.get(key)
    try:
        for given, want in (("10000", str(uni.BATCH_TEXTS)), ("77", "77")):
            spark.conf.set(key, given)
            assert uni.process(docs, "t").first()["t_processed"] == "\u00e9"
            assert spark.conf.get(key) == want
    finally:
        spark.conf.set(key, before)


def test_texts_are_dealt_before_verdicts(spark, monkeypatch):
    """Tasks that score and sort hold a bounded number of texts, however few bytes these take."""
    rows = spark.range(95).selectExpr("id % 9 as profile_id", "'post' as kind", "id as pos", "if(id % 19 = 0, '', 'comms open') as text", "cast(null as timestamp) as event_time", "false as is_pinned", "true as date_present").coalesce(1)
    monkeypatch.setattr(ensemble, "TEXTS", 10)
    for made in (ensemble.profile_rules(rows, fx.as_of()), ensemble.weighted_ensemble(rows, fx.as_of())):
        assert "REPARTITION_BY_NUM" in made._jdf.queryExecution().executedPlan().toString()
        assert made.count() == 9
    assert ensemble.scored_items(rows, F.lit(fx.AS_OF).cast("timestamp")).rdd.getNumPartitions() == 9
