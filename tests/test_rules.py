"""Golden sentences and formula boundaries."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillon.functions import rules, scalars
from quillon.functions import unicode as uni
from quillon.operators import browse, ensemble
from quillon.plans.fixtures import PHRASES

NOW = dt.datetime(2024, 1, 31)
HIGH, TWO, THREE = 0.8500000000000001, 0.9, 0.95
GOLDEN = [
    ("open", HIGH, ["commissions are open"]), ("open", HIGH, ["comms open"]), ("open", HIGH, ["c0mms 0pen"]), ("open", HIGH, ["taking comms"]), ("open", TWO, ["comm slots available", "slots available"]),
    ("open", HIGH, ["open for commissions"]), ("open", HIGH, ["Commission: open"]), ("open", HIGH, ["queue is open"]), ("open", THREE, ["accepting commissions", "slots available", "DM me for comms"]),
    ("closed", HIGH, ["commissions closed"]), ("closed", HIGH, ["comms are full"]), ("open", 0.6, ["taking commissions"]), ("closed", HIGH, ["no comms"]), ("closed", HIGH, ["hiatus"]), ("closed", HIGH, ["fully booked"]),
    ("closed", TWO, ["queue is full", "waitlist is closed"]), ("closed", TWO, ["com closed"]), ("open", 0.6, ["accepting commissions"]), ("unclear", 0.3, []), ("open", 0.6, ["commissions open"]), ("unclear", 0.3, []),
]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_golden_sentences(spark):
    rows = spark.createDataFrame(list(enumerate(PHRASES)), "i int, t string").select("i", rules.rule_verdict(F.col("t")).alias("v")).collect()
    for r in rows:
        status, confidence, triggers = GOLDEN[r["i"]]
        assert (r["v"]["status"], r["v"]["triggers"]) == (status, triggers)
        assert r["v"]["confidence"] == pytest.approx(confidence, abs=1e-12)


@pytest.mark.parametrize("text", ["", None])
def test_empty_text_is_unclear(spark, text):
    v = one(spark, rules.rule_verdict(F.lit(text).cast("string")))
    assert (v["status"], v["confidence"], v["triggers"]) == ("unclear", 0.3, [])


def test_word_boundaries_are_ascii(spark):
    assert one(spark, rules.rule_verdict(F.lit(f"{chr(233)}comms open")))["status"] == "open"
    assert one(spark, rules.rule_verdict(F.lit("xcomms open")))["status"] == "unclear"
    assert one(spark, rules.rule_verdict(F.lit(f"comms{chr(160)}open")))["status"] == "open"


@pytest.mark.parametrize(("days", "weight"), [(6.99, 1.0), (7, 0.8), (29.99, 0.8), (30, 0.5), (89.99, 0.5), (90, 0.3), (-3, 1.0), (None, 0.3)])
def test_time_weight(spark, days, weight):
    t = None if days is None else NOW - dt.timedelta(days=days)
    assert one(spark, scalars.time_weight(F.lit(t).cast("timestamp"), F.lit(NOW))) == weight


@pytest.mark.parametrize(("days", "confidence"), [(0, 0.9), (10, 0.72), (60, 0.45), (100, None)])
def test_bullets_fade(spark, days, confidence):
    b = one(spark, rules.dated_bullet(F.lit("commissions open"), F.lit(NOW - dt.timedelta(days=days)), F.lit(NOW)))
    assert (b and b["confidence"]) == (confidence and pytest.approx(confidence))


def test_name_bullet_prefers_closed(spark):
    b = one(spark, rules.silver_bullet(F.lit("comms open, not taking commissions"), name=True))
    assert (b["status"], b["confidence"]) == ("closed", 0.95)


@pytest.mark.parametrize(("a", "b", "same"), [("foo", "foo", True), ("foo", "foo.bsky.social", False), ("artist", "artistart", False), ("abc", "abcde", True), ("", "x", False), (chr(0x416), chr(0x429), False), (None, "x", False)])
def test_similar_names(spark, a, b, same):
    assert one(spark, scalars.similar_names(F.lit(a).cast("string"), F.lit(b).cast("string"))) is same


def test_strict_names_equal_when_nothing_is_left(spark):
    assert one(spark, scalars.similar_names(F.lit(chr(0x416)), F.lit(chr(0x429)), strict_reference_names=True)) is True


@pytest.mark.parametrize(("days", "said"), [(0, "just now"), (6, "6d ago"), (7, "1w ago"), (28, "0mo ago"), (31, "1mo ago"), (400, "1y ago"), (None, "never")])
def test_relative_time(spark, days, said):
    t = None if days is None else NOW - dt.timedelta(days=days)
    assert one(spark, scalars.relative_time(F.lit(t).cast("timestamp"), F.lit(NOW))) == said


def java_hash(s):
    h = 0
    raw = s.encode("utf-16-be")
    for k in range(0, len(raw), 2):
        h = (h * 31 + int.from_bytes(raw[k : k + 2], "big")) & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


@pytest.mark.parametrize("text", ["", "a", "Customer#000000001", chr(0x1F3A8) + " art", "polygenelubricants"])
def test_string_hash(spark, text):
    assert one(spark, scalars.string_hash32(F.lit(text))) == java_hash(text)


@pytest.mark.parametrize(("x", "pct", "band"), [(0.285, 28, "low"), (0.7, 70, "high"), (0.69, 69, "medium"), (0.5, 50, "medium"), (0.49, 49, "low")])
def test_percent_and_band(spark, x, pct, band):
    p = scalars.percent(F.lit(x))
    assert (one(spark, p), one(spark, scalars.confidence_band(p))) == (pct, band)


def test_lorem_mask_lengths(spark):
    rows = spark.range(0, 60).select(F.repeat(F.lit("x"), F.col("id").cast("int")).alias("t")).select("t", scalars.lorem_mask(F.col("t"), 40).alias("m")).collect()
    assert all(len(r["m"]) == min(len(r["t"]), 40) or len(r["t"]) in (1, 2) for r in rows)


def test_unicode_cleaning(spark):
    text = f"a{chr(0x200B)}  {chr(127912)}{chr(128512)} e{chr(769)}\t"
    assert one(spark, uni.clean(F.lit(text), "replace")) == f"a [art] [emoji] {chr(233)}"
    assert one(spark, uni.clean(F.lit(text), "remove")) == f"a {chr(233)}"
    assert one(spark, uni.emoji_count(F.lit(f"{chr(128512)}{chr(128512)} {chr(128512)}"))) == 2


def components(spark, rows):
    return spark.createDataFrame(rows, "profile_id long, kind string, pos long, text string, event_time timestamp, is_pinned boolean, date_present boolean, model_status string, model_confidence double")


def given(df):
    return df


@pytest.mark.parametrize(
    ("rows", "status", "confidence", "score"),
    [
        ([("display_name", 0, "x", None, False, True, "unclear", 0.6), ("bio", 0, "x", None, False, True, "open", 0.8)], "open", 0.56, 0.4571428571),
        ([("display_name", 0, "comms open", None, False, True, "x", 0.0), ("bio", 0, "commissions closed", None, False, True, "x", 0.0)], "closed", 0.9, -0.0777777778),
        ([("gallery", 0, "x", NOW, False, True, "open", 0.8), ("gallery", 1, "x", NOW - dt.timedelta(days=60), False, True, "closed", 0.6), ("bio", 0, "x", None, False, True, "unclear", 0.5)], "unclear", 0.2877272727, 0.0681818182),
        ([("commission_status", 0, "x", None, False, True, "closed", 0.7), ("bio", 0, "x", None, False, True, "open", 0.2)], "unclear", 0.28, -0.1),
    ],
)
def test_weighted_ensemble(spark, rows, status, confidence, score):
    frame = components(spark, [(1, *r) for r in rows])
    out = ensemble.weighted_ensemble(frame, F.lit(NOW), given).first()
    assert (out["status"], out["confidence"], out["score"]) == (status, pytest.approx(confidence, abs=1e-9), pytest.approx(score, abs=1e-9))


def test_approximate_score():
    assert browse.approximate_score("small ring", "small") == 0.0
    assert browse.approximate_score("smal ring", "small") == pytest.approx(0.2)
    assert browse.approximate_score("zzzz", "small") is None
    assert browse.approximate_score("x" * 90 + "small", "small") is None


def test_fuzzy_search_uses_the_whole_term(spark):
    term = "a rather long name of a small green ring"
    rows = spark.createDataFrame([(1, term), (2, term[:32] + "qwzxkvbj")], "id long, display_name string")
    got = {r["id"]: r["search_score"] for r in browse.fuzzy_search(rows, term).collect()}
    assert got[1] < 1e-3 < got[2]
