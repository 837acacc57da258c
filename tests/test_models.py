"""Model artefacts: digests, fallback, scoring as plain numpy does."""

from pathlib import Path

import numpy as np
import pytest

from quillon.operators import ensemble
from quillon.sources import models

ROWS = [(1, "bio", 0, "commissions open now"), (1, "post", 1, "closed for now"), (2, "bio", 0, ""), (2, "post", 1, "nothing here, open open"), (3, "bio", 0, None)]


@pytest.fixture
def place(tmp_path):
    rng = np.random.default_rng(2)
    for variant in ("full", "int8", "fp16"):
        models.save(str(tmp_path), variant, {models.HEAD: models.head(rng.standard_normal((64, 3)), rng.standard_normal(3)), "config.json": b"{}"})
    return str(tmp_path)


def plain(place, variant, texts):
    held = np.load(f"{place}/{variant}/{models.HEAD}")
    out = []
    for t in texts:
        x = held["bias"].copy()
        for w in (t or "").lower().split():
            x = x + held["weights"][__import__("zlib").crc32(w.encode()) % 64]
        p = np.exp(x) / np.exp(x).sum()
        out.append((models.CLASSES[int(p.argmax())], round(float(p.max()), 9)))
    return out


def scores(spark, scorer):
    frame = spark.createDataFrame(ROWS, "profile_id long, kind string, pos long, text string").repartition(2)
    got = {(r["profile_id"], r["pos"]): (r["model_status"], round(r["model_confidence"], 9)) for r in scorer(frame).collect()}
    return [got[r[0], r[2]] for r in ROWS]


def test_scores_equal_numpy_and_broken_files_fall_to_the_next(spark, place):
    texts = [r[3] for r in ROWS]
    assert scores(spark, models.model_scorer(place)) == plain(place, "fp16", texts)
    Path(f"{place}/fp16/{models.HEAD}").write_bytes(b"cut short")
    assert models.problems(place, "fp16") == ["head.npz: broken"]
    assert scores(spark, models.model_scorer(place, rows=2)) == plain(place, "full", texts)
    Path(f"{place}/full/config.json").unlink()
    assert models.usable(place) == "int8" and models.problems(place, "full") == ["config.json: missing"]
    Path(f"{place}/int8/{models.DIGESTS}").write_text("{")
    assert models.usable(place) is None and models.problems(place, "int8") == ["digests.json: broken"]
    assert models.model_scorer(place) is ensemble.rule_scorer
    with pytest.raises(models.BrokenModel):
        models.fetched(place, "fp16")


def test_listing_and_clearing(place):
    rows = models.listing(place)
    assert [r[0] for r in rows] == ["fp16", "full", "int8"] and all(size > 1000 and ok for _, size, ok in rows)
    Path(f"{place}/full/{models.HEAD}").write_bytes(b"x")
    assert {v: ok for v, _, ok in models.listing(place)} == {"fp16": True, "full": False, "int8": True}
    assert models.clear(place, "full") == ["full"] and models.usable(place, ("full",)) is None
    assert models.clear(place) == ["fp16", "int8"] and models.listing(place) == []
    assert models.usable(f"{place}/none") is None


def test_an_order_of_ones_own(spark, place):
    assert models.usable(place, ("int8", "full")) == "int8"
    assert scores(spark, models.model_scorer(place, ("none", "int8"))) == plain(place, "int8", [r[3] for r in ROWS])
