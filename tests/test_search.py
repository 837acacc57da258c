"""The vectorised approximate matcher against the plain one."""

import math
import random

import pytest

from quillon.operators.browse import approximate_score, approximate_scores


@pytest.mark.parametrize("length", [1, 2, 5, 9, 31, 62, 63, 64, 80])
def test_scores_equal_the_plain_matcher(length):
    rng = random.Random(length)
    pattern = "".join(rng.choice("abcé ") for _ in range(length))
    texts = [None, "", pattern, "x" * 39 + pattern, "x" * 200 + pattern, "\0" + pattern, pattern + "\0", "\U0001f600" * 3 + pattern]
    for _ in range(120):
        near = list(pattern)
        for _ in range(rng.randrange(0, 1 + length // 2)):
            at = rng.randrange(len(near) + 1)
            near[at : at + rng.randrange(2)] = rng.choice(["", "a", "z", "bc"])
        texts.append("".join(rng.choice("abcxyz ") for _ in range(rng.randrange(60))) + "".join(near) + "".join(rng.choice("abc") for _ in range(rng.randrange(20))))
    got = approximate_scores(texts, pattern)
    for t, g in zip(texts, got, strict=True):
        want = None if t is None else approximate_score(t, pattern)
        assert (want is None and math.isnan(g)) or want == g


def test_no_texts_and_no_pattern():
    assert approximate_scores([], "abc").tolist() == []
    assert approximate_scores(["x", ""], "").tolist() == [0.0, 0.0]
    assert math.isnan(approximate_scores([None], "")[0])
