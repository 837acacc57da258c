"""Reading results: likelihood, filters, facets, ranking, search, counts."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import artist_id, likelihood
from ..sources.tables import settled

# Platforms with a facet of their own.
PLATFORMS = (("furaffinity", "FurAffinity", True), ("bluesky", "Bluesky", True), ("twitter", "Twitter/X", False))


def broadcast_if_small(small: DataFrame, most_rows: int) -> DataFrame:
    """Hint a broadcast only after the rows were counted (up to the bound)."""
    return F.broadcast(small) if small.limit(most_rows + 1).count() <= most_rows else small


def result_likelihood() -> Column:
    """Mean over the platforms with data if there are several, else the row's own."""
    many = F.transform(F.map_values("platform_data"), lambda d: likelihood(d["status"], d["confidence"]))
    mean = F.aggregate(many, F.lit(0.0), lambda a, x: a + x) / F.size(many)
    return F.when((F.size("platforms") > 1) & (F.size(F.map_keys("platform_data")) > 0), mean).otherwise(likelihood(F.col("status"), F.col("confidence")))


def on_platform(platform: str | None) -> Column:
    """No platform means all; merged rows need it among theirs."""
    if not platform:
        return F.lit(True)
    return F.when(F.size("platforms") > 1, F.array_contains("platforms", platform)).otherwise(F.col("platform") == platform)


def without(rows: DataFrame, ids: DataFrame, key: Column | None = None) -> DataFrame:
    """Rows whose artist is not listed (a left anti join on artist_id)."""
    key = artist_id(F.col("platform"), F.col("username")) if key is None else key
    return rows.withColumn("artist_id", key).join(ids.select("artist_id").distinct(), "artist_id", "left_anti").drop("artist_id")


def flagged(rows: DataFrame, ids: DataFrame, flag: str = "is_favourite") -> DataFrame:
    """Rows with a flag: whether the artist is listed."""
    listed = ids.select("artist_id").distinct().withColumn(flag, F.lit(True))
    keyed = rows.withColumn("artist_id", artist_id(F.col("platform"), F.col("username")))
    return keyed.join(listed, "artist_id", "left").withColumn(flag, F.coalesce(flag, F.lit(False))).drop("artist_id")


def toggled(favourites: DataFrame, blacklist: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Toggle ids on the blacklist; those that enter it leave the favourites."""
    entering = ids.select("artist_id").distinct().join(blacklist, "artist_id", "left_anti")
    leaving = ids.select("artist_id").join(blacklist, "artist_id", "left_semi")
    after = blacklist.select("artist_id").join(leaving, "artist_id", "left_anti").unionByName(entering).distinct()
    return favourites.select("artist_id").join(entering, "artist_id", "left_anti"), after


def facet_counts(rows: DataFrame) -> DataFrame:
    """(platform, n): a merged row counts once for each of its platforms."""
    each = F.explode(F.when(F.size("platforms") > 1, F.col("platforms")).otherwise(F.array("platform")))
    return rows.select(each.alias("platform")).groupBy("platform").agg(F.count("*").alias("n"))


def facet_options(rows: DataFrame) -> DataFrame:
    """(platform, label, enabled, n) of the fixed platforms, zero where nothing is."""
    fixed = F.explode(F.array(*[F.struct(F.lit(k).alias("platform"), F.lit(label).alias("label"), F.lit(on).alias("enabled")) for k, label, on in PLATFORMS]))
    dimension = rows.sparkSession.range(1).select(fixed.alias("d")).select("d.*")
    counts = facet_counts(rows)
    return dimension.join(counts, "platform", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def ranked(rows: DataFrame, searching: bool = False) -> DataFrame:
    """Favourites first, then search score in steps of 0.01, then likelihood, then arrival."""
    keys = [F.col("is_favourite").desc()] + ([F.floor(F.col("search_score") / 0.01).asc()] if searching else []) + [F.col("likelihood").desc(), F.col("seq").asc()]
    return rows.orderBy(*keys)


def placed(rows: DataFrame, searching: bool = False) -> DataFrame:
    """The ranked rows with their place (1-based): rows are range-sorted, numbered inside
    their partition, and moved by the rows of the partitions before."""
    inside = ranked(rows, searching).withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id() - F.shiftleft(F.col("part").cast("long"), 33))
    inside = settled(inside)
    sizes = inside.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).drop("n")  # one row a partition
    return inside.join(before, "part").withColumn("place", F.col("before") + F.col("row") + 1).drop("part", "row", "before")


def search_stats(rows: DataFrame, kept: Column, term: str) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.count(F.when(kept, 1)).alias("filtered")).withColumns({"active": F.lit(bool(term)), "term": F.lit(term)})


# ---------------------------------------------------------------- search

# Weights of the searched columns.
KEYS = {"display_name": 0.4, "username": 0.3, "bio": 0.15, "triggers": 0.1, "platform_name": 0.05}
THRESHOLD, DISTANCE = 0.4, 100


def substring_search(rows: DataFrame, term: str, columns: list[str]) -> DataFrame:
    """Rows in which a column holds the term (ASCII case folded), with the first place."""
    places = [F.nullif(F.locate(term.lower(), F.lower(F.coalesce(F.col(c), F.lit("")))), F.lit(0)) for c in columns]
    found = places[0] if len(places) == 1 else F.least(*places)
    return rows.withColumn("place", found).where("place is not null")


def approximate_score(text: str, pattern: str, threshold: float = THRESHOLD, distance: int = DISTANCE) -> float | None:
    """Best score of an approximate occurrence, or None: errors / length plus the
    distance of its start from the text's start / ``distance``.

    One column of the edit-distance table per character, free to start anywhere;
    a place so far in that distance alone exceeds the threshold can't match.
    """
    m = len(pattern)
    if not m:
        return 0.0
    column, best = list(range(m + 1)), None
    for at, c in enumerate(text[: int(threshold * distance) + m + 1]):
        diagonal = column[0]
        for k in range(1, m + 1):
            here = min(column[k] + 1, column[k - 1] + 1, diagonal + (pattern[k - 1] != c))
            diagonal, column[k] = column[k], here
        score = column[m] / m + max(0, at - m + 1) / distance
        if score <= threshold and (best is None or score < best):
            best = score
    return best


def approximate_scores(texts: list[str | None], pattern: str, threshold: float = THRESHOLD, distance: int = DISTANCE) -> np.ndarray:
    """``approximate_score`` of many texts at once, NaN where there is none.

    A step takes the next character of all texts.  For patterns of up to 63
    characters a text's column of the edit-distance table is two bit words, whose
    vertical steps up and down are carried over by a dozen operations (Myers' bit
    vectors); longer ones keep the table's column as numbers.
    """
    m, width = len(pattern), int(threshold * distance) + len(pattern) + 1
    out = np.full(len(texts), np.nan)
    given = np.array([t is not None for t in texts], bool)
    if not m:
        out[given] = 0.0
        return out
    cut = [(t or "")[:width] for t in texts]
    length = np.array([len(t) for t in cut], np.int64)
    codes = np.array(cut, dtype=f"U{width}").view(np.uint32).reshape(len(cut), width) if cut else np.zeros((0, width), np.uint32)
    signs = np.array(sorted({ord(c) for c in pattern}), np.uint32)
    masks = np.zeros(len(signs) + 1, np.uint64)  # places of each sign in the pattern; the last: of none
    for k, c in enumerate(pattern):
        masks[np.searchsorted(signs, ord(c))] |= np.uint64(1 << min(k, 63))
    errors = np.full(len(cut), m, np.int64)
    one, top = np.uint64(1), np.uint64(min(m, 63) - 1)
    up, down = np.full(len(cut), (1 << 64) - 1, np.uint64), np.zeros(len(cut), np.uint64)
    table = np.repeat(np.arange(m + 1)[:, None], len(cut), axis=1)
    with np.errstate(over="ignore"):
        for at in range(int(length.max()) if len(cut) else 0):
            column = codes[:, at]
            if m < 64:
                place = np.minimum(np.searchsorted(signs, column), len(signs) - 1)
                equal = np.where(signs[place] == column, masks[place], masks[-1])
                vertical = equal | down
                across = (((equal & up) + up) ^ up) | equal
                more, less = down | ~(across | up), up & across
                errors += ((more >> top) & one).astype(np.int64) - ((less >> top) & one).astype(np.int64)
                more, less = more << one, less << one
                up, down = less | ~(vertical | more), more & vertical
            else:
                diagonal = table[0].copy()
                for k in range(1, m + 1):
                    here = np.minimum(np.minimum(table[k], table[k - 1]) + 1, diagonal + (column != ord(pattern[k - 1])))
                    diagonal, table[k] = table[k].copy(), here
                errors = table[m]
            score = errors / m + max(0, at - m + 1) / distance
            better = given & (at < length) & (score <= threshold) & ~(score >= out)
            out[better] = score[better]
    return out


def may_match(column: Column, pattern: str, threshold: float = THRESHOLD) -> Column:
    """Whether an approximate occurrence is possible; it never rules one out.

    Of one more pieces of the pattern than errors are allowed, one occurs as it
    is.  Texts beyond ASCII always may match, as their lower case may depend on
    the engine.
    """
    m = len(pattern)
    n = 1 + sum(e / m <= threshold for e in range(1, m + 1))
    cuts = [m * k // n for k in range(n + 1)]
    pieces = sorted({pattern[a:b] for a, b in zip(cuts, cuts[1:])})
    text = F.coalesce(column, F.lit(""))
    return F.exists(F.array(*[F.lit(p) for p in pieces]), lambda p: F.contains(F.lower(text), p)) | text.rlike(r"[^\x00-\x7F]")


def fuzzy_search(rows: DataFrame, term: str, keys: dict[str, float] | None = None) -> DataFrame:
    """Rows with a search_score (lower is better); the blank term keeps all at 0.

    Scores of the columns that match multiply, each raised to its weight by the
    field's length norm.  The approximate matcher is an Arrow UDF; rows in which
    no column ``may_match`` never reach it, and equal values of a batch are scored once.
    """
    if not term.strip():
        return rows.withColumn("search_score", F.lit(0.0))
    keys = {k: w for k, w in (keys or KEYS).items() if k in rows.columns}
    total, pattern = sum(keys.values()), term.strip().lower()

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        product, hit = np.ones(len(columns[0])), np.zeros(len(columns[0]), bool)
        for values, weight in zip(columns, keys.values(), strict=True):
            where, once = pd.factorize(values.fillna("").astype(object))
            s = approximate_scores([t.lower() or None for t in once], pattern)[where]
            norm = np.array([1 / math.sqrt(max(1, len(t.split()))) for t in once])[where]
            found = ~np.isnan(s)
            with np.errstate(invalid="ignore"):
                product = np.where(found, product * np.maximum(s, 2.0**-52) ** (weight / total * norm), product)
            hit |= found
        return pd.Series(np.where(hit, product, np.nan)).astype(object).where(hit, None)

    rows = rows.where(reduce(lambda a, b: a | b, [may_match(F.col(k), pattern) for k in keys]))
    return rows.withColumn("search_score", score(*[F.col(k) for k in keys])).where("search_score is not null")


# ------------------------------------------------------------ evaluation


def classifier_metrics(rows: DataFrame, expected: str, actual: str, positive: str = "open") -> DataFrame:
    """total, correct, accuracy, precision, recall and F1 of the positive label."""
    hit, said, true = F.col(expected) == F.col(actual), F.col(actual) == positive, F.col(expected) == positive
    n = lambda c: F.count(F.when(c, 1))
    out = rows.agg(F.count("*").alias("total"), n(hit).alias("correct"), n(said & true).alias("tp"), n(said).alias("said"), n(true).alias("true_"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    out = out.withColumns({"accuracy": ratio("correct", "total"), "precision": ratio("tp", "said"), "recall": ratio("tp", "true_")})
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both > 0, F.col("precision") * 2.0 * F.col("recall") / both).otherwise(0.0)).select("total", "correct", "accuracy", "precision", "recall", "f1")


def summary(rows: DataFrame, passed: Column) -> DataFrame:
    """total, passed, failed."""
    return rows.agg(F.count("*").alias("total"), F.count(F.when(passed, 1)).alias("passed")).withColumn("failed", F.col("total") - F.col("passed"))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
