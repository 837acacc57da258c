"""Profile verdicts from component verdicts.

``components`` has one row per text: profile_id, kind (display_name, bio,
commission_status, journal, gallery, post), pos, text, event_time, is_pinned,
date_present.  Every operator groups once by profile, with aggregates that
combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.scalars import is_recent, label_score, time_weight
from ..sources.tables import spread

Scorer = Callable[[DataFrame], DataFrame]
#: Texts that one task scores, about: they are narrow before and sorted by profile with their verdicts behind.
TEXTS = 50_000


def rule_scorer(components: DataFrame) -> DataFrame:
    """Default scorer: model_status and model_confidence of the phrase rules."""
    verdict = rules.rule_verdict(F.col("text"))
    return components.withColumn("verdict_", verdict).withColumns({"model_status": F.col("verdict_.status"), "model_confidence": F.col("verdict_.confidence")}).drop("verdict_")


def table_scorer(scores: DataFrame) -> Scorer:
    """Scorer that looks up precomputed model labels (profile_id, kind, pos, label,
    score); components without one fall back to the phrase rules."""
    from ..functions.scalars import normal_label

    def run(components: DataFrame) -> DataFrame:
        given = scores.select("profile_id", "kind", "pos", normal_label(F.col("label")).alias("given_status"), F.col("score").alias("given_confidence"))
        joined = rule_scorer(components).join(given, ["profile_id", "kind", "pos"], "left")
        return joined.withColumns({"model_status": F.coalesce("given_status", "model_status"), "model_confidence": F.coalesce("given_confidence", "model_confidence")}).drop("given_status", "given_confidence")

    return run


def first_by(value: Column, order: Column, when: Column) -> Column:
    """The value with the least order among rows that satisfy ``when``."""
    return F.min_by(F.when(when, value), F.when(when, order))


def scored_items(components: DataFrame, as_of: Column, scorer: Scorer = rule_scorer) -> DataFrame:
    """Components with weight, bullet, status, confidence and signed score of each.

    A decisive phrase replaces the scorer's verdict.  Item dates that are missing
    count as new for the phrase and as old for the weight; dates that could not
    be read are old for both.
    """
    kind, when = F.col("kind"), F.col("event_time")
    tw = time_weight(when, as_of)
    fresh = F.when(kind.isin("gallery", "post") & ~F.coalesce("date_present", F.lit(True)), 1.0).when(kind == "bio", 1.0).otherwise(tw)
    bullet = F.when(kind == "display_name", rules.silver_bullet(F.col("text"), name=True)).when(kind != "commission_status", rules.silver_bullet(F.col("text"), fresh))
    out = scorer(spread(components.where(F.col("text") != ""), TEXTS)).withColumns({"tw": tw, "bullet": bullet})
    out = out.withColumns({"status": F.coalesce("bullet.status", "model_status"), "confidence": F.coalesce("bullet.confidence", "model_confidence"), "is_bullet": F.col("bullet").isNotNull()})
    return out.withColumn("s", label_score(F.col("status"), F.col("confidence")))


def _group_status(s: Column) -> Column:
    """Status of a mean, rounded first: sums of doubles vary with the order of rows, so a mean of just 0.2 would be on either side."""
    s = F.round(s, 9)
    return F.when(s > 0.2, "open").when(s < -0.2, "closed").otherwise("unclear")


def gallery_aggregates() -> dict[str, Column]:
    """Mean of weighted scores over the number of items; weight 0.15 if any item is fresh."""
    of = F.col("kind") == "gallery"
    n = F.count(F.when(of, 1))
    return {
        "gallery_s": F.when(n > 0, F.sum(F.when(of, F.col("s") * F.col("tw"))) / n),
        "gallery_w": F.when(n > 0, F.when(F.max(F.when(of, F.col("tw"))) > 0.5, 0.15).otherwise(0.1)),
        "gallery_c": F.max(F.when(of, F.col("confidence"))),
    }


def post_aggregates() -> dict[str, Column]:
    """Weighted mean of scores; a pinned post that is decided counts three times and lifts the weight."""
    of = F.col("kind") == "post"
    decided = F.coalesce("is_pinned", F.lit(False)) & (F.col("status") != "unclear")
    ew = F.when(of, F.col("tw") * F.when(decided, 3.0).otherwise(1.0))
    n = F.count(F.when(of, 1))
    base = F.when(F.max(F.when(of, F.col("tw"))) > 0.5, 0.15).otherwise(0.1)
    return {
        "post_s": F.when(n > 0, F.sum(F.col("s") * ew) / F.sum(ew)),
        "post_w": F.when(n > 0, base * F.when(F.max(F.when(of & decided, 1)) == 1, 1.5).otherwise(1.0)),
        "post_c": F.max(F.when(of, F.col("confidence"))),
    }


def gallery_ensemble(items: DataFrame) -> DataFrame:
    """(profile_id, gallery_s, gallery_w, gallery_c, gallery_status) of scored items."""
    out = items.where(F.col("kind") == "gallery").groupBy("profile_id").agg(*[c.alias(k) for k, c in gallery_aggregates().items()])
    return out.withColumn("gallery_status", _group_status(F.col("gallery_s")))


def posts_ensemble(items: DataFrame) -> DataFrame:
    """(profile_id, post_s, post_w, post_c, post_status) of scored items."""
    out = items.where(F.col("kind") == "post").groupBy("profile_id").agg(*[c.alias(k) for k, c in post_aggregates().items()])
    return out.withColumn("post_status", _group_status(F.col("post_s")))


# Weights with and without a decisive phrase.
WEIGHTS = {"display_name": (0.4, 0.3), "bio": (0.5, 0.4), "commission_status": (0.2, 0.2), "journal": (0.3, 0.2)}


def weighted_ensemble(components: DataFrame, as_of: Column, scorer: Scorer = rule_scorer) -> DataFrame:
    """One verdict per profile: status, confidence, score, has_bullet, triggers, method.

    The score is the weighted mean of the component scores.  A decisive phrase of
    bio, display name or journal (in that order) takes status and confidence;
    otherwise confidence is 0.7 |score| + 0.3 of the best component, open above
    0.15 and closed below -0.2.
    """
    items = scored_items(components, as_of, scorer)
    parts: dict[str, Column] = {}
    for kind, (with_bullet, without) in WEIGHTS.items():
        w = F.when(F.col("is_bullet"), with_bullet).otherwise(without) * (F.col("tw") if kind == "journal" else F.lit(1.0))
        parts[kind] = first_by(F.struct("s", w.alias("w"), "confidence", "status", "is_bullet", F.col("bullet.trigger").alias("trigger"), "text"), F.col("pos"), F.col("kind") == kind)
    grouped = items.groupBy("profile_id").agg(*[c.alias(k) for k, c in parts.items()], *[c.alias(k) for k, c in (gallery_aggregates() | post_aggregates()).items()])
    zero = F.lit(0.0)
    pairs = [(F.col(f"{k}.s"), F.col(f"{k}.w")) for k in WEIGHTS] + [(F.col("gallery_s"), F.col("gallery_w")), (F.col("post_s"), F.col("post_w"))]
    total = sum((F.coalesce(w, zero) for _, w in pairs), zero)
    score = F.when(total > 0, sum((F.coalesce(s * w, zero) for s, w in pairs), zero) / total).otherwise(zero)
    highest = F.coalesce(F.greatest(*[F.col(f"{k}.confidence") for k in WEIGHTS], F.col("gallery_c"), F.col("post_c")), zero)
    bullet = F.coalesce(*[F.when(F.col(f"{k}.is_bullet"), F.col(k)) for k in ("bio", "display_name", "journal")])
    out = grouped.select("profile_id", score.alias("score"), highest.alias("highest"), bullet.alias("bullet"), F.concat(F.coalesce("display_name.text", F.lit("")), F.lit(" "), F.coalesce("bio.text", F.lit(""))).alias("said"))
    mixed = F.greatest(zero, F.least(F.lit(1.0), F.abs(F.col("score")) * 0.7 + F.col("highest") * 0.3))
    status = F.when(F.col("bullet").isNotNull(), F.col("bullet.status")).when(F.col("score") > 0.15, "open").when(F.col("score") < -0.2, "closed").otherwise("unclear")
    out = out.withColumn("status", status)
    confidence = F.when(F.col("bullet").isNotNull(), F.col("bullet.confidence")).when(F.col("status") == "unclear", F.least(mixed, F.lit(0.7))).otherwise(mixed)
    triggers = F.when(F.col("bullet").isNotNull(), F.array("bullet.trigger")).otherwise(rules.trigger_words(F.col("said"), F.col("status")))
    return out.select("profile_id", "status", confidence.alias("confidence"), "score", F.col("bullet").isNotNull().alias("has_bullet"), triggers.alias("triggers"), F.lit("component-analysis").alias("method"))


def profile_rules(components: DataFrame, as_of: Column) -> DataFrame:
    """The ordered fold of rule verdicts: name, bio, stated status, journal, gallery, posts.

    (profile_id, status, confidence, triggers), the first five distinct triggers
    in that order.
    """
    items = spread(components.where(F.col("text") != ""), TEXTS).withColumn("v", rules.rule_verdict(F.col("text")))
    value = F.struct("v.status", "v.confidence", "v.triggers")
    single = lambda kind, extra=F.lit(True): first_by(value, F.col("pos"), (F.col("kind") == kind) & extra)
    best = lambda when: F.max_by(F.when(when, value), F.when(when, F.struct("v.confidence", -F.col("pos"))))
    pinned = F.coalesce("is_pinned", F.lit(False))
    post = F.col("kind") == "post"
    grouped = items.groupBy("profile_id").agg(
        single("display_name").alias("name"), single("bio").alias("bio"), single("commission_status").alias("stated"),
        single("journal", is_recent(F.col("event_time"), as_of)).alias("journal"), best(F.col("kind") == "gallery").alias("gallery"), best(post & pinned).alias("pin"),
    )
    step = grouped.withColumns({"S": F.lit("unclear"), "H": F.lit(0.0)})

    def take(frame: DataFrame, rule: Column, part: str, status_only: bool = False) -> DataFrame:
        rule = F.coalesce(rule, F.lit(False))
        frame = frame.withColumn("S", F.when(rule, F.col(f"{part}.status")).otherwise(F.col("S")))
        return frame if status_only else frame.withColumn("H", F.when(rule, F.col(f"{part}.confidence")).otherwise(F.col("H")))

    step = take(step, F.col("name.confidence") > 0.7, "name")
    for part in ("bio", "stated", "journal"):
        step = step.withColumn("beats", F.col(f"{part}.confidence") > F.col("H"))
        step = take(step, F.col("beats"), part)
    step = take(step, F.col("gallery.confidence") > F.col("H") * 0.8, "gallery", status_only=True)
    step = take(step, F.col("pin.confidence") > 0.7, "pin")
    none = F.array().cast("array<string>")
    said = F.flatten(F.array(F.when(F.col("name.confidence") > 0.7, F.col("name.triggers")).otherwise(none), *[F.coalesce(f"{p}.triggers", none) for p in ("bio", "stated", "journal")]))
    return step.select("profile_id", F.col("S").alias("status"), F.col("H").alias("confidence"), F.slice(F.array_distinct(said), 1, 5).alias("triggers"))


def best_item(items: DataFrame, key: str, value: str, pos: str) -> DataFrame:
    """Greatest value in each group; of ties the first position."""
    rest = [c for c in items.columns if c != key]
    return items.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(value, -F.col(pos))).alias("b")).select(key, "b.*")


def first_triggers(items: DataFrame, key: str, pos: str, triggers: str, most: int = 5) -> DataFrame:
    """First distinct triggers of each group in order of position.

    Each trigger is reduced to its first place before groups are collected, so a
    group collects no more than its distinct triggers.  The outer form keeps Spark from
    asking for the list's size in a filter of its own, which would find the triggers
    twice more.
    """
    said = items.select(key, pos, F.posexplode_outer(triggers).alias("at", "trigger")).where("trigger is not null")
    first = said.groupBy(key, "trigger").agg(F.min(F.struct(pos, "at")).alias("place"))
    ordered = F.array_sort(F.collect_list(F.struct("place", "trigger")))
    return first.groupBy(key).agg(F.slice(ordered["trigger"], 1, most).alias("triggers"))
