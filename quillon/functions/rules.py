"""Rule verdicts over single texts, as Column expressions without any UDF."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon
from .scalars import time_weight

VERDICT = "struct<status:string,confidence:double,method:string,triggers:array<string>>"


def hits(text: Column, phrases: Iterable[lexicon.Phrase]) -> Column:
    """First match of every phrase that matches, in phrase order."""
    found = F.filter(F.array(*[F.regexp_extract(text, p.spark, 0) for p in phrases]), lambda x: x != "")
    return F.when(F.regexp_like(text, F.lit(lexicon.HINT)), found).otherwise(F.array().cast("array<string>"))


def rule_verdict(text: Column, method: str = "pattern-matching") -> Column:
    """Verdict of the phrase lexicon: counts of phrases decide, ties are open at 0.6.

    A null or empty text is unclear at 0.3 without triggers.
    """
    text = F.coalesce(text, F.lit(""))
    opened, closed = hits(text, lexicon.OPEN), hits(text, lexicon.CLOSED)

    def decide(found: Column) -> Column:
        o, c = F.size(found["o"]), F.size(found["c"])
        sure = F.least(F.lit(0.8) + F.greatest(o, c) * F.lit(0.05), F.lit(0.95))
        is_closed = c > o
        status = F.when((o == 0) & (c == 0), "unclear").when(is_closed, "closed").otherwise("open")
        confidence = F.when((o == 0) & (c == 0), 0.3).when((o > 0) & (c > 0), 0.6).otherwise(sure)
        triggers = F.array_distinct(F.when(is_closed, found["c"]).otherwise(found["o"]))
        return F.struct(status.alias("status"), confidence.alias("confidence"), F.lit(method).alias("method"), triggers.alias("triggers"))

    # a one-element array binds the hit lists once for all the uses above
    return F.transform(F.array(F.struct(opened.alias("o"), closed.alias("c"))), decide)[0]


def coarse_verdict(text: Column) -> Column:
    """One open and one closed phrase: 0.7 if exactly one of them matches, else unclear at 0.3."""
    text = F.coalesce(text, F.lit(""))
    o, c = (F.regexp_extract(text, p[0].spark, 0) != "" for p in (lexicon.COARSE_OPEN, lexicon.COARSE_CLOSED))
    status = F.when(o & ~c, "open").when(c & ~o, "closed").otherwise("unclear")
    return F.struct(status.alias("status"), F.when(o == c, 0.3).otherwise(0.7).alias("confidence"))


def trigger_words(text: Column, status: Column) -> Column:
    """Distinct words that hint at a status; any status but open reads the closed list."""
    text = F.coalesce(text, F.lit(""))
    found = lambda phrases: F.filter(F.array(*[F.regexp_extract(text, p.spark, 0) for p in phrases]), lambda x: x != "")
    return F.array_distinct(F.when(status == "open", found(lexicon.TRIGGER_OPEN)).otherwise(found(lexicon.TRIGGER_CLOSED)))


def silver_bullet(text: Column, weight: Column | None = None, name: bool = False) -> Column:
    """struct(status, confidence, trigger) of a decisive phrase, or null.

    Display names have weight 1 and confidence 0.95; other texts need a time
    weight of 0.5 and have 0.9 times the weight.  Closed beats open.
    """
    lists = (lexicon.NAME_OPEN, lexicon.NAME_CLOSED) if name else (lexicon.TEXT_OPEN, lexicon.TEXT_CLOSED)
    text = F.coalesce(text, F.lit(""))
    opened, closed = (F.coalesce(*[F.nullif(F.regexp_extract(text, p.spark, 0), F.lit("")) for p in phrases]) for phrases in lists)
    weight = F.lit(1.0) if name or weight is None else weight
    base = F.lit(0.95 if name else 0.9)

    def decide(found: Column) -> Column:
        status = F.when(found["c"].isNotNull(), "closed").otherwise("open")
        bullet = F.struct(status.alias("status"), (base * weight).alias("confidence"), F.coalesce(found["c"], found["o"]).alias("trigger"))
        return F.when(found["c"].isNotNull() | found["o"].isNotNull(), bullet)

    # closed phrases first; open ones are looked for only where none of those is; the array binds both once
    looked = F.transform(F.array(closed), lambda c: F.struct(c.alias("c"), F.when(c.isNull(), opened).alias("o")))
    return F.when((weight >= 0.5) & F.regexp_like(text, F.lit(lexicon.HINT)), F.transform(looked, decide)[0])


def dated_bullet(text: Column, event_time: Column, as_of: Column, name: bool = False) -> Column:
    return silver_bullet(text, time_weight(event_time, as_of), name)
