"""Unicode cleaning of texts for training: formatting characters, emoji, categories."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Formatting characters that are deleted.
FORMATTING = "".join(map(chr, (0x202A, 0x202B, 0x202C, 0x202D, 0x202E, 0x2066, 0x2067, 0x2068, 0x2069, 0x200B, 0x200C, 0x200D, 0xFEFF)))
# Emoji ranges.
EMOJI_CLASS = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{1F900}-\x{1F9FF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}]"
EMOJI = EMOJI_CLASS + "+"
# Names of known emoji, replaced in this order.
EMOJI_NAMES = (
    ("🎨", "art"), ("💜", "heart"), ("🔞", "adult"), ("🌙", "moon"), ("☕", "coffee"), ("🐂", "bull"), ("✨", "sparkles"), ("💤", "sleep"), ("🍋", "lemon"), ("🔥", "fire"),
    ("⭐", "star"), ("🌟", "glowing_star"), ("💫", "dizzy"), ("🎯", "target"), ("🚀", "rocket"), ("💎", "diamond"), ("🎪", "circus"), ("🌈", "rainbow"), ("🎃", "pumpkin"),
    ("🎄", "christmas_tree"), ("💘", "cupid"), ("🎊", "confetti"), ("🌸", "cherry_blossom"), ("☀️", "sun"), ("🍂", "fallen_leaves"), ("❄️", "snowflake"), ("🎮", "video_game"),
    ("🐾", "paw_prints"), ("🏳️‍🌈", "pride_flag"), ("🏳️‍⚧️", "trans_flag"),
)
#: Python's \s on str, for Java patterns.
SPACE = r"[\x09-\x0D\x1C-\x20\x85\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip_formatting(text: Column) -> Column:
    return F.translate(text, FORMATTING, "")


@F.pandas_udf(StringType())
def _normalise(text: pd.Series, form: pd.Series) -> pd.Series:
    kind = form.iloc[0] if len(form) else "NFC"
    return text.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize(kind, x))


def normalise(text: Column, form: str = "NFC") -> Column:
    """Unicode normal form NFC, NFD, NFKC or NFKD; the one step without a builtin."""
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(form)
    # only texts with characters beyond ASCII change, and only those are sent to Python
    odd = F.regexp_like(text, F.lit(r"[^\x00-\x7F]"))
    return F.coalesce(_normalise(F.when(odd, text), F.lit(form)), text)


def remove_emoji(text: Column) -> Column:
    return F.regexp_replace(text, EMOJI, "")


def name_emoji(text: Column) -> Column:
    for emoji, name in EMOJI_NAMES:
        text = F.replace(text, F.lit(emoji), F.lit(f" [{name}] "))
    return F.regexp_replace(text, EMOJI, " [emoji] ")


def clean(text: Column, emoji: str = "keep", formatting: bool = True, form: str | None = "NFC") -> Column:
    """Strip, normalise, treat emoji (keep, remove or replace), collapse blanks, trim."""
    out = strip_formatting(text) if formatting else text
    out = normalise(out, form) if form else out
    out = {"keep": lambda x: x, "remove": remove_emoji, "replace": name_emoji}[emoji](out)
    return F.regexp_replace(F.regexp_replace(out, f"{SPACE}+", " "), "^ | $", "")


def has_emoji(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(EMOJI)), F.lit(False))


def emoji_count(text: Column) -> Column:
    """Number of runs of emoji."""
    return F.coalesce(F.regexp_count(text, F.lit(EMOJI)), F.lit(0))


def categories(text: Column) -> Column:
    """Distinct characters beyond ASCII by kind: struct of sorted arrays.

    Formatting beats emoji beats marks beats symbols beats the rest.
    """
    text = F.coalesce(text, F.lit(""))
    odd = F.array_distinct(F.regexp_extract_all(text, F.lit(r"([^\x00-\x7F])"), F.lit(1)))

    def of(kind: str, but: str = "") -> Column:
        return F.array_sort(F.filter(odd, lambda c: F.regexp_like(c, F.lit(f"^(?:{kind})$")) & ~F.regexp_like(c, F.lit(f"^(?:{but})$")) if but else F.regexp_like(c, F.lit(f"^(?:{kind})$"))))

    formatting = f"[{FORMATTING}]"
    symbols = r"\p{Sm}|\p{So}|\p{Sc}|\p{Sk}"
    return F.struct(
        of(EMOJI_CLASS, formatting).alias("emojis"),
        of(symbols, f"{formatting}|{EMOJI_CLASS}").alias("special_symbols"),
        of(formatting).alias("formatting_chars"),
        of(r"\p{M}", f"{formatting}|{EMOJI_CLASS}").alias("accented_chars"),
        of(r"(?s).", rf"{formatting}|{EMOJI_CLASS}|\p{{M}}|{symbols}").alias("other_unicode"),
    )


#: Texts of an Arrow batch, unless the session asks for another number: whole texts are long, and a worker holds a batch several times.
BATCH_TEXTS = 500


def process(df: DataFrame, column: str, emoji: str = "keep", analysis: bool = False) -> DataFrame:
    """Add the cleaned text and, if asked for, emoji counts and non-empty categories."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_TEXTS))
    out = df.withColumn(f"{column}_processed", clean(F.col(column), emoji))
    if not analysis:
        return out
    kinds = ("emojis", "special_symbols", "formatting_chars", "accented_chars", "other_unicode")
    found = categories(F.col(column))
    present = F.filter(F.array(*[F.when(F.size(found[k]) > 0, k) for k in kinds]), lambda x: x.isNotNull())
    return out.withColumns({f"{column}_has_emojis": has_emoji(F.col(column)), f"{column}_emoji_count": emoji_count(F.col(column)), f"{column}_unicode_categories": present})


def statistics(df: DataFrame, column: str) -> DataFrame:
    """One row: rows, texts with characters beyond ASCII, with emoji, distinct such
    characters, the first twenty emoji by code point, and shares of all rows."""
    text = F.col(column)
    odd = F.regexp_like(text, F.lit(r"[^\x00-\x7F]"))
    rows = df.select(text.alias("t"))
    chars = rows.select(F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(r"([^\x00-\x7F])"), F.lit(1)))).alias("c")).groupBy("c").agg(F.lit(1).alias("one"))
    chars = chars.agg(F.count("*").alias("unique_chars"), F.array_join(F.slice(F.array_sort(F.collect_list(F.when(F.regexp_like("c", F.lit(f"^{EMOJI_CLASS}$")), F.col("c")))), 1, 20), "").alias("top_emojis"))
    total = df.select(F.when(odd, 1).alias("u"), F.when(has_emoji(text), 1).alias("e")).agg(F.count(F.lit(1)).alias("total_texts"), F.count("u").alias("texts_with_unicode"), F.count("e").alias("texts_with_emojis"))
    share = lambda c: F.when(F.col("total_texts") > 0, F.format_string("%.1f", F.col(c) * 100.0 / F.col("total_texts"))).otherwise("0.0")
    return total.crossJoin(chars).withColumns({"unicode_share": share("texts_with_unicode"), "emoji_share": share("texts_with_emojis")})  # one row each
