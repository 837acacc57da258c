"""Entity resolution: the same creator on several platforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import normal_name, similar_names
from ..sources.tables import settled

# Which status makes the better record.
RANK = {"open": 3, "unclear": 2, "closed": 1}


def status_rank(status: Column) -> Column:
    out = F.lit(0)
    for name, rank in RANK.items():
        out = F.when(status == name, rank).otherwise(out)
    return out


def exact_dedupe(rows: DataFrame, keys: list[str], confidence: str = "confidence", seq: str = "seq") -> DataFrame:
    """One row per key: a later row replaces only with strictly greater confidence."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(confidence, -F.col(seq))).alias("r")).select(*keys, "r.*").select(rows.columns)


def _substrings(name: Column, share: float = 0.6) -> Column:
    """All substrings of at least that share of the length (the name itself included)."""
    n = F.length(name)
    lengths = F.sequence(F.greatest(F.lit(1), F.ceil(n * share).cast("int")), n)
    parts = F.flatten(F.transform(lengths, lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda at: F.substring(name, at, k))))
    return F.when(n > 0, F.array_distinct(parts)).otherwise(F.array().cast("array<string>"))


#: Length from which names meet on grams, and their length (0.6 of LONG_NAME is more).
LONG_NAME, GRAM = 48, 24


def _blocks(name: Column, whole: bool) -> Column:
    """Keys on which a name meets those that it contains, or with ``whole`` those that contain it."""
    n = F.length(name)
    if whole:
        # the other name may be on either side of LONG_NAME
        return F.when(n >= 0.6 * LONG_NAME, F.array(name, F.concat(F.lit("^"), F.substring(name, 1, GRAM)))).otherwise(F.array(name))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - GRAM + 1)), lambda at: F.concat(F.lit("^"), F.substring(name, at, GRAM)))
    return F.when(n > LONG_NAME, F.array_distinct(grams)).otherwise(_substrings(name))


def name_pairs(a: DataFrame, b: DataFrame, names: tuple[str, ...] = ("username", "display_name")) -> DataFrame:
    """(a_id, b_id) whose names are similar, name by name, without a nested loop.

    Distinct normal names are matched first and ids attached to the pairs of names
    that the predicate leaves, so a name of many rows is compared once.  A name that
    contains the other with at least 0.6 of its length has it among its long
    substrings; those are exploded and equi-joined with whole names, in both
    directions.  Names beyond ``LONG_NAME`` characters meet on the first ``GRAM`` characters of
    the contained one instead, which are among the grams of the other.
    """
    found = []
    for name in names:
        left = a.select(F.col("id").alias("a_id"), normal_name(F.col(name)).alias("a_key")).where("a_key <> ''")
        right = b.select(F.col("id").alias("b_id"), normal_name(F.col(name)).alias("b_key")).where("b_key <> ''")
        x, y = left.select("a_key").distinct(), right.select("b_key").distinct()
        down = x.select("a_key", F.explode(_blocks(F.col("a_key"), whole=False)).alias("key")).join(y.select("b_key", F.explode(_blocks(F.col("b_key"), whole=True)).alias("key")), "key")
        up = x.select("a_key", F.explode(_blocks(F.col("a_key"), whole=True)).alias("key")).join(y.select("b_key", F.explode(_blocks(F.col("b_key"), whole=False)).alias("key")), "key")
        keys = down.unionByName(up).where(similar_names(F.col("a_key"), F.col("b_key"))).select("a_key", "b_key").distinct()
        found.append(left.join(keys, "a_key").join(right, "b_key").select("a_id", "b_id"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def platform_update(existing: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Results after arrivals on platforms that they already stand for.

    An arrival meets the result of its username that has its platform among
    ``platforms`` (or as ``platform`` where those are empty).  In order of ``seq`` it
    replaces status, confidence, platform and time of that result if it is strictly
    more confident, and its platform's entry in ``platform_data``; the platforms stay.
    """
    every = F.when(F.size("platforms") > 0, F.col("platforms")).otherwise(F.array("platform"))
    places = existing.select("id", "username", F.col("confidence").alias("held"), F.explode(F.array_distinct(every)).alias("platform"))
    met = arrivals.select("username", "platform", "status", "confidence", "last_updated", "seq").join(places, ["username", "platform"])
    before = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    wins = met.withColumn("most", F.greatest("held", F.max("confidence").over(before))).where("confidence > most")
    entries = wins.groupBy("id", "platform").agg(F.max_by(F.struct("status", "confidence"), "seq").alias("value"), F.max_by(F.struct("platform", "status", "confidence", "last_updated"), "seq").alias("last"), F.max("seq").alias("seq"))
    news = entries.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("platform", "value"))).alias("fresh"), F.max_by("last", "seq").alias("last"))  # an entry for each platform
    joined = existing.join(news, "id", "left")
    old = F.map_filter("platform_data", lambda k, _: ~F.map_contains_key("fresh", k))
    changed = {c: F.coalesce(f"last.{c}", c) for c in ("platform", "status", "confidence", "last_updated")}
    return joined.withColumns({**changed, "platform_data": F.when(F.col("fresh").isNull(), F.col("platform_data")).otherwise(F.map_concat(old, "fresh"))}).select(existing.columns)


def _better(prefix: str, existing: Column) -> Column:
    return F.struct(status_rank(F.col(f"{prefix}.status")), F.col(f"{prefix}.confidence"), F.col(f"{prefix}.last_updated"), existing)


def merge_pairs(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """Results after merging: better record's columns, both platforms, data of each.

    Rows without a partner stay with a single platform.
    """
    fields = ["id", "platform", "username", "display_name", "status", "confidence", "last_updated"]
    left = a.select(F.col("id").alias("a_id"), F.struct(*fields).alias("a"))
    right = b.select(F.col("id").alias("b_id"), F.struct(*fields).alias("b"))
    joined = left.join(pairs, "a_id", "left").join(right, "b_id", "full_outer")
    new_wins = F.coalesce(_better("b", F.lit(0)) > _better("a", F.lit(1)), F.col("a").isNull())
    base, other = F.when(new_wins, F.col("b")).otherwise(F.col("a")), F.when(new_wins, F.col("a")).otherwise(F.col("b"))
    merged = joined.select(base.alias("base"), other.alias("other"))
    platforms = F.filter(F.array("base.platform", "other.platform"), lambda p: p.isNotNull())
    entry = lambda side: F.struct(F.col(f"{side}.platform").alias("key"), F.col(side).alias("value"))
    data = F.map_from_entries(F.filter(F.array(entry("base"), entry("other")), lambda e: e["key"].isNotNull()))
    return merged.select(*[F.col(f"base.{f}") for f in fields[2:]], platforms.alias("platforms"), data.alias("platform_data"))


def mutual_best(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs in which each side is the other's earliest partner."""
    seqs = pairs.join(a.select(F.col("id").alias("a_id"), F.col("seq").alias("a_seq")), "a_id").join(b.select(F.col("id").alias("b_id"), F.col("seq").alias("b_seq")), "b_id")
    ranked = seqs.withColumns(
        {
            "for_a": F.row_number().over(Window.partitionBy("a_id").orderBy("b_seq", "b_id")),
            "for_b": F.row_number().over(Window.partitionBy("b_id").orderBy("a_seq", "a_id")),
        }
    )
    return ranked.where("for_a = 1 and for_b = 1").select("a_id", "b_id")


def greedy_pairs(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """Arrival-order matching: each b in turn takes the earliest a that is still free.

    All b with the same open a are a class; its n-th b is meant for its n-th a.
    In every round those pairs are fixed whose a, and the earlier a of the class,
    are wanted by no earlier b of another class, and their ends leave; the result
    is the same as one by one.  The earliest b is always among them, so rounds go
    on until no pair is open; equal names take one round.
    """
    ids = pairs.select("a_id", "b_id").distinct()
    left = ids.join(a.select(F.col("id").alias("a_id"), F.col("seq").alias("a_seq")), "a_id").join(b.select(F.col("id").alias("b_id"), F.col("seq").alias("b_seq")), "b_id")
    left = settled(left.select("b_id", "a_id", F.struct("a_seq", "a_id").alias("a_at"), F.struct("b_seq", "b_id").alias("b_at")))
    done = left.select("a_id", "b_id").limit(0)
    while not left.isEmpty():
        sums = [F.sum(F.xxhash64(F.lit(k), "a_id").cast("decimal(38,0)")) for k in (0, 1)]
        named = left.groupBy("b_id", "b_at").agg(F.struct(F.count("*"), *sums).alias("class"))
        ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("class").orderBy("b_at")))
        wanted = left.join(named.select("b_id", "class"), "b_id").groupBy("a_id", "a_at", "class").agg(F.min("b_at").alias("first"))
        # the earliest b of another class: the earliest of all, or the second class's where that is our own
        others = Window.partitionBy("a_id").orderBy("first")
        wanted = wanted.withColumns({"nth": F.row_number().over(others), "least": F.min("first").over(Window.partitionBy("a_id")), "second": F.lead("first").over(others)})
        wanted = wanted.withColumn("rival", F.when(F.col("nth") == 1, F.col("second")).otherwise(F.col("least")))
        order = Window.partitionBy("class").orderBy("a_at")
        meant = wanted.withColumns({"rank": F.row_number().over(order), "rival": F.min("rival").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
        fixed = ranked.join(meant.select("class", "rank", "a_id", "rival"), ["class", "rank"]).where("rival is null or b_at < rival")
        fixed = settled(fixed.select("a_id", "b_id"))
        done = done.unionByName(fixed)
        left = settled(left.join(fixed.select("a_id"), "a_id", "left_anti").join(fixed.select("b_id"), "b_id", "left_anti"))
    return done


def same_artist(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_id, b_id) with equal platform and username, or equal profile URL: a union of two equi-joins."""
    x = a.select(F.col("id").alias("a_id"), "platform", "username", "profile_url")
    y = b.select(F.col("id").alias("b_id"), "platform", "username", "profile_url")
    by_name = x.join(y, ["platform", "username"]).select("a_id", "b_id")
    return by_name.unionByName(x.where("profile_url <> ''").join(y, "profile_url").select("a_id", "b_id")).distinct()


def merge_records(joined: DataFrame, old: str = "a", new: str = "b") -> DataFrame:
    """Merge two records of one artist: confidence, triggers and method of the more
    confident one, latest time, texts of the strictly newer one if not empty."""
    stronger = F.col(f"{new}.confidence") > F.col(f"{old}.confidence")
    newer = F.coalesce(F.col(f"{new}.last_updated") > F.col(f"{old}.last_updated"), F.lit(False))
    pick = lambda rule, f: F.when(rule, F.col(f"{new}.{f}")).otherwise(F.col(f"{old}.{f}"))
    text = lambda f: F.when(newer, F.coalesce(F.nullif(f"{new}.{f}", F.lit("")), f"{old}.{f}")).otherwise(F.col(f"{old}.{f}"))
    return joined.select(
        F.col(f"{old}.id").alias("id"), pick(stronger, "confidence").alias("confidence"), pick(stronger, "triggers").alias("triggers"), pick(stronger, "method").alias("method"),
        F.greatest(f"{old}.last_updated", f"{new}.last_updated").alias("last_updated"), text("bio").alias("bio"), text("display_name").alias("display_name"),
    )
