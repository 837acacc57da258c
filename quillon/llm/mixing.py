"""Mixing sources to target weights by Poisson replication.

A source's repetition rate is what brings its bytes to its target weight.  Each
document draws a count from a Poisson distribution with that mean by inverting
the distribution at a uniform number hashed from (seed, doc_id), is exploded by
the count and dealt out by a second hash, which makes a global shuffle.

Large means are sums of independent means of at most ``STEP``, each with a hash
of its own (drawn once), so the inversion never underflows.  Only one row per source is
aggregated (partial sums first); the join with the rates is broadcast while
there are at most ``BROADCAST_SOURCES`` sources and salted beyond.

Edge cases: a null source is a source of its own (''); a null text weighs one
byte; a null id hashes as ''; repeated rows draw the same count; sources with a
zero or missing weight vanish, by request; an empty table gives an empty result.
Columns of the input are kept, whatever their names; the added ones are
mix_copies, mix_copy and mix_key, with underscores behind a name that the input
has already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = 8
CDF_TERMS = 64
BROADCAST_SOURCES = 10_000
SALTS = 32


def uniform(*parts: Column | str) -> Column:
    """Uniform number in [0, 1) from the first 52 bits of an MD5."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def rates(docs: DataFrame, source_col: str = "source", text_col: str = "text", weights: dict[str, float] | None = None, total_bytes: int | None = None) -> DataFrame:
    """One row per source: mix_source, mix_rate (mean copies), mix_steps, mix_cdf of one step.

    Without ``weights`` a source's weight is the square root of its bytes
    (temperature 2).  ``total_bytes`` is the size of the mixture, by default that
    of the input.
    """
    size = (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 1).cast("long")
    by = docs.select(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("mix_source"), size.alias("size")).groupBy("mix_source").agg(F.sum("size").alias("bytes"))
    if weights is None:
        weighed = by.withColumn("weight", F.sqrt(F.col("bytes").cast("double")))
    else:
        known = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.create_map(F.lit(""), F.lit(0.0))
        weighed = by.withColumn("weight", F.coalesce(F.try_element_at(known, F.col("mix_source")).cast("double"), F.lit(0.0)))
    # decimal sums are the same in any order, so no source has to meet all others in one task
    sums = weighed.agg(F.sum(F.col("weight").cast("decimal(28,10)")).cast("double").alias("weights"), F.sum("bytes").alias("total"))
    total = F.lit(total_bytes).cast("double") if total_bytes is not None else F.col("total").cast("double")
    rate = F.col("weight") / F.col("weights") * total / F.col("bytes")
    mean = F.col("rate") / F.col("steps")
    first = F.exp(-mean)
    cdf = F.aggregate(
        F.sequence(F.lit(1), F.lit(CDF_TERMS - 1)),
        F.struct(first.alias("p"), F.array(first).alias("c")),
        lambda s, k: F.struct((s["p"] * mean / k).alias("p"), F.concat(s["c"], F.array(F.element_at(s["c"], -1) + s["p"] * mean / k)).alias("c")),
    )["c"]
    return (
        weighed.crossJoin(F.broadcast(sums))  # the second side is one row of totals
        .where("weight > 0")
        .withColumn("rate", rate)
        .withColumn("steps", F.greatest(F.lit(1), F.ceil(F.col("rate") / STEP)).cast("int"))
        .select("mix_source", F.col("rate").alias("mix_rate"), F.col("steps").alias("mix_steps"), cdf.alias("mix_cdf"))
    )


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: dict[str, float] | None = None, total_bytes: int | None = None, seed: int = 11) -> DataFrame:
    """The mixture: the input's columns, plus mix_copies, mix_copy (1-based) and mix_key.

    Rows lie in a global random order: a partition is chosen by the hash of the
    key, and rows are sorted by the key inside it.
    """
    from .shared import materialise

    table = materialise(rates(docs, source_col, text_col, weights, total_bytes), "mix-rates")
    # the input's row is one column, so whatever its columns are called they meet none of these
    keyed = docs.select(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("mix_source"), F.col(id_col).alias("mix_id"), F.xxhash64(id_col, text_col).alias("mix_hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mix_row"))
    if table.count() <= BROADCAST_SOURCES:
        joined = keyed.join(F.broadcast(table), "mix_source")
    else:
        salted = table.withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn("mix_salt", F.pmod(F.col("mix_hash"), F.lit(SALTS)).cast("int")).join(salted, ["mix_source", "mix_salt"])
    # a one-element array binds the drawn number, which all terms of the distribution are compared with
    below = lambda k: F.transform(F.array(uniform(str(seed), F.col("mix_id"), k)), lambda u: F.size(F.filter("mix_cdf", lambda c: c <= u)))[0]
    draw = F.aggregate(F.sequence(F.lit(1), F.col("mix_steps")), F.lit(0), lambda a, k: a + below(k))
    drawn = joined.select("mix_id", "mix_row", draw.alias("mix_copies")).where("mix_copies > 0")
    copies = drawn.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
    text = F.concat_ws(":", F.lit(f"{seed}:shuffle"), F.coalesce(F.col("mix_id").cast("string"), F.lit("")), F.col("mix_copy").cast("string"))
    ordered = copies.withColumn("mix_key", F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")).repartition("mix_key").sortWithinPartitions("mix_key", "mix_id", "mix_copy")
    own = {n: next(x for x in (n + "_" * k for k in range(len(docs.columns) + 1)) if x not in docs.columns) for n in ("mix_copies", "mix_copy", "mix_key")}
    return ordered.select(*[F.col("mix_row").getField(c).alias(c) for c in docs.columns], *[F.col(n).alias(x) for n, x in own.items()])


#: DuckDB, over the view ``documents`` (seed 11, square-root weights).
MIX_SQL = f"""
WITH RECURSIVE sized AS (SELECT doc_id, coalesce(source, '') AS source, (coalesce(octet_length(encode(text)), 0) + 1)::BIGINT AS size FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS bytes, sqrt(sum(size)::DOUBLE) AS weight FROM sized GROUP BY source),
totals AS (SELECT list_reduce(list(weight ORDER BY source), lambda a, b: a + b) AS weights, sum(bytes)::DOUBLE AS total FROM by_source),
rated AS (SELECT source, weight / weights * total / bytes AS rate FROM by_source, totals),
stepped AS (SELECT source, rate, greatest(1, ceil(rate / {STEP}))::INT AS steps FROM rated),
terms AS (
  SELECT source, steps, rate / steps AS mean, 0 AS k, exp(-(rate / steps)) AS p, exp(-(rate / steps)) AS c FROM stepped
  UNION ALL
  SELECT source, steps, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM terms WHERE k < {CDF_TERMS - 1}),
cdfs AS (SELECT source, any_value(steps) AS steps, list(c ORDER BY k) AS cdf FROM terms GROUP BY source),
drawn AS (
  SELECT doc_id, d.source, size, list_sum(list_transform(range(1, steps + 1), lambda s: len(list_filter(cdf, lambda c: c <= ('0x' || substr(md5('11:' || coalesce(doc_id::VARCHAR, '') || ':' || s), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE))))::INT AS n_copies
  FROM sized d JOIN cdfs USING (source))
SELECT doc_id, source, size, n_copies, copy::INT AS copy, ('0x' || substr(md5('11:shuffle:' || coalesce(doc_id::VARCHAR, '') || ':' || copy), 1, 15))::BIGINT AS shuffle_key
FROM drawn, unnest(range(1, n_copies + 1)) AS u(copy)
"""
