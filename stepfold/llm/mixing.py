"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfold.plans.lineage import cut

#: The largest mean that is inverted at once; larger means are sums of equal parts, each with a hash of its own.
PART = 16.0
#: Terms of a distribution with mean PART or less; what is left beyond them is below 2^-52.
TERMS = 80


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) from the MD5 digest of the keys: 52 bits, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *keys)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_cdf(mean: Column) -> Column:
    """P(X <= k) for k from 0 to TERMS - 1, as an array."""
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), F.array(first).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, step, lambda acc: acc["cdf"])


def rates(docs: DataFrame, temperature: float = 0.5, weights: dict[str | None, float] | None = None, size: float = 1.0) -> DataFrame:
    """Mean repetitions of each source: its target share of ``size`` times all characters, over its own characters.

    The share follows ``weights`` (a source without one gets none) or, without weights, the source's characters to the power
    ``temperature``. A null source is a source. A source without characters keeps each row once.
    """
    sums = docs.groupBy("source").agg(F.sum(F.coalesce(F.char_length("text"), F.lit(0)).cast("long")).alias("chars"))
    if weights is None:
        weight = F.pow(F.col("chars").cast("double"), F.lit(temperature))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    shares = sums.withColumn("weight", weight)
    total = shares.agg(F.sum("weight").alias("all_weight"), F.sum("chars").alias("all_chars"))
    mean = (F.col("weight") / F.col("all_weight") * size * F.col("all_chars") / F.col("chars"))
    return (shares.crossJoin(total)  # a single row
            .select("source", F.when(F.col("chars") > 0, mean).otherwise(F.lit(1.0)).alias("rate")))


def repeated(docs: DataFrame, rate: DataFrame, seed: int = 17) -> DataFrame:
    """Each row of ``docs`` as often as a Poisson draw says, with ``copy`` from 0, in a random global order.

    The draw inverts the Poisson distribution with the source's ``rate`` at a number hashed from seed and doc_id, so it
    depends on nothing else: a lost task repeats it. Equal rows are drawn alike. Rows with a null doc_id draw as one id; rows whose
    source has no rate are left out. The order is by a hash of seed, doc_id and copy, dealt over all partitions.
    """
    own = [c for c in docs.columns if c not in ("copy", "repeats")]
    parts = rate.select(F.col("source").alias("__source"), F.greatest(F.ceil(F.col("rate") / PART).cast("int"), F.lit(1)).alias("__parts"),
                        F.col("rate").alias("__rate"))
    # Written first: computed once per source, and Spark knows its size before it plans to move the documents.
    parts = cut(parts.withColumn("__cdf", poisson_cdf(F.col("__rate") / F.col("__parts"))))
    joined = docs.join(parts, F.col("source").eqNullSafe(F.col("__source")))
    draws = F.transform(F.sequence(F.lit(1), F.col("__parts")),
                        lambda part: F.size(F.filter("__cdf", lambda p: p <= uniform(F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                                                                                     part.cast("string")))).cast("long"))
    times = F.aggregate(draws, F.lit(0).cast("long"), lambda a, b: a + b)
    out = (joined.select(*own, times.alias("repeats")).filter("repeats > 0")
           .select(*own, "repeats", F.explode(F.sequence(F.lit(0).cast("long"), F.col("repeats") - 1)).alias("copy")))
    order = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("copy"))
    return out.withColumn("__order", order).repartition("__order").sortWithinPartitions("__order").drop("__order")


def mix(docs: DataFrame, temperature: float = 0.5, weights: dict[str | None, float] | None = None, size: float = 1.0, seed: int = 17) -> DataFrame:
    """``docs`` repeated so that the characters of each source come to their target share. Empty input gives no rows."""
    return repeated(docs, rates(docs, temperature, weights, size), seed)


def mixed(docs: DataFrame, temperature: float = 0.5, weights: dict[str | None, float] | None = None, size: float = 1.0, seed: int = 17) -> DataFrame:
    """As ``mix``, with the columns of ``docs`` and no others, whatever their names."""
    rows = docs.select("doc_id", "source", F.struct(*[f"`{c}`" for c in docs.columns]).alias("__row"))
    return repeated(rows, rates(docs, temperature, weights, size), seed).select("__row.*")


OP4_SQL = f"""
WITH sums AS (SELECT source, sum(coalesce(length(text), 0)) AS chars FROM documents GROUP BY source),
shares AS (SELECT source, chars, sqrt(chars::DOUBLE) AS weight FROM sums),
totals AS (SELECT sum(weight) AS all_weight, sum(chars) AS all_chars FROM shares),
rates AS (SELECT source, CASE WHEN chars > 0 THEN weight / all_weight * all_chars / chars ELSE 1.0 END AS rate FROM shares, totals),
parts AS (SELECT source, rate, greatest(ceil(rate / {PART})::INTEGER, 1) AS parts FROM rates),
terms AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM (
  SELECT source, k, exp(-rate / parts + k * ln(rate / parts) - lgamma(k + 1)) AS p FROM parts, range({TERMS}) AS r(k))),
draws AS (SELECT d.doc_id, d.source, j, ('0x' || substr(md5('17:' || d.doc_id || ':' || j), 1, 13))::BIGINT / {1 << 52}::DOUBLE AS u
  FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source, range(1, p.parts + 1) AS r(j)),
counts AS (SELECT doc_id, d.source, count(*) AS repeats FROM draws d JOIN terms t
  ON d.source IS NOT DISTINCT FROM t.source AND t.cdf <= d.u GROUP BY doc_id, d.source)
SELECT d.doc_id, d.source, d.lang, d.text, d.n_chars, c.repeats, r.copy
FROM documents d JOIN counts c USING (doc_id), range(c.repeats) AS r(copy)
"""
