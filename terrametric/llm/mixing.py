"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

A source's mean repetition rate is its share of the target divided by its share
of the corpus. Each document's count is Poisson with that mean, by inverting
the distribution at a uniform number hashed from seed and id; the document is
exploded by its count and all copies are dealt out and ordered by another hash.
A rate above 16 is a sum of draws with rates up to 16, each with a number of
its own, so that the distribution's steps never underflow.

Sources are counted by an aggregation; the rates join the documents as a
broadcast only if there are at most MAX_BROADCAST_SOURCES, else by source and
a salt, so that a source with a third of all rows is dealt over many tasks.

Defined results: a null source is a source of its own; sources without a weight
get none of the target where weights are given; null text counts one row, or no
characters; rows with the same id get the same count; a null id hashes like the
empty string; an empty table or a target of zero gives an empty result; other
columns are carried along, but for one named like a result column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, carried

#: Up to so many sources the rates (about 700 bytes each) are broadcast.
MAX_BROADCAST_SOURCES = 10_000
SALTS = 64
#: The largest mean of one draw, and the steps of its distribution that 52-bit numbers can reach.
DRAW_MEAN = 16
STEPS = 80


def uniform(*parts: Column | str) -> Column:
    """52 bits of MD5 over the parts, in [0, 1)."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, source_col: str, weights: dict[str | None, float] | None, temperature: float, total: int | None, measure: Column, scratch: Scratch) -> DataFrame:
    """(source, rate, draws, cdf): a row per source.

    The measure is summed a source; its target share is its weight, or where
    none are given its share to the power `temperature`, normalised. total: what
    all copies should measure, as much as the corpus by default.
    """
    sums = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(measure).cast("double").alias("own"))
    if weights is None:
        weight = F.pow("own", F.lit(float(temperature)))
    else:
        weight = F.lit(0.0)
        for k, v in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(v))).otherwise(weight)
    sums = scratch.save(sums.withColumn("weight", weight), "sums")
    corpus, all_weights = (float(x or 0) for x in sums.agg(F.sum("own"), F.sum("weight")).first())
    target = float(total) if total is not None else corpus
    rate = F.lit(target) * (F.col("weight") / F.lit(all_weights)) / F.col("own") if all_weights else F.lit(0.0)
    rated = sums.withColumn("rate", F.when(F.col("own") > 0, rate).otherwise(0.0))
    rated = rated.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / DRAW_MEAN)).cast("int")).withColumn("mean", F.col("rate") / F.col("draws"))
    cdf = F.expr(
        f"aggregate(sequence(1, {STEPS}), named_struct('p', exp(-mean), 'c', exp(-mean), 'a', array(exp(-mean))),"
        " (s, k) -> named_struct('p', s.p * mean / k, 'c', s.c + s.p * mean / k, 'a', concat(s.a, array(s.c + s.p * mean / k))), s -> s.a)"
    )
    return rated.select("source", "rate", "draws", cdf.alias("cdf"))


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = 0.5, total: int | None = None, by_chars: bool = False, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", scratch: Scratch | None = None) -> DataFrame:
    """The input rows, each as often as drawn, in shuffled order, with `copies`, `copy` (from 0) and `shuffle_key`."""
    scratch = scratch or Scratch(docs.sparkSession, "mixing")
    measure = F.coalesce(F.length(text_col), F.lit(0)) if by_chars else F.lit(1)
    rates = scratch.save(source_rates(docs, source_col, weights, temperature, total, measure, scratch), "rates")
    keyed = docs.select(carried(docs, "copies", "copy", "shuffle_key"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(source_col).alias("own_source"))
    same = keyed["own_source"].eqNullSafe(rates["source"])
    if rates.count() <= MAX_BROADCAST_SOURCES:
        joined = keyed.join(F.broadcast(rates), same)
    else:
        keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        rates = rates.withColumn("rate_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.join(rates, keyed["own_source"].eqNullSafe(rates["source"]) & (keyed["salt"] == rates["rate_salt"]))
    draws = F.sequence(F.lit(1), F.col("draws"))
    numbers = F.transform(draws, lambda j: uniform(str(seed), F.col("id"), j.cast("string")))
    drawn = joined.withColumn("u", numbers)
    count = F.aggregate("u", F.lit(0), lambda n, u: n + F.size(F.filter("cdf", lambda c: c <= u)))
    counted = drawn.select("row", "id", count.alias("copies")).where("copies > 0")
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    key = F.md5(F.concat_ws("|", F.lit(f"shuffle{seed}"), F.col("id"), F.col("copy").cast("string")).cast("binary"))
    keyed = copies.select("row.*", "copies", "copy", F.substring(key, 1, 16).alias("shuffle_key"))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


#: The same in DuckDB over `documents`, by rows at temperature 0.5 and seed 42.
SQL = r"""
WITH RECURSIVE sums AS (
    SELECT source, count(*)::DOUBLE AS own, pow(count(*)::DOUBLE, 0.5) AS weight FROM documents GROUP BY source
), rated AS (
    SELECT source, (SELECT sum(own) FROM sums) * (weight / (SELECT sum(weight) FROM sums)) / own AS rate FROM sums
), means AS (
    SELECT source, greatest(1, ceil(rate / 16))::INT AS draws, rate / greatest(1, ceil(rate / 16))::INT AS mean FROM rated
), steps AS (
    SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM means
    UNION ALL
    SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM steps WHERE k < 80
), drawn AS (
    SELECT doc_id, d.source, j,
           ('0x' || substr(md5('42|' || coalesce(doc_id::VARCHAR, '') || '|' || j), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
    FROM documents d JOIN means m ON d.source IS NOT DISTINCT FROM m.source, LATERAL unnest(range(1, draws + 1)) t(j)
), counted AS (
    SELECT doc_id, count(*)::INT AS copies
    FROM drawn d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source AND s.c <= d.u GROUP BY doc_id
)
SELECT d.*, copies, copy::INT AS copy,
       substr(md5('shuffle42|' || coalesce(d.doc_id::VARCHAR, '') || '|' || copy), 1, 16) AS shuffle_key
FROM documents d JOIN counted USING (doc_id), LATERAL unnest(range(0, copies)) t(copy)
"""
