"""Mixing sources to target weights by Poisson replication, in DataFrame functions alone.

A source of n documents and target share w of a total of T gets the mean repetition rate w * T / n. A document's count
is the inverse of that Poisson distribution at a uniform number hashed from seed and doc_id (where that is null, from
the text's MD5), so that a rerun, or a lost executor, gives the same copies. Each copy goes to a partition by a hash of its
own, and partitions are ordered by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import cut, without

#: Without given weights, shares are as n ** ALPHA: large sources are held down and small ones raised.
ALPHA, SEED = 0.5, "mix-1"
#: Bytes of source names and rates that are broadcast at most; more are joined by shuffle.
BROADCAST_BYTES = 16 << 20


def uniform(*parts):
    """A number in [0, 1) from the first 52 bits of an MD5, which other engines have too."""
    text = F.concat_ws("|", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def start(rate):
    """(low, high, log): the numbers outside of which a Poisson distribution has less than a double can tell, and the
    logarithm of its probability at low, by Stirling's series where low isn't 0. Worked out once a source."""
    wide = 12 * F.sqrt(rate) + 30
    low = F.greatest(F.lit(0.0), F.floor(rate - wide))
    factorial = (low + 0.5) * F.log(low) - low + 0.5 * F.log(F.lit(2) * F.pi()) + 1 / (12 * low) - 1 / (360 * low * low * low) + 1 / (1260 * F.pow(low, F.lit(5)))
    log = F.when(low == 0, -rate).otherwise(low * F.log(rate) - rate - factorial)
    return F.struct(low.cast("long").alias("low"), F.ceil(rate + wide).cast("long").alias("high"), log.alias("log"))


def inverse(u, rate, place):
    """The Poisson count at the uniform number u: how many of the distribution function's values are u or less. Terms are
    summed in logarithms from low on, so that no rate is too large, and a row costs time by the root of the rate."""
    begin = F.struct(place["low"].alias("n"), F.exp(place["log"]).alias("sum"), place["log"].alias("log"))

    def more(s, k):
        log = s["log"] + F.log(rate / k)
        return F.when(s["sum"] > u, s).otherwise(F.struct(k.alias("n"), (s["sum"] + F.exp(log)).alias("sum"), log.alias("log")))

    return F.aggregate(F.sequence(place["low"] + 1, place["high"]), begin, more, lambda s: F.when(s["sum"] > u, s["n"]).otherwise(s["n"] + 1).cast("int"))


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, total: float | None = None, alpha: float = ALPHA) -> DataFrame:
    """(mix_source, n, rate) of each source; total: documents wanted, all of docs if None. Null is a source of its own.
    weights: shares, normalised over the sources that docs has; a source that they don't name gets 0."""
    n = cut(docs.groupBy(F.col("source").alias("mix_source")).agg(F.count(F.lit(1)).alias("n")))
    if weights is None:
        n = n.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(alpha)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "s string, w double")
        n = n.join(given, n.mix_source.eqNullSafe(given.s), "left").select("mix_source", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    sums = n.agg(F.sum("w").alias("all_w"), F.sum("n").alias("all_n"))
    wanted = F.col("all_n").cast("double") if total is None else F.lit(float(total))
    return n.crossJoin(F.broadcast(sums)).select("mix_source", "n", F.when(F.col("all_w") > 0, F.col("w") * wanted / F.col("all_w") / F.col("n")).otherwise(0.0).alias("rate"))  # sums is one row


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, total: float | None = None, alpha: float = ALPHA) -> DataFrame:
    """docs, each as often as its Poisson count says, with mix_copy (from 1) and mix_key, in random order.

    Columns of docs pass through (those two names are replaced if docs has them). Rows that repeat a doc_id draw the same
    count, and so do rows without an id that repeat a text (or have none). Null and empty texts are documents like others. No rows: no rows.
    """
    known = without(docs, "mix_copy", "mix_key")
    r = rates(known, weights, total, alpha)
    r = r.where(F.col("rate") > 0).select("mix_source", F.struct("rate", start(F.col("rate")).alias("start")).alias("mix_rate"))
    # One row for each source: a broadcast if they are small, measured beforehand; else Spark's own (skew-split) join.
    size = r.agg(F.sum(F.coalesce(F.octet_length("mix_source"), F.lit(0)) + 64).alias("bytes")).first()["bytes"] or 0
    few = size <= BROADCAST_BYTES
    # Rows travel as one struct, so that no name in docs meets one of ours.
    rows = known.select(F.struct(*[F.col(f"`{c}`") for c in known.columns]).alias("d"))
    name = F.coalesce(F.col("d.doc_id").cast("string"), *[F.md5(F.col("d.text"))] * ("text" in known.columns))
    joined = rows.join(F.broadcast(r) if few else r, F.col("d.source").eqNullSafe(r.mix_source))
    drawn = joined.select("d", "mix_rate", F.inline(F.array(F.struct(uniform(name).alias("u")))))  # once a row
    counted = drawn.select("d", F.inline(F.array(F.struct(inverse(F.col("u"), F.col("mix_rate.rate"), F.col("mix_rate.start")).alias("n")))))
    copies = counted.where("n > 0").select("d", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("mix_copy"))
    keyed = copies.withColumn("mix_key", uniform(name, F.col("mix_copy")))
    # Rows that repeat an id share keys: their texts tell them apart.
    dealt = keyed.repartition(F.col("mix_key"), *[F.xxhash64("d.text")] * ("text" in known.columns)).sortWithinPartitions("mix_key")
    return dealt.select(*[F.col("d").getField(c).alias(c) for c in known.columns], "mix_copy", "mix_key")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = r"""
WITH n AS (SELECT source, count(*) AS n, sqrt(count(*)::DOUBLE) AS w FROM documents GROUP BY source),
r AS (SELECT source, w * (SELECT sum(n)::DOUBLE FROM n) / (SELECT sum(w) FROM n) / n AS rate FROM n),
c AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c FROM (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::INT + 1)) AS k FROM r)),
l AS (SELECT source, list(c ORDER BY k) AS cdf FROM c GROUP BY source),
d AS (SELECT d.*, len(list_filter(cdf, lambda x: x <= ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0)) AS m FROM documents d JOIN l ON d.source IS NOT DISTINCT FROM l.source),
x AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(1, m + 1))::INT AS mix_copy FROM d WHERE m > 0)
SELECT *, ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '') || '|' || mix_copy), 1, 13))::BIGINT / 4503599627370496.0 AS mix_key FROM x
"""
