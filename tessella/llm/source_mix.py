"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate, total * weight / documents. A document's count inverts the Poisson
distribution of that mean at a uniform number hashed from seed and doc_id, so a rerun, a retried task or another
partitioning gives the same copies. The copies are dealt out and sorted by a hash, which shuffles them globally.

An id that several rows share, or none, can't tell them apart: such rows draw with their place in the input
too, so each has a number of its own. For them alone another order or partitioning of the input draws other copies.

Defined results: a null source is a source of its own; rows of null and repeated ids, repeated rows too, are drawn for and
dealt out one by one; texts play no other part and may be of any length; a source of weight zero goes; an empty table gives an empty one; other columns pass through, and n_copies, replica and
shuffle_key replace columns of these names, which mixed_documents() leaves alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 17
#: Without given weights, a source weighs its number of documents to this power.
TEMPERATURE = 0.7
#: Up to so many sources (a few hundred bytes each) the table of rates is broadcast; beyond, it is joined with salt.
BROADCAST_SOURCES = 20_000
#: Up to so many ids that several rows share are broadcast; more are joined.
BROADCAST_IDS = 200_000
SALT = 32


def uniform(*parts) -> Column:
    """A number in [0, 1) with 52 bits, hashed from the parts."""
    text = F.concat_ws(":", *[F.coalesce(F.col(p).cast("string"), F.lit("null")) if isinstance(p, str) else F.lit(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def poisson_cdf(rate: str) -> Column:
    """P(X <= k) for k = 0, 1, ... far into the tail of a Poisson variable with the mean in this column."""
    return F.expr(f"""
        aggregate(
            sequence(1, cast(ceil({rate} + 12 * sqrt({rate}) + 30) as int)),
            struct(-{rate} as lp, array(exp(-{rate})) as cdf),
            (s, k) -> struct(s.lp + ln({rate} / k) as lp, array_append(s.cdf, element_at(s.cdf, -1) + exp(s.lp + ln({rate} / k))) as cdf),
            s -> s.cdf)""")


def rates(docs: DataFrame, weights: DataFrame | None = None, total: float | None = None, source: str = "source") -> DataFrame:
    """source, n, rate and cdf. weights: DataFrame of source and weight; total: copies wanted, as many as documents by default."""
    by = docs.groupBy(F.col(source).alias("_source")).agg(F.count("*").alias("n"))
    if weights is None:
        by = by.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(TEMPERATURE)))
    else:
        w = weights.groupBy(F.col("source").alias("_s")).agg(F.sum("weight").cast("double").alias("weight"))
        by = by.join(w, F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    whole = by.agg(F.sum("weight").alias("_w"), F.sum("n").alias("_n"))
    wanted = F.lit(float(total)) if total is not None else F.col("_n").cast("double")
    by = by.join(F.broadcast(whole)).withColumn("rate", wanted * F.col("weight") / F.col("_w") / F.col("n"))  # whole is one row
    return by.filter("rate > 0").select("_source", "n", "rate", poisson_cdf("rate").alias("_cdf"))


def _told_apart(rows: DataFrame) -> DataFrame:
    """rows with an _id of its own for each: that of rows that share one, or have none, gets their place."""
    shared = rows.filter("not _none").groupBy("_id").agg(F.count("*").alias("_n")).filter("_n > 1").select("_id", F.lit(True).alias("_shared"))
    few = shared.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    placed = rows.withColumn("_place", F.monotonically_increasing_id())
    both = placed.join(F.broadcast(shared) if few else shared, "_id", "left")
    return both.withColumn("_id", F.when(F.col("_none") | F.col("_shared"), F.concat_ws(":", "_id", F.col("_place").cast("string"))).otherwise(F.col("_id"))).select("_row", "_key", "_id")


def mix(docs: DataFrame, weights: DataFrame | None = None, total: float | None = None, source: str = "source", key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """The copies in shuffled order: the documents' columns, n_copies, replica (from 0) and shuffle_key."""
    table = rates(docs, weights, total, source)
    row = _told_apart(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(source).alias("_key"), F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("_id"), F.col(key).isNull().alias("_none")))
    if table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        joined = row.join(F.broadcast(table), F.col("_key").eqNullSafe(F.col("_source")))
    else:
        table = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        row = row.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALT)).cast("int"))
        joined = row.join(table, F.col("_key").eqNullSafe(F.col("_source")) & (row["_salt"] == table["_salt"]))
    counted = joined.select("_row", "_id", uniform(seed, "_id").alias("_u"), "_cdf").select("_row", "_id", F.expr("size(filter(_cdf, c -> c <= _u))").alias("_n"))
    copies = counted.filter("_n > 0").select("_row", "_id", "_n", F.explode(F.expr("sequence(0, _n - 1)")).alias("_replica"))
    keyed = copies.withColumn("_shuffle", F.md5(F.concat_ws(":", F.lit(str(seed)), "_id", F.col("_replica").cast("string"))))
    out = keyed.repartition("_shuffle").sortWithinPartitions("_shuffle")
    own = {"n_copies", "replica", "shuffle_key"}
    return out.select(*[F.col(f"_row.`{c}`") for c in docs.columns if c.lower() not in own], F.col("_n").alias("n_copies"), F.col("_replica").alias("replica"), F.col("_shuffle").alias("shuffle_key"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """mix(), with the documents' columns only."""
    clash = [c for c in docs.columns if c.lower() in {"n_copies", "replica", "shuffle_key"}]
    safe = docs.withColumnsRenamed({c: f"_own_{c}" for c in clash})
    return mix(safe, **how).select(*[F.col(f"`_own_{c}`").alias(c) if c in clash else F.col(f"`{c}`") for c in docs.columns])


def op3_source_mix(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))


COPIES_SQL = f"""
  SELECT d.*, len(list_filter(cdf, lambda c: c <= ('0x' || substr(md5('{SEED}:' || d.doc_id), 1, 13))::BIGINT / 4503599627370496::DOUBLE)) AS n_copies
  FROM {{docs}} d JOIN (
    SELECT source, list_transform(range(1, len(p) + 1), lambda i: list_sum(p[:i])) AS cdf FROM (
      SELECT source, list_transform(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1), lambda k: exp(-rate + k * ln(rate) - lgamma(k + 1))) AS p FROM (
        SELECT source, sum(n) OVER () * pow(n::DOUBLE, {TEMPERATURE}) / sum(pow(n::DOUBLE, {TEMPERATURE})) OVER () / n AS rate
        FROM (SELECT source, count(*) AS n FROM {{docs}} GROUP BY source)))
  ) r ON d.source IS NOT DISTINCT FROM r.source"""
OP3_SQL = f"""
WITH c AS ({COPIES_SQL.format(docs="documents")})
SELECT doc_id, source, text, n_copies::INTEGER AS n_copies, replica::INTEGER AS replica, md5('{SEED}:' || doc_id || ':' || replica) AS shuffle_key
FROM (SELECT *, unnest(range(n_copies)) AS replica FROM c)"""
