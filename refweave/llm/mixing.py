"""Mixing sources to target weights by Poisson replication (DataFrame operations only).

Each source gets a rate: the number of times its documents should occur on average so that sources meet their target shares. A document's
count inverts the Poisson distribution of that mean at a uniform number hashed from seed and id, so its count depends on nothing but its
source's rate. Every document is exploded by its count, then all copies are dealt over all partitions and ordered there by a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W

from .common import cut, table

#: Target shares are in proportion to (documents of the source) ** ALPHA: below 1, small sources are repeated and large ones thinned.
ALPHA = 0.5
SEED = 20
NO_SOURCE = "(none)"
#: Numbers in the sources' distributions up to which these are broadcast; beyond it documents are joined to them by shuffle.
BROADCAST_NUMBERS = 4_000_000


def _hash_hex(*parts) -> Column:
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column) else F.lit(str(p)) for p in parts]).cast("binary"))


def _name(doc_id: Column, text: Column) -> Column:
    """What a row's draw hashes: its id, or its text where the id is null, so that rows without one don't share a draw."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.coalesce(text, F.lit(""))))


def source_rates(docs: DataFrame, targets: DataFrame | None = None, alpha: float = ALPHA, epochs: float = 1.0) -> DataFrame:
    """(_source, n_docs, rate, cdf): one row per source. ``targets`` has (source, weight); without it weights are n_docs ** alpha.

    rate = weight / sum(weight) * epochs * all documents / n_docs. A source that ``targets`` lacks gets rate 0. cdf[k] = P(count <= k), to
    where the rest is below 1e-16; its terms come from logarithms, so large rates don't underflow. Weights count among sources that ``docs`` has.
    """
    sizes = docs.groupBy(F.coalesce("source", F.lit(NO_SOURCE)).alias("_source")).agg(F.count("*").alias("n_docs"))
    if targets is None:
        weighted = sizes.withColumn("_w", F.pow(F.col("n_docs").cast("double"), F.lit(float(alpha))))
    else:
        given = targets.groupBy(F.coalesce("source", F.lit(NO_SOURCE)).alias("_source")).agg(F.sum("weight").alias("_w"))
        weighted = sizes.join(given, "_source", "left").withColumn("_w", F.coalesce(F.greatest("_w", F.lit(0.0)), F.lit(0.0)))
    weighted = cut(weighted)
    weights, documents = weighted.agg(F.coalesce(F.sum("_w"), F.lit(0.0)), F.coalesce(F.sum("n_docs"), F.lit(0))).first()
    rate = F.col("_w") / F.lit(weights) * F.lit(float(epochs)) * F.lit(documents) / F.col("n_docs") if weights > 0 else F.lit(0.0)
    rated = weighted.select("_source", "n_docs", rate.alias("rate"))
    rated = cut(rated)
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 24).cast("int")
    terms = rated.where("rate > 0").select("_source", "rate", F.explode(F.sequence(F.lit(0), last)).alias("_k"))
    upto = W.partitionBy("_source").orderBy("_k")
    logs = terms.withColumn("_log", -F.col("rate") + F.sum(F.when(F.col("_k") > 0, F.log(F.col("rate") / F.col("_k"))).otherwise(0.0)).over(upto))
    sums = logs.withColumn("_sum", F.sum(F.exp("_log")).over(upto))
    cdfs = sums.groupBy("_source").agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "_sum"))), lambda x: x["_sum"]).alias("cdf"))
    return cut(rated.join(cdfs, "_source", "left").select("_source", "n_docs", "rate", F.coalesce("cdf", F.array(F.lit(1.0))).alias("cdf")))


def mix_sources(docs: DataFrame, targets: DataFrame | None = None, alpha: float = ALPHA, epochs: float = 1.0, seed: int = SEED) -> DataFrame:
    """All columns of ``docs`` plus rate, n_copies, copy (1 to n_copies) and shuffle_key; one row per copy.

    A null source is a source of its own. Rows that repeat an id get equal counts. Rows with a null id hash their text.
    Columns named like the added ones are replaced. An empty table gives an empty result.
    """
    docs = docs.drop("rate", "n_copies", "copy", "shuffle_key", "_source", "n_docs", "cdf")
    rates = source_rates(docs, targets, alpha, epochs)
    if (rates.agg(F.sum(F.size("cdf") + 4)).first()[0] or 0) <= BROADCAST_NUMBERS:
        rates = F.broadcast(rates)
    u = (F.conv(F.substring(_hash_hex(seed, _name(F.col("doc_id"), F.col("text"))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    counted = (
        docs.withColumn("_source", F.coalesce("source", F.lit(NO_SOURCE)))
        .join(rates, "_source")
        .withColumn("_u", u)
        .withColumn("n_copies", F.size(F.filter("cdf", lambda c: c <= F.col("_u"))))
        .where("n_copies > 0")
    )
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies")))).withColumn("shuffle_key", _hash_hex(seed, F.lit("copy"), _name(F.col("doc_id"), F.col("text")), F.col("copy")))
    return copies.drop("_source", "n_docs", "cdf", "_u").repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "text", "n_copies", "copy", F.round("rate", 6).alias("rate"), "shuffle_key")


OP8_SQL = f"""
WITH sizes AS (SELECT coalesce(source, '{NO_SOURCE}') AS s, count(*) AS n FROM documents GROUP BY 1),
rates AS (SELECT s, pow(n::DOUBLE, {ALPHA}) / (SELECT sum(pow(n::DOUBLE, {ALPHA})) FROM sizes) * (SELECT sum(n) FROM sizes) / n AS rate FROM sizes),
ks AS (SELECT s, rate, k::INT AS k FROM rates, range(0, 4000) AS r(k) WHERE k <= ceil(rate + 12 * sqrt(rate) + 24)),
lp AS (SELECT s, rate, k, -rate + coalesce(sum(CASE WHEN k > 0 THEN ln(rate / k) END) OVER (PARTITION BY s ORDER BY k), 0) AS log_p FROM ks),
cdf AS (SELECT s, rate, k, sum(exp(log_p)) OVER (PARTITION BY s ORDER BY k) AS c FROM lp),
u AS (SELECT doc_id, source, text, (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null:' || coalesce(text, ''))), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u FROM documents),
counted AS (SELECT u.doc_id, u.source, u.text, cdf.rate, count(*) FILTER (WHERE cdf.c <= u.u) AS n_copies
  FROM u JOIN cdf ON cdf.s = coalesce(u.source, '{NO_SOURCE}') GROUP BY ALL)
SELECT doc_id, source, text, n_copies::INT AS n_copies, copy::INT AS copy, round(rate, 6) AS rate,
  md5('{SEED}:copy:' || coalesce(doc_id::VARCHAR, 'null:' || coalesce(text, '')) || ':' || copy) AS shuffle_key
FROM (SELECT *, unnest(range(1, n_copies + 1)) AS copy FROM counted)
"""
