"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate: its share of the mixture over its share
of the corpus. A document's number of copies is the Poisson quantile, with that
mean, of a number that a seeded hash draws from its id; so any retry, partitioning
or order gives the same mixture. Copies are exploded and dealt over the cluster
by a seeded hash of id and copy number, which is the global shuffle, and sorted by
it within each partition.

A hot source is no hot key: counts are partially aggregated, the rates are one
short row a source, and the shuffle key is uniform.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Larger means are drawn as sums of parts of at most this mean.
PART = 500.0


def _unit(*parts: Column) -> Column:
    """Uniform in [0, 1) from 48 bits of a hash."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def source_rates(documents: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, size: float = 1.0) -> DataFrame:
    """(source, rate, parts, cdf): mean copies of each source's documents.

    Without ``weights`` a source's target weight is its number of documents to the
    power ``temperature``; with them, sources that have none get 0. The mixture has
    ``size`` times the corpus' rows in expectation."""
    counts = documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        counts = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(temperature))))
    else:
        pairs = [F.lit(x) for k, v in weights.items() for x in (k, float(v))]
        counts = counts.withColumn("w", F.coalesce(F.create_map(*pairs)[F.col("source")], F.lit(0.0)) if pairs else F.lit(0.0))
    total = counts.agg(F.sum("w").alias("sw"), F.sum("n").alias("sn"))
    rates = counts.join(F.broadcast(total)).select("source", F.when(F.col("sw") > 0, F.col("w") / F.col("sw") * F.col("sn") * F.lit(float(size)) / F.col("n")).otherwise(0.0).alias("rate"))
    rates = rates.withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int"))
    mean = F.col("rate") / F.col("parts")
    steps = F.sequence(F.lit(1), F.ceil(mean + 10 * F.sqrt(mean) + 40).cast("int"))
    first = F.exp(-mean)
    grow = F.aggregate(
        steps, F.struct(F.array(first).alias("cdf"), first.alias("p"), first.alias("c")),
        lambda a, k: F.struct(F.concat(a["cdf"], F.array(a["c"] + a["p"] * mean / k)).alias("cdf"), (a["p"] * mean / k).alias("p"), (a["c"] + a["p"] * mean / k).alias("c")),
        lambda a: a["cdf"],
    )
    return rates.withColumn("cdf", grow)


def mix(documents: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, size: float = 1.0, seed: int = 0) -> DataFrame:
    """The columns of ``documents``, with copy_no (from 1) and mix_key (the order of the
    mixture), one row per copy; columns of those names in the input are replaced.

    Rows with equal doc_id draw equal counts; a null doc_id counts as the id "null";
    a null source is a source of its own. Texts are carried whole, null or not."""
    docs = documents.drop("copy_no", "mix_key")
    rates = source_rates(docs, weights, temperature, size).select(F.col("source").alias("_mix_source"), F.col("parts").alias("_mix_parts"), F.col("cdf").alias("_mix_cdf"))
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    joined = docs.join(rates, docs["source"].eqNullSafe(rates["_mix_source"]))
    draws = F.transform(F.sequence(F.lit(0), F.col("_mix_parts") - 1), lambda j: _unit(F.lit(str(seed)), own, j.cast("string")))
    count = F.aggregate(draws, F.lit(0), lambda acc, u: acc + F.size(F.filter("_mix_cdf", lambda c: c <= u)))
    copies = joined.withColumn("_mix_n", count).where("_mix_n > 0").select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_n").cast("long"))).alias("copy_no"))
    keyed = copies.withColumn("mix_key", _unit(F.lit(f"{seed}/order"), own, F.col("copy_no").cast("string")))
    return keyed.repartition("mix_key").sortWithinPartitions("mix_key", "doc_id", "copy_no")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


def mix_sql(source: str, temperature: float = 0.5, seed: int = 0, columns: str = "doc_id, text, lang, source, n_chars", extra: bool = True) -> str:
    """The same in DuckDB over ``source``, for means of at most PART."""
    unit = "CAST('0x' || substr(md5({}), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE"
    order = unit.format(f"'{seed}/order:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || CAST(copy_no AS VARCHAR)")
    return f"""
WITH RECURSIVE mix_in AS (SELECT * FROM {source}),
mix_n AS (SELECT source, count(*) AS n, pow(CAST(count(*) AS DOUBLE), {temperature}) AS w FROM mix_in GROUP BY source),
mix_t AS (SELECT sum(w) AS sw, CAST(sum(n) AS BIGINT) AS sn FROM mix_n),
mix_rate AS (SELECT source, w / sw * sn * CAST(1.0 AS DOUBLE) / n AS rate FROM mix_n, mix_t),
mix_cdf AS (SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM mix_rate
  UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM mix_cdf WHERE k < ceil(rate + 10 * sqrt(rate) + 40)),
mix_list AS (SELECT source, list(c ORDER BY k) AS cdf FROM mix_cdf GROUP BY source),
mix_u AS (SELECT d.*, l.cdf, {unit.format(f"'{seed}:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':0'")} AS u FROM mix_in d JOIN mix_list l ON d.source IS NOT DISTINCT FROM l.source),
mix_c AS (SELECT {columns}, unnest(range(1, 1 + len(list_filter(cdf, lambda c: c <= u)))) AS copy_no FROM mix_u)
SELECT {columns}{f", copy_no, {order} AS mix_key" if extra else ""} FROM mix_c
"""


SQL = mix_sql("documents")
