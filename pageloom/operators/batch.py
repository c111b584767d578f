"""Queues of pages and the totals of a batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States of a page that failed, and the group of pages without a category.
FAILED = ["fetch-failed", "extract-failed", "error"]
UNSORTED = "(未分類)"


def build_queue(*sources: DataFrame) -> DataFrame:
    """Union of the sources with status and duplicate_url: whether another row has the URL.

    URLs are counted and joined back, not windowed, so that no URL is sorted in one task.
    Null and empty URLs are no duplicates."""
    queue = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
    twice = queue.where("url <> ''").groupBy("url").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("url", F.lit(True).alias("_twice"))
    return queue.join(twice, "url", "left").select(*queue.columns, F.lit("pending").alias("status"), F.coalesce("_twice", F.lit(False)).alias("duplicate_url"))


def batch_summary(batch: DataFrame) -> DataFrame:
    """One row: pages, done, failed, duplicates, auto_accepted, remaining."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return batch.agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status").isin(FAILED)).alias("failed"),
        F.count_if("duplicate_url").alias("duplicates"), total("auto_accepted").alias("auto_accepted"), total("remaining").alias("remaining"))


def pages_by(batch: DataFrame, key: Column) -> DataFrame:
    """(group, pages, unsorted); order by unsorted and group for the report."""
    group = F.when(F.coalesce(key, F.lit("")) != "", key).otherwise(UNSORTED)
    return batch.groupBy(group.alias("group")).agg(F.count(F.lit(1)).alias("pages")).withColumn("unsorted", F.col("group") == UNSORTED)


def rule_counts(rules: DataFrame) -> DataFrame:
    """(dimension, value, n): rules by category and by processing class."""
    kinds = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in ("category", "processing_class")])
    return rules.select(F.explode(kinds).alias("k")).groupBy("k.dimension", "k.value").agg(F.count(F.lit(1)).alias("n"))
