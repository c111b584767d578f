"""Queries over the driver tables, and their SQL."""

from pyspark.sql import DataFrame, SparkSession

from pageloom.plans.queries import ORACLE_SQL, QUERIES, link_audit

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_audit(spark, sf_dir)
