"""A corpus pipeline: language ID, near-dedup, decontamination, mixing, token files.

``STAGES`` are (name, function); each function takes (spark, docs, sf_dir) and all of
what the stage before kept, and all but the last return the columns of documents,
whatever they are called. A null or empty text has no letter and goes in the first
stage. Rows with a null doc_id are judged by their texts and never near-duplicates.
Repeated rows are judged alike; near-dedup leaves one of them. Of an empty table every
stage makes an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import decontaminate, lang_id, mixing, near_dup, token_file
from pageloom.llm.bpe import default_path
from pageloom.llm.common import materialise, table, text_key

#: Below this share of words in its best language a document is rejected.
LEAST_SHARE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those in which no language holds LEAST_SHARE, go."""
    labelled = lang_id.identify(docs, lang_id.fit(docs))
    return labelled.where((F.col("lang_pred") != lang_id.UNKNOWN) & (F.col("score") >= LEAST_SHARE)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of the least doc_id."""
    return near_dup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item word for word go, whatever share of
    their words it is: a long document teaches a passage as well as a short one."""
    judged = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    gone = judged.where("n_hit > 0").select(F.col("doc_id").alias("_id"), F.col("tkey").alias("_key")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]) & (text_key(docs["text"]) == gone["_key"]), "left_anti")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights of the square root of their sizes; copies are rows."""
    return mixing.mix(docs).select(docs.columns)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bit-packed token files, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_file.encode_to_files(docs, default_path("byte_bpe_50k.json"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token_files", token_files),
]

#: Language models and tokenizers are not SQL; tests/llm/test_pipeline.py compares the
#: stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
