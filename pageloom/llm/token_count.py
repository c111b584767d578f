"""Token counts: batch encoding in Arrow functions that return lengths only.

Batches are cut by bytes of text and long texts are split at blanks where the
tokenizer's pieces start (see bpe), so no list of ids is built and memory follows
the batch, not the corpus. There is no shuffle; a task's work follows its split.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Encoder, byte_batches, default_path
from .common import release, table


def count_tokens(documents: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_bytes, n_tokens, over_limit.

    A null text counts as an empty one: 0 bytes, 0 tokens. Repeated rows are counted
    each. Other columns are ignored."""

    def count(batches):
        encoder = Encoder.of(path)
        for big in batches:
            for b in byte_batches(big, "text"):
                n, _ = encoder.encode(b.column("text"), want_ids=False)
                size = pc.cast(pc.fill_null(pc.binary_length(b.column("text")), 0), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), size, pa.array(n, pa.int64()), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])
        release()

    docs = documents.select(F.col("doc_id").cast("long"), "text")
    return docs.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.json"))
