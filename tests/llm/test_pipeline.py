"""Every stage of the pipeline, and run(), against plain Python on a small table."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pageloom.llm import bpe, lang_id, mixing

EN = "the of and to in is that it was for on are as with his they at be this from".split()
DE = "der die das und ist nicht ein zu mit von auf den des sich dem im als auch es an".split()


def _text(rng, words, n):
    return " ".join(w + str(k) if k % 7 == 0 else w for k, w in enumerate(rng.choice(words, n)))


@pytest.fixture(scope="module")
def rows():
    rng, out = np.random.default_rng(11), []
    for i in range(60):
        lang, words = (("en", EN), ("de", DE))[i % 2]
        out.append((i, _text(rng, words, 60), lang, "ab"[i % 3 % 2]))
    out += [(100, out[3][1] + " extra", "de", "a"), (101, out[4][1].upper(), "en", "b"), (4, out[4][1], "en", "a")]
    out += [(102, None, "en", "a"), (103, "", None, "b"), (104, "?! 12", "en", "a"), (None, _text(rng, EN, 40), "en", None)]
    out.append((105, _text(rng, EN, 600) + " " + BENCH + " " + _text(rng, EN, 600), "en", "a"))
    return out


BENCH = " ".join(f"q{i}" for i in range(14))


@pytest.fixture(scope="module")
def sf_dir(spark, rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text")).withColumn("tkey", F.lit(1)).withColumn("score", F.lit("x"))
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, BENCH.upper()), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def _ids(df):
    return sorted(map(str, (r.doc_id for r in df.collect())))


def test_stages(spark, rows, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    got = stages["language"](spark, docs, sf_dir)
    assert got.columns == docs.columns
    assert _ids(got) == sorted(str(r[0]) for r in rows if r[1] and re.search("[a-zA-Z]", r[1]))
    kept = stages["near_duplicates"](spark, got, sf_dir)
    assert kept.columns == docs.columns
    assert _ids(kept) == sorted([*map(str, range(60)), "None", "105"])
    clean = stages["decontamination"](spark, kept, sf_dir)
    assert clean.columns == docs.columns and _ids(clean) == sorted([*map(str, range(60)), "None"])
    mixed = stages["mixture"](spark, clean, sf_dir)
    assert mixed.columns == docs.columns
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mix(clean).select(docs.columns).collect()))
    files = stages["token_files"](spark, mixed, sf_dir)
    t, want = bpe.Encoder.of(bpe.default_path("byte_bpe_50k.json")).tokenizer, []
    for r in mixed.collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((r.doc_id, len(ids), zlib.crc32(ids.tobytes())))
    result = sorted(files.collect(), key=lambda r: r.start)
    assert sorted(map(str, ((r.doc_id, r.n_tokens, r.ids_crc32) for r in result))) == sorted(map(str, want))
    assert [r.start for r in result] == [0, *np.cumsum([r.n_tokens for r in result])[:-1].tolist()]
    assert [r.doc_id or -1 for r in result] == sorted(r.doc_id or -1 for r in result)


def test_empty(spark, sf_dir):
    none = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, none, sf_dir)
        assert got.count() == 0 and (name == "token_files" or got.columns == none.columns)


def test_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert {r.doc_id for r in got.collect()} <= {None, *range(60)}


def test_undetermined(spark, sf_dir):
    """Nothing to learn from: no document has a language, and all go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.STAGES[0][1](spark, docs, sf_dir).count() == 0
    assert lang_id.fit(docs) is None
