"""Language identification by a linear-chain conditional random field over words.

Each word has a label; a word's scores come from hashed features (affixes and inner
character n-grams of one to four characters over the word between boundary marks,
and the whole word as lexicon entry), and learned transitions tie neighbours. The
labels' marginals come from forward-backward over the whole text, so code-switched
texts are labelled word by word; a document's language is the label with the largest
expected share of its words, and that share is its score.

Forward-backward runs over chunks of all texts of a batch at once: products of the
transfer matrices of each chunk, a scan over the chunks of each text, then the
marginals within all chunks. Nothing is shuffled; the model is 2**18 rows of one
number per language, whatever the corpus' size.

Training takes the whole texts of at most ``TRAIN_DOCS`` labelled documents per language,
chosen by a hash of their ids. Code-switched sequences are made by stringing stretches
of different languages together.

A text longer than ``LABEL_BYTES`` is labelled in pieces of that size, at whose ends the
chain starts anew; their words' expected labels are summed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .bpe import byte_batches
from .common import pieces, release, table

TRAIN_DOCS = 150
BITS = 18
CHUNK = 64
ROUNDS = 30
#: Bytes of text labelled at once; the work arrays take about fifty times as much.
LABEL_BYTES = 1 << 20
#: Mean number of words before a made sequence changes its language.
STRETCH = 40
UNKNOWN = "und"


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words (a letter and the letters and marks after it) of all texts, and each
    text's number."""
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    split = pc.split_pattern_regex(low, r"^\pM+|(?:[^\pL\pM]+\pM*)+")
    flat, offsets = split.flatten(), split.offsets.to_numpy()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(full)])
    return flat.filter(pa.array(full)), (ends[offsets[1:] - offsets[0]] - ends[offsets[:-1] - offsets[0]]).astype(np.int64)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of the words one after another, and where each word's start."""
    chars = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    word = np.repeat(np.arange(len(words)), sizes)
    last = np.repeat(np.cumsum(sizes), sizes)
    here = np.arange(len(chars))
    at, feature, h = [], [], np.zeros(len(chars), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, 5):
            h = h * np.uint64(0x9E3779B97F4A7C15) + np.concatenate([chars[n - 1 :], np.zeros(n - 1, np.uint64)])
            ok = here + n <= last
            x = h[ok] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(n)
            at.append(word[ok])
            feature.append((x >> np.uint64(64 - BITS)).astype(np.int64))
        start = np.cumsum(sizes) - sizes
        whole = np.add.reduceat(chars * (np.uint64(0xBF58476D1CE4E5B9) ** ((here - start[word]) % 61 + 1).astype(np.uint64)), start) if len(words) else chars
        at.append(np.arange(len(words)))
        feature.append(((whole * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - BITS)).astype(np.int64))
    at, feature = np.concatenate(at), np.concatenate(feature)
    order = np.argsort(at, kind="stable")
    return feature[order], np.searchsorted(at[order], np.arange(len(words)))


class Model:
    def __init__(self, labels: list[str]):
        self.labels = labels
        self.weights = np.zeros((1 << BITS, len(labels)), np.float32)
        self.moves = np.zeros((len(labels), len(labels)))

    def emissions(self, words: list[str], block: int = 20_000) -> np.ndarray:
        out = [np.empty((0, len(self.labels)))]
        for i in range(0, len(words), block):
            f, start = word_features(words[i : i + block])
            n = np.diff(np.append(start, len(f)))[:, None]
            out.append(np.add.reduceat(self.weights[f], start, axis=0) / np.sqrt(n))
        return np.concatenate(out)


def marginals(scores: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, ...]:
    """Forward-backward over texts of ``sizes`` words laid end to end.

    Returns the label marginals of the words, and the parts from which expected
    transitions follow: forward vectors before each word and the words' (potential *
    backward) vectors. Every text is cut into chunks that are worked on together."""
    n_labels = scores.shape[1]
    sizes = sizes[sizes > 0]
    chunks = -(-sizes // CHUNK)
    first = np.cumsum(chunks) - chunks
    n = int(chunks.sum())
    rank = np.arange(n) - np.repeat(first, chunks)
    begin = np.repeat(np.cumsum(sizes) - sizes, chunks) + rank * CHUNK
    length = np.minimum(np.repeat(sizes, chunks) - rank * CHUNK, CHUNK)
    grid = begin[:, None] + np.arange(CHUNK)
    inside = np.arange(CHUNK) < length[:, None]
    em = np.exp(scores - scores.max(1, keepdims=True))[np.where(inside, grid, 0)]
    t = np.exp(moves)
    prod = np.broadcast_to(np.eye(n_labels), (n, n_labels, n_labels)).copy()
    many = np.repeat(chunks > 1, chunks)
    if many.any():
        p, e, live = prod[many], em[many], inside[many]
        for k in range(CHUNK):
            q = (p.reshape(-1, n_labels) @ t).reshape(p.shape) * e[:, k, None, :]
            q /= q.sum((1, 2), keepdims=True)
            p = np.where(live[:, k, None, None], q, p)
        prod[many] = p
    enter = np.full((n, n_labels), 1.0 / n_labels)
    leave = np.ones((n, n_labels))
    for j in range(1, int(chunks.max(initial=0))):
        at = first[chunks > j] + j
        v = np.einsum("ca,cab->cb", enter[at - 1], prod[at - 1])
        enter[at] = v / v.sum(1, keepdims=True)
    for j in range(int(chunks.max(initial=0)) - 1, 0, -1):
        at = first[chunks > j] + j
        v = np.einsum("cab,cb->ca", prod[at], leave[at])
        leave[at - 1] = v / v.sum(1, keepdims=True)
    before = np.empty((CHUNK, n, n_labels))
    a = enter
    for k in range(CHUNK):
        before[k] = a
        q = (a @ t) * em[:, k]
        a = np.where(inside[:, k, None], q / q.sum(1, keepdims=True), a)
    after = np.empty((CHUNK, n, n_labels))
    b = leave
    for k in range(CHUNK - 1, -1, -1):
        after[k] = em[:, k] * b
        q = after[k] @ t.T
        b = np.where(inside[:, k, None], q / q.sum(1, keepdims=True), b)
    keep = inside.T
    order = np.argsort(grid.T[keep])
    before, after = before[keep][order], after[keep][order]
    out = (before @ t) * after
    return out / out.sum(1, keepdims=True), before, after


def train(samples: list[tuple[str, list[str]]], seed: int = 0) -> Model | None:
    """Fit to (language, words); None without labelled words."""
    samples = [s for s in samples if s[1]]
    labels = sorted({s[0] for s in samples})
    if not labels:
        return None
    model, rng = Model(labels), np.random.default_rng(seed)
    runs = []
    for lang, words in samples:
        at = 0
        while at < len(words):
            n = int(rng.geometric(1 / STRETCH))
            runs.append((labels.index(lang), words[at : at + n]))
            at += n
    runs = [runs[i] for i in rng.permutation(len(runs))]
    # Sequences of about eight stretches each.
    tokens = [w for _, ws in runs for w in ws]
    gold = np.repeat([y for y, _ in runs], [len(ws) for _, ws in runs])
    sizes = np.add.reduceat([len(ws) for _, ws in runs], np.arange(0, len(runs), 8))
    distinct, where = np.unique(np.array(tokens, dtype=object), return_inverse=True)
    f, start = word_features(list(distinct))
    n = np.diff(np.append(start, len(f)))
    scale = 1 / np.sqrt(n)
    owner = np.repeat(np.arange(len(distinct)), n)
    begins = np.cumsum(sizes) - sizes
    inner = np.ones(len(tokens), bool)
    inner[begins] = False
    hot = np.eye(len(labels))[gold]
    seen = np.zeros((len(labels), len(labels)))
    np.add.at(seen, (gold[:-1][inner[1:]], gold[1:][inner[1:]]), 1)
    sq_w, sq_t = np.full(model.weights.shape, 1e-8, np.float32), np.full(model.moves.shape, 1e-8)
    for _ in range(ROUNDS):
        scores = np.add.reduceat(model.weights[f], start, axis=0) * scale[:, None]
        p, before, after = marginals(scores[where], sizes, model.moves)
        gap = hot - p
        pair = before[:, :, None] * np.exp(model.moves) * after[:, None, :]
        pair /= pair.sum((1, 2), keepdims=True)
        g_t = (seen - pair[inner].sum(0)) / len(tokens) - 1e-3 * model.moves
        by_word = np.stack([np.bincount(where, gap[:, y], len(distinct)) for y in range(len(labels))], 1) * scale[:, None]
        g_w = np.stack([np.bincount(f, by_word[owner, y], 1 << BITS) for y in range(len(labels))], 1).astype(np.float32) / len(tokens) - 1e-6 * model.weights
        sq_w += g_w * g_w
        sq_t += g_t * g_t
        model.weights += 0.3 * g_w / np.sqrt(sq_w)
        model.moves += 0.3 * g_t / np.sqrt(sq_t)
    return model


def _held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(documents: DataFrame, docs_per_language: int = TRAIN_DOCS) -> Model | None:
    """Learn from text and non-null lang of the documents that are not held out."""
    rows = documents.select(F.col("doc_id").cast("string").alias("id"), "text", "lang").where("lang is not null and text is not null").where(~_held_out(F.col("id")))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    rows = rows.withColumn("h", F.xxhash64(F.lit("sample"), "id"))
    # Hashes below a bound per language hold the sample and little more.
    bound = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, -(2**63) + min(2**64 - 1, math.ceil(2**64 * (docs_per_language + 6 * docs_per_language**0.5 + 20) / n)))])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    picked = rows.where(F.col("h") <= bound[F.col("lang")]).withColumn("r", rank).where(F.col("r") <= docs_per_language)
    samples = []
    for r in picked.select("lang", "id", "text").toLocalIterator():
        samples.append((r["lang"], split_words(pa.array([r["text"]]))[0].to_pylist()))
    return train(sorted(samples))


def expected(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each text's number of words and their expected labels."""
    words, sizes = split_words(texts)
    total = np.zeros((len(sizes), len(model.labels)))
    if len(words):
        coded = words.dictionary_encode()
        scores = model.emissions(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        p = marginals(scores, sizes, model.moves)[0]
        some = sizes > 0
        total[some] = np.add.reduceat(p, (np.cumsum(sizes) - sizes)[some], axis=0)
    return sizes, total


def label_batch(model: Model | None, texts: pa.Array, limit: int = LABEL_BYTES) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    langs, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
    if model is None:
        return langs.tolist(), score
    if len(texts) == 1 and texts[0].is_valid and len(texts[0].as_py()) > limit:
        parts = [expected(model, pa.array([x])) for x in pieces(texts[0].as_py(), limit)]
        sizes, total = sum(n for n, _ in parts), sum(t for _, t in parts)
    else:
        sizes, total = expected(model, texts)
    some = sizes > 0
    share = total[some] / sizes[some][:, None]
    langs[some] = np.array(model.labels, object)[share.argmax(1)]
    score[some] = np.clip(share.max(1), 0, 1)
    return langs.tolist(), score


def identify(documents: DataFrame, model: Model | None) -> DataFrame:
    """The columns of ``documents`` with held_out, lang_pred and score; input columns of
    those names are replaced.

    ``und`` with score 0 where the text is null or has no letter, and everywhere if
    there was nothing to learn from. Ties go to the first language in order. Repeated
    rows are labelled each. A null doc_id is not held out."""
    docs = documents.drop("held_out", "lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.withColumn("held_out", _held_out(F.col("doc_id")))

    def run(batches):
        for big in batches:
            for b in byte_batches(big, "text", LABEL_BYTES):
                langs, score = label_batch(shared.value, b.column("text"))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(score)], [*b.schema.names, "lang_pred", "score"])
        release()

    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.mapInArrow(run, schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs.select("doc_id", "text"), fit(docs)).select("doc_id", "held_out", "lang_pred", "score")
