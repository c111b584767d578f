"""Language-model scores of texts from an n-gram trie built over the corpus.

Words are lower-cased (A-Z) runs without white space; every text ends in one end
token. A trigram's probability is (count + P3 p2) / (pair's count + P3), where p2 is the
pair's (count + P2 p1) / (word's count + P2) and p1 the base (add-0.1), so probabilities
sum to one over the known words and one unknown word.

Building: each task counts its batches' trigrams in sorted arrays and deals them to
shards by a hash of their first two words, as one small trie of 32-bit codes a batch and
shard; so a hot word's grams are spread over all shards, and a hot pair's are at
most its distinct successors a batch. Pairs' counts are sums over their trigrams. Each
shard is merged and written as a trie file (see ngram_trie) in the shared folder; the
words' own counts go to word shards. The number of shards follows the bytes of text.

Scoring maps the files (or, where the store is remote, reads one shard at a time) and
looks up each batch's distinct words, pairs and trigrams once, in their order. Word
keys are 64-bit hashes.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ngram_trie
from .bpe import byte_batches
from .common import release, shared_dir, table
from .near_dup import _GOLD, _mix
from .ngram_trie import code
from .token_file import _fs, publish

P2, P3 = 20.0, 4.0
#: Bytes of text counted and scored at once, and for which there is a shard.
BATCH_BYTES = 16 << 20
SCORE_BYTES = 6 << 20
SHARD_BYTES = 16 << 20
#: Distinct words above which three of their numbers do not fit one integer.
WORDS = (1 << 21) - 2
END, BEGIN = np.uint64(1), np.uint64(2)
_SHORT = np.uint64((1 << 40) - 1)


def _held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def word_keys(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words: sums of a random number for each byte at its place."""
    words = words.cast(pa.large_binary())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(words) and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    sizes = np.diff(offsets)
    with np.errstate(over="ignore"):
        place = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], sizes)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_mix((place.astype(np.uint64) << np.uint64(8) | data) * _GOLD + _GOLD), dtype=np.uint64)])
        keys = _mix(sums[offsets[1:] - offsets[0]] - sums[offsets[:-1] - offsets[0]] + sizes.astype(np.uint64))
    return keys | np.uint64(4)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all texts' tokens, each text's end token included, and offsets."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat, offsets = split.flatten(), split.offsets.to_numpy().astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(full)])
    offsets = ends[offsets - offsets[0]]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    own = word_keys(pc.ascii_lower(coded.dictionary))
    words = own[coded.indices.to_numpy(zero_copy_only=False)] if len(own) else np.zeros(0, np.uint64)
    return np.insert(words, offsets[1:], END), offsets + np.arange(len(offsets))


def shard_of(first: np.ndarray, second, shards: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (_mix(first * _GOLD + second) >> np.uint64(20)).astype(np.int64) % shards


def _contexts(t: np.ndarray, offsets: np.ndarray, begin) -> tuple[np.ndarray, np.ndarray]:
    """The token before each, and the one before that; ``begin`` where there is none."""
    one = np.roll(t, 1)
    one[offsets[:-1]] = begin
    two = np.roll(one, 1)
    two[offsets[:-1]] = begin
    return one, two


def count_batch(t: np.ndarray, offsets: np.ndarray):
    """Distinct (first, second, code of third or NONE, count), in order of the first two. All
    of a batch is counted at once, unless it has more distinct words than WORDS."""
    number, words = pd.factorize(np.concatenate([t, [BEGIN, np.uint64(0)]]), sort=True)
    begin, none = number[-2:]
    number = number[:-2]
    one, two = _contexts(number, offsets, begin)
    inner = np.ones(len(t), bool)
    inner[offsets[:-1]] = False
    last = t == END
    first = np.concatenate([two[inner], one[last]])
    second = np.concatenate([one[inner], number[last]])
    third = np.concatenate([number[inner], np.full(int(last.sum()), none)])
    del number, one, two, inner, last
    step = len(first) if len(words) <= WORDS else WORDS // 4
    for i in range(0, len(first), max(1, step)):
        a, b, c, own = first[i : i + step], second[i : i + step], third[i : i + step], words
        if len(words) > WORDS:
            number, which = pd.factorize(np.concatenate([a, b, c]), sort=True)
            (a, b, c), own = np.split(number, 3), words[which]
        w = np.int64(len(own))
        if w > WORDS:
            raise AssertionError("more words than rows allow")
        gram, count = np.unique((a * w + b) * w + c, return_counts=True)
        c = own[gram % w]
        yield own[gram // w // w], own[gram // w % w], np.where(c == 0, ngram_trie.NONE, code(c)), count


def _small(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in one byte each, and those of 255 or more apart."""
    return np.minimum(x, 255).astype(np.uint8), x[x >= 255].astype("<u4")


def _steps(keys: np.ndarray) -> tuple[int, np.ndarray]:
    """40-bit keys as steps from one to the next, in as many bits as the longest has."""
    steps = np.diff(keys, prepend=np.uint64(0)) & _SHORT
    width = int(steps.max()).bit_length() if len(steps) else 0
    bits = np.unpackbits(steps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :width]
    return width, np.packbits(bits.ravel(), bitorder="little")


def _from_steps(data: np.ndarray, n: int, width: int) -> np.ndarray:
    bits = np.zeros((n, 64), np.uint8)
    bits[:, :width] = np.unpackbits(data, count=n * width, bitorder="little").reshape(n, width)
    steps = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)
    return np.cumsum(steps, dtype=np.uint64) & _SHORT


def _pack(first, second, third, n) -> bytes:
    """Rows in order of (first, second) as a small trie of its own. A shard's first words are
    few enough for 40 bits of their keys, and close to each other in the order of keys."""
    new_pair = np.ones(len(first), bool)
    new_pair[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    pair = np.flatnonzero(new_pair)
    new_first = np.ones(len(pair), bool)
    new_first[1:] = first[pair][1:] != first[pair][:-1]
    own = np.flatnonzero(new_first)
    keys = ngram_trie.short(first[pair][own])
    small = [_small(x) for x in (np.diff(np.append(own, len(pair))), np.diff(np.append(pair, len(first))), n)]
    width, steps = _steps(keys)
    head = np.array([len(own), len(pair), len(first), *(len(big) for _, big in small), width], "<u4")
    parts = (head, code(second[pair]).astype("<u4"), third.astype("<u4"), *(big for _, big in small), *(x for x, _ in small), steps)
    return b"".join(p.tobytes() for p in parts)


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    n1, n2, n3, *big, width = np.frombuffer(blob, "<u4", 7).tolist()
    at, got = 28, []
    for kind, n in (*(("<u4", n) for n in (n2, n3, *big)), *(("u1", n) for n in (n1, n2, n3))):
        got.append(np.frombuffer(blob, kind, n, at))
        at += got[-1].nbytes
    sizes = [x.astype(np.int64) for x in got[5:]]
    for x, more in zip(sizes, got[2:5]):
        x[x == 255] = more
    keys = _from_steps(np.frombuffer(blob, np.uint8, -1, at), n1, width)
    return np.repeat(np.repeat(keys, sizes[0]), sizes[1]), np.repeat(got[0], sizes[1]), got[1], sizes[2]


def _pack_words(keys, n) -> bytes:
    small, big = _small(n)
    return np.array([len(keys), len(big)], "<u4").tobytes() + keys.astype("<u8").tobytes() + big.tobytes() + small.tobytes()


def _unpack_words(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, more = np.frombuffer(blob, "<u4", 2).tolist()
    keys, big, small = np.frombuffer(blob, "<u8", n, 8), np.frombuffer(blob, "<u4", more, 8 + 8 * n), np.frombuffer(blob, "u1", n, 8 + 8 * n + 4 * more)
    counts = small.astype(np.int64)
    counts[counts == 255] = big
    return keys, counts


def _by_shard(shard: np.ndarray, n: int):
    order = np.argsort(shard.astype(np.uint16 if n < 65536 else np.int64), kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(n + 1))
    return ((k, order[cuts[k] : cuts[k + 1]]) for k in range(n) if cuts[k] < cuts[k + 1])


def build(documents: DataFrame, folder: str) -> dict:
    """Write the model of ``documents`` to ``folder``; returns its totals. Null texts count
    as empty ones (one end token)."""
    spark = documents.sparkSession
    size = documents.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards = max(1, -(-size // SHARD_BYTES))

    def count(batches):
        for big in batches:
            for batch in byte_batches(big, "text", BATCH_BYTES):
                t, offsets = tokens(batch.column("text"))
                rows = []
                for first, second, third, n in count_batch(t, offsets):
                    for k, own in _by_shard(shard_of(first, second, shards), shards):
                        rows.append((k, 0, _pack(first[own], second[own], third[own], n[own])))
                keys, n = np.unique(np.concatenate([t, np.full(batch.num_rows, BEGIN)]), return_counts=True)
                for k, own in _by_shard(shard_of(keys, np.uint64(0), shards), shards):
                    rows.append((k, 1, _pack_words(keys[own], n[own])))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.binary()))], ["shard", "kind", "data"])
        release()

    def put(fs, base, name, write):
        from pyspark import TaskContext

        fs.create_dir(base, recursive=True)
        own = f"{base}/_attempt-{name}-{TaskContext.get().taskAttemptId()}"
        with fs.open_output_stream(own) as f:
            write(f)
        publish(fs, own, f"{base}/{name}")

    def merge(shard, kind, blobs):
        fs, base = _fs(folder)
        if kind == 0:
            rows = [np.concatenate(x) for x in zip(*map(_unpack, blobs))]
            put(fs, base, f"grams-{shard:07d}", lambda f: ngram_trie.write_grams(f, *rows, P3))
            return (shard, kind, 0, 0)
        flat = [_unpack_words(b) for b in blobs]
        keys, where = np.unique(np.concatenate([x[0] for x in flat]), return_inverse=True)
        counts = np.bincount(where, np.concatenate([x[1] for x in flat]), len(keys)).astype("<u8")
        put(fs, base, f"words-{shard:07d}", lambda f: f.write(keys.astype("<u8").tobytes() + counts.tobytes()))
        real = keys != BEGIN
        return (shard, kind, int(counts[real].sum()), int(real.sum()))

    def write(batches):
        held, done = {}, []
        for b in batches:
            for shard, kind, data in zip(*(b.column(i).to_pylist() for i in range(3))):
                if (shard, kind) not in held:
                    done += [merge(*k, v) for k, v in held.items()]
                    held = {(shard, kind): []}
                held[shard, kind].append(data)
        done += [merge(*k, v) for k, v in held.items()]
        release()
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip(("shard", "kind", "tokens", "words"), zip(*done))))

    dealt = documents.select("text").mapInArrow(count, "shard long, kind int, data binary").repartition(2 * shards, "shard", "kind").sortWithinPartitions("shard", "kind")
    done = dealt.mapInArrow(write, "shard long, kind long, tokens long, words long").collect()
    model = {"shards": shards, "grams": sorted(r.shard for r in done if not r.kind), "words": sorted(r.shard for r in done if r.kind), "n_tokens": sum(r.tokens for r in done), "n_words": sum(r.words for r in done)}
    fs, base = _fs(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/model.json") as f:
        f.write(json.dumps(model).encode())
    return model


class Model:
    """A model's shards, one at a time: mapped, or read where the store is remote. Maps are
    not kept, so a worker's memory does not grow with the model."""

    def __init__(self, folder: str, model: dict):
        self.folder, self.model = folder, model

    def _data(self, name: str) -> np.ndarray:
        from pyarrow.fs import LocalFileSystem

        fs, base = _fs(self.folder)
        if isinstance(fs, LocalFileSystem):
            return np.memmap(f"{base}/{name}", np.uint8, "r").view(np.ndarray)
        with fs.open_input_file(f"{base}/{name}") as f:
            return np.frombuffer(f.read(), np.uint8)

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Exact counts of words."""
        out, here = np.zeros(len(keys), np.int64), set(self.model["words"])
        for k, own in _by_shard(shard_of(keys, np.uint64(0), self.model["shards"]), self.model["shards"]):
            if k in here:
                known, n = self._data(f"words-{k:07d}").view("<u8").reshape(2, -1)
                at = np.minimum(np.searchsorted(known, keys[own]), len(known) - 1)
                out[own] = np.where(known[at] == keys[own], n[at], 0)
        return out

    def score(self, t: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Known tokens, base score and model score of each text."""
        total, words, shards = self.model["n_tokens"], self.model["n_words"], self.model["shards"]
        keys, number = np.unique(np.concatenate([t, [BEGIN]]), return_inverse=True)
        v = np.int64(len(keys))
        count = self.counts(keys)
        base = (count + 0.1) / (total + 0.1 * (words + 1))
        cur = number[: len(t)].astype(np.int64)
        begin = np.int64(number[-1])
        prev = np.concatenate([[begin], cur[:-1]])
        prev[offsets[:-1]] = begin
        pair, which = np.unique(prev * v + cur, return_inverse=True)
        a, b = pair // v, pair % v
        # A trigram is the number of its first pair with its last word.
        before = np.concatenate([[0], which[:-1]])
        gram, back = np.unique(before * v + cur, return_inverse=True)
        context, last = gram // v, gram % v
        n_pair, share = np.zeros(len(pair)), np.zeros(len(gram))
        shard, at = shard_of(keys[a], keys[b], shards), np.searchsorted(context, np.arange(len(pair) + 1))
        here, codes = set(self.model["grams"]), code(keys)
        for k, own in _by_shard(shard, shards):
            if k not in here:
                continue
            trie = ngram_trie.Grams(self._data(f"grams-{k:07d}"))
            place, n_pair[own] = trie.pairs(keys[a[own]], codes[b[own]])
            some = place >= 0
            size = (at[own + 1] - at[own])[some]
            mine = np.repeat(at[own][some] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            share[mine] = trie.shares(np.repeat(place[some], size), codes[last[mine]])
        p2 = (n_pair + P2 * base[b]) / (count[a] + P2)
        inner = np.ones(len(t), bool)
        inner[offsets[:-1]] = False
        p = p2[which]
        rest = P3 / (n_pair[before] + P3)
        full = np.log10(np.where(inner, share[back] + rest * p, p))
        known = np.concatenate([[0], np.cumsum(count[cur] > 0)])
        starts = offsets[:-1]
        return known[offsets[1:]] - known[starts], np.add.reduceat(np.log10(base)[cur], starts), np.add.reduceat(full, starts)


def score(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents``: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score; learnt from the rows that are not held out.

    A null text is scored as an empty one: its end token. Rows with a null doc_id are
    not held out. Repeated rows are counted and scored each. With nothing to learn from,
    every token has the probability of the unknown word. Other columns are ignored."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", _held_out(F.col("doc_id")))
    folder = shared_dir(spark, "trie")
    model = build(docs.where(~F.col("held_out")), folder)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches):
        m = Model(folder, model)
        for big in batches:
            for b in byte_batches(big, "text", SCORE_BYTES):
                t, offsets = tokens(b.column("text"))
                known, base, full = m.score(t, offsets)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(np.diff(offsets)), pa.array(known), pa.array(np.full(len(known), model["n_tokens"])), pa.array(base), pa.array(full)], names)
        release()

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
