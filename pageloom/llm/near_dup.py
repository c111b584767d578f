"""Near-duplicates by ProbMinHash, banding and verification.

A document is its set of shingles of ``SIZE`` words, all of one weight, whatever their
counts: so probability Jaccard similarity is the Jaccard similarity that is verified.
Every shingle is a Poisson process whose rate is its weight, seeded by the shingle's hash;
each arrival falls on one of ``REGISTERS`` registers, and a register keeps the shingle
that arrives first, so two documents' registers agree with the probability that is
their probability Jaccard similarity. Arrivals are made in rounds up to a time by
which all registers are nearly surely taken: later ones cannot change a register, so
a document of n shingles costs about n + 590 arrivals. Documents with a register
still free get twice the time.

Equal word sequences are one class before anything is compared. Registers are
banded (24 bands of 6: at a similarity of 0.8 a pair meets in some band with
probability 0.9993). A bucket's centre is its member of the least hash. Each text is
compared with one centre, the least of its buckets', so a cluster of any size makes one
pair a member; what that links gives components. Then a delegate of each component in
each bucket is compared with the bucket's centre. Of a bucket that
still holds several components, all pairs across them are then compared or ruled out
exactly: shingles that one component alone holds cannot be common, the
others are ordered from rare to frequent, and a pair that reaches the threshold shares
one early in both orders, at places that leave enough shingles behind (prefix, size
and position filters). So a pair is missed only if it shares no bucket.
Pairs are verified on their exact shingle sets, which are made once for the texts
that share a bucket: Jaccard similarity ``THRESHOLD`` or more. Classes are the
connected components.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_batches
from .common import materialise, pieces, release, table, text_key
from .components import components, relabel

SIZE = 5
THRESHOLD = 0.8
REGISTERS = 144
BAND = 6
#: Rounds: members meet the least centre of their buckets, then delegates of components theirs.
STARS = 2
#: Pairs, at most, by which each two components are compared in each round before all others.
MET = (1, 8)
#: Hash classes of the pairs between two components that are verified in each round; 0: all.
ACROSS = (16, 0)
#: Bytes of text sketched at once; the work arrays take about thirty times as much.
#: A longer text is cut between words, and its shingles are drawn ``DRAWN`` at once.
SKETCH_BYTES = 2 << 20
DRAWN = 1 << 20
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of lower-cased texts (runs of a-z, 0-9 and all beyond ASCII), and offsets."""
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    split = pc.split_pattern_regex(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    flat, offsets = split.flatten(), split.offsets.to_numpy().astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(full)])
    return flat.filter(pa.array(full)), ends[offsets - offsets[0]]


def word_hashes(words: pa.Array) -> np.ndarray:
    coded = words.dictionary_encode()
    own = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()] or [0], np.uint64)
    return own[coded.indices.to_numpy(zero_copy_only=False)]


def hashed_words(texts: pa.Array, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words, and offsets; a text beyond ``limit`` goes in pieces."""
    limit = limit or SKETCH_BYTES
    if len(texts) == 1 and texts[0].is_valid and len(texts[0].as_py()) > limit:
        parts = [word_hashes(split_words(pa.array([p]))[0]) for p in pieces(texts[0].as_py(), limit)]
        w = np.concatenate(parts)
        return w, np.array([0, len(w)])
    words, offsets = split_words(texts)
    return word_hashes(words) if len(words) else np.zeros(0, np.uint64), offsets


def fingerprints(w: np.ndarray, offsets: np.ndarray, texts: pa.Array) -> np.ndarray:
    """128 bits (two integers) of each text's word sequence, or of a text without words."""
    n = np.diff(offsets)
    out = np.zeros((len(n), 2), np.uint64)
    place = (np.arange(len(w)) - np.repeat(offsets[:-1], n)).astype(np.uint64)
    with np.errstate(over="ignore"):
        for i, seed in enumerate((_M1, _M2)):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(_mix(w + _mix(place * _GOLD + seed)), dtype=np.uint64)])
            out[:, i] = _mix(sums[offsets[1:]] - sums[offsets[:-1]] + n.astype(np.uint64))
    for i in np.flatnonzero(n == 0):
        out[i] = divmod(xxhash.xxh3_128_intdigest(texts[i].as_py()), 2**64)
    return out.view(np.int64)


def shingles(w: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of hashed words and the text of each; a text of fewer words,
    but not none, is one shingle."""
    n = np.diff(offsets)
    short = np.flatnonzero((n > 0) & (n < size))
    h, owner = np.zeros(max(0, len(w) - size + 1), np.uint64), np.repeat(np.arange(len(n)), n)
    with np.errstate(over="ignore"):
        for k in range(size):
            h = h * _GOLD + w[k : k + len(h)]
        first = owner[: len(h)]
        ok = first == owner[size - 1 :] if len(h) else np.zeros(0, bool)
        h, at = [_mix(h[ok])], [first[ok]]
        for d in short:
            x = np.uint64(n[d])
            for y in w[offsets[d] : offsets[d + 1]]:
                x = x * _GOLD + y
            h.append(_mix(np.array([x])))
            at.append(np.array([d]))
    return np.concatenate(h), np.concatenate(at)


def distinct(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text."""
    order = np.lexsort((h, at))
    h, at = h[order], at[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
    return h[new], at[new]


def signatures(h: np.ndarray, at: np.ndarray, weight: np.ndarray, n_texts: int, m: int = REGISTERS) -> np.ndarray:
    """ProbMinHash registers (the winning shingles' hashes) of each text; 0 without shingles."""
    out = np.zeros(n_texts * m, np.uint64)
    total = np.bincount(at, weight, n_texts)
    until = m * (math.log(m) + 5) / np.where(total > 0, total, 1)
    todo = np.ones(len(h), bool)
    while todo.any():
        best, rows = np.full(n_texts * m, np.inf), np.flatnonzero(todo)
        for k in range(0, len(rows), DRAWN):
            src = rows[k : k + DRAWN]
            x, state = np.zeros(len(src)), h[src]
            with np.errstate(over="ignore"):
                while len(src):
                    state = state + _GOLD
                    r = _mix(state)
                    # 52 bits for the time, the rest for the register
                    x = x - np.log1p(-(r >> np.uint64(12)).astype(np.float64) / 2.0**52) / weight[src]
                    live = x <= until[at[src]]
                    src, x, state, r = src[live], x[live], state[live], r[live]
                    slot = at[src] * m + (_mix(r ^ _M2) % np.uint64(m)).astype(np.int64)
                    old = best[slot]
                    np.minimum.at(best, slot, x)
                    win = (best[slot] == x) & (x < old)
                    out[slot[win]] = h[src[win]]
        free = np.isinf(best.reshape(n_texts, m)).any(1) & (total > 0)
        todo &= free[at]
        until = np.where(free, until * 2, until)
    return out.reshape(n_texts, m)


def sketch(documents: DataFrame) -> DataFrame:
    """(doc_id, tkey, f1, f2, size, bands): key of the text, fingerprint of its word
    sequence, number of distinct shingles and band hashes, for rows whose doc_id and
    text are not null. Without words, the text itself is the fingerprint and there
    are no bands."""
    names = ["doc_id", "tkey", "f1", "f2", "size", "bands"]

    def run(batches):
        for big in batches:
            for b in byte_batches(big, "text", SKETCH_BYTES):
                texts = b.column("text")
                w, offsets = hashed_words(texts)
                prints = fingerprints(w, offsets, texts)
                h, at = distinct(*shingles(w, offsets))
                size = np.bincount(at, minlength=len(texts)).astype(np.int64)
                sig = signatures(h, at, np.ones(len(h)), len(texts)).reshape(len(texts), -1, BAND)
                band = np.zeros(sig.shape[:2], np.uint64)
                with np.errstate(over="ignore"):
                    for k in range(BAND):
                        band = _mix(band * _GOLD + sig[:, :, k])
                    band = _mix(band + np.arange(band.shape[1], dtype=np.uint64))
                has = np.diff(offsets) > 0
                ends = np.concatenate([[0], np.cumsum(np.where(has, band.shape[1], 0))]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(band[has].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tkey"), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array(size), bands], names)
        release()

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("tkey"), "text")
    return docs.where("doc_id is not null and text is not null").mapInArrow(run, "doc_id long, tkey long, f1 long, f2 long, size long, bands array<long>")


def representatives(sketches: DataFrame) -> DataFrame:
    """(node, f1, f2, doc_id, tkey, size, bands): one row of each word sequence, that of
    the least doc_id. ``node`` is that doc_id, or a hash where rows of one doc_id have
    different texts and it would stand for several."""
    first = sketches.groupBy("f1", "f2").agg(F.min("doc_id").alias("doc_id"))
    several = first.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("shared"))
    reps = sketches.join(first, ["f1", "f2", "doc_id"]).dropDuplicates(["f1", "f2"])
    node = F.when(F.col("shared").isNull(), F.col("doc_id")).otherwise(F.xxhash64("doc_id", "f1", "f2"))
    return reps.join(several, reps["doc_id"] == several["shared"], "left").select(node.alias("node"), "f1", "f2", "doc_id", "tkey", "size", "bands")


def verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have at least that Jaccard similarity."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("hs").alias(f"{c}_hs"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    common = F.size(F.array_intersect("a_hs", "b_hs"))
    return both.where(common >= F.lit(threshold) * (F.size("a_hs") + F.size("b_hs") - common) - 1e-9).select("a", "b")


def _crowded(buckets: DataFrame) -> DataFrame:
    """Members of buckets with at least two."""
    many = buckets.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k")
    return buckets.join(many, "k")


def shingle_sets(reps: DataFrame, documents: DataFrame) -> DataFrame:
    """(node, size, hs) with the distinct shingles of the representatives' texts."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("tkey"), "text").where("text is not null")

    def run(batches):
        for big in batches:
            for b in byte_batches(big, "text", SKETCH_BYTES):
                h, at = distinct(*shingles(*hashed_words(b.column("text"))))
                ends = np.searchsorted(at, np.arange(b.num_rows + 1)).astype(np.int32)
                hs = pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(np.diff(ends).astype(np.int64)), hs], ["node", "size", "hs"])
        release()

    both = texts.join(reps.select("node", "doc_id", "tkey"), ["doc_id", "tkey"]).select("node", "text")
    return both.mapInArrow(run, "node long, size long, hs array<long>").dropDuplicates(["node"])


def prefixes(nodes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(s, node, size, rest, least): the early shingles of ``nodes`` (node, comp), in the
    order from rare to frequent of those that several components hold; ``rest`` counts
    a node's such shingles from there on.

    Of a pair of different components with at least that Jaccard similarity, the smaller
    set (then the lesser node) has its first common shingle among the first size -
    2t/(1+t) size + 1 (``least``), the larger among the first size - t size + 1; from
    there on both hold the overlap t/(1+t) (sum of sizes) or more. What components hold
    alone stays so when components join, hence one table serves all rounds."""
    share = threshold / (1 + threshold)
    flat = sets.join(nodes, "node").select("node", "comp", "size", F.explode("hs").alias("s"))
    held = flat.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("s", "n")
    order = flat.join(held, "s").groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("n", "s"))).alias("o"))
    place = order.select("node", "size", F.size("o").alias("n_open"), F.posexplode("o").alias("i", "x"))
    rest = place.select("x.s", "node", "size", (F.col("n_open") - F.col("i")).cast("long").alias("rest"))
    early = lambda part: F.col("rest") >= F.ceil(F.col("size") * F.lit(part) - 1e-6)
    return rest.where(early(threshold)).withColumn("least", early(2 * share))


def _meet(first: DataFrame, labels: DataFrame, threshold: float) -> tuple[DataFrame, ...]:
    """``prefixes`` with components x and y, and (s, x_comp, y_comp, x, y, ...): where two
    components meet, with the node of each that has most left from there on."""
    first = first.join(labels.select("node", F.col("label").alias("comp")), "node")
    enough = F.expr(f"least(x_rest, y_rest) >= (x_size + y_size) * {threshold / (1 + threshold)!r}D - 1e-6D")
    side = lambda df, c: df.select("s", F.col("comp").alias(f"{c}_comp"), F.col("node").alias(c), F.col("size").alias(f"{c}_size"), F.col("rest").alias(f"{c}_rest"))
    ends = lambda df, c: df.groupBy("s", f"{c}_comp").agg(F.max(f"{c}_rest").alias(f"{c}_rest"), F.min(f"{c}_size").alias(f"{c}_size"), F.max_by(c, F.struct(f"{c}_rest", c)).alias(c))
    x, y = side(first.where("least"), "x"), side(first, "y")
    return x, y, ends(x, "x").join(ends(y, "y"), "s").where(enough & F.expr("x_comp <> y_comp")), enough


def open_pairs(first: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, common) of nodes of different components, with the number of early
    shingles that both hold, among them all whose shingle sets have at least that
    Jaccard similarity. Components meet before their nodes, so nodes of one component
    are never paired."""
    x, y, meet, enough = _meet(first, labels, threshold)
    fits = enough & F.expr(f"(x_size < y_size or (x_size = y_size and x < y)) and x_size >= y_size * {threshold!r}D - 1e-9D")
    pairs = x.join(meet.select("s", "x_comp", "y_comp"), ["s", "x_comp"]).join(y, ["s", "y_comp"]).where(fits)
    return pairs.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count(F.lit(1)).alias("common"))


def join_met(labels: DataFrame, first: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``labels`` joined where, in growing numbers, nodes verify by which two components
    meet. What it leaves is for the pairs of all nodes."""
    for some in MET:
        meet = _meet(first, labels, threshold)[2]
        best = meet.groupBy("x_comp", "y_comp", F.pmod(F.xxhash64("s"), F.lit(some)).alias("part")).agg(F.max(F.struct(F.least("x_rest", "y_rest").alias("r"), "x", "y")).alias("m"))
        pairs = materialise(best.select(F.least("m.x", "m.y").alias("a"), F.greatest("m.x", "m.y").alias("b")).distinct(), "met")
        labels = _join(labels, materialise(verify(pairs, sets, threshold), "links"))
    return labels


def _join(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) where ``links`` (a, b) between nodes of ``labels`` make labels one."""
    top = components(relabel(links, labels)).select(F.col("node").alias("label"), F.col("label").alias("top"))
    return materialise(labels.join(top, "label", "left").select("node", F.coalesce("top", "label").alias("label")), "labels")


def join_across(labels: DataFrame, pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``labels`` joined where pairs (a, b, common) verify. In a few rounds, of each two
    labels some pairs are verified, those with most in common of growing numbers of
    hash classes, and pairs within a label then are dropped; at last all that are left."""
    for some in ACROSS:
        ends = pairs.join(labels.select(F.col("node").alias("a"), F.col("label").alias("x")), "a")
        ends = ends.join(labels.select(F.col("node").alias("b"), F.col("label").alias("y")), "b").where("x <> y")
        ends = materialise(ends.select("a", "b", "common", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")), "across")
        part = F.pmod(F.xxhash64("a", "b"), F.lit(some)) if some else F.struct("a", "b")
        best = ends.groupBy("x", "y", part.alias("part")).agg(F.max(F.struct("common", "a", "b")).alias("m")).select("m.a", "m.b")
        best = materialise(best, "best")
        labels = _join(labels, materialise(verify(best, sets, threshold), "links"))
        pairs = ends.select("a", "b", "common").join(best, ["a", "b"], "left_anti")
    return labels


def near_components(reps: DataFrame, documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, label) of the nodes that share a bucket: label is the least node of those
    that verified links connect."""
    bands = reps.select("node", "size", F.explode("bands").alias("k")).distinct()
    buckets = materialise(_crowded(bands), "buckets")
    crowd = reps.join(buckets.select("node").distinct(), "node", "left_semi")
    sets = materialise(shingle_sets(crowd, documents), "sets")
    labels = sets.select("node", F.col("node").alias("label"))
    # Sets of sizes this far apart cannot reach the threshold.
    fits = F.least("size", "a_size") >= F.greatest("size", "a_size") * F.lit(threshold) - 1e-9
    members = buckets
    for salt in range(STARS):
        order = lambda seed: F.struct(F.xxhash64("node", F.lit(seed)).alias("h"), "node", "size")
        if salt:
            members = materialise(members.groupBy("k", "comp").agg(F.min(order(-salt)).alias("m")).select("k", "m.node", "m.size"), "delegates")
        centres = members.groupBy("k").agg(F.min(order(salt)).alias("c")).select("k", F.col("c.node").alias("a"), F.col("c.size").alias("a_size"))
        star = members.join(centres, "k").where(F.col("node") != F.col("a")).where(fits).select("node", "a")
        if not salt:
            star = star.groupBy("node").agg(F.min(F.struct(F.xxhash64("a", F.lit(salt)).alias("h"), "a")).alias("c")).select("node", "c.a")
        pairs = materialise(star.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct(), "pairs")
        labels = _join(labels, materialise(verify(pairs, sets, threshold), "links"))
        now = materialise(buckets.join(labels, "node").select("k", "node", "size", F.col("label").alias("comp")), "members")
        mixed = now.groupBy("k").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("k")
        members = materialise(now.join(mixed, "k"), "mixed")
    first = materialise(prefixes(members.select("node", "comp").distinct(), sets, threshold), "prefixes")
    labels = join_met(labels, first, sets, threshold)
    return join_across(labels, materialise(open_pairs(first, labels, threshold), "pairs"), sets, threshold)


def _classes(documents: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, tkey, node, class_id, kept) of each row whose doc_id and text are not
    null; rows of one doc_id and one word sequence are kept or not together."""
    sketches = materialise(sketch(documents), "sketches")
    reps = materialise(representatives(sketches), "representatives")
    labels = near_components(reps, documents, threshold)
    named = reps.select("node", "doc_id", "f1", "f2").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = materialise(named, "named")
    best = named.groupBy("label").agg(F.min(F.struct("doc_id", "node")).alias("best"))
    named = named.join(best, "label").select("f1", "f2", "node", F.col("best.doc_id").alias("class_id"), (F.col("node") == F.col("best.node")).alias("first"))
    kept = F.col("first") & (F.col("doc_id") == F.col("class_id"))
    return sketches.select("doc_id", "tkey", "f1", "f2").join(named, ["f1", "f2"]).select("doc_id", "tkey", "node", "class_id", kept.alias("kept"))


def near_duplicates(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, kept), one row per row of ``documents``; a class is named by its
    least doc_id, whose document is the one kept.

    Texts with the same words are alike; texts without words are alike if equal. Rows
    with one doc_id and different texts are judged each by its own text. A null text
    is a class of its own, as is a row with a null doc_id (its class_id is null); both
    are kept."""
    ids = F.col("doc_id").cast("long")
    alone = documents.where("doc_id is null or text is null").select(ids.alias("doc_id"), ids.alias("class_id"), F.lit(True).alias("kept"))
    return _classes(documents, threshold).select("doc_id", "class_id", "kept").unionByName(alone)


def keep_one(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents`` that stay: one of each class, and all rows whose doc_id
    or text is null. Of rows with one doc_id, each is judged by its own text; of those
    that repeat a kept text, the least (as JSON) stays."""
    classes = materialise(_classes(documents, threshold), "classes")
    gone = classes.where("not kept").select(F.col("doc_id").alias("_id"), F.col("tkey").alias("_key")).distinct()
    at = lambda d: (d["doc_id"].cast("long") == F.col("_id")) & (text_key(d["text"]) == F.col("_key"))
    again = classes.where("kept").groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node")
    stay = documents.join(gone, at(documents), "left_anti").select(documents.columns)
    if again.isEmpty():
        return stay
    again = classes.where("kept").join(again, "node", "left_semi").select(F.col("doc_id").alias("_id"), F.col("tkey").alias("_key"), "node").distinct()
    rest = stay.join(again.drop("node"), at(stay), "left_anti").select(documents.columns)
    row = F.struct(*(stay[c] for c in documents.columns))
    one = stay.join(again, at(stay)).groupBy("node").agg(F.min_by(row, F.to_json(row)).alias("_row"))
    return rest.unionByName(one.select("_row.*"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
