"""Nulls, empty and repeated rows, clashing columns and empty tables; brute force."""

import io
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pageloom.llm import ann, bpe, common, components, decontaminate, html_text, lang_id, lm_score, mixing, near_dup, ngram_trie, token_count, token_file, url_filter

PATH = bpe.default_path("byte_bpe_50k.json")
LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
ROWS = [
    (1, LONG, "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, LONG, "en", "a"), (4, LONG, "en", "a"), (None, "x y", "en", "b"),
    (5, "!!! ...", "de", "b"), (6, "der die das und ist nicht " * 400, "de", "b"), (7, "der die das", "de", None),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    clash = [F.lit(0).alias(c) for c in ("n_chars", "pos", "w", "k", "a", "b", "score", "lang_pred", "tkey", "copy_no", "mix_key")]
    return spark.createDataFrame(ROWS, SCHEMA).select("*", *clash).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_decontaminate(spark, docs, none):
    bench = spark.createDataFrame([(10, LONG.upper()), (11, "XX YY"), (12, None), (None, LONG), (10, LONG.upper()), (13, "x y")], "item_id long, text string")
    got = {(r.doc_id, r.n_words): r for r in decontaminate.decontaminate(docs, bench).collect()}
    assert (got[1, 14].n_hit, got[1, 14].n_items, got[1, 14].contaminated) == (14, 1, True)
    assert (got[None, 2].n_hit, got[None, 2].n_items) == (2, 1)
    assert got[2, 0].n_hit == 0 and not got[2, 0].contaminated
    assert decontaminate.decontaminate(docs, bench).count() == len(ROWS)
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.decontaminate(none, bench).count() == 0


def test_tokens(spark, docs, none):
    t = bpe.Encoder.of(PATH).tokenizer
    n = {(r.doc_id, r.n_bytes): r.n_tokens for r in token_count.count_tokens(docs, PATH).collect()}
    assert n == {(i, len((x or "").encode())): len(t.encode(x or "", add_special_tokens=False).ids) for i, x, _, _ in ROWS}
    assert token_count.count_tokens(none, PATH).count() == 0
    want, at = [], 0
    for i, x, _, _ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, token_file.encode_to_files(docs, PATH).collect()), key=lambda r: r[1]) == want
    assert token_file.encode_to_files(none, PATH).count() == 0


@pytest.mark.parametrize("width", [1, 7, 8, 13, 16, 17, 32])
def test_packing(width):
    x = np.random.default_rng(width).integers(0, 2**width, 1001).astype("<u4")
    assert (token_file.unpack(token_file.pack(x, width), len(x), width) == x).all()


def test_pieces():
    t, rng = bpe.Encoder.of(PATH).tokenizer, np.random.default_rng(0)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "<|endoftext|>", "é", "1", "!", "\u3000", "\x01", "\x1c", "\x85", " \n", "\ufeff"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(2000)] + ["".join(bpe._MARKS) + " a  b"]
    n, ids = bpe.Encoder.of(PATH).encode(pa.array(texts))
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in ((1, 0), (5, 3), (1000, 100000), (3000, 50), (70, 10**9)):
        v = np.sort(rng.integers(0, top + 1, n))
        width, parts = ngram_trie.EliasFano.encode(v)
        assert (ngram_trie.EliasFano(width, *parts)[np.arange(n)] == v).all()


def test_trie():
    """Levels found by context against plain counts; repeated rows are summed."""
    rng = np.random.default_rng(1)
    keys = rng.integers(4, 2**63, 40).astype(np.uint64)
    a, b, c = (keys[rng.integers(0, 40, 3000)] for _ in range(3))
    third = np.where(rng.random(3000) < 0.1, ngram_trie.NONE, ngram_trie.code(c))
    n = rng.integers(1, 9, 3000)
    out = io.BytesIO()
    ngram_trie.write_grams(out, ngram_trie.short(a), ngram_trie.code(b), third, n, 4.0)
    trie = ngram_trie.Grams(np.frombuffer(out.getvalue(), np.uint8))
    pair, gram = {}, {}
    for x, y, z, k in zip(a.tolist(), ngram_trie.code(b).tolist(), third.tolist(), n.tolist()):
        pair[x, y] = pair.get((x, y), 0) + k
        gram[x, y, z] = gram.get((x, y, z), 0) + k
    for x in keys:
        for y in ngram_trie.code(keys[:20]):
            place, count = trie.pairs(np.array([x]), np.array([y]))
            want = pair.get((int(x), int(y)), 0)
            assert (place[0] >= 0) == (want > 0) and abs(count[0] - want) <= 0.02 * want
            if want:
                z = ngram_trie.code(keys)
                got = trie.shares(np.repeat(place, 40), z)
                full = np.array([gram.get((int(x), int(y), int(k)), 0) for k in z]) / (want + 4.0)
                assert np.allclose(got, full, rtol=0.02)


def test_lm_rows():
    rng = np.random.default_rng(6)
    first = np.repeat(rng.integers(4, 2**63, 40).astype(np.uint64), 300)
    second = np.concatenate([np.sort(rng.integers(4, 2**63, 290)).astype(np.uint64) if i % 2 else np.repeat(np.uint64(i + 9), 290) for i in range(40) for _ in (0,)])
    first, third = first[: len(second)], rng.integers(0, 2**32, len(second)).astype(np.uint32)
    first, n = np.repeat(first[::290], 290), rng.integers(1, 600, len(second))
    a, b, c, k = lm_score._unpack(lm_score._pack(first, second, third, n))
    assert (a == ngram_trie.short(first)).all() and (b == ngram_trie.code(second)).all() and (c == third).all() and (k == n).all()


@pytest.mark.parametrize("limit, parts", [(50, 1), (12, 104)])
def test_lm_batch_counts(monkeypatch, limit, parts):
    """A batch of more tokens than WORDS is counted at once; only distinct words cut it."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(lm_score, "WORDS", limit)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 20, 30)) for _ in range(10)]
    got, seen = {}, list(lm_score.count_batch(*lm_score.tokens(pa.array(texts))))
    assert len(seen) <= parts and sum(len(n) for *_, n in seen) >= 100
    for a, b, c, n in seen:
        assert len(set(zip(a.tolist(), b.tolist(), c.tolist()))) == len(n)
        for x, y, z, k in zip(a.tolist(), b.tolist(), c.tolist(), n.tolist()):
            got[x, y, z] = got.get((x, y, z), 0) + k
    want = {}
    for t in texts:
        t = np.array([lm_score.BEGIN, *lm_score.word_keys(pa.array(t.split())), lm_score.END])
        for gram in [*zip(t.tolist(), t[1:].tolist(), ngram_trie.code(t[2:]).tolist()), (int(t[-2]), int(t[-1]), int(ngram_trie.NONE))]:
            want[gram] = want.get(gram, 0) + 1
    assert got == want


def test_lm_row_bytes():
    """First words in order of their keys take less than five bytes each."""
    rng = np.random.default_rng(4)
    first = np.sort(rng.integers(4, 2**63, 3000)).astype(np.uint64)
    second, third, n = rng.integers(4, 2**63, 3000).astype(np.uint64), rng.integers(1, 2**32, 3000).astype(np.uint32), np.ones(3000, np.int64)
    blob = lm_score._pack(first, second, third, n)
    assert len(blob) < 3000 * (4 + 4 + 3 + 4.5)
    a, b, c, k = lm_score._unpack(blob)
    assert (a == ngram_trie.short(first)).all() and (b == ngram_trie.code(second)).all() and (c == third).all() and (k == n).all()
    none = np.zeros(0, np.uint64)
    assert all(len(x) == 0 for x in lm_score._unpack(lm_score._pack(none, none, none.astype(np.uint32), none)))


def test_lm_words():
    keys, n = np.array([4, 9, 2**63 + 5], np.uint64), np.array([1, 254, 70_000])
    blob = lm_score._pack_words(keys, n)
    assert len(blob) < 16 * len(keys) and all((a == b).all() for a, b in zip(lm_score._unpack_words(blob), (keys, n)))


def test_lm(docs, none):
    got = lm_score.score(docs).collect()
    assert len(got) == len(ROWS) and {r.n_tokens for r in got if r.doc_id in (2, 3)} == {1}
    assert all(r.score < 0 and r.base_score < 0 for r in got)
    assert lm_score.score(none).count() == 0


@pytest.mark.parametrize("shard_bytes", [1 << 20, 500])
def test_lm_brute(spark, monkeypatch, shard_bytes):
    """Counts, base and model scores against plain dictionaries, over one or many shards."""
    rng = np.random.default_rng(9)
    words = ["The", "of", "x\u00c9", "a,b", "zebra", "Z\u00a0q", *(f"w{i}" for i in range(40))]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 60), p=np.arange(46, 0, -1) / 1081)) + rng.choice(["", " \t\n"])) for i in range(150)] + [(200, None), (None, "the of the of"), (201, "unseen of The")]
    monkeypatch.setattr(lm_score, "SHARD_BYTES", shard_bytes)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = {i: [w.translate(lower) for w in re.split("[ \t\n\x0b\f\r]+", t or "") if w] + [0] for i, t in rows}
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i in cut}
    one, two, three = {}, {}, {}
    for i, t in cut.items():
        if not held[i]:
            for k, w in enumerate(t):
                one[w] = one.get(w, 0) + 1
                p, q = t[k - 1] if k else 1, t[k - 2] if k > 1 else 1
                two[p, w] = two.get((p, w), 0) + 1
                if k:
                    three[q, p, w] = three.get((q, p, w), 0) + 1
    n, v, starts = sum(one.values()), len(one), sum(not held[i] for i in cut)
    base = lambda w: (one.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))
    got = lm_score.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert any(held.values()) and len(got) == len(rows)
    for r in got:
        t, full = cut[r.doc_id], 0.0
        for k, w in enumerate(t):
            p, q = t[k - 1] if k else 1, t[k - 2] if k > 1 else 1
            p2 = (two.get((p, w), 0) + 20 * base(w)) / ((one.get(p, 0) if k else starts) + 20)
            c2 = two.get((q, p), 0)
            full += math.log10((three.get((q, p, w), 0) + 4 * p2) / (c2 + 4) if k else p2)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(w in one for w in t), n)
        assert abs(r.base_score - sum(math.log10(base(w)) for w in t)) < 1e-8
        assert abs(r.score - full) <= 0.01 * len(t)


def test_urls(spark):
    pages = spark.createDataFrame([(1, "HTTP://WWW.Example.ORG/es/1?x"), (2, None), (3, "nothing"), (4, "http://a.com"), (None, "x://q.com/de/5#f"), (5, "x://example.org/en/12"), (5, "x://example.org/en/12")], "page_id long, url string")
    got = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in url_filter.filter_urls(pages.withColumn("host", F.lit(1))).collect()}
    assert got[1, "www.example.org", "/es/1"] == ("example.org/es/", "block") and got[2, "", ""][0] is None and got[3, "", ""] == got[2, "", ""]
    assert got[4, "a.com", ""][0] is None and got[None, "q.com", "/de/5"] == ("com/de/", "block") and got[5, "example.org", "/en/12"] == ("example.org/en/1", "block")
    assert url_filter.filter_urls(pages).count() == 7 and url_filter.filter_urls(pages.limit(0)).count() == 0


def test_deep_urls(spark):
    """Branches that differ below any depth have verdicts of their own; ties block."""
    deep = "/a/b/c/d/e/"
    rows = [(i, f"http://h.net{deep}{'x' if i % 2 else 'y'}/{i}") for i in range(40)] + [(100, "http://h.net/tie/p"), (101, "http://h.net/tie/p")]
    rules = [("block", "h.net", deep + "x/1"), ("allow", "h.net", deep + "y/1"), ("block", "h.net", deep + "x/3"), ("allow", "h.net", deep + "y/2")]
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert got[5] == "block" and got[4] == "allow" and got[100] == got[101]


def test_mix(docs, none):
    got = mixing.mix(docs, {"a": 1.0}, size=3.0)
    assert set(got.columns) == set(docs.columns) and {r.source for r in got.collect()} <= {"a"}
    assert sorted(map(str, got.collect())) == sorted(map(str, mixing.mix(docs.repartition(2), {"a": 1.0}, size=3.0).collect()))
    assert mixing.mix(none).count() == 0 and mixing.mix(docs, {}).count() == 0


def test_near(spark, docs, none):
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 1, None: None, 5: 5, 6: 6, 7: 7}
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, (1, 2, 3, 5, 6, 7, None)))
    assert near_dup.near_duplicates(none).count() == 0
    rng = np.random.default_rng(0)
    base, rows = [f"w{i}" for i in range(300)], []
    for i in range(60):
        words = list(base) if i < 30 else [f"v{x}" for x in rng.integers(0, 9999, 200)]
        for j in rng.integers(0, len(words), 4):
            words[j] = f"x{i}y{j}"
        rows.append((i, " ".join(words)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows]
    root = list(range(60))
    for i in range(60):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(60)] == root


def brute_classes(texts, threshold=0.8):
    sets, root = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def test_near_crowded(spark):
    """Of some thousand texts on one template two are alike, in buckets that all share."""
    template = [f"w{i}" for i in range(100)]
    texts = [" ".join([*template[:85], *(f"o{i}x{k}" for k in range(17))]) for i in range(1500)]
    texts[1203] = texts[411] + " more"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bands = F.array(*(F.lit(i).cast("long") for i in range(6)))
    size = (F.size(F.split("text", " ")) - 4).cast("long")
    reps = docs.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("f1"), F.col("doc_id").alias("f2"), "doc_id", F.xxhash64("text").alias("tkey"), size.alias("size"), bands.alias("bands"))
    got = near_dup.near_components(reps, docs).where("node <> label")
    assert [tuple(r) for r in got.collect()] == [(1203, 411)]


def test_near_open_pairs(spark):
    """Every alike pair across components is among the pairs, few others are."""
    rng = np.random.default_rng(1)
    texts = []
    for i in range(120):
        words = [f"g{i % 4}w{k}" for k in range(80)][: 60 + i % 20]
        for j in rng.integers(0, len(words), i % 5):
            words[j] = f"x{i}y{j}"
        texts.append(" ".join(words))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    comp = [i % 7 * 10 for i in range(120)]
    want = {(i, j) for j in range(120) for i in range(j) if comp[i] != comp[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = spark.createDataFrame([(i, comp[i]) for i in range(120)], "node long, comp long")
    reps = docs.select(F.col("doc_id").alias("node"), "doc_id", F.xxhash64("text").alias("tkey"))
    shingle_sets = near_dup.shingle_sets(reps, docs)
    assert {r.node: r.size for r in shingle_sets.collect()} == {i: len(sets[i]) for i in range(120)}
    first = near_dup.prefixes(nodes, shingle_sets, 0.8)
    got = {(r.a, r.b) for r in near_dup.open_pairs(first, nodes.withColumnRenamed("comp", "label"), 0.8).collect()}
    assert want and want <= got and all(comp[a] != comp[b] for a, b in got)


def test_near_one_id(spark):
    """Rows of one doc_id are judged by their own texts; repeated rows leave one."""
    x, y, z = (" ".join(f"{c}{i}" for i in range(40)) for c in "xyz")
    rows = [(1, x, "a"), (1, y, "a"), (1, x, "b"), (2, x + " more", "a"), (3, y.upper(), "a"), (4, z, "a"), (4, z, "a"), (None, z, "a"), (5, None, "a"), (5, None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [tuple(r) for r in near_dup.keep_one(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, x, "a"), (1, y, "a"), (4, z, "a"), (None, z, "a"), (5, None, "a"), (5, None, "a")]))
    classes = near_dup.near_duplicates(docs)
    assert classes.count() == len(rows) and {r.class_id for r in classes.where("doc_id in (1, 2, 3)").collect()} == {1}


def test_near_long_text(monkeypatch):
    """A text cut into pieces has the words, shingles and registers of the whole."""
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(["ab", "É", "x1", "-", " ", ". ", "\n", "世"], 3000)) + "w" * 500
    whole = near_dup.hashed_words(pa.array([text]), 1 << 20)
    cut = near_dup.hashed_words(pa.array([text]), 50)
    assert "".join(common.pieces(text, 50)) == text and len(common.pieces(text, 50)) > 50
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()
    h, at = near_dup.distinct(*near_dup.shingles(*whole))
    want = near_dup.signatures(h, at, np.ones(len(h)), 1)
    monkeypatch.setattr(near_dup, "DRAWN", 100)
    assert (near_dup.signatures(h, at, np.ones(len(h)), 1) == want).all()


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5), (2000, 1500), (2000, 1600)]
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(len(root)):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.label for r in components.components(df).collect()} == root
    assert components.components(df.limit(0)).count() == 0


def test_near_cluster_pairs(spark, monkeypatch):
    """A cluster of near copies makes about one link a member, not one for each bucket."""
    rng, base, rows = np.random.default_rng(5), [f"w{i}" for i in range(400)], []
    for i in range(400):
        words = list(base)
        for j in rng.integers(0, 400, 3):
            words[j] = f"x{i}y{j}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    reps = near_dup.representatives(near_dup.sketch(docs).cache())
    pairs, verify = [], near_dup.verify
    monkeypatch.setattr(near_dup, "verify", lambda p, *more: pairs.append(p.count()) or verify(p, *more))
    near_dup.near_components(reps, docs)
    assert sum(pairs) < 1.2 * 400
    monkeypatch.undo()
    assert {r.class_id for r in near_dup.near_duplicates(docs).collect()} == {0}


@pytest.mark.parametrize(("part", "times"), [(10, 100), (6, 100), (4, 1000)])
def test_near_counts(spark, part, times):
    """Texts of equal shingle sets share all bands, however often a part of one is repeated."""
    lines = [" ".join(f"l{n}w{k}" for k in range(8)) for n in range(20)]
    rows = [(i, " ".join([*lines, *(lines[:part] * n)])) for i, n in enumerate((2, times))]
    a, b = near_dup.sketch(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert a.size == b.size and a.bands == b.bands


def test_language(spark, docs, none):
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in lang_id.identify(docs, lang_id.fit(docs)).collect()}
    assert got[2, None] == ("und", 0) and got[3, ""] == ("und", 0) and got[5, "!!! ..."] == ("und", 0)
    assert got[1, LONG][0] == "en" and got[7, "der die das"][0] == "de"
    assert lang_id.identify(none, lang_id.fit(none)).count() == 0
    assert {r.lang_pred for r in lang_id.identify(docs, lang_id.fit(none)).collect()} == {"und"}


def test_language_texts():
    """Marks alone are no letter; a text in pieces has about the shares of the whole."""
    words, sizes = lang_id.split_words(pa.array(["\u0301\u0302", "a\u0301b 1\u0301c", "\u0301a-\u0302", None, "x"]))
    assert words.to_pylist() == ["a\u0301b", "c", "a", "x"] and sizes.tolist() == [0, 2, 1, 0, 1]
    en, de = "the of and to in is that it was for".split() * 30, "der die und das ist nicht ein zu mit von".split() * 30
    model = lang_id.train([("en", en), ("de", de)])
    text = pa.array([" ".join(en * 3 + de)])
    whole, cut = lang_id.label_batch(model, text), lang_id.label_batch(model, text, 500)
    assert whole[0] == cut[0] == ["en"] and abs(whole[1][0] - cut[1][0]) < 0.02
    even = lang_id.Model(["a", "b"])
    assert lang_id.label_batch(even, pa.array(["x y"])) == (["a"], [0.5])


def test_marginals():
    rng = np.random.default_rng(1)
    scores, moves, sizes = rng.normal(size=(200, 3)), rng.normal(size=(3, 3)), np.array([1, 130, 0, 5, 64])
    got, at, t = lang_id.marginals(scores, sizes, moves)[0], 0, np.exp(moves)
    for n in sizes:
        e, a, b = np.exp(scores[at : at + n]), [], [np.ones(3)]
        v = np.full(3, 1 / 3)
        for x in e:
            v = (v @ t) * x
            v = v / v.sum()
            a.append(v)
        for x in e[:0:-1]:
            v = t @ (x * b[-1])
            b.append(v / v.sum())
        if n:
            want = np.array(a) * np.array(b[::-1])
            assert np.allclose(got[at : at + n], want / want.sum(1, keepdims=True))
        at += n


def test_html(spark):
    foot = " ".join(f"foot{i}" for i in range(14))
    rows = [(i, "http://h/x", f"<div>own text of page {i} here</div><div>{foot}</div>") for i in range(4)]
    rows += [(9, "http://h/y", "<nav>m</nav><article><h1>T&amp;t</h1><p>a <b>b<br><p>c</article><footer>f</footer>"), (10, None, None), (11, "", ""), (11, "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = [(r.page_id, r.text, r.n_chars) for r in html_text.main_text(pages).collect()]
    assert sorted(got) == sorted([*((i, f"own text of page {i} here", 23) for i in range(4)), (9, "T&t\n\na b\n\nc", 11), (10, "", 0), (11, "", 0), (11, "", 0)])
    assert html_text.main_text(pages.limit(0)).count() == 0


def test_html_groups(spark, monkeypatch):
    """A menu on a few pages of a host is template text however the host is dealt."""
    menu = " ".join(f"menu{i}" for i in range(14))
    rows = [(i, "http://h/x", f"<div>own text of page {i} here</div>" + (f"<div>{menu}</div>" if i % 8 == 0 else "")) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    monkeypatch.setattr(html_text, "GROUP_BYTES", 150)
    got = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    assert got == {i: f"own text of page {i} here" for i in range(40)}


@pytest.mark.parametrize("group_bytes", [8 << 20, 400])
def test_html_article_template(spark, monkeypatch, group_bytes):
    """A notice without a class in most articles of a host is template text; a passage
    that fewer share, copies and near copies are not."""
    notice, passage = (" ".join(f"{w}{i}" for i in range(14)) for w in ("notice", "shared"))
    monkeypatch.setattr(html_text, "GROUP_BYTES", group_bytes)
    rows, want = [], {}
    for i in range(24):
        own = [" ".join(f"p{i}b{b}w{k}" for k in range(20)) for b in range(3)]
        body = own + [passage] * (i % 3 == 0)
        want[i] = "\n\n".join(body)
        if i % 4:
            body.insert(i % 3 + 1, notice)
        rows.append((i, "http://a.org/x", "".join(f"<p>{t}</p>" for t in body)))
        copy = [passage, " ".join(f"near{k}" for k in range(30))]
        rows.append((100 + i, "http://b.org/x", "".join(f"<p>{t}</p>" for t in copy)))
        want[100 + i] = "\n\n".join(copy)
        near = [f"number {i}", *copy]
        rows.append((200 + i, "http://c.org/x", "".join(f"<p>{t}</p>" for t in near)))
        want[200 + i] = "\n\n".join(near)
    pages = spark.createDataFrame([(i, u, f"<article>{h}</article>") for i, u, h in [*rows, rows[1]]], "page_id long, url string, html string")
    got = html_text.main_text(pages).collect()
    assert len(got) == len(rows) + 1 and {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_html_groups_without_judged(spark, monkeypatch):
    """Groups whose pages all have an article give the array text and have nothing to judge."""
    menu = " ".join(f"menu{i}" for i in range(14))
    rows = [(i, "http://h/x", f"<nav>{menu}</nav><article>text {i}</article>") for i in range(20)] + [(30, "http://h/x", f"<div>{menu}</div><div>own</div>")]
    monkeypatch.setattr(html_text, "GROUP_BYTES", 100)
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{i: f"text {i}" for i in range(20)}, 30: "own"}


def test_html_article_words():
    """Class words that may name parts of an article's own text remove nothing there."""
    page = '<div class="related">r</div><article><p>a</p><div class="related">b</div><p class="notice">c</p><section id="discussion">d</section><div class="ad">x</div><div id="comments">y</div><aside>z</aside></article>'
    assert [t for t, z in html_text.blocks(page) if z == html_text.ARTICLE] == ["a", "b", "c", "d"]
    assert [t for t, z in html_text.blocks(page) if z == html_text.BOILER] == ["r", "x", "y", "z"]


def test_runs_brute():
    """Suffix array and page counts of runs against plain comparison."""
    rng = np.random.default_rng(7)
    for _ in range(20):
        page = np.sort(rng.integers(0, 5, 200))
        tokens = rng.integers(0, 3, 200)
        ends = np.flatnonzero(np.append(page[1:] != page[:-1], True))
        tokens[ends] = -1 - page[ends]
        order = html_text.suffix_array(tokens, 4)
        assert [tuple(tokens[i : i + 4]) for i in order] == sorted(tuple(tokens[i : i + 4]) for i in range(200))
        start, number, pages = html_text.runs(tokens, page, 4)
        want = {}
        for i in range(197):
            if (tokens[i : i + 4] >= 0).all():
                want.setdefault(tuple(tokens[i : i + 4]), []).append(i)
        got = {}
        for i, k in zip(start, number):
            got.setdefault(k, []).append(int(i))
        assert sorted(sorted(v) for v in got.values()) == sorted(want.values())
        assert all(pages[k] == len({page[i] for i in v}) for k, v in got.items())


def test_html_brute(spark):
    """The query's text on pages without articles against counting runs by hand."""
    rng = np.random.default_rng(2)
    lines = [" ".join(f"l{n}w{k}" for k in range(rng.integers(8, 16))) for n in range(12)]
    rows = []
    for i in range(60):
        own = [" ".join(f"p{i}b{b}w{k}" for k in range(12)) for b in range(2)]
        picked = [lines[j] for j in rng.choice(12, 3, replace=False, p=np.array([1, 1, 1, 1, 1, 1, 1, 1, 8, 8, 8, 8]) / 40)]
        body = [own[0], *picked, own[1]]
        rows.append((i, f"http://h{i % 3}.example/x", "".join(f"<p>{t}</p>" for t in body)))
    rows.append(rows[0])
    seen = {}
    for i, url, page in set(rows):
        words = [w for t in html_text.blocks(page) for w in ["\0", *t[0].split()]]
        for k in range(len(words) - 9):
            seen.setdefault((url, tuple(words[k : k + 10])), set()).add(i)
    want = []
    for i, url, page in rows:
        own = [t for t, _ in html_text.blocks(page)]
        words = [(w, b) for b, t in enumerate(own) for w in ["\0", *t.split()]]
        mark = [False] * len(words)
        for k in range(len(words) - 9):
            if len(seen[url, tuple(w for w, _ in words[k : k + 10])]) >= 3:
                mark[k : k + 10] = [True] * 10
        keep = [t for b, t in enumerate(own) if sum(m for m, (_, x) in zip(mark, words) if x == b) < 0.8 * sum(x == b for _, x in words)]
        want.append((i, "\n\n".join(keep)))
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.text) for r in got) == sorted(want)
    assert len({len(t.split("\n\n")) for _, t in want}) > 1


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[100:150] = x[0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(700, None), (720, [0.0] * 8), (740, [float("nan")] * 8), (None, [1.0] * 8), (20, [float(v) for v in x[20]])]
    emb = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    hit, got = 0, ann.nearest(emb, shard_rows=200).toPandas()
    for q in range(0, 600, 20):
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        s[q] = -np.inf
        want = np.lexsort((np.arange(600), -s))[:20]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and np.allclose(mine.score, s[mine.vec_id])
        hit += len(set(want) & set(mine.vec_id))
    assert hit >= 0.9 * 600 and set(got.query_id) == set(range(0, 600, 20))
    assert ann.nearest(emb.limit(0)).count() == 0
    clash = emb.where("vec_id < 40 and size(embedding) = 8").select("*", *(F.lit(1).alias(c) for c in ("shard", "dim", "block", "score", "rank", "query_id")))
    assert ann.nearest(clash).count() == 2 * 20 and ann.nearest(clash).columns == ["query_id", "rank", "vec_id", "score"]


def test_nearest_large(spark):
    """Components whose squares overflow, and other vectors under the query's id."""
    rows = [(0, [3e38, 1.0]), (1, [2e38, 0.0]), (2, [-1e30, 5.0]), (3, [1.0, 1.0]), (0, [1e38, 0.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=4).collect()
    x = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    want = sorted(((float(q @ v), i) for k, q in x if k == 0 for i, v in x if v is not q), key=lambda t: (-t[0], t[1]))[:4]
    assert [(r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == want
