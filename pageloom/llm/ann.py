"""Approximate nearest neighbours by largest inner product: robust-pruned graphs.

Vectors are dealt to shards of about ``SHARD_ROWS`` by a hash of their ids; every
shard gets a directed graph. Inner product becomes distance by one more coordinate,
sqrt(M^2 - |x|^2), M the shard's largest norm. Points enter in batches: a greedy
search from the medoid proposes neighbours, relaxed pruning keeps a candidate unless
a kept one is ``ALPHA`` times nearer to it than the point is, and reverse edges are
added and pruned alike. Equal vectors are one node (else copies would crowd all
other edges out), which keeps its k + 1 least ids: no more can be reported.

Each shard's index is one row of a table in the shared folder. Queries go in blocks
to every shard, where a beam search finds candidates that are scored again in double
precision on the original vectors; the shards' lists are merged by rank.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

SHARD_ROWS = 8_000
BLOCK_ROWS = 20_000
DEGREE = 32
BEAM = 96
ALPHA = 1.2
#: Vectors with components beyond this are scaled.
LARGE = 1e15


def search(points: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, list]:
    """Beam search of all queries at once: ids (-1 where fewer) and squared distances of
    the nearest ``beam``, and the (query, node) pairs that were expanded."""
    nq, n = len(queries), len(points)
    norms = np.einsum("nd,nd->n", points, points)
    ids = np.full((nq, beam), -1, np.int32)
    dist = np.full((nq, beam), np.inf, np.float32)
    open_ = np.zeros((nq, beam), bool)
    seen = np.zeros((nq, n), bool)
    ids[:, 0], dist[:, 0], open_[:, 0], seen[:, entry] = entry, norms[entry] - 2 * queries @ points[entry], True, True
    live, trail = np.arange(nq), []
    while len(live):
        first = open_[live].argmax(1)
        go = open_[live, first]
        live, first = live[go], first[go]
        if not len(live):
            break
        at = ids[live, first]
        open_[live, first] = False
        trail.append((live, at))
        near = graph[at]
        fresh = (near >= 0) & ~seen[live[:, None], near]
        rows = np.broadcast_to(live[:, None], near.shape)[fresh]
        cols = near[fresh]
        seen[rows, cols] = True
        d = np.full(near.shape, np.inf, np.float32)
        d[fresh] = norms[cols] - 2 * np.einsum("nd,nd->n", points[cols], queries[rows])
        all_d = np.concatenate([dist[live], d], 1)
        order = np.argsort(all_d, 1, kind="stable")[:, :beam]
        dist[live] = np.take_along_axis(all_d, order, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(fresh, near, -1)], 1), order, 1)
        open_[live] = np.take_along_axis(np.concatenate([open_[live], fresh], 1), order, 1)
    return ids, dist, trail


def prune(points: np.ndarray, owners: np.ndarray, cand: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Up to ``degree`` diverse neighbours of each owner among its row of candidates
    (-1 pads; repeats and the owner itself are left out)."""
    cand = np.sort(cand, 1)
    cand = np.where((cand == owners[:, None]) | (np.diff(cand, axis=1, prepend=-2) == 0), -1, cand)
    x = points[cand]
    d = np.einsum("bcd,bcd->bc", x - points[owners][:, None], x - points[owners][:, None])
    d = np.where(cand < 0, np.inf, d)
    order = np.argsort(d, 1, kind="stable")
    cand, d = np.take_along_axis(cand, order, 1), np.take_along_axis(d, order, 1)
    x = points[cand]
    norm = np.einsum("bcd,bcd->bc", x, x)
    between = norm[:, :, None] + norm[:, None, :] - 2 * (x @ x.transpose(0, 2, 1))
    alive = np.isfinite(d)
    out = np.full((len(owners), degree), -1, np.int32)
    rows = np.arange(len(owners))
    for k in range(degree):
        first = alive.argmax(1)
        ok = alive[rows, first]
        if not ok.any():
            break
        out[ok, k] = cand[rows, first][ok]
        alive &= alpha * between[rows, first] > d
        alive[rows, first] = False
    return out


def build(points: np.ndarray, degree: int = DEGREE, beam: int = 64, alpha: float = ALPHA, seed: int = 0, batch: int = 256) -> tuple[np.ndarray, int]:
    """Neighbour table (-1 pads) and entry node."""
    n, rng = len(points), np.random.default_rng(seed)
    entry = int(((points - points.mean(0)) ** 2).sum(1).argmin())
    if n <= degree + 1:
        full = np.tile(np.arange(n, dtype=np.int32), (n, 1))
        np.fill_diagonal(full, -1)
        return full, entry
    graph = rng.integers(0, n, (n, degree)).astype(np.int32)
    graph = np.where(graph == np.arange(n)[:, None], (graph + 1) % n, graph).astype(np.int32)
    for a in (1.0, alpha):
        order = rng.permutation(n)
        for i in range(0, n, batch):
            own = order[i : i + batch]
            ids, _, trail = search(points, graph, entry, points[own], beam)
            graph[own] = prune(points, own, np.concatenate([ids, graph[own]], 1), a, degree)
            src = np.repeat(own, degree)
            dst = graph[own].ravel()
            src, dst = src[dst >= 0], dst[dst >= 0]
            order2 = np.argsort(dst, kind="stable")
            src, dst = src[order2], dst[order2]
            to, start, count = np.unique(dst, return_index=True, return_counts=True)
            extra = np.full((len(to), min(int(count.max()), 4 * degree)), -1, np.int32)
            place = np.arange(len(dst)) - np.repeat(start, count)
            ok = place < extra.shape[1]
            extra[np.repeat(np.arange(len(to)), count)[ok], place[ok]] = src[ok]
            for j in range(0, len(to), batch):
                t = to[j : j + batch]
                graph[t] = prune(points, t, np.concatenate([graph[t], extra[j : j + batch]], 1), a, degree)
    return graph, entry


def _index(pdf: pd.DataFrame, k: int) -> bytes:
    vectors = np.stack(pdf["embedding"].to_numpy()).astype(np.float32)
    ids = pdf["vec_id"].to_numpy(np.int64)
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    _, where = np.unique(vectors.view(np.dtype((np.void, vectors.strides[0]))).ravel(), return_inverse=True)
    by = np.argsort(where, kind="stable")
    place = np.arange(len(by)) - np.concatenate([[0], np.cumsum(np.bincount(where))[:-1]])[where[by]]
    kept = by[place <= k]
    node = where[kept]
    first = kept[place[place <= k] == 0]
    # Large components are scaled down, which orders inner products alike, so that squares
    # and their sums stay finite.
    exact = vectors[first]
    top = float(np.abs(exact).max())
    points = (exact / np.float32(top)).astype(np.float32) if top > LARGE else exact
    norms = np.sqrt((points.astype(np.float64) ** 2).sum(1))
    lifted = np.concatenate([points, np.sqrt(np.maximum(norms.max() ** 2 - norms**2, 0))[:, None].astype(np.float32)], 1)
    graph, entry = build(lifted)
    out = io.BytesIO()
    np.savez(out, exact=exact if top > LARGE else np.zeros(0, np.float32), lifted=lifted, graph=graph, entry=entry, ids=ids[kept], start=np.searchsorted(node, np.arange(len(points) + 1)))
    return out.getvalue()


def _answer(blob: bytes, query_ids: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
    f = np.load(io.BytesIO(blob))
    lifted, graph, entry, ids, start = f["lifted"], f["graph"], int(f["entry"]), f["ids"], f["start"]
    exact = (f["exact"] if f["exact"].size else lifted[:, :-1]).astype(np.float64)
    parts = []
    for i in range(0, len(queries), 512):
        q = queries[i : i + 512]
        top = np.abs(q).max(1, keepdims=True)
        unit = np.where(top > LARGE, q / top, q).astype(np.float32)
        found = search(lifted, graph, entry, np.concatenate([unit, np.zeros((len(q), 1), np.float32)], 1), max(BEAM, 2 * k))[0]
        row, col = np.nonzero(found >= 0)
        node = found[row, col]
        score = np.einsum("nd,nd->n", exact[node], q[row].astype(np.float64))
        n = start[node + 1] - start[node]
        member = np.repeat(start[node] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        p = pd.DataFrame({"query_id": query_ids[i : i + 512][np.repeat(row, n)], "vec_id": ids[member], "score": np.repeat(score, n)})
        own = np.repeat((exact[node] == q[row]).all(1), n)
        p = p[~(own & (p.query_id == p.vec_id).to_numpy())].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        parts.append(p.groupby("query_id", sort=False).head(k))
    return pd.concat(parts)


def nearest(embeddings: DataFrame, k: int = 20, every: int = 20, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found of each row whose vec_id is
    divisible by ``every``, by inner product; ties go to the smaller vec_id.

    Rows with a null vec_id, and vectors that are null, zero, or hold null or non-finite
    components take no part. Repeated rows count once; of different vectors under one
    vec_id each is searched, and each may be found, by the others too. Vectors meet only those of as many
    components. Fewer candidates than ``k`` are all returned; an empty table gives none."""
    spark = embeddings.sparkSession
    e = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    e = e.where("vec_id is not null and size(embedding) > 0").where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0))
    e = e.withColumn("dim", F.size("embedding"))
    stats = e.groupBy().agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q")).first()
    shards, blocks = max(1, -(-stats["n"] // shard_rows)), max(1, -(-stats["q"] // BLOCK_ROWS))
    dealt = e.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))

    def index(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_b=[np.asarray(v, np.float32).tobytes() for v in pdf["embedding"]]).drop_duplicates(["vec_id", "_b"])
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "blob": [_index(pdf, k)]})

    built = materialise(dealt.groupBy("dim", "shard").applyInPandas(index, "dim int, shard int, blob binary"), "index")
    queries = e.where(F.col("vec_id") % every == 0).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))
    left = built.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def answer(idx: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        if not len(idx) or not len(qs):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        qs = qs.assign(_b=[np.asarray(v, np.float32).tobytes() for v in qs["embedding"]]).drop_duplicates(["vec_id", "_b"])
        return _answer(idx["blob"].iloc[0], qs["vec_id"].to_numpy(np.int64), np.stack(qs["embedding"].to_numpy()).astype(np.float32), k)

    keys = ["dim", "shard", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(answer, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
