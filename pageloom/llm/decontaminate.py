"""Benchmark decontamination by a prefix-filtered join, DataFrame functions only.

An item is cut into windows of ``window`` consecutive words; a document is hit
where a window occurs word for word. Containment of a window is required whole,
so its necessary prefix in the order of rarity is one token: the word of the
window that is rarest over all documents. Only document words equal to such a
prefix token become candidates; the token's place in the window bounds where the
window may start (positional filter) and the document's length bounds where it
may end (length filter). Each surviving candidate is compared with the item over
a slice as long as the window.

Document words never enter a shuffle (outer explodes, since Catalyst would repeat
the tokenisation in an inferred size filter): they are exploded, joined with the
broadcast prefix tokens and verified inside one generated stage. The broadcast
side is cut into blocks of at most ``block_windows`` windows (about 200 bytes
each); a larger benchmark takes more passes and no more memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialise, table, text_key

#: What stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(text):
    """Words of a text in A-Z lower case. Splitting takes an eighth of the time of extracting
    the matches."""
    words = F.array_remove(F.split(ascii_lower(text), BETWEEN), "")
    return F.coalesce(words, F.array().cast("array<string>"))


def _key(word):
    return F.xxhash64(word)


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(wkey, len, item_id): each distinct window of each item.

    An item shorter than ``window`` is one window; one without words has none."""
    w = benchmark.select("item_id", _words(F.col("text")).alias("w"))
    cut = F.when(F.size("w") >= window, F.transform(F.sequence(F.lit(0), F.size("w") - window), lambda i: F.slice("w", i + 1, window))).otherwise(F.array("w"))
    cut = w.where(F.size("w") > 0).select("item_id", F.explode(cut).alias("win"))
    return cut.select(F.array_join("win", " ").alias("wkey"), F.size("win").alias("len"), "item_id").distinct()


def _blocks(df: DataFrame, column: str, n: int) -> list[DataFrame]:
    return [df] if n == 1 else [df.where(F.pmod(F.xxhash64(column), F.lit(n)) == i) for i in range(n)]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def find_windows(documents: DataFrame, benchmark: DataFrame, window: int = 13, block_windows: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """Occurrences (doc_id, tkey, start, len, wkey) of item windows in documents, and
    the windows (wkey, len, item_id). Every occurrence of every window is found."""
    items = materialise(item_windows(benchmark, window), "windows")
    wins = items.select("wkey", "len").distinct()
    n_blocks = max(1, -(-wins.count() // block_windows))
    tokens = wins.select("wkey", "len", F.posexplode(F.split("wkey", " ")).alias("apos", "word")).withColumn("akey", _key(F.col("word")))
    text = documents.select("doc_id", "text")

    # Rarity of the windows' words over all documents.
    vocab = tokens.select("akey").distinct()
    spread = text.select(F.explode_outer(_words(F.col("text"))).alias("w")).select(_key(F.col("w")).alias("akey"))
    counted = _union([spread.join(F.broadcast(v), "akey") for v in _blocks(vocab, "akey", n_blocks)]).groupBy("akey").agg(F.count(F.lit(1)).alias("freq"))
    # A word that no document holds rules its windows out.
    ranked = tokens.join(counted, "akey", "left").groupBy("wkey", "len").agg(F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "akey", "apos")).alias("m"))
    anchors = materialise(ranked.where("m.freq > 0").select("wkey", "len", "m.akey", "m.apos"), "anchors")

    found = []
    for block in _blocks(anchors, "wkey", n_blocks):
        ws = text.select("doc_id", text_key(F.col("text")).alias("tkey"), _words(F.col("text")).alias("ws"))
        at = ws.select("doc_id", "tkey", "ws", F.posexplode_outer("ws").alias("pos", "w")).withColumn("k", _key(F.col("w")))
        start = F.col("pos") - F.col("apos")
        same = F.array_join(F.slice("ws", start + 1, F.col("len")), " ") == F.col("wkey")
        bounds = (start >= 0) & (start + F.col("len") <= F.size("ws"))
        # when() keeps slice() from a start before the first word.
        cond = (F.col("k") == F.col("akey")) & F.when(bounds, same).otherwise(False)
        found.append(at.join(F.broadcast(block), cond).select("doc_id", "tkey", start.alias("start"), "len", "wkey"))
    return _union(found), items


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """One row per row of ``documents``: doc_id, tkey (key of its text), n_words, n_hit,
    n_items, items_sha256, contaminated (n_hit > 0 and share * n_hit >= n_words).

    Null texts have no words. Rows with a null doc_id, and repeated rows, each get
    their own result. Windows of items with a null item_id hit words, but there is no id
    to count or list. Empty tables give no hits. Other columns are ignored."""
    found, items = find_windows(documents, benchmark, window)
    found, items = materialise(found, "hits"), items.where("item_id is not null")
    key = ["doc_id", "tkey"]
    spans = found.groupBy(*key, "start").agg(F.max(F.col("start") + F.col("len")).alias("stop"))
    before = F.max("stop").over(Window.partitionBy(*key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.col("stop") - F.greatest("start", F.coalesce(before, F.lit(0))), F.lit(0))
    hits = spans.withColumn("new", new).groupBy(*key).agg(F.sum("new").cast("long").alias("n_hit"))
    ids = found.select(*key, "wkey").distinct().join(items.select("wkey", F.col("item_id").cast("string").alias("item")), "wkey")
    ids = ids.groupBy(*key).agg(F.array_sort(F.collect_set("item")).alias("ids"))
    stats = hits.withColumnRenamed("doc_id", "d").withColumnRenamed("tkey", "t")
    stats = stats.join(ids, stats["d"].eqNullSafe(ids["doc_id"]) & (stats["t"] == ids["tkey"]), "left").select("d", "t", "n_hit", "ids")
    base = documents.select("doc_id", text_key(F.col("text")).alias("tkey"), F.size(_words(F.col("text"))).cast("long").alias("n_words"))
    out = base.join(stats, base["doc_id"].eqNullSafe(stats["d"]) & (base["tkey"] == stats["t"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    listed = F.coalesce("ids", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "tkey", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tkey")


SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
ip AS (SELECT item_id, ws, least(len(ws), 13) AS l, unnest(range(0, greatest(len(ws) - 12, 1))) AS p FROM iw WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, l, array_to_string(ws[p + 1:p + l], ' ') AS k FROM ip),
lens AS (SELECT DISTINCT l FROM win),
dp AS (SELECT doc_id, ws, l, unnest(range(0, len(ws) - l + 1)) AS p FROM dw, lens WHERE len(ws) >= l),
hit AS (SELECT d.doc_id, d.p, d.l, w.item_id FROM (SELECT doc_id, p, l, array_to_string(ws[p + 1:p + l], ' ') AS k FROM dp) d JOIN win w ON d.k = w.k AND d.l = w.l),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM (SELECT DISTINCT doc_id, p, l FROM hit)) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
