"""Main-content candidates of a page and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTAINERS = ["body", "main", "article", "section", "div", "td"]
SKIPPED = ["script", "style", "noscript", "template", "header", "footer", "nav", "aside", "form"]
FILE = r"(?i)\.(pdf|docx?|xlsx?|pptx?|zip|csv)([?#]|$)"
FILE_WORDS = "入札|契約|公告|結果|資料|申請書|様式|ダウンロード|PDF|令和|年度"


def score() -> Column:
    """Capped linear score of a candidate row."""
    cap = lambda c, top: F.least(c, F.lit(top))
    files = (F.col("file_links") >= 3) & F.col("text").rlike(FILE_WORDS)
    s = cap(F.floor(F.col("text_length") / 35), 45) + cap(F.col("headings") * 4, 18) + cap(F.col("paragraphs") * 2, 12) + cap(F.col("tables") * 5, 10) + cap(F.col("table_rows"), 16) + cap(F.col("images") * 2, 8)
    s = s + F.least(F.when(files, 28).otherwise(7), F.col("file_links") * 4)
    s = s + F.when((F.col("paragraphs") >= 4) & (F.col("tables") >= 1), 12).otherwise(0) + F.when((F.col("file_links") >= 3) & (F.col("tables") >= 1), 10).otherwise(0)
    dense = F.when(F.col("link_density") > 3, -20).otherwise(0) + F.when(F.col("link_density") > 5, -25).otherwise(0)
    s = s + F.when(files, 14 + F.when(F.col("link_density") > 6, -8).otherwise(0)).otherwise(dense)
    return F.greatest(s, F.lit(0))


def content_candidates(nodes: DataFrame, keep: int = 5, before_dedupe: int = 8) -> DataFrame:
    """Best ``keep`` candidates per page: the best ``before_dedupe`` by score, one per text,
    the smallest first. Containment is a range join on (pre, post) within a page."""
    e = nodes.where("node_type = 1")
    skip = e.where(F.col("tag").isin(SKIPPED)).select("page_id", F.col("pre").alias("sp"), F.col("post").alias("so"))
    c = e.where(F.col("tag").isin(CONTAINERS) & (F.length("text") >= 30)).select("page_id", F.col("pre").alias("cp"), F.col("post").alias("co"), "tag", "path", "text")
    c = c.join(skip, (c["page_id"] == skip["page_id"]) & (F.col("sp") < F.col("cp")) & (F.col("so") > F.col("co")), "left_anti")
    d = e.where("tag rlike '^h[1-6]$' or tag in ('p', 'table', 'tr', 'img', 'a')").select(F.col("page_id").alias("pid"), "pre", "post", F.col("tag").alias("t"), F.col("attrs")["href"].alias("href"))
    d = d.join(skip, (d["pid"] == skip["page_id"]) & (F.col("sp") < F.col("pre")) & (F.col("so") > F.col("post")), "left_anti")
    j = c.join(d, (c["page_id"] == F.col("pid")) & (F.col("cp") < F.col("pre")) & (F.col("co") > F.col("post")), "left")
    n = lambda cond: F.count(F.when(cond, 1))
    f = j.groupBy("page_id", "cp", "tag", "path", "text").agg(
        n(F.col("t").rlike("^h[2-6]$")).alias("headings"), n(F.col("t") == "p").alias("paragraphs"), n(F.col("t") == "table").alias("tables"), n(F.col("t") == "tr").alias("table_rows"), n(F.col("t") == "img").alias("images"),
        n(F.col("t") == "a").alias("links"), n(F.col("href").rlike(FILE)).alias("file_links"))
    f = f.withColumn("text_length", F.length("text")).withColumn("link_density", F.col("links") / F.greatest(F.lit(1.0), F.col("text_length") / 80))
    f = f.withColumn("score", score())
    top = f.withColumn("r", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "text_length", "cp"))).where(F.col("r") <= before_dedupe)
    one = top.withColumn("d", F.row_number().over(Window.partitionBy("page_id", F.xxhash64("text"), "images").orderBy("text_length", F.desc("cp")))).where("d = 1")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "text_length", "cp"))).where(F.col("rank") <= keep).select("page_id", "rank", "score", F.col("cp").alias("pre"), "tag", "path", "text_length", "link_density", "headings", "paragraphs", "tables", "table_rows", "images", "links", "file_links")
