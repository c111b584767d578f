"""Queries over ``pages``, ``documents`` and ``events``, and their SQL.

Regular markup is read with built-in expressions (one scan, partial aggregation, no
Python); the checks and the extraction run over the parsed node table.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions import metrics, text
from pageloom.operators import batch, candidates, checks, compare, decisions, extract, gold_hints, rewrite
from pageloom.sources import parse_html, parse_pages

from .check_cases import CASES, case_values
from .fixtures import DATES, HTML, TEXTS, date_values, html_values, text_values

ANCHOR = r'<a href="([^"]*)">([^<]*)</a>'


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than there are cores (small files) is dealt to all."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def _pages(spark, sf_dir):
    return _spread(read(spark, sf_dir, "pages").select("page_id", "html")).unionByName(spark.createDataFrame(HTML, "page_id long, html string").coalesce(1))


def _texts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(TEXTS, "doc_id long, text string"))


def link_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    hrefs, labels = (F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(i)) for i in (1, 2))
    return p.select("page_id", F.regexp_extract("url", "://([^/?#]+)", 1).alias("host"), F.posexplode(F.arrays_zip(hrefs.alias("href"), labels.alias("label"))).alias("pos", "a")).select("page_id", "host", F.col("pos").cast("long").alias("pos"), "a.href", "a.label")


def link_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = link_inventory(spark, sf_dir)
    per = a.groupBy("host", "page_id", "href").agg(F.count(F.lit(1)).alias("n"), F.count(F.when((F.length("label") > 0) & (F.length("label") < 20), 1)).alias("short"))
    return per.groupBy("host").agg(F.count_distinct("page_id").alias("pages"), F.sum("n").alias("links"), F.sum("short").alias("short_untitled"), F.count(F.when(F.col("n") > 1, 1)).alias("repeated_hrefs"))


def repeated_hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_inventory(spark, sf_dir).groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def page_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.page_metrics(_pages(spark, sf_dir)).drop("html")


def page_metrics_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages").withColumn("host", F.regexp_extract("url", "://([^/?#]+)", 1))
    m = metrics.page_metrics(p)
    return m.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.sum("textLength").alias("text_length"), F.sum("img").alias("img"), F.sum("weakLink").alias("weak_link"))


def visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", text.visible_text(F.col("html")).alias("visible"))


def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "(?i)<title>([^<]*)</title>", 1).alias("title"))


def _rule(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = _texts(spark, sf_dir)
        return t.select("doc_id", getattr(text, name)(F.col("text")).alias("fixed")).where(F.col("fixed") != t["text"])

    return query


def language_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", text.language_script(F.col("text")).alias("script")).groupBy("script").agg(F.count(F.lit(1)).alias("n"))


def doc_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dice similarity of each document to the benchmark item of its number."""
    d = read(spark, sf_dir, "documents").select("doc_id", text.token_set(F.col("text")).alias("a"))
    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), text.token_set(F.col("text")).alias("b"))
    return d.join(b, "doc_id").select("doc_id", F.size("a").cast("long").alias("n_a"), F.size("b").cast("long").alias("n_b"), text.dice(F.col("a"), F.col("b")).alias("dice"))


def report_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the place of check reports: the first half by id is the report before."""
    e = read(spark, sf_dir, "events")
    e = e.select(F.col("event_id").alias("row_no"), F.col("event_type").alias("type"), (F.col("user_id") % 50).cast("string").alias("jis"), F.hour("ts").cast("string").alias("method"), F.concat(F.lit("selector "), "event_type").alias("message"), F.col("event_id").cast("string").alias("line"))
    half = e.agg((F.max("row_no") / 2).alias("half"))
    e = e.join(F.broadcast(half))
    d = compare.diff_reports(e.where("row_no < half"), e.where("row_no >= half"))
    return d.select("status", "before_count", "after_count", "type", "jis", "method", "message", F.size("after_lines").cast("long").alias("n_lines"))


def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_diff(spark, sf_dir).groupBy("type").agg(*[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in compare.STATUS])


def topk_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("type").orderBy(F.desc("after_count"), F.desc("before_count"), "jis", "method")
    return report_diff(spark, sf_dir).withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("type", "rank", "jis", "method", "before_count", "after_count")


def _nodes(pages: DataFrame, texts_of: frozenset[str] | None = None) -> DataFrame:
    """Parsed once for all branches that read them; lost blocks are parsed again."""
    return parse_html(pages, texts_of).persist(StorageLevel.MEMORY_AND_DISK)


def _page_nodes(pages: DataFrame) -> DataFrame:
    """Dealt by page once, so that what the checks group or order by page needs no more
    shuffle."""
    n = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), pages._jdf.rdd().getNumPartitions())
    return parse_pages(pages).repartition(n, "page_id").persist(StorageLevel.MEMORY_AND_DISK)


def check_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.run_checks(_page_nodes(_pages(spark, sf_dir)))


def check_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = ["C_15.0", "C_57.0", "C_14.0", "C_34.0", "C_51.1"]
    return checks.check_summary(checks.run_checks(_page_nodes(_spread(read(spark, sf_dir, "pages"))), ids))


def check_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary over all checks."""
    return checks.check_summary(check_problems(spark, sf_dir))


def check_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each check gives on its small pages; the SQL lists what it must give."""
    cases = spark.createDataFrame([(i, c, h) for i, (c, h, _, _) in enumerate(CASES)], "page_id long, target string, html string")
    problems = checks.run_checks(_page_nodes(cases)).groupBy("page_id", F.col("check_id").alias("target")).agg(F.count(F.lit(1)).alias("problems"), F.sum(F.size("nodes")).alias("nodes"))
    out = cases.select("page_id", "target").join(problems, ["page_id", "target"], "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(F.col("page_id").alias("case_no"), F.col("target").alias("check_id"), count("problems"), count("nodes"))


def content_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.content_candidates(_nodes(_spread(read(spark, sf_dir, "pages"))))


#: Edits that stand for a repair and for a gold page.
_CURRENT = [("(?s)<nav>.*?</nav>", ""), ("<b>", "<h3>")]
_GOLD = [("(?s)<footer>.*?</footer>", ""), ("<h1>", "<h2>"), ("<b>", "<h3>"), ("<p>", "<p>こちら詳細")]


def _edited(edits):
    c = F.col("html")
    for p, r in edits:
        c = F.regexp_replace(c, p, r)
    return c


def gold_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's repaired self against a gold one that differs from it."""
    p = _pages(spark, sf_dir)
    return metrics.grade(p.select(F.col("page_id").alias("id"), F.col("html").alias("old_html"), _edited(_CURRENT).alias("current_html"), _edited(_GOLD).alias("gold_html")))


def gold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of those pages by status."""
    p = _pages(spark, sf_dir)
    m = metrics.compare_html(p.select(F.col("page_id").alias("id"), F.col("html").alias("old_html"), _edited(_CURRENT).alias("current_html"), _edited(_GOLD).alias("gold_html")))
    return m.groupBy("metric", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("gold").alias("gold"))


def text_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the calendar-valid dates of the texts, in order."""
    dates = spark.createDataFrame(DATES, "doc_id long, text string")
    t = read(spark, sf_dir, "documents").select("doc_id", "text").unionByName(dates)
    return t.select("doc_id", F.posexplode(F.transform(text.full_dates(F.col("text")), text.date_name)).alias("pos", "name")).select("doc_id", F.col("pos").cast("long").alias("pos"), "name")


def text_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", F.explode(text.spaced_characters(F.col("text"))).alias("run"))


def rewrite_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.rewrite(_pages(spark, sf_dir), ["scripts", "tidy"]).select("page_id", "final_html")


def rewrite_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.rewrite(_pages(spark, sf_dir)).select("page_id", "final_html")


def hint_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their rewritten selves as gold."""
    p = rewrite.rewrite(_pages(spark, sf_dir))
    return gold_hints.learn_hints(p.select(F.col("page_id").alias("file"), F.col("html").alias("old_html"), F.col("final_html").alias("gold_html")))


def queue_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as one source of the queue and their URLs without the last part as another."""
    p = read(spark, sf_dir, "pages").select("page_id", "url")
    return batch.build_queue(p, p.withColumn("url", F.regexp_replace("url", "/[^/]*$", "/")))


def batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue after reading: pages whose html has a paragraph are done; headings stand for accepted rows."""
    html = read(spark, sf_dir, "pages").select("page_id", F.when(F.col("html").contains("<p>"), "done").otherwise("extract-failed").alias("state"), F.regexp_count("html", F.lit("<h[1-6]>")).alias("auto_accepted"), F.regexp_count("html", F.lit("<a ")).alias("remaining"))
    return batch.batch_summary(queue_build(spark, sf_dir).drop("status").join(html.withColumnRenamed("state", "status"), "page_id"))


def queue_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.pages_by(read(spark, sf_dir, "pages").select("url"), F.regexp_extract("url", "://[^/]+/([^/]+)/", 1))


def _found(spark, sf_dir):
    nodes = _nodes(_pages(spark, sf_dir), candidates.TEXTS_OF)
    return nodes, candidates.find_candidates(nodes, read(spark, sf_dir, "pages"))


def candidate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir)[1]


def candidate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.rule_summary(decisions.auto_accept(_found(spark, sf_dir)[1]))


def candidate_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.completion(decisions.auto_accept(_found(spark, sf_dir)[1]))


def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.evidence(decisions.auto_accept(_found(spark, sf_dir)[1]), read(spark, sf_dir, "pages"))


def final_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, found = _found(spark, sf_dir)
    return decisions.apply_patches(nodes, decisions.auto_accept(found))


def link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each page by the kind of their target."""
    p = read(spark, sf_dir, "pages")
    links = candidates.classify_links(parse_html(p.select("page_id", "html")), p)
    kinds = ["is_broken", "is_in_page", "is_external", "is_pdf"]
    return links.groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), *[F.count_if(k).alias(k) for k in kinds])


_A = rf"""a AS (SELECT page_id, regexp_extract(url, '://([^/?#]+)', 1) AS host, unnest(range(0, len(regexp_extract_all(html, '{ANCHOR}')))) AS pos, html FROM pages),
l AS (SELECT page_id, host, pos, regexp_extract_all(html, '{ANCHOR}', 1)[pos + 1] AS href, regexp_extract_all(html, '{ANCHOR}', 2)[pos + 1] AS label FROM a)"""
_P = f"p AS (SELECT page_id, html FROM pages UNION ALL SELECT * FROM (VALUES {html_values()}))"
_T = f"t AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {text_values()}))"


def _visible(c: str) -> str:
    c = f"regexp_replace(regexp_replace(regexp_replace({c}, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
    for p, r in text.ENTITIES:
        c = f"regexp_replace({c}, '{p.replace(chr(39), chr(39) * 2)}', '{r.replace(chr(39), chr(39) * 2)}', 'g')"
    return f"trim(regexp_replace({c}, '[\\s\\x0b\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{feff}}]+', ' ', 'g'))"


def _metric_list(c: str) -> str:
    """The metrics of a column in order of KEYS, as a list."""
    one = lambda k, p: f"len(list_filter(regexp_extract_all(lower({c}), '<img\\b[^>]*'), lambda x: regexp_matches(x, 'alt=[\"'']([\"''])')))" if k == "emptyAlt" else f"len(regexp_extract_all(lower({c}), '{p.replace(chr(39), chr(39) * 2)}'))"
    return "[" + ", ".join([*(one(k, p) for k, p in metrics.COUNTS.items()), f"CAST(regexp_matches({_visible(c)}, '{metrics.WEAK_LINK}') AS BIGINT)"]) + "]"


def _metric_sql() -> str:
    cols = []
    for k, p in metrics.COUNTS.items():
        if k == "emptyAlt":
            cols.append("CAST(len(list_filter(regexp_extract_all(lower(html), '<img\\b[^>]*'), lambda x: regexp_matches(x, 'alt=[\"'']([\"''])'))) AS INT) AS \"emptyAlt\"")
        else:
            cols.append(f"CAST(len(regexp_extract_all(lower(html), '{p.replace(chr(39), chr(39) * 2)}')) AS INT) AS \"{k}\"")
    v = _visible("html")
    return ", ".join([*cols, f"CAST(regexp_matches({v}, '{metrics.WEAK_LINK}') AS INT) AS \"weakLink\"", f"CAST(length({v}) AS INT) AS \"textLength\""])


_E = """e AS (SELECT event_id AS row_no, event_type AS type, CAST(user_id % 50 AS VARCHAR) AS jis, CAST(hour(ts) AS VARCHAR) AS method, 'selector ' || event_type AS message FROM events),
h AS (SELECT max(row_no) / 2.0 AS half FROM e),
b AS (SELECT type, jis, method, count(*) AS n, arg_min(message, row_no) AS m FROM e, h WHERE row_no < half GROUP BY ALL),
f AS (SELECT type, jis, method, count(*) AS n, arg_min(message, row_no) AS m FROM e, h WHERE row_no >= half GROUP BY ALL),
d AS (SELECT CASE WHEN f.n IS NULL THEN 'resolved' WHEN b.n IS NULL THEN 'new' ELSE 'unresolved' END AS status, coalesce(b.n, 0) AS before_count, coalesce(f.n, 0) AS after_count, coalesce(b.type, f.type) AS type,
 coalesce(b.jis, f.jis) AS jis, coalesce(b.method, f.method) AS method, coalesce(f.m, b.m) AS message, coalesce(f.n, 0) AS n_lines FROM b FULL JOIN f ON b.type = f.type AND b.jis = f.jis AND b.method = f.method)"""


def _fixed(expr: str) -> str:
    return f"WITH {_T}, f AS (SELECT doc_id, text, {expr} AS fixed FROM t) SELECT doc_id, fixed FROM f WHERE fixed <> text"


def _replace(c: str, *steps: tuple[str, str]) -> str:
    for p, r in steps:
        c = f"regexp_replace({c}, '{p}', '{r}', 'g')"
    return c


_S = r"\s*"
_TIME = _replace("text", (r"\b0?([0-9]|1[0-9]|2[0-3]):00\b", r"\1時"), (r"\b0?([0-9]|1[0-9]|2[0-3]):0([1-9])\b", r"\1時\2分"), (r"\b0?([0-9]|1[0-9]|2[0-3]):([1-5][0-9])\b", r"\1時\2分"))
_UNITS = "text"
for _u in sorted(text.UNITS, key=len, reverse=True):
    _UNITS = _replace(_UNITS, (rf"(?i)([0-9]+(?:\.[0-9]+)?)\s*{_u}($|[^A-Za-z])", rf"\1{text.UNITS[_u]}\2"))
_TOK = r"list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+|[\x{{3040}}-\x{{30ff}}\x{{3400}}-\x{{9fff}}]{{1,3}}'))"
_Q = """u AS (SELECT page_id, url FROM pages UNION ALL SELECT page_id, regexp_replace(url, '/[^/]*$', '/') FROM pages),
c AS (SELECT url FROM u WHERE url <> '' GROUP BY url HAVING count(*) > 1),
q AS (SELECT page_id, u.url, 'pending' AS status, c.url IS NOT NULL AS duplicate_url FROM u LEFT JOIN c ON u.url = c.url)"""
_WS = r"[\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"


def _sql_edited(edits) -> str:
    return _replace("html", *edits)


_KEYS = "[" + ", ".join(f"'{k}'" for k in metrics.KEYS) + "]"
_GRADED = f"""{_P}, v AS (SELECT page_id AS id, html AS o, {_sql_edited(_CURRENT)} AS c, {_sql_edited(_GOLD)} AS g FROM p),
m AS (SELECT id, {", ".join(f"{_metric_list(x)} AS m{x}, {_TOK.format(_visible(x))} AS t{x}" for x in "ocg")} FROM v),
k AS (SELECT id, unnest({_KEYS}) AS metric, unnest(mo) AS o, unnest(mc) AS c, unnest(mg) AS g FROM m),
st AS (SELECT *, CASE WHEN c = g THEN 'matches_gold' WHEN abs(c - g) < abs(o - g) THEN 'improved' WHEN abs(c - g) > abs(o - g) THEN 'regressed' ELSE 'unchanged' END AS status FROM k)"""
_DICE = "CASE WHEN len({0}) + len({1}) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({0}, {1})) / (len({0}) + len({1})) END"
_R4 = "floor(({}) * 10000::DOUBLE + 0.5::DOUBLE) / 10000::DOUBLE"

QUERIES = {
    "gold_metrics": gold_metrics, "text_date": text_date, "text_spaced": text_spaced,
    "link_audit": link_audit, "link_inventory": link_inventory, "repeated_hrefs": repeated_hrefs, "page_metrics": page_metrics, "page_metrics_by_host": page_metrics_by_host, "visible_text": visible_text, "page_title": page_title,
    "text_half_width": _rule("half_width"), "text_currency": _rule("currency"), "text_tel_fax": _rule("tel_fax"), "text_time": _rule("time_notation"), "text_units": _rule("units"), "text_weekday": _rule("weekday"),
    "check_totals": check_totals, "check_fixtures": check_fixtures, "language_scripts": language_scripts, "doc_similarity": doc_similarity, "report_diff": report_diff, "status_pivot": status_pivot, "topk_signatures": topk_signatures, "check_problems": check_problems, "check_counts": check_counts,
    "content_extract": content_extract, "gold_grade": gold_grade,
    "candidate_rows": candidate_rows, "candidate_rules": candidate_rules, "candidate_completion": candidate_completion, "evidence_rows": evidence_rows, "final_html": final_html, "link_targets": link_targets,
    "rewrite_strip": rewrite_strip, "rewrite_pages": rewrite_pages, "hint_mining": hint_mining, "queue_build": queue_build, "batch_totals": batch_totals, "queue_by_category": queue_by_category,
}

ORACLE_SQL = {
    "link_inventory": f"WITH {_A} SELECT page_id, host, pos, href, label FROM l",
    "link_audit": f"WITH {_A}, g AS (SELECT host, page_id, href, count(*) AS n, count(*) FILTER (length(label) BETWEEN 1 AND 19) AS s FROM l GROUP BY ALL) SELECT host, count(DISTINCT page_id) AS pages, CAST(sum(n) AS BIGINT) AS links, CAST(sum(s) AS BIGINT) AS short_untitled, count(*) FILTER (n > 1) AS repeated_hrefs FROM g GROUP BY host",
    "repeated_hrefs": f"WITH {_A} SELECT page_id, href, count(*) AS n FROM l GROUP BY ALL HAVING count(*) > 1",
    "page_metrics": f"WITH {_P} SELECT page_id, {_metric_sql()} FROM p",
    "page_metrics_by_host": f"WITH m AS (SELECT regexp_extract(url, '://([^/?#]+)', 1) AS host, {_metric_sql()} FROM pages) SELECT host, count(*) AS pages, CAST(sum(\"textLength\") AS BIGINT) AS text_length, CAST(sum(img) AS BIGINT) AS img, CAST(sum(\"weakLink\") AS BIGINT) AS weak_link FROM m GROUP BY host",
    "visible_text": f"WITH {_P} SELECT page_id, {_visible('html')} AS visible FROM p",
    "page_title": "SELECT page_id, regexp_extract(html, '(?i)<title>([^<]*)</title>', 1) AS title FROM pages",
    "text_half_width": _fixed(f"translate(text, '{text.FULL}', '{text.HALF}')"),
    "text_currency": _fixed(_replace("text", (rf"[¥￥]{_S}([0-9,]+)", r"\1円"), (rf"\${_S}([0-9,]+)", r"\1ドル"))),
    "text_tel_fax": _fixed(_replace("text", (rf"(?i)(?:TEL|ＴＥＬ){_S}[：:]", "電話番号："), (rf"(?i)(?:TEL|ＴＥＬ){_S}", "電話番号"), (rf"(?i)(?:FAX|ＦＡＸ){_S}[：:]", "ファックス番号："), (rf"(?i)(?:FAX|ＦＡＸ){_S}", "ファックス番号"))),
    "text_time": _fixed(_TIME),
    "text_units": _fixed(_UNITS),
    "text_weekday": _fixed(_replace("text", (rf"[（(]{_S}([日月火水木金土])曜?{_S}[)）]", r"（\1曜日）"))),
    "language_scripts": rf"WITH {_T} SELECT CASE WHEN regexp_matches(text, '\p{{Hangul}}{{2,}}') THEN 'ko' WHEN regexp_matches(text, '\p{{Thai}}{{2,}}') THEN 'th' WHEN regexp_matches(text, '\p{{Cyrillic}}{{3,}}') THEN 'ru' WHEN regexp_matches(text, '\p{{Han}}{{2,}}') AND regexp_matches(text, '{text.CHINESE}') THEN 'zh' WHEN regexp_matches(text, '[\x{{1EA0}}-\x{{1EF9}}]') THEN 'vi' WHEN regexp_matches(text, '[A-Za-z\x{{C0}}-\x{{17F}}\x{{1E00}}-\x{{1EFF}}]{{3,}}(?:[ ,.''\"-]+[A-Za-z\x{{C0}}-\x{{17F}}\x{{1E00}}-\x{{1EFF}}]{{2,}}){{2,}}') THEN 'latin' ELSE '' END AS script, count(*) AS n FROM t GROUP BY ALL",
    "doc_similarity": f"WITH s AS (SELECT doc_id, {_TOK.format('d.text')} AS a, {_TOK.format('b.text')} AS b FROM documents d JOIN benchmark b ON d.doc_id = b.item_id) SELECT doc_id, len(a) AS n_a, len(b) AS n_b, CASE WHEN len(a) + len(b) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) END AS dice FROM s",
    "rewrite_strip": f"WITH {_P} SELECT page_id, {_replace('html', ('(?is)<script.*?</script>', ''), ('(?is)<style.*?</style>', ''), (_WS, ' '), ('> +<', '><'), (' +>', '>'), ('^ | $', ''))} AS final_html FROM p",
    "queue_build": f"WITH {_Q} SELECT * FROM q",
    "batch_totals": f"WITH {_Q}, h AS (SELECT page_id, contains(html, '<p>') AS ok, len(regexp_extract_all(html, '<h[1-6]>')) AS a, len(regexp_extract_all(html, '<a ')) AS r FROM pages) SELECT count(*) AS pages, count(*) FILTER (ok) AS done, count(*) FILTER (NOT coalesce(ok, false)) AS failed, count(*) FILTER (duplicate_url) AS duplicates, CAST(coalesce(sum(a), 0) AS BIGINT) AS auto_accepted, CAST(coalesce(sum(r), 0) AS BIGINT) AS remaining FROM q JOIN h USING (page_id)",
    "queue_by_category": "WITH g AS (SELECT coalesce(nullif(regexp_extract(url, '://[^/]+/([^/]+)/', 1), ''), '(未分類)') AS \"group\" FROM pages) SELECT \"group\", count(*) AS pages, \"group\" = '(未分類)' AS unsorted FROM g GROUP BY ALL",
    "link_targets": "WITH l AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host, trim(unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1))) AS href FROM pages), k AS (SELECT *, regexp_matches(href, '^#[^#\\s]+') AS inside, regexp_matches(href, '(?i)^(https?:)?//') AS full_url FROM l) SELECT page_id, count(*) AS links, count(*) FILTER (href IN ('', '#')) AS is_broken, count(*) FILTER (inside) AS is_in_page, count(*) FILTER (full_url AND lower(regexp_extract(href, '//([^/?#:]*)', 1)) <> host) AS is_external, count(*) FILTER (regexp_matches(href, '(?i)\\.pdf($|[?#])')) AS is_pdf FROM k GROUP BY page_id",
    "report_diff": f"WITH {_E} SELECT * FROM d",
    "status_pivot": f"WITH {_E} SELECT type, count(*) FILTER (status = 'new') AS \"new\", count(*) FILTER (status = 'unresolved') AS unresolved, count(*) FILTER (status = 'resolved') AS resolved FROM d GROUP BY type",
    "topk_signatures": f"WITH {_E}, r AS (SELECT type, CAST(row_number() OVER (PARTITION BY type ORDER BY after_count DESC, before_count DESC, jis, method) AS INT) AS rank, jis, method, before_count, after_count FROM d) SELECT * FROM r WHERE rank <= 10",
    "gold_metrics": f"WITH {_GRADED} SELECT metric, status, count(*) AS n, CAST(sum(g) AS BIGINT) AS gold FROM st GROUP BY ALL",
    "gold_grade": f"WITH {_GRADED}, s AS (SELECT id, {_DICE.format('to_', 'tg')} AS bs, {_DICE.format('tc', 'tg')} AS cs FROM (SELECT id, \"to\" AS to_, tc, tg FROM m)), n AS (SELECT id, count(*) FILTER (status = 'matches_gold') AS matches_gold, count(*) FILTER (status = 'improved') AS improved, count(*) FILTER (status = 'regressed') AS regressed FROM st GROUP BY id) "
    f"SELECT id, {_R4.format('bs')} AS baseline_similarity, {_R4.format('cs')} AS current_similarity, {_R4.format('cs - bs')} AS similarity_delta, matches_gold, improved, regressed, {len(metrics.KEYS)} - matches_gold AS differs_from_gold, {_R4.format(f'(cs * 0.6::DOUBLE + matches_gold::DOUBLE / {len(metrics.KEYS)} * 0.4::DOUBLE) * 100')} AS score FROM s JOIN n USING (id)",
    "text_date": r"""WITH t AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES """ + date_values() + r""") AS v(doc_id, text)), m AS (SELECT doc_id, regexp_extract_all(text, '(^|[^0-9/.])([0-9]{4}[/.][0-9]{1,2}[/.][0-9]{1,2})($|[^0-9/.])', 2) AS d FROM t),
l AS (SELECT doc_id, list_filter(d, lambda x: try_cast(replace(x, '.', '/').split('/')[1] || '-' || lpad(replace(x, '.', '/').split('/')[2], 2, '0') || '-' || lpad(replace(x, '.', '/').split('/')[3], 2, '0') AS DATE) IS NOT NULL AND x >= '1000' AND x < '3') AS d FROM m),
u AS (SELECT doc_id, unnest(range(0, len(d))) AS pos, unnest(d) AS x FROM l) SELECT doc_id, CAST(pos AS BIGINT) AS pos, CAST(replace(x, '.', '/').split('/')[1] AS VARCHAR) || '年' || CAST(replace(x, '.', '/').split('/')[2] AS INT) || '月' || CAST(replace(x, '.', '/').split('/')[3] AS INT) || '日' AS name FROM u""",
    "check_fixtures": f"SELECT CAST(a AS BIGINT) AS case_no, b AS check_id, CAST(c AS BIGINT) AS problems, CAST(d AS BIGINT) AS nodes FROM (VALUES {case_values()}) AS v(a, b, c, d)",
    "check_counts": "SELECT 'C_15.0' AS check_id, 'user' AS type, count(*) AS problems, count(*) AS pages, CAST(sum(n) AS BIGINT) AS nodes FROM (SELECT len(regexp_extract_all(html, '<h[1-6]>')) AS n FROM pages) WHERE n > 0 HAVING count(*) > 0 UNION ALL SELECT 'C_57.0', 'info', count(*), count(*), CAST(sum(n) AS BIGINT) FROM (SELECT len(list_filter(regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1), lambda x: length(x) BETWEEN 1 AND 19)) AS n FROM pages) WHERE n > 0 HAVING count(*) > 0",
}
