"""URL filter by a path-template tree, DataFrame functions only.

Explicit rules decide first. The urls they decide are the labels of the rest:
per host, paths are cut into segments, and a segment becomes a wildcard if it
looks like an id or if its place under one prefix takes many values. The nodes of
that tree (prefixes of templates) hold counts of allowed and blocked urls. A branch
whose share of blocked urls does not differ from its siblings' by ``z`` standard
errors is merged with those siblings. Purity is smoothed down the tree, each node
towards its parent with ``strength`` pseudo-urls, the hosts towards the whole
table; templates whose smoothed share of blocked urls is ``threshold`` or more are
rejected.

Urls are first counted by host and template with partial aggregation; all tree
work is on those counts. Looking the verdicts up is one join on (host, template),
which broadcasts below the session's threshold and splits hot keys above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: (verdict, host, path)
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Segments up to this depth may become wildcards for taking many values; deeper ones
#: only for their looks.
DEPTH = 4


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty where the url is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def _rule(rules) -> tuple[Column, Column]:
    """The longest fitting rule's name and verdict; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _lexical(s: Column) -> Column:
    s = F.when(s.rlike(r"^[0-9]+$"), F.lit("{n}")).when(s.rlike(r"^[0-9]+\."), F.concat(F.lit("{n}"), F.regexp_extract(s, r"^[0-9]+(.*)$", 1))).otherwise(s)
    return F.when(s.rlike(r"^[0-9a-fA-F-]{16,}$"), F.lit("{h}")).otherwise(s)


def _segments(path: Column) -> Column:
    """All segments, those that look like ids generalised."""
    return F.transform(F.split(F.regexp_replace(path, "^/", ""), "/", -1), _lexical)


def template_verdicts(judged: DataFrame, spread: int = 20, per_value: float = 5.0, z: float = 1.96, strength: float = 5.0, threshold: float = 0.5) -> DataFrame:
    """(host, segs, purity, verdict) of each template in ``judged`` (host, segs, rule_verdict)."""
    t = judged.groupBy("host", "segs").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("rule_verdict") == "allow", 1)).alias("a"), F.count(F.when(F.col("rule_verdict") == "block", 1)).alias("b"))
    t = t.withColumn("tpl", F.col("segs"))
    for d in range(1, DEPTH + 1):
        t = t.withColumn("prefix", F.slice("tpl", 1, d - 1)).withColumn("seg", F.get("tpl", F.lit(d - 1)))
        wide = t.where("seg is not null").groupBy("host", "prefix").agg(F.countDistinct("seg").alias("values"), F.sum("n").alias("urls"))
        wide = wide.where((F.col("values") >= spread) & (F.col("urls") < per_value * F.col("values"))).select("host", "prefix", F.lit(True).alias("wide"))
        t = t.join(wide, ["host", "prefix"], "left")
        tail = F.slice("tpl", F.lit(d + 1), F.size("tpl"))
        t = t.withColumn("tpl", F.when(F.col("wide") & F.col("seg").isNotNull(), F.concat("prefix", F.array(F.lit("*")), tail)).otherwise(F.col("tpl"))).select("host", "segs", "n", "a", "b", "tpl")
    steps = t.select("host", "segs", "a", "b", F.explode(F.sequence(F.lit(0), F.size("tpl"))).alias("d"), "tpl").withColumn("node", F.slice("tpl", 1, F.col("d"))).drop("tpl")
    nodes = steps.groupBy("host", "d", "node").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).withColumn("parent", F.when(F.col("d") > 0, F.slice("node", 1, F.col("d") - 1)))
    kin = Window.partitionBy("host", "d", "parent")
    n1, n = F.col("a") + F.col("b"), F.col("sa") + F.col("sb")
    n2 = n - n1
    p = F.col("sb") / n
    gap = F.col("b") / n1 - (F.col("sb") - F.col("b")) / n2
    alike = F.when((n1 == 0) | (n2 == 0), F.lit(True)).otherwise(gap * gap <= z * z * p * (1 - p) * (1.0 / n1 + 1.0 / n2))
    nodes = nodes.withColumn("sa", F.sum("a").over(kin)).withColumn("sb", F.sum("b").over(kin)).withColumn("alike", (F.col("d") > 0) & alike)
    for c in "ab":
        pool = F.sum(F.when(F.col("alike"), F.col(c))).over(kin)
        nodes = nodes.withColumn("m" + c, F.when(F.col("alike"), pool).otherwise(F.col(c)))
    chain = steps.select("host", "segs", "d", "node").join(nodes.select("host", "d", "node", "ma", "mb"), ["host", "d", "node"])
    chain = chain.groupBy("host", "segs").agg(F.array_sort(F.collect_list(F.struct("d", "ma", "mb"))).alias("chain"))
    whole = judged.agg((F.count(F.when(F.col("rule_verdict") == "block", 1)) / F.greatest(F.count("rule_verdict"), F.lit(1))).alias("prior"))
    fold = F.aggregate("chain", F.col("prior"), lambda acc, x: (x["mb"] + strength * acc) / (x["ma"] + x["mb"] + strength))
    out = chain.join(F.broadcast(whole)).select("host", "segs", fold.alias("purity"))
    return out.withColumn("verdict", F.when(F.col("purity") >= threshold, F.lit("block")).otherwise(F.lit("allow")))


def filter_urls(pages: DataFrame, rules=RULES, **options) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, purity (null under a rule).

    Null urls and urls without ``://`` have empty host and path and form a template of
    their own. Repeated rows are judged alike, each in its own row. Without labelled
    urls every template is allowed. Other columns are ignored."""
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = _rule(rules)
    judged = parts.select("*", name.alias("rule"), verdict.alias("rule_verdict"), _segments(F.col("path")).alias("segs"))
    by = template_verdicts(judged, **options)
    out = judged.join(by, ["host", "segs"], "left")
    return out.select(
        "page_id", "host", "path", "rule", F.coalesce("rule_verdict", "verdict").alias("verdict"), F.when(F.col("rule").isNull(), F.col("purity")).alias("purity"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).drop("purity")


def _sql() -> str:
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    longest = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    name = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in longest) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in longest) + " END"
    lex = r"CASE WHEN regexp_matches(s, '^[0-9]+$') THEN '{n}' WHEN regexp_matches(s, '^[0-9]+\.') THEN '{n}' || regexp_extract(s, '^[0-9]+(.*)$', 1) WHEN regexp_matches(s, '^[0-9a-fA-F-]{16,}$') THEN '{h}' ELSE s END"
    levels = ""
    for d in range(1, DEPTH + 1):
        levels += f"""
w{d} AS (SELECT host, tpl[1:{d - 1}] AS prefix FROM t{d - 1} WHERE len(tpl) >= {d} GROUP BY ALL HAVING count(DISTINCT tpl[{d}]) >= 20 AND sum(n) < 5.0 * count(DISTINCT tpl[{d}])),
t{d} AS (SELECT t.host, segs, n, a, b, CASE WHEN w.host IS NOT NULL AND len(tpl) >= {d} THEN list_concat(tpl[1:{d - 1}], ['*'], tpl[{d + 1}:]) ELSE tpl END AS tpl FROM t{d - 1} t LEFT JOIN w{d} w ON t.host = w.host AND t.tpl[1:{d - 1}] = w.prefix),"""
    return rf"""
WITH RECURSIVE u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
j AS (SELECT page_id, host, path, {name} AS rule, {verdict} AS rv, string_split(regexp_replace(path, '^/', ''), '/') AS raw FROM p),
s AS (SELECT page_id, host, path, rule, rv, list_transform(raw, lambda s: {lex}) AS segs FROM j),
t0 AS (SELECT host, segs, count(*) AS n, count(*) FILTER (rv = 'allow') AS a, count(*) FILTER (rv = 'block') AS b, segs AS tpl FROM s GROUP BY host, segs),{levels}
st AS (SELECT host, segs, a, b, d, tpl[1:d] AS node FROM (SELECT *, unnest(range(0, len(tpl) + 1)) AS d FROM t{DEPTH})),
nd AS (SELECT host, d, node, CASE WHEN d > 0 THEN node[1:d - 1] END AS parent, sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b FROM st GROUP BY host, d, node),
sb AS (SELECT *, sum(a) OVER (PARTITION BY host, d, parent) AS sa, sum(b) OVER (PARTITION BY host, d, parent) AS sbl FROM nd),
al AS (SELECT *, d > 0 AND CASE WHEN a + b = 0 OR sa + sbl - a - b = 0 THEN true ELSE
  pow(b / (a + b) - (sbl - b) / (sa + sbl - a - b), 2) <= 1.96::DOUBLE * 1.96::DOUBLE * (sbl / (sa + sbl)) * (1 - sbl / (sa + sbl)) * (1.0::DOUBLE / (a + b) + 1.0::DOUBLE / (sa + sbl - a - b)) END AS alike FROM sb),
mg AS (SELECT host, d, node, CASE WHEN alike THEN sum(a) FILTER (alike) OVER k ELSE a END AS ma, CASE WHEN alike THEN sum(b) FILTER (alike) OVER k ELSE b END AS mb FROM al WINDOW k AS (PARTITION BY host, d, parent)),
fd AS (SELECT host, segs, len(tpl) AS depth, -1 AS d, (SELECT count(*) FILTER (rv = 'block')::DOUBLE / greatest(count(rv), 1) FROM s) AS purity, tpl FROM t{DEPTH}
  UNION ALL SELECT f.host, f.segs, f.depth, f.d + 1, (m.mb + 5.0::DOUBLE * f.purity) / (m.ma + m.mb + 5.0::DOUBLE), f.tpl FROM fd f JOIN mg m ON f.host = m.host AND m.d = f.d + 1 AND m.node = f.tpl[1:f.d + 1]),
vd AS (SELECT host, segs, CASE WHEN purity >= 0.5 THEN 'block' ELSE 'allow' END AS v FROM fd WHERE d = depth)
SELECT page_id, s.host, path, rule, coalesce(rv, v) AS verdict FROM s LEFT JOIN vd ON s.host = vd.host AND s.segs = vd.segs
"""


SQL = _sql()
