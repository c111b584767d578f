"""Structural page metrics, and comparison with a gold page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import count_matches, dice, token_set, visible_text

#: Metric names and what each counts in lower-cased html.
COUNTS = {
    "h2": r"<h2\b", "h3": r"<h3\b", "h4": r"<h4\b", "table": r"<table\b", "thead": r"<thead\b", "caption": r"<caption\b", "th": r"<th\b", "scopeCol": "scope=[\"']col[\"']", "scopeRow": "scope=[\"']row[\"']",
    "img": r"<img\b", "emptyAlt": "<img\\b(?=[^>]*alt=[\"'][\"'])", "iframe": r"<iframe\b",
}
WEAK_LINK = "クリックしてください|こちら|詳細はこちら|詳しくはこちら"
KEYS = [*COUNTS, "weakLink"]


def page_metrics(df: DataFrame, html: str = "html") -> DataFrame:
    """``df`` with one column per metric and textLength; scan-local."""
    text = visible_text(F.col(html))
    lower = F.lower(F.coalesce(html, F.lit("")))
    return df.withColumns({k: count_matches(lower, p) for k, p in COUNTS.items()} | {"weakLink": text.rlike(WEAK_LINK).cast("int"), "textLength": F.length(text)})


SIDES = ("old_html", "current_html", "gold_html")


def _measured(df: DataFrame, key: str) -> DataFrame:
    """``key`` and per side m, the metrics in order of KEYS, and t, the token set. Functions of
    an array's elements keep each side's lower-cased html and text from being made twice."""
    seen = F.transform(F.array(*SIDES), lambda h: F.struct(F.lower(F.coalesce(h, F.lit(""))).alias("low"), visible_text(h).alias("text")))
    counts = lambda x: [count_matches(x["low"], p) for p in COUNTS.values()] + [x["text"].rlike(WEAK_LINK).cast("int")]
    sides = F.transform(seen, lambda x: F.struct(F.array(*counts(x)).alias("m"), token_set(x["text"]).alias("t")))
    return df.select(key, sides.alias("s")).select(key, *(F.col("s")[i].alias(n) for i, n in enumerate("ocg")))


def _statuses() -> Column:
    """(metric, baseline, current, gold, status) of each metric."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(len(KEYS) - 1)), lambda i: F.struct(F.get(F.array(*map(F.lit, KEYS)), i).alias("metric"), *(F.get(F.col(f"{n}.m"), i).alias(c) for n, c in zip("ocg", ("baseline", "current", "gold")))))
    before, now = (lambda x, c: F.abs(x[c] - x["gold"])), (lambda x: F.abs(x["current"] - x["gold"]))
    status = lambda x: F.when(now(x) == 0, "matches_gold").when(now(x) < before(x, "baseline"), "improved").when(now(x) > before(x, "baseline"), "regressed").otherwise("unchanged")
    return F.transform(rows, lambda x: x.withField("status", status(x)))


def compare_html(df: DataFrame, key: str = "id") -> DataFrame:
    """Long rows (key, metric, baseline, current, gold, status) of old_html, current_html and
    gold_html; each side is read once."""
    return _measured(df, key).select(key, F.explode(_statuses()).alias("m")).select(key, "m.*")


def _round4(c):
    return F.floor(c * 10000 + 0.5) / 10000


def grade(df: DataFrame, key: str = "id") -> DataFrame:
    """Per case: similarities, metric balance and score (60 % text, 40 % structure), in one
    pass without a shuffle."""
    m = _measured(df, key).select(key, dice(F.col("o.t"), F.col("g.t")).alias("bs"), dice(F.col("c.t"), F.col("g.t")).alias("cs"), _statuses().alias("st"))
    of = lambda s: F.size(F.filter("st", lambda x: x["status"] == s)).cast("long").alias(s)
    m = m.select(key, "bs", "cs", *map(of, ("matches_gold", "improved", "regressed")))
    return m.select(
        key, _round4(F.col("bs")).alias("baseline_similarity"), _round4(F.col("cs")).alias("current_similarity"), _round4(F.col("cs") - F.col("bs")).alias("similarity_delta"), "matches_gold", "improved", "regressed",
        (F.lit(len(KEYS)) - F.col("matches_gold")).alias("differs_from_gold"), _round4((F.col("cs") * 0.6 + F.col("matches_gold") / len(KEYS) * 0.4) * 100).alias("score"))


def summarise(graded: DataFrame) -> DataFrame:
    """Averages of the rounded per-case values."""
    mean = lambda c: _round4(F.coalesce(F.avg(c), F.lit(0.0)))
    return graded.agg(F.count(F.lit(1)).alias("cases"), mean("score").alias("average_score"), mean("baseline_similarity").alias("average_baseline_similarity"), mean("current_similarity").alias("average_current_similarity"), F.sum("improved").alias("improved_metrics"), F.sum("regressed").alias("regressed_metrics"), F.sum("differs_from_gold").alias("differs_from_gold"))


def worst_cases(graded: DataFrame, n: int = 10, key: str = "id") -> DataFrame:
    return graded.orderBy(F.desc("differs_from_gold"), "score", key).limit(n)
