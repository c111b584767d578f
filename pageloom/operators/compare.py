"""Before/after comparison of check reports, and lookup of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import collapse

#: Order of severities and of statuses.
SEVERITY = ["問題あり", "問題の可能性大", "要判断箇所", "手動確認"]
STATUS = ["new", "unresolved", "resolved"]
STYLE_REFERENCE = r"\.css\b|セレクタ\s*="
KEY = ["type", "jis", "method"]


def rank(c: Column, values: list[str]) -> Column:
    at = F.array_position(F.array(*map(F.lit, values)), c)
    return F.when(at == 0, 9).otherwise(at)


def signatures(report: DataFrame, order: str = "row_no") -> DataFrame:
    """One row per signature (the message is no part of it): count, first message, lines."""
    kept = [F.coalesce(c, F.lit("undefined")).alias(c) for c in KEY]
    return report.groupBy(*kept).agg(
        F.count(F.lit(1)).alias("count"), F.min(order).alias("first"), F.min_by("message", order).alias("message"),
        F.array_sort(F.collect_list(F.when(F.coalesce("line", F.lit("")) != "", F.struct(order, "line")))).getField("line").alias("lines"))


def diff_reports(before: DataFrame, after: DataFrame, order: str = "row_no") -> DataFrame:
    """Full outer join on the signature; falling counts stay unresolved."""
    b, a = signatures(before, order), signatures(after, order)
    b = b.select(*KEY, F.col("count").alias("before_count"), F.col("message").alias("bm"))
    a = a.select(*KEY, F.col("count").alias("after_count"), F.col("message").alias("am"), "lines")
    out = b.join(a, KEY, "full_outer").fillna(0, ["before_count", "after_count"])
    message = F.when(F.col("after_count") > 0, F.col("am")).otherwise(F.col("bm"))
    status = F.when(F.col("after_count") == 0, "resolved").when(F.col("before_count") == 0, "new").otherwise("unresolved")
    style = F.coalesce(message.rlike(STYLE_REFERENCE), F.lit(False))
    return out.select(
        status.alias("status"), "before_count", "after_count", *KEY, message.alias("message"), F.coalesce("lines", F.array().cast("array<string>")).alias("after_lines"),
        F.when(style, "old-site-template").otherwise("unknown").alias("classification"), style.alias("classification_auto"))


def sorted_diff(diff: DataFrame) -> DataFrame:
    return diff.orderBy(rank(F.col("type"), SEVERITY), rank(F.col("status"), STATUS), *KEY)


def match_check_ids(messages: DataFrame, catalogue: DataFrame, key: str = "message_id") -> DataFrame:
    """(key, check_id): exact normalised text first; only messages without such a match are
    tried against the templates, whose {0} stands for any text. The catalogue has some
    hundred rows, so the template pass is a nested loop over a broadcast side."""
    m = messages.select(key, collapse(F.coalesce("message", F.lit(""))).alias("norm")).where("norm <> ''")
    items = catalogue.where("desc_ja_normalized <> ''").select(F.col("id").alias("check_id"), "is_static", F.col("desc_ja_normalized").alias("t"))
    exact = m.join(items.where("is_static"), m["norm"] == F.col("t")).select(key, "check_id")
    quoted = F.regexp_replace("t", r"([\\.*+?^$(){}|\[\]])", r"\\$1")
    pattern = F.concat(F.lit("^(?s:"), F.regexp_replace(quoted, r"\\\{0\\\}", ".*?"), F.lit(")$"))
    rest = m.join(exact.select(key).distinct(), key, "left_anti")
    some = rest.join(items.where("not is_static").withColumn("p", pattern), F.expr("norm rlike p")).select(key, "check_id")
    return exact.unionByName(some)


def rules_of_checks(matches: DataFrame, rules: DataFrame, key: str = "message_id") -> DataFrame:
    """(key, rule_id, via): rules that name a check, and manual rules that include those."""
    edge = rules.select(F.col("id").alias("rule_id"), F.explode("michecker_check_ids").alias("check_id"))
    direct = matches.join(edge, "check_id").select(key, "rule_id").distinct()
    inc = rules.select(F.col("id").alias("by"), F.explode("includes").alias("path")).select("by", F.regexp_extract("path", r"([^/]+?)(?:\.md)?$", 1).alias("rule_id"))
    via = direct.join(inc, "rule_id").select(key, F.col("by").alias("rule_id")).distinct()
    return direct.withColumn("via", F.lit("check")).unionByName(via.withColumn("via", F.lit("includes")))


def status_totals(diff: DataFrame) -> DataFrame:
    return diff.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
