"""Decisions on candidates, their patches, and reports.

Patches are rows joined to the node table on (page_id, pre); html is then written from
the nodes by one aggregation a page, in the order of its tags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.sources.html_nodes import VOID

# Patches, and attributes set by one, that a reviewer words.
WORDED, WORDED_NAMES = ["replace-text", "set-text"], ["alt", "title", "lang"]
#: Patches that ``apply_patches`` carries out.
APPLIED = ["set-attribute", "remove-attribute", "rename-element", "unwrap-element", "remove-element", "set-text", "replace-text", "remove-style-properties"]


#: Attributes whose words name ids, beside links into the page (fixed values).
ID_REFERENCES = ["aria-describedby", "aria-labelledby", "aria-controls", "aria-owns", "aria-activedescendant", "aria-details", "aria-errormessage", "aria-flowto", "for"]
# Columns of the evidence file of a batch, and of its summary (names fixed by the format).
EVIDENCE_FILE = {"page_key": "移行管理ID", "page_title": "ページ名", "url": "URL", "page_category": "カテゴリ", **{c: c for c in ("candidate_id", "rule_id", "category", "processing_class", "status", "confidence", "requires_human_review", "decision_reason", "actor")}}


def batch_evidence(decided: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows of a batch's evidence file: EVIDENCE_FILE's columns, those unknown empty. Pages
    have page_id, url and, if known, id, page_title and category."""
    own = lambda df, c: F.col(c).cast("string") if c in df.columns else F.lit("")
    p = pages.select("page_id", own(pages, "id").alias("page_key"), own(pages, "page_title").alias("page_title"), "url", own(pages, "category").alias("page_category"))
    d = decided.select("page_id", "candidate_id", "rule_id", own(decided, "category").alias("category"), own(decided, "processing_class").alias("processing_class"), F.col("decision").alias("status"), "confidence", F.when(F.col("human_review"), "1").otherwise("0").alias("requires_human_review"), own(decided, "decision_reason").alias("decision_reason"), own(decided, "actor").alias("actor"))
    return d.join(p, "page_id").select(*EVIDENCE_FILE)


def _references() -> Column:
    """Ids of its page that a node's attributes refer to."""
    words = [F.filter(F.split(F.coalesce(F.col("attrs")[a], F.lit("")), r"\s+"), lambda x: x != "") for a in ID_REFERENCES]
    href = F.col("attrs")["href"]
    link = F.when(href.startswith("#") & (F.length(href) > 1), F.array(F.substring(href, 2, 2**31 - 1))).otherwise(F.array().cast("array<string>"))
    return F.concat(link, *words)


def auto_accept(candidates: DataFrame) -> DataFrame:
    """Adds ``decision``: fixes are accepted unless a person must word an unsure one."""
    wait = F.col("human_review") & (F.col("confidence") == "low") & (F.col("patch_type").isin(WORDED) | ((F.col("patch_type") == "set-attribute") & F.col("patch_name").isin(WORDED_NAMES)))
    return candidates.withColumn("decision", F.when((F.col("review_type") == "fix") & ~wait, "accepted").otherwise("undecided"))


def completion(decided: DataFrame) -> DataFrame:
    """Fixes of each page, those undecided, and whether none is."""
    fixes = decided.where("review_type = 'fix'").groupBy("page_id")
    return fixes.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("decision") == "undecided").alias("unresolved")).withColumn("complete", F.col("unresolved") == 0)


def rule_summary(decided: DataFrame) -> DataFrame:
    """Totals by rule over all pages."""
    return decided.groupBy("rule_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("decision") == "accepted").alias("accepted"), F.count_if(F.col("decision") == "undecided").alias("unresolved"), F.count_distinct("page_id").alias("pages"))


def evidence(decided: DataFrame, pages: DataFrame, rule_table: DataFrame | None = None) -> DataFrame:
    """One flat row for each candidate with its page's url and, where given, its rule's title."""
    rows = decided.join(pages.select("page_id", "url"), "page_id", "left")
    if rule_table is not None:
        rows = rows.join(rule_table.select(F.col("id").alias("rule_id"), F.col("title").alias("rule_title")), "rule_id", "left")
    return rows


def in_scope(candidates: DataFrame, rule_table: DataFrame) -> DataFrame:
    """Candidates of rules that name at least one check."""
    named = rule_table.where(F.size("michecker_check_ids") > 0).select(F.col("id").alias("rule_id"))
    return candidates.join(named, "rule_id", "left_semi")


def _escaped(c: Column, quote: bool = False) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"),) if quote else ())):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _without_styles(style: Column, names: Column) -> Column:
    kept = F.filter(F.split(style, ";"), lambda d: ~F.array_contains(names, F.lower(F.trim(F.substring_index(d, ":", 1)))) & (F.trim(d) != ""))
    return F.trim(F.array_join(kept, ";"))


def apply_patches(nodes: DataFrame, decided: DataFrame) -> DataFrame:
    """(page_id, final_html) with accepted patches applied, without any class and without the
    ids to which nothing on the patched page refers.

    Of several patches on a node the attribute patches all hold, one each name; of the rest
    the first by candidate number. Text repairs of a node follow each other. What lies in a
    removed element, or one whose text is set, goes with it. Comments and the doctype are
    not nodes and are not written. Pages without a node have no row."""
    p = decided.where((F.col("decision") == "accepted") & F.col("patch_type").isin(APPLIED))
    # Nodes and patches are dealt by page once: what belongs to a node, and what to a page,
    # meets in windows, and candidates are worked out once.
    own = ["last", "depth", "node_type", "tag", "attrs", "text", "parent_tag"]
    patch = F.struct("candidate_id", "patch_type", "patch_name", "patch_value", "before")
    texts = F.when(F.col("node_type") == 3, F.col("text")).alias("text")  # those of elements are not written
    n = nodes.select("page_id", "pre", *[texts if c == "text" else c for c in own]).withColumn("patch", F.lit(None).cast(p.select(patch.alias("x")).schema["x"].dataType))
    n = n.unionByName(p.select("page_id", "pre", patch.alias("patch")), allowMissingColumns=True).repartition("page_id")
    node, page = Window.partitionBy("page_id", "pre"), Window.partitionBy("page_id")
    n = n.withColumn("patches", F.collect_list("patch").over(node)).where("node_type is not null")
    pick = lambda *k: F.when(F.size("patches") > 0, F.array_sort(F.filter("patches", lambda x: x["patch_type"].isin(*k))))
    n = n.select("page_id", "pre", *own, pick("set-attribute", "remove-attribute", "remove-style-properties").alias("attr_p"), pick("replace-text").alias("text_p"), F.try_element_at(pick("rename-element", "unwrap-element", "remove-element", "set-text"), F.lit(1)).alias("act"))
    n = n.withColumn("cut", F.collect_list(F.when(F.col("act.patch_type").isin("remove-element", "set-text"), F.struct("pre", "last"))).over(page))
    n = n.where("not exists(cut, c -> pre > c.pre and pre <= c.last) and coalesce(act.patch_type, '') <> 'remove-element'").drop("cut")
    named = lambda kinds: F.transform(F.filter(F.coalesce("attr_p", F.array()), lambda x: x["patch_type"].isin(*kinds)), lambda x: x["patch_name"])
    drop, style = named(["remove-attribute"]), F.split(F.array_join(named(["remove-style-properties"]), ","), ",")
    put = F.filter(F.coalesce("attr_p", F.array()), lambda x: x["patch_type"] == "set-attribute")
    old = F.map_entries(F.coalesce("attrs", F.create_map().cast("map<string,string>")))
    kept = F.filter(old, lambda e: ~F.array_contains(drop, e["key"]) & ~F.exists(put, lambda x: x["patch_name"] == e["key"]))
    styled = F.filter(F.transform(kept, lambda e: F.struct(e["key"].alias("key"), F.when(e["key"] == "style", _without_styles(e["value"], style)).otherwise(e["value"]).alias("value"))), lambda e: ~((e["key"] == "style") & (e["value"] == "") & (F.size("attr_p") > 0)))
    added = F.transform(put, lambda x: F.struct(x["patch_name"].alias("key"), x["patch_value"].alias("value")))
    first = F.filter(added, lambda x, i: (i == 0) | ~F.exists(F.slice(added, 1, i), lambda y: y["key"] == x["key"]))
    n = n.withColumn("attrs", F.map_from_entries(F.concat(styled, first)))
    n = n.withColumn("refs", F.when(F.col("node_type") == 1, _references())).withColumn("ids", F.collect_list(F.when(F.size("refs") > 0, F.col("refs"))).over(page))
    wanted = F.filter(F.map_entries("attrs"), lambda e: (e["key"] != "class") & ((e["key"] != "id") | F.exists("ids", lambda refs: F.array_contains(refs, e["value"]))))
    inside = F.array_join(F.transform(wanted, lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), _escaped(e["value"], True), F.lit('"'))), "")
    tag = F.when(F.col("act.patch_type") == "rename-element", F.coalesce("act.patch_value", "act.patch_name")).otherwise(F.col("tag"))
    bare = F.col("act.patch_type") == "unwrap-element"
    fixed = F.aggregate(F.coalesce("text_p", F.array()), F.col("text"), lambda t, x: F.replace(t, x["before"], x["patch_value"]))
    raw = F.coalesce(F.col("parent_tag").isin("script", "style"), F.lit(False))
    begin = F.when(F.col("node_type") == 3, F.when(raw, F.col("text")).otherwise(_escaped(fixed))).when(F.coalesce(bare, F.lit(False)), "").otherwise(F.concat(F.lit("<"), tag, inside, F.lit(">")))
    begin = F.concat(begin, F.when(F.col("act.patch_type") == "set-text", _escaped(F.col("act.patch_value"))).otherwise(""))
    end = F.when((F.col("node_type") == 3) | F.coalesce(bare, F.lit(False)) | F.col("tag").isin(*sorted(VOID)), "").otherwise(F.concat(F.lit("</"), tag, F.lit(">")))
    # A closing tag stands after the last node inside, deeper ones first.
    marks = F.array(F.struct(F.col("pre").alias("at"), F.lit(0).alias("side"), F.lit(0).alias("order"), begin.alias("html")), F.struct(F.col("last").alias("at"), F.lit(1).alias("side"), (-F.col("depth")).alias("order"), end.alias("html")))
    every = n.select("page_id", F.explode(F.filter(marks, lambda m: m["html"] != "")).alias("m"))
    return every.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["html"]), "").alias("final_html"))
