"""Hints mined from pairs of an old page and its gold page.

Headings, links and images of both pages are arrays of one row, so a hint is a fold over
the row's own arrays: no shuffle, no Python. A pair costs its old elements times its
gold elements, which a page bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import ENTITIES, SPACE, _chain, dice, token_set, visible_text

#: Labels that say nothing of a link's target, and texts that say nothing of an image.
WEAK_LINK = "^(こちら|ここ|詳細|詳細はこちら|詳しくはこちら|クリックしてください|clickhere|here|more)$"
GENERIC_ALT = "^(画像|写真|イラスト|図|地図|案内図|image|photo|picture|img)$"
#: Least similarities of a heading's and of a link's text.
HEADING_LEAST, HEADING_HIGH, LINK_LEAST = 0.92, 0.99, 0.82
HINT = "target_index int, decision string, confidence string, before string, gold string"


def _value(attrs: Column, name: str) -> Column:
    """Value of a quoted attribute with its references decoded; empty where absent."""
    return _chain(F.concat(*[F.regexp_extract(attrs, rf"(?i)\s{name}=(?:\"([^\"]*)\"|'([^']*)')", i) for i in (1, 2)]), ENTITIES)


def _path(url: Column) -> Column:
    path = F.regexp_extract(url, "^[^?#]*", 0)
    return F.lower(F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path))


def _numbered(elements: Column) -> Column:
    return F.transform(elements, lambda x, i: F.struct(i.alias("index"), x.alias("e")))


def headings(html: Column) -> Column:
    """Array of (index, e: level, text, tokens); headings without text are none."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)(<(h[1-6])\b[^>]*>.*?</\2>)"), F.lit(1))
    made = F.transform(found, lambda h: F.struct(F.substring(h, 3, 1).cast("int").alias("level"), visible_text(h).alias("text"), token_set(visible_text(h)).alias("tokens")))
    return _numbered(F.filter(made, lambda h: h["text"] != ""))


def anchors(html: Column) -> Column:
    """Array of (index, e: href, key, tail, text, tokens)."""

    def made(a):
        href = _value(F.regexp_extract(a, r"(?is)^<a\b([^>]*)>", 1), "href")
        key, text = F.regexp_replace(_path(href), "/+$", ""), visible_text(a)
        return F.struct(href.alias("href"), key.alias("key"), F.regexp_extract(key, "([^/]+)$", 1).alias("tail"), text.alias("text"), token_set(text).alias("tokens"))

    return _numbered(F.transform(F.regexp_extract_all(html, F.lit(r"(?is)(<a\b[^>]*>.*?</a>)"), F.lit(1)), made))


def images(html: Column) -> Column:
    """Array of (index, e: key, alt)."""

    def made(attrs):
        return F.struct(F.regexp_extract(_path(_value(attrs, "src")), "([^/]+)/*$", 1).alias("key"), visible_text(_value(attrs, "alt")).alias("alt"))

    return _numbered(F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<img\b([^>]*)>"), F.lit(1)), made))


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once instead of wherever it is named."""
    return F.transform(F.array(value), then)[0]


def _best(gold: Column, score) -> Column:
    """(score, index, e) of the gold element of the largest score, the first of equals; null
    where none scores above zero."""
    scored = F.filter(F.transform(gold, lambda g: F.struct(score(g).alias("score"), (-g["index"]).alias("order"), g["e"].alias("e"))), lambda g: g["score"] > 0)
    return F.array_max(F.transform(scored, lambda s: F.struct(s["score"].alias("score"), s["order"].alias("order"), s["e"].alias("e"))))


def _hint(index: Column, decision, confidence, before: Column, gold: Column) -> Column:
    as_col = lambda c: c if isinstance(c, Column) else F.lit(c)
    return F.struct(index.cast("int").alias("target_index"), as_col(decision).alias("decision"), as_col(confidence).alias("confidence"), before.alias("before"), gold.alias("gold"))


def heading_hints(old: Column, gold: Column) -> Column:
    """Old headings whose text the gold page keeps at another level. A gold heading serves
    one hint; one matched at its own level stays free."""
    empty = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast(f"array<struct<{HINT.replace(' ', ':').replace(',:', ',')}>>").alias("hints"))

    def step(acc, o):
        free = F.filter(gold, lambda g: ~F.array_contains(acc["used"], g["index"]))
        similar = lambda g: dice(o["e"]["tokens"], g["e"]["tokens"])
        best = _best(free, lambda g: F.when(similar(g) >= HEADING_LEAST, similar(g)).otherwise(0.0))
        name = lambda e: F.concat(F.lit("h"), e["level"].cast("string"), F.lit(": "), e["text"])

        def add(best):
            hint = _hint(o["index"], "accepted", F.when(best["score"] >= HEADING_HIGH, "high").otherwise("medium"), name(o["e"]), name(best["e"]))
            moved = best["e"]["level"] != o["e"]["level"]
            return F.when(moved, F.struct(F.concat(acc["used"], F.array((-best["order"]).cast("int"))).alias("used"), F.concat(acc["hints"], F.array(hint)).alias("hints"))).otherwise(acc)

        return _let(best, add)

    return F.aggregate(old, empty, step, lambda acc: acc["hints"])


def _weak(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, f"{SPACE}+", "")).rlike(WEAK_LINK)


def link_hints(old: Column, gold: Column) -> Column:
    """For every old link of a weak label the gold link of the same target, file or text."""

    def one(o):
        a = o["e"]

        def href(e):
            return F.when((a["key"] == "") | (e["key"] == ""), 0.0).when(a["key"] == e["key"], 1.0).when((a["tail"] != "") & (a["tail"] == e["tail"]), 0.6).otherwise(0.0)

        def score(g):
            text = dice(a["tokens"], g["e"]["tokens"])
            return F.when((href(g["e"]) > 0) | (text >= LINK_LEAST), href(g["e"]) * 2 + text).otherwise(0.0)

        before = F.when(a["text"] != "", a["text"]).otherwise(a["href"])

        def judge(best):
            sure = F.when(href(best["e"]) >= 1, "high").otherwise("medium")
            return (
                F.when(best.isNull(), _hint(o["index"], "needs_review", "low", before, F.lit("No matching gold link.")))
                .when(~_weak(best["e"]["text"]), _hint(o["index"], "edited", sure, before, best["e"]["text"])).otherwise(_hint(o["index"], "needs_review", "low", before, best["e"]["text"]))
            )

        return _let(_best(gold, score), judge)

    return F.transform(F.filter(old, lambda o: _weak(o["e"]["text"])), one)


def image_hints(old: Column, gold: Column) -> Column:
    """Old images for which the same image, or the one in its place, has a telling text."""
    generic = lambda c: (c == "") | F.lower(c).rlike(GENERIC_ALT)

    def one(o):
        a = o["e"]
        same = lambda e: (a["key"] != "") & (a["key"] == e["key"])
        before = F.when(a["alt"] != "", a["alt"]).otherwise(F.lit("(empty alt)"))

        def judge(best):
            alt = best["e"]["alt"]
            told = best.isNotNull() & ~generic(alt) & (generic(a["alt"]) | (a["alt"] != alt))
            return F.when(told, _hint(o["index"], "edited", F.when(same(best["e"]), "high").otherwise("medium"), before, alt))

        return _let(_best(gold, lambda g: F.when(same(g["e"]), 3).otherwise(0) + F.when(g["index"] == o["index"], 1).otherwise(0)), judge)

    return F.filter(F.transform(old, one), lambda h: h.isNotNull())


def learn_hints(pairs: DataFrame) -> DataFrame:
    """(file, rule_id, target_kind, target_index, decision, confidence, before, gold) from
    pairs (file, old_html, gold_html). Null html has no elements."""
    both = pairs.select("file", F.coalesce("old_html", F.lit("")).alias("o"), F.coalesce("gold_html", F.lit("")).alias("g"))
    kinds = {"heading": ("html-structure.heading-order", headings, heading_hints), "link": ("link.link-text", anchors, link_hints), "image": ("image.alt-text", images, image_hints)}
    out = both.select("file", *[find(F.col(c)).alias(f"{c}_{k}") for k, (_, find, _) in kinds.items() for c in "og"])
    fields = [f.split()[0] for f in HINT.split(", ")]

    def part(kind: str, rule: str, hints) -> Column:
        return F.transform(hints(F.col(f"o_{kind}"), F.col(f"g_{kind}")), lambda h: F.struct(F.lit(rule).alias("rule_id"), F.lit(kind).alias("target_kind"), *[h[f].alias(f) for f in fields]))

    parts = [part(k, rule, hints) for k, (rule, _, hints) in kinds.items()]
    return out.select("file", F.explode(F.concat(*parts)).alias("h")).select("file", "h.*")


def hint_counts(hints: DataFrame) -> DataFrame:
    return hints.groupBy("rule_id", "target_kind", "decision", "confidence").agg(F.count(F.lit(1)).alias("n"))
