"""Stages of the HTML rewrite chain that need no tree, as column expressions.

A page is cut behind the closing tags that a stage looks for, each piece is rewritten
on its own and the pieces are joined again; nothing leaves generated code and nothing
is shuffled. Null html stays null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import SPACE, collapse, visible_text

#: Link texts that say nothing of their target, and the text for an image without a name.
WEAK_TEXT = "^(こちら|ここ|詳細はこちら|詳しくはこちら|詳細|クリックしてください|こちらから.*|.*こちら)$"
UNNAMED_IMAGE = "画像内容の確認が必要な画像"
FILE_TYPES = r"(?i)\.(pdf|docx?|xlsx?|pptx?|zip|csv)$"


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute, null where the tag has none of that name."""
    value = rf"""(?i)(?:^|\s){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    parts = [F.regexp_extract(tag, value, i) for i in (1, 2, 3)]
    return F.when(tag.rlike(value), F.concat(*parts))


def _escaped(c: Column) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")], c)


def _file_name(url: Column) -> Column:
    """Last non-empty part of a URL's path, percent signs decoded where they can be."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), "^[^?#]*", 0)
    path = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    return F.regexp_extract(path, "([^/]+)/*$", 1)


def _stem(file: Column) -> Column:
    return F.regexp_replace(file, r"(?i)\.[a-z0-9]+$", "")


def _spaced(stem: Column) -> Column:
    return F.trim(F.regexp_replace(stem, "[-_]+", " "))


def _pieces(html: Column, closing: str, change) -> Column:
    return F.array_join(F.transform(F.split(html, f"(?i)(?<={closing})", -1), change), "")


def remove_scripts(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<script.*?</script>", ""), r"(?is)<style.*?</style>", "")


def remove_empty_tables(html: Column) -> Column:
    """Tables without visible text and without media go."""

    def change(piece):
        table = F.regexp_extract(piece, r"(?is)<table\b[^>]*>.*", 0)
        empty = (table != "") & (visible_text(table) == "") & ~table.rlike(r"(?i)<(img|iframe|video|audio)\b")
        return F.when(empty, F.regexp_replace(piece, r"(?is)<table\b[^>]*>.*", "")).otherwise(piece)

    return _pieces(html, "</table>", change)


def link_label(href: Column) -> Column:
    """Label from a link's file name; empty where it says nothing."""
    file = _file_name(href)
    stem = _stem(file)
    label = _spaced(stem)
    kind = F.concat(F.lit("（"), F.upper(F.regexp_extract(file, r"\.([A-Za-z0-9]+)$", 1)), F.lit("ファイル）"))
    named = F.when(file.rlike(FILE_TYPES), F.concat(label, kind)).otherwise(label)
    return F.when((label == "") | stem.rlike("^[0-9]+$") | stem.rlike(r"(?i)^main(\.php)?$"), "").otherwise(named)


def name_weak_links(html: Column) -> Column:
    """Links whose text says nothing of their target take the name of the target's file."""
    link = r"(?is)^(.*?)<a\b([^>]*)>(.*?)</a>$"

    def change(piece):
        before, attrs, inner = (F.regexp_extract(piece, link, i) for i in (1, 2, 3))
        weak = F.regexp_replace(visible_text(inner), f"{SPACE}+", "").rlike(WEAK_TEXT)
        label = link_label(_attribute(attrs, "href"))
        return F.when(piece.rlike(link) & weak & (label != ""), F.concat(before, F.lit("<a"), attrs, F.lit(">"), _escaped(label), F.lit("</a>"))).otherwise(piece)

    return _pieces(html, "</a>", change)


def name_images(html: Column) -> Column:
    """Images without alternative text take their title, else the name of their file."""
    tag = r"(?is)^<img\b([^>]*)>"

    def change(piece):
        attrs = F.regexp_extract(piece, tag, 1)
        rest = F.regexp_replace(piece, tag, "")
        alt, title = _attribute(attrs, "alt"), _attribute(attrs, "title")
        name = _spaced(_stem(_file_name(_attribute(attrs, "src"))))
        label = F.when(title != "", title).when(name != "", F.concat(name, F.lit("の画像"))).otherwise(F.lit(UNNAMED_IMAGE))
        bare = F.regexp_replace(F.regexp_replace(attrs, r"""(?i)\salt(\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=\s|/|$)""", ""), r"\s*/?\s*$", "")
        named = F.concat(F.lit("<img"), bare, F.lit(' alt="'), _escaped(label), F.lit('">'), rest)
        return F.when(piece.rlike(tag) & (collapse(F.coalesce(alt, F.lit(""))) == ""), named).otherwise(piece)

    return F.array_join(F.transform(F.split(html, r"(?i)(?=<img\b)", -1), change), "")


def tidy(html: Column) -> Column:
    steps = [(f"{SPACE}+", " "), (">\\s+<", "><"), ("\\s+>", ">"), ("^ | $", "")]
    return reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, html)


#: The stages in their order.
STAGES = {"scripts": remove_scripts, "empty_tables": remove_empty_tables, "weak_links": name_weak_links, "images": name_images, "tidy": tidy}


def rewrite(pages: DataFrame, stages: list[str] | None = None) -> DataFrame:
    """``pages`` with final_html: the html after the named stages, all by default."""
    out = pages.withColumn("final_html", F.col("html"))
    for name in stages or STAGES:
        out = out.withColumn("final_html", STAGES[name](F.col("final_html")))
    return out
