"""Checks and comparison on fixtures of our own."""

import pytest

from pageloom.operators import checks, compare
from pageloom.plans.check_cases import CASES
from pageloom.sources import page_tree, parse_pages

def test_cases():
    """Every check has a page on which it fires, but for those of the checklist."""
    assert {c for c, _, n, _ in CASES if n} >= set(checks.ALL_IDS) - set(checks.ALWAYS)
    assert {c for c, *_ in CASES} <= set(checks.ALL_IDS) and len(checks.ALL_IDS) == len(set(checks.ALL_IDS)) == 108


def test_extra_texts(spark):
    pages = [
        ("C_14.0", "<h2>a</h2><h4>b</h4>", " (H4タグの1階層上がH2タグです)"), ("C_7.0", "<area href='/Y'>", ' (href="/Y")'), ("C_57.6", "<a href='/e'></a>", "/e"), ("C_48.2", "<u>x</u>", "u"), ("C_13.0", "<font size=2>x</font>", ""), ("C_422.0", "<a accesskey=k></a><b accesskey=k></b>", "k"),
        ("C_423.0", "<p id=''></p><p id=''></p>", 'id=""'), ("C_12.0", "<table><tr><td><table><tr><td><table></table></table></table>", " (2階層の入れ子のテーブルが存在しています)"), ("C_51.1", "<iframe src='u'></iframe>", ": src=u"), ("C_57.1", "<a href=u title=t>x</a>", ' (link text="x", title="t", href="u")'),
    ]
    df = spark.createDataFrame([(i, h) for i, (_, h, _) in enumerate(pages)], "page_id long, html string")
    got = {}
    for r in checks.run_checks(parse_pages(df), [c for c, _, _ in pages]).collect():
        got.setdefault((r.page_id, r.check_id), []).append(r.extra_text)
    assert [x in got[i, c] for i, (c, _, x) in enumerate(pages)] == [True] * len(pages)


def test_page_tree():
    names = [f[0] for f in page_tree.FIELDS]
    row = lambda h: [dict(zip(names, r)) for r in page_tree.page_rows(1, h)]
    tags = lambda h: [(r["tag"], r["parent_tag"]) for r in row(h) if r["tag"]]
    assert tags("") == tags(None) == [("html", None), ("head", "html"), ("body", "html")]
    assert tags("<title>t</title>x")[2:] == [("title", "head"), ("body", "html")]
    assert tags("<table><td>a<tr><td>b")[3:] == [("table", "body"), ("tbody", "table"), ("tr", "tbody"), ("td", "tr"), ("tr", "tbody"), ("td", "tr")]
    assert tags("<td>a")[2:] == [("body", "html")]
    assert [r["path"] for r in row("<p>a</p><p id='q'><b>c</b></p>") if r["tag"]][3:] == ["html > body > p:nth-of-type(1)", "p#q", "p#q > b"]
    deep = row("<div>" * 3000 + "x")
    assert len(deep) == 3004 and max(len(r["path"] or "") for r in deep) < 40 * page_tree.DEPTH
    named = row("<a href=u><img alt=k aria-labelledby='m q'></a><p id=q> own  text </p><i id=r aria-labelledby=r role=img></i>")
    assert [r["text"] for r in named if r["tag"] == "a"] == ["own  text"]
    doc = lambda d: row(d)[0]["is_html5"]
    assert doc("<!doctype HTML>") and doc('<!DOCTYPE html SYSTEM "about:legacy-compat">') and not doc("<p>") and not doc('<!DOCTYPE html PUBLIC "-//W3C//DTD HTML 4.01//EN">')


def test_unknown_check(spark):
    with pytest.raises(ValueError):
        checks.run_checks(parse_pages(spark.createDataFrame([(1, "")], "page_id long, html string")), ["nope"])


def test_diff(spark):
    schema = "row_no long, type string, jis string, method string, message string, line string"
    row = lambda i, j, m="m": (i, "問題あり", j, "G1", m, str(i))
    b = spark.createDataFrame([row(1, "a"), row(2, "a"), row(3, "b", "x.css セレクタ=p")], schema)
    a = spark.createDataFrame([row(4, "a", "first"), row(5, "c")], schema)
    got = {r.jis: (r.status, r.before_count, r.after_count, r.message, r.classification) for r in compare.diff_reports(b, a).collect()}
    assert got == {"a": ("unresolved", 2, 1, "first", "unknown"), "b": ("resolved", 1, 0, "x.css セレクタ=p", "old-site-template"), "c": ("new", 0, 1, "m", "unknown")}


def test_dates(spark):
    from pyspark.sql import functions as F

    from pageloom.functions.text import date_name, full_dates

    df = spark.createDataFrame([("2024/2/29",), ("2023/2/29",), ("1/2/3",), ("x 2020.12.1 y 12020/1/1",)], "t string")
    got = [r[0] for r in df.select(F.transform(full_dates(F.col("t")), date_name)).collect()]
    assert got == [["2024年2月29日"], [], [], ["2020年12月1日"]]


def test_checklist(spark):
    pages = spark.createDataFrame([(1, "<p>x</p>"), (2, "<a href='u'>x</a>"), (3, "")], "page_id long, html string")
    got = {(r.page_id, r.check_id) for r in checks.run_checks(parse_pages(pages), checks.ALWAYS).collect()}
    assert len(checks.ALWAYS) == 19
    assert got == {(i, c) for i in (1, 2, 3) for c in checks.ALWAYS if i == 2 or c not in ("C_56.1", "C_81.0")}
