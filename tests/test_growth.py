"""Work and memory that must not grow faster than the input."""

import inspect
import re
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from pageloom.functions import text
from pageloom.operators import candidates, decisions
from pageloom.sources import html_nodes, page_tree, parse_html, parse_pages

PAGE = "<h1>a</h1><p>日 時 ：１ <a href='/x/../y/'>こちら</a></p><ul><li>b</ul><img><p id='i' style=''>９</p><a href='#i'>c</a>"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def pages(spark):
    return spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id long, html string")


def test_detectors_are_projected(spark):
    """No explode works out the detectors itself."""
    found = plan(candidates.element_candidates(parse_html(pages(spark))))
    assert re.findall(r"Generate explode\((\w+)", found) == ["c"]


def test_candidates_found_once_for_patches(spark):
    nodes = parse_html(pages(spark)).persist()
    found = decisions.auto_accept(candidates.find_candidates(nodes))
    assert plan(decisions.apply_patches(nodes, found)).count("Generate explode") <= plan(found).count("Generate explode") + 1
    nodes.unpersist()


def test_texts_of(spark):
    """Candidates and patched pages are those of the whole node table."""
    whole, part = parse_html(pages(spark)), parse_html(pages(spark), candidates.TEXTS_OF)
    assert {r["tag"] for r in html_nodes.page_nodes(1, PAGE, candidates.TEXTS_OF) if r["text"]} == {None, "h1", "p", "a"}
    for f in (lambda n: candidates.find_candidates(n), lambda n: decisions.apply_patches(n, decisions.auto_accept(candidates.find_candidates(n)))):
        assert sorted(map(repr, f(whole).collect())) == sorted(map(repr, f(part).collect()))


def test_node_batches(spark):
    """A batch holds few nodes, whatever the pages in it."""
    df = spark.range(300).select(F.col("id").alias("page_id"), F.lit("<p>x</p>" * 20).alias("html")).coalesce(1)
    assert parse_html(df, batch_nodes=100).count() == 300 * 40


def test_spaced_characters(spark):
    texts = ["日 時 ：", "a b c", "日 時", "x 日  時 y z 語", "日\u3000時\xa0分", "日時 a b", "", None, "あ い\nう え お", "aa b cc 日"]
    space, other = "[ \\t\u3000\xa0]", "[^\\s\u3000\xa0]"
    want = [None if t is None else [m for m in re.findall(f"(?a:(?:{other}{space}+){{2,}}{other})", t) if re.search("[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]", m)] for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[1] for r in sorted(df.select("i", text.spaced_characters(F.col("t"))).collect())] == want


def test_dot_segments(spark):
    links = ["/a/../b/", "/a/./b", "/a..b/", "..", ".", "", "/a/b/..", "/.x/", "c/index.html", "//h.invalid", "//h.invalid/.."]
    want = ["/b/", "/a/b", "/a..b/", "/", "/d/", "/d/e.html", "/a/", "/.x/", "/d/c/", "/", "/"]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(links)], "i int, href string")
    got = df.select("i", candidates._resolved(F.col("href"), F.lit("https://example.invalid/d/e.html"))["path"])
    assert [r[1] for r in sorted(got.collect())] == want


def test_memory_of_checks_does_not_grow_with_pages():
    """The parser holds a few pages' nodes, however many pages a batch has."""
    nodes = inspect.signature(parse_pages).parameters["batch_nodes"].default

    def peak(n):
        batch = pa.RecordBatch.from_pydict({"page_id": list(range(n)), "html": ["<p>あ<b>x</b></p>" * 60] * n})
        tracemalloc.start()
        most = max(b.num_rows for b in page_tree.node_batches([batch], nodes))
        held = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < nodes + 300
        return held

    assert peak(100) > 0.8 * peak(400)
