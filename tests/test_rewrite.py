"""Rewrite stages and batch operators on small inputs."""

from pageloom.operators import batch, rewrite

CASES = [
    ("<script>x</script><p>a</p> <STYLE>b{}</STYLE>", "<p>a</p>"),
    ("<table><tr><td> </td></tr></table><p>k</p><table><tr><td>1</td></tr></table>", "<p>k</p><table><tr><td>1</td></tr></table>"),
    ("<table><tr><td><img src='a.gif' alt='x'></td></tr></table>", "<table><tr><td><img src='a.gif' alt='x'></td></tr></table>"),
    ('<a href="/f/annual_report-2020.pdf?x=1">こちら</a>', '<a href="/f/annual_report-2020.pdf?x=1">annual report 2020（PDFファイル）</a>'),
    ('<a href="/f/123.html">こちら</a><a name="n">詳細</a><a href="/guide/">詳細</a>', '<a href="/f/123.html">こちら</a><a name="n">詳細</a><a href="/guide/">guide</a>'),
    ('<a href="/x_y">見学</a>', '<a href="/x_y">見学</a>'),
    ('<img src="/i/my_photo.jpg"><img src="b.png" alt="ok">', '<img src="/i/my_photo.jpg" alt="my photoの画像"><img src="b.png" alt="ok">'),
    ('<img src="/i/a.jpg" alt="" title="T"/>', '<img src="/i/a.jpg" title="T" alt="T">'),
    ("<img>", '<img alt="画像内容の確認が必要な画像">'),
    ("  <p >a\n b</p>　 <p>c</p> ", "<p>a b</p><p>c</p>"),
    (None, None),
    ("", ""),
]


def test_stages(spark):
    pages = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(CASES)], "page_id long, html string")
    got = {r.page_id: r.final_html for r in rewrite.rewrite(pages).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES)}


def test_queue_and_totals(spark):
    a = spark.createDataFrame([("u", "c"), ("v", ""), (None, None), ("", "c")], "url string, category string")
    b = spark.createDataFrame([("u",), ("",)], "url string")
    queue = batch.build_queue(a, b)
    assert sorted((r.url or "", r.duplicate_url) for r in queue.collect()) == [("", False), ("", False), ("", False), ("u", True), ("u", True), ("v", False)]
    done = queue.selectExpr("if(url = 'u', 'done', 'error') as status", "duplicate_url", "1 as auto_accepted", "cast(null as int) as remaining")
    assert tuple(batch.batch_summary(done).first()) == (6, 2, 4, 2, 6, 0)
    assert tuple(batch.batch_summary(done.limit(0)).first()) == (0, 0, 0, 0, 0, 0)
    assert {(r.group, r.pages) for r in batch.pages_by(queue, queue["category"]).collect()} == {("c", 2), (batch.UNSORTED, 4)}


def test_rule_counts(spark):
    rules = spark.createDataFrame([("a", "x"), ("a", "y")], "category string, processing_class string")
    assert {tuple(r) for r in batch.rule_counts(rules).collect()} == {("category", "a", 2), ("processing_class", "x", 1), ("processing_class", "y", 1)}
