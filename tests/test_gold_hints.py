"""Hints of small pairs of pages."""

from pageloom.operators import gold_hints

PAIRS = [
    ("h", "<h3>About us</h3><h3>News</h3><h2></h2><h2>Same</h2>", "<h2>About us</h2><h2>Other words</h2><h2>Same</h2>"),
    ("twice", "<h3>A b</h3><h3>A b</h3>", "<h2>A b</h2>"),
    ("a", '<a href="/x/report.pdf?v=1">こちら</a><a href="/old/plan.html">here</a><a href="/n">More</a><a href="/z">ここ</a><a href="/q">fine label</a>', '<a href="/x/report.pdf">Annual report</a><a href="/new/plan.html">The plan</a><a href="/z/">ここ</a>'),
    ("i", '<img src="/a/p.jpg" alt=""><img src="/b.png" alt="old text"><img src="c.png" alt="same">', '<img src="/n/P.jpg" alt="Town hall"><img src="/other.png" alt="New text"><img src="c.png" alt="same">'),
    ("none", None, "<h1>x</h1>"),
]


def test_hints(spark):
    pairs = spark.createDataFrame(PAIRS, "file string, old_html string, gold_html string")
    got = sorted((r.file, r.target_kind, r.target_index, r.decision, r.confidence, r.before, r.gold) for r in gold_hints.learn_hints(pairs).collect())
    assert got == [
        ("a", "link", 0, "edited", "high", "こちら", "Annual report"),
        ("a", "link", 1, "edited", "medium", "here", "The plan"),
        ("a", "link", 2, "needs_review", "low", "More", "No matching gold link."),
        ("a", "link", 3, "needs_review", "low", "ここ", "ここ"),
        ("h", "heading", 0, "accepted", "high", "h3: About us", "h2: About us"),
        ("i", "image", 0, "edited", "high", "(empty alt)", "Town hall"),
        ("i", "image", 1, "edited", "medium", "old text", "New text"),
        ("twice", "heading", 0, "accepted", "high", "h3: A b", "h2: A b"),
    ]
