"""Candidates on fixtures of our own."""

from pageloom.operators import candidates, decisions
from pageloom.sources import parse_html

RULE = {"order": "html-structure.heading-order", "need": "html-structure.heading-required", "thin": "html-structure.heading-content-quality", "lone": "html-structure.heading-link-only", "dup": "html-structure.duplicate-id-accesskey", "gone": "html-structure.deprecated-elements", "refresh": "html-structure.embedded-script-behavior", "alone": "link.link-purpose-standalone"}
CASES = [
    ("order", "<h1>aaa</h1><h2>bbb</h2><h3>ccc</h3>", ["h2"]), ("order", "<h4>aaa</h4><h5>bbb</h5><h2>ccc</h2><h4>ddd</h4>", ["h2", "h3", "h3"]), ("order", "<h2>aaa</h2><h3>bbb</h3>", []), ("order", "<h2>aaa</h2><h5>bbb</h5><h6>ccc</h6>", ["h3", "h4"]),
    ("need", "<p>対象者</p><table><tr><td><p>対象者</p></td></tr></table>", ["h3"]), ("thin", "<h2>※</h2><h2>あい</h2><h2>あいう</h2><h2></h2>", [None, None]), ("lone", "<h2><a href='/a/b.html'>案内</a></h2><h2><a href='#x'>案内</a></h2><h2>x<a href='/a'>案内</a></h2>", [None]),
    ("dup", "<p id='x'></p><p id='x'></p><a accesskey='x'></a><p id=' x '></p>", [None, None]), ("gone", "<img longdesc='a' alt='b'><table summary='s'></table><marquee>m</marquee><blink> </blink>", ["longdesc", "summary", None]), ("refresh", "<meta http-equiv='Refresh' content='1'>", [None]),
    ("alone", "<a href='/x'></a><a href='#'></a>", [None]), ("alone", "<a href='/x'><span></span></a><a href='/x'>name</a><a href='/y'><img src='i'></a>", [None, None]), ("alone", "<a href='/x'>n</a><a href='/y'>n</a><a href='/x'>n</a><a href='/y'>n</a><a href='/z'>n</a>", [None, None]),
    ("link.toppage-link", "<a href='/'>t</a><a href='../'>t</a><a href='index.html'>t</a><a href='/b/'>t</a>", ["サイト名のトップページ"] * 3), ("link.category-link", "<a href='/b/'>t</a><a href='/b/./index.php'>t</a><a href='/b/x'>t</a>", [None, None]), ("link.external-link", "<a href='https://other.invalid/x'>t</a><a href='//other.invalid'>t</a><a href='mailto:a@b.c'>t</a>", [None, None]),
    ("link.internal-link", "<a href='https://example.invalid/x'>t</a><a href='b.html'>t</a><a href='b.pdf'>t</a>", [None, None]), ("file.external-pdf", "<a href='https://other.invalid/x.pdf?a'>t</a>", [None]), ("link.cross-page-anchor", "<a href='b.html#c'>t</a><a href='#c'>t</a><a href='/#c'>t</a>", [None]), ("link.in-page-anchor", "<a href='#c'>t</a><a href='#'>t</a>", [None]),
    ("link.link-broken", "<a>t</a><a href='#'>t</a><a href='/x'>t</a>", [None, None]), ("link.link-text", "<a href='/f/report.pdf'>こちら</a><a href='/x'>ここ</a><a href='/x'>こちらの表</a>", ["report", "リンク先の内容を具体的に入力"]), ("link.link-text", "<a href='JavaScript:x()'>t</a>", ["href"]), ("link.mail-link", "<a href='mailto:a@b.jp'>t</a><a href='/x'>a@b.jp</a>", ["担当部署へメールを送信"] * 2),
    ("file.file-display-text", "<a href='/x'>申請書（PDF：123KB）</a><a href='/x'>申請書</a>", ["申請書"]), ("table.th-scope", "<table><tr><th>a</th><th>b</th></tr></table>", ["row", "col"]), ("table.th-scope", "<table><tr><th scope='x'>a</th><th scope='col'>b</th></tr></table>", ["row"]), ("table.th-scope", "<table><tr><td headers='n p t'>a</td><td id='t'><p id='p'>b</p></td></tr></table>", [None, None]),
    ("table.caption", "<table><caption>一覧</caption></table><table><caption>人口</caption></table>", [None]), ("image.alt-text", "<img><img alt=' '><img alt='夏の写真'><img alt='夏'>", ["夏の内容を具体的に説明", "画像内容を具体的に入力", "画像内容を具体的に入力"]), ("image.caption", "<figure><figcaption>写真：夏</figcaption></figure>", ["夏"]), ("text.spaced-characters", "<img alt='案 内 図'><p>日 時：x</p><p>場 所 名</p>", ["場所名", "案内図"]),
    ("image.display-width", "<img width='300' alt='a'><img style='width: 20px' alt='a'><img alt='a'>", [None, None]), ("image.complex-image-report", "<img src='map.gif' alt='a'>", [None]), ("image.linked-image", "<a href='/x'><img alt='夏'></a><a href='/x'><img alt='夏'>t</a>", [None]), ("image.multiple-images", "<p><img alt='a'><a href='/x'><img alt='b'></a></p><p><img alt='c'></p>", [None]), ("iframe.title", "<iframe src='youtube'></iframe><iframe title='map' src='/maps'></iframe><iframe title='市の窓口'></iframe>", ["動画の内容を入力", "地図の内容を入力"]),
    ("text.color", "<p style='COLOR : red'>a</p><p style='background-color:red'>a</p>", ["color"]), ("text.background-color", "<p style='background-color:red'>a</p><td bgcolor='x'>", ["background,background-color", "bgcolor"]), ("text.sensory-characteristics", "<p style='color:red;background:x'>a</p><font color='x'>b</font><p>右側の表</p>", [None, None, None]), ("text.decoration-lines", "<u>a</u><p style='font-style:italic'>a</p>", [None, "font-style,text-decoration"]),
    ("text.bold", "<b>a</b><strong>b</strong>", [None, None]), ("text.list", "<ul></ul><ul><li>a</li></ul><ul><li>a</li><li>b</li></ul><ul><ul><li>a</li><li>b</li></ul></ul>", [None, None]), ("text.list", "<p>1．a</p> <p>2．b</p><p>c</p><p>3．d</p>", [None]), ("text.note-symbol", "<p>※注</p>", [None]), ("text.meaningless-symbol", "<p>→ ◎</p><table><tr><td>→</td></tr></table>", [None]), ("text.foreign-language", "<p>한국어</p>", [None]),
    ("text.date-notation", "<p>2024/2/29 2023/2/29 2024/2/29</p>", ["2024年2月29日"]), ("text.time-notation", "<p>9:30から10:00</p>", ["10時", "9時30分"]), ("text.currency-notation", "<p>¥1,200</p>", ["1,200円"]), ("text.unit-notation", "<p>3.5kg 3kgs</p>", ["3.5キログラム"]), ("text.tel-fax", "<p>TEL：1 Fax 2</p>", ["ファックス番号", "電話番号："]), ("text.weekday-notation", "<p>（日）</p>", ["（日曜日）"]), ("text.alphanumeric", "<p>５Ａ</p>", ["5A"]),
]


def shown(r):
    v = r.patch_value or r.patch_name
    return ",".join(sorted(v.split(","))) if r.patch_name and "," in (r.patch_name or "") else v


def test_candidates(spark):
    pages = spark.createDataFrame([(i, h) for i, (_, h, _) in enumerate(CASES)] + [(-1, None), (-2, "")], "page_id long, html string")
    got = {}
    found = candidates.find_candidates(parse_html(pages)).collect()
    for r in found:
        got.setdefault((r.page_id, r.rule_id), []).append(shown(r))
    key = lambda v: v or ""
    have = [(c, h, sorted(got.get((i, RULE.get(c, c)), []), key=key)) for i, (c, h, _) in enumerate(CASES)]
    want = [(c, h, sorted(w, key=key)) for c, h, w in CASES]
    for mine, right in zip(have, want):
        assert mine == right
    assert all(r.page_id >= 0 for r in found)
    assert len({(r.page_id, r.candidate_id) for r in found}) == len(found)


def test_patches(spark):
    cases = [
        ("<h1 class=\"k\">aaa</h1><p>５Ａ &amp; b</p>", "<h2>aaa</h2><p>5A &amp; b</p>"), ("<p style='color:red; Font-Size:2px'>x<br>y</p>", "<p>x<br>y</p>"), ("<p>a<u>b<i>c</i></u>d</p>", "<p>abcd</p>"), ("<meta http-equiv='refresh' content='1'><p>a</p>", "<p>a</p>"),
        ("<a href='/x'>案内（PDF：1KB）<b>!</b></a>", "<a href=\"/x\">案内!</a>"), ("<a href='/x'><b>案内</b>（PDF：1KB）</a>z", "<a href=\"/x\">案内</a>z"), ("<h2><a href='/x'>案内所</a></h2>", "<a href=\"/x\">案内所</a>"), ("<table summary='s' id='t'><tr><td bgcolor='x'>a</table>", "<table><tr><td>a</td></tr></table>"),
        ("<p>9:30（日）</p><script>a<b</script>", "<p>9時30分（日曜日）</p><script>a<b</script>"), ("", None), (None, None),
        ("<p id='a' class='c'>x</p><p id='b'>y</p><a href='#a'>案内所</a>", "<p id=\"a\">x</p><p>y</p><a href=\"#a\">案内所</a>"), ("<p id='a'>x</p><p id='b'>y</p><label for='q b'>z</label>", "<p>x</p><p id=\"b\">y</p><label for=\"q b\">z</label>"),
    ]
    nodes = parse_html(spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "page_id long, html string"))
    decided = decisions.auto_accept(candidates.find_candidates(nodes))
    got = {r.page_id: r.final_html for r in decisions.apply_patches(nodes, decided).collect()}
    for i, (h, want) in enumerate(cases):
        assert (h, got.get(i)) == (h, want)
    scopes = candidates.find_candidates(parse_html(spark.createDataFrame([(1, "<table><tr><th>a</th></tr></table><img>")], "page_id long, html string")))
    assert {r.rule_id: r.decision for r in decisions.auto_accept(scopes).collect()} == {"table.th-scope": "accepted", "image.alt-text": "undecided"}
    done = {r.page_id: (r.total, r.unresolved, r.complete) for r in decisions.completion(decided).collect()}
    assert done[0] == (2, 0, True) and done[3] == (1, 0, True)
    table = spark.createDataFrame([("text.color", "t", ["C_1"]), ("text.alphanumeric", "u", [])], "id string, title string, michecker_check_ids array<string>")
    assert {r.rule_id for r in decisions.in_scope(decided, table).collect()} == {"text.color"}
