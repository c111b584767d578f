"""Small html and text rows that exercise what the driver tables hold none of."""

HTML = [
    (-1, "<h2>A</h2><h3 id='x'>B</h3><table><caption>c</caption><thead><tr><th scope=\"col\">a</th><th scope=\"row\">b</th></tr></thead><tr><td>1</td></tr></table>"),
    (-2, "<script>var a = '<h2>';</script><p>詳細はこちら &amp; more&nbsp;text</p><img src='a.gif' alt=''><img alt=\"photo\"><iframe src='x'></iframe>"),
    (-3, "<h4>x</h4><style>h2{}</style><IMG ALT=''><a href=\"/a\">詳細</a><a href=\"/b\">詳細</a>"),
]
TEXTS = [
    (-1, "料金は ¥1,200 と $5 です。TEL：0172-35 FAX 12"), (-2, "受付 9:30 から 10:00 まで、25:00 は無効"), (-3, "重さ 3.5kg、長さ 5cm、広さ 20m2、3kgs"), (-4, "５Ａ と Ｂ９ （日） （月曜）"), (-5, "한국어 문장"), (-6, "Это русский"), (-7, "我们 欢迎"),
]

DATES = [(-11, "2024/2/29 と 2023/2/29"), (-12, "1/2/3 と 2020.12.1、12020/1/1"), (-13, "2021.4.31  2021/13/1  0999/1/1  2999/01/09"), (-14, "2020/1/1/2 x2019/7/8y")]


def date_values() -> str:
    return ", ".join(f"({i}, '{t}')" for i, t in DATES)


def html_values() -> str:
    return ", ".join(f"({i}, '{h.replace(chr(39), chr(39) * 2)}')" for i, h in HTML)


def text_values() -> str:
    return ", ".join(f"({i}, '{t}')" for i, t in TEXTS)
