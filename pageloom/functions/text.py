"""Text rules as column expressions; everything stays inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unit marks and their names.
UNITS = {"㎝": "センチメートル", "cm": "センチメートル", "㎜": "ミリメートル", "mm": "ミリメートル", "㎞": "キロメートル", "km": "キロメートル", "㎏": "キログラム", "kg": "キログラム", "㎡": "平方メートル", "m2": "平方メートル", "m²": "平方メートル", "㎥": "立方メートル", "m3": "立方メートル", "m³": "立方メートル", "m": "メートル", "g": "グラム"}
#: Words that Japanese text never spells this way.
CHINESE = "我们|我們|你们|你們|他们|他們|它们|它們|不是|没有|沒有|可以|因为|因為|所以|但是|如果|虽然|雖然|哪里|哪裡|什么|什麼|怎么|怎麼|谢谢|謝謝|欢迎|歡迎|这个|這個|你好|请问|請問"
#: White space as browsers' patterns have it.
SPACE = r"[\s   -     　﻿\x0b]"
FULL = "".join(chr(c) for r in ((0xFF10, 0xFF1A), (0xFF21, 0xFF3B), (0xFF41, 0xFF5B)) for c in range(*r))
HALF = "".join(chr(ord(c) - 0xFEE0) for c in FULL)
ENTITIES = [("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&quot;", '"'), ("(?i)&#39;", "'")]


def _chain(c: Column, steps) -> Column:
    return reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), steps, c)


def count_matches(c: Column, pattern: str) -> Column:
    """Matches of a pattern that is never empty. Splitting is linear, where regexp_count
    copies the text for each match."""
    return F.size(F.split(c, pattern)) - 1


def half_width(c: Column) -> Column:
    return F.translate(c, FULL, HALF)


def currency(c: Column) -> Column:
    return _chain(c, [(rf"[¥￥]{SPACE}*([0-9,]+)", "$1円"), (rf"\${SPACE}*([0-9,]+)", "$1ドル")])


def tel_fax(c: Column) -> Column:
    return _chain(c, [(rf"(?i)(?:TEL|ＴＥＬ){SPACE}*[：:]", "電話番号："), (rf"(?i)(?:TEL|ＴＥＬ){SPACE}*", "電話番号"), (rf"(?i)(?:FAX|ＦＡＸ){SPACE}*[：:]", "ファックス番号："), (rf"(?i)(?:FAX|ＦＡＸ){SPACE}*", "ファックス番号")])


def time_notation(c: Column) -> Column:
    # Word bounds are those of ASCII: kana may follow a time at once.
    left, right = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
    return _chain(c, [(f"{left}0?([0-9]|1[0-9]|2[0-3]):00{right}", "$1時"), (f"{left}0?([0-9]|1[0-9]|2[0-3]):0([1-9]){right}", "$1時$2分"), (f"{left}0?([0-9]|1[0-9]|2[0-3]):([1-5][0-9]){right}", "$1時$2分")])


def units(c: Column) -> Column:
    ordered = sorted(UNITS, key=len, reverse=True)
    return reduce(lambda x, u: F.regexp_replace(x, rf"(?i)([0-9]+(?:\.[0-9]+)?){SPACE}*{u}(?![A-Za-z])", f"$1{UNITS[u]}"), ordered, c)


def weekday(c: Column) -> Column:
    return F.regexp_replace(c, rf"[（(]{SPACE}*([日月火水木金土])曜?{SPACE}*[)）]", "（$1曜日）")


def full_dates(c: Column) -> Column:
    """Array of the calendar-valid Y/M/D tokens of a text."""
    found = F.regexp_extract_all(c, F.lit(r"(?<![0-9/.])([0-9]{4}[/.][0-9]{1,2}[/.][0-9]{1,2})(?![0-9/.])"), F.lit(1))
    part = lambda x, i: F.split(x, "[/.]").getItem(i).cast("int")
    # The calendar check: a day past its month's end moves into the next month.
    day = lambda x: F.date_add(F.make_date(part(x, 0), F.greatest(F.least(part(x, 1), F.lit(12)), F.lit(1)), F.lit(1)), part(x, 2) - 1)
    valid = lambda x: part(x, 0).between(1000, 2999) & part(x, 1).between(1, 12) & part(x, 2).between(1, 31) & (F.month(day(x)) == part(x, 1))
    return F.filter(found, valid)


def date_name(x: Column) -> Column:
    p = F.split(x, "[/.]")
    return F.concat(p.getItem(0), F.lit("年"), p.getItem(1).cast("int").cast("string"), F.lit("月"), p.getItem(2).cast("int").cast("string"), F.lit("日"))


def spaced_characters(c: Column) -> Column:
    """Runs of three or more single characters apart, one of them CJK."""
    runs = F.regexp_extract_all(c, F.lit(r"((?:[^\s　 ][ \t　 ]+){2,}[^\s　 ])"), F.lit(1))
    cjk = r"[぀-ヿ㐀-鿿豈-﫿]"
    # What every run holds is looked for first: few texts have both.
    maybe = c.rlike(r"[ \t　 ][^\s　 ][ \t　 ]") & c.rlike(cjk)
    return F.when(~maybe, F.array().cast("array<string>")).otherwise(F.filter(runs, lambda x: x.rlike(cjk)))


def language_script(c: Column) -> Column:
    return (
        F.when(c.rlike(r"\p{IsHangul}{2,}"), "ko").when(c.rlike(r"\p{IsThai}{2,}"), "th").when(c.rlike(r"\p{IsCyrillic}{3,}"), "ru")
        .when(c.rlike(r"\p{IsHan}{2,}") & c.rlike(CHINESE), "zh").when(c.rlike(r"[Ạ-ỹ]"), "vi")
        .when(c.rlike(r"[A-Za-zÀ-ſḀ-ỿ]{3,}(?:[ ,.'\"-]+[A-Za-zÀ-ſḀ-ỿ]{2,}){2}"), "latin").otherwise("")
    )


def collapse(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"{SPACE}+", " "), "^ | $", "")


def visible_text(html: Column) -> Column:
    bare = _chain(F.coalesce(html, F.lit("")), [(r"(?is)<script.*?</script>", " "), (r"(?is)<style.*?</style>", " "), (r"<[^>]+>", " ")])
    return collapse(_chain(bare, ENTITIES))


def token_set(text: Column) -> Column:
    """Distinct words of a-z and 0-9 and pieces of up to three characters of kana and Han.

    Tokens are set apart and split: extracting all matches copies the text for each."""
    apart = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9぀-ヿ㐀-鿿]+", " "), "([a-z0-9]+|[぀-ヿ㐀-鿿]{1,3})", "$1 ")
    return F.array_distinct(F.array_remove(F.split(apart, " +"), ""))


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of two token sets; 1 if both are empty."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)
