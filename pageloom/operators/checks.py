"""Accessibility checks over the nodes of pages (``parse_pages``).

A check is a row filter with a cardinality: one problem per element, per page, per
page and tag, or a small plan of its own. ``run_checks`` unions the branches of the
chosen checks; all branches read the same nodes, so a caller should write the nodes
once. Grouped checks combine before their shuffle, on page keys.

Output: page_id, check_id, type, nodes (selectors), pres (their numbers), extra_text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LINK = "tag = 'a' and attrs['href'] is not null"
SPACE = r"[\\s\\u000B\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
BLANK = f"rlike '^{SPACE}*$'"


def _words(text: str) -> str:
    """Number of words; the delimiters are fixed values."""
    return rf"size(filter(split({text}, '[ \\t\\n\\r\\f,.\\[\\]()<>!?:/\"、。「」・〈〉　]+'), x -> x <> ''))"


def _trimmed(text: str) -> str:
    return f"regexp_replace({text}, '^{SPACE}+|{SPACE}+$', '')"


def _number(attr: str) -> str:
    return f"try_cast(regexp_extract(attrs['{attr}'], '^[+-]?[0-9]+$', 0) as bigint)"


def _extension(url: str) -> str:
    """What follows the last dot that is not the first character."""
    return rf"lower(if(coalesce({url}, '') rlike '(?s)^.+\\.[^.]*$', regexp_extract({url}, '(?s)^.+\\.([^.]*)$', 1), ''))"


#: File extensions of sound and films (fixed values).
MEDIA = "('mp3', 'mid', 'mrm', 'mrl', 'vqf', 'wav', 'ogg', 'spx', 'oga', 'avi', 'ram', 'rm', 'asf', 'wm', 'wmx', 'wmv', 'asx', 'mpeg', 'mpg', 'mp4', 'ogv', '3gp')"
# A side that is no number makes both count as 100; a missing one counts as 0.
_ODD = f"((attrs['width'] is not null and {_number('width')} is null) or (attrs['height'] is not null and {_number('height')} is null))"
_W, _H = (f"if({_ODD}, 100, coalesce({_number(a)}, 0))" for a in ("width", "height"))
NORMAL = f"(({_W} >= 50 and {_H} >= 50) or (greatest({_W}, {_H}) >= 50 and least({_W}, {_H}) / greatest({_W}, {_H}) >= 0.2))"
TITLE, ALT, SRC, DATA, VALUE, HREF = (f"attrs['{a}']" for a in ("title", "alt", "src", "data", "value", "href"))
REFRESH = "tag = 'meta' and lower(attrs['http-equiv']) = 'refresh'"
TITLED = f"attrs['title'] is not null and not attrs['title'] {BLANK}"
#: Style patterns of attributes and, in braces, of style elements.
COLOR = r"rlike '(?is)^(((.*[^-]+)color)|(\\s)*color)(\\s)*:.*$'"
BACK = r"rlike '(?is)background-color(\\s)*:'"
FIXED = r"rlike '(?is)font-size(\\s)*:[^;v]*(mm|cm|in|pt|pc|px)'"
VIEW = r"rlike '(?is)font-size(\\s)*:[^;v]*(vh|vw|vi|vb|vmin|vmax)'"
IN_COLOR = r"rlike '(?is)\\{(.*[^-]+)?color(\\s)*:.*?\\}'"
IN_BACK = r"rlike '(?is)\\{.*?background-color(\\s)*:.*?\\}'"
IN_FIXED = r"rlike '(?is)\\{[^}]*font-size(\\s)*:[^;v]*(mm|cm|in|pt|pc|px).*\\}'"
IN_VIEW = r"rlike '(?is)\\{[^}]*font-size(\\s)*:[^;v]*(vh|vw|vi|vb|vmin|vmax).*\\}'"
_STYLE_EXTRA = "if(tag = 'style' and style is not null, '', concat('(style属性, ', attrs['style'], ')'))"

# Links: their text, or their name where it is blank; short texts are looked at.
LINK_TEXT = f"if({_trimmed('text')} = '' and name is not null, {_trimmed('name')}, text)"
SHORT = f"{LINK} and {_words(LINK_TEXT)} < 3 and length({LINK_TEXT}) < 20"
UNTITLED = f"{SHORT} and coalesce(attrs['title'], '') = ''"
EMPTY = f"{UNTITLED} and {_trimmed(LINK_TEXT)} = '' and not startswith(attrs['href'], '#')"

# Drawings of characters: glyphs, and symbols that separate words (fixed values).
GLYPHS = "[∧＿￣＠／＼γΦ∩∪ιＯ⊂ﾟДσ･∀∑io0_´｀ヾ]"
PUNCTUATION = r"[\\x21-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7E]"
SYMBOL = r"[\\u2200-\\u22FF\\u25A0-\\u25FF\\u2600-\\u27BF\\u2500-\\u257F\\u2000-\\u206F\\u3000-\\u303F\\u2190-\\u21FF\\p{P}\\p{S}\\s]"


def _art(text: str) -> str:
    """Whether more than 30 characters and most of the text draw something."""
    whole = rf"length(regexp_replace({text}, '[ \\t\\n\\u000B\\f\\r]', ''))"
    drawn = f"(regexp_count({text}, '{PUNCTUATION}') + regexp_count(regexp_replace({text}, '{PUNCTUATION}', ''), '{GLYPHS}'))"
    return f"({drawn} > 30 and ({drawn} / greatest({whole}, 1) > 0.8 or {_symbols(text)}))"


def _symbols(text: str) -> str:
    return f"(length({text}) > 0 and length(regexp_replace(lower({text}), '{SYMBOL}', '')) / length({text}) < 0.5 and not {text} {BLANK})"


#: Alternative texts that say nothing: whole ones and words (fixed values).
NO_ALT = "('spacer gif', 'spacer.gif', 'spacer', 'space', 'blank', 'click here', 'clickhere', 'click here!', 'null', 'void', 'banner', 'line', 'dashline', 'image', 'gif', 'gif image', 'jpeg', 'jpeg image', 'photo', 'bullet', 'icon', 'button', 'ボタン', 'alt')"
NO_WORD = "('spacer', 'space', 'blank', 'null', 'void', 'banner', 'line', 'dashline', 'gif', 'jpeg', 'bullet', 'shade', 'star', 'bar', 'icon', '影', '点', '空白', '線', '画像', '写真', 'バナー', 'アイコン', '背景')"


def alt_problem(alt: str, more: str = "''") -> str:
    """SQL that names what is wrong with an alternative text: OK if nothing; ``more`` is a
    further text that says nothing."""
    low = _trimmed(f"lower({alt})")
    words = f"filter(split({low}, '{SYMBOL}'), w -> w <> '')"
    share = f"size(filter({words}, w -> w in {NO_WORD})) / size({words})"
    japanese = r"[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}]"
    return rf"""case when {alt} = '' then 'NULL' when {alt} {BLANK} then if({alt} like '% %', 'BLANK_NBSP', 'BLANK')
        when {low} in {NO_ALT} or {low} = {more} or {low} rlike '画像\\s*[0-9]+' then 'NG_WORD' when {low} rlike '(?is)\\.(jpg|jpeg|gif|png|bmp|tiff)$' then 'IMG_EXT'
        when {low} rlike '(?:[A-Za-z]\\s){{3,}}' then 'SPACE_SEPARATED' when {low} rlike '\\b{japanese}[\\s\\u3000\\u00A0]+{japanese}\\b' then 'SPACE_SEPARATED_JP' when {_symbols(alt)} then 'ASCII_ART'
        when size({words}) > 0 and {share} > 0.6 then 'INCLUDING_MANY_NG_WORD' when size({words}) > 0 and {share} > 0.3 then 'INCLUDING_NG_WORD' else 'OK' end"""


#: id: (severity, condition on an element, extra text); one problem each.
EACH = {
    "C_18.2": ("error", "coalesce(attrs['cite'], '') = '' and ((tag = 'q' and raw_len > 10) or tag = 'blockquote')"),
    "C_33.0": ("error", "tag = 'blink' and raw_len >= 0"),
    "C_33.1": ("error", r"attrs['style'] rlike '(?is)text-decoration(\\s)*:[^;]*blink'", "concat('style=\"', attrs['style'], '\"')"),
    "C_34.0": ("error", "tag = 'marquee'"),
    "C_36.0": ("error", f"{REFRESH} and not lower(coalesce(attrs['content'], '')) like '%url%'"),
    "C_36.1": ("error", rf"{REFRESH} and lower(attrs['content']) like '%url%' and try_cast(regexp_extract(attrs['content'], '^([0-9]+);', 1) as decimal(38)) > 0"),
    "C_51.0": ("error", "tag = 'frame' and attrs['title'] is null"),
    "C_51.1": ("error", "tag = 'iframe' and attrs['title'] is null", "concat(': src=', coalesce(attrs['src'], ''))"),
    "C_51.4": ("error", f"tag = 'frame' and attrs['title'] {BLANK}"),
    "C_51.5": ("error", f"tag = 'iframe' and attrs['title'] {BLANK}", "concat(': src=', coalesce(attrs['src'], ''))"),
    "C_57.3": ("error", f"{LINK} and attrs['title'] {BLANK}"),
    "C_6.0": ("error", f"leaf and {_art('text')}"),
    "C_33.2": ("warning", r"style rlike '(?is)\\{[^}]*text-decoration(\\s)*:[^;]*blink.*\\}'"),
    "C_6.1": ("warning", f"leaf and {_art('text')}"),
    "C_48.8": ("warning", "is_html5 and ((tag = 'img' and attrs['longdesc'] is not null) or (tag = 'table' and attrs['summary'] is not null))", "if(tag = 'img', 'longdesc', 'summary')"),
    "C_80.0": ("warning", "(in_body or tag = 'body') and length(attrs['alt']) > 150"),
    "C_3.1": ("user", "tag = 'img' and attrs['longdesc'] is not null and not is_html5"),
    "C_17.0": ("info", "tag in ('q', 'blockquote') and raw_len < 0"),
    "C_18.0": ("user", "tag = 'q' and raw_len > 10"),
    "C_18.1": ("user", "tag = 'blockquote' and raw_len <= 10"),
    "C_26.0": ("user", "tag = 'th' and length(text) > 30"),
    "C_51.2": ("user", f"tag = 'frame' and {TITLED}", "attrs['title']"),
    "C_51.3": ("user", f"tag = 'iframe' and {TITLED}", "attrs['title']"),
    "C_52.0": ("info", "tag = 'frame' and attrs['title'] <> '' and coalesce(attrs['longdesc'], '') = ''"),
    "C_52.1": ("info", "tag = 'iframe' and attrs['title'] <> '' and coalesce(attrs['longdesc'], '') = ''"),
    "C_57.1": ("user", f"{SHORT} and attrs['title'] <> '' and {_words(TITLE)} < 3 and length(attrs['title']) < 20", f"concat(' (link text=\"', {LINK_TEXT}, '\", title=\"', attrs['title'], '\", href=\"', attrs['href'], '\")')"),
    "C_57.4": ("user", f"{LINK} and {TITLED}", "attrs['title']"),
    "C_69.0": ("user", f"leaf and {_art('text')}"),
    "C_500.17": ("user", f"(attrs['style'] {COLOR} and not attrs['style'] {BACK}) or style {IN_COLOR}", _STYLE_EXTRA),
    "C_500.18": ("user", f"(attrs['style'] {BACK} and not attrs['style'] {COLOR}) or style {IN_BACK}", _STYLE_EXTRA),
    "C_500.19": ("user", f"style {IN_FIXED}"),
    "C_500.20": ("user", f"attrs['style'] {FIXED}", "concat('(style属性, ', attrs['style'], ')')"),
    "C_500.21": ("user", f"attrs['style'] {VIEW} or style {IN_VIEW}", _STYLE_EXTRA),
}
#: One problem per page with all its elements.
PAGE = {
    "C_85.0": ("error", "tag in ('audio', 'video') and lower(attrs['autoplay']) <> 'false'"),
    "C_4.0": ("user", rf"tag = 'img' and {NORMAL} and ({_words(ALT)} >= 3 or length(attrs['alt']) >= 20) and (attrs['alt'] rlike '[^\\x00-\\x7f]' or length(attrs['alt']) > 30)"),
    "C_8.0": ("user", "tag = 'font' and (coalesce(attrs['color'], '') <> '' or coalesce(attrs['bgcolor'], '') <> '')"),
    "C_15.0": ("user", "tag in ('h1', 'h2', 'h3', 'h4', 'h5', 'h6')"),
    "C_17.1": ("user", "tag = 'blockquote'"),
    "C_30.0": ("user", "tag in ('object', 'embed', 'applet')"),
    "C_30.1": ("user", "tag in ('object', 'embed', 'applet')"),
    "C_35.0": ("user", f"tag = 'img' and {NORMAL} and {_extension(SRC)} = 'gif'"),
    "C_57.0": ("info", f"{UNTITLED} and {_trimmed(LINK_TEXT)} <> ''"),
    "C_300.5": ("user", "tag = 'canvas'"),
    "C_388.0": ("user", "tag = 'form'"),
}
#: One problem per page, without elements.
BARE = {
    "C_32.0": ("user", "tag in ('object', 'applet')"),
    "C_86.0": ("info", f"(tag = 'object' and {_extension(DATA)} in {MEDIA}) or (tag = 'param' and parent_tag = 'applet' and {_extension(VALUE)} in {MEDIA}) or (tag = 'a' and {_extension(HREF)} in {MEDIA})"),
}
#: One problem per page and tag, which is the extra text.
TAG = {
    "C_13.0": ("warning", "(tag = 'font' and attrs['size'] <> '' and not attrs['size'] rlike '[+-]') or (tag in ('table', 'tr', 'td', 'col') and ((attrs['width'] <> '' and not attrs['width'] like '%\\%%') or (attrs['height'] <> '' and not attrs['height'] like '%\\%%')))"),
    "C_48.0": ("warning", "tag = 'menuitem' or (is_html5 and tag in ('frame', 'frameset', 'noframes'))"),
    "C_48.1": ("warning", "tag = 'applet'"),
    "C_48.2": ("warning", "tag in ('basefont', 'center', 'font', 'strike', 'u') or (not is_html5 and tag = 's') or (is_html5 and tag in ('big', 'tt'))"),
    "C_48.3": ("warning", "tag = 'dir' or (tag = 'menu' and not is_html5)"),
    "C_48.4": ("warning", "tag = 'isindex'"),
    "C_48.5": ("warning", "tag in ('listing', 'plaintext', 'xmp')"),
    "C_48.6": ("user", "tag in ('b', 'i') and not is_html5"),
    "C_48.7": ("warning", "tag = 'acronym' and is_html5"),
}
#: Checklist items of a page.
ALWAYS = ["C_19.0", "C_20.0", "C_55.0", "C_56.1", "C_67.0", "C_71.0", "C_81.0", "C_83.0", "C_500.2", "C_500.6", "C_500.11", "C_500.12", "C_600.0", "C_600.8", "C_600.9", "C_600.10", "C_600.14", "C_600.17", "C_600.19"]
#: Of these, the items that only pages with links get.
ALWAYS_LINKS = ["C_56.1", "C_81.0"]
OUT = ["page_id", "check_id", "type", "nodes", "pres", "extra_text"]


def _none():
    return F.array().cast("array<string>"), F.array().cast("array<int>")


def _out(df: DataFrame, check: str, severity: str, nodes=None, pres=None, extra=None) -> DataFrame:
    return df.select(
        "page_id", F.lit(check).alias("check_id"), F.lit(severity).alias("type"), (F.array("path") if nodes is None else nodes).alias("nodes"),
        (F.array("pre") if pres is None else pres).alias("pres"), (F.lit("") if extra is None else extra.cast("string")).alias("extra_text"))


def _bare(df: DataFrame, check: str, severity: str, extra=None) -> DataFrame:
    return _out(df, check, severity, *_none(), extra)


def _grouped(df: DataFrame, keys: list[str], check: str, severity: str, extra=None) -> DataFrame:
    hit = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pre", "path"))).alias("hit"), *([] if extra is None else [extra.alias("extra")]))
    return _out(hit, check, severity, F.col("hit.path"), F.col("hit.pre"), None if extra is None else F.col("extra"))


def _heading_jump(e, c, s, nodes):
    h = e.where("tag rlike '^h[1-6]$'").withColumn("level", F.substring("tag", 2, 1).cast("int"))
    w = Window.partitionBy("page_id").orderBy("pre")
    h = h.withColumns({"was": F.lag("level").over(w), "was_path": F.lag("path").over(w), "was_pre": F.lag("pre").over(w)}).where("level - was > 1")
    extra = F.concat(F.lit(" (H"), "level", F.lit("タグの1階層上がH"), "was", F.lit("タグです)"))
    return _out(h, c, s, F.array("was_path", "path"), F.array("was_pre", "pre"), extra)


def _longdesc(e, c, s, nodes):
    links = e.where(LINK).where(f"lower({_trimmed('text')}) = 'd'").select("page_id", F.expr("lower(attrs['href'])").alias("url"))
    img = e.where("tag = 'img' and attrs['longdesc'] <> '' and not is_html5").withColumn("url", F.expr("lower(attrs['longdesc'])"))
    return _out(img.join(links, ["page_id", "url"], "left_anti"), c, s)


def _area_anti(e, c, s, nodes):
    links = e.where(LINK).select("page_id", F.expr("lower(attrs['href'])").alias("url")).where("url <> ''").distinct()
    area = e.where("tag = 'area'").withColumn("href", F.expr("coalesce(attrs['href'], '')")).withColumn("url", F.lower("href"))
    return _bare(area.join(links, ["page_id", "url"], "left_anti"), c, s, F.concat(F.lit(' (href="'), "href", F.lit('")')))


def _empty_links(e, beside: bool):
    w = Window.partitionBy("page_id").orderBy("pre")
    a = e.where(LINK).withColumn("href", F.expr("attrs['href']"))
    same = lambda at: F.coalesce((at("href").over(w) == F.col("href")) & (F.length(at("text").over(w)) > 0), F.lit(False))
    a = a.withColumn("beside", same(F.lag) | same(F.lead)).where(EMPTY).where("kids > 0 and not noscript")
    return a.where("beside" if beside else "not beside")


_HREF = "concat(' (href=\"', href, '\")')"


def _childless_links(e, c, s, nodes):
    a = e.where(EMPTY).where("kids = 0").withColumn("href", F.expr("attrs['href']"))
    return _grouped(a, ["page_id", "href"], c, s, F.first("href"))


def _same_text(e, c, s, nodes):
    """A text's first link with those of other targets."""
    a = e.where(LINK).where("text <> ''").withColumn("url", F.expr("lower(attrs['href'])"))
    first = a.groupBy("page_id", "text").agg(F.min(F.struct("pre", "url", "path")).alias("f"))
    others = a.join(first, ["page_id", "text"]).where("url <> f.url")
    hit = others.groupBy("page_id", "text").agg(F.array_sort(F.collect_list(F.struct("pre", "path"))).alias("hit"), F.first("f").alias("f"))
    extra = F.concat(F.lit(' (link text="'), "text", F.lit('")'))
    return _out(hit, c, s, F.concat(F.array("f.path"), F.col("hit.path")), F.concat(F.array("f.pre"), F.col("hit.pre")), extra)


def _adjacent_links(e, c, s, nodes):
    """Links with nothing but breaks, paragraphs and white space up to links elsewhere."""
    w = Window.partitionBy("page_id", "parent").orderBy("sibling")
    kind = F.expr("case when tag = 'a' then 1 when node_type = 3 and blank or tag in ('br', 'p') then 0 else 2 end")
    run = nodes.where("parent is not null").withColumn("kind", kind).withColumn("run", F.sum(F.expr("int(kind = 2)")).over(w)).where("kind = 1")
    link = F.struct("pre", "path", F.expr("coalesce(attrs['href'], '')").alias("url"), F.expr("attrs['href'] is not null").alias("linked"))
    runs = run.groupBy("page_id", "parent", "run").agg(F.array_sort(F.collect_list(link)).alias("links")).where("size(links) > 1")
    one = "struct<pre:int,path:string,url:string,linked:boolean>"
    start = F.expr(f"named_struct('from', cast(null as {one}), 'to', cast(null as {one}), 'out', cast(array() as array<struct<a:{one},b:{one}>>))")
    done = lambda acc: F.when(acc["to"].isNotNull(), F.concat(acc["out"], F.array(F.struct(acc["from"].alias("a"), acc["to"].alias("b"))))).otherwise(acc["out"])
    nothing = F.lit(None).cast(one)

    def step(acc, x):
        fresh = F.struct(F.when(x["linked"], x).otherwise(nothing).alias("from"), nothing.alias("to"), done(acc).alias("out"))
        more = F.struct(acc["from"].alias("from"), x.alias("to"), acc["out"].alias("out"))
        return F.when(acc["from"].isNull() | (acc["from"]["url"] == x["url"]), fresh).otherwise(more)

    hit = runs.select("page_id", F.explode(F.aggregate("links", start, step, done)).alias("p"))
    return _out(hit, c, s, F.array("p.a.path", "p.b.path"), F.array("p.a.pre", "p.b.pre"))


def _mouse(e, c, s, nodes):
    has = lambda *names: "(" + " or ".join(f"attrs['{n}'] is not null" for n in names) + ")"
    button, focus = has("onclick", "ondblclick", "onmouseup", "onmousedown"), has("onmouseover", "onmouseout", "onmousemove")
    kind = f"case when {button} then if({has('onkeydown', 'onkeypress', 'onkeyup')}, null, 'button') when {focus} and not {has('onfocus', 'onblur', 'onselect')} then 'focus' end"
    seen = e.withColumn("kind", F.expr(kind)).where("kind is not null")
    return _out(_grouped(seen, ["page_id", "kind"], c, s), c, s, F.col("nodes"), F.col("pres"))


def _item_without_list(e, c, s, nodes):
    """Runs of list items outside lists, which any other node ends, as their ends."""
    w = Window.partitionBy("page_id", "parent").orderBy("sibling")
    li = e.where("tag = 'li' and list_pre is null").withColumn("run", F.col("sibling") - F.row_number().over(w))
    ends = li.groupBy("page_id", "parent", "run").agg(F.min(F.struct("pre", "path")).alias("a"), F.max(F.struct("pre", "path")).alias("b"))
    return _out(ends, c, s, F.array("a.path", "b.path"), F.array("a.pre", "b.pre"))


def _area_alt(e, c, s, nodes):
    """Useless texts of an image map's areas, once for each image with the map."""
    area = e.where("tag = 'area' and parent_tag = 'map' and attrs['alt'] is not null").withColumn("alt", F.expr("attrs['alt']"))
    area = area.withColumn("found", F.expr(alt_problem("alt", "'area'"))).where("not found in ('OK', 'SPACE_SEPARATED', 'SPACE_SEPARATED_JP') and not (found = 'BLANK' and attrs['href'] is null)")
    maps = e.where("tag = 'map'").select("page_id", F.col("pre").alias("parent"), F.expr("concat('#', coalesce(attrs['name'], ''))").alias("usemap"))
    images = e.where("tag = 'img' and attrs['usemap'] is not null").select("page_id", F.expr("attrs['usemap']").alias("usemap"))
    return _out(area.join(maps, ["page_id", "parent"]).join(images, ["page_id", "usemap"]), c, s, extra=F.col("alt"))


def table_profile(e: DataFrame) -> DataFrame:
    """One row per table: cells, rows, header cells, spans, own caption and class (parent,
    1x1, data or layout)."""
    own = e.where("tag in ('td', 'th', 'caption') and table_pre is not null")
    span = " or ".join(f"{_number(a)} > 1" for a in ("rowspan", "colspan"))
    is_cell = "tag in ('td', 'th')"
    agg = own.groupBy("page_id", F.col("table_pre").alias("pre")).agg(
        F.count(F.expr("if(tag = 'td', 1, null)")).alias("td"), F.count(F.expr("if(tag = 'th', 1, null)")).alias("th"), F.count(F.expr("if(tag = 'caption', 1, null)")).alias("own_captions"),
        F.count(F.expr(f"if({is_cell} and (length(text) > 250 or imgs > 10), 1, null)")).alias("large"), F.count(F.expr(f"if({is_cell} and ({span}), 1, null)")).alias("spans"),
        F.count(F.expr("if(tag = 'td' and attrs['headers'] is not null, 1, null)")).alias("with_headers"))
    rows = e.where("tag = 'tr' and table_pre is not null").select("page_id", "pre", "table_pre")
    cells = e.where(f"{is_cell} and row_pre is not null").groupBy("page_id", F.col("row_pre").alias("pre")).agg(F.count(F.lit(1)).alias("n"))
    shape = rows.join(cells, ["page_id", "pre"], "left").groupBy("page_id", F.col("table_pre").alias("pre")).agg(F.count(F.lit(1)).alias("tr"), F.max(F.coalesce("n", F.lit(0))).alias("widest"))
    t = e.where("tag = 'table'").join(agg, ["page_id", "pre"], "left").join(shape, ["page_id", "pre"], "left")
    t = t.fillna(0, ["td", "th", "own_captions", "large", "spans", "with_headers", "tr", "widest"])
    kind = F.expr("case when tables > 0 then 'parent' when tr <= 1 or widest <= 1 then '1x1' when controls = 0 and td > 0 and large = 0 then 'data' else 'layout' end")
    return t.withColumn("kind", kind).withColumn("summary", F.expr("coalesce(attrs['summary'], '')"))


#: Table checks: condition on a profile row, and cardinality.
TABLES = {
    "C_12.0": ("user", "kind = 'parent'", "each"),
    "C_12.1": ("user", "kind = '1x1'", "each"),
    "C_12.2": ("user", "kind = 'layout'", "each"),
    "C_23.0": ("user", "kind = 'parent' and (th > 0 or captions > 0 or summary <> '')", "each"),
    "C_23.1": ("user", "kind = 'data' and (th > 0 or own_captions > 0 or (summary <> '' and not is_html5))", "page"),
    "C_23.2": ("warning", "kind <> 'data' and (th > 0 or own_captions > 0 or summary <> '')", "page"),
    "C_25.1": ("user", f"kind = 'data' and own_captions = 0 and coalesce(name, '') {BLANK}", "page"),
    "C_25.2": ("user", "kind = 'data' and summary = '' and not is_html5", "page"),
    "C_25.3": ("user", "kind = 'data' and own_captions > 0", "page"),
    "C_25.4": ("user", "kind = 'data' and summary <> '' and not is_html5", "page"),
    "C_75.0": ("user", "kind = 'data' and th = 0", "each"),
    "C_76.1": ("user", "kind = 'data' and spans > 0", "page"),
}
_NESTED = "if(tables = 1, ' (入れ子のテーブルが存在しています)', concat(' (', tables, '階層の入れ子のテーブルが存在しています)'))"


def scope_tables(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """Data tables with how their header cells lie: ``simple`` (a row or a column of them),
    ``crossed`` (both, with the corner), ``corner`` (both, without the corner cell)."""
    data = table_profile(e).where("kind = 'data'").select("page_id", F.col("pre").alias("table_pre"), F.col("th").alias("n_th"), "td", "with_headers")
    first = nodes.where("sibling = 0 and parent_tag = 'tr'").select("page_id", F.col("parent").alias("pre"), F.struct(F.col("pre"), "path", "tag", "text", "attrs").alias("first"))
    width = F.expr(r"coalesce(try_cast(regexp_extract(attrs['colspan'], '^\\s*([+-]?[0-9]+)', 1) as int), 1)")
    cells = e.where("tag in ('td', 'th') and row_pre is not null").groupBy("page_id", F.col("row_pre").alias("pre")).agg(F.sum(width).alias("width"), F.count(F.expr("if(tag = 'th', 1, null)")).alias("th"))
    rows = e.where("tag = 'tr'").select("page_id", "pre", "table_pre", "kids").join(data.select("page_id", "table_pre"), ["page_id", "table_pre"]).join(first, ["page_id", "pre"], "left").join(cells, ["page_id", "pre"], "left")
    heads = F.expr(r"coalesce(first.tag = 'th' and coalesce(try_cast(regexp_extract(first.attrs['rowspan'], '^\\s*([+-]?[0-9]+)', 1) as int), 1) < 2, false)")
    top = F.min_by(F.struct("kids", F.coalesce("th", F.lit(0)).alias("th"), "first"), "pre")
    t = rows.groupBy("page_id", "table_pre").agg(F.count(F.lit(1)).alias("tr"), F.max(F.coalesce("width", F.lit(0))).alias("widest"), F.sum(F.when(heads, 0).otherwise(1)).alias("unheaded"), F.min_by(heads, "pre").alias("top_head"), top.alias("top"))
    t = t.join(data, ["page_id", "table_pre"]).withColumn("row", F.expr("top.th = top.kids and top.kids = widest")).withColumn("column", F.expr("unheaded = 0"))
    t = t.withColumn("corner", F.expr("top.th <> top.kids and top.th + 1 = top.kids and coalesce(top.first.tag = 'td', false) and unheaded - int(not top_head) = 0 and top.kids = widest and top.kids + tr - 2 = n_th"))
    t = t.withColumn("crossed", F.expr("row and column and tr + top.kids - 1 = n_th")).withColumn("simple", F.expr("(row and top.kids = n_th) or (column and tr = n_th)"))
    return t


def _scope_missing(e, c, s, nodes):
    t = scope_tables(e, nodes).where("with_headers <> td")
    th = e.where("tag = 'th' and attrs['scope'] is null").select("page_id", "table_pre", "pre", "path").join(t.where("not simple and not corner and not crossed"), ["page_id", "table_pre"]).select("page_id", "table_pre", "pre", "path")
    top = t.where("crossed and top.first.tag is not null and top.first.attrs['scope'] is null").select("page_id", "table_pre", "top.first.pre", "top.first.path")
    return _grouped(th.unionByName(top), ["page_id", "table_pre"], c, s)


def _scope_invalid(e, c, s, nodes):
    data = table_profile(e).where("kind = 'data'").select("page_id", F.col("pre").alias("table_pre"))
    th = e.where("tag = 'th' and attrs['scope'] is not null and not attrs['scope'] in ('row', 'col', 'rowgroup', 'colgroup')")
    return _grouped(th.join(data, ["page_id", "table_pre"], "left_semi"), ["page_id"], c, s)


def _corner_text(e, c, s, nodes):
    t = scope_tables(e, nodes).where(f"corner and not top.first.text {BLANK}")
    return _out(t, c, s, F.array("top.first.path"), F.array("top.first.pre"))


def _headers(e):
    data = table_profile(e).where("kind = 'data'").groupBy("page_id").agg(F.count(F.lit(1)).alias("n_data"))
    refs = e.where("tag in ('td', 'th') and attrs['headers'] is not null").select("page_id", "pre", "path", F.explode(F.filter(F.split(F.col("attrs")["headers"], r"[ \t]+"), lambda x: x != "")).alias("ref"))
    ids = e.where("attrs['id'] is not null").groupBy("page_id", F.col("attrs")["id"].alias("ref")).agg(F.min_by("tag", "pre").alias("ref_tag"))
    # Each problem repeats once per data table of the page.
    return refs.join(data, "page_id").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_data").cast("int")))), ids


def _headers_missing(e, c, s, nodes):
    refs, ids = _headers(e)
    return _out(refs.join(ids, ["page_id", "ref"], "left_anti"), c, s, extra=F.concat(F.lit("(id="), "ref", F.lit(")")))


def _headers_other(e, c, s, nodes):
    refs, ids = _headers(e)
    return _out(refs.join(ids.where("not ref_tag in ('td', 'th')"), ["page_id", "ref"]), c, s, extra=F.col("ref_tag"))


def _repeated(e, c, s, attr, where="true"):
    a = e.where(f"attrs['{attr}'] is not null and {where}").withColumn("value", F.col("attrs")[attr])
    many = a.groupBy("page_id", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("page_id", "value")
    value = F.when((F.first("value") == "") & F.lit(attr == "id"), F.lit('id=""')).otherwise(F.first("value"))
    return _grouped(a.join(many, ["page_id", "value"]), ["page_id", "value"], c, s, value)


def _body_text(e, c, s, low, high, img=None):
    body = e.where(f"tag = 'body' and length(text) between {low} and {high}")
    return _bare(body if img is None else body.where(f"imgs {'>' if img else '='} 0"), c, s)


#: id: (severity, plan(elements, id, severity, nodes)).
PLANS: dict[str, tuple[str, Callable]] = {
    "C_3.0": ("error", _longdesc), "C_14.0": ("error", _heading_jump), "C_331.0": ("error", _scope_missing), "C_331.1": ("error", _scope_invalid), "C_332.1": ("error", _headers_missing), "C_332.2": ("error", _headers_other),
    "C_57.2": ("error", lambda e, c, s, n: _out(_empty_links(e, False), c, s, extra=F.expr(_HREF))), "C_57.5": ("user", lambda e, c, s, n: _out(_empty_links(e, True), c, s, extra=F.expr(_HREF))), "C_57.6": ("user", _childless_links),
    "C_7.0": ("user", _area_anti), "C_58.0": ("user", _same_text), "C_38.0": ("warning", _mouse), "C_46.0": ("warning", _adjacent_links), "C_300.1": ("warning", _area_alt), "C_331.2": ("warning", _corner_text),
    "C_16.1": ("user", lambda e, c, s, n: _out(e.where("tag in ('ul', 'ol') and items = 0"), c, s)), "C_16.2": ("user", _item_without_list),
    "C_422.0": ("error", lambda e, c, s, n: _repeated(e, c, s, "accesskey")), "C_423.0": ("error", lambda e, c, s, n: _repeated(e, c, s, "id", "parent_tag = 'body'")),
    "C_89.0": ("error", lambda e, c, s, n: _body_text(e, c, s, 0, 0)), "C_89.1": ("user", lambda e, c, s, n: _body_text(e, c, s, 1, 49, True)), "C_89.2": ("warning", lambda e, c, s, n: _body_text(e, c, s, 1, 49, False)),
}
ALL_IDS = [*EACH, *PAGE, *BARE, *TAG, *TABLES, *PLANS, *ALWAYS]


def _hits(e: DataFrame, checks: dict) -> DataFrame:
    """Elements with the checks that they meet, in one pass over the nodes."""
    met = F.array_compact(F.array(*[F.when(F.expr(cond), F.struct(F.lit(c).alias("check_id"), F.lit(s).alias("type"), F.expr(f"string({extra[0] if extra else chr(39) * 2})").alias("extra"))) for c, (s, cond, *extra) in checks.items()]))
    return e.select("page_id", "pre", "path", "tag", F.explode(met).alias("m")).select("page_id", "pre", "path", "tag", "m.*")


def run_checks(nodes: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """Problems of the chosen checks (all if None) over ``nodes`` of ``parse_pages``. Every
    page has a node, an empty one too. Pages of equal page_id are taken for one."""
    want = lambda d: {k: v for k, v in d.items() if ids is None or k in ids}
    e = nodes.where("node_type = 1")
    parts = []
    if each := want(EACH):
        parts.append(_hits(e, each).select("page_id", "check_id", "type", F.array("path").alias("nodes"), F.array("pre").alias("pres"), F.col("extra").alias("extra_text")))
    for group, keys in ((PAGE, []), (TAG, ["tag"]), (BARE, [])):
        if some := want(group):
            hit = _hits(e, some).groupBy("page_id", "check_id", "type", *keys).agg(F.array_sort(F.collect_list(F.struct("pre", "path"))).alias("hit"))
            own = _none() if group is BARE else (F.col("hit.path"), F.col("hit.pre"))
            extra = F.expr("if(check_id = 'C_13.0', '', tag)") if keys else F.lit("")
            parts.append(hit.select("page_id", "check_id", "type", own[0].alias("nodes"), own[1].alias("pres"), extra.alias("extra_text")))
    if tables := want(TABLES):
        met = F.array_compact(F.array(*[F.when(F.expr(cond), F.struct(F.lit(c).alias("check_id"), F.lit(s).alias("type"), F.lit(how).alias("how"))) for c, (s, cond, how) in tables.items()]))
        hit = table_profile(e).select("page_id", "pre", "path", "tables", F.explode(met).alias("m")).select("page_id", "pre", "path", "tables", "m.*")
        # Tables of a page in one problem, or each in its own.
        own = hit.groupBy("page_id", "check_id", "type", F.expr("if(how = 'each', pre, -1)").alias("of")).agg(F.array_sort(F.collect_list(F.struct("pre", "path"))).alias("hit"), F.max("tables").alias("tables"))
        parts.append(own.select("page_id", "check_id", "type", F.col("hit.path").alias("nodes"), F.col("hit.pre").alias("pres"), F.expr(f"if(check_id = 'C_12.0', {_NESTED}, '')").alias("extra_text")))
    parts += [plan(e, c, s, nodes) for c, (s, plan) in want(PLANS).items()]
    if ids is None or set(ids) & set(ALWAYS):
        parts.append(checklist(nodes).where(F.col("check_id").isin(ALWAYS if ids is None else ids)))
    if not parts:
        raise ValueError(f"no such checks: {ids}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(OUT)


def checklist(nodes: DataFrame) -> DataFrame:
    """The items that every page gets, or every page with links; they have no nodes."""
    seen = nodes.groupBy("page_id").agg(F.max(F.coalesce(F.expr(LINK), F.lit(False))).alias("links"))
    items = seen.select("page_id", "links", F.explode(F.array(*map(F.lit, ALWAYS))).alias("check_id")).where(F.col("links") | ~F.col("check_id").isin(ALWAYS_LINKS))
    return items.select("page_id", "check_id", F.lit("info").alias("type"), _none()[0].alias("nodes"), _none()[1].alias("pres"), F.lit("").alias("extra_text"))


def check_summary(problems: DataFrame) -> DataFrame:
    return problems.groupBy("check_id", "type").agg(F.count(F.lit(1)).alias("problems"), F.count_distinct("page_id").alias("pages"), F.sum(F.size("nodes")).cast("long").alias("nodes"))
