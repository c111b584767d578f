"""Repair candidates over the node table.

Detectors of one element are conditions tried in one scan. Detectors that look at
neighbours are windows or aggregations on page keys, so no plan compares two nodes by
range. Candidates are numbered per page in collector order, notices apart from fixes.

Columns: page_id, pre, path, rule_id, message, patch_type, patch_name, patch_value,
before, confidence, human_review, review_type (fix or notice), candidate_id.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions import text as rules

# Rules whose candidates are notices.
NOTICES = [
    "image.multiple-images", "image.image-text-layout", "image.display-width", "image.showcase-section", "image.heritage-image", "image.linked-image", "link.internal-link", "link.external-link", "link.category-link",
    "link.cross-page-anchor", "link.in-page-anchor", "link.link-broken", "file.external-pdf", "iframe.cms-review", "iframe.frame-unsupported", "text.bold", "text.meaningless-symbol",
]
# Vocabularies and patterns.
LABELS = "^(担当課|担当部署|届出期間|受付期間|受付窓口|申請方法|対象者|対象|問い合わせ|問合せ|お問い合わせ|お問合せ|提出先|必要書類)$"
GENERIC_LINK = "(?i)^(こちら|ここ|詳細はこちら|詳しくはこちら|クリック|click here)$"
GENERIC_ALT = "^(画像|写真|イメージ|image|photo)$|^(.*の)?写真$"
GENERIC_FRAME = "(?i)^(iframe|埋め込み|埋め込みコンテンツ|動画|地図|map|movie)$"
GENERIC_CAPTION = "(?i)^(?:表[0-9０-９]*|図表|一覧|表組|データ|テーブル|table)$"
COMPLEX = "(?i)(地図|案内図|図表|グラフ|チャート|フローチャート|組織図|路線図|配置図|模式図|チラシ|ポスター|バナー|map|chart|graph|flyer|poster|banner)"
POSITION = "右側の|右の|左側の|左の|上記の|下記の|上の図|下の図|上の画像|下の画像|上のボタン|下のボタン|上のリンク|下のリンク"
ARROWS, ORNAMENTS = "[→↓↑←⇔⇒⇨]", "[○●◎□■◇◆☆★]"
FILE_TYPE = r"(?:PDF|Word|Excel|PowerPoint|ZIP|CSV|XLSX?|DOCX?|PPTX?|ワード|エクセル|パワーポイント)(?:\s*(?:ファイル|文書|形式))?(?:\s*(?:XLSX?|DOCX?|PPTX?))?"
FILE_SIZE = r"[\d,.]+(?:\.\d+)?\s*(?:KB|MB|GB|kbyte|mbyte|gbyte|キロバイト|メガバイト|ギガバイト)"
DECORATION = ["u", "s", "strike", "i", "center", "big", "tt"]
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
SCOPES = "^(row|col|rowgroup|colgroup)$"
NO_BASE = "https://example.invalid/"

#: Collectors in the order in which candidates are numbered.
ORDER = ["heading", "heading_text", "heading_quality", "heading_link", "table", "image", "image_group", "link", "iframe", "style", "decoration", "bold", "numbered", "text", "list", "refresh", "duplicate", "frame", "deprecated", "empty_link", "same_text"]
#: Elements whose own texts detectors read; those of others need not be kept.
TEXTS_OF = frozenset(["a", "p", "div", "figure", "caption", "figcaption", "blink", *HEADINGS])
FIELDS = ["rule_id", "message", "patch_type", "patch_name", "patch_value", "before", "confidence", "human_review", "collector", "step"]
KEY = ["page_id", "pre", "path"]


class Detector(NamedTuple):
    """Fires on an element where ``when`` holds; a string where a Column may be is a literal."""

    collector: str
    rule_id: str
    when: Column
    message: object
    patch: str = "none"
    name: object = None
    value: object = None
    confidence: object = "low"
    human: bool = True
    before: object = None

    def struct(self, step: int) -> Column:
        lit = lambda v: v if isinstance(v, Column) else F.lit(v).cast("string")
        cols = [lit(v) for v in (self.rule_id, self.message, self.patch, self.name, self.value, self.before, self.confidence)] + [F.lit(self.human), F.lit(ORDER.index(self.collector)), F.lit(step)]
        return F.when(F.coalesce(self.when, F.lit(False)), F.struct(*[c.alias(n) for c, n in zip(cols, FIELDS)]))


def tag() -> Column:
    return F.col("tag")


def content() -> Column:
    return F.coalesce("content", "text")


def attr(name: str) -> Column:
    return F.col("attrs")[name]


def _blank(c: Column) -> Column:
    return rules.collapse(F.coalesce(c, F.lit(""))) == ""


def _styled(*names: str) -> Column:
    return F.coalesce(attr("style").rlike(rf"(?i)(^|;)\s*({'|'.join(names)})\s*:"), F.lit(False))


def strip_file_note(c: Column) -> Column:
    """A link text without the type and size of its file."""
    left, right = r"(?i)[【［\[(（]\s*", r"\s*[】］\])）]"
    steps = [rf"{left}{FILE_TYPE}\s*[：:]\s*{FILE_SIZE}{right}", f"{left}{FILE_TYPE}{right}", f"{left}{FILE_SIZE}{right}", rf"(?i)\s*{FILE_TYPE}\s*$"]
    return F.trim(reduce(lambda x, p: F.regexp_replace(x, p, ""), steps, c))


def _width() -> Column:
    px = F.regexp_extract(attr("style"), r"(?i)(?:^|;)\s*width\s*:\s*([0-9]+(?:\.[0-9]+)?)px\s*(?:;|$)", 1)
    return F.coalesce(F.regexp_extract(attr("width"), r"^\s*([0-9]+)", 1).try_cast("double"), px.try_cast("double"))


def _element_detectors() -> list[Detector]:
    img, alt, link = tag() == "img", attr("alt"), tag() == "a"
    src = F.coalesce(attr("src"), F.lit(""))
    caption = F.regexp_replace(F.regexp_replace(content(), r"(?i)^[（(]\s*(写真|画像|イメージ)\s*[）)]\s*", ""), r"(?i)^\s*(写真|画像|イメージ)\s*[：:]\s*", "")
    title, frame = rules.collapse(F.coalesce(attr("title"), F.lit(""))), tag().isin("iframe", "frame")
    named = F.when(src.rlike(r"(?i)youtube|youtu\.be|vimeo"), "動画の内容を入力").when(src.rlike("(?i)map|maps|地図"), "地図の内容を入力").otherwise("埋め込みコンテンツの内容を入力")
    href = F.trim(F.coalesce(attr("href"), F.lit("")))
    cleaned = F.when(strip_file_note(content()) != content(), strip_file_note(content())).otherwise(content())
    file_name = F.regexp_extract(href, r"(?i)([^/?]+)\.pdf(?:$|[?#])", 1)
    mail = F.regexp_extract(href, "(?i)^mailto:", 0) != ""
    refresh = (tag() == "meta") & (F.lower(F.trim(attr("http-equiv"))) == "refresh")
    scope = rules.collapse(attr("scope"))
    guess = F.when((F.col("parent_tag") == "tr") & F.coalesce(F.col("prev_tag").isin("td", "th"), F.lit(False)), "col").otherwise("row")
    color, back = _styled("color"), _styled("background", "background-color") | attr("bgcolor").isNotNull()
    symbol = ~content().rlike(r"[\p{L}\p{N}]")
    return [
        Detector("heading_text", "html-structure.heading-required", tag().isin("p", "div") & F.col("cell_pre").isNull() & (F.col("elements") <= 1) & content().rlike(LABELS), "見出しに相当する短い項目名が本文要素のままです。", "rename-element", "h3", confidence="medium"),
        Detector("heading_quality", "html-structure.heading-content-quality", tag().isin(*HEADINGS) & (content() != "") & (symbol | (F.length(content()) <= 2)), F.when(symbol, "見出しのテキストが記号のみで構成されています。").otherwise("見出しのテキストが極端に短くなっています。")),
        Detector("table", "table.th-scope", (tag() == "th") & F.col("table_pre").isNotNull() & attr("scope").isNull(), "th要素にscope属性がありません。", "set-attribute", "scope", guess),
        Detector("table", "table.th-scope", (tag() == "th") & F.col("table_pre").isNotNull() & ~scope.rlike(SCOPES), F.concat(F.lit("th要素のscope属性値「"), scope, F.lit("」が不正です。")), "set-attribute", "scope", guess),
        Detector("table", "table.caption", (tag() == "caption") & content().rlike(GENERIC_CAPTION), "表のキャプションが汎用的で、この表の内容を特定できません。"),
        Detector("image", "image.alt-text", img & _blank(alt), "画像の代替テキストが未設定です。", "set-attribute", "alt", "画像内容を具体的に入力"),
        Detector("image", "image.alt-text", img & rules.collapse(alt).rlike(GENERIC_ALT), "画像の代替テキストが汎用的です。", "set-attribute", "alt", F.concat(F.regexp_replace(alt, "の?写真$", ""), F.lit("の内容を具体的に説明"))),
        Detector("image", "image.caption", (tag() == "figcaption") & (F.trim(caption) != content()), "キャプションに画像分類語が含まれています。", "set-text", None, F.trim(caption), "high", False),
        Detector("image", "text.spaced-characters", img & (F.size(rules.spaced_characters(alt)) > 0), "画像の代替テキストに不要な文字間空白が含まれています。", "set-attribute", "alt", _unspaced(alt), "medium"),
        Detector("image", "image.display-width", img & _width().isNotNull(), "画像の表示幅からCMS画像サイズの確認が必要です。", confidence="medium"),
        Detector("image", "image.complex-image-report", img & F.concat_ws(" ", src, F.coalesce(alt, F.lit(""))).rlike(COMPLEX), "地図・図表など複雑な画像の可能性があります。"),
        Detector("image", "image.complex-image-report", img & (F.length(alt) > 150), "代替テキストが150文字を超えています。"),
        Detector("link", "file.file-display-text", link & (strip_file_note(content()) != content()), "ファイル種別・容量がリンクテキストに含まれています。", "set-text", None, strip_file_note(content()), "high", False),
        Detector("link", "link.link-text", link & cleaned.rlike(GENERIC_LINK), "リンクテキストがリンク先を単独で説明していません。", "set-text", None, F.when(file_name != "", file_name).otherwise("リンク先の内容を具体的に入力"), F.when(file_name != "", "medium").otherwise("low")),
        Detector("link", "link.link-text", link & cleaned.rlike("(?i)^https?://"), "リンクテキストがURLそのものになっています。"),
        Detector("link", "link.link-broken", link & href.isin("", "#"), "リンク先が空、または仮リンクの可能性があります。"),
        Detector("link", "link.link-text", link & href.rlike("(?i)^javascript:"), "javascript: URLが含まれています。", "remove-attribute", "href", None, "high"),
        Detector("link", "link.in-page-anchor", link & href.rlike(r"^#[^#\s]+"), "ページ内アンカーリンクです。"),
        Detector("link", "link.mail-link", link & (mail | content().rlike(r"^[\w.+-]+@[\w-]+(\.[\w-]+)+$")), "メールアドレスがリンク文言に使われています。", "set-text", None, "担当部署へメールを送信"),
        Detector("iframe", "iframe.title", frame & ((title == "") | title.rlike(GENERIC_FRAME)), F.concat(tag(), F.when(title != "", "要素のtitle属性が汎用的です。").otherwise("要素にtitle属性がありません。")), "set-attribute", "title", named),
        Detector("iframe", "iframe.cms-review", frame, F.concat(tag(), F.lit("埋め込みが含まれています。"))),
        Detector("style", "text.background-color", back, F.when(attr("bgcolor").isNotNull(), "背景色の指定(廃止されたbgcolor属性を含む)が含まれています。").otherwise("背景色の指定が含まれています。"), F.when(attr("bgcolor").isNotNull(), "remove-attribute").otherwise("remove-style-properties"), F.when(attr("bgcolor").isNotNull(), "bgcolor").otherwise("background,background-color"), None, "high", False),
        Detector("style", "text.font-size", _styled("font-size", "font-family"), "文字サイズまたはフォント指定が含まれています。", "remove-style-properties", "font-size,font-family", None, "high", False),
        Detector("style", "text.decoration-lines", _styled("text-decoration", "font-style"), "下線・打消し線・斜体の指定が含まれています。", "remove-style-properties", "text-decoration,font-style", None, "high", False),
        Detector("style", "text.color", color, "文字色の指定が含まれています。", "remove-style-properties", "color"),
        Detector("style", "text.sensory-characteristics", color & back, "文字色と背景色が同時に指定されています。"),
        Detector("decoration", "html-structure.deprecated-elements", (tag() == "marquee") | ((tag() == "blink") & (content() != "")), F.concat(tag(), F.lit("要素が含まれています。")), "unwrap-element", None, None, "high", False),
        Detector("decoration", "text.font-size", tag().isin("font", "basefont"), F.concat(tag(), F.lit("要素が含まれています。")), "unwrap-element", None, None, "high", False),
        Detector("decoration", "text.decoration-lines", tag().isin(*DECORATION), "装飾用のHTML要素が含まれています。", "unwrap-element", None, None, "high", False),
        Detector("decoration", "text.sensory-characteristics", (tag() == "font") & ~(_blank(attr("color")) & _blank(attr("bgcolor"))), "font要素にcolor/bgcolor属性による配色指定があります。"),
        Detector("bold", "text.bold", tag().isin("b", "strong"), "太字表現が含まれています。", confidence="high", human=False),
        Detector("list", "text.list", (tag() == "li") & ~F.coalesce(F.col("parent_tag").isin("ul", "ol", "menu"), F.lit(False)), "このli要素には親となるul要素もしくはol要素が存在しません。", confidence="medium"),
        Detector("refresh", "html-structure.embedded-script-behavior", refresh, F.when(attr("content").rlike("(?i)url"), "自動転送が含まれています。").otherwise("自動更新が含まれています。"), "remove-element", None, None, "high", False),
        Detector("frame", "iframe.frame-unsupported", tag() == "frame", "frame要素が含まれています。CMS本文には取り込めません。"),
        Detector("deprecated", "html-structure.deprecated-elements", img & attr("longdesc").isNotNull(), "img要素に廃止されたlongdesc属性が使われています。", "remove-attribute", "longdesc", None, "high", False),
        Detector("deprecated", "html-structure.deprecated-elements", (tag() == "table") & attr("summary").isNotNull(), "table要素に廃止されたsummary属性が使われています。", "remove-attribute", "summary", None, "high", False),
        Detector("empty_link", "link.link-purpose-standalone", link & (href != "") & ~href.startswith("#") & (F.col("kids") == 0), "リンク内に要素やテキストが存在しません。", confidence="medium"),
    ]


def _unspaced(c: Column) -> Column:
    return F.aggregate(rules.spaced_characters(c), c, lambda t, run: F.replace(t, run, F.regexp_replace(run, f"{rules.SPACE}+", "")))


def _fired(rows: DataFrame, detectors: list[Detector]) -> DataFrame:
    """All detectors in one scan; ``step`` is a detector's place in its list."""
    hits = F.filter(F.array(*[d.struct(i) for i, d in enumerate(detectors)]), lambda x: x.isNotNull())
    return _each(rows.select(*KEY, hits.alias("c")))


def _each(rows: DataFrame) -> DataFrame:
    """One row for each struct in ``c``, a column of its own: detectors in a projection take
    half the time of detectors inside an explode, into which an inner one would be folded."""
    return rows.select(*KEY, F.explode_outer("c").alias("c")).where("c is not null").select(*KEY, "c.*")


def element_candidates(nodes: DataFrame) -> DataFrame:
    return _fired(nodes.where("node_type = 1"), _element_detectors())


def heading_candidates(nodes: DataFrame) -> DataFrame:
    """Levels against the level before as it will be after repair.

    That level is least(own, before + 1) from 1 on, so it is a running minimum of
    ``level - place`` and needs no fold."""
    w = Window.partitionBy("page_id").orderBy("pre")
    h = nodes.where(tag().isin(*HEADINGS)).withColumn("level", F.substring("tag", 2, 1).cast("int")).withColumn("n", F.row_number().over(w))
    own = F.greatest("level", F.lit(2))
    h = h.withColumn("after", F.col("n") + F.least(F.lit(1), F.min(own - F.col("n")).over(w)))
    h = h.withColumn("was", F.coalesce(F.lag("after").over(w), F.lit(1)))
    to = F.concat(F.lit("h"), F.col("after").cast("string"))
    skip = F.concat(F.lit("見出しレベルがh"), F.col("was").cast("string"), F.lit("相当からh"), F.col("level").cast("string"), F.lit("へスキップしています。"))
    return _fired(h, [
        Detector("heading", "html-structure.heading-order", F.col("level") == 1, "コンテンツ領域にh1が含まれています。", "rename-element", "h2", None, "high", False),
        Detector("heading", "html-structure.heading-order", (F.col("level") > 1) & (F.col("level") > F.col("was") + 1), skip, "rename-element", to, None, "medium"),
    ])


def _resolved(href: Column, base: Column) -> dict[str, Column]:
    """Host, path and flags of a link as a browser resolves it against ``base``."""
    host = lambda u: F.lower(F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = lambda u: F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    protocol, double = href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href.startswith("//")
    own = path(href)
    joined = F.when(protocol | double | own.startswith("/"), own).when(own == "", path(base)).otherwise(F.concat(F.regexp_extract(path(base), "^(.*/)", 1), own))
    parts = F.split(F.regexp_replace(joined, r"/\.{1,2}$", "$0/"), "/")
    empty = F.lit([]).cast("array<string>")
    folded = F.aggregate(parts, empty, lambda a, x: F.when(x == "..", F.when(F.size(a) > 1, F.slice(a, 1, F.size(a) - 1)).otherwise(a)).when(x == ".", a).otherwise(F.concat(a, F.array(x))))
    # Only a path with dot segments needs folding.
    plain = F.when(joined.rlike(r"(^|/)\.\.?(/|$)"), F.array_join(folded, "/")).otherwise(joined)
    clean = lambda c: F.regexp_replace(F.regexp_replace(c, r"\A\z", "/"), r"(?i)/index\.(html?|php)$", "/")
    return {"http": href.rlike("(?i)^https?:") | ~protocol, "protocol": protocol, "relative": ~protocol & ~double, "host": F.when(protocol | double, host(href)).otherwise(host(base)), "path": clean(plain), "base_host": host(base), "base_path": clean(path(base))}


def _links(nodes: DataFrame) -> DataFrame:
    return nodes.where(tag() == "a").withColumn("href", F.trim(F.coalesce(attr("href"), F.lit(""))))


def classify_links(nodes: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """``a`` elements with the flags of their targets. ``pages`` (page_id, url) gives the
    pages' own addresses; without it every relative link is internal."""
    a = _links(nodes)
    a = a.join(pages.select("page_id", F.col("url").alias("base")), "page_id", "left") if pages is not None else a.withColumn("base", F.lit(None).cast("string"))
    a = a.withColumn("base", F.coalesce(F.nullif("base", F.lit("")), F.lit(NO_BASE)))
    r = _resolved(F.col("href"), F.col("base"))
    a = a.select("*", *[c.alias(f"_{k}") for k, c in r.items()])
    # Step by step, so that none is worked out once for each flag that reads it.
    a = a.withColumn("_counts", ~F.col("href").rlike(r"(?i)^$|^#[^#\s]+|^mailto:|^javascript:") & F.col("_http")).withColumn("_pdf", F.col("href").rlike(r"(?i)\.pdf(?:$|[?#])"))
    a = a.withColumn("_same", F.col("_counts") & (F.col("_host") == F.col("_base_host")))
    counts, same, pdf = F.col("_counts"), F.col("_same"), F.col("_pdf")
    top = same & (F.col("_path") == "/")
    flags = {
        "is_pdf": pdf, "is_external": counts & (F.col("_host") != F.col("_base_host")), "is_internal_absolute": same & F.col("_protocol"), "is_internal_relative": same & F.col("_relative") & ~pdf,
        "is_in_page": F.col("href").rlike(r"^#[^#\s]+"), "is_cross_page": counts & F.col("href").rlike("#.") & ~(same & (F.col("_path") == F.col("_base_path"))), "is_top": top, "is_category": same & ~top & F.col("_path").endswith("/") & ~pdf,
        "is_broken": F.col("href").isin("", "#"),
    }
    return a.select("*", *[c.alias(k) for k, c in flags.items()]).drop("_counts", "_same", "_pdf", *[f"_{k}" for k in r])


def link_candidates(nodes: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Candidates by target, by neighbours with the same target and by shared texts."""
    a = classify_links(nodes, pages)
    c = F.col
    plain = ~(c("is_top") | c("is_category") | c("is_cross_page"))
    by_target = _fired(a, [
        Detector("link", "link.toppage-link", c("is_top"), "トップページへの内部リンクです。", "set-text", None, "サイト名のトップページ"),
        Detector("link", "link.cross-page-anchor", c("is_cross_page"), "別ページ内の特定箇所へのアンカーリンクです。"),
        Detector("link", "link.category-link", c("is_category"), "カテゴリページへのリンクの可能性があります。"),
        Detector("link", "file.external-pdf", c("is_pdf") & c("is_external"), "外部ドメインのPDFリンクです。", confidence="medium"),
        Detector("link", "link.external-link", ~c("is_pdf") & c("is_external"), "外部ドメインへのリンクです。", confidence="medium"),
        Detector("link", "link.internal-link", ~c("is_external") & (c("is_internal_absolute") | c("is_internal_relative")) & plain, F.when(c("is_internal_absolute"), "同一ドメインの絶対URLリンクです。").otherwise("CMS管理内ページへの相対リンクです。"), confidence="medium"),
    ])
    named = _links(nodes).withColumn("name", rules.collapse(F.concat_ws(" ", "text", attr("aria-label"))))
    w = Window.partitionBy("page_id").orderBy("pre")
    near = lambda f: (f("href").over(w) == c("href")) & (f("name").over(w) != "")
    named = named.where(attr("href").isNotNull()).withColumn("beside", F.coalesce(near(F.lag), F.lit(False)) | F.coalesce(near(F.lead), F.lit(False)))
    silent = (c("name") == "") & (c("kids") > 0)
    neighbours = _fired(named, [
        Detector("link", "link.link-purpose-standalone", silent & c("beside"), "直前または直後に同じリンク先へのリンクがあります。", confidence="medium"),
        Detector("link", "link.link-purpose-standalone", silent & ~c("beside"), "リンク内に読み上げ可能なテキストがありません。", confidence="medium"),
    ])
    first = named.where("name <> '' and href <> ''").groupBy("page_id", "name", "href").agg(F.min(F.struct("pre", "path")).alias("at"))
    place = F.row_number().over(Window.partitionBy("page_id", "name").orderBy("at.pre"))
    later = first.withColumn("place", place).where("place > 1").select("page_id", "at.pre", "at.path", "name")
    same = _fired(later, [Detector("same_text", "link.link-purpose-standalone", F.lit(True), F.concat(F.lit("同じリンクテキスト「"), "name", F.lit("」で異なるリンク先が使われています。")), confidence="medium")])
    real = ~c("is_broken") & (c("is_pdf") | c("is_external") | c("is_internal_absolute") | c("is_internal_relative") | c("is_cross_page") | c("is_top"))
    inner = a.where(real).select("page_id", F.col("parent").alias("pre"), content().alias("inner"))
    lone = nodes.where(tag().isin(*HEADINGS) & (F.col("elements") == 1)).join(inner, ["page_id", "pre"]).where((content() != "") & (content() == F.col("inner")))
    heading = _fired(lone, [Detector("heading_link", "html-structure.heading-link-only", F.lit(True), "見出しの中身がリンク単体になっています。", "unwrap-element", None, None, "high", False)])
    return by_target.unionByName(neighbours).unionByName(same).unionByName(heading)


def duplicate_candidates(nodes: DataFrame) -> DataFrame:
    """Second and later holders of an id or an access key."""
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.trim(attr(k)).alias("v")) for k in ("id", "accesskey")])
    held = nodes.where("node_type = 1 and (attrs['id'] is not null or attrs['accesskey'] is not null)").select(*KEY, F.explode(pairs).alias("p")).select(*KEY, "p.k", "p.v").where("v <> ''")
    w = Window.partitionBy("page_id", "k", "v").orderBy("pre")
    later = held.withColumn("place", F.row_number().over(w)).where("place > 1")
    said = F.concat("k", F.lit("属性の値「"), "v", F.lit("」が他の要素と重複しています。"))
    return _fired(later, [Detector("duplicate", "html-structure.duplicate-id-accesskey", F.lit(True), said, confidence="medium")])


def list_candidates(nodes: DataFrame) -> DataFrame:
    """Lists without an item, and with one. The first item after a list lies in the list
    if any does, so a window finds lists without one."""
    w = Window.partitionBy("page_id").orderBy("pre").rowsBetween(1, Window.unboundedFollowing)
    lists = nodes.where(tag().isin("ul", "ol", "li")).withColumn("next", F.first(F.when(tag() == "li", F.col("pre")), ignorenulls=True).over(w)).where(tag().isin("ul", "ol"))
    items = nodes.where(tag() == "li").groupBy("page_id", F.col("parent").alias("pre")).agg(F.count(F.lit(1)).alias("items"))
    lists = lists.join(items, ["page_id", "pre"], "left").withColumn("none", F.coalesce(F.col("next") > F.col("last"), F.lit(True)))
    return _fired(lists, [
        Detector("list", "text.list", F.col("none"), F.concat(tag(), F.lit("要素にli要素がありません。")), confidence="medium"),
        Detector("list", "text.list", ~F.col("none") & (F.col("items") == 1), "項目が1件だけのリストです。"),
    ])


def table_candidates(nodes: DataFrame) -> DataFrame:
    """``headers`` without a cell of that id in the nearest table."""
    cells = nodes.where("attrs['headers'] is not null and table_pre is not null").select(*KEY, "table_pre", F.explode(F.filter(F.split(attr("headers"), r"\s+"), lambda x: x != "")).alias("id"))
    ids = nodes.where("attrs['id'] is not null and table_pre is not null").groupBy("page_id", "table_pre", attr("id").alias("id")).agg(F.min_by("tag", "pre").alias("found"))
    found = F.col("found")
    missing = F.concat(F.lit("headers属性が参照するid「"), "id", F.lit("」が表内に見つかりません。"))
    other = F.concat(F.lit('headers属性が参照する要素(id="'), "id", F.lit('")がth・td要素ではありません(<'), found, F.lit(">)。"))
    return _fired(cells.join(ids, ["page_id", "table_pre", "id"], "left"), [Detector("table", "table.th-scope", found.isNull(), missing), Detector("table", "table.th-scope", ~found.isin("th", "td"), other)])


def image_group_candidates(nodes: DataFrame) -> DataFrame:
    """Containers with images as children or as children of links that are their children."""
    links = nodes.where(tag() == "a").select("page_id", F.col("pre").alias("parent"), F.col("parent").alias("up"))
    imgs = nodes.where(tag() == "img")
    direct = imgs.where("parent_tag <> 'a'").select("page_id", F.col("parent").alias("pre"))
    linked = imgs.where("parent_tag = 'a'").join(links, ["page_id", "parent"]).select("page_id", F.col("up").alias("pre"))
    count = direct.unionByName(linked).groupBy("page_id", "pre").agg(F.count(F.lit(1)).alias("images"))
    boxes = nodes.where(tag().isin("figure", "p", "div")).join(count, ["page_id", "pre"])
    groups = _fired(boxes, [
        Detector("image_group", "image.multiple-images", F.col("images") >= 2, "複数画像が同じまとまりに並んでいます。", "replace"),
        Detector("image_group", "image.image-text-layout", (F.length(content()) >= 20) & ~F.col("path").rlike("/figure(/|$)"), "画像とテキストが同じまとまりに配置されています。", "replace"),
    ])
    around = nodes.where(tag() == "a").where(content() == "").select("page_id", F.col("pre").alias("link_pre"))
    alone = imgs.where(~_blank(attr("alt")) & ~rules.collapse(attr("alt")).rlike(GENERIC_ALT)).join(around, ["page_id", "link_pre"])
    return groups.unionByName(_fired(alone, [Detector("image", "image.linked-image", F.lit(True), "リンクになっている画像の代替テキストです。")]))


class Repair(NamedTuple):
    """A repair of a run of text."""

    step: int
    rule_id: str
    message: str
    fix: object
    confidence: str
    human: bool

    def struct(self, run: Column) -> Column:
        cols = [F.lit(self.rule_id), F.lit(self.message), F.lit("replace-text"), F.lit(None).cast("string"), self.fix(run), run, F.lit(self.confidence), F.lit(self.human), F.lit(ORDER.index("text")), F.lit(self.step)]
        return F.struct(*[c.alias(n) for c, n in zip(cols, FIELDS)])


def _text_rules() -> list[tuple[str, str, Column, object, str, bool]]:
    """(rule, message, array of found runs, repair of a run, confidence, human review)."""
    t, found = F.col("text"), lambda p: F.regexp_extract_all("text", F.lit(f"({p})"), F.lit(1))
    unit = "|".join(sorted(rules.UNITS, key=len, reverse=True))
    s = rules.SPACE
    return [
        ("text.tel-fax", "TELの略記が含まれています。", found(rf"(?i:TEL|ＴＥＬ){s}*[：:]?"), rules.tel_fax, "medium", True),
        ("text.tel-fax", "FAXの略記が含まれています。", found(rf"(?i:FAX|ＦＡＸ){s}*[：:]?"), rules.tel_fax, "medium", True),
        ("text.spaced-characters", "文字間に不要な空白が含まれています。", rules.spaced_characters(t), lambda c: F.regexp_replace(c, f"{s}+", ""), "medium", True),
        ("text.alphanumeric", "全角英数字が含まれています。", found("[０-９Ａ-Ｚａ-ｚ]+"), rules.half_width, "high", False),
        ("text.currency-notation", "通貨記号が含まれています。", found(rf"[¥￥]{s}*[0-9,]+|\${s}*[0-9,]+"), rules.currency, "high", False),
        ("text.weekday-notation", "省略された曜日表記です。", found(rf"[（(]{s}*[日月火水木金土]{s}*[)）]"), rules.weekday, "medium", True),
        ("text.date-notation", "スラッシュまたはピリオド区切りの日付です。", rules.full_dates(t), rules.date_name, "medium", True),
        ("text.time-notation", "コロン区切りの時刻表記です。", found("(?<![A-Za-z0-9_])(?:[01]?[0-9]|2[0-3]):[0-5][0-9](?![A-Za-z0-9_])"), rules.time_notation, "medium", True),
        ("text.unit-notation", "単位記号または英字略記が含まれています。", found(rf"[0-9]+(?:\.[0-9]+)?{s}*(?i:{unit})(?![A-Za-z])"), rules.units, "high", False),
    ]


def text_candidates(nodes: DataFrame) -> DataFrame:
    """Candidates of text nodes: one for each different run that a rule repairs."""
    t = nodes.where("node_type = 3 and not coalesce(parent_tag, '') in ('script', 'style', 'noscript', 'textarea', 'title')")
    runs = []
    for i, (rule, said, found, fix, confidence, human) in enumerate(_text_rules()):
        runs.append(F.transform(F.array_distinct(found), Repair(i, rule, said, fix, confidence, human).struct))
    repairs = _each(t.select(*KEY, F.concat(*runs).alias("c"))).where("patch_value <> before")
    body = F.col("text")
    arrow, ornament, free = body.rlike(ARROWS), body.rlike(ORNAMENTS), F.col("cell_pre").isNull()
    script = rules.language_script(body)
    seen = _fired(t, [
        Detector("text", "text.foreign-language", script.isin("ko", "th", "ru", "zh", "vi"), F.concat(F.lit("外国語("), script, F.lit("の可能性)の文章または語句が含まれています。"))),
        Detector("text", "text.note-symbol", body.contains("※"), "注釈記号（※）が含まれています。"),
        Detector("text", "text.sensory-characteristics", body.rlike(POSITION), F.concat(F.lit("形や位置だけに依存した案内表現(「"), F.regexp_extract("text", POSITION, 0), F.lit("」)が含まれています。"))),
        Detector("text", "text.meaningless-symbol", free & (arrow | ornament), F.when(arrow & ornament, "矢印記号・装飾記号が含まれています。").when(arrow, "方向を示す矢印記号が含まれています。").otherwise("装飾目的の記号が含まれています。")),
    ])
    return repairs.unionByName(seen.withColumn("step", F.col("step") + len(runs)))


def numbered_candidates(nodes: DataFrame) -> DataFrame:
    """Runs of two or more sibling paragraphs numbered one after the other (islands of
    number minus place); the first paragraph stands for its run."""
    kids = nodes.where("node_type = 1 or trim(text) <> ''")
    w = Window.partitionBy("page_id", "parent").orderBy("pre")
    number = F.translate(F.regexp_extract(content(), r"^[（(]?([0-9０-９]{1,4})[）).．、]", 1), rules.FULL, rules.HALF).try_cast("int")
    p = kids.withColumn("place", F.row_number().over(w)).where("tag = 'p' and item_pre is null and cell_pre is null").withColumn("number", number).where("number is not null")
    island = p.groupBy("page_id", "parent", (F.col("number") - F.col("place")).alias("island")).agg(F.min(F.struct("pre", "path")).alias("at"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    return _fired(island.select("page_id", "at.pre", "at.path"), [Detector("numbered", "text.list", F.lit(True), "番号付き段落による擬似的な順序リストです。", "replace-paragraph-sequence", None, None, "high", False)])


def find_candidates(nodes: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """All candidates, numbered. A page without any has no row; null html has no nodes."""
    parts = [heading_candidates(nodes), table_candidates(nodes), image_group_candidates(nodes), link_candidates(nodes, pages), numbered_candidates(nodes), text_candidates(nodes), list_candidates(nodes), duplicate_candidates(nodes), element_candidates(nodes)]
    every = reduce(DataFrame.unionByName, parts).withColumn("review_type", F.when(F.col("rule_id").isin(NOTICES), "notice").otherwise("fix"))
    w = Window.partitionBy("page_id", "review_type").orderBy("collector", "pre", "step", "rule_id", "message", "before")
    number = F.row_number().over(w).cast("string")
    padded = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    label = F.concat(F.when(F.col("review_type") == "fix", "cand_").otherwise("notice_"), padded)
    return every.withColumn("candidate_id", label).drop("collector", "step")
