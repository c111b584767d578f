"""Main text of web pages: page structure and a suffix array per host.

A tolerant scan of the tags turns a page into blocks, each in one of three zones:
the article (inside ``article`` or ``main``), boilerplate by structure (navigation,
headers and footers outside the article, asides, forms, adverts, notices, comments,
by tag, role or class words) and the rest. The text outside the article of all pages
of a host is laid end to end as one token stream, with a separator of its own after
each page. A suffix array over it (prefix doubling, deep enough for ``RUN`` tokens)
puts equal runs side by side; runs on ``PAGES`` or more distinct pages are template
text, and a block of the rest whose tokens they cover is dropped. Unique runs stay.

The articles of every host are such a stream as well, and the array judges their blocks.
There a run is template text (notices, adverts without a class) if it is in more than half
of the host's distinct articles, ``ARTICLES`` or more in number: fewer share passages that
belong to their text. An article of which such runs cover more than half is one of many
copies and keeps all. On a page that has an article, the rest is not part of it; on others
the array judges the rest.

A host is dealt into groups of about ``GROUP_BYTES`` of text by a hash of the page or article,
each with a suffix array of its own, so no task holds a whole host; the groups' runs, hashed,
are counted over the host, so the result is that of one suffix array, whatever the dealing.
What is in more than half of a host's articles is so in one of its groups, so groups
nominate runs, and nominated ones are counted in all groups. Equal pages count as one.
"""

from __future__ import annotations

import html
import re
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_batches
from .common import materialise, table
from .near_dup import _GOLD, _mix

RUN = 10
PAGES = 3
ARTICLES = 8
COVERED = 0.8
GROUP_BYTES = 8 << 20
ARTICLE, BOILER, REST = 0, 1, 2

_TAG = re.compile(r"""<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|</?[a-zA-Z][^>]*+(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary table tbody td tfoot th thead tr ul".split())
_DROP = frozenset("nav aside form menu search dialog button select template object canvas audio video svg math head".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar rail widget widgets cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe signup login social share sharing "
    "related recommended recommendations pagination pager toolbar comment comments commentlist respond reply replies disqus discussion footer copyright".split()
)
#: Those that hold inside an article as well, where the others may name parts of its text.
_INNER_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsored comment comments commentlist reply replies disqus sidebar cookie newsletter breadcrumb breadcrumbs pagination".split())
_OUTER_WORDS = frozenset("header masthead topbar".split())
#: An open element of the key closes at the start of any of these.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}


def _zone(tag: str, attrs: str, zone: int) -> int:
    """Zone inside this element, given the zone around it."""
    if zone == BOILER or tag in _DROP:
        return BOILER
    if attrs and tag not in ("html", "body"):
        a = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
        words = set(re.split(r"[\s_-]+", f"{a.get('class', '')} {a.get('id', '')}".lower()))
        if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or (tag not in ("main", "article") and a.get("role", "").lower() in _ROLES):
            return BOILER
        if words & {"comment", "comments", "reply", "replies"} or tag not in ("main", "article") and words & (_INNER_WORDS if zone == ARTICLE else _WORDS):
            return BOILER
        if zone != ARTICLE and tag not in ("main", "article") and words & _OUTER_WORDS:
            return BOILER
        if tag == "div" and a.get("role", "").lower() in ("main", "article"):
            return ARTICLE
    if tag in ("article", "main"):
        return ARTICLE
    if tag == "footer" or (tag == "header" and zone != ARTICLE):
        return BOILER
    return zone


def blocks(page: str | None) -> list[tuple[str, int]]:
    """(text, zone) of the blocks of a page in order."""
    page = page or ""
    out: list[tuple[str, int]] = []
    open_: list[tuple[str, int]] = []
    zone, parts, at, n = REST, [], 0, len(page)

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, zone))
            parts.clear()

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            parts.append(page[at:])
            break
        if lt > at:
            parts.append(page[at:lt])
        m = _TAG.match(page, lt)
        if m is None:
            parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            where = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == tag), -1)
            if tag in _BLOCK:
                flush()
            if where >= 0:
                if any(t in _BLOCK for t, _ in open_[where:]) or open_[where][1] != zone:
                    flush()
                zone = open_[where][1]
                del open_[where:]
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in _BLOCK:
            flush()
            for i in range(len(open_) - 1, -1, -1):
                t = open_[i][0]
                if t == "p" or tag in _CLOSES.get(t, ()):
                    zone = open_[i][1]
                    del open_[i:]
                    break
                if t in ("ul", "ol", "dl", "table", "div", "section", "article", "main", "body"):
                    break
        elif tag == "br":
            parts.append(" ")
        if tag in _VOID or m[3].endswith("/") and tag not in _BLOCK:
            continue
        inner = _zone(tag, m[3], zone)
        if inner != zone:
            flush()
        open_.append((tag, zone))
        zone = inner
    flush()
    return out


def parse(pages: DataFrame) -> DataFrame:
    """(key, page_id, url, host, text, texts, rest) of each page: ``text`` of its article,
    empty for a page without text, null if the array is to judge; the blocks outside
    the article, and which of them structure does not call boilerplate."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#]*)", 1))
    page_id = F.col("page_id").cast("long")
    src = pages.select(F.xxhash64(page_id, "url", "html").alias("key"), page_id.alias("page_id"), "url", host.alias("host"), "html")

    def run(batches):
        for big in batches:
            for b in byte_batches(big, "html"):
                text, texts, rest = [], [], []
                for page in b.column("html").to_pylist():
                    found = blocks(page)
                    outside = [(t, z == REST) for t, z in found if z != ARTICLE]
                    judged = len(outside) == len(found) and any(r for _, r in outside)
                    text.append(None if judged else "\n\n".join(t for t, z in found if z == ARTICLE))
                    texts.append([t for t, _ in outside])
                    rest.append([i for i, (_, r) in enumerate(outside) if r])
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c) for c in ("key", "page_id", "url", "host")), pa.array(text, pa.string()), pa.array(texts, pa.list_(pa.string())), pa.array(rest, pa.list_(pa.int32()))],
                    ["key", "page_id", "url", "host", "text", "texts", "rest"])

    return src.mapInArrow(run, "key long, page_id long, url string, host string, text string, texts array<string>, rest array<int>")


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the ``depth`` or more tokens that start there."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    order, have, n = np.argsort(rank, kind="stable"), 1, len(tokens)
    while have < depth and n:
        # As many ranks to a key as fit an integer; 0 is past the end.
        width = int(rank.max() + 1).bit_length()
        key, parts = rank + 1, max(2, 63 // width)
        for k in range(have, have * parts, have):
            key <<= width
            key[: max(0, n - k)] += rank[k:] + 1
        order = np.argsort(key)
        ahead = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(ahead[1:] != ahead[:-1])])
        rank, have = new, have * parts
        if rank.max() == n - 1:
            break
    return order


def runs(tokens: np.ndarray, page: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all runs of ``run`` tokens without a separator (a token below 0), a
    number for each that equal runs share, and on how many pages those numbers occur."""
    n = len(tokens)
    if n < run:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = suffix_array(tokens, run)
    order = order[order + run <= n]
    same = np.ones(len(order) - 1, bool)
    bad = np.zeros(len(order), bool)
    for k in range(run):
        t = tokens[order + k]
        same &= t[1:] == t[:-1]
        bad |= t < 0
    group = np.concatenate([[0], np.cumsum(~same)])
    n_pages = np.int64(page.max() + 1)
    pairs = np.unique(group * n_pages + page[order])
    return order[~bad], group[~bad], np.bincount(pairs // n_pages, minlength=group[-1] + 1)


def covered(n: int, starts: np.ndarray, run: int = RUN) -> np.ndarray:
    """Marks, of ``n`` tokens, those inside the runs that start there."""
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + run, -1)
    return np.cumsum(mark)[:n] > 0


class _Hashes(dict):
    """Hashes of words, each computed once."""

    def __missing__(self, word: str) -> int:
        self[word] = found = xxhash.xxh3_64_intdigest(word) >> 1
        return found


def _stream(pages: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed tokens of the pages' blocks with a separator after each page, page and
    block (-1 for separators) of each token, and the blocks' sizes."""
    words, spans, blocks_, sizes, ids = array("q"), array("q"), array("q"), array("q"), _Hashes()
    for i, texts in enumerate(pages):
        at = len(words)
        for t in texts:
            own = ["\x00", *t.split()]
            words.extend(map(ids.__getitem__, own))
            blocks_.append(len(sizes))
            sizes.append(len(own))
        words.append(-1 - i)
        blocks_.append(-1)
        spans.append(len(words) - at)
    words, spans, blocks_, sizes = (np.array(x, np.int64) for x in (words, spans, blocks_, sizes))
    lengths = np.ones(len(blocks_), np.int64)
    lengths[blocks_ >= 0] = sizes
    return words, np.repeat(np.arange(len(spans)), spans), np.repeat(blocks_, lengths), sizes


def _run_hashes(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(RUN):
            h = _mix(h * _GOLD + tokens[starts + k].view(np.uint64))
    return h.view(np.int64)


def _covered(texts: pd.Series, stream: tuple, start: np.ndarray, hits: np.ndarray) -> tuple[list[np.ndarray], list[float]]:
    """Share of each block's tokens, and of each page's, that runs of these hashes cover."""
    tokens, page, owner, sizes = stream
    inside = covered(len(tokens), start[np.isin(_run_hashes(tokens, start), hits)])[owner >= 0]
    blocks_ = np.bincount(owner[owner >= 0], inside, len(sizes)) / sizes
    own = page[owner >= 0]
    pages = np.bincount(own, inside, len(texts)) / np.maximum(1, np.bincount(own, minlength=len(texts)))
    return np.split(blocks_, np.cumsum([len(t) for t in texts])[:-1]), pages.tolist()


def _pack(batches):
    """Articles compressed, since they are moved to their host's other articles."""
    codec = pa.Codec("zstd")
    for b in batches:
        data = [t.encode() for t in b.column("text").to_pylist()]
        packed = [codec.compress(t, asbytes=True) for t in data]
        yield pa.RecordBatch.from_arrays([b.column("host"), b.column("article"), pa.array([len(t) for t in data], pa.int64()), pa.array(packed, pa.binary())], ["host", "article", "size", "packed"])


def _distinct(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.Series]:
    """Distinct packed articles and their blocks."""
    pdf, codec = pdf.drop_duplicates("article"), pa.Codec("zstd")
    return pdf, pd.Series([codec.decompress(p, n, asbytes=True).decode().split("\n\n") for p, n in zip(pdf["packed"], pdf["size"])], dtype=object)


def article_templates(parsed: DataFrame) -> DataFrame | None:
    """(host, article, gone): numbers of the blocks of articles (by the hash of their
    text) that are template text of the host; None if no run is in most articles."""
    own = parsed.where("text <> ''").select("host", F.xxhash64("text").alias("article"), "text")
    large = own.groupBy("host").agg(F.ceil(F.sum(F.length("text")) / GROUP_BYTES).cast("long").alias("parts")).where("parts > 1")
    packed = own.mapInArrow(_pack, "host string, article long, size long, packed binary")
    # Large hosts are few: each has GROUP_BYTES of text.
    dealt = packed.join(F.broadcast(large), "host", "left").fillna(1, ["parts"]).withColumn("part", F.pmod("article", "parts"))

    def gone(pdf: pd.DataFrame, texts: pd.Series, stream: tuple, start: np.ndarray, hits: np.ndarray) -> list[tuple]:
        shares, whole = _covered(texts, stream, start, hits)
        found = [[i for i, x in enumerate(s) if x >= COVERED] if w <= 0.5 else [] for s, w in zip(shares, whole)]
        return [row for row in zip(pdf["host"], pdf["article"], found) if row[2]]

    def nominate(pdf: pd.DataFrame) -> pd.DataFrame:
        host, parts = pdf["host"].iloc[0], int(pdf["parts"].iloc[0])
        pdf, texts = _distinct(pdf)
        rows = []
        if parts > 1 or len(pdf) >= ARTICLES:
            stream = _stream(texts)
            start, number, pages = runs(*stream[:2])
            number, first = np.unique(number, return_index=True)
            most = _run_hashes(stream[0], start[first[2 * pages[number] > len(pdf)]])
            if parts > 1:
                rows = [(host, parts, int(r), None, None) for r in most]
            elif len(most):  # the whole host
                rows = [(h, 1, None, a, g) for h, a, g in gone(pdf, texts, stream, start, most)]
        return pd.DataFrame(rows, columns=["host", "parts", "run", "article", "gone"])

    def count(pdf: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=["host", "whole", "run", "pages"])
        host = pdf["host"].iloc[0]
        pdf, texts = _distinct(pdf)
        tokens, page, _, _ = _stream(texts)
        start, number, pages = runs(tokens, page)
        number, first = np.unique(number, return_index=True)
        run = _run_hashes(tokens, start[first])
        some = np.isin(run, hits["run"].to_numpy(np.int64))
        # The first row counts all articles.
        return pd.DataFrame({"host": host, "whole": [True] + [False] * int(some.sum()), "run": np.append(0, run[some]), "pages": np.append(len(pdf), pages[number[some]])})

    def judge(pdf: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(hits):
            return pd.DataFrame(columns=["host", "article", "gone"])
        pdf, texts = _distinct(pdf)
        stream = _stream(texts)
        found = gone(pdf, texts, stream, runs(*stream[:2])[0], hits["run"].to_numpy(np.int64))
        return pd.DataFrame(found, columns=["host", "article", "gone"])

    found = materialise(dealt.groupBy("host", "part").applyInPandas(nominate, "host string, parts long, run long, article long, gone array<int>"), "nominated")
    if found.isEmpty():
        return None
    nominated, judged = found.where("run is not null").select("host", "parts", "run"), found.where("run is null").select("host", "article", "gone")
    if nominated.isEmpty():
        return judged
    here = dealt.join(nominated.select("host").distinct(), "host", "left_semi")
    hits = nominated.distinct().withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    counts = here.groupBy("host", "part").cogroup(hits.groupBy("host", "part")).applyInPandas(count, "host string, whole boolean, run long, pages long")
    counts = materialise(counts.groupBy("host", "whole", "run").agg(F.sum("pages").alias("n")), "counted")
    total = counts.where("whole").select("host", F.col("n").alias("total")).where(F.col("total") >= ARTICLES)
    template = counts.where("not whole").join(total, "host").where("2 * n > total").select("host", "run")
    hits = hits.join(template, ["host", "run"], "left_semi")
    return judged.unionByName(materialise(here.groupBy("host", "part").cogroup(hits.groupBy("host", "part")).applyInPandas(judge, "host string, article long, gone array<int>"), "gone"))


def template_blocks(parsed: DataFrame) -> DataFrame:
    """(key, gone): numbers of the blocks that repeated runs cover, of pages without an
    article; for empty input, no rows."""
    hosts = parsed.where("text is null").select("host").distinct()
    outside = parsed.where("size(texts) > 0").join(hosts, "host", "left_semi").select("key", "host", "texts", F.col("text").isNull().alias("judged"))
    size = F.aggregate("texts", F.lit(0).cast("long"), lambda n, t: n + F.length(t))
    groups = outside.groupBy("host").agg(F.ceil((F.sum(size) + 1) / GROUP_BYTES).cast("int").alias("parts"))
    dealt = outside.join(groups, "host").withColumn("part", F.pmod("key", "parts").cast("long"))
    # Else the join's partitions, whole hosts, would serve the groups.
    dealt = materialise(dealt.repartition("host", "part"), "outside")

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("key")
        tokens, page, _, _ = _stream(pdf["texts"])
        start, number, pages = runs(tokens, page)
        number, first = np.unique(number, return_index=True)
        return pd.DataFrame({"host": pdf["host"].iloc[0], "part": pdf["part"].iloc[0], "run": _run_hashes(tokens, start[first]), "pages": pages[number]})

    def judge(pdf: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("key")
        stream = _stream(pdf["texts"])
        shares = _covered(pdf["texts"], stream, runs(*stream[:2])[0], hits["run"].to_numpy(np.int64))[0]
        gone = [[i for i, x in enumerate(s) if x >= COVERED] for s in shares]
        out = pd.DataFrame({"key": pdf["key"].to_numpy(), "gone": gone})
        return out[out["gone"].map(len) > 0]

    counts = materialise(dealt.groupBy("host", "part").applyInPandas(count, "host string, part long, run long, pages long"), "runs")
    template = counts.groupBy("host", "run").agg(F.sum("pages").alias("n")).where(F.col("n") >= PAGES).select("host", "run")
    hits = counts.join(template, ["host", "run"]).select("host", "part", "run")
    return dealt.where("judged").groupBy("host", "part").cogroup(hits.groupBy("host", "part")).applyInPandas(_judged_only(judge), "key long, gone array<int>")


def _judged_only(judge):
    """Groups in which no page is to be judged have only hits."""

    def run(pdf: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
        return judge(pdf, hits) if len(pdf) else pd.DataFrame(columns=["key", "gone"])

    return run


def main_text(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text (empty if none), n_chars.

    Null or empty html gives an empty text. Repeated rows each get their text, and
    count as one page among those of a host; a null url has the empty host. Unclosed
    and stray tags, comments and quotes never fail. Other columns are ignored."""
    parsed = materialise(parse(pages), "parsed", "zstd")
    out = parsed.where("text is not null")
    gone = article_templates(parsed)
    if gone is not None:
        out = out.withColumn("article", F.xxhash64("text")).join(gone, ["host", "article"], "left")
        kept = F.filter(F.split("text", "\n\n"), lambda t, i: ~F.array_contains("gone", i))
        out = out.withColumn("text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n\n")))
    out = out.select("page_id", "url", "text")
    open_ = parsed.where("text is null")
    if not open_.isEmpty():
        left = open_.join(template_blocks(parsed), "key", "left")
        kept = F.array_except("rest", F.coalesce("gone", F.array().cast("array<int>")))
        text = F.array_join(F.transform(kept, lambda i: F.get("texts", i)), "\n\n")
        out = out.unionByName(left.select("page_id", "url", text.alias("text")))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
