"""HTML pages as a relational node table.

One row per element or text node, in document order. ``pre``/``post`` number the
tree so that ``a`` contains ``d`` iff a.pre < d.pre and d.post < a.post on one page;
the nearest table and list are carried so that most checks need no range join.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
P_ENDS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
NEAREST = {"cell_pre": ("td", "th"), "link_pre": ("a",), "item_pre": ("li",)}
SCHEMA = (
    "page_id long, is_html5 boolean, pre int, post int, parent int, depth int, sibling int, node_type int, tag string, attrs map<string,string>, "
    "text string, path string, in_body boolean, table_pre int, list_pre int, parent_tag string, prev_tag string, last int, kids int, elements int, content string, cell_pre int, link_pre int, item_pre int"
)
ARROW = pa.schema([
    ("page_id", pa.int64()), ("is_html5", pa.bool_()), ("pre", pa.int32()), ("post", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("sibling", pa.int32()), ("node_type", pa.int32()),
    ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("path", pa.string()), ("in_body", pa.bool_()), ("table_pre", pa.int32()), ("list_pre", pa.int32()), ("parent_tag", pa.string()), ("prev_tag", pa.string()),
    ("last", pa.int32()), ("kids", pa.int32()), ("elements", pa.int32()), ("content", pa.string()), ("cell_pre", pa.int32()), ("link_pre", pa.int32()), ("item_pre", pa.int32()),
])


class _Tree(HTMLParser):
    def __init__(self, page_id, texts_of=None):
        super().__init__(convert_charrefs=True)
        self.page_id, self.rows, self.open, self.html5, self.posts = page_id, [], [], False, 0
        self.texts_of = texts_of

    def handle_decl(self, decl):
        self.html5 = self.html5 or decl.strip().lower() == "doctype html"

    def _new(self, kind, tag, attrs, text):
        up = self.open[-1] if self.open else None
        row = {
            "page_id": self.page_id, "pre": len(self.rows), "post": 0, "parent": up["pre"] if up else None, "depth": len(self.open), "sibling": up["kids"] if up else 0, "node_type": kind, "tag": tag, "attrs": attrs, "text": text,
            "path": f"{up['path'] if up else ''}/{tag or 'text()'}", "in_body": bool(up and (up["tag"] == "body" or up["in_body"])), "parent_tag": up["tag"] if up else None, "prev_tag": up["before"] if up else None,
            "table_pre": (up["pre"] if up["tag"] == "table" else up["table_pre"]) if up else None, "list_pre": (up["pre"] if up["tag"] in ("ul", "ol") else up["list_pre"]) if up else None, "kids": 0, "elements": 0, "last": len(self.rows), "before": None, "parts": [], "raw": [], "content": None,
            **{k: (up["pre"] if up["tag"] in tags and (k != "link_pre" or up["href"]) else up[k]) if up else None for k, tags in NEAREST.items()}, "href": any(k == "href" for k, _ in attrs),
        }
        if up:
            up["kids"] += 1
            up["before"] = tag or "text()"
            up["elements"] += kind == 1
        self.rows.append(row)
        return row

    def _close(self, n):
        while len(self.open) > n:
            row = self.open.pop()
            said, raw = "".join(row["parts"]), "".join(row["raw"])
            if self.texts_of is None or row["tag"] in self.texts_of:
                row["text"] = " ".join(said.split())
                whole = row["text"] if raw == said else " ".join(raw.split())
                row["content"] = None if whole == row["text"] else whole
            row["post"], self.posts, row["last"] = self.posts, self.posts + 1, len(self.rows) - 1
            row["parts"], row["raw"] = None, None
            if self.open and row["tag"] not in ("script", "style", "noscript"):
                self.open[-1]["raw"].append(raw)
                self.open[-1]["parts"].append(("" if row["tag"] in ("a", "b", "i", "span", "em", "strong", "font", "u") else " ") + said + " ")

    def handle_starttag(self, tag, attrs):
        ends, stop = CLOSES.get(tag, ({"p"}, {"table", "td", "th"}) if tag in P_ENDS else (set(), set()))
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i]["tag"] in stop:
                break
            if self.open[i]["tag"] in ends:
                self._close(i)
                if tag not in ("tr", "thead", "tbody", "tfoot"):
                    break
        own = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        row = self._new(1, tag, list(own.items()), "")
        if tag in VOID:
            row["post"], self.posts = self.posts, self.posts + 1
            if tag == "img" and self.open:
                self.open[-1]["parts"].append(f" {own.get('alt', '')} ")
        else:
            self.open.append(row)

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i]["tag"] == tag), -1)
        if at >= 0:
            self._close(at)

    def handle_data(self, data):
        row = self._new(3, None, [], data)
        row["post"], self.posts = self.posts, self.posts + 1
        if self.open:
            self.open[-1]["parts"].append(data)
            self.open[-1]["raw"].append(data)


def page_nodes(page_id, html: str | None, texts_of=None) -> list[dict]:
    tree = _Tree(page_id, texts_of)
    tree.feed(html or "")
    tree.close()
    tree._close(0)
    for r in tree.rows:
        r["is_html5"] = tree.html5
    return tree.rows


def parse_html(pages: DataFrame, texts_of: frozenset[str] | None = None, batch_nodes: int = 5_000) -> DataFrame:
    """Nodes of ``pages`` (page_id, html). ``text`` of an element is all text below it with
    alternative texts of images, white space collapsed; ``content`` is the bare text, null where
    it is the same. ``last`` is the last node inside; ``cell_pre``, ``link_pre`` and ``item_pre`` are
    the nearest cell, link and list item around a node. Given ``texts_of``, elements of other tags
    have an empty text and no content: texts of elements repeat what lies below them. No shuffle;
    batches hold ``batch_nodes`` nodes, a larger page its own."""

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in ARROW], schema=ARROW)

    def run(batches):
        rows = []
        for b in batches:
            for p, h in zip(b.column(0), b.column(1)):
                rows += page_nodes(p.as_py(), h.as_py(), texts_of)
                if len(rows) >= batch_nodes:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, SCHEMA)
