"""HTML pages as a table of nodes for the accessibility checks.

Unlike the plain node table, a page always has html, head and body, and tables have
row groups and rows, as browsers make them. Texts are kept once for a page while it is
read; only elements whose text some check compares carry it. Counts of what is below
a node (images, controls, tables, captions, items) let checks do without range joins.

Elements more than ``DEPTH`` levels deep hang on the last level, as in browsers, so
selectors stay short whatever is nested.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_nodes import CLOSES, P_ENDS, VOID

DEPTH = 512
HEAD = frozenset("base basefont bgsound link meta noframes script style template title".split())
#: Block elements of the checks (fixed values).
BLOCK = frozenset(
    "address blockquote center dir div dl fieldset form h1 h2 h3 h4 h5 h6 hr isindex menu noframes noscript ol p pre table ul dd frameset li tbody td tfoot th thead tr".split()
)
#: Elements that exist in tables only.
IN_TABLE = frozenset("caption col colgroup tbody td tfoot th thead tr".split())
CONTROL = frozenset(("form", "input", "select", "textarea"))
#: Counters of nodes below an element.
COUNTERS = {"imgs": ("img",), "controls": CONTROL, "tables": ("table",), "captions": ("caption",), "items": ("li",), "scripts": ("script",), "blocks": BLOCK}
#: Length of a page's text at which the checks stop reading it (fixed value).
BODY_TEXT = 50
FIELDS = [
    ("page_id", pa.int64(), "long"), ("is_html5", pa.bool_(), "boolean"), ("pre", pa.int32(), "int"), ("parent", pa.int32(), "int"), ("sibling", pa.int32(), "int"), ("node_type", pa.int32(), "int"), ("tag", pa.string(), "string"),
    ("attrs", pa.map_(pa.string(), pa.string()), "map<string,string>"), ("path", pa.string(), "string"), ("parent_tag", pa.string(), "string"), ("in_body", pa.bool_(), "boolean"),
    ("table_pre", pa.int32(), "int"), ("row_pre", pa.int32(), "int"), ("list_pre", pa.int32(), "int"), ("kids", pa.int32(), "int"), ("blank", pa.bool_(), "boolean"),
    ("text", pa.string(), "string"), ("name", pa.string(), "string"), ("raw_len", pa.int32(), "int"), ("style", pa.string(), "string"), ("noscript", pa.bool_(), "boolean"), ("leaf", pa.bool_(), "boolean"),
    *((c, pa.int32(), "int") for c in COUNTERS if c != "blocks"),
]
SCHEMA = ", ".join(f"{n} {t}" for n, _, t in FIELDS)


class _Node:
    __slots__ = ("pre", "parent", "sibling", "kind", "tag", "attrs", "up", "kids", "same", "nth", "alt", "raw", "below", "table", "row", "list", "data", "path", "depth", "in_body")

    def __init__(self, tree, up, kind, tag, attrs, data=None):
        self.pre, self.up, self.kind, self.tag, self.attrs, self.data = len(tree.nodes), up, kind, tag, attrs, data
        self.parent, self.sibling, self.kids, self.same, self.nth, self.depth = None, 0, 0, {}, 0, 0
        self.table = self.row = self.list = None
        self.alt, self.raw, self.below, self.in_body = [len(tree.alts), 0], [len(tree.raws), 0], dict(tree.seen), False
        if up is not None:
            self.parent, self.sibling, self.depth = up.pre, up.kids, up.depth + 1
            self.in_body = up.in_body or up.tag == "body"
            up.kids += 1
            self.table = up.pre if up.tag == "table" else up.table
            self.row = up.pre if up.tag == "tr" else up.row
            self.list = up.pre if up.tag in ("ul", "ol") else up.list
            if tag:
                up.same[tag] = self.nth = up.same.get(tag, 0) + 1
        tree.nodes.append(self)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.open, self.alts, self.raws, self.html5, self.body, self.head = [], [], [], [], False, None, None
        self.seen = dict.fromkeys(COUNTERS, 0)
        self.frames = False

    def handle_decl(self, decl):
        words = decl.split(None, 2)
        if not self.nodes and len(words) > 1 and words[0].lower() == "doctype":
            rest = words[2].strip().lower() if len(words) > 2 else ""
            # Without a public id.
            self.html5 = words[1].lower() == "html" and (not rest.startswith("public") or rest.startswith(("public \"about:legacy-compat", "public \"\"", "public ''")))

    def _start(self, tag, attrs):
        node = _Node(self, self.open[min(len(self.open), DEPTH) - 1] if self.open else None, 1, tag, attrs)
        for counter, tags in COUNTERS.items():
            self.seen[counter] += tag in tags
        if tag == "img" or attrs.get("role", "").lower() == "img":
            self.alts.append(node)
        self.open.append(node)
        return node

    def _end(self):
        node = self.open.pop()
        node.alt[1], node.raw[1] = len(self.alts), len(self.raws)
        node.below = {k: self.seen[k] - n - (node.tag in COUNTERS[k]) for k, n in node.below.items()}

    def _close(self, n):
        while len(self.open) > n:
            self._end()

    def _place(self, tag):
        """Open what must be open around ``tag`` (or text, None)."""
        if not self.open:
            self._start("html", {})
        if tag == "html" or self.body is not None:
            return
        if self.head is None and tag != "head":
            self.head = self._start("head", {})
        if tag in HEAD and self.open[-1].tag != "html" or tag == "head":
            return
        if tag in HEAD:  # between head and body
            return
        self._close(1)
        if tag not in ("body", "frameset"):
            self.body = self._start("body", {})

    def handle_starttag(self, tag, attrs):
        own = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        if tag in ("html", "head", "body"):
            known = {"html": self.nodes[0] if self.nodes else None, "head": self.head, "body": self.body}[tag]
            if known is not None:
                if tag != "head":
                    known.attrs.update((k, v) for k, v in own.items() if k not in known.attrs)
                return
            self._place(tag)
            node = self.nodes[0] if tag == "html" and self.nodes else self._start(tag, {})
            node.attrs.update(own)
            if tag == "head":
                self.head = node
            elif tag == "body":
                self.body = node
            return
        if tag in IN_TABLE and not any(n.tag == "table" for n in self.open):
            return
        self._place(tag)
        if tag == "frameset" and self.body is None:
            self.body = self._start(tag, own)
            return
        ends, stop = CLOSES.get(tag, ({"p"}, {"table", "td", "th"}) if tag in P_ENDS else (set(), set()))
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag in stop:
                break
            if self.open[i].tag in ends:
                self._close(i)
                if tag not in ("tr", "thead", "tbody", "tfoot"):
                    break
        if tag in ("tr", "td", "th") and self.open[-1].tag == "table":
            self._start("tbody", {})
        if tag in ("td", "th") and self.open[-1].tag in ("tbody", "thead", "tfoot"):
            self._start("tr", {})
        self._start(tag, own)
        if tag in VOID or tag in ("frame", "param", "basefont", "isindex"):
            self._end()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            return
        at = next((i for i in range(len(self.open) - 1, 1, -1) if self.open[i].tag == tag), -1)
        if tag == "head" and self.body is None and self.open and self.head is not None:
            self._close(1)
        elif at >= 0:
            self._close(at)

    def handle_data(self, data):
        if self.body is None and not data.strip() and (not self.open or self.open[-1].tag in ("html", "head")):
            return
        if self.body is None and self.open and self.open[-1].tag in HEAD:
            pass
        else:
            self._place(None)
        up = self.open[min(len(self.open), DEPTH) - 1]
        _Node(self, up, 3, None, {}, data)
        self.alts.append(data.strip() + " ")
        self.raws.append(data)

    def finish(self):
        self.close()
        self._place(None)
        self._close(0)
        self.ids = {}
        for n in self.nodes:
            if n.kind == 1 and "id" in n.attrs:
                self.ids.setdefault(n.attrs["id"], n)
        return self

    def text(self, node, depth=0):
        """Text and image names below a node, trimmed."""
        parts = []
        for p in self.alts[node.alt[0] + (self.alts[node.alt[0] : node.alt[0] + 1] == [node]) : node.alt[1]]:
            if isinstance(p, str):
                parts.append(p)
            else:
                name = self.name(p, "alt" if p.tag == "img" else None, depth + 1)
                if name and name.strip():
                    parts.append(name.strip() + " ")
        return "".join(parts).strip()

    def name(self, node, alt=None, depth=0):
        """Name by aria-labelledby, aria-label or the given attribute; else None."""
        refs = [self.ids[i] for i in node.attrs.get("aria-labelledby", "").strip().split(" ") if i in self.ids]
        if refs and depth < 8:  # references may run in circles
            texts = [t for t in (self.text(r, depth + 1) for r in refs) if t]
            if texts:
                return " ".join(texts)
        own = node.attrs.get("aria-label")
        if own is not None and (own.strip() or not alt or alt not in node.attrs):
            return own
        return node.attrs.get(alt) if alt else None

    def body_text(self):
        """What the page says, up to BODY_TEXT characters; None with a frameset or without a body."""
        if self.body is None or self.body.tag != "body" or any(n.tag == "frameset" for n in self.nodes):
            return None
        out, clean = "", lambda s: s.replace("\xa0", "").strip()
        for n in self.nodes[self.body.pre + 1 :]:
            if len(out) >= BODY_TEXT:
                break
            if n.in_body:
                out += clean(n.data) if n.kind == 3 else clean(n.attrs.get("alt", "")) + clean(n.attrs.get("title", ""))
        return out

    def selector(self, n):
        part = n.tag
        if n.attrs.get("id"):
            return f"{part}#{n.attrs['id']}"
        if n.up is None:
            return part
        if n.up.same[n.tag] > 1:
            part += f":nth-of-type({n.nth})"
        return f"{n.up.path} > {part}"


def page_rows(page_id, html: str | None) -> list[tuple]:
    tree, rows = _Tree(), []
    tree.feed(html or "")
    tree.finish()
    body_text = tree.body_text()
    for n in tree.nodes:
        element = n.kind == 1
        n.path = tree.selector(n) if element else None
        leaf = element and n.in_body | (n.tag == "body") and n.tag in BLOCK and n.below["blocks"] == 0
        texts = element and (leaf or n.tag in ("td", "th") or n.tag == "a" and "href" in n.attrs)
        raws = tree.raws[n.raw[0] : n.raw[1]] if element and n.tag in ("q", "blockquote", "blink", "style") else None
        noscript = element and n.tag == "a" and n.below["scripts"] > 0 and any(m.tag == "noscript" and tree.text(m) for m in _inside(tree, n))
        rows.append((
            page_id, tree.html5, n.pre, n.parent, n.sibling, n.kind, n.tag, list(n.attrs.items()), n.path, n.up.tag if n.up else None, n.in_body, n.table, n.row, n.list, n.kids, None if element else not n.data.strip(),
            body_text if element and n.tag == "body" else tree.text(n) if texts else None, tree.name(n) if element and n.tag in ("a", "table") else None,
            None if raws is None else -1 if not raws else sum(map(len, raws)), "".join(raws) if element and n.tag == "style" else None, noscript, leaf, *((n.below[c] if element else 0) for c in COUNTERS if c != "blocks"),
        ))
    return rows


def _inside(tree, node):
    for n in tree.nodes[node.pre + 1 :]:
        if n.depth <= node.depth:
            break
        yield n


def node_batches(batches, batch_nodes: int):
    """Record batches of the nodes of pages. Pages are taken one by one: a batch of input has
    up to 64 MB of html, and copying it whole or holding many nodes is what fills a worker."""
    schema = pa.schema([(n, t) for n, t, _ in FIELDS])

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t, _) in zip(zip(*rows), FIELDS)], schema=schema)

    rows = []
    for b in batches:
        for p, h in zip(b.column(0), b.column(1)):
            rows += page_rows(p.as_py(), h.as_py())
            if len(rows) >= batch_nodes:
                yield batch(rows)
                rows = []
    if rows:
        yield batch(rows)


def parse_pages(pages: DataFrame, batch_nodes: int = 5_000) -> DataFrame:
    """Nodes of ``pages`` (page_id, html). ``text`` is the text with image names of links,
    cells and leaf blocks, and for body what a reader gets of it first (null with frames);
    ``raw_len`` the characters of quotations, blinking text and styles (-1 without a text
    node). A null html is an empty page, which has html, head and body. Repeated rows give
    repeated nodes. No shuffle; batches hold ``batch_nodes`` nodes, a larger page its own."""

    def run(batches):
        return node_batches(batches, batch_nodes)

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, SCHEMA)
