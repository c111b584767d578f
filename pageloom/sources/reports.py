"""Check reports, page queues, rule tables and page files.

Small files of odd encodings are read whole, one row a file, decoded and cut into cells
in one Arrow pass; so a folder of many files is read in parallel and line breaks in
quotes and any encoding that Python knows are no matter.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column names fixed by the file formats.
REPORT_COLUMNS = {"種別": "type", "JIS": "jis", "達成方法": "method", "内容": "message", "行番号": "line"}
QUEUE_COLUMNS = {"移行管理ID": "id", "ページタイトル": "page_title", "テンプレートNo": "template_no", "移行元URL": "url", "移行先カテゴリ": "category", "ステータス": "source_status"}
QUEUE_KEYS = ("移行管理ID", "移行元URL")
RULE_SCHEMA = (
    "id string, category string, title string, description string, processing_class string, wcag array<string>, jis array<string>, municipality_specific boolean, cms_auto boolean, known_failure string, "
    "origin string, michecker_check_ids array<string>, includes array<string>, rule string, examples array<struct<case:string,before:string,after:string,point:string>>, source string"
)
PAGE_COLUMNS = [*QUEUE_COLUMNS.values(), "source"]
_CELL = re.compile(r'((?:"(?:[^"]|"")*(?:"|\Z)|[^",\r\n])*)(,|\r\n|\r|\n|\Z)')
_QUOTED = re.compile(r'"((?:[^"]|"")*)(?:"|\Z)')
_SPACE = re.compile(r"[\s﻿]+")


def decode(data: bytes, encoding: str | None = None) -> str:
    """Text of a file. Without an encoding: UTF-8 if it is valid, else Shift_JIS."""
    if encoding is None:
        try:
            return data.decode("utf-8-sig")
        except UnicodeDecodeError:
            encoding = "shift_jis"
    # Files of that name are written with the larger set of Windows.
    return data.decode({"shift_jis": "cp932"}.get(encoding.lower().replace("-", "_"), encoding), "replace")


def csv_rows(text: str) -> list[list[str]]:
    """Rows of cells; quotes may stand anywhere in a cell. Empty lines are no rows."""
    rows, row = [], []
    for m in _CELL.finditer(text):
        if m.start() == len(text) and not row:
            break
        row.append(_QUOTED.sub(lambda q: q[1].replace('""', '"'), m[1]))
        if m[2] != ",":
            rows.append(row)
            row = []
            if m.end() == len(text):
                break
    return [r for r in rows if r != [""]]


def _clean(cell: str) -> str:
    return _SPACE.sub(" ", cell).strip(" ")


def _files(spark: SparkSession, path) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _read(files: DataFrame, columns: list[str], rows_of) -> DataFrame:
    """``rows_of(path, content)`` gives rows of ``columns``, all text but row_no."""

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = rows_of(path, content)
                cols = list(zip(*rows)) if rows else [()] * len(columns)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "row_no" else pa.string()) for n, c in zip(columns, cols)], columns)

    return files.mapInArrow(run, ", ".join(f"{c} {'long' if c == 'row_no' else 'string'}" for c in columns))


def read_check_report(spark: SparkSession, path, encoding: str = "shift_jis") -> DataFrame:
    """(file, row_no, type, jis, method, message, line) of report files, columns found by
    header name, absent ones empty, white space collapsed. No rows at all are an error."""

    def rows_of(file, content):
        rows = csv_rows(decode(content, encoding))
        at = {_clean(name): i for i, name in enumerate(rows[0])} if rows else {}
        take = [at.get(name, -1) for name in REPORT_COLUMNS]
        return [(file, n, *(_clean(r[i]) if 0 <= i < len(r) else "" for i in take)) for n, r in enumerate(rows[1:])]

    out = _read(_files(spark, path), ["file", "row_no", *REPORT_COLUMNS.values()], rows_of)
    if out.isEmpty():
        raise ValueError(f"{path}: no rows")
    return out


def read_queue_csv(spark: SparkSession, path, encoding: str | None = None) -> DataFrame:
    """PAGE_COLUMNS of queue files: those with the two key columns by header name, others as
    lines of a URL and, if there is one, a category. Rows without a URL go; a row without
    an id gets one of its file and line."""

    def rows_of(file, content):
        rows = [r for r in csv_rows(decode(content, encoding)) if any(c.strip() for c in r)]
        header, out = rows[0] if rows else [], []
        known = all(k in header for k in QUEUE_KEYS)
        take = [header.index(k) if k in header else -1 for k in QUEUE_COLUMNS] if known else [-1, -1, -1, 0, 1, -1]
        for n, r in enumerate(rows[known:]):
            own, *rest = (r[i].strip() if 0 <= i < len(r) else "" for i in take)
            if rest[2]:
                out.append((own or f"csv_{_hash(file)}_{n}", *rest, "csv"))
        return out

    return _read(_files(spark, path), PAGE_COLUMNS, rows_of)


def _hash(text: str) -> str:
    import xxhash

    return xxhash.xxh64_hexdigest(text)


def read_url_list(spark: SparkSession, path) -> DataFrame:
    """PAGE_COLUMNS of files with a URL, or a URL and a category, a line; lines that are no
    http URLs go."""

    def rows_of(file, content):
        lines = (line.split(",") for line in re.split(r"\r?\n", decode(content)))
        cut = ((n, parts[0].strip(), parts[1].strip() if len(parts) > 1 else "") for n, parts in enumerate(lines))
        return [(f"url_{_hash(file)}_{n}", "", "", url, category, "", "url-list") for n, url, category in cut if re.match("https?://", url, re.I)]

    return _read(_files(spark, path), PAGE_COLUMNS, rows_of)


class _Title(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.parts, self.over = False, [], False

    def handle_starttag(self, tag, attrs):
        self.inside = tag == "title" and not self.over

    def handle_endtag(self, tag):
        self.over = self.over or tag == "title" and self.inside
        self.inside = False

    def handle_data(self, data):
        if self.inside:
            self.parts.append(data)


def page_title(html: str) -> str:
    """Text of the first title, whatever its attributes."""
    t = _Title()
    t.feed(html)
    t.close()
    return "".join(t.parts).strip()


def read_html_files(spark: SparkSession, path) -> DataFrame:
    """PAGE_COLUMNS and raw_html of page files; the id is the file's name without its ending."""

    def rows_of(file, content):
        html = content.decode("utf-8-sig", "replace")
        return [(re.sub(r"\.[^.]+$", "", file.rsplit("/", 1)[-1]), page_title(html), "", "", "", "", "html-file", html)]

    return _read(_files(spark, path), [*PAGE_COLUMNS, "raw_html"], rows_of)


def read_rules_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Rules of one JSON object a line; a broken line is an error when rows are read."""
    return spark.read.schema(RULE_SCHEMA).option("mode", "FAILFAST").json(path)


def csv_cell(c: Column) -> Column:
    """A quoted cell; null is empty."""
    return F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def csv_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(line) of each row: ``columns`` as quoted cells."""
    return rows.select(F.concat_ws(",", *(csv_cell(F.col(c)) for c in columns)).alias("line"))


def write_csv(rows: DataFrame, path: str, columns: list[str], names: list[str] | None = None, bom: bool = True) -> None:
    """Write ``columns`` under ``names`` with every cell quoted and lines ended by CR LF. Each
    part file is whole: it starts with a byte order mark, if wanted, and the header."""
    lines = csv_lines(rows, columns)
    head = ("﻿" if bom else "") + ",".join('"' + n.replace('"', '""') + '"' for n in names or columns)

    def with_head(batches):
        first = True
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([head, *b.column(0).to_pylist()] if first else b.column(0).to_pylist(), pa.string())], ["line"])
                first = False

    lines.mapInArrow(with_head, "line string").write.option("lineSep", "\r\n").text(path)
