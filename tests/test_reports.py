"""Readers and writers of files, from bytes to a comparison."""

import pytest

from pageloom.operators import compare, decisions
from pageloom.sources import reports

HEAD = "種別,JIS, 達成方法 ,内容,行番号\r\n"


def test_csv_rows():
    assert reports.csv_rows('a,"b,""c""\nd",e\r\n\r\nf,\n') == [["a", 'b,"c"\nd', "e"], ["f", ""]]
    assert reports.csv_rows('x"y,z"w,\rv') == [["xy,zw", ""], ["v"]]
    assert reports.csv_rows("") == reports.csv_rows("\n\n") == [] and reports.csv_rows("a") == [["a"]] and reports.csv_rows('"open') == [["open"]]


def test_decode():
    assert reports.decode("\ufeffé".encode()) == "é" and reports.decode("種別".encode("cp932")) == "種別" and reports.decode("①".encode("cp932"), "Shift_JIS") == "①"


def test_report_diff(spark, tmp_path):
    """Two Shift_JIS reports from files to the difference."""
    (tmp_path / "before.csv").write_bytes((HEAD + '問題あり,1.1.1,H37,"画像に,  代替\r\nがない",3\r\n問題あり,1.1.1,H37,x,4\r\n要判断箇所,2.4.2,G88,t,\r\n').encode("cp932"))
    (tmp_path / "after.csv").write_bytes((HEAD + "問題あり,1.1.1,H37,z,9\r\n手動確認,3.1.1,H57,n,1").encode("cp932"))
    (tmp_path / "none.csv").write_bytes(HEAD.encode("cp932"))
    before, after = (reports.read_check_report(spark, str(tmp_path / f"{n}.csv")) for n in ("before", "after"))
    assert [(r.row_no, r.type, r.message, r.line) for r in before.orderBy("row_no").collect()] == [(0, "問題あり", "画像に, 代替 がない", "3"), (1, "問題あり", "x", "4"), (2, "要判断箇所", "t", "")]
    got = [(r.status, r.jis, r.before_count, r.after_count, r.message, r.after_lines) for r in compare.sorted_diff(compare.diff_reports(before, after)).collect()]
    assert got == [("unresolved", "1.1.1", 2, 1, "z", ["9"]), ("resolved", "2.4.2", 1, 0, "t", []), ("new", "3.1.1", 0, 1, "n", ["1"])]
    with pytest.raises(ValueError):
        reports.read_check_report(spark, str(tmp_path / "none.csv"))


def test_queues(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes("移行管理ID,移行元URL,ページタイトル\nA1, http://a ,T\n,http://b,\nA3,,x\n , ,\n".encode("cp932"))
    (tmp_path / "u.csv").write_text("http://c,news\n\nhttp://d\n")
    (tmp_path / "list.txt").write_text("HTTP://e, cat ,x\r\nftp://f\n\n https://g")
    m = sorted(reports.read_queue_csv(spark, str(tmp_path / "m.csv")).collect(), key=lambda r: r.url)
    assert [(r.url, r.page_title, r.source) for r in m] == [("http://a", "T", "csv"), ("http://b", "", "csv")] and m[0].id == "A1" and m[1].id.startswith("csv_")
    assert sorted((r.url, r.category) for r in reports.read_queue_csv(spark, str(tmp_path / "u.csv")).collect()) == [("http://c", "news"), ("http://d", "")]
    assert sorted((r.url, r.category, r.source) for r in reports.read_url_list(spark, str(tmp_path / "list.txt")).collect()) == [("HTTP://e", "cat", "url-list"), ("https://g", "", "url-list")]


def test_html_files(spark, tmp_path):
    (tmp_path / "a.b.html").write_text("<html><head><TITLE lang=ja> T &amp; t </title></head><svg><title>no</title></svg>")
    got = reports.read_html_files(spark, str(tmp_path)).collect()
    assert [(r.id, r.page_title, r.source) for r in got] == [("a.b", "T & t", "html-file")] and got[0].raw_html.startswith("<html>")


def test_write_csv(spark, tmp_path):
    """Batch evidence, written and read back."""
    decided = spark.createDataFrame([(1, "c1", 'r"1', "accepted", "high", False), (1, "c2", "r,2", "undecided", "low", True)], "page_id long, candidate_id string, rule_id string, decision string, confidence string, human_review boolean")
    pages = spark.createDataFrame([(1, "P1", "線\n引き", "http://a")], "page_id long, id string, page_title string, url string")
    rows = decisions.batch_evidence(decided, pages)
    reports.write_csv(rows.coalesce(1), str(tmp_path / "out"), list(decisions.EVIDENCE_FILE), list(decisions.EVIDENCE_FILE.values()))
    (part,) = [p for p in (tmp_path / "out").glob("part-*") if p.stat().st_size]
    data = part.read_bytes()
    assert data.startswith("\ufeff\"移行管理ID\",".encode()) and data.count(b"\r\n") == 3
    read = reports.csv_rows(reports.decode(data))
    assert read[0] == list(decisions.EVIDENCE_FILE.values())
    assert sorted(read[1:]) == [["P1", "線\n引き", "http://a", "", "c1", 'r"1', "", "", "accepted", "high", "0", "", ""], ["P1", "線\n引き", "http://a", "", "c2", "r,2", "", "", "undecided", "low", "1", "", ""]]
