import io
import zipfile

import pytest
from pyspark.sql import types as T

from quernstone.sources import delimited, pages, sinks, workbooks


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv(spark, tmp_path):
    p = write(tmp_path / "a.csv", '﻿a,b,c\n1,"x, ""y""",3\n4,5\n7,8,9,10\n"l1\nl2",b,NA\n')
    rows, rejected = delimited.read_csv(spark, p)
    assert sorted(tuple(r) for r in rows.collect()) == sorted([("1", 'x, "y"', "3"), ("4", "5", None), ("l1\nl2", "b", "NA")])
    assert [r.reason for r in rejected.collect()] == ["column_count"]


@pytest.mark.parametrize("head", ["a,a", "a,,b", " a,b", "a,b "])
def test_bad_headers(head):
    with pytest.raises(delimited.HeaderError):
        delimited.header_of(head)


def test_empty_csv(spark, tmp_path):
    with pytest.raises(delimited.HeaderError):
        delimited.read_csv(spark, write(tmp_path / "e.csv", ""))
    rows, rejected = delimited.read_csv(spark, write(tmp_path / "h.csv", "a,b\n"))
    assert rows.count() == rejected.count() == 0


def test_jsonl(spark, tmp_path):
    p = write(tmp_path / "a.jsonl", '{"a": 1, "b": "x"}\n\n  \n{"a": }\n[1]\n"t"\n{"b": null}\n')
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    rows, rejected = delimited.read_jsonl(spark, p, schema)
    assert sorted(map(str, (tuple(r) for r in rows.collect()))) == sorted(["(1, 'x')", "(None, None)"])
    assert sorted(r.reason for r in rejected.collect()) == ["invalid_json", "record_not_object", "record_not_object"]


def test_text_pages(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("one\ftwo 水".encode())
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "c.txt").write_bytes(b" \n")
    (tmp_path / "d.bin").write_bytes(b"x")
    got = {(r.path.rsplit("/", 1)[1], r.page_num): (r.text, r.reason) for r in pages.text_pages(spark, str(tmp_path)).collect()}
    assert got == {("a.txt", 1): ("one", None), ("a.txt", 2): ("two 水", None), ("b.txt", 0): (None, "not_utf8"), ("c.txt", 0): (None, "no_text")}


MAIN, RELS, PACKAGE = workbooks.MAIN[1:-1], workbooks.RELATION[1:-1], workbooks.PACKAGE[1:-1]


def workbook(*sheets, shared=None, head=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{RELS}"><sheets>' + "".join(f'<sheet name="s{i}" r:id="x{i}"/>' for i in range(len(sheets))) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE}">' + "".join(f'<Relationship Id="x{i}" Target="parts/p{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, sheet in enumerate(sheets):
            z.writestr(f"xl/parts/p{i}.xml", f'{head}<worksheet xmlns="{MAIN}"><sheetData>{sheet}</sheetData></worksheet>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">' + "".join(f"<si>{s}</si>" for s in shared) + "</sst>")
    return out.getvalue()


def cell(at, value, kind="s"):
    return f'<c r="{at}" t="{kind}"><v>{value}</v></c>'


HEAD = "<row>" + cell("A2", 0) + cell("C2", 1) + "</row>"
STRINGS = ["<t>code</t>", "<t>name</t>", "<r><t>X </t></r><r><t>&amp; Y</t></r><rPh><t>reading</t></rPh>"]


def test_workbooks(spark, tmp_path):
    title = '<row><c r="A1" t="inlineStr"><is><t>title</t></is></c></row>'
    body = "<row>" + cell("C4", 2) + cell("A4", 5, "n") + "</row><row>" + cell("AA5", 7, "n") + "</row>"
    files = {
        "a": workbook(title + HEAD + body, shared=STRINGS), "b": b"no zip", "c": workbook('<row><c r="A1"><f>1+1</f><v>2</v></c></row>'), "d": workbook(HEAD + "<row>" + cell("A3", 9) + "</row>", shared=STRINGS),
        "e": workbook('<row><c t="n"><v>1</v></c></row>'), "f": workbook(HEAD + "<row>" + cell("A3", "-1") + "</row>", shared=STRINGS), "g": workbook(HEAD, HEAD, shared=STRINGS), "h": workbook(title),
        "i": workbook(HEAD + "<row>" + cell("A3", 1, "n") + cell("A3", 2, "n") + "</row>", shared=STRINGS), "j": workbook("<row>" + cell("A2", 0) + cell("B2", 0) + cell("C2", 1) + "</row>", shared=STRINGS),
        "k": workbook("<row>", shared=STRINGS), "l": workbook(title, head='<!DOCTYPE x [<!ENTITY y "z">]>'), "m": workbook("<row>" + cell("A1", "#DIV/0!", "e") + "</row>"),
    }
    for name, content in files.items():
        (tmp_path / f"{name}.xlsx").write_bytes(content)
    got = {(r.path.rsplit("/", 1)[1][0], r.row_no): (r.cells, r.reason) for r in workbooks.workbook_rows(spark, str(tmp_path), ["code", "name"]).collect()}
    assert got.pop(("a", 4)) == ({"code": "5", "name": "X & Y"}, None) and got.pop(("a", 5)) == ({"code": None, "name": None}, None)
    assert {k[0]: v[1] for k, v in got.items()} == {
        "b": "not_a_workbook", "c": "formula", "d": "string_out_of_range", "e": "cell_without_address", "f": "string_out_of_range", "g": "several_sheets", "h": "no_header", "i": "cell_given_twice",
        "j": "label_given_twice", "k": "part_damaged", "l": "document_type", "m": "error_value",
    }
    assert workbooks.table_rows(files["g"], ["code"], sheet="s1") == []


def test_pdf_without_a_reader_or_damaged(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 damaged")
    assert [(r.page_num, r.text) for r in pages.pdf_pages(spark, str(tmp_path)).collect()] == [(0, None)]


def test_csv_headers_of_every_file(spark, tmp_path):
    write(tmp_path / "a.csv", "x,y\n1,2\n")
    write(tmp_path / "b.csv", "y,x\r\n3,4\r\n5\r\n")
    rows, rejected = delimited.read_csv(spark, str(tmp_path))
    assert sorted(map(str, (tuple(r) for r in rows.select("x", "y").collect()))) == sorted(["('1', '2')", "('4', '3')", "(None, '5')"]) and rejected.count() == 0
    write(tmp_path / "c.csv", "x,z\n1,2\n")
    with pytest.raises(delimited.HeaderError):
        delimited.read_csv(spark, str(tmp_path))


def test_csv_quotes_are_strict(spark, tmp_path):
    p = write(tmp_path / "a.csv", 'a,b\n"5"6,x\n9"9",y\n"ok","o""k"\n"",z\n\n"two\nlines",w\nq"r,s\n1,2\n')
    rows, rejected = delimited.read_csv(spark, p)
    # from the lone quote on, the rest of the file is one open record
    assert sorted(tuple(r) for r in rows.collect()) == sorted([("ok", 'o"k'), ("", "z"), ("two\nlines", "w")])
    assert sorted((r.line_no, r.reason) for r in rejected.collect()) == [(2, "quoting"), (3, "quoting"), (9, "quoting")]


def test_csv_in_small_splits(spark, tmp_path):
    """Records of several lines that lie across the splits of a file, against the standard reader."""
    import csv
    import random

    r = random.Random(7)
    rows = [[str(i), "".join(r.choice(['"', "\n", ",", "x", "é", " "]) for _ in range(r.randint(0, 60)))] for i in range(400)]
    with open(tmp_path / "a.csv", "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator="\n").writerows([["k", "v"], *rows])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got, rejected = delimited.read_csv(spark, str(tmp_path / "a.csv"))
        assert sorted(([x.k, x.v] for x in got.collect()), key=lambda x: int(x[0])) == rows and rejected.count() == 0
        lines = delimited.numbered_lines(spark, str(tmp_path / "a.csv"))
        assert [x.line_no for x in lines.orderBy("line_no").collect()] == list(range(1, lines.count() + 1))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_csv_record_without_end(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(delimited, "MOST_RECORD", 50)
    p = write(tmp_path / "a.csv", 'a\n1\n"open\n' + "x\n" * 100)
    rows, rejected = delimited.read_csv(spark, p)
    assert [r.a for r in rows.collect()] == ["1"] and [(r.line_no, r.line, r.reason) for r in rejected.collect()] == [(3, None, "quoting")]


def test_jsonl_lines_and_fatal(spark, tmp_path):
    p = write(tmp_path / "a.jsonl", '{"a": 1}\r\n\n{"a": }\n[1]\n')
    schema = T.StructType([T.StructField("a", T.LongType())])
    rows, rejected = delimited.read_jsonl(spark, p, schema)
    assert rows.count() == 1 and sorted((r.line_no, r.reason) for r in rejected.collect()) == [(3, "invalid_json"), (4, "record_not_object")]
    with pytest.raises(delimited.RecordError, match="line 3"):
        delimited.read_jsonl(spark, p, schema, fatal=True)


def test_runs_and_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "=1+1"), (2, None), (3, "x")], "k bigint, v string")
    folder = str(tmp_path / "runs")
    sinks.write_run(df, folder, "a")
    sinks.write_run(df.limit(1), folder, "b")
    sinks.write_run(df, folder, "a")
    assert sinks.verify_export(spark, df, folder, "a").count() == 0
    assert {(r.k, r.side) for r in sinks.verify_export(spark, df, folder, "b").collect()} == {(2, "left"), (3, "left")}
    sinks.export_csv(df, str(tmp_path / "csv"))
    assert sorted(tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).na.fill("").collect()) == [("1", "'=1+1"), ("2", ""), ("3", "x")]
    sinks.export_jsonl(df, str(tmp_path / "json"))
    assert '"v":null' in "".join(r[0] for r in spark.read.text(str(tmp_path / "json")).collect())
    assert sinks.finished(spark, str(tmp_path)) is None
    sinks.finish(spark, str(tmp_path), {"rows": 3})
    sinks.finish(spark, str(tmp_path), {"rows": 4})
    assert sinks.finished(spark, str(tmp_path)) == {"rows": 4}


def test_feeds(spark):
    import datetime

    from pyspark.sql import functions as F

    from quernstone.sources import feeds

    row = T.StructType([T.StructField("c", T.StringType())])
    body = lambda page, pages, total, n: '{"page": %d, "pages": %d, "total": %d, "rows": [%s]}' % (page, pages, total, ", ".join(['{"c": "x"}'] * n))
    df = spark.createDataFrame([("ok", 1, body(1, 2, 3, 2)), ("ok", 2, body(2, 2, 3, 1)), ("bad", 1, "{"), ("drift", 1, body(1, 2, 3, 2)), ("drift", 2, body(2, 2, 4, 1)), ("short", 1, body(1, 2, 4, 2)), ("other", 1, body(3, 1, 1, 1))], "f string, p int, b string")
    rows, faults = feeds.paged(df, "f", "p", "b", row)
    assert rows.where("feed = 'ok'").count() == 3
    got = {}
    for r in faults.collect():
        got.setdefault(r.feed, set()).add(r.fault)
    assert got == {"bad": {"invalid_json"}, "drift": {"total_drift", "row_count"}, "short": {"missing_pages", "row_count"}, "other": {"page_mismatch"}}

    rules = [(r"^6\d{5}$", ".S", "A", "equity"), (r"^\d{5}$", ".K", "HK", "equity")]
    s = spark.createDataFrame([("600001", "n"), (" 00700 ", "m"), ("9", "x"), ("600002", " "), ("600003", "a"), ("600003", "b"), (None, "z")], "code string, name string")
    assert sorted((r.ticker or "", r.reason or "") for r in feeds.securities(s, "code", "name", rules).collect()) == [("", "unknown_code"), ("", "unknown_code"), ("00700.K", ""), ("600001.S", ""), ("600002.S", "no_name"), ("600003.S", "repeated_code"), ("600003.S", "repeated_code")]

    late = int(datetime.datetime(2024, 1, 31, 17, tzinfo=datetime.timezone.utc).timestamp() * 1000)
    d = spark.createDataFrame([("p", 1, "Annual report 2023", late), ("p", 2, "notice", None), (None, 3, "x", late), ("p", 4, "x", 0)], "prov string, id bigint, title string, at bigint")
    day = lambda s: F.lit(s).cast("date")
    got = {r.id: (r.document_id, str(r.available_at), r.source_type, r.reason) for r in feeds.disclosures(d, "prov", "id", "title", "at", day("2024-01-01"), day("2024-12-31"), [("(?i)annual report", "annual_report")]).collect()}
    assert got[1] == ("p-1", "2024-02-01", "annual_report", None) and [got[i][3] for i in (2, 3, 4)] == ["no_release", "no_identity", "outside_window"]


def test_manifest(spark, tmp_path):
    import hashlib

    from quernstone.sources import feeds

    (tmp_path / "a.txt").write_bytes(b"one\ftwo")
    (tmp_path / "b.txt").write_bytes(b" ")
    sha = hashlib.sha256(b"one\ftwo").hexdigest()
    m = [("t", "2024-01-02", "https://x/y", "s", "a.txt", sha), ("t", "2024-01-02", "https://x/y", "s", "a.txt", "0" * 64), ("t", "2024-1-2", "https://x/y", "s", "a.txt", None), ("t", "2024-01-02", "https://u:p@x/y", "s", "a.txt", None),
         ("t", "2024-01-02", "https://x/y", "s", "zz.txt", None), (None, "2024-01-02", "https://x/y", "s", "a.txt", None), ("t", "2024-01-02", "https://x/y", "s", "b.txt", None)]
    got = feeds.manifest_pages(spark, spark.createDataFrame(m, feeds.MANIFEST), pages.text_pages(spark, str(tmp_path))).collect()
    good = [r for r in got if r.reject_reason is None]
    assert sorted((r.page_num, r.text) for r in good) == [(1, "one"), (2, "two")] and len({r.document_id for r in good}) == 1
    assert {r.reject_reason for r in got if r.reject_reason} == {"hash_mismatch", "invalid_available_at", "invalid_source_url", "no_file", "missing_fields", "no_text"}
