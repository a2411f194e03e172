"""CSV / Excel / Parquet loading, validation and report round trips."""

import os
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from session_rows import sessions_frame
from convolytics.schema import SchemaError
from convolytics.sinks.reports import export_reports, report_path, write_csv
from convolytics.sources.csv import UnsupportedFormatError, detect_format, load_sessions, read_csv, read_csv_header
from convolytics.sources.excel import read_xlsx

REQ = "TOPIC,TOPIC_DESCRIPTION,USER_QUERY,RESOLUTION,RESOLUTION_STATUS,RESOLUTION_STATUS_REASONING,USER_SENTIMENT,USER_SENTIMENT_REASONING,SESSION_ID"


def _write(d, name, text, bom=False):
    p = os.path.join(d, name)
    with open(p, "wb") as f:
        if bom:
            f.write(b"\xef\xbb\xbf")
        f.write(text.encode("utf-8"))
    return p


def test_csv_quotes_newlines_tokens_short_rows(spark, tmp_dir):
    p = _write(
        tmp_dir,
        "s.csv",
        REQ + ",extra\n"
        'a,d,"say ""hi""\nthen go",r,resolved,x,positive,y,01,e1\n'
        "\n"
        "NA,null,N/A,nan,None,,NULL,n/a, padded ,NaN\n"
        "b,d,q,r,resolved\n",
        bom=True,
    )
    df = load_sessions(spark, p)
    assert df.columns == REQ.split(",") + ["extra"]
    rows = df.collect()
    assert len(rows) == 3  # blank line skipped
    assert rows[0].USER_QUERY == 'say "hi"\nthen go'
    assert rows[0].SESSION_ID == "01"  # kept as text
    assert [rows[1][c] for c in df.columns[:8]] == [None] * 8
    assert rows[1].SESSION_ID == " padded "  # not trimmed
    assert rows[1].extra is None
    assert rows[2].TOPIC == "b" and rows[2].RESOLUTION_STATUS == "resolved" and rows[2].SESSION_ID is None  # short row kept


def test_csv_long_row_fails(spark, tmp_dir):
    p = _write(tmp_dir, "l.csv", "A,B\n1,2\n3,4,5\n")
    with pytest.raises(Exception, match="more than 2 fields"):
        read_csv(spark, p).collect()
    with pytest.raises(Exception, match="more than 2 fields"):
        read_csv(spark, p).count()
    with pytest.raises(Exception, match="more than 2 fields"):
        read_csv(spark, p).select("B").collect()
    p2 = _write(tmp_dir, "ok.csv", 'A,B\n1,"x,y"\n')
    assert [tuple(r) for r in read_csv(spark, p2).collect()] == [("1", "x,y")]


def test_csv_header_checks(spark, tmp_dir):
    dup = _write(tmp_dir, "dup.csv", "A,a,B\n1,2,3\n")
    with pytest.raises(SchemaError, match="Duplicate"):
        read_csv_header(spark, dup)
    wrong_case = _write(tmp_dir, "case.csv", REQ.replace("TOPIC,", "Topic,", 1) + "\n" + ",".join("x" * 9) + "\n")
    with pytest.raises(SchemaError, match="Missing required columns: TOPIC"):
        load_sessions(spark, wrong_case)
    missing = _write(tmp_dir, "miss.csv", "TOPIC,USER_QUERY\n1,2\n")
    with pytest.raises(SchemaError) as e:
        load_sessions(spark, missing)
    assert str(e.value).startswith(
        "Missing required columns: TOPIC_DESCRIPTION, RESOLUTION, RESOLUTION_STATUS, RESOLUTION_STATUS_REASONING, "
        "USER_SENTIMENT, USER_SENTIMENT_REASONING, SESSION_ID"
    )


def test_csv_files_with_other_header_order_fail(spark, tmp_dir):
    d = os.path.join(tmp_dir, "many")
    os.makedirs(d)
    _write(d, "f1.csv", "A,B\n1,2\n")
    _write(d, "f2.csv", "B,A\n3,4\n")
    with pytest.raises(Exception, match="CSV header does not conform"):
        read_csv(spark, d).collect()


def test_format_dispatch():
    assert detect_format("x.csv") == "csv"
    assert detect_format("x.xlsx") == "xlsx"
    assert detect_format("x.parquet") == "parquet"
    with pytest.raises(UnsupportedFormatError, match="Cannot tell the format"):
        detect_format("x.CSV")
    with pytest.raises(UnsupportedFormatError):
        detect_format("x.xls")


def test_parquet_source_casts_contract_columns(spark, tmp_dir):
    df = sessions_frame(spark, [("a", "q", "r", "resolved", "positive", "1", "accurate", "spam")]).withColumn(
        "SESSION_ID", F.lit(7)
    )
    p = os.path.join(tmp_dir, "in.parquet")
    df.write.parquet(p)
    got = load_sessions(spark, p)
    assert dict(got.dtypes)["SESSION_ID"] == "string"
    assert got.first().SESSION_ID == "7"


def test_full_dataset_round_trip(spark, tmp_dir):
    rows = [
        ("a", 'he said "no"\nthen left', "r, with comma", "resolved", "positive", "1", "accurate", "spam"),
        ("b", "", None, None, "negative", None, None, "not_spam"),
    ]
    df = sessions_frame(spark, rows)
    path = write_csv(df, os.path.join(tmp_dir, "full.csv"))
    back = read_csv(spark, path)
    assert back.columns == df.columns
    expected = sorted(tuple(None if v is None or v == "" else str(v) for v in r) for r in df.collect())
    assert sorted(tuple(r) for r in back.collect()) == expected


def test_export_reports(spark, tmp_dir):
    df = sessions_frame(spark, [("a", "q", "r", "resolved", "positive", "1", "accurate", "spam"),
                                ("b", "q q", "r", "unresolved", "negative", "2", "accurate", "spam")])
    ts = datetime(2024, 1, 2, 3, 4, 5)
    paths = export_reports(df, tmp_dir, ts, single_file_summaries=True)
    assert paths["topic_summary"] == report_path(tmp_dir, "topic_summary", ts)
    assert paths["topic_summary"].endswith("topic_summary_20240102_030405.csv")
    summary = spark.read.option("header", True).csv(paths["topic_summary"])
    assert summary.columns == ["TOPIC", "Total_Conversations", "Resolution_Rate_%", "Positive_Sentiment_%",
                               "Avg_Query_Words", "Avg_Response_Words"]
    res = spark.read.option("header", True).csv(paths["resolution_analysis"])
    assert res.columns == ["TOPIC", "resolved", "unresolved", "All"]
    assert res.collect()[-1].TOPIC == "All"
    assert read_csv(spark, paths["full_dataset"]).count() == 2
    with pytest.raises(Exception):
        export_reports(df, tmp_dir, ts)  # never overwrites


def _xlsx(path, rows):
    shared = []

    def cell(ref, v):
        if v is None:
            return ""
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><v>{v}</v></c>'
        shared.append(v)
        return f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>'

    body = []
    for i, r in enumerate(rows, start=1):
        cells = "".join(cell(f"{chr(65 + j)}{i}", v) for j, v in enumerate(r))
        body.append(f'<row r="{i}">{cells}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rns = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    sst = "".join(f"<si><t>{s}</t></si>" for s in shared)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rns}><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr(
            "xl/_rels/workbook.xml.rels",
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            '<Relationship Id="rId1" Type="worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        )
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData>{"".join(body)}</sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{sst}</sst>")


def test_xlsx_source(spark, tmp_dir):
    d = os.path.join(tmp_dir, "wb")
    os.makedirs(d)
    header = REQ.split(",")
    _xlsx(os.path.join(d, "a.xlsx"), [header, ["t1", "d", "q", None, "resolved", "x", "positive", "y", 12], [None] * 9,
                                      ["t2", "d", "NA", "r", "resolved", "x", "negative", "y", 3.5]])
    _xlsx(os.path.join(d, "b.xlsx"), [header, ["t3", "d", "q", "r", "user_drop_off"]])
    df = load_sessions(spark, d, fmt="xlsx")
    assert df.columns == header
    rows = sorted(tuple(r) for r in df.collect())
    assert rows[0] == ("t1", "d", "q", None, "resolved", "x", "positive", "y", "12")
    assert rows[1] == ("t2", "d", None, "r", "resolved", "x", "negative", "y", "3.5")
    assert rows[2][:5] == ("t3", "d", "q", "r", "user_drop_off") and rows[2][5:] == (None,) * 4
    _xlsx(os.path.join(d, "c.xlsx"), [list(reversed(header)), ["x"] * 9])
    with pytest.raises(Exception, match="differs"):
        read_xlsx(spark, d, header).collect()


def test_long_quoted_fields_in_short_and_long_rows(spark, tmp_dir):
    import os

    big = "x" * 1_000_000
    short, long = os.path.join(tmp_dir, "short.csv"), os.path.join(tmp_dir, "long.csv")
    with open(short, "w") as f:
        f.write(f'a,b,c\n"{big}"\n')
    with open(long, "w") as f:
        f.write(f'a,b,c\n"{big}",2,3,4\n')
    rows = read_csv(spark, short).collect()
    assert [(len(r.a), r.b, r.c) for r in rows] == [(1_000_000, None, None)]
    with pytest.raises(Exception, match="more than 3 fields"):
        read_csv(spark, long).collect()


def test_workbooks_round_trip(spark):
    from convolytics.sources.excel import make_workbooks, parse_workbooks

    rows = [("a", "x\r\ny\tz", "1"), ("_x000D_ <&>", "\x0b\x01 ü 日本 ", None), (None, None, "NA"), (None, None, None)] + [(str(i), "é" * i, "") for i in range(30)]
    df = spark.createDataFrame(rows, "`A b` string, B string, C string").repartition(2)
    books = make_workbooks(df, book_rows=10)
    assert books.count() >= 4
    got = parse_workbooks(books, df.columns)
    want = [tuple(None if v in ("", "NA") else v for v in r) for r in rows if any(r)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_a_long_sheet_is_read_in_bounded_memory():
    import tracemalloc

    from convolytics.sources.excel import WorkbookWriter, workbook_rows

    book = WorkbookWriter(["A", "B"])
    for i in range(60_000):
        book.add([f"value {i}", "some text " * 5])
    content = book.close()
    tracemalloc.start()
    n = sum(1 for _ in workbook_rows(content))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 60_001 and peak < 4_000_000


def test_shared_strings_are_held_in_one_buffer(tmp_dir):
    import tracemalloc

    from convolytics.sources.excel import workbook_rows

    path = os.path.join(tmp_dir, "shared.xlsx")
    _xlsx(path, [["A"]] + [[f"string number {i}"] for i in range(30_000)])
    content = open(path, "rb").read()
    tracemalloc.start()
    rows = workbook_rows(content)
    assert next(rows) == ["A"] and next(rows) == ["string number 0"]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < len(content) + 4_000_000 and sum(1 for _ in rows) == 29_999
