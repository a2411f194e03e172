"""One CSV file read by many tasks equals Spark's own reader."""

import csv
import io
import os
import tempfile

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from convolytics.schema import SchemaError
from convolytics.sources.csv import load_sessions, read_csv
from convolytics.sources.csv_split import split_records, stays_open
from session_rows import sessions_frame

SMALL = {"spark.sql.files.maxPartitionBytes": "200", "spark.sql.files.openCostInBytes": "1", "spark.sql.shuffle.partitions": "3"}


@pytest.fixture()
def ranges(spark, monkeypatch):
    """Byte ranges of 200 bytes; the reports are kept in memory, since their
    Parquet files would be read in as small ranges."""
    monkeypatch.setattr("convolytics.sources.csv_split.stored_rows", lambda df, name: df.coalesce(2).persist())
    before = {k: spark.conf.get(k) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def write(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(text.encode())
    return path


def same(spark, path):
    a, b = read_csv(spark, path), read_csv(spark, path, split=True)
    assert a.columns == b.columns
    rows = [sorted(map(repr, df.collect())) for df in (a, b)]
    assert rows[0] == rows[1]
    return b


def test_quoted_newlines_over_many_ranges(spark, tmp_dir, ranges):
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(["A", "B", "C"])
    for i in range(40):
        w.writerow([i, f'line one\nline "two", {i}\n\n' * (1 + i % 5), "x" * (i * 7 % 90)])
    path = write(tmp_dir, "q.csv", out.getvalue())
    got = same(spark, path)
    assert got.count() == 40
    assert spark.read.text(path).rdd.getNumPartitions() > 10
    # records are put together in several tasks
    assert split_records(spark, [path]).count() == 41


def test_blank_lines_carriage_returns_mark_short_rows_and_two_files(spark, tmp_dir, ranges):
    d = os.path.join(tmp_dir, "many")
    os.makedirs(d)
    write(d, "a.csv", '﻿A,B\r\n\r\n1,"two\nlines"\r\n"A","B"\r\nA,B\r\n"",NA\r\n5\r\n')
    write(d, "b.csv", "A,B\n" + "".join(f'{i},"{"y" * 50}\n"\n' for i in range(9)))
    same(spark, d)


def test_long_field_without_a_record_start_in_its_ranges(spark, tmp_dir, ranges):
    path = write(tmp_dir, "long.csv", 'A,B\n1,"' + "text\n" * 200 + '"\n2,"a ""b"" c"\n3,d"e"f\n')
    rows = sorted(tuple(r) for r in same(spark, path).collect())
    assert rows[0] == ("1", "text\n" * 200) and rows[2] == ("3", 'd"e"f')


def test_header_and_long_rows_are_checked(spark, tmp_dir, ranges):
    d = os.path.join(tmp_dir, "other")
    os.makedirs(d)
    write(d, "a.csv", "A,B\n1,2\n")
    write(d, "b.csv", "B,A\n1,2\n")
    with pytest.raises(SchemaError, match="does not conform"):
        read_csv(spark, d, ["A", "B"], split=True)
    long = write(tmp_dir, "l.csv", "A,B\n1,2\n3,4,\n")
    with pytest.raises(Exception, match="more than 2 fields"):
        read_csv(spark, long, split=True).count()


def test_load_sessions(spark, tmp_dir, ranges):
    rows = [(f"t{i}", f'q "{i}"\nmore, text', None, "resolved", "positive", str(i)) for i in range(20)]
    from convolytics.sinks.reports import write_csv

    path = write_csv(sessions_frame(spark, rows, quality=False), f"{tmp_dir}/s.csv")
    a, b = (load_sessions(spark, path, "csv", split=s) for s in (False, True))
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect())) and b.count() == 20


def states(text):
    """The state at the end of each line, character by character."""
    state, out = "start", []
    for c in text:
        if c == "\n":
            out.append(state == "quoted")
            if state != "quoted":
                state = "start"
        elif state == "quoted":
            state = "quote" if c == '"' else state
        elif state == "quote" and c == '"':
            state = "quoted"
        elif c == ",":
            state = "start"
        elif state == "start":
            state = "quoted" if c == '"' else "plain"
        else:
            state = "plain"
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='a",\n', max_size=60))
def test_state_of_lines(text):
    text += "\n"
    is_open, got = False, []
    for line in text.split("\n")[:-1]:
        is_open = stays_open(line, is_open)
        got.append(is_open)
    assert got == states(text)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(*[st.text(alphabet='ab ,"\n', max_size=40)] * 2), min_size=1, max_size=25))
def test_drawn_files(spark, ranges, rows):
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_ALL)
    w.writerows([("A", "B"), *rows])
    same(spark, write(tempfile.mkdtemp(prefix="convolytics-test-", dir="/tmp"), "d.csv", out.getvalue()))
