"""The whole-dashboard plan and the streaming ingest."""

import os

import pytest

from session_rows import SF001, sessions_frame
from convolytics.plans.catalog import QUERIES
from convolytics.plans.dashboard import dashboard, materialize
from convolytics.sinks.reports import write_csv
from convolytics.sources import fixtures
from convolytics.streaming.ingest import export_stream, running_kpis, session_stream


@pytest.mark.parametrize("how", ["checkpoint", "table", "cache", "none"])
def test_dashboard_matches_catalog(spark, how):
    reports = dashboard(fixtures.sessions(spark, SF001), materialize_how=how,
                        only=["topic_summary_report", "kpi_quality", "xt_topic_status_margins"])
    assert set(reports) == {"topic_summary_report", "kpi_quality", "xt_topic_status_margins"}
    for name, df in reports.items():
        expected = QUERIES[name](spark, SF001)
        assert sorted(map(tuple, df.collect())) == sorted(map(tuple, expected.collect()))


def test_checkpoint_cuts_lineage(spark):
    df = materialize(fixtures.sessions(spark, SF001), "checkpoint")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_dashboard_without_quality_columns(spark):
    base = fixtures.sessions(spark, SF001).drop("spam_check")
    reports = dashboard(base, materialize_how="none")
    assert "kpi_quality" not in reports and "xt_intent_spam" not in reports
    assert "kpi_overview" in reports


def test_stream_ingest_and_running_kpis(spark, tmp_dir):
    src = os.path.join(tmp_dir, "incoming")
    df = sessions_frame(spark, [("a", "q one", "r", "resolved", "positive", "1", "accurate", "spam"),
                                ("b", "q", None, "user_drop_off", "negative", "2", "accurate", "not_spam")])
    raw = df.drop("query_length", "query_word_count", "resolution_length", "resolution_word_count")
    write_csv(raw.limit(1), os.path.join(src, "batch1"))
    write_csv(raw.filter("TOPIC = 'b'"), os.path.join(src, "batch2"))
    stream = session_stream(spark, os.path.join(src, "*"), raw.columns)
    q = export_stream(stream, os.path.join(tmp_dir, "sink"), os.path.join(tmp_dir, "cp-export"))
    q.awaitTermination(120)
    out = spark.read.parquet(os.path.join(tmp_dir, "sink"))
    assert sorted(r.query_word_count for r in out.collect()) == [1, 2]

    k = (running_kpis(session_stream(spark, os.path.join(src, "*"), raw.columns))
         .writeStream.format("memory").queryName("kpis_test").outputMode("complete")
         .option("checkpointLocation", os.path.join(tmp_dir, "cp-kpi"))
         .trigger(availableNow=True).start())
    k.awaitTermination(120)
    r = spark.sql("SELECT * FROM kpis_test").first()
    assert r.total_conversations == 2 and r.resolution_rate_pct == 50.0 and r.approx_unique_topics == 2


def test_dashboard_tables_clean_up(spark):
    from session_rows import SF001
    from convolytics.plans.dashboard import dashboard_tables
    from convolytics.sources import fixtures

    with dashboard_tables(fixtures.sessions(spark, SF001), only=["kpi_overview", "topic_counts"]) as tables:
        assert set(tables) == {"kpi_overview", "topic_counts"}
        folder = os.path.dirname(tables["topic_counts"].inputFiles()[0])[len("file:") :]
        folder = "/" + folder.lstrip("/")
        assert os.path.isdir(folder) and tables["kpi_overview"].first().total_conversations == 48
    assert not os.path.exists(folder)


def test_two_sinks_both_receive_every_row(spark, tmp_dir):
    src = os.path.join(tmp_dir, "src")
    os.makedirs(src)
    from convolytics.schema import DEFAULT_COLUMNS

    names = list(DEFAULT_COLUMNS.required)
    with open(os.path.join(src, "a.csv"), "w") as f:
        f.write(",".join(names) + "\n" + ",".join("x" for _ in names) + "\n")
    for k in ("one", "two"):
        q = export_stream(session_stream(spark, src, names), os.path.join(tmp_dir, k), os.path.join(tmp_dir, f"cp-{k}"))
        q.awaitTermination()
        assert spark.read.parquet(os.path.join(tmp_dir, k)).count() == 1
