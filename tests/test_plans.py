"""Physical-plan properties the operators promise."""

import pytest

from session_rows import SF001
from convolytics.plans.catalog import QUERIES


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_udf(spark, name):
    plan = _plan(QUERIES[name](spark, SF001))
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF"):
        assert node not in plan


@pytest.mark.parametrize("name", ["xt_status_sentiment", "xt_intent_spam"])
def test_crosstabs_are_one_aggregate_without_joins_of_their_own(spark, name):
    from convolytics.plans.catalog import featured_sessions

    own = _plan(QUERIES[name](spark, SF001)).count("Join")
    assert own == _plan(featured_sessions(spark, SF001).select("TOPIC", "RESOLUTION_STATUS", "USER_SENTIMENT")).count("Join")


def test_fixture_has_no_window_on_conversation(spark):
    plan = _plan(QUERIES["text_features"](spark, SF001))
    assert "Window" not in plan


def test_histogram_filter_not_pushed_into_scan(spark):
    # the bin expression must not be re-inlined into scan filters
    plan = _plan(QUERIES["hist_query_words"](spark, SF001))
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and not any("regexp_replace" in line for line in filters)


def test_keywords_partially_aggregated(spark):
    df = QUERIES["top_keywords_documents"](spark, SF001)
    plan = _plan(df)
    assert "partial_count" in plan
    assert "TakeOrderedAndProject" in plan


def test_parquet_scans_are_pruned(spark):
    plan = _plan(QUERIES["topic_counts"](spark, SF001))
    # documents: only the three columns the fixture needs, never the text
    assert "ReadSchema: struct<doc_id:bigint,lang:string,source:string>" in \
        QUERIES["topic_counts"](spark, SF001)._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert plan


def test_fixture_shuffles_each_text_once(spark):
    # As at scale (nothing broadcast): only the user turns and the next turns
    # carry text through a shuffle, both keyed by (conv_id, turn); the
    # per-conversation join moves keys and labels only.
    import re

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = QUERIES["text_features"](spark, SF001)
        text = df._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    details = text.split("\n\n")
    exchanges = [d for d in details if re.match(r"\(\d+\) Exchange", d.strip())]
    with_text = [d for d in exchanges if re.search(r"Input \[\d+\]: \[[^\]]*\b(text|nt)#", d)]
    assert len(with_text) == 2
    for d in with_text:
        assert re.search(r"hashpartitioning\(conv_id#\d+L, turn#\d+L", d)


@pytest.mark.parametrize(
    "name", ["text_stats", "topic_summary_report", "avg_query_words_by_topic", "avg_resolution_words_by_status", "key_insights", "hist_query_words"]
)
def test_word_counts_cross_the_shuffle_without_their_texts(spark, name):
    import re

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = QUERIES[name](spark, SF001)
        text = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanges = [d for d in text.split("\n\n") if re.match(r"\(\d+\) Exchange", d.strip())]
    assert exchanges and not any(re.search(r"Input \[\d+\]: \[[^\]]*\b(text|nt)#", d) for d in exchanges)
