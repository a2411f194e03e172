"""Null, denominator, tie and total rules (SURVEY traps) on small tables."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from session_rows import sessions_frame
from convolytics.operators import crosstab as xt
from convolytics.operators import frequency as fq
from convolytics.operators import grouped as gr
from convolytics.operators import kpis
from convolytics.operators import profile as pf
from convolytics.operators import text as tx

ROWS = [
    # topic, query, resolution, status, sentiment, session, intent, spam
    ("a", "how do I fix the engine", "check it", "resolved", "positive", "1", "accurate", "not_spam"),
    ("a", "engine noise again", None, "user_drop_off", "negative", "2", "not_accurate", "spam"),
    ("a", None, "ok", None, None, None, None, "not_spam"),
    ("b", "service booking", "done", "resolved", "neutral", "3", "accurate", "not_spam"),
    ("b", "booking engine", "yes", "unresolved", "negative", "3", "accurate", "spam"),
    ("c", "price", "sure", None, "positive", "4", "accurate", "not_spam"),
    (None, "price engine", "no", "resolved", "positive", "5", None, "not_spam"),
]


@pytest.fixture()
def df(spark):
    return sessions_frame(spark, ROWS)


def test_kpi_overview_denominators(df):
    r = kpis.kpi_overview(df).first()
    assert r.total_conversations == 7
    assert r.unique_topics == 3  # null topic not counted
    assert r.unique_sessions == 5  # null id not counted, "3" twice
    assert r.resolution_rate_pct == pytest.approx(3 / 7 * 100)  # null status stays in the denominator
    assert r.negative_sentiment_pct == pytest.approx(2 / 7 * 100)
    assert r.drop_off_rate_pct == pytest.approx(1 / 7 * 100)


def test_status_shares_two_denominators(df):
    pie = {r[0]: r.pct_of_non_null for r in fq.status_counts(df).collect()}
    kpi = {r[0]: r.pct_of_rows for r in fq.kpi_status(df).collect()}
    assert pie["resolved"] == pytest.approx(3 / 5 * 100)
    assert kpi["resolved"] == pytest.approx(3 / 7 * 100)
    assert sum(pie.values()) == pytest.approx(100.0)
    assert None not in pie


def test_topic_summary_counts_non_null_ids_but_divides_by_rows(df):
    rows = {r.TOPIC: r for r in gr.topic_summary_report(df).collect()}
    assert set(rows) == {"a", "b", "c"}  # null topic vanishes
    a = rows["a"]
    assert a.total_conversations == 2  # one null SESSION_ID
    assert a.resolution_rate_pct == round(100 / 3, 2)
    assert a.positive_sentiment_pct == round(100 / 3, 2)
    ordered = [r.TOPIC for r in gr.topic_summary_report(df).collect()]
    assert ordered == ["a", "b", "c"]  # 2, 2, 1: tie broken by topic


def test_accuracy_band_and_null_intent_in_denominator(df):
    res = {r.RESOLUTION_STATUS: (r.accuracy_pct, r.band) for r in gr.accuracy_by_status(df).collect()}
    assert res["resolved"] == (round(2 / 3 * 100, 2), "medium")  # one null intent, still counted
    assert res["user_drop_off"] == (0.0, "poor")
    spam = {r.USER_SENTIMENT: (r.spam_pct, r.band) for r in gr.spam_by_sentiment(df).collect()}
    assert spam["negative"] == (100.0, "poor")
    assert spam["positive"] == (0.0, "good")


def test_kpi_sentiment_fixed_order_and_omission(spark):
    df = sessions_frame(spark, [(t, "q", "r", "resolved", s, "1", "accurate", "spam") for t, s in
                                [("a", "negative"), ("a", "positive"), ("b", "positive"), ("b", None)]])
    rows = fq.kpi_sentiment(df).collect()
    assert [(r.USER_SENTIMENT, r.n, r.label) for r in rows] == [("positive", 2, "Positive"), ("negative", 1, "Negative")]
    assert rows[0].pct_of_rows == 50.0


def test_kpi_quality_absent_labels_are_zero(spark):
    df = sessions_frame(spark, [("a", "q", "r", "resolved", "positive", "1", "accurate", "not_spam")])
    r = kpis.kpi_quality(df).first()
    assert (r.accurate_count, r.not_accurate_count, r.spam_count, r.not_spam_count) == (1, 0, 0, 1)
    assert r.accurate_pct == 100.0 and r.spam_pct == 0.0


def test_quality_needs_both_columns(spark):
    df = sessions_frame(spark, ROWS, quality=False).drop("spam_check")
    with pytest.raises(ValueError):
        kpis.kpi_quality(df)


def test_key_insights(df):
    r = kpis.key_insights(df).first()
    assert r.top_topic == "a" and r.top_topic_count == 3
    assert r.resolution_advice == "focus on improving resolution rates"
    assert r.sentiment_advice == "address negative sentiment"
    assert r.avg_query_words == pytest.approx(sum(len((x[1] or "").split()) for x in ROWS) / 7)


def test_top_topic_tie_goes_to_smaller_key(spark):
    df = sessions_frame(spark, [("z", "q", "r", "resolved", "positive", "1", "a", "s"),
                                ("y", "q", "r", "resolved", "positive", "2", "a", "s")])
    assert [tuple(r) for r in fq.top_topic(df).collect()] == [("y", 1)]
    assert kpis.key_insights(df).first().top_topic == "y"


def test_crosstab_excludes_null_pairs_and_fills_zero(df):
    rows = {r.RESOLUTION_STATUS: r.asDict() for r in xt.xt_status_sentiment(df).collect()}
    assert set(rows) == {"resolved", "unresolved", "user_drop_off"}
    assert rows["resolved"] == {"RESOLUTION_STATUS": "resolved", "negative": 0, "neutral": 1, "positive": 2}


def test_crosstab_margins(df):
    out = xt.xt_topic_status_margins(df)
    assert out.columns == ["TOPIC", "resolved", "unresolved", "user_drop_off", "All"]
    rows = [r.asDict() for r in out.collect()]
    assert [r["TOPIC"] for r in rows] == ["a", "b", "All"]  # c has only a null status
    total = rows[-1]
    assert total == {"TOPIC": "All", "resolved": 2, "unresolved": 1, "user_drop_off": 1, "All": 4}
    assert sum(r["All"] for r in rows[:-1]) == total["All"]


def test_crosstab_margin_label_collision(spark):
    df = sessions_frame(spark, [("All", "q", "r", "resolved", "positive", "1", "a", "s")])
    with pytest.raises(Exception, match="All"):
        xt.xt_topic_status_margins(df).collect()
    df2 = sessions_frame(spark, [("x", "q", "r", "All", "positive", "1", "a", "s")])
    with pytest.raises(ValueError, match="All"):
        xt.xt_topic_status_margins(df2)


def test_crosstab_long_margins(df):
    rows = {(r.TOPIC, r.RESOLUTION_STATUS): r.n for r in xt.crosstab_long(df, "TOPIC", "RESOLUTION_STATUS", margins=True).collect()}
    assert rows[("All", "All")] == 4
    assert rows[("a", "All")] == 2 and rows[("All", "resolved")] == 2


def test_topk_crosstab_keeps_topic_without_pairs(spark):
    # topic "c" is the most frequent but all its statuses are null
    rows = [("c", "q", "r", None, "positive", str(i), "a", "s") for i in range(3)]
    rows += [("a", "q", "r", "resolved", "positive", "9", "a", "s"), ("b", "q", "r", "unresolved", None, "8", "a", "s")]
    df = sessions_frame(spark, rows)
    out = xt.crosstab_top(df, "TOPIC", "RESOLUTION_STATUS", 2)
    got = [tuple(r) for r in out.collect()]
    assert out.columns == ["rank", "TOPIC", "resolved", "unresolved"]
    assert got == [(1, "c", 0, 0), (2, "a", 1, 0)]  # "unresolved" kept though only seen outside the top 2


def test_histogram_matches_numpy(spark):
    values = [0, 1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 59, 59, 7, 7, 7]
    df = spark.createDataFrame([(v,) for v in values], "x bigint")
    out = tx.histogram(df, "x").collect()
    counts, edges = np.histogram(values, bins=20)
    assert [r.n for r in out] == counts.tolist()
    assert [r.bin_start for r in out] == edges[:-1].tolist()
    assert [r.bin_end for r in out] == edges[1:].tolist()


def test_histogram_single_value(spark):
    df = spark.createDataFrame([(4,), (4,)], "x bigint")
    out = tx.histogram(df, "x").collect()
    counts, edges = np.histogram([4, 4], bins=20)
    assert [r.n for r in out] == counts.tolist()
    assert [r.bin_start for r in out] == pytest.approx(edges[:-1].tolist())


@pytest.mark.parametrize("hi", [1, 3, 7, 19, 20, 41, 59, 97, 123, 199])
def test_histogram_edges_like_numpy(spark, hi):
    values = list(range(0, hi + 1))
    df = spark.createDataFrame([(v,) for v in values], "x bigint")
    got = [r.n for r in tx.histogram(df, "x").collect()]
    assert got == np.histogram(values, bins=20)[0].tolist()


def test_text_stats_median_interpolates(spark):
    df = sessions_frame(spark, [("a", " ".join(["w"] * n), None, "resolved", "positive", "1", "a", "s") for n in (1, 2, 3, 10)])
    r = tx.text_stats(df).first()
    assert (r.query_words_mean, r.query_words_median, r.query_words_max, r.query_words_min) == (4.0, 2.5, 10, 1)
    assert (r.resolution_words_median, r.resolution_words_max) == (0.0, 0)


def test_top_keywords_counts_and_ties(spark):
    df = sessions_frame(spark, [
        ("a", "Engine engine ENGINE noise", None, None, None, None, None, None),
        ("a", "noise brake the and", None, None, None, None, None, None),
        ("a", "brake_pad élan abc123 zzz", None, None, None, None, None, None),
    ])
    got = [tuple(r) for r in tx.top_keywords(df, top_n=3).collect()]
    assert got == [("engine", 3), ("noise", 2), ("brake", 1)]
    extra = [tuple(r) for r in tx.top_keywords(df, top_n=5, extra_stop_words=["engine"]).collect()]
    assert ("engine", 3) not in extra


def test_profile_shape_duplicates_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, None), (2, "x"), (2, None)], "a int, b string")
    r = pf.profile_shape(df).first()
    assert (r.row_count, r.column_count, r.missing_cells, r.duplicate_rows) == (5, 2, 4, 2)
    r2 = pf.profile_shape(df, duplicates=False).first()
    assert (r2.row_count, r2.missing_cells) == (5, 4)


def test_profile_missing_and_nan(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "b"), (2.0, "c")], "x double, s string")
    rows = [tuple(r) for r in pf.profile_missing(df).collect()]
    assert rows == [(1, "x", 2, 50.0), (2, "s", 1, 25.0)]


def test_profile_types(df):
    rows = pf.profile_types(df).collect()
    assert rows[0].column_name == "TOPIC" and rows[0].data_type == "string"
    assert rows[-1].column_name == "resolution_word_count" and rows[-1].data_type == "bigint"
    assert [r.position for r in rows] == list(range(1, len(df.columns) + 1))
    counts = {r.column_name: r.non_null_count for r in rows}
    assert counts["TOPIC"] == 6 and counts["SESSION_ID"] == 6 and counts["query_word_count"] == 7


def test_preview_drops_suggestion(spark, df):
    with_s = df.withColumn("suggestion", F.lit("x"))
    out = pf.preview(with_s, n=3)
    assert "suggestion" not in out.columns
    assert out.count() == 3
    assert [r.TOPIC for r in out.collect()] == [None, "a", "a"]


def test_features_never_null(df):
    r = df.agg(*[F.sum(F.col(c).isNull().cast("int")) for c in
                 ["query_length", "query_word_count", "resolution_length", "resolution_word_count"]]).first()
    assert tuple(r) == (0, 0, 0, 0)


def test_empty_table(spark):
    df = sessions_frame(spark, []).limit(0)
    r = kpis.kpi_overview(df).first()
    assert r.total_conversations == 0 and r.resolution_rate_pct is None
    assert fq.top_topic(df).count() == 0
    assert all(r.n == 0 for r in tx.hist_query_words(df).collect())


def test_profile_shape_on_nulls_nan_zeros_and_a_hot_group(spark):
    import pandas as pd

    rows = [(1, None, 0.0), (1, None, -0.0), (None, 1, 0.0), (None, None, None), (None, None, None),
            (2, None, float("nan")), (2, None, float("nan")), (3, 4, 1.5)] + [(7, 7, 7.0)] * 40
    df = spark.createDataFrame(rows, "a int, b int, c double")
    r = pf.profile_shape(df).first()
    pdf = pd.DataFrame(rows, columns=["a", "b", "c"]).replace({-0.0: 0.0})
    assert r.row_count == len(rows)
    assert r.missing_cells == int(pdf.isna().sum().sum())
    assert r.duplicate_rows == int(pdf.duplicated().sum()) == 42


def test_profile_shape_no_duplicates_and_empty(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(50)], "a int, b string")
    r = pf.profile_shape(df).first()
    assert (r.row_count, r.missing_cells, r.duplicate_rows) == (50, 0, 0)
    empty = pf.profile_shape(df.filter("a < 0")).first()
    assert (empty.row_count, empty.missing_cells, empty.duplicate_rows) == (0, 0, 0)


@pytest.mark.parametrize("threshold", ["-1", "10485760"])
def test_profile_shape_is_one_scan_and_one_keyed_shuffle_at_any_threshold(spark, threshold):
    from session_rows import SF001

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        out = pf.profile_shape(spark.read.parquet(f"{SF001}/documents.parquet").drop("doc_id"))
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("FileScan") == 1 and plan.count("hashpartitioning") == 1 and "Join" not in plan


def test_profile_shape_tells_shifted_and_nested_values_apart(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "-"), ("-", None), ("1:a", ""), ("", "1:a")], "a string, b string")
    assert pf.profile_shape(df).first().duplicate_rows == 0
    nested = df.select(F.array("a", "b").alias("x"), F.struct("a", "b").alias("y"), F.to_timestamp(F.lit("2020-01-01")).alias("t"))
    assert pf.profile_shape(nested.union(nested)).first().duplicate_rows == 6


def test_crosstabs_take_any_label_and_keep_nothing(spark):
    labels = ["resolved", "Resolved", "v1.0", "rank", "a`b", "T", "_row", "x y"]
    kept = spark.sparkContext._jsc.getPersistentRDDs().size()
    df = spark.createDataFrame([(f"t{i % 3}", v) for i, v in enumerate(labels * 4)], "T string, L string")
    names = sorted(labels)
    for out, keys in (
        (xt.crosstab(df, "T", "L"), ["T"]),
        (xt.crosstab(df, "T", "L", margins=True), ["T"]),
        (xt.crosstab_top(df, "T", "L", 2), ["rank", "T"]),
    ):
        assert out.columns[: len(keys) + len(names)] == keys + names
        assert sum(sum(r[len(keys) : len(keys) + len(names)]) for r in out.collect() if r[len(keys) - 1] != "All") in (32, 21, 22)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == kept


def test_crosstab_sees_files_added_between_calls(spark, tmp_dir):
    path = f"{tmp_dir}/pairs"
    spark.createDataFrame([("a", "x")] * 3, "T string, L string").write.parquet(path)
    assert xt.crosstab(spark.read.parquet(path), "T", "L").collect()[0].x == 3
    spark.createDataFrame([("a", "x")] * 3, "T string, L string").write.mode("append").parquet(path)
    assert xt.crosstab(spark.read.parquet(path), "T", "L").collect()[0].x == 6


def test_crosstab_margins_of_nothing_are_zero_and_all_is_refused_in_long_form(spark):
    none = spark.createDataFrame([(None, "x"), ("a", None)], "T string, L string")
    assert [tuple(r) for r in xt.crosstab(none, "T", "L", margins=True).collect()] == [("All", 0, 0)] or [
        tuple(r) for r in xt.crosstab(none, "T", "L", margins=True).collect()
    ] == [("All", 0)]
    for row in (("All", "x"), ("a", "All")):
        with pytest.raises(Exception, match="names the totals"):
            xt.crosstab_long(spark.createDataFrame([row], "T string, L string"), "T", "L", margins=True).collect()


def test_crosstab_order_and_ties_at_the_boundary(spark):
    rows = [("b", "x")] * 2 + [("a", "x")] * 2 + [("c", None)] * 3 + [("d", "y")] * 2
    df = spark.createDataFrame(rows, "T string, L string")
    assert [(r["rank"], r["T"], r.x, r.y) for r in xt.crosstab_top(df, "T", "L", 3).collect()] == [(1, "c", 0, 0), (2, "a", 2, 0), (3, "b", 2, 0)]
    assert [r["T"] for r in xt.crosstab(df, "T", "L").collect()] == ["a", "b", "d"]
    assert [(r["T"], r["L"]) for r in xt.crosstab_long(df, "T", "L").collect()] == [("a", "x"), ("b", "x"), ("d", "y")]


def test_histogram_leaves_nan_out_and_has_bins_without_values(spark):
    kept = spark.sparkContext._jsc.getPersistentRDDs().size()
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,), (2.0,)], "v double")
    assert sum(r.n for r in tx.histogram(df, "v", 4).collect()) == 3
    empty = tx.histogram(df.filter("v > 9 and not isnan(v)"), "v", 4).collect()
    assert [(r.bin_start, r.bin_end, r.n) for r in empty] == [(i / 4, (i + 1) / 4, 0) for i in range(4)]
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == kept


def test_preview_derive_after_topn_equals_ordering_the_derived_table(spark):
    from session_rows import SF001
    from convolytics.operators.features import add_text_features
    from convolytics.sources import fixtures

    raw = fixtures.sessions(spark, SF001)
    late = pf.preview(raw, derive=add_text_features)
    early = pf.preview(add_text_features(raw))
    assert late.columns == early.columns
    assert [tuple(r) for r in late.collect()] == [tuple(r) for r in early.collect()]


_CELLS = (
    st.sampled_from([None, 0, 1, 2]),
    st.sampled_from([None, "", "x", "y z"]),
    st.sampled_from([None, 0.0, -0.0, 1.5, float("nan")]),
)


@settings(max_examples=12, deadline=None)
@given(rows=st.lists(st.tuples(*_CELLS), max_size=30))
def test_profile_shape_matches_pandas_on_random_tables(spark, rows):
    import pandas as pd

    df = spark.createDataFrame(rows, "a int, b string, c double")
    r = pf.profile_shape(df).first()
    pdf = pd.DataFrame(rows, columns=["a", "b", "c"], dtype=object)
    # pandas equality: -0.0 == 0.0, NaN equal to NaN, None equal to None
    pdf["c"] = pdf["c"].map(lambda v: None if v is None else ("nan" if v != v else float(v) + 0.0))
    assert r.row_count == len(rows)
    assert r.missing_cells == sum(v is None or (isinstance(v, float) and v != v) for row in rows for v in row)
    assert r.duplicate_rows == int(pdf.astype(str).duplicated().sum())
