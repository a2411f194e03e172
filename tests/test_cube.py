"""The cube's roll-ups equal the queries on rows, from one scan."""

import math

import pytest
from pyspark.sql import functions as F

from convolytics.operators import cube as cb
from convolytics.plans.dashboard import analyses, dashboard, dashboard_tables
from convolytics.sources import fixtures
from session_rows import SF001, sessions_frame

ROWS = [
    ("t1", "a b c", "x", "resolved", "positive", "1", "accurate", "spam"),
    ("t1", "a", None, "unresolved", "negative", "1", "not_accurate", "not_spam"),
    ("t2", None, "y z", None, "neutral", None, None, "spam"),
    (None, "d e", "", "user_drop_off", None, "2", "accurate", None),
    ("t2", "a b", "w", "resolved", "positive", "3", "accurate", "not_spam"),
    ("t3", "", "w w w w", "resolved", "negative", "3", None, None),
    ("t1", "a b c", "x", "resolved", "positive", "1", "accurate", "spam"),
]
# without an order among equal keys, or with floating sums in another order
_PLACES = 9


def rows(df):
    def plain(v):
        return round(v, _PLACES) if isinstance(v, float) and math.isfinite(v) else v

    return df.columns, [tuple(plain(v) for v in r) for r in df.collect()]


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")


@pytest.fixture(scope="module")
def featured(spark):
    return fixtures.featured_sessions(spark, SF001).persist()


@pytest.fixture(scope="module")
def cube(featured):
    return cb.build_cube(featured)


@pytest.mark.parametrize("name", sorted(cb.rollups()))
def test_each_answer_equals_its_query(featured, cube, name):
    assert rows(cb.rollups()[name](cube)) == rows(analyses()[name](featured))


@pytest.mark.parametrize("quality", [True, False])
@pytest.mark.parametrize("table", [ROWS, ROWS[2:3], []])
def test_small_tables(spark, table, quality):
    df = sessions_frame(spark, table, quality)
    cube = cb.build_cube(df, store=False)
    plain = analyses(quality=quality)
    for name, fn in cb.rollups(quality=quality).items():
        assert rows(fn(cube)) == rows(plain[name](df)), name


def test_one_scan_and_one_shuffle_build_the_cube(spark, featured, tmp_dir):
    featured.write.parquet(f"{tmp_dir}/featured")
    table = cb.build_cube(spark.read.parquet(f"{tmp_dir}/featured"), store=False).table
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning") == 1
    # no text is read
    assert "USER_QUERY" not in plan.split("ReadSchema")[1] and "RESOLUTION:" not in plan.split("ReadSchema")[1]


def test_rollups_read_the_cube_alone(spark, featured, cube, tmp_dir):
    featured.write.parquet(f"{tmp_dir}/featured")
    tables = dashboard(spark.read.parquet(f"{tmp_dir}/featured").drop("query_length", "query_word_count", "resolution_length", "resolution_word_count"))
    for name, df in tables.items():
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        files = {f for f in df.inputFiles()}
        assert all(("cube-" in f) == (name in cb.rollups()) for f in files), (name, plan)


def test_cubes_merge(spark, featured, cube):
    days = [featured.filter(F.pmod(F.xxhash64("USER_QUERY", "SESSION_ID"), F.lit(3)) == i) for i in range(3)]
    merged = cb.merge([cb.build_cube(d) for d in days])
    for name, fn in cb.rollups().items():
        assert rows(fn(merged)) == rows(fn(cube)), name
    with pytest.raises(ValueError):
        cb.merge([cube, cb.build_cube(featured.drop("spam_check"), store=False)])


def test_stored_tables_are_deleted_after_the_block(spark):
    with dashboard_tables(sessions_frame(spark, ROWS).drop("query_length", "query_word_count", "resolution_length", "resolution_word_count")) as tables:
        files = [f for df in tables.values() for f in df.inputFiles()]
        assert files and tables["kpi_overview"].count() == 1
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for f in files:
        path = jvm.org.apache.hadoop.fs.Path(f)
        assert not path.getFileSystem(conf).exists(path)


def test_one_pass_over_top_keys_counts_only_them(spark, featured):
    """The pair counts sit above the join with the k top keys."""
    from convolytics.operators.crosstab import crosstab_top

    top = crosstab_top(featured, "TOPIC", "RESOLUTION_STATUS", 3, values=["resolved", "unresolved"])
    lines = top._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(i for i, line in enumerate(lines) if "Join Inner" in line)
    pair = [i for i, line in enumerate(lines) if "Aggregate" in line and "_c0" in line]
    assert pair and max(pair) < join and "broadcast" in lines[join].lower()
    assert top.count() == 3
