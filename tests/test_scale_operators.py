"""Pruned top-k, place-filtered duplicates, selection by bins, sketches and
rows in file order."""

import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from convolytics.operators.profile import profile_shape, profile_shape_filtered
from convolytics.operators.selection import continuous_histogram, summarize
from convolytics.operators.sketches import estimates, id_sketches, roll_up
from convolytics.operators.topk import candidates, top_counts
from convolytics.sinks.reports import write_csv
from convolytics.sources.head import first_rows


def shuffled(df, metric):
    """A metric of all shuffles of a run of the plan, its subqueries included."""
    df.collect()
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
        else:
            if node.nodeName() == "Exchange":
                total += node.metrics().apply(metric).value()
            kids, subs = node.children(), node.subqueries()
            todo += [kids.apply(i) for i in range(kids.size())]
            todo += [subs.apply(i).child() for i in range(subs.size()) if subs.apply(i).nodeName() == "Subquery"]
    return total


def zipf(spark, n=60_000, seed=1):
    words = np.random.default_rng(seed).zipf(1.3, n) % 50_000
    return spark.createDataFrame([(f"w{w}",) for w in words.tolist()], "k string").repartition(6).persist(), Counter(f"w{w}" for w in words.tolist())


def expected(counts, k):
    return [(w, n) for w, n in sorted(counts.items(), key=lambda t: (-t[1], t[0]))[:k]]


def test_top_counts_on_a_zipf_vocabulary(spark):
    df, counts = zipf(spark)
    for k in (1, 10, 30):
        assert [tuple(r) for r in top_counts(df, "k", k, tracked=4000).collect()] == expected(counts, k)
    few = candidates(df, "k", 10, 4000)
    assert 10 <= len(few) < 200 and {w for w, _ in expected(counts, 10)} <= set(few)
    # far fewer keys are shuffled than by counting each
    full = df.groupBy("k").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "k").limit(10)
    pruned = top_counts(df, "k", 10, tracked=4000)
    rows = "shuffleRecordsWritten"
    assert 0 < shuffled(pruned, rows) * 10 < shuffled(full, rows)


def test_top_counts_without_a_useful_bound(spark):
    rows = [(f"k{i % 700}",) for i in range(2100)] + [(None,)] * 50
    df = spark.createDataFrame(rows, "k string")
    assert candidates(df, "k", 5, 100) is None
    assert [tuple(r) for r in top_counts(df, "k", 5, tracked=100).collect()] == expected(Counter(r[0] for r in rows if r[0]), 5)
    assert [tuple(r) for r in top_counts(df.limit(0), "k", 5).collect()] == []
    one = spark.createDataFrame([("b",), ("a",), ("b",), ("a",)], "k string")
    assert [tuple(r) for r in top_counts(one, "k", 1).collect()] == [("a", 2)]
    with pytest.raises(ValueError):
        top_counts(one, "k", 11, tracked=10)


def test_filtered_duplicates_equal_the_full_count(spark):
    distinct = spark.range(40_000).select(F.col("id"), F.concat(F.lit("text "), "id").alias("t"), F.lit(None).cast("string").alias("n"))
    doubled = distinct.unionByName(distinct.filter("id % 10 = 0")).unionByName(distinct.filter("id = 7"))
    for df in (distinct, doubled, distinct.limit(0), distinct.limit(1)):
        assert profile_shape_filtered(df).collect() == profile_shape(df).collect()
    assert profile_shape_filtered(doubled).first().duplicate_rows == 4001


def test_no_digest_of_a_distinct_row_is_shuffled(spark, tmp_dir):
    spark.range(300_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("t")).write.parquet(f"{tmp_dir}/t")
    table = spark.read.parquet(f"{tmp_dir}/t")
    plan = profile_shape_filtered(table)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan

    moved = "shuffleBytesWritten"
    assert 0 < shuffled(profile_shape_filtered(table, block_bits=8), moved) * 5 < shuffled(profile_shape(table), moved)


@pytest.mark.parametrize("kind", ["normal", "lumps", "tiny range", "integers", "wide"])
def test_selection_against_numpy(spark, kind):
    rng = np.random.default_rng(3)
    x = {
        "normal": rng.normal(size=100_001),
        "lumps": np.concatenate([np.full(5000, 2.5), rng.normal(1e9, 1, 3000), rng.exponential(1e-6, 3000)]),
        "tiny range": 1.0 + rng.integers(0, 50, 4000) * 2.0**-52,
        "integers": rng.integers(-5, 6, 3000).astype(float),
        "wide": np.concatenate([rng.normal(size=999), [1.7e308, -1.7e308]]),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double").repartition(4)
    asked = (0.0, 0.25, 0.5, 0.9, 1.0)
    s = summarize(df, "v", asked, bins=20)
    assert (s.n, s.low, s.high) == (len(x), x.min(), x.max())
    ordered = np.sort(x)
    for q, got in zip(asked, s.quantiles):
        p = q * (len(x) - 1)
        a, b = ordered[int(p)], ordered[min(int(p) + 1, len(x) - 1)]
        assert got == a + (b - a) * (p - int(p))
    assert sum(s.counts) == len(x)
    if kind != "wide":
        counts = np.histogram(x, bins=np.asarray(s.edges))[0]
        assert s.counts == counts.tolist()
        assert np.allclose(s.edges, np.histogram(x, 20)[1], rtol=1e-15, atol=0)


def test_selection_of_nothing_and_of_one_value(spark):
    empty = spark.createDataFrame([(None,)], "v double")
    assert summarize(empty, "v").quantiles == [None] and sum(summarize(empty, "v").counts) == 0
    one = spark.createDataFrame([(3.0,)] * 4, "v double")
    s = summarize(one, "v", (0.5,), 4)
    assert (s.quantiles, s.counts, s.edges[0], s.edges[-1]) == ([3.0], [0, 0, 4, 0], 2.5, 3.5)
    assert [r.n for r in continuous_histogram(one, "v", 4).collect()] == [0, 0, 4, 0]
    with pytest.raises(ValueError, match="infinities"):
        summarize(spark.createDataFrame([(float("inf"),), (1.0,)], "v double"), "v")


def test_sketches_roll_up_over_days(spark):
    rows = [(f"d{i % 5}", "ab"[i % 2], f"s{(i * 7919) % 3000}" if i % 11 else None) for i in range(20_000)]
    df = spark.createDataFrame(rows, "day string, topic string, id string")
    stored = id_sketches(df, "id", ["day", "topic"])
    days = {r.day: r.unique_ids for r in estimates(roll_up(stored, ["day"])).collect()}
    for d in days:
        true = len({i for day, _, i in rows if day == d and i})
        assert abs(days[d] - true) <= 0.03 * true
    whole = estimates(roll_up(stored)).first()
    true = len({i for _, _, i in rows if i})
    assert whole["rows"] == 20_000 and abs(whole.unique_ids - true) <= 0.03 * true
    # the same as a sketch of everything at once
    assert whole.unique_ids == estimates(id_sketches(df, "id")).first().unique_ids
    plan = estimates(roll_up(stored))._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    assert estimates(roll_up(id_sketches(df.limit(0), "id", ["day"]))).first().unique_ids == 0


def test_first_rows_in_file_order(spark, tmp_dir):
    d = os.path.join(tmp_dir, "t.parquet")
    for part in range(4):
        rows = [(part * 100 - i, f"t{i}", None) for i in range(7 if part else 3)]
        spark.createDataFrame(rows, "id long, t string, suggestion string").coalesce(1).write.mode("append").parquet(d)
    files = sorted(f for f in os.listdir(d) if f.endswith(".parquet"))
    want = [r for f in files for r in spark.read.parquet(f"{d}/{f}").drop("suggestion").collect()][:10]
    got = first_rows(spark, d, 10)
    assert got.columns == ["id", "t"] and got.collect() == want
    assert first_rows(spark, d, 100).count() == 24 and first_rows(spark, d, 2).collect() == want[:2]
    csv = write_csv(spark.createDataFrame([(f"b{i}", f'x "{i}"\ny') for i in range(30)], "a string, b string").coalesce(1), f"{tmp_dir}/c.csv")
    assert [r.a for r in first_rows(spark, csv, 4, "csv").collect()] == ["b0", "b1", "b2", "b3"]


def test_first_rows_sort_no_text(spark, tmp_dir):
    from convolytics.sources.head import _parquet_head

    spark.createDataFrame([(1, "a")], "id long, t string").write.parquet(f"{tmp_dir}/p")
    table = spark.read.parquet(f"{tmp_dir}/p")
    plan = _parquet_head(spark, table.inputFiles()[0], table, 5)._jdf.queryExecution().optimizedPlan().toString()
    sorts = [line for line in plan.splitlines() if "Sort" in line]
    assert all("_row_in_file" in line and "t#" not in line.split("], ")[0] for line in sorts) and "Limit" in plan
