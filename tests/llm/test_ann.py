import numpy as np
import pytest

from convolytics.llm import ann
from convolytics.llm.queries import QUERIES
from tests_paths import SF01

SCHEMA = "vec_id long, embedding array<float>, node string, code int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 0) for i, v in rows], SCHEMA)


def nearest(rows, queries, k):
    out = {}
    for q in queries:
        x = np.asarray(dict(rows)[q], np.float32).astype(float)
        scored = sorted((-float(np.dot(x, np.asarray(v, np.float32).astype(float))), i) for i, v in rows if i != q)
        out[q] = [i for _, i in scored[:k]]
    return out


def found(spark, rows, queries, k=20, settings=None):
    index = ann.build_index(frame(spark, rows), settings)
    asked = spark.createDataFrame([(q,) for q in queries], "query_id long")
    out = {}
    for r in sorted(ann.search(index, asked, k).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def test_more_neighbours_than_copies_are_refused(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5)], "vec_id long, embedding array<float>")
    index = ann.build_index(rows, copies=3)
    asked = rows.select(rows.vec_id.alias("query_id"))
    with pytest.raises(ValueError, match="copies=4"):
        ann.search(index, asked, k=3)
    assert ann.search(index, asked, k=2).count() == 10


def test_whole_table_is_exact_where_one_leaf_holds_it(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF01}/embeddings.parquet").collect()]
    queries = [i for i, _ in rows if i % 20 == 0]
    got = QUERIES["op2_nn_descent"](spark, SF01).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r.vec_id)
        assert r["rank"] == len(by[r.query_id])
    assert by == nearest(rows, queries, 20)


def test_recall_with_small_leaves(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(1500, 12)) * rng.uniform(0.2, 2, (1500, 1)))]
    queries = list(range(0, 1500, 50))
    small = ann.Settings(neighbours=12, trees=3, leaf=40, group=300, sample=400, beam=48, hops=(12, 24, 24), block=16)
    got, want = found(spark, rows, queries, 10, small), nearest(rows, queries, 10)
    assert np.mean([len(set(got[q]) & set(want[q])) / 10 for q in queries]) >= 0.9


def test_vectors_that_take_no_part_and_few_candidates(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
            (7, [None, 1.0]), (8, [1.0]), (9, [2.0, 2.0]), (None, [1.0, 1.0])]
    assert found(spark, rows, [1, 2, 3, 4, 5, 8, 9, 77]) == {1: [9, 2], 2: [9, 1], 9: [1, 2]}


def test_copies_and_ties(spark):
    rows = [(i, [1.0, 0.5]) for i in range(60)] + [(100 + i, [0.5, 1.0]) for i in range(3)]
    got = found(spark, rows, [0, 59, 101], 20)
    assert got[0] == list(range(1, 21)) and got[59] == list(range(20))
    assert got[101] == [100, 102, *range(18)]


def test_repeated_rows_and_empty_or_single_tables(spark):
    assert found(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [2.0, 1.0])], [1, 1]) == {1: [2]}
    assert found(spark, [(1, [1.0, 2.0]), (1, [2.0, 0.0]), (2, [2.0, 1.0]), (2, [0.0, 3.0])], [1]) == {1: [2]}
    assert found(spark, [(1, [1.0, 2.0])], [1]) == {}
    assert found(spark, [], [1]) == {}


def test_scores_are_exact_products(spark):
    rows = [(1, [0.1, 0.7, -0.3]), (2, [0.2, 0.9, 0.4]), (3, [-5.0, 0.1, 0.25])]
    index = ann.build_index(frame(spark, rows))
    for r in ann.search(index, spark.createDataFrame([(1,)], "query_id long"), 5).collect():
        a, b = (np.asarray(dict(rows)[i], np.float32).astype(float) for i in (1, r.vec_id))
        assert r.score == sum(x * y for x, y in zip(a, b))


def test_rounds_go_on_until_neighbours_settle(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(1500, 10)))]
    one = ann.Settings(neighbours=10, trees=2, leaf=20, group=300, sample=400, beam=40, hops=(10, 20), block=16)
    got, want = found(spark, rows, list(range(0, 1500, 50)), 10, one), nearest(rows, list(range(0, 1500, 50)), 10)
    assert np.mean([len(set(got[q]) & set(want[q])) / 10 for q in want]) >= 0.9


def parts(spark, graph, n):
    codes = [(i, np.asarray([1.0, i / 64, 0.0], np.float16).tobytes()) for i in range(n)]
    return spark.createDataFrame(graph, "node long, near array<long>, sim array<float>"), spark.createDataFrame(codes, "node long, code binary")


def test_own_neighbours_meet_and_blocks_change_with_the_round(spark):
    s = ann.Settings(neighbours=3, block=4)
    graph, nodes = parts(spark, [(0, [1, 2], [0.0, 0.0]), (1, [3], [0.0]), (2, [4], [0.0]), (3, [], []), (4, [], [])], 5)
    assert 2 in {r.node: r.near for r in ann.descend(graph, nodes, s, 0).collect()}[1]
    graph, nodes = parts(spark, [(i, [0], [-9.0]) for i in range(1, 40)] + [(0, [], [])], 40)
    pairs = [{(r.node, x) for r in ann.descend(graph, nodes, s, turn).collect() for x in r.near} for turn in (0, 1)]
    assert len(pairs[0] - pairs[1]) > 10


def test_vectors_no_plane_parts_meet_others_in_each_tree(spark):
    nodes = spark.createDataFrame([(i, np.ones(4, np.float16).tobytes()) for i in range(60)], "node long, code binary")
    n = [sum(len(r.near) for r in ann.leaf_neighbours(nodes, ann.Settings(trees=t, group=4)).collect()) for t in (1, 6)]
    assert n[1] > 2 * n[0]
