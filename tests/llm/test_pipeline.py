import os
import subprocess
import sys

import brute
import corpus_pipeline as cp
from convolytics.llm import packing
from convolytics.llm.queries import QUERIES
from tests_paths import SF001

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `row` string, score int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, g, "s", len(t or ""), "r", 1) for d, t, g in rows], SCHEMA)


def test_run_equals_the_stages_and_keeps_columns(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id for r in docs.collect()}
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF001).cache()
        assert docs.columns == columns
        now = {r.doc_id for r in docs.collect()}
        assert now <= before and len(now) > 0.5 * len(before)
        before = now
    packed = cp.STAGES[-1][1](spark, docs, SF001).collect()
    assert {r.doc_id for r in packed} == before
    ran = cp.run(spark, SF001).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, ran)) == sorted(map(key, packed))


def test_one_document_of_each_group_stays(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    kept = {r.doc_id for r in cp.remove_near_duplicates(spark, spark.read.parquet(f"{SF001}/documents.parquet"), SF001).collect()}
    assert kept == {c for _, c in brute.components(docs, 5, 80, 100).values()}


def test_edge_cases_pass_through(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 34", "en"), (None, "plain words about the river and the town", "en"), (4, "plain words of the town", None)]
    docs = frame(spark, rows)
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF001)
        assert out.columns == docs.columns
        out.collect()
        assert stage(spark, docs.limit(0), SF001).collect() == []
    gone = {r.doc_id for r in cp.language_id(spark, docs, SF001).collect()}
    assert not gone & {1, 2, 3}


def test_rows_go_to_python_and_back_once(spark):
    docs = frame(spark, [(k, f"plain words of town {k}", "en") for k in range(40)])
    for name, stage in cp.STAGES[:-1]:
        if name == "near_duplicates":
            continue
        plan = stage(spark, docs, SF001)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1, name
        assert "AS _text" not in plan, name


def test_repeated_ids_keep_one_row_per_text(spark):
    docs = frame(spark, [(1, "a b c d e f", "en"), (1, "a b c d e f", "en"), (2, "a b c d e f", "en")])
    assert [r.doc_id for r in cp.remove_near_duplicates(spark, docs, SF001).collect()] == [1]


def test_rows_are_removed_not_ids(spark):
    def kept(rows):
        out = cp.remove_near_duplicates(spark, frame(spark, [(d, t, "en") for d, t in rows]), SF001).collect()
        return sorted(((r.doc_id, r.text) for r in out), key=str)

    a, b = "one two three four five six seven", "red green blue black white grey brown"
    # an id with two texts: each group keeps its smallest id's row
    assert kept([(5, a), (6, a), (4, b), (5, b)]) == [(4, b), (5, a)]
    assert kept([(1, a), (None, a), (None, a)]) == [(1, a)]
    assert kept([(None, a), (None, a), (None, b)]) == [(None, a), (None, b)]
    assert kept([(3, None), (3, None), (3, ""), (None, "")]) == [(3, ""), (3, None), (None, "")]


def test_stages_and_queries_are_registered():
    import __spark_entry__ as entry

    assert {"pipeline", *QUERIES} <= set(entry.queries())
    assert sorted({int(q.split("_")[0][2:]) for q in QUERIES}) == list(range(1, 14))
    assert 4 <= len(cp.STAGES) <= 5 and packing


def test_the_rest_imports_without_the_operators(tmp_dir):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = (
        "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['convolytics.llm'] = None\n"
        "import importlib, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('convolytics.llm'): raise ModuleNotFoundError(name, name=name)\n"
        "for m in ('corpus_pipeline', 'convolytics.llm'): sys.modules.pop(m, None)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(k.startswith('op1') for k in q)\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
