import random

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import brute
from convolytics.llm import components, jaccard
from convolytics.llm.common import staged
from convolytics.llm.components import connected_components
from convolytics.llm.queries import QUERIES
from tests_paths import SF001


def found(spark, rows, **options):
    frame = spark.createDataFrame([(d, t, 1, "s") for d, t in rows], "doc_id long, text string, node int, component string")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame, **options).collect()}


def variants(seed, bases=4, copies=12, words=60, edits=6):
    """Texts and copies of them with some words changed."""
    rng = random.Random(seed)
    rows = []
    for _ in range(bases):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(words // 2, words))]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randrange(edits)):
                text[rng.randrange(len(text))] = f"v{rng.randrange(5)}"
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    return rows


def test_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op8_ngram_jaccard"](spark, SF001).collect()}
    assert got == brute.components(docs)


def test_variants_at_both_thresholds(spark):
    rows = variants(1)
    assert found(spark, rows) == brute.components(rows)
    assert found(spark, rows, words=5, num=80, den=100) == brute.components(rows, 5, 80, 100)


def test_crowded_groups_take_the_way_by_rare_elements(spark):
    rows = variants(2, bases=2, copies=30)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    table = staged(jaccard.document_sets(frame, jaccard.Bands()), "sets")
    corpus = jaccard.Corpus(frame, table, 3, 90, 100)
    parts = {r.node: r.component for r in jaccard.similarity_components(corpus, jaccard.shared_signatures(table), most=3).collect()}
    want = brute.components(rows)
    by = {}
    for r in table.collect():
        by.setdefault(parts.get(r.node, r.node), set()).add(r.doc_id)
    assert sorted(map(sorted, by.values())) == sorted(sorted(d for d in want if want[d][1] == c) for c in {c for _, c in want.values()})


def test_edge_cases(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one two three"), (8, "One  two\nthree"),
            (9, long), (10, long + " end"), (11, "Été a b"), (12, "été a b")]
    assert found(spark, rows) == brute.components(rows)
    assert found(spark, []) == {}


def test_repeated_and_null_ids(spark):
    frame = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (None, "q r s")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in jaccard.jaccard_components(frame).collect())
    assert got == [("5", "5"), ("5", "5"), ("None", "5"), ("None", "None")]


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 400), st.integers(0, 12), st.integers(0, 12), st.integers(0, 10**6), st.sampled_from([(90, 100), (80, 100)]))
def test_similar_sets_share_a_signature(size, gone, new, seed, threshold):
    rng = np.random.default_rng(seed)
    bands = jaccard.Bands(*threshold)
    a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
    b = np.unique(np.concatenate([a[min(gone, len(a) - 1) :], rng.integers(0, 2**64, new, dtype=np.uint64)]))
    common = len(np.intersect1d(a, b))
    if threshold[1] * common >= threshold[0] * (len(a) + len(b) - common):
        assert np.intersect1d(jaccard.signatures(a, bands), jaccard.signatures(b, bands)).size
        words = [np.frombuffer(jaccard.sketch(x), "<u8") for x in (a, b)]
        assert jaccard.may_be_similar(np.asarray(len(a)), np.asarray(len(b)), *words, *threshold)
        assert jaccard.similar(jaccard.unpack(jaccard.pack(a)), jaccard.unpack(jaccard.pack(b)), *threshold)


@settings(max_examples=150, deadline=None)
@given(st.integers(60, 3000), st.integers(0, 10**6), st.sampled_from([(90, 100), (80, 100)]), st.sampled_from(["gone", "new", "both"]))
def test_sets_that_differ_in_their_fullest_cells_share_a_signature(size, seed, threshold, how):
    rng = np.random.default_rng(seed)
    num, den = threshold
    bands = jaccard.Bands(num, den)
    a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
    size = len(a)
    level = bands.levels(size)[-1]
    n1, n2, _ = bands.plan(level)
    cell = ((a >> np.uint64(32)) * np.uint64(n1 * n2)) >> np.uint64(32)
    # one difference in each cell, the fullest first, as many as similarity allows
    _, first, held = np.unique(cell, return_index=True, return_counts=True)
    spots = first[np.argsort(-held, kind="stable")]
    most = {"gone": size * (den - num) // den, "new": size * (den - num) // num, "both": size * (den - num) // (den + num)}[how]
    out, more = spots[: most if how != "new" else 0], spots[most if how == "both" else 0 :][: most if how != "gone" else 0]
    b = np.unique(np.concatenate([np.delete(a, out), a[more] ^ np.uint64(1)]))
    common = len(np.intersect1d(a, b))
    assert den * common >= num * (len(a) + len(b) - common)
    assert np.intersect1d(jaccard.signatures(a, bands), jaccard.signatures(b, bands)).size


def test_sets_without_a_common_element_share_no_signature():
    rng = np.random.default_rng(3)
    for threshold in ((90, 100), (80, 100)):
        bands = jaccard.Bands(*threshold)
        for size in (200, 1000, 3000):
            sigs = [jaccard.signatures(np.unique(rng.integers(0, 2**64, size, dtype=np.uint64)), bands) for _ in range(60)]
            assert len(np.unique(np.concatenate(sigs))) == sum(map(len, sigs))


@settings(max_examples=100, deadline=None)
@given(st.integers(500, 5000), st.integers(0, 700), st.integers(0, 700), st.integers(0, 10**6), st.sampled_from([(90, 100), (80, 100)]))
def test_wide_sketches_pass_similar_sets_and_stop_others(size, gone, new, seed, threshold):
    rng = np.random.default_rng(seed)
    num, den = threshold
    a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
    b = np.unique(np.concatenate([a[min(gone, len(a) - 1) :], rng.integers(0, 2**64, new, dtype=np.uint64)]))
    x, y = jaccard.wide_sketch(a), jaccard.wide_sketch(b)
    if x is None or y is None:
        return
    assert jaccard.differing_bits(x, y) <= len(np.setxor1d(a, b))
    other = jaccard.wide_sketch(rng.integers(0, 2**64, size, dtype=np.uint64))
    assert jaccard.differing_bits(x, other) * (den + num) > 2 * size * (den - num)


def test_words_at_the_cut_of_long_texts(monkeypatch):
    text = ("ab cde  f\n" * 500).encode()
    whole = jaccard.word_hashes(text)
    monkeypatch.setattr(jaccard, "_CUT", 64)
    assert (jaccard.word_hashes(text) == whole).all()


def test_words_longer_than_the_cut(monkeypatch):
    word = "".join(chr(97 + i * i % 26) for i in range(1000))
    one, two = f"x y {word} z".encode(), f"some more {word}".encode()
    whole = [jaccard.word_hashes(t) for t in (one, two, word.encode())]
    for cut in (64, 7, 1000):
        monkeypatch.setattr(jaccard, "_CUT", cut)
        assert [w.tolist() for w in map(jaccard.word_hashes, (one, two, word.encode()))] == [w.tolist() for w in whole]
    assert len(whole[0]) == 4 and whole[0][2] == whole[1][2] == whole[2][0]
    monkeypatch.undo()
    big = "q" * ((3 << 20) + 5)
    a, b = jaccard.word_hashes(f"x y {big} z".encode()), jaccard.word_hashes(f"{big} z".encode())
    assert len(a) == 4 and a[2:].tolist() == b.tolist()


def test_a_forest_of_a_group_comes_first(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base, rng.integers(0, 2**64, 3, dtype=np.uint64)])) for _ in range(30)]
    rows = [(s, i, i, len(e), jaccard.sketch(e)) for s in (1, 2) for i, e in enumerate(sets)]
    groups = spark.createDataFrame(rows, "sig long, node long, component long, n long, sketch binary")
    first = jaccard.compared(groups, 90, 100, 0).collect()
    pairs = [(r.a, r.b) for r in first if r.a is not None]
    assert len(pairs) == 29 and len(first) == 30  # both groups choose alike, and say that pairs are left
    assert len({n for p in pairs for n in p}) == 30
    every = [(r.a, r.b) for r in jaccard.compared(groups, 90, 100, 100).collect()]
    assert len(every) == 30 * 29 // 2 and (None, None) not in every


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in edges:
        lo, hi = sorted((root(a), root(b)))
        parent[hi] = lo
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in edges for x in (a, b) if a != b}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_without_new_links_the_components_stay(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "connected_components", None)
    known = spark.createDataFrame([(1, 1), (2, 1)], "node long, component long")
    assert jaccard._join_up(known, spark.createDataFrame([], "a long, b long")) is known


def test_a_step_of_the_components_is_a_small_plan(spark, monkeypatch):
    plans = []
    stored = components.staged
    monkeypatch.setattr(components, "staged", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or stored(df, name))
    got = connected_components(spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")).collect()
    assert {r.component for r in got} == {0} and len(got) == 21
    # each step reads the last one's table four times at most
    assert max(p[p.index("== Physical Plan ==") :].count("FileScan") for p in plans) <= 4


def test_bitmap_filter_keeps_the_rows_of_set_slots(spark):
    rows = spark.range(-4000, 4000).select(F.xxhash64("id").alias("v"))
    some = rows.filter(F.pmod("v", F.lit(7)) == 0)
    for size in (15, 17):
        bits = jaccard.bitmap(some, "v", size)
        slots = [(r.v, r.s) for r in rows.select("v", jaccard._slot("v", size).alias("s")).collect()]
        wanted = sorted(v for v, s in slots if bits[s >> 3] >> (s & 7) & 1)
        found = sorted(r.v for r in jaccard.set_in(rows, "v", bits, size).collect())
        assert found == wanted and len(wanted) >= some.count()
    empty = jaccard.bitmap(some.limit(0), "v", 15)
    assert jaccard.set_in(rows, "v", empty, 15).isEmpty()


def test_shared_signatures_stay_in_the_jvm(spark, monkeypatch):
    made = []
    monkeypatch.setattr(jaccard, "staged", lambda df, name: made.append(df) or df)
    monkeypatch.setattr(jaccard, "drop_staged", lambda df: None)
    table = spark.createDataFrame([(1, [5, 6]), (2, [6, 7]), (3, None)], "node long, sigs array<long>")
    groups = jaccard.shared_signatures(table)
    assert sorted(map(tuple, groups.collect())) == [(6, 1, 1), (6, 2, 1)]
    for df in made:
        plan = df._jdf.queryExecution().toString()
        assert "MapInArrow" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
