import zlib

import numpy as np

from convolytics.llm import sharding
from convolytics.llm.queries import QUERIES
from tests_paths import SF01


def slots(rows, shards):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    return by


def test_whole_table(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    rows = QUERIES["op10_sharding"](spark, SF01).collect()
    slots(rows, 16)
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)


def test_nulls_repeats_clashing_names_and_few_rows(spark):
    rows = [(1, "a", "x"), (1, "a", "x"), (None, None, "y"), (2, "b", None), (3, "", "z")]
    out = sharding.uniform_shards(spark.createDataFrame(rows, "doc_id long, part string, `block.x` string"), shards=16).collect()
    slots(out, 16)
    assert sorted(map(str, (tuple(r)[:3] for r in out))) == sorted(map(str, rows))
    assert sharding.uniform_shards(spark.createDataFrame([], "doc_id long"), shards=4).collect() == []


def test_many_blocks(spark):
    out = sharding.uniform_shards(spark.range(1000).withColumnRenamed("id", "doc_id"), shards=3, block_rows=7).collect()
    slots(out, 3)
    assert sorted(r.doc_id for r in out) == list(range(1000))


def test_same_seed_same_order_other_seed_another(spark):
    def run(seed):
        return {r.doc_id: (r.shard, r.slot) for r in sharding.uniform_shards(spark.range(0, 500, 1, 4).withColumnRenamed("id", "doc_id"), 4, seed).collect()}

    assert run(1) == run(1) != run(2)


def test_matrix_has_exact_margins_and_the_right_mean():
    upto, sizes = np.asarray([0, 30, 30, 90, 100]), np.asarray([40, 35, 25])
    total = np.zeros((4, 3))
    for seed in range(300):
        m = np.stack([sharding.matrix_row(p, upto, sizes, seed) for p in range(4)])
        assert (m.sum(axis=0) == sizes).all() and (m.sum(axis=1) == np.diff(upto)).all() and (m >= 0).all()
        total += m
    assert np.abs(total / 300 - np.outer(np.diff(upto), sizes) / 100).max() < 0.5


def test_counts_beyond_the_generators_bound_keep_their_sum():
    counts = np.asarray([2_000_000_000, 1_000_000_000, 5])
    got = sharding.draw(np.random.default_rng(1), counts, 1_500_000_000)
    assert got.sum() == 1_500_000_000 and (got <= counts).all() and (got >= 0).all()


def test_large_draws_follow_the_law(monkeypatch):
    # the draw for large counts, at counts where numpy's own can be compared
    rng = np.random.default_rng(4)
    large = np.asarray([sharding._large_hypergeometric(rng, 60, 40, 30) for _ in range(4000)])
    numpy = np.random.default_rng(5).hypergeometric(60, 40, 30, 4000)
    values = np.arange(10, 27)
    gap = [abs((large <= v).mean() - (numpy <= v).mean()) for v in values]
    assert max(gap) < 0.04  # about the 99.9 % bound for two samples of 4000
    for good, bad, n, k in ((5, 7, 0, 0), (5, 7, 12, 5), (0, 9, 4, 0), (9, 0, 4, 4)):
        assert sharding._large_hypergeometric(rng, good, bad, n) == k
    big = [sharding._large_hypergeometric(rng, 6 * 10**11, 4 * 10**11, 5 * 10**11) for _ in range(3)]
    assert all(abs(k - 3 * 10**11) < 6 * 250_000 for k in big)
    monkeypatch.setattr(sharding, "_MAX_ROWS", 10)
    counts = np.asarray([9, 0, 30, 1, 20])
    total = sum(sharding.draw(rng, counts, 30) for _ in range(3000)) / 3000
    assert np.abs(total - counts / 2).max() < 0.15


def test_shards_look_uniform(spark):
    # every shard gets its share of any stretch of the input
    out = sharding.uniform_shards(spark.range(0, 8000, 1, 8).withColumnRenamed("id", "doc_id"), shards=4).collect()
    table = np.zeros((8, 4))
    for r in out:
        table[r.doc_id // 1000, r.shard] += 1
    assert ((table - 250) ** 2 / 250).sum() < 50  # 21 degrees of freedom
