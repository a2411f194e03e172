import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from convolytics.llm import dedup
from convolytics.llm.queries import QUERIES
from tests_paths import SF01


def sha(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()


def digests(n, seed=0):
    return np.random.default_rng(seed).integers(0, 1 << 63, size=(n, 4), dtype=np.uint64)


def plain(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(sha(t), []).append(i)
    keep = {k: min((i for i in v if i is not None), default=None) for k, v in groups.items()}
    return sorted((str(i), str(keep[sha(t)]), len(groups[sha(t)]), sha(t)) for i, t in rows)


def check(found, rows):
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in found) == plain(rows)
    kept = [r for r in found if r.kept]
    assert len(kept) == len({r.text_sha256 for r in found}) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()]
    check(QUERIES["op13_exact_dedup"](spark, SF01).collect(), rows)


def test_white_space_nulls_repeats_and_clashing_names(spark):
    long = "word " * 300_000
    rows = [
        (5, "a b"), (3, "a\t\n b"), (9, " a b"), (3, "a  b"), (None, "a b"), (1, None), (2, ""), (None, "z"), (None, "z"),
        (7, "a b"), (8, long), (6, long.replace(" ", "\r\n")), (4, "A b"), (3, "a b"),
    ]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, digest string, row int")
    check(dedup.exact_duplicates(docs.repartition(3)).collect(), rows)
    assert dedup.exact_duplicates(docs.limit(0)).collect() == []


def test_hot_group_in_many_parts(spark):
    rows = [(i, "hot" if i % 3 else f"t{i % 50}") for i in range(3000, 0, -1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(20)
    check(dedup.exact_duplicates(docs, per_shard=10).collect(), rows)


def test_index_inserts_deletes_and_looks_up(spark):
    def keyed(texts, first=0):
        rows = spark.createDataFrame([(first + k, t) for k, t in enumerate(texts)], "id long, text string")
        return rows.select("id", dedup.text_digest(F.col("text")).alias("digest"), F.col("id").alias("row"))

    def live(index):
        return sorted((r.keep_id, r.copies) for r in index.live().collect())

    def names(index, texts):
        return sorted(bytes(r.digest).hex() for r in index.lookup(keyed(texts)).collect())

    one = dedup.DigestIndex(2).insert(keyed(["a", "b", "a", "c"]))
    assert live(one) == [(0, 2), (1, 1), (3, 1)]
    two = one.insert(keyed(["b", "d"], 10))
    assert live(two) == [(0, 2), (1, 2), (3, 1), (11, 1)] and live(one) == [(0, 2), (1, 1), (3, 1)]
    three = two.delete(keyed(["a", "never"]))
    assert live(three) == [(1, 2), (3, 1), (11, 1)]
    assert names(three, ["a", "b", "x", "d"]) == sorted([sha("b"), sha("d")])
    assert live(three.insert(keyed(["a"], 50))) == [(1, 2), (3, 1), (11, 1), (50, 1)]
    # overflow of the smallest filter: every shard grows from its stored keys
    many = three.insert(keyed([f"m{k}" for k in range(2000)], 100))
    assert many.live().count() == 2003 and len(names(many, [f"m{k}" for k in range(2000)])) == 2000
    assert many.delete(keyed([f"m{k}" for k in range(2000)])).live().count() == 3


def test_filter_has_no_false_misses_and_deletes():
    keys = digests(3000)
    f = dedup.CuckooFilter.holding(keys)
    assert f.contains(keys).all() and (f.table != 0).sum() == 3000
    others = digests(20_000, 1)
    assert f.contains(others).mean() < 0.001
    f.delete(keys[:1500])
    assert f.contains(keys[1500:]).all() and f.contains(keys[:1500]).mean() < 0.01 and (f.table != 0).sum() == 1500
    f = dedup.CuckooFilter.from_bytes(f.to_bytes())
    f.insert(keys[:1500])
    assert f.contains(keys).all()


def test_filter_overflow_leaves_it_unchanged():
    f = dedup.CuckooFilter(16)
    f.insert(digests(30))
    before = f.table.copy()
    try:
        f.insert(digests(200, 2))
        raise AssertionError("no overflow")
    except dedup.Overflow:
        assert (f.table == before).all()


def test_shard_resizes_from_stored_keys():
    shard = dedup._Shard()
    keys = [k.tobytes() for k in digests(5000, 3)]
    shard.insert(keys + keys, [(0, k, k, 1) for k in range(10_000)], block=64)
    assert shard.resized > 0 and len(shard.live) == 5000
    assert all(shard.found(keys)) and {v[3] for v in shard.live.values()} == {2}
