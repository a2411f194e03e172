import math

import numpy as np
import pytest

from convolytics.llm import whitening
from convolytics.llm.queries import QUERIES
from tests_paths import SF01


def plain(rows, counts=False):
    """vec_id -> (n, deviation, whitened up to sign, explained), one length."""
    kept = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    vectors = sorted(set(tuple(x) for _, x in kept))
    weight = np.asarray([sum(tuple(x) == v for _, x in kept) if counts else 1 for v in vectors])
    x, n = np.asarray(vectors, float), int(weight.sum())
    sums = [sum(int(w) * v[k] for w, v in zip(weight, vectors)) for k in range(x.shape[1])]
    mean = np.asarray([s / n for s in sums])
    cov = ((x - mean) * weight[:, None]).T @ (x - mean) / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:4], u[:, ::-1][:, :4]
    out = []
    for i, v in kept:
        z = (np.asarray(v, float) - mean) @ u / np.sqrt(e)
        out.append((i, n, sum((n * c - s) ** 2 for c, s in zip(v, sums)), z, e / np.trace(cov)))
    return out


def same(found, expected):
    by = {}
    for r in found:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert sorted(by) == sorted(i for i, *_ in expected)
    k = len(next(iter(by.values())))
    for i, n, deviation, z, explained in expected:
        assert sorted(by[i]) == list(range(1, k + 1))
        for c in range(k):
            r = by[i][c + 1]
            assert (r.n, r.deviation) == (n, deviation)
            assert r.explained == pytest.approx(explained[c], rel=1e-6)
            assert abs(r.whitened) == pytest.approx(abs(z[c]), abs=1e-6)
            assert r.identity_error < 1e-6
    # one sign for all rows
    for c in range(k):
        signs = {np.sign(by[i][c + 1].whitened * z[c]) for i, _, _, z, _ in expected if abs(z[c]) > 1e-3}
        assert len(signs) == 1


def test_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF01}/embeddings.parquet").collect()]
    same(QUERIES["op11_embedding_whitening"](spark, SF01).collect(), plain(rows))


@pytest.mark.parametrize("weights", ["one", "count"])
def test_copies_nulls_and_extra_columns(spark, weights):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 6)).tolist()
    rows = [(i, base[i % 25 if i < 60 else 0]) for i in range(120)]
    bad = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (202, [float("nan")] * 6), (203, [float("inf")] + [0.0] * 5)]
    table = spark.createDataFrame([(i, v, "x", i) for i, v in rows + bad], "vec_id long, embedding array<double>, x string, digest long")
    found = whitening.whiten(table.repartition(5), weights=weights).collect()
    same(found, plain(rows, weights == "count"))


def test_flat_directions_ties_lengths_and_empty(spark):
    def run(rows):
        return whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()

    assert run([]) == [] and run([(1, []), (2, None)]) == []
    assert run([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    # one direction with variance, then a second length, repeated and null ids
    out = run([(1, [0.0, 1.0]), (1, [0.0, 1.0]), (None, [1.0, 1.0]), (3, [0.0]), (4, [2.0]), (5, [0.5])])
    assert sorted((str(r.vec_id), r.component, r.n) for r in out) == [
        ("1", 1, 2), ("1", 1, 2), ("3", 1, 3), ("4", 1, 3), ("5", 1, 3), ("None", 1, 2),
    ]
    assert {round(abs(r.whitened), 9) for r in out if r.n == 2} == {1.0}


def test_deviation_beyond_64_bits():
    x = np.asarray([[1 << 40, 0], [3, 4]])
    got = whitening.deviations(x, 1 << 20, [1 << 50, 5])
    assert got == [None, None]
    assert whitening.deviations(np.asarray([[5, -3]]), 7, [2, 9]) == [33**2 + 30**2]
    assert whitening._weighted_sums(np.asarray([[1 << 62], [1 << 62]]), np.asarray([2, 3])) == [5 << 62]
