import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from convolytics.llm import langid, quality, toxicity
from convolytics.llm.common import crc_mod
from convolytics.llm.queries import QUERIES
from convolytics.llm.sampling import per_label
from tests_paths import SF01

DOCS = "doc_id long, text string, lang string, score string, evidence int"


def held(spark, query, n, k, label):
    rows = QUERIES[query](spark, SF01).collect()
    ids = [r.doc_id for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()]
    assert sorted(r.doc_id for r in rows) == sorted(ids)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == k) and 0 <= r.score <= 1 for r in rows)
    if label == "lang":
        truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
        return [(r.lang_pred, truth[r.doc_id]) for r in rows if r.held_out]
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    return [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]


def accuracy(pairs):
    return sum(a == b for a, b in pairs) / len(pairs)


def test_quality_keeps_the_labels_shares():
    # one feature, twenty ones to a zero, of which equal numbers are drawn
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(1, 1, 3000), rng.normal(0, 1, 3000)])[:, None]
    y = np.concatenate([np.ones(3000), np.zeros(3000)])
    weight = np.where(y == 1, 20.0, 1.0)
    model = quality.train(x, y, weight=weight)
    assert np.average(model.scores(x), weights=weight) == pytest.approx(20 / 21, abs=0.01)
    # Bayes' rule for two bells, from brute arithmetic
    at = np.asarray([[-0.5], [0.5], [1.5]])
    odds = 20 * np.exp(at[:, 0] - 0.5)
    assert np.abs(model.scores(at) - odds / (1 + odds)).max() < 0.05


def test_language_held_out_accuracy(spark):
    assert accuracy(held(spark, "op6_language_id", 3, 1, "lang")) >= 0.98


def test_quality_held_out_accuracy(spark):
    assert accuracy(held(spark, "op3_quality", 5, 0, "quality")) >= 0.93


def test_toxicity_held_out_accuracy(spark):
    assert accuracy(held(spark, "op9_toxicity", 4, 2, "toxic")) >= 0.92


# language


def net():
    rng = np.random.default_rng(0)
    texts = [(("the cat and the dog " if k else "der hund und die katze ") * 20, k) for k in (0, 1) for _ in range(40)]
    win = np.stack([langid.windows(t.encode()[rng.integers(30) :][:256])[0] for t, _ in texts])
    return langid.train(win, np.asarray([k for _, k in texts]), ["de", "en"], epochs=4)


def test_tables_equal_the_convolution():
    model = net()
    win = langid.windows("Die Katze sah the dog é ß 12!".encode())
    x = model.embedding[model.classes[win]]
    pooled = []
    for w, k, b in zip(langid.WIDTHS, model.filters, model.biases):
        n = langid.WINDOW - w + 1
        patch = np.concatenate([x[:, j : j + n] for j in range(w)], axis=2)
        pooled.append(np.maximum((patch @ k + b).max(axis=1), 0))
    z = np.concatenate(pooled, axis=1) @ model.out + model.out_bias
    p = np.exp(z) / np.exp(z).sum()
    assert np.allclose(p, model.probabilities(win, model.tables()), atol=1e-4)


def test_gradients_of_the_network():
    rng = np.random.default_rng(1)
    embed, n_filters, n_lang = 3, 4, 3
    params = [rng.normal(size=(langid.CLASSES, embed))]
    for w in langid.WIDTHS:
        params += [rng.normal(size=(w * embed, n_filters)), rng.normal(size=n_filters)]
    params += [rng.normal(size=(len(langid.WIDTHS) * n_filters, n_lang)), rng.normal(size=n_lang)]
    x, y = rng.integers(0, langid.CLASSES, (5, 30)), rng.integers(0, n_lang, 5)

    def loss():
        h = []
        for i, w in enumerate(langid.WIDTHS):
            n = x.shape[1] - w + 1
            patch = np.concatenate([params[0][x][:, j : j + n] for j in range(w)], axis=2)
            h.append(np.maximum((patch @ params[1 + 2 * i] + params[2 + 2 * i]).max(axis=1), 0))
        p = langid._softmax(np.concatenate(h, axis=1) @ params[-2] + params[-1])
        return -np.log(p[np.arange(5), y]).mean()

    for p, g in zip(params, langid._gradients(params, x, y, embed)):
        at = tuple(rng.integers(0, s) for s in p.shape)
        p[at] += 1e-6
        up = loss()
        p[at] -= 2e-6
        down = loss()
        p[at] += 1e-6
        assert (up - down) / 2e-6 == pytest.approx(g[at], abs=1e-5)


def test_windows_cover_every_byte_run():
    for n in (0, 1, 255, 256, 257, 510, 1000):
        raw = bytes(97 + i % 26 for i in range(n))
        runs = {bytes(w[i : i + 4]) for w in langid.windows(raw) for i in range(langid.WINDOW - 3)}
        assert {raw[i : i + 4] for i in range(n - 3)} <= runs


def test_unknown_and_long_texts():
    model = net()
    texts = pa.array([None, "", "12 34 !?", "the cat and the dog", "der hund und die katze " * 40_000, "é"])
    langs, scores = langid.score_texts(model, model.tables(), texts, flush=64)
    assert langs[:5] == ["und", "und", "und", "en", "de"] and scores[:3] == [0.0] * 3 and langs[5] in ("de", "en")
    assert langid.score_texts(None, [], texts)[0] == ["und"] * 6


def test_language_without_labels_or_rows(spark):
    rows = [(1, "abc", None, "x", 1), (None, None, None, None, None), (1, "abc", None, "x", 1)]
    frame = spark.createDataFrame(rows, DOCS)
    model = langid.fit(frame, F.lit(True))
    assert model is None
    assert [(r.doc_id, r.lang_pred, r.score) for r in langid.predict(frame, model).collect()] == [(1, "und", 0.0), (None, "und", 0.0), (1, "und", 0.0)]
    assert langid.predict(frame.limit(0), net()).collect() == []


# quality


def test_features_of_edge_cases():
    assert quality.features(None) == quality.features("") == [0.0] * len(quality.FEATURES)
    for text in (" ", "\n\n", "x", "😀" * 10, "word " * 200_000, "\x00"):
        made = quality.features(text)
        assert len(made) == len(quality.FEATURES) and all(map(math.isfinite, made))


def test_boosting_learns_single_terms_and_pairs():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 4))
    single, pair = (x[:, 0] > 0.3).astype(float), ((x[:, 1] > 0) ^ (x[:, 2] > 0)).astype(float)
    assert ((quality.train(x, single).scores(x) > 0.5) == single).mean() > 0.98
    assert ((quality.train(x, pair, rounds=5).scores(x) > 0.5) == pair).mean() > 0.95
    constant = quality.train(np.zeros((10, 2)), np.asarray([1.0, 0.0] * 5)).scores(np.ones((1, 2)))
    assert constant[0] == pytest.approx(0.5)
    assert quality.train(np.zeros((0, 2)), np.zeros(0)).scores(np.zeros((1, 2)))[0] == pytest.approx(0.5)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality_without_labels_nulls_and_repeats(spark):
    frame = spark.createDataFrame([(1, "abc", "en", "x", 1), (1, "abc", "en", "x", 1), (None, None, None, None, None)], DOCS)
    model = quality.fit(frame, labels(spark, [(None, 1, 1), (5, None, None)]), F.lit(True))
    assert sorted((str(r.doc_id), r.score) for r in quality.score(frame, model).collect()) == [("1", 0.5), ("1", 0.5), ("None", 0.5)]
    assert quality.score(frame.limit(0), model).collect() == []


# toxicity


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(4)
    n_terms, idf = 40, np.ones(40)
    vectors = []
    for _ in range(500):
        t = np.sort(rng.choice(n_terms, rng.integers(1, 6), replace=False))
        vectors.append(toxicity.unit(t, rng.integers(1, 4, len(t)).astype(float), idf))
    ids = rng.permutation(500)
    index = toxicity.BlockMaxIndex(vectors, ids, np.zeros(500, int), n_terms, block=16)
    for _ in range(30):
        t = np.sort(rng.choice(n_terms, 4, replace=False))
        q = toxicity.unit(t, np.ones(4), idf)
        dense = np.zeros(n_terms)
        dense[t] = q[1]
        scored = sorted((-float(dense[a] @ w), int(i)) for (a, w), i in zip(vectors, ids) if dense[a] @ w > 0)[:15]
        got = [(s, int(index.ids[p])) for s, p in index.nearest(*q, 15)]
        assert np.allclose([s for s, _ in got], [-s for s, _ in scored])
        for (s, i), (want, j) in zip(got, scored):
            assert i == j or abs(s + want) < 1e-9


def test_terms():
    assert toxicity.terms("Fools, FOOL! a") == Counter({"fools": 1, "foo*": 2, "fool*": 1, "fool": 1, "a": 1})
    assert toxicity.terms(" .,! ") == Counter()


def toy(spark):
    clean = [(i, f"plain words number {i} about rivers", "en", "x", i) for i in range(60)]
    bad = [(100 + i, f"you vile scoundrel number {i} of rivers and more", "en", "x", i) for i in range(60)]
    more = [(500, None, None, None, None), (501, "", "en", "x", 1), (502, "vile vile scoundrel", "en", "x", 1), (None, "scoundrel vile", "en", "x", 1),
            (503, "calm rivers", "en", "x", 1), (503, "calm rivers", "en", "x", 1), (504, "rivers " * 100_000 + "vile scoundrel", "en", "x", 1)]
    rows = [(d[0], None, int(d[0] >= 100)) for d in clean + bad] + [(3, None, 0), (None, None, 1), (7, None, None)]
    return spark.createDataFrame(clean + bad + more, DOCS), labels(spark, rows), clean + bad + more


def test_toxicity_of_edge_cases(spark):
    docs, marks, rows = toy(spark)
    out = toxicity.score(docs, marks, F.lit(True), keep=["doc_id"]).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert by[502].score > 0.9 and by[None].score > 0.9 and by[110].score > 0.9
    assert by[10].score < 0.05
    # every example has a term here, so texts without one get the rate of all
    assert by[500].score == by[501].score == by[503].score == pytest.approx(61 / 122, abs=0.01) and by[500].evidence == []
    near = by[502].evidence
    assert near and all(e.label == 1 for e in near) and [e.cosine for e in near] == sorted((e.cosine for e in near), reverse=True)


def test_toxicity_without_labels_or_rows(spark):
    docs, marks, rows = toy(spark)
    assert {r.score for r in toxicity.score(docs, marks.limit(0), F.lit(True)).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), marks, F.lit(True)).collect() == []


# sampling


def test_sample_is_bounded_per_label(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 100 == 0, "rare").when(F.col("id") % 7 == 0, None).otherwise("common").alias("k"))
    counts = Counter(r.k for r in per_label(rows, "k", ["id"], 200, 1).collect())
    assert counts == {"rare": 50, "common": 200}
    hot = spark.range(3000).select(F.lit(1).alias("id"), F.lit("same").alias("k"))
    assert per_label(hot, "k", ["id"], 200, 1).count() <= 1


def test_crc_mod(spark):
    got = [r[0] for r in spark.createDataFrame([(12,), (None,)], "doc_id long").select(crc_mod(F.col("doc_id"), 5)).collect()]
    assert got == [zlib.crc32(b"12") % 5, 0]
