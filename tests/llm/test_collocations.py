import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from convolytics.llm import collocations as co
from convolytics.llm.queries import ORACLE_SQL, QUERIES
from tests_paths import SF01

_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(_LOW))]


def plain(rows, least, longest=5, top=2000):
    """All results as tuples, every phrase counted in the texts."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    often = {k: c for k, c in f.items() if c >= least}
    held = Counter()
    for (lang, g), c in often.items():
        for k in range(2, len(g)):
            for i in range(len(g) - k + 1):
                held[lang, g[i : i + k]] = max(held[lang, g[i : i + k]], c)
    out = {}
    for (lang, g), a in often.items():
        if len(g) < 2 or held[lang, g] >= a:
            continue
        cuts = [(Fraction(1000 * a * n[lang], f[lang, g[:j]] * f[lang, g[j:]]).__floor__(), j) for j in range(1, len(g))]
        score, j = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), f[lang, g[:j]], f[lang, g[j:]]))
    return sorted(
        (lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, v in out.items() for i, (s, a, p, l, r) in enumerate(sorted(v)[:top])
    )


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, "lang string, text string").repartition(parts)


def found(df):
    return sorted(tuple(r)[:8] for r in df.collect())


def test_whole_table(spark):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()]
    out = found(QUERIES["op12_collocations"](spark, SF01))
    assert out == plain(rows, 100) and len(out) > 10


def test_against_counting_every_phrase(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["a", "b", "c", "D", "é", "x-y", "日本"]
    rows = []
    for i in range(300):
        words = rng.choice(vocabulary, size=rng.integers(0, 30), p=[0.3, 0.2, 0.2, 0.1, 0.1, 0.05, 0.05])
        text = "".join(w + rng.choice([" ", "\t  ", ". ", "\n", ",", " "], p=[0.6, 0.1, 0.1, 0.1, 0.05, 0.05]) for w in words)
        rows.append((["en", "fr", None, "und"][i % 4], text))
    rows += [("en", "the quick brown fox jumps over the lazy dog")] * 40 + [("en", None), ("fr", ""), (None, " ..!? ")]
    for least, top in ((5, 2000), (20, 7), (1000, 5)):
        assert found(co.collocations(table(spark, rows), least=least, top=top)) == plain(rows, least, top=top)
    paths = {r.phrase: r.path_words for r in co.collocations(table(spark, rows), least=40).collect() if r.path_words}
    assert paths["the quick brown fox jumps"] == 9 and paths["jumps over the lazy dog"] == 9


def test_empty_extra_columns_and_three_words(spark):
    assert co.collocations(table(spark, [])).collect() == []
    rows = [("en", "p q r s t. q r")] * 3
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "lang string, text string, n int, id string")
    assert found(co.collocations(docs, least=2, longest=3)) == plain(rows, 2, longest=3)


def test_ties_and_counts_past_64_bits(spark):
    cand = spark.createDataFrame([([1, 2, 0], 2, "x", 4_000_000_000_000, 9_000_000_000_000)], "g array<long>, k int, lang string, a long, n long")
    parts = spark.createDataFrame([([1, 0, 0], 4_000_000_000_001), ([2, 0, 0], 4_000_000_000_007)], "g array<long>, f long")
    r = co._scored(cand, parts, 3).first()
    assert r.score == 1000 * 4_000_000_000_000 * 9_000_000_000_000 // (4_000_000_000_001 * 4_000_000_000_007)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB é.,\t\n!日", max_size=40), max_size=5), st.integers(1, 12))
def test_segments_and_windows_keep_every_word(texts, size):
    raw = [t.encode() for t in texts]
    words = [w for part in co.segments(raw, size) for w in part]
    flat = [g for t in texts for p in pieces(t) for g in [*[w.encode() for w in p], b"."]]
    squeezed = lambda ws: [w for i, w in enumerate(ws) if w != b"." or (i and ws[i - 1] != b".")]
    strip = lambda ws: squeezed([b".", *ws, b"."])
    assert strip(words) == strip(flat)


def test_windows_carry_over_segments(monkeypatch):
    text = b" ".join(b"w%d" % (i % 7) for i in range(200))
    known = co._Numbers("en", 0)
    whole = [known[w] for w in text.split()]
    monkeypatch.setattr(co.segments, "__defaults__", (40,))

    def upto_break(window):
        n = window.index(0) if 0 in window else 5
        return tuple(window[:n] + [0] * (5 - n))

    starts = [upto_break(ids[i : i + 5].tolist()) for ids in co._windows([text, None, text], known, 5) for i in range(len(ids) - 4)]
    padded = [*whole, 0, 0, 0, 0, 0]
    one = [tuple(padded[i : i + 5]) for i in range(200)]
    assert [s for s in starts if s[0]] == one * 2


@pytest.mark.parametrize("name", ["op12_collocations", "op13_exact_dedup"])
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF01}/documents.parquet')")
    got = QUERIES[name](spark, SF01).drop("path_words")
    rows = con.execute(ORACLE_SQL[name]).fetchall()
    order = [d[0] for d in con.description]
    assert sorted(order) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*order).collect())) == sorted(rows)
