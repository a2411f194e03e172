"""Scalar expressions against Python's own definitions."""

import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from convolytics import constants as K
from convolytics.functions import (
    accuracy_band,
    char_length,
    drop_off_advice,
    keyword_tokens,
    pretty_label,
    resolution_advice,
    round2,
    sentiment_advice,
    spam_band,
    word_count,
)

STOP = set(K.STOP_WORDS)


def py_words(s):
    return len((s or "").split())


def py_keywords(s, stop=STOP):
    """Walks the characters: runs of letters, numbers and underscores; a run
    counts if it is three or more of the letters a to z."""
    found, run = [], ""
    for c in (s or "").lower() + " ":
        if c.isalnum() or c == "_":
            run += c
            continue
        if len(run) >= 3 and all("a" <= x <= "z" for x in run) and run not in stop:
            found.append(run)
        run = ""
    return found


EDGE = [
    (None, 0, 0, []),
    ("", 0, 0, []),
    ("  a b\tc\n", 8, 3, []),
    ("a b", 3, 2, []),
    ("a b\u001cc", 5, 3, []),
    ("x\u000by", 3, 2, []),
    ("　", 1, 0, []),
    ("Élan vital don't abc123 foo_bar Hello the élan", 46, 8, ["vital", "don", "hello"]),
    ("\U0001F600 smile \U0001F600", 9, 3, ["smile"]),
    ("naïve café café test", 21, 4, ["cafe", "test"]),
]


def _eval(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_edge_lengths_words_tokens(spark):
    texts = [e[0] for e in EDGE]
    assert _eval(spark, texts, char_length("t")) == [e[1] for e in EDGE]
    assert _eval(spark, texts, word_count("t")) == [e[2] for e in EDGE]
    assert _eval(spark, texts, keyword_tokens("t")) == [e[3] for e in EDGE]
    # the table's expectations are Python's own results
    assert [py_words(e[0]) for e in EDGE] == [e[2] for e in EDGE]
    assert [py_keywords(e[0]) for e in EDGE] == [e[3] for e in EDGE]
    assert [len(e[0] or "") for e in EDGE] == [e[1] for e in EDGE]


ALPHABET = st.sampled_from(
    list("abcxyzABCXYZ019_ '-.,") + ["\t", "\n", " ", " ", "　", "\u001c", "é", "ß", "İ",
                                     "́", "\U0001F600", "٠", " ", "\u0085"]
)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=40), min_size=200, max_size=200))
def test_words_and_tokens_match_python(spark, texts):
    assert _eval(spark, texts, char_length("t")) == [len(t) for t in texts]
    assert _eval(spark, texts, word_count("t")) == [py_words(t) for t in texts]
    got = _eval(spark, texts, keyword_tokens("t"))
    assert got == [py_keywords(t) for t in texts]


def test_round2_is_half_even_like_numpy(spark):
    vals = [0.125, 0.135, 2.675, 1.005, 33.333333, 66.666666, 12.5, -0.125, 0.0, 99.995] + [i / 7 for i in range(60)]
    got = _eval(spark, [str(v) for v in vals], round2(F.col("t").cast("double")))
    assert got == [float(np.round(v, 2)) for v in vals]


def test_pretty_label(spark):
    got = _eval(spark, ["user_drop_off", "resolved", "partially_resolved", None], pretty_label("t"))
    assert got == ["User Drop Off", "Resolved", "Partially Resolved", None]


def test_bands_are_strict(spark):
    vals = ["80", "80.01", "50", "50.01", "20", "20.01", "5", "5.01", "0"]
    acc = _eval(spark, vals, accuracy_band(F.col("t").cast("double")))
    spam = _eval(spark, vals, spam_band(F.col("t").cast("double")))
    assert acc == ["medium", "good", "poor", "medium", "poor", "poor", "poor", "poor", "poor"]
    assert spam == ["poor", "poor", "poor", "poor", "medium", "poor", "good", "medium", "good"]


@pytest.mark.parametrize(
    "value,res,drop,neg",
    [
        (50.0, "focus on improving resolution rates", "investigate user drop-offs", "address negative sentiment"),
        (15.0, "focus on improving resolution rates", "investigate user drop-offs", "address negative sentiment"),
        (10.0, "focus on improving resolution rates", "low drop-off rate", "address negative sentiment"),
        (9.99, "focus on improving resolution rates", "low drop-off rate", "positive user sentiment"),
        (50.01, "good resolution rate", "investigate user drop-offs", "address negative sentiment"),
    ],
)
def test_recommendations_strict(spark, value, res, drop, neg):
    x = F.lit(value)
    row = spark.range(1).select(resolution_advice(x), drop_off_advice(x), sentiment_advice(x)).first()
    assert tuple(row) == (res, drop, neg)
