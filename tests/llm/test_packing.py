import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from convolytics.llm import packing, token_counts, tokens
from convolytics.llm.queries import QUERIES
from convolytics.llm.tokens import WordCachedEncoder
from tests_paths import SF001

PATH = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)
CACHED = WordCachedEncoder(PATH)
SCHEMA = "doc_id long, text string, row_id string, length int"


def expected(text, limit=4096):
    ids = PLAIN.encode(text or "", add_special_tokens=False).ids + [1]
    return [(k // limit, k, ids[k : k + limit]) for k in range(0, len(ids), limit)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB '́ÉéİΣς\t\n\x0b\x1c\x1f\x85\xa0 ​09don'tre!?…😀ßœ<|", max_size=40))
def test_cached_encoding_equals_the_tokenizer(text):
    ids = np.frombuffer(next(CACHED.encode([text])), "<u4").tolist()
    assert ids == PLAIN.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|ENDOFTEXT|>", "<|StartOfText|>", "<|startoftext|>", "<|", "|>", "aB", "É", " ", "."]), max_size=8))
def test_added_tokens_in_any_letter_case(parts):
    text = "".join(parts)
    assert np.frombuffer(next(CACHED.encode([text])), "<u4").tolist() == PLAIN.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a<|startoftext|>b", "<|endoftext|> x", "a" * 5000, "", "x" * 3000 + " y"])
def test_special_tokens_and_long_words(text):
    assert np.frombuffer(next(CACHED.encode([text])), "<u4").tolist() == PLAIN.encode(text, add_special_tokens=False).ids


def test_a_full_cache_starts_anew():
    small = WordCachedEncoder(PATH, max_words=3)
    texts = ["one two three four, five", "one six seven!", "eight nine ten one"]
    assert [np.frombuffer(x, "<u4").tolist() for x in small.encode(texts)] == [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_task_holds_few_words_and_leaves_none():
    enc = WordCachedEncoder(PATH, max_words=50)
    texts = [" ".join(f"w{chr(97 + k % 26)}{chr(97 + j)}x{'.' * (k % 2)}" for j in range(26)) for k in range(52)]
    want = [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == want
        assert all(len(c) <= 50 and len(c.before) <= 50 for c in (enc.words, enc.stems))
    assert not any(isinstance(v, (dict, WordCachedEncoder)) and v for k, v in vars(tokens).items() if not k.startswith("__") and k != "_BYTE_LETTERS")


def check(rows, docs, limit=4096):
    want = sorted(
        (d if d is not None else -1, p, s, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        for d, t in docs
        for p, s, ids in expected(t, limit)
    )
    assert want == sorted((r.doc_id if r.doc_id is not None else -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= limit
    return bins


def test_pieces_of_edge_cases(spark):
    docs = [(1, "one two three"), (1, "one two three"), (None, "x"), (2, None), (3, ""), (4, "word " * 9000), (5, "word " * 4095), (6, "word " * 4096)]
    frame = spark.createDataFrame([(d, t, "clash", 7) for d, t in docs], SCHEMA)
    check(packing.pack_documents(frame, PATH).collect(), docs)


def test_whole_table_packs_close_to_the_bound(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = QUERIES["op1_best_fit_packing"](spark, SF001).collect()
    bins = check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert len(bins) <= -(-sum(r.length for r in rows) // 4096) * 1.05 + 1


def test_small_blocks_and_few_bins_stay_valid(spark):
    docs = [(i, "word " * (i * 37 % 90)) for i in range(120)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    check(packing.pack_documents(frame, PATH, max_len=64, open_bins=2, block_rows=20).collect(), docs, 64)


def test_best_fit_picks_the_fullest_bin_that_fits_and_closes_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 4, 9, 8, 1)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0), (2, 9)]
    crowded = packing.OpenBins(10, 2)
    assert [crowded.place(n)[0] for n in (6, 7, 8, 3)] == [0, 1, 2, 0]  # 7 closed for 8


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(empty, PATH).collect() == []
    assert token_counts.token_counts(empty, PATH).collect() == []


def test_materialised_sequences_hold_the_ids(spark):
    docs = [(1, "one two three"), (2, "four five " * 40), (3, None)]
    rows = packing.materialise_sequences(spark.createDataFrame(docs, "doc_id long, text string"), PATH, max_len=32).collect()
    total = sorted(i for r in rows for i in np.frombuffer(r.ids, "<u4").tolist())
    assert total == sorted(i for _, t in docs for _, _, ids in expected(t, 32) for i in ids)
    assert all(r.length * 4 == len(r.ids) <= 128 for r in rows)


def test_token_counts_equal_brute_force(spark):
    lengths = [len(PLAIN.encode(r.text or "", add_special_tokens=False).ids) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    limits = QUERIES["op4_token_counts"](spark, SF001)
    for r in limits.collect():
        n = r.context_limit
        assert r.docs == lengths.count(n) and r.docs_over == sum(x > n for x in lengths)
        assert r.tokens_within == sum(x for x in lengths if x <= n) and r.tokens_over == sum(x for x in lengths if x > n)
        assert r.truncated_tokens == sum(min(x, n) for x in lengths) and r.docs_within == len(lengths) - r.docs_over
        assert r.quantile == pytest.approx(r.docs_within / len(lengths))
    for n in (0, 5, 100, 10**6):
        assert token_counts.at_limit(limits, n).first().truncated_tokens == sum(min(x, n) for x in lengths)


def test_token_counts_across_ranges(spark):
    docs = [(i, "word " * n) for i, n in enumerate([0, 1, 4095, 4096, 9000, 9000, 20000])] + [(9, None)]
    rows = token_counts.token_counts(spark.createDataFrame(docs, "doc_id long, text string"), PATH).collect()
    lengths = sorted([0, 0, 1, 4095, 4096, 9000, 9000, 20000])
    got = {r.context_limit: (r.docs, r.docs_over, r.truncated_tokens) for r in rows}
    assert got == {n: (lengths.count(n), sum(x > n for x in lengths), sum(min(x, n) for x in lengths)) for n in set(lengths)}
