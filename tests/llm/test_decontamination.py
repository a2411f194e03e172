import random

import brute
from hypothesis import given, settings, strategies as st

from convolytics.llm import decontamination as dc
from convolytics.llm.queries import QUERIES
from tests_paths import SF001

ITEM = "Which of the seven rivers crosses the old border town twice, and why did the ferrymen refuse to name it?"
SHORT = "blue whales hum at night in winter"


def spans(spark, docs, items, **options):
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, hits string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return sorted((r.doc_id, r.item_id, r.edits, r.start, r.end) for r in dc.contaminated(frame, bench, **options).collect())


def test_exact_moved_and_altered_copies(spark):
    filler = "Some other words come first here. "
    altered = ITEM.replace("seven", "eight").replace("ferrymen", "ferryman").replace("twice,", "twice")
    docs = [
        (1, ITEM), (2, filler + ITEM + " and more"), (3, ("words in front " + ITEM.upper()).replace(" ", " \n ")), (4, filler + altered + filler),
        (5, filler * 30), (6, None), (7, ""), (8, "é" * 50 + " " + ITEM), (9, ITEM[: len(ITEM) // 2]), (10, filler + SHORT),
    ]
    got = spans(spark, docs, [(1, ITEM), (2, SHORT), (3, None), (4, "tiny"), (None, ITEM)])
    assert [(d, i) for d, i, *_ in got] == [(1, 1), (2, 1), (3, 1), (4, 1), (8, 1), (10, 2)]
    by = {d: (e, a, b) for d, _, e, a, b in got}
    assert by[1] == (0, 0, len(ITEM)) and by[2] == (0, len(filler), len(filler) + len(ITEM)) and by[8] == (0, 51, 51 + len(ITEM))
    assert by[4][0] == brute.edit_distance_within(ITEM.lower(), altered.lower()) and by[3][0] == 0


def test_whole_table_holds_all_exact_copies_and_only_true_ones(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): (r.edits, r.start, r.end) for r in QUERIES["op5_decontamination"](spark, SF001).collect()}
    fold = lambda s: " ".join(s.lower().split())
    assert {(d, i) for d, t in docs.items() for i, x in items.items() if fold(x) in fold(t)} <= set(got)
    for (d, i), (edits, a, b) in got.items():
        item = fold(items[i])
        assert edits <= 0.2 * len(item.encode())
        assert brute.edit_distance_within(item.encode(), fold(docs[d][a:b]).encode()) <= edits


def test_recall_of_edited_copies():
    rng = random.Random(5)
    items = [(i, " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(30))) for i in range(60)]
    index = dc.ItemIndex(items, dc.Settings())
    texts, want = [], []
    for i, item in items:
        body = list(item)
        for _ in range(len(item) // 10):
            body[rng.randrange(len(body))] = rng.choice("xyz ")
        texts.append("some words before it " + "".join(body) + " and after")
        want.append(i)
    found = index.find(texts)
    assert sum(any(h[0] == i for h in hits) for i, hits in zip(want, found)) >= 0.95 * len(items)


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=1, max_size=20), st.binary(max_size=40))
def test_edit_search_is_exact(item, text):
    edits, end = dc.edit_search(item, text)
    assert edits == brute.edit_distance_within(item, text)
    assert edits == len(item) or brute.edit_distance_within(item, text[:end]) == edits


def test_empty_benchmark_repeats_and_empty_table(spark):
    assert spans(spark, [(1, ITEM)], []) == []
    assert spans(spark, [], [(1, ITEM)]) == []
    assert len(spans(spark, [(1, ITEM), (1, ITEM)], [(1, ITEM), (1, ITEM)])) == 2


def test_benchmark_size_is_checked(spark):
    import pytest

    with pytest.raises(ValueError):
        spans(spark, [(1, ITEM)], [(1, ITEM)], settings=dc.Settings(max_item_bytes=10))


def test_very_long_text_between_others():
    long = "lorem ipsum dolor " * 120_000
    index = dc.ItemIndex([(1, ITEM)], dc.Settings())
    found = index.find(["a b c", long + ITEM + " " + long, None, ITEM])
    assert [[h[0] for h in x] for x in found] == [[], [1], [], [1]]
    assert found[1][0][2:] == (len(long), len(long) + len(ITEM))


def edited(text, share, rng, ways):
    """A copy with that share of its characters replaced (``ways`` is 1) or
    replaced, left out or preceded by another (3)."""
    out = list(text)
    for p in rng.sample(range(len(text)), int(share * len(text))):
        other = rng.choice("klmnopqrst")
        out[p] = (other, "", other + out[p])[rng.randrange(ways)]
    return "".join(out)


def test_recall_at_10_15_and_20_percent_of_edits():
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    items = [(i, words(rng.randrange(14, 70))) for i in range(80)]
    index = dc.ItemIndex(items, dc.Settings())
    for ways in (1, 3):
        for share, least in ((0.1, 1.0), (0.15, 0.98), (0.2, 0.93)):
            copies = [edited(x, share, rng, ways) for _, x in items]
            found = index.find([words(9) + " " + c + " " + words(9) for c in copies])
            assert sum(i in [h[0] for h in hits] for (i, _), hits in zip(items, found)) >= least * len(items)


def test_windows_are_as_long_as_the_items():
    rng = random.Random(4)
    items = [(n, "".join(rng.choice("abcdefgh") for _ in range(n))) for n in (30, 100, 400)]
    index = dc.ItemIndex(items, dc.Settings())
    assert sorted(b.steps for b in index.bands) == sorted(2 * len(x) for x in index.items)
    few = dc.ItemIndex(items, dc.Settings(target_recall=0.5))
    keys = lambda x: sum(len(k) for b in x.bands for _, k in b.walks)
    assert keys(few) < keys(index)


def test_copies_in_texts_without_spaces():
    han = "".join(chr(0x4E00 + (i * i * 31 + 7 * i) % 2000) for i in range(400))
    item = han[150:200]
    rng = random.Random(3)
    line = "".join(rng.choice("abcdefghijklmnop") for _ in range(300))
    index = dc.ItemIndex([(1, item), (2, line[100:180])], dc.Settings())
    changed = item[:20] + "天" + item[21:]
    found = index.find([han, han[:90] + changed + han[:80], line, "x" * 50 + line[100:180], han[:140]])
    assert [[h[0] for h in hits] for hits in found] == [[1], [1], [2], [2], []]
    assert found[0][0] == (1, 0, 150, 200) and found[2][0] == (2, 0, 100, 180)


def test_item_of_one_character():
    index = dc.ItemIndex([(1, "-" * 200), (2, ITEM)], dc.Settings())
    found = index.find(["a " + "-" * 199 + " b " + ITEM, "-" * 100, ITEM])
    assert [[h[0] for h in hits] for hits in found] == [[1, 2], [], [2]]


def test_short_items_are_found_exactly(spark):
    docs = [(1, "a TINY  box"), (2, "tin y"), (3, "xtinyx"), (4, "the short\nitem is here"), (5, "the shor item is here"), (6, "這是短句。")]
    got = spans(spark, docs, [(1, "tiny"), (2, "short item is"), (3, "短"), (4, " "), (5, "")])
    assert got == [(1, 1, 0, 2, 6), (3, 1, 0, 1, 5), (4, 2, 0, 4, 17), (6, 3, 0, 2, 3)]
