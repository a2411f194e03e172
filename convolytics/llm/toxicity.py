"""Toxicity by the nearest labelled examples under TF-IDF cosine.

Terms are words and word beginnings. A vocabulary of terms that set the
labels apart is chosen on the labelled examples; inverse document
frequencies come from all documents. All
words of a text share one more place, so one slip in a long text is not as near to
an abusive example as an abusive text is. The examples' vectors form an inverted
index cut into blocks of examples, with the largest weight of every term in
every block. A query adds up the block maxima of its terms, which bounds every
cosine in a block, and reads blocks from the highest bound down until no
unread block can hold a nearer example: the nearest examples are exact. Their
cosines weight their votes, and a prior keeps thin evidence near the base
rate.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (ArrayType, DoubleType, FloatType, IntegerType, LongType, StructField, StructType)

from convolytics.llm.common import in_parts, require_columns, staged, text_source, tidy
from convolytics.llm.sampling import labelled_texts

PREFIXES = range(3, 9)  # letters of a word beginning
_EDGES = ".,!?;:\"'()[]{}<>|#$%&*@^~`_-+=/\\"


def term_of(word: str) -> Iterator[str]:
    """A word and, marked with a star, its proper beginnings."""
    yield word
    for k in PREFIXES:
        if len(word) <= k:
            break
        yield word[:k] + "*"


def terms(text: str) -> Counter:
    """The terms of all words (lower case, punctuation stripped from their
    ends) with their counts."""
    found: Counter[str] = Counter()
    for word, n in Counter(text.lower().split()).items():
        word = word.strip(_EDGES)
        if word:
            for t in term_of(word):
                found[t] += n
    return found


def term_labels(sample: DataFrame) -> DataFrame:
    """``term, n0, n1``: in how many examples of each label a term occurs.
    Each task counts before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = [Counter(), Counter()]

        def out() -> pa.RecordBatch:
            names = list(have[0].keys() | have[1].keys())
            columns = [pa.array(names, pa.string()), *(pa.array([h[t] for t in names], pa.int64()) for h in have)]
            for h in have:
                h.clear()
            return pa.RecordBatch.from_arrays(columns, names=["term", "n0", "n1"])

        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                have[y].update(terms(text.as_py() or "").keys())
                if len(have[0]) + len(have[1]) > 300_000:
                    yield out()
        yield out()

    counted = sample.select("label", "text").mapInArrow(run, "term string, n0 long, n1 long")
    return counted.groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def choose_vocabulary(sample: DataFrame, n: tuple[int, int], size: int = 2048, least_ratio: float = 3.0, least_g2: float = 20.0) -> list[str]:
    """The terms whose presence differs most between the labels (``n``
    examples of each): the largest log-likelihood ratios, at least
    ``least_g2``, with rates that differ by ``least_ratio`` or more; ties to
    longer terms. Of a beginning and its continuations only the one that
    tells most is kept."""
    if not n[0] or not n[1]:
        return []
    a, b = F.col("n0"), F.col("n1")
    r0, r1 = (a + 0.5) / (n[0] + 1), (b + 0.5) / (n[1] + 1)
    share = (a + b) / float(n[0] + n[1])

    def part(k, expected):
        return F.when(k > 0, 2 * k * F.log(k / expected)).otherwise(0.0)

    g2 = part(a, share * n[0]) + part(n[0] - a, (1 - share) * n[0]) + part(b, share * n[1]) + part(n[1] - b, (1 - share) * n[1])
    told = term_labels(sample).filter((a + b >= 3) & (F.greatest(r0 / r1, r1 / r0) >= least_ratio))
    told = told.select(F.round(g2, 9).alias("g2"), "term").filter(F.col("g2") >= least_g2)
    best = told.orderBy(F.col("g2").desc(), F.length("term").desc(), "term").limit(20 * size)
    scored = [(-r["g2"], -len(r["term"]), r["term"]) for r in best.collect()]
    chosen: list[str] = []
    begun: set[str] = set()  # beginnings of chosen terms
    whole: set[str] = set()  # chosen terms
    for _, _, term in sorted(scored):
        stem = term.rstrip("*")
        if stem in begun or any(stem[:k] in whole for k in range(1, len(stem) + 1)):
            continue
        chosen.append(term)
        whole.add(stem)
        begun.update(stem[:k] for k in range(1, len(stem) + 1))
        if len(chosen) == size:
            break
    return chosen


class BlockMaxIndex:
    """Inverted index over unit vectors, cut into blocks of ``block``
    examples. Postings of a term lie together, block by block."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, labels: np.ndarray, n_terms: int, block: int = 64):
        # like vectors side by side make the block maxima tight
        lead = [int(t[w.argmax()]) for t, w in vectors]
        order = sorted(range(len(vectors)), key=lambda i: (lead[i], int(ids[i])))
        self.ids, self.labels, self.block = ids[order], labels[order], block
        self.n_blocks = -(-len(order) // block) if order else 0
        term = np.concatenate([vectors[i][0] for i in order]) if order else np.zeros(0, np.int64)
        weight = np.concatenate([vectors[i][1] for i in order]) if order else np.zeros(0)
        place = np.repeat(np.arange(len(order)), [len(vectors[i][0]) for i in order])
        by = np.lexsort((place, term))
        self.place, self.weight = place[by], weight[by]
        cell = term[by] * max(1, self.n_blocks) + place[by] // block
        self.starts = np.searchsorted(cell, np.arange(n_terms * max(1, self.n_blocks) + 1))
        self.maxima = np.zeros((n_terms, max(1, self.n_blocks)))
        np.maximum.at(self.maxima.reshape(-1), cell, self.weight)

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The ``k`` examples of largest positive cosine, ties to smaller
        ids, as (cosine, place)."""
        if not self.n_blocks or not len(term):
            return []
        bound = weight @ self.maxima[term]
        best: list[tuple[float, int, int]] = []
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or (len(best) == k and bound[b] < best[-1][0] - 1e-12):
                break
            sums = np.zeros(self.block)
            for t, w in zip(term.tolist(), weight.tolist()):
                at, to = self.starts[t * self.n_blocks + b], self.starts[t * self.n_blocks + b + 1]
                sums[self.place[at:to] - b * self.block] += w * self.weight[at:to]
            hit = np.flatnonzero(sums > 0)
            best += [(float(sums[h]), int(self.ids[b * self.block + h]), b * self.block + int(h)) for h in hit]
            best = sorted(best, key=lambda x: (-x[0], x[1]))[:k]
        return [(s, place) for s, _, place in best]


@dataclass
class ToxicityModel:
    vocabulary: list[str]
    idf: np.ndarray
    index: BlockMaxIndex
    prior: float  # rate of label 1 among examples without any term
    vote: tuple[float, float]  # weight of an example's vote, by label
    k: int
    prior_weight: float

    def vector(self, term: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return unit(term, count, self.idf)

    def score(self, term: np.ndarray, count: np.ndarray) -> tuple[float, list[tuple[float, int]]]:
        near = self.index.nearest(*self.vector(term, count), self.k)
        weights = [s * self.vote[int(self.index.labels[p])] for s, p in near]
        votes = sum(weights)
        ones = sum(w for w, (_, p) in zip(weights, near) if self.index.labels[p])
        return (ones + self.prior * self.prior_weight) / (votes + self.prior_weight), near


def unit(term: np.ndarray, count: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The TF-IDF vector of length one."""
    w = (1 + np.log(count)) * idf[term]
    return term, w / max(1e-12, float(np.sqrt((w * w).sum())))


def term_counter(vocabulary: list[str]) -> Callable[[str | None], Counter[int]]:
    """Counts a text's terms by their places in the vocabulary; the place
    after the last is for all words."""
    place = {t: i for i, t in enumerate(vocabulary)}
    # a text is searched for its words; only words that begin like a term are
    # looked at closer
    begins = frozenset(t[:3] for t in vocabulary)

    def count(text: str | None) -> Counter[int]:
        found: Counter[int] = Counter()
        if text and place:
            words = Counter(text.lower().split())
            found[len(place)] = words.total()  # the place of all words
            for word, n in words.items():
                if word[:3] not in begins and word[0] not in _EDGES:
                    continue
                word = word.strip(_EDGES)
                for t in term_of(word):
                    if t in place:
                        found[place[t]] += n
        return found

    return count


def count_terms(rows: DataFrame, vocabulary: list[str], keep: list[str], text_col: str) -> DataFrame:
    """``keep``, ``terms`` (places in the vocabulary; the place after the last
    is for all words) and ``counts`` of every row, from its whole text."""
    source, texts_of = text_source(rows, keep, text_col)
    schema = StructType(source.schema.fields[: len(keep)]).add("terms", ArrayType(IntegerType())).add("counts", ArrayType(IntegerType()))
    count = term_counter(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms_of, counts_of = [], []
            for cell in texts_of(batch):
                found = count(cell.as_py())
                terms_of.append(sorted(found))
                counts_of.append([found[t] for t in sorted(found)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(terms_of, pa.list_(pa.int32())), pa.array(counts_of, pa.list_(pa.int32()))],
                names=schema.names,
            )

    return source.mapInArrow(tidy(run), schema)


def score(
    docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "toxic", per_label_rows: int = 4000, k: int = 15,
    prior_weight: float = 1.0, seed: int = 9, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None,
    store: bool = True,
) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``evidence`` (the nearest examples:
    ``doc_id, label, cosine``, nearest first) to the columns ``keep``
    (default: the id) of every document.

    The examples are a sample of at most ``per_label_rows`` documents per
    label among ids that ``allowed`` selects; null labels teach nothing. The
    texts are read once for the examples and once for all term counts, which
    are stored; with ``store`` off (``keep`` holds whole rows) they are counted
    a second time instead, by the tasks that score them. A text without any vocabulary term (null, empty or plain) has
    no evidence and gets the rate of label 1 among such examples, or among
    all if there are none; without any label that is one half. Repeated rows each get a row.
    """
    keep = [id_col] if keep is None else keep
    require_columns(docs, [*keep, id_col, text_col])
    sample = staged(labelled_texts(docs, labels, label, allowed, per_label_rows, seed, id_col, text_col), "examples")
    sampled = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    vocabulary = choose_vocabulary(sample, (sampled.get(0, 0), sampled.get(1, 0)))

    counted = staged(count_terms(docs, vocabulary, keep, text_col), "terms") if store else None
    narrow = counted if counted is not None else count_terms(docs, vocabulary, [id_col], text_col)
    per_term = narrow.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    n_docs = docs.count()
    idf = np.full(len(vocabulary) + 1, math.log(n_docs + 1) + 1)
    for r in per_term.collect():  # one row per vocabulary term
        idf[r["term"]] = math.log((n_docs + 1) / (r["n"] + 1)) + 1

    vectors, ids, ys, plain = [], [], [], []
    examples = count_terms(sample, vocabulary, ["doc_id", "label"], "text").collect()  # a few numbers each
    for r in sorted(examples, key=lambda r: r["doc_id"]):
        if len(r["terms"]) > 1:
            vectors.append(unit(np.asarray(r["terms"]), np.asarray(r["counts"], np.float64), idf))
            ids.append(r["doc_id"])
            ys.append(r["label"])
        else:
            plain.append(r["label"])
    index = BlockMaxIndex(vectors, np.asarray(ids, np.int64), np.asarray(ys, np.int64), len(vocabulary) + 1)
    # labels are sampled evenly: a vote weighs as many labelled rows as it
    # stands for, and so does the rate of examples without a term
    counts = _label_counts(labels, label, allowed, id_col)
    stands = [counts.get(y, 0) / max(1, sampled.get(y, 0)) for y in (0, 1)]
    mean = sum(counts.values()) / max(1, len(examples)) or 1.0
    rate = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    bare = [sum(1 for p in plain if p == y) * stands[y] + 0.01 * share for y, share in ((0, 1 - rate), (1, rate))]
    prior = bare[1] / sum(bare)
    model = ToxicityModel(vocabulary, idf, index, prior, (stands[0] / mean, stands[1] / mean), k, prior_weight)
    return _scored(counted, model, keep) if counted is not None else _scored_texts(docs, model, keep, text_col)


def _label_counts(labels: DataFrame, label: str, allowed: Column, id_col: str) -> dict[int, int]:
    rows = (
        labels.select(F.col(id_col).alias("doc_id"), (F.col(label) > 0).cast("int").alias("y"))
        .filter(allowed & F.col("y").isNotNull())
        .groupBy("y")
        .count()
        .collect()
    )
    return {r["y"]: r["count"] for r in rows}


_Terms = Iterable[tuple[list[int], list[int]]]


def _scored(counted: DataFrame, model: ToxicityModel, keep: list[str]) -> DataFrame:
    def terms_of(batch: pa.RecordBatch) -> _Terms:
        for t, n in zip(batch.column(len(keep)), batch.column(len(keep) + 1)):
            yield t.as_py(), n.as_py()

    return _judged(counted, terms_of, model, len(keep))


def _scored_texts(docs: DataFrame, model: ToxicityModel, keep: list[str], text_col: str) -> DataFrame:
    """The same from the texts: rows cross to Python and back once."""
    source, texts_of = text_source(docs, keep, text_col)
    count = term_counter(model.vocabulary)

    def terms_of(batch: pa.RecordBatch) -> _Terms:
        for cell in texts_of(batch):
            found = count(cell.as_py())
            yield (places := sorted(found)), [found[t] for t in places]

    return _judged(source, terms_of, model, len(keep))


def _judged(rows: DataFrame, terms_of: Callable[[pa.RecordBatch], _Terms], model: ToxicityModel, kept: int) -> DataFrame:
    near = ArrayType(StructType([StructField("doc_id", LongType()), StructField("label", IntegerType()), StructField("cosine", FloatType())]))
    schema = StructType(rows.schema.fields[:kept]).add("score", DoubleType()).add("evidence", near)
    near_arrow = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = model.index
        for batch in batches:
            scores, evidence = [], []
            for t, n in terms_of(batch):
                s, found = model.score(np.asarray(t, np.int64), np.asarray(n, np.float64)) if len(t) > 1 else (model.prior, [])
                scores.append(s)
                evidence.append([{"doc_id": int(index.ids[p]), "label": int(index.labels[p]), "cosine": c} for c, p in found])
            columns = [*batch.columns[:kept], pa.array(scores, pa.float64()), pa.array(evidence, near_arrow)]
            yield from in_parts(pa.RecordBatch.from_arrays(columns, names=schema.names))

    return rows.mapInArrow(tidy(run), schema)
