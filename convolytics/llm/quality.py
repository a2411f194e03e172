"""Quality classifier: a generalised additive model with pairwise terms.

Each document becomes a few dozen numbers computed from its whole text. The
numbers are put into quantile bins; boosting then goes round the features
again and again, each time fitting one shallow tree on that feature's bins to
the current residuals and adding its steps to the feature's lookup table.
The pairs of features with the strongest interactions get tables over pairs
of coarser bins in the same way. A score is the sum of looked-up values
through the logistic function.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from convolytics.llm.common import require_columns
from convolytics.llm.sampling import labelled_texts

_BYTE_SETS = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "high": range(128, 256),
    "newline": [10],
    "tab": [9],
    "sentence": [46],
    "comma": [44],
    "shout": [33],
    "question": [63],
    "pipe": [124],
    "slash": [47, 92],
    "at": [64],
    "colon": [58, 59],
    "symbol": [35, 36, 37, 38, 42, 94, 126],
    "bracket": [40, 41, 60, 62, 91, 93, 123, 125],
    "dash": [45, 95, 61, 43],
    "quote": [34, 39, 96],
    "control": [*range(0, 9), *range(11, 32), 127],
}
_SET_NAMES = list(_BYTE_SETS)
_MASKS = np.zeros((256, len(_SET_NAMES)))
for _k, _name in enumerate(_SET_NAMES):
    _MASKS[list(_BYTE_SETS[_name]), _k] = 1

FEATURES = [
    "log_bytes",
    *[f"share_{n}" for n in _SET_NAMES],
    "word_length",
    "distinct_words",
    "commas_per_sentence",
    "words_per_line",
    "words_per_sentence",
    "repeated_lines",
    "repeated_sentences",
]


def features(text: str | None) -> list[float]:
    """The numbers of one whole text; null counts as empty, whose numbers
    are all 0."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "replace")
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    sets = counts @ _MASKS
    words = text.split()
    n_words = max(1, len(words))
    spaces = int(counts[32]) + int(sets[4])
    lines = [x for x in text.split("\n") if x.strip()]
    sentences = text.split(". ")
    n_sent = max(1, int(counts[46]))
    return [
        float(np.log1p(n)),
        *(sets / n).tolist(),
        (n - spaces) / n_words,
        len(set(words)) / n_words,
        int(counts[44]) / n_sent,
        n_words / max(1, len(lines)),
        n_words / n_sent,
        1 - len(set(lines)) / max(1, len(lines)),
        1 - len(set(sentences)) / len(sentences),
    ]


@dataclass
class AdditiveModel:
    edges: list[np.ndarray]  # per feature: inner bin edges
    tables: list[np.ndarray]  # per feature: value per bin
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]  # per pair: value per coarse bin x coarse bin
    coarse: list[np.ndarray]  # per feature: bin -> coarse bin
    bias: float

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.bias)
        for f, table in enumerate(self.tables):
            z += table[b[f]]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            z += table[self.coarse[i][b[i]], self.coarse[j][b[j]]]
        return z

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(x)))


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int, reg: float) -> np.ndarray:
    """A shallow regression tree over ordered bins: the best split is made
    until there are ``leaves`` ranges; returns the step of every bin."""
    cuts = [0, len(grad)]
    g, h = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(hess)])

    def gain(a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray:
        return (g[b] - g[a]) ** 2 / (h[b] - h[a] + reg)

    for _ in range(leaves - 1):
        best, where = 1e-9, None
        for a, b in zip(cuts, cuts[1:]):
            if b - a < 2:
                continue
            at = np.arange(a + 1, b)
            won = gain(a, at) + gain(at, b) - gain(a, b)
            k = int(won.argmax())
            if won[k] > best:
                best, where = float(won[k]), int(at[k])
        if where is None:
            break
        cuts = sorted([*cuts, where])
    step = np.zeros(len(grad))
    for a, b in zip(cuts, cuts[1:]):
        step[a:b] = -(g[b] - g[a]) / (h[b] - h[a] + reg)
    return step


def _pair_tree(grad: np.ndarray, hess: np.ndarray, reg: float) -> tuple[np.ndarray, float]:
    """A tree of depth two over a grid: one split of one axis, then one of
    the other axis on each side. Returns the steps and the gain."""
    best, steps = -1.0, np.zeros_like(grad)
    for axis in (0, 1):
        g, h = (grad, hess) if axis == 0 else (grad.T, hess.T)
        for cut in range(1, g.shape[0]):
            total, parts = 0.0, []
            for rows in (slice(0, cut), slice(cut, None)):
                a, b = np.cumsum(g[rows].sum(axis=0)), np.cumsum(h[rows].sum(axis=0))
                won = a[:-1] ** 2 / (b[:-1] + reg) + (a[-1] - a[:-1]) ** 2 / (b[-1] - b[:-1] + reg)
                k = int(won.argmax()) if len(won) else 0
                total += float(won[k]) if len(won) else 0.0
                parts.append((rows, k + 1, -a[k] / (b[k] + reg), -(a[-1] - a[k]) / (b[-1] - b[k] + reg)))
            if total > best:
                best = total
                out = np.zeros_like(g)
                for rows, k, left, right in parts:
                    out[rows, :k] = left
                    out[rows, k:] = right
                steps = out if axis == 0 else out.T
    return steps, best - float(grad.sum() ** 2 / (hess.sum() + reg))


def train(
    x: np.ndarray, y: np.ndarray, max_bins: int = 64, coarse_bins: int = 8, rounds: int = 120, pair_rounds: int = 40,
    n_pairs: int = 8, leaves: int = 3, rate: float = 0.15, reg: float = 2.0, weight: np.ndarray | None = None,
) -> AdditiveModel:
    """Cyclic boosting of the logistic loss, first the single features, then
    the chosen pairs. With one label only, the model is its smoothed rate.
    ``weight`` says how many examples each row stands for, up to a factor."""
    w = np.ones(len(y)) if weight is None or not len(y) else weight * (len(y) / weight.sum())
    rate_1 = (float(w @ y) + 0.5) / (len(y) + 1.0)
    edges, coarse = [], []
    for f in range(x.shape[1]):
        inner = np.unique(np.quantile(x[:, f], np.arange(1, max_bins) / max_bins)) if len(x) else np.zeros(0)
        edges.append(inner)
        coarse.append(np.arange(len(inner) + 1) * coarse_bins // (len(inner) + 1))
    model = AdditiveModel(edges, [np.zeros(len(e) + 1) for e in edges], [], [], coarse, float(np.log(rate_1 / (1 - rate_1))))
    if len(np.unique(y)) < 2:
        return model
    b = model.bins(x)
    z = np.full(len(x), model.bias)

    def residuals() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return w * (p - y), w * p * (1 - p)

    for _ in range(rounds):
        for f, table in enumerate(model.tables):
            if len(table) < 2:
                continue
            g, h = residuals()
            step = rate * _tree(np.bincount(b[f], g, len(table)), np.bincount(b[f], h, len(table)), leaves, reg)
            table += step
            z += step[b[f]]
    # the pairs whose grids still hold the most to gain
    g, h = residuals()
    cells = {f: coarse[f][b[f]] for f in range(x.shape[1]) if len(model.tables[f]) > 1}

    def grid(i: int, j: int, values: np.ndarray) -> np.ndarray:
        return np.bincount(cells[i] * coarse_bins + cells[j], values, coarse_bins**2).reshape(coarse_bins, coarse_bins)

    gains = [(_pair_tree(grid(i, j, g), grid(i, j, h), reg)[1], i, j) for i in cells for j in cells if i < j]
    model.pairs = [(i, j) for _, i, j in sorted(gains, key=lambda t: (-t[0], t[1], t[2]))[:n_pairs]]
    model.pair_tables = [np.zeros((coarse_bins, coarse_bins)) for _ in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), table in zip(model.pairs, model.pair_tables):
            g, h = residuals()
            step = rate * _pair_tree(grid(i, j, g), grid(i, j, h), reg)[0]
            table += step
            z += step[cells[i], cells[j]]
    return model


def feature_rows(texts: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """``keep`` and the array ``features`` of each row."""
    source = texts.select(*[F.col(c) for c in keep], F.col(text_col).alias("_text"))
    schema = StructType(source.schema.fields[:-1]).add("features", ArrayType(DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(x.as_py()) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(made, pa.list_(pa.float64()))], names=schema.names)

    return source.mapInArrow(run, schema)


def fit(
    docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "quality", per_label_rows: int = 6000, seed: int = 3,
) -> AdditiveModel:
    """Trains on at most ``per_label_rows`` documents of each label; their
    numbers come to the driver, never their texts. Where a label has more
    documents, those drawn stand for all of them, so scores keep the labels'
    true shares. Without labels every score is one half."""
    sample = labelled_texts(docs, labels, label, allowed, per_label_rows, seed)
    rows = feature_rows(sample, ["doc_id", "label"], "text").collect()
    rows.sort(key=lambda r: r["doc_id"])
    x = np.asarray([r["features"] for r in rows]).reshape(len(rows), len(FEATURES))
    y = np.asarray([float(r["label"]) for r in rows])
    return train(x, y, weight=_stands_for(labels, label, allowed, y, per_label_rows))


def _stands_for(labels: DataFrame, label: str, allowed: Column, y: np.ndarray, drawn: int) -> np.ndarray:
    """How many labelled documents each row of the sample stands for."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & allowed)
    one = known.groupBy("doc_id").agg(F.max((F.col(label) > 0).cast("int")).alias("label"))
    counts = {r["label"]: r["count"] for r in one.groupBy("label").count().collect()}  # two rows
    weight = np.ones(len(y))
    for v in (0, 1):
        n = int((y == v).sum())
        if n and counts.get(v, 0) > drawn:
            weight[y == v] = counts[v] / n
    return weight


def score(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every document, from its whole text. Null and
    empty texts are scored as all-zero numbers; repeated rows each get one."""
    require_columns(docs, [id_col, text_col])
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    schema = StructType([source.schema["doc_id"], StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray([features(t.as_py()) for t in batch.column(1)]).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], names=schema.names)

    return source.mapInArrow(run, schema)
