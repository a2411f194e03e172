"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over fixed-length
windows, each filter keeps its largest response, and a softmax layer gives
the language. The network is trained in numpy on a bounded sample of windows
and applied to every window of every text; a text's prediction is the mean
over its windows, weighted by their letters.

For prediction the embedding and the filters are multiplied out once into
tables: a filter's response is then a sum of table rows looked up by pairs of
neighbouring bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from convolytics.llm.common import in_parts, require_columns, text_source, tidy
from convolytics.llm.sampling import per_label

UNKNOWN = "und"
WINDOW = 256
WIDTHS = (2, 3, 4)
OVERLAP = max(WIDTHS) - 1
CLASSES = 64  # distinct byte classes: padding, the most frequent bytes, all others
_LETTER = re.compile(r"[^\W\d_]")


def _fold() -> np.ndarray:
    """Byte -> byte with ASCII capitals lowered and white space made one."""
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    fold[[9, 10, 11, 12, 13]] = 32
    return fold


_FOLD = _fold()
_IS_LETTER = np.zeros(256, np.float32)
_IS_LETTER[97:123] = 1
_IS_LETTER[0x80:] = 0.5


def windows(raw: bytes) -> np.ndarray:
    """The fixed-length windows that cover ``raw`` (k x WINDOW, folded,
    padded with byte 0), overlapping by the widest filter less one, so every
    run of bytes a filter can see lies whole in some window."""
    step = WINDOW - OVERLAP
    k = max(1, -(-(len(raw) - OVERLAP) // step))
    padded = np.zeros((k - 1) * step + WINDOW, np.uint8)
    padded[: len(raw)] = np.frombuffer(raw, np.uint8)
    return np.lib.stride_tricks.as_strided(_FOLD[padded], (k, WINDOW), (step, 1))


@dataclass
class ByteCnn:
    languages: list[str]
    classes: np.ndarray  # byte -> class
    embedding: np.ndarray  # class x E
    filters: list[np.ndarray]  # per width: (width x E) x F
    biases: list[np.ndarray]
    out: np.ndarray  # (widths x F) x languages
    out_bias: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """Per width, the tables whose looked-up rows add up to the filters'
        responses: one per pair of neighbouring bytes, and one for a last
        single byte."""
        e = self.embedding.shape[1]
        found = []
        for width, k, bias in zip(WIDTHS, self.filters, self.biases):
            single = [self.embedding @ k[j * e : (j + 1) * e] for j in range(width)]
            single[0] = single[0] + bias
            pairs = [
                (single[j][:, None, :] + single[j + 1][None, :, :]).reshape(CLASSES * CLASSES, -1)
                for j in range(0, width - 1, 2)
            ]
            found.append([t.astype(np.float32) for t in pairs + single[width - width % 2 :]])
        return found

    def probabilities(self, win: np.ndarray, tables: list[list[np.ndarray]], block: int = 16) -> np.ndarray:
        """Softmax per window."""
        out = np.empty((len(win), len(self.languages)))
        for at in range(0, len(win), block):
            cls = self.classes[win[at : at + block]].astype(np.int32)
            pair = cls[:, :-1] * CLASSES + cls[:, 1:]
            pooled = []
            for width, tabs in zip(WIDTHS, tables):
                n = WINDOW - width + 1
                response = tabs[0].take(pair[:, :n], axis=0)
                for j, tab in enumerate(tabs[1:], 1):
                    index = pair if len(tab) > CLASSES else cls
                    response += tab.take(index[:, 2 * j : 2 * j + n], axis=0)
                pooled.append(np.maximum(response.max(axis=1), 0))
            out[at : at + block] = _softmax(np.concatenate(pooled, axis=1) @ self.out + self.out_bias)
        return out


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(
    win: np.ndarray, label: np.ndarray, languages: list[str], embed: int = 8, n_filters: int = 16, epochs: int = 8,
    batch: int = 64, rate: float = 0.01, seed: int = 5,
) -> ByteCnn:
    """Fits the network to labelled windows with Adam on the cross-entropy."""
    rng = np.random.default_rng(seed)
    common = np.argsort(-np.bincount(win[win > 0], minlength=256), kind="stable")[: CLASSES - 2]
    classes = np.full(256, CLASSES - 1, np.uint8)
    classes[common] = np.arange(1, CLASSES - 1)
    classes[0] = 0
    x = classes[win].astype(np.int64)
    n_lang = len(languages)
    params = [rng.normal(0, 0.3, (CLASSES, embed))]
    for w in WIDTHS:
        params += [rng.normal(0, (w * embed) ** -0.5, (w * embed, n_filters)), np.zeros(n_filters)]
    params += [rng.normal(0, 0.1, (len(WIDTHS) * n_filters, n_lang)), np.zeros(n_lang)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            grads = _gradients(params, x[pick], label[pick], embed)
            t += 1
            for p, g, a, b in zip(params, grads, m, v):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return ByteCnn(languages, classes, params[0], params[1:-2:2], params[2:-2:2], params[-2], params[-1])


def _gradients(params: list[np.ndarray], x: np.ndarray, y: np.ndarray, embed: int) -> list[np.ndarray]:
    emb, out, out_bias = params[0], params[-2], params[-1]
    b, n_filters = len(x), params[1].shape[1]
    rows = np.arange(b)[:, None]
    pooled, best, patches = [], [], []
    for i, w in enumerate(WIDTHS):
        k, bias = params[1 + 2 * i], params[2 + 2 * i]
        n = x.shape[1] - w + 1
        vec = emb[x]
        patch = np.concatenate([vec[:, j : j + n] for j in range(w)], axis=2)
        response = patch.reshape(b * n, -1) @ k
        response = response.reshape(b, n, n_filters) + bias
        top = response.argmax(axis=1)
        best.append(top)
        patches.append(patch[rows, top])  # b x F x (w E)
        pooled.append(np.maximum(np.take_along_axis(response, top[:, None, :], 1)[:, 0], 0))
    h = np.concatenate(pooled, axis=1)
    d = _softmax(h @ out + out_bias)
    d[np.arange(b), y] -= 1
    d /= b
    d_h = d @ out.T
    d_emb = np.zeros_like(emb)
    middle: list[np.ndarray] = []
    for i, w in enumerate(WIDTHS):
        g = d_h[:, i * n_filters : (i + 1) * n_filters] * (pooled[i] > 0)
        middle += [np.einsum("bf,bfe->ef", g, patches[i]), g.sum(axis=0)]
        back = g[:, :, None] * params[1 + 2 * i].T[None]  # b x F x (w E)
        for j in range(w):
            np.add.at(d_emb, x[rows, best[i] + j], back[:, :, j * embed : (j + 1) * embed])
    return [d_emb, *middle, h.T @ d, d.sum(axis=0)]


def fit(
    docs: DataFrame, allowed: Column, per_language: int = 1000, max_languages: int = 512, seed: int = 5,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> ByteCnn | None:
    """Trains on at most ``per_language`` windows of each language, from rows
    that ``allowed`` selects and that have a language and some text. A window
    starts at a place of the text given by a hash of the row. Returns None if
    there is nothing to learn from."""
    chars = WINDOW  # characters: at least a window's bytes unless the text ends
    text = F.col(text_col)
    span = F.greatest(F.lit(1), F.length(text) - chars)
    start = (F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), span) + 1).cast("int")
    rows = docs.filter(allowed & F.col(lang_col).isNotNull() & (F.length(text) > 0)).select(
        F.col(lang_col).cast("string").alias("lang"),
        F.substring(text, start, F.lit(chars)).alias("window"),
        F.col(id_col).cast("long").alias("id"),
    )
    sample = per_label(rows, "lang", ["id", "window"], per_language, seed, max_languages)
    found = sample.select("lang", "window").collect()  # at most per_language x max_languages windows
    languages = sorted({r["lang"] for r in found})
    if not found:
        return None
    number = {lang: k for k, lang in enumerate(languages)}
    found.sort(key=lambda r: (r["lang"], r["window"]))
    win = np.stack([windows(r["window"].encode("utf-8", "replace")[:WINDOW])[0] for r in found])
    return train(win, np.asarray([number[r["lang"]] for r in found]), languages, seed=seed)


def predict(docs: DataFrame, model: ByteCnn | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (the mean probability of that
    language over the text's windows) to the columns ``keep`` (default: the
    id). Null texts and texts without a letter, and all texts if the model is
    None, are ``und`` with score 0. Repeated rows each get a row."""
    keep = [id_col] if keep is None else keep
    require_columns(docs, [*keep, text_col])
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    source, texts_of = text_source(docs, keep, text_col)
    kept = source.schema.fields[: len(keep)]
    schema = StructType([*kept, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables() if model is not None else []
        for batch in batches:
            langs, scores = score_texts(model, tables, texts_of(batch))
            columns = [*batch.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield from in_parts(pa.RecordBatch.from_arrays(columns, names=schema.names))

    return source.mapInArrow(tidy(run), schema)


def score_texts(model: ByteCnn | None, tables, texts, flush: int = 1024) -> tuple[list[str], list[float]]:
    """Language and score of each text; windows of many texts are evaluated
    together, and a long text's windows part by part."""
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if model is None:
        return langs, scores
    sums = np.zeros((len(texts), len(model.languages)))
    weight = np.zeros(len(texts))
    pending: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    held = 0

    def evaluate() -> None:
        nonlocal held
        if not pending:
            return
        win, own = np.concatenate(pending), np.concatenate(owner)
        letters = _IS_LETTER[win].sum(axis=1)
        p = model.probabilities(win, tables) * letters[:, None]
        np.add.at(sums, own, p)
        np.add.at(weight, own, letters)
        pending.clear()
        owner.clear()
        held = 0

    for i, cell in enumerate(texts):
        text = cell.as_py()
        if not text or not _LETTER.search(text):
            continue
        win = windows(text.encode("utf-8", "replace"))
        for at in range(0, len(win), flush):
            part = win[at : at + flush]
            pending.append(part)
            owner.append(np.full(len(part), i))
            held += len(part)
            if held >= flush:
                evaluate()
    evaluate()
    for i in np.flatnonzero(weight > 0).tolist():
        k = int(sums[i].argmax())
        langs[i], scores[i] = model.languages[k], float(min(1.0, sums[i, k] / weight[i]))
    # letters that are neither ASCII nor multi-byte cannot occur, so a text
    # with a letter always has weight
    return langs, scores
