"""Exact Jaccard self-join of documents' word shingles by PartEnum signatures.

A document is the set of its distinct word shingles, hashed to 64 bits. Two
sets of Jaccard similarity t or more differ in a bounded number k of
elements once their sizes lie in one band. The hash domain is split into n1
partitions of n2 cells each; some first-level partition then holds at most
k2 = floor(k / n1) of the differences, and some n2 - k2 of its cells none.
The signature of every such subset of cells (their elements' sum) is
enumerated, so sufficiently similar sets share one signature for certain.
Long sets take one level of a few more cells than can hold differences, and
only the signatures of their fuller cells: see ``signatures``. Empty cells
and those of one element, which sets that have nothing to do with each other
share, thus make no groups.

Sharing a signature only makes candidates. In every group of equal signatures
each set is first checked against one hub of the group, and linked sets are
joined into components. In groups that still hold several components (many
variants of one text) the sets of different components are compared by
small parity sketches, whose differing bits never outnumber the differing
elements; of the pairs that pass, a forest that would join the components
leaves the task first, to be checked exactly, and then, in rounds, what the
components found leave apart. A
group of more members than one task should hold is regrouped by its sets'
rarest elements, of which similar sets must share one, and checked against
more and more hubs until no group holds two untested components. So no
unbounded group is gathered in one task, no group is expanded into all its
pairs, and no link between two components is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from convolytics.llm.common import drop_staged, require_columns, staged, tidy, whole_groups
from convolytics.llm.components import connected_components

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_CUT = 1 << 20  # bytes hashed at a time
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SET_BYTES = 6  # of each element kept for the exact check
_SKETCH_BITS = 1024


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        out = np.full(_CUT + 1, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return run(_BASE), run(_INVERSE)


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of every word (run of bytes other than white space),
    from running polynomial sums over the bytes. A word that goes on over
    the bytes summed at a time carries its sum and length along."""
    power, inverse = _powers()
    out, carry, size = [], 0, 0
    for at in range(0, len(raw), _CUT):
        b = np.frombuffer(raw, np.uint8, min(_CUT, len(raw) - at), at)
        gap = _SPACE[b]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]])))
        start, stop = edge[::2], edge[1::2]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + _U(1)) * power[: len(b)], dtype=np.uint64)])
        part, n = (sums[stop] - sums[start]) * inverse[start], (stop - start).astype(np.uint64)
        if size and len(start) and start[0] == 0:
            part[:1] = part[:1] * _U(pow(_BASE, size, 1 << 64)) + _U(carry)
            n[:1] += _U(size)
        elif size:
            part, n = np.concatenate([[_U(carry)], part]), np.concatenate([[_U(size)], n])
        carry, size = 0, 0
        if at + len(b) < len(raw) and len(stop) and stop[-1] == len(b):
            carry, size = int(part[-1]), int(n[-1])
            part, n = part[:-1], n[:-1]
        if len(part):
            out.append(_mix(part + n))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(text: str | None, words: int = 3) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles. A to Z are lowered; a
    text of fewer words is one shingle, one without words the empty set."""
    if not text:
        return np.zeros(0, np.uint64)
    w = word_hashes(text.encode("utf-8", "surrogatepass").lower())
    if not len(w):
        return w
    size = min(words, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for j in range(size):
        h = _mix(h * _U(3) + w[j : len(w) - size + 1 + j])
    return np.unique(h)


class Bands:
    """Size bands and the enumeration of every level, for similarity
    ``num / den`` or more."""

    def __init__(self, num: int = 90, den: int = 100):
        # a band spans sizes that differ by about 0.7: wider, and its sets
        # need more signatures; narrower, and more sets lie near two bands
        width = max(1, round(np.log(0.7) / np.log(num / den))) if num < den else 1
        self.num, self.den, self.width = num, den, width
        self.lows = [1]
        self.plans: dict[int, tuple[int, int, int]] = {}

    def _reach(self, size: int) -> None:
        while self.lows[-1] <= size:
            low = self.lows[-1]
            self.lows.append(max(low + 1, low * self.den**self.width // self.num**self.width + 1))

    def levels(self, size: int) -> list[int]:
        """The set's own band, and the next if a similar set may lie there."""
        self._reach(size)
        band = int(np.searchsorted(self.lows, size, side="right")) - 1
        self._reach(self.lows[band + 1])
        near = self.den * size >= self.num * self.lows[band + 1]
        return [band, band + 1] if near else [band]

    def plan(self, level: int) -> tuple[int, int, int]:
        """n1, n2 and k2 of a level. Sets of at most ``top`` elements that are
        similar differ in at most k = 2 top (den - num) / (den + num)."""
        if level not in self.plans:
            while len(self.lows) <= level + 1:
                self._reach(self.lows[-1])
            top = self.lows[level + 1] - 1
            k = 2 * top * (self.den - self.num) // (self.den + self.num)
            n1 = -(-(k + 1) // 3)
            k2 = k // n1
            # short sets take subsets of two cells, which few others share;
            # longer ones single cells, a fifth more than must be
            self.plans[level] = (n1, k2 + 2, k2) if k < 12 else ((k + 1) * 6 // 5, 1, 0)
        return self.plans[level]

    def differences(self, size: int, level: int) -> int:
        """The most elements that a set of ``size`` and one similar to it, both
        of the level, differ in."""
        self.plan(level)
        top = self.lows[level + 1] - 1
        return min(2 * top * (self.den - self.num) // (self.den + self.num), size * (self.den - self.num) // self.num)


def signatures(elements: np.ndarray, bands: Bands) -> np.ndarray:
    """All PartEnum signatures of a sorted set. Of single cells only the fuller
    are taken: with ``c`` cells and at most ``k`` differences, ``c - k`` cells
    or more hold the same elements in both sets. Fewer than ``c - k`` of a
    set's cells hold less than its ``least``, so one of those that are equal
    holds the ``least`` of either set, and both sets take it."""
    if not len(elements):
        return elements
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(elements ^ _U(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)])
    high = elements >> _U(32)
    out = []
    for level in bands.levels(len(elements)):
        n1, n2, k2 = bands.plan(level)
        cell = (high * _U(n1 * n2)) >> _U(32)  # sorted like the elements
        at = np.searchsorted(cell, np.arange(n1 * n2 + 1, dtype=np.uint64))
        in_cell = (sums[at[1:]] - sums[at[:-1]]).reshape(n1, n2)
        base = np.arange(n1, dtype=np.uint64) * _U(64)
        for s, chosen in enumerate(combinations(range(n2), n2 - k2)):
            total = _mix(base + _U((level << 40) + s))
            for j in chosen:
                total = _mix(total * _U(3) + in_cell[:, j])
            if n2 == 1:
                held = np.diff(at)
                spare = n1 - bands.differences(len(elements), level)
                total = total[held >= np.partition(held, spare - 1)[spare - 1]]
            out.append(total)
    return np.unique(np.concatenate(out))


def set_digest(elements: np.ndarray) -> int | None:
    """A 64-bit digest of a set; None for the empty set."""
    if not len(elements):
        return None
    return int(_mix(_mix(elements).sum(dtype=np.uint64, keepdims=True) + _U(len(elements))).view(np.int64)[0])


def sketch(elements: np.ndarray) -> bytes:
    """Parity bits of the elements' places: two sketches differ in at most as
    many bits as the sets differ in elements."""
    bits = np.bincount((elements & _U(_SKETCH_BITS - 1)).astype(np.int64), minlength=_SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def wide_sketch(elements: np.ndarray) -> bytes | None:
    """For sets that fill the small sketch: parity bits at as many places as
    the set has elements, a power of two. It is about a fiftieth of the set."""
    if len(elements) <= _SKETCH_BITS // 2:
        return None
    places = 1 << (len(elements) - 1).bit_length()
    bits = np.bincount((elements & _U(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def differing_bits(a: bytes, b: bytes) -> int:
    """Of two wide sketches, the longer folded to the length of the shorter."""
    x, y = (np.frombuffer(s, np.uint8) for s in sorted((a, b), key=len))
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def pack(elements: np.ndarray) -> bytes:
    return elements.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_SET_BYTES].tobytes()


def unpack(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // _SET_BYTES, 8), np.uint8)
    wide[:, :_SET_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, _SET_BYTES)
    return wide.reshape(-1).view("<u8")


@dataclass
class Corpus:
    """The documents, how their sets are made, and the table of
    ``document_sets``."""

    texts: DataFrame  # doc_id, text
    table: DataFrame
    words: int
    num: int
    den: int


_SETS = "doc_id long, n_shingles long, node long, sketch binary, wide binary, sigs array<long>"


_DOCS = 64  # whose signatures leave a task together


def document_sets(docs: DataFrame, bands: Bands, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, set size and ``node`` (a 64-bit digest of
    the set, null if empty); the set's sketches and signatures only where the
    task meets the set for the first time, so hot copies weigh one row per
    task from here on. The sets themselves are not stored."""
    require_columns(docs, [id_col, text_col])
    names = ["doc_id", "n_shingles", "node", "sketch", "wide", "sigs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column(0)
            for lo in range(0, batch.num_rows, _DOCS):
                size, node, sketches, wide, flat, ends = [], [], [], [], [], [0]
                for cell in batch.column(1).slice(lo, _DOCS):
                    s = shingle_set(cell.as_py(), words)
                    size.append(len(s))
                    digest = set_digest(s)
                    new = digest is not None and digest not in seen
                    if new:
                        if len(seen) > 1_000_000:
                            seen.clear()
                        seen.add(digest)
                        flat.append(signatures(s, bands))
                    node.append(digest)
                    sketches.append(sketch(s) if new else None)
                    wide.append(wide_sketch(s) if new else None)
                    ends.append(ends[-1] + (len(flat[-1]) if new else 0))
                sigs = np.concatenate(flat).view(np.int64) if flat else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, _DOCS), pa.array(size, pa.int64()), pa.array(node, pa.int64()),
                     pa.array(sketches, pa.binary()), pa.array(wide, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(sigs))],
                    names=names,
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(tidy(run), _SETS)


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return den * common >= num * (len(a) + len(b) - common)


def may_be_similar(na: np.ndarray, nb: np.ndarray, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """False only for pairs that cannot be similar, by their sizes and
    sketches (rows of 64-bit words)."""
    bits = np.bitwise_count(a ^ b).sum(axis=-1)
    fits = np.minimum(na, nb) * den >= np.maximum(na, nb) * num
    return fits & (bits * (den + num) <= (na + nb) * (den - num))


def sieved(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``a, b`` that may be similar. Pairs and sketches are small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u8").reshape(len(na), -1) for c in (4, 5))
                yield batch.select([0, 1]).filter(pa.array(may_be_similar(na, nb, x, y, num, den)))

    left = sketches.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = sketches.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    whole = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "na", "nb", "sa", "sb")
    return whole.mapInArrow(run, "a long, b long")


_TOGETHER = 4096  # pairs of one set that a task verifies at most


def _by_wide_sketches(pairs: DataFrame, corpus: Corpus) -> DataFrame:
    """The pairs that may be similar by their wide sketches too. They have no
    more differing bits than the sets have differing elements either."""
    num, den = corpus.num, corpus.den

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two = (batch.column(c).to_pylist() for c in (2, 3, 4))
            keep = [x is None or y is None or differing_bits(x, y) * (den + num) <= both * (den - num) for both, x, y in zip(n, one, two)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    rows = corpus.table.filter(F.col("wide").isNotNull()).join(nodes, "node", "left_semi")
    wide = rows.groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("wide").alias("wide"))
    left = wide.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("wide").alias("wa"))
    right = wide.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("wide").alias("wb"))
    whole = pairs.select("a", "b").join(left, "a", "left").join(right, "b", "left")
    return whole.select("a", "b", (F.col("na") + F.col("nb")).alias("n"), "wa", "wb").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, corpus: Corpus) -> DataFrame:
    """The pairs ``a, b`` whose sets are similar. Pairs of long sets are
    first sieved by their wide sketches. Each set goes from the task
    that makes it straight to where it is compared: once for each pair it is
    the ``b`` of, and once for every ``_TOGETHER`` pairs it is the ``a`` of."""
    pairs = staged(_by_wide_sketches(pairs, corpus), "pairs")
    parts = F.ceil(F.col("count") / _TOGETHER).cast("int")
    counts = pairs.groupBy("a").count().select("a", parts.alias("parts"))
    seconds = pairs.join(counts, "a").select(
        F.col("b").alias("node"), F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), F.lit(1).alias("kind")
    )
    firsts = counts.select(
        F.col("a").alias("node"), F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind")
    )
    wanted = staged(seconds.unionByName(firsts), "wanted")
    num, den = corpus.num, corpus.den

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, one = None, None
        for batch in batches:
            hub, part, kind, node = (batch.column(c).to_pylist() for c in range(4))
            found = []
            for i, key in enumerate(zip(hub, part)):
                if kind[i] == 0:
                    if key != now:
                        now, one = key, unpack(batch.column(4)[i].as_py())
                elif similar(one, unpack(batch.column(4)[i].as_py()), num, den):
                    found.append((hub[i], node[i]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    sets = _made_sets(corpus, wanted.select("node").distinct()).join(wanted, "node")
    near = sets.select("hub", "part", "kind", "node", "members").repartition("hub", "part").sortWithinPartitions("hub", "part", "kind")
    links = staged(near.mapInArrow(run, "a long, b long").distinct(), "links")
    drop_staged(wanted)
    drop_staged(pairs)
    return links


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of the links ``a - b`` that join two trees when the links
    are taken in order."""
    most = int(max(a.max(), b.max())) + 1
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    _, first = np.unique(lo * most + hi, return_index=True)
    root, out = list(range(most)), []
    for at in np.sort(first).tolist():
        x, y = int(a[at]), int(b[at])
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            root[x] = y
            out.append(at)
            if len(out) == most - 1:
                break
    return np.asarray(out, np.int64)


def compared(groups: DataFrame, num: int, den: int, more: int) -> DataFrame:
    """``a, b``: pairs of different components inside each group that may be
    similar: of every group those that would join its components to a forest,
    in one order for all groups, and ``more`` times as many others as it has
    members. A row of nulls says that a group has still others. ``groups``:
    ``sig, node, component, n, sketch``, with no more rows to a group than a
    task should hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[tuple[int, int]] = set()
        left_out = False
        for table in whole_groups(batches):
            sig, node, part, n = (table.column(c).to_numpy() for c in range(4))
            bits = np.frombuffer(b"".join(table.column(4).to_pylist()), "<u8").reshape(len(n), -1)
            cuts = np.append(np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])), len(sig)).tolist()
            fresh: list[tuple[int, int]] = []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                step, found = max(1, (1 << 18) // (hi - lo)), []
                for at in range(lo, hi, step):
                    end = min(hi, at + step)
                    rows, cols = slice(at, end), slice(at, hi)  # each pair once
                    pass_ = may_be_similar(n[rows, None], n[None, cols], bits[rows, None], bits[None, cols], num, den)
                    pass_ &= part[rows, None] != part[None, cols]
                    i, j = np.nonzero(pass_)
                    found.append(np.stack([at + i, at + j]))
                i, j = np.concatenate(found, axis=1)
                if not len(i):
                    continue
                x, y = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
                order = np.argsort(_mix(_mix(x.view(np.uint64)) * _U(3) + y.view(np.uint64)), kind="stable")
                _, place = np.unique(part[lo:hi], return_inverse=True)
                joining = order[_forest(place[i[order] - lo], place[j[order] - lo])]
                others = np.ones(len(i), bool)
                others[joining] = False
                others = order[others[order]]
                left_out |= len(others) > more * (hi - lo)
                for at in np.concatenate([joining, others[: more * (hi - lo)]]).tolist():
                    pair = (int(x[at]), int(y[at]))
                    if pair not in known:
                        fresh.append(pair)
                        known.add(pair)
            if len(known) > 500_000:
                known.clear()
            if fresh:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*fresh)], names=["a", "b"])
        if left_out:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64())] * 2, names=["a", "b"])

    near = groups.select("sig", "node", "component", "n", "sketch").repartition("sig").sortWithinPartitions("sig")
    return near.mapInArrow(run, "a long, b long").distinct()


_SLICE = 32_768  # bits of one aggregated slice


def _slot(column: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(1 << bits))


def bitmap(rows: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of fixed size (2 ** (bits - 3) bytes) of a column's hashed
    slots, whatever the number of rows."""
    slices = (
        rows.select(_slot(column, bits).alias("s"))
        .groupBy(F.floor(F.col("s") / _SLICE).alias("k"))
        .agg(F.bitmap_construct_agg(F.col("s") % _SLICE).alias("bits"))
        .collect()
    )
    out = np.zeros(((1 << bits) // _SLICE, _SLICE // 8), np.uint8)
    for r in slices:
        out[r["k"], : len(r["bits"])] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.reshape(-1)


def _hits(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return ((bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1).astype(bool)


def set_in(rows: DataFrame, column: str, bits: np.ndarray, size: int) -> DataFrame:
    """The rows whose slot is set in a ``bitmap`` of ``size``, found without
    leaving the JVM: the bitmap's slices are a small table of fixed size,
    broadcast whatever the number of rows."""
    words = bits.view("<i8").reshape(-1, _SLICE // 64)
    lists = pa.FixedSizeListArray.from_arrays(pa.array(words.reshape(-1)), words.shape[1]).cast(pa.list_(pa.int64()))
    slices = rows.sparkSession.createDataFrame(pa.table({"_slice": pa.array(np.arange(len(words))), "_words": lists}))
    slot = _slot(column, size)
    at = F.shiftright(slot, 6).bitwiseAND(F.lit(_SLICE // 64 - 1)).cast("int")
    found = rows.join(F.broadcast(slices), F.shiftright(slot, _SLICE.bit_length() - 1) == F.col("_slice"))
    return found.filter(F.getbit(F.get("_words", at), slot.bitwiseAND(F.lit(63)).cast("int")) == 1).drop("_slice", "_words")


def candidate_sketches(table: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, n, sketch`` of the given nodes."""
    rows = table.filter(F.col("sketch").isNotNull()).select("node", F.col("n_shingles").alias("n"), "sketch")
    return rows.join(nodes, "node", "left_semi").groupBy("node", "n").agg(F.first("sketch").alias("sketch"))


def _made_sets(corpus: Corpus, nodes: DataFrame) -> DataFrame:
    """``node, members``: sets made again from the texts, those of the given
    nodes and few others; rarely one twice. Of each node's documents the one
    with the smallest id is read; a bitmap of fixed size passes over most
    other texts."""
    held = corpus.table.filter(F.col("sketch").isNotNull()).select("node", "doc_id")
    bits = bitmap(held.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "doc_id", 23)
    words = corpus.words

    def made(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int64(), pa.binary()))]
        return pa.RecordBatch.from_arrays(columns, names=["node", "members"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            out, size = [], 0
            for i in np.flatnonzero(_hits(bits, batch.column(0).to_numpy())).tolist():
                s = shingle_set(batch.column(1)[i].as_py(), words)
                digest = set_digest(s)
                if digest is not None and digest not in seen:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(digest)
                    out.append((digest, pack(s)))
                    size += len(s)
                    if size > 500_000:  # 3 MB
                        yield made(out)
                        out, size = [], 0
            if out:
                yield made(out)

    return corpus.texts.select(_slot("doc_id", 23).alias("slot"), "text").mapInArrow(tidy(run), "node long, members binary")


def candidate_sets(corpus: Corpus, nodes: DataFrame) -> DataFrame:
    """``node, members``: the sets of the given nodes, each once."""
    made = _made_sets(corpus, nodes).join(nodes, "node", "left_semi")
    return made.groupBy("node").agg(F.first("members").alias("members"))


def shared_signatures(table: DataFrame) -> DataFrame:
    """``sig, node, hub``: the groups of two or more sets with an equal
    signature; the hub is the smallest node. Each task's rows of a signature
    become one before the shuffle; a bitmap of fixed size then keeps most
    unshared signatures out of the join that finds the members. All of it
    stays in the JVM: there are half as many rows as shingles."""
    sigs = table.filter(F.col("sigs").isNotNull()).select(F.explode("sigs").alias("sig"), "node")
    ends = sigs.groupBy("sig").agg(F.min("node").alias("hub"), F.max("node").alias("last"))
    shared = staged(ends.filter("hub <> last").select("sig", "hub"), "shared")
    near = set_in(sigs.select("sig", "node"), "sig", bitmap(shared, "sig", 25), 25)
    groups = staged(near.join(shared, "sig").distinct(), "signatures")
    drop_staged(shared)
    return groups


_COUNTERS = 1 << 20


def rare_elements(sets: DataFrame, num: int, den: int) -> DataFrame:
    """``element, node, n, at``: of each set (of size n), as many of its rarest
    elements as any similar set must meet one of, with their place from 0. The order is by a counting sketch of fixed
    size over these sets, ties by element: one order for all, so the rule
    holds whatever the sketch confuses. Elements counted once are in no other
    set and are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_COUNTERS, np.int64)
        for batch in batches:
            for cell in batch.column(1):
                np.add.at(total, (unpack(cell.as_py()) & _U(_COUNTERS - 1)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        for lo in range(0, len(at), 1 << 16):
            part = at[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["slot", "n"])

    counted = sets.select("node", "members").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    found = counted.filter("n > 1").toArrow()  # at most _COUNTERS rows
    sketch = np.ones(_COUNTERS, np.int64)
    sketch[found.column(0).to_numpy()] = found.column(1).to_numpy()

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            element, node, size, place = [], [], [], []
            for name, cell in zip(batch.column(0), batch.column(1)):
                e = unpack(cell.as_py())
                n = sketch[(e & _U(_COUNTERS - 1)).astype(np.int64)]
                first = np.lexsort((e, n))[: len(e) - -(-num * len(e) // den) + 1]
                at = np.flatnonzero(n[first] > 1)
                element.append(e[first[at]].view(np.int64))
                node.append(np.full(len(at), name.as_py(), np.int64))
                size.append(np.full(len(at), len(e), np.int64))
                place.append(at.astype(np.int64))
            if element:
                columns = [pa.array(np.concatenate(c)) for c in (element, node, size, place)]
                yield pa.RecordBatch.from_arrays(columns, names=["element", "node", "n", "at"])

    return sets.select("node", "members").mapInArrow(rare, "element long, node long, n long, at long")


def _labelled(rows: DataFrame, component: DataFrame) -> DataFrame:
    """``rows`` with the component of their ``node`` (itself if it has none)."""
    return rows.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _join_up(component: DataFrame, links: DataFrame) -> DataFrame:
    if links.isEmpty():
        return component
    known = component.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    found = connected_components(known.union(links))
    out = staged(found, "components")
    drop_staged(found)
    return out


def _link_up(component: DataFrame | None, pairs: DataFrame, corpus: Corpus) -> DataFrame:
    """The components after the similar ones of ``pairs`` (``a, b``; they may
    be similar) are linked. One pair per ``b`` is verified first; most others
    then lie inside one component and their sets need not be moved."""
    pairs = staged(pairs, "sieved")
    first = verified(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), corpus)
    component = staged(connected_components(first), "components") if component is None else _join_up(component, first)
    part = component.select("node", "component")
    rest = (
        pairs.join(part.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
        .join(part.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        .filter(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
        .select("a", "b")
    )
    out = _join_up(component, verified(rest, corpus))
    drop_staged(pairs)
    return out


def similarity_components(corpus: Corpus, groups: DataFrame, most: int = 4096) -> DataFrame:
    """``node, component`` of every set similar to some other set, from the
    ``shared_signatures``. ``most`` is the largest group that one task
    compares by itself."""
    num, den = corpus.num, corpus.den
    sketches = staged(candidate_sketches(corpus.table, groups.select("node").distinct()), "sketches")
    pairs = groups.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    component = _link_up(None, sieved(pairs, sketches, num, den), corpus)

    # groups of two are settled; of larger ones those with several components
    # are not. Variants of a text share many signatures: of the groups with
    # the same members one is enough
    members = _labelled(groups.select("sig", "node"), component)
    same = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"members_{k}") for k in (1, 2)]
    mixed = staged(
        members.groupBy("sig")
        .agg(F.count(F.lit(1)).alias("members"), F.min("component").alias("lo"), F.max("component").alias("hi"), *same)
        .filter("members > 2 and lo <> hi")
        .groupBy("members", "members_1", "members_2")
        .agg(F.min("sig").alias("sig"))
        .select("sig", "members"),
        "mixed",
    )
    small = staged(groups.select("sig", "node").join(mixed.filter(F.col("members") <= most).select("sig"), "sig"), "small")
    component = _within_groups(corpus, small, sketches, component)
    large = mixed.filter(F.col("members") > most)
    if not large.isEmpty():
        nodes = staged(groups.join(large, "sig", "left_semi").select("node").distinct(), "crowded")
        component = _by_rare_elements(corpus, nodes, sketches, component)
    for table in (small, mixed, sketches):
        drop_staged(table)
    return component


def _within_groups(corpus: Corpus, small: DataFrame, sketches: DataFrame, component: DataFrame) -> DataFrame:
    """The components after all links inside the groups ``sig, node``. The
    first round verifies a forest of each group, which mostly makes it one
    component; what is then still apart is verified by rounds of ever more
    pairs until none is left out."""
    tested, more = None, 0
    while True:
        now = _labelled(small, component).join(sketches, "node")
        found = staged(compared(now, corpus.num, corpus.den, more), "near")
        pairs = found.filter("a is not null")
        pairs = pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")
        if not pairs.isEmpty():
            component = _join_up(component, verified(pairs, corpus))
        if found.filter("a is null").isEmpty():
            return component
        tested = pairs if tested is None else staged(tested.union(pairs), "tested")
        more = max(16, 16 * more)


def _by_rare_elements(corpus: Corpus, nodes: DataFrame, sketches: DataFrame, component: DataFrame) -> DataFrame:
    """The components after all links between the given nodes are found."""
    num, den = corpus.num, corpus.den
    sets = staged(candidate_sets(corpus, nodes), "crowded-sets")
    order = Window.partitionBy("element").orderBy("node")
    rare = staged(rare_elements(sets, num, den).withColumn("place", F.row_number().over(order)), "rare")

    # hubs are the members in places up to a bound that grows fourfold, so a
    # few rounds settle any group; only groups still mixed go on
    done, upto = 0, 1
    while True:
        now = _labelled(rare, component)
        open_groups = (
            now.groupBy("element")
            .agg(F.max("place").alias("members"), F.min("component").alias("lo"), F.max("component").alias("hi"))
            .filter((F.col("members") > done + 1) & (F.col("lo") != F.col("hi")))
            .select("element")
        )
        now = staged(now.join(open_groups, "element", "left_semi"), "open")
        if now.isEmpty():
            return component
        hub = now.filter((F.col("place") > done) & (F.col("place") <= upto)).select(
            "element", F.col("node").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"),
            F.col("at").alias("pa"), F.col("place").alias("ha"),
        )
        # of the elements two similar sets share, the rarest has few of
        # either set's elements before it
        least = F.ceil((F.col("n") + F.col("na")) * num / (num + den))
        met = hub.join(now, "element").filter(
            (F.col("place") > F.col("ha"))
            & (F.col("component") != F.col("ca"))
            & (F.col("na") - F.col("pa") >= least)
            & (F.col("n") - F.col("at") >= least)
        )
        pairs = met.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
        component = _link_up(component, sieved(pairs, sketches, num, den), corpus)
        done, upto = upto, upto * 4


def jaccard_components(
    docs: DataFrame, num: int = 90, den: int = 100, words: int = 3, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``.

    Two documents are linked when ``den * |A and B| >= num * |A or B|``;
    ``component_id`` is the smallest id reachable over links, the row's own
    included. Null texts and texts without a word have no shingles and link
    with nothing, so their component is their own id. Rows with a null id take
    part but never name a component (it is null if no other id is in it).
    Repeated rows give repeated results; other columns are not read.
    """
    made = staged(document_sets(docs, Bands(num, den), words, id_col, text_col), "signed")
    groups = shared_signatures(made)
    table = staged(made.drop("sigs"), "documents-sets")
    drop_staged(made)  # the signatures are its bulk
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    component = similarity_components(Corpus(texts, table, words, num, den), groups)
    drop_staged(groups)
    keyed = _labelled(table.select("doc_id", "n_shingles", "node"), component)
    smallest = keyed.filter(F.col("node").isNotNull()).groupBy("component").agg(F.min("doc_id").alias("smallest"))
    return keyed.join(smallest, "component", "left").select(
        "doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("smallest")).alias("component_id")
    )
