"""Benchmark passages in documents, found by edit distance.

The CGK random walk maps a string to a longer one so that a few edits become a
few differing places: at every step it writes the current character and, by a
random bit for that step and character, moves on or stays; after an edit two
walks soon fall into step again. Windows as long as an item are embedded in
the document and in the item; a window is a candidate if the walks agree on
all the sampled places of one key (bit sampling). Keys and walks are added
until copies of the items with ``edit_share`` of edits are found as often as
``target_recall`` asks. Every candidate is verified by the exact edit distance
between the item and the best substring around it.

Windows are laid around anchors: byte n-grams of an item, at whatever byte of
a document they occur, so scripts without spaces are served like others. An
n-gram is as long as lets one survive the edits often enough in an item of its
length. Both walks run from the anchor outward, to both ends of the item. One
pass over the documents, many texts at a time, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from convolytics.llm.common import in_parts, require_columns, text_source, tidy

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


@dataclass(frozen=True)
class Settings:
    """An item that is altered by the share ``edit_share`` of its length or
    less counts as present; ``target_recall`` is the share of copies altered
    that much that become candidates."""

    edit_share: float = 0.2
    target_recall: float = 0.97
    least_bytes: int = 24  # shorter items are looked up exactly
    seed: int = 23
    max_item_bytes: int = 64 << 20  # of all items together


_PLACES = 6  # sampled places per key
_MOST_KEYS = 1024  # of one walk; then another is added
_MOST_WALKS = 4  # then every window at an anchor is a candidate
_LONGEST = 12  # bytes of an anchor
_COPIES = 256  # altered copies that recall is measured on


@dataclass
class Texts:
    """Texts end to end, each with a gap of zeros behind it: bytes with ASCII
    capitals lowered and runs of white space made one space."""

    raw: bytes
    begin: list[int]  # of each text in ``raw``; last, the end
    folded: np.ndarray
    place: np.ndarray  # of each folded byte in ``raw``
    first: np.ndarray  # of each text in ``folded``; last, the end


def fold(texts: list[bytes], gap: int) -> Texts:
    hole = b"\0" * gap
    raw = b"".join(x + hole for x in texts)
    begin = np.cumsum([0, *(len(x) + gap for x in texts)])
    b = np.frombuffer(raw, np.uint8)
    low = _FOLD[b]
    space = low == 32
    keep = np.ones(len(b), bool)
    keep[1:] = ~(space[1:] & (space[:-1] | (b[:-1] == 0)))
    if len(b) and space[0]:
        keep[0] = False
    place = np.flatnonzero(keep)
    return Texts(raw, begin.tolist(), low[place], place, np.searchsorted(place, begin))


def eights(folded: np.ndarray) -> np.ndarray:
    """The eight bytes at every place that is followed by seven more, as one
    number."""
    out = np.empty(max(0, len(folded) - 7), np.uint64)
    for k in range(min(8, len(out))):
        n = (len(out) - k + 7) // 8
        out[k::8] = folded[k : k + 8 * n].view("<u8")
    return out


def grams(eight: np.ndarray, size: int, at: np.ndarray | None = None) -> np.ndarray:
    """A hash of the ``size`` bytes (at most 16) at each place of ``at``, or at
    every place."""
    h = eight if at is None else eight.take(at)
    if size < 8:
        h = h << np.uint64(8 * (8 - size))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    if size > 8:
        h = (h ^ (h >> np.uint64(31)) ^ eight.take(at + (size - 8))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h


def anchor_bytes(length: int, s: Settings) -> int:
    """The longest n-gram that ``edit_share`` of edits leaves somewhere in an
    item of this length in all but half of the misses allowed."""
    length = min(length, 4096)
    kept = 1 - s.edit_share
    for size in range(_LONGEST, 3, -1):
        none = [1.0] * size + [1 - kept**size]  # no whole n-gram in so many bytes
        for n in range(size + 1, length + 1):
            none.append(none[-1] - s.edit_share * kept**size * none[n - size - 1])
        if length >= size and none[length] <= (1 - s.target_recall) / 2:
            return size
    return 3


class Anchors:
    """Where n-grams of the items occur. ``sizes`` has the n-gram's length of
    each item; of an item under ``least_bytes`` only the first is taken."""

    def __init__(self, items: list[bytes], sizes: list[int], s: Settings):
        self.text = np.frombuffer(b"".join(x + b"\0" * 16 for x in items), np.uint8)
        self.first = np.cumsum([0, *(len(x) + 16 for x in items)])
        eight = eights(self.text)
        self.tables = []
        self.least = min(8, *sizes)
        at_all = []
        for size in sorted(set(sizes)):
            group = [i for i, g in enumerate(sizes) if g == size]
            n = [len(items[i]) - size + 1 if len(items[i]) >= s.least_bytes else 1 for i in group]
            item = np.repeat(np.asarray(group, np.int32), n)
            offset = np.arange(len(item)) - np.repeat(np.cumsum([0, *n[:-1]]), n)
            at = self.first[item] + offset
            at_all.append(at)
            h = grams(eight, size, at)
            # what repeats closer together than the edits that verifying allows counts once
            near = np.maximum(1, s.edit_share * np.asarray([len(items[i]) for i in group]) // 2).astype(np.int64)
            bucket = offset // np.repeat(near, n)
            order = np.lexsort((offset, bucket, item, h))
            new = np.ones(len(order), bool)
            new[1:] = np.diff(h[order]).astype(bool) | np.diff(item[order]).astype(bool) | np.diff(bucket[order]).astype(bool)
            order = order[new]
            self.tables.append((size, h[order], item[order], offset[order].astype(np.int32), *self._known(h)))
        self.gate, self.shift = self._known(grams(eight, self.least, np.concatenate(at_all)))

    @staticmethod
    def _known(h: np.ndarray) -> tuple[np.ndarray, np.uint64]:
        bits = max(16, int(32 * max(1, len(h))).bit_length())
        known = np.zeros(1 << bits, bool)
        known[(h >> np.uint64(64 - bits)).astype(np.int64)] = True
        return known, np.uint64(64 - bits)

    def pairs(self, folded: np.ndarray, block: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``item, offset, place`` of n-grams in ``folded`` (which ends in a
        gap of 16 bytes or more); of those that follow each other on one
        diagonal the first, in blocks."""
        for lo in range(0, len(folded), block):
            eight = eights(folded[lo : lo + block + 15])
            h = grams(eight[:block], self.least)
            here = np.flatnonzero(self.gate.take((h >> self.shift).view(np.int64)))
            here = here[here + 8 < len(eight)]  # the rest is the gap
            for size, keys, item, offset, known, shift in self.tables:
                mine = grams(eight, size, here)
                near = np.flatnonzero(known.take((mine >> shift).view(np.int64)))
                mine, at = mine[near], lo + here[near]
                a, b = np.searchsorted(keys, mine, side="left"), np.searchsorted(keys, mine, side="right")
                n = b - a
                row = np.repeat(np.arange(len(at)), n)
                which = np.repeat(a, n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                i, o, p = item[which].astype(np.int64), offset[which].astype(np.int64), at[row]
                order = np.lexsort((p, p - o, i))
                i, o, p = i[order], o[order], p[order]
                new = np.ones(len(i), bool)
                new[1:] = (i[1:] != i[:-1]) | (p[1:] - p[:-1] != 1) | (o[1:] - o[:-1] != 1)
                if new.any():
                    yield i[new], o[new], p[new]


class Walk:
    """The random bits of one walk of ``steps`` steps."""

    def __init__(self, steps: int, seed: list[int]):
        self.steps = steps
        self.moves = np.random.default_rng(seed).integers(0, 2, (steps, 256), dtype=np.int64)

    def agree(self, items: np.ndarray, a: np.ndarray, back: np.ndarray, folded: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A row per step, a column per window: do the walks of the item from
        ``a`` and of the document from ``b`` write the same? The last ``back``
        steps of a window run backward from before the anchor."""
        steps, n = self.steps, len(a)
        order = np.argsort(back, kind="stable")
        a, b, back = a[order], b[order], back[order]
        out = np.empty((steps, n), bool)
        # forward windows still walking come first, backward ones last
        ahead, behind = np.searchsorted(back, steps - np.arange(steps)).tolist(), np.searchsorted(back, np.arange(steps), side="right").tolist()
        for way in (1, -1):
            p, q = (a.copy(), b.copy()) if way > 0 else (a - 1, b - 1)
            for j in range(steps):
                w = slice(0, ahead[j]) if way > 0 else slice(behind[j], n)
                if w.start == w.stop:
                    break
                r = j if way > 0 else steps - 1 - j
                x, y = items.take(p[w], mode="clip"), folded.take(q[w], mode="clip")
                np.equal(x, y, out=out[r, w])
                moves = self.moves[r] if way > 0 else -self.moves[r]
                p[w] += moves.take(x)
                q[w] += moves.take(y)
        whole = np.empty_like(out)
        whole[:, order] = out
        return whole


def altered(item: bytes, share: float, rng: np.random.Generator, ways: int) -> bytes:
    """A copy with ``share`` of its bytes replaced (if ``ways`` is 1) or, by
    chance, replaced, left out or preceded by another byte of it (if 3)."""
    out = [bytes([c]) for c in item]
    for p in rng.choice(len(item), int(share * len(item)), replace=False).tolist():
        other = item[int(rng.integers(len(item)))]
        out[p] = (bytes([other]), b"", bytes([other]) + out[p])[int(rng.integers(ways))]
    return b"".join(out)


class Band:
    """Items of about one length: walks as long as the shortest, and as many
    keys as the target recall needs."""

    def __init__(self, items: list[bytes], group: list[int], anchors: Anchors, s: Settings):
        rng = np.random.default_rng([s.seed, len(items[group[0]])])
        self.steps = 2 * min(len(items[i]) for i in group)
        self.walks: list[tuple[Walk, np.ndarray]] = []
        owner = np.asarray([group[c % len(group)] for c in rng.permutation(max(_COPIES, len(group)))[:_COPIES]])
        t = fold([altered(items[i], s.edit_share, rng, 1 + c % 2 * 2) for c, i in enumerate(owner.tolist())], 64)
        item, offset, place = (np.concatenate(c) for c in zip(*anchors.pairs(t.folded), [np.zeros(0, np.int64)] * 3))
        copy = np.searchsorted(t.first, place, side="right") - 1
        own = item == owner[copy]
        item, offset, place, copy = item[own], offset[own], place[own], copy[own]
        found = np.zeros(len(owner), bool)

        def recall() -> float:
            return min(found[::2].mean(), found[1::2].mean())

        for w in range(_MOST_WALKS):
            walk = Walk(self.steps, [s.seed, self.steps, w])
            agree = self._agree(walk, anchors, items, item, offset, t.folded, place)
            keys = []
            while recall() < s.target_recall and len(keys) < _MOST_KEYS:
                keys.append(rng.choice(self.steps, _PLACES, replace=False))
                found[copy[agree[keys[-1]].all(axis=0)]] = True
            self.walks.append((walk, np.asarray(keys)))
            if recall() >= s.target_recall:
                break
        else:
            self.walks = []  # every window at an anchor is verified

    def _agree(self, walk: Walk, anchors: Anchors, items: list[bytes], item, offset, folded: np.ndarray, place) -> np.ndarray:
        length = (anchors.first[item + 1] - anchors.first[item] - 16) if len(item) else item
        back = offset * self.steps // np.maximum(1, length)
        return walk.agree(anchors.text, anchors.first[item] + offset, back, folded, place)

    def near(self, anchors: Anchors, items: list[bytes], item: np.ndarray, offset: np.ndarray, folded: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Which windows share a key with their item."""
        passed = np.full(len(item), not self.walks)
        block = max(64, (8 << 20) // self.steps)
        for walk, keys in self.walks:
            left = np.flatnonzero(~passed)
            for lo in range(0, len(left), block):
                w = left[lo : lo + block]
                agree = self._agree(walk, anchors, items, item[w], offset[w], folded, place[w])
                any_key = np.zeros(len(w), bool)
                for places in keys:
                    both = agree[places[0]]
                    for r in places[1:]:
                        both = both & agree[r]
                    any_key |= both
                passed[w] = any_key
        return passed


def edit_search(item: bytes, text: bytes, most: int | None = None) -> tuple[int, int]:
    """The least edit distance between ``item`` and any substring of
    ``text``, and where the first such substring ends (bit-parallel columns
    of the dynamic programme). With ``most``, a result above it is only a bound:
    the search ends when no more than that many edits can be reached."""
    m = len(item)
    if not m:
        return 0, 0
    mask, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[int, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | (1 << i)
    pv, mv, score = mask, 0, m
    best, end = m, 0
    spare = len(text) + (m if most is None else most)  # the score falls by one a byte at most
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        score += 1 if ph & top else -1 if mh & top else 0
        ph, mh = (ph << 1) & mask, (mh << 1) & mask  # a match may begin anywhere
        pv = mh | (~(xv | ph) & mask)
        mv = ph & xv
        if score < best:
            best, end = score, j
            if not best:
                break
        if score + j > spare:
            break
    return best, end


class ItemIndex:
    """The items, their anchors and the bands of their lengths."""

    def __init__(self, items: list[tuple[int, str]], s: Settings, bands: list[Band] | None = None):
        self.s = s
        self.ids: list[int] = []
        self.items: list[bytes] = []
        for item_id, text in items:
            t = fold([text.encode("utf-8", "surrogatepass")], 0)
            body = t.folded.tobytes().rstrip(b" ")
            if body:
                self.ids.append(item_id)
                self.items.append(body)
        self.gap = 64
        self.bands: list[Band] = []
        if not self.items:
            return
        size = {n: min(n, 8) if n < s.least_bytes else anchor_bytes(n, s) for n in {len(x) for x in self.items}}
        self.anchors = Anchors(self.items, [size[len(x)] for x in self.items], s)
        groups: dict[tuple[int, int], list[int]] = {}
        for i, x in enumerate(self.items):
            if len(x) >= s.least_bytes:
                groups.setdefault((size[len(x)], int(np.log(len(x)) / np.log(1.25))), []).append(i)
        self.band = np.full(len(self.items), -1)
        for k, group in enumerate(groups.values()):
            self.band[group] = k
        self.bands = bands if bands is not None else [Band(self.items, g, self.anchors, s) for g in groups.values()]

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """For every text, ``item id, edits, start, end`` (characters of the
        text) of each item in it, at the item's best place."""
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        if not self.items:
            return out
        group: list[int] = []
        held = 0
        for i, text in enumerate(texts):
            if text:
                group.append(i)
                held += len(text)
            if group and (held > 4 << 20 or i == len(texts) - 1):
                for k, hits in self._find([texts[g].encode("utf-8", "surrogatepass") for g in group]):
                    out[group[k]] = hits
                group, held = [], 0
        return out

    def _find(self, raws: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int, int, int]]]]:
        t = fold(raws, self.gap)
        found: set[tuple[int, int, int]] = set()
        pairs = list(self.anchors.pairs(t.folded))
        if pairs:
            item, offset, place = (np.concatenate(c) for c in zip(*pairs))
            text = np.searchsorted(t.first, place, side="right") - 1
            band = self.band[item]
            for k in np.unique(band).tolist():
                w = np.flatnonzero(band == k)
                if k >= 0:
                    w = w[self.bands[k].near(self.anchors, self.items, item[w], offset[w], t.folded, place[w])]
                found.update(zip(text[w].tolist(), item[w].tolist(), (place[w] - offset[w]).tolist()))
        by_text: dict[int, list[tuple[int, int]]] = {}
        for text, item, begin in sorted(found):
            by_text.setdefault(text, []).append((item, begin))
        for text, near in by_text.items():
            hits = self._verify(t, text, near)
            if hits:
                yield text, hits

    def _verify(self, t: Texts, text: int, near: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
        first, stop = int(t.first[text]), int(t.first[text + 1]) - self.gap
        best: dict[int, tuple[int, int, int]] = {}
        tried: dict[int, list[int]] = {}
        for i, begin in near:
            item = self.items[i]
            most = int(self.s.edit_share * len(item)) if len(item) >= self.s.least_bytes else 0
            if i in best and not best[i][0]:
                continue
            if any(abs(begin - b) <= most // 2 for b in tried.get(i, ())):
                continue  # the same place by another window
            tried.setdefault(i, []).append(begin)
            reach = most + most // 2 + 1  # edits before the anchor, and the places skipped above
            lo = max(first, begin - reach)
            part = t.folded[lo : max(lo, min(stop, begin + len(item) + reach))].tobytes()
            exact = part.find(item)
            edits, end = (0, exact + len(item)) if exact >= 0 else edit_search(item, part, most)
            if edits <= most and (i not in best or edits < best[i][0]):
                _, length = edit_search(item[::-1], part[:end][::-1])
                best[i] = (edits, lo + end - length, lo + end)
        out = []
        for i, (edits, a, b) in sorted(best.items()):
            begin = t.begin[text]
            ahead = t.raw[begin : int(t.place[a])].decode("utf-8", "replace")
            inside = t.raw[int(t.place[a]) : int(t.place[b - 1]) + 1].decode("utf-8", "replace")
            out.append((self.ids[i], edits, len(ahead), len(ahead) + len(inside)))
        return out


HITS = ArrayType(
    StructType([StructField("item_id", LongType()), StructField("edits", IntegerType()), StructField("start", LongType()), StructField("end", LongType())])
)


def collect_items(benchmark: DataFrame, s: Settings, id_col: str = "item_id", text_col: str = "text") -> list[tuple[int, str]]:
    """The benchmark's items, checked to be at most ``max_item_bytes`` before
    they are gathered. Null ids or texts take no part; of a repeated id with
    several texts, each counts."""
    require_columns(benchmark, [id_col, text_col])
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).dropna().distinct()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > s.max_item_bytes:
        raise ValueError(f"the benchmark holds {size} bytes, more than max_item_bytes={s.max_item_bytes}")
    return sorted((r["id"], r["text"]) for r in rows.collect())


def scan(
    docs: DataFrame, benchmark: DataFrame, keep: list[str], settings: Settings | None = None, text_col: str = "text",
) -> DataFrame:
    """The columns ``keep`` and ``hits`` of every row: ``item_id, edits,
    start, end`` (characters of the whole text) of each item that occurs in it
    with at most ``edit_share`` of its length in edits, letter case and white
    space aside. Null and empty texts have no hits, nor has any text if the
    benchmark is empty; items under ``least_bytes`` bytes are found only where
    they occur without edits. Repeated rows each get theirs."""
    require_columns(docs, [*keep, text_col])
    s = settings or Settings()
    items = collect_items(benchmark, s)
    bands = ItemIndex(items, s).bands  # keys and walks are chosen once
    source, texts_of = text_source(docs, keep, text_col)
    schema = StructType(source.schema.fields[: len(keep)]).add("hits", HITS)
    arrow = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(items, s, bands)
        for batch in batches:
            found = index.find(texts_of(batch).to_pylist())
            hits = [[dict(zip(("item_id", "edits", "start", "end"), h)) for h in hs] for hs in found]
            yield from in_parts(pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(hits, arrow)], names=schema.names))

    return source.mapInArrow(tidy(run), schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, settings: Settings | None = None, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, item_id, edits, start, end``: one row per document and item
    found in it."""
    found = scan(docs, benchmark, [id_col], settings)
    return found.select(F.col(id_col).alias("doc_id"), F.inline("hits"))
