"""Exact duplicates through an index of live digests.

The index is a stored table, dealt into shards by the digest's first bits. A
shard holds the digests that are live (with the row that stays and the number
of copies) and a cuckoo filter over them. A new digest asks the filter first:
a miss is new for certain and is inserted; a hit is verified against the
shard's stored digests. Digests can be deleted again, from the filter and the
store. A filter that overflows is built anew, twice as large, from the stored
digests. Every change writes a new version of the table and leaves the old.

Texts are equal when identical after every run of white space became one
space; their identity is the SHA-256 of that text. Copies are counted inside
each task before they move, so a hot text costs one row per task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from convolytics.llm.common import drop_staged, join_groups, require_columns, staged, whole_groups

_SLOTS = 4
_KICKS = 200
_SEED = 7


class Overflow(Exception):
    """The filter has no room for these keys."""


class CuckooFilter:
    """A cuckoo filter of 16-bit fingerprints, four to a bucket, for digests
    given as rows of four unsigned 64-bit words. Whole arrays of digests are
    asked, inserted and deleted at a time."""

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        if buckets & (buckets - 1):
            raise ValueError("the number of buckets must be a power of two")
        self.table = np.zeros((buckets, _SLOTS), np.uint16) if table is None else table

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        table = np.frombuffer(raw, "<u2").reshape(-1, _SLOTS).copy()
        return cls(len(table), table)

    def to_bytes(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    @classmethod
    def holding(cls, digests: np.ndarray, buckets: int = 16) -> CuckooFilter:
        """A filter with room for ``digests``: the first power of two of
        buckets, from ``buckets`` on, in which they find a place."""
        while buckets * _SLOTS * 9 < len(digests) * 10:
            buckets *= 2
        while True:
            made = cls(buckets)
            try:
                made.insert(digests)
                return made
            except Overflow:
                buckets *= 2

    def _places(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mark = (digests[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1  # zero is an empty slot
        return mark, (digests[:, 2] & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _other(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        mixed = (mark.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
        return bucket ^ (mixed & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, digests: np.ndarray) -> np.ndarray:
        """False only for digests that are not in the filter."""
        mark, one = self._places(digests)
        return (self.table[one] == mark[:, None]).any(axis=1) | (self.table[self._other(mark, one)] == mark[:, None]).any(axis=1)

    def _settle(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Puts marks in free slots of their buckets; which are left over."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        nth = np.arange(len(b)) - np.repeat(first, np.diff(np.append(first, len(b))))
        free = self.table[b] == 0
        fits = nth < free.sum(axis=1)
        slot = (free.cumsum(axis=1) > nth[:, None]).argmax(axis=1)
        self.table[b[fits], slot[fits]] = mark[order[fits]]
        left = np.ones(len(b), bool)
        left[order[fits]] = False
        return left

    def insert(self, digests: np.ndarray) -> None:
        """Adds digests (each once). Raises ``Overflow`` and leaves the filter
        as it was if they find no room."""
        mark, bucket = self._places(digests)
        before, rng = self.table.copy(), np.random.default_rng(_SEED)
        left = self._settle(mark, bucket) if len(mark) else np.zeros(0, bool)
        mark, bucket = mark[left], self._other(mark[left], bucket[left])
        for _ in range(_KICKS):
            if not len(mark):
                return
            left = self._settle(mark, bucket)
            mark, bucket = mark[left], bucket[left]
            # one mark a bucket takes the slot of another, which moves on
            _, one = np.unique(bucket, return_index=True)
            slot = rng.integers(_SLOTS, size=len(one))
            moved = self.table[bucket[one], slot].copy()
            self.table[bucket[one], slot] = mark[one]
            mark[one] = moved
            bucket[one] = self._other(moved, bucket[one])
        if len(mark):
            self.table = before
            raise Overflow

    def delete(self, digests: np.ndarray) -> None:
        """Removes digests that are in the filter, one entry for each."""
        mark, one = self._places(digests)
        for m, b, c in zip(mark, one, self._other(mark, one)):
            for bucket in (b, c):
                at = np.flatnonzero(self.table[bucket] == m)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break
            else:
                raise KeyError("not in the filter")


def _words(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, 4)


_FILTER, _LIVE, _INSERT, _DELETE, _LOOKUP = range(5)
_NO_ID = 1  # sorts rows without an id last


def _first(a: tuple, b: tuple) -> tuple:
    return a if a <= b else b


class _Shard:
    """One shard in a task: the live digests and their filter."""

    def __init__(self):
        self.filter, self.live, self.resized = CuckooFilter(16), {}, 0

    def load(self, raw: bytes | None, digests: list[bytes], values: list[tuple]) -> None:
        self.live = dict(zip(digests, values))
        if raw is not None:
            self.filter = CuckooFilter.from_bytes(raw)

    def _add(self, digests: np.ndarray) -> None:
        try:
            self.filter.insert(digests)
        except Overflow:
            self.resized += 1
            keys = np.frombuffer(b"".join(self.live), "<u8").reshape(-1, 4)
            self.filter = CuckooFilter.holding(keys, 2 * len(self.filter.table))

    def insert(self, digests: list[bytes], values: list[tuple], block: int = 4096) -> None:
        """``values``: ``(no id, id, row, copies)`` of the rows to add."""
        for lo in range(0, len(digests), block):
            fresh: dict[bytes, tuple] = {}
            for d, v in zip(digests[lo : lo + block], values[lo : lo + block]):
                old = fresh.get(d)
                fresh[d] = v if old is None else (*_first(old[:3], v[:3]), old[3] + v[3])
            words = np.frombuffer(b"".join(fresh), "<u8").reshape(-1, 4)
            new = []
            for k, (d, v, hit) in enumerate(zip(fresh, fresh.values(), self.filter.contains(words).tolist())):
                old = self.live.get(d) if hit else None  # a hit is verified, a miss needs no look
                if old is None:
                    new.append(k)
                    self.live[d] = v
                else:
                    self.live[d] = (*_first(old[:3], v[:3]), old[3] + v[3])
            self._add(words[new])

    def found(self, digests: list[bytes]) -> list[bool]:
        hits = self.filter.contains(np.frombuffer(b"".join(digests), "<u8").reshape(-1, 4)) if digests else []
        return [bool(hit) and d in self.live for d, hit in zip(digests, hits)]

    def delete(self, digests: list[bytes]) -> None:
        gone = [d for d, there in zip(digests, self.found(digests)) if there]
        gone = list(dict.fromkeys(gone))
        for d in gone:
            del self.live[d]
        if gone:
            self.filter.delete(np.frombuffer(b"".join(gone), "<u8").reshape(-1, 4))


_ROW = "shard int, kind int, digest binary, no_id int, id long, row long, copies long"
_NAMES = [c.split()[0] for c in _ROW.split(", ")]


def _update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The new version of every shard, from its old rows and the changes."""
    for table in whole_groups(batches):
        shards = table.column(0).to_numpy()
        for s in np.unique(shards).tolist():
            yield _shard_rows(s, table.slice(int(np.searchsorted(shards, s)), int((shards == s).sum())))


def _read_shard(table: pa.Table) -> tuple[_Shard, dict[int, tuple[list, list]]]:
    kind = table.column(1).to_numpy()
    by = {}
    for k in range(5):
        part = table.filter(pa.array(kind == k))
        by[k] = (part.column(2).to_pylist(), list(zip(*(part.column(c).to_pylist() for c in range(3, 7)))))
    shard = _Shard()
    shard.load(by[_FILTER][0][0] if by[_FILTER][0] else None, *by[_LIVE])
    return shard, by


def _shard_rows(s: int, table: pa.Table) -> pa.RecordBatch:
    shard, by = _read_shard(table)
    shard.insert(*by[_INSERT])
    shard.delete(by[_DELETE][0])
    blob = shard.filter.to_bytes()
    rows = [(s, _FILTER, blob, 0, None, None, len(shard.live))] + [(s, _LIVE, d, *v) for d, v in shard.live.items()]
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=_NAMES)


def _lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_groups(batches):
        shards = table.column(0).to_numpy()
        for s in np.unique(shards).tolist():
            shard, by = _read_shard(table.slice(int(np.searchsorted(shards, s)), int((shards == s).sum())))
            asked = by[_LOOKUP][0]
            there = [d for d, found in zip(asked, shard.found(asked)) if found]
            if there:
                yield pa.RecordBatch.from_arrays([pa.array(there, pa.binary())], names=["digest"])


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies inside a task become one row each; at most a million digests
    are held, then handed on."""

    def flush(held: dict[bytes, tuple]) -> pa.RecordBatch:
        kinds = (pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        rows = [(d, *v) for d, v in held.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=_NAMES[2:])

    held: dict[bytes, tuple] = {}
    for batch in batches:
        for d, i, row in zip(*(batch.column(c).to_pylist() for c in range(3))):
            v = (_NO_ID if i is None else 0, 0 if i is None else i, row)
            old = held.get(d)
            held[d] = (*v, 1) if old is None else (*_first(old[:3], v), old[3] + 1)
        if len(held) > 1_000_000:
            yield flush(held)
            held = {}
    if held:
        yield flush(held)


@dataclass
class DigestIndex:
    """The live digests in ``shards`` shards (a power of two); ``table`` is
    None while it is empty. Methods that change it return the new version."""

    shards: int
    table: DataFrame | None = None

    def _shard(self) -> Column:
        # the digest's first 24 bits
        first = F.conv(F.hex(F.substring("digest", 1, 3)), 16, 10).cast("int")
        return (first % F.lit(self.shards)).alias("shard")

    def _changes(self, rows: DataFrame, kind: int) -> DataFrame:
        empty = {"no_id": "int", "id": "long", "row": "long", "copies": "long"}
        filled = [F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in empty.items()]
        return rows.select(self._shard(), F.lit(kind).alias("kind"), "digest", *filled)

    def _with(self, changes: DataFrame) -> DataFrame:
        rows = changes if self.table is None else self.table.unionByName(changes)
        return rows.repartition(self.shards, "shard").sortWithinPartitions("shard", "kind")

    def _changed(self, changes: DataFrame) -> DigestIndex:
        return DigestIndex(self.shards, staged(self._with(changes).mapInArrow(_update, _ROW), "digests"))

    def insert(self, rows: DataFrame) -> DigestIndex:
        """Adds ``digest`` (32 bytes), ``id`` and ``row`` (a number no other
        row has): copies are counted, and of each digest the row with the
        smallest id (null last), then the smallest number, stays."""
        partial = rows.select("digest", F.col("id").cast("long"), F.col("row").cast("long"))
        schema = "digest binary, no_id int, id long, row long, copies long"
        return self._changed(self._changes(partial.mapInArrow(_combined, schema), _INSERT))

    def delete(self, digests: DataFrame) -> DigestIndex:
        """Removes the digests in ``digest``; those that are not live are passed over."""
        return self._changed(self._changes(digests.select("digest").distinct(), _DELETE))

    def lookup(self, digests: DataFrame) -> DataFrame:
        """The distinct ones of ``digest`` that are live."""
        asked = self._changes(digests.select("digest").distinct(), _LOOKUP)
        return self._with(asked).mapInArrow(_lookup, "digest binary")

    def live(self) -> DataFrame:
        """``digest, keep_row, keep_id, copies`` of every live digest."""
        return self.table.filter(F.col("kind") == _LIVE).select(
            "digest", F.col("row").alias("keep_row"), F.when(F.col("no_id") == 0, F.col("id")).alias("keep_id"), "copies"
        )

    def drop(self) -> None:
        """Deletes this version's table."""
        if self.table is not None:
            drop_staged(self.table)


def text_digest(text: Column) -> Column:
    """SHA-256 of the text with every run of white space as one space."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return F.unhex(F.sha2(F.encode(spaced, "utf-8"), 256))


def shards_for(rows: int, per_shard: int = 100_000) -> int:
    """A power of two of shards, with about ``per_shard`` digests at most in
    each; 16 at least."""
    return max(16, 1 << max(0, -(-rows // per_shard) - 1).bit_length())


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_shard: int = 100_000) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row.

    Rows with equal texts are a group, in which the row with the smallest id
    stays; ``keep_id`` is its id. A null text counts as empty. Among rows with
    an equal text and an equal id exactly one stays; a row without an id stays
    only if no row of its group has one, and ``keep_id`` is null then. Texts of
    any length are hashed whole. An empty table gives no rows; other columns
    are not read.
    """
    require_columns(docs, [id_col, text_col])
    rows = staged(
        docs.select(
            F.col(f"`{id_col}`").cast("long").alias("id"), text_digest(F.col(f"`{text_col}`")).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "text-digests",
    )
    index = DigestIndex(shards_for(rows.count(), per_shard)).insert(rows)
    found = join_groups(rows, index.live(), "digest", "copies")
    return found.select(
        F.col("id").alias(id_col), "keep_id", F.col("copies").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
