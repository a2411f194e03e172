"""Best-fit packing of documents into fixed-length token sequences.

Each document is encoded and ended by an end token; only documents longer
than a sequence are cut. The pieces are then packed by bounded-space online
best fit: a fixed number of open bins is held in a bitset keyed by free
space, a piece goes to the open bin with the least free space that holds it,
and when a new bin would exceed the number, the fullest open bin closes first.

Scale: encoding is one map over the documents. What is packed is one row of a
few numbers per piece; blocks of ``block_rows`` pieces, dealt by a hash of a
stored row number, are packed independently, each with ``open_bins`` bins, and
a block is fed longest piece first. A block leaves at most a few bins partly
filled, so blocks cost next to nothing against one global packing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from convolytics.llm.common import require_columns, staged, tidy
from convolytics.llm.tokens import WordCachedEncoder

ID_BYTES = 4


def encode_pieces(
    docs: DataFrame, tokenizer: str, max_len: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``row_id`` (unique per input row and piece),
    ``doc_id``, ``piece`` from 0, ``start``, ``length``, ``ids_crc32``, and
    the ids themselves as little-endian bytes (``ids``) if ``with_ids``.

    A null text counts as empty: its only piece is the end token. A null id
    stays null; repeated rows each give their own pieces. Other columns are
    not read.
    """
    require_columns(docs, [id_col, text_col])
    schema = "row_id long, doc_id long, piece int, start long, length long, ids_crc32 long"
    fields = [("row_id", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
              ("length", pa.int64()), ("ids_crc32", pa.int64())]
    if with_ids:
        schema += ", ids binary"
        fields.append(("ids", pa.binary()))
    arrow = pa.schema(fields)
    tail = end_id.to_bytes(ID_BYTES, "little")
    step = max_len * ID_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = WordCachedEncoder(tokenizer)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            texts = (x.as_py() or "" for x in batch.column(1))
            rows: list[tuple] = []
            size = 0
            for doc, raw in zip(ids_of, enc.encode(texts, tail)):
                for piece, at in enumerate(range(0, len(raw), step)):
                    part = raw[at : at + step]
                    item = (row, doc, piece, at // ID_BYTES, len(part) // ID_BYTES, zlib.crc32(part))
                    rows.append((*item, part) if with_ids else item)
                    size += len(part) if with_ids else 0
                    row += 1
                if size > 32 << 20:  # very long texts: many small batches
                    yield _batch(rows, arrow)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, arrow)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(tidy(run), schema)


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)


class OpenBins:
    """Best fit over a bounded set of open bins. Bit ``f`` of ``free`` is set
    while some open bin has exactly ``f`` free places."""

    def __init__(self, capacity: int, limit: int):
        self.capacity = capacity
        self.limit = limit
        self.free = 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = 0
        self.made = 0

    def _take(self, space: int) -> int:
        bins = self.by_free[space]
        chosen = bins.pop()
        if not bins:
            self.free &= ~(1 << space)
        self.open -= 1
        return chosen

    def place(self, length: int) -> tuple[int, int]:
        """The bin of a piece and the piece's offset in it."""
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            chosen = self._take(space)
        else:
            if self.open >= self.limit:  # the fullest closes first
                self._take((self.free & -self.free).bit_length() - 1)
            space, chosen = self.capacity, self.made
            self.made += 1
        rest = space - length
        if rest:
            self.by_free[rest].append(chosen)
            self.free |= 1 << rest
            self.open += 1
        return chosen, self.capacity - space


def best_fit(
    pieces: DataFrame, capacity: int = 4096, open_bins: int = 16_384, block_rows: int = 32_768, row_id: str = "row_id",
) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to ``pieces`` (columns ``row_id``
    and ``length``; others are kept). Lengths must be 1 to ``capacity``.

    ``pieces`` must be stored or deterministic: its rows are counted first.
    An empty table gives an empty result; pieces of equal length are placed
    in the order of their row number.
    """
    require_columns(pieces, [row_id, "length"])
    blocks = max(1, -(-pieces.count() // block_rows))

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", row_id], ascending=[False, True], kind="stable")
        bins = OpenBins(capacity, open_bins)
        placed = [bins.place(n) for n in rows["length"].tolist()]
        base = int(key[0]) << 32
        return rows.drop(columns="_block").assign(
            sequence_id=[base + b for b, _ in placed], offset=[o for _, o in placed]
        )

    from pyspark.sql.types import LongType, StructType

    out = StructType(list(pieces.schema.fields)).add("sequence_id", LongType()).add("offset", LongType())
    dealt = pieces.withColumn("_block", F.pmod(F.xxhash64(F.col(row_id)), F.lit(blocks)))
    return dealt.groupBy("_block").applyInPandas(pack, out)


def pack_documents(docs: DataFrame, tokenizer: str, max_len: int = 4096, end_id: int = 1, **packing) -> DataFrame:
    """Encodes and packs documents: ``doc_id, piece, start, length,
    ids_crc32, sequence_id, offset``. The pieces (numbers only) are stored
    once in the shared folder."""
    pieces = staged(encode_pieces(docs, tokenizer, max_len, end_id), "pieces")
    return best_fit(pieces, max_len, **packing).drop("row_id")


def materialise_sequences(docs: DataFrame, tokenizer: str, max_len: int = 4096, end_id: int = 1, **packing) -> DataFrame:
    """The packed sequences themselves: ``sequence_id``, ``length`` and
    ``ids`` (little-endian bytes, pieces by offset). A sequence gathers at
    most ``max_len`` ids."""
    pieces = staged(encode_pieces(docs, tokenizer, max_len, end_id, with_ids=True), "pieces-ids")
    placed = best_fit(pieces.drop("ids"), max_len, **packing).select("row_id", "sequence_id", "offset")
    whole = placed.join(pieces.select("row_id", "length", "ids"), "row_id")
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return whole.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))
