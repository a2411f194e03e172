"""Uniform sharding by a random communication matrix.

How many rows of each input part go to each output block is drawn first, from
the multivariate hypergeometric law that a uniformly random permutation of
all rows induces. Then each part permutes its rows and deals them out by its
row of the matrix, the blocks are exchanged, and each block is permuted
again. Shard sizes are exact: the law is ``rows``, counts at most one apart.

Every part draws its own row of the matrix: a binary tree over the parts,
whose nodes split the counts of their rows with a generator seeded by the node,
is walked from the root to the part. What the tasks share is one integer per
part, the running row count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from convolytics.llm.common import staged

# numpy's "marginals" method takes totals under this bound
_MAX_ROWS = 900_000_000


def block_sizes(rows: int, shards: int, block_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shard, first slot and size of every block. Shards differ by at most
    one row; a shard is cut into equal blocks of at most ``block_rows``."""
    shard_of, first, size = [], [], []
    for s in range(shards):
        n = rows // shards + (s < rows % shards)
        blocks = max(1, -(-n // block_rows))
        at = 0
        for b in range(blocks):
            k = n // blocks + (b < n % blocks)
            shard_of.append(s)
            first.append(at)
            size.append(k)
            at += k
    return np.asarray(shard_of), np.asarray(first), np.asarray(size)


def matrix_row(part: int, upto: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """The row of ``part``: how many of its rows go to each block. ``upto``
    holds the rows before each part and, last, all rows."""
    lo, hi, left = 0, len(upto) - 1, sizes.astype(np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        first = draw(rng, left, int(upto[mid] - upto[lo]))
        if part < mid:
            hi, left = mid, first
        else:
            lo, left = mid, left - first
    return left


def draw(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """A multivariate hypergeometric draw of ``n`` out of ``counts``, colour
    by colour; a total beyond numpy's bound is halved by colours first, by an
    exact draw for either half."""
    total = int(counts.sum())
    if total < _MAX_ROWS:
        return rng.multivariate_hypergeometric(counts, n, method="marginals")
    if len(counts) == 1:
        return np.asarray([n])
    half = len(counts) // 2
    a = int(counts[:half].sum())
    k = _large_hypergeometric(rng, a, total - a, n)
    return np.concatenate([draw(rng, counts[:half], k), draw(rng, counts[half:], n - k)])


def _large_hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric draw at any count, by rejection: if every row is taken
    with the same chance, the number of good rows among those taken follows
    this law given that ``n`` are taken in all. So both binomial counts are
    drawn until they add up to ``n``; one pair in about 2.5 standard deviations
    of their sum does."""
    total = good + bad
    if n in (0, total) or good == 0 or bad == 0:
        return good if n == total else min(n, good)
    share = n / total
    tries = int(min(1 << 20, 16 + 4 * (total * share * (1 - share)) ** 0.5))
    while True:
        taken = rng.binomial(good, share, tries)
        fits = np.flatnonzero(taken + rng.binomial(bad, share, tries) == n)
        if len(fits):
            return int(taken[fits[0]])


def uniform_shards(rows: DataFrame, shards: int = 16, seed: int = 17, block_rows: int = 262_144) -> DataFrame:
    """Adds ``shard`` (from 0) and ``slot`` (gapless from 0 in each shard, in
    random order) to ``rows``; every order of the rows is equally likely.

    The rows are stored once with their part and place, so the counts and
    the deal agree whatever is recomputed; pass only the columns to be
    moved. Nulls, repeated rows and rows of any size are dealt like any
    other; an empty table gives an empty result. Columns keep their names,
    whatever they are (inside they go by number).
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    names = rows.columns
    rows = rows.toDF(*(f"_s10_{i}" for i in range(len(names))))
    cols = rows.columns
    placed_schema = StructType(list(rows.schema.fields)).add("_s10_part", IntegerType()).add("_s10_pos", LongType())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            extra = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))]
            at += n
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, "_s10_part", "_s10_pos"])

    table = staged(rows.mapInArrow(number, placed_schema), "parts")
    counts = table.groupBy("_s10_part").agg(F.count(F.lit(1)).alias("n")).collect()  # one integer per part
    parts = sorted((r["_s10_part"], r["n"]) for r in counts)
    index = {p: k for k, (p, _) in enumerate(parts)}
    upto = np.concatenate([[0], np.cumsum([n for _, n in parts])]).astype(np.int64)
    shard_of, first, size = block_sizes(int(upto[-1]), shards, block_rows)
    dealt_schema = StructType(list(rows.schema.fields))
    for name in ("_s10_block", "_s10_part"):
        dealt_schema = dealt_schema.add(name, IntegerType())
    dealt_schema = dealt_schema.add("_s10_pos", LongType())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for b in batches:
            part, pos = (b.column(len(cols) + k).to_numpy() for k in (0, 1))
            block = np.empty(b.num_rows, np.int32)
            for p in np.unique(part).tolist():
                if p not in known:
                    if len(known) >= 4:  # a split holds few parts, in order
                        known.pop(next(iter(known)))
                    k = index[p]
                    row = matrix_row(k, upto, size, seed)
                    to = np.repeat(np.arange(len(size), dtype=np.int32), row)
                    np.random.default_rng([seed, k]).shuffle(to)  # the local permutation
                    known[p] = to
                here = part == p
                block[here] = known[p][pos[here]]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(cols)], pa.array(block), pa.array(part), pa.array(pos)], names=dealt_schema.names
            )

    dealt = table.mapInArrow(deal, dealt_schema)
    tie = [F.col("_s10_part"), F.col("_s10_pos")]
    order = Window.partitionBy("_s10_block").orderBy(F.xxhash64(F.lit(seed), *tie), *tie)
    ranked = dealt.withColumn("_s10_rank", F.row_number().over(order).cast("long") - 1)
    blocks = [(k, int(s), int(f)) for k, (s, f) in enumerate(zip(shard_of, first))]
    at = rows.sparkSession.createDataFrame(blocks, "_s10_block int, _s10_shard int, _s10_first long")
    joined = ranked.join(at, "_s10_block")
    return joined.select(*cols, "_s10_shard", F.col("_s10_first") + F.col("_s10_rank")).toDF(*names, "shard", "slot")
