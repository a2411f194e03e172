"""Whitening of embeddings by the covariance of their distinct vectors.

Vectors are first put on an integer grid (``floor(scale * entry)``), so equal
ones can be grouped exactly. Each distinct vector is one row from there on,
with the number of its copies: a hot vector costs one row per task before the
shuffle and one in all after it. The fit weighs every distinct vector by one,
or by its copies, and takes two passes over the distinct vectors: exact
integer sums, then the products of the centred vectors, one matrix product a
batch, summed entry by entry in Spark. Each distinct vector is then projected
once, and the rows get their values back by a digest of the vector.

The driver holds one matrix of the vectors' dimension, never a vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from convolytics.llm.common import join_groups, require_columns, staged

_LONG = 1 << 63


def _usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(
        vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf")))
    )


def _on_grid(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``id, x, digest`` of the rows with a usable vector."""
    v = F.col(f"`{vector_col}`")
    x = F.transform(v, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    kept = rows.filter(_usable(v)).select(F.col(f"`{id_col}`").alias("id"), x.alias("x"))
    return kept.withColumn("digest", F.unhex(F.sha2(F.concat_ws(",", F.col("x").cast("array<string>")), 256)))


def _by_length(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``length, rows, matrix`` for each vector length in a batch."""
    lists = batch.column(at)
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    sizes = np.diff(ends)
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        if d:
            yield d, rows, flat[ends[rows][:, None] + np.arange(d)]


def _weighted_sums(x: np.ndarray, w: np.ndarray) -> list[int]:
    """Exact sums per dimension, in Python's integers where 64 bits may not do."""
    if len(x) and int(w.sum()) * max(abs(int(x.min())), abs(int(x.max()))) >= _LONG:
        return (x.astype(object) * w.astype(object)[:, None]).sum(axis=0).tolist()
    return (x * w[:, None]).sum(axis=0).tolist()


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over dimensions of ``(n * x - sums) ** 2`` of each row, exactly;
    None where it does not fit 64 bits."""
    most = n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, sums))
    if most * most * len(sums) < _LONG:
        away = x * n - np.asarray(sums, np.int64)
        return (away * away).sum(axis=1).tolist()
    away = x.astype(object) * n - np.asarray(sums, object)
    return [v if v < _LONG else None for v in (away * away).sum(axis=1).tolist()]


@dataclass
class Fit:
    """The covariance's leading components for one vector length."""

    n: int
    sums: list[int]
    mean: np.ndarray
    components: np.ndarray  # a column for each
    values: np.ndarray
    explained: list[float]


def _fit(groups: DataFrame, components: int) -> dict[int, Fit]:
    """``groups``: ``x, copies, weight``. One fit for each vector length."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[int]] = {}
        for batch in batches:
            weight = batch.column(1).to_numpy()
            for d, rows, x in _by_length(batch, 0):
                here = [int(weight[rows].sum()), *_weighted_sums(x, weight[rows])]
                total[d] = [a + b for a, b in zip(total.get(d, [0] * (d + 1)), here)]
        out = [(d, i, Decimal(v)) for d, sums in total.items() for i, v in enumerate(sums)]
        kinds = (pa.int32(), pa.int32(), pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else ([], [], []), kinds)], names=["d", "i", "v"])

    needed = groups.select("x", "weight")
    summed = needed.mapInArrow(add_up, "d int, i int, v decimal(38,0)").groupBy("d", "i").agg(F.sum("v").alias("v"))
    sums: dict[int, list[int]] = {}
    for r in summed.orderBy("d", "i").collect():  # the dimension's numbers for each vector length
        sums.setdefault(r["d"], []).append(int(r["v"]))
    mean = {d: np.asarray([s / v[0] for s in v[1:]]) for d, v in sums.items()}

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            weight = batch.column(1).to_numpy().astype(float)
            for d, rows, x in _by_length(batch, 0):
                centred = x.astype(float) - mean[d]
                total[d] = total.get(d, 0.0) + (centred * weight[rows][:, None]).T @ centred
        for d, matrix in total.items():
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), d, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(matrix[i, j])],
                names=["d", "i", "j", "v"],
            )

    entries = needed.mapInArrow(products, "d int, i int, j int, v double").groupBy("d", "i", "j").agg(F.sum("v").alias("v")).toArrow()
    at, i, j, v = (entries.column(c).to_numpy() for c in range(4))
    fits = {}
    for d, (n, *s) in sums.items():
        cov, here = np.zeros((d, d)), at == d
        cov[i[here], j[here]] = cov[j[here], i[here]] = v[here] / n
        values, vectors = np.linalg.eigh(cov)
        values, vectors, trace = values[::-1], vectors[:, ::-1], float(np.trace(cov))
        # a direction in which the vectors do not differ cannot be whitened
        k = int((values[:components] > 16 * d * np.finfo(float).eps * trace).sum())
        fits[d] = Fit(n, s, mean[d], vectors[:, :k], values[:k], [float(e / trace) for e in values[:k]])
    return fits


def _project(groups: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    """``digest, copies, weight, d, deviation, whitened`` of each distinct vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows, x in _by_length(batch, 0):
                fit = fits[d]
                z = (x.astype(float) - fit.mean) @ fit.components / np.sqrt(fit.values)
                picked = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(picked) for c in (1, 2, 3)), pa.array(np.full(len(rows), d, np.int32)),
                     pa.array(deviations(x, fit.n, fit.sums), pa.int64()), pa.array(list(z), pa.list_(pa.float64()))],
                    names=["digest", "copies", "weight", "d", "deviation", "whitened"],
                )

    schema = "digest binary, copies long, weight long, d int, deviation long, whitened array<double>"
    return groups.select("x", "digest", "copies", "weight").mapInArrow(run, schema)


def _identity_error(table: DataFrame, components: int) -> float:
    """The largest absolute entry of the whitened vectors' weighted covariance
    minus the identity, over all vector lengths; centred before multiplying."""
    z = [F.get("whitened", F.lit(i)) for i in range(components)]
    w, total = F.col("weight"), F.sum("weight")
    means = table.groupBy("d").agg(*[(F.sum(w * z[i]) / total).alias(f"m{i}") for i in range(components)])
    away = table.join(F.broadcast(means), "d")  # a row for each vector length
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    products = [F.sum(w * (z[i] - F.col(f"m{i}")) * (z[j] - F.col(f"m{j}"))) / total for i, j in pairs]
    found = away.groupBy("d").agg(*[F.abs(p - F.lit(float(i == j))).alias(f"e{i}_{j}") for p, (i, j) in zip(products, pairs)]).collect()
    return max((v for r in found for v in r[1:] if v is not None), default=0.0)


def whiten(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, components: int = 4, weights: str = "one",
) -> DataFrame:
    """``id_col, component, n, deviation, whitened, explained, identity_error``
    for every usable row of ``rows`` and every component (numbered from 1, by
    falling eigenvalue).

    ``weights`` is ``one`` (each distinct vector on the grid counts once) or
    ``count`` (by its copies); ``n`` is the sum of the weights. ``deviation`` is
    exact, and null where it does not fit 64 bits. ``identity_error`` is one
    value for the whole result.

    Vectors that are null or hold null or non-finite entries give no row;
    grid values beyond 64 bits are the nearest ones that fit. Vectors of
    different lengths are fitted apart, each length by itself. Directions
    without variance are no components, so a table whose vectors are all equal,
    an empty vector and an empty table give no rows. Repeated rows give
    repeated results, null ids stay null; other columns are not read.
    """
    if weights not in ("one", "count"):
        raise ValueError("weights must be 'one' or 'count'")
    require_columns(rows, [id_col, vector_col])
    placed = _on_grid(rows, id_col, vector_col, scale)
    weight = F.lit(1).cast("long") if weights == "one" else F.col("copies")
    grouped = placed.groupBy("x", "digest").agg(F.count(F.lit(1)).alias("copies")).withColumn("weight", weight)
    groups = staged(grouped, "vectors")
    fits = _fit(groups, components)
    table = staged(_project(groups, fits), "whitened")
    error = _identity_error(table, components)
    facts = rows.sparkSession.createDataFrame(
        [(d, f.n, f.explained) for d, f in fits.items()], "d int, n long, explained array<double>"
    )
    values = join_groups(placed.select("id", "digest"), table.drop("weight"), "digest", "copies").join(F.broadcast(facts), "d")
    each = values.select("id", "n", "deviation", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "part"))
    return each.select(
        F.col("id").alias(id_col), (F.col("at") + 1).cast("int").alias("component"), "n", "deviation",
        F.col("part.whitened").alias("whitened"), F.col("part.explained").alias("explained"), F.lit(error).alias("identity_error"),
    )
