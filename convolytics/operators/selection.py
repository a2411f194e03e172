"""Median, quantiles and histogram of a continuous column.

Counting every distinct value needs memory that grows with them. Here each
pass counts the values in a fixed number of bins; the bin that holds a wanted
rank is split again by its own smallest and largest value, until it holds one
value. Bins follow the values' order, so ranks are exact. The first pass's
bins subdivide those of the histogram, which is read off it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

_BINS = 1024  # of one pass; a pass returns at most so many rows


@dataclass
class Summary:
    """What ``summarize`` found; ``quantiles`` in the order asked for."""

    n: int
    mean: float | None
    low: float | None
    high: float | None
    quantiles: list[float | None]
    edges: list[float]
    counts: list[int]


def _bin(x: Column, lo: float, hi: float, bins: int) -> Column:
    """A bin number that never falls as ``x`` rises; halves keep the widths
    of the largest doubles finite."""
    width = F.lit(hi / 2 - lo / 2)
    at = F.floor((x / 2 - F.lit(lo / 2)) / width * F.lit(float(bins))).cast("int")
    return F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1))


def _counted(values: DataFrame, lo: float, hi: float, bins: int) -> list[tuple[float, float, int]]:
    """Smallest value, largest value and number of values of every bin
    between ``lo`` and ``hi`` that holds any, in order."""
    here = values.filter((F.col("x") >= F.lit(lo)) & (F.col("x") <= F.lit(hi)))
    rows = here.groupBy(_bin(F.col("x"), lo, hi, bins).alias("b")).agg(
        F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n")
    )
    return [(r["lo"], r["hi"], r["n"]) for r in rows.orderBy("b").collect()]


def _select(values: DataFrame, first: list[tuple[float, float, int]], ranks: list[int]) -> dict[int, float]:
    """The values of the given ranks (from 0)."""
    out: dict[int, float] = {}
    todo = [(0, first, sorted(set(ranks)))]
    while todo:
        before, cells, wanted = todo.pop()
        for lo, hi, n in cells:
            mine = [r for r in wanted if before <= r < before + n]
            if mine and lo == hi:
                out.update(dict.fromkeys(mine, lo))
            elif mine and n == 2:
                out.update({r: lo if r == before else hi for r in mine})
            elif mine:
                todo.append((before, _counted(values, lo, hi, _BINS), mine))
            before += n
    return out


def _edges(lo: float, hi: float, bins: int) -> list[float]:
    """Equal-width edges; without a range, half a unit to either side."""
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    step = (hi - lo) / bins
    return [lo + i * step for i in range(bins)] + [hi]


def summarize(df: DataFrame, column: str, quantiles: tuple[float, ...] = (0.5,), bins: int = 20) -> Summary:
    """Count, mean, range, exact interpolated quantiles and the histogram of
    a numeric column; nulls and NaN are left out, infinities are refused. The
    histogram has ``bins`` equal bins from the smallest to the largest value,
    the last closed on the right. Runs three passes for typical columns, one
    more for each further thousandfold crowding of values."""
    values = df.select(F.col(f"`{column}`").cast("double").alias("x")).filter("x IS NOT NULL AND NOT isnan(x)")
    r = values.agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    n, lo, hi = r["n"], r["lo"], r["hi"]
    if n == 0:
        return Summary(0, None, None, None, [None] * len(quantiles), _edges(0.0, 1.0, bins), [0] * bins)
    if lo == float("-inf") or hi == float("inf"):
        raise ValueError(f"column {column!r} holds infinities, which have no histogram")
    edges = _edges(lo, hi, bins)
    if lo == hi:
        counts = [0] * bins
        counts[bins // 2] = n
        return Summary(n, r["mean"], lo, hi, [lo] * len(quantiles), edges, counts)

    # the bin by division is off by one at most; the edges themselves decide
    edge = F.array(*[F.lit(e) for e in edges])
    guess = _bin(F.col("x"), lo, hi, bins)
    at = (
        F.when(F.col("x") < F.element_at(edge, guess + 1), guess - 1)
        .when((guess < bins - 1) & (F.col("x") >= F.element_at(edge, guess + 2)), guess + 1)
        .otherwise(guess)
    )
    inner = max(1, _BINS // bins)
    cell = _bin(F.col("x"), lo, hi, bins * inner)
    rows = (
        values.select("x", at.alias("bin"), cell.alias("cell")).groupBy("bin", "cell")
        .agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n")).collect()
    )
    counts = [0] * bins
    for c in rows:
        counts[c["bin"]] += c["n"]
    cells = sorted((c["lo"], c["hi"], c["n"]) for c in rows)

    places = [q * (n - 1) for q in quantiles]
    picked = _select(values, cells, [k for p in places for k in (int(p), min(int(p) + 1, n - 1))])
    found = []
    for p in places:
        a, b = picked[int(p)], picked[min(int(p) + 1, n - 1)]
        found.append(a + (b - a) * (p - int(p)))
    return Summary(n, r["mean"], lo, hi, found, edges, counts)


def continuous_stats(df: DataFrame, column: str) -> DataFrame:
    """A12 for a continuous column as one row: ``n, median, max, min``."""
    s = summarize(df, column)
    return df.sparkSession.createDataFrame([(s.n, s.quantiles[0], s.high, s.low)], "n long, median double, max double, min double")


def continuous_histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """H1/H2 for a continuous column: ``bin, bin_start, bin_end, n``."""
    s = summarize(df, column, (), bins)
    rows = [(i, s.edges[i], s.edges[i + 1], s.counts[i]) for i in range(bins)]
    return df.sparkSession.createDataFrame(rows, "bin long, bin_start double, bin_end double, n long").orderBy("bin")
