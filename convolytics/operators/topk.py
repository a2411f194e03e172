"""Exact top-k of many keys without shuffling every key.

Two passes. The first keeps a frequent-items sketch of fixed size per task
(local heavy hitters), merged to one row: for every key it tracks an upper
bound of its count, and no count is off by more than a known share of all
rows. The k-th largest estimate less that error is a count that k keys reach
for certain, so a key below it is out. The second pass counts exactly the few
keys that can reach it; only they are shuffled. If the bound is no help (so
many rows in rare keys that an untracked key might be in the answer), every
key is counted: the result is exact, ties included, either way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: by the sketch's guarantee no count is off by more than this share of the
#: rows, divided by the number of tracked keys; keys it does not report may
#: have up to twice that
_ERROR = 3.5


def candidates(keys: DataFrame, column: str, k: int, tracked: int = 10_000) -> list[str] | None:
    """The keys that can be among the ``k`` most frequent, at most
    ``tracked``; None if that cannot be told."""
    c = "`" + column.replace("`", "``") + "`"
    row = keys.filter(F.expr(f"{c} IS NOT NULL")).agg(
        F.count(F.lit(1)).alias("rows"), F.expr(f"approx_top_k({c}, {int(tracked)}, {int(tracked)})").alias("top")
    ).first()
    found = sorted(((r["count"], r["item"]) for r in row["top"] or []), reverse=True)
    if len(found) < k:
        return None
    error = _ERROR * row["rows"] / tracked
    least = found[k - 1][0] - error
    if least <= 2 * error:
        return None
    return [item for count, item in found if count >= least]


def top_counts(keys: DataFrame, column: str, k: int, tracked: int = 10_000) -> DataFrame:
    """``column, n``: the ``k`` most frequent non-null values of a text
    column, count descending, ties to the smaller key. Runs the first pass
    when called."""
    if not 1 <= k <= tracked:
        raise ValueError("k must lie between 1 and the number of tracked keys")
    rows = keys.select(F.col(f"`{column}`")).filter(F.col(f"`{column}`").isNotNull())
    chosen = candidates(rows, column, k, tracked)
    if chosen is not None:
        few = keys.sparkSession.createDataFrame([(v,) for v in chosen], f"`{column}` string")
        rows = rows.join(F.broadcast(few), column, "left_semi")  # at most ``tracked`` rows
    counted = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.col("n").desc(), F.col(f"`{column}`").asc()).limit(k)
