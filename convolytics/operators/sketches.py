"""Distinct counts that add up (A2, A3): stored HyperLogLog sketches.

A sketch per key (a day, a topic) is a few kilobytes however many ids it has
seen. Sketches of several keys, or of days counted at other times, unite to
one; the ids themselves are never kept, shuffled or expanded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

SKETCH = "sketch"


def id_sketches(df: DataFrame, ids: str, by: Sequence[str] = (), precision: int = 14) -> DataFrame:
    """One row per key: ``rows`` and the sketch of the non-null ``ids``
    (about 0.8 % standard error at precision 14)."""
    c = F.col(f"`{ids}`").cast("string")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.hll_sketch_agg(c, F.lit(precision)).alias(SKETCH))


def roll_up(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches united over all keys but ``by``."""
    return sketches.groupBy(*by).agg(F.sum("rows").alias("rows"), F.hll_union_agg(SKETCH).alias(SKETCH))


def estimates(sketches: DataFrame) -> DataFrame:
    """``unique_ids`` in place of the sketch; no row is no id."""
    return sketches.withColumn("unique_ids", F.coalesce(F.hll_sketch_estimate(SKETCH), F.lit(0).cast("long"))).drop(SKETCH)
