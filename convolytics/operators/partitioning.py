"""Spreading CPU-heavy work over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(source: DataFrame, partitions: int) -> DataFrame:
    """Round-robin a freshly read table over ``partitions`` tasks, for inputs
    that arrive in few splits (one unsplittable multi-line CSV, a single
    Parquet row group) before per-row CPU work such as tokenising whole
    texts. The caller decides; the plan never depends on the data's size."""
    return source.repartition(partitions)
