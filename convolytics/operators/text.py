"""Text-length statistics (A12), histograms (H1, H2) and keywords."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from convolytics import constants as K
from convolytics.functions.measures import Measures, PER_ROW
from convolytics.functions.text import keyword_tokens
from convolytics.schema import Columns, DEFAULT_COLUMNS


def text_stats(df: DataFrame, cols: Columns = DEFAULT_COLUMNS) -> DataFrame:
    """A12 in one row: mean, exact median (interpolating, as the dashboard's),
    max and min of the query and resolution word counts.

    ``median`` keeps a value -> count map per partition and merges the maps;
    word counts repeat, so the map stays small whatever the row count."""
    out = []
    for prefix, c in (("query_words", cols.query_words), ("resolution_words", cols.resolution_words)):
        out += [
            F.avg(c).alias(f"{prefix}_mean"),
            F.median(c).cast("double").alias(f"{prefix}_median"),
            F.max(c).alias(f"{prefix}_max"),
            F.min(c).alias(f"{prefix}_min"),
        ]
    return df.agg(*out)


def histogram(df: DataFrame, column: str, bins: int = K.HISTOGRAM_BINS, m: Measures = PER_ROW) -> DataFrame:
    """H1/H2: ``bins`` equal-width bins from the column's min to max, the
    last bin closed on the right, empty bins kept: ``bin, bin_start,
    bin_end, n``. If min = max the range is min - 0.5 .. max + 0.5.

    Null and NaN values are left out, as the dashboard does; without any
    value the range is 0 .. 1. The input is first reduced to one row per
    distinct value (partial aggregation, so the shuffle carries at most one
    row per value and partition), which both the bounds and the bins read.
    Bin placement follows the edge comparisons of numpy's histogram (float
    edges ``lo + i * step``), so values on an edge land where numpy puts
    them.
    """
    valid = F.col(column).isNotNull()
    if dict(df.dtypes)[column] in ("float", "double"):
        valid &= ~F.isnan(column)
    counts = df.filter(valid).groupBy(column).agg(m.rows().alias("n"))
    # one scalar subquery for both bounds; it sums n too, so that it is the
    # same aggregate as the one placed below
    seen = counts.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"), F.sum("n").alias("n"))
    bounds = seen.select(
        F.struct(F.coalesce("lo", F.lit(0.0)).alias("lo"), F.coalesce("hi", F.lit(1.0)).alias("hi"), "n")
    ).scalar()

    def with_range(frame: DataFrame) -> DataFrame:
        # Each step is its own projection, so every later expression reads
        # plain columns instead of re-inlining the subqueries.
        lo0, hi0 = F.col("_lo0"), F.col("_hi0")
        return (
            frame.withColumn("_bounds", bounds)
            .withColumns({"_lo0": F.col("_bounds.lo"), "_hi0": F.col("_bounds.hi")})
            .withColumns(
                {
                    "_lo": F.when(lo0 == hi0, lo0 - F.lit(0.5)).otherwise(lo0),
                    "_hi": F.when(lo0 == hi0, hi0 + F.lit(0.5)).otherwise(hi0),
                }
            )
            .withColumn("_step", (F.col("_hi") - F.col("_lo")) / F.lit(float(bins)))
        )

    def edge(i):
        return F.when(i >= bins, F.col("_hi")).otherwise(F.col("_lo") + i.cast("double") * F.col("_step"))

    x = F.col(column).cast("double")
    placed = (
        with_range(counts)
        .withColumn("_raw", (((x - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))) * F.lit(float(bins))).cast("bigint"))
        .withColumn("_raw", F.when(F.col("_raw") >= bins, F.lit(bins - 1)).otherwise(F.col("_raw")))
        .withColumn("_dec", F.when(x < edge(F.col("_raw")), F.col("_raw") - 1).otherwise(F.col("_raw")))
        .withColumn(
            "bin",
            F.when((x >= edge(F.col("_dec") + 1)) & (F.col("_dec") != bins - 1), F.col("_dec") + 1).otherwise(
                F.col("_dec")
            ),
        )
    )
    per_bin = placed.select(F.col("bin").cast("bigint").alias("bin"), "n")
    # Empty bins: a zero row for every bin, summed with the real counts (a
    # union and an aggregate of at most 2 x bins rows; no join, so no filter
    # is inferred and pushed back into the scan).
    zeros = df.sparkSession.range(bins).select(F.col("id").alias("bin"), F.lit(0).cast("bigint").alias("n"))
    summed = per_bin.unionByName(zeros).groupBy("bin").agg(F.sum("n").cast("bigint").alias("n"))
    b = F.col("bin")
    return (
        with_range(summed)
        .select(b, edge(b).alias("bin_start"), edge(b + 1).alias("bin_end"), "n")
        .orderBy("bin")
    )


def hist_query_words(df: DataFrame, cols: Columns = DEFAULT_COLUMNS) -> DataFrame:
    return histogram(df, cols.query_words)


def hist_resolution_words(df: DataFrame, cols: Columns = DEFAULT_COLUMNS) -> DataFrame:
    return histogram(df, cols.resolution_words)


def top_keywords(
    df: DataFrame,
    column: str | None = None,
    top_n: int = K.KEYWORD_DEFAULT_TOP_N,
    stop_words: Iterable[str] = K.STOP_WORDS,
    extra_stop_words: Iterable[str] = (),
    cols: Columns = DEFAULT_COLUMNS,
) -> DataFrame:
    """The ``top_n`` most frequent keywords of a text column: ``keyword,
    n``, count descending, ties to the smaller keyword.

    Each text is tokenised whole, inside the JVM; the dashboard's step of
    joining every query into one string is not reproduced because a space
    never joins two tokens. Counting is a partial aggregate per keyword before
    the shuffle, so a very common keyword costs one row per partition, and the
    top-n is taken per partition before the final merge. For a source that
    arrives in very few splits see ``partitioning.spread``.
    """
    column = column or cols.query
    stop = tuple(stop_words) + tuple(extra_stop_words)
    words = df.select(F.explode(keyword_tokens(column, stop)).alias("keyword"))
    return (
        words.groupBy("keyword")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), F.col("keyword").asc())
        .limit(top_n)
    )
