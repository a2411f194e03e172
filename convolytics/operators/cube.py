"""The dashboard's tables as roll-ups of one stored cube of partial counts.

One pass over the featurised table builds four small parts by a single
aggregate with grouping sets, combined in each task before its one shuffle:

* ``cells``: per combination of topic, status, sentiment, intent and spam the
  rows ``n``, the non-null session ids and the sums of both word counts;
* ``lengths``: per word count of queries and of resolutions, the rows;
* ``sessions``: the distinct session ids.

Every KPI, frequency table, grouped summary, cross-tab, length statistic,
histogram and the insights row are roll-ups of these parts, by the same
operators that work on rows (``functions.measures``). Nulls are groups like any
value, so every rule about nulls and denominators carries over. The cube of
several inputs is the union of theirs, rolled up once more (``merge``), so a
new day's file is counted alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from convolytics import constants as K
from convolytics.functions.measures import CellMeasures
from convolytics.functions.numeric import safe_divide
from convolytics.operators import crosstab as xt
from convolytics.operators import frequency as fq
from convolytics.operators import grouped as gr
from convolytics.operators import kpis
from convolytics.operators import text as tx
from convolytics.schema import Columns, DEFAULT_COLUMNS, DEFAULT_LABELS, Labels, has_quality_columns
from convolytics.session import checkpoint_dir

TABLE_PREFIX = "cube-"
_IN_CELL = CellMeasures("n")
_QUERY, _RESOLUTION = "query", "resolution"


def _aggregate(featured: DataFrame, cols: Columns) -> DataFrame:
    """All parts as one table: ``part``, the keys and the measures."""
    dims = _dims(featured, cols)
    keyed = featured.select(
        *[F.col(f"`{d}`").alias(f"d{i}") for i, d in enumerate(dims)],
        *[F.col(f"`{c}`").alias(k) for k, c in (("s", cols.session_id), ("q", cols.query_words), ("r", cols.resolution_words))],
        *[F.col(f"`{c}`").alias(k) for k, c in (("id", cols.session_id), ("qw", cols.query_words), ("rw", cols.resolution_words))],
    )
    names = [f"d{i}" for i in range(len(dims))]
    sets = [names, ["s"], ["q"], ["r"]]
    grouped = keyed.groupingSets(sets, *names, "s", "q", "r").agg(
        *[F.grouping(c).alias(f"not_{c}") for c in ("d0", "s", "q")],
        F.count(F.lit(1)).alias("n"),
        F.count("id").alias("ids"),
        F.sum("qw").alias("qw"),
        F.sum("rw").alias("rw"),
    )
    part = F.when(F.col("not_d0") == 0, "cells").when(F.col("not_s") == 0, "sessions").when(F.col("not_q") == 0, _QUERY).otherwise(_RESOLUTION)
    return grouped.select(part.alias("part"), *names, "s", F.coalesce("q", "r").alias("value"), "n", "ids", "qw", "rw")


def _dims(featured: DataFrame, cols: Columns) -> list[str]:
    quality = [cols.intent, cols.spam] if has_quality_columns(featured, cols) else []
    return [cols.topic, cols.status, cols.sentiment, *quality]


@dataclass
class Cube:
    """The parts of one cube (``table``) and the names of its dimensions."""

    table: DataFrame
    dims: list[str]
    cols: Columns = DEFAULT_COLUMNS

    @property
    def cells(self) -> DataFrame:
        """The dimensions, ``n``, and under the input's names the number of
        non-null session ids and the sums of the word counts."""
        rows = self.table.filter(F.col("part") == "cells")
        names = [F.col(f"d{i}").alias(d) for i, d in enumerate(self.dims)]
        c = self.cols
        return rows.select(
            *names, "n", F.col("ids").alias(c.session_id), F.col("qw").alias(c.query_words), F.col("rw").alias(c.resolution_words)
        )

    @property
    def lengths(self) -> DataFrame:
        """``which, value, n``: rows per word count."""
        return self.table.filter(F.col("part").isin(_QUERY, _RESOLUTION)).select(F.col("part").alias("which"), "value", "n")

    @property
    def sessions(self) -> DataFrame:
        """The distinct session ids (null is one row, if there is any)."""
        return self.table.filter(F.col("part") == "sessions").select(F.col("s").alias(self.cols.session_id))

    def has_quality(self) -> bool:
        return self.cols.intent in self.dims


def build_cube(featured: DataFrame, cols: Columns = DEFAULT_COLUMNS, store: bool = True) -> Cube:
    """Counts ``featured`` once. With ``store`` the parts are written as a
    Parquet table under ``spark.checkpoint.dir``, split by part; without, the
    cube is lazy and every roll-up of it counts again."""
    dims = _dims(featured, cols)
    table = _aggregate(featured, cols)
    return Cube(_stored(table) if store else table, dims, cols)


def _stored(table: DataFrame) -> DataFrame:
    spark = table.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{TABLE_PREFIX}{uuid.uuid4().hex}"
    table.write.partitionBy("part").parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def merge(cubes: list[Cube], store: bool = True) -> Cube:
    """One cube of several with the same dimensions: their rows added up."""
    first = cubes[0]
    if any(c.dims != first.dims for c in cubes):
        raise ValueError("cubes have different dimensions")
    keys = ["part", *[f"d{i}" for i in range(len(first.dims))], "s", "value"]
    rows = reduce(DataFrame.unionByName, [c.table for c in cubes])
    table = rows.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in ("n", "ids", "qw", "rw")])
    return Cube(_stored(table) if store else table, first.dims, first.cols)


# --- the roll-ups that are not the row operators -------------------------------


def kpi_overview(cube: Cube, labels: Labels = DEFAULT_LABELS) -> DataFrame:
    """Rates from the cells, distinct topics from their keys, distinct
    sessions by counting the ids' part. No key is expanded or sorted."""
    cols = cube.cols
    status, sentiment = F.col(cols.status), F.col(cols.sentiment)
    per_topic = cube.cells.groupBy(cols.topic).agg(
        _IN_CELL.rows().alias("n"),
        _IN_CELL.rows(status == labels.resolved).alias("resolved"),
        _IN_CELL.rows(sentiment == labels.negative).alias("negative"),
        _IN_CELL.rows(status == labels.drop_off).alias("drop_off"),
    )

    def share(part: str) -> Column:
        return safe_divide(F.sum(part), F.sum("n")) * F.lit(100.0).cast("double")

    ids = cube.sessions.agg(F.count(cols.session_id).alias("ids")).select("ids").scalar()
    return per_topic.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_conversations"),
        F.count(cols.topic).alias("unique_topics"),
        ids.alias("unique_sessions"),
        share("resolved").alias("resolution_rate_pct"),
        share("negative").alias("negative_sentiment_pct"),
        share("drop_off").alias("drop_off_rate_pct"),
    )


def text_stats(cube: Cube) -> DataFrame:
    """A12 from the distributions of word counts: the median is exact."""
    out = []
    for prefix, which in (("query_words", _QUERY), ("resolution_words", _RESOLUTION)):
        here = F.col("which") == which
        value, n = F.when(here, F.col("value")), F.when(here, F.col("n")).otherwise(F.lit(0))
        out += [
            safe_divide(F.sum(value * n), F.sum(n)).alias(f"{prefix}_mean"),
            F.percentile(value, 0.5, n).cast("double").alias(f"{prefix}_median"),
            F.max(value).alias(f"{prefix}_max"),
            F.min(value).alias(f"{prefix}_min"),
        ]
    return cube.lengths.agg(*out)


def histogram(cube: Cube, which: str, bins: int = K.HISTOGRAM_BINS) -> DataFrame:
    """H1/H2 of ``query`` or ``resolution`` word counts."""
    return tx.histogram(cube.lengths.filter(F.col("which") == which).select("value", "n"), "value", bins, _IN_CELL)


def rollups(labels: Labels = DEFAULT_LABELS, quality: bool = True) -> dict[str, Callable[[Cube], DataFrame]]:
    """Every analysis that the cube answers, by name, as ``cube -> DataFrame``."""
    m = _IN_CELL

    def of(fn: Callable[..., DataFrame], *args, **more) -> Callable[[Cube], DataFrame]:
        return lambda cube: fn(cube.cells, *args, cols=cube.cols, m=m, **more)

    out = {
        "kpi_overview": lambda cube: kpi_overview(cube, labels),
        "topic_counts": of(fq.topic_counts),
        "topics_top15": of(fq.topics_top, K.TOP_TOPICS_CHART),
        "topics_top10_pct": of(fq.topics_top_pct, K.TOP_TOPICS_TABLE),
        "top_topic": of(fq.top_topic),
        "topic_summary": of(gr.topic_summary, labels=labels),
        "kpi_status": of(fq.kpi_status),
        "status_counts": of(fq.status_counts),
        "xt_topic_status_top20": of(xt.xt_topic_status_top, K.TOP_TOPICS_HEATMAP),
        "resolution_rate_by_topic": of(gr.resolution_rate_by_topic, K.TOP_RESOLUTION_RATE, labels=labels),
        "kpi_sentiment": of(fq.kpi_sentiment, labels=labels),
        "sentiment_counts": of(fq.sentiment_counts),
        "xt_status_sentiment": of(xt.xt_status_sentiment),
        "xt_topic_sentiment_top15": of(xt.xt_topic_sentiment_top, K.TOP_TOPICS_SENTIMENT),
        "text_stats": text_stats,
        "hist_query_words": lambda cube: histogram(cube, _QUERY),
        "hist_resolution_words": lambda cube: histogram(cube, _RESOLUTION),
        "avg_query_words_by_topic": of(gr.avg_query_words_by_topic, K.TOP_AVG_QUERY_WORDS),
        "avg_resolution_words_by_status": of(gr.avg_resolution_words_by_status),
        "topic_summary_report": of(gr.topic_summary_report, labels=labels),
        "xt_topic_status_margins": of(xt.xt_topic_status_margins),
        "xt_topic_sentiment_margins": of(xt.xt_topic_sentiment_margins),
        "key_insights": of(kpis.key_insights, labels=labels),
    }
    if quality:
        out |= {
            "kpi_quality": of(kpis.kpi_quality, labels=labels),
            "intent_counts": of(fq.intent_counts),
            "spam_counts": of(fq.spam_counts),
            "xt_status_intent": of(xt.xt_status_intent),
            "xt_topic_intent_top10": of(xt.xt_topic_intent_top, K.TOP_TOPICS_INTENT),
            "xt_sentiment_spam": of(xt.xt_sentiment_spam),
            "xt_intent_spam": of(xt.xt_intent_spam),
            "accuracy_by_status": of(gr.accuracy_by_status, labels=labels),
            "spam_by_sentiment": of(gr.spam_by_sentiment, labels=labels),
        }
    return out
