"""The whole dashboard as one Spark application.

``run_dashboard`` loads and validates the input, adds the text features once,
materialises that table in the shared checkpoint folder, and returns every
analysis as a DataFrame over it. Materialising matters when many
analyses run: each would otherwise re-read and re-featurise the input. One more
pass over it stores a cube of partial counts (``operators.cube``), of which all
but the keyword, preview and profile analyses are roll-ups. The
checkpoint lives in ``spark.checkpoint.dir`` (shared storage on a cluster),
so a lost executor does not force recomputation from the source files.
Quality analyses are planned only when both quality columns exist.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from convolytics import constants as K
from convolytics.operators import crosstab as xt
from convolytics.operators import cube as cb
from convolytics.operators import frequency as fq
from convolytics.operators import grouped as gr
from convolytics.operators import kpis
from convolytics.operators import profile as pf
from convolytics.operators import text as tx
from convolytics.operators.features import add_text_features
from convolytics.schema import Columns, DEFAULT_COLUMNS, DEFAULT_LABELS, Labels, has_quality_columns, validate
from convolytics.session import checkpoint_dir
from convolytics.sources.csv import load_sessions


_TABLE_PREFIX = "featured-"


def materialize(df: DataFrame, how: str = "table") -> DataFrame:
    """``table``: Parquet table written under ``spark.checkpoint.dir`` and read
    back, so each analysis reads only its columns; ``release`` deletes it;
    ``checkpoint``: reliable checkpoint in the same folder (row data: every
    analysis reads whole rows); ``cache``: memory-and-disk persistence (recomputed from the
    lineage if an executor is lost); ``none``: unchanged."""
    spark = df.sparkSession
    if how == "checkpoint":
        checkpoint_dir(spark)
        return df.checkpoint(eager=True)
    if how == "table":
        path = f"{checkpoint_dir(spark).rstrip('/')}/{_TABLE_PREFIX}{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.parquet(path)
    if how == "cache":
        out = df.persist(StorageLevel.MEMORY_AND_DISK)
        out.count()
        return out
    if how == "none":
        return df
    raise ValueError(f"unknown materialisation {how!r}")


def release(featured: DataFrame) -> None:
    """Deletes the table that ``materialize(how="table")`` wrote, or that of a
    stored cube; the lazy analyses over it cannot be run afterwards. Anything
    else is unpersisted."""
    spark = featured.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    # a cube's files lie one folder deeper, by part
    folders = {f.rsplit("/", n)[0] for f in featured.inputFiles() for n in (1, 2)}
    for folder in folders:
        if folder.rsplit("/", 1)[-1].startswith((_TABLE_PREFIX, cb.TABLE_PREFIX)):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
    featured.unpersist()


@contextmanager
def dashboard_tables(
    sessions: DataFrame, cols: Columns = DEFAULT_COLUMNS, labels: Labels = DEFAULT_LABELS, only: Sequence[str] | None = None
) -> Iterator[dict[str, DataFrame]]:
    """``dashboard`` whose stored tables are deleted when the block ends."""
    featured = materialize(add_text_features(validate(sessions, cols), cols))
    cube = None
    try:
        cube = cb.build_cube(featured, cols)
        yield _planned(featured, cube, cols, labels, only)
    finally:
        release(featured)
        if cube is not None:
            release(cube.table)


def _planned(
    featured: DataFrame, cube: cb.Cube | None, cols: Columns, labels: Labels, only: Sequence[str] | None
) -> dict[str, DataFrame]:
    quality = has_quality_columns(featured, cols)
    rolled = {} if cube is None else cb.rollups(labels, quality)
    return {
        name: rolled[name](cube) if name in rolled else fn(featured)
        for name, fn in analyses(cols, labels, quality).items()
        if only is None or name in only
    }


def analyses(
    cols: Columns = DEFAULT_COLUMNS, labels: Labels = DEFAULT_LABELS, quality: bool = True
) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Every analysis of the dashboard by name, as ``featured -> DataFrame``."""
    out: dict[str, Callable[[DataFrame], DataFrame]] = {
        # overview
        "kpi_overview": lambda d: kpis.kpi_overview(d, cols, labels),
        "preview": lambda d: pf.preview(d, cols=cols),
        "profile_shape": pf.profile_shape,
        "profile_types": pf.profile_types,
        "profile_missing": pf.profile_missing,
        # topics
        "topic_counts": lambda d: fq.topic_counts(d, cols),
        "topics_top15": lambda d: fq.topics_top(d, K.TOP_TOPICS_CHART, cols),
        "topics_top10_pct": lambda d: fq.topics_top_pct(d, K.TOP_TOPICS_TABLE, cols),
        "top_topic": lambda d: fq.top_topic(d, cols),
        "topic_summary": lambda d: gr.topic_summary(d, cols, labels),
        # resolution
        "kpi_status": lambda d: fq.kpi_status(d, cols),
        "status_counts": lambda d: fq.status_counts(d, cols),
        "xt_topic_status_top20": lambda d: xt.xt_topic_status_top(d, K.TOP_TOPICS_HEATMAP, cols),
        "resolution_rate_by_topic": lambda d: gr.resolution_rate_by_topic(d, K.TOP_RESOLUTION_RATE, cols, labels),
        # sentiment
        "kpi_sentiment": lambda d: fq.kpi_sentiment(d, cols, labels),
        "sentiment_counts": lambda d: fq.sentiment_counts(d, cols),
        "xt_status_sentiment": lambda d: xt.xt_status_sentiment(d, cols),
        "xt_topic_sentiment_top15": lambda d: xt.xt_topic_sentiment_top(d, K.TOP_TOPICS_SENTIMENT, cols),
        # text
        "text_stats": lambda d: tx.text_stats(d, cols),
        "hist_query_words": lambda d: tx.hist_query_words(d, cols),
        "hist_resolution_words": lambda d: tx.hist_resolution_words(d, cols),
        "avg_query_words_by_topic": lambda d: gr.avg_query_words_by_topic(d, K.TOP_AVG_QUERY_WORDS, cols),
        "avg_resolution_words_by_status": lambda d: gr.avg_resolution_words_by_status(d, cols),
        "top_keywords": lambda d: tx.top_keywords(d, top_n=K.KEYWORD_TOP_N, cols=cols),
        # export and insights
        "topic_summary_report": lambda d: gr.topic_summary_report(d, cols, labels),
        "xt_topic_status_margins": lambda d: xt.xt_topic_status_margins(d, cols),
        "xt_topic_sentiment_margins": lambda d: xt.xt_topic_sentiment_margins(d, cols),
        "key_insights": lambda d: kpis.key_insights(d, cols, labels),
    }
    if quality:
        out.update(
            {
                "kpi_quality": lambda d: kpis.kpi_quality(d, cols, labels),
                "intent_counts": lambda d: fq.intent_counts(d, cols),
                "spam_counts": lambda d: fq.spam_counts(d, cols),
                "xt_status_intent": lambda d: xt.xt_status_intent(d, cols),
                "xt_topic_intent_top10": lambda d: xt.xt_topic_intent_top(d, K.TOP_TOPICS_INTENT, cols),
                "xt_sentiment_spam": lambda d: xt.xt_sentiment_spam(d, cols),
                "xt_intent_spam": lambda d: xt.xt_intent_spam(d, cols),
                "accuracy_by_status": lambda d: gr.accuracy_by_status(d, cols, labels),
                "spam_by_sentiment": lambda d: gr.spam_by_sentiment(d, cols, labels),
            }
        )
    return out


def dashboard(
    sessions: DataFrame,
    cols: Columns = DEFAULT_COLUMNS,
    labels: Labels = DEFAULT_LABELS,
    materialize_how: str = "table",
    only: Sequence[str] | None = None,
    cube: bool = True,
) -> dict[str, DataFrame]:
    """Validates, featurises and materialises ``sessions`` once, counts it into
    a stored cube and plans every analysis on the two (P10: quality analyses
    only with both columns). ``cube=False`` plans each analysis on the table."""
    featured = materialize(add_text_features(validate(sessions, cols), cols), materialize_how)
    return _planned(featured, cb.build_cube(featured, cols) if cube else None, cols, labels, only)


def run_dashboard(
    spark: SparkSession,
    path: str | Sequence[str],
    fmt: str | None = None,
    cols: Columns = DEFAULT_COLUMNS,
    labels: Labels = DEFAULT_LABELS,
    materialize_how: str = "table",
) -> dict[str, DataFrame]:
    return dashboard(load_sessions(spark, path, fmt, cols), cols, labels, materialize_how)
