"""Cross-tabulations (C1-C9) and the top-k restriction.

Rules: only rows where both keys are non-null count; rows and columns are in
ascending order; absent pairs are 0. The wide form needs the list of column
labels at plan time. When the caller does not pass it, it is read with a
bounded distinct (the same thing ``pivot`` does without values), and more
than ``spark.sql.pivotMaxValues`` labels is an error, never a silent cut.

The wide form is one aggregate: a count per label under the row key, combined
in each task before the shuffle, so a hot key costs one row per task. ``m`` says
whether the input is one row per conversation or the cells of a cube. Inside,
columns go by position and take their labels once, at the end, so any text
may be a label. Nothing is kept between calls.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from convolytics import constants as K
from convolytics.functions.measures import Measures, PER_ROW
from convolytics.schema import Columns, DEFAULT_COLUMNS


class CrosstabError(ValueError):
    pass


def _name(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def both_non_null(df: DataFrame, row: str, col: str) -> DataFrame:
    return df.filter(_name(row).isNotNull() & _name(col).isNotNull())


def pivot_values(df: DataFrame, col: str, max_values: int | None = None) -> list:
    """Sorted distinct non-null values of ``col``, checked against a bound.

    The distinct is partially aggregated before its shuffle, so only the
    distinct labels of each partition move; at most ``max_values + 1`` of
    them reach the driver.
    """
    if max_values is None:
        max_values = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues", "10000"))
    labels = df.filter(_name(col).isNotNull()).select(_name(col).alias("label")).distinct()
    rows = labels.orderBy("label").limit(max_values + 1).collect()
    if len(rows) > max_values:
        raise CrosstabError(
            f"Column {col!r} has more than {max_values} distinct values; pass `values` "
            "or use crosstab_long()"
        )
    return [r[0] for r in rows]


def _counts(col: str, values: Sequence, m: Measures) -> list[Column]:
    """A count per label, named by position."""
    return [m.rows(_name(col) == F.lit(v)).alias(f"_c{i}") for i, v in enumerate(values)]


def _not_the_margin(key: Column, column: str, margin_label: str) -> Column:
    """The key as text; fails at run time on a real key that reads like the
    totals' label."""
    message = F.lit(f"Column {column!r} holds the value {margin_label!r}, which names the totals")
    return F.when(key.cast("string") == margin_label, F.raise_error(message)).otherwise(key.cast("string"))


def crosstab(
    df: DataFrame,
    row: str,
    col: str,
    values: Sequence | None = None,
    margins: bool = False,
    margin_label: str = K.MARGIN_LABEL,
    m: Measures = PER_ROW,
) -> DataFrame:
    """C1/C3/C5/C6 (and C8/C9 with ``margins=True``): wide cross-tab of pair
    counts, one row per ``row`` value, ascending.

    With margins, a ``margin_label`` column holds the row totals and a last
    ``margin_label`` row the column totals (grand total in the corner); both
    only count rows where the two keys are non-null. The totals row sums the
    aggregated table. A real key equal to ``margin_label`` would be mistaken
    for a total and is refused: at plan time for column labels, at run time
    for row keys.
    """
    if values is None:
        values = pivot_values(df.filter(_name(row).isNotNull()), col)
    names = [str(v) for v in values]
    wide = both_non_null(df, row, col).groupBy(_name(row).alias("_row")).agg(m.rows().alias("_n"), *_counts(col, values, m))
    cells = [f"_c{i}" for i in range(len(names))]
    if not margins:
        return wide.orderBy("_row").select("_row", *cells).toDF(row, *names)

    if margin_label in names:
        raise CrosstabError(f"Column {col!r} holds the value {margin_label!r}, which names the totals")
    total = reduce(lambda a, b: a + b, [F.col(c) for c in cells], F.lit(0).cast("bigint"))
    body = wide.select(
        _not_the_margin(F.col("_row"), row, margin_label).alias("_row"), *cells, total.alias("_all"), F.lit(0).alias("_last")
    )
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in [*cells, "_all"]]
    totals = body.agg(*sums).select(F.lit(margin_label).alias("_row"), *cells, "_all", F.lit(1).alias("_last"))
    both = body.unionByName(totals).orderBy("_last", "_row")
    return both.select("_row", *cells, "_all").toDF(row, *names, margin_label)


def crosstab_long(
    df: DataFrame, row: str, col: str, margins: bool = False, margin_label: str = K.MARGIN_LABEL, m: Measures = PER_ROW
) -> DataFrame:
    """Long form ``row, col, n``: only pairs that occur (zeros are implied).
    With margins, ``cube`` adds the per-row, per-column and grand totals,
    labelled ``margin_label``; a real key that reads the same is refused at
    run time."""
    by = {"_row": _name(row), "_col": _name(col)}
    pairs = both_non_null(df, row, col).withColumns(by)
    if not margins:
        return pairs.groupBy("_row", "_col").agg(m.rows().alias("n")).orderBy("_row", "_col").toDF(row, col, "n")
    cubed = pairs.cube("_row", "_col").agg(
        m.rows().alias("n"),
        F.grouping("_row").alias("_gr"),
        F.grouping("_col").alias("_gc"),
    )
    label = F.lit(margin_label)
    named = cubed.select(
        F.when(F.col("_gr") == 1, label).otherwise(_not_the_margin(F.col("_row"), row, margin_label)).alias("_row"),
        F.when(F.col("_gc") == 1, label).otherwise(_not_the_margin(F.col("_col"), col, margin_label)).alias("_col"),
        "n",
        "_gr",
        "_gc",
    )
    return named.orderBy("_gr", "_row", "_gc", "_col").select("_row", "_col", "n").toDF(row, col, "n")


def crosstab_top(
    df: DataFrame, row: str, col: str, k: int, values: Sequence | None = None, m: Measures = PER_ROW
) -> DataFrame:
    """J1 + C2/C4/C7: the cross-tab restricted to the ``k`` most frequent
    ``row`` keys, in frequency order (``rank`` 1..k).

    The top keys come first, from a count per key alone (null partners
    included); they are ``k`` rows, ranked in an array, and filter the table
    below the pair counts, so only ``k`` keys ever carry a counter per label.
    A top key whose partner values are all null has a row of zeros. Column
    labels come from the whole table, so a label seen only outside the top-k
    keeps its (zero) column.
    """
    if values is None:
        values = pivot_values(df.filter(_name(row).isNotNull()), col)
    keyed = df.filter(_name(row).isNotNull()).withColumn("_row", _name(row))
    top = keyed.groupBy("_row").agg(m.rows().alias("_n")).orderBy(F.col("_n").desc(), F.col("_row").asc()).limit(k)
    packed = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("_n")).alias("_n"), "_row"))).alias("_top"))
    ranked = packed.select(F.posexplode("_top").alias("_at", "_key")).select((F.col("_at") + 1).cast("bigint").alias("_rank"), "_key._row")
    counted = keyed.join(F.broadcast(ranked), "_row").groupBy("_rank", "_row").agg(m.rows().alias("_n"), *_counts(col, values, m))
    cells = [f"_c{i}" for i in range(len(values))]
    return counted.orderBy("_rank").select("_rank", "_row", *cells).toDF("rank", row, *[str(v) for v in values])


# --- the dashboard's cross-tabs ---------------------------------------------


def xt_status_sentiment(df: DataFrame, cols: Columns = DEFAULT_COLUMNS, m: Measures = PER_ROW) -> DataFrame:
    return crosstab(df, cols.status, cols.sentiment, m=m)


def xt_status_intent(df: DataFrame, cols: Columns = DEFAULT_COLUMNS, m: Measures = PER_ROW) -> DataFrame:
    return crosstab(df, cols.status, cols.intent, m=m)


def xt_sentiment_spam(df: DataFrame, cols: Columns = DEFAULT_COLUMNS, m: Measures = PER_ROW) -> DataFrame:
    return crosstab(df, cols.sentiment, cols.spam, m=m)


def xt_intent_spam(df: DataFrame, cols: Columns = DEFAULT_COLUMNS, m: Measures = PER_ROW) -> DataFrame:
    return crosstab(df, cols.intent, cols.spam, m=m)


def xt_topic_status_top(df: DataFrame, k: int = K.TOP_TOPICS_HEATMAP, cols: Columns = DEFAULT_COLUMNS, m: Measures = PER_ROW) -> DataFrame:
    return crosstab_top(df, cols.topic, cols.status, k, m=m)


def xt_topic_intent_top(df: DataFrame, k: int = K.TOP_TOPICS_INTENT, cols: Columns = DEFAULT_COLUMNS, m: Measures = PER_ROW) -> DataFrame:
    return crosstab_top(df, cols.topic, cols.intent, k, m=m)


def xt_topic_sentiment_top(df: DataFrame, k: int = K.TOP_TOPICS_SENTIMENT, cols: Columns = DEFAULT_COLUMNS, m: Measures = PER_ROW) -> DataFrame:
    return crosstab_top(df, cols.topic, cols.sentiment, k, m=m)


def xt_topic_status_margins(df: DataFrame, cols: Columns = DEFAULT_COLUMNS, m: Measures = PER_ROW) -> DataFrame:
    return crosstab(df, cols.topic, cols.status, margins=True, m=m)


def xt_topic_sentiment_margins(df: DataFrame, cols: Columns = DEFAULT_COLUMNS, m: Measures = PER_ROW) -> DataFrame:
    return crosstab(df, cols.topic, cols.sentiment, margins=True, m=m)
