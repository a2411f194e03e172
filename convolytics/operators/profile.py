"""Data-quality profile."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType, StructType, TimestampType

from convolytics.functions.numeric import round2, share
from convolytics.schema import Columns, DEFAULT_COLUMNS


def _is_missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN for floating columns (both read as missing)."""
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (DoubleType, FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def _missing_in_row(df: DataFrame) -> Column:
    terms = [F.when(_is_missing(df, n), F.lit(1)).otherwise(F.lit(0)) for n in df.columns]
    return reduce(lambda a, b: a + b, terms, F.lit(0)).cast("bigint")


def _encoded(df: DataFrame, name: str) -> Column:
    """One value as text that no other value shares: a null mark, or the
    length of its text and the text. Floats count -0.0 as 0.0 and every NaN
    alike, the equality ``groupBy`` uses; nested values go through JSON."""
    c, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(kind, (DoubleType, FloatType)):
        # adding zero turns -0.0 into 0.0
        text = F.when(F.isnan(c), F.lit("NaN")).otherwise((c + F.lit(0.0).cast(kind)).cast("string"))
    elif isinstance(kind, TimestampType):
        text = F.unix_micros(c).cast("string")
    elif isinstance(kind, BinaryType):
        text = F.hex(c)
    elif isinstance(kind, (ArrayType, StructType)):
        text = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
    else:
        text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text))


def row_digest(df: DataFrame) -> Column:
    """SHA-256 of the whole row in an unambiguous encoding: equal rows (null
    equal to null) have equal digests, others in practice never."""
    return F.unhex(F.sha2(F.concat(*[_encoded(df, n) for n in df.columns]), 256))


def profile_shape(df: DataFrame, duplicates: bool = True) -> DataFrame:
    """D1-D3 in one row: ``row_count``, ``column_count``, ``missing_cells`` and
    ``duplicate_rows`` (rows equal to an earlier row in every column, null
    equal to null).

    One scan and one aggregate by the row's 32-byte digest, combined in each
    task before the shuffle: a hot group of copies costs one small row per
    task, and no row crosses the shuffle whole. The plan is the same at every
    size."""
    n_cols = F.lit(len(df.columns)).cast("bigint").alias("column_count")
    missing = _missing_in_row(df)
    if not duplicates:
        return df.agg(
            F.count(F.lit(1)).alias("row_count"),
            n_cols,
            F.coalesce(F.sum(missing), F.lit(0)).cast("bigint").alias("missing_cells"),
        )
    rows = df.select(row_digest(df).alias("_row"), missing.alias("_missing"))
    groups = rows.groupBy("_row").agg(F.count(F.lit(1)).alias("_copies"), F.sum("_missing").alias("_missing"))
    return groups.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).cast("bigint").alias("row_count"),
        n_cols,
        F.coalesce(F.sum("_missing"), F.lit(0)).cast("bigint").alias("missing_cells"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"),
    )


def profile_shape_filtered(df: DataFrame, block_bits: int = 16) -> DataFrame:
    """``profile_shape`` for tables of mostly distinct rows, with little
    shuffle: two passes over the rows.

    The first sends of every row only a 32-bit place in one of 65,536 blocks
    (``2 ** block_bits``), gathered to arrays by block before they move: four
    bytes a row, and some for each block and task. A row whose
    place no other row has is no duplicate, so the second pass compares the
    digests of the rest alone; on a table of distinct rows that is next to none.
    The table of shared places is joined as Spark finds fit for its size."""
    digest = row_digest(df)
    place = F.xxhash64(digest)
    block = F.shiftrightunsigned(place, 64 - block_bits).cast("int").alias("_block")
    slot = F.shiftright(F.shiftleft(place, block_bits), 32).cast("int").alias("_slot")
    rows = df.select(digest.alias("_row"), block, slot, _missing_in_row(df).alias("_missing"))
    blocks = rows.groupBy("_block").agg(F.collect_list("_slot").alias("_slots"), F.sum("_missing").alias("_missing"))
    totals = blocks.agg(
        F.coalesce(F.sum(F.size("_slots")), F.lit(0)).cast("bigint").alias("row_count"),
        F.coalesce(F.sum("_missing"), F.lit(0)).cast("bigint").alias("missing_cells"),
    )
    # equal places lie in one block, so no row moves again to be counted
    each = blocks.select("_block", F.explode("_slots").alias("_slot"))
    shared = each.groupBy("_block", "_slot").count().filter("count > 1").select("_block", "_slot")
    suspects = rows.join(shared, ["_block", "_slot"], "left_semi").groupBy("_row").agg(F.count(F.lit(1)).alias("_copies"))
    extra = suspects.agg(F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).cast("bigint").alias("n")).select("n").scalar()
    return totals.select(
        "row_count", F.lit(len(df.columns)).cast("bigint").alias("column_count"), "missing_cells", extra.alias("duplicate_rows")
    )


def profile_types(df: DataFrame) -> DataFrame:
    """``position, column_name, data_type, non_null_count`` in column
    order: the column types and, from one aggregate pass over the table, how
    many values each column holds (NaN counts as missing)."""
    names = df.columns
    agg = df.agg(*[F.count(F.when(~_is_missing(df, n), F.lit(1))).alias(f"_c{i}") for i, n in enumerate(names)])
    cells = F.array(
        *[
            F.struct(
                F.lit(i + 1).cast("bigint").alias("position"),
                F.lit(n).alias("column_name"),
                F.lit(t).alias("data_type"),
                F.col(f"_c{i}").alias("non_null_count"),
            )
            for i, (n, t) in enumerate(df.dtypes)
        ]
    )
    return agg.select(F.inline(cells)).orderBy("position")


def profile_missing(df: DataFrame) -> DataFrame:
    """Per column with at least one missing value, ``missing_count`` and
    ``missing_pct`` (over all rows, rounded to 2), in column order.

    One aggregate pass counts every column; the one-row result is unpivoted
    with ``inline`` and filtered (the HAVING of P5)."""
    names = df.columns
    agg = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(F.when(_is_missing(df, n), F.lit(1))).alias(f"_m{i}") for i, n in enumerate(names)],
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(i + 1).cast("bigint").alias("position"),
                F.lit(n).alias("column_name"),
                F.col(f"_m{i}").alias("missing_count"),
            )
            for i, n in enumerate(names)
        ]
    )
    out = agg.select("_rows", F.inline(cells)).filter(F.col("missing_count") > 0)
    return out.select(
        "position",
        "column_name",
        "missing_count",
        round2(share(F.col("missing_count"), F.col("_rows"))).alias("missing_pct"),
    ).orderBy("position")


def preview(
    df: DataFrame,
    n: int = 10,
    order_by: Sequence[str] | None = None,
    cols: Columns = DEFAULT_COLUMNS,
    derive: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The first ``n`` rows without the ``suggestion`` column.

    Spark tables have no file order, so "first" needs a key: by default every
    remaining column ascending, nulls first, which is a total order up to
    identical rows. Plans as ``TakeOrderedAndProject`` (a top-n per partition).

    ``derive`` adds columns after the top-n, so they are computed for ``n``
    rows instead of the whole table. Pass it only for columns that are
    functions of the ordered ones (the text features of the query and
    resolution): rows tied on the ordered columns then agree on the derived
    ones too, so the result equals ordering the derived table.
    """
    shown = df.drop(cols.suggestion)
    keys = list(order_by) if order_by else shown.columns
    top = shown.orderBy(*[F.col(f"`{k}`").asc_nulls_first() for k in keys]).limit(n)
    return derive(top) if derive is not None else top
