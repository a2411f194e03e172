"""Loading the session table.

CSV is read in two steps so that columns are always matched by name:

1. the header record of the input (``header=False``, first record only; a
   bounded ``limit(1)``) gives the exact column names, in file order and case;
2. every file is read with a schema of those names (all strings, no type
   inference) plus ``_corrupt_record``, with ``enforceSchema=False`` so Spark
   checks each file's header against the names and fails on a file whose
   header differs (another order, a missing column).

Rows with too few fields are kept (missing fields are null); a row with more
fields than the header fails the job, as the dashboard's reader does. The
dashboard's reader also turns a fixed list of tokens (``NA``, ``null``, ...)
into missing values; Spark's ``nullValue`` takes one token, so the rest are
mapped right after the scan.

Spark's reader takes one task for a multi-line file. ``split=True`` reads
large files by byte ranges instead (``sources.csv_split``), quoted newlines
included, with the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from convolytics import constants as K
from convolytics.schema import Columns, DEFAULT_COLUMNS, SchemaError, check_unique_names, validate_names

CORRUPT = "_corrupt_record"
CSV_OPTIONS = {"multiLine": "true", "quote": '"', "escape": '"', "encoding": "UTF-8"}
SAMPLE_PATH = "data.csv"


class UnsupportedFormatError(ValueError):
    pass


def _paths(path: str | Sequence[str]) -> list[str]:
    return [path] if isinstance(path, str) else list(path)


def read_csv_header(spark: SparkSession, path: str | Sequence[str]) -> list[str]:
    """The header names of the input, exactly as written (a byte-order mark
    is dropped). Reads one record."""
    rows = spark.read.options(header="false", **CSV_OPTIONS).csv(_paths(path)).limit(1).collect()
    if not rows:
        raise SchemaError("The file is empty: no header row")
    names = list(rows[0])
    for i, n in enumerate(names):
        if n is None or n == "":
            raise SchemaError(f"Header field {i + 1} is empty")
    check_unique_names(names)
    return names


def normalize_null_tokens(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text equal to one of the reader's missing-value tokens becomes null
    (exact match, no trimming). String columns only."""
    targets = set(columns) if columns is not None else {f.name for f in df.schema if isinstance(f.dataType, StringType)}
    tokens = list(K.NULL_TOKENS)
    return df.select(
        *[
            F.when(~F.col(f"`{n}`").isin(tokens), F.col(f"`{n}`")).alias(n) if n in targets else F.col(f"`{n}`")
            for n in df.columns
        ]
    )


def _field_count(raw: F.Column) -> F.Column:
    """Fields in one raw CSV record: separators outside quoted fields + 1."""
    # possessive: no recursion, whatever the length; a doubled quote is two
    # quoted runs side by side
    unquoted = F.regexp_replace(raw, F.lit('"[^"]*+"'), F.lit(""))
    return F.length(unquoted) - F.length(F.regexp_replace(unquoted, F.lit(","), F.lit(""))) + 1


def read_csv(spark: SparkSession, path: str | Sequence[str], names: Sequence[str] | None = None, split: bool = False) -> DataFrame:
    """CSV file(s) with a header row to a table of nullable strings,
    columns matched by name, null tokens normalised (S4). With ``split`` many
    tasks read one file."""
    names = list(names) if names is not None else read_csv_header(spark, path)
    if split:
        return _read_split(spark, path, names)
    raw = spark.read.schema(csv_schema(names)).options(**csv_reader_options()).csv(_paths(path))
    return normalize_null_tokens(guard_long_rows(raw, names), names)


def _read_split(spark: SparkSession, path: str | Sequence[str], names: Sequence[str]) -> DataFrame:
    from convolytics.sources.csv_split import header_of, split_records

    records = split_records(spark, _paths(path))
    options = {k: v for k, v in CSV_OPTIONS.items() if k != "encoding"}
    schema = ", ".join(f"`c{i}` string" for i in range(len(names)))
    fields = F.from_csv(F.col("record"), F.lit(schema), options)
    for r in header_of(records).select(_field_count(F.col("record")).alias("n"), fields.alias("r")).limit(2).collect():
        if r["n"] != len(names) or list(r["r"]) != list(names):
            raise SchemaError(f"CSV header does not conform to the columns {', '.join(names)}: found {', '.join(map(str, r['r']))}")
    message = F.concat(F.lit(f"CSV row has more than {len(names)} fields: "), F.col("record"))
    checked = F.when(_field_count(F.col("record")) > len(names), F.raise_error(message)).otherwise(F.lit(True))
    rows = records.filter(~F.col("first")).filter(checked).select(fields.alias("r"))
    return normalize_null_tokens(rows.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)]), names)


def parse_records(records: DataFrame, names: Sequence[str], column: str = "record") -> DataFrame:
    """S1 + S4 for records already in a column: all-text columns ``names``,
    null tokens normalised."""
    schema = ", ".join(f"`{n}` string" for n in names)
    options = {k: v for k, v in CSV_OPTIONS.items() if k != "encoding"}
    parsed = records.select(F.from_csv(F.col(column), F.lit(schema), {**options, "mode": "FAILFAST"}).alias("_r")).select("_r.*")
    return normalize_null_tokens(parsed, names)


def csv_schema(names: Sequence[str]) -> StructType:
    """All-string schema of the header names plus the corrupt-record column."""
    return StructType([StructField(n, StringType(), True) for n in names] + [StructField(CORRUPT, StringType(), True)])


def csv_reader_options() -> dict[str, str]:
    return dict(header="true", enforceSchema="false", mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, **CSV_OPTIONS)


def guard_long_rows(raw: DataFrame, names: Sequence[str]) -> DataFrame:
    """Fails the job on a row with more fields than the header; drops the
    corrupt-record column."""
    too_long = F.col(CORRUPT).isNotNull() & (_field_count(F.col(CORRUPT)) > len(names))
    # The guard stays in every plan built on this table (a filter is never
    # pruned). It also names a data column: Spark refuses scans that read
    # only the corrupt-record column (for example a bare count()).
    message = F.concat(
        F.lit(f"CSV row has more than {len(names)} fields (first field "),
        F.coalesce(F.col(f"`{names[0]}`"), F.lit("")),
        F.lit("): "),
        F.col(CORRUPT),
    )
    return raw.filter(F.when(too_long, F.raise_error(message)).otherwise(F.lit(True))).drop(CORRUPT)


def read_parquet(spark: SparkSession, path: str | Sequence[str], cols: Columns = DEFAULT_COLUMNS) -> DataFrame:
    """Parquet input: stored schema, contract columns cast to string."""
    df = spark.read.parquet(*_paths(path))
    contract = set(cols.required) | {cols.intent, cols.spam, cols.suggestion}
    return df.select(
        *[F.col(f"`{n}`").cast("string").alias(n) if n in contract else F.col(f"`{n}`") for n in df.columns]
    )


def detect_format(path: str) -> str:
    """By file suffix, case-sensitive, as the dashboard does."""
    if path.endswith(".csv"):
        return "csv"
    if path.endswith(".xlsx"):
        return "xlsx"
    if path.endswith(".xls"):
        raise UnsupportedFormatError("Legacy .xls workbooks are not supported; save as .xlsx or CSV")
    if path.endswith(".parquet"):
        return "parquet"
    raise UnsupportedFormatError(f"Cannot tell the format of {path!r}: expected a .csv, .xlsx or .parquet suffix")


def load_sessions(
    spark: SparkSession,
    path: str | Sequence[str],
    fmt: str | None = None,
    cols: Columns = DEFAULT_COLUMNS,
    split: bool = False,
) -> DataFrame:
    """Read a session table and check its required columns.
    ``split`` reads large CSV files by many tasks.

    ``fmt`` is ``csv``, ``xlsx`` or ``parquet``; by default it comes from the
    suffix of the (first) path. Missing required columns raise
    ``SchemaError`` naming them (S6); read errors surface as Spark raises
    them (S8). Extra columns are kept.
    """
    fmt = fmt or detect_format(_paths(path)[0])
    if fmt == "csv":
        names = read_csv_header(spark, path)
        validate_names(names, cols)
        return read_csv(spark, path, names, split)
    if fmt == "xlsx":
        from convolytics.sources.excel import read_xlsx

        df = read_xlsx(spark, path)
        validate_names(df.columns, cols)
        return df
    if fmt == "parquet":
        df = read_parquet(spark, path, cols)
        validate_names(df.columns, cols)
        return df
    raise UnsupportedFormatError(f"Unsupported format {fmt!r}")


def load_sample(spark: SparkSession, path: str = SAMPLE_PATH, cols: Columns = DEFAULT_COLUMNS) -> DataFrame:
    """The bundled sample file. Unlike the dashboard, it is validated too."""
    return load_sessions(spark, path, "csv", cols)
