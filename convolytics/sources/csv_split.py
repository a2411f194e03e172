"""S1 for large files: multi-line CSV read by many tasks.

A newline ends a CSV record only outside quotes, so a byte range does not know
where its first record starts until everything before it is known. The lines
of all ranges are read twice. The first pass follows every range from both
possible states at its start (between records, or inside a quoted field) and
reports, for each, the state at its end, and its unfinished ends: the text up
to the end of a record it did not start, and the text of a record it does not
finish. These few rows per range are put in order and the true states follow:
a range's effect on the state is constant, or keeps or flips it, so the state
is the last constant effect before it, flipped as often as flips came since.
The second pass emits the records that lie whole in one range; those that
cross ranges are put together from the reported ends.

Nothing but one small row per range meets in one task (by file), and a crossing
record meets in the task that owns it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from convolytics.session import stored_rows, workers_see_library

_QUOTE, _COMMA = '"', ","


def stays_open(line: str, is_open: bool) -> bool:
    """Whether a quoted field is open at the end of ``line``, which starts
    inside one (``is_open``) or a record. A quote opens a field only at its
    start; inside, a doubled quote is a quote; what follows a closing quote is
    text up to the next comma."""
    at, n = 0, len(line)
    while True:
        if is_open:
            at = line.find(_QUOTE, at)
            if at < 0:
                return True
            if at + 1 < n and line[at + 1] == _QUOTE:
                at += 2
                continue
            is_open = False
        elif line.startswith(_QUOTE, at):
            is_open = True
            at += 1
            continue
        at = line.find(_COMMA, at)
        if at < 0:
            return False
        at += 1


def _after(line: str, is_open: bool) -> bool:
    return stays_open(line, is_open) if _QUOTE in line else is_open


class _Walk:
    """One range followed from one state at its start."""

    def __init__(self, is_open: bool):
        self.start = self.open = is_open
        self.lead: list[str] | None = [] if is_open else None  # of a record that began before
        self.held: list[str] = []
        self.starts = False  # whether a record starts here
        self.ended = False  # whether one also ended here, other than a blank line

    def line(self, text: str) -> str | None:
        """The record that ends with this line, if it also starts here and is
        no blank line."""
        inside, self.open = self.open, _after(text, self.open)
        if inside and not self.starts:
            self.lead.append(text)
            return None
        self.starts = True
        self.held.append(text)
        if self.open:
            return None
        record, self.held = "\n".join(self.held).removesuffix("\r"), []
        self.ended |= record != ""
        return record or None


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``file, block, pos, line``: the lines of every byte range."""
    text = spark.read.option("lineSep", "\n").text(list(paths))
    meta = F.col("_metadata")
    return text.select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line")
    )


def _ranges(batches: Iterable[pa.RecordBatch], columns: int) -> Iterator[tuple[tuple, str | None]]:
    """``(file, block, ...), line`` in order, and a None line after the last
    of each range."""
    now = None
    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in range(columns)))
        for key, line in zip(keys, batch.column(batch.num_columns - 1).to_pylist()):
            if now is not None and key[:2] != now[:2]:
                yield now, None
            now = key
            yield key, line
    if now is not None:
        yield now, None


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each range: its ends under both states at its start."""
    names = ["file", "block", "end0", "end1", "starts1", "ended0", "lead1", "tail0", "tail1"]
    walks = None
    for key, line in _ranges(batches, 2):
        if walks is None:
            walks = _Walk(False), _Walk(True)
        if line is not None:
            for w in walks:
                w.line(line)
            continue
        zero, one = walks
        row = (*key, zero.open, one.open, one.starts, zero.ended, "\n".join(one.lead), *("\n".join(w.held) if w.held else None for w in walks))
        walks = None
        kinds = (pa.string(), pa.int64(), *[pa.bool_()] * 4, *[pa.string()] * 3)
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)


_REPORT = "file string, block long, end0 boolean, end1 boolean, starts1 boolean, ended0 boolean, lead1 string, tail0 string, tail1 string"


def _with_states(report: DataFrame) -> DataFrame:
    """Adds ``open`` (the true state at a range's start) and ``owner`` (the
    range in which the record open at its start began). One narrow row for
    each range passes through the window of its file."""
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    flips = ((F.col("end0") == F.lit(True)) & (F.col("end1") == F.lit(False))).cast("int")
    fixed = F.when(F.col("end0") == F.col("end1"), F.col("end0").cast("int"))
    narrow = report.select("file", "block", "starts1", flips.alias("flip"), fixed.alias("fixed"))
    counted = narrow.withColumn("flips", F.sum("flip").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    anchor = F.when(F.col("fixed").isNotNull(), F.struct("fixed", "flips"))
    known = counted.withColumns(
        {"anchor": F.last(anchor, ignorenulls=True).over(before), "upto": F.coalesce(F.sum("flip").over(before), F.lit(0))}
    )
    since = F.col("upto") - F.coalesce("anchor.flips", F.lit(0))
    states = known.withColumn("open", (F.coalesce("anchor.fixed", F.lit(0)) + since) % 2 == 1)
    starts = F.when(~F.col("open") | F.col("starts1"), F.col("block"))
    return states.select("file", "block", "open", F.last(starts, ignorenulls=True).over(before).alias("owner"))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records that start and end in one range, and whether they are the
    first of a file."""

    def batch(out: list[tuple[str, bool]]) -> pa.RecordBatch:
        records, first = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(records, pa.string()), pa.array(first, pa.bool_())], names=["record", "first"])

    walk, out = None, []
    for key, line in _ranges(batches, 3):
        if line is None:
            walk = None
            continue
        if walk is None:
            walk = _Walk(key[2])
        ended = walk.ended
        record = walk.line(line)
        if record is not None:
            out.append((record, key[1] == 0 and not ended))
            if len(out) >= 4096:
                yield batch(out)
                out = []
    if out:
        yield batch(out)


def split_records(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``record, first``: every record of the files as its raw text without
    its line end, blank lines left out, and whether it is the first of its
    file. Line ends inside quotes are kept as written. Lines end in ``\\n`` or ``\\r\\n``; a quote left open ends with its
    file. Records come in no order."""
    workers_see_library(spark)
    lines = _lines(spark, paths)
    in_order = ["file", "block", "pos"]
    # the scan delivers each range in order; the sort makes it certain
    report = stored_rows(lines.sortWithinPartitions(*in_order).select("file", "block", "line").mapInArrow(_report, _REPORT), "csv-ranges")
    states = _with_states(report)
    known = lines.join(states.select("file", "block", "open"), ["file", "block"]).sortWithinPartitions(*in_order)
    whole = known.select("file", "block", "open", "line").mapInArrow(_whole, "record string, first boolean")

    # the ends of crossing records: a lead belongs to its owner, a tail to its own range
    ranges = report.join(states.drop("starts1"), ["file", "block"])
    lead = ranges.filter("open").select("file", F.col("owner").alias("at"), "block", F.lit(0).alias("part"), F.col("lead1").alias("text"), F.lit(False).alias("first"))
    tail_text = F.when(F.col("open"), F.col("tail1")).otherwise(F.col("tail0"))
    opens_file = (F.col("block") == 0) & ~F.col("ended0")
    tail = ranges.select("file", F.col("block").alias("at"), "block", F.lit(1).alias("part"), tail_text.alias("text"), opens_file.alias("first"))
    ends = lead.unionByName(tail.filter("text is not null")).groupBy("file", "at")
    crossing = ends.agg(F.sort_array(F.collect_list(F.struct("block", "part", "text"))).alias("ends"), F.max("first").alias("first"))
    joined = F.regexp_replace(F.array_join(F.transform("ends", lambda e: e["text"]), "\n"), "\r\\z", "")
    return whole.unionByName(crossing.select(joined.alias("record"), "first")).filter("record <> ''")


def header_of(records: DataFrame) -> DataFrame:
    """The distinct first records of the files, without a byte-order mark."""
    return records.filter("first").select(F.regexp_replace("record", "\\A\ufeff", "").alias("record")).distinct()
