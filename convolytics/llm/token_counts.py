"""Exact token counts from a histogram of document lengths.

Documents are encoded whole and reduced at once to ``length -> documents``,
a table with one row per distinct length. Sums over that table answer, for
every context limit, the totals, the quantile and the tokens left if every
document is truncated to the limit.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from convolytics.llm.common import require_columns, staged, tidy
from convolytics.llm.tokens import WordCachedEncoder

# Lengths that share a range of this many are summed together first, so the
# only ordering without a partition key runs over ranges of lengths.
RANGE = 4096


def length_histogram(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """``tokens`` (a document's encoded length, no added tokens) and ``docs``
    (how many documents have it). Null texts count as empty, with length 0;
    repeated rows count each. Counts are summed in each task before the
    shuffle, so what moves is one row per task and distinct length."""
    require_columns(docs, [text_col])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = WordCachedEncoder(tokenizer)
        seen: Counter[int] = Counter()
        for batch in batches:
            seen.update(len(raw) // 4 for raw in enc.encode(x.as_py() or "" for x in batch.column(0)))
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["tokens", "docs"]
            )

    counts = docs.select(text_col).mapInArrow(tidy(count), "tokens long, docs long")
    return counts.groupBy("tokens").agg(F.sum("docs").alias("docs"))


def context_limits(histogram: DataFrame) -> DataFrame:
    """For every length that occurs, taken as a context limit, in one row:

    ``context_limit, docs`` (documents of exactly that length),
    ``docs_within`` and ``tokens_within`` (documents not longer, their
    tokens), ``docs_over`` and ``tokens_over`` (longer ones),
    ``truncated_tokens`` (tokens of all documents cut to the limit),
    ``quantile`` (share of documents not longer). Between two limits the
    answers for a limit follow from the rows around it; see ``at_limit``.
    An empty histogram gives no rows.
    """
    hist = histogram.select(F.col("tokens"), F.col("docs"), (F.col("tokens") * F.col("docs")).alias("n"))
    hist = hist.withColumn("range", F.floor(F.col("tokens") / RANGE))
    ranges = hist.groupBy("range").agg(F.sum("docs").alias("rd"), F.sum("n").alias("rn"))
    # one row per range of lengths: as many as the longest document / RANGE
    over = Window.orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = ranges.select(
        "range",
        F.coalesce(F.sum("rd").over(over), F.lit(0)).alias("above_docs"),
        F.coalesce(F.sum("rn").over(over), F.lit(0)).alias("above_n"),
        F.sum("rd").over(every).alias("all_docs"),
        F.sum("rn").over(every).alias("all_n"),
    )
    inside = Window.partitionBy("range").orderBy(F.col("tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    docs_over = F.coalesce(F.sum("docs").over(inside), F.lit(0)) + F.col("above_docs")
    tokens_over = F.coalesce(F.sum("n").over(inside), F.lit(0)) + F.col("above_n")
    both = hist.join(sums, "range").withColumns({"docs_over": docs_over, "tokens_over": tokens_over})
    return both.select(
        F.col("tokens").alias("context_limit"),
        "docs",
        (F.col("all_docs") - F.col("docs_over")).alias("docs_within"),
        (F.col("all_n") - F.col("tokens_over")).alias("tokens_within"),
        "docs_over",
        "tokens_over",
        (F.col("all_n") - F.col("tokens_over") + F.col("tokens") * F.col("docs_over")).alias("truncated_tokens"),
        ((F.col("all_docs") - F.col("docs_over")) / F.col("all_docs")).alias("quantile"),
    )


def at_limit(limits: DataFrame, limit: int) -> DataFrame:
    """The answers for any context limit, also one that no document has:
    ``context_limit, docs_within, docs_over, truncated_tokens``, one row."""
    kept = limits.agg(
        F.coalesce(F.max(F.when(F.col("context_limit") <= limit, F.col("docs_within"))), F.lit(0)).alias("docs_within"),
        F.coalesce(F.max(F.when(F.col("context_limit") <= limit, F.col("tokens_within"))), F.lit(0)).alias("t"),
        F.coalesce(F.max(F.col("docs_within")), F.lit(0)).alias("all_docs"),
    )
    over = F.col("all_docs") - F.col("docs_within")
    return kept.select(
        F.lit(limit).cast("long").alias("context_limit"),
        "docs_within",
        over.alias("docs_over"),
        (F.col("t") + over * limit).alias("truncated_tokens"),
    )


def token_counts(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """``context_limits`` of all documents; the histogram is stored once, so
    the texts are encoded once."""
    return context_limits(staged(length_histogram(docs, tokenizer, text_col), "lengths"))
