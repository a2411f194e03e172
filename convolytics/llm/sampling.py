"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def per_label(rows: DataFrame, label: str, key: list[str], n: int, seed: int, max_labels: int = 10_000) -> DataFrame:
    """At most ``n`` distinct rows of each non-null label, those with the
    smallest hash of the columns ``key``: a uniform sample that depends on
    the rows alone. The labels are counted first, so only little more than
    ``n`` rows of a label go on to be ranked, however many there are."""
    rows = rows.filter(F.col(label).isNotNull())
    counts = rows.groupBy(label).count().limit(max_labels + 1).collect()
    if len(counts) > max_labels:
        raise ValueError(f"more than {max_labels} labels")
    # a tenth and five standard deviations more than n, then exactly n by rank
    most = 1 << 30
    bounds = [F.lit(v) for r in counts for v in (r[label], min(most, int(most * (1.1 * n + 5 * n**0.5) / r["count"])))]
    bound = F.create_map(*bounds)[F.col(label)] if bounds else F.lit(0)
    hashed = rows.withColumn("_h", F.xxhash64(F.lit(seed), *key))
    few = hashed.filter(F.shiftrightunsigned("_h", 34) < bound).distinct()
    ranked = few.withColumn("_rank", F.row_number().over(Window.partitionBy(label).orderBy("_h", *key)))
    return ranked.filter(F.col("_rank") <= n).drop("_h", "_rank")


def labelled_texts(
    docs: DataFrame, labels: DataFrame, label: str, allowed: Column, n: int, seed: int, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, text, label`` of at most ``n`` documents per label (0 or 1).

    The sample is drawn from the narrow label table (``allowed`` filters its
    ids) and its few rows are broadcast: at most ``2 n`` pairs of numbers, so
    no text is shuffled to be dropped. An id with several labels counts by
    its largest, one with several texts by its smallest; null ids, labels
    and texts without a label take no part.
    """
    pairs = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), (F.col(label) > 0).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & allowed)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    chosen = per_label(pairs, "label", ["doc_id"], n, seed)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return (
        texts.join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "label")
        .agg(F.min("text").alias("text"))
        .select("doc_id", "text", "label")
    )
