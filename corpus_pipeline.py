"""Raw documents to packed training sequences, as five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes it as Parquet in the shared folder and reads it back as the next
stage's documents. All but the last keep the columns of ``docs``, whatever
they are: the whole row travels as one struct, so no name can clash.

Rows with a null text are rejected by the first stage (they have no
language). Repeated rows pass or fail alike until the fourth, where one
document of each group of near-duplicates stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from convolytics.llm import decontamination, jaccard, langid, packing, toxicity
from convolytics.llm.common import crc_mod, read_table, staged
from convolytics.llm.queries import TOKENIZER

# below a third, no language holds the text
LEAST_LANGUAGE_SCORE = 0.34
TOXIC_SCORE = 0.3


def _with_row(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the whole row as ``row``, whose ``text`` the operators
    read there, so it goes to Python and back once."""
    return docs.select("doc_id", F.struct("*").alias("row"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no letters, or no language that is
    clearly the likeliest."""
    model = langid.fit(docs, allowed=crc_mod(F.col("doc_id"), 3) != 1)
    found = langid.predict(_with_row(docs), model, keep=["row"], text_col="row.text")
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("row.*")


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the labelled examples nearest to them call toxic."""
    labels = read_table(spark, sf_dir, "labels")
    scored = toxicity.score(_with_row(docs), labels, allowed=crc_mod(F.col("doc_id"), 4) != 2, text_col="row.text", keep=["row"], store=False)
    return scored.filter(F.col("score") < TOXIC_SCORE).select("row.*")


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates (shingles of five
    words, similarity of 0.8 or more): that with the smallest id, a row
    without an id only if no other is in the group. Rows are known by a
    64-bit hash of id and text, so an id with several texts keeps those that
    stay, and of rows equal in both one is kept."""
    key = F.xxhash64("doc_id", "text", F.col("doc_id").isNull(), F.col("text").isNull())
    keyed = docs.select(key.alias("_key"), F.struct("*").alias("row"))
    found = staged(jaccard.jaccard_components(keyed.select("_key", "row.text"), num=80, den=100, words=5, id_col="_key"), "near-duplicates")
    members = found.select(F.col("doc_id").alias("_key"), "component_id")
    ids = keyed.select("_key", "row.doc_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key"))
    stays = members.distinct().join(ids, "_key").groupBy("component_id").agg(first["_key"].alias("_key"))
    gone = members.select("_key").distinct().join(stays, "_key", "left_anti")
    kept = keyed.join(gone, "_key", "left_anti")
    # rows equal in id and text are few: only they are grouped
    repeated = members.groupBy("_key").count().filter("count > 1").select("_key")
    once = kept.join(repeated, "_key", "left_anti")
    several = kept.join(repeated, "_key", "left_semi").dropDuplicates(["_key"])
    return once.unionByName(several).select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    found = decontamination.scan(_with_row(docs), read_table(spark, sf_dir, "benchmark"), keep=["row"], text_col="row.text")
    return found.filter(F.size("hits") == 0).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of the remaining documents' pieces in sequences of 4096
    tokens."""
    return packing.pack_documents(docs, TOKENIZER, max_len=4096, end_id=1)


STAGES = [
    ("language_id", language_id),
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: no SQL expresses the classifiers or the tokenizer
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
