"""The four text features every analysis reads."""

from __future__ import annotations

from pyspark.sql import DataFrame

from convolytics.functions.text import char_length, word_count
from convolytics.schema import Columns, DEFAULT_COLUMNS


def add_text_features(df: DataFrame, cols: Columns = DEFAULT_COLUMNS) -> DataFrame:
    """Adds ``query_length``, ``query_word_count``, ``resolution_length`` and
    ``resolution_word_count``: non-null bigints, missing text counts as ''.
    One projection, no shuffle."""
    return df.withColumns(
        {
            cols.query_length: char_length(cols.query),
            cols.query_words: word_count(cols.query),
            cols.resolution_length: char_length(cols.resolution),
            cols.resolution_words: word_count(cols.resolution),
        }
    )
