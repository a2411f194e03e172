"""Input contract: column names, label values, validation (S6) and the
capability probe (S7).

Column names and labels are parameters everywhere; the dataclasses below hold
the defaults. Every check here is plan-time only: it reads ``df.columns`` and
never runs a job.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from convolytics import constants as K


@dataclass(frozen=True)
class Columns:
    """Names of the session table's columns."""

    topic: str = "TOPIC"
    topic_description: str = "TOPIC_DESCRIPTION"
    query: str = "USER_QUERY"
    resolution: str = "RESOLUTION"
    status: str = "RESOLUTION_STATUS"
    status_reasoning: str = "RESOLUTION_STATUS_REASONING"
    sentiment: str = "USER_SENTIMENT"
    sentiment_reasoning: str = "USER_SENTIMENT_REASONING"
    session_id: str = "SESSION_ID"
    intent: str = K.INTENT_COLUMN
    spam: str = K.SPAM_COLUMN
    suggestion: str = K.HIDDEN_IN_PREVIEW_COLUMN
    query_length: str = K.QUERY_LENGTH
    query_words: str = K.QUERY_WORD_COUNT
    resolution_length: str = K.RESOLUTION_LENGTH
    resolution_words: str = K.RESOLUTION_WORD_COUNT

    @property
    def required(self) -> tuple[str, ...]:
        return (
            self.topic,
            self.topic_description,
            self.query,
            self.resolution,
            self.status,
            self.status_reasoning,
            self.sentiment,
            self.sentiment_reasoning,
            self.session_id,
        )

    @property
    def features(self) -> tuple[str, ...]:
        return (self.query_length, self.query_words, self.resolution_length, self.resolution_words)


@dataclass(frozen=True)
class Labels:
    """Label values the analyses compare against."""

    resolved: str = K.STATUS_RESOLVED
    drop_off: str = K.STATUS_DROP_OFF
    sentiments: tuple[str, ...] = field(default=K.SENTIMENTS)
    positive: str = K.SENTIMENTS[0]
    negative: str = K.SENTIMENTS[2]
    accurate: str = K.INTENT_ACCURATE
    not_accurate: str = K.INTENT_NOT_ACCURATE
    not_spam: str = K.SPAM_NOT_SPAM
    spam: str = K.SPAM_SPAM


DEFAULT_COLUMNS = Columns()
DEFAULT_LABELS = Labels()


class SchemaError(ValueError):
    """The input does not satisfy the session table contract."""


def missing_columns(names: list[str] | tuple[str, ...], cols: Columns = DEFAULT_COLUMNS) -> list[str]:
    """Required names absent from ``names``, in declared order. Exact case."""
    present = set(names)
    return [c for c in cols.required if c not in present]


def check_unique_names(names: list[str] | tuple[str, ...]) -> None:
    """Spark resolves names case-insensitively, so ``Topic`` and ``TOPIC`` in
    one table would be ambiguous. Refuse such headers up front."""
    seen: dict[str, str] = {}
    for n in names:
        low = n.lower()
        if low in seen:
            raise SchemaError(f"Duplicate column names (case-insensitive): {seen[low]!r} and {n!r}")
        seen[low] = n


def validate_names(names: list[str] | tuple[str, ...], cols: Columns = DEFAULT_COLUMNS) -> None:
    check_unique_names(names)
    missing = missing_columns(names, cols)
    if missing:
        raise SchemaError(
            "Missing required columns: "
            + ", ".join(missing)
            + ". Required columns: "
            + ", ".join(cols.required)
        )


def validate(df: DataFrame, cols: Columns = DEFAULT_COLUMNS) -> DataFrame:
    """Fail when a required column is missing; return ``df`` unchanged."""
    validate_names(df.columns, cols)
    return df


def has_quality_columns(df: DataFrame, cols: Columns = DEFAULT_COLUMNS) -> bool:
    """Both optional quality columns present."""
    return {cols.intent, cols.spam} <= set(df.columns)


def require_quality_columns(df: DataFrame, cols: Columns = DEFAULT_COLUMNS) -> None:
    if not has_quality_columns(df, cols):
        raise SchemaError(f"Quality analysis needs both {cols.intent!r} and {cols.spam!r} columns")
