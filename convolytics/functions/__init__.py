"""Column expressions (F1-F10). All are built-in Spark expressions, so they
stay inside whole-stage code generation; none is a Python UDF."""

from convolytics.functions.text import (
    text_or_empty,
    char_length,
    word_count,
    keyword_tokens,
    KEYWORD_PATTERN,
)
from convolytics.functions.numeric import rate, share, round2, safe_divide
from convolytics.functions.labels import (
    pretty_label,
    accuracy_band,
    spam_band,
    resolution_advice,
    drop_off_advice,
    sentiment_advice,
)

__all__ = [
    "text_or_empty",
    "char_length",
    "word_count",
    "keyword_tokens",
    "KEYWORD_PATTERN",
    "rate",
    "share",
    "round2",
    "safe_divide",
    "pretty_label",
    "accuracy_band",
    "spam_band",
    "resolution_advice",
    "drop_off_advice",
    "sentiment_advice",
]
