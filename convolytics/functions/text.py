"""Text expressions: null to empty (F1), code-point length (F2), whitespace
word count (F3), lower-case (F4) and keyword tokens (F5)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from convolytics import constants as K

# What str.split() with no argument takes for white space.
WHITESPACE_CHARS = "".join(chr(cp) for cp in K.WHITESPACE_CODE_POINTS)

# A word character is a letter, a number or '_' (Python's Unicode ``\w``).
WORD_CHAR = r"[\p{L}\p{N}_]"

# A keyword is a maximal run of word characters made of a-z only, at least
# MIN_KEYWORD_LENGTH long. Lookarounds keep the run maximal: a run that
# touches a digit, '_' or an accented letter is dropped as a whole.
KEYWORD_PATTERN = (
    f"(?<!{WORD_CHAR})[a-z]{{{K.MIN_KEYWORD_LENGTH},}}(?!{WORD_CHAR})"
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or_empty(c: Column | str) -> Column:
    """null becomes ''."""
    return F.coalesce(_col(c), F.lit(""))


def char_length(c: Column | str) -> Column:
    """length in Unicode code points, null counts as ''; never null."""
    return F.length(text_or_empty(c)).cast("bigint")


def word_count(c: Column | str) -> Column:
    """number of whitespace-separated words; '' and null give 0.

    Every whitespace character becomes a plain space (``translate``, a
    per-character map), the text is split on that single space, and the
    non-empty pieces are counted: Python's ``str.split()``. No regex engine
    runs, which matters at scale: a character-class regex is several times
    slower per character. Never null.
    """
    spaced = F.translate(text_or_empty(c), WHITESPACE_CHARS, " " * len(WHITESPACE_CHARS))
    return F.size(F.filter(F.split(spaced, " "), lambda w: w != F.lit(""))).cast("bigint")


def keyword_tokens(c: Column | str, stop_words: Iterable[str] = K.STOP_WORDS) -> Column:
    """F4 + F5 + P7: array of the keywords of one text, in text order.

    Lower-cases, keeps maximal a-z word runs longer than two characters and
    drops stop words. Works on whole texts; nothing is truncated.
    """
    stop = sorted(set(stop_words))
    runs = F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(KEYWORD_PATTERN), 0)
    if not stop:
        return runs
    return F.filter(runs, lambda w: ~w.isin(stop))
