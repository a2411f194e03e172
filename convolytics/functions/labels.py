"""Display labels (F8), quality bands (F9) and recommendation rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from convolytics import constants as K


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pretty_label(c: Column | str) -> Column:
    """F8: '_' to space, then each space-separated word capitalised."""
    return F.initcap(F.regexp_replace(_col(c), F.lit("_"), F.lit(" ")))


def accuracy_band(pct: Column | str) -> Column:
    """accuracy rate band on the rounded rate, strict thresholds."""
    p = _col(pct)
    return (
        F.when(p > K.ACCURACY_GOOD_ABOVE, F.lit("good"))
        .when(p > K.ACCURACY_MEDIUM_ABOVE, F.lit("medium"))
        .otherwise(F.lit("poor"))
    )


def spam_band(pct: Column | str) -> Column:
    """spam rate band on the rounded rate, strict thresholds."""
    p = _col(pct)
    return (
        F.when(p > K.SPAM_POOR_ABOVE, F.lit("poor"))
        .when(p > K.SPAM_MEDIUM_ABOVE, F.lit("medium"))
        .otherwise(F.lit("good"))
    )


def resolution_advice(resolved_pct: Column | str) -> Column:
    """resolution recommendation on the unrounded rate."""
    return F.when(_col(resolved_pct) > K.RESOLVED_GOOD_ABOVE, F.lit("good resolution rate")).otherwise(
        F.lit("focus on improving resolution rates")
    )


def drop_off_advice(drop_off_pct: Column | str) -> Column:
    """drop-off recommendation on the unrounded rate."""
    return F.when(_col(drop_off_pct) < K.DROP_OFF_GOOD_BELOW, F.lit("low drop-off rate")).otherwise(
        F.lit("investigate user drop-offs")
    )


def sentiment_advice(negative_pct: Column | str) -> Column:
    """sentiment recommendation on the unrounded rate."""
    return F.when(_col(negative_pct) < K.NEGATIVE_GOOD_BELOW, F.lit("positive user sentiment")).otherwise(
        F.lit("address negative sentiment")
    )
