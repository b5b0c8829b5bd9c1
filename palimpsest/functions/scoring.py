"""Scores of memories as column expressions: forgetting curve, composite score, lifecycle decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the composite score.
WEIGHTS = {"importance": 0.35, "confidence": 0.20, "recency": 0.15, "usage": 0.15, "signal": 0.15}


def rounded(x: Column, digits: int = 4) -> Column:
    """Half up on doubles, the same in every engine."""
    return F.floor(x * 10**digits + 0.5) / 10.0**digits


def days(later: Column, earlier: Column) -> Column:
    """Days between two timestamps, with their fraction."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 86_400_000_000.0


def recency(last: Column, strength: Column, now: Column) -> Column:
    """Forgetting curve: 1 if never used or in the future, else exp(-hours / (24 strength)), within [0.01, 1]; strength counts as 1 at least."""
    hours = days(now, last) * 24
    curve = F.greatest(F.lit(0.01), F.least(F.lit(1.0), F.exp(-hours / (F.greatest(F.lit(1.0), F.coalesce(strength, F.lit(1.0))) * 24))))
    return F.when(last.isNull() | (hours <= 0), 1.0).otherwise(curve)


def composite(importance: Column, confidence: Column, fresh: Column, usage: Column, signal: Column) -> Column:
    """Weighted score of five parts in [0, 1], to four places."""
    within = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    used = F.when(usage > 0, 1 - 1 / (1 + usage / 5.0)).otherwise(0.0)
    w = WEIGHTS
    return rounded(w["importance"] * within((importance - 1) / 4.0) + w["confidence"] * confidence + w["recency"] * fresh + w["usage"] * used + w["signal"] * signal)


def live(valid_to: Column, archived_at: Column, now: Column) -> Column:
    return archived_at.isNull() & (valid_to.isNull() | (valid_to >= now))


def as_of(valid_from: Column, valid_to: Column, archived_at: Column, at: Column) -> Column:
    """Valid at a point in time: intervals are closed on the left and open on the right."""
    return (valid_from.isNull() | (valid_from <= at)) & (valid_to.isNull() | (valid_to > at)) & (archived_at.isNull() | (archived_at > at))
