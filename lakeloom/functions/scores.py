"""Decay, confidence and field scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A value halves in 90 days.
HALF_LIFE_SECONDS = 7_776_000


def decayed(worth: Column, age_seconds: Column) -> Column:
    return worth * F.pow(F.lit(0.5), age_seconds / F.lit(float(HALF_LIFE_SECONDS)))


def confidence(score: Column, position: Column, candidates: Column) -> Column:
    """The heuristic score, raised by up to 0.3 the earlier a candidate of several matched, within 0.1 and 1."""
    raised = score + F.when(candidates > 1, (candidates - position) / candidates * 0.3).otherwise(0.0)
    return F.least(F.greatest(raised, F.lit(0.1)), F.lit(1.0))
