"""Column functions for scores of facts: recency, decay, pins, and what resolves contradictions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_WEIGHTS = {"confidence": 0.25, "corroboration": 0.15, "recency": 0.40, "validation": 0.20}
DECAY_RATE, ACCESS_BOOST, MOST_BOOST, LEAST_DECAY = 0.1, 0.1, 0.5, 0.01


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def recency(created_at: Column, now: float) -> Column:
    """1 / (1 + weeks since); 0.5 if unknown."""
    return F.when(created_at.isNull(), 0.5).otherwise(1 / (1 + (F.lit(now) - created_at) / 3600.0 / 168))


def days_since(created_at: Column, now: float) -> Column:
    """Days from a unix time, never negative; 10000 if unknown."""
    return F.coalesce(F.greatest((F.lit(now) - created_at) / 86400.0, F.lit(0.0)), F.lit(10000.0))


def components(confidence: Column, corroboration: Column, days: Column, validation: Column, weights: dict[str, float] = DEFAULT_WEIGHTS) -> dict[str, Column]:
    """The four parts of a claim's score and their weighted total."""
    kinds = F.create_map(F.lit("explicit"), F.lit(1.0), F.lit("inferred"), F.lit(0.95))
    parts = {
        "confidence": clamp(confidence, 0.0, 1.0),
        "corroboration": F.least(F.sqrt(F.greatest(corroboration.cast("double"), F.lit(1.0))), F.lit(3.0)),
        "recency": 1 / (1 + F.coalesce(days, F.lit(10000.0)) / 30),
        "validation": F.coalesce(F.try_element_at(kinds, validation), F.lit(0.7)),
    }
    total = sum((parts[k] * w for k, w in weights.items()), F.lit(0.0))
    return parts | {"weighted_total": total}


def decay(importance: Column, days: Column, accesses: Column) -> Column:
    score = clamp(importance, 0.0, 1.0) * F.exp(-DECAY_RATE * days) * (1 + F.least(ACCESS_BOOST * accesses, F.lit(MOST_BOOST)))
    return clamp(F.greatest(F.lit(LEAST_DECAY), score), 0.0, 1.0)


def half_life(initial: Column, days: Column, half: float = 7.0) -> Column:
    return initial * F.pow(F.lit(0.5), days / half)


def multi_factor_decay(importance: Column, created_days: Column, accessed_days: Column, accesses: Column) -> Column:
    score = clamp(importance, 0.0, 1.0) * F.exp(-DECAY_RATE * 0.5 * created_days) * F.exp(-DECAY_RATE * accessed_days) * (1 + F.log10(1 + accesses) / 3)
    return F.greatest(F.lit(LEAST_DECAY), F.least(F.lit(1.0), score))


def search_time_decay(stored: Column, days: Column, weight: float = 0.2) -> Column:
    return stored * (1 + weight * F.exp(-0.1 * days))


def days_until(initial: Column, threshold: float) -> Column:
    return F.when(initial <= threshold, F.lit(0.0)).otherwise(F.ln(threshold / initial) / -DECAY_RATE)


def boost_on_access(score: Column, amount: float = 0.8) -> Column:
    return F.least(F.lit(1.0), score + (1 - score) * amount)


def pin_boost(kind: Column, age_days: Column, most: float = 1.5, half: float = 90.0) -> Column:
    """1 without pin, `most` for a hard one, halving towards 1 for a soft one; the future and a half-life of 0 count as new."""
    soft = F.lit(most) if half == 0 else F.when(age_days < 0, F.lit(most)).otherwise(1 + (most - 1) * F.exp(-age_days * math.log(2) / half))
    return F.when(kind == "hard", F.lit(most)).when(kind == "soft", soft).otherwise(F.lit(1.0))
