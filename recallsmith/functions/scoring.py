"""Scores of memories as column expressions. Every time-dependent one takes the instant it holds for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decay by day of each tier; an unknown tier counts as semantic.
DECAY = {"semantic": 0.005, "episodic": 0.02, "working": 0.05}


def instant(as_of: str) -> Column:
    return F.to_timestamp(F.lit(as_of))


def age_days(created: Column, as_of: str) -> Column:
    """Days since `created`, not below 0."""
    return F.greatest((F.unix_micros(instant(as_of)) - F.unix_micros(created.cast("timestamp"))) / 86_400_000_000.0, F.lit(0.0))


def tier_decay(tier: Column, created: Column, as_of: str) -> Column:
    """exp(-rate of the tier * age); 1 without a readable instant."""
    rate = F.lit(DECAY["semantic"])
    for name in ("episodic", "working"):
        rate = F.when(tier == name, F.lit(DECAY[name])).otherwise(rate)
    return F.coalesce(F.exp(-rate * age_days(created, as_of)), F.lit(1.0))


def relevance_boost(hits: Column, last: Column, created: Column, as_of: str) -> Column:
    """Frequency * recency of the last access * decay since creation; 1 without hits, and 1 for what has no instant."""
    hours = (F.unix_micros(instant(as_of)) - F.unix_micros(last.cast("timestamp"))) / 3_600_000_000.0
    days = (F.unix_micros(instant(as_of)) - F.unix_micros(created.cast("timestamp"))) / 86_400_000_000.0
    freq = F.least(F.log2(hits + 1) / 5, F.lit(1.0)) * 0.5 + 1
    recent = F.when(hours < 24, 1.3).when(hours < 168, 1.09).otherwise(1.0)
    decay = F.greatest(F.exp(-0.693 * days / 30), F.lit(0.1))
    return F.when(F.coalesce(hits, F.lit(0)) == 0, F.lit(1.0)).otherwise(freq * recent * F.coalesce(decay, F.lit(1.0)))


def clamp(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))


def strength(sim: Column, vsa: Column, age_hours: Column, hits: Column, surprise: Column, redundancy: Column) -> Column:
    """The governor's strength of a memory, from 0 to 1."""
    recency = F.exp(-age_hours / 336)
    often = F.least(F.log1p(hits) / F.log(F.lit(16.0)), F.lit(1.0))
    return clamp(0.30 * clamp(sim) + 0.30 * clamp(vsa) + 0.15 * clamp(recency) + 0.15 * often + 0.15 * clamp(surprise) - F.least(F.lit(0.25), 0.25 * clamp(redundancy)) - (1 - clamp(recency)) * 0.15)


def trigger(strength_: Column, surprise: Column, novelty: Column, conflict: Column) -> Column:
    """The governor's decision, by priority."""
    return (
        F.when((strength_ >= 0.90) | (conflict >= 0.70), "notify").when(strength_ >= 0.85, "inject")
        .when((strength_ >= 0.72) | (surprise >= 0.65) | (novelty >= 0.75), "consolidate").when(strength_ >= 0.60, "prefetch").otherwise("low_signal")
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 for empty, unlike long or zero ones."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(F.lit(0.0))
