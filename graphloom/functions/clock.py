"""Time columns. The present is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def event_clock() -> Column:
    return F.coalesce("referent_ts", "ts")


def age_days(ts, as_of) -> Column:
    return (F.unix_micros(F.lit(as_of)) - F.unix_micros(ts)) / F.lit(86_400_000_000.0)


def recency_weight(ts, as_of) -> Column:
    """0.5 + 0.5 e^(-age/365 days); 1 where the time is unknown or to come."""
    age = age_days(ts, as_of)
    return F.when(age > 0, 0.5 + 0.5 * F.exp(-age / 365.0)).otherwise(1.0)


def event_time(text, strict: bool = False) -> Column:
    """A timestamp from ISO text with an offset; without one it is refused: null, or an error if strict."""
    t = F.trim(text)
    good = t.rlike(r"([Zz]|[+-]\d{2}:?\d{2})$") & F.try_to_timestamp(t).isNotNull()
    bad = F.raise_error(F.concat(F.lit("not a time with an offset: "), t)) if strict else F.lit(None)
    return F.when(t.isNull() | (t == ""), None).when(good, F.try_to_timestamp(t)).otherwise(bad.cast("timestamp"))
