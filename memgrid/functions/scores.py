"""Closed-form scores as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units by how many of them make a second. Fixed values.
PER_SECOND = {"seconds": 1.0, "s": 1.0, "milliseconds": 1e3, "ms": 1e3, "microseconds": 1e6, "us": 1e6}
#: Bounds of a retrieval plan. Fixed values.
PLAN_BOUNDS = {"hops": (0, 2), "fanout": (1, 3), "beam": (1, 16), "rerank_m": (1, 24), "final_context": (1, 12), "docs_max": (16, 512), "latency_ms": (200, 10000)}


def harmonic_mean(x: Column, y: Column) -> Column:
    return F.when((x > 0) & (y > 0), 2.0 * x * y / (x + y)).otherwise(F.lit(0.0))


def positive(*columns: Column) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & (c > 0)
    return out


def bottleneck(what: Column, rate: Column, who: Column, seconds: Column | None = None) -> Column:
    """what * rate * who, by time if there is one; 0 unless all are positive."""
    value = what * rate * who if seconds is None else what * rate * who / seconds
    return F.when(positive(what, rate, who, *([seconds] if seconds is not None else [])), value).otherwise(F.lit(0.0))


def single_score(what: Column, rate: Column, who: Column, seconds: Column, context: Column, alpha: Column) -> Column:
    """efficiency, capability and whether a zero gate closed both."""
    open_ = positive(what, rate, who, seconds, context)
    power = F.pow(context, alpha)
    zero = F.lit(0.0)
    return F.struct(
        F.when(open_, what * rate * who / seconds * power).otherwise(zero).alias("efficiency"),
        F.when(open_, what * rate * who * power).otherwise(zero).alias("capability"),
        (~open_).alias("zero_gate"),
    )


def pair_score(out_leg: Column, in_leg: Column, context: Column, link: Column, alpha: Column, monolithic: bool = False) -> Column:
    """Score of two legs (bottlenecks): the harmonic mean with context^alpha and the link's part.

    alpha outside 1.5 to 2.0 and a link outside 0 to 1 are errors, checked first; then a closed context gate, then a closed bottleneck.
    """
    mean = harmonic_mean(out_leg, in_leg)
    value = F.pow(mean * context, alpha) * link if monolithic else mean * F.pow(context, alpha) * link
    shut = (context <= 0) | (link == 0)
    gate = F.when(shut, F.lit("context_or_link")).when(mean <= 0, F.lit("bottleneck"))
    zero = F.lit(0.0)
    fine = F.when(~alpha.between(1.5, 2.0), F.raise_error(F.lit("alpha must lie in 1.5 to 2.0"))).when(~link.between(0, 1), F.raise_error(F.lit("link must lie in 0 to 1")))
    found = F.struct(
        F.when(shut, zero).otherwise(out_leg).alias("out_leg"),
        F.when(shut, zero).otherwise(in_leg).alias("in_leg"),
        F.when(gate.isNotNull(), zero).otherwise(value).alias("pair"),
        gate.alias("gate"),
    )
    return F.when(fine.cast("string").isNull(), found)


def amplification(gain: Column, reach: Column, who: Column, seconds: Column, context: Column, alpha: Column) -> Column:
    return F.when(positive(gain, reach, who, seconds, context), gain * reach * who / seconds * F.pow(context, alpha - 1)).otherwise(F.lit(0.0))


def recency(age_days: Column, scale: float = 30.0) -> Column:
    return F.coalesce(F.exp(-age_days / scale), F.lit(0.0))


def freshness(age_days: Column, scale: float = 30.0) -> Column:
    return F.greatest(F.lit(0.0), 1 - age_days / scale)


def in_seconds(value: Column, unit: Column) -> Column:
    """Null for an unknown unit; never less than 1e-9."""
    per = F.try_element_at(F.create_map(*[F.lit(x) for pair in PER_SECOND.items() for x in pair]), unit)
    return F.greatest(value / per, F.lit(1e-9)) + F.lit(0.0) * per


def clamped(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def clamp_reason(name: str, value: Column, low: int, high: int) -> Column:
    return F.when(value < low, F.lit(f"{name}:min")).when(value > high, F.lit(f"{name}:max"))
