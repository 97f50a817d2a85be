"""Scalar expressions. NaN counts as unknown: comparisons guard against Spark's order, in which NaN is the largest."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip01(x: Column) -> Column:
    return F.when(F.isnan(x), x).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def fatigue_probability(exertion: Column) -> Column:
    return clip01(F.lit(1.0) - exertion)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def zscore(x: Column, mean: Column, std: Column, eps: float = 1e-8) -> Column:
    return F.when(std < eps, F.lit(0.0)).otherwise((x - mean) / std)


def exertion_proxy(jitter: Column, shimmer: Column, hnr: Column) -> Column:
    """From z-scored voice quality: more jitter and shimmer and less harmonics mean more exertion."""
    return sigmoid(F.lit(0.4) * jitter + F.lit(0.4) * shimmer - F.lit(0.2) * hnr)


def exertion_z(e: Column) -> Column:
    return F.when(e < 0.95, (e - 0.95) / 0.03).otherwise(F.lit(0.0))


def composite_id(file: Column, segment: Column) -> Column:
    return F.concat_ws("::", file, segment)


def display_to_id(x: Column) -> Column:
    """``"persist_001 (label)"`` to ``persist_001``."""
    return F.trim(F.split(F.split(x, " ")[0], r"\(")[0])


def age_days(then: Column, now: Column) -> Column:
    """Whole days of 24 hours."""
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(then)) / 86400).cast("long")


def pcm16(x: Column) -> Column:
    return F.transform(x, lambda v: (v * 32767).cast("short"))


def mono(channels: Column) -> Column:
    """Mean over channels of ``ARRAY<ARRAY<..>>``, a row for each sample."""
    return F.transform(channels, lambda s: F.aggregate(s, F.lit(0.0), lambda a, b: a + b.cast("double")) / F.size(s))


def quoted(names: Iterable[str]) -> list[Column]:
    """Columns whose names may hold dots or dashes."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]
