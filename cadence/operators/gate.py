"""Signal quality of segments: noise estimate, gate and histogram."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.operators import ranges


def _percentile(sorted_: Column, q: float) -> Column:
    """Linear interpolation in a sorted array."""
    at = (F.size(sorted_) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    a, b = F.get(sorted_, low), F.get(sorted_, F.least(low + 1, F.size(sorted_) - 1))
    return a + (b - a) * (at - low)


def snr_db(audio: str | Column, frame: int = 512, hop: int = 256) -> Column:
    """Energy of loud frames (90th percentile) over that of quiet ones (10th), in dB; -inf under two frames, 30 where quiet ones are silent. Array functions only, so a segment stays in its row."""
    audio = F.col(audio) if isinstance(audio, str) else audio
    n = F.floor((F.size(audio) - frame) / hop) + 1
    energy = lambda i: F.aggregate(F.slice(audio, (i * hop + 1).cast("int"), frame), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    energies = F.array_sort(F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), energy))
    noise, signal = _percentile(energies, 0.1), _percentile(energies, 0.9)
    value = F.when(noise < 1e-12, F.lit(30.0)).otherwise(10 * F.log10(F.greatest(F.try_divide(signal, noise), F.lit(1e-6))))
    return F.when(n < 2, F.lit(float("-inf"))).otherwise(value)


def long_enough(audio: str | Column, sec: float = 0.3, rate: int = 16000) -> Column:
    audio = F.col(audio) if isinstance(audio, str) else audio
    return F.coalesce(F.size(audio) >= sec * rate, F.lit(False))


def numbered(df: DataFrame, order_by: str, out: str) -> DataFrame:
    """Rows numbered from 0 in order, without one task that holds them all; rows of equal order as they are read."""
    return ranges.numbered(df, [order_by], out)


def gate(df: DataFrame, *, duration: str = "duration_sec", snr: str = "snr_db", tse: str = "tse_confidence", order_by: str, min_sec: float = 0.3, min_snr: float = 3.0, min_tse: float = 0.6, keys: tuple[str, ...] = ()) -> DataFrame:
    """Drops short segments, flags the others, and gives ids by place before dropping where none is set."""
    if keys:
        df = df.withColumn("_seg", F.row_number().over(Window.partitionBy(*[F.col(k) for k in keys]).orderBy(order_by)) - 1)
    else:
        df = numbered(df, order_by, "_seg")
    place = F.format_string("seg_%03d", F.col("_seg").cast("long"))
    name = F.coalesce(F.nullif(F.col("segment_id").cast("string"), F.lit("")), place) if "segment_id" in df.columns else place
    flag = F.when(F.col(tse) < min_tse, "uncertain").when(F.col(snr) < min_snr, "low_snr").otherwise("ok")
    return df.withColumn("segment_id", name).where(F.col(duration) >= min_sec).withColumn("quality_flag", flag).drop("_seg")


def histogram(before: DataFrame, after: DataFrame) -> DataFrame:
    """Total kept, by flag, and how many were dropped as too short."""
    flags = after.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("quality_flag") == f).alias(f) for f in ("ok", "low_snr", "uncertain")])
    return flags.crossJoin(before.agg(F.count(F.lit(1)).alias("_all"))).select("total", "ok", "low_snr", "uncertain", (F.col("_all") - F.col("total")).alias("too_short"))
