"""Intervals from frame probabilities, merging of close segments, and slices of waveforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.operators import ranges as scans
from cadence.sources.tables import scratch


def frames_to_segments(frames: DataFrame, *, key: str, frame: str = "frame", prob: str = "prob", threshold: float = 0.5, frame_sec: float = 0.032, min_speech_ms: float = 300, min_silence_ms: float = 200, ranges: int | None = None) -> DataFrame:
    """``key, start_sec, end_sec, duration_sec``.

    A segment opens at a speech frame and closes at a run of silence of the
    minimum length; an open one ends with the signal. A closed segment's length
    is tested up to its last speech frame, without that frame, and its end is
    reported with it; an open one is tested and reported to the last frame.
    Frames are taken in ``ranges`` by key and frame; a run that is open at a range's end goes on in the next, so a recording of any length is
    spread over tasks.
    """
    quiet = max(1, int(min_silence_ms / 1000 / frame_sec))
    total = frames.groupBy(F.col(key).alias("_k")).agg((F.max(frame) + 1).alias("n"))
    speech = frames.where((F.col(prob) > threshold) & ~F.isnan(prob) & F.col(key).isNotNull()).select(key, frame)
    rows = scans.dealt(speech, [key, frame], ranges)
    by = scans.inside(key, [frame])
    opens = F.col(frame) - F.lag(frame).over(by) - 1 >= quiet
    rows = rows.withColumn("_open", F.when(opens, F.col(frame))).withColumn("_from", F.last("_open", ignorenulls=True).over(by))
    found = scans.edges(rows, key, F.struct(F.min(frame).alias("first"), F.max(frame).alias("last"), F.max("_from").alias("open")))

    def add(held: dict | None, own: dict, _: int) -> dict:
        goes_on = held is not None and own["first"] - held["_last"] - 1 < quiet
        return {"_last": own["last"], "_start": own["open"] if own["open"] is not None else held["_start"] if goes_on else own["first"]}

    rows = scans.with_carried(rows, key, found, scans.chained(found, add), "_last long, _start long")
    first = F.first(frame).over(by)
    run = F.when(F.col("_from").isNotNull(), F.col("_from")).when(first - F.col("_last") - 1 < quiet, F.col("_start")).otherwise(first)
    islands = scratch(rows.withColumn("_run", run).groupBy(key, "_run").agg(F.max(frame).alias("last")).select(key, F.col("_run").alias("first"), "last"), "islands")
    ends = islands.groupBy(F.col(key).alias("_k")).agg(F.max("first").alias("_f"), F.max("last").alias("_l")).join(total, "_k")  # a row for each key
    tails = ends.where(F.col("n") - 1 - F.col("_l") < quiet).select("_k", "_f", "n")
    kept = islands.join(tails, (F.col(key) == F.col("_k")) & (F.col("first") == F.col("_f")), "left")
    tail = F.col("n").isNotNull()
    length = F.when(tail, F.col("n") - F.col("first")).otherwise(F.col("last") - F.col("first"))
    end = F.when(tail, F.col("n")).otherwise(F.col("last") + 1)
    kept = kept.where(length * (frame_sec * 1000) >= min_speech_ms)
    return kept.select(key, (F.col("first") * frame_sec).alias("start_sec"), (end * frame_sec).alias("end_sec"), ((end - F.col("first")) * frame_sec).alias("duration_sec"))


def merge_close(segments: DataFrame, *, key: str, gap_sec: float = 0.3, ranges: int | None = None) -> DataFrame:
    """Segments nearer than ``gap_sec`` become one; its end is the last one's. Ranges of segments are merged each for itself, and what is open at a range's end goes on in the next."""
    rows = scans.dealt(segments.select(key, F.col("start_sec").cast("double").alias("start_sec"), F.col("end_sec").cast("double").alias("end_sec")), [key, "start_sec", "end_sec"], ranges)
    by = scans.inside(key, ["start_sec", "end_sec"])
    place = F.struct("start_sec", "end_sec", scans.ROW)
    apart = ~F.coalesce(F.col("start_sec") - F.lag("end_sec").over(by) < gap_sec, F.lag(scans.ROW).over(by).isNull())
    rows = rows.withColumn("_open", F.when(apart, F.col(scans.ROW))).withColumn("_from", F.last("_open", ignorenulls=True).over(by))
    at = lambda pick, c: pick(F.col(c), place)
    found = scans.edges(rows, key, F.struct(at(F.min_by, "start_sec").alias("start"), at(F.min_by, scans.ROW).alias("row"), at(F.max_by, "end_sec").alias("end"), at(F.max_by, "_from").alias("open")))

    def add(held: dict | None, own: dict, _: int) -> dict:
        goes_on = held is not None and None not in (own["start"], held["_end"]) and own["start"] - held["_end"] < gap_sec
        return {"_end": own["end"], "_run": own["open"] if own["open"] is not None else held["_run"] if goes_on else own["row"]}

    rows = scans.with_carried(rows, key, found, scans.chained(found, add), "_end double, _run long")
    goes_on = F.first("start_sec").over(by) - F.col("_end") < gap_sec
    run = F.when(F.col("_from").isNotNull(), F.col("_from")).when(goes_on, F.col("_run")).otherwise(F.first(scans.ROW).over(by))
    merged = rows.withColumn("_run", run).groupBy(key, "_run").agg(F.min("start_sec").alias("start_sec"), F.max_by("end_sec", place).alias("end_sec"))
    return merged.select(key, "start_sec", "end_sec", (F.col("end_sec") - F.col("start_sec")).alias("duration_sec"))


def cut(audio: Column, start_sec: Column, end_sec: Column, rate: int = 16000) -> Column:
    """Samples from ``int(start * rate)`` up to ``int(end * rate)``."""
    a, b = (start_sec * rate).cast("int"), (end_sec * rate).cast("int")
    return F.slice(audio, a + 1, F.greatest(F.lit(0), F.least(b, F.size(audio)) - a))


def renumbered(df: DataFrame, order_by: list[str], out: str = "segment_no") -> DataFrame:
    """Rows numbered from 0 over all files, by file and then the other columns of ``order_by``."""
    return scans.numbered(df, order_by, out)


def file_boundaries(df: DataFrame, file: str, number: str) -> DataFrame:
    """Numbers at which a new file begins, the first left out."""
    return df.groupBy(file).agg(F.min(number).alias("pos")).where("pos > 0")
