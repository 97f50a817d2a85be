"""Reports: rounded segment rows, means, scalars and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def segment_report(df: DataFrame) -> DataFrame:
    """Times to one place, scores to three; all other columns as they are."""
    out = {c: F.round(c, 1) for c in ("start_sec", "end_sec", "duration_sec") if c in df.columns}
    return df.withColumns(out | {c: F.round(c, 3) for c in ("arousal", "exertion", "fatigue_prob") if c in df.columns})


def speaker_means(df: DataFrame, speaker: str) -> DataFrame:
    return df.groupBy(speaker).agg(F.avg("arousal").alias("avg_arousal"), F.avg("exertion").alias("avg_exertion"), F.count(F.lit(1)).alias("n")).orderBy(speaker)


def scalars(df: DataFrame, *, file: str, speaker: str, duration: str | None = None) -> DataFrame:
    """One row of counts and means; the low-confidence count is always part of it."""
    return df.agg(
        F.count_distinct(file).alias("n_files"),
        F.count(F.lit(1)).alias("n_segments"),
        F.count_distinct(speaker).alias("n_speakers"),
        (F.sum(duration) if duration else F.lit(None).cast("double")).alias("total_sec"),
        F.avg("arousal").alias("avg_arousal"),
        F.avg("exertion").alias("avg_exertion"),
        F.count_if(F.col("state") == "fatigued").alias("n_fatigued"),
        F.count_if(F.col("state") == "excited").alias("n_excited"),
        F.count_if(F.col("confidence") == "low").alias("n_low_confidence"),
        F.count_if(~F.col("using_individual")).alias("n_cold"),
    )


def fatigue_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(F.col("fatigue_prob") > 0.5).alias("n_fatigue_tendency"))


def training_report(metrics: DataFrame, importance: dict[str, DataFrame], predictions: DataFrame, parameters: dict[str, object], *, order_by: str, head: int = 500) -> dict[str, DataFrame]:
    """The seven named frames of the training report: metrics, ranked features and groups of each of two tasks, the first predictions with their errors, and the parameters.

    ``importance``: by task, as :func:`metrics.global_importance` ranks it; ``predictions``: for each task ``t`` columns ``true_t`` and ``pred_t``.
    """
    from cadence.operators.metrics import group_importance

    out = {"metrics": metrics}
    for task, ranked in importance.items():
        out[f"shap_{task}"] = ranked
        out[f"groups_{task}"] = group_importance(ranked)
    errors = {f"error_{t}": F.col(f"pred_{t}") - F.col(f"true_{t}") for t in importance}
    out["predictions"] = predictions.withColumns(errors).orderBy(order_by).limit(head)
    out["parameters"] = metrics.sparkSession.createDataFrame([(k, str(v)) for k, v in parameters.items()], "parameter string, value string")
    return out
