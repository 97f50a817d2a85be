"""Thresholds from the data, the state rule, confidence and reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.operators.quantiles import percentiles

LABELS = {"excited": "excited", "stable": "stable", "fatigued": "fatigued"}
#: Used where no thresholds are given.
DEFAULTS = {"arousal_low": 0.55, "arousal_high": 0.80, "exertion_low": 0.85, "exertion_high": 0.95}


def thresholds(df: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """``low`` (25th percentile), ``high`` (75th), ``mean``; percentiles interpolate linearly. See :mod:`cadence.operators.quantiles` for large frames."""
    p, means = percentiles(df, value, [0.25, 0.75], keys), df.groupBy(*keys).agg(F.avg(value).alias("mean"))
    same = F.lit(True)
    for k in keys:
        same = same & p[k].eqNullSafe(means[k])
    return p.join(means, same).select(*[p[k] for k in keys], F.col("percentiles")[0].alias("low"), F.col("percentiles")[1].alias("high"), "mean")


def with_thresholds(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``a_low, a_high, e_high`` of the frame or of each group; one row of thresholds per group is joined, not a window that holds a group."""
    a, e = percentiles(df, "arousal", [0.25, 0.75], keys), percentiles(df, "exertion", [0.75], keys)
    a = a.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("percentiles")[0].alias("a_low"), F.col("percentiles")[1].alias("a_high"))
    e = e.select(*[F.col(k).alias(f"_e{k}") for k in keys], F.col("percentiles")[0].alias("e_high"))
    if not keys:
        return df.crossJoin(F.broadcast(a)).crossJoin(F.broadcast(e))  # one row each
    same, both = F.lit(True), F.lit(True)
    for k in keys:
        both = both & F.col(f"_{k}").eqNullSafe(F.col(f"_e{k}"))
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(a.join(e, both), same, "left").drop(*[f"_{k}" for k in keys], *[f"_e{k}" for k in keys])


#: What a reason says: name of a score, comparison and limit; and the stable one, with the score and both limits.
TEXTS = {"reason": "%s=%.2f %s threshold(%.2f)", "stable": "arousal=%.2f within [%.2f, %.2f]", "arousal": "arousal", "exertion": "exertion"}


def state_struct(a: Column, e: Column, a_low: Column, a_high: Column, e_high: Column, labels: dict[str, str] = LABELS, texts: dict[str, str] = TEXTS) -> Column:
    """``state, confidence, reason``. Comparisons are strict, NaN meets none of them."""
    above = lambda x, y: (x > y) & ~F.isnan(x)
    say = lambda name, x, sign, y: F.format_string(texts["reason"], F.lit(texts[name]), x.cast("double"), F.lit(sign), y.cast("double"))

    def out(state: str, confidence: str, *reasons: Column) -> Column:
        return F.struct(F.lit(labels[state]).alias("state"), F.lit(confidence).alias("confidence"), F.concat_ws("; ", *reasons).alias("reason"))

    low = above(a_low, a)
    return (
        F.when(above(a, a_high), out("excited", "high", say("arousal", a, ">", a_high)))
        .when(low & above(e, e_high), out("fatigued", "high", say("arousal", a, "<", a_low), say("exertion", e, ">", e_high)))
        .when(low, out("fatigued", "medium", say("arousal", a, "<", a_low), say("exertion", e, "<=", e_high)))
        .otherwise(out("stable", "high", F.format_string(texts["stable"], a.cast("double"), a_low.cast("double"), a_high.cast("double"))))
    )


def classify(df: DataFrame, keys: tuple[str, ...] = (), limits: dict[str, float] | None = None, labels: dict[str, str] = LABELS, texts: dict[str, str] = TEXTS) -> DataFrame:
    """``df`` with ``state, confidence, reason``. ``limits`` (see DEFAULTS) replaces thresholds from the data."""
    if limits is None:
        rows = with_thresholds(df, keys)
    else:
        rows = df.withColumns({"a_low": F.lit(limits["arousal_low"]), "a_high": F.lit(limits["arousal_high"]), "e_high": F.lit(limits["exertion_high"])})
    s = state_struct(F.col("arousal"), F.col("exertion"), F.col("a_low"), F.col("a_high"), F.col("e_high"), labels, texts)
    return rows.withColumn("_s", s).select(*df.columns, "_s.state", "_s.confidence", "_s.reason")


#: Fixed value: what stands for reasons where there are no attributions.
NO_SHAP = "SHAP 列未找到"


def classify_with_shap(df: DataFrame, keys: tuple[str, ...] = (), *, top_k: int = 3, prefix: str = "shap_arousal_", **more) -> DataFrame:
    """:func:`classify` with ``shap_reason``: the ``top_k`` largest attributions of the arousal score, from columns named by ``prefix`` and feature; a fixed text where there are none."""
    from cadence.operators.metrics import top_reasons

    rows = classify(df, keys, **more)
    features = [c.removeprefix(prefix) for c in df.columns if c.startswith(prefix)]
    return rows.withColumn("shap_reason", top_reasons(rows, features, top_k, prefix) if features else F.lit(NO_SHAP))


def downgraded(confidence: Column, baseline: Column) -> Column:
    """A rule's confidence, lowered by that of the speaker's baseline."""
    return (
        F.when((baseline == "low") & (confidence == "high"), "medium")
        .when((baseline == "low") & (confidence == "medium"), "low")
        .when((baseline == "medium") & (confidence == "high"), "medium")
        .otherwise(confidence)
    )


def summary(df: DataFrame) -> DataFrame:
    """Counts and shares of states and mean scores; shares of an empty frame are null."""
    n = lambda s: F.count_if(F.col("state") == s)
    total = F.count(F.lit(1))
    share = lambda s: F.try_divide(n(s) * F.lit(100.0), total)
    return df.agg(
        total.alias("total"),
        *[n(s).alias(f"n_{s}") for s in LABELS],
        *[share(s).alias(f"{s}_pct") for s in LABELS],
        F.avg("arousal").alias("avg_arousal"),
        F.avg("exertion").alias("avg_exertion"),
    )


def state_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("state", "confidence").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "state", "confidence")


def per_state_head(df: DataFrame, n: int, order_by: str) -> DataFrame:
    w = Window.partitionBy("state").orderBy(order_by)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
