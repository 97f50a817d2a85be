"""Alignment of features to each speaker: z-scores with the population as fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.functions.scalar import zscore



def _stats(grouped, features: list[str], tag: str) -> DataFrame:
    """Count, and each feature's mean and sample deviation. NaN is skipped."""
    aggs = [F.count(F.lit(1)).alias(f"{tag}n")]
    for i, f in enumerate(features):
        x = F.col(f"`{f}`").cast("double")
        known = F.when(~F.isnan(x), x)
        aggs += [F.avg(known).alias(f"{tag}m{i}"), F.stddev_samp(known).alias(f"{tag}s{i}")]
    return grouped.agg(*aggs)


def fit(df: DataFrame, *, speaker: str, features: list[str], min_samples: int = 3) -> DataFrame:
    """Rows of the aligner: each speaker's and, under a null speaker, everyone's mean, sample deviation and count."""

    def tall(wide: DataFrame, who) -> DataFrame:
        each = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"_m{i}").alias("mean"), F.col(f"_s{i}").alias("std")) for i, f in enumerate(features)])
        return wide.select(who.alias("speaker"), F.col("_n").alias("n"), F.explode(each).alias("x")).select("speaker", "x.feature", "x.mean", "x.std", "n")

    own = tall(_stats(df.groupBy(F.col(speaker).cast("string").alias("_sp")), features, "_").where("_sp is not null"), F.col("_sp"))
    every = tall(_stats(df.groupBy(), features, "_"), F.lit(None).cast("string"))
    return own.unionByName(every).withColumn("use_global", F.col("speaker").isNotNull() & (F.col("n") < min_samples))


def _applied(df: DataFrame, own: DataFrame, every: DataFrame, speaker: str, features: list[str], eps: float) -> DataFrame:
    rows = df.join(own, F.col(speaker).cast("string") == F.col("_sp"), "left").crossJoin(F.broadcast(every))  # one row
    fall = F.coalesce(F.col("_use"), F.lit(True))
    out = {}
    for i, f in enumerate(features):
        m, s = (F.when(fall, F.col(f"_g{k}{i}")).otherwise(F.col(f"_o{k}{i}")) for k in "ms")
        out[f] = zscore(F.col(f"`{f}`").cast("double"), m, s, eps)
    return rows.select(*[(out[c].alias(c) if c in out else F.col(f"`{c}`")) for c in df.columns], fall.alias("low_confidence"))


def transform(df: DataFrame, aligner: DataFrame, *, speaker: str, features: list[str], eps: float = 1e-8) -> DataFrame:
    """``df`` with features as z-scores and ``low_confidence`` where the population's figures had to serve."""

    def pivoted(rows: DataFrame, tag: str, keys: list[str]) -> DataFrame:
        aggs = [F.max("use_global").alias("_use")]
        for i, f in enumerate(features):
            at = F.col("feature") == f
            aggs += [F.max(F.when(at, F.col("mean"))).alias(f"{tag}m{i}"), F.max(F.when(at, F.col("std"))).alias(f"{tag}s{i}")]
        return rows.groupBy(*keys).agg(*aggs)

    own = pivoted(aligner.where("speaker is not null"), "_o", ["speaker"]).withColumnRenamed("speaker", "_sp")
    every = pivoted(aligner.where("speaker is null"), "_g", []).drop("_use")
    return _applied(df, own, every, speaker, features, eps)


def align(df: DataFrame, *, speaker: str, features: list[str], aligner: DataFrame | None = None, min_samples: int = 3) -> DataFrame:
    """Fit and transform, or transform only with an aligner at hand."""
    if aligner is not None:
        return transform(df, aligner, speaker=speaker, features=features)
    # A fresh fit stays wide: one aggregate by speaker and one over all, joined back.
    own = _stats(df.groupBy(F.col(speaker).cast("string").alias("_sp")), features, "_o").where("_sp is not null").withColumn("_use", F.col("_on") < min_samples)
    every = _stats(df.groupBy(), features, "_g")
    return _applied(df, own, every, speaker, features, 1e-8)


def summary(aligner: DataFrame, features: list[str]) -> DataFrame:
    """A row per speaker: count, whether the population serves, and the means of the wanted features."""
    return aligner.where("speaker is not null").groupBy("speaker").agg(F.max("n").alias("n"), F.max("use_global").alias("using_global"), *[F.max(F.when(F.col("feature") == f, F.col("mean"))).alias(f"{f}_mean") for f in features])
