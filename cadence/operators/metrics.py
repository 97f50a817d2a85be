"""Regression metrics, importance of features, and splits. Denominators are tested, since division by zero is an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.functions import taxonomy


def ccc(y: str, p: str) -> Column:
    """Concordance correlation from population moments; 0 where nothing varies."""
    gap = F.avg(y) - F.avg(p)
    below = F.var_pop(y) + F.var_pop(p) + gap * gap
    return F.when(below < 1e-12, F.lit(0.0)).otherwise(2 * F.covar_pop(y, p) / below)


def metric_pack(df: DataFrame, y: str, p: str, keys: tuple[str, ...] = ()) -> DataFrame:
    e = F.col(y) - F.col(p)
    sst = F.var_pop(y) * F.count(y)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        (1 - F.try_divide(F.sum(e * e), sst)).alias("r2"),
        F.avg(e * e).alias("mse"),
        F.avg(F.abs(e)).alias("mae"),
        ccc(y, p).alias("ccc"),
        F.corr(y, p).alias("pearson"),
        F.avg(y).alias("mean_true"),
        F.stddev_pop(y).alias("std_true"),
        F.avg(p).alias("mean_pred"),
        F.stddev_pop(p).alias("std_pred"),
    )


def contributions(df: DataFrame, id_cols: list[str], features: list[str], values: dict[str, str] | None = None) -> DataFrame:
    """``id_cols, pos, feature, contribution, value``: one row per feature."""
    values = values or {}
    rows = [F.struct(F.lit(i).alias("pos"), F.lit(f).alias("feature"), F.col(f"`{f}`").cast("double").alias("contribution"), (F.col(f"`{values[f]}`") if f in values else F.lit(None)).cast("double").alias("value")) for i, f in enumerate(features)]
    return df.select(*id_cols, F.explode(F.array(*rows)).alias("x")).select(*id_cols, "x.*")


def top_reasons(df: DataFrame, features: list[str], k: int = 3, prefix: str = "") -> Column:
    """``feat↑(+0.123) | …`` of the largest contributions by size, in columns named by ``prefix`` and feature; ties in column order."""
    rows = F.array(*[F.struct(-F.abs(F.col(f"`{prefix}{f}`").cast("double")).alias("a"), F.lit(i).alias("i"), F.lit(f.split("_")[0]).alias("f"), F.col(f"`{prefix}{f}`").cast("double").alias("c")) for i, f in enumerate(features)])
    best = F.slice(F.array_sort(rows), 1, k)
    return F.array_join(F.transform(best, lambda x: F.concat(x["f"], F.when(x["c"] > 0, F.lit("↑")).otherwise(F.lit("↓")), F.format_string("(%+.3f)", x["c"]))), " | ")


def top_map(features: list[str], k: int = 5) -> Column:
    """The largest contributions as a map; ties in reverse column order."""
    rows = F.array(*[F.struct(-F.abs(F.col(f"`{f}`").cast("double")).alias("a"), F.lit(-i).alias("i"), F.lit(f).alias("f"), F.col(f"`{f}`").cast("double").alias("c")) for i, f in enumerate(features)])
    return F.map_from_entries(F.transform(F.slice(F.array_sort(rows), 1, k), lambda x: F.struct(x["f"], x["c"])))


def global_importance(long: DataFrame, top: int = 30) -> DataFrame:
    """``rank, feature, contribution, direction``: mean size of contributions, and whether they rise with the feature's value."""
    c = F.corr("contribution", "value")
    by = long.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("contribution"), F.min("pos").alias("pos"), F.when((c > 0) & ~F.isnan(c), "+").otherwise("-").alias("direction"))
    rank = F.row_number().over(Window.orderBy(F.desc("contribution"), "pos"))  # a row per feature
    return by.withColumn("rank", rank).where(F.col("rank") <= top).select("rank", "feature", "contribution", "direction", taxonomy.first_group(F.col("feature")).alias("grp"))


def group_importance(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy("grp").agg(F.sum("contribution").alias("contribution")).orderBy(F.desc("contribution"), "grp")


def hash_split(df: DataFrame, id_col: str, percent: int = 80, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test by a hash of the id, the same whatever the partitions."""
    part = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(100))
    return df.where(part < percent), df.where(part >= percent)


def loso_folds(df: DataFrame, speaker: str, order_by: str, n_folds: int = 7) -> DataFrame:
    """``fold, speaker, n_train, n_test`` for the first speakers by appearance. Sizes follow from counts, rows are not paired with folds."""
    by = df.groupBy(F.col(speaker).alias("speaker")).agg(F.min(order_by).alias("_at"), F.count(F.lit(1)).alias("n_test"))
    total = df.agg(F.count(F.lit(1)).alias("_all"))
    first = by.orderBy("_at", "speaker").limit(n_folds)
    fold = F.row_number().over(Window.orderBy("_at", "speaker")) - 1
    return first.crossJoin(total).select(fold.alias("fold"), "speaker", (F.col("_all") - F.col("n_test")).alias("n_train"), "n_test")


def fold_rows(df: DataFrame, speaker: str, held: str | int) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(speaker) != held), df.where(F.col(speaker) == held)
