"""Exact percentiles, interpolated linearly.

A small input is one aggregate. Beyond ``one_pass`` bytes no task may hold all distinct values, so wanted
ranks are found by counting: how many values fall into each of BUCKETS equal stretches between a group's
least and greatest, then the same inside the few stretches that hold a wanted rank, then
the values themselves there. Each count is an aggregate with partial sums in every task, so a group with a third
of all rows sends each task's counts only.

Nulls and NaN don't count; a group without values has nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[f"_{k}"])
    return out


def _named(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in df.columns if c not in keys])


def _cumulated(counts: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys, F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn("_to", F.sum("_n").over(w)).withColumn("_from", F.col("_to") - F.col("_n"))


def _pick(wanted: DataFrame, counts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The stretch (or value) of each wanted rank, and its rank there."""
    held = _named(_cumulated(counts, keys, order).drop("_n"), keys)
    hit = wanted.join(held, _same(wanted, held, keys) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    return hit.withColumn("_rank", F.col("_rank") - F.col("_from")).drop(*[f"_{k}" for k in keys], "_from", "_to")


def percentiles(df: DataFrame, value: str, shares: list[float], keys: tuple[str, ...] | list[str] = (), *, one_pass: int = 1 << 28) -> DataFrame:
    """``keys, percentiles`` (an array in the order of ``shares``), a row for each group; without keys one row."""
    keys = list(keys)
    rows = df.select(*[F.col(k) for k in keys], F.col(value).cast("double").alias("_v"))
    if int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= one_pass:
        known = F.when(~F.isnan("_v"), F.col("_v"))
        return rows.groupBy(*keys).agg(F.percentile(known, F.array(*[F.lit(s) for s in shares])).alias("percentiles"))
    rows = rows.where("_v is not null and not isnan(_v)")
    ends = rows.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    asked = F.array(*[F.struct(F.lit(i).alias("_i"), (F.lit(float(s)) * (F.col("_n") - 1)).alias("_at")) for i, s in enumerate(shares)])
    wanted = ends.where("_n > 0").select(*keys, F.explode(asked).alias("_a")).select(*keys, "_a.*")
    wanted = wanted.select(*keys, "_i", "_at", F.explode(F.array(F.floor("_at"), F.ceil("_at"))).alias("_rank")).distinct().withColumn("_whole", F.col("_rank"))
    lims = _named(ends.drop("_n"), keys)
    left = rows.join(lims, _same(rows, lims, keys)).drop(*[f"_{k}" for k in keys])
    for level in (1, 2):
        share = F.nanvl(F.coalesce(F.try_divide(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)), F.lit(0.0)) * BUCKETS
        share = share if level == 1 else (share - F.col("_b1")) * BUCKETS
        left = left.withColumn(f"_b{level}", F.least(F.lit(BUCKETS - 1), F.greatest(F.lit(0), F.floor(share))).cast("int"))
        group = [*keys, *[f"_b{k}" for k in range(1, level)]]
        wanted = _pick(wanted, left.groupBy(*group, f"_b{level}").agg(F.count(F.lit(1)).alias("_n")), group, f"_b{level}")
        held = [*keys, *[f"_b{k}" for k in range(1, level + 1)]]
        some = _named(wanted.select(*held).distinct(), held)
        left = left.join(some, _same(left, some, held), "left_semi")
    group = [*keys, "_b1", "_b2"]
    values = left.groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_n"))
    found = _pick(wanted, values, group, "_v").groupBy(*keys, "_i", "_at").agg(F.min("_v").alias("_x"), F.max("_v").alias("_y"))
    each = found.select(*keys, F.struct("_i", (F.col("_x") + (F.col("_y") - F.col("_x")) * (F.col("_at") - F.floor("_at"))).alias("_p")).alias("_s"))
    out = each.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list("_s")), lambda s: s["_p"]).alias("percentiles"))
    if not keys:
        return out.select(F.when(F.size("percentiles") > 0, F.col("percentiles")).alias("percentiles"))
    every = df.select(*keys).distinct()
    got = _named(out, keys)
    return every.join(got, _same(every, got, keys), "left").select(*[every[k] for k in keys], "percentiles")
