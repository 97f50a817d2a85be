"""Self-learning baselines of speakers: decayed sums and normalisation against what came before.

Adding rows one by one, with all sums multiplied by ``max_n / (max_n + 1)``
before each row once ``max_n`` is reached, has a closed form: with ``e`` decays
so far, ``S = d**e * (S0 + sum(a * d**-e))``. That makes the fold a window sum, and any stretch of rows one affine
map of the sums before it. Stretches are ranges of the rows by speaker and order, so a speaker of any size is spread over tasks.
Decay factors would overflow after some hundred thousand rows, so
a range's rows are taken in spans of ``SPAN`` decays: sums of a span are scaled to its own start, and its few spans are chained.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.operators import ranges as scans
from cadence.sources.tables import scratch

MEAN, STD, COLD, WARM, MAX_N, SPAN = 0.72, 0.19, 30, 100, 200, 20_000


def _factor(max_n: int) -> float:
    return max_n / (max_n + 1)


def _with_state(df: DataFrame, speaker: str, state: DataFrame | None) -> DataFrame:
    """Adds stored sums ``n0, s0, q0``, zero for speakers without any."""
    rows = df.where(F.col(speaker).isNotNull())
    if state is None:
        return rows.withColumns({"n0": F.lit(0.0), "s0": F.lit(0.0), "q0": F.lit(0.0)})
    old = state.select(F.col("speaker_id").alias("_sp"), F.col("n").alias("n0"), F.col("sum_a").alias("s0"), F.col("sum_sq_a").alias("q0"))
    return rows.join(old, F.col(speaker) == F.col("_sp"), "left").drop("_sp").na.fill(0.0, ["n0", "s0", "q0"])


def running(df: DataFrame, *, speaker: str, order_by: str, value: str = "arousal", state: DataFrame | None = None, max_n: int = MAX_N, ranges: int | None = None) -> DataFrame:
    """``df`` with ``n, sum_a, sum_sq_a`` before each row and ``n_after, sum_a_after, sum_sq_a_after``.

    Rows are dealt into ``ranges`` by speaker and order, each of which is one affine map of the sums before it. A speaker's rows may fill any number of
    ranges: the maps are chained, and what a range gets carried in is the state at its start. Rows of equal order keep the order in which they are read.
    """
    d = _factor(max_n)
    rows = scans.dealt(_with_state(df, speaker, state), [speaker, order_by], ranges)
    by = scans.inside(speaker, [order_by])
    rows = rows.withColumns({"_k": F.row_number().over(by), "_v": F.col(value).cast("double")})
    counts = scans.edges(rows, speaker, F.struct(F.count(F.lit(1)).alias("k")))
    places = scans.chained(counts, lambda held, own, _: {"_k0": (held["_k0"] if held else 0) + own["k"]})
    rows = scans.with_carried(rows, speaker, counts, places, "_k0 long").na.fill(0, ["_k0"])
    before = F.greatest(F.lit(0.0), F.ceil(F.lit(float(max_n)) - F.col("n0")))  # a speaker's rows without decay
    rows = rows.withColumn("_e", F.greatest(F.lit(0.0), F.col("_k0") + F.col("_k") - before) - F.greatest(F.lit(0.0), F.col("_k0") - before))  # decays since the range's start, up to and with the row
    rows = rows.withColumn("_span", F.floor(F.col("_e") / SPAN))
    scale = F.pow(F.lit(d), -(F.col("_e") - F.col("_span") * SPAN))
    part = Window.partitionBy(scans.RANGE, speaker, "_span").orderBy("_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"_1s": F.sum(scale).over(part), "_as": F.sum(scale * F.col("_v")).over(part), "_qs": F.sum(scale * F.col("_v") * F.col("_v")).over(part)})
    # The last running sums of a range's spans, at most one for SPAN rows.
    ends = rows.groupBy(scans.RANGE, speaker, "_span").agg(F.max_by(F.struct("_e", "_1s", "_as", "_qs"), "_k").alias("x"))
    ends = scratch(ends.select(scans.RANGE, speaker, "_span", "x.*"), "spans")
    found = scans.edges(ends, speaker, F.struct(F.max("_e").alias("e"), F.collect_list(F.struct("_span", "_1s", "_as", "_qs")).alias("spans")))
    starts = {r[scans.RANGE]: (r["n0"], r["s0"], r["q0"]) for r in rows.groupBy(scans.RANGE).agg(F.max_by(F.struct("n0", "s0", "q0"), F.struct(F.col(speaker))).alias("x")).select(scans.RANGE, "x.*").collect()} if state is not None else {}

    def add(held: dict | None, own: dict, at: int) -> dict:
        old = [held[c] for c in ("_cn", "_cs", "_cq")] if held else starts.get(at, (0.0, 0.0, 0.0))
        return {c: d ** own["e"] * o + sum(d ** (own["e"] - s["_span"] * SPAN) * s[x] for s in own["spans"]) for c, o, x in zip(("_cn", "_cs", "_cq"), old, ("_1s", "_as", "_qs"), strict=True)}

    rows = scans.with_carried(rows, speaker, found, scans.chained(found, add), "_cn double, _cs double, _cq double")
    rows = rows.withColumns({c: F.coalesce(c, z) for c, z in (("_cn", "n0"), ("_cs", "s0"), ("_cq", "q0"))})
    step = d**SPAN
    listed = ends.groupBy(F.col(scans.RANGE).alias("_r"), F.col(speaker).alias("_sp")).agg(F.sort_array(F.collect_list(F.struct("_span", "_1s", "_as", "_qs"))).alias("_l")).where(F.size("_l") > 1)
    zero = F.array(F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q")))

    def follow(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        return F.concat(acc, F.array(F.struct(((last["n"] + x["_1s"]) * step).alias("n"), ((last["s"] + x["_as"]) * step).alias("s"), ((last["q"] + x["_qs"]) * step).alias("q"))))

    spans = listed.select("_r", "_sp", F.aggregate("_l", zero, follow).alias("_c"))  # what each span gets from those before it in the range
    rows = rows.join(spans, (F.col(scans.RANGE) == F.col("_r")) & (F.col(speaker) == F.col("_sp")), "left")
    own = F.element_at("_c", (F.col("_span") + 1).cast("int"))
    back, whole = F.pow(F.lit(d), F.col("_e") - F.col("_span") * SPAN), F.pow(F.lit(d), F.col("_e"))
    after = {name: whole * F.col(c) + back * (F.coalesce(own[x], F.lit(0.0)) + F.col(s)) for name, c, x, s in (("n_after", "_cn", "n", "_1s"), ("sum_a_after", "_cs", "s", "_as"), ("sum_sq_a_after", "_cq", "q", "_qs"))}
    rows = rows.withColumns(after)
    prior = {a: F.coalesce(F.lag(f"{a}_after").over(by), F.col(c)) for a, c in (("n", "_cn"), ("sum_a", "_cs"), ("sum_sq_a", "_cq"))}
    return rows.withColumns(prior).select(*df.columns, *prior, *after)


def moments(n: Column, s: Column, q: Column) -> tuple[Column, Column]:
    """Mean and population deviation; null for no rows."""
    mean = F.when(n > 0, s / n)
    return mean, F.when(n > 0, F.sqrt(F.greatest(F.lit(0.0), q / n - mean * mean)))


def normalised(rows: DataFrame, value: str = "arousal", *, mean: float = MEAN, std: float = STD, cold: int = COLD, warm: int = WARM) -> DataFrame:
    """Adds ``arousal_z, baseline_conf, using_individual`` from the state before each row: the population's figures for new speakers, a blend, then the speaker's own."""
    n = F.col("n")
    own_mean = F.when(n > 0, F.col("sum_a") / n)
    variance = F.when(n > 0, F.col("sum_sq_a") / n - own_mean * own_mean)
    share = (n - cold) / float(warm - cold)
    blend_mean = share * own_mean + (1 - share) * mean
    blend_std = share * F.sqrt(F.greatest(variance, F.lit(1e-8))) + (1 - share) * std
    full_std = F.greatest(F.sqrt(F.greatest(variance, F.lit(1e-8))), F.lit(0.05))
    z = lambda m, s: (F.col(value) - m) / s
    return rows.withColumns({
        "arousal_z": F.when(n < cold, z(F.lit(mean), F.lit(std))).when(n < warm, z(blend_mean, blend_std)).otherwise(z(own_mean, full_std)),
        "baseline_conf": F.when(n < cold, "low").when(n < warm, "medium").otherwise("high"),
        "using_individual": n >= cold,
    })


def process(df: DataFrame, *, speaker: str, order_by: str, update: bool = True, state: DataFrame | None = None) -> DataFrame:
    """Normalise each row; with ``update`` later rows see earlier ones, else all see the stored state."""
    if update:
        return normalised(running(df, speaker=speaker, order_by=order_by, state=state))
    rows = _with_state(df, speaker, state).withColumns({"n": F.col("n0"), "sum_a": F.col("s0"), "sum_sq_a": F.col("q0")})
    return normalised(rows.select(*df.columns, "n", "sum_a", "sum_sq_a"))


def final_state(df: DataFrame, *, speaker: str, order_by: str, value: str = "arousal", state: DataFrame | None = None, max_n: int = MAX_N) -> DataFrame:
    """``speaker_id, n, sum_a, sum_sq_a`` after all rows; speakers without rows keep their stored state."""
    rows = running(df, speaker=speaker, order_by=order_by, value=value, state=state, max_n=max_n)
    last = F.max_by(F.struct(F.col("n_after").alias("n"), F.col("sum_a_after").alias("sum_a"), F.col("sum_sq_a_after").alias("sum_sq_a")), order_by)
    new = rows.groupBy(F.col(speaker).cast("string").alias("speaker_id")).agg(last.alias("x")).select("speaker_id", "x.*")
    return new if state is None else new.unionByName(state.join(new, "speaker_id", "left_anti").select(*new.columns))


def summary(state: DataFrame, *, cold: int = COLD, warm: int = WARM) -> DataFrame:
    m, s = moments(F.col("n"), F.col("sum_a"), F.col("sum_sq_a"))
    stage = F.when(F.col("n") < cold, "cold").when(F.col("n") < warm, "warm").otherwise("stable")
    return state.select("speaker_id", "n", m.alias("mean"), s.alias("std"), stage.alias("stage"))


def classify_with_baseline(df: DataFrame, *, speaker: str, order_by: str, keys: tuple[str, ...] = (), state: DataFrame | None = None) -> DataFrame:
    """States by the frame's thresholds, with confidences lowered by each speaker's baseline."""
    from cadence.functions.scalar import exertion_z
    from cadence.operators import rules

    rows = process(rules.classify(df, keys), speaker=speaker, order_by=order_by, state=state)
    return rows.withColumns({"exertion_z": exertion_z(F.col("exertion")), "confidence": rules.downgraded(F.col("confidence"), F.col("baseline_conf"))})
