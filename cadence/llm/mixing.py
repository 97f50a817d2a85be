"""Mixing sources to target weights by Sainte-Laguë apportionment.

Everything here is DataFrame expressions. The documents of a source are laid
out, shard by shard, in a seeded order as one stream of words. Streams are cut
into blocks of ``block_words``. Every source's target is turned into a number
of blocks by the divisor method of Sainte-Laguë (the highest quotients
``target / (2 s + 1)`` win), and a source's blocks are dealt to its shards the
same way. Each shard then takes a seeded run of its blocks, twice round at most.

Defined cases: null or empty text has size 0 and is never taken; a null source
is a source of its own, last in order; rows that repeat, or share an id or have none, are rows of their own, and
those equal in id and text may stand for each other; texts of any length are whole; ties between quotients go to the lower source or shard;
an empty table gives an empty result; other columns are ignored by :func:`mix` and carried by :func:`mixed_documents`, whatever their names.
All sources, a row for each, meet in one window, and the shards of a source in bundles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.llm.common import WORD_BYTES, Workspace

WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_BYTES)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``source, source_size, target`` from ``source, size``.

    Sharing by weight, with what exceeds a cap shared anew until none is above,
    ends at ``least(cap, weight * level)`` for one level. Sorting the sources by
    ``cap / weight`` gives the level from running sums, without iterating. One
    row per source is all that meets in the unpartitioned window.
    """
    by = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    w = F.array(*[F.lit(float(x)) for x in weights])
    t = (
        by.withColumn("_w", F.get(w, ((F.row_number().over(order) - 1) % len(weights)).cast("int")))
        .withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
        .withColumn("_r", F.col("_cap") / F.col("_w"))
    )
    tie = Window.orderBy("_r", F.col("source").cast("binary").asc_nulls_last())
    before, everything = tie.rowsBetween(Window.unboundedPreceding, -1), tie.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = (
        t.withColumn("_total", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("_full", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_rest", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_try", (F.col("_total") - F.col("_full")) / F.col("_rest"))
        .withColumn("_no", F.row_number().over(tie))
    )
    first = F.min(F.when(F.col("_try") <= F.col("_r"), F.struct("_no", "_try"))).over(everything)  # all before it are full
    level = first["_try"]
    return t.withColumn("target", F.least(F.col("_cap"), F.coalesce(F.col("_w") * level, F.col("_cap")))).select("source", "source_size", "target")


def sainte_lague(parts: DataFrame, group: list[str], weight: str, seats: str, tie: str, out: str) -> DataFrame:
    """Seats for each row of ``parts``: within ``group``, ``seats`` (the same in all rows of a group) go to the highest quotients ``weight / (2 s + 1)``.

    Rounding ``weight / (sum / seats)`` is off by at most half the group's rows
    in all. So only the quotients near that start are listed and ranked, a few
    for each row, not one for each seat. Ties go to the lower ``tie``.
    """
    g = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    t = parts.withColumn("_sum", F.sum(weight).over(g)).withColumn("_n", F.count(F.lit(1)).over(g))
    t = t.withColumn("_ideal", F.when(F.col("_sum") > 0, F.col(weight) * F.col(seats) / F.col("_sum")).otherwise(F.lit(0.0)))
    t = t.withColumn("_start", F.floor(F.col("_ideal") + 0.5).cast("long"))
    t = t.withColumn("_span", (F.ceil(F.when(F.col("_sum") > 0, F.col(weight) / F.col("_sum")).otherwise(F.lit(0.0)) * (2 * F.col("_n"))) + 2).cast("long"))
    t = t.withColumn("_low", F.greatest(F.lit(0).cast("long"), F.col("_start") - F.col("_span")))
    t = t.withColumn("_left", (F.col(seats) - F.sum("_low").over(g)).cast("long"))
    seat = t.withColumn("_seat", F.explode(F.sequence(F.col("_low"), F.col("_start") + F.col("_span"))))
    rank = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy(F.col("_q").desc(), F.col(tie).asc_nulls_last(), "_seat")
    seat = seat.withColumn("_q", F.col(weight) / (2 * F.col("_seat") + 1)).withColumn("_rank", F.row_number().over(rank))
    keep = list(parts.columns)
    won = F.sum(F.when((F.col("_rank") <= F.col("_left")) & (F.col(weight) > 0), 1).otherwise(0))
    return seat.groupBy(*keep).agg((F.first("_low") + won).cast("long").alias(out))


#: So many shards at most are ranked together; larger sources deal their blocks to bundles of shards first.
BUNDLE = 1024


def _quotas(sizes: DataFrame, targets: DataFrame, ws: Workspace, block_words: int, seed: int) -> DataFrame:
    """Per source and shard (``_s, _h``) its size, whole turns, the words of the turn that is begun, and where that starts."""
    shards = sizes.groupBy("source", "shard").agg(F.sum("size").cast("long").alias("shard_size")).withColumn("bundle", F.floor(F.col("shard") / BUNDLE))
    quota = targets.withColumn("_all", F.floor(F.sum("target").over(Window.partitionBy(F.lit(0))) / block_words + 0.5).cast("long"))
    quota = sainte_lague(quota, [], "target", "_all", "source", "_blocks")
    bundles = shards.groupBy("source", "bundle").agg(F.sum("shard_size").cast("long").alias("bundle_size"))
    bundles = bundles.join(quota.select(F.col("source").alias("_s"), "_blocks"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    bundles = sainte_lague(bundles, ["source"], "bundle_size", "_blocks", "bundle", "_held").select(F.col("source").alias("_s"), F.col("bundle").alias("_b"), "_held")
    per = shards.join(bundles, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bundle") == F.col("_b"))).drop("_s", "_b")
    per = sainte_lague(per, ["source", "bundle"], "shard_size", "_held", "shard", "_quota")
    size, words = F.col("shard_size"), F.least(F.col("_quota") * block_words, 2 * F.col("shard_size"))
    per = (
        per.withColumn("_words", words)
        .withColumn("_turns", F.when(size > 0, F.expr("_words div shard_size")).otherwise(F.lit(0).cast("long")))
        .withColumn("_more", F.col("_words") - F.col("_turns") * size)
        .withColumn("_from", F.when(size > 0, F.pmod(F.xxhash64(F.lit(seed + 2), "source", "shard"), F.ceil(size / block_words).cast("long")) * block_words).otherwise(F.lit(0).cast("long")))
    )
    return ws.put(per.select(F.col("source").alias("_s"), F.col("shard").alias("_h"), "shard_size", "_turns", "_more", "_from"), "shards")


def _laid(docs: DataFrame, carry: bool, weights: tuple[int, ...], share: float, cap: float, block_words: int, shard_words: int, seed: int) -> DataFrame:
    spark = docs.sparkSession
    ws = Workspace(spark, "mix")
    base = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("_place"), F.xxhash64(F.lit(seed + 1), "doc_id", "text").alias("_deal"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")] if carry else []))
    sizes = ws.put(base.drop("_doc"), "sizes")
    targets = ws.put(source_targets(sizes, weights, share, cap).withColumn("_shards", F.ceil(F.col("source_size") / F.lit(float(shard_words))).cast("long")), "targets")

    def dealt(rows: DataFrame) -> DataFrame:
        rows = rows.join(targets, rows["source"].eqNullSafe(targets["source"]), "inner").drop(targets["source"])
        return rows.withColumn("shard", F.when(F.col("_shards") > 1, F.pmod("_deal", F.col("_shards"))).otherwise(F.lit(0).cast("long")))

    per = _quotas(dealt(sizes), targets, ws, block_words, seed)
    stream = Window.partitionBy("source", "shard").orderBy("_place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = dealt(base if carry else sizes).withColumn("_end", F.sum("size").over(stream)).withColumn("_start", F.col("_end") - F.col("size"))
    laid = laid.join(per, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_h")), "left")

    def overlap(low: Column, high: Column) -> Column:
        return F.greatest(F.lit(0).cast("long"), F.least(F.col("_end"), high) - F.greatest(F.col("_start"), low))

    stop = F.col("_from") + F.col("_more")
    part = overlap(F.col("_from"), F.least(stop, F.col("shard_size"))) + overlap(F.lit(0).cast("long"), stop - F.col("shard_size"))
    return laid.withColumn("taken", F.coalesce(F.col("_turns") * F.col("size") + part, F.lit(0).cast("long")).cast("long"))


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, block_words: int = 64, shard_words: int = 1 << 20, seed: int = 17) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, source, size, source_size, target, taken``.

    Texts are read once and never shuffled: a table of sizes is written to the
    shared folder first. Sources and shards are joined to it as small tables;
    Spark broadcasts them only below its own size limit, else it splits a hot
    source's rows with a skewed join.
    """
    laid = _laid(docs, False, weights, share, cap, block_words, shard_words, seed)
    return laid.select("doc_id", "source", "size", "source_size", F.col("target").cast("double"), "taken")


def mixed_documents(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, block_words: int = 64, shard_words: int = 1 << 20, seed: int = 17) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it: its words taken, rounded to whole copies. All columns are kept, whatever their names and whatever the ids."""
    laid = _laid(docs, True, weights, share, cap, block_words, shard_words, seed)
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.nullif(F.col("size"), F.lit(0).cast("long")))).otherwise(F.lit(0)).cast("int")
    return laid.where("taken > 0").select("_doc", F.explode(F.array_repeat(F.lit(1), copies)).alias("_copy")).select("_doc.*")
