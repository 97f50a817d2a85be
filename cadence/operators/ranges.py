"""Ordered scans over ranges of rows, for keys of any size.

Rows are sorted by key and order and dealt into ranges of about equal size, so a key with most of the rows spans many
tasks. A range sums up what it passes on; the driver chains those summaries, one row for each range, and each range's first key gets what the ranges
before it carry in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGE, ROW = "_range", "_at"


def dealt(df: DataFrame, order: list[str], n: int | None = None) -> DataFrame:
    """``df``, written once (ranges are drawn from a sample, so they are fixed first), with its ``_range`` and a number ``_at`` by which equal rows keep an order. Ranges follow each other in order."""
    from cadence.sources.tables import scratch

    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn(ROW, F.monotonically_increasing_id())
    return scratch(rows.repartitionByRange(n, *[F.col(c) for c in [*order, ROW]]).withColumn(RANGE, F.spark_partition_id()), "ranges")


def inside(key: str, order: list[str]) -> WindowSpec:
    """The rows of a key in a range, in order."""
    return Window.partitionBy(RANGE, key).orderBy(*order, ROW)


def edges(rows: DataFrame, key: str, summary: Column) -> list[dict]:
    """``_range, first, last, summary`` of each range: the keys at its ends and the summary of the last key's rows, one row a range."""
    by = rows.groupBy(RANGE, key).agg(summary.alias("summary"))
    who = F.struct(F.col(key).alias("k"))  # a struct, so that a null key counts, as the first
    ends = by.groupBy(RANGE).agg(F.min(who).alias("first"), F.max(who).alias("last"), F.max_by("summary", who).alias("summary"))
    found = [r.asDict(True) for r in ends.orderBy(RANGE).collect()]
    return [{**e, "first": e["first"]["k"], "last": e["last"]["k"]} for e in found]


def chained(found: list[dict], add: Callable[[dict | None, dict, int], dict]) -> dict[int, dict]:
    """What each range gets for its first key: ``add(carried or None, summary, range)`` over those ranges before it that hold this key."""
    out, key, held = {}, None, None
    for e in found:
        if held is not None and e["first"] == key:
            out[e[RANGE]] = held
        before = held if held is not None and e["first"] == key == e["last"] else None
        held, key = add(before, e["summary"], e[RANGE]), e["last"]
    return out


def with_carried(rows: DataFrame, key: str, found: list[dict], carried: dict[int, dict], schema: str) -> DataFrame:
    """Rows with the columns of ``schema``: what is carried into their range for its first key, null elsewhere. What is sent to all tasks has a row for each range."""
    fields = T.StructType.fromDDL(schema)
    first = {e[RANGE]: e["first"] for e in found}
    kinds = T.StructType([T.StructField("_r", T.IntegerType()), T.StructField("_f", rows.schema[key].dataType), *fields])
    table = rows.sparkSession.createDataFrame([(r, first[r], *[v[n] for n in fields.names]) for r, v in carried.items()], kinds)
    return rows.join(F.broadcast(table), (F.col(RANGE) == F.col("_r")) & F.col(key).eqNullSafe(F.col("_f")), "left").drop("_r", "_f")


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Rows numbered from 0 in order: ranges are numbered each for itself, after the counts of those before."""
    rows = dealt(df, order)
    before, offsets = 0, []
    for r in rows.groupBy(RANGE).count().orderBy(RANGE).collect():
        offsets.append((r[RANGE], before))
        before += r["count"]
    table = rows.sparkSession.createDataFrame(offsets, "_r int, _o long")
    own = F.row_number().over(Window.partitionBy(RANGE).orderBy(*order, ROW)) - 1
    return rows.withColumn("_n", own).join(F.broadcast(table), F.col(RANGE) == F.col("_r")).withColumn(out, F.col("_n") + F.col("_o")).drop(RANGE, ROW, "_n", "_r", "_o")
