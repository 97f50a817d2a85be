"""Vectors of a table: which take part, their numbers, and a stated query set dealt against all rows in blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import Workspace


def usable(vector: str, factor: float = 1.0) -> Column:
    """Not null, and no component null or, ``factor`` times, non-finite."""
    return F.coalesce(F.col(vector).isNotNull() & F.forall(F.col(vector), lambda x: x.isNotNull() & (F.abs(x.cast("double") * factor) < float("inf")) & ~F.isnan(x.cast("double"))), F.lit(False))


def numbered(df: DataFrame, ws: Workspace, name: str) -> tuple[DataFrame, int]:
    """The frame, written with a number ``row`` for each row (so that equal rows and rows of one id are told apart), and its size."""
    out = ws.put(df.withColumn("row", F.monotonically_increasing_id()), name)
    return out, out.count()


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as doubles."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), float).reshape(len(flat), -1)


def by_width(table: pa.Table, vector: str) -> dict[int, pa.Table]:
    """Rows apart by the length of their vectors: those of different lengths are not compared."""
    if not table.num_rows:  # a side without rows may come without columns
        return {}
    widths = np.asarray(table[vector].combine_chunks().value_lengths())
    return {int(w): table.filter(pa.array(widths == w)) for w in np.unique(widths)}


def sort_ids(ids: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """``(null, id)`` to sort by: nulls last."""
    null = np.asarray(ids.is_null())
    return null, np.asarray(ids.fill_null(0)).astype(np.int64)


def in_blocks(rows: DataFrame, n_rows: int, asked: DataFrame, n_asked: int, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, *, stripes: int = 48, stripe_rows: tuple[int, int] = (1024, 32768), asked_rows: int = 4096) -> DataFrame:
    """``run`` on every pair of a stripe of rows and a block of the asked; both have a column ``row`` and are read from tables of
    their own (columns of one table on both sides of a cogroup would be taken for the same).

    Stripes are dealt by a hash of the row's number, so neither a hot label nor a hot vector makes one larger, and hold between the two
    bounds of ``stripe_rows``; the number of pairs of rows looked at is what the query set states, and only what ``run`` returns becomes rows.
    """
    size = min(max(-(-n_rows // stripes), stripe_rows[0]), stripe_rows[1])
    n_stripes, n_blocks = max(1, -(-n_rows // size)), max(1, -(-n_asked // asked_rows))
    left = rows.withColumns({"stripe": F.pmod(F.xxhash64("row"), F.lit(n_stripes)).cast("int"), "block": F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))})
    right = asked.withColumns({"block": F.pmod(F.xxhash64("row", F.lit(1)), F.lit(n_blocks)).cast("int"), "stripe": F.explode(F.sequence(F.lit(0), F.lit(n_stripes - 1)))})
    return left.groupBy("stripe", "block").cogroup(right.groupBy("stripe", "block")).applyInArrow(run, schema)
