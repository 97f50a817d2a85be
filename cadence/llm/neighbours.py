"""Approximate nearest neighbours by collision counting on single projections.

A stripe of rows keeps one sorted array for each random projection. A query opens a window
around its own value in every array; a row that lies in at least ``need`` of the windows is verified with its exact cosine. For the
radius R a window reaches ``WIDTH * R`` to either side, so a row within R of the query lies in a window with a probability of
at least P1, whatever the data, and ``need`` is set such that it is missed with a probability of about ``miss``. Windows are widened by virtual
rehashing: R doubles until ``k`` rows are verified, then becomes the distance of the running k-th, at which the query is done. Only
the rings that a round adds are counted.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadence.llm.common import Workspace
from cadence.llm.vectors import by_width, in_blocks, matrix, numbered, sort_ids, usable

WIDTH = 1.15
P1 = 2 * NormalDist().cdf(WIDTH) - 1
FIRST = 0.25  # of the unit vectors' distances, which end at 2


def needed(projections: int, miss: float) -> int:
    """Collisions from which a row is verified: a row within the radius has fewer with a probability of ``miss``."""
    return max(1, math.floor(projections * P1 + NormalDist().inv_cdf(miss) * math.sqrt(projections * P1 * (1 - P1))))


def _scaled(x: np.ndarray) -> np.ndarray:
    """By a power of two for each row, so that squares neither overflow nor vanish; cosines stay the same to the last bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


class Arrays:
    """A sorted array for each projection of a stripe's unit vectors."""

    def __init__(self, unit: np.ndarray, projections: int, seed: int):
        self.n = len(unit)
        self.axes = np.random.default_rng(seed).standard_normal((unit.shape[1], projections))
        values = (unit @ self.axes).T
        self.order = np.argsort(values, axis=1, kind="stable")
        self.values = np.take_along_axis(values, self.order, axis=1)
        self.flat = self.order.ravel()

    def windows(self, at: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last positions (excluded) of the windows, by query and projection."""
        low = np.stack([np.searchsorted(v, a - reach, "left") for v, a in zip(self.values, at.T, strict=True)], axis=1)
        high = np.stack([np.searchsorted(v, a + reach, "right") for v, a in zip(self.values, at.T, strict=True)], axis=1)
        return low, high

    def count(self, start: np.ndarray, stop: np.ndarray, base: np.ndarray) -> np.ndarray:
        """How often each row lies in the given pieces of the arrays."""
        size = np.maximum(stop - start, 0)
        ends = np.cumsum(size)
        at = np.repeat(base + start - (ends - size), size) + np.arange(ends[-1])
        return np.bincount(self.flat[at], minlength=self.n)


def search_stripe(rows: pa.Table, asked: pa.Table, k: int, projections: int, miss: float, seed: int, growth: float) -> dict[str, list]:
    """The ``k`` nearest of a stripe's rows for every asked one, all verified by their exact cosine."""
    out: dict[str, list] = {"query": [], "vec_id": [], "row": [], "score": []}
    x, q = _scaled(matrix(rows["v"])), _scaled(matrix(asked["v"]))
    norms, q_norms = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
    unit, q_unit = x / norms[:, None], q / q_norms[:, None]
    numbers, q_numbers = np.asarray(rows["row"]), np.asarray(asked["row"])
    null, ids = sort_ids(rows["vec_id"])
    arrays = Arrays(unit, projections, seed)
    at, base = q_unit @ arrays.axes, np.arange(projections) * arrays.n
    need = needed(projections, miss)
    counts = np.zeros((len(q), len(x)), np.int16)
    first = np.stack([np.searchsorted(v, a) for v, a in zip(arrays.values, at.T, strict=True)], axis=1)
    low, high = first.copy(), first.copy()
    radius = np.full(len(q), FIRST)
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(q)
    active = np.arange(len(q))
    while len(active):
        reach = np.where(radius[active] > 2, np.inf, WIDTH * radius[active])
        new_low, new_high = arrays.windows(at[active], reach)
        new_low, new_high = np.minimum(new_low, low[active]), np.maximum(new_high, high[active])
        open_ = []
        for i, a, b in zip(active, new_low, new_high, strict=True):
            before = counts[i] >= need
            pieces = (np.concatenate([a, high[i]]), np.concatenate([low[i], b]), np.concatenate([base, base]))
            counts[i] += arrays.count(*pieces).astype(np.int16)
            fresh = np.flatnonzero((counts[i] >= need) & ~before & (numbers != q_numbers[i]))
            scores = (x[fresh] * q[i]).sum(axis=1) / (norms[fresh] * q_norms[i])
            fresh, scores = np.concatenate([found[i][0], fresh]), np.concatenate([found[i][1], scores])
            best = np.lexsort((numbers[fresh], ids[fresh], null[fresh], -scores))[:k]
            found[i] = fresh[best], scores[best]
            done = radius[i] > 2
            if len(best) == k and not done:
                far = math.sqrt(max(0.0, 2 - 2 * scores[best[-1]]))
                done = far <= radius[i]
                radius[i] = far if not done else radius[i]
            elif not done:
                radius[i] *= growth
            if not done:
                open_.append(i)
        low[active], high[active] = new_low, new_high
        active = np.asarray(open_, np.int64)
    for i, (at_rows, scores) in enumerate(found):
        out["query"] += [int(q_numbers[i])] * len(at_rows)
        out["vec_id"] += [None if null[j] else int(ids[j]) for j in at_rows]
        out["row"] += numbers[at_rows].tolist()
        out["score"] += scores.tolist()
    return out


def nearest(df: DataFrame, *, k: int = 5, every: int = 50, id_col: str = "vec_id", vector: str = "embedding", projections: int = 96, miss: float = 0.1, seed: int = 11, growth: float = 2.0) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of largest cosine found for each row whose id is divisible by ``every``, every row but itself a candidate.

    Every row is in the index, and no candidate is capped or sampled. A stripe's search ends at the distance of its own k-th row, so a
    row is missed only where it has fewer collisions than ``needed``; those rows that are returned have exact scores.

    Null vectors, zero ones, those without components and those with null or non-finite ones take no part. Vectors of another length than the query's are
    not its candidates. Rows without an id are candidates, after all others on ties, and ask nothing. Repeated rows, and rows that share
    an id, are rows of their own: each asks, and each is found. Equal scores go by id, then by the row's number as read. An empty table
    gives an empty result. Other columns are not read, whatever their names; vectors of any length are whole.
    """
    ws = Workspace(df.sparkSession, "neighbours")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("v")).where(usable("v") & F.exists("v", lambda x: x != 0))
    rows, n = numbered(rows, ws, "rows")
    asked = ws.put(rows.where(F.col("vec_id") % every == 0), "asked")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query": [], "vec_id": [], "row": [], "score": []}
        others = by_width(right, "v")
        for width, part in by_width(left, "v").items():
            if width in others:
                for name, values in search_stripe(part, others[width], k, projections, miss, seed, growth).items():
                    out[name] += values
        return pa.table({"query": pa.array(out["query"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "row": pa.array(out["row"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    found = in_blocks(rows, n, asked, asked.count(), run, "query long, vec_id long, row long, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row"))
    top = found.withColumn("rank", rank).where(F.col("rank") <= k)
    names = asked.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return top.join(names, "query").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
