"""Hard negatives by norm-bucketed search.

A stripe's candidates are sorted by norm and cut into buckets. No candidate of a bucket scores above
the anchor's norm times the bucket's largest (Cauchy-Schwarz), so an anchor leaves a bucket, and all that follow, once that bound is under the
lower limit or the running k-th score of every window it still has open. All scores are exact integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.llm.common import Workspace
from cadence.llm.vectors import by_width, in_blocks, matrix, numbered, sort_ids, usable

BUCKET = 512
LONG = (-(2**63), 2**63 - 1)


def _exact(x: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in a type in which their inner products are exact: doubles, longs, or Python's integers for larger ones."""
    bound = x.shape[1] * float(np.abs(x).max(initial=0)) * float(np.abs(a).max(initial=0))
    if bound < 2**53:
        return x, a
    if bound < 2**62:
        return x.astype(np.int64), a.astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return whole(x), whole(a)


def _norms(x: np.ndarray) -> np.ndarray:
    size = np.abs(x).max(axis=1, initial=0)
    size = np.where(size > 0, size, 1)
    return np.sqrt(((x / size[:, None]) ** 2).sum(axis=1)) * size


class Running:
    """The running first ``k`` of one window: scores from ``low`` to ``high``, higher ones first, then smaller ids."""

    def __init__(self, low: int | None, high: int | None, k: int):
        self.low, self.high, self.k, self.best = low, high, k, []

    def floor(self):
        """What a candidate must score at least, None for anything."""
        return self.best[-1][0] if len(self.best) == self.k else self.low

    def offer(self, scores: np.ndarray, at: np.ndarray, null: np.ndarray, ids: np.ndarray, numbers: np.ndarray) -> None:
        floor = self.floor()
        ok = np.ones(len(scores), bool) if floor is None else np.asarray(scores >= floor, bool)
        if self.high is not None:
            ok &= np.asarray(scores <= self.high, bool)
        if not ok.any():
            return
        scores, at = scores[ok], at[ok]
        if len(scores) > self.k and scores.dtype != object:  # only those at or above the k-th score can be among the first
            keep = scores >= np.partition(scores, -self.k)[-self.k]
            scores, at = scores[keep], at[keep]
        new = [(int(s), bool(null[j]), int(ids[j]), int(numbers[j])) for s, j in zip(scores, at, strict=True)]
        self.best = sorted(self.best + new, key=lambda t: (-t[0], *t[1:]))[: self.k]


def search(rows: pa.Table, asked: pa.Table, windows: list[list[Running]], same: bool) -> None:
    """Offer every stripe's row of the anchor's label (``same``, but not itself) or of another label to the anchor's windows, bucket by bucket."""
    x, a = matrix(rows["v"]), matrix(asked["v"])
    order = np.argsort(-_norms(x), kind="stable")
    rows, x = rows.take(pa.array(order)), x[order]
    norms, a_norms = _norms(x), _norms(a) * (1 + 1e-9)
    labels, a_labels = np.asarray(rows["label"]), np.asarray(asked["label"])
    numbers, a_numbers = np.asarray(rows["row"]), np.asarray(asked["row"])
    null, ids = sort_ids(rows["vec_id"])
    x, a = _exact(x, a)
    active = np.array([i for i, w in enumerate(windows) if w], np.int64)
    for start in range(0, len(x), BUCKET):
        bound = a_norms * norms[start]
        active = np.array([i for i in active if any((f := w.floor()) is None or f <= bound[i] for w in windows[i])], np.int64)
        if not len(active):
            return
        part = slice(start, start + BUCKET)
        scores = a[active] @ x[part].T
        for i, s in zip(active, scores, strict=True):
            right = (labels[part] == a_labels[i]) & (numbers[part] != a_numbers[i]) if same else labels[part] != a_labels[i]
            floors = [w.floor() for w in windows[i]]
            if None not in floors:
                right &= np.asarray(s >= min(floors), bool)
            at = np.flatnonzero(right)
            if len(at):
                for w in windows[i]:
                    w.offer(s[at], at + start, null, ids, numbers)


def _floor(x: Column) -> Column:
    """As a double: from 2**53 on all doubles are integers, which a long need not hold."""
    return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)


def _clipped(values: list[int]) -> pa.Array:
    return pa.array([min(max(v, LONG[0]), LONG[1]) for v in values], pa.int64())


def hard_negatives(df: DataFrame, *, k: int = 5, positives: int = 5, every: int = 100, classes: int = 10, relabel: int = 7, low: int = 80, high: int = 100, scale: int = 256, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are rows whose id is divisible by ``every``; positives are an anchor's first rows of its label, negatives the first of other labels
    that score from ``low`` to ``high`` per cent of the positive. Components become ``floor(scale * x)``; an id divisible by ``relabel`` moves its label on by one, modulo ``classes``.

    Rows with a null label, a null vector or a null or non-finite component take no part (also one whose ``scale``-fold is no finite double). Vectors of another length than the anchor's are not
    compared with it; an empty vector scores 0. Rows without an id are candidates, after all others on ties, and no anchors. Repeated rows, and rows that
    share an id, are rows of their own: each is an anchor, and each is found. Equal scores go by id, then by the row's number as read.
    Scores beyond a long are compared exactly inside a stripe, as doubles between stripes, and returned as the nearest long. A positive score below zero has no window. An empty table gives an empty
    result. Other columns are not read, whatever their names.
    """
    ws = Workspace(df.sparkSession, "negatives")
    moved = F.when(F.col("vec_id") % relabel == 0, (F.col("label") + 1) % classes).otherwise(F.col("label"))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v")).where(F.col("label").isNotNull() & usable("v", scale))
    rows = rows.select("vec_id", moved.alias("label"), F.transform("v", lambda x: _floor(x.cast("double") * scale)).alias("v"))
    rows, n = numbered(rows, ws, "rows")
    anchors = ws.put(rows.where(F.col("vec_id") % every == 0), "anchors")
    n_anchors = anchors.count()

    def find_positives(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        others = by_width(right, "v")
        for width, part in by_width(left, "v").items():
            if width in others:
                asked = others[width]
                windows = [[Running(None, None, positives)] for _ in range(asked.num_rows)]
                search(part, asked, windows, True)
                out += [(who, *b) for who, (w,) in zip(asked["row"].to_pylist(), windows, strict=True) for b in w.best]
        return pa.table({"anchor": pa.array([o[0] for o in out], pa.int64()), "score": _clipped([o[1] for o in out]), "exact": pa.array([str(o[1]) for o in out], pa.string()), "id": pa.array([None if o[2] else o[3] for o in out], pa.int64()), "row": pa.array([o[4] for o in out], pa.int64())})

    def first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc(F.col("exact").cast("double")), F.asc_nulls_last("id"), "row")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    close = first(in_blocks(rows, n, anchors, n_anchors, find_positives, "anchor long, score long, exact string, id long, row long"), ["anchor"], positives)
    close = ws.put(close.select("anchor", "score", "exact", F.col("id").alias("positive_id"), F.col("row").alias("positive")), "positives")
    windows = close.groupBy(F.col("anchor").alias("row")).agg(F.sort_array(F.collect_list(F.struct("positive", "exact"))).alias("windows"))  # at most ``positives`` each
    asked = anchors.join(windows, "row")

    def find_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        others = by_width(right, "v")
        for width, part in by_width(left, "v").items():
            if width in others:
                asked = others[width]
                named = [[(w["positive"], int(w["exact"])) for w in ws_] for ws_ in asked["windows"].to_pylist()]
                open_ = [[(p, Running(-(-low * s // 100), s * high // 100, k)) for p, s in ws_ if -(-low * s // 100) <= s * high // 100] for ws_ in named]
                search(part, asked, [[w for _, w in ws_] for ws_ in open_], False)
                out += [(who, p, *b) for who, ws_ in zip(asked["row"].to_pylist(), open_, strict=True) for p, w in ws_ for b in w.best]
        return pa.table({"anchor": pa.array([o[0] for o in out], pa.int64()), "positive": pa.array([o[1] for o in out], pa.int64()), "score": _clipped([o[2] for o in out]), "exact": pa.array([str(o[2]) for o in out], pa.string()), "id": pa.array([None if o[3] else o[4] for o in out], pa.int64()), "row": pa.array([o[5] for o in out], pa.int64())})

    found = first(in_blocks(rows, n, asked, n_anchors, find_negatives, "anchor long, positive long, score long, exact string, id long, row long"), ["anchor", "positive"], k)
    named = close.select("anchor", "positive", "positive_id", F.col("score").alias("positive_score"))
    ids = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    out = found.select("anchor", "positive", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(named, ["anchor", "positive"]).join(ids, "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
