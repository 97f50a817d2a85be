"""Exact nearest neighbours without all pairs: cells around pivots, with bounds by angle.

Angles obey the triangle inequality, so a cell's members lie at an angle of at least ``angle(query, pivot) - radius`` from a query, which bounds their
inner products with it from above. Queries visit only those cells whose bound reaches the best pivot and the best that they have found.

No vector is copied for the cells that it visits: vectors are packed into blocks, blocks of queries meet blocks of cells as pairs of stored
partitions, without a shuffle, and each pair of partitions hands on at most one best a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIVOTS, PART, ASKED, SLACK = 1024, 2048, 2048, 1e-9
GROUPS, GROUP = 16, 50_000  # partitions of the known: at least so many, and of at most so many vectors


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), float).reshape(len(flat), -1)


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T / np.sqrt((x * x).sum(axis=1))[:, None], -1, 1))


def bounds(angle: np.ndarray, cells: dict[str, np.ndarray]) -> np.ndarray:
    """No member of a cell has a larger inner product with a unit vector at ``angle`` (by cell) from its pivot."""
    least = np.maximum(0, np.maximum(angle - cells["far"], cells["near"] - angle) - 1e-7)  # arc cosines are worse than other roundings
    cos = np.cos(np.minimum(least, np.pi))
    return np.where(cos > 0, cos * cells["long"], cos * cells["short"]) + SLACK * np.maximum(1, cells["long"])


def best_of(c: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best of a block (sorted by ``no``) for each query, as places and inner products; near-equal products are compared by sums in order, equal ones by ``no``."""
    sims = q @ c.T
    at = sims.argmax(axis=1)
    top = sims[np.arange(len(q)), at]
    many = np.flatnonzero((sims >= top[:, None] - SLACK).sum(axis=1) > 1)
    for i in many:
        near = np.flatnonzero(sims[i] >= top[i] - SLACK)
        at[i] = near[(c[near] * q[i]).sum(axis=1).argmax()]
    return at, (c[at] * q).sum(axis=1)


def nearest(asked: DataFrame, known: DataFrame, size: int, *, pivots: int = PIVOTS) -> tuple[DataFrame, dict]:
    """``id, name, no, similarity`` of the largest inner product, the smallest ``no`` on ties, and what was visited.

    ``asked``: ``id``, unit vectors ``q``; ``known``: ``name, no``, non-zero vectors ``c``, ``size`` of them. The square root of
    ``size``, at most ``pivots``, of the known are the pivots, which is all that every task gets. Cells are cut into blocks of at most PART
    vectors, which count as cells of their own, so a crowded cell is spread over tasks.
    """
    from cadence.sources.tables import scratch

    kind = asked.schema["id"].dataType.simpleString()
    n = min(pivots, max(1, int(np.ceil(np.sqrt(size)))))
    chosen = known.select(F.xxhash64("name").alias("h"), "name", "c").orderBy("h", "name").limit(n).collect()  # at most ``pivots`` rows
    if not chosen:
        return asked.sparkSession.createDataFrame([], f"id {kind}, name string, no long, similarity double"), {"cells": 0, "visits": 0, "possible": 0, "products": 0}
    axes = np.array([r["c"] for r in chosen], float)
    raw = axes.copy()
    axes /= np.sqrt((axes * axes).sum(axis=1))[:, None]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_angles(_matrix(b.column("c")), axes).argmin(axis=1), pa.int32())], names=[*b.schema.names, "cell"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of one cell each from rows sorted by cell and ``no``."""
        for b in batches:
            cell = np.asarray(b.column("cell"))
            cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1), len(cell)] if len(cell) else []
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                for k in range(i, j, PART):
                    part = b.slice(k, min(PART, j - k))
                    c = _matrix(part.column("c"))
                    angle, norm = _angles(c, axes[cell[k] : cell[k] + 1])[:, 0], np.sqrt((c * c).sum(axis=1))
                    lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(x)) for x in ("name", "no")]
                    yield pa.RecordBatch.from_arrays([pa.array([cell[k]], pa.int32()), *(pa.array([float(x)]) for x in (angle.min(), angle.max(), norm.min(), norm.max())), *lists, pa.array([c.tobytes()], pa.binary())], names=["cell", "near", "far", "short", "long", "names", "nos", "c"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, ASKED):
                part = b.slice(i, ASKED)
                q = _matrix(part.column("q"))
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("id"))
                least = (q @ raw.T).max(axis=1) - SLACK * max(1, np.sqrt((raw * raw).sum(axis=1)).max())  # what the pivots give, as a bound only
                yield pa.RecordBatch.from_arrays([ids, pa.array([q.tobytes()], pa.binary()), pa.array([least.tobytes()], pa.binary())], names=["ids", "q", "least"])

    placed = known.select("name", "no", "c").mapInArrow(assign, "name string, no long, c array<double>, cell int")
    placed = placed.repartitionByRange(max(GROUPS, -(-size // GROUP)), "cell", "no").sortWithinPartitions("cell", "no")
    blocks = scratch(placed.mapInArrow(pack, "cell int, near double, far double, short double, long double, names array<string>, nos array<long>, c binary"), "blocks")
    asking = asked.select("id", "q").mapInArrow(ask, f"ids array<{kind}>, q binary, least binary")
    questions = scratch(asking.withColumn("block", F.monotonically_increasing_id()), "asked")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs come by block of queries; what a block found is handed on when the next one comes."""
        block = ids = None

        def done() -> pa.RecordBatch:
            some = np.flatnonzero(visits)
            return pa.RecordBatch.from_arrays([ids.take(pa.array(some)), pa.array(name[some], pa.string()), pa.array(no[some]), pa.array(best[some]), pa.array(visits[some]), pa.array(products[some])], names=["id", "name", "no", "similarity", "visits", "products"])

        for b in batches:
            for i in range(b.num_rows):
                value = lambda c, b=b, i=i: b.column(c)[i]
                if block != value("block").as_py():
                    if block is not None:
                        yield done()
                    block, ids = value("block").as_py(), value("ids").values
                    q, least = np.frombuffer(value("q").as_py()).reshape(len(ids), -1), np.frombuffer(value("least").as_py())
                    best, no, name = np.full(len(q), -np.inf), np.zeros(len(q), np.int64), np.full(len(q), None, object)
                    visits, products = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
                cell = value("cell").as_py()
                bound = bounds(_angles(q, axes[cell : cell + 1]), {c: np.array([value(c).as_py()]) for c in ("near", "far", "short", "long")})[:, 0]
                go = np.flatnonzero(bound >= np.maximum(best, least))
                if not len(go):
                    continue
                nos, c = value("nos").values.to_numpy(), np.frombuffer(value("c").as_py()).reshape(-1, q.shape[1])
                at, found = best_of(c, q[go])
                visits[go] += 1
                products[go] += len(c)
                better = (found > best[go]) | ((found == best[go]) & (nos[at] < no[go]))
                new, at = go[better], at[better]
                best[new], no[new], name[new] = found[better], nos[at], value("names").values.take(pa.array(at)).to_numpy(zero_copy_only=False)
        if block is not None:
            yield done()

    met = questions.crossJoin(blocks.hint("shuffle_replicate_nl")).mapInArrow(meet, f"id {kind}, name string, no long, similarity double, visits long, products long")
    top = met.groupBy("id").agg(F.max_by(F.struct("name", "no", "similarity"), F.struct("similarity", (-F.col("no")).alias("i"))).alias("x"), F.sum("visits").alias("visits"), F.sum("products").alias("products"))
    best = scratch(top.select("id", "x.*", "visits", "products"), "best")
    total = best.agg(F.sum("visits").alias("visits"), F.sum("products").alias("products")).first().asDict()
    n_blocks, n_asked = blocks.count(), questions.agg(F.sum(F.size("ids"))).first()[0] or 0
    return best.drop("visits", "products"), {"cells": n_blocks, "visits": total["visits"] or 0, "products": total["products"] or 0, "possible": n_asked * n_blocks}
