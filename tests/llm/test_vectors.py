"""Nearest neighbours and hard negatives against brute force."""

import math

import numpy as np
import pytest

from cadence.llm import negatives, neighbours
from cadence.llm.entry import ORACLE_SQL, QUERIES

DDL = "vec_id long, embedding array<float>, label int, row string, score int, v int, stripe int"


def frame(spark, rows):
    """With columns whose names clash with those the operators use."""
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], DDL).repartition(5)


def some(n=700, d=24, seed=3):
    g = np.random.default_rng(seed)
    x = g.standard_normal((n, d)).astype(np.float32)
    x[100:160] = x[100] + 0.01 * g.standard_normal((60, d)).astype(np.float32)  # a group of near copies
    x[200:230] = x[200]  # and one of equal vectors
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(x)]
    odd = [(5000, None, 1), (5100, [0.0] * d, 1), (5200, [], 2), (5300, [float("nan")] * d, 0), (5400, [1.0, None] + [0.0] * (d - 2), 1), (5500, [float("inf")] + [1.0] * (d - 1), 2), (None, x[3].tolist(), 1), (5600, x[4].tolist(), None), (5700, [1.0, 2.0], 0)]
    return rows + odd + [rows[50], rows[100], rows[100]]


def usable(v, zero):
    return v is not None and all(c is not None and math.isfinite(c) for c in v) and (zero or any(v))


def brute_nearest(rows, k=5, every=50):
    rows = [(i, np.array(v, float)) for i, v, _ in rows if usable(v, False)]
    out = []
    for a, (q, x) in enumerate(rows):
        if q is not None and q % every == 0:
            near = [(-float((x * y).sum() / math.sqrt((x * x).sum()) / math.sqrt((y * y).sum())), i is None, i or 0) for b, (i, y) in enumerate(rows) if a != b and len(x) == len(y)]
            out.append((q, [(None if n else i, -s) for s, n, i in sorted(near)[:k]]))
    return out


def test_nearest(spark):
    rows = some()
    got = {}
    for r in neighbours.nearest(frame(spark, rows)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute_nearest(rows)
    assert sum(map(len, got.values())) == sum(len(n) for _, n in want)
    hits = total = 0
    for q, near in want:
        scores = sorted((s for _, _, s in got.get(q, [])), reverse=True)
        total += len(near)
        hits += sum(any(abs(s - t) < 1e-9 for t in scores) for _, s in near)
    assert hits >= 0.95 * total
    assert 5700 not in got  # alone in its length
    assert [r[2] for r in sorted(got[650])] == sorted((r[2] for r in got[650]), reverse=True)


def test_recall_on_the_table(spark, small):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in QUERIES["op11_nearest_vectors"](spark, small).collect()}
    want = [((q, i), s) for q, near in brute_nearest(rows) for i, s in near]
    assert len(got) == len(want)
    assert sum(key in got and abs(got[key] - s) < 1e-12 for key, s in want) >= 0.95 * len(want)


def test_few_rows(spark):
    rows = [(0, [1.0, 0.0], 0), (50, [-1.0, 0.0], 0), (7, [0.0, -2.0], 1)]
    got = [tuple(r) for r in neighbours.nearest(frame(spark, rows)).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 7, 0.0), (0, 2, 50, -1.0), (50, 1, 7, 0.0), (50, 2, 0, -1.0)]
    assert neighbours.nearest(frame(spark, rows[:1])).count() == 0
    assert neighbours.nearest(frame(spark, [])).count() == 0


def brute_negatives(rows, k=5, every=100):
    rows = [(i, [math.floor(256 * c) for c in v], ((y + 1) % 10 if i is not None and i % 7 == 0 else y)) for i, v, y in rows if y is not None and usable(v, True)]
    out = []
    for a, (q, x, y) in enumerate(rows):
        if q is None or q % every:
            continue
        scored = sorted((-sum(s * t for s, t in zip(x, z, strict=True)), i is None, i or 0, w) for b, (i, z, w) in enumerate(rows) if a != b and len(x) == len(z))
        for ps, pn, p, _ in [s for s in scored if s[3] == y][:5]:
            good = [s for s in scored if s[3] != y and 80 * -ps <= 100 * -s[0] <= 100 * -ps][:k]
            out += [(q, None if pn else p, r, None if n else i, -ps, -s) for r, (s, n, i, _) in enumerate(good, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("scale", [1.0, 1e6, 3e15])
def test_negatives(spark, scale):
    rows = [(i, v and [c if c is None else c * scale for c in v], y) for i, v, y in some(500)]
    rows = [(i, v and np.array(v, float).astype(np.float32).astype(float).tolist() if v and None not in v else v, y) for i, v, y in rows]
    got = sorted([tuple(r) for r in negatives.hard_negatives(frame(spark, rows)).collect()], key=str)
    want = brute_negatives(rows)
    top = 2**63 - 1
    assert len(want) > 50
    assert got == sorted([(*w[:4], min(w[4], top), min(w[5], top)) for w in want], key=str)


def test_negatives_buckets_end_early(spark):
    """Long vectors first: short ones can't reach the window and are left out by their norm."""
    import pyarrow as pa

    from cadence.llm.negatives import Running, search

    n = 3000
    x = np.zeros((n, 2))
    x[:, 0] = np.arange(n)[::-1]
    rows = pa.table({"v": pa.array(x.tolist()), "label": pa.array([1] * n), "row": pa.array(range(n)), "vec_id": pa.array(range(n))})
    asked = pa.table({"v": pa.array([[1.0, 0.0]]), "label": pa.array([0]), "row": pa.array([-1])})
    seen = []

    class Seen(Running):
        def offer(self, scores, *rest):
            seen.append(len(scores))
            super().offer(scores, *rest)

    w = Seen(100, 2**40, 5)
    search(rows, asked, [[w]], False)
    assert [b[0] for b in w.best] == [2999, 2998, 2997, 2996, 2995]
    assert len(seen) == 1


def test_negatives_empty(spark):
    assert negatives.hard_negatives(frame(spark, [])).count() == 0
    assert negatives.hard_negatives(frame(spark, [(0, [1.0], 0)])).count() == 0


def test_negatives_sql(spark, small):
    import duckdb

    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
    got = sorted(tuple(r) for r in QUERIES["op12_hard_negatives"](spark, small).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert got == sorted(db.sql(f"SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ({ORACLE_SQL['op12_hard_negatives']})").fetchall())
