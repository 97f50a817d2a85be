"""Gradient-boosted regression trees: second-order gain, L2 leaf weights, histograms summed in tasks.

Rows are binned once and packed into blocks. A pass over the blocks grows one level of one tree of every model (target and fold) at
the same time: tasks sum gradients by node, feature and bin, a shuffle by node and feature adds those up and finds the feature's best split, and the driver gets one row for each node. Gradients are
rounded to multiples of a power of two and summed as integers, so trees are the same however the rows are dealt.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.operators.quantiles import percentiles
from cadence.sources.tables import scratch

BINS, BLOCK, REFRESH = 256, 16_384, 10
Tree = dict[str, np.ndarray]


class Forest:
    """A base value and trees; ``trees`` holds weight and nodes as attributions take them, the base as a tree of one leaf."""

    def __init__(self, base: float, cover: float, trees: list[Tree]):
        self.base, self.cover, self.grown = base, cover, trees

    @property
    def trees(self) -> list[tuple[float, list[dict]]]:
        base = [{"value": self.base, "cover": self.cover, "feature": -1, "threshold": 0.0, "left": -1, "right": -1}]
        return [(1.0, base), *((1.0, [{k: t[k][i].item() for k in ("value", "cover", "feature", "threshold", "left", "right")} for i in range(len(t["feature"]))]) for t in self.grown)]

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.grown:
            out += t["value"][_leaves(t, lambda rows, f: x[rows, f], len(x), "threshold")]
        return out

    def to_dict(self) -> dict:
        return {"base": self.base, "cover": self.cover, "trees": [{k: v.tolist() for k, v in t.items()} for t in self.grown]}

    @classmethod
    def from_dict(cls, d: dict) -> Forest:
        kinds = {"feature": np.int32, "left": np.int32, "right": np.int32, "bin": np.int32}
        return cls(d["base"], d["cover"], [{k: np.array(v, kinds.get(k, float)) for k, v in t.items()} for t in d["trees"]])


def _leaves(tree: Tree, value, n: int, test: str) -> np.ndarray:
    """The leaf of each row; a row goes left where its value is at most the node's ``test`` (a missing value is not)."""
    at = np.zeros(n, np.int64)
    while True:
        go = np.flatnonzero(tree["feature"][at] >= 0)
        if not len(go):
            return at
        node = at[go]
        left = value(go, tree["feature"][node]) <= tree[test][node]
        at[go] = np.where(left, tree["left"][node], tree["right"][node])


def bin_edges(rows: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Upper bounds of each feature's bins, from all rows: all its values but the greatest, or, with more than ``bins`` of them, the middles between the values at the ends of equal shares of the rows."""
    cols = [F.col(f) for f in features]

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0) for _ in features]
        for b in batches:
            for j in range(len(held)):
                if len(held[j]) <= bins:
                    held[j] = np.union1d(held[j], np.asarray(b.column(j), float))[: bins + 1]
        number = np.repeat(np.arange(len(held), dtype=np.int32), [len(h) for h in held])
        yield pa.RecordBatch.from_pydict({"_j": number, "_x": np.concatenate(held)})

    found = scratch(rows.select(*cols).mapInArrow(few, "_j int, _x double").distinct(), "values")  # at most bins + 1 of each task and feature
    counts = {r["_j"]: r["count"] for r in found.groupBy("_j").count().collect()}
    many = [j for j, n in counts.items() if n > bins]
    out = [np.zeros(0) for _ in features]
    for r in found.where(~F.col("_j").isin(many)).groupBy("_j").agg(F.sort_array(F.collect_list("_x")).alias("x")).collect():
        out[r["_j"]] = np.array(r["x"])[:-1]
    if many:
        n = rows.count()
        ranks = np.ceil(np.arange(1, bins) * n / bins).astype(int) - 1
        tall = rows.select(F.explode(F.array(*[F.struct(F.lit(j).alias("_j"), cols[j].alias("_x")) for j in many])).alias("v")).select("v.*")
        for r in percentiles(tall, "_x", [float(s) for s in (ranks + 0.5) / (n - 1)], ["_j"]).collect():
            out[r["_j"]] = np.unique(r["percentiles"])
        tops = rows.agg(*[F.max(cols[j]).alias(str(j)) for j in many]).first()
        out = [e[e < tops[str(j)]] if j in many else e for j, e in enumerate(out)]
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of each number."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _sampled(key: np.ndarray, seed: int, tree: int, share: float) -> np.ndarray:
    """Rows that a tree is grown on, by their content."""
    if share >= 1:
        return np.ones(len(key), bool)
    with np.errstate(over="ignore"):
        salt = _mixed(np.array([seed], np.uint64) * np.uint64(1_000_003) + np.array([tree], np.uint64))
    return _mixed(key ^ salt) < np.uint64(int(share * 2**64))


def _blocks(rows: DataFrame, features: list[str], n_targets: int, edges: list[np.ndarray], n_models: int):
    """Rows as blocks: bins by feature, targets, the fold that holds a row out, a hash of its content, and sums of leaves so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                part = b.slice(i, BLOCK)
                bins = np.stack([np.searchsorted(e, np.asarray(part.column(f"_f{j}"), float), "left") for j, e in enumerate(edges)]).astype(np.uint8)
                y = np.stack([np.asarray(part.column(f"_y{j}"), float) for j in range(n_targets)])
                held, key = np.asarray(part.column("_fold")).astype(np.int32), np.asarray(part.column("_key")).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"n": pa.array([part.num_rows], pa.int32()), "bins": [bins.tobytes()], "y": [y.tobytes()], "held": [held.tobytes()], "key": [key.tobytes()], "sums": [np.zeros((n_models, part.num_rows)).tobytes()]})

    return rows.mapInArrow(run, "n int, bins binary, y binary, held binary, key binary, sums binary")


class _Model:
    """What a pass has to know of a model: its target, the fold it leaves out, and its trees since the stored sums."""

    def __init__(self, target: int, fold: int | None, base: float, scale: int, limit: float):
        self.target, self.fold, self.base, self.scale, self.limit = target, fold, base, scale, limit
        self.recent: list[Tree] = []
        self.growing: list[dict] = []


def _arrays(nodes: list[dict]) -> Tree:
    kinds = {"feature": np.int32, "left": np.int32, "right": np.int32, "bin": np.int32, "threshold": float, "value": float, "cover": float}
    return {k: np.array([n[k] for n in nodes], kind) for k, kind in kinds.items()}


def _each(batches: Iterator[pa.RecordBatch], models: list[_Model], n_features: int):
    for b in batches:
        for i in range(b.num_rows):
            n = b.column("n")[i].as_py()
            read = lambda c, kind, b=b, i=i: np.frombuffer(b.column(c)[i].as_py(), kind)
            bins = read("bins", np.uint8).reshape(n_features, n)
            sums = read("sums", float).reshape(len(models), n).copy()
            for m, s in zip(models, sums, strict=True):
                for t in m.recent:
                    s += t["value"][_leaves(t, lambda rows, f: bins[f, rows], n, "bin")]
            yield b.slice(i, 1), n, bins, read("y", float).reshape(-1, n), read("held", np.int32), read("key", np.int64).view(np.uint64), sums


def _level(blocks: DataFrame, models: list[_Model], n_edges: list[int], tree: int, share: float, seed: int, penalty: float, least: float) -> list:
    """The best split of every open node of every model: ``model, node, gain, feature, bin, gl, hl, g, h`` with gradients as integers."""
    n_features, width = len(n_edges), max(n_edges) + 1

    def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for _, n, bins, y, held, key, sums in _each(batches, models, n_features):
            drawn = _sampled(key, seed, tree, share)
            for k, m in enumerate(models):
                use = np.flatnonzero(drawn if m.fold is None else drawn & (held != m.fold))
                grown = _arrays(m.growing)
                at = _leaves(grown, lambda rows, f: bins[f, rows], n, "bin")[use]
                gradient = np.clip(np.rint((m.base + sums[k, use] - y[m.target, use]) * 2.0**m.scale), -m.limit, m.limit)
                for node in np.unique(at):
                    if not m.growing[node]["open"]:
                        continue
                    mine = at == node
                    rows, g = use[mine], gradient[mine]
                    add = np.zeros((n_features, width, 2), np.int64)
                    for f in range(n_features):
                        b = bins[f, rows]
                        add[f, :, 0] = np.bincount(b, g, width).astype(np.int64)  # whole numbers below 2**53
                        add[f, :, 1] = np.bincount(b, minlength=width)
                    found = total.get((k, int(node)))
                    total[k, int(node)] = add if found is None else found + add
        for (k, node), t in total.items():
            yield pa.RecordBatch.from_pydict({"model": np.full(n_features, k, np.int32), "node": np.full(n_features, node, np.int32), "feature": np.arange(n_features, dtype=np.int32), "sums": [t[f].tobytes() for f in range(n_features)]})

    def split(key: tuple, rows: pa.Table) -> pa.Table:
        k, node, f = (x.as_py() for x in key)
        t = sum(np.frombuffer(s, np.int64).reshape(width, 2) for s in rows["sums"].to_pylist())
        g, h = (int(x) for x in t.sum(axis=0))
        below = t[: n_edges[f]].cumsum(axis=0)
        unit = 2.0 ** -models[k].scale
        gl, hl = below[:, 0] * unit, below[:, 1].astype(float)
        gr, hr = (g - below[:, 0]) * unit, h - hl
        gain = gl * gl / (hl + penalty) + gr * gr / (hr + penalty) - (g * unit) ** 2 / (h + penalty)
        gain = np.where((hl >= least) & (hr >= least), gain, -np.inf)
        at = int(gain.argmax()) if len(gain) else 0
        best = float(gain[at]) if len(gain) else -math.inf
        return pa.table({"model": pa.array([k], pa.int32()), "node": pa.array([node], pa.int32()), "feature": pa.array([f], pa.int32()), "gain": [best], "bin": pa.array([at], pa.int32()), "gl": pa.array([int(below[at, 0]) if len(gain) else 0]), "hl": pa.array([int(below[at, 1]) if len(gain) else 0]), "g": [g], "h": [h]})

    tall = blocks.mapInArrow(histograms, "model int, node int, feature int, sums binary")
    best = tall.groupBy("model", "node", "feature").applyInArrow(split, "model int, node int, feature int, gain double, bin int, gl long, hl long, g long, h long")
    top = best.groupBy("model", "node").agg(F.max_by(F.struct("gain", "feature", "bin", "gl", "hl", "g", "h"), F.struct("gain", (-F.col("feature")).alias("f"))).alias("x"))
    return top.select("model", "node", "x.*").collect()  # a row for each open node of each model


def train(df: DataFrame, features: list[str], targets: list[str], *, fold: str | None = None, folds: list[int] | None = None, trees: int = 200, depth: int = 6, rate: float = 0.05, subsample: float = 0.8, seed: int = 42, penalty: float = 1.0, least: float = 1.0, bins: int = BINS, scale: int | None = None) -> dict[tuple[str, int | None], Forest]:
    """A forest for each target, and with ``folds`` for each target and fold, grown on all rows whose ``fold`` is another, all in the same passes.

    Squared error with hessian 1; ``penalty`` is the L2 weight of leaves, ``least`` the smallest number of rows of a leaf. Rows with a missing
    feature or target are left out. ``subsample`` draws rows by their content, so equal rows fare alike. ``scale`` fixes the power of two to which gradients
    are rounded; by default it follows from the targets' range and the number of rows. Ties between splits go to the first feature, then the lowest bin.
    """
    cols = [F.col(f"`{f}`").cast("double").alias(f"_f{i}") for i, f in enumerate(features)] + [F.col(f"`{t}`").cast("double").alias(f"_y{i}") for i, t in enumerate(targets)]
    rows = df.select(*cols, (F.col(fold).cast("int") if fold else F.lit(-1)).alias("_fold"))
    named = [c for c in rows.columns if c != "_fold"]
    for c in named:
        rows = rows.where(F.col(c).isNotNull() & ~F.isnan(c))
    rows = scratch(rows.na.fill(-1, ["_fold"]).withColumn("_key", F.xxhash64(*named)), "boosting")
    edges = bin_edges(rows, [f"_f{i}" for i in range(len(features))], bins)
    wanted = [(i, f) for i in range(len(targets)) for f in (folds if folds is not None else [None])]
    stats = rows.agg(F.count(F.lit(1)).alias("n"), *[g(f"_y{i}").alias(f"{name}{i}") for i in range(len(targets)) for name, g in (("low", F.min), ("high", F.max))]).first()
    if not stats["n"]:
        raise ValueError("no complete rows to train on")
    powers = []
    for i in range(len(targets)):
        span = max(stats[f"high{i}"] - stats[f"low{i}"], 2.0**-40)
        powers.append(scale if scale is not None else math.floor(min(60 - math.log2(stats["n"] * 4 * span), 53 - math.log2(BLOCK * 4 * span))))
    sums = {r["_fold"]: r for r in rows.groupBy("_fold").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.rint(F.col(f"_y{i}") * 2.0 ** powers[i]).cast("decimal(38,0)")).alias(f"s{i}") for i in range(len(targets))]).where(F.col("_fold").isin([-1, *(folds or [])])).collect()} if folds else {}
    every = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.rint(F.col(f"_y{i}") * 2.0 ** powers[i]).cast("decimal(38,0)")).alias(f"s{i}") for i in range(len(targets))]).first()
    models, forests = [], []
    for i, f in wanted:
        out = sums.get(f) if f is not None else None
        n = every["n"] - (out["n"] if out else 0)
        base = float(every[f"s{i}"] - (out[f"s{i}"] if out else 0)) / 2.0 ** powers[i] / n if n else 0.0
        span = max(stats[f"high{i}"] - stats[f"low{i}"], 2.0**-40)
        models.append(_Model(i, f, base, powers[i], 4 * span * 2.0 ** powers[i]))
        forests.append(Forest(base, float(n), []))
    blocks = scratch(_blocks(rows, features, len(targets), edges, len(models)), "blocks")
    n_edges = [len(e) for e in edges]
    leaf = {"feature": -1, "threshold": 0.0, "bin": 0, "left": -1, "right": -1, "value": 0.0, "cover": 0.0, "open": True}
    for tree in range(trees):
        for m in models:
            m.growing = [dict(leaf)]
        for level in range(depth):
            if not any(n["open"] for m in models for n in m.growing):
                break
            for r in _level(blocks, models, n_edges, tree, subsample, seed, penalty, least):
                m = models[r["model"]]
                node, unit = m.growing[r["node"]], 2.0**-m.scale
                worth = lambda g, h, unit=unit: -g * unit / (h + penalty) * rate
                node |= {"open": False, "cover": float(r["h"]), "value": worth(r["g"], r["h"])}
                if r["gain"] > 1e-6:
                    at, more = len(m.growing), level + 1 < depth
                    node |= {"feature": r["feature"], "bin": r["bin"], "threshold": float(edges[r["feature"]][r["bin"]]), "left": at, "right": at + 1}
                    for g, h in ((r["gl"], r["hl"]), (r["g"] - r["gl"], r["h"] - r["hl"])):
                        m.growing.append(leaf | {"open": more, "cover": float(h), "value": worth(g, h)})
        for m, forest in zip(models, forests, strict=True):
            grown = _arrays(m.growing)
            m.recent.append(grown)
            forest.grown.append(grown)
        if (tree + 1) % REFRESH == 0 and tree + 1 < trees:

            def summed(batches: Iterator[pa.RecordBatch], models=models) -> Iterator[pa.RecordBatch]:
                for block, *_, total in _each(batches, models, len(features)):
                    yield block.set_column(block.schema.names.index("sums"), "sums", pa.array([total.tobytes()], pa.binary()))

            blocks = scratch(blocks.mapInArrow(summed, blocks.schema), "blocks")
            for m in models:
                m.recent = []
    return {(targets[i], f): forest for (i, f), forest in zip(wanted, forests, strict=True)}


def scored(df: DataFrame, features: list[str], out: dict[str, Forest], by: tuple[str, dict[int, Forest]] | None = None) -> DataFrame:
    """``df`` with a column for each forest; with ``by`` (a column of whole numbers, forests by number, and one name in ``out``) every row is scored by its own."""
    shared = df.sparkSession.sparkContext.broadcast(({n: f.to_dict() for n, f in out.items()}, {k: f.to_dict() for k, f in by[1].items()} if by else None))  # trees and depth bound its size
    names = [f"_f{i}" for i in range(len(features))]
    rows = df.withColumns({n: F.col(f"`{f}`").cast("double") for n, f in zip(names, features, strict=True)})
    keep = [c for c in rows.columns if c not in names]
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), *(f"`{n}` double" for n in out)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forests = {n: Forest.from_dict(d) for n, d in shared.value[0].items()}
        own = {k: Forest.from_dict(d) for k, d in (shared.value[1] or {}).items()}
        for b in batches:
            x = np.stack([np.asarray(b.column(n).cast(pa.float64()).fill_null(np.nan), float) for n in names], axis=1) if b.num_rows else np.zeros((0, len(names)))
            values = {n: f.predict(x) for n, f in forests.items()}
            if by:
                (name,), which = forests, np.asarray(b.column(by[0]))
                for k, f in own.items():
                    values[name][which == k] = f.predict(x[which == k])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(v) for v in values.values())], names=[*keep, *values])

    return rows.mapInArrow(run, schema)


def shap_values(nodes: list[dict], x: np.ndarray) -> np.ndarray:
    """Shapley values of one tree for all rows of ``x``, exact, in one walk: work is the number of leaves times the square of the depth.

    The walk carries, for all rows at once, how many subsets of each size reach a node (the path of features with the share of rows that pass
    when a feature is unknown, and whether a row passes); both children start from the same path. A feature that is asked again
    is taken out of the path first, and a leaf takes each feature out once to get its weight.
    """
    phi = np.zeros(x.shape)
    n = len(x)

    def extended(weights: list, zero: float, one) -> list:
        size = len(weights)
        out = [*weights, np.zeros(n) if size else np.ones(n)]
        out = [np.array(w, float) for w in out]
        for i in range(size - 1, -1, -1):
            out[i + 1] += one * out[i] * ((i + 1) / (size + 1))
            out[i] *= zero * ((size - i) / (size + 1))
        return out

    def without(weights: list, zero: float, one) -> list:
        last = len(weights) - 1
        passes = np.asarray(one, bool)
        carry = weights[last].copy()
        out = [None] * last
        for i in range(last - 1, -1, -1):
            hot = carry * ((last + 1) / (i + 1))
            cold = weights[i] * ((last + 1) / (zero * (last - i))) if zero else np.zeros(n)
            carry = np.where(passes, weights[i] - hot * zero * ((last - i) / (last + 1)), carry)
            out[i] = np.where(passes, hot, cold)
        return out

    def walk(at: int, path: list[tuple[int, float, np.ndarray]], weights: list) -> None:
        node = nodes[at]
        if node["feature"] < 0:
            for f, zero, one in path:
                phi[:, f] += sum(without(weights, zero, one)) * (one - zero) * node["value"]
            return
        f = node["feature"]
        zero, one = 1.0, np.ones(n)
        seen = next((i for i, p in enumerate(path) if p[0] == f), None)
        if seen is not None:
            _, zero, one = path[seen]
            weights, path = without(weights, zero, one), path[:seen] + path[seen + 1 :]
        left = x[:, f] <= node["threshold"]
        total = nodes[node["left"]]["cover"] + nodes[node["right"]]["cover"]
        for child, passes in ((node["left"], left), (node["right"], ~left)):
            share, now = zero * nodes[child]["cover"] / total, one * passes
            walk(child, [*path, (f, share, now)], extended(weights, share, now))

    walk(0, [], extended([], 1.0, 1.0))
    return phi


def explained(df: DataFrame, features: list[str], forests: dict[str, list[tuple[float, list[dict]]]], base: dict[str, float]) -> DataFrame:
    """``df`` with ``<name>_base``, ``<name>_shap`` (an array in the order of ``features``) for each forest, and ``shap_status``: ``ok``, or which features are missing; those count as not at most any threshold."""
    shared = df.sparkSession.sparkContext.broadcast(forests)
    names = [f"_f{i}" for i in range(len(features))]
    rows = df.withColumns({n: F.col(f"`{f}`").cast("double") for n, f in zip(names, features, strict=True)})
    gone = F.filter(F.array(*[F.when(F.col(n).isNull() | F.isnan(n), F.lit(f)) for n, f in zip(names, features, strict=True)]), lambda s: s.isNotNull())
    rows = rows.withColumn("shap_status", F.when(F.size(gone) == 0, "ok").otherwise(F.concat(F.lit("missing: "), F.array_join(gone, ", "))))
    keep = [c for c in rows.columns if c not in names]
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), *(f"`{n}_base` double, `{n}_shap` array<double>" for n in forests)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([np.asarray(b.column(n).fill_null(np.nan), float) for n in names], axis=1) if b.num_rows else np.zeros((0, len(names)))
            cols, out = [b.column(c) for c in keep], list(keep)
            for name, forest in shared.value.items():
                values = sum((w * shap_values(t, x) for w, t in forest), np.zeros(x.shape))
                cols += [pa.array(np.full(len(x), base[name])), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(names), pa.int32()), pa.array(values.ravel()))]
                out += [f"{name}_base", f"{name}_shap"]
            yield pa.RecordBatch.from_arrays(cols, names=out)

    return rows.mapInArrow(run, schema)


