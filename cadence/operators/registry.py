"""The speaker registry as a table: matching, decisions, the ordered fold, merging, erasure and summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.functions import vector
from cadence.functions.scalar import age_days
from cadence.operators import cells, ranges
from cadence.plans.schema import SPEAKERS

BASE, GRAY, HISTORY, ZERO, EPS = 0.55, 0.05, 50, 1e-6, 1e-8


def adaptive_threshold(n: Column, last_seen: Column | None = None, as_of: Column | None = None, base: float = BASE) -> Column:
    """Higher for speakers known from few samples or not seen for over 30 days."""
    out = F.lit(base) + F.when(n <= 5, 0.07).when(n <= 30, 0.03).otherwise(-0.03)
    if last_seen is not None and as_of is not None:
        out = out + F.when(age_days(last_seen, as_of) > 30, 0.05).otherwise(0.0)
    return out


_PART = 2048


def _packed(rows: DataFrame, vector_col: str, keep: list[str]) -> DataFrame:
    """Rows as matrices of at most _PART vectors (doubles, packed), with lists of ``keep``."""
    kinds = {f.name: f.dataType for f in rows.schema}
    schema = ", ".join([*(f"`{c}` array<{kinds[c].simpleString()}>" for c in keep), "m binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, _PART):
                part = b.slice(i, _PART)
                values = part.column(vector_col).flatten().to_numpy(zero_copy_only=False).astype(float)
                lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([values.tobytes()], pa.binary())], names=[*keep, "m"])

    return rows.select(*keep, vector_col).mapInArrow(run, schema)


def nearest(queries: DataFrame, registry: DataFrame, *, id_col: str, embedding: str = "embedding", max_broadcast: int = 20_000) -> DataFrame:
    """``id_col, speaker_id, similarity, invalid``: the most similar non-zero centroid, the earliest registered on ties.

    A registry of at most ``max_broadcast`` speakers (counted first) is sent to every task, and each block of _PART queries meets it in one
    matrix product that keeps each query's best. A larger one is cut into cells around pivots, of which a query visits only those that can hold its best.
    """
    return nearest_visits(queries, registry, id_col=id_col, embedding=embedding, max_broadcast=max_broadcast)[0]


def nearest_visits(queries: DataFrame, registry: DataFrame, *, id_col: str, embedding: str = "embedding", max_broadcast: int = 20_000) -> tuple[DataFrame, dict | None]:
    """:func:`nearest`, and how many of all cells the queries visited (None for a registry that was sent whole)."""
    speakers = registry.where(F.col("centroid").isNotNull() & (vector.norm("centroid") >= ZERO)).select("speaker_id", "insert_no", F.transform("centroid", lambda x: x.cast("double")).alias("c"))
    asked = queries.select(F.col(id_col).alias("id"), vector.unit(embedding, EPS).alias("q"), vector.norm(embedding).alias("_norm"))
    kind = asked.schema["id"].dataType.simpleString()
    size = speakers.count()
    usable = asked.where(F.col("_norm") >= ZERO)
    if size > max_broadcast:
        top, visited = cells.nearest(usable, speakers.select(F.col("speaker_id").alias("name"), F.col("insert_no").alias("no"), "c"), size)
        top = top.withColumnsRenamed({"name": "speaker_id", "no": "insert_no"})
    else:
        right = F.broadcast(_packed(speakers.coalesce(1), "c", ["speaker_id", "insert_no"]).withColumnRenamed("m", "c"))

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    ids, names, nos = (b.column(c)[i].values for c in ("id", "speaker_id", "insert_no"))
                    q = np.frombuffer(b.column("m")[i].as_py()).reshape(len(ids), -1)
                    c = np.frombuffer(b.column("c")[i].as_py()).reshape(len(names), -1)
                    order = np.argsort(nos.to_numpy(), kind="stable")  # the first of equal ones is the earliest
                    sims = q @ c[order].T
                    at = sims.argmax(1)
                    take = pa.array(order[at])
                    yield pa.RecordBatch.from_arrays([ids, names.take(take), nos.take(take), pa.array(sims[np.arange(len(at)), at])], names=["id", "speaker_id", "insert_no", "similarity"])

        found = _packed(usable, "q", ["id"]).crossJoin(right).mapInArrow(best, f"id {kind}, speaker_id string, insert_no long, similarity double")
        top = found.groupBy("id").agg(F.max_by(F.struct("speaker_id", "similarity"), F.struct("similarity", (-F.col("insert_no")).alias("i"))).alias("x")).select("id", "x.*")
        visited = None
    out = asked.select("id", "_norm").join(top, "id", "left")
    return out.select(F.col("id").alias(id_col), "speaker_id", F.coalesce("similarity", F.lit(-1.0)).alias("similarity"), (F.col("_norm") < ZERO).alias("invalid")), visited


def decide(queries: DataFrame, registry: DataFrame, *, id_col: str, embedding: str = "embedding", as_of: Column | None = None, base: float = BASE) -> DataFrame:
    """``similarity, threshold, decision``: match, uncertain (the gray zone below the threshold), new, or invalid for a zero vector."""
    found = nearest(queries, registry, id_col=id_col, embedding=embedding)
    known = registry.select(F.col("speaker_id").alias("_sp"), "n_samples", "last_seen")
    limit = adaptive_threshold(F.col("n_samples"), F.col("last_seen") if as_of is not None else None, as_of, base)
    rows = found.join(known, F.col("speaker_id") == F.col("_sp"), "left").withColumn("threshold", F.when(F.col("_sp").isNotNull(), limit))
    what = F.when(F.col("invalid"), "invalid").when(F.col("similarity") >= F.col("threshold"), "match").when(F.col("similarity") >= F.col("threshold") - GRAY, "uncertain").otherwise("new")
    return rows.select(id_col, "speaker_id", "similarity", "threshold", what.alias("decision"))


class Columns:
    """Vectors that are asked for the nearest, in blocks of rows, while some of them change between rows.

    A block meets all columns in one product. Columns that change inside the block are corrected before the next row is answered, and new ones are
    added. The few columns within rounding of the best are compared by their own sums of products, so answers don't depend on the blocks.
    """

    ROOM, NEAR = 32_000_000, 1e-9

    def __init__(self, width: int = 0, room: int = 16):
        self.m, self.size, self.dead, self.n = np.zeros((room, width)), np.ones(room), np.zeros(room, bool), 0
        self.touched: set[int] = set()

    def add(self, v: np.ndarray | None, size: float = 1.0) -> int:
        if self.n == len(self.m):
            grown = lambda x: np.concatenate([x, np.zeros_like(x)])
            self.m, self.size, self.dead = grown(self.m), grown(self.size), grown(self.dead)
        self.n += 1
        self.put(self.n - 1, v, size)
        return self.n - 1

    def put(self, i: int, v: np.ndarray | None, size: float = 1.0) -> None:
        """``None``: the column matches nothing."""
        self.dead[i] = v is None
        if v is not None:
            if not self.m.shape[1]:
                self.m = np.zeros((len(self.m), len(v)))
            self.m[i], self.size[i] = v, size
        self.touched.add(i)

    def _sims(self, which, q: np.ndarray) -> np.ndarray:
        return np.where(self.dead[which], -np.inf, self.m[which] @ q / self.size[which])

    def nearest(self, rows: np.ndarray) -> Iterator[tuple[int | None, float]]:
        """The first of the most similar columns for each row, as columns are by then."""
        at = 0
        while at < len(rows):
            n = self.n
            block = rows[at : at + max(16, min(256, self.ROOM // max(n, 1)))]
            self.touched = set()
            known = np.where(self.dead[:n], -np.inf, block @ self.m[:n].T / self.size[:n]) if n else np.zeros((len(block), 0))
            for q, sims in zip(block, known, strict=True):
                changed = [i for i in self.touched if i < n]
                if changed:
                    sims[changed] = self._sims(changed, q)
                fresh = self._sims(slice(n, self.n), q) if self.n > n else np.zeros(0)
                top = max(sims.max(initial=-np.inf), fresh.max(initial=-np.inf))
                if top == -np.inf:
                    yield None, -1.0
                    continue
                near = np.concatenate([np.flatnonzero(sims >= top - self.NEAR), n + np.flatnonzero(fresh >= top - self.NEAR)])
                exact = (self.m[near] * q).sum(axis=1) / self.size[near]
                best = int(exact.argmax())
                yield int(near[best]), float(exact[best])
            at += len(block)


class Registry:
    """The fold's state in a task: rows of the speakers table in order of registration. ``changed`` holds the names of those that a call has written."""

    def __init__(self, rows: list[dict], base: float = BASE):
        self.base = base
        self.rows = sorted((dict(r) for r in rows), key=lambda r: r["insert_no"])
        usable = [r["centroid"] is not None and np.linalg.norm(r["centroid"]) >= ZERO for r in self.rows]
        width = max([len(r["centroid"]) for r, ok in zip(self.rows, usable, strict=True) if ok], default=0)
        self.known = Columns(width, max(16, 2 * len(self.rows)))
        for r, ok in zip(self.rows, usable, strict=True):
            self.known.add(np.asarray(r["centroid"], float) if ok else None)
        self.changed: set[str] = set()
        self._count()

    def _count(self) -> None:
        self.next = 1 + max([int(t) for r in self.rows if (t := str(r["speaker_id"]).rpartition("_")[2]).isdigit()], default=0)
        self.order = 1 + max([r["insert_no"] for r in self.rows], default=0)

    def threshold(self, r: dict, now: pd.Timestamp | None) -> float:
        n = r["n_samples"]
        out = self.base + (0.07 if n <= 5 else 0.03 if n <= 30 else -0.03)
        return out + 0.05 if now is not None and r["last_seen"] is not None and (now - r["last_seen"]).days > 30 else out

    def take(self, vectors: list[np.ndarray | None], times: list[pd.Timestamp | None]) -> list[tuple[str | None, float, str]]:
        """Match vectors in order and update after each: a match moves its centroid, anything else registers."""
        sizes = [0.0 if v is None else float(np.linalg.norm(v)) for v in vectors]
        valid = [i for i, size in enumerate(sizes) if size >= ZERO]
        out: list[tuple[str | None, float, str]] = [(None, -1.0, "invalid")] * len(vectors)
        if valid:
            units = np.stack([vectors[i] / (sizes[i] + EPS) for i in valid])
            for i, q, (at, sim) in zip(valid, units, self.known.nearest(units), strict=True):
                out[i] = self._update(q, times[i], at if sim > -1.0 else None, sim)
        return out

    def _update(self, q: np.ndarray, now: pd.Timestamp | None, at: int | None, sim: float) -> tuple[str, float, str]:
        best = None if at is None else self.rows[at]
        if best is not None and sim >= (limit := self.threshold(best, now)):
            rate = min(0.1, 1 / max(best["n_samples"], 1))
            c = (1 - rate) * np.asarray(best["centroid"], float) + rate * q
            c = c / (np.linalg.norm(c) + EPS)
            self.known.put(at, c)
            best |= {"centroid": c.tolist(), "n_samples": best["n_samples"] + 1, "last_seen": now, "match_history": [*(best["match_history"] if best["match_history"] is not None else []), round(float(q @ c), 4)][-HISTORY:]}
            self.changed.add(best["speaker_id"])
            return best["speaker_id"], sim, "match"
        near = best is not None and sim >= limit - GRAY
        name = f"persist_{self.next:03d}"
        self.known.add(q)
        self.rows.append({"speaker_id": name, "insert_no": self.order, "label": f"auto_spk_{self.next:03d}", "centroid": q.tolist(), "n_samples": 1, "first_seen": now, "last_seen": now, "registered": False, "match_history": [], "possible_match": best["speaker_id"] if near else None, "possible_sim": sim if near else None})
        self.changed.add(name)
        self.next, self.order = self.next + 1, self.order + 1
        return name, sim if best is not None else -1.0, "uncertain" if near else "new"

    def forget(self, speaker_id: str) -> bool:
        """Erase a speaker and all references to them; later vectors don't match them."""
        at = next((i for i, r in enumerate(self.rows) if r["speaker_id"] == speaker_id), None)
        if at is None:
            return False
        others = [r for i, r in enumerate(self.rows) if i != at]
        for r in others:
            if r.get("possible_match") == speaker_id:
                r |= {"possible_match": None, "possible_sim": None}
                self.changed.add(r["speaker_id"])
        known = Columns(self.known.m.shape[1], max(16, 2 * len(others)))
        for i in range(len(self.rows)):
            if i != at:
                known.add(None if self.known.dead[i] else self.known.m[i])
        self.rows, self.known = others, known
        self.changed.discard(speaker_id)
        self._count()
        return True


def match_and_update(batch: DataFrame, registry: DataFrame, *, id_col: str, order_by: str, scope: str | None = None, embedding: str = "embedding", now: str | None = None, base: float = BASE) -> tuple[DataFrame, DataFrame]:
    """``(registry', out)``. Within a scope rows are taken in order, which only one task can do; scopes run side by side. A block of rows meets the
    registry in one product, and what the rows of the block change in it is corrected.

    Both results come from one fold whose rows are written once.
    """
    from cadence.sources.tables import scratch

    key = F.col(scope).cast("string") if scope else F.lit("")
    kind = batch.schema[id_col].dataType.simpleString()
    left = batch.select(key.alias("scope"), F.col(id_col).alias("id"), F.col(order_by).alias("ord"), F.col(embedding).cast("array<double>").alias("embedding"), (F.col(now).cast("timestamp") if now else F.lit(None).cast("timestamp")).alias("now"))
    own = (F.col(scope).cast("string") if scope and scope in registry.columns else F.lit("")).alias("scope")
    right = registry.select(own, *[F.col(f.name).cast(f.dataType) for f in SPEAKERS])
    cols = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SPEAKERS)

    def fold(_, rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known = known.astype(object).where(known.notna(), None) if len(known) else known
        state = Registry(known.drop(columns="scope").to_dict("records") if len(known) else [], base)
        rows = rows.sort_values("ord", kind="stable")
        vectors = [None if e is None else np.asarray(e, float) for e in rows["embedding"]]
        done = state.take(vectors, [None if pd.isna(t) else t for t in rows["now"]])
        out = [{"kind": "out", "id": i, "speaker_id": who, "similarity": sim, "decision": what} for i, (who, sim, what) in zip(rows["id"], done, strict=True)]
        out += [{"kind": "registry", **r} for r in state.rows]
        tag = rows["scope"].iloc[0] if len(rows) else known["scope"].iloc[0]
        frame = pd.DataFrame(out, columns=["kind", "id", "similarity", "decision", *SPEAKERS.names])
        frame = frame.astype(object).where(frame.notna(), None)
        frame.insert(0, "scope", tag)
        return frame

    schema = f"scope string, kind string, id {kind}, similarity double, decision string, {cols}"
    done = scratch(left.groupBy("scope").cogroup(right.groupBy("scope")).applyInPandas(fold, schema), "fold")
    out = done.where("kind = 'out'").select(F.col("id").alias(id_col), "scope", "speaker_id", "similarity", "decision")
    return done.where("kind = 'registry'").select("scope", *SPEAKERS.names), out


def greedy_cluster(df: DataFrame, *, scope: str, id_col: str, order_by: str, embedding: str = "embedding", threshold: float = BASE, compat: bool = False) -> DataFrame:
    """``scope, id_col, cluster``: in order, join the most similar group from ``threshold`` on, else open one. Zero vectors have no group; with ``compat`` they go to group 0 and centroids are plain means."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord", kind="stable")
        vectors = [np.zeros(0) if e is None else np.asarray(e, float) for e in rows["embedding"]]
        norms = [float(np.linalg.norm(v)) for v in vectors]
        labels: list[int | None] = [0 if compat else None] * len(rows)
        valid = [i for i, size in enumerate(norms) if size >= ZERO]
        if valid:
            units = np.stack([vectors[i] / (norms[i] + EPS) for i in valid])
            groups, sums, sizes = Columns(units.shape[1]), [], []
            for i, q, (best, sim) in zip(valid, units, groups.nearest(units), strict=True):
                if best is not None and sim >= threshold:
                    sums[best], sizes[best] = sums[best] + q, sizes[best] + 1
                    groups.put(best, sums[best], sizes[best] if compat else float(np.linalg.norm(sums[best]) + EPS))
                    labels[i] = best
                else:
                    sums.append(q)
                    sizes.append(1)
                    labels[i] = groups.add(q, 1 if compat else float(np.linalg.norm(q) + EPS))
        return pd.DataFrame({"scope": rows["scope"], "id": rows["id"], "cluster": pd.array(labels, "Int64")})

    rows = df.select(F.col(scope).cast("string").alias("scope"), F.col(id_col).alias("id"), F.col(order_by).alias("ord"), F.col(embedding).cast("array<double>").alias("embedding"))
    return rows.groupBy("scope").applyInPandas(run, f"scope string, id {kind}, cluster long").withColumnRenamed("id", id_col)


def rename(registry: DataFrame, speaker_id: str, label: str) -> DataFrame:
    if not label.strip():
        raise ValueError("a label must not be blank")
    hit = F.col("speaker_id") == speaker_id
    return registry.withColumns({"label": F.when(hit, F.lit(label.strip())).otherwise(F.col("label")), "registered": F.when(hit, F.lit(True)).otherwise(F.col("registered"))})


def merge(registry: DataFrame, keep: str, gone: str, baselines: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """``gone`` becomes part of ``keep``, in the registry and in the baselines. An unknown id changes nothing."""
    if keep == gone:
        raise ValueError("a speaker cannot be merged with itself")
    b = registry.where(F.col("speaker_id") == gone).select(F.col("centroid").alias("_c"), F.col("n_samples").alias("_n"), F.col("last_seen").alias("_l"), F.col("match_history").alias("_h"))
    both = registry.where(F.col("speaker_id") == keep).crossJoin(b)  # one row each
    n = F.col("n_samples") + F.col("_n")
    new = both.withColumns({
        "centroid": vector.weighted_merge("centroid", F.col("n_samples"), "_c", F.col("_n")),
        "n_samples": n,
        "last_seen": F.greatest("last_seen", "_l"),
        "match_history": vector.tail(F.concat("match_history", "_h"), HISTORY),
    }).select(*registry.columns)
    merged = new.select(F.lit(1).alias("_did")).limit(1)
    old = registry.where(~F.col("speaker_id").isin(keep, gone)).select(*registry.columns)
    untouched = registry.where(F.col("speaker_id").isin(keep, gone)).join(merged, F.lit(True), "left_anti").select(*registry.columns)
    out = forget_references(old.unionByName(new).unionByName(untouched), gone, keep)
    if baselines is None:
        return out, None
    sums = baselines.withColumn("speaker_id", F.when(F.col("speaker_id") == gone, F.lit(keep)).otherwise(F.col("speaker_id"))).groupBy("speaker_id").agg(*[F.sum(c).alias(c) for c in ("n", "sum_a", "sum_sq_a")])
    return out, sums


def forget_references(registry: DataFrame, gone: str, instead: str | None = None) -> DataFrame:
    if "possible_match" not in registry.columns:
        return registry
    hit = F.col("possible_match") == gone
    named = F.when(hit & (F.col("speaker_id") != F.lit(instead)), F.lit(instead)) if instead else F.when(hit, F.lit(None).cast("string"))
    return registry.withColumns({"possible_match": F.when(hit, named).otherwise(F.col("possible_match")), "possible_sim": F.when(hit & named.isNull(), F.lit(None).cast("double")).otherwise(F.col("possible_sim"))})


def erase(registry: DataFrame, speaker_id: str, *others: DataFrame) -> list[DataFrame]:
    """The registry and all other tables without a speaker, and without references to them."""
    return [forget_references(registry.where(F.col("speaker_id") != speaker_id), speaker_id), *(t.where(F.col("speaker_id") != speaker_id) for t in others)]


def summary(registry: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Stage and mean history of every speaker, most samples first."""
    n = F.col("n_samples")
    stale = age_days(F.col("last_seen"), as_of) > 30 if as_of is not None else F.lit(False)
    stage = F.when(n <= 5, "cold").when(n <= 30, "warm").when(stale, "stale").otherwise("stable")
    h = F.col("match_history")
    mean = F.when(F.size(h) > 0, F.try_divide(F.aggregate(h, F.lit(0.0), lambda s, x: s + x), F.size(h))).otherwise(F.lit(0.0))
    return registry.select("speaker_id", "label", "n_samples", stage.alias("stage"), mean.alias("avg_similarity"), "insert_no").orderBy(F.desc("n_samples"), "insert_no")


def display(registry: DataFrame, as_of: Column | None = None) -> DataFrame:
    """The table of known speakers, most samples first, and the text by which one is chosen."""
    s = summary(registry, as_of).join(registry.select("speaker_id", "first_seen", "last_seen"), "speaker_id")
    name = F.when(F.col("label") != F.col("speaker_id"), F.format_string("%s (%s)", "speaker_id", "label")).otherwise(F.col("speaker_id"))
    mean = F.when(F.col("avg_similarity") == 0, "--").otherwise(F.format_string("%.4f", F.col("avg_similarity")))
    return s.orderBy(F.desc("n_samples"), "insert_no").select("speaker_id", "label", "n_samples", "stage", mean.alias("avg_similarity"), "first_seen", "last_seen", name.alias("choice"))


def speaker_ids(registry: DataFrame) -> DataFrame:
    """``position, speaker_id`` in order of registration, from 0."""
    return ranges.numbered(registry.select("speaker_id", "insert_no"), ["insert_no"], "position").select("position", "speaker_id")


def cluster_counts(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    by = df.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    return by.agg(F.count(F.lit(1)).alias("n_speakers"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(cluster).cast("string"), "n")))).alias("segments_per_speaker"), F.sum("n").alias("total"))


def next_number(registry: DataFrame) -> DataFrame:
    """The number of the next new id; ids without a number don't count."""
    tail = F.regexp_extract("speaker_id", r"_(\d+)$", 1)
    return registry.agg((F.coalesce(F.max(F.when(tail != "", tail.cast("int"))), F.lit(0)) + 1).alias("next"))

