"""Scoring by a hidden Markov language model.

Latent states emit words: each word that is common in training by itself (how many there are
follows from the texts, up to a bound that keeps the table small enough for every task), and rarer ones through
classes of word forms, which emit their words by their counts in the training texts. Baum-Welch counts are
taken over all training texts: every task adds up its expected counts, shards of the classes add up the tasks', and
sums whose size depends on states and classes alone reach the driver. The
scaled forward recursion then gives each whole text's exact likelihood.

Tokens are words with A-Z lower-cased, then one end. A word that training has
not seen takes the share that its class keeps for such words.

Defined cases: a null text is the end alone; a null id trains; rows that repeat are rows of
their own; texts of any length are whole, one sequence each; without training texts the counts are zero and all known shares
uniform; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.llm.blocks import N_CLASSES, classes_of, encode, exchange, joined, unpacked_ids
from cadence.llm.common import Workspace, release, rows_of, whole

STATES, ROUNDS, STEP_TOKENS, GRAIN = 8, 5, 500_000, 1 << 16
#: So many classes' sums meet in one task.
SLICE = 1 << 14


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def start_model(tokens: np.ndarray, states: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First, transition and emission shares: states that tend to stay, each with classes weighted at random."""
    rng = np.random.Generator(np.random.PCG64(seed))
    first = np.full(states, 1 / states)
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9)
    emit = (tokens + 0.5) * np.exp(rng.normal(0, 0.7, (states, len(tokens))))
    return first, move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True)


class Lattice:
    """Sequences laid out by time: those still running at time t stand together, the longest first."""

    def __init__(self, sizes: np.ndarray, seen: np.ndarray):
        self.order = np.argsort(-sizes, kind="stable")
        rank = np.empty(len(sizes), np.int64)
        rank[self.order] = np.arange(len(sizes))
        self.longest = int(sizes.max()) if len(sizes) else 0
        running = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(self.longest), "right")
        self.at = np.concatenate([[0], np.cumsum(running)])
        ends = np.cumsum(sizes)
        step = np.arange(len(seen)) - np.repeat(ends - sizes, sizes)
        place = self.at[step] + np.repeat(rank, sizes)
        self.seen = np.empty(len(seen), seen.dtype)
        self.seen[place] = seen
        self.running = running


def forward(sizes: np.ndarray, seen: np.ndarray, first: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Log10 likelihood of each sequence of classes; all have a token at least."""
    lat = Lattice(sizes, seen)
    total, by_class = np.zeros(len(sizes)), np.ascontiguousarray(emit.T)
    a = np.tile(first, (len(sizes), 1))
    for t in range(lat.longest):
        n = lat.running[t]
        a = a[:n] @ move if t else a[:n]
        a = a * by_class[lat.seen[lat.at[t] : lat.at[t + 1]]]
        s = a.sum(1)
        a /= s[:, None]
        total[:n] += np.log10(s)
    out = np.empty(len(sizes))
    out[lat.order] = total
    return out


def expected(sizes: np.ndarray, seen: np.ndarray, first: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of first states, moves and emissions (one step of Baum-Welch), over whole sequences."""
    lat = Lattice(sizes, seen)
    k = len(first)
    shown = np.ascontiguousarray(emit.T.astype(np.float32))[lat.seen]
    fwd, scale = np.empty((len(seen), k), np.float32), np.empty((len(seen), 1), np.float32)
    step = move.astype(np.float32)
    a = np.tile(first.astype(np.float32), (len(sizes), 1))
    for t in range(lat.longest):
        i, j, n = lat.at[t], lat.at[t + 1], lat.running[t]
        a = a[:n] @ step if t else a[:n]
        a = a * shown[i:j]
        s = a.sum(1, keepdims=True)
        a /= s
        fwd[i:j], scale[i:j] = a, s
    back, moves = np.ones((0, k), np.float32), np.zeros((k, k))
    for t in range(lat.longest - 1, -1, -1):
        i, j, n = lat.at[t], lat.at[t + 1], lat.running[t]
        now = np.ones((n, k), np.float32)
        if m := len(back):
            ahead = back * shown[j : j + m] / scale[j : j + m]
            moves += fwd[i : i + m].T @ ahead
            now[:m] = ahead @ step.T
        back = now
        fwd[i:j] *= now
    emits = np.stack([np.bincount(lat.seen, fwd[:, s], emit.shape[1]) for s in range(k)])
    return fwd[: lat.at[1] if lat.longest else 0].sum(0).astype(float), moves * move, emits


def with_ends(sizes: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's classes and then the end's, 0."""
    return sizes + 1, np.insert(classes, np.cumsum(sizes), 0)


def train(blocks: DataFrame, tokens: np.ndarray, common: np.ndarray, *, states: int = STATES, rounds: int = ROUNDS, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch over the training texts of all blocks. Sums are of whole numbers (counts times GRAIN), so their order does not matter."""
    first, move, emit = start_model(tokens, states, seed)
    rows = blocks.select("train", "sizes", "ids", "hashes", "classes")
    width, n_slices = 1 + states + len(tokens), -(-(1 + states + len(tokens)) // SLICE)
    sent = blocks.sparkSession.sparkContext.broadcast(common)  # at most SHARE hashes
    for _ in range(rounds):

        def count(batches: Iterator[pa.RecordBatch], model=(first, move, emit)) -> Iterator[pa.RecordBatch]:
            total, common = np.zeros((states, width), np.int64), sent.value
            sizes, seen, held = [], [], 0

            def flush() -> None:
                nonlocal held
                if held:
                    a, b, c = expected(np.concatenate(sizes), np.concatenate(seen), *model)
                    total[:] += np.rint(np.concatenate([a[:, None], b, c], 1) * GRAIN).astype(np.int64)
                    sizes.clear()
                    seen.clear()
                    held = 0

            for r in rows_of(batches):
                size, on = np.frombuffer(r["sizes"], np.int32).astype(np.int64), np.array(r["train"], bool)
                classes = classes_of(np.frombuffer(r["hashes"], np.uint64), np.frombuffer(r["classes"], np.uint16), common)
                ids = unpacked_ids(r["ids"], len(classes))[np.repeat(on, size)]
                size, got = with_ends(size[on], classes[ids])
                sizes.append(size)
                seen.append(got)
                held += len(got)
                if held >= STEP_TOKENS:
                    flush()
            flush()
            parts = [x[k * SLICE : (k + 1) * SLICE].tobytes() for x in total for k in range(n_slices)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(parts, pa.binary())], names=["part", "counts"])
            release()

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for b in batches:
                for r in rows_of([b]):
                    total[r["part"]] = total.get(r["part"], 0) + np.frombuffer(r["counts"], np.int64)
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "counts"])

        schema = "part int, counts binary"
        got = rows.mapInArrow(count, schema).repartition(states * n_slices, "part").mapInArrow(add, schema).collect()
        sums = np.zeros((states, width))
        for r in got:
            state, k = divmod(r["part"], n_slices)
            part = np.frombuffer(bytes(r["counts"]), np.int64) / GRAIN
            sums[state, k * SLICE : k * SLICE + len(part)] = part
        first = sums[:, 0] + 0.1
        move = sums[:, 1 : 1 + states] + 0.1
        emit = sums[:, 1 + states :] + 0.01
        first, move, emit = first / first.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True)
    return first, move, emit


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, *, states: int = STATES, rounds: int = ROUNDS, add: float = 0.1, seed: int = 5) -> DataFrame:
    """One row per row of ``docs``: token counts, the unigram base and the model's log10 likelihood."""
    ws = Workspace(docs.sparkSession, "hmm")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"), (~held_out()).alias("train"))
    blocks = ws.put(encode(rows), "blocks")
    replies, stats, common = exchange(blocks, ws)
    ends = blocks.select(F.sum(F.size(F.filter("train", lambda x: x)).cast("long")).alias("n")).first()["n"] or 0
    stats[0] = ends, int(ends > 0)
    n_all, n_kinds = int(stats[:, 0].sum()), int(stats[:, 1].sum())
    model = train(blocks, stats[:, 0].astype(float), common, states=states, rounds=rounds, seed=seed)
    below = stats[:, 0] + add * (stats[:, 1] + 1.0)
    shared = docs.sparkSession.sparkContext.broadcast((common, below, *model))  # sizes depend on states and classes alone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base_below = np.log10(n_all + add * (n_kinds + 1))
        common, below, *model = shared.value
        for r in rows_of(batches):
            sizes = np.frombuffer(r["sizes"], np.int32).astype(np.int64)
            classes = classes_of(np.frombuffer(r["hashes"], np.uint64), np.frombuffer(r["classes"], np.uint16), common)
            total = np.concatenate([np.frombuffer(x, np.int64) for x in r["totals"]]) if r["totals"] else np.zeros(0, np.int64)
            ids = unpacked_ids(r["ids"], len(classes))
            ends_at = np.cumsum(sizes)

            def by_text(values: np.ndarray, ids=ids, ends_at=ends_at, sizes=sizes) -> np.ndarray:
                sums = np.concatenate([[0], np.cumsum(values[ids])])
                return sums[ends_at] - sums[ends_at - sizes]

            base = by_text(np.log10(total + add) - base_below) + np.log10(ends + add) - base_below
            share = np.where(classes < N_CLASSES, np.log10(total + add) - np.log10(below[classes]), 0.0)  # a common word is its class
            inside = by_text(share) + np.log10(ends + add) - np.log10(below[0])
            chain = forward(*with_ends(sizes, classes[ids]), *model)
            known = by_text((total > 0).astype(np.int64)) + int(ends > 0)
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(r["doc_ids"], pa.int64()), pa.array([not x for x in r["train"]], pa.bool_()), pa.array(sizes + 1), pa.array(known.astype(np.int64)), pa.array(np.full(n, n_all, np.int64)), pa.array(base), pa.array(inside + chain)],
                names=[f.split()[0] for f in SCHEMA.split(", ")],
            )
        release()

    return joined(blocks, replies).select("doc_ids", "train", "sizes", "ids", "hashes", "classes", "totals").mapInArrow(run, SCHEMA)
