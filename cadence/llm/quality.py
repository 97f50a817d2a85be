"""Quality rules: a linear-chain conditional random field labels every line.

Lines are marked content or boilerplate by Viterbi decoding; the share of a
document's words in content lines decides whether it is kept.

The field is trained on labelled documents, line by line. A line of a good document counts as content and one of a
bad document as boilerplate, but a line that documents of both kinds hold counts as most of them are
(boilerplate on ties), and one that repeats an earlier line of its document is boilerplate; so labels change inside documents and the
weights of label pairs are learnt from such changes. Every step of the ascent takes expected counts over all
training lines in the tasks and sends a few sums to the driver.

Defined cases: a null text has no words and no lines, so it fails the base
rule; texts of any length are whole, in training too; ties between label sequences go to content; rows that repeat give rows that repeat; null ids are carried along;
an empty table gives an empty result; without labelled documents of both kinds every line is content, so that only the base
rule decides; other columns are ignored (or carried, by :func:`keep`), whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm import words as W
from cadence.llm.common import Workspace, release

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
N_FEATURES = 10
#: Bound of the training sample: labelled ids.
MAX_DOCS = 2000
_UPPER = re.compile(r"[^\W\d_a-zß-öø-ÿ]")
_LETTER = re.compile(r"[\W\d_]+")
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def line_features(line: str, seen: bool) -> list[float]:
    """Features of a line with a word; ``seen``: an earlier line is equal."""
    n = len(line)
    parts = line.split()
    k = max(1, len(parts))
    letters = max(1, len(_LETTER.sub("", line)))
    symbols = sum(map(line.count, "#*$%&|<>=~^_{}\\"))
    return [
        1.0,
        min(1.0, 4.0 * symbols / n),
        len(_UPPER.findall(line)) / letters,
        min(1.0, line.count("!") / k),
        min(1.0, 2.0 * line.count("|") / k),
        1.0 - len(set(parts)) / k,
        min(1.0, letters / n),
        min(1.0, np.log1p(k) / 6.0),
        1.0 if line.rstrip()[-1:] in ".!?…\"'" else 0.0,
        1.0 if seen else 0.0,
    ]


def features(text: str | None) -> tuple[list[list[float]], list[int], int]:
    """Features and word counts of the lines that have words, and how many equal an earlier one."""
    rows, sizes, seen, dup = [], [], set(), 0
    for line in (text or "").split("\n"):
        if not (k := len(line.strip(SPACES))):
            continue
        again = line in seen
        dup += again
        seen.add(line)
        rows.append(line_features(line, again))
        sizes.append(k)
    return rows, sizes, dup


@dataclass
class Field:
    """Weights of label 1 (content) against 0, of label pairs, and of the first label."""

    w: np.ndarray
    pair: np.ndarray
    start: np.ndarray

    @staticmethod
    def content() -> Field:
        return Field(np.concatenate([[1e3], np.zeros(N_FEATURES - 1)]), np.zeros((2, 2)), np.zeros(2))


Sequence = tuple[np.ndarray, np.ndarray, float]


def likelihood(docs: list[Sequence], theta: np.ndarray, cells: int = 40_000) -> tuple[float, np.ndarray]:
    """Weighted log-likelihood of the labels and its gradient; ``docs``: features and labels by line, and a weight. Documents of like length go side by side."""
    w, pair, start = theta[:N_FEATURES], theta[N_FEATURES:-2].reshape(2, 2), theta[-2:]
    docs = sorted(docs, key=lambda d: -len(d[0]))
    value, grad, at = 0.0, np.zeros_like(theta), 0
    while at < len(docs):
        length = len(docs[at][0])
        part = docs[at : at + max(1, cells // length)]
        at += len(part)
        n = len(part)
        x, y, on = np.zeros((n, length, N_FEATURES)), np.zeros((n, length), np.int64), np.zeros((n, length), bool)
        for i, (rows, labels, _) in enumerate(part):
            x[i, : len(rows)], y[i, : len(rows)], on[i, : len(rows)] = rows, labels, True
        weight = np.array([d[2] for d in part])
        unary = np.zeros((n, length, 2))
        unary[:, :, 1] = x @ w
        fwd, bwd = np.zeros((n, length, 2)), np.zeros((n, length, 2))
        fwd[:, 0] = start + unary[:, 0]
        for t in range(1, length):
            fwd[:, t] = np.where(on[:, t, None], np.logaddexp(fwd[:, t - 1, :1] + pair[0], fwd[:, t - 1, 1:] + pair[1]) + unary[:, t], fwd[:, t - 1])
        for t in range(length - 2, -1, -1):
            nxt = unary[:, t + 1] + bwd[:, t + 1]
            bwd[:, t] = np.where(on[:, t + 1, None], np.logaddexp(pair[:, 0] + nxt[:, :1], pair[:, 1] + nxt[:, 1:]), 0)
        total = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        post = np.exp(fwd + bwd - total[:, None, None])
        each = weight[:, None] * on
        grad[:N_FEATURES] += np.einsum("nl,nlf->f", each * (y - post[:, :, 1]), x)
        inner = each[:, 1:, None, None]
        both = np.exp(fwd[:, :-1, :, None] + pair + (unary + bwd)[:, 1:, None, :] - total[:, None, None, None])
        truth = np.zeros((n, max(0, length - 1), 2, 2))
        np.put_along_axis(truth.reshape(n, -1, 4), (2 * y[:, :-1] + y[:, 1:])[:, :, None], 1.0, 2)
        grad[N_FEATURES:-2] += ((truth - both) * inner).sum((0, 1)).ravel()
        grad[-2:] += (weight[:, None] * (np.stack([1 - y[:, 0], y[:, 0]], 1) - post[:, 0])).sum(0)
        path = (np.take_along_axis(unary, y[:, :, None], 2)[:, :, 0] * on).sum(1) + start[y[:, 0]] + (pair[y[:, :-1], y[:, 1:]] * on[:, 1:]).sum(1)
        value += float((weight * (path - total)).sum())
    return value, grad


def ascend(evaluate, steps: int = 30, ridge: float = 1e-3, tol: float = 1e-4) -> np.ndarray:
    """Weights at the maximum of a concave function less a ridge, by BFGS; ``evaluate`` takes some weights at once, so one pass over the data tries several step lengths."""
    size = N_FEATURES + 6

    def at(thetas: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        return [(ridge / 2 * float(t @ t) - f, ridge * t - g) for t, (f, g) in zip(thetas, evaluate(thetas), strict=True)]

    theta, h = np.zeros(size), np.eye(size)
    f, g = at([theta])[0]
    for _ in range(steps):
        if np.abs(g).max() < tol:
            break
        way = -h @ g
        tries = [theta + a * way for a in (2.0, 0.7, 0.1)]
        found = at(tries)
        k = min(range(len(tries)), key=lambda k: found[k][0])
        if found[k][0] >= f - 1e-9:
            if np.array_equal(h, np.eye(size)):
                break
            h = np.eye(size)
            continue
        s, y = tries[k] - theta, found[k][1] - g
        theta, (f, g) = tries[k], found[k]
        if (sy := float(s @ y)) > 1e-12:
            v = np.eye(size) - np.outer(s, y) / sy
            h = v @ h @ v.T + np.outer(s, s) / sy
    return np.round(theta, 9)


def viterbi(field: Field, scores: list[float]) -> list[int]:
    """The most likely labels; ``scores``: of label 1 against 0 by line. Ties go to content."""
    (p00, p01), (p10, p11) = field.pair.tolist()
    a, b = float(field.start[0]), float(field.start[1]) + scores[0]
    back = []
    for s in scores[1:]:
        from0, from1 = (a + p00 > b + p10, a + p01 > b + p11)
        back.append((from0, from1))
        a, b = (a + p00 if from0 else b + p10), (a + p01 if from1 else b + p11) + s
    label = 0 if a > b else 1
    out = [label]
    for pair in reversed(back):
        label = 0 if pair[label] else 1
        out.append(label)
    return out[::-1]


def line_labels(docs: DataFrame, labels: DataFrame, max_docs: int, seed: int) -> DataFrame:
    """``x, y, quality`` of the sampled documents: features of all lines with words (float32) and their labels (bytes), packed."""
    ids = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    ids = ids.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "quality")  # ids bounded by max_docs

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            for text, quality in zip(b.column("text"), b.column("quality").to_pylist(), strict=True):
                lines = [t for t in (text.as_py() or "").split("\n") if t.strip(SPACES)]
                if lines:
                    x = np.asarray(features("\n".join(lines))[0], np.float32)
                    keys = [xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for t in lines]
                    doc = xxhash.xxh3_64_intdigest("\n".join(lines).encode("utf-8", "surrogatepass")) - (1 << 63)
                    yield pa.RecordBatch.from_arrays([pa.array([doc]), pa.array([quality], pa.int32()), pa.array([x.tobytes()], pa.binary()), pa.array([keys], pa.list_(pa.int64()))], names=["doc", "quality", "x", "keys"])

    found = rows.mapInArrow(extract, "doc long, quality int, x binary, keys array<long>").dropDuplicates(["doc", "quality"])
    found = Workspace(docs.sparkSession, "crf").put(found, "lines")
    lines = found.select("doc", "quality", F.posexplode("keys").alias("no", "key"))
    first = lines.groupBy("doc", "quality", "key").agg(F.min("no").alias("first"))
    votes = first.groupBy("key").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    voted = lines.join(first, ["doc", "quality", "key"]).join(votes, "key")
    y = F.when(F.col("no") > F.col("first"), 0).when(F.col("bad") == 0, 1).when(F.col("good") > F.col("bad"), 1).otherwise(0)
    labels = voted.groupBy("doc", "quality").agg(F.transform(F.sort_array(F.collect_list(F.struct("no", y.cast("int").alias("y")))), lambda r: r["y"]).alias("y"))
    return found.select("doc", "quality", "x").join(labels, ["doc", "quality"])


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, seed: int = 11) -> Field:
    """Fit on the whole texts of at most ``max_docs`` labelled ids, chosen by a hash; that bound also bounds the broadcast of ids."""
    ws = Workspace(docs.sparkSession, "crf")
    rows = ws.put(line_labels(docs, labels, max_docs, seed), "labelled")
    counts = {r["quality"]: r["n"] for r in rows.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return Field.content()
    n = sum(counts.values())
    schema = "part int, k int, value double, grad array<double>"

    def evaluate(thetas: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release()  # what other operators' tasks have left in this worker
            part, docs = TaskContext.get().partitionId(), []
            for b in batches:
                for x, y, q in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), b.column("quality").to_pylist(), strict=True):
                    x = np.frombuffer(x, np.float32).reshape(-1, N_FEATURES).astype(float)
                    docs.append((x, np.asarray(y), 0.5 / counts[q] / len(x) ** 0.5))  # both kinds weigh the same
            docs.sort(key=lambda d: (len(d[0]), d[0].tobytes()))
            got = [likelihood(docs, t) for t in thetas]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(got), pa.int32()), pa.array(range(len(got)), pa.int32()), pa.array([f for f, _ in got]), pa.array([g.tolist() for _, g in got], pa.list_(pa.float64()))], names=["part", "k", "value", "grad"])
            release()

        got = rows.select("x", "y", "quality").mapInArrow(run, schema).collect()
        out = []
        for k in range(len(thetas)):
            own = [r for r in got if r["k"] == k]
            out.append((math.fsum(r["value"] for r in own), np.array([math.fsum(c) for c in zip(*(r["grad"] for r in own), strict=True)])))
        return out

    theta = ascend(evaluate) if n else np.zeros(N_FEATURES + 6)
    ws.drop("labelled")
    return Field(theta[:N_FEATURES].copy(), theta[N_FEATURES:-2].reshape(2, 2).copy(), theta[-2:].copy())


def _repeat_words(w: W.Words, n_texts: int) -> np.ndarray:
    """By text, how many words stand in a window of three that the text has twice or more."""
    key, owner, at = W.windows(w, 3)
    key = W.mixed(key + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    often = np.zeros(len(key), bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    hit = np.zeros(len(w.hashes) + 3, bool)
    place = (w.first[owner] + at)[often]
    for j in range(3):
        hit[place + j] = True
    return np.diff(np.concatenate([[0], np.cumsum(hit)])[w.first])


def _upto(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offs])


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, content_share double, base_failed boolean, kept boolean"


def judged(texts: pa.Array, field: Field, min_share: float, min_words: int, max_repeat: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Row ranges of a batch with the columns of SCHEMA after the id."""
    for i, j in W.chunks(texts):
        part = texts.slice(i, j - i)
        raw, offs = W.buffers(part)
        w = W.split(part, lower=False)
        n_words = w.counts.astype(np.int64)
        chars = _upto(~W._IS_SPACE[raw] & ((raw & 0xC0) != 0x80), offs)
        symbols = _upto(_IS_SYMBOL[raw], offs)
        repeat = _repeat_words(w, j - i)
        found = [features(t) for t in part.to_pylist()]
        flat = [r for rows, _, _ in found for r in rows]
        scores = (np.asarray(flat) @ field.w).tolist() if flat else []
        shares, at = [], 0
        for rows, sizes, _ in found:
            marks = viterbi(field, scores[at : at + len(rows)]) if rows else []
            at += len(rows)
            shares.append(sum(s for s, m in zip(sizes, marks, strict=True) if m) / max(1, sum(sizes)))
        share = np.asarray(shares)
        failed = (n_words < min_words) | (100 * repeat > max_repeat * n_words)
        counts = [n_words, chars, symbols, np.array([d for _, _, d in found]), repeat, np.array([len(r) for r, _, _ in found])]
        yield i, j, [*(c.astype(np.int64) for c in counts), share, failed, ~failed & (share >= min_share)]
    release()


def assess(docs: DataFrame, field: Field, *, min_share: float = 0.5, min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """One row per row of ``docs``: the base counts, the share of words in content lines and the verdict, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for b in batches:
            ids = b.column("doc_id").cast(pa.int64())
            for i, j, cols in judged(b.column("text"), field, min_share, min_words, max_repeat):
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), *(pa.array(c) for c in cols)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def keep(docs: DataFrame, field: Field, *, min_share: float = 0.5, min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """The rows of ``docs`` that :func:`assess` keeps, with all their columns, whatever their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, cols in judged(b.column("text"), field, min_share, min_words, max_repeat):
                yield b.slice(i, j - i).filter(pa.array(cols[-1]))

    return docs.mapInArrow(run, docs.schema)
