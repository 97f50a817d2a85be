"""Texts as blocks of word numbers, and the exchange of counts between blocks and shards.

A block holds some neighbouring texts of a file: their words as numbers of the
block's own vocabulary, sorted by hash. Counts over all texts come from shards
of the hash range: every block sends each word once, with its count, and gets
the total back. What travels is the distinct words of blocks, not words, so
a frequent word costs a shard one entry from each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm import words as W
from cadence.llm.common import Workspace, n_shuffle, release, rows_of

BLOCK_BYTES = 2 << 20
#: Class 0 is the end of a text, the others below are classes of word forms; common words follow, a class each.
N_CLASSES = 4096
#: A common word occurs so often in training, and is at least one in SHARE words there, so there are at most SHARE.
LEAST, SHARE = 20, 1 << 17


def form_classes(w: W.Words, which: np.ndarray) -> np.ndarray:
    """The class of each of these words: by length, first byte and last three bytes. So a short word has a class nearly of its own."""
    b, e, d = w.begin[which], w.end[which], w.data
    size = e - b
    key = np.minimum(size, 6).astype(np.uint64) * np.uint64(1 << 32) + d[b].astype(np.uint64) * np.uint64(1 << 24)
    for j in (1, 2, 3):
        key = key + np.where(size >= j, d[np.maximum(e - j, b)], 0).astype(np.uint64) * np.uint64(1 << (8 * (j - 1)))
    return (W.mixed(key + np.uint64(1)) % np.uint64(N_CLASSES - 1) + np.uint64(1)).astype(np.uint16)


def packed_ids(ids: np.ndarray, n: int) -> bytes:
    return ids.astype(np.uint16 if n <= 1 << 16 else np.uint32).tobytes()


def unpacked_ids(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint16 if n <= 1 << 16 else np.uint32)


def encode(docs: DataFrame, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` (``doc_id, text, train``) as blocks; null texts count as empty."""
    schema = "block long, doc_ids array<long>, train array<boolean>, sizes binary, ids binary, hashes binary, classes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        part, no = TaskContext.get().partitionId(), 0
        for b in batches:
            texts = b.column("text")
            for i, j in W.chunks(texts, block_bytes):
                w = W.split(texts.slice(i, j - i))
                vocab, index, ids = np.unique(w.hashes, return_index=True, return_inverse=True)
                row = [
                    (part << 32) + no,
                    b.column("doc_id").slice(i, j - i).to_pylist(),
                    b.column("train").slice(i, j - i).to_pylist(),
                    w.counts.astype(np.int32).tobytes(),
                    packed_ids(ids, len(vocab)),
                    vocab.tobytes(),
                    form_classes(w, index).tobytes(),
                ]
                no += 1
                kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)
        release()

    return docs.mapInArrow(run, schema)


def shards_of(spark) -> int:
    """A power of two, some shards for each shuffle partition."""
    return 1 << (4 * n_shuffle(spark) - 1).bit_length()


def exchange(blocks: DataFrame, ws: Workspace) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Total training counts for each block's vocabulary, and by class its training tokens and distinct words.

    Returns ``block, totals`` (int64 in vocabulary order, packed), an array
    of shape (classes, 2), and the sorted hashes of the common words, whose classes follow N_CLASSES.
    """
    spark = blocks.sparkSession
    n = shards_of(spark)
    shift = np.uint64(64 - (n.bit_length() - 1))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows_of(batches):
            hashes, classes = np.frombuffer(r["hashes"], np.uint64), np.frombuffer(r["classes"], np.uint16)
            sizes, train = np.frombuffer(r["sizes"], np.int32), np.array(r["train"], bool)
            used = unpacked_ids(r["ids"], len(hashes))[np.repeat(train, sizes)]
            counts = np.bincount(used, minlength=len(hashes)).astype(np.uint32)
            shard = (hashes >> shift).astype(np.int64) if n > 1 else np.zeros(len(hashes), np.int64)
            cut = np.searchsorted(shard, np.arange(n + 1))
            full = np.flatnonzero(np.diff(cut))
            out = [[int(s), r["block"], *(x[cut[s] : cut[s + 1]].tobytes() for x in (hashes, counts, classes))] for s in full]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["shard", "block", "hashes", "counts", "classes"])
        release()

    asked = blocks.select("block", "train", "sizes", "ids", "hashes", "classes").mapInArrow(ask, "shard int, block long, hashes binary, counts binary, classes binary")
    dealt = asked.repartition(n_shuffle(spark), "shard").sortWithinPartitions("shard")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["shard", "block", "totals", "stats", "often"], (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())

        def settled(shard: int, rows: list[dict]) -> pa.RecordBatch:
            hashes = np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in rows])
            counts = np.concatenate([np.frombuffer(r["counts"], np.uint32) for r in rows]).astype(np.float64)
            classes = np.concatenate([np.frombuffer(r["classes"], np.uint16) for r in rows])
            _, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            total = np.bincount(inverse, counts, len(index)).astype(np.int64)
            back, at, out = total[inverse], 0, []
            for r in rows:
                size = len(r["hashes"]) // 8
                out.append([shard, r["block"], back[at : at + size].tobytes(), None, None])
                at += size
            tokens = np.bincount(classes[index], total, N_CLASSES).astype(np.int64)
            kinds_of = np.bincount(classes[index], total > 0, N_CLASSES).astype(np.int64)
            many = total >= LEAST
            often = np.stack([hashes[index[many]].view(np.int64), total[many], classes[index[many]].astype(np.int64)])
            out.append([shard, -1, None, np.stack([tokens, kinds_of]).tobytes(), often.tobytes()])
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        held: list[dict] = []
        for r in rows_of(batches):  # one by one, so a batch is not held twice
            if held and held[0]["shard"] != r["shard"]:
                yield settled(held[0]["shard"], held)
                held = []
            held.append(r)
        if held:
            yield settled(held[0]["shard"], held)
        release()

    replies = ws.put(dealt.mapInArrow(answer, "shard int, block long, totals binary, stats binary, often binary"), "replies")

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, N_CLASSES), np.int64)
        for b in batches:
            for raw in b.column("stats").to_pylist():
                total += np.frombuffer(raw, np.int64).reshape(2, N_CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(N_CLASSES, dtype=np.int32)), pa.array(total[0]), pa.array(total[1])], names=["class", "tokens", "kinds"])

    rows = replies.where("block < 0").select("stats").mapInArrow(by_class, "class int, tokens long, kinds long").groupBy("class").agg(F.sum("tokens").alias("tokens"), F.sum("kinds").alias("kinds")).collect()
    stats = np.zeros((N_CLASSES, 2), np.int64)
    for r in rows:
        stats[r["class"]] = r["tokens"], r["kinds"]
    least = max(LEAST, int(stats[:, 0].sum()) / SHARE)

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column("often").to_pylist():
                word, total, kind = np.frombuffer(raw, np.int64).reshape(3, -1)
                keep = total >= least
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (word, total, kind)], names=["word", "total", "class"])

    got = replies.where("block < 0").select("often").mapInArrow(common, "word long, total long, class long").toArrow()  # at most SHARE rows
    word, total, kind = (got.column(c).to_numpy() for c in ("word", "total", "class"))
    order = np.argsort(word.view(np.uint64))
    np.subtract.at(stats, kind, np.stack([total, np.ones_like(total)], 1))
    stats = np.concatenate([stats, np.stack([total[order], np.ones_like(total)], 1)])
    return replies.where("block >= 0").select("block", "shard", "totals"), stats, word.view(np.uint64)[order]


def classes_of(hashes: np.ndarray, forms: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Each word's class: its own where it is common, else that of its form."""
    out = forms.astype(np.uint32)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        out = np.where(common[at] == hashes, at + N_CLASSES, out).astype(np.uint32)
    return out


def joined(blocks: DataFrame, replies: DataFrame) -> DataFrame:
    """``blocks`` with ``totals``: the replies of all shards in the order of the block's vocabulary."""
    lists = replies.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("shard", "totals"))).alias("totals"))
    return blocks.join(lists.select("block", F.col("totals.totals").alias("totals")), "block", "left")
