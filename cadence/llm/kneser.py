"""Quality classifier: an interpolated modified Kneser-Ney word n-gram model of trusted text.

The model predicts every word of a text, and its end, from up to two words before. It is fitted on
all trusted documents but those held out for the thresholds (whole texts): grams are counted in shards, lower orders
count the words that stand before, and totals, discounts and back-off weights come
from joins of those counts by context. A word that training lacks has the share that
discounting leaves for one unseen word.

Of order 3, the one that is registered, the model is never on disk as a whole: trigrams fall into slices by the word in their middle,
and of a slice (:class:`Trigrams`) counts, shares, weights and all texts' sums are made before the next one, from the texts anew.
Other orders are tables of words (:func:`fit`).

Scores are joins of counts too. Telescoped over the orders, the logarithm of a text's
probability is a sum of one number for each of its grams that the model holds: what
the gram adds to its back-off, and the weight it has as a context of the next word. So every task
sends a text's grams, in hash shards, to the model's shards, which sum their numbers by
text, and the sums are added up. A bitmap of fixed size tells grams that the model surely lacks, and the
HEAD commonest grams, the hot keys of that join, are held by each task. Beyond that no gram is hot in
proportion to the corpus: the model is dealt out ``copies`` times, more for a larger corpus. Numbers are
whole (units of 2**-20), so sums don't depend on their order.

A document is kept where its perplexity a word is at most a quantile of trusted documents
of its language, ones that the model was not fitted on.

Defined cases: words keep their case; a text without words, or null, has no perplexity (null) and is
not kept; texts of any length are whole; a language without held-out trusted documents takes the threshold of all
of them; without any, nothing can be judged and all documents with words are kept; null
languages form a group of their own; rows that repeat give rows that repeat; null ids are carried along; other columns are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm import words as W
from cadence.llm.blocks import shards_of
from cadence.llm.common import Workspace, n_shuffle, release, rows_of
from cadence.llm.lines import _by_shard, _grouped, _meet, _table, bitmap
from cadence.operators.quantiles import percentiles

ORDER = 3
BEGIN, END = np.uint64(1), np.uint64(2)
#: One in so many trusted documents is kept from training, for the thresholds.
HELD = 5
#: Commonest grams held by each task, and bits of the bitmap of all grams (as a power of two).
HEAD, BITS = 1 << 19, 27
#: Bytes of input for one copy of the model's shards.
COPY_BYTES = 64 << 30
UNIT = float(1 << 20)
#: Ids of training documents that are sent to every task.
MOST_IDS = 1 << 22


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents labelled good and not toxic; of several labels all must agree."""
    toxic = F.coalesce(F.col("toxic"), F.lit(0)) if "toxic" in labels.columns else F.lit(0)
    by = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_q"), F.max(toxic).alias("_t"))
    return by.where("_q = 1 and _t = 0").select("doc_id")


def _place(seed: int):
    return F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"))


def training(docs: DataFrame, trusted: DataFrame, seed: int, max_docs: int | None = None) -> DataFrame:
    """Texts of all trusted ids, without those held out; with ``max_docs`` of that many, in a seeded order."""
    ids = trusted.where(F.pmod(_place(seed), F.lit(HELD)) != 0)
    if max_docs is not None:
        ids = ids.orderBy(_place(seed), "doc_id").limit(max_docs)
    ids = ids.select("doc_id").distinct()
    if ids.count() <= MOST_IDS:  # so no text is dealt out
        ids = F.broadcast(ids)
    return docs.select("doc_id", "text").join(ids, "doc_id").select("text")


def padded(w: W.Words, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' word hashes with ``order - 1`` begins before and an end after each; every place's text, and its place there."""
    sizes = w.counts + order
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)
    flat = np.full(len(at), BEGIN, np.uint64)
    flat[(at >= order - 1) & (at < np.repeat(sizes - 1, sizes))] = w.hashes
    flat[ends - 1] = END
    return flat, owner, at


def top_grams(texts: DataFrame, order: int) -> DataFrame:
    """``w0 .. w(order-1), a``: each word or end with the words before, and how often. Texts without words count for nothing."""
    names = [f"w{k}" for k in range(order)]
    schema = ", ".join(f"{n} long" for n in names) + ", a long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in W.chunks(b.column("text")):
                w = W.split(b.column("text").slice(i, j - i), lower=False)
                flat, owner, at = padded(w, order)
                last = np.flatnonzero((at >= order - 1) & (w.counts[owner] > 0))
                cols = [flat[last - order + 1 + k].view(np.int64) for k in range(order)]
                by = np.lexsort(cols[::-1])
                new = np.ones(len(by), bool)
                new[1:] = np.logical_or.reduce([c[by][1:] != c[by][:-1] for c in cols]) if len(by) else False
                head = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays([*(pa.array(c[by][head]) for c in cols), pa.array(np.diff(np.append(head, len(by))).astype(np.int64))], names=[*names, "a"])
        release()

    return texts.mapInArrow(run, schema).groupBy(*names).agg(F.sum("a").alias("a"))


def discounts(n: list[int]) -> list[float]:
    """For counts of one, two, and three or more, from the numbers of grams that occur 1 to 4 times."""
    n1, n2, n3, n4 = (max(1, x) for x in n)
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return [min(k + 0.95, max(0.05, d)) if np.isfinite(d) else 0.5 for k, d in enumerate(raw)]


def fit(docs: DataFrame, trusted: DataFrame, ws: Workspace, *, order: int = ORDER, max_docs: int | None = None, seed: int = 23) -> tuple[DataFrame, float]:
    """``w0 .., m, value, a`` of every gram of ``m`` words in the model (left-aligned, null beyond), and the logarithm of an unseen word's share.

    ``value``: what the gram's probability has above its back-off, and its weight as a context, both as natural logarithms.
    """
    names = [f"w{k}" for k in range(order)]
    level = ws.put(top_grams(training(docs, trusted, seed, max_docs), order), "top")
    levels = {order: level}
    for m in range(order - 1, 0, -1):  # lower orders count the words that stand before
        cols = names[order - m :]
        levels[m] = ws.put(levels[m + 1].groupBy(*cols).agg(F.count(F.lit(1)).alias("a")), f"level{m}")
    shares, weights = {}, {}
    for m in range(1, order + 1):
        cols = names[order - m :]
        n = levels[m].agg(*[F.count(F.when(F.col("a") == k, 1)) for k in (1, 2, 3, 4)], F.count(F.lit(1))).first()
        d = discounts(list(n)[:4])
        cut = F.when(F.col("a") == 1, d[0]).when(F.col("a") == 2, d[1]).otherwise(d[2])
        by = levels[m].groupBy(*cols[:-1]).agg(F.sum("a").alias("total"), F.sum(cut).alias("free"))
        if m == 1:
            all_ = by.first()
            if not all_ or not all_["total"]:
                return levels[order].select(*names, F.lit(0).alias("m"), F.lit(0.0).alias("value"), "a").where("false"), 0.0
            rest = all_["free"] / all_["total"] / (n[4] + 1)
            shares[1] = levels[1].select(*cols, "a", (F.greatest(F.col("a") - cut, F.lit(0.0)) / float(all_["total"]) + rest).alias("p"))
            shares[1] = ws.put(shares[1].withColumn("d", F.log("p") - float(np.log(rest))), "p1")
            continue
        weights[m - 1] = by.select(*cols[:-1], (F.col("free") / F.col("total")).alias("bow"), "total")
        lower = shares[m - 1].select(*cols[1:], F.col("p").alias("q"))
        got = levels[m].join(weights[m - 1], cols[:-1]).join(lower, cols[1:])
        p = F.greatest(F.col("a") - cut, F.lit(0.0)) / F.col("total") + F.col("bow") * F.col("q")
        got = got.select(*cols, "a", p.alias("p"), (F.log(p) - F.log("bow") - F.log("q")).alias("d"))
        shares[m] = ws.put(got, f"p{m}")
    out = None
    for m in range(1, order + 1):
        cols = names[order - m :]
        rows = shares[m]
        if m in weights:  # contexts of begins alone are no grams of the level
            ctx = weights[m].select(*[F.col(c).alias(n) for c, n in zip(names[order - m - 1 : order - 1], cols, strict=True)], "bow")
            rows = rows.join(ctx, cols, "full").select(*cols, F.coalesce("a", F.lit(0)).alias("a"), (F.coalesce("d", F.lit(0.0)) + F.coalesce(F.log("bow"), F.lit(0.0))).alias("d"))
        left = [F.col(cols[k]).alias(names[k]) if k < m else F.lit(None).cast("long").alias(names[k]) for k in range(order)]
        rows = rows.select(*left, F.lit(m).alias("m"), F.col("d").alias("value"), F.col("a").cast("long").alias("a"))
        out = rows if out is None else out.unionByName(rows)
    return out, float(np.log(rest))


def gram_hashes(flat: np.ndarray, last: np.ndarray, m: int) -> np.ndarray:
    """Of the ``m`` words up to each of these places."""
    total = np.full(len(last), np.uint64(m))
    for k in range(m):
        total = total + flat[last - m + 1 + k] * W._STEPS[k]
    return W.mixed(total)


def hashed(grams: DataFrame, order: int) -> DataFrame:
    """``hash, value`` (whole units), ``a``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.column("m").to_numpy()
            flat = np.stack([b.column(f"w{k}").fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64) for k in range(order)], 1)
            key = np.zeros(len(m), np.uint64)
            for k in range(1, order + 1):
                rows = np.flatnonzero(m == k)
                key[rows] = gram_hashes(flat.ravel(), rows * order + k - 1, k)
            value = np.rint(b.column("value").to_numpy() * UNIT).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(value), b.column("a")], names=["hash", "value", "a"])

    return grams.mapInArrow(run, "hash long, value int, a long")


_ROW = "shard int, block long, keys binary, docs binary"
_HEADER = ", ids binary, langs array<string>, counts binary, sums binary, digests binary"
_SCORED = "doc_id long, lang string, n_words long, digest binary, units long"

#: Finds the grams of texts: ``flat, owner, at`` of :func:`padded` and which places are of texts with words; hashes and their places.
Grams = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]


def log_shares(docs: DataFrame, model: DataFrame, floor: float, ws: Workspace, order: int, copies: int) -> DataFrame:
    """``doc_id, lang, n_words, log_p``: the natural logarithm of every text's probability, its end included."""
    packed = ws.put(model.mapInArrow(_packer(shards_of(docs.sparkSession)), "shard int, keys binary, docs binary"), "packed")
    top = np.array([tuple(r) for r in model.orderBy(F.desc("a"), "hash").limit(HEAD).select("hash", "value").collect()], np.int64).reshape(-1, 2)

    def grams(flat: np.ndarray, owner: np.ndarray, at: np.ndarray, full: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for m in range(1, order + 1):
            last = np.flatnonzero(full & (at >= (order - 1 if m == order else order - 2)))
            yield gram_hashes(flat, last, m), last

    got, _ = summed(docs, packed, (top[:, 0].copy().view(np.uint64), top[:, 1].astype(np.int32)), grams, int(round(floor * UNIT)), order, copies)
    return got.select("doc_id", "lang", "n_words", (F.col("units") / UNIT).alias("log_p"))


def summed(docs: DataFrame, packed: DataFrame, top: tuple[np.ndarray, np.ndarray], grams: Grams, unseen: int, order: int, copies: int) -> tuple[DataFrame, Broadcast]:
    """``doc_id, lang, n_words, digest, units``: the numbers of the model (``packed``) for every gram of a text, and ``unseen`` for every word and end, summed up; ``top``: hashes and numbers that each task holds. And the broadcast that the result needs."""
    spark = docs.sparkSession
    n, p = shards_of(spark), n_shuffle(spark)
    by = np.argsort(top[0])
    size = min(BITS, max(20, int(2 * (packed.agg(F.sum(F.octet_length("keys"))).first()[0] or 0)).bit_length()))  # sixteen for each gram
    shared = spark.sparkContext.broadcast((bitmap(packed.select("keys").mapInArrow(_numbers, "refs binary"), size), top[0][by], top[1][by]))
    names = [f.split()[0] for f in (_ROW + _HEADER).split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary()]

    def rows(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, head, head_value = shared.value
        part, no = TaskContext.get().partitionId(), 0
        for b in batches:
            for i, j in W.chunks(b.column("text")):
                texts = b.column("text").slice(i, j - i)
                w = W.split(texts, lower=False)
                flat, owner, at = padded(w, order)
                sums = np.where(w.counts > 0, (w.counts + 1) * unseen, 0).astype(np.int64)
                keys, docs_ = [], []
                for key, last in grams(flat, owner, at, w.counts[owner] > 0):
                    spot = (key >> np.uint64(64 - size)).astype(np.int64)
                    may = ((bits[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8)) & 1).astype(bool)
                    key, doc = key[may], owner[last[may]]
                    if len(head):
                        where = np.minimum(np.searchsorted(head, key), len(head) - 1)
                        hot = head[where] == key
                        sums += np.bincount(doc[hot], head_value[where[hot]], len(sums)).astype(np.int64)
                        key, doc = key[~hot], doc[~hot]
                    keys.append(key)
                    docs_.append(doc.astype(np.uint16 if j - i <= 1 << 16 else np.uint32))
                block = (part << 32) + no
                copy = no % copies
                no += 1
                key = np.concatenate(keys)
                shard = key >> np.uint64(64 - n.bit_length() + 1) if n > 1 else np.zeros(len(key), np.uint64)
                key = (shard << np.uint64(48)) | _short(key)
                by = np.argsort(key)  # so a shard finds neighbours one after the other
                key, doc = key[by], np.concatenate(docs_)[by]
                cut = np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << np.uint64(48))
                high, low = (key >> np.uint64(32)).astype(np.uint16), key.astype(np.uint32)
                out = [[int(s) * copies + copy, block, b"".join(c[cut[s] : cut[s + 1]].tobytes() for c in (high, low)), doc[cut[s] : cut[s + 1]].tobytes(), *[None] * 5] for s in np.flatnonzero(np.diff(cut))]
                ids = b.column("doc_id").slice(i, j - i)
                known = np.packbits(~np.asarray(ids.is_null())).tobytes()
                packed_ids = known + ids.fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False).tobytes()
                data, offs = W.buffers(texts)
                digests = b"".join(xxhash.xxh3_128_digest(data[s:e]) for s, e in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True))
                out.append([(block % n) * copies + copy, block, None, None, packed_ids, b.column("lang").slice(i, j - i).cast(pa.string()).to_pylist(), w.counts.astype(np.int64).tobytes(), sums.tobytes(), digests])
                for k in range(0, len(out), 64):
                    yield rows(out[k : k + 64])
        release()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, key, value, fresh = None, [], [], False
        for r in rows_of(batches):
            if r["shard"] != shard:
                shard, key, value, fresh = r["shard"], [], [], False
            if r["block"] < 0:  # the model's rows come first
                key.append(_short(np.frombuffer(r["keys"], np.uint64)))
                value.append(np.frombuffer(r["docs"], np.int32))
                continue
            if r["ids"] is not None:
                yield rows([[0, r["block"], None, None, *(r[c] for c in names[4:])]])
                continue
            if not fresh:
                keys = np.concatenate(key) if key else np.zeros(0, np.uint64)
                by = np.argsort(keys)
                keys, values, fresh = keys[by], (np.concatenate(value) if value else np.zeros(0, np.int32))[by], True
                key, value = [], []
            if not len(keys):
                continue
            count = len(r["keys"]) // 6
            asked = np.frombuffer(r["keys"], np.uint16, count).astype(np.uint64) << np.uint64(32) | np.frombuffer(r["keys"], np.uint32, count, 2 * count)
            doc = np.frombuffer(r["docs"], np.uint16 if len(r["docs"]) == 2 * count else np.uint32)
            where = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            hit = keys[where] == asked
            total = np.bincount(doc[hit], values[where[hit]]).astype(np.int64)
            texts = np.flatnonzero(total)
            if len(texts):
                total = total[texts]
                small = np.abs(total).max() < 1 << 31
                total, texts = total.astype(np.int32 if small else np.int64), texts.astype(np.uint16 if small and texts[-1] < 1 << 16 else np.uint32)
                yield rows([[0, r["block"], total.tobytes(), bytes([total.itemsize, texts.itemsize]) + texts.tobytes(), *[None] * 5]])
        release()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(header: dict, parts: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
            sums = np.frombuffer(header["sums"], np.int64).copy()
            for total, texts in parts:
                sums[np.frombuffer(texts[2:], f"u{texts[1]}")] += np.frombuffer(total, f"i{texts[0]}")
            count = np.frombuffer(header["counts"], np.int64)
            skip = -(-len(count) // 8)
            known = np.unpackbits(np.frombuffer(header["ids"], np.uint8, skip))[: len(count)].astype(bool)
            ids = np.frombuffer(header["ids"], np.int64, len(count), skip)
            digests = [header["digests"][16 * k : 16 * k + 16] for k in range(len(count))]
            return pa.RecordBatch.from_arrays([pa.array(ids, mask=~known), pa.array(header["langs"], pa.string()), pa.array(count), pa.array(digests, pa.binary()), pa.array(sums)], names=[f.split()[0] for f in _SCORED.split(", ")])

        block, header, parts = None, None, []
        for r in rows_of(batches):
            if r["block"] != block:
                if header:
                    yield done(header, parts)
                block, header, parts = r["block"], None, []
            if r["ids"] is not None:
                header = r
            else:
                parts.append((r["keys"], r["docs"]))
        if header:
            yield done(header, parts)
        release()

    schema = _ROW + _HEADER
    none = [F.lit(None).cast(t).alias(c) for c, t in (f.split() for f in _HEADER[2:].split(", "))]
    table = packed.select("shard", "keys", "docs", (F.explode(F.sequence(F.lit(0), F.lit(copies - 1))) if copies > 1 else F.lit(0)).alias("copy"))
    table = table.select((F.col("shard") * copies + F.col("copy")).cast("int").alias("shard"), F.lit(-1).cast("long").alias("block"), "keys", "docs", *none)
    asked = docs.select("doc_id", "lang", "text").mapInArrow(ask, schema).unionByName(table)
    met = asked.repartition(p * copies, "shard").sortWithinPartitions("shard", "block").mapInArrow(settle, schema)
    return met.repartition(p, "block").sortWithinPartitions("block").mapInArrow(gather, _SCORED), shared


def _short(key: np.ndarray) -> np.ndarray:
    """The 48 bits of hashes by which grams are told apart inside a shard, whose number is up to eight bits more."""
    return (key >> np.uint64(8)) & np.uint64((1 << 48) - 1)


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Upper halves of hashes, many in a row."""
    for b in batches:
        keys = np.frombuffer(b"".join(b.column("keys").to_pylist()), np.uint64)
        yield _table([[(keys >> np.uint64(32)).astype(np.uint32).tobytes()]], "refs binary")


def _packer(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, value = b.column("hash").to_numpy().view(np.uint64), b.column("value").to_numpy()
            if len(key):
                yield _table(list(_by_shard(key, n, key, value)), "shard int, keys binary, docs binary")

    return run


#: Parts of the trigram model, by the word before the last, and parts for the first counts; only one is on disk at a time. Powers of two.
SLICES = 4
COUNT_SLICES = 2
#: Commonest words, whose grams are dealt out by gram and not by word; rows that a task holds before it sends them.
HOT, SPOOL = 1 << 14, 1 << 19
#: Added to a context's sum, so that its hash differs from that of the same words as a gram.
_CONTEXT = np.uint64(7)
_RAW = "a binary, v binary, w binary, n binary"
_VOC = "word binary, total binary, ones binary, twos binary, more binary, before binary"
_KINDS = {"a": np.uint64, "v": np.uint64, "w": np.uint64, "n": np.uint32, "g": np.uint64, "k": np.uint64, "x": np.float32, "t2": np.float32, "f2": np.float32, "key": np.uint64, "value": np.int32, "weight": np.uint32} | {f.split()[0]: np.int64 for f in _VOC.split(", ")} | {"word": np.uint64}


class _Spool:
    """Packed columns that a task sends by shard, in large pieces. ``names`` are its columns of ``schema``."""

    def __init__(self, n: int, schema: str, names: list[str]):
        self.n, self.schema, self.names, self.held, self.size = n, schema, names, [], 0
        self.place = [[f.split()[0] for f in schema.split(", ")].index(c) for c in ["shard", *names]]

    def put(self, by: np.ndarray, *cols: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((by, *(c.astype(_KINDS[k], copy=False) for c, k in zip(cols, self.names, strict=True))))
        self.size += len(by)
        if self.size >= SPOOL:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            by, *cols = (np.concatenate(c) for c in zip(*self.held, strict=True))
            rows = []
            for r in _by_shard(by, self.n, *cols):
                rows.append([None] * (self.schema.count(",") + 1))
                for k, x in zip(self.place, r, strict=True):
                    rows[-1][k] = x
            for k in range(0, len(rows), 64):
                yield _table(rows[k : k + 64], self.schema)
        self.held, self.size = [], 0


def _held(rows: list[dict], names: str) -> list[np.ndarray]:
    return [_meet(rows, c, _KINDS[c]) for c in names.split()]


def _cut(a: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(a, 3).astype(np.int64)]


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _words(rows: list[dict], hot: np.ndarray | None = None) -> np.ndarray:
    """The vocabulary's columns of a shard, a row each, one column for each word in order, with the ``hot`` ones."""
    cols = np.stack([c.view(np.int64) for c in _held(rows, "word total ones twos more before")])
    cols = cols if hot is None else np.concatenate([cols, hot], 1)
    word, first, index = np.unique(cols[0].view(np.uint64), return_index=True, return_inverse=True)
    if hot is not None:
        return cols[:, first]
    return np.stack([word.view(np.int64), *(np.bincount(index, c, len(word)).astype(np.int64) for c in cols[1:])])


class Trigrams:
    """The model of order 3 in packed shards: whole counts of words, kept, and a slice at a time of all grams whose word before the last is in the slice.

    Grams of a slice are read from the texts anew; so neither the counts nor the model are ever on disk as a whole. First all slices give the
    numbers of rare grams and, for each word, how many grams follow (``total``, of which ``ones, twos, more`` words once, twice or more often) and how many words stand ``before`` it.
    Then, with discounts known, a slice's trigrams meet by context (or by the word before the last, unless it is HOT) and go on to the shard of their last word (of their last two, if that is HOT), whose share they need.
    """

    def __init__(self, docs: DataFrame, trusted: DataFrame, ws: Workspace, seed: int, max_docs: int | None):
        self.spark, self.ws = docs.sparkSession, ws
        self.n, self.p = shards_of(self.spark), n_shuffle(self.spark)
        self.texts = training(docs, trusted, seed, max_docs)
        schema, all_of = f"shard int, {_VOC}, stats binary", None
        for r in range(COUNT_SLICES):
            counted = self._dealt(self._raw(r, COUNT_SLICES, None)).mapInArrow(self._count(), schema)
            part = ws.put(self._dealt(counted).mapInArrow(_merge, schema), f"words{r}")
            all_of = part if all_of is None else all_of.unionByName(part)
        self.voc = ws.put(self._dealt(all_of.where("stats is null")).mapInArrow(_merge, schema).drop("stats"), "words")
        counts = sum((np.frombuffer(r["stats"], np.int64) for r in all_of.where("stats is not null").select("stats").collect()), np.zeros(8, np.int64))
        tops, ones = [], np.zeros(7, np.int64)
        for r in self.voc.mapInArrow(self._tops(), "top binary, ones binary").collect():
            tops.append(np.frombuffer(r["top"], np.int64).reshape(6, -1))
            ones += np.frombuffer(r["ones"], np.int64)
        ws.drop(*(f"words{r}" for r in range(COUNT_SLICES)))
        tops = np.concatenate([np.zeros((6, 0), np.int64), *tops], 1)
        order = np.lexsort((tops[0], -(tops[1] + tops[5])))[:HOT]
        self.hot = tops[:, order[np.argsort(tops[0, order].view(np.uint64))]]
        self.d = [discounts(list(ones[:4])), discounts(list(counts[4:])), discounts(list(counts[:4]))]
        self.total, kinds = int(ones[5]), int(ones[6])
        free = self.d[0][0] * ones[0] + self.d[0][1] * ones[1] + self.d[0][2] * ones[4]
        self.rest = free / self.total / (kinds + 1) if self.total else 1.0
        self.floor = float(np.log(self.rest))

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self.p, "shard").sortWithinPartitions("shard")

    def _raw(self, r: int, of: int, hot: np.ndarray | None) -> DataFrame:
        """Trigrams of slice ``r`` of ``of`` as the sum of their first two words, the second and the third, and how often; dealt out by the last two words, or, with ``hot`` words, by context."""
        n = self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            spool = _Spool(n, f"shard int, {_RAW}", ["a", "v", "w", "n"])
            for b in batches:
                for i, j in W.chunks(b.column("text")):
                    t = W.split(b.column("text").slice(i, j - i), lower=False)
                    flat, owner, at = padded(t, 3)
                    last = _in_slice(flat, at, t.counts[owner] > 0, r, of)
                    a = np.uint64(2) + flat[last - 2] * W._STEPS[0] + flat[last - 1] * W._STEPS[1]
                    _, first, count = np.unique(a + np.uint64(1) + flat[last] * W._STEPS[2], return_index=True, return_counts=True)
                    a, v, w = a[first], flat[last - 1][first], flat[last][first]
                    by = W.mixed(_pair(v, w)) if hot is None else np.where(_hit(hot, v), W.mixed(a), W.mixed(v))
                    yield from spool.put(by, a, v, w, count)
            yield from spool.flush()
            release()

        return self.texts.mapInArrow(run, f"shard int, {_RAW}")

    def _count(self):
        n = self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = f"shard int, {_VOC}, stats binary"
            spool, stats = _Spool(n, schema, [f.split()[0] for f in _VOC.split(", ")]), np.zeros(8, np.int64)
            for rows in _grouped(batches):
                a, v, w, count = _held(rows, "a v w n")
                g, k = a + np.uint64(1) + w * W._STEPS[2], _pair(v, w)
                order = np.lexsort((g, k))
                g, k, v, w = g[order], k[order], v[order], w[order]
                head = _starts(k, g)
                stats[:4] += np.bincount(np.minimum(np.add.reduceat(count[order].astype(np.int64), head), 5), minlength=6)[1:5]
                pair = _starts(k[head])
                before = np.diff(np.append(pair, len(head)))
                stats[4:] += np.bincount(np.minimum(before, 5), minlength=6)[1:5]
                v, w, m = v[head][pair], w[head][pair], len(pair)
                word, index = np.unique(np.concatenate([v, w]), return_inverse=True)
                cols = [np.bincount(index[:m], x, len(word)) for x in (before, before == 1, before == 2, before > 2)]
                yield from spool.put(W.mixed(word), word, *cols, np.bincount(index[m:], minlength=len(word)))
            yield from spool.flush()
            yield _table([[0, *[None] * 6, stats.tobytes()]], schema)
            release()

        return run

    def _tops(self):
        most = 4 * HOT // self.n + 16

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    cols = _words([r])
                    top = np.argsort(-(cols[1] + cols[5]), kind="stable")[:most]
                    a = cols[5][cols[5] > 0]
                    ones = [*np.bincount(np.minimum(a, 5), minlength=6)[1:5], (a > 2).sum(), a.sum(), len(a)]
                    yield _table([[np.ascontiguousarray(cols[:, top]).tobytes(), np.array(ones, np.int64).tobytes()]], "top binary, ones binary")

        return run

    def part(self, r: int) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray]]:
        """Slice ``r`` of the model as ``shard, keys, docs``, and its commonest grams."""
        n, d, rest, total = self.n, self.d, self.rest, self.total
        hot = self.spark.sparkContext.broadcast(self.hot)
        some = [f.split()[0] for f in _VOC.split(", ")]
        second = f"shard int, g binary, k binary, w binary, x binary, t2 binary, f2 binary, n binary, key binary, value binary, weight binary, {_VOC}"

        def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            spool, contexts = _Spool(n, second, ["g", "k", "w", "x", "t2", "f2", "n"]), _Spool(n, second, ["key", "value", "weight"])
            for rows in _grouped(batches):
                a, v, w, count = _held(rows, "a v w n")
                if not len(a):
                    continue
                g = a + np.uint64(1) + w * W._STEPS[2]
                order = np.lexsort((g, a))
                head = _starts(a[order], g[order])
                count = np.add.reduceat(count[order].astype(np.int64), head)
                order = order[head]
                a, v, w, g = a[order], v[order], w[order], g[order]
                context, cut = _starts(a), _cut(count, d[2])
                free, all_of = np.add.reduceat(cut, context), np.add.reduceat(count, context)
                x = np.maximum(count - cut, 0) / np.repeat(free, np.diff(np.append(context, len(a))))
                words = _words(rows, hot.value)
                at = np.searchsorted(words[0].view(np.uint64), v)
                pair = _pair(v, w)
                by = np.where(_hit(hot.value, w), W.mixed(pair), W.mixed(w))
                yield from spool.put(by, g, pair, w, x, words[1][at], _free(words, d[1])[at], np.minimum(count, 1 << 30))
                key = W.mixed(a[context] + _CONTEXT)
                yield from contexts.put(key, key, np.rint(np.log(free / all_of) * UNIT), np.minimum(all_of, 1 << 30))
            yield from spool.flush()
            yield from contexts.flush()
            release()

        most = 4 * HEAD // SLICES // self.p + 64

        def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = "shard int, keys binary, docs binary, top binary"
            spool, top = _Spool(n, "shard int, key binary, value binary", ["key", "value"]), np.zeros((3, 0), np.int64)

            def sent(key: np.ndarray, value: np.ndarray, weight: np.ndarray) -> Iterator[pa.RecordBatch]:
                nonlocal top
                value = np.rint(value).astype(np.int32)
                top = np.concatenate([top, np.stack([key.view(np.int64), value.astype(np.int64), weight.astype(np.int64)])], 1)
                if top.shape[1] > most:
                    top = top[:, np.argpartition(-top[2], most)[:most]]
                for b in spool.put(key, key, value):
                    yield named(b)

            def named(b: pa.RecordBatch) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, pa.binary())], names=["shard", "keys", "docs", "top"])

            for rows in _grouped(batches):
                own = _words(rows)
                own = own[:, (own[0].view(np.uint64) & np.uint64(SLICES - 1)) == np.uint64(r)]
                free = _free(own, d[1])
                with np.errstate(divide="ignore", invalid="ignore"):
                    value = np.where(own[5] > 0, np.log(_first(own[5], d[0], total, rest) / rest), 0) + np.where(own[1] > 0, np.log(free / own[1]), 0)
                yield from sent(W.mixed(np.uint64(1) + own[0].view(np.uint64) * W._STEPS[0]), value * UNIT, own[5])
                yield from sent(*_held(rows, "key value weight"))
                g, k, w, x, t2, f2, count = _held(rows, "g k w x t2 f2 n")
                if not len(g):
                    continue
                order = np.argsort(k, kind="stable")
                g, k, w, x, t2, f2, count = (c[order] for c in (g, k, w, x, t2, f2, count))
                pair = _starts(k)
                before = np.diff(np.append(pair, len(k)))
                words = _words(rows, hot.value)
                one = _first(words[5], d[0], total, rest)[np.searchsorted(words[0].view(np.uint64), w[pair])]
                above, lower = np.maximum(before - _cut(before, d[1]), 0), f2[pair].astype(float) * one
                yield from sent(W.mixed(k[pair]), np.log1p(above / lower) * UNIT, before)
                q = np.repeat((above + lower) / t2[pair], before)
                yield from sent(W.mixed(g), np.log1p(x / q) * UNIT, count)
            for b in spool.flush():
                yield named(b)
            yield _table([[None, None, None, top.tobytes()]], schema)
            release()

        def wide(df: DataFrame, schema: str) -> DataFrame:
            return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in (f.split() for f in schema.split(", "))])

        first = f"shard int, {_RAW}, {_VOC}"
        words = self.voc.select("shard", *some)
        raw = wide(self._raw(r, SLICES, self.hot[:1]), first).unionByName(wide(words, first))
        met = self._dealt(raw).mapInArrow(share, second).unionByName(wide(words, second))
        out = self.ws.put(self._dealt(met).mapInArrow(settle, "shard int, keys binary, docs binary, top binary"), f"part{r}")
        hot.destroy()
        top = np.concatenate([np.zeros((3, 0), np.int64), *(np.frombuffer(x["top"], np.int64).reshape(3, -1) for x in out.where("top is not null").select("top").collect())], 1)
        top = top[:, np.lexsort((top[0], -top[2]))[: HEAD // SLICES]]
        return out.where("top is null").drop("top"), (top[0].copy().view(np.uint64), top[1].astype(np.int32))


def _pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.uint64(2) + v * W._STEPS[0] + w * W._STEPS[1]


def _hit(hot: np.ndarray, words: np.ndarray) -> np.ndarray:
    if not hot.shape[1]:
        return np.zeros(len(words), bool)
    keys = hot[0].view(np.uint64)
    return keys[np.minimum(np.searchsorted(keys, words), len(keys) - 1)] == words


def _free(words: np.ndarray, d: list[float]) -> np.ndarray:
    return d[0] * words[2] + d[1] * words[3] + d[2] * words[4]


def _first(before: np.ndarray, d: list[float], total: int, rest: float) -> np.ndarray:
    """Shares of single words."""
    return np.maximum(before - _cut(before, d), 0) / max(1, total) + rest


def _in_slice(flat: np.ndarray, at: np.ndarray, full: np.ndarray, r: int, of: int, back: int = 1) -> np.ndarray:
    """Places of words and ends whose word ``back`` before is in slice ``r`` of ``of``."""
    last = np.flatnonzero((flat[: len(flat) - back] & np.uint64(of - 1)) == np.uint64(r)) + back
    return last[(at[last] >= 1 + back) & full[last]]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = f"shard int, {_VOC}, stats binary"
    for rows in _grouped(batches):
        cols = _words(rows)
        if cols.shape[1]:
            yield _table([[rows[0]["shard"], *(c.tobytes() for c in cols), None]], schema)
        stats = [np.frombuffer(r["stats"], np.int64) for r in rows if r["stats"] is not None]
        if stats:
            yield _table([[rows[0]["shard"], *[None] * 6, sum(stats).tobytes()]], schema)
    release()


def _slice_grams(r: int) -> Grams:
    """The grams of a text that slice ``r`` of :class:`Trigrams` may hold: trigrams, pairs and contexts by the word before the last, and words."""

    def grams(flat: np.ndarray, owner: np.ndarray, at: np.ndarray, full: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        last = _in_slice(flat, at, full, r, SLICES)
        a = np.uint64(2) + flat[last - 2] * W._STEPS[0] + flat[last - 1] * W._STEPS[1]
        yield W.mixed(a + np.uint64(1) + flat[last] * W._STEPS[2]), last
        yield W.mixed(_pair(flat[last - 1], flat[last])), last
        yield W.mixed(a + _CONTEXT), last
        last = _in_slice(flat, at, full, r, SLICES, 0)
        yield W.mixed(np.uint64(1) + flat[last] * W._STEPS[0]), last

    return grams


def trigram_shares(docs: DataFrame, trusted: DataFrame, ws: Workspace, copies: int, max_docs: int | None, seed: int) -> DataFrame:
    """:func:`log_shares` under the model of order 3, a slice at a time. A row is told by its id, language and text, since rows that agree in them have equal sums."""
    model, parts = Trigrams(docs, trusted, ws, seed, max_docs), None
    for r in range(SLICES):
        packed, top = model.part(r)
        part, shared = summed(docs, packed, top, _slice_grams(r), int(round(model.floor * UNIT)) if r == 0 else 0, ORDER, copies)
        part = ws.put(part, f"sums{r}")
        shared.destroy()
        ws.drop(f"part{r}")
        parts = part if parts is None else parts.unionByName(part)
    ws.drop("words")
    by = parts.groupBy("doc_id", "lang", "n_words", "digest").agg(F.sum("units").alias("units"), F.count(F.lit(1)).alias("n"))
    each = by.select("doc_id", "lang", "n_words", (F.col("units") / F.col("n") * (SLICES / UNIT)).alias("log_p"), F.explode(F.array_repeat(F.lit(0), (F.col("n") / SLICES).cast("int"))))
    return each.drop("col")


def perplexities(docs: DataFrame, trusted: DataFrame, *, order: int = ORDER, max_docs: int | None = None, seed: int = 23) -> DataFrame:
    """``doc_id, lang, n_words, perplexity`` (a word, the end included) of every row of ``docs``, written once."""
    ws = Workspace(docs.sparkSession, "kn")
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= 1 << 60:  # unknown to Spark
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    copies = 1 + size // COPY_BYTES
    if order == ORDER:
        scored = trigram_shares(docs, trusted, ws, copies, max_docs, seed)
    else:
        grams, floor = fit(docs, trusted, ws, order=order, max_docs=max_docs, seed=seed)
        model = ws.put(hashed(grams, order), "model")
        ws.drop("top", *(f"level{m}" for m in range(1, order)), *(f"p{m}" for m in range(1, order + 1)))
        scored = log_shares(docs, model, floor, ws, order, copies)
    per = F.exp(F.least(-F.col("log_p") / (F.col("n_words") + 1), F.lit(700.0)))
    out = ws.put(scored.select("doc_id", "lang", "n_words", F.when(F.col("n_words") > 0, per).alias("perplexity")), "scored")
    ws.drop("model", "packed", *(f"sums{r}" for r in range(SLICES)))
    return out


def classify(docs: DataFrame, labels: DataFrame, *, quantile: float = 0.99, prior: int = 50, order: int = ORDER, max_docs: int | None = None, seed: int = 23) -> DataFrame:
    """``doc_id, lang, n_words, perplexity, threshold, kept``. The threshold is the ``quantile`` of the language's held-out trusted documents, mixed with the greater of it and that of all languages' as if this had come from ``prior`` documents: the fewer a language has, the less its own quantile counts against it."""
    ws = Workspace(docs.sparkSession, "knq")
    trusted = ws.put(trusted_ids(labels).withColumn("doc_id", F.col("doc_id").cast("long")), "trusted")
    scored = perplexities(docs, trusted, order=order, max_docs=max_docs, seed=seed)
    held = trusted.where(F.pmod(_place(seed), F.lit(HELD)) == 0)
    known = scored.where("perplexity is not null").join(held, "doc_id", "left_semi").select("lang", "perplexity")
    counts = known.groupBy(F.col("lang").alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    cuts = percentiles(known, "perplexity", [quantile], ["lang"]).select(F.col("lang").alias("_lang"), F.col("percentiles")[0].alias("_cut"))
    by = ws.put(cuts.join(counts, F.col("_lang").eqNullSafe(F.col("_l"))).drop("_l"), "cuts")
    overall = ws.put(percentiles(known, "perplexity", [quantile]).select(F.col("percentiles")[0].alias("_all")), "cut")
    out = scored.join(by, F.col("lang").eqNullSafe(F.col("_lang")), "left").join(F.broadcast(overall), F.lit(True), "left")  # one row
    n = F.coalesce(F.col("_n"), F.lit(0))
    cut = ((n * F.coalesce("_cut", "_all") + prior * F.greatest("_cut", "_all")) / (n + prior)).alias("threshold")
    out = out.select("doc_id", "lang", "n_words", "perplexity", cut)
    kept = F.col("perplexity").isNotNull() & (F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold")))
    return out.select("*", kept.alias("kept"))
