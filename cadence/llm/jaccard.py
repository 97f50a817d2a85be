"""N-gram Jaccard join: a grouped prefix join on word shingles.

A document's set holds the hashes of its distinct shingles. Equal sets are one
class. Shards of the hash range count in how many sets a shingle occurs and
send back only shingles that occur twice or more, so a document learns which of
its shingles can be shared. A shingle that FOLD or more sets of one chunk of text hold goes
there once with their number, and its owners stay with the chunk; so a shingle that
a third of all documents hold costs its shard one entry from each chunk. With the rarest first, two sets of the wanted
likeness must share one of the first ``n - ceil(t n) + 1``; a class whose
unshared shingles alone fill that prefix has no partner and goes no further.

Classes with the same prefix and size form a group. Groups are joined by prefix shingles, a
shingle of very many groups in parts; pairs of groups are filtered by size and by the place of the shared
shingle, and what is left is expanded to members, filtered by bitmaps and verified on the sets.
Since links are wanted for components, members are first verified against a
few hubs of each prefix shingle, then groups are joined by some of the shingles, then by all. Pairs of groups and members that these links have
already put into one component go no further, so a group of near
copies of any size costs links in proportion to its members.

Defined cases: words are lower-cased in A-Z only; under ``size`` words the whole
sequence is one shingle; without words, or null, the set is empty and linked
with nothing; rows that repeat give rows that repeat; null ids count as the largest;
texts of any length are whole; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm import words as W
from cadence.llm.blocks import shards_of
from cadence.llm.components import connected
from cadence.llm.common import Workspace, free, n_shuffle, release
from cadence.llm.lines import LAST, _grouped, _meet, _table

#: Shingles travel as 48 bits: the shard's, 8 to sort into bins, and 32.
KEPT, BINS = 48, 256
#: From so many sets in a chunk on, a shingle travels once, with their number.
FOLD = 4
#: Words of 64 bits in a set's parity bitmap.
SIG_WORDS = 16


def sets(w: W.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts as ``owner, hash``, by owner; hashes have KEPT bits."""
    key, owner, _ = W.windows(w, size)
    counts = w.counts
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        key = np.concatenate([key, np.array([W.whole_hash(w.hashes[w.first[i] : w.first[i + 1]]) for i in short], np.uint64)])
        owner = np.concatenate([owner, short])
    key = key >> np.uint64(64 - KEPT)
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], key[new]


def set_digests(owner: np.ndarray, key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set, in any order of its members."""
    cut = np.concatenate([[0], np.cumsum(n)])
    out = []
    for salt in (0x5BF0_3635, 0x1F12_3BB5):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mixed(key + np.uint64(salt << 20)), dtype=np.uint64)])
        out.append(W.mixed(total[cut[1:]] - total[cut[:-1]] + n.astype(np.uint64)))
    return out[0], out[1]


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of a bounded number of rows, since a row may hold thousands of shingles."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (percent * n + 99) // 100 + 1


_DOCS = "doc binary, t1 binary, t2 binary, n binary, d1 binary, d2 binary, head binary, several binary, owners binary"
_DOC_NAMES = [c.split()[0] for c in _DOCS.split(", ")]


def text_marks(docs: DataFrame) -> list:
    """Two hashes of the text, by which rows with one id are told apart."""
    return [F.xxhash64(F.lit(k), F.col("text")).alias(f"t{k}") for k in (1, 2)]


def shared_shingles(docs: DataFrame, ws: Workspace, size: int, percent: int) -> DataFrame:
    """``doc_id, t1, t2, n, node, d2, tokens``: for each row its text's marks, its set's size, number and second digest, and for one row of equal ones in a chunk the shingles that others may share, rarest first (null where its prefix holds none)."""
    spark = docs.sparkSession
    n_shards = shards_of(spark)
    bits = n_shards.bit_length() - 1
    bin_shift = np.uint64(KEPT - bits - 8)
    low_bits = KEPT - bits - 8
    low_type = np.uint32 if low_bits <= 32 else np.uint64
    asked = "shard int, block long, bins binary, low binary, owner binary, hot binary, times binary, " + _DOCS
    answered = "block long, key binary, df binary, owner binary, shared binary, often binary, " + _DOCS

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no = TaskContext.get().partitionId(), 0
        for b in batches:
            ids = b.column("doc_id").cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)
            marks = [b.column(t).to_numpy() for t in ("t1", "t2")]
            for i, j in W.chunks(b.column("text")):
                w = W.split(b.column("text").slice(i, j - i))
                owner, key = sets(w, size)
                n = np.bincount(owner, minlength=j - i)
                d1, d2 = set_digests(owner, key, n)
                order = np.lexsort((ids[i:j], d2, d1))
                head = np.zeros(j - i, bool)
                head[order] = np.concatenate([[True], (d1[order][1:] != d1[order][:-1]) | (d2[order][1:] != d2[order][:-1])])
                keep = head[owner]
                owner, key = owner[keep], key[keep]
                order = np.argsort(key, kind="stable")
                owner, key = owner[order], key[order]
                start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
                times = np.diff(np.append(start, len(key)))
                several = np.repeat(times >= FOLD, times)
                many, times = key[start[times >= FOLD]], times[times >= FOLD]
                wide = np.uint16 if j - i <= 1 << 16 else np.uint32
                owners, who, key = owner[several].astype(wide), owner[~several].astype(wide), key[~several]
                block = (part << 32) + no
                no += 1
                out = [[no % n_shards, block, *[None] * 5, ids[i:j].tobytes(), *(t[i:j].tobytes() for t in marks), n.astype(np.int64).tobytes(), d1.tobytes(), d2.tobytes(), head.tobytes(), times.astype(np.uint32).tobytes(), owners.tobytes()]]
                bin_of = (key >> bin_shift).astype(np.int64)
                cut = np.searchsorted(bin_of, np.arange(n_shards * BINS + 1))
                low = (key & np.uint64((1 << low_bits) - 1)).astype(low_type)
                shard_cut = np.searchsorted((many >> np.uint64(KEPT - bits)).astype(np.int64), np.arange(n_shards + 1))
                for s in range(n_shards):
                    x, y = cut[s * BINS], cut[(s + 1) * BINS]
                    p, q = shard_cut[s], shard_cut[s + 1]
                    if y > x or q > p:
                        out.append([s, block, np.diff(cut[s * BINS : (s + 1) * BINS + 1]).astype(np.uint32).tobytes(), low[x:y].tobytes(), who[x:y].tobytes(), many[p:q].tobytes(), times[p:q].astype(np.uint32).tobytes(), *[None] * len(_DOC_NAMES)])
                for k in range(0, len(out), 64):
                    yield _table(out[k : k + 64], asked)
        release()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches):
            tables = [r for r in rows if r["doc"] is not None]
            rows = [r for r in rows if r["doc"] is None]
            out = [[r["block"], *[None] * 5, *(r[c] for c in _DOC_NAMES)] for r in tables]
            if rows:
                lows = [np.frombuffer(r["low"], low_type) for r in rows]
                sizes = np.array([len(x) for x in lows])
                bins = np.concatenate([np.repeat(np.arange(BINS, dtype=np.uint64), np.frombuffer(r["bins"], np.uint32)) for r in rows])
                key = (((np.uint64(rows[0]["shard"]) << np.uint64(8)) + bins) << np.uint64(low_bits)) + np.concatenate(lows).astype(np.uint64)
                more = [np.frombuffer(r["hot"], np.uint64) for r in rows]
                at, single = 0, len(key)
                key = np.concatenate([key, *more])
                weight = np.concatenate([np.ones(single, np.uint32), *(np.frombuffer(r["times"], np.uint32) for r in rows)])
                order = np.argsort(key)
                run = key[order]
                start = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.zeros(0, np.int64)
                df = np.empty(len(key), np.uint16)
                if len(run):
                    total = np.minimum(np.add.reduceat(weight[order].astype(np.int64), start), 65535)
                    df[order] = np.repeat(total, np.diff(np.append(start, len(run)))).astype(np.uint16)
                after = single
                for r, k, m in zip(rows, sizes.tolist(), more, strict=True):
                    who = np.frombuffer(r["owner"], np.uint16 if len(r["owner"]) == 2 * k else np.uint32)
                    often = df[at : at + k] > 1
                    if often.any() or len(m):
                        out.append([r["block"], key[at : at + k][often].tobytes(), df[at : at + k][often].tobytes(), who[often].astype(np.uint32).tobytes(), m.tobytes(), df[after : after + len(m)].tobytes(), *[None] * len(_DOC_NAMES)])
                    at, after = at + k, after + len(m)
            for k in range(0, len(out), 64):
                yield _table(out[k : k + 64], answered)
        release()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(_renamed(batches)):
            table = next(r for r in rows if r["doc"] is not None)
            doc, n = np.frombuffer(table["doc"], np.int64), np.frombuffer(table["n"], np.int64)
            key, df, owner = _meet(rows, "key", np.uint64), _meet(rows, "df", np.uint16), _meet(rows, "owner", np.uint32)
            shared, often = _meet(rows, "shared", np.uint64), _meet(rows, "often", np.uint16)
            order, times = np.argsort(shared), np.frombuffer(table["several"], np.uint32)
            key = np.concatenate([key, np.repeat(shared[order], times)])
            df = np.concatenate([df, np.repeat(often[order], times)])
            owner = np.concatenate([owner, np.frombuffer(table["owners"], np.uint16 if len(doc) <= 1 << 16 else np.uint32)])
            order = np.lexsort((key, df, owner))
            key, owner = key[order], owner[order]
            m = np.bincount(owner, minlength=len(doc))
            cut = np.concatenate([[0], np.cumsum(m)])
            may = (n - m < prefix_size(n, percent)) & (m > 0)
            tokens = [key[cut[i] : cut[i + 1]].tobytes() if may[i] else None for i in range(len(doc))]
            cols = [pa.array(doc), *(pa.array(np.frombuffer(table[d], np.int64)) for d in ("t1", "t2")), pa.array(n), *(pa.array(np.frombuffer(table[d], np.int64)) for d in ("d1", "d2")), pa.array(tokens, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "t1", "t2", "n", "node", "d2", "tokens"])
        release()

    def _renamed(batches):
        for b in batches:
            yield b.rename_columns(["shard", *b.schema.names[1:]])

    p = n_shuffle(spark)
    sent = docs.select("doc_id", "text", *text_marks(docs)).mapInArrow(send, asked)
    met = sent.repartition(p, "shard").sortWithinPartitions("shard").mapInArrow(settle, answered)
    back = met.repartition(p, "block").sortWithinPartitions("block").mapInArrow(gather, "doc_id long, t1 long, t2 long, n long, node long, d2 long, tokens binary")
    found = ws.put(back, "sets")
    # Sets are told apart by 128 bits and numbered by the first 64, but where those are equal by chance.
    clash = found.groupBy("node").agg(F.min("d2").alias("lo"), F.max("d2").alias("hi")).where("lo <> hi").select("node")
    if not clash.isEmpty():
        clash = clash.select(F.col("node").alias("_node"))
        found = ws.put(found.join(clash, F.col("node") == F.col("_node"), "left").withColumn("node", F.when(F.col("_node").isNull(), F.col("node")).otherwise(F.xxhash64("node", "d2"))).drop("_node"), "sets2")
    return found


def candidates(sets_: DataFrame, ws: Workspace, percent: int) -> tuple[DataFrame, DataFrame]:
    """``node, n, tokens`` of the classes that may have partners, and ``token, node, n, i, m, grp``: the postings of their prefixes, ``i`` a shingle's place among the ``m`` shared ones."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            sig = [signature(np.frombuffer(t, np.int64)).tolist() for t in b.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sig, pa.list_(pa.int64()))], names=[*b.schema.names, "sig"])
        release()

    nodes = ws.put(classes(sets_).mapInArrow(sign, "node long, n long, tokens binary, sig array<long>"), "nodes")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            node, n = (b.column(c).to_numpy() for c in ("node", "n"))
            tokens = [np.frombuffer(t, np.int64) for t in b.column("tokens").to_pylist()]
            m = np.array([len(t) for t in tokens], np.int64)
            k = np.minimum(prefix_size(n, percent) - (n - m), m)
            first = [t[:x] for t, x in zip(tokens, k.tolist(), strict=True)]
            group = np.array([int(W.mixed(np.array([int(np.sum(W.mixed(t.view(np.uint64) + np.uint64(3)), dtype=np.uint64)) ^ (int(s) << 20)], np.uint64))[0]) >> 1 for t, s in zip(first, n.tolist(), strict=True)], np.int64)
            place = np.concatenate([np.arange(x) for x in k]) if len(k) else np.zeros(0, np.int64)
            cols = [np.concatenate(first) if first else np.zeros(0, np.int64), *(np.repeat(x, k) for x in (node, n)), place, *(np.repeat(x, k) for x in (m, group))]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["token", "node", "n", "i", "m", "grp"])
        release()

    return nodes, nodes.select("node", "n", "tokens").mapInArrow(explode, "token long, node long, n long, i long, m long, grp long")


def verify(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sets reach the wanted likeness. Shingles outside ``tokens`` are in one set only, so sizes and shared ones decide."""
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            na, nb = part.column("na").to_numpy(), part.column("nb").to_numpy()
            both = np.array([len(np.intersect1d(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), assume_unique=True)) for x, y in zip(part.column("ta").to_pylist(), part.column("tb").to_pylist(), strict=True)], np.int64)
            yield part.select(["a", "b"]).filter(pa.array(100 * both >= percent * (na + nb - both)))
        release()

    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ta", "tb").mapInArrow(check, "a long, b long")


def may_reach(x: str, y: str, percent: int):
    """Size and place filter of two postings: what the places of a shared shingle still allow against what the likeness needs."""
    col = lambda p, c: F.col(f"{p}.{c}" if p else c)
    na, nb = col(x, "n"), col(y, "n")
    most = 1 + F.least(col(x, "i"), col(y, "i")) + F.least(col(x, "m") - col(x, "i"), col(y, "m") - col(y, "i")) - 1
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (most * (100 + percent) >= percent * (na + nb))


def hub_pairs(post: DataFrame, percent: int, seeds: tuple[int, ...], central: bool) -> DataFrame:
    """Pairs of a node and its hubs: by shingle and size class a few groups' nodes, the same for as many shingles as can be; and members with their group's node.

    ``central`` hubs are nodes with few shingles of their own, since what a group
    of near copies was made from has the fewest; else any. Each seed takes another.
    """
    rows = post.withColumn("c", F.floor(F.log("n") / F.log(F.lit(100 / percent))))
    head = F.struct(F.floor(F.lit(24.0) * (F.col("n") - F.col("m")) / F.col("n")).alias("own"), "node", "n", "i", "m", "root")
    groups = rows.groupBy("token", "c", "grp").agg(F.min(head).alias("x"))
    picks = [F.min(F.struct(F.col("x.own") if central else F.lit(0), F.xxhash64(F.lit(s), "x.node").alias("h"), F.col("x"))).alias(f"h{s}") for s in seeds]
    hubs = groups.groupBy("token", "c").agg(F.count(F.lit(1)).alias("k"), *picks).where("k > 1")
    hubs = hubs.select("token", "c", F.explode(F.array_distinct(F.array(*[F.col(f"h{s}.x") for s in seeds]))).alias("hub"))
    met = groups.join(hubs, ["token", "c"]).where(F.col("x.root") != F.col("hub.root")).where(may_reach("x", "hub", percent))
    between = met.select(F.col("x.node").alias("a"), F.col("hub.node").alias("b"))
    head = post.groupBy("grp").agg(F.min(F.struct("node", "root")).alias("hub"), F.max("node").alias("last")).where(F.col("last") != F.col("hub.node"))
    inside = post.select("grp", "node", "root").distinct().join(head.select("grp", "hub"), "grp").where(F.col("root") != F.col("hub.root")).select(F.col("node").alias("a"), F.col("hub.node").alias("b"))
    both = between.union(inside)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def signature(tokens: np.ndarray) -> np.ndarray:
    bits = np.bincount((W.mixed(tokens.view(np.uint64)) % np.uint64(64 * SIG_WORDS)).astype(np.int64), minlength=64 * SIG_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def classes(sets_: DataFrame) -> DataFrame:
    """``node, n, tokens``: one row for each distinct set that may have a partner."""
    return sets_.where("tokens is not null").groupBy("node").agg(F.min("n").alias("n"), F.first("tokens").alias("tokens"))


#: So many groups of a shingle meet in one task; a shingle of more is split.
SPLIT = 512


def _like(percent: int, a: str = "a", o: str = "a"):
    """Whether two sets ``x, y`` may reach the likeness by their parity bitmaps; of groups, by the bits that all (``a``) and any (``o``) of their members have.

    Bits that must differ, and the shingles that no other set has, bound the symmetric difference from below.
    """
    col = F.col
    bits = sum((F.bit_count((col(f"x.{a}{k}").bitwiseAND(F.bitwise_not(f"y.{o}{k}"))).bitwiseOR(col(f"y.{a}{k}").bitwiseAND(F.bitwise_not(f"x.{o}{k}")))) for k in range(SIG_WORDS)), F.lit(0))
    alone = col("x.n") - col("x.m") + col("y.n") - col("y.m")
    return (100 - percent) * (col("x.n") + col("y.n")) >= (100 + percent) * (bits + alone)


def group_bits(post: DataFrame, nodes: DataFrame) -> DataFrame:
    """``grp`` and the bits of its members' bitmaps: ``a0 ..`` that all have, ``o0 ..`` that any has."""
    members = post.where("i = 0").select("grp", "node").join(nodes.select("node", "sig"), "node")
    words = [F.col("sig")[k] for k in range(SIG_WORDS)]
    return members.groupBy("grp").agg(*[F.bit_and(w).alias(f"a{k}") for k, w in enumerate(words)], *[F.bit_or(w).alias(f"o{k}") for k, w in enumerate(words)])


def group_pairs(post: DataFrame, bits: DataFrame, percent: int, share: int = 1) -> DataFrame:
    """``ga, gb``: pairs of groups (a group with itself too) that share a prefix shingle, may reach the likeness, and are not wholly in one component.

    Sizes, the shingle's places and bitmaps filter them.
    """
    if share > 1:
        post = post.where(F.pmod(F.xxhash64(F.lit(9), "token"), F.lit(share)) == 0)
    groups = post.groupBy("token", "grp").agg(F.first("n").alias("n"), F.first("i").alias("i"), F.first("m").alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    by = groups.groupBy("token").agg(F.min("lo").alias("_lo"), F.max("hi").alias("_hi"), F.count(F.lit(1)).alias("_k")).where("_lo <> _hi")
    parts = F.floor(F.col("_k") / SPLIT) + 1
    rows = groups.join(by, "token").join(bits, "grp")
    x = rows.withColumn("part", F.pmod(F.xxhash64("grp"), parts)).alias("x")
    y = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).alias("y")
    torn = (F.col("x.lo") != F.col("y.lo")) | (F.col("x.lo") != F.col("x.hi")) | (F.col("y.lo") != F.col("y.hi"))
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.grp") <= F.col("y.grp")) & torn & may_reach("x", "y", percent) & _like(percent, "a", "o"))
    return met.select(F.col("x.grp").alias("ga"), F.col("y.grp").alias("gb")).distinct()


def open_pairs(post: DataFrame, nodes: DataFrame, bits: DataFrame, percent: int, share: int = 1) -> DataFrame:
    """The members of :func:`group_pairs`, of all or one ``share``-th of the shingles, that are in different components yet.

    The sets' own bitmaps leave little but links even between components of near copies.
    """
    members = post.where("i = 0").select("grp", "node", "n", "m", "root").join(nodes.select("node", "sig"), "node")
    members = members.select("grp", "node", "n", "m", "root", *[F.col("sig")[k].alias(f"a{k}") for k in range(SIG_WORDS)])
    x, y, pairs = members.alias("x"), members.alias("y"), group_pairs(post, bits, percent, share)
    once = (F.col("ga") < F.col("gb")) | (F.col("x.node") < F.col("y.node"))
    met = pairs.join(x, F.col("ga") == F.col("x.grp")).join(y, (F.col("gb") == F.col("y.grp")) & once & (F.col("x.root") != F.col("y.root")) & _like(percent))
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def components(docs: DataFrame, *, size: int = 5, percent: int = 75) -> DataFrame:
    """For every row of ``docs`` its id (``_id``, LAST for null), its text's marks ``t1, t2``, the size ``n`` of its set, and ``root``, a number of its component (null without words)."""
    ws = Workspace(docs.sparkSession, "jaccard")
    found = shared_shingles(docs, ws, size, percent)
    nodes, post = candidates(found, ws, percent)
    post = ws.put(post.withColumn("root", F.col("node")), "post")
    bits = ws.put(group_bits(post, nodes), "bits")
    links = ws.put(verify(ws.put(hub_pairs(post, percent, (1, 2, 3, 4), True), "pairs1"), nodes, percent), "links1")
    roots = ws.put(connected(links, ws, "c1"), "roots1")

    def rooted(post: DataFrame, roots: DataFrame, name: str) -> DataFrame:
        return ws.put(post.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), name)

    # A part of the shingles first: what it links is one component by the time all are joined.
    post = rooted(post, roots, "post2")
    some = ws.put(verify(ws.put(open_pairs(post, nodes, bits, percent, 8), "pairs2"), nodes, percent), "links2")
    links = links.union(some)
    post = rooted(post, ws.put(connected(links, ws, "c2"), "roots2"), "post3")
    more = ws.put(verify(ws.put(open_pairs(post, nodes, bits, percent), "pairs3"), nodes, percent), "links3")
    ws.drop("post", "post2", "post3", "pairs1", "pairs2", "pairs3", "nodes", "bits", "roots1", "roots2")
    roots = ws.put(connected(links.union(more), ws, "c3"), "roots3")
    ws.drop("links1", "links2", "links3")
    rows = found.select(F.col("doc_id").alias("_id"), "t1", "t2", "n", "node")
    named = rows.where("n > 0").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return named.drop("node").unionByName(rows.where("n = 0").drop("node").withColumn("root", F.lit(None).cast("long")))


def join_documents(docs: DataFrame, *, size: int = 5, percent: int = 75) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``: the size of its set, and the smallest id that links reach."""
    rows = components(docs, size=size, percent=percent)
    tops = rows.where("root is not null").groupBy("root").agg(F.min("_id").alias("top"))
    out = rows.join(tops, "root", "left").withColumn("top", F.coalesce("top", "_id"))
    known = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return out.select(known("_id").alias("doc_id"), F.col("n").alias("n_shingles"), known("top").alias("component_id"))


def linked_sets(docs: DataFrame, *, size: int = 5, percent: int = 75) -> tuple[DataFrame, DataFrame]:
    """``(documents, links)``: per row of ``docs`` its id, ``n_shingles``, ``set_id`` and ``n_links``; per link of two different sets ``a, b``, the set ids, once.

    Here every pair of groups and of their members that the filters leave is verified, so no link is
    lost and a group of n near copies costs up to n**2 / 2 pairs; :func:`join_documents` is for
    components of such groups. ``n_links`` counts the other rows a row is linked with, copies of its own set included;
    without words ``set_id`` is null and there are none.
    """
    ws = Workspace(docs.sparkSession, "links")
    found = shared_shingles(docs, ws, size, percent)
    nodes, post = candidates(found, ws, percent)
    post = ws.put(post.withColumn("root", F.col("node")), "post")  # each set a component of its own, so none is skipped
    pairs = ws.put(open_pairs(post, nodes, group_bits(post, nodes), percent), "pairs")
    links = ws.put(verify(pairs.distinct(), nodes, percent), "links")
    ws.drop("post", "pairs", "nodes")
    named = found.select(F.when(F.col("doc_id") != LAST, F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("node")).alias("set_id"))
    copies = named.where("set_id is not null").groupBy("set_id").agg(F.count(F.lit(1)).alias("k"))
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("set_id"), F.col("b").alias("o")), F.struct(F.col("b").alias("set_id"), F.col("a").alias("o")))).alias("e")).select("e.*")
    others = ends.join(copies.withColumnRenamed("set_id", "o"), "o").groupBy("set_id").agg(F.sum("k").alias("more"))
    totals = copies.join(others, "set_id", "left").select("set_id", (F.col("k") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    return named.join(totals, "set_id", "left").select("doc_id", "n_shingles", "set_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), links


def first_of_each(docs: DataFrame, *, size: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` less those of each component that are not its first, by id (null last) and then text: one row stays.

    Rows are told apart by id and text, so two texts with one id are judged each for itself; of
    rows equal in both one stays. Rows without words are linked with nothing and all stay. Columns are kept as they are, whatever their names.
    """
    ws = Workspace(docs.sparkSession, "first")
    rows = ws.put(components(docs, size=size, percent=percent).where("root is not null").select("_id", "t1", "t2", "root"), "rows")
    first = rows.groupBy("root").agg(F.min(F.struct("_id", "t1", "t2")).alias("w"))
    names = [free(c, docs) for c in ("_id", "_t1", "_t2")]
    judged = rows.join(first, "root").select(*[F.col(c).alias(x) for c, x in zip(("_id", "t1", "t2"), names, strict=True)], (F.struct("_id", "t1", "t2") == F.col("w")).alias("won"))
    gone = ws.put(judged.where("not won").drop("won").distinct(), "gone")
    again = ws.put(judged.where("won").groupBy(*names).count().where("count > 1").drop("count"), "again")
    keyed = docs.withColumns(dict(zip(names, [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), *text_marks(docs)], strict=True)))
    kept = keyed.join(gone, names, "left_anti")
    if not again.isEmpty():
        one = kept.join(again, names, "left_semi").groupBy(*names).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row")).select("row.*")
        kept = kept.join(again, names, "left_anti").drop(*names).unionByName(one)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
