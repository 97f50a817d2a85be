"""The prefix trie of conversations, families first.

Conversations are rebuilt by family (the ids that share a base), and each family's small trie is built where its conversations
meet; only combined family nodes are shuffled to be merged with those of other families.

A node is named by its depth and a polynomial hash of its turns (four primes of 31 bits). Such a hash is a prefix sum, so neither a conversation nor
a family has to sit in one task: turns are sorted by ranges, sums are carried over the ranges' borders, and a family is dealt out in stretches of
``band`` turns, then bands of as many depths. A family has at most 199 ids, which bounds both. What a subtree sums is attributed to smallest members: a node's tokens to its own, a leaf to its
own; sums of later bands are carried to a conversation's last node in a band.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadence.llm.common import Workspace, n_shuffle

PRIMES = np.array([2147483647, 2147483629, 2147483587, 2147483579], np.uint64)[:, None]
BASES = np.array([1103515245, 1664525013, 1597334677, 1812433253], np.uint64)[:, None]
FAMILY, HEAD, BAND = 100, 6, 1024
KEY = ["depth", "k1", "k2"]


def power(exponent: np.ndarray) -> np.ndarray:
    """``BASES ** exponent`` modulo each prime."""
    e, square = np.asarray(exponent, np.int64).copy(), BASES.copy()
    out = np.ones((4, len(e)), np.uint64)
    while e.any():
        out = np.where(e & 1, out * square % PRIMES, out)
        square, e = square * square % PRIMES, e >> 1
    return out


INVERSE = [np.array([[pow(int(b), -k, int(p))] for b, p in zip(BASES[:, 0], PRIMES[:, 0], strict=True)], np.uint64) for k in range(HEAD)]


def packed(lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return ((lanes[0] << np.uint64(31)) | lanes[1]).astype(np.int64), ((lanes[2] << np.uint64(31)) | lanes[3]).astype(np.int64)


def lanes(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    a, b = np.asarray(k1, np.int64).astype(np.uint64), np.asarray(k2, np.int64).astype(np.uint64)
    low = np.uint64(2**31 - 1)
    return np.stack([a >> np.uint64(31), a & low, b >> np.uint64(31), b & low])


def _longs(table: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(table.column(name)).astype(np.int64)


def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns of a sorted range with their number in the conversation and the sum of hashes up to them, counted from the range's start."""
    part = TaskContext.get().partitionId()
    last, count, total = None, 0, np.zeros((4, 1), np.uint64)
    for b in batches:
        if not b.num_rows:
            continue
        conv = _longs(b, "conv")
        hashes = np.frombuffer(b"".join(b.column("digest").to_pylist()), ">u8").astype(np.uint64).reshape(-1, 4).T % PRIMES
        starts = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
        index = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(conv))))
        turn = np.arange(len(conv)) - starts[index] + 1
        more = (index == 0) & (last is not None and conv[0] == last)
        turn += np.where(more, count, 0)
        sums = np.cumsum(hashes * power(turn) % PRIMES, axis=1)
        before = np.concatenate([np.zeros((4, 1), np.uint64), sums], axis=1)[:, starts]
        sums = (sums - before[:, index] + np.where(more, total, np.uint64(0))) % PRIMES
        last, count, total = conv[-1], int(turn[-1]), sums[:, -1:]
        s1, s2 = packed(sums)
        g1, g2 = packed(hashes)
        yield pa.RecordBatch.from_pydict({"part": np.full(len(conv), part), "conv": conv, "turn": turn, "s1": s1, "s2": s2, "g1": g1, "g2": g2, "chars": _longs(b, "chars")})


def carried(edges: list[dict]) -> dict[int, tuple[int, int, np.ndarray]]:
    """What each range has to add to the turns of its first conversation, from a row for each range."""
    out, running = {}, None
    for e in sorted(edges, key=lambda e: e["part"]):
        own = lanes(np.array([e["end"]["s1"]]), np.array([e["end"]["s2"]]))
        if running and running[0] == e["first"]:
            out[e["part"]] = running
            if e["first"] == e["last"]:
                running = (e["last"], running[1] + e["end"]["turn"], (running[2] + power(np.array([running[1]])) * own) % PRIMES)
                continue
        running = (e["last"], e["end"]["turn"], own)
    return out


def _family(left: pa.Table, right: pa.Table, size_of_band: int) -> pa.Table:
    """A stretch of a family's turns as combined nodes, each in the band of its depth."""
    conv, turn, chars = _longs(left, "conv"), _longs(left, "turn"), _longs(left, "chars")
    sums, hashes = lanes(_longs(left, "s1"), _longs(left, "s2")), lanes(_longs(left, "g1"), _longs(left, "g2"))
    base, top = int(_longs(left, "base")[0]), int(_longs(left, "stretch")[0]) == 0
    kind = _longs(right, "kind")
    head = right.filter(pa.array(kind == 1)).sort_by("turn")
    known = right.filter(pa.array(kind == 0)).sort_by("conv")
    head_sums = np.concatenate([np.zeros((4, 1), np.uint64), lanes(_longs(head, "s1"), _longs(head, "s2"))], axis=1)
    head_chars = np.concatenate([[0], _longs(head, "chars")])
    ids, size, keep = _longs(known, "conv"), _longs(known, "turn"), _longs(known, "h")
    taken = np.minimum(keep, len(head_chars) - 1)
    skipped = lanes(_longs(known, "s1"), _longs(known, "s2"))
    at = np.searchsorted(ids, conv)
    own = turn > keep[at]
    conv, turn, chars, sums, hashes, at = conv[own], turn[own], chars[own], sums[:, own], hashes[:, own], at[own]
    depth = taken[at] + turn - keep[at]
    back = np.concatenate(INVERSE, axis=1)[:, keep[at] - taken[at]]
    name = (head_sums[:, taken[at]] + (sums + PRIMES - skipped[:, at]) % PRIMES * back) % PRIMES
    above = (name + PRIMES - hashes * power(depth) % PRIMES) % PRIMES
    band = (depth - 1) // size_of_band
    pieces = [(depth, band, name, above, conv, chars, turn == size[at], (depth == (band + 1) * size_of_band) & (turn < size[at]), np.zeros(len(conv), bool))]
    first = (band > 0) & (depth == band * size_of_band + 1)  # the nodes above a band's first ones stand in it without members
    none = np.zeros(int(first.sum()), bool)
    pieces.append((depth[first] - 1, band[first], above[:, first], above[:, first], conv[first], np.zeros(len(none), np.int64), none, none, ~none))
    if top:
        for d in range(int(taken.max(initial=0)) + 1):
            here = taken >= d
            n = int(here.sum())
            column = np.repeat(head_sums[:, d : d + 1], n, axis=1)
            pieces.append((np.full(n, d), np.zeros(n, np.int64), column, np.repeat(head_sums[:, max(d - 1, 0) : max(d, 1)], n, axis=1), ids[here], np.full(n, head_chars[d]), (size[here] <= keep[here]) & (taken[here] == d), np.zeros(n, bool), np.zeros(n, bool)))
    depth, band, name, above, conv, chars, ends, exits, context = (np.concatenate(x, axis=-1) for x in zip(*pieces, strict=True))
    (k1, k2), (p1, p2) = packed(name), packed(above)
    order = np.lexsort((conv, context, k2, k1, depth))
    depth, band, k1, k2, p1, p2, conv, chars, ends, exits, context = (x[order] for x in (depth, band, k1, k2, p1, p2, conv, chars, ends, exits, context))
    new = np.ones(len(depth), bool)
    new[1:] = (depth[1:] != depth[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (context[1:] != context[:-1])
    starts = np.flatnonzero(new)
    node = np.cumsum(new) - 1
    count = np.diff(np.append(starts, len(node)))

    def listed(which: np.ndarray) -> pa.Array:
        sizes = np.bincount(node[which], minlength=len(starts))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(conv[which], pa.int64()))

    real = ~context[starts]
    return pa.table({
        "depth": depth[starts], "k1": k1[starts], "k2": k2[starts], "p1": p1[starts], "p2": p2[starts],
        "base": np.full(len(starts), base), "band": band[starts], "context": context[starts],
        "least": pa.array(conv[starts], pa.int64(), mask=~real), "n": np.where(real, count, 0), "chars": chars[starts],
        "ends": listed(ends), "exits": listed(exits),
    })


def _subtrees(left: pa.Table, right: pa.Table) -> pa.Table:
    """A band's share of its nodes' children, leaves and saved tokens, and what its own smallest members know of them."""
    depth, k1, k2, p1, p2 = (_longs(left, c).tolist() for c in ("depth", "k1", "k2", "p1", "p2"))
    context, least, chars, n, ends, conv, exits = (left.column(c).to_pylist() for c in ("context", "least", "chars", "n_convs", "n_ends", "conv_id", "exits"))
    later = {c: (a, b) for c, a, b in zip(*(right.column(c).to_pylist() for c in ("conv", "leaves", "saved")), strict=True)} if right.num_rows else {}
    at: dict[tuple, int] = {}
    for i in sorted(range(len(depth)), key=context.__getitem__):
        j = at.setdefault((depth[i], k1[i], k2[i]), i)
        if j != i:  # one node from two stretches
            least[j] = min((x for x in (least[i], least[j]) if x is not None), default=None)
            exits[j] = exits[j] + exits[i]
    one = list(at.values())
    children, leaves, saved, parent = [0] * len(depth), [0] * len(depth), [0] * len(depth), [None] * len(depth)
    own = [not c and a == b for c, a, b in zip(context, least, conv, strict=True)]
    for i in sorted(one, key=depth.__getitem__, reverse=True):
        if context[i]:
            continue
        if own[i]:
            leaves[i] += n[i] == ends[i]
            saved[i] += (n[i] - 1) * chars[i]
        for c in exits[i]:
            a, b = later.get(c, (0, 0))
            leaves[i] += a
            saved[i] += b
        if depth[i]:
            above = at[depth[i] - 1, p1[i], p2[i]]
            children[above] += own[i]
            leaves[above] += leaves[i]
            saved[above] += saved[i]
            parent[i] = conv[above]
    for i in one:
        if context[i]:  # what lies below it reaches its own band through the carried sums
            leaves[i] = saved[i] = 0
    only = lambda values: pa.array([values[i] if own[i] else None for i in one], pa.int64())
    every = lambda values: pa.array([values[i] for i in one], pa.int64())
    return pa.table({"depth": every(depth), "k1": every(k1), "k2": every(k2), "children": every(children), "leaves": every(leaves), "saved": every(saved), "conv_id": only(conv), "parent": only(parent), "n": only(n)})


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ends, streamed: rows come by node and family, and families follow each other in the order of their ids."""
    key, family, held, sha, any_ = None, None, [], None, False

    def flush() -> None:
        nonlocal any_, held
        if held:
            sha.update((("," if any_ else "") + ",".join(map(str, sorted(held)))).encode())
            any_, held = True, []

    def row(key: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"depth": key[0], "k1": key[1], "k2": key[2], "ends_sha256": sha.hexdigest()}])

    for b in batches:
        done = []
        for d, k1, k2, base, ends in zip(*(b.column(c).to_pylist() for c in (*KEY, "base", "ends")), strict=True):
            if (d, k1, k2) != key:
                if key is not None:
                    flush()
                    done.append(row(key))
                key, family, sha, any_ = (d, k1, k2), base, hashlib.sha256(), False
            elif base != family:
                flush()
                family = base
            held += ends
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if key is not None:
        flush()
        yield row(key)


def prefix_trie(df: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", band: int = BAND) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of every node of the trie of rebuilt conversations.

    Turns go by ``turn``, null first; equal turns of a conversation by a digest of role and text, so repeated rows are turns of their own. Null role
    or text is an empty one. Rows without a conversation id take no part. The base of an id is the id less its remainder by 100, which has the
    id's sign. A conversation that has no turns after its rebuilding ends at the root. Texts of any length are whole and are read once, for
    their digest and length. An empty table gives an empty result, without a root. Other columns are not read, whatever their names.
    """
    if band < HEAD:
        raise ValueError(f"a band holds at least {HEAD} turns")
    spark = df.sparkSession
    ws = Workspace(spark, "trie")
    who, what = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = df.select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).where("conv IS NOT NULL")
    digest = F.unhex(F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, what).cast("binary"), 256))
    rows = rows.select("conv", "turn", digest.alias("digest"), F.length(what).cast("long").alias("chars"), F.monotonically_increasing_id().alias("read"))
    order = [F.col("conv"), F.asc_nulls_first("turn"), F.col("digest"), F.col("read")]
    schema = "part long, conv long, turn long, s1 long, s2 long, g1 long, g2 long, chars long"
    numbered = ws.put(rows.repartitionByRange(n_shuffle(spark), *order).sortWithinPartitions(*order).select("conv", "digest", "chars").mapInArrow(number, schema), "numbered")
    end = F.max_by(F.struct("turn", "s1", "s2"), F.struct("conv", "turn"))
    edges = numbered.groupBy("part").agg(F.min("conv").alias("first"), F.max("conv").alias("last"), end.alias("end")).collect()  # a row for each range
    carry = carried([e.asDict(True) for e in edges])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, conv, turn = _longs(b, "part"), _longs(b, "conv"), _longs(b, "turn").copy()
            s1, s2 = _longs(b, "s1").copy(), _longs(b, "s2").copy()
            for p in np.unique(part):
                if int(p) in carry:
                    who, count, total = carry[int(p)]
                    hit = (part == p) & (conv == who)
                    s1[hit], s2[hit] = packed((total + power(np.array([count])) * lanes(s1[hit], s2[hit])) % PRIMES)
                    turn[hit] += count
            yield pa.RecordBatch.from_pydict({"conv": conv, "turn": turn, "s1": s1, "s2": s2, "g1": _longs(b, "g1"), "g2": _longs(b, "g2"), "chars": _longs(b, "chars")})

    placed = numbered.mapInArrow(place, schema.removeprefix("part long, "))
    placed = placed.withColumns({"base": F.col("conv") - F.col("conv") % FAMILY, "stretch": F.floor((F.col("turn") - 1) / band), "h": F.crc32(F.col("conv").cast("string").cast("binary")) % HEAD})
    at_head = F.col("turn") == F.col("h")
    known = placed.groupBy("base", "conv", "h").agg(F.max("turn").alias("turn"), F.coalesce(F.max(F.when(at_head, F.col("s1"))), F.lit(0)).alias("s1"), F.coalesce(F.max(F.when(at_head, F.col("s2"))), F.lit(0)).alias("s2"))
    known = ws.put(known, "known")
    last = lambda c: F.floor((F.col(c) - 1) / band)
    members = known.withColumns({"stretch": F.explode(F.sequence(F.lit(0).cast("long"), last("turn"))), "kind": F.lit(0), "chars": F.lit(0).cast("long")})
    longest = known.groupBy("base").agg(F.max("turn").alias("most"))
    heads = placed.where((F.col("conv") == F.col("base")) & (F.col("turn") < HEAD)).drop("stretch").join(longest, "base")
    heads = heads.withColumns({"stretch": F.explode(F.sequence(F.lit(0).cast("long"), last("most"))), "kind": F.lit(1)})
    cols = ["base", "stretch", "kind", "conv", "h", "turn", "s1", "s2", "chars"]
    families = ws.put(members.select(cols).unionByName(heads.select(cols)), "families")
    node = "depth long, k1 long, k2 long, p1 long, p2 long, base long, band long, context boolean, least long, n long, chars long, ends array<long>, exits array<long>"
    nodes = ws.put(placed.drop("h").groupBy("base", "stretch").cogroup(families.groupBy("base", "stretch")).applyInArrow(lambda a, b: _family(a, b, band), node), "nodes")

    merged = nodes.groupBy(*KEY).agg(F.min("least").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum(F.size("ends")).alias("n_ends"))
    joined = ws.put(nodes.join(merged, KEY).drop("ends", "n"), "joined")
    below = joined.where((F.col("band") > 0) & ~F.col("context") & (F.col("least") == F.col("conv_id")))
    sums = below.select("base", F.col("conv_id").alias("conv"), "band", (F.col("n_convs") == F.col("n_ends")).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    none = F.lit(0).cast("long")
    left = joined.where(F.size("exits") > 0).select("base", F.explode("exits").alias("conv"), (F.col("band") + 1).alias("band"), none.alias("leaves"), none.alias("saved"))
    sums = sums.unionByName(left).groupBy("base", "conv", "band").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    deeper = Window.partitionBy("conv").orderBy(F.desc("band"))  # a row for each band of a long conversation
    later = ws.put(sums.select("base", "conv", (F.col("band") - 1).alias("band"), F.sum("leaves").over(deeper).alias("leaves"), F.sum("saved").over(deeper).alias("saved")), "later")
    share = "depth long, k1 long, k2 long, children long, leaves long, saved long, conv_id long, parent long, n long"
    shares = joined.groupBy("base", "band").cogroup(later.groupBy("base", "band")).applyInArrow(_subtrees, share)
    trie = shares.groupBy(*KEY).agg(F.max("conv_id").alias("conv_id"), F.max("parent").alias("parent_conv_id"), F.max("n").alias("n_convs"), F.sum("children").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    ended = nodes.where(F.size("ends") > 0).select(*KEY, "base", "ends").repartition(*KEY).sortWithinPartitions(*KEY, "base")
    digests = ended.mapInArrow(_digests, "depth long, k1 long, k2 long, ends_sha256 string")
    out = trie.join(digests, KEY, "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))
