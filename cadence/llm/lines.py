"""Line dedup by a deletion-neighbourhood join.

Two lines match when they are equal or within ``max_edits`` edits of one character (one, by default). A line
goes when an earlier line, by document id and then line number, matches it,
whether or not that one goes too; so the result does not depend on any order of
work. Lines shorter than ``min_chars`` match equal ones only, from ``equal_chars`` on; blank lines never match.

Equal lines meet in shards by a 128-bit hash, at most once from each chunk of
text. For near lines, all variants with one character deleted are emitted as
hashed keys with the place of the deletion, and the line itself as one more. Lines with an equal key and an
equal place differ in that character only; a line equal to another's variant
lacks one character. In each bucket only the earliest is linked, so a bucket of
any size makes as many links as it has lines. Larger bounds delete recursively (:func:`far_links`), at a cost that
grows with the line's length to the power of the bound. Links are verified on the lines'
texts. Variants are emitted for those lines only that share a piece with a line
of fitting length, since edits leave one of ``max_edits + 1`` pieces untouched; a bitmap
tells which, sized from their number up to 2**30 bits, and its false hits only cost variants.

Defined cases: null text has no lines and stays null; a null id counts as the last; rows that share an id, or have none,
are rows of their own, in the order of a digest of their texts and then as they are read, so a row that repeats loses the lines that the first one keeps; texts and lines of any length are whole; an empty table gives an empty
result; other columns are carried along, whatever their names, but for the two that are added.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm import words as W
from cadence.llm.blocks import shards_of
from cadence.llm.common import Workspace, apart, free, n_shuffle, no_shuffle_files, release

LAST = 2**63 - 1
#: Bounds of the bitmap's size in bits, as powers of two.
BITS = (26, 30)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    got = _powers.get(int(base))
    if got is None or len(got) < n:
        steps = np.full(max(n, 4096), base, np.uint64)
        steps[0] = 1
        got = _powers[int(base)] = np.cumprod(steps)
    return got[:n]


@dataclass
class Lines:
    """The eligible lines of some texts: code points, ranges without outer white space, and where they stand."""

    points: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    line: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


def find(ids: np.ndarray, texts: list[str], min_chars: int) -> Lines:
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    offs = np.concatenate([[0], np.cumsum(sizes)])
    breaks = np.flatnonzero(points == 10)
    begin = np.sort(np.concatenate([offs[:-1], breaks + 1]), kind="stable")
    owner = np.concatenate([np.arange(len(texts)), np.searchsorted(offs, breaks, "right") - 1])
    owner = np.sort(owner, kind="stable")
    end = np.empty_like(begin)
    end[:-1] = begin[1:] - 1
    last = np.flatnonzero(np.diff(np.append(owner, len(texts))))
    end[last] = offs[1:][owner[last]]
    first_line = np.searchsorted(owner, owner)
    line = np.arange(len(begin)) - first_line
    small = points < 0x21
    inside = np.flatnonzero(~((points == 0x20) | (small & (points >= 9) & (points <= 13))))
    a, b = np.searchsorted(inside, begin), np.searchsorted(inside, end)
    ok = np.flatnonzero(b > a)
    start, stop = inside[a[ok]], inside[b[ok] - 1] + 1
    long = stop - start >= min_chars
    start, stop, ok = start[long], stop[long], ok[long]
    pair = np.frombuffer(b"".join(xxhash.xxh3_128_digest(points[s:e].tobytes()) for s, e in zip(start.tolist(), stop.tolist(), strict=True)), np.uint64).reshape(-1, 2)
    return Lines(points, start, stop, ids[owner[ok]], line[ok].astype(np.int32), pair[:, 0].copy(), pair[:, 1].copy())


def sums(found: Lines, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Running polynomial sums of these lines, one after another with a zero before each: the sums, each line's start in them, and lengths."""
    size = found.end[which] - found.begin[which]
    at = np.cumsum(size + 1) - (size + 1)
    place = np.arange(int((size + 1).sum())) - np.repeat(at, size + 1)
    source = np.repeat(found.begin[which], size + 1) + place - 1
    value = W.mixed(found.points[np.maximum(source, 0)].astype(np.uint64) + np.uint64(1))
    power = powers(_BASE, int(size.max()) + 1 if len(size) else 1)
    value = np.where(place > 0, value * power[np.maximum(place - 1, 0)], np.uint64(0))
    total = np.cumsum(value, dtype=np.uint64)
    return total - np.repeat(total[at], size + 1), at, size


def piece_keys(found: Lines, which: np.ndarray, max_edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and lines (as numbers into ``which``): lines within ``max_edits`` edits share a key.

    The longer of two such lines, cut into ``max_edits + 1`` pieces, has one that no edit touches, and the
    shorter holds it, moved by at most ``max_edits`` places. So a line gives its own pieces, and
    for each longer length in reach what may be a piece there. With one edit these are halves.
    """
    run, at, n = sums(found, which)
    back = powers(_INVERSE, int(n.max()) + max_edits + 2 if len(n) else 1)
    keys, lines = [], []
    for more in range(max_edits + 1):
        whole = n + more
        for j in range(max_edits + 1):
            low, high = whole * j // (max_edits + 1), whole * (j + 1) // (max_edits + 1)
            # With one edit and one character more, a first half stays in place and a second one moves by one.
            shifts = [0] if not more and max_edits == 1 else [-j] if max_edits == 1 else range(-max_edits, max_edits + 1)
            for shift in shifts:
                ok = np.flatnonzero((low + shift >= 0) & (high + shift <= n) & (high > low))
                a, b = (low + shift)[ok], (high + shift)[ok]
                part = (run[at[ok] + b] - run[at[ok] + a]) * back[a]
                keys.append(W.mixed(part + W.mixed((whole[ok] * (max_edits + 1) + j).astype(np.uint64) + np.uint64(7))))
                lines.append(ok)
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(lines)


def variants(found: Lines, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, places and lines (as numbers into ``which``): all deletions of one character, and the line itself with place -1."""
    run, at, n = sums(found, which)
    line = np.repeat(np.arange(len(which)), n + 1)
    p = np.arange(len(line)) - np.repeat(at, n + 1) - 1
    total = run[at + n][line]
    i = np.maximum(p, 0)
    without = run[at[line] + i] + (total - run[np.minimum(at[line] + i + 1, len(run) - 1)]) * _INVERSE
    size = np.where(p < 0, n[line], n[line] - 1).astype(np.uint64)
    return W.mixed(np.where(p < 0, total, without) + W.mixed(size)), p.astype(np.int32), line


def earliest(lo: np.ndarray, hi: np.ndarray, doc: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by line content, then position; and whether a row is the first of its content. A row at the first one's own position is first too."""
    order = np.lexsort((line, doc, hi, lo))
    if not len(order):
        return order, np.zeros(0, bool)
    lo, hi, doc, line = lo[order], hi[order], doc[order], line[order]
    new = np.ones(len(order), bool)
    new[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order, (doc == doc[head]) & (line == line[head])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[str]]]:
    for b in batches:
        texts = b.column("text")
        ids = b.column("doc_id").cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)
        for i, j in W.chunks(texts):
            yield ids[i:j], [t or "" for t in texts.slice(i, j - i).to_pylist()]


def _table(rows: list[list], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "binary": pa.binary(), "long": pa.int64()}
    names = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), names, strict=True)], names=[n for n, _ in names])


def _by_shard(key: np.ndarray, n: int, *cols: np.ndarray) -> Iterator[list]:
    """Rows ``shard, packed columns`` of the full shards."""
    shard = (key >> np.uint64(64 - (n.bit_length() - 1))).astype(np.int64) if n > 1 else np.zeros(len(key), np.int64)
    order = np.argsort(shard, kind="stable")
    cut = np.searchsorted(shard[order], np.arange(n + 1))
    cols = [c[order] for c in cols]
    for s in np.flatnonzero(np.diff(cut)):
        yield [int(s), *(c[cut[s] : cut[s + 1]].tobytes() for c in cols)]


def _meet(rows: list[dict], name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(r[name], kind) for r in rows if r[name] is not None] or [np.zeros(0, kind)])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    held: list[dict] = []
    for b in batches:
        for k in range(0, b.num_rows, 64):
            for r in b.slice(k, 64).to_pylist():
                if held and held[0]["shard"] != r["shard"]:
                    yield held
                    held = []
                held.append(r)
    if held:
        yield held


_DROPS = "doc binary, line binary, lo binary"


def equal_lines(docs: DataFrame, ws: Workspace, min_chars: int, equal_chars: int, max_edits: int) -> DataFrame:
    """Packed drops of equal lines from ``equal_chars``, and the numbers (``refs``) of lines from ``min_chars`` that share a piece with another (see :func:`piece_keys`)."""
    n = shards_of(docs.sparkSession)
    schema = "shard int, lo binary, hi binary, doc binary, line binary, gone_doc binary, gone_line binary, gone_lo binary, key binary, ref binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for no, (ids, texts) in enumerate(_rows(batches)):
            found = find(ids, texts, equal_chars)
            if not len(found.lo):
                continue
            order, first = earliest(found.lo, found.hi, found.doc, found.line)
            keep, gone = order[first], order[~first]
            out = [[*r, None, None, None, None, None] for r in _by_shard(found.lo[keep], n, found.lo[keep], found.hi[keep], found.doc[keep], found.line[keep])]
            if len(gone):
                out.append([no % n, None, None, None, None, found.doc[gone].tobytes(), found.line[gone].tobytes(), found.lo[gone].tobytes(), None, None])
            if max_edits:
                keep = keep[found.end[keep] - found.begin[keep] >= min_chars]
                keys, line = piece_keys(found, keep, max_edits)
                refs = (found.lo[keep] >> np.uint64(32)).astype(np.uint32)[line]
                out += [[s, *[None] * 7, k, r] for s, k, r in _by_shard(keys, n, keys, refs)]
            yield _table(out, schema)
        release()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches):
            lo, hi = _meet(rows, "lo", np.uint64), _meet(rows, "hi", np.uint64)
            doc, line = _meet(rows, "doc", np.int64), _meet(rows, "line", np.int32)
            order, first = earliest(lo, hi, doc, line)
            gone = order[~first]
            out_doc = np.concatenate([doc[gone], _meet(rows, "gone_doc", np.int64)])
            out_line = np.concatenate([line[gone], _meet(rows, "gone_line", np.int32)])
            out_lo = np.concatenate([lo[gone], _meet(rows, "gone_lo", np.uint64)])
            key, ref = _meet(rows, "key", np.uint64), _meet(rows, "ref", np.uint32)
            order = np.lexsort((ref, key))
            key, ref = key[order], ref[order]
            other = (key[1:] == key[:-1]) & (ref[1:] != ref[:-1])
            shared = np.isin(key, key[1:][other])
            yield _table([[out_doc.tobytes(), out_line.tobytes(), out_lo.tobytes(), np.unique(ref[shared]).tobytes()]], _DROPS + ", refs binary")

    dealt = docs.select("doc_id", "text").mapInArrow(send, schema).repartition(n_shuffle(docs.sparkSession), "shard").sortWithinPartitions("shard")
    return ws.put(dealt.mapInArrow(settle, _DROPS + ", refs binary"), "equal")


def bitmap_bits(equal: DataFrame) -> int:
    """Room for 64 times the lines that share a piece, so that few others are taken for one, within BITS. A false hit costs some thirty times its line."""
    n = equal.agg(F.sum(F.octet_length("refs") / 4)).first()[0] or 0
    return min(BITS[1], max(BITS[0], int(64 * n).bit_length()))


def bitmap(equal: DataFrame, size: int) -> np.ndarray:
    """Which line numbers may share a piece: 2 ** size bits, put together slice by slice, whatever the input."""
    slices = 64
    width = (1 << size) // slices

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column("refs").to_pylist():
                at = np.unique(np.frombuffer(raw, np.uint32) >> np.uint32(32 - size)).astype(np.int64)
                edge = np.searchsorted(at, np.arange(slices + 1) * width)
                rows = [[int(s), (at[edge[s] : edge[s + 1]] - s * width).astype(np.int32).tobytes()] for s in np.flatnonzero(np.diff(edge))]
                if rows:
                    yield _table(rows, "shard int, at binary")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full: dict[int, np.ndarray] = {}
        for b in batches:
            for r in b.to_pylist():
                full.setdefault(r["shard"], np.zeros(width, bool))[np.frombuffer(r["at"], np.int32)] = True
        if full:
            yield _table([[s, np.packbits(x).tobytes()] for s, x in full.items()], "shard int, bits binary")

    with no_shuffle_files(equal.sparkSession):
        rows = equal.select("refs").mapInArrow(cut, "shard int, at binary").repartition(slices, "shard").mapInArrow(fill, "shard int, bits binary").collect()
    out = np.zeros((slices, width // 8), np.uint8)
    for r in rows:
        out[r["shard"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.ravel()


_LINKS = "doc long, line int, lo long, to_doc long, to_line int"


def deletions(points: list[int], max_edits: int) -> dict[tuple[tuple[int, ...], tuple[int, ...]], None]:
    """All variants with up to ``max_edits`` characters deleted, by recursion: what is left, and where in it characters are missing."""
    out = {}

    def go(rest: tuple[int, ...], gaps: tuple[int, ...], start: int, left: int) -> None:
        out[rest, gaps] = None
        if left:
            for p in range(start, len(rest)):
                go(rest[:p] + rest[p + 1 :], (*gaps, p), p, left - 1)

    go(tuple(points), (), 0, max_edits)
    return out


def far_links(docs: DataFrame, bits: np.ndarray, size: int, min_chars: int, max_edits: int) -> DataFrame:
    """:func:`near_links` for any bound.

    Two lines are within the bound where they have variants with the same rest, of which the gaps they share
    (there one character replaces another) and those only one has add up to no more. So each variant is keyed by its rest
    and every choice of its gaps as the shared ones. All lines of a bucket whose gaps together, less
    the shared, are within the bound match; the earliest of them, for each number of gaps, is linked.
    """
    from itertools import combinations

    n = shards_of(docs.sparkSession)
    schema = "shard int, key binary, gaps binary, shared binary, doc binary, line binary, lo binary"
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for ids, texts in _rows(batches):
            found = find(ids, texts, min_chars)
            at = (found.lo >> np.uint64(64 - size)).astype(np.int64)
            may = np.flatnonzero((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1)
            order, first = earliest(found.lo[may], found.hi[may], found.doc[may], found.line[may])
            for x in may[order[first]].tolist():
                keys, gaps, shared = [], [], []
                for rest, missing in deletions(found.points[found.begin[x] : found.end[x]].tolist(), max_edits):
                    raw = np.array(rest, np.uint32).tobytes()
                    for c in range(len(missing) + 1):
                        for common in dict.fromkeys(combinations(missing, c)):
                            keys.append(xxhash.xxh3_64_intdigest(raw + b"|" + np.array(common, np.uint32).tobytes() + bytes([c])))
                            gaps.append(len(missing))
                            shared.append(c)
                key = np.array(keys, np.uint64)
                k = len(key)
                yield _table(list(_by_shard(key, n, key, np.array(gaps, np.int8), np.array(shared, np.int8), np.full(k, found.doc[x]), np.full(k, found.line[x], np.int32), np.full(k, found.lo[x]))), schema)
        release()

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches):
            cols = [_meet(rows, c, k) for c, k in (("key", np.uint64), ("gaps", np.int8), ("shared", np.int8), ("doc", np.int64), ("line", np.int32), ("lo", np.uint64))]
            order = np.lexsort((cols[4], cols[3], cols[1], cols[0]))
            key, gaps, shared, doc, line, lo = (c[order] for c in cols)
            cut = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else [], len(key)).astype(np.int64)
            out = []
            for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if e - s < 2:
                    continue
                heads = {}
                for k in range(s, e):
                    heads.setdefault(int(gaps[k]), k)
                for k in range(s, e):
                    room = max_edits + int(shared[k]) - int(gaps[k])
                    near = [h for g, h in heads.items() if g <= room and lo[h] != lo[k] and (doc[h], line[h]) < (doc[k], line[k])]
                    if near:
                        h = min(near, key=lambda h: (doc[h], line[h]))
                        out.append((int(doc[k]), int(line[k]), int(lo[k : k + 1].view(np.int64)[0]), int(doc[h]), int(line[h])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*set(out), strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=[f.split()[0] for f in _LINKS.split(", ")])

    dealt = docs.select("doc_id", "text").mapInArrow(send, schema).repartition(n_shuffle(docs.sparkSession), "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(link, _LINKS).distinct()


def near_links(docs: DataFrame, bits: np.ndarray, size: int, min_chars: int, max_edits: int = 1) -> DataFrame:
    """For lines within ``max_edits`` edits from an earlier line, such a line; not yet verified."""
    if max_edits > 1:
        return far_links(docs, bits, size, min_chars, max_edits)
    n = shards_of(docs.sparkSession)
    schema = "shard int, key binary, place binary, doc binary, line binary, lo binary"
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for ids, texts in _rows(batches):
            found = find(ids, texts, min_chars)
            at = (found.lo >> np.uint64(64 - size)).astype(np.int64)
            may = np.flatnonzero((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1)
            order, first = earliest(found.lo[may], found.hi[may], found.doc[may], found.line[may])
            may = may[order[first]]
            heavy = np.cumsum(found.end[may] - found.begin[may] + 1) >> 18  # some hundred thousand variants at a time
            for part in np.unique(heavy):
                which = may[heavy == part]
                key, place, no = variants(found, which)
                rows = list(_by_shard(key, n, key, place, found.doc[which][no], found.line[which][no], found.lo[which][no]))
                yield _table(rows, schema)
        release()

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches):
            key, place = _meet(rows, "key", np.uint64), _meet(rows, "place", np.int32)
            doc, line, lo = _meet(rows, "doc", np.int64), _meet(rows, "line", np.int32), _meet(rows, "lo", np.uint64)
            order = np.lexsort((line, doc, place, key))
            key, place, doc, line, lo = (x[order] for x in (key, place, doc, line, lo))
            index = np.arange(len(key))
            head = np.maximum.accumulate(np.where(np.concatenate([[True], (key[1:] != key[:-1]) | (place[1:] != place[:-1])]), index, 0))
            pairs = [(index[m], head[m]) for m in [(place >= 0) & (lo != lo[head])]]  # one character replaced
            top = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), index, 0))
            whole = place[top] < 0  # buckets of a whole line; its earliest is first
            b = index[whole & (place >= 0)]
            earlier = (doc[top[b]] < doc[b]) | ((doc[top[b]] == doc[b]) & (line[top[b]] < line[b]))
            pairs.append((b[earlier], top[b][earlier]))  # a character more than an earlier line
            if len(b):  # a character less than an earlier line: the earliest of those with one more
                rank = np.lexsort((line[b], doc[b], top[b]))
                b = b[rank]
                b = b[np.concatenate([[True], top[b][1:] != top[b][:-1]])]
                least = np.full(len(key), -1)
                least[top[b]] = b
                a = index[whole & (place < 0)]
                a = a[least[top[a]] >= 0]
                c = least[top[a]]
                earlier = (doc[c] < doc[a]) | ((doc[c] == doc[a]) & (line[c] < line[a]))
                pairs.append((a[earlier], c[earlier]))
            x, y = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(doc[x]), pa.array(line[x]), pa.array(lo[x].view(np.int64)), pa.array(doc[y]), pa.array(line[y])], names=[f.split()[0] for f in _LINKS.split(", ")])

    dealt = docs.select("doc_id", "text").mapInArrow(send, schema).repartition(n_shuffle(docs.sparkSession), "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(link, _LINKS).distinct()


def within(a: str, b: str, bound: int) -> bool:
    """Whether the edit distance is at most ``bound``."""
    if abs(len(a) - len(b)) > bound:
        return False
    if bound == 1:
        if len(a) > len(b):
            a, b = b, a
        i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
        return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(last[j - 1] + (x != y), last[j] + 1, row[j - 1] + 1)
    return row[-1] <= bound


def verified(docs: DataFrame, links: DataFrame, ws: Workspace, max_edits: int = 1) -> DataFrame:
    """``doc, line, lo`` of the links whose lines' texts are within ``max_edits`` edits."""
    links = ws.put(links, "links")
    need = links.select("doc", "line").union(links.select("to_doc", "to_line")).groupBy("doc").agg(F.collect_set("line").alias("lines"))
    need = ws.put(need, "needed")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), "text").join(need, "doc")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                parts = (r["text"] or "").split("\n")
                out += [(r["doc"], k, parts[k].strip(" \t\n\x0b\x0c\r")) for k in r["lines"] if k < len(parts)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.string()), strict=True)], names=["doc", "line", "said"])

    said = ws.put(rows.mapInArrow(cut, "doc long, line int, said string").distinct(), "said")
    both = links.join(said, ["doc", "line"]).join(said.select(F.col("doc").alias("to_doc"), F.col("line").alias("to_line"), F.col("said").alias("to_said")), ["to_doc", "to_line"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = pa.array([within(x, y, max_edits) for x, y in zip(b.column("said").to_pylist(), b.column("to_said").to_pylist(), strict=True)], pa.bool_())
            yield b.select(["doc", "line", "lo"]).filter(ok)

    return both.select("doc", "line", "lo", "said", "to_said").mapInArrow(check, "doc long, line int, lo long").distinct()


def dedup_lines(docs: DataFrame, *, min_chars: int = 20, max_edits: int = 1, equal_chars: int = 1, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """``docs`` with ``text`` rid of repeated lines, and two columns ``counts``: its lines, with or without words, and those removed.

    Lines match equal ones from ``equal_chars`` on, and those within ``max_edits`` edits from ``min_chars`` on; 0 is equal lines only. Input columns named as ``counts`` give way.
    """
    if max_edits < 0:
        raise ValueError("max_edits must not be negative")
    ws = Workspace(docs.sparkSession, "lines")
    columns = docs.columns
    docs, no = apart(docs, ws)
    named = docs.select(F.col(no or "doc_id").alias("doc_id"), "text")
    equal = equal_lines(named, ws, min_chars, min(equal_chars, min_chars), max_edits)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.select(["doc", "line", "lo"]).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["doc"], np.int64)), pa.array(np.frombuffer(r["line"], np.int32)), pa.array(np.frombuffer(r["lo"], np.int64))], names=["doc", "line", "lo"])

    drops = equal.select("doc", "line", "lo").mapInArrow(unpack, "doc long, line int, lo long")
    if max_edits:
        size = bitmap_bits(equal)
        drops = drops.unionByName(verified(named, near_links(named, bitmap(equal, size), size, min_chars, max_edits), ws, max_edits))
    at, gone_lines = free("_doc", docs), free("_drops", docs)
    drops = ws.put(drops.groupBy("doc").agg(F.collect_set(F.struct("line", "lo")).alias("drops")), "drops")
    ws.drop("equal", "links", "needed", "said")
    drops = drops.select(F.col("doc").alias(at), F.col("drops").alias(gone_lines))
    key = F.coalesce(F.col(no or "doc_id").cast("long"), F.lit(LAST))
    rest = [c for c in columns if c not in counts]
    rows = docs.join(drops, key == F.col(at), "left").select(*[F.col(f"`{c}`") for c in [*rest, gone_lines]])
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*(f"`{c}` {fields[c]}" for c in rest), *(f"`{c}` int" for c in counts)])

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, lines, gone = b.column("text").to_pylist(), [], []
            for i, (text, drop) in enumerate(zip(texts, b.column(gone_lines).to_pylist(), strict=True)):
                parts = text.split("\n") if text is not None else []
                out = set()
                for d in drop or ():
                    if d["line"] < len(parts) and line_number(parts[d["line"]]) == d["lo"]:
                        out.add(d["line"])
                lines.append(len(parts))
                gone.append(len(out))
                if out:
                    texts[i] = "\n".join(p for k, p in enumerate(parts) if k not in out)
            cols = [pa.array(texts, b.schema.field("text").type) if c == "text" else b.column(c) for c in rest]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lines, pa.int32()), pa.array(gone, pa.int32())], names=[*rest, *counts])

    return rows.mapInArrow(rebuild, schema)


def line_number(line: str) -> int:
    """The first 64 bits of a line's hash, as a signed number."""
    raw = line.strip(" \t\n\x0b\x0c\r").encode("utf-32-le", "surrogatepass")
    return int(np.frombuffer(xxhash.xxh3_128_digest(raw), np.int64)[0])
