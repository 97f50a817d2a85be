"""Substring dedup: passages that repeat across documents, by collinear chaining.

Runs of ``k`` words are hashed and thinned by winnowing, so that every shared
run of ``k + window - 1`` words shares a seed. Every occurrence goes to its seed's
shard. A seed with at most ``FEW`` holders is matched with every earlier one; the later occurrences of others are matched with the earliest document and with the
one before. So a seed that a third of all documents holds makes matches in
proportion to its occurrences.

Where the seeds of a passage have many holders, those two may hold pieces only, such as quotes.
So, first, two such seeds of a document that stand nearly ``min_words`` apart are hashed as a couple, which a shorter quote can't hold, and a couple is
matched, by both its seeds, with the earliest document that holds it: a document with edits between its seeds still finds one that holds as much of the passage. Second, every run of ``min_words`` words whose seeds are all shared is hashed too and
matched with the earliest document that holds all of it: each such run that an
earlier document has is in a passage of the result. Runs go to the shard of
their least seed, which neighbours mostly have in common, so neighbours travel as one; a bitmap of fixed size tells
shared seeds, and its false hits only cost runs.

Last, what no row covers so far is looked up in full (:func:`missed`): where seeds that others share reach over ``min_words`` words of a document, some of them with many holders and some
in no row, each of them meets, with a second one, every earlier document that holds both. Holders with the same text in between count as one, since
those are in rows of equal runs. So each stretch that an earlier document holds with shared seeds from end to end is in a row, whoever quotes its pieces.

Matches of a pair of documents are chained: ordered in both, each worth its
words less a cost for gaps, the best predecessor inside the gap window from Fenwick trees of
maxima. Chains are then aligned word by word, gaps by dynamic programming and
ends by extension, and kept from ``min_words`` words and ``identity``; an equal run
whose extension falls under that is kept as it is. What lies in another passage of the pair goes.

Defined cases: words are lower-cased in A-Z; texts under ``min_words`` words, empty or
null, hold no passage; rows that share an id, or have none (they come last), are documents of their own, in the order of a digest of their texts and then as they are
read; texts of any length are whole, in one row each; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm import words as W
from cadence.llm.blocks import shards_of
from cadence.llm.common import Workspace, apart, n_shuffle, no_shuffle_files, release
from cadence.llm.lines import _BASE, _INVERSE, LAST, _by_shard, _grouped, _meet, _table, bitmap, powers

K, WINDOW, MAX_GAP = 5, 8, 30
#: What a matched word is worth in a chain, where a word of gap costs one.
WORTH = 20
#: Holders up to which a seed meets all earlier ones.
FEW = 4
#: How many words the distances of couples range over.
COUPLE = 10
#: The most bits of a bitmap of seeds, as a power of two.
BITS = 28


def seeds(w: W.Words, min_words: int, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and word position of the winnowed runs: the least hash of every ``window`` neighbouring runs."""
    return thinned(w, min_words, *W.windows(w, k), window)[:3]


def thinned(w: W.Words, min_words: int, key: np.ndarray, owner: np.ndarray, at: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """:func:`seeds` of runs that are hashed already, and the numbers of all winnowed runs."""
    all_of = winnowed(key, owner, window)
    pick = all_of[w.counts[owner[all_of]] >= min_words]
    return key[pick], owner[pick], at[pick], all_of


def winnowed(key: np.ndarray, owner: np.ndarray, window: int = WINDOW) -> np.ndarray:
    if len(key) < window:
        return np.zeros(0, np.int64)
    at, low, span = np.arange(len(key)), key, 1
    while span < window:  # the first least of ever longer stretches
        step = min(span, window - span)
        m = len(low) - step
        at = np.where(low[step:] < low[:m], at[step:], at[:m])
        low = np.minimum(low[step:], low[:m])
        span += step
    at = at[owner[: len(at)] == owner[window - 1 :]]
    return at[_heads(at) == np.arange(len(at))]


def least(key: np.ndarray, span: int) -> np.ndarray:
    """The minimum of every ``span`` neighbours."""
    out, k = key, 1
    while 2 * k <= span:
        out, k = np.minimum(out[:-k], out[k:]), 2 * k
    n = len(key) - span + 1
    return np.minimum(out[:n], out[span - k : span - k + n])


def long_runs(w: W.Words, min_words: int, bits: np.ndarray, key: np.ndarray, owner: np.ndarray, at: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, least seed, text and word position of the runs of ``min_words`` words whose seeds (those numbered ``pick`` of the short runs given) are all shared."""
    span = min_words - min(K, min_words) + 1
    if len(key) < span:
        return key[:0], key[:0], owner[:0], at[:0]
    f = np.arange(len(key) - span + 1)
    ok = owner[f] == owner[f + span - 1]
    if span > 2 * (WINDOW - 1):  # a seed that far inside is one wherever the run stands
        alone = np.zeros(len(key) + 1, np.int64)
        alone[pick + 1] = ~marked(bits, key[pick])
        alone = np.cumsum(alone)
        ok &= alone[f + span - WINDOW + 1] == alone[f + WINDOW - 1]
    f = f[ok]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hashes * powers(_BASE, len(w.hashes)), dtype=np.uint64)])
    g = w.first[owner[f]] + at[f]
    run = W.mixed((total[g + min_words] - total[g]) * powers(_INVERSE, len(w.hashes))[g])
    return run, least(key, span)[f], owner[f], at[f]


class _Window:
    """Best entries by y, for the MAX_GAP places below any y: Fenwick trees of maxima over each stretch of MAX_GAP places, one from its start and one from its end."""

    def __init__(self):
        self.low: dict[int, list[tuple[int, int]]] = {}
        self.high: dict[int, list[tuple[int, int]]] = {}

    def put(self, y: int, entry: tuple[int, int]) -> None:
        stretch, place = divmod(y, MAX_GAP)
        for side, p in ((self.low, place + 1), (self.high, MAX_GAP - place)):
            tree = side.setdefault(stretch, [_NONE] * (MAX_GAP + 1))
            while p <= MAX_GAP:
                if entry > tree[p]:
                    tree[p] = entry
                p += p & -p

    def best(self, y: int) -> tuple[int, int]:
        stretch, place = divmod(y, MAX_GAP)
        best = _NONE
        for tree, p in ((self.low.get(stretch), place), (self.high.get(stretch - 1), MAX_GAP - place)):
            while tree and p > 0:
                if tree[p] > best:
                    best = tree[p]
                p -= p & -p
        return best


_NONE = (-(1 << 62), -1)


def chain_scores(x: list[int], y: list[int], k: int = K) -> tuple[list[int], list[int]]:
    """For each match (sorted by x, then y) the best score of a chain that ends in it, and the match before it there (-1: none).

    A match is worth ``k * WORTH``, a step costs one for each word it goes on in x and in y, and
    goes on by one to MAX_GAP words in both. x is taken in stretches of MAX_GAP places: a window
    reaches back into the end of the stretch before, whose matches enter a tree from the last on while
    the wanted x goes down, and over the start of its own, whose matches enter as x goes up.
    So each tree holds only matches inside the window when it is asked.
    """
    n = len(x)
    score, before = [k * WORTH] * n, [-1] * n
    last: list[int] = []
    i = 0
    while i < n:
        stretch, j = x[i] // MAX_GAP, i
        while j < n and x[j] // MAX_GAP == stretch:
            j += 1
        found = [_NONE] * (j - i)
        if last and x[last[0]] // MAX_GAP == stretch - 1:
            back, at = _Window(), len(last) - 1
            for m in range(j - 1, i - 1, -1):
                while at >= 0 and x[last[at]] >= x[m] - MAX_GAP:
                    b = last[at]
                    back.put(y[b], (score[b] + x[b] + y[b], b))
                    at -= 1
                found[m - i] = back.best(y[m])
        own, done = _Window(), i
        for m in range(i, j):
            while x[done] < x[m]:  # those of one x don't follow each other
                own.put(y[done], (score[done] + x[done] + y[done], done))
                done += 1
            value, b = max(found[m - i], own.best(y[m]))
            if b >= 0 and (gain := value - x[m] - y[m]) > 0:
                score[m], before[m] = score[m] + gain, b
        last, i = list(range(i, j)), j
    return score, before


def chain(x: np.ndarray, y: np.ndarray, k: int = K) -> list[np.ndarray]:
    """Chains of matches ``(x, y)`` (sorted by x, then y) as index arrays; each is increasing in both, with steps of at most MAX_GAP words.

    No chain crosses a gap in x, so what lies between gaps is chained by itself.
    Where it is increasing in y too, a match's neighbour is its best predecessor (the
    way over it costs the same and is worth a match more), so the chain needs no tree.
    """
    out: list[np.ndarray] = []
    cut = np.concatenate([[0], np.flatnonzero(np.diff(x) > MAX_GAP) + 1, [len(x)]])
    for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if e <= s:
            continue
        px, py = x[s:e], y[s:e]
        if (np.diff(px) > 0).all() and (np.diff(py) > 0).all():
            out += np.split(np.arange(s, e), np.flatnonzero(np.diff(py) > MAX_GAP) + 1)
            continue
        out += [s + c for c in _tree_chains(px.tolist(), py.tolist(), k)]
    return out


def single_chains(x: np.ndarray, y: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Of groups of matches, from each of ``cut`` to the next, which are one chain from end to end."""
    dx, dy = np.diff(x), np.diff(y)
    breaks = np.concatenate([[0], np.cumsum((dx <= 0) | (dy <= 0) | (dx > MAX_GAP) | (dy > MAX_GAP))])
    return breaks[cut[1:] - 1] == breaks[cut[:-1]]


def _tree_chains(x: list[int], y: list[int], k: int) -> list[np.ndarray]:
    score, before = chain_scores(x, y, k)
    out, used = [], [False] * len(x)
    for j in sorted(range(len(x)), key=lambda j: -score[j]):
        way = []
        while j >= 0 and not used[j]:
            used[j] = True
            way.append(j)
            j = before[j]
        if way:
            out.append(np.array(way[::-1]))
    return out


def edit_matches(a: list[int], b: list[int]) -> int:
    """Equal words in a best alignment of two gaps."""
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            above = row[j]
            row[j] = diagonal + 1 if x == y else max(row[j], row[j - 1])
            diagonal = above
    return row[-1]


def extend(a: np.ndarray, b: np.ndarray, drop: int = 4) -> tuple[int, int]:
    """How far two sequences go on alike from their start (one worth for an equal word, one off for another), and equal words on the way."""
    n = min(len(a), len(b))
    best = score = length = found = hits = 0
    for i in range(n):
        if a[i] == b[i]:
            score, hits = score + 1, hits + 1
        else:
            score -= 1
        if score > best:
            best, length, found = score, i + 1, hits
        if score < best - drop:
            break
    return length, found


def align(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, k: int = K) -> tuple[int, int, int, int, int]:
    """Start and end in ``a`` and in ``b`` of the aligned chain, and equal words. ``x, y``: the chain's matches as positions in ``a, b``."""
    i, j, matches = int(x[0]), int(y[0]), 0
    left, hits = extend(a[:i][::-1], b[:j][::-1])
    start, from_ = i - left, j - left
    matches += hits
    for p, q in zip(x.tolist(), y.tolist(), strict=True):
        if p < i or q < j:  # inside what is aligned already
            back = max(i - p, j - q)
            if back >= k:
                continue
            p, q, run = p + back, q + back, k - back
        else:
            run = k
        if p - i == q - j:
            matches += int((a[i:p] == b[j:q]).sum())
        elif p > i and q > j:
            matches += edit_matches(a[i:p].tolist(), b[j:q].tolist())
        matches += run
        i, j = p + run, q + run
    right, hits = extend(a[i:], b[j:])
    return start, i + right, from_, j + right, matches + hits


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, W.Words]]:
    for b in batches:
        ids = b.column("doc_id").cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)
        for i, j in W.chunks(b.column("text")):
            yield ids[i:j], W.split(b.column("text").slice(i, j - i))


def _heads(*keys: np.ndarray) -> np.ndarray:
    """For sorted rows, the place of the first row with equal keys."""
    n = len(keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else np.zeros(0, np.int64)


def holders(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For rows sorted by seed and document, how many documents hold the row's seed."""
    new = _heads(key, doc) == np.arange(len(key))
    group = np.cumsum(_heads(key) == np.arange(len(key))) - 1
    return np.bincount(group[new])[group] if len(key) else np.zeros(0, np.int64)


def matches_of(key: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by seed, document and place: pairs of a row and its match in the seed's earliest document, and in the document before; of seeds with few holders, in every one before."""
    seed, own = _heads(key), _heads(key, doc)
    index = np.arange(len(key))
    first = index[own != seed]
    second = first[own[first] - 1 != seed[first]]
    a, b = [first, second], [seed[first], own[second] - 1]
    few = second[holders(key, doc)[second] <= FEW]
    start = own[own[few] - 1]  # of the document before
    while len(few):
        go = (start != seed[few]) & (own[start - 1] != seed[few])
        few, start = few[go], start[go]
        a.append(few)
        b.append(start - 1)
        start = own[start - 1]
    return np.concatenate(a), np.concatenate(b)


def couples(key: np.ndarray, owner: np.ndarray, at: np.ndarray, hot: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and both places of couples of seeds (sorted by text and place) with many holders: each with the seed of least hash among those that end nearly ``min_words`` after it starts."""
    many = np.flatnonzero(marked(hot, key))
    key, owner, at = key[many], owner[many], at[many]
    far = max(1, min_words - K)
    place = owner * (np.int64(1) << 40) + at  # texts lie far apart
    low, high = np.searchsorted(place, place + max(1, far - COUPLE + 1)), np.searchsorted(place, place + far, "right")
    some = np.flatnonzero(high > low)
    if not len(some):
        return key[:0], owner[:0], at[:0], at[:0]
    size = (high - low)[some]
    other = np.repeat(low[some] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    first = np.repeat(some, size)
    order = np.lexsort((key[other], first))
    keep = order[np.concatenate([[True], first[order][1:] != first[order][:-1]])]
    i, j = first[keep], other[keep]
    return W.mixed(key[i] * _BASE + W.mixed(key[j])), owner[i], at[i], at[j]


_LINKS = "doc binary, src binary, x binary, y binary"


def marked(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which seeds a bitmap may hold."""
    no = (key >> np.uint64(64 - (8 * len(bits)).bit_length() + 1)).astype(np.int64)
    return ((bits[no >> 3] >> (7 - (no & 7)).astype(np.uint8)) & 1).astype(bool)


def sized_bitmap(numbers: DataFrame, room: int) -> np.ndarray:
    """A bitmap of ``refs`` with ``room`` bits for each, up to 2 ** BITS."""
    with no_shuffle_files(numbers.sparkSession):
        n = numbers.agg(F.sum(F.octet_length("refs") / 4)).first()[0] or 0
    return bitmap(numbers, min(BITS, max(20, int(room * n).bit_length())))


def seed_matches(docs: DataFrame, min_words: int) -> DataFrame:
    """Packed matches ``doc, src, x, y`` by shard of the document, the numbers (``refs``) of seeds that documents share, and those (``hot``) of seeds with many holders."""
    n = shards_of(docs.sparkSession)
    p = n_shuffle(docs.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, w in _rows(batches):
            key, owner, at = seeds(w, min_words)
            out = list(_by_shard(W.mixed(key), n, key, ids[owner], at.astype(np.int32)))  # seeds are least hashes, so low ones are common
            for k in range(0, len(out), 128):
                yield _table(out[k : k + 128], "shard int, key binary, place binary, at binary")
        release()

    def packed(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        doc, src, x, y = (np.concatenate(c) for c in zip(*parts, strict=True))
        out = [[*r, None, None] for r in _by_shard(W.mixed(doc.view(np.uint64)), n, doc, src, x, y)]
        for k in range(0, len(out), 128):
            yield _table(out[k : k + 128], f"shard int, {_LINKS}, refs binary, hot binary")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, count = [], 0
        for rows in _grouped(batches):
            key, doc, at = _meet(rows, "key", np.uint64), _meet(rows, "place", np.int64), _meet(rows, "at", np.int32)
            order = np.lexsort((at, doc, key))
            key, doc, at = key[order], doc[order], at[order]
            a, b = matches_of(key, doc, at)
            refs = np.unique((key[a] >> np.uint64(32)).astype(np.uint32))
            hot = np.unique((key[holders(key, doc) > FEW] >> np.uint64(32)).astype(np.uint32))
            yield _table([[rows[0]["shard"], None, None, None, None, refs.tobytes(), hot.tobytes()]], f"shard int, {_LINKS}, refs binary, hot binary")
            parts.append((doc[a], doc[b], at[a], at[b]))
            count += len(a)
            if count > HELD_COUPLES:  # matches of several shards travel in one row
                yield from packed(parts)
                parts, count = [], 0
        if parts:
            yield from packed(parts)
        release()

    sent = docs.select("doc_id", "text").mapInArrow(send, "shard int, key binary, place binary, at binary")
    return sent.repartition(p, "shard").sortWithinPartitions("shard").mapInArrow(meet, f"shard int, {_LINKS}, refs binary, hot binary")


def run_matches(docs: DataFrame, shared: Broadcast, min_words: int) -> DataFrame:
    """Packed matches of runs of ``min_words`` words with the earliest document that holds them, by shard of the document, ``n`` neighbours as one; and matches of couples (no ``n``)."""
    n = shards_of(docs.sparkSession)
    schema = "shard int, run binary, place binary, at binary, n binary, pair binary, there binary, start binary, stop binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hot = shared.value
        for ids, w in _rows(batches):
            short = W.windows(w, min(K, min_words))
            *found, pick = thinned(w, min_words, *short)
            pair, text, from_, to = couples(*found, hot, min_words)
            both = [[r[0], None, None, None, None, *r[1:]] for r in _by_shard(pair, n, pair, ids[text], from_.astype(np.int32), to.astype(np.int32))]
            run, seed, owner, at = long_runs(w, min_words, bits, *short, pick)
            seed = W.mixed(seed)  # the least of so many hashes is low: by itself, nearly span / n of all runs would meet in the first of n shards
            new = np.ones(len(run), bool)
            new[1:] = (seed[1:] != seed[:-1]) | (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)
            head = np.flatnonzero(new)
            size = np.diff(np.append(head, len(run))).astype(np.int32)
            heads = _by_shard(seed[head], n, ids[owner[head]], at[head].astype(np.int32), size)
            out = [[*a, *b[1:], None, None, None, None] for a, b in zip(_by_shard(seed, n, run), heads, strict=True)] + both
            for k in range(0, len(out), 128):
                yield _table(out[k : k + 128], schema)
        release()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches):
            run, size = _meet(rows, "run", np.uint64), _meet(rows, "n", np.int32)
            doc, at = spread(size, _meet(rows, "place", np.int64), _meet(rows, "at", np.int32))
            order = np.lexsort((at, doc, run))
            run, doc, at = run[order], doc[order], at[order]
            head = _heads(run)
            a = np.flatnonzero(doc != doc[head])
            doc, src, x, y, size = neighbours(doc[a], doc[head[a]], at[a], at[head[a]])
            out = list(_by_shard(W.mixed(doc.view(np.uint64)), n, doc, src, x, y, size))
            pair, doc = _meet(rows, "pair", np.uint64), _meet(rows, "there", np.int64)
            from_, to = _meet(rows, "start", np.int32), _meet(rows, "stop", np.int32)
            order = np.lexsort((from_, doc, pair))
            pair, doc, from_, to = pair[order], doc[order], from_[order], to[order]
            head = _heads(pair)
            a = np.flatnonzero(doc != doc[head])
            b = head[a]
            found = np.concatenate([doc[a], doc[a]]), np.concatenate([doc[b], doc[b]]), np.concatenate([from_[a], to[a]]), np.concatenate([from_[b], to[b]])
            out += [[*r, None] for r in _by_shard(W.mixed(found[0].view(np.uint64)), n, *found)]
            for k in range(0, len(out), 128):
                yield _table(out[k : k + 128], f"shard int, {_LINKS}, n binary")
        release()

    sent = docs.select("doc_id", "text").mapInArrow(send, schema)
    return sent.repartition(n_shuffle(docs.sparkSession), "shard").sortWithinPartitions("shard").mapInArrow(meet, f"shard int, {_LINKS}, n binary")


def spread(size: np.ndarray, fixed: np.ndarray, *at: np.ndarray) -> list[np.ndarray]:
    """Each row ``size`` times, with its places counted up."""
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return [np.repeat(fixed, size), *((np.repeat(c, size) + step).astype(np.int32) for c in at)]


def neighbours(doc: np.ndarray, src: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """Matches whose places go up by one in both documents as one row, with their number."""
    order = np.lexsort((x, x - y, src, doc))
    doc, src, x, y = doc[order], src[order], x[order], y[order]
    keep = _heads(doc, src, x, y) == np.arange(len(doc))
    doc, src, x, y = doc[keep], src[keep], x[keep], y[keep]
    step = np.arange(len(doc))
    head = np.flatnonzero(_heads(doc, src, x - step, y - step) == step)
    return doc[head], src[head], x[head], y[head], np.diff(np.append(head, len(doc))).astype(np.int32)


#: Documents in one step over packed seeds, couples of them that a task holds at once, and matches that a shard of :func:`missed` holds.
DOCS, HELD_COUPLES, HELD_MATCHES = 256, 1 << 18, 1 << 20


def _packed(b: pa.RecordBatch, **kinds) -> list[np.ndarray]:
    """The text number of every entry of packed columns, and these end to end."""
    cols = [b.column(c).to_pylist() for c in kinds]
    sizes = [len(x) // np.dtype(next(iter(kinds.values()))).itemsize for x in cols[0]]
    return [np.repeat(np.arange(b.num_rows), sizes), *(np.frombuffer(b"".join(c), k) for c, k in zip(cols, kinds.values(), strict=True))]


def _reach(owner: np.ndarray, at: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """For seeds sorted by text and place, the ranges of those that start ``low`` to ``high`` words later in the text."""
    place = owner * (np.int64(1) << 40) + at
    return np.searchsorted(place, place + low), np.searchsorted(place, place + high, "right")


def shared_seeds(docs: DataFrame, shared: Broadcast, min_words: int) -> DataFrame:
    """``doc`` and, packed, ``key, at, total, many`` of its shared seeds in stretches (no gap over MAX_GAP words) over ``min_words`` words with a seed of many holders; ``total`` is a hash of the words before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hot = shared.value
        for ids, w in _rows(batches):
            key, owner, at = seeds(w, min_words)
            keep = marked(bits, key)
            key, owner, at = key[keep], owner[keep], at[keep]
            if not len(key):
                continue
            many = marked(hot, key)
            place = owner * (np.int64(1) << 40) + at
            new = np.concatenate([[True], np.diff(place) > MAX_GAP])
            first, no = np.flatnonzero(new), np.cumsum(new) - 1
            last = np.append(first[1:], len(key)) - 1
            keep = (np.logical_or.reduceat(many, first) & (place[last] - place[first] + K >= min_words))[no]
            key, owner, at, many = key[keep], owner[keep], at[keep], many[keep]
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hashes * powers(_BASE, len(w.hashes)), dtype=np.uint64)])
            start = w.first[owner]
            total = (total[start + at] - total[start]) * powers(_INVERSE, len(w.hashes) + 1)[start]
            cut = np.append(np.flatnonzero(_heads(owner) == np.arange(len(owner))), len(owner))
            out = [[int(ids[owner[i]]), key[i:j].tobytes(), at[i:j].astype(np.int32).tobytes(), total[i:j].tobytes(), many[i:j].tobytes()] for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            if out:
                yield _table(out, "doc long, key binary, at binary, total binary, many binary")
        release()

    return docs.select("doc_id", "text").mapInArrow(run, "doc long, key binary, at binary, total binary, many binary")


def pairs(owner: np.ndarray, key: np.ndarray, at: np.ndarray, flags: np.ndarray, min_words: int, only_open: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Couples of seeds (sorted by text and place) that stand half to twice ``min_words`` apart, HELD_COUPLES at a time: both seeds, hash, and whether a seed that no row covers and one of many holders stand from one to the other."""
    # two seeds so far apart leave no gap over MAX_GAP between the first ones and the second ones of a chain over min_words
    low, high = _reach(owner, at, max(1, (min_words - K) // 2 + 2), 2 * min_words - K)
    count = [np.concatenate([[0], np.cumsum(flags & bit > 0)]) for bit in (1, 2)]
    some = high > low
    if only_open:  # those whose widest couple is
        some &= np.logical_and.reduce([c[high] > c[: len(key)] for c in count])
    some = np.flatnonzero(some)
    end = np.cumsum((high - low)[some])
    i = 0
    while i < len(some):
        j = max(i + 1, int(np.searchsorted(end, (end[i - 1] if i else 0) + HELD_COUPLES, "right")))
        size = (high - low)[some[i:j]]
        first = np.repeat(some[i:j], size)
        other = np.arange(len(first)) + np.repeat(low[some[i:j]] - (np.cumsum(size) - size), size)
        open_ = np.logical_and.reduce([c[other + 1] > c[first] for c in count])
        yield first, other, W.mixed(key[first] + (key[other] >> np.uint64(32)) * _BASE), open_
        i = j


def uncovered(held: DataFrame, rows: DataFrame, min_words: int) -> DataFrame:
    """:func:`shared_seeds` with ``flags``: one for a seed that no row covers, two for one of many holders; ``refs``: the numbers of couples with both from end to end (see :func:`missed`)."""
    ranges = rows.groupBy(F.col("doc_id").alias("doc")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, DOCS):
                b = whole.slice(i, DOCS)
                owner, key, at, many = _packed(b, key=np.uint64, at=np.int32, many=bool)
                lists = b.column("ranges")
                of = np.repeat(np.arange(b.num_rows), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)) * (np.int64(1) << 40)
                low, high = (of + lists.flatten().field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                order = np.argsort(low, kind="stable")
                low, high = low[order], np.maximum.accumulate(high[order]) if len(order) else high
                new = np.concatenate([[True], low[1:] > high[:-1]])[: len(low)]
                low, high = low[new], high[np.append(np.flatnonzero(new)[1:], len(new)) - 1] if len(new) else high
                place = owner * (np.int64(1) << 40) + at
                spot = np.searchsorted(low, place, "right") - 1
                bare = np.ones(len(place), bool) if not len(low) else (spot < 0) | (high[np.maximum(spot, 0)] < place + K)
                both = bare + np.uint8(2) * many
                cut = np.searchsorted(owner, np.arange(b.num_rows + 1))
                flags = [both[s:e].tobytes() for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                refs = [(couple[open_] >> np.uint64(32)).astype(np.uint32) for *_, couple, open_ in pairs(owner, key, at, both, min_words, True)]
                refs = np.unique(np.concatenate([np.unique(r) for r in refs] or [np.zeros(0, np.uint32)])).tobytes()
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc", "key", "at", "total")), pa.array(flags, pa.binary()), pa.array([refs] + [None] * (b.num_rows - 1), pa.binary())], names=["doc", "key", "at", "total", "flags", "refs"])
        release()

    return held.join(ranges, "doc", "left").select("doc", "key", "at", "many", "total", "ranges").mapInArrow(run, "doc long, key binary, at binary, total binary, flags binary, refs binary")


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Ids of some documents and their packed seeds."""
    for whole in batches:
        for i in range(0, whole.num_rows, DOCS):
            b = whole.slice(i, DOCS)
            yield b.column("doc").to_numpy(), *_packed(b, key=np.uint64, at=np.int32, total=np.uint64, flags=np.uint8)


def contested(held: DataFrame, shared: Broadcast, min_words: int) -> DataFrame:
    """The numbers (``refs``) of couples that are open in a document while an earlier one holds them too. ``shared``: a bitmap of the open ones.

    Most open couples are of their earliest holder, so what :func:`missed` deals out is a small part.
    """
    n = shards_of(held.sparkSession)
    schema = "shard int, no binary, low binary, open binary, high binary"

    def folded(no: np.ndarray, doc: np.ndarray, highest: bool = False) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((doc, no))
        no, doc = no[order], doc[order]
        keep = np.append(no[1:] != no[:-1], True) if highest else np.append(True, no[1:] != no[:-1])
        return no[keep[: len(no)]], doc[keep[: len(no)]]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(parts: list) -> Iterator[pa.RecordBatch]:
            no, doc, open_ = (np.concatenate(c) for c in zip(*parts, strict=True))
            out = []
            for rows, side in ((folded(no, doc), 0), (folded(no[open_], doc[open_], True), 1)):
                out += [[s, *[None] * (2 * side), *r, *[None] * (2 - 2 * side)] for s, *r in _by_shard(rows[0].astype(np.uint64) << np.uint64(32), n, *rows)]
            for k in range(0, len(out), 128):
                yield _table(out[k : k + 128], schema)

        bits, parts, count = shared.value, [], 0
        for ids, owner, key, at, _, flags in _steps(batches):
            for first, _, couple, open_ in pairs(owner, key, at, flags, min_words):
                keep = marked(bits, couple)
                # sorted as one number; of a document once, open where it is so anywhere
                one = np.sort((couple[keep] >> np.uint64(32) << np.uint64(16)) + (owner[first[keep]] * 2 + open_[keep]).astype(np.uint64))
                one = one[np.append(one[1:] >> np.uint64(1) != one[:-1] >> np.uint64(1), True)[: len(one)]]
                parts.append(((one >> np.uint64(16)).astype(np.uint32), ids[(one >> np.uint64(1) & np.uint64(0x7FFF)).astype(np.int64)], (one & np.uint64(1)).astype(bool)))
                count += len(one)
                if count > 4 * HELD_COUPLES:
                    yield from packed(parts)
                    parts, count = [], 0
        if parts:
            yield from packed(parts)
        release()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches):
            no, low = folded(_meet(rows, "no", np.uint32), _meet(rows, "low", np.int64))
            open_, high = _meet(rows, "open", np.uint32), _meet(rows, "high", np.int64)
            yield _table([[np.unique(open_[high > low[np.searchsorted(no, open_)]]).tobytes()]], "refs binary")
        release()

    sent = held.select("doc", "key", "at", "total", "flags").mapInArrow(send, schema)
    return sent.repartition(n_shuffle(held.sparkSession), "shard").sortWithinPartitions("shard").mapInArrow(meet, "refs binary")


def steps(who: np.ndarray, size: np.ndarray, held: int = HELD_MATCHES) -> Iterator[tuple[int, int]]:
    """Ranges of rows (sorted by ``who``) of at most ``held`` in sum of sizes, or of one ``who``, whose rows stay together whatever the limit."""
    edge = np.append(np.flatnonzero(who[1:] != who[:-1]) + 1, len(who))
    total = np.append(0, np.cumsum(size))
    i = 0
    while i < len(who):
        k = int(np.searchsorted(total[edge], total[i] + held, "right")) - 1
        j = int(edge[max(k, int(np.searchsorted(edge, i, "right")))])
        yield i, j
        i = j


def missed(held: DataFrame, shared: Broadcast, min_words: int) -> DataFrame:
    """Packed matches of two seeds of a window with all earlier documents that hold both (where more than once, the last time), by shard of the document.

    Such a window has a seed that no row covers and one with many holders; ``shared``: a bitmap of the numbers of couples that :func:`contested` found. Documents with equal texts from one seed to the other count as the first of them.
    """
    spark = held.sparkSession
    n = shards_of(spark)
    schema = "shard int, key binary, place binary, at binary, size binary, other binary, off binary, inner binary, open binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for ids, owner, key, at, total, flags in _steps(batches):
            for first, other, couple, open_ in pairs(owner, key, at, flags, min_words):
                keep = np.flatnonzero(marked(bits, couple))
                if not len(keep):
                    continue
                order = keep[np.argsort(couple[keep], kind="stable")]  # what is neither open nor a document's last counts for nothing
                last = np.append((couple[order][1:] != couple[order][:-1]) | (owner[first[order]][1:] != owner[first[order]][:-1]), True)
                keep = np.sort(order[last | open_[order]])
                first, other, open_ = first[keep], other[keep], open_[keep]
                pick, size = np.unique(first, return_counts=True)
                shard = (W.mixed(key[first]) >> np.uint64(64 - (n.bit_length() - 1))).astype(np.int64) if n > 1 else np.zeros(len(first), np.int64)
                order = np.argsort(shard, kind="stable")
                first, other, open_ = first[order], other[order], open_[order]
                off = at[other] - at[first]
                inner = W.mixed((total[other] - total[first]) * powers(_INVERSE, int(at.max()) + 1)[at[first]] + off.astype(np.uint64))
                shard = shard[np.cumsum(size) - 1]
                order = np.argsort(shard, kind="stable")
                pick, size, shard = pick[order], size[order], shard[order]
                end = np.cumsum(size)
                flat = [key[pick], ids[owner[pick]], at[pick], size.astype(np.uint16)]
                lists = [(key[other] >> np.uint64(32)).astype(np.uint32), off.astype(np.int16), (inner >> np.uint64(32)).astype(np.uint32), open_]
                cut = np.append(np.flatnonzero(_heads(shard) == np.arange(len(shard))), len(shard))
                edge = np.append(0, end)[cut]
                out = [[int(shard[cut[k]]), *(c[cut[k] : cut[k + 1]].tobytes() for c in flat), *(c[edge[k] : edge[k + 1]].tobytes() for c in lists)] for k in range(len(cut) - 1)]
                for k in range(0, len(out), 128):
                    yield _table(out[k : k + 128], schema)
        release()

    def packed(a: np.ndarray, b: np.ndarray, u: np.ndarray, v: np.ndarray, doc: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((u, b, a))
        a, b, u, v = a[order], b[order], u[order], v[order]
        head = np.flatnonzero(_heads(a, b) == np.arange(len(a)))
        last = np.append(head[1:], len(a)) - 1
        d, s = doc[a[head]], doc[b[head]]
        x = [at[a[head]], at[a[head]] + u[head], at[a[head]] + u[last]]
        y = [at[b[head]], at[b[head]] + v[head], at[b[head]] + v[last]]
        cols = [np.tile(d, 3), np.tile(s, 3), np.concatenate(x).astype(np.int32), np.concatenate(y).astype(np.int32)]
        out = list(_by_shard(W.mixed(cols[0].view(np.uint64)), n, *cols))
        for k in range(0, len(out), 128):
            yield _table(out[k : k + 128], f"shard int, {_LINKS}")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches):
            key, doc, at = _meet(rows, "key", np.uint64), _meet(rows, "place", np.int64), _meet(rows, "at", np.int32)
            size, open_ = _meet(rows, "size", np.uint16), _meet(rows, "open", bool)
            other, off, inner = _meet(rows, "other", np.uint32), _meet(rows, "off", np.int16), _meet(rows, "inner", np.uint32)
            del rows[:]
            who_of = np.repeat(np.arange(len(key), dtype=np.uint32), size)
            slices = max(1, -(-len(who_of) // HELD_MATCHES))
            slice_of = ((W.mixed(key) & np.uint64(0xFFFF)) * np.uint64(slices) >> np.uint64(16)).astype(np.int64)
            for no in range(slices):  # a seed's rows are in one
                part = np.flatnonzero(slice_of[who_of] == no)
                who = who_of[part].astype(np.int64)
                couple = W.mixed(key[who] + other[part] * _BASE)
                order = np.lexsort((at[who], doc[who], couple))
                couple, who, part = couple[order], who[order], part[order]
                own = _heads(couple, doc[who])
                last = np.flatnonzero(np.append(own[1:] != own[:-1], True)[: len(own)])
                order = last[np.lexsort((last, inner[part[last]], couple[last]))]
                source = np.zeros(len(who), bool)
                source[order[_heads(couple[order], inner[part[order]]) == np.arange(len(order))]] = True
                before = np.concatenate([[0], np.cumsum(source)])  # sources before each row
                rank = np.flatnonzero(source)
                start, own = before[_heads(couple)], before[own]
                now = np.flatnonzero(open_[part] & (own > start))
                now = now[np.argsort(who[now], kind="stable")]
                for i, j in steps(who[now], own[now] - start[now]):
                    many = (own - start)[now[i:j]]
                    a = np.repeat(now[i:j], many)
                    src = rank[np.repeat(own[now[i:j]] - 1 + np.cumsum(many) - many, many) - np.arange(len(a))]
                    yield from packed(who[a], who[src], off[part[a]], off[part[src]], doc, at)
        release()

    sent = held.select("doc", "key", "at", "total", "flags").mapInArrow(send, schema)
    return sent.repartition(n_shuffle(spark), "shard").sortWithinPartitions("shard").mapInArrow(meet, f"shard int, {_LINKS}")


_CHAIN = "doc long, src long, x binary, y binary, x0 int, x1 int, y0 int, y1 int, run int"


def chains(matches: DataFrame, runs: DataFrame | None, min_words: int) -> DataFrame:
    """A row for each chain that can still reach ``min_words`` once extended, and for each equal run (of ``run`` words)."""
    margin = K + WINDOW
    k = min(K, min_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(d, s, cx, cy, size):
            return [int(d), int(s), cx.tobytes(), cy.tobytes(), max(0, int(cx[0]) - margin), int(cx[-1]) + K + margin, max(0, int(cy[0]) - margin), int(cy[-1]) + K + margin, size]

        for rows in _grouped(batches):
            long = [r for r in rows if r["n"] is not None]
            rows = [r for r in rows if r["n"] is None]
            size = _meet(long, "n", np.int32)
            doc, x, y = spread(size, _meet(long, "doc", np.int64), _meet(long, "x", np.int32), _meet(long, "y", np.int32))
            out = []
            for d, s, i, j, n in zip(*(c.tolist() for c in neighbours(doc, np.repeat(_meet(long, "src", np.int64), size), x, y)), strict=True):
                ends = np.array([0, n + min_words - 1 - k], np.int32)
                out.append(row(d, s, ends + np.int32(i), ends + np.int32(j), n + min_words - 1))
            doc, src = _meet(rows, "doc", np.int64), _meet(rows, "src", np.int64)
            x, y = _meet(rows, "x", np.int32), _meet(rows, "y", np.int32)
            order = np.lexsort((y, x, src, doc))
            doc, src, x, y = doc[order], src[order], x[order], y[order]
            head = _heads(doc, src, x, y)
            keep = head == np.arange(len(doc))
            doc, src, x, y = doc[keep], src[keep], x[keep], y[keep]
            head = _heads(doc, src)
            cut = np.append(np.flatnonzero(head == np.arange(len(doc))), len(doc))
            plain = single_chains(x, y, cut)
            far = x[cut[1:] - 1] - x[cut[:-1]] + K + 2 * margin >= min_words
            for g in np.flatnonzero(far).tolist():
                s, e = cut[g], cut[g + 1]
                if plain[g]:
                    out.append(row(doc[s], src[s], x[s:e], y[s:e], 0))
                    continue
                for c in chain(x[s:e], y[s:e]):
                    cx, cy = x[s:e][c], y[s:e][c]
                    if cx[-1] - cx[0] + K + 2 * margin >= min_words:
                        out.append(row(doc[s], src[s], cx, cy, 0))
            for i in range(0, len(out), 512):
                yield _table(out[i : i + 512], _CHAIN)
        release()

    both = matches.select("*", F.lit(None).cast("binary").alias("n"))
    both = both.unionByName(runs) if runs is not None else both
    return both.repartition(n_shuffle(matches.sparkSession), "shard").sortWithinPartitions("shard").mapInArrow(run, _CHAIN)


_PASSAGE = "doc_id long, source_id long, start_word int, end_word int, source_start int, source_end int, n_equal int"


def find_passages(docs: DataFrame, *, min_words: int = 50, identity: float = 0.8) -> DataFrame:
    """One row for each passage of a document that an earlier one holds too, exactly or nearly: both ids, word ranges, and equal words."""
    ws = Workspace(docs.sparkSession, "passages")
    docs, no = apart(docs.select("doc_id", "text"), ws)
    if no:
        ids = docs.select(F.col(no).alias("no"), F.col("doc_id").alias("id"))
        docs = docs.select(F.col(no).alias("doc_id"), "text")
    matches = ws.put(seed_matches(docs, min_words), "matches")
    numbers_of = matches.where("refs is not null")
    shared = docs.sparkSession.sparkContext.broadcast((sized_bitmap(numbers_of, 64), bitmap(numbers_of.select(F.col("hot").alias("refs")), BITS)))  # a false hit of the second may change which couple is taken
    runs = run_matches(docs, shared, min_words)
    found = chains(matches.where("refs is null").drop("refs", "hot"), runs, min_words).withColumn("pair", F.monotonically_increasing_id())
    found = ws.put(found, "chains")
    ws.drop("matches")
    held = ws.put(shared_seeds(docs, shared, min_words), "shared")
    shared.destroy()
    rows = ws.put(settled(docs, found, min_words, identity), "rows")
    ws.drop("chains")
    held = ws.put(uncovered(held, rows, min_words), "seeds")
    ws.drop("shared")
    starts = docs.sparkSession.sparkContext.broadcast(sized_bitmap(held.where("refs is not null"), 16))
    numbers_of = ws.put(contested(held, starts, min_words), "contested")
    starts.destroy()
    starts = docs.sparkSession.sparkContext.broadcast(sized_bitmap(numbers_of, 16))
    links = missed(held, starts, min_words)
    more = ws.put(chains(links, None, min_words).withColumn("pair", F.monotonically_increasing_id()), "more")
    starts.destroy()
    ws.drop("seeds", "contested")
    rows = rows.unionByName(settled(docs, more, min_words, identity))
    ranges = [f.split()[0] for f in _PASSAGE.split(", ")][2:]
    inside = " and ".join(f"q.{c} {sign} r.{c}" for c, sign in zip(ranges, ("<=", ">=", "<=", ">="), strict=False))
    size = "({0}.end_word - {0}.start_word + {0}.source_end - {0}.source_start)"
    other = f"({size.format('q')} > {size.format('r')} or {size.format('q')} = {size.format('r')} and q.n_equal > r.n_equal)"
    all_of = rows.groupBy("doc_id", "source_id").agg(F.collect_set(F.struct(*ranges)).alias("all"))
    out = all_of.select("doc_id", "source_id", F.expr(f"inline(filter(all, r -> not exists(all, q -> {inside} and {other})))"))
    if not no:
        return out
    for c in ("doc_id", "source_id"):
        out = out.join(ids.select(F.col("no").alias(c), F.col("id").alias(f"_{c}")), c).drop(c).withColumnRenamed(f"_{c}", c)
    return out.select("doc_id", "source_id", *ranges)


def _mark(ids: np.ndarray) -> np.ndarray:
    return (W.mixed(ids.view(np.uint64)) >> np.uint64(32)).astype(np.uint32)


def settled(docs: DataFrame, found: DataFrame, min_words: int, identity: float) -> DataFrame:
    """Passages of the chains that keep ``min_words`` and ``identity`` once aligned with both texts."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _table([[np.unique(_mark(np.concatenate([b.column(c).to_numpy() for c in ("doc", "src")]))).tobytes()]], "refs binary")

    asked = docs.sparkSession.sparkContext.broadcast(sized_bitmap(found.select("doc", "src").mapInArrow(marks, "refs binary"), 16))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Without most texts that no chain needs."""
        for b in batches:
            ids = b.column("doc_id").cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)
            yield b.filter(pa.array(marked(asked.value, _mark(ids).astype(np.uint64) << np.uint64(32))))

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, w in _rows(some(batches)):
            low = (w.hashes >> np.uint64(32)).astype(np.uint32)
            keep = np.flatnonzero(w.counts >= min_words)
            if len(keep):
                packed = [low[w.first[i] : w.first[i + 1]].tobytes() for i in keep]
                yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(packed, pa.binary())], names=["id", "words"])

    texts = docs.select("doc_id", "text").mapInArrow(numbers, "id long, words binary")
    one = F.struct(F.lit(0).alias("side"), F.col("doc").alias("id"), F.col("x0").alias("low"), F.col("x1").alias("high"))
    two = F.struct(F.lit(1).alias("side"), F.col("src").alias("id"), F.col("y0").alias("low"), F.col("y1").alias("high"))
    ranges = found.select("pair", F.explode(F.array(one, two)).alias("a")).select("pair", "a.*")
    parts = ranges.join(texts, "id").select("pair", "side", F.expr("substring(words, 4 * low + 1, 4 * (high - low))").alias("words"))
    p, k = n_shuffle(docs.sparkSession), min(K, min_words)
    extra = found.select("pair", F.lit(-1).alias("side"), F.lit(None).cast("binary").alias("words"), "doc", "src", "x", "y", "x0", "y0", "run")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("doc", "long"), ("src", "long"), ("x", "binary"), ("y", "binary"), ("x0", "int"), ("y0", "int"), ("run", "int"))]
    dealt = extra.unionByName(parts.select("pair", "side", "words", *none)).repartition(p, "pair").sortWithinPartitions("pair", "side")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[dict]):
            r = rows[0]
            sides = {q["side"]: q["words"] for q in reversed(rows)}
            if r["side"] != -1 or 0 not in sides or 1 not in sides:
                return None
            a, b = np.frombuffer(sides[0], np.uint32), np.frombuffer(sides[1], np.uint32)
            x, y = np.frombuffer(r["x"], np.int32) - r["x0"], np.frombuffer(r["y"], np.int32) - r["y0"]
            if x[-1] + k > len(a) or y[-1] + k > len(b):
                return None  # of another row with the same id
            s, e, t, f, m = align(a, b, x, y, k)
            if e - s < min_words or m < identity * max(e - s, f - t):
                s, t, m = int(x[0]), int(y[0]), r["run"]
                e, f = s + m, t + m
                if not m or not np.array_equal(a[s:e], b[t:f]):
                    return None
            return [None if r["doc"] == LAST else r["doc"], None if r["src"] == LAST else r["src"], s + r["x0"], e + r["x0"], t + r["y0"], f + r["y0"], m]

        out, held = [], []
        for batch in batches:
            for r in batch.to_pylist():
                if held and held[0]["pair"] != r["pair"]:
                    out.append(done(held))
                    held = []
                held.append(r)
            out = [o for o in out if o]
            if len(out) > 1000:
                yield _table(out, _PASSAGE)
                out = []
        if held:
            out.append(done(held))
        out = [o for o in out if o]
        if out:
            yield _table(out, _PASSAGE)

    return dealt.mapInArrow(settle, _PASSAGE)
