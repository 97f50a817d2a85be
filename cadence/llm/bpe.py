"""SentencePiece BPE by a merge-type prefix table.

Every prefix of a chunk has exactly one last token in its encoding. An
automaton lists the tokens that end at each position; the last token is the
one among them that is compatible with the last token of the prefix it leaves,
that is, merging the two tokens' text alone gives back the same two tokens.
Ids are read off backwards. The work is linear in the text, whatever the length
of a chunk, where repeated merging is not.

No piece holds a space mark after another character, so a text splits
before every run of marks that follows something else, and equal chunks are
encoded once for each worker. Characters without a piece never merge and
become byte tokens.

Defined cases: a null text counts as empty; the empty text is the end id only;
rows that repeat give rows that repeat; ids are carried along, null included. Each row is encoded by itself, so there are no
ties; texts of any length are whole, in memory that grows with one text; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cadence.llm.common import caches, release

MARK = "▁"
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Entries of a worker's tables of chunks and of pairs, and the longest chunk kept there.
MAX_CHUNKS, MAX_PAIRS, MAX_KEPT = 300_000, 500_000, 96


class PrefixTable:
    """The encoder of one model file."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = self.lib.get_piece_size()
        usual = [i for i in range(n) if not (self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_byte(i) or self.lib.is_unused(i))]
        self.id_of = {self.lib.id_to_piece(i): i for i in usual}
        self.score = {i: self.lib.get_score(i) for i in usual}
        self.byte = [self.lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.end = self.lib.eos_id()
        self.text = {i: p for p, i in self.id_of.items()}
        if any(MARK in p.lstrip(MARK) for p in self.id_of):
            raise ValueError("a piece of this model goes across words")
        # A piece that its own text doesn't encode to can't be anyone's last token.
        reached = [p for p in self.id_of if self.merge(p) == [p]]
        self.auto = ahocorasick.Automaton()
        for p in reached:
            self.auto.add_word(p, (len(p), self.id_of[p]))
        self.auto.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.byte_of = {i: b for b, i in enumerate(self.byte)}
        self.said = _Memo(lambda tail: " ".join(map(str, self.encode_chunk(MARK + tail))))
        self.meant = _Memo(lambda part: self.decode_ids(list(map(int, part.split(" ")))))

    def merge(self, text: str) -> list[str]:
        """Plain merging by best score, leftmost first, for the short texts of pairs."""
        part, right, left = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        n, heap = len(part), []

        def offer(i: int) -> None:
            if i >= 0 and (j := right[i]) < n and (token := self.id_of.get(part[i] + part[j])) is not None:
                heappush(heap, (-self.score[token], i, part[i], part[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b = heappop(heap)
            if part[i] != a or (j := right[i]) >= n or part[j] != b:
                continue
            part[i], part[j], right[i] = a + b, "", right[j]
            if right[i] < n:
                left[right[i]] = i
            offer(left[i])
            offer(i)
        return [p for p in part if p]

    def fits(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            x, y = self.text[a], self.text[b]
            known = self.merge(x + y) == [x, y]
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            self.pairs[(a, b)] = known
        return known

    def encode_chunk(self, chunk: str) -> list[int]:
        n = len(chunk)
        last, size = [-1] * (n + 1), [1] * (n + 1)  # of each prefix: its last token (-1: none, or a character without a piece), and that token's length
        settled, known, fits = -1, self.pairs.get, self.fits
        for at, (length, token) in self.auto.iter(chunk):  # by end, the longest first
            if at == settled:
                continue
            before = last[at + 1 - length]
            if before >= 0:
                fit = known((before, token))
                if not (fits(before, token) if fit is None else fit):
                    continue
            last[at + 1], size[at + 1], settled = token, length, at
        out, at = [], n
        while at:
            if last[at] < 0:
                out.extend(self.byte[b] for b in reversed(chunk[at - 1].encode()))
            else:
                out.append(last[at])
            at -= size[at]
        return out[::-1]

    def decode_ids(self, ids: list[int]) -> str:
        """The text of these ids inside a longer sequence; broken byte runs give replacement characters."""
        out, run = [], bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                run.append(b)
                continue
            if run:
                out.append(bytes(run).decode(errors="replace"))
                run.clear()
            out.append(self.text.get(i, ""))
        if run:
            out.append(bytes(run).decode(errors="replace"))
        return "".join(out).replace(MARK, " ")

    def parts(self, text: str) -> list[str]:
        """The ids of each chunk as text, in order, without the end id."""
        if not text:
            return []
        if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
            tails = [c[1:] for c in _CHUNK.findall(MARK + text.replace(" ", MARK))]
        else:
            tails = text.split(" ")
        return list(map(self.said.__getitem__, tails))

    def encode(self, text: str) -> list[int]:
        return [int(i) for part in self.parts(text) for i in part.split(" ")] + [self.end]

    def decode(self, parts: list[str]) -> str:
        """The library's decode() of all ids; the mark that encoding put first is taken off."""
        text = "".join(map(self.meant.__getitem__, parts))
        return text[1:] if text[:1] == " " else text


class _Memo(dict):
    """Keeps what ``make`` returns, up to MAX_CHUNKS short keys; then it starts anew."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key: str) -> str:
        value = self.make(key)
        if len(key) <= MAX_KEPT:
            if len(self) >= MAX_CHUNKS:
                self.clear()
            self[key] = value
        return value


_tables: dict[str, PrefixTable] = {}


def table(model_file: str) -> PrefixTable:
    """One for each worker process and model."""
    if model_file not in _tables:
        _tables[model_file] = PrefixTable(model_file)
    return _tables[model_file]


def _forget() -> None:
    for t in _tables.values():
        t.said.clear()
        t.meant.clear()
        t.pairs.clear()


caches.append(_forget)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """Where the public vocabulary file stands on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encode_frame(docs: DataFrame, model_file: str, *, with_ids: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for each row, and with ``with_ids`` also ``ids, decoded``; one pass, no shuffle."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table(model_file)
        names = [f.split()[0] for f in schema.split(", ")]
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                cols: list[list] = [[] for _ in names[1:]]
                for text in part.column("text").to_pylist():
                    chunks = t.parts(text or "")
                    said = " ".join([*chunks, str(t.end)])
                    decoded = t.decode(chunks)
                    row = [said.count(" ") + 1, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()]
                    if with_ids:
                        row += [np.array(said.split(" "), np.int32), decoded]
                    for c, x in zip(cols, row, strict=True):
                        c.append(x)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=False))], names=names)
        release(keep=True)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
