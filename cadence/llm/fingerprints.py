"""Document fingerprints: a canonical exact digest.

A text is brought to NFKC, case-folded, brought to NFKC again, and its runs of
white space become one space. The fingerprint is the 128-bit xxh3 of that form.
Inside buckets of equal digests the canonical bytes themselves are compared:
texts that differ although their digests are equal get a numbered suffix.
Likeness of two exact fingerprints is 1 where they are equal and 0 elsewhere.

Defined cases: null counts as the empty text; rows are ordered by id, then by a
digest of the text, null ids last; the last row's next is the first; a table of
one row is its own next; an empty table gives an empty result; repeated
rows give repeated results; texts of any length are whole, one text in memory at a time beside its edited form; columns other than ``doc_id`` and ``text`` are not read,
whatever their names.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadence.llm.common import Workspace, n_shuffle

_LAST = 2**63 - 1


def canonical(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split())


def digest(form: str) -> bytes:
    return xxhash.xxh3_128_digest(form.encode("utf-8", "surrogatepass"))


def edit(text: str, following: str) -> str:
    """The last half of ``text`` (rounded down) replaced by as much of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_frame(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` for every row, with the byte comparison inside buckets."""
    ws = Workspace(docs.sparkSession, "fp")
    found = ws.put(_scan(docs).select("doc_id", "_raw", "_fp"), "scan")
    return _settle(docs, found, ws).select("doc_id", F.col("_name").alias("fingerprint"))


def _scan(docs: DataFrame) -> DataFrame:
    """One pass without a shuffle. Where a row's neighbour in its file is its next by id, the edited text is made here."""
    schema = "doc_id long, _key long, _raw binary, _fp binary, n_chars long, _next_key long, _next_raw binary, _sha binary, _efp binary, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]

        def rows():
            held = None
            for b in batches:
                for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    text = text or ""
                    form = canonical(text)
                    now = (doc_id, _LAST if doc_id is None else doc_id, xxhash.xxh3_128_digest(text.encode()), digest(form), text, form)
                    if held:
                        yield described(held, now)
                    held = now
            if held:
                yield [*held[:4], len(held[4]), *[None] * 6]

        def described(a, b):
            sha, efp, near_edited, near_next = compared(a[4], a[5], b[4], b[5])
            return [*a[:4], len(a[4]), b[1], b[2], sha, efp, near_edited, near_next]

        part: list[list] = []
        for row in rows():
            part.append(row)
            if len(part) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names=names)
                part = []
        if part:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def compared(text: str, form: str, following: str, following_form: str) -> tuple[bytes, bytes, float, float]:
    edited = edit(text, following)
    edited_form = canonical(edited)
    return hashlib.sha256(edited.encode()).digest(), digest(edited_form), float(edited_form == form), float(following_form == form)


def _settle(docs: DataFrame, found: DataFrame, ws: Workspace) -> DataFrame:
    """``found`` with ``_name``: the digest in hexadecimal, with a suffix where bytes differ inside a bucket.

    Only texts of buckets with several rows are fetched. Grouping by digest and
    canonical text compares bytes and folds copies before the shuffle, so a
    group of copies of any size sends one row from each task. Raw variants are listed for clashing digests alone.
    """
    many = ws.put(found.groupBy("_fp").count().where("count > 1").select("_fp"), "many")
    ids = ws.put(found.join(many, "_fp", "left_semi").select(F.coalesce("doc_id", F.lit(_LAST)).alias("_key")).distinct(), "bucketed")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("_key"), "text").join(ids, "_key", "left_semi")

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                form = [canonical(t or "") for t in b.column("text").slice(i, 500).to_pylist()]
                raw = [xxhash.xxh3_128_digest((t or "").encode()) for t in b.column("text").slice(i, 500).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary()), pa.array([digest(f) for f in form], pa.binary()), pa.array([f.encode() for f in form], pa.binary())], names=["_raw", "_fp", "_form"])

    each = texts.mapInArrow(forms, "_raw binary, _fp binary, _form binary")
    clash = each.select("_fp", "_form").distinct().groupBy("_fp").count().where("count > 1").select("_fp")
    clash, name = ws.put(clash, "clashing"), F.lower(F.hex("_fp"))
    if clash.isEmpty():
        return found.withColumn("_name", name)
    several = each.join(clash, "_fp", "left_semi").distinct()
    no = F.row_number().over(Window.partitionBy("_fp").orderBy("_form"))  # different texts of one 128-bit digest
    numbered = several.select("_fp", "_form").distinct().withColumn("_no", no).where("_no > 1")
    named = ws.put(several.join(numbered, ["_fp", "_form"]).select("_fp", "_raw", "_no"), "clashes")
    found = found.join(named, ["_fp", "_raw"], "left")
    return found.withColumn("_name", F.concat(name, F.when(F.col("_no").isNull(), "").otherwise(F.concat(F.lit("-"), F.col("_no").cast("string")))))


def _following(found: DataFrame, ws: Workspace) -> DataFrame:
    """``found`` in order of id, with ``_to_key, _to_raw`` of the row that follows.

    Rows are dealt to ranges of ids and sorted there. A range's last row takes
    the first of the next range; only those first rows, one for each task, come
    to the driver.
    """
    n = max(1, n_shuffle(found.sparkSession))
    dealt = found.repartitionByRange(n, "_key", "_raw").sortWithinPartitions("_key", "_raw")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema) + ", _to_key long, _to_raw binary, _part int, _head boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, first = TaskContext.get().partitionId(), None, True
        for b in batches:
            if not b.num_rows:
                continue
            if held is not None:
                yield closed(held, b.column("_key")[0], b.column("_raw")[0], part, first)
                first = False
            held = b
        if held is not None:
            yield closed(held, None, None, part, first)

    def closed(b, key, raw, part, first):
        to_key = pa.concat_arrays([b.column("_key").slice(1), pa.array([key.as_py() if key is not None else None], pa.int64())])
        to_raw = pa.concat_arrays([b.column("_raw").slice(1), pa.array([raw.as_py() if raw is not None else None], pa.binary())])
        head = pa.array([first and i == 0 for i in range(b.num_rows)])
        return pa.RecordBatch.from_arrays([*b.columns, to_key, to_raw, pa.array([part] * b.num_rows, pa.int32()), head], names=[*b.schema.names, "_to_key", "_to_raw", "_part", "_head"])

    out = ws.put(dealt.mapInArrow(run, schema), "ordered")
    heads = sorted(((r["_part"], r["_key"], bytes(r["_raw"])) for r in out.where("_head").select("_part", "_key", "_raw").collect()), key=lambda r: r[0])
    if not heads:
        return out.drop("_part", "_head")
    after = [(p, *heads[(i + 1) % len(heads)][1:]) for i, (p, _, _) in enumerate(heads)]
    joints = out.sparkSession.createDataFrame([(p, k, bytearray(r)) for p, k, r in after], "_part int, _k long, _r binary")
    out = out.join(F.broadcast(joints), "_part", "left")  # a row for each task
    return out.withColumn("_to_key", F.coalesce("_to_key", "_k")).withColumn("_to_raw", F.coalesce("_to_raw", "_r")).drop("_part", "_head", "_k", "_r")


def _made_late(docs: DataFrame, rows: DataFrame, ws: Workspace) -> DataFrame:
    """The rows whose next row by id stood elsewhere, with what ``_scan`` could not make."""
    rows = ws.put(rows.select("doc_id", "_key", "_raw", "_fp", "n_chars", "_to_key", "_to_raw"), "late")
    need = rows.select("_key").union(rows.select(F.col("_to_key").alias("_key"))).distinct()
    need = ws.put(need, "needed")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("_key"), "text").join(need, "_key", "left_semi")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_key"), pa.array([xxhash.xxh3_128_digest(t.encode()) for t in texts], pa.binary()), pa.array(texts, pa.string())], names=["_key", "_raw", "text"])

    texts = texts.mapInArrow(mark, "_key long, _raw binary, text string").dropDuplicates(["_key", "_raw"])
    both = rows.join(texts, ["_key", "_raw"]).join(texts.select(F.col("_key").alias("_to_key"), F.col("_raw").alias("_to_raw"), F.col("text").alias("_to")), ["_to_key", "_to_raw"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [compared(a, canonical(a), c, canonical(c)) for a, c in zip(b.column("text").to_pylist(), b.column("_to").to_pylist(), strict=True)]
            cols = [pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.binary(), pa.binary(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "_raw", "_fp", "n_chars")), *cols], names=["doc_id", "_raw", "_fp", "n_chars", "_sha", "_efp", "near_edited", "near_next"])

    return both.select("doc_id", "_raw", "_fp", "n_chars", "text", "_to").mapInArrow(compare, "doc_id long, _raw binary, _fp binary, n_chars long, _sha binary, _efp binary, near_edited double, near_next double")


def fingerprints_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text: see :func:`edit`.

    Texts cross no shuffle where files hold neighbouring ids together; the rows
    at the joints, or all rows of an unordered table, are joined by id.
    """
    ws = Workspace(docs.sparkSession, "fp")
    ordered = _following(ws.put(_scan(docs), "scan"), ws)
    right = F.col("_next_key").eqNullSafe(F.col("_to_key")) & F.col("_next_raw").eqNullSafe(F.col("_to_raw"))
    cols = ["doc_id", "_raw", "_fp", "n_chars", "_sha", "_efp", "near_edited", "near_next"]
    late = _made_late(docs, ordered.where(~right), ws).select(*cols)
    found = ws.put(ordered.where(right).select(*cols).unionByName(late), "found")
    ws.drop("scan", "ordered", "late", "needed")
    out = _settle(docs, found, ws)
    return out.select("doc_id", "n_chars", F.lower(F.hex("_sha")).alias("edited_sha256"), F.col("_name").alias("fingerprint"), F.lower(F.hex("_efp")).alias("edited_fingerprint"), "near_edited", "near_next")
