"""Recordings as a data source: WAV files of any length, read by ranges of bytes and written all or none.

``read`` gives a row for each piece of a recording, at most ``chunk_sec`` long, so neither a file nor a task has to hold a whole one. A file
is cut into ranges of ``range_mb``, each of which needs the header and its own bytes only; a partition is a run of ranges of ``task_mb``, in which
every range also counts for what opening a file costs, so small files and small ranges share tasks.
"""

from __future__ import annotations

import fnmatch
import struct
import uuid
from collections.abc import Iterator
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "recordings"
PIECES = "path string, sample_rate int, channels int, first long, n int, samples array<float>, error string"
ARROW = pa.schema([("path", pa.string()), ("sample_rate", pa.int32()), ("channels", pa.int32()), ("first", pa.int64()), ("n", pa.int32()), ("samples", pa.list_(pa.float32())), ("error", pa.string())])
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
UNKNOWN = 0xFFFFFFFF  # a size that its field can't hold
OPEN = 1 << 16  # bytes that a range counts for beside its own
BATCH_ROWS, BATCH_BYTES = 1024, 1 << 20
MOVERS = 32


def _system(path: str) -> tuple[files.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return files.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return files.LocalFileSystem(), path


@dataclass
class Header:
    kind: int
    channels: int
    rate: int
    width: int  # bytes of a sample
    start: int  # of the samples in the file
    size: int  # their bytes

    @property
    def frame(self) -> int:
        return self.channels * self.width


def header(f, size: int) -> Header:
    """Where a WAV file (RIFF, or RF64 for more than 4 GB) keeps its samples, and in which form; chunks of other kinds are skipped."""
    top = f.read(12)
    if len(top) < 12 or top[:4] not in (b"RIFF", b"RF64") or top[8:] != b"WAVE":
        raise ValueError("not a WAV file")
    at, found, long_size = 12, None, None
    while at + 8 <= size:
        f.seek(at)
        name, n = struct.unpack("<4sI", f.read(8))
        if name == b"ds64":
            long_size = struct.unpack("<Q", f.read(24)[8:16])[0]
        elif name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", f.read(16))
            if kind == EXTENSIBLE:
                kind = struct.unpack("<H", f.read(10)[8:10])[0]
            found = (kind, channels, rate, bits // 8)
            if kind not in (PCM, FLOAT) or found[3] not in ((1, 2, 3, 4) if kind == PCM else (4, 8)) or not channels or not rate:
                raise ValueError(f"samples of kind {kind} with {bits} bits are not supported")
        elif name == b"data":
            if not found:
                raise ValueError("samples without a format")
            n = (long_size if long_size is not None else size) if n == UNKNOWN else n
            return Header(*found, at + 8, min(n, size - at - 8))
        at += 8 + n + n % 2
    raise ValueError("no samples")


def decoded(raw: bytes, h: Header) -> np.ndarray:
    """Mono samples between -1 and 1."""
    if h.kind == FLOAT:
        x = np.frombuffer(raw, "<f4" if h.width == 4 else "<f8").astype(np.float64)
    elif h.width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif h.width == 3:
        low = np.zeros((len(raw) // 3, 4), np.uint8)
        low[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        x = low.view("<i4").ravel() / 2147483648.0
    else:
        x = np.frombuffer(raw, "<i2" if h.width == 2 else "<i4") / (32768.0 if h.width == 2 else 2147483648.0)
    return x.reshape(-1, h.channels).mean(axis=1)


@dataclass
class Range:
    """Ranges of a file that follow each other, all from ``first`` to ``stop``."""

    path: str
    size: int
    first: int
    stop: int


@dataclass
class Share(InputPartition):
    ranges: list[Range]


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.pattern = options.get("pattern", "*.wav")
        self.recursive = str(options.get("recursive", "false")).lower() == "true"
        self.range = max(1, int(float(options.get("range_mb", 64)) * 2**20))
        self.chunk_sec = float(options.get("chunk_sec", 30))
        self.task = max(1, int(float(options.get("task_mb", 64)) * 2**20))

    def partitions(self) -> list[InputPartition]:
        """Ranges of the files' bytes; only names and sizes are read here."""
        system, root = _system(self.path)
        info = system.get_file_info(root)
        if info.type == files.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == files.FileType.File else system.get_file_info(files.FileSelector(root, recursive=self.recursive))
        named = sorted((i for i in found if i.type == files.FileType.File and (i is info or fnmatch.fnmatch(i.base_name, self.pattern))), key=lambda i: i.path)
        shares: list[Share] = []
        load = self.task
        for i in named:
            for at in range(0, max(i.size, 1), self.range):
                stop = min(at + self.range, i.size)
                if load >= self.task:
                    shares.append(Share([]))
                    load = 0
                held = shares[-1].ranges
                if held and at and held[-1].path == i.path:
                    held[-1].stop = stop
                else:
                    held.append(Range(i.path, i.size, at, stop))
                load += stop - at + OPEN
        return shares

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        system, _ = _system(self.path)
        rows, held = [], 0
        for part in partition.ranges:
            for row in self._rows(system, part):
                rows.append(row)
                held += row[5].nbytes if row[5] is not None else 0
                if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _rows(self, system: files.FileSystem, part: Range) -> Iterator[tuple]:
        with system.open_input_file(part.path) as f:
            try:
                h = header(f, part.size)
            except (ValueError, struct.error) as e:
                if not part.first:  # once for each file
                    yield part.path, None, None, None, None, None, f"{type(e).__name__}: {e}"
                return
            frames = h.size // h.frame
            place = lambda at: min(frames, max(0, -(-(at - h.start) // h.frame)))
            step = max(1, int(self.chunk_sec * h.rate))
            for start in range(part.first, part.stop, self.range):
                end = min(start + self.range, part.stop)
                first, stop = place(start), place(end) if end < part.size else frames
                for at in range(first, stop, step):
                    n = min(step, stop - at)
                    f.seek(h.start + at * h.frame)
                    yield part.path, h.rate, h.channels, at, n, decoded(f.read(n * h.frame), h).astype(np.float32), None
            if not part.first and not frames:
                yield part.path, h.rate, h.channels, 0, 0, np.zeros(0, np.float32), None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class Writer(DataSourceArrowWriter):
    """PCM16 files ``name`` of ``samples``. Tasks write below a hidden folder of the job's; the driver moves all files into place once all tasks are done."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.rate, self.overwrite = options["path"].rstrip("/"), int(options.get("rate", 16000)), overwrite
        self.parts = f".parts-{uuid.uuid4().hex[:12]}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from cadence.sources.providers import wav_bytes

        system, root = _system(self.path)
        folder = f"{root}/{self.parts}/{uuid.uuid4().hex}"  # one for each attempt of a task
        names: list[str] = []
        for b in iterator:
            for i in range(b.num_rows):
                name, x = b.column("name")[i].as_py(), b.column("samples")[i]
                if not name or "/" in name or name.startswith("."):
                    raise ValueError(f"not a file name: {name!r}")
                if not names:
                    system.create_dir(folder, recursive=True)
                with system.open_output_stream(f"{folder}/{name}") as f:
                    f.write(wav_bytes(x.values.to_numpy(zero_copy_only=False) if x.is_valid else [], self.rate))
                names.append(name)
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _system(self.path)
        pairs = [(m.folder, n) for m in messages if m for n in m.names]
        names = [n for _, n in pairs]
        if len(set(names)) < len(names):
            raise ValueError("a name is written twice")
        there = {i.base_name for i in system.get_file_info(files.FileSelector(root, allow_not_found=True)) if i.type == files.FileType.File}
        if not self.overwrite and there & set(names):
            raise FileExistsError(f"{len(there & set(names))} of the files are there already")
        moved: list[str] = []

        def move(pair: tuple[str, str]) -> None:
            system.move(f"{pair[0]}/{pair[1]}", f"{root}/{pair[1]}")
            moved.append(pair[1])

        with ThreadPoolExecutor(MOVERS) as pool:
            waiting = [pool.submit(move, p) for p in pairs]
            wait(waiting, return_when=FIRST_EXCEPTION)
            for w in waiting:
                w.cancel()
        failed = next((w.exception() for w in waiting if not w.cancelled() and w.exception()), None)
        if failed:
            for name in moved:
                if name not in there:
                    system.delete_file(f"{root}/{name}")
            raise failed
        self._clean()

    def abort(self, messages: list[Written | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        system, root = _system(self.path)
        if system.get_file_info(f"{root}/{self.parts}").type == files.FileType.Directory:
            system.delete_dir(f"{root}/{self.parts}")


class Recordings(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return PIECES

    def reader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if not {"name", "samples"} <= set(schema.names):
            raise ValueError("columns name and samples are wanted")
        return Writer(dict(self.options), overwrite)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """``path, sample_rate, channels, first, n, samples, error``: pieces of the recordings below ``path``, mono; a file that can't be read is one row that says why.

    Options: ``pattern``, ``recursive``, ``range_mb`` (bytes of a range), ``task_mb`` (bytes of a partition), ``chunk_sec`` (longest piece).
    """
    spark.dataSource.register(Recordings)
    return spark.read.format(NAME).options(**options).load(path)


def write(df: DataFrame, path: str, *, samples: str = "samples", name: str = "name", rate: int = 16000, overwrite: bool = False) -> None:
    """A PCM16 file below ``path`` for each row, all of them or none; names that are there already or come twice are an error, unless ``overwrite`` replaces those that are there."""
    df.sparkSession.dataSource.register(Recordings)
    df.selectExpr(f"CAST(`{name}` AS STRING) AS name", f"CAST(`{samples}` AS ARRAY<FLOAT>) AS samples").write.format(NAME).option("rate", rate).mode("overwrite" if overwrite else "append").save(path)


def durations(pieces: DataFrame) -> DataFrame:
    """``path, sample_rate, n, seconds`` of whole recordings."""
    from pyspark.sql import functions as F

    return pieces.where("error IS NULL").groupBy("path", "sample_rate").agg(F.sum("n").alias("n")).withColumn("seconds", F.col("n") / F.col("sample_rate"))
