"""Scans and sinks. State tables are numbered commits, so a reader never meets half a write and no writer overwrites another's unseen."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.plans.schema import ALIGNER, BASELINES, SPEAKERS, TRACE
from cadence.sources import commits

BASELINES_STORED = T.StructType([*BASELINES.fields, T.StructField("max_n", T.IntegerType())])


_fs, exists = commits.fs, commits.exists


def scratch(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below ``spark.checkpoint.dir`` and read back. Where that is unset a temporary folder serves, in local mode only."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="cadence-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/cadence-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


# Scans


def training_metadata(spark: SparkSession, path: str, audio: str = "audio-path") -> DataFrame:
    """All columns but the audio, which is never read."""
    return spark.read.parquet(path).drop(audio)


def training_rows(spark: SparkSession, path: str, decode, *, n: int | None = None, audio: str = "audio-path") -> DataFrame:
    """Metadata with ``samples, sample_rate, error`` decoded by a provider; rows that fail carry the error and can be filtered."""
    from cadence.sources.providers import with_decoded

    rows = spark.read.parquet(path)
    rows = rows.limit(n) if n else rows
    return with_decoded(rows.withColumn("_bytes", F.col(f"`{audio}`.bytes")).drop(audio), "_bytes", decode).drop("_bytes")


def file_counts(spark: SparkSession, path: str) -> DataFrame:
    """``file, n`` of a folder of Parquet files, by name."""
    rows = spark.read.parquet(path)
    return rows.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n")).orderBy("file")


def audio_files(spark: SparkSession, path: str, *, pattern: str = "*.wav", recursive: bool = False) -> DataFrame:
    """``path, content`` of matching files, each once."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "content").dropDuplicates(["path"])


def speaker_library(spark: SparkSession, files: dict[str, str], decode) -> DataFrame:
    """``speaker_id, samples, sample_rate, error`` of reference recordings by id."""
    from cadence.sources.providers import with_decoded

    whole = {who: str(_fs(spark, path)[1].makeQualified(_fs(spark, path)[0].getUri(), _fs(spark, path)[0].getWorkingDirectory()).toString()) for who, path in files.items()}
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    names = spark.createDataFrame(list(whole.items()), "speaker_id string, _p string")
    blobs = spark.read.format("binaryFile").load(sorted(set(whole.values()))).select("path", "content")
    rows = blobs.join(F.broadcast(names), plain("path") == plain("_p"))  # a row for each file that was named
    return with_decoded(rows.select("speaker_id", "content"), "content", decode).drop("content")


_BROKEN = re.compile(r"not a Parquet file|footer|UNABLE_TO_INFER_SCHEMA|Unable to infer schema", re.I)

#: The version of each table that this session has read or written last; a write starts from it.
_seen: dict[tuple[str, str], int] = {}


def _key(spark: SparkSession, path: str) -> tuple[str, str]:
    return spark.sparkContext.applicationId, path.rstrip("/")


def versioned_read(spark: SparkSession, path: str, schema: T.StructType, *, version: int | None = None) -> DataFrame:
    """The newest version, or one that is kept. A missing table is empty. One whose files are broken or gone is kept aside, each time under a new ``.bak`` name, and read as empty; any other error is raised."""
    number, folder = commits.latest(spark, path)
    if version is not None:
        return spark.read.schema(schema).parquet(f"{path}/{commits.versions(spark, path)[version]}")
    _seen[_key(spark, path)] = number
    if folder is None:
        return spark.createDataFrame([], schema)
    broken = not exists(spark, f"{path}/{folder}")
    if not broken:
        try:
            _ = spark.read.parquet(f"{path}/{folder}").schema  # reads footers only
        except Exception as e:
            if not _BROKEN.search(str(e)):
                raise
            broken = True
    if broken:
        fs, p = _fs(spark, path)
        fs.rename(p, _fs(spark, f"{path}.bak-{uuid.uuid4().hex[:8]}")[1])
        _seen[_key(spark, path)] = 0
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{folder}")


def versioned_write(df: DataFrame, path: str, *, dirty: bool = True, keep: int = commits.KEEP) -> None:
    """Commits a new version after the one that this session has read or written last (the newest, where it has not); :class:`commits.Conflict` where another writer came between.

    Nothing happens where nothing changed. The last ``keep`` versions stay for readers that have just met them.
    """
    if not dirty:
        return
    spark = df.sparkSession
    base = _seen.get(_key(spark, path), commits.latest(spark, path)[0])
    _seen[_key(spark, path)] = commits.commit(df, path, base, keep=keep)


def versioned_update(spark: SparkSession, path: str, schema: T.StructType, change: Callable[[DataFrame], DataFrame]) -> None:
    """Commits ``change`` of the newest version, taken again on a newer one as often as other writers come first: no writer's change is lost."""
    _seen[_key(spark, path)] = commits.update(spark, path, lambda: versioned_read(spark, path, schema), change)


def versioned_erase(spark: SparkSession, path: str, schema: T.StructType, change: Callable[[DataFrame], DataFrame]) -> None:
    """``change`` on the newest and every kept version of a table, see :func:`commits.erase`. A missing table stays missing."""
    if commits.latest(spark, path)[1] is not None:
        _seen[_key(spark, path)] = commits.erase(spark, path, lambda: versioned_read(spark, path, schema), schema, change)


def erase_speaker(spark: SparkSession, speaker_id: str, *, registry: str, baselines: str | None = None) -> None:
    """A speaker leaves every kept version of the stored registry, references included, and of the stored baselines."""
    from cadence.operators.registry import forget_references

    gone = F.col("speaker_id") != speaker_id
    versioned_erase(spark, registry, SPEAKERS, lambda df: forget_references(df.where(gone), speaker_id))
    if baselines:
        versioned_erase(spark, baselines, BASELINES_STORED, lambda df: df.where(gone))


def save_aligner(df: DataFrame, path: str) -> None:
    """The rows of a fitted aligner: each speaker's figures and, under a null speaker, everyone's."""
    versioned_write(df.select(*ALIGNER.names), path)


def load_aligner(spark: SparkSession, path: str) -> DataFrame:
    return versioned_read(spark, path, ALIGNER)


def aligner_from_json(spark: SparkSession, path: str) -> DataFrame:
    """An earlier tool's aligner document as aligner rows; a missing one raises, since nothing can be aligned without it."""
    figures = "mean: map<string, double>, std: map<string, double>"
    d = spark.read.text(path, wholetext=True).select(F.from_json("value", f"feature_cols array<string>, global struct<{figures}>, baselines map<string, struct<{figures}, n: bigint, use_global: boolean>>").alias("d")).select("d.*")
    per = lambda f: [F.col("f").alias("feature"), F.try_element_at(F.col(f"{f}.mean"), F.col("f")).alias("mean"), F.try_element_at(F.col(f"{f}.std"), F.col("f")).alias("std")]
    own = d.select("feature_cols", F.explode("baselines").alias("speaker", "b")).select("speaker", "b", F.explode("feature_cols").alias("f")).select("speaker", *per("b"), F.col("b.n").alias("n"), F.col("b.use_global").alias("use_global"))
    every = d.select("global", F.explode("feature_cols").alias("f")).select(F.lit(None).cast("string").alias("speaker"), *per("global"), F.lit(None).cast("long").alias("n"), F.lit(False).alias("use_global"))
    return own.unionByName(every).select(*ALIGNER.names)


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    return versioned_read(spark, path, SPEAKERS)


def update_registry(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame]) -> None:
    """Commits ``change`` of the stored registry; see :func:`versioned_update`."""
    versioned_update(spark, path, SPEAKERS, lambda df: change(df).select(*SPEAKERS.names))


def save_registry(df: DataFrame, path: str, *, dirty: bool = True) -> None:
    versioned_write(df.select(*SPEAKERS.names), path, dirty=dirty)


_JSON_SPEAKER = "struct<label: string, centroid: array<double>, n_samples: bigint, first_seen: string, last_seen: string, registered: boolean, match_history: array<double>, possible_match: string, possible_sim: double>"


def registry_from_json(spark: SparkSession, path: str) -> DataFrame:
    """The registry document of an earlier tool as a speakers table; missing or broken text gives an empty table, broken text is kept as ``.bak``."""
    if not exists(spark, path):
        return spark.createDataFrame([], SPEAKERS)
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", f"speakers map<string, {_JSON_SPEAKER}>").alias("d"))
    if rows.where("d.speakers is not null").isEmpty():
        fs, p = _fs(spark, path)
        _, bak = _fs(spark, f"{path}.bak")
        fs.rename(p, bak)
        return spark.createDataFrame([], SPEAKERS)
    out = rows.select(F.posexplode("d.speakers")).select(
        F.col("key").alias("speaker_id"), (F.col("pos") + 1).cast("long").alias("insert_no"), "value.label", "value.centroid", F.coalesce("value.n_samples", F.lit(1)).cast("long").alias("n_samples"),
        F.to_timestamp("value.first_seen").alias("first_seen"), F.to_timestamp("value.last_seen").alias("last_seen"), F.coalesce("value.registered", F.lit(False)).alias("registered"),
        F.coalesce("value.match_history", F.array().cast("array<double>")).alias("match_history"), "value.possible_match", "value.possible_sim",
    )
    return out.select(*SPEAKERS.names)


def baselines_from_json(spark: SparkSession, path: str) -> DataFrame:
    """Running baselines of an earlier tool; missing text or fields give defaults, broken text an empty table and a ``.bak``."""
    if not exists(spark, path):
        return spark.createDataFrame([], BASELINES)
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "speakers map<string, struct<n: double, sum_a: double, sum_sq_a: double>>, global struct<mean: double, std: double>").alias("d"))
    if rows.where("d.speakers is not null or d.global is not null").isEmpty():
        fs, p = _fs(spark, path)
        _, bak = _fs(spark, f"{path}.bak")
        fs.rename(p, bak)
        return spark.createDataFrame([], BASELINES)
    zero = lambda c: F.coalesce(F.col(f"value.{c}"), F.lit(0.0)).alias(c)
    return rows.select(F.explode("d.speakers")).select(F.col("key").alias("speaker_id"), zero("n"), zero("sum_a"), zero("sum_sq_a"))


def save_baselines(df: DataFrame, path: str, *, max_n: int = 200) -> None:
    """The state with the cap it was made under."""
    versioned_write(df.select(*BASELINES.names).withColumn("max_n", F.lit(max_n)), path)


def load_baselines(spark: SparkSession, path: str) -> DataFrame:
    return versioned_read(spark, path, BASELINES_STORED)


# Sinks


def write_states_csv(df: DataFrame, path: str, *, bom: bool = True) -> None:
    """One CSV file with a header; a byte order mark before it where asked, as spreadsheet programs expect."""
    names = [c.replace('"', '""') for c in df.columns]
    text = df.select(F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in df.columns]).alias("value"))
    head = df.sparkSession.createDataFrame([(("﻿" if bom else "") + ",".join(f'"{n}"' for n in names),)], "value string")
    head.coalesce(1).union(text.coalesce(1)).coalesce(1).write.mode("overwrite").text(path)


def write_report(frames: dict[str, DataFrame], path: str) -> None:
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def append_trace(spark: SparkSession, rows: list[dict], path: str) -> None:
    """A JSON record per request below the date; written whether or not a request had valid input."""
    spark.createDataFrame([tuple(r.get(n) for n in TRACE.names) for r in rows], TRACE).write.mode("append").partitionBy("date").json(path)


def write_wav(df: DataFrame, path: str, *, samples: str = "samples", name: str = "name", rate: int = 16000) -> DataFrame:
    """A PCM16 WAV file for each row below ``path``, written by the tasks; ``name, path, n_bytes`` of each. Names may hold no slash; equal names overwrite each other."""
    from cadence.sources.providers import wav_bytes

    def run(batches):
        from pyarrow import fs as files

        system, root = files.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (files.LocalFileSystem(), path)
        system.create_dir(root, recursive=True)
        for b in batches:
            out = []
            for who, x in zip(b.column("name").to_pylist(), b.column("samples").to_pylist(), strict=True):
                if not who or "/" in who:
                    raise ValueError(f"not a file name: {who!r}")
                data = wav_bytes(x or [], rate)
                with system.open_output_stream(f"{root}/.{who}.part") as f:
                    f.write(data)
                system.move(f"{root}/.{who}.part", f"{root}/{who}")
                out.append((who, f"{path.rstrip('/')}/{who}", len(data)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else ([], [], []), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["name", "path", "n_bytes"])

    return scratch(df.select(F.col(name).cast("string").alias("name"), F.col(samples).alias("samples")).mapInArrow(run, "name string, path string, n_bytes long"), "wav")
