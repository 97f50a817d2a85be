"""From recordings to states, as one plan over any number of files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.functions.scalar import composite_id, quoted
from cadence.functions.taxonomy import FEATURE_NAMES
from cadence.operators import align, baseline, gate, intervals, registry, rules
from cadence.operators.model import Regressors
from cadence.sources import providers


def process_audio(recordings: DataFrame, *, denoise: bool = False, vad_backend: str = "fake", use_tse: bool = False, min_sec: float = 0.3) -> DataFrame:
    """``file, samples, sample_rate`` to gated segments with their samples at 16 kHz. Asked-for denoising that can't be had leaves the signal as it is and says so in ``denoised``."""
    if use_tse:
        providers.provider("tse")
    recordings = providers.at_rate(recordings.select("file", "samples", "sample_rate"))
    recordings = providers.denoised(recordings) if denoise else recordings.withColumn("denoised", F.lit(False))
    found = intervals.frames_to_segments(providers.vad(recordings, key="file", backend=vad_backend), key="file", frame_sec=providers.frame_sec(vad_backend))
    rows = found.join(recordings, "file")
    rows = rows.withColumn("audio", intervals.cut(F.col("samples"), F.col("start_sec"), F.col("end_sec"), providers.RATE)).drop("samples")
    rows = rows.withColumns({"snr_db": gate.snr_db("audio"), "tse_confidence": F.lit(1.0), "speaker_label": F.lit("unknown")})
    return gate.gate(rows, order_by="start_sec", keys=("file",), min_sec=min_sec)


def extract_features(segments: DataFrame, *, backend: str = "fake") -> DataFrame:
    """Segments with one column per acoustic feature and ids that are unique over files. Columns beyond those of the gate are carried along."""
    rows = providers.mapped(segments, "audio", "_f", providers.provider(f"features:{backend}"))
    named = [F.col("_f")[i].alias(n) for i, n in enumerate(FEATURE_NAMES)]
    head = ["segment_id", "start_sec", "end_sec", "duration_sec", "speaker_label", "quality_flag", "file"]
    more = [c for c in ("embedding", "embedding_status") if c in segments.columns]
    return rows.withColumn("segment_id", composite_id(F.col("file"), F.col("segment_id"))).select(*head, *more, *named)


def with_speaker(rows: DataFrame, speaker: str, label: str | None) -> DataFrame:
    """One label for all rows, unless it is unknown."""
    return rows.withColumn(speaker, F.lit(label)) if label and label != "unknown" else rows


def align_features(features: DataFrame, *, speaker: str = "speaker_label", label: str | None = None, aligner: DataFrame | None = None) -> DataFrame:
    return align.align(with_speaker(features, speaker, label), speaker=speaker, features=list(FEATURE_NAMES), aligner=aligner)


def mean_vectors(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """``keys`` and the mean ``vector`` of each group: tasks send one sum of a group for each batch, not its numbers as rows."""
    kinds = [f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys]

    def folded(table: pa.Table, name: str, count: str | None) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        groups = table.select(keys).append_column("at", pa.array(np.arange(table.num_rows))).group_by(keys).aggregate([("at", "list")])
        x = np.asarray(table[name].combine_chunks().flatten(), float).reshape(table.num_rows, -1)
        n = np.ones(len(x)) if count is None else np.asarray(table[count], float)
        at = groups["at_list"].to_pylist()
        return groups.select(keys), np.stack([x[i].sum(axis=0) for i in at]), np.array([n[i].sum() for i in at])

    def arrays(x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                groups, x, n = folded(pa.Table.from_batches([b]), vector, None)
                yield from groups.append_column("sums", arrays(x)).append_column("n", pa.array(n)).combine_chunks().to_batches()

    def total(table: pa.Table) -> pa.Table:
        groups, x, n = folded(table, "sums", "n")
        return groups.append_column(vector, arrays(x / n[:, None]))

    sums = rows.select(*keys, F.col(vector).cast("array<double>").alias(vector)).mapInArrow(partial, ", ".join([*kinds, "sums array<double>", "n double"]))
    return sums.groupBy(*keys).applyInArrow(total, ", ".join([*kinds, f"`{vector}` array<double>"]))


def identify(segments: DataFrame, known: DataFrame, *, backend: str = "fake", threshold: float = registry.BASE) -> tuple[DataFrame, DataFrame]:
    """``(segments with speaker_label, registry')``: voices are clustered inside each file, and each cluster's mean voice is matched with the registry, file by file."""
    voiced = providers.embeddings(segments, backend=backend).withColumn("_at", F.struct("file", "start_sec"))
    clusters = registry.greedy_cluster(voiced.withColumn("_id", composite_id(F.col("file"), F.col("segment_id"))), scope="file", id_col="_id", order_by="start_sec", threshold=threshold)
    rows = voiced.join(clusters.select(F.col("_id"), "cluster"), composite_id(F.col("file"), F.col("segment_id")) == F.col("_id"), "left").drop("_id", "_at")
    means = mean_vectors(rows.where("cluster is not null"), ["file", "cluster"], "embedding")
    means = means.withColumn("voice", F.concat_ws("#", "file", "cluster")).withColumn("no", F.struct("file", "cluster").cast("string"))
    after, matched = registry.match_and_update(means, known, id_col="voice", order_by="no")
    named = matched.select(F.col("voice").alias("_voice"), "speaker_id")
    rows = rows.join(named, F.concat_ws("#", "file", "cluster") == F.col("_voice"), "left").drop("_voice")
    return rows.withColumn("speaker_label", F.coalesce("speaker_id", F.lit("unknown"))).drop("speaker_id", "cluster"), after.drop("scope")


def classify_scores(scores: DataFrame, *, speaker: str, order_by: str, file: str | None = None, state: DataFrame | None = None) -> DataFrame:
    """Scores to states by each file's thresholds, with speakers' baselines where a speaker is known."""
    keys = (file,) if file else ()
    if speaker in scores.columns:
        return baseline.classify_with_baseline(scores, speaker=speaker, order_by=order_by, keys=keys, state=state)
    return rules.classify(scores, keys)


def classify_audio(recordings: DataFrame, models, *, denoise: bool = False, known: DataFrame | None = None, backend: str = "opensmile", vad_backend: str = "silero", embedding_backend: str = "modelscope", state: DataFrame | None = None) -> DataFrame | tuple[DataFrame, DataFrame]:
    """All steps from recordings to states: gate, voices (where a registry is given; it comes back changed), features, scores in the models' input space, rules."""
    segments, after = process_audio(recordings, denoise=denoise, vad_backend=vad_backend), None
    if known is not None:
        segments, after = identify(segments, known, backend=embedding_backend)
    features = extract_features(segments, backend=backend).drop("embedding", "embedding_status")
    if models.input_space == "z":
        features = align_features(features)
    scored = models.predict(features, input_space=models.input_space)
    scored = scored.select(*quoted(c for c in scored.columns if c not in FEATURE_NAMES))
    if after is None:
        return rules.classify(scored, ("file",))
    return classify_scores(scored, speaker="speaker_label", order_by="segment_id", file="file", state=state), after


def frame_of(rows: DataFrame | str, spark: SparkSession | None = None) -> DataFrame:
    """A frame, or the one at a Parquet path."""
    if isinstance(rows, DataFrame):
        return rows
    if isinstance(rows, str):
        return (spark or SparkSession.active()).read.parquet(rows)
    raise TypeError(f"a DataFrame or a path is wanted, not {type(rows).__name__}")


def train_from_aligned(rows: DataFrame | str, path: str | None = None, **training) -> Regressors:
    """Models from aligned rows or their path, saved where a path is given."""
    models = Regressors.train(frame_of(rows), input_space="z", **training)
    if path:
        models.save(path)
    return models


def predict_from_aligned(rows: DataFrame | str, models: Regressors | str) -> DataFrame:
    """Scores of aligned rows or their path, by models or those at a path."""
    from cadence.operators.model import get_models

    models = get_models(models) if isinstance(models, str) else models
    return models.predict(frame_of(rows), input_space=models.input_space)


def classify_results(scores: DataFrame | str, path: str | None = None, *, order_by: str = "segment_id") -> DataFrame:
    """States of scored rows or their path; written as CSV where a path is given."""
    from cadence.sources.tables import write_states_csv

    out = rules.classify(frame_of(scores))
    if path:
        write_states_csv(out.orderBy(order_by), path)
    return out


def union_frames(frames: list[DataFrame]) -> DataFrame:
    """All rows; columns that a frame lacks are null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
