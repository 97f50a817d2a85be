"""Streaming forms of the persistent folds: baselines and the registry, keyed state in Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cadence.operators.baseline import MAX_N
from cadence.operators.registry import BASE, Registry
from cadence.plans.schema import SPEAKERS
from cadence.session import STATE_STORE


def running_baselines(stream: DataFrame, *, speaker: str, order_by: str, value: str = "arousal", max_n: int = MAX_N) -> DataFrame:
    """Each row with the state before it; the state of a speaker lives in the state store. Rows of one trigger are taken in order."""
    kind = stream.schema[order_by].dataType.simpleString()
    who = stream.schema[speaker].dataType.simpleString()
    state = T.StructType.fromDDL("n double, s double, q double")

    def step(key: tuple, frames: Iterable[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        n, s, q = held.get if held.exists else (0.0, 0.0, 0.0)
        rows = pd.concat(list(frames)).sort_values(order_by, kind="stable")
        out = []
        for r in rows[[order_by, value]].itertuples(index=False):
            out.append((key[0], r[0], float(r[1]), n, s, q))
            if n >= max_n:
                d = max_n / (max_n + 1)
                n, s, q = n * d, s * d, q * d
            n, s, q = n + 1, s + float(r[1]), q + float(r[1]) ** 2
        held.update((n, s, q))
        yield pd.DataFrame(out, columns=[speaker, order_by, value, "n", "sum_a", "sum_sq_a"])

    schema = f"`{speaker}` {who}, `{order_by}` {kind}, `{value}` double, n double, sum_a double, sum_sq_a double"
    rows = stream.where(F.col(speaker).isNotNull()).select(speaker, order_by, F.col(value).cast("double").alias(value))
    return rows.groupBy(speaker).applyInPandasWithState(step, schema, state, "append", GroupStateTimeout.NoTimeout)


VALUE = T.StructType([f for f in SPEAKERS if f.name != "speaker_id"])


def _plain(x):
    """As the state store takes it."""
    if x is None or x is pd.NaT or (isinstance(x, float) and np.isnan(x)):
        return None
    if isinstance(x, (pd.Timestamp, np.datetime64)):
        return pd.Timestamp(x).to_pydatetime()
    if isinstance(x, (list, tuple, np.ndarray)):
        return [float(v) for v in x]
    return x.item() if isinstance(x, np.generic) else x


class SpeakerStates(StatefulProcessor):
    """The registry of a scope as a map from speaker to their row. A trigger reads the map once and writes only speakers that it has changed."""

    def __init__(self, id_col: str, scope: str, base: float):
        self.id_col, self.scope, self.base = id_col, scope, base

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.speakers = handle.getMapState("speakers", "speaker_id string", VALUE)

    def _held(self) -> Registry:
        rows = [{"speaker_id": key[0], **dict(zip(VALUE.names, value, strict=True))} for key, value in self.speakers.iterator()]
        for r in rows:
            r["last_seen"] = None if r["last_seen"] is None else pd.Timestamp(r["last_seen"]).tz_localize(None)
        return Registry(rows, self.base)

    def _write(self, rows: Iterable[dict]) -> None:
        for r in rows:
            self.speakers.updateValue((r["speaker_id"],), tuple(_plain(r[n]) for n in VALUE.names))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._write(initialState.to_dict("records"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("ord", kind="stable")
        registry = self._held()
        out: list[tuple] = []
        erased = frame["erase"].notna().to_numpy()
        stretches = np.flatnonzero(np.diff(np.concatenate([[-1], erased.astype(int)])) != 0)
        for start, stop in zip(stretches, [*stretches[1:], len(frame)], strict=True):
            part = frame.iloc[start:stop]
            if erased[start]:
                for row, who in zip(part["id"], part["erase"], strict=True):
                    there = registry.forget(who)
                    if self.speakers.containsKey((who,)):
                        self.speakers.removeKey((who,))
                    out.append((key[0], row, who, None, "erased" if there else "unknown"))
            else:
                vectors = [None if e is None else np.asarray(e, float) for e in part["embedding"]]
                done = registry.take(vectors, [None if pd.isna(t) else t for t in part["now"]])
                out += [(key[0], row, *d) for row, d in zip(part["id"], done, strict=True)]
        self._write(r for r in registry.rows if r["speaker_id"] in registry.changed)
        result = pd.DataFrame(out, columns=[self.scope, self.id_col, "speaker_id", "similarity", "decision"])
        yield result.astype({"similarity": "float64"})

    def close(self) -> None:
        pass


def match_and_update(stream: DataFrame, *, scope: str, id_col: str, order_by: str, embedding: str = "embedding", now: str | None = None, erase: str | None = None, registry: DataFrame | None = None, base: float = BASE) -> DataFrame:
    """Registry matching, one registry per scope, with a state for each speaker; needs the RocksDB state store.

    ``registry`` (the speakers table, with the scope's column) is what a new query starts from. A row whose ``erase`` column names a speaker
    takes them out of the state, with all references to them, at its place in the order: earlier rows of a trigger still match
    them, later ones don't. ``now`` names the column by which speakers grow stale. Rows of one trigger are taken in order.
    """
    if "RocksDB" not in stream.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass"):
        raise ValueError(f"spark.sql.streaming.stateStore.providerClass must be {STATE_STORE}")
    kinds = {c: stream.schema[c].dataType.simpleString() for c in (scope, id_col)}
    when = (F.col(now).cast("timestamp_ntz") if now else F.lit(None).cast("timestamp_ntz")).alias("now")
    gone = (F.col(erase).cast("string") if erase else F.lit(None).cast("string")).alias("erase")
    rows = stream.select(scope, F.col(id_col).alias("id"), F.col(order_by).alias("ord"), F.col(embedding).cast("array<double>").alias("embedding"), when, gone)
    known = None if registry is None else registry.select(scope, *[F.col(f.name).cast(f.dataType) for f in SPEAKERS]).groupBy(scope)
    schema = f"`{scope}` {kinds[scope]}, `{id_col}` {kinds[id_col]}, speaker_id string, similarity double, decision string"
    return rows.groupBy(scope).transformWithStateInPandas(SpeakerStates(id_col, scope, base), schema, "append", "none", initialState=known)


def speakers_of(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``scope, speaker_id`` and the other columns of the speakers table, as a stopped query's state holds them."""
    found = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "speakers").load()
    key = found.schema["key"].dataType.names[0]
    return found.select(F.col(f"key.{key}").alias("scope"), F.col("user_map_key.speaker_id").alias("speaker_id"), *[F.col(f"user_map_value.{n}").alias(n) for n in VALUE.names])
