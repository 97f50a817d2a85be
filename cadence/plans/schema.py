"""Row types, and which columns are features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cadence.functions.scalar import quoted

META = ("start_sec", "end_sec", "duration_sec", "speaker_label", "quality_flag", "low_confidence", "segment_id")
META_FIRST = ("segment_id", "start_sec", "end_sec", "duration_sec", "speaker_label", "quality_flag")
_KINDS = {
    "string": T.StringType(), "double": T.DoubleType(), "long": T.LongType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
    "doubles": T.ArrayType(T.DoubleType()), "strings": T.ArrayType(T.StringType()),
    "map_double": T.MapType(T.StringType(), T.DoubleType()), "map_long": T.MapType(T.StringType(), T.LongType()),
}


def _struct(fields: str) -> T.StructType:
    """From ``name:kind`` words; needs no session, as DDL would."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (f.split(":") for f in fields.split())])


VAD_SEGMENT = _struct("start_sec:double end_sec:double backend:string")
SPEAKERS = _struct("speaker_id:string insert_no:long label:string centroid:doubles n_samples:long first_seen:timestamp last_seen:timestamp registered:boolean match_history:doubles possible_match:string possible_sim:double")
BASELINES = _struct("speaker_id:string n:double sum_a:double sum_sq_a:double")
ALIGNER = _struct("speaker:string feature:string mean:double std:double n:long use_global:boolean")
TRACE = _struct("trace_id:string date:string timestamp:timestamp model_version:string audio_duration_s:double n_segments:long timing_ms:map_double arousal_mean:double exertion_mean:double states:map_long errors:strings")


def feature_columns(df: DataFrame, extra_meta: tuple[str, ...] = ()) -> list[str]:
    """All columns but the meta ones. Those must be numbers, so an id column is noticed, not used."""
    names = [c for c in df.columns if c not in META and c not in extra_meta]
    bad = [c for c in names if not isinstance(df.schema[c].dataType, T.NumericType)]
    if bad:
        raise TypeError(f"not numeric: {', '.join(bad)}")
    return names


def realign(df: DataFrame, saved: list[str]) -> DataFrame:
    """The saved features in their order; names what is missing."""
    missing = [c for c in saved if c not in df.columns]
    if missing:
        raise KeyError(f"missing features: {', '.join(missing)}")
    return df.select(*quoted(saved))


def meta_first(df: DataFrame) -> DataFrame:
    head = [c for c in META_FIRST if c in df.columns]
    return df.select(*quoted([*head, *(c for c in df.columns if c not in head)]))
