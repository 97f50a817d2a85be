"""Names of the 88 acoustic features and what they belong to, as data and as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of the acoustic parameter set, and the patterns that group them.
FEATURE_NAMES: tuple[str, ...] = (
    "F0semitoneFrom27.5Hz_sma3nz_amean",
    "F0semitoneFrom27.5Hz_sma3nz_stddevNorm",
    "F0semitoneFrom27.5Hz_sma3nz_percentile20.0",
    "F0semitoneFrom27.5Hz_sma3nz_percentile50.0",
    "F0semitoneFrom27.5Hz_sma3nz_percentile80.0",
    "F0semitoneFrom27.5Hz_sma3nz_pctlrange0-2",
    "F0semitoneFrom27.5Hz_sma3nz_meanRisingSlope",
    "F0semitoneFrom27.5Hz_sma3nz_stddevRisingSlope",
    "F0semitoneFrom27.5Hz_sma3nz_meanFallingSlope",
    "F0semitoneFrom27.5Hz_sma3nz_stddevFallingSlope",
    "loudness_sma3_amean",
    "loudness_sma3_stddevNorm",
    "loudness_sma3_percentile20.0",
    "loudness_sma3_percentile50.0",
    "loudness_sma3_percentile80.0",
    "loudness_sma3_pctlrange0-2",
    "loudness_sma3_meanRisingSlope",
    "loudness_sma3_stddevRisingSlope",
    "loudness_sma3_meanFallingSlope",
    "loudness_sma3_stddevFallingSlope",
    "spectralFlux_sma3_amean",
    "spectralFlux_sma3_stddevNorm",
    "mfcc1_sma3_amean",
    "mfcc1_sma3_stddevNorm",
    "mfcc2_sma3_amean",
    "mfcc2_sma3_stddevNorm",
    "mfcc3_sma3_amean",
    "mfcc3_sma3_stddevNorm",
    "mfcc4_sma3_amean",
    "mfcc4_sma3_stddevNorm",
    "jitterLocal_sma3nz_amean",
    "jitterLocal_sma3nz_stddevNorm",
    "shimmerLocaldB_sma3nz_amean",
    "shimmerLocaldB_sma3nz_stddevNorm",
    "HNRdBACF_sma3nz_amean",
    "HNRdBACF_sma3nz_stddevNorm",
    "logRelF0-H1-H2_sma3nz_amean",
    "logRelF0-H1-H2_sma3nz_stddevNorm",
    "logRelF0-H1-A3_sma3nz_amean",
    "logRelF0-H1-A3_sma3nz_stddevNorm",
    "F1frequency_sma3nz_amean",
    "F1frequency_sma3nz_stddevNorm",
    "F1bandwidth_sma3nz_amean",
    "F1bandwidth_sma3nz_stddevNorm",
    "F1amplitudeLogRelF0_sma3nz_amean",
    "F1amplitudeLogRelF0_sma3nz_stddevNorm",
    "F2frequency_sma3nz_amean",
    "F2frequency_sma3nz_stddevNorm",
    "F2bandwidth_sma3nz_amean",
    "F2bandwidth_sma3nz_stddevNorm",
    "F2amplitudeLogRelF0_sma3nz_amean",
    "F2amplitudeLogRelF0_sma3nz_stddevNorm",
    "F3frequency_sma3nz_amean",
    "F3frequency_sma3nz_stddevNorm",
    "F3bandwidth_sma3nz_amean",
    "F3bandwidth_sma3nz_stddevNorm",
    "F3amplitudeLogRelF0_sma3nz_amean",
    "F3amplitudeLogRelF0_sma3nz_stddevNorm",
    "alphaRatioV_sma3nz_amean",
    "alphaRatioV_sma3nz_stddevNorm",
    "hammarbergIndexV_sma3nz_amean",
    "hammarbergIndexV_sma3nz_stddevNorm",
    "slopeV0-500_sma3nz_amean",
    "slopeV0-500_sma3nz_stddevNorm",
    "slopeV500-1500_sma3nz_amean",
    "slopeV500-1500_sma3nz_stddevNorm",
    "spectralFluxV_sma3nz_amean",
    "spectralFluxV_sma3nz_stddevNorm",
    "mfcc1V_sma3nz_amean",
    "mfcc1V_sma3nz_stddevNorm",
    "mfcc2V_sma3nz_amean",
    "mfcc2V_sma3nz_stddevNorm",
    "mfcc3V_sma3nz_amean",
    "mfcc3V_sma3nz_stddevNorm",
    "mfcc4V_sma3nz_amean",
    "mfcc4V_sma3nz_stddevNorm",
    "alphaRatioUV_sma3nz_amean",
    "hammarbergIndexUV_sma3nz_amean",
    "slopeUV0-500_sma3nz_amean",
    "slopeUV500-1500_sma3nz_amean",
    "spectralFluxUV_sma3nz_amean",
    "loudnessPeaksPerSec",
    "VoicedSegmentsPerSec",
    "MeanVoicedSegmentLengthSec",
    "StddevVoicedSegmentLengthSec",
    "MeanUnvoicedSegmentLength",
    "StddevUnvoicedSegmentLength",
    "equivalentSoundLevel_dBp",
)
GROUPS: dict[str, tuple[int, tuple[str, ...]]] = {
    "pitch": (4, ("F0semitoneFrom27.5Hz",)),
    "voice_quality": (5, ("jitterLocal", "shimmerLocaldB", "HNRdBACF")),
    "energy": (4, ("loudness_sma3",)),
    "spectral": (2, ("spectralFlux_sma3",)),
    "mfcc": (2, ("mfcc1_sma3", "mfcc2_sma3", "mfcc3_sma3", "mfcc4_sma3")),
    "spectral_tilt": (3, ("logRelF0-H1-H2", "logRelF0-H1-A3", "alphaRatio", "hammarbergIndex", "slopeV0-500", "slopeV500-1500")),
    "formant": (2, ("F1frequency", "F1bandwidth", "F1amplitudeLogRelF0", "F2frequency", "F2bandwidth", "F2amplitudeLogRelF0", "F3frequency", "F3bandwidth", "F3amplitudeLogRelF0")),
    "rhythm": (4, ("VoicedSegmentsPerSec", "MeanVoicedSegmentLengthSec", "StddevVoicedSegmentLengthSec", "MeanUnvoicedSegmentLength", "StddevUnvoicedSegmentLength", "loudnessPeaksPerSec")),
    "other": (1, ("equivalentSoundLevel_dBp", "spectralFluxV", "alphaRatioV", "hammarbergIndexV", "slopeV0-500", "slopeV500-1500", "spectralFluxUV", "alphaRatioUV", "hammarbergIndexUV")),
}
#: Pattern of each core indicator and how fatigue moves it.
FATIGUE_CORE: dict[str, tuple[str, str]] = {
    "F0": ("F0semitoneFrom27.5Hz", "down"),
    "jitter": ("jitterLocal", "up"),
    "shimmer": ("shimmerLocaldB", "up"),
    "HNR": ("HNRdBACF", "down"),
    "loudness": ("loudness_sma3", "down"),
    "voice_rate": ("VoicedSegmentsPerSec", "down"),
}
#: Replacements in order; the last three drop the smoothing suffix.
SHORT: tuple[tuple[str, str], ...] = (
    ("F0semitoneFrom27.5Hz", "F0"),
    ("jitterLocal", "jitter"),
    ("shimmerLocaldB", "shimmer"),
    ("HNRdBACF", "HNR"),
    ("loudness_sma3", "loudness"),
    ("spectralFlux_sma3", "specFlux"),
    ("mfcc1_sma3", "MFCC1"),
    ("mfcc2_sma3", "MFCC2"),
    ("mfcc3_sma3", "MFCC3"),
    ("mfcc4_sma3", "MFCC4"),
    ("logRelF0-H1-H2", "H1H2"),
    ("logRelF0-H1-A3", "H1A3"),
    ("alphaRatioV", "alphaRatioV"),
    ("alphaRatioUV", "alphaRatioUV"),
    ("hammarbergIndexV", "hammarbergV"),
    ("EquivalentSoundLevel_dBp", "SPL"),
    ("VoicedSegmentsPerSec", "voiceSegPerSec"),
    ("MeanVoicedSegmentLengthSec", "meanVoiceSegLen"),
    ("F1frequency", "F1freq"),
    ("F2frequency", "F2freq"),
    ("F3frequency", "F3freq"),
    ("F1bandwidth", "F1bw"),
    ("F2bandwidth", "F2bw"),
    ("F3bandwidth", "F3bw"),
    ("_sma3nz_", "_"),
    ("_sma3_", "_"),
    ("_sma3nn_", "_"),
)
def names_frame(spark: SparkSession, names: tuple[str, ...] = FEATURE_NAMES) -> DataFrame:
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "pos int, name string")


def groups_of(name: Column) -> Column:
    """All groups that a name belongs to; several, or none."""
    hit = lambda pats: F.lit(False) if not pats else sum((F.contains(name, F.lit(p)).cast("int") for p in pats), F.lit(0)) > 0
    return F.filter(F.array(*[F.when(hit(pats), F.lit(g)) for g, (_, pats) in GROUPS.items()]), lambda x: x.isNotNull())


def group_weight(group: Column) -> Column:
    return F.coalesce(*[F.when(group == g, F.lit(w)) for g, (w, _) in GROUPS.items()])


def first_group(name: Column) -> Column:
    """The one group of a name by the first part that it holds, ``other`` if none. ``Voiced`` and ``voice`` match ``Unvoiced`` by letters alone."""
    has = lambda part: F.contains(name, F.lit(part))
    any_case = lambda part: F.contains(F.lower(name), F.lit(part))
    return (
        F.when(has("F0"), "F0")
        .when(any_case("jitter"), "jitter")
        .when(any_case("shimmer"), "shimmer")
        .when(has("HNR"), "HNR")
        .when(any_case("loudness"), "loudness")
        .when(any_case("mfcc"), "MFCC")
        .when(has("F1") | has("F2") | has("F3"), "formant")
        .when(has("Voiced") | any_case("voice"), "rhythm")
        .when(any_case("slope") | has("alphaRatio") | has("H1"), "spectral_tilt")
        .otherwise("other")
    )


def is_core(name: Column) -> Column:
    test = F.lit(False)
    for pattern, _ in FATIGUE_CORE.values():
        test = test | F.contains(name, F.lit(pattern))
    return test


def short_name(name: Column) -> Column:
    for old, new in SHORT:
        name = F.replace(name, F.lit(old), F.lit(new))
    return name


def core_features(names: tuple[str, ...] = FEATURE_NAMES) -> list[str]:
    return sorted({n for n in names for p, _ in FATIGUE_CORE.values() if p in n})


def classify_table(names: DataFrame) -> DataFrame:
    """``pos, name, groups, first_group, core, short``; groups joined by commas."""
    n = F.col("name")
    return names.select("pos", "name", F.array_join(groups_of(n), ",").alias("groups"), first_group(n).alias("first_group"), is_core(n).alias("core"), short_name(n).alias("short"))
