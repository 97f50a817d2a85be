"""The signal plane: providers for decoding, denoising, speech detection, features and embeddings.

A provider is a plain object that takes samples at 16 kHz; workers build it once and call it for each row. Adapters to real
libraries import them in the worker; where a library is missing on the driver, asking for its provider raises
``ProviderMissing``, and where a worker can't build one the task fails. The fake ones are deterministic and serve
tests and plans; no real name ever stands for a fake.
"""

from __future__ import annotations

import importlib.util
import io
import tempfile
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cadence.functions.taxonomy import FEATURE_NAMES

RATE = 16000


class ProviderMissing(RuntimeError):
    pass


def resample(x: np.ndarray, rate: int, target: int = RATE, zeros: int = 16) -> np.ndarray:
    """Windowed-sinc interpolation, low-passed at the lower of both rates; identity at the target rate."""
    if rate == target or not len(x):
        return x
    n = int(round(len(x) * target / rate))
    scale = min(1.0, target / rate)
    reach = int(np.ceil(zeros / scale))
    out = np.empty(n)
    offs = np.arange(-reach, reach + 1)
    for i in range(0, n, 1 << 14):
        at = np.arange(i, min(n, i + (1 << 14))) * (rate / target)
        near = np.floor(at).astype(np.int64)[:, None] + offs
        gap = (at[:, None] - near) * scale
        kernel = np.sinc(gap) * np.cos(np.pi / 2 * np.clip(gap / zeros, -1, 1)) ** 2 * scale
        inside = (near >= 0) & (near < len(x))
        kernel = kernel * inside
        out[i : i + len(at)] = (kernel * x[np.clip(near, 0, len(x) - 1)]).sum(1) / kernel.sum(1)  # the same level up to the ends
    return out


def decode_wav(raw: bytes) -> tuple[np.ndarray, int]:
    """PCM WAV (8, 16, 24 or 32 bits) to mono at 16 kHz."""
    with wave.open(io.BytesIO(raw)) as f:
        width, channels, rate = f.getsampwidth(), f.getnchannels(), f.getframerate()
        data = f.readframes(f.getnframes())
    if width == 1:
        x = (np.frombuffer(data, np.uint8).astype(float) - 128) / 128
    elif width == 3:
        low = np.zeros((len(data) // 3, 4), np.uint8)
        low[:, 1:] = np.frombuffer(data, np.uint8).reshape(-1, 3)
        x = low.view(np.int32).ravel() / 2147483648.0
    elif width in (2, 4):
        x = np.frombuffer(data, np.int16 if width == 2 else np.int32) / (32768.0 if width == 2 else 2147483648.0)
    else:
        raise ValueError(f"sample width {width} is not supported")
    return resample(x.reshape(-1, channels).mean(1), rate), RATE


def wav_bytes(x: np.ndarray, rate: int = RATE) -> bytes:
    """PCM16 WAV; samples beyond 1 are clipped, and cut towards zero."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.clip(np.asarray(x, float), -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def _schema(df: DataFrame, *more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *more])


def with_decoded(df: DataFrame, column: str, decode: Callable[[bytes], tuple[np.ndarray, int]] = decode_wav) -> DataFrame:
    """Adds ``samples, sample_rate, error``; a row that fails has no samples and says why."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for raw in pdf[column]:
                try:
                    x, rate = decode(bytes(raw))
                    out.append((x.astype(np.float32).tolist(), rate, None))
                except Exception as e:
                    out.append((None, None, f"{type(e).__name__}: {e}"))
            yield pdf.assign(samples=[o[0] for o in out], sample_rate=pd.array([o[1] for o in out], "Int32"), error=[o[2] for o in out])

    return df.mapInPandas(run, _schema(df, "samples array<float>", "sample_rate int", "error string"))


def observed(df: DataFrame, error: str = "error") -> tuple[DataFrame, Observation]:
    """The same rows, and an observation that has ``success`` and ``failed`` once they have been written or collected: counts come from the pass itself."""
    failed = F.col(error).isNotNull()
    seen = Observation()
    return df.observe(seen, F.count_if(~failed).alias("success"), F.count_if(failed).alias("failed")), seen


def outcomes(df: DataFrame, item: str, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """How many rows worked and failed, and ``log`` lines ``item: error`` of those that failed, both from one pass over ``df``."""
    from cadence.sources.tables import scratch

    rows, seen = observed(df, error)
    log = scratch(rows.where(F.col(error).isNotNull()).select(F.concat_ws(": ", F.col(item).cast("string"), F.col(error)).alias("log")), "log")
    return df.sparkSession.createDataFrame([(seen.get["success"], seen.get["failed"])], "success long, failed long"), log


def at_rate(df: DataFrame, samples: str = "samples", rate: str = "sample_rate", target: int = RATE) -> DataFrame:
    """Each row's samples brought from its own rate to ``target``; an unknown rate counts as that."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            x = [v if v is None or pd.isna(r) or int(r) == target else resample(np.asarray(v, float), int(r), target).astype(np.float32).tolist() for v, r in zip(pdf[samples], pdf[rate], strict=True)]
            yield pdf.assign(**{samples: x, rate: pd.array([target] * len(pdf), "Int32")})

    return df.withColumn(rate, F.col(rate).cast("int")).mapInPandas(run, _schema(df.withColumn(rate, F.col(rate).cast("int"))))


class FakeVad:
    """Frame probabilities from energy."""

    frame = 512

    def __call__(self, x: np.ndarray) -> np.ndarray:
        n = len(x) // self.frame
        energy = (x[: n * self.frame].reshape(n, self.frame) ** 2).mean(1) if n else np.zeros(0)
        return energy / (energy + 1e-4)


class FakeFeatures:
    """88 numbers that depend on the samples only; NaN under 50 ms."""

    names = FEATURE_NAMES

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if len(x) < 0.05 * RATE:
            return np.full(len(self.names), np.nan)
        base = np.array([x.mean(), x.std(), np.abs(x).max(), (x**2).mean()])
        return np.array([float(base[i % 4] * (1 + i / 10)) for i in range(len(self.names))])


class FakeEmbedding:
    """192 numbers from a coarse spectrum; zeros under 300 ms."""

    size = 192

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if len(x) < 0.3 * RATE:
            return np.zeros(self.size)
        s = np.abs(np.fft.rfft(x[: len(x) // 2 * 2]))
        return np.array([c.mean() for c in np.array_split(s, self.size)])


class SileroVad:
    """Speech probability of every 512 samples."""

    frame = 512

    def __init__(self):
        import silero_vad
        import torch

        self.torch, self.model = torch, silero_vad.load_silero_vad()

    def __call__(self, x: np.ndarray) -> np.ndarray:
        self.model.reset_states()
        parts = np.asarray(x[: len(x) // self.frame * self.frame], np.float32).reshape(-1, self.frame)
        return np.array([float(self.model(self.torch.from_numpy(p), RATE).item()) for p in parts])


class TenVad:
    """Speech probability of every 256 samples."""

    frame = 256

    def __init__(self):
        import ten_vad

        self.make = lambda: ten_vad.TenVad(self.frame, 0.5)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        model = self.make()  # it keeps state from frame to frame
        parts = (np.clip(x[: len(x) // self.frame * self.frame], -1, 1) * 32767).astype(np.int16).reshape(-1, self.frame)
        return np.array([float(model.process(p)[0]) for p in parts])


class SmileFeatures:
    """The 88 functionals; NaN under 50 ms."""

    names = FEATURE_NAMES

    def __init__(self):
        import opensmile

        self.smile = opensmile.Smile(feature_set=opensmile.FeatureSet.eGeMAPSv02, feature_level=opensmile.FeatureLevel.Functionals)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if len(x) < 0.05 * RATE:
            return np.full(len(self.names), np.nan)
        return self.smile.process_signal(np.asarray(x, np.float32), RATE).iloc[0].reindex(list(self.names)).to_numpy(float)


class SpeakerEmbedding:
    """A unit of 192 numbers for a voice; zeros under 300 ms."""

    size, model = 192, "iic/speech_eres2netv2_sv_zh-cn_16k-common"

    def __init__(self):
        from modelscope.pipelines import pipeline

        self.pipe = pipeline(task="speaker-verification", model=self.model)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if len(x) < 0.3 * RATE:
            return np.zeros(self.size)
        with tempfile.NamedTemporaryFile(suffix=".wav") as f:  # the library reads files only
            f.write(wav_bytes(x))
            f.flush()
            return np.asarray(self.pipe([f.name], output_emb=True)["embs"], float).ravel()


class Denoiser:
    """Speech enhancement of a whole recording."""

    def __init__(self):
        import clearvoice

        self.run = clearvoice.ClearVoice(task="speech_enhancement", model_names=["FRCRN_SE_16K"])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        with tempfile.NamedTemporaryFile(suffix=".wav") as f:
            f.write(wav_bytes(x))
            f.flush()
            return np.asarray(self.run(input_path=f.name, online_write=False), float).ravel()


_REAL: dict[str, tuple[tuple[str, ...], type]] = {
    "denoise": (("clearvoice",), Denoiser),
    "vad:silero": (("torch", "silero_vad"), SileroVad),
    "vad:ten": (("ten_vad",), TenVad),
    "features:opensmile": (("opensmile",), SmileFeatures),
    "embedding:modelscope": (("modelscope",), SpeakerEmbedding),
}
_FAKE: dict[str, type] = {"vad:fake": FakeVad, "features:fake": FakeFeatures, "embedding:fake": FakeEmbedding}


def provider(kind: str) -> type:
    """The class of a provider by its name; raises where its library is not installed."""
    if kind == "tse":
        raise NotImplementedError("target-speaker extraction has no provider")
    if kind in _FAKE:
        return _FAKE[kind]
    if kind not in _REAL:
        raise ValueError(f"unknown provider: {kind}")
    libraries, made = _REAL[kind]
    for name in libraries:
        if importlib.util.find_spec(name) is None:
            raise ProviderMissing(f"provider {kind} needs the library {name}, which is not installed")
    return made


def mapped(df: DataFrame, column: str, out: str, made: Callable[[], Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """Adds ``out`` (an array) and ``out_error``, by a provider that each worker builds once; one that can't be built fails the task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = made()
        for pdf in frames:
            values, errors = [], []
            for x in pdf[column]:
                try:
                    values.append(np.asarray(call(np.asarray(x, float)), float).tolist())
                    errors.append(None)
                except Exception as e:
                    values.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pdf.assign(**{out: values, f"{out}_error": errors})

    return df.mapInPandas(run, _schema(df, f"`{out}` array<double>", f"`{out}_error` string"))


def vad(df: DataFrame, *, key: str, samples: str = "samples", backend: str = "fake") -> DataFrame:
    """``key, frame, prob`` of each recording; a frame is ``frame_sec(backend)`` long."""
    rows = mapped(df.select(key, samples), samples, "p", provider(f"vad:{backend}"))
    return rows.select(key, F.posexplode_outer("p").alias("frame", "prob")).where("frame is not null")


def frame_sec(backend: str = "fake") -> float:
    return provider(f"vad:{backend}").frame / RATE


def embeddings(df: DataFrame, *, samples: str = "audio", backend: str = "fake") -> DataFrame:
    """``df`` with ``embedding`` and ``embedding_status``: ok, short (zeros), or the error (zeros)."""
    made = provider(f"embedding:{backend}")
    rows = mapped(df, samples, "embedding", made)
    zeros = F.array_repeat(F.lit(0.0), made.size)
    status = F.when(F.col("embedding_error").isNotNull(), F.col("embedding_error")).when(F.size(samples) < 0.3 * RATE, "short").otherwise("ok")
    return rows.withColumns({"embedding_status": status, "embedding": F.coalesce("embedding", zeros)}).drop("embedding_error")


def denoised(df: DataFrame, samples: str = "samples") -> DataFrame:
    """``df`` with enhanced samples and ``denoised``; a row that can't be enhanced, or a missing library, leaves the signal as it is and says false."""
    try:
        made = provider("denoise")
    except ProviderMissing:
        return df.withColumn("denoised", F.lit(False))

    class Lazy:
        """Built at the first row, so that a worker without the library reports rows, not a failed task."""

        def __init__(self):
            self.call = None

        def __call__(self, x: np.ndarray) -> np.ndarray:
            self.call = self.call or made()
            return self.call(x)

    rows = mapped(df, samples, "_clean", Lazy)
    return rows.withColumns({"denoised": F.col("_clean").isNotNull(), samples: F.coalesce(F.col("_clean").cast("array<float>"), F.col(samples).cast("array<float>"))}).drop("_clean", "_clean_error")
