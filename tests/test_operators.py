"""Behaviour of single operators, against plain loops where there is one."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.functions import scalar, taxonomy
from cadence.operators import align, baseline, boosting, gate, intervals, metrics, model, registry, rules
from cadence.plans import end_to_end
from cadence.plans.schema import SPEAKERS, feature_columns, realign
from cadence.sources import commits, providers, tables


def loop(values, n=0.0, s=0.0, q=0.0, max_n=200):
    out = []
    for v in values:
        out.append((n, s, q))
        if n >= max_n:
            d = max_n / (max_n + 1)
            n, s, q = n * d, s * d, q * d
        n, s, q = n + 1, s + v, q + v * v
    return out, (n, s, q)


def frame(spark, values, who="a"):
    return spark.createDataFrame([(who, i, float(v), 0.9) for i, v in enumerate(values)], "spk string, t int, arousal double, exertion double")


@pytest.mark.parametrize("stored", [None, (50.0, 20.0, 9.0), (200.7, 90.0, 60.0)])
def test_running_matches_loop(spark, stored, monkeypatch):
    monkeypatch.setattr(baseline, "SPAN", 100)  # several spans
    values = np.random.default_rng(1).random(900)
    state = None if stored is None else spark.createDataFrame([("a", *stored)], "speaker_id string, n double, sum_a double, sum_sq_a double")
    want, last = loop(values, *(stored or (0.0, 0.0, 0.0)))
    got = baseline.running(frame(spark, values), speaker="spk", order_by="t", state=state).orderBy("t").collect()
    assert np.allclose([(r["n"], r["sum_a"], r["sum_sq_a"]) for r in got], want, rtol=1e-9)
    end = baseline.final_state(frame(spark, values), speaker="spk", order_by="t", state=state).first()
    assert np.allclose((end["n"], end["sum_a"], end["sum_sq_a"]), last, rtol=1e-9)


def test_decay_bounds_count(spark):
    end = baseline.final_state(frame(spark, [0.3] * 200 + [0.8] * 50), speaker="spk", order_by="t").first()
    assert end["n"] <= 201


def test_cold_and_stable(spark):
    rows = baseline.process(frame(spark, [0.5, 0.6] * 51), speaker="spk", order_by="t").orderBy("t").collect()
    assert (rows[0]["using_individual"], rows[0]["baseline_conf"]) == (False, "low")
    assert (rows[101]["using_individual"], rows[101]["baseline_conf"]) == (True, "high")


@pytest.mark.parametrize(("a", "e", "want"), [(0.60, 0.70, ("excited", "high")), (0.30, 0.95, ("fatigued", "high")), (0.30, 0.75, ("fatigued", "medium")), (0.42, 0.85, ("stable", "high")), (0.47, 0.9, ("stable", "high")), (float("nan"), 0.9, ("stable", "high"))])
def test_state_rule(spark, a, e, want):
    df = spark.createDataFrame([(a, e)], "arousal double, exertion double")
    r = rules.classify(df, limits={"arousal_low": 0.37, "arousal_high": 0.47, "exertion_high": 0.90}).first()
    assert (r["state"], r["confidence"]) == want


def test_thresholds_interpolate(spark):
    r = rules.thresholds(spark.range(1, 101).select(F.col("id").cast("double").alias("v")), "v").first()
    assert (r["low"], r["high"]) == (25.75, 75.25)


def test_summary_of_nothing(spark):
    df = spark.createDataFrame([], "state string, arousal double, exertion double")
    r = rules.summary(df).first()
    assert r["total"] == 0 and r["excited_pct"] is None


@pytest.mark.parametrize(("n", "want"), [(1, 0.62), (5, 0.62), (6, 0.58), (30, 0.58), (31, 0.52), (100, 0.52)])
def test_adaptive_threshold(spark, n, want):
    assert spark.range(1).select(registry.adaptive_threshold(F.lit(n)).alias("t")).first()["t"] == pytest.approx(want)


def unit(rng):
    v = rng.normal(size=192)
    return v / np.linalg.norm(v)


def test_fold_registers_matches_and_skips_zero(spark):
    rng = np.random.default_rng(3)
    a, b = unit(rng), unit(rng)
    near = [a + rng.normal(size=192) * 0.01 for _ in range(60)]
    rows = [(0, a), (1, b), (2, np.zeros(192)), (3, -a), *((4 + i, v) for i, v in enumerate(near))]
    batch = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id long, embedding array<double>")
    state, out = registry.match_and_update(batch, spark.createDataFrame([], SPEAKERS), id_col="id", order_by="id")
    got = {r["id"]: (r["speaker_id"], r["decision"]) for r in out.collect()}
    assert got[0] == ("persist_001", "new") and got[1] == ("persist_002", "new") and got[2] == (None, "invalid") and got[3] == ("persist_003", "new")
    assert all(got[i] == ("persist_001", "match") for i in range(4, 64))
    first = state.where("speaker_id = 'persist_001'").first()
    assert first["n_samples"] == 61 and len(first["match_history"]) == 50
    assert np.linalg.norm(first["centroid"]) == pytest.approx(1, abs=1e-6)


def people(spark):
    rows = [("persist_001", 1, "x", [1.0, 0.0], 3, None, None, False, [0.9], None, None), ("persist_002", 2, "y", [0.0, 1.0], 1, None, None, False, [0.8], "persist_001", 0.5), ("persist_x", 3, "z", None, 40, None, None, False, [], None, None)]
    return spark.createDataFrame(rows, SPEAKERS)


def test_merge_erase_rename(spark):
    base = spark.createDataFrame([("persist_001", 1.0, 2.0, 3.0), ("persist_002", 4.0, 5.0, 6.0)], "speaker_id string, n double, sum_a double, sum_sq_a double")
    out, sums = registry.merge(people(spark), "persist_001", "persist_002", base)
    r = out.where("speaker_id = 'persist_001'").first()
    assert out.count() == 2 and r["n_samples"] == 4 and r["match_history"] == [0.9, 0.8] and sums.collect()[0]["n"] == 5.0
    assert registry.merge(people(spark), "persist_001", "nobody")[0].count() == 3
    gone, left = registry.erase(people(spark), "persist_001", base)
    assert gone.count() == 2 and left.count() == 1 and gone.where("possible_match is not null").count() == 0
    assert registry.rename(people(spark), "persist_001", "Ann").where("label = 'Ann' and registered").count() == 1
    assert registry.next_number(people(spark)).first()["next"] == 3
    with pytest.raises(ValueError):
        registry.merge(people(spark), "a", "a")


def test_large_registry_is_not_broadcast(spark):
    e = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(40)], "id long, embedding array<double>")
    reg = e.select(F.format_string("p_%d", "id").alias("speaker_id"), F.col("id").alias("insert_no"), F.col("embedding").alias("centroid"))
    a = registry.nearest(e, reg, id_col="id").select("id", "speaker_id").collect()
    b = registry.nearest(e, reg, id_col="id", max_broadcast=7).select("id", "speaker_id").collect()
    assert sorted(a) == sorted(b)


@pytest.mark.parametrize("kind", ["clustered", "spread", "one cell"])
def test_cells_are_exact(spark, kind):
    """Against all pairs: voices in clusters, without any structure, and crowded into one place, with equal and longer centroids among them."""
    g = np.random.default_rng(2)
    d, n, asked = 16, 2500, 300
    centres = g.standard_normal((30 if kind == "clustered" else 1 if kind == "one cell" else n, d))
    known = centres[g.integers(0, len(centres), n)] + g.standard_normal((n, d)) * (1.0 if kind == "spread" else 0.08)
    known /= np.linalg.norm(known, axis=1)[:, None]
    known[100:130] = known[100]
    known[200:220] *= g.uniform(0.5, 2, 20)[:, None]
    q = known[g.integers(0, n, asked)] + g.standard_normal((asked, d)) * 0.05
    q[0] = 0
    reg = spark.createDataFrame([(f"p_{i}", i, v.tolist()) for i, v in enumerate(known)] + [("none", n, None), ("zero", n + 1, [0.0] * d)], "speaker_id string, insert_no long, centroid array<double>")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "id int, embedding array<double>").repartition(3)
    got, visited = registry.nearest_visits(df, reg, id_col="id", max_broadcast=10)
    rows = {r["id"]: r for r in got.collect()}
    unit = q / (np.linalg.norm(q, axis=1)[:, None] + 1e-8)
    sims = unit @ known.T
    assert len(rows) == asked and rows[0]["invalid"] and rows[0]["speaker_id"] is None
    for i in range(1, asked):
        top = sims[i].max()
        assert abs(rows[i]["similarity"] - top) < 1e-12
        assert rows[i]["speaker_id"] == f"p_{np.flatnonzero(sims[i] >= top - 1e-13)[0]}"
    assert visited["possible"] == (asked - 1) * visited["cells"]
    if kind == "clustered":
        assert visited["visits"] < 0.25 * visited["possible"]


def islands(probs, quiet, min_frames_ms, frame_ms):
    out, start, silence, n = [], None, 0, len(probs)
    for i, p in enumerate(probs):
        if p > 0.5:
            start, silence = (i if start is None else start), 0
        elif start is not None:
            silence += 1
            if silence >= quiet:
                if (i - silence - start) * frame_ms >= min_frames_ms:
                    out.append((start, i - silence + 1))
                start, silence = None, 0
    if start is not None and (n - start) * frame_ms >= min_frames_ms:
        out.append((start, n))
    return out


def test_islands_match_state_machine(spark):
    rng = np.random.default_rng(7)
    seqs = {k: (rng.random(120) < rng.uniform(0.2, 0.9)).astype(float) for k in range(25)}
    df = spark.createDataFrame([(k, i, float(v)) for k, s in seqs.items() for i, v in enumerate(s)], "key int, frame int, prob double")
    got = intervals.frames_to_segments(df, key="key", frame_sec=0.032, min_speech_ms=96, min_silence_ms=70).collect()
    want = {(k, a, b) for k, s in seqs.items() for a, b in islands(s, 2, 96, 32)}
    assert {(r["key"], round(r["start_sec"] / 0.032), round(r["end_sec"] / 0.032)) for r in got} == want


@pytest.mark.parametrize("stored", [None, (40.0, 20.0, 9.0), (150.5, 70.0, 50.0), (200.7, 90.0, 60.0)])
def test_one_speaker_over_many_ranges(spark, stored, monkeypatch):
    """Nine rows in ten are one speaker's; every range holds some of them, and the sums are those of a loop."""
    from cadence.operators import ranges

    monkeypatch.setattr(baseline, "SPAN", 64)
    g = np.random.default_rng(3)
    values = {"big": g.random(1500), "a": g.random(60), "z": g.random(90), "m": g.random(1)}
    rows = [(who, t, float(v), 0.9) for who, vs in values.items() for t, v in enumerate(vs)]
    df = spark.createDataFrame([rows[i] for i in g.permutation(len(rows))], "spk string, t int, arousal double, exertion double")
    state = stored and spark.createDataFrame([("big", *stored), ("z", 5.0, 2.0, 1.0), ("gone", 1.0, 1.0, 1.0)], "speaker_id string, n double, sum_a double, sum_sq_a double")
    got = {(r["spk"], r["t"]): (r["n"], r["sum_a"], r["sum_sq_a"], r["n_after"], r["sum_a_after"], r["sum_sq_a_after"]) for r in baseline.running(df, speaker="spk", order_by="t", state=state, ranges=9).collect()}
    end = {r["speaker_id"]: (r["n"], r["sum_a"], r["sum_sq_a"]) for r in baseline.final_state(df, speaker="spk", order_by="t", state=state).collect()}
    for who, vs in values.items():
        want, last = loop(vs, *({"big": stored, "z": (5.0, 2.0, 1.0)}.get(who, (0.0, 0.0, 0.0)) if stored else (0.0, 0.0, 0.0)))
        after = want[1:] + [last]
        assert np.allclose([got[who, t] for t in range(len(vs))], [(*a, *b) for a, b in zip(want, after, strict=True)], rtol=1e-9)
        assert np.allclose(end[who], last, rtol=1e-9)
    assert ("gone" in end) == bool(stored)
    dealt = ranges.dealt(df, ["spk", "t"], 9)
    assert dealt.where("spk = 'big'").select(ranges.RANGE).distinct().count() >= 8
    assert dealt.groupBy(ranges.RANGE).count().agg(F.max("count")).first()[0] < len(rows) / 3


def test_rows_of_one_time_and_no_rows(spark):
    df = spark.createDataFrame([("a", 1, 0.5, 0.9)] * 500, "spk string, t int, arousal double, exertion double")
    got = sorted(r["n"] for r in baseline.running(df, speaker="spk", order_by="t", ranges=6).collect())
    assert np.allclose(got, sorted(n for n, _, _ in loop([0.5] * 500)[0]))
    assert baseline.running(df.limit(0), speaker="spk", order_by="t").count() == 0


def test_one_recording_over_many_ranges(spark):
    g = np.random.default_rng(11)
    rows, want = [], set()
    for key, n in (("long", 4000), ("b", 50), ("quiet", 40), ("all", 800)):
        probs = np.repeat(g.random(n // 2 + 1) > 0.55, 2)[:n] * 0.9 if key not in ("quiet", "all") else np.full(n, 0.0 if key == "quiet" else 0.9)
        rows += [(key, i, float(p)) for i, p in enumerate(probs)]
        want |= {(key, a, b) for a, b in islands(probs, 3, 96, 32)}
    df = spark.createDataFrame([rows[i] for i in g.permutation(len(rows))], "key string, frame int, prob double")
    for ranges in (1, 5, 40):
        got = intervals.frames_to_segments(df, key="key", frame_sec=0.032, min_speech_ms=96, min_silence_ms=100, ranges=ranges)
        assert {(r["key"], round(r["start_sec"] / 0.032), round(r["end_sec"] / 0.032)) for r in got.collect()} == want
    segs = spark.createDataFrame([*[(k, a * 0.032, b * 0.032) for k, a, b in sorted(want)], ("long", 3.0, 3.5), ("long", 3.0, 3.5), (None, 1.0, 2.0), (None, 2.1, 3.0)], "key string, start_sec double, end_sec double")
    merged = {}
    for k, a, b in sorted(((r["key"], r["start_sec"], r["end_sec"]) for r in segs.collect()), key=lambda r: (r[0] or "", *r[1:])):
        runs = merged.setdefault(k, [])
        if runs and a - runs[-1][1] < 0.3:
            runs[-1][1] = b
        else:
            runs.append([a, b])
    for ranges in (1, 7):
        got = intervals.merge_close(segs, key="key", gap_sec=0.3, ranges=ranges).collect()
        assert sorted((r["key"] or "", r["start_sec"], r["end_sec"]) for r in got) == sorted((k or "", a, b) for k, runs in merged.items() for a, b in runs)


def test_numbers_over_ranges(spark):
    rows = [("f1", i % 4, i) for i in range(300)] + [("f0", 0, -1), (None, 0, -2)]
    got = intervals.renumbered(spark.createDataFrame(rows, "file string, t int, id int"), ["file", "t"]).orderBy("segment_no").collect()
    assert [r["segment_no"] for r in got] == list(range(302))
    assert [(r["file"] or "", r["t"]) for r in got] == sorted((f or "", t) for f, t, _ in rows)


def test_snr_of_short_and_silent(spark):
    df = spark.createDataFrame([([0.0] * 2000,), ([1.0] * 100,)], "x array<double>")
    got = [r[0] for r in df.select(gate.snr_db("x")).collect()]
    assert got == [30.0, float("-inf")]


def test_align_keeps_fitted_state(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 5.0), ("c", float("nan"))], "spk string, `f.1` double")
    fitted = align.fit(df, speaker="spk", features=["f.1"])
    out = align.align(spark.createDataFrame([("a", 2.0), ("zz", 2.0)], "spk string, `f.1` double"), speaker="spk", features=["f.1"], aligner=fitted).orderBy("spk").collect()
    assert out[0]["f.1"] == pytest.approx(0) and not out[0]["low_confidence"] and out[1]["low_confidence"]


def test_taxonomy_counts(spark):
    t = taxonomy.classify_table(taxonomy.names_frame(spark))
    got = {r["first_group"]: r["count"] for r in t.groupBy("first_group").count().collect()}
    assert got == {"F0": 20, "formant": 12, "MFCC": 16, "loudness": 11, "spectral_tilt": 9, "other": 9, "rhythm": 5, "jitter": 2, "shimmer": 2, "HNR": 2}
    assert t.where("groups = ''").count() == 10 and t.where("groups like '%,%'").count() == 10
    assert len(taxonomy.core_features()) == 27 and len(set(taxonomy.FEATURE_NAMES)) == 88
    assert t.where("name = 'F0semitoneFrom27.5Hz_sma3nz_amean'").first()["short"] == "F0_amean"


def test_schema_rules(spark):
    df = spark.createDataFrame([("s", 1.0, "x")], "segment_id string, f double, other string")
    with pytest.raises(TypeError):
        feature_columns(df)
    with pytest.raises(KeyError, match="g"):
        realign(df, ["f", "g"])


def test_clip_keeps_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (2.0,), (-1.0,)], "x double")
    got = [r[0] for r in df.select(scalar.clip01(F.col("x"))).collect()]
    assert math.isnan(got[0]) and got[1:] == [1.0, 0.0]


def test_shap_adds_up(spark):
    rng = np.random.default_rng(2)
    x = rng.random((300, 3))
    df = spark.createDataFrame([(i, *map(float, r), float(r[0] * 2 + r[1] * r[2])) for i, r in enumerate(x)], "id long, a double, b double, c double, y double")
    m = model.Regressors.train(df, features=["a", "b", "c"], arousal="y", exertion="y", trees=4, depth=3)
    rows = model.explain(df, m.arousal, ["a", "b", "c"], ["id"]).collect()
    for r in rows:
        assert r["base_value"] + sum(r["shap"]) == pytest.approx(m.arousal.predict(x[r["id"]][None])[0], abs=1e-9)
        assert r["shap_status"] == "ok"
    with pytest.raises(ValueError):
        m.predict(df, input_space="z")


def test_split_and_ccc(spark):
    a, b = metrics.hash_split(spark.range(1000), "id")
    assert a.count() + b.count() == 1000 and 150 < b.count() < 250
    same = spark.range(5).select(F.lit(1.0).alias("y"), F.lit(1.0).alias("p"))
    assert same.agg(metrics.ccc("y", "p").alias("c")).first()["c"] == 0.0


def test_registry_round_trip(spark, tmp_path):
    path = str(tmp_path / "reg")
    assert tables.load_registry(spark, path).count() == 0
    tables.save_registry(people(spark), path)
    tables.save_registry(people(spark).limit(1), path)
    assert tables.load_registry(spark, path).count() == 1
    broken = tmp_path / "old.json"
    broken.write_text("{ broken")
    assert tables.registry_from_json(spark, str(broken)).count() == 0 and (tmp_path / "old.json.bak").exists()
    good = tmp_path / "good.json"
    good.write_text('{"version": 1, "speakers": {"persist_001": {"label": "A", "centroid": [1.0], "n_samples": 2, "first_seen": "2024-01-01T00:00:00"}}}')
    assert tables.registry_from_json(spark, str(good)).first()["n_samples"] == 2
    base = tmp_path / "base.json"
    base.write_text('{"speakers": {"a": {"n": 10}}}')
    assert tables.baselines_from_json(spark, str(base)).first()["sum_a"] == 0.0


def test_recordings_to_segments(spark):
    x = np.concatenate([np.zeros(16000), np.sin(np.arange(16000) / 5), np.zeros(16000)])
    df = spark.createDataFrame([("f1", [float(v) for v in x], 16000)], "file string, samples array<float>, sample_rate int")
    seg = end_to_end.process_audio(df, denoise=True).collect()
    assert len(seg) == 1 and seg[0]["quality_flag"] == "low_snr" and seg[0]["denoised"] is False and 0.9 < seg[0]["duration_sec"] < 1.1
    got = end_to_end.extract_features(end_to_end.process_audio(df)).first()
    assert got["segment_id"] == "f1::seg_000" and got["loudnessPeaksPerSec"] is not None
    with pytest.raises(NotImplementedError):
        end_to_end.process_audio(df, use_tse=True)
    with pytest.raises(ValueError):
        providers.vad(df, key="file", backend="other")


def recording(spark, rate=16000):
    t = np.arange(rate * 3) / rate
    x = np.where((t > 1) & (t < 2), np.sin(2 * np.pi * 440 * t), 0.0)
    return spark.createDataFrame([("f1", [float(v) for v in x], rate)], "file string, samples array<float>, sample_rate int")


def test_real_providers_never_fall_back_to_fakes(spark, monkeypatch):
    """Neither where a library is missing nor where it can't be imported by the workers."""
    df = recording(spark)
    for backend in ("silero", "ten"):
        with pytest.raises(providers.ProviderMissing):
            providers.vad(df, key="file", backend=backend)
    with pytest.raises(providers.ProviderMissing):
        end_to_end.extract_features(end_to_end.process_audio(df), backend="opensmile")
    assert not any(r["denoised"] for r in end_to_end.process_audio(df, denoise=True).select("denoised").collect())
    monkeypatch.setattr(providers.importlib.util, "find_spec", lambda name: object())
    for backend in ("silero", "ten"):
        with pytest.raises(Exception, match="No module named"):
            providers.vad(df, key="file", backend=backend).collect()
    with pytest.raises(Exception, match="No module named"):
        end_to_end.extract_features(end_to_end.process_audio(df), backend="opensmile").collect()
    assert not any(r["denoised"] for r in end_to_end.process_audio(df, denoise=True).select("denoised").collect())


STUBS = {
    "opensmile": """
import pandas as pd
class FeatureSet: eGeMAPSv02 = "set"
class FeatureLevel: Functionals = "functionals"
class Smile:
    def __init__(self, feature_set, feature_level): assert (feature_set, feature_level) == ("set", "functionals")
    def process_signal(self, x, rate):
        assert rate == 16000
        from cadence.functions.taxonomy import FEATURE_NAMES
        return pd.DataFrame([[float(len(x)) + i for i in range(88)]], columns=list(FEATURE_NAMES))
""",
    "ten_vad": """
class TenVad:
    def __init__(self, hop, threshold): self.hop = hop
    def process(self, frame):
        assert len(frame) == self.hop and frame.dtype.name == "int16"
        return float(abs(frame.astype(int)).mean() > 100), 1
""",
    "clearvoice": """
import wave
class ClearVoice:
    def __init__(self, task, model_names): pass
    def __call__(self, input_path, online_write):
        import numpy as np
        with wave.open(input_path) as f:
            return np.frombuffer(f.readframes(f.getnframes()), np.int16)[None] / 65536
""",
}


def test_adapters_call_their_libraries(spark, tmp_path, monkeypatch):
    """With libraries of the same interface on the workers' path."""
    import sys

    for name, text in STUBS.items():
        (tmp_path / f"{name}.py").write_text(text)
        spark.sparkContext.addPyFile(str(tmp_path / f"{name}.py"))
    try:
        segments = end_to_end.process_audio(recording(spark), denoise=True, vad_backend="ten")
        rows = segments.collect()
        assert len(rows) == 1 and rows[0]["denoised"] is True and 0.9 < rows[0]["duration_sec"] < 1.1 and max(rows[0]["audio"]) < 0.51
        got = end_to_end.extract_features(segments, backend="opensmile").first()
        assert got["F0semitoneFrom27.5Hz_sma3nz_amean"] == len(rows[0]["audio"])
    finally:
        for name in STUBS:
            sys.modules.pop(name, None)
            monkeypatch.setitem(sys.modules, name, None)


def test_rates_are_kept_apart(spark):
    """An 8 kHz and a 48 kHz recording give the segment that a 16 kHz one gives; resampling keeps tones and cuts what the lower rate can't hold."""
    for rate in (8000, 16000, 48000):
        r = end_to_end.process_audio(recording(spark, rate)).collect()
        assert len(r) == 1 and 0.95 < r[0]["start_sec"] < 1.05 and 1.95 < r[0]["end_sec"] < 2.1
    t = np.arange(48000) / 48000
    low, high = (providers.resample(np.sin(2 * np.pi * f * t), 48000) for f in (1000, 11000))
    assert np.abs(low[500:-500] - np.sin(2 * np.pi * 1000 * np.arange(16000) / 16000)[500:-500]).max() < 0.01
    assert np.abs(high[500:-500]).max() < 0.02


def test_decoding_of_widths(tmp_path):
    import io
    import wave

    for width, data, want in ((1, bytes([128, 255]), [0, 0.992]), (2, b"\x00\x00\x00\x40", [0, 0.5]), (3, b"\x00\x00\x00\x00\x00\xc0", [0, -0.5]), (4, b"\x00\x00\x00\x00\x00\x00\x00\x40", [0, 0.5])):
        out = io.BytesIO()
        with wave.open(out, "wb") as f:
            f.setnchannels(1)
            f.setsampwidth(width)
            f.setframerate(16000)
            f.writeframes(data)
        assert providers.decode_wav(out.getvalue())[0] == pytest.approx(want, abs=1e-3)


def test_speaker_library_takes_whole_paths(spark, tmp_path):
    for name, n in (("a.wav", 3), ("ba.wav", 5)):
        (tmp_path / name).write_bytes(providers.wav_bytes(np.zeros(n)))
    got = tables.speaker_library(spark, {"x": str(tmp_path / "a.wav"), "y": str(tmp_path / "ba.wav")}, providers.decode_wav).collect()
    assert {r["speaker_id"]: len(r["samples"]) for r in got} == {"x": 3, "y": 5} and len(got) == 2


def test_broken_tables_are_kept_and_other_errors_raised(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "reg")
    for k in range(2):
        tables.save_registry(people(spark), path)
        version = commits.latest(spark, path)[1]
        for f in (tmp_path / "reg" / version).iterdir():
            f.write_bytes(b"broken") if f.suffix == ".parquet" else f.unlink()
        assert tables.load_registry(spark, path).count() == 0
        assert len(list(tmp_path.glob("reg.bak-*"))) == k + 1
    for _ in range(4):
        tables.save_registry(people(spark), path)
    assert tables.load_registry(spark, path).count() == 3 and len(list((tmp_path / "reg").glob("v-*"))) == 2
    monkeypatch.setattr(commits, "latest", lambda spark, path: (_ for _ in ()).throw(RuntimeError("the job failed")))
    with pytest.raises(RuntimeError, match="the job failed"):
        tables.load_registry(spark, path)
    assert len(list(tmp_path.glob("reg.bak-*"))) == 2


def test_two_writers_lose_nothing(spark, tmp_path):
    """Threads that add speakers at the same time: each change is in the last version, and a write from an older one is refused."""
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "reg")
    tables.save_registry(people(spark), path)

    def add(k):
        def change(df):
            new = df.limit(1).withColumns({"speaker_id": F.lit(f"persist_{900 + k}"), "insert_no": F.lit(900 + k).cast("long")})
            return df.unionByName(new)

        tables.update_registry(spark, path, change)

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(add, range(8)))
    assert {r["speaker_id"] for r in tables.load_registry(spark, path).collect()} == {r["speaker_id"] for r in people(spark).collect()} | {f"persist_{900 + k}" for k in range(8)}
    assert commits.latest(spark, path)[0] == 9 and len(commits.versions(spark, path)) == 2
    known = tables.load_registry(spark, path)
    commits.commit(known.where("insert_no > 900"), path, 9)  # as another session would
    with pytest.raises(commits.Conflict):
        tables.save_registry(known, path)
    assert tables.load_registry(spark, path).count() == 7
    assert len([f for f in (tmp_path / "reg").iterdir() if f.name.startswith("v-")]) == 2


def test_no_kept_file_holds_an_erased_voice(spark, tmp_path):
    path, sums = str(tmp_path / "reg"), str(tmp_path / "sums")
    gone = people(spark).first()["speaker_id"]
    marked = people(spark).withColumn("possible_match", F.when(F.col("speaker_id") != gone, gone))
    for _ in range(3):
        tables.save_registry(marked, path)
    tables.save_baselines(people(spark).select("speaker_id", F.lit(1.0).alias("n"), F.lit(1.0).alias("sum_a"), F.lit(1.0).alias("sum_sq_a")), sums)
    marked.write.parquet(f"{path}/v-left-behind")
    marked.write.parquet(f"{path}.bak-1/v-old")
    tables.erase_speaker(spark, gone, registry=path, baselines=sums)
    files = [str(f) for f in tmp_path.rglob("*.parquet")]
    assert files and not any(gone in str(spark.read.parquet(f).collect()) for f in files)
    assert len(commits.versions(spark, path)) >= 2 and all(tables.versioned_read(spark, path, SPEAKERS, version=v).count() == 2 for v in commits.versions(spark, path))
    assert tables.load_registry(spark, path).count() == 2 == tables.load_baselines(spark, sums).count()
    tables.erase_speaker(spark, gone, registry=str(tmp_path / "none"))


def test_tables_of_the_earlier_layout_are_read(spark, tmp_path):
    path = str(tmp_path / "reg")
    people(spark).select(*SPEAKERS.names).write.parquet(f"{path}/v-1")
    (tmp_path / "reg" / "CURRENT").write_text("v-1")
    assert tables.load_registry(spark, path).count() == 3
    tables.save_registry(people(spark).limit(1), path)
    assert tables.load_registry(spark, path).count() == 1 and not (tmp_path / "reg" / "CURRENT").exists()


def test_counts_come_from_one_pass(spark):
    calls = spark.sparkContext.accumulator(0)

    def decode(raw):
        calls.add(1)
        return providers.decode_wav(raw)

    rows = [("a", providers.wav_bytes(np.zeros(50))), ("b", b"no audio"), ("c", b"")]
    counts, log = providers.outcomes(providers.with_decoded(spark.createDataFrame(rows, "path string, content binary"), "content", decode), "path")
    assert tuple(counts.first()) == (1, 2)
    assert sorted(r["log"][:3] for r in log.collect()) == ["b: ", "c: "]
    assert calls.value == 3


def test_training_rows(spark, tmp_path):
    """Rows with audio in a struct: the first n, decoded, with the reason beside those that fail; metadata alone never reads the audio."""
    wav = providers.wav_bytes(np.sin(np.arange(800) / 7))
    rows = [((wav, "a.wav"), 0.5, "calm"), ((b"broken", "b.wav"), 0.25, "calm"), ((None, "c.wav"), None, "tense")]
    ddl = "`audio-path` struct<bytes: binary, path: string>, score_arousal double, emotion string"
    spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(str(tmp_path / "shard"))
    got = tables.training_rows(spark, str(tmp_path / "shard"), providers.decode_wav).orderBy("score_arousal").collect()
    assert [(r["score_arousal"], r["samples"] is not None, r["error"] is None) for r in got] == [(None, False, False), (0.25, False, False), (0.5, True, True)]
    assert len(got[2]["samples"]) == 800 and got[2]["sample_rate"] == 16000
    assert tables.training_rows(spark, str(tmp_path / "shard"), providers.decode_wav, n=2).count() == 2
    plan = tables.training_metadata(spark, str(tmp_path / "shard"))._jdf.queryExecution().executedPlan().toString()
    assert "audio-path" not in plan.split("ReadSchema")[1]


def test_recordings_by_ranges(spark, tmp_path):
    """Every sample once, whatever the ranges and pieces; broken files are rows that say why."""
    import struct
    import wave

    from cadence.sources import recordings

    g = np.random.default_rng(30)
    want = {}
    for width, channels, rate, n in ((2, 1, 16000, 5001), (1, 2, 8000, 333), (3, 1, 44100, 1000), (4, 2, 16000, 77), (2, 1, 16000, 0)):
        name = f"w{width}c{channels}n{n}.wav"
        with wave.open(str(tmp_path / name), "wb") as f:
            f.setnchannels(channels)
            f.setsampwidth(width)
            f.setframerate(rate)
            f.writeframes(g.integers(0, 256, n * channels * width).astype(np.uint8).tobytes())
        want[name] = recordings.decoded((tmp_path / name).read_bytes()[44:], recordings.Header(1, channels, rate, width, 44, 0)) if n else np.zeros(0)
    floats = g.random(100).astype("<f4")
    body = b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<IHHIIHH", 16, 3, 1, 22050, 88200, 4, 32) + b"data" + struct.pack("<I", 400) + floats.tobytes() + b"tail"
    (tmp_path / "float.wav").write_bytes(b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body)
    want["float.wav"] = floats
    (tmp_path / "bad.wav").write_bytes(b"no audio at all")
    (tmp_path / "other.txt").write_bytes(b"x")
    for range_mb, chunk in ((64, 30), (0.0005, 0.01), (0.00003, 30)):
        rows = recordings.read(spark, str(tmp_path), range_mb=range_mb, chunk_sec=chunk).orderBy("path", "first").collect()
        got = {}
        for r in rows:
            name = r["path"].rpartition("/")[2]
            if r["error"]:
                assert name == "bad.wav" and "WAV" in r["error"]
                continue
            at = got.setdefault(name, [])
            assert r["first"] == len(at) and r["n"] == len(r["samples"])
            at += r["samples"]
        assert got.keys() == want.keys() and sum(bool(r["error"]) for r in rows) == 1
        assert all(np.allclose(got[n], want[n], atol=1e-7) for n in want)
    with pytest.raises(Exception, match="FileNotFound"):
        recordings.read(spark, str(tmp_path / "none")).count()


def test_ranges_of_a_file_beyond_two_gigabytes(tmp_path):
    """A sparse file with more than 4 GB of samples: ranges read only their own bytes."""
    import struct

    from cadence.sources import recordings

    path, frames = tmp_path / "long.wav", 2_300_000_000
    with path.open("wb") as f:
        f.write(b"RF64" + struct.pack("<I", 0xFFFFFFFF) + b"WAVEds64" + struct.pack("<IQQQI", 28, 0, frames * 2, frames, 0) + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 32000, 2, 16) + b"data" + struct.pack("<I", 0xFFFFFFFF))
        start = f.tell()
        f.seek(start + 2 * (frames - 1))
        f.write(struct.pack("<h", 16384))
    reader = recordings.Reader({"path": str(tmp_path)})
    parts = reader.partitions()
    assert len(parts) == -(-path.stat().st_size // 2**26)
    last = list(reader.read(parts[-1]))
    assert last[-1].column("first")[0].as_py() + last[-1].column("n")[0].as_py() == frames and last[-1].column("samples")[0].as_py()[-1] == 0.5
    before = list(reader.read(parts[-2]))
    assert before[-1].column("first")[0].as_py() + before[-1].column("n")[0].as_py() == last[0].column("first")[0].as_py()


def test_recordings_are_written_all_or_none(spark, tmp_path):
    from cadence.sources import recordings

    out = tmp_path / "out"
    rows = [(f"r{i}.wav", [float(np.sin(k / 9)) for k in range(i * 7)]) for i in range(20)]
    df = spark.createDataFrame(rows, "name string, samples array<float>").repartition(4)
    recordings.write(df, str(out))
    assert sorted(f.name for f in out.iterdir()) == sorted(n for n, _ in rows)
    back = {r["path"].rpartition("/")[2]: r["samples"] for r in recordings.read(spark, str(out)).collect()}
    assert all(np.allclose(back[n], x, atol=1e-4) for n, x in rows)
    more = spark.createDataFrame([("new.wav", [0.1]), ("a/b.wav", [0.1])], df.schema).repartition(2)
    with pytest.raises(Exception, match="not a file name"):
        recordings.write(more, str(out))
    with pytest.raises(Exception, match="there already"):
        recordings.write(spark.createDataFrame([("new.wav", [0.1]), ("r3.wav", [0.1])], df.schema).repartition(2), str(out))
    with pytest.raises(Exception, match="written twice"):
        recordings.write(spark.createDataFrame([("new.wav", [0.1]), ("new.wav", [0.1])], df.schema).repartition(2), str(out))
    assert sorted(f.name for f in out.iterdir()) == sorted(n for n, _ in rows)
    recordings.write(spark.createDataFrame([("r3.wav", [0.25] * 5)], df.schema), str(out), overwrite=True)
    assert recordings.durations(recordings.read(spark, str(out))).where("path LIKE '%r3.wav'").first()["n"] == 5


def test_shap_is_the_average_over_orders():
    """Against the definition: every subset of features known, others by shares of training rows."""
    import itertools

    nodes = [
        {"feature": 0, "threshold": 0.5, "left": 1, "right": 2, "value": 0, "cover": 10},
        {"feature": 1, "threshold": 0.3, "left": 3, "right": 4, "value": 0, "cover": 6},
        {"feature": 2, "threshold": 0.7, "left": 5, "right": 6, "value": 0, "cover": 4},
        {"feature": -1, "value": 1.0, "cover": 2}, {"feature": 0, "threshold": 0.2, "left": 7, "right": 8, "value": 0, "cover": 4},
        {"feature": -1, "value": 5.0, "cover": 1}, {"feature": -1, "value": -2.0, "cover": 3}, {"feature": -1, "value": 3.0, "cover": 1}, {"feature": -1, "value": 4.0, "cover": 3},
    ]

    def known(x, subset, at=0):
        n = nodes[at]
        if n["feature"] < 0:
            return n["value"]
        if n["feature"] in subset:
            return known(x, subset, n["left"] if x[n["feature"]] <= n["threshold"] else n["right"])
        return sum(nodes[c]["cover"] * known(x, subset, c) for c in (n["left"], n["right"])) / (nodes[n["left"]]["cover"] + nodes[n["right"]]["cover"])

    rows = np.random.default_rng(4).random((20, 3))
    got = boosting.shap_values(nodes, rows)
    for x, phi in zip(rows, got, strict=True):
        for f in range(3):
            rest = [g for g in range(3) if g != f]
            want = sum(math.factorial(k) * math.factorial(2 - k) / 6 * (known(x, {*s, f}) - known(x, set(s))) for k in range(3) for s in itertools.combinations(rest, k))
            assert phi[f] == pytest.approx(want)


def grown_in_loops(x, y, trees, depth, rate):
    """Boosted trees row by row: all values are bounds, exact sums, the first best split."""
    pred, out = np.full(len(y), y.mean()), []
    for _ in range(trees):
        g = pred - y

        def grow(rows, level, g=g):
            total, n = g[rows].sum(), len(rows)
            best = (1e-6, None)
            for f in range(x.shape[1]) if level < depth else ():
                for v in np.unique(x[rows, f])[:-1]:
                    left = rows[x[rows, f] <= v]
                    gl, hl = g[left].sum(), len(left)
                    gain = gl**2 / (hl + 1) + (total - gl) ** 2 / (n - hl + 1) - total**2 / (n + 1)
                    if gain > best[0] * (1 + 1e-12):
                        best = (gain, (f, v))
            if best[1] is None:
                pred[rows] += -total / (n + 1) * rate
                return (-total / (n + 1) * rate, n)
            f, v = best[1]
            return (f, v, grow(rows[x[rows, f] <= v], level + 1), grow(rows[x[rows, f] > v], level + 1))

        out.append(grow(np.arange(len(y)), 0))
    return pred, out


def test_boosting_equals_loops_whatever_the_partitions(spark):
    g = np.random.default_rng(21)
    x = np.round(g.random((400, 3)), 1)
    y = x[:, 0] * (x[:, 1] > 0.5) + 0.2 * x[:, 2] + 0.05 * g.random(400)
    want, _ = grown_in_loops(x, y, 12, 3, 0.3)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)] + [(None, 1.0, 1.0, 1.0), (1.0, 1.0, float("nan"), 1.0), (1.0, 1.0, 1.0, None)], "a double, b double, c double, y double")
    one = boosting.train(df.repartition(1), ["a", "b", "c"], ["y"], trees=12, depth=3, rate=0.3, subsample=1.0)["y", None]
    assert np.allclose(one.predict(x), want, atol=1e-8)
    many = boosting.train(df.repartition(7, "c"), ["a", "b", "c"], ["y"], trees=12, depth=3, rate=0.3, subsample=1.0)["y", None]
    assert many.to_dict() == one.to_dict()
    drawn = [boosting.train(df.repartition(k, "b"), ["a", "b", "c"], ["y"], trees=3, depth=2, rate=0.3, subsample=0.5)["y", None] for k in (1, 5)]
    assert drawn[0].to_dict() == drawn[1].to_dict()
    assert 120 < drawn[0].grown[0]["cover"][0] < 280


def test_folds_equal_fits_without_them(spark):
    g = np.random.default_rng(22)
    x = np.round(g.random((300, 2)), 1)
    rows = [(*map(float, r), float(r[0] + 0.3 * r[1] + 0.1 * g.random()), int(i % 4) if i % 4 < 3 else None) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, y double, fold int")
    folds = boosting.train(df, ["a", "b"], ["y"], fold="fold", folds=[0, 1, 2], trees=4, depth=2, subsample=1.0, scale=30)
    for k in (0, 1, 2):
        alone = boosting.train(df.where(~F.col("fold").eqNullSafe(F.lit(k))), ["a", "b"], ["y"], trees=4, depth=2, subsample=1.0, scale=30)["y", None]
        assert np.allclose(alone.predict(x), folds["y", k].predict(x), atol=1e-12)


def test_attributions_of_missing_features_and_many_values(spark):
    g = np.random.default_rng(23)
    rows = [(i, *map(float, v), float(v.sum() / 3)) for i, v in enumerate(g.random((900, 3)))]
    df = spark.createDataFrame(rows, "id long, f_a double, f_b double, f_c double, y double")
    models = model.Regressors.train(df, features=["f_a", "f_b", "f_c"], arousal="y", exertion="y", trees=15, depth=4, rate=0.3)
    assert boosting.bin_edges(df, ["f_a"], 64)[0].shape[0] <= 63
    got = models.predict(df.union(spark.createDataFrame([(-1, None, 0.5, float("nan"), 0.0)], df.schema)), add_shap=True)
    by = {r["id"]: r for r in got.collect()}
    assert by[-1]["shap_status"] == "missing: f_a, f_c" and by[5]["shap_status"] == "ok"
    base = model.expected(models.arousal.trees)
    for i in range(0, 900, 50):
        total = base + sum(by[i][f"shap_arousal_{f}"] for f in ("f_a", "f_b", "f_c"))
        assert max(0, min(1, total)) == pytest.approx(by[i]["arousal"], abs=1e-9)
    assert np.mean([abs(r["arousal"] - r["y"]) for i, r in by.items() if i >= 0]) < 0.05
    stated = rules.classify_with_shap(got, top_k=2).where("id = 5").first()["shap_reason"]
    assert stated.count(" | ") == 1 and stated.startswith("f")
    assert rules.classify_with_shap(got.select("id", "arousal", "exertion")).first()["shap_reason"] == rules.NO_SHAP


def test_gate_numbers_rows_without_keys(spark):
    df = spark.range(1000, numPartitions=7).select((999 - F.col("id")).alias("t"), F.lit(1.0).alias("duration_sec"), F.lit(9.0).alias("snr_db"), F.lit(1.0).alias("tse_confidence"))
    got = gate.gate(df, order_by="t").collect()
    assert all(r["segment_id"] == f"seg_{r['t']:03d}" for r in got) and len(got) == 1000
    named = df.withColumn("segment_id", F.when(F.col("t") == 5, "mine").otherwise(""))
    assert gate.gate(named, order_by="t").where("t = 5").first()["segment_id"] == "mine"


def test_percentiles_by_counting(spark):
    from cadence.operators.quantiles import percentiles

    rng = np.random.default_rng(0)
    rows = [("a", float(v)) for v in rng.normal(size=500)] + [("b", 3.0)] * 40 + [("b", 1e12), (None, 2.0), ("c", None), ("c", float("nan")), ("d", float("inf")), ("d", 1.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    for keys in ([], ["k"]):
        one, many = ({tuple(r[:-1]): r[-1] for r in percentiles(df.where("k <> 'd' or k is null"), "v", [0.0, 0.25, 0.9, 1.0], keys, one_pass=n).collect()} for n in (1 << 62 << 2, 0))
        assert one.keys() == many.keys()
        assert all((one[k] is None and many[k] is None) or np.allclose(one[k], many[k], rtol=1e-12) for k in one)


def test_facades_and_model_cache(spark, tmp_path):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(f"s{i}", *map(float, rng.random(2)), float(rng.random())) for i in range(60)], "segment_id string, a double, b double, y double")
    path = str(tmp_path / "models")
    end_to_end.train_from_aligned(df, path, features=["a", "b"], arousal="y", exertion="y", trees=2, depth=2)
    assert model.get_models(path) is model.get_models(path)
    scored = end_to_end.predict_from_aligned(df, path)
    scored.write.parquet(str(tmp_path / "scored"))
    out = end_to_end.classify_results(str(tmp_path / "scored"), str(tmp_path / "csv"))
    assert out.count() == 60 and len(list((tmp_path / "csv").glob("part-*"))) == 1
    with pytest.raises(TypeError):
        end_to_end.predict_from_aligned(7, path)
    table = model.tree_table(spark, model.get_models(path).arousal)
    assert table.where("feature is null").count() == table.where("feature is not null").count() + table.select("tree").distinct().count()
    with_speakers = df.withColumns({"spk": F.concat(F.lit("p"), (F.hash("segment_id") % 3).cast("string")), "fatigue": F.col("y"), "t": F.col("segment_id")})
    folds = model.cross_validate(with_speakers, features=["a", "b"], speaker="spk", fatigue="fatigue", order_by="t", n_folds=2, exertion="y", trees=2, depth=2).collect()
    assert len(folds) == 2 and all(r["n_train"] + r["n_test"] == 60 and 0 <= r["accuracy"] <= 1 for r in folds)


def test_voices_of_recordings(spark):
    """Two files of one voice and one of another, against an empty registry, from samples to states."""
    rows = []
    for name, hz in (("a", 300), ("b", 300), ("c", 3000)):
        t = np.arange(16000 * 3) / 16000
        rows.append((name, [float(v) for v in np.where((t > 0.5) & (t < 2.5), np.sin(2 * np.pi * hz * t), 0.0)], 16000))
    recordings = spark.createDataFrame(rows, "file string, samples array<float>, sample_rate int")
    named, after = end_to_end.identify(end_to_end.process_audio(recordings), spark.createDataFrame([], SPEAKERS))
    got = {r["file"]: r["speaker_label"] for r in named.collect()}
    assert got["a"] == got["b"] == "persist_001" and got["c"] == "persist_002" and after.count() == 2


def stream_of(spark, df, path, schema):
    for k in range(3):
        df.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name).collect()


def test_streams_match_batches(spark, tmp_path, rocks):
    from cadence.streaming import folds

    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(f"s{i % 3}", i, float(rng.random()), i // 40) for i in range(120)], "spk string, t int, arousal double, part int").where("part < 3")
    stream = stream_of(spark, df, str(tmp_path / "a"), df.drop("part").schema)
    got = {r["t"]: (r["n"], r["sum_a"], r["sum_sq_a"]) for r in drained(folds.running_baselines(stream, speaker="spk", order_by="t", max_n=20), "baselines")}
    want = {r["t"]: (r["n"], r["sum_a"], r["sum_sq_a"]) for r in baseline.running(df, speaker="spk", order_by="t", max_n=20).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    base = [unit(rng) for _ in range(3)]
    rows = [(f"c{i % 2}", i, [float(x) for x in base[i % 3] + rng.normal(size=192) * 0.01], None if i % 5 else "2024-01-01 00:00:00", i // 30) for i in range(90)]
    df = spark.createDataFrame(rows, "scope string, id int, embedding array<double>, at string, part int").withColumn("at", F.col("at").cast("timestamp"))
    stream = stream_of(spark, df, str(tmp_path / "b"), df.drop("part").schema)
    got = {r["id"]: (r["speaker_id"], r["decision"]) for r in drained(folds.match_and_update(stream, scope="scope", id_col="id", order_by="id", now="at"), "registry")}
    want = {r["id"]: (r["speaker_id"], r["decision"]) for r in registry.match_and_update(df, spark.createDataFrame([], SPEAKERS), id_col="id", order_by="id", scope="scope", now="at")[1].collect()}
    assert got == want and {v[1] for v in got.values()} == {"new", "match"}


def people_in_order(n=60, seed=4):
    g = np.random.default_rng(seed)
    who = g.standard_normal((6, 16))
    return [("a" if k % 3 else "b", k, (who[g.integers(0, 6)] + g.standard_normal(16) * 0.2).tolist(), None) for k in range(n)]


EVENTS = "scope string, id int, embedding array<double>, erase string"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def batches(spark, rows):
    """``{id: (speaker, decision)}`` and the registry of each scope by the batch fold, an erase event at its place."""
    known, out = spark.createDataFrame([], SPEAKERS).withColumn("scope", F.lit("")), {}
    part = []
    for r in [*rows, ("", -1, None, "nobody")]:
        if r[3] is None:
            part.append(r)
            continue
        if part:
            left, done = registry.match_and_update(spark.createDataFrame(part, EVENTS), known, id_col="id", order_by="id", scope="scope")
            out |= {x["id"]: (x["speaker_id"], x["decision"]) for x in done.collect()}
            known = left.unionByName(known.join(left, "scope", "left_anti"))
        hit = F.col("scope") == r[0]
        kept, = registry.erase(known.where(hit), r[3])
        known, part = kept.unionByName(known.where(~hit)), []
        known = tables.scratch(known, "known")
    return out, known


def test_stream_by_speaker_restarts_and_erases(spark, tmp_path, rocks):
    """Started from a stored table, stopped, restarted from its checkpoint, with a speaker erased in flight: as the batch fold."""
    from cadence.streaming import folds

    rows = people_in_order()
    stored, _ = registry.match_and_update(spark.createDataFrame(rows[:20], EVENTS), spark.createDataFrame([], SPEAKERS), id_col="id", order_by="id", scope="scope")
    gone = [("a", 35, None, "persist_001"), ("b", 50, None, "persist_999")]
    later = sorted([r for r in rows[20:] if r[1] not in (35, 50)] + gone, key=lambda r: r[1])
    want, known = batches(spark, rows[:20] + later)
    folder, state, sink = str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "out")

    def run(part):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
        done = folds.match_and_update(stream, scope="scope", id_col="id", order_by="id", erase="erase", registry=stored)
        done.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    run(later[:12])
    run(later[12:30])
    run(later[30:])
    got = {r["id"]: (r["speaker_id"], r["decision"]) for r in spark.read.parquet(sink).collect()}
    assert got.pop(35) == ("persist_001", "erased")
    assert got.pop(50) == ("persist_999", "unknown")
    assert got == {i: v for i, v in want.items() if i >= 20}
    shown = lambda df: sorted((r["scope"], r["speaker_id"], r["n_samples"], r["possible_match"] or "", [round(x, 9) for x in r["centroid"]]) for r in df.collect())
    assert shown(folds.speakers_of(spark, state)) == shown(known)
    assert "persist_001" not in {r["speaker_id"] for r in folds.speakers_of(spark, state).where("scope = 'a'").collect()}


def one_by_one(known, rows, base=0.55):
    """The fold as plain loops over all speakers."""
    known, out = [[np.array(c), n] for c, n in known], []
    for e in rows:
        q = e / (np.linalg.norm(e) + 1e-8)
        sims = [float(np.sum(c * q)) for c, _ in known]
        best = int(np.argmax(sims)) if sims else -1
        limit = base + (0.07 if known[best][1] <= 5 else 0.03 if known[best][1] <= 30 else -0.03) if sims else 0
        if sims and sims[best] >= limit:
            c, n = known[best]
            rate = min(0.1, 1 / max(n, 1))
            c = (1 - rate) * c + rate * q
            known[best] = [c / (np.linalg.norm(c) + 1e-8), n + 1]
            out.append(best)
        else:
            known.append([q, 1])
            out.append(len(known) - 1)
    return out, known


def test_blocks_equal_rows():
    """Blocks of rows against a registry that changes inside them, also with equal centroids and far more rows than a block holds."""
    g = np.random.default_rng(8)
    people = g.standard_normal((40, 24))
    rows = [people[i] + g.standard_normal(24) * g.uniform(0.1, 1.2) for i in g.integers(0, 40, 900)]
    start = [(v / np.linalg.norm(v), int(n)) for v, n in zip(people[:15], g.integers(1, 60, 15), strict=True)]
    start.append(start[3])
    want, known = one_by_one(start, rows)
    state = registry.Registry([{"speaker_id": f"persist_{i:03d}", "insert_no": i, "centroid": c.tolist(), "n_samples": n, "last_seen": None, "match_history": []} for i, (c, n) in enumerate(start)])
    got = state.take(rows, [None] * len(rows))
    assert [int(who.rpartition("_")[2]) for who, _, _ in got] == want
    assert np.allclose([r["centroid"] for r in state.rows], [c for c, _ in known], rtol=1e-9)
    again = registry.Registry([{"speaker_id": f"persist_{i:03d}", "insert_no": i, "centroid": c.tolist(), "n_samples": n, "last_seen": None, "match_history": []} for i, (c, n) in enumerate(start)])
    assert [x for r in rows for x in again.take([r], [None])] == got


@pytest.mark.parametrize("compat", [False, True])
def test_clustering_in_blocks_equals_rows(spark, compat):
    g = np.random.default_rng(9)
    people = g.standard_normal((12, 10))
    rows = [("s", k, (people[g.integers(0, 12)] + g.standard_normal(10) * 0.5).tolist() if k % 50 else [0.0] * 10) for k in range(700)]
    sums, sizes, want = [], [], []
    for _, _, e in rows:
        v = np.array(e)
        if not v.any():
            want.append(0 if compat else None)
            continue
        q = v / (np.linalg.norm(v) + 1e-8)
        sims = [float(q @ s) / n if compat else float(q @ s) / (np.linalg.norm(s) + 1e-8) for s, n in zip(sums, sizes, strict=True)]
        best = int(np.argmax(sims)) if sims else -1
        if sims and sims[best] >= 0.55:
            sums[best], sizes[best] = sums[best] + q, sizes[best] + 1
        else:
            best = len(sums)
            sums.append(q)
            sizes.append(1)
        want.append(best)
    df = spark.createDataFrame(rows, "scope string, id int, embedding array<double>").repartition(4)
    got = registry.greedy_cluster(df, scope="scope", id_col="id", order_by="id", compat=compat).orderBy("id").collect()
    assert [r["cluster"] for r in got] == want


def test_bounds_of_bins_come_from_all_rows(spark):
    from cadence.operators import boosting

    rows = spark.range(960_000, numPartitions=4).select((F.col("id") % 8).cast("double").alias("a"), (F.col("id") % 960).cast("double").alias("b"))
    a, b = boosting.bin_edges(rows, ["a", "b"], 32)
    assert a.tolist() == [0, 1, 2, 3, 4, 5, 6]
    assert b.tolist() == [30 * k - 0.5 for k in range(1, 32)]


def test_small_ranges_share_tasks(tmp_path):
    from cadence.sources import recordings

    for i in range(1500):
        (tmp_path / f"{i}.wav").write_bytes(providers.wav_bytes(np.full(64, i / 2000), 16000))
    reader = recordings.Reader({"path": str(tmp_path), "range_mb": 64 / 2**20, "chunk_sec": 0.001})
    parts = reader.partitions()
    assert len(parts) <= 6  # 4,500 ranges
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    found = {}
    for r in rows:
        found.setdefault(r["path"], []).append((r["first"], r["n"]))
    assert len(found) == 1500 and all(v == [(0, 10), (10, 16), (26, 16), (42, 16), (58, 6)] for v in found.values())


def test_cells_copy_no_vector_for_a_visit(spark):
    """Without structure nearly all cells are visited; what goes between tasks is a best for each query and partition."""
    import pyspark.sql

    g = np.random.default_rng(31)
    v = g.standard_normal((4000, 32))
    v /= np.linalg.norm(v, axis=1)[:, None]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")
    reg = df.select(F.format_string("p_%d", "id").alias("speaker_id"), F.col("id").alias("insert_no"), F.reverse("embedding").alias("centroid"))
    written = {}
    kept = pyspark.sql.DataFrameWriter.parquet

    def parquet(self, path, *more):
        kept(self, path, *more)
        written[path] = spark.read.parquet(path).count()

    with pytest.MonkeyPatch.context() as m:
        m.setattr(pyspark.sql.DataFrameWriter, "parquet", parquet)
        got, visited = registry.nearest_visits(df, reg, id_col="id", max_broadcast=10)
    assert visited["visits"] > 0.5 * visited["possible"]
    assert sum(written.values()) < 2 * 4000  # blocks and bests, no row for a visit
    sims = v @ v[:, ::-1].T
    assert {r["id"]: r["speaker_id"] for r in got.collect()} == {i: f"p_{k}" for i, k in enumerate(sims.argmax(axis=1))}
