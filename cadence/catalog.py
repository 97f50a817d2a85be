"""The registered queries of the speech-state operators and their SQL.

Driver tables stand in for speech data: ``events`` for scored segments,
``lineitem`` and ``orders`` for feature frames, ``embeddings`` for voiceprints
and short waveforms. Numbers are rounded to six places on both sides, since sums
over partitions are not taken in the same order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadence.functions import scalar, taxonomy, vector
from cadence.operators import align, baseline, gate, intervals, metrics, model, registry, report, rules
from cadence.plans import end_to_end
from cadence.plans.schema import SPEAKERS, feature_columns, meta_first, realign
from cadence.sources import providers, recordings, tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _segments(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "events")
    return e.select("event_id", F.col("user_id").alias("speaker"), F.col("event_type").alias("file"), F.least(F.col("value") / 100, F.lit(1.0)).alias("arousal"), (F.get_json_object("props", "$.k").cast("double") / 100).alias("exertion"))


def _six(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{f.name}`"), 6).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f"`{f.name}`") for f in df.schema])


SEG = """seg AS (SELECT event_id, user_id AS speaker, event_type AS file, least(value / 100, 1.0) AS arousal,
 CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS exertion FROM events)"""
LIM = """lim AS (SELECT quantile_cont(arousal, 0.25) AS a_low, quantile_cont(arousal, 0.75) AS a_high, quantile_cont(exertion, 0.75) AS e_high FROM seg)"""
STATE = """CASE WHEN arousal > a_high THEN 'excited' WHEN arousal < a_low THEN 'fatigued' ELSE 'stable' END AS state,
 CASE WHEN arousal > a_high THEN 'high' WHEN arousal < a_low AND exertion > e_high THEN 'high' WHEN arousal < a_low THEN 'medium' ELSE 'high' END AS confidence"""


@_query(f"WITH {SEG} SELECT round(quantile_cont(arousal, 0.25), 6) AS low, round(quantile_cont(arousal, 0.75), 6) AS high, round(avg(arousal), 6) AS mean FROM seg")
def state_thresholds(spark, d):
    return _six(rules.thresholds(_segments(spark, d), "arousal"))


@_query(f"WITH {SEG}, {LIM} SELECT event_id, {STATE} FROM seg, lim")
def classify_global(spark, d):
    return rules.classify(_segments(spark, d)).select("event_id", "state", "confidence")


@_query(f"""WITH {SEG}, lim AS (SELECT file, quantile_cont(arousal, 0.25) AS a_low, quantile_cont(arousal, 0.75) AS a_high, quantile_cont(exertion, 0.75) AS e_high FROM seg GROUP BY file)
 SELECT event_id, seg.file AS file, {STATE} FROM seg JOIN lim ON seg.file = lim.file""")
def classify_per_file(spark, d):
    return rules.classify(_segments(spark, d), ("file",)).select("event_id", "file", "state", "confidence")


@_query(f"""WITH {SEG} SELECT event_id, CASE WHEN arousal > 0.8 THEN 'arousal=' || printf('%.2f', arousal) || ' > threshold(0.80)'
 WHEN arousal < 0.55 AND exertion > 0.95 THEN 'arousal=' || printf('%.2f', arousal) || ' < threshold(0.55); exertion=' || printf('%.2f', exertion) || ' > threshold(0.95)'
 WHEN arousal < 0.55 THEN 'arousal=' || printf('%.2f', arousal) || ' < threshold(0.55); exertion=' || printf('%.2f', exertion) || ' <= threshold(0.95)'
 ELSE 'arousal=' || printf('%.2f', arousal) || ' within [0.55, 0.80]' END AS reason FROM (SELECT event_id, floor(arousal * 100) / 100 AS arousal, exertion FROM seg)""")
def state_reasons(spark, d):
    seg = _segments(spark, d).withColumn("arousal", F.floor(F.col("arousal") * 100) / 100)
    return rules.classify(seg, limits=rules.DEFAULTS).select("event_id", "reason")


@_query(f"""WITH {SEG}, {LIM}, s AS (SELECT *, {STATE} FROM seg, lim) SELECT count(*) AS total,
 count(*) FILTER (state = 'excited') AS n_excited, count(*) FILTER (state = 'stable') AS n_stable, count(*) FILTER (state = 'fatigued') AS n_fatigued,
 round(100.0 * count(*) FILTER (state = 'excited') / count(*), 6) AS excited_pct, round(100.0 * count(*) FILTER (state = 'stable') / count(*), 6) AS stable_pct,
 round(100.0 * count(*) FILTER (state = 'fatigued') / count(*), 6) AS fatigued_pct, round(avg(arousal), 6) AS avg_arousal, round(avg(exertion), 6) AS avg_exertion FROM s""")
def state_summary(spark, d):
    return _six(rules.summary(rules.classify(_segments(spark, d))))


@_query(f"WITH {SEG}, {LIM} SELECT state, confidence, count(*) AS n FROM (SELECT {STATE} FROM seg, lim) GROUP BY 1, 2")
def state_counts(spark, d):
    return rules.state_counts(rules.classify(_segments(spark, d)))


@_query(f"""WITH {SEG}, {LIM}, s AS (SELECT event_id, {STATE} FROM seg, lim), r AS (SELECT event_id, state, row_number() OVER (PARTITION BY state ORDER BY event_id) AS k FROM s)
 SELECT event_id, state FROM r WHERE k <= 2""")
def state_examples(spark, d):
    return rules.per_state_head(rules.classify(_segments(spark, d)), 2, "event_id").select("event_id", "state")


@_query(f"WITH {SEG} SELECT speaker, round(avg(arousal), 6) AS avg_arousal, round(avg(exertion), 6) AS avg_exertion, count(*) AS n FROM seg GROUP BY speaker")
def speaker_means(spark, d):
    return _six(report.speaker_means(_segments(spark, d), "speaker"))


def _decayed(key: str) -> str:
    """Closed form of the running sums before each row, without stored state."""
    return f"""{SEG}, k AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY event_id) AS k FROM seg),
 e AS (SELECT *, greatest(0, k - 200) AS e, 200.0 / 201 AS d FROM k),
 w AS (SELECT *, sum(pow(d, -e)) OVER b AS w1, sum(pow(d, -e) * arousal) OVER b AS wa, sum(pow(d, -e) * arousal * arousal) OVER b AS wq
  FROM e WINDOW b AS (PARTITION BY {key} ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 r AS (SELECT *, coalesce(pow(d, greatest(0, k - 201)) * w1, 0) AS n, coalesce(pow(d, greatest(0, k - 201)) * wa, 0) AS sum_a,
  coalesce(pow(d, greatest(0, k - 201)) * wq, 0) AS sum_sq_a FROM w)"""


Z = """z AS (SELECT *, CASE WHEN n > 0 THEN sum_a / n END AS m, CASE WHEN n > 0 THEN greatest(sum_sq_a / n - (sum_a / n) * (sum_a / n), 1e-8) END AS v, (n - 30) / 70 AS t FROM r),
 p AS (SELECT *, CASE WHEN n < 30 THEN (arousal - 0.72) / 0.19 WHEN n < 100 THEN (arousal - (t * m + (1 - t) * 0.72)) / (t * sqrt(v) + (1 - t) * 0.19)
  ELSE (arousal - m) / greatest(sqrt(v), 0.05) END AS arousal_z, CASE WHEN n < 30 THEN 'low' WHEN n < 100 THEN 'medium' ELSE 'high' END AS baseline_conf, n >= 30 AS using_individual FROM z)"""


@_query(f"WITH {_decayed('file')} SELECT event_id, file, round(n, 6) AS n, round(sum_a, 6) AS sum_a, round(sum_sq_a + 3.3e-9, 6) AS sum_sq_a FROM r")
def running_baseline(spark, d):
    rows = baseline.running(_segments(spark, d), speaker="file", order_by="event_id")
    return rows.select("event_id", "file", F.round("n", 6).alias("n"), F.round("sum_a", 6).alias("sum_a"), F.round(F.col("sum_sq_a") + 3.3e-9, 6).alias("sum_sq_a"))  # squares end at the eighth place, so none is near a tie


@_query(f"WITH {_decayed('speaker')}, {Z} SELECT event_id, round(arousal_z, 6) AS arousal_z, baseline_conf, using_individual FROM p")
def prequential_z(spark, d):
    return _six(baseline.process(_segments(spark, d), speaker="speaker", order_by="event_id").select("event_id", "arousal_z", "baseline_conf", "using_individual"))


@_query(f"""WITH {_decayed('file')}, {Z}, {LIM}, s AS (SELECT event_id, file, arousal_z, baseline_conf, using_individual, exertion, {STATE} FROM p, lim)
 SELECT event_id, file, state, CASE WHEN baseline_conf = 'low' AND confidence = 'high' THEN 'medium' WHEN baseline_conf = 'low' AND confidence = 'medium' THEN 'low'
 WHEN baseline_conf = 'medium' AND confidence = 'high' THEN 'medium' ELSE confidence END AS confidence, round(arousal_z, 6) AS arousal_z,
 round(CASE WHEN exertion < 0.95 THEN (exertion - 0.95) / 0.03 ELSE 0 END, 6) AS exertion_z, using_individual FROM s""")
def classify_with_baseline(spark, d):
    out = baseline.classify_with_baseline(_segments(spark, d), speaker="file", order_by="event_id")
    return _six(out.select("event_id", "file", "state", "confidence", "arousal_z", "exertion_z", "using_individual"))


@_query(f"""WITH {_decayed('speaker')}, {Z}, {LIM}, s AS (SELECT *, {STATE} FROM p, lim) SELECT round(sum(event_id % 7 / 2.0), 6) AS total_sec, count(DISTINCT file) AS n_files, count(*) AS n_segments, count(DISTINCT speaker) AS n_speakers,
 round(avg(arousal), 6) AS avg_arousal, round(avg(exertion), 6) AS avg_exertion, count(*) FILTER (state = 'fatigued') AS n_fatigued, count(*) FILTER (state = 'excited') AS n_excited,
 count(*) FILTER (baseline_conf = 'low' AND confidence = 'medium') AS n_low_confidence, count(*) FILTER (NOT using_individual) AS n_cold FROM s""")
def report_scalars(spark, d):
    rows = baseline.classify_with_baseline(_segments(spark, d).withColumn("sec", F.col("event_id") % 7 / 2.0), speaker="speaker", order_by="event_id")
    return _six(report.scalars(rows, file="file", speaker="speaker", duration="sec"))


@_query(f"""WITH {SEG}, k AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY event_id) AS k, count(*) OVER (PARTITION BY file) AS c FROM seg),
 a AS (SELECT file, sum(CASE WHEN k > 200 THEN pow(200.0 / 201, c - greatest(k, 200)) ELSE pow(200.0 / 201, greatest(0, c - 200)) END) AS n,
 sum(CASE WHEN k > 200 THEN pow(200.0 / 201, c - greatest(k, 200)) ELSE pow(200.0 / 201, greatest(0, c - 200)) END * arousal) AS s,
 sum(CASE WHEN k > 200 THEN pow(200.0 / 201, c - greatest(k, 200)) ELSE pow(200.0 / 201, greatest(0, c - 200)) END * arousal * arousal) AS q FROM k GROUP BY file)
 SELECT file AS speaker_id, round(n, 6) AS n, round(s / n, 6) AS mean, round(sqrt(greatest(0, q / n - (s / n) * (s / n))), 6) AS std,
 CASE WHEN n < 30 THEN 'cold' WHEN n < 100 THEN 'warm' ELSE 'stable' END AS stage FROM a""")
def baseline_summary(spark, d):
    return _six(baseline.summary(baseline.final_state(_segments(spark, d), speaker="file", order_by="event_id")))


FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _lineitem(spark, d):
    return _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", *[F.col(f).cast("double").alias(f) for f in FEATS])


@_query("""WITH b AS (SELECT l_suppkey, """ + ", ".join(f"avg({f}::DOUBLE) AS m{i}, stddev_samp({f}::DOUBLE) AS s{i}" for i, f in enumerate(FEATS)) + """, count(*) AS n FROM lineitem GROUP BY 1)
 SELECT l_orderkey, l_linenumber, """ + ", ".join(f"round(CASE WHEN s{i} < 1e-8 THEN 0 ELSE ({f} - m{i}) / s{i} END, 6) AS {f}" for i, f in enumerate(FEATS)) + ", n < 3 AS low_confidence FROM lineitem JOIN b USING (l_suppkey)")
def align_zscore(spark, d):
    out = align.align(_lineitem(spark, d), speaker="l_suppkey", features=FEATS)
    return _six(out.drop("l_suppkey"))


@_query("""WITH b AS (SELECT o_custkey, avg(o_totalprice::DOUBLE) AS m, stddev_samp(o_totalprice::DOUBLE) AS s, count(*) AS n FROM orders GROUP BY 1),
 g AS (SELECT avg(o_totalprice::DOUBLE) AS gm, stddev_samp(o_totalprice::DOUBLE) AS gs FROM orders)
 SELECT o_orderkey, round(CASE WHEN n < 3 THEN (o_totalprice - gm) / gs ELSE (o_totalprice - m) / s END, 6) AS o_totalprice, n < 3 AS low_confidence FROM orders JOIN b USING (o_custkey), g""")
def align_fallback(spark, d):
    rows = _table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    return _six(align.align(rows, speaker="o_custkey", features=["o_totalprice"]).drop("o_custkey"))


@_query("SELECT CAST(l_suppkey AS VARCHAR) AS speaker, count(*) AS n, count(*) < 3 AS using_global, round(avg(l_quantity::DOUBLE), 6) AS l_quantity_mean, round(avg(l_tax::DOUBLE), 6) AS l_tax_mean FROM lineitem GROUP BY l_suppkey")
def align_summary(spark, d):
    return _six(align.summary(align.fit(_lineitem(spark, d), speaker="l_suppkey", features=FEATS), ["l_quantity", "l_tax"]))


@_query("SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(0.4 * l_discount::DOUBLE + 0.4 * l_tax::DOUBLE - 0.2 * l_quantity::DOUBLE / 50))), 6) AS exertion FROM lineitem")
def exertion_proxy(spark, d):
    return _six(_lineitem(spark, d).select("l_orderkey", "l_linenumber", scalar.exertion_proxy(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50).alias("exertion")))


@_query("SELECT l_orderkey, l_linenumber, round(greatest(0, least(1, l_discount::DOUBLE * 12)), 6) AS arousal, round(greatest(0, least(1, 1 - l_tax::DOUBLE * 15)), 6) AS fatigue_prob FROM lineitem")
def clip_scores(spark, d):
    return _six(_lineitem(spark, d).select("l_orderkey", "l_linenumber", scalar.clip01(F.col("l_discount") * 12).alias("arousal"), scalar.fatigue_probability(F.col("l_tax") * 15).alias("fatigue_prob")))


YP = "SELECT l_discount::DOUBLE * 10 AS y, l_tax::DOUBLE * 10 AS p, l_returnflag AS f FROM lineitem"


def _pairs(spark, d):
    return _table(spark, d, "lineitem").select((F.col("l_discount").cast("double") * 10).alias("y"), (F.col("l_tax").cast("double") * 10).alias("p"), F.col("l_returnflag").alias("f"))


@_query(f"WITH t AS ({YP}) SELECT round(2 * covar_pop(y, p) / (var_pop(y) + var_pop(p) + (avg(y) - avg(p)) * (avg(y) - avg(p))), 6) AS ccc FROM t")
def ccc(spark, d):
    return _six(_pairs(spark, d).agg(metrics.ccc("y", "p").alias("ccc")))


@_query(f"""WITH t AS ({YP}) SELECT f, count(*) AS n, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2, round(avg((y - p) * (y - p)), 6) AS mse, round(avg(abs(y - p)), 6) AS mae,
 round(2 * covar_pop(y, p) / (var_pop(y) + var_pop(p) + (avg(y) - avg(p)) * (avg(y) - avg(p))), 6) AS ccc, round(corr(y, p), 6) AS pearson,
 round(avg(y), 6) AS mean_true, round(stddev_pop(y), 6) AS std_true, round(avg(p), 6) AS mean_pred, round(stddev_pop(p), 6) AS std_pred FROM t GROUP BY f""")
def metric_pack(spark, d):
    return _six(metrics.metric_pack(_pairs(spark, d), "y", "p", ("f",)))


def _registry(spark, d):
    e = _table(spark, d, "embeddings")
    id_ = F.col("vec_id")
    return e.select(
        F.format_string("persist_%03d", id_ + 1).alias("speaker_id"), (id_ + 1).alias("insert_no"), F.format_string("auto_spk_%03d", id_ + 1).alias("label"), F.col("embedding").cast("array<double>").alias("centroid"),
        (id_ % 40 + 1).alias("n_samples"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("first_seen"), F.expr("timestamp'2024-03-01 00:00:00' - make_interval(0, 0, 0, cast(vec_id as int))").alias("last_seen"),
        F.lit(False).alias("registered"), F.transform(F.sequence(F.lit(1).cast("long"), id_ % 5), lambda x: x / 10.0).alias("match_history"), F.lit(None).cast("string").alias("possible_match"), F.lit(None).cast("double").alias("possible_sim"),
    )


def _asked(spark, d):
    """Vectors that none of the registry's equals: each embedding backwards."""
    return _table(spark, d, "embeddings").select("vec_id", F.reverse("embedding").alias("embedding"))


REG = """reg AS (SELECT 'persist_' || CASE WHEN vec_id < 99 THEN lpad(CAST(vec_id + 1 AS VARCHAR), 3, '0') ELSE CAST(vec_id + 1 AS VARCHAR) END AS speaker_id, vec_id + 1 AS insert_no, CAST(embedding AS DOUBLE[]) AS centroid, vec_id % 40 + 1 AS n_samples,
 TIMESTAMP '2024-03-01' - to_days(CAST(vec_id AS INTEGER)) AS last_seen, vec_id % 5 AS h FROM embeddings),
 v AS (SELECT vec_id, list_reverse(CAST(embedding AS DOUBLE[])) AS x FROM embeddings),
 q AS (SELECT vec_id, list_transform(x, lambda y: y / (sqrt(list_dot_product(x, x)) + 1e-8)) AS u FROM v),
 s AS (SELECT vec_id, speaker_id, insert_no, n_samples, last_seen, list_dot_product(u, centroid) AS sim FROM q, reg),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, insert_no) AS k FROM s) WHERE k = 1)"""


@_query(f"WITH {REG} SELECT vec_id, speaker_id, round(sim, 6) AS similarity FROM best")
def nn_match(spark, d):
    return _six(registry.nearest(_asked(spark, d), _registry(spark, d), id_col="vec_id").select("vec_id", "speaker_id", "similarity"))


@_query(f"WITH {REG} SELECT vec_id, speaker_id, round(sim, 6) AS similarity FROM best")
def nn_match_cells(spark, d):
    """As for a registry that is too large to be sent to all tasks."""
    return _six(registry.nearest(_asked(spark, d), _registry(spark, d), id_col="vec_id", max_broadcast=0).select("vec_id", "speaker_id", "similarity"))


@_query(f"""WITH {REG}, t AS (SELECT *, 0.55 + CASE WHEN n_samples <= 5 THEN 0.07 WHEN n_samples <= 30 THEN 0.03 ELSE -0.03 END + CASE WHEN date_diff('day', last_seen, TIMESTAMP '2024-03-15') > 30 THEN 0.05 ELSE 0 END AS thr FROM best)
 SELECT vec_id, speaker_id, round(sim, 6) AS similarity, round(thr, 6) AS threshold, CASE WHEN sim >= thr THEN 'match' WHEN sim >= thr - 0.05 THEN 'uncertain' ELSE 'new' END AS decision FROM t""")
def match_decision(spark, d):
    return _six(registry.decide(_asked(spark, d), _registry(spark, d), id_col="vec_id", as_of=F.lit("2024-03-15 00:00:00").cast("timestamp")))


@_query("""WITH a AS (SELECT CAST(embedding AS DOUBLE[]) AS c FROM embeddings WHERE vec_id = 3), b AS (SELECT CAST(embedding AS DOUBLE[]) AS c FROM embeddings WHERE vec_id = 7),
 m AS (SELECT list_transform(generate_series(1, 64), lambda i: (4 * a.c[i] + 8 * b.c[i]) / 12) AS c FROM a, b), n AS (SELECT c, sqrt(list_dot_product(c, c)) + 1e-8 AS size FROM m)
 SELECT 'persist_' || CASE WHEN vec_id < 99 THEN lpad(CAST(vec_id + 1 AS VARCHAR), 3, '0') ELSE CAST(vec_id + 1 AS VARCHAR) END AS speaker_id, CASE WHEN vec_id = 3 THEN 12 ELSE vec_id % 40 + 1 END AS n_samples,
 array_to_string(list_transform(CASE WHEN vec_id = 3 THEN (SELECT list_transform(c, lambda x: x / size) FROM n) ELSE CAST(embedding AS DOUBLE[]) END, lambda x: printf('%.5f', x)), ' ') AS centroid FROM embeddings WHERE vec_id <> 7""")
def registry_merge(spark, d):
    out, _ = registry.merge(_registry(spark, d), "persist_004", "persist_008")
    return out.select("speaker_id", "n_samples", F.array_join(F.transform("centroid", lambda x: F.format_string("%.5f", x)), " ").alias("centroid"))


@_query("SELECT 'persist_' || CASE WHEN vec_id < 99 THEN lpad(CAST(vec_id + 1 AS VARCHAR), 3, '0') ELSE CAST(vec_id + 1 AS VARCHAR) END AS speaker_id, vec_id % 40 + 1 AS n_samples FROM embeddings WHERE vec_id <> 9")
def registry_delete(spark, d):
    return registry.erase(_registry(spark, d), "persist_010")[0].select("speaker_id", "n_samples")


ID = "'persist_' || CASE WHEN vec_id < 99 THEN lpad(CAST(vec_id + 1 AS VARCHAR), 3, '0') ELSE CAST(vec_id + 1 AS VARCHAR) END"


def _cascade(spark, d):
    known = _registry(spark, d).withColumns({"possible_match": F.when(F.col("insert_no") % 3 == 0, "persist_010"), "possible_sim": F.when(F.col("insert_no") % 3 == 0, 0.5)})
    sums = known.select("speaker_id", F.col("insert_no").cast("double").alias("n"))
    left, kept = registry.erase(known, "persist_010", sums)
    return left.select(F.lit("registry").alias("tbl"), "speaker_id", F.col("n_samples").cast("double").alias("n"), "possible_match").unionByName(kept.select(F.lit("baselines").alias("tbl"), "speaker_id", "n", F.lit(None).cast("string").alias("possible_match")))


@_query("""SELECT 'persist_' || CASE WHEN vec_id < 99 THEN lpad(CAST(vec_id + 1 AS VARCHAR), 3, '0') ELSE CAST(vec_id + 1 AS VARCHAR) END AS speaker_id, vec_id % 40 + 1 AS n_samples, CASE WHEN vec_id % 40 + 1 <= 5 THEN 'cold' WHEN vec_id % 40 + 1 <= 30 THEN 'warm'
 WHEN 14 + vec_id > 30 THEN 'stale' ELSE 'stable' END AS stage, round(CASE WHEN vec_id % 5 = 0 THEN 0.1 / 2 ELSE (vec_id % 5 + 1) / 20.0 END, 6) AS avg_similarity FROM embeddings""")
def registry_summary(spark, d):
    return _six(registry.summary(_registry(spark, d), F.lit("2024-03-15 00:00:00").cast("timestamp")).select("speaker_id", "n_samples", "stage", "avg_similarity"))


def _frames(spark, d):
    no = F.row_number().over(Window.partitionBy("speaker").orderBy("event_id")) - 1
    return _segments(spark, d).select("speaker", no.alias("frame"), F.col("arousal").alias("prob"))


ISLANDS = f"""{SEG}, f AS (SELECT speaker, row_number() OVER (PARTITION BY speaker ORDER BY event_id) - 1 AS frame, arousal AS prob FROM seg), t AS (SELECT speaker, max(frame) + 1 AS n FROM f GROUP BY 1),
 g AS (SELECT speaker, frame, CASE WHEN frame - lag(frame) OVER (PARTITION BY speaker ORDER BY frame) - 1 < 2 THEN 0 ELSE 1 END AS new FROM f WHERE prob > 0.4),
 i AS (SELECT speaker, frame, sum(new) OVER (PARTITION BY speaker ORDER BY frame) AS no FROM g), h AS (SELECT speaker, no, min(frame) AS first, max(frame) AS last FROM i GROUP BY 1, 2),
 j AS (SELECT h.*, n, n - 1 - last < 2 AS tail FROM h JOIN t USING (speaker)),
 v AS (SELECT speaker, first * 0.032 AS start_sec, CASE WHEN tail THEN n ELSE last + 1 END * 0.032 AS end_sec FROM j WHERE CASE WHEN tail THEN n - first ELSE last - first END * 32.0 >= 60)"""


def _islands(spark, d):
    return intervals.frames_to_segments(_frames(spark, d), key="speaker", threshold=0.4, min_speech_ms=60, min_silence_ms=70)


@_query(f"WITH {ISLANDS} SELECT speaker, round(start_sec::DOUBLE, 6) AS start_sec, round(end_sec::DOUBLE, 6) AS end_sec FROM v")
def vad_islands(spark, d):
    return _six(_islands(spark, d).select("speaker", "start_sec", "end_sec"))


@_query(f"""WITH {ISLANDS}, a AS (SELECT speaker, start_sec::DOUBLE AS start_sec, end_sec::DOUBLE AS end_sec FROM v),
 b AS (SELECT *, CASE WHEN start_sec - lag(end_sec) OVER (PARTITION BY speaker ORDER BY start_sec) < 0.15 THEN 0 ELSE 1 END AS new FROM a),
 c AS (SELECT *, sum(new) OVER (PARTITION BY speaker ORDER BY start_sec) AS no FROM b) SELECT speaker, round(min(start_sec), 6) AS start_sec, round(max(end_sec), 6) AS end_sec FROM c GROUP BY speaker, no""")
def merge_segments(spark, d):
    return _six(intervals.merge_close(_islands(spark, d), key="speaker", gap_sec=0.15).select("speaker", "start_sec", "end_sec"))


SNR = """w AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
 fr AS (SELECT vec_id, list_sum(list_transform(list_slice(x, i * 8 + 1, i * 8 + 16), lambda v: v * v)) AS e FROM w, generate_series(0, 6) AS g(i)),
 sn AS (SELECT vec_id, quantile_cont(e, 0.1) AS noise, quantile_cont(e, 0.9) AS signal FROM fr GROUP BY vec_id),
 db AS (SELECT vec_id, CASE WHEN noise < 1e-12 THEN 30.0 ELSE 10 * log10(greatest(signal / noise, 1e-6)) END AS snr_db FROM sn)"""


def _snr(spark, d):
    return _table(spark, d, "embeddings").select("vec_id", gate.snr_db("embedding", 16, 8).alias("snr_db"))


@_query(f"WITH {SNR} SELECT vec_id, round(snr_db, 6) AS snr_db FROM db")
def snr_estimate(spark, d):
    return _six(_snr(spark, d))


def _gated(spark, d):
    rows = _snr(spark, d).withColumns({"duration_sec": F.col("vec_id") % 20 / 10.0, "tse_confidence": F.when(F.col("vec_id") % 7 == 0, 0.5).otherwise(1.0)})
    return rows, gate.gate(rows, order_by="vec_id", min_snr=6.0)


GATE = f"""{SNR}, gt AS (SELECT vec_id, 'seg_' || CASE WHEN vec_id < 1000 THEN lpad(CAST(vec_id AS VARCHAR), 3, '0') ELSE CAST(vec_id AS VARCHAR) END AS segment_id,
 CASE WHEN vec_id % 7 = 0 THEN 'uncertain' WHEN snr_db < 6 THEN 'low_snr' ELSE 'ok' END AS quality_flag FROM db WHERE vec_id % 20 / 10.0 >= 0.3)"""


@_query(f"WITH {GATE} SELECT * FROM gt")
def quality_gate(spark, d):
    return _gated(spark, d)[1].select("vec_id", "segment_id", "quality_flag")


@_query(f"""WITH {GATE} SELECT count(*) AS total, count(*) FILTER (quality_flag = 'ok') AS ok, count(*) FILTER (quality_flag = 'low_snr') AS low_snr, count(*) FILTER (quality_flag = 'uncertain') AS uncertain,
 (SELECT count(*) FROM embeddings) - count(*) AS too_short FROM gt""")
def quality_hist(spark, d):
    return gate.histogram(*_gated(spark, d))


@_query("SELECT vec_id, round(list_sum(list_slice(CAST(embedding AS DOUBLE[]), 9, 24)), 6) AS total, 16 AS n FROM embeddings")
def segment_slice(spark, d):
    part = intervals.cut(F.col("embedding"), F.lit(0.5), F.lit(1.5), 16)
    return _six(_table(spark, d, "embeddings").select("vec_id", F.aggregate(part, F.lit(0.0), lambda s, x: s + x.cast("double")).alias("total"), F.size(part).alias("n")))


# Numbers have six places and never end in a tie at the third, so both sides print them alike.
@_query("""WITH t AS (SELECT row_number() OVER () AS rid, l_orderkey, l_linenumber, round(l_quantity::DOUBLE / 50 - 0.50013, 6) AS a_quantity, round(l_discount::DOUBLE * 10 - 0.50013, 6) AS b_discount, round(l_tax::DOUBLE * 12 - 0.50013, 6) AS c_tax FROM lineitem),
 u AS (SELECT rid, l_orderkey, l_linenumber, unnest(['a', 'b', 'c']) AS f, unnest([1, 2, 3]) AS i, unnest([a_quantity, b_discount, c_tax]) AS c FROM t),
 r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY abs(c) DESC, i) AS k FROM u)
 SELECT l_orderkey, l_linenumber, string_agg(f || CASE WHEN c > 0 THEN '↑' ELSE '↓' END || '(' || printf('%+.3f', c) || ')', ' | ' ORDER BY k) AS reasons FROM r WHERE k <= 2 GROUP BY rid, l_orderkey, l_linenumber""")
def topk_contrib(spark, d):
    t = _lineitem(spark, d).select("l_orderkey", "l_linenumber", *[F.round(x - 0.50013, 6).alias(n) for n, x in (("a_quantity", F.col("l_quantity") / 50), ("b_discount", F.col("l_discount") * 10), ("c_tax", F.col("l_tax") * 12))])
    return t.select("l_orderkey", "l_linenumber", metrics.top_reasons(t, ["a_quantity", "b_discount", "c_tax"], 2).alias("reasons"))


CONTRIB = " UNION ALL ".join(f"SELECT {i} AS pos, '{f}' AS feature, (l_{f}::DOUBLE - {m}) / {s} AS c, l_{f}::DOUBLE AS v FROM lineitem" for i, (f, m, s) in enumerate((("quantity", 25, 50), ("discount", 0.05, 0.1), ("tax", 0.04, 0.08))))


def _contrib(spark, d):
    li = _lineitem(spark, d)
    t = li.select(((F.col("l_quantity") - 25) / 50).alias("quantity"), ((F.col("l_discount") - 0.05) / 0.1).alias("discount"), ((F.col("l_tax") - 0.04) / 0.08).alias("tax"), "l_quantity", "l_discount", "l_tax")
    return metrics.contributions(t, [], ["quantity", "discount", "tax"], {f: f"l_{f}" for f in ("quantity", "discount", "tax")})


@_query(f"""WITH u AS ({CONTRIB}), g AS (SELECT feature, min(pos) AS pos, avg(abs(c)) AS contribution, CASE WHEN corr(c, v) > 0 THEN '+' ELSE '-' END AS direction FROM u GROUP BY feature)
 SELECT row_number() OVER (ORDER BY contribution DESC, pos) AS rank, feature, round(contribution, 6) AS contribution, direction FROM g""")
def global_importance(spark, d):
    return _six(metrics.global_importance(_contrib(spark, d)).drop("grp"))


GROUPED = (("F0semitoneFrom27.5Hz_sma3nz_amean", "F0", "l_quantity::DOUBLE / 50"), ("F0semitoneFrom27.5Hz_sma3nz_stddevNorm", "F0", "l_discount::DOUBLE"), ("jitterLocal_sma3nz_amean", "jitter", "l_tax::DOUBLE - 0.04"), ("mfcc1_sma3_amean", "MFCC", "l_extendedprice::DOUBLE / 100000"), ("slopeV0-500_sma3nz_amean", "spectral_tilt", "l_tax::DOUBLE * l_discount::DOUBLE"))


@_query("WITH u AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, '{g}' AS grp, {x} AS c FROM lineitem" for f, g, x in GROUPED) + "), a AS (SELECT feature, grp, avg(abs(c)) AS c FROM u GROUP BY 1, 2) SELECT grp, round(sum(c), 6) AS contribution FROM a GROUP BY grp")
def group_importance(spark, d):
    li = _lineitem(spark, d)
    t = li.select(*[F.expr(x.replace("::DOUBLE", "")).alias(f) for f, _, x in GROUPED])
    return _six(metrics.group_importance(metrics.global_importance(metrics.contributions(t, [], [f for f, _, _ in GROUPED]))))


def _short(name: str) -> str:
    """SQL of the replacements in order."""
    for old, new in taxonomy.SHORT:
        name = f"replace({name}, '{old}', '{new}')"
    return name


@_query(f"""WITH n(pos, name) AS (VALUES {", ".join(f"({i}, '{n}')" for i, n in enumerate(taxonomy.FEATURE_NAMES))})
 SELECT pos, name, CASE WHEN contains(name, 'F0') THEN 'F0' WHEN contains(lower(name), 'jitter') THEN 'jitter' WHEN contains(lower(name), 'shimmer') THEN 'shimmer' WHEN contains(name, 'HNR') THEN 'HNR'
 WHEN contains(lower(name), 'loudness') THEN 'loudness' WHEN contains(lower(name), 'mfcc') THEN 'MFCC' WHEN contains(name, 'F1') OR contains(name, 'F2') OR contains(name, 'F3') THEN 'formant'
 WHEN contains(name, 'Voiced') OR contains(lower(name), 'voice') THEN 'rhythm' WHEN contains(lower(name), 'slope') OR contains(name, 'alphaRatio') OR contains(name, 'H1') THEN 'spectral_tilt' ELSE 'other' END AS first_group,
 {" OR ".join(f"contains(name, '{p}')" for p, _ in taxonomy.FATIGUE_CORE.values())} AS core, {_short("name")} AS short FROM n""")
def feature_taxonomy(spark, d):
    return taxonomy.classify_table(taxonomy.names_frame(spark)).select("pos", "name", "first_group", "core", "short")


@_query(f"""WITH n(name) AS (VALUES {", ".join(f"('{n}')" for n in taxonomy.FEATURE_NAMES)}), g(grp, weight, pat) AS (VALUES {", ".join(f"('{g}', {w}, '{p}')" for g, (w, ps) in taxonomy.GROUPS.items() for p in ps)})
 SELECT grp, weight, count(DISTINCT name) AS n FROM n JOIN g ON contains(name, pat) GROUP BY 1, 2""")
def feature_groups(spark, d):
    rows = taxonomy.names_frame(spark).select(F.explode(taxonomy.groups_of(F.col("name"))).alias("grp"))
    return rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).withColumn("weight", taxonomy.group_weight(F.col("grp"))).select("grp", "weight", "n")


@_query(f"WITH {SEG} SELECT event_id, row_number() OVER (ORDER BY file, event_id) - 1 AS segment_no FROM seg")
def concat_renumber(spark, d):
    return intervals.renumbered(_segments(spark, d).select("event_id", "file"), ["file", "event_id"]).select("event_id", "segment_no")


@_query(f"WITH {SEG}, r AS (SELECT file, row_number() OVER (ORDER BY file, event_id) - 1 AS no FROM seg) SELECT file, min(no) AS pos FROM r GROUP BY file HAVING min(no) > 0")
def file_boundaries(spark, d):
    return intervals.file_boundaries(intervals.renumbered(_segments(spark, d).select("event_id", "file"), ["file", "event_id"]), "file", "segment_no")


@_query("""WITH f AS (SELECT o_custkey AS speaker, min(o_orderkey) AS first_at, count(*) AS n_test FROM orders GROUP BY 1 ORDER BY 2, 1 LIMIT 7)
 SELECT row_number() OVER (ORDER BY first_at) - 1 AS fold, speaker, (SELECT count(*) FROM orders) - n_test AS n_train, n_test FROM f""")
def loso_split(spark, d):
    return metrics.loso_folds(_table(spark, d, "orders"), "o_custkey", "o_orderkey")


@_query("SELECT 'l_' || unnest(['quantity', 'extendedprice', 'discount', 'tax']) AS feature")
def feature_detection(spark, d):
    rows = _lineitem(spark, d).withColumnRenamed("l_suppkey", "speaker_label").withColumnRenamed("l_orderkey", "segment_id")
    names = feature_columns(rows, ("l_linenumber",))
    return spark.createDataFrame([(n,) for n in names], "feature string")


@_query(f"WITH {SEG} SELECT file || '::' || CAST(event_id AS VARCHAR) AS id, CASE WHEN exertion < 0.95 THEN round((exertion - 0.95) / 0.03, 6) ELSE 0 END AS exertion_z FROM seg")
def composite_ids(spark, d):
    seg = _segments(spark, d)
    return _six(seg.select(scalar.composite_id(F.col("file"), F.col("event_id").cast("string")).alias("id"), scalar.exertion_z(F.col("exertion")).alias("exertion_z")))


TIMES = {"start_sec": "event_id % 1000 * 0.1371 + 0.00031", "end_sec": "event_id % 1000 * 0.2503 + 0.00031", "duration_sec": "event_id % 1000 * 0.1132 + 0.00031"}  # never a tie at the first place


@_query(f"WITH {SEG} SELECT event_id, CAST(round(CAST(arousal AS DECIMAL(18, 6)), 3) AS DOUBLE) AS arousal, CAST(round(CAST(exertion AS DECIMAL(18, 6)), 3) AS DOUBLE) AS exertion, {', '.join(f'CAST(round(CAST({x} AS DECIMAL(18, 6)), 1) AS DOUBLE) AS {c}' for c, x in TIMES.items())} FROM seg")
def report_rows(spark, d):
    rows = _segments(spark, d).withColumn("arousal", F.round("arousal", 6)).withColumns({c: F.expr(x).cast("double") for c, x in TIMES.items()})
    return report.segment_report(rows).select("event_id", "arousal", "exertion", *TIMES)


@_query("SELECT count(*) FILTER (least(1, greatest(0, 1 - l_tax::DOUBLE * 8)) > 0.5) AS n_fatigue_tendency FROM lineitem")
def fatigue_count(spark, d):
    return report.fatigue_count(_lineitem(spark, d).select(scalar.fatigue_probability(F.col("l_tax") * 8).alias("fatigue_prob")))


@_query("SELECT a.vec_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_cosine(spark, d):
    e = _table(spark, d, "embeddings")
    return _six(e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id").select("vec_id", vector.cosine("embedding", "other").alias("cosine")))


#: Vectors of a scope in order, with their norm and unit vector; the folds' SQL takes one of each scope in a step.
ORDERED = """e AS (SELECT vec_id, label % 4 AS scope, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), z AS (SELECT *, sqrt(list_dot_product(x, x)) AS size FROM e),
 r AS MATERIALIZED (SELECT vec_id, scope, size, list_transform(x, lambda y: y / (size + 1e-8)) AS q, row_number() OVER (PARTITION BY scope ORDER BY vec_id) AS k FROM z)"""


@_query(f"""WITH RECURSIVE {ORDERED}, f AS (
 SELECT scope, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(c DOUBLE[], n BIGINT)[]) AS known, CAST(NULL AS BIGINT) AS vec_id, CAST(NULL AS BIGINT) AS no, CAST(NULL AS DOUBLE) AS similarity, CAST(NULL AS VARCHAR) AS decision FROM (SELECT DISTINCT scope FROM r)
 UNION ALL
 SELECT scope, k, CASE decision WHEN 'invalid' THEN known
  WHEN 'match' THEN list_transform(known, lambda s, i: CASE WHEN i = pos THEN {{'c': list_transform(moved, lambda y: y / (sqrt(list_dot_product(moved, moved)) + 1e-8)), 'n': s.n + 1}} ELSE s END)
  ELSE list_append(known, {{'c': q, 'n': CAST(1 AS BIGINT)}}) END, vec_id, CASE decision WHEN 'invalid' THEN NULL WHEN 'match' THEN pos ELSE len(known) + 1 END, similarity, decision
 FROM (SELECT *, CASE WHEN size < 1e-6 THEN 'invalid' WHEN best >= thr THEN 'match' WHEN best >= thr - 0.05 THEN 'uncertain' ELSE 'new' END AS decision,
   CASE WHEN size < 1e-6 THEN -1.0 ELSE coalesce(best, -1.0) END AS similarity, list_transform(known[pos].c, lambda y, i: (1 - rate) * y + rate * q[i]) AS moved
  FROM (SELECT *, 0.2 + CASE WHEN n <= 5 THEN 0.07 WHEN n <= 30 THEN 0.03 ELSE -0.03 END AS thr, least(0.1, 1.0 / n) AS rate
   FROM (SELECT *, known[pos].n AS n FROM (SELECT *, list_max(sims) AS best, list_position(sims, list_max(sims)) AS pos
    FROM (SELECT f.scope, r.k, f.known, r.vec_id, r.size, r.q, list_transform(f.known, lambda s: list_dot_product(s.c, r.q)) AS sims FROM f JOIN r ON r.scope = f.scope AND r.k = f.k + 1))))))
 SELECT vec_id, CAST(scope AS VARCHAR) AS scope, 'persist_' || CASE WHEN no < 100 THEN lpad(CAST(no AS VARCHAR), 3, '0') ELSE CAST(no AS VARCHAR) END AS speaker_id, round(similarity, 6) AS similarity, decision FROM f WHERE k > 0""")
def match_and_update(spark, d):
    e = _table(spark, d, "embeddings").withColumn("scope", (F.col("label") % 4).cast("string"))
    empty = _registry(spark, d).where("false")
    return _six(registry.match_and_update(e, empty, id_col="vec_id", order_by="vec_id", scope="scope", base=0.2)[1])


@_query(f"""WITH RECURSIVE {ORDERED}, f AS (
 SELECT scope, CAST(0 AS BIGINT) AS k, CAST([] AS DOUBLE[][]) AS sums, CAST(NULL AS BIGINT) AS vec_id, CAST(NULL AS BIGINT) AS cluster FROM (SELECT DISTINCT scope FROM r)
 UNION ALL
 SELECT scope, k, CASE WHEN size < 1e-6 THEN sums WHEN best >= 0.2 THEN list_transform(sums, lambda s, i: CASE WHEN i = pos THEN list_transform(s, lambda y, j: y + q[j]) ELSE s END) ELSE list_append(sums, q) END,
  vec_id, CASE WHEN size < 1e-6 THEN NULL WHEN best >= 0.2 THEN pos - 1 ELSE len(sums) END
 FROM (SELECT *, list_max(sims) AS best, list_position(sims, list_max(sims)) AS pos
  FROM (SELECT f.scope, r.k, f.sums, r.vec_id, r.size, r.q, list_transform(f.sums, lambda s: list_dot_product(s, r.q) / (sqrt(list_dot_product(s, s)) + 1e-8)) AS sims FROM f JOIN r ON r.scope = f.scope AND r.k = f.k + 1)))
 SELECT CAST(scope AS VARCHAR) AS scope, vec_id, cluster FROM f WHERE k > 0""")
def greedy_cluster(spark, d):
    e = _table(spark, d, "embeddings").withColumn("scope", F.col("label") % 4)
    return registry.greedy_cluster(e, scope="scope", id_col="vec_id", order_by="vec_id", threshold=0.2)


def _boost_sql(tag: str, rows: str, features: int, trees: int, depth: int, rate: float, scale: int, models: str = "(0)") -> str:
    """Boosted trees in SQL: ``{tag}_e{trees}`` holds ``model, id, pred`` and the columns of ``rows`` (id, y, fold, f0, ...); nodes are numbered as in a heap, from 1. Every value of a feature is a bin's bound."""
    f, unit = [f"f{i}" for i in range(features)], 2.0**scale
    out = [
        f"{tag}_b AS (SELECT m.model, sum(round_even(y * {unit}, 0)) / {unit} / count(*) AS base FROM {rows} r, (VALUES {models}) AS m(model) WHERE r.fold <> m.model GROUP BY m.model)",
        f"{tag}_e0 AS MATERIALIZED (SELECT b.model, r.*, b.base AS pred FROM {rows} r, {tag}_b b)",
    ]
    for t in range(trees):
        at = f"{tag}_n{t}_0"
        out.append(f"{at} AS MATERIALIZED (SELECT *, 1 AS node, round_even((pred - y) * {unit}, 0) AS g, fold <> model AS used FROM {tag}_e{t})")
        for level in range(depth):
            at, on, split = f"{tag}_n{t}_{level}", f"{tag}_n{t}_{level + 1}", f"{tag}_s{t}_{level}"
            out.append(f"""{split} AS MATERIALIZED (WITH h AS (SELECT model, node, feature, x, sum(g) AS g, count(*) AS h FROM (SELECT model, node, g, unnest({list(range(features))}) AS feature, unnest([{", ".join(f)}]) AS x FROM {at} WHERE used AND node >= {2**level}) GROUP BY ALL),
  c AS (SELECT model, node, feature, x, sum(g) OVER w / {unit} AS gl, CAST(sum(h) OVER w AS DOUBLE) AS hl, sum(g) OVER a / {unit} AS g, CAST(sum(h) OVER a AS DOUBLE) AS h FROM h WINDOW w AS (PARTITION BY model, node, feature ORDER BY x), a AS (PARTITION BY model, node, feature)),
  v AS (SELECT model, node, feature, x, gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1) AS gain, h FROM c WHERE hl < h)
  SELECT * FROM v WHERE gain > 1e-6 QUALIFY row_number() OVER (PARTITION BY model, node ORDER BY gain DESC, feature, x) = 1)""")
            goes = "CASE s.feature " + " ".join(f"WHEN {i} THEN n.{c}" for i, c in enumerate(f)) + " END"
            out.append(f"{on} AS MATERIALIZED (SELECT n.* REPLACE (CASE WHEN s.node IS NULL THEN n.node ELSE 2 * n.node + CAST({goes} > s.x AS INTEGER) END AS node) FROM {at} n LEFT JOIN {split} s ON s.model = n.model AND s.node = n.node)")
        at = f"{tag}_n{t}_{depth}"
        out.append(f"{tag}_l{t} AS (SELECT model, node, -sum(g) / {unit} / (count(*) + 1) * {rate} AS v, count(*) AS cover FROM {at} WHERE used GROUP BY model, node)")
        out.append(f"{tag}_e{t + 1} AS MATERIALIZED (SELECT n.model, n.id, y, fold, {', '.join(f)}, pred + v AS pred FROM {at} n JOIN {tag}_l{t} l ON l.model = n.model AND l.node = n.node)")
    return ",\n ".join(out)


BOOST = {"depth": 2, "rate": 0.3, "scale": 30}
BOOST_ROWS = """r AS MATERIALIZED (SELECT row_number() OVER () AS id, l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS f0, CAST(l_tax AS DOUBLE) AS f1, CAST(l_linenumber AS DOUBLE) AS f2, l_returnflag AS flag,
 l_quantity::DOUBLE / 100 + l_discount::DOUBLE * 5 AS ya, l_tax::DOUBLE * 6 + l_linenumber::DOUBLE / 20 AS ye FROM lineitem)"""


def _boost_rows(spark, d):
    return _lineitem(spark, d).select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", F.col("l_linenumber").cast("double").alias("line"), (F.col("l_quantity") / 100 + F.col("l_discount") * 5).alias("y"), (F.col("l_tax") * 6 + F.col("l_linenumber").cast("double") / 20).alias("e"))


@_query(f"""WITH {BOOST_ROWS}, ra AS (SELECT id, ya AS y, -1 AS fold, f0, f1, f2 FROM r), re AS (SELECT id, ye AS y, -1 AS fold, f0, f1, f2 FROM r), {_boost_sql("a", "ra", 3, 3, **BOOST)}, {_boost_sql("e", "re", 3, 3, **BOOST)}
 SELECT l_orderkey, l_linenumber, round(greatest(0, least(1, a.pred)), 6) AS arousal, round(greatest(0, least(1, e.pred)), 6) AS exertion, round(greatest(0, least(1, 1 - a.pred)), 6) AS fatigue_prob FROM r JOIN a_e3 a USING (id) JOIN e_e3 e USING (id)""")
def gbt_predict(spark, d):
    """Both regressors, grown to a stated depth, against trees grown in SQL."""
    rows = _boost_rows(spark, d)
    models = model.Regressors.train(rows, features=["l_quantity", "l_tax", "line"], arousal="y", exertion="e", trees=3, subsample=1.0, **BOOST)
    return _six(models.predict(rows).select("l_orderkey", "l_linenumber", "arousal", "exertion", "fatigue_prob"))


FOLDS_SQL = "f AS (SELECT flag, row_number() OVER (ORDER BY min(l_orderkey), flag) - 1 AS fold, count(*) AS n_test, (SELECT count(*) FROM r) - count(*) AS n_train FROM r GROUP BY flag)"


@_query(f"""WITH {BOOST_ROWS}, {FOLDS_SQL}, rf AS MATERIALIZED (SELECT id, ya AS y, f.fold, f0, f1, f2 FROM r JOIN f USING (flag)), {_boost_sql("a", "rf", 3, 2, models="(0), (1), (2)", **BOOST)},
 t AS (SELECT model AS fold, y, greatest(0, least(1, pred)) AS p, pred FROM a_e2 WHERE fold = model)
 SELECT f.fold, flag AS speaker, n_train, n_test, round(2 * covar_pop(y, p) / (var_pop(y) + var_pop(p) + (avg(y) - avg(p)) * (avg(y) - avg(p))), 4) AS ccc,
 round(avg(CAST((greatest(0, least(1, 1 - pred)) > 0.5) = (1 - y > 0.5) AS INTEGER)), 4) AS accuracy FROM t JOIN f ON f.fold = t.fold GROUP BY ALL""")
def cross_validate(spark, d):
    """Leave one speaker out, the folds' models grown side by side."""
    rows = _table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", *[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_tax", "l_linenumber")], (1 - (F.col("l_quantity").cast("double") / 100 + F.col("l_discount").cast("double") * 5)).alias("fatigue"))
    return model.cross_validate(rows, features=["l_quantity", "l_tax", "l_linenumber"], speaker="l_returnflag", fatigue="fatigue", order_by="l_orderkey", trees=2, subsample=1.0, **BOOST)


def _shap_rows(spark, d):
    return _table(spark, d, "orders").select("o_orderkey", F.floor(F.col("o_totalprice").cast("double") / 20000).cast("double").alias("price"), (F.col("o_custkey") % 20).cast("double").alias("cust")).withColumn("y", F.col("price") / 40 + F.when((F.col("price") > 5) & (F.col("cust") > 7), 0.3).otherwise(0.1))


def _shap_sql(trees: int) -> str:
    """``p``: base value and both attributions of each order, by the average over orders of features, from trees grown in SQL."""
    nodes = []
    for t in range(trees):
        nodes += [f"SELECT {t}, node, feature, x, 2 * node, 2 * node + 1, 0.0, h FROM a_s{t}_{k}" for k in range(BOOST["depth"])]
        nodes.append(f"SELECT {t}, node, -1, 0.0, -1, -1, v, cover FROM a_l{t}")
    return f"""r AS MATERIALIZED (SELECT *, price / 40 + CASE WHEN price > 5 AND cust > 7 THEN 0.3 ELSE 0.1 END AS y FROM (SELECT o_orderkey, floor(CAST(o_totalprice AS DOUBLE) / 20000) AS price, CAST(o_custkey % 20 AS DOUBLE) AS cust FROM orders)),
 ra AS (SELECT o_orderkey AS id, y, -1 AS fold, price AS f0, cust AS f1 FROM r), {_boost_sql("a", "ra", 2, trees, **BOOST)},
 leafs AS (SELECT * FROM ({" UNION ALL ".join(nodes)}) AS v(tree, node, feature, threshold, l, r, value, cover)),
 nodes AS MATERIALIZED (SELECT tree, node, feature, threshold, l, r, value, cover FROM leafs),
 known AS (SELECT * FROM (VALUES (0), (1), (2), (3)) AS v(s)), x AS (SELECT DISTINCT price, cust FROM r),
 walk AS (SELECT price, cust, s, n.tree, n.node, CAST(1 AS DOUBLE) AS w FROM x, known, nodes n WHERE n.node = 1
 UNION ALL
 SELECT price, cust, s, t.tree, c.node, t.w * CASE WHEN (s >> n.feature) & 1 = 0 THEN c.cover / n.cover ELSE 1 END
 FROM walk t JOIN nodes n ON n.tree = t.tree AND n.node = t.node AND n.feature >= 0 JOIN nodes c ON c.tree = t.tree AND c.node IN (n.l, n.r)
 WHERE (s >> n.feature) & 1 = 0 OR (CASE WHEN n.feature = 0 THEN price ELSE cust END <= n.threshold) = (c.node = n.l)),
 v AS (SELECT price, cust, s, sum(t.w * n.value) AS v FROM walk t JOIN nodes n ON n.tree = t.tree AND n.node = t.node AND n.feature < 0 GROUP BY ALL),
 q AS (SELECT price, cust, max(v) FILTER (s = 0) AS v0, max(v) FILTER (s = 1) AS v1, max(v) FILTER (s = 2) AS v2, max(v) FILTER (s = 3) AS v3 FROM v GROUP BY ALL),
 p AS (SELECT o_orderkey, (SELECT base FROM a_b) + v0 AS base_value, (v1 - v0 + v3 - v2) / 2 AS price, (v2 - v0 + v3 - v1) / 2 AS cust FROM r JOIN q ON q.price = r.price AND q.cust = r.cust)"""


@_query(f"WITH RECURSIVE {_shap_sql(3)} SELECT o_orderkey, round(base_value, 6) AS base_value, round(price, 6) AS price, round(cust, 6) AS cust, 'ok' AS shap_status FROM p")
def tree_shap(spark, d):
    """Attributions of grown trees, against trees grown and averaged over orders of features in SQL."""
    rows = _shap_rows(spark, d)
    models = model.Regressors.train(rows, features=["price", "cust"], arousal="y", exertion="y", trees=3, subsample=1.0, **BOOST)
    out = model.explain(rows, models.arousal, ["price", "cust"], ["o_orderkey"])
    return _six(out.select("o_orderkey", "base_value", F.col("shap")[0].alias("price"), F.col("shap")[1].alias("cust"), "shap_status"))


@_query(f"""WITH RECURSIVE {_shap_sql(2)}, s AS (SELECT o_orderkey, 'price' || CASE WHEN price > 0 THEN '↑' ELSE '↓' END || '(' || printf('%+.3f', price) || ')' AS a, 'cust' || CASE WHEN cust > 0 THEN '↑' ELSE '↓' END || '(' || printf('%+.3f', cust) || ')' AS b, abs(price) >= abs(cust) AS first FROM p)
 SELECT o_orderkey, CASE WHEN first THEN a || ' | ' || b ELSE b || ' | ' || a END AS shap_reason FROM s""")
def classify_with_shap(spark, d):
    """States with what drove each score."""
    rows = _shap_rows(spark, d)
    models = model.Regressors.train(rows, features=["price", "cust"], arousal="y", exertion="y", trees=2, subsample=1.0, **BOOST)
    return rules.classify_with_shap(models.predict(rows, add_shap=True)).select("o_orderkey", "shap_reason")


#: Two stated trees over price (0) and cust (1): tree, weight, node, feature (-1: a leaf), threshold, left, right, value, cover.
FOREST = [
    (0, 1.0, 0, 0, 150000.0, 1, 2, 0.0, 10.0), (0, 1.0, 1, 1, 50.0, 3, 4, 0.0, 6.0), (0, 1.0, 2, 0, 300000.0, 5, 6, 0.0, 4.0), (0, 1.0, 3, -1, 0.0, -1, -1, 0.25, 2.0), (0, 1.0, 4, -1, 0.0, -1, -1, 0.5, 4.0), (0, 1.0, 5, 1, 20.0, 7, 8, 0.0, 3.0),
    (0, 1.0, 6, -1, 0.0, -1, -1, 2.0, 1.0), (0, 1.0, 7, -1, 0.0, -1, -1, -1.0, 1.0), (0, 1.0, 8, -1, 0.0, -1, -1, 1.0, 2.0), (1, 0.5, 0, 1, 70.0, 1, 2, 0.0, 8.0), (1, 0.5, 1, -1, 0.0, -1, -1, 3.0, 6.0), (1, 0.5, 2, -1, 0.0, -1, -1, -2.0, 2.0),
]
NODES = ", ".join(str(r) for r in FOREST)


@_query(f"""WITH RECURSIVE nodes AS (SELECT * FROM (VALUES {NODES}) AS v(tree, weight, node, feature, threshold, l, r, value, cover)),
 x AS (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS price, CAST(o_custkey % 100 AS DOUBLE) AS cust FROM orders), known AS (SELECT * FROM (VALUES (0), (1), (2), (3)) AS v(s)),
 walk AS (SELECT o_orderkey, price, cust, s, n.tree, n.node, CAST(1 AS DOUBLE) AS w FROM x, known, nodes n WHERE n.node = 0
 UNION ALL
 SELECT o_orderkey, price, cust, s, t.tree, c.node, t.w * CASE WHEN (s >> n.feature) & 1 = 0 THEN c.cover / n.cover ELSE 1 END
 FROM walk t JOIN nodes n ON n.tree = t.tree AND n.node = t.node AND n.feature >= 0 JOIN nodes c ON c.tree = t.tree AND c.node IN (n.l, n.r)
 WHERE (s >> n.feature) & 1 = 0 OR (CASE WHEN n.feature = 0 THEN price ELSE cust END <= n.threshold) = (c.node = n.l)),
 v AS (SELECT o_orderkey, s, sum(t.w * n.value * n.weight) AS v FROM walk t JOIN nodes n ON n.tree = t.tree AND n.node = t.node AND n.feature < 0 GROUP BY ALL),
 p AS (SELECT o_orderkey, max(v) FILTER (s = 0) AS v0, max(v) FILTER (s = 1) AS v1, max(v) FILTER (s = 2) AS v2, max(v) FILTER (s = 3) AS v3 FROM v GROUP BY ALL)
 SELECT o_orderkey, round(v0, 6) AS base_value, round((v1 - v0 + v3 - v2) / 2, 6) AS price, round((v2 - v0 + v3 - v1) / 2, 6) AS cust FROM p""")
def forest_shap(spark, d):
    """Attributions of a stated forest, against the average over orders of features."""
    from cadence.operators.model import explain_forest

    rows = _table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("price"), (F.col("o_custkey") % 100).cast("double").alias("cust"))
    keys = ("feature", "threshold", "left", "right", "value", "cover")
    forest = [(w, [dict(zip(keys, r[3:], strict=True)) for r in FOREST if r[0] == t]) for t, w in sorted({(r[0], r[1]) for r in FOREST})]
    return _six(explain_forest(rows, forest, ["price", "cust"], ["o_orderkey"]).select("o_orderkey", "base_value", F.col("shap")[0].alias("price"), F.col("shap")[1].alias("cust")))


@_query(f"SELECT 'registry' AS tbl, {ID} AS speaker_id, (vec_id % 40 + 1)::DOUBLE AS n, CAST(NULL AS VARCHAR) AS possible_match FROM embeddings WHERE vec_id <> 9 UNION ALL SELECT 'baselines', {ID}, (vec_id + 1)::DOUBLE, NULL FROM embeddings WHERE vec_id <> 9")
def registry_cascade(spark, d):
    return _cascade(spark, d)


@_query(f"SELECT {ID} AS speaker_id, CASE WHEN vec_id = 4 THEN 'Ann' ELSE replace({ID}, 'persist', 'auto_spk') END AS label, vec_id = 4 AS registered FROM embeddings")
def registry_rename(spark, d):
    return registry.rename(_registry(spark, d), "persist_005", " Ann ").select("speaker_id", "label", "registered")


@_query(f"SELECT vec_id AS position, {ID} AS speaker_id FROM embeddings")
def registry_ids(spark, d):
    return registry.speaker_ids(_registry(spark, d)).select(F.col("position").cast("long").alias("position"), "speaker_id")


@_query(f"""WITH s AS (SELECT vec_id, {ID} AS speaker_id, replace({ID}, 'persist', 'auto_spk') AS label, vec_id % 40 + 1 AS n FROM embeddings)
 SELECT speaker_id, label, n AS n_samples, CASE WHEN n <= 5 THEN 'cold' WHEN n <= 30 THEN 'warm' WHEN 14 + vec_id > 30 THEN 'stale' ELSE 'stable' END AS stage,
 CASE WHEN vec_id % 5 = 0 THEN '0.0500' ELSE printf('%.4f', (vec_id % 5 + 1) / 20.0) END AS avg_similarity, TIMESTAMP '2024-01-01' AS first_seen, TIMESTAMP '2024-03-01' - to_days(CAST(vec_id AS INTEGER)) AS last_seen,
 speaker_id || ' (' || label || ')' AS choice FROM s""")
def registry_table(spark, d):
    return registry.display(_registry(spark, d), F.lit("2024-03-15 00:00:00").cast("timestamp"))


@_query(f"SELECT {ID} AS speaker_id, vec_id % 40 + 1 AS n_samples, TIMESTAMP '2024-03-01' - to_days(CAST(vec_id AS INTEGER)) AS last_seen, embedding[64]::DOUBLE AS c64 FROM embeddings WHERE vec_id % 2 = 0")
def registry_round_trip(spark, d):
    """Saved whole, then as half of it, then not at all since nothing changed."""
    path, known = tables.scratch_path(spark, "registry"), _registry(spark, d)
    tables.save_registry(known, path)
    tables.save_registry(known.where("(insert_no - 1) % 2 = 0"), path)
    tables.save_registry(known.where("false"), path, dirty=False)
    return tables.load_registry(spark, path).select("speaker_id", "n_samples", "last_seen", F.col("centroid")[63].alias("c64"))


@_query(f"""WITH {SEG}, k AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY event_id) AS k, count(*) OVER (PARTITION BY file) AS c FROM seg),
 w AS (SELECT file, arousal, CASE WHEN k > 200 THEN pow(200.0 / 201, c - greatest(k, 200)) ELSE pow(200.0 / 201, greatest(0, c - 200)) END AS w FROM k)
 SELECT file AS speaker_id, round(sum(w), 6) AS n, round(sum(w * arousal), 6) AS sum_a, round(sum(w * arousal * arousal), 6) AS sum_sq_a, 200 AS max_n FROM w GROUP BY file""")
def baseline_round_trip(spark, d):
    path = tables.scratch_path(spark, "baselines")
    tables.save_baselines(baseline.final_state(_segments(spark, d), speaker="file", order_by="event_id"), path)
    return _six(tables.load_baselines(spark, path))


@_query(ORACLE_SQL["align_fallback"])
def aligner_round_trip(spark, d):
    rows = _table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    path = tables.scratch_path(spark, "aligner")
    tables.save_aligner(align.fit(rows, speaker="o_custkey", features=["o_totalprice"]), path)
    return _six(align.align(rows, speaker="o_custkey", features=["o_totalprice"], aligner=tables.load_aligner(spark, path)).drop("o_custkey"))


@_query("""WITH b AS (SELECT 'C' || o_custkey AS spk, avg(o_totalprice::DOUBLE) AS m, count(*) AS n FROM orders GROUP BY 1) SELECT spk AS speaker, 'o_totalprice' AS feature, n, round(m, 6) AS mean, n < 3 AS use_global FROM b
 UNION ALL SELECT NULL, 'o_totalprice', NULL, round(avg(o_totalprice::DOUBLE), 6), false FROM orders""")
def aligner_json(spark, d):
    """The document of an earlier tool, made here from a fit, read back as rows."""
    rows = _table(spark, d, "orders").select(F.concat(F.lit("C"), F.col("o_custkey")).alias("spk"), F.col("o_totalprice").cast("double").alias("o_totalprice"))
    fitted = align.fit(rows, speaker="spk", features=["o_totalprice"])
    figures = lambda: F.struct(F.create_map("feature", "mean").alias("mean"), F.create_map("feature", "std").alias("std"), "n", "use_global")
    own = fitted.where("speaker is not null").agg(F.map_from_entries(F.collect_list(F.struct("speaker", figures()))).alias("baselines"))
    every = fitted.where("speaker is null").select(figures().alias("global"))
    text = own.crossJoin(every).select(F.to_json(F.struct(F.array(F.lit("o_totalprice")).alias("feature_cols"), "global", "baselines")).alias("value"))
    path = tables.scratch_path(spark, "aligner-json")
    text.coalesce(1).write.text(path)
    return tables.aligner_from_json(spark, path).select("speaker", "feature", "n", F.round("mean", 6).alias("mean"), "use_global")


@_query(f"WITH {SEG} SELECT CAST(event_id AS VARCHAR) AS event_id, file, printf('%.6f', arousal) AS arousal FROM seg")
def csv_round_trip(spark, d):
    """Written with a byte order mark, which the reader takes off again."""
    path = tables.scratch_path(spark, "csv")
    tables.write_states_csv(_segments(spark, d).select("event_id", "file", F.format_string("%.6f", "arousal").alias("arousal")), path)
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    return rows.select(*[F.col(f"`{c}`").alias(c.lstrip("\ufeff").strip('"')) for c in rows.columns])


@_query(f"WITH {SEG} SELECT file AS trace_id, '2024-05-01' AS date, count(*) AS n_segments, round(avg(arousal), 6) AS arousal_mean FROM seg GROUP BY file")
def trace_round_trip(spark, d):
    found = _segments(spark, d).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.avg("arousal").alias("a")).collect()  # a record for each request
    path = tables.scratch_path(spark, "trace")
    tables.append_trace(spark, [{"trace_id": r["file"], "date": "2024-05-01", "n_segments": r["n"], "arousal_mean": r["a"], "timing_ms": {"total_ms": 1.0}} for r in found], path)
    return _six(spark.read.schema("trace_id string, date string, n_segments long, arousal_mean double").json(path).select("trace_id", F.col("date").cast("string").alias("date"), "n_segments", "arousal_mean"))


REPORT_SQL = f"""WITH u AS ({CONTRIB}), g AS (SELECT feature, min(pos) AS pos, avg(abs(c)) AS c, CASE WHEN corr(c, v) > 0 THEN '+' ELSE '-' END AS direction FROM u GROUP BY feature),
 t AS (SELECT l_tax::DOUBLE AS y, l_discount::DOUBLE AS p FROM lineitem),
 k AS (SELECT row_number() OVER (ORDER BY c DESC, pos) AS rank, * FROM g), tasks AS (SELECT unnest(['arousal', 'exertion']) AS task),
 e AS (SELECT l_discount::DOUBLE - l_tax::DOUBLE AS x FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount, l_tax LIMIT 500)
 SELECT 'metrics' AS sheet, 'ccc' AS item, round(2 * covar_pop(y, p) / (var_pop(y) + var_pop(p) + (avg(y) - avg(p)) * (avg(y) - avg(p))), 6) AS x FROM t
 UNION ALL SELECT 'metrics', 'mae', round(avg(abs(y - p)), 6) FROM t UNION ALL SELECT 'metrics', 'n', count(*) FROM t
 UNION ALL SELECT 'shap_' || task, rank || ' ' || feature || ' ' || direction, round(c, 6) FROM k, tasks
 UNION ALL SELECT 'groups_' || task, 'other', round(sum(c), 6) FROM k, tasks GROUP BY task
 UNION ALL SELECT 'predictions', 'n', count(*) FROM e UNION ALL SELECT 'predictions', 'error_arousal', round(sum(x), 6) FROM e UNION ALL SELECT 'predictions', 'error_exertion', round(sum(x), 6) FROM e
 UNION ALL SELECT 'parameters', 'trees', 300 UNION ALL SELECT 'parameters', 'depth', 6"""


@_query(REPORT_SQL)
def training_report(spark, d):
    """What the seven written sheets hold."""
    ranked = metrics.global_importance(_contrib(spark, d))
    keys = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_tax")
    pairs = _table(spark, d, "lineitem").select(keys.alias("k"), *[F.col(c).cast("double").alias(n) for c, n in (("l_tax", "true_arousal"), ("l_discount", "pred_arousal"), ("l_tax", "true_exertion"), ("l_discount", "pred_exertion"))])
    frames = report.training_report(metrics.metric_pack(pairs, "true_arousal", "pred_arousal"), {"arousal": ranked, "exertion": ranked}, pairs, {"trees": 300, "depth": 6}, order_by="k")
    path = tables.scratch_path(spark, "report")
    tables.write_report(frames, path)
    sheet = {name: spark.read.parquet(f"{path}/{name}") for name in frames}

    def items(name: str, df: DataFrame, **values) -> DataFrame:
        return df.select(F.explode(F.array(*[F.struct(F.lit(name).alias("sheet"), F.lit(k).alias("item"), v.cast("double").alias("x")) for k, v in values.items()])).alias("r")).select("r.*")

    out = items("metrics", sheet["metrics"], ccc=F.col("ccc"), mae=F.col("mae"), n=F.col("n"))
    for task in ("arousal", "exertion"):
        out = out.unionByName(sheet[f"shap_{task}"].select(F.lit(f"shap_{task}").alias("sheet"), F.concat_ws(" ", F.col("rank").cast("string"), "feature", "direction").alias("item"), F.col("contribution").alias("x")))
        out = out.unionByName(sheet[f"groups_{task}"].select(F.lit(f"groups_{task}").alias("sheet"), F.col("grp").alias("item"), F.col("contribution").alias("x")))
    sums = sheet["predictions"].agg(F.count(F.lit(1)).alias("n"), F.sum("error_arousal").alias("error_arousal"), F.sum("error_exertion").alias("error_exertion"))
    out = out.unionByName(items("predictions", sums, **{c: F.col(c) for c in sums.columns}))
    return _six(out.unionByName(sheet["parameters"].select(F.lit("parameters").alias("sheet"), F.col("parameter").alias("item"), F.col("value").cast("double").alias("x"))))


def _wavs(spark, d):
    path = tables.scratch_path(spark, "wavs")
    rows = _table(spark, d, "embeddings").select(F.format_string("%d.wav", "vec_id").alias("name"), F.col("embedding").alias("samples"))
    return path, tables.write_wav(rows, path.removeprefix("file:"))


@_query("SELECT CAST(vec_id AS VARCHAR) || '.wav' AS name, CAST(44 + 2 * len(embedding) AS BIGINT) AS n_bytes FROM embeddings")
def wav_files(spark, d):
    path, written = _wavs(spark, d)
    found = tables.audio_files(spark, path)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.length("content").cast("long").alias("n_bytes"))


@_query("SELECT vec_id, len(embedding) AS n, 16000 AS sample_rate, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(trunc(x * 32767) AS DOUBLE) / 32768)), 5) AS total FROM embeddings")
def decoded_audio(spark, d):
    """Written as WAV files, scanned and decoded again."""
    path, _ = _wavs(spark, d)
    rows = providers.with_decoded(tables.audio_files(spark, path), "content").where("error is null")
    no = F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("long")
    return rows.select(no.alias("vec_id"), F.size("samples").cast("long").alias("n"), "sample_rate", F.round(F.aggregate("samples", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"))


@_query("SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, 16000 AS sample_rate, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(trunc(x * 32767) AS DOUBLE) / 32768)), 5) AS total FROM embeddings")
def recording_ranges(spark, d):
    """Written all or none and read again by ranges of 64 bytes, in pieces of 16 samples."""
    path = tables.scratch_path(spark, "recordings")
    recordings.write(_table(spark, d, "embeddings").select(F.format_string("%d.wav", "vec_id").alias("name"), F.col("embedding").alias("samples")), path)
    pieces = recordings.read(spark, path, range_mb=64 / 2**20, chunk_sec=0.001)
    no = F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("long")
    sums = F.sum(F.aggregate("samples", F.lit(0.0), lambda s, x: s + x.cast("double")))
    return pieces.where("error is null").groupBy(no.alias("vec_id"), "sample_rate").agg(F.sum("n").alias("n"), F.round(sums, 5).alias("total"))


@_query("SELECT count(*) FILTER (vec_id % 3 = 0) AS success, count(*) FILTER (vec_id % 3 <> 0) AS failed FROM embeddings")
def error_counts(spark, d):
    path, _ = _wavs(spark, d)
    files = tables.audio_files(spark, path).withColumn("no", F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("long"))
    broken = files.withColumn("content", F.when(F.col("no") % 3 == 0, F.col("content")).otherwise(F.lit(b"broken")))
    return providers.outcomes(providers.with_decoded(broken, "content"), "path")[0]


@_query("SELECT doc_id, lang, source, n_chars FROM documents")
def metadata_scan(spark, d):
    return tables.training_metadata(spark, f"{d}/documents.parquet", "text")


@_query("SELECT count(*) AS n FROM lineitem")
def scan_counts(spark, d):
    return tables.file_counts(spark, f"{d}/lineitem.parquet").agg(F.sum("n").alias("n"))


@_query("SELECT l_tax::DOUBLE AS l_tax, l_quantity::DOUBLE AS l_quantity FROM lineitem")
def realigned(spark, d):
    return realign(_lineitem(spark, d), ["l_tax", "l_quantity"])


@_query("SELECT 'segment_id,start_sec,speaker_label,l_linenumber' AS names, concat_ws(',', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS line, count(*) AS n FROM lineitem GROUP BY ALL")
def column_order(spark, d):
    """Each row as its columns stand, and their names."""
    rows = meta_first(_table(spark, d, "lineitem").select("l_linenumber", F.col("l_suppkey").alias("speaker_label"), F.col("l_orderkey").alias("segment_id"), F.col("l_partkey").alias("start_sec")))
    return rows.groupBy(F.lit(",".join(rows.columns)).alias("names"), F.concat_ws(",", *[F.col(c).cast("string") for c in rows.columns]).alias("line")).agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT vec_id, vec_id % 20 >= 0.3 * 32 AS long_enough FROM embeddings")
def min_length(spark, d):
    part = _table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, (F.col("vec_id") % 20).cast("int")).alias("audio"))
    return part.select("vec_id", gate.long_enough("audio", 0.3, 32).alias("long_enough"))


@_query(f"WITH {SEG} SELECT event_id, 'Ann' AS speaker FROM seg UNION ALL SELECT event_id, CAST(speaker AS VARCHAR) FROM seg")
def speaker_override(spark, d):
    seg = _segments(spark, d).select("event_id", F.col("speaker").cast("string").alias("speaker"))
    return end_to_end.union_frames([end_to_end.with_speaker(seg, "speaker", "Ann"), end_to_end.with_speaker(seg, "speaker", "unknown")])


@_query(f"SELECT vec_id, {ID} AS speaker_id FROM embeddings")
def display_ids(spark, d):
    shown = registry.display(_registry(spark, d)).select(scalar.display_to_id(F.col("choice")).alias("speaker_id"), F.col("speaker_id").alias("own"))
    return _registry(spark, d).select((F.col("insert_no") - 1).alias("vec_id"), F.col("speaker_id").alias("own")).join(shown, "own").select("vec_id", "speaker_id")


@_query("""WITH c AS (SELECT CAST(label AS VARCHAR) AS l, count(*) AS n FROM embeddings GROUP BY 1) SELECT count(*) AS n_speakers, sum(n)::BIGINT AS total, '{' || string_agg('"' || l || '":' || n, ',' ORDER BY l) || '}' AS segments FROM c""")
def cluster_counts(spark, d):
    return registry.cluster_counts(_table(spark, d, "embeddings"), "label").select("n_speakers", "total", F.to_json("segments_per_speaker").alias("segments"))


@_query(f"""WITH {SEG}, st AS (SELECT DISTINCT speaker, speaker % 120 AS n FROM seg), s AS (SELECT seg.*, n, (n - 30) / 70.0 AS t FROM seg JOIN st USING (speaker))
 SELECT event_id, round(CASE WHEN n < 30 THEN (arousal - 0.72) / 0.19 WHEN n < 100 THEN (arousal - (t * 0.5 + (1 - t) * 0.72)) / (t * 0.2 + (1 - t) * 0.19) ELSE (arousal - 0.5) / 0.2 END + 1.1e-8, 6) AS arousal_z,
 CASE WHEN n < 30 THEN 'low' WHEN n < 100 THEN 'medium' ELSE 'high' END AS baseline_conf FROM s""")
def stored_baseline(spark, d):
    """All rows against stored state that they don't change: means of 0.5 and deviations of 0.2."""
    n = (F.col("speaker") % 120).cast("double")
    state = _segments(spark, d).select("speaker").distinct().select(F.col("speaker").alias("speaker_id"), n.alias("n"), (n * 0.5).alias("sum_a"), (n * 0.29).alias("sum_sq_a"))
    return _six(baseline.process(_segments(spark, d), speaker="speaker", order_by="event_id", update=False, state=state).select("event_id", (F.col("arousal_z") + 1.1e-8).alias("arousal_z"), "baseline_conf"))


@_query("""WITH t AS (SELECT row_number() OVER () AS rid, l_orderkey, l_linenumber, l_quantity::DOUBLE / 50 - 0.50013 AS a, l_discount::DOUBLE * 10 - 0.50013 AS b, l_tax::DOUBLE * 12 - 0.50013 AS c FROM lineitem),
 u AS (SELECT rid, l_orderkey, l_linenumber, unnest(['a', 'b', 'c']) AS f, unnest([1, 2, 3]) AS i, unnest([a, b, c]) AS x FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY abs(x) DESC, i DESC) AS k FROM u)
 SELECT l_orderkey, l_linenumber, string_agg(f, ',' ORDER BY k) AS features, round(sum(x), 6) AS total FROM r WHERE k <= 2 GROUP BY rid, l_orderkey, l_linenumber""")
def topk_map(spark, d):
    t = _lineitem(spark, d).select("l_orderkey", "l_linenumber", *[(x - 0.50013).alias(n) for n, x in (("a", F.col("l_quantity") / 50), ("b", F.col("l_discount") * 10), ("c", F.col("l_tax") * 12))])
    m = metrics.top_map(["a", "b", "c"], 2)
    return _six(t.select("l_orderkey", "l_linenumber", F.array_join(F.map_keys(m), ",").alias("features"), F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x).alias("total")))


@_query("SELECT o_orderkey AS k, o_totalprice::DOUBLE AS price, CAST(NULL AS DOUBLE) AS tax FROM orders UNION ALL SELECT l_orderkey, l_extendedprice::DOUBLE, l_tax::DOUBLE FROM lineitem")
def union_of_frames(spark, d):
    a = _table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").cast("double").alias("price"))
    b = _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_tax").cast("double").alias("tax"), F.col("l_extendedprice").cast("double").alias("price"))
    return end_to_end.union_frames([a, b])


@_query("SELECT vec_id, 50 AS n, round(list_sum(list_slice(list_concat(CAST(embedding AS DOUBLE[]), list_reverse(CAST(embedding AS DOUBLE[]))), 79, 128)), 6) AS total FROM embeddings")
def history_tail(spark, d):
    h = vector.tail(F.concat("embedding", F.reverse("embedding")), 50)
    return _six(_table(spark, d, "embeddings").select("vec_id", F.size(h).alias("n"), F.aggregate(h, F.lit(0.0), lambda s, x: s + x.cast("double")).alias("total")))


@_query(f"SELECT unnest([{', '.join(repr(n) for n in taxonomy.core_features())}]) AS feature")
def core_set(spark, d):
    names = taxonomy.names_frame(spark)
    return names.where(taxonomy.is_core(F.col("name"))).select(F.col("name").alias("feature")).distinct()


@_query("SELECT unnest(['l_missing', 'l_other']) AS feature")
def missing_columns(spark, d):
    try:
        realign(_lineitem(spark, d), ["l_tax", "l_missing", "l_other"])
    except KeyError as e:
        return spark.createDataFrame([(n,) for n in str(e.args[0]).removeprefix("missing features: ").split(", ")], "feature string")
    raise AssertionError("nothing was missing")


@_query("SELECT 'user_' || user_id AS speaker_id, CAST(count(*) AS DOUBLE) AS n, 0.0::DOUBLE AS sum_a FROM events GROUP BY user_id")
def json_defaults(spark, d):
    """A baseline document that lacks sums, as nested text."""
    by = _table(spark, d, "events").groupBy(F.concat(F.lit("user_"), F.col("user_id")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    text = by.agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("n")))).alias("speakers")).select(F.to_json(F.struct("speakers")).alias("value"))
    path = tables.scratch_path(spark, "json")
    text.coalesce(1).write.text(path)
    return tables.baselines_from_json(spark, path).select("speaker_id", "n", "sum_a")


@_query(f"SELECT {ID} AS speaker_id, vec_id % 7 AS n_samples, round(embedding[1]::DOUBLE, 6) AS c1, false AS registered FROM embeddings")
def registry_json(spark, d):
    rows = _registry(spark, d).select("speaker_id", F.struct("label", F.col("centroid"), ((F.col("insert_no") - 1) % 7).alias("n_samples")).alias("s"))
    text = rows.agg(F.map_from_entries(F.collect_list(F.struct("speaker_id", "s"))).alias("speakers")).select(F.to_json(F.struct(F.lit(1).alias("version"), "speakers")).alias("value"))
    path = tables.scratch_path(spark, "json")
    text.coalesce(1).write.text(path)
    return _six(tables.registry_from_json(spark, path).select("speaker_id", "n_samples", F.col("centroid")[0].alias("c1"), "registered"))


@_query("SELECT vec_id, CAST(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(trunc(x * 32767) AS BIGINT))) AS BIGINT) AS total FROM embeddings")
def pcm_casts(spark, d):
    pcm = scalar.pcm16(F.transform("embedding", lambda x: x.cast("double")))
    return _table(spark, d, "embeddings").select("vec_id", F.aggregate(pcm, F.lit(0).cast("long"), lambda s, x: s + x.cast("long")).alias("total"))


@_query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linenumber % 2 = 0 THEN l_tax::DOUBLE ELSE 1 / (1 + exp(-(0.4 * l_discount::DOUBLE + 0.4 * l_tax::DOUBLE - 0.2 * l_quantity::DOUBLE / 50))) END, 6) AS y FROM lineitem")
def label_choice(spark, d):
    """The given label, or the voice-quality proxy where there is none."""
    names = {"jitterLocal_sma3nz_amean": F.col("l_discount"), "shimmerLocaldB_sma3nz_amean": F.col("l_tax"), "HNRdBACF_sma3nz_amean": F.col("l_quantity") / 50, "lab": F.when(F.col("l_linenumber") % 2 == 0, F.col("l_tax"))}
    rows = _lineitem(spark, d).withColumns(names)
    return _six(model.label_exertion(rows, [n for n in names if n != "lab"], "lab").select("l_orderkey", "l_linenumber", F.col("_y_exertion").alias("y")))


@_query("SELECT vec_id, len(embedding) AS n, true AS same, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: x * i)), 6) AS moment FROM embeddings")
def resample_identity(spark, d):
    rows = _table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("samples"), F.lit(16000).alias("sample_rate"))
    back = providers.at_rate(rows).join(rows.select("vec_id", F.col("samples").alias("own")), "vec_id")
    moment = F.aggregate(F.transform("samples", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return _six(back.select("vec_id", F.size("samples").cast("long").alias("n"), (F.col("samples") == F.col("own")).alias("same"), moment.alias("moment")))


@_query(f"WITH {SEG}, {LIM} SELECT event_id, {STATE} FROM seg, lim")
def result_facade(spark, d):
    """From a path of scored rows to states, as one call."""
    path = tables.scratch_path(spark, "scores")
    _segments(spark, d).write.parquet(path)
    return end_to_end.classify_results(path).select("event_id", "state", "confidence")
