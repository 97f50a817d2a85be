"""Two gradient-boosted regressors, prediction, and exact tree attributions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.functions.scalar import clip01, exertion_proxy, fatigue_probability
from cadence.operators import boosting, metrics


def label_exertion(df: DataFrame, features: list[str], label: str | None) -> DataFrame:
    """``_y_exertion``: the label where there is one, else the voice-quality proxy."""
    pick = lambda part: next((F.col(f"`{f}`") for f in features if part in f), F.lit(0.0))
    proxy = exertion_proxy(pick("jitterLocal"), pick("shimmerLocaldB"), pick("HNRdBACF"))
    return df.withColumn("_y_exertion", F.coalesce(F.col(label).cast("double"), proxy) if label else proxy)


class Regressors:
    """Arousal and exertion models over one ordered feature list, and the space (raw or z) they were fitted in."""

    def __init__(self, features: list[str], arousal: boosting.Forest, exertion: boosting.Forest, input_space: str = "raw"):
        self.features, self.arousal, self.exertion, self.input_space = features, arousal, exertion, input_space

    @classmethod
    def train(cls, df: DataFrame, *, features: list[str], arousal: str, exertion: str | None = None, input_space: str = "raw", trees: int = 200, depth: int = 6, rate: float = 0.05, subsample: float = 0.8, seed: int = 42, **more) -> Regressors:
        """Both models grow in the same passes; rows with a missing feature or target are left out."""
        rows = label_exertion(df, features, exertion).withColumn("_y_arousal", F.col(arousal).cast("double"))
        grown = boosting.train(rows, features, ["_y_arousal", "_y_exertion"], trees=trees, depth=depth, rate=rate, subsample=subsample, seed=seed, **more)
        return cls(features, grown["_y_arousal", None], grown["_y_exertion", None], input_space)

    def predict(self, df: DataFrame, *, input_space: str | None = None, add_shap: bool = False) -> DataFrame:
        """``df`` with ``arousal, exertion, fatigue_prob``; other columns stay. With ``add_shap`` also ``shap_arousal_*``, ``shap_exertion_*``, the attributions of both scores by feature, and ``shap_status``."""
        if input_space and input_space != self.input_space:
            raise ValueError(f"the models were fitted on {self.input_space} features, not {input_space}")
        missing = [f for f in self.features if f not in df.columns]
        if missing:
            raise KeyError(f"missing features: {', '.join(missing)}")
        rows = boosting.scored(df, self.features, {"_a": self.arousal, "_e": self.exertion})
        shap = []
        if add_shap:
            both = {"_a": self.arousal.trees, "_e": self.exertion.trees}
            rows = boosting.explained(rows, self.features, both, {n: expected(t) for n, t in both.items()})
            shap = [F.col(f"{n}_shap")[i].alias(f"shap_{name}_{f}") for n, name in (("_a", "arousal"), ("_e", "exertion")) for i, f in enumerate(self.features)] + [F.col("shap_status")]
        return rows.select(*[F.col(f"`{c}`") for c in df.columns], clip01(F.col("_a")).alias("arousal"), clip01(F.col("_e")).alias("exertion"), fatigue_probability(F.col("_a")).alias("fatigue_prob"), *shap)

    def save(self, path: str) -> None:
        from pyspark.sql import SparkSession

        text = json.dumps({"features": self.features, "input_space": self.input_space, "arousal": self.arousal.to_dict(), "exertion": self.exertion.to_dict()})
        SparkSession.active().createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, path: str) -> Regressors:
        from pyspark.sql import SparkSession

        d = json.loads(SparkSession.active().read.text(path).first()["value"])
        return cls(d["features"], boosting.Forest.from_dict(d["arousal"]), boosting.Forest.from_dict(d["exertion"]), d["input_space"])


def expected_value(nodes: list[dict], at: int = 0) -> float:
    n = nodes[at]
    if n["feature"] < 0:
        return n["value"]
    a, b = nodes[n["left"]], nodes[n["right"]]
    return (a["cover"] * expected_value(nodes, n["left"]) + b["cover"] * expected_value(nodes, n["right"])) / (a["cover"] + b["cover"])


def expected(forest: list[tuple[float, list[dict]]]) -> float:
    """The forest's mean over its training rows, to which attributions add."""
    return sum(w * expected_value(t) for w, t in forest)


def explain(df: DataFrame, model: boosting.Forest, features: list[str], id_cols: list[str]) -> DataFrame:
    """``id_cols, base_value, shap`` (one value per feature, in order) and ``shap_status``; values and base add up to the prediction."""
    return explain_forest(df, model.trees, features, id_cols)


def explain_forest(df: DataFrame, forest: list[tuple[float, list[dict]]], features: list[str], id_cols: list[str]) -> DataFrame:
    """:func:`explain` for weights and nodes of trees."""
    rows = df.select(*id_cols, *[F.col(f"`{f}`") for f in features if f not in id_cols])
    out = boosting.explained(rows, features, {"_x": forest}, {"_x": expected(forest)})
    return out.select(*id_cols, F.col("_x_base").alias("base_value"), F.col("_x_shap").alias("shap"), "shap_status")


def tree_table(spark, model: boosting.Forest) -> DataFrame:
    """The model as rows ``tree, weight, node, feature, threshold, left, right, value, cover``; leaves have no feature, and the first tree is the base value."""
    rows = [(t, w, i, n["feature"] if n["feature"] >= 0 else None, n["threshold"], n["left"], n["right"], n["value"], n["cover"]) for t, (w, nodes) in enumerate(model.trees) for i, n in enumerate(nodes)]
    return spark.createDataFrame(rows, "tree int, weight double, node int, feature int, threshold double, left int, right int, value double, cover double")


_loaded: dict[tuple[str, str], Regressors] = {}


def get_models(path: str) -> Regressors:
    """The models at a path, read once for each application."""
    from pyspark.sql import SparkSession

    key = (SparkSession.active().sparkContext.applicationId, path)
    if key not in _loaded:
        _loaded[key] = Regressors.load(path)
    return _loaded[key]


def cross_validate(df: DataFrame, *, features: list[str], speaker: str, fatigue: str, order_by: str, n_folds: int = 7, exertion: str | None = None, **training) -> DataFrame:
    """Leave one speaker out: trained on ``1 - fatigue`` as arousal; ``fold, speaker, n_train, n_test`` and concordance and accuracy to four places. No figure here depends on ``exertion``.

    The folds' models grow side by side, in the same passes over rows that are binned once, and each held-out row is scored by its own fold's.
    """
    folds = metrics.loso_folds(df, speaker, order_by, n_folds).collect()  # at most ``n_folds``
    table = df.sparkSession.createDataFrame([(r["speaker"], r["fold"]) for r in folds], T.StructType([T.StructField("_who", df.schema[speaker].dataType), T.StructField("_held", T.IntegerType())]))
    rows = df.withColumn("_target", 1 - F.col(fatigue).cast("double")).join(F.broadcast(table), F.col(speaker) == F.col("_who"), "left").drop("_who")
    grown = boosting.train(rows, features, ["_target"], fold="_held", folds=[r["fold"] for r in folds], **training)
    first = grown["_target", folds[0]["fold"]]
    held = rows.where(F.col("_held").isNotNull()).select("_held", "_target", fatigue, *[F.col(f"`{f}`") for f in features if f != fatigue])
    got = boosting.scored(held, features, {"_p": first}, ("_held", {r["fold"]: grown["_target", r["fold"]] for r in folds})).withColumn("_a", clip01(F.col("_p")))
    right = (fatigue_probability(F.col("_p")) > 0.5) == (F.col(fatigue) > 0.5)
    scores = got.groupBy(F.col("_held").alias("fold")).agg(F.round(metrics.ccc("_target", "_a"), 4).alias("ccc"), F.round(F.avg(right.cast("int")), 4).alias("accuracy"))
    sizes = df.sparkSession.createDataFrame([(r["fold"], str(r["speaker"]), r["n_train"], r["n_test"]) for r in folds], "fold int, speaker string, n_train long, n_test long")
    return sizes.join(scores, "fold")
