"""Training a text classifier with Spark ML (E14-E16, M1 b).

The reference fine-tunes a transformer; here the same workflow -- train,
keep the best model by weighted F1, grid or random search over settings --
runs as a Spark ML pipeline, distributed over the training rows.
"""

from __future__ import annotations

import random

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quill.functions import vectors as vx
from quill.operators import multifit as mf
from quill.session import staged


def text_features(num_features: int = 1 << 16) -> Pipeline:
    """Words, hashed term counts, inverse document frequency."""
    tok = RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False)
    tf = HashingTF(inputCol="words", outputCol="tf", numFeatures=num_features)
    return Pipeline(stages=[tok, tf, IDF(inputCol="tf", outputCol="features")])


def classifier(reg_param: float = 0.0, max_iter: int = 50, elastic_net: float = 0.0) -> LogisticRegression:
    return LogisticRegression(featuresCol="features", labelCol="label", regParam=reg_param, maxIter=max_iter,
                              elasticNetParam=elastic_net)


def text_pipeline(num_features: int = 1 << 16, **params) -> Pipeline:
    return Pipeline(stages=[*text_features(num_features).getStages(), classifier(**params)])


def f1_weighted() -> MulticlassClassificationEvaluator:
    return MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction", metricName="weightedFMeasure")


def train_lr(train: DataFrame, **params) -> PipelineModel:
    """Fit the pipeline on (text, label)."""
    return text_pipeline(**params).fit(train.withColumn("label", F.col("label").cast("double")))


def score_lr(model: PipelineModel, df: DataFrame) -> DataFrame:
    """M1 (b): class probabilities of a fitted pipeline, as the canonical sentiment struct."""
    out = model.transform(df.withColumn("label", F.lit(0.0)) if "label" not in df.columns else df)
    probs = vector_to_array("probability").cast("array<double>")
    return out.select(*[c for c in df.columns], probs.alias("probs")).withColumn(
        "sentiment", vx.label_from_probs(vx.collapse_to_three(F.col("probs"))))


def evaluate(model: PipelineModel, df: DataFrame) -> float:
    return f1_weighted().evaluate(model.transform(df.withColumn("label", F.col("label").cast("double"))))


class Trials:
    """Trials over one training and validation set.

    The term counts of a feature size are written once (checkpoint folder).  Trials of two classes that differ in penalty and iterations are
    fitted together (:mod:`quill.operators.multifit`), the others one by one.
    A failed trial scores -1.
    """

    def __init__(self, train: DataFrame, valid: DataFrame) -> None:
        as_double = F.col("label").cast("double")
        self.train, self.valid = (d.select("text", as_double.alias("label")) for d in (train, valid))
        self.ready: dict[int, tuple[DataFrame, DataFrame]] = {}

    def features(self, num_features: int) -> tuple[DataFrame, DataFrame]:
        """The texts are read and cut into words once; the weights of the terms come from the written counts."""
        if num_features not in self.ready:
            *counting, idf = text_features(num_features).getStages()
            counter = PipelineModel(counting)
            train, valid = (staged(counter.transform(d).select("tf", "label"), "term-counts") for d in (self.train, self.valid))
            model = idf.fit(train)
            self.ready[num_features] = tuple(model.transform(d).select("features", "label") for d in (train, valid))
        return self.ready[num_features]

    def score(self, params: dict) -> float:
        """One trial by itself."""
        rest = dict(params)
        try:
            train, valid = self.features(rest.pop("num_features", 1 << 16))
            return f1_weighted().evaluate(classifier(**rest).fit(train).transform(valid))
        except Exception:  # noqa: BLE001
            return -1.0

    def together(self, params: dict) -> bool:
        known = {"reg_param", "max_iter", "num_features", "elastic_net"}
        return set(params) <= known and not params.get("elastic_net") and params.get("reg_param", 0) >= 0 and params.get("max_iter", 50) > 0

    def scores(self, settings: list[dict]) -> list[float]:
        """All trials, in the order given."""
        out: dict[int, float] = {}
        labels = {r[0] for r in self.train.select("label").distinct().limit(3).collect()}
        groups: dict[int, list[int]] = {}
        for i, p in enumerate(settings):
            if labels == {0.0, 1.0} and self.together(p):
                groups.setdefault(p.get("num_features", 1 << 16), []).append(i)
            else:
                out[i] = self.score(p)
        for num_features, own in groups.items():
            train, valid = map(mf.sparse_rows, self.features(num_features))
            fits = mf.Fits(train, [settings[i].get("reg_param", 0.0) for i in own], [settings[i].get("max_iter", 50) for i in own])
            out |= zip(own, mf.f1_weighted(fits.confusion(valid)).tolist(), strict=True)
        return [out[i] for i in range(len(settings))]


def _rows(spark: SparkSession, settings: list[dict], trials: Trials) -> DataFrame:
    rows = [(i, str(sorted(c.items())), x) for i, (c, x) in enumerate(zip(settings, trials.scores(settings), strict=True))]
    return spark.createDataFrame(rows, "trial long, params string, score double")


def grid_search(spark: SparkSession, train: DataFrame, valid: DataFrame, grid: dict, max_trials: int | None = None) -> DataFrame:
    """Every combination of ``grid`` (capped at ``max_trials``, if given), one row per trial."""
    keys = sorted(grid)
    combos = [{}]
    for k in keys:
        combos = [dict(c, **{k: v}) for c in combos for v in grid[k]]
    return _rows(spark, combos[:max_trials], Trials(train, valid))


def random_search(spark: SparkSession, train: DataFrame, valid: DataFrame, space: dict, n_trials: int = 50,
                  seed: int = 42) -> DataFrame:
    """``n_trials`` settings sampled from ``space`` with a seeded generator."""
    rng = random.Random(seed)
    settings = [{k: (rng.choice(v) if isinstance(v, list) else rng.uniform(*v)) for k, v in sorted(space.items())}
                for _ in range(n_trials)]
    return _rows(spark, settings, Trials(train, valid))


def best_trial(trials: DataFrame) -> DataFrame:
    """The best trial by score (ties: lowest trial number)."""
    return trials.agg(F.max_by(F.struct("trial", "params", "score"), F.struct("score", -F.col("trial"))).alias("b")) \
        .select("b.*")
