"""Training and search queries (E14-E16, M1 b); models are not bit-comparable, so
these are checked on rows and invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from quill.operators import prep as pp
from quill.operators import train as tr
from quill.plans.catalog import query
from quill.sources.tables import table


def splits(spark, d):
    lab = table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    sp = pp.stratified_split(lab, "label", "doc_id").join(docs, "doc_id")
    return (sp.filter("split = 'train'"), sp.filter("split = 'validation'"), sp.filter("split = 'test'"))


@query("train_lr", None)
def q_train_lr(spark, d):
    train, _, test = splits(spark, d)
    model = tr.train_lr(train)
    return spark.createDataFrame([("f1_weighted_test", float(tr.evaluate(model, test)))], "metric string, value double")


@query("score_lr", None)
def q_score_lr(spark, d):
    train, _, _ = splits(spark, d)
    model = tr.train_lr(train)
    docs = table(spark, d, "documents").select("doc_id", "text")
    return tr.score_lr(model, docs).select("doc_id", F.col("sentiment.label").alias("label"),
                                           F.col("sentiment.score").alias("score"))


@query("grid_search", None)
def q_grid_search(spark, d):
    train, valid, _ = splits(spark, d)
    trials = tr.grid_search(spark, train, valid, {"reg_param": [0.0, 0.01, 0.1, 0.3], "max_iter": [20, 50]})
    best = tr.best_trial(trials).select(F.lit(-1).cast("bigint").alias("trial"), F.concat(F.lit("best "), "params").alias("params"), "score")
    return trials.unionByName(best)


@query("random_search", None)
def q_random_search(spark, d):
    train, valid, _ = splits(spark, d)
    return tr.random_search(spark, train, valid, {"reg_param": (0.0, 0.3), "max_iter": [20, 50]}, seed=42)
