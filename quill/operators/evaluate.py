"""Classifier evaluation over ``predictions(row_id, y_true, y_pred, probs)``.

Everything is derived from two small aggregates -- the confusion counts
``(y_true, y_pred, n)`` and, for ranking metrics, the distinct scores with
their positive/negative counts -- so the heavy work is one map-side
combined aggregation per metric family.  Ranks over scores use the
distributed prefix sums of :mod:`quill.operators.stats`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quill.operators.stats import running_sums


def confusion_counts(pred: DataFrame) -> DataFrame:
    return pred.groupBy("y_true", "y_pred").agg(F.count("*").cast("bigint").alias("n"))


def _classes(cc: DataFrame) -> DataFrame:
    return (cc.select(F.col("y_true").alias("cls")).union(cc.select(F.col("y_pred").alias("cls"))).distinct())


def per_class(pred: DataFrame) -> DataFrame:
    """E5: precision, recall, F1, support for every class seen in truth or prediction."""
    cc = confusion_counts(pred)
    tp = cc.filter(F.col("y_true") == F.col("y_pred")).select(F.col("y_true").alias("cls"), F.col("n").alias("tp"))
    t = cc.groupBy(F.col("y_true").alias("cls")).agg(F.sum("n").alias("support"))
    p = cc.groupBy(F.col("y_pred").alias("cls")).agg(F.sum("n").alias("predicted"))
    j = _classes(cc).join(tp, "cls", "left").join(t, "cls", "left").join(p, "cls", "left").fillna(0, ["tp", "support", "predicted"])
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    return j.select(F.col("cls").cast("int").alias("cls"), prec.alias("precision"), rec.alias("recall"), f1.alias("f1"),
                    F.col("support").cast("bigint").alias("support"))


def overall(pred: DataFrame) -> DataFrame:
    """Accuracy and F1 macro / weighted / micro (micro = accuracy for single-label)."""
    pc = per_class(pred)
    acc = pred.agg((F.count_if(F.col("y_true") == F.col("y_pred")) / F.count("*")).alias("accuracy"))
    return pc.agg(F.avg("f1").alias("f1_macro"),
                  F.coalesce(F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")), F.lit(0.0))
                  .alias("f1_weighted")).select(
        acc.select("accuracy").scalar().alias("accuracy"), "f1_macro", "f1_weighted",
        acc.select("accuracy").scalar().alias("f1_micro"))


def classification_report(pred: DataFrame) -> DataFrame:
    """Per-class rows plus 'accuracy', 'macro avg' and 'weighted avg' rows."""
    pc = per_class(pred)
    rows = pc.select(F.concat(F.lit("class_"), F.col("cls").cast("string")).alias("name"),
                     "precision", "recall", "f1", "support")
    n = pred.select(F.count("*")).scalar()
    acc = pred.select(F.count_if(F.col("y_true") == F.col("y_pred")) / F.count("*")).scalar()
    macro = pc.agg(F.lit("macro avg").alias("name"), F.avg("precision").alias("precision"),
                   F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.sum("support").cast("bigint").alias("support"))
    wavg = lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support")
    weighted = pc.agg(F.lit("weighted avg").alias("name"), wavg("precision").alias("precision"),
                      wavg("recall").alias("recall"), wavg("f1").alias("f1"), F.sum("support").cast("bigint").alias("support"))
    accuracy = pc.limit(1).select(F.lit("accuracy").alias("name"), F.lit(None).cast("double").alias("precision"),
                                  F.lit(None).cast("double").alias("recall"), acc.alias("f1"), n.alias("support"))
    return rows.unionByName(macro).unionByName(weighted).unionByName(accuracy)


def confusion_matrix(pred: DataFrame) -> DataFrame:
    """Every (true, predicted) class pair with its count and row-normalised share.

    The class list is the model's label set (small); pairs come from
    exploding it twice inside one row, not from a join.
    """
    cc = confusion_counts(pred)
    cls = _classes(cc).agg(F.array_sort(F.collect_set("cls")).alias("c"))
    grid = (cls.select(F.explode("c").alias("y_true"), "c").select("y_true", F.explode("c").alias("y_pred")))
    g = grid.join(cc, ["y_true", "y_pred"], "left").fillna(0, ["n"])
    rows = cc.groupBy("y_true").agg(F.sum("n").alias("row_n"))
    return (g.join(rows, "y_true", "left")
            .select(F.col("y_true").cast("int").alias("y_true"), F.col("y_pred").cast("int").alias("y_pred"),
                    F.col("n").cast("bigint").alias("n"),
                    F.coalesce(F.try_divide(F.col("n"), F.col("row_n")), F.lit(0.0)).alias("share")))


# --- ranking metrics ------------------------------------------------------------
def score_counts(df: DataFrame, group: list[str], score: Column, positive: Column) -> DataFrame:
    """Distinct (group, score) with positive / negative counts (map-side combined)."""
    return (df.select(*group, score.alias("score"), positive.alias("pos"))
            .groupBy(*group, "score").agg(F.count_if("pos").cast("bigint").alias("p"),
                                          F.count_if(~F.col("pos")).cast("bigint").alias("q")))


def auc_from_counts(sc: DataFrame, group: list[str]) -> DataFrame:
    """Rank-sum AUC with average ranks for ties; NULL when a group lacks a class."""
    sc = sc.withColumn("c", F.col("p") + F.col("q"))
    cum = running_sums(sc, group, [F.col("score")], ["c"])
    avg_rank = F.col("cum_c") - F.col("c") + (F.col("c") + 1) / 2.0
    agg = cum.groupBy(*group).agg(F.sum(F.col("p") * avg_rank).alias("rs"), F.sum("p").alias("np"),
                                  F.sum("q").alias("nq"))
    auc = F.when((F.col("np") > 0) & (F.col("nq") > 0),
                 (F.col("rs") - F.col("np") * (F.col("np") + 1) / 2.0) / (F.col("np") * F.col("nq")))
    return agg.select(*group, auc.alias("auc"))


def auc_binary(pred: DataFrame) -> DataFrame:
    """E8 binary: AUC of probs[1] for y_true = 1."""
    sc = score_counts(pred, [], F.get(F.col("probs"), 1), F.col("y_true") == 1)
    return auc_from_counts(sc, [])


def _class_list(pred: DataFrame, k: int) -> Column:
    return F.array(*[F.lit(i) for i in range(k)])


def auc_ovr(pred: DataFrame, k: int) -> DataFrame:
    """E8 one-vs-rest macro AUC over ``k`` classes."""
    ex = pred.select("y_true", "probs", F.explode(_class_list(pred, k)).alias("cls"))
    sc = score_counts(ex, ["cls"], F.get(F.col("probs"), F.col("cls")), F.col("y_true") == F.col("cls"))
    per = auc_from_counts(sc, ["cls"])
    return per.agg(F.avg("auc").alias("auc_ovr"))


def auc_ovo(pred: DataFrame, k: int) -> DataFrame:
    """E8 one-vs-one macro AUC: mean over class pairs of the two directed AUCs."""
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(k) for b in range(k) if a != b])
    ex = pred.select("y_true", "probs", F.explode(pairs).alias("pr")).filter(
        (F.col("y_true") == F.col("pr.a")) | (F.col("y_true") == F.col("pr.b")))
    sc = score_counts(ex.select(F.col("pr.a").alias("a"), F.col("pr.b").alias("b"), "y_true", "probs"), ["a", "b"],
                      F.get(F.col("probs"), F.col("a")), F.col("y_true") == F.col("a"))
    per = auc_from_counts(sc, ["a", "b"])
    und = per.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.avg("auc").alias("auc"))
    return und.agg(F.avg("auc").alias("auc_ovo"))


def curve_points(pred: DataFrame, k: int) -> DataFrame:
    """Per class and distinct threshold: tps, fps, tpr, fpr, precision, recall.

    Thresholds descend; every distinct score is a point (no collinear
    point dropping).
    """
    ex = pred.select("y_true", "probs", F.explode(_class_list(pred, k)).alias("cls"))
    sc = score_counts(ex, ["cls"], F.get(F.col("probs"), F.col("cls")), F.col("y_true") == F.col("cls"))
    cum = running_sums(sc, ["cls"], [F.desc("score")], ["p", "q"])
    tot = sc.groupBy("cls").agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"))
    j = cum.join(tot, "cls")
    return j.select(F.col("cls").cast("int").alias("cls"), F.col("score").alias("threshold"),
                    F.col("cum_p").cast("bigint").alias("tps"), F.col("cum_q").cast("bigint").alias("fps"),
                    F.try_divide(F.col("cum_p"), F.col("n_pos")).alias("tpr"), F.try_divide(F.col("cum_q"), F.col("n_neg")).alias("fpr"),
                    (F.col("cum_p") / (F.col("cum_p") + F.col("cum_q"))).alias("precision"),
                    F.try_divide(F.col("cum_p"), F.col("n_pos")).alias("recall"))


def roc_points(pred: DataFrame, k: int) -> DataFrame:
    """ROC points per class, with the (0, 0) start point."""
    c = curve_points(pred, k)
    start = c.select("cls").distinct().select("cls", F.lit(None).cast("double").alias("threshold"),
                                              F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return c.select("cls", "threshold", "fpr", "tpr").unionByName(start)


def pr_points(pred: DataFrame, k: int) -> DataFrame:
    """Precision-recall points per class, with the (recall 0, precision 1) end point."""
    c = curve_points(pred, k)
    end = c.select("cls").distinct().select("cls", F.lit(None).cast("double").alias("threshold"),
                                            F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return c.select("cls", "threshold", "precision", "recall").unionByName(end)


# --- per-prediction analysis ---------------------------------------------------------
def prediction_detail(pred: DataFrame, k: int) -> DataFrame:
    """Label names, confidence = max prob, correct flag, one column per class."""
    name = lambda c: F.concat(F.lit("class_"), c.cast("string"))
    return pred.select("row_id", name(F.col("y_true")).alias("true_label"), name(F.col("y_pred")).alias("predicted_label"),
                       F.array_max("probs").alias("confidence"), (F.col("y_true") == F.col("y_pred")).alias("correct"),
                       *[F.get(F.col("probs"), i).alias(f"prob_class_{i}") for i in range(k)])


def high_conf_correct(detail: DataFrame, n: int = 50) -> DataFrame:
    """Most confident correct predictions (TakeOrderedAndProject)."""
    return detail.filter("correct").orderBy(F.desc("confidence"), F.asc("row_id")).limit(n)


def high_conf_wrong(detail: DataFrame, n: int = 50) -> DataFrame:
    return detail.filter(~F.col("correct")).orderBy(F.desc("confidence"), F.asc("row_id")).limit(n)


def low_conf(detail: DataFrame, n: int = 50) -> DataFrame:
    return detail.orderBy(F.asc("confidence"), F.asc("row_id")).limit(n)


def prediction_summary(detail: DataFrame) -> DataFrame:
    """Counts, accuracy, mean confidence overall / correct / wrong, sample std."""
    c = F.col("confidence")
    return detail.agg(
        F.count("*").cast("bigint").alias("total_samples"),
        F.count_if("correct").cast("bigint").alias("correct_predictions"),
        F.count_if(~F.col("correct")).cast("bigint").alias("incorrect_predictions"),
        (F.count_if("correct") / F.count("*")).alias("accuracy"),
        F.avg(c).alias("average_confidence"),
        F.avg(F.when(F.col("correct"), c)).alias("average_confidence_correct"),
        F.avg(F.when(~F.col("correct"), c)).alias("average_confidence_incorrect"),
        F.stddev_samp(c).alias("confidence_std"))


def focal_loss(pred: DataFrame, alpha: float = 1.0, gamma: float = 2.0, reduction: str = "mean"):
    """Alpha * (1 - p_t)^gamma * CE with p_t = probs[y_true]."""
    pt = F.get(F.col("probs"), F.col("y_true"))
    loss = F.lit(alpha) * F.pow(1 - pt, F.lit(gamma)) * -F.log(pt)
    if reduction == "none":
        return pred.select("row_id", loss.alias("loss"))
    agg = F.avg(loss) if reduction == "mean" else F.sum(loss)
    return pred.agg(agg.alias("loss"))


def evaluate_dataset(pred: DataFrame, k: int, path: str) -> DataFrame:
    """Every table of one evaluation, written under ``path``; returns the metrics (metric, value).

    Predictions are written first and read back by all tables, so the model's
    output is computed once and nothing stays cached.
    """
    spark = pred.sparkSession
    pred.write.mode("overwrite").parquet(f"{path}/predictions")
    p = spark.read.schema(pred.schema).parquet(f"{path}/predictions")
    detail = prediction_detail(p, k)
    # two classes have one AUC, more have both averages
    aucs = {"roc_auc": auc_binary(p).withColumnRenamed("auc", "roc_auc")} if k == 2 else {
        "roc_auc_ovr": auc_ovr(p, k).withColumnRenamed("auc_ovr", "roc_auc_ovr"),
        "roc_auc_ovo": auc_ovo(p, k).withColumnRenamed("auc_ovo", "roc_auc_ovo")}
    tables = {"overall": overall(p), "per_class": per_class(p), "classification_report": classification_report(p),
              "confusion_matrix": confusion_matrix(p), "roc_points": roc_points(p, k), **aucs,
              "pr_points": pr_points(p, k), "prediction_detail": detail, "high_conf_correct": high_conf_correct(detail),
              "high_conf_wrong": high_conf_wrong(detail), "low_conf": low_conf(detail), "summary": prediction_summary(detail)}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    read = lambda name: spark.read.schema(tables[name].schema).parquet(f"{path}/{name}")
    o, s = read("overall"), read("summary")
    as_rows = lambda df, cols: df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols])).alias("m")).select("m.*")
    sizes = [read(name).agg(F.lit(f"rows_{name}").alias("metric"), F.count("*").cast("double").alias("value"))
             for name in ("per_class", "confusion_matrix", "prediction_detail", "high_conf_correct", "roc_points")]
    out = as_rows(o, ["accuracy", "f1_macro", "f1_weighted"]).unionByName(
        as_rows(s, ["total_samples", "correct_predictions", "average_confidence", "confidence_std"]))
    for df in [as_rows(read(name), [name]) for name in aucs] + sizes:
        out = out.unionByName(df)
    return out
