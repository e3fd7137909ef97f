"""Queries for training-data preparation and classifier evaluation (E*)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quill.operators import evaluate as ev
from quill.operators import prep as pp
from quill.plans import fixtures as fx
from quill.plans.catalog import query
from quill.plans.q_results import round_doubles
from quill.plans.sqlbits import lit
from quill.plans.sqlfix import FX, FX_PRED2, FX_PRED3
from quill.session import scratch_path
from quill.sources.tables import table

# Parameter: a small synonym dictionary of words that occur in the test text.
SYNONYMS = {"the": "a", "and": "plus", "of": "from", "le": "un", "der": "ein", "el": "un"}


def labelled(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")).join(docs, "doc_id")


LABELLED_SQL = "(SELECT l.doc_id, l.quality AS label, d.text FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"


def d_hash(key: str, salt: str = "", seed: int = 42) -> str:
    k = f"'{seed}-' || CAST({key} AS VARCHAR)" + (f" || '-{salt}'" if salt else "")
    return f"CAST(('0x' || substr(md5({k}), 1, 8)) AS BIGINT)"


D_W = "list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '')"


def d_swap(w: str, key: str) -> str:
    n = f"greatest(len({w}), 1)"
    i, j = f"({d_hash(key, 'swap-i')} % {n})", f"({d_hash(key, 'swap-j')} % {n})"
    return (f"array_to_string(list_transform({w}, lambda x, k: CASE WHEN k - 1 = {i} THEN {w}[{j} + 1] "
            f"WHEN k - 1 = {j} THEN {w}[{i} + 1] ELSE x END), ' ')")


def d_delete(w: str, key: str) -> str:
    i = f"({d_hash(key, 'del')} % greatest(len({w}), 1))"
    return f"array_to_string(list_filter({w}, lambda x, k: k - 1 <> {i} OR len({w}) <= 1), ' ')"


def d_insert(w: str, key: str) -> str:
    n = f"greatest(len({w}), 1)"
    s, t = f"({d_hash(key, 'ins-src')} % {n})", f"({d_hash(key, 'ins-dst')} % {n})"
    return (f"array_to_string(CASE WHEN len({w}) = 0 THEN {w} ELSE list_concat(list_slice({w}, 1, {t}), "
            f"[{w}[{s} + 1]], list_slice({w}, {t} + 1, len({w}))) END, ' ')")


SYN_MAP = "MAP {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in sorted(SYNONYMS.items())) + "}"
SYN_KEYS = "[" + ", ".join(lit(k) for k in sorted(SYNONYMS)) + "]"


def d_synonym(w: str) -> str:
    hits = f"list_filter(range(0, len({w})), lambda k: list_contains({SYN_KEYS}, {w}[k + 1]))"
    chosen = f"list_slice({hits}, 1, 3)"
    return (f"array_to_string(list_transform({w}, lambda x, k: CASE WHEN list_contains({chosen}, k - 1) "
            f"THEN {SYN_MAP}[x] ELSE x END), ' ')")


@query("stratified_split", """
WITH r AS (SELECT doc_id, quality AS label,
                  row_number() OVER (PARTITION BY quality ORDER BY md5('42-' || CAST(doc_id AS VARCHAR)), doc_id) AS rn,
                  count(*) OVER (PARTITION BY quality) AS n FROM labels)
SELECT doc_id, label, CASE WHEN rn <= floor(n * CAST(0.8 AS DOUBLE)) THEN 'train'
                          WHEN rn <= floor(n * CAST(0.8 AS DOUBLE)) + floor(n * CAST(0.1 AS DOUBLE)) THEN 'validation'
                          ELSE 'test' END AS split
FROM r
""")
def q_stratified_split(spark, d):
    lab = table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    return pp.stratified_split(lab, "label", "doc_id")


@query("augment_swap", f"WITH t AS (SELECT doc_id, {D_W} AS w FROM {LABELLED_SQL} x) SELECT doc_id, {d_swap('w', 'doc_id')} AS aug FROM t")
def q_augment_swap(spark, d):
    return labelled(spark, d).select("doc_id", pp.augment_swap(F.col("text"), F.col("doc_id")).alias("aug"))


@query("augment_delete", f"WITH t AS (SELECT doc_id, {D_W} AS w FROM {LABELLED_SQL} x) SELECT doc_id, {d_delete('w', 'doc_id')} AS aug FROM t")
def q_augment_delete(spark, d):
    return labelled(spark, d).select("doc_id", pp.augment_delete(F.col("text"), F.col("doc_id")).alias("aug"))


@query("augment_insert", f"WITH t AS (SELECT doc_id, {D_W} AS w FROM {LABELLED_SQL} x) SELECT doc_id, {d_insert('w', 'doc_id')} AS aug FROM t")
def q_augment_insert(spark, d):
    return labelled(spark, d).select("doc_id", pp.augment_insert(F.col("text"), F.col("doc_id")).alias("aug"))


@query("augment_synonym", f"WITH t AS (SELECT doc_id, {D_W} AS w FROM {LABELLED_SQL} x) SELECT doc_id, {d_synonym('w')} AS aug FROM t")
def q_augment_synonym(spark, d):
    return labelled(spark, d).select("doc_id", pp.augment_synonym(F.col("text"), SYNONYMS).alias("aug"))


@query("augment_dataset", f"""
WITH t AS (SELECT *, {D_W} AS w FROM {LABELLED_SQL} x),
r AS (SELECT *, row_number() OVER (ORDER BY md5('42-' || CAST(doc_id AS VARCHAR) || '-pick'), doc_id) AS rn FROM t),
p AS (SELECT *, {d_hash('doc_id', 'op')} % 4 AS op FROM r WHERE rn <= floor((SELECT count(*) FROM t) * CAST(0.5 AS DOUBLE))),
a AS (SELECT doc_id, label, text AS orig,
             CASE op WHEN 0 THEN {d_swap('w', 'doc_id')} WHEN 1 THEN {d_delete('w', 'doc_id')}
                     WHEN 2 THEN {d_insert('w', 'doc_id')} ELSE {d_synonym('w')} END AS aug FROM p)
SELECT doc_id, label, text, false AS augmented FROM t
UNION ALL SELECT doc_id, label, aug, true FROM a WHERE aug <> orig
""")
def q_augment_dataset(spark, d):
    return pp.augment_dataset(labelled(spark, d), "text", "label", "doc_id", 0.5, 42, SYNONYMS)


@query("dataset_info", """
WITH r AS (SELECT doc_id, quality AS label,
                  row_number() OVER (PARTITION BY quality ORDER BY md5('42-' || CAST(doc_id AS VARCHAR)), doc_id) AS rn,
                  count(*) OVER (PARTITION BY quality) AS n FROM labels),
s AS (SELECT label, CASE WHEN rn <= floor(n * CAST(0.8 AS DOUBLE)) THEN 'train'
                         WHEN rn <= floor(n * CAST(0.8 AS DOUBLE)) + floor(n * CAST(0.1 AS DOUBLE)) THEN 'validation'
                         ELSE 'test' END AS split FROM r)
SELECT split, label, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY CUBE (split, label)
""")
def q_dataset_info(spark, d):
    lab = table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    return pp.dataset_info(pp.stratified_split(lab, "label", "doc_id"))


# --- evaluation -------------------------------------------------------------------
P3 = f"WITH {FX}, {FX_PRED3}"
P2 = f"WITH {FX}, {FX_PRED2}"
PC3 = P3 + """,
cc AS (SELECT y_true, y_pred, count(*) AS n FROM fx_pred3 GROUP BY 1, 2),
cls AS (SELECT y_true AS cls FROM cc UNION SELECT y_pred FROM cc),
m AS (SELECT c.cls,
             coalesce((SELECT sum(n) FROM cc WHERE y_true = c.cls AND y_pred = c.cls), 0) AS tp,
             coalesce((SELECT sum(n) FROM cc WHERE y_true = c.cls), 0) AS support,
             coalesce((SELECT sum(n) FROM cc WHERE y_pred = c.cls), 0) AS predicted FROM cls c),
pc AS (SELECT cls, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
              CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall, support FROM m),
pcf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM pc)
"""


def P(spark, d, k=3):
    return fx.predictions(spark, d, classes=k)


@query("eval_per_class", PC3 + """
SELECT CAST(cls AS INTEGER) AS cls, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM pcf
""")
def q_eval_per_class(spark, d):
    return round_doubles(ev.per_class(P(spark, d)))


@query("eval_overall", PC3 + """
SELECT round((SELECT count(*) FILTER (WHERE y_true = y_pred) / count(*) FROM fx_pred3), 6) AS accuracy,
       round(avg(f1), 6) AS f1_macro, round(sum(f1 * support) / sum(support), 6) AS f1_weighted,
       round((SELECT count(*) FILTER (WHERE y_true = y_pred) / count(*) FROM fx_pred3), 6) AS f1_micro FROM pcf
""")
def q_eval_overall(spark, d):
    return round_doubles(ev.overall(P(spark, d)))


@query("classification_report", PC3 + """
SELECT 'class_' || cls AS name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM pcf
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM pcf
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
                 round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM pcf
UNION ALL SELECT 'accuracy', NULL, NULL, round(count(*) FILTER (WHERE y_true = y_pred) / count(*), 6), CAST(count(*) AS BIGINT) FROM fx_pred3
""")
def q_classification_report(spark, d):
    return round_doubles(ev.classification_report(P(spark, d)))


@query("confusion_matrix", P3 + """,
cc AS (SELECT y_true, y_pred, count(*) AS n FROM fx_pred3 GROUP BY 1, 2),
cls AS (SELECT y_true AS cls FROM cc UNION SELECT y_pred FROM cc),
g AS (SELECT a.cls AS y_true, b.cls AS y_pred FROM cls a, cls b),
rw AS (SELECT y_true, sum(n) AS row_n FROM cc GROUP BY 1)
SELECT CAST(g.y_true AS INTEGER) AS y_true, CAST(g.y_pred AS INTEGER) AS y_pred, CAST(coalesce(cc.n, 0) AS BIGINT) AS n,
       round(coalesce(coalesce(cc.n, 0) / rw.row_n, 0.0), 6) AS share
FROM g LEFT JOIN cc USING (y_true, y_pred) LEFT JOIN rw USING (y_true)
""")
def q_confusion_matrix(spark, d):
    return round_doubles(ev.confusion_matrix(P(spark, d)))


def _auc_sql(src: str, group_cols: str) -> str:
    g = f"PARTITION BY {group_cols}" if group_cols else ""
    gb = f"GROUP BY {group_cols}" if group_cols else ""
    return f"""
r AS (SELECT *, rank() OVER ({g} ORDER BY score) + (count(*) OVER ({g}{',' if g else 'PARTITION BY'} score) - 1) / 2.0 AS ar FROM {src}),
auc AS (SELECT {group_cols + ',' if group_cols else ''}
               CASE WHEN count(*) FILTER (WHERE pos) > 0 AND count(*) FILTER (WHERE NOT pos) > 0 THEN
               (sum(ar) FILTER (WHERE pos) - count(*) FILTER (WHERE pos) * (count(*) FILTER (WHERE pos) + 1) / 2.0)
               / (count(*) FILTER (WHERE pos) * count(*) FILTER (WHERE NOT pos)) END AS auc FROM r {gb})
"""


@query("auc_binary", P2 + ", s AS (SELECT p1 AS score, y_true = 1 AS pos FROM fx_pred2)," + _auc_sql("s", "")
       + "SELECT round(auc, 6) AS auc FROM auc")
def q_auc_binary(spark, d):
    return round_doubles(ev.auc_binary(P(spark, d, 2)))


_OVR_SRC = """, s AS (SELECT 0 AS cls, p0 AS score, y_true = 0 AS pos FROM fx_pred3
             UNION ALL SELECT 1, p1, y_true = 1 FROM fx_pred3 UNION ALL SELECT 2, p2, y_true = 2 FROM fx_pred3),"""


@query("auc_ovr", P3 + _OVR_SRC + _auc_sql("s", "cls") + "SELECT round(avg(auc), 6) AS auc_ovr FROM auc")
def q_auc_ovr(spark, d):
    return round_doubles(ev.auc_ovr(P(spark, d), 3))


_OVO_SRC = ", s AS (" + " UNION ALL ".join(
    f"SELECT {a} AS a, {b} AS b, p{a} AS score, y_true = {a} AS pos FROM fx_pred3 WHERE y_true IN ({a}, {b})"
    for a in range(3) for b in range(3) if a != b) + "),"


@query("auc_ovo", P3 + _OVO_SRC + _auc_sql("s", "a, b") + """,
u AS (SELECT least(a, b) AS x, greatest(a, b) AS y, avg(auc) AS auc FROM auc GROUP BY 1, 2)
SELECT round(avg(auc), 6) AS auc_ovo FROM u""")
def q_auc_ovo(spark, d):
    return round_doubles(ev.auc_ovo(P(spark, d), 3))


_CURVE = P3 + _OVR_SRC + """
sc AS (SELECT cls, score, count(*) FILTER (WHERE pos) AS p, count(*) FILTER (WHERE NOT pos) AS q FROM s GROUP BY 1, 2),
c AS (SELECT cls, score, sum(p) OVER (PARTITION BY cls ORDER BY score DESC) AS tps,
             sum(q) OVER (PARTITION BY cls ORDER BY score DESC) AS fps,
             sum(p) OVER (PARTITION BY cls) AS P, sum(q) OVER (PARTITION BY cls) AS N FROM sc)
"""


@query("roc_points", _CURVE + """
SELECT CAST(cls AS INTEGER) AS cls, round(score, 6) AS threshold, round(CASE WHEN N > 0 THEN fps / N END, 6) AS fpr,
       round(CASE WHEN P > 0 THEN tps / P END, 6) AS tpr FROM c
UNION ALL SELECT DISTINCT CAST(cls AS INTEGER), NULL, 0.0, 0.0 FROM c
""")
def q_roc_points(spark, d):
    return round_doubles(ev.roc_points(P(spark, d), 3))


@query("pr_points", _CURVE + """
SELECT CAST(cls AS INTEGER) AS cls, round(score, 6) AS threshold, round(tps / (tps + fps), 6) AS precision,
       round(CASE WHEN P > 0 THEN tps / P END, 6) AS recall FROM c
UNION ALL SELECT DISTINCT CAST(cls AS INTEGER), NULL, 1.0, 0.0 FROM c
""")
def q_pr_points(spark, d):
    return round_doubles(ev.pr_points(P(spark, d), 3))


_DETAIL = P3 + """,
det AS (SELECT row_id, 'class_' || y_true AS true_label, 'class_' || y_pred AS predicted_label,
               greatest(p0, p1, p2) AS confidence, y_true = y_pred AS correct, p0 AS prob_class_0,
               p1 AS prob_class_1, p2 AS prob_class_2 FROM fx_pred3)
"""
_DET_COLS = ("row_id, true_label, predicted_label, round(confidence, 6) AS confidence, correct, round(prob_class_0, 6) AS prob_class_0, "
             "round(prob_class_1, 6) AS prob_class_1, round(prob_class_2, 6) AS prob_class_2")


def detail(spark, d):
    return ev.prediction_detail(P(spark, d), 3)


@query("prediction_detail", _DETAIL + f"SELECT {_DET_COLS} FROM det")
def q_prediction_detail(spark, d):
    return round_doubles(detail(spark, d))


@query("high_conf_correct", _DETAIL + f"SELECT {_DET_COLS} FROM det WHERE correct ORDER BY confidence DESC, row_id LIMIT 50")
def q_high_conf_correct(spark, d):
    return round_doubles(ev.high_conf_correct(detail(spark, d)))


@query("high_conf_wrong", _DETAIL + f"SELECT {_DET_COLS} FROM det WHERE NOT correct ORDER BY confidence DESC, row_id LIMIT 50")
def q_high_conf_wrong(spark, d):
    return round_doubles(ev.high_conf_wrong(detail(spark, d)))


@query("low_conf", _DETAIL + f"SELECT {_DET_COLS} FROM det ORDER BY confidence, row_id LIMIT 50")
def q_low_conf(spark, d):
    return round_doubles(ev.low_conf(detail(spark, d)))


@query("prediction_summary", _DETAIL + """
SELECT CAST(count(*) AS BIGINT) AS total_samples, CAST(count(*) FILTER (WHERE correct) AS BIGINT) AS correct_predictions,
       CAST(count(*) FILTER (WHERE NOT correct) AS BIGINT) AS incorrect_predictions,
       round(count(*) FILTER (WHERE correct) / count(*), 6) AS accuracy, round(avg(confidence), 6) AS average_confidence,
       round(avg(confidence) FILTER (WHERE correct), 6) AS average_confidence_correct,
       round(avg(confidence) FILTER (WHERE NOT correct), 6) AS average_confidence_incorrect,
       round(stddev_samp(confidence), 6) AS confidence_std FROM det
""")
def q_prediction_summary(spark, d):
    return round_doubles(ev.prediction_summary(detail(spark, d)))


@query("focal_loss", P3 + """
, l AS (SELECT -ln(CASE y_true WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END)
               * pow(1 - CASE y_true WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END, 2) AS loss FROM fx_pred3)
SELECT 'mean' AS reduction, round(avg(loss), 6) AS loss FROM l UNION ALL SELECT 'sum', round(sum(loss), 6) FROM l
""")
def q_focal_loss(spark, d):
    p = P(spark, d)
    m = ev.focal_loss(p, reduction="mean").select(F.lit("mean").alias("reduction"), "loss")
    s = ev.focal_loss(p, reduction="sum").select(F.lit("sum").alias("reduction"), "loss")
    return round_doubles(m.unionByName(s))


@query("evaluate_dataset", PC3 + """,
det AS (SELECT greatest(p0, p1, p2) AS confidence, y_true = y_pred AS correct FROM fx_pred3),
sc AS (SELECT DISTINCT 0 AS cls, p0 AS score FROM fx_pred3 UNION SELECT DISTINCT 1, p1 FROM fx_pred3 UNION SELECT DISTINCT 2, p2 FROM fx_pred3)
SELECT 'accuracy' AS metric, round((SELECT count(*) FILTER (WHERE y_true = y_pred) / count(*) FROM fx_pred3), 6) AS value
UNION ALL SELECT 'f1_macro', round(avg(f1), 6) FROM pcf
UNION ALL SELECT 'f1_weighted', round(sum(f1 * support) / sum(support), 6) FROM pcf
UNION ALL SELECT 'total_samples', CAST(count(*) AS DOUBLE) FROM det
UNION ALL SELECT 'correct_predictions', CAST(count(*) AS DOUBLE) FROM det WHERE correct
UNION ALL SELECT 'average_confidence', round(avg(confidence), 6) FROM det
UNION ALL SELECT 'confidence_std', round(stddev_samp(confidence), 6) FROM det
UNION ALL SELECT 'roc_auc_ovr', round((""" + f"WITH {_OVR_SRC.lstrip(', ')}" + _auc_sql("s", "cls") + """ SELECT avg(auc) FROM auc), 6)
UNION ALL SELECT 'roc_auc_ovo', round((""" + f"WITH {_OVO_SRC.lstrip(', ')}" + _auc_sql("s", "a, b") + """,
  u AS (SELECT least(a, b) AS x, greatest(a, b) AS y, avg(auc) AS auc FROM auc GROUP BY 1, 2) SELECT avg(auc) FROM u), 6)
UNION ALL SELECT 'rows_per_class', CAST(count(*) AS DOUBLE) FROM pcf
UNION ALL SELECT 'rows_confusion_matrix', CAST(count(*) * count(*) AS DOUBLE) FROM pcf
UNION ALL SELECT 'rows_prediction_detail', CAST(count(*) AS DOUBLE) FROM det
UNION ALL SELECT 'rows_high_conf_correct', CAST(least(count(*), 50) AS DOUBLE) FROM det WHERE correct
UNION ALL SELECT 'rows_roc_points', CAST(count(*) + 3 AS DOUBLE) FROM sc
""")
def q_evaluate_dataset(spark, d):
    """One dataset through E4-E13; every table is written, metrics and table sizes come back."""
    path = scratch_path(spark, f"evaluation/{uuid.uuid4().hex[:8]}")
    return round_doubles(ev.evaluate_dataset(P(spark, d), 3, path))
