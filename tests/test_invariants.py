"""Algebraic invariants of operators on the driver tables (sf0.001)."""

from pyspark.sql import functions as F

from quill.operators import entities as en
from quill.operators import evaluate as ev
from quill.operators import prep as pp
from quill.operators import stats as st
from quill.plans import fixtures as fx
from quill.sources.tables import table

SF = "/root/testdata/sf0.001"


def test_split_disjoint_and_complete(spark):
    lab = table(spark, SF, "labels").select("doc_id", F.col("quality").alias("label"))
    sp = pp.stratified_split(lab, "label", "doc_id")
    assert sp.count() == lab.count()
    assert sp.select("doc_id").distinct().count() == lab.count()
    assert set(r[0] for r in sp.select("split").distinct().collect()) <= {"train", "validation", "test"}


def test_confusion_matrix_sums_to_n(spark):
    p = fx.predictions(spark, SF, 3)
    cm = ev.confusion_matrix(p)
    assert cm.agg(F.sum("n")).first()[0] == p.count()


def test_running_sums_match_window(spark):
    df = table(spark, SF, "events").select("event_type", "value")
    cum = st.cumulative_counts(df, ["event_type"], "value", n_parts=5)
    got = {(r.event_type, r.value): r.cum_c for r in cum.collect()}
    rows = df.collect()
    for (g, v), c in list(got.items())[:200]:
        assert c == sum(1 for r in rows if r.event_type == g and r.value <= v)


def test_entity_offsets_point_at_text(spark):
    r = fx.results(spark, SF).select("text", F.explode("entities").alias("e")).collect()
    assert r
    for row in r[:500]:
        assert row.text[row.e.start:row.e.end] == row.e.text


def test_rule_entities_offsets(spark):
    docs = table(spark, SF, "documents")
    out = docs.select("text", F.explode(en.extract_entities(F.col("text"))).alias("e")).collect()
    for row in out:
        assert row.text[row.e.start:row.e.end] == row.e.text


def test_lda_rows_sum_to_one(spark):
    from quill.operators import features as fe
    dist, words = fe.lda_topics(table(spark, SF, "documents"), "doc_id", "text", k=3, max_features=200, max_iter=5)
    sums = dist.groupBy("doc_id").agg(F.sum("weight").alias("s")).collect()
    assert sums and all(abs(r.s - 1.0) < 1e-6 for r in sums)
    assert words.select("topic").distinct().count() == 3


def test_stream_equals_batch_parse(spark):
    from __spark_entry__ import queries
    q = queries()
    a = {(r.id, r.text) for r in q["stream_parquet"](spark, SF).collect()}
    docs = table(spark, SF, "documents").filter("doc_id % 50 <> 0").select(F.col("doc_id").cast("string").alias("id"), "text")
    assert a == {(r.id, r.text) for r in docs.collect()}


def test_random_search_runs_all_trials(spark):
    from quill.plans import q_train
    rows = q_train.q_random_search(spark, SF).collect()
    assert [r.trial for r in rows] == list(range(50)) and all(0 <= r.score <= 1 for r in rows)
