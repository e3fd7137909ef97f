"""Work and memory of single steps that must not grow with a batch, a text's uses or the number of passes."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import yaml
from pyspark.sql import functions as F

from quill.functions import text as tx
from quill.functions.batches import short_lists
from quill.operators import bayes
from quill.operators import features as fe
from quill.operators import search as se
from quill.sources import readers as rd


def peak_mb(run) -> float:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


# --- F14 ------------------------------------------------------------------------------------------

YAML_TEXTS = ["a: 1\nb: [x, 2.5, ~]", "- {k: 'it''s'}\n- |\n  two\n  lines\n", 'doc_id: 7\ntext: "a \\" \\u00e9 \\/ \\n é"', "", "2024-01-01", "a:\t1", '"\\ud83d"']


@pytest.mark.skipif(not yaml.__with_libyaml__, reason="no libyaml")
def test_sound_yaml_goes_through_libyaml(monkeypatch):
    want = [yaml.safe_load(t) for t in YAML_TEXTS if "\t" not in t]
    assert [rd._parse_yaml(t) for t in YAML_TEXTS if "\t" not in t] == want
    monkeypatch.setattr(yaml, "safe_load", None)
    assert [rd._parse_yaml(t) for t in YAML_TEXTS[:5]] == want[:5]


@pytest.mark.parametrize("text", ["\nbroken: [", "a: b: c", "k:\n\t- 1", "\x07", "a: 1\n- b", *YAML_TEXTS])
def test_yaml_verdicts_are_those_of_the_plain_parser(text):
    def of(parse):
        try:
            return "sound", parse(text)
        except yaml.YAMLError as e:
            return "broken", str(e)
    assert of(rd._parse_yaml) == of(yaml.safe_load)


# --- F15, F22 -------------------------------------------------------------------------------------

def test_scoring_a_batch_holds_the_words_of_a_cut():
    model = bayes.Model({f"w{i}": i for i in range(100)}, np.random.default_rng(0).normal(size=(100, 3)), np.zeros(3), np.zeros(3))
    texts = [" ".join(f"w{(i * j) % 113}" for j in range(20_000)) for i in range(1, 200)] + [None, ""]
    got = []
    assert peak_mb(lambda: got.extend(model.by_cuts(texts))) < 150 < peak_mb(lambda: model.probabilities(texts))
    assert np.array_equal(np.array(got), model.probabilities(texts))


def test_short_lists_lose_nothing():
    texts = ["abc", None, "", "x" * 50, "de", None]
    for most in (1, 4, 10, 1000):
        parts = list(short_lists(texts, most))
        assert sum(parts, []) == texts and all(len(p) == 1 or sum(len(t or "") for t in p) <= most for p in parts)
    assert list(short_lists([])) == []


# --- F16 ------------------------------------------------------------------------------------------

def test_topics_read_counts_written_once(spark, monkeypatch):
    from pyspark.ml.clustering import LDA
    plan_of = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    plans, fit = [], LDA.fit
    monkeypatch.setattr(LDA, "fit", lambda self, df: plans.append(plan_of(df)) or fit(self, df))
    docs = spark.createDataFrame([(i, f"apple pear w{i % 7} fig{i % 3}") for i in range(40)] + [(40, None), (41, "")], "id long, text string")
    dist, _ = fe.lda_topics(docs, "id", "text", k=3, max_features=20, max_iter=3)
    assert len(plans) == 1 and "text#" not in plans[0]
    # no guard of the generator that works out a topic distribution for its size
    assert "size(CASE" not in plan_of(dist)
    sums = dist.groupBy("id").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).collect()
    assert len(sums) == 42 and all(r.n == 3 and abs(r.w - 1) < 1e-9 for r in sums)


# --- F26 ------------------------------------------------------------------------------------------

def test_block_of_two_parts_holds_a_share_of_its_scores():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(3000, 4)), rng.normal(size=(se.PART, 4))
    got = []
    assert peak_mb(lambda: got.extend(se.best_of(a, b, 10))) < 100  # all scores: 197 MB, and their order
    some = np.arange(0, 3000, 500)
    cos = se.cosines(a[some], b)
    assert np.array_equal(got[0][some], np.argsort(-cos, axis=1, kind="stable")[:, :10])
    assert np.allclose(got[1][some], -np.sort(-cos, axis=1)[:, :10], rtol=0, atol=1e-12)


def test_visits_come_in_pieces():
    b = pa.RecordBatch.from_arrays([pa.array([5, 6]), pa.array([[1.0, 2.0], [3.0, 4.0]])], names=["query", "q"])
    row = np.arange(40_000) % 2
    parts = list(se._visits(b, row, np.arange(40_000)))
    assert max(p.num_rows for p in parts) <= se.VISITS
    all_rows = pa.Table.from_batches(parts)
    assert all_rows["cell"].to_pylist() == list(range(40_000)) and all_rows["query"].to_pylist() == [5 + r for r in row]


# --- F27 ------------------------------------------------------------------------------------------

def test_contractions_are_worked_out_once_a_row(spark):
    texts = [(1, "I won\u2019t, I WON'T ﬁnd it's we're é", "en"), (2, "can't", "de"), (3, None, "en"), (4, "n't ½ ’ll ＇ll", "en"), (5, "plain  text", "en"),
             (6, "", None), (7, "- ?", "en"), (8, "he'll \u00bd Ünd they'd", "en")]
    df = spark.createDataFrame(texts, "id int, text string, lang string")
    out = df.select("id", tx.clean_multilingual(F.col("text"), F.col("lang")).alias("o"))
    # in the branches of plain and of other texts, of which a row takes one, and behind the guard of the few rows that go to Python
    assert out._jdf.queryExecution().optimizedPlan().toString().count("(?i)won't") <= 3
    plain = df.select("id", F.when(F.col("lang") == "en", tx.expand_contractions(F.col("text"))).otherwise(F.col("text")).alias("text"))
    want = plain.select("id", tx.clean_text(F.col("text")).alias("o"))
    assert sorted(out.collect()) == sorted(want.collect())
    assert dict(out.collect())[8] == "he will 1 2 und they would"
