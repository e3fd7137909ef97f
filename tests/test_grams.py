"""Term counts in Arrow batches against brute force."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quill.functions.batches import short_batches
from quill.operators import features as fe
from quill.operators import grams as gr
from quill.session import setting

TEXTS = ["Some words, some  WORDS", None, "", " .a b. ", "Ünïcode İstanbul ΑΣ'Α Σοφός_1 i̇ 日本語 x² Ⅷ ʼn",
         "a1 b2 a1 b2", "end."]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_of_a_batch_are_the_terms(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "k long, text string").coalesce(1)
    want = collections.Counter(r.word for r in docs.select(F.explode(fe.terms(F.col("text"))).alias("word")).collect())
    assert {r.word: r.c for r in gr.word_counts(docs, fe.terms(F.col("text"))).collect()} == want


def test_cut_of_slices():
    texts = pa.array(["", "ab cd ab", "", "ef", None, "cd ab", "gh"] * 50)
    b = pa.RecordBatch.from_arrays([texts], names=["t"])
    got = []
    for part in short_batches(iter([b.slice(3)]), 0, 40):
        c = gr.cut(part.column(0))
        got += c.words.take(pa.array(c.ids)).to_pylist()
        assert np.bincount(c.rows, minlength=len(part)).tolist() == [len((t or "").split()) for t in part.column(0).to_pylist()]
    assert got == [w for t in texts.to_pylist()[3:] for w in (t or "").split()]


def brute(docs, most, min_df, max_df, sublinear, ngram_range, idf, norm):
    tf = collections.defaultdict(collections.Counter)
    for k, t in docs:
        t = re.findall(r"\w{2,}", t or "")
        for n in range(ngram_range[0], ngram_range[1] + 1):
            tf[k].update(" ".join(t[i:i + n]) for i in range(len(t) - n + 1))
    cnt, df = collections.Counter(), collections.Counter()
    for c in tf.values():
        cnt.update(c)
        df.update(c.keys())
    bound = lambda x: x if isinstance(x, int) else x * len(docs)
    kept = sorted((g for g in cnt if bound(min_df) <= df[g] <= bound(max_df)), key=lambda g: (-cnt[g], g))[:most]
    out = {}
    for k, c in tf.items():
        w = {g: (1 + math.log(c[g]) if sublinear else c[g]) * (math.log((1 + len(docs)) / (1 + df[g])) + 1 if idf else 1)
             for g in kept if c[g]}
        total = {"l1": sum(w.values()), "l2": math.sqrt(sum(x * x for x in w.values())), None: 1}[norm]
        out |= {(k, g): x / total for g, x in w.items()}
    return out


@pytest.mark.parametrize("args", [(20, 1, 1.0, True, (1, 1), True, "l2"), (50, 5, 0.5, False, (1, 2), False, "l1"),
                                  (1000, 2, 1.0, True, (1, 3), True, None), (15, 1, 0.9, True, (2, 3), True, "l2")])
@pytest.mark.parametrize("rows", ["10000", "7"])
def test_tfidf_makes_no_row_of_a_term(spark, args, rows):
    """Keys that come often, over batches, and null keys; n-grams left out of the count are never kept."""
    rng = random.Random(3)
    words = [f"w{i:02d}" for i in range(30)]
    rows_ = [(rng.choice([None, *range(40)]), rng.choice([None, ""]) if rng.random() < 0.1 else " ".join(
        rng.choices(words, weights=[1 / (i + 1) for i in range(30)], k=rng.randrange(60)))) for _ in range(120)]
    docs = spark.createDataFrame(rows_, "k long, text string").coalesce(2)
    most, min_df, max_df, sublinear, ngram_range, idf, norm = args
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", rows):
        out = fe.tfidf(docs, "k", "text", most, min_df, max_df, sublinear, ngram_range, idf, norm)
        got = out.collect()
    want = brute(rows_, *args)
    assert len(got) == len(want) and all(abs(r.weight - want[r.k, r.term]) < 1e-12 for r in got)
    assert "Generate" not in plan(out) and "Window" not in plan(out)


def test_a_vocabulary_too_large_to_send_is_joined(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "aa bb aa"), (2, "bb cc")], "k long, text string")
    rows = lambda: sorted(fe.tfidf(docs, "k", "text", 3, ngram_range=(1, 2)).collect())
    small = rows()
    monkeypatch.setattr(gr, "SENT_TERMS", 2)
    large = rows()
    assert [r[:2] for r in small] == [r[:2] for r in large]
    assert np.allclose([r.weight for r in small], [r.weight for r in large], atol=1e-12)


@pytest.mark.parametrize("how", ["mean", "max", "sum"])
def test_pooling_makes_no_row_of_a_word(spark, how):
    """A word with two vectors counts with both; documents without a key have zeros."""
    docs = spark.createDataFrame([(1, "aa bb aa zz"), (2, ""), (None, "aa"), (1, "bb"), (3, "zz")], "k long, text string")
    vec = [("aa", [1.0, -2.0]), ("aa", [3.0, -4.0]), ("bb", [-5.0, -6.0]), (None, [9.0, 9.0]), ("cc", None)]
    out = fe.doc_vectors(docs, "k", "text", spark.createDataFrame(vec, "word string, vec array<float>"), 2, how)
    one = {"mean": [(2 * (1 + 3) - 10) / 6, (2 * -6 - 12) / 6], "max": [3.0, -2.0], "sum": [-2.0, -24.0]}[how]
    got = sorted((r.k or 0, r.dim, r.value) for r in out.collect())
    want = sorted([(0, 0, 0.0), (0, 1, 0.0), (2, 0, 0.0), (2, 1, 0.0), (3, 0, 0.0), (3, 1, 0.0), *[(1, i, one[i]) for i in (0, 1)] * 2])
    assert np.allclose(got, want, atol=1e-12)
    assert not [x for x in plan(out).split("\n") if "Generate" in x and "regexp_extract_all" in x]
