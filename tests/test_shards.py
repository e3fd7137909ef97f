"""Pooling by shards of vectors, term counts by document, batches bounded by bytes."""

import re

import numpy as np
import pyarrow as pa
import pytest

from quill.functions.batches import short_batches
from quill.operators import features as fe


@pytest.mark.parametrize("how", ["mean", "max", "sum"])
def test_pooling_is_the_same_over_many_shards(spark, monkeypatch, how):
    monkeypatch.setattr(fe, "SHARD_VECTORS", 3)
    rng = np.random.default_rng(4)
    vec = {f"w{i:02d}": rng.normal(size=4).astype(np.float32) - 2 for i in range(20)}
    texts = {i: " ".join(f"w{x:02d}" for x in rng.integers(0, 25, rng.integers(0, 40))) for i in range(30)}
    texts[30], texts[31] = None, "w24 w24"
    docs = spark.createDataFrame([*texts.items(), (5, "w03 w03")], "doc_id long, text string")  # a key that comes twice
    texts[5] += " w03 w03"
    wv = spark.createDataFrame([(w, v.tolist()) for w, v in vec.items()], "word string, vec array<float>")
    got = {}
    for r in fe.doc_vectors(docs, "doc_id", "text", wv, 4, how).collect():
        got.setdefault(r.doc_id, {})[r.dim] = r.value
    pooled = {}
    for r in fe.pool_tokens(docs, "doc_id", "text", wv, 4, how if how != "sum" else "cls").collect():
        pooled.setdefault(r.doc_id, {})[r.dim] = r.value
    fold = {"mean": np.mean, "max": np.max, "sum": np.sum}[how]
    for i, t in texts.items():
        words = (t or "").split()
        known = [vec[w].astype(float) for w in words if w in vec]
        want = fold(known, axis=0) if known else np.zeros(4)
        assert np.allclose([got[i][k] for k in range(4)], want, atol=1e-9)
        if how == "max" and words:
            want = np.max([vec.get(w, np.zeros(4)) for w in words], axis=0)
        if how != "sum":
            assert np.allclose([pooled[i][k] for k in range(4)], want, atol=1e-9)


def test_term_counts_move_texts_not_terms(spark):
    docs = spark.createDataFrame([(1, "some words some"), (2, "words"), (1, "some")], "doc_id long, text string")
    tf = fe.term_counts(fe.term_rows(docs, "doc_id", "text", (1, 2)), "doc_id")
    plan = tf._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(doc_id#\d+L?, term", plan) and plan.count("hashpartitioning(") == 1
    assert {(r.doc_id, r.term): r.tf for r in tf.collect()}[(1, "some")] == 3


def test_short_batches_keep_every_row():
    texts = ["a" * 10, None, "b" * 95, "", "c" * 40, "d" * 60, "é" * 51, "e"]
    b = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], names=["key", "text"])
    cut = list(short_batches(iter([b.slice(0, 3), b.slice(3)]), 1, 100))
    assert [x for c in cut for x in c.column(1).to_pylist()] == texts and len(cut) > 3
    assert all(c.num_rows == 1 or sum(len((t or "").encode()) for t in c.column(1).to_pylist()) <= 100 for c in cut)
