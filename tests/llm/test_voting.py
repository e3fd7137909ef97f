"""The voting classifier against a plain version, and its accuracy on held-out rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quill.llm import common, voting
from tests.llm.helpers import DOCS, doc, good_docs, odd_docs

LABELS = "doc_id long, quality int, toxic int, text string, label int"


def plain_shape(word):
    out = ""
    for b in word:
        c = chr(b)
        c = "A" if "A" <= c <= "Z" else "a" if "a" <= c <= "z" or b >= 128 else "0" if c.isdigit() else c
        if not out.endswith(c):
            out += c
    return out[:8].encode("latin-1")


def plain_counts(text):
    """place -> count, straight from the description."""
    words = re.findall(rb"[^ \t\n\x0b\x0c\r]+", (text or "").encode())
    out = Counter()
    for w in words:
        out[zlib.crc32(w.lower()) % voting.WORDS] += 1
        out[voting.WORDS + zlib.crc32(plain_shape(w)) % voting.SHAPES] += 1
    lines = Counter((text or "").encode().split(b"\n"))
    again = {b"word again": sum(a == b for a, b in zip(words, words[1:])), b"any again": len(words) - len(set(words)),
             b"line again": sum(n * len(x.split()) for x, n in lines.items() if n > 1)}
    for name, n in again.items():
        out[voting.WORDS + zlib.crc32(name) % voting.SHAPES] += n
    return {k: n for k, n in out.items() if n}


def junk(rng, i):
    words = [f"w{rng.randint(0, 300)}" for _ in range(60)]
    return [" ".join(["Spam"] * 80 + words[:9]), " | ".join(words), " ".join(w + "$$$" for w in words),
            "\n".join(["BUY THIS NOW TODAY"] * 20)][i % 4]


def training():
    rng = random.Random(6)
    rows = good_docs(120) + [doc(2000 + i, junk(rng, i)) for i in range(60)]
    labels = [(r[0], int(r[0] < 2000), 0, "t", 5) for r in rows]
    return rows, labels


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def run(spark, rows, labels, **more):
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    return voting.classify(docs, spark.createDataFrame(labels, LABELS).repartition(2), **more).collect()


def test_counts_equal_a_plain_version(monkeypatch):
    texts = [r[1] for r in odd_docs() + good_docs(20)] + ["a  b\x0bB\x0cÄä1.2|x|\r\na", "Aaa" * 50, "x\n\n\ny x x"]
    got = voting.Terms().counts(texts)
    for t, row in zip(texts, got, strict=True):
        assert {int(k): int(row[k]) for k in np.flatnonzero(row)} == plain_counts(t)
    monkeypatch.setattr(voting, "PIECE", 50)
    monkeypatch.setattr(voting, "REMEMBER", 7)
    assert (voting.Terms().counts(texts) == got).all()
    assert (voting.Terms().present(texts) == (got[:, :voting.WORDS] > 0).sum(axis=0)).all()


def test_scores_equal_a_plain_version(spark):
    rows, labels = training()
    got = {r.doc_id: r for r in run(spark, rows, labels)}
    counts = {r[0]: plain_counts(r[1]) for r in rows}
    df = Counter(k for c in counts.values() for k in c if k < voting.WORDS)

    def weigh(c):
        v = np.zeros(voting.TERMS)
        n = sum(x for k, x in c.items() if k < voting.WORDS)
        for k, x in c.items():
            v[k] = (1 + math.log(x)) * math.log((len(rows) + 1) / (df[k] + 1)) if k < voting.WORDS else math.sqrt(x / n)
        for half in (v[:voting.WORDS], v[voting.WORDS:]):
            half /= max(np.linalg.norm(half), 1e-12)
        return v
    ids = [r[0] for r in rows if not held(r[0])]
    x = np.array([weigh(counts[i]) for i in ids])
    _, _, v = np.linalg.svd(x, full_matrices=False)
    basis = v[:voting.LATENT].T
    refs = x @ basis
    refs /= np.linalg.norm(refs, axis=1, keepdims=True)
    y = np.array([int(i < 2000) for i in ids])
    worst = 0
    for i, c in counts.items():
        q = weigh(c) @ basis
        cos = refs @ (q / np.linalg.norm(q))
        near = np.argsort(-cos)[:voting.NEIGHBOURS]
        vote = np.maximum(cos[near], 0) ** voting.SHARPNESS
        worst = max(worst, abs((vote * y[near]).sum() / vote.sum() - got[i].score))
        assert got[i].held_out == held(i) and got[i].predicted == int(got[i].score >= 0.5)
    assert worst < 0.02


def test_held_out_labels_teach_nothing_and_are_predicted(spark):
    rows, labels = training()
    a = {r.doc_id: r for r in run(spark, rows, labels)}
    wrong = [(i, 1 - q if held(i) else q, t, x, y) for i, q, t, x, y in labels]
    b = {r.doc_id: r.score for r in run(spark, rows, wrong)}
    assert {i: r.score for i, r in a.items()} == b
    right = [a[i].predicted == q for i, q, *_ in labels if held(i)]
    assert len(right) > 40 and np.mean(right) >= 0.95


def test_a_drawn_sample_stands_for_its_label(spark):
    rows, labels = training()
    docs = spark.createDataFrame(rows, DOCS)
    known = spark.createDataFrame(labels, LABELS).drop("label").withColumnRenamed("quality", "label")
    v = voting.fit(docs, known.select("doc_id", "label"), per_label=20)
    open_ = [q for i, q, *_ in labels if not held(i)]
    assert len(v.labels) < 60 and abs(v.stands_for.sum() - len(open_)) < 1e-6
    assert abs(v.prior - np.mean(open_)) < 1e-9


def test_accuracy_on_held_out_rows_of_the_given_tables(spark):
    sf = "/root/testdata/sf0.01"
    got = voting.classify(common.table(spark, sf, "documents"), common.table(spark, sf, "labels"))
    j = got.filter("held_out").join(common.table(spark, sf, "labels"), "doc_id")
    r = j.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("a"),
              F.avg(F.when(F.col("quality") == 0, 1 - F.col("predicted"))).alias("low")).first()
    assert r.a >= 0.95 and r.low >= 0.9


@pytest.mark.parametrize("labels", [[], [(1, None, 0, "", 1), (None, 1, 0, "", 1), (99, 1, 0, "", 1)]])
def test_without_usable_labels(spark, labels):
    got = run(spark, odd_docs(), labels)
    assert len(got) == len(odd_docs()) and all(r.score == 0.5 and r.predicted == 1 for r in got)


def test_odd_rows(spark):
    labels = [(r[0], i % 2, 0, None, None) for i, r in enumerate(odd_docs())]
    got = run(spark, odd_docs(), labels)
    assert len(got) == len(odd_docs()) and all(0 <= r.score <= 1 for r in got)
    by_text = defaultdict(set)
    for r in got:
        by_text[r.doc_id].add((r.held_out, r.score))
    assert by_text[None] and all(h == held(i) for i, s in by_text.items() for h, _ in s)
    assert run(spark, [], labels) == []
