"""The Merkle manifest against a plain version on small tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quill.llm import merkle
from tests.llm.helpers import DOCS, doc, good_docs, odd_docs

LOWER = {ord(a): ord(a) + 32 for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i:i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def plain(rows):
    """rows (doc_id, text, lang, source, n_chars) -> sorted result rows with the proofs."""
    groups = defaultdict(list)
    for d, text, lang, source, n in rows:
        seen = text if d is None or zlib.crc32(str(d).encode()) % 3 or text is None else text.translate(LOWER)
        groups[lang].append((d, leaf(d, source, lang, n, text), leaf(d, source, lang, n, seen)))
    langs = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    for k in langs:
        groups[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = {k: levels([r[1] for r in groups[k]]) for k in langs}
    top = levels([trees[k][-1][0] for k in langs])
    out = []
    for at, k in enumerate(langs):
        for i, (d, own, now) in enumerate(groups[k]):
            proof = []
            for tree, pos in ((trees[k], i), (top, at)):
                for row in tree[:-1]:
                    run, slot = row[pos // 8 * 8:pos // 8 * 8 + 8], pos % 8
                    proof += run[:slot] + run[slot + 1:]
                    now, pos = sha(*run[:slot], now, *run[slot + 1:]), pos // 8
            out.append((d, own, trees[k][-1][0], top[-1][0], sha(*proof), now, now == top[-1][0], tuple(proof)))
    return sorted(out, key=str)


def found(df):
    got = merkle.manifest(df, *merkle.lowered(), with_proof=True).collect()
    return sorted(((*r[:-1], tuple(r.proof)) for r in got), key=str)


def table(rows):
    return [(r[0], r[1], r[2], r[3], r[4]) for r in rows]


@pytest.mark.parametrize("make", [odd_docs, good_docs])
def test_manifest_equals_a_plain_tree(spark, make):
    rows = make()
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    assert found(df) == plain(table(rows))


def test_groups_of_all_sizes_nulls_copies_and_many_groups(spark):
    r = random.Random(5)
    rows = []
    for k, n in enumerate([1, 2, 7, 8, 9, 64, 65, 200]):
        rows += [(r.randint(-50, 50), f"Text {k} {r.randint(0, 9)}", f"l{k}", None, k) for _ in range(n)]
    rows += [(5, "Same", None, "s", 4)] * 30 + [(None, None, None, None, None)] * 3 + [(7, "x", "", "é漢", None)]
    rows += [(i, "One", f"lang {i}", "s", 3) for i in range(70)]
    df = spark.createDataFrame([(a, b, c, d, e, 1, 2) for a, b, c, d, e in rows],
                               "doc_id long, text string, lang string, source string, n_chars long, pos long, digest int")
    assert found(df.repartition(5)) == plain(rows)


def test_groups_above_one_block(spark):
    """10,000 leaves are three blocks, so the ancestors' siblings come from another task."""
    rows = [(i, f"T {i}", "en" if i % 5 else "fr", "s", i) for i in range(700)]
    df = spark.createDataFrame([doc(*r[:2]) for r in rows], DOCS).repartition(4)
    big = df.withColumn("lang", F.lit("en"))
    want = plain([(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in big.collect()])
    assert found(big) == want
    more = spark.range(10_000).select(F.col("id").alias("doc_id"), F.lit("Ab").alias("text"), F.lit("en").alias("lang"),
                                      F.lit(None).cast("string").alias("source"), F.lit(2).alias("n_chars"))
    assert found(more) == plain([tuple(r) for r in more.collect()])


def test_empty_and_single(spark):
    df = spark.createDataFrame([], DOCS)
    assert merkle.manifest(df).count() == 0
    row = merkle.manifest(spark.createDataFrame([doc(3, "Only")], DOCS)).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.verified and row.proof_sha256 == sha()


def test_a_parent_resumes_its_state():
    children = [sha(str(i)) for i in range(8)]
    p = merkle.Parent(children)
    for k in range(8):
        other = sha("x", str(k))
        assert p.fold(k, other) == sha(*children[:k], other, *children[k + 1:])
        assert p.fold(k, children[k]) == p.digest == sha(*children)
