"""Incremental states, the prediction cache, exact search, co-occurrence and YAML policies against plain versions."""

import datetime as dt
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quill.operators import aggregate as ag
from quill.operators import incremental as inc
from quill.operators import search as se
from quill.plans import fixtures as fx
from quill.sources import readers as rd
from quill.sources.cache import PredictionCache

SF = "/root/testdata/sf0.001"


# --- A12 --------------------------------------------------------------------------------------

def test_states_of_batches_equal_a_full_run(spark, tmp_path):
    r = fx.results(spark, SF)
    for k in (0, 1, 0, 2):  # a replayed batch counts once
        inc.append_batch(r.filter(F.pmod("doc_id", F.lit(3)) == k), str(tmp_path), k)
    got, want = inc.refresh_summary(spark, str(tmp_path)).first(), ag.summary_stats(r).first()
    for name in want.asDict():
        if name == "unique_entities":
            assert abs(got[name] - want[name]) <= 0.03 * want[name]
        else:
            assert got[name] == pytest.approx(want[name]) if isinstance(want[name], float) else got[name] == want[name], name
    scores = sorted(x.s for x in r.select(F.col("sentiment.score").alias("s")).collect() if x.s is not None)
    at = np.searchsorted(scores, got.median_confidence) / len(scores)
    assert 0.45 <= at <= 0.55
    labels = {x.label: x for x in inc.refresh_labels(spark, str(tmp_path)).collect()}
    for x in ag.agg_by_entity_type(r).collect():
        g = labels.pop(x.label)
        assert (g.total_occurrences, g.document_coverage) == (x.total_occurrences, pytest.approx(x.document_coverage))
        assert g.avg_confidence == pytest.approx(x.avg_confidence) and abs(g.unique_entities - x.unique_entities) <= 0.03 * x.unique_entities
    assert not labels


def test_a_refresh_reads_states_only(spark, tmp_path):
    r = fx.results(spark, SF)
    inc.append_batch(r.filter("doc_id < 50"), str(tmp_path), 1)
    plan = inc.refresh_summary(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "/corpus" in plan and "/results" not in plan


# --- S23, S24 -----------------------------------------------------------------------------------

SCHEMA = "text_hash string, model_type string, prediction_data string, confidence double, created_at timestamp_ntz"


def cached(n, day, data, kind="sentiment"):
    import hashlib
    return (hashlib.md5(str(n).encode()).hexdigest(), kind, data, n / 100, dt.datetime(2024, 1, day))


def test_cache_upserts_touch_only_their_partitions(spark, tmp_path):
    import os
    cache = PredictionCache(spark, f"{tmp_path}/c", buckets=4)
    first = [cached(i, 1, "old") for i in range(60)] + [cached(3, 1, "other", "entities")]
    cache.upsert(spark.createDataFrame(first, SCHEMA))
    files = {p: sorted(os.listdir(f"{tmp_path}/c/{p}")) for p in os.listdir(f"{tmp_path}/c") if p.startswith("part=")}
    new = [cached(5, 2, "new"), cached(500, 2, "fresh"), cached(6, 1, "a"), cached(6, 1, "b")]
    touched = cache.upsert(spark.createDataFrame(new, SCHEMA))
    assert set(touched) == {r[0][0] for r in new}
    for p, names in files.items():
        assert (sorted(os.listdir(f"{tmp_path}/c/{p}")) == names) == (p.removeprefix("part=") not in touched), p
    got = {(r.text_hash, r.model_type): r.prediction_data for r in cache.rows().collect()}
    want = {r[:2]: r[2] for r in first} | {new[0][:2]: "new", new[1][:2]: "fresh", new[2][:2]: "old"}
    assert got == want and cache.upsert(spark.createDataFrame([], SCHEMA)) == []
    cache.drop()


def test_cache_lookup_moves_only_the_requests(spark, tmp_path):
    cache = PredictionCache(spark, f"{tmp_path}/c", buckets=4)
    cache.upsert(spark.createDataFrame([cached(i, 1 + i % 3, "x") for i in range(30)], SCHEMA))
    asked = spark.createDataFrame([(i, cached(i, 1, "")[0], "sentiment") for i in range(40)], "id long, text_hash string, model_type string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = cache.lookup(asked, F.lit("2024-01-03 12:00:00").cast("timestamp_ntz"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = {r.id: r.prediction_data for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {i: "x" if i < 30 and i % 3 == 2 else None for i in range(40)}
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan and "SortMergeJoin" in plan
    cache.drop()


# --- F11 ------------------------------------------------------------------------------------------

def test_search_equals_comparing_all(spark, monkeypatch):
    rng = np.random.default_rng(3)
    groups = rng.normal(size=(12, 8))
    x = [groups[i % 12] * rng.uniform(0.5, 2) + rng.normal(size=8) * 0.15 for i in range(600)] + [np.zeros(8)] + [groups[0]] * 5
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)] + [(9000, None, 1), (9001, [], 1), (9002, [1.0], 1), (9003, [None] * 8, 1)]
    df = spark.createDataFrame(rows, "id long, v array<double>, cell int").repartition(3)
    monkeypatch.setattr(se, "PART", 40)
    found = se.cosine_topk_many(df, df.filter("id % 20 = 0"), "id", "v", 10)
    cos = se.cosines(np.array(x), np.array(x))
    want = []
    for q in range(0, len(x), 20):
        order = sorted(range(len(x)), key=lambda i: (-round(cos[q, i], 12), i))[:10]
        want += [(q, k + 1, round(float(cos[q, i]), 9)) for k, i in enumerate(order)]
    got = found.rows.collect()
    assert sorted((r.query, r["rank"], round(r.score, 9)) for r in got) == sorted(want)
    assert all(abs(cos[r.query, r.key] - r.score) < 1e-12 for r in got)
    assert found.compared < 0.6


def test_search_with_fewer_vectors_than_wanted(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<float>")
    got = se.cosine_topk_many(df, df, "id", "v", 5).rows.collect()
    assert sorted((r.query, r["rank"], r.key, r.score) for r in got) == [(1, 1, 1, 1.0), (1, 2, 2, 0.0), (2, 1, 2, 1.0), (2, 2, 1, 0.0)]


# --- A7 -------------------------------------------------------------------------------------------

@pytest.mark.parametrize("pair_rows", [ag.PAIR_ROWS, 7])
def test_cooccurrence_equals_counting_pairs(spark, monkeypatch, pair_rows):
    monkeypatch.setattr(ag, "PAIR_ROWS", pair_rows)
    rng = random.Random(4)
    docs = [[f"e{rng.randint(0, 12)}" for _ in range(rng.randint(0, 9))] for _ in range(60)] + [[f"x{i}" for i in range(300)]] * 3 + [["é", None]]
    rows = [(str(i), [{"text": t} for t in d]) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "document_id string, entities array<struct<text:string>>").repartition(3)
    want = Counter(p for d in docs for p in combinations(sorted({t for t in d if t}), 2))
    got = {(r.entity1, r.entity2): (r.co_occurrence_count, r.strength) for r in ag.entity_cooccurrence(df, 3).collect()}
    assert got == {p: (n, n / len(docs)) for p, n in want.items() if n >= 3}


# --- S5, S9 -----------------------------------------------------------------------------------------

def test_yaml_policies(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("id: 1\n---\nid: [broken\n---\n- id: 3\n- id: 4\n---\n\n---\nid: 5\n")
    (tmp_path / "b.yml").write_text("key: 'open\n")
    path, schema = str(tmp_path / "a.yaml"), "id int"
    assert sorted(r.id for r in rd.read_yaml(spark, path, schema, errors="skip").collect()) == [1, 3, 4, 5]
    log = rd.read_yaml(spark, path, schema, errors="log").collect()
    assert sorted((r.id or 0, bool(r._corrupt_record)) for r in log) == [(0, True), (1, False), (3, False), (4, False), (5, False)]
    with pytest.raises(Exception, match="YAML document in"):
        rd.read_yaml(spark, path, schema, errors="raise").collect()
    assert rd.load_file(spark, path, errors="skip").count() == 4
    assert rd.load_directory(spark, str(tmp_path), errors="skip").count() == 4
    assert rd.load_directory(spark, str(tmp_path), errors="log").filter("_corrupt_record IS NOT NULL").count() == 2
    with pytest.raises(Exception, match="YAML document in"):
        rd.load_directory(spark, str(tmp_path), errors="raise").collect()
    with pytest.raises(Exception, match="YAML document in"):
        rd.load_batch(spark, [path], errors="raise").collect()
