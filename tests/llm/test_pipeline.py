"""The corpus pipeline against a brute-force version, and its stages on odd tables."""

from collections import Counter, defaultdict

import corpus_pipeline
from quill.llm import mixing, quality, queries
from tests.llm.helpers import DOCS, brute_components, brute_lines, brute_simhash, doc, good_docs, odd_docs, sha


def brute(spark, rows):
    """Rows (doc_id, text, source) through the stages, with the queue's schedule from its own query."""
    judged = quality.quality_rules(spark.createDataFrame(rows, DOCS)).filter("kept").collect()
    good = {r.doc_id for r in judged}
    rows = [r for r in rows if r[0] in good]
    rows = [(r[0], t, r[3]) for r, (t, _, _) in zip(rows, brute_lines([r[:2] for r in rows]), strict=True)]
    groups = defaultdict(list)
    for r, c in zip(rows, brute_components([brute_simhash(r[1]) for r in rows]), strict=True):
        groups[c].append(r)
    rows = [min(g, key=lambda r: r[0]) for g in groups.values()]
    taken = {r.doc_id: r.taken // r.size if r.size else 0 for r in mixing.fair_queue(
        spark.createDataFrame([doc(*r) for r in rows], DOCS)).collect()}
    return Counter({(d, sha_ids(t)): taken[d] for d, t, _ in rows if taken[d]})


def sha_ids(text):
    import public_tokenizers
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(queries.PIECE_MODEL))
    return sha(",".join(map(str, lib.encode(text))))


def test_run_equals_brute_force(spark, tmp_path):
    rows = good_docs(80) + [doc(5000, "*** " * 200), doc(5001, "short"), doc(5002, None), doc(None, None)]
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.ids_sha256) for r in got) == brute(spark, rows)
    assert all(len(r.ids) == r.n_tokens for r in got)


def test_stages_on_odd_and_empty_tables(spark):
    for rows in (odd_docs(), []):
        df = spark.createDataFrame(rows, DOCS)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, "")
            assert out.columns == df.columns, name
            assert out.count() <= 3 * max(1, len(rows)), name
        last = corpus_pipeline.STAGES[-1][1](spark, df, "")
        assert last.count() == len(rows)


def test_near_stage_keeps_one_row_of_each_group(spark):
    rows = good_docs(40)
    df = spark.createDataFrame(rows + rows[:7], DOCS).repartition(3)
    kept = [r.doc_id for r in corpus_pipeline.near_stage(spark, df, "").collect()]
    comp = brute_components([brute_simhash(r[1]) for r in rows])
    want = {min(r[0] for r, d in zip(rows, comp, strict=True) if d == c) for c in set(comp)}
    assert sorted(kept) == sorted(want)


def test_line_stage_updates_the_text_and_its_length(spark):
    rows = good_docs(40)
    got = {r.doc_id: r for r in corpus_pipeline.line_stage(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    for r, (t, _, _) in zip(rows, brute_lines([r[:2] for r in rows]), strict=True):
        assert got[r[0]].text == t and got[r[0]].n_chars == len(t)
