"""Exports of the analysis sink."""

import glob
import gzip
import json

from quill.streaming import stream as xs


def test_exports_are_whole_and_compressed(spark, tmp_path):
    sink = xs.AnalysisSink(str(tmp_path), export_every=10)
    rows = [(str(i), "the same words again " * 20, "neutral", i) for i in range(36)]
    for k in range(3):
        sink(spark.createDataFrame(rows[12 * k:12 * k + 12], "document_id string, clean string, sentiment_label string, n_entities long"), k)
    assert len(sink.exports) == 3
    for k, target in enumerate(sink.exports, 1):
        files = glob.glob(f"{target}/part-*")
        assert files and all(f.endswith(".json.gz") for f in files)
        lines = [json.loads(x) for f in files for x in gzip.open(f, "rt")]
        assert sorted((x["document_id"], x["clean"], x["n_entities"]) for x in lines) == sorted((r[0], r[1], r[3]) for r in rows[:12 * k])
        assert spark.read.json(target).count() == 12 * k
