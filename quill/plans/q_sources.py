"""Source and sink queries (S1-S15, S21, S22, S25): files written from the driver
tables into the checkpoint folder, then scanned back with the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quill.operators import prep as pp
from quill.plans import fixtures as fx
from quill.plans.catalog import query
from quill.plans.q_results import round_doubles
from quill.plans.sqlfix import FX
from quill.session import scratch_path
from quill.sources import readers as rd
from quill.sources import sinks as sk
from quill.sources.tables import table

DOC_SCHEMA = "doc_id bigint, text string, lang string"


def scratch(spark, name):
    return scratch_path(spark, f"files/{name}-{uuid.uuid4().hex[:8]}")


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "lang")


@query("scan_csv", "SELECT doc_id, text, lang FROM documents")
def q_scan_csv(spark, d):
    p = scratch(spark, "csv")
    docs(spark, d).write.option("header", True).option("escape", '"').csv(p)
    return rd.read_csv(spark, p, schema=DOC_SCHEMA)


@query("scan_json", "SELECT doc_id, text, lang FROM documents")
def q_scan_json(spark, d):
    p = scratch(spark, "json")
    docs(spark, d).write.json(p)
    return rd.read_json(spark, p, schema=DOC_SCHEMA)


@query("error_policy", """
SELECT 'skip' AS policy, count(*) AS rows, CAST(0 AS BIGINT) AS errors FROM documents
UNION ALL SELECT 'log', 2 * count(*), count(*) FROM documents
""")
def q_error_policy(spark, d):
    """The same files (documents plus undecodable lines) under skip / log policies."""
    p = scratch(spark, "bad")
    docs(spark, d).write.json(f"{p}/good")
    # one unterminated JSON object per document: always undecodable
    table(spark, d, "documents").select(F.concat(F.lit('{"doc_id": '), F.col("doc_id").cast("string"),
                                                 F.lit(', "text": ')).alias("value")).write.text(f"{p}/bad")
    schema = DOC_SCHEMA + ", _corrupt_record string"
    skip = rd.read_json(spark, f"{p}/*", errors="skip", schema=DOC_SCHEMA).agg(F.count("*").alias("rows"))
    log = rd.read_json(spark, f"{p}/*", errors="log", schema=schema).agg(
        F.count("*").alias("rows"),
        # Spark rejects queries that read only the corrupt-record column, so doc_id is referenced too
        F.count_if(F.col("_corrupt_record").isNotNull() & F.col("doc_id").isNull()).alias("errors"))
    return (skip.select(F.lit("skip").alias("policy"), "rows", F.lit(0).cast("bigint").alias("errors"))
            .unionByName(log.select(F.lit("log").alias("policy"), "rows", "errors")))


@query("scan_text_lines", r"""
WITH l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line,
                  generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
n AS (SELECT source, trim(line, chr(32) || chr(9) || chr(13)) AS text,
             CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id, i) AS INTEGER) AS line_number FROM l)
SELECT source, text, line_number FROM n WHERE text <> ''
""")
def q_scan_text_lines(spark, d):
    """S3: one text file for each source (documents in id order), its lines numbered."""
    p = scratch(spark, "text")
    (table(spark, d, "documents").select("source", "doc_id", "text").repartition("source")
     .sortWithinPartitions("source", "doc_id").select("source", "text").write.partitionBy("source").text(p))
    lines = rd.read_text_lines(spark, p)
    return lines.select(F.regexp_extract("_source_file", "source=([^/]+)/", 1).alias("source"), "text", "line_number")


@query("scan_parquet", "SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en'")
def q_scan_parquet(spark, d):
    df = rd.read_parquet(spark, f"{d}/documents.parquet")
    return df.filter(F.col("lang") == "en").select("doc_id", "lang", "n_chars")


YAML_SCHEMA = "doc_id bigint, lang string, source string, text string"


def write_yaml(docs, p: str, bad: bool = False) -> None:
    """One YAML document a row, the text as a quoted scalar; with ``bad``, each is followed by one that is no YAML."""
    quoted = F.get(F.split(F.to_json(F.struct("text")), '^\\{"text":|\\}$'), 1)
    y = docs.filter("text IS NOT NULL").select(F.concat(
        F.format_string("---\ndoc_id: %d\nlang: %s\nsource: %s\ntext: ", "doc_id", "lang", "source"), quoted,
        F.lit("\n---" + ("\nbroken: [" if bad else ""))).alias("value"))
    y.write.text(p)


@query("scan_yaml", "SELECT doc_id, lang, source, text FROM documents WHERE text IS NOT NULL")
def q_scan_yaml(spark, d):
    """Multi-document YAML written by Spark (one document per input row)."""
    p = scratch(spark, "yaml")
    write_yaml(table(spark, d, "documents"), p)
    # the text writer names its files part-*.txt; the glob picks them up as YAML
    return rd.read_yaml(spark, p, YAML_SCHEMA, glob="*.txt").select("doc_id", "lang", "source", "text")


@query("yaml_error_policy", """
SELECT 'skip' AS policy, count(text) AS documents, CAST(0 AS BIGINT) AS errors FROM documents
UNION ALL SELECT 'log', count(text), count(text) FROM documents
UNION ALL SELECT 'raise', CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)
""")
def q_yaml_error_policy(spark, d):
    """S9 for S5: as many broken documents as sound ones, under every policy."""
    p = scratch(spark, "yaml-bad")
    write_yaml(table(spark, d, "documents"), p, bad=True)
    read = lambda policy: rd.read_yaml(spark, p, YAML_SCHEMA, glob="*.txt", errors=policy)
    skip = read("skip").agg(F.lit("skip").alias("policy"), F.count("doc_id").alias("documents"),
                            F.count_if(F.col("doc_id").isNull()).alias("errors"))
    log = read("log").agg(F.lit("log").alias("policy"), F.count("doc_id").alias("documents"),
                          F.count("_corrupt_record").alias("errors"))
    try:
        fails = read("raise").agg(F.lit("raise").alias("policy"), F.count("doc_id").alias("documents"),
                                  F.lit(0).cast("bigint").alias("errors")).collect()
    except Exception as e:  # noqa: BLE001
        if "YAML document in" not in str(e):
            raise
        fails = [("raise", None, None)]
    return skip.unionByName(log).unionByName(spark.createDataFrame(fails, "policy string, documents long, errors long"))


@query("load_by_extension", "SELECT doc_id, text, lang FROM documents")
def q_load_by_extension(spark, d):
    p = scratch(spark, "ext")
    docs(spark, d).write.option("header", True).option("escape", '"').csv(p + "/data.csv")
    return rd.load_file(spark, p + "/data.csv", schema=DOC_SCHEMA)


def _mixed_dir(spark, d):
    """csv, json and parquet folders of the documents, and text files of their ids, in Spark's own partitions."""
    p = scratch(spark, "dir")
    dd = docs(spark, d).sortWithinPartitions("doc_id")
    dd.filter("lang = 'en'").write.option("header", True).option("escape", '"').csv(f"{p}/csv")
    dd.filter("lang = 'fr'").write.json(f"{p}/json")
    dd.filter("lang = 'de'").write.parquet(f"{p}/parquet")
    dd.filter("lang = 'es'").select(F.col("doc_id").cast("string")).write.text(f"{p}/txt")
    return p


@query("scan_directory", """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN lang <> 'es' THEN lang END AS lang, CASE WHEN lang <> 'es' THEN text END AS text,
       CASE WHEN lang = 'es' THEN true END AS line_number_fits
FROM documents
""")
def q_scan_directory(spark, d):
    """All formats of one folder; the lines of a text file (ids in order) carry their number in it."""
    df = rd.load_directory(spark, _mixed_dir(spark, d))
    is_line = F.col("line_number").isNotNull()
    own = Window.partitionBy("_source_file").orderBy(F.col("text").cast("bigint"))
    lines = df.filter(is_line).select(
        F.col("text").alias("doc_id"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("text"),
        (F.col("line_number") == F.row_number().over(own)).alias("line_number_fits"))
    rest = df.filter(~is_line).select(F.col("doc_id").cast("string").alias("doc_id"), "lang", "text",
                                      F.lit(None).cast("boolean").alias("line_number_fits"))
    return rest.unionByName(lines)


@query("load_stats", """
SELECT 'run-2' AS run_id, true AS all_files, count(*) AS records, CAST(0 AS BIGINT) AS errors, true AS timed FROM documents
""")
def q_load_stats(spark, d):
    """Stats of two loads appended to a stats table; the latest row is read back."""
    p, folder = scratch(spark, "stats"), _mixed_dir(spark, d)
    loaded = rd.load_directory(spark, folder)
    rd.save_load_stats(rd.load_stats(loaded.filter("lang = 'en'")), p, "run-1")
    rd.save_load_stats(rd.load_stats(loaded), p, "run-2")
    # files that hold rows, counted without the loader (a CSV file may be a header alone)
    with_rows = spark.read.option("recursiveFileLookup", "true").format("binaryFile").load(folder).select("path", "length")
    files = with_rows.filter("length > 0").join(loaded.select(F.col("_source_file").alias("path")).distinct(), "path").agg(
        F.count("*")).scalar()
    timed = (F.col("end_time") >= F.col("start_time")) & (F.col("duration_s") > 0)
    return rd.last_load_stats(spark, p).select("run_id", (F.col("files") == files).alias("all_files"), "records", "errors",
                                              timed.alias("timed"))


@query("load_union", "SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents")
def q_load_union(spark, d):
    """A CSV folder named as a file, a plain folder and a missing source (logged), one transform over all."""
    p = scratch(spark, "union")
    dd = docs(spark, d)
    dd.filter("lang IN ('en', 'de')").write.option("header", True).option("escape", '"').csv(f"{p}/a.csv")
    dd.filter("lang NOT IN ('en', 'de')").write.json(f"{p}/b")
    u = rd.load_batch(spark, [f"{p}/a.csv", f"{p}/b", f"{p}/missing.json"], lambda df: df.withColumn(
        "n", F.length("text").cast("bigint")), errors="skip")
    return u.select(F.col("doc_id").cast("bigint").alias("doc_id"), "n")


@query("enrich_batch", "SELECT doc_id, 'batch' AS source, true AS has_processed_at FROM documents")
def q_enrich_batch(spark, d):
    return rd.enrich_batch(docs(spark, d)).select("doc_id", "source",
                                                  F.col("processed_at").isNotNull().alias("has_processed_at"))


@query("label_index", """
WITH l AS (SELECT DISTINCT lang FROM documents), i AS (SELECT lang, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS label_id FROM l)
SELECT d.doc_id, d.lang AS label, i.label_id FROM documents d JOIN i USING (lang)
""")
def q_label_index(spark, d):
    return rd.label_index(docs(spark, d).select("doc_id", F.col("lang").alias("label")))


@query("scan_json_columnar", """SELECT text, CAST(quality AS BIGINT) AS label FROM labels l JOIN documents d USING (doc_id)""")
def q_scan_json_columnar(spark, d):
    """Columnar objects {text: [...], label: [...]}, one object per block of 100 ids, one per line."""
    p = scratch(spark, "columnar")
    lab = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    blocks = lab.groupBy(F.floor(F.col("doc_id") / 100).alias("b")).agg(
        F.sort_array(F.collect_list(F.struct("doc_id", "text", "quality"))).alias("r"))
    blocks.select(F.col("r.text").alias("text"), F.col("r.quality").alias("label")).write.json(p)
    return rd.read_json_columnar(spark, p).withColumn("label", F.col("label").cast("bigint"))


@query("sink_json", f"""
WITH {FX}, e AS (SELECT document_id, text, start_pos FROM fx_ents WHERE pos = 0)
SELECT d.document_id, d.text, lang, source, sent_label AS sentiment_label, round(sent_score, 6) AS sentiment_score, cls_label,
       n_entities, e.text AS first_entity, CAST(e.start_pos AS BIGINT) AS first_start, round(processing_time, 6) AS processing_time, error
FROM fx_docs d LEFT JOIN e USING (document_id)
""")
def q_sink_json(spark, d):
    """Results written as JSON lines and read back, nested columns included."""
    p = scratch(spark, "sink")
    df = fx.results(spark, d)
    sk.write_json(df, p)
    r = spark.read.schema(df.schema).json(p)
    first = F.get("entities", 0)
    return round_doubles(r.select(
        "document_id", "text", "lang", "source", F.col("sentiment.label").alias("sentiment_label"),
        F.col("sentiment.score").alias("sentiment_score"), F.col("classification.label").alias("cls_label"),
        F.size("entities").cast("bigint").alias("n_entities"), first["text"].alias("first_entity"),
        first["start"].cast("bigint").alias("first_start"), "processing_time", "error"))


@query("export_batch", f"""
WITH {FX}
SELECT f AS format, document_id, substr(text, 1, 500) AS text, CAST(length(text) AS BIGINT) AS text_length, sent_label AS sentiment_label,
       round(sent_score, 6) AS sentiment_score, n_entities, coalesce(error, '') AS error
FROM fx_docs, (VALUES ('json'), ('csv'), ('parquet')) t(f)
""")
def q_export_batch(spark, d):
    """The same rows read back from every format."""
    df = fx.results(spark, d)
    paths = sk.export_batch(df, scratch(spark, "export"))
    flat = sk.flat_results_table(df).schema
    read = spark.read.option("multiLine", True).option("header", True).option("escape", '"')
    parts = {"json": sk.flat_results_table(spark.read.schema(df.schema).json(paths["json"])),
             "csv": read.schema(flat).csv(paths["csv"]),
             "parquet": sk.flat_results_table(spark.read.schema(df.schema).parquet(paths["parquet"]))}
    out = None
    for name, part in parts.items():
        rows = part.select(F.lit(name).alias("format"), "document_id", "text", "text_length", "sentiment_label", "sentiment_score",
                           F.col("entity_count").alias("n_entities"), F.coalesce("error", F.lit("")).alias("error"))
        out = rows if out is None else out.unionByName(rows)
    return round_doubles(out)


_SPLIT_COUNTS = """
WITH r AS (SELECT doc_id, quality AS label,
                  row_number() OVER (PARTITION BY quality ORDER BY md5('42-' || CAST(doc_id AS VARCHAR)), doc_id) AS rn,
                  count(*) OVER (PARTITION BY quality) AS n FROM labels),
s AS (SELECT CASE WHEN rn <= floor(n * CAST(0.8 AS DOUBLE)) THEN 'train'
                  WHEN rn <= floor(n * CAST(0.8 AS DOUBLE)) + floor(n * CAST(0.1 AS DOUBLE)) THEN 'validation'
                  ELSE 'test' END AS split FROM r)
SELECT split, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY split
"""


_SPLIT_COUNTS_MISSING = ("SELECT split, n, 'validation' AS missing FROM (" + _SPLIT_COUNTS
                         + ") x WHERE split <> 'validation'")


@query("save_splits", _SPLIT_COUNTS)
def q_save_splits(spark, d):
    p = scratch(spark, "splits")
    lab = table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    rd.save_splits(pp.stratified_split(lab, "label", "doc_id"), p)
    df, _missing = rd.load_splits(spark, p)
    return df.groupBy("split").agg(F.count("*").cast("bigint").alias("n"))


@query("load_splits", _SPLIT_COUNTS_MISSING)
def q_load_splits(spark, d):
    """Saved splits read back; the report lists splits that are absent."""
    p = scratch(spark, "splits2")
    lab = table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    rd.save_splits(pp.stratified_split(lab, "label", "doc_id").filter(F.col("split") != "validation"), p)
    df, missing = rd.load_splits(spark, p)
    return df.groupBy("split").agg(F.count("*").cast("bigint").alias("n")).withColumn(
        "missing", F.lit(",".join(missing)))
