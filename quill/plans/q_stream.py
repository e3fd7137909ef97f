"""Streaming queries (X*): file-sourced streams drained with ``availableNow``.

Each query derives its input from the driver tables, runs a real
Structured Streaming query into a sink under the checkpoint folder and
returns the sink as a batch DataFrame, so the stream result can be checked
against the batch oracle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quill.plans import fixtures as fx
from quill.plans.catalog import query
from quill.plans.q_monitor import COOLDOWN_EVENTS, rules_df
from quill.plans.q_results import FLAGSHIP_SQL, flagship, round_doubles
from quill.plans.sqlfix import FX
from quill.session import scratch_path
from quill.sources.tables import events as events_table
from quill.sources.tables import table
from quill.streaming import stream as xs


def write_messages(spark, d, src: str = "documents", key: str = "doc_id", files: int | None = None) -> str:
    """The document stream as JSON lines; every 50th message is cut in half (undecodable)."""
    docs = table(spark, d, src)
    docs = docs.repartition(files) if files else docs
    meta = (F.to_json(F.struct("lang", "source")) if src == "documents" else F.lit(None).cast("string"))
    msg = F.to_json(F.struct(F.col(key).cast("string").alias("id"), F.col("text"), meta.alias("metadata"),
                             fx.processed_at(F.col(key)).alias("timestamp")))
    value = F.when(F.pmod(F.col(key), F.lit(50)) == 0, F.substring(msg, 1, (F.length(msg) / 2).cast("int"))).otherwise(msg)
    path = scratch_path(spark, f"streams/messages-{src}-{uuid.uuid4().hex[:8]}")
    docs.select(value.alias("value")).write.text(path)
    return path


def parsed_stream(spark, d, files: int | None = None, **kw):
    return xs.parse_messages(xs.file_stream(spark, write_messages(spark, d, files=files), "text", **kw))


VALID_SQL = f"""
WITH {FX} SELECT CAST(doc_id AS VARCHAR) AS id, text, lang, source, processed_at AS event_ts
FROM fx_docs WHERE doc_id % 50 <> 0
"""


@query("stream_source", """
SELECT concat_ws('|', doc_id, lang, source, translate(text, chr(10) || chr(13), '  ')) AS value FROM documents
""")
def q_stream_source(spark, d):
    """File source (the Kafka source takes the same path through :func:`kafka_stream`)."""
    path = scratch_path(spark, f"streams/lines-{uuid.uuid4().hex[:8]}")
    table(spark, d, "documents").select(F.concat_ws(
        "|", F.col("doc_id").cast("string"), "lang", "source", F.translate("text", "\n\r", "  ")).alias("value")).write.text(path)
    out, _ = xs.run_to_table(xs.file_stream(spark, path, "text"), "source")
    return out


@query("stream_parse", VALID_SQL)
def q_stream_parse(spark, d):
    out, _ = xs.run_to_table(xs.valid_messages(parsed_stream(spark, d)), "parse")
    return out.select("id", "text", F.get_json_object("metadata", "$.lang").alias("lang"),
                      F.get_json_object("metadata", "$.source").alias("source"),
                      F.col("timestamp").cast("timestamp_ntz").alias("event_ts"))


@query("stream_transform", """
SELECT CAST(doc_id AS VARCHAR) AS id, CAST(length(text) AS BIGINT) AS text_length
FROM documents WHERE doc_id % 50 <> 0 AND text IS NOT NULL AND length(text) > 0
""")
def q_stream_transform(spark, d):
    s = xs.valid_messages(parsed_stream(spark, d)).transform(xs.filter_nonempty)
    out, _ = xs.run_to_table(s.select("id", "text_length"), "transform")
    return out


@query("stream_parquet", """SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents WHERE doc_id % 50 <> 0""")
def q_stream_parquet(spark, d):
    out, _ = xs.run_to_table(xs.valid_messages(parsed_stream(spark, d)).select("id", "text"), "parquet")
    return out


@query("stream_to_json", """SELECT CAST(doc_id AS VARCHAR) AS key, text FROM documents WHERE doc_id % 50 <> 0""")
def q_stream_to_json(spark, d):
    payload = xs.to_message_json(xs.valid_messages(parsed_stream(spark, d)).select("id", "text"))
    out, _ = xs.run_to_table(payload, "to_json")
    return out.select("key", F.get_json_object("value", "$.text").alias("text"))


@query("dead_letter", "SELECT CAST(count(*) AS BIGINT) AS n_dead FROM documents WHERE doc_id % 50 = 0")
def q_dead_letter(spark, d):
    out, _ = xs.run_to_table(xs.dead_letters(parsed_stream(spark, d)), "dead")
    return out.agg(F.count("*").cast("bigint").alias("n_dead"))


@query("stream_trigger", "SELECT CAST(104 AS BIGINT) AS batches, count(*) AS rows FROM documents")
def q_stream_trigger(spark, d):
    """Bounded micro-batches (one of 104 files per trigger), drained with availableNow; every report counts."""
    s = parsed_stream(spark, d, files=104, max_files_per_trigger=1)
    _, reports = xs.run_to_table(s.select("id"), "trigger")
    return xs.progress_rows(spark, reports).agg(F.count("*").cast("bigint").alias("batches"),
                                          F.sum("num_input_rows").cast("bigint").alias("rows"))


@query("stream_progress", None)
def q_stream_progress(spark, d):
    _, reports = xs.run_to_table(parsed_stream(spark, d, max_files_per_trigger=2).select("id"), "progress")
    return xs.progress_rows(spark, reports)


@query("stream_retry", "SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents WHERE doc_id % 50 <> 0")
def q_stream_retry(spark, d):
    """foreachBatch with retries; the writer fails once per batch and succeeds on retry."""
    base = scratch_path(spark, f"streams/retry-{uuid.uuid4().hex[:8]}")
    seen: set = set()
    write = xs.idempotent_append(f"{base}/data")

    def flaky(batch, batch_id):
        if batch_id not in seen:
            seen.add(batch_id)
            raise RuntimeError("transient failure")
        write(batch, batch_id)

    s = xs.valid_messages(parsed_stream(spark, d)).select("id", "text")
    q = (s.writeStream.foreachBatch(xs.retrying_batch(flaky, f"{base}/dead", backoff_s=0.1))
         .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
    xs.wait_to_end(q)
    return spark.read.parquet(f"{base}/data").select("id", "text")


@query("stream_analyze", FLAGSHIP_SQL + " WHERE doc_id % 50 <> 0")
def q_stream_analyze(spark, d):
    """Stream -> analyze -> per-batch append with running figures and an export every 1,000 documents."""
    s = xs.valid_messages(parsed_stream(spark, d, files=4, max_files_per_trigger=1)).select(
        F.col("id").cast("bigint").alias("doc_id"), "text")
    base = scratch_path(spark, f"streams/analyze-{uuid.uuid4().hex[:8]}")
    sink = xs.AnalysisSink(base, export_every=1000)
    q = (flagship(spark, d, s).writeStream.foreachBatch(sink)
         .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
    xs.wait_to_end(q)
    return round_doubles(sink.results(spark))


@query("stream_analyze_totals", f"""
WITH a AS ({FLAGSHIP_SQL} WHERE doc_id % 50 <> 0)
SELECT CAST(count(*) AS BIGINT) AS documents, CAST(sum(n_entities) AS BIGINT) AS entities,
       CAST(count(*) FILTER (WHERE sentiment_label = 'negative') AS BIGINT) AS n_negative,
       CAST(count(*) FILTER (WHERE sentiment_label = 'neutral') AS BIGINT) AS n_neutral,
       CAST(count(*) FILTER (WHERE sentiment_label = 'positive') AS BIGINT) AS n_positive,
       CAST(floor(count(*) / 100) AS BIGINT) >= 9 AS exported FROM a
""")
def q_stream_analyze_totals(spark, d):
    """The running figures after the last batch, and whether every hundredth document led to an export."""
    s = xs.valid_messages(parsed_stream(spark, d, files=12, max_files_per_trigger=1)).select(
        F.col("id").cast("bigint").alias("doc_id"), "text")
    base = scratch_path(spark, f"streams/totals-{uuid.uuid4().hex[:8]}")
    sink = xs.AnalysisSink(base, export_every=100)
    q = (flagship(spark, d, s).writeStream.foreachBatch(sink)
         .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
    xs.wait_to_end(q)
    return sink.totals(spark).withColumn("exported", F.lit(len(sink.exports) >= 9))


@query("stream_running_counts", """
SELECT lang, CAST(count(*) AS BIGINT) AS n FROM documents WHERE doc_id % 50 <> 0 GROUP BY lang
""")
def q_stream_running_counts(spark, d):
    """A12 streaming: running counts per language in complete mode over the message stream."""
    s = xs.valid_messages(parsed_stream(spark, d, max_files_per_trigger=2)).select(
        F.get_json_object("metadata", "$.lang").alias("lang"))
    path, _ = xs.running_counts(s, "lang", "running")
    return spark.read.parquet(path)


@query("hybrid_union", """
SELECT 'batch' AS origin, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents
UNION ALL
SELECT 'stream', CAST(count(*) AS BIGINT), CAST(sum(length(text)) AS BIGINT) FROM benchmark WHERE item_id % 50 <> 0
""")
def q_hybrid_union(spark, d):
    """Historical batch (S12 enrichment) + the drained benchmark stream."""
    from quill.sources.readers import enrich_batch
    batch = enrich_batch(table(spark, d, "documents").select("text")).withColumn("origin", F.lit("batch"))
    msgs = xs.parse_messages(xs.file_stream(spark, write_messages(spark, d, "benchmark", "item_id"), "text"))
    s = xs.valid_messages(msgs).select("text").withColumn("origin", F.lit("stream"))
    u = xs.hybrid(batch, s, "hybrid")
    return u.groupBy("origin").agg(F.count("*").cast("bigint").alias("n"), F.sum(F.length("text")).cast("bigint").alias("chars"))


def events_stream(spark, d):
    ev = table(spark, d, "events")
    s = xs.file_stream(spark, d, "parquet", schema=ev.schema, glob="events.parquet")
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_window", """
WITH w AS (SELECT event_type, time_bucket(INTERVAL 1 hour, ts) AS window_start, count(*) AS n, sum(value) AS total
           FROM events GROUP BY 1, 2)
SELECT event_type, window_start, window_start + INTERVAL 1 hour AS window_end, CAST(n AS BIGINT) AS n, round(total, 6) AS total
FROM w WHERE window_start + INTERVAL 1 hour <= (SELECT max(ts) FROM events) - INTERVAL 1 hour
""")
def q_stream_window(spark, d):
    agg = xs.windowed_counts(events_stream(spark, d), size="1 hour", delay="1 hour")
    out, _ = xs.run_to_table(agg, "window", output_mode="append")
    return round_doubles(out.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                                    F.col("w.end").cast("timestamp_ntz").alias("window_end"), "n", "total"))


@query("stream_late_rows", """
WITH m AS (SELECT median(event_id) AS mid FROM events),
wm AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 minute AS w FROM events, m WHERE event_id > mid AND event_id < (SELECT max(event_id) FROM events)),
late AS (SELECT DISTINCT event_type, time_bucket(INTERVAL 1 hour, ts) AS h FROM events, m WHERE event_id <= mid)
SELECT (SELECT count(*) FROM events) AS rows, count(*) AS dropped FROM late, wm WHERE h + INTERVAL 1 hour <= w
""")
def q_stream_late_rows(spark, d):
    """The later half of the events comes first; rows behind the watermark (10 minutes) are dropped.

    Rows are late by the watermark of the batch before the last, hence a short
    batch in between.  The reports count dropped rows as the state operator
    sees them: one for each (event type, window) of a micro-batch.
    """
    ev = events_table(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    mid = ev.select(F.median("event_id")).scalar()
    path = scratch_path(spark, f"streams/late-{uuid.uuid4().hex[:8]}")
    last = ev.select(F.max("event_id")).scalar()
    newer = ev.filter(F.col("event_id") > mid)
    for k, part in enumerate((newer.filter(F.col("event_id") < last), newer.filter(F.col("event_id") == last),
                              ev.filter(F.col("event_id") <= mid))):
        part.coalesce(1).write.parquet(f"{path}/part={k}")
    s = xs.file_stream(spark, path, "parquet", schema=ev.schema, max_files_per_trigger=1)
    agg = xs.windowed_counts(s, size="1 hour", delay="10 minutes")
    _, reports = xs.run_to_table(agg, "late", output_mode="append")
    return xs.progress_rows(spark, reports).agg(F.sum("num_input_rows").cast("bigint").alias("rows"),
                                                F.sum("rows_dropped_by_watermark").cast("bigint").alias("dropped"))


@query("stream_alerts", COOLDOWN_EVENTS + "SELECT rule, event_id, ts, key, event, value FROM ev")
def q_stream_alerts(spark, d):
    """The cooldown alert state machine on the event stream (state per rule)."""
    s = events_stream(spark, d)
    pts = s.select("event_id", "ts", F.col("event_type").alias("name"),
                   F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("labels"), "value")
    matched = xs.match_rules_stream(pts, rules_df(spark))
    with xs.keyed_state(spark):
        out, _ = xs.run_to_table(xs.stateful_alerts(matched), "alerts")
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


