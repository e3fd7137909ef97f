"""Structured Streaming entry points.

Every transformation here works on batch and streaming DataFrames alike
unless its docstring says otherwise, so a stream result can be checked
against the same function run on the batch table.  Sources and sinks are
thin option mappings over ``readStream`` / ``writeStream``; checkpoints go
to the shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quill.functions.vectors import SENTIMENT_LABELS
from quill.operators.alerts import match_rules
from quill.operators.cooldown import RuleState
from quill.session import scratch_path, setting

# Message schema of the document stream (all fields nullable), plus the
# column that keeps undecodable messages.
MESSAGE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("metadata", T.StringType()), T.StructField("timestamp", T.TimestampType()),
    T.StructField("_corrupt_record", T.StringType()),
])


def filter_nonempty(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Keep non-null, non-empty text; add its length and a processing time."""
    t = F.col(text_col)
    return (df.filter(t.isNotNull() & (F.length(t) > 0))
              .withColumn("text_length", F.length(t).cast("bigint"))
              .withColumn("processed_timestamp", F.current_timestamp()))


# The Kafka source's option names.
# --- sources (X1) -------------------------------------------------------------------
def kafka_options(servers: str, topic: str, starting_offsets: str = "latest",
                  max_offsets_per_trigger: int | None = 1000) -> dict:
    """Options of the Kafka source (rate cap, no failure on data loss)."""
    opts = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting_offsets,
            "failOnDataLoss": "false"}
    if max_offsets_per_trigger:
        opts["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    return opts


def kafka_stream(spark: SparkSession, servers: str, topic: str, **kw) -> DataFrame:
    """Kafka source as (key, value, kafka_timestamp); needs the Kafka connector on the classpath."""
    raw = spark.readStream.format("kafka").options(**kafka_options(servers, topic, **kw)).load()
    return raw.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"),
                      F.col("timestamp").alias("kafka_timestamp"))


def file_stream(spark: SparkSession, path: str, fmt: str = "text", schema: T.StructType | None = None,
                max_files_per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    """X1 (file form): any file source; ``text`` yields one ``value`` per line."""
    r = spark.readStream.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path)


# --- parse, transform, dead letter (X2, X3, X9) -------------------------------------------
def parse_messages(df: DataFrame, value: str = "value", schema: T.StructType = MESSAGE_SCHEMA) -> DataFrame:
    """JSON value -> flat columns; broker time kept apart as ``kafka_timestamp``.

    PERMISSIVE parsing keeps undecodable messages in ``_corrupt_record``.
    """
    parsed = F.from_json(F.col(value), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    keep = [c for c in df.columns if c in ("key", "kafka_timestamp")]
    return df.select(*keep, parsed.alias("data")).select(*keep, "data.*")


def valid_messages(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def dead_letters(parsed: DataFrame) -> DataFrame:
    """Undecodable messages, for a dead-letter sink."""
    return parsed.filter(F.col("_corrupt_record").isNotNull()).select(
        F.col("_corrupt_record").alias("raw"), F.current_timestamp().alias("failed_at"))


def to_message_json(df: DataFrame, key: str = "id") -> DataFrame:
    """Kafka-style payload: key = id, value = JSON of the whole row."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


# --- sinks, triggers, progress (X4-X6) --------------------------------------------------
def start_sink(df: DataFrame, fmt: str, path: str | None = None, checkpoint: str | None = None,
               output_mode: str = "append", trigger: dict | None = None, query_name: str | None = None,
               options: dict | None = None):
    """Start a streaming write (parquet / json / console / memory / kafka)."""
    if fmt not in ("parquet", "json", "console", "memory", "kafka", "noop", "text"):
        raise ValueError(f"unsupported sink {fmt}")
    w = df.writeStream.format(fmt).outputMode(output_mode).options(**(options or {}))
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    if path and fmt not in ("memory", "console", "kafka"):
        w = w.option("path", path)
    if query_name:
        w = w.queryName(query_name)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


class ProgressLog(StreamingQueryListener):
    """Every progress report of the queries started while it listens, none dropped.

    ``recentProgress`` keeps the last 100 reports only; a listener is told all
    of them.  Reports are kept by run id, one short row a micro-batch.
    """

    def __init__(self) -> None:
        self.rows: dict[str, list[tuple]] = {}
        self.ended: dict[str, threading.Event] = {}
        self.lock = threading.Lock()

    def _end(self, run_id: str) -> threading.Event:
        with self.lock:
            return self.ended.setdefault(run_id, threading.Event())

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        d = json.loads(event.progress.json)
        with self.lock:
            self.rows.setdefault(str(d["runId"]), []).append(_progress_row(d))

    def onQueryTerminated(self, event) -> None:
        self._end(str(event.runId)).set()

    def of(self, query, wait_s: float = 120) -> list[tuple]:
        """The reports of a query that has ended, after the listener has seen its end."""
        run_id = str(query.runId)
        if not self._end(run_id).wait(wait_s):
            raise TimeoutError(f"the end of query {run_id} was not reported within {wait_s} s")
        with self.lock:
            return list(self.rows.get(run_id, []))


def _progress_row(d: dict) -> tuple:
    dropped = sum(int(op.get("numRowsDroppedByWatermark", 0) or 0) for op in d.get("stateOperators", []))
    return (int(d.get("batchId", -1)), int(d.get("numInputRows", 0)),
            float(d.get("inputRowsPerSecond") or 0.0), float(d.get("processedRowsPerSecond") or 0.0),
            int((d.get("durationMs") or {}).get("triggerExecution", 0)),
            json.dumps([s.get("endOffset") for s in d.get("sources", [])]), dropped)


def progress_rows(spark: SparkSession, reports: list[tuple]) -> DataFrame:
    """Progress reports as rows (batch id, rows, rates, durations, source offsets)."""
    return spark.createDataFrame(reports, "batch_id long, num_input_rows long, input_rows_per_second double, "
                                          "processed_rows_per_second double, trigger_ms long, end_offsets string, "
                                          "rows_dropped_by_watermark long")


def wait_to_end(query, timeout_s: float | None = None) -> None:
    """Wait until a bounded stream has ended; its failure is raised.

    With ``timeout_s``, a query still running then is stopped and reported: a
    sink that holds a part of the rows never looks like a result.
    """
    if timeout_s is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout_s):
        query.stop()
        raise TimeoutError(f"the stream did not end within {timeout_s} s")
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


def run_to_table(df: DataFrame, name: str, output_mode: str = "append", trigger: dict | None = None,
                 timeout_s: float | None = None) -> tuple[DataFrame, list[tuple]]:
    """Drain a streaming frame (availableNow) into parquet under the checkpoint folder.

    Returns the sink as a batch frame and all progress reports; a stream that
    fails, or has not ended within ``timeout_s``, raises.
    """
    spark = df.sparkSession
    base = scratch_path(spark, f"streams/{name}-{uuid.uuid4().hex[:8]}")
    log = ProgressLog()
    spark.streams.addListener(log)
    try:
        q = start_sink(df, "parquet", f"{base}/data", f"{base}/ckpt", output_mode, trigger)
        wait_to_end(q, timeout_s)
        reports = log.of(q)
    finally:
        spark.streams.removeListener(log)
    return spark.read.schema(df.schema).parquet(f"{base}/data"), reports


# --- reliable micro-batch processing (X8, X12) ---------------------------------------------
def retrying_batch(fn: Callable[[DataFrame, int], None], dead_letter_path: str,
                   attempts: int = 3, backoff_s: float = 1.0):
    """A ``foreachBatch`` function retrying ``fn`` with back-off 1 s, 2 s, ...

    After the last failure the batch goes to ``dead_letter_path/batch_id=N``
    (overwrite, so a replayed batch id stays idempotent) instead of failing
    the query; without a path there would be nowhere to keep it.
    """
    if not dead_letter_path:
        raise ValueError("a dead-letter path is needed: a failed batch must not vanish")

    def run(batch: DataFrame, batch_id: int) -> None:
        for i in range(attempts):
            try:
                fn(batch, batch_id)
                return
            except Exception:  # noqa: BLE001
                if i == attempts - 1:
                    batch.write.mode("overwrite").parquet(f"{dead_letter_path}/batch_id={batch_id}")
                    return
                time.sleep(backoff_s * (2 ** i))
    return run


def idempotent_append(path: str) -> Callable[[DataFrame, int], None]:
    """Write each micro-batch to its own ``batch_id=N`` folder (replays overwrite, not duplicate)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


# Level 1: two fifths of the plain lines, at six times the speed of the default level.
EXPORT_CODEC = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


class AnalysisSink:
    """A ``foreachBatch`` function for analysed documents.

    Each batch goes to its own folder, as do its figures (one row); the running
    figures are their sum.  Whenever the documents so far pass a multiple of
    ``export_every``, all results so far are exported.  A
    replayed batch overwrites its own folders, so nothing counts twice.
    """

    def __init__(self, path: str, export_every: int = 1000) -> None:
        self.path, self.every, self.exports = path, export_every, []

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        target = f"{self.path}/results/batch_id={batch_id}"
        batch.write.mode("overwrite").option("compression", "zstd").parquet(target)
        done = spark.read.schema(batch.schema).parquet(target)
        done.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n_entities"), F.lit(0)).alias("entities"), *[
            F.count_if(F.col("sentiment_label") == x).alias(f"n_{x}") for x in SENTIMENT_LABELS]).write.mode(
            "overwrite").parquet(f"{self.path}/figures/batch_id={batch_id}")
        now = self.totals(spark).first()["documents"]
        before = now - done.count()
        if now // self.every > before // self.every:
            self.export(spark, now)

    def totals(self, spark: SparkSession) -> DataFrame:
        """The running figures (one row)."""
        names = ["documents", "entities", *[f"n_{x}" for x in SENTIMENT_LABELS]]
        f = spark.read.parquet(f"{self.path}/figures")
        return f.agg(*[F.sum(n).cast("bigint").alias(n) for n in names])

    def results(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/results").drop("batch_id")

    def export(self, spark: SparkSession, documents: int) -> None:
        """All results so far as JSON lines, compressed: every export holds what the ones before it hold."""
        target = f"{self.path}/exports/documents={documents}"
        self.results(spark).write.mode("overwrite").options(**EXPORT_CODEC).json(target)
        self.exports.append(target)


def running_counts(stream: DataFrame, key: str, name: str):
    """A12 on a stream: a running count per ``key`` kept current in complete mode.

    Each micro-batch overwrites the sink with the full updated aggregate
    (idempotent on replay); returns (sink path, finished query).
    """
    spark = stream.sparkSession
    base = scratch_path(spark, f"streams/{name}-{uuid.uuid4().hex[:8]}")
    agg = stream.groupBy(key).agg(F.count("*").cast("bigint").alias("n"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/data")

    q = (agg.writeStream.outputMode("complete").foreachBatch(write)
         .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
    wait_to_end(q)
    return f"{base}/data", q


# --- windows (X14) -------------------------------------------------------------------------
def windowed_counts(events: DataFrame, ts: str = "ts", size: str = "1 hour", delay: str = "1 hour",
                    slide: str | None = None, key: str = "event_type") -> DataFrame:
    """Event-time windows with a watermark (append mode emits closed windows only)."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return (events.withWatermark(ts, delay).groupBy(key, w.alias("w"))
            .agg(F.count("*").cast("bigint").alias("n"), F.sum("value").alias("total")))


# --- stateful alerts (X15) -----------------------------------------------------------------
ALERT_OUT = T.StructType([T.StructField("rule", T.StringType()), T.StructField("event_id", T.LongType()),
                          T.StructField("ts", T.TimestampType()), T.StructField("key", T.StringType()),
                          T.StructField("event", T.StringType()), T.StructField("value", T.DoubleType())])
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# Points of a waiting run (one state entry), and the points gathered before they are sorted and cut into runs.
RUN_POINTS = 1 << 13
GATHER_POINTS = 1 << 18
POINT_NAMES = ["us", "event_id", "key", "value", "cond", "cooldown_s"]


class AlertProcessor(StatefulProcessor):
    """The cooldown state machine of a rule (the grouping key) on a stream.

    Points wait in runs: up to ``RUN_POINTS`` of them in time order, as one Arrow
    entry of a map state under their first millisecond, at which a timer is set.
    So the calls to the state store grow with the runs.  The first timer that
    expires merges the runs that begin by the watermark and evaluates their points
    up to it; what is left of them waits again.  In hand are the runs that overlap
    and a few more.  The last fire is a value, the active label sets are the keys
    of a map; what a task has read of them it remembers until the batch ends.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last_fired", "us long")
        self.active = handle.getMapState("active", "key string", "since long")
        self.waiting = handle.getMapState("waiting", "ms long, no long", "points binary")
        self.runs = handle.getValueState("runs", "n long")
        self.rules: dict[str, RuleState] = {}
        self.read: set[tuple[str, str]] = set()
        self.done: dict[str, int] = {}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for pdf in rows:
            points = pdf[["event_id", "key", "value", "cooldown_s"]].copy()
            points["us"] = pdf["ts"].astype("datetime64[us]").astype("int64")
            points["cond"] = pdf["cond"].map(bool).astype(bool)
            held.append(points[POINT_NAMES])
            n += len(points)
            if n >= GATHER_POINTS:
                self._keep(held)
                held, n = [], 0
        self._keep(held)
        yield pd.DataFrame()

    def _keep(self, frames: list[pd.DataFrame]) -> None:
        """The points as waiting runs, each with a timer at its first millisecond."""
        points = _in_order(frames)
        if not len(points):
            return
        found = self.runs.get()
        no = found[0] if found is not None else 0
        for at in range(0, len(points), RUN_POINTS):
            run = points.iloc[at:at + RUN_POINTS]
            ms = int(run["us"].iloc[0]) // 1000
            batch = pa.RecordBatch.from_pandas(run, preserve_index=False)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            self.waiting.updateValue((ms, no), (sink.getvalue().to_pybytes(),))
            self.handle.registerTimer(ms)
            no += 1
        self.runs.update((no,))

    def _take(self, run: tuple[int, int]) -> pd.DataFrame:
        points = pa.ipc.open_stream(bytes(self.waiting.getValue(run)[0])).read_pandas()
        self.waiting.removeKey(run)
        return points

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rule = key[0]
        bound = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        if self.done.get(rule) == bound:  # an earlier timer of this batch has seen to all of them
            yield pd.DataFrame()
            return
        self.done[rule] = bound
        due = sorted(tuple(k) for k in self.waiting.keys() if k[0] <= bound)
        pool, size, left = [], 0, 0
        for i, run in enumerate(due):
            pool.append(self._take(run))
            size += len(pool[-1])
            last = i + 1 == len(due)
            if last or size >= max(8 * RUN_POINTS, 2 * left):
                end = bound + 1 if last else due[i + 1][0]  # later runs begin here
                points = _in_order(pool)
                ready = int(points["us"].searchsorted(end * 1000))
                out = self._evaluate(rule, points.iloc[:ready])
                if out:
                    yield pd.DataFrame(out, columns=[f.name for f in ALERT_OUT.fields])
                pool = [points.iloc[ready:]]
                size = left = len(points) - ready
        self._keep(pool)
        yield pd.DataFrame()

    def _evaluate(self, rule: str, points: pd.DataFrame) -> list[tuple]:
        if rule not in self.rules:
            found = self.last.get()
            self.rules[rule] = RuleState(found[0] if found is not None else None)
        state, out = self.rules[rule], []
        for us, event_id, k, value, cond, cooldown_s in zip(*[points[c].tolist() for c in POINT_NAMES], strict=True):
            cooldown = cooldown_s * 1_000_000
            if not state.awake(us, cooldown):
                continue
            if (rule, k) not in self.read:
                self.read.add((rule, k))
                if self.active.containsKey((k,)):
                    state.active.add(k)
            event = state.step(us, k, cond, cooldown)
            if event == "fired":
                self.active.updateValue((k,), (us,))
                self.last.update((us,))
            elif event:
                self.active.removeKey((k,))
            if event:
                out.append((rule, event_id, pd.Timestamp(us, unit="us"), k, event, value))
        return out

    def close(self) -> None:
        pass


def _in_order(frames: list[pd.DataFrame]) -> pd.DataFrame:
    points = pd.concat(frames, ignore_index=True) if frames else pd.DataFrame(columns=POINT_NAMES)
    return points.sort_values(["us", "event_id"], kind="stable", ignore_index=True)


def keyed_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which map states and timers need."""
    return setting(spark, STATE_STORE, ROCKSDB)


def match_rules_stream(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Stream-static rule matching, as in batch: exploded name prefixes joined to the rules."""
    return match_rules(metrics, rules).select("rule", "event_id", "ts", "key", "value", "cond", "cooldown_s")


def stateful_alerts(points: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """K12-K14 on a stream, state kept per rule by :class:`AlertProcessor`; start it under :func:`keyed_state`.

    ``points`` = matched metric points (rule, event_id, ts, key, value, cond,
    cooldown_s).  ``delay`` is how much later than the newest point another may
    still come; points are evaluated in time order once the watermark passes.
    """
    return points.withWatermark("ts", delay).groupBy("rule").transformWithStateInPandas(
        AlertProcessor(), ALERT_OUT, "Append", "EventTime")


def hybrid(batch: DataFrame, stream: DataFrame, name: str = "hybrid") -> DataFrame:
    """Historical batch frame + a bounded (availableNow) stream, unioned by name."""
    drained, _ = run_to_table(stream, name)
    return batch.unionByName(drained, allowMissingColumns=True)
