"""Readers and streams on hand-made files: numbering, patterns, policies, whole results."""

import pytest
from pyspark.sql import functions as F

from quill.sources import readers as rd
from quill.streaming import stream as xs


def test_line_numbers_count_blank_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\n\n y\nz \n")
    (tmp_path / "b.txt").write_text("\xa0c\xa0\r\n\r\nd", encoding="utf-8", newline="")
    got = sorted((r._source_file.rsplit("/", 1)[1], r.text, r.line_number)
                 for r in rd.read_text_lines(spark, str(tmp_path)).collect())
    assert got == [("a.txt", "x", 1), ("a.txt", "y", 3), ("a.txt", "z", 4), ("b.txt", "c", 1), ("b.txt", "d", 3)]


def test_line_numbers_across_splits(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 97) if i % 7 else "" for i in range(20000)]
    (tmp_path / "big.txt").write_text("\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        df = rd.read_text_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        got = {r.line_number: r.text for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {i + 1: x.strip() for i, x in enumerate(lines) if x}


@pytest.fixture
def mixed(tmp_path):
    d = tmp_path / "mixed"
    (d / "sub").mkdir(parents=True)
    (d / "report_a.csv").write_text("id,text\n1,one\n2,two\n")
    (d / "sub" / "report_b.json").write_text('{"id": 3, "text": "three"}\n')
    (d / "notes.txt").write_text("four\n\nfive\n")
    (d / "more.yaml").write_text("id: 6\ntext: six\n")
    (d / "other.bin").write_bytes(b"\x00\x01")
    (d / "UPPER.CSV").write_text("id,text\n7,seven\n")
    return str(d)


def test_directory_loads_every_format(spark, mixed):
    got = rd.load_directory(spark, mixed, errors="skip")
    assert got.filter("_loaded_at IS NULL OR _source_file IS NULL").count() == 0
    files = {r[0].rsplit("/", 1)[1]: r[1] for r in got.groupBy("_source_file").count().collect()}
    assert files == {"report_a.csv": 2, "report_b.json": 1, "notes.txt": 2, "more.yaml": 1, "UPPER.CSV": 1}


def test_directory_patterns(spark, mixed):
    names = lambda df: sorted({r[0].rsplit("/", 1)[1] for r in df.select("_source_file").collect()})
    assert names(rd.load_directory(spark, mixed, "report_*")) == ["report_a.csv", "report_b.json"]
    assert names(rd.load_directory(spark, mixed, "*.csv")) == ["report_a.csv"]
    assert names(rd.load_directory(spark, mixed, "report_*", recursive=False)) == ["report_a.csv"]
    assert names(rd.load_directory(spark, mixed, "*.[tc]?[tv]")) == ["notes.txt", "report_a.csv"]
    assert rd.load_directory(spark, mixed, "nothing*").count() == 0


@pytest.mark.parametrize("pattern,ext,want", [
    ("*", ".csv", "*.csv"), ("a*", ".csv", "a*.csv"), ("*.csv", ".csv", "*.csv"), ("*.csv", ".txt", None),
    ("*.?sv", ".csv", "*.csv"), ("x[ab].[ct]sv", ".csv", "x[ab].csv"), ("v", ".csv", None), ("a*v", ".csv", "a*.csv")])
def test_narrowed_patterns(pattern, ext, want):
    assert rd.narrowed(pattern, ext) == want


def test_error_policies(spark, mixed):
    for errors in ("skip", "log"):
        assert rd.load_file(spark, f"{mixed}/missing.csv", errors=errors).count() == 0
        assert rd.load_file(spark, f"{mixed}/other.bin", errors=errors).count() == 0
        assert rd.load_directory(spark, f"{mixed}/none", errors=errors).count() == 0
    for bad in (lambda: rd.load_file(spark, f"{mixed}/missing.csv", errors="raise"),
                lambda: rd.load_file(spark, f"{mixed}/other.bin", errors="raise"),
                lambda: rd.load_directory(spark, mixed, errors="raise"),
                lambda: rd.load_batch(spark, [f"{mixed}/none"], errors="raise")):
        with pytest.raises(RuntimeError):
            bad()


def test_batch_of_files_and_folders_with_stats(spark, mixed):
    df = rd.load_batch(spark, [f"{mixed}/report_a.csv", f"{mixed}/sub", f"{mixed}/none"],
                       lambda d: d.withColumn("n", F.length("text")), errors="skip")
    assert sorted((r.text, r.n) for r in df.collect()) == [("one", 3), ("three", 5), ("two", 3)]
    s = rd.load_stats(df).first()
    assert (s.files, s.records, s.errors) == (2, 3, 0) and s.duration_s >= 0 and s.end_time >= s.start_time


def test_stream_reports_every_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i in range(130):
        (src / f"f{i:03d}.txt").write_text(f"{i}\n")
    out, reports = xs.run_to_table(xs.file_stream(spark, str(src), "text", max_files_per_trigger=1), "every")
    assert out.count() == 130
    assert len({r[0] for r in reports}) == 130 and sum(r[1] for r in reports) == 130


def test_stream_that_does_not_end_in_time_raises(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i in range(40):
        (src / f"f{i}.txt").write_text("x\n")
    with pytest.raises(TimeoutError):
        xs.run_to_table(xs.file_stream(spark, str(src), "text", max_files_per_trigger=1), "late", timeout_s=0.2)
    assert not spark.streams.active


def test_failed_batches_need_a_place_and_go_there(spark, tmp_path):
    with pytest.raises(ValueError):
        xs.retrying_batch(lambda b, i: None, "")
    calls = []

    def fail(batch, batch_id):
        calls.append(batch_id)
        raise RuntimeError("no")
    xs.retrying_batch(fail, f"{tmp_path}/dead", backoff_s=0.01)(spark.range(5).toDF("id"), 7)
    assert calls == [7, 7, 7] and spark.read.parquet(f"{tmp_path}/dead").count() == 5


def test_kafka_options_and_unknown_sinks(spark, tmp_path):
    assert xs.kafka_options("h:9092", "docs") == {
        "kafka.bootstrap.servers": "h:9092", "subscribe": "docs", "startingOffsets": "latest", "failOnDataLoss": "false",
        "maxOffsetsPerTrigger": "1000"}
    assert "maxOffsetsPerTrigger" not in xs.kafka_options("h", "t", max_offsets_per_trigger=None)
    src = tmp_path / "in"
    src.mkdir()
    with pytest.raises(ValueError):
        xs.start_sink(xs.file_stream(spark, str(src), "text"), "bad")


def test_stream_alerts_equal_batch_whatever_the_files(spark, tmp_path):
    import datetime as dt
    import random

    from quill.operators import alerts as al
    # some points share a millisecond
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i // 4 * 28 if i % 9 < 3 else i * 7, microseconds=i % 2 * 300),
             f"m{i % 3}", {"h": str(i % 5)}, float(i * 7919 % 13)) for i in range(2000)]
    schema = "event_id long, ts timestamp, name string, labels map<string,string>, value double"
    df = spark.createDataFrame(rows, schema)
    rules = spark.createDataFrame([("a", "m", ">", 9.0, "high", 60, "x"), ("b", "m1", "<", 3.0, "low", 0, "y")], al.RULE_SCHEMA)
    want = sorted((r.rule, r.event_id, r.event, r.key) for r in al.alert_events(
        df.withColumn("ts", F.col("ts").cast("timestamp_ntz")), rules).collect())
    assert len(want) > 20

    def streamed(name, files, delay, per_batch=1):
        for k, part in enumerate(files):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        s = xs.file_stream(spark, f"{tmp_path}/{name}", "parquet", schema=df.schema, max_files_per_trigger=per_batch)
        with xs.keyed_state(spark):
            out, _ = xs.run_to_table(xs.stateful_alerts(xs.match_rules_stream(s, rules), delay), name)
        return sorted((r.rule, r.event_id, r.event, r.key) for r in out.collect())

    assert streamed("one", [rows], "0 seconds") == want
    shuffled = random.Random(5).sample(rows, len(rows))
    assert streamed("batch", [shuffled[i::20] for i in range(20)], "0 seconds", per_batch=20) == want
    # each file holds points of its neighbours' times, up to 700 s out of order; a last late point moves the watermark on
    mixed = sorted(rows, key=lambda r: r[0] + random.Random(r[0]).randint(0, 100))
    end = [(9999, dt.datetime(2024, 1, 2), "other", {}, 0.0)]
    parts = [mixed[i:i + 100] for i in range(0, 2000, 100)] + [[(9998, dt.datetime(2024, 1, 2), "m0", {"h": "z"}, 5.0)], end]
    assert streamed("many", parts, "1000 seconds") == want


def test_csv_keeps_quotes_line_breaks_and_outer_blanks(spark, tmp_path):
    from quill.sources import sinks as sk
    rows = [(1, 'say "hi", then\nleave'), (2, "  blanks  "), (3, "back\\slash \"end\""), (4, ",;'")]
    sk.write_csv(spark.createDataFrame(rows, "id long, text string"), f"{tmp_path}/c")
    got = rd.read_csv(spark, f"{tmp_path}/c", schema="id long, text string").collect()
    assert sorted((r.id, r.text) for r in got) == rows


class _Value:
    def __init__(self, calls):
        self.calls, self.v = calls, None

    def get(self):
        self.calls.append("get")
        return self.v

    def update(self, v):
        self.calls.append("update")
        self.v = v


class _Map(dict):
    def __init__(self, calls):
        super().__init__()
        self.calls = calls

    def getValue(self, k):
        self.calls.append("getValue")
        return self.get(k)

    def updateValue(self, k, v):
        self.calls.append("updateValue")
        self[k] = v

    def removeKey(self, k):
        self.calls.append("removeKey")
        self.pop(k, None)

    def containsKey(self, k):
        self.calls.append("containsKey")
        return k in self


class _Store:
    """A state store in memory that counts its calls, and its timers."""

    def __init__(self):
        self.calls, self.states, self.timers = [], {}, set()

    def getValueState(self, name, schema):
        return self.states.setdefault(name, _Value(self.calls))

    def getMapState(self, name, key, value, ttl=None):
        return self.states.setdefault(name, _Map(self.calls))

    def registerTimer(self, ms):
        self.calls.append("registerTimer")
        self.timers.add(ms)


class _At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    getExpiryTimeInMs = getCurrentWatermarkInMs


def test_waiting_points_cost_no_state_call_each(monkeypatch):
    """Overlapping batches, runs cut by the watermark: the sequential events, with few calls to the state store."""
    import random

    import pandas as pd

    from quill.operators.cooldown import RuleState
    monkeypatch.setattr(xs, "RUN_POINTS", 500, raising=False)
    monkeypatch.setattr(xs, "GATHER_POINTS", 4000, raising=False)
    rng = random.Random(5)
    batches = []
    for b in range(4):  # batch b spans 20 s from 10 b s on: every one overlaps the next
        batches.append([(b * 10_000_000 + rng.randrange(20_000_000), b * 10_000 + i, f"h={rng.randrange(9)}", rng.random())
                        for i in range(10_000)])
    batches[3].append((60_000_000, 99_999, "h=0", 1.0))
    store, got = _Store(), []
    for b, rows in enumerate([*batches, []]):
        p = xs.AlertProcessor()
        p.init(store)
        chunk = [pd.DataFrame({"ts": pd.to_datetime([r[0] for r in part], unit="us"), "event_id": [r[1] for r in part],
                               "key": [r[2] for r in part], "value": [r[3] for r in part], "cond": [r[3] > 0.9 for r in part],
                               "cooldown_s": 1}) for part in (rows[i:i + 3000] for i in range(0, len(rows), 3000))]
        wm = b * 10_000 - 1 if rows else 60_000
        if chunk:
            list(p.handleInputRows(("r",), iter(chunk), _At(wm)))
        for ms in sorted(x for x in store.timers if x <= wm):
            store.timers.discard(ms)
            got += [r for f in p.handleExpiredTimer(("r",), _At(wm), _At(ms)) for r in f.itertuples(index=False)]
    state, want = RuleState(), []
    for us, e, k, v in sorted(r for rows in batches for r in rows):
        if event := state.step(us, k, v > 0.9, 1_000_000):
            want.append((e, event))
    assert [(r.event_id, r.event) for r in got] == want and len(want) > 20
    assert not store.states["waiting"] and not store.timers and len(store.calls) < 2000
