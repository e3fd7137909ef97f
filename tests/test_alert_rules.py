"""Alert identity, templates and metric keys on hand-made points."""

import datetime as dt

from pyspark.sql import functions as F

from quill.operators import alerts as al
from quill.operators import cooldown
from quill.operators import metrics as mt

T0 = dt.datetime(2024, 1, 1)
POINT = "event_id long, ts timestamp_ntz, name string, labels map<string,string>, value double"


def points(spark, rows):
    return spark.createDataFrame([(i, T0 + dt.timedelta(seconds=s), n, lab, float(v))
                                  for i, (s, n, lab, v) in enumerate(rows)], POINT)


def rule(spark, *rows):
    return spark.createDataFrame(list(rows), al.RULE_SCHEMA)


def test_one_alert_per_rule_and_labels_over_overlapping_prefixes(spark):
    pts = points(spark, [(0, "cpu_a", {"h": "1"}, 9), (1, "cpu_b", {"h": "1"}, 9), (2, "cpu_b", {"h": "2"}, 9),
                         (3, "cpu_a", {"h": "1"}, 1), (4, "cpu", {}, 9)])
    rules = rule(spark, ("hot", "cpu", ">", 5.0, "high", 0, "host {h} at {value:.1f} of {other}"),
                 ("hot_b", "cpu_b", ">", 5.0, "low", 0, "{value}"))
    want = [("hot", "", "fired", 4), ("hot", "h=1", "fired", 0), ("hot", "h=1", "resolved", 3), ("hot", "h=2", "fired", 2),
            ("hot_b", "h=1", "fired", 1), ("hot_b", "h=2", "fired", 2)]
    ev = al.alert_events(pts, rules).collect()
    assert sorted((r.rule, r.key, r.event, r.event_id) for r in ev) == want
    messages = {(r.rule, r.key): r.message for r in ev if r.event == "fired"}
    assert messages[("hot", "h=1")] == "host 1 at 9.0 of {other}" and messages[("hot_b", "h=2")] == "9.0"
    assert messages[("hot", "")] == "host {h} at 9.0 of {other}"
    plain = al.alert_fire(pts, rules).collect()
    assert sorted((r.rule, r.key, r.event, r.event_id) for r in plain) == want


def test_cooldown_mutes_all_label_sets_of_the_rule(spark):
    pts = points(spark, [(0, "m", {"h": "1"}, 9), (5, "m", {"h": "2"}, 9), (10, "m", {"h": "2"}, 9), (11, "m", {"h": "1"}, 1),
                         (20, "m", {"h": "1"}, 1)])
    ev = al.alert_events(pts, rule(spark, ("r", "m", ">", 5.0, "high", 10, "{value}"))).collect()
    assert sorted((r.event_id, r.event) for r in ev) == [(0, "fired"), (2, "fired"), (4, "resolved")]


def test_same_events_from_any_partitioning(spark):
    rows = [(i * 3 % 997, f"m{i % 3}", {"h": str(i % 5)}, (i * 7919) % 13) for i in range(2000)]
    rules = rule(spark, ("a", "m", ">", 9.0, "high", 30, "x"), ("b", "m1", "<", 3.0, "low", 0, "y"))
    key = lambda df: sorted((r.rule, r.event_id, r.event, r.key) for r in df.collect())
    one = key(al.alert_events(points(spark, rows).coalesce(1), rules))
    assert one == key(al.alert_events(points(spark, rows).orderBy(F.rand(3)).repartition(20), rules)) and len(one) > 20


def test_long_stretches_without_events(spark):
    """Frames of a task in which nothing fires or is resolved, at the start, in the middle and in a block of its own."""
    hot = {0, 25_000, 25_001, 90_000}
    pts = spark.range(100_000).selectExpr("'r' AS rule", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id) AS ts", "id AS event_id",
                                          "'k' AS key", "1.0D AS value", f"id IN ({', '.join(map(str, hot))}) AS cond", "5L AS cooldown_s")
    want = [(0, "fired"), (5, "resolved"), (25_000, "fired"), (25_005, "resolved"), (90_000, "fired"), (90_005, "resolved")]
    for blocks in (None, 7):
        assert sorted((r.event_id, r.event) for r in cooldown.run_rules(pts, blocks).events.collect()) == want


def test_default_rules(spark):
    pts = points(spark, [(0, "system_cpu_percent", {}, 91.26), (1, "documents_processed_per_minute", {}, 4),
                         (2, "system_disk_percent", {}, 89)])
    ev = al.alert_events(pts, al.default_rules(spark)).collect()
    assert {r.message for r in ev} == {"CPU usage is 91.3%, exceeding threshold",
                                       "Document processing throughput is 4.0 docs/min, below threshold"}
    assert al.default_rules(spark).count() == 6


def test_histograms_and_buckets_keep_labels_apart(spark):
    pts = points(spark, [(0, "cpu_a", {"h": "1"}, 1), (1, "cpu_a", {"h": "2"}, 3), (2, "cpu_a", {"h": "1"}, 2)])
    h = {r.key: (r["count"], r.max) for r in mt.histograms(pts).collect()}
    assert h == {"cpu_a{h=1}": (2, 2.0), "cpu_a{h=2}": (1, 3.0)}
    b = {(r.key, r.le): r["count"] for r in mt.buckets(pts).collect()}
    assert b[("cpu_a{h=1}", "1.0")] == 1 and b[("cpu_a{h=1}", "+Inf")] == 2 and b[("cpu_a{h=2}", "2.0")] == 0


def test_throughput_window_crosses_bucket_edges(spark):
    secs = [0, 50, 3599, 3600, 3650, 4400, 4499, 4500, 7300]
    pts = points(spark, [(s, "m", {}, 1) for s in secs])
    got = {r.sec: r for r in mt.throughput(pts).collect()}
    base = int((T0 - dt.datetime(1970, 1, 1)).total_seconds())
    assert len(got) == len(secs)
    for s in secs:
        for span in (60, 300, 900):
            assert got[base + s][f"rate_{span}s"] == sum(s - span <= x <= s for x in secs) / span
