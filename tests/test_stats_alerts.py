"""Brute-force checks: distributed order statistics and the alert state machine."""

import datetime as dt
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quill.operators import alerts as al
from quill.operators import cooldown as cd
from quill.operators import stats as st
from quill.plans import fixtures as fx
from quill.plans.q_monitor import RULES, rules_df

SF = "/root/testdata/sf0.001"


def test_quantiles_match_numpy_and_statistics(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet").select(F.col("event_type").alias("g"), "value")
    lin = {r.g: r for r in st.quantiles_linear(ev, ["g"], "value", {"q1": 0.25, "med": 0.5}).collect()}
    exc = {r.g: r for r in st.quantiles_exclusive(ev, ["g"], "value", {"p90": 90}, k=100).collect()}
    flo = {r.g: r for r in st.quantiles_floor(ev, ["g"], "value", {"p95": 0.95}).collect()}
    pdf = ev.toPandas()
    for g, grp in pdf.groupby("g"):
        v = np.sort(grp["value"].to_numpy())
        assert abs(lin[g].q1 - np.quantile(v, 0.25)) < 1e-9
        assert abs(lin[g].med - np.median(v)) < 1e-9
        assert abs(exc[g].p90 - statistics.quantiles(list(v), n=100)[89]) < 1e-9
        assert flo[g].p95 == v[min(int(len(v) * 0.95), len(v) - 1)]


def brute_alerts(points: pd.DataFrame, rules) -> set:
    out = set()
    for name, source, op, thr, sev, cool, _ in rules:
        p = points[points["name"].str.startswith(source)].sort_values(["ts", "event_id"])
        last, active = None, set()
        for r in p.itertuples():
            if last is not None and (r.ts - last).total_seconds() < cool:
                continue
            cond = {">": r.value > thr, "<": r.value < thr, ">=": r.value >= thr}[op]
            key = f"{r.name}{{k={r.k}}}"
            if cond and key not in active:
                active.add(key)
                last = r.ts
                out.add((name, r.event_id, "fired"))
            elif not cond and key in active:
                active.discard(key)
                out.add((name, r.event_id, "resolved"))
    return out


def test_alert_cooldown_matches_loop(spark):
    m = fx.metric_points(spark, SF)
    got = {(r.rule, r.event_id, r.event) for r in al.alert_events(m, rules_df(spark)).collect()}
    pdf = m.select("event_id", "ts", "name", F.col("labels")["k"].alias("k"), "value").toPandas()
    assert got == brute_alerts(pdf, RULES)


def series(spark, rows):
    """Matched points (rule, second, label set, condition, cooldown)."""
    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(r, t0 + dt.timedelta(seconds=s), i, k, float(i), c, cool) for i, (r, s, k, c, cool) in
                                  enumerate(rows)], "rule string, ts timestamp_ntz, event_id long, key string, value double, "
                                                    "cond boolean, cooldown_s long")


def one_by_one(rows):
    out, state = set(), {}
    for i, (r, s, k, c, cool) in sorted(enumerate(rows), key=lambda x: (x[1][1], x[0])):
        st_ = state.setdefault(r, cd.RuleState())
        event = st_.step(s, k, c, cool)
        if event:
            out.add((r, i, k, event))
    return out


def ran(alerts):
    return {(r.rule, r.event_id, r.key, r.event) for r in alerts.events.collect()}


@pytest.mark.parametrize("blocks", [None, 1, 7, 200])
def test_blocks_give_the_sequential_result(spark, blocks):
    rng = np.random.default_rng(4)
    rules = [("a", 30), ("b", 0), ("c", 5000), ("hot", 3)]
    rows = []
    for _ in range(1500):
        name, cool = rules[min(3, rng.integers(0, 8))]
        rows.append((name, int(rng.integers(0, 4000)), f"k{rng.integers(0, 4)}", bool(rng.random() < 0.5), cool))
    got = cd.run_rules(series(spark, rows), blocks)
    assert ran(got) == one_by_one(rows)
    assert (len(got.rounds) > 1) == (blocks in (7, 200))


def test_every_block_starts_from_another_state(spark):
    """A fire every seven seconds and points every second: each block's first guess is wrong."""
    rows = [("r", s, f"k{s % 3}", s % 2 == 0 or s % 5 > 1, 7) for s in range(240)]
    got = cd.run_rules(series(spark, rows), 24)
    assert ran(got) == one_by_one(rows)
    assert got.rounds[0] == 24 and got.rounds[1] >= 20


def test_a_label_set_is_active_over_blocks_without_its_points(spark):
    rows = [("r", 0, "x", True, 0)] + [("r", s, "y", s % 2 == 0, 0) for s in range(1, 100)] + [("r", 200, "x", True, 0), ("r", 201, "x", False, 0)]
    got = cd.run_rules(series(spark, rows), 12)
    assert ran(got) == one_by_one(rows)
    assert cd.run_rules(series(spark, []), 5).events.count() == 0


def test_previous_value_matches_window_lag(spark):
    from pyspark.sql import Window
    ev = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts", "event_type", "value")
    got = st.previous_value(ev, ["event_type"], [F.col("ts"), F.col("event_id")], "value", "prev", n_parts=7)
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    ref = ev.withColumn("ref", F.lag("value").over(w))
    j = got.join(ref.select("event_id", "ref"), "event_id")
    assert j.count() == ev.count()
    assert j.filter(~F.col("prev").eqNullSafe(F.col("ref"))).count() == 0
