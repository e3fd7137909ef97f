"""The alert state machine (K13/K14) over time blocks, in parallel and exact.

A fired rule mutes itself for every label set until its cooldown ends, so each
decision of a rule depends on the one before.  The points of all rules are
range-partitioned by (rule, time); a partition's part of a rule is a block.
Every block first runs as if nothing had happened before it and reports what it
leaves behind: its last fire, and for each label set it decided on whether that
is active.  From these reports follows what every block should have started
from.  Blocks that had started from something else run again, until none had.

The first block of a rule is right from the start and every round settles at
least the next one, so the end is the sequential result whatever the rounds; a
block only runs again where an alert or a cooldown crosses its border, and a
cooldown that ended before a block began is no difference.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quill.session import staged

# Points of a block: narrow rows, streamed through a task.
BLOCK_POINTS = 1 << 20
POINT_COLS = ["rule", "ts", "event_id", "key", "value", "cond", "cooldown_s"]
# what: event (fired or resolved), key (label set decided on, active or not), last (last fire of the block)
REPORT = ("rule string, block long, what string, event_id long, ts timestamp_ntz, key string, event string, "
          "value double, active boolean")
ENTRY = "rule string, block long, key string, ts timestamp_ntz"


class RuleState:
    """The alert state of one rule: when it last fired (any time unit) and which label sets are active."""

    def __init__(self, last_fired=None, active=()) -> None:
        self.last_fired, self.active = last_fired, set(active)

    def awake(self, ts, cooldown) -> bool:
        return self.last_fired is None or ts - self.last_fired >= cooldown

    def step(self, ts, key: str, cond: bool, cooldown) -> str | None:
        """``fired``, ``resolved`` or None for the next point in time order."""
        if not self.awake(ts, cooldown):
            return None
        if cond and key not in self.active:
            self.active.add(key)
            self.last_fired = ts
            return "fired"
        if not cond and key in self.active:
            self.active.discard(key)
            return "resolved"
        return None


class _Block:
    """One block in a task: the state it started from, and what it has decided on."""

    def __init__(self, rule: str, block: int) -> None:
        self.rule, self.block, self.state, self.touched, self.fired = rule, block, RuleState(), set(), None

    def report(self) -> Iterator[pd.DataFrame]:
        rows = [(self.rule, self.block, "key", None, None, k, None, None, k in self.state.active) for k in sorted(self.touched)]
        if self.fired is not None:
            rows.append((self.rule, self.block, "last", None, self.fired, None, None, None, None))
        if rows:
            yield pd.DataFrame(rows, columns=_NAMES)


_NAMES = [f.split()[0] for f in REPORT.split(", ")]


def _run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by (rule, block, entry first, ts, event_id); only the current block's state is held.

    No frame without rows is given out: Arrow makes chunked arrays of its columns, which Spark refuses.
    """
    now = None
    for pdf in frames:
        at, names = [], []
        us = pdf["ts"].astype("datetime64[us]").astype("int64")
        for i, (rule, block, entry, ts, key, cond, cool) in enumerate(zip(
                pdf["rule"], pdf["block"], pdf["entry"], us, pdf["key"], pdf["cond"], pdf["cooldown_s"], strict=True)):
            if now is None or rule != now.rule or block != now.block:
                if now is not None:
                    yield from now.report()
                now = _Block(rule, block)
            if entry:
                if key is None:
                    now.state.last_fired = ts
                else:
                    now.state.active.add(key)
                continue
            cool = int(cool) * 1_000_000
            if not now.state.awake(ts, cool):
                continue
            now.touched.add(key)
            event = now.state.step(ts, key, cond, cool)
            if event:
                at.append(i)
                names.append(event)
                if event == "fired":
                    now.fired = pd.Timestamp(ts, unit="us")
        if at:
            out = pdf.iloc[at][["rule", "block", "event_id", "ts", "key", "value"]].copy()
            out["what"], out["event"], out["active"] = "event", names, None
            yield out[_NAMES]
    if now is not None:
        yield from now.report()


def _reports(points: DataFrame, entries: DataFrame | None) -> DataFrame:
    rows = points.withColumn("entry", F.lit(False))
    if entries is not None:
        rows = rows.unionByName(entries.withColumn("entry", F.lit(True)), allowMissingColumns=True)
    rows = rows.withColumn("cond", F.coalesce("cond", F.lit(False))).withColumn("cooldown_s", F.coalesce("cooldown_s", F.lit(0)))
    rows = rows.repartition("rule", "block").sortWithinPartitions("rule", "block", F.desc("entry"), "ts", "event_id")
    return rows.mapInPandas(_run, REPORT)


def _entries(reports: DataFrame, keys: DataFrame, starts: DataFrame) -> DataFrame:
    """What each block should start from: the active label sets that it has points of, and the last fire."""
    before = lambda *by: Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    left = reports.filter("what = 'key'").select("rule", "block", "key", "active")
    active = keys.join(left, ["rule", "block", "key"], "left").withColumn(
        "on", F.last("active", ignorenulls=True).over(before("rule", "key")))
    active = active.filter("on").select("rule", "block", "key", F.lit(None).cast("timestamp_ntz").alias("ts"))
    fired = reports.filter("what = 'last'").select("rule", "block", F.col("ts").alias("fired"))
    last = starts.join(fired, ["rule", "block"], "left").withColumn("ts", F.max("fired").over(before("rule")))
    muted = F.col("start") < F.col("ts") + F.make_dt_interval(secs=F.col("cooldown_s"))
    last = last.filter(muted).select("rule", "block", F.lit(None).cast("string").alias("key"), "ts")
    return active.unionByName(last)


def _different(a: DataFrame, b: DataFrame) -> DataFrame:
    """The blocks whose entries are not the same in both."""
    both = a.withColumn("side", F.lit(1)).unionByName(b.withColumn("side", F.lit(-1)))
    odd = both.groupBy("rule", "block", "key", "ts").agg(F.sum("side").alias("n")).filter("n <> 0")
    return odd.select("rule", "block").distinct()


class Alerts(NamedTuple):
    """Fire and resolve events, and how many times blocks ran: rounds, and the blocks of each."""

    events: DataFrame
    rounds: list[int]


def run_rules(points: DataFrame, blocks: int | None = None) -> Alerts:
    """Events of matched points (``POINT_COLS``, unique by rule, ts and event_id).

    ``blocks``: partitions of all points; by default one for every ``BLOCK_POINTS``.
    """
    spark = points.sparkSession
    given = staged(points.select(*POINT_COLS), "alert-points")
    blocks = blocks or -(-given.count() // BLOCK_POINTS)
    p = given.withColumn("block", F.lit(0).cast("bigint"))
    if blocks > 1:
        order = ["rule", "ts", "event_id"]
        p = given.repartitionByRange(blocks, *order).withColumn("block", F.spark_partition_id().cast("bigint"))
        p = staged(p, "alert-blocks")
    reports, rounds = _reports(p, None), [blocks]
    if blocks > 1:
        keys = staged(p.select("rule", "block", "key").distinct(), "alert-keys")
        starts = staged(p.groupBy("rule", "block").agg(F.min("ts").alias("start"), F.max("cooldown_s").alias("cooldown_s")),
                        "alert-starts")
        reports = staged(reports, "alert-reports")
        ran = spark.createDataFrame([], ENTRY)
        while True:
            want = staged(_entries(reports, keys, starts), "alert-entries")
            again = staged(_different(want, ran), "alert-again")
            n = again.count()
            if not n:
                break
            new = _reports(p.join(again, ["rule", "block"], "left_semi"), want.join(again, ["rule", "block"], "left_semi"))
            reports = staged(reports.join(again, ["rule", "block"], "left_anti").unionByName(new), "alert-reports")
            ran = want
            rounds.append(n)
    return Alerts(reports.filter("what = 'event'").select("rule", "event_id", "ts", "key", "event", "value"), rounds)
