"""Threshold alerts and health rollups.

Rules are data: ``rules(name, source, op, threshold, severity, cooldown_s,
template)``.  A rule watches every metric whose name starts with its
``source``; an alert is known by its rule and the point's labels, whatever
the metric's name.  Points meet rules by an equi-join of the exploded name
prefixes with the rule table.

The cooldown makes a rule's evaluation sequential: a fired rule ignores
all its points, for every label set, until the cooldown ends.  That state
machine runs over time blocks in parallel (:mod:`quill.operators.cooldown`).
Without a cooldown (K12) alerts are independent per (rule, label set) and
reduce to edge detection with ``lag``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quill.operators import stats as st
from quill.operators.cooldown import run_rules

SEVERITIES = ["low", "medium", "high", "critical"]
RULE_SCHEMA = "name string, source string, op string, threshold double, severity string, cooldown_s long, template string"
# The default rules (name, source, op, threshold, severity, cooldown_s, template).
DEFAULT_RULES = [
    ("high_cpu_usage", "system_cpu_percent", ">", 80.0, "high", 300, "CPU usage is {value:.1f}%, exceeding threshold"),
    ("high_memory_usage", "system_memory_percent", ">", 85.0, "high", 300, "Memory usage is {value:.1f}%, exceeding threshold"),
    ("high_disk_usage", "system_disk_percent", ">", 90.0, "critical", 600, "Disk usage is {value:.1f}%, exceeding threshold"),
    ("slow_document_processing", "document_processing_duration", ">", 5.0, "medium", 180,
     "Document processing time is {value:.2f}s, exceeding threshold"),
    ("high_model_latency", "model_inference_duration", ">", 2.0, "medium", 180,
     "Model inference latency is {value:.2f}s, exceeding threshold"),
    ("low_processing_throughput", "documents_processed_per_minute", "<", 10.0, "medium", 300,
     "Document processing throughput is {value:.1f} docs/min, below threshold"),
]


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEFAULT_RULES, RULE_SCHEMA)


def label_text(labels: Column) -> Column:
    """``k=v,...`` sorted by key; empty without labels."""
    pairs = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.coalesce(F.array_join(pairs, ","), F.lit(""))


def fill_template(template: Column, value: Column, labels: Column) -> Column:
    """``{value}``, ``{value:.Nf}`` and ``{label}`` filled in; a name without a value stays as it is."""
    def fill(text: Column, hole: Column) -> Column:
        name = F.regexp_extract(hole, r"^\{([^:}]*)", 1)
        places = F.regexp_extract(hole, r":\.([0-9]+)f\}$", 1)
        decimals = F.when(places == "", F.lit(0)).otherwise(places.try_cast("int"))
        number = F.when(places == "", value.cast("string")).otherwise(
            F.replace(F.call_function("format_number", value, decimals), F.lit(","), F.lit("")))
        return F.replace(text, hole, F.coalesce(F.when(name == "value", number).otherwise(
            F.try_element_at(labels, name)), hole))
    return F.aggregate(F.regexp_extract_all(template, F.lit(r"(\{[^{}]*\})"), 1), template, fill)


def condition(op: Column, value: Column, threshold: Column) -> Column:
    return (F.when(op == ">", value > threshold).when(op == ">=", value >= threshold)
            .when(op == "<", value < threshold).when(op == "<=", value <= threshold)
            .when(op == "==", value == threshold).when(op == "!=", value != threshold).otherwise(F.lit(False)))


def name_prefixes(name: Column) -> Column:
    """Every non-empty prefix of a metric name (names are short identifiers)."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1))), lambda i: F.substring(name, 1, i))


def match_pairs(points: DataFrame, rules: DataFrame) -> DataFrame:
    """(point, rule...) for every rule whose ``source`` is a prefix of the point's ``name``.

    The prefix test is an equi-join: names are exploded into their prefixes
    and joined to the rule table on ``source``; Spark broadcasts the rules
    when they are small, and without a shuffle most prefixes end there.
    """
    pre = points.select("*", F.explode(name_prefixes(F.col("name"))).alias("source"))
    return pre.join(rules.withColumnRenamed("name", "rule"), "source")


def match_rules(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Points x matching rules: the alert key (labels) and the evaluated condition."""
    return (match_pairs(metrics, rules).withColumn("key", label_text(F.col("labels")))
            .withColumn("cond", condition(F.col("op"), F.col("value"), F.col("threshold"))))


def alert_events(metrics: DataFrame, rules: DataFrame, blocks: int | None = None) -> DataFrame:
    """Fire and resolve events with per-rule cooldowns, over time blocks (:mod:`quill.operators.cooldown`)."""
    m = match_rules(metrics, rules).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    ev = run_rules(m, blocks).events
    info = rules.select(F.col("name").alias("rule"), "severity", "template", "threshold")
    labels = F.when(F.col("key") == "", F.create_map().cast("map<string,string>")).otherwise(
        F.str_to_map("key", F.lit(","), F.lit("=")))
    return ev.join(info, "rule").withColumn(
        "message", F.when(F.col("event") == "fired", fill_template(F.col("template"), F.col("value"), labels)))


def alert_fire(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """K12 without cooldown: fire at a true point whose previous point (same rule and
    label set) was false or absent; resolve at the first false point after it."""
    m = match_rules(metrics, rules).select("rule", "key", "event_id", "ts", "value", "severity", "cond")
    # lag per (rule, label set) with distributed prefix logic: a hot series is not one task
    m = st.previous_value(m, ["rule", "key"], [F.col("ts"), F.col("event_id")], "cond", "prev_cond")
    prev = F.coalesce(F.col("prev_cond"), F.lit(False))
    e = m.withColumn("event", F.when(F.col("cond") & ~prev, "fired").when(~F.col("cond") & prev, "resolved"))
    return e.filter(F.col("event").isNotNull()).select(
        "rule", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "key", "event", "value", "severity")


def alert_intervals(events: DataFrame) -> DataFrame:
    """Each fired alert with the time it was resolved (NULL while active)."""
    w = Window.partitionBy("rule", "key").orderBy("ts", "event_id")
    nxt = events.withColumn("next_event", F.lead("event").over(w)).withColumn("next_ts", F.lead("ts").over(w))
    return nxt.filter(F.col("event") == "fired").select(
        "rule", "key", F.col("ts").alias("fired_at"),
        F.when(F.col("next_event") == "resolved", F.col("next_ts")).alias("resolved_at"), "severity")


def alert_history(events: DataFrame, limit: int = 1000) -> DataFrame:
    """The latest ``limit`` alert events."""
    return events.orderBy(F.desc("ts"), F.desc("event_id"), F.asc("rule")).limit(limit)


def alert_active(events: DataFrame) -> DataFrame:
    """Alerts whose last event is a fire."""
    last = events.groupBy("rule", "key").agg(F.max_by(F.struct("event", "ts", "severity", "value"),
                                                       F.struct("ts", "event_id")).alias("l"))
    return last.filter(F.col("l.event") == "fired").select("rule", "key", F.col("l.ts").alias("since"),
                                                           F.col("l.severity").alias("severity"), F.col("l.value").alias("value"))


def alert_stats(events: DataFrame) -> DataFrame:
    """Totals, active count, and fired alerts per severity (all four, zeros kept)."""
    fired = events.filter(F.col("event") == "fired")
    active = alert_active(events).select(F.count("*")).scalar()
    cnt = fired.groupBy("severity").agg(F.count("*").alias("n"))
    sev = fired.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in SEVERITIES])).alias("severity"))
    by = sev.join(cnt, "severity", "left").fillna(0, ["n"])
    row = by.agg(*[F.sum(F.when(F.col("severity") == s, F.col("n"))).cast("bigint").alias(f"n_{s}") for s in SEVERITIES])
    return row.select(fired.select(F.count("*").cast("bigint")).scalar().alias("total_alerts"),
                      active.cast("bigint").alias("active_alerts"), *[f"n_{s}" for s in SEVERITIES])


# --- health (K19, K20) ---------------------------------------------------------------
def health_status(checks: DataFrame, all_checks: DataFrame | None = None) -> DataFrame:
    """Last status per check and the rollup (healthy / degraded / unhealthy).

    Checks that never ran are ``unknown`` and do not fail the rollup.
    """
    last = checks.groupBy("name").agg(F.max_by(F.struct("ok", "critical"), F.struct("ts", "event_id")).alias("l"),
                                      F.max("ts").alias("last_check"))
    if all_checks is not None:
        last = all_checks.select("name").join(last, "name", "left")
    status = F.when(F.col("l").isNull(), "unknown").when(F.col("l.ok"), "healthy").otherwise("unhealthy")
    per = last.select("name", status.alias("status"), F.col("l.critical").alias("critical"),
                      F.col("last_check").cast("timestamp_ntz").alias("last_check"))
    crit_bad = F.count_if((F.col("status") == "unhealthy") & F.col("critical"))
    non_bad = F.count_if((F.col("status") == "unhealthy") & ~F.col("critical"))
    overall = per.agg(F.when(crit_bad > 0, "unhealthy").when(non_bad > 0, "degraded").otherwise("healthy").alias("o"))
    return per.withColumn("overall", overall.select("o").scalar())


def health_failures(checks: DataFrame) -> DataFrame:
    """Current and longest run of consecutive failures per check.

    Positions within a check come from distributed prefix sums, so one
    check with most of the probes is not a single task.
    """
    c = checks.withColumn("one", F.lit(1)).withColumn("succ", F.col("ok").cast("int"))
    cum = st.running_sums(c, ["name"], [F.col("ts"), F.col("event_id")], ["one", "succ"])
    # island = number of successes so far; failures in an island follow its success
    runs = (cum.filter(~F.col("ok")).groupBy("name", F.col("cum_succ").alias("island"))
            .agg(F.count("*").alias("fails")))
    last_island = cum.groupBy("name").agg(F.max("cum_succ").alias("island"))
    current = last_island.join(runs, ["name", "island"], "left").select(
        "name", F.coalesce("fails", F.lit(0)).cast("bigint").alias("consecutive_failures"))
    longest = runs.groupBy("name").agg(F.max("fails").cast("bigint").alias("longest_failure_run"))
    return current.join(longest, "name", "left").fillna(0, ["longest_failure_run"])
