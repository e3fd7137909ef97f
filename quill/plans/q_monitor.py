"""Queries over the ``events`` table as metrics, alerts and health probes (K*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quill.operators import alerts as al
from quill.operators import metrics as mt
from quill.plans import fixtures as fx
from quill.plans.catalog import query
from quill.plans.q_results import round_doubles
from quill.plans.sqlbits import lit

# Parameters: alert rules on the event types (name, source, op, threshold, severity, cooldown_s, template).
RULES = [
    ("slow_click", "click", ">", 200.0, "high", 3600, "Click value {value:.1f} above 200 for k {k}"),
    ("purchase_spike", "purchase", ">", 250.0, "critical", 1800, "Purchase value {value} above 250 ({missing})"),
    ("tiny_view", "view", "<", 0.5, "low", 600, "View value {value} below 0.5"),
    ("error_burst", "error", ">", 300.0, "medium", 0, "Error value {value} above 300"),
    ("big_signup", "sign", ">", 300.0, "medium", 7200, "Signup value {value} above 300"),
]


def rules_df(spark):
    return spark.createDataFrame(RULES, al.RULE_SCHEMA)


def M(spark, d):
    return fx.metric_points(spark, d)


RULES_SQL = ("rules(name, source, op, threshold, severity, cooldown_s, template) AS (VALUES "
             + ", ".join(f"({lit(a)}, {lit(b)}, {lit(c)}, {t}, {lit(s)}, {cd}, {lit(tp)})" for a, b, c, t, s, cd, tp in RULES)
             + ")")
MET = """m AS (SELECT event_id, ts, event_type AS name, json_extract_string(props, '$.k') AS k, value,
                      event_type || '{k=' || json_extract_string(props, '$.k') || '}' AS key,
                      'k=' || json_extract_string(props, '$.k') AS lkey FROM events)"""
COND = ("CASE r.op WHEN '>' THEN m.value > r.threshold WHEN '>=' THEN m.value >= r.threshold "
        "WHEN '<' THEN m.value < r.threshold WHEN '<=' THEN m.value <= r.threshold "
        "WHEN '==' THEN m.value = r.threshold WHEN '!=' THEN m.value <> r.threshold ELSE false END")
POINTS = f"""{RULES_SQL}, {MET},
p AS (SELECT r.name AS rule, m.event_id, m.ts, m.lkey AS key, m.value, {COND} AS cond, r.cooldown_s, r.severity,
             row_number() OVER (PARTITION BY r.name ORDER BY m.ts, m.event_id) AS rn
      FROM m JOIN rules r ON starts_with(m.name, r.source))"""
COOLDOWN_EVENTS = f"""WITH RECURSIVE {POINTS},
s(rule, rn, last_fired, active, ev, key, event_id, ts, value) AS (
  SELECT DISTINCT rule, CAST(0 AS BIGINT), CAST(NULL AS TIMESTAMP), CAST([] AS VARCHAR[]), CAST(NULL AS VARCHAR),
         CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS TIMESTAMP), CAST(NULL AS DOUBLE) FROM p
  UNION ALL
  SELECT p.rule, p.rn,
    CASE WHEN s.last_fired IS NOT NULL AND p.ts - s.last_fired < to_seconds(p.cooldown_s) THEN s.last_fired
         WHEN p.cond AND NOT list_contains(s.active, p.key) THEN p.ts ELSE s.last_fired END,
    CASE WHEN s.last_fired IS NOT NULL AND p.ts - s.last_fired < to_seconds(p.cooldown_s) THEN s.active
         WHEN p.cond AND NOT list_contains(s.active, p.key) THEN list_append(s.active, p.key)
         WHEN NOT p.cond AND list_contains(s.active, p.key) THEN list_filter(s.active, lambda x: x <> p.key)
         ELSE s.active END,
    CASE WHEN s.last_fired IS NOT NULL AND p.ts - s.last_fired < to_seconds(p.cooldown_s) THEN NULL
         WHEN p.cond AND NOT list_contains(s.active, p.key) THEN 'fired'
         WHEN NOT p.cond AND list_contains(s.active, p.key) THEN 'resolved' END,
    p.key, p.event_id, p.ts, p.value
  FROM s JOIN p ON p.rule = s.rule AND p.rn = s.rn + 1),
ev AS (SELECT s.rule, s.event_id, s.ts, s.key, s.ev AS event, s.value, r.severity
       FROM s JOIN rules r ON r.name = s.rule WHERE s.ev IS NOT NULL)
"""


def events_cool(spark, d):
    return al.alert_events(M(spark, d), rules_df(spark))


@query("metric_counters", f"""
WITH {MET} SELECT key, CAST(count(*) AS BIGINT) AS count, round(sum(value), 6) AS total FROM m GROUP BY key
""")
def q_metric_counters(spark, d):
    return round_doubles(mt.counters(M(spark, d)))


@query("metric_gauges", f"""
WITH {MET} SELECT key, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts FROM m GROUP BY key
""")
def q_metric_gauges(spark, d):
    return mt.gauges(M(spark, d))


def _hist_sql(window: int) -> str:
    pick = lambda p: (f"max(CASE WHEN vr = least(floor(n * CAST({p} AS DOUBLE)), n - 1) + 1 THEN value END) "  # noqa: E731
                      f"AS p{int(round(p * 100))}")
    return f"""
WITH {MET}, l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) AS rn FROM m),
r AS (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY value, event_id) AS vr,
             count(*) OVER (PARTITION BY key) AS n FROM l WHERE rn <= {window})
SELECT key, CAST(count(*) AS BIGINT) AS count, round(sum(value), 6) AS sum, min(value) AS min, max(value) AS max,
       round(avg(value), 6) AS avg, {pick(0.5)}, {pick(0.9)}, {pick(0.95)}, {pick(0.99)}
FROM r GROUP BY key
"""


@query("metric_histograms", _hist_sql(1000))
def q_metric_histograms(spark, d):
    return round_doubles(mt.histograms(M(spark, d), 1000))


@query("percentile_floor", f"""
WITH {MET}, r AS (SELECT name, value, row_number() OVER (PARTITION BY name ORDER BY value) AS vr,
                         count(*) OVER (PARTITION BY name) AS n FROM m)
SELECT name, CAST(max(n) AS BIGINT) AS n,
       max(CASE WHEN vr = least(floor(n * CAST(0.5 AS DOUBLE)), n - 1) + 1 THEN value END) AS p50,
       max(CASE WHEN vr = least(floor(n * CAST(0.9 AS DOUBLE)), n - 1) + 1 THEN value END) AS p90,
       max(CASE WHEN vr = least(floor(n * CAST(0.95 AS DOUBLE)), n - 1) + 1 THEN value END) AS p95,
       max(CASE WHEN vr = least(floor(n * CAST(0.99 AS DOUBLE)), n - 1) + 1 THEN value END) AS p99
FROM r GROUP BY name
""")
def q_percentile_floor(spark, d):
    return mt.percentile_floor(M(spark, d))


@query("metric_history", f"""
WITH {MET}, l AS (SELECT key, ts, value, row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) AS rn FROM m)
SELECT key, ts, value, CAST(rn AS BIGINT) AS rn FROM l WHERE rn <= 100
""")
def q_metric_history(spark, d):
    return mt.history(M(spark, d), 100)


@query("metric_key", f"WITH {MET} SELECT event_id, key, 'k' AS label_name, k AS label_value FROM m")
def q_metric_key(spark, d):
    """K6: build the key from the labels map and parse the labels back from the key."""
    m = M(spark, d)
    key = mt.metric_key(F.col("name"), F.col("labels"))
    return m.select("event_id", key.alias("key")).select(
        "event_id", "key", F.explode(mt.parse_metric_key(F.col("key"))).alias("label_name", "label_value"))


@query("metric_buckets", f"""
WITH {MET}, b AS (SELECT key, CASE WHEN value <= 0.1 THEN 0 WHEN value <= 0.5 THEN 1 WHEN value <= 1.0 THEN 2
                                    WHEN value <= 2.0 THEN 3 WHEN value <= 5.0 THEN 4 WHEN value <= 10.0 THEN 5
                                    WHEN value <= 30.0 THEN 6 ELSE 7 END AS b FROM m),
c AS (SELECT key, b, count(*) AS c FROM b GROUP BY 1, 2),
g AS (SELECT key, b FROM (SELECT DISTINCT key FROM m), range(0, 8) t(b))
SELECT g.key, (['0.1', '0.5', '1.0', '2.0', '5.0', '10.0', '30.0', '+Inf'])[g.b + 1] AS le,
       CAST(sum(coalesce(c.c, 0)) OVER (PARTITION BY g.key ORDER BY g.b) AS BIGINT) AS count
FROM g LEFT JOIN c USING (key, b)
""")
def q_metric_buckets(spark, d):
    return mt.buckets(M(spark, d))


@query("docs_per_minute", """
WITH m AS (SELECT date_trunc('minute', ts) AS minute, count(*) AS c FROM events GROUP BY 1),
c AS (SELECT minute, sum(c) OVER (ORDER BY minute) AS counter FROM m)
SELECT minute, CAST(counter AS BIGINT) AS counter,
       CAST(greatest(counter - coalesce(lag(counter) OVER (ORDER BY minute), 0), 0) AS BIGINT) AS per_minute FROM c
""")
def q_docs_per_minute(spark, d):
    return mt.per_minute(M(spark, d))


@query("throughput_trailing", """
WITH s AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) AS sec, count(*) AS c FROM events GROUP BY 1)
SELECT sec, round(sum(c) OVER (ORDER BY sec RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) / 60.0, 6) AS rate_60s,
       round(sum(c) OVER (ORDER BY sec RANGE BETWEEN 300 PRECEDING AND CURRENT ROW) / 300.0, 6) AS rate_300s,
       round(sum(c) OVER (ORDER BY sec RANGE BETWEEN 900 PRECEDING AND CURRENT ROW) / 900.0, 6) AS rate_900s FROM s
""")
def q_throughput_trailing(spark, d):
    return round_doubles(mt.throughput(M(spark, d)))


def _excl(i: int, k: int = 100) -> str:
    j = f"least(greatest(floor((n + 1) * {i} / {k}), 1), n - 1)"
    return (f"(max(CASE WHEN rk = {j} THEN value END) * ({k} - ((n + 1) * {i} - {j} * {k})) "
            f"+ max(CASE WHEN rk = {j} + 1 THEN value END) * ((n + 1) * {i} - {j} * {k})) / {k}")


QEXCL_SQL = """
r AS (SELECT name, value, row_number() OVER (PARTITION BY name ORDER BY value) AS rk, count(*) OVER (PARTITION BY name) AS n FROM src),
q AS (SELECT name, max(n) AS n, """ + f"{_excl(90)} AS q90, {_excl(95)} AS q95, {_excl(99)} AS q99" + """,
             median(value) AS p50, avg(value) AS mean, max(value) AS mx, min(value) AS mn FROM r GROUP BY name, n)
"""


@query("quantiles_exclusive", f"WITH {MET}, src AS (SELECT name, value FROM m), " + QEXCL_SQL + """
SELECT name, round(p50, 6) AS p50, round(CASE WHEN n >= 10 THEN q90 ELSE mx END, 6) AS p90,
       round(CASE WHEN n >= 20 THEN q95 ELSE mx END, 6) AS p95, round(CASE WHEN n >= 100 THEN q99 ELSE mx END, 6) AS p99,
       round(mean, 6) AS mean, mx AS max, mn AS min FROM q
""")
def q_quantiles_exclusive(spark, d):
    return round_doubles(mt.quantiles_exclusive(M(spark, d)))


def requests(spark, d):
    m = M(spark, d)
    return m.select("ts", (F.col("name") != "error").alias("success"), F.col("value").alias("latency"),
                    F.lit(None).cast("string").alias("error"), F.col("labels")["k"].alias("status"))


@query("run_summary", "WITH src AS (SELECT 'all' AS name, value FROM events WHERE event_type <> 'error'), " + QEXCL_SQL + """
SELECT CAST((SELECT count(*) FROM events) AS BIGINT) AS total_requests,
       CAST((SELECT count(*) FROM events WHERE event_type <> 'error') AS BIGINT) AS successful_requests,
       CAST((SELECT count(*) FROM events WHERE event_type = 'error') AS BIGINT) AS failed_requests,
       round((SELECT count(*) FILTER (WHERE event_type <> 'error') / count(*) FROM events), 6) AS success_rate,
       round((SELECT (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 FROM events), 6) AS total_duration_seconds,
       round((SELECT count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) FROM events), 6) AS requests_per_second,
       round((SELECT count(*) FILTER (WHERE event_type <> 'error') / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) FROM events), 6)
         AS successful_requests_per_second,
       round(mean, 6) AS latency_mean, round(p50, 6) AS latency_p50, round(CASE WHEN n >= 10 THEN q90 ELSE mx END, 6) AS latency_p90,
       round(CASE WHEN n >= 20 THEN q95 ELSE mx END, 6) AS latency_p95, round(CASE WHEN n >= 100 THEN q99 ELSE mx END, 6) AS latency_p99,
       mn AS latency_min, mx AS latency_max
FROM q
""")
def q_run_summary(spark, d):
    return round_doubles(mt.run_summary(requests(spark, d)))


@query("error_distribution", """
SELECT 'HTTP ' || json_extract_string(props, '$.k') AS error_type, CAST(count(*) AS BIGINT) AS count
FROM events WHERE event_type = 'error' GROUP BY 1
""")
def q_error_distribution(spark, d):
    return mt.error_distribution(requests(spark, d))


# --- alerts ------------------------------------------------------------------------------
@query("alert_fire", f"""
WITH {POINTS}, e AS (SELECT *, coalesce(lag(cond) OVER (PARTITION BY rule, key ORDER BY ts, event_id), false) AS prev FROM p)
SELECT rule, event_id, ts, key, CASE WHEN cond AND NOT prev THEN 'fired' ELSE 'resolved' END AS event, value, severity
FROM e WHERE (cond AND NOT prev) OR (NOT cond AND prev)
""")
def q_alert_fire(spark, d):
    return al.alert_fire(M(spark, d), rules_df(spark))


@query("alert_cooldown", COOLDOWN_EVENTS + """
SELECT e.rule, e.event_id, e.ts, e.key, e.event, e.value, e.severity,
       CASE WHEN e.event = 'fired' THEN replace(replace(replace(r.template, '{value:.1f}', printf('%.1f', e.value)),
            '{value}', CAST(e.value AS VARCHAR)), '{k}', e.key[3:]) END AS message
FROM ev e JOIN rules r ON r.name = e.rule
""")
def q_alert_cooldown(spark, d):
    e = events_cool(spark, d)
    return e.select("rule", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "key", "event", "value",
                    "severity", "message")


@query("alert_intervals", COOLDOWN_EVENTS + """,
n AS (SELECT *, lead(event) OVER (PARTITION BY rule, key ORDER BY ts, event_id) AS ne,
             lead(ts) OVER (PARTITION BY rule, key ORDER BY ts, event_id) AS nt FROM ev)
SELECT rule, key, ts AS fired_at, CASE WHEN ne = 'resolved' THEN nt END AS resolved_at, severity FROM n WHERE event = 'fired'
""")
def q_alert_intervals(spark, d):
    i = al.alert_intervals(events_cool(spark, d))
    return i.select("rule", "key", F.col("fired_at").cast("timestamp_ntz").alias("fired_at"),
                    F.col("resolved_at").cast("timestamp_ntz").alias("resolved_at"), "severity")


@query("alert_history", COOLDOWN_EVENTS + """
SELECT rule, event_id, ts, key, event, value, severity FROM ev ORDER BY ts DESC, event_id DESC, rule LIMIT 1000
""")
def q_alert_history(spark, d):
    h = al.alert_history(events_cool(spark, d))
    return h.select("rule", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "key", "event", "value", "severity")


_ACTIVE = """, la AS (SELECT rule, key, arg_max(event, (ts, event_id)) AS le, max(ts) AS since,
                    arg_max(severity, (ts, event_id)) AS severity, arg_max(value, (ts, event_id)) AS value FROM ev GROUP BY 1, 2)
"""


@query("alert_active", COOLDOWN_EVENTS + _ACTIVE + "SELECT rule, key, since, severity, value FROM la WHERE le = 'fired'")
def q_alert_active(spark, d):
    a = al.alert_active(events_cool(spark, d))
    return a.withColumn("since", F.col("since").cast("timestamp_ntz"))


@query("alert_stats", COOLDOWN_EVENTS + _ACTIVE + """
SELECT CAST((SELECT count(*) FROM ev WHERE event = 'fired') AS BIGINT) AS total_alerts,
       CAST((SELECT count(*) FROM la WHERE le = 'fired') AS BIGINT) AS active_alerts,
       CAST(count(*) FILTER (WHERE severity = 'low') AS BIGINT) AS n_low,
       CAST(count(*) FILTER (WHERE severity = 'medium') AS BIGINT) AS n_medium,
       CAST(count(*) FILTER (WHERE severity = 'high') AS BIGINT) AS n_high,
       CAST(count(*) FILTER (WHERE severity = 'critical') AS BIGINT) AS n_critical
FROM ev WHERE event = 'fired'
""")
def q_alert_stats(spark, d):
    return al.alert_stats(events_cool(spark, d))


# --- health ------------------------------------------------------------------------------
HEALTH = """h AS (SELECT event_id, ts, event_type AS name, event_type IN ('error', 'purchase') AS critical, value < 100 AS ok FROM events)"""


@query("health_status", f"""
WITH {HEALTH}, l AS (SELECT name, arg_max(ok, (ts, event_id)) AS ok, arg_max(critical, (ts, event_id)) AS critical,
                            max(ts) AS last_check FROM h GROUP BY name),
o AS (SELECT CASE WHEN count(*) FILTER (WHERE NOT ok AND critical) > 0 THEN 'unhealthy'
                  WHEN count(*) FILTER (WHERE NOT ok AND NOT critical) > 0 THEN 'degraded' ELSE 'healthy' END AS overall FROM l)
SELECT name, CASE WHEN ok THEN 'healthy' ELSE 'unhealthy' END AS status, critical, last_check, (SELECT overall FROM o) AS overall FROM l
""")
def q_health_status(spark, d):
    return al.health_status(fx.health_checks(spark, d))


@query("health_failures", f"""
WITH {HEALTH}, c AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY name ORDER BY ts, event_id) AS isl FROM h),
runs AS (SELECT name, isl, count(*) AS fails FROM c WHERE NOT ok GROUP BY 1, 2),
li AS (SELECT name, max(isl) AS isl FROM c GROUP BY 1)
SELECT li.name, CAST(coalesce(r.fails, 0) AS BIGINT) AS consecutive_failures,
       CAST(coalesce((SELECT max(fails) FROM runs x WHERE x.name = li.name), 0) AS BIGINT) AS longest_failure_run
FROM li LEFT JOIN runs r ON r.name = li.name AND r.isl = li.isl
""")
def q_health_failures(spark, d):
    return al.health_failures(fx.health_checks(spark, d))


@query("system_stats", COOLDOWN_EVENTS + _ACTIVE + f""", {HEALTH},
l AS (SELECT name, arg_max(ok, (ts, event_id)) AS ok, arg_max(critical, (ts, event_id)) AS critical FROM h GROUP BY name)
SELECT (SELECT arg_max(value, (ts, event_id)) FROM m WHERE name = 'click') AS gauge_click,
       (SELECT arg_max(value, (ts, event_id)) FROM m WHERE name = 'view') AS gauge_view, CAST(0 AS DOUBLE) AS gauge_absent,
       round((SELECT sum(value) FROM m WHERE name = 'purchase'), 6) AS counter_purchase,
       round((SELECT sum(value) FROM m WHERE name = 'error'), 6) AS counter_error,
       (SELECT CASE WHEN count(*) FILTER (WHERE NOT ok AND critical) > 0 THEN 'unhealthy'
                    WHEN count(*) FILTER (WHERE NOT ok AND NOT critical) > 0 THEN 'degraded' ELSE 'healthy' END FROM l) AS overall_status,
       CAST((SELECT count(*) FROM l WHERE ok) AS BIGINT) AS healthy_checks, CAST((SELECT count(*) FROM l) AS BIGINT) AS total_checks,
       CAST((SELECT count(*) FROM ev WHERE event = 'fired') AS BIGINT) AS total_alerts,
       CAST((SELECT count(*) FROM la WHERE le = 'fired') AS BIGINT) AS active_alerts,
       CAST(count(*) FILTER (WHERE severity = 'low') AS BIGINT) AS n_low,
       CAST(count(*) FILTER (WHERE severity = 'medium') AS BIGINT) AS n_medium,
       CAST(count(*) FILTER (WHERE severity = 'high') AS BIGINT) AS n_high,
       CAST(count(*) FILTER (WHERE severity = 'critical') AS BIGINT) AS n_critical,
       CAST((SELECT count(*) FROM rules) AS BIGINT) AS alert_rules
FROM ev WHERE event = 'fired'
""")
def q_system_stats(spark, d):
    """Gauges and counters without labels, the health rollup and the alert statistics in one row."""
    plain = M(spark, d).withColumn("labels", F.create_map().cast("map<string,string>"))
    return round_doubles(mt.system_status(
        plain, fx.health_checks(spark, d), events_cool(spark, d), rules_df(spark),
        gauge_names=("click", "view", "absent"), counter_names=("purchase", "error")))


@query("metric_labels", f"""
WITH {MET} SELECT DISTINCT key, 'k' AS label_name, k AS label_value FROM m
""")
def q_metric_labels(spark, d):
    """K6: label maps parsed back out of the distinct metric keys."""
    keys = mt.counters(M(spark, d)).select("key")
    return keys.select("key", F.explode(mt.parse_metric_key(F.col("key"))).alias("label_name", "label_value"))
