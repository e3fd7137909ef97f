"""Metric tables (K1-K11, K21) over ``metrics(ts, name, kind, labels, value, event_id)``.

Groups are metric keys; a key may hold a huge share of the points, so
order statistics over whole series use :mod:`quill.operators.stats` and
"last N per key" uses ``row_number() <= N`` (window group limit, applied
before and after the shuffle).  Time series (per minute / per second) first
aggregate to one row per time bucket; running counters go by distributed
prefix sums, trailing windows by hour buckets with a halo.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quill.operators import stats as st

# Default histogram bucket edges (seconds).
DEFAULT_BUCKETS = [0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0]


def metric_key(name: Column, labels: Column) -> Column:
    """K6: ``name{k=v,...}`` with labels sorted by key (``name`` alone without labels)."""
    pairs = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.when(F.size(labels) > 0, F.concat(name, F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise(name)


def parse_metric_key(key: Column) -> Column:
    """K6: labels map back from a metric key."""
    inner = F.regexp_extract(key, r"\{(.*)\}$", 1)
    return F.when(inner == "", F.create_map().cast("map<string,string>")).otherwise(F.str_to_map(inner, F.lit(","), F.lit("=")))


def counters(metrics: DataFrame) -> DataFrame:
    """K1: per key, number of increments and their sum."""
    return (metrics.groupBy(metric_key(F.col("name"), F.col("labels")).alias("key"))
            .agg(F.count("*").cast("bigint").alias("count"), F.sum("value").alias("total")))


def gauges(metrics: DataFrame) -> DataFrame:
    """K2: last value per key (ties by event id)."""
    return (metrics.groupBy(metric_key(F.col("name"), F.col("labels")).alias("key"))
            .agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"),
                 F.max("ts").cast("timestamp_ntz").alias("ts")))


def last_n(metrics: DataFrame, key: Column, n: int) -> DataFrame:
    """Last ``n`` points per key by (ts, event_id)."""
    w = Window.partitionBy("key").orderBy(F.desc("ts"), F.desc("event_id"))
    return (metrics.withColumn("key", key).withColumn("rn", F.row_number().over(w))
            .filter(F.col("rn") <= n))


def histograms(metrics: DataFrame, window: int = 1000, probs=(0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """K3: stats over the last ``window`` values of each metric key (name and labels); K4 percentile rule."""
    recent = last_n(metrics, metric_key(F.col("name"), F.col("labels")), window)
    # at most ``window`` values a key: sorted as one array, in the partitioning that the window left
    h = recent.groupBy("key").agg(
        F.count("*").cast("bigint").alias("count"), F.sum("value").alias("sum"), F.min("value").alias("min"),
        F.max("value").alias("max"), F.avg("value").alias("avg"), F.sort_array(F.collect_list("value")).alias("vs"))
    n = F.size("vs")
    pick = lambda p: F.get("vs", F.least(F.floor(n * F.lit(p)).cast("int"), n - 1))
    return h.select("key", "count", "sum", "min", "max", "avg", *[pick(p).alias(f"p{int(round(p * 100))}") for p in probs])


def percentile_floor(metrics: DataFrame, probs=(0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """K4 over whole series: value at index min(floor(n*p), n-1), exact and distributed."""
    return st.quantiles_floor(metrics.select("name", "value"), ["name"], "value",
                              {f"p{int(round(p * 100))}": p for p in probs})


def history(metrics: DataFrame, n: int = 100) -> DataFrame:
    """K5: the last ``n`` points of each key."""
    return (last_n(metrics, metric_key(F.col("name"), F.col("labels")), n)
            .select("key", F.col("ts").cast("timestamp_ntz").alias("ts"), "value", F.col("rn").cast("bigint").alias("rn")))


def buckets(metrics: DataFrame, edges=DEFAULT_BUCKETS) -> DataFrame:
    """K7: cumulative bucket counts ``le`` per metric key (name and labels), plus ``+Inf``.

    Each value gets the index of its first edge >= value; counts per
    (key, index) are then accumulated over at most len(edges)+1 rows.
    """
    edges = sorted(float(e) for e in edges)
    idx = F.lit(len(edges))
    for i in reversed(range(len(edges))):
        idx = F.when(F.col("value") <= edges[i], F.lit(i)).otherwise(idx)
    counts = metrics.groupBy(metric_key(F.col("name"), F.col("labels")).alias("key"), idx.alias("b")).agg(F.count("*").alias("c"))
    keys = counts.select("key").distinct()
    grid = keys.select("key", F.explode(F.sequence(F.lit(0), F.lit(len(edges)))).alias("b"))
    w = Window.partitionBy("key").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    labels = F.array(*[F.lit(str(e)) for e in edges], F.lit("+Inf"))
    return (grid.join(counts, ["key", "b"], "left").fillna(0, ["c"])
            .select("key", F.get(labels, F.col("b")).alias("le"), F.sum("c").over(w).cast("bigint").alias("count")))


def per_minute(metrics: DataFrame) -> DataFrame:
    """K8: documents per minute = counter delta between minute ticks, floor 0.

    The counter only grows, so the delta of a minute is its own count; the
    counter at the end of each minute with points comes from distributed
    running sums over one row a minute.
    """
    m = metrics.groupBy(F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute")).agg(F.count("*").alias("c"))
    cum = st.running_sums(m, [], [F.col("minute")], ["c"])
    return cum.select("minute", F.col("cum_c").cast("bigint").alias("counter"), F.col("c").cast("bigint").alias("per_minute"))


THROUGHPUT_BUCKET_S = 3600


def throughput(metrics: DataFrame, spans=(60, 300, 900)) -> DataFrame:
    """K9: trailing throughput (ops/s) over ``spans`` seconds at every second with points.

    Seconds are dealt to hour buckets; those in the longest span before the
    next bucket are copied there as its halo, so each bucket's window is whole
    and no task holds more than an hour and its halo.
    """
    width, halo = max(THROUGHPUT_BUCKET_S, max(spans)), max(spans)
    sec = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    s = metrics.groupBy(sec.alias("sec")).agg(F.count("*").alias("c"))
    own = F.floor(F.col("sec") / width)
    s = s.withColumn("own", own).withColumn("bucket", F.explode(F.array_distinct(F.array(
        F.col("own"), F.floor((F.col("sec") + halo) / width)))))
    cols = []
    for sp in spans:
        w = Window.partitionBy("bucket").orderBy("sec").rangeBetween(-sp, 0)
        cols.append((F.sum("c").over(w) / float(sp)).alias(f"rate_{sp}s"))
    return s.select(F.col("sec").cast("bigint").alias("sec"), "own", "bucket", *cols).filter("own = bucket").drop("own", "bucket")


def system_status(metrics: DataFrame, checks: DataFrame, alerts: DataFrame, rules: DataFrame,
                  gauge_names=("system_cpu_percent", "system_memory_percent", "system_disk_percent"),
                  counter_names=("documents_processed", "processing_errors")) -> DataFrame:
    """One row of gauges, counters, health and alert statistics (absent metrics count as 0)."""
    from quill.operators.alerts import alert_stats, health_status
    g = gauges(metrics.filter(F.col("name").isin(*gauge_names))).agg(
        *[F.max(F.when(F.col("key") == n, F.col("value"))).alias(n) for n in gauge_names])
    c = metrics.filter(F.col("name").isin(*counter_names))
    c = counters(c).agg(*[F.sum(F.when(F.col("key") == n, F.col("total"))).alias(n) for n in counter_names])
    h = health_status(checks).agg(F.max("overall").alias("overall_status"),
                                  F.count_if(F.col("status") == "healthy").cast("bigint").alias("healthy_checks"),
                                  F.count("*").cast("bigint").alias("total_checks"))
    a = alert_stats(alerts)
    one = lambda df: df.select(F.struct(*df.columns)).scalar()
    row = metrics.sparkSession.range(1).select(one(g).alias("g"), one(c).alias("c"), one(h).alias("h"), one(a).alias("a"),
                                               rules.select(F.count("*").cast("bigint")).scalar().alias("alert_rules"))
    zero = F.lit(0.0)
    return row.select(*[F.coalesce(F.col(f"g.{n}"), zero).alias(f"gauge_{n}") for n in gauge_names],
                      *[F.coalesce(F.col(f"c.{n}"), zero).alias(f"counter_{n}") for n in counter_names],
                      F.coalesce("h.overall_status", F.lit("unknown")).alias("overall_status"), "h.healthy_checks",
                      "h.total_checks", "a.*", "alert_rules")


def quantiles_exclusive(metrics: DataFrame, group=("name",)) -> DataFrame:
    """Median, exclusive p90/p95/p99 (max when the series is too short), mean, min, max."""
    q = st.quantile_summary(metrics, list(group), "value", {"p50": 0.5}, {"q90": 90, "q95": 95, "q99": 99})
    return q.select(*group, "p50",
                    F.when(F.col("n") >= 10, F.col("q90")).otherwise(F.col("max")).alias("p90"),
                    F.when(F.col("n") >= 20, F.col("q95")).otherwise(F.col("max")).alias("p95"),
                    F.when(F.col("n") >= 100, F.col("q99")).otherwise(F.col("max")).alias("p99"),
                    "mean", "max", "min")


def run_summary(requests: DataFrame, ts: str = "ts") -> DataFrame:
    """Request-run summary (success flag, latency of successes, duration from timestamps)."""
    dur = F.timestamp_diff("MICROSECOND", F.min(F.col(ts)), F.max(F.col(ts)))
    base = requests.agg(
        F.count("*").cast("bigint").alias("total_requests"),
        F.count_if("success").cast("bigint").alias("successful_requests"),
        F.count_if(~F.col("success")).cast("bigint").alias("failed_requests"),
        F.coalesce(F.try_divide(F.count_if("success"), F.count("*")), F.lit(0.0)).alias("success_rate"),
        (dur / 1e6).alias("total_duration_seconds"))
    lat = requests.filter("success").select(F.col("latency").alias("value"))
    q = quantiles_exclusive(lat, group=())
    out = base.withColumn("requests_per_second", F.try_divide(F.col("total_requests"), F.col("total_duration_seconds"))) \
              .withColumn("successful_requests_per_second",
                          F.try_divide(F.col("successful_requests"), F.col("total_duration_seconds")))
    names = ["mean", "p50", "p90", "p95", "p99", "min", "max"]
    out = out.withColumn("_q", q.select(F.struct(*names)).scalar())  # one subquery for all latency figures
    return out.select("*", *[F.col(f"_q.{c}").alias(f"latency_{c}") for c in names]).drop("_q")


def error_distribution(requests: DataFrame) -> DataFrame:
    """Failures by error text, or ``HTTP <status>`` when there is none."""
    return (requests.filter(~F.col("success"))
            .groupBy(F.coalesce(F.col("error"), F.concat(F.lit("HTTP "), F.col("status").cast("string"))).alias("error_type"))
            .agg(F.count("*").cast("bigint").alias("count")))
