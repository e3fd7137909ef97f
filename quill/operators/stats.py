"""Exact order statistics without funnelling a group into one task.

A group (a sentiment label, a metric name, a class) may hold a third of all
rows, so neither ``Window.partitionBy(group).orderBy(v)`` nor exact
``percentile`` (which buffers every value of a group) is safe.  Instead:

1. collapse to distinct ``(group, value, count)`` rows (combined map-side);
2. range-partition by ``(group, value)`` so a big group spans many tasks;
3. the range-partitioned frame is checkpointed (so every consumer sees
   the same partition assignment), then running sums inside each partition
   plus the totals of the earlier partitions of the same group (a small
   table) give the exact cumulative count ``cum`` of every distinct value;
4. a quantile at rank ``k`` is the value with ``cum - count < k <= cum``,
   picked with a conditional aggregate (no range join).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quill.session import cut_lineage, staged

# So many narrow rows are a window in one task.
FEW_ROWS = 200_000


def _parts(df: DataFrame, n: int | None) -> int:
    return n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running_sums(d: DataFrame, group: Sequence[str], order: Sequence[Column], cols: Sequence[str],
                 n_parts: int | None = None) -> DataFrame:
    """Inclusive running sums ``cum_<c>`` of ``cols`` in ``order`` within each group.

    ``d`` must have one row per (group, order key).  Distributed prefix sum:
    range partitions, per-partition totals, offsets from earlier partitions.
    The rows are written once first, so nothing computes them twice; a table of
    at most ``FEW_ROWS`` of them needs no more than a window (unless the number
    of partitions is given).
    """
    group = list(group)
    if n_parts is None:
        d = staged(d, "running-sums")
        if d.count() <= FEW_ROWS:
            w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
            return d.select("*", *[F.sum(c).over(w).alias("cum_" + c) for c in cols])
    r = d.repartitionByRange(_parts(d, n_parts), *[F.col(g) for g in group], *order) \
         .withColumn("_pid", F.spark_partition_id())
    # Both branches below must see the same range assignment; a reliable
    # checkpoint (shared checkpoint folder) fixes it and cuts the lineage.
    r = cut_lineage(r)
    tot = r.groupBy(*group, "_pid").agg(*[F.sum(c).alias("_t_" + c) for c in cols])
    wo = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*group, "_pid", *[F.coalesce(F.sum("_t_" + c).over(wo), F.lit(0)).alias("_o_" + c)
                                      for c in cols])
    wl = Window.partitionBy(*group, "_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = r.join(off, [*group, "_pid"])
    return out.select(*[c for c in r.columns if c != "_pid"],
                      *[(F.sum(c).over(wl) + F.col("_o_" + c)).alias("cum_" + c) for c in cols])


def value_counts(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Distinct (group, value) with multiplicity ``c``; NULL values dropped."""
    return (df.filter(F.col(value).isNotNull()).groupBy(*group, value)
            .agg(F.count("*").cast("bigint").alias("c")))


def cumulative_counts(df: DataFrame, group: Sequence[str], value: str,
                      n_parts: int | None = None) -> DataFrame:
    """(group, value, c, cum_c, n): exact cumulative counts in ascending value order."""
    return cumulate(value_counts(df, group, value), group, value, n_parts)


def cumulate(vc: DataFrame, group: Sequence[str], value: str, n_parts: int | None = None) -> DataFrame:
    """Running and total counts of (group, value, c) rows.

    The running sums stand on a checkpoint, so the totals do not run the source again.
    """
    cum = running_sums(vc, group, [F.col(value)], ["c"], n_parts)
    if not group:  # one global total: a scalar subquery, not a join
        return cum.withColumn("n", cum.select(F.max("cum_c")).scalar())
    return cum.join(cum.groupBy(*group).agg(F.max("cum_c").alias("n")), list(group))


def medians_of_counts(vc: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """(group, n, median) of rows given as (group, value, c)."""
    lo, hi = F.floor((F.col("n") + 1) / 2), F.ceil((F.col("n") + 1) / 2)
    p = pick_ranks(cumulate(vc, group, value), group, value, {"lo": lo, "hi": hi})
    return p.select(*group, "n", ((F.col("lo") + F.col("hi")) / 2).alias("median"))


def pick_ranks(cum: DataFrame, group: Sequence[str], value: str, ranks: dict[str, Column],
               extra: Sequence[Column] = ()) -> DataFrame:
    """For each name -> rank expression (of ``n``), the value at that 1-based rank."""
    lo = F.col("cum_c") - F.col("c")
    aggs = [F.max(F.when((lo < k) & (k <= F.col("cum_c")), F.col(value))).alias(name) for name, k in ranks.items()]
    return cum.groupBy(*group).agg(F.max("n").cast("bigint").alias("n"), *aggs, *extra)


def quantiles_linear(df: DataFrame, group: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles (numpy / ``quantile_cont`` rule), exact."""
    cum = cumulative_counts(df, group, value)
    ranks = {}
    for name, p in probs.items():
        pos = (F.col("n") - 1) * F.lit(p)          # 0-based fractional position
        ranks[name + "__lo"] = F.floor(pos) + 1
        ranks[name + "__hi"] = F.ceil(pos) + 1
    picked = pick_ranks(cum, group, value, ranks)
    cols = []
    for name, p in probs.items():
        pos = (F.col("n") - 1) * F.lit(p)
        frac = pos - F.floor(pos)
        cols.append((F.col(name + "__lo") + (F.col(name + "__hi") - F.col(name + "__lo")) * frac).alias(name))
    return picked.select(*group, "n", *cols)


def box_stats(df: DataFrame, group: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """n, linear quantiles, min, max, mean and sample deviation (sd, 0 for one row) in one aggregation."""
    cum = cumulative_counts(df, group, value)
    ranks = {}
    for name, p in probs.items():
        pos = (F.col("n") - 1) * F.lit(p)
        ranks[name + "__lo"], ranks[name + "__hi"] = F.floor(pos) + 1, F.ceil(pos) + 1
    v, c = F.col(value), F.col("c")
    extra = [F.min(v).alias("min"), F.max(v).alias("max"), (F.sum(v * c) / F.sum(c)).alias("mean"),
             F.sum(v * v * c).alias("_ss"), F.sum(v * c).alias("_s")]
    picked = pick_ranks(cum, group, value, ranks, extra)
    cols = []
    for name, p in probs.items():
        pos = (F.col("n") - 1) * F.lit(p)
        cols.append((F.col(name + "__lo") + (F.col(name + "__hi") - F.col(name + "__lo")) * (pos - F.floor(pos))).alias(name))
    var = (F.col("_ss") - F.col("_s") * F.col("_s") / F.col("n")) / (F.col("n") - 1)
    sd = F.when(F.col("n") > 1, F.sqrt(F.greatest(var, F.lit(0.0)))).otherwise(F.lit(0.0))
    return picked.select(*group, "n", *cols, "min", "max", "mean", sd.alias("sd"))


def quantiles_floor(df: DataFrame, group: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """K4 rule: sorted value at 0-based index ``min(floor(n*p), n-1)``."""
    cum = cumulative_counts(df, group, value)
    ranks = {name: F.least(F.floor(F.col("n") * F.lit(p)), F.col("n") - 1) + 1 for name, p in probs.items()}
    return pick_ranks(cum, group, value, ranks)


def quantiles_exclusive(df: DataFrame, group: Sequence[str], value: str, ks: dict[str, int], k: int = 100) -> DataFrame:
    """Exclusive method: position i(n+1)/k, clamped to ranks [1, n-1], interpolated."""
    cum = cumulative_counts(df, group, value)
    ranks = {}
    for name, i in ks.items():
        m = F.col("n") + 1
        j = F.least(F.greatest(F.floor(m * i / k), F.lit(1)), F.col("n") - 1)
        ranks[name + "__j"] = j
        ranks[name + "__j1"] = j + 1
    picked = pick_ranks(cum, group, value, ranks)
    cols = []
    for name, i in ks.items():
        m = F.col("n") + 1
        j = F.least(F.greatest(F.floor(m * i / k), F.lit(1)), F.col("n") - 1)
        delta = m * i - j * k
        cols.append(((F.col(name + "__j") * (k - delta) + F.col(name + "__j1") * delta) / k).alias(name))
    return picked.select(*group, "n", *cols)


def quantile_summary(df: DataFrame, group: Sequence[str], value: str, linear: dict[str, float],
                     exclusive: dict[str, int], k: int = 100) -> DataFrame:
    """n, mean, min, max, linear quantiles and exclusive quantiles in one aggregation."""
    cum = cumulative_counts(df, group, value)
    m = F.col("n") + 1
    ranks = {}
    for name, p in linear.items():
        pos = (F.col("n") - 1) * F.lit(p)
        ranks[name + "__lo"], ranks[name + "__hi"] = F.floor(pos) + 1, F.ceil(pos) + 1
    jx = {name: F.least(F.greatest(F.floor(m * i / k), F.lit(1)), F.col("n") - 1) for name, i in exclusive.items()}
    for name, j in jx.items():
        ranks[name + "__j"], ranks[name + "__j1"] = j, j + 1
    extra = [(F.sum(F.col(value) * F.col("c")) / F.sum("c")).alias("mean"), F.min(value).alias("min"),
             F.max(value).alias("max")]
    picked = pick_ranks(cum, group, value, ranks, extra)
    cols = []
    for name, p in linear.items():
        pos = (F.col("n") - 1) * F.lit(p)
        frac = pos - F.floor(pos)
        cols.append((F.col(name + "__lo") + (F.col(name + "__hi") - F.col(name + "__lo")) * frac).alias(name))
    for name, i in exclusive.items():
        delta = m * i - jx[name] * k
        cols.append(((F.col(name + "__j") * (k - delta) + F.col(name + "__j1") * delta) / k).alias(name))
    return picked.select(*group, "n", "mean", "min", "max", *cols)


def previous_value(d: DataFrame, group: Sequence[str], order: Sequence[Column], col: str, out: str = "prev",
                   n_parts: int | None = None) -> DataFrame:
    """``lag(col)`` within each group in ``order``, without one task per group.

    Rows are range-partitioned (and checkpointed, as in :func:`running_sums`);
    inside a partition the ordinary ``lag`` applies, and the first row of a
    partition takes the last value of the same group from the previous
    partition (a table of one row per group and partition).
    """
    group = list(group)
    if n_parts is None:
        d = staged(d, "previous-value")
        if d.count() <= FEW_ROWS:
            return d.withColumn(out, F.lag(col).over(Window.partitionBy(*group).orderBy(*order)))
    r = d.repartitionByRange(_parts(d, n_parts), *[F.col(g) for g in group], *order) \
         .withColumn("_pid", F.spark_partition_id())
    r = cut_lineage(r)
    wl = Window.partitionBy(*group, "_pid").orderBy(*order)
    local = r.withColumn("_lag", F.lag(col).over(wl)).withColumn("_rn", F.row_number().over(wl))
    lasts = local.groupBy(*group, "_pid").agg(F.max_by(F.col(col), F.col("_rn")).alias("_last"))
    wp = Window.partitionBy(*group).orderBy("_pid")
    carry = lasts.select(*group, "_pid", F.lag("_last").over(wp).alias("_carry"))
    j = local.join(carry, [*group, "_pid"])
    prev = F.when(F.col("_rn") == 1, F.col("_carry")).otherwise(F.col("_lag"))
    return j.select(*[c for c in d.columns], prev.alias(out))
