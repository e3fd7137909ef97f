"""Helpers shared by the training-data operators: tables, scratch space, ranks, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# White space of the contracts: [\x20\x09-\x0D]
BLANKS = " \t\n\x0b\x0c\r"
ABC, abc = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed number of hash cells a group is cut into for distributed ranks: a cell holds 1/4096 of its group.
CELLS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a private one only on a local master."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    path = path or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="quill-llm-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for one intermediate table under the application's part of the shared folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def scratch_root(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/quill-llm/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete the application's intermediate tables; results read lazily from them are then gone."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives the optimizer the
    true size, so that it broadcasts the table only below the session's limit.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def string_key(c: Column) -> Column:
    """A non-null grouping key that keeps null apart from every string and sorts it last."""
    return F.when(c.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), c.cast("string")))


def blank_to_space(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")


def words(text: Column) -> Column:
    """Array of the maximal runs of characters outside ``[\\x20\\x09-\\x0D]`` (null text: none)."""
    return F.filter(F.split(blank_to_space(text), " "), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words without building them: word starts are non-blanks after a blank."""
    t = F.concat(F.lit(" "), blank_to_space(text))
    return F.regexp_count(t, F.lit(" [^ ]")).cast("bigint")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, ABC, abc)


def shuffle_key(seed: str, *cols: Column) -> Column:
    """Seeded pseudo-random key of a row: 32 hex digits."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols]))


def key_cell(key: Column) -> Column:
    """The first three hex digits of ``shuffle_key`` as one of 4096 cells, in key order."""
    return F.conv(F.substring(key, 1, 3), 16, 10).cast("int")


def running_total(df: DataFrame, group: list[str], cell: str, order: list[str], value: str | None, out: str) -> DataFrame:
    """Inclusive running sum of ``value`` (None: row number) over ``order`` within ``group``.

    ``cell`` cuts a group into at most ``CELLS`` consecutive pieces of ``order``, so no task holds a
    whole group: cell totals (combined map-side) give the start of a cell, a window inside the cell
    gives the rest.  The prefix window over cells sees at most ``CELLS`` rows per group.
    """
    v = F.lit(1).cast("bigint") if value is None else F.col(value)
    keys = [*group, cell]
    tot = df.groupBy(*keys).agg(F.sum(v).alias("_q_tot"))
    before = Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select(*keys, F.coalesce(F.sum("_q_tot").over(before), F.lit(0)).alias("_q_off"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (df.join(tot, keys)
            .select(*df.columns, (F.sum(v).over(inside) + F.col("_q_off")).cast("bigint").alias(out)))


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root): the smallest node reachable, for every node of ``edges`` (long columns ``u``, ``v``).

    Alternating large-star and small-star rounds; each round is a grouped minimum (combined map-side)
    and a join, checkpointed in the shared folder, until the edge set no longer changes.  Nothing but
    the two round statistics reaches the driver.
    """
    def state(e: DataFrame) -> tuple:
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    e = cut(edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).filter("a <> b").distinct())
    seen = state(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = (small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))))
        e = cut(small.filter("a <> b").distinct())
        now = state(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
