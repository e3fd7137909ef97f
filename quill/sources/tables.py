"""The driver tables: one parquet file per table under a scale-factor folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


# Tables whose rows carry long texts: per-row work is CPU-heavy regex work.
TEXT_TABLES = ("documents", "conversations", "pages", "benchmark")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; Catalyst prunes columns and pushes filters into it.

    A text table whose scan has fewer partitions than the cluster has cores
    (here: one file with one row group) would be processed by a few tasks; its
    rows are spread round-robin.  This only deals the same rows out; a scan of
    enough partitions is read as it is.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if name in TEXT_TABLES:
        par = spark.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < par:
            df = df.repartition(par)
    return df


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as stored: ``ts`` is TIMESTAMP_NTZ (wall clock, independent of the
    session time zone).  Streams cast it to TIMESTAMP for watermarks."""
    return table(spark, sf_dir, "events")
