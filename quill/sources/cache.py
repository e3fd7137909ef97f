"""The prediction cache as a bucketed table.

Rows are found by ``cache_key``, the text's hash and the model type.  The table
is partitioned by the hash's first digits and bucketed by the key:

* an upsert merges the new rows with the partitions they fall in and replaces
  those partitions only;
* a lookup joins on the key, for which the cache lies ready in its buckets: only
  the requests are shuffled;
* Parquet keeps a Bloom filter on the key, so a search for a few keys skips the
  row groups that cannot hold them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quill.session import setting, staged

COLUMNS = ["text_hash", "model_type", "prediction_data", "confidence", "created_at"]
BUCKETS = 64


def cache_key(text_hash: Column, model_type: Column) -> Column:
    return F.concat_ws(":", text_hash, model_type)


class PredictionCache:
    """One cache table; ``buckets`` should give files of some hundred megabytes at the size it will reach."""

    def __init__(self, spark: SparkSession, path: str, prediction_type: str = "string", buckets: int = BUCKETS,
                 digits: int = 1, name: str | None = None) -> None:
        self.spark, self.path, self.name = spark, path, name or f"prediction_cache_{uuid.uuid4().hex}"
        self.buckets, self.digits = buckets, digits  # 16 ** digits partitions
        spark.sql(f"""
            CREATE TABLE IF NOT EXISTS {self.name} (cache_key STRING, text_hash STRING, model_type STRING,
                prediction_data {prediction_type}, confidence DOUBLE, created_at TIMESTAMP_NTZ, part STRING)
            USING parquet OPTIONS ('parquet.bloom.filter.enabled#cache_key' 'true') PARTITIONED BY (part)
            CLUSTERED BY (cache_key) SORTED BY (cache_key) INTO {buckets} BUCKETS LOCATION '{path}'""")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def rows(self) -> DataFrame:
        return self.table().select(*COLUMNS)

    def upsert(self, new: DataFrame) -> list[str]:
        """The latest row of each key wins; returns the partitions that were replaced.

        The merged rows are written aside first, so a failure leaves the table as it was.
        """
        n = staged(new.select(cache_key(F.col("text_hash"), F.col("model_type")).alias("cache_key"),
                              *[F.col(c).cast("timestamp_ntz") if c == "created_at" else F.col(c) for c in COLUMNS],
                              F.substring("text_hash", 1, self.digits).alias("part")), "cache-new")
        touched = sorted(r["part"] for r in n.select("part").distinct().collect())
        if not touched:
            return []
        old = self.table().filter(F.col("part").isin(*touched))
        latest = F.max_by(F.struct(*COLUMNS, "part"), F.struct("created_at", "prediction_data", "confidence"))
        merged = old.unionByName(n).groupBy("cache_key").agg(latest.alias("r")).select("cache_key", "r.*")
        merged = staged(merged, "cache-merged")
        # dealt out as the table is, so that a task writes one bucket's files
        with setting(self.spark, "spark.sql.sources.partitionOverwriteMode", "dynamic"):
            merged.repartition(self.buckets, "cache_key").write.insertInto(self.name, overwrite=True)
        self.spark.catalog.refreshTable(self.name)
        return touched

    def lookup(self, requests: DataFrame, as_of, max_age_hours: int = 24) -> DataFrame:
        """Each request (text_hash, model_type, ...) with its cached prediction newer than ``as_of - max_age``."""
        fresh = self.table().filter(F.col("created_at") > as_of - F.make_dt_interval(F.lit(0), F.lit(max_age_hours)))
        fresh = fresh.select("cache_key", "prediction_data", "confidence", "created_at")
        asked = requests.withColumn("cache_key", cache_key(F.col("text_hash"), F.col("model_type")))
        return asked.join(fresh, "cache_key", "left").drop("cache_key")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
