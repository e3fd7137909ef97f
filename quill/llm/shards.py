"""Sharding by proportional stratified interleaving, built-in functions only.

Rows of each source are put in a seeded shuffle order; the row of rank r among
n has the fractional rank (r - 1/2) / n.  All rows sorted by fractional rank
form one sequence in which every stretch holds the sources in proportion, and
the sequence is cut into shards whose row counts differ by one at most (law
``rows``), so each shard has the mixture of the whole.

Ranks never gather a source in one task: a source is cut into 4096 hash cells
and the merged sequence into 4096 equal intervals (``common.running_total``).
The text is read once, for its size and checksum; only narrow rows shuffle.

Defined cases: null text has size 16 and the checksum of no bytes; null source
is a stratum of its own; rows equal in id, text and source are interchangeable;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quill.llm.common import CELLS, key_cell, running_total, shuffle_key, string_key

SEED = "interleave-1"
ROW_BYTES = 16


def interleave(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text",
               source_col: str = "source", seed: str = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the source of every row."""
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    d = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(raw) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(raw).alias("text_crc32"), string_key(F.col(source_col)).alias("_q_src"))
    d = d.withColumn("_q_key", shuffle_key(seed, F.col("doc_id"))).withColumn("_q_cell", key_cell(F.col("_q_key")))
    ranked = running_total(d, ["_q_src"], "_q_cell", ["_q_key", "doc_id", "text_crc32", "size"], None, "_q_rank")
    n = d.groupBy("_q_src").agg(F.count("*").alias("_q_n"))
    f = ranked.join(n, "_q_src").withColumn("_q_frac", (F.col("_q_rank") - 0.5) / F.col("_q_n"))
    f = f.withColumn("_q_cut", F.floor(F.col("_q_frac") * CELLS).cast("int"))
    f = running_total(f, [], "_q_cut", ["_q_frac", "_q_src", "_q_rank"], None, "_q_pos")
    total = d.agg(F.count("*").alias("_q_total"))
    f = f.withColumn("_q_total", total.scalar()).withColumn("_q_p", F.col("_q_pos") - 1)
    f = f.withColumn("_q_shard", F.expr(f"(_q_p * {n_shards}) div _q_total"))
    first = F.expr(f"(_q_shard * _q_total + {n_shards - 1}) div {n_shards}")
    return f.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
                    F.col("_q_shard").cast("int").alias("shard"), (F.col("_q_p") - first).alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard"),
                    F.when(F.col("_q_src") == "1", F.lit(None)).otherwise(F.substring("_q_src", 2, 1 << 30)).alias("source"))
