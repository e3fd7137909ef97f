"""Shared helpers: scratch tables, ranks."""

from pyspark.sql import functions as F

from quill.llm import common


def test_scratch_tables_can_be_cleared(spark):
    df = common.materialise(spark.range(10), "numbers")
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(common.scratch_root(spark))
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert df.count() == 10 and fs.exists(root)
    common.clear_scratch(spark)
    assert not fs.exists(root)


def test_running_total_in_cells_equals_a_plain_sum(spark):
    df = spark.range(3000).select(F.pmod("id", F.lit(3)).alias("g"), "id", (F.col("id") % 7).alias("v"))
    df = df.withColumn("key", common.shuffle_key("s", F.col("id"))).withColumn("cell", common.key_cell(F.col("key")))
    got = {r.id: r.total for r in common.running_total(df, ["g"], "cell", ["key", "id"], "v", "total").collect()}
    rows = sorted((r.g, r.key, r.id, r.v) for r in df.collect())
    total: dict = {}
    for g, _, i, v in rows:
        total[g] = total.get(g, 0) + v
        assert got[i] == total[g]


def test_word_counts_agree(spark):
    texts = ["", None, " a ", "a\tb\n c", "\x0b\x0c\r", "x" * 1000, "é \xa0 b", "a  b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", common.n_words(F.col("t")).alias("n"), F.size(common.words(F.col("t"))).alias("m")).collect():
        import re
        want = len(re.findall(r"[^\x20\x09-\x0D]+", r.t or ""))
        assert (r.n, r.m) == (want, want)
