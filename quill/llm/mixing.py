"""Mixing sources to target weights by weighted fair queueing.

Each source is a flow of its shuffled documents, repeated up to ``MAX_EPOCHS``
times; a copy finishes at (words of the source up to and with it) / target.
All copies, sorted by finish time, are taken until the budget (all words) is
used up (copies that finish at the same time together), so at any cut the flows
have advanced in proportion to their targets.

Targets: the budget is shared by weight, a source gets at most three times its
words, and the excess goes to the others by weight until none is above.  With
the sources sorted by cap / weight the capped ones form a prefix, so one pass
of running sums over the per-source totals finds the level.

No source is gathered in a task: running sums go by hash cells
(``common.running_total``), the global order by 4096 intervals of finish time.
Only narrow rows (id, source, words) shuffle.

Defined cases: null text has no words; a document without words has taken 0;
null source is a source of its own, last in order; repeated rows are separate
documents; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quill.llm.common import CELLS, key_cell, materialise, n_words, running_total, shuffle_key, string_key

SEED = "mixing-1"
MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(``_q_src``, source_size, target) from rows (``_q_src``, size).

    Windows here run over one row per source, never over documents.
    """
    per = sizes.groupBy("_q_src").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(x).cast("bigint") for x in weights]),
                     (F.expr(f"pmod(_q_no - 1, {len(weights)})") + 1).cast("int"))
    per = (per.withColumn("_q_no", F.row_number().over(Window.orderBy("_q_src"))).withColumn("_q_w", w)
           .withColumn("_q_cap", F.col("source_size") * max_epochs))
    every = Window.partitionBy()
    upto = Window.orderBy(F.col("_q_cap") / F.col("_q_w"), "_q_no").rowsBetween(Window.unboundedPreceding, 0)
    # what is left, of words and of weight, when all sources of a smaller cap / weight are at their caps
    left = F.sum("source_size").over(every) - F.sum("_q_cap").over(upto) + F.col("_q_cap")
    left_w = F.sum("_q_w").over(every) - F.sum("_q_w").over(upto) + F.col("_q_w")
    per = per.withColumn("_q_full", F.col("_q_cap") / F.col("_q_w") <= left / left_w)
    rest = lambda c: F.sum(F.when(F.col("_q_full"), 0).otherwise(F.col(c))).over(every)
    spare = F.sum("source_size").over(every) - F.sum(F.when(F.col("_q_full"), F.col("_q_cap")).otherwise(0)).over(every)
    per = per.withColumn("_q_num", spare).withColumn("_q_den", rest("_q_w"))
    target = F.when(F.col("_q_full"), F.col("_q_cap").cast("double")).otherwise(
        (F.col("_q_w") * F.col("_q_num")).cast("double") / F.col("_q_den"))
    return per.select("_q_src", "source_size", target.alias("target"))


def narrow(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """The rows the queue works on: all columns are its own, the text is left behind."""
    return docs.select(F.col(id_col).alias("doc_id"), n_words(F.col(text_col)).alias("size"),
                       string_key(F.col(source_col)).alias("_q_src"), F.xxhash64(F.col(text_col)).alias("_q_text"))


def queued(d: DataFrame, seed: str = SEED) -> DataFrame:
    """``d`` (doc_id, size, _q_src, _q_text and any others) with ``_q_cum``: words of its source up to it."""
    d = d.withColumn("_q_key", shuffle_key(seed, F.col("doc_id"))).withColumn("_q_cell", key_cell(F.col("_q_key")))
    d = running_total(d, ["_q_src"], "_q_cell", ["_q_key", "doc_id", "size", "_q_text"], "size", "_q_cum")
    return d.drop("_q_key", "_q_cell")


def finish_times(max_epochs: int = MAX_EPOCHS):
    """Virtual finish times of the copies of a row, one an epoch."""
    return [(F.lit(e) * F.col("source_size") + F.col("_q_cum")) / F.col("target") for e in range(max_epochs)]


def last_finish(q: DataFrame):
    """Scalar: the latest finish time at which the copies finished so far fit the budget.

    Copies are summed by finish time, then by 4096 intervals of it; running sums
    over the intervals find the one that holds the cut, and only that is sorted.
    """
    c = (q.filter("size > 0").withColumn("_q_fin", F.explode(F.array(*finish_times())))
         .groupBy("_q_fin").agg(F.sum("size").alias("_q_sum")))
    c = c.withColumn("_q_slot", F.floor(F.col("_q_fin") / (F.col("_q_fin") + 1) * CELLS).cast("int"))
    c = running_total(c, [], "_q_slot", ["_q_fin"], "_q_sum", "_q_used")
    return c.filter(F.col("_q_used") <= q.agg(F.sum("size")).scalar()).agg(F.max("_q_fin")).scalar()


def copies(cut):
    """How many copies of a row finish by ``cut``."""
    n = F.lit(0)
    for t in finish_times():
        n = n + F.when((F.col("size") > 0) & (t <= cut), 1).otherwise(0)
    return n


def fair_queue(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of ``docs``."""
    q = materialise(queued(narrow(docs, id_col, text_col, source_col), seed), "queue")
    q = q.join(source_targets(q), "_q_src")
    return q.select("doc_id", "size", "source_size", "target",
                    (copies(last_finish(q)) * F.col("size")).cast("bigint").alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        seed: str = SEED) -> DataFrame:
    """The mixture itself: every row of ``docs`` as many times as it is taken, all columns kept."""
    q = materialise(queued(narrow(docs, id_col, text_col, source_col), seed), "queue")
    targets = source_targets(q)
    cut = last_finish(q.join(targets, "_q_src"))
    d = docs.select(F.struct(*docs.columns).alias("_q_row"))
    d = d.select(F.col("_q_row")[id_col].alias("doc_id"), n_words(F.col("_q_row")[text_col]).alias("size"),
                 string_key(F.col("_q_row")[source_col]).alias("_q_src"),
                 F.xxhash64(F.col("_q_row")[text_col]).alias("_q_text"), "_q_row")
    d = queued(d, seed).join(targets, "_q_src").withColumn("_q_n", copies(cut)).filter("_q_n > 0")
    return d.withColumn("_q_copy", F.explode(F.sequence(F.lit(1), F.col("_q_n")))).select("_q_row.*")
