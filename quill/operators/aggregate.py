"""Result aggregations (A2-A15) over the canonical ``results`` relation.

Scalars that normalise a grouped result (totals, means, deviations) are
computed as scalar subqueries (``DataFrame.scalar()``) instead of global
windows or cross joins, so no step funnels all rows into one task.
Per-group top-k uses ``row_number() <= k``, which Spark plans with a
window group limit on both sides of the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quill.functions import text as tx
from quill.functions.text import let, unnest
from quill.functions.vectors import SENTIMENT_LABELS
from quill.operators.entities import ENTITY_TYPES, entities_long
from quill.session import staged

TYPE_NAMES = sorted(set(ENTITY_TYPES.values()))


def sent_label() -> Column:
    return F.col("sentiment.label")


def sent_score() -> Column:
    return F.col("sentiment.score")


def n_entities(c: str = "entities") -> Column:
    """Entity count with a missing array counted as 0."""
    return F.coalesce(F.size(c), F.lit(0)).cast("bigint")


def _total(results: DataFrame) -> Column:
    return results.select(F.count("*")).scalar()


def sentiment_counts(prefix: str = "n_") -> list[Column]:
    return [F.count_if(sent_label() == lab).cast("bigint").alias(prefix + lab) for lab in SENTIMENT_LABELS]


def one_pass(results: DataFrame, per_document: dict[str, Column], per_entity: dict[str, Column]) -> DataFrame:
    """Sums over documents and over entities, and the entity types and distinct texts, from one scan.

    Each document is exploded into its entities (one empty row if none); the
    document's figures count on its first row only.  Rows are combined by
    entity text and type, then by text, so the distinct texts are the groups;
    a last step adds the groups up.  Types that are not known count as Other.
    """
    # figures first, in a projection of their own: next to the generator they would be computed for every entity
    d = results.select(*[c.alias(f"d_{n}") for n, c in per_document.items()], "entities")
    d = d.select(*[f"d_{n}" for n in per_document], F.posexplode_outer("entities").alias("pos", "e"))
    once = lambda n: F.sum(F.when(F.coalesce("pos", F.lit(0)) == 0, F.col(f"d_{n}"))).alias(f"d_{n}")
    by_text = d.groupBy(F.col("e.text").alias("text"), F.col("e.type").alias("kind")).agg(
        *[once(n) for n in per_document], *[F.sum(c).alias(f"e_{n}") for n, c in per_entity.items()],
        F.count("e").alias("n"))
    # a text has few types, so types are told apart only now, over distinct (text, type)
    total = by_text.groupBy("text").agg(
        *[F.sum(f"d_{n}").alias(f"d_{n}") for n in per_document], *[F.sum(f"e_{n}").alias(f"e_{n}") for n in per_entity],
        *[F.sum(F.when(F.col("kind") == t, F.col("n")).otherwise(0)).alias(f"t_{t}") for t in TYPE_NAMES],
        F.sum(F.when(F.coalesce(F.col("kind").isin(*TYPE_NAMES), F.lit(False)), 0).otherwise(F.col("n"))).alias("t_Other")).agg(
        *[F.sum(f"d_{n}").alias(n) for n in per_document], *[F.sum(f"e_{n}").alias(n) for n in per_entity],
        *[F.sum(F.col(f"`t_{t}`")).alias(f"t_{t}") for t in (*TYPE_NAMES, "Other")],
        F.count("text").cast("bigint").alias("unique_entities"))
    pairs = F.array(*[F.when(F.col(f"`t_{t}`") > 0, F.concat(F.lit(t + "="), F.col(f"`t_{t}`").cast("string")))
                      for t in sorted((*TYPE_NAMES, "Other"))])
    return total.select(*per_document, *per_entity, "unique_entities", F.array_join(F.array_compact(pairs), ", ").alias("entity_types"))


def _doc_sums() -> dict[str, Column]:
    """Per-document figures that the summaries add up."""
    one, wc, score, label = F.lit(1).cast("bigint"), F.col("n_words"), F.col("score"), F.col("label")
    ok = F.coalesce(F.col("error"), F.lit("")) == ""
    n = {f"n_{lab}": F.when(label == lab, one).otherwise(0) for lab in SENTIMENT_LABELS}
    return {"docs": one, "ok": F.when(ok, one).otherwise(0), **n, "labelled": F.when(label.isNotNull(), one).otherwise(0),
            "scored": F.when(score.isNotNull(), one).otherwise(0), "score": score, "score2": score * score,
            "sure": F.when(score > 0.8, one).otherwise(0), "ents": n_entities(),
            "with_ents": F.when(F.col("entities").isNotNull(), one).otherwise(0),
            "texts": F.when(F.col("chars").isNotNull(), one).otherwise(0), "chars": F.col("chars"), "words": wc,
            "timed": F.when(F.col("processing_time").isNotNull(), one).otherwise(0), "time": F.col("processing_time")}


def _entity_sums() -> dict[str, Column]:
    s, one = F.col("e.score"), F.lit(1).cast("bigint")
    return {"ent_scored": F.when(s.isNotNull(), one).otherwise(0), "ent_score": s, "ent_sure": F.when(s > 0.8, one).otherwise(0)}


def corpus_sums(results: DataFrame) -> DataFrame:
    """One row of sums for the summaries and reports (one scan of the documents)."""
    r = results.select(sent_label().alias("label"), sent_score().alias("score"), F.length("text").cast("bigint").alias("chars"),
                       tx.word_count(F.col("text")).alias("n_words"), "entities", "processing_time", "error")
    return one_pass(r, _doc_sums(), _entity_sums())


def ratio(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))


def summary_columns() -> list:
    """The corpus statistics, from a row of sums."""
    var = (F.col("score2") - F.col("score") * F.col("score") / F.col("scored")) / (F.col("scored") - 1)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return [
        zero("docs").alias("total_documents"), ratio("ok", "docs").alias("success_rate"),
        (zero("docs") - zero("ok")).alias("failed_documents"), *[zero(f"n_{x}").alias(f"n_{x}") for x in SENTIMENT_LABELS],
        ratio("score", "scored").alias("avg_confidence"),
        F.when(F.col("scored") > 1, F.sqrt(F.greatest(var, F.lit(0.0)))).otherwise(F.lit(0.0)).alias("std_confidence"),
        zero("ents").alias("total_entities"), ratio("ents", "with_ents").alias("avg_entities_per_doc"),
        ratio("chars", "texts").alias("avg_length"), ratio("words", "texts").alias("avg_words"),
        ratio("time", "timed").alias("avg_processing_time"), "unique_entities", "entity_types"]


def summary_stats(results: DataFrame) -> DataFrame:
    """A2: one row of corpus statistics."""
    return corpus_sums(results).select(*summary_columns())


def agg_by_sentiment(results: DataFrame) -> DataFrame:
    """A3: per sentiment label; the percentage base is all results."""
    total = _total(results)
    wc = tx.word_count(F.col("text"))
    return (results.filter(sent_label().isNotNull()).groupBy(sent_label().alias("sentiment"))
            .agg(F.count("*").cast("bigint").alias("count"),
                 (F.count("*") * 100.0 / total).alias("percentage"),
                 F.coalesce(F.avg(sent_score()), F.lit(0.0)).alias("avg_confidence"),
                 F.avg(F.length("text")).alias("avg_length"), F.avg(wc).alias("avg_words"),
                 F.sum(F.length("text")).cast("bigint").alias("total_chars"),
                 F.sum(wc).cast("bigint").alias("total_words")))


def top_entities_by(results: DataFrame, group: Column, name: str, n: int = 10) -> DataFrame:
    """Top-``n`` entity texts per group (count desc, then text)."""
    e = unnest(results.select(group.alias(name), F.col("entities.text").alias("texts")), "texts", "entity", name)
    e = e.filter(F.col(name).isNotNull())
    counts = e.groupBy(name, "entity").agg(F.count("*").cast("bigint").alias("count"))
    w = Window.partitionBy(name).orderBy(F.desc("count"), F.asc("entity"))
    return (counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
            .withColumn("rank", F.col("rank").cast("bigint")))


def top_entities_per_label(results: DataFrame, n: int = 20) -> DataFrame:
    """A4 top list: most frequent texts of each entity label."""
    e = entities_long(results, keep=()).withColumn("label", F.coalesce("label", F.lit("UNKNOWN")))
    counts = e.groupBy("label", F.col("text").alias("entity")).agg(F.count("*").cast("bigint").alias("count"))
    w = Window.partitionBy("label").orderBy(F.desc("count"), F.asc("entity"))
    return (counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
            .withColumn("rank", F.col("rank").cast("bigint")))


def agg_by_entity_type(results: DataFrame) -> DataFrame:
    """A4: per entity label (NULL -> UNKNOWN).

    Whether an entity is the first of its label in its document is a figure of
    the row, so coverage is a sum; combined by (label, text), the groups of a
    label are its distinct texts.  One scan of the documents, and one count.
    """
    total = _total(results)
    labels = F.transform("entities", lambda e: F.coalesce(e["label"], F.lit("UNKNOWN")))

    def marked(ls: Column) -> Column:
        return F.transform("entities", lambda e, i: F.struct(
            F.get(ls, i).alias("label"), e["text"].alias("text"), F.coalesce(e["score"], F.lit(0.0)).alias("score"),
            (F.array_position(ls, F.get(ls, i)) == i + 1).cast("bigint").alias("first")))
    e = unnest(results, let(labels, marked), "e").select("e.*")
    c = e.groupBy("label", "text").agg(F.count("*").alias("n"), F.sum("score").alias("s"), F.sum("first").alias("docs"))
    return c.groupBy("label").agg(
        F.sum("n").cast("bigint").alias("total_occurrences"), F.count("text").cast("bigint").alias("unique_entities"),
        (F.sum("s") / F.sum("n")).alias("avg_confidence"), (F.sum("docs") / total).alias("document_coverage"))


def agg_by_window(results: DataFrame, size: str = "1 day", ts: str = "processed_at") -> DataFrame:
    """A5: per tumbling time window of ``size`` (the reference's default is a day)."""
    docs = (results.filter(F.col(ts).isNotNull()).groupBy(F.window(ts, size).alias("w"))
            .agg(F.count("*").cast("bigint").alias("document_count"), *sentiment_counts(),
                 F.sum(n_entities()).cast("bigint").alias("entity_count"),
                 F.coalesce(F.avg(sent_score()), F.lit(0.0)).alias("avg_confidence")))
    ents = (entities_long(results, keep=(ts,)).groupBy(F.window(ts, size).alias("w"))
            .agg(F.countDistinct("text").cast("bigint").alias("unique_entities")))
    return (docs.join(ents, "w", "left")
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"),
                    "document_count", *[f"n_{x}" for x in SENTIMENT_LABELS], "entity_count",
                    F.coalesce("unique_entities", F.lit(0)).cast("bigint").alias("unique_entities"),
                    "avg_confidence"))


def agg_by_classification(results: DataFrame) -> DataFrame:
    """Per classification label; percentage base is all results."""
    total = _total(results)
    cl = F.col("classification.label")
    return (results.filter(cl.isNotNull()).groupBy(cl.alias("classification"))
            .agg(F.count("*").cast("bigint").alias("count"),
                 (F.count("*") * 100.0 / total).alias("percentage"), *sentiment_counts(),
                 F.avg(F.coalesce(F.col("classification.score"), F.lit(0.0))).alias("avg_classification_confidence")))


def entity_cooccurrence(results: DataFrame, min_count: int = 3) -> DataFrame:
    """Unordered pairs of distinct entity texts sharing documents.

    Exact pruning first: a pair can only reach ``min_count`` when both texts
    occur in at least ``min_count`` documents.  Those texts are numbered; the
    numbers of a document meet as blocks of pairs, counted in the task and then
    by Spark, and texts come back only for the pairs that stay.
    """
    total = _total(results)
    de = unnest(results, F.array_distinct(F.transform("entities", lambda e: e["text"])), "text", "document_id")
    de = staged(de.filter(F.col("text").isNotNull()).distinct(), "entity-documents")
    frequent = de.groupBy("text").agg(F.count("*").alias("df")).filter(F.col("df") >= min_count)
    names = staged(frequent.select("text", F.monotonically_increasing_id().alias("id")), "entity-ids")
    ids = de.join(names, "text").groupBy("document_id").agg(F.collect_list("id").alias("ids")).filter(F.size("ids") > 1)
    pairs = ids.select("ids").mapInArrow(_pair_counts, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    pairs = pairs.filter(F.col("n") >= min_count)
    name = lambda key, out: names.select(F.col("id").alias(key), F.col("text").alias(out))
    named = pairs.join(name("a", "x"), "a").join(name("b", "y"), "b")
    return named.select(F.least("x", "y").alias("entity1"), F.greatest("x", "y").alias("entity2"),
                        F.col("n").cast("bigint").alias("co_occurrence_count"), (F.col("n") / total).alias("strength"))


PAIR_ROWS = 1 << 20


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the pairs (a < b) within each row's ids, over about ``PAIR_ROWS`` pairs at a time."""
    codes: list[np.ndarray] = []
    size = 0

    def counted() -> pa.RecordBatch:
        pairs, n = np.unique(np.concatenate(codes), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(seen[pairs // len(seen)]), pa.array(seen[pairs % len(seen)]),
                                           pa.array(n.astype(np.int64))], names=["a", "b", "n"])

    for batch in batches:
        col = batch.column(0)
        seen, at = np.unique(col.flatten().to_numpy(), return_inverse=True)
        ends = np.cumsum(col.value_lengths().to_numpy())
        for lo, hi in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
            row = np.sort(at[lo:hi]).astype(np.int64)
            step = max(1, PAIR_ROWS // len(row))
            for i in range(0, len(row) - 1, step):
                some = np.arange(i, min(i + step, len(row) - 1))
                first, second = np.nonzero(some[:, None] < np.arange(i + 1, len(row))[None, :])
                codes.append(row[some[first]] * len(seen) + row[i + 1 + second])
                size += len(first)
                if size >= PAIR_ROWS:
                    yield counted()
                    codes, size = [], 0
        if codes:
            yield counted()
            codes, size = [], 0


def metric_values(results: DataFrame, metric: str) -> DataFrame | None:
    if metric == "sentiment_confidence":
        return results.filter(sent_score().isNotNull()).select("document_id", sent_score().cast("double").alias("value"))
    if metric == "entity_count":
        return results.select("document_id", n_entities().cast("double").alias("value"))
    if metric == "text_length":
        return results.select("document_id", F.coalesce(F.length("text"), F.lit(0)).cast("double").alias("value"))
    return None


def find_outliers(results: DataFrame, metric: str = "sentiment_confidence", threshold: float = 2.0) -> DataFrame:
    """Rows with |z| > threshold (sample std; std 0 -> z = 0)."""
    vals = metric_values(results, metric)
    if vals is None:  # unknown metric: empty result with the same schema
        vals = results.select("document_id", F.lit(None).cast("double").alias("value")).limit(0)
    mean = vals.select(F.avg("value")).scalar()
    std = vals.select(F.coalesce(F.stddev_samp("value"), F.lit(0.0))).scalar()
    z = F.when(std > 0, F.abs(F.col("value") - mean) / std).otherwise(F.lit(0.0))
    return (vals.select("document_id", F.lit(metric).alias("metric"), "value", z.alias("z_score"),
                        mean.alias("mean"), std.alias("std_dev"))
            .filter(F.col("z_score") > threshold))


def _daily(results: DataFrame, ts: str):
    day = F.to_date(ts)
    daily = (results.filter(F.col(ts).isNotNull()).groupBy(day.alias("day"))
             .agg(F.count("*").alias("docs"), F.sum(n_entities()).alias("ents")))
    return day, daily


def trend_sentiment(results: DataFrame, ts: str = "processed_at") -> DataFrame:
    """Per label, first/last daily share over the days the label occurs."""
    day, daily = _daily(results, ts)
    n_days = daily.select(F.count("*")).scalar()
    per = (results.filter(F.col(ts).isNotNull() & sent_label().isNotNull())
           .groupBy(day.alias("day"), sent_label().alias("sentiment")).agg(F.count("*").alias("n"))
           .join(daily, "day").withColumn("share", F.col("n") / F.col("docs")))
    out = per.groupBy("sentiment").agg(F.min_by("share", "day").alias("start_value"),
                                       F.max_by("share", "day").alias("end_value"))
    return (out.filter(n_days >= 2)
            .withColumn("direction", F.when(F.col("end_value") > F.col("start_value"), "increasing")
                        .otherwise("decreasing"))
            .withColumn("change", F.col("end_value") - F.col("start_value")))


def trend_entity_density(results: DataFrame, ts: str = "processed_at") -> DataFrame:
    """Entity density first/last day, period, daily averages; < 2 days -> error row."""
    _, daily = _daily(results, ts)
    total = _total(results)
    dens = daily.withColumn("density", F.col("ents") / F.col("docs"))
    agg = dens.agg(F.min("day").alias("period_start"), F.max("day").alias("period_end"),
                   F.count("*").cast("bigint").alias("n_days"),
                   F.min_by("density", "day").alias("start"), F.max_by("density", "day").alias("end"),
                   F.avg("density").alias("daily_avg_entities"))
    ok = F.col("n_days") >= 2
    return agg.select(
        F.when(ok, F.col("period_start").cast("string")).alias("period_start"),
        F.when(ok, F.col("period_end").cast("string")).alias("period_end"),
        "n_days", F.when(ok, F.col("start")).alias("start"), F.when(ok, F.col("end")).alias("end"),
        F.when(ok, F.col("end") - F.col("start")).alias("change"),
        F.when(ok, total / F.col("n_days")).alias("daily_avg_documents"),
        F.when(ok, F.col("daily_avg_entities")).alias("daily_avg_entities"),
        F.when(~ok, F.lit("Insufficient data for trend analysis")).alias("error"))


def top_entities(results: DataFrame, n: int = 10, label: str | None = None) -> DataFrame:
    """Most frequent entity texts (count desc, then text)."""
    e = entities_long(results, keep=())
    if label:
        e = e.filter(F.col("label") == label)
    return (e.groupBy("text").agg(F.count("*").cast("bigint").alias("count"))
            .orderBy(F.desc("count"), F.asc("text")).limit(n))


def unique_entities(results: DataFrame, approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """Distinct entity texts; ``approx`` uses a HyperLogLog++ sketch (bounded memory)."""
    e = entities_long(results, keep=())
    agg = F.approx_count_distinct("text", rsd) if approx else F.countDistinct("text")
    return e.agg(agg.cast("bigint").alias("unique_entities"))


def run_stats(results: DataFrame) -> DataFrame:
    """Processed count, mean time and throughput (0 when empty)."""
    return results.agg(
        F.count("*").cast("bigint").alias("processed"),
        F.coalesce(F.avg("processing_time"), F.lit(0.0)).alias("avg_time"),
        F.coalesce(F.try_divide(F.count("*"), F.sum("processing_time")), F.lit(0.0)).alias("throughput"))


def frequent_texts(df: DataFrame, ts: str = "processed_at", days: int = 7, limit: int = 1000) -> DataFrame:
    """Most frequent texts (by md5) in the last ``days`` before the newest row."""
    newest = df.select(F.max(ts)).scalar()
    recent = df.filter(F.col(ts) > newest - F.make_dt_interval(F.lit(days)))
    return (recent.groupBy(F.md5("text").alias("text_hash")).agg(F.count("*").cast("bigint").alias("count"))
            .orderBy(F.desc("count"), F.asc("text_hash")).limit(limit))


def dedup_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Keep the lowest ``key`` of each exact text (valid texts only).

    ``min_by`` over the whole row is a declarative aggregate, so duplicates
    of a hot text collapse map-side before the shuffle.
    """
    valid = docs.filter(tx.invalid_reason(F.col(text)).isNull())
    cols = docs.columns
    kept = valid.groupBy(F.md5(text).alias("h")).agg(F.min_by(F.struct(*cols), F.col(key)).alias("r"))
    return kept.select("r.*")
