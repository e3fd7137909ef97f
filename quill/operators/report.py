"""Report and chart tables.

Reports are small DataFrames (one row, or one row per label / insight)
computed with distributed aggregates over ``results``; rendering (HTML,
plots) is left to the caller.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quill.functions import text as tx
from quill.functions.vectors import SENTIMENT_LABELS
from quill.operators import aggregate as ag
from quill.operators import stats as st
from quill.operators.entities import entities_long
from quill.session import cut_lineage, staged


def quality_metrics(results: DataFrame) -> DataFrame:
    """Mean sentiment / entity scores and the share of scores > 0.8 (strict)."""
    return ag.corpus_sums(results).select(
        ag.ratio("score", "scored").alias("avg_sentiment_confidence"), ag.ratio("sure", "scored").alias("high_confidence_sentiments"),
        ag.ratio("ent_score", "ent_scored").alias("avg_entity_confidence"),
        ag.ratio("ent_sure", "ent_scored").alias("high_confidence_entities"))


def report_summary(results: DataFrame) -> DataFrame:
    """G1: processing summary, sentiment shares over labelled rows, entities, text, quality, from one scan."""
    s = ag.corpus_sums(results)
    return s.select(
        F.col("docs").cast("bigint").alias("total_documents"), F.col("ok").cast("bigint").alias("successful"),
        (F.col("docs") - F.col("ok")).cast("bigint").alias("failed"),
        *[F.try_divide(F.col(f"n_{x}") * 100.0, F.col("labelled")).alias(f"pct_{x}") for x in SENTIMENT_LABELS],
        F.col("ents").cast("bigint").alias("total_entities"), F.try_divide("ents", "docs").alias("entities_per_document"),
        ag.ratio("chars", "texts").alias("avg_length"), ag.ratio("words", "texts").alias("avg_words"),
        F.col("chars").cast("bigint").alias("total_characters"), F.col("words").cast("bigint").alias("total_words"),
        ag.ratio("score", "scored").alias("avg_sentiment_confidence"), ag.ratio("sure", "scored").alias("high_confidence_sentiments"),
        F.try_divide("ok", "docs").alias("success_rate"), "unique_entities",
        ag.ratio("ent_score", "ent_scored").alias("avg_entity_confidence"),
        ag.ratio("ent_sure", "ent_scored").alias("high_confidence_entities"))


def dominant_sentiment(results: DataFrame) -> DataFrame:
    """The most frequent label (ties by label)."""
    return (results.filter(ag.sent_label().isNotNull()).groupBy(ag.sent_label().alias("sentiment"))
            .agg(F.count("*").cast("bigint").alias("count"))
            .orderBy(F.desc("count"), F.asc("sentiment")).limit(1))


def report_sentiment(results: DataFrame) -> DataFrame:
    """Per label (missing label -> neutral): count and mean confidence."""
    s = results.filter(F.col("sentiment").isNotNull())
    return (s.groupBy(F.coalesce(ag.sent_label(), F.lit("neutral")).alias("sentiment"))
            .agg(F.count("*").cast("bigint").alias("count"),
                 F.avg(F.coalesce(ag.sent_score(), F.lit(0.0))).alias("avg_confidence")))


def report_sentiment_detail(results: DataFrame) -> DataFrame:
    """G4 detail rows with a 100-character preview."""
    return results.filter(F.col("sentiment").isNotNull()).select(
        "document_id", F.coalesce(ag.sent_label(), F.lit("neutral")).alias("sentiment"),
        F.coalesce(ag.sent_score(), F.lit(0.0)).alias("confidence"),
        tx.preview(F.coalesce(F.col("text"), F.lit(""))).alias("text_preview"))


def insights_sentiment(results: DataFrame) -> DataFrame:
    """Insight sentences (seq, insight) derived from G4."""
    rs = report_sentiment(results)
    agg = rs.agg(
        F.sum(F.when(F.col("sentiment") == "positive", F.col("count"))).alias("pos"),
        F.sum(F.when(F.col("sentiment") == "negative", F.col("count"))).alias("neg"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("avg_confidence") > 0.8, F.col("sentiment")))), ", ")
        .alias("high"))
    dom = dominant_sentiment(results)
    d1 = dom.select(F.lit(1).cast("bigint").alias("seq"), F.format_string(
        "Dominant sentiment is '%s' (%d documents)", "sentiment", "count").alias("insight"))
    d2 = agg.filter(F.col("pos").isNotNull() & F.col("neg").isNotNull()).select(
        F.lit(2).cast("bigint").alias("seq"),
        F.format_string("Positive to negative ratio: %.2f", F.round(F.col("pos") / (F.col("neg") + 1), 2)).alias("insight"))
    d3 = agg.filter(F.col("high") != "").select(
        F.lit(3).cast("bigint").alias("seq"), F.concat(F.lit("High confidence sentiments: "), "high").alias("insight"))
    return d1.unionByName(d2).unionByName(d3)


def report_entities(results: DataFrame, top: int = 20) -> DataFrame:
    """Per label: occurrences, sum of the top-``top`` counts, the top entity."""
    t = ag.top_entities_per_label(results, top)
    tot = entities_long(results, keep=()).groupBy(F.coalesce("label", F.lit("UNKNOWN")).alias("label")) \
        .agg(F.count("*").cast("bigint").alias("occurrences"), F.countDistinct("text").cast("bigint").alias("unique"))
    tops = t.groupBy("label").agg(F.sum("count").cast("bigint").alias("top_sum"),
                                  F.min_by("entity", "rank").alias("top_entity"),
                                  F.min_by("count", "rank").alias("top_count"))
    return tot.join(tops, "label")


def top_entities_typed(results: DataFrame, n: int = 50) -> DataFrame:
    """Top-``n`` texts with their most common label (ties by label)."""
    e = entities_long(results, keep=())
    c = e.groupBy("text", "label").agg(F.count("*").alias("n"))
    per = c.groupBy("text").agg(F.sum("n").cast("bigint").alias("frequency"))
    # a text has at most one row per label, so these windows are tiny
    best = (c.withColumn("rk", F.row_number().over(Window.partitionBy("text").orderBy(F.desc("n"), F.asc("label"))))
            .filter(F.col("rk") == 1).select("text", F.col("label").alias("type")))
    return (per.join(best, "text").select("text", "type", "frequency")
            .orderBy(F.desc("frequency"), F.asc("text")).limit(n))


def entity_coverage(results: DataFrame) -> DataFrame:
    """Share of documents with at least one entity."""
    return results.agg(F.coalesce(F.avg(F.when(F.size("entities") > 0, 1.0).otherwise(0.0)), F.lit(0.0))
                       .alias("entity_coverage"))


def insights_entities(results: DataFrame, top: int = 20) -> DataFrame:
    """Most prevalent label (largest top-``top`` sum) and the top entity of each label."""
    r = report_entities(results, top)
    first = (r.orderBy(F.desc("top_sum"), F.asc("label")).limit(1)
             .select(F.lit(0).cast("bigint").alias("seq"), F.lit("").alias("label"),
                     F.format_string("Most prevalent entity type: %s", "label").alias("insight")))
    each = r.select(F.lit(1).cast("bigint").alias("seq"), "label", F.format_string(
        "Top %s: '%s' (%d occurrences)", "label", "top_entity", "top_count").alias("insight"))
    return first.unionByName(each)


def document_report(results: DataFrame) -> DataFrame:
    """Per-document report row (row-local)."""
    wc = tx.word_count(F.coalesce(F.col("text"), F.lit("")))
    n = ag.n_entities()
    return results.select(
        "document_id", "processed_at", F.length(F.coalesce(F.col("text"), F.lit(""))).cast("bigint").alias("text_length"),
        wc.alias("word_count"), ag.sent_label().alias("sentiment_label"), ag.sent_score().alias("sentiment_confidence"),
        n.alias("total_found"), (n / F.greatest(wc, F.lit(1))).alias("entity_density"),
        F.col("classification.label").alias("classification"))


def document_entities_by_label(results: DataFrame) -> DataFrame:
    """G10 ``by_type``: per document and label, entity texts in position order (row-local)."""
    labels = F.array_sort(F.array_distinct(F.transform("entities", lambda e: F.coalesce(e["label"], F.lit("UNKNOWN")))))
    grouped = F.transform(labels, lambda lab: F.struct(lab.alias("label"), F.transform(
        F.filter("entities", lambda e: F.coalesce(e["label"], F.lit("UNKNOWN")) == lab), lambda e: e["text"]).alias("texts")))
    return (results.select("document_id", F.explode(grouped).alias("g"))
            .select("document_id", "g.label", F.array_join("g.texts", "; ").alias("texts"),
                    F.size("g.texts").cast("bigint").alias("n")))


def sentiment_segments(results: DataFrame, scorer, size: int = 100) -> DataFrame:
    """Split each text into ``size``-character segments and score each one."""
    t = F.coalesce(F.col("text"), F.lit(""))
    nseg = F.ceil(F.length(t) / size).cast("int")
    segs = results.select("document_id", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.greatest(nseg - 1, F.lit(0))), lambda i: F.substring(t, i * size + 1, size))).alias("seg_no", "segment"))
    return scorer(segs.filter(F.length("segment") > 0))


def chart_sentiment(results: DataFrame) -> DataFrame:
    """Counts per label plus the total."""
    total = results.filter(F.col("sentiment").isNotNull()).select(F.count("*")).scalar()
    return (results.filter(F.col("sentiment").isNotNull())
            .groupBy(F.coalesce(ag.sent_label(), F.lit("unknown")).alias("sentiment"))
            .agg(F.count("*").cast("bigint").alias("count")).withColumn("total", total))


def chart_confidence_box(results: DataFrame) -> DataFrame:
    """Box statistics per label with linear quartiles (exact, distributed), all from the value counts."""
    s = results.filter(F.col("sentiment").isNotNull()).select(
        F.coalesce(ag.sent_label(), F.lit("unknown")).alias("sentiment"), F.coalesce(ag.sent_score(), F.lit(0.0)).alias("v"))
    return st.box_stats(s, ["sentiment"], "v", {"q1": 0.25, "median": 0.5, "q3": 0.75})


def chart_entity_types(results: DataFrame, top: int | None = None) -> DataFrame:
    """Entity label counts (optionally the ``top`` labels)."""
    c = (entities_long(results, keep=()).groupBy(F.coalesce("label", F.lit("UNKNOWN")).alias("label"))
         .agg(F.count("*").cast("bigint").alias("count")))
    return c.orderBy(F.desc("count"), F.asc("label")).limit(top) if top else c


def chart_timeline(results: DataFrame, ts: str = "processed_at") -> DataFrame:
    """Documents per timestamp and label."""
    return (results.filter(F.col("sentiment").isNotNull() & F.col(ts).isNotNull())
            .groupBy(F.col(ts).cast("timestamp_ntz").alias("ts"), F.coalesce(ag.sent_label(), F.lit("unknown")).alias("sentiment"))
            .agg(F.count("*").cast("bigint").alias("count")))


def network_edges(results: DataFrame, min_count: int = 5) -> DataFrame:
    """G17 edges: co-occurrence pairs with count >= ``min_count``; width = min(count/2, 10)."""
    e = ag.entity_cooccurrence(results, min_count)
    return e.select("entity1", "entity2", "co_occurrence_count",
                    F.least(F.col("co_occurrence_count") / 2.0, F.lit(10.0)).alias("width"))


def network_nodes(edges: DataFrame) -> DataFrame:
    """G17 nodes: distinct ends of the edges on a circle, position by name order."""
    nodes = edges.select(F.explode(F.array("entity1", "entity2")).alias("node")).distinct()
    ranked = st.running_sums(nodes.withColumn("one", F.lit(1)), [], [F.col("node")], ["one"])
    n = ranked.select(F.max("cum_one")).scalar()
    ang = (F.col("cum_one") - 1) * F.lit(2 * math.pi) / n
    return ranked.select("node", (F.col("cum_one") - 1).cast("bigint").alias("idx"),
                         F.cos(ang).alias("x"), F.sin(ang).alias("y"))


def network_tables(results: DataFrame, min_count: int = 5) -> tuple[DataFrame, DataFrame]:
    """Edges and nodes; the edges are built once."""
    edges = staged(network_edges(results, min_count), "network-edges")
    return edges, network_nodes(edges)


def dashboard_tables(results: DataFrame) -> DataFrame:
    """The four dashboard panels as one tagged long table (panel, key, value).

    The panels stand on two small tables, scores by label and entities by label
    and text, each counted once and written to the checkpoint folder.
    """
    scores = cut_lineage(results.filter(F.col("sentiment").isNotNull()).groupBy(
        F.coalesce(ag.sent_label(), F.lit("unknown")).alias("sentiment"), F.coalesce(ag.sent_score(), F.lit(0.0)).alias("v"))
        .agg(F.count("*").cast("bigint").alias("c")))
    ents = cut_lineage(entities_long(results, keep=()).groupBy(F.coalesce("label", F.lit("UNKNOWN")).alias("label"), "text")
                       .agg(F.count("*").alias("c")))
    panel = lambda df, name, key, value: df.select(F.lit(name).alias("panel"), F.col(key).alias("key"),
                                                   F.col(value).cast("double").alias("value"))
    top = lambda key: ents.groupBy(key).agg(F.sum("c").alias("n")).orderBy(F.desc("n"), F.asc(key)).limit(10)
    box = st.medians_of_counts(scores.filter(F.col("sentiment").isin(*SENTIMENT_LABELS)), ["sentiment"], "v")
    return (panel(scores.groupBy("sentiment").agg(F.sum("c").alias("n")), "sentiment", "sentiment", "n")
            .unionByName(panel(top("label"), "entity_types", "label", "n"))
            .unionByName(panel(top("text"), "top_entities", "text", "n"))
            .unionByName(panel(box, "confidence_median", "sentiment", "median")))
