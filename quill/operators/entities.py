"""Entity extraction and per-document entity operators.

Entities live in the ``entities`` array column of ``results`` as
``struct<text,label,type,start,end,score>`` with 0-based, end-exclusive
character offsets.  Row-local work (extraction, counts, filters, context)
is expressed on the array so it never shuffles; corpus-level work explodes
once into :func:`entities_long`.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quill.functions.text import let, prefix_sum, unnest

# Entity label -> display type (unknown labels are kept as is).
ENTITY_TYPES = {
    "PERSON": "Person",
    "ORG": "Organization",
    "GPE": "Location",
    "LOC": "Location",
    "DATE": "Date",
    "TIME": "Time",
    "MONEY": "Money",
    "PERCENT": "Percentage",
    "PRODUCT": "Product",
    "EVENT": "Event",
    "FAC": "Facility",
    "LAW": "Law",
    "LANGUAGE": "Language",
    "WORK_OF_ART": "Work of Art",
    "NORP": "Nationality/Group",
    "QUANTITY": "Quantity",
    "ORDINAL": "Ordinal",
    "CARDINAL": "Cardinal",
}


# Pattern rules used by the rule-based extractor (label, Java regex).
PATTERN_RULES = [
    ("EMAIL", r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+\.[a-z]+"),
    ("IP", r"[0-9]+(?:\.[0-9]+){3}"),
    ("CARDINAL", r"[0-9]+"),
]

# Spellings with the same matches that do not start again inside a run that has failed.
LINEAR_FORMS = {
    PATTERN_RULES[0][1]: r"(?:(?<![A-Za-z0-9._-])|\G)[A-Za-z0-9._-]++@[A-Za-z0-9.-]+\.[a-z]+",
}


def entity_type(label: Column) -> Column:
    """Display type of a label; unknown labels pass through."""
    m = F.create_map(*[F.lit(x) for kv in ENTITY_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(m, label), label)


# Marks the matches in a text; a noncharacter, so texts do not hold it (one that does shows U+FFFE there).
SPAN_MARK = "\uffff"


def match_spans(text: Column, pattern: str) -> Column:
    """All regex matches with offsets, in order: array<struct<text,start,end>>.

    One pass of the pattern marks the matches, so the pieces between marks are
    gap, match, gap, ...; the end of match k is the prefix sum of gap and match
    lengths up to k.  The same formula serves any number of matches.
    """
    t, pattern = F.translate(F.coalesce(text, F.lit("")), SPAN_MARK, "\ufffe"), LINEAR_FORMS.get(pattern, pattern)
    parts = F.split(F.regexp_replace(t, pattern, f"{SPAN_MARK}$0{SPAN_MARK}"), SPAN_MARK, -1)

    def with_parts(p):
        n = ((F.size(p) - 1) / 2).cast("int")
        lens = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: (
            F.length(F.get(p, 2 * k)) + F.length(F.get(p, 2 * k + 1))))).otherwise(F.array().cast("array<int>"))
        return let(prefix_sum(lens), lambda ends: F.transform(ends, lambda e, k: F.struct(
            F.get(p, 2 * k + 1).alias("text"), (e - F.length(F.get(p, 2 * k + 1))).alias("start"), e.alias("end"))))
    return let(parts, with_parts)


def _labelled(spans: Column, label: str, score: float) -> Column:
    def one(s):
        ent = F.struct(s["text"].alias("text"), F.lit(label).alias("label"),
                       entity_type(F.lit(label)).alias("type"), s["start"].alias("start"),
                       s["end"].alias("end"), F.lit(score).cast("double").alias("score"))
        return F.struct(s["start"].alias("k1"), s["end"].alias("k2"), F.lit(label).alias("k3"), ent.alias("e"))
    return F.transform(spans, one)


def extract_entities(text: Column, rules=None, score: float = 1.0) -> Column:
    """N1 (a): rule-based extraction; entities ordered by (start, end, label)."""
    rules = PATTERN_RULES if rules is None else rules
    parts = [_labelled(match_spans(text, pat), lab, score) for lab, pat in rules]
    allp = parts[0] if len(parts) == 1 else F.concat(*parts)
    return F.transform(F.sort_array(allp), lambda x: x["e"])


def count_entities(text: Column, rules=None) -> Column:
    """How many entities the rules find; no spans are built."""
    rules = PATTERN_RULES if rules is None else rules
    t = F.coalesce(text, F.lit(""))
    return sum((F.regexp_count(t, F.lit(LINEAR_FORMS.get(p, p))) for _, p in rules), F.lit(0)).cast("bigint")


def entities_long(results: DataFrame, keep=("processed_at",)) -> DataFrame:
    """results x posexplode(entities): one row per entity."""
    extra = [c for c in keep if c in results.columns]
    return (unnest(results, "entities", "e", "document_id", *extra, pos="pos")
            .select("document_id", *extra, F.col("pos").cast("bigint").alias("pos"), "e.text", "e.label",
                    "e.type", "e.start", "e.end", "e.score"))


def entity_counts(entities: Column) -> Column:
    """Map type -> count within one document (row-local, no shuffle)."""
    types = F.array_sort(F.array_distinct(F.transform(entities, lambda e: e["type"])))
    return F.map_from_arrays(types, F.transform(
        types, lambda t: F.size(F.filter(entities, lambda e: e["type"] == t)).cast("bigint")))


def filter_entities(entities: Column, types=None, min_score: float | None = None) -> Column:
    """Keep entities of the given types and/or with score >= ``min_score``."""
    def keep(e):
        c = F.lit(True)
        if types:
            c = c & e["type"].isin(*types)
        if min_score is not None:
            c = c & (e["score"] >= min_score)
        return c
    return F.filter(entities, keep)


def entities_by_type(results: DataFrame, types=None) -> DataFrame:
    """Distinct entity texts per type, as (type, text) rows.

    Long form on purpose: a type may have millions of distinct texts, so they
    are never collected into one row.
    """
    ents = entities_long(results, keep=())
    if types:
        ents = ents.filter(F.col("type").isin(*types))
    return ents.select("type", "text").distinct()


def entity_context(text: Column, entities: Column, window: int = 50) -> Column:
    """Context of +-``window`` characters around each entity, clamped."""
    def with_len(n):
        def ctx(e):
            s = F.greatest(e["start"] - window, F.lit(0))
            t = F.least(e["end"] + window, n)
            return F.struct(e["text"].alias("text"), e["label"].alias("label"),
                            F.substring(text, s + 1, t - s).alias("context"),
                            (e["start"] - s).alias("rel_start"), (e["end"] - s).alias("rel_end"))
        return F.transform(entities, ctx)
    return let(F.length(text), with_len)


ISLAND_STRUCT = "struct<start:int,end:int,n_spans:bigint,label:string,best_len:int>"


def merge_entities(entities: Column) -> Column:
    """Merge overlapping spans of one document into islands (row-local).

    Spans are visited in (start, end, label) order; a span joins the current
    island when it starts before the island's end (touching spans stay
    separate).  The island keeps the label of its longest span, the first
    one on ties.  Returns array<struct<start,end,n_spans,label>>.
    """
    ordered = F.transform(F.sort_array(F.transform(entities, lambda e: F.struct(
        e["start"].alias("start"), e["end"].alias("end"), e["label"].alias("label")))), lambda x: x)

    def fresh(e):
        return F.struct(e["start"].alias("start"), e["end"].alias("end"), F.lit(1).cast("bigint").alias("n_spans"),
                        e["label"].alias("label"), (e["end"] - e["start"]).alias("best_len"))

    def step(acc, e):
        cur = acc["cur"]
        longer = (e["end"] - e["start"]) > cur["best_len"]
        grown = F.struct(cur["start"].alias("start"), F.greatest(cur["end"], e["end"]).alias("end"),
                         (cur["n_spans"] + 1).alias("n_spans"),
                         F.when(longer, e["label"]).otherwise(cur["label"]).alias("label"),
                         F.when(longer, e["end"] - e["start"]).otherwise(cur["best_len"]).alias("best_len"))
        joins = cur.isNotNull() & (e["start"] < cur["end"])
        done = F.when(joins | cur.isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(cur)))
        return F.struct(done.alias("done"), F.when(joins, grown).otherwise(fresh(e)).alias("cur"))

    init = F.struct(F.array().cast(f"array<{ISLAND_STRUCT}>").alias("done"),
                    F.lit(None).cast(ISLAND_STRUCT).alias("cur"))
    out = F.aggregate(ordered, init, step,
                      lambda acc: F.when(acc["cur"].isNull(), acc["done"])
                      .otherwise(F.concat(acc["done"], F.array(acc["cur"]))))
    return F.transform(out, lambda i: F.struct(i["start"].alias("start"), i["end"].alias("end"),
                                               i["n_spans"].alias("n_spans"), i["label"].alias("label")))


def entity_relations(docs: DataFrame, key: str, text: str, entity_pattern: str = r"^[A-Z][a-z]+$") -> DataFrame:
    """Entity pairs of one sentence with verbs between them.

    Per sentence (row-local, no join): entity tokens match ``entity_pattern``,
    verbs come from the part-of-speech tags (N4).  A pair (e1, e2), e1 before
    e2, is kept when at least one verb lies strictly between them; the
    relation is those verbs joined by a blank.  Work is bounded by the
    sentence, never by the corpus or the document.
    """
    from quill.functions.text import sentences, word_tokens
    from quill.operators.features import pos_tags

    s = unnest(docs, sentences(F.col(text)), "sentence", key, pos="sent_no")

    def rel(tg):
        n = F.size(tg)
        idx = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

        def with_lists(ents, verbs):
            def pairs_of(a):
                between = lambda b: F.filter(verbs, lambda v: (v > a) & (v < b))
                keep = F.filter(ents, lambda b: (b > a) & F.exists(verbs, lambda v: (v > a) & (v < b)))
                return F.transform(keep, lambda b: F.struct(
                    a.cast("bigint").alias("p1"), b.cast("bigint").alias("p2"),
                    F.get(tg, a)["token"].alias("entity1"), F.get(tg, b)["token"].alias("entity2"),
                    F.array_join(F.transform(between(b), lambda v: F.get(tg, v)["token"]), " ").alias("relation")))
            return F.flatten(F.transform(ents, pairs_of))

        def with_idx(ix):
            # bind the entity and verb position lists once per sentence
            return let(F.filter(ix, lambda i: F.get(tg, i)["token"].rlike(entity_pattern)), lambda ents: let(
                F.filter(ix, lambda i: F.get(tg, i)["pos"] == "VERB"), lambda verbs: with_lists(ents, verbs)))
        return let(idx, with_idx)

    rels = let(pos_tags(word_tokens(F.col("sentence"))), rel)
    return (unnest(s, rels, "r", key, F.col("sent_no").cast("bigint").alias("sent_no"))
            .select(key, "sent_no", "r.*"))


def extract_gazetteer(docs: DataFrame, key: str, text: str, gazetteer: DataFrame, **how) -> DataFrame:
    """N1 (b): dictionary entities: leftmost-longest phrases of a (phrase, label) table, of any number of words.

    Long form (key, text, label, type, start, end); a phrase of several labels is a row for each.
    """
    from quill.operators.phrases import match
    m = match(docs, key, text, gazetteer, **how)
    return m.withColumn("label", F.explode("labels")).select(
        key, "text", "label", entity_type(F.col("label")).alias("type"), "start", "end")


def extract_with_model(df: DataFrame, text: str, model_factory, out: str = "entities") -> DataFrame:
    """N1 (c): a user NER model over Arrow batches; it returns, per text, a list of
    (text, label, start, end, score) tuples.  The factory runs once per Python worker."""
    import pandas as pd
    from pyspark.sql import types as T

    from quill.operators.sentiment import cached_model

    schema = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("label", T.StringType()),
                                       T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                                       T.StructField("score", T.DoubleType())]))

    @F.pandas_udf(schema)
    def _ner(texts: pd.Series) -> pd.Series:
        model = cached_model(model_factory)
        return pd.Series([[dict(zip(("text", "label", "start", "end", "score"), e)) for e in ents]
                          for ents in model(texts.fillna("").tolist())])

    raw = df.withColumn("_ner", _ner(F.col(text)))
    return raw.withColumn(out, F.transform("_ner", lambda e: F.struct(
        e["text"].alias("text"), e["label"].alias("label"), entity_type(e["label"]).alias("type"),
        e["start"].alias("start"), e["end"].alias("end"), e["score"].alias("score")))).drop("_ner")
