"""Text features (F1-F12) and token-id encoding.

Vocabularies are bounded by a parameter (``max_features``, ``vocab_size``) but
may be large, so whether they are broadcast is left to Spark's size rule.
Per-document work (pooling, id encoding) stays row-local where possible.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quill.functions import text as tx
from quill.operators import grams as gr

# Word tokens of two or more word characters (the vectorizer default rule).
TERM_PATTERN = r"[\p{L}\p{N}_]{2,}"
# Vectors in a task that pools (64 components: 32 MB).
SHARD_VECTORS = 1 << 17
# Reserved ids of the special tokens.
SPECIAL_TOKENS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]"]


def terms(text: Column) -> Column:
    """Lower-cased terms of >= 2 word characters."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TERM_PATTERN), 0), F.lower)


def term_rows(docs: DataFrame, key: str, text: str, ngram_range: tuple[int, int] = (1, 1)) -> DataFrame:
    """(key, term) rows of the n-grams of the terms, n in the closed ``ngram_range``.

    The texts are dealt out by key, so whatever groups the rows by key or by
    (key, term) moves none of them.
    """
    t = terms(F.col(text))
    if ngram_range != (1, 1):
        t = tx.ngrams(t, *ngram_range)
    return tx.unnest(docs.select(key, text).repartition(key), t, "term", key)


def term_counts(rows: DataFrame, key: str) -> DataFrame:
    """(key, term, tf): term frequency per document."""
    return rows.groupBy(key, "term").agg(F.count("*").alias("tf"))


def term_stats(tf: DataFrame) -> DataFrame:
    """(term, cnt, df) from per-document counts: one aggregation, no distinct-count expansion."""
    return tf.groupBy("term").agg(F.sum("tf").alias("cnt"), F.count("*").alias("df"))


def df_bound(bound: int | float, n_docs: Column) -> Column:
    """A document-frequency bound: an int is a number of documents, a float a share of them."""
    return F.lit(bound) if isinstance(bound, int) else F.lit(bound) * n_docs


def kept_terms(tf: DataFrame, n_docs: Column, max_features: int | None, min_df: int | float = 1,
               max_df: int | float = 1.0) -> DataFrame:
    """(term, cnt, df) within the frequency bounds, the top ``max_features`` by corpus count."""
    return top_terms(term_stats(tf), n_docs, max_features, min_df, max_df)


def top_terms(stats: DataFrame, n_docs: Column, max_features: int | None, min_df: int | float = 1,
              max_df: int | float = 1.0) -> DataFrame:
    """The rows of (term, cnt, df) within the frequency bounds, the top ``max_features`` by corpus count."""
    df = F.col("df")
    stats = stats.filter((df >= df_bound(min_df, n_docs)) & (df <= df_bound(max_df, n_docs)))
    return stats.orderBy(F.desc("cnt"), F.asc("term")).limit(max_features) if max_features else stats


def vocabulary(docs: DataFrame, key: str, text: str, max_features: int | None = None, min_df: int | float = 1,
               max_df: int | float = 1.0, ngram_range: tuple[int, int] = (1, 1)) -> DataFrame:
    """The kept terms with their counts."""
    tf = term_counts(term_rows(docs, key, text, ngram_range), key)
    v = kept_terms(tf, docs.select(F.count("*")).scalar(), max_features, min_df, max_df)
    return v.select("term", F.col("cnt").cast("bigint").alias("cnt"), F.col("df").cast("bigint").alias("df"))


def count_vector(docs: DataFrame, key: str, text: str, max_features: int = 10000, min_df: int | float = 1,
                 binary: bool = False, ngram_range: tuple[int, int] = (1, 1)) -> DataFrame:
    """long-form bag of words (key, term, count) over the kept vocabulary."""
    tf = term_counts(term_rows(docs, key, text, ngram_range), key)
    vocab = kept_terms(tf, docs.select(F.count("*")).scalar(), max_features, min_df).select("term")
    count = F.lit(1) if binary else F.col("tf")
    return tf.join(vocab, "term").select(key, "term", count.cast("bigint").alias("count"))


def _idf(n_docs: Column, use_idf: bool) -> Column:
    """Smooth idf = ln((1+N)/(1+df)) + 1, or 1."""
    return (F.log((1 + n_docs) / (1 + F.col("df"))) + 1 if use_idf else F.lit(1.0)).alias("idf")


def tfidf_fit(docs: DataFrame, key: str, text: str, max_features: int = 10000, min_df: int | float = 1,
              max_df: int | float = 1.0, ngram_range: tuple[int, int] = (1, 1), use_idf: bool = True) -> DataFrame:
    """F2/F3 fit: vocabulary with idf (a small table to save)."""
    n_docs = docs.select(F.count("*")).scalar()
    tf = term_counts(term_rows(docs, key, text, ngram_range), key)
    return kept_terms(tf, n_docs, max_features, min_df, max_df).select("term", _idf(n_docs, use_idf))


def tfidf_transform(docs: DataFrame, key: str, text: str, model: DataFrame, sublinear_tf: bool = True,
                    ngram_range: tuple[int, int] = (1, 1), norm: str | None = "l2") -> DataFrame:
    """F2/F3 transform: (key, term, weight), normalised per document; unknown terms ignored."""
    tf = term_counts(term_rows(docs, key, text, ngram_range), key)
    return _weights(tf.join(model.select("term", "idf"), "term"), key, sublinear_tf, norm)


def tfidf(docs: DataFrame, key: str, text: str, max_features: int = 10000, min_df: int | float = 1,
          max_df: int | float = 1.0, sublinear_tf: bool = True, ngram_range: tuple[int, int] = (1, 1),
          use_idf: bool = True, norm: str | None = "l2") -> DataFrame:
    """F2 fit + transform on the same corpus.

    No row is made of a term of a text: tasks count the n-grams of their texts by numpy and hand on
    the counts, then weigh those of the kept terms.  A vocabulary too large to be sent to the tasks is joined.
    """
    n_docs = docs.select(F.count("*")).scalar()
    if not max_features or max_features > gr.SENT_TERMS:
        tf = term_counts(term_rows(docs, key, text, ngram_range), key)
        model = kept_terms(tf, n_docs, max_features, min_df, max_df).select("term", _idf(n_docs, use_idf))
        return _weights(tf.join(model, "term"), key, sublinear_tf, norm)
    texts = gr.keyed_texts(docs, key, text, terms)
    stats = _gram_stats(texts, n_docs, max_features, min_df, max_df, ngram_range)
    top = top_terms(stats, n_docs, max_features, min_df, max_df).select("term", _idf(n_docs, use_idf)).collect()
    return gr.gram_weights(texts, key, {r["term"]: r["idf"] for r in top}, *ngram_range, sublinear_tf, norm)


def _gram_stats(texts: DataFrame, n_docs: Column, max_features: int, min_df: int | float, max_df: int | float,
                ngram_range: tuple[int, int]) -> DataFrame:
    """(term, cnt, df) of all n-grams that may be kept.

    An n-gram comes no more often, and with no more keys, than each of its words.  So the words are
    counted first: longer n-grams with a word below ``min_df``, or one that is rarer than the last of
    ``max_features`` kept words, cannot be kept and are not counted.
    """
    from quill.session import staged
    lo, hi = ngram_range
    if hi == 1:
        return gr.gram_stats(texts, lo, hi)
    words = staged(gr.gram_stats(texts, 1, 1), "word-stats")
    least = 1
    if lo == 1:
        full = top_terms(words, n_docs, max_features, min_df, max_df).agg(F.count("*").alias("n"), F.min("cnt").alias("least")).first()
        least = full["least"] if full["n"] == max_features else 1
    rest = words.filter((F.col("df") >= df_bound(min_df, n_docs)) & (F.col("cnt") >= least)).select("term").limit(gr.SENT_TERMS + 1)
    some = [r["term"] for r in rest.collect()]
    longer = gr.gram_stats(texts, max(lo, 2), hi, some if len(some) <= gr.SENT_TERMS else None)
    return words.unionByName(longer) if lo == 1 else longer


def _weights(tf: DataFrame, key: str, sublinear_tf: bool, norm: str | None) -> DataFrame:
    w = (1 + F.log("tf") if sublinear_tf else F.col("tf").cast("double")) * F.col("idf")
    tw = tf.withColumn("w", w)
    per = Window.partitionBy(key)
    if norm == "l2":
        tw = tw.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(per)))
    elif norm == "l1":
        tw = tw.withColumn("w", F.col("w") / F.sum(F.abs("w")).over(per))
    elif norm is not None:
        raise ValueError(f"norm {norm!r}: l1, l2 or None")
    return tw.select(key, "term", F.col("w").alias("weight"))


# --- topics (F5, F6) -----------------------------------------------------------------
def lda_topics(docs: DataFrame, key: str, text: str, k: int = 50, max_features: int = 10000, seed: int = 42,
               max_iter: int = 10, language: str = "english"):
    """document-topic distributions with Spark ML LDA; returns (doc_topics, topic_words)."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer, StopWordsRemover
    from pyspark.ml.functions import vector_to_array

    from quill.session import cut_lineage

    toks = docs.select(key, terms(F.col(text)).alias("toks"))
    sw = StopWordsRemover(inputCol="toks", outputCol="kept", stopWords=list(tx.default_stopwords(language)))
    kept = sw.transform(toks)
    cv = CountVectorizer(inputCol="kept", outputCol="features", vocabSize=max_features).fit(kept)
    feats = cv.transform(kept)
    # every iteration samples the counts: worked out of the texts once, in the same partitions
    counts = cut_lineage(feats.select("features"))
    model = LDA(k=k, seed=seed, maxIter=max_iter, optimizer="online").fit(counts)
    # a document with no vocabulary term gets the prior's uniform distribution (rows sum to 1)
    arr = vector_to_array("topicDistribution")
    uniform = F.array_repeat(F.lit(1.0 / k), k)
    arr = F.when(F.aggregate(arr, F.lit(0.0), lambda a, x: a + x) > 0, arr).otherwise(uniform)
    dist = tx.unnest(model.transform(feats), arr, "weight", key, pos="topic")
    topics = model.describeTopics(10)
    vocab = docs.sparkSession.createDataFrame(list(enumerate(cv.vocabulary)), "term int, word string")
    words = topics.select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "t")).select(
        "topic", "rank", F.col("t.termIndices").alias("term"), F.col("t.termWeights").alias("weight"))
    return dist, words.join(vocab, "term").select("topic", "rank", "word", "weight")


# --- embeddings (F7, F8, F10-F12) ---------------------------------------------------------------
def word_vectors_from_counts(docs: DataFrame, text: str, vectors: DataFrame) -> DataFrame:
    """(word, vec): lowercase words by frequency, mapped to the vector row ``vec_id = rank - 1`` while there are rows.

    Words are ranked by distributed running sums, so neither side is bounded.
    """
    from quill.operators.stats import running_sums
    words = gr.word_counts(docs, terms(F.col(text)))
    ranked = running_sums(words.withColumn("one", F.lit(1)), [], [F.desc("c"), F.asc("word")], ["one"])
    ranked = ranked.select("word", (F.col("cum_one") - 1).alias("vec_id"))
    return ranked.join(vectors.select("vec_id", F.col("embedding").alias("vec")), "vec_id").select("word", "vec")


def _pooled(docs: DataFrame, key: str, text: str, wv: DataFrame, dim: int, how: str, oov: bool, first: bool = False) -> DataFrame:
    """(key, dim, value): mean, max or sum of the word vectors of the texts' terms, zeros without any.

    No vector is copied to the words of the texts, and no row is made of a word: vectors are
    dealt by word into shards of at most about ``SHARD_VECTORS``, documents into blocks, and a
    task of one shard and one block adds up what the shard gives to each of its documents, which
    come with their words packed.  With ``oov`` a word without a vector counts as zeros.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    from quill.session import staged
    wv = staged(wv.filter("vec IS NOT NULL AND word IS NOT NULL").select("word", "vec"), "word-vectors")
    shards = max(1, -(-wv.count() // SHARD_VECTORS))
    blocks = -(-2 * docs.sparkSession.sparkContext.defaultParallelism // shards)
    packed = gr.packed_words(docs, key, terms(F.col(text)), shards, first)
    cell = F.col("shard") * blocks
    rows = packed.select((cell + F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")).alias("cell"), "key", "words", "n")
    copies = wv.select("word", "vec", gr.shard_of("word", shards).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    vectors = copies.select((cell + F.col("block")).alias("cell"), F.col("word").alias("words"), "vec")
    rows = rows.unionByName(vectors, allowMissingColumns=True).select("cell", "key", "words", "n", "vec")
    rows = rows.repartitionById(shards * blocks, F.col("cell")).sortWithinPartitions("cell", F.col("n").isNotNull())
    parts = rows.mapInArrow(gr.folded(dim, how, oov), f"key {docs.schema[key].dataType.simpleString()}, n long, part array<double>")
    fold = Summarizer.max if how == "max" else Summarizer.sum
    vals = parts.groupBy(F.col("key").alias(key)).agg(vector_to_array(fold(array_to_vector("part"))).alias("a"), F.sum("n").alias("n"))
    a = F.transform("a", lambda x: x / F.col("n")) if how == "mean" else F.col("a")
    zeros = F.array_repeat(F.lit(0.0), dim)
    return docs.select(key).join(vals, key, "left").select(key, F.posexplode(F.coalesce(a, zeros)).alias("dim", "value")).select(
        key, F.col("dim").cast("bigint").alias("dim"), "value")


def doc_vectors(docs: DataFrame, key: str, text: str, wv: DataFrame, dim: int, how: str = "mean") -> DataFrame:
    """mean / max / sum of the word vectors of a document's tokens (OOV skipped, empty -> zeros)."""
    return _pooled(docs, key, text, wv, dim, how, oov=False)


def pool_tokens(docs: DataFrame, key: str, text: str, wv: DataFrame, dim: int, how: str) -> DataFrame:
    """F8: pooling over a document's token embeddings (OOV tokens: zero vector, mask 0).

    cls = first token's vector; mean = sum(v * mask) / sum(mask); max over all
    tokens (mask ignored, as in the reference).
    """
    return _pooled(docs, key, text, wv, dim, "mean" if how == "mean" else "max", oov=how != "mean", first=how == "cls")


def embed_with_model(df: DataFrame, text: str, model_factory: Callable[[], Callable], dim: int,
                     out: str = "embedding") -> DataFrame:
    """a user embedding model over Arrow batches (factory runs once per Python worker)."""
    from quill.operators.sentiment import cached_model

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def _embed(texts: pd.Series) -> pd.Series:
        model = cached_model(model_factory)
        arr = np.asarray(model(texts.fillna("").tolist()), dtype=np.float32).reshape(len(texts), dim)
        return pd.Series(list(arr))

    return df.withColumn(out, _embed(F.col(text)))


def hashing_embedder(dim: int = 64) -> Callable[[list], np.ndarray]:
    """Fallback model: signed feature hashing of lower-cased words, L2-normalised."""
    import re
    import zlib

    word = re.compile(r"\w\w+")

    def embed(texts):
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, t in enumerate(texts):
            for w in word.findall(t.lower()):
                h = zlib.crc32(w.encode("utf-8"))
                out[i, h % dim] += 1.0 if (h >> 16) & 1 else -1.0
            nrm = np.linalg.norm(out[i])
            if nrm > 0:
                out[i] /= nrm
        return out
    return embed


def cosine_topk(vectors: DataFrame, key: str, vec: str, query: DataFrame, k: int = 10) -> DataFrame:
    """cosine similarity to one query vector (a one-row frame ``q``), top ``k`` (score desc, key).

    The single query vector is a bounded parameter: it is read once and
    inlined as a literal, so scoring is row-local (no join) and the top-k is
    a TakeOrdered.
    """
    from quill.functions.vectors import cosine, to_double_array
    row = query.select("q").head(2)
    if len(row) != 1:
        raise ValueError("the query must be one vector")
    q = F.array(*[F.lit(float(x)).cast("double") for x in row[0]["q"]])
    return (vectors.select(key, cosine(to_double_array(F.col(vec)), q).alias("score"))
            .orderBy(F.desc("score"), F.asc(key)).limit(k))


# --- token ids (T5-T7) ------------------------------------------------------------------------
def build_vocab(docs: DataFrame, text: str, vocab_size: int = 30000, min_frequency: int = 2) -> DataFrame:
    """(token, id, count); ids after the reserved special tokens, by count desc then token."""
    toks = tx.unnest(docs, terms(F.col(text)), "token")
    c = toks.groupBy("token").agg(F.count("*").cast("bigint").alias("count")).filter(F.col("count") >= min_frequency)
    top = c.orderBy(F.desc("count"), F.asc("token")).limit(max(vocab_size - len(SPECIAL_TOKENS), 0))
    ranked = top.withColumn("id", (F.row_number().over(Window.orderBy(F.desc("count"), F.asc("token")))
                                   + len(SPECIAL_TOKENS) - 1).cast("int"))
    return ranked.select("token", "id", "count")


def encode_ids(docs: DataFrame, key: str, text: str, vocab: DataFrame, max_length: int = 512) -> DataFrame:
    """T5: [CLS] ids [SEP], truncated to ``max_length``, padded with [PAD]; attention mask.

    Only the tokens that stay are exploded; they meet the vocabulary in a join
    (Spark map lookups are linear in the map) and are put together again in
    position order, at most ``max_length`` a document.
    """
    kept = F.slice(terms(F.col(text)), 1, max_length - 2)
    toks = tx.unnest(docs, kept, "token", key, pos="pos")
    ids = toks.join(vocab.select("token", "id"), "token", "left") \
              .withColumn("id", F.coalesce("id", F.lit(SPECIAL_TOKENS.index("[UNK]"))))
    seq = ids.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("s"))
    cls, sep = (F.array(F.lit(SPECIAL_TOKENS.index(x))) for x in ("[CLS]", "[SEP]"))
    base = docs.select(key).join(seq, key, "left").select(key, F.concat(
        cls, F.coalesce(F.transform("s", lambda x: x["id"]), F.array().cast("array<int>")), sep).alias("ids"))
    room = F.lit(max_length) - F.size("ids")
    return base.select(key, F.concat("ids", F.array_repeat(F.lit(SPECIAL_TOKENS.index("[PAD]")), room)).alias("input_ids"),
                       F.concat(F.array_repeat(F.lit(1), F.size("ids")), F.array_repeat(F.lit(0), room)).alias("attention_mask"))


def decode_ids(encoded: DataFrame, key: str, vocab: DataFrame) -> DataFrame:
    """Ids back to text, special tokens skipped."""
    ex = tx.unnest(encoded, "input_ids", "id", key, pos="pos").filter(F.col("id") >= len(SPECIAL_TOKENS))
    j = ex.join(vocab.select("token", "id"), "id")
    seq = j.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("s"))
    out = encoded.select(key).join(seq, key, "left")
    return out.select(key, F.coalesce(F.array_join(F.transform("s", lambda x: x["token"]), " "), F.lit("")).alias("text"))


# Parameter: coarse part-of-speech lexicon and suffix fallbacks.
POS_LEXICON = {"the": "DET", "a": "DET", "an": "DET", "and": "CCONJ", "or": "CCONJ", "of": "ADP", "to": "ADP",
               "in": "ADP", "on": "ADP", "with": "ADP", "is": "VERB", "are": "VERB", "was": "VERB", "be": "VERB",
               "it": "PRON", "this": "PRON", "that": "PRON"}


def pos_tags(tokens: Column) -> Column:
    """(token, pos) pairs: lexicon first, then suffix and shape rules."""
    lex = F.create_map(*[F.lit(x) for kv in sorted(POS_LEXICON.items()) for x in kv])

    def tag(t):
        lt = F.lower(t)
        rule = (F.when(t.rlike(r"^\p{N}+$"), "NUM").when(t.rlike(r"^[^\p{L}\p{N}]+$"), "PUNCT")
                .when(lt.endswith("ing") | lt.endswith("ed"), "VERB").when(lt.endswith("ly"), "ADV")
                .when(t.rlike(r"^\p{Lu}"), "PROPN").otherwise("NOUN"))
        return F.struct(t.alias("token"), F.coalesce(F.try_element_at(lex, lt), rule).alias("pos"))
    return F.transform(tokens, tag)
