"""What is learned from a corpus: languages, abbreviations, the sentiment scorer, trials fitted together."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quill.operators import bayes as nb
from quill.operators import language as la
from quill.operators import multifit as mf
from quill.operators import sentences as sn
from quill.operators import train as tr

SF = "/root/testdata/sf0.01"


# --- T9 -------------------------------------------------------------------------------------

def plain_language(train, texts, smoothing=la.SMOOTHING):
    import regex

    def grams(t):
        return [f" {w} "[i:i + 3] for w in regex.findall(r"\p{L}+", (t or "").lower()) for i in range(len(w))]
    counts, docs = defaultdict(Counter), Counter()
    for t, x in train:
        if x is not None and t is not None:
            counts[x].update(grams(t))
            docs[x] += 1
    vocab = set().union(*counts.values())
    out = []
    for t in texts:
        g = grams(t)
        score = {x: math.log(docs[x] / sum(docs.values())) + sum(
            math.log((counts[x][w] + smoothing) / (sum(counts[x].values()) + smoothing * (len(vocab) + 1))) for w in g) for x in counts}
        out.append(max(sorted(score), key=score.get) if g else None)
    return out


def test_language_equals_a_plain_model(spark):
    rng = random.Random(2)
    words = {"en": ["the", "and", "with", "house"], "de": ["der", "und", "mit", "haus"], "xx": ["ö漢", "字ß", "the"]}
    train = [(" ".join(rng.choice(words[x]) for _ in range(6)), x) for x in rng.choices(list(words), k=60)] + [(None, "en"), ("the", None)]
    texts = ["the house", "DER HAUS 12", "", None, "123 !!", "字", "und the", "house" * 20_000, "zzz"]
    model = la.train(spark.createDataFrame(train, "text string, lang string").repartition(3), "text", "lang")
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(2)
    got = {r.id: r.detected for r in la.detect(df, "id", "text", model).collect()}
    assert [got[i] for i in range(len(texts))] == plain_language(train, texts)
    assert got[2] is None and got[4] is None


def test_language_beats_stop_words_on_held_out_texts(spark):
    from quill.functions.text import default_stopwords
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    held = la.held_out(F.col("doc_id"))
    model = la.train(docs.filter(~held), "text", "lang")
    rows = docs.filter(held).join(la.detect(docs.filter(held), "doc_id", "text", model), "doc_id").collect()
    lists = {"de": "german", "en": "english", "es": "spanish", "fr": "french"}
    stop = {x: set(default_stopwords(n)) for x, n in lists.items()}

    def by_stop_words(t):
        n = {x: sum(w in s for w in t.lower().split()) for x, s in stop.items()}
        return max(sorted(n), key=n.get) if any(n.values()) else None
    right = np.mean([r.detected == r.lang for r in rows])
    assert right >= 0.97 and right >= np.mean([by_stop_words(r.text) == r.lang for r in rows])


def test_language_without_training_texts(spark):
    empty = spark.createDataFrame([], "id long, text string, lang string")
    model = la.train(empty, "text", "lang")
    got = la.detect(spark.createDataFrame([(1, "some text")], "id long, text string"), "id", "text", model).collect()
    assert [r.detected for r in got] == [None]


# --- T3 -------------------------------------------------------------------------------------

def test_abbreviations_are_learned_and_do_not_end_sentences(spark):
    rng = random.Random(1)
    names = [a + b for a in ("Sm", "J", "Br", "Cl", "W") for b in ("ith", "ones", "own", "ark", "ood")]
    filler = ["walks", "home", "today", "because", "nothing", "happens", "there", "often"]
    texts = []
    for _ in range(200):
        a = rng.choice(["Mr.", "Dr.", "e.g.", "Mrs."])
        texts.append(f"{a} {rng.choice(names)} {' '.join(rng.sample(filler, 4))}. Then he {' '.join(rng.sample(filler, 3))}.")
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    found = {r.word for r in sn.learn_abbreviations(df, "text", min_count=5).collect()}
    assert found == {"mr", "dr", "e.g", "mrs"}

    def split(t):
        return spark.createDataFrame([(t,)], "t string").select(sn.split_sentences(F.col("t"), found).alias("s")).first().s
    assert split("Mr. Smith went. He met Dr. Wood!  Was it e.g.  today? Yes. ") == [
        "Mr. Smith went.", "He met Dr. Wood!", "Was it e.g.  today?", "Yes.", ""]
    assert split("A farmr. Next") == ["A farmr.", "Next"] and split("Mr.") == ["Mr."]
    assert split("") == [""] and split(None) == [""] and split("MR. X. mr! Y") == ["MR. X.", "mr!", "Y"]
    assert spark.createDataFrame([("Mr. A. B",)], "t string").select(sn.split_sentences(F.col("t"), []).alias("s")).first().s == [
        "Mr.", "A.", "B"]


def test_abbreviation_scores_follow_the_formula(spark):
    texts = ["Mr. a b. Mr. c", "mr d. etc. etc of", "U.S. and u.s. x"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.word: r for r in sn.abbreviation_scores(df, "text").collect()}
    n, k = Counter(), Counter()
    import regex
    for t in texts:
        for m in regex.finditer(r"(?<![\p{L}\p{N}])\p{L}+(?:\.\p{L}+)*+\.?", t):
            w = m.group().lower().rstrip(".")
            n[w] += 1
            k[w] += m.group().endswith(".")
    p = sum(k.values()) / sum(n.values())
    assert set(got) == {w for w in n if k[w]}
    for w, r in got.items():
        letters = len(w.replace(".", ""))
        null = k[w] * math.log(p) + (n[w] - k[w]) * math.log(1 - p)
        alt = k[w] * math.log(0.99) + (n[w] - k[w]) * math.log(0.01)
        want = -2 * (null - alt) * math.exp(-letters) * (w.count(".") + 1) * letters ** -(n[w] - k[w])
        assert (r.n, r.n_period) == (n[w], k[w]) and r.score == pytest.approx(want)


# --- M1 -------------------------------------------------------------------------------------

def test_trained_scorer_equals_a_plain_model_and_generalises(spark):
    rng = random.Random(3)
    words = {0: ["bad", "awful", "the"], 1: ["table", "row", "the"], 2: ["good", "great", "the"]}
    rows = [(y, " ".join(rng.choice(words[y]) for _ in range(8))) for y in rng.choices([0, 1, 2], k=150)]
    df = spark.createDataFrame([*rows, (None, "good"), (7, "x"), (1, None)], "label int, text string").repartition(4)
    model = nb.train(df)
    counts = {y: Counter() for y in words}
    docs = Counter()
    for y, t in [*rows, (1, "")]:
        counts[y].update(t.split())
        docs[y] += 1
    vocab = set().union(*counts.values())
    texts = ["good good awful", "", None, "unknown words only", "the row"]
    for t, got in zip(texts, model.probabilities(texts), strict=True):
        own = (t or "").split()
        x = [math.log((docs[y] + 1) / (sum(docs.values()) + 3)) + sum(
            math.log((counts[y][w] + 1) / (sum(counts[y].values()) + len(vocab) + 1)) for w in own) / math.sqrt(max(1, len(own))) for y in words]
        e = np.exp(np.array(x) - max(x))
        assert got == pytest.approx(e / e.sum())
    fresh = [(y, " ".join(rng.choice(words[y]) for _ in range(8))) for y in rng.choices([0, 1, 2], k=60)]
    probs = model.probabilities([t for _, t in fresh])
    assert np.mean(probs.argmax(axis=1) == [y for y, _ in fresh]) > 0.9


# --- E15, E16 ---------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def sets(spark):
    rng = random.Random(5)
    words = {0: ["alpha", "beta", "gamma", "noise", "shared"], 1: ["delta", "epsilon", "gamma", "noise", "shared"]}
    rows = [(" ".join(rng.choice(words[y if rng.random() < 0.8 else 1 - y]) for _ in range(6)), y) for y in rng.choices([0, 1], k=400)]
    df = spark.createDataFrame(rows, "text string, label int").repartition(3)
    return df.limit(300).cache(), spark.createDataFrame(rows[300:], "text string, label int").repartition(2)


def test_trials_together_equal_single_fits(spark, sets):
    train, valid = sets
    trials = tr.Trials(train, valid)
    settings = [{"reg_param": r, "max_iter": 100, "num_features": 256} for r in (0.001, 0.01, 0.1, 0.5)]
    together = trials.scores(settings)
    single = [trials.score(s) for s in settings]
    assert together == pytest.approx(single, abs=1e-3)
    fitted = mf.Fits(mf.sparse_rows(trials.features(256)[0]), [s["reg_param"] for s in settings], [100] * 4)
    for k, s in enumerate(settings):
        model = tr.classifier(reg_param=s["reg_param"], max_iter=100).fit(trials.features(256)[0])
        used = np.flatnonzero(fitted.scale.column >= 0)
        # the penalised loss at Spark's solution is no lower than at this one
        theirs = fitted.weights.copy()
        theirs[k] = [*(model.coefficients.toArray()[used] / fitted.scale.inverse), model.intercept]
        one = np.array([k])
        assert fitted.losses(fitted.weights, one)[0][0] <= fitted.losses(theirs, one)[0][0] + 1e-4


def test_passes_do_not_grow_with_the_trials(spark, sets):
    rows = mf.sparse_rows(tr.Trials(*sets).features(256)[0])
    one = mf.Fits(rows, [0.01], [30])
    many = mf.Fits(rows, [0.01 + 0.01 * i for i in range(20)], [30] * 20)
    assert many.passes <= 2 * one.passes and many.weights.shape[0] == 20


def test_packed_rows_are_the_sparse_rows(spark):
    rows = spark.createDataFrame([([0, 3, 5], [1.0, 2.0, 4.0], 1.0), ([], [], 0.0), ([3], [6.0], 0.0), ([5], [1.0], 1.0), ([], [], 1.0)],
                                 "at array<int>, x array<double>, label double").coalesce(1)
    scale = mf.Scale(np.array([-1, -1, -1, 0, -1, 1]), np.array([0.5, 0.25]))
    table = mf.packed(rows, scale).toArrow().combine_chunks()
    for b in (table.to_batches()[0], table.slice(1).to_batches()[0], table.slice(4).to_batches()[0]):
        (row, col, val, label), = mf._unpacked(b)
        first = 5 - b.num_rows
        want = [(r - first, c, v) for r, c, v in ((0, 0, 1.0), (0, 1, 1.0), (2, 0, 3.0), (3, 1, 0.25)) if r >= first]
        assert [*zip(row.tolist(), col.tolist(), val.tolist(), strict=True)] == want
        assert label.tolist() == [1.0, 0.0, 0.0, 1.0, 1.0][first:]


def test_a_pass_has_as_many_tasks_whatever_the_rows(spark, sets):
    rows = mf.sparse_rows(tr.Trials(*sets).features(256)[0]).repartition(40)
    fits = mf.Fits(mf.staged(rows, "many-files"), [0.1], [3])
    assert fits.rows.rdd.getNumPartitions() <= max(8, spark.sparkContext.defaultParallelism)


def test_texts_are_cut_into_words_once(spark, sets):
    for f in tr.Trials(*sets).features(256):
        assert "term-counts" in "".join(f.inputFiles())


def test_odd_trials(spark, sets):
    train, valid = sets
    trials = tr.Trials(train, valid)
    bad = trials.scores([{"reg_param": -1.0}, {"no_such": 1}, {"reg_param": 0.1, "num_features": 64}, {"elastic_net": 0.5, "reg_param": 0.01}])
    assert bad[0] == -1 and bad[1] == -1 and bad[2] > 0.5 and bad[3] > 0.5
    three = train.withColumn("label", F.when(F.col("text").contains("gamma"), 2).otherwise(F.col("label")))
    assert 0 < tr.grid_search(spark, three, three, {"reg_param": [0.1], "max_iter": [10]}).first().score <= 1
    same = tr.random_search(spark, train, valid, {"reg_param": (0.0, 0.1)}, n_trials=3, seed=1).collect()
    assert same == tr.random_search(spark, train, valid, {"reg_param": (0.0, 0.1)}, n_trials=3, seed=1).collect()
