"""Training-data preparation: stratified split, augmentation, dataset info.

Randomness is replaced by hashes of (seed, id) so results are reproducible
on any cluster layout and checkable by an independent engine.  Ranks inside
a label use the distributed prefix sums of :mod:`quill.operators.stats`,
so a label holding most of the rows is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quill.functions import text as tx
from quill.functions.text import let
from quill.operators.stats import running_sums


def hash_key(seed: int, key: Column, salt: str = "") -> Column:
    """Hex md5 of ``seed-key[-salt]``: a portable, well-mixed sort key."""
    parts = [F.lit(str(seed)), F.lit("-"), key.cast("string")]
    if salt:
        parts += [F.lit("-"), F.lit(salt)]
    return F.md5(F.concat(*parts))


def hash_int(seed: int, key: Column, salt: str = "") -> Column:
    """First 32 bits of :func:`hash_key` as a non-negative bigint."""
    return F.conv(F.substring(hash_key(seed, key, salt), 1, 8), 16, 10).cast("bigint")


def stratified_split(df: DataFrame, label: str, key: str, train: float = 0.8, val: float = 0.1,
                     test: float = 0.1, seed: int = 42) -> DataFrame:
    """Per label, rows ranked by hash get quotas floor(n*train), floor(n*val), rest test."""
    if abs(train + val + test - 1.0) > 1e-7:
        raise ValueError("Split sizes must sum to 1.0")
    place = F.struct(hash_key(seed, F.col(key)).alias("h"), F.col(key).alias("k"))
    # only (label, hash, id) are ranked; the rows themselves are compared with their label's last places
    keyed = df.select(label, hash_key(seed, F.col(key)).alias("_h"), F.col(key).alias("_k"), F.lit(1).alias("_one"))
    ranked = running_sums(keyed, [label], [F.col("_h"), F.col("_k")], ["_one"])
    n = ranked.groupBy(label).agg(F.max("cum__one").alias("_n"))
    n_train, n_val = F.floor(F.col("_n") * F.lit(train)), F.floor(F.col("_n") * F.lit(val))
    at, cum = F.struct(F.col("_h").alias("h"), F.col("_k").alias("k")), F.col("cum__one")
    ends = ranked.join(n, label).groupBy(label).agg(
        F.max(F.when(cum <= n_train, at)).alias("_train"), F.max(F.when(cum <= n_train + n_val, at)).alias("_val"))
    split = F.when(place <= F.col("_train"), "train").when(place <= F.col("_val"), "validation").otherwise("test")
    return df.join(ends, label).withColumn("split", split).drop("_train", "_val")


# --- augmentation (E2) --------------------------------------------------------
def _words(text: Column) -> Column:
    return tx.words(F.coalesce(text, F.lit("")))


def augment_swap(text: Column, key: Column, seed: int = 42) -> Column:
    """Swap the words at two hash-chosen positions."""
    hi, hj = hash_int(seed, key, "swap-i"), hash_int(seed, key, "swap-j")

    def run(w):
        n = F.greatest(F.size(w), F.lit(1))
        i, j = F.pmod(hi, n).cast("int"), F.pmod(hj, n).cast("int")
        return F.array_join(F.transform(w, lambda x, k: F.when(k == i, F.get(w, j))
                                        .when(k == j, F.get(w, i)).otherwise(x)), " ")
    return let(_words(text), run)


def augment_delete(text: Column, key: Column, seed: int = 42) -> Column:
    """Delete the word at a hash-chosen position (texts of one word are kept)."""
    h = hash_int(seed, key, "del")

    def run(w):
        n = F.size(w)
        i = F.pmod(h, F.greatest(n, F.lit(1))).cast("int")
        return F.array_join(F.filter(w, lambda x, k: (k != i) | (n <= 1)), " ")
    return let(_words(text), run)


def augment_insert(text: Column, key: Column, seed: int = 42) -> Column:
    """Insert a copy of a hash-chosen word before another hash-chosen position."""
    hs, hd = hash_int(seed, key, "ins-src"), hash_int(seed, key, "ins-dst")

    def run(w):
        n = F.size(w)
        src = F.pmod(hs, F.greatest(n, F.lit(1))).cast("int")
        dst = F.pmod(hd, F.greatest(n, F.lit(1))).cast("int")
        out = F.when(n == 0, w).otherwise(
            F.concat(F.slice(w, 1, dst), F.array(F.get(w, src)), F.slice(w, dst + 1, n)))
        return F.array_join(out, " ")
    return let(_words(text), run)


def augment_synonym(text: Column, synonyms: dict[str, str], max_replace: int = 3) -> Column:
    """Replace the first ``max_replace`` words that have an entry in ``synonyms``."""
    m = F.create_map(*[F.lit(x) for kv in sorted(synonyms.items()) for x in kv])

    def run(w):
        hits = F.filter(F.transform(w, lambda x, k: F.when(x.isin(*synonyms.keys()), k)), lambda k: k.isNotNull())

        def apply(chosen):
            return F.array_join(F.transform(w, lambda x, k: F.when(F.array_contains(chosen, k), F.element_at(m, x))
                                            .otherwise(x)), " ")
        return let(F.slice(hits, 1, max_replace), apply)
    return let(_words(text), run)


def augment_dataset(df: DataFrame, text: str, label: str, key: str, factor: float = 0.5, seed: int = 42,
                    synonyms: dict[str, str] | None = None) -> DataFrame:
    """Augment the first floor(n*factor) rows in hash order, one op each, keep changed texts.

    Output = input rows (``augmented`` false) + changed augmented rows.
    """
    synonyms = synonyms or {}
    # only (hash, id) are ranked, to find the last place within the quota; texts are compared with it
    keyed = df.select(hash_key(seed, F.col(key), "pick").alias("_h"), F.col(key).alias("_k"), F.lit(1).alias("_one"))
    ranked = running_sums(keyed, [], [F.col("_h"), F.col("_k")], ["_one"])
    quota = ranked.select(F.floor(F.max("cum__one") * F.lit(factor))).scalar()
    last = ranked.filter(F.col("cum__one") <= quota).select(F.max(F.struct(F.col("_h").alias("h"), F.col("_k").alias("k")))).scalar()
    picked = df.filter(F.struct(hash_key(seed, F.col(key), "pick").alias("h"), F.col(key).alias("k")) <= last)
    n_ops = 4 if synonyms else 3
    op = F.pmod(hash_int(seed, F.col(key), "op"), F.lit(n_ops))
    k, t = F.col(key), F.col(text)
    aug = (F.when(op == 0, augment_swap(t, k, seed)).when(op == 1, augment_delete(t, k, seed))
           .when(op == 2, augment_insert(t, k, seed)))
    if synonyms:
        aug = aug.when(op == 3, augment_synonym(t, synonyms))
    changed = (picked.select(key, label, aug.alias("_aug"), F.col(text).alias("_orig"))
               .filter(F.col("_aug") != F.col("_orig"))
               .select(key, label, F.col("_aug").alias(text), F.lit(True).alias("augmented")))
    return df.select(key, label, text, F.lit(False).alias("augmented")).unionByName(changed)


def dataset_info(splits: DataFrame, label: str = "label", split: str = "split") -> DataFrame:
    """Rows per split and label, with cube totals (NULL = all)."""
    return splits.cube(split, label).agg(F.count("*").cast("bigint").alias("n"))
