"""Same or near-same records across splits (problem 2).

A record's canonical form is its words after look-alike characters, case, punctuation and white space are normalised.
Hashes of canonical records of the evaluation splits are joined with those of the training split.  Two hashes are taken:
of the words in their order (the same record) and of the set of words (a class of records).

A hash of the whole record cannot find records that differ in a word, so classes are also joined by hashes of canonical
parts: two sets whose Jaccard similarity reaches the threshold share at least two of the rarest words of either, in
prefixes whose length follows from the threshold, so joining on hashes of pairs of prefix words loses nothing; candidates
are verified on their whole word sets.  Words are 64-bit hashes from the first step on.  Word frequencies that order the
prefixes are counted over all classes in a fixed number of hash buckets.

Defined results: null and word-less texts match nothing; repeated rows count once; records without a split don't count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispark.cluster import checkpointed, spread_lookup
from lexispark.llm.charforms import words_of

THRESHOLD = 0.7
#: Word counts are kept in this many buckets (a broadcast of fixed size); collisions only change the prefix order.
BUCKETS = 1 << 16
_EPS = 1e-9


_CANONICAL = T.StructType(
    [T.StructField("class_id", T.StringType()), T.StructField("same_id", T.StringType()), T.StructField("words", T.ArrayType(T.LongType()))]
)


@F.pandas_udf(_CANONICAL)
def _canonical_udf(texts: pd.Series) -> pd.DataFrame:
    """Hash of the set of words, hash of the words in order, and the distinct words' own hashes."""
    sets, orders, hashes = [], [], []
    for text in texts:
        words = words_of(text)
        distinct = sorted(set(words))
        sets.append(xxhash.xxh3_128_hexdigest(" ".join(distinct)))
        orders.append(xxhash.xxh3_128_hexdigest(" ".join(words)))
        hashes.append([xxhash.xxh64_intdigest(w) - (1 << 63) for w in distinct])
    return pd.DataFrame({"class_id": sets, "same_id": orders, "words": hashes})


def _prefix_pairs(counts: np.ndarray, threshold: float):
    """Hashes of all pairs among the rarest words of each class, with the place of the later word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, roles = batch["id"].to_numpy(), batch["role"].to_numpy()
            lists = batch["words"]
            n = np.diff(lists.offsets.to_numpy())
            words = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(len(n)), n)
            # rarest first within a class, ties by hash
            order = np.lexsort((words, counts[words % BUCKETS], owner))
            words = words[order].view(np.uint64)
            first = np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else np.empty(0, np.int64)
            size = np.minimum(n - np.ceil(threshold * n - _EPS).astype(np.int64) + 2, n)
            out = []
            for k in np.unique(size[n >= 2]):
                rows = np.flatnonzero((size == k) & (n >= 2))
                block = words[first[rows][:, None] + np.arange(k)]
                for j in range(1, k):
                    for i in range(j):
                        key = (block[:, i] * np.uint64(0x9E3779B97F4A7C15) ^ block[:, j]) * np.uint64(0x100000001B3)
                        out.append((key ^ (key >> np.uint64(31)), rows, np.full(len(rows), j)))
            if out:
                key, rows, at = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(ids[rows]), pa.array(roles[rows], pa.int32()), pa.array(n[rows], pa.int32()), pa.array(at, pa.int32())],
                    names=["pair_key", "id", "role", "n", "at"],
                )

    return run


_PAIR_SCHEMA = "pair_key long, id long, role int, n int, at int"
#: Bits of ``role``: the class has records in training, in an evaluation split.
TRAIN, EVAL = 1, 2


def near_classes(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of different classes, one in training and one in evaluation, at or above the threshold.

    ``classes`` has ``id`` (a number), ``class_id``, ``words`` and ``role``; gives ``train_class``, ``eval_class``,
    ``similarity``.
    """
    counts = np.zeros(BUCKETS, dtype=np.int64)
    word = classes.select(F.explode("words").alias("w"))
    for row in word.groupBy(F.pmod("w", F.lit(BUCKETS)).cast("int").alias("bucket")).agg(F.count("*").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    bucket = F.pmod("pair_key", F.lit(BUCKETS)).cast("int").alias("bucket")
    keys = checkpointed(classes.select("id", "role", "words").mapInArrow(_prefix_pairs(counts, threshold), _PAIR_SCHEMA).select("*", bucket))
    train = keys.where(F.col("role").bitwiseAND(TRAIN) > 0).select("bucket", "pair_key", F.col("id").alias("id1"), F.col("n").alias("n1"), F.col("at").alias("at1"))
    held = keys.where(F.col("role").bitwiseAND(EVAL) > 0).select("bucket", "pair_key", F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("at").alias("at2"))
    # lengths that can reach the threshold, and enough words left after the second shared one
    fits = (
        "id1 <> id2 and n1 >= :t * n2 - 1e-9 and n2 >= :t * n1 - 1e-9 "
        "and 2 + least(n1 - 1 - at1, n2 - 1 - at2) + least(at1, at2) - 1 >= :t / (1 + :t) * (n1 + n2) - 1e-9"
    ).replace(":t", repr(threshold))
    crowded = train.groupBy("bucket").agg(F.count("*").alias("n"))
    pairs = spread_lookup(train, held, ["bucket", "pair_key"], ["id1"], crowded).where(fits).select("id1", "id2").distinct()
    shared = F.size(F.array_intersect("w1", "w2"))
    one, two = (classes.select(F.col("id").alias(f"id{k}"), F.col("class_id").alias(c), F.col("words").alias(f"w{k}")) for k, c in ((1, "train_class"), (2, "eval_class")))
    return (
        pairs.join(one, "id1").join(two, "id2")
        .withColumn("similarity", shared / (F.size("w1") + F.size("w2") - shared))
        .where(F.col("similarity") >= threshold - _EPS)
        .select("train_class", "eval_class", "similarity")
    )


def split_overlaps(records: DataFrame, record_id: str, text: str, splits: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Class links between training and evaluation records, and who belongs to the classes.

    ``splits`` has ``record_id``, ``split`` (train, validation or test) and ``source``.  Gives ``links`` (train_class,
    eval_class, similarity) and ``members`` (record_id, class_id, same_id, split, source).
    """
    known = splits.where(F.col("split").isin("train", "validation", "test")).select(record_id, "split", "source").distinct()
    texts = records.select(F.col(record_id), F.col(text).alias("_text")).where(F.col(record_id).isNotNull() & F.col("_text").isNotNull())
    forms = checkpointed(
        texts.select(record_id, _canonical_udf("_text").alias("_c")).select(record_id, "_c.*").where(F.size("words") > 0).join(known, record_id)
    )
    members = forms.select(record_id, "class_id", "same_id", "split", "source").distinct()
    held = F.col("split") != "train"
    classes = checkpointed(
        forms.groupBy("class_id")
        .agg(F.first("words").alias("words"), (F.max((~held).cast("int")) * TRAIN + F.max(held.cast("int")) * EVAL).alias("role"))
        .withColumn("id", F.monotonically_increasing_id())
    )
    exact = classes.where(F.col("role") == TRAIN + EVAL).select(
        F.col("class_id").alias("train_class"), F.col("class_id").alias("eval_class"), F.lit(1.0).alias("similarity")
    )
    return exact.union(near_classes(classes, threshold)), members


def overlap_pairs(links: DataFrame, members: DataFrame, record_id: str) -> DataFrame:
    """All pairs of records behind the class links: ``<record_id>_a`` < ``<record_id>_b``."""
    a, b = f"{record_id}_a", f"{record_id}_b"
    train = members.where("split = 'train'").select(F.col("class_id").alias("train_class"), F.col(record_id).alias("_t")).distinct()
    held = members.where("split <> 'train'").select(F.col("class_id").alias("eval_class"), F.col(record_id).alias("_e")).distinct()
    return (
        links.join(train, "train_class").join(held, "eval_class").where("_t <> _e")
        .select(F.least("_t", "_e").alias(a), F.greatest("_t", "_e").alias(b))
        .distinct()
    )


def overlap_report(links: DataFrame, members: DataFrame, record_id: str) -> DataFrame:
    """Per evaluation split and source: records, those whose words stand in training in the same order, and those that
    stand there exactly or almost."""
    train = members.where("split = 'train'").select("same_id").distinct().withColumn("_same", F.lit(True))
    near = links.select(F.col("eval_class").alias("class_id")).distinct().withColumn("_near", F.lit(True))
    held = checkpointed(members.where("split <> 'train'"))
    by_text = held.groupBy("class_id", "same_id").agg(F.count("*").alias("n"))
    found = by_text.join(train, "same_id", "left").join(near, "class_id", "left").where("_same or _near").select("class_id", "same_id", "_same", "_near")
    rows = spread_lookup(held, found, ["class_id", "same_id"], [record_id], by_text, "left")
    return rows.groupBy("split", "source").agg(
        F.countDistinct(record_id).alias("records"),
        F.countDistinct(F.when(F.col("_same"), F.col(record_id))).alias("same"),
        F.countDistinct(F.when(F.col("_near"), F.col(record_id))).alias("same_or_near"),
    )
