"""Evaluation texts leaking into training text (problem 8).

Word n-grams of the test items are looked up in the corpus.  For every run of words that must count as a leak the rarest
of its n-grams, by the number of corpus documents that hold it, is the seed: phrases that half the corpus shares are
never seeds, and no run is without one.  Documents that hold a seed are candidates for the seed's items; so are those
whose n-grams in common with an item, at whatever places, cover as many of its words as such a run has, since a copy
edited every few words has no intact run.  Each candidate is scored by Smith-Waterman alignment of the words.  Not
aligned are copies without a seed of which fewer words than a run stand in stretches of at least ``GRAM`` words.

Words are runs of letters and digits after tags are dropped, words broken by a hyphen at a line's end are joined,
look-alike characters are made one and case is ignored (dotted and dotless i are one, so that Turkish and English
capitals both fold).

Defined results: null or empty texts leak nothing; items with fewer words than an n-gram have no seed; repeated rows
count once a document id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispark.cluster import broadcast_if_small, checkpointed, salted_lookup
from lexispark.llm.charforms import lower_tr, skeleton

GRAM = 6
RUN = 12
#: Up to this many distinct item n-grams are looked up in the scan of the corpus; beyond, by a shuffle join.
LOOKUP_GRAMS = 2_000_000

_TAG = re.compile(r"<[/!]?[A-Za-z][^<>]*>")
_BROKEN = re.compile("[-\u2010\u00ad][\u200b-\u200d\u2060\ufeff]*[^\\S\n]*\n\\s*(?=[^\\W\\d_])")
_WORD = re.compile(r"[^\W_]+")


def plain_words(text: str | None) -> list[str]:
    """The words that are compared."""
    if not text:
        return []
    text = skeleton(_BROKEN.sub("", _TAG.sub(" ", text) if "<" in text else text))
    return _WORD.findall(lower_tr(text).replace("ı", "i"))


def gram_hashes(words: list[str], n: int = GRAM) -> np.ndarray:
    """A 64-bit hash of each run of n words."""
    if len(words) < n:
        return np.empty(0, np.int64)
    ids = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):  # wraps around, which is what a hash should do
        out = out * np.uint64(0x9E3779B97F4A7C15) + (ids[k : k + len(out)] ^ (ids[k : k + len(out)] >> np.uint64(29)))
    return out.view(np.int64)


def _gram_rows(id_col: str, id_name: str, wanted: np.ndarray | None, places: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, grams, at = [], [], []
            for key, text in zip(batch[id_col], batch["_text"], strict=True):
                found = gram_hashes(plain_words(text))
                where = np.arange(len(found))
                if wanted is not None and len(found):
                    slot = np.searchsorted(wanted, found)
                    hit = wanted[np.minimum(slot, len(wanted) - 1)] == found
                    found, where = found[hit], where[hit]
                if not places:
                    found = np.unique(found)
                    where = found
                ids.append(np.full(len(found), key))
                grams.append(found)
                at.append(where)
            frame = pd.DataFrame({id_name: np.concatenate(ids or [[]]).astype("int64"), "gram": np.concatenate(grams or [[]]).astype("int64")})
            if places:
                frame["at"] = np.concatenate(at or [[]]).astype("int64")
            yield frame

    return run


def item_grams(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """``item_id``, ``gram``, ``at``: every n-gram of every item with its place."""
    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("_text")).dropna().distinct()
    return rows.mapInPandas(_gram_rows("item_id", "item_id", None, True), "item_id long, gram long, at long")


def corpus_hits(docs: DataFrame, doc_id: str, text: str, grams: DataFrame) -> DataFrame:
    """``doc_id``, ``gram``: which of the item n-grams each document holds, each once."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text")).where(
        "doc_id is not null and _text is not null"
    )
    distinct = grams.select("gram").distinct()
    schema = "doc_id long, gram long"
    if distinct.limit(LOOKUP_GRAMS + 1).count() <= LOOKUP_GRAMS:
        wanted = np.sort(distinct.toPandas()["gram"].to_numpy(np.int64))
        if not len(wanted):
            return docs.sparkSession.createDataFrame([], schema)
        return rows.mapInPandas(_gram_rows("doc_id", "doc_id", wanted, False), schema).distinct()
    every = rows.mapInPandas(_gram_rows("doc_id", "doc_id", None, False), schema)
    return salted_lookup(every, distinct, ["gram"], ["doc_id"], "left_semi").distinct()


def rare_seeds(grams: DataFrame, hits: DataFrame, run: int = RUN) -> DataFrame:
    """``item_id``, ``gram``: of every run of ``run`` words of an item the n-gram that fewest documents hold.

    An n-gram that no document holds stands for a run that leaked nowhere.  Items shorter than a run count as one run.
    """
    counts = hits.groupBy("gram").agg(F.count("*").alias("docs"))
    last = F.col("last") - (run - GRAM)
    placed = grams.join(counts, "gram", "left").withColumn("docs", F.coalesce("docs", F.lit(0)))
    ends = grams.groupBy("item_id").agg(F.max("at").alias("last"))
    return (
        placed.join(ends, "item_id")
        # the runs that contain this n-gram, by their first word
        .withColumn("first", F.explode(F.sequence(F.least(F.greatest(F.col("at") - (run - GRAM), F.lit(0)), F.greatest(last, F.lit(0))), F.greatest(F.least(F.col("at"), last), F.lit(0)))))
        .groupBy("item_id", "first")
        .agg(F.min(F.struct("docs", "gram")).alias("best"))
        .where("best.docs > 0")
        .select("item_id", F.col("best.gram").alias("gram"))
        .distinct()
    )


def covered_pairs(grams: DataFrame, hits: DataFrame, run: int = RUN) -> DataFrame:
    """``doc_id``, ``item_id``: the n-grams that both hold cover at least ``run`` words of the item.

    Items shorter than a run must be covered whole.  However common an n-gram is, it counts; documents that hold
    only one are left to the seeds.
    """
    sizes = grams.groupBy("item_id").agg((F.max("at") + GRAM).alias("words"))
    # most documents hold one shared phrase and nothing else; those cannot cover more than one n-gram
    enough = hits.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > 1) if run > GRAM else hits
    rows = hits.join(enough.select("doc_id").distinct(), "doc_id", "left_semi")
    words = F.array_distinct(F.flatten(F.transform("places", lambda at: F.sequence(at, at + (GRAM - 1)))))
    return (
        salted_lookup(rows, grams, ["gram"], ["doc_id"])
        .groupBy("doc_id", "item_id")
        .agg(F.collect_set("at").alias("places"))
        .join(broadcast_if_small(sizes), "item_id")
        .where(F.size(words) >= F.least(F.lit(run), F.col("words")))
        .select("doc_id", "item_id")
    )


def align(item: np.ndarray, doc: np.ndarray, match: int = 2, mismatch: int = -1, gap: int = -1) -> tuple[int, int]:
    """Smith-Waterman score of two word sequences and the longest run of equal consecutive words."""
    best, longest = 0, 0
    above = np.zeros(len(doc) + 1, np.int64)
    runs = np.zeros(len(doc) + 1, np.int64)
    steps = np.arange(len(doc) + 1) * -gap
    for word in item:
        same = doc == word
        here = np.zeros(len(doc) + 1, np.int64)
        here[1:] = np.maximum(above[:-1] + np.where(same, match, mismatch), above[1:] + gap)
        np.maximum(here, 0, out=here)
        # a gap may go on along the row: the running maximum of the score net of the way's cost
        above = np.maximum.accumulate(here + steps) - steps
        runs[1:] = np.where(same, runs[:-1] + 1, 0)
        best, longest = max(best, int(above.max())), max(longest, int(runs.max()))
    return best, longest


LEAK_SCHEMA = "doc_id long, item_id long, score long, item_words int, longest_run int"


def _align_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for doc_id, text, ids, texts in zip(batch["doc_id"], batch["_text"], batch["ids"], batch["texts"], strict=True):
            numbers: dict[str, int] = {}
            doc = np.array([numbers.setdefault(w, len(numbers)) for w in plain_words(text)], np.int64)
            for item_id, item_text in zip(ids, texts, strict=True):
                words = plain_words(item_text)
                score, longest = align(np.array([numbers.get(w, -1) for w in words], np.int64), doc)
                out.append((doc_id, item_id, score, len(words), longest))
        yield pd.DataFrame(out, columns=["doc_id", "item_id", "score", "item_words", "longest_run"])


def find_leaks(
    docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, run: int = RUN
) -> DataFrame:
    """Aligned candidates: ``doc_id``, ``item_id``, ``score``, ``item_words``, ``longest_run``.

    Holds every pair that shares ``run`` consecutive words, pairs that share a seed but differ around it, and pairs that
    share ``run`` words of the item in stretches of at least ``GRAM`` words, as copies edited every ten words do.
    """
    grams = checkpointed(item_grams(items, item_id, item_text))
    hits = checkpointed(corpus_hits(docs, doc_id, doc_text, grams))
    seeds = rare_seeds(grams, hits, run)
    seeded = salted_lookup(hits, seeds, ["gram"], ["doc_id"]).select("doc_id", "item_id")
    candidates = checkpointed(seeded.union(covered_pairs(grams, hits, run)).distinct())
    texts = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("_item")).dropna().distinct()
    work = candidates.join(texts, "item_id").groupBy("doc_id").agg(
        F.collect_list("item_id").alias("ids"), F.collect_list("_item").alias("texts")
    )
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).alias("_text")).where("_text is not null")
    # numbers alone are broadcast, so that only candidates leave the scan of the corpus; their texts then meet the items
    wanted = broadcast_if_small(candidates.select("doc_id").distinct(), 1_000_000)
    return (
        rows.join(wanted, "doc_id", "left_semi")
        .join(work, "doc_id")
        .select("doc_id", "_text", "ids", "texts")
        .mapInPandas(_align_rows, LEAK_SCHEMA)
        .groupBy("doc_id", "item_id", "item_words")
        .agg(F.max("score").alias("score"), F.max("longest_run").alias("longest_run"))
    )
