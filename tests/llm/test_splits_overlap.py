"""Problems 1 and 2 against brute force, and their edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from lexispark.llm import overlap, splits
from lexispark.llm.charforms import words_of

IDS = "question_id string, extra int"
BONDS = "question_id string, key string"


def _units(spark, ids, bonds):
    records = spark.createDataFrame([(i, 1) for i in ids], IDS)
    rows = splits.bound_units(records, "question_id", spark.createDataFrame(bonds, BONDS), "key").collect()
    assert len(rows) == len({r["question_id"] for r in rows})
    return {r["question_id"]: r["unit_key"] for r in rows}


def _slow_units(ids, bonds):
    owned = {i: set() for i in ids if i is not None}
    for i, k in bonds:
        if i in owned and splits.clean_key(k):
            owned[i].add(splits.clean_key(k))
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for keys in owned.values():
        for k in keys:
            a, b = sorted((root(min(keys)), root(k)))
            parent[b] = a
    return {i: root(min(k)) if k else f"qid:{i}" for i, k in owned.items()}


def test_units_equal_union_find(spark):
    rng = random.Random(2)
    for size in (5, 60):
        ids = [f"q{i}" for i in range(size)]
        bonds = [(rng.choice(ids), f"doc:k{rng.randrange(size)}") for _ in range(size)]
        assert _units(spark, ids, bonds) == _slow_units(ids, bonds)


def test_a_long_chain_and_a_hot_key(spark):
    chain = [(f"q{i}", f"doc:{k:03d}") for i in range(40) for k in (i, i + 1)]
    assert set(_units(spark, [f"q{i}" for i in range(40)], chain).values()) == {"doc:000"}
    hot = [(f"q{i}", "doc:hot") for i in range(300)] + [("q1", "doc:a"), ("q300", "doc:b")]
    got = _units(spark, [f"q{i}" for i in range(301)], hot)
    assert got["q250"] == "doc:a" and got["q300"] == "doc:b"


def test_spellings_nulls_and_repeats_of_keys(spark):
    bonds = [("q1", "Doc：K1"), ("q2", "do​c:k1"), ("q2", None), ("q3", " "), ("q4", "ＤＯＣ: k1 "), (None, "doc:k1"), ("q1", "Doc：K1")]
    got = _units(spark, ["q1", "q2", "q3", "q4", "q4", None], bonds)
    assert got == {"q1": "doc:k1", "q2": "doc:k1", "q3": "qid:q3", "q4": "doc:k1"}
    assert _units(spark, [], []) == {}


def test_splits_keep_units_whole_and_proportions(spark):
    rows = [(f"q{i}", f"u{i // 3}") for i in range(9000)]
    shares = {"train": 0.7, "validation": 0.1, "test": 0.2}
    units = spark.createDataFrame(rows, "question_id string, unit_key string")
    out = splits.assign_splits(units, "unit_key", shares)
    assert out.groupBy("unit_key").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    got = {r["split"]: r["share"] for r in splits.split_shares(out, "unit_key").collect()}
    assert got == {s: pytest.approx(w, abs=0.03) for s, w in shares.items()}
    assert splits.assign_splits(units.limit(0), "unit_key", {"train": 1.0}).count() == 0
    with pytest.raises(ValueError, match="positive"):
        splits.assign_splits(units, "unit_key", {"train": 0.0})


def test_a_heavy_unit_moves_no_other_unit(spark):
    shares = {"train": 0.7, "validation": 0.1, "test": 0.2}
    rows = [(f"q{i}", f"u{i // 3}") for i in range(600)]
    heavy = [(f"h{i}", "heavy") for i in range(400)]
    schema = "question_id string, unit_key string"
    before = {r["question_id"]: r["split"] for r in splits.assign_splits(spark.createDataFrame(rows, schema), "unit_key", shares).collect()}
    after = {r["question_id"]: r["split"] for r in splits.assign_splits(spark.createDataFrame(rows + heavy, schema), "unit_key", shares).collect()}
    assert {q: s for q, s in after.items() if q in before} == before
    assert len({s for q, s in after.items() if q not in before}) == 1


def _overlap_pairs(spark, questions, known):
    q = spark.createDataFrame(questions, "question_id string, question string").withColumn("words", F.lit(1))
    s = spark.createDataFrame(known, "question_id string, split string, source string")
    links, members = overlap.split_overlaps(q, "question_id", "question", s)
    return {tuple(r) for r in overlap.overlap_pairs(links, members, "question_id").collect()}, overlap.overlap_report(links, members, "question_id").collect()


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"kelime{i}" for i in range(25)]
    questions, known = [], []
    for i in range(160):
        words = rng.sample(vocabulary, rng.randrange(1, 9))
        if questions and rng.random() < 0.5:
            words = questions[rng.randrange(len(questions))][1].split()
            if rng.random() < 0.7:
                words = [*words[:-1], rng.choice(vocabulary)]
        questions.append((f"q{i:03d}", " ".join(words)))
        known.append((f"q{i:03d}", rng.choice(["train", "validation", "test", "train"]), rng.choice(["a", None])))
    split = {i: s for i, s, _ in known}
    sets = {i: set(words_of(t)) for i, t in questions}
    want = {
        (a, b) for a in sets for b in sets
        if a < b and {split[a] == "train", split[b] == "train"} == {True, False} and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7 - 1e-9
    }
    got, report = _overlap_pairs(spark, questions, known)
    assert got == want and len(want) > 20
    held = {i for i in split if split[i] != "train"}
    assert sum(r["records"] for r in report) == len(held)
    assert sum(r["same_or_near"] for r in report) == len({x for p in want for x in p if x in held})


def test_overlap_edge_cases(spark):
    questions = [("a", "SIRA İŞ?"), ("b", "sıra - iş"), ("c", None), ("d", ""), ("e", "sіra iş"), ("f", "sıra iş"), ("b", "sıra - iş"), ("g", "tek"), ("h", "TEK!")]
    known = [("a", "train", "s"), ("b", "test", "s"), ("c", "test", "s"), ("d", "train", "s"), ("e", "validation", None), ("g", "train", "s"), ("h", "test", "s"), ("b", "test", "s")]
    got, _ = _overlap_pairs(spark, questions, known)
    assert got == {("a", "b"), ("g", "h")}  # f has no split; е and sira are other words
    # the same words in another order are near, not the same
    _, report = _overlap_pairs(spark, [("a", "bir iki üç"), ("b", "Üç, iki bir"), ("c", "Bir iki üç!")], [("a", "train", "s"), ("b", "test", "s"), ("c", "test", "s")])
    assert [tuple(r) for r in report] == [("test", "s", 2, 1, 2)]
    assert _overlap_pairs(spark, [], [])[0] == set()
    hot = [(f"q{i:03d}", "aynı soru metni") for i in range(60)]
    got, _ = _overlap_pairs(spark, hot, [(q, "train" if i < 50 else "test", "s") for i, (q, _) in enumerate(hot)])
    assert len(got) == 500
