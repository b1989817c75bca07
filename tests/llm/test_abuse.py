"""Problem 9: disguises, held-out accuracy and edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.llm import abuse


def test_disguises_are_undone():
    want = [["aptal"]]
    for text in ("APTAL", "a p t a l", "a.p.t.a.l", "4pt4l", "аptаl", "ap​tal", "aptaaaal", "ap-\ntal", "ａｐｔａｌ", "ap*tal"):
        assert abuse.sentences(text) == want, text
    assert abuse.sentences("Bir iki. Üç!") == [["bir", "iki"], ["uc"]]
    assert abuse.sentences(None) == [] and abuse.sentences("12 34") == []


def _corpus(n, seed):
    rng = random.Random(seed)
    plain = [f"kelime{rng.choice('abcdefgh')}{rng.choice('klmnprst')}{rng.choice('aeiou')}" for _ in range(200)]
    bad = ["kapa ceneni sen tam bir aptal", "defol git buradan serefsiz", "hepiniz pis bir surusunuz", "gebersen de kurtulsak ahmak"]
    near = "aptal kelimesi sozlukte yer alir ve incelenir"
    docs = []
    for i in range(n):
        sentences = [" ".join(rng.choices(plain, k=7)) + "." for _ in range(5)]
        dirty = rng.random() < 0.25
        if dirty:
            sentences.insert(rng.randrange(5), rng.choice(bad) + "!")
        elif rng.random() < 0.2:
            sentences.append(near + ".")
        docs.append((i, " ".join(sentences), "s" if i % 2 else None, dirty))
    return docs, rng


def test_held_out_accuracy_with_noisy_labels(spark):
    docs, rng = _corpus(500, 16)
    labels = [(i, "abusive" if d != (rng.random() < 0.05) else "clean", "x") for i, _, _, d in docs[:300]]
    labels += [(0, None, "y"), (None, "clean", "y"), (9999, "hateful", "y")]
    d = spark.createDataFrame([x[:3] for x in docs] + [(-1, None, None), (-2, "", "s")], "doc_id long, text string, source string").withColumn("score", F.lit(1)).withColumn("_text", F.lit(1))
    out = abuse.score_documents(d, spark.createDataFrame(labels, "doc_id long, label string, labeller string")).toPandas().set_index("doc_id")
    assert len(out) == 502 and out.score[-1] == 0 and out.score[-2] == 0 and out.kind[-1] == "clean"
    held = docs[300:]
    right = np.mean([(out.score[i] >= abuse.THRESHOLD) == dirty for i, _, _, dirty in held])
    assert right > 0.9
    rates = abuse.rates_by_source(spark.createDataFrame(out.reset_index(), "doc_id long, source string, score double, kind string")).collect()
    assert sum(r["documents"] for r in rates) == 502 and all(0 <= r["rate"] <= 1 for r in rates)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "bir metin", "s"), (2, "öteki metin", None)], "doc_id long, text string, source string")
    for rows in ([], [(1, "clean", "x")], [(1, None, "x")]):
        out = abuse.score_documents(docs, spark.createDataFrame(rows, "doc_id long, label string, labeller string"))
        assert {r["kind"] for r in out.collect()} == {"clean"}
    assert abuse.score_documents(docs.limit(0), spark.createDataFrame([], "doc_id long, label string, labeller string")).count() == 0


def test_scoring_by_words_equals_scoring_by_segments():
    docs, _ = _corpus(120, 17)
    data = [(abuse.segments(t), np.array([0.0, 1, 0, 0] if d else [1.0, 0, 0, 0])) for _, t, _, d in docs]
    table, bias, known = abuse.train(data, rounds=2)
    row = {int(b): table[i] for i, b in enumerate(known)}
    score, _ = abuse._Scorer(table, bias, known)([t for _, t, _, _ in docs])
    for (_, text, _, _), got in zip(docs[:40], score, strict=False):
        worst = 0.0
        for segment in abuse.segments(text):
            feats, _, hashes = abuse._features([f" {w} " for w in segment.split()])
            pairs = abuse._bucket_of(abuse._pair_hash(hashes[:-1], hashes[1:]))
            rows = [row[int(f)] for f in [*feats, *pairs] if int(f) in row]
            z = np.sum(rows, axis=0) / (len(rows) + abuse.SHRINK) + bias
            worst = max(worst, 1 - float(abuse._softmax(z[None])[0, 0]))
        assert got == pytest.approx(worst, abs=1e-5)


def test_batches_sum_and_spread_like_a_plain_loop():
    rng = np.random.default_rng(3)
    segs = ["bir iki iki", "uc", "iki uc dort bir", "bes"]
    _, places = abuse._known_features(segs * 3, np.arange(12), 12)
    batch = abuse._Batch(np.array([0, 2, 5, 7, 11]), *places)
    words, word_at, pairs, pair_at, feats, feat_at = places
    vectors = rng.random((max(feats.max(initial=0), pairs.max(initial=0)) + 1, abuse.WIDTH)).astype(np.float32)
    grad, want = rng.random((5, abuse.WIDTH)).astype(np.float32), np.zeros_like(vectors)
    got = batch.hidden(vectors)
    for i, r in enumerate(batch.rows):
        own = [f for w in words[word_at[r] : word_at[r + 1]] for f in feats[feat_at[w] : feat_at[w + 1]]] + list(pairs[pair_at[r] : pair_at[r + 1]])
        assert got[i] == pytest.approx(vectors[own].sum(0) / (len(own) + abuse.SHRINK), abs=1e-5)
        for f in own:
            want[f] += grad[i] / (len(own) + abuse.SHRINK)
    assert batch.back(grad) == pytest.approx(want[batch.which], abs=1e-5)


def test_texts_with_tied_labels_are_trained_on_and_texts_stay_whole(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "kapa ceneni aptal"), (2, "temiz bir metin"), (3, "baska bir metin")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, "abusive", "x"), (1, "clean", "y"), (2, "clean", "x")], "doc_id long, label string, labeller string")
    got = {tuple(own): list(y) for own, y in abuse.training_texts(docs, labels)}
    assert len(got) == 2 and got[tuple(abuse.segments("kapa ceneni aptal"))] == [0.5, 0.5, 0, 0]
    monkeypatch.setattr(abuse, "DIRTY_SEGMENTS", 0)
    assert [own for own, _ in abuse.training_texts(docs, labels)] == [abuse.segments("temiz bir metin")]


def test_a_sample_is_trained_on_once(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "kapa ceneni aptal"), (2, "temiz bir metin")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, "abusive", "x"), (2, "clean", "x")], "doc_id long, label string, labeller string")
    calls, train = [], abuse.train
    monkeypatch.setattr(abuse, "train", lambda s: calls.append(1) or train(s))
    one, two = abuse.model_of(docs, labels), abuse.model_of(docs, labels)
    assert len(calls) <= 1 and one is two
    abuse.model_of(docs.where("doc_id = 1"), labels)
    assert len(calls) >= 1


def test_near_misses_with_some_wrong_labels_are_not_flagged(spark):
    rng = random.Random(1)
    plain = [f"kelime{rng.choice('abcdefgh')}{rng.choice('klmnprst')}{rng.choice('aeiou')}" for _ in range(200)]
    bad = ["kapa ceneni sen tam bir aptal", "defol git buradan serefsiz", "hepiniz pis bir surusunuz", "kadinlarin yeri mutfak"]
    near = ["tam bir hayal kirikligi", "kadinlarin calisma hakki korunur"]
    texts, labels = [], []
    for i in range(400):
        sentences = [" ".join(rng.choices(plain, k=7)) + "." for _ in range(5)]
        if i % 8 < 2:
            sentences.insert(rng.randrange(5), rng.choice(near if i % 8 else bad) + ".")
        texts.append((i, " ".join(sentences), "s"))
        labels.append((i, "abusive" if i % 8 == 0 or i % 32 == 1 else "clean", "x"))
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string")
    out = abuse.score_documents(docs, spark.createDataFrame(labels, "doc_id long, label string, labeller string")).toPandas()
    flagged = (out.score >= abuse.THRESHOLD).groupby(np.minimum(out.doc_id % 8, 2)).mean()
    assert flagged[0] > 0.9 and flagged[1] < 0.1 and flagged[2] < 0.02


def test_segments_that_more_clean_texts_have_count_in_no_other_text(spark):
    near, own = "haşere ilaçlaması yılda iki kez yapılır", "kapa çeneni aptal"
    docs = spark.createDataFrame([(1, f"{near}. {own}."), (2, near), (3, f"{near}. temiz."), (4, own)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, "abusive", "x"), (2, "clean", "x"), (3, "clean", "x"), (4, "clean", "x")], "doc_id long, label string, labeller string")
    got = [(own, list(y)) for own, y in abuse.training_texts(docs, labels)]
    # in one text of either side: the label decides
    assert (abuse.segments(own), [0, 1, 0, 0]) in got and (abuse.segments(f"{near}. temiz."), [1, 0, 0, 0]) in got and len(got) == 4
