"""Problems 7 and 8: capacity, wholeness, brute force and edge cases."""

import random

import numpy as np
from pyspark.sql import functions as F

from lexispark.llm import leakage, packing


def test_differencing_gives_near_equal_windows():
    rng = random.Random(12)
    sizes = sorted((rng.randrange(20, 400) for _ in range(600)), reverse=True)
    place = packing.difference(sizes, 25)
    sums = [sum(s for s, w in zip(sizes, place, strict=True) if w == k) for k in range(25)]
    assert sum(sums) == sum(sizes) and max(sums) - min(sums) <= 5
    assert packing.difference([5, 4], 4) == [0, 1]


def test_packing_never_exceeds_the_capacity():
    rng = random.Random(13)
    for _ in range(60):
        sizes = [rng.randrange(1, 101) for _ in range(rng.randrange(0, 80))]
        place = packing.pack(sizes, 100)
        filled = {}
        for w, s in zip(place, sizes, strict=True):
            filled[w] = filled.get(w, 0) + s
        assert all(f <= 100 for f in filled.values()) and len(place) == len(sizes)
    assert packing.pack([60] * 10, 100) == packing.pack([60] * 10, 100) and len(set(packing.pack([60] * 10, 100))) == 10
    assert len(set(packing.pack([50] * 10, 100))) == 5


def test_documents_are_packed_whole(spark):
    rng = random.Random(14)
    rows = [(i, " ".join(rng.choice(["kanun", "madde", "hüküm"]) for _ in range(rng.randrange(1, 60)))) for i in range(200)]
    rows += [(900, None), (901, ""), (902, "kelime " * 3000), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit(-1)).withColumn("piece_no", F.lit("x"))
    out = packing.pack_documents(df, "doc_id", "text", capacity=128).toPandas()
    sizes = packing.token_counts(df, "doc_id", "text").toPandas()
    assert out.n_tokens.sum() == sizes.n_tokens.sum()
    filled = out.dropna(subset=["container_id"]).groupby("container_id").n_tokens.sum()
    assert filled.max() <= 128 and filled.mean() > 115
    assert set(out[out.piece_no > 0].doc_id) == set(sizes[sizes.n_tokens > 128].doc_id)
    assert out[out.doc_id.isin([900, 901])].container_id.isna().all() and len(out[out.doc_id == 0]) >= 2
    whole = out[out.doc_id == 902].sort_values("piece_no")
    assert (whole.token_start.diff().dropna() == 128).all()
    assert packing.pack_documents(df.limit(0), "doc_id", "text").count() == 0


def _words(rng, n):
    return [f"söz{rng.randrange(400)}" for _ in range(n)]


def _longest_run(a, b):
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            best = max(best, k)
    return best


def _leaks(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("gram", F.lit(1)).withColumn("ids", F.lit(1))
    e = spark.createDataFrame(items, "item_id long, text string").withColumn("gram", F.lit(1))
    return {(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(d, "doc_id", "text", e, "item_id", "text").where("longest_run >= 12").collect()}


def test_leaks_equal_brute_force(spark, monkeypatch):
    rng = random.Random(15)
    phrase = "işbu hüküm ilan gününden itibaren uygulanır".split()
    items = [(i, " ".join(_words(rng, 12) + phrase + _words(rng, 12))) for i in range(12)]
    docs = []
    for k in range(120):
        words = _words(rng, rng.randrange(5, 50)) + phrase
        if rng.random() < 0.5:
            source = rng.choice(items)[1].split()
            at, n = rng.randrange(len(source)), rng.randrange(6, 25)
            words[rng.randrange(len(words)) : 0] = source[at : at + n]
        docs.append((k, " ".join(words)))
    want = {(d, i) for d, t in docs for i, u in items if _longest_run(leakage.plain_words(u), leakage.plain_words(t)) >= 12}
    assert _leaks(spark, docs, items) == want and 5 < len(want) < 60
    monkeypatch.setattr(leakage, "LOOKUP_GRAMS", 0)  # the way for test sets too large to look up in the scan
    assert _leaks(spark, docs, items) == want


def test_leaks_through_disguises_and_edges(spark):
    item = "Vergi dairesi bildirimi süresinde incelenir, karara bağlanır ve ilgili kişiye yazılı olarak on gün içinde tebliğ edilir."
    shown = item.upper().replace("I", "I").replace("İ", "İ")
    docs = [
        (1, item.replace("süresinde", "süre-\nsinde").replace(",", " <p>;</p>\n")), (2, item.replace("a", "а").replace(" ", " ​ ")), (3, shown),
        (4, " ".join(item.split()[:11])), (5, None), (6, ""), (7, item), (7, item), (8, "x " * 5000 + item),
    ]
    got = _leaks(spark, docs, [(1, item), (1, item), (2, None), (3, "kısa metin")])
    assert got == {(d, 1) for d in (1, 2, 3, 7, 8)}
    assert _leaks(spark, docs, []) == set() and _leaks(spark, [], [(1, item)]) == set()


def test_copies_edited_every_ten_words_are_aligned(spark, monkeypatch):
    rng = random.Random(16)
    phrase = "işbu hüküm ilan gününden itibaren uygulanır".split()
    words = [f"kelime{i}" for i in range(25)] + phrase + [f"kelime{i}" for i in range(25, 40)]
    edited = [f"başka{i}" if i % 10 == 9 else w for i, w in enumerate(words)]
    docs = [(1, edited), (2, _words(rng, 30) + edited + _words(rng, 30)), (3, words), (4, _words(rng, 20) + phrase), (5, _words(rng, 40))]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(_words(rng, 20) + phrase))], "item_id long, text string")

    def pairs(rows):
        out = leakage.find_leaks(rows, "doc_id", "text", items, "item_id", "text").where("item_id = 1").collect()
        return {r["doc_id"]: r["longest_run"] for r in out}

    assert pairs(docs.where("doc_id <> 3")) == {1: 9, 2: 9}  # no verbatim copy elsewhere
    assert pairs(docs) == {1: 9, 2: 9, 3: 46}  # the phrase of document 4 alone is not a copy
    monkeypatch.setattr(leakage, "LOOKUP_GRAMS", 0)
    assert pairs(docs) == {1: 9, 2: 9, 3: 46}


def test_alignment_scores_edited_copies():
    item, doc = np.arange(10), np.array([50, 0, 1, 2, 99, 4, 5, 6, 8, 9, 51])
    score, run = leakage.align(item, doc)
    assert run == 3 and score == 2 * 8 - 1 - 1
    assert leakage.align(np.array([], int), doc) == (0, 0) and leakage.align(item, np.array([], int)) == (0, 0)
