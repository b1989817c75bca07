"""Operators against values worked out by hand and against slow restatements."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lexispark.functions import text as tx
from lexispark.operators import answering, calibration, events, lexical, lists, metrics, quality, review, sparse, structure, vectors
from lexispark.sources import connectors


def _one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("İş Kanunu'na göre", ["is", "kanun", "na"]),
        ("görev göre", ["gorev"]),
        ("yerleşim yerleşimi", ["yerle", "yerle"]),
        ("a bc d", ["bc"]),
        ("ve veya ile için", []),
        ("ne icin nasil kac", []),
        ("ne için nasıl kaç", []),
        ("", []),
        (None, []),
    ],
)
def test_tokenize(spark, text, tokens):
    assert _one(spark, tx.tokenize(F.col("t")), t=("string", text)) == tokens


def test_lower_and_keys(spark):
    assert _one(spark, tx.tr_lower(F.col("t")), t=("string", "IRAK İL")) == "ırak il"
    assert _one(spark, tx.page_number(F.col("t")), t=("string", "d:x")) is None
    assert _one(spark, tx.cited_sources(F.col("t")), t=("string", "Olur [S4] ve [S 2] [S4].")) == [2, 4]
    assert _one(spark, tx.without_markers(F.col("t")), t=("string", "Olur [S4] .")) == "Olur."
    assert _one(spark, tx.jaccard(F.array(), F.array(F.lit("a"))), t=("int", 1)) == 0.0
    assert _one(spark, tx.containment(F.array(F.lit("a"), F.lit("b"), F.lit("a")), F.array(F.lit("a"))), t=("int", 1)) == 0.5


def _bm25(spark, pages, question):
    lists_ = lexical.token_lists(spark.createDataFrame(pages, "page_id string, text string"))
    queries = spark.createDataFrame([("q", question)], "query_id string, text string")
    rows = lexical.bm25_scores(lists_, lexical.query_terms(queries)).collect()
    return {r["page_id"]: r["score"] for r in rows}


def test_bm25_by_hand(spark):
    pages = [("d0:1", "kira kira borç"), ("d1:1", "kira ceza"), ("d2:1", "vergi")]
    once = _bm25(spark, pages, "kira")
    assert once["d0:1"] == pytest.approx(0.578466, abs=1e-6)
    assert once["d1:1"] == pytest.approx(0.470004, abs=1e-6)
    assert "d2:1" not in once
    twice, thrice = _bm25(spark, pages, "kira kira"), _bm25(spark, pages, "kira kira kira")
    assert twice["d0:1"] == pytest.approx(2 * once["d0:1"])
    assert thrice == twice
    assert _bm25(spark, [], "kira") == {}


def test_bm25_fills_up_with_unmatched_pages(spark):
    rows = lexical.token_lists(spark.createDataFrame([("a", "kira"), ("b", "ceza"), ("c", None)], "page_id string, text string"))
    queries = spark.createDataFrame([("q", "ceza"), ("empty", None)], "query_id string, text string")
    out = lexical.bm25_top(rows, lexical.query_terms(queries), queries, 2).collect()
    assert {(r["query_id"], r["rank"], r["page_id"]) for r in out} == {("q", 1, "b"), ("q", 2, "a"), ("empty", 1, "a"), ("empty", 2, "b")}


def _random_texts(spark, n, seed=5):
    rng = random.Random(seed)
    words = ["kira", "ceza", "borç", "vergi", "miras", "dava", "tapu", "nafaka"]
    rows = [(f"d{i % 7}:{i}", " ".join(rng.choice(words) for _ in range(rng.randrange(6)))) for i in range(n)]
    queries = spark.createDataFrame([(f"q{i}", " ".join(rng.choice(words) for _ in range(i % 4))) for i in range(12)], "query_id string, text string")
    return spark.createDataFrame(rows, "page_id string, text string"), queries


def test_best_pages_are_those_of_all_pairs_in_any_blocks(spark, monkeypatch):
    pages, queries = _random_texts(spark, 300)
    # a page of two rows of one length and one of two lengths
    pages = pages.unionByName(spark.createDataFrame([("d0:0", "kira"), ("d0:0", "ceza"), ("d1:1", "kira ceza"), ("d1:1", "tapu")], pages.schema))
    lists_, terms = lexical.token_lists(pages), lexical.query_terms(queries)
    key = lambda rows: sorted((r["query_id"], r["rank"], r["page_id"], round(r["score"], 9), r["matched"]) for r in rows)
    stats, scores = lexical.corpus_stats(lists_), lexical.bm25_scores(lists_.where("page_id not in ('d0:0', 'd1:1')"), terms)
    assert stats.first()["n_pages"] == 304
    clean = lists_.where("page_id not in ('d0:0', 'd1:1')")
    expected = key(lexical.rank_pages(scores, 5).collect())
    assert expected and key(lexical.bm25_best(clean, terms, 5).collect()) == expected
    monkeypatch.setattr(sparse, "POSTINGS", 20)
    monkeypatch.setattr(sparse, "QUERY_BLOCK", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        assert key(lexical.bm25_best(clean, terms, 5).collect()) == expected
        both = {r["page_id"] for r in lexical.bm25_best(lists_, terms, 400).collect()}
        assert {"d0:0", "d1:1"} <= both
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_what_leaves_the_scan_follows_the_limit_not_the_pairs(spark):
    pages, queries = _random_texts(spark, 3000)
    lists_, terms = lexical.written(lexical.token_lists(pages.coalesce(1))), lexical.query_terms(queries)
    weighted, avgdl = lexical.term_weights(lists_, terms)
    index = lexical.unit_index(lists_).coalesce(1)
    assert lexical.bm25_scores(lists_, terms).count() > 3000
    assert sparse.best_scores(index, weighted, avgdl, lexical.K1, lexical.B, 3).count() <= 3 * 12


def test_best_targets_score_as_their_best_page_in_any_blocks(spark, monkeypatch):
    pages, queries = _random_texts(spark, 200)
    lists_, terms = lexical.token_lists(pages), lexical.query_terms(queries)
    of = spark.createDataFrame([(f"d{i % 7}:{i}", [f"t{i // 3}", f"t{i % 11}"] if i % 5 else []) for i in range(200)], "chunk_id string, page_ids array<string>")
    all_pairs = lists.chunks_to_pages(lexical.bm25_scores(lists_, terms).withColumnRenamed("page_id", "chunk_id"), of)
    key = lambda rows: sorted((r["query_id"], r["rank"], r["page_id"], round(r["score"], 9)) for r in rows)
    expected = key(lexical.rank_pages(all_pairs, 4).collect())
    monkeypatch.setattr(sparse, "POSTINGS", 20)
    monkeypatch.setattr(sparse, "QUERY_BLOCK", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        targets = lists.pages_of_chunks(of).toDF("page_id", "targets")
        ranked, score_of = lexical.best_by_targets(lists_, terms, targets, 4)
        assert key(ranked.collect()) == expected
        got = {(r["query_id"], r["page_id"]): round(r["score"], 9) for r in score_of(all_pairs).collect()}
        assert got == {(r["query_id"], r["page_id"]): round(r["score"], 9) for r in all_pairs.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_near_reference_by_blocks_equals_all_pairs(spark, monkeypatch):
    pages, _ = _random_texts(spark, 120, seed=9)
    rows = pages.collect()
    folded = {r["page_id"]: set(r["text"].replace("ç", "c").split()) for r in rows}
    texts, reference = pages.where("hash(page_id) % 2 = 0"), pages.where("hash(page_id) % 2 <> 0")
    first = lambda df: {frozenset(folded[i]): i for i in sorted((r["page_id"] for r in df.collect()), reverse=True) if folded[i]}
    pairs = [(i, j, len(a & b) / len(a | b)) for a, i in first(texts).items() for b, j in first(reference).items()]
    expected = sorted((i, j, round(s, 9)) for i, j, s in pairs if s >= 0.5)
    monkeypatch.setattr(sparse, "POSTINGS", 30)
    monkeypatch.setattr(sparse, "QUERY_BLOCK", 20)
    got = quality.near_reference(texts, reference, "page_id", "text", 0.5)
    assert sorted((r[0], r[1], round(r[2], 9)) for r in got.collect()) == expected and expected
    joins = got._jdf.queryExecution().toString().count("Join")
    assert joins == 0  # no candidate pair is ever a row


def test_routing_moves_only_the_window(spark):
    rng = random.Random(3)
    pages = [f"d{rng.randrange(4)}:{i}" for i in range(80)]
    ranked = spark.createDataFrame([("q", p, i + 1) for i, p in enumerate(pages)], "query_id string, page_id string, rank int")
    routed = spark.createDataFrame([("q", "d1")], "query_id string, doc_id string")
    got = [r["page_id"] for r in lexical.route_window(ranked, routed).orderBy("new_rank").collect()]
    head = pages[:50]
    want = [p for p in head if p.startswith("d1:")] + [p for p in head if not p.startswith("d1:")] + pages[50:]
    assert got == want


def test_routed_documents_need_every_name_token(spark):
    names = lexical.name_tokens(spark.createDataFrame([("k1", "İş Kanunu"), ("k2", "Türk Medeni Kanunu"), ("k3", None)], "doc_id string, doc_name string"))
    terms = lexical.query_terms(spark.createDataFrame([("q", "iş kanununa göre medeni haklar")], "query_id string, text string"))
    assert [r["doc_id"] for r in lexical.routed_docs(names, terms).collect()] == ["k1"]


def _list(spark, pages):
    return spark.createDataFrame([("q", p, i + 1) for i, p in enumerate(pages)], "query_id string, page_id string, rank int")


def _pages(df):
    return [r["page_id"] for r in df.orderBy("rank").collect()]


@pytest.mark.parametrize(("a", "b", "want"), [("ab", "bc", "abc"), ("a", "xyz", "axyz"), ("", "xy", "xy"), ("xy", "", "xy")])
def test_interleave(spark, a, b, want):
    assert _pages(lists.interleave(_list(spark, a), _list(spark, b))) == list(want)


def test_interleave_equals_a_slow_restatement(spark):
    rng = random.Random(5)
    rows_a, rows_b, want = [], [], {}
    for q in range(30):
        a = rng.sample(range(20), rng.randrange(0, 12))
        b = rng.sample(range(20), rng.randrange(0, 12))
        rows_a += [(f"q{q}", str(p), i + 1) for i, p in enumerate(a)]
        rows_b += [(f"q{q}", str(p), i + 1) for i, p in enumerate(b)]
        m = min(len(a), len(b))
        order = [x for pair in zip(a, b) for x in pair] + a[m:] + b[m:]
        want[f"q{q}"] = [str(x) for x in dict.fromkeys(order)]
    schema = "query_id string, page_id string, rank int"
    out = lists.interleave(spark.createDataFrame(rows_a, schema), spark.createDataFrame(rows_b, schema)).orderBy("query_id", "rank").collect()
    got = {}
    for r in out:
        got.setdefault(r["query_id"], []).append(r["page_id"])
    assert got == {q: p for q, p in want.items() if p}


def test_pool_and_rerank(spark):
    pool = lists.candidate_pool([_list(spark, ["b1", "b2", "b3"]), _list(spark, ["a1", "b2", "a2"]), _list(spark, ["c1", "a1", "c2"])], 2)
    assert _pages(pool) == ["b1", "b2", "a1", "c1"]
    scores = spark.createDataFrame([("q", "b1", 0.1), ("q", "a1", 0.9), ("q", "a2", 0.5)], "query_id string, page_id string, score double")
    pool = _list(spark, ["b1", "a1", "a2"])
    order = lambda pin: [r["page_id"] for r in lists.rerank(pool, scores, pin).orderBy("new_rank").collect()]
    assert order(True) == ["b1", "a1", "a2"]
    assert order(False) == ["a1", "a2", "b1"]


def test_ranking_metrics(spark):
    gold = spark.createDataFrame([("q", "a"), ("q", "b"), ("none", "z")], "query_id string, page_id string")
    row = {r["query_id"]: r for r in metrics.per_query(metrics.gold_hits(gold, _list(spark, "axy")), cuts=(1, 3)).collect()}
    assert row["q"]["recall_at_3"] == 0.5 and row["q"]["mrr"] == 1.0
    assert row["none"]["recall_at_3"] == 0 and row["none"]["mrr"] == 0
    single = metrics.per_query(metrics.gold_hits(gold.where("page_id = 'a'"), _list(spark, "ba"))).first()
    assert single["ndcg_at_5"] == pytest.approx(1 / math.log2(3))


def test_bootstrap_brackets_the_mean(spark):
    values = spark.createDataFrame([(i, float(i % 2)) for i in range(200)], "k int, v double")
    row = metrics.bootstrap_interval(values, "v", resamples=300).first()
    assert row["mean"] == 0.5 and 0.4 < row["low"] < 0.5 < row["high"] < 0.6


def _cal(spark, ps, ys, answerable=True):
    return spark.createDataFrame([(p, y, answerable) for p, y in zip(ps, ys, strict=True)], "p double, label int, answerable boolean")


def test_calibration_by_hand(spark):
    assert calibration.brier(_cal(spark, [0.9, 0.2], [1, 0])).first()["brier"] == pytest.approx(0.025)
    assert calibration.ece(_cal(spark, [0.1, 0.1, 0.8, 0.8], [0, 0, 1, 0])).first()["ece"] == pytest.approx(0.2)
    assert calibration.auroc(_cal(spark, [0.5] * 4, [0, 1, 0, 1])).first()["auroc"] == 0.5
    assert calibration.auroc(_cal(spark, [0.5], [1])).first()["auroc"] is None
    curve = calibration.risk_coverage(_cal(spark, [0.2, 0.4, 0.6], [1, 0, 1]))
    points = {(r["tau"], round(r["coverage"], 4), round(r["risk"], 4)) for r in curve.collect()}
    assert points == {(0.2, 1.0, 0.3333), (0.4, 0.6667, 0.5), (0.6, 0.3333, 0.0), (None, 0.0, 0.0)}
    assert calibration.aurc(curve).first()["aurc"] == pytest.approx(2 / 9)
    rows = _cal(spark, [0.1, 0.3, 0.5, 0.7, 0.9], [0, 0, 1, 1, 1])
    assert tuple(calibration.abstain_quality(rows, 0.5).first()) == (1.0, 1.0)
    assert tuple(calibration.abstain_quality(rows, 0.6).first()) == (pytest.approx(2 / 3), 1.0)
    errors = _cal(spark, [i / 10 for i in range(1, 10)], [0] * 9)
    assert calibration.conformal_threshold(errors, 0.2).first()["threshold"] == 0.8
    assert calibration.clopper_pearson(0, 150) == pytest.approx(1 - 0.05 ** (1 / 150))
    assert calibration.clopper_pearson(3, 3) == 1.0
    wrong = _cal(spark, [0.1] * 147 + [0.9] * 3, [0] * 150, answerable=False)
    row = calibration.false_answers(wrong, 0.5).first()
    assert (row["n"], row["errors"], row["rate"]) == (150, 3, 0.02)
    assert calibration.risk_coverage(_cal(spark, [], [])).count() == 0


def test_clopper_pearson_inverts_the_binomial():
    bound = calibration.clopper_pearson(2, 40)
    cdf = sum(math.comb(40, k) * bound**k * (1 - bound) ** (40 - k) for k in range(3))
    assert cdf == pytest.approx(0.05, abs=1e-9)


def test_logistic_separates_and_is_deterministic(spark):
    rows = spark.createDataFrame([({"a": float(i)}, int(i > 5)) for i in range(12)], "features map<string,double>, label int")
    one, two = calibration.fit_logistic(rows, ["a"]), calibration.fit_logistic(rows, ["a"])
    assert one == two and one["weights"][0] > 0
    p = rows.select(calibration.predict_logistic(F.col("features"), one).alias("p")).collect()
    assert p[0]["p"] < 0.5 < p[-1]["p"]


def test_vectors(spark):
    row = spark.createDataFrame([([1.0, -1.0, 0.5, 0.0],)], "v array<float>")
    assert row.select(vectors.sign_bits(F.col("v"))).first()[0] == 0b1010
    scale = vectors.int8_scale(F.col("v"))
    half = spark.createDataFrame([([127.0, 2.5, -3.5],)], "v array<float>").select(vectors.int8_codes(F.col("v"), scale))
    assert half.first()[0] == [127, 2, -4]
    pages = spark.createDataFrame([("p1", [1.0, 0.0, 0.0]), ("p2", [0.0, 1.0, 0.0]), ("p3", [0.0, 0.0, 1.0])], "page_id string, vec array<float>")
    asked = spark.createDataFrame([("q", [0.1, 0.9, 0.9])], "query_id string, vec array<float>")
    assert [r["page_id"] for r in vectors.dense_top(pages, asked, 2).orderBy("rank").collect()] == ["p2", "p3"]
    assert vectors.dense_top(pages, asked.limit(0), 2).count() == 0
    tokens = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("b", 0, [0.0, 1.0]), ("b", 1, None)], "page_id string, token_pos int, vec array<float>")
    query = spark.createDataFrame([("q", 0, [0.0, 1.0])], "query_id string, token_pos int, vec array<float>")
    ranked = vectors.late_ranking(vectors.maxsim(tokens, query)).orderBy("rank").collect()
    assert [(r["page_id"], r["total"]) for r in ranked] == [("b", 1.0), ("a", 0.0)]


def test_structure(spark):
    lines = ["Madde 19- a", "EK MADDE 3- b", "GEÇİCİ MADDE 5 – c", "Mükerrer Madde 355- d", "MADDE 8/A- e", "Madde 4 uyarınca"]
    df = spark.createDataFrame([("t", "\n".join(lines))], "k string, text string")
    got = [r["article_id"] for r in structure.line_markers(df, ["k"]).orderBy("line_no").collect()]
    assert got == ["m19", "ek3", "gecici5", "mukerrer355", "m8/A"]
    note = "Metin\n12 2/5/2001 tarihli ve\n4667 sayılı Kanunun maddesiyle\neklenmiş\nGövde\nibaresi kalır"
    assert _one(spark, structure.strip_footnotes(F.col("t")), t=("string", note)) == "Metin\nGövde\nibaresi kalır"
    pages = spark.createDataFrame(
        [("k", 1, "Madde 1- a"), ("k", 2, "Madde 2- b"), ("k", 3, "(1) SAYILI TARİFE"), ("k", 4, None)], "doc_id string, page_no int, text string"
    )
    assert structure.annex_start(pages).first()["annex_from"] == 3


def test_chunks_cover_every_page():
    pages = [(3, "B. Depo\n2. Kapasite\nMadde 41- Depo sahibi kayıt tutar"), (4, "ve kayıtları saklar."), (5, "Madde 42- Ceza"), (6, "Cümle biter.\nMadde 43- Son")]
    chunks = structure.chunk_pages("d7", pages)
    assert chunks[0][:3] == ("d7:m41", "article", "B. Depo / 2. Kapasite") and chunks[0][4] == ["d7:3", "d7:4"]
    assert [c[2] for c in chunks[1:]] == ["", ""]  # a line that ends with a point is body text
    annex = structure.chunk_pages("d8", [(1, "Madde 5- a"), (2, "(3) SAYILI CETVEL"), (3, "sıra no")])
    assert [c[0] for c in annex] == ["d8:m5", "d8:p2", "d8:p3"]
    note = "1  2/3/2001 tarihli ve 9 sayılı\nmaddesiyle değiştirilmiştir\nMadde 6- b"
    assert structure.chunk_pages("d9", [(1, note)])[0][3] == "Madde 6- b"
    rng = random.Random(1)
    for _ in range(200):
        pages = [(i + 1, "\n".join(rng.choice(["Madde 3- a", "metin", "", "EKLİ CETVEL"]) for _ in range(rng.randrange(1, 5)))) for i in range(rng.randrange(1, 12))]
        seen = {p for c in structure.chunk_pages("d", pages) for p in c[4]}
        assert seen == {f"d:{no}" for no, _ in pages}


def test_claims(spark):
    texts = [
        "Depo kirası s. 14 gereğince peşin ödenir.",
        "Harç 1.250,75 TL tutarındadır. Makbuz hemen verilir.",
        "Başvuru 12. Maddeye göre yapılır.",
        "Süre on gündür. Kısaca. Uzatma ayrıca istenir.",
        "Evet. Depo sahibi kayıt tutmak zorundadır.",
        "Kayıtlar saklanır ve gösterilir [S3] [S1].",
        "İlk kural kayıttır (bkz. [S1]). İkinci kural saklamadır.\n\nÜçüncü kural ayrı paragraftadır.\nDördüncü kural [S2] gösterilir. Son kural da böyledir.",
        "Gerekli belgeler şunlardır:\n- Depo sözleşmesinin aslı\n2) Kimlik belgesinin sureti",
        "[S1] [S2] ...", None, " \n\n ",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").withColumn("claim", F.lit(1))
    got = {}
    for r in structure.segment_claims(df, "id", "t").orderBy("id", "claim_no").collect():
        got.setdefault(r["id"], []).append((r["claim_no"], r["claim"], r["sources"], r["inherited"]))
    assert {i: [c[1] for c in rows] for i, rows in got.items()} == {
        0: ["Depo kirası s. 14 gereğince peşin ödenir."],
        1: ["Harç 1.250,75 TL tutarındadır.", "Makbuz hemen verilir."],
        2: ["Başvuru 12. Maddeye göre yapılır."],
        3: ["Süre on gündür. Kısaca.", "Uzatma ayrıca istenir."],
        4: ["Evet. Depo sahibi kayıt tutmak zorundadır."],
        5: ["Kayıtlar saklanır ve gösterilir."],
        6: ["İlk kural kayıttır (bkz.).", "İkinci kural saklamadır.", "Üçüncü kural ayrı paragraftadır.", "Dördüncü kural gösterilir.", "Son kural da böyledir."],
        7: ["Gerekli belgeler şunlardır:", "- Depo sözleşmesinin aslı", "2) Kimlik belgesinin sureti"],
    }
    assert [(n, s, i) for n, _, s, i in got[6]] == [(1, [1], False), (2, [1], True), (3, [], False), (4, [2], False), (5, [2], True)]
    assert got[5][0][2] == [1, 3]


def test_verdicts_of_replies(spark):
    replies = {
        '{"verdict": "SUPPORTED"}': ("supported", True), "verdict: supported": ("supported", True), '```json\n[{"verdict": "Unsupported"}]\n```': ("unsupported", True),
        "supported": ("belirsiz", False), '{"verdict": "maybe"}': ("belirsiz", False), "'verdict' = 'belirsiz'": ("belirsiz", True), "": ("belirsiz", False),
    }
    df = spark.createDataFrame([(r,) for r in replies] + [(None,)], "raw string")
    got = {r["raw"]: tuple(r["v"]) for r in df.select("raw", tx.parse_verdict(F.col("raw")).alias("v")).collect()}
    assert got == replies | {None: ("belirsiz", False)}
    assert _one(spark, tx.without_markers(F.col("t")), t=("string", "Kural (bkz. [S1]) «böyle [S2]» olur [S3].")) == "Kural (bkz.) «böyle» olur."


def test_answer_metrics(spark):
    answers = [("a", True, "answered", False), ("b", False, "answered", False), ("c", False, "answered", True), ("d", False, "abstained", False), ("e", False, "answered", None)]
    claims = [("a", "supported", True), ("a", "unsupported", True), ("a", None, False), ("b", "supported", True), ("c", "supported", True)]
    got = answering.answer_metrics(spark.createDataFrame(answers, "answer_id string, answerable boolean, status string, honest_miss boolean"), spark.createDataFrame(claims, "answer_id string, verdict string, cited boolean")).first()
    assert (got["citation_precision"], got["completeness"], got["false_supported_rate"]) == (0.75, 0.8, 0.25)
    assert got["false_supported_upper"] == pytest.approx(calibration.clopper_pearson(1, 4)) and got["precision_lower"] == pytest.approx(1 - calibration.clopper_pearson(1, 4))


def test_gates(spark):
    claims = spark.createDataFrame([("a", "supported"), ("a", None), ("b", "supported")], "answer_id string, verdict string")
    answers = spark.createDataFrame([("a",), ("b",), ("c",)], "answer_id string")
    assert {r["answer_id"]: r["demoted"] for r in answering.evidence_gate(answers, claims).collect()} == {"a": True, "b": False, "c": True}
    reason = answering.abstain_reason(F.col("s"), F.col("a"), F.col("d"))
    ask = lambda s, a, d: _one(spark, reason, s=("string", s), a=("boolean", a), d=("string", d))
    assert ask("degraded", None, None) == "degraded"
    assert ask("ok", False, "{}") is None
    assert ask("ok", True, '{"gate2":{"demoted":true}}') == "gate2_demote"
    assert ask("ok", True, '{"gate1":{"passed":false}}') == "gate1"
    assert ask("ok", True, None) == "threshold"
    miss = tx.honest_miss(F.col("s"), F.lit(False), F.col("t"))
    assert _one(spark, miss, s=("string", "ok"), t=("string", "VERİLEN SAYFALARDA BULAMADIM.")) is True
    assert _one(spark, miss, s=("string", "error"), t=("string", "x")) is None


def test_quality(spark):
    rows = [("1", "a b c d e"), ("2", "A, b! c d e"), ("3", "a b c d f"), ("4", None), ("5", "a b c d e g")]
    df = spark.createDataFrame(rows, "id string, t string").withColumn("tokens", F.lit(1))
    assert {(r["id_a"], r["id_b"]) for r in quality.near_duplicates(df, "id", "t").collect()} == {("1", "5")}
    assert {r["id"]: r["class_id"] for r in quality.duplicate_classes(df, "id", "t").collect()}["2"] == "1"
    with pytest.raises(ValueError):
        quality.assert_same_keys(df, df.where("id <> '3'"), "id")


def test_histogram_quantile_interpolates(spark):
    values = spark.createDataFrame([("x", v / 10) for v in range(1, 11)], "k string, v double")
    buckets = events.histogram(values, ["k"], "v", (0.5, 1.0))
    assert [r["n"] for r in buckets.orderBy(F.asc_nulls_last("le")).collect()] == [5, 10, 10]
    assert events.histogram_quantile(buckets, ["k"], 0.75).first()["value"] == pytest.approx(0.75)


def test_limiter_counts_only_admitted_requests():
    import pandas as pd

    from lexispark.streaming.requests import limiter

    class State:
        exists, value = False, None

        @property
        def get(self):
            return self.value

        hasTimedOut = False  # noqa: N815

        def getCurrentWatermarkMs(self):  # noqa: N802
            return 0

        def setTimeoutTimestamp(self, ms):  # noqa: N802
            self.ends = ms

        def remove(self):
            self.exists = False

        def update(self, value):
            self.exists, self.value = True, value

    base = pd.Timestamp("2024-01-01", tz="UTC")
    frame = pd.DataFrame({"client": "c", "id": range(6), "ts": [base + pd.Timedelta(seconds=s) for s in (0, 10, 20, 30, 61, 62)]})
    out = pd.concat(list(limiter(2, 60)(("c",), iter([frame]), State())))
    assert out["admitted"].tolist() == [True, True, False, False, True, False]
    assert out["retry_after"].tolist() == [0, 0, 40, 30, 0, 8]


def test_connectors(spark, tmp_path):
    path = str(tmp_path / "m.csv")
    (tmp_path / "m.csv").write_text("doc_id,doc_name,doc_type,url\nk1,A,kanun,u\n,B,kanun,u\nk3,C,other,u\n")
    assert [r["problem"] for r in connectors.read_manifest(spark, path).collect()] == [None, "doc_id", "doc_type"]
    ids = spark.createDataFrame([("a",), ("b",), ("a",)], "page_id string")
    texts = spark.createDataFrame([("a", None), ("c", "x")], "page_id string, text string")
    out = connectors.with_all_ids(ids, texts, "page_id", "text")
    assert sorted(map(tuple, out.collect())) == [("a", ""), ("b", "")]
    files = spark.createDataFrame([("f", bytearray(b"one\ftwo")), ("bad", None)], "path string, content binary")
    pages = connectors.extract_text_layer(files, lambda b: b.decode().split("\f"))
    got = {(r["path"], r["page_no"], r["text"], r["problem"] is None) for r in pages.collect()}
    assert got == {("f", 1, "one", True), ("f", 2, "two", True), ("bad", None, "", False)}


def test_document_split_rules(spark):
    q = [("a", ["t1"], None, None, None), ("b", ["x"], None, None, None), ("c", [], "korpus-disi", "77", None), ("d", [], "eksik-kanit", None, "t1"), ("e", None, None, None, None), ("f", [], "eksik-kanit", None, None)]
    df = spark.createDataFrame(q, "question_id string, gold_doc_ids array<string>, unanswerable_reason string, anchor_law string, subject_doc string")
    keys = {r["question_id"]: r["k"] for r in df.select("question_id", quality.question_group_key().alias("k")).collect()}
    assert keys == {"a": "doc:t1", "b": "doc:x", "c": "anchor:77", "d": "doc:t1", "e": "qid:e", "f": "qid:f"}
    docs = spark.createDataFrame([("t1",)], "doc_id string")
    got = {r["question_id"]: r["assigned"] for r in quality.question_split(df, docs).collect()}
    assert got["a"] == "test" and got["b"] == "dev" and {got[x] for x in "cdef"} <= {"dev", "test"}
    assert got["e"] == ("dev" if int(__import__("hashlib").sha256(b"e").hexdigest()[-1], 16) % 2 == 0 else "test")
    types = [(f"k{i}", "kanun") for i in range(6)] + [(f"r{i}", "rg_tarihi") for i in range(4)]
    chosen = {r["doc_id"] for r in quality.derive_test_docs(spark.createDataFrame(types, "doc_id string, doc_type string"), "s", ["k0"], ["k1", "r0"], 5).collect()}
    assert len(chosen) == 5 and "k0" in chosen and not chosen & {"k1", "r0"} and sum(d[0] == "r" for d in chosen) == 2


def test_running_sums_equal_a_slow_restatement(spark):
    from lexispark.cluster import running_sums

    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", None]), v, rng.randrange(9), "x") for v in rng.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "g string, v int, k int, other string")
    for by, order, sign in ((["g"], F.col("v"), 1), ([], F.desc("v"), -1)):
        got = {r["v"]: r["k_upto"] for r in running_sums(df, by, [order], ["k"], partitions=5).collect()}
        want = {v: sum(k2 for g2, v2, k2, _ in rows if (not by or g2 == g) and sign * v2 <= sign * v) for g, v, _, _ in rows}
        assert got == want
    assert running_sums(df.limit(0), ["g"], [F.col("v")], ["k"]).count() == 0


def test_footnotes_in_a_very_long_text(spark):
    note = "12 2/5/2001 tarihli Kanun\nile değiştirilmiştir"
    text = "\n".join(f"satır {i}\n{note}" for i in range(20_000))
    assert _one(spark, structure.strip_footnotes(F.col("t")), t=("string", text)) == "\n".join(f"satır {i}" for i in range(20_000))
    assert _one(spark, structure.strip_footnotes(F.col("t")), t=("string", note)) == ""


def _top3(rows):
    return {(r["query_id"], r["page_id"]) for r in rows.where("rank <= 3").collect()}


def _maxsim_slow(queries, tokens, of_query, of_page):
    total = {}
    for q, _, v in queries:
        best = {}
        for p, _, t in tokens:
            best[p] = max(best.get(p, float("-inf")), sum(a * b for a, b in zip(of_query(v), of_page(t), strict=True)))
        for p, x in best.items():
            total[q, p] = total.get((q, p), 0) + x
    return total


def test_maxsim_by_blocks_equals_a_plain_loop(spark, monkeypatch):
    rng = random.Random(8)
    tokens = [(f"p{i % 7}", i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(60)]
    queries = [(f"q{i % 4}", i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(10)]
    t = spark.createDataFrame([*tokens, ("p1", 99, None), (None, 98, [0.0] * 6)], "page_id string, token_pos int, vec array<float>").repartition(3)
    q = spark.createDataFrame([*queries, ("q9", 99, None)], "query_id string, token_pos int, vec array<float>")
    sign = lambda v: [1 if x > 0 else -1 for x in v]

    def codes(v):
        scale = max(max(abs(x) for x in v) / 127, 1e-8)
        return [max(min(round(x / scale), 127), -127) * scale for x in v]

    for block in (4096, 3):
        monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
        for kind, of_query, of_page in (("float", list, list), ("int8", list, codes), ("binary", sign, sign)):
            want = _maxsim_slow(queries, tokens, of_query, of_page)
            got = {(r["query_id"], r["page_id"]): r["total"] for r in vectors.maxsim(t, q, kind).collect()}
            assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)
    assert vectors.maxsim(t, q.limit(0)).count() == 0 and vectors.maxsim(t.limit(0), q).count() == 0


def test_two_stages_recall_the_exact_top(spark):
    rng = random.Random(21)
    width = 48
    pages = {}
    for p in range(250):  # more pages than the first stage keeps; tokens vary within a page
        centre = [rng.gauss(0, 1) for _ in range(width)]
        pages[p] = [[c + rng.gauss(0, 0.7) for c in centre] for _ in range(4)]
    tokens = spark.createDataFrame([(p, i, v) for p, vs in pages.items() for i, v in enumerate(vs)], "page_id long, token_pos int, vec array<double>")
    asked = [(q, 0, [x + rng.gauss(0, 0.3) for x in pages[q * 12][0]]) for q in range(20)]
    queries = spark.createDataFrame(asked, "query_id long, token_pos int, vec array<double>")
    sign = lambda v: [1 if x > 0 else -1 for x in v]
    exact = set()
    for q, _, v in asked:
        scores = {p: max(sum(a * b for a, b in zip(sign(v), sign(t), strict=True)) for t in ts) for p, ts in pages.items()}
        exact |= {(q, p) for p in sorted(scores, key=lambda p: (-scores[p], p))[:3]}
    assert vectors.STAGE1 == 200
    assert len(_top3(vectors.two_stage(tokens, queries, 3)) & exact) / len(exact) >= 0.95


def test_wide_vectors_and_their_signs(spark):
    v = [1.0 if i % 3 else -1.0 for i in range(130)]
    row = spark.createDataFrame([(v, [-x for x in v])], "a array<double>, b array<double>")
    got = row.select(vectors.sign_words(F.col("a")).alias("w"), vectors.hamming_words(vectors.sign_words(F.col("a")), vectors.sign_words(F.col("b"))).alias("d")).first()
    assert len(got["w"]) == 3 and got["d"] == 130
    with pytest.raises(Exception, match="64 elements"):
        row.select(vectors.sign_bits(F.col("a"))).collect()


def test_runs_sessions_and_windows_by_cells(spark):
    rng = random.Random(5)
    at = [(f"k{rng.randrange(2)}", i, rng.randrange(0, 4000)) for i in range(300)] + [(None, 999, 5)]
    df = spark.createDataFrame(at, "k string, id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    want, held = {}, {}
    for k in ("k0", "k1"):
        times = sorted((s, i) for key, i, s in at if key == k)
        for n, (s, _) in enumerate(times):
            if n == 0 or s - times[n - 1][0] >= 20:
                want.setdefault(k, []).append(0)
            want[k][-1] += 1
        last = None
        for s, i in times:
            if last is None or s - last[0] >= 60:
                last = (s, i)
                held[i] = 0
            else:
                held[last[1]] += 1
    got = {}
    for r in events.batch_sessions(df, "k", 20).orderBy("session_start").collect():
        got.setdefault(r["k"], []).append(r["requests"])
    assert got == want
    recent = {(r["k"], r["us"]): r["in_window"] for r in events.recent_requests(df, "k", 60, 100).collect()}
    assert recent == {(k, s * 1_000_000): sum(1 for key, _, x in at if key == k and s - 60 <= x <= s) for k, _, s in at if k}
    assert {r["id"]: r["held"] for r in review.rate_limited_warnings(df, "k").collect()} == held


def test_precheck_notes(spark):
    schema = "question_id string, question string, answerable boolean, slice string, minimal_evidence_spans array<string>, gold_doc_ids array<string>, gold_page_ids array<string>"
    text = "Depo sahibi her girişi aynı gün deftere yazar ve saklar."
    rows = [
        ("ok", "Ne yazılır?", True, "x", ["her girişi  AYNI gün"], ["d"], ["d:1"]), ("other", "Ne?", True, "x", [None], ["e"], ["d:1"]),
        ("missing", "Ne?", True, "x", None, ["d"], ["d:2"]), ("span", "Ne?", True, "x", ["başka söz"], ["d"], ["d:1"]),
        ("close", "depo sahibi girişi deftere yazar", True, "paraphrase", [], ["d"], ["d:1"]), ("scan", "Ne?", True, "x", [], ["d"], ["d:3"]), ("no", "Ne?", False, "x", ["q"], [], []),
    ]
    pages = spark.createDataFrame([("d:1", text), ("d:2", text), ("d:3", " ")], "page_id string, text string")
    got = {r["question_id"]: (r["verdict"], r["notes"]) for r in review.precheck(spark.createDataFrame(rows, schema), pages, pages.where("page_id <> 'd:2'")).collect()}
    assert got == {
        "ok": ("clean", []), "other": ("suspicious", ["other-document"]), "missing": ("suspicious", ["not-indexed"]), "span": ("suspicious", ["span-not-found"]),
        "close": ("suspicious", ["close-to-page"]), "scan": ("manual", []), "no": ("clean", []),
    }


def test_every_question_is_encoded(spark, folder):
    from lexispark.plans import vector_queries

    rows = spark.read.parquet(f"{folder}/bench_questions.parquet").select("question_id", "question").distinct()
    got = vector_queries.hash_encode_questions(spark, folder)
    assert got.count() == 4 * rows.count()
    assert {r[0] for r in got.select("query_id").distinct().collect()} == {r["question_id"] for r in rows.collect()}


def test_filled_search_gives_five_hits_to_every_query(spark, tmp_path):
    from lexispark.plans import lexical_queries

    chunks = [(f"d{i}:m1", "kira borç" if i == 4 else "vergi") for i in range(8)]
    spark.createDataFrame(chunks, "chunk_id string, index_text string").write.parquet(f"{tmp_path}/chunks.parquet")
    asked = [("q20", "kira"), ("q40", "ve")]  # one match, no token
    spark.createDataFrame(asked, "question_id string, question string").write.parquet(f"{tmp_path}/bench_questions.parquet")
    spark.createDataFrame([("d0", "Vergi", "u")], "doc_id string, doc_name string, url string").write.parquet(f"{tmp_path}/manifest.parquet")
    hits = {q: [r["page_id"] for r in lexical_queries.search_hybrid_filled(spark, str(tmp_path)).where(F.col("query_id") == q).orderBy("hit_rank").collect()] for q, _ in asked}
    assert hits["q20"] == ["d4:m1", "d0:m1", "d1:m1", "d2:m1", "d3:m1"]
    assert hits["q40"] == ["d0:m1", "d1:m1", "d2:m1", "d3:m1", "d4:m1"]


def _search_tables(spark, folder, asked):
    chunks = [(f"d{i}:m1", "kira borç" if i == 4 else "vergi") for i in range(12)]
    spark.createDataFrame(chunks, "chunk_id string, index_text string").write.parquet(f"{folder}/chunks.parquet")
    spark.createDataFrame(asked, "question_id string, question string").write.parquet(f"{folder}/bench_questions.parquet")
    spark.createDataFrame([("d4", "Kira", "u"), ("d0", "Ceza", "u")], "doc_id string, doc_name string, url string").write.parquet(f"{folder}/manifest.parquet")


def test_every_question_gets_its_best_chunks(spark, tmp_path):
    from lexispark.plans import lexical_queries

    # numbers that 20 doesn't divide, an id without a number, a question twice, one without a token, one without text
    _search_tables(spark, str(tmp_path), [("q20", "kira"), ("q21", "kira"), ("q21", "kira"), ("qx", "kira"), ("q3", "ve"), ("q7", None)])
    rows = lexical_queries.bm25_top10(spark, str(tmp_path)).orderBy("query_id", "rank").collect()
    hits = {q: [r["page_id"] for r in rows if r["query_id"] == q] for q in {r["query_id"] for r in rows}}
    pages = sorted(f"d{i}:m1" for i in range(12))
    first = ["d4:m1", *[p for p in pages if p != "d4:m1"]][:10]
    assert hits == {"q20": first, "q21": first, "qx": first, "q3": pages[:10], "q7": pages[:10]}


def test_lists_of_hits_are_the_best_pages_in_any_blocks(spark, monkeypatch):
    pages, queries = _random_texts(spark, 300)
    # a page of two rows of one length and one of two lengths
    pages = pages.unionByName(spark.createDataFrame([("d0:0", "kira"), ("d0:0", "ceza"), ("d1:1", "kira ceza"), ("d1:1", "tapu")], pages.schema))
    lists_, terms = lexical.token_lists(pages), lexical.query_terms(queries)
    key = lambda rows: sorted((r["query_id"], r["rank"], r["page_id"], round(r["score"], 9)) for r in rows)
    flat = lambda best: [{"query_id": r["query_id"], "rank": i + 1, **h.asDict()} for r in best.collect() for i, h in enumerate(r["hits"])]
    expected = {n: key(lexical.bm25_best(lists_, terms, n).collect()) for n in (3, 400)}
    clean = lists_.where("page_id not in ('d0:0', 'd1:1')")
    top = key(lexical.bm25_top(clean, terms, queries, 200).collect())
    for postings, dense, queries_a_block in ((4_000_000, 8, 16_384), (100, 2, 5)):
        monkeypatch.setattr(sparse, "POSTINGS", postings)
        monkeypatch.setattr(sparse, "DENSE", dense)
        monkeypatch.setattr(sparse, "QUERY_BLOCK", queries_a_block)
        for n, rows in expected.items():
            assert key(flat(lexical.bm25_lists(lists_, terms, n))) == rows
        assert key(lexical.bm25_filled(clean, terms, queries, 200).collect()) == top
    assert lexical.bm25_lists(lists_.where("false"), terms, 3).count() == 0
    assert lexical.bm25_lists(lists_, terms.where("false"), 3).count() == 0
    assert lexical.bm25_filled(lists_.where("false"), terms, queries, 3).count() == 0


def test_every_question_is_ranked_before_and_after_routing(spark, tmp_path):
    from lexispark.plans import lexical_queries

    # q21 names d4 and d0, which 20 doesn't divide; q3 has no token
    _search_tables(spark, str(tmp_path), [("q20", "borç"), ("q21", "kira vergi ceza"), ("q3", "ve")])
    rows = lexical_queries.route_window(spark, str(tmp_path)).orderBy("query_id", "new_rank").collect()
    got = {q: [(r["page_id"], r["rank"], r["new_rank"], r["routed"]) for r in rows if r["query_id"] == q] for q in {r["query_id"] for r in rows}}
    others = sorted(f"d{i}:m1" for i in range(1, 12) if i != 4)
    assert got["q20"] == [("d4:m1", 1, 1, False)]
    assert got["q21"] == [("d4:m1", 1, 1, True), ("d0:m1", 2, 2, True), *((p, i + 3, i + 3, False) for i, p in enumerate(others))]
    assert set(got) == {"q20", "q21"}


def test_routing_of_lists_equals_that_of_rows(spark):
    pages, queries = _random_texts(spark, 150)
    lists_, terms = lexical.token_lists(pages), lexical.query_terms(queries)
    routed = spark.createDataFrame([("q1", "d3"), ("q1", "d5"), ("q2", "d0"), ("q2", "d0"), ("q3", "none")], "query_id string, doc_id string")
    columns = ["query_id", "page_id", "rank", "new_rank", "routed"]
    want = sorted(map(tuple, lexical.route_window(lexical.bm25_best(lists_, terms, 30), routed, 10).select(columns).collect()))
    got = lexical.route_lists(lexical.bm25_lists(lists_, terms, 30), routed, 10).select(columns)
    assert sorted(map(tuple, got.collect())) == want
    assert any(r["routed"] and r["new_rank"] < r["rank"] for r in got.collect())
