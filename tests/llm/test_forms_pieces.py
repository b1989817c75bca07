"""Problems 3 and 4 against brute force, round trips and edge cases."""

import random
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexispark.llm import pieces
from lexispark.llm.charforms import look_alike_forms, look_alike_pairs, skeleton


def test_skeleton_makes_looks_equal_and_keeps_differences():
    same = [("ｋａｎｕｎ", "kanun"), ("şüre", "şüre"), ("ka​n­un", "kanun"), ("a b c　d", "a b c d"), ("kаnun", "kanun"), ("ΑΒΕ", "ABE"), ("ﬁkra", "fikra"), ("İ", "İ"), ("i̇", "i"), ("ӧ", "ö")]
    for a, b in same:
        assert skeleton(a) == skeleton(b), (a, b)
    for a, b in [("ş", "s"), ("ı", "i"), ("â", "a"), ("A", "a"), ("-", "–"), ("–", "—"), ("1", "l"), ("0", "O"), ("a b", "a  b"), ("a,", "a"), ("x²", "x2")]:
        assert skeleton(a) != skeleton(b), (a, b)
    assert skeleton(None) is None and skeleton("") == "" and skeleton("​") == ""


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_skeleton_is_stable_and_ignores_the_storage_form(text):
    once = skeleton(text)
    assert skeleton(once) == once
    assert skeleton(unicodedata.normalize("NFD", text)) == once


def _pairs(spark, rows):
    df = spark.createDataFrame(rows, "chunk_id string, text string").withColumn("form", F.lit(1)).withColumn("class_id", F.lit("x"))
    forms = look_alike_forms(df, "chunk_id", "text").withColumn("table_name", F.lit("t"))
    return {(r["id_a"], r["id_b"]) for r in look_alike_pairs(forms, ["table_name"]).collect()}


def test_pairs_equal_brute_force(spark):
    rng = random.Random(6)
    forms = ["kanun", "kаnun", "ｋanun", "kanün", "kanün", "Kanun", "", "​"]
    rows = [(f"c{i:02d}", rng.choice(forms)) for i in range(40)] + [("c00", "kanun"), ("n", None), (None, "kanun")]
    texts = [(i, t) for i, t in rows if i is not None and t is not None]
    want = {(a, b) for a, t in texts for b, u in texts if a < b and t != u and skeleton(t) == skeleton(u)}
    assert _pairs(spark, rows) == want
    assert _pairs(spark, []) == set()
    assert _pairs(spark, [(f"c{i}", "aynı") for i in range(500)]) == set()  # copies of one text never meet


def _rebuild(text, parts, overlap):
    return text[: parts[0][1]] + "".join(text[s + overlap : e] for s, e, _ in parts[1:])


def test_pieces_round_trip_and_stay_within_the_limit():
    rng = random.Random(8)
    kinds = ["Madde 3- Kısa bir cümle.", "Uzun bir cümle daha var burada.", "\n", "\n\n", "kelime " * 12, "x" * 700]
    for _ in range(60):
        text = "".join(rng.choice(kinds) + rng.choice([" ", "\n", ""]) for _ in range(rng.randrange(0, 90)))
        for limit, overlap in ((500, 50), (300, 0)):
            parts, _ = pieces.cut_text(text, limit, overlap)
            assert all(0 < e - s <= limit for s, e, _ in parts) or not text
            assert all(b[0] == a[1] - overlap for a, b in zip(parts, parts[1:], strict=False))
            assert _rebuild(text, parts, overlap) == text


def test_cuts_prefer_articles_then_paragraphs_then_sentences():
    body = "Bir cümle burada biter. " * 20
    kind = lambda t: pieces.cut_text(t, 600, 40)[0][1][2]
    assert kind(body + "\nMadde 4- " + body) == pieces.ARTICLE
    assert kind(body + "\n\n" + body) == pieces.PARAGRAPH
    assert kind(body * 2) == pieces.SENTENCE
    assert kind("kelime " * 200) == 0
    assert kind("x" * 2000) == -1


def test_the_deepest_valley_is_chosen():
    a, b = "elma armut kiraz. " * 30, "gemi liman deniz. " * 30
    parts, _ = pieces.cut_text(a + b, 1000, 50)
    assert abs(parts[0][1] - len(a)) <= 1


def test_article_starts():
    text = "\n".join(["Madde 1- x", "  EK MADDE 2 – x", "GECICI MADDE 3 — x", "Mаdde 4 / A- x", "ｍａｄｄｅ 5- x", "m​adde 6- x", "\tMükerrer Madde 7- x",
                      "Madde 8 uyarınca - x", "Maddeler 9-10 x", "9 uncu madde - x", "Madde 11'e göre - x", "bkz. Madde 12- x", "Madde hükmü – x"])
    want = [sum(len(x) + 1 for x in text.split("\n")[:i]) for i in range(7)]
    assert pieces.article_starts(text) == want


def test_split_oversized_edge_cases(spark):
    long = "Madde 1- " + "Bir cümle burada biter. " * 300 + "\nMadde 2- " + "Söz biter. " * 900
    rows = [("a", long, ["k:10", "k:9", None, "k:9"]), ("a", long, ["k:10", "k:9", None, "k:9"]), ("b", "", None), ("c", None, []), ("d", "kısa", ["x"])]
    df = spark.createDataFrame(rows, "chunk_id string, text string, page_ids array<string>").withColumn("piece_no", F.lit("clash"))
    got = pieces.split_oversized(df).collect()
    by = {}
    for r in got:
        by.setdefault(r["chunk_id"], []).append(r)
    assert {tuple(r["page_ids"]) for r in by["a"]} == {("k:9", "k:10")}
    assert len(by["a"]) % 2 == 0 and max(len(r["piece_text"]) for r in by["a"]) <= 5000
    assert {x for r in by["a"] for x in r["article_starts"]} == {0, long.index("Madde 2-")}
    assert by["b"][0]["piece_text"] == "" and by["b"][0]["page_ids"] is None
    assert by["c"][0]["piece_text"] is None and by["d"][0]["piece_text"] == "kısa"
    assert pieces.split_oversized(df.limit(0)).count() == 0


def test_a_stronger_boundary_in_the_lower_half_goes_before_sentences():
    sentence = "Bu hüküm burada uygulanır. "
    for start, kind in (("Madde 4- ", pieces.ARTICLE), ("\nYeni ", pieces.PARAGRAPH)):
        text = sentence * 10 + "\n" + start + sentence * 60
        (_, end, _), (_, _, got) = pieces.cut_text(text, 1000, 50)[0][:2]
        assert got == kind and end == text.index(start.strip()) < 500
    (_, end, _), (_, _, got) = pieces.cut_text(sentence * 60, 1000, 50)[0][:2]
    assert got == pieces.SENTENCE and 500 <= end <= 1000
