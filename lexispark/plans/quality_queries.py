"""Splits, duplicates, reconciliation and rule checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.functions import text as tx
from lexispark.operators import quality
from lexispark.plans.registry import query
from lexispark.plans.views import sql_lower
from lexispark.sources.tables import table


def _bench(spark, folder):
    return table(spark, folder, "bench_questions")


@query("""SELECT verification_status AS status, CASE WHEN verification_kind IS NULL THEN -1 WHEN verification_kind = 'human' THEN 2
WHEN verification_kind = 'model-cross-check' THEN 1 ELSE 0 END AS level, count(*) AS n FROM bench_questions GROUP BY ALL""")
def verification_levels(spark, folder):
    """Questions by status and strength of verification, -1 where the kind is not recorded."""
    level = F.coalesce(quality.verification_level(F.col("verification_kind")), F.lit(-1)).alias("level")
    return _bench(spark, folder).groupBy(F.col("verification_status").alias("status"), level).agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT question_id FROM bench_questions WHERE verification_status = 'verified' AND verification_kind = 'human' AND answerable""")
def verified_answerable(spark, folder):
    """Questions a human verified as answerable."""
    strong = quality.verification_level(F.col("verification_kind")) >= 2
    return _bench(spark, folder).where((F.col("verification_status") == "verified") & strong & F.col("answerable")).select("question_id").distinct()


_TEST = "t AS (SELECT doc_id FROM (SELECT doc_id, doc_type, row_number() OVER (PARTITION BY doc_type ORDER BY sha256('seed|' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY doc_type) AS n FROM (SELECT DISTINCT doc_id, doc_type FROM manifest WHERE doc_id IS NOT NULL)) WHERE k <= greatest(2, n * 0.4))"


def _test_docs(spark, folder):
    """Two fifths of the documents of each type, at least two, in the order of a hash."""
    from pyspark.sql.window import Window

    docs = table(spark, folder, "manifest").where("doc_id is not null").select("doc_id", "doc_type").distinct()
    order = Window.partitionBy("doc_type").orderBy(F.sha2(F.concat(F.lit("seed|"), "doc_id"), 256), "doc_id")
    size = F.count("*").over(Window.partitionBy("doc_type"))
    return docs.withColumn("k", F.row_number().over(order)).withColumn("n", size).where(F.col("k") <= F.greatest(F.lit(2.0), F.col("n") * 0.4)).select("doc_id")


@query(f"WITH {_TEST} SELECT doc_id FROM t")
def test_documents(spark, folder):
    """Documents of the test side, chosen by hash order within their type."""
    return _test_docs(spark, folder)


_HALF = "CASE WHEN CAST(concat('0x', right(sha256({x}), 1)) AS INTEGER) % 2 = 0 THEN 'dev' ELSE 'test' END"


@query(f"""WITH {_TEST}, b AS (SELECT *, CASE WHEN len(gold_doc_ids) > 0 THEN gold_doc_ids[1] END AS g FROM bench_questions),
d AS (SELECT *, coalesce(g, CASE WHEN unanswerable_reason = 'eksik-kanit' THEN subject_doc END) AS doc FROM b)
SELECT DISTINCT question_id, CASE WHEN g IS NOT NULL THEN CASE WHEN doc IN (SELECT doc_id FROM t) THEN 'test' ELSE 'dev' END
WHEN unanswerable_reason = 'korpus-disi' AND anchor_law IS NOT NULL THEN {_HALF.format(x="'anchor:' || anchor_law")}
WHEN doc IS NOT NULL THEN CASE WHEN doc IN (SELECT doc_id FROM t) THEN 'test' ELSE 'dev' END
ELSE {_HALF.format(x="'qid:' || question_id")} END AS assigned FROM d""")
def split_assignment(spark, folder):
    """Split of every question by gold document, anchor, subject or hash."""
    return quality.assign_split(_bench(spark, folder), _test_docs(spark, folder))


@query("""SELECT question_id, group_key, CASE WHEN group_key IS NULL THEN NULL
WHEN CAST(concat('0x', left(sha256('late-calibration-v1:' || group_key), 2)) AS INTEGER) < 170 THEN 'fit' ELSE 'calibration' END AS inner_side FROM calibration_rows""")
def inner_split(spark, folder):
    """Inner split of every calibration row by its group."""
    return table(spark, folder, "calibration_rows").select("question_id", "group_key", quality.inner_split(F.col("group_key")).alias("inner_side"))


_SETS = f"""sets AS (SELECT question_id AS id, list_sort(list_distinct(list_filter(regexp_split_to_array(translate({sql_lower("coalesce(question, '')")}, '{tx.FOLD_FROM}', '{tx.FOLD_TO}'), '[^0-9a-z]+'), lambda w: w <> ''))) AS tokens FROM bench_questions),
cls AS (SELECT tokens, min(id) AS id FROM sets WHERE len(tokens) > 0 GROUP BY tokens)"""


@query(f"WITH {_SETS} SELECT sets.id, cls.id AS class_id FROM sets JOIN cls USING (tokens)")
def duplicate_question_classes(spark, folder):
    """Questions with equal token sets."""
    return quality.duplicate_classes(_bench(spark, folder), "question_id", "question").select("id", "class_id")


@query(f"""WITH {_SETS} SELECT a.id AS id_a, b.id AS id_b, round(len(list_intersect(a.tokens, b.tokens)) / (len(a.tokens) + len(b.tokens) - len(list_intersect(a.tokens, b.tokens))), 6) AS similarity
FROM cls a JOIN cls b ON a.id < b.id WHERE len(list_intersect(a.tokens, b.tokens)) >= 0.8 * (len(a.tokens) + len(b.tokens) - len(list_intersect(a.tokens, b.tokens))) - 1e-9""")
def near_duplicate_questions(spark, folder):
    """Links between classes of questions with a Jaccard similarity of 0.8 or more."""
    out = quality.near_duplicates(_bench(spark, folder), "question_id", "question")
    return out.select("id_a", "id_b", F.round("similarity", 6).alias("similarity"))


def _reconcile_sql(a: str, b: str) -> str:
    return f"""SELECT (SELECT count(*) FROM (({a}) INTERSECT ({b}))) AS "both", (SELECT count(*) FROM (({a}) EXCEPT ({b}))) AS only_left, (SELECT count(*) FROM (({b}) EXCEPT ({a}))) AS only_right"""


@query(_reconcile_sql("SELECT doc_id FROM manifest WHERE doc_id IS NOT NULL", "SELECT doc_id FROM chunks WHERE doc_id IS NOT NULL"))
def manifest_reconciliation(spark, folder):
    """Documents of the manifest against documents with chunks."""
    return quality.reconcile(table(spark, folder, "manifest"), table(spark, folder, "chunks"), "doc_id")


@query(_reconcile_sql("SELECT chunk_id FROM article_markers WHERE chunk_id IS NOT NULL", "SELECT chunk_id FROM chunks WHERE chunk_id IS NOT NULL"))
def marker_reconciliation(spark, folder):
    """Chunks with markers against chunks."""
    return quality.reconcile(table(spark, folder, "article_markers"), table(spark, folder, "chunks"), "chunk_id")


@query("""WITH v AS (SELECT question_id, coalesce(gold_page_ids, []) AS gp, coalesce(gold_doc_ids, []) AS gd, trim(coalesce(reference_answer, '')) AS ref, answerable, unanswerable_reason, verification_status, verified_by FROM bench_questions)
SELECT DISTINCT question_id, rule FROM (
SELECT question_id, 'answerable-without-gold' AS rule FROM v WHERE answerable AND len(gp) = 0
UNION ALL SELECT question_id, 'answerable-without-reference' FROM v WHERE answerable AND ref = ''
UNION ALL SELECT question_id, 'answerable-with-reason' FROM v WHERE answerable AND unanswerable_reason IS NOT NULL
UNION ALL SELECT question_id, 'unanswerable-with-gold' FROM v WHERE NOT answerable AND len(gp) > 0
UNION ALL SELECT question_id, 'unanswerable-without-reason' FROM v WHERE NOT answerable AND unanswerable_reason IS NULL
UNION ALL SELECT question_id, 'gold-page-without-number' FROM v WHERE len(list_filter(gp, lambda p: NOT contains(p, ':'))) > 0
UNION ALL SELECT question_id, 'gold-page-of-other-doc' FROM v WHERE len(list_filter(gp, lambda p: NOT list_contains(gd, split_part(p, ':', 1)))) > 0
UNION ALL SELECT question_id, 'verified-by-nobody' FROM v WHERE verification_status = 'verified' AND verified_by IS NULL)""")
def question_violations(spark, folder):
    """Broken rules of the question table."""
    return quality.question_violations(_bench(spark, folder))


@query(f"""WITH c AS (SELECT page_id, string_agg(text, chr(10) ORDER BY chunk_id) AS text FROM (SELECT DISTINCT chunk_id, text, unnest(page_ids) AS page_id FROM chunks) GROUP BY page_id),
q AS (SELECT DISTINCT question_id, gold_page_ids, minimal_evidence_spans FROM bench_questions),
s AS (SELECT question_id, unnest(gold_page_ids) AS page_id, minimal_evidence_spans FROM q),
e AS (SELECT question_id, page_id, unnest(minimal_evidence_spans) AS span FROM s)
SELECT question_id, page_id, count(*) AS spans, count(CASE WHEN contains(trim(regexp_replace({sql_lower("coalesce(c.text, '')")}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), trim(regexp_replace({sql_lower("coalesce(span, '')")}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) THEN 1 END) AS found
FROM e LEFT JOIN c USING (page_id) GROUP BY ALL""")
def span_precheck(spark, folder):
    """Evidence spans of each question and gold page, and how many stand in the page's text."""
    pieces = table(spark, folder, "chunks").select("chunk_id", "text", F.explode("page_ids").alias("page_id")).distinct()
    # a page's chunks are few
    joined = pieces.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))).alias("c"))
    pages = joined.select("page_id", F.array_join(F.transform("c", lambda s: s["text"]), "\n").alias("text"))
    asked = _bench(spark, folder).select("question_id", "gold_page_ids", "minimal_evidence_spans").distinct()
    spans = asked.select("question_id", F.explode("gold_page_ids").alias("page_id"), "minimal_evidence_spans").select(
        "question_id", "page_id", F.explode("minimal_evidence_spans").alias("span")
    )
    return spans.join(pages, "page_id", "left").groupBy("question_id", "page_id").agg(
        F.count("*").alias("spans"), F.count_if(tx.span_in(F.col("span"), F.col("text"))).alias("found")
    )


@query(f"""SELECT DISTINCT question_id, sha256(coalesce(question, '')) AS fingerprint, left(sha256(coalesce(question, '')), 12) AS short,
trim(regexp_replace({sql_lower("coalesce(question, '')")}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS normal FROM bench_questions""")
def question_fingerprints(spark, folder):
    """Content hashes and the normalised form of every question."""
    q = F.coalesce("question", F.lit(""))
    return _bench(spark, folder).select(
        "question_id", F.sha2(q, 256).alias("fingerprint"), tx.hash_prefix(q, 12).alias("short"), tx.squeeze_blanks(tx.tr_lower(q)).alias("normal")
    ).distinct()


_GROUP = """CASE WHEN len(gold_doc_ids) > 0 THEN 'doc:' || gold_doc_ids[1] WHEN unanswerable_reason = 'korpus-disi' AND coalesce(anchor_law, '') <> '' THEN 'anchor:' || anchor_law
WHEN unanswerable_reason = 'eksik-kanit' AND coalesce(subject_doc, '') <> '' THEN 'doc:' || subject_doc ELSE 'qid:' || question_id END"""


@query(f"""WITH g AS (SELECT DISTINCT question_id, {_GROUP} AS group_key FROM bench_questions)
SELECT question_id, group_key, CASE WHEN CAST(concat('0x', left(sha256('late-calibration-v1:' || group_key), 2)) AS INTEGER) < 170 THEN 'fit' ELSE 'calibration' END AS inner_side FROM g""")
def question_groups(spark, folder):
    """Group of every question and the inner split of its group."""
    rows = _bench(spark, folder).select("question_id", quality.question_group_key().alias("group_key")).distinct()
    return rows.withColumn("inner_side", quality.inner_split(F.col("group_key")))


_PINNED, _SIZE = ["k101", "k102"], 12
_DERIVED = f"""blocked AS (SELECT DISTINCT subject_doc AS doc_id FROM bench_questions WHERE subject_doc IS NOT NULL AND verification_kind = 'human'),
docs AS (SELECT doc_id, min(doc_type) AS doc_type FROM manifest WHERE doc_id IS NOT NULL GROUP BY 1), own AS (SELECT * FROM docs WHERE doc_id IN ('k101', 'k102')),
free AS (SELECT *, sha256('seed|' || doc_id) AS h FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM own) AND doc_id NOT IN (SELECT doc_id FROM blocked) AND doc_id NOT IN ('k101', 'k102')),
need AS (SELECT greatest(2 - count(CASE WHEN doc_type = 'rg_tarihi' THEN 1 END), 0) AS scarce, count(*) AS pinned FROM own),
derived AS (SELECT doc_id FROM own UNION ALL SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY h, doc_id) AS k FROM free WHERE doc_type = 'rg_tarihi'), need WHERE k <= scarce
UNION ALL SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY h, doc_id) AS k FROM free WHERE doc_type IS DISTINCT FROM 'rg_tarihi'), need WHERE k <= greatest({_SIZE} - pinned - scarce, 0))"""


def _derived(spark, folder):
    blocked = _bench(spark, folder).where("subject_doc is not null and verification_kind = 'human'").select("subject_doc").distinct()
    ids = [r[0] for r in blocked.collect()]  # documents that a human chose as subject: a handful
    return quality.derive_test_docs(table(spark, folder, "manifest"), "seed", _PINNED, ids, _SIZE)


@query(f"WITH {_DERIVED} SELECT doc_id FROM derived")
def derived_test_documents(spark, folder):
    """Test documents: two pinned, subject documents blocked, filled to twelve in hash order with two gazettes."""
    return _derived(spark, folder)


@query(f"""WITH {_DERIVED}, q AS (SELECT DISTINCT question_id, CASE WHEN len(gold_doc_ids) > 0 THEN gold_doc_ids[1] END AS g FROM bench_questions)
SELECT DISTINCT question_id, CASE WHEN g IS NULL THEN {_HALF.format(x='question_id')} WHEN g IN (SELECT doc_id FROM derived) THEN 'test' ELSE 'dev' END AS assigned FROM q""")
def question_split(spark, folder):
    """Side of every question by its first gold document, else by the parity of its hash."""
    return quality.question_split(_bench(spark, folder), _derived(spark, folder))


_FOLDED = lambda x: f"list_distinct(list_filter(regexp_split_to_array(translate({sql_lower(f'coalesce({x}, chr(32))')}, '{tx.FOLD_FROM}', '{tx.FOLD_TO}'), '[^0-9a-z]+'), lambda w: w <> ''))"


@query(f"""WITH s AS (SELECT question_id AS id, answerable, list_sort({_FOLDED('question')}) AS tokens FROM bench_questions WHERE answerable IS NOT NULL),
a AS (SELECT tokens, min(id) AS id FROM s WHERE NOT answerable AND len(tokens) > 0 GROUP BY tokens), b AS (SELECT tokens, min(id) AS id FROM s WHERE answerable AND len(tokens) > 0 GROUP BY tokens),
p AS (SELECT a.id AS id_a, b.id AS id_b, len(list_intersect(a.tokens, b.tokens)) AS i, len(a.tokens) AS n, len(b.tokens) AS m FROM a, b WHERE len(list_intersect(a.tokens, b.tokens)) > 0)
SELECT id_a, id_b, round(i / (n + m - i), 6) AS similarity FROM p WHERE i / (n + m - i) >= 0.3 - 1e-12""")
def near_reference_questions(spark, folder):
    """Unanswerable questions near an answerable one (at 0.3: no two are closer by chance)."""
    q = _bench(spark, folder)
    out = quality.near_reference(q.where("not answerable"), q.where("answerable"), "question_id", "question", 0.3)
    return out.select("id_a", "id_b", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH n AS (SELECT DISTINCT anchor_name || ' Kanunu' AS name FROM bench_questions WHERE anchor_name IS NOT NULL), a AS (SELECT name, {_FOLDED('name')} AS t FROM n),
c AS (SELECT DISTINCT doc_id, {_FOLDED('doc_name')} AS t FROM manifest WHERE doc_name IS NOT NULL), p AS (SELECT name, doc_id, len(list_intersect(a.t, c.t)) AS i, len(a.t) AS x, len(c.t) AS y FROM a, c WHERE len(list_intersect(a.t, c.t)) > 0)
SELECT name, arg_min(doc_id, struct_pack(s := -(i / (x + y - i)), d := doc_id)) AS doc_id, round(max(i / (x + y - i)), 6) AS similarity FROM p GROUP BY name""")
def anchor_names(spark, folder):
    """The corpus name most like the name of each anchor law (written as a law's name): none may be the same law."""
    names = _bench(spark, folder).where("anchor_name is not null").select(F.concat("anchor_name", F.lit(" Kanunu")).alias("name"))
    corpus = table(spark, folder, "manifest").select("doc_id", F.col("doc_name").alias("name"))
    return quality.closest_names(names, corpus).select("name", "doc_id", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH d AS (SELECT DISTINCT doc_id FROM manifest WHERE doc_id IS NOT NULL), q AS (SELECT *, {_FOLDED('question')} AS w, {_FOLDED('anchor_name')} AS a FROM bench_questions WHERE unanswerable_reason IS NOT NULL),
r AS (SELECT question_id, unnest(list_filter([CASE WHEN answerable IS NULL OR answerable THEN 'answerable' END, CASE WHEN len(coalesce(gold_doc_ids, [])) > 0 THEN 'gold_doc_ids-not-empty' END,
CASE WHEN len(coalesce(gold_page_ids, [])) > 0 THEN 'gold_page_ids-not-empty' END, CASE WHEN len(coalesce(gold_article_ids, [])) > 0 THEN 'gold_article_ids-not-empty' END,
CASE WHEN len(coalesce(minimal_evidence_spans, [])) > 0 THEN 'minimal_evidence_spans-not-empty' END, CASE WHEN trim(coalesce(reference_answer, '')) <> '' THEN 'reference-not-empty' END,
CASE WHEN coalesce(requires_visual, false) OR coalesce(requires_multi_hop, false) THEN 'visual-or-multi-hop' END, CASE WHEN trim(coalesce(verification_note, '')) = '' THEN 'no-verification-note' END,
CASE WHEN (slice = 'korpus-disi' AND unanswerable_reason IS DISTINCT FROM 'korpus-disi') OR (slice = 'eksik-kanit' AND unanswerable_reason IS DISTINCT FROM 'eksik-kanit') OR (slice = 'anlamsiz-ood' AND unanswerable_reason IS DISTINCT FROM 'anlamsiz') THEN 'reason-of-other-slice' END,
CASE WHEN slice = 'korpus-disi' AND (anchor_law IS NULL OR anchor_name IS NULL) THEN 'no-anchor' END,
CASE WHEN slice = 'korpus-disi' AND anchor_law IS NOT NULL AND anchor_name IS NOT NULL AND 'k' || anchor_law IN (SELECT doc_id FROM d) THEN 'anchor-in-corpus' END,
CASE WHEN slice = 'korpus-disi' AND anchor_law IS NOT NULL AND anchor_name IS NOT NULL AND NOT (list_contains(w, anchor_law) OR (len(a) > 0 AND len(list_filter(a, lambda x: NOT list_contains(w, x))) = 0)) THEN 'anchor-not-in-question' END,
CASE WHEN slice = 'eksik-kanit' AND subject_doc IS NULL THEN 'no-subject' END, CASE WHEN slice = 'eksik-kanit' AND subject_doc IS NOT NULL AND subject_doc NOT IN (SELECT doc_id FROM d) THEN 'subject-not-in-corpus' END], lambda x: x IS NOT NULL)) AS rule FROM q)
SELECT DISTINCT question_id, rule FROM r""")
def abstention_violations(spark, folder):
    """Broken rules of the unanswerable questions."""
    rows = _bench(spark, folder).where("unanswerable_reason is not null")
    return quality.abstention_violations(rows, table(spark, folder, "manifest"))


_FLIPPED = "CASE WHEN CAST(substr(question_id, 2) AS BIGINT) % 7 = 0 THEN NOT answerable ELSE answerable END"


@query(f"""WITH v AS (SELECT question_id, coalesce(gold_page_ids, []) AS gp, CASE WHEN CAST(substr(question_id, 2) AS BIGINT) % 5 = 0 THEN [] ELSE coalesce(gold_doc_ids, []) END AS gd, trim(coalesce(reference_answer, '')) AS ref, {_FLIPPED} AS answerable, unanswerable_reason,
verification_status, CASE WHEN CAST(substr(question_id, 2) AS BIGINT) % 11 <> 0 THEN verified_by END AS verified_by FROM bench_questions)
SELECT DISTINCT question_id, rule FROM (
SELECT question_id, 'answerable-without-gold' AS rule FROM v WHERE answerable AND len(gp) = 0
UNION ALL SELECT question_id, 'answerable-without-reference' FROM v WHERE answerable AND ref = ''
UNION ALL SELECT question_id, 'answerable-with-reason' FROM v WHERE answerable AND unanswerable_reason IS NOT NULL
UNION ALL SELECT question_id, 'unanswerable-with-gold' FROM v WHERE NOT answerable AND len(gp) > 0
UNION ALL SELECT question_id, 'unanswerable-without-reason' FROM v WHERE NOT answerable AND unanswerable_reason IS NULL
UNION ALL SELECT question_id, 'gold-page-without-number' FROM v WHERE len(list_filter(gp, lambda p: NOT contains(p, ':'))) > 0
UNION ALL SELECT question_id, 'gold-page-of-other-doc' FROM v WHERE len(list_filter(gp, lambda p: NOT list_contains(gd, split_part(p, ':', 1)))) > 0
UNION ALL SELECT question_id, 'verified-by-nobody' FROM v WHERE verification_status = 'verified' AND verified_by IS NULL)""")
def planted_violations(spark, folder):
    """Broken rules of a question table in which every seventh answer mark is turned, every fifth question has lost its gold
    documents and every eleventh its verifier."""
    n = F.substring("question_id", 2, 20).cast("long")
    rows = _bench(spark, folder).withColumn("answerable", F.when(n % 7 == 0, ~F.col("answerable")).otherwise(F.col("answerable")))
    rows = rows.withColumn("gold_doc_ids", F.when(n % 5 == 0, F.array().cast("array<string>")).otherwise(F.col("gold_doc_ids")))
    return quality.question_violations(rows.withColumn("verified_by", F.when(n % 11 != 0, F.col("verified_by"))))


@query("""WITH t AS (SELECT DISTINCT score_scale AS scale, top_score AS threshold FROM request_events WHERE top_score IS NOT NULL AND NOT isnan(top_score) AND score_scale IS NOT NULL)
SELECT scale, threshold, CASE WHEN scale = 'hybrid-bm25' AND threshold > 0 AND threshold <= 1.5 THEN 'looks normalised' WHEN scale = 'hybrid-bm25' AND threshold > 200 THEN 'too large' WHEN scale = 'visual-normalized' AND threshold > 1.5 THEN 'looks like BM25' END AS problem FROM t""")
def threshold_guard(spark, folder):
    """Every score that was ever the best, taken as a threshold on its scale."""
    rows = table(spark, folder, "request_events").where("top_score is not null and not isnan(top_score) and score_scale is not null")
    given = rows.select(F.col("score_scale").alias("scale"), F.col("top_score").alias("threshold")).distinct()
    return given.withColumn("problem", quality.threshold_violation(F.col("scale"), F.col("threshold")))
