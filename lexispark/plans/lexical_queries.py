"""Text channel: tokens, statistics, BM25, routing, search, confidence features."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.cluster import checkpointed
from lexispark.functions.text import page_doc
from lexispark.operators import lexical, lists
from lexispark.plans.registry import query
from lexispark.plans.views import ALL_QUESTIONS_SQL, HITS_SQL, QUESTIONS_SQL, UNITS_SQL, VISUAL_SQL, all_questions, hit_list, search_questions, sql_tokens, units
from lexispark.sources.tables import table

_TERMS = f"""qt AS (SELECT query_id, token, least(count(*), {lexical.QUERY_TERM_CAP}) AS qtf
    FROM (SELECT query_id, unnest({sql_tokens('text')}) AS token FROM qs) GROUP BY ALL)"""
_BM25 = f"""WITH {UNITS_SQL}, {QUESTIONS_SQL}, {_TERMS},
lists AS (SELECT page_id, {sql_tokens('text')} AS tokens FROM units),
stats AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM lists),
tf AS (SELECT page_id, len(tokens) AS dl, token, count(*) AS tf FROM (SELECT page_id, tokens, unnest(tokens) AS token FROM lists) GROUP BY page_id, len(tokens), token),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
scores AS (
    SELECT query_id, page_id, count(*) AS matched,
           sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {lexical.K1 + 1} / (tf + {lexical.K1} * (1 - {lexical.B} + {lexical.B} * dl / avgdl))) AS score
    FROM qt JOIN tf USING (token) JOIN df USING (token), stats GROUP BY query_id, page_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, page_id) AS rank FROM scores)"""
_ROUTED = f"""names AS (
    SELECT DISTINCT doc_id, list_distinct(list_filter({sql_tokens('doc_name')}, lambda w: w NOT IN ('kanun', 'türk', 'türki', 'cumhu'))) AS names FROM manifest),
need AS (SELECT DISTINCT doc_id, list_sort(names) AS names, len(names) AS need, unnest(names) AS token FROM names WHERE len(names) > 0),
routed AS (
    SELECT DISTINCT query_id, doc_id FROM (
        SELECT query_id, doc_id, names, need, count(*) AS got FROM qt JOIN need USING (token) GROUP BY ALL) WHERE got = need)"""


def _inputs(spark, folder):
    questions = search_questions(spark, folder)
    return lexical.token_lists(units(spark, folder)), checkpointed(lexical.query_terms(questions)), questions


def _routed(spark, folder, terms):
    return lexical.routed_docs(lexical.name_tokens(table(spark, folder, "manifest")), terms)


@query(f"""WITH {UNITS_SQL} SELECT page_id, len(tokens) AS dl, len(list_distinct(tokens)) AS n_distinct
FROM (SELECT page_id, {sql_tokens('text')} AS tokens FROM units)""")
def token_counts(spark, folder):
    """Length and distinct tokens of every chunk."""
    lists = lexical.token_lists(units(spark, folder))
    return lists.select("page_id", "dl", F.size(F.array_distinct("tokens")).alias("n_distinct"))


@query(f"""WITH {UNITS_SQL}, lists AS (SELECT {sql_tokens('text')} AS tokens FROM units),
df AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS token FROM lists) GROUP BY token)
SELECT token, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, (SELECT count(*) AS n FROM lists)""")
def term_statistics(spark, folder):
    """Document frequency and idf of every token."""
    stats = lexical.term_stats(lexical.token_lists(units(spark, folder)))
    return stats.select("token", "df", F.round("idf", 6).alias("idf"))


@query(f"""WITH {UNITS_SQL} SELECT count(*) AS n_pages, round(coalesce(nullif(avg(len({sql_tokens('text')})), 0), 1), 6) AS avgdl FROM units""")
def corpus_statistics(spark, folder):
    """Number of chunks and their mean length."""
    return lexical.corpus_stats(lexical.token_lists(units(spark, folder))).select("n_pages", F.round("avgdl", 6).alias("avgdl"))


@query(f"""{_BM25.replace(QUESTIONS_SQL, ALL_QUESTIONS_SQL)}, filled AS (
    SELECT query_id, page_id, score FROM scores
    UNION ALL SELECT qs.query_id, units.page_id, 0 FROM qs CROSS JOIN units
    WHERE NOT EXISTS (SELECT 1 FROM scores s WHERE s.query_id = qs.query_id AND s.page_id = units.page_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, page_id) AS rank FROM filled)
SELECT query_id, page_id, rank, round(score, 6) AS score FROM placed WHERE rank <= 10""")
def bm25_top10(spark, folder):
    """The ten best chunks of every question; chunks without a match fill up with score 0."""
    questions = all_questions(spark, folder)
    terms = checkpointed(lexical.query_terms(questions))
    return lexical.bm25_filled(lexical.token_lists(units(spark, folder)), terms, questions, 10).select("query_id", "page_id", "rank", F.round("score", 6).alias("score"))


@query(f"""WITH names AS (SELECT DISTINCT doc_id, unnest(list_distinct(list_filter({sql_tokens('doc_name')}, lambda w: w NOT IN ('kanun', 'türk', 'türki', 'cumhu')))) AS token FROM manifest)
SELECT DISTINCT doc_id, token FROM names""")
def doc_name_tokens(spark, folder):
    """Distinct tokens of document names."""
    return lexical.name_tokens(table(spark, folder, "manifest")).select("doc_id", F.explode("names").alias("token")).distinct()


@query(f"WITH {QUESTIONS_SQL}, {_TERMS}, {_ROUTED} SELECT query_id, doc_id FROM routed")
def routed_documents(spark, folder):
    """Documents whose whole name stands in the query."""
    return _routed(spark, folder, lexical.query_terms(search_questions(spark, folder))).distinct()


_WINDOW = f"""{_BM25}, {_ROUTED},
flagged AS (
    SELECT r.*, x.doc_id IS NOT NULL AS routed FROM ranked r
    LEFT JOIN routed x ON x.query_id = r.query_id AND x.doc_id = split_part(r.page_id, ':', 1)),
moved AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank > {lexical.ROUTE_WINDOW} THEN 2 WHEN routed THEN 0 ELSE 1 END, rank) AS new_rank
    FROM flagged WHERE rank <= 200)"""


def _moved(spark, folder, limit=200):
    units_, terms, _ = _inputs(spark, folder)
    ranked = checkpointed(lexical.bm25_best(units_, terms, limit))
    return lexical.route_window(ranked, _routed(spark, folder, terms))


@query(_WINDOW.replace(QUESTIONS_SQL, ALL_QUESTIONS_SQL) + " SELECT query_id, page_id, rank, new_rank, routed FROM moved")
def route_window(spark, folder):
    """Ranks up to 200 of every question before and after routing."""
    terms = checkpointed(lexical.query_terms(all_questions(spark, folder)))
    best = lexical.bm25_lists(lexical.token_lists(units(spark, folder)), terms, 200)
    return lexical.route_lists(best, _routed(spark, folder, terms)).select("query_id", "page_id", "rank", "new_rank", "routed")


@query(f"""{_WINDOW}, meta AS (SELECT doc_id, min(doc_name) AS doc_name, min(url) AS source_url FROM manifest GROUP BY doc_id)
SELECT query_id, page_id, new_rank AS hit_rank, round(score, 6) AS score, doc_name, source_url, score >= {lexical.SCORE_FLOOR} AS above_floor
FROM moved LEFT JOIN meta ON meta.doc_id = split_part(page_id, ':', 1) WHERE new_rank <= 5""")
def search_hybrid(spark, folder):
    """Five best chunks of every query after routing, with the metadata of their document.

    As in the SQL only chunks that share a token with the query are ranked, so a query may have fewer than five hits;
    ``search_hybrid_filled`` ranks all chunks.
    """
    return _served(_moved(spark, folder, lexical.ROUTE_WINDOW), spark, folder)  # no page beyond the window comes into it


def _served(moved, spark, folder):
    hits = moved.where("new_rank <= 5").withColumn("doc_id", page_doc(F.col("page_id")))
    meta = table(spark, folder, "manifest").groupBy("doc_id").agg(F.min("doc_name").alias("doc_name"), F.min("url").alias("source_url"))
    return hits.join(meta, "doc_id", "left").select(
        "query_id", "page_id", F.col("new_rank").alias("hit_rank"), F.round("score", 6).alias("score"), "doc_name", "source_url",
        (F.col("score") >= lexical.SCORE_FLOOR).alias("above_floor"),
    )


@query(f"""{_BM25}, {_ROUTED}, filled AS (
    SELECT query_id, page_id, score FROM scores
    UNION ALL SELECT qs.query_id, units.page_id, 0 FROM qs CROSS JOIN units
    WHERE NOT EXISTS (SELECT 1 FROM scores s WHERE s.query_id = qs.query_id AND s.page_id = units.page_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, page_id) AS rank FROM filled),
flagged AS (
    SELECT r.*, x.doc_id IS NOT NULL AS routed FROM placed r
    LEFT JOIN routed x ON x.query_id = r.query_id AND x.doc_id = split_part(r.page_id, ':', 1)),
moved AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank > {lexical.ROUTE_WINDOW} THEN 2 WHEN routed THEN 0 ELSE 1 END, rank) AS new_rank
    FROM flagged WHERE rank <= 200),
meta AS (SELECT doc_id, min(doc_name) AS doc_name, min(url) AS source_url FROM manifest GROUP BY doc_id)
SELECT query_id, page_id, new_rank AS hit_rank, round(score, 6) AS score, doc_name, source_url, score >= {lexical.SCORE_FLOOR} AS above_floor
FROM moved LEFT JOIN meta ON meta.doc_id = split_part(page_id, ':', 1) WHERE new_rank <= 5""")
def search_hybrid_filled(spark, folder):
    """The same search over all chunks: those without a match score 0 and fill the ranks by page id before routing."""
    units_, terms, questions = _inputs(spark, folder)
    ranked = checkpointed(lexical.bm25_top(units_, terms, questions, lexical.ROUTE_WINDOW))  # no page beyond comes into it
    return _served(lexical.route_window(ranked, _routed(spark, folder, terms)), spark, folder)


@query(f"""{_BM25}, {_ROUTED}, top AS (
    SELECT query_id, max(CASE WHEN rank = 1 THEN score END) AS s1, max(CASE WHEN rank = 2 THEN score END) AS s2,
           max(CASE WHEN rank = 1 THEN matched END) AS m FROM ranked WHERE rank <= 2 GROUP BY query_id),
size AS (SELECT query_id, count(*) AS n FROM qt GROUP BY query_id)
SELECT query_id, round(coalesce(s1, 0), 6) AS served_top1, round(CASE WHEN s2 IS NULL THEN 0 ELSE s1 - s2 END, 6) AS bm25_margin,
       coalesce(m, 0) AS matched_terms_top1, round(coalesce(coalesce(m, 0) / n, 0), 6) AS matched_frac,
       CASE WHEN query_id IN (SELECT query_id FROM routed) THEN 1 ELSE 0 END AS routed
FROM (SELECT DISTINCT query_id FROM qs) LEFT JOIN size USING (query_id) LEFT JOIN top USING (query_id)""")
def confidence_features(spark, folder):
    """Five confidence features of every query of the query set."""
    units_, terms, questions = _inputs(spark, folder)
    out = lexical.confidence_features(checkpointed(lexical.bm25_best(units_, terms, 2)), _routed(spark, folder, terms), terms, questions)
    return out.select(
        "query_id", *[F.round(c, 6).alias(c) for c in ("served_top1", "bm25_margin")], "matched_terms_top1",
        F.round("matched_frac", 6).alias("matched_frac"), "routed",
    )


# questions of the query set that name their gold document, so that routing has something to route
_NAMED = """qs AS (SELECT q.question_id AS query_id, min(m.doc_name || ' ' || q.question) AS text
    FROM bench_questions q JOIN manifest m ON m.doc_id = q.gold_doc_ids[1] WHERE CAST(substr(question_id, 2) AS BIGINT) % 20 = 0 AND m.doc_name IS NOT NULL AND q.question IS NOT NULL GROUP BY 1)"""


def _named_questions(spark, folder):
    rows = table(spark, folder, "bench_questions").where(F.substring("question_id", 2, 20).cast("long") % 20 == 0)
    names = table(spark, folder, "manifest").where("doc_name is not null").select(F.col("doc_id").alias("_doc"), "doc_name")
    asked = rows.where("question is not null").select("question_id", "question", F.get("gold_doc_ids", F.lit(0)).alias("_doc")).join(names, "_doc")
    return asked.groupBy(F.col("question_id").alias("query_id")).agg(F.min(F.concat_ws(" ", "doc_name", "question")).alias("text"))


@query(f"WITH {_NAMED}, {_TERMS}, {_ROUTED} SELECT query_id, doc_id FROM routed")
def routed_named_documents(spark, folder):
    """Documents whose whole name stands in a question that names its gold document."""
    return _routed(spark, folder, lexical.query_terms(_named_questions(spark, folder))).distinct()


@query(_WINDOW.replace(QUESTIONS_SQL, _NAMED) + " SELECT query_id, page_id, rank, new_rank, routed FROM moved")
def route_window_named(spark, folder):
    """Ranks before and after routing for questions that name their gold document."""
    asked = _named_questions(spark, folder)
    terms = checkpointed(lexical.query_terms(asked))
    ranked = checkpointed(lexical.bm25_best(lexical.token_lists(units(spark, folder)), terms, 200))
    return lexical.route_window(ranked, _routed(spark, folder, terms)).select("query_id", "page_id", "rank", "new_rank", "routed")


_TITLES = """lines AS (SELECT doc_id, trim(l, ' ' || chr(9) || chr(13)) AS title FROM (SELECT split_part(page_id, ':', 1) AS doc_id, unnest(string_split(text, chr(10))) AS l FROM documents WHERE page_id IS NOT NULL)),
best AS (SELECT doc_id, arg_min(title, struct_pack(a := -length(title), b := title)) AS title FROM lines
    WHERE regexp_full_match(title, '[A-ZÇĞİÖŞÜÂÎÛ0-9 ()''’.,;:-]{8,}') AND (contains(title, 'KANUN') OR contains(title, 'ANAYASA')) GROUP BY doc_id)"""


@query(f"""WITH {_TITLES}, n AS (SELECT doc_id, unnest(list_distinct(list_filter({sql_tokens('title')}, lambda w: w NOT IN ('kanun', 'türk', 'türki', 'cumhu')))) AS token FROM best)
SELECT doc_id, token FROM n""")
def title_name_tokens(spark, folder):
    """Name tokens of documents out of the title lines of their pages (of any page: few first pages are in the table)."""
    pages = table(spark, folder, "documents").where("page_id is not null").select("page_id", "text")
    return lexical.title_names(pages, first_only=False).select("doc_id", F.explode("names").alias("token"))


_FULL = f"""{_BM25}, {HITS_SQL}, {VISUAL_SQL}, {_ROUTED},
on_page AS (SELECT query_id, pg.page_id, max(score) AS score FROM scores JOIN (SELECT DISTINCT chunk_id, unnest(page_ids) AS page_id FROM chunks WHERE chunk_id IS NOT NULL) pg ON pg.chunk_id = scores.page_id WHERE pg.page_id IS NOT NULL GROUP BY ALL),
ranks AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, page_id) AS rank FROM on_page),
moved AS (SELECT query_id, page_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank > {lexical.ROUTE_WINDOW} THEN 2 WHEN routed THEN 0 ELSE 1 END, rank) AS rank FROM (
    SELECT r.*, x.doc_id IS NOT NULL AS routed FROM ranks r LEFT JOIN routed x ON x.query_id = r.query_id AND x.doc_id = split_part(r.page_id, ':', 1) WHERE rank <= 200)),
l0 AS (SELECT * FROM moved)"""


def _fold_sql(k: int, other: str) -> str:
    """One late channel woven into list ``l<k>``."""
    return f""", a{k} AS (SELECT query_id, page_id, rank, 0 AS src FROM l{k} UNION ALL SELECT query_id, page_id, rank, 1 FROM {other} WHERE rank <= 50 AND query_id IN (SELECT query_id FROM l0)),
n{k} AS (SELECT query_id, least(coalesce(max(CASE WHEN src = 0 THEN rank END), 0), coalesce(max(CASE WHEN src = 1 THEN rank END), 0)) AS paired FROM a{k} GROUP BY query_id),
o{k} AS (SELECT query_id, page_id, CASE WHEN rank <= paired THEN 0 ELSE 1 END AS k1, CASE WHEN rank <= paired THEN rank ELSE src END AS k2, CASE WHEN rank <= paired THEN src ELSE rank END AS k3 FROM a{k} JOIN n{k} USING (query_id)),
f{k} AS (SELECT *, row_number() OVER (PARTITION BY query_id, page_id ORDER BY k1, k2, k3) AS nth FROM o{k}),
l{k + 1} AS (SELECT query_id, page_id, row_number() OVER (PARTITION BY query_id ORDER BY k1, k2, k3) AS rank FROM f{k} WHERE nth = 1)"""


@query(f"""{_FULL}{_fold_sql(0, 'visual')}{_fold_sql(1, 'hits')}, vs AS (SELECT query_id, page_id, max(visual_score) AS visual_score FROM page_hits WHERE NOT isnan(visual_score) GROUP BY ALL)
SELECT l2.query_id, l2.page_id, l2.rank AS hit_rank, round(coalesce(score, 0), 6) AS score, round(visual_score, 6) AS visual_score
FROM l2 LEFT JOIN on_page USING (query_id, page_id) LEFT JOIN vs USING (query_id, page_id) WHERE l2.rank <= 5""")
def search_late(spark, folder):
    """The whole search by pages: BM25 of the best chunk on a page, routing, then two late channels woven in one after the
    other; the first page stays first, visual scores are shown and rank nothing of the text channel."""
    units_, terms, _ = _inputs(spark, folder)
    pages = lists.pages_of_chunks(table(spark, folder, "chunks")).select(F.col("chunk_id").alias("page_id"), F.col("pages").alias("targets"))
    ranked, score_of = lexical.best_by_targets(units_, terms, pages, 200)
    moved = lexical.route_window(ranked, _routed(spark, folder, terms))
    base = checkpointed(moved.select("query_id", "page_id", F.col("new_rank").alias("rank")))
    asked = base.select("query_id").distinct()
    late = [hit_list(spark, folder, score, 50).join(asked, "query_id", "left_semi") for score in ("visual_score", "score")]
    merged = checkpointed(lists.interleave_all(base, late).where("rank <= 5"))
    seen = table(spark, folder, "page_hits").where("not isnan(visual_score)").groupBy("query_id", "page_id").agg(F.max("visual_score").alias("visual_score"))
    keys = ["query_id", "page_id"]
    return merged.join(score_of(merged), keys, "left").join(seen, keys, "left").select(
        *keys, F.col("rank").alias("hit_rank"), F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"), F.round("visual_score", 6).alias("visual_score")
    )
