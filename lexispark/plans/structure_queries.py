"""Document structure over chunks and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.operators import structure
from lexispark.plans.registry import query
from lexispark.sources.tables import table

_ARTICLE = structure.ARTICLE_LINE.replace("'", "''")
_TEXTS = "t AS (SELECT DISTINCT chunk_id, coalesce(text, '') AS text FROM chunks WHERE chunk_id IS NOT NULL)"
_LINES = "l AS (SELECT chunk_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS line FROM t)"


def _texts(spark, folder):
    return table(spark, folder, "chunks").where("chunk_id is not null").select("chunk_id", F.coalesce("text", F.lit("")).alias("text")).distinct()


@query(f"""WITH {_TEXTS}, {_LINES}, m AS (SELECT *, regexp_extract(line, '{_ARTICLE}', 1) AS kind, regexp_extract(line, '{_ARTICLE}', 2) AS num, regexp_extract(line, '{_ARTICLE}', 3) AS letter FROM l WHERE regexp_matches(line, '{_ARTICLE}'))
SELECT chunk_id, line_no, (CASE WHEN kind = '' THEN 'm' ELSE translate(lower(translate(kind, 'İI', 'iı')), 'çğıöşüâîû', 'cgiosuaiu') END) || num || CASE WHEN letter = '' THEN '' ELSE '/' || letter END AS article_id FROM m""")
def article_markers(spark, folder):
    """Article markers by line of every chunk."""
    return structure.line_markers(_texts(spark, folder), ["chunk_id"])


@query(f"""WITH {_TEXTS}, {_LINES} SELECT chunk_id, count(*) AS lines, CAST(max(line_start) AS BIGINT) AS last_start FROM (
SELECT chunk_id, coalesce(sum(length(line) + 1) OVER (PARTITION BY chunk_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_start FROM l) GROUP BY chunk_id""")
def line_offsets(spark, folder):
    """Lines of every chunk and the offset at which the last begins."""
    rows = structure.lines_of(_texts(spark, folder), ["chunk_id"])
    return rows.groupBy("chunk_id").agg(F.count("*").alias("lines"), F.max("start").cast("long").alias("last_start"))


_HEAD, _HIST = structure.FOOTNOTE_HEAD, structure.HISTORY.replace("(?iu)", "(?i)")


@query(f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS line FROM t),
f AS (SELECT *, regexp_matches(line, '{_HEAD}') AS head, regexp_matches(line, '{_HIST}') AS hist FROM l),
g AS (SELECT *, count(CASE WHEN head OR NOT hist THEN 1 END) OVER (PARTITION BY doc_id ORDER BY n) AS island FROM f),
k AS (SELECT *, max(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, island) AS in_note FROM g)
SELECT doc_id, md5(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT (head OR (hist AND in_note = 1))), '')) AS body_md5, count(CASE WHEN head OR (hist AND in_note = 1) THEN 1 END) AS dropped FROM k GROUP BY doc_id""")
def strip_footnotes(spark, folder):
    """Hash of every document without its history footnotes, and the lines that went."""
    docs = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    body = structure.strip_footnotes(F.col("text"))
    count = lambda c: F.size(F.split(c, "\n", -1))
    kept = F.when((body == "") & (F.col("text") != ""), F.lit(0)).otherwise(count(body))
    return docs.select("doc_id", F.md5(body).alias("body_md5"), (count(F.col("text")) - kept).cast("long").alias("dropped"))


_PAGES = "p AS (SELECT DISTINCT doc_id, chunk_id, CAST(regexp_extract(chunk_id, ':[pm]([0-9]+)', 1) AS BIGINT) AS page_no, coalesce(text, '') AS text FROM chunks WHERE regexp_matches(chunk_id, ':[pm][0-9]+'))"


def _pages(spark, folder):
    """Chunks read as numbered pages of their document."""
    rows = table(spark, folder, "chunks").where(F.col("chunk_id").rlike(":[pm][0-9]+"))
    no = F.regexp_extract("chunk_id", ":[pm]([0-9]+)", 1).cast("long")
    return rows.select("doc_id", "chunk_id", no.alias("page_no"), F.coalesce("text", F.lit("")).alias("text")).distinct()


@query(f"""WITH {_PAGES} SELECT doc_id, coalesce(min(CASE WHEN regexp_matches(text, '{structure.ANNEX.replace("(?iu)", "(?i)")}') AND NOT regexp_matches(text, '(?m){_ARTICLE}') THEN page_no END), -1) AS annex_from FROM p GROUP BY doc_id""")
def annex_starts(spark, folder):
    """Where the annex of each document begins, -1 if it has none."""
    return structure.annex_start(_pages(spark, folder)).select("doc_id", F.coalesce("annex_from", F.lit(-1)).alias("annex_from"))


@query(f"""WITH {_PAGES}, c AS (SELECT doc_id, count(*) AS pages, CAST(sum(len(regexp_extract_all(text, '(?m){_ARTICLE}'))) AS BIGINT) AS markers FROM p GROUP BY doc_id)
SELECT doc_id, pages, markers, markers / pages >= 0.3 AS by_article FROM c""")
def article_regimes(spark, folder):
    """Documents with markers enough to be cut by articles."""
    return structure.article_regime(_pages(spark, folder))


@query("""WITH m AS (SELECT DISTINCT chunk_id AS doc_id, article_id, marker_start AS start FROM article_markers WHERE article_id IS NOT NULL),
t AS (SELECT chunk_id AS doc_id, max(length(text)) AS total FROM chunks GROUP BY 1), j AS (SELECT * FROM m JOIN t USING (doc_id))
SELECT doc_id, article_id, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start, article_id), total) AS "end",
doc_id || ':' || article_id || CASE WHEN row_number() OVER (PARTITION BY doc_id, article_id ORDER BY start) = 1 THEN '' ELSE '#' || row_number() OVER (PARTITION BY doc_id, article_id ORDER BY start) END AS chunk_id FROM j""")
def article_extents(spark, folder):
    """Extent and repeat number of every recorded marker."""
    marks = table(spark, folder, "article_markers").where("article_id is not null").select(F.col("chunk_id").alias("doc_id"), "article_id", F.col("marker_start").alias("start")).distinct()
    total = table(spark, folder, "chunks").groupBy(F.col("chunk_id").alias("doc_id")).agg(F.max(F.length("text")).alias("total"))
    return structure.extents(marks.join(total, "doc_id")).select("doc_id", "article_id", "start", "end", "chunk_id")


@query()
def article_chunks(spark, folder):
    """Chunks of every document cut anew, by articles where it has them."""
    rows = structure.chunk_documents(_pages(spark, folder).select("doc_id", "page_no", "text"))
    return rows.select("chunk_id", "doc_id", "kind", "heading", F.length("text").alias("chars"), F.array_join("page_ids", " ").alias("page_ids"))


@query("""WITH t AS (SELECT DISTINCT chunk_id, heading, text, index_text FROM chunks WHERE chunk_id IS NOT NULL),
x AS (SELECT *, CASE WHEN coalesce(heading, '') = '' THEN coalesce(text, '') ELSE heading || chr(10) || coalesce(text, '') END AS made FROM t)
SELECT chunk_id, md5(made) AS made_md5, coalesce(index_text, '') = made AS agrees FROM x""")
def index_texts(spark, folder):
    """Index text of every chunk made anew and compared with the stored one."""
    rows = table(spark, folder, "chunks").where("chunk_id is not null").select("chunk_id", "heading", "text", "index_text").distinct()
    made = structure.index_text(F.col("heading"), F.col("text"))
    return rows.select("chunk_id", F.md5(made).alias("made_md5"), (F.coalesce("index_text", F.lit("")) == made).alias("agrees"))


@query()
def answer_claims(spark, folder):
    """Claims of every reference answer."""
    answers = table(spark, folder, "bench_questions").select("question_id", "reference_answer").distinct()
    rows = structure.segment_claims(answers, "question_id", "reference_answer")
    return rows.select("question_id", "claim_no", F.md5("claim").alias("claim_md5"), F.size("sources").alias("n_sources"), "inherited")


@query("""WITH w AS (SELECT id AS seq, coalesce(query_sha256, '') AS answer_id, CASE WHEN coalesce(citations_n, 0) > 0 THEN citations_n END AS own FROM (SELECT DISTINCT id, query_sha256, citations_n FROM request_events))
SELECT seq, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY answer_id ORDER BY seq), 0) AS effective,
own IS NULL AND last_value(own IGNORE NULLS) OVER (PARTITION BY answer_id ORDER BY seq) IS NOT NULL AS inherited FROM w""")
def citation_inheritance(spark, folder):
    """Nearest citation before each request of the same query (window form of the inheritance rule)."""
    rows = table(spark, folder, "request_events").select("id", "query_sha256", "citations_n").distinct()
    pieces = rows.select(
        F.col("id").alias("seq"), F.coalesce("query_sha256", F.lit("")).alias("answer_id"), F.lit(0).alias("paragraph"),
        F.when(F.coalesce("citations_n", F.lit(0)) > 0, F.array("citations_n")).otherwise(F.array().cast("array<int>")).alias("sources"),
    )
    out = structure.inherit_sources(pieces)
    return out.select("seq", F.coalesce(F.try_element_at("effective", F.lit(1)), F.lit(0)).alias("effective"), "inherited")
