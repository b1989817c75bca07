"""Review, guards of the query path, rendering and index checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.functions import text as tx
from lexispark.operators import review, structure, vectors
from lexispark.operators.events import clean_events
from lexispark.plans.event_queries import _E
from lexispark.plans.registry import query
from lexispark.operators.calibration import clopper_pearson_udf
from lexispark.plans.views import sql_upper_bound, sql_lower, sql_tokens
from lexispark.sources.tables import table


def _bench(spark, folder):
    return table(spark, folder, "bench_questions")


@query(f"""WITH r AS (SELECT id, k, query_text FROM request_events)
SELECT id, CASE WHEN length(coalesce(query_text, '')) > 500 THEN 'too long' WHEN k < 1 OR k > 50 THEN 'bad k' WHEN len({sql_tokens("query_text")}) = 0 THEN 'not searchable' END AS problem FROM r""")
def request_guards(spark, folder):
    """Why a request would be refused."""
    return table(spark, folder, "request_events").select("id", review.request_problem(F.col("query_text"), F.col("k")).alias("problem"))


# a dotted capital becomes two characters in lower case
_BANNED = " OR ".join(f"contains(lower(replace(question, 'İ', 'i' || chr(775))), '{w}')" for w in review.BANNED_IN_QUESTIONS)


@query(f"SELECT question_id, coalesce(length(question) >= 15 AND NOT ({_BANNED}), false) AS kept FROM bench_questions")
def generated_question_filter(spark, folder):
    """Which questions would pass as generated ones."""
    return _bench(spark, folder).select("question_id", F.coalesce(review.keeps_question(F.col("question")), F.lit(False)).alias("kept"))


@query("SELECT slice, count(*) AS waiting FROM bench_questions WHERE coalesce(verification_kind, 'human') <> 'human' GROUP BY slice")
def review_queue(spark, folder):
    """Questions that wait for a human, per slice."""
    return review.review_queue(_bench(spark, folder)).groupBy("slice").agg(F.count("*").alias("waiting"))


_LETTER = "CASE abs(CAST(substr(question_id, 2) AS BIGINT)) % 3 WHEN 0 THEN 'e' WHEN 1 THEN 'h' ELSE 'a' END"


@query(f"""WITH q AS (SELECT DISTINCT question_id, verification_status, verified_by, verification_kind FROM bench_questions), d AS (SELECT *, {_LETTER} AS l FROM q)
SELECT question_id, CASE l WHEN 'e' THEN 'verified' WHEN 'h' THEN 'rejected' ELSE verification_status END AS verification_status, CASE WHEN l IN ('e', 'h') THEN 'reviewer' ELSE verified_by END AS verified_by,
CASE WHEN l IN ('e', 'h') THEN 'human' ELSE verification_kind END AS verification_kind FROM d""")
def review_decisions(spark, folder):
    """A decision for every question (by its number) applied."""
    letter = F.element_at(F.array(F.lit("e"), F.lit("h"), F.lit("a")), (F.substring("question_id", 2, 20).cast("long") % 3 + 1).cast("int"))
    questions = _bench(spark, folder)
    decisions = questions.select("question_id").distinct().select("question_id", letter.alias("letter"), F.lit("reviewer").alias("by"), F.lit("").alias("note"))
    out = review.apply_decisions(questions, decisions)
    return out.select("question_id", "verification_status", "verified_by", "verification_kind").distinct()


_PAGES = "pg AS (SELECT page_id, string_agg(text, chr(10) ORDER BY chunk_id) AS text FROM (SELECT DISTINCT chunk_id, text, unnest(page_ids) AS page_id FROM chunks) GROUP BY page_id)"
_NORM = lambda x: f"trim(regexp_replace({sql_lower(f'coalesce({x}, chr(32))')}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


def _page_texts(spark, folder):
    pieces = table(spark, folder, "chunks").select("chunk_id", "text", F.explode("page_ids").alias("page_id")).distinct()
    joined = pieces.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))).alias("c"))  # few chunks a page
    return joined.select("page_id", F.array_join(F.transform("c", lambda s: s["text"]), "\n").alias("text"))


@query(f"""WITH {_PAGES}, q AS (SELECT DISTINCT question_id, question, answerable, slice, gold_doc_ids, list_filter(coalesce(minimal_evidence_spans, []), lambda s: s IS NOT NULL) AS spans, gold_page_ids FROM bench_questions),
g AS (SELECT *, unnest(CASE WHEN len(gold_page_ids) > 0 THEN gold_page_ids ELSE [NULL] END) AS page_id FROM q), r AS (SELECT g.*, pg.text FROM g LEFT JOIN pg USING (page_id)),
e AS (SELECT question_id, answerable, slice, spans, page_id IS NOT NULL AND length(trim(coalesce(text, ''))) < 40 AS scanned,
  page_id IS NOT NULL AND NOT list_contains(coalesce(gold_doc_ids, []), split_part(page_id, ':', 1)) AS other, page_id IS NOT NULL AND page_id NOT IN (SELECT page_id FROM page_hits WHERE page_id IS NOT NULL) AS missing,
  CASE WHEN len(list_distinct({sql_tokens('question')})) = 0 THEN 0 ELSE len(list_intersect(list_distinct({sql_tokens('question')}), list_distinct({sql_tokens('text')}))) / len(list_distinct({sql_tokens('question')})) END AS overlap,
  list_filter(spans, lambda s: contains({_NORM('text')}, {_NORM('s')})) AS found FROM r),
o AS (SELECT question_id, answerable, slice, bool_or(scanned) AS scanned, bool_or(other) AS other, bool_or(missing) AS missing, max(overlap) AS overlap, any_value(spans) AS spans, flatten(list(found)) AS found FROM e GROUP BY question_id, answerable, slice),
n AS (SELECT question_id, coalesce(answerable, false) AS a, scanned, list_filter([CASE WHEN other THEN 'other-document' END, CASE WHEN missing THEN 'not-indexed' END, CASE WHEN len(list_filter(spans, lambda s: NOT list_contains(found, s))) > 0 THEN 'span-not-found' END,
  CASE WHEN slice = 'paraphrase' AND overlap > 0.5 THEN 'close-to-page' END], lambda x: x IS NOT NULL) AS notes FROM o)
SELECT question_id, CASE WHEN NOT a THEN 'clean' WHEN scanned THEN 'manual' WHEN len(notes) > 0 THEN 'suspicious' ELSE 'clean' END AS verdict, CASE WHEN a THEN array_to_string(notes, ' ') ELSE '' END AS notes FROM n""")
def gold_precheck(spark, folder):
    """Machine check of every question's gold pages: clean, suspicious or manual; pages with hits count as indexed."""
    rows = _bench(spark, folder).select("question_id", "question", "answerable", "slice", "minimal_evidence_spans", "gold_doc_ids", "gold_page_ids").distinct()
    out = review.precheck(rows, _page_texts(spark, folder), table(spark, folder, "page_hits").where("page_id is not null"))
    return out.select("question_id", "verdict", F.array_join("notes", " ").alias("notes"))


@query()
def closest_evidence_lines(spark, folder):
    """For every evidence span the most similar line of its gold page."""
    rows = _bench(spark, folder).select("question_id", "minimal_evidence_spans", F.explode("gold_page_ids").alias("page_id")).distinct()
    spans = rows.select("question_id", "page_id", F.explode("minimal_evidence_spans").alias("span")).join(_page_texts(spark, folder), "page_id")
    out = review.closest_lines(spans.select("question_id", "page_id", "span", "text"))
    return out.select("question_id", "page_id", F.md5("span").alias("span_md5"), F.md5("closest").alias("closest_md5"), F.round("ratio", 6).alias("ratio"))


_HITS = "h AS (SELECT id, json_extract(detail, '$.hits') AS j FROM e WHERE json_array_length(detail, '$.hits') > 0), s AS (SELECT id, unnest(range(0, CAST(json_array_length(j) AS BIGINT))) AS n, j FROM h)"


@query(f"WITH {_E}, {_HITS} SELECT id, n + 1 AS rank, json_extract_string(j, '$[' || n || '].page_id') AS page_id, round(CAST(json_extract_string(j, '$[' || n || '].score') AS DOUBLE), 6) AS score FROM s")
def served_hits(spark, folder):
    """Hits of every request out of its JSON detail."""
    out = review.served_hits(clean_events(table(spark, folder, "request_events")))
    return out.select("id", "rank", "page_id", F.round("score", 6).alias("score"))


@query(f"""WITH {_E}, {_HITS} SELECT e.id, s.n + 1 AS rank, json_extract_string(s.j, '$[' || s.n || '].page_id') AS page_id FROM e JOIN s ON s.id = e.id WHERE e.citations_n >= s.n + 1""")
def cited_pages(spark, folder):
    """The first citations of an answer resolved to its served hits."""
    events = clean_events(table(spark, folder, "request_events"))
    cites = events.where("citations_n > 0").select("id", F.sequence(F.lit(1), F.col("citations_n")).alias("sources"))
    return review.cited_pages(cites, review.served_hits(events)).select("id", "rank", "page_id")


@query("""WITH r AS (SELECT DISTINCT page_id, doc_name, page_no FROM page_hits WHERE page_no IS NOT NULL)
SELECT page_id, '[S1] ' || coalesce(doc_name, '') || ' sayfa ' || CAST(page_no AS VARCHAR) AS marker FROM r""")
def source_markers(spark, folder):
    """Source marker of every page."""
    rows = table(spark, folder, "page_hits").where("page_no is not null").select("page_id", "doc_name", "page_no").distinct()
    return rows.select("page_id", review.source_marker(F.lit(1), F.col("doc_name"), F.col("page_no")).alias("marker"))


@query("""SELECT doc_id, length(CASE WHEN length(text) > 12000 THEN left(text, 12000) || ' …' ELSE text END) AS chars, length(text) > 12000 AS cut FROM documents WHERE text IS NOT NULL""")
def evidence_truncation(spark, folder):
    """Documents cut to the length of evidence."""
    rows = table(spark, folder, "documents").where("text is not null")
    return rows.select("doc_id", F.length(review.evidence_text(F.col("text"))).alias("chars"), (F.length("text") > review.EVIDENCE_CHARS).alias("cut"))


@query("SELECT DISTINCT question_id, md5('Query: ' || question || repeat('<pad>', 10) || chr(10)) AS rendered_md5 FROM bench_questions WHERE question IS NOT NULL")
def rendered_queries(spark, folder):
    """Questions in the format a query encoder expects."""
    rows = _bench(spark, folder).where("question is not null")
    return rows.select("question_id", F.md5(review.render_query(F.col("question"))).alias("rendered_md5")).distinct()


@query(f"""WITH q AS (SELECT DISTINCT question_id, {_NORM('question')} AS a, {_NORM('reference_answer')} AS b, trim(regexp_replace(coalesce(reference_answer, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS raw FROM bench_questions)
SELECT question_id, CASE WHEN raw <> '' AND a <> b THEN md5(raw) END AS expansion_md5 FROM q""")
def validated_expansions(spark, folder):
    """Reference answers taken as query expansions, refused where they only repeat the question."""
    return _bench(spark, folder).select("question_id", F.md5(review.valid_expansion(F.col("question"), F.col("reference_answer"))).alias("expansion_md5")).distinct()


@query(f"""WITH {_E} SELECT CASE WHEN error_type = 'parse' THEN 'parse' WHEN http_status = 429 THEN 'http_429' WHEN http_status IN (401, 403) THEN 'auth' WHEN http_status BETWEEN 500 AND 599 THEN 'http_5xx'
WHEN error_type = 'timeout' THEN 'timeout' ELSE 'other' END AS class, count(*) AS requests FROM e WHERE status = 'error' OR status = 'degraded' GROUP BY 1""")
def error_classes(spark, folder):
    """Failed requests by class of error."""
    rows = clean_events(table(spark, folder, "request_events")).where("status in ('error', 'degraded')")
    return rows.groupBy(review.error_class(F.col("http_status"), F.col("error_type")).alias("class")).agg(F.count("*").alias("requests"))


@query(f"""WITH RECURSIVE r AS (SELECT slice, answerable, label, coalesce(gold_in_topk, false) AS shown FROM calibration_rows WHERE label IS NOT NULL),
m AS (SELECT slice, 1 - avg(label) AS risk, avg(CASE WHEN answerable THEN label END) AS safe, count(CASE WHEN NOT answerable THEN 1 END) AS n, count(CASE WHEN NOT answerable AND shown THEN 1 END) AS errors,
      count(DISTINCT shown) = 1 AS identity FROM r GROUP BY slice), {sql_upper_bound('m', 'slice')}
SELECT m.slice, round(risk, 6) AS risk, round(errors / nullif(n, 0), 6) AS false_rate, round(cp.upper, 6) AS false_upper, identity,
coalesce(risk <= 0.05 AND errors / nullif(n, 0) <= 0.02 AND cp.upper <= 0.05 AND safe >= 0.8 AND identity, false) AS eligible FROM m JOIN cp ON cp.key IS NOT DISTINCT FROM m.slice""")
def enablement_verdicts(spark, folder):
    """Which slices would pass the five conditions, the false rate with its Clopper-Pearson bound."""
    shown = F.coalesce("gold_in_topk", F.lit(False))
    rows = table(spark, folder, "calibration_rows").where("label is not null").withColumn("_shown", shown).groupBy("slice").agg(
        (1 - F.avg("label")).alias("risk"), F.avg(F.when(F.col("answerable"), F.col("label"))).alias("safe_rate"), F.count_if(~F.col("answerable")).alias("n"),
        F.count_if(~F.col("answerable") & F.col("_shown")).alias("errors"), (F.countDistinct("_shown") == 1).alias("identity"),
    )
    rows = rows.withColumn("false_rate", F.col("errors") / F.nullif(F.col("n"), F.lit(0))).withColumn("false_upper", clopper_pearson_udf("errors", "n"))
    return review.enablement(rows).select("slice", *[F.round(c, 6).alias(c) for c in ("risk", "false_rate", "false_upper")], "identity", "eligible")


@query("""WITH a AS (SELECT pipeline AS arm, avg(CASE WHEN abstained THEN 0 ELSE 1 END) AS paraphrase, count(*) AS overall, max(candidates) AS disk, round(avg(CASE WHEN total_ms >= 0 AND NOT isnan(total_ms) THEN total_ms END), 6) AS latency FROM request_events WHERE pipeline IS NOT NULL GROUP BY pipeline)
SELECT arm FROM a ORDER BY round(paraphrase, 9) DESC, overall DESC, disk, latency, arm LIMIT 1""")
def best_arm(spark, folder):
    """The pipeline that the tie-breaking rule would choose."""
    rows = table(spark, folder, "request_events").where("pipeline is not null").groupBy(F.col("pipeline").alias("arm")).agg(
        F.round(F.avg(F.when(F.col("abstained"), 0).otherwise(1)), 9).alias("paraphrase"), F.count("*").alias("overall"), F.max("candidates").alias("disk"),
        F.round(F.avg(F.when((F.col("total_ms") >= 0) & ~F.isnan("total_ms"), F.col("total_ms"))), 6).alias("latency"),
    )
    return review.best_arm(rows)


@query("""SELECT vec_id, CAST(count(CASE WHEN x > 0 THEN 1 END) AS BIGINT) AS kept, round(coalesce(sum(CASE WHEN x > 0 THEN x END), 0), 5) AS total
FROM (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings WHERE embedding IS NOT NULL) GROUP BY vec_id""")
def mask_trimming(spark, folder):
    """Elements kept by a mask (here: the positive ones)."""
    v = F.col("embedding")
    kept = review.trim_by_mask(v, F.transform(v, lambda x: x > 0))
    rows = table(spark, folder, "embeddings").where("embedding is not null").select("vec_id", kept.alias("k"))
    return rows.select("vec_id", F.size("k").cast("long").alias("kept"), F.round(F.aggregate("k", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"))


@query("""WITH z AS (SELECT label AS page_id, count(*) AS length FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL GROUP BY label),
o AS (SELECT *, coalesce(sum(length) OVER (ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS expected FROM z)
SELECT page_id, length, CAST(expected + 1 AS BIGINT) AS begin, CAST(expected AS BIGINT) AS expected FROM o WHERE page_id % 3 = 0""")
def index_offsets(spark, folder):
    """Offsets of an index by page, of which every third was written one too far: those are found."""
    sizes = table(spark, folder, "embeddings").where("embedding is not null and label is not null").groupBy(F.col("label").alias("page_id")).agg(F.count("*").alias("length"))
    stored = review.page_offsets(sizes).withColumn("begin", F.col("begin") + (F.col("page_id") % 3 == 0).cast("long"))
    return review.offset_problems(stored).select("page_id", "length", "begin", "expected")


_ART, _NUM = structure.ARTICLE_LINE, structure.NUMBERING
_LAGS = ", ".join(f"trim(regexp_replace(lag(line, {k}) OVER w, '^\\s+|\\s+$', '', 'g')) AS s{k}, lag(line, {k}) OVER w AS r{k}" for k in (1, 2, 3))
_OKS = ", ".join(
    f"coalesce(r{k} IS NOT NULL AND s{k} <> '' AND NOT regexp_matches(r{k}, '{_ART}') AND NOT (ends_with(s{k}, '.') AND NOT regexp_matches(s{k}, '{_NUM}')) AND length(s{k}) <= 90, false) AS ok{k}" for k in (1, 2, 3)
)


@query(f"""WITH t AS (SELECT DISTINCT chunk_id, coalesce(text, '') AS text FROM chunks WHERE chunk_id IS NOT NULL),
l AS (SELECT chunk_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS line FROM t),
a AS (SELECT *, {_LAGS} FROM l WINDOW w AS (PARTITION BY chunk_id ORDER BY line_no)), o AS (SELECT *, {_OKS} FROM a)
SELECT chunk_id, line_no, concat_ws(' / ', CASE WHEN ok1 AND ok2 AND ok3 THEN s3 END, CASE WHEN ok1 AND ok2 THEN s2 END, CASE WHEN ok1 THEN s1 END) AS heading FROM o WHERE regexp_matches(line, '{_ART}')""")
def article_headings(spark, folder):
    """Heading above every article line."""
    texts = table(spark, folder, "chunks").where("chunk_id is not null").select("chunk_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    return review.headings(structure.lines_of(texts, ["chunk_id"], offsets=False), _ART, _NUM)


@query("""WITH c AS (SELECT group_key AS answer_id, row_number() OVER (PARTITION BY group_key ORDER BY question_id, extracted_at) AS claim_no, 1 + label AS attempts FROM calibration_rows WHERE group_key IS NOT NULL),
b AS (SELECT *, sum(attempts) OVER (PARTITION BY answer_id ORDER BY claim_no ROWS UNBOUNDED PRECEDING) <= 10 AS allowed FROM c)
SELECT answer_id, count(*) AS claims, count(CASE WHEN allowed THEN 1 END) AS verified FROM b GROUP BY answer_id""")
def verification_budget(spark, folder):
    """Claims that fit the attempt budget of their answer."""
    from pyspark.sql.window import Window

    rows = table(spark, folder, "calibration_rows").where("group_key is not null")
    no = F.row_number().over(Window.partitionBy("group_key").orderBy("question_id", "extracted_at"))
    claims = rows.select(F.col("group_key").alias("answer_id"), no.alias("claim_no"), (1 + F.col("label")).alias("attempts"))
    return review.within_budget(claims).groupBy("answer_id").agg(F.count("*").alias("claims"), F.count_if("allowed").alias("verified"))


@query(f"""WITH RECURSIVE {_E}, x AS (SELECT error_type, id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY error_type ORDER BY epoch_us(ts), id) AS k FROM e WHERE error_type IS NOT NULL),
f AS (SELECT error_type, id, us, k FROM x WHERE k = 1 UNION ALL SELECT n.error_type, n.id, n.us, n.k FROM f, LATERAL (SELECT * FROM x WHERE x.error_type = f.error_type AND x.us >= f.us + 60000000 ORDER BY k LIMIT 1) n)
SELECT error_type, id, coalesce(lead(k) OVER w, 1 + (SELECT max(k) FROM x WHERE x.error_type = f.error_type)) - k - 1 AS held FROM f WINDOW w AS (PARTITION BY error_type ORDER BY k)""")
def warning_log(spark, folder):
    """Warnings emitted at most once a minute and error type."""
    rows = clean_events(table(spark, folder, "request_events")).where("error_type is not null")
    return review.rate_limited_warnings(rows, "error_type")


@query("""SELECT DISTINCT doc_id, regexp_replace(coalesce(doc_name, ''), '[^A-Za-z0-9._-]+', '-', 'g') AS slug, concat_ws('__', doc_id, coalesce(doc_type, 'none')) AS key FROM manifest""")
def path_slugs(spark, folder):
    """Path-safe names and composite keys of documents."""
    rows = table(spark, folder, "manifest")
    return rows.select("doc_id", tx.slug(F.coalesce("doc_name", F.lit(""))).alias("slug"), F.concat_ws("__", "doc_id", F.coalesce("doc_type", F.lit("none"))).alias("key")).distinct()


_CODES = "list_transform(v, lambda x: greatest(least(round_even(x / greatest(list_max(list_transform(v, lambda y: abs(y))) / 127, 1e-8), 0), 127), -127) * greatest(list_max(list_transform(v, lambda y: abs(y))) / 127, 1e-8))"


@query(f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL), c AS (SELECT vec_id, v, {_CODES} AS d, list_transform(v, lambda x: CASE WHEN x > 0 THEN 1.0 ELSE -1.0 END) AS b FROM e),
q AS (SELECT vec_id AS query_id, v AS qv, b AS qb FROM c WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, round(list_dot_product(qv, v), 9) AS f, round(list_dot_product(qv, d), 9) AS i, list_dot_product(CAST(qb AS DOUBLE[]), CAST(b AS DOUBLE[])) AS b FROM q, c WHERE vec_id <> query_id)
SELECT query_id, arg_min(vec_id, struct_pack(a := -f, b := vec_id)) AS best_float, arg_min(vec_id, struct_pack(a := -i, b := vec_id)) AS best_int8, arg_min(vec_id, struct_pack(a := -b, b := vec_id)) AS best_binary FROM s GROUP BY query_id""")
def oracle_arms(spark, folder):
    """The vector each representation holds nearest to every vector of the query set, itself left out."""
    rows = table(spark, folder, "embeddings").where("embedding is not null")
    pages = rows.select(F.col("vec_id").alias("page_id"), F.col("embedding").alias("vec"))
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))

    def best(kind):  # at most one of two is the vector itself
        near = vectors.nearest(pages, asked, 2, kind).where("page_id <> query_id")
        return near.groupBy("query_id").agg(F.min_by("page_id", "rank").alias(f"best_{kind}"))

    return best("float").join(best("int8"), "query_id").join(best("binary"), "query_id")
