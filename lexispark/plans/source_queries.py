"""Sources and sinks: every query writes and reads back or checks what it reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.cluster import scratch_path
from lexispark.functions.text import page_doc, page_number
from lexispark.plans.registry import query
from lexispark.sources import connectors
from lexispark.sources.tables import table


@query("""SELECT problem, count(*) AS n FROM (SELECT CASE WHEN trim(coalesce(doc_id, '')) = '' THEN 'doc_id' WHEN trim(coalesce(doc_name, '')) = '' THEN 'doc_name'
WHEN coalesce(doc_type, '') NOT IN ('kanun', 'rg_tarihi') THEN 'doc_type' WHEN trim(coalesce(url, '')) = '' THEN 'url' END AS problem FROM manifest) GROUP BY problem""")
def manifest_csv(spark, folder):
    """The manifest written as CSV and read back with its problems."""
    path = f"{scratch_path(spark, 'manifest')}.csv"
    table(spark, folder, "manifest").write.csv(path, header=True)
    return connectors.read_manifest(spark, path).groupBy("problem").agg(F.count("*").alias("n"))


@query("SELECT question_id, question, answerable, coalesce(len(gold_page_ids), 0) AS n_gold FROM bench_questions")
def questions_jsonl(spark, folder):
    """The question table written as JSON lines and read back with its schema."""
    rows = table(spark, folder, "bench_questions")
    path = f"{scratch_path(spark, 'questions')}.jsonl"
    connectors.write_json_lines(rows, path)
    back = connectors.read_json_lines(spark, path, rows.schema)
    return back.select("question_id", "question", "answerable", F.coalesce(F.size("gold_page_ids"), F.lit(0)).cast("long").alias("n_gold"))


@query("""WITH ids AS (SELECT DISTINCT unnest(gold_page_ids) AS page_id FROM bench_questions), t AS (SELECT page_id, max(text) AS text FROM documents WHERE page_id IS NOT NULL GROUP BY page_id)
SELECT ids.page_id, length(coalesce(t.text, '')) AS chars FROM ids LEFT JOIN t USING (page_id)""")
def texts_for_pages(spark, folder):
    """One row per gold page with its text, empty if it is missing."""
    ids = table(spark, folder, "bench_questions").select(F.explode("gold_page_ids").alias("page_id"))
    out = connectors.with_all_ids(ids, table(spark, folder, "documents").where("page_id is not null"), "page_id", "text")
    return out.select("page_id", F.length("text").alias("chars"))


@query("SELECT source AS doc_id, count(*) AS pages, count(CASE WHEN trim(coalesce(text, '')) = '' THEN 1 END) AS blank FROM documents GROUP BY source")
def blank_pages(spark, folder):
    """Pages and blank pages per source."""
    return connectors.blank_pages(table(spark, folder, "documents").select(F.col("source").alias("doc_id"), "text"))


@query("SELECT id, pipeline, CASE WHEN pipeline IS NULL THEN NULL ELSE score_scale END AS score_scale FROM request_events")
def schema_evolution(spark, folder):
    """Old rows without a column and new rows with it in one table; the old stay null."""
    rows = table(spark, folder, "request_events").select("id", "pipeline", "score_scale")
    old = rows.where("pipeline is null").drop("score_scale")
    return connectors.merge_schemas(rows.where("pipeline is not null"), old)


@query("SELECT count(*) AS n, min(id) AS first_id, max(id) AS last_id, count(total_ms) AS with_ms FROM request_events")
def export_round_trip(spark, folder):
    """The request log exported as Parquet ordered by id and read back."""
    path = f"{scratch_path(spark, 'export')}.parquet"
    connectors.export_events(table(spark, folder, "request_events"), path)
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("total_ms").alias("with_ms"))


@query("""SELECT question_id FROM (SELECT DISTINCT question_id FROM bench_questions) ANTI JOIN calibration_rows USING (question_id)""")
def resume_missing(spark, folder):
    """Questions without a calibration row: what a resumed job still has to do."""
    todo = table(spark, folder, "bench_questions").select("question_id").distinct()
    return connectors.resume(todo, table(spark, folder, "calibration_rows"), "question_id")


@query("SELECT DISTINCT page_id, split_part(page_id, ':', 1) AS doc_id, TRY_CAST(split_part(page_id, ':', 2) AS INTEGER) AS page_no FROM page_hits")
def page_keys(spark, folder):
    """Parts of every page key of the hit table."""
    rows = table(spark, folder, "page_hits").select("page_id").distinct()
    return rows.select("page_id", page_doc(F.col("page_id")).alias("doc_id"), page_number(F.col("page_id")).alias("page_no"))


@query("""WITH c AS (SELECT DISTINCT chunk_id, unnest(page_ids) AS page_id FROM chunks), k AS (SELECT DISTINCT split_part(page_id, ':', 1) AS doc_id, chunk_id FROM c),
d AS (SELECT chunk_id, count(*) AS copies FROM chunks GROUP BY chunk_id)
SELECT (SELECT count(*) FROM d WHERE copies > 1) AS repeated_ids, (SELECT count(*) FROM (SELECT DISTINCT doc_id FROM k WHERE doc_id IS NOT NULL) ANTI JOIN manifest USING (doc_id)) AS unknown_docs""")
def chunk_scan_checks(spark, folder):
    """Repeated chunk ids and documents that the manifest doesn't know."""
    chunks = table(spark, folder, "chunks")
    repeated = chunks.groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("repeated_ids"))
    docs = chunks.select(F.explode("page_ids").alias("p")).select(page_doc(F.col("p")).alias("doc_id"))
    unknown = docs.where("doc_id is not null").distinct().join(table(spark, folder, "manifest"), "doc_id", "left_anti").agg(F.count("*").alias("unknown_docs"))
    return repeated.join(F.broadcast(unknown), how="left")  # one row each


@query("""WITH k AS (SELECT DISTINCT sha256(concat_ws(chr(0), coalesce(query_sha256, ''), coalesce(index_revision, ''))) AS cache_key, answer_len IS NOT NULL AS parsed FROM request_events)
SELECT (SELECT count(DISTINCT cache_key) FROM k) AS requests, (SELECT count(DISTINCT cache_key) FROM k WHERE cache_key NOT IN (SELECT cache_key FROM k WHERE parsed)) AS misses""")
def verdict_cache(spark, folder):
    """Content-addressed cache: distinct keys and those without a parsed entry."""
    rows = table(spark, folder, "request_events")
    keys = rows.select(connectors.cache_key(F.col("query_sha256"), F.col("index_revision")).alias("cache_key"), F.col("answer_len").isNotNull().alias("parsed")).distinct()
    missing = connectors.cache_misses(keys.select("cache_key").distinct(), keys).agg(F.count("*").alias("misses"))
    return keys.agg(F.countDistinct("cache_key").alias("requests")).join(F.broadcast(missing), how="left")  # one row each


@query("SELECT page_id, doc_name, page_no, source_url, count(*) AS hits FROM page_hits JOIN (SELECT DISTINCT doc_id FROM manifest) m ON m.doc_id = split_part(page_id, ':', 1) GROUP BY ALL")
def hits_with_metadata(spark, folder):
    """Hits joined with the manifest, counted by page."""
    known = table(spark, folder, "manifest").select("doc_id").distinct()
    rows = table(spark, folder, "page_hits").withColumn("doc_id", page_doc(F.col("page_id"))).join(known, "doc_id")
    return rows.groupBy("page_id", "doc_name", "page_no", "source_url").agg(F.count("*").alias("hits"))
