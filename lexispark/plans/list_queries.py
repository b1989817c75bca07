"""Rank lists and retrieval metrics over the hit table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.operators import lists, metrics, quality
from lexispark.plans.registry import query
from lexispark.plans.views import GOLD_SQL, HITS_SQL, VISUAL_SQL, gold_pages, hit_list
from lexispark.sources.tables import table

_INTERLEAVED = f"""WITH {HITS_SQL}, {VISUAL_SQL},
both_ AS (SELECT *, 0 AS src FROM hits UNION ALL SELECT *, 1 FROM visual),
sized AS (SELECT *, least(coalesce(max(CASE WHEN src = 0 THEN rank END) OVER (PARTITION BY query_id), 0),
                          coalesce(max(CASE WHEN src = 1 THEN rank END) OVER (PARTITION BY query_id), 0)) AS m FROM both_),
keyed AS (SELECT query_id, page_id, CASE WHEN rank <= m THEN 0 ELSE 1 END AS k1, CASE WHEN rank <= m THEN rank ELSE src END AS k2,
                 CASE WHEN rank <= m THEN src ELSE rank END AS k3 FROM sized),
seen AS (SELECT *, row_number() OVER (PARTITION BY query_id, page_id ORDER BY k1, k2, k3) AS n FROM keyed)"""
_POOL = f"""WITH {HITS_SQL}, {VISUAL_SQL},
parts AS (SELECT *, 0 AS src FROM hits WHERE rank <= {lists.POOL_LIMIT} UNION ALL SELECT *, 1 FROM visual WHERE rank <= {lists.POOL_LIMIT}),
seen AS (SELECT *, row_number() OVER (PARTITION BY query_id, page_id ORDER BY src, rank) AS n FROM parts),
pool AS (SELECT query_id, page_id, row_number() OVER (PARTITION BY query_id ORDER BY src, rank) AS rank FROM seen WHERE n = 1)"""


def _two_lists(spark, folder):
    return hit_list(spark, folder), hit_list(spark, folder, "visual_score")


def _pool(spark, folder):
    return lists.candidate_pool(_two_lists(spark, folder))


@query(f"{_INTERLEAVED} SELECT query_id, page_id, row_number() OVER (PARTITION BY query_id ORDER BY k1, k2, k3) AS rank FROM seen WHERE n = 1")
def interleave_union(spark, folder):
    """Hits by score and by visual score interleaved."""
    return lists.interleave(*_two_lists(spark, folder))


@query(f"{_POOL} SELECT query_id, page_id, rank FROM pool")
def candidate_pool(spark, folder):
    """The first fifty pages of both lists without repeats."""
    return _pool(spark, folder)


@query(f"""WITH {HITS_SQL}, {VISUAL_SQL}, s AS (
    SELECT query_id, page_id, sum(1.0 / ({lists.RRF_K} + rank)) AS score FROM (SELECT * FROM hits UNION ALL SELECT * FROM visual) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, page_id) AS rank FROM s)
SELECT query_id, page_id, rank, round(score, 6) AS score FROM r WHERE rank <= 20""")
def rrf_ablation(spark, folder):
    """Reciprocal rank fusion of both lists, twenty best pages."""
    out = lists.reciprocal_rank_fusion(_two_lists(spark, folder)).where("rank <= 20")
    return out.select("query_id", "page_id", "rank", F.round("score", 6).alias("score"))


def _visual_scores(spark, folder):
    rows = table(spark, folder, "page_hits").where("visual_score is not null and not isnan(visual_score)")
    return rows.groupBy("query_id", "page_id").agg(F.max("visual_score").alias("score"))


_RERANK = f"""{_POOL}, vs AS (SELECT query_id, page_id, max(visual_score) AS score FROM page_hits
    WHERE visual_score IS NOT NULL AND NOT isnan(visual_score) GROUP BY ALL)
SELECT query_id, page_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY PIN score DESC NULLS LAST, rank) AS new_rank
FROM pool LEFT JOIN vs USING (query_id, page_id)"""


@query(_RERANK.replace("PIN", "CASE WHEN rank = 1 THEN 0 ELSE 1 END,"))
def rerank_pinned(spark, folder):
    """Pools reordered by visual score, the first page kept."""
    return lists.rerank(_pool(spark, folder), _visual_scores(spark, folder), True).select("query_id", "page_id", "rank", "new_rank")


@query(_RERANK.replace("PIN", ""))
def rerank_free(spark, folder):
    """Pools reordered by visual score."""
    return lists.rerank(_pool(spark, folder), _visual_scores(spark, folder), False).select("query_id", "page_id", "rank", "new_rank")


@query("""WITH c AS (SELECT DISTINCT chunk_id, unnest(page_ids) AS page_id FROM chunks WHERE chunk_id IS NOT NULL), h AS (SELECT query_id, page_id, max(score) AS score FROM page_hits WHERE score IS NOT NULL AND NOT isnan(score) AND query_id IS NOT NULL AND page_id IS NOT NULL GROUP BY ALL),
s AS (SELECT DISTINCT chunk_id, round(length(chunk_id) + coalesce(length(index_text), 0) / 1000, 6) AS base FROM chunks WHERE chunk_id IS NOT NULL AND length(coalesce(index_text, '')) % 2 = 0),
b AS (SELECT page_id, max(base) AS best, count(*) AS n FROM s JOIN c USING (chunk_id) WHERE page_id IS NOT NULL GROUP BY page_id)
SELECT query_id, h.page_id, round(coalesce(best, score), 6) AS score, coalesce(n, 0) AS n_chunks FROM h LEFT JOIN b ON b.page_id = h.page_id""")
def chunk_to_page_max(spark, folder):
    """Page hits scored by their best chunk (a number of each chunk; every second has none), else by their own score."""
    chunks = table(spark, folder, "chunks").where("chunk_id is not null")
    hits = table(spark, folder, "page_hits").where("score is not null and not isnan(score) and query_id is not null and page_id is not null")
    own = hits.groupBy("query_id", "page_id").agg(F.max("score").alias("score"))
    size = F.length(F.coalesce("index_text", F.lit("")))
    scored = chunks.where(size % 2 == 0).select("chunk_id", F.round(F.length("chunk_id") + size / 1000, 6).alias("score")).distinct()
    # the number is the same for every query, so chunks meet pages once and pages meet queries
    pages = lists.chunks_to_pages(scored.withColumn("query_id", F.lit("")), chunks).select("page_id", F.col("score").alias("_best"), "n_chunks")
    rows = own.join(pages, "page_id", "left")
    return rows.select("query_id", "page_id", F.round(F.coalesce("_best", "score"), 6).alias("score"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


_CUT_SQL = ", ".join(f"count(CASE WHEN rank <= {k} THEN 1 END) / count(*) AS recall_at_{k}" for k in metrics.CUTS)
_PER_QUERY = f"""{{WITH}} {GOLD_SQL}, found AS (SELECT gold.query_id, gold.page_id, rank FROM gold LEFT JOIN {{LIST}} USING (query_id, page_id)),
pq AS (SELECT query_id, count(*) AS n_gold, min(rank) AS best, {_CUT_SQL}, coalesce(1 / min(rank), 0) AS mrr,
    sum(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END) / list_sum(list_transform(range(1, least(count(*), 5) + 1), lambda i: 1 / log2(i + 1))) AS ndcg_at_5
    FROM found GROUP BY query_id)"""
_HITS_PQ = _PER_QUERY.replace("{WITH}", f"WITH {HITS_SQL},").replace("{LIST}", "hits")


def _per_query(spark, folder, score="score"):
    return metrics.per_query(metrics.gold_hits(gold_pages(spark, folder), hit_list(spark, folder, score)))


_NAMES = [f"recall_at_{k}" for k in metrics.CUTS] + ["mrr", "ndcg_at_5"]
_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in _NAMES)


@query(f"{_HITS_PQ} SELECT query_id, n_gold, {_ROUNDED} FROM pq")
def retrieval_per_query(spark, folder):
    """Recall at every cut, MRR and nDCG of every question with gold pages."""
    return _per_query(spark, folder).select("query_id", "n_gold", *[F.round(c, 6).alias(c) for c in _NAMES])


_MEANS = ", ".join(f"round(avg({c}), 6) AS {c}" for c in _NAMES)


@query(f"""{_HITS_PQ}, sl AS (SELECT DISTINCT question_id AS query_id, slice FROM bench_questions),
gd AS (SELECT DISTINCT question_id AS query_id, unnest(gold_doc_ids) AS doc_id FROM bench_questions),
ex AS (SELECT pq.*, 'overall' AS scope, '' AS value FROM pq
    UNION ALL SELECT pq.*, 'slice', coalesce(slice, '') FROM pq LEFT JOIN sl USING (query_id)
    UNION ALL SELECT pq.*, 'doc', doc_id FROM pq JOIN gd USING (query_id))
SELECT scope, value, count(*) AS n, {_MEANS} FROM ex GROUP BY scope, value""")
def retrieval_report(spark, folder):
    """Means overall, per slice and per gold document."""
    bench = table(spark, folder, "bench_questions")
    slices = bench.select(F.col("question_id").alias("query_id"), "slice").distinct()
    docs = bench.select(F.col("question_id").alias("query_id"), F.explode("gold_doc_ids").alias("doc_id"))
    out = metrics.metric_blocks(_per_query(spark, folder), slices, docs)
    return out.select("scope", "value", "n", *[F.round(c, 6).alias(c) for c in _NAMES])


@query(f"""{_HITS_PQ} SELECT count(*) AS n, round(avg(CASE WHEN coalesce(best, 1000001) <= 1 THEN 1 ELSE 0 END), 6) AS hit_at_1,
round(avg(CASE WHEN coalesce(best, 1000001) <= 5 THEN 1 ELSE 0 END), 6) AS hit_at_5,
round(avg(CASE WHEN coalesce(best, 1000001) <= 20 THEN 1 ELSE 0 END), 6) AS hit_at_20, round(avg(1 / coalesce(best, 1000001)), 6) AS mrr_all FROM pq""")
def hit_rates(spark, folder):
    """Hit rates (any gold page), another number than recall."""
    out = metrics.hit_rates(_per_query(spark, folder), (1, 5, 20), 1_000_000)
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("hit_at_1", "hit_at_5", "hit_at_20", "mrr_all")])


@query(f"""{_POOL}, {GOLD_SQL}, f AS (SELECT gold.query_id, avg(CASE WHEN pool.page_id IS NULL THEN 0 ELSE 1 END) AS coverage
    FROM gold LEFT JOIN pool USING (query_id, page_id) GROUP BY gold.query_id),
sl AS (SELECT DISTINCT question_id AS query_id, slice FROM bench_questions)
SELECT coalesce(slice, '') AS slice, count(*) AS n, round(avg(coverage), 6) AS coverage FROM f LEFT JOIN sl USING (query_id) GROUP BY 1""")
def pool_coverage(spark, folder):
    """Share of gold pages inside the candidate pool, per slice."""
    hits = metrics.gold_hits(gold_pages(spark, folder), _pool(spark, folder))
    each = hits.groupBy("query_id").agg(F.avg(F.col("rank").isNotNull().cast("double")).alias("coverage"))
    slices = table(spark, folder, "bench_questions").select(F.col("question_id").alias("query_id"), "slice").distinct()
    return each.join(slices, "query_id", "left").groupBy(F.coalesce("slice", F.lit("")).alias("slice")).agg(
        F.count("*").alias("n"), F.round(F.avg("coverage"), 6).alias("coverage")
    )


@query(f"""{_POOL}, {GOLD_SQL}, src AS (SELECT query_id, page_id, 'hits' AS channel FROM hits WHERE rank <= {lists.POOL_LIMIT}
    UNION ALL SELECT query_id, page_id, 'visual' FROM visual WHERE rank <= {lists.POOL_LIMIT})
SELECT gold.query_id, gold.page_id, string_agg(channel, '+' ORDER BY channel) AS channels FROM gold JOIN src USING (query_id, page_id) GROUP BY ALL""")
def gold_attribution(spark, folder):
    """Which channels hold each gold page of the pool."""
    a, b = _two_lists(spark, folder)
    parts = [x.where(F.col("rank") <= lists.POOL_LIMIT).withColumn("channel", F.lit(n)) for x, n in ((a, "hits"), (b, "visual"))]
    found = gold_pages(spark, folder).join(parts[0].unionByName(parts[1]), ["query_id", "page_id"])
    return found.groupBy("query_id", "page_id").agg(F.array_join(F.array_sort(F.collect_set("channel")), "+").alias("channels"))


_VIS_FOUND = "vf AS (SELECT gold.query_id, min(rank) AS best FROM gold LEFT JOIN visual USING (query_id, page_id) GROUP BY gold.query_id)"


@query(f"""{_HITS_PQ}, {VISUAL_SQL}, {_VIS_FOUND}, j AS (SELECT coalesce(pq.best <= 5, false) AS a, coalesce(vf.best <= 5, false) AS b,
    coalesce(1 / pq.best, 0) AS am, coalesce(1 / vf.best, 0) AS bm FROM pq JOIN vf USING (query_id)),
s AS (SELECT count(*) AS n, count(CASE WHEN b AND NOT a THEN 1 END) AS gained, count(CASE WHEN a AND NOT b THEN 1 END) AS lost, avg(am) AS base_mrr, avg(bm) AS arm_mrr FROM j)
SELECT n, gained, lost, round(base_mrr, 6) AS base_mrr, round(arm_mrr, 6) AS arm_mrr,
CASE WHEN arm_mrr < base_mrr - 1e-9 OR gained - lost < 1 THEN 'DISCARDED' WHEN gained - lost >= 2 THEN 'KEPT' ELSE 'KEPT(single)' END AS verdict FROM s""")
def arm_comparison(spark, folder):
    """Ranking by visual score against ranking by score."""
    out = metrics.compare_arms(_per_query(spark, folder), _per_query(spark, folder, "visual_score"))
    return out.select("n", "gained", "lost", F.round("base_mrr", 6).alias("base_mrr"), F.round("arm_mrr", 6).alias("arm_mrr"), "verdict")


@query(f"WITH {HITS_SQL}, {GOLD_SQL} SELECT DISTINCT query_id, page_id FROM gold WHERE page_id NOT IN (SELECT page_id FROM hits)")
def gold_never_hit(spark, folder):
    """Gold pages that no query ever hit (left anti join)."""
    pages = hit_list(spark, folder).select("page_id").distinct()
    return gold_pages(spark, folder).join(pages, "page_id", "left_anti").select("query_id", "page_id")


@query(f"WITH {HITS_SQL}, {GOLD_SQL} SELECT query_id, page_id, min(rank) AS rank FROM gold JOIN hits USING (query_id, page_id) GROUP BY ALL")
def gold_ranks(spark, folder):
    """Rank of every gold page that was found."""
    return metrics.gold_hits(gold_pages(spark, folder), hit_list(spark, folder)).where("rank is not null").select("query_id", "page_id", "rank")


@query()
def bootstrap_recall(spark, folder):
    """Bootstrap interval of recall at 5."""
    return metrics.bootstrap_interval(_per_query(spark, folder).select("query_id", "recall_at_5"), "recall_at_5")


@query(f"""{_HITS_PQ}
SELECT query_id, 'recall_at_5' AS metric, round(recall_at_5 + 0.001, 6) AS stored, round(recall_at_5, 6) AS recomputed FROM pq WHERE CAST(substr(query_id, 2) AS BIGINT) % 10 = 0
UNION ALL SELECT query_id, 'mrr', NULL, round(mrr, 6) FROM pq WHERE CAST(substr(query_id, 2) AS BIGINT) % 10 = 3""")
def metric_recomputation(spark, folder):
    """Stored metrics that differ from those recomputed: of every tenth question one was changed, of others one is lost."""
    now = _per_query(spark, folder).select("query_id", "recall_at_5", "mrr", "ndcg_at_5")
    n = F.substring("query_id", 2, 20).cast("long")
    stored = now.withColumn("recall_at_5", F.col("recall_at_5") + F.when(n % 10 == 0, 0.001).otherwise(0.0)).withColumn("mrr", F.when(n % 10 != 3, F.col("mrr")))
    out = quality.metric_differences(stored, now, ["query_id"])
    return out.select("query_id", "metric", F.round("stored", 6).alias("stored"), F.round("recomputed", 6).alias("recomputed"))
