"""BM25 over token statistics, ranking, name routing and confidence features.

Every operator is defined for empty inputs (empty result), null texts (no tokens) and repeated rows (callers pass
distinct keys).  Equal scores go by page id in code-point order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexispark.cluster import BROADCAST_ROWS, broadcast_if_small, checkpointed, scratch_path, spread_lookup
from lexispark.functions.text import GENERIC_NAME_TOKENS, TITLE_KEYWORDS, TITLE_LINE, page_doc, page_number, tokenize
from lexispark.operators import sparse

# BM25 parameters, cap of repeated query terms, routing window, score floor.
K1, B = 1.5, 0.75
QUERY_TERM_CAP = 2
ROUTE_WINDOW = 50
SCORE_FLOOR = 10.6


def token_lists(pages: DataFrame, page_id: str = "page_id", text: str = "text") -> DataFrame:
    """``page_id``, ``tokens``, ``dl`` (number of tokens, repeats included)."""
    tokens = tokenize(F.col(text))
    return pages.select(page_id, tokens.alias("tokens")).withColumn("dl", F.size("tokens"))


def corpus_stats(lists: DataFrame) -> DataFrame:
    """One row: ``n_pages`` and ``avgdl`` (1 for a corpus without tokens)."""
    mean = F.avg("dl")
    return lists.agg(F.count("*").alias("n_pages"), F.when(mean > 0, mean).otherwise(F.lit(1.0)).alias("avgdl"))


def term_stats(lists: DataFrame) -> DataFrame:
    """``token``, ``df``, ``idf`` of every token of the corpus."""
    df = lists.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return _with_idf(df, corpus_stats(lists))


def _with_idf(df: DataFrame, stats: DataFrame) -> DataFrame:
    n = F.col("n_pages")
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return df.join(F.broadcast(stats), how="left").withColumn("idf", idf).drop("n_pages", "avgdl")  # stats is one row


def query_terms(queries: DataFrame, query_id: str = "query_id", text: str = "text") -> DataFrame:
    """``query_id``, ``token``, ``qtf`` (capped number of repeats)."""
    words = queries.select(query_id, F.explode(tokenize(F.col(text))).alias("token"))
    return words.groupBy(query_id, "token").agg(F.least(F.count("*"), F.lit(QUERY_TERM_CAP)).alias("qtf"))


#: Stands in the postings once a page, so that the same pass over the texts gives the page lengths.
_PAGE = "\0page"


def postings(lists: DataFrame, tokens: DataFrame) -> DataFrame:
    """``page_id``, ``dl``, ``token``, ``tf`` for the given tokens, and one row a page with the page mark as token.

    The texts are tokenised in one pass and only asked tokens leave the scan; the result is written and its lineage cut.
    """
    asked = broadcast_if_small(tokens.select("token").distinct().union(lists.sparkSession.createDataFrame([(_PAGE,)], "token string")))
    cells = lists.select("page_id", "dl", F.explode(F.concat("tokens", F.array(F.lit(_PAGE)))).alias("token"))
    return checkpointed(cells.join(asked, "token", "left_semi").groupBy("page_id", "dl", "token").agg(F.count("*").alias("tf")))


def bm25_scores(lists: DataFrame, terms: DataFrame) -> DataFrame:
    """``query_id``, ``page_id``, ``score``, ``matched`` of every query and page that share a token."""
    index = postings(lists, terms)
    stats = corpus_stats(index.where(F.col("token") == _PAGE))
    tf = index.where(F.col("token") != _PAGE)
    counts = checkpointed(tf.groupBy("token").agg(F.count("*").alias("df")))
    idf = _with_idf(counts, stats)
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    weighted = checkpointed(terms.join(idf, "token"))
    pages = tf.join(F.broadcast(stats), how="left")  # one row
    if weighted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        both = pages.join(F.broadcast(weighted), "token")
    else:  # a frequent token's pages are spread over as many tasks as they need
        both = spread_lookup(pages, weighted, ["token"], ["page_id"], counts.withColumnRenamed("df", "n"))
    return (
        both.groupBy("query_id", "page_id")
        .agg(F.sum(F.col("qtf") * F.col("idf") * weight).alias("score"), F.count("*").alias("matched"))
    )


def written(lists: DataFrame) -> DataFrame:
    """``lists`` written as a columnar table in the shared folder and read again, so that texts are tokenised once."""
    path = scratch_path(lists.sparkSession, "lists")
    lists.write.parquet(path)
    return lists.sparkSession.read.parquet(path)


def unit_index(lists: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """``page_id``, ``targets``, ``parts`` (``dl``, ``tokens``) once a page; rows of a page that has several are its parts,
    those of one length are one part.  ``targets`` (page_id, targets) says what else a page's score is for; those it lacks
    are left out."""
    part = F.struct("dl", "tokens")
    more = checkpointed(lists.groupBy("page_id").agg(F.count("*").alias("_n")).where("_n > 1").select("page_id"))
    rows = lists
    if not more.isEmpty():
        more = broadcast_if_small(more)
        same = lists.join(more, "page_id", "left_semi").groupBy("page_id", "dl").agg(F.flatten(F.collect_list("tokens")).alias("tokens"))
        rows = lists.join(more, "page_id", "left_anti")
    index = rows.select("page_id", F.array(part).alias("parts"))
    if rows is not lists:
        index = index.unionByName(same.groupBy("page_id").agg(F.collect_list(part).alias("parts")))
    return index.withColumn("targets", F.array("page_id")) if targets is None else index.join(targets, "page_id")


def term_weights(lists: DataFrame, terms: DataFrame) -> tuple[DataFrame, float]:
    """``query_id``, ``token``, ``weight`` (repeats times idf) of the asked tokens that the corpus has, and its mean length.

    Rows of a page that are of one length count once for a token, as in ``unit_index``.
    """
    n_pages, avgdl = corpus_stats(lists).first()
    tokens = unit_index(lists).select(F.explode("parts.tokens").alias("t")).select(F.explode(F.array_distinct("t")).alias("token"))
    df = tokens.groupBy("token").agg(F.count("*").alias("df"))  # as many rows as there are words
    idf = F.log(1 + (n_pages - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return checkpointed(terms.join(df, "token").select("query_id", "token", (F.col("qtf") * idf).alias("weight"))), avgdl


def bm25_best(lists: DataFrame, terms: DataFrame, limit: int) -> DataFrame:
    """``query_id``, ``page_id``, ``score``, ``matched``, ``rank`` of the ``limit`` best pages of every query.

    The same scores as ``bm25_scores``, but only what can be among the best leaves a task.
    """
    rows = written(lists)
    weighted, avgdl = term_weights(rows, terms)
    return rank_pages(sparse.best_scores(unit_index(rows), weighted, avgdl, K1, B, limit), limit)


def bm25_lists(lists: DataFrame, terms: DataFrame, limit: int) -> DataFrame:
    """``query_id``, ``hits`` (``page_id``, ``score``): the pages of ``bm25_best`` in their order, a row a query.

    For query sets that grow with the table: a query's hits come out of one task, in rank order.
    """
    rows = written(lists)
    weighted, avgdl = term_weights(rows, terms)
    tokens = rows.agg(F.sum("dl")).first()[0] or 0
    return sparse.best_lists(unit_index(rows), weighted, tokens, avgdl, K1, B, limit)


def bm25_filled(lists: DataFrame, terms: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """``query_id``, ``page_id``, ``score``, ``rank``: the pages of ``bm25_top``, filled up within a query's list of hits."""
    first = [r["page_id"] for r in lists.select("page_id").orderBy("page_id").limit(2 * limit).collect()]
    best = queries.select("query_id").where("query_id is not null").distinct().join(bm25_lists(lists, terms, limit), "query_id", "left")
    hits = F.coalesce("hits", F.array().cast("array<struct<page_id: string, score: double>>"))
    pages = F.array(*map(F.lit, first)).cast("array<string>")
    fill = F.transform(F.filter(pages, lambda p: ~F.array_contains(hits["page_id"], p)), lambda p: F.struct(p.alias("page_id"), F.lit(0.0).alias("score")))
    all_ = F.when(F.size(hits) < limit, F.slice(F.concat(hits, fill), 1, limit)).otherwise(hits)
    return best.select("query_id", F.posexplode(all_).alias("pos", "hit")).select("query_id", "hit.page_id", "hit.score", (F.col("pos") + 1).alias("rank"))


def best_by_targets(lists: DataFrame, terms: DataFrame, targets: DataFrame, limit: int) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The ``limit`` best targets of every query (``query_id``, ``page_id``, ``score``, ``rank``) and a function that gives
    the ``score`` of any pairs of ``query_id``, ``page_id`` that have one.

    ``targets`` (page_id, targets) says for every page of ``lists`` what it is part of; a target scores as its best page.
    """
    rows = written(lists)
    weighted, avgdl = term_weights(rows, terms)
    index = unit_index(rows, targets)
    best = sparse.best_scores(index, weighted, avgdl, K1, B, limit)
    ranked = rank_pages(best.groupBy("query_id", "page_id").agg(F.max("score").alias("score")), limit)

    def score(pairs: DataFrame) -> DataFrame:
        asked = broadcast_if_small(checkpointed(pairs.select("query_id", F.col("page_id").alias("target")).distinct()))
        units = unit_index(rows).select("page_id", "parts").join(targets, "page_id").withColumn("target", F.explode("targets"))
        cells = units.join(asked, "target").select("query_id", "target", "page_id", F.explode("parts").alias("p"))
        cells = cells.select("query_id", "target", "page_id", "p.dl", F.explode("p.tokens").alias("token"))
        tf = cells.groupBy("query_id", "target", "page_id", "dl", "token").agg(F.count("*").alias("tf")).join(weighted, ["query_id", "token"])
        part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / avgdl))
        of_page = tf.groupBy("query_id", "target", "page_id").agg(F.sum(part).alias("score"))
        return of_page.groupBy("query_id", F.col("target").alias("page_id")).agg(F.max("score").alias("score"))

    return ranked, score


def rank_pages(scores: DataFrame, limit: int | None = None, rank: str = "rank") -> DataFrame:
    """Add the rank within a query: score descending (to nine places, so that the order of a sum doesn't matter), then page
    id; keep at most ``limit`` a query."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "page_id"))
    out = scores.withColumn(rank, place)
    return out if limit is None else out.where(F.col(rank) <= limit)


def bm25_top(lists: DataFrame, terms: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` best pages of every query; pages without a match score 0 and follow by page id."""
    best = checkpointed(bm25_best(lists, terms, limit).drop("rank"))
    # a query with fewer matches is filled up from the first pages; twice the limit always suffices
    first = lists.select("page_id").orderBy("page_id").limit(2 * limit)
    fill = (
        queries.select("query_id").distinct().join(F.broadcast(first), how="left")  # at most 2 * limit rows
        .where("page_id is not null")
        .join(best.select("query_id", "page_id"), ["query_id", "page_id"], "left_anti")
        .select("query_id", "page_id", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("matched"))
    )
    return rank_pages(best.unionByName(fill), limit)


def name_tokens(docs: DataFrame, doc_id: str = "doc_id", name: str = "doc_name") -> DataFrame:
    """``doc_id``, ``names``: distinct tokens of a document's name without generic ones; documents with none left out."""
    names = F.array_except(tokenize(F.col(name)), F.array(*[F.lit(t) for t in GENERIC_NAME_TOKENS]))
    return docs.select(F.col(doc_id).alias("doc_id"), names.alias("names")).where(F.size("names") > 0).distinct()


def title_line(text: Column) -> Column:
    """The longest line of capitals that names a law, the first of several as long; null if there is none."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    named = lambda x: F.contains(x, F.lit(TITLE_KEYWORDS[0])) | F.contains(x, F.lit(TITLE_KEYWORDS[1]))
    titles = F.filter(lines, lambda x: x.rlike(TITLE_LINE) & named(x))
    return F.aggregate(titles, F.lit(None).cast("string"), lambda best, x: F.when(F.length(x) > F.coalesce(F.length(best), F.lit(0)), x).otherwise(best))


def title_names(pages: DataFrame, first_only: bool = True) -> DataFrame:
    """``doc_id``, ``names``: tokens of the title on a document's first page (or on any), without generic ones.

    ``pages`` has ``page_id`` and ``text``.  Documents without a title or with generic words only are left out; of several
    titles the longest counts, then the first in code-point order.
    """
    rows = pages.where(page_number(F.col("page_id")) == 1) if first_only else pages
    titles = rows.select(page_doc(F.col("page_id")).alias("doc_id"), title_line(F.col("text")).alias("title")).where("title is not null")
    best = titles.groupBy("doc_id").agg(F.min_by("title", F.struct(-F.length("title"), "title")).alias("title"))
    return name_tokens(best, "doc_id", "title")


def routed_docs(names: DataFrame, terms: DataFrame) -> DataFrame:
    """``query_id``, ``doc_id`` where all name tokens stand in the query: a relational division, not a cross join."""
    owned = names.select("doc_id", F.size("names").alias("need"), F.explode("names").alias("token"))
    return (
        terms.select("query_id", "token").join(owned, "token")
        .groupBy("query_id", "doc_id", "need")
        .agg(F.count("*").alias("got"))
        .where("got = need")
        .select("query_id", "doc_id")
    )


def route_window(ranked: DataFrame, routed: DataFrame, window: int = ROUTE_WINDOW) -> DataFrame:
    """Reorder the first ``window`` ranks: pages of routed documents first, both parts in their old order.

    Adds ``routed`` and ``new_rank``; ranks beyond the window stay.
    """
    flag = routed.select("query_id", F.col("doc_id").alias("_doc"), F.lit(True).alias("routed")).distinct()
    rows = (
        ranked.withColumn("_doc", page_doc(F.col("page_id")))
        .join(flag, ["query_id", "_doc"], "left")
        .withColumn("routed", F.coalesce("routed", F.lit(False)))
        .drop("_doc")
    )
    part = F.when(F.col("rank") > window, 2).when(F.col("routed"), 0).otherwise(1)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(part, "rank"))
    return rows.withColumn("new_rank", place)


def route_lists(best: DataFrame, routed: DataFrame, window: int = ROUTE_WINDOW) -> DataFrame:
    """``query_id``, ``page_id``, ``score``, ``rank``, ``routed``, ``new_rank``: ``route_window`` for the hits of ``bm25_lists``,
    reordered within a query's list, so that only ``routed`` may be shuffled."""
    docs = routed.groupBy("query_id").agg(F.collect_set("doc_id").alias("docs"))
    rows = best.join(broadcast_if_small(checkpointed(docs)), "query_id", "left")
    hit = lambda h, i, flag: F.struct(h["page_id"].alias("page_id"), h["score"].alias("score"), (i + 1).alias("rank"), flag.alias("routed"))
    flagged = F.transform("hits", lambda h, i: hit(h, i, F.array_contains("docs", page_doc(h["page_id"]))))
    plain = F.transform("hits", lambda h, i: hit(h, i, F.lit(False)))
    inside = F.slice("flagged", 1, window)
    parts = [F.filter(inside, lambda h: h["routed"]), F.filter(inside, lambda h: ~h["routed"]), F.filter("flagged", lambda h: h["rank"] > window)]
    moved = rows.withColumn("flagged", F.when(F.col("docs").isNull(), plain).otherwise(flagged))
    moved = moved.withColumn("moved", F.when(F.col("docs").isNull(), F.col("flagged")).otherwise(F.concat(*parts)))
    return moved.select("query_id", F.posexplode("moved").alias("pos", "hit")).select("query_id", "hit.*", (F.col("pos") + 1).alias("new_rank"))


def confidence_features(scores: DataFrame, routed: DataFrame, terms: DataFrame, queries: DataFrame) -> DataFrame:
    """One row a query: best score, margin to the second, terms matched by the best page, their share, routed or not.

    ``scores`` holds at least the two best pages of a query.  Queries without any match get zeros, and so do those of
    ``queries`` that have no token.
    """
    best = scores if "rank" in scores.columns else rank_pages(scores, 2)
    top = best.where("rank <= 2").groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("served_top1"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"),
        F.max(F.when(F.col("rank") == 1, F.col("matched"))).alias("matched_terms_top1"),
    )
    asked = queries.select("query_id").where("query_id is not null").distinct()
    size = asked.join(terms.groupBy("query_id").agg(F.count("*").alias("n_terms")), "query_id", "left")
    hit = routed.select("query_id").distinct().withColumn("_routed", F.lit(1))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return (
        size.join(top, "query_id", "left").join(hit, "query_id", "left")
        .select(
            "query_id",
            zero("served_top1").alias("served_top1"),
            # a single match has no margin
            F.when(F.col("second").isNull(), F.lit(0.0)).otherwise(F.col("served_top1") - F.col("second")).alias("bm25_margin"),
            zero("matched_terms_top1").alias("matched_terms_top1"),
            F.coalesce(zero("matched_terms_top1") / F.col("n_terms"), F.lit(0.0)).alias("matched_frac"),
            zero("_routed").alias("routed"),
        )
    )
