"""Queries of the nine training-data problems, each over the whole of its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.cluster import checkpointed
from lexispark.llm import abuse, charforms, leakage, overlap, packing, pieces, quantiles, splits, topn
from lexispark.sources.tables import table

# Fixed value: proportions of the splits.
PROPORTIONS = {"train": 0.7, "validation": 0.1, "test": 0.2}


def _question_units(spark: SparkSession, folder: str) -> DataFrame:
    questions = table(spark, folder, "bench_questions").select("question_id", "gold_doc_ids")
    gold = questions.select("question_id", F.explode("gold_doc_ids").alias("_doc")).where("trim(_doc) <> ''")
    bonds = gold.select("question_id", F.concat(F.lit("doc:"), "_doc").alias("key")).union(
        table(spark, folder, "calibration_rows").select("question_id", F.col("group_key").alias("key"))
    )
    return splits.bound_units(questions, "question_id", bonds, "key")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The unit of every question."""
    return _question_units(spark, folder)


def p1_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Unit and split of every question."""
    return splits.assign_splits(_question_units(spark, folder), "unit_key", PROPORTIONS)


def p1_split_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Questions and units of each split, the share of questions and the largest unit."""
    return splits.split_shares(p1_splits(spark, folder), "unit_key")


def _overlaps(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    known = table(spark, folder, "calibration_rows").select("question_id", "split", "source")
    return overlap.split_overlaps(table(spark, folder, "bench_questions"), "question_id", "question", known)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of a training and an evaluation question that are the same or nearly so."""
    return overlap.overlap_pairs(*_overlaps(spark, folder), "question_id")


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation questions that also stand in training, per split and source."""
    links, members = _overlaps(spark, folder)
    return overlap.overlap_report(links, members, "question_id")


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of every chunk (texts as hash and length)."""
    rows = pieces.split_oversized(table(spark, folder, "chunks"))
    return rows.select(
        "chunk_id", "piece_no", "piece_start", "piece_end", "cut_kind",
        F.array_join("page_ids", " ").alias("page_ids"), F.md5("piece_text").alias("piece_md5"),
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """True article starts of oversized chunks, from their pieces."""
    rows = pieces.split_oversized(table(spark, folder, "chunks"))
    return rows.select("chunk_id", F.explode("article_starts").alias("marker_start")).distinct()


def p3_marker_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded markers of oversized chunks against the true starts: exact, shifted by up to 8 characters, or false."""
    true = checkpointed(p3_found(spark, folder))
    big = table(spark, folder, "chunks").where(F.length("text") > pieces.LIMIT).select("chunk_id").distinct()
    hints = table(spark, folder, "article_markers").select("chunk_id", "marker_start").join(big, "chunk_id", "left_semi")
    near = hints.distinct().join(true.withColumnRenamed("marker_start", "true_start"), "chunk_id", "left")
    gap = F.min(F.abs(F.col("marker_start") - F.col("true_start")))
    return (
        near.groupBy("chunk_id", "marker_start").agg(gap.alias("gap"))
        .groupBy(F.when(F.col("gap") == 0, "exact").when(F.col("gap") <= 8, "shifted").otherwise("false").alias("status"))
        .agg(F.count("*").alias("markers"))
    )


def _forms(spark: SparkSession, folder: str) -> DataFrame:
    chunks = charforms.look_alike_forms(table(spark, folder, "chunks"), "chunk_id", "text")
    questions = charforms.look_alike_forms(table(spark, folder, "bench_questions"), "question_id", "question")
    named = chunks.select(F.lit("chunks").alias("table_name"), "*").union(
        questions.select(F.lit("bench_questions").alias("table_name"), "*")
    )
    return checkpointed(named)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of rows whose texts look the same but are stored differently."""
    return charforms.look_alike_pairs(_forms(spark, folder), ["table_name"])


def p4_classes(spark: SparkSession, folder: str) -> DataFrame:
    """The class of equal-looking texts of every row, with the number of ways the class is stored."""
    forms = _forms(spark, folder)
    kinds = forms.groupBy("table_name", "class_id").agg(F.countDistinct("form").alias("forms"))
    return forms.join(kinds, ["table_name", "class_id"]).select("table_name", "id", "class_id", "form", "forms")


def _timings(spark: SparkSession, folder: str) -> DataFrame:
    return checkpointed(quantiles.request_timings(table(spark, folder, "request_events")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Requests above five times the median of their endpoint and pipeline."""
    return quantiles.slow_requests(_timings(spark, folder))


def p5_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles per endpoint, from digests of days that are merged."""
    by = ["endpoint", "metric"]
    days = quantiles.digest(_timings(spark, folder), [*by, "day"], "value")
    return quantiles.quantiles(quantiles.merge_digests(days, by), by, [0.5, 0.9, 0.95, 0.99])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The five best pages of every query."""
    return topn.top_n(table(spark, folder, "page_hits"), "query_id", "page_id", "score", 5).select(
        "query_id", "hit_rank", "page_id"
    )


def p6_top_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The five best pages of every query with their scores."""
    return topn.top_n(table(spark, folder, "page_hits"), "query_id", "page_id", "score", 5)


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document with its container."""
    return packing.pack_documents(table(spark, folder, "documents"), "doc_id", "text")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that are cut because they alone exceed a container."""
    return p7_containers(spark, folder).where("piece_no > 0").select("doc_id").distinct()


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers and the share of their space that is used."""
    used = p7_containers(spark, folder).where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    return used.agg(
        F.count("*").alias("containers"),
        F.sum("n").alias("tokens"),
        F.round(F.sum("n") / (F.count("*") * packing.CAPACITY), 6).alias("fill"),
        F.max("n").alias("fullest"),
    )


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.find_leaks(
        table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_passages"), "item_id", "text"
    )


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the items of which they repeat at least twelve consecutive words."""
    return _leaks(spark, folder).where(F.col("longest_run") >= leakage.RUN).select("doc_id", "item_id")


def p8_alignments(spark: SparkSession, folder: str) -> DataFrame:
    """Aligned candidates with score, item length and longest common run; edited copies included."""
    return _leaks(spark, folder)


def _abuse_scores(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.score_documents(table(spark, folder, "documents"), table(spark, folder, "doc_labels"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with an abusive, hateful or sexual utterance."""
    return _abuse_scores(spark, folder).where(F.col("score") >= abuse.THRESHOLD).select("doc_id").distinct()


def p9_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Score and kind of every document."""
    return _abuse_scores(spark, folder)


def p9_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Rates per source."""
    return abuse.rates_by_source(_abuse_scores(spark, folder))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_splits, p1_split_sizes, p2_found, p2_report, p3_found, p3_pieces, p3_marker_audit, p4_found,
        p4_classes, p5_found, p5_percentiles, p6_found, p6_top_pages, p7_found, p7_containers, p7_fill, p8_found,
        p8_alignments, p9_found, p9_scores, p9_rates,
    )
}
