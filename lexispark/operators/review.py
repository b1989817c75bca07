"""Review of questions, guards of the query path, rendering of sources, index checks and arm selection."""

from __future__ import annotations

import difflib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexispark.cluster import running_sums
from lexispark.functions.text import containment, page_doc, span_in, tokenize, tr_lower
from lexispark.operators.events import runs_of

# Limits of a request, words that generated questions must not hold, limits of the precheck, evidence
# length, bounds of the enablement verdict, attempts of a verification.
MAX_QUERY_CHARS, MAX_K = 500, 50
BANNED_IN_QUESTIONS = ["madde", "kanun", "fıkra", "fikra", "bent", "yukarıda", "bu metin", "metinde"]
MIN_QUESTION_CHARS = 15
SCANNED_CHARS = 40
PARAPHRASE_OVERLAP = 0.5
EVIDENCE_CHARS = 12_000
MAX_RISK, MAX_FALSE_ACCEPT, MAX_FALSE_ACCEPT_BOUND, MIN_SAFE_ACCEPT = 0.05, 0.02, 0.05, 0.80
ATTEMPTS = 10


def request_problem(text: Column, k: Column) -> Column:
    """Why a search request is refused, null if it isn't: too long, bad k, nothing left to search for."""
    return (
        F.when(F.length(F.coalesce(text, F.lit(""))) > MAX_QUERY_CHARS, "too long")
        .when((k < 1) | (k > MAX_K), "bad k")
        .when(F.size(tokenize(text)) == 0, "not searchable")
    )


def keeps_question(text: Column) -> Column:
    """Whether a generated question is long enough and names no part of the law."""
    low = F.lower(text)
    named = [F.contains(low, F.lit(w)) for w in BANNED_IN_QUESTIONS]
    bad = named[0]
    for c in named[1:]:
        bad = bad | c
    return (F.length(text) >= MIN_QUESTION_CHARS) & ~bad


def review_queue(questions: DataFrame) -> DataFrame:
    """Questions that no human has verified; a kind that was not recorded counts as human."""
    return questions.where(F.coalesce("verification_kind", F.lit("human")) != "human")


def apply_decisions(questions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions ``e`` (verify), ``h`` (reject) and ``a`` (skip) applied to their questions, all other columns kept.

    ``decisions`` has ``question_id``, ``letter``, ``by``, ``note``; one a question.
    """
    d = decisions.select("question_id", F.col("letter").alias("_l"), F.col("by").alias("_b"), F.col("note").alias("_n"))
    acted = F.col("_l").isin("e", "h")
    return (
        questions.join(d, "question_id", "left")
        .withColumn("verification_status", F.when(F.col("_l") == "e", "verified").when(F.col("_l") == "h", "rejected").otherwise(F.col("verification_status")))
        .withColumn("verified_by", F.when(acted, F.col("_b")).otherwise(F.col("verified_by")))
        .withColumn("verification_kind", F.when(acted, F.lit("human")).otherwise(F.col("verification_kind")))
        .withColumn("verification_note", F.when(F.coalesce("_n", F.lit("")) != "", F.col("_n")).otherwise(F.col("verification_note")))
        .drop("_l", "_b", "_n")
    )


def precheck(questions: DataFrame, pages: DataFrame, indexed: DataFrame) -> DataFrame:
    """``question_id``, ``verdict`` (clean, suspicious or manual) and ``notes``, what was found wrong.

    Unanswerable questions are clean.  Manual if a gold page has no text to speak of; else suspicious if there is a note:
    a gold page of a document that is no gold document, a gold page that is not in ``indexed`` (``page_id``), a span on no
    gold page, or a question of the paraphrase slice that shares more than half its tokens with a gold page.
    ``questions`` are distinct, with ``slice``; null spans are left out.
    """
    base = questions.select(
        "question_id", "question", "answerable", "slice", "minimal_evidence_spans", "gold_doc_ids", F.explode_outer("gold_page_ids").alias("page_id")
    )
    known = indexed.select("page_id").distinct().withColumn("_known", F.lit(True))
    rows = base.join(pages.select("page_id", "text"), "page_id", "left").join(known, "page_id", "left")
    spans = F.filter(F.coalesce("minimal_evidence_spans", F.array()), lambda s: s.isNotNull())
    found = F.filter(spans, lambda s: span_in(s, F.col("text")))
    named = F.col("page_id").isNotNull()
    each = rows.select(
        "question_id", "answerable", "slice", spans.alias("spans"), found.alias("found"),
        (named & (F.length(F.trim(F.coalesce("text", F.lit("")))) < SCANNED_CHARS)).alias("scanned"),
        (named & ~page_prefix_consistent(F.col("gold_doc_ids"), F.array("page_id"))).alias("other"),
        (named & F.col("_known").isNull()).alias("missing"),
        containment(tokenize(F.col("question")), tokenize(F.col("text"))).alias("overlap"),
    )
    one = each.groupBy("question_id", "answerable", "slice").agg(
        *[F.max(c).alias(c) for c in ("scanned", "other", "missing", "overlap")], F.first("spans").alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"),  # a question has few gold pages
    )
    close = (F.col("slice") == "paraphrase") & (F.col("overlap") > PARAPHRASE_OVERLAP)
    rules = {"other-document": F.col("other"), "not-indexed": F.col("missing"), "span-not-found": F.size(F.array_except("spans", "found")) > 0, "close-to-page": close}
    notes = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))
    verdict = F.when(F.col("scanned"), "manual").when(F.size("notes") > 0, "suspicious").otherwise("clean")
    answerable = F.coalesce("answerable", F.lit(False))
    rated = one.withColumn("notes", F.when(answerable, notes).otherwise(F.array().cast("array<string>")))
    return rated.select("question_id", F.when(~answerable, "clean").otherwise(verdict).alias("verdict"), "notes")


def closest_lines(spans: DataFrame) -> DataFrame:
    """Adds ``closest`` and ``ratio``: the line of ``text`` most like ``span`` by matching blocks (Arrow batches)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            best = []
            for span, text in zip(batch["span"], batch["text"], strict=True):
                lines = [x.strip() for x in (text or "").split("\n") if x.strip()]
                rated = [(difflib.SequenceMatcher(None, span or "", x, autojunk=False).ratio(), x) for x in lines]
                best.append(max(rated, key=lambda r: r[0]) if rated else (0.0, None))
            yield batch.assign(closest=[b[1] for b in best], ratio=[b[0] for b in best])

    types = ", ".join(f"{c} {t}" for c, t in spans.dtypes)
    return spans.mapInPandas(run, f"{types}, closest string, ratio double")


def served_hits(events: DataFrame) -> DataFrame:
    """``id``, ``rank``, ``page_id``, ``score`` of the hits in the JSON detail."""
    hits = F.from_json("detail", "hits array<struct<page_id: string, score: double>>")["hits"]
    rows = events.select("id", F.posexplode(hits).alias("n", "h"))
    return rows.select("id", (F.col("n") + 1).alias("rank"), F.col("h.page_id").alias("page_id"), F.col("h.score").alias("score"))


def cited_pages(citations: DataFrame, hits: DataFrame) -> DataFrame:
    """Citation numbers resolved to served hits; numbers out of range are ignored."""
    return citations.select("id", F.explode("sources").alias("rank")).join(hits, ["id", "rank"])


def source_marker(rank: Column, doc_name: Column, page_no: Column) -> Column:
    """``[Sn] name sayfa no``."""
    return F.concat(F.lit("[S"), rank.cast("string"), F.lit("] "), F.coalesce(doc_name, F.lit("")), F.lit(" sayfa "), page_no.cast("string"))


def evidence_text(text: Column, suffix: str = " …") -> Column:
    """Evidence cut at its limit, with a mark where it was cut."""
    return F.when(F.length(text) > EVIDENCE_CHARS, F.concat(F.substring(text, 1, EVIDENCE_CHARS), F.lit(suffix))).otherwise(text)


def render_query(text: Column, prefix: str = "Query: ", suffix: str = "<pad>", repeats: int = 10, newline: bool = True) -> Column:
    """Text with the prefix and repeated suffix a model was trained with."""
    return F.concat(F.lit(prefix), text, F.repeat(F.lit(suffix), F.lit(repeats)), F.lit("\n" if newline else ""))


def valid_expansion(question: Column, expansion: Column) -> Column:
    """An expansion with blanks squeezed, null if it is empty or only repeats the question."""
    squeeze = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    out = squeeze(expansion)
    return F.when((out != "") & (tr_lower(out) != tr_lower(squeeze(question))), out)


def error_class(code: Column, kind: Column) -> Column:
    """Class of a failed call from its HTTP code and kind; a kind that speaks of a key or a permission is ``auth`` too."""
    return (
        F.when(kind == "parse", "parse").when(code == 429, "http_429").when(code.isin(401, 403) | F.lower(kind).rlike("api.?key|permission|unauth|auth"), "auth")
        .when((code >= 500) & (code < 600), "http_5xx").when(kind == "timeout", "timeout").otherwise("other")
    )


def enablement(metrics: DataFrame) -> DataFrame:
    """Adds ``eligible``: all five conditions hold. Needs risk, false_rate, false_upper, safe_rate, identity."""
    ok = (
        (F.col("risk") <= MAX_RISK) & (F.col("false_rate") <= MAX_FALSE_ACCEPT) & (F.col("false_upper") <= MAX_FALSE_ACCEPT_BOUND)
        & (F.col("safe_rate") >= MIN_SAFE_ACCEPT) & F.col("identity")
    )
    return metrics.withColumn("eligible", F.coalesce(ok, F.lit(False)))


def best_arm(arms: DataFrame) -> DataFrame:
    """The arm with the best paraphrase coverage, then overall coverage, least disk, least latency, first name."""
    order = F.struct(-F.col("paraphrase"), -F.col("overall"), F.col("disk"), F.col("latency"), F.col("arm"))
    return arms.agg(F.min_by("arm", order).alias("arm"))


def trim_by_mask(vectors: Column, mask: Column) -> Column:
    """Vectors whose mask is set; padding goes."""
    return F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda z: z["m"]), lambda z: z["v"])


def page_offsets(sizes: DataFrame) -> DataFrame:
    """Adds ``begin``: where a page's tokens begin in an index in order of page ids; needs ``page_id``, ``length``."""
    return running_sums(sizes, [], [F.col("page_id")], ["length"]).withColumn("begin", F.col("length_upto") - F.col("length")).drop("length_upto")


def offset_problems(index: DataFrame) -> DataFrame:
    """Pages of an index whose ``begin`` doesn't follow from the lengths before, or that are empty, with ``expected``."""
    kept = index.select("page_id", "length", F.col("begin").alias("_begin"))
    return page_offsets(kept).withColumnRenamed("begin", "expected").withColumnRenamed("_begin", "begin").where(
        ~F.col("begin").eqNullSafe(F.col("expected")) | (F.col("length") <= 0)
    )


def compatibility_problems(manifest: DataFrame, serving: dict[str, str], checked: Sequence[str] = ("model_name", "model_revision", "query_format", "mask_policy")) -> DataFrame:
    """``problem`` rows: fields in which an index differs from what serves it; an unknown revision is no problem."""
    cells = [F.when(F.col(c) != F.lit(serving[c]), F.lit(c)) for c in checked if serving.get(c) not in (None, "unknown")]
    return manifest.select(F.explode(F.array_compact(F.array(*cells))).alias("problem"))


def within_budget(claims: DataFrame, budget: int = ATTEMPTS) -> DataFrame:
    """Adds ``allowed``: whether a claim's attempts still fit the answer's budget, in the order of claims."""
    used = F.sum("attempts").over(Window.partitionBy("answer_id").orderBy("claim_no").rowsBetween(Window.unboundedPreceding, 0))
    return claims.withColumn("allowed", used <= budget)


def rate_limited_warnings(events: DataFrame, key: str, seconds: int = 60) -> DataFrame:
    """Warnings that are emitted, at most one a key and ``seconds``, with how many after each are held back (``held``).

    After a pause of ``seconds`` a warning is emitted whatever was before, so each run of warnings without such a pause is a
    fold of its own, and a key with millions of failures is as many tasks' work as it has pauses.  Null keys are left out.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        us = np.sort(frame["us"].to_numpy())
        ids = frame.sort_values(["us", "id"])["id"].to_numpy()
        out, at = [], 0
        while at < len(us):
            then = int(np.searchsorted(us, us[at] + seconds * 1_000_000))
            out.append((frame[key].iloc[0], int(ids[at]), then - at - 1))
            at = then
        return pd.DataFrame(out, columns=[key, "id", "held"])

    rows = events.where(F.col(key).isNotNull()).select(key, "id", F.unix_micros("ts").alias("us"))
    runs = runs_of(rows, key, "us", seconds * 1_000_000)
    return runs.groupBy(key, "run").applyInPandas(run, f"{key} string, id long, held long")


def headings(lines: DataFrame, article: str, numbering: str, most: int = 3, chars: int = 90) -> DataFrame:
    """``keys``, ``line_no``, ``heading`` of article lines: up to ``most`` lines above, until one cannot belong to it."""
    order = Window.partitionBy("chunk_id").orderBy("line_no")
    out = lines
    for k in range(1, most + 1):
        above = F.lag("line", k).over(order)
        s = F.trim(F.regexp_replace(above, r"^\s+|\s+$", ""))
        ok = above.isNotNull() & (s != "") & ~above.rlike(article) & ~(s.endswith(".") & ~s.rlike(numbering)) & (F.length(s) <= chars)
        out = out.withColumn(f"_s{k}", s).withColumn(f"_ok{k}", F.coalesce(ok, F.lit(False)))
    use, parts = F.lit(True), []
    for k in range(1, most + 1):
        use = use & F.col(f"_ok{k}")
        parts.insert(0, F.when(use, F.col(f"_s{k}")))
    return out.where(F.col("line").rlike(article)).select("chunk_id", "line_no", F.array_join(F.array_compact(F.array(*parts)), " / ").alias("heading"))


def page_prefix_consistent(gold_docs: Column, gold_pages: Column) -> Column:
    """Whether the documents of all gold pages are gold documents."""
    return F.size(F.array_except(F.transform(F.coalesce(gold_pages, F.array()), page_doc), F.coalesce(gold_docs, F.array()))) == 0
