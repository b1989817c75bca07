"""Gates that decide whether an answer is served: decisions only, models plug in as given columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.operators.calibration import clopper_pearson_udf
from lexispark.operators.structure import MAX_CLAIMS

# Prices per million tokens.
PRICE_IN, PRICE_OUT = 0.10, 0.40


def evidence_gate(answers: DataFrame, claims: DataFrame) -> DataFrame:
    """Per answer: claims, supported claims and whether it is demoted.

    An answer stands only if it has claims, at most ``MAX_CLAIMS``, and every one is supported.  ``answers`` has
    ``answer_id``, ``claims`` has ``answer_id``, ``verdict``; a null verdict counts as undecided, an answer without claims
    is demoted.
    """
    ok = F.coalesce(F.col("verdict") == "supported", F.lit(False))
    counts = claims.groupBy("answer_id").agg(F.count("*").alias("claims"), F.count_if(ok).alias("supported"))
    out = answers.select("answer_id").distinct().join(counts, "answer_id", "left").fillna(0, ["claims", "supported"])
    return out.withColumn("demoted", (F.col("claims") == 0) | (F.col("claims") > MAX_CLAIMS) | (F.col("supported") < F.col("claims")))


def ask_decision(hit: Column, passed: Column, failed: Column, demoted: Column) -> Column:
    """What is served: nothing found, held back by the first gate, failed, held back by the second gate, or answered."""
    no = lambda c: ~F.coalesce(c, F.lit(True))
    return (
        F.when(no(hit), "abstain:threshold")
        .when(no(passed), "abstain:gate1")
        .when(F.coalesce(failed, F.lit(False)), "degraded")
        .when(F.coalesce(demoted, F.lit(False)), "abstain:gate2_demote")
        .otherwise("answer")
    )


def skip_reason(abstained: Column, honest_miss: Column, citations: Column) -> Column:
    """Why the evidence gate has nothing to do: the first reason that holds, else null."""
    return (
        F.when(F.coalesce(abstained, F.lit(False)), "abstained")
        .when(F.coalesce(honest_miss, F.lit(False)), "honest_miss")
        .when(F.coalesce(citations, F.lit(0)) == 0, "no_citations")
    )


def abstain_reason(status: Column, abstained: Column, detail: Column) -> Column:
    """Why a request was not answered; null if it was."""
    flag = lambda path: F.get_json_object(detail, path)
    return (
        F.when(status == "degraded", "degraded")
        .when(~F.coalesce(abstained, F.lit(False)), F.lit(None).cast("string"))
        .when(flag("$.gate2.demoted") == "true", "gate2_demote")
        .when(flag("$.gate1.passed") == "false", "gate1")
        .otherwise("threshold")
    )


def token_cost(tokens_in: Column, tokens_out: Column) -> Column:
    """Cost in USD; null unless both numbers are known."""
    return tokens_in / 1e6 * PRICE_IN + tokens_out / 1e6 * PRICE_OUT


def answer_metrics(answers: DataFrame, claims: DataFrame) -> DataFrame:
    """One row: how often a cited claim is supported, how many claims are cited, and how often an unanswerable question is
    answered with support, each with its numbers and the Clopper-Pearson bound of the errors.

    ``answers`` has ``answer_id``, ``answerable``, ``status``, ``honest_miss``; ``claims`` has ``answer_id``, ``verdict``,
    ``cited``.  A falsely supported answer is one to an unanswerable question that was given, admits no miss, and has
    claims all of which are supported.  A rate over nothing is null, and so is its bound.
    """
    ok = F.coalesce(F.col("verdict") == "supported", F.lit(False))
    cited = F.coalesce(F.col("cited"), F.lit(False))
    own = claims.groupBy("answer_id").agg(
        F.count("*").alias("n"), F.count_if(cited).alias("cited"), F.count_if(cited & ok).alias("cited_ok"), F.count_if(ok).alias("ok")
    )
    false = (F.col("status") == "answered") & ~F.coalesce("honest_miss", F.lit(False)) & (F.col("n") > 0) & (F.col("ok") == F.col("n"))
    closed = ~F.col("answerable")
    sums = answers.join(own, "answer_id", "left").agg(
        F.count("*").alias("answers"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("claims"),
        F.coalesce(F.sum("cited"), F.lit(0)).alias("cited"),
        F.coalesce(F.sum("cited_ok"), F.lit(0)).alias("cited_supported"),
        F.count_if(closed).alias("unanswerable"),
        F.count_if(closed & false).alias("false_supported"),
    )
    rate = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    return sums.select(
        "*",
        rate("cited_supported", "cited").alias("citation_precision"),
        (1 - clopper_pearson_udf(F.col("cited") - F.col("cited_supported"), F.col("cited"))).alias("precision_lower"),
        rate("cited", "claims").alias("completeness"),
        clopper_pearson_udf(F.col("claims") - F.col("cited"), F.col("claims")).alias("uncited_upper"),
        rate("false_supported", "unanswerable").alias("false_supported_rate"),
        clopper_pearson_udf(F.col("false_supported"), F.col("unanswerable")).alias("false_supported_upper"),
    )
