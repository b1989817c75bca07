"""Calibration and selective-answering statistics over rows of probability ``p`` and binary ``label``.

Rows with a null probability or label don't count.  Rates over no rows are null unless stated otherwise.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lexispark.cluster import running_sums

# Bins, budgets, confidence, quantile of the normal distribution at 0.95.
BINS = 10
RISK_BUDGET = 0.05
ALPHA = 0.05
Z95 = 1.6448536269514722
LEARNING_RATE, L2, MAX_ITER, TOL = 0.5, 1.0, 50_000, 1e-9


def sigmoid(z: Column) -> Column:
    """Logistic function that never overflows."""
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def usable(rows: DataFrame) -> DataFrame:
    return rows.where("p is not null and not isnan(p) and label in (0, 1)")


def brier(rows: DataFrame) -> DataFrame:
    """Mean squared difference of probability and label."""
    return usable(rows).agg(F.count("*").alias("n"), F.avg(F.pow(F.col("p") - F.col("label"), 2)).alias("brier"))


def ece_bins(rows: DataFrame, bins: int = BINS) -> DataFrame:
    """Rows, accuracy and confidence of each non-empty bin of equal width."""
    cell = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return usable(rows).groupBy(cell.alias("bin")).agg(
        F.count("*").alias("n"), F.avg("label").alias("accuracy"), F.avg("p").alias("confidence")
    )


def ece(rows: DataFrame, bins: int = BINS) -> DataFrame:
    """Expected calibration error."""
    gap = F.abs(F.col("accuracy") - F.col("confidence"))
    return ece_bins(rows, bins).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"))


def _by_value(rows: DataFrame) -> DataFrame:
    """Rows counted by distinct probability: all curves below are functions of these counts."""
    return usable(rows).groupBy("p").agg(F.count("*").alias("n"), F.sum("label").alias("pos"))


def auroc(rows: DataFrame) -> DataFrame:
    """Area under the ROC curve with ties counted half; null unless both classes occur."""
    values = _by_value(rows).withColumn("neg", F.col("n") - F.col("pos"))
    wins = running_sums(values, [], [F.col("p")], ["neg"]).withColumn("below", F.col("neg_upto") - F.col("neg"))
    area = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2))
    return wins.agg(
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
        (area / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auroc"),
    )


def risk_coverage(rows: DataFrame) -> DataFrame:
    """``tau``, ``coverage``, ``risk``, ``answered``, ``errors`` for every distinct probability.

    The sentinel above the largest probability, where nothing is answered, has ``tau`` null, coverage 0 and risk 0.
    ``step`` and ``risk_before`` are the coverage gained over the next higher point and the risk there.
    """
    values = _by_value(rows).withColumn("wrong", F.col("n") - F.col("pos"))
    sums = running_sums(values, [], [F.desc("p")], ["n", "wrong"])
    total = values.agg(F.sum("n").alias("total"))
    points = sums.select(F.col("p").alias("tau"), F.col("n_upto").alias("answered"), F.col("wrong_upto").alias("errors"), "n", "wrong")
    end = rows.sparkSession.createDataFrame([(None, 0, 0, 0, 0)], "tau double, answered long, errors long, n long, wrong long")
    risk = lambda e, a: F.when(a == 0, F.lit(0.0)).otherwise(e / a)
    answered, errors = F.col("answered"), F.col("errors")
    return points.unionByName(end).join(F.broadcast(total), how="left").where("total > 0").select(  # total is one row
        "tau",
        (answered / F.col("total")).alias("coverage"),
        risk(errors, answered).alias("risk"),
        "answered",
        "errors",
        (F.col("n") / F.col("total")).alias("step"),
        risk(errors - F.col("wrong"), answered - F.col("n")).alias("risk_before"),
    )


def aurc(curve: DataFrame) -> DataFrame:
    """Area under the risk-coverage curve by trapezoids; every point knows its step and the risk before it."""
    return curve.agg(F.sum(F.col("step") * (F.col("risk") + F.col("risk_before")) / 2).alias("aurc"))


def selective_accuracy(rows: DataFrame, tau: float) -> DataFrame:
    """Share of right answers among those with probability ``tau`` or more; null if none is answered."""
    return usable(rows).where(F.col("p") >= tau).agg(F.count("*").alias("answered"), F.avg("label").alias("accuracy"))


def abstain_quality(rows: DataFrame, tau: float) -> DataFrame:
    """Precision and recall of abstaining (positive: label 0) at ``tau``."""
    held, wrong = F.col("p") < tau, F.col("label") == 0
    both = F.count_if(held & wrong)
    return usable(rows).agg(
        (both / F.nullif(F.count_if(held), F.lit(0))).alias("precision"), (both / F.nullif(F.count_if(wrong), F.lit(0))).alias("recall")
    )


def conformal_threshold(rows: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Split-conformal threshold: order statistic ceil((n + 1)(1 - alpha)) of the confidences of errors.

    Found from counts by value; ``available`` is false when too few errors were seen.
    """
    values = usable(rows).where("label = 0").groupBy("p").agg(F.count("*").alias("n"))
    total = values.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("errors"))
    need = F.ceil((F.col("errors") + 1) * F.lit(1 - alpha) - 1e-9)
    found = running_sums(values, [], [F.col("p")], ["n"]).withColumnRenamed("n_upto", "upto")
    return total.join(found, how="left").groupBy("errors").agg(  # total is one row
        F.min(F.when(F.col("upto") >= need, F.col("p"))).alias("threshold")
    ).withColumn("available", F.col("threshold").isNotNull() & (F.col("errors") >= math.ceil(1 / alpha) - 1))


def wilson_upper(errors: Column, n: Column, z: float = Z95) -> Column:
    """One-sided Wilson upper bound of a rate; null for no rows."""
    rate = errors / F.nullif(n, F.lit(0))
    centre = rate + z * z / (2 * n)
    spread = z * F.sqrt(rate * (1 - rate) / n + z * z / (4 * n * n))
    return (centre + spread) / (1 + z * z / n)


def clopper_pearson(errors: int, n: int, alpha: float = ALPHA) -> float:
    """One-sided Clopper-Pearson upper bound by bisection of the binomial distribution."""
    if not 0 <= errors <= n or n == 0:
        raise ValueError("errors must lie in 0 .. n, n above 0")
    if errors == n:
        return 1.0
    if errors == 0:
        return 1 - alpha ** (1 / n)
    # terms from the largest down; those further than 40 deviations below it add nothing that a double could hold
    k = np.arange(errors, max(errors - 100 - 40 * math.isqrt(n), 0), -1)
    top = math.lgamma(n + 1) - math.lgamma(errors + 1) - math.lgamma(n - errors + 1)
    ways = top + np.concatenate([[0.0], np.cumsum(np.log(k) - np.log(n - k + 1.0))])
    k = np.concatenate([k, [k[-1] - 1]])
    low, high = errors / n, 1.0  # below the rate the distribution at ``errors`` is about a half or more
    for _ in range(100):
        mid = (low + high) / 2
        if mid >= 1:
            break
        cdf = np.exp(ways + k * math.log(mid) + (n - k) * math.log1p(-mid)).sum()
        low, high = (mid, high) if cdf > alpha else (low, mid)
    return (low + high) / 2


@F.pandas_udf(DoubleType())
def clopper_pearson_udf(errors: pd.Series, n: pd.Series) -> pd.Series:
    """Column form of ``clopper_pearson``; null where it has no value."""
    return errors.combine(n, lambda e, m: clopper_pearson(int(e), int(m)) if m and 0 <= e <= m else None).astype("float64")


def false_answers(rows: DataFrame, tau: float) -> DataFrame:
    """How often unanswerable questions are answered at ``tau``, with its Clopper-Pearson and its Wilson upper bound."""
    seen = usable(rows).where("not answerable").agg(F.count("*").alias("n"), F.count_if(F.col("p") >= tau).alias("errors"))
    return seen.select(
        "n", "errors", (F.col("errors") / F.nullif(F.col("n"), F.lit(0))).alias("rate"),
        clopper_pearson_udf("errors", "n").alias("upper"), wilson_upper(F.col("errors"), F.col("n")).alias("wilson"),
    )


def choose_threshold(curve: DataFrame, budget: float = RISK_BUDGET) -> DataFrame:
    """The point of largest coverage above 0 whose risk keeps the budget, the sentinel if there is none; with the
    Clopper-Pearson bound of its risk and whether that bound keeps the budget too (``guaranteed``)."""
    fits = (F.col("coverage") > 0) & (F.col("risk") <= budget)
    order = F.struct(F.when(fits, F.col("coverage")).otherwise(F.lit(-1.0)), (F.col("tau").isNull()).cast("int"))
    row = F.struct("tau", "coverage", "risk", "answered", "errors")
    best = curve.agg(F.max_by(row, order).alias("r")).select("r.*")
    bounded = best.withColumn("upper", clopper_pearson_udf(F.col("errors").cast("long"), F.col("answered").cast("long")))
    return bounded.withColumn("guaranteed", F.coalesce(F.col("upper") <= budget, F.lit(False)))


def safe_to_answer(questions: DataFrame, gold: DataFrame, ranked: DataFrame, k: int = 5) -> DataFrame:
    """``query_id``, ``gold_in_topk``, ``label``: a question is safe to answer if it is answerable and one of its gold
    pages stands among the first ``k`` pages.

    ``questions`` has ``query_id``, ``answerable``; ``gold`` and ``ranked`` have ``query_id``, ``page_id``, ``ranked`` also
    ``rank``.  Questions without gold pages or without hits are not hit; a null ``answerable`` counts as false.
    """
    hit = gold.join(ranked.where(F.col("rank") <= k).select("query_id", "page_id"), ["query_id", "page_id"]).select("query_id").distinct()
    found = questions.join(hit.withColumn("_hit", F.lit(True)), "query_id", "left")
    in_top = F.coalesce("_hit", F.lit(False))
    return found.select("query_id", in_top.alias("gold_in_topk"), (F.coalesce("answerable", F.lit(False)) & in_top).cast("int").alias("label"))


def calibration_report(rows: DataFrame, tau: float, bins: int = BINS) -> DataFrame:
    """One row: rows, Brier score, calibration error, AUROC, AURC, and at ``tau`` coverage, risk with its bound, precision
    and recall of abstaining, and false answers with their bound.  Each part is a statistic of its own over the rows."""
    at = usable(rows).agg(
        F.count_if(F.col("p") >= tau).alias("answered"), F.count_if((F.col("p") >= tau) & (F.col("label") == 0)).alias("errors")
    )
    held = abstain_quality(rows, tau).select(F.col("precision").alias("abstain_precision"), F.col("recall").alias("abstain_recall"))
    wrong = false_answers(rows, tau).select(F.col("rate").alias("false_answer_rate"), F.col("upper").alias("false_answer_upper"))
    out = brier(rows)
    for part in (ece(rows, bins), auroc(rows), aurc(risk_coverage(rows)), at, held, wrong):
        out = out.join(F.broadcast(part), how="left")  # each is one row
    none = F.lit(0)
    return out.withColumn("coverage", F.col("answered") / F.nullif(F.col("n"), none)).withColumn(
        "risk", F.col("errors") / F.nullif(F.col("answered"), none)
    ).withColumn("risk_upper", clopper_pearson_udf("errors", "answered"))


def feature_stats(rows: DataFrame) -> DataFrame:
    """Per feature: mean, population deviation, range and the mean of each class; ``rows`` has ``features`` and ``label``."""
    long = rows.where("features is not null").select("label", F.explode("features").alias("feature", "x"))
    x = F.col("x")
    return long.where(x.isNotNull() & ~F.isnan(x)).groupBy("feature").agg(
        F.count("*").alias("n"),
        F.avg(x).alias("mean"),
        F.stddev_pop(x).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.avg(F.when(F.col("label") == 1, x)).alias("mean_pos"),
        F.avg(F.when(F.col("label") == 0, x)).alias("mean_neg"),
    )


def feature_correlations(rows: DataFrame, names: list[str]) -> DataFrame:
    """Pearson correlation of every pair of features (not finite becomes 0), in one pass."""
    wide = rows.where("features is not null").select(*[F.col("features")[n].alias(n) for n in names])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    one = wide.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    flat = one.select(F.explode(cells).alias("c")).select("c.a", "c.b", "c.r")
    return flat.withColumn("r", F.when(F.col("r").isNull() | F.isnan("r"), F.lit(0.0)).otherwise(F.col("r")))


def average_ranks_auc(rows: DataFrame) -> DataFrame:
    """AUROC of every single feature, by average ranks."""
    long = rows.where("features is not null").select("label", F.explode("features").alias("feature", "x")).where("x is not null and not isnan(x)")
    values = long.groupBy("feature", "x").agg(F.count("*").alias("n"), F.sum("label").alias("pos"))
    sums = running_sums(values, ["feature"], [F.col("x")], ["n"])
    ranked = sums.withColumn("rank", F.col("n_upto") - F.col("n") + (F.col("n") + 1) / 2)
    p, n = F.sum("pos"), F.sum(F.col("n") - F.col("pos"))
    return ranked.groupBy("feature").agg(((F.sum(F.col("rank") * F.col("pos")) - p * (p + 1) / 2) / F.nullif(p * n, F.lit(0))).alias("auc"))


def fit_logistic(rows: DataFrame, names: list[str], max_rows: int = 200_000) -> dict:
    """Weights, bias, means and deviations of a logistic regression on standardised features.

    Full-batch gradient descent from zero without random numbers; labelled rows are few, and a table of more than
    ``max_rows`` (a stated bound) is cut to those with the smallest hash.
    """
    wide = rows.where("features is not null and label in (0, 1)").select(*[F.col("features")[n].cast("double").alias(n) for n in names], "label").dropna()
    data = wide.orderBy(F.xxhash64(*names, "label"), *names, "label").limit(max_rows).toPandas().to_numpy(float)
    if not len(data):
        raise ValueError("no rows to fit")
    x, y = data[:, :-1], data[:, -1]
    if y.min() == y.max():
        raise ValueError("both classes are needed")
    mean, std = x.mean(0), x.std(0)
    std[std == 0] = 1.0
    z = (x - mean) / std
    w, b, n, steps = np.zeros(z.shape[1]), 0.0, len(z), 0
    for _ in range(MAX_ITER):
        error = 1 / (1 + np.exp(-np.clip(z @ w + b, -500, 500))) - y
        gw, gb = z.T @ error / n + L2 / n * w, error.mean()
        if max(np.abs(gw).max(), abs(gb)) < TOL:
            break
        w, b, steps = w - LEARNING_RATE * gw, b - LEARNING_RATE * gb, steps + 1
    return {"rows": n, "positive": int(y.sum()), "steps": steps, "names": names, "mean": mean.tolist(), "std": std.tolist(), "weights": w.tolist(), "bias": float(b)}


def predict_logistic(features: Column, model: dict) -> Column:
    """Probability as a column expression of a feature map."""
    z = F.lit(model["bias"])
    for name, mean, std, weight in zip(model["names"], model["mean"], model["std"], model["weights"], strict=True):
        z = z + (features[name] - mean) / std * weight
    return sigmoid(z)


def gate(p: Column, tau: Column) -> Column:
    """Whether a calibrated gate lets an answer pass."""
    return p.isNotNull() & (p >= tau)
