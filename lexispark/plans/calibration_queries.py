"""Calibration statistics over the calibration rows; the probability is the squashed mean of two features."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.operators import calibration as cal
from lexispark.plans.registry import query
from lexispark.plans.views import GOLD_SQL, HITS_SQL, gold_pages, hit_list, sql_upper_bound
from lexispark.sources.tables import table

TAU = 0.65
_ROWS = """r AS (SELECT question_id, label, answerable, slice, features, 1 / (1 + exp(-round(features['mogan_top1_mean'] + features['mogan_margin_mean'] / 4, 2))) AS p FROM calibration_rows),
u AS (SELECT * FROM r WHERE p IS NOT NULL AND NOT isnan(p) AND label IN (0, 1))"""
_VALUES = f"WITH {_ROWS}, v AS (SELECT p, count(*) AS n, sum(label) AS pos FROM u GROUP BY p)"
_CURVE = f"""{_VALUES}, c AS (SELECT p AS tau, sum(n) OVER w AS answered, sum(n - pos) OVER w AS errors FROM v WINDOW w AS (ORDER BY p DESC)
    UNION ALL SELECT NULL, 0, 0), curve AS (SELECT tau, answered / total AS coverage, CASE WHEN answered = 0 THEN 0 ELSE errors / answered END AS risk, answered, errors
    FROM c, (SELECT sum(n) AS total FROM v))"""


def rows(spark, folder):
    """Calibration rows with their probability."""
    f = F.col("features")
    z = F.round(f["mogan_top1_mean"] + f["mogan_margin_mean"] / 4, 2)
    return table(spark, folder, "calibration_rows").withColumn("p", 1 / (1 + F.exp(-z)))


def _rounded(df, *keep):
    return df.select(*keep, *[F.round(c, 6).alias(c) for c in df.columns if c not in keep])


@query(f"WITH {_ROWS} SELECT count(*) AS n, round(avg((p - label) * (p - label)), 6) AS brier FROM u")
def brier_score(spark, folder):
    """Brier score."""
    return _rounded(cal.brier(rows(spark, folder)), "n")


_BIN = f"""WITH {_ROWS}, b AS (SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(label) AS accuracy, avg(p) AS confidence FROM u GROUP BY 1)"""


@query(f"{_BIN} SELECT bin, n, round(accuracy, 6) AS accuracy, round(confidence, 6) AS confidence FROM b")
def ece_bins(spark, folder):
    """Accuracy and confidence by bin."""
    return _rounded(cal.ece_bins(rows(spark, folder)), "bin", "n")


@query(f"{_BIN} SELECT round(sum(n * abs(accuracy - confidence)) / sum(n), 6) AS ece FROM b")
def ece_score(spark, folder):
    """Expected calibration error."""
    return _rounded(cal.ece(rows(spark, folder)))


@query(f"""{_VALUES}, x AS (SELECT *, coalesce(sum(n - pos) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM v)
SELECT CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(n - pos) AS BIGINT) AS negatives, round(sum(pos * (below + (n - pos) / 2)) / nullif(sum(pos) * sum(n - pos), 0), 6) AS auroc FROM x""")
def auroc_score(spark, folder):
    """Area under the ROC curve."""
    return _rounded(cal.auroc(rows(spark, folder)), "positives", "negatives")


@query(f"{_CURVE} SELECT round(tau, 6) AS tau, round(coverage, 6) AS coverage, round(risk, 6) AS risk, CAST(answered AS BIGINT) AS answered, CAST(errors AS BIGINT) AS errors FROM curve")
def risk_coverage(spark, folder):
    """Risk-coverage curve with its sentinel."""
    return _rounded(cal.risk_coverage(rows(spark, folder)).drop("step", "risk_before"), "answered", "errors")


@query(f"""{_CURVE}, s AS (SELECT coverage - lag(coverage) OVER w AS dx, (risk + lag(risk) OVER w) / 2 AS h FROM curve WINDOW w AS (ORDER BY coverage))
SELECT round(sum(dx * h), 6) AS aurc FROM s""")
def aurc_score(spark, folder):
    """Area under the risk-coverage curve."""
    return _rounded(cal.aurc(cal.risk_coverage(rows(spark, folder))))


@query(f"WITH {_ROWS} SELECT count(*) AS answered, round(avg(label), 6) AS accuracy FROM u WHERE p >= {TAU}")
def selective_accuracy(spark, folder):
    """Accuracy of what is answered."""
    return _rounded(cal.selective_accuracy(rows(spark, folder), TAU), "answered")


@query(f"""WITH {_ROWS} SELECT round(count(CASE WHEN p < {TAU} AND label = 0 THEN 1 END) / nullif(count(CASE WHEN p < {TAU} THEN 1 END), 0), 6) AS precision,
round(count(CASE WHEN p < {TAU} AND label = 0 THEN 1 END) / nullif(count(CASE WHEN label = 0 THEN 1 END), 0), 6) AS recall FROM u""")
def abstain_quality(spark, folder):
    """Precision and recall of abstaining."""
    return _rounded(cal.abstain_quality(rows(spark, folder), TAU))


@query(f"""WITH {_ROWS}, o AS (SELECT p, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS n FROM u WHERE label = 0)
SELECT (SELECT count(*) FROM u WHERE label = 0) AS errors, round((SELECT p FROM o WHERE k = ceil((n + 1) * 0.95 - 1e-9)), 6) AS threshold,
(SELECT count(*) FROM o WHERE k = ceil((n + 1) * 0.95 - 1e-9)) > 0 AND (SELECT count(*) FROM u WHERE label = 0) >= 19 AS available""")
def conformal_threshold(spark, folder):
    """Split-conformal threshold."""
    out = cal.conformal_threshold(rows(spark, folder))
    return out.select("errors", F.round("threshold", 6).alias("threshold"), "available")


_FALSE = f"""WITH RECURSIVE {_ROWS}, s AS (SELECT 1 AS one, count(*) AS n, count(CASE WHEN p >= {TAU} THEN 1 END) AS errors FROM u WHERE NOT answerable), {sql_upper_bound('s', 'one')}"""


@query(f"""{_FALSE}, t AS (SELECT *, errors / nullif(n, 0) AS r, {cal.Z95} AS z FROM s)
SELECT n, errors, round(r, 6) AS rate, round(cp.upper, 6) AS upper, round((r + z * z / (2 * n) + z * sqrt(r * (1 - r) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS wilson FROM t, cp""")
def false_answer_rate(spark, folder):
    """Unanswerable questions that would be answered, with their bounds."""
    return _rounded(cal.false_answers(rows(spark, folder), TAU), "n", "errors")


@query(f"""WITH RECURSIVE {_ROWS}, s AS (SELECT slice, count(*) AS n, count(CASE WHEN label = 0 THEN 1 END) AS errors FROM u WHERE p >= {TAU} GROUP BY slice), {sql_upper_bound('s', 'slice')}
SELECT s.slice, n, errors, round(upper, 6) AS upper FROM s JOIN cp ON cp.key IS NOT DISTINCT FROM s.slice""")
def clopper_pearson_by_slice(spark, folder):
    """Clopper-Pearson bound of wrong answers per slice."""
    seen = cal.usable(rows(spark, folder)).where(F.col("p") >= TAU).groupBy("slice").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 0).alias("errors"))
    return seen.withColumn("upper", F.round(cal.clopper_pearson_udf("errors", "n"), 6))


def _threshold_sql(budget: float) -> str:
    return f"""{_CURVE.replace('WITH', 'WITH RECURSIVE', 1)}, k AS (SELECT *, coverage > 0 AND risk <= {budget} AS fits FROM curve), m AS (SELECT max(coverage) AS best FROM k WHERE fits),
s AS (SELECT 1 AS one, tau, coverage, risk, answered AS n, errors FROM k, m WHERE (best IS NOT NULL AND fits AND coverage = best) OR (best IS NULL AND tau IS NULL)), {sql_upper_bound('s', 'one')}
SELECT round(tau, 6) AS tau, round(coverage, 6) AS coverage, round(risk, 6) AS risk, CAST(n AS BIGINT) AS answered, CAST(errors AS BIGINT) AS errors, round(upper, 6) AS upper, coalesce(upper <= {budget}, false) AS guaranteed FROM s, cp"""


@query(_threshold_sql(cal.RISK_BUDGET))
def choose_threshold(spark, folder):
    """Widest coverage within the risk budget, with the bound of its risk; nothing is answered where no point keeps it."""
    return _rounded(cal.choose_threshold(cal.risk_coverage(rows(spark, folder))), "answered", "errors", "guaranteed")


@query(_threshold_sql(0.3))
def choose_threshold_wide(spark, folder):
    """The same within a budget of 0.3."""
    return _rounded(cal.choose_threshold(cal.risk_coverage(rows(spark, folder)), 0.3), "answered", "errors", "guaranteed")


_LABELS = f"""{GOLD_SQL}, {HITS_SQL}, hit AS (SELECT DISTINCT query_id FROM gold JOIN hits USING (query_id, page_id) WHERE rank <= 5),
l AS (SELECT q.question_id AS query_id, hit.query_id IS NOT NULL AS gold_in_topk, CAST(coalesce(answerable, false) AND hit.query_id IS NOT NULL AS INTEGER) AS label
      FROM (SELECT DISTINCT question_id, answerable FROM bench_questions) q LEFT JOIN hit ON hit.query_id = q.question_id)"""


@query(f"WITH {_LABELS} SELECT query_id, gold_in_topk, label FROM l")
def safe_to_answer(spark, folder):
    """Whether each question is answerable with a gold page among its five best hits."""
    questions = table(spark, folder, "bench_questions").select(F.col("question_id").alias("query_id"), "answerable").distinct()
    return cal.safe_to_answer(questions, gold_pages(spark, folder), hit_list(spark, folder, limit=5))


@query(f"""WITH human AS (SELECT DISTINCT question_id, answerable FROM bench_questions WHERE answerable AND coalesce(verification_kind, 'human') = 'human'),
closed AS (SELECT DISTINCT question_id, answerable FROM bench_questions WHERE NOT answerable AND verification_status = 'verified')
SELECT question_id, answerable, 'retrieval' AS source FROM human UNION ALL SELECT question_id, answerable, 'abstention' FROM closed""")
def calibration_load(spark, folder):
    """Questions to calibrate on from two sources: answerable ones that a human verified, unanswerable ones verified."""
    q = table(spark, folder, "bench_questions")
    human = q.where("answerable and coalesce(verification_kind, 'human') = 'human'").select("question_id", "answerable").distinct()
    closed = q.where("not answerable and verification_status = 'verified'").select("question_id", "answerable").distinct()
    return human.withColumn("source", F.lit("retrieval")).unionByName(closed.withColumn("source", F.lit("abstention")))


@query(f"""{_FALSE}, b AS (SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(label) AS accuracy, avg(p) AS confidence FROM u GROUP BY 1),
v AS (SELECT p, count(*) AS n, sum(label) AS pos FROM u GROUP BY p),
x AS (SELECT *, coalesce(sum(n - pos) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM v),
c AS (SELECT p AS tau, sum(n) OVER w AS answered, sum(n - pos) OVER w AS errors FROM v WINDOW w AS (ORDER BY p DESC) UNION ALL SELECT NULL, 0, 0),
curve AS (SELECT answered / total AS coverage, CASE WHEN answered = 0 THEN 0 ELSE errors / answered END AS risk FROM c, (SELECT sum(n) AS total FROM v)),
h AS (SELECT coverage - lag(coverage) OVER w AS dx, (risk + lag(risk) OVER w) / 2 AS h FROM curve WINDOW w AS (ORDER BY coverage)),
a AS (SELECT 1 AS one, count(CASE WHEN p >= {TAU} THEN 1 END) AS n, count(CASE WHEN p >= {TAU} AND label = 0 THEN 1 END) AS errors, count(*) AS total, avg((p - label) * (p - label)) AS brier,
      count(CASE WHEN p < {TAU} AND label = 0 THEN 1 END) AS held_wrong, count(CASE WHEN label = 0 THEN 1 END) AS wrong FROM u), {sql_upper_bound('a', 'one', 'risk_cp')}
SELECT total AS n, round(brier, 6) AS brier, round((SELECT sum(n * abs(accuracy - confidence)) / sum(n) FROM b), 6) AS ece,
(SELECT CAST(sum(pos) AS BIGINT) FROM x) AS positives, (SELECT CAST(sum(n - pos) AS BIGINT) FROM x) AS negatives,
round((SELECT sum(pos * (below + (n - pos) / 2)) / nullif(sum(pos) * sum(n - pos), 0) FROM x), 6) AS auroc, round((SELECT sum(dx * h) FROM h), 6) AS aurc,
a.n AS answered, a.errors, round(held_wrong / nullif(total - a.n, 0), 6) AS abstain_precision, round(held_wrong / nullif(wrong, 0), 6) AS abstain_recall,
round(s.errors / nullif(s.n, 0), 6) AS false_answer_rate, round(cp.upper, 6) AS false_answer_upper, round(a.n / total, 6) AS coverage,
round(a.errors / nullif(a.n, 0), 6) AS risk, round(risk_cp.upper, 6) AS risk_upper FROM a, s, cp, risk_cp""")
def calibration_report(spark, folder):
    """All calibration statistics in one row."""
    return _rounded(cal.calibration_report(rows(spark, folder), TAU), "n", "positives", "negatives", "answered", "errors")


_LONG = """WITH l AS (SELECT label, unnest(map_entries(features)) AS e FROM calibration_rows WHERE features IS NOT NULL),
f AS (SELECT label, e.key AS feature, e.value AS x FROM l WHERE e.value IS NOT NULL AND NOT isnan(e.value))"""


@query(f"""{_LONG} SELECT feature, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max,
round(avg(CASE WHEN label = 1 THEN x END), 6) AS mean_pos, round(avg(CASE WHEN label = 0 THEN x END), 6) AS mean_neg FROM f GROUP BY feature""")
def feature_statistics(spark, folder):
    """Moments of every feature."""
    return _rounded(cal.feature_stats(table(spark, folder, "calibration_rows")), "feature", "n")


_FEATURES = ["mogan_top1_mean", "mogan_margin_mean", "colmm_top1_mean", "colmm_margin_mean"]
_PAIRS = [(a, b) for i, a in enumerate(_FEATURES) for b in _FEATURES[i:]]


@query(" UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(coalesce(CASE WHEN isnan(r) THEN 0 ELSE r END, 0), 6) AS r FROM (SELECT corr(features['{a}'], features['{b}']) AS r FROM calibration_rows)"
    for a, b in _PAIRS
))
def feature_correlations(spark, folder):
    """Pearson correlation of feature pairs."""
    return _rounded(cal.feature_correlations(table(spark, folder, "calibration_rows"), _FEATURES), "a", "b")


@query(f"""{_LONG}, v AS (SELECT feature, x, count(*) AS n, sum(label) AS pos FROM f GROUP BY ALL),
k AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY feature ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS rk FROM v)
SELECT feature, round((sum(rk * pos) - sum(pos) * (sum(pos) + 1) / 2) / nullif(sum(pos) * sum(n - pos), 0), 6) AS auc FROM k GROUP BY feature""")
def feature_auc(spark, folder):
    """AUROC of every single feature."""
    return _rounded(cal.average_ranks_auc(table(spark, folder, "calibration_rows")), "feature")


@query()
def logistic_predictions(spark, folder):
    """Probability of a logistic regression fitted on the training split, for every row."""
    data = table(spark, folder, "calibration_rows")
    model = cal.fit_logistic(data.where("split = 'train'"), _FEATURES)
    return data.select("question_id", F.round(cal.predict_logistic(F.col("features"), model), 4).alias("p"), "label")


@query("""SELECT slice, count(*) AS total, count(CASE WHEN label = 1 THEN 1 END) AS positive, count(CASE WHEN label = 0 THEN 1 END) AS negative,
count(CASE WHEN answerable THEN 1 END) AS answerable, count(CASE WHEN gold_in_topk THEN 1 END) AS hit FROM calibration_rows GROUP BY slice""")
def class_counts(spark, folder):
    """Rows by class and slice."""
    return table(spark, folder, "calibration_rows").groupBy("slice").agg(
        F.count("*").alias("total"), F.count_if(F.col("label") == 1).alias("positive"), F.count_if(F.col("label") == 0).alias("negative"),
        F.count_if("answerable").alias("answerable"), F.count_if("gold_in_topk").alias("hit"),
    )


@query(f"WITH {_ROWS} SELECT question_id, round(p, 6) AS p, p IS NOT NULL AND p >= {TAU} AS passes FROM r")
def calibrated_gate(spark, folder):
    """Gate decision of every row."""
    return rows(spark, folder).select("question_id", F.round("p", 6).alias("p"), cal.gate(F.col("p"), F.lit(TAU)).alias("passes"))
