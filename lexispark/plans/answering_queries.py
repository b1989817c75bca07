"""Gates over the request log and the calibration rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.functions import text as tx
from lexispark.operators import answering
from lexispark.operators.events import clean_events
from lexispark.plans.event_queries import _E
from lexispark.plans.registry import query
from lexispark.plans.views import sql_upper_bound
from lexispark.sources.tables import table

_PASSED = "CASE json_extract_string(detail, '$.gate1.passed') WHEN 'true' THEN true WHEN 'false' THEN false END"
_DEMOTED = "coalesce(json_extract_string(detail, '$.gate2.demoted') = 'true', false)"


@query(f"""WITH {_E}, d AS (SELECT CASE WHEN NOT coalesce(top_score >= 10.6 AND NOT isnan(top_score), true) THEN 'abstain:threshold' WHEN NOT coalesce({_PASSED}, true) THEN 'abstain:gate1'
WHEN coalesce(status = 'degraded', false) THEN 'degraded' WHEN {_DEMOTED} THEN 'abstain:gate2_demote' ELSE 'answer' END AS decision, status FROM e WHERE endpoint = '/ask')
SELECT decision, status, count(*) AS requests FROM d GROUP BY ALL""")
def ask_decisions(spark, folder):
    """What the chain of gates serves, from the stage outputs in the log."""
    rows = clean_events(table(spark, folder, "request_events")).where("endpoint = '/ask'")
    passed = F.get_json_object("detail", "$.gate1.passed").try_cast("boolean")
    demoted = F.coalesce(F.get_json_object("detail", "$.gate2.demoted") == "true", F.lit(False))
    hit = (F.col("top_score") >= 10.6) & ~F.isnan("top_score")
    decision = answering.ask_decision(hit, passed, F.col("status") == "degraded", demoted)
    return rows.groupBy(decision.alias("decision"), "status").agg(F.count("*").alias("requests"))


@query(f"""WITH {_E}, d AS (SELECT CASE WHEN coalesce(abstained, false) THEN 'abstained' WHEN coalesce(honest_miss, false) THEN 'honest_miss' WHEN coalesce(citations_n, 0) = 0 THEN 'no_citations' END AS reason FROM e WHERE endpoint = '/ask')
SELECT coalesce(reason, 'checked') AS reason, count(*) AS requests FROM d GROUP BY 1""")
def gate2_skips(spark, folder):
    """Why the evidence gate has nothing to do."""
    rows = clean_events(table(spark, folder, "request_events")).where("endpoint = '/ask'")
    reason = answering.skip_reason(F.col("abstained"), F.col("honest_miss"), F.col("citations_n"))
    return rows.groupBy(F.coalesce(reason, F.lit("checked")).alias("reason")).agg(F.count("*").alias("requests"))


_CLAIMS = """rows AS (SELECT * FROM calibration_rows WHERE group_key IS NOT NULL),
c AS (SELECT group_key AS answer_id, CASE WHEN label = 1 THEN 'supported' WHEN gold_in_topk THEN 'belirsiz' ELSE 'unsupported' END AS verdict, coalesce(gold_in_topk, false) AS cited FROM rows WHERE features IS NOT NULL AND slice <> 'tablo-layout'),
a AS (SELECT group_key AS answer_id, bool_and(coalesce(answerable, false)) AS answerable, CASE WHEN bool_or(coalesce(gold_in_topk, false)) OR max(label) = 0 THEN 'answered' ELSE 'abstained' END AS status,
      bool_or(coalesce(unanswerable_reason, '') = 'korpus-disi') AS honest_miss FROM rows GROUP BY 1)"""


def _answers(spark, folder):
    """Calibration rows read as answers and their claims: the group is the answer, a row a claim, the label its verdict.

    Rows without features and those of one slice give no claim, so some answers have none.
    """
    rows = table(spark, folder, "calibration_rows").where("group_key is not null")
    verdict = F.when(F.col("label") == 1, "supported").when(F.col("gold_in_topk"), "belirsiz").otherwise("unsupported")
    claims = rows.where("features is not null and slice <> 'tablo-layout'").select(
        F.col("group_key").alias("answer_id"), verdict.alias("verdict"), F.coalesce("gold_in_topk", F.lit(False)).alias("cited")
    )
    given = F.bool_or(F.coalesce("gold_in_topk", F.lit(False))) | (F.max("label") == 0)
    answers = rows.groupBy(F.col("group_key").alias("answer_id")).agg(
        F.bool_and(F.coalesce("answerable", F.lit(False))).alias("answerable"), F.when(given, "answered").otherwise("abstained").alias("status"),
        F.bool_or(F.coalesce("unanswerable_reason", F.lit("")) == "korpus-disi").alias("honest_miss"),
    )
    return answers, claims


@query(f"""WITH {_CLAIMS}, g AS (SELECT answer_id, count(*) AS claims, count(CASE WHEN verdict = 'supported' THEN 1 END) AS supported FROM c GROUP BY 1)
SELECT a.answer_id, coalesce(claims, 0) AS claims, coalesce(supported, 0) AS supported, claims IS NULL OR claims > 8 OR supported < claims AS demoted FROM a LEFT JOIN g ON g.answer_id = a.answer_id""")
def evidence_gate(spark, folder):
    """Gate decision per answer from the verdicts of its claims; an answer without claims is demoted."""
    answers, claims = _answers(spark, folder)
    return answering.evidence_gate(answers, claims)


@query(f"""WITH RECURSIVE {_CLAIMS}, g AS (SELECT answer_id, count(*) AS n, count(CASE WHEN cited THEN 1 END) AS cited, count(CASE WHEN cited AND verdict = 'supported' THEN 1 END) AS cited_ok, count(CASE WHEN verdict = 'supported' THEN 1 END) AS ok FROM c GROUP BY 1),
m AS (SELECT count(*) AS answers, CAST(coalesce(sum(n), 0) AS BIGINT) AS claims, CAST(coalesce(sum(cited), 0) AS BIGINT) AS cited, CAST(coalesce(sum(cited_ok), 0) AS BIGINT) AS cited_supported, count(CASE WHEN NOT answerable THEN 1 END) AS unanswerable,
      count(CASE WHEN NOT answerable AND status = 'answered' AND NOT honest_miss AND n > 0 AND ok = n THEN 1 END) AS false_supported FROM a LEFT JOIN g USING (answer_id)),
s AS (SELECT 'p' AS what, cited - cited_supported AS errors, cited AS n FROM m UNION ALL SELECT 'c', claims - cited, claims FROM m UNION ALL SELECT 'f', false_supported, unanswerable FROM m), {sql_upper_bound('s', 'what')}
SELECT m.*, round(cited_supported / nullif(cited, 0), 6) AS citation_precision, round(1 - (SELECT upper FROM cp WHERE key = 'p'), 6) AS precision_lower,
round(cited / nullif(claims, 0), 6) AS completeness, round((SELECT upper FROM cp WHERE key = 'c'), 6) AS uncited_upper,
round(false_supported / nullif(unanswerable, 0), 6) AS false_supported_rate, round((SELECT upper FROM cp WHERE key = 'f'), 6) AS false_supported_upper FROM m""")
def answer_metrics(spark, folder):
    """Citation precision, completeness and false supported answers, with their bounds."""
    out = answering.answer_metrics(*_answers(spark, folder))
    whole = ("answers", "claims", "cited", "cited_supported", "unanswerable", "false_supported")
    return out.select(*whole, *[F.round(c, 6).alias(c) for c in out.columns if c not in whole])


# what a model might reply, by the number of the question: seven shapes, each around the verdict of the question
_SHAPES = [
    ('```json\n{"verdict": "', '", "gerekce": "x"}\n```'), ('[{"verdict": "', '"}]'), ("verdict: ", ""), ("Verdict = '", "' olur"), ("", ""),
    ('{"verdict": " ', ' ", "gerekce": null}'), ('Karar "verdict": "', '" metin'),
]
_WORDS = ["supported", "UNSUPPORTED", "Belirsiz", "maybe", "Supported"]


@query("""WITH q AS (SELECT DISTINCT question_id, CAST(substr(question_id, 2) AS BIGINT) AS n FROM bench_questions WHERE question_id IS NOT NULL),
w AS (SELECT question_id, n % 7 AS shape, ['supported', 'unsupported', 'belirsiz', 'maybe', 'supported'][1 + (n // 7) % 5] AS word FROM q)
SELECT question_id, CASE WHEN word = 'maybe' OR shape = 4 THEN 'belirsiz' ELSE word END AS verdict, word <> 'maybe' AND shape <> 4 AS parsed FROM w""")
def verdict_parsing(spark, folder):
    """Replies around a verdict, one for every question in one of seven shapes, read back as verdicts."""
    n = F.substring("question_id", 2, 20).cast("long")
    pick = lambda values, at: F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))
    word = pick(_WORDS, F.pmod(F.floor(n / 7), F.lit(5)))
    raw = F.concat(pick([a for a, _ in _SHAPES], n % 7), word, pick([b for _, b in _SHAPES], n % 7))
    rows = table(spark, folder, "bench_questions").where("question_id is not null").select("question_id").distinct()
    return rows.select("question_id", tx.parse_verdict(raw).alias("v")).select("question_id", "v.verdict", "v.parsed")
