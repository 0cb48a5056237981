"""Queries on predictions, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyobs.operators import evaluate as ev
from skyobs.operators.simulate import rounded
from skyobs.plans.registry import registry
from skyobs.sources import driver_tables as dt

QUERIES, SQL, query = registry()
_E = f"e AS (SELECT {dt.EVAL} FROM lineitem)"


_LV = "lv AS (SELECT pred AS v FROM e UNION SELECT truth FROM e)"
_CONF = f"WITH {_E}, {_LV}, conf AS (SELECT a.v AS pred, b.v AS truth, (SELECT count(*) FROM e WHERE e.pred = a.v AND e.truth = b.v) AS n FROM lv a, lv b)"


@query("confusion", f"{_CONF} SELECT pred, truth, n FROM conf")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return ev.confusion(dt.evaluation(spark, d))


_PER = """, per AS (SELECT v AS class, CAST((SELECT sum(n) FROM conf WHERE truth = v) AS DOUBLE) AS t, CAST((SELECT sum(n) FROM conf WHERE pred = v) AS DOUBLE) AS p, CAST((SELECT sum(n) FROM conf WHERE pred = v AND truth = v) AS DOUBLE) AS tp, CAST((SELECT sum(n) FROM conf) AS DOUBLE) AS a FROM lv)"""


@query("validate", f"{_CONF}{_PER} SELECT class, CAST(t AS BIGINT) AS n_truth, CAST(p AS BIGINT) AS n_pred, round(tp/nullif(p,0), 6) AS precision, round(tp/nullif(t,0), 6) AS recall, round((a - p - t + tp)/nullif(a - t,0), 6) AS specificity, round(2*(tp/p)*(tp/t)/(tp/p + tp/t), 6) AS f1, round(tp/nullif(p + t - tp,0), 6) AS iou FROM per")
def validate(spark: SparkSession, d: str) -> DataFrame:
    return ev.per_class(ev.confusion(dt.evaluation(spark, d)))


@query("validate_overall", f"""{_CONF}{_PER}, s AS (SELECT CAST(sum(CASE WHEN pred=1 AND truth=1 THEN n ELSE 0 END) AS DOUBLE) tp, CAST(sum(CASE WHEN pred=1 AND truth=0 THEN n ELSE 0 END) AS DOUBLE) fp, CAST(sum(CASE WHEN pred=0 AND truth=1 THEN n ELSE 0 END) AS DOUBLE) fn, CAST(sum(CASE WHEN pred=0 AND truth=0 THEN n ELSE 0 END) AS DOUBLE) tn FROM conf)
SELECT CAST(tp+fp+fn+tn AS BIGINT) AS n, round((tp+tn)/(tp+fp+fn+tn), 6) AS overall_accuracy, round((SELECT avg(tp/t) FROM per), 6) AS balanced_accuracy, round((tp*tn - fp*fn)/sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)), 6) AS mcc FROM s""")  # fmt: skip
def validate_overall(spark: SparkSession, d: str) -> DataFrame:
    return ev.overall(ev.confusion(dt.evaluation(spark, d)))


_ROC = f"""WITH {_E}, c AS (SELECT prob, sum(truth) AS pos, sum(1 - truth) AS neg FROM e GROUP BY prob), t AS (SELECT i * CAST({0.01!r} AS DOUBLE) AS threshold FROM (SELECT unnest(generate_series(0, 100)) AS i) g),
r AS (SELECT threshold, CAST((SELECT coalesce(sum(pos),0) FROM c WHERE prob >= threshold) AS DOUBLE) AS tp, CAST((SELECT coalesce(sum(neg),0) FROM c WHERE prob >= threshold) AS DOUBLE) AS fp, CAST((SELECT sum(pos) FROM c) AS DOUBLE) AS p, CAST((SELECT sum(neg) FROM c) AS DOUBLE) AS n FROM t),
curve AS (SELECT threshold, fp/n AS fpr, tp/p AS tpr, tp/nullif(tp+fp, 0) AS precision FROM r) """


@query("roc", _ROC + "SELECT round(threshold, 6) AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr, round(precision, 6) AS precision FROM curve")
def roc(spark: SparkSession, d: str) -> DataFrame:
    return ev.roc(dt.evaluation(spark, d))


@query("roc_auc", _ROC + ", l AS (SELECT fpr, tpr, lag(fpr) OVER (ORDER BY fpr, tpr) AS x0, lag(tpr) OVER (ORDER BY fpr, tpr) AS y0 FROM curve) SELECT round(sum((fpr - x0)*(tpr + y0)/2), 6) AS auc FROM l")
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return ev.auc(ev.roc(dt.evaluation(spark, d)))


_EDGES = ", ".join(f"({k + 1}, CAST({k * 0.1!r} AS DOUBLE), CAST({(k + 1) * 0.1 if k < 9 else 1.0!r} AS DOUBLE))" for k in range(10))
_CAL = f"""WITH {_E}, b(bin, lower, upper) AS (VALUES {_EDGES}), x AS (SELECT prob, truth, (SELECT max(bin) FROM b WHERE lower <= prob) AS bin FROM (SELECT prob, truth FROM e) q),
cal AS (SELECT b.bin, b.lower, b.upper, count(x.prob) AS n, avg(x.prob) AS mean_pred, avg(CAST(x.truth AS DOUBLE)) AS observed FROM b LEFT JOIN x ON b.bin = x.bin GROUP BY 1,2,3) """


@query("calibration", _CAL + "SELECT bin, round(lower, 6) AS lower, round(upper, 6) AS upper, n, round(mean_pred, 6) AS mean_pred, round(observed, 6) AS observed FROM cal")
def calibration(spark: SparkSession, d: str) -> DataFrame:
    return ev.calibration(dt.evaluation(spark, d))


@query("calibration_summary", _CAL + "SELECT round((SELECT avg((prob - truth)*(prob - truth)) FROM e), 6) AS brier, round(sum(n*abs(mean_pred - observed))/sum(n), 6) AS ece FROM cal")
def calibration_summary(spark: SparkSession, d: str) -> DataFrame:
    return ev.calibration_summary(dt.evaluation(spark, d))


_PREDS = ["pred", "pred_b", "pred_c"]
_PAIRS = [(a, b) for i, a in enumerate(_PREDS) for b in _PREDS[i + 1 :]]


@query("mcnemar", f"WITH {_E}, m AS (" + " UNION ALL ".join(f"SELECT '{a}' AS method_a, '{b}' AS method_b, count(*) FILTER (WHERE {a} = truth AND {b} <> truth) AS a_only_correct, count(*) FILTER (WHERE {a} <> truth AND {b} = truth) AS b_only_correct FROM e" for a, b in _PAIRS) + ") SELECT *, round((abs(CAST(a_only_correct AS DOUBLE) - b_only_correct) - 1)*(abs(CAST(a_only_correct AS DOUBLE) - b_only_correct) - 1)/(a_only_correct + b_only_correct), 6) AS mcnemar_chi2 FROM m")
def mcnemar(spark: SparkSession, d: str) -> DataFrame:
    return ev.mcnemar(dt.evaluation(spark, d), _PREDS)


@query("compare_bootstrap")
def compare_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return ev.compared(dt.evaluation(spark, d), _PREDS, block="block")


_AG = f"""WITH {_E}, s AS (SELECT block, pred, pred_b, pred_c, CAST(pred + pred_b + pred_c AS DOUBLE)/3 AS agreement FROM e),
a AS (SELECT *, CASE WHEN agreement > 0.5 THEN 1 ELSE 0 END AS consensus, agreement IN (0, 1) AS unanimous, greatest(1e-9, least(1 - CAST(1e-9 AS DOUBLE), agreement)) AS q FROM s),
ag AS (SELECT *, -(q*log2(q) + (1 - q)*log2(1 - q)) AS entropy FROM a) """


@query("agreement", _AG + "SELECT pred, pred_b, pred_c, round(agreement, 6) AS agreement, consensus, round(entropy, 6) AS entropy, unanimous, count(*) AS n FROM ag GROUP BY ALL")
def agreement(spark: SparkSession, d: str) -> DataFrame:
    a = rounded(ev.agreement(dt.evaluation(spark, d).select(*_PREDS), _PREDS))
    return a.groupBy(*a.columns).agg(F.count(F.lit(1)).alias("n"))


def _dis(a: str, b: str) -> str:
    f = lambda c: f"CAST(count(*) FILTER (WHERE {c}) AS DOUBLE)"
    return f"SELECT '{a}' AS method_a, '{b}' AS method_b, round({f(f'{a} = {b}')}/count(*), 6) AS agreement, round({f(f'{a}=1 AND {b}=1')}/{f(f'{a}=1 OR {b}=1')}, 6) AS jaccard, round({f(f'{a}=1 AND {b}=0')}/count(*), 6) AS a_only, round({f(f'{a}=0 AND {b}=1')}/count(*), 6) AS b_only, round(avg(CAST({a} AS DOUBLE)), 6) AS cloud_a, round(avg(CAST({b} AS DOUBLE)), 6) AS cloud_b FROM e"


@query("disagreement_pairs", f"WITH {_E} " + " UNION ALL ".join(_dis(a, b) for a, b in _PAIRS))
def disagreement_pairs(spark: SparkSession, d: str) -> DataFrame:
    return ev.disagreement(dt.evaluation(spark, d), _PREDS)


@query("disagreement_strata", _AG + "SELECT block AS stratum, count(*) AS n, round(avg(CASE WHEN unanimous THEN 1.0 ELSE 0.0 END), 6) AS mean_agreement, round(avg(entropy), 6) AS mean_entropy, round(avg(agreement), 6) AS mean_cloud FROM ag GROUP BY block")
def disagreement_strata(spark: SparkSession, d: str) -> DataFrame:
    return ev.disagreement_by(dt.evaluation(spark, d), _PREDS, "block")
