"""Metrics of scored tables (G)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rareflow.functions.hashing import hash_fraction
from rareflow.operators import metrics
from rareflow.operators.series import best_score
from rareflow.plans.registry import LOG, SCORES, query, rounded, with_
from rareflow.sources.tables import KEY, metric_log, scores

CLIPPED = "least(greatest(score, 1e-15), 1 - 1e-15)"
LOSS = f"avg(-CASE WHEN y = 1 THEN ln({CLIPPED}) ELSE ln(1 - {CLIPPED}) END)"
ACCURACY = """avg((CASE WHEN (score >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END
  + CASE WHEN (1 - score >= 0.5) = (y = 0) THEN 1.0 ELSE 0.0 END) / 2)"""


def single(df: DataFrame) -> DataFrame:
    return rounded(df, df.columns)


@query("metric_cross_entropy", with_(SCORES,
                                     f"SELECT round({LOSS}, 6) AS cross_entropy FROM scores"))
def metric_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single(metrics.cross_entropy(scores(spark, sf_dir)))


@query("metric_accuracy", with_(SCORES, f"SELECT round({ACCURACY}, 6) AS accuracy FROM scores"))
def metric_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single(metrics.accuracy(scores(spark, sf_dir)))


MICRO = """cells AS (SELECT y, score AS p FROM scores UNION ALL SELECT 1 - y, 1 - score FROM scores),
limits AS (SELECT i, CASE i WHEN 0 THEN -1e-7 WHEN 199 THEN 1 + 1e-7
  ELSE i / CAST(199 AS DOUBLE) END AS t FROM range(0, 200) AS g(i)),
folded AS (SELECT p, sum(y) AS pos, count(*) - sum(y) AS neg FROM cells GROUP BY 1),
passed AS (SELECT i, coalesce(sum(pos) FILTER (p > t), 0) AS tp,
  coalesce(sum(neg) FILTER (p > t), 0) AS fp, sum(pos) AS pos, sum(neg) AS neg
  FROM limits, folded GROUP BY 1),
rates AS (SELECT i, (tp + 1e-6) / (pos + 1e-6) AS tpr, fp / (neg + 1e-6) AS fpr FROM passed),
steps AS (SELECT (fpr - lead(fpr) OVER (ORDER BY i)) * (tpr + lead(tpr) OVER (ORDER BY i)) / 2
  AS area FROM rates)"""


@query("metric_auroc_micro", with_(f"{SCORES}, {MICRO}",
                                   "SELECT round(sum(area), 6) AS auroc_micro FROM steps"))
def metric_auroc_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single(metrics.auroc_micro(scores(spark, sf_dir)))


TIES = """tied AS (SELECT score, CAST(sum(y) AS DOUBLE) AS pos,
  CAST(count(*) - sum(y) AS DOUBLE) AS neg FROM scores GROUP BY 1),
running AS (SELECT *, sum(pos) OVER w AS pos_upto, sum(neg) OVER w AS neg_upto,
  sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM tied WINDOW w AS (ORDER BY score))"""
AUROC = "sum(pos * (neg_upto - neg / 2)) / (max(p) * max(n))"


@query("metric_auroc", with_(f"{SCORES}, {TIES}", f"SELECT round({AUROC}, 6) AS auroc FROM running"))
def metric_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single(metrics.auroc(scores(spark, sf_dir)))


CONFUSED = """c AS (SELECT count(*) FILTER (score >= 0.5 AND y = 1)::DOUBLE AS tp,
  count(*) FILTER (score >= 0.5 AND y = 0)::DOUBLE AS fp,
  count(*) FILTER (score < 0.5 AND y = 1)::DOUBLE AS fn,
  count(*) FILTER (score < 0.5 AND y = 0)::DOUBLE AS tn FROM scores)"""


@query("metric_precision_recall_f1", with_(f"{SCORES}, {CONFUSED}", """SELECT
  round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
  round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c"""))
def metric_precision_recall_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single(metrics.precision_recall_f1(scores(spark, sf_dir)))


@query("metric_log_loss", with_(SCORES, f"SELECT round({LOSS}, 6) AS log_loss FROM scores"))
def metric_log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single(metrics.cross_entropy(scores(spark, sf_dir))
                  .withColumnRenamed("cross_entropy", "log_loss"))


@query("metric_average_precision", with_(f"{SCORES}, {TIES}", """SELECT round(sum(pos / p
  * (p - pos_upto + pos) / (p - pos_upto + pos + n - neg_upto + neg)), 6) AS average_precision
  FROM running"""))
def metric_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single(metrics.average_precision(scores(spark, sf_dir)))


@query("metric_confusion", with_(SCORES, """SELECT y, CAST(score >= 0.5 AS INTEGER) AS predicted,
  round(count(*) / (SELECT count(*) FROM scores)::DOUBLE, 6) AS share FROM scores GROUP BY 1, 2"""))
def metric_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.confusion(scores(spark, sf_dir)), ["share"])


@query("metric_class_report", with_(f"{SCORES}, {CONFUSED}", """SELECT 1 AS label,
  round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
  round(2 * tp / (2 * tp + fp + fn), 6) AS f1, CAST(tp + fn AS BIGINT) AS support FROM c
  UNION ALL SELECT 0, round(tn / (tn + fn), 6), round(tn / (tn + fp), 6),
  round(2 * tn / (2 * tn + fp + fn), 6), CAST(tn + fp AS BIGINT) FROM c"""))
def metric_class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.class_report(scores(spark, sf_dir)), ["precision", "recall", "f1"])


DAN_Q = "least(greatest(q, 1e-15), 1 - 1e-15)"


@query("metric_dan_components", with_(SCORES + """, moved AS (SELECT scores.*, l_quantity / 10
  AS shift, CAST(('0x' || substr(md5('after:' || scores.row_key), 1, 8)) AS BIGINT)
  / CAST(4294967296 AS DOUBLE) AS q FROM scores JOIN lines USING (row_key)),
parts AS (SELECT """ + LOSS + f""" AS ce,
  avg(-({DAN_Q} * ln({DAN_Q}) + (1 - {DAN_Q}) * ln(1 - {DAN_Q}))) FILTER (y = 0) AS pe,
  avg(ln({DAN_Q})) FILTER (y = 0) AS quality, avg(shift) FILTER (y = 0) AS reg,
  avg(CAST(q >= 0.5 AS INTEGER)) FILTER (y = 0) AS success FROM moved)""", """SELECT
  round(ce, 6) AS cross_entropy, round(pe, 6) AS predictive_entropy,
  round(ce + 0.5 * pe, 6) AS discriminator_loss, round(quality, 6) AS disguise_quality,
  round(success, 6) AS disguise_success_rate, round(reg, 6) AS regularizer,
  round(2 * reg - quality, 6) AS disguise_loss FROM parts"""))
def metric_dan_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = scores(spark, sf_dir, "l_quantity").withColumns(
        {"score_disguised": hash_fraction(KEY, "after"), "shift": F.col("l_quantity") / 10})
    return single(metrics.dan_components(moved, lambd=2.0, eta=0.5))


@query("metric_bundle", with_(f"{SCORES}, {MICRO}, {TIES}, {CONFUSED}, {LOG}", f"""SELECT
  round((SELECT {LOSS} FROM scores), 6) AS cross_entropy,
  round((SELECT {ACCURACY} FROM scores), 6) AS accuracy,
  round((SELECT {AUROC} FROM running), 6) AS auroc,
  round((SELECT sum(area) FROM steps), 6) AS auroc_micro,
  round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
  round((SELECT max(value) FROM metric_log WHERE tag = 'click'), 6) AS best_validation_auroc
  FROM c"""))
def metric_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = best_score(metric_log(spark, sf_dir), "click")
    return single(metrics.metric_bundle(scores(spark, sf_dir), best))


