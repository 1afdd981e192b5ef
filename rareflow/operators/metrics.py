"""Exact evaluation metrics of a scored table (label ``y`` in {0,1}, score ``p``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rareflow.functions.scores import CLIP, binary_entropy, clipped, log_loss_term, predicted_class
from rareflow.operators.ordering import SLICE_ROWS, running_before
from rareflow.session import materialize

# The streaming AUROC's grid and its smoothing terms.
MICRO_THRESHOLDS = 200
MICRO_EPS = 1e-7
MICRO_SMOOTH = 1e-6


def cross_entropy(df: DataFrame, y: str = "y", p: str = "score", eps: float = CLIP) -> DataFrame:
    return df.agg(F.avg(log_loss_term(F.col(y), F.col(p), eps)).alias("cross_entropy"))


def accuracy(df: DataFrame, y: str = "y", p: str = "score") -> DataFrame:
    """Share of correct cells over both indicator columns."""
    hit = lambda q, t: F.when((q >= 0.5) == (t == 1), F.lit(1.0)).otherwise(0.0)
    score, label = F.col(p), F.col(y)
    cells = hit(score, label) + hit(F.lit(1.0) - score, F.lit(1) - label)
    return df.agg((F.sum(cells) / (F.count("*") * 2)).alias("accuracy"))


def micro_thresholds(n: int = MICRO_THRESHOLDS, eps: float = MICRO_EPS) -> list[float]:
    """n - 2 inner thresholds evenly in (0, 1) and one just outside at each end."""
    return [-eps, *[(i + 1) / (n - 1) for i in range(n - 2)], 1.0 + eps]


def micro_bucket(p: Column, n: int = MICRO_THRESHOLDS) -> Column:
    """Number of thresholds strictly below p: between 1 and n - 1.

    The inner thresholds are i / (n - 1), i = 1 .. n - 2; a value equal to one of
    them does not pass it. The guess from the product is corrected by comparing
    with the thresholds on both sides.
    """
    last = F.lit(n - 2)
    guess = F.least(F.greatest(F.ceil(p * (n - 1)) - 1, F.lit(0)), last)
    up = (guess < last) & ((guess + 1) / F.lit(float(n - 1)) < p)
    down = (guess > 0) & (guess / F.lit(float(n - 1)) >= p)
    inner = F.when(up, guess + 1).when(down, guess - 1).otherwise(guess)
    return (inner + 1).cast("int")


def micro_counts(df: DataFrame, y: str = "y", p: str = "score") -> DataFrame:
    """(bucket, pos, neg, hits) over both indicator columns: at most 200 rows."""
    label = F.col(y).cast("bigint")
    return _bucket_counts(df.select(label.alias("pos"), (F.lit(1) - label).alias("neg"),
                                    F.col(p).alias("p")))


def _bucket_counts(weighted: DataFrame) -> DataFrame:
    """Bucket counts of rows (pos, neg, p) and of their mirror images."""
    cells = weighted.select(F.explode(F.array(
        F.struct("pos", "neg", "p"),
        F.struct(F.col("neg").alias("pos"), F.col("pos").alias("neg"),
                 (F.lit(1.0) - F.col("p")).alias("p")))).alias("cell")).select("cell.*")
    hits = F.when(F.col("p") >= 0.5, F.col("pos")).otherwise(F.col("neg"))
    return cells.groupBy(micro_bucket(F.col("p")).alias("bucket")).agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum(hits).alias("hits"))


def micro_auroc_from_counts(counts: DataFrame) -> DataFrame:
    """Trapezoid over the threshold curve from bucket counts (<= 200 rows)."""
    spark = counts.sparkSession
    grid = spark.range(MICRO_THRESHOLDS + 1).select(F.col("id").cast("int").alias("bucket"))
    full = grid.join(counts, "bucket", "left").na.fill(0, ["pos", "neg"])
    above = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    # threshold t (0-based) is passed by the buckets > t
    curve = full.select(
        "bucket",
        (F.coalesce(F.sum("pos").over(above), F.lit(0)) + MICRO_SMOOTH).alias("tp"),
        F.coalesce(F.sum("neg").over(above), F.lit(0)).alias("fp"),
        F.sum("pos").over(everything).alias("p"), F.sum("neg").over(everything).alias("n"),
    ).filter(F.col("bucket") < MICRO_THRESHOLDS)
    rates = curve.select("bucket", ((F.col("tp")) / (F.col("p") + MICRO_SMOOTH)).alias("tpr"),
                         (F.col("fp") / (F.col("n") + MICRO_SMOOTH)).alias("fpr"))
    after = Window.orderBy("bucket")
    step = rates.select(
        ((F.col("fpr") - F.lead("fpr").over(after))
         * (F.col("tpr") + F.lead("tpr").over(after)) / 2).alias("area"))
    return step.agg(F.sum("area").alias("auroc_micro"))


def auroc_micro(df: DataFrame, y: str = "y", p: str = "score") -> DataFrame:
    return micro_auroc_from_counts(micro_counts(df, y, p))


def score_groups(df: DataFrame, y: str = "y", p: str = "score") -> DataFrame:
    """(score, pos, neg): rows of each class per distinct score, as a written table."""
    label = F.col(y).cast("bigint")
    return materialize(df.groupBy(F.col(p).alias("score")).agg(
        F.sum(label).alias("pos"), F.sum(F.lit(1) - label).alias("neg")), "score-groups")


def ranked_groups(groups: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Adds the counts at smaller scores and overall."""
    return running_before(groups, [], "score", ["pos", "neg"], slice_rows)


def _auroc() -> Column:
    pairs = F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") * 0.5)
    return F.sum(pairs) / (F.max("pos_total").cast("double") * F.max("neg_total"))


def auroc(df: DataFrame, y: str = "y", p: str = "score", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Exact rank AUROC; tied pairs count one half."""
    return ranked_groups(score_groups(df, y, p), slice_rows).agg(_auroc().alias("auroc"))


def auroc_by(df: DataFrame, by: str, y: str = "y", p: str = "score",
             slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(by, auroc): exact rank AUROC of each group; NULL for a group of one class."""
    label = F.col(y).cast("bigint")
    groups = materialize(df.groupBy(by, F.col(p).alias("score")).agg(
        F.sum(label).alias("pos"), F.sum(F.lit(1) - label).alias("neg")), "score-groups")
    area = F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") * 0.5))
    pairs = F.max("pos_total").cast("double") * F.max("neg_total")
    return running_before(groups, [by], "score", ["pos", "neg"], slice_rows).groupBy(by).agg(
        F.try_divide(area, pairs).alias("auroc"))


def average_precision(df: DataFrame, y: str = "y", p: str = "score", slice_rows: int = SLICE_ROWS
                      ) -> DataFrame:
    """Sum over distinct scores of recall gain times precision."""
    g = ranked_groups(score_groups(df, y, p), slice_rows)
    tp = F.col("pos_total") - F.col("pos_before")
    fp = F.col("neg_total") - F.col("neg_before")
    return g.agg(F.sum(F.col("pos") / F.col("pos_total") * (tp / (tp + fp)))
                 .alias("average_precision"))


def score_summary(df: DataFrame, y: str = "y", p: str = "score", slice_rows: int = SLICE_ROWS
                  ) -> DataFrame:
    """One row of cross entropy, accuracy, both AUROCs, precision and recall.

    The rows are read once, into score groups; everything follows from those.
    """
    groups = score_groups(df, y, p)
    score, pos, neg = F.col("score"), F.col("pos"), F.col("neg")
    q, rows = clipped(score), F.sum(pos + neg)
    mirror = F.lit(1.0) - score
    hits = F.when(score >= 0.5, pos).otherwise(neg) + F.when(mirror >= 0.5, neg).otherwise(pos)
    tp, fp = F.sum(F.when(score >= 0.5, pos).otherwise(0)), \
        F.sum(F.when(score >= 0.5, neg).otherwise(0))
    micro = micro_auroc_from_counts(_bucket_counts(groups.withColumnRenamed("score", "p")))
    return ranked_groups(groups, slice_rows).agg(
        (-F.sum(pos * F.log(q) + neg * F.log(F.lit(1.0) - q)) / rows).alias("cross_entropy"),
        (F.sum(hits) / (rows * 2)).alias("accuracy"), _auroc().alias("auroc"),
        ratio(tp, tp + fp).alias("precision"), ratio(tp, F.sum(pos)).alias("recall"),
    ).withColumn("auroc_micro", micro.scalar())


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def confusion_counts(df: DataFrame, y: str = "y", p: str = "score", threshold: float = 0.5
                     ) -> DataFrame:
    """One row (tp, fp, fn, tn)."""
    pred, label = predicted_class(F.col(p), threshold), F.col(y)
    return df.agg(
        F.count_if((pred == 1) & (label == 1)).alias("tp"),
        F.count_if((pred == 1) & (label == 0)).alias("fp"),
        F.count_if((pred == 0) & (label == 1)).alias("fn"),
        F.count_if((pred == 0) & (label == 0)).alias("tn"))


def _f1(precision: Column, recall: Column) -> Column:
    return ratio(precision * recall * 2, precision + recall)


def precision_recall_f1(df: DataFrame, y: str = "y", p: str = "score") -> DataFrame:
    c = confusion_counts(df, y, p)
    precision = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select(precision.alias("precision"), recall.alias("recall"),
                    _f1(precision, recall).alias("f1"))


def class_report(df: DataFrame, y: str = "y", p: str = "score") -> DataFrame:
    """Per class (label, precision, recall, f1, support)."""
    c = confusion_counts(df, y, p)
    both = c.select(F.explode(F.array(
        F.struct(F.lit(0).alias("label"), F.col("tn").alias("hit"), F.col("fn").alias("wrong"),
                 F.col("fp").alias("missed")),
        F.struct(F.lit(1).alias("label"), F.col("tp").alias("hit"), F.col("fp").alias("wrong"),
                 F.col("fn").alias("missed")))).alias("r")).select("r.*")
    precision = ratio(F.col("hit"), F.col("hit") + F.col("wrong"))
    recall = ratio(F.col("hit"), F.col("hit") + F.col("missed"))
    return both.select("label", precision.alias("precision"), recall.alias("recall"),
                       _f1(precision, recall).alias("f1"),
                       (F.col("hit") + F.col("missed")).alias("support"))


def confusion(df: DataFrame, y: str = "y", p: str = "score") -> DataFrame:
    """(y, predicted, share of all rows)."""
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # at most four rows
    return (df.groupBy(F.col(y).alias("y"), predicted_class(F.col(p)).alias("predicted"))
            .agg(F.count("*").alias("n"))
            .select("y", "predicted", (F.col("n") / total).alias("share")))


def dan_components(df: DataFrame, lambd: float = 1.0, eta: float = 1.0) -> DataFrame:
    """The step metrics from scored rows.

    ``y``, ``score``: label and probability of the true row; for negatives also
    ``score_disguised`` (probability after the disguise) and ``shift`` (L1 change).
    """
    y, q = F.col("y"), F.col("score_disguised")
    negative = y == 0
    only = lambda c: F.avg(F.when(negative, c))
    parts = df.agg(
        F.avg(log_loss_term(y, F.col("score"))).alias("cross_entropy"),
        only(binary_entropy(q)).alias("predictive_entropy"),
        only(F.log(clipped(q))).alias("disguise_quality"),
        only(F.col("shift")).alias("regularizer"),
        only(F.when(q >= 0.5, F.lit(1.0)).otherwise(0.0)).alias("disguise_success_rate"))
    return parts.select(
        "cross_entropy", "predictive_entropy",
        (F.col("cross_entropy") + F.lit(eta) * F.col("predictive_entropy"))
        .alias("discriminator_loss"),
        "disguise_quality", "disguise_success_rate", "regularizer",
        (F.lit(lambd) * F.col("regularizer") - F.col("disguise_quality")).alias("disguise_loss"))


def metric_bundle(df: DataFrame, best: DataFrame | None = None, y: str = "y", p: str = "score"
                  ) -> DataFrame:
    """The test result row; given a one-cell table, with the best validation AUROC."""
    out = score_summary(df, y, p)
    return out if best is None else out.withColumn("best_validation_auroc", best.scalar())
