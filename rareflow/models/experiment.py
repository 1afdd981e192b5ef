"""One training run with its test result, as the experiment scripts do it."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, functions as F

from rareflow.models.dan import DisguiseClassifier, DisguiseModel, Training
from rareflow.models.kernel import Shape
from rareflow.operators.metrics import metric_bundle
from rareflow.operators.sample import oversample
from rareflow.operators.series import best_score
from rareflow.sources.files import append_results


def run_experiment(run_id: str, train: DataFrame, validation: DataFrame, test: DataFrame,
                   shape: Shape, training: Training, features: str = "features",
                   label: str = "label", oversample_times: int = 1,
                   checkpoint_dir: str | None = None, results_dir: str | None = None
                   ) -> tuple[DisguiseModel, DataFrame]:
    """Fit (optionally on oversampled positives), test, and record.

    The result row holds the test metrics, the best validation AUROC and the
    settings; with ``results_dir`` it is appended there, next to the training log.
    """
    spark = train.sparkSession
    if oversample_times > 1:
        train = oversample(train, label, oversample_times).drop("copy")
    model = DisguiseClassifier(shape, training, features, label, validation,
                               checkpoint_dir).fit(train)
    scored = model.transform(test).select(F.col(label).alias("y"), "score")
    log = model.log_table(spark, run_id)
    settings = {"hidden": str(shape.discriminator), "disguise": str(shape.disguise),
                **{k: v for k, v in asdict(training).items() if v is not None},
                "oversample": oversample_times}
    result = metric_bundle(scored, best_score(log, "validation auroc"))
    result = result.withColumns({k: F.lit(v) for k, v in settings.items()})
    if results_dir:
        append_results(result, f"{results_dir}/results", run_id)
        append_results(log.drop("run"), f"{results_dir}/log", run_id)
    return model, result
