"""Wall time of the headline queries; prints one JSON line.

Each query runs once to warm up, then BENCH_RUNS times; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import numpy as np  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from rareflow.models import kernel  # noqa: E402
from rareflow.models.dan import Training, training_round, training_rows  # noqa: E402
from rareflow.models.kernel import Shape  # noqa: E402
from rareflow.plans import catalog  # noqa: E402
from rareflow.plans.encoding import encoder_model  # noqa: E402
from rareflow.session import clear_scratch, local_session, materialize  # noqa: E402
from rareflow.sources.tables import TARGET  # noqa: E402

HEADLINE = [
    "scan_csv_gz", "shard_table", "cardinality_profile", "describe_numeric", "build_vocabulary",
    "numeric_stats", "equi_width_histogram", "feature_shift_ranking", "index_encode",
    "feature_encoding", "dictionary_join", "assemble_sparse", "rebalance_validation",
    "oversample_positive", "stratified_split", "smote", "predict_proba", "metric_auroc",
    "metric_auroc_micro", "metric_bundle", "metric_outer_join", "fill_series",
    "write_processed", "sample_balanced", "thin_positive_shards", "class_mixed_batches",
    "adasyn", "stored_embedding_step", "gaussian_nb", "stream_encode", "stream_metrics",
]


def timed(work, runs: int) -> float:
    work()
    spent = []
    for _ in range(runs):
        start = time.perf_counter()
        work()
        spent.append(time.perf_counter() - start)
    return statistics.median(spent)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, runs = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    scratch = tempfile.mkdtemp(prefix="rareflow-bench-")     # one machine: local is shared
    spark = local_session("rareflow-bench", cpus, int(cpus) if cpus.isdigit() else 8, scratch)
    spark.sparkContext.setLogLevel("ERROR")

    def drain(name: str) -> None:
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    spent = {name: round(timed(lambda n=name: drain(n), runs), 3) for name in HEADLINE}

    # the published network (disguise 256 x 4, discriminator 64-32) on encoded lines
    df, model = encoder_model(spark, sf_dir)
    codes = model.spec.index
    plain = [c for c in model.output_columns if c not in codes]
    inputs = plain + codes
    encoded = materialize(model.transform(df).select(
        F.array(*[F.col(c).cast("double") for c in inputs]).alias("features"), TARGET), "bench")
    shape = Shape(len(inputs), (64, 32), (256,) * 4, index_map={
        len(plain) + i: model.sizes[c].entries for i, c in enumerate(codes)})
    rows = training_rows(encoded, "features", TARGET, None)
    count, training = encoded.count(), Training()
    flat = kernel.initial_weights(shape)

    def one_round() -> None:
        new, _ = training_round(rows, shape, training, flat, kernel.Adam(), 0)
        assert np.isfinite(new).all()

    spent["dan_round"] = round(timed(one_round, runs), 3)
    clear_scratch(spark)
    print(json.dumps({
        "metric": "total_wall_time", "value": round(sum(spent.values()), 3), "unit": "sec",
        "queries": spent, "sf": Path(sf_dir).name,
        "rows_per_sec": {"feature_encoding": round(count / spent["feature_encoding"]),
                         "dan_round": round(count / spent["dan_round"])},
        "lines": count}))


if __name__ == "__main__":
    main()
