"""Models (F)."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from rareflow.functions.scores import predicted_class
from rareflow.models import baselines, kernel, search, stored
from rareflow.models.dan import (
    DisguiseClassifier, DisguiseModel, Training, full_gradient, load_checkpoint, training_rows)
from rareflow.models.experiment import run_experiment
from rareflow.models.kernel import Shape
from rareflow.models.penalised import PenaltyPath
from rareflow.models.spectral import CentredPCA
from rareflow.operators import matrix, metrics
from rareflow.operators.smote import smote
from rareflow.plans.registry import CELLS, LINES, SPLIT, normal_sql, query, r, rounded, with_
from rareflow.session import materialize, scratch_path
from rareflow.sources import generators
from rareflow.sources.files import with_split
from rareflow.sources.tables import KEY, TARGET, lines, vectors

WIDTH = 64


def labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, validation, test) vectors with a 0/1 label."""
    df = vectors(spark, sf_dir).withColumnRenamed(TARGET, "label")
    df = materialize(with_split(df, F.col("vec_id").cast("string")), "labelled")
    return tuple(df.filter(F.col("split") == s) for s in ("train", "validation", "test"))


def everything(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).withColumnRenamed(TARGET, "label")


DAN_SHAPE = Shape(WIDTH, (32, 16), (32, 32))
QUICK = Training(epochs=3, learning_rate=5e-3, batch_size=64)


@query("dan_fit")
def dan_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, validation, _ = labelled(spark, sf_dir)
    model = DisguiseClassifier(DAN_SHAPE, QUICK, validation=validation).fit(train)
    return model.log_table(spark, "dan")


@query("discriminator_fit")
def discriminator_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, validation, _ = labelled(spark, sf_dir)
    model = DisguiseClassifier(Shape(WIDTH, (32, 16)), QUICK, validation=validation).fit(train)
    return model.log_table(spark, "discriminator")


def fixed_logistic() -> DisguiseModel:
    """Logistic model with given weights ((37 i) mod 19 - 9) / 10 and offset -0.3."""
    shape = Shape(WIDTH, (), batch_norm=False)
    flat = kernel.initial_weights(shape) * 0.0
    w = kernel.as_blocks(shape, flat)
    w["d0w"][:, 1] = [((37 * i) % 19 - 9) / 10 for i in range(WIDTH)]
    w["d0b"][1] = -0.3
    return DisguiseModel(shape, flat)


LINEAR = CELLS + """, scored AS (SELECT vec_id, 1 / (1 + exp(-(sum(value
  * (((37 * pos) % 19 - 9) / CAST(10 AS DOUBLE))) - CAST('0.3' AS DOUBLE)))) AS p
  FROM cells GROUP BY 1)"""


@query("predict_proba", with_(LINEAR, """SELECT vec_id, round(1 - p, 6) AS proba_negative,
  round(p, 6) AS proba_positive FROM scored"""))
def predict_proba(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = fixed_logistic().predict_proba(everything(spark, sf_dir))
    return rounded(scored.select("vec_id", "proba_negative", "proba_positive"),
                   ["proba_negative", "proba_positive"])


@query("predict", with_(LINEAR, """SELECT vec_id, CAST(1 - p >= 0.5 AS INTEGER) AS negative,
  CAST(p >= 0.5 AS INTEGER) AS positive FROM scored"""))
def predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed_logistic().predict(everything(spark, sf_dir)).select(
        "vec_id", "negative", "positive")


EPOCH = Training(epochs=1, sync="gradient", dtype="float64", learning_rate=0.01)
EPOCH_SHAPE = Shape(WIDTH, (), batch_norm=False)
START = kernel.as_blocks(EPOCH_SHAPE, kernel.initial_weights(EPOCH_SHAPE, EPOCH.seed))["d0w"]


@query("discriminator_epoch", with_(CELLS + f""", start(pos, j, w) AS (VALUES {", ".join(
    f"({i}, {j}, {float(v)!r}::DOUBLE)" for (i, j), v in np.ndenumerate(START))}),
logit AS (SELECT vec_id, any_value(conversion_target) AS y,
  sum(value * w * CASE j WHEN 1 THEN 1 ELSE -1 END) AS z FROM cells JOIN start USING (pos) GROUP BY 1),
miss AS (SELECT vec_id, 1 / (1 + exp(-z)) - y AS e FROM logit),
slopes AS (SELECT pos, sum(e * value) / (SELECT count(*) FROM miss) AS g
  FROM cells JOIN miss USING (vec_id) GROUP BY pos UNION ALL SELECT -1, avg(e) FROM miss),
steps AS (SELECT pos, {EPOCH.learning_rate}::DOUBLE * g / (abs(g) + 1e-8::DOUBLE / sqrt(0.001::DOUBLE)) AS s
  FROM slopes)""", """SELECT steps.pos, coalesce(start.j, side.j) AS j,
  round(coalesce(w, 0) - s * CASE coalesce(start.j, side.j) WHEN 1 THEN 1 ELSE -1 END, 6) + 0 AS weight
  FROM steps LEFT JOIN start ON steps.pos = start.pos
  LEFT JOIN (VALUES (-1, 0), (-1, 1)) AS side(pos, j) ON steps.pos = side.pos"""))
def discriminator_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the plain discriminator after one epoch: one optimiser step on all rows.

    Position -1 holds the offsets.
    """
    model = DisguiseClassifier(EPOCH_SHAPE, EPOCH).fit(everything(spark, sf_dir))
    w = kernel.as_blocks(EPOCH_SHAPE, model.flat)
    rows = [(i, j, float(v)) for (i, j), v in np.ndenumerate(w["d0w"])]
    rows += [(-1, j, float(v)) for j, v in enumerate(w["d0b"])]
    return rounded(spark.createDataFrame(rows, "pos int, j int, weight double"), ["weight"])


def slopes_sql(name: str, weights: str, part: int) -> str:
    """CTE of (pos, g): slopes of the difference of logits over the rows of a round."""
    return f"""{name}_miss AS (SELECT vec_id, 1 / (1 + exp(-(sum(value * d) + any_value(side)))) - any_value(
    conversion_target) AS e FROM cells JOIN dealt USING (vec_id) JOIN {weights} USING (pos),
    (SELECT d AS side FROM {weights} WHERE pos = -1) WHERE round = {part} GROUP BY vec_id),
{name} AS (SELECT pos, sum(e * value) / (SELECT count(*) FROM {name}_miss) AS g
  FROM cells JOIN {name}_miss USING (vec_id) GROUP BY pos UNION ALL SELECT -1, avg(e) FROM {name}_miss)"""


ROUNDS = replace(EPOCH, rounds_per_epoch=2)


@query("discriminator_rounds", with_(CELLS + f""", start(pos, j, w) AS (VALUES {", ".join(
    f"({i}, {j}, {float(v)!r}::DOUBLE)" for (i, j), v in np.ndenumerate(START))}),
dealt AS (SELECT vec_id, CAST('0x' || substr(md5('round:' || vec_id), 1, 8) AS BIGINT) % 2 AS round
  FROM vectors),
d0 AS (SELECT pos, sum(CASE j WHEN 1 THEN w ELSE -w END) AS d FROM start GROUP BY pos
  UNION ALL SELECT -1, 0),
{slopes_sql("g1", "d0", 0)},
d1 AS (SELECT pos, d - 2 * {ROUNDS.learning_rate}::DOUBLE * g / (abs(g) + 1e-8::DOUBLE / sqrt(0.001::DOUBLE)) AS d
  FROM d0 JOIN g1 USING (pos)),
{slopes_sql("g2", "d1", 1)},
moments AS (SELECT pos, 0.09::DOUBLE * g1.g + 0.1::DOUBLE * g2.g AS m, 0.000999::DOUBLE * g1.g * g1.g
  + 0.001::DOUBLE * g2.g * g2.g AS v FROM g1 JOIN g2 USING (pos)),
moved AS (SELECT pos, (d1.d - d0.d) / 2 - {ROUNDS.learning_rate}::DOUBLE * sqrt(1 - 0.999::DOUBLE * 0.999::DOUBLE)
  / (1 - 0.9::DOUBLE * 0.9::DOUBLE) * m / (sqrt(v) + 1e-8::DOUBLE) AS s
  FROM moments JOIN d0 USING (pos) JOIN d1 USING (pos))""", """SELECT moved.pos, coalesce(start.j, side.j) AS j,
  round(coalesce(w, 0) + s * CASE coalesce(start.j, side.j) WHEN 1 THEN 1 ELSE -1 END, 6) + 0 AS weight
  FROM moved LEFT JOIN start ON moved.pos = start.pos
  LEFT JOIN (VALUES (-1, 0), (-1, 1)) AS side(pos, j) ON moved.pos = side.pos"""))
def discriminator_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the plain discriminator after one epoch of two rounds, dealt by key."""
    model = DisguiseClassifier(EPOCH_SHAPE, ROUNDS, key="vec_id").fit(everything(spark, sf_dir))
    w = kernel.as_blocks(EPOCH_SHAPE, model.flat)
    rows = [(i, j, float(v)) for (i, j), v in np.ndenumerate(w["d0w"])]
    rows += [(-1, j, float(v)) for j, v in enumerate(w["d0b"])]
    return rounded(spark.createDataFrame(rows, "pos int, j int, weight double"), ["weight"])


def fixed_disguise() -> DisguiseModel:
    """Linear disguise with given weights ((31 i + 17 j) mod 13 - 6) / 100 and offsets j / 64."""
    shape = Shape(WIDTH, (), (), batch_norm=False)
    flat = kernel.initial_weights(shape) * 0.0
    w = kernel.as_blocks(shape, flat)
    for j in range(WIDTH):
        w["t0w"][:, j] = [((31 * i + 17 * j) % 13 - 6) / 100 for i in range(WIDTH)]
        w["t0b"][j] = j / WIDTH
    return DisguiseModel(shape, flat)


@query("disguise_transform", with_(CELLS, """SELECT vec_id, CAST(j AS INTEGER) AS pos,
  round(sum(value * (((31 * pos + 17 * j) % 13 - 6) / CAST(100 AS DOUBLE))) + j / CAST(64 AS DOUBLE),
  6) AS value FROM cells, range(0, 64) AS g(j) WHERE conversion_target = 0 GROUP BY vec_id, j"""))
def disguise_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    negatives = everything(spark, sf_dir).filter("label = 0")
    moved = fixed_disguise().disguise(negatives)
    return rounded(matrix.cells(moved, ["vec_id"], "disguised"), ["value"])


def fixed_dan() -> tuple[Shape, np.ndarray]:
    """Both fixed linear networks in one weight vector."""
    shape = Shape(WIDTH, (), (), batch_norm=False)
    flat = np.zeros(shape.size)
    mine = kernel.as_blocks(shape, flat)
    for model in (fixed_logistic(), fixed_disguise()):
        given = kernel.as_blocks(model.shape, model.flat)
        for name in given:
            if np.any(given[name]):
                mine[name][:] = given[name]
    return shape, flat


FIXED = Training(lambd=0.5, eta=0.25, sync="gradient", dtype="float64")
STEP = CELLS + """, wd AS (SELECT CAST(i AS INTEGER) AS pos, ((37 * i) % 19 - 9) / CAST(10 AS DOUBLE)
  AS w FROM range(0, 64) AS g(i)),
plain AS (SELECT vec_id, any_value(conversion_target) AS y, sum(value * w) - CAST('0.3' AS DOUBLE)
  AS z FROM cells JOIN wd USING (pos) GROUP BY 1),
moved AS (SELECT vec_id, CAST(j AS INTEGER) AS pos,
  sum(value * (((31 * pos + 17 * j) % 13 - 6) / CAST(100 AS DOUBLE))) + j / CAST(64 AS DOUBLE) AS t
  FROM cells, range(0, 64) AS g(j) WHERE conversion_target = 0 GROUP BY vec_id, j),
after AS (SELECT vec_id, 1 / (1 + exp(-(sum(t * w) - CAST('0.3' AS DOUBLE)))) AS q,
  sum(abs(t - value)) AS shift FROM moved JOIN wd USING (pos) JOIN cells USING (vec_id, pos)
  GROUP BY 1),
losses AS (SELECT *, -(q * ln(q) + (1 - q) * ln(1 - q)) AS h FROM after),
ce AS (SELECT avg(ln(1 + exp(CASE y WHEN 1 THEN -z ELSE z END))) AS ce FROM plain),
parts AS (SELECT any_value(ce) AS ce, avg(h) AS pe, avg(ln(q)) AS quality,
  avg(CAST(q >= 0.5 AS INTEGER)) AS success, avg(shift) AS reg FROM losses, ce)"""


@query("dan_step_metrics", with_(STEP, """SELECT tag, round(value, 6) AS value FROM (
  SELECT 'cross entropy' AS tag, ce AS value FROM parts
  UNION ALL SELECT 'predictive entropy', pe FROM parts
  UNION ALL SELECT 'discriminator loss', ce + 0.25 * pe FROM parts
  UNION ALL SELECT 'disguise quality', quality FROM parts
  UNION ALL SELECT 'disguise success rate', success FROM parts
  UNION ALL SELECT 'regularizer', reg FROM parts
  UNION ALL SELECT 'disguise loss', 0.5 * reg - quality FROM parts)"""))
def dan_step_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The losses of one training pass at fixed weights."""
    rows = training_rows(everything(spark, sf_dir), "features", "label", None)
    shape, flat = fixed_dan()
    _, found = full_gradient(rows, shape, FIXED, flat)
    return rounded(spark.createDataFrame(list(found.items()), "tag string, value double"),
                   ["value"])


@query("dan_gradient", with_(STEP + """, counts AS (SELECT count(*) AS n,
  count(*) FILTER (y = 0) AS neg FROM plain),
direct AS (SELECT pos, sum((1 / (1 + exp(-z)) - y) * value) / any_value(n) AS g
  FROM cells JOIN plain USING (vec_id), counts GROUP BY 1),
entropy AS (SELECT pos, sum(-q * (ln(q) + h) * t) / any_value(neg) AS g
  FROM moved JOIN losses USING (vec_id), counts GROUP BY 1),
slope AS (SELECT vec_id, pos, (q - 1) * w + 0.5 * sign(t - value) AS d FROM moved
  JOIN losses USING (vec_id) JOIN wd USING (pos) JOIN cells USING (vec_id, pos))""", """SELECT
  'd0w' AS block, pos AS i, 1 AS j, round(direct.g + 0.25 * entropy.g, 6) + 0 AS value
  FROM direct JOIN entropy USING (pos)
  UNION ALL SELECT 'd0w', pos, 0, round(-direct.g - 0.25 * entropy.g, 6) + 0
  FROM direct JOIN entropy USING (pos)
  UNION ALL SELECT 't0w', c.pos, s.pos, round(sum(c.value * d) / any_value(neg), 6) + 0
  FROM cells c JOIN slope s USING (vec_id), counts GROUP BY c.pos, s.pos
  UNION ALL SELECT 't0b', 0, pos, round(sum(d) / any_value(neg), 6) + 0
  FROM slope, counts GROUP BY pos"""))
def dan_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full-pass gradient of both networks at fixed weights."""
    shape, flat = fixed_dan()
    rows = training_rows(everything(spark, sf_dir), "features", "label", None)
    gradient, _ = full_gradient(rows, shape, FIXED, flat)
    blocks = kernel.as_blocks(shape, gradient)
    cells = [(name, i, j, float(v)) for name in ("d0w", "t0w", "t0b")
             for (i, j), v in np.ndenumerate(np.atleast_2d(blocks[name]))]
    return rounded(spark.createDataFrame(cells, "block string, i int, j int, value double"),
                   ["value"])


# An index column with a value per order: its embeddings are a table, here with given vectors.
STORED = LINES + """, sizes AS (SELECT CAST(ceil(pow(max(l_orderkey) + 1, 1 / CAST(6 AS DOUBLE))
  - CAST('1e-9' AS DOUBLE)) AS INTEGER) AS dim, count(*) AS n FROM lines),
vectors AS (SELECT code, CAST(i AS INTEGER) AS i, (code * 7 + i * 3) % 11 / CAST(10 AS DOUBLE)
    - CAST('0.5' AS DOUBLE) AS v, ((i + 1) * 5 % 7 - 3) / CAST(10 AS DOUBLE) AS w
  FROM (SELECT DISTINCT l_orderkey AS code FROM lines), sizes, range(0, 100) AS g(i) WHERE i < dim),
pulls AS (SELECT code, sum(v * w) AS pull FROM vectors GROUP BY code),
misses AS (SELECT l_orderkey AS code, sum(1 / (1 + exp(-(CAST('0.1' AS DOUBLE)
    - CAST('0.3' AS DOUBLE) * l_quantity / 50 + pull))) - conversion_target) / any_value(n) AS miss
  FROM lines JOIN pulls ON l_orderkey = code, sizes GROUP BY 1),
gradients AS (SELECT code, i, v, miss * w AS g FROM vectors JOIN misses USING (code))"""


def stored_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, Shape, np.ndarray]:
    """(rows, embeddings with given vectors, shape, given weights)."""
    df = materialize(lines(spark, sf_dir).select(
        F.array(F.col("l_quantity") / 50, F.col("l_orderkey").cast("double")).alias("features"),
        F.col(TARGET).alias("label"), F.monotonically_increasing_id().alias("row"),
        F.col("l_orderkey").alias("code")), "order-rows")
    shape = Shape(2, (), batch_norm=False, alpha=6.0, stored=(1,),
                  index_map={1: df.agg(F.max("code")).first()[0] + 1})
    dim = shape.width - 1
    store = stored.unmoved(df.select("code").distinct().select(
        F.lit(1).alias("position"), "code", F.transform(
            F.sequence(F.lit(0), F.lit(dim - 1)),
            lambda i: F.pmod(F.col("code") * 7 + i * 3, F.lit(11)) / 10.0 - 0.5).alias("vector")))
    flat = kernel.initial_weights(shape) * 0.0
    w = kernel.as_blocks(shape, flat)
    w["d0w"][:, 1] = [(j * 5 % 7 - 3) / 10 for j in range(dim + 1)]
    w["d0b"][1] = 0.1
    return df.drop("code"), store, shape, flat


PLAIN = Training(use_disguise=False, dtype="float64")


@query("stored_embedding_gradient", with_(STORED, """SELECT code, i, round(1000 * g, 6) + 0 AS value
  FROM gradients"""))
def stored_embedding_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gradient of every embedding that the rows hold, as rows by code."""
    df, store, shape, flat = stored_orders(spark, sf_dir)
    _, found, _ = stored.gradient(df, store, shape, PLAIN, flat, kernel.Adam())
    return found.select("code", F.posexplode("gradient").alias("i", "value")).select(
        "code", "i", r(F.col("value") * 1000).alias("value"))


@query("stored_embedding_step", with_(STORED, """SELECT code, i, round(v - CAST('0.001' AS DOUBLE)
  * sqrt(CAST('0.001' AS DOUBLE)) / CAST('0.1' AS DOUBLE) * CAST('0.1' AS DOUBLE) * g
  / (sqrt(CAST('0.001' AS DOUBLE) * g * g) + CAST('1e-8' AS DOUBLE)), 6) + 0 AS value
  FROM gradients"""))
def stored_embedding_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings after one optimiser step over all rows."""
    df, store, shape, flat = stored_orders(spark, sf_dir)
    model = stored.fit_stored(df.drop("row"), shape, replace(PLAIN, epochs=1), store=store, flat=flat)
    return model.vectors().select("code", F.posexplode("vector").alias("i", "value")).select(
        "code", "i", r("value").alias("value"))


@query("early_stopping")
def early_stopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, validation, _ = labelled(spark, sf_dir)
    training = Training(epochs=12, learning_rate=2e-2, batch_size=32, early_stopping=2)
    model = DisguiseClassifier(Shape(WIDTH, (16,)), training, validation=validation).fit(train)
    return model.log_table(spark, "early").filter(F.col("tag") == "validation auroc")


@query("checkpoint", "SELECT vec_id, 1 AS same FROM embeddings")
def checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights restored from the newest version score every row as before."""
    df = everything(spark, sf_dir)
    path, shape = scratch_path(spark, "checkpoints"), Shape(WIDTH, (8,))
    model = DisguiseClassifier(shape, Training(epochs=2), checkpoint_dir=path).fit(df)
    flat = load_checkpoint(spark, path).flat
    both = df.withColumn("before", model.score()).withColumn(
        "after", DisguiseModel(shape, flat).score())
    return both.select("vec_id", (F.col("before") == F.col("after")).cast("int").alias("same"))


def bundle(scored: DataFrame, label: str = "label") -> DataFrame:
    return metrics.metric_bundle(scored.select(F.col(label).alias("y"), "score"))


@query("logistic_regression")
def logistic_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _, test = labelled(spark, sf_dir)
    model = baselines.logistic_regression(baselines.as_vector(train), "label")
    return bundle(baselines.positive_score(model.transform(baselines.as_vector(test))))


@query("tune_on_validation")
def tune_on_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, validation, _ = labelled(spark, sf_dir)
    return baselines.tune_on_validation(train, validation, "label")


PENALTIES = (1e-5, 1e-4, 1e-3, 1e-2, 1.0, 100.0)


def newton_sql(steps: int = 12) -> str:
    """CTEs n0 .. n<steps> (c, b, u, w): Newton steps for an offset and two weights."""
    values = ", ".join(f"({c!r}::DOUBLE)" for c in PENALTIES)
    ctes = [f"n0 AS (SELECT c, 0::DOUBLE AS b, 0::DOUBLE AS u, 0::DOUBLE AS w FROM (VALUES {values}) AS g(c))"]
    for step in range(1, steps + 1):
        ctes.append(f"""q{step} AS (SELECT c, b, u, w, x, y, 1 / (1 + exp(-(b + u * x + w * y))) AS p, t
  FROM points, n{step - 1} WHERE split = 'train'),
h{step} AS (SELECT c, b, u, w, sum(p - t) AS g0, sum((p - t) * x) + u / c AS g1,
  sum((p - t) * y) + w / c AS g2, sum(p * (1 - p)) AS a, sum(p * (1 - p) * x) AS d,
  sum(p * (1 - p) * y) AS e, sum(p * (1 - p) * x * x) + 1 / c AS f, sum(p * (1 - p) * x * y) AS h,
  sum(p * (1 - p) * y * y) + 1 / c AS k FROM q{step} GROUP BY c, b, u, w),
n{step} AS MATERIALIZED (SELECT c, b - (g0 * (f * k - h * h) - d * (g1 * k - h * g2) + e * (g1 * h - f * g2)) / det AS b,
  u - (a * (g1 * k - h * g2) - g0 * (d * k - h * e) + e * (d * g2 - g1 * e)) / det AS u,
  w - (a * (f * g2 - g1 * h) - d * (d * g2 - g1 * e) + g0 * (d * h - f * e)) / det AS w
  FROM (SELECT *, a * (f * k - h * h) - d * (d * k - h * e) + e * (d * h - f * e) AS det FROM h{step}))""")
    return ",\n".join(ctes)


POINTS = LINES + ", " + SPLIT + """, points AS (SELECT split, conversion_target AS t, l_quantity / 50 AS x,
  l_extendedprice / 100000 AS y FROM split_lines)"""


@query("penalty_path", with_(POINTS + ",\n" + newton_sql() + """,
cells AS (SELECT c, t, b + u * x + w * y AS z FROM points, n12 WHERE split = 'validation'),
ranked AS (SELECT c, t, rank() OVER (PARTITION BY c ORDER BY z)
  + (count(*) OVER (PARTITION BY c, z) - 1) / CAST(2 AS DOUBLE) AS place FROM cells),
areas AS (SELECT c, (sum(place) FILTER (t = 1) - count(*) FILTER (t = 1) * (count(*) FILTER (t = 1) + 1)
  / CAST(2 AS DOUBLE)) / (count(*) FILTER (t = 1) * CAST(count(*) FILTER (t = 0) AS DOUBLE)) AS auroc
  FROM ranked GROUP BY c)""", """SELECT c, round(b, 5) + 0 AS offset_weight, round(u, 5) + 0 AS quantity_weight,
  round(w, 5) + 0 AS price_weight, round(auroc, 5) AS auroc FROM n12 JOIN areas USING (c)"""))
def penalty_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights under six penalties and their ranking of the validation rows."""
    df = with_split(lines(spark, sf_dir), F.col(KEY)).select(
        "split", F.col(TARGET).alias("label"),
        F.array(F.col("l_quantity") / 50, F.col("l_extendedprice") / 100000).alias("features"))
    path = PenaltyPath(df.where("split = 'train'"), "label", grid=PENALTIES)
    rows = [(c, float(b), float(w[0]), float(w[1]))
            for c, b, w in zip(path.grid, path.offsets, path.weights)]
    fitted = spark.createDataFrame(
        rows, "c double, offset_weight double, quantity_weight double, price_weight double")
    areas = path.auroc(df.where("split = 'validation'"), "label")
    return rounded(fitted.join(areas, "c"),
                   ["offset_weight", "quantity_weight", "price_weight", "auroc"], 5)


@query("refit_train_plus_validation")
def refit_train_plus_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, validation, test = (baselines.as_vector(d) for d in labelled(spark, sf_dir))
    model = baselines.refit_train_plus_validation(train, validation, "label")
    return bundle(baselines.positive_score(model.transform(test)))


@query("random_forest_cv")
def random_forest_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _, test = labelled(spark, sf_dir)
    grown = baselines.as_vector(materialize(
        smote(train, "label", "vec_id", "features", 20), "smote"))
    search = baselines.random_forest_cv(grown, "vec_id", "label")
    scored = baselines.positive_score(search.bestModel.transform(baselines.as_vector(test)))
    return bundle(scored).withColumn("cv_accuracy", F.lit(float(search.avgMetrics[0])))


GAUSS = LINES + f""", gauss AS (SELECT row_key, label,
  CASE label WHEN 1 THEN 1 + 0.4 * x0 ELSE x0 END AS x0,
  CASE label WHEN 1 THEN 1 + 0.4 * x1 ELSE x1 END AS x1
  FROM (SELECT row_key, CAST(row_number() OVER (ORDER BY md5('gauss:label:' || row_key))
      <= round_even((SELECT count(*) FROM lines) * 0.1::DOUBLE, 0) AS INTEGER) AS label,
    {normal_sql("row_key", "gauss:x0")} AS x0, {normal_sql("row_key", "gauss:x1")} AS x1
  FROM lines)),
floors AS (SELECT 1e-9 * greatest(var_pop(x0), var_pop(x1)) AS f FROM gauss),
moments AS (SELECT label, avg(x0) AS m0, var_pop(x0) + any_value(f) AS v0, avg(x1) AS m1,
  var_pop(x1) + any_value(f) AS v1 FROM gauss, floors GROUP BY 1),
likely AS (SELECT row_key, g.label, m.label AS class, ln(CASE m.label WHEN 1 THEN 0.1::DOUBLE
    ELSE 0.9::DOUBLE END) - 0.5 * ln(2 * pi() * v0) - (x0 - m0) * (x0 - m0) / (2 * v0)
  - 0.5 * ln(2 * pi() * v1) - (x1 - m1) * (x1 - m1) / (2 * v1) AS ll FROM gauss g, moments m)"""


@query("gaussian_nb", with_(GAUSS, """SELECT row_key, label, round(1 / (1 + exp(
  max(ll) FILTER (class = 0) - max(ll) FILTER (class = 1))), 6) AS probability
  FROM likely GROUP BY 1, 2"""))
def gaussian_nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = materialize(generators.two_gaussians(lines(spark, sf_dir), KEY), "gauss")
    return df.select(KEY, "label", r(baselines.gaussian_nb(df, ["x0", "x1"], "label"))
                     .alias("probability"))


@query("gaussian_nb_accuracy", with_(GAUSS, """SELECT round(avg(CAST(
  (a - b <= 0) = (label = 1) AS INTEGER)), 6) AS accuracy FROM (SELECT label,
  max(ll) FILTER (class = 0) AS a, max(ll) FILTER (class = 1) AS b FROM likely
  GROUP BY row_key, label)"""))
def gaussian_nb_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = materialize(generators.two_gaussians(lines(spark, sf_dir), KEY), "gauss")
    hit = predicted_class(baselines.gaussian_nb(df, ["x0", "x1"], "label")) == F.col("label")
    return df.agg(r(F.avg(hit.cast("int"))).alias("accuracy"))


@query("mlp_baseline")
def mlp_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _, test = labelled(spark, sf_dir)
    model = baselines.mlp_baseline(train, WIDTH, "label")
    return bundle(model.transform(test))


@query("experiment")
def experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oversampled positives, adversarial training, recorded test result."""
    train, validation, test = labelled(spark, sf_dir)
    path = scratch_path(spark, "experiment")
    run_experiment("run-1", train, validation, test, DAN_SHAPE, QUICK, oversample_times=5,
                   checkpoint_dir=f"{path}/checkpoints", results_dir=path)
    return spark.read.parquet(f"{path}/results")


SWEEP = Training(epochs=1, learning_rate=5e-3, batch_size=64)


@query("lambda_eta_sweep")
def lambda_eta_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, validation, _ = labelled(spark, sf_dir)
    trials = baselines.sweep(train, validation, Shape(WIDTH, (16,), (16,)), SWEEP,
                             [0.1, 1.0], [0.1, 1.0])
    rows = [(s["lambd"], s["eta"], m["accuracy"], m["auroc"], m["auroc_micro"],
             m["cross_entropy"]) for s, _, m in trials]
    return spark.createDataFrame(rows, "lambd double, eta double, accuracy double, auroc double, "
                                       "auroc_micro double, cross_entropy double")


@query("lambda_eta_random_search")
def lambda_eta_random_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight drawn settings side by side; half of them go on after each rung."""
    train, validation, _ = labelled(spark, sf_dir)
    settings = search.drawn_settings(8, {"lambd": (0.01, 10.0), "eta": (0.05, 2.0)})
    _, rows = search.halving(train, validation, Shape(WIDTH, (16,), (16,)),
                             replace(SWEEP, epochs=1), settings)
    return search.rung_table(spark, rows)


@query("lambda_activation_effect")
def lambda_activation_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, validation, _ = labelled(spark, sf_dir)
    trials = baselines.sweep(train, validation, Shape(WIDTH, (8,), (8,)), SWEEP, [0.01, 1.0],
                             [1.0], list(kernel.ACTIVATIONS))
    return baselines.disguise_effect(everything(spark, sf_dir).filter("label = 0"), trials)


COVARIANCE = CELLS + """, means AS (SELECT pos, avg(value) AS m, count(*) AS n
  FROM cells GROUP BY pos),
centred AS (SELECT vec_id, conversion_target, pos, value - m AS x, n FROM cells JOIN means USING (pos)),
cov AS MATERIALIZED (SELECT a.pos AS i, b.pos AS j, sum(a.x * b.x) / (any_value(a.n) - 1) AS c
  FROM centred a JOIN centred b USING (vec_id) GROUP BY 1, 2)"""


def components_sql(k: int, squarings: int = 16) -> str:
    """CTEs v1 .. vk (i, v) and l1 .. lk (value): the leading eigenpairs of ``cov``.

    Squared over and over, the matrix tends to that of its first eigenvector; taken away from
    ``cov``, it leaves the next one first.
    """
    ctes, left = [], "cov"
    for n in range(1, k + 1):
        last = left
        for step in range(squarings):
            name = f"s{n}_{step}"
            ctes.append(f"""{name} AS MATERIALIZED (SELECT i, j, c / sqrt(sum(c * c) OVER ()) AS c
  FROM (SELECT a.i, b.j, sum(a.c * b.c) AS c FROM {last} a JOIN {last} b ON a.j = b.i GROUP BY 1, 2))""")
            last = name
        ctes.append(f"""u{n} AS (SELECT i, c / sqrt(sum(c * c) OVER ()) AS v FROM {last}
  WHERE j = (SELECT i FROM {last} WHERE i = j ORDER BY c DESC LIMIT 1)),
v{n} AS MATERIALIZED (SELECT i, v * sign((SELECT v FROM u{n} ORDER BY abs(v) DESC LIMIT 1)) AS v FROM u{n}),
l{n} AS MATERIALIZED (SELECT sum(a.v * c * b.v) AS value FROM {left}
  JOIN v{n} a USING (i) JOIN v{n} b ON b.i = j),
c{n} AS MATERIALIZED (SELECT i, j, c - value * a.v * b.v AS c FROM {left}
  JOIN v{n} a USING (i) JOIN v{n} b ON b.i = j, l{n})""")
        left = f"c{n}"
    return ",\n".join(ctes)


@query("pca_project", with_(COVARIANCE + ",\n" + components_sql(3) + """,
parts AS (SELECT vec_id, pos, CASE conversion_target WHEN 1 THEN 'positive' ELSE 'negative' END AS kind,
    x FROM centred
  UNION ALL SELECT vec_id, CAST(j AS INTEGER), 'disguised', t - m FROM (SELECT vec_id, j,
    sum(value * (((31 * pos + 17 * j) % 13 - 6) / CAST(100 AS DOUBLE))) + j / CAST(64 AS DOUBLE) AS t
    FROM cells, range(0, 64) AS g(j) WHERE conversion_target = 0 GROUP BY vec_id, j)
    JOIN means ON means.pos = j)""", """SELECT vec_id, kind, round(sum(x * v1.v), 6) + 0 AS pc1,
  round(sum(x * v2.v), 6) + 0 AS pc2, round(sum(x * v3.v), 6) + 0 AS pc3 FROM parts
  JOIN v1 ON v1.i = pos JOIN v2 ON v2.i = pos JOIN v3 ON v3.i = pos GROUP BY vec_id, kind"""))
def pca_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = everything(spark, sf_dir)
    pca = CentredPCA(df, k=3)
    moved = fixed_disguise().disguise(df.filter("label = 0"))
    plain = pca.project(df).select(
        "vec_id", F.when(F.col("label") == 1, F.lit("positive")).otherwise(F.lit("negative"))
        .alias("kind"), "pc1", "pc2", "pc3")
    disguised = pca.project(moved, "disguised").select(
        "vec_id", F.lit("disguised").alias("kind"), "pc1", "pc2", "pc3")
    return rounded(plain.unionByName(disguised), ["pc1", "pc2", "pc3"])


# The ratios belong to the eigenvalues, which SQL lacks; their sum over all
# components times the total variance is checked instead.
@query("pca_explained_variance", with_(CELLS, """SELECT round(sum(v), 6) AS total_variance FROM (
  SELECT var_samp(value) AS v FROM cells GROUP BY pos)"""))
def pca_explained_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = everything(spark, sf_dir)
    pca = CentredPCA(df, k=WIDTH)
    spread = pca.project(df).agg(*[F.var_samp(f"pc{i + 1}").alias(f"pc{i + 1}")
                                   for i in range(WIDTH)])
    shares = dict(zip(spread.columns, pca.ratios))
    # component variance = ratio x total, so variance / ratio gives the total back
    weighted = sum((F.col(c) for c in spread.columns), F.lit(0.0)) / float(sum(shares.values()))
    return spread.select(r(weighted).alias("total_variance"))


@query("pca_eigenvalue_sums", with_(COVARIANCE, """SELECT power,
  round(value, 6) AS value FROM (SELECT 1 AS power, sum(c) FILTER (i = j) AS value FROM cov
  UNION ALL SELECT 2, sum(c * c) FROM cov
  UNION ALL SELECT 3, sum(a.c * b.c * d.c) FROM cov a JOIN cov b ON a.j = b.i
    JOIN cov d ON b.j = d.i AND d.j = a.i)"""))
def pca_eigenvalue_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of powers of all eigenvalues: traces of powers of the covariance in SQL."""
    df = everything(spark, sf_dir)
    pca = CentredPCA(df, k=WIDTH)
    total = df.agg(sum((F.var_samp(F.get("features", F.lit(i))) for i in range(WIDTH)),
                       F.lit(0.0))).first()[0]
    values = np.asarray(pca.ratios) * total
    rows = [(k, float((values ** k).sum())) for k in (1, 2, 3)]
    return rounded(spark.createDataFrame(rows, "power int, value double"), ["value"])


@query("pca_ratios", with_(COVARIANCE + ",\n" + components_sql(3) + """,
total AS (SELECT sum(c) AS t FROM cov WHERE i = j)""", """SELECT component, round(value / t, 6) AS ratio
  FROM (SELECT 1 AS component, value FROM l1 UNION ALL SELECT 2, value FROM l2
    UNION ALL SELECT 3, value FROM l3), total"""))
def pca_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    pca = CentredPCA(everything(spark, sf_dir), k=3)
    rows = [(i + 1, float(v)) for i, v in enumerate(pca.ratios)]
    return rounded(spark.createDataFrame(rows, "component int, ratio double"), ["ratio"])
