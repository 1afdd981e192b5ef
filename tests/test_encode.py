"""Encoders: codes, levels, scaling, the whole preparation, embeddings."""

import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rareflow.operators import encode, profile
from rareflow.operators.clean import FeatureSpec
from rareflow.operators.encode import FeatureEncoder, FeatureEncoderModel


@pytest.fixture()
def table(spark):
    rows = [(f"k{i}", f"site{i % 40}", "abc"[i % 3], None if i % 5 == 0 else float(i % 11),
             3.0, int(i % 9 == 0), "train" if i < 150 else "test") for i in range(200)]
    return spark.createDataFrame(
        rows, "row_key string, site string, kind string, x double, flat double, "
              "conversion_target int, split string")


SPEC = FeatureSpec([], ["flat", "x"], ["kind"], ["site"])


def test_unseen_values(spark, table):
    vocabulary = profile.build_vocabulary(table, ["site"])
    new = spark.createDataFrame([("site3",), ("other",), (None,)], "site string")
    codes = lambda how: [r["site"] for r in encode.encode_codes(
        new, vocabulary, ["site"], how).collect()]
    assert codes("oov") == [codes("oov")[0], 40, 40]
    assert codes("missing")[1:] == [-1, -1]
    with pytest.raises(PySparkException, match="unseen value in column site"):
        codes("error")


def test_large_dictionary_join_equals_broadcast(spark, table):
    hot = table.unionByName(table.filter("site = 'site1'").limit(1).crossJoin(
        spark.range(300)).drop("id"))
    vocabulary = profile.build_vocabulary(hot, ["site"])
    small = encode.encode_codes(hot, vocabulary, ["site"], "oov")
    old = encode.HEAVY_VALUES
    try:
        encode.HEAVY_VALUES = 3
        large = encode.encode_codes(hot, vocabulary, ["site"], "oov", broadcast_bytes=0)
        unranked = encode.encode_codes(hot, vocabulary.drop("n"), ["site"], "oov",
                                       broadcast_bytes=0)
        for other in (large, unranked):
            assert small.exceptAll(other).count() == 0 and other.count() == small.count()
    finally:
        encode.HEAVY_VALUES = old


def test_onehot_levels_and_errors(spark, table):
    levels = encode.column_levels(profile.build_vocabulary(table, ["kind"]), ["kind"])
    assert levels == {"kind": ["a", "b", "c"]}
    row = encode.onehot_expand(table.filter("kind = 'b'").limit(1), levels).first()
    assert (row["kind_0"], row["kind_1"], row["kind_2"]) == (0, 1, 0)
    with pytest.raises(PySparkException, match="unseen value"):
        encode.onehot_expand(spark.createDataFrame([("z",)], "kind string"), levels).collect()
    with pytest.raises(ValueError):
        encode.column_levels(profile.build_vocabulary(table, ["site"]), ["site"], limit=20)


def test_scaling_uses_population_std_and_spares_constants(table):
    stats = encode.stats_map(profile.numeric_stats(table, ["x", "flat"]))
    scaled = encode.standard_scale(table, stats, ["x", "flat"])
    row = scaled.agg(F.stddev_pop("x"), F.avg("x"), F.max("flat"), F.count("x")).first()
    assert row[0] == pytest.approx(1) and row[1] == pytest.approx(0, abs=1e-9)
    assert row[2] == 0 and row[3] == 160
    filled = encode.scale_then_impute(table, stats, ["x"])
    assert filled.filter("x = 0").count() >= 40


def test_encoder_output(spark, table, tmp_path):
    model = FeatureEncoder(SPEC, "split = 'train'", keep=["row_key"]).fit(table)
    out = model.transform(table)
    assert out.columns == ["row_key", "flat", "kind_0", "kind_1", "kind_2", "site", "x",
                           "conversion_target"]
    assert model.output_columns == out.columns[1:-1]
    path = str(tmp_path / "encoder")
    model.save(path)
    again = FeatureEncoderModel.load(spark, path).transform(table)
    assert out.exceptAll(again).count() == 0


def test_training_statistics_ignore_other_splits(spark, table):
    changed = table.withColumn("x", F.when(F.col("split") == "test", 1000.0).otherwise(F.col("x")))
    a = FeatureEncoder(SPEC, "split = 'train'").fit(table)
    b = FeatureEncoder(SPEC, "split = 'train'").fit(changed)
    assert a.stats == b.stats


def test_oov_encoder_fits_on_training_rows(spark, table):
    late = table.withColumn("site", F.when(F.col("split") == "test", F.lit("new"))
                            .otherwise(F.col("site")))
    model = FeatureEncoder(SPEC, "split = 'train'", unseen="oov", keep=["split"]).fit(late)
    codes = {r["site"] for r in model.transform(late).filter("split = 'test'").collect()}
    assert codes == {40}


def test_encoding_is_one_stage_of_projection(table):
    model = FeatureEncoder(SPEC, "split = 'train'").fit(table)
    plan = model.transform(table)._jdf.queryExecution().toString()
    assert "SortMergeJoin" not in plan.split("Physical Plan")[1]


def test_embedding_dims_and_widths(spark):
    cards = spark.createDataFrame([(200,), (100,), (80,), (50,)], "cardinality bigint")
    dims = sorted(r["dim"] for r in encode.embedding_dims(cards).collect())
    assert dims == [4, 5, 5, 6]
    assert encode.embedded_width(cards, 8).first()[0] == 24
    powers = spark.createDataFrame([(n**3,) for n in range(1, 60)], "cardinality bigint")
    assert sorted(r["dim"] for r in encode.embedding_dims(powers).collect()) == list(range(1, 60))


def test_embedding_lookup(spark):
    vectors = spark.createDataFrame([("a", 0, [1.0, 2.0]), ("a", 1, [3.0, 4.0])],
                                    "column string, code bigint, vector array<double>")
    rows = spark.createDataFrame([(7.0, 1), (8.0, 0)], "x double, a bigint")
    for limit in (0, 1 << 20):
        got = encode.embedding_lookup(rows, vectors, ["x"], ["a"], broadcast_bytes=limit)
        assert sorted(r["embedded"] for r in got.collect()) == [[7.0, 3.0, 4.0], [8.0, 1.0, 2.0]]
    with pytest.raises(PySparkException, match="no embedding row"):
        encode.embedding_lookup(spark.createDataFrame([(7.0, 5)], "x double, a bigint"), vectors,
                                ["x"], ["a"]).collect()


def test_sparse_rows(spark, table):
    vocabulary = profile.build_vocabulary(table.filter("split = 'train'"), ["kind", "site"])
    stats = encode.stats_map(profile.numeric_stats(table, ["x"]))
    out = encode.assemble_sparse(table, vocabulary, stats, ["kind", "site"], ["x"])
    vector = out.first()["features"]
    assert vector.size == 4 + 41 + 1
    assert out.select("features").distinct().count() > 1


def test_whole_numbers_are_coded_as_numbers(spark):
    """Codes, missing values and errors are those of the numbers' texts, but no row's number is made one."""
    rows = [(f"k{i}", v, "ab"[i % 2], float(i), i % 2)
            for i, v in enumerate([10, 9, -1, None, 2**53 + 1, 2**53, 9, 100])]
    numbers = spark.createDataFrame(
        rows, "row_key string, site bigint, kind string, x double, conversion_target int")
    texts = numbers.withColumn("site", F.col("site").cast("string"))
    spec = FeatureSpec([], ["x"], ["kind"], ["site"])
    fitted = FeatureEncoder(spec, keep=["row_key"]).fit(numbers)
    plain = FeatureEncoder(spec, keep=["row_key"]).fit(texts)
    assert sorted(fitted.vocabulary.collect()) == sorted(plain.vocabulary.collect())
    out = fitted.transform(numbers)
    assert sorted(out.collect()) == sorted(plain.transform(texts).collect())
    assert sorted(out.collect()) == sorted(fitted.transform(texts).collect())
    plan = out.select("site")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"BroadcastHashJoin \[site#\d+L\], \[__value#\d+L\]", plan)
    other = spark.createDataFrame([("k", 7, "a", 0.0, 1)], numbers.schema)
    with pytest.raises(PySparkException, match="unseen value in column site: 7"):
        fitted.transform(other).collect()
    odd = spark.createDataFrame([("site", "007", 1, 0), ("site", "x", 1, 1), ("site", "7", 1, 2)],
                                "column string, value string, n bigint, idx bigint")
    assert encode.encode_codes(other, odd, ["site"]).first()["site"] == 2


def test_encoder_writes_numbers_and_compiles(spark):
    """Neither keys nor texts of numbers are written, and no generated method is too long to compile."""
    from rareflow.plans import encoding

    df, model = encoding.encoder_model(spark, "/root/testdata/sf0.001")
    written = dict(spark.read.parquet(df.inputFiles()[0]).dtypes)
    assert "row_key" not in written and written["l_partkey"] == "bigint"
    out = encoding.rounded(model.transform(df), encoding.CONTINUOUS)
    old = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        code = spark._jvm.PythonSQLUtils.explainString(
            out.select("*")._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 6_500   # HotSpot compiles none above 8,000


def test_rounding_without_decimals_is_the_same(spark):
    from rareflow.plans.registry import rounded

    values = [0.0, -0.0, 0.5e-6, 1.5e-6, -2.5e-6, 1.00000049, 1.0000005, 1.00000051, 2.675, -2.675, 1e9 + 0.1,
              123456.7890125, 1e13 + 0.123, 1e300, -1e-300, float("nan"), float("inf"), float("-inf"), None]
    df = spark.createDataFrame([(v,) for v in values], "x double").unionByName(
        spark.range(20000).select(((F.rand(3) - 0.5) * F.pow(F.lit(10.0), F.col("id") % 12)).alias("x")))
    for digits in (0, 2, 6):
        both = rounded(df.withColumn("y", F.round("x", digits) + F.lit(0.0)), ["x"], digits)
        assert both.filter(~F.col("x").eqNullSafe(F.col("y"))).count() == 0
    plan = rounded(df, ["x"])._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "rint(" in plan and rounded(df, ["x"]).columns == ["x"]
