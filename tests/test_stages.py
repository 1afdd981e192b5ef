"""The ml stages in a Pipeline, saved and loaded."""

import pytest
from pyspark.errors import PySparkException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from rareflow.operators.stages import (
    DropColumns, ExpandLevels, FillConstant, IndexCategories, ScalePopulation, TargetLast)


def test_stages_in_a_saved_pipeline(spark, tmp_path):
    rows = [(f"s{i % 30}", None if i % 10 == 0 else "ab"[i % 2], float(i) if i % 4 else None, 1.0,
             i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "site string, kind string, x double, w double, y int")
    model = Pipeline(stages=[
        DropColumns(inputCols=["w"]),
        FillConstant(inputCols=["kind"], constant="-1"),
        ScalePopulation(inputCols=["x"]),
        FillConstant(inputCols=["x"], constant="0"),
        IndexCategories(inputCols=["site"], dictionary=str(tmp_path / "dictionary")),
        ExpandLevels(inputCols=["kind"]),
        TargetLast(target="y")]).fit(df)
    out = model.transform(df)
    assert out.columns == ["kind_0", "kind_1", "kind_2", "site", "x", "y"]
    assert out.agg(F.max("site"), F.sum("kind_0")).first()[:] == (29, 12)
    assert out.filter("x is null").count() == 0
    model.write().overwrite().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model")).transform(df)
    assert out.exceptAll(again).count() == 0
    with pytest.raises(PySparkException, match="unseen value"):
        model.transform(df.withColumn("site", F.lit("new"))).collect()
