"""The preparation steps as separate pyspark.ml stages, for use in ml Pipelines.

Each is persistable and can be mixed with Spark's own stages. ``FeatureEncoder``
in ``encode.py`` does all of them in one projection.
"""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from rareflow.operators import clean, encode
from rareflow.operators.profile import build_vocabulary, numeric_stats


class _Stage(HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Shared constructor: ``inputCols`` and the stage's own parameters."""

    @keyword_only
    def __init__(self, **kwargs):
        super().__init__()
        self._set(**self._input_kwargs)


class DropColumns(_Stage, Transformer):
    """Drop the named columns."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.drop(*self.getInputCols())


class FillConstant(_Stage, Transformer):
    """Replace missing values by a constant given as text; keeps each column's type."""

    constant = Param(Params._dummy(), "constant", "replacement of missing values",
                     TypeConverters.toString)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        types = dict(dataset.dtypes)
        value = F.lit(self.getOrDefault(self.constant))
        return dataset.withColumns({c: F.coalesce(F.col(c), value.cast(types[c]))
                                    for c in self.getInputCols()})


class TargetLast(DefaultParamsReadable, DefaultParamsWritable, Transformer):
    """Alphabetical columns, the target last."""

    target = Param(Params._dummy(), "target", "name of the target", TypeConverters.toString)

    @keyword_only
    def __init__(self, target: str = "conversion_target"):
        super().__init__()
        self._set(**self._input_kwargs)
        if not self.isSet(self.target):
            self._set(target="conversion_target")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return clean.order_columns(dataset, self.getOrDefault(self.target))


class _Fitted(_Stage, Model):
    """A model whose fitted values are small enough for a JSON parameter."""

    fitted = Param(Params._dummy(), "fitted", "fitted values as JSON", TypeConverters.toString)

    def values(self) -> dict:
        return json.loads(self.getOrDefault(self.fitted))


class ScalePopulation(_Stage, Estimator):
    """Standardise with the population deviation; nulls stay null."""

    def _fit(self, dataset: DataFrame) -> ScalePopulationModel:
        stats = encode.stats_map(numeric_stats(dataset, self.getInputCols()))
        return ScalePopulationModel(inputCols=self.getInputCols(), fitted=json.dumps(stats))


class ScalePopulationModel(_Fitted):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        return encode.standard_scale(dataset, self.values(), self.getInputCols())


class ExpandLevels(_Stage, Estimator):
    """One column per level, ``<column>_<rank>``; an unseen value is an error."""

    levels = Param(Params._dummy(), "levels", "most levels a column may have",
                   TypeConverters.toInt)

    def _fit(self, dataset: DataFrame) -> ExpandLevelsModel:
        columns = self.getInputCols()
        limit = self.getOrDefault(self.levels) if self.isSet(self.levels) else encode.LEVEL_LIMIT
        levels = encode.column_levels(build_vocabulary(dataset, columns), columns, limit)
        return ExpandLevelsModel(inputCols=columns, fitted=json.dumps(levels))


class ExpandLevelsModel(_Fitted):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        return encode.onehot_expand(dataset, self.values())


class IndexCategories(_Stage, Estimator):
    """Category text -> rank of the text; an unseen value is an error."""

    dictionary = Param(Params._dummy(), "dictionary", "folder to keep the dictionary in",
                       TypeConverters.toString)

    def _fit(self, dataset: DataFrame) -> IndexCategoriesModel:
        path = self.getOrDefault(self.dictionary)
        build_vocabulary(dataset, self.getInputCols()).write.mode("overwrite").parquet(path)
        return IndexCategoriesModel(inputCols=self.getInputCols(), dictionary=path)


class IndexCategoriesModel(_Stage, Model):
    """Looks codes up in the dictionary table, whatever its size."""

    dictionary = Param(Params._dummy(), "dictionary", "folder of the dictionary",
                       TypeConverters.toString)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        vocabulary = dataset.sparkSession.read.parquet(self.getOrDefault(self.dictionary))
        text = clean.cast_category_text(dataset, self.getInputCols())
        return encode.encode_codes(text, vocabulary, self.getInputCols())
