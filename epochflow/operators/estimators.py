"""Pipeline stages in pyspark.ml form, and models fitted by it on feature columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasLabelCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochflow.operators import information, signals, spatial
from epochflow.sources.scratch import staged


class BandpassFilter(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Zero-phase band-pass of signals; rate and band are params, so a saved filter comes back with its own."""

    fs = Param(Params._dummy(), "fs", "samples a second", TypeConverters.toFloat)
    low = Param(Params._dummy(), "low", "lower edge in Hz", TypeConverters.toFloat)
    high = Param(Params._dummy(), "high", "upper edge in Hz", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, fs: float = 250.0, low: float = 8.0, high: float = 30.0, inputCol: str = "signal", outputCol: str = "filtered"):
        super().__init__()
        self._setDefault(fs=250.0, low=8.0, high=30.0, inputCol="signal", outputCol="filtered")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        band = [self.getOrDefault(p) for p in (self.fs, self.low, self.high)]
        return df.withColumn(self.getOutputCol(), signals.bandpassed(F.col(self.getInputCol()), *band))


class _Fitted(Model, HasInputCol, HasOutputCol):
    def __init__(self, matrix: np.ndarray, source: str, out: str):
        super().__init__()
        self.matrix = matrix
        self._set(inputCol=source, outputCol=out)


class CspModel(_Fitted):
    def _transform(self, df: DataFrame) -> DataFrame:
        return spatial.csp_features(df, self.matrix, self.getInputCol(), self.getOutputCol())


class Csp(Estimator, HasInputCol, HasOutputCol, HasLabelCol):
    """Common spatial patterns of two classes."""

    def __init__(self, classes: tuple = (0, 1), filters: int = 4, inputCol: str = "signal", outputCol: str = "features", labelCol: str = "label"):
        super().__init__()
        self.classes, self.filters = classes, filters
        self._set(inputCol=inputCol, outputCol=outputCol, labelCol=labelCol)

    def _fit(self, df: DataFrame) -> CspModel:
        c = df.withColumn("_cov", signals.covariance(F.col(self.getInputCol())))
        return CspModel(spatial.csp_filters(c, self.getLabelCol(), self.classes, self.filters, "_cov"), self.getInputCol(), self.getOutputCol())


class TangentModel(_Fitted):
    def _transform(self, df: DataFrame) -> DataFrame:
        c = df.withColumn("_cov", signals.covariance(F.col(self.getInputCol())))
        return spatial.tangent_features(c, self.matrix, "_cov", self.getOutputCol()).drop("_cov")


class TangentSpace(Estimator, HasInputCol, HasOutputCol):
    """Tangent vectors at the Riemannian mean of the training covariances."""

    def __init__(self, inputCol: str = "signal", outputCol: str = "features", rounds: int = 50):
        super().__init__()
        self.rounds = rounds
        self._set(inputCol=inputCol, outputCol=outputCol)

    def _fit(self, df: DataFrame) -> TangentModel:
        c = df.select(signals.covariance(F.col(self.getInputCol())).alias("cov"))
        return TangentModel(spatial.frechet_mean(c, rounds=self.rounds), self.getInputCol(), self.getOutputCol())


class ToVector(Transformer, HasInputCol, HasOutputCol):
    """array<double> to the vectors of pyspark.ml."""

    def __init__(self, inputCol: str = "features", outputCol: str = "vector"):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOutputCol(), array_to_vector(F.col(self.getInputCol())))


class CalibratedModel(Model):
    """A fitted pipeline with a sigmoid on its margins: adds margin and probability (of the label 1)."""

    def __init__(self, inner: Model, sigmoid: tuple[float, float]):
        super().__init__()
        self.inner, self.sigmoid = inner, sigmoid

    def _transform(self, df: DataFrame) -> DataFrame:
        out = self.inner.transform(df).withColumn("margin", vector_to_array("rawPrediction")[1])
        return out.withColumn("probability", information.probability(F.col("margin"), *self.sigmoid))


class Calibrated(Estimator):
    """A pipeline that ends in margins, with probabilities: Platt's sigmoid on the margins of folds held out in turn.

    foldCol names the folds (whole groups); the pipeline is learned once on the others for each, and once on all rows.
    """

    def __init__(self, pipeline: Callable[[], Pipeline], foldCol: str = "fold", labelCol: str = "label"):
        super().__init__()
        self.pipeline, self.fold, self.label = pipeline, foldCol, labelCol

    def _fit(self, df: DataFrame) -> CalibratedModel:
        held = []
        for r in df.select(self.fold).distinct().orderBy(self.fold).collect():  # a handful of folds
            model = self.pipeline().fit(df.where(F.col(self.fold) != r[0]))
            held.append(model.transform(df.where(F.col(self.fold) == r[0])).select(vector_to_array("rawPrediction")[1].alias("margin"), (F.col(self.label) == 1).alias("hit")))
        margins = staged(reduce(DataFrame.unionByName, held), "margins")
        return CalibratedModel(self.pipeline().fit(df), information.platt(margins, "margin", "hit"))


def _standardised(features: Estimator, classifier: Estimator) -> Pipeline:
    """The pass band first, as in learning's pipelines."""
    return Pipeline(stages=[BandpassFilter(), features, ToVector(), StandardScaler(inputCol="vector", outputCol="scaled", withMean=True), classifier])


def _margins() -> Pipeline:
    return _standardised(TangentSpace("filtered"), LinearSVC(featuresCol="scaled", labelCol="label", regParam=0.01, maxIter=30))


#: Pipelines by name, for a label column of 0.0 and 1.0; riemann_svm has folds to learn its probabilities on.
BUILDERS: dict[str, Callable[[], Estimator]] = {
    "csp_lr": lambda: _standardised(Csp(inputCol="filtered"), LogisticRegression(featuresCol="scaled", labelCol="label", regParam=0.01)),
    "riemann_lr": lambda: _standardised(TangentSpace("filtered"), LogisticRegression(featuresCol="scaled", labelCol="label", regParam=0.01)),
    "riemann_svm": lambda: Calibrated(_margins),
}
