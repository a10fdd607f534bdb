"""Preparation as Spark ML stages: what is fitted on the training part travels with the saved pipeline."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCol
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelrisk.operators.clean import PanelImputer, PanelImputerModel, nan_to_null
from panelrisk.session import materialize


def _number(name: str) -> Column:
    """A column as a double without NaN."""
    x = F.col("`" + name.replace("`", "``") + "`").cast("double")
    return F.when(~F.isnan(x), x)


# ---------------------------------------------------------------- scaling
class PopulationScaler(Estimator, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """A1: (x - mean) / population std of number columns, as one vector.

    Missing values (null, NaN) and infinite ones take no part in the statistics; missing ones are NaN in the vector.
    A column without variance is only centred, one without values is left as it is.
    """

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> PopulationScalerModel:
        cols = self.getInputCols()
        finite = [F.when(F.abs(_number(c)) < float("inf"), _number(c)) for c in cols]
        row = dataset.agg(*[F.avg(x) for x in finite], *[F.stddev_pop(x) for x in finite]).first()
        out = PopulationScalerModel()._set(means=[m or 0.0 for m in row[:len(cols)]], stds=[s or 1.0 for s in row[len(cols):]])
        return self._copyValues(out)


class PopulationScalerModel(Model, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    means = Param(Params._dummy(), "means", "mean of each column", typeConverter=TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "divisor of each column", typeConverter=TypeConverters.toListFloat)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        fitted = zip(self.getInputCols(), self.getOrDefault("means"), self.getOrDefault("stds"))
        scaled = [F.coalesce((_number(c) - m) / s, F.lit(float("nan"))) for c, m, s in fitted]
        out = dataset.withColumn(self.getOutputCol(), array_to_vector(F.array(*scaled)))
        return out.withMetadata(self.getOutputCol(), {"ml_attr": {"num_attrs": len(scaled)}})  # assemblers ask for the length


# ---------------------------------------------------------------- imputing
class _Panel(Params):
    indicators = Param(Params._dummy(), "indicators", "columns filled by medians", typeConverter=TypeConverters.toListString)
    group = Param(Params._dummy(), "group", "column whose groups have medians of their own", typeConverter=TypeConverters.toString)
    categoricals = Param(Params._dummy(), "categoricals", "columns filled by their mode", typeConverter=TypeConverters.toListString)


class ImputerStage(Estimator, _Panel, DefaultParamsReadable, DefaultParamsWritable):
    """M2, M3, M5, M7: ``PanelImputer`` as a stage: group medians, the medians behind them, modes.

    NaN counts as missing.  Columns that the frame lacks are left out; an empty frame or a column without
    values fills nothing.
    """

    @keyword_only
    def __init__(self, *, indicators=(), group=None, categoricals=()):
        super().__init__()
        self._set(indicators=list(indicators), categoricals=list(categoricals))
        if group is not None:
            self._set(group=group)

    def _fit(self, dataset: DataFrame) -> ImputerStageModel:
        num = [c for c in self.getOrDefault("indicators") if c in dataset.columns]
        group = self.getOrDefault("group") if self.isDefined("group") else None
        fitted = PanelImputer(num, group, self.getOrDefault("categoricals")).fit(nan_to_null(dataset, num))
        for name in PanelImputerModel._TABLES:  # the state is tables of their own, not plans over the training data
            if getattr(fitted, name) is not None:
                setattr(fitted, name, materialize(getattr(fitted, name), name.replace("_", "-")))
        return self._copyValues(ImputerStageModel(fitted))


class ImputerStageModel(Model, _Panel, MLReadable, MLWritable):
    """Fills missing values from the fitted tables; a group that the fit did not see takes the medians of all."""

    def __init__(self, fitted: PanelImputerModel | None = None):
        super().__init__()
        self.fitted = fitted

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.fitted.transform(nan_to_null(dataset, self.fitted.num))

    def write(self) -> MLWriter:
        return _ImputerWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ImputerReader(cls)


class _ImputerWriter(MLWriter):
    """Writes to another path than the one a model was loaded from, whose tables it reads."""

    def __init__(self, instance: ImputerStageModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, SparkSession.active())
        self.instance.fitted.save(f"{path}/tables")


class _ImputerReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> ImputerStageModel:
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        out = self.cls(PanelImputerModel.load(spark, f"{path}/tables"))
        out._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(out, metadata)
        return out
