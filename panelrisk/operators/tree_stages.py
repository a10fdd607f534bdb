"""The histogram trees as Spark ML stages, so that they fit into pipelines, and save and load with them."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol
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
from pyspark.sql import types as T

from panelrisk.operators import trees
from panelrisk.session import ship

#: A column with each row's number for draws; where it is absent, the number is a hash of the row.
KEY = "__key"


def row_hash(df: DataFrame, *without: str) -> Column:
    """A number for each row from its values: the draws of a bootstrap sample depend on nothing else."""
    plain = [f.name for f in df.schema.fields if f.name not in without and not isinstance(f.dataType, (VectorUDT, T.MapType, T.VariantType))]
    return F.xxhash64(*[F.col("`" + c.replace("`", "``") + "`") for c in plain])


class _Sizes(HasLabelCol, HasFeaturesCol):
    settings = Param(Params._dummy(), "settings", "kind and sizes of the model, as JSON", typeConverter=TypeConverters.toString)

    @property
    def spec(self) -> trees.Forest | trees.Boosting:
        return trees.from_settings(json.loads(self.getOrDefault("settings")))

    def getNumTrees(self) -> int:
        return self.spec.trees

    def getMaxIter(self) -> int:
        return self.spec.rounds

    def getStepSize(self) -> float:
        return self.spec.step

    def getMaxDepth(self) -> int:
        return trees.DEEPEST if self.spec.depth is None else self.spec.depth

    def getMinSplit(self) -> int:
        return self.spec.min_split

    def getMinInstancesPerNode(self) -> int:
        return self.spec.min_leaf


class TreeClassifier(Estimator, _Sizes, DefaultParamsReadable, DefaultParamsWritable):
    """Fits a forest or boosted trees on a vector of features; NaN is a missing value."""

    @keyword_only
    def __init__(self, *, spec=None, labelCol="label", featuresCol="features"):
        super().__init__()
        self._set(labelCol=labelCol, featuresCol=featuresCol)
        if spec is not None:
            self._set(settings=json.dumps(trees.settings(spec)))

    def _fit(self, dataset: DataFrame) -> TreeClassifierModel:
        ship(dataset.sparkSession)
        key = F.col(KEY) if KEY in dataset.columns else row_hash(dataset)
        rows = trees.prepare(dataset, vector_to_array(F.col(self.getFeaturesCol())), self.getLabelCol(), key, None)
        fitted = trees.fit_all(rows, [trees.Task(self.spec)])[0]
        size = rows.agg(F.max(F.size("x"))).first()[0] or 0
        return self._copyValues(TreeClassifierModel(fitted, size))


class TreeClassifierModel(Model, _Sizes, MLReadable, MLWritable):
    """Adds ``probability`` (a vector for the two classes) and ``prediction`` (1.0 where the second is above one half)."""

    def __init__(self, ensemble: trees.Ensemble | None = None, n_features: int = 0):
        super().__init__()
        self.ensemble, self.numFeatures = ensemble, n_features

    @property
    def featureImportances(self):
        return Vectors.dense(self.ensemble.importances(self.numFeatures))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ship(dataset.sparkSession)
        held = dataset.sparkSession.sparkContext.broadcast(self.ensemble)  # the model, whatever the rows

        @F.arrow_udf("double")
        def positive(x: pa.Array) -> pa.Array:
            if not len(x):
                return pa.array([], pa.float64())
            values = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
            return pa.array(held.value.probability(values))

        return (dataset.withColumn("__p1", positive(vector_to_array(F.col(self.getFeaturesCol()))))
                .withColumn("probability", array_to_vector(F.array(1 - F.col("__p1"), F.col("__p1"))))
                .withColumn("prediction", (F.col("__p1") > 0.5).cast("double")).drop("__p1"))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


_NODES = ("feature", "threshold", "missing_left", "left", "right", "value", "gain", "count")


class _Writer(MLWriter):
    def __init__(self, instance: TreeClassifierModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        own, spark = self.instance.ensemble, SparkSession.active()
        DefaultParamsWriter.saveMetadata(self.instance, path, spark, extraMetadata={"kind": own.kind, "numFeatures": self.instance.numFeatures})
        root = np.zeros(len(own.feature), bool)
        root[own.roots] = True
        nodes = pa.table({"id": np.arange(len(own.feature)), "root": root, **{c: getattr(own, c) for c in _NODES}})
        spark.createDataFrame(nodes).write.parquet(f"{path}/nodes")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> TreeClassifierModel:
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        nodes = spark.read.parquet(f"{path}/nodes").orderBy("id").toArrow()
        held = {c: nodes.column(c).to_numpy() for c in nodes.column_names}
        out = TreeClassifierModel(trees.Ensemble(metadata["kind"], np.flatnonzero(held["root"]), **{c: held[c] for c in _NODES}),
                                  metadata["numFeatures"])
        out._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(out, metadata)
        return out
