"""The edge to ``pyspark.ml``: vectors, pipeline stages, SVM and forest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import Estimator, Transformer
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from lexigrid.operators.metrics import averaged_f1
from lexigrid.session import staged


def to_vectors(cells: DataFrame, size: int, keep: Sequence[str] = (), docs: DataFrame | None = None) -> DataFrame:
    """``doc_id, *keep, features``: one sparse vector for each document.

    Only a document's own cells meet in one row.  With ``docs``, every row of
    it gets a vector and keeps its columns, without cells an empty vector.
    """
    gathered = cells.groupBy("doc_id", *keep).agg(
        F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("_cells")
    )
    if docs is not None:
        gathered = docs.join(gathered.select("doc_id", "_cells"), "doc_id", "left")
    none = F.array().cast("array<struct<idx:int,value:double>>")
    cell = F.coalesce(F.col("_cells").cast("array<struct<idx:int,value:double>>"), none)
    sparse = F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"),
        F.transform(cell, lambda x: x["idx"]).alias("indices"), F.transform(cell, lambda x: x["value"]).alias("values"),
    )
    plain = gathered.withColumn("features", sparse).drop("_cells")
    # Learners read vectors hundreds of times, so their partitions follow the size of the data, not of the
    # shuffle before.  A vector is stored as this struct, so the table is written as one and read as the other
    schema = StructType([StructField("features", VectorUDT()) if f.name == "features" else f for f in plain.schema])
    return staged(plain.hint("rebalance"), "vectors", schema)


@dataclass
class Pipe:
    """A named stage with the parameter values to try.

    Stages named ``clf`` are classifiers, the others run before them.  A seed
    is set where the stage takes one.
    """

    name: str
    stage: Estimator | Transformer
    parameters: Mapping[str, Sequence] = field(default_factory=dict)

    def seeded(self, seed: int) -> "Pipe":
        if self.stage.hasParam("seed"):
            self.stage.set(self.stage.getParam("seed"), seed)
        return self


def label_indexer() -> StringIndexer:
    """Label numbers in sorted order; a label not seen before is an error."""
    return StringIndexer(
        inputCol="label", outputCol="label_idx", stringOrderType="alphabetAsc", handleInvalid="error"
    )


def linear_svm(c: float = 1.0, n_rows: int = 1, features: str = "features", max_iter: int = 50) -> Pipeline:
    """A linear SVM with probabilities.

    One margin for each class against the rest, then a logistic fit on the
    margins.  ``c`` weighs the summed loss, so the penalty of the mean loss is
    ``1 / (c * n_rows)``.
    """
    margin = OneVsRest(
        classifier=LinearSVC(
            regParam=1.0 / (c * n_rows), maxIter=max_iter, tol=1e-3, rawPredictionCol="margins", standardization=False
        ),
        featuresCol=features, labelCol="label_idx", predictionCol="svm_idx", rawPredictionCol="margins",
        parallelism=4,
    )
    calibrated = LogisticRegression(
        featuresCol="margins", labelCol="label_idx", predictionCol="predicted_idx",
        probabilityCol="probability", rawPredictionCol="calibrated", family="multinomial", tol=1e-4,
    )
    return Pipeline(stages=[margin, calibrated])


def random_forest(trees: int = 50, depth: int = 8, seed: int = 42, features: str = "features") -> RandomForestClassifier:
    return RandomForestClassifier(
        featuresCol=features, labelCol="label_idx", predictionCol="predicted_idx", numTrees=trees, maxDepth=depth, seed=seed
    )


def name_of(stage: Estimator | Transformer) -> str:
    """The class of the classifier that a pipeline or a one-against-rest stands for."""
    if isinstance(stage, Pipeline):
        return name_of(stage.getStages()[0])
    return type(stage.getClassifier() if isinstance(stage, OneVsRest) else stage).__name__


def fit_labelled(model: Estimator, vectors: DataFrame) -> PipelineModel:
    """Fit label numbers and a model, and give labels back as names."""
    indexer = label_indexer().fit(vectors)
    names = IndexToString(inputCol="predicted_idx", outputCol="predicted", labels=indexer.labels)
    return Pipeline(stages=[indexer, model, names]).fit(vectors)


class AveragedF1(Evaluator):
    """F1 in one of the averages binary, micro, macro and weighted."""

    def __init__(self, average: str = "weighted"):
        super().__init__()
        self.average = average

    def _evaluate(self, dataset: DataFrame) -> float:
        pairs = dataset.select(F.col("label_idx").alias("label"), F.col("predicted_idx").alias("predicted"))
        found = averaged_f1(pairs, self.average).first()
        return float(found["score"] or 0.0) if found else 0.0


def find_param(stage: Estimator | Transformer, name: str) -> Param:
    """A parameter of a stage, or of what it is made of."""
    if stage.hasParam(name):
        return stage.getParam(name)
    inner = stage.getStages() if isinstance(stage, Pipeline) else []
    if isinstance(stage, OneVsRest):
        inner = [stage.getClassifier()]
    for part in inner:
        try:
            return find_param(part, name)
        except KeyError:
            pass
    raise KeyError(f"no parameter {name!r} in {stage}")


def cross_validate(
    pipes: Sequence[Pipe], vectors: DataFrame, folds: int, seed: int = 42, average: str = "weighted", parallelism: int = 4
) -> list[CrossValidatorModel]:
    """Search the grid of every classifier over the ``fold`` column.

    Each classifier is searched with all combinations of its own values and
    those of the stages before it.  Models of the search are not kept.
    """
    pipes = [p.seeded(seed) for p in pipes]
    before = [p for p in pipes if p.name != "clf"]
    found = []
    for clf in (p for p in pipes if p.name == "clf"):
        grid = ParamGridBuilder()
        for p in [*before, clf]:
            for name, values in p.parameters.items():
                grid = grid.addGrid(find_param(p.stage, name), list(values))
        found.append(
            CrossValidator(
                estimator=Pipeline(stages=[p.stage for p in [*before, clf]]),
                estimatorParamMaps=grid.build(), evaluator=AveragedF1(average),
                numFolds=folds, foldCol="fold", parallelism=parallelism,
            ).fit(vectors)
        )
    return found


def grid_scores(found: Sequence[CrossValidatorModel]) -> list[tuple[int, int, str, float]]:
    """``classifier, setting, parameters, mean score`` of every setting."""
    return [
        (i, j, ", ".join(f"{p.name}={v}" for p, v in setting.items()), float(score))
        for i, model in enumerate(found)
        for j, (setting, score) in enumerate(zip(model.getEstimatorParamMaps(), model.avgMetrics))
    ]
