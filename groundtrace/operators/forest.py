"""Forest and neural classifiers on the feature table."""

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    MultilayerPerceptronClassifier, RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundtrace import vocabulary as v
from groundtrace.operators.metrics import class_weights, standardised
from groundtrace.session import stored


@dataclass(frozen=True)
class ForestSettings:
    """Shape of a forest; the detector uses 6 trees of depth 6, the disagreement model 100."""

    trees: int = 6
    depth: int = 6
    seed: int = 42
    bins: int = 32
    balanced: bool = True
    bootstrap: bool = True  # off: every tree sees all rows


@dataclass(frozen=True)
class ForestModel:
    """A fitted forest, its feature list (inside the assembler) and the training statistics."""

    pipeline: PipelineModel
    statistics: dict[str, tuple[float, float]] = field(default_factory=dict)

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(self.pipeline.stages[0].getInputCols())

    @property
    def forest(self):
        return self.pipeline.stages[1]

    @property
    def importances(self) -> dict[str, float]:
        """Importance per feature; as many numbers as features."""
        return dict(zip(self.names, (float(x) for x in self.forest.featureImportances.toArray())))

    @property
    def used(self) -> list[str]:
        """The features that some split looks at; a verdict depends on no other."""
        seen = {int(i) for i in re.findall(r"\bfeature (\d+)\b", self.forest.toDebugString)}
        return [n for i, n in enumerate(self.names) if i in seen]


def target_of(label: str = "label") -> Column:
    """benign = 0, malicious = 1 (alphabetical order); any other label is an error."""
    unknown = F.raise_error(F.concat(F.lit("unknown label "), F.coalesce(F.col(label), F.lit("null"))))
    return (F.when(F.col(label) == v.BENIGN, 0.0).when(F.col(label) == v.MALICIOUS, 1.0)
            .otherwise(unknown.cast("double")))


def filled(names: Sequence[str]) -> list[Column]:
    """Features as doubles, missing values as 0."""
    return [F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names]


def weight_of(df: DataFrame, target: str) -> Column:
    """Balanced class weight as a literal case over the two values of the target, 0 and 1."""
    other = F.raise_error(F.concat(F.lit("target is not 0 or 1: "), F.coalesce(F.col(target).cast("string"), F.lit("null"))))
    binary = df.select(F.when(F.col(target).isin(0, 1), F.col(target)).otherwise(other.cast("double")).alias(target))
    rows = class_weights(binary, target).collect()
    if not rows:
        raise ValueError("no rows to fit on")
    first, *others = rows
    case = F.when(F.col(target) == first["label"], F.lit(float(first["weight"])))
    for row in others:
        case = case.when(F.col(target) == row["label"], F.lit(float(row["weight"])))
    return case


def vector_statistics(vectors: DataFrame, names: Sequence[str]) -> dict[str, tuple[float, float]]:
    """(mean, population deviation) per feature from one pass over the assembled vectors.

    A vector summary keeps one buffer for all features, where an aggregate per feature and measure
    would outgrow generated code.
    """
    row = vectors.select(Summarizer.metrics("mean", "variance", "count").summary(
        F.col("features")).alias("s")).first()["s"]
    n = row["count"]
    to_population = (n - 1) / n if n else 0.0  # the summary divides by n - 1
    return {name: (float(m), (max(float(x), 0.0) * to_population) ** 0.5)
            for name, m, x in zip(names, row["mean"], row["variance"])}


def fit_forest(table: DataFrame, names: Sequence[str], settings: ForestSettings = ForestSettings(),
               target: Column | None = None, statistics: bool = True, store: bool = True
               ) -> ForestModel:
    """Fit on a feature table.

    The fit reads its input several times, so vector and target are stored once; ``store=False`` is for
    a table that is stored already.
    """
    assembler = VectorAssembler(inputCols=list(names), outputCol="features")
    narrow = table.select(*filled(names), (target_of() if target is None else target).alias("target"))
    training = assembler.transform(narrow).select("features", "target")
    if store:
        training = stored(training)
    weight = weight_of(training, "target") if settings.balanced else F.lit(1.0)
    vectors = training.withColumn("weight", weight)
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="target", weightCol="weight", numTrees=settings.trees,
        maxDepth=settings.depth, maxBins=settings.bins, seed=settings.seed, bootstrap=settings.bootstrap,
        featureSubsetStrategy="auto").fit(vectors)
    numbers = vector_statistics(vectors, names) if statistics else {}
    return ForestModel(PipelineModel([assembler, forest]), numbers)


def score(model: ForestModel, table: DataFrame, keep: Sequence[str]) -> DataFrame:
    """keep columns, features as doubles, ``prediction``, ``confidence``, ``p_malicious`` (M2).

    A table may lack features that the model does not use; they are 0 in the result.
    """
    others = [c for c in keep if c not in model.names]
    idle = {n for n in model.names if n not in table.columns} - set(model.used)
    given = [F.lit(0.0).alias(n) if n in idle else filled([n])[0] for n in model.names]
    scored = model.pipeline.transform(table.select(*others, *given))
    probability = vector_to_array("probability")
    called = F.when(F.col("prediction") == 1.0, v.MALICIOUS).otherwise(v.BENIGN)
    return scored.select(
        *others, *model.names, called.alias("prediction"),
        F.array_max(probability).alias("confidence"),
        F.element_at(probability, 2).alias("p_malicious"))


def importance_table(spark: SparkSession, model: ForestModel) -> DataFrame:
    """(feature, importance) rows (M3)."""
    return spark.createDataFrame(list(model.importances.items()), "feature string, importance double")


def top_features(model: ForestModel, k: int) -> list[str]:
    """The k most important features, descending; equal ones keep the feature order (L1, L2)."""
    ranked = sorted(model.importances.items(), key=lambda item: -item[1])
    return [name for name, _ in ranked[:k]]


def fit_top_k(table: DataFrame, names: Sequence[str], k: int,
              settings: ForestSettings = ForestSettings(), store: bool = True, statistics: bool = True
              ) -> ForestModel:
    """Fit, keep the k most important features, fit again on those (M4)."""
    if store:
        table = stored(table.select("label", *filled(names)))
    first = fit_forest(table, names, settings, statistics=False, store=False)
    return fit_forest(table, top_features(first, k), settings, statistics=statistics, store=False)


def save_forest(model: ForestModel, spark: SparkSession, path: str) -> None:
    """Write the model, its feature list and the training statistics."""
    model.pipeline.write().overwrite().save(f"{path}/forest")
    rows = [(n, *model.statistics.get(n, (0.0, 1.0))) for n in model.names]
    spark.createDataFrame(rows, "feature string, mean double, deviation double").coalesce(
        1).write.mode("overwrite").parquet(f"{path}/statistics")


def load_forest(spark: SparkSession, path: str) -> ForestModel:
    pipeline = PipelineModel.load(f"{path}/forest")
    rows = spark.read.parquet(f"{path}/statistics").collect()  # one row per feature
    return ForestModel(pipeline, {r["feature"]: (r["mean"], r["deviation"]) for r in rows})


@dataclass(frozen=True)
class NetworkModel:
    """A fitted perceptron with the z-score statistics it was trained with."""

    names: tuple[str, ...]
    statistics: dict[str, tuple[float, float]]
    network: object


def _standardised(df: DataFrame, names, statistics, *others: Column) -> DataFrame:
    ready = df.select(*others, *[standardised(n, *statistics[n]).alias(n) for n in names])
    return VectorAssembler(inputCols=list(names), outputCol="features").transform(ready)


def fit_network(table: DataFrame, names: Sequence[str], hidden: Sequence[int] = (128, 64),
                iterations: int = 50, seed: int = 42, block: int = 128, store: bool = True
                ) -> NetworkModel:
    """Small neural classifier on z-scores (M8)."""
    training = table.select(*filled(names), target_of().alias("target"))
    if store:
        training = stored(training)
    statistics = vector_statistics(
        VectorAssembler(inputCols=list(names), outputCol="features").transform(training), names)
    vectors = _standardised(training, names, statistics, F.col("target")).select("features", "target")
    network = MultilayerPerceptronClassifier(
        featuresCol="features", labelCol="target", layers=[len(names), *hidden, 2],
        maxIter=iterations, seed=seed, blockSize=block).fit(vectors)
    return NetworkModel(tuple(names), statistics, network)


def score_network(model: NetworkModel, table: DataFrame, keep: Sequence[str]) -> DataFrame:
    vectors = _standardised(table, model.names, model.statistics, *[F.col(c) for c in keep])
    probability = vector_to_array("probability")
    called = F.when(F.col("prediction") == 1.0, v.MALICIOUS).otherwise(v.BENIGN)
    return model.network.transform(vectors).select(
        *keep, called.alias("prediction"), F.array_max(probability).alias("confidence"),
        F.element_at(probability, 2).alias("p_malicious"))


def soft_vote(first: ForestModel, second: NetworkModel, table: DataFrame,
              keep: Sequence[str]) -> DataFrame:
    """Mean of both models' probabilities in one pass over the table, without a join (M9)."""
    carried = list(dict.fromkeys([*keep, *second.names]))
    one = score(first, table, carried).select(*carried, F.col("p_malicious").alias("_p1"))
    two = score_network(second, one, [*keep, "_p1"])
    mean = (F.col("_p1") + F.col("p_malicious")) / 2
    averaged = two.select(*keep, mean.alias("p_malicious"))
    return averaged.select(
        *keep, F.when(F.col("p_malicious") > 0.5, v.MALICIOUS).otherwise(v.BENIGN).alias("prediction"),
        F.greatest("p_malicious", 1 - F.col("p_malicious")).alias("confidence"), "p_malicious")
