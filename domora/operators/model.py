"""Price models with Spark ML: preprocessing, candidates, selection, refit, calibration, contributions."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domora.functions import config as C
from domora.operators import metrics
from domora.operators.features import FeatureContext, feature_frame
from domora.session import materialise

NUMBERS = C.NUMERIC_FEATURES + C.FLAG_FEATURES + C.MISSING_FEATURES
RIDGE_ALPHA = 10.0
#: Trees of a forest and their depth; MOST_DEPTH, with 300 trees, is a forest that leaves alone limit.
TREES, DEPTH = 60, 8
MOST_DEPTH = 30
LEAST_IN_LEAF = 5
CANDIDATES = ("naive_median", "ridge_linear", "forest")


@dataclass(frozen=True)
class Imputation:
    """Statistics of a training frame: medians, most frequent values, means and deviations."""

    medians: dict[str, float]
    modes: dict[str, str]
    means: dict[str, float]
    deviations: dict[str, float]
    with_indicator: tuple[str, ...]

    @staticmethod
    def fit(frame: DataFrame) -> Imputation:
        stats = frame.agg(
            *[F.median(c).alias(f"m_{c}") for c in NUMBERS], *[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in NUMBERS], *[F.mode(c, True).alias(f"o_{c}") for c in C.CATEGORICAL_FEATURES]
        ).first()
        medians = {c: float(stats[f"m_{c}"]) if stats[f"m_{c}"] is not None else 0.0 for c in NUMBERS}
        modes = {c: stats[f"o_{c}"] or C.UNKNOWN_VALUE for c in C.CATEGORICAL_FEATURES}
        filled = frame.select(*[F.coalesce(F.col(c).cast("double"), F.lit(medians[c])).alias(c) for c in NUMBERS])
        spread = filled.agg(*[F.avg(c).alias(f"a_{c}") for c in NUMBERS], *[F.stddev_pop(c).alias(f"s_{c}") for c in NUMBERS]).first()
        return Imputation(
            medians, modes, {c: spread[f"a_{c}"] or 0.0 for c in NUMBERS}, {c: spread[f"s_{c}"] or 1.0 for c in NUMBERS}, tuple(c for c in NUMBERS if stats[f"n_{c}"])
        )

    def apply(self, frame: DataFrame, standardise: bool) -> DataFrame:
        out = {}
        for c in NUMBERS:
            value = F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c]))
            out[f"x_{c}"] = (value - self.means[c]) / self.deviations[c] if standardise else value
        for c in self.with_indicator:
            out[f"i_{c}"] = F.col(c).isNull().cast("double")
        out |= {f"k_{c}": F.coalesce(F.col(c), F.lit(self.modes[c])) for c in C.CATEGORICAL_FEATURES}
        return frame.withColumns(out)

    @property
    def inputs(self) -> list[str]:
        return [f"x_{c}" for c in NUMBERS] + [f"i_{c}" for c in self.with_indicator]


@dataclass(frozen=True)
class PriceModel:
    name: str
    context: FeatureContext
    imputation: Imputation
    stages: PipelineModel | None
    constant: float = 0.0

    def predict(self, rows: DataFrame, keep: list[str], as_of: str | None = None) -> DataFrame:
        """keep, the features and prediction (price, not below 0); as_of: a date column that replaces listing_date."""
        return self.predict_frame(feature_frame(rows, self.context, as_of, keep))

    def predict_frame(self, frame: DataFrame) -> DataFrame:
        """A frame of this model's context with prediction."""
        if self.stages is None:
            return frame.withColumn("prediction", F.greatest(F.expm1(F.lit(self.constant)), F.lit(0.0)))
        scored = self.stages.transform(self.imputation.apply(frame, self.name == "ridge_linear"))
        return scored.select(*frame.columns, F.greatest(F.expm1("log_prediction"), F.lit(0.0)).alias("prediction"))

    def save(self, path: str) -> None:
        """state (name, constant, context, imputation) and stages under path."""
        state = {"name": self.name, "constant": self.constant, "context": asdict(self.context), "imputation": asdict(self.imputation), "staged": self.stages is not None}
        SparkSession.active().createDataFrame([(json.dumps(state, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/state")
        if self.stages is not None:
            self.stages.write().overwrite().save(f"{path}/stages")

    @staticmethod
    def load(spark: SparkSession, path: str) -> PriceModel:
        state = json.loads(spark.read.text(f"{path}/state").first()[0])
        context, filled = state["context"], state["imputation"]
        stages = PipelineModel.load(f"{path}/stages") if state["staged"] else None
        return PriceModel(
            state["name"], FeatureContext(**context | {"centre": tuple(context["centre"])}), Imputation(**filled | {"with_indicator": tuple(filled["with_indicator"])}), stages, state["constant"]
        )


@dataclass(frozen=True)
class Prepared:
    """What all candidates learn from: the features, price and label of training rows, written once, and their statistics."""

    context: FeatureContext
    frame: DataFrame
    imputation: Imputation


def prepare(train: DataFrame) -> Prepared:
    """The context and all statistics come from train alone."""
    context = FeatureContext.fit(train)
    frame = materialise(feature_frame(train, context, keep=["price"]).withColumn("label", F.log1p("price")))
    return Prepared(context, frame, Imputation.fit(frame))


def fit(name: str, train: DataFrame, trees: int = TREES, depth: int = DEPTH) -> PriceModel:
    """Learn log1p(price) from train."""
    return learn(name, prepare(train), trees, depth)


def learn(name: str, prepared: Prepared, trees: int = TREES, depth: int = DEPTH) -> PriceModel:
    context, frame, imputation = prepared.context, prepared.frame, prepared.imputation
    if name == "naive_median":
        return PriceModel(name, context, imputation, None, float(frame.agg(F.median("label")).first()[0]))
    ready = imputation.apply(frame, name == "ridge_linear")
    index = StringIndexer(inputCols=[f"k_{c}" for c in C.CATEGORICAL_FEATURES], outputCols=[f"j_{c}" for c in C.CATEGORICAL_FEATURES], handleInvalid="keep", stringOrderType="alphabetAsc")
    hot = OneHotEncoder(inputCols=index.getOutputCols(), outputCols=[f"h_{c}" for c in C.CATEGORICAL_FEATURES], dropLast=True)
    vector = VectorAssembler(inputCols=imputation.inputs + hot.getOutputCols(), outputCol="vector")
    if name == "ridge_linear":
        stats = frame.agg(F.count("*").alias("n"), F.stddev_pop("label").alias("s")).first()
        learner = LinearRegression(featuresCol="vector", labelCol="label", predictionCol="log_prediction", solver="normal", elasticNetParam=0.0, standardization=False, regParam=RIDGE_ALPHA / stats["n"] * (stats["s"] or 1.0))
    elif name == "forest":
        learner = RandomForestRegressor(featuresCol="vector", labelCol="label", predictionCol="log_prediction", numTrees=trees, maxDepth=depth, minInstancesPerNode=LEAST_IN_LEAF, featureSubsetStrategy="0.8", bootstrap=False, seed=42)
    else:
        raise ValueError(f"unknown candidate {name}")
    return PriceModel(name, context, imputation, Pipeline(stages=[index, hot, vector, learner]).fit(ready))


def select(train: DataFrame, validation: DataFrame, candidates: tuple[str, ...] = CANDIDATES, trees: int = TREES, depth: int = DEPTH) -> tuple[str, DataFrame]:
    """The candidate with the least validation error, the first of equals, and all candidates' metrics."""
    table, scores = None, {}
    prepared = prepare(train)
    asked = materialise(feature_frame(validation, prepared.context, keep=["price"]))
    for i, name in enumerate(candidates):
        model = learn(name, prepared, trees, depth)
        one = metrics.regression_metrics(model.predict_frame(asked)).withColumns({"candidate": F.lit(name), "place": F.lit(i)})
        scores[name] = one.first()["mae"]
        table = one if table is None else table.unionByName(one)
    return min(candidates, key=lambda c: (scores[c], candidates.index(c))), table


def residuals(model: PriceModel, rows: DataFrame) -> DataFrame:
    return model.predict(rows, ["price"]).select(F.abs(F.log1p("price") - F.log1p("prediction")).alias("residual"))


def contributions(model: PriceModel, rows: DataFrame, keep: list[str], top: int = 5) -> DataFrame:
    """keep and the largest contributions coefficient x (value - mean) of a linear model, by size."""
    if model.name != "ridge_linear":
        raise ValueError("contributions need the linear model")
    lr, vector = model.stages.stages[-1], model.stages.stages[-2]
    levels = model.stages.stages[0].labelsArray
    names = [c[2:] for c in model.imputation.inputs] + [f"{c}={v}" for c, ls in zip(C.CATEGORICAL_FEATURES, levels, strict=True) for v in ls]
    assert vector.getOutputCol() == "vector" and len(names) == len(lr.coefficients)
    frame = model.imputation.apply(feature_frame(rows, model.context, keep=keep), True)
    made = model.stages.transform(frame).select(*keep, vector_to_array("vector").alias("v"))
    each = F.transform(F.arrays_zip(F.lit(names).alias("n"), F.lit([float(c) for c in lr.coefficients]).alias("c"), F.col("v").alias("x")), lambda z: F.struct((-F.abs(z["c"] * z["x"])).alias("order"), z["n"].alias("feature"), (z["c"] * z["x"]).alias("contribution")))
    best = F.transform(F.slice(F.array_sort(each), 1, top), lambda z: F.struct(z["feature"].alias("feature"), z["contribution"].alias("contribution")))
    return made.select(*keep, best.alias("contributions"))
