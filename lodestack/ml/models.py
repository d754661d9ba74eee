"""Models of the payment reduction: baselines, ridge, boosted trees, and an additive model of binned features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.feature import Bucketizer, Imputer, OneHotEncoder, QuantileDiscretizer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.ml.roles import feature_types
from lodestack.operators.relations import shifted

SCORE = "score"


def training_mean(train: DataFrame, test: DataFrame, target: str) -> DataFrame:
    """The same score for everyone."""
    return test.crossJoin(F.broadcast(train.agg(F.avg(target).alias(SCORE))))


def earlier_value(table: DataFrame, test: DataFrame, years: int, target: str, fill: Column, key: str = "facility_id", year: str = "fiscal_year") -> DataFrame:
    """A hospital's own value so many years earlier; ``fill`` where there is none."""
    past = table.select(key, year, F.col(target).alias(SCORE))
    past = shifted(past, year, years, lambda c: F.substring(c, 3, 4).cast("int"), lambda c: F.concat(F.lit("FY"), c.cast("string")))
    return test.join(past, [key, year], "left").withColumn(SCORE, F.coalesce(SCORE, fill))


def _prepared(df: DataFrame, numbers: Sequence[str], texts: Sequence[str]) -> DataFrame:
    """Numbers as doubles beside a flag for missing ones; missing texts as a level of their own."""
    plain = {f"n_{c}": F.col(c).cast("double") for c in numbers}
    missing = {f"m_{c}": F.col(c).isNull().cast("double") for c in numbers}
    return df.withColumns({**plain, **missing, **{f"t_{c}": F.coalesce(c, F.lit("(missing)")) for c in texts}})


@dataclass
class Fitted:
    """A pipeline with the columns that it reads. Categories it has not seen count as none."""

    pipeline: PipelineModel
    numbers: list[str]
    texts: list[str]
    family: str

    def score(self, df: DataFrame) -> DataFrame:
        helpers = [f"{p}_{c}" for p, cs in (("n", self.numbers), ("m", self.numbers), ("t", self.texts)) for c in cs]
        scored = self.pipeline.transform(_prepared(df, self.numbers, self.texts))
        return scored.select(*df.columns, F.col("prediction").alias(SCORE)) if helpers else scored

    @property
    def last(self) -> Model:
        return self.pipeline.stages[-1]


def _stages(numbers: Sequence[str], texts: Sequence[str]) -> tuple[list, list[str]]:
    """Median imputation and one-hot codes; the vector's inputs."""
    stages: list = []
    if numbers:
        stages.append(Imputer(strategy="median", inputCols=[f"n_{c}" for c in numbers], outputCols=[f"i_{c}" for c in numbers]))
    for c in texts:
        stages += [StringIndexer(inputCol=f"t_{c}", outputCol=f"x_{c}", handleInvalid="keep"), OneHotEncoder(inputCol=f"x_{c}", outputCol=f"o_{c}", handleInvalid="keep")]
    return stages, [*(f"i_{c}" for c in numbers), *(f"m_{c}" for c in numbers), *(f"o_{c}" for c in texts)]


def _usable(df: DataFrame, numbers: Sequence[str]) -> list[str]:
    """Numbers with any value; a median needs one."""
    if not numbers:
        return []
    row = df.agg(*[F.count(c).alias(c) for c in numbers]).first()
    return [c for c in numbers if row[c]]


def fit_ridge(train: DataFrame, features: Sequence[str], target: str, alpha: float = 100.0) -> Fitted:
    """Linear model with a squared penalty. Spark scales its objective by rows and by the target's deviation, so the penalty of a sum of squares is
    ``alpha / n * sd``."""
    numbers, texts = feature_types(train, features)
    numbers = _usable(train, numbers)
    stages, inputs = _stages(numbers, texts)
    row = train.agg(F.count(target).alias("n"), F.stddev_pop(target).alias("sd")).first()
    stages += [
        VectorAssembler(inputCols=inputs, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True),
        LinearRegression(labelCol=target, featuresCol="features", elasticNetParam=0.0, regParam=alpha / max(1, row["n"]) * (row["sd"] or 1.0), standardization=False),
    ]
    return Fitted(Pipeline(stages=stages).fit(_prepared(train, numbers, texts)), numbers, texts, "ridge")


def fit_trees(train: DataFrame, features: Sequence[str], target: str, trees: int = 60, depth: int = 4, step: float = 0.1, least: int = 20, seed: int = 0) -> Fitted:
    """Boosted trees on four fifths of the rows and features each."""
    numbers, texts = feature_types(train, features)
    numbers = _usable(train, numbers)
    stages, inputs = _stages(numbers, texts)
    stages += [
        VectorAssembler(inputCols=inputs, outputCol="features"),
        GBTRegressor(labelCol=target, featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=step, subsamplingRate=0.8, featureSubsetStrategy="0.8", minInstancesPerNode=least, seed=seed),
    ]
    return Fitted(Pipeline(stages=stages).fit(_prepared(train, numbers, texts)), numbers, texts, "trees")


def fit_additive(train: DataFrame, features: Sequence[str], target: str, bins: int = 16, alpha: float = 20.0) -> Fitted:
    """A sum of one step function per feature: each is cut into bins of equal size, whose effects are fitted together. It can be
    read like an explainable boosting machine without pairs."""
    numbers, texts = feature_types(train, features)
    numbers = _usable(train, numbers)
    stages, _ = _stages(numbers, texts)
    binned: list[str] = []
    ready = _prepared(train, numbers, texts)
    imputed = Pipeline(stages=stages).fit(ready)
    seen = imputed.transform(ready)
    for c in numbers:
        cut = QuantileDiscretizer(numBuckets=bins, inputCol=f"i_{c}", outputCol=f"b_{c}", handleInvalid="keep").fit(seen)
        if len(cut.getSplits()) > 2:
            stages += [Bucketizer(splits=cut.getSplits(), inputCol=f"i_{c}", outputCol=f"b_{c}", handleInvalid="keep"), OneHotEncoder(inputCol=f"b_{c}", outputCol=f"h_{c}", dropLast=False, handleInvalid="keep")]
            binned.append(f"h_{c}")
    n = train.count()
    stages += [
        VectorAssembler(inputCols=[*binned, *(f"m_{c}" for c in numbers), *(f"o_{c}" for c in texts)], outputCol="features"),
        LinearRegression(labelCol=target, featuresCol="features", elasticNetParam=0.0, regParam=alpha / max(1, n), standardization=False),
    ]
    return Fitted(Pipeline(stages=stages).fit(ready), numbers, texts, "additive")


def coefficients(model: Fitted, df: DataFrame) -> list[tuple[str, float]]:
    """Names and effects of a linear model, the largest first."""
    attrs = model.pipeline.transform(_prepared(df, model.numbers, model.texts)).schema["raw"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a.get("name", str(a["idx"])) for group in attrs.values() for a in group}
    pairs = [(names.get(i, str(i)), float(v)) for i, v in enumerate(model.last.coefficients)]
    return sorted(pairs, key=lambda p: -abs(p[1]))


def contributions(model: Fitted, df: DataFrame) -> DataFrame:
    """``df`` with ``base`` and ``parts``, what each input adds to a linear model's score: they sum up to the score."""
    weights = [float(w) for w in model.last.coefficients]
    scored = model.pipeline.transform(_prepared(df, model.numbers, model.texts))
    from pyspark.ml.functions import vector_to_array

    parts = F.zip_with(vector_to_array("features"), F.array(*[F.lit(w) for w in weights]), lambda x, w: x * w)
    return scored.select(*df.columns, F.lit(float(model.last.intercept)).alias("base"), parts.alias("parts"), F.col("prediction").alias(SCORE))
