"""The fitted matcher of parcel pairs: training, probabilities, calibration, cross-validation.

Frames hold the columns FEATURES (null counts as 0), `y` (0 or 1) and a key to split by.
"""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed order of the features.
FEATURES = (
    "centroid_distance", "boundary_distance", "iou", "intersection_area", "area_ratio", "perimeter_ratio", "shape_similarity",
    "orientation_similarity", "attribute_similarity", "gnss_support", "building_support",
)


def _uniform(seed: int, name: str):
    return F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(name)), F.lit(1 << 30)) / float(1 << 30)


def synthetic_pairs(spark: SparkSession, n: int = 1000, seed: int = 42) -> DataFrame:
    """Pairs with uniform features; near and overlapping ones are matches, with noise at the border."""
    size = {"centroid_distance": 50.0, "boundary_distance": 30.0, "intersection_area": 1200.0}
    rows = spark.range(n).select("id", *((_uniform(seed, f) * size.get(f, 1.0)).alias(f) for f in FEATURES), _uniform(seed, "noise").alias("u"))
    score = 0.4 * F.col("iou") - 0.3 * F.col("centroid_distance") / 50 + 0.15 * F.col("area_ratio") + 0.15 * F.col("attribute_similarity")
    return rows.withColumn("y", (score > 0.1 + 0.3 * F.col("u")).cast("int")).drop("u")


def with_part(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """`part`: train, calibrate or test for 60, 20 and 20 of 100 keys."""
    u = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(100))
    return rows.withColumn("part", F.when(u < 60, "train").when(u < 80, "calibrate").otherwise("test"))


def _balanced(rows: DataFrame) -> tuple[DataFrame, int]:
    n = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if set(n) != {0, 1}:
        raise ValueError("training needs rows of both labels, 0 and 1")
    total = n[0] + n[1]
    return rows.withColumn("__weight", F.when(F.col("y") == 1, total / (2.0 * n[1])).otherwise(total / (2.0 * n[0]))), total


def _vector(rows: DataFrame) -> DataFrame:
    return rows.withColumns({f"__{f}": F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in FEATURES})


def _stages(last) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=[f"__{f}" for f in FEATURES], outputCol="__raw"), StandardScaler(inputCol="__raw", outputCol="__x", withMean=True), last])


def fit(rows: DataFrame) -> PipelineModel:
    """Logistic regression on standardised features; labels weigh alike, unit penalty on the weights."""
    weighted, n = _balanced(rows.dropna(subset=["y"]))
    last = LogisticRegression(featuresCol="__x", labelCol="y", weightCol="__weight", probabilityCol="__probability", rawPredictionCol="__margin", predictionCol="__class", maxIter=1000, regParam=1.0 / n, standardization=False)
    return _stages(last).fit(_vector(weighted))


def plain_weights(model: PipelineModel, names: tuple[str, ...]) -> tuple[dict[str, float], float]:
    """The weights of some features, and the intercept, for features as they are instead of standardised ones."""
    scaler, last = model.stages[1], model.stages[2]
    per = {f: (w / s if s else 0.0, m) for f, w, s, m in zip(FEATURES, last.coefficients.toArray().tolist(), scaler.std.toArray().tolist(), scaler.mean.toArray().tolist(), strict=True)}
    return {f: per[f][0] for f in names}, last.intercept - sum(w * m for w, m in per.values())


def fit_boosted(rows: DataFrame, trees: int = 200) -> PipelineModel:
    weighted, _ = _balanced(rows.dropna(subset=["y"]))
    last = GBTClassifier(featuresCol="__x", labelCol="y", weightCol="__weight", predictionCol="__class", maxIter=trees, stepSize=0.1, maxDepth=5, seed=42)
    last = last.setProbabilityCol("__probability").setRawPredictionCol("__margin")
    return _stages(last).fit(_vector(weighted))


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """The rows with `p`, the probability of a match."""
    scored = model.transform(_vector(rows)).withColumn("p", vector_to_array("__probability")[1])
    return scored.select(*rows.columns, "p")


def linear_score(rows: DataFrame, weights: dict[str, float], intercept: float) -> DataFrame:
    """`p` of a regression with given weights, four digits: a fitted model's, kept as plain numbers."""
    z = sum((F.coalesce(F.col(f).cast("double"), F.lit(0.0)) * w for f, w in weights.items()), F.lit(intercept))
    return rows.withColumn("p", F.round(1 / (1 + F.exp(-z)), 4))


def save(model: PipelineModel, path: str) -> None:
    """Written over what lies there."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def importances(model: PipelineModel) -> list[tuple[str, float]]:
    return list(zip(FEATURES, map(float, model.stages[-1].coefficients), strict=True))


def log_loss(scored: DataFrame) -> float:
    p = F.greatest(F.least(F.col("p"), F.lit(1 - 1e-15)), F.lit(1e-15))
    return scored.agg(F.avg(F.when(F.col("y") == 1, -F.log(p)).otherwise(-F.log(1 - p)))).first()[0]


def cross_validate(rows: DataFrame, key: str, folds: int = 5, fitter=fit) -> list[float]:
    """Log loss of each fold; folds come from a hash of key and label, so no label gathers in one task.

    Folds are fitted side by side, as a fit is a long row of short jobs, each over all partitions of the rows.
    """
    dealt = rows.withColumn("__fold", F.pmod(F.xxhash64(F.col(key), F.col("y")), F.lit(folds)))

    @inheritable_thread_target(rows.sparkSession)
    def loss(k: int) -> float:
        return log_loss(predict(fitter(dealt.where(F.col("__fold") != k)), dealt.where(F.col("__fold") == k)))

    with ThreadPool(folds) as pool:
        return pool.map(loss, range(folds))


def choose(rows: DataFrame, key: str, trees: int = 200) -> tuple[str, PipelineModel]:
    """Boosted trees where their loss is below 0.95 of the regression's, else the regression."""
    plain, trees_loss = (sum(cross_validate(rows, key, fitter=f)) for f in (fit, lambda d: fit_boosted(d, trees)))
    return ("boosted", fit_boosted(rows, trees)) if trees_loss < 0.95 * plain else ("logistic", fit(rows))


def calibrate(scored: DataFrame, method: str = "platt"):
    """A function that adds `calibrated` to rows with `p`, fitted on p and y."""
    if method not in ("platt", "isotonic"):
        raise ValueError(f"unknown calibration: {method}")
    column = VectorAssembler(inputCols=["p"], outputCol="__s")
    data = column.transform(scored.select("p", F.col("y").cast("double").alias("y")).dropna())
    if method == "platt":
        model = LogisticRegression(featuresCol="__s", labelCol="y", probabilityCol="__q", rawPredictionCol="__m", predictionCol="__c").fit(data)
        value = vector_to_array("__q")[1]
    else:
        model = IsotonicRegression(featuresCol="__s", labelCol="y", predictionCol="__q").fit(data)
        value = F.col("__q")
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
    return lambda rows: model.transform(column.transform(rows)).withColumn("calibrated", clipped).select(*rows.columns, "calibrated")
