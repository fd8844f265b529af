"""Time-safe splits and models over feature tables, with MLlib."""

from __future__ import annotations

import hashlib
import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def at_position(values: DataFrame, name: str, place: int, buckets: int = 1024) -> int | None:
    """The value of a whole-number column that stands at a place (from 0) in ascending order; NULLs take no place.

    The range is cut into buckets, which are counted, and the one that holds the place is cut again: the driver sees
    some hundred counts a round, and nothing is sorted.
    """
    low, high, count = values.agg(F.min(name), F.max(name), F.count(name)).first()
    if not 0 <= place < count:
        return None
    while low < high:
        step = max(1, -(-(high - low + 1) // buckets))
        bucket = F.expr(f"(`{name}` - {low}) div {step}")
        counts = {r.b: r.n for r in values.where(F.col(name).between(low, high)).groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect()}
        for b in sorted(counts):
            if place < counts[b]:
                low, high = low + b * step, min(high, low + (b + 1) * step - 1)
                break
            place -= counts[b]
    return int(low)


def time_split(rows: DataFrame, time: str, purge_seconds: int, train: float = 0.8, holdout: str | None = None, order: str | None = None) -> DataFrame:
    """``rows`` with ``split``: of the rows in order of time (and of the whole-number column ``order``), the first part is
    ``train``, the rest ``val``; from the time ``holdout`` on it is ``holdout``. Rows whose outcome could still be open at
    the next split's start are ``purged``, before the parts are counted off for the holdout's and after it for val's.
    Without ``order``, all rows of the moment at which val starts belong to it."""
    at, purge = F.unix_micros(F.col(time).cast("timestamp")), purge_seconds * 1_000_000
    cut = F.unix_micros(F.lit(holdout).cast("timestamp")) if holdout else None
    inner = rows.where(at < cut - purge) if cut is not None else rows
    moments = inner.select(at.alias("at"), (F.col(order) if order else F.lit(0)).cast("long").alias("order"))
    place = int(moments.where("at is not null").count() * train)
    start = at_position(moments, "at", place)
    split = F.when(at.isNull(), None)
    if cut is not None:
        split = split.when(at >= cut, "holdout").when(at >= cut - purge, "purged")
    if start is None:  # nothing is left for val
        return rows.withColumn("split", split.otherwise("train"))
    early = at < start
    if order:
        first = at_position(moments.where(F.col("at") == start), "order", place - moments.where(F.col("at") < start).count())
        early = early | ((at == start) & (F.col(order).cast("long") < first))
    return rows.withColumn("split", split.when(at < start - purge, "train").when(early, "purged").otherwise("val"))


def _stages(features: list[str]) -> list:
    return [Imputer(inputCols=features, outputCols=[f"_{f}" for f in features]), VectorAssembler(inputCols=[f"_{f}" for f in features], outputCol="_features")]


def train_trees(rows: DataFrame, features: list[str], label: str, objective: str = "binary", rounds: int = 50, depth: int = 4, seed: int = 42) -> PipelineModel:
    """Boosted trees on the ``train`` rows, stopped early on the ``val`` rows; missing features take their mean."""
    usable = rows.where(F.col("split").isin("train", "val") & F.col(label).isNotNull()).withColumn("_val", F.col("split") == "val").withColumns({f: F.col(f).cast("double") for f in features})
    kind = GBTClassifier if objective == "binary" else GBTRegressor
    trees = kind(featuresCol="_features", labelCol=label, maxIter=rounds, maxDepth=depth, seed=seed, validationIndicatorCol="_val")
    return Pipeline(stages=[*_stages(features), trees]).fit(usable)


def train_baseline(rows: DataFrame, feature: str, label: str) -> PipelineModel:
    """A logistic regression on one scaled feature."""
    usable = rows.where((F.col("split") == "train") & F.col(label).isNotNull() & F.col(feature).isNotNull())
    return Pipeline(stages=[VectorAssembler(inputCols=[feature], outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_features", withMean=True), LogisticRegression(featuresCol="_features", labelCol=label)]).fit(usable)


def scored(model: PipelineModel, rows: DataFrame, into: str = "score") -> DataFrame:
    """``rows`` with the model's probability of label 1, or its prediction if it is a regression."""
    out = model.transform(rows)
    value = vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")
    return out.withColumn(into, value).select(*rows.columns, into)


def calibrated(rows: DataFrame, score: str, label: str) -> tuple:
    """An isotonic fit of label on score: (model, a function that adds ``calibrated``)."""
    model = IsotonicRegression(featuresCol=score, labelCol=label).fit(rows.select(F.col(score).cast("double").alias(score), F.col(label).cast("double").alias(label)))
    return model, lambda df: model.transform(df).withColumnRenamed("prediction", "calibrated")


def threshold(rows: DataFrame, score: str, quantile: float = 0.9) -> float:
    """The exact quantile of the validation scores, between neighbours by linear interpolation."""
    return rows.where("split = 'val'").agg(F.percentile(score, F.lit(quantile))).first()[0]


def freeze(model: PipelineModel, folder: str, features: list[str], limit: float, rows: DataFrame) -> dict:
    """Save the model and, beside it, its features, threshold and a fingerprint of the rows that it was fitted on."""
    model.write().overwrite().save(f"{folder}/model")
    about = {"features": features, "threshold": limit, "rows": fingerprint(rows, features)}
    rows.sparkSession.createDataFrame([(json.dumps(about, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/about")
    return about


def thaw(spark, folder: str, features: list[str]) -> tuple[PipelineModel, dict]:
    """A frozen model; raises if its features aren't those named."""
    about = json.loads(spark.read.text(f"{folder}/about").first().value)
    if about["features"] != list(features):
        raise ValueError("the model was fitted on other features")
    return PipelineModel.load(f"{folder}/model"), about


def fingerprint(rows: DataFrame, columns: list[str]) -> str:
    """A hash of a table's rows, whatever their order."""
    n, x, s = rows.agg(F.count("*"), F.bit_xor(F.xxhash64(*columns)), F.sum(F.xxhash64(*columns).cast("decimal(20,0)"))).first()
    return hashlib.sha256(f"{n}:{x}:{s}".encode()).hexdigest()


def walk_forward(rows: DataFrame, time: str, periods: int = 3) -> DataFrame:
    """``rows`` with ``period``, from 0, of equal numbers of rows by time; train on those before, judge on each."""
    edges = rows.agg(F.percentile(F.unix_seconds(F.col(time).cast("timestamp")), F.array(*(F.lit(k / periods) for k in range(1, periods))))).first()[0] or []
    at = F.unix_seconds(F.col(time).cast("timestamp"))
    return rows.withColumn("period", sum(((at >= F.lit(e)).cast("int") for e in edges), F.lit(0)))


def recency_weight(time: Column, now: Column, half_life_days: float = 60.0) -> Column:
    return F.exp(-F.log(F.lit(2.0)) * (F.unix_seconds(now) - F.unix_seconds(time)) / (86400.0 * half_life_days))


def best_stump(rows: DataFrame, features: list[str], label: str, levels: int = 9) -> DataFrame:
    """One row: the feature, direction and threshold (of the positives' quantiles) of the greatest Youden index."""
    long = rows.where(F.col(label).isNotNull()).select(F.col(label).cast("int").alias("y"), F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features))).alias("f")).select("y", "f.*").where("x is not null")
    cuts = long.where("y = 1").groupBy("feature").agg(F.explode(F.percentile("x", F.array(*(F.lit((k + 1) / (levels + 1)) for k in range(levels))))).alias("cut"))
    met = long.join(cuts, "feature").groupBy("feature", "cut").agg(*(F.avg(F.when(F.col("y") == y, (F.col("x") <= F.col("cut")).cast("double"))).alias(f"below{y}") for y in (0, 1)))
    both = met.select("feature", "cut", F.explode(F.array(F.struct(F.lit("<=").alias("op"), (F.col("below1") - F.col("below0")).alias("j")), F.struct(F.lit(">=").alias("op"), (F.col("below0") - F.col("below1")).alias("j")))).alias("x")).select("feature", "cut", "x.*")
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("j"), "feature", "cut", "op")
    return both.where("j is not null").withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
