"""Training, evaluation, uncertainty and scoring of sale prices."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import ModelConfig
from tidemark.operators.features import CATEGORICAL, EXAMPLE, NUMERIC, encode, features_at, fit_encoder


def baseline(examples: DataFrame) -> DataFrame:
    """A predictor without a model: the last sale's average, else the month's, else the current price."""
    return examples.select("*", F.coalesce("previous_sale_price", "avg_30d", "current_price").alias("predicted"), (F.col("target_paise2") / 200.0).alias("actual"))


def evaluate(scored: DataFrame, by: str = "split") -> DataFrame:
    error = F.col("predicted") - F.col("actual")
    return scored.groupBy(by).agg(F.count("*").alias("examples"), F.round(F.avg(F.abs(error)), 4).alias("mae"), F.round(F.sqrt(F.avg(error * error)), 4).alias("rmse"))


def fit_uncertainty(scored: DataFrame, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """One row: exact residual percentiles, then the share of rows inside them, with RMSE, MAE and mean target."""
    residual = F.col("actual") - F.col("predicted")
    bounds = scored.agg(F.percentile(residual, F.lit(low)).alias("p_low"), F.percentile(residual, F.lit(high)).alias("p_high"))
    inside = (residual >= F.col("p_low") - 1e-9) & (residual <= F.col("p_high") + 1e-9)  # a bound may be a residual itself
    return scored.join(bounds).agg(
        F.first("p_low").alias("p_low"), F.first("p_high").alias("p_high"), F.avg(inside.cast("double")).alias("coverage"),
        F.sqrt(F.avg(residual * residual)).alias("rmse"), F.avg(F.abs(residual)).alias("mae"), F.avg("actual").alias("mean_target"),
    )


def intervals(scored: DataFrame, uncertainty: DataFrame) -> DataFrame:
    """Bounds and confidence of every prediction; uncertainty has one row."""
    rows = scored.join(uncertainty)
    lower = F.greatest(F.lit(0.0), F.col("predicted") + F.col("p_low"))
    upper = F.greatest(lower, F.col("predicted") + F.col("p_high"))
    relative = F.when(F.col("mean_target") > 0, F.col("rmse") / F.col("mean_target")).otherwise(0.0)
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    confidence = unit(unit(F.col("coverage")) * unit(F.col("completeness")) / (1.0 + relative))
    return rows.select(*scored.columns, F.round(lower, 4).alias("lower"), F.round(upper, 4).alias("upper"), F.round(confidence, 6).alias("confidence"))


def _assembled(examples: DataFrame):
    """Features as a vector: nulls become 0 with a flag beside them, as trees here don't split on missing values."""
    from pyspark.ml.feature import VectorAssembler

    names = [*NUMERIC, *(f"cat_{c}" for c in CATEGORICAL)]
    filled = examples.select("*", *(F.coalesce(F.col(c), F.lit(0.0)).cast("double").alias(f"_{c}") for c in names), *(F.col(c).isNull().cast("double").alias(f"_no_{c}") for c in names))
    inputs = [f"_{c}" for c in names] + [f"_no_{c}" for c in names]
    return VectorAssembler(inputCols=inputs, outputCol="_features").transform(filled).drop(*inputs)


def train(split: DataFrame, c: ModelConfig = ModelConfig()):
    """(model, codes): boosted trees on train, stopped early on validation; the encoder sees train only. None if a split is too small."""
    from pyspark.ml.regression import GBTRegressor

    sizes = {r.split: r["count"] for r in split.groupBy("split").count().collect()}  # three rows
    if sizes.get("train", 0) < c.min_train or sizes.get("validation", 0) < c.min_validation or sizes.get("test", 0) < c.min_test:
        return None
    codes = fit_encoder(split.where("split = 'train'"))
    rows = _assembled(encode(split.where("split <> 'test'"), codes)).select(*EXAMPLE, "_features", (F.col("target_paise2") / 200.0).alias("_label"), (F.col("split") == "validation").alias("_held"))
    gbt = GBTRegressor(featuresCol="_features", labelCol="_label", predictionCol="predicted", validationIndicatorCol="_held", maxDepth=c.depth, maxIter=c.rounds, stepSize=c.rate, subsamplingRate=0.8, seed=c.seed)
    return gbt.fit(rows.repartition(*EXAMPLE).sortWithinPartitions(*EXAMPLE)), codes  # the same rows in the same places, whatever came before


def score(model, codes: DataFrame, examples: DataFrame) -> DataFrame:
    done = model.transform(_assembled(encode(examples, codes)))
    return done.select(*examples.columns, F.greatest(F.lit(0.0), F.col("predicted")).alias("predicted"))


def save(model, codes: DataFrame, root: str, version: str, notes: dict) -> None:
    """A version folder with model, codes and notes, and a pointer to the latest; all written by Spark."""
    spark = codes.sparkSession
    model.write().overwrite().save(f"{root}/{version}/model")
    codes.write.mode("overwrite").parquet(f"{root}/{version}/codes")
    one = lambda text, path: spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    one(json.dumps(notes | {"version": version, "features": NUMERIC + CATEGORICAL}, sort_keys=True), f"{root}/{version}/metadata")
    one(version, f"{root}/latest")


def load_latest(spark, root: str):
    from pyspark.ml.regression import GBTRegressionModel

    version = spark.read.text(f"{root}/latest").first()[0]
    return version, GBTRegressionModel.load(f"{root}/{version}/model"), spark.read.parquet(f"{root}/{version}/codes")


def batch_scores(points: DataFrame, events: DataFrame, at: Column, predict: Callable[[DataFrame], DataFrame], uncertainty: DataFrame) -> DataFrame:
    """scores in the order of (variant, retailer, seller)."""
    return scores(points, events, at, predict, uncertainty).orderBy("product_id", "retailer_id", F.col("seller_id").asc_nulls_first(), "listing_id")


def scores(points: DataFrame, events: DataFrame, at: Column, predict: Callable[[DataFrame], DataFrame], uncertainty: DataFrame) -> DataFrame:
    """A prediction, or the reason why there is none, for every series at a time.

    predict adds `predicted` to a feature table and keeps its other columns; uncertainty has one row, without bounds where nothing was trained.
    A price is never made up: a series without a qualifying row known before the time has no current price, and without bounds nothing is predicted.
    """
    predicted = F.when(F.col("seen_n") > 0, F.greatest(F.lit(0.0), F.col("predicted")))
    rows = intervals(predict(features_at(points, events, at)).withColumn("predicted", predicted), uncertainty)
    rows = rows.join(uncertainty.select(F.col("p_low").isNotNull().alias("_trained")))
    known = F.col("predicted").isNotNull() & F.col("_trained")
    paise = lambda c: F.when(known, F.round(F.col(c) * 100).cast("long"))
    return rows.select(
        F.col("_product").alias("product_id"), F.col("_retailer").alias("retailer_id"), F.col("_seller").alias("seller_id"), F.col("_listing").alias("listing_id"), F.when(known, "PREDICTED").otherwise("INSUFFICIENT_DATA").alias("status"),
        F.when(~F.col("_trained"), "no_trained_model").when(F.col("predicted").isNull(), "no_current_price").alias("reason"),
        paise("predicted").alias("predicted_paise"), paise("lower").alias("lower_paise"), paise("upper").alias("upper_paise"), F.when(known, F.col("confidence")).alias("confidence"),
    )
