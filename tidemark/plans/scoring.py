"""Forecast jobs: lag features, models, and batch scoring with keys kept in the row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import series as S
from tidemark.session import materialise


MAX_ITERATIONS = 1000

def lag_features(series: DataFrame, lags: int, value: str = "close", order: str = "trade_date") -> DataFrame:
    """The last ``lags`` values of each series next to its current one; the first rows drop out."""
    w = Window.partitionBy("code").orderBy(order)
    columns = [F.lag(value, i).over(w).cast("double").alias(f"lag_{i}") for i in range(1, lags + 1)]
    out = series.select("code", order, F.col(value).cast("double").alias(value), *columns)
    return out.where(F.col(f"lag_{lags}").isNotNull())


def fit_growth(features: DataFrame, inputs: Sequence[str], target: str) -> PipelineModel:
    """Linear regression on lag features; solved by one pass of normal equations."""
    assembler = VectorAssembler(inputCols=list(inputs), outputCol="features")
    model = LinearRegression(featuresCol="features", labelCol=target, predictionCol="predicted", solver="normal")
    return Pipeline(stages=[assembler, model]).fit(features)


def score(model: Transformer, features: DataFrame, keys: Sequence[str], outputs: Sequence[str]) -> DataFrame:
    """Predictions with their keys; rows with a missing input are left out."""
    return model.transform(features.na.drop("any")).select(*keys, *outputs)


def direction_table(segments: DataFrame) -> DataFrame:
    """Segments with the previous one's measures as features and their own direction as label."""
    w = Window.partitionBy("code").orderBy("start_record_id")
    before = {f"prev_{m}": F.lag(m).over(w).cast("double") for m in ("calendar_days", "trading_days", "change_rate")}
    rising = (F.col("direction") == S.UP).cast("double")
    return (
        segments.withColumns(before)
        .withColumn("rising", rising)
        .withColumn("prev_rising", F.lag(rising).over(w))
        .where(F.col("prev_rising").isNotNull())
    )


DIRECTION_INPUTS = ["prev_calendar_days", "prev_trading_days", "prev_change_rate", "prev_rising"]


def trend_direction(segments: DataFrame, weights: Sequence[float] = (1.0, 5.0, 1.0)) -> DataFrame:
    """Forecast of every segment's days, change and direction, with its weighted loss.

    Finished segments (train_flag 1) train the models, all are scored.  The features are stored
    first, since three fits and the scoring read them.  The loss is the weighted
    sum of both squared errors and the log loss of the direction.
    """
    table = direction_table(segments).select(
        "code", "start_record_id", "train_flag", F.col("trading_days").cast("double").alias("days"),
        F.col("change_rate").cast("double").alias("change"), "rising", *DIRECTION_INPUTS,
    )
    table = materialise(table, "direction-features")
    train = table.where(F.col("train_flag") == 1)
    stages = [
        VectorAssembler(inputCols=DIRECTION_INPUTS, outputCol="features"),
        LinearRegression(labelCol="days", predictionCol="days_hat", solver="normal"),
        LinearRegression(labelCol="change", predictionCol="change_hat", solver="normal"),
        LogisticRegression(labelCol="rising", predictionCol="rising_hat", probabilityCol="p", rawPredictionCol="raw", maxIter=MAX_ITERATIONS, tol=1e-9),
    ]
    from pyspark.ml.functions import vector_to_array

    fitted = Pipeline(stages=stages).fit(train)
    if fitted.stages[-1].summary.totalIterations >= MAX_ITERATIONS:
        raise RuntimeError("the direction model did not converge")
    scored = fitted.transform(table).withColumn("p_up", vector_to_array("p")[1])
    chance = F.when(F.col("rising") == 1, F.col("p_up")).otherwise(1 - F.col("p_up"))
    loss = (
        weights[0] * (F.col("days") - F.col("days_hat")) ** 2
        + weights[1] * (F.col("change") - F.col("change_hat")) ** 2
        + weights[2] * -F.log(F.greatest(chance, F.lit(1e-12)))
    )
    return scored.select(
        "code", "start_record_id", "train_flag", "days", "days_hat", "change", "change_hat", "rising", "rising_hat",
        loss.alias("loss"),
    )


# ---- one model per group ---------------------------------------------------------------


def fit_by_group(features: DataFrame, group: str, inputs: Sequence[str], target: str) -> DataFrame:
    """Least squares per group: (group, weights, intercept, n).

    One aggregate gathers means and covariances, which combine before the shuffle; a group's equations are then one row, solved there.  Inputs that
    depend on each other share their weight (least norm).
    """
    import numpy as np
    import pandas as pd

    rows = features.where(F.col(group).isNotNull()).na.drop("any", subset=[*inputs, target])
    columns = [*inputs, target]
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    sums = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(F.col(c).cast("double")) for c in columns]).alias("means"),
        F.array(*[F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")) for a, b in pairs]).alias("moments"),
    )
    k = len(inputs)

    def solve(batches):
        for batch in batches:
            weights, intercepts = [], []
            for means, moments in zip(batch["means"], batch["moments"]):
                square = np.zeros((k + 1, k + 1))
                square[np.triu_indices(k + 1)] = moments
                square = square + np.triu(square, 1).T
                w = np.linalg.lstsq(square[:k, :k], square[:k, k], rcond=None)[0]
                weights.append(w.tolist())
                intercepts.append(float(means[k] - w @ np.asarray(means[:k])))
            yield pd.DataFrame({group: batch[group], "weights": weights, "intercept": intercepts, "n": batch["n"]})

    kind = features.schema[group].dataType.simpleString()
    return sums.mapInPandas(solve, f"{group} {kind}, weights array<double>, intercept double, n long")


def score_by_group(models: DataFrame, features: DataFrame, group: str, inputs: Sequence[str], keys: Sequence[str], output: str = "predicted") -> DataFrame:
    """Predictions of each row's own group model; rows with a missing input, or of a group without a model, are left out."""
    values = F.zip_with("weights", F.array(*[F.col(c).cast("double") for c in inputs]), lambda w, x: w * x)
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    joined = features.na.drop("any", subset=list(inputs)).join(models, group)
    return joined.select(*keys, group, (F.col("intercept") + total).alias(output))
