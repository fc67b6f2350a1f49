"""Linear delay model: labels, fit, evaluation, gate and scoring.

Training never moves examples to the driver: each fit is one aggregate of fourteen sums,
and only the four-by-four system made of them is solved there.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbox.session import checkpointed

# fixed values
FEATURES = ("current_delay_s", "stops_remaining", "active_alert_flag")
EXCLUDED_STATUSES = ("cancelled", "undetermined_gap")
RIDGE = 1e-6
LAD_ITERATIONS = 15
MIN_RESIDUAL = 1.0


@dataclass(frozen=True)
class DelayModel:
    intercept: float
    weights: tuple[float, float, float]
    trained_at: str = ""


def labelable(completions: DataFrame) -> DataFrame:
    return completions.filter(~F.col("status").isin(*EXCLUDED_STATUSES) & F.col("delay_seconds").isNotNull())


def label_observations(observations: DataFrame, completions: DataFrame, order: Sequence[str]) -> DataFrame:
    """Join observations to the trip's final delay; a later completion of the same trip and day wins."""
    keys = ["trip_id", "service_date"]
    labels = labelable(completions).groupBy(*keys).agg(F.max_by("delay_seconds", F.struct(*order)).alias("final_delay_s"))
    return observations.join(labels, keys)


def mark_test_days(examples: DataFrame, test_days: int) -> DataFrame:
    """Add ``is_test``: the last ``test_days`` distinct service dates."""
    if test_days <= 0:
        return examples.withColumn("is_test", F.lit(False))
    days = examples.select("service_date").distinct().orderBy(F.desc("service_date")).limit(test_days)
    return examples.join(days.withColumn("is_test", F.lit(True)), "service_date", "left").withColumn(
        "is_test", F.coalesce("is_test", F.lit(False))
    )


def _terms() -> list[Column]:
    return [F.lit(1.0), *[F.col(f).cast("double") for f in FEATURES]]


def compact(examples: DataFrame) -> DataFrame:
    """Distinct examples with their multiplicity; all columns are small integers, so this shrinks a lot."""
    return examples.groupBy(*FEATURES, "final_delay_s").agg(F.count(F.lit(1)).cast("double").alias("n"))


def fit_linear(compacted: DataFrame, weight: Column | None = None) -> DelayModel:
    """Weighted least squares through the normal equations."""
    x, y = _terms(), F.col("final_delay_s").cast("double")
    w = F.col("n") if weight is None else F.col("n") * weight
    size = len(x)
    cells = [(i, j) for i in range(size) for j in range(i, size)]
    sums = [F.sum(w * x[i] * x[j]).alias(f"a{i}{j}") for i, j in cells] + [
        F.sum(w * x[i] * y).alias(f"b{i}") for i in range(size)
    ]
    row = compacted.agg(*sums).first()
    if row["a00"] is None:
        raise ValueError("no examples to fit")
    matrix = np.zeros((size, size))
    for i, j in cells:
        matrix[i, j] = matrix[j, i] = row[f"a{i}{j}"]
    beta = np.linalg.solve(matrix + RIDGE * np.eye(size), np.array([row[f"b{i}"] for i in range(size)]))
    return DelayModel(float(beta[0]), tuple(float(b) for b in beta[1:]))


def fit_least_absolute(
    examples: DataFrame, iterations: int = LAD_ITERATIONS, min_residual: float = MIN_RESIDUAL
) -> DelayModel:
    """Median-seeking fit: repeated weighted fits with weights one over the last residual."""
    return _least_absolute(checkpointed(compact(examples)), iterations, min_residual)


def _least_absolute(data: DataFrame, iterations: int = LAD_ITERATIONS, min_residual: float = MIN_RESIDUAL) -> DelayModel:
    """The fit over stored compact examples."""
    model = fit_linear(data)
    for _ in range(iterations):
        residual = F.abs(F.col("final_delay_s") - prediction(model))
        model = fit_linear(data, 1.0 / F.greatest(residual, F.lit(min_residual)))
    return model


def prediction(model: DelayModel) -> Column:
    out = F.lit(model.intercept)
    for weight, term in zip(model.weights, _terms()[1:]):
        out = out + F.lit(weight) * term
    return out


def baseline() -> Column:
    """The delay holds unchanged to the terminus."""
    return F.col("current_delay_s").cast("double")


def evaluate(model: DelayModel, examples: DataFrame, weight: Column | None = None) -> DataFrame:
    """Mean absolute error of the model and of the baseline; ``weight`` is the multiplicity of compact examples."""
    target = F.col("final_delay_s")
    mean = F.avg if weight is None else lambda e: F.sum(e * weight) / F.sum(F.when(e.isNotNull(), weight))
    return examples.agg(
        mean(F.abs(target - prediction(model))).alias("model_mae"),
        mean(F.abs(target - baseline())).alias("baseline_mae"),
        (F.count(F.lit(1)) if weight is None else F.sum(weight).cast("bigint")).alias("examples"),
    )


def score(features: DataFrame, model: DelayModel) -> DataFrame:
    """Predicted delay in whole seconds, halves to even."""
    return features.withColumn("predicted_delay_seconds", F.bround(prediction(model), 0).cast("bigint"))


@dataclass(frozen=True)
class GateResult:
    passed: bool
    train_examples: int
    test_examples: int
    model: DelayModel | None = None
    model_mae: float | None = None
    baseline_mae: float | None = None


def train_and_gate(examples: DataFrame, test_days: int, path: str | None = None) -> GateResult:
    """Fit on the older days, judge on the last ones, write the model only when it beats the baseline."""
    # the examples, often a large join, are read once; days, sizes, fits and errors come from the compact table
    dated = checkpointed(examples.groupBy("service_date", *FEATURES, "final_delay_s").agg(F.count(F.lit(1)).alias("n")))
    marked = checkpointed(mark_test_days(dated, test_days).groupBy("is_test", *FEATURES, "final_delay_s").agg(F.sum("n").cast("double").alias("n")))
    size = lambda which: F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0)).cast("bigint")
    sizes = marked.agg(size(~F.col("is_test")).alias("a"), size(F.col("is_test")).alias("b")).first()
    if not sizes.a or not sizes.b:
        return GateResult(False, sizes.a, sizes.b)
    model = _least_absolute(marked.filter(~F.col("is_test")))
    scores = evaluate(model, marked.filter("is_test"), F.col("n")).first()
    passed = scores.model_mae < scores.baseline_mae
    if passed and path:
        save_model(examples.sparkSession, model, path, scores.model_mae, scores.baseline_mae)
    return GateResult(passed, sizes.a, sizes.b, model, scores.model_mae, scores.baseline_mae)


MODEL_SCHEMA = "trained_at string, intercept double, weights array<double>, model_mae double, baseline_mae double"


def save_model(spark: SparkSession, model: DelayModel, path: str, model_mae: float, baseline_mae: float) -> None:
    stamp = model.trained_at or datetime.now(timezone.utc).isoformat()
    row = [(stamp, model.intercept, list(model.weights), float(model_mae), float(baseline_mae))]
    spark.createDataFrame(row, MODEL_SCHEMA).write.mode("overwrite").json(path)


def load_model(spark: SparkSession, path: str) -> DelayModel:
    row = spark.read.schema(MODEL_SCHEMA).json(path).first()
    return DelayModel(row.intercept, tuple(row.weights), row.trained_at)
