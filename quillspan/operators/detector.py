"""Detectors on feature arrays, with balanced class weights, cross-fitted calibration and a cost-based threshold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.operators.quantiles import join_groups
from quillspan.operators.split import bucket

DECLARED = {"lightgbm": "boosted_trees"}  # what a declaration may call a kind; the trees are Spark's own


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Adds ``weight`` = rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    weights = counts.crossJoin(F.broadcast(total)).select(label, (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("weight"))
    return df.join(F.broadcast(weights), label)


def fit(df: DataFrame, features: str = "features", label: str = "label", kind: str = "logistic_regression", balanced: bool = True, max_iter: int = 50) -> PipelineModel:
    """A ``logistic_regression`` over all classes, or one class against the rest: ``linear_svc``, ``boosted_trees`` (Spark's, over binned features)."""
    kind = DECLARED.get(kind, kind)
    rows = df.withColumn("_vector", array_to_vector(features))
    rows = balanced_weights(rows, label) if balanced else rows.withColumn("weight", F.lit(1.0))
    index = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="keep")
    if kind == "logistic_regression":
        model = LogisticRegression(family="multinomial", featuresCol="_vector", labelCol="_y", weightCol="weight", maxIter=max_iter)
    elif kind == "linear_svc":
        model = OneVsRest(classifier=LinearSVC(maxIter=max_iter), featuresCol="_vector", labelCol="_y", weightCol="weight")
    elif kind == "boosted_trees":
        model = OneVsRest(classifier=GBTClassifier(maxIter=max_iter, seed=0), featuresCol="_vector", labelCol="_y", weightCol="weight")
    else:
        raise ValueError(f"unknown detector {kind}")
    return Pipeline(stages=[index, model]).fit(rows)


def predict(model: PipelineModel, df: DataFrame, features: str = "features") -> DataFrame:
    """Adds ``predicted`` (the label's text) and, where the model has it, ``proba``."""
    labels = model.stages[0].labels
    out = model.stages[1].transform(df.withColumn("_vector", array_to_vector(features)))
    named = F.get(F.array(*[F.lit(x) for x in labels]), F.col("prediction").cast("int"))
    out = out.withColumn("predicted", named)
    if "probability" in out.columns:
        from pyspark.ml.functions import vector_to_array

        out = out.withColumn("proba", F.slice(vector_to_array("probability"), 1, len(labels)))
    return out.drop("_vector", "rawPrediction", "probability", "prediction", "weight")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def calibrate(df: DataFrame, score: str, truth: str, bins: int = 10) -> DataFrame:
    """Observed rate of ``truth`` in equal-width bins of the score: ``bin``, ``n``, ``mean_score``, ``rate``."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(truth).cast("int")).alias("rate"))


def fit_calibrator(df: DataFrame, score: str, truth: str, steps: int = 10_000) -> IsotonicRegressionModel:
    """Isotonic map from scores to observed rates, over at most ``steps`` + 1 steps of the score so that its size is bounded; rows with a null are left out."""
    usable = df.where(F.col(score).isNotNull() & F.col(truth).isNotNull())
    step = F.floor(F.col(score) * steps)
    rates = usable.groupBy(step).agg(F.avg(score).alias("_score"), F.avg(F.col(truth).cast("int")).alias("_rate"), F.count(F.lit(1)).cast("double").alias("_n"))
    return IsotonicRegression(featuresCol="_score", labelCol="_rate", weightCol="_n").fit(rates)


def calibrated(model: IsotonicRegressionModel, df: DataFrame, score: str, out: str = "calibrated") -> DataFrame:
    """Adds ``out``, the rate between the fitted steps on both sides of the score; a null score gives null."""
    shown = model.copy().setFeaturesCol("_score").setPredictionCol("_rate").transform(df.withColumn("_score", F.coalesce(score, F.lit(0.0))))
    return shown.withColumn(out, F.when(F.col(score).isNotNull(), F.col("_rate"))).drop("_score", "_rate")


def fold_of(group: Column, folds: int, seed: int = 42) -> Column:
    """All rows of a group are in one fold; rows without a group are one."""
    return bucket(F.coalesce(group, F.lit("")), seed, folds)


def out_of_fold(df: DataFrame, positive: str, group: str = "context_id", features: str = "features", label: str = "label", kind: str = "logistic_regression", folds: int = 5, seed: int = 42, max_iter: int = 50) -> DataFrame:
    """Adds ``fold`` and ``score``: the probability of ``positive`` by a detector that saw no row of the fold's groups.

    A fold whose rest lacks the class scores 0. ``folds`` detectors are fitted one after the other, each by Spark.
    """
    rows = df.withColumn("fold", fold_of(F.col(group), folds, seed).cast("int"))
    out = None
    for k in range(folds):
        model = fit(rows.where(F.col("fold") != k), features, label, kind, max_iter=max_iter)
        seen = predict(model, rows.where(F.col("fold") == k), features)
        if "proba" not in seen.columns:
            raise ValueError(f"{kind} gives no probabilities to calibrate")
        labels = model.stages[0].labels
        score = F.get("proba", F.lit(labels.index(positive))) if positive in labels else F.lit(0.0)
        part = seen.withColumn("score", score).select(*rows.columns, "score")
        out = part if out is None else out.unionByName(part)
    return out


@dataclass(frozen=True)
class Calibrated:
    """A detector fitted on all rows and the calibrator fitted on scores of detectors that hadn't seen the row's group."""

    model: PipelineModel
    calibrator: IsotonicRegressionModel
    positive: str

    def scores(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Adds ``predicted``, ``proba``, ``score`` and ``calibrated``."""
        at = self.model.stages[0].labels.index(self.positive)
        return calibrated(self.calibrator, predict(self.model, df, features).withColumn("score", F.get("proba", F.lit(at))), "score")


def fit_calibrated(df: DataFrame, positive: str, group: str = "context_id", features: str = "features", label: str = "label", kind: str = "logistic_regression", folds: int = 5, seed: int = 42, max_iter: int = 50) -> Calibrated:
    scored = out_of_fold(df, positive, group, features, label, kind, folds, seed, max_iter).withColumn("_truth", F.col(label) == positive)
    return Calibrated(fit(df, features, label, kind, max_iter=max_iter), fit_calibrator(scored, "score", "_truth"), positive)


def cross_fitted_rates(df: DataFrame, group: str, score: str, truth: str, bins: int = 10, folds: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``fold``, ``bin`` and ``calibrated``: the rate of ``truth`` among the other folds' rows of the score's bin (null without any).

    One aggregation by fold and bin; rows with a null score or truth calibrate nothing.
    """
    b = F.when(F.col(score).isNotNull(), F.greatest(F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)), F.lit(0))).cast("int")
    rows = df.withColumn("fold", fold_of(F.col(group), folds, seed).cast("int")).withColumn("bin", b)
    use = F.col(score).isNotNull() & F.col(truth).isNotNull()
    parts = rows.where(use).groupBy("fold", "bin").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(truth).cast("bigint")).alias("_y"))
    whole = parts.groupBy("bin").agg(F.sum("_n").alias("_all_n"), F.sum("_y").alias("_all_y"))
    met = join_groups(join_groups(rows, parts, ["fold", "bin"]), whole, ["bin"])
    others = F.col("_all_n") - F.coalesce("_n", F.lit(0))
    return met.withColumn("calibrated", F.when(others > 0, (F.col("_all_y") - F.coalesce("_y", F.lit(0))) / others)).drop("_n", "_y", "_all_n", "_all_y")


def brier(df: DataFrame, scores: list[str], truth: str, by: list[str] | None = None) -> DataFrame:
    """``n`` and for each score its mean squared distance from the truth, over rows where both are known."""
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.pow(F.col(c) - F.col(truth).cast("int"), 2)).alias(f"brier_{c}") for c in scores])


def cost_threshold(df: DataFrame, score: str, truth: str, cost_fp: float = 1.0, cost_fn: float = 1.0, steps: int = 100) -> DataFrame:
    """Threshold of a grid with the least cost of errors (the lower one on ties): ``threshold``, ``cost``."""
    at = F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("i")
    binned = df.select(F.floor(F.col(score) * steps).cast("int").alias("s"), F.col(truth).cast("int").alias("y")).groupBy("s", "y").agg(F.count(F.lit(1)).alias("n"))
    grid = binned.select("s", "y", "n", at)
    wrong = F.when((F.col("y") == 0) & (F.col("s") >= F.col("i")), F.col("n") * cost_fp).when((F.col("y") == 1) & (F.col("s") < F.col("i")), F.col("n") * cost_fn).otherwise(0.0)
    costs = grid.groupBy("i").agg(F.sum(wrong).alias("cost"))
    best = costs.agg(F.min_by("i", F.struct("cost", "i")).alias("i"), F.min("cost").alias("cost"))
    return best.select((F.col("i") / steps).alias("threshold"), "cost")
