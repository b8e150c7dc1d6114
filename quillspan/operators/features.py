"""Features of chunk attention: concentration on the row, drift and evidence rank by window, head aggregation.

Choices where the definition is open: entropy uses the natural logarithm, Gini is the mean-difference form over all chunks,
the standard deviation is that of a population; a row whose shares sum to zero has entropy, Gini and gap zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalised(shares: Column) -> Column:
    # the total is bound once, in the closing step; inside the lambda of transform it would be summed for every element
    return F.aggregate(shares, F.lit(0.0), lambda a, x: a + x, lambda total: F.transform(shares, lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0))))


def chunk_features(shares: Column) -> Column:
    p = F.array_sort(normalised(shares))
    n = F.size(p)
    entropy = F.aggregate(p, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.ln(x)).otherwise(F.lit(0.0)))
    weighted = F.aggregate(F.transform(p, lambda x, i: x * (2 * (i + 1) - n - 1)), F.lit(0.0), lambda a, x: a + x)
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    top, second = F.coalesce(F.get(p, n - 1), F.lit(0.0)), F.coalesce(F.get(p, n - 2), F.lit(0.0))
    return F.struct(entropy.alias("chunk_entropy"), top.alias("chunk_max_share"), F.when(total > 0, weighted / (n * total)).otherwise(F.lit(0.0)).alias("chunk_gini"), (top - second).alias("top1_top2_gap"))


def chunk_drift(df: DataFrame, by: list[str], order: str, shares: str) -> DataFrame:
    """Mean over consecutive steps of the mean absolute change of the normalised shares; null with one step."""
    steps = df.select(*by, order, normalised(F.col(shares)).alias("_p")).withColumn("_q", F.lag("_p").over(Window.partitionBy(*by).orderBy(order)))
    change = F.aggregate(F.zip_with("_p", "_q", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, x: a + x) / F.size("_p")
    return steps.groupBy(*by).agg(F.avg(F.when(F.col("_q").isNotNull(), change)).alias("chunk_drift"))


def evidence_rank(shares: Column, evidence_chunk: Column) -> Column:
    """Rank from 1 of the evidence chunk by share, equal shares sharing the better rank."""
    own = F.get(shares, evidence_chunk)
    return F.when(own.isNotNull(), F.size(F.filter(shares, lambda x: x > own)) + 1).cast("int")


def lookback_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("lookback_mean"), F.stddev_pop(value).alias("lookback_std"))


def mean_over_heads(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias(value))


def top_heads(scores: DataFrame, k: int, score: str = "score", layer: str = "layer", head: str = "head") -> DataFrame:
    """The ``k`` best (layer, head) pairs by score, ties by layer and head."""
    return scores.orderBy(F.desc(score), layer, head).limit(k).select(layer, head, score)


def keep_heads(df: DataFrame, best: DataFrame, layer: str = "layer", head: str = "head") -> DataFrame:
    return df.join(F.broadcast(best.select(layer, head)), [layer, head], "left_semi")
