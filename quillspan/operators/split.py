"""Group split by context and leakage between splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket(group: Column, seed: int = 42, buckets: int = 100) -> Column:
    """Stable bucket of a group: eight hex digits of a seeded MD5, modulo ``buckets``."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), group).cast("binary")), 1, 8), 16, 10).cast("bigint") % buckets


def group_split(df: DataFrame, group: str = "context_id", ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 42) -> DataFrame:
    """Adds ``split``: all rows of a group fall into one of train, dev, test; row-local, so no group can be in two."""
    if abs(sum(ratios) - 1) > 1e-9:
        raise ValueError("ratios must sum to one")
    b, first, second = bucket(F.col(group), seed), round(ratios[0] * 100), round((ratios[0] + ratios[1]) * 100)
    return df.withColumn("split", F.when(b < first, "train").when(b < second, "dev").otherwise("test"))


def leakage(df: DataFrame, group: str = "context_id", split: str = "split", base: str = "train") -> DataFrame:
    """For every other split: groups and rows, and those whose group is also in ``base``."""
    held = df.where(F.col(split) == base).select(group).distinct().withColumn("_in", F.lit(1))
    rest = df.where(F.col(split) != base).groupBy(split, group).agg(F.count(F.lit(1)).alias("_rows")).join(held, group, "left")
    leaked = F.col("_in").isNotNull()
    return rest.groupBy(split).agg(F.count(F.lit(1)).alias("n_groups"), F.sum(leaked.cast("bigint")).alias("leaked_groups"), F.sum("_rows").alias("n_rows"), F.sum(F.when(leaked, F.col("_rows")).otherwise(0)).alias("leaked_rows"))


def check_no_leakage(df: DataFrame, group: str = "context_id", split: str = "split") -> None:
    n = df.groupBy(group).agg(F.countDistinct(split).alias("n")).where("n > 1").count()
    if n:
        raise ValueError(f"{n} groups are in more than one split")
