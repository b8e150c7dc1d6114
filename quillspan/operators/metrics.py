"""Classification metrics and label profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators.schema import LABELS


def confusion(df: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(df: DataFrame, truth: str, predicted: str, labels: tuple[str, ...] = LABELS, by: list[str] | None = None) -> DataFrame:
    """``n``, ``accuracy``, ``f1_<label>``, ``macro_f1`` from the confusion counts; an absent class has F1 zero."""
    by = by or []
    cells = confusion(df, truth, predicted, by)
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0)).cast("double")
    aggs = [F.sum("n").alias("n"), (total(F.col("truth") == F.col("predicted")) / F.sum("n")).alias("accuracy")]
    for lab in labels:
        t, p = F.col("truth") == lab, F.col("predicted") == lab
        both = total(t) + total(p)
        aggs.append(F.when(both == 0, F.lit(0.0)).otherwise(2 * total(t & p) / F.nullif(both, F.lit(0.0))).alias(f"f1_{lab}"))
    out = cells.groupBy(*by).agg(*aggs)
    mean = sum((F.col(f"f1_{lab}") for lab in labels), F.lit(0.0)) / len(labels)
    return out.withColumn("macro_f1", mean)


def calibration_error(df: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal-width bins of confidence (1 falls into the last)."""
    b = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1))
    rows = df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("conf"), F.avg(F.col(correct).cast("int")).alias("acc"))
    return rows.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")).alias("ece"))


def distribution(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Counts of ``value`` and their percent within ``by``."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.col("n") * 100 / F.sum("n").over(Window.partitionBy(*by) if by else Window.partitionBy()))


def coverage(df: DataFrame, by: list[str], code_list: DataFrame, code: str) -> DataFrame:
    """Counts for every code of a fixed list, zeros included."""
    counts = df.groupBy(*by, code).agg(F.count(F.lit(1)).alias("n"))
    every = counts.select(*by).distinct().crossJoin(F.broadcast(code_list.select(code)))
    return every.join(counts, [*by, code], "left").na.fill(0, ["n"])


def meta_profile(df: DataFrame, meta: str, most_values: int = 8) -> DataFrame:
    """``key``, ``value``, ``n``, ``pct`` of each JSON key with at most ``most_values`` values that are not all booleans.

    A row without a key counts under the empty value. Only per-key counts are gathered: absent rows are the difference to the
    table's count.
    """
    pairs = df.select(F.explode(F.from_json(meta, "map<string,string>")).alias("key", "value"))
    counts = pairs.groupBy("key", F.coalesce("value", F.lit("")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    rows = df.agg(F.count(F.lit(1)).alias("_rows"))
    seen = counts.groupBy("key").agg(F.sum("n").alias("_seen"), F.max((F.col("value") == "").cast("int")).alias("_blank")).crossJoin(F.broadcast(rows))
    absent = seen.where("_seen < _rows").select("key", F.lit("").alias("value"), (F.col("_rows") - F.col("_seen")).alias("n"))
    every = counts.unionByName(absent).groupBy("key", "value").agg(F.sum("n").alias("n"))
    keep = every.groupBy("key").agg(F.count(F.lit(1)).alias("_values"), F.every(F.col("value").isin("true", "false")).alias("_flags")).where((F.col("_values") <= most_values) & ~F.col("_flags")).select("key")
    return every.join(keep, "key", "left_semi").crossJoin(F.broadcast(rows)).select("key", "value", "n", (F.col("n") * 100 / F.col("_rows")).alias("pct"))


def spread_of(df: DataFrame, value: str, target: float, order: str) -> DataFrame:
    """The row nearest to ``target`` and the row of the greatest value (first in ``order`` on ties), and min, mean, max."""
    v = F.col(value)
    return df.agg(F.min_by(order, F.struct(F.abs(v - target), F.col(order))).alias("nearest"), F.min_by(order, F.struct(-v, F.col(order))).alias("largest"), F.min(v).alias("least"), F.avg(v).alias("mean"), F.max(v).alias("most"))
