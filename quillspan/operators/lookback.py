"""Lookback ratios from attention weights: one row for each (sample, layer, head, query) with the weights as an array.

Roles are kept as arrays of token positions, so every ratio is computed on its row and nothing is shuffled. ``long_form``
gives the same weights as one row for each key, for cross-checks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from quillspan.functions.text import let
from quillspan.operators.quantiles import exact_percentiles, join_groups

EPS = 1e-9


def token_span(offsets: Column, start: Column, end: Column) -> Column:
    """Positions of tokens (array of structs ``token_start``, ``token_end``) that overlap [start, end); empty tokens never do."""
    spot = lambda s: F.transform(offsets, lambda o, i: F.when(_overlaps(o, s["a"], s["z"]), i.cast("int")))
    return F.filter(let(F.struct(start.alias("a"), end.alias("z")), spot), lambda i: i.isNotNull())


def _overlaps(token: Column, start: Column, end: Column) -> Column:
    return (token["token_end"] > token["token_start"]) & (token["token_start"] < end) & (token["token_end"] > start)


def layout(offsets: Column, context: tuple[Column, Column], response: tuple[Column, Column], chunks: Column) -> Column:
    """Struct of roles: ``context``, ``prompt`` (all before the response), ``response``, ``queries`` (response less its first), ``chunk_tokens``.

    ``chunks``: array of structs ``char_start``, ``char_end`` in the same text as the offsets. Raises without a context token
    and with fewer than two response tokens. Chunks keep context tokens only. Offsets and roles are bound once each.
    """
    none = lambda why: F.raise_error(F.lit(why)).cast("array<int>")
    in_context = lambda o: let(token_span(o, *context), lambda t: F.when(F.size(t) > 0, t).otherwise(none("no context token")))
    in_response = lambda o: let(token_span(o, *response), lambda t: F.when(F.size(t) > 1, t).otherwise(none("fewer than two response tokens")))

    def roles(o: Column, ctx: Column, resp: Column) -> Column:
        first = F.get(resp, F.lit(0))
        prompt = F.when(first > 0, F.sequence(F.lit(0), first - 1)).otherwise(F.array().cast("array<int>"))
        inside = F.transform(chunks, lambda c: F.filter(ctx, lambda i: _overlaps(F.get(o, i), c["char_start"], c["char_end"])))
        return F.struct(ctx.alias("context"), prompt.alias("prompt"), resp.alias("response"), F.slice(resp, 2, F.greatest(F.size(resp) - 1, F.lit(0))).alias("queries"), inside.alias("chunk_tokens"))

    return let(offsets, lambda o: let(in_context(o), lambda ctx: let(in_response(o), lambda resp: roles(o, ctx, resp))))


def _sum_at(weights: Column, positions: Column) -> Column:
    return F.aggregate(positions, F.lit(0.0), lambda acc, k: acc + F.coalesce(F.get(weights, k).cast("double"), F.lit(0.0)))


@pandas_udf(T.ArrayType(T.DoubleType()))
def prefix_sums(weights: pd.Series) -> pd.Series:
    """0 and the sums of the first 1, 2, ... weights, nulls as 0; null if a weight isn't finite, since it would spoil all after it."""

    def of(row):
        if row is None:
            return None
        row = np.asarray(row, np.float64) if None not in row else np.array([0.0 if x is None else x for x in row])
        return np.concatenate(([0.0], np.cumsum(row))) if np.isfinite(row).all() else None

    return weights.map(of)


# as one that isn't deterministic it stays where it stands: the optimizer would copy it into lambdas, where it can't run
prefix_sums = prefix_sums.asNondeterministic()


def _sum_between(weights: Column, sums: Column | None, positions: Column) -> Column:
    """Positions in a row are the difference of two prefix sums; others, or without sums, are added up one by one."""
    if sums is None:
        return _sum_at(weights, positions)
    n = F.size(positions)
    first, last = F.get(positions, F.lit(0)), F.get(positions, n - 1)
    upto = lambda k: F.get(sums, F.least(k, F.size(sums) - 1))
    return F.when(n == 0, F.lit(0.0)).when(sums.isNotNull() & (first >= 0) & (last - first + 1 == n), upto(last + 1) - upto(first)).otherwise(_sum_at(weights, positions))


def ratios(weights: Column, context: Column, prompt: Column, response: Column, query_index: Column, chunk_tokens: Column, sums: Column | None = None) -> Column:
    """Struct of ``context_mean``, ``prompt_mean``, ``self_mean``, ``lookback_context``, ``lookback_total``, ``per_chunk``.

    ``query_index`` counts the scored response tokens from 0: the query's own key is response token ``query_index + 1``, its
    weight is left out of the self mean, which is divided by ``query_index + 1``. Positions are ascending. With the row's
    ``prefix_sums`` a role or chunk whose tokens are in a row costs two look-ups, however long it is and however chunks overlap.
    """
    total = lambda positions: _sum_between(weights, sums, positions)
    own = F.coalesce(F.get(weights, F.get(response, query_index + 1)).cast("double"), F.lit(0.0))
    context_mean = total(context) / F.greatest(F.size(context), F.lit(1))
    prompt_mean = total(prompt) / F.greatest(F.size(prompt), F.lit(1))
    self_mean = (total(response) - own) / (query_index + 1)
    floor = lambda x: F.greatest(x, F.lit(EPS))
    share = lambda m: m / floor(m + self_mean)
    means = F.transform(chunk_tokens, lambda t: total(t) / F.greatest(F.size(t), F.lit(1)))
    # the divisor is bound once to a lambda's variable
    per_chunk = F.aggregate(F.array(floor(context_mean + self_mean)), F.lit(0.0), lambda a, x: a + x, lambda total: F.transform(means, lambda m: m / total))
    return F.struct(context_mean.alias("context_mean"), prompt_mean.alias("prompt_mean"), self_mean.alias("self_mean"), share(context_mean).alias("lookback_context"), share(prompt_mean).alias("lookback_total"), per_chunk.alias("per_chunk"))


def lookback(df: DataFrame, weights: str = "weights", query_index: str = "query_index", role: str = "layout") -> DataFrame:
    r = F.col(role)
    rows = df.withColumn("_sums", prefix_sums(weights))
    return rows.withColumn("ratios", ratios(F.col(weights), r["context"], r["prompt"], r["response"], F.col(query_index), r["chunk_tokens"], F.col("_sums"))).drop("_sums")


def is_finite(weights: Column) -> Column:
    return ~F.exists(weights, lambda w: w.isNull() | F.isnan(w) | (F.abs(w) == float("inf")))


def layer_diagnostics(df: DataFrame, sample: str = "sample_id", layer: str = "layer", weights: str = "weights", query_index: str = "query_index") -> DataFrame:
    """For each sample and layer: whether all weights are finite, and the mean over heads of the last query's row sum."""
    total = F.aggregate(F.col(weights), F.lit(0.0), lambda a, w: a + w.cast("double"))
    rows = df.select(sample, layer, query_index, is_finite(F.col(weights)).alias("ok"), total.alias("total"))
    per_query = rows.groupBy(sample, layer, query_index).agg(F.every("ok").alias("ok"), F.avg("total").alias("total"))
    return per_query.groupBy(sample, layer).agg(F.every("ok").alias("finite"), F.max_by("total", query_index).alias("row_sum_mean"))


def select_layers(df: DataFrame, layers: list[int] | None = None, exclude: tuple[int, ...] = (), layer: str = "layer") -> DataFrame:
    """Rows of the chosen layers; raises if the lists leave none."""
    if layers is not None and not set(layers) - set(exclude):
        raise ValueError("no layer left")
    kept = df if layers is None else df.where(F.col(layer).isin(sorted(set(layers) - set(exclude))))
    return kept.where(~F.col(layer).isin(*exclude)) if exclude else kept


def missing_layers(df: DataFrame, expected: DataFrame, sample: str = "sample_id", layer: str = "layer") -> DataFrame:
    """Expected (sample, layer) pairs without weights."""
    return expected.join(df.select(sample, layer).distinct(), [sample, layer], "left_anti")


def long_form(df: DataFrame, keys: list[str], weights: str = "weights") -> DataFrame:
    return df.select(*keys, F.posexplode(weights).alias("k", "w"))


def layer_drift(a: DataFrame, b: DataFrame, keys: list[str], layer: str, value: str) -> DataFrame:
    """For each layer of two runs joined on ``keys``: rows with a NaN on either side, mean and greatest absolute difference of the rest."""
    met = a.select(*keys, layer, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys)
    bad = F.isnan("_a") | F.isnan("_b")
    gap = F.when(~bad, F.abs(F.col("_a") - F.col("_b")))
    return met.groupBy(layer).agg(F.sum(bad.cast("bigint")).alias("n_nan"), F.avg(gap).alias("mean_diff"), F.max(gap).alias("max_diff"))


def global_drift(a: DataFrame, b: DataFrame, keys: list[str], layer: str, value: str) -> DataFrame:
    """Over layers without a NaN in either run: mean, 99th percentile and maximum difference, and the layer of the maximum."""
    met = a.select(*keys, layer, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys)
    bad = met.where(F.isnan("_a") | F.isnan("_b")).select(layer).distinct()
    clean = met.join(bad, layer, "left_anti").withColumn("_gap", F.abs(F.col("_a") - F.col("_b")))
    rest = clean.agg(F.avg("_gap").alias("mean_diff"), F.max("_gap").alias("max_diff"), F.min_by(layer, F.struct(-F.col("_gap"), F.col(layer))).alias("worst_layer"))
    return join_groups(rest, exact_percentiles(clean, [], {"p99_diff": ("_gap", 0.99)}), [])


def bad_layers(df: DataFrame, sample: str = "sample_id", layers: str = "nonfinite_layers") -> DataFrame:
    """One row: all layers that were bad in any sample, sorted, and how many samples had one."""
    return df.agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set(layers)))).alias("layers"), F.coalesce(F.sum((F.size(layers) > 0).cast("bigint")), F.lit(0)).alias("n_samples"))


def assemble(df: DataFrame, value: str, sample: str = "sample_id", layer: str = "layer", head: str = "head") -> DataFrame:
    """One row for each sample: values as a float array ordered by layer and head."""
    rows = df.groupBy(sample).agg(F.sort_array(F.collect_list(F.struct(layer, head, F.col(value).cast("float").alias("v")))).alias("_v"))
    return rows.select(sample, F.transform("_v", lambda x: x["v"]).alias("features"))
