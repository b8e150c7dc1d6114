"""Exact percentiles without a group's values in one task.

A mergeable summary of bounded size brackets each wanted place; one more pass counts what lies below the bracket and keeps,
counted by value, only what lies inside, a share of about four over the summary's accuracy. The places fall into these.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 50_000


def join_groups(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """``left`` with the other columns of ``right``, which has a row for each group; null groups meet too, absent ones give nulls, no groups join one row."""
    if not by:
        return left.crossJoin(F.broadcast(right))  # one row
    renamed = right.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], *[c for c in right.columns if c not in by])
    same = reduce(and_, [left[c].eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)])
    return left.join(renamed, same, "left").drop(*[f"_g{i}" for i in range(len(by))])


def exact_percentiles(df: DataFrame, by: list[str], wanted: Mapping[str, tuple[Column | str, float]], accuracy: int = ACCURACY) -> DataFrame:
    """For each group a column for each of ``wanted`` (name: value, share), interpolated linearly between the two nearest places.

    Nulls count for nothing; a group without a value has null there; groups without any row don't exist. Values are doubles
    without NaN. It raises, rather than return a near value, if a summary missed its error bound.
    """
    values: list[Column] = []
    names: list[str] = []
    places: dict[int, dict[float, list[str]]] = {}  # by value: share and the columns that ask for it
    for out, (value, share) in wanted.items():
        value = F.col(value) if isinstance(value, str) else value
        text = str(value._jc) if hasattr(value, "_jc") else str(value)
        if text not in names:
            names.append(text)
            values.append(value.cast("double"))
        places.setdefault(names.index(text), {}).setdefault(share, []).append(out)
    shares = sorted({s for own in places.values() for s in own})
    margin = 2.0 / accuracy
    rows = df.select(*by, F.explode(F.array(*[F.struct(F.lit(i).alias("_v"), v.alias("_x")) for i, v in enumerate(values)])).alias("_e")).select(*by, "_e._v", "_e._x").where(F.col("_x").isNotNull())
    asks = lambda j: F.col("_v").isin([i for i, own in places.items() if shares[j] in own])
    ends = [max(s - margin, 0.0) for s in shares] + [min(s + margin, 1.0) for s in shares]
    marks = rows.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_x", ends, accuracy).alias("_q"))
    met = join_groups(rows, marks, [*by, "_v"])

    n_shares = len(shares)
    low, high = (lambda j: F.get("_q", F.lit(j))), (lambda j: F.get("_q", F.lit(j + n_shares)))
    x = F.col("_x")
    # each value's side of each bracket that is asked of it; inside, values stay apart
    side = lambda j: F.struct(F.lit(j).alias("j"), F.when(x < low(j), -1).when(x > high(j), 1).otherwise(0).alias("side"))
    tagged = met.select(*by, "_v", "_n", "_x", F.explode(F.array_compact(F.array(*[F.when(asks(j), side(j)) for j in range(n_shares)]))).alias("_t"))
    tagged = tagged.select(*by, "_v", "_n", F.col("_t.j").alias("_j"), F.col("_t.side").alias("_side"), F.when(F.col("_t.side") == 0, x).alias("_x"), x.alias("_any"))
    counts = tagged.groupBy(*by, "_v", "_n", "_j", "_side", "_x").agg(F.count(F.lit(1)).alias("_c"), F.max("_any").alias("_most"), F.min("_any").alias("_least"))
    own = Window.partitionBy(*by, "_v", "_j")
    where = lambda k, c: F.when(F.col("_side") == k, F.col(c))
    inside = counts.withColumns({
        "_less": F.coalesce(F.sum(where(-1, "_c")).over(own), F.lit(0)), "_below": F.max(where(-1, "_most")).over(own), "_above": F.min(where(1, "_least")).over(own),
        "_to": F.sum(F.coalesce(where(0, "_c"), F.lit(0))).over(own.orderBy("_x")),
    }).where("_side = 0")

    at = F.get(F.array(*map(F.lit, shares)), F.col("_j")) * (F.col("_n") - 1)
    place = {"_lo": F.floor(at), "_hi": F.ceil(at)}
    pick = lambda k: F.max(F.when((F.col(k) >= F.col("_less") + F.col("_to") - F.col("_c")) & (F.col(k) < F.col("_less") + F.col("_to")), x)).alias(f"{k}_in")
    found = inside.withColumns(place).groupBy(*by, "_v", "_j", "_n", "_lo", "_hi", "_less", "_below", "_above").agg(pick("_lo"), pick("_hi"), F.max("_to").alias("_all"))

    def value(k: str) -> Column:
        below, after = F.col("_less") - 1, F.col("_less") + F.col("_all")
        return F.coalesce(F.col(f"{k}_in"), F.when(F.col(k) == below, F.col("_below")).when(F.col(k) == after, F.col("_above")), F.raise_error(F.lit("a summary missed its error bound; raise the accuracy")).cast("double"))

    step = F.get(F.array(*map(F.lit, shares)), F.col("_j")) * (F.col("_n") - 1) - F.col("_lo")
    solved = found.select(*by, "_v", "_j", (value("_lo") + (value("_hi") - value("_lo")) * step).alias("_y"))
    outs = [F.max(F.when((F.col("_v") == i) & (F.col("_j") == shares.index(s)), F.col("_y"))).alias(out) for i, own in places.items() for s, cols in own.items() for out in cols]
    return solved.groupBy(*by).agg(*outs)
