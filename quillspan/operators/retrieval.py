"""BM25 retrieval by joins on blocks of postings, and ranking metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from quillspan.functions.text import words
from quillspan.sources.paths import stored


@pandas_udf(T.ArrayType(T.StructType([T.StructField("place", T.IntegerType()), T.StructField("score", T.DoubleType())])))
def _best(places: pd.Series, weights: pd.Series, k: pd.Series, digits: pd.Series) -> pd.Series:
    """The k best sums of weights by place; ties of the rounded sums go to the lower place."""
    out = []
    for at, w, n, d in zip(places, weights, k, digits, strict=True):
        total = np.bincount(at, weights=w)
        some = np.unique(at)
        best = some[np.lexsort((some, -np.round(total[some], d)))[:n]]
        out.append([(int(i), float(total[i])) for i in best])
    return pd.Series(out)


def postings(passages: DataFrame, passage_id: str, passage_text: str, k1: float = 1.5, b: float = 0.75, block: int = 128) -> tuple[DataFrame, DataFrame]:
    """The index: ``term``, ``block``, ``places``, ``weights``, ``top`` (the greatest weight); and ``block``, ``place``, passage id.

    Passages are dealt into blocks of about ``block`` by the hash of their id, and a term has one row for each block that
    holds it: a frequent term's postings are spread over as many rows as there are blocks.
    """
    rows = passages.select(passage_id, words(F.lower(passage_text)).alias("_w"))
    corpus = rows.agg(F.count(F.lit(1)).alias("N"), F.avg(F.size("_w")).alias("avg_len"))
    sized = rows.select(passage_id, F.size("_w").alias("len")).crossJoin(F.broadcast(corpus)).withColumn("block", F.pmod(F.xxhash64(passage_id), F.greatest(F.ceil(F.col("N") / block), F.lit(1))))
    placed = sized.withColumn("place", F.row_number().over(Window.partitionBy("block").orderBy(passage_id)) - 1)
    tf = rows.select(passage_id, F.explode("_w").alias("term")).groupBy(passage_id, "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.ln(1 + (F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    weighted = tf.join(df, "term").join(placed, passage_id).select("term", "block", "place", weight.alias("w"))
    index = weighted.groupBy("term", "block").agg(F.collect_list(F.struct("place", "w")).alias("_h"), F.max("w").alias("top"))
    return index.select("term", "block", F.col("_h.place").alias("places"), F.col("_h.w").alias("weights"), "top"), placed.select("block", "place", passage_id)


def _block_scores(wanted: DataFrame, asked: DataFrame, index: DataFrame, query_id: str, k: int, digits: int) -> DataFrame:
    """The ``k`` best passages of each (query, block): only these leave the row in which a block is scored."""
    rows = wanted.join(asked, query_id).join(index.select("term", "block", "places", "weights"), ["term", "block"])
    rows = rows.groupBy(query_id, "block").agg(F.flatten(F.collect_list("places")).alias("_p"), F.flatten(F.collect_list("weights")).alias("_w"))
    best = rows.select(query_id, "block", F.explode(_best("_p", "_w", F.lit(k), F.lit(digits))).alias("_b"))
    return best.select(query_id, "block", F.col("_b.place").alias("place"), F.round("_b.score", digits).alias("score"))


def candidate_blocks(asked: DataFrame, index: DataFrame, query_id: str, k: int, digits: int, seeds: int = 2) -> DataFrame:
    """(query, block) pairs that may hold one of the query's ``k`` best passages; all others are proven not to.

    The ``k`` blocks where each of the query's ``seeds`` heaviest terms weighs most are scored first; their k-th best score is a floor. Terms
    whose greatest weights add up to less than the floor can't lift a passage to it by themselves, so only blocks of the
    others are looked at, and of these the ones whose terms' greatest weights there reach the floor.
    """
    tops = index.select("term", "block", "top")
    weighed = asked.join(tops.groupBy("term").agg(F.max("top").alias("most")), "term")
    heavy = Window.partitionBy(query_id).orderBy(F.desc("most"), "term")
    best = tops.withColumn("_n", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("top"), "block"))).where(F.col("_n") <= k).select("term", "block")
    first = weighed.withColumn("_n", F.row_number().over(heavy)).where(F.col("_n") <= seeds).join(best, "term").select(query_id, "block").distinct()
    seeded = _block_scores(first, asked, index, query_id, k, digits)
    floor = seeded.groupBy(query_id).agg(F.sort_array(F.collect_list("score"), asc=False).alias("_s")).select(query_id, (F.get("_s", F.lit(k - 1)) - 10.0**-digits).alias("floor"))
    light = Window.partitionBy(query_id).orderBy("most", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    needed = weighed.join(floor, query_id).withColumn("_sum", F.sum("most").over(light)).where(F.col("floor").isNull() | (F.col("_sum") >= F.col("floor")))
    blocks = needed.select(query_id, "floor", "term").join(tops, "term").select(query_id, "floor", "block").distinct()
    bound = blocks.join(asked, query_id).join(tops, ["term", "block"]).groupBy(query_id, "block").agg(F.sum("top").alias("_bound"), F.first("floor").alias("floor"))
    return bound.where(F.col("floor").isNull() | (F.col("_bound") >= F.col("floor"))).select(query_id, "block")


def bm25(queries: DataFrame, passages: DataFrame, query_id: str, query_text: str, passage_id: str, passage_text: str, k: int = 3, k1: float = 1.5, b: float = 0.75, digits: int = 6, block: int = 128) -> DataFrame:
    """The ``k`` best passages of each query: ``query_id``, ``passage_id``, ``score``, ``rank`` from 1.

    Terms are lower-cased words; a query's repeated terms count once. idf = ln(1 + (N - df + 0.5) / (df + 0.5)). Scores are
    rounded before ranking so that ties go to the lower passage id on any partitioning. Queries are joined with blocks of
    postings by (term, block) and a block is scored in one row, so pairs of query and passage are never rows but for a block's
    ``k`` best; blocks that can't reach the query's k-th score aren't scored. Passages without a shared term are not
    returned. Ids are unique. The index is written once to the shared folder when this is called, since it is read at every step.
    """
    index, placed = (stored(x, name) for x, name in zip(postings(passages, passage_id, passage_text, k1, b, block), ("postings", "places"), strict=True))
    asked = queries.select(query_id, F.explode(F.array_distinct(words(F.lower(query_text)))).alias("term"))
    wanted = candidate_blocks(asked, index, query_id, k, digits)
    scores = _block_scores(wanted, asked, index, query_id, k, digits).join(placed, ["block", "place"])
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), passage_id))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k).select(query_id, passage_id, "score", "rank")


def ranking_metrics(df: DataFrame, rank: str, n_candidates: str, by: list[str] | None = None) -> DataFrame:
    """``hit_at_1``, ``hit_at_3``, ``mrr`` and the random floor; a null rank is a miss."""
    hit = lambda k: F.avg(F.coalesce((F.col(rank) <= k).cast("double"), F.lit(0.0)))
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), hit(1).alias("hit_at_1"), hit(3).alias("hit_at_3"), F.avg(F.coalesce(1 / F.col(rank), F.lit(0.0))).alias("mrr"), F.avg(1 / F.col(n_candidates)).alias("random_floor"))
