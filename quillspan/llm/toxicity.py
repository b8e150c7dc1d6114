"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, calibrated votes.

Examples: at most ``most`` labelled rows of each class (chosen by a hash of the id). Terms: lower-cased words and their
beginnings (stems of compounds and inflected words) that the two classes use at clearly different rates (ratio and
chi-square bounds). Each example is a unit TF-IDF vector. The index keeps
each term's postings in blocks of examples with the greatest weight of the block; a query sums those maxima to bound every
block, visits blocks from the highest bound on and stops once a bound falls below the k-th best cosine, so the k nearest
are exact (ties: the lower example). The vote of the neighbours, weighted by their cosine and their class's sampling rate,
is mapped to a probability by isotonic regression over leave-one-out votes. Evidence: the neighbours' ids and the query's
heaviest terms.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import labelled_sample

_WORD = re.compile(r"[^\W\d_]+")
BLOCK = 32


STEMS = (3, 4, 5, 6, 7)  # characters of a word's beginning, written with a following ~


def terms_of(text: str | None, known: dict[str, int] | None = None) -> Counter:
    """Counts of words and word beginnings, and once each a term for 2 and for 4 uses; of ``known`` terms only, if given."""
    out: Counter = Counter()
    for w, n in Counter(_WORD.findall((text or "").lower())).items():
        if known is None or w in known:
            out[w] += n
        for k in STEMS:
            if k < len(w) and (known is None or w[:k] + "~" in known):
                out[w[:k] + "~"] += n
    for term, n in list(out.items()):
        for least in (2, 4):
            if n >= least and (known is None or f"{term}#{least}" in known):
                out[f"{term}#{least}"] = 1
    return out


def choose_terms(bags: list[Counter], labels: np.ndarray, most: int, ratio: float, chi: float, least: float = 0.02) -> list[str]:
    """Terms whose document rates in the classes differ by ``ratio`` or more, the higher one ``least`` or more, with a chi-square of ``chi`` or more."""
    n = np.array([(labels == 0).sum(), (labels == 1).sum()], float)
    df = (Counter(), Counter())
    for bag, y in zip(bags, labels, strict=True):
        df[y].update(bag.keys())
    found = []
    for term in df[0].keys() | df[1].keys():
        a = np.array([df[0][term], df[1][term]], float)
        rates = (a + 0.5) / (n + 1)
        share = a.sum() / n.sum()
        if share >= 1 or max(a / np.maximum(n, 1)) < least or max(rates[1] / rates[0], rates[0] / rates[1]) < ratio:
            continue
        value = (((a - n * share) ** 2) / np.maximum(n * share * (1 - share), 1e-9)).sum()
        if value >= chi:
            found.append((-value, term))
    return [t for _, t in sorted(found)[:most]]


class BlockMaxIndex:
    """Inverted index over unit vectors: for each term postings by block, with the block's greatest weight."""

    def __init__(self, vectors: np.ndarray):
        self.n, self.terms = vectors.shape
        self.blocks = -(-self.n // BLOCK)
        padded = np.zeros((self.blocks * BLOCK, self.terms))
        padded[: self.n] = vectors
        blocks = padded.reshape(self.blocks, BLOCK, self.terms)
        self.most = blocks.max(axis=1).T.copy()  # (term, block)
        self.postings = [{int(b): (np.nonzero(blocks[b, :, t])[0], blocks[b, np.nonzero(blocks[b, :, t])[0], t]) for b in np.nonzero(self.most[t])[0]} for t in range(self.terms)]

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Exact: examples and cosines of the ``k`` nearest with a positive cosine, best first; ``skip`` is left out."""
        bounds = weights @ self.most[terms]
        order = np.argsort(-bounds, kind="stable")
        best_ids, best = np.zeros(0, np.int64), np.zeros(0)
        for b in order:
            if bounds[b] <= 0 or len(best) == k and bounds[b] < best[-1] - 1e-12:
                break
            scores = np.zeros(BLOCK)
            for t, w in zip(terms, weights, strict=True):
                if (hit := self.postings[t].get(int(b))) is not None:
                    scores[hit[0]] += w * hit[1]
            own = np.nonzero(scores > 0)[0]
            ids = own + b * BLOCK
            own, ids = own[ids != skip], ids[ids != skip]
            best_ids, best = np.r_[best_ids, ids], np.r_[best, scores[own]]
            top = np.lexsort((best_ids, -best))[:k]
            best_ids, best = best_ids[top], best[top]
        return best_ids, best


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted pool-adjacent-violators: knots (greatest x of each pool) and non-decreasing values."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for xi in np.unique(x[order]):
        at = x == xi
        pools.append([xi, float((y[at] * w[at]).sum()), float(w[at].sum())])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            top = pools.pop()
            pools[-1] = [top[0], pools[-1][1] + top[1], pools[-1][2] + top[2]]
    return np.array([p[0] for p in pools]), np.array([p[1] / p[2] for p in pools])


class NeighbourVotes:
    def __init__(self, texts: list[str], labels: np.ndarray, ids: list[int], rates: np.ndarray, k: int, most_terms: int, ratio: float, chi: float, power: float):
        """``rates``: sampled share of each class, so that votes count as if all labelled rows were examples."""
        bags = [terms_of(t) for t in texts]
        self.k, self.power, self.labels, self.ids = k, power, labels, np.array(ids, np.int64)
        self.weight = 1 / rates[labels] if len(labels) else np.zeros(0)
        self.words = choose_terms(bags, labels, most_terms, ratio, chi) if len(set(labels.tolist())) == 2 else []
        self.place = {w: i for i, w in enumerate(self.words)}
        n = len(bags)
        df = Counter(w for bag in bags for w in bag if w in self.place)
        self.idf = np.array([np.log((1 + n) / (1 + df[w])) + 1 for w in self.words])
        vectors = np.zeros((n, len(self.words)))
        for i, bag in enumerate(bags):
            t, v = self.vector(bag)
            vectors[i, t] = v
        self.index = BlockMaxIndex(vectors) if self.words else None
        votes = np.array([self.vote(bag, i)[0] for i, bag in enumerate(bags)])
        if len(votes):
            self.knots, self.values = isotonic(votes, labels.astype(float), self.weight)

    def vector(self, bag: Counter) -> tuple[np.ndarray, np.ndarray]:
        place = self.place
        t = np.array(sorted(place[w] for w in place.keys() & bag.keys()), np.int64)
        if not len(t):
            return t, np.zeros(0)
        v = (1 + np.log([bag[self.words[i]] for i in t])) * self.idf[t]
        return t, v / np.sqrt((v * v).sum())

    def vote(self, bag: Counter, skip: int = -1) -> tuple[float, np.ndarray]:
        """Weighted share of toxic neighbours, and the neighbours; -1 if no example shares a term."""
        if self.index is None:
            return -1.0, np.zeros(0, np.int64)
        t, v = self.vector(bag)
        if not len(t):
            return -1.0, np.zeros(0, np.int64)
        near, cos = self.index.nearest(t, v, self.k, skip)
        if not len(near):
            return -1.0, near
        w = cos**self.power * self.weight[near]
        return float((w * self.labels[near]).sum() / w.sum()), near

    def score(self, text: str | None) -> tuple[float, list[int], list[str]]:
        bag = terms_of(text, self.place)
        vote, near = self.vote(bag)
        if not len(self.labels):
            return 0.0, [], []
        at = min(int(np.searchsorted(self.knots, vote - 1e-12)), len(self.values) - 1)
        t, v = self.vector(bag)
        return float(self.values[at]), self.ids[near[:3]].tolist(), [self.words[i] for i in t[np.argsort(-v, kind="stable")[:3]]]


def fit(docs: DataFrame, labels: DataFrame, most: int = 1000, k: int = 15, most_terms: int = 512, ratio: float = 4.0, chi: float = 30.0, power: float = 2.0, id_col: str = "doc_id", text_col: str = "text", train: str | None = None) -> NeighbourVotes:
    """Learns from at most ``most`` labelled rows of each class; ``train`` is an SQL condition on the labels' rows."""
    usable = labels.where(train) if train else labels
    chosen = labelled_sample(docs, usable, "toxic", most, id_col)
    texts = docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("_key") == F.col("_id")).select("_id", F.col("_label").cast("int").alias("y"), "text").collect()
    rows.sort(key=lambda r: (r["_id"], r["text"] or ""))
    y = np.array([r["y"] for r in rows], np.int64)
    counts = {r["y"]: r["n"] for r in usable.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col)).agg(F.max("toxic").cast("int").alias("y")).groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    rates = np.array([min(1.0, max((y == c).sum(), 1) / max(counts.get(c, 0), 1)) for c in (0, 1)])
    return NeighbourVotes([r["text"] for r in rows], y, [r["_id"] for r in rows], rates, k, most_terms, ratio, chi, power)


def _score(model: NeighbourVotes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = [model.score(t.as_py()) for t in rows.column(1)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.list_(pa.int64())), pa.array([f[2] for f in found], pa.list_(pa.string()))], ["id", "score", "neighbours", "evidence"])

    return run


def toxicity_scores(docs: DataFrame, model: NeighbourVotes, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, ``score`` (0 to 1), ``predicted``, ``neighbours``, ``evidence``.

    Null and empty texts score as documents that share no term with an example; without labels every score is 0. Null ids
    and repeated rows stay; texts of any length are scored whole; other columns aren't read. One pass without a shuffle.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(_score(model), "id bigint, score double, neighbours array<bigint>, evidence array<string>")
    return found.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "neighbours", "evidence")


def drop_toxic(docs: DataFrame, model: NeighbourVotes, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Rows of ``docs``, all columns kept, whose score is below ``threshold``; null texts score as empty ones, repeated rows alike."""

    @F.pandas_udf("double")
    def score(texts):
        return texts.map(lambda t: model.score(t)[0]).astype("float64")

    return docs.where(score(F.col(text_col)) < threshold)
