"""Rule-based quality with an isolation forest over the rules' statistics.

Base rules count words, symbols, repeated lines and repeated word windows of the whole text. An isolation forest, fitted on
documents labelled good that pass the base rules, isolates a document's statistics by random splits: few splits mean an
anomaly. The threshold is calibrated on labelled rows that pass the base rules: among thresholds that keep at least
``keep`` of the good ones, the one that rejects most bad ones, placed midway to the next score.

Forest and threshold come from all labelled rows. A tree grows level by level: tasks send each node's count and ranges, and the
driver, which sees no row, draws the splits. The threshold's quantile is exact.
"""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.operators.quantiles import exact_percentiles

from .common import staged

FEATURES = ("symbols", "marks", "pipes", "capitals", "dup_lines", "word_length")
_SPACE = bytes((9, 10, 11, 12, 13, 32))
_SYMBOLS = b"#*$%&|<>"


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words that lie in a window of ``width`` words found twice or more in the text (exact: windows are paired, not hashed)."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    if len(known) == len(words):
        return 0
    step = 1
    while step < width:  # width is a power of two
        pairs = ids[: len(ids) - step] * (len(words) + 1) + ids[step:]
        ids = np.unique(pairs, return_inverse=True)[1]
        step *= 2
    counts = np.bincount(ids)
    hit = counts[ids] > 1
    if not hit.any():
        return 0
    cover = np.zeros(len(words) + 1, np.int64)
    cover[:n] += hit
    cover[width : width + n] -= hit
    return int((np.cumsum(cover[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple[int, int, int, int, int, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the features of one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, chars = len(words), len(text or "") - len(raw) + len(raw.translate(None, _SPACE))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dups = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    w = max(n, 1)
    capitals, lower = len(raw) - len(raw.translate(None, _UPPER)), len(raw) - len(raw.translate(None, _LOWER))
    marks = raw.count(b"!") + raw.count(b"?")
    features = np.array([symbols / w, marks / w, raw.count(b"|") / w, capitals / max(capitals + lower, 1), dups / max(len(lines), 1), chars / w], np.float64)
    return n, chars, symbols, dups, repeats, features


_LOWER, _UPPER = bytes(range(97, 123)), bytes(range(65, 91))


class IsolationForest:
    """Random trees over all rows they are grown from; ``score`` is 2 ** (-mean path / expected path), higher for anomalies.

    ``trees``: for each tree nodes in a complete binary layout of feature (-1 for a leaf), split, path length that ends there.
    """

    def __init__(self, size: int, trees: int = 100, depth: int = 8, seed: int = 7):
        self.size, self.depth, self.seed = size, depth, seed
        self.trees = np.zeros((trees if size else 0, 2 ** (depth + 1), 3))
        self.trees[:, :, 0] = -1

    @staticmethod
    def expected(n: np.ndarray | float) -> np.ndarray:
        """Mean path of an unsuccessful search among n rows."""
        n = np.asarray(n, float)
        return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))

    def settle(self, level: int, tree: int, node: int, n: int, low: np.ndarray, high: np.ndarray) -> None:
        """A node becomes a leaf or splits at a place drawn for it.

        Splits are drawn from the rows' range widened by half on either side, so that values beyond all that was fitted
        part from it at once.
        """
        if level == self.depth or n <= 1:
            self.trees[tree, node] = -1, 0, level + float(self.expected(n))
            return
        rng = np.random.default_rng((self.seed, tree, node))
        f = int(rng.integers(len(low)))
        reach = 0.5 * max(high[f] - low[f], 1e-3)
        self.trees[tree, node] = f, rng.uniform(low[f] - reach, high[f] + reach), 0
        for child in (2 * node, 2 * node + 1):  # one without rows ends where an empty leaf does
            self.trees[tree, child] = -1, 0, level + 1

    @staticmethod
    def descend(nodes: np.ndarray, rows: np.ndarray, steps: int) -> np.ndarray:
        """The node of one tree that each row is in after so many steps."""
        at = np.ones(len(rows), np.int64)
        for _ in range(steps):
            f = nodes[at, 0].astype(np.int64)
            right = rows[np.arange(len(rows)), np.maximum(f, 0)] >= nodes[at, 1]
            at = np.where(f >= 0, 2 * at + right, at)
        return at

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not len(self.trees):
            return np.zeros(len(rows))
        total = np.zeros(len(rows))
        for nodes in self.trees:
            total += nodes[self.descend(nodes, rows, self.depth), 2]
        return 2 ** (-total / len(self.trees) / max(float(self.expected(self.size)), 1e-9))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def _ranges(forest: IsolationForest, level: int):
    """(tree, node, rows, least and greatest of each feature) of the level's nodes, over a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, shape = 2**level, (len(forest.trees), 2**level, len(FEATURES))
        n, low, high = np.zeros(shape[:2], np.int64), np.full(shape, np.inf), np.full(shape, -np.inf)
        for batch in batches:
            rows = _matrix(batch.column(0))
            for t, nodes in enumerate(forest.trees):
                at = forest.descend(nodes, rows, level) - first
                order = np.argsort(at, kind="stable")
                order = order[np.searchsorted(at[order], 0) :]  # rows of leaves above are through
                if not len(order):
                    continue
                own, begins, counts = np.unique(at[order], return_index=True, return_counts=True)
                n[t, own] += counts
                low[t, own] = np.minimum(low[t, own], np.minimum.reduceat(rows[order], begins))
                high[t, own] = np.maximum(high[t, own], np.maximum.reduceat(rows[order], begins))
        trees, own = np.nonzero(n)
        columns = [pa.array(trees), pa.array(own + first), pa.array(n[trees, own]), *[pa.array(x[trees, own, f]) for x in (low, high) for f in range(len(FEATURES))]]
        yield pa.RecordBatch.from_arrays(columns, _RANGE_NAMES)

    return run


_RANGE_NAMES = ["tree", "node", "n", *[f"{x}{f}" for x in ("low", "high") for f in range(len(FEATURES))]]


def grown(rows: DataFrame, **options) -> IsolationForest:
    """A forest over all ``rows`` (``features``), whatever their number and order; the driver sees a row for each node."""
    forest, k = IsolationForest(rows.count(), **options), len(FEATURES)
    schema = ", ".join(f"{c} {'bigint' if i < 3 else 'double'}" for i, c in enumerate(_RANGE_NAMES))
    for level in range(forest.depth + 1 if forest.size else 0):
        spans = rows.select("features").mapInArrow(_ranges(forest, level), schema).groupBy("tree", "node")
        found = spans.agg(F.sum("n"), *[(F.min if c.startswith("low") else F.max)(c) for c in _RANGE_NAMES[3:]]).collect()
        for tree, node, n, *ends in found:
            forest.settle(level, tree, node, n, np.array(ends[:k]), np.array(ends[k:]))
    return forest


def calibrated_threshold(scored: DataFrame, keep: float) -> float:
    """Rows scoring above it are anomalous (``scored``: ``quality``, ``anomaly``). Without labelled rows nothing is."""
    least = exact_percentiles(scored.where("quality = 1"), [], {"least": ("anomaly", keep)}).first()["least"]
    if least is None:
        return float("inf")
    above = scored.where((F.col("quality") == 0) & (F.col("anomaly") > least)).agg(F.min("anomaly")).first()[0]
    return least if above is None else (least + above) / 2


def fails(n_words, n_repeat_words):
    """The base rules: too few words, or over 30 % of them in repeated windows."""
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id") -> DataFrame:
    """Ids and labels of at most ``most`` rows of each class, first by a hash of the id: a bounded table, safe to broadcast.

    Rows without a label or id are left out; of an id with several labels the greatest counts.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).alias("_label"))
    by_class = [known.where(F.col("_label") == v).orderBy(F.xxhash64("_id"), "_id").limit(most) for v in (0, 1)]
    return by_class[0].unionByName(by_class[1])


_STATISTICS = "id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, features array<double>"


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        found = [statistics(t.as_py()) for t in rows.column(1)]
        counts = np.array([f[:5] for f in found], np.int64).reshape(-1, 5)
        features = pa.array([f[5] for f in found], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(counts[:, k].copy()) for k in range(5)), pa.array(fails(counts[:, 0], counts[:, 4])), features], [c.split()[0] for c in _STATISTICS.split(", ")])


def _scored(forest: IsolationForest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            scores = forest.score(_matrix(rows.column(rows.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(scores)], [*rows.schema.names[:-1], "anomaly"])

    return run


def fit(stats: DataFrame, labels: DataFrame, keep: float = 0.999, id_col: str = "doc_id") -> tuple[IsolationForest, float]:
    """Forest and threshold from all labelled rows that pass the base rules.

    Rows without a label or id are left out; of an id with several labels the greatest counts.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max("quality").cast("int").alias("quality"))
    rows = staged(stats.where("not base_failed").select("id", "features").join(known, "id").select("quality", "features"), "labelled")
    forest = grown(rows.where("quality = 1"))
    return forest, calibrated_threshold(staged(rows.mapInArrow(_scored(forest), "quality int, anomaly double"), "labelled-scores"), keep)


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = 0.999) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, the base counts, ``base_failed``, ``kept``, ``anomaly`` (0 to 1).

    Words are ``[^\\x20\\x09-\\x0D]+``. Null texts have none and fail; texts of any length are counted whole; other columns aren't read. Null ids and repeated rows stay. Without labels the
    forest is empty and only base rules reject. The text is read once.
    """
    stats = staged(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_statistics, _STATISTICS), "statistics")
    forest, threshold = fit(stats, labels, keep, id_col)
    scored = stats.mapInArrow(_scored(forest), _STATISTICS.replace("features array<double>", "anomaly double"))
    kept = ~F.col("base_failed") & (F.col("anomaly") <= F.lit(threshold))
    return scored.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "anomaly")
