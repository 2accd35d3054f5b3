"""Quality classifier: histogram gradient-boosted trees over statistics of a whole text.

Statistics are computed in Arrow batches on the executors. The model is fitted on the driver from a bounded sample of
labelled rows (``fit_rows``); its trees are flattened into heap-ordered arrays, so a batch is scored by ``depth`` array
steps for each tree. Scoring needs no shuffle: one pass over the documents.

Defined cases: a null or empty text has the statistics of an empty text and gets a score; repeated labels of one document
count once (the largest quality); rows without id or quality teach nothing; without labels of both kinds every
score is their mean (0.5 without any). Columns of the documents beside the id and the text are never read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = (
    "chars", "words", "word_chars", "distinct_words", "top_word", "same_as_before", "letters", "upper", "digits", "spaces", "stops",
    "other_marks", "pipes", "marked_words", "lines", "line_chars", "repeated_lines", "packed", "distinct_pairs",
)
_KINDS = np.zeros((256, 7))
for _byte in range(256):
    _char = chr(_byte)
    _KINDS[_byte, 0] = _byte >= 128 or _char.isalpha()
    _KINDS[_byte, 1] = _byte < 128 and _char.isupper()
    _KINDS[_byte, 2] = _byte < 128 and _char.isdigit()
    _KINDS[_byte, 3] = _byte in b" \t\n\r\x0b\x0c"
    _KINDS[_byte, 4] = _char in ".,;:?'\"-()"
    _KINDS[_byte, 5] = 32 < _byte < 127 and not _char.isalnum() and _char not in ".,;:?'\"-()|"
    _KINDS[_byte, 6] = _char == "|"


def text_statistics(text: str | None) -> list[float]:
    """The statistics of one whole text, in the order of FEATURES."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(FEATURES)
    size = len(raw)
    kinds = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _KINDS
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    n, n_lines = max(len(words), 1), max(len(lines), 1)
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    return [
        float(np.log1p(size)), float(np.log1p(len(words))), sum(map(len, words)) / n, len(counts) / n,
        max(counts.values(), default=0) / n, sum(map(bytes.__eq__, words, words[1:])) / n,
        kinds[0] / size, kinds[1] / max(kinds[0], 1.0), kinds[2] / size, kinds[3] / size, kinds[4] / size, kinds[5] / size, kinds[6] / size,
        sum(word[-1] in b"!#$%&*@^~|=<>" for word in words) / n, float(np.log1p(len(lines))), float(np.log1p(size / n_lines)),
        1.0 - len(set(lines)) / n_lines, len(zlib.compress(raw, 1)) / size, pairs / n,
    ]


@dataclass
class Trees:
    """Trees of equal depth in heap order: node i has the children 2i+1 (at most the threshold) and 2i+2."""

    start: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            while len(x) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -35, 35)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, step: float = 0.15, ridge: float = 1.0,
              least: float = 2.0) -> Trees:
    """Second-order boosting of the logistic loss; splits are sought in per-node histograms of binned features."""
    inner, leaves = 2**depth - 1, 2**depth
    if len(y) == 0 or y.min() == y.max():
        mean = float(y.mean()) if len(y) else 0.5
        odds = np.log(np.clip(mean, 0.01, 0.99) / (1 - np.clip(mean, 0.01, 0.99)))
        return Trees(float(odds), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    code = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)  # code <= b means x <= edges[b]
    offset = code + np.arange(width) * bins
    start = float(np.log(y.mean() / (1 - y.mean())))
    margin, grown = np.full(n, start), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width_nodes = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (width * bins) + offset).ravel()
            size = width_nodes * width * bins
            g = np.bincount(at, np.repeat(grad, width), size).reshape(width_nodes, width, bins).cumsum(2)
            h = np.bincount(at, np.repeat(hess, width), size).reshape(width_nodes, width, bins).cumsum(2)
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
            gain[(h < least) | (all_h - h < least)] = 0
            best = gain.reshape(width_nodes, -1).argmax(1)
            for k in range(width_nodes):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-6 and b < len(edges[f]):
                    feature[first + k], threshold[first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf_of = node - inner
        leaf = -step * np.bincount(leaf_of, grad, leaves) / (np.bincount(leaf_of, hess, leaves) + ridge)
        margin += leaf[leaf_of]
        grown.append((feature, threshold, leaf))
    return Trees(start, *(np.stack(part) for part in zip(*grown)))


def _statistics_column(text: str | Column) -> Column:
    @F.pandas_udf("array<double>")
    def statistics(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([text_statistics(t) for t in texts], dtype=object)

    return statistics(text)


def held_out(doc_id: Column) -> Column:
    """Rows never used for learning: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_quality(documents: DataFrame, labels: DataFrame, fit_rows: int = 20_000, **how) -> Trees:
    """Fit on at most ``fit_rows`` labelled documents outside the held-out quarter: those with the smallest id hashes.

    The sample is bounded, so it may be broadcast to the documents and its statistics collected.
    """
    known = (
        labels.select(F.col("doc_id").alias("doc"), F.col("quality").cast("int").alias("good"))
        .where("doc IS NOT NULL AND good IN (0, 1)").where(~held_out(F.col("doc")))
        .groupBy("doc").agg(F.max("good").alias("good"))
    )
    sample = known.orderBy(F.xxhash64("doc"), "doc").limit(fit_rows)
    texts = documents.select(F.col("doc_id").alias("doc"), F.col("text").alias("body"))
    joined = texts.join(F.broadcast(sample), "doc").select("doc", "good", _statistics_column("body").alias("x"))
    rows = sorted((r["doc"], r["good"], tuple(r["x"])) for r in joined.collect())
    x = np.array([r[2] for r in rows], dtype=np.float64).reshape(len(rows), len(FEATURES))
    return fit_trees(x, np.array([r[1] for r in rows], dtype=np.float64), **how)


def quality_score(trees: Trees, text: str | Column = "text") -> Column:
    """The score of a text column, between 0 and 1; higher means label 1 is likelier."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([text_statistics(t) for t in texts], dtype=np.float64).reshape(len(texts), len(FEATURES))
            yield pd.Series(trees.score(x))

    return score(text)


def score_quality(documents: DataFrame, labels: DataFrame, fit_rows: int = 20_000, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= threshold) of every document."""
    trees = fit_quality(documents, labels, fit_rows)
    scored = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), quality_score(trees).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(documents: DataFrame, labels: DataFrame, fit_rows: int = 20_000, threshold: float = 0.7) -> DataFrame:
    """The documents, with all their columns, whose text scores at least the threshold."""
    trees = fit_quality(documents, labels, fit_rows)
    return documents.where(quality_score(trees, F.col("text")) >= threshold)
