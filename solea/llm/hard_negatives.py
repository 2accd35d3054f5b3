"""Hard negatives by an inverted multi-index: rows of another label whose score is near that of an anchor's best rows of its own label.

Vectors are cut into two halves; a k-means codebook for each half, fitted on a bounded sample, names a row's cell by its pair of codewords. The
inner product of an anchor with a row of a cell is at most the sum of two half-scores, anchor half times codeword plus anchor half's length
times the radius of the codeword's rows. The multi-sequence algorithm walks the cells of an anchor in falling order of that sum: a heap over the two sorted lists of half-scores.

Each search is two visits. The first walks cells until ``FIRST_ROWS`` rows are in them; what it finds there is a floor for the results.
The second walks to the first cell whose bound is below the floor: beyond it nothing can belong to the result, so the result is certified. Positives are
searched first (floor: the score of the last wanted row); their scores open the windows of the negatives, which are
searched in the same way (floor: the lowest of the windows' floors; a window that is not full has its own lower end as floor). A cell whose bound is above a window is
visited too, because the bound says nothing about its lowest row. Results are exact and do not depend on the sample.

Cells are packed into shards of at most ``SHARD_ROWS`` rows; a larger cell is dealt to several shards by a hash of the id. A shard is sent only to those blocks of
anchors that visit one of its cells, and a task looks at one shard and one block. On vectors without any clusters the bounds close few cells and the
work nears all anchors against all rows, in blocks.

Defined cases: rows with a null id or label, a null vector, or a null or non-finite component take no part; an empty vector is a vector of zeros, and a shorter one is filled up with zeros; a repeated
vec_id counts as many rows, but rows with the anchor's own vec_id are never its positives or negatives; an anchor without positives, and a positive without negatives, give no rows; products are
exact in doubles or, for larger components, in Python integers, and a score beyond 64 bits is an error; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solea.llm.vectors import matrix
from solea.session import store

SHARD_ROWS = 2048
BLOCK_ROWS = 2048
FIRST_ROWS = 1024
SLICE = 128
_WINDOWS = "array<struct<place: int, low: bigint, high: bigint>>"


@dataclass
class MultiIndex:
    """Two codebooks with the radii of their codewords, the rows of each cell, and the cells' shards."""

    codebooks: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    rows: np.ndarray  # of cell (first codeword, second codeword)
    shards: dict[int, range]  # of cell number

    @property
    def number(self) -> int:
        """Number of shards."""
        return max(s.stop for s in self.shards.values())

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.codebooks[0].shape[1]
        return x[:, :cut], x[:, cut:]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell of each row, and the distance of its halves to their codewords."""
        codes, far = [], []
        for half, book in zip(self.halves(x), self.codebooks):
            code = ((book**2).sum(1) - 2 * half @ book.T).argmin(1)
            codes.append(code)
            far.append(np.sqrt(((half - book[code]) ** 2).sum(1)))
        return codes[0] * len(self.codebooks[1]) + codes[1], far[0], far[1]

    def half_bounds(self, x: np.ndarray) -> list[np.ndarray]:
        """For each half, the most that it can add to the inner product with a row of each codeword."""
        out = []
        for half, book, radius in zip(self.halves(x), self.codebooks, self.radii):
            length = np.sqrt((half * half).sum(1))[:, None]
            exact = half @ book.T + length * np.maximum(radius, 0)
            slack = 1e-9 * (np.abs(half) @ np.abs(book).T + length * np.maximum(radius, 0) + 1)  # for rounding; only ever visits more
            out.append(np.where(radius >= 0, exact + slack, -np.inf))
        return out


def walk(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(bound, i, j) of all pairs of codewords in falling order of first[i] + second[j]: the multi-sequence algorithm. Codewords of bound -inf have no rows."""
    one, two = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    a, b = first[one].tolist(), second[two].tolist()
    heap, pushed = [(-(a[0] + b[0]), 0, 0)], {(0, 0)}
    while heap:
        bound, i, j = heapq.heappop(heap)
        if bound == np.inf:
            return
        yield -bound, int(one[i]), int(two[j])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in pushed:
                pushed.add((x, y))
                heapq.heappush(heap, (-(a[x] + b[y]), x, y))


def _k_means(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    random = np.random.default_rng(seed)
    centres = x[random.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        own = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        size = np.bincount(own, minlength=k)
        total = np.stack([np.bincount(own, x[:, j], k) for j in range(x.shape[1])], 1) if x.shape[1] else np.zeros((k, 0))
        centres[size > 0] = total[size > 0] / size[size > 0, None]
    return centres


def _whole_rows(embeddings: DataFrame, scale: int) -> tuple[DataFrame, int]:
    """(vec_id, label, v) of the rows that take part, with floor(scale * x) of each component as packed doubles, and the number of dimensions."""
    dims = max(1, embeddings.agg(F.max(F.size("embedding"))).first()[0] or 0)

    @F.pandas_udf("binary")
    def pack(vectors: pd.Series) -> pd.Series:
        out = []
        for x in vectors:
            x = None if x is None else np.asarray(x, np.float64)  # a null component becomes nan
            out.append(None if x is None or not np.isfinite(x).all() else (np.pad(np.floor(x * scale), (0, dims - len(x))) + 0.0).astype("<f8").tobytes())
        return pd.Series(out, dtype=object)

    there = embeddings.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    return there.select("vec_id", "label", pack("embedding").alias("v")).where("v IS NOT NULL"), dims


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] < 2**53:
        return (q @ x.T).astype(np.int64)
    exact = np.frompyfunc(int, 1, 1)
    return exact(q).dot(exact(x).T)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties by smaller id."""
    if len(score) > 8 * k and score.dtype != object:
        least = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= least)
        return near[np.lexsort((ids[near], -score[near]))[:k]]
    return np.array(sorted(range(len(score)), key=lambda i: (-score[i], ids[i]))[:k], int)


def _fit(rows: DataFrame, dims: int, words: int, sample_rows: int) -> tuple[MultiIndex, DataFrame]:
    """The index, fitted on at most ``sample_rows`` rows, and every row with its cell."""
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("v").collect()
    sample = matrix(pd.Series([r["v"] for r in drawn], dtype=object), dims)
    cut = (dims + 1) // 2
    books = tuple(_k_means(half, words, seed) for seed, half in enumerate((sample[:, :cut], sample[:, cut:])))
    index = MultiIndex(books, (np.full(words, -1.0), np.full(words, -1.0)), np.zeros((words, words), np.int64), {})

    @F.pandas_udf("cell int, far1 double, far2 double")
    def placed(v: pd.Series) -> pd.DataFrame:
        cell, far1, far2 = index.nearest(matrix(v, dims))
        return pd.DataFrame({"cell": cell.astype(np.int32), "far1": far1, "far2": far2})

    indexed, _ = store(rows.withColumn("p", placed("v")).select("vec_id", "label", "v", "p.*"), "cells")
    shard, filled = 0, 0
    for r in indexed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far1").alias("far1"), F.max("far2").alias("far2")).orderBy("cell").collect():  # at most words^2
        i, j = divmod(r["cell"], words)
        index.rows[i, j] = r["n"]
        index.radii[0][i], index.radii[1][j] = max(index.radii[0][i], r["far1"]), max(index.radii[1][j], r["far2"])
        parts = -(-r["n"] // SHARD_ROWS)
        if filled and (parts > 1 or filled + r["n"] > SHARD_ROWS):
            shard, filled = shard + 1, 0
        index.shards[r["cell"]] = range(shard, shard + parts)
        shard, filled = (shard + parts, 0) if parts > 1 else (shard, filled + r["n"])
    dealt = rows.sparkSession.createDataFrame([(c, s.start, len(s)) for c, s in index.shards.items()], "cell int, start int, parts int")
    number = F.col("start") + F.pmod(F.xxhash64("vec_id"), "parts").cast("int")
    return index, indexed.join(F.broadcast(dealt), "cell").select("vec_id", "label", "v", "cell", number.alias("shard"))


def _visits(index: MultiIndex, dims: int):
    """The shards that an anchor visits, and in each the cells: down to its floor, or without one until FIRST_ROWS rows are in the cells."""

    @F.pandas_udf("shards array<int>, cells array<binary>")
    def plan(vectors: pd.Series, floors: pd.Series) -> pd.DataFrame:
        out = []
        for start in range(0, len(vectors), SLICE):
            halves = index.half_bounds(matrix(vectors.iloc[start : start + SLICE], dims))
            for first, second, floor in zip(*halves, floors.iloc[start : start + SLICE]):
                met, cells = 0, {}
                for bound, i, j in walk(first, second):
                    if bound < floor or (floor != floor and met >= FIRST_ROWS):
                        break
                    met += index.rows[i, j]
                    cell = i * len(second) + j
                    for shard in index.shards.get(cell, ()):
                        cells.setdefault(shard, []).append(cell)
                out.append((list(cells), [np.array(c, "<i4").tobytes() for c in cells.values()]))
        return pd.DataFrame(out, columns=["shards", "cells"])

    return F.explode(F.arrays_zip(*(plan("v", "floor")[c].alias(c) for c in ("shards", "cells"))))


def _look(anchors: DataFrame, rows: DataFrame, index: MultiIndex, dims: int, same: bool, k: int) -> DataFrame:
    """(anchor, place, score, vec_id): of every shard that an anchor visits, the k best rows of its label, or of other labels inside each of its windows."""
    to = anchors.withColumn("to", _visits(index, dims))
    visits, _ = store(to.select("anchor", "vec_id", "label", "v", "block", "windows", F.col("to.shards").alias("shard"), F.col("to.cells").alias("cells")), "visits")
    pairs = visits.select(F.col("shard").alias("shard"), F.col("block").alias("block")).distinct()
    members = rows.join(pairs, "shard").select("shard", "block", *[F.col(c).alias(f"x_{c}") for c in ("vec_id", "label", "v", "cell")])

    def best(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        x, ids, labels, cells = matrix(own["x_v"], dims), own["x_vec_id"].to_numpy(), own["x_label"].to_numpy(), own["x_cell"].to_numpy()
        for start in range(0, len(asked), SLICE):
            part = asked.iloc[start : start + SLICE]
            for score, a in zip(_products(matrix(part["v"], dims), x), part.itertuples(index=False)):
                here = np.flatnonzero(np.isin(cells, np.frombuffer(a.cells, "<i4")) & ((labels == a.label) == same) & (ids != a.vec_id))
                for place, low, high in [(0, None, None)] if same else ((w["place"], w["low"], w["high"]) for w in a.windows):
                    fit = here if same else here[(score[here] >= low) & (score[here] <= high)]
                    out += [(a.anchor, place, int(score[i]), ids[i]) for i in fit[_best(score[fit], ids[fit], k)]]
        return pd.DataFrame(out, columns=["anchor", "place", "score", "vec_id"]).astype({"anchor": np.int64, "place": np.int32, "score": np.int64, "vec_id": np.int64})

    found = visits.groupBy("shard", "block").cogroup(members.groupBy("shard", "block")).applyInPandas(lambda a, b: best(a, b), "anchor long, place int, score long, vec_id long")
    return store(found, "found")[0]


def _first(found: DataFrame, k: int) -> DataFrame:
    """The k best of each anchor and place, with their rank."""
    order = Window.partitionBy("anchor", "place").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(embeddings: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, words: int = 32,
                   sample_rows: int = 8192) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of ``embeddings`` (vec_id, label, embedding) that ``anchors`` selects.

    A negative has another label and a score of ``low`` to ``high`` percent of the positive's.
    """
    rows, dims = _whole_rows(embeddings, scale)
    rows, _ = store(rows, "whole-rows")
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if rows.isEmpty():
        return embeddings.sparkSession.createDataFrame([], empty)
    index, rows = _fit(rows, dims, words, sample_rows)
    chosen, _ = store(rows.where(anchors), "chosen")
    together = max(1, index.number * BLOCK_ROWS // max(1, chosen.count()))  # shards whose anchors form a block, about BLOCK_ROWS of them
    no_windows = F.lit(None).cast(_WINDOWS)
    asked = chosen.select("vec_id", "label", "v", F.floor(F.col("shard") / together).alias("block"))
    asked, _ = store(asked.select(F.monotonically_increasing_id().alias("anchor"), "*"), "anchors")

    def search(asked: DataFrame, same: bool, k: int, floor: Callable[[DataFrame], DataFrame]) -> DataFrame:
        near = _look(asked.withColumn("floor", F.lit(None).cast("double")), rows, index, dims, same, k)
        certified = asked.join(floor(_first(near, k)), "anchor", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        return _first(_look(certified, rows, index, dims, same, k), k)

    def last(found: DataFrame) -> DataFrame:  # the score of the last wanted row, where all are there
        return found.groupBy("anchor").agg(F.when(F.count("*") == positives, F.min("score")).cast("double").alias("floor"))

    best = search(asked.withColumn("windows", no_windows), True, positives, last)
    best, _ = store(best.select("anchor", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    score = "CAST(positive_score AS decimal(20, 0))"  # a negative score has an empty window
    ends = best.where("positive_score >= 0").select("anchor", "place", F.expr(f"({score} * {low} + 99) DIV 100").alias("low"), F.expr(f"({score} * {high}) DIV 100").alias("high"))
    windows = ends.groupBy("anchor").agg(F.collect_list(F.struct("place", "low", "high")).alias("windows"))  # at most ``positives`` of an anchor

    def lowest(found: DataFrame) -> DataFrame:  # the lowest floor of the anchor's windows
        kth = found.groupBy("anchor", "place").agg(F.when(F.count("*") == negatives, F.min("score")).alias("kth"))
        return ends.join(kth, ["anchor", "place"], "left").groupBy("anchor").agg(F.min(F.coalesce("kth", "low")).cast("double").alias("floor"))

    worst = search(asked.join(windows, "anchor"), False, negatives, lowest)
    pairs = worst.select("anchor", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = pairs.join(best, ["anchor", "place"]).join(asked.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
  s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, CAST(list_sum([z[1] * z[2] FOR z IN list_zip(a.v, b.v)]) AS BIGINT) AS score
        FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
  p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
        SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE own = label) WHERE n <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE s.own <> s.label AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score) WHERE rank <= 3
"""
