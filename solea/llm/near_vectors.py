"""Near-duplicate vectors by product quantisation, complete by its bounds.

A coarse k-means over a bounded sample gives inverted lists; residuals to a list's centroid are coded subspace by subspace. Every distinct vector
is indexed. Two unit vectors with cosine >= t are at most r = sqrt(2 - 2t) apart. So a vector needs to look only into lists whose
border with its own list is within r and whose radius plus r reaches it: those probes are sufficient. Inside a list the
distance to a member's decoded code, less the member's own coding error, is a lower bound of the true distance; a block of probes meets a
shard's decoded codes in one product of matrices. What passes the bound is reranked by the exact cosine.
Nothing that is linked can fail a bound, so the result does not depend on the sample.

Work is dealt out as (shard of members, block of probing vectors): shards hold whole lists or, for a list beyond ``SHARD_ROWS``, an even part of
it; each unordered pair of shards is looked at from one side. A task returns counts and a spanning set of links, never all pairs.

Defined cases: rows that take no part (null id, null or zero vector, null or non-finite components) have no links and are their own
component; equal vectors form one class whose members are linked to each other; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solea.llm.components import connected_components
from solea.llm.vectors import cosines, matrix, packed, unit_rows
from solea.session import store

SHARD_ROWS = 8192
PROBE_ROWS = 16384
BATCH = 128
SLACK = 1e-6  # for rounding in single precision; only ever adds candidates


@dataclass
class Quantiser:
    """Coarse centroids, and for each subspace the codewords of residuals."""

    centroids: np.ndarray
    spaces: list[slice]
    words: list[np.ndarray]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances to all centroids, and the nearest one."""
        d = np.maximum((x * x).sum(1)[:, None] + (self.centroids**2).sum(1) - 2 * x @ self.centroids.T, 0)
        return d, d.argmin(1)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        residual = x - self.centroids[lists]
        codes = np.stack([_closest(residual[:, s], w) for s, w in zip(self.spaces, self.words)], 1).astype(np.uint8)
        return codes, np.concatenate([w[codes[:, m]] for m, w in enumerate(self.words)], 1) + self.centroids[lists]


def _closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)


def _k_means(x: np.ndarray, k: int, random: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[random.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        own = _closest(x, centres)
        size = np.bincount(own, minlength=k)
        total = np.stack([np.bincount(own, x[:, j], k) for j in range(x.shape[1])], 1)
        centres[size > 0] = total[size > 0] / size[size > 0, None]
    return centres


def fit_quantiser(sample: np.ndarray, lists: int, subspaces: int = 16, codewords: int = 256) -> Quantiser:
    random = np.random.default_rng(5)
    centroids = _k_means(sample, lists, random)
    residual = sample - centroids[_closest(sample, centroids)]
    edges = np.linspace(0, sample.shape[1], min(subspaces, sample.shape[1]) + 1).astype(int)
    spaces = [slice(a, b) for a, b in zip(edges, edges[1:])]
    return Quantiser(centroids, spaces, [_k_means(residual[:, s], codewords, random, 6) for s in spaces])


def _spanning(members: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest member reachable over the pairs (x, y) of positions in ``members``."""
    label = members.copy()
    while True:
        low = np.minimum(label[x], label[y])
        after = label.copy()
        np.minimum.at(after, x, low)
        np.minimum.at(after, y, low)
        if (after == label).all():
            return label
        label = after


def _shard_links(own: pd.DataFrame, probes: pd.DataFrame, model: Quantiser, dims: int, cosine: float) -> pd.DataFrame:
    """Counts and a spanning set of the links between one shard's members and one block of probing vectors."""
    columns = ["node", "links", "root"]
    if not len(own) or not len(probes):
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in columns})
    reach = np.sqrt(2 - 2 * cosine)
    raw, asked_raw = matrix(own["v"], dims), matrix(probes["v"], dims)
    lists = own["list"].to_numpy()
    unit = unit_rows(raw)
    rebuilt = model.encode(unit, lists)[1]
    error = np.sqrt(((unit - rebuilt) ** 2).sum(1))
    # x and a member are unit vectors apart by at least |x - rebuilt| - error; |x - rebuilt|^2 = 1 + |rebuilt|^2 - 2 x.rebuilt
    least = ((1.0 + (rebuilt**2).sum(1) - (reach + error) ** 2) / 2 - 5 * SLACK).astype(np.float32)
    decoded = np.ascontiguousarray(rebuilt.T, dtype=np.float32)
    nodes, weight = own["node"].to_numpy(), own["copies"].to_numpy()
    asked, asked_weight = probes["node"].to_numpy(), probes["copies"].to_numpy()
    home = probes["home"].to_numpy(bool)
    found_x, found_y = [], []
    for first in range(0, len(probes), BATCH):
        q = unit_rows(asked_raw[first : first + BATCH])
        open_lists = _open_lists(q, model, reach, None)
        x, y = np.nonzero(q.astype(np.float32) @ decoded >= least)
        keep = open_lists[x, lists[y]]
        x, y = x[keep] + first, y[keep]
        once = ~home[x] | (asked[x] < nodes[y])  # inside a shard each pair is counted once, and nothing with itself
        x, y = x[once], y[once]
        exact = cosines(asked_raw[x], raw[y]) >= cosine if len(x) else np.zeros(0, bool)
        found_x.append(x[exact])
        found_y.append(y[exact])
    x, y = np.concatenate(found_x) if found_x else np.zeros(0, int), np.concatenate(found_y) if found_y else np.zeros(0, int)
    together = np.unique(np.concatenate([asked[x], nodes[y]]))
    px, py = np.searchsorted(together, asked[x]), np.searchsorted(together, nodes[y])
    links = np.bincount(px, weight[y], len(together)) + np.bincount(py, asked_weight[x], len(together))
    return pd.DataFrame({"node": together, "links": links.astype(np.int64), "root": _spanning(together, px, py)})


def _open_lists(q: np.ndarray, model: Quantiser, reach: float, radius: np.ndarray | None) -> np.ndarray:
    """Which lists may hold a vector within reach: the border with the own list is within reach, and so is the list's ball."""
    d, own = model.nearest(q)
    gap = np.sqrt(np.maximum(((model.centroids[own][:, None] - model.centroids[None]) ** 2).sum(2), 1e-18)) if len(q) * len(model.centroids) < 1 << 16 else np.sqrt(
        np.maximum((model.centroids[own] ** 2).sum(1)[:, None] + (model.centroids**2).sum(1) - 2 * model.centroids[own] @ model.centroids.T, 1e-18))
    open_ = (d - d[np.arange(len(q)), own][:, None]) <= 2 * gap * reach + 1e-9
    if radius is not None:
        open_ &= np.sqrt(d) <= radius + reach + 1e-9
    open_[np.arange(len(q)), own] = True
    return open_


def near_vectors(embeddings: DataFrame, cosine: float = 0.95, sample_rows: int = 8192, most_lists: int = 4096) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector; the quantiser is fitted on at most ``sample_rows`` distinct vectors."""
    rows, dims = packed(embeddings)
    rows, _ = store(rows, "vectors")
    classes = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("v").alias("v"))
    sample = matrix(pd.Series([r["v"] for r in classes.orderBy(F.xxhash64("key")).limit(sample_rows).select("v").collect()], dtype=object), dims) if dims else np.zeros((0, 0))
    if not len(sample):
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    count = classes.count()
    model = fit_quantiser(unit_rows(sample), int(min(most_lists, max(1, 2 ** round(np.log2(np.sqrt(count)))))))
    reach = float(np.sqrt(2 - 2 * cosine))

    @F.pandas_udf("list int, far double")
    def listed(v: pd.Series) -> pd.DataFrame:
        d, own = model.nearest(unit_rows(matrix(v, dims)))
        return pd.DataFrame({"list": own.astype(np.int32), "far": np.sqrt(d[np.arange(len(own)), own])})

    indexed, _ = store(classes.withColumn("l", listed("v")).select("node", "copies", "v", "l.list", "l.far"), "indexed")
    told = indexed.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).orderBy("list").collect()  # one row for each list
    radius = np.full(len(model.centroids), -np.inf)
    shards: dict[int, tuple[int, int]] = {}  # list -> first shard, number of shards
    shard, filled = 0, 0
    for r in told:
        radius[r["list"]] = r["far"]
        parts = -(-r["n"] // SHARD_ROWS)
        if parts > 1 or filled + r["n"] > SHARD_ROWS:
            shard, filled = shard + (filled > 0), 0
        shards[r["list"]] = (shard, parts)
        shard, filled = (shard + parts, 0) if parts > 1 else (shard, filled + r["n"])
    blocks = -(-count // PROBE_ROWS)

    @F.pandas_udf("shard int, visits array<int>")
    def dealt(node: pd.Series, v: pd.Series, own: pd.Series) -> pd.DataFrame:
        open_ = _open_lists(unit_rows(matrix(v, dims)), model, reach, radius)
        mixed = (node.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        home = [shards[k][0] + int(m) % shards[k][1] for k, m in zip(own, mixed)]
        visits = [sorted({s for k in np.flatnonzero(o) if k in shards for s in range(shards[k][0], sum(shards[k])) if s > h} | {h}) for o, h in zip(open_, home)]
        return pd.DataFrame({"shard": np.array(home, np.int32), "visits": visits})

    placed, _ = store(indexed.withColumn("d", dealt("node", "v", "list")).select("node", "copies", "v", "list", "d.shard", "d.visits"), "dealt")
    members = placed.select("node", "copies", "v", "list", "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    block = F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("block")
    probes = placed.select("node", "copies", "v", F.col("shard").alias("own"), F.explode("visits").alias("shard"), block).withColumn("home", F.col("own") == F.col("shard"))
    probes = probes.select("node", "copies", "v", "shard", "block", "home")

    def linked(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        return _shard_links(own, asked, model, dims, cosine)

    found, _ = store(members.groupBy("shard", "block").cogroup(probes.groupBy("shard", "block")).applyInPandas(linked, "node long, links long, root long"), "links")
    labels = connected_components(found.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.select("key", "node", "copies").join(links, "node", "left").join(labels, "node", "left")
    out = rows.select("vec_id", "key").join(named, "key", "left")
    component = F.coalesce("label", "node", "vec_id")
    return out.select(
        "vec_id", (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), component.cast("long").alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"))
