"""Forests of full depth whose trees are never whole in one place.

Values become at most 32 bins per feature. The top of all trees grows level by level: tasks sum class weights per node, drawn feature and bin, and one
row per split reaches the driver. A node of at most ``SMALL`` rows is finished in one task, which scores the test rows that fall into the node and
returns their leaf shares, or the gain of each feature; the node's tree is then dropped. So the driver holds the top alone, about 2 * rows / SMALL nodes
a tree, and a task holds one node's rows.

Tables are ``(id bigint, y 0 or 1, x array<double>)`` with unique ids. Which rows a tree draws follows from its number and the row's id, which features a node
draws from its tree and place: a repeated task gives the same trees. A null or NaN value is in the highest bin. A node without a split that
lowers the Gini impurity is a leaf. Without rows of both classes every score is the training share.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solea.session import release, store

SMALL = 16_384  # rows of a node that one task finishes
BINS = 32
DEPTH = 30
_NODES = 2048  # nodes whose histograms are held at once
_POISSON = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880)])
_BLOCK = "n int, ids binary, y binary, bins binary"


def _edges(train: DataFrame, size: int) -> np.ndarray:
    """Upper bounds of the bins of each feature: approximate quantiles, padded with infinity."""
    shares = [(i + 1) / BINS for i in range(BINS - 1)]
    value = lambda i: F.nanvl(F.get("x", F.lit(i)).cast("double"), F.lit(None).cast("double"))
    found = train.agg(*[F.percentile_approx(value(i), shares, 1000).alias(f"q{i}") for i in range(size)]).first()
    edges = np.full((size, BINS - 1), np.inf)
    for i in range(size):
        distinct = np.unique(found[i] or [])
        edges[i, : len(distinct)] = distinct
    return edges


def _blocks(df: DataFrame, edges: np.ndarray) -> DataFrame:
    """Binned rows, packed: one row of the result per batch."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array(pdf.x.to_list(), dtype=float).reshape(len(pdf), len(edges))
            x[np.isnan(x)] = np.inf
            bins = np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)], axis=1).astype(np.uint8)
            yield pd.DataFrame({"n": [len(pdf)], "ids": [pdf.id.to_numpy(np.int64).tobytes()], "y": [pdf.y.to_numpy(np.uint8).tobytes()], "bins": [bins.tobytes()]})

    return df.select(F.col("id").cast("bigint").alias("id"), F.col("y").cast("int").alias("y"), "x").mapInPandas(pack, _BLOCK)


def _unpack(r, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(r.ids, np.int64), np.frombuffer(r.y, np.uint8), np.frombuffer(r.bins, np.uint8).reshape(r.n, size)


def binned_blocks(train: DataFrame, size: int) -> DataFrame:
    """Rows packed in blocks, each value as the number of its bin."""
    return _blocks(train, _edges(train, size))


def joined_blocks(pdf: pd.DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and bins of all rows of some blocks."""
    joined = lambda c, kind: np.frombuffer(b"".join(pdf[c]), kind)
    return joined("ids", np.int64), joined("y", np.uint8), joined("bins", np.uint8).reshape(-1, size)


def _draws(ids: np.ndarray, tree: int, seed: int, bootstrap: bool) -> np.ndarray:
    """How often the tree draws each row: Poisson with mean 1 out of a hash of the id."""
    if not bootstrap:
        return np.ones(len(ids), dtype=np.uint8)
    h = ids.view(np.uint64) + np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    h ^= h >> np.uint64(31)
    return np.searchsorted(_POISSON, (h >> np.uint64(11)) / 2.0**53, side="right").astype(np.uint8)


def _drawn_features(rng: np.random.Generator, nodes: int, size: int) -> np.ndarray:
    """The square root of all features for each node, without repeats."""
    m = max(1, isqrt(size - 1) + 1)
    return np.argpartition(rng.random((nodes, size)), m - 1, axis=1)[:, :m]


def _rng(seed: int, tree: int, node: int) -> np.random.Generator:
    return np.random.default_rng((seed, tree, node))


def _histograms(node: np.ndarray, nodes: int, bins: np.ndarray, y: np.ndarray, weight: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """Weight and weight of class 1 per (node, drawn feature, bin)."""
    m = drawn.shape[1]
    cell = (node[:, None] * m + np.arange(m)) * BINS + np.take_along_axis(bins, drawn[node], axis=1)
    cells = nodes * m * BINS
    both = [np.bincount(cell.ravel(), np.repeat(w, m), cells) for w in (weight, weight * y)]
    return np.stack(both).reshape(2, nodes, m, BINS)


def _best(hist: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per node the drawn feature's position, the last bin of the left side and the gain; a gain of 0 means a leaf."""
    left, one = hist.cumsum(axis=3)
    all_, ones = left[:, :, -1:], one[:, :, -1:]
    left, one = left[:, :, :-1], one[:, :, :-1]
    right = all_ - left
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = one * (left - one) / left + (ones - one) * (right - ones + one) / right
        before = (ones * (all_ - ones) / all_)[:, 0, 0]
    spread = np.where((left > 1e-9) & (right > 1e-9 * all_), spread, np.inf).reshape(len(before), -1)
    at = spread.argmin(axis=1)
    gain = before - spread[np.arange(len(at)), at]
    return at // (BINS - 1), at % (BINS - 1), np.where(gain > 1e-9 * all_[:, 0, 0], gain, 0.0)


def _finish(bins: np.ndarray, y: np.ndarray, weight: np.ndarray, depth: int, rng: np.random.Generator):
    """A whole subtree: feature (-1 at leaves), last left bin, left child (the right one is next) and share of class 1 per node; gain per feature."""
    size = bins.shape[1]
    gains = np.zeros(size)
    total, one = weight.sum(), (weight * y).sum()
    feature, cut, child, share = [np.array([-1])], [np.array([0])], [np.array([0])], [np.array([one / total])]
    rows, node, width, count = np.arange(len(y)), np.zeros(len(y), dtype=np.int64), 1, 1
    if not 0 < one < total:
        rows, node = rows[:0], node[:0]
    while len(rows) and depth < DEPTH:
        order = node.argsort(kind="stable")
        rows, node = rows[order], node[order]
        f, c, g = np.full(width, -1), np.zeros(width, dtype=np.int64), np.zeros(width)
        for low in range(0, width, _NODES):
            high = min(low + _NODES, width)
            a, b = np.searchsorted(node, (low, high))
            if a < b:
                drawn = _drawn_features(rng, high - low, size)
                i = rows[a:b]
                at, last, gain = _best(_histograms(node[a:b] - low, high - low, bins[i], y[i], weight[i], drawn))
                f[low:high] = np.where(gain > 0, drawn[np.arange(high - low), at], -1)
                c[low:high], g[low:high] = last, gain
        split = f >= 0
        gains += np.bincount(f[split], g[split], size)
        first = np.where(split, np.cumsum(split) * 2 - 2, 0)
        feature[-1], cut[-1], child[-1] = f, c, first + count
        keep = split[node]
        rows, node = rows[keep], node[keep]
        node = first[node] + (bins[rows, f[node]] > c[node])
        width = 2 * int(split.sum())
        if not width:
            break
        count += width
        total, one = np.bincount(node, weight[rows], width), np.bincount(node, weight[rows] * y[rows], width)
        feature.append(np.full(width, -1)), cut.append(np.zeros(width, dtype=np.int64)), child.append(np.zeros(width, dtype=np.int64)), share.append(one / total)
        mixed = ((one > 0) & (one < total - 1e-9 * total))[node]
        rows, node = rows[mixed], node[mixed]
        depth += 1
    return *map(np.concatenate, (feature, cut, child, share)), gains


def _descend(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, child: np.ndarray) -> np.ndarray:
    """The node without a further split that each row ends in."""
    node = np.zeros(len(bins), dtype=np.int64)
    going = np.flatnonzero(feature[node] >= 0)
    while len(going):
        at = node[going]
        node[going] = child[at] + (bins[going, feature[at]] > cut[at])
        going = going[feature[node[going]] >= 0]
    return node


class Forest:
    """The top of ``trees`` trees, grown on ``train``; the rest grows inside ``probabilities`` and ``importances``."""

    def __init__(self, train: DataFrame, trees: int, bootstrap: bool, balanced: bool, seed: int):
        self.spark, self.trees, self.bootstrap, self.seed = train.sparkSession, trees, bootstrap, seed
        self.size = len(train.first().x)
        self.edges = _edges(train, self.size)
        self.blocks, self.path = store(_blocks(train, self.edges), "blocks")
        n = {r.y: r["count"] for r in train.groupBy("y").count().collect()}
        self.rows = sum(n.values())
        self.weights = np.array([self.rows / (len(n) * n[y]) if balanced and y in n else 1.0 for y in (0, 1)])
        # per tree: feature, last left bin, left child, share of class 1 (NaN: finished elsewhere), depth; one list entry per node
        self.top = [([-1], [0], [0], [np.nan], [0]) for _ in range(trees)]
        self.gains = np.zeros((trees, self.size))
        open_ = [(tree, 0) for tree in range(trees)] if self.rows > SMALL else []
        while open_:
            open_ = [node for low in range(0, len(open_), _NODES) for node in self._split(open_[low : low + _NODES])]

    def _arrays(self):
        return {tree: [np.array(column) for column in nodes] for tree, nodes in enumerate(self.top)}

    def _split(self, wanted: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Split the given nodes of the top; the children that are still too large for a task."""
        seed, size, weights, bootstrap = self.seed, self.size, self.weights, self.bootstrap
        slots: dict[int, list[tuple[int, int]]] = {}
        for slot, (tree, node) in enumerate(wanted):
            slots.setdefault(tree, []).append((node, slot))
        top = {tree: nodes for tree, nodes in self._arrays().items() if tree in slots}

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            drawn = {tree: np.concatenate([_drawn_features(_rng(seed, tree, node), 1, size) for node, _ in nodes]) for tree, nodes in slots.items()}
            sums: dict[int, np.ndarray] = {}
            for pdf in batches:
                for r in pdf.itertuples():
                    ids, y, bins = _unpack(r, size)
                    for tree, nodes in slots.items():
                        times = _draws(ids, tree, seed, bootstrap)
                        place = np.full(len(top[tree][0]), -1)
                        place[[node for node, _ in nodes]] = np.arange(len(nodes))
                        at = place[_descend(bins, *top[tree][:3])]
                        i = np.flatnonzero((at >= 0) & (times > 0))
                        hist = _histograms(at[i], len(nodes), bins[i], y[i], times[i] * weights[y[i]], drawn[tree])
                        rows = _histograms(at[i], len(nodes), bins[i], y[i], np.ones(len(i)), drawn[tree])[:1]
                        sums[tree] = sums.get(tree, 0) + np.concatenate([hist, rows])
            for tree, total in sums.items():
                slot = [s for _, s in slots[tree]]
                yield pd.DataFrame({"tree": tree, "slot": slot, "node": [n for n, _ in slots[tree]], "hist": [total[:, k].tobytes() for k in range(len(slot))]})

        def choose(pdf: pd.DataFrame) -> pd.DataFrame:
            tree, slot, node = (int(pdf[c].iloc[0]) for c in ("tree", "slot", "node"))
            drawn = _drawn_features(_rng(seed, tree, node), 1, size)
            total = sum(np.frombuffer(h) for h in pdf["hist"]).reshape(3, 1, drawn.shape[1], BINS)
            at, last, gain = (v[0] for v in _best(total[:2]))
            left, all_ = total[:, 0, at, : last + 1].sum(axis=1), total[:, 0, at].sum(axis=1)
            side = lambda s: [s[2], s[1] / s[0] if s[0] > 0 else 0.0]
            parts = [*side(all_), *side(left), *side(all_ - left)]
            return pd.DataFrame([[slot, int(drawn[0, at]), int(last), float(gain), *map(float, parts)]], columns=columns)

        columns = ["slot", "feature", "last", "gain", "n", "p", "n_left", "p_left", "n_right", "p_right"]
        schema = "slot int, feature int, last int, " + ", ".join(f"{c} double" for c in columns[3:])
        found = self.blocks.mapInPandas(count, "tree int, slot int, node int, hist binary").groupBy("slot").applyInPandas(choose, schema).collect()
        large = []
        for r in sorted(found):
            tree, node = wanted[r.slot]
            feature, cut, child, share, depth = self.top[tree]
            if r.gain <= 0:
                share[node] = r.p
                continue
            self.gains[tree, r.feature] += r.gain
            feature[node], cut[node], child[node] = r.feature, r.last, len(feature)
            for n, p in ((r.n_left, r.p_left), (r.n_right, r.p_right)):
                leaf = depth[node] + 1 >= DEPTH or not 1e-12 < p < 1 - 1e-12
                if not leaf and n > SMALL:
                    large.append((tree, len(feature)))
                for column, value in zip(self.top[tree], (-1, 0, 0, p if leaf else np.nan, depth[node] + 1)):
                    column.append(value)
        return large

    def _dealt(self, blocks: DataFrame, test: bool, parts: int) -> DataFrame:
        """Packed rows of each (tree, node, part) that a task finishes. Training rows go to every part, a test row to one."""
        seed, size, bootstrap, top = self.seed, self.size, self.bootstrap, self._arrays()

        def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for r in pdf.itertuples():
                    ids, y, bins = _unpack(r, size)
                    for tree, (feature, cut, child, share, _) in top.items():
                        node = _descend(bins, feature, cut, child)
                        times = np.ones(r.n, dtype=np.uint8) if test else _draws(ids, tree, seed, bootstrap)
                        part = ids % parts if test else np.zeros(r.n, dtype=np.int64)
                        key = np.where(np.isnan(share[node]) & (times > 0), node * parts + part, -1)
                        order = key.argsort(kind="stable")
                        order = order[key[order] >= 0]
                        cuts = np.flatnonzero(np.diff(key[order], prepend=-1))
                        groups = np.split(order, cuts[1:]) if len(order) else []
                        yield pd.DataFrame([
                            (tree, int(node[i[0]]), p, test, len(i), ids[i].tobytes(), y[i].tobytes(), times[i].tobytes(), bins[i].tobytes())
                            for i in groups for p in ([int(part[i[0]])] if test else range(parts))
                        ], columns=names)

        names = ["tree", "node", "part", "test", "n", "ids", "y", "times", "bins"]
        return blocks.mapInPandas(deal, "tree int, node int, part int, test boolean, n int, ids binary, y binary, times binary, bins binary")

    def _finished(self, dealt: DataFrame, result, schema: str) -> DataFrame:
        seed, size, weights = self.seed, self.size, self.weights
        depth = {tree: nodes[4] for tree, nodes in enumerate(self.top)}

        def finish(pdf: pd.DataFrame) -> pd.DataFrame:
            tree, node, test = int(pdf.tree.iloc[0]), int(pdf.node.iloc[0]), pdf.test.to_numpy(bool)
            joined = lambda c, mask, kind: np.frombuffer(b"".join(pdf[c][mask]), kind)
            ids = joined("ids", ~test, np.int64)
            order = ids.argsort(kind="stable")  # sums do not depend on the order of arrival
            y, bins = joined("y", ~test, np.uint8)[order], joined("bins", ~test, np.uint8).reshape(-1, size)[order]
            weight = joined("times", ~test, np.uint8)[order] * weights[y]
            wanted = joined("ids", test, np.int64), joined("bins", test, np.uint8).reshape(-1, size)
            if not len(y):  # no drawn row fell here
                return result(tree, None, *wanted)
            return result(tree, _finish(bins, y, weight, depth[tree][node], _rng(seed, tree, node)), *wanted)

        return dealt.groupBy("tree", "node", "part").applyInPandas(finish, schema)

    def probabilities(self, test: DataFrame) -> DataFrame:
        """``test (id, y)`` with ``prob``, the mean over all trees of the leaf's share of class 1."""
        blocks, path = store(_blocks(test, self.edges), "blocks")
        parts = max(1, -(-test.count() // self.rows))
        size, trees, top = self.size, self.trees, self._arrays()

        def leaves(tree: int, grown, ids: np.ndarray, bins: np.ndarray) -> pd.DataFrame:
            feature, cut, child, share, _ = grown or (np.array([-1]), np.array([0]), np.array([0]), np.array([0.5]), None)
            return pd.DataFrame({"id": ids, "share": share[_descend(bins, feature, cut, child)]})

        def shallow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for r in pdf.itertuples():
                    ids, _, bins = _unpack(r, size)
                    for feature, cut, child, share, _ in top.values():
                        found = share[_descend(bins, feature, cut, child)]
                        known = ~np.isnan(found)
                        yield pd.DataFrame({"id": ids[known], "share": found[known]})

        dealt = self._dealt(self.blocks, False, parts).unionByName(self._dealt(blocks, True, parts))
        shares = self._finished(dealt, leaves, "id bigint, share double").unionByName(blocks.mapInPandas(shallow, "id bigint, share double"))
        per = shares.groupBy("id").agg((F.sum(F.round(F.col("share") * 2**40).cast("bigint")) / F.lit(2.0**40 * trees)).alias("prob"))
        per, _ = store(per, "probabilities")
        release(self.spark, path, self.path)
        return test.select("id", "y").join(per, "id")

    def importances(self) -> np.ndarray:
        """Summed weighted gain per feature, as a share of its tree, averaged over the trees; trees x features numbers reach the driver."""
        def gained(tree: int, grown, ids: np.ndarray, bins: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({"tree": tree, "feature": np.arange(len(grown[4])), "gain": grown[4]})

        found = self._finished(self._dealt(self.blocks, False, 1), gained, "tree int, feature int, gain double")
        gains = self.gains.copy()
        for r in found.groupBy("tree", "feature").agg(F.sort_array(F.collect_list("gain")).alias("g")).select("tree", "feature", F.aggregate("g", F.lit(0.0), lambda a, g: a + g).alias("gain")).collect():
            gains[r.tree, r.feature] += r.gain
        release(self.spark, self.path)
        total = gains.sum(axis=1, keepdims=True)
        mean = np.divide(gains, total, out=np.zeros_like(gains), where=total > 0).mean(axis=0)
        return mean / mean.sum() if mean.sum() > 0 else mean
