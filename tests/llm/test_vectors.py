"""Operators on vectors against all pairs, with copies, ties and rows that take no part."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from solea.llm import near_vectors, neighbours
from solea.llm.components import connected_components
from tests.llm.conftest import DATA


@pytest.fixture(scope="module")
def vectors(spark):
    base = spark.read.parquet(f"{DATA}/embeddings.parquet")
    first = base.orderBy("vec_id").limit(1)
    copies = first.crossJoin(spark.range(150).select((F.col("id") + 100_000).alias("new"))).select(F.col("new").alias("vec_id"), "embedding", "label")
    random = np.random.default_rng(1)
    centre = random.normal(size=64)
    close = [(200_000 + k, (centre + random.normal(size=64) * 0.2).tolist(), None) for k in range(120)]
    odd = [(300_000, None, 1), (300_050, [0.0] * 64, 1), (300_100, [float("nan")] + [1.0] * 63, 1), (300_150, [None] + [1.0] * 63, 1), (300_200, [], 1), (300_250, [0.5] * 32, 1), (None, [1.0] * 64, 1)]
    shape = "vec_id long, embedding array<float>, label int"
    return base.select("vec_id", "embedding", "label").union(copies).union(spark.createDataFrame(close + odd, shape)).withColumn("key", F.lit(1)).withColumn("v", F.lit(2)).cache()


@pytest.fixture(scope="module")
def known(vectors):
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    fit = sorted((i, v) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v))
    x = np.stack([np.pad(np.array(v, np.float64), (0, 64 - len(v))) for _, v in fit])
    x /= np.linalg.norm(x, axis=1)[:, None]
    return np.array([i for i, _ in fit]), x @ x.T


@pytest.mark.parametrize("shard_rows", [8192, 40])
def test_links_and_components_are_complete(vectors, known, monkeypatch, shard_rows):
    monkeypatch.setattr(near_vectors, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(near_vectors, "PROBE_ROWS", 2 * shard_rows)
    ids, cosine = known
    linked = cosine >= 0.95
    np.fill_diagonal(linked, False)
    label = ids.copy()
    for _ in range(50):
        label = np.array([min(label[i], label[linked[i]].min()) if linked[i].any() else label[i] for i in range(len(ids))])
    rows = near_vectors.near_vectors(vectors).collect()
    found = {r["vec_id"]: r for r in rows}
    assert len(rows) == vectors.count()
    assert [found[i]["n_links"] for i in ids] == linked.sum(1).tolist() and [found[i]["component_id"] for i in ids] == label.tolist()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows)
    assert all(found[i]["n_links"] == 0 and found[i]["component_id"] == i for i in (300_000, 300_050, 300_100, 300_150, 300_200))


def test_neighbours_recall_and_order(vectors, known):
    ids, cosine = known
    np.fill_diagonal(cosine := cosine.copy(), -9)
    rows = neighbours.nearest_neighbours(vectors, F.col("vec_id") % 50 == 0, k=5).collect()
    queries = [i for i in ids if i % 50 == 0]
    met = 0
    for q in queries:
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in rows if r["query_id"] == q)
        scores = cosine[np.searchsorted(ids, q)]
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5] and q not in [v for _, v, _ in own]
        assert all(abs(s - scores[np.searchsorted(ids, v)]) < 1e-9 for _, v, s in own) and own == sorted(own, key=lambda r: (-r[2], r[1]))
        met += sum(s >= np.sort(scores)[-5] - 1e-9 for _, _, s in own)
    assert len(rows) == 5 * len(queries) and met >= 0.9 * len(rows)


def test_few_or_no_vectors(spark, vectors):
    few = vectors.where("vec_id IN (0, 100000, 100001)")
    rows = neighbours.nearest_neighbours(few, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in rows] == [(0, 100000), (0, 100001), (100000, 0), (100000, 100001)]
    empty = vectors.where("false")
    assert near_vectors.near_vectors(empty).count() == 0 and neighbours.nearest_neighbours(empty, F.col("vec_id") % 50 == 0).count() == 0
    assert near_vectors.near_vectors(vectors.where("vec_id = 300050")).first()["kept"]


def test_hadamard_is_orthogonal():
    h = neighbours.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16)) and np.allclose(np.abs(h), 0.25)


def test_components_of_chains_and_stars(spark):
    pairs = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(1000, 1100)] + [(3, 3), (None, 5), (9, 8), (8, 9)]
    found = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {found[k] for k in range(100, 161)} == {100} and {found[k] for k in range(1000, 1100)} == {7} and found[9] == 8


def test_a_block_of_probes_meets_a_shard_without_gathering_vectors_for_pairs():
    import tracemalloc

    x = near_vectors.unit_rows(np.random.default_rng(3).normal(size=(4096, 64)))
    x[1::8] = near_vectors.unit_rows(x[0::8] + 0.01 * np.random.default_rng(4).normal(size=(512, 64)))
    model = near_vectors.fit_quantiser(x[::4], 16, codewords=32)
    own = pd.DataFrame({"node": np.arange(4096), "copies": 1, "v": [r.tobytes() for r in x], "list": model.nearest(x)[1], "home": True})
    tracemalloc.start()
    got = near_vectors._shard_links(own, own, model, 64, 0.95)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    assert dict(zip(got["node"], got["links"])) == {i: n for i, n in enumerate(near.sum(1)) if n}
    assert peak < 24e6
