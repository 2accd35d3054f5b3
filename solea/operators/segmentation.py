"""Colour segmentation of images: Gaussian mixture per image, then label smoothing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solea.functions.batches import starts, whole_groups
from solea.operators.labelling import smooth_labels
from solea.operators.pixels import IMAGE, cluster_scores, rgb_to_ydbdr
from solea.session import cut_lineage

FEATURES = ("Y", "Db", "Dr")


def _terms(x: np.ndarray) -> np.ndarray:
    """1, x and the products of its components: what a mixture's mass, means and covariances are sums of."""
    return np.concatenate([np.ones((len(x), 1)), x, (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)], 1)


def _joint(x: np.ndarray, image: np.ndarray, weight: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Log of weight times density of every component at every row of x."""
    root = np.linalg.cholesky(cov)
    whole = np.log(weight + 1e-300) - np.log(np.einsum("ikdd->ikd", root)).sum(2) - 0.5 * x.shape[1] * np.log(2 * np.pi)
    square, white = np.zeros((len(x), weight.shape[1])), []
    for i in range(x.shape[1]):  # the root is a triangle: one component after the other
        left = x[:, i, None] - mean[:, :, i][image]
        for j, known in enumerate(white):
            left -= root[:, :, i, j][image] * known
        white.append(left / root[:, :, i, i][image])
        square += white[-1] ** 2
    return whole[image] - 0.5 * square


def _fit_mixtures(x: np.ndarray, n: np.ndarray, first: np.ndarray, starts: np.ndarray, max_iter: int, tol: float):
    """Mixtures of many images at once. ``x`` holds their distinct colours with pixel counts ``n``, image after image from ``first``;
    ``starts`` (image, component) are rows of x. An image stops for itself when its likelihood settles; only the others are worked on further."""
    images, k = starts.shape
    dims = x.shape[1]
    size = np.diff(np.append(first, len(x)))
    image = np.repeat(np.arange(images), size)
    pixels = np.add.reduceat(n, first)
    centre = np.add.reduceat(n[:, None] * x, first) / pixels[:, None]
    x = x - centre[image]  # sums of squares stay exact enough around an image's own mean
    spread = np.maximum(np.add.reduceat(n[:, None] * x * x, first) / pixels[:, None], 1e-6)
    weight, mean = np.full((images, k), 1.0 / k), x[starts]
    cov = np.repeat((spread[:, :, None] * np.eye(dims))[:, None], k, 1)
    likelihood, live, terms = [[] for _ in range(images)], np.arange(images), _terms(x)
    for _ in range(max_iter):
        joint = _joint(x, image, weight[live], mean[live], cov[live])
        top = joint.max(1)
        share = np.exp(joint - top[:, None])
        both = share.sum(1)
        total = np.add.reduceat((top + np.log(both)) * n, first)
        share *= (n / both)[:, None]
        sums = np.stack([np.add.reduceat(share[:, j, None] * terms, first) for j in range(k)], 1)
        mass = np.maximum(sums[:, :, 0], 1e-12)
        new_mean = sums[:, :, 1 : dims + 1] / mass[:, :, None]
        squares = sums[:, :, dims + 1 :].reshape(len(live), k, dims, dims)
        weight[live], mean[live] = mass / pixels[live][:, None], new_mean
        cov[live] = squares / mass[:, :, None, None] - new_mean[..., :, None] * new_mean[..., None, :] + 1e-6 * np.eye(dims)
        for i, value in zip(live, total):
            likelihood[i].append(float(value))
        going = np.array([len(likelihood[i]) < 2 or abs(likelihood[i][-1] - likelihood[i][-2]) >= tol for i in live])
        if not going.any():
            break
        if not going.all():
            kept = going[image]
            x, n, terms, size, live = x[kept], n[kept], terms[kept], size[going], live[going]
            first, image = np.cumsum(size) - size, np.repeat(np.arange(len(live)), size)
    return weight, mean + centre[:, None], cov, likelihood


IMAGES_TOGETHER = 200


def gmm_em(px: DataFrame, k: int = 3, max_iter: int = 80, tol: float = 1e-4, seed: int = 42, key: list[str] = IMAGE) -> DataFrame:
    """Mixture parameters per image, one row per component.

    Pixels are counted per distinct colour first; the colour tables of about ``IMAGES_TOGETHER`` images are fitted in one batch.
    """
    colours = px.groupBy(*key, *FEATURES).agg(F.count(F.lit(1)).alias("n"))
    types = dict(px.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in key) + ", k int, weight double, mean array<double>, inv array<double>, logdet double, loglik array<double>"

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*key, *FEATURES])
        keys = pdf[key].drop_duplicates().itertuples(index=False, name=None)
        first = np.flatnonzero(~pdf.duplicated(key).to_numpy())
        n, ends = pdf.n.to_numpy(np.float64), np.append(first[1:], len(pdf))
        starts, keys = [], list(keys)
        for own, a, b in zip(keys, first, ends):
            rng = np.random.default_rng([seed, *[zlib.crc32(str(v).encode()) for v in own]])
            drawn = np.sort(rng.uniform(0, n[a:b].sum(), k))  # pixels at random: a colour is drawn by its count
            starts.append(a + np.searchsorted(np.cumsum(n[a:b]), drawn, side="right"))
        w, m, c, history = _fit_mixtures(pdf[list(FEATURES)].to_numpy(np.float64), n, first, np.array(starts), max_iter, tol)
        inverse, logdet = np.linalg.inv(c), np.linalg.slogdet(c)[1]
        return pd.DataFrame([
            (*own, j, w[i, j], m[i, j], inverse[i, j].ravel(), logdet[i, j], history[i]) for i, own in enumerate(keys) for j in range(k)
        ], columns=[*key, "k", "weight", "mean", "inv", "logdet", "loglik"])

    batches = max(1, -(-px.select(*key).distinct().count() // IMAGES_TOGETHER))
    return colours.groupBy(F.pmod(F.xxhash64(*key), F.lit(batches)).alias("__batch")).applyInPandas(lambda pdf: fit(pdf), schema)


def likelihood_energies(px: DataFrame, params: DataFrame, k: int = 3, key: list[str] = IMAGE) -> DataFrame:
    """Per pixel the energy (negative log density) of each component as e0, e1, ... and the most likely ``label``."""
    per = params.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("k", "weight", "mean", "inv", "logdet"))).alias("__p"))
    df = px.join(per, key)
    energy = {}
    for j in range(k):
        p = F.get("__p", F.lit(j))
        d = [F.col(c) - F.get(p["mean"], F.lit(i)) for i, c in enumerate(FEATURES)]
        quad = sum((F.get(p["inv"], F.lit(3 * a + b)) * d[a] * d[b] for a in range(3) for b in range(3)), F.lit(0.0))
        energy[f"e{j}"] = 0.5 * (3 * float(np.log(2 * np.pi)) + p["logdet"] + quad)
    df = df.withColumns(energy)
    options = [F.struct((F.col(f"e{j}") - F.log(F.get("__p", F.lit(j))["weight"] + 1e-300)).alias("e"), F.lit(j).alias("j")) for j in range(k)]
    return df.withColumn("label", F.least(*options)["j"]).drop("__p")


def hmrf_icm(df: DataFrame, k: int = 3, beta: float = 1.5, max_sweeps: int = 30, tol: float = 1e-3, key: list[str] = IMAGE,
             columns: list[str] | None = None) -> DataFrame:
    """Sweep until fewer than ``tol`` of an image's pixels change, each image for itself: the same result as repeated ``icm_sweep``.

    The result has key, place, label and ``columns``, by default the energies. One shuffle brings the pixels of an image together; label planes of many images are swept in memory and nothing is stored between sweeps.
    """
    energy = [f"e{j}" for j in range(k)]
    keep = [*key, "row_no", "col_no", "label", *(energy if columns is None else columns)]
    types = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep)

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, key):
            first = np.flatnonzero(starts(pdf, key).to_numpy())
            row, col = pdf["row_no"].to_numpy(np.int64), pdf["col_no"].to_numpy(np.int64)
            size = np.maximum.reduceat(row, first) + 1, np.maximum.reduceat(col, first) + 1
            yield pdf[keep].assign(label=smooth_labels(pdf["label"].to_numpy(np.int64), pdf[energy].to_numpy(np.float64), row, col, *size, first, beta, max_sweeps, tol))

    dealt = df.select(*dict.fromkeys([*keep, *energy])).repartition(*key).sortWithinPartitions(*key, "row_no", "col_no")
    return dealt.mapInPandas(lambda batches: step(batches), schema)


def segment_foot(px: DataFrame, k: int = 3, beta: float = 1.5, seed: int = 42, key: list[str] = IMAGE) -> DataFrame:
    """Pixels with a boolean ``mask`` that is true on the foot cluster."""
    colour = cut_lineage(rgb_to_ydbdr(px))
    more = [c for c in colour.columns if c not in (*key, "row_no", "col_no")]
    labelled = cut_lineage(hmrf_icm(likelihood_energies(colour, gmm_em(colour, k, seed=seed, key=key), k, key), k, beta, key=key, columns=more))
    foot = cluster_scores(labelled, key).filter("foot").select(*key, F.col("label").alias("__foot"))
    return labelled.join(foot, key).withColumn("mask", F.col("label") == F.col("__foot")).drop("__foot", *FEATURES)
