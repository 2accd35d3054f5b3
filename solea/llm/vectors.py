"""Vectors as packed doubles: which rows take part, and classes of equal vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def packed(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, key, v) of every row, and the number of dimensions.

    ``v`` holds little-endian doubles, shorter vectors filled up with zeros; ``key`` is a 128-bit hash of them. Both are null for rows that take no
    part: null id, null or zero vector, null or non-finite components.
    """
    dims = embeddings.agg(F.max(F.size("embedding"))).first()[0] or 0

    @F.pandas_udf("key binary, v binary")
    def pack(vectors: pd.Series) -> pd.DataFrame:
        rows = []
        for x in vectors:
            x = None if x is None else np.asarray(x, dtype=np.float64)
            if x is None or not len(x) or not np.isfinite(x).all() or not x.any():
                rows.append((None, None))
            else:
                raw = (np.pad(x, (0, dims - len(x))) + 0.0).astype("<f8").tobytes()
                rows.append((xxhash.xxh3_128_digest(raw), raw))
        return pd.DataFrame(rows, columns=["key", "v"])

    found = embeddings.select("vec_id", pack("embedding").alias("p"))
    fit = F.col("vec_id").isNotNull()
    return found.select("vec_id", F.when(fit, F.col("p.key")).alias("key"), F.when(fit, F.col("p.v")).alias("v")), int(dims)


def matrix(column: pd.Series, dims: int) -> np.ndarray:
    """Packed vectors as the rows of one array."""
    return np.frombuffer(b"".join(column), "<f8").reshape(len(column), dims)


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that large components do not overflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with the same row of b, in double precision; a pair gives the same bits wherever it is computed."""
    a, b = a / np.abs(a).max(1, keepdims=True), b / np.abs(b).max(1, keepdims=True)
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
