"""Vectors: hashing embedder, blending, and exact nearest neighbours in blocks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

DIMENSIONS = 256
_TOKEN = re.compile(r"[^\W_]+")


def local_embed(text: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Signed feature hashing of lower-cased words, scaled to length one; no words give zeros.

    A word's SHA-256 gives its place (first two bytes) and sign (lowest bit of the third).
    """
    out = np.zeros(dimensions, dtype=np.float64)
    for word in _TOKEN.findall(text.lower()):
        h = hashlib.sha256(word.encode()).digest()
        out[(h[0] << 8 | h[1]) % dimensions] += 1.0 if h[2] & 1 else -1.0
    norm = np.linalg.norm(out)
    return (out / norm if norm else out).astype(np.float32)


@F.pandas_udf(ArrayType(FloatType()))
def embed(texts: pd.Series) -> pd.Series:
    return pd.Series([local_embed(t or "") for t in texts])


def blend(a: np.ndarray, b: np.ndarray, weight: float) -> np.ndarray:
    """``(1 - weight) a + weight b`` at length one; the ends of the scale give the vectors themselves."""
    if weight <= 0:
        return a
    if weight >= 1:
        return b
    out = (1 - weight) * a.astype(np.float64) + weight * b.astype(np.float64)
    norm = np.linalg.norm(out)
    return (out / norm if norm else out).astype(np.float32)


def cosine_distance(a: Column, b: Column) -> Column:
    """One minus the cosine; 1 if either vector is all zeros. For expressions over two columns;
    :func:`nearest` is the way to search."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    n = norm(a) * norm(b)
    return F.when(n == 0, 1.0).otherwise(1 - dot / F.when(n == 0, 1.0).otherwise(n))


def nearest(
    vectors: DataFrame, queries: Sequence[tuple[int, Sequence[float]]], k: int, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``query_id, id, distance, rank``: the exact ``k`` nearest by cosine distance, ties by id.

    ``queries`` is what one caller asks at once and travels to the executors; vectors are compared
    a batch at a time and every batch gives out ``k`` rows for each query.
    """
    ids = np.array([q for q, _ in queries], dtype=np.int64)
    matrix = np.array([v for _, v in queries], dtype=np.float64)
    if matrix.size and not np.isfinite(matrix).all():
        raise ValueError("a query vector isn't finite")
    norms = np.linalg.norm(matrix, axis=1, keepdims=True) if matrix.size else matrix
    unit = np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows or not len(ids):
                continue
            own = b.column(0).to_numpy(zero_copy_only=False)
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            n = np.linalg.norm(x, axis=1, keepdims=True)
            x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
            distance = 1.0 - unit @ x.T
            out = []
            for i, row in enumerate(distance):
                at = np.lexsort((own, row))[:k]
                out.append((np.full(len(at), ids[i]), own[at], row[at]))
            if out:
                columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "id", "distance"])

    near = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), vector_col).mapInArrow(
        run, "query_id long, id long, distance double"
    )
    by = Window.partitionBy("query_id").orderBy("distance", "id")
    return near.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def in_blocks(search: Callable[[list[tuple[int, Sequence[float]]]], DataFrame], queries: DataFrame, block: int = 4096) -> DataFrame:
    """What ``search`` finds for queries that are rows themselves (id and vector), in blocks of bounded size.

    Each block is a pass of its own; the driver holds one block at a time besides the plan.
    """
    found, held = None, []
    for q in queries.toLocalIterator():
        held.append((q[0], q[1]))
        if len(held) == block:
            found = search(held) if found is None else found.unionByName(search(held))
            held = []
    if held or found is None:
        found = search(held) if found is None else found.unionByName(search(held))
    return found


def nearest_of(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 4096) -> DataFrame:
    """:func:`nearest` for queries that are rows themselves, in blocks."""
    return in_blocks(lambda some: nearest(vectors, some, k, id_col, vector_col), queries, block)
