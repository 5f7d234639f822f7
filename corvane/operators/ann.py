"""Approximate nearest neighbours: vectors in cells around centroids, of which a search reads the nearest few.

Centroids are fitted on a bounded sample; every vector is in the index. Distances of what is read are exact, so a result can only
miss neighbours that lie in cells that weren't read; with all cells it is that of the exact scan.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def fit_centroids(x: np.ndarray, cells: int, rounds: int = 20, seed: int = 1) -> np.ndarray:
    """Spherical k-means; a cell that loses all its vectors keeps its centroid."""
    x = _unit(np.asarray(x, dtype=np.float64))
    rng = np.random.default_rng(seed)
    at = x[rng.choice(len(x), min(cells, len(x)), replace=False)] if len(x) else np.zeros((1, x.shape[1] if x.ndim == 2 else 1))
    for _ in range(rounds):
        own = np.argmax(x @ at.T, axis=1) if len(x) else np.zeros(0, dtype=np.int64)
        moved = at.copy()
        for c in range(len(at)):
            if (own == c).any():
                moved[c] = x[own == c].sum(axis=0)
        moved = _unit(moved)
        if np.allclose(moved, at):
            break
        at = moved
    return at


@dataclass
class CellIndex:
    """Vectors by cell under ``path``."""

    spark: SparkSession
    path: str
    centroids: np.ndarray

    def search(self, queries: Sequence[tuple[int, Sequence[float]]], k: int, probes: int = 8) -> DataFrame:
        """``query_id, id, distance, rank``: the ``k`` nearest among the vectors of each query's ``probes`` nearest cells.

        ``queries`` is what one caller asks at once. Only the folders of those cells are read.
        """
        ids = np.array([q for q, _ in queries], dtype=np.int64)
        unit = _unit(np.array([v for _, v in queries], dtype=np.float64)) if len(ids) else np.zeros((0, self.centroids.shape[1]))
        if unit.size and not np.isfinite(unit).all():
            raise ValueError("a query vector isn't finite")
        near = np.argsort(-(unit @ self.centroids.T), axis=1, kind="stable")[:, :probes]
        asking: dict[int, np.ndarray] = {int(c): np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near)}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                cell, own = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                x = _unit(b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1))
                out = []
                for c in np.unique(cell):
                    here = np.flatnonzero(cell == c)
                    distance = 1.0 - unit[asking[int(c)]] @ x[here].T
                    for q, row in zip(asking[int(c)], distance, strict=True):
                        at = np.lexsort((own[here], row))[:k]
                        out.append((np.full(len(at), ids[q]), own[here][at], row[at]))
                if out:
                    columns = [np.concatenate(x) for x in zip(*out, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["query_id", "id", "distance"])

        rows = self.spark.read.parquet(f"{self.path}/cells").where(F.col("cell").isin(sorted(asking))).select(F.col("cell").cast("int").alias("cell"), "id", "embedding")
        found = rows.mapInArrow(run, "query_id long, id long, distance double")
        by = Window.partitionBy("query_id").orderBy("distance", "id")
        return found.withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= k)


def build_cells(
    vectors: DataFrame, path: str, cells: int = 64, sample_rows: int = 20_000, splits: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 1
) -> CellIndex:
    """Fits ``cells`` centroids on at most ``sample_rows`` vectors, and writes all vectors by their nearest one; null vectors are left out.

    A cell that many vectors fall in is spread over ``splits`` files.
    """
    rows = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("embedding"))
    picked = rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample_rows).collect()
    centroids = fit_centroids(np.array([r.embedding for r in picked]) if picked else np.zeros((0, 1)), cells, seed=seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                cell = np.argmax(_unit(x) @ centroids.T, axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32())], ["id", "embedding", "cell"])

    dealt = rows.mapInArrow(run, "id long, embedding array<float>, cell int").repartition("cell", F.pmod(F.xxhash64("id"), F.lit(splits)))
    dealt.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
    return CellIndex(vectors.sparkSession, path, centroids)
