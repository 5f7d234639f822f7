"""Approximate nearest neighbours by a neighbour graph for each shard of the vectors.

Vectors are dealt to shards of bounded size by a hash of their id. In a shard, equal vectors are one node; each node is joined to
those of its exact nearest neighbours that no kept one is clearly nearer to (the pruning of Vamana, with a factor above one, so that
long edges stay), back along those edges, and to some nodes at random, which keeps the graph in one piece (four a node). A search walks each shard's graph
with a beam from a few entry nodes and merges the shards' best. Distances are of single precision.

A shard is built and searched in one task; its vectors and edges are one row, bounded by ``shard_rows``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators.ann import _unit

_SHARD = "shard int, n int, nodes binary, edges binary, ids binary, starts binary"


def _nearest_in(x: np.ndarray, some: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` nearest other nodes of some, nearest first, with their distances."""
    d = 1.0 - x[some] @ x.T
    d[np.arange(len(some)), some] = np.inf
    k = min(k, len(x) - 1)
    at = np.argpartition(d, k - 1, axis=1)[:, :k]
    near = np.take_along_axis(d, at, axis=1)
    order = np.argsort(near, axis=1, kind="stable")
    return np.take_along_axis(at, order, axis=1), np.take_along_axis(near, order, axis=1)


def pruned(x: np.ndarray, at: np.ndarray, near: np.ndarray, degree: int, alpha: float) -> list[np.ndarray]:
    """Of each row's candidates, nearest first, those that no kept one is ``alpha`` times nearer to than the node itself is, ``degree`` at most."""
    between = 1.0 - np.einsum("bid,bjd->bij", x[at], x[at])
    alive, kept = np.ones(at.shape, dtype=bool), np.zeros(at.shape, dtype=bool)
    room = np.full(len(at), degree)
    for i in range(at.shape[1]):
        take = alive[:, i] & (room > 0)
        kept[:, i] = take
        room -= take
        alive &= ~(take[:, None] & (alpha * between[:, i] <= near))
    return [a[k] for a, k in zip(at, kept, strict=True)]


def build_graph(x: np.ndarray, degree: int = 32, candidates: int = 96, alpha: float = 1.2, seed: int = 1) -> np.ndarray:
    """Edges of unit vectors, a row of ``degree`` nodes for each; rows that have fewer repeat their first."""
    n = len(x)
    if n < 2:
        return np.zeros((n, 1), dtype=np.int32)
    rng = np.random.default_rng(seed)
    out: list[list[int]] = []
    for a in range(0, n, 256):
        some = np.arange(a, min(a + 256, n))
        out += [e.tolist() for e in pruned(x, *_nearest_in(x, some, candidates), degree // 2, alpha)]
    back: list[list[int]] = [[] for _ in range(n)]
    for i, near in enumerate(out):
        for j in near:
            back[j].append(i)
    edges = np.empty((n, degree), dtype=np.int32)
    far = rng.integers(0, n, size=(n, 4))
    for i in range(n):
        own = list(dict.fromkeys([*out[i], *far[i].tolist(), *back[i]]))[:degree]
        edges[i] = own + own[:1] * (degree - len(own))
    return edges


def beam_search(x: np.ndarray, edges: np.ndarray, q: np.ndarray, k: int, beam: int = 64, entries: int = 8, seed: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
    """Nodes and distances of the ``k`` nearest that the walk meets, for each query at once, and how many vectors were compared."""
    n, m = len(x), len(q)
    beam = min(max(beam, k), n)
    start = np.unique(np.concatenate([[int(np.argmax(x @ x.mean(axis=0)))], np.random.default_rng(seed).integers(0, n, entries)]))
    seen = np.zeros((m, n), dtype=bool)
    seen[:, start] = True
    ids = np.full((m, beam), -1)
    dist = np.full((m, beam), np.inf)
    done = np.zeros((m, beam), dtype=bool)

    def merged(new: np.ndarray, d: np.ndarray) -> None:
        nonlocal ids, dist, done
        every, far = np.concatenate([ids, new], axis=1), np.concatenate([dist, d], axis=1)
        flags = np.concatenate([done, np.zeros(new.shape, dtype=bool)], axis=1)
        at = np.argsort(far, axis=1, kind="stable")[:, :beam]
        ids, dist, done = (np.take_along_axis(z, at, axis=1) for z in (every, far, flags))

    merged(np.repeat(start[None], m, axis=0), 1.0 - q @ x[start].T)
    rows = np.arange(m)
    while True:
        open_ = ~done & np.isfinite(dist)
        live = open_.any(axis=1)
        if not live.any():
            break
        first = open_.argmax(axis=1)
        done[rows[live], first[live]] = True
        near = edges[np.where(live, ids[rows, first], 0)]
        # a node that is repeated in a row, or seen before, isn't compared again
        order = np.argsort(near, axis=1, kind="stable")
        ranked = np.take_along_axis(near, order, axis=1)
        again = np.concatenate([np.zeros((m, 1), bool), ranked[:, 1:] == ranked[:, :-1]], axis=1)
        fresh = live[:, None] & ~again & ~seen[rows[:, None], ranked]
        seen[rows[:, None], ranked] |= live[:, None]
        d = np.full(ranked.shape, np.inf)
        at = np.nonzero(fresh)
        d[at] = 1.0 - np.einsum("id,id->i", q[at[0]], x[ranked[at]])
        merged(ranked, d)
    return ids[:, :k], dist[:, :k], int(seen.sum())


@dataclass
class GraphIndex:
    """Shards of vectors with their graphs under ``path``."""

    spark: SparkSession
    path: str
    length: int

    def search(self, queries: DataFrame, k: int, beam: int = 64, block: int = 256) -> DataFrame:
        """``query_id, id, distance, rank, compared``: the ``k`` nearest that a beam of ``beam`` nodes a shard meets, for queries that are rows (id and vector).

        Each block of queries meets each shard once. ``compared`` is the number of vectors that the query's block compared with, a query, over all shards. Vectors that
        are null are asked nothing.
        """
        named = queries.toDF("query_id", "vector").where("vector IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
        blocks = max(1, -(-named.count() // block))
        dealt = named.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("b")).agg(F.collect_list(F.struct("query_id", "vector")).alias("asked"))
        pairs = self.spark.read.parquet(f"{self.path}/shards").crossJoin(dealt)

        length = self.length

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for s in b.to_pylist():
                    x = np.frombuffer(s["nodes"], "<f4").reshape(s["n"], length)
                    edges = np.frombuffer(s["edges"], "<i4").reshape(s["n"], -1)
                    ids, starts = np.frombuffer(s["ids"], "<i8"), np.frombuffer(s["starts"], "<i4")
                    q = _unit(np.array([r["vector"] for r in s["asked"]])).astype(np.float32)
                    nodes, near, compared = beam_search(x, edges, q, k, beam)
                    out = []
                    for r, at, d in zip(s["asked"], nodes, near, strict=True):
                        own = [(float(v), int(i)) for a, v in zip(at.tolist(), d, strict=True) if a >= 0 and np.isfinite(v) for i in ids[starts[a] : starts[a + 1]][:k]]
                        # what was compared is told with the first row of each shard
                        out += [(r["query_id"], i, v, 0.0 if j else compared / len(q)) for j, (v, i) in enumerate(sorted(own)[:k])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], ["query_id", "id", "distance", "compared"])

        found = pairs.mapInArrow(run, "query_id long, id long, distance double, compared double")
        by = Window.partitionBy("query_id").orderBy("distance", "id")
        ranked = found.withColumn("compared", F.sum("compared").over(Window.partitionBy("query_id"))).withColumn("rank", F.row_number().over(by).cast("long"))
        return ranked.where(F.col("rank") <= k).select("query_id", "id", "distance", "rank", "compared")


def build_graph_index(
    vectors: DataFrame, path: str, shard_rows: int = 32_768, degree: int = 32, candidates: int = 96, alpha: float = 1.2, id_col: str = "vec_id", vector_col: str = "embedding"
) -> GraphIndex:
    """Writes the shards of all vectors that aren't null; they must have one length. A table without vectors gives an index that finds nothing."""
    rows = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    n, length = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    shards = max(1, -(-n // shard_rows))

    def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", kind="stable")
        x = _unit(np.stack(part["v"].to_numpy()))
        # equal vectors are one node, so that copies don't fill each other's edges
        nodes, own = np.unique(np.round(x, 7).astype(np.float32), axis=0, return_inverse=True)
        order = np.argsort(own.ravel(), kind="stable")
        starts = np.searchsorted(own.ravel()[order], np.arange(len(nodes) + 1))
        edges = build_graph(nodes, degree, candidates, alpha)
        ids = part["id"].to_numpy()[order]
        packed = [nodes.astype("<f4").tobytes(), edges.astype("<i4").tobytes(), ids.astype("<i8").tobytes(), starts.astype("<i4").tobytes()]
        return pd.DataFrame([[int(key[0]), len(nodes), *packed]], columns=["shard", "n", "nodes", "edges", "ids", "starts"])

    dealt = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard")).applyInPandas(build, _SHARD)
    dealt.write.mode("overwrite").parquet(f"{path}/shards")
    return GraphIndex(vectors.sparkSession, path, length or 1)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact neighbours (``query_id, id``) that were found."""
    hit, every = exact.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left").agg(F.count("hit"), F.count(F.lit(1))).first()
    return hit / every if every else 1.0
