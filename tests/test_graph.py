"""The neighbour graph: recall at its defaults, copies, odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions.vectors import nearest_of
from corvane.operators import graph

KIND = "vec_id long, embedding array<float>"


def unit(x):
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


@pytest.mark.parametrize("kind", ["clustered", "uniform"])
def test_recall_at_the_defaults(kind):
    rng = np.random.default_rng(4)
    n = 16_000
    x = rng.normal(size=(n, 64))
    if kind == "clustered":
        x = 0.35 * x + rng.normal(size=(150, 64))[rng.integers(0, 150, n)]
    x = unit(x)
    asked = x[::100]
    nodes, near, compared = graph.beam_search(x, graph.build_graph(x), asked, 10)
    exact = np.argsort(-(asked @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(nodes, exact)]) >= 0.9
    assert compared / len(asked) / n < 0.1
    assert np.allclose(near, 1 - np.einsum("qd,qkd->qk", asked, x[nodes]), atol=1e-5)


def test_index_against_the_exact_scan(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 16))
    x[200:500] = x[7]  # a common vector
    rows = [(i, [float(v) for v in e]) for i, e in enumerate(x)] + [(9999, None)]
    df = spark.createDataFrame(rows, KIND).withColumn("label", F.lit(1)).repartition(3)
    asked = df.where("vec_id % 50 = 3 OR vec_id = 7").select("vec_id", "embedding")
    index = graph.build_graph_index(df, str(tmp_path / "g"), shard_rows=400)
    assert spark.read.parquet(str(tmp_path / "g" / "shards")).count() == 4
    found = index.search(asked, 10, block=8).cache()
    exact = nearest_of(df, asked, 10).cache()
    other = exact.where("query_id % 50 <> 0 AND query_id NOT BETWEEN 200 AND 499 AND query_id <> 7")
    assert graph.recall(found, other) >= 0.95
    copies = [r.id for r in found.where("query_id = 7").orderBy("rank").collect()]
    assert copies == [7, *range(200, 209)]
    assert found.groupBy("query_id").count().where("count <> 10").isEmpty()
    assert found.where("compared > 1500 OR compared <= 0").isEmpty()


def test_small_and_empty_indexes(spark, tmp_path):
    asked = spark.createDataFrame([(1, [1.0, 0.0])], KIND)
    none = graph.build_graph_index(asked.limit(0), str(tmp_path / "a"))
    assert none.search(asked, 3).collect() == []
    few = graph.build_graph_index(spark.createDataFrame([(5, [0.0, 2.0]), (6, [3.0, 0.0]), (6, [3.0, 0.0])], KIND), str(tmp_path / "b"))
    assert [(r.id, round(r.distance, 5)) for r in few.search(asked, 3).orderBy("rank").collect()] == [(6, 0.0), (6, 0.0), (5, 1.0)]
    assert few.search(asked.limit(0), 3).collect() == []
