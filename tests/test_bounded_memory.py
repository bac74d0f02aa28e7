import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.operators import ann, search


def batch(x, first=0):
    return pa.record_batch([pa.array(np.arange(first, first + len(x))), pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))], ["id", "vector"])


@pytest.mark.parametrize("rows, product, held", [(2000, 1_000_000, 1_000_000), (7, 30, 20)])
def test_nearest_equals_brute_force(monkeypatch, rows, product, held):
    """Ties in rounded scores, copies of one vector, zero and NaN vectors, a query without a direction."""
    for name, value in (("ROWS", rows), ("PRODUCT", product), ("HELD", held)):
        monkeypatch.setattr(search, name, value)
    draw = np.random.default_rng(1)
    x = np.concatenate([draw.integers(-2, 3, (300, 3)), np.ones((50, 3)), [[0, 0, 0], [np.nan, 1, 1]]]).astype(float)
    q = draw.normal(size=(20, 3)) / 1.0
    q = np.concatenate([q / np.linalg.norm(q, axis=1, keepdims=True), [[np.nan] * 3]])
    near = search.Nearest(pa.array(np.arange(21)), q, 4, 2)
    for a in range(0, len(x), 60):
        near.add(batch(x[a : a + 60], a))
    got = [tuple(r.values()) for b in near.found() for r in b.to_pylist()]
    with np.errstate(invalid="ignore"):
        s = np.round(q @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T, 2)
    want = [(i, int(j), s[i, j]) for i in range(20) for j in sorted(np.flatnonzero(np.isfinite(s[i])), key=lambda j: (-s[i, j], j))[:4]]
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want] and [c for *_, c in got] == pytest.approx([c for *_, c in want])


def test_memory_does_not_grow_with_queries():
    draw = np.random.default_rng(2)
    q = draw.normal(size=(6000, 8))
    b = batch(draw.normal(size=(10_000, 8)))
    near = search.Nearest(pa.array(np.arange(6000)), q / np.linalg.norm(q, axis=1, keepdims=True), 5, 6)
    tracemalloc.start()
    near.add(b)
    found = sum(map(len, near.found()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 30_000 and peak < 200e6  # all products at once: 480 MB, and three copies


def test_lists_in_blocks_of_queries(spark, tmp_path, monkeypatch):
    """The same from blocks of eight queries as from one."""
    draw = np.random.default_rng(3)
    x = draw.normal(size=(500, 8))
    points = spark.createDataFrame([(k, v.tolist(), k % 3) for k, v in enumerate(x)], "id long, vector array<float>, label int")
    path = str(tmp_path / "ann")
    ann.build(points, path, counted=("label",))
    queries = points.filter("id % 10 = 0").select(F.col("id").alias("query_id"), "vector")
    run = lambda where: [tuple(r) for r in ann.search(spark, path, queries, 3, rerank=30, probes=10, digits=6, where=where).orderBy("query_id", "rank").collect()]
    want = [run(None), run(F.col("label") == 1)]
    monkeypatch.setattr(ann, "KEPT", 100)
    assert [run(None), run(F.col("label") == 1)] == want and len(want[0]) == 150
