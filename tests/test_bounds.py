"""Exact search by bounds against scoring all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import bounds
from corvane.operators.search import batch_search


def rows(df):
    return [(r.query_id, r.rank, r.id, round(r.score, 9), r.payload.tag) for r in df.orderBy("query_id", "rank").collect()]


def table(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), v.tolist(), int(i) % 3) for i, v in zip(ids, x)], "id long, vector array<double>, tag int")


@pytest.mark.parametrize("digits", [9, 2])
@pytest.mark.parametrize("kind", ["clusters", "plain", "copies"])
def test_same_as_all_pairs(spark, tmp_path, kind, digits, monkeypatch):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(600, 12))
    if kind == "clusters":
        x = draw.normal(size=(8, 12))[draw.integers(8, size=600)] + 0.05 * x
    if kind == "copies":
        x = np.round(x[draw.integers(9, size=600)], 1)  # ties go to smaller ids, whichever folder holds them
    points = table(spark, x)
    queries = points.filter("id % 7 = 0").select(F.col("id").alias("query_id"), "vector")
    monkeypatch.setattr(bounds, "BLOCK_COMPONENTS", 400)  # three blocks of queries
    assert bounds.build(points, f"{tmp_path}/i") in (9, 24)
    found = bounds.search(spark, f"{tmp_path}/i", queries, 4, digits=digits)
    assert rows(found) == rows(batch_search(points, queries, 4, digits=digits))
    if digits == 9:
        skipped = bounds.work(spark, f"{tmp_path}/i", queries, found, 4)
        assert skipped > 0.5 if kind == "clusters" else 0 <= skipped <= 1


def test_visited_folders_alone_are_read(spark, tmp_path):
    draw = np.random.default_rng(4)
    x = np.repeat(np.eye(10), 30, 0) + 0.01 * draw.normal(size=(300, 10))
    bounds.build(table(spark, x), f"{tmp_path}/i", 10)
    meta = bounds._meta(spark, f"{tmp_path}/i")
    visits = bounds._possible(bounds._angles(x[:1], meta.pivots), meta, bounds._reach(np.array([0.99]), None))
    scan = bounds._scan(spark, f"{tmp_path}/i", meta, x[:1], visits, np.array([0.99]), 5, None)
    plan = scan._jdf.queryExecution().toString()
    assert visits.sum() < 10 and "PartitionFilters: [pivot" in plan.replace("isnotnull(pivot", "pivot") and "Exchange" not in plan
    assert scan.count() == 5


def test_odd_vectors_and_few_points(spark, tmp_path):
    schema = "id long, vector array<double>, tag int"
    points = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [0.0, 0.0], 2), (3, None, 3), (4, [-2.0, 0.0], 4), (5, [1.0, 0.0], 5)], schema)
    queries = spark.createDataFrame([(9, [3.0, 0.0]), (8, [0.0, 0.0]), (7, None)], "query_id long, vector array<double>")
    bounds.build(points, f"{tmp_path}/a")
    assert rows(bounds.search(spark, f"{tmp_path}/a", queries)) == [(9, 1, 1, 1.0, 1), (9, 2, 5, 1.0, 5), (9, 3, 4, -1.0, 4)]
    assert bounds.search(spark, f"{tmp_path}/a", queries.limit(0)).count() == 0
    assert bounds.build(points.limit(0), f"{tmp_path}/b") == 0
    assert bounds.search(spark, f"{tmp_path}/b", queries).count() == 0


def test_what_tasks_get_grows_with_queries_and_pivots_alone(spark, tmp_path, monkeypatch):
    """Not with their product, but for a bit a pair."""
    draw = np.random.default_rng(6)
    points = table(spark, draw.normal(size=(300, 4)))
    bounds.build(points, f"{tmp_path}/i", 100)
    meta, sent = bounds._meta(spark, f"{tmp_path}/i"), []
    context = type(spark.sparkContext)
    monkeypatch.setattr(context, "broadcast", lambda self, value, f=context.broadcast: (sent.append(value), f(self, value))[1])
    bounds._scan(spark, f"{tmp_path}/i", meta, draw.normal(size=(2000, 4)), np.ones((2000, 100), bool), np.full(2000, -2.0), 3, None)
    assert sum(x.nbytes for x in sent[0]) < 200_000
