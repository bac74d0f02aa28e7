"""Exact cosine search that skips what can't be among the best, by pivots and angles.

``build`` puts each point with its nearest pivot, a direction, writes it into that pivot's folder with its angle to the
pivot, and keeps the least and greatest angle of each folder. The angle between a query and a point is at least the
difference of their angles to any pivot. ``search`` first visits the nearest folders of each query, which hold enough points to
give it a k-th score, then those folders alone where some point could reach that score, and in these the points that
could. Other folders are pruned (PartitionFilters), nothing of the index is shuffled, and a task keeps the best of a
query over all it reads. The result is that of ``search.batch_search``.

What is skipped depends on the data: with clusters nearly everything, without any structure nothing. ``work`` tells.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.vectors import normalized
from corvane.operators.search import BLOCK_COMPONENTS, BROADCAST_ROWS, ROWS, TOP_K, Nearest, _asked
from corvane.tables import stored

#: Rows a pivot that pivots are fitted on, pivots at most (they go to every task), vectors in a file of a folder, about.
SAMPLE, MOST, PART = 40, 16_384, 20_000
#: Numbers in the largest product that a task or the driver makes, and what rounding may take from an angle.
PRODUCT, SLACK = 1_000_000, 1e-6


def _unit(vectors: pa.Array) -> np.ndarray:
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


@dataclass(frozen=True)
class Meta:
    """Pivots with the number of their points and the range of these points' angles, and the index's columns."""

    pivots: np.ndarray
    sizes: np.ndarray
    least: np.ndarray
    greatest: np.ndarray
    schema: T.StructType


def build(points: DataFrame, path: str, pivots: int = 0, iterations: int = 5, seed: int = 1) -> int:
    """Writes the index of ``points`` (id, vector, payload) to ``path`` and returns the number of pivots.

    ``pivots`` is the square root of the number of points unless given. Only the choice of pivots rests on a sample, which
    changes no result. Points whose vector is null or zero are left out, as they have no score.
    """
    spark = points.sparkSession
    points = stored(points.filter(F.exists("vector", lambda x: x != 0)))
    n = points.count()
    pivots = max(1, min(pivots or round(math.sqrt(n)), MOST, n))
    some = points.filter(F.xxhash64("id") / F.lit(2.0**64) + 0.5 < SAMPLE * pivots / n) if n > SAMPLE * pivots else points
    centres = np.zeros((0, 0))
    if n:
        first = _unit(points.select("vector").limit(1).toArrow()["vector"].combine_chunks())
        centres = first
        if pivots > 1:
            vectors = some.select(array_to_vector(normalized("vector")).alias("features"))
            found = np.array(KMeans(k=pivots, maxIter=iterations, seed=seed).fit(vectors).clusterCenters())
            length = np.linalg.norm(found, axis=1, keepdims=True)
            centres = np.where(length > 1e-9, found / np.maximum(length, 1e-9), first)
    shared = spark.sparkContext.broadcast(centres)
    schema = T.StructType([*points.schema, T.StructField("pivot", T.IntegerType()), T.StructField("angle", T.DoubleType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        step = max(1, PRODUCT // max(1, len(centres)))
        for batch in batches:
            for a in range(0, len(batch), step):
                b = batch.slice(a, step)
                angles = _angles(_unit(b["vector"]), centres)
                at = angles.argmin(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32()), pa.array(angles[np.arange(len(at)), at])], names=schema.names)

    placed = stored(points.mapInArrow(assign, schema))
    told = placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("least"), F.max("angle").alias("greatest"))
    told = {r.pivot: r for r in told.collect()}  # one row a pivot
    rows = [(k, c.tolist(), *((told[k].n, told[k].least, told[k].greatest) if k in told else (0, 0.0, 0.0))) for k, c in enumerate(centres)]
    table = spark.createDataFrame(rows, "pivot int, centre array<double>, n long, least double, greatest double")
    parts = placed.join(F.broadcast(table.select("pivot", F.ceil(F.col("n") / PART).alias("parts"))), "pivot")
    parts = parts.withColumn("_part", F.pmod(F.xxhash64("id"), "parts").cast("int")).drop("parts")
    parts.repartition("pivot", "_part").sortWithinPartitions("pivot", "angle").drop("_part").write.mode("overwrite").partitionBy("pivot").parquet(f"{path}/points")
    kept = T.StructType([*points.schema, schema["angle"], schema["pivot"]])
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/pivots")
    spark.createDataFrame([(json.dumps(kept.jsonValue()),)], "told string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    return len(centres)


def _meta(spark: SparkSession, path: str) -> Meta:
    rows = spark.read.parquet(f"{path}/pivots").orderBy("pivot").collect()  # at most MOST
    schema = T.StructType.fromJson(json.loads(spark.read.parquet(f"{path}/meta").first().told))
    numbers = np.array([(r.n, r.least, r.greatest) for r in rows], float).reshape(-1, 3)
    return Meta(np.array([r.centre for r in rows], float), numbers[:, 0].astype(np.int64), numbers[:, 1], numbers[:, 2], schema)


def _first(angles: np.ndarray, meta: Meta, k: int) -> np.ndarray:
    """(query, pivot): the nearest folders of each query that hold ``k`` points together."""
    order = np.argsort(np.where(meta.sizes > 0, angles, np.inf), axis=1, kind="stable")
    sizes = meta.sizes[order]
    out = np.zeros(angles.shape, bool)
    np.put_along_axis(out, order, (np.cumsum(sizes, 1) - sizes < k) & (sizes > 0), 1)
    return out


def _reach(scores: np.ndarray, digits: int | None) -> np.ndarray:
    """The greatest angle at which a point may still have a score; scores are rounded to ``digits``."""
    return np.arccos(np.clip(scores - (0 if digits is None else 10.0**-digits), -1, 1)) + SLACK


def _possible(angles: np.ndarray, meta: Meta, reach: np.ndarray) -> np.ndarray:
    """(query, pivot): folders where some point may be within reach."""
    gap = np.maximum(angles - meta.greatest, meta.least - angles)
    return (gap <= reach[:, None]) & (meta.sizes > 0)


def _of_few(q: np.ndarray, meta: Meta, choose: Callable[[np.ndarray, slice], np.ndarray]) -> np.ndarray:
    """(query, pivot): what ``choose`` makes of the angles, of few queries at a time."""
    out = np.zeros((len(q), len(meta.pivots)), bool)
    step = max(1, PRODUCT // max(1, len(meta.pivots)))
    for a in range(0, len(q), step):
        at = slice(a, a + step)
        out[at] = choose(_angles(q[at], meta.pivots), at)
    return out


def _scan(spark: SparkSession, path: str, meta: Meta, q: np.ndarray, visits: np.ndarray, scores: np.ndarray, k: int, digits: int | None) -> DataFrame:
    """(row, id, score): the best ``k`` that each task reads for each query, among points of the visited folders that reach ``scores``."""
    folders = np.flatnonzero(visits.any(0))
    points = spark.read.schema(meta.schema).parquet(f"{path}/points").filter(F.col("pivot").isin(folders.tolist()))
    shared = spark.sparkContext.broadcast((q, np.packbits(visits.T, axis=1), meta.pivots, scores))
    ids = meta.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, visits, centres, least = shared.value
        near = Nearest(pa.array(np.arange(len(q))), q, k, digits)
        near.least = np.maximum(near.least, least)
        for batch in batches:
            pivots = batch["pivot"].to_numpy(zero_copy_only=False)
            for p in np.unique(pivots):
                mine = np.flatnonzero(pivots == p)
                who = np.flatnonzero(np.unpackbits(visits[p], count=len(q)))
                own = _angles(q[who], centres[p : p + 1])[:, 0]  # made anew, as those of all folders grow with queries and pivots
                for at in range(0, len(mine), ROWS):
                    b = batch.take(pa.array(mine[at : at + ROWS]))
                    angle = b["angle"].to_numpy(zero_copy_only=False)
                    step = max(1, PRODUCT // len(b))
                    for a in range(0, len(who), step):
                        some = who[a : a + step]
                        gap = np.abs(own[a : a + step, None] - angle)
                        columns = np.flatnonzero((gap <= _reach(near.least[some], digits)[:, None]).any(0))
                        if len(columns):
                            near.add(b.take(pa.array(columns)).select(["id", "vector"]), some)
        for found in near.found():
            yield pa.RecordBatch.from_arrays(found.columns, names=["row", "id", "score"])

    return points.select("id", "vector", "angle", "pivot").mapInArrow(run, T.StructType([T.StructField("row", T.LongType()), T.StructField("id", ids), T.StructField("score", T.DoubleType())]))


def _last_scores(found: DataFrame, n: int, k: int) -> np.ndarray:
    """The k-th score of each of ``n`` queries; less than any score where there are fewer."""
    order = Window.partitionBy("row").orderBy(F.desc("score"), "id")
    rows = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k).select("row", "score").collect()  # one a query of a block
    out = np.full(n, -np.inf)
    out[[r["row"] for r in rows]] = [r.score for r in rows]
    return out


def _blocks(queries: DataFrame) -> list[DataFrame]:
    """Queries with a direction, in blocks of at most about BLOCK_COMPONENTS components."""
    queries = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).filter(F.exists("vector", lambda x: x != 0))
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("d")).first()
    blocks = -(-size.n * size.d // BLOCK_COMPONENTS)
    return [queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else queries for b in range(blocks)]


def search(spark: SparkSession, path: str, queries: DataFrame, top_k: int = 0, with_payload: bool = True, digits: int | None = None) -> DataFrame:
    """(query_id, rank, id, score, payload): for each of ``queries`` (query_id, vector) its ``top_k`` nearest points, exactly.

    Equal scores go to the smaller id; unrounded scores of equal vectors may differ in their last bits, which ``digits`` ends.
    Queries without a direction and an empty index give no rows. Blocks of queries of a
    bounded size go to the tasks one after another.
    """
    k, meta = top_k or TOP_K, _meta(spark, path)
    kind = queries.schema["query_id"].dataType.simpleString()
    out = spark.createDataFrame([], T.StructType([queries.schema["query_id"], T.StructField("id", meta.schema["id"].dataType), T.StructField("score", T.DoubleType())]))
    n = 0
    for block in _blocks(queries) if len(meta.pivots) else []:
        ids, q = _asked(block.toArrow())
        visits = _of_few(q, meta, lambda angles, at: _first(angles, meta, k))
        near = stored(_scan(spark, path, meta, q, visits, np.full(len(q), -np.inf), k, digits))
        scores = _last_scores(near, len(q), k)
        rest = _of_few(q, meta, lambda angles, at: _possible(angles, meta, _reach(scores[at], digits))) & ~visits
        found = near.unionByName(_scan(spark, path, meta, q, rest, scores, k, digits)) if rest.any() else near
        names = spark.createDataFrame(pa.table({"row": pa.array(np.arange(len(q))), "query_id": ids})).select("row", F.col("query_id").cast(kind).alias("query_id"))
        out, n = out.unionByName(found.join(F.broadcast(names), "row").drop("row")), n + len(q)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    found = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
    payload = [f.name for f in meta.schema if f.name not in ("id", "vector", "norm", "angle", "pivot")]
    if not with_payload or not payload or not len(meta.pivots):
        return found
    found = F.broadcast(found) if n * k <= BROADCAST_ROWS else found
    points = spark.read.schema(meta.schema).parquet(f"{path}/points").select("id", F.struct(*payload).alias("payload"))
    return points.join(found, "id").select("query_id", "rank", "id", "score", "payload")


def work(spark: SparkSession, path: str, queries: DataFrame, found: DataFrame, top_k: int = 0) -> float:
    """The share of pairs of queries and points that ``search`` skips by whole folders, told from the scores it ``found``."""
    k, meta = top_k or TOP_K, _meta(spark, path)
    seen = every = 0
    for block in _blocks(queries) if len(meta.pivots) else []:
        ids, q = _asked(block.toArrow())
        angles = _angles(q, meta.pivots)
        last = dict(found.filter(F.col("rank") == k).select("query_id", "score").join(F.broadcast(block.select("query_id")), "query_id").collect())
        reach = _reach(np.array([last.get(i, -2.0) for i in ids.to_pylist()]), None)
        seen += int((_possible(angles, meta, reach) * meta.sizes).sum())
        every += len(q) * int(meta.sizes.sum())
    return 1 - seen / every if every else 0.0
