"""A stored navigable graph of small worlds, searched by beam.

Points are dealt by the hash of their ids to shards of bounded size, and each task links the points of a shard: the
nearest EF_CONSTRUCT of a point, found by matrix products, are thinned to M that lie in different directions (one is left
out if a link chosen before is nearer to it than the point is), links go both ways, and a point keeps 2 * M at most. A
shard is written as one row, so a search reads shards where they lie and shuffles only what it finds.

A search enters a shard at the nearest of some points spread over it and follows links from the best point of its beam that
it has not followed, until none is left. All queries walk at once, in arrays. The width of the beam is measured when
the graph is built: the smallest that finds RECALL of the true neighbours of points of the shard, which are at hand then.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators import search as exact
from corvane.operators.ann import _unit
from corvane.operators.search import TOP_K, _asked, _payload

#: Links of a point (both ways twice as many), nearest points that these are chosen from, points of a shard at most.
M, EF_CONSTRUCT, SHARD = 16, 100, 20_000
#: Points that a search may enter a shard at; widths of the beam that are tried; share of neighbours to find among so many points.
ENTRIES, WIDTHS, RECALL, CALIBRATED = 256, (16, 32, 64, 128, 256, 512), 0.95, 100
#: Numbers in the largest product; queries that walk at once; rows found that go to all tasks at most.
PRODUCT, WALKERS, BROADCAST_ROWS = 4_000_000, 256, 100_000


def _nearest(x: np.ndarray, some: np.ndarray, k: int) -> np.ndarray:
    """The k rows of ``x`` nearest to each of the rows ``some``, without itself, the nearest first, by dot product."""
    out = np.empty((len(some), k), np.int64)
    step = max(1, PRODUCT // max(1, len(x)))
    for a in range(0, len(some), step):
        s = x[some[a : a + step]] @ x.T
        s[np.arange(len(s)), some[a : a + step]] = -np.inf
        few = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < s.shape[1] else np.broadcast_to(np.arange(k), (len(s), k))
        out[a : a + step] = np.take_along_axis(few, np.argsort(-np.take_along_axis(s, few, 1), axis=1, kind="stable"), 1)
    return out


def link(x: np.ndarray, m: int = M, ef_construct: int = EF_CONSTRUCT) -> np.ndarray:
    """(point, 2 * m) of the points that each of the unit vectors ``x`` is linked to, -1 where there are fewer."""
    n = len(x)
    k = min(ef_construct, n - 1)
    out = np.full((n, 2 * m), -1, np.int32)
    if k < 1:
        return out
    near = _nearest(x, np.arange(n), k)
    chosen = np.zeros((n, k), bool)
    step = max(1, PRODUCT // (k * x.shape[1]))
    for a in range(0, n, step):
        rows = near[a : a + step]
        v = x[rows]
        own = np.einsum("nd,nkd->nk", x[a : a + step], v)
        kept = np.zeros(rows.shape, bool)
        closest = np.full(rows.shape, -np.inf)  # of each candidate to a link chosen before
        for j in range(k):
            take = (closest[:, j] < own[:, j]) & (kept.sum(1) < m)
            kept[:, j] = take
            if take.any():
                closest[take] = np.maximum(closest[take], np.einsum("nd,nkd->nk", v[take, j], v[take]))
        fill = (m - kept.sum(1)).clip(0)[:, None]  # places left go to the nearest that were left out
        chosen[a : a + step] = kept | (~kept & (np.cumsum(~kept, axis=1) <= fill))
    one, col = np.nonzero(chosen)
    other = near[one, col]
    pairs = np.unique(np.r_[np.c_[one, other], np.c_[other, one]], axis=0)
    strength = np.concatenate([np.einsum("nd,nd->n", x[p[:, 0]], x[p[:, 1]]) for p in np.array_split(pairs, max(1, len(pairs) * x.shape[1] // PRODUCT))])
    pairs = pairs[np.lexsort((pairs[:, 1], -strength, pairs[:, 0]))]
    first = np.flatnonzero(np.r_[True, pairs[1:, 0] != pairs[:-1, 0]])
    place = np.arange(len(pairs)) - np.repeat(first, np.diff(np.r_[first, len(pairs)]))
    fits = place < 2 * m
    out[pairs[fits, 0], place[fits]] = pairs[fits, 1]
    return out


def walk(x: np.ndarray, links: np.ndarray, q: np.ndarray, width: int, entries: int = ENTRIES, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(query, width) of the points in the beam of each of the queries ``q`` at the end, the best first, and their scores; -1 where there are fewer.

    ``without`` names a point for each query that it doesn't come to, as if it weren't there.
    """
    n = len(x)
    doors = np.unique(np.linspace(0, n - 1, min(entries, n)).astype(np.int64))
    width = min(width, n)
    s = q @ x[doors].T
    if without is not None:
        s[doors == without[:, None]] = -np.inf
    few = np.argsort(-s, axis=1, kind="stable")[:, :width]
    beam, score = np.full((len(q), width), -1, np.int32), np.full((len(q), width), -np.inf, x.dtype)
    beam[:, : few.shape[1]], score[:, : few.shape[1]] = doors[few], np.take_along_axis(s, few, 1)
    beam[score == -np.inf] = -1
    ahead = score.copy()  # of points whose links are still to be followed
    worst = score.min(1)
    seen = np.zeros((len(q), n), bool)
    seen[:, doors] = True
    if without is not None:
        seen[np.arange(len(q)), without] = True
    seen = seen.ravel()
    live = np.arange(len(q))
    while len(live):
        at = ahead[live].argmax(1)
        going = ahead[live, at] > -np.inf
        live, at = live[going], at[going]
        ahead[live, at] = -np.inf
        to = links[beam[live, at]]
        row, spot = np.nonzero(to >= 0)
        who, point = live[row], to[row, spot].astype(np.int64)
        new = ~seen[who * n + point]
        who, point = who[new], point[new]
        seen[who * n + point] = True
        value = np.einsum("nd,nd->n", q[who], x[point])
        better = value > worst[who]
        who, point, value = who[better], point[better], value[better]
        if not len(who):
            continue
        first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        own, count = who[first], np.diff(np.r_[first, len(who)])
        line, place = np.repeat(np.arange(len(own)), count), np.arange(len(who)) - np.repeat(first, count)
        points, values = np.full((len(own), count.max()), -1, np.int32), np.full((len(own), count.max()), -np.inf, x.dtype)
        points[line, place], values[line, place] = point, value
        both = [np.concatenate(z, 1) for z in ((beam[own], points), (score[own], values), (ahead[own], values))]
        best = np.argpartition(-both[1], width - 1, axis=1)[:, :width]
        beam[own], score[own], ahead[own] = (np.take_along_axis(z, best, 1) for z in both)
        worst[own] = score[own].min(1)
    best = np.lexsort((beam, -score), axis=1)
    return np.take_along_axis(beam, best, 1), np.take_along_axis(score, best, 1)


def _width(x: np.ndarray, links: np.ndarray) -> int:
    """The smallest width of the beam that finds RECALL of the TOP_K neighbours of some points of the shard, each left out when it asks."""
    if len(x) <= TOP_K + 1:
        return len(x)
    some = np.unique(np.linspace(0, len(x) - 1, min(CALIBRATED, len(x))).astype(np.int64))
    near = _nearest(x, some, TOP_K)
    for width in WIDTHS:
        beam, _ = walk(x, links, x[some], width, without=some)
        hit = [len(set(b[:TOP_K]) & set(want)) for b, want in zip(beam, near)]
        if sum(hit) >= RECALL * near.size:
            return width
    return WIDTHS[-1]


def build(points: DataFrame, path: str, m: int = M, ef_construct: int = EF_CONSTRUCT, shard: int = SHARD) -> int:
    """Writes the graph of ``points`` (id, vector, payload) to ``path`` and returns the number of its shards.

    Points without a direction are left out, as they have no score. Points of one id are all kept, in one shard.
    """
    points = points.filter(F.exists("vector", lambda x: x != 0))
    shards = max(1, -(-points.count() // shard))
    kind = points.schema["id"].dataType.simpleString()

    def make(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        x = _unit(group["vector"].combine_chunks()).astype(np.float32)
        links = link(x, m, ef_construct)
        ids = pa.ListArray.from_arrays(pa.array([0, len(group)], pa.int32()), group["id"].combine_chunks())
        return pa.table([group["shard"].slice(0, 1).combine_chunks(), ids, pa.array([x.shape[1]], pa.int32()), pa.array([_width(x, links)], pa.int32()), pa.array([x.tobytes()], pa.binary()), pa.array([links.tobytes()], pa.binary())], names=["shard", "ids", "dimension", "width", "vectors", "links"])

    dealt = points.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "id", "vector")
    made = dealt.repartitionById(shards, F.col("shard")).groupBy("shard").applyInArrow(make, f"shard int, ids array<{kind}>, dimension int, width int, vectors binary, links binary")
    made.write.mode("overwrite").parquet(f"{path}/shards")
    points.drop("vector").write.mode("overwrite").parquet(f"{path}/payload")
    return shards


def search(spark: SparkSession, path: str, queries: DataFrame, top_k: int = 0, width: int = 0, digits: int | None = None) -> DataFrame:
    """(query_id, rank, id, score, payload): the nearest points that each of ``queries`` (query_id, vector) finds in all shards.

    ``width`` is that of the beam, 0 for each shard's own; it grows with ``top_k``. Scores are cosines of vectors in
    single precision. Queries of up to a block go to the tasks that read the shards; more are taken block by block.
    """
    k = top_k or TOP_K
    shards = spark.read.parquet(f"{path}/shards")
    kind, id_kind = queries.schema["query_id"].dataType.simpleString(), shards.schema["ids"].dataType.elementType.simpleString()
    queries = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).filter(F.exists("vector", lambda x: x != 0))
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("d")).first()
    blocks = max(1, -(-size.n * size.d // exact.BLOCK_COMPONENTS))
    found = None
    for block in range(blocks):
        some = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        walked = shards.mapInArrow(_walker(spark, *_asked(some.toArrow()), k, width, digits), f"query_id {kind}, id {id_kind}, score double")
        found = walked if found is None else found.unionByName(walked)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
    payload = spark.read.parquet(f"{path}/payload")
    if _payload(payload):
        found = F.broadcast(found) if size.n * k <= BROADCAST_ROWS else found
        found = payload.select("id", F.struct(*_payload(payload)).alias("payload")).join(found, "id").select("query_id", "rank", "id", "score", "payload")
    return found


def _walker(spark: SparkSession, ids: pa.Array, q: np.ndarray, k: int, width: int, digits: int | None):
    shared = spark.sparkContext.broadcast((ids, q.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        for b in batches:
            for r in range(len(b)):
                points = b["ids"].slice(r, 1).flatten()
                x = np.frombuffer(b["vectors"][r].as_buffer(), np.float32).reshape(len(points), -1)
                links = np.frombuffer(b["links"][r].as_buffer(), np.int32).reshape(len(points), -1)
                wide = max(width or -(-b["width"][r].as_py() * k // TOP_K), k)
                step = max(1, min(WALKERS, 10 * PRODUCT // len(x)))
                for a in range(0, len(q), step):
                    beam, score = walk(x, links, q[a : a + step], wide)
                    score = np.where(beam < 0, -np.inf, score.astype(float) if digits is None else np.round(score.astype(float), digits))
                    point = points.to_numpy(zero_copy_only=False)[np.maximum(beam, 0)]
                    best = np.lexsort((point, -score), axis=1)[:, :k]
                    row = np.repeat(np.arange(len(beam)), best.shape[1])
                    spot, value = np.take_along_axis(beam, best, 1).ravel(), np.take_along_axis(score, best, 1).ravel()
                    real = np.isfinite(value)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[real] + a)), points.take(pa.array(spot[real])), pa.array(value[real])], names=["query_id", "id", "score"])

    return run
