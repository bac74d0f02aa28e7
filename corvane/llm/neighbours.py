"""Approximate nearest neighbours by a forest of random-projection trees.

Trees are fitted on a bounded sample (about SAMPLE rows, those with the least hashes of their ids): each node splits at the
median of the projection on the difference of two random rows. Every row is then routed to one leaf of each tree. A
query searches all trees through one shared priority queue, always taking next the branch with the least distance to
any hyperplane it crossed on the way, until the leaves hold ``search_k`` candidates. A leaf's rows and the queries that
visit it meet by (tree, leaf). There one matrix product gives all distances up to rounding, and those that rounding
leaves among the nearest are computed again exactly; each leaf gives its nearest, and the best of all leaves remain.

How many candidates a recall takes depends on the data, so ``search_k`` is calibrated: CALIBRATE queries are answered by
brute force over all rows, and it becomes the least number for which their recall reaches AIM.

Of equal vectors only the smallest ids can be among the k nearest, so k + 1 of each are indexed, which loses nothing
and keeps a vector that a third of all rows share from filling a leaf. Leaves with many rows or many visiting queries
are split among tasks by salts, of rows and of queries.

A tree has at most MOST_LEAVES leaves, as it goes to every task; with more than LEAF times that many vectors, leaves
hold more rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm import common

TREES, LEAF, SAMPLE, MOST_LEAVES, CALIBRATE, AIM = 12, 128, 10_000, 4096, 64, 0.95
#: Rows and queries of a leaf that meet in one task, about.
SALT, QUERY_SALT = 20_000, 20_000


@dataclass
class Tree:
    """Nodes in preorder: direction, threshold and children; a child -1-k is leaf k."""

    direction: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    leaves: int

    def route(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64) if len(self.child) else np.full(len(x), -1)
        while True:
            go = np.flatnonzero(at >= 0)
            if not len(go):
                return -1 - at
            node = at[go]
            side = np.einsum("nd,nd->n", x[go], self.direction[node]) >= self.threshold[node]
            at[go] = self.child[node, side.astype(int)]


def fit(sample: np.ndarray, leaves: int, seed: int) -> Tree:
    draw = np.random.default_rng(seed)
    direction, threshold, child = [], [], []
    count = 0
    least = max(1, len(sample) // leaves)
    # (rows, parent, side)
    stack = [(np.arange(len(sample)), -1, 0)]
    while stack:
        rows, parent, side = stack.pop()
        split = None
        for _ in range(3 if len(rows) > least else 0):
            a, b = draw.choice(rows, 2, replace=False)
            w = sample[a] - sample[b]
            if not w.any():
                w = draw.normal(size=sample.shape[1])
            w = w / np.linalg.norm(w)
            on = sample[rows] @ w
            t = np.median(on)
            if 0 < (high := on >= t).sum() < len(rows):
                split = w, t, high
                break
        if split is None:
            here = -1 - count
            count += 1
        else:
            here = len(child)
            direction.append(split[0])
            threshold.append(split[1])
            child.append([0, 0])
            stack += [(rows[split[2]], here, 1), (rows[~split[2]], here, 0)]
        if parent >= 0:
            child[parent][side] = here
    d = sample.shape[1]
    return Tree(np.array(direction).reshape(-1, d), np.array(threshold), np.array(child, np.int64).reshape(-1, 2), count)


def visits(forest: list[Tree], q: np.ndarray) -> Iterator[tuple[int, int]]:
    """(tree, leaf) in the order of the shared queue."""
    side = [t.direction @ q - t.threshold for t in forest]
    queue = [(0.0, k, 0 if len(t.child) else -1) for k, t in enumerate(forest)]
    heapq.heapify(queue)
    while queue:
        margin, k, node = heapq.heappop(queue)
        while node >= 0:
            x = side[k][node]
            near = int(x >= 0)
            heapq.heappush(queue, (max(margin, abs(x)), k, int(forest[k].child[node, 1 - near])))
            node = int(forest[k].child[node, near])
        yield k, -1 - node


def valid(vector: Column) -> Column:
    """Not null, not zero, without null or non-finite components."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(good, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean, in double precision, without the cancellation of the expanded form."""
    return np.sqrt(((q[:, None, :] - x[None, :, :]) ** 2).sum(-1))


def nearest(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance) of the k nearest ids of each query among x, itself left out; ties to smaller ids."""
    out = []
    step = max(1, 1_000_000 // max(1, len(x)))
    repeated = len(np.unique(ids)) < len(ids)
    length = (x * x).sum(1)
    for at in range(0, len(q), step):
        some = q[at : at + step]
        # squared distances less the query's square; rounding errors stay far below the slack
        rough = length - 2 * (some @ x.T)
        slack = 1e-10 * ((some * some).sum(1) + (length.max() if len(x) else 0))
        for i, row in enumerate(rough):
            row[ids == query_ids[at + i]] = np.inf
            want = k
            while True:
                few = np.flatnonzero(row <= np.partition(row, want - 1)[want - 1] + slack[i]) if len(row) > want else np.arange(len(row))
                few = few[np.isfinite(row[few])]
                d = distances(some[i : i + 1], x[few])[0]
                order = np.lexsort((ids[few], d))
                few, d = few[order], d[order]
                if repeated:
                    first = np.sort(np.unique(ids[few], return_index=True)[1])
                    few, d = few[first], d[first]
                if not repeated or len(few) >= k or want >= len(row):
                    break
                want *= 2
            few, d = few[:k], d[:k]
            out.append((np.full(len(few), query_ids[at + i]), ids[few], d))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out))


BEST = pa.schema([("query_id", pa.int64()), ("found", pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())])))])
FOUND_DDL = "query_id long, vec_id long, score double"


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.dropDuplicates(["query_id", "vec_id", "score"]).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def combine(k: int):
    """The k best ids of one query among those of all leaves."""

    def run(group: pa.Table) -> pa.Table:
        found = group["found"].combine_chunks().flatten()
        score, ids = found.field("score").to_numpy(), found.field("vec_id").to_numpy()
        order = np.lexsort((ids, score))
        order = order[np.sort(np.unique(ids[order], return_index=True)[1])][:k]
        query = np.full(len(order), group["query_id"][0].as_py(), np.int64)
        return pa.table({"query_id": query, "rank": np.arange(1, len(order) + 1, dtype=np.int32), "vec_id": ids[order], "score": score[order]})

    return run


def exact(rows: DataFrame, query_ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """The k nearest of a few queries by brute force, each with its vector; a task keeps k a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = b["vec_id"].to_numpy(), matrix(b["vector"])
            query, found, d = nearest(query_ids, q, ids, x, k)
            at = dict(zip(ids.tolist(), range(len(ids))))
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(found), pa.array(d), b["vector"].take(pa.array([at[i] for i in found.tolist()], pa.int64()))], names=["query_id", "vec_id", "score", "vector"])

    return _best(rows.mapInArrow(run, FOUND_DDL + ", vector array<double>"), k)


def calibrate(forest: list[Tree], sizes: list[np.ndarray], rows: DataFrame, queries: DataFrame, k: int) -> int:
    """The least number of candidates that gives a sample of queries the recall AIM."""
    sample = common.sampled(queries, CALIBRATE, queries.count(), "vec_id")
    ids, q = np.array([r.vec_id for r in sample], np.int64), np.array([r.vector for r in sample], float)
    found = exact(rows, ids, q, k).collect() if sample else []  # at most CALIBRATE * k
    if not sample:  # there are queries, but none was drawn
        return int(sum(sizes[0]))
    if not found:
        return 1
    leaf = np.stack([t.route(np.array([r.vector for r in found], float)) for t in forest], axis=1)
    mine: dict[int, list[np.ndarray]] = {}
    for r, x in zip(found, leaf):
        mine.setdefault(r.query_id, []).append(x)
    needed = []
    for query_id, x in zip(ids.tolist(), q):
        if query_id not in mine:
            continue
        want = np.stack(mine[query_id])
        first, seen = np.full(len(want), np.iinfo(np.int64).max), 0
        for tree, at in visits(forest, x):
            seen += int(sizes[tree][at])
            first[(want[:, tree] == at) & (first > seen)] = seen
            if first.max() < np.iinfo(np.int64).max:
                break
        needed += first.tolist()
    needed.sort()
    return needed[min(len(needed) - 1, int(np.ceil(AIM * len(needed))) - 1)]


def search(vectors: DataFrame, is_query: Column, k: int = 10, column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): of each query row, the k nearest other rows found, nearest first.

    ``vectors`` has vec_id and the vector column, all of one length. Rows whose vector is null, zero or holds null or
    non-finite components take no part; so do null ids. Repeated rows of one id count once. With fewer candidates than k
    all are returned; an empty table, or one without queries, gives an empty one.
    """
    spark = vectors.sparkSession
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vector"), is_query.alias("is_query"))
    clean = common.stored(clean.filter(F.col("vec_id").isNotNull() & valid(F.col("vector"))))
    queries = clean.filter("is_query").dropDuplicates(["vec_id"]).select("vec_id", "vector")
    order = Window.partitionBy("vector").orderBy("vec_id")
    distinct = clean.select("vec_id", "vector").distinct()
    rows = common.stored(distinct.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).select("vec_id", "vector"))
    n = rows.count()
    if not n or queries.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    leaves = max(1, min(MOST_LEAVES, n // LEAF))
    sample = np.array([r.vector for r in common.sampled(rows, max(SAMPLE, 8 * leaves), n, "vec_id")], float)
    forest = [fit(sample, max(1, min(leaves, len(sample) // 8)), seed) for seed in range(TREES)]
    shared = spark.sparkContext.broadcast(forest)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b["vector"])
            leaf = np.stack([t.route(x) for t in shared.value], axis=1).astype(np.int32)
            at = pa.ListArray.from_arrays(pa.array(np.arange(len(leaf) + 1, dtype=np.int32) * TREES), pa.array(leaf.ravel()))
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["vector"], at], names=["vec_id", "vector", "leaf"])

    routed = rows.mapInArrow(route, "vec_id long, vector array<double>, leaf array<int>")
    placed = routed.select(F.posexplode("leaf").alias("tree", "leaf"), "vec_id", "vector")
    sizes = [np.zeros(t.leaves, np.int64) for t in forest]
    for r in placed.groupBy("tree", "leaf").count().collect():  # one row a leaf: at most TREES * MOST_LEAVES or so
        sizes[r.tree][r.leaf] = r["count"]
    search_k = calibrate(forest, sizes, rows, queries, k)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for x in matrix(b["vector"]):
                seen, to = 0, []
                for tree, leaf in visits(shared.value, x):
                    to.append({"tree": tree, "leaf": leaf})
                    seen += int(sizes[tree][leaf])
                    if seen >= search_k:
                        break
                found.append(to)
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["vector"], pa.array(found, VISITS)], names=["query_id", "q", "to"])

    visited = common.stored(queries.mapInArrow(visit, "query_id long, q array<double>, to array<struct<tree: int, leaf: int>>"))
    asked = [np.zeros(t.leaves, np.int64) for t in forest]
    for r in visited.select(F.inline("to")).groupBy("tree", "leaf").count().collect():  # one row a leaf
        asked[r.tree][r.leaf] = r["count"]
    row_salts, query_salts = _salts(sizes, SALT), _salts(asked, QUERY_SALT)
    placed = placed.withColumn("salt", F.pmod(F.xxhash64("vec_id"), row_salts).cast("int")).withColumn("turn", F.explode(F.sequence(F.lit(0), query_salts - 1)))
    visited = visited.select("query_id", "q", F.inline("to")).withColumn("turn", F.pmod(F.xxhash64("query_id"), query_salts).cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0), row_salts - 1)))

    def meet(x: pa.Table, v: pa.Table) -> pa.Table:
        if not len(x) or not len(v):
            return pa.table([pa.array([], f.type) for f in BEST], schema=BEST)
        query, found, score = nearest(v["query_id"].to_numpy(), matrix(v["q"].combine_chunks()), x["vec_id"].to_numpy(), matrix(x["vector"].combine_chunks()), k)
        first = np.flatnonzero(common.in_order(query))
        pairs = pa.StructArray.from_arrays([pa.array(score), pa.array(found)], fields=list(BEST.field("found").type.value_type))
        return pa.table([pa.array(query[first], pa.int64()), pa.ListArray.from_arrays(pa.array(np.r_[first, len(query)].astype(np.int32)), pairs)], schema=BEST)

    key = ("tree", "leaf", "salt", "turn")
    best = placed.groupBy(*key).cogroup(visited.groupBy(*key)).applyInArrow(meet, "query_id long, found array<struct<score: double, vec_id: long>>")
    return best.groupBy("query_id").applyInArrow(combine(k), "query_id long, rank int, vec_id long, score double")


VISITS = pa.list_(pa.struct([("tree", pa.int32()), ("leaf", pa.int32())]))


def _salts(counts: list[np.ndarray], most: int) -> Column:
    """Into how many parts each (tree, leaf) is split, so that none has over ``most`` or so."""
    parts = [np.maximum(1, -(-c // most)) for c in counts]
    if max(p.max() for p in parts) == 1:
        return F.lit(1)
    return F.get(F.get(F.array(*[F.array(*map(F.lit, p.tolist())) for p in parts]), F.col("tree")), F.col("leaf"))
