"""A stored approximate index: vectors in lists around centroids, searched without fitting anything again.

``build`` finds centroids by k-means on a bounded sample and writes each vector into the folder of its nearest centroid's
list, and beside it a product-quantised code of a byte for every few components of what the centroid leaves. ``search``
visits the lists of a query's nearest centroids. Folders of lists that no query visits are pruned, and nothing of the
index is shuffled: tasks hold queries against the codes they scan, by tables of dot products, and the best of these are
scored exactly, from the vectors.

How many lists a query visits and how many codes are scored exactly is measured when the index is built, on points of it
and their true neighbours: the fewest that find RECALL of them. A filter on the columns that the index counts by list
goes on to farther lists until a query has visited as many points that pass as it visits without a filter.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.vectors import cosine, normalized, rounded
from corvane.operators import search as exact
from corvane.operators.search import TOP_K, Nearest, _asked, _payload
from corvane.tables import stored

#: Rows a list that centroids are fitted on, lists at most (centroids go to every task), vectors in a file of a list, about.
SAMPLE, MOST_LISTS, PART = 40, 65_536, 20_000
#: Components that share a byte of a code, values of that byte, rows that these are fitted on.
SUB, VALUES, CODE_SAMPLE = 4, 256, 10_000
#: Share of true neighbours that lists and, of those, codes have to find among CALIBRATED points.
RECALL, CALIBRATED = 0.95, 100
#: Codes that a task scans at least, where there are more tasks than cores.
TASK = 1_000_000
#: Codes that a task keeps at once for a block of queries, about.
KEPT = 500_000
#: Numbers in the largest product that a task makes: 32 MB in double precision. Found rows that go to all tasks at most.
PRODUCT, BROADCAST_ROWS = 4_000_000, 100_000


def _unit(vectors: pa.Array) -> np.ndarray:
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def _order(q: np.ndarray, centres: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks of queries (from which row on) with all lists, the nearest first."""
    step = max(1, PRODUCT // max(1, len(centres)))
    for a in range(0, len(q), step):
        yield a, np.argsort((centres**2).sum(1) / 2 - q[a : a + step] @ centres.T, axis=1, kind="stable")


class Codes:
    """Codebooks: the nearest of up to VALUES values for every SUB components of a residual."""

    def __init__(self, books: np.ndarray) -> None:
        self.books = books  # part, value, component

    @staticmethod
    def _split(x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, -x.shape[1] % SUB))).reshape(len(x), -1, SUB)

    @classmethod
    def fit(cls, residuals: np.ndarray, rounds: int = 8, seed: int = 1) -> Codes:
        """Lloyd's rounds on a bounded sample, each part by itself."""
        parts = cls._split(residuals)
        draw, books = np.random.default_rng(seed), []
        for k in range(parts.shape[1]):
            x = parts[:, k]
            book = x[draw.permutation(len(x))[:VALUES]]
            for _ in range(rounds):
                at = (x @ book.T - (book**2).sum(1) / 2).argmax(1)
                n = np.bincount(at, minlength=len(book))
                sums = np.column_stack([np.bincount(at, x[:, j], len(book)) for j in range(SUB)])
                book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], book)
            books.append(book)
        return cls(np.array(books))

    def encode(self, residuals: np.ndarray) -> np.ndarray:
        parts = self._split(residuals)
        return np.column_stack([(parts[:, k] @ book.T - (book**2).sum(1) / 2).argmax(1) for k, book in enumerate(self.books)]).astype(np.uint8)

    def products(self, q: np.ndarray) -> np.ndarray:
        """(query, part, value): dot products of queries with the values."""
        return np.einsum("qpc,pvc->qpv", self._split(q), self.books)

    @staticmethod
    def scores(products: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """(query, code) of what the coded residuals add to a dot product."""
        out = np.zeros((len(products), len(codes)))
        for k in range(codes.shape[1]):
            out += products[:, k, codes[:, k]]
        return out


@dataclass(frozen=True)
class Meta:
    """What ``search`` needs of an index besides its points."""

    centres: np.ndarray
    sizes: np.ndarray
    codes: Codes | None
    probes: int
    rerank: int
    counted: tuple[str, ...]
    schema: T.StructType


def _meta(spark: SparkSession, path: str) -> Meta:
    table = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()  # at most MOST_LISTS
    told = json.loads(spark.read.parquet(f"{path}/meta").first().told)
    books = np.array(told["books"])
    return Meta(np.array([r.centre for r in table], float), np.array([r.n for r in table], np.int64), Codes(books) if books.size else None, told["probes"], told["rerank"], tuple(told["counted"]), T.StructType.fromJson(told["schema"]))


def build(points: DataFrame, path: str, lists: int = 0, iterations: int = 10, seed: int = 1, counted: Sequence[str] = ()) -> int:
    """Writes the index of ``points`` (id, vector, payload) to ``path`` and returns the number of its lists.

    ``lists`` is the square root of the number of points unless given. Points without a direction are left out, as they
    have no score. Points of one id are all kept. ``counted`` names payload columns that a search may filter by.
    """
    spark = points.sparkSession
    points = stored(points.filter(F.exists("vector", lambda x: x != 0)))
    n = points.count()
    lists = max(1, min(lists or round(math.sqrt(n)), MOST_LISTS, n))
    share = F.xxhash64("id") / F.lit(2.0**64) + 0.5
    some = points.filter(share < SAMPLE * lists / n) if n > SAMPLE * lists else points
    vectors = some.select(array_to_vector(normalized("vector")).alias("features"))
    if n:
        centres = np.array(KMeans(k=lists, maxIter=iterations, seed=seed).fit(vectors).clusterCenters()) if lists > 1 else np.ones((1, len(points.first().vector)))
        few = points.filter(share < CODE_SAMPLE / n) if n > CODE_SAMPLE else points
        x = _unit(few.select("vector").limit(2 * CODE_SAMPLE).toArrow()["vector"].combine_chunks())
        codes = Codes.fit(x - centres[np.concatenate([o[:, 0] for _, o in _order(x, centres)])])
    else:
        centres, codes = np.zeros((0, 0)), None
    shared = spark.sparkContext.broadcast((centres, codes))
    schema = T.StructType([*points.schema, T.StructField("list", T.IntegerType()), T.StructField("code", T.BinaryType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, codes = shared.value
        step = max(1, PRODUCT // max(1, len(centres)))
        for batch in batches:
            for a in range(0, len(batch), step):
                b = batch.slice(a, step)
                x = _unit(b["vector"])
                at = (x @ centres.T - (centres**2).sum(1) / 2).argmax(1)
                code = codes.encode(x - centres[at])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary())], names=schema.names)

    placed = stored(points.mapInArrow(assign, schema))
    sizes = {r["list"]: r["n"] for r in placed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a list
    table = [(k, c.tolist(), sizes.get(k, 0), max(1, -(-sizes.get(k, 0) // PART))) for k, c in enumerate(centres)]
    centroids = spark.createDataFrame(table, "list int, centre array<double>, n long, parts int")
    parts = placed.join(F.broadcast(centroids.select("list", "parts")), "list").withColumn("_part", F.pmod(F.xxhash64("id"), "parts").cast("int")).drop("parts")
    parts.repartition("list", "_part").sortWithinPartitions("list", "id").drop("_part").write.mode("overwrite").partitionBy("list").parquet(f"{path}/points")
    centroids.coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    if counted:
        placed.groupBy("list", *counted).agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/counts")
    told = {"books": codes.books.tolist() if codes else [], "counted": list(counted), "probes": len(centres), "rerank": n, "schema": T.StructType([*points.schema, schema["code"], schema["list"]]).jsonValue()}
    if n:
        told |= dict(zip(("probes", "rerank"), _calibrated(placed, n, centres, codes)))
    spark.createDataFrame([(json.dumps(told),)], "told string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    return len(centres)


def _calibrated(placed: DataFrame, n: int, centres: np.ndarray, codes: Codes) -> tuple[int, int]:
    """Lists to visit and codes to score exactly, so that TOP_K true neighbours of sampled points are found often enough.

    One exact search and one scan of the codes; what comes to the driver are a few numbers for each sampled point.
    """
    spark = placed.sparkSession
    share = F.xxhash64(F.lit("calibrate"), "id") / F.lit(2.0**64) + 0.5
    some = stored(placed.filter(share < CALIBRATED / n).limit(2 * CALIBRATED) if n > CALIBRATED else placed).select(F.col("id").alias("query_id"), "vector")
    near = exact.batch_search(placed.select("id", "vector"), some, TOP_K + 1, with_payload=False).filter("id <> query_id")
    found = near.join(placed.select("id", "list", "code"), "id").select("query_id", "list", "code").collect()
    ids, q = _asked(some.toArrow())
    if not found:
        return len(centres), n
    row = {key: k for k, key in enumerate(ids.to_pylist())}
    place = np.empty((len(q), len(centres)), np.int64)
    for a, order in _order(q, centres):
        np.put_along_axis(place[a : a + len(order)], order, np.arange(len(centres))[None], axis=1)
    who = np.array([row[r.query_id] for r in found])
    ranks = np.sort(place[who, [r["list"] for r in found]])
    probes = int(ranks[min(len(ranks) - 1, math.ceil(RECALL * len(ranks)) - 1)]) + 1
    products = codes.products(q)
    base = q @ centres.T
    wanted = np.array([base[w, r["list"]] + codes.scores(products[w : w + 1], np.frombuffer(r.code, np.uint8)[None])[0, 0] for w, r in zip(who, found)])
    shared = spark.sparkContext.broadcast((place < probes, base, products, who, wanted, codes))

    def ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        visited, base, products, who, wanted, codes = shared.value
        n = np.zeros(len(who), np.int64)
        for b in batches:
            at = b["list"].to_numpy(zero_copy_only=False)
            code = np.frombuffer(b"".join(b["code"].to_pylist()), np.uint8).reshape(len(b), -1)
            for w in np.unique(who):
                seen = visited[w, at]
                scores = np.sort(base[w, at[seen]] + codes.scores(products[w : w + 1], code[seen])[0])
                mine = np.flatnonzero(who == w)
                n[mine] += len(scores) - np.searchsorted(scores, wanted[mine], "left")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n)), pa.int32()), pa.array(n)], names=["pair", "n"])

    counts = placed.select("list", "code").mapInArrow(ahead, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    deep = np.sort([r["n"] for r in counts if place[who[r["pair"]], found[r["pair"]]["list"]] < probes])
    return probes, max(4 * TOP_K, int(deep[math.ceil((1 + RECALL) / 2 * len(deep)) - 1]))


def _visits(q: np.ndarray, meta: Meta, probes: int, passing: np.ndarray | None) -> list[np.ndarray]:
    """The queries that visit each list. With a filter, lists without points that pass are passed over and farther ones visited."""
    out: list[list[np.ndarray]] = [[] for _ in meta.centres]
    for a, order in _order(q, meta.centres) if len(out) else ():
        if passing is None:
            visited = np.broadcast_to(np.arange(order.shape[1]) < probes, order.shape)
        else:
            enough = np.maximum(meta.sizes[order[:, :probes]].sum(1), 1)
            before = np.cumsum(passing[order], axis=1) - passing[order]
            visited = (before < enough[:, None]) & (passing[order] > 0)
        row, spot = np.nonzero(visited)
        lists = order[row, spot]
        by = np.argsort(lists, kind="stable")
        row, lists = row[by] + a, lists[by]
        cuts = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]]) if len(lists) else []
        for first, past in zip(cuts, [*cuts[1:], len(lists)]):
            out[lists[first]].append(row[first:past])
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]


class Visits:
    """Which queries visit each list, a bit for each of both."""

    def __init__(self, q: np.ndarray, meta: Meta, probes: int, passing: np.ndarray | None) -> None:
        self.n, lists = len(q), len(meta.centres)
        self.bits = np.zeros((lists, -(-len(q) // 8)), np.uint8)
        step = 8 * max(1, PRODUCT // max(1, 8 * lists))
        for a in range(0, len(q), step):
            size = min(step, len(q) - a)
            seen = np.zeros((lists, size), bool)
            for j, who in enumerate(_visits(q[a : a + size], meta, probes, passing)):
                seen[j, who] = True
            self.bits[:, a // 8 : a // 8 + -(-size // 8)] = np.packbits(seen, axis=1)

    def lists(self) -> np.ndarray:
        return np.flatnonzero(self.bits.any(1))

    def of(self, j: int, begin: int = 0, end: int | None = None) -> np.ndarray:
        """The queries from ``begin``, which 8 divides, to ``end`` that visit list ``j``."""
        end = self.n if end is None else min(end, self.n)
        return begin + np.flatnonzero(np.unpackbits(self.bits[j, begin // 8 : -(-end // 8)], count=end - begin))


def search(spark: SparkSession, path: str, queries: DataFrame, top_k: int = 0, probes: int = 0, digits: int | None = None, where: Column | None = None, rerank: int = 0) -> DataFrame:
    """(query_id, rank, id, score, payload): the nearest points that each of ``queries`` (query_id, vector) finds in ``probes`` lists.

    0 stands for the calibrated numbers of lists and of codes to score exactly; codes are at least as many as ``top_k``
    needs in proportion. With as many probes as lists, codes aren't used and the result is exact. ``where`` is a filter on
    the columns that the index counts. Queries beyond a block of bounded size meet the points of their lists by a shuffle.
    """
    k = top_k or TOP_K
    meta = _meta(spark, path)
    index = spark.read.schema(meta.schema).parquet(f"{path}/points")
    passing = None
    if where is not None:
        if not meta.counted:
            raise ValueError("the index counts no columns to filter by")
        passing = np.zeros(len(meta.centres), np.int64)
        for r in spark.read.parquet(f"{path}/counts").filter(where).groupBy("list").agg(F.sum("n").alias("n")).collect():  # one row a list
            passing[r["list"]] = r["n"]
        index = index.filter(where)
    payload = [c for c in _payload(index) if c not in ("list", "code")]
    all_lists = probes >= len(meta.centres) > 0
    probes = probes or meta.probes
    deep = max(rerank or -(-meta.rerank * k // TOP_K), k)
    queries = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).filter(F.exists("vector", lambda x: x != 0))
    kind, id_kind = (df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (index, "id")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("d")).first()
    if size.n * size.d > exact.BLOCK_COMPONENTS:
        found, seen = _met(index, queries, meta, probes, passing, k, digits, kind, id_kind), index
    else:
        block = queries.toArrow()
        ids, q = _asked(block)
        visits = Visits(q, meta, probes, passing)
        lists = visits.lists().tolist()
        seen = index.filter(F.col("list").isin(lists)) if len(lists) < len(meta.centres) else index
        if all_lists or deep >= meta.sizes.sum():
            found = seen.select("list", "id", "vector").mapInArrow(_scored(spark, ids, q, visits, k, digits), f"query_id {kind}, id {id_kind}, score double")
        else:
            scanned = int(meta.sizes[lists].sum())
            tasks = max(spark.sparkContext.defaultParallelism, scanned // TASK)  # small lists share a task, so a query is sent on by few
            coarse = seen.select("list", "id", "code").coalesce(tasks).mapInArrow(_coarse(spark, ids, q, visits, meta, deep), f"query_id {kind}, list int, id {id_kind}, score double")
            coarse = coarse.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= deep).select("query_id", "list", "id")
            found = _reranked(seen, coarse, spark.createDataFrame(block, queries.schema), size.n * deep, digits)
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
    if payload:
        found = F.broadcast(found) if size.n * k <= BROADCAST_ROWS else found
        found = seen.select("id", F.struct(*payload).alias("payload")).join(found, "id").select("query_id", "rank", "id", "score", "payload")
    return found


def _by_list(lists: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Each stretch of rows of one list: the list, where it begins and ends."""
    cuts = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]]) if len(lists) else []
    for first, past in zip(cuts, [*cuts[1:], len(lists)]):
        yield int(lists[first]), int(first), int(past)


def _scored(spark: SparkSession, ids: pa.Array, q: np.ndarray, visits: Visits, k: int, digits: int | None):
    shared = spark.sparkContext.broadcast((ids, q, visits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, visits = shared.value
        near = Nearest(ids, q, k, digits)
        for b in batches:
            for j, first, past in _by_list(b["list"].to_numpy(zero_copy_only=False)):
                near.add(b.slice(first, past - first), visits.of(j))
        yield from near.found()

    return run


def _coarse(spark: SparkSession, ids: pa.Array, q: np.ndarray, visits: Visits, meta: Meta, deep: int):
    """Scores by codes; a query keeps the best ``deep`` of all that a task scans.

    A task holds its codes, about TASK of them, and goes through the queries in blocks that keep about KEPT in all.
    """
    shared = spark.sparkContext.broadcast((ids, q, visits, meta.centres, meta.codes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, visits, centres, codes = shared.value
        read = [(b["list"].to_numpy(zero_copy_only=False), b["id"], np.frombuffer(b"".join(b["code"].to_pylist()), np.uint8).reshape(len(b), -1)) for b in batches if len(b)]
        if not read:
            return
        kind = read[0][1].type
        lists, point, code = np.concatenate([r[0] for r in read]), pa.concat_arrays([r[1] for r in read]).to_numpy(zero_copy_only=False), np.concatenate([r[2] for r in read])
        del read
        order = np.argsort(lists, kind="stable")
        lists, point, code = lists[order], point[order], code[order]
        stretches = list(_by_list(lists))
        step = 8 * max(1, min(KEPT // deep, PRODUCT // max(1, code.shape[1] * VALUES)) // 8)
        for begin in range(0, len(q), step):
            held: list[tuple[np.ndarray, ...]] = []  # query, row, score
            n = 0

            def best() -> list[tuple[np.ndarray, ...]]:
                who, row, s = (np.concatenate(x) for x in zip(*held))
                order = np.lexsort((-s, who))
                first = np.flatnonzero(np.r_[True, who[order][1:] != who[order][:-1]]) if len(order) else np.zeros(0, np.int64)
                place = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
                order = order[place < deep]
                return [(who[order], row[order], s[order])]

            products = codes.products(q[begin : begin + step])
            for j, first, past in stretches:
                who = visits.of(j, begin, begin + step)
                for at in range(first, past, exact.ROWS):
                    rows = code[at : min(past, at + exact.ROWS)]
                    for a in range(0, len(who), 256):
                        some = who[a : a + 256]
                        s = (q[some] @ centres[j])[:, None] + codes.scores(products[some - begin], rows)
                        few = np.argpartition(-s, deep - 1, axis=1)[:, :deep] if s.shape[1] > deep else np.broadcast_to(np.arange(s.shape[1]), s.shape)
                        held.append((np.repeat(some, few.shape[1]), at + few.ravel(), np.take_along_axis(s, few, 1).ravel()))
                        n += few.size
                        if n > 4 * KEPT:
                            held = best()
                            n = len(held[0][0])
            if held:
                who, row, s = best()[0]
                for a in range(0, len(who), exact.SENT):
                    cut = slice(a, a + exact.SENT)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(who[cut])), pa.array(lists[row[cut]], pa.int32()), pa.array(point[row[cut]], kind), pa.array(s[cut])], names=["query_id", "list", "id", "score"])

    return run


def _reranked(index: DataFrame, coarse: DataFrame, queries: DataFrame, rows: int, digits: int | None) -> DataFrame:
    """Exact scores of what codes have found. Up to BROADCAST_ROWS go to the tasks that scan the vectors."""
    few = F.broadcast(coarse) if rows <= BROADCAST_ROWS else coarse
    there = index.select("list", "id", "vector").join(few, ["list", "id"])
    both = there.join(F.broadcast(queries.withColumnRenamed("vector", "asked")), "query_id")
    score = cosine("vector", "asked")
    return both.select("query_id", "id", (score if digits is None else rounded(score, digits)).alias("score"))


def _met(index: DataFrame, queries: DataFrame, meta: Meta, probes: int, passing: np.ndarray | None, k: int, digits: int | None, kind: str, id_kind: str) -> DataFrame:
    """Exact scores for any number of queries: blocks of those that visit a list meet the list's points by a shuffle."""
    spark = index.sparkSession
    shared = spark.sparkContext.broadcast((meta, passing))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meta, passing = shared.value
        for b in batches:
            if len(b) and len(meta.centres):
                visits = _visits(_unit(b["vector"]), meta, probes, passing)
                who, lists = np.concatenate(visits), np.repeat(np.arange(len(visits)), [len(v) for v in visits])
                for a in range(0, len(who), 10_000):
                    some = b.take(pa.array(who[a : a + 10_000]))
                    yield pa.RecordBatch.from_arrays([some["query_id"], some["vector"], pa.array(lists[a : a + 10_000], pa.int32())], names=["query_id", "vector", "list"])

    def meet(asked: pa.Table, b: pa.Table) -> pa.Table:
        names = ["query_id", "id", "score"]
        if not len(asked) or not len(b):
            return pa.table([asked["query_id"].slice(0, 0), b["id"].slice(0, 0), pa.array([], pa.float64())], names=names)
        near = Nearest(*_asked(asked), k, digits)
        near.add(b)
        return pa.Table.from_batches(near.found(), pa.schema([(n, t) for n, t in zip(names, (asked["query_id"].type, b["id"].type, pa.float64()))]))

    visits = stored(queries.mapInArrow(visit, f"query_id {kind}, vector array<double>, list int"))
    cells = visits.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("blocks"))
    parts = spark.createDataFrame([(j, max(1, -(-int(n) // PART))) for j, n in enumerate(meta.sizes)], "list int, parts int")
    cells = F.broadcast(cells.join(parts, "list"))  # one row a list
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = visits.join(cells, "list").withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks").cast("int")).withColumn("part", each("parts")).select("query_id", "vector", "list", "block", "part")
    there = index.select("id", "vector", "list").join(cells, "list").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).withColumn("block", each("blocks")).select("id", "vector", "list", "block", "part")
    return asked.groupBy("list", "block", "part").cogroup(there.groupBy("list", "block", "part")).applyInArrow(meet, f"query_id {kind}, id {id_kind}, score double")
