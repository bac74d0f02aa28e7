"""The vector index: a table of points with their payload and norm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.vectors import norm
from corvane.operators import ann, graph
from corvane.tables import stored


def flatten_payload(chunks: DataFrame) -> DataFrame:
    """text beside the fields of metadata; of two equal names the metadata's wins."""
    fields = chunks.schema["metadata"].dataType.fieldNames()
    own = [c for c in chunks.columns if c != "metadata" and c not in fields]
    return chunks.select(*own, "metadata.*")


def with_ordinals(points: DataFrame, *order: str) -> DataFrame:
    """``points`` with ``id`` from 0 in the given order.

    Ranges of the order are numbered apart and shifted by the size of those before, so no task has all rows. Points are
    written down before ranges are drawn from them, so they are computed once, and again by range, as these would differ
    if they were drawn anew.
    """
    ranged = stored(stored(points).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("_at", inside).join(F.broadcast(before), "_part").withColumn("id", F.col("_before") + F.col("_at")).drop("_part", "_before", "_at")


def checked_dimension(points: DataFrame, vector: str, dimension: int) -> DataFrame:
    """Fails, when it runs, on a vector of another length."""
    size = F.size(vector)
    told = F.concat(F.lit(f"a vector of {dimension} components is wanted, not of "), size.cast("string"))
    return points.withColumn(vector, F.when(size == dimension, F.col(vector)).otherwise(F.raise_error(told)))


def build_index(embedded: DataFrame, dimension: int) -> DataFrame:
    """Points (id, vector, payload columns, norm) of embedded chunks, in the order of arxiv_id and chunk_index."""
    flat = flatten_payload(embedded.drop("id")).withColumnRenamed("embedding", "vector")
    return with_ordinals(checked_dimension(flat, "vector", dimension), "arxiv_id", "chunk_index").withColumn("norm", norm("vector"))


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions of the index at ``path``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    done = [n for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(int(n[1:]) for n in done)


def newest(spark: SparkSession, path: str) -> int:
    """The newest complete version of the index at ``path``."""
    versions = _versions(spark, path)
    if not versions:
        raise FileNotFoundError(f"no index at {path}")
    return versions[-1]


def read(spark: SparkSession, path: str) -> DataFrame:
    """The index at ``path``: its newest complete version."""
    return spark.read.parquet(f"{path}/v{newest(spark, path)}")


def near_path(spark: SparkSession, path: str, method: str) -> str:
    """Where the approximate index over the newest version lies."""
    return f"{path}/{method}/v{newest(spark, path)}"


def build_near(spark: SparkSession, path: str, method: str) -> None:
    """Builds the approximate index over the newest version; those of versions that are gone go as well."""
    {"lists": ann.build, "graph": graph.build}[method](read(spark, path).drop("norm"), near_path(spark, path, method))
    kept = {f"v{v}" for v in _versions(spark, path)}
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{method}")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(folder):
        if status.getPath().getName() not in kept:
            fs.delete(status.getPath(), True)


def search_near(spark: SparkSession, path: str, method: str, queries: DataFrame, top_k: int = 0) -> DataFrame:
    """(query_id, rank, id, score, payload) by the approximate index over the newest version."""
    return {"lists": ann.search, "graph": graph.search}[method](spark, near_path(spark, path, method), queries, top_k)


def create_or_check(spark: SparkSession, path: str, dimension: int) -> bool:
    """True if there is an index at ``path``; its vectors must all have the dimension, which a created one only gets with data."""
    if not _versions(spark, path):
        return False
    other = read(spark, path).select(F.size("vector").alias("n")).filter(F.col("n") != dimension).first()
    if other is not None:
        raise ValueError(f"the index at {path} has vectors of {other.n} components, not {dimension}")
    return True


def upserted(index: DataFrame, points: DataFrame) -> DataFrame:
    """``index`` with ``points`` in place of those with the same id; of new points that share an id one is taken."""
    return index.join(points.select("id"), "id", "left_anti").unionByName(points.dropDuplicates(["id"]))


def setup(spark: SparkSession, embedded: DataFrame, path: str, dimension: int) -> int:
    """Creates the index if there is none, puts all points into it and returns their number.

    A new version is written beside the others and read once it is complete, so a failure leaves the last one as it was.
    The one before it is kept for those who still read it, older ones go.
    """
    there = create_or_check(spark, path, dimension)
    points = build_index(embedded, dimension)
    versions = _versions(spark, path)
    if there:
        points = upserted(read(spark, path), points)
    points.write.mode("overwrite").parquet(f"{path}/v{versions[-1] + 1 if versions else 1}")
    for old in versions[:-1]:
        gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{old}")
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    return read(spark, path).count()
