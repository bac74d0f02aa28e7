"""Choosing what to work on: what is new, what came first, what failed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def not_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among ``done``."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def first_of_each(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key in the given order. Ranks are limited before the shuffle, so a hot key stays cheap."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def newest(papers: DataFrame, category: str | None, since: str | None, n: int) -> DataFrame:
    """Papers of a category submitted at or after ``since`` (yyyyMMddHHmm), the newest first, ``n`` at most."""
    if category is not None:
        papers = papers.filter(F.col("category") == category)
    if since is not None:
        papers = papers.filter(F.col("submitted") >= F.to_timestamp(F.lit(since), "yyyyMMddHHmm"))
    return papers.orderBy(F.desc("submitted"), "arxiv_id").limit(n)


def with_files(metadata: DataFrame, files: DataFrame, extracted: str = "full_text") -> DataFrame:
    """Metadata with the text of its file, by ``pdf_path``; ``error`` tells what is missing or failed, and is null otherwise."""
    joined = metadata.join(files.select(F.col("path").alias("pdf_path"), extracted, F.col("error").alias("_error")), "pdf_path", "left")
    missing = F.when(F.col(extracted).isNull() & F.col("_error").isNull(), F.lit("no such file"))
    return joined.select(*metadata.columns, extracted, F.coalesce("_error", missing).alias("error"))
