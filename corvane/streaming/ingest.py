"""Incremental ingestion: each run takes the papers of a feed, or the paper files, that came since the last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from corvane.config import Chunking, Download
from corvane.operators.chunking import chunk_documents
from corvane.sources.atom import register
from corvane.sources.files import PAPER


def stream_papers(spark: SparkSession, path: str, schema: str = PAPER) -> DataFrame:
    return spark.readStream.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)


def stream_chunks(papers: DataFrame, cfg: Chunking = Chunking()) -> DataFrame:
    return chunk_documents(papers, size=cfg.chunk_size, overlap=cfg.chunk_overlap)


def ingest_new(spark: SparkSession, source: str, sink: str, checkpoint: str, cfg: Chunking = Chunking()) -> StreamingQuery:
    """Chunks what is new and appends it to ``sink``, each file once; ends when all is done."""
    chunks = stream_chunks(stream_papers(spark, source), cfg)
    query = chunks.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def stream_feed(spark: SparkSession, url: str, cfg: Download = Download()) -> DataFrame:
    """Papers of the configured category and time, the oldest first, each once: ids that were seen are state of the query."""
    register(spark)
    options = {"url": url, "results_per_request": cfg.results_per_request, "category": cfg.category, "start_date": cfg.start_date, "timeout": cfg.search_timeout, "retries": cfg.retries, "retry_wait": cfg.retry_wait, "pause": cfg.pause, "parallel": cfg.parallel}
    return spark.readStream.format("atom").options(**options).load().dropDuplicates(["arxiv_id"])


def ingest_feed(spark: SparkSession, url: str, sink: str, checkpoint: str, cfg: Download = Download()) -> StreamingQuery:
    """Appends papers that the feed got since the last run to ``sink``; ends when all are there. A run that failed is taken up again."""
    query = stream_feed(spark, url, cfg).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
