"""Downloading the papers that a feed lists."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.config import Download
from corvane.operators.ingest import first_of_each, not_done
from corvane.sources.atom import fetch, register
from corvane.sources.files import file_name, read_binary, write_json
from corvane.sources.sinks import write_files
from corvane.tables import stored


def listed(spark: SparkSession, url: str, cfg: Download) -> DataFrame:
    """Papers of the configured category and time, each once, at most ``target_count``.

    Pages are read until there are so many different papers, or fewer came than were asked for. What has been read is
    written down, so no page is asked for twice.
    """
    register(spark)
    options = {"url": url, "target_count": cfg.target_count, "results_per_request": cfg.results_per_request, "category": cfg.category, "start_date": cfg.start_date, "timeout": cfg.search_timeout, "retries": cfg.retries, "retry_wait": cfg.retry_wait}
    found, start, missing = None, 0, cfg.target_count
    while True:
        asked = -(-missing // cfg.results_per_request) * cfg.results_per_request
        pages = stored(spark.read.format("atom").options(**options | {"start": start, "target_count": asked}).load())
        found = pages if found is None else found.unionByName(pages)
        papers = first_of_each(found, ["arxiv_id"], "submitted", "title")
        start, missing = start + asked, cfg.target_count - papers.count()
        if missing <= 0 or pages.count() < asked:
            return papers.orderBy(F.desc("submitted"), "arxiv_id").limit(cfg.target_count)


def fetched(papers: DataFrame, cfg: Download, get: Callable[..., bytes] = fetch) -> DataFrame:
    """(arxiv_id, content, error): the files that ``papers`` point to.

    ``cfg.parallel`` tasks share one rate: each begins a request no sooner than parallel times the pause after its last,
    so all of them together begin one a pause.
    """
    timeout, retries, wait, parallel = cfg.file_timeout, cfg.retries, cfg.retry_wait, max(1, cfg.parallel)
    every = cfg.pause * parallel

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        after = 0.0
        for b in batches:
            for key, url in zip(b["arxiv_id"], b["pdf_url"]):
                time.sleep(max(0.0, after - time.monotonic()))
                after = time.monotonic() + every
                content, error = None, None
                try:
                    content = get(url, timeout, retries, max(wait, every))
                except OSError as failed:
                    error = f"{type(failed).__name__}: {failed}"
                yield pd.DataFrame([(key, content, error)], columns=["arxiv_id", "content", "error"])

    return papers.select("arxiv_id", "pdf_url").repartition(parallel).mapInPandas(run, "arxiv_id string, content binary, error string")


def there(spark: SparkSession, folder: str) -> DataFrame:
    """(arxiv_id, pdf_path) of the PDFs in a folder, without reading them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    files = read_binary(spark, folder).select(file_name().alias("pdf_path"))
    return files.select(F.url_decode(F.regexp_extract("pdf_path", r"([^/]*)\.pdf$", 1)).alias("arxiv_id"), "pdf_path")


def download(spark: SparkSession, url: str, cfg: Download = Download(), get: Callable[..., bytes] = fetch) -> int:
    """Lists papers, fetches those files that aren't there yet, overwrites the metadata and returns the number of papers that have a file."""
    papers = stored(listed(spark, url, cfg))
    missing = not_done(papers, there(spark, cfg.raw_pdf_dir), "arxiv_id")
    files = stored(fetched(missing, cfg, get)).filter("error is null")
    write_files(files, cfg.raw_pdf_dir, "arxiv_id", "content", ".pdf")
    rows = papers.join(there(spark, cfg.raw_pdf_dir), "arxiv_id").select("arxiv_id", "title", "abstract", "authors", "pdf_path")
    return write_json(rows, cfg.metadata_path)
