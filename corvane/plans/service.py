"""The stages as calls that give a record of what they did, and all of them in a row."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.config import Config
from corvane.operators import index
from corvane.operators.chunking import chunk_documents
from corvane.operators.embedding import Embedder, HashEmbedder, embed_chunks
from corvane.operators.ingest import not_done, with_files
from corvane.operators.rag import ExtractiveGenerator, Generator, rag
from corvane.operators.search import Retriever
from corvane.sources import download as source
from corvane.sources.files import EMBEDDED, PAPER, Extractor, extract_texts, file_name, plain_text, read_binary, read_json_lines, read_metadata, write_json


@dataclass(frozen=True)
class Result:
    """What a stage did; ``failed`` lists at most a hundred failures."""

    stage: str
    count: int
    path: str
    failed: tuple[tuple[str, str], ...] = ()


class Service:
    """The calls of the system. Any error of a stage is raised to the caller."""

    def __init__(self, spark: SparkSession, cfg: Config = Config(), embedder: Embedder | None = None, generator: Generator | None = None, extractor: Callable[[], Extractor] = lambda: plain_text) -> None:
        self.spark, self.cfg, self.extractor = spark, cfg, extractor
        self.embedder = HashEmbedder(cfg.embedding.dimension) if embedder is None else embedder
        self.generator = ExtractiveGenerator() if generator is None else generator

    def download(self, url: str, get: Callable[..., bytes] = source.fetch) -> Result:
        return Result("download", source.download(self.spark, url, self.cfg.download, get), self.cfg.download.metadata_path)

    def parse(self) -> Result:
        """Papers that have no text yet; those whose file is missing or unreadable are told and left for the next time."""
        d = self.cfg.download
        metadata = read_metadata(self.spark, d.metadata_path, lines=True)
        try:
            metadata = not_done(metadata, self.papers(), "arxiv_id")
        except FileNotFoundError:
            pass  # nothing was parsed yet
        files = extract_texts(read_binary(self.spark, d.raw_pdf_dir), self.extractor).withColumn("path", file_name())
        parsed = with_files(metadata.withColumn("pdf_path", file_name("pdf_path")), files).persist()
        try:
            count = write_json(parsed.filter("error is null").drop("error").select(*[c.split()[0] for c in PAPER.split(", ")]), f"{d.processed_json_dir}/{time.time_ns()}")
            failed = parsed.filter("error is not null").select("arxiv_id", "error").limit(100).collect()
        finally:
            parsed.unpersist()
        return Result("parse", count, d.processed_json_dir, tuple((r.arxiv_id, r.error) for r in failed))

    def papers(self) -> DataFrame:
        """All parsed papers, of every run."""
        path = self.cfg.download.processed_json_dir
        try:
            return self.spark.read.schema(PAPER).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
        except AnalysisException as absent:
            if absent.getCondition() == "PATH_NOT_FOUND":
                raise FileNotFoundError(f"no JSON files in {path}") from absent
            raise

    def chunk(self) -> Result:
        c = self.cfg.chunking
        papers = self.papers()
        papers = papers.filter(F.col("arxiv_id").isNotNull() & F.col("title").isNotNull())
        return Result("chunk", write_json(chunk_documents(papers, size=c.chunk_size, overlap=c.chunk_overlap), c.output_path), c.output_path)

    def embed(self) -> Result:
        chunks = read_json_lines(self.spark, self.cfg.chunking.output_path)
        if chunks.isEmpty():
            raise ValueError("there are no chunks to embed")
        return Result("embed", write_json(embed_chunks(chunks, self.embedder), self.cfg.embedding.output_path), self.cfg.embedding.output_path)

    def index(self) -> Result:
        path = f"{self.cfg.index.path}/{self.cfg.index.collection}"
        embedded = read_json_lines(self.spark, self.cfg.embedding.output_path, EMBEDDED)
        count = index.setup(self.spark, embedded, path, self.cfg.index.vector_size)
        if self.cfg.index.method != "exact":
            index.build_near(self.spark, path, self.cfg.index.method)
        return Result("index", count, path)

    def ask(self, *questions: str, top_k: int = 0) -> DataFrame:
        """(query_id, query, answer, retrieved_contexts, scores) for each question."""
        path, method = f"{self.cfg.index.path}/{self.cfg.index.collection}", self.cfg.index.method
        near = None if method == "exact" else lambda asked, k: index.search_near(self.spark, path, method, asked, k)
        retriever = Retriever(index.read(self.spark, path), self.embedder, self.cfg.retrieval.top_k, near=near)
        queries = self.spark.createDataFrame(list(enumerate(questions)), "query_id long, query string")
        return rag(retriever, self.generator, queries, top_k)


def run_pipeline(service: Service, url: str | None = None, **calls: Any) -> list[Result]:
    """All stages in a row, each tried again as often as the settings say. Without an address, papers are there already."""
    stages = [("download", lambda: service.download(url, **calls))] if url else []
    stages += [(s, getattr(service, s)) for s in ("parse", "chunk", "embed", "index")]
    done = []
    for _, stage in stages:
        for left in range(service.cfg.run.retries, -1, -1):
            try:
                done.append(stage())
                break
            except Exception:
                if not left:
                    raise
                time.sleep(service.cfg.run.retry_wait)
    return done
