"""Records on disk: JSON arrays, a JSON file for each document, JSON lines, and binary documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corvane.sources.pdf import pdf_text

METADATA = "arxiv_id string, title string, abstract string, authors array<string>, pdf_path string"
PAPER = METADATA + ", full_text string"
CHUNK = "id string, text string, metadata struct<arxiv_id: string, title: string, source: string, chunk_index: int>"
EMBEDDED = CHUNK + ", embedding array<float>"


def read_json_documents(spark: SparkSession, path: str, schema: str = PAPER) -> DataFrame:
    """Files that each hold one record or an array of records. An empty folder is an error."""
    df = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    if not df.inputFiles():
        raise FileNotFoundError(f"no JSON files in {path}")
    return df


def read_metadata(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Metadata as one array over many lines, or as JSON lines."""
    return spark.read.schema(METADATA).option("multiLine", not lines).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str = CHUNK) -> DataFrame:
    """One record a line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> int:
    """Writes JSON lines, creating folders as needed; returns the number of rows written."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).json(path)
    return seen.get["n"]


Extractor = Callable[[bytes], str]


def plain_text(content: bytes) -> str:
    """Takes files for UTF-8 text, but for PDFs, whose text it reads."""
    return pdf_text(content) if content[:1024].lstrip().startswith(b"%PDF") else content.decode("utf-8", errors="replace")


def read_binary(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def extract_texts(files: DataFrame, load: Callable[[], Extractor] = lambda: plain_text) -> DataFrame:
    """(path, full_text, error) of binary files; ``load`` makes the extractor once in each worker. A failure is a row, not the end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extract = load()
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    rows.append((path, extract(bytes(content)), None))
                except Exception as failed:
                    rows.append((path, None, f"{type(failed).__name__}: {failed}"))
            yield pd.DataFrame(rows, columns=["path", "full_text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, full_text string, error string")


def file_name(path: str = "path") -> Column:
    """The path as the file system has it, without a scheme."""
    return F.regexp_replace(path, r"^[a-z]+:/+", "/")
