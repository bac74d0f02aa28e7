"""Settings of each stage, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Download:
    raw_pdf_dir: str = "data/raw/pdf"
    processed_json_dir: str = "data/raw/json"
    metadata_path: str = "data/raw/metadata/metadata.json"
    category: str = "cs.CL"
    start_date: str = "202501010000"
    target_count: int = 10
    results_per_request: int = 5
    search_timeout: float = 30.0
    file_timeout: float = 10.0
    retries: int = 5
    retry_wait: float = 5.0
    pause: float = 1.0
    #: Tasks that fetch files at a time. They share the rate that the pause sets.
    parallel: int = 1


@dataclass(frozen=True)
class Chunking:
    chunk_size: int = 512
    chunk_overlap: int = 50
    output_dir: str = "data/processed"

    def __post_init__(self) -> None:
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("the overlap must be at least 0 and less than the chunk size")

    @property
    def output_path(self) -> str:
        return f"{self.output_dir}/basic_chunks_{self.chunk_size}_{self.chunk_overlap}.jsonl"


@dataclass(frozen=True)
class Embedding:
    output_path: str = "data/processed/basic_chunks_embeddings.jsonl"
    model_name: str = "all-MiniLM-L6-v2"
    dimension: int = 384


@dataclass(frozen=True)
class Index:
    path: str = "data/index"
    collection: str = "papers"
    vector_size: int = 384
    #: How batches of questions are searched: exact, lists (pruned, with codes) or graph (of small worlds).
    method: str = "exact"

    def __post_init__(self) -> None:
        if self.method not in ("exact", "lists", "graph"):
            raise ValueError(f"unknown method {self.method!r}")


@dataclass(frozen=True)
class Generation:
    model_name: str = "extractive"
    max_new_tokens: int = 256


@dataclass(frozen=True)
class Retrieval:
    top_k: int = 5


@dataclass(frozen=True)
class Run:
    """How a pipeline run treats a stage that fails: it runs it again, as often as ``retries`` says."""

    retries: int = 1
    retry_wait: float = 60.0


@dataclass(frozen=True)
class Config:
    download: Download = field(default_factory=Download)
    chunking: Chunking = field(default_factory=Chunking)
    embedding: Embedding = field(default_factory=Embedding)
    index: Index = field(default_factory=Index)
    generation: Generation = field(default_factory=Generation)
    retrieval: Retrieval = field(default_factory=Retrieval)
    run: Run = field(default_factory=Run)
