"""Embeddings of texts by a pluggable model."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from itertools import chain
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.vectors import normalized


class Embedder(Protocol):
    dimension: int

    def column(self, text: Column) -> Column:
        """array<float> of ``dimension`` for each text."""
        ...


class ModelEmbedder:
    """Wraps ``load() -> encode(list of texts) -> vectors``; the model is loaded once in each worker."""

    def __init__(self, load: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]], dimension: int) -> None:
        self.load, self.dimension = load, dimension

    def column(self, text: Column) -> Column:
        load = self.load

        @F.arrow_udf("array<float>")
        def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            encode = load()
            for batch in batches:
                texts = batch.fill_null("").to_pylist()
                vectors = np.asarray(encode(texts), np.float32).ravel()
                size = len(vectors) // max(1, len(texts))
                yield pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * size, pa.int32()), pa.array(vectors))

        return embed(text)


#: Texts whose words are counted at once, words whose hashes a worker keeps at hand.
TEXTS, WORDS = 1_000, 100_000


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS:
            self.clear()
        self[word] = found = int(hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()[:8], 16)
        return found


class HashEmbedder(ModelEmbedder):
    """Counts of words by hash, signed and scaled to length one. It needs no model and only knows shared words.

    The hash is the first 32 bits of the word's MD5, which SQL has as well; the highest of them is the sign.
    """

    WORD = re.compile(r"\w+")

    def __init__(self, dimension: int = 384) -> None:
        word = self.WORD

        def load() -> Callable[[list[str]], np.ndarray]:
            hashed = _Hashes()

            def counts(texts: list[str]) -> np.ndarray:
                words = [word.findall(text.lower()) for text in texts]
                size = np.fromiter(map(len, words), np.int64, len(words))
                h = np.fromiter(map(hashed.__getitem__, chain.from_iterable(words)), np.int64, int(size.sum()))
                spot = np.repeat(np.arange(len(texts)) * dimension, size) + h % dimension
                return np.bincount(spot, np.where(h >> 31 & 1, 1.0, -1.0), len(texts) * dimension).reshape(-1, dimension)

            def encode(texts: list[str]) -> np.ndarray:
                out = np.zeros((len(texts), dimension), np.float32)
                for a in range(0, len(texts), TEXTS):
                    out[a : a + TEXTS] = counts(texts[a : a + TEXTS])
                length = np.linalg.norm(out, axis=1, keepdims=True)
                return np.divide(out, length, out=out, where=length > 0)

            return encode

        super().__init__(load, dimension)


def embed_chunks(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """``chunks`` with their ``embedding``."""
    return chunks.withColumn("embedding", embedder.column(F.col("text")))


def embed_queries(queries: DataFrame, embedder: Embedder, text: str = "query") -> DataFrame:
    """``queries`` with a ``vector`` of length one."""
    return queries.withColumn("vector", embedder.column(F.col(text))).withColumn("vector", normalized("vector").cast("array<float>"))
