"""Tokens of texts by byte pairs, and contexts that fit a model's window.

A vocabulary is a file of ``base64(token) rank`` lines, whose path is a parameter. A text is split by the pattern of its
vocabulary, and pairs of neighbours in a part are merged by rank, the lowest first and of equals the leftmost. Candidates
wait in a priority queue and parts are linked lists, so a part of n bytes takes a time in proportion to n log n, however
long it is; short ones, as words are, have theirs searched by plain scans. Parts of a batch are numbered first, so each
different one is merged once a batch, and each worker keeps the tokens of those that it has seen lately, up to KEPT.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import regex
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Fixed value: how byte-level vocabularies of the GPT-2 kind split a text.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEPT, LONGEST_KEPT = 200_000, 40
#: Texts whose tokens a task holds at a time, and characters of them beyond which it takes no further one.
ROWS, CHARACTERS = 256, 2_000_000


class BytePairs:
    """Encodes and decodes by the ranks of merged tokens, in which single bytes are as well."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.ranks, self.pattern = ranks, pattern
        self._split, self._tokens = regex.compile(pattern), {r: t for t, r in ranks.items()}
        self._kept, self._before, self._none = {}, {}, max(ranks.values(), default=0) + 1
        self._shared: dict[str, Broadcast] = {}

    def __reduce__(self) -> tuple:
        return BytePairs, (self.ranks, self.pattern)

    def part(self, data: bytes) -> list[int]:
        """The ranks of a part's tokens after all merges."""
        return self._scanned(data) if len(data) <= LONGEST_KEPT else self._queued(data)

    def word(self, text: str) -> tuple[int, ...]:
        """``part`` of a text. What was asked for lately is kept; once half of KEPT came, those before them go."""
        found = self._kept.get(text)
        if found is None:
            found = self._before.get(text)
            if found is None:
                found = tuple(self.part(text.encode()))
            if len(text) <= LONGEST_KEPT:
                if len(self._kept) >= KEPT // 2:
                    self._before, self._kept = self._kept, {}
                self._kept[text] = found
        return found

    def _scanned(self, data: bytes) -> list[int]:
        ranks, none = self.ranks, self._none
        parts = [data[i : i + 1] for i in range(len(data))]
        rank = [ranks.get(data[i : i + 2], none) for i in range(len(data) - 1)]  # of a part merged with the next
        while rank and (low := min(rank)) < none:
            at = rank.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del rank[at]
            if at < len(rank):
                rank[at] = ranks.get(parts[at] + parts[at + 1], none)
            if at:
                rank[at - 1] = ranks.get(parts[at - 1] + parts[at], none)
        return [ranks[p] for p in parts]

    def _queued(self, data: bytes) -> list[int]:
        n, ranks = len(data), self.ranks
        end, back = list(range(1, n + 1)), list(range(-1, n - 1))  # of the token that begins at a place
        alive = [True] * n
        queue: list[tuple[int, int, int]] = []  # rank, place, end of the merged token

        def offer(at: int) -> None:
            if 0 <= at and end[at] < n:
                past = end[end[at]]
                rank = ranks.get(data[at:past])
                if rank is not None:
                    heapq.heappush(queue, (rank, at, past))

        for at in range(n - 1):
            offer(at)
        while queue:
            _, at, past = heapq.heappop(queue)
            if not alive[at] or end[at] >= n or end[end[at]] != past:
                continue  # one of the two was merged with another
            alive[end[at]] = False
            end[at] = past
            if past < n:
                back[past] = at
            offer(at)
            offer(back[at])
        out, at = [], 0
        while at < n:
            out.append(ranks[data[at : end[at]]])
            at = end[at]
        return out

    def encode(self, text: str) -> list[int]:
        return self.encoded([text])[0].tolist()

    def encoded(self, texts: Sequence[str]) -> list[np.ndarray]:
        """The token ids of each text, each different part of all of them looked up once."""
        split = [self._split.findall(t) for t in texts]
        sizes = [len(s) for s in split]
        numbers, parts = pd.factorize(np.array([p for s in split for p in s], dtype=object))
        del split
        found = [self.word(p) for p in parts]
        length = np.array([len(f) for f in found], np.int64)
        begin = np.cumsum(length) - length
        flat = np.fromiter((r for f in found for r in f), np.int32, int(length.sum()))
        each = length[numbers]
        upto = np.cumsum(each)
        ids = flat[np.repeat(begin[numbers] - upto + each, each) + np.arange(int(each.sum()))]
        ends = np.concatenate([[0], upto])[np.cumsum(sizes, dtype=np.int64)]
        return np.split(ids, ends[:-1]) if len(ends) else []

    def size(self, text: str, most: float = float("inf")) -> int | None:
        """The number of a text's tokens; None if there are more than ``most``, for which no more than these are made."""
        n = 0
        for m in self._split.finditer(text):
            n += len(self.word(m[0]))
            if n > most:
                return None
        return n

    def decode(self, ids: Sequence[int]) -> str:
        return b"".join(self._tokens[i] for i in ids).decode(errors="replace")

    def cut(self, text: str, most: int) -> str:
        """The longest start of a text that has ``most`` tokens at most and ends with a whole character and a whole token."""
        out, left = [], most
        for m in self._split.finditer(text):
            ids = self.word(m[0])
            if len(ids) > left:
                out.append(b"".join(self._tokens[i] for i in ids[: max(left, 0)]).decode(errors="ignore"))
                break
            out.append(m[0])
            left -= len(ids)
        return "".join(out)


def read_vocabulary(spark: SparkSession, path: str, pattern: str = PATTERN) -> BytePairs:
    """Reads a vocabulary, wherever Spark reads texts from. A few megabytes at most, which go to each task that encodes."""
    lines = (r.value.split() for r in spark.read.text(path).filter("value != ''").collect())
    return BytePairs({base64.b64decode(token): int(rank) for token, rank in lines}, pattern)


def _shared(spark: SparkSession, pairs: BytePairs) -> Broadcast:
    """One copy of a vocabulary for all functions of an application, so a worker has one and keeps tokens once."""
    return pairs._shared.setdefault(spark.sparkContext.applicationId, spark.sparkContext.broadcast(pairs))


def _pieces(texts: Sequence[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of at most ROWS texts, which end with the one that brings them to CHARACTERS."""
    first = size = 0
    for at, text in enumerate(texts, 1):
        size += len(text or "")
        if at - first == ROWS or size >= CHARACTERS:
            yield first, at
            first, size = at, 0
    if first < len(texts):
        yield first, len(texts)


def token_ids(spark: SparkSession, pairs: BytePairs) -> Callable[[Column], Column]:
    """A function of a text column that gives array<int>; null gives null."""
    shared = _shared(spark, pairs)

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            for a, b in _pieces(texts.tolist()):
                some = texts.iloc[a:b].tolist()
                ids = shared.value.encoded([t or "" for t in some])
                yield pd.Series([None if t is None else i for t, i in zip(some, ids)], dtype=object)

    return run


def decoded(spark: SparkSession, pairs: BytePairs) -> Callable[[Column], Column]:
    """A function of a column of token ids that gives the text; null gives null."""
    shared = _shared(spark, pairs)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            for a in range(0, len(rows), ROWS):
                yield pd.Series([None if ids is None else shared.value.decode(ids.tolist()) for ids in rows.iloc[a : a + ROWS]], dtype=object)

    return run


def fitting(spark: SparkSession, pairs: BytePairs, most: int, separator: str = "\n\n") -> Callable[[Column, Column], Column]:
    """A function of (contexts, prompt without contexts) that gives the contexts which fit into ``most`` tokens with that prompt.

    Contexts are taken in their order; the first that doesn't fit is cut to the tokens that are left, and those after
    it go. Separators count. A prompt that is too long by itself leaves none.
    """

    def fit(pairs: BytePairs, contexts: Sequence[str], rest: str) -> list[str]:
        left, out, between = most - pairs.size(rest), [], pairs.size(separator)
        for text in contexts:
            left -= between if out else 0
            n = pairs.size(text, left)
            if n is None:
                text = pairs.cut(text, left)
                return out + [text] * bool(text)
            out.append(text)
            left -= n
        return out

    shared = _shared(spark, pairs)

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for contexts, rest in batches:
            for a in range(0, len(rest), ROWS):
                rows = zip(contexts.iloc[a : a + ROWS], rest.iloc[a : a + ROWS])
                yield pd.Series([None if c is None or r is None else fit(shared.value, c, r) for c, r in rows], dtype=object)

    return run
