"""Periodic runs of words: stretches that repeat a unit four times or more, found by bit-parallel lags.

A document's words become numbers and their bits planes, big integers with a bit for each word. For a lag q, planes
shifted by q are XORed with themselves and the results ORed, so a zero bit says that a word equals the word q later.
ANDing the zeros with themselves at doubled shifts leaves those that begin long enough zero stretches; nearly all lags
end there after a few operations. Lags go upwards, so a stretch inside a run of a smaller period is no new run.

In long texts lags from 32 on look at a sample first. Planes are split into S phases, where S is a power of two of at
most q / 16: a stretch of 3q equal pairs has 3q / S of them in phase 0 of the left words, in a row, so that phase is
compared with the phase that the lag leads to. What passes is compared word by word, at its place. All lags of a text of
n words take a time in proportion to n log n then, and the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm import common

#: A run has so many periods and words at least.
TIMES, LEAST = 4, 6
#: Planes that are compared before a lag is given up; words from which on phases are sampled; samples in a period.
FIRST_PLANES, LONG, SAMPLES = 3, 4096, 16
FLUSH = 8_000_000
FOUND = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers, counted up from 0."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint32, len(words))


def planes(ids: np.ndarray, most: int = 32) -> list[int]:
    """The bits of numbers as big integers, the lowest bit's plane first; bit i belongs to number i."""
    if not len(ids):
        return []
    bits = min(most, max(1, int(ids.max()).bit_length()))
    each = np.unpackbits(np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4), axis=1, count=bits, bitorder="little")
    return [int.from_bytes(row.tobytes(), "little") for row in np.packbits(each.T, axis=1, bitorder="little")]


def stretches(left: list[int], right: list[int], shift: int, count: int, need: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Where ``need`` or more of ``count`` bits in a row are equal in all planes of ``left`` and, ``shift`` later, of ``right``.

    Starts and ends of the maximal stretches; None if there are none.
    """
    every = (1 << count) - 1
    for tried in (FIRST_PLANES, len(left)):
        differ = 0
        for a, b in zip(left[:tried], right[:tried]):
            differ |= a ^ (b >> shift)
        equal = every ^ (differ & every)
        have = 1
        while have < need and equal:
            step = min(have, need - have)
            equal &= equal >> step
            have += step
        if not equal:
            return None
        if tried >= len(left):
            break
    marks = np.unpackbits(np.frombuffer(equal.to_bytes(count // 8 + 1, "little"), np.uint8), bitorder="little")
    edges = np.flatnonzero(np.diff(marks, prepend=0, append=0))
    return edges[::2], edges[1::2] + need - 1


class Known:
    """Runs found so far, asked whether one of them holds a stretch."""

    def __init__(self) -> None:
        self.start, self.reach = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, start: np.ndarray, end: np.ndarray) -> None:
        start, end = np.r_[self.start, start], np.r_[self.reach, end]
        order = np.argsort(start, kind="stable")
        self.start, self.reach = start[order], np.maximum.accumulate(end[order])

    def hold(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.zeros(len(start), bool)
        at = np.searchsorted(self.start, start, "right") - 1
        return (at >= 0) & (self.reach[np.maximum(at, 0)] >= end)


def _exact(ids: np.ndarray, low: int, high: int, lag: int, need: int) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``need`` or more equal pairs with a left word from ``low`` to ``high``."""
    edges = np.flatnonzero(np.diff(ids[low:high] == ids[low + lag : high + lag], prepend=False, append=False)) + low
    start, end = edges[::2], edges[1::2]
    long = end - start >= need
    return start[long], end[long]


def find(ids: np.ndarray, times: int = TIMES, least: int = LEAST) -> np.ndarray:
    """(start, length, period) of all runs in an array of numbers, sorted by start and then period.

    A run has its smallest period q, max(least, times * q) items at least, and is maximal for that period. ``times`` is
    at least 2: a stretch of two periods inside a run of a smaller one has that smaller one too. Sampling takes three.
    """
    if times < 2:
        raise ValueError("a run has two periods at least")
    n, known, found = len(ids), Known(), []
    whole, phases, size = planes(ids), [], 1
    for lag in range(1, n // times + 1):
        need = max(least, times * lag) - lag
        if lag + need > n:
            continue
        wanted = 1 << max(0, min(lag // SAMPLES, n // LONG if times > 2 else 0).bit_length() - 1)
        if wanted != size:
            size = wanted
            padded = np.r_[ids, np.zeros(-n % size, ids.dtype)].reshape(-1, size)
            phases = [planes(padded[:, r], FIRST_PLANES + 2) for r in range(size)]
            phases = [p + [0] * (FIRST_PLANES + 2 - len(p)) for p in phases]
        if size == 1:
            here = stretches(whole, whole, lag, n - lag, need)
            if here is None:
                continue
            start, end = here
        else:
            here = stretches(phases[0], phases[lag % size], lag // size, -(-(n - lag) // size), need // size)
            if here is None:
                continue
            new = ~known.hold(here[0] * size, (here[1] - 1) * size + lag + 1)
            exact = [_exact(ids, max(0, (a - 1) * size + 1), min(n - lag, b * size), lag, need) for a, b in zip(here[0][new].tolist(), here[1][new].tolist())]
            start, end = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*exact) if exact else ([], [])))
        new = ~known.hold(start, end + lag)
        start, end = start[new], end[new] + lag
        if len(start):
            known.add(start, end)
            found.append(np.column_stack([start, end - start, np.full(len(start), lag)]))
    out = np.concatenate([np.zeros((0, 3), np.int64), *found])
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n items no run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) == 0


def periodic_runs(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), times: int = TIMES, least: int = LEAST) -> DataFrame:
    """The columns to ``keep`` with n_words, runs (start, length, period; by start and period) and the collapsed text.

    The collapsed text holds the words that no run contains after its first period, joined by one space. Nothing is
    shuffled, and a text is looked at as a whole. Null, empty and white texts have no words, no runs and an empty
    collapsed text. Repeated rows and null ids are rows like any other; of columns only those to keep and text are used,
    and those to keep may not be named as results are.
    """
    clash = {*keep} & {"n_words", "runs", "collapsed"}
    if clash:
        raise ValueError(f"columns to keep have the names of results: {sorted(clash)}")
    out = docs.select(*keep)
    pair = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.flushes(batches, FLUSH, "_text"):
            sizes, all_runs, texts = [], [], []
            for data in common.binary(t["_text"]):
                words = common.words(data)
                runs = find(numbered(words), times, least) if len(words) >= least else np.zeros((0, 3), np.int64)
                sizes.append(len(words))
                all_runs.append(runs)
                texts.append(b" ".join(w for w, k in zip(words, kept(len(words), runs).tolist()) if k) if len(runs) else b" ".join(words))
            flat = np.concatenate([np.zeros((0, 3), np.int64), *all_runs])
            items = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], fields=list(pair))
            runs = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(r) for r in all_runs])].astype(np.int32)), items)
            columns = {c: t[c].combine_chunks() for c in keep} | {"n_words": pa.array(sizes, pa.int64()), "runs": runs, "collapsed": pa.array(texts, pa.binary()).cast(pa.string())}
            yield from pa.table(columns).to_batches()

    schema = out.sparkSession.createDataFrame([], f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in out.schema)}, {FOUND}").schema
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(common.released(run), schema)


def greatest(runs: Column | str) -> Column:
    """The run of the greatest length, of equals that of the smallest start and then period; null if there is none."""
    runs = F.col(runs) if isinstance(runs, str) else runs
    return F.try_element_at(F.array_sort(F.transform(runs, lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))), F.lit(1))


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of ``docs``, where the words of about one text in ten go on in a unit of their own.

    With h = crc32(doc_id in decimal) and g = h div 10: if h % 10 = 0, words from g % n on repeat the first
    1 + (n - a) div (3 + g % 8) of them, a being that place. A null doc_id leaves its text as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    found = docs.select("doc_id", "text", F.expr("crc32(cast(doc_id as string)) div 10").alias("g"), F.when(h % 10 == 0, words).alias("words"))
    found = found.withColumn("n", F.size("words")).withColumn("a", F.expr("if(n > 0, cast(g % n as int), 0)")).withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    unit = F.slice("words", F.col("a") + 1, F.col("p"))
    rest = F.slice(F.flatten(F.array_repeat(unit, F.expr("cast(ceil((n - a) / p) as int)"))), F.lit(1), F.col("n") - F.col("a"))
    return found.select("doc_id", F.when(F.col("n") > 0, F.concat_ws(" ", F.slice("words", F.lit(1), F.col("a")), rest)).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """What ``periodic_runs`` found, in numbers and hashes."""
    best = F.col("best")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.withColumn("best", greatest("runs")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
