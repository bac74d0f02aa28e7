"""What several operators share: words, rolling hashes, packed arrays and tables in the shared folder."""

from __future__ import annotations

import ctypes
import inspect
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, GroupedData, Row, SparkSession
from pyspark.sql import functions as F

from corvane.tables import alone as alone
from corvane.tables import stored as stored

#: Maps the bytes A-Z to a-z and leaves all others.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Stands for a null doc_id: such rows come after every other.
NO_ID = 2**63 - 1
MOST_PARTITIONS = 20_000
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_COMPRESS, _EXPAND = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def words(text: str | bytes | None, lower: bool = False) -> list[bytes]:
    """The maximal runs of bytes other than space and U+0009 to U+000D; none for null.

    ``bytes.split`` splits at exactly these six bytes, which ``str.split`` does not.
    """
    if not text:
        return []
    data = text.encode() if isinstance(text, str) else text
    return (data.translate(LOWER) if lower else data).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_key(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def sampled(df: DataFrame, want: int, of: int, *keys: str) -> list[Row]:
    """About ``want`` of ``of`` rows, those with the least hashes of their keys, the least first.

    Tasks send on only what is taken, so what reaches the driver does not grow with them; repeated rows can't swell it.
    """
    h = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), *keys), 1)
    chosen = df.withColumn("_h", h).filter(F.col("_h") < int(2**63 * min(1.0, want / max(of, 1))) if want < of else F.lit(True))
    return sorted(chosen.limit(2 * want + 100).collect(), key=lambda r: (r["_h"], *((r[k] is None, r[k] or 0) for k in keys)))


def in_buckets(df: DataFrame, n: int) -> GroupedData:
    """``df`` by its bucket from 0 to ``n``: a partition for each up to MOST_PARTITIONS, so tasks keep their size; beyond, by hash."""
    dealt = df.repartitionById(n, F.col("bucket")) if n <= MOST_PARTITIONS else df.repartition(MOST_PARTITIONS, "bucket")
    return dealt.groupBy("bucket")


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def released(run: Callable) -> Callable:
    """``run``, for mapInArrow or applyInArrow, after which the worker gives memory back: idle workers stay beside busy ones."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _give_back()

    def group(table: pa.Table) -> pa.Table:
        out = run(table)
        _give_back()
        return out

    return stream if inspect.isgeneratorfunction(run) else group


def binary(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """A text or binary column as Python bytes, without decoding."""
    return column.cast(pa.large_binary()).to_pylist()


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the entropy of polynomial hashes, whose low bits are weak, over all 64 bits."""
    h = (h ^ (h >> np.uint64(32))) * MIX_1
    h = (h ^ (h >> np.uint64(29))) * MIX_2
    return h ^ (h >> np.uint64(32))


#: A hash for each byte value.
BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * MIX_1)


class HashTable:
    """Numbers by 64-bit keys, for arrays of keys; open addressing, no key is put in twice."""

    def __init__(self, bits: int) -> None:
        self.shift, self.keys, self.numbers = np.uint64(64 - bits), np.zeros(2**bits, np.uint64), np.zeros(2**bits, np.int32)

    @staticmethod
    def _key(h: np.ndarray) -> np.ndarray:
        return np.maximum(mixed(h), np.uint64(1))

    def find(self, h: np.ndarray, absent: int) -> np.ndarray:
        h = self._key(h)
        at = (h >> self.shift).astype(np.int64)
        key = self.keys[at]
        out = np.where(key == h, self.numbers[at], absent)
        go = np.flatnonzero((key != h) & (key != 0))
        while len(go):
            at[go] = (at[go] + 1) % len(self.keys)
            key = self.keys[at[go]]
            same = key == h[go]
            out[go[same]] = self.numbers[at[go[same]]]
            go = go[~same & (key != 0)]
        return out

    def put(self, h: np.ndarray, numbers: np.ndarray) -> None:
        h = self._key(h)
        at, go = (h >> self.shift).astype(np.int64), np.arange(len(h))
        while len(go):
            free = go[self.keys[at[go]] == 0]
            self.keys[at[free]] = h[free]  # of several that want one place, the last has it
            held = free[self.keys[at[free]] == h[free]]
            self.numbers[at[held]] = numbers[held]
            go = np.setdiff1d(go, held, assume_unique=True)
            at[go] = (at[go] + 1) % len(self.keys)


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions start to start + size of each part, one after another."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column's rows, one after another, and where each begins and ends; null rows are empty."""
    column = column.cast(pa.binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def batches_of(places: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of items (item k from places[k] to places[k+1]) of about ``most`` in all, one item at least."""
    a = 0
    while a < len(places) - 1:
        b = max(a + 1, int(np.searchsorted(places, places[a] + most, "right")) - 1)
        yield a, b
        a = b


class WordHash(dict):
    """Hashes of words that agree in all processes; keeps those of frequent words at hand."""

    MOST = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found

    def array(self, of: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, of), np.uint64, len(of))


class Rolling:
    """Rabin-Karp hashes modulo 2**64 of all windows of an array, by one prefix sum.

    The hash of items i to i+n is the sum of v[i+j] * base**j.
    """

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base | 1, pow(base | 1, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", self.inverse)):
                p = np.full(size, np.uint64(base))
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def prefix(self, v: np.ndarray) -> np.ndarray:
        self._powers(len(v) + 1)
        out = np.zeros(len(v) + 1, np.uint64)
        np.cumsum(v * self.up[: len(v)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the items start to end, an array of each."""
        return mixed((prefix[end] - prefix[start]) * self.down[start])

    def windows(self, prefix: np.ndarray, n: int) -> np.ndarray:
        """Hashes of every n items in a row."""
        count = max(0, len(prefix) - n)
        return mixed((prefix[n:] - prefix[:count]) * self.down[:count])


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of integers as compressed bytes; give sorted ones as differences."""
    head = b"".join(len(a).to_bytes(4, "little") + a.dtype.str.encode().ljust(4) for a in arrays)
    return _COMPRESS.compress(bytes([len(arrays)]) + head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack(payload: bytes) -> list[np.ndarray]:
    data = _EXPAND.decompress(payload)
    at, out = 1 + 8 * data[0], []
    for k in range(data[0]):
        head = data[1 + 8 * k : 9 + 8 * k]
        n, kind = int.from_bytes(head[:4], "little"), np.dtype(head[4:].decode().strip())
        out.append(np.frombuffer(data, kind, n, at))
        at += n * kind.itemsize
    return out


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that intervals cover together, in order; runs that touch become one."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    first = np.r_[True, start[1:] > reach[:-1]]
    return start[first], reach[np.r_[first[1:], True]]


def in_order(groups: np.ndarray) -> np.ndarray:
    """Where a new group begins in a sorted array."""
    return np.r_[True, groups[1:] != groups[:-1]] if len(groups) else np.zeros(0, bool)


def flushes(batches: Iterable[pa.RecordBatch], most_bytes: int, text: str = "text") -> Iterator[pa.Table]:
    """Joins and cuts the batches of a partition into tables of about ``most_bytes`` of text; a row stays whole."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch[text]), 0)).astype(np.int64))
        begin = 0
        while begin < len(batch):
            base = lengths[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(lengths, base + most_bytes - size, "right")))
            end = min(end, len(batch))
            held.append(batch.slice(begin, end - begin))
            size += int(lengths[end - 1] - base)
            begin = end
            if size >= most_bytes or begin < len(batch):
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)
