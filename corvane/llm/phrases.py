"""Fingerprints of documents by the phrases of their Lempel-Ziv parse.

A text is parsed from left to right into the shortest phrases that were not seen before (LZ78), code point by code point.
What two texts have in common shows in the phrases that both have, as it would if one were compressed with the other's
dictionary. The fingerprint is a minimum-hash signature of the set of phrases: their hashes fall into BINS bins, each of
which keeps the least; the share of bins that agree estimates the likeness of the sets. The dictionary starts anew every
SPAN code points, which bounds memory for any text.

Neighbours in the order of ids meet by one shuffle of compressed texts: ranges of ids go to partitions of bounded size,
each of which also gets the first document of the next, and stream through sorted.
"""

from __future__ import annotations

import gc
import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm import common

BINS, SPAN = 128, 2**22
#: Hex digits of a bin; a bin that no phrase falls into holds the greatest number.
DIGITS, EMPTY = 8, 2**32 - 1
FLUSH, PART = 8_000_000, 16_000_000
#: Keys that ranges are drawn from, at most.
SAMPLE = 100_000
_BASE = 0x9E3779B97F4A7C15


class Parser:
    """Parses texts into phrases and signs them."""

    def __init__(self) -> None:
        self.rolling = common.Rolling(_BASE)

    @staticmethod
    def _parse(text: str, at: int, state: tuple[dict, str | None], root: dict, ends: list[int], added: list[tuple[dict, str]]) -> tuple[dict, str | None]:
        """Goes on from ``state`` in the dictionary of phrases, to which new ones are added; ``at`` is the place of the text.

        A phrase that none goes on from is None in the dictionary. The state is a place in it and, if the open phrase is
        such a one, its last character.
        """
        node, open_at = state
        rest = iter(text)
        left, total = rest.__length_hint__, at + len(text)
        if open_at is not None:
            for c in rest:
                node[open_at] = {c: None}
                added.append((node, open_at))
                ends.append(total - left())
                break
            else:
                return state
            node = root
        for c in rest:
            child = node.get(c, 0)
            if child:
                node = child
            elif child is None:
                for d in rest:
                    node[c] = {d: None}
                    added.append((node, c))
                    ends.append(total - left())
                    break
                else:
                    return node, c
                node = root
            else:
                node[c] = None
                added.append((node, c))
                ends.append(total - left())
                node = root
        return node, None

    def _least(self, text: str, ends: list[int]) -> np.ndarray:
        """The signature of the phrases that end at ``ends``."""
        out = np.full(BINS, EMPTY, np.uint32)
        if ends:
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            end = np.array(ends)
            h = np.sort(self.rolling.spans(self.rolling.prefix(common.mixed(codes + np.uint64(1))), np.r_[0, end[:-1]], end))
            bins = (h >> np.uint64(57)).astype(np.int64)
            first = common.in_order(bins)
            out[bins[first]] = np.minimum((h[first] >> np.uint64(25)) & np.uint64(EMPTY), EMPTY - 1)
        return out

    def sign(self, text: str) -> np.ndarray:
        """The signature of a text: the least hash in each bin."""
        return self.sign_both(text, len(text), "")[0]

    def sign_both(self, text: str, place: int, tail: str) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of a text and of the text whose end from ``place`` on is replaced by ``tail``; the common start is parsed once."""
        on = gc.isenabled()
        gc.disable()  # dictionaries of phrases have no cycles, and looking for some in them takes longer than parsing
        try:
            return self._sign_both(text, place, tail)
        finally:
            if on:
                gc.enable()

    def _sign_both(self, text: str, place: int, tail: str) -> tuple[np.ndarray, np.ndarray]:
        shared = np.full(BINS, EMPTY, np.uint32)
        begin = 0
        while place - begin > SPAN:
            shared = np.minimum(shared, self._alone(text[begin : begin + SPAN]))
            begin += SPAN
        root: dict = {}
        ends: list[int] = []
        start = text[begin:place]
        state = self._parse(start, 0, (root, None), root, ends, [])
        both = []
        for end in (text[place:], tail) if place < len(text) or tail else ("",):
            found, added = [*ends], []
            first = end[: SPAN - len(start)]
            self._parse(first, len(start), state, root, found, added)
            out = np.minimum(shared, self._least(start + first, found))
            for node, c in reversed(added):
                if node[c] is None:
                    del node[c]
                else:
                    node[c] = None
            for at in range(SPAN - len(start), len(end), SPAN):
                out = np.minimum(out, self._alone(end[at : at + SPAN]))
            both.append(out)
        return both[0], both[-1]

    def _alone(self, text: str) -> np.ndarray:
        root: dict = {}
        ends: list[int] = []
        self._parse(text, 0, (root, None), root, ends, [])
        return self._least(text, ends)


def written(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def alike(a: np.ndarray, b: np.ndarray) -> float:
    """The share of bins in which two signatures agree, of those that either fills; 1 for two empty ones."""
    filled = (a != EMPTY) | (b != EMPTY)
    return float(((a == b) & filled).sum() / filled.sum()) if filled.any() else 1.0


def likeness(a: Column | str, b: Column | str) -> Column:
    """``alike`` for two columns of written fingerprints."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    bins = F.sequence(F.lit(0), F.lit(BINS - 1))
    part = lambda x, i: F.substring(x, i * DIGITS + 1, F.lit(DIGITS))
    filled = F.filter(F.transform(bins, lambda i: F.struct(part(a, i).alias("a"), part(b, i).alias("b"))), lambda p: (p["a"] != "f" * DIGITS) | (p["b"] != "f" * DIGITS))
    return F.coalesce(F.try_divide(F.size(F.filter(filled, lambda p: p["a"] == p["b"])), F.size(filled)), F.lit(1.0))


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to ``keep`` with n_chars (code points) and the fingerprint, BINS * 8 hexadecimal digits, of each whole text.

    Equal texts have equal fingerprints; null counts as empty, which fills no bin. Nothing is shuffled. Repeated rows and
    null ids are rows like any other; of columns only those to keep and text are used, and those to keep may not be named
    as results are.
    """
    clash = {*keep} & {"n_chars", "fingerprint"}
    if clash:
        raise ValueError(f"columns to keep have the names of results: {sorted(clash)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser()
        for t in common.flushes(batches, FLUSH, "_text"):
            texts = [(x or b"").decode() for x in common.binary(t["_text"])]
            columns = {c: t[c].combine_chunks() for c in keep} | {"n_chars": pa.array(map(len, texts), pa.int64()), "fingerprint": pa.array([written(parser.sign(x)) for x in texts], pa.string())}
            yield from pa.table(columns).to_batches()

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(common.released(run), f"{ddl}, n_chars long, fingerprint string")


def _ranges(keys: DataFrame) -> tuple[list[tuple[int, int]], dict[tuple[int, int], list[int]], int]:
    """Where ranges of keys begin, the ranges that get a copy of a range's first key, and the number of ranges."""
    n, size = keys.agg(F.count(F.lit(1)), F.sum("size")).first()
    wanted = min(common.MOST_PARTITIONS, max(-(-(size or 0) // PART), min(keys.sparkSession.sparkContext.defaultParallelism, (size or 0) // 2**20), 1))
    some = sorted((r["at"], r["tie"], r["size"]) for r in common.sampled(keys, min(SAMPLE, max(1000, 20 * wanted)), n, "at", "tie"))
    sums = list(accumulate(s + 100 for _, _, s in some))
    bounds = sorted({some[bisect_right(sums, sums[-1] * k // wanted)][:2] for k in range(1, wanted)}) if some else []

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, tuple[int, int]] = {}
        for b in batches:
            for key in zip(b["at"].to_pylist(), b["tie"].to_pylist()):
                p = bisect_right(bounds, key)
                if p not in least or key < least[p]:
                    least[p] = key
        yield pa.RecordBatch.from_pydict({"part": pa.array(least, pa.int32()), "at": pa.array([k[0] for k in least.values()], pa.int64()), "tie": pa.array([k[1] for k in least.values()], pa.int64())})

    found = keys.select("at", "tie").mapInArrow(first, "part int, at long, tie long").groupBy("part").agg(F.min(F.struct("at", "tie")).alias("key"))
    firsts = sorted((r["part"], tuple(r["key"])) for r in found.collect())  # a row for each range
    guests: dict[tuple[int, int], list[int]] = {}
    for k, (part, _) in enumerate(firsts):
        guests.setdefault(firsts[(k + 1) % len(firsts)][1], []).append(part)
    return bounds, guests, len(bounds) + 1


PAIRED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def beside_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text of ``docs`` (doc_id, text) and of its edited text, and their likeness to it and to the next document's.

    Documents are in descending order of doc_id, null ids last, equal ids by a hash of their texts; after the last comes
    the first. The edited text has the last floor(n_chars / 2) code points replaced by the first as many, or all, of the
    next document. A null text counts as empty. Rows that are equal follow one another and are rows of the result each. A
    single row is followed by itself; an empty table gives an empty one. Other columns aren't used.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    at = F.coalesce(F.bitwise_not(F.col("doc_id").cast("long")), F.lit(common.NO_ID))
    rows = docs.select(at.alias("at"), F.xxhash64(text).alias("tie"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    keys = common.stored(rows.select("at", "tie", F.octet_length("text").cast("long").alias("size")))
    bounds, guests, n = _ranges(keys)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for t in common.flushes(batches, FLUSH):
            once: dict[tuple[int, int, int | None], list] = {}
            for a, tie, i, data in zip(t["at"].to_pylist(), t["tie"].to_pylist(), t["doc_id"].to_pylist(), common.binary(t["text"])):
                if (a, tie, i) in once:
                    once[a, tie, i][1] += 1
                else:
                    once[a, tie, i] = [press.compress(data), 1]
            out = [(bisect_right(bounds, k[:2]), False, *k, copies, data) for k, (data, copies) in once.items()]
            out += [(part, True, *k, 1, once[k][0]) for k in once for part in guests.get(k[:2], ())]
            kinds = (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            for few in range(0, len(out), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out[few : few + 2000]), kinds)], names=["part", "guest", "at", "tie", "doc_id", "copies", "payload"])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, expand = Parser(), zstandard.ZstdDecompressor()
        names, kinds = [c.split()[0] for c in PAIRED.split(", ")], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        last: tuple[int | None, int, str] | None = None  # a document that waits for the next
        signed: tuple | None = None  # one that waits for the next one's signature
        out: list[tuple] = []

        def told(own: tuple, after: np.ndarray) -> tuple:
            i, text, edited, a, b = own
            return (i, len(text), hashlib.sha256(edited.encode()).hexdigest(), written(a), written(b), alike(a, b), alike(a, after))

        done = False
        for batch in batches:
            for guest, i, copies, payload in zip(*(batch[c].to_pylist() for c in ("guest", "doc_id", "copies", "payload"))):
                if done:
                    continue
                text = expand.decompress(payload).decode()
                if last is not None:
                    before, own_copies, own = last
                    half = len(own) // 2
                    place = len(own) - half
                    for k in range(own_copies):
                        head = (text if k == own_copies - 1 else own)[:half]
                        a, b = parser.sign_both(own, place, head)
                        if signed is not None:
                            out.append(told(signed, a))
                        signed = (before, own, own[:place] + head, a, b)
                if guest:
                    if signed is not None:
                        out.append(told(signed, parser.sign(text)))
                    done = True
                last = (i, copies, text)
                if len(out) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names=names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names=names)

    dealt = rows.mapInArrow(common.released(deal), "part int, guest boolean, at long, tie long, doc_id long, copies long, payload binary")
    return dealt.repartitionById(n, F.col("part")).sortWithinPartitions("part", "guest", "at", "tie").mapInArrow(common.released(follow), PAIRED)
