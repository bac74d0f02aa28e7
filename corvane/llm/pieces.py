"""SentencePiece encoding and decoding with a given vocabulary; giant documents by a max-plus parallel scan.

A text is encoded as the segmentation of greatest total score: the path of a max-plus semiring. Its spaces are marked,
one mark is put before it, and characters that no piece covers become byte pieces, so decoding gives the text back
exactly. Scores are integers, so sums don't depend on their order. The vocabulary's file orders pieces by merge rank,
not by probability; scores follow Zipf's law in that rank.

Of equally good segmentations the one whose last piece is the longest is taken, then whose last but one is, and so on.

A text of up to CHUNK characters is one chunk. A giant one is cut into chunks anywhere. A boundary's state is how far
the piece across it reaches into the next chunk. A chunk's transfer matrix holds the best score from each state at its
begin to each at its end, and the order of those paths by the rule for ties. Matrices combine associatively in the
max-plus product; a scan over a document's matrices (states times states times chunks, whatever the texts) gives the
state of the best path at every boundary, and then each chunk backtraces its own pieces, apart from all others. A giant
text gets the same pieces as it would in one chunk. No task holds more than a chunk but the one that collects the
document's piece numbers.

Inside a chunk, no piece crosses a place where a mark follows another character (true of the vocabulary, and checked),
so each different stretch between such places is solved once. A worker remembers solved stretches by a hash of their
bytes, in arrays, and gathers pieces and decoded bytes from there; what is decoded is compared with the text, so two
stretches of one hash are noticed.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import common

MARK, UNIT, SHORT = "▁", 1_000_000, 64
#: Characters in a chunk, stretches that a worker remembers, bytes of text and characters of new stretches solved at once.
CHUNK, REMEMBERED, FLUSH, UNITS = 32_000, 400_000, 400_000, 50_000
#: Chunks of giant texts whose matrices or pieces, as Python objects, a task holds.
CHUNKS_AT_ONCE = 32
#: Stands for a mark that the text itself holds: a lone surrogate, which no text and no piece can hold.
OWN_MARK = "\ud800"
WORST, LONGER = -(2**60), 2**30


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by number with integer scores; ``byte`` gives the number of each byte's piece; None if a number has no text."""

    pieces: tuple[str | None, ...]
    scores: tuple[int, ...]
    byte: tuple[int, ...]

    @cached_property
    def table(self) -> dict[str, tuple[int, int]]:
        return {p: (s, k) for k, (p, s) in enumerate(zip(self.pieces, self.scores)) if p is not None}

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.table), default=1)

    @cached_property
    def unknown(self) -> int:
        return min(self.scores) - 10 * UNIT

    @cached_property
    def in_bytes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the bytes of each piece begin, their number, and those of all pieces."""
        of_byte = {k: bytes([b]) for b, k in enumerate(self.byte)}
        raw = [of_byte.get(k, (p or "").replace(MARK, " ").encode()) for k, p in enumerate(self.pieces)]
        size = np.array(list(map(len, raw)), np.int64)
        return np.cumsum(size) - size, size, np.frombuffer(b"".join(raw), np.uint8)


def load(path: str | None = None) -> Vocabulary:
    """A vocabulary with byte pieces from a SentencePiece model file; by default the public one that is installed."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    special = [model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k) for k in range(n)]
    pieces = tuple(None if special[k] else model.id_to_piece(k) for k in range(n))
    byte = tuple(model.piece_to_id(f"<0x{b:02X}>") for b in range(256))
    if bad := [p for p in pieces if p is not None and not re.fullmatch(f"{MARK}*[^{MARK}]*", p)]:
        raise ValueError(f"pieces with a mark after another character: {bad[:5]}")
    if len(set(byte)) != 256 or not all(model.is_byte(k) for k in byte):
        raise ValueError("the vocabulary lacks byte pieces")
    rank = np.cumsum([not s for s in special])
    scores = tuple(-round(UNIT * math.log(float(r) + 2.7)) for r in rank)
    return Vocabulary(pieces, scores, byte)


CUT = re.compile(f"(?<=[^{MARK}]){MARK}")


def as_marks(text: str) -> str:
    return text.replace(MARK, OWN_MARK).replace(" ", MARK)


def marked(text: str) -> str:
    """The text as pieces see it; nothing for nothing."""
    return as_marks(f" {text}") if text else ""


HASH_BASE, TABLE_BITS = np.uint64(0x9E3779B97F4A7C15), 19


def extended(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (h + c + np.uint64(1)) * HASH_BASE


def with_marks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows with one space before each that isn't empty."""
    some = offsets[1:] > offsets[:-1]
    return np.insert(data, offsets[:-1][some], 32), offsets + np.r_[0, np.cumsum(some)]


def strings(data: np.ndarray, offsets: np.ndarray, valid: pa.Array) -> pa.Array:
    """Decoded rows as texts, without the space before each; bytes that are no UTF-8 become U+FFFD."""
    first = offsets[:-1][offsets[1:] > offsets[:-1]]
    keep = np.ones(len(data), bool)
    keep[first[data[first] == 32]] = False
    offsets = np.r_[0, np.cumsum(keep)][offsets].astype(np.int32)
    raw = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[keep]))])
    try:
        texts = raw.cast(pa.string())
    except pa.ArrowInvalid:
        texts = pa.array([x.decode(errors="replace") for x in raw.to_pylist()], pa.string())
    return pa.compute.if_else(valid, texts, pa.scalar(None, pa.string()))


def as_text(ids: np.ndarray, cuts: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that rows of pieces stand for, and where each row begins and ends."""
    at, size, raw = vocabulary.in_bytes
    n = size[ids]
    return raw[common.ragged(at[ids], n)], np.r_[0, np.cumsum(n, dtype=np.int64)][cuts]


class Lattice:
    """Best paths over marked text; of equally good ones that whose last piece is the longest, then the one before it."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.table, self.longest, self.unknown = vocabulary.table, vocabulary.longest, vocabulary.unknown
        self.score_of, self.byte = np.array(vocabulary.scores, np.int64), np.array(vocabulary.byte, np.int32)
        self.hashed = common.Rolling(int(HASH_BASE))
        self.prefixes = self._prefixes()
        self.forget()

    def _prefixes(self) -> common.HashTable:
        """The number of each piece, -1 for what only begins one, by a hash of their characters."""
        numbers: dict[str, int] = {}
        for p, (_, k) in self.table.items():
            for n in range(1, len(p)):
                numbers.setdefault(p[:n], -1)
            numbers[p] = k
        found = common.HashTable(max(TABLE_BITS, len(numbers).bit_length() + 1))
        by_length: dict[int, list[str]] = {}
        for p in numbers:
            by_length.setdefault(len(p), []).append(p)
        for n, same in by_length.items():
            c = np.frombuffer("".join(same).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64).reshape(-1, n)
            h = np.zeros(len(same), np.uint64)
            for j in range(n):
                h = extended(h, c[:, j])
            found.put(h, np.array([numbers[p] for p in same], np.int32))
        return found

    def forget(self, most: int = 0) -> None:
        """Drops what is known of stretches and makes room for REMEMBERED, or ``most``: about 50 bytes each."""
        most = most or REMEMBERED
        self.most, self.count, self.used = most, 0, 0
        self.known = common.HashTable((2 * most).bit_length())
        self.total, self.at, self.size = np.zeros(most, np.int64), np.zeros(most, np.int64), np.zeros(most, np.int32)
        self.ids = np.zeros(4 * most, np.int32)

    def bytes_of(self, c: str) -> list[int]:
        return [self.v.byte[b] for b in {OWN_MARK: MARK, MARK: " "}.get(c, c).encode()]

    def forward(self, text: str, begin: int, stop: int) -> tuple[list[int], list[tuple[int, int]]]:
        """Best scores from begin to each place, over pieces that start before stop, and the last piece of each."""
        best, back = [WORST] * (len(text) + 1), [(-1, -1)] * (len(text) + 1)
        best[begin] = 0
        get, longest, n = self.table.get, self.longest, len(text)
        for i in range(begin, stop):
            base = best[i]
            if base == WORST:
                continue
            j, x = i + 1, get(text[i])
            s = base + (x[0] if x else self.unknown)
            if s > best[j]:
                best[j], back[j] = s, (i, x[1] if x else -1)
            for j in range(i + 2, min(n, i + longest) + 1):
                x = get(text[i:j])
                if x and base + x[0] > best[j]:
                    best[j], back[j] = base + x[0], (i, x[1])
        return best, back

    def path(self, text: str, back: list[tuple[int, int]], begin: int, end: int) -> list[int]:
        out: list[int] = []
        while end > begin:
            i, k = back[end]
            if k >= 0:
                out.append(k)
            else:
                out += reversed(self.bytes_of(text[i]))
            end = i
        return out[::-1]

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Total score of each row, where its pieces begin, and the pieces of all rows.

        ``data``: the rows' bytes with their marks, which are spaces here. Stretches are found by hashes, each different
        one solved once; rows whose pieces don't give their bytes back, as hashes of two stretches agreed, are solved anew.
        """
        space = data == 32
        new = space.copy()
        new[1:] &= ~space[:-1]
        new[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
        start = np.flatnonzero(new)
        entry = self._entries(data, start, np.r_[start[1:], len(data)])
        of_row = np.searchsorted(start, offsets)
        size = self.size[entry]
        total = np.r_[0, np.cumsum(self.total[entry])][of_row]
        cuts = np.r_[0, np.cumsum(size, dtype=np.int64)][of_row]
        ids, total = self.ids[common.ragged(self.at[entry], size)], np.diff(total)
        text, _ = as_text(ids, cuts, self.v)
        if len(text) != len(data) or (text != data).any():
            rows = [self._alone(data[a:b]) for a, b in zip(offsets, offsets[1:])]
            total, cuts = np.array([r[0] for r in rows], np.int64), np.r_[0, np.cumsum([len(r[1]) for r in rows])]
            ids = np.array(list(chain.from_iterable(r[1] for r in rows)), np.int32)
        return total, cuts, ids

    def _alone(self, data: np.ndarray) -> tuple[int, list[int]]:
        text = as_marks(data.tobytes().decode())
        best, back = self.forward(text, 0, len(text))
        return best[-1], self.path(text, back, 0, len(text))

    def _entries(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Where each stretch is known, after solving those that aren't."""
        h = self.hashed.spans(self.hashed.prefix(common.BYTE_VALUES[data]), start, end)
        at = self.known.find(h, -1)
        new = np.flatnonzero(at < 0)
        if not len(new):
            return at
        some = new[np.unique(h[new], return_index=True)[1]]
        if self.count + len(some) > self.most:
            new = np.arange(len(h))
            some = np.unique(h, return_index=True)[1]
            self.forget(max(REMEMBERED, len(some)))
        size = end[some] - start[some]
        raw = data[common.ragged(start[some], size)]
        ends = np.cumsum(size)
        lengths = np.diff(np.r_[0, np.cumsum((raw & 0xC0) != 0x80)][np.r_[0, ends]])
        order = np.argsort(-lengths, kind="stable")
        some, size, lengths = some[order], size[order], lengths[order]
        c = np.frombuffer(data[common.ragged(start[some], size)].tobytes().decode().encode("utf-32-le"), "<u4").astype(np.uint64)
        own = c == ord(MARK)
        c[c == 32] = ord(MARK)
        c[own] = ord(OWN_MARK)
        places = np.r_[0, np.cumsum(lengths)]
        a, n = 0, int(np.searchsorted(-lengths, -SHORT))  # long stretches come first and are solved one by one
        for k in range(n):
            text = c[places[k] : places[k + 1]].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            best, back = self.forward(text, 0, len(text))
            ids = np.array(self.path(text, back, 0, len(text)), np.int32)
            self._keep(h[some[k : k + 1]], np.array([best[-1]]), np.array([len(ids)]), ids)
        for a, b in common.batches_of(places[n:], UNITS):
            self._keep(h[some[n + a : n + b]], *self._solve(c[places[n + a] : places[n + b]], lengths[n + a : n + b]))
        at[new] = self.known.find(h[new], -1)
        return at

    def _keep(self, h: np.ndarray, total: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        a, b = self.count, self.count + len(h)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.r_[self.ids[: self.used], np.zeros(len(ids) + len(self.ids) // 2, np.int32)]
        self.total[a:b], self.size[a:b], self.at[a:b] = total, size, self.used + np.cumsum(size) - size
        self.ids[self.used : self.used + len(ids)] = ids
        self.known.put(h, np.arange(a, b, dtype=np.int32))
        self.count, self.used = b, self.used + len(ids)

    def _solve(self, c: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same as ``forward`` and ``path`` for many stretches at once, longest first: total scores, sizes and pieces."""
        many, ends = len(lengths), np.cumsum(lengths)
        starts, end_of = ends - lengths, np.repeat(ends, lengths)
        most = min(self.longest, int(lengths[0]))
        score = np.full((most + 1, len(c)), WORST, np.int64)
        piece = np.full((most + 1, len(c)), -1, np.int32)
        i, h = np.arange(len(c)), np.zeros(len(c), np.uint64)
        for n in range(1, most + 1):
            fits = i + n <= end_of[i]
            i, h = i[fits], h[fits]
            h = extended(h, c[i + n - 1])
            k = self.prefixes.find(h, -2)
            score[n, i] = np.where(k >= 0, self.score_of[k], self.unknown if n == 1 else WORST)
            piece[n, i] = np.maximum(k, -1)
            i, h = i[k > -2], h[k > -2]
        begin = starts + np.arange(many)  # of each stretch's places, one more than its characters
        best, back = np.full(len(c) + many, WORST, np.int64), np.zeros(len(c) + many, np.int32)
        best[begin] = 0
        for j in range(1, int(lengths[0]) + 1):
            t = int(np.searchsorted(-lengths, -j, "right"))  # stretches that are long enough
            top, last = np.full(t, WORST, np.int64), np.zeros(t, np.int32)
            for n in range(min(most, j), 0, -1):
                x = best[begin[:t] + j - n] + score[n, starts[:t] + j - n]
                better = x > top
                top, last = np.where(better, x, top), np.where(better, n, last)
            best[begin[:t] + j], back[begin[:t] + j] = top, last
        who, at, steps, size = np.arange(many), lengths.copy(), [], np.zeros(many, np.int64)
        while len(who):
            n = back[begin[who] + at[who]]
            at[who] -= n
            steps.append((who, size[who], piece[n, starts[who] + at[who]], starts[who] + at[who]))
            size[who] += 1
            who = who[at[who] > 0]
        who, back_at, found, place = (np.concatenate(x) for x in zip(*steps))
        to = np.cumsum(size)[who] - 1 - back_at
        ids, place_of = np.empty(len(to), np.int32), np.empty(len(to), np.int64)
        ids[to], place_of[to] = found, place
        odd = ids < 0
        if odd.any():
            x = c[place_of[odd]].astype("<u4")
            x = np.where(x == ord(MARK), 32, np.where(x == ord(OWN_MARK), ord(MARK), x)).astype("<u4")
            raw = x.tobytes().decode("utf-32-le").encode()
            lead = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
            times = np.ones(len(ids), np.int64)
            times[odd] = np.diff(np.r_[lead, len(raw)])
            size = np.diff(np.r_[0, np.cumsum(times)[np.cumsum(size) - 1]])
            ids = np.repeat(ids, times)
            ids[ids < 0] = self.byte[np.frombuffer(raw, np.uint8)]
        return best[begin + lengths], size, ids

    def whole(self, text: str) -> tuple[int, list[int]]:
        """Total score and pieces of a marked text."""
        data = np.frombuffer(text.replace(MARK, " ").replace(OWN_MARK, MARK).encode(), np.uint8)
        total, _, ids = self.block(data, np.array([0, len(data)]))
        return int(total[0]), ids.tolist()

    def _cuts(self, text: str, n: int) -> tuple[int, int] | None:
        """First and last place inside the chunk that no piece crosses."""
        first = CUT.search(text, 0, n)
        if first is None:
            return None
        last = n
        while True:
            last = text.rfind(MARK, 1, last)
            if text[last - 1] != MARK:
                return first.start(), last

    def _lengths(self, back: list[tuple[int, int]], begin: int, end: int) -> tuple[int, ...]:
        """Lengths of the pieces of a path, the last first; what comes before its begin counts as longer than any piece."""
        out = []
        while end > begin:
            out.append(end - back[end][0])
            end = back[end][0]
        return (*out, LONGER)

    def transfer(self, text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The matrix of a chunk and its ranks: text holds its n characters and those that pieces from it may reach."""
        states = self.longest
        m, rank = np.full((states, states), WORST, np.int64), np.zeros((states, states), np.int64)
        cuts = self._cuts(text, n)
        reach = min(len(text), n + states - 1)
        if cuts is None:
            paths: list[list[tuple[int, ...]]] = [[() for _ in range(states)] for _ in range(states)]
            for i in range(min(states, n)):
                best, back = self.forward(text[:reach], i, n)
                m[i, : reach - n + 1] = best[n : reach + 1]
                for b in range(reach - n + 1):
                    paths[i][b] = self._lengths(back, i, n + b) if best[n + b] > WORST else ()
            for i in range(n, min(states, reach + 1)):  # a piece may reach over the whole chunk
                m[i, i - n], paths[i][i - n] = 0, (LONGER,)
            for b in range(states):
                rank[:, b] = ranks([paths[i][b] for i in range(states)])
            return m, rank
        first, last = cuts
        middle = self.whole(text[first:last])[0]
        best, _ = self.forward(text[last:reach], 0, n - last)
        tail = np.array(best[n - last :], np.int64)
        heads: list[tuple[int, ...]] = [() for _ in range(states)]
        for i in range(min(states, first + 1)):
            best, back = self.forward(text[i:first], 0, first - i)
            row = best[-1] + middle + tail
            m[i, : len(row)] = np.where(tail > WORST // 2, row, WORST)
            heads[i] = self._lengths(back, 0, first - i)
        rank[:] = ranks(heads)[:, None]
        return m, rank

    def backtrace(self, text: str, n: int, begin: int, end: int) -> list[int]:
        """The pieces that start in the chunk on its best path from one state to the other."""
        cuts = self._cuts(text, n)
        if begin >= n:
            return []
        if cuts is None:
            _, back = self.forward(text[: n + end], begin, n)
            return self.path(text[: n + end], back, begin, n + end)
        first, last = cuts
        head, tail = text[begin:first], text[last : n + end]
        out = self.path(head, self.forward(head, 0, len(head))[1], 0, len(head))
        out += self.whole(text[first:last])[1]
        return out + self.path(tail, self.forward(tail, 0, n - last)[1], 0, len(tail))


def ranks(keys: Sequence[tuple]) -> np.ndarray:
    """The place of each key among the different ones in order."""
    place = {x: k for k, x in enumerate(sorted(set(keys)))}
    return np.array([place[x] for x in keys], np.int64)


#: Best scores from each state at a chunk's begin to each at its end, and, by end, the order of the paths for ties.
Matrix = tuple[np.ndarray, np.ndarray]


def middles(a: Matrix, b: Matrix) -> tuple[np.ndarray, np.ndarray]:
    """Best total from each state to each over two chunks, and the state between them: of ties that of the greatest rank."""
    total = a[0][:, :, None] + b[0][None, :, :]
    best = total.max(1)
    return best, np.where(total == best[:, None, :], b[1][None, :, :], -1).argmax(1)


def product(a: Matrix, b: Matrix) -> Matrix:
    """The max-plus product of two transfer matrices; paths are ordered by the last chunk first, so this is associative."""
    best, at = middles(a, b)
    states = np.arange(len(best))
    order = np.stack([b[1][at, states[None, :]], a[1][states[:, None], at]], axis=-1)
    rank = np.stack([ranks([tuple(x) for x in order[:, k].tolist()]) for k in states], axis=1)
    return np.maximum(best, WORST), rank


def scan(matrices: Sequence[Matrix]) -> list[int]:
    """The state at every boundary, first and last included, of the best path from state 0 to state 0.

    Matrices are combined in pairs up a tree; states are set down it: a pair's middle state is the best one between the
    two states at its ends. So depth grows as the logarithm of the chunks.
    """
    levels = [list(matrices)]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([product(x[i], x[i + 1]) if i + 1 < len(x) else x[i] for i in range(0, len(x), 2)])
    states = [0, 0]
    for x in reversed(levels[:-1]):
        down = [states[0]]
        for i in range(0, len(x), 2):
            end = states[i // 2 + 1]
            if i + 1 < len(x):
                down.append(int(middles(x[i], x[i + 1])[1][states[i // 2], end]))
            down.append(end)
        states = down
    return states


def _list(ids: np.ndarray, cuts: np.ndarray, valid: pa.Array | None = None) -> pa.Array:
    mask = None if valid is None else pa.compute.invert(valid)
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids, pa.int32()), mask=mask)


_lattices: list[Lattice] = []


def lattice_of(vocabulary: Vocabulary) -> Lattice:
    """The worker's lattice of a vocabulary: what one task solved, the next tasks know."""
    if not _lattices or _lattices[0].v is not vocabulary:
        _lattices[:] = [Lattice(vocabulary)]
    return _lattices[0]


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from (b.slice(at, CHUNKS_AT_ONCE) for at in range(0, len(b), CHUNKS_AT_ONCE))


def _chunks(docs: DataFrame, reach: int, chunk: int) -> DataFrame:
    """(row, k, n, part) of giant texts after a space: chunks with what pieces may reach beyond them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, text in zip(b["row"].to_pylist(), b["text"].to_pylist()):
                text = f" {text}"
                for k, at in enumerate(range(0, len(text), chunk)):
                    n = min(chunk, len(text) - at)
                    yield pa.RecordBatch.from_pydict({"row": pa.array([row]), "k": pa.array([k], pa.int32()), "n": pa.array([n], pa.int32()), "part": pa.array([text[at : at + n + reach]])})

    return docs.select("row", "text").mapInArrow(common.released(run), "row long, k int, n int, part string")


def encode(docs: DataFrame, vocabulary: Vocabulary | None = None, chunk: int = CHUNK, restored: str | None = None) -> DataFrame:
    """``docs`` (text and any more columns) with ``pieces`` (array<int>) and ``score`` (log of Zipf's law, summed).

    ``restored`` names a column for the text that the pieces decode to, which saves sending them to another worker.

    A null text has null pieces, an empty one none; both have score 0. Texts are encoded whole. Columns of the two names
    are replaced. An empty table gives an empty one.
    """
    vocabulary = vocabulary or load()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    columns = [c for c in docs.columns if c not in ("pieces", "score")]
    inner = docs.select(F.struct(*columns).alias("doc"), "text")
    ddl = T.StructType([inner.schema["doc"], T.StructField("pieces", T.ArrayType(T.IntegerType())), T.StructField("score", T.DoubleType())])
    if restored:
        ddl = ddl.add("_decoded", T.StringType())

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(shared.value)
        for whole in batches:
            for at, to in common.batches_of(common.text_buffer(whole["doc"].field("text"))[1], FLUSH):
                b = whole.slice(at, to - at)
                texts = b["doc"].field("text")
                total, cuts, ids = lattice.block(*with_marks(*common.text_buffer(texts)))
                out = [b["doc"], _list(ids, cuts, texts.is_valid()), pa.array(total / UNIT)]
                if restored:
                    out.append(strings(*as_text(ids, cuts, lattice.v), texts.is_valid()))
                yield pa.RecordBatch.from_arrays(out, names=ddl.names)

    is_giant = F.coalesce(F.length("text") > chunk, F.lit(False))
    encoded = inner.filter(~is_giant).select("doc").mapInArrow(common.released(small), ddl)
    giants = common.stored(inner.filter(is_giant).withColumn("row", F.monotonically_increasing_id()))
    chunks = common.stored(_chunks(giants, vocabulary.longest - 1, chunk).repartition("row", "k"))

    def transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(shared.value)
        for b in _few(batches):
            m = [np.stack(lattice.transfer(as_marks(t), n)).tobytes() for t, n in zip(b["part"].to_pylist(), b["n"].to_pylist())]
            yield pa.RecordBatch.from_arrays([b["row"], b["k"], pa.array(m, pa.binary())], names=["row", "k", "matrix"])

    def states(group: pa.Table) -> pa.Table:
        group = group.sort_by("k")
        size = shared.value.longest
        matrices = [tuple(np.frombuffer(x, np.int64).reshape(2, size, size)) for x in group["matrix"].to_pylist()]
        at = scan(matrices)
        score = [int(m[a, b]) for (m, _), a, b in zip(matrices, at, at[1:])]
        return pa.table([group["row"], group["k"], pa.array(at[:-1], pa.int32()), pa.array(at[1:], pa.int32()), pa.array(score, pa.int64())], names=["row", "k", "begin", "end", "part_score"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(shared.value)
        for b in _few(batches):
            rows = [lattice.backtrace(as_marks(t), *x) for t, *x in zip(*(b[c].to_pylist() for c in ("part", "n", "begin", "end")))]
            ids = np.fromiter(chain.from_iterable(rows), np.int32)
            yield pa.RecordBatch.from_arrays([b["row"], b["k"], _list(ids, np.r_[0, np.cumsum(list(map(len, rows)))]), b["part_score"]], names=["row", "k", "ids", "part_score"])

    ends = chunks.select("row", "k", "n", "part").mapInArrow(common.released(transfers), "row long, k int, matrix binary").groupBy("row").applyInArrow(common.released(states), "row long, k int, begin int, end int, part_score long")
    traced = chunks.join(ends, ["row", "k"]).mapInArrow(common.released(pieces), "row long, k int, ids array<int>, part_score long")
    parts = traced.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x.ids)).alias("pieces"), (F.sum("part_score") / UNIT).alias("score"))
    long_ones = giants.join(parts, "row").select("doc", "pieces", "score")
    if restored:
        long_ones = decode(long_ones, vocabulary, into="_decoded")
    kept = [F.col("doc").getField(c).alias(c) for c in columns if c != restored]
    return encoded.unionByName(long_ones).select(*kept, "pieces", "score", *([F.col("_decoded").alias(restored)] if restored else []))


def decode(encoded: DataFrame, vocabulary: Vocabulary | None = None, into: str = "text") -> DataFrame:
    """``encoded`` (pieces and any more columns) with the decoded text as column ``into``; null pieces give null.

    Byte pieces that are no UTF-8 become U+FFFD.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary or load())
    columns = [c for c in encoded.columns if c != into]
    inner = encoded.select(F.struct(*columns).alias("doc"), "pieces")
    ddl = T.StructType([inner.schema["doc"], T.StructField("_decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            lengths = np.r_[0, np.cumsum(pa.compute.list_value_length(whole["pieces"]).fill_null(0).to_numpy())]
            for at, to in common.batches_of(lengths, FLUSH // 4):
                b = whole.slice(at, to - at)
                ids = b["pieces"].flatten().to_numpy(zero_copy_only=False)
                texts = strings(*as_text(ids, lengths[at : to + 1] - lengths[at], shared.value), b["pieces"].is_valid())
                yield pa.RecordBatch.from_arrays([b["doc"], texts], names=["doc", "_decoded"])

    return inner.mapInArrow(common.released(run), ddl).select("doc.*", F.col("_decoded").alias(into))
