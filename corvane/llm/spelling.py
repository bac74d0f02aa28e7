"""Grouping of spelling variants: words at one inserted, deleted or replaced character, through automata in both directions.

A word is searched in two halves. If the error is in the second half, a near word begins with the first: the forward
automaton matches that exactly and completes it with one error. If it is in the first half, the backward automaton, of
reversed words, does the same from the end. Automata are minimal and acyclic, and count the words below each edge, so a
path through them gives the number of its word in sorted order.

An error has one place: the first at which the two words differ. A search only takes errors at that place, so a pair is
found once, by one half, and needs no shuffle to be told from another finding.

Words meet by what has to match exactly: (length of the asking word, part with the error, what stands before and after
it). Such a group is divided if it has more than HOT words: the part with the error is cut in two, and words meet by the
three parts that have to match then. A part of one character has few words in any case.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm import common

LEAST_LENGTH, LEAST_TIMES, RATIO = 5, 3, 2
RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: One run in so many loses a character before words are counted.
DAMAGED = 97
#: Words that a task counts before it sends them; words and queries of a bucket, about; a group's before it is divided.
HELD, BUCKET, HOT = 300_000, 60_000, 30_000
FLUSH = 8_000_000


class Automaton:
    """The minimal acyclic automaton of sorted, distinct words. Edges tell the state they lead to and how many words come before."""

    def __init__(self, words: list[bytes]) -> None:
        self.edges: list[dict[int, tuple[int, int]]] = []
        self.final: list[bool] = []
        self._size: list[int] = []
        self._known: dict[tuple, int] = {}
        open_: list[tuple[list[bool], list[tuple[int, int]]]] = [([False], [])]
        last = b""
        for word in words:
            common_to = 0
            for common_to, (a, b) in enumerate(zip(last, word)):
                if a != b:
                    break
            else:
                common_to = min(len(last), len(word))
            self._close(open_, last, common_to)
            open_ += [([False], []) for _ in range(len(word) - common_to)]
            open_[-1][0][0] = True
            last = word
        self._close(open_, last, 0)
        self.start = self._state(*open_[0])
        del self._known

    def _close(self, open_: list, word: bytes, to: int) -> None:
        for at in range(len(word) - 1, to - 1, -1):
            state = self._state(*open_.pop())
            open_[-1][1].append((word[at], state))

    def _state(self, final: list[bool], edges: list[tuple[int, int]]) -> int:
        key = (final[0], *edges)
        found = self._known.get(key)
        if found is None:
            found = self._known[key] = len(self.edges)
            before, out = int(final[0]), {}
            for c, state in edges:
                out[c] = (state, before)
                before += self._size[state]
            self.edges.append(out)
            self.final.append(final[0])
            self._size.append(before)
        return found

    def number(self, tail: bytes, state: int | None = None, number: int = 0) -> int | None:
        """The number of the word that ``tail`` completes from a state; None if there is none."""
        state = self.start if state is None else state
        edges = self.edges
        for c in tail:
            step = edges[state].get(c)
            if step is None:
                return None
            state = step[0]
            number += step[1]
        return number if self.final[state] else None

    def one_error(self, word: bytes, first: int, last: int, forward: bool = True) -> list[int]:
        """Numbers of the words that differ from ``word`` by one error at ``first`` to ``last`` and match exactly elsewhere.

        Characters are replaced and deleted at places from first up to last, and inserted at gaps: before these places
        (at the end as well, if that is the last), or after them in a reversed word. Of places that come to the same
        the last counts, or the first in a reversed word.
        """
        state, number, n, found = self.start, 0, len(word), []
        for c in word[:first]:
            step = self.edges[state].get(c)
            if step is None:
                return found
            state, number = step[0], number + step[1]
        for at in range(first, last + 1):
            edges = self.edges[state]
            inside = at < last
            gap = inside or at == n if forward else at > first or at == 0
            if forward:
                beside = word[at] if at < n else None
                twin = at + 1 < n and inside and word[at] == word[at + 1]
            else:
                beside = word[at - 1] if at else None
                twin = at > 0 and inside and word[at] == word[at - 1]
            for c, (state_of, before) in edges.items():
                if gap and c != beside:
                    k = self.number(word[at:], state_of, number + before)
                    if k is not None:
                        found.append(k)
                if inside and c != word[at]:
                    k = self.number(word[at + 1 :], state_of, number + before)
                    if k is not None:
                        found.append(k)
            if not inside:
                break
            if not twin:
                k = self.number(word[at + 1 :], state, number)
                if k is not None:
                    found.append(k)
            step = edges.get(word[at])
            if step is None:
                break
            state, number = step[0], number + step[1]
        return found


def counted(docs: DataFrame, least_length: int = LEAST_LENGTH, least_times: int = LEAST_TIMES, damaged: int = 0) -> DataFrame:
    """(word, n): maximal runs of Latin letters in ``docs`` (text, and doc_id if ``damaged``), A-Z lower-cased, with how often they occur.

    If ``damaged`` is over 0, a run loses the character h % length, h being the crc32 of "<doc_id>:<run>", where damaged
    divides h; rows without an id lose none. Tasks count before words are shuffled.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})

        for t in common.flushes(batches, FLUSH):
            for doc, data in zip(t["doc_id"].to_pylist(), common.binary(t["text"])):
                here = Counter(RUN.findall((data or b"").translate(common.LOWER).decode()))
                if damaged and doc is not None:
                    start = zlib.crc32(f"{doc}:".encode())
                    for word, n in here.items():
                        h = zlib.crc32(word.encode(), start)
                        if h % damaged == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                        if len(word) >= least_length:
                            held[word] += n
                else:
                    for word, n in here.items():
                        if len(word) >= least_length:
                            held[word] += n
                if len(held) > HELD:
                    yield told()
                    held.clear()
        yield told()

    some = docs.select(F.col("doc_id").cast("string").alias("doc_id") if damaged else F.lit(None).cast("string").alias("doc_id"), "text")
    return some.mapInArrow(common.released(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_times)


def _key() -> Column:
    """What words have to share to meet: the asking word's length, the part with the error, and what is around it."""
    after = F.col("asks_length") - F.col("stop")
    return F.xxhash64("asks_length", "begin", "stop", F.substring("word", F.lit(1), F.col("begin")), F.when(after > 0, F.substring("word", -after, after)))


def _parts(words: DataFrame) -> DataFrame:
    """(word, n, asks_length, begin, stop, asks): each word under the halves of words that are as long, or one character shorter or longer."""
    length = F.length("word")
    to = F.explode(F.filter(F.array(length - 1, length, length + 1), lambda x: x >= 1))
    halves = F.explode(F.array(F.struct(F.lit(0).alias("begin"), F.expr("asks_length div 2").alias("stop")), F.struct(F.expr("asks_length div 2").alias("begin"), F.col("asks_length").alias("stop"))))
    return words.withColumn("asks_length", to).withColumn("half", halves).select("word", "n", "asks_length", "half.begin", "half.stop", (F.col("asks_length") == length).alias("asks"))


def _divided(rows: DataFrame, hot_size: int) -> DataFrame:
    """``rows`` with their key, those of large groups under the two parts of the part with the error, until no group is large."""
    rows = rows.withColumn("key", _key())
    done: DataFrame | None = None
    while True:
        large = common.stored(rows.filter("stop - begin > 1").groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > hot_size).select("key"))
        n = large.count()
        if not n:
            return rows if done is None else done.unionByName(rows)
        large = F.broadcast(large) if n <= 100_000 else large
        rows = common.stored(rows.join(large.withColumn("large", F.lit(True)), "key", "left"))
        cold = rows.filter("large is null").drop("large")
        done = cold if done is None else done.unionByName(cold)
        parts = F.explode(F.array(F.struct("begin", F.expr("(begin + stop) div 2").alias("stop")), F.struct(F.expr("(begin + stop) div 2").alias("begin"), "stop")))
        rows = rows.filter("large").withColumn("part", parts).select("word", "n", "asks_length", "part.begin", "part.stop", "asks").withColumn("key", _key())


def _search(group: pa.Table) -> pa.Table:
    """(word, n, n_near, most, form) for each asking word of a bucket: how many near words it has here, and the most frequent of them."""
    rows = list(zip(*(group[c].to_pylist() for c in ("word", "n", "asks_length", "begin", "stop", "asks"))))
    sides = []
    for forward in (True, False):
        own = {}
        for word, n, length, begin, stop, _ in rows:
            if forward == (begin >= length - stop):
                data = word.encode("latin-1")
                own[data if forward else data[::-1]] = n
        words = sorted(own)
        sides.append((Automaton(words), words, [own[w] for w in words]))
    out = []
    for word, n, length, begin, stop, asks in rows:
        if not asks:
            continue
        forward = begin >= length - stop
        automaton, words, sizes = sides[not forward]
        data = word.encode("latin-1")
        found = automaton.one_error(data, begin, stop) if forward else automaton.one_error(data[::-1], length - stop, length - begin, False)
        if found:
            most = max(sizes[k] for k in found)
            best = min(words[k] if forward else words[k][::-1] for k in found if sizes[k] == most)
            out.append((word, n, len(found), most, best.decode("latin-1")))
        else:
            out.append((word, n, 0, None, None))
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.table([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["word", "n", "n_near", "most", "form"])


def near_words(words: DataFrame, ratio: int = RATIO, hot_size: int = HOT) -> DataFrame:
    """(word, n, n_near, form, form_n) for distinct ``words`` (word, n) of Latin letters.

    n_near counts the words that differ by exactly one inserted, deleted or replaced character. The form is that of the
    largest n, of equals the first in code-point order, if its n is at least ``ratio`` times the word's; null otherwise.
    An empty table gives an empty one.
    """
    words = common.stored(words.select("word", "n"))
    n = max(1, -(-6 * words.count() // BUCKET))
    rows = _divided(_parts(words), hot_size).withColumn("bucket", F.pmod("key", F.lit(n)).cast("int"))
    found = common.in_buckets(rows.select("bucket", "word", "n", "asks_length", "begin", "stop", "asks"), n).applyInArrow(common.released(_search), "word string, n long, n_near long, most long, form string")
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("most")).alias("less"), "form", "most")))
    total = found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    is_form = F.col("best.most") >= ratio * F.col("n")
    return total.select("word", "n", "n_near", F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, F.col("best.most")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) for ``links`` (word, form): where forms lead in the end. n at least doubles with each, so there are no rings.

    Each round follows twice as many forms as the one before.
    """
    found = common.stored(links.select("word", F.col("form").alias("root")))
    while True:
        after = found.select(F.col("word").alias("root"), F.col("root").alias("later"))
        moved = common.stored(found.join(after, "root", "left").select("word", F.coalesce("later", "root").alias("root"), F.col("later").isNotNull().alias("moved")))
        found = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return found


def variants(docs: DataFrame, damaged: int = 0) -> DataFrame:
    """(word, form, root, n, n_near, form_n): the words of ``docs`` with the frequent word that each is probably a variant of.

    The root is where forms lead in the end, the word itself if it has none. Null and empty texts have no words; an empty
    table gives an empty one. Repeated rows count as often as they occur. Other columns of ``docs`` aren't used.
    """
    found = common.stored(near_words(counted(docs, damaged=damaged)))
    ends = roots(found.filter("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
