"""Removal of every repeated byte string of a given length, by a depth-limited radix sort of all suffixes.

Suffixes are told apart by their first ``length`` bytes only, most significant digit first, and a pass goes on only with
groups that still have two members. Equal groups after the last digit are exactly the repeated windows.

The first digit of a suffix is the anchor of its window: the leftmost of its ANCHOR-byte strings with the least hash.
Equal windows have equal anchors at equal offsets, and neighbouring suffixes share one, so this pass moves one record
for each run of suffixes (about 1 in 50) instead of one for each suffix. The second digit is the whole stretch of bytes
that the run's windows cover: runs that agree in it are repeated at once, all windows together. The third digit, the
window itself, is only needed where stretches with one anchor differ, that is around the ends of repeats, and only for
one run of each different stretch.

Every task first merges what is equal among its own documents, so a string that a third of all documents share reaches
its group at most once a task. Digits are compared as hashes of 56 bits beside the bucket number, which grows with the
corpus. Rows that share an id are documents of their own; where only their texts tell them apart, a 64-bit hash does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import common
from corvane.llm.substring import BUCKET_BASE, HASH_BASE, PACKED, PACKED_DDL, SENT_DDL, attach, bucket_of, buckets_for, by_document, intervals, keyed, mark_blocks, packed, packed_by_bucket, rows_of, sent, split, unpacked

LENGTH, ANCHOR = 200, 100
#: Bytes of text that a task takes at once; records in a bucket, about.
FLUSH, BUCKET = 2_000_000, 1_000_000


class Digits:
    """Hashes of all stretches of the documents of one block, laid end to end."""

    def __init__(self, texts: list[bytes | None], first: common.Rolling, second: common.Rolling) -> None:
        lengths = np.array([len(x or b"") for x in texts], np.int64)
        self.ends = np.cumsum(lengths)
        self.begins = self.ends - lengths
        values = common.BYTE_VALUES[np.frombuffer(b"".join(x or b"" for x in texts), np.uint8)]
        self.n, self.first, self.second = len(values), first, second
        self.one, self.two = first.prefix(values), second.prefix(values)

    def runs(self, length: int, anchor: int) -> tuple[np.ndarray, ...]:
        """Runs of windows with one anchor: row, first and last start, and the anchor's place."""
        none = np.zeros(0, np.int64)
        if self.n < length:
            return none, none, none, none
        h = self.first.windows(self.one, anchor)
        key = (h & ~np.uint64(2**30 - 1)) | (np.arange(len(h), dtype=np.uint64) & np.uint64(2**30 - 1))
        width, done = length - anchor + 1, 1
        while 2 * done <= width:
            key = np.minimum(key[:-done], key[done:])
            done *= 2
        if done < width:
            key = np.minimum(key[: len(key) - (width - done)], key[width - done :])
        row = np.repeat(np.arange(len(self.ends)), self.ends - self.begins)[: len(key)]
        start = np.flatnonzero(np.arange(len(key)) + length <= self.ends[row])
        row, low = row[start], (key[start] & np.uint64(2**30 - 1)).astype(np.int64)
        place = start + ((low - start) & (2**30 - 1))
        new = np.flatnonzero(common.in_order(place) | common.in_order(row) | np.r_[True, np.diff(start) != 1][: len(start)])
        last = np.r_[new[1:], len(start)] - 1 if len(start) else new
        return row[new], start[new], start[last], place[new]


def merge_equal(order_by: np.ndarray, also: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of equal keys (and second keys), and where each group begins in it."""
    order = np.argsort(order_by, kind="stable") if also is None else np.lexsort((also, order_by))
    new = common.in_order(order_by[order])
    return order, new if also is None or not len(order) else new | common.in_order(also[order])


def first_digits(length: int, anchor: int, n: int):
    """First and second digit: a record for each different stretch of a block; later copies are marked at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = common.Rolling(HASH_BASE), common.Rolling(BUCKET_BASE)
        for t in common.flushes(batches, FLUSH):
            ids, tags = t["id"].to_numpy(), t["tag"].to_numpy()
            d = Digits(common.binary(t["text"]), first, second)
            row, a, b, p = d.runs(length, anchor)
            if not len(row):
                continue
            digit = first.spans(d.one, p, p + anchor)
            stretch = first.spans(d.one, a, b + length) ^ common.mixed(((p - a) * 4096 + (b - p)).astype(np.uint64))
            order, new = merge_equal(digit, stretch)
            group = np.cumsum(new) - 1
            lead = order[np.flatnonzero(new)]
            times = np.bincount(group)
            again = order[times[group] > 1]
            begin = d.begins[row]
            marks = mark_blocks(ids[row[again]], tags[row[again]], (a - begin)[again], (b - begin)[again] + length, n)
            lead = np.sort(lead)
            low = np.ascontiguousarray(stretch[lead]).view(np.uint8).reshape(-1, 8)[:, :7]
            extra = np.concatenate([low, (b - a)[lead].astype("<u2").view(np.uint8).reshape(-1, 2)], axis=1)
            bucket = bucket_of(second.spans(d.two, p[lead], p[lead] + anchor), n)
            yield sent(list(packed_by_bucket(bucket, digit[lead], row[lead], (a - begin)[lead], ids, tags, extra.view("V9").ravel())), marks)

    return run


RUNS_DDL = PACKED_DDL + ", final boolean"
RUNS = PACKED.append(pa.field("final", pa.bool_()))


def refine(length: int, n: int):
    """Groups by both digits: equal stretches are repeated; one run of each other stretch with that anchor goes on."""

    def with_kind(marks: pa.Table, final: bool) -> pa.Table:
        return marks.append_column(RUNS.field("final"), pa.array([final] * len(marks), pa.bool_()))

    def run(group: pa.Table) -> pa.Table:
        blocks, done = split(group)
        out = [with_kind(done, True)]
        if blocks:
            h, ids, tags, start, extra = unpacked(blocks)
            raw = extra.view(np.uint8).reshape(-1, 9)
            stretch = np.zeros((len(h), 8), np.uint8)
            stretch[:, :7] = raw[:, :7]
            stretch = stretch.view("<u8").ravel()
            more = np.ascontiguousarray(raw[:, 7:9]).view("<u2").ravel().astype(np.int32)
            order, new = merge_equal(h, stretch)
            part = np.cumsum(new) - 1
            again = order[np.bincount(part)[part] > 1]
            out.append(with_kind(packed(mark_blocks(ids[again], tags[again], start[again], start[again] + more[again] + length, n)), True))
            lead = order[np.flatnonzero(new)]
            anchors = common.in_order(h[lead])
            several = np.bincount(np.cumsum(anchors) - 1)[np.cumsum(anchors) - 1] > 1
            lead = lead[several]
            out.append(with_kind(packed(mark_blocks(ids[lead], tags[lead], start[lead], start[lead] + more[lead] + 1, n)), False))
        return pa.concat_tables(out)

    return run


def last_digit(length: int, n: int, marks_n: int):
    """Third digit: the windows of the runs that go on, one record for each different window of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = common.Rolling(HASH_BASE), common.Rolling(BUCKET_BASE)
        for t in common.flushes(batches, FLUSH):
            ids, tags = t["id"].to_numpy(), t["tag"].to_numpy()
            d = Digits(common.binary(t["text"]), first, second)
            rows, starts = [], []
            for k, spans in enumerate(rows_of(t["spans"].combine_chunks())):
                for x, y in zip(*intervals(spans)):
                    starts.append(np.arange(x, y) + d.begins[k])
                    rows.append(np.full(y - x, k))
            if not starts:
                continue
            at, row = np.concatenate(starts), np.concatenate(rows)
            h = first.spans(d.one, at, at + length)
            order, new = merge_equal(h)
            times = np.bincount(np.cumsum(new) - 1)
            again = order[times[np.cumsum(new) - 1] > 1]
            pos = (at - d.begins[row]).astype(np.int32)
            marks = mark_blocks(ids[row[again]], tags[row[again]], pos[again], pos[again] + length, marks_n)
            lead = np.sort(order[np.flatnonzero(new)])
            bucket = bucket_of(second.spans(d.two, at[lead], at[lead] + length), n)
            yield sent(list(packed_by_bucket(bucket, h[lead], row[lead], pos[lead], ids, tags)), marks)

    return run


def equal_windows(length: int, marks_n: int):
    def run(group: pa.Table) -> pa.Table:
        blocks, done = split(group)
        if not blocks:
            return done
        h, ids, tags, pos = unpacked(blocks)
        order, new = merge_equal(h)
        part = np.cumsum(new) - 1
        again = order[np.bincount(part)[part] > 1]
        return pa.concat_tables([done, packed(mark_blocks(ids[again], tags[again], pos[again], pos[again] + length, marks_n))])

    return run


def repeated_byte_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(doc, removed): rows of ``docs`` (doc_id, text and any more columns) with the intervals of UTF-8 bytes to remove.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in this document or another;
    strings never cross documents. Null, empty and shorter texts lose nothing. Repeated rows are copies of each other.
    An empty table gives an empty one.
    """
    if not 0 < anchor <= length:
        raise ValueError("an anchor is no longer than the strings")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = buckets_for(size // 50, BUCKET)
    records = keyed(docs, "text").mapInArrow(common.released(first_digits(length, anchor, n)), SENT_DDL)
    runs = common.stored(common.in_buckets(records, n).applyInArrow(common.released(refine(length, n)), RUNS_DDL))
    going = common.stored(by_document(runs.filter("not final").drop("final")))
    texts = keyed(docs, "text").join(going, ["id", "tag"]).dropDuplicates(["id", "tag"]).select("id", "tag", "text", "spans")
    windows = going.agg(F.sum("covered")).first()[0] or 0
    window_n = buckets_for(windows)
    sent_on = texts.mapInArrow(common.released(last_digit(length, window_n, n)), SENT_DDL)
    marks = common.in_buckets(sent_on, window_n).applyInArrow(common.released(equal_windows(length, n)), PACKED_DDL)
    return attach(docs, runs.filter("final").drop("final").unionByName(marks))


def digest(found: DataFrame) -> DataFrame:
    """Per document: bytes, removed bytes, maximal removed runs and the SHA-256 of the remaining bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for text, removed in zip(common.binary(b["text"]), rows_of(b["removed"])):
                text, at, sha, gone = text or b"", 0, hashlib.sha256(), 0
                starts, ends = intervals(removed)
                for start, end in zip(starts.tolist(), ends.tolist()):
                    sha.update(text[at:start])
                    at, gone = end, gone + end - start
                sha.update(text[at:])
                out.append((len(text), gone, len(starts), sha.hexdigest()))
            n, gone, spans, sha = zip(*out) if out else ((), (), (), ())
            yield pa.record_batch([b["doc_id"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return found.select("doc.doc_id", "doc.text", "removed").mapInArrow(common.released(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
