"""Removal of passages that an earlier document already has, by Rabin-Karp hashes of every word window.

Each task hashes every window of its documents by one prefix sum, keeps of each hash only the occurrences in its
smallest document (later ones are marked at once), and sends hash, document and position to the hash's bucket, packed.
So a window that a third of all documents share reaches its bucket at most once a task. A bucket marks the windows whose
hash has a smaller document; marks return by document, where they merge into maximal removal intervals.

Hashes have 56 bits beside the bucket number, which grows with the corpus. Null ids come after all others. Rows that
share an id never remove from each other; where their texts differ, a 64-bit hash of the text, the tag, tells them apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import common

WINDOW = 50
#: Windows in a bucket, about; and bytes of text that a task takes at once.
BUCKET, FLUSH = 2_000_000, 3_000_000
HASH_BASE, BUCKET_BASE = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03


def buckets_for(items: int, size: int = BUCKET) -> int:
    return max(1, -(-items // size))


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def packed_by_bucket(bucket: np.ndarray, h: np.ndarray, row: np.ndarray, pos: np.ndarray, ids: np.ndarray, tags: np.ndarray, extra: np.ndarray | None = None) -> Iterator[tuple[int, bytes]]:
    """Blocks of (hash, row's id and tag, position, extra), one for each bucket; the input is sorted by row and position."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(common.in_order(bucket[order]))
    for begin, end in zip(cuts, [*cuts[1:], len(order)]):
        at = order[begin:end]
        low = np.ascontiguousarray(h[at]).view(np.uint8).reshape(-1, 8)[:, :7].ravel()
        new = np.flatnonzero(common.in_order(row[at]))
        rows = row[at][new]
        block = [low, np.diff(ids[rows], prepend=0), tags[rows], np.diff(np.r_[new, len(at)]).astype(np.uint32), np.diff(pos[at], prepend=0).astype(np.int32)]
        yield int(bucket[at[0]]), common.pack(*block, *([] if extra is None else [np.ascontiguousarray(extra[at])]))


def gathered(payloads: list[bytes]) -> list[np.ndarray]:
    """hash, row, position and any extra column of all blocks of a bucket, after the id and tag of each row."""
    heads: list[list[np.ndarray]] = []
    columns: list[list[np.ndarray]] = []
    rows = 0
    for payload in payloads:
        low, ids, tags, counts, pos, *extra = common.unpack(payload)
        h = np.zeros((len(low) // 7, 8), np.uint8)
        h[:, :7] = low.reshape(-1, 7)
        row = np.repeat(np.arange(rows, rows + len(ids), dtype=np.int32), counts)
        heads.append([np.cumsum(ids), tags.copy()])
        # copies, as views would keep all of an unpacked block
        columns.append([h.view("<u8").ravel(), row, np.cumsum(pos, dtype=np.int32), *(x.copy() for x in extra)])
        rows += len(ids)
    out = [np.concatenate(x) for x in zip(*heads)]
    for _ in range(len(columns[0])):  # each column goes from the blocks as it is joined
        out.append(np.concatenate([x.pop(0) for x in columns]))
    return out


def unpacked(payloads: list[bytes]) -> list[np.ndarray]:
    """hash, id, tag, position and any extra column of all blocks of a bucket."""
    ids, tags, h, row, *more = gathered(payloads)
    return [h, ids[row], tags[row], *more]


def mark_blocks(ids: np.ndarray, tags: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> list[tuple[int, bytes]]:
    """Intervals to mark, merged by document and packed by the document's bucket."""
    if not len(ids):
        return []
    order = np.lexsort((start, tags, ids))
    ids, tags, start, end = ids[order], tags[order], start[order].astype(np.int64), end[order].astype(np.int64)
    doc = np.cumsum(common.in_order(ids) | common.in_order(tags)) - 1
    shift = doc * 2**40  # documents are laid far apart, so one pass merges all of them
    start, end = common.merged(start + shift, end + shift)
    first = np.flatnonzero(common.in_order(doc))
    doc, ids, tags = start >> 40, ids[first], tags[first]
    start, end = start & (2**40 - 1), end & (2**40 - 1)
    bucket = bucket_of(common.mixed(ids.view(np.uint64)), n)[doc]
    order = np.argsort(bucket, kind="stable")
    out = []
    cuts = np.flatnonzero(common.in_order(bucket[order]))
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        i = order[a:b]
        new = np.flatnonzero(common.in_order(doc[i]))
        rows = doc[i][new]
        out.append((int(bucket[i[0]]), common.pack(np.diff(ids[rows], prepend=0), tags[rows], np.diff(np.r_[new, len(i)]).astype(np.uint32), np.diff(start[i], prepend=0).astype(np.int64), (end - start)[i].astype(np.int32))))
    return out


def merge_marks(group: pa.Table) -> pa.Table:
    """All marks of a bucket of documents, one row for each document."""
    parts = []
    for payload in group["marks"].to_pylist():
        ids, tags, counts, start, length = common.unpack(payload)
        start = np.cumsum(start)
        parts.append((np.repeat(np.cumsum(ids), counts), np.repeat(tags, counts), start, start + length))
    ids, tags, start, end = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((start, tags, ids))
    ids, tags, start, end = ids[order], tags[order], start[order], end[order]
    first = np.flatnonzero(common.in_order(ids) | common.in_order(tags))
    shift = (np.cumsum(common.in_order(ids) | common.in_order(tags)) - 1) * 2**40
    start, end = common.merged(start + shift, end + shift)
    counts = np.bincount(start >> 40, minlength=len(first))
    spans = np.column_stack([start & (2**40 - 1), end & (2**40 - 1)]).astype(np.int32)
    offsets = pa.array(np.r_[0, 2 * np.cumsum(counts)].astype(np.int32))
    covered = np.add.reduceat(end - start, np.r_[0, np.cumsum(counts)[:-1]])
    return pa.table([pa.array(ids[first]), pa.array(tags[first]), pa.ListArray.from_arrays(offsets, pa.array(spans.ravel())), pa.array(covered)], schema=MARKS)


SENT = pa.schema([("bucket", pa.int32()), ("payload", pa.binary()), ("doc_bucket", pa.int32()), ("marks", pa.binary())])
PACKED = pa.schema([("doc_bucket", pa.int32()), ("marks", pa.binary())])
MARKS = pa.schema([("id", pa.int64()), ("tag", pa.int64()), ("spans", pa.list_(pa.int32())), ("covered", pa.int64())])
SENT_DDL, PACKED_DDL = "bucket int, payload binary, doc_bucket int, marks binary", "doc_bucket int, marks binary"
MARKS_DDL = "id long, tag long, spans array<int>, covered long"


def sent(blocks: list[tuple[int, bytes]], marks: list[tuple[int, bytes]]) -> pa.RecordBatch:
    """Blocks for buckets, and marks that need no more work, which travel with them."""
    b, m = [None] * len(blocks), [None] * len(marks)
    columns = [[x[0] for x in blocks + marks], [x[1] for x in blocks] + m, b + [x[0] for x in marks], b + [x[1] for x in marks]]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, SENT)], schema=SENT)


def split(group: pa.Table) -> tuple[list[bytes], pa.Table]:
    """The blocks of a bucket, and the marks that came with them."""
    block = pa.compute.is_valid(group["payload"])
    return group.filter(block)["payload"].to_pylist(), group.filter(pa.compute.invert(block)).select(PACKED.names).cast(PACKED)


def packed(marks: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table([pa.array([x[k] for x in marks], f.type) for k, f in enumerate(PACKED)], schema=PACKED)


def by_document(marks: DataFrame) -> DataFrame:
    return marks.groupBy("doc_bucket").applyInArrow(common.released(merge_marks), MARKS_DDL)


def mapper(window: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, first, second = common.WordHash(), common.Rolling(HASH_BASE), common.Rolling(BUCKET_BASE)
        for t in common.flushes(batches, FLUSH):
            t = t.sort_by("id")
            ids, tags = t["id"].to_numpy(), t["tag"].to_numpy()
            values = [hashed.array(common.words(x)) for x in common.binary(t["text"])]
            lengths = np.array([len(v) for v in values], np.int64)
            v, ends = np.concatenate(values), np.cumsum(lengths)
            if len(v) < window:
                continue
            row = np.repeat(np.arange(len(ids)), lengths)[: len(v) - window + 1]
            i = np.flatnonzero(np.arange(len(row)) + window <= ends[row])
            row, h = row[i], first.windows(first.prefix(v), window)[i]
            order = np.argsort(h, kind="stable")
            new = common.in_order(h[order])
            least = ids[row[order[np.flatnonzero(new)]]][np.cumsum(new) - 1]
            own = np.empty(len(h), bool)
            own[order] = ids[row[order]] == least
            pos = (i - (ends - lengths)[row]).astype(np.int32)
            late = ~own
            marks = mark_blocks(ids[row[late]], tags[row[late]], pos[late], pos[late] + window, n)
            b = bucket_of(second.windows(second.prefix(v), window)[i[own]], n)
            yield sent(list(packed_by_bucket(b, h[own], row[own], pos[own], ids, tags)), marks)

    return run


def repeats(h: np.ndarray) -> np.ndarray:
    """The places of hashes that occur more than once, by hash."""
    order = np.argsort(h, kind="stable")
    new = common.in_order(h[order])
    return order[~(new & np.r_[new[1:], True])]


def reducer(window: int, n: int):
    def run(group: pa.Table) -> pa.Table:
        blocks, done = split(group)
        if not blocks:
            return done
        ids, tags, h, row, pos = gathered(blocks)
        some = repeats(h)
        h, row, pos = h[some], row[some], pos[some]
        order = np.lexsort((ids[row], h))
        new = common.in_order(h[order])
        if len(order):
            order = order[ids[row[order]] > ids[row[order[np.flatnonzero(new)]]][np.cumsum(new) - 1]]
        row, pos = row[order], pos[order]
        return pa.concat_tables([done, packed(mark_blocks(ids[row], tags[row], pos, pos + window, n))])

    return run


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """id and tag, by which marks find their row, before the other columns."""
    return docs.select(common.id_key().alias("id"), F.xxhash64("text").alias("tag"), *more)


def attach(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc, removed): a row of ``docs`` and all its marks, array<int> of starts and ends, merged and in order; null if none."""
    by_doc = by_document(marks).select(F.col("id").alias("_id"), F.col("tag").alias("_tag"), F.col("spans").alias("removed"))
    keys = keyed(docs, F.struct(*docs.columns).alias("doc"))
    return keys.join(by_doc, (keys.id == F.col("_id")) & (keys.tag == F.col("_tag")), "left").select("doc", "removed")


def repeated_word_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, removed): rows of ``docs`` (doc_id, text and any more columns) with the word intervals to remove.

    A word goes if a window of ``window`` words that covers it also starts in a document with a smaller doc_id.
    Null, empty and shorter texts lose nothing; a null doc_id counts as the largest. An empty table gives an empty one.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = buckets_for(size // 6)
    hashed = keyed(docs, "text").mapInArrow(common.released(mapper(window, n)), SENT_DDL)
    return attach(docs, common.in_buckets(hashed, n).applyInArrow(common.released(reducer(window, n)), PACKED_DDL))


def intervals(removed: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.asarray(removed if removed is not None else [], np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def rows_of(column: pa.Array) -> Iterator[np.ndarray | None]:
    """The rows of an array<int> column as numpy arrays."""
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for k, ok in enumerate(column.is_valid().to_pylist()):
        yield values[offsets[k] : offsets[k + 1]] if ok else None


def digest(found: DataFrame) -> DataFrame:
    """Per document: words, removed words and the SHA-256 of the kept words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, sha = [], [], []
            for text, removed in zip(common.binary(b["text"]), rows_of(b["removed"])):
                words, gone = common.words(text), 0
                n_words.append(len(words))
                for start, end in reversed(list(zip(*intervals(removed)))):
                    del words[start:end]
                    gone += int(end - start)
                n_removed.append(gone)
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.record_batch([b["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return found.select("doc.doc_id", "doc.text", "removed").mapInArrow(common.released(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut(found: DataFrame) -> DataFrame:
    """The documents with their removed words cut out of the text; kept stretches stay as they are, joined by a space.

    A document that loses all its words goes; one that loses none stays as it is.
    """
    import re

    word = re.compile(rb"[^ \t-\r]+")
    schema = found.schema["doc"].dataType
    columns, spans = schema.fieldNames(), "removed"
    while spans in columns:
        spans = f"_{spans}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keep = [], []
            for text, removed in zip(common.binary(b["text"]), rows_of(b[spans])):
                if removed is not None and len(removed):
                    spots, at, parts = [m.span() for m in word.finditer(text)], 0, []
                    for start, end in [*zip(*intervals(removed)), (len(spots), len(spots))]:
                        if start > at:
                            parts.append(text[spots[at][0] if at else 0 : spots[start - 1][1] if start < len(spots) else len(text)])
                        at = end
                    text = b" ".join(parts)
                    keep.append(bool(parts))
                else:
                    keep.append(True)
                texts.append(text)
            new = {c: b[c] for c in columns} | {"text": pa.array(texts, pa.binary()).cast(b["text"].type)}
            yield pa.RecordBatch.from_pydict(new).filter(pa.array(keep, pa.bool_()))

    return found.select("doc.*", F.col("removed").alias(spans)).mapInArrow(common.released(run), schema)
