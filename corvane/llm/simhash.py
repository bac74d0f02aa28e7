"""SimHash near-duplicates, found by deletion-variant signatures.

A fingerprint is cut into so few segments that two near ones must agree in one segment up to one bit. Each segment is
indexed once for each of its bits, with that bit left out; fingerprints that agree in a signature meet in its bucket and
are verified there. Equal fingerprints are one node from the start, so exact copies never meet each other.

Two members that agree in the whole segment would meet in each of its signatures; they are compared in the first only,
in the others only members that differ in the bit left out. Buckets are counted before anything is sent to them: one of
over HOT members is cut into parts by fingerprint, and every two parts get a bucket of their own, so no task holds more.
In a bucket, groups over MOST members are cut into blocks, and every two blocks are compared in a task of their own. In
groups over ALL members, links are found by searching from member to member, with never all pairs at once. Of its links
a bucket sends a spanning forest, those of the fewest differing bits first.

Where fingerprints only estimate what is asked, links that are not certain and join what certain ones don't are verified
by the texts' shingles; a bucket sends MORE forests of these, so that one that falls isn't the only one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm import common, similar
from corvane.llm.graph import components
from corvane.llm.substring import bucket_of, buckets_for

SEED, MOST, FEW, BUCKET, HOT, MOST_SENT, MORE, ALL = 42, 20_000, 64, 2_000_000, 8_000_000, 500_000, 3, 1024
LANES = np.uint64(0x0101010101010101)
SHIFTS = np.arange(8, dtype=np.uint64)


@dataclass(frozen=True)
class Scheme:
    """How texts become fingerprints and which of them link.

    width: words in a shingle. words: 64-bit words of a fingerprint. segments of bits: what is indexed, the same at any
    number of fingerprints, so a pair is found or not whatever else the table holds. near: differing bits allowed in the
    first word; levels: in the whole fingerprint, the last for a link, those before for what joins large groups sooner.
    certain: links of more differing bits are verified by the texts' shingles, which must be similar to ``least``.
    """

    width: int
    words: int
    segments: int
    bits: int
    near: int
    levels: tuple[int, ...]
    certain: int | None = None
    least: float = 0.0


#: 64 bits in two segments of 32: of at most 3 differing bits, one segment has at most one.
EXACT = Scheme(width=3, words=1, segments=2, bits=32, near=3, levels=(3,))
#: For a similarity of 0.8 or more on five-word shingles: bits of such texts differ with a probability of at most 0.151,
#: so 116 of 768 are expected at 0.8, with a deviation of 10; unrelated texts differ in about 384. Such a pair differs in
#: at most 140 bits with a probability of 0.99, and agrees in one of 12 segments of 16 bits up to one bit with 0.98. Up to
#: 80 bits are four deviations from what a similarity under 0.8 gives; links of more bits are verified.
SIMILAR = Scheme(width=5, words=12, segments=12, bits=16, near=18, levels=(48, 80, 110, 140), certain=80, least=0.8)


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` lower-cased words, space-joined; of the whole sequence if there are fewer."""
    found = common.words(text, lower=True)
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = list(accumulate(map(len, found), lambda at, n: at + 1 + n))
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :])), np.uint64, len(found) - width + 1)


def fingerprint(h: np.ndarray, words: int) -> bytes:
    """The bits set in over half of the hashes, most significant first; zero for none."""
    out = []
    for k in range(words):
        x = h if k == 0 else common.mixed(h * np.uint64(2 * k + 1) + np.uint64(k))
        counts = np.zeros((8, 8), np.int64)
        for at in range(0, len(x), 65_280):
            lanes = (x[at : at + 65_280, None] >> SHIFTS) & LANES
            sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
            counts += sums.view(np.uint8).reshape(-1, 8, 8).sum(0, dtype=np.int64)
        bits = (2 * counts.T.ravel() > len(x)).astype(np.uint8)  # byte by byte, least significant first
        out.append(np.packbits(bits[::-1]).tobytes())
    return b"".join(out)


def fingerprints(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """(doc_id, text_hash, fp binary, node) for each row; a null or empty text has fingerprint zero. node stands for fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(shingle_hashes(x, scheme.width), scheme.words) for x in common.binary(b["text"])]
            node = node_of(as_words(fp, scheme.words)).view(np.int64)
            yield pa.record_batch([b["doc_id"], b["text_hash"], pa.array(fp, pa.binary()), pa.array(node)], ["doc_id", "text_hash", "fp", "node"])

    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), "text")
    return keys.mapInArrow(common.released(run), "doc_id long, text_hash long, fp binary, node long")


def text_hash() -> Column:
    return F.xxhash64("text")


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


#: More differing bits than any two fingerprints have.
APART = 2**30


def differing(sketch: np.ndarray, at: np.ndarray, to: np.ndarray | int, scheme: Scheme) -> np.ndarray:
    """How many bits the fingerprints ``at`` and ``to`` differ in; APART where the first word alone tells that they don't link."""
    out = popcount(sketch[at, 0] ^ sketch[to, 0]).astype(np.int64)
    out[out > scheme.near] = APART
    if scheme.words > 1:
        k = np.flatnonzero(out < APART)
        other = to if np.ndim(to) == 0 else to[k]
        out[k] = popcount(sketch[at[k]] ^ sketch[other]).sum(1)
    return out


Found = list[tuple[int, int, int]]


def forest(sketch: np.ndarray, scheme: Scheme, most: int) -> Found:
    """Pairs of positions, with their differing bits, that join all members which links of at most ``most`` bits join."""
    left, out = np.arange(1, len(sketch)), []
    stack = [0]
    while len(left):
        at = stack.pop() if stack else int(left[0])
        bits = differing(sketch, left, at, scheme)
        hit = bits <= most
        for k, n in zip(left[hit].tolist(), bits[hit].tolist()):
            if k != at:
                out.append((at, k, n))
                stack.append(k)
        left = left[~hit & (left != at)]
    return out


def two_sided(sketch: np.ndarray, side: np.ndarray, scheme: Scheme, most: int) -> Found:
    """The same where only members of different sides link."""
    left = [np.flatnonzero(~side), np.flatnonzero(side)]
    out: Found = []
    stack: list[int] = []
    while len(left[0]) and len(left[1]) or stack:
        if stack:
            at = stack.pop()
        else:
            at, left[0] = int(left[0][0]), left[0][1:]
        other = int(not side[at])
        bits = differing(sketch, left[other], at, scheme)
        hit = bits <= most
        for k, n in zip(left[other][hit].tolist(), bits[hit].tolist()):
            out.append((at, k, n))
            stack.append(k)
        left[other] = left[other][~hit]
    return out


def joined(sketch: np.ndarray, side: np.ndarray | None, scheme: Scheme) -> Found:
    """Links of a group with many: of up to ALL members every one is looked at and they are thinned out; else forests of every level."""
    n = len(sketch)
    out: Found = []
    if n > ALL:
        for most in scheme.levels:
            found = forest(sketch, scheme, most) if side is None else two_sided(sketch, side, scheme, most)
            out += found
            if len(found) == n - 1:
                break
        return out
    links = []
    for i in range(n - 1):
        other = np.arange(i + 1, n) if side is None else i + 1 + np.flatnonzero(side[i + 1 :] != side[i])
        bits = differing(sketch, other, i, scheme)
        hit = bits <= scheme.levels[-1]
        links.append((np.full(hit.sum(), i), other[hit], bits[hit]))
    a, b, bits = (np.concatenate(x) for x in zip(*links))
    order = np.argsort(bits, kind="stable")
    kept = order[thinned(a[order], b[order], bits[order], n, scheme)]
    return list(zip(a[kept].tolist(), b[kept].tolist(), bits[kept].tolist()))


def few_pairs(begin: np.ndarray, size: np.ndarray, kind: np.ndarray, who: np.ndarray, sketch: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All links inside many small groups at once, as positions, and their differing bits."""
    at = np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    left = np.repeat(begin + size, size) - at
    found = [(at[:0], at[:0], at[:0])]
    for k in range(1, int(size.max(initial=1))):
        at, left = at[left > k], left[left > k]
        for x in range(0, len(at), 1_000_000):
            i = at[x : x + 1_000_000]
            i = i[(kind[i] >= 2) | (kind[i] != kind[i + k])]
            bits = differing(sketch, who[i], who[i + k], scheme)
            hit = bits <= scheme.levels[-1]
            found.append((i[hit], i[hit] + k, bits[hit]))
    return tuple(np.concatenate(x) for x in zip(*found))


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the links between n members to keep so that they join the same members without any loop, and a number for each part.

    Every component takes the first link that leaves it, all at once, until none leaves one.
    """
    label, kept = np.arange(n), np.zeros(len(a), bool)
    left = np.arange(len(a))
    while True:
        left = left[label[a[left]] != label[b[left]]]
        if not len(left):
            return kept, label
        x, y, at = label[a[left]], label[b[left]], np.arange(len(left))
        first = np.full(n, len(left))
        np.minimum.at(first, x, at)
        np.minimum.at(first, y, at)
        some = np.flatnonzero(first < len(left))
        link = first[some]
        kept[left[link]] = True
        to = np.arange(n)
        to[some] = np.where(x[link] == some, y[link], x[link])
        mutual = (to[to] == np.arange(n)) & (np.arange(n) < to)
        to[mutual] = np.flatnonzero(mutual)
        while (to[to] != to).any():
            to = to[to]
        label = to[label]


def thinned(a: np.ndarray, b: np.ndarray, bits: np.ndarray, n: int, scheme: Scheme) -> np.ndarray:
    """Which links to keep, those of the fewest bits first: a forest of all, and MORE forests of those that may not stand."""
    kept = spanning(a, b, n)[0]
    if scheme.certain is not None:
        sure = bits <= scheme.certain
        part = spanning(a[sure], b[sure], n)[1]
        open_ = ~sure & (part[a] != part[b])
        for _ in range(MORE):
            left = np.flatnonzero(open_ & ~kept)
            kept[left[spanning(part[a[left]], part[b[left]], n)[0]]] = True
    return np.flatnonzero(kept)


BLOCKS = pa.schema([("bucket", pa.int64()), ("payload", pa.binary())])
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("bits", pa.int32()), ("bucket", pa.int64()), ("payload", pa.binary())])
LINKS_DDL = "a long, b long, bits int, bucket long, payload binary"


def node_of(fp: np.ndarray) -> np.ndarray:
    """A number for each fingerprint (a row of words): a single word itself, else a hash of all words."""
    out = fp[:, 0]
    for k in range(1, fp.shape[1]):
        out = common.mixed(out * common.MIX_2 + fp[:, k])
    return out


def as_words(fp: list[bytes], words: int) -> np.ndarray:
    return np.frombuffer(b"".join(fp), ">u8").reshape(len(fp), words).astype(np.uint64)


def members(key: np.ndarray, kind: np.ndarray, who: np.ndarray, fp: np.ndarray) -> bytes:
    """Signatures with their fingerprints, each fingerprint once; ``who`` is sorted."""
    new = np.flatnonzero(common.in_order(who))
    return common.pack(key.astype(np.uint32), kind.astype(np.uint8), np.diff(np.r_[new, len(who)]).astype(np.uint32), fp[who[new]].ravel())


def parts_of(bucket: int, parts: int) -> Iterator[tuple[int, int, int]]:
    """The numbers of a bucket that is cut into parts: one for every two of them, and the parts."""
    for i in range(parts):
        for j in range(i + 1 if parts > 1 else i, parts):
            yield bucket << 32 | i << 16 | j, i, j


def signatures(scheme: Scheme, n: int, hot: dict[int, int] | None):
    """Sends (signature, side of the left-out bit, fingerprint) of every fingerprint to the signature's bucket.

    ``hot`` has the number of parts of buckets that are cut. Without it, only the members of each bucket are counted.

    Signatures that leave out a bit of one half of a segment go by the other half, so that a fingerprint travels to at
    most two buckets a segment, once to each. 32 bits of a signature are enough there: where different ones meet, the
    comparison tells them apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, half = scheme.bits, scheme.bits // 2
        for whole in batches:
            for at in range(0, len(whole), 4000):
                b = whole.slice(at, 4000)
                fp = as_words(b["fp"].to_pylist(), scheme.words)
                parts = np.stack([(fp[:, s // 2] >> np.uint64(32 * (s % 2))) & np.uint64(2**bits - 1) for s in range(scheme.segments)], axis=1)
                out = np.uint64(1) << np.arange(bits, dtype=np.uint64)
                value = parts[:, :, None] & ~out
                segment = np.arange(scheme.segments, dtype=np.uint64)[:, None] * np.uint64(64)
                key = common.mixed(value ^ ((segment + np.arange(bits, dtype=np.uint64)) << np.uint64(40))).ravel()
                low = np.arange(bits) < half
                whole_half = np.where(low, parts[:, :, None] >> np.uint64(half), parts[:, :, None] & np.uint64(2**half - 1))
                bucket = bucket_of(common.mixed(common.mixed(whole_half ^ ((segment + low.astype(np.uint64)) << np.uint64(40)))), n).ravel()
                if hot is None:
                    some, size = np.unique(bucket, return_counts=True)
                    yield pa.record_batch([pa.array(some.astype(np.int64)), pa.array(size)], ["bucket", "size"])
                    continue
                spread = common.mixed(node_of(fp) ^ common.MIX_1) >> np.uint64(32)
                side = ((parts[:, :, None] & out) != 0).ravel()
                first = np.broadcast_to(np.arange(bits) == 0, value.shape).ravel()
                who = np.repeat(np.arange(len(b)), scheme.segments * bits)
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(common.in_order(bucket[order]))
                rows = []
                for x, y in zip(cuts, [*cuts[1:], len(order)]):
                    to = int(bucket[order[x]])
                    many = hot.get(to, 1)
                    part = (spread * np.uint64(many) >> np.uint64(32)).astype(np.int64)[who[order[x:y]]]
                    for name, left, right in parts_of(to, many):
                        i = order[x:y][(part == left) | (part == right)]
                        if len(i):
                            rows.append((name, members(key[i], side[i] + 2 * first[i].astype(np.uint8), who[i], fp)))
                yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], schema=BLOCKS)

    return run


def _blocks(group: np.ndarray, name: str, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """Every two blocks of a large group, under a number of their own."""
    parts = np.array_split(group, -(-2 * len(group) // most))
    for i, x in enumerate(parts):
        for y in parts[i + 1 :]:
            yield xxhash.xxh64_intdigest(f"{name} {x[0]} {y[0]}") >> 1, np.concatenate([x, y])


def compare(scheme: Scheme, most: int | None):
    """Links within each signature of a bucket; groups over ``most`` members, if given, are sent on in blocks."""

    def run(group: pa.Table) -> pa.Table:
        parts = [common.unpack(p) for p in group["payload"].to_pylist()]
        key, kind, counts, fp = (np.concatenate(x) for x in zip(*parts))
        fp = fp.reshape(-1, scheme.words)
        node, who = node_of(fp), np.repeat(np.arange(len(fp)), counts)
        # a bit that comes first or not is part of the signature, for where different ones share 32 bits
        key = key.astype(np.uint64) * np.uint64(2) + (kind >> 1)
        order = np.lexsort((node[who], key))
        key, kind, who = key[order], kind[order], who[order]
        begin = np.flatnonzero(common.in_order(key))
        size = np.diff(np.r_[begin, len(key)])
        few = (size > 1) & (size <= FEW) & (most is None or size <= most)
        a, b, bits = few_pairs(begin[few], size[few], kind, who, fp, scheme)
        # where links abound, as among near copies, a spanning forest takes their place
        of = np.searchsorted(begin, a, "right") - 1
        many = np.bincount(of, minlength=len(begin)) >= size
        a, b, bits = ([x[~many[of]]] for x in (who[a], who[b], bits))
        sent = []
        rest = (size > 1) & (~few | many)
        for x, n in zip(begin[rest].tolist(), size[rest].tolist()):
            if most is not None and n > most:
                sent += [(to, members(np.full(len(i), key[x] >> np.uint64(1), np.uint32), kind[i], np.arange(len(i)), fp[who[i]])) for to, i in _blocks(np.arange(x, x + n), f"{group['bucket'][0].as_py()} {key[x]}", most)]
                continue
            pairs = joined(fp[who[x : x + n]], None if kind[x] >= 2 else (kind[x : x + n] & 1).astype(bool), scheme)
            if pairs:
                i = np.array(pairs)
                a.append(who[i[:, 0] + x])
                b.append(who[i[:, 1] + x])
                bits.append(i[:, 2])
        # a fingerprint is in many groups of a bucket: its links over all of them are thinned out, those of the fewest bits
        # first, so what links of up to any number of bits join stays joined by such links, and nearest ones always stay
        a, b, bits, place = np.concatenate(a), np.concatenate(b), np.concatenate(bits), np.unique(node, return_inverse=True)[1]
        order = np.argsort(bits, kind="stable")
        a, b, bits = a[order], b[order], bits[order]
        kept = thinned(place[a], place[b], bits, len(node), scheme)
        none = [None] * len(kept)
        links = pa.table([pa.array(node[a[kept]].view(np.int64)), pa.array(node[b[kept]].view(np.int64)), pa.array(bits[kept], pa.int32()), pa.array(none, pa.int64()), pa.array(none, pa.binary())], schema=LINKS)
        none = [None] * len(sent)
        return pa.concat_tables([links, pa.table([*(pa.array(none, f.type) for f in list(LINKS)[:3]), pa.array([x[0] for x in sent], pa.int64()), pa.array([x[1] for x in sent], pa.binary())], schema=LINKS)])

    return run


def links_between(nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """(a, b, bits): links that join the same nodes as all links of the scheme do. ``nodes``: (node long, fp binary), no repeats."""
    n = buckets_for(nodes.count() * scheme.segments * scheme.bits)
    sizes = nodes.select("fp").mapInArrow(common.released(signatures(scheme, n, None)), "bucket long, size long").groupBy("bucket").agg(F.sum("size").alias("size"))
    hot = {r["bucket"]: -(-2 * r["size"] // HOT) for r in sizes.filter(F.col("size") > HOT).collect()}  # few: each has over HOT of all members
    sent = nodes.select("fp").mapInArrow(common.released(signatures(scheme, n, hot)), "bucket long, payload binary")
    found = common.stored(sent.repartition(min(n, common.MOST_PARTITIONS), "bucket").groupBy("bucket").applyInArrow(common.released(compare(scheme, MOST)), LINKS_DDL))
    blocks = found.filter("payload is not null").select("bucket", "payload").groupBy("bucket").applyInArrow(common.released(compare(scheme, None)), LINKS_DDL)
    return found.unionByName(blocks).filter("a is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "bits").distinct()


def verified(docs: DataFrame, nodes: DataFrame, links: DataFrame, scheme: Scheme) -> DataFrame:
    """The (a, b) of ``links`` whose texts are similar enough by their sets of shingles.

    A node stands for texts of one fingerprint; that with the least hash is taken. Only texts of linked nodes are read
    on: their hashes go to all tasks where there are at most MOST_SENT, and meet the texts by hash beyond.
    """
    wanted = common.stored(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "text_hash"), "node"))
    hashes = wanted.select("text_hash").distinct()
    hashes = F.broadcast(hashes) if wanted.count() <= MOST_SENT else hashes
    texts = docs.select(text_hash().alias("text_hash"), "text").join(hashes, "text_hash", "left_semi").dropDuplicates(["text_hash"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(shingle_hashes(x, scheme.width)).view(np.int64) for x in common.binary(b["text"])]
            yield pa.record_batch([b["text_hash"], pa.array(found, pa.list_(pa.int64()))], ["text_hash", "shingles"])

    found = common.stored(wanted.join(texts.mapInArrow(common.released(sets), "text_hash long, shingles array<long>"), "text_hash").select("node", "shingles"))
    left, right = (found.select(F.col("node").alias(x), F.col("shingles").alias(f"of_{x}")) for x in "ab")
    both = F.size(F.array_intersect("of_a", "of_b"))
    alike = both >= scheme.least * (F.size("of_a") + F.size("of_b") - both)
    return links.select("a", "b").join(left, "a").join(right, "b").filter(alike).select("a", "b")


def groups(docs: DataFrame, scheme: Scheme = EXACT) -> DataFrame:
    """(doc_id, text_hash, fp, component_id, group) for each row of ``docs``: rows that links join share a group.

    Where the scheme asks for it, links are verified by the texts' shingles, those aside that join what certain links join.
    component_id is the smallest doc_id of the group. Null and empty texts have fingerprint zero and link like any other.
    Rows with equal texts are always linked. Null ids count as none: a group has the smallest of its other ids, or null.
    An empty table gives an empty one.
    """
    rows = common.stored(fingerprints(docs, scheme))
    nodes = common.stored(rows.groupBy("node").agg(F.min("fp").alias("fp"), F.min("doc_id").alias("least"), F.min("text_hash").alias("text_hash")))
    links = links_between(nodes, scheme)
    if scheme.certain is not None:
        links = common.stored(links)
        sure = links.filter(F.col("bits") <= scheme.certain).select("a", "b")
        parts = components(sure)
        left, right = (parts.select(F.col("node").alias(x), F.col("label").alias(f"of_{x}")) for x in "ab")
        rest = links.filter(F.col("bits") > scheme.certain).join(left, "a", "left").join(right, "b", "left")
        rest = common.stored(rest.filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b"))
        links = sure.unionByName(verified(docs, nodes, rest, scheme))
    labels = components(links)
    known = labels.join(nodes.select("node", "least"), "node")
    least = known.groupBy("label").agg(F.min("least").alias("component_id"))
    known = known.select("node", "label").join(least, "label")
    by_node = nodes.select("node", "least").join(known, "node", "left").select("node", F.coalesce("label", "node").alias("group"), F.when(F.col("label").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    return rows.join(by_node, "node").select("doc_id", "text_hash", "fp", "component_id", "group")


def one_of_each(docs: DataFrame, least: float = similar.LEAST) -> DataFrame:
    """The rows of ``docs`` less all but one of each group: that with the smallest doc_id (null last), then text hash.

    Groups are joined by similarities of ``least`` or more of the sets of five-word shingles, found exactly (``similar``).
    Of repeated rows one stays. Rows keep all their columns.
    """
    # no key is null, so that rows stay where the join has put them
    keys = ["_id", "_none", "_hash"]

    def firsts() -> DataFrame:
        first = similar.groups(docs, least).groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first"))
        return first.select(F.coalesce("first.doc_id", F.lit(common.NO_ID)).alias("_id"), F.col("first.none").alias("_none"), F.col("first.text_hash").alias("_hash")).distinct()

    first = common.alone(firsts)
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), common.id_key().alias("_id"), F.col("doc_id").isNull().alias("_none"), text_hash().alias("_hash"))
    return keyed.join(first, keys).dropDuplicates(keys).select("doc.*")
