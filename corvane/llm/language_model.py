"""Scores of texts by a log-bilinear language model that is trained with noise-contrastive estimation in numpy.

Words are hashed by arrays, block by block. Their counts over all training documents are added up in Spark. HEAVY words
at most have over a HEAVY-th of all tokens; their counts go to every task. All others occur so rarely that no single one
is a hot key: documents send their hashes, packed, to buckets, which count them over all training documents, and only
sums by document come back.

Model. Every word, known or not, belongs to one of CLASSES classes by its last two bytes, the end token to one of its
own. A token's probability given the two before it is that of its class times that of the word within its class. Both
are softmaxes of scores q . r + b, q the sum of two context vectors. A class's members are those of the VOCABULARY most
frequent words that it has, and one for its rare words; a rare word further takes its share of these by its corpus
count, smoothed as in the base score, so known words together with one unseen word have probability one.

Training. Documents are dealt to shards of about SHARD tokens by their hashes. Starting from the unigram distribution,
a model is trained on the first shard; from there one is trained on each shard, in the order of hashes, and all are
averaged by tokens. Averages are sums of integers, and shards depend on the documents alone, so the model is the same
however the table is partitioned. A task holds one shard's tokens in blocks; the driver holds one model.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm import common
from corvane.llm.substring import bucket_of, buckets_for, packed_by_bucket, unpacked

HEAVY, VOCABULARY, LEAST, CLASSES, DIMENSION, SEED = 400_000, 8192, 8, 128, 24, 7
#: Tokens in a shard, in a block that a task trains on at once, in a batch of classes and of words; noise of both.
SHARD, BLOCK, BATCH, WORD_BATCH, NOISE, WORD_NOISE = 1_000_000, 250_000, 2048, 1024, 24, 16
RATE, WORD_RATE, WARM_ROUNDS = 0.08, 0.015, 2
#: Bytes of text that a task takes at once, and tokens whose scores it holds.
FLUSH, SCORED_AT_ONCE = 1_000_000, 4096
#: Models that one task adds up, about.
ADDED_AT_ONCE = 16
HASH_BASE, END = 0xD6E8FEB86659FD93, 0
LOWER = np.frombuffer(common.LOWER, np.uint8)
WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: The class of a word by its last two bytes.
SHAPES = (1 + common.mixed(np.arange(65_536, dtype=np.uint64) * common.MIX_1 + np.uint64(99)) % np.uint64(CLASSES)).astype(np.int32)


def held_out() -> Column:
    """The remainder of the CRC-32 of the id as text by 5 is 1; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1


def in_training(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 != 1


class Tokens:
    """All tokens of a block of texts, with an end after each: hashes, classes, and where each text begins and ends."""

    rolling = common.Rolling(HASH_BASE)

    def __init__(self, texts: pa.Array) -> None:
        data, offsets = common.text_buffer(texts)
        data = LOWER[data]
        inside = ~WHITE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before, after = np.r_[False, inside[:-1]][: len(data)], np.r_[inside[1:], False][: len(data)]
        start = np.flatnonzero(inside & (~before | edge[:-1]))
        end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        words = np.searchsorted(start, offsets)
        h = self.rolling.spans(self.rolling.prefix(common.BYTE_VALUES[data]), start, end)
        last = data[end - 1].astype(np.int64)
        other = np.where(end - start > 1, data[np.maximum(end - 2, 0)], 0).astype(np.int64)
        self.cuts = words + np.arange(len(offsets))
        self.hash, self.kind = np.zeros(self.cuts[-1], np.uint64), np.zeros(self.cuts[-1], np.int32)
        at = np.arange(len(h)) + np.repeat(np.arange(len(offsets) - 1), np.diff(words))
        self.hash[at], self.kind[at] = np.maximum(h, np.uint64(1)), SHAPES[other * 256 + last]

    def texts(self) -> np.ndarray:
        """The number of each token's text."""
        return np.repeat(np.arange(len(self.cuts) - 1), np.diff(self.cuts))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut to about FLUSH bytes of text each; rows stay whole."""
    for b in batches:
        places = common.text_buffer(b["text"])[1]
        for a, z in common.batches_of(places, FLUSH):
            yield b.slice(a, z - a)


def counts(docs: DataFrame) -> DataFrame:
    """(word, kind, c) of all training tokens: hash, class and count; the end token is END."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def added() -> pa.RecordBatch:
            h, kind, c = (np.concatenate(x) for x in zip(*held))
            _, first, of = np.unique(h, return_index=True, return_inverse=True)
            total = np.bincount(of, c).astype(np.int64)
            return pa.record_batch([pa.array(h[first].view(np.int64)), pa.array(kind[first]), pa.array(total)], ["word", "kind", "c"])

        for b in blocks(batches):
            t = Tokens(b["text"])
            h, first, c = np.unique(t.hash, return_index=True, return_counts=True)
            held.append((h, t.kind[first], c))
            size += len(h)
            if size > 500_000:
                yield added()
                held, size = [], 0
        if held:
            yield added()

    return docs.filter(~held_out()).select("text").mapInArrow(common.released(run), "word long, kind int, c long").groupBy("word").agg(F.min("kind").alias("kind"), F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Members by number, class after class; the first of each class is its rare words, the end is number 0.

    words and counts: hashes of the words that are members of their own, and how often each occurs in training. rare: how
    often the others of each class do, and distinct how many there are.
    """

    words: np.ndarray
    kinds: np.ndarray
    counts: np.ndarray
    ends: int
    rare: np.ndarray
    distinct: np.ndarray

    def __post_init__(self) -> None:
        order = np.lexsort((self.words, -self.counts, self.kinds))
        self.words, self.kinds, self.counts = self.words[order], self.kinds[order], self.counts[order]
        self.size = np.r_[1, 1 + np.bincount(self.kinds, minlength=CLASSES + 1)[1:]]
        self.first = np.cumsum(self.size) - self.size
        number = np.arange(len(self.words)) + self.kinds + 1
        self.kind_of = np.repeat(np.arange(CLASSES + 1), self.size)
        self.weight = np.zeros(len(self.kind_of))
        self.weight[self.first] = self.rare + 0.5
        self.weight[0] = self.ends + 0.5
        self.weight[number] = self.counts
        self.known = common.HashTable((4 * len(self.words) + 8).bit_length())
        self.known.put(self.words, number.astype(np.int32))

    def numbers(self, t: Tokens) -> np.ndarray:
        found = self.known.find(t.hash, -1)
        return np.where(found < 0, self.first[t.kind], found).astype(np.int32)


def added(into: np.ndarray, past: np.ndarray, who: np.ndarray, gradient: np.ndarray, rate: float) -> None:
    """A step of each row of ``into`` along its summed gradient, shorter the more that row has moved before."""
    order = np.argsort(who.astype(np.uint16), kind="stable")  # a radix sort; numbers of members are that small
    cut = np.flatnonzero(common.in_order(who[order]))
    rows, sums = who[order[cut]], np.add.reduceat(gradient[order], cut, axis=0)
    past[rows] += (sums * sums).mean(-1) if sums.ndim > 1 else sums * sums
    step = rate / np.sqrt(past[rows] + 1e-3)
    into[rows] += step[:, None] * sums if sums.ndim > 1 else step * sums


def contrast(q: np.ndarray, r: np.ndarray, b: np.ndarray, log_noise: np.ndarray, hit: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, ...]:
    """Gradients of noise-contrastive estimation: of the contexts, of the hits and the noise, and of their biases.

    ``log_noise``: log of the expected number of noise draws of each target.
    """
    good = 1 / (1 + np.exp(np.clip(np.einsum("nd,nd->n", q, r[hit]) + b[hit] - log_noise[hit], -30, 30)))
    bad = 1 / (1 + np.exp(-np.clip(q @ r[noise].T + b[noise] - log_noise[noise], -30, 30)))
    return good[:, None] * r[hit] - bad @ r[noise], good[:, None] * q, -(bad.T @ q), good, -bad.sum(0)


class LogBilinear:
    """Context vectors of members, target vectors and biases of classes and of members within their classes."""

    NAMES = ("before", "last", "kinds", "kind_bias", "words", "word_bias")

    def __init__(self, vocabulary: Vocabulary) -> None:
        v, draw = vocabulary, np.random.default_rng(SEED)
        self.v, n = v, len(v.weight)
        total = np.add.reduceat(v.weight, v.first)
        self.p_kind, self.p_word = total / total.sum(), v.weight / total[v.kind_of]
        vectors = lambda rows, scale: draw.normal(0, scale, (rows, DIMENSION)).astype(np.float32)
        self.before, self.last = vectors(n, 0.3), vectors(n, 0.3)
        self.kinds, self.words = vectors(CLASSES + 1, 0.05), vectors(n, 0.05)
        self.kind_bias, self.word_bias = np.log(self.p_kind).astype(np.float32), np.log(self.p_word).astype(np.float32)
        self.past = {x: np.zeros(len(getattr(self, x)), np.float32) for x in self.NAMES}

    def parameters(self) -> np.ndarray:
        return np.concatenate([getattr(self, x).ravel() for x in self.NAMES])

    def set(self, flat: np.ndarray) -> LogBilinear:
        at = 0
        for name in self.NAMES:
            x = getattr(self, name)
            setattr(self, name, flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return self

    def contexts(self, w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
        return self.before[w1] + self.last[w2]

    def train(self, rows: np.ndarray, draw: np.random.Generator) -> None:
        """One pass over (w1, w2, w) rows: of the classes, then of the words within each class."""
        rows = rows[draw.permutation(len(rows))]
        log_noise = np.log(self.p_kind * NOISE).astype(np.float32)
        cumulative = np.cumsum(self.p_kind)
        for at in range(0, len(rows), BATCH):
            w1, w2, w = rows[at : at + BATCH].T
            noise = np.minimum(np.searchsorted(cumulative, draw.random(NOISE)), CLASSES)
            kind = self.v.kind_of[w]
            dq, dr, dn, db, dm = contrast(self.contexts(w1, w2), self.kinds, self.kind_bias, log_noise, kind, noise)
            both = np.r_[kind, noise]
            added(self.before, self.past["before"], w1, dq, RATE)
            added(self.last, self.past["last"], w2, dq, RATE)
            added(self.kinds, self.past["kinds"], both, np.concatenate([dr, dn]), RATE)
            added(self.kind_bias, self.past["kind_bias"], both, np.r_[db, dm], RATE / 4)
        w1, w2, w = rows.T
        kind = self.v.kind_of[w]
        order = np.argsort(kind, kind="stable")
        cuts = np.searchsorted(kind[order], np.arange(CLASSES + 2))
        for c in range(1, CLASSES + 1):
            a, n = int(self.v.first[c]), int(self.v.size[c])
            if n == 1 or cuts[c] == cuts[c + 1]:
                continue
            p = self.p_word[a : a + n]
            log_noise, cumulative = np.log(p * WORD_NOISE).astype(np.float32), np.cumsum(p)
            r, b, past, past_b = self.words[a : a + n], self.word_bias[a : a + n], self.past["words"][a : a + n], self.past["word_bias"][a : a + n]
            for at in range(cuts[c], cuts[c + 1], WORD_BATCH):
                i = order[at : min(at + WORD_BATCH, cuts[c + 1])]
                noise = np.minimum(np.searchsorted(cumulative, draw.random(WORD_NOISE)), n - 1)
                _, dr, dn, db, dm = contrast(self.contexts(w1[i], w2[i]), r, b, log_noise, w[i] - a, noise)
                both = np.r_[w[i] - a, noise]
                added(r, past, both, np.concatenate([dr, dn]), WORD_RATE)
                added(b, past_b, both, np.r_[db, dm], WORD_RATE / 4)

    def log_probabilities(self, w1: np.ndarray, w2: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Natural logs of the normalised probability of each w: of its class, and of the member within it."""
        out, kind = np.empty(len(w)), self.v.kind_of[w]
        order = np.argsort(kind, kind="stable")
        cuts = np.searchsorted(kind[order], np.arange(CLASSES + 2))
        for c in range(CLASSES + 1):
            a, n = int(self.v.first[c]), int(self.v.size[c])
            for at in range(cuts[c], cuts[c + 1], SCORED_AT_ONCE):
                i = order[at : min(at + SCORED_AT_ONCE, cuts[c + 1])]
                q = self.contexts(w1[i], w2[i])
                out[i] = log_softmax(q @ self.kinds.T + self.kind_bias, np.full(len(i), c))
                if n > 1:
                    out[i] += log_softmax(q @ self.words[a : a + n].T + self.word_bias[a : a + n], w[i] - a)
        return out


def log_softmax(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log of the softmax of each row at one place."""
    if not -60 < z.min() <= z.max() < 60:  # beyond these the sums could leave what floats can hold
        z -= z.max(1, keepdims=True)
    hit = z[np.arange(len(z)), at].astype(np.float64)
    return hit - np.log((np.exp(z, out=z) @ np.ones(z.shape[1], z.dtype)).astype(np.float64))


def rows_of_tokens(numbers: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """(w1, w2, w) for each token; the end token stands before each text's begin."""
    w2 = np.r_[0, numbers[:-1]][: len(numbers)]
    w1 = np.r_[0, 0, numbers[:-2]][: len(numbers)]
    first = cuts[:-1]
    w2[first] = w1[first] = 0
    second = first[np.diff(cuts) > 1] + 1
    w1[second] = 0
    return np.column_stack([w1, w2, numbers])


class Averaged:
    """The mean of models by tokens, as integers, so that it doesn't depend on their order."""

    SCALE = 2.0**40

    @staticmethod
    def part(model: LogBilinear, tokens: int, of: int) -> np.ndarray:
        return np.rint(model.parameters().astype(np.float64) * (tokens / of) * Averaged.SCALE).astype(np.int64)


def train(docs: DataFrame, vocabulary: Vocabulary, tokens: int) -> LogBilinear:
    """The model of the training documents, which have ``tokens`` in all."""
    model = LogBilinear(vocabulary)
    n = max(1, -(-tokens // SHARD))
    if not tokens:
        return model
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    order = F.xxhash64(F.lit(SEED), "doc_id", "text")
    dealt = docs.filter(~held_out()).select(F.pmod(order, F.lit(n)).alias("shard"), order.alias("order"), "text")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            t = Tokens(b["text"])
            raw = shared.value.numbers(t).astype(np.uint16)
            ids = pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer((t.cuts * 2).astype(np.int32)), pa.py_buffer(raw)])
            yield pa.record_batch([b["shard"], b["order"], ids], ["shard", "order", "ids"])

    def learn(start: np.ndarray | None, rounds: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, own, shard, held, size, seen, k = None, None, None, [], 0, 0, 0

            def block() -> None:
                nonlocal held, size, seen, k
                cuts = np.r_[0, np.cumsum([len(x) for x in held])]
                rows = rows_of_tokens(np.concatenate(held), cuts)
                for _ in range(rounds):
                    own.train(rows, np.random.default_rng([SEED, shard, k]))
                    k += 1
                held, size, seen = [], 0, seen + len(rows)

            def finish() -> None:
                nonlocal total
                if held:
                    block()
                if own is not None:
                    part = Averaged.part(own, seen, seen if start is None else tokens)
                    total = part if total is None else total + part

            for b in batches:
                for s, ids in zip(b["shard"].to_pylist(), b["ids"].to_pylist()):
                    if s != shard:
                        finish()
                        own, shard, seen, k = LogBilinear(shared.value), s, 0, 0
                        if start is not None:
                            own.set(start)
                    held.append(np.frombuffer(ids, np.uint16).astype(np.int32))
                    size += len(held[-1])
                    if size >= BLOCK:
                        block()
            finish()
            if total is not None:
                yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["sums"])

        return run

    def models(some: DataFrame, start: np.ndarray | None, rounds: int) -> DataFrame:
        numbered = some.mapInArrow(common.released(number), "shard long, order long, ids binary")
        by_shard = numbered.repartition("shard").sortWithinPartitions("shard", "order", "ids")
        return by_shard.mapInArrow(common.released(learn(start, rounds)), "sums binary")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for x in b["sums"]:
                total = np.frombuffer(x.as_buffer(), np.int64) + (0 if total is None else total)
        if total is not None:
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["sums"])

    first = [np.frombuffer(r.sums, np.int64) for r in models(dealt.filter("shard = 0"), None, WARM_ROUNDS).collect()]  # one shard, one model
    start = first[0] / Averaged.SCALE if first else model.parameters()
    sums = common.stored(models(dealt, start, 1))
    left = sums.count()
    while left > ADDED_AT_ONCE:
        left = -(-left // ADDED_AT_ONCE)
        sums = common.stored(sums.repartition(left).mapInArrow(common.released(add), "sums binary"))
    return model.set(sum(np.frombuffer(r.sums, np.int64) for r in sums.toLocalIterator()) / Averaged.SCALE)


def learned(docs: DataFrame, counted: DataFrame) -> tuple[LogBilinear, np.ndarray, np.ndarray, int, int]:
    """The model, hashes and counts of heavy words, and how many training tokens there are, and different ones."""
    total, distinct = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("word")).first()
    heavy = counted.filter((F.col("c") * HEAVY > total) | (F.col("word") == END)).collect()  # at most HEAVY words
    word, kind, c = (np.array([r[k] for r in heavy], np.int64) for k in ("word", "kind", "c"))
    own = np.flatnonzero((c >= LEAST) & (word != END))
    own = own[np.lexsort((word[own], -c[own]))][:VOCABULARY]
    rare, others = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    for r in counted.filter(F.col("word") != END).groupBy("kind").agg(F.sum("c").alias("c"), F.count("word").alias("n")).collect():  # one row a class
        rare[r.kind], others[r.kind] = r.c, r.n
    rare -= np.bincount(kind[own], c[own], CLASSES + 1)
    others -= np.bincount(kind[own], minlength=CLASSES + 1)
    vocabulary = Vocabulary(word[own].view(np.uint64), kind[own].astype(np.int32), c[own], int(c[word == END].sum()), rare, others)
    return train(docs, vocabulary, int(total)), word.view(np.uint64), c, int(total), int(distinct)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of ``docs``.

    Scores are log10 probabilities of the whole text and its end. A null or empty text is its end token. With no training
    documents the base counts are zero and the model knows classes only. Repeated rows score alike. An empty table gives
    an empty one.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = common.stored(counts(docs))
    model, word, c, total, distinct = learned(docs, counted)
    v = model.v
    heavy = common.HashTable((4 * len(word) + 8).bit_length())
    heavy.put(word, np.arange(len(word), dtype=np.int32))
    # within a class's rare words: each known one, and one unseen word, by smoothed counts
    of_class = np.log10(v.rare + 0.5 * (v.distinct + 1))
    shared = docs.sparkSession.sparkContext.broadcast((v, model.parameters(), heavy, np.log10(c + 0.5), of_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, parameters, heavy, log_heavy, of_class = shared.value
        own = LogBilinear(v).set(parameters)
        for b in blocks(batches):
            t = Tokens(b["text"])
            if not len(b):
                continue
            numbers, at, first = v.numbers(t), heavy.find(t.hash, -1), t.cuts[:-1]
            logs = np.where(at >= 0, log_heavy[at] if len(log_heavy) else 0.0, 0.0)
            p = own.log_probabilities(*rows_of_tokens(numbers, t.cuts).T) * LOG_E
            is_rare = (numbers == v.first[t.kind]) & (t.kind > 0)
            p += np.where(is_rare, logs - of_class[t.kind], 0.0)
            light = np.flatnonzero(at < 0)
            text = t.texts()[light]
            order = np.lexsort((t.hash[light], text))
            h, text = t.hash[light][order], text[order]
            new = np.flatnonzero(common.in_order(h) | common.in_order(text))
            offsets = pa.array(np.searchsorted(text[new], np.arange(len(b) + 1)).astype(np.int32))
            words = pa.ListArray.from_arrays(offsets, pa.array(h[new].view(np.int64)))
            times = pa.ListArray.from_arrays(offsets, pa.array(np.diff(np.r_[new, len(h)]).astype(np.int32)))
            sums = [np.add.reduceat(x, first) for x in ((at >= 0).astype(np.int64), logs, p)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], words, times, pa.array(np.diff(t.cuts)), *map(pa.array, sums)], schema=SCORED)

    scored = docs.mapInArrow(common.released(run), "doc_id long, words array<long>, times array<int>, n_tokens long, n_known long, logs double, model double")
    scored = common.stored(scored.withColumns({"row": F.monotonically_increasing_id(), "held_out": held_out()}))
    n = buckets_for(scored.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0])
    sent = scored.select("row", "held_out", "words", "times").mapInArrow(common.released(_send(n)), "bucket int, payload binary")
    sums = common.in_buckets(sent, n).applyInArrow(common.released(_count(n)), "bucket int, payload binary")
    more = common.in_buckets(sums, n).applyInArrow(common.released(_add), "row long, more_logs double, more_known long")
    result = scored.drop("words", "times").join(more, "row", "left")
    base = float(np.log10(total + 0.5 * (distinct + 1)))
    extra = F.coalesce("more_logs", F.lit(0.0))
    return result.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + extra - F.col("n_tokens") * base).alias("base_score"),
        (F.col("model") + extra).alias("score"),
    )


LOG_E = float(np.log10(np.e))
SCORED = pa.schema([("doc_id", pa.int64()), ("words", pa.list_(pa.int64())), ("times", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()), ("model", pa.float64())])
BLOCKS = pa.schema([("bucket", pa.int32()), ("payload", pa.binary())])


def _send(n: int):
    """Hashes of rare words with their row, its count and whether it is held out, to the word's bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, times = b["words"].flatten().to_numpy(), b["times"].flatten().to_numpy()
            row = np.repeat(np.arange(len(b)), pa.compute.list_value_length(b["words"]).to_numpy())
            h = words.view(np.uint64)
            ids, tags = b["row"].to_numpy(), b["held_out"].to_numpy(zero_copy_only=False).astype(np.uint16)
            blocks = list(packed_by_bucket(bucket_of(common.mixed(h), n), h, row, times, ids, tags))
            yield pa.record_batch([pa.array([x[0] for x in blocks], pa.int32()), pa.array([x[1] for x in blocks], pa.binary())], schema=BLOCKS)

    return run


def _count(n: int):
    """Counts the words of a bucket over the training documents; sums what they give to each row, by the row's bucket."""

    def run(group: pa.Table) -> pa.Table:
        h, ids, held, k = unpacked(group["payload"].to_pylist())
        order = np.argsort(h, kind="stable")
        word = np.empty(len(h), np.int64)
        word[order] = np.cumsum(common.in_order(h[order])) - 1
        c = np.bincount(word, k * (held == 0))[word]
        logs, known = k * np.log10(c + 0.5), k * (c > 0)
        order = np.argsort(ids, kind="stable")
        first = np.flatnonzero(common.in_order(ids[order]))
        rows, logs, known = ids[order[first]], np.add.reduceat(logs[order], first), np.add.reduceat(known[order], first).astype(np.int64)
        bucket = bucket_of(common.mixed(rows.view(np.uint64)), n)
        order = np.argsort(bucket, kind="stable")
        out = [(int(bucket[i[0]]), common.pack(rows[i], logs[i], known[i])) for i in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)]
        return pa.table([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], schema=BLOCKS)

    return run


def _add(group: pa.Table) -> pa.Table:
    rows, logs, known = (np.concatenate(x) for x in zip(*map(common.unpack, group["payload"].to_pylist())))
    order = np.lexsort((logs, rows))
    first = np.flatnonzero(common.in_order(rows[order]))
    return pa.table({"row": rows[order[first]], "more_logs": np.add.reduceat(logs[order], first), "more_known": np.add.reduceat(known[order], first)})
