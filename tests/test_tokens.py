"""Byte pairs against plain merging, and contexts that fit a window."""

import base64
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from corvane.operators import tokens
from corvane.operators.embedding import HashEmbedder, embed_chunks
from corvane.operators.rag import ExtractiveGenerator, chat_template, messages, prompt, rag
from corvane.operators.search import Retriever

FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
needs_file = pytest.mark.skipif(not os.path.exists(FILE), reason="no vocabulary")


def plain_merges(data, ranks):
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == 1 << 40:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def some_ranks(draw):
    ranks = {bytes([b]): b for b in range(256)}
    while len(ranks) < 320:
        a, b = (draw.choice([t for t in ranks if not t.strip(b"abc")]) for _ in range(2))
        ranks.setdefault(a + b, len(ranks))
    return ranks


def test_merges_like_one_after_another():
    draw = random.Random(1)
    for _ in range(5):
        pairs = tokens.BytePairs(some_ranks(draw))
        for _ in range(200):
            data = bytes(draw.choice(b"abc") for _ in range(draw.randint(0, 30)))
            assert pairs.part(data) == plain_merges(data, pairs.ranks)


def test_long_parts_take_little_time():
    pairs = tokens.BytePairs(some_ranks(random.Random(2)))
    began = time.perf_counter()
    data = bytes(random.Random(3).choice(b"abc") for _ in range(100_000))
    assert b"".join(pairs._tokens[i] for i in pairs.part(data)) == data and time.perf_counter() - began < 20


def test_cuts_end_with_whole_characters():
    pairs = tokens.BytePairs({bytes([b]): b for b in range(256)})
    assert [pairs.cut("é😀 x", n) for n in range(10)] == ["", "", "é", "é", "é", "é", "é😀", "é😀 ", "é😀 x", "é😀 x"]
    assert pairs.cut("ab", -3) == "" and pairs.decode(pairs.encode("é😀 x")) == "é😀 x"


@needs_file
def test_same_as_the_public_encoder(spark):
    tiktoken = pytest.importorskip("tiktoken")
    with open(FILE, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    other = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", " ", "It's  here,\n\n\tnow 12345!", "naïve 漢字 😀é", "a" * 500, "\x00\x1c  x", "we'll don't I'VE", None]
    pairs = tokens.read_vocabulary(spark, f"file://{FILE}")
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").withColumn("ids", tokens.token_ids(spark, pairs)(F.col("t")))
    rows = df.withColumn("back", tokens.decoded(spark, pairs)(F.col("ids"))).collect()
    assert all(r.back == r.t and r.ids == (None if r.t is None else other.encode_ordinary(r.t)) for r in rows) and len(rows) == len(texts)


def test_contexts_that_fit(spark):
    pairs = tokens.BytePairs({bytes([b]): b for b in range(256)})
    rows = [(0, ["aaaa", "bbbb", "cccc"], "12345"), (1, ["aaaa"], "x" * 30), (2, [], ""), (3, ["é" * 20, "z"], "")]
    df = spark.createDataFrame(rows, "id int, c array<string>, p string")
    got = {r.id: r.f for r in df.select("id", tokens.fitting(spark, pairs, 17)(F.col("c"), F.col("p")).alias("f")).collect()}
    assert got == {0: ["aaaa", "bbbb"], 1: [], 2: [], 3: ["é" * 8]}


def test_answers_from_what_fits(spark):
    texts = ["Rivers flow to the sea. " + "They flow on. " * 30, "Rivers flow past towns."]
    embedder, pairs = HashEmbedder(256), tokens.BytePairs({bytes([b]): b for b in range(256)})
    points = embed_chunks(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), embedder).withColumnRenamed("embedding", "vector")
    queries = spark.createDataFrame([(0, "where do rivers flow")], "query_id long, query string")
    chat = spark.range(1).select(chat_template(messages(prompt(F.lit("where do rivers flow"), F.lit("")))).alias("c")).first().c
    for room, kept in ((0, 0), (24, 1), (10_000, 2)):
        row = rag(Retriever(points, embedder), ExtractiveGenerator(), queries, 2, fit=tokens.fitting(spark, pairs, len(chat) + room)).first()
        assert len(row.retrieved_contexts) == len(row.scores) == kept
        assert sum(map(len, row.retrieved_contexts)) <= room
