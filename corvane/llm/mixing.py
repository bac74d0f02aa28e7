"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every document has a place in its source's permutation: a seeded hash. Equal stretches of the hash range are the
source's blocks. A source's target is met by whole passes over its blocks and one pass that ends inside a block, at the
document (and word) where the target is reached; so a source's taken words are its target, rounded down.

The blocks that all passes draw are the source's exact quota. A tree splits the quotas of all sources among output
shards: each node gives its left half a multivariate-hypergeometric share of what it has, so every shard gets an
unbiased mix, all quotas are used up exactly, and no block is drawn twice. A leaf's quota is a stretch of the source's
permuted blocks, disjoint from all others. Inside a shard, documents are shuffled by hash. Everything about a document
follows from its hash, its source's row and its block's shards. No documents are sorted by source, only the sums of its
blocks, and the documents of the one block where its target ends.

The driver holds one row a source and, of the tree, the top levels; tasks expand the rest. Words are counted once, to a
table without texts; the mix itself reads texts once more and shuffles them once, to their shards. The rows of sources
and of blocks go to every task where there are at most MOST_SENT, and are joined by their keys beyond.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import common

WEIGHTS, SHARE, CAP = (5.0, 2.0, 1.0), 1.5, 2.0
#: Words in a block and blocks in a shard, about; subtrees that the driver hands to tasks.
BLOCK, PER_SHARD, SUBTREES, MOST_SENT = 250_000, 16, 256, 100_000
SEED = 20_240_601
SPACE = r"[\x20\x09-\x0D]+"


def targets(sizes: Sequence[float], weights: Sequence[float], share: float = SHARE, cap: float = CAP) -> np.ndarray:
    """share of all sizes by weight; what exceeds cap times a source's size goes to the others by weight, until none does."""
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    out, free, left = np.zeros(len(sizes)), np.ones(len(sizes), bool), share * sizes.sum()
    while free.any():
        out[free] = left * weights[free] / weights[free].sum()
        over = free & (out > cap * sizes)
        if not over.any():
            break
        out[over] = cap * sizes[over]
        left -= out[over].sum()
        free &= ~over
    return out


@dataclass(frozen=True)
class Shards:
    """How many blocks go into shards in a row: ``total`` blocks are laid over ``number`` shards as evenly as can be."""

    total: int
    number: int

    @staticmethod
    def of(total: int, per_shard: int = 0) -> Shards:
        return Shards(total, max(1, -(-total // (per_shard or PER_SHARD))))

    def capacity(self, low: int, high: int) -> int:
        return self.total * high // self.number - self.total * low // self.number


def halved(have: np.ndarray, shards: Shards, low: int, high: int, seed: int) -> np.ndarray:
    """What the left half of the shards low to high gets; the same whenever and wherever it is drawn."""
    draw = np.random.default_rng([seed, low, high])
    return draw.multivariate_hypergeometric(have, shards.capacity(low, (low + high) // 2), method="marginals")


def split_quota(quota: np.ndarray, shards: Shards, seed: Sequence[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, blocks of each source, first block of each source) for shards seed[1] to seed[2], by the splitting tree."""
    stack = [(seed[1], seed[2], quota, np.zeros_like(quota))]
    while stack:
        low, high, have, first = stack.pop()
        if high - low == 1:
            yield low, have, first
            continue
        left = halved(have, shards, low, high, seed[0])
        middle = (low + high) // 2
        stack.append((middle, high, have - left, first + left))
        stack.append((low, middle, left, first))


def place() -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col("doc_id").cast("long"), "text"), 1)


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns to keep as ``doc``, with source, size in words and place in the permutation."""
    kept = [F.struct(*keep).alias("doc")] if keep else []
    inner = docs.select(*kept, F.col("source").cast("string").alias("source"), place().alias("place"), F.col("text").alias("_text"))
    out = inner.drop("_text").schema.add("size", T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = pa.array([len(x.split()) if x else 0 for x in common.binary(b["_text"])], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b[c] for c in out.names[:-1]), size], names=out.names)

    return inner.mapInArrow(common.released(run), out)


def block_of(blocks: str = "blocks") -> Column:
    return F.shiftrightunsigned(F.shiftrightunsigned("place", 32) * F.col(blocks), 31)


@dataclass
class Plan:
    """sources: a row each with its size, target, passes, last place taken and blocks. tied: a source ends among several rows of one place. shards: (sid, block, shards by pass). Both are to be sent to all tasks if they are small."""

    sources: DataFrame
    tied: bool
    shards: DataFrame


SOURCES = "source string, sid int, source_size long, target double, passes long, blocks long, rest long, last_block long, last_place long, part long, tied long"


def plan(rows: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> Plan:
    spark = rows.sparkSession
    found = rows.groupBy("source").agg(F.sum("size").alias("size")).collect()  # one row a source
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r["size"] for r in found]
    aim = targets(sizes, [weights[k % len(weights)] for k in range(len(found))], share, cap)
    table = pd.DataFrame({"source": [r.source for r in found], "sid": range(len(found)), "source_size": sizes, "target": aim})
    size = np.maximum(np.array(sizes, np.int64), 1)
    table["passes"] = (np.floor(aim).astype(np.int64)) // size
    table["blocks"] = np.maximum(1, -(-size // BLOCK))
    table["rest"] = np.floor(aim).astype(np.int64) - table["passes"] * size
    table["last_block"], table["last_place"], table["part"], table["tied"] = -1, -1, 0, 0

    def as_frame() -> DataFrame:
        return spark.createDataFrame([tuple(None if x is None else x for x in r) for r in table.astype(object).itertuples(index=False)], SOURCES)

    placed = _with_sources(rows, _sent(as_frame(), len(table))).filter("rest > 0").withColumn("block", block_of())
    sums = placed.groupBy("sid", "rest", "block").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("sid").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    ends = sums.withColumn("before", before).filter("before < rest and before + words >= rest").select("sid", "block", "before").collect()
    for r in ends:
        table.loc[r.sid, ["last_block", "part"]] = r.block, r.before
    inside = _with_sources(rows, _sent(as_frame(), len(table))).withColumn("block", block_of()).filter("rest > 0 and block = last_block")
    # rows of one place, as repeated ones have, are met together and share what is left of the target there
    places = inside.groupBy("sid", "rest", "part", "place").agg(F.sum("size").alias("words"), F.count("*").alias("tied"))
    reached = F.sum("words").over(Window.partitionBy("sid").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)) + F.col("part")
    met = places.withColumn("reached", reached).filter("reached >= rest").groupBy("sid").agg(F.min(F.struct("place", "words", "reached", "tied")).alias("x"))
    for r in met.select("sid", "x.*").collect():
        table.loc[r.sid, ["last_place", "part", "tied"]] = r.place, int(table.loc[r.sid, "rest"]) - (r.reached - r["words"]), r.tied
    quota = (table["passes"] * table["blocks"] + table["last_block"] + 1).to_numpy(np.int64)
    blocks = table["blocks"].to_numpy(np.int64)
    return Plan(_sent(as_frame(), len(table)), bool((table["tied"] > 1).any()), _sent(_shards(spark, quota, blocks, seed), int(blocks.sum())))


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MOST_SENT else df


def _with_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    right = sources.withColumnRenamed("source", "_source")
    return rows.join(right, rows.source.eqNullSafe(right._source)).drop("_source")


def _shards(spark: SparkSession, quota: np.ndarray, blocks: np.ndarray, seed: int) -> DataFrame:
    """(sid, block, shards): the shard that draws the block in each pass, in order."""
    plan = Shards.of(int(quota.sum()))
    tops = [(0, plan.number, quota, np.zeros_like(quota))]
    while len(tops) < SUBTREES and any(high - low > 1 for low, high, _, _ in tops):
        more = []
        for low, high, have, first in tops:
            if high - low == 1:
                more.append((low, high, have, first))
                continue
            left, middle = halved(have, plan, low, high, seed), (low + high) // 2
            more += [(low, middle, left, first), (middle, high, have - left, first + left)]
        tops = more
    nodes = spark.createDataFrame([(low, high, have.tolist(), first.tolist()) for low, high, have, first in tops], "low int, high int, have array<long>, first array<long>")

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for low, high, have, at in b.itertuples(index=False):
                for shard, got, first in split_quota(np.asarray(have), plan, (seed, low, high)):
                    first = first + np.asarray(at)
                    for sid in np.flatnonzero(got):
                        unit = np.arange(first[sid], first[sid] + got[sid])
                        yield pd.DataFrame({"sid": np.int32(sid), "block": unit % blocks[sid], "pass": unit // blocks[sid], "shard": np.int64(shard)})

    drawn = nodes.mapInPandas(expand, "sid int, block long, pass long, shard long")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("pass", "shard"))), lambda x: x.shard)
    return drawn.groupBy("sid", "block").agg(in_order.alias("shards"))


def numbered(tied: DataFrame) -> DataFrame:
    """Rows of one place in a source with their number from 0, counted within tasks first."""
    order = Window.partitionBy("sid", "task").orderBy("place")
    found = common.stored(tied.withColumn("task", F.spark_partition_id()).withColumn("number", F.row_number().over(order) - 1))
    counts = found.groupBy("sid", "task").count()
    before = F.sum("count").over(Window.partitionBy("sid").orderBy("task").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")
    counts = counts.select("sid", "task", before.alias("before"))
    return found.join(counts, ["sid", "task"]).withColumn("number", F.col("number") + F.col("before")).drop("task", "before")


def applied(placed: DataFrame, by: Plan) -> DataFrame:
    """Rows with their source's columns and, new, taken (words, repeats counted) and shards (one for each time it is drawn)."""
    part = F.when(F.col("place") < F.col("last_place"), F.col("size")).when(F.col("place") == F.col("last_place"), F.least(F.greatest(F.col("part") - F.col("number") * F.col("size"), F.lit(0)), F.col("size"))).otherwise(F.lit(0))
    out = placed.withColumn("number", F.lit(0).cast("long"))
    if by.tied:
        tied = (F.col("place") == F.col("last_place")) & (F.col("tied") > 1)
        out = out.filter(~tied).unionByName(numbered(placed.filter(tied)))
    out = out.withColumn("part", part).withColumn("block", block_of())
    out = out.join(by.shards, ["sid", "block"], "left")
    draws = (F.col("passes") + (F.col("part") > 0).cast("long")).cast("int")
    return out.select("doc", "source", "place", "size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("part")).alias("taken"), "passes", "part", F.slice(F.coalesce("shards", F.array().cast("array<long>")), 1, draws).alias("shards"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, shards for each row of ``docs`` (doc_id, text, source).

    Sources in order of code points, null last, weigh WEIGHTS in turn. A null or empty text has size 0 and gives no
    words. Rows that are repeated are drawn alike, but where the target ends among them. An empty table gives an empty one.
    """
    rows = common.stored(measured(docs, ["doc_id"]))
    by = plan(rows)
    return applied(_with_sources(rows, by.sources), by).select("doc.doc_id", "size", "source_size", "target", "taken", "shards")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as they are drawn, shuffled inside their shards.

    Where a source's target ends inside a document, its last draw has the document's first words only.
    """
    by = plan(common.stored(measured(docs, [])))
    placed = _with_sources(docs.select(F.struct(*docs.columns).alias("doc"), F.col("source").cast("string").alias("source"), place().alias("place")), by.sources)
    # of a document that is taken whole it only matters whether it has words; they are counted where a target ends
    words = F.array_remove(F.split("doc.text", SPACE), "")
    some = F.coalesce(F.col("doc.text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).cast("long")
    placed = placed.withColumn("size", F.when(F.col("place") == F.col("last_place"), F.greatest(F.coalesce(F.size(words), F.lit(0)), F.lit(0)).cast("long")).otherwise(some))
    drawn = applied(placed, by).filter(F.size("shards") > 0)
    drawn = drawn.select("doc", "place", "size", "passes", "part", F.posexplode("shards").alias("pass", "shard"))
    cut = (F.col("pass") == F.col("passes")) & (F.col("part") < F.col("size"))
    first_words = F.array_join(F.slice(words, 1, F.col("part").cast("int")), " ")
    text = F.when(cut, first_words).otherwise(F.col("doc.text"))
    out = drawn.select("shard", F.xxhash64("pass", "shard", "place").alias("order"), F.col("doc").withField("text", text).alias("doc"))
    return out.repartition("shard").sortWithinPartitions("shard", "order").select("doc.*")
