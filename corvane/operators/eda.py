"""Corpus statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import STOP_WORDS, clean_alpha, token_count
from corvane.tables import stored

#: Items of a summary, buckets of values that aren't candidates (a broadcast of as many integers at most), and how many
#: groups summaries are merged in.
TRACKED, BUCKETS, GROUPS = 10_000, 65_536, 32


def summary(df: DataFrame, value: Column | str) -> DataFrame:
    """One row: median and mean rounded half to even, least and greatest."""
    x = F.col(value) if isinstance(value, str) else value
    return df.select(x.alias("x")).agg(F.bround(F.median("x"), 0).alias("median"), F.bround(F.avg("x"), 0).alias("mean"), F.min("x").alias("least"), F.max("x").alias("greatest"))


def token_counts(df: DataFrame, text: str) -> DataFrame:
    return df.select(token_count(clean_alpha(text)).alias("tokens"))


def _counted(df: DataFrame, value: str) -> DataFrame:
    """(v, n) of each value but null. It is written down, so range and bins come from one pass over ``df``."""
    return stored(df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n")))


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """(bin from 0, n) over ``bins`` equal widths from the least to the greatest value; empty bins are left out."""
    counted = _counted(df, value)
    low, high = counted.agg(F.min("v"), F.max("v")).first()
    if low is None:
        low = high = 0
    at = F.lit(0) if low == high else F.least(F.floor((F.col("v") - F.lit(low)) * bins / F.lit(high - low)), F.lit(bins - 1))
    return counted.groupBy(at.cast("int").alias("bin")).agg(F.sum("n").alias("n"))


def density(df: DataFrame, value: str, points: int = 200) -> DataFrame:
    """(x, density) of a Gaussian kernel estimate at ``points`` places from the least to the greatest value, by Scott's rule.

    Equal values are counted first. Values that are all equal, or none, give no rows.
    """
    counted = _counted(df, value).withColumn("v", F.col("v").cast("double"))
    n, mean, low, high = counted.agg(F.sum("n"), F.sum(F.col("n") * F.col("v")) / F.sum("n"), F.min("v"), F.max("v")).first()
    squares = counted.agg(F.sum(F.col("n") * (F.col("v") - F.lit(mean or 0.0)) ** 2)).first()[0] or 0.0
    spread = math.sqrt(squares / (n - 1)) if n and n > 1 else 0.0
    width = spread * max(n or 0, 1) ** -0.2
    step = (high - low) / (points - 1) if width else 0.0
    x = F.lit(low or 0.0) + F.col("at") * F.lit(step)
    at = F.sequence(F.lit(0), F.lit(points - 1)) if width else F.array().cast("array<int>")
    near = F.exp(-((x - F.col("v")) / F.lit(width or 1.0)) ** 2 / 2)
    summed = counted.select("v", "n", F.explode(at).alias("at")).groupBy("at").agg(F.sum(F.col("n") * near).alias("s"))
    return summed.select(x.alias("x"), (F.col("s") / F.lit((n or 1) * (width or 1.0) * math.sqrt(2 * math.pi))).alias("density"))


def frequencies(df: DataFrame, values: Column) -> DataFrame:
    """(value, n) of the elements of an array column."""
    return df.select(F.explode(values).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def word_frequencies(df: DataFrame, text: str, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """Words of cleaned texts but stop words, case kept; an empty text counts as one empty word.

    Words are counted first, so each different one is held against the stop words once.
    """
    counted = frequencies(df, F.split(clean_alpha(text), " ", -1))
    return counted.filter(~F.lower("value").isin(*sorted(set(stop_words))) | F.col("value").isNull())


def words(df: DataFrame, text: str, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """(value) a row for each word of cleaned texts but stop words; what ``word_frequencies`` counts."""
    every = df.select(F.explode(F.split(clean_alpha(text), " ", -1)).alias("value"))
    return every.filter(~F.lower("value").isin(*sorted(set(stop_words))) | F.col("value").isNull())


def candidates(values: DataFrame, most: int, tracked: int = TRACKED) -> list[str]:
    """Up to ``most`` values of the string column ``value`` that may be the most frequent, by summaries of ``tracked`` items.

    Each task sums up its rows. Summaries are merged in GROUPS squared groups, which get one of each of their tasks, then in
    GROUPS, then in one, so the last two steps get GROUPS summaries each, however many tasks there are.
    """
    tasks = F.pmod(F.xxhash64(F.spark_partition_id()), F.lit(GROUPS**2)).alias("g")
    some = values.filter("value is not null").select("value", tasks)
    some = some.groupBy("g").agg(F.expr(f"approx_top_k_accumulate(value, {tracked})").alias("s"))
    some = some.groupBy((F.col("g") % GROUPS).alias("g")).agg(F.expr(f"approx_top_k_combine(s, {tracked})").alias("s"))
    some = some.groupBy(F.col("g") % 1).agg(F.expr(f"approx_top_k_combine(s, {tracked})").alias("s"))  # without a group, no rows would be an error
    row = some.select(F.expr(f"approx_top_k_estimate(s, {min(most, tracked)})").alias("e")).first()
    return [] if row is None else [e["item"] for e in row.e]


def top_values(values: DataFrame, n: int = 20, tracked: int = TRACKED, buckets: int = BUCKETS) -> DataFrame:
    """(value, n): what ``top`` of the counts of ``value`` gives, exactly, without a shuffle of all different values.

    Summaries name candidates. A second pass counts these exactly and all other rows by the bucket that their value is
    hashed to, at most ``buckets`` rows a task, so a bucket's count bounds that of each value in it. Buckets that reach the
    last candidate's count, if any, are counted value by value in a third pass; the rest can't hold a frequent value.
    The passes must see the same rows. Null is a value like any other; no rows give none.
    """
    named = candidates(values, 4 * n, tracked)
    chosen = F.col("value").isin(*named) & F.col("value").isNotNull() if named else F.lit(False)
    bucket = F.pmod(F.xxhash64("value"), F.lit(buckets)).cast("int")
    keyed = values.select(F.when(chosen, F.col("value")).alias("value"), F.when(chosen, F.lit(-1)).otherwise(bucket).alias("bucket"))
    counted = stored(keyed.groupBy("bucket", "value").agg(F.count(F.lit(1)).alias("n")))
    exact = counted.filter("bucket = -1").select("value", "n")
    least = top(exact, n).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("n")).first()
    heavy = counted.filter(F.col("bucket") >= 0).filter(F.col("n") >= (least.n if least.k == n else 0)).select("bucket")
    if not heavy.isEmpty():
        rest = values.filter(~F.coalesce(chosen, F.lit(False))).select("value", bucket.alias("bucket")).join(F.broadcast(heavy), "bucket")
        exact = exact.unionByName(rest.groupBy("value").agg(F.count(F.lit(1)).alias("n")))
    return top(exact, n)


def top(counted: DataFrame, n: int = 20) -> DataFrame:
    """The most frequent values, the smaller of equals first."""
    return counted.orderBy(F.desc("n"), "value").limit(n)
