"""The most frequent values by summaries against counting all."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import eda


def plain(values):
    return eda.top(values.groupBy("value").agg(F.count(F.lit(1)).alias("n")), 5).collect()


@pytest.mark.parametrize("tracked, buckets", [(10_000, 65_536), (20, 64), (20, 1)])
@pytest.mark.parametrize("kind", ["skewed", "flat", "ties"])
def test_top_values_are_those_of_all_counts(spark, kind, tracked, buckets):
    draw = random.Random(5)
    pick = {"skewed": lambda: f"w{int(draw.paretovariate(0.7)) % 3000}", "flat": lambda: f"w{draw.randrange(3000)}", "ties": lambda: f"w{draw.randrange(6)}"}[kind]
    rows = [(pick(),) for _ in range(6000)] + [(None,)] * 40 + [("",)] * 30
    if kind == "ties":
        rows = [(f"w{i}",) for i in range(400)] * 3  # all equally frequent: the smallest in order are wanted
    values = spark.createDataFrame(rows, "value string").repartition(7)
    assert eda.top_values(values, 5, tracked, buckets).collect() == plain(values)


def test_few_or_no_values(spark):
    values = spark.createDataFrame([("a",), ("b",), ("b",)], "value string")
    assert [tuple(r) for r in eda.top_values(values).collect()] == [("b", 2), ("a", 1)]
    assert eda.top_values(values.limit(0)).collect() == []
    assert [tuple(r) for r in eda.top_values(spark.createDataFrame([(None,)] * 2, "value string")).collect()] == [(None, 2)]


def test_only_bounded_keys_are_shuffled(spark, monkeypatch):
    """One row a candidate and bucket is written, however many values there are; the third pass isn't needed."""
    written = []
    monkeypatch.setattr(eda, "stored", lambda df: written.append(df.cache()) or written[-1])
    values = spark.range(20_000).select(F.explode(F.array(F.concat(F.lit("v"), F.col("id")), F.concat(F.lit("f"), F.col("id") % 4))).alias("value"))
    assert [r.n for r in eda.top_values(values, 3, 100, 16).collect()] == [5000] * 3
    assert written[0].count() <= 16 + 4 * 3
