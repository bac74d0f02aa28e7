import math
import struct

import duckdb
from pyspark.sql import functions as F

from corvane.functions.vectors import rounded
from corvane.plans import registry


def bits(x):
    return None if x is None else "nan" if math.isnan(x) else struct.pack(">d", x)


def test_rounding_keeps_the_sign_of_zero(spark):
    values = [-1e-9, 1e-9, -0.0, 0.0, 0.5, -2.5, 1.25e300, 0.1234565, -0.49999999999999994, 1e22, float("nan"), float("inf"), -float("inf"), None]
    found = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").select("k", rounded(F.col("v"), 0).alias("a"), rounded(F.col("v"), 6).alias("b"))
    db = duckdb.connect()
    db.execute("CREATE TABLE t (k INT, v DOUBLE)")
    db.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(values)))
    want = db.execute("SELECT k, round(v, 0), round(v, 6) FROM t ORDER BY k").fetchall()
    assert [(r.k, bits(r.a), bits(r.b)) for r in found.orderBy("k").collect()] == [(k, bits(a), bits(b)) for k, a, b in want]


def test_normalized_vectors_equal_sql_to_the_bit(spark, tmp_path):
    """Small negative components, zero vectors, nulls and what isn't finite."""
    nan, inf = float("nan"), float("inf")
    rows = [[-1e-8, 1.0], [3.0, -4.0], [0.0, 0.0], [], None, [3.0, None, 4.0], [None], [nan, 1.0], [inf, 1.0], [1e-30, -1e-30]]
    spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {k: (v and [bits(x) for x in v], bits(n)) for k, v, n in db.execute(registry.ORACLE_SQL["normalize_vectors"]).fetchall()}
    got = {r.vec_id: (r.vector and [bits(x) for x in r.vector], bits(r.norm)) for r in registry.QUERIES["normalize_vectors"](spark, str(tmp_path)).collect()}
    assert got == want and want[0][0][0] == bits(-0.0)
