import pytest
from pyspark.sql import functions as F

from corvane.functions.text import WHITE, clean_alpha, clean_text, is_blank, last_segment, percent_encoded, strip, token_count

CLEAN = [
    ("hy-\nphen", "hyphen"),
    ("foot\n2 note", "foot note"),
    ("keep\n12 x", "keep 12 x"),
    ("keep\n0 x", "keep 0 x"),
    ("a\n9\nb", "a b"),
    ("tail\n3", "tail 3"),
    ("  a  b\x1cc  ", "a b c"),
    ("-\n", ""),
    ("", ""),
    (None, None),
]
ALPHA = [("it's 42% of-\nten", "it's often", 2), ("café naïve", "caf na ve", 3), ("123", "", 0), ("", "", 0)]


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f("t").alias("x")).first().x


def test_clean_text(spark):
    rows = spark.createDataFrame([(a, b) for a, b in CLEAN], "t string, want string")
    for r in rows.select("t", "want", clean_text("t").alias("got")).collect():
        assert r.got == r.want, r.t


def test_clean_alpha(spark):
    rows = spark.createDataFrame(ALPHA, "t string, want string, n int")
    for r in rows.select("*", clean_alpha("t").alias("got"), token_count(clean_alpha("t")).alias("k")).collect():
        assert (r.got, r.k) == (r.want, r.n), r.t


def test_white_space_is_that_of_python(spark):
    points = spark.range(1, 0x11000).filter("id < 55296 or id > 57343").select("id", F.regexp_like(F.decode(F.encode(F.char(F.lit(32)), "UTF-8"), "UTF-8"), F.lit(WHITE)).alias("x"))
    assert points.first().x
    rows = [(c, chr(c)) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    found = spark.createDataFrame(rows, "c int, s string").filter(F.regexp_like("s", F.lit(WHITE))).collect()
    assert {r.c for r in found} == {c for c, s in rows if s.isspace()}


def test_strip_and_blank(spark):
    assert one(spark, "  a b \x1c\n", strip) == "a b"
    assert one(spark, "  \n", is_blank) is True
    assert one(spark, None, is_blank) is True
    assert one(spark, " x", is_blank) is False


def test_addresses(spark):
    assert one(spark, "http://x.org/abs/hep-th/9901001v1", last_segment) == "9901001v1"
    assert one(spark, "cat:a b/c*~", percent_encoded) == "cat%3Aa%20b/c%2A~"


@pytest.mark.parametrize("text,n", [("", 0), ("a", 1), ("a b c", 3)])
def test_token_count(spark, text, n):
    assert one(spark, text, token_count) == n
