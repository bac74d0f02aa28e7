import random
import re
import time

import pytest

from corvane.operators.chunking import chunk_documents, split_text

CASES = [
    ("short", 10, 2, ["short"]),
    ("", 10, 2, [""]),
    ("A first one. B second", 15, 3, ["A first one.", "B second."]),
    ("alpha beta gamma delta", 12, 3, ["alphabeta", "gammadelta"]),
    ("one, two, three", 9, 2, ["one,", "two,", "three,"]),
    ("Aaaa bbbb cccc dddd. Eee", 12, 2, ["Aaaabbbbcccc", "dddd.", "Eee."]),
    ("p1 l1\n\np2 l2", 8, 2, ["p1 l1", "p2 l2"]),
    ("wow! yes? no; ok", 8, 2, ["wow!", "yes?", "no; ok!?"]),
    (None, 10, 2, None),
]


@pytest.mark.parametrize("text,size,overlap,want", CASES)
def test_cases(spark, text, size, overlap, want):
    assert spark.createDataFrame([(text,)], "t string").select(split_text("t", size, overlap).alias("c")).first().c == want


@pytest.mark.parametrize("n,size,overlap,lengths", [(25, 10, 3, [10, 10, 10, 4]), (925, 512, 50, [512, 463, 1])])
def test_windows(spark, n, size, overlap, lengths):
    found = spark.createDataFrame([("x" * n,)], "t string").select(split_text("t", size, overlap).alias("c")).first().c
    assert [len(c) for c in found] == lengths


def test_clean_mode_keeps_spaces_and_drops_inner_windows(spark):
    df = spark.createDataFrame([("alpha beta gamma delta",), ("x" * 925,)], "t string")
    spaced, cut = (r.c for r in df.select(split_text("t", 12, 3, "clean").alias("c")).collect())
    assert spaced == ["alpha beta", "gamma delta"]
    assert all(len(c) > 3 for c in cut)


@pytest.mark.parametrize("size,overlap", [(10, 10), (10, 11), (10, -1)])
def test_bad_overlap(size, overlap):
    with pytest.raises(ValueError):
        split_text("t", size, overlap)


LETTERS = re.compile(r"[abé]")


@pytest.fixture(scope="module")
def chunked(spark):
    """Random texts with their chunks at a small and a larger size."""
    draw = random.Random(5)
    texts = ["".join(draw.choice("ab .,;!?\n é") for _ in range(draw.randint(0, 120))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    return [(size, rows.select("t", split_text("t", size, overlap).alias("c"), split_text("t", size, overlap, "clean").alias("d")).collect()) for size, overlap in ((9, 2), (30, 7))]


def test_chunks_fit(chunked):
    for size, rows in chunked:
        assert all(len(c) <= size for r in rows for c in (*r.c, *r.d))
        assert all(r.c == [r.t] for r in rows if len(r.t) <= size)


def test_letters_stay_in_order(chunked):
    """Without runs that must be cut into windows, chunks hold each letter once, in the order of the text."""
    for size, rows in chunked:
        whole = [r for r in rows if max(map(len, re.findall(r"[^ \n]+", r.t)), default=0) < size - 2]
        assert len(whole) > 300
        for r in whole:
            assert LETTERS.findall("".join(r.c)) == LETTERS.findall("".join(r.d)) == LETTERS.findall(r.t)


def test_paragraphs_are_kept_apart(chunked):
    """A text over the size never has letters of two paragraphs in one chunk if both are over half of it."""
    for size, rows in chunked:
        for r in rows:
            long = [p.strip() for p in r.t.split("\n\n") if len(p.strip()) > size // 2 + 1]
            if len(long) > 1 and len(r.t) > size:
                assert not any(a in c and b in c for c in r.c for a, b in zip(long, long[1:]) if a != b and a not in b and b not in a)


def test_chunks_are_final(chunked, spark):
    """What was split once is not split again, and repeated runs agree."""
    for size, rows in chunked:
        parts = sorted({c for r in rows for c in r.c})
        again = spark.createDataFrame([(c,) for c in parts], "t string").select("t", split_text("t", size, 2).alias("c")).collect()
        assert all(r.c == [r.t] for r in again)


def test_documents(spark):
    docs = spark.createDataFrame([("p1", "T", "a. " * 300, "f.pdf"), ("p2", "U", " \n ", None), ("p3", None, None, None), ("p4", "V", "short", None)], "arxiv_id string, title string, full_text string, pdf_path string")
    rows = chunk_documents(docs).orderBy("id").collect()
    assert [r.id for r in rows] == ["p1_chunk_0", "p1_chunk_1", "p4_chunk_0"]
    assert rows[0].metadata.source == "f.pdf" and rows[2].metadata.source == "" and rows[2].text == "short"


def test_patterns_pack_like_one_part_after_another(spark, monkeypatch):
    """Patterns, and parts packed one by one in blocks, give the same chunks; marks of line ends may stand in a text."""
    from corvane.operators import chunking

    draw = random.Random(8)
    parts = ["\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ", "  ", "a", "bb", "é", "😀", "word", "x" * 9, "y" * 30, "\t", "\n\n\n"]
    texts = ["".join(draw.choices(parts, [draw.choice([1, 5, 30]) for _ in parts], k=draw.randint(0, 120))) for _ in range(400)] + ["﷐ a\n\nb\n\n\nc" * 9, None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    chunks = lambda: [[r.c for r in df.select(split_text("t", size, size // 5, mode).alias("c")).collect()] for size in (1, 7, 25, 60) for mode in ("compat", "clean")]
    by_patterns = chunks()
    monkeypatch.setattr(chunking, "MOST_COUNTED", 0)
    monkeypatch.setattr(chunking, "BLOCK", 3)
    monkeypatch.setattr(chunking, "_joined", lambda size, separator: chunking._folded(size, separator, separator))
    assert chunks() == by_patterns


def test_time_grows_with_the_text(spark):
    """Sixteen times the text takes far less than the square of that, chunks of any size and words without end included."""
    draw = random.Random(9)
    text = "".join(draw.choice(["word ", "longerword ", "a ", "b, ", "end. ", "x"]) for _ in range(400_000))

    def seconds(n):
        df = spark.createDataFrame([(text[:n],)], "t string").select(split_text("t", 60, 10).alias("c"))
        began = time.perf_counter()
        assert sum(map(len, df.first().c)) > n // 2
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(1_600_000) < 6 * seconds(100_000) + 5
    long = spark.createDataFrame([("x" * 50_000 + " " + "y" * 3000,)], "t string")
    assert long.select(split_text("t", 1000, 0).alias("c")).first().c == ["x" * 1000] * 50 + ["y" * 1000] * 3
    assert len(long.select(split_text("t", 2000, 0).alias("c")).first().c) == 27
