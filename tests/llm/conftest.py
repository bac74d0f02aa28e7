import random

import pytest

#: Names that operators use inside; documents may have columns of these names.
CLASHING = "id long, tag string, removed string, bucket string, doc string, row string, n_words string, kept string, quality string, node string, group string, size string, place string, shards string, word string, line string, label string, count string"


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, odd white space, nulls and repeated rows."""
    draw = random.Random(11)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pé", "Ra", "sŏ") for b in ("ta", "vi", "zo", "x", "漢", "")]

    def prose(n):
        return " ".join(draw.choice(words) + draw.choice(["", "", "", ".", ","]) for _ in range(n))

    passage, base = prose(70), prose(150)
    texts = [prose(draw.randint(1, 260)) for _ in range(40)]
    texts += [base, base, base.replace("ka", "lo", 1), f"{prose(20)} {passage} {prose(30)}", f"{passage}\n{prose(5)}", f"{prose(9)}\t{passage}", passage]
    texts += [None, "", " \n\t\x0b\x0c\r", "one", "a b", "x " * 400, "ab" * 500, "  nbsp\x1c is no space here", prose(4000), "😀 é " * 90, "x " * 400]
    rows = [(k, t, ("a", "b", None)[k % 3] if k % 5 else "a") for k, t in enumerate(texts)]
    draw.shuffle(rows)
    return rows + [rows[3], rows[7], (None, prose(60), None), (None, None, "a")]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string, source string").repartition(3)


@pytest.fixture(scope="session")
def crowded(docs):
    """The documents with columns whose names clash with those inside operators."""
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit("7").cast(c.split()[1]).alias(c.split()[0]) for c in CLASHING.split(", ")])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")
