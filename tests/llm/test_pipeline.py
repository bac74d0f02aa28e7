from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_dedup import kept_words, words

import corpus_pipeline
from corvane.llm import mixing, pieces, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Prose, junk, exact and near copies, a shared passage, nulls, and columns beside those of documents."""
    import random

    draw = random.Random(3)
    stop = "the of and to in a is that it for on was with as be by this from".split()
    own = [f"{a}{b}{c}" for a in "klmnprst" for b in "aeiou" for c in ("r", "st", "nd", "ling")]

    def prose(n):
        return " ".join(draw.choice(stop if draw.random() < 0.4 else own) + ("." if draw.random() < 0.1 else "") for _ in range(n))

    good = [prose(draw.randint(40, 200)) for _ in range(60)]
    passage = prose(70)
    texts = good + [good[0], good[0], good[1].replace(" the ", " a ", 1), f"{prose(40)} {passage} {prose(40)}", f"{prose(30)} {passage}\n{prose(30)}"]
    texts += [" | ".join(f"menu{k}x{j}" for j in range(40)) for k in range(8)] + [" ".join(f"W{k}{j}***" for j in range(30)) for k in range(8)]
    texts += [None, "", " \n", "too short", "a b " * 100]
    rows = [(k, t, "en", ("s1", "s2", None)[k % 3], len(t) if t else None, "x") for k, t in enumerate(texts)]
    rows += [rows[5], (None, prose(60), None, "s1", None, None), (None, None, None, None, None, None)]
    at = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame(rows, SCHEMA + ", kept string").repartition(3)
    docs.write.parquet(f"{at}/documents.parquet")
    return at, rows


def test_stages_exchange_few_rows_at_once(spark, tables):
    """Also in a session that says more or nothing; what says less stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        for said, want in (("10000", "1000"), ("0", "1000"), ("70", "70")):
            spark.conf.set(key, said)
            stage(spark, docs.limit(0), tables[0])
            assert spark.conf.get(key) == want
    spark.conf.unset(key)


def rows_of(df):
    return Counter(str(r) for r in df.collect())


def test_stages_one_after_another(spark, tables, tmp_path):
    at, rows = tables
    docs, out = spark.read.parquet(f"{at}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, docs, at)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert found.schema.simpleString() == docs.schema.simpleString()
        found.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        out[name] = docs.collect()
    given = spark.read.parquet(f"{at}/documents.parquet")

    good = out["quality rules"]
    want = Counter((r.doc_id, r.n_words) for r in quality.score(given).filter("kept").collect())
    assert Counter((r.doc_id, len(words(r.text))) for r in good) == want
    assert {r.doc_id for r in good if r.doc_id is not None} >= set(range(65)) and not {r.doc_id for r in good} & set(range(65, 86))
    assert not rows_of(spark.read.parquet(f"{tmp_path}/0")) - rows_of(given)

    one = out["near dedup"]
    ids = {r.doc_id for r in one}
    assert ids >= {*range(60), 63, 64, None} and not ids & {60, 61, 62} and len(one) == len({r.text for r in one})

    cut = out["substring dedup"]
    removed = {(d, n - gone) for d, n, gone, _ in kept_words([(r.doc_id, r.text, r.source) for r in one], 50)}
    assert {(r.doc_id, len(words(r.text))) for r in cut} == {x for x in removed if x[1]}
    assert sum(len(words(r.text)) for r in one) - sum(len(words(r.text)) for r in cut) >= 65
    assert all(r.n_chars == len(r.text) for r in cut)

    mixed = out["mix sources"]
    taken = {(r.doc_id, r["size"]): r.taken for r in mixing.mix(spark.read.parquet(f"{tmp_path}/2")).collect()}
    got = Counter()
    for r in mixed:
        got[r.doc_id] += len(words(r.text))
    assert +got == +Counter({d: t for (d, _), t in taken.items()})
    assert all(r.n_chars == len(r.text) for r in mixed)

    last = out["encode"]
    assert Counter((r.doc_id, r.text) for r in last) == Counter((r.doc_id, r.text) for r in mixed)
    v = pieces.load()
    assert all(r.n_pieces == len(r.pieces) and r.pieces == pieces.Lattice(v).whole(pieces.marked(r.text))[1] for r in last[:20])


def test_whole_run_and_nothing(spark, tables, tmp_path):
    at, _ = tables
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
    found = corpus_pipeline.run(spark, at)
    assert rows_of(found) == rows_of(corpus_pipeline.run(spark, at)) and found.count() > 60
    docs = spark.read.parquet(f"{at}/documents.parquet")
    docs.filter(F.lit(False)).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    for _, stage in corpus_pipeline.STAGES:
        nulls = docs.filter("text is null").select("doc_id", "text", "source")
        assert stage(spark, nulls, at).count() <= nulls.count()
