import json
import time
import zlib

import pytest
from pyspark.sql import functions as F

from corvane.config import Chunking, Config, Download, Embedding, Index
from corvane.operators import eda, ingest
from corvane.plans.service import Service, run_pipeline
from corvane.sources import atom, download, files, sinks
from corvane.streaming.ingest import ingest_new

FEED = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://x.org/abs/{n}v1</id><title> A title
</title><summary> Sum </summary><published>2025-0{n}-01T00:00:00Z</published><author><name>Ann</name></author><author><name>Bob</name></author>
<link title="pdf" href="{url}"/><category term="cs.CL"/></entry></feed>"""


def test_saved_feeds(spark):
    df = spark.createDataFrame([(FEED.format(n=1, url="u"),)], "xml string")
    assert [tuple(r) for r in atom.parse_feeds(df).collect()] == [("1v1", "A title", "Sum", ["Ann", "Bob"])]


def test_addresses():
    assert atom.query_url("http://b", "cs.CL", "202501010000", 5, 5) == "http://b?search_query=cat%3Acs.CL%20AND%20submittedDate%3A%5B202501010000%20TO%20999912312359%5D&start=5&max_results=5&sortBy=submittedDate&sortOrder=descending"


def test_fetch_gives_up():
    with pytest.raises(OSError):
        atom.fetch("file:///no/such/file", retries=1, wait=0)


def test_json(spark, tmp_path):
    (tmp_path / "papers").mkdir()
    with pytest.raises(FileNotFoundError):
        files.read_json_documents(spark, str(tmp_path / "papers"))
    (tmp_path / "papers" / "a.json").write_text(json.dumps({"arxiv_id": "a", "title": "é", "full_text": "x"}, indent=2))
    (tmp_path / "papers" / "b.json").write_text(json.dumps([{"arxiv_id": "b"}, {"arxiv_id": "c"}]))
    assert sorted(r.arxiv_id for r in files.read_json_documents(spark, str(tmp_path / "papers")).collect()) == ["a", "b", "c"]
    (tmp_path / "lines.jsonl").write_text('{"id": "1", "text": "é"}\n\n  \n{"id": "2"}\n')
    lines = files.read_json_lines(spark, str(tmp_path / "lines.jsonl"))
    assert [r.id for r in lines.collect()] == ["1", "2"]
    assert files.write_json(lines, str(tmp_path / "new" / "out")) == 2
    assert files.read_json_lines(spark, str(tmp_path / "new" / "out")).count() == 2


def test_files_of_documents_and_arrays(spark, tmp_path):
    """A file a document by executors, found again by the reader; names that need escapes; one array in order."""
    rows = [(f"p{n}", f"T{n}", None, ["a"], "", "é text") for n in range(20)] + [("cs/01 x", "slash", "", [], "", "old id")]
    df = spark.createDataFrame(rows, files.PAPER).repartition(5)
    folder = tmp_path / "docs"
    sinks.write_json_documents(df, str(folder))
    assert len(list(folder.iterdir())) == 21 and json.loads((folder / "p3.json").read_text())["abstract"] is None
    assert sorted(map(tuple, files.read_json_documents(spark, str(folder)).collect()), key=str) == sorted(rows, key=str)
    assert (folder / "cs%2F01%20x.json").exists()
    sinks.write_json_documents(df.limit(1).withColumn("arxiv_id", F.lit("p3")).withColumn("title", F.lit("new")), f"file://{folder}")
    assert json.loads((folder / "p3.json").read_text())["title"] == "new" and len(list(folder.iterdir())) == 21
    sinks.write_json_documents(df.filter("arxiv_id = 'p7'"), str(folder), mode="overwrite")
    assert [p.name for p in folder.iterdir()] == ["p7.json"]
    sinks.write_json_array(df.orderBy("arxiv_id"), str(tmp_path / "all.json"))
    assert [r["arxiv_id"] for r in json.loads((tmp_path / "all.json").read_text())] == sorted(r[0] for r in rows)
    assert files.read_metadata(spark, str(tmp_path / "all.json")).count() == 21
    sinks.write_json_array(df.filter("false"), str(tmp_path / "none.json"))
    assert json.loads((tmp_path / "none.json").read_text()) == []


def test_failed_tasks_leave_no_file(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "kept.json").write_text("{}")
    bad = spark.range(40).select(F.when(F.col("id") < 39, F.col("id").cast("string")).alias("arxiv_id")).repartition(4)
    with pytest.raises(Exception, match="no file can have the name"):
        sinks.write_json_documents(bad, str(folder))
    assert [p.name for p in folder.iterdir()] == ["kept.json"]
    with pytest.raises(Exception, match="columns must be"):
        sinks._save(bad, str(folder), "append")


def test_tasks_share_one_rate(spark, tmp_path):
    """Three tasks begin no more requests than one would."""
    log = tmp_path / "log"

    def get(url, timeout, retries, wait):
        with open(log, "a") as out:
            out.write(f"{time.time()}\n")
        if url == "u5":
            raise OSError("gone")
        return url.encode()

    papers = spark.createDataFrame([(f"p{n}", f"u{n}") for n in range(9)], "arxiv_id string, pdf_url string")
    rows = download.fetched(papers, Download(pause=0.2, parallel=3), get).collect()
    assert {r.arxiv_id: bytes(r.content) if r.content else r.error for r in rows} == {f"p{n}": f"u{n}".encode() if n != 5 else "OSError: gone" for n in range(9)}
    times = sorted(map(float, log.read_text().split()))
    assert times[-1] - times[0] >= 0.2 * (9 - 3) * 0.9


def test_failures_are_rows(spark, tmp_path):
    (tmp_path / "good.pdf").write_bytes(b"text")
    (tmp_path / "bad.pdf").write_bytes(b"\x00bad")

    def load():
        def extract(content):
            if content.startswith(b"\x00"):
                raise ValueError("broken")
            return content.decode()

        return extract

    found = files.extract_texts(files.read_binary(spark, str(tmp_path)), load).withColumn("path", files.file_name())
    metadata = spark.createDataFrame([(n, f"{tmp_path}/{n}.pdf") for n in ("good", "bad", "none")], "arxiv_id string, pdf_path string")
    rows = {r.arxiv_id: r for r in ingest.with_files(metadata, found).collect()}
    assert rows["good"].full_text == "text" and rows["good"].error is None
    assert rows["bad"].error == "ValueError: broken" and rows["none"].error == "no such file"


def test_text_of_simple_pdfs():
    shown = b"BT /F1 12 Tf 72 700 Td (Hello \\(PDF\\) w\\366rld) Tj 0 -14 Td [(sec) 20 (ond) -300 (line)] TJ T* <414243> Tj ET"
    plain = b"%PDF-1.4\n1 0 obj << /Length 99 >>\nstream\n" + shown + b"\nendstream endobj"
    packed = b"%PDF-1.4\n1 0 obj << /Filter /FlateDecode /Length 99 >>\nstream\n" + zlib.compress(shown) + b"\nendstream endobj"
    assert files.plain_text(plain) == files.plain_text(packed) == "Hello (PDF) w\u00f6rld\nsecond line\nABC"
    assert files.plain_text("pl\u00e4in".encode()) == "pl\u00e4in"
    for none in (b"%PDF-1.4\n", b"%PDF-1.4\n1 0 obj << /Filter /FlateDecode >>\nstream\nbroken\nendstream", b"%PDF" + b"<<" * 50_000):
        with pytest.raises(ValueError):
            files.plain_text(none)


def test_pages_until_enough_distinct_papers(spark, tmp_path):
    for n, paper in enumerate((1, 1, 2, 2, 3, 4)):
        (tmp_path / f"page{n}.xml").write_text(FEED.format(n=paper, url="u"))
    url = f"file://{tmp_path}/page{{start}}.xml"
    cfg = Download(target_count=3, results_per_request=1, retries=0, pause=0)
    assert [r.arxiv_id for r in download.listed(spark, url, cfg).collect()] == ["3v1", "2v1", "1v1"]
    assert download.listed(spark, url, Download(target_count=9, results_per_request=1, retries=0, pause=0)).count() == 4


def test_files_are_fetched_once_and_failures_left_out(spark, tmp_path):
    for n in (1, 2):
        (tmp_path / f"page{n - 1}.xml").write_text(FEED.format(n=n, url=f"file://{tmp_path}/remote{n}.pdf"))
    (tmp_path / "remote1.pdf").write_bytes(b"one")
    cfg = Download(raw_pdf_dir=f"{tmp_path}/pdf", metadata_path=f"{tmp_path}/meta", target_count=2, results_per_request=1, retries=0, pause=0)
    url = f"file://{tmp_path}/page{{start}}.xml"
    assert download.download(spark, url, cfg) == 1 and (tmp_path / "pdf" / "1v1.pdf").read_bytes() == b"one"
    (tmp_path / "remote1.pdf").write_bytes(b"changed")
    (tmp_path / "remote2.pdf").write_bytes(b"two")
    assert download.download(spark, url, cfg) == 2 and (tmp_path / "pdf" / "1v1.pdf").read_bytes() == b"one"


def test_choices(spark):
    rows = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3), (None, 1)], "k string, n int")
    assert sorted((r.k or "", r.n) for r in ingest.first_of_each(rows, ["k"], "n").collect()) == [("", 1), ("a", 1), ("b", 3)]
    assert [r.k for r in ingest.not_done(rows, spark.createDataFrame([("a",)], "k string"), "k").orderBy("n").collect()] == [None, "b"]


def test_statistics(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (100,), (None,)], "x int")
    assert tuple(eda.summary(df, "x").first()) == (2.0, 26.0, 1, 100)
    assert {r["bin"]: r.n for r in eda.histogram(df, "x", 10).collect()} == {0: 3, 9: 1}
    assert {r["bin"]: r.n for r in eda.histogram(df.filter("x = 2"), "x").collect()} == {0: 1}
    assert eda.histogram(df.filter("x > 500"), "x").collect() == []
    curve = eda.density(df, "x", 50).orderBy("x").collect()
    assert len(curve) == 50 and [curve[0].x, curve[-1].x] == pytest.approx([1, 100]) and max(curve, key=lambda r: r.density).x < 40
    assert eda.density(df.filter("x = 2"), "x").collect() == eda.density(df.filter("x > 500"), "x").collect() == []
    words = spark.createDataFrame([("The cat the Cat 5",), ("",)], "t string")
    assert {r.value: r.n for r in eda.word_frequencies(words, "t").collect()} == {"cat": 1, "Cat": 1, "": 1}
    assert [r.value for r in eda.top(eda.word_frequencies(words, "t"), 2).collect()] == ["", "Cat"]


def test_whole_pipeline(spark, tmp_path):
    for n in (1, 2):
        (tmp_path / f"remote{n}.pdf").write_text(f"Paper {n} tells of topic{n}. " + "It says more. " * 60)
        (tmp_path / f"page{n - 1}.xml").write_text(FEED.format(n=n, url=f"file://{tmp_path}/remote{n}.pdf"))
    cfg = Config(
        download=Download(raw_pdf_dir=f"{tmp_path}/pdf", processed_json_dir=f"{tmp_path}/json", metadata_path=f"{tmp_path}/meta", target_count=3, results_per_request=1, retries=0, pause=0),
        chunking=Chunking(output_dir=f"{tmp_path}/chunks"),
        embedding=Embedding(output_path=f"{tmp_path}/embedded", dimension=64),
        index=Index(path=f"{tmp_path}/index", vector_size=64),
    )
    service = Service(spark, cfg)
    done = run_pipeline(service, f"file://{tmp_path}/page{{start}}.xml")
    assert [(r.stage, r.count) for r in done] == [("download", 2), ("parse", 2), ("chunk", 4), ("embed", 4), ("index", 4)]
    assert service.parse().count == 0
    answer = service.ask("what tells of topic2", top_k=1).first()
    assert answer.answer == "Paper 2 tells of topic2."


def test_streaming_takes_each_file_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for n in range(3):
        (source / f"{n}.json").write_text(json.dumps({"arxiv_id": str(n), "title": "t", "full_text": "some text"}))
        ingest_new(spark, str(source), str(tmp_path / "out"), str(tmp_path / "state"))
        assert spark.read.parquet(str(tmp_path / "out")).select(F.count_distinct("id")).first()[0] == n + 1
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
