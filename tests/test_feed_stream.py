"""The feed as a stream: each paper once over runs, restarts and repetitions, at one rate for all tasks."""

import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.errors import StreamingQueryException

from corvane.config import Download
from corvane.sources.atom import AtomStreamReader
from corvane.streaming.ingest import ingest_feed

ENTRY = "<entry><id>http://x/abs/{0}</id><title>t{0}</title><summary>s</summary><published>2025-01-01T00:00:00Z</published><author><name>A</name></author><category term='cs.CL'/></entry>"


class Feed:
    """Serves ``ids`` in order, notes what was asked for and when, and fails from place ``broken`` on."""

    def __init__(self):
        self.ids, self.asked, self.broken = [], [], None
        feed = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
                start, count = int(q["start"]), int(q["max_results"])
                feed.asked.append((time.monotonic(), start, count, q["sortOrder"]))
                if feed.broken is not None and start >= feed.broken:
                    return self.send_error(503)
                body = f"<feed xmlns='http://www.w3.org/2005/Atom' xmlns:o='http://a9.com/-/spec/opensearch/1.1/'><o:totalResults>{len(feed.ids)}</o:totalResults>{''.join(map(ENTRY.format, feed.ids[start:start + count]))}</feed>".encode()
                self.send_response(200)
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}/query"

    def pages(self):
        return [a for a in self.asked if a[1:3] != (0, 1)]


@pytest.fixture
def feed():
    made = Feed()
    yield made
    made.server.shutdown()
    made.server.server_close()


def config(**changes):
    return Download(**{"results_per_request": 3, "retries": 0, "retry_wait": 0.0, "pause": 0.0, "parallel": 2} | changes)


def ids(spark, sink):
    return sorted(r.arxiv_id for r in spark.read.parquet(sink).collect())


def test_runs_take_up_where_the_last_one_ended(spark, feed, tmp_path):
    sink, checkpoint = f"{tmp_path}/sink", f"{tmp_path}/checkpoint"
    feed.ids = [f"p{i}" for i in range(7)]
    ingest_feed(spark, feed.url, sink, checkpoint, config())
    assert ids(spark, sink) == sorted(feed.ids) and {a[3] for a in feed.asked} == {"ascending"}
    feed.asked.clear()
    ingest_feed(spark, feed.url, sink, checkpoint, config())
    assert not feed.pages()
    feed.ids += ["p7", "p8", "p2"]  # the last one again
    ingest_feed(spark, feed.url, sink, checkpoint, config())
    assert ids(spark, sink) == sorted({*feed.ids}) and min(a[1] for a in feed.pages()) == 7


def test_a_failed_run_is_taken_up_again(spark, feed, tmp_path):
    sink, checkpoint = f"{tmp_path}/sink", f"{tmp_path}/checkpoint"
    feed.ids, feed.broken = [f"p{i}" for i in range(8)], 6
    with pytest.raises(StreamingQueryException):
        ingest_feed(spark, feed.url, sink, checkpoint, config())
    feed.broken = None
    ingest_feed(spark, feed.url, sink, checkpoint, config())
    assert ids(spark, sink) == sorted(feed.ids)


def test_tasks_share_a_rate(spark, feed, tmp_path):
    feed.ids = [f"p{i}" for i in range(18)]
    ingest_feed(spark, feed.url, f"{tmp_path}/sink", f"{tmp_path}/checkpoint", config(pause=0.5, parallel=3))
    times = sorted(a[0] for a in feed.pages())
    assert len(times) == 6 and times[-1] - times[0] >= 2 * 0.5  # each of three lanes waits three pauses between its two


def test_lanes_and_short_pages(feed):
    reader = AtomStreamReader({"url": feed.url, "results_per_request": "2", "parallel": "2", "pause": "1", "retries": "0"})
    lanes = reader.partitions({"start": 3}, {"start": 10})
    assert [[(p.start, p.count) for p in lane.pages] for lane in lanes] == [[(3, 2), (7, 2)], [(5, 2), (9, 1)]]
    assert [(lane.first, lane.every) for lane in lanes] == [(0.0, 2.0), (1.0, 2.0)] and reader.partitions({"start": 3}, {"start": 3}) == []
    feed.ids = ["a"]
    with pytest.raises(OSError):
        list(reader.read(lanes[0]))
    with pytest.raises(ValueError):
        AtomStreamReader({"url": "file:///x/{start}.xml"})
