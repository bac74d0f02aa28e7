"""A paged Atom feed of papers: parsing saved feeds, and a data source that reads pages, as a table with filters pushed down or as a stream."""

from __future__ import annotations

import time
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition

from corvane.functions.text import last_segment, strip

ENTRY = "struct<id: string, title: string, summary: string, published: string, author: array<struct<name: string>>, link: array<struct<_href: string, _title: string, _type: string>>>"
SCHEMA = "arxiv_id string, title string, abstract string, authors array<string>, pdf_url string, submitted timestamp, category string"
NAMESPACE = {"a": "http://www.w3.org/2005/Atom", "search": "http://a9.com/-/spec/opensearch/1.1/"}


def parse_feeds(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """(arxiv_id, title, abstract, authors) of each entry of saved feeds, one document a row."""
    parsed = feeds.select(F.from_xml(F.col(xml), f"entry array<{ENTRY}>").alias("feed"))
    entry = parsed.select(F.explode("feed.entry").alias("e"))
    authors = F.coalesce(F.transform("e.author", lambda a: a["name"]), F.array().cast("array<string>"))
    return entry.select(last_segment("e.id").alias("arxiv_id"), strip("e.title").alias("title"), strip("e.summary").alias("abstract"), authors.alias("authors"))


def query_url(base: str, category: str | None, since: str | None, start: int, count: int, order: str = "descending") -> str:
    """The address of a page, the newest submissions first unless the order is ascending."""
    # The terms of the search interface.
    terms = [f"cat:{category}"] * (category is not None) + [f"submittedDate:[{since} TO 999912312359]"] * (since is not None)
    query = urllib.parse.quote(" AND ".join(terms))
    return f"{base}?search_query={query}&start={start}&max_results={count}&sortBy=submittedDate&sortOrder={order}"


def fetch(url: str, timeout: float = 30.0, retries: int = 5, wait: float = 5.0) -> bytes:
    """Reads an address, again after a while if that fails, but not forever."""
    for left in range(retries, -1, -1):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as response:
                return response.read()
        except OSError:
            if not left:
                raise
            time.sleep(wait)
    raise AssertionError


def entries(xml: bytes) -> Iterator[tuple]:
    """Rows of SCHEMA from a page; entries without an id are skipped."""
    for e in ElementTree.fromstring(xml).iterfind("a:entry", NAMESPACE):
        url = (e.findtext("a:id", "", NAMESPACE)).strip()
        if not url:
            continue
        links = {link.get("title"): link.get("href") for link in e.iterfind("a:link", NAMESPACE)}
        published = e.findtext("a:published", None, NAMESPACE)
        category = e.find("a:category", NAMESPACE)
        yield (
            url.rsplit("/", 1)[-1],
            e.findtext("a:title", "", NAMESPACE).strip(),
            e.findtext("a:summary", "", NAMESPACE).strip(),
            [n.text or "" for n in e.iterfind("a:author/a:name", NAMESPACE)],
            links.get("pdf") or url.replace("/abs/", "/pdf/"),
            datetime.fromisoformat(published.replace("Z", "+00:00")) if published else None,
            category.get("term") if category is not None else None,
        )


@dataclass
class Page(InputPartition):
    start: int
    count: int


class AtomReader(DataSourceReader):
    """A page for each partition, from ``start`` on. Equality on category and a lower bound on submitted go into the query."""

    def __init__(self, options: dict[str, str]) -> None:
        self.base = options["path"] if "path" in options else options["url"]
        self.first, self.total, self.size = int(options.get("start", 0)), int(options.get("target_count", 10)), int(options.get("results_per_request", 5))
        self.timeout, self.retries, self.wait = float(options.get("timeout", 30)), int(options.get("retries", 5)), float(options.get("retry_wait", 5))
        self.category, self.since = options.get("category"), options.get("start_date")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("category",):
                self.category = f.value
            elif isinstance(f, GreaterThanOrEqual) and f.attribute == ("submitted",):
                self.since = f.value.strftime("%Y%m%d%H%M")
            yield f  # the server's answer is checked again: it may go by other categories or whole minutes

    def partitions(self) -> list[Page]:
        return [Page(self.first + at, min(self.size, self.total - at)) for at in range(0, self.total, self.size)]

    def read(self, page: Page) -> Iterator[tuple]:
        if "{start}" in self.base:  # saved pages
            url = self.base.format(start=page.start)
        else:
            url = query_url(self.base, self.category, self.since, page.start, page.count)
        try:
            xml = fetch(url, self.timeout, self.retries, self.wait)
        except OSError:
            if "{start}" in self.base:
                return  # there are fewer saved pages
            raise
        yield from entries(xml)


@dataclass
class Lane(InputPartition):
    """Pages that one task fetches one after another, and how long it waits before the first and after each."""

    pages: tuple[Page, ...]
    first: float
    every: float


class AtomStreamReader(DataSourceStreamReader):
    """The feed from the oldest submission on; an offset is the number of entries before it.

    Ordered that way new papers come last, so places of those before stay, and a query that goes on from its checkpoint
    asks for no page of finished batches. Pages of a batch are dealt over ``parallel`` lanes, each of which begins a request
    no sooner than ``parallel`` times the pause after its last, so all tasks together begin one a pause.
    A feed that puts a paper among older ones gives its neighbour twice; ``stream_feed`` drops such repetitions.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.asked = AtomReader(options)
        if "{start}" in self.asked.base:
            raise ValueError("saved pages are read as a table; a stream needs an address that tells how many entries there are")
        self.pause, self.parallel = float(options.get("pause", 1)), max(1, int(options.get("parallel", 1)))

    def _page(self, page: Page) -> bytes:
        a = self.asked
        return fetch(query_url(a.base, a.category, a.since, page.start, page.count, "ascending"), a.timeout, a.retries, a.wait)

    def initialOffset(self) -> dict:
        return {"start": self.asked.first}

    def latestOffset(self) -> dict:
        total = ElementTree.fromstring(self._page(Page(0, 1))).findtext("search:totalResults", None, NAMESPACE)
        if total is None:
            raise ValueError("the feed doesn't tell how many entries there are")
        return {"start": max(self.asked.first, int(total))}

    def partitions(self, start: dict, end: dict) -> list[Lane]:
        size = self.asked.size
        pages = [Page(at, min(size, end["start"] - at)) for at in range(start["start"], end["start"], size)]
        lanes = min(self.parallel, len(pages))
        return [Lane(tuple(pages[k::lanes]), k * self.pause, lanes * self.pause) for k in range(lanes)]

    def read(self, lane: Lane) -> Iterator[tuple]:
        after = time.monotonic() + lane.first
        for page in lane.pages:
            time.sleep(max(0.0, after - time.monotonic()))
            after = time.monotonic() + lane.every
            found = list(entries(self._page(page)))
            if len(found) < page.count:  # the batch would be taken for complete
                raise OSError(f"{len(found)} entries instead of {page.count} from {page.start} on")
            yield from found

    def commit(self, end: dict) -> None:
        """Nothing is held back for batches that aren't finished."""


class AtomSource(DataSource):
    """``spark.read.format("atom").option("url", ...).load()``: an address to query, or one with {start} for saved pages.

    ``readStream`` takes addresses to query, with the options pause and parallel.
    """

    @classmethod
    def name(cls) -> str:
        return "atom"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> AtomReader:
        return AtomReader(dict(self.options))

    def streamReader(self, schema) -> AtomStreamReader:
        return AtomStreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(AtomSource)
