import random
import time
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import html, neighbours


def brute(rows, queries, k):
    out = {}
    for q in queries:
        d = sorted((float(np.sqrt(((np.array(rows[q]) - np.array(v)) ** 2).sum())), i) for i, v in rows.items() if i != q)
        out[q] = d[:k]
    return out


@pytest.fixture(scope="module")
def vectors():
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(6, 12))
    rows = {k: (centres[k % 6] + 0.3 * draw.normal(size=12)).tolist() for k in range(1500)}
    rows |= {k: rows[7] for k in range(2000, 2600)}  # a very common vector
    return rows


def test_recall_and_exact_scores(spark, vectors):
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").selectExpr("*", "1 AS tree", "2 AS leaf", "3 AS vector", "4 AS query_id")
    found = {}
    for r in neighbours.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
    want = brute(vectors, [q for q in vectors if q % 100 == 0], 10)
    assert set(found) == set(want)
    hits = sum(len({i for _, i in found[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, rows in found.items():
        assert rows == sorted(rows) and len({i for _, i in rows}) == 10
        for d, i in rows:
            assert d == float(np.sqrt(((np.array(vectors[q]) - np.array(vectors[i])) ** 2).sum()))
    assert [i for _, i in found[2000]] == [7, *range(2001, 2010)]


def test_salted_leaves_and_repeated_rows(spark, vectors, monkeypatch):
    """Leaves and queries split among tasks, every row three times, an id with two vectors."""
    monkeypatch.setattr(neighbours, "SALT", 40)
    monkeypatch.setattr(neighbours, "QUERY_SALT", 3)
    rows = [*vectors.items()] * 3 + [(1, vectors[200])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {}
    for r in neighbours.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    want = brute(vectors, [q for q in vectors if q % 100 == 0], 10)
    assert all(len(x) == len(set(x)) == 10 for x in found.values()) and set(found) == set(want)
    assert sum(len(set(found[q]) & {i for _, i in want[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))
    assert found[200][0] == 1


def test_one_vector_only(spark):
    df = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(500)], "vec_id long, embedding array<double>")
    found = neighbours.search(df, F.col("vec_id") == 100).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(k, 0.0) for k in range(10)]


def test_nearest_is_exact_where_rounding_is_large():
    draw = np.random.default_rng(3)
    x = 1e6 + draw.normal(size=(400, 8)) * 1e-3
    q, ids = x[:5] + 1e-4, np.arange(400) // 2
    query, found, d = neighbours.nearest(np.array([900, 901, 902, 0, 1]), q, ids, x, 7)
    for j, n in enumerate((900, 901, 902, 0, 1)):
        all_d = np.sqrt(((q[j] - x) ** 2).sum(1))
        best = sorted((min(all_d[ids == i]), i) for i in set(ids.tolist()) if i != n)[:7]
        assert list(zip(d[query == n], found[query == n])) == best


def test_few_odd_and_repeated_rows(spark):
    bad = [None, [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0]]
    rows = [(k, v) for k, v in enumerate(bad)] + [(100, [1.0, 0.0]), (100, [1.0, 0.0]), (101, [0.0, 1.0]), (200, [1.0, 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = [(r.query_id, r["rank"], r.vec_id) for r in neighbours.search(df, F.col("vec_id") % 100 == 0).collect()]
    assert sorted(found) == [(100, 1, 200), (100, 2, 101), (200, 1, 100), (200, 2, 101)]
    assert neighbours.search(df.filter("false"), F.lit(True)).collect() == []
    assert neighbours.search(df, F.lit(False)).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no";</script></head><body class="menu">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home of all things</a></li><li><a href="/b">News, and more news.</a></li></ul></nav>
<div class="cookie-notice">We use cookies, as everyone does. Accept them, please.</div><!-- <p>hidden</p> -->
{body}
<aside class="sidebar"><p>A sidebar that is quite long, with commas, and full stops. It goes on.</p></aside>
<div id="comments"><p>First! A reader comments at length, with, many, commas. Really.</p></div>
<form><p>Subscribe now to our letter, it is free.</p><input name="x"></form><footer><p>Copyright, all rights reserved.</p></footer></body></html>"""
LONG = "This is the first paragraph, which is long; it says much. And it goes on, as texts do."


@pytest.mark.parametrize(
    "body,want",
    [
        (f"<article><h1>Head</h1><p>{LONG}</p><p>Short.</p></article>", f"Head\n{LONG}\nShort."),
        (f"<div class=post><h2>A &amp; B</h2><p><b>{LONG}<br><p>two\n  lines&nbsp;here</p></div>", f"A & B\n{LONG}\ntwo lines here"),
        (f"<main><p>{LONG}</p><div class='ad'>Buy this, now.</div><ul><li>one</li><li>two</li></ul><p>{LONG} <a href=x>link</a></p></main>", f"{LONG}\none\ntwo\n{LONG} link"),
        (f"<article><p>{LONG} 1 < 2 &lt;3&gt;</p><p>a<b>b</b>c <script>x()</script>d</p></article>", f"{LONG} 1 < 2 <3>\nabc d"),
        (f"<ARTICLE><P>{LONG}<P style='display:none'>unseen<P>{LONG}</ARTICLE>", f"{LONG}\n{LONG}"),
        ("", ""),
    ],
)
def test_main_text(body, want):
    assert html.extract(PAGE.format(body=body)) == want


ROWS = "".join(f"<tr><td>{LONG} {k}</td></tr>" for k in range(8))


@pytest.mark.parametrize(
    "body,want",
    [
        (f"<article><h1>Title</h1><p>lead</p><div class=entry>{f'<p>{LONG}</p>' * 9}</div></article>", ["Title", "lead", *[LONG] * 9]),
        (f"<div><section><h2>A</h2><p>{LONG}</p></section><section><h2>B</h2>{f'<p>{LONG}</p>' * 8}</section></div>", ["A", LONG, "B", *[LONG] * 8]),
        (f"<div><p>Before.</p><table>{ROWS}</table><p>After.</p></div>", ["Before.", *[f"{LONG} {k}" for k in range(8)], "After."]),
        (f"<div><p>Before.</p><ul>{f'<li>{LONG}</li>' * 8}</ul><p>After.</p></div>", ["Before.", *[LONG] * 8, "After."]),
        (f"<p>{LONG}</p><article>{f'<p>{LONG}</p>' * 9}</article>", [LONG] * 10),
    ],
)
def test_no_main_text_is_left(body, want):
    assert html.extract(PAGE.format(body=body)).split("\n") == want


@pytest.mark.parametrize("page,want", [(None, ""), ("", ""), ("<p", "<p"), ("<nav>a</nav>", ""), ("just text", "just text"), ("<p>a</p></div></p><p>b", "a\nb"), ("<div>" * 3000 + "deep", "deep"), ("<a title=\"x>" * 50 + "end", "")])
def test_odd_pages(page, want):
    assert html.extract(page) == want


def test_pages_table(spark):
    df = spark.createDataFrame([(1, "u", "<p>é</p>", "old"), (1, "u", "<p>é</p>", "old"), (2, None, None, None)], "page_id long, url string, html string, text string")
    rows = [tuple(r) for r in html.main_text(df).orderBy("page_id").collect()]
    assert rows == [(1, "u", "é", 1), (1, "u", "é", 1), (2, None, "", 0)]
    assert html.main_text(df.filter("false")).collect() == []


def test_long_page():
    body = "".join(f"<p>{LONG} {k}</p>" for k in range(3000))
    assert html.extract(PAGE.format(body=f"<article>{body}</article>")).count("\n") == 2999


@pytest.mark.parametrize(
    "body,want",
    [
        # names are no veto: on lines only whole names count, and a body of text under such a name stays
        (f"<article><p class='header-note'>{LONG}</p><p>{LONG}</p><p class='ad-free'>{LONG}</p></article>", [LONG] * 3),
        (f"<div class='widget'>{f'<p>{LONG} {LONG} {LONG} {LONG}</p>' * 9}</div>", [f"{LONG} {LONG} {LONG} {LONG}"] * 9),
        # what no name tells apart goes by its ratios
        (f"<article>{f'<p>{LONG}</p>' * 5}<div>Copyright.</div><ul><li><a href=1>Related one.</a></li><li><a href=2>Related two.</a></li></ul></article>", [LONG] * 5),
        (f"<article><header><h1>Head</h1><p class=meta>By us.</p></header><section><h2>One</h2><p>{LONG}</p></section><div><p>Short.</p></div><p>{LONG}</p></article>", ["Head", "By us.", "One", LONG, "Short.", LONG]),
        (f"<div id=wrap><article>{f'<p>{LONG}</p>' * 5}</article><div>All rights reserved</div></div>", [LONG] * 5),
    ],
)
def test_ratios_decide(body, want):
    assert html.extract(f"<html><body><nav><a href=1>Home</a></nav>{body}<footer>Copyright, 2020.</footer></body></html>").split("\n") == want


def test_threshold_and_unseen_text(monkeypatch):
    page = PAGE.format(body=f"<article><h1>Head</h1><p>{LONG}</p></article>")
    some = html.extract(page)
    monkeypatch.setattr(html, "SHARE", -1.0)
    monkeypatch.setattr(html, "FLOOR", -1.0)
    whole = html.extract(page)
    assert some == f"Head\n{LONG}" and "sidebar" in whole and "Home of" not in whole and "var a" not in whole and "hidden" not in whole


@pytest.mark.parametrize("piece", ["<div>", "<a ", "<!", "<!--", '<a title="x>', "<a '\">", "</div>", "<div></p>", '<p class="a b">x', "<p>x</p>", "<a b=\"'>", "&amp;", "<b hidden>"])
def test_hostile_pages_take_linear_time(piece):
    began = time.perf_counter()
    html.extract(piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - began < 5


class Tree(HTMLParser):
    """Well-formed pages: (path of (tag, class, beside), text, link text) of each block."""

    def __init__(self):
        super().__init__()
        self.path, self.found, self.parts, self.linked, self.link, self.skip = (), [], [], 0, 0, 0

    def flush(self):
        t = " ".join("".join(self.parts).split())
        if t:
            self.found.append((self.path, t, min(self.linked, len(t))))
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title"):
            self.skip += 1
        if tag == "a":
            self.link = 1
        if tag in html.INLINE or tag in html.VOID or self.skip:
            return
        self.flush()
        name = dict(attrs).get("class", "")
        up = bool(self.path) and self.path[-1][2]
        self.path += ((tag, name, up or tag in html.AROUND or tag not in html.WHOLE and name in html.NAMES),)

    def handle_endtag(self, tag):
        if tag in ("script", "style", "title"):
            self.skip -= 1
            return
        if tag == "a":
            self.link = 0
        if tag in html.INLINE or self.skip:
            return
        self.flush()
        self.path = self.path[:-1]

    def handle_data(self, data):
        if not self.skip and "head" not in [x[0] for x in self.path]:
            self.parts.append(data)
            self.linked += len(data.strip()) * self.link


def plain_extract(page):
    tree = Tree()
    tree.feed(page)
    tree.close()
    found = tree.found
    by = {p: [(t, n) for q, t, n in found if q == p] for p, _, _ in found}
    length = lambda texts: sum(map(len, texts)) / len(texts)
    marks = lambda texts: sum(c in html.MARKS for t in texts for c in t) / len(texts)
    own = {p: [t for t, _ in x] for p, x in by.items()}
    seen_length, seen_marks = (html.smoothed([f(own[p]) for p, _, _ in found]) for f in (length, marks))

    def held(p):
        """Texts of the article that the path is a part of, or else the next element that is no part itself."""
        if p[-1][0] in html.PARTS:
            mains = [k for k, x in enumerate(p) if x[0] in ("article", "main")]
            p = p[: mains[-1] + 1] if mains else p
        while p and p[-1][0] in html.PARTS:
            p = p[:-1]
        out = []
        for q, t, _ in found:
            below = [x[0] for x in q[len(p) :]]
            if q[: len(p)] == p and not {"article", "main"} & set(below) and (p[-1][0] not in ("html", "body") or set(below) <= html.PARTS):
                out.append(t)
        return out

    value = {}
    for p, x in by.items():
        at = [k for k, f in enumerate(found) if f[0] == p]
        line = np.mean([seen_length[k] * (1 + seen_marks[k]) for k in at])
        around = length(held(p)) * (1 + marks(held(p)))
        value[p] = (line + around) / 2 * (1 - sum(n for _, n in x) / sum(len(t) for t, _ in x)) * (0.1 if p[-1][2] else 1)
    mean = lambda some: sum(value[p] * len(t) for p, t, _ in some) / max(1, sum(len(t) for _, t, _ in some))
    level = 0.25 * max(mean(found), mean([f for f in found if not f[0][-1][2]]))
    good = {p for p in by if value[p] >= level and 2 * sum(n for _, n in by[p]) <= sum(len(t) for t, _ in by[p]) and (not p[-1][2] or value[p] >= 200)}
    return "\n".join(t for p, t, _ in found if p in good)


def test_same_as_the_plain_rule():
    draw = random.Random(9)
    words = "one two, three four. five; six seven eight nine ten".split()
    prose = lambda n: " ".join(draw.choice(words) for _ in range(n))

    def lines():
        kinds = ["<p>{}</p>", "<h2>{}</h2>", "<p><b>{}</b> x &amp; y</p>", "<ul><li>{}</li><li>z</li></ul>", "<p><a href=1>{}</a></p>", "<table><tr><td>{}</td></tr></table>"]
        return "".join(draw.choice(kinds).format(prose(draw.choice([2, 8, 60]))) for _ in range(draw.randint(1, 6)))

    changed = 0
    for _ in range(400):
        parts = [lines() if draw.random() < 0.3 else f"<{t}{draw.choice(['', '', ' class=ad', ' class=entry', ' class=comments'])}>{lines()}</{t}>" for t in draw.choices(["div", "article", "section", "nav", "footer", "aside", "main"], k=draw.randint(1, 6))]
        page = f"<html><head><title>t</title><style>s</style></head><body><div>{''.join(parts[:3])}</div>{''.join(parts[3:])}<script>x</script></body></html>"
        assert html.extract(page) == plain_extract(page), page
        changed += html.extract(page) != "\n".join(b.text for b in html.blocks(page)[0])
    assert changed > 200
