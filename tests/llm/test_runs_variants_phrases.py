"""Periodic runs, spelling variants and phrase fingerprints against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import phrases, runs, spelling

WORD = re.compile(r"[^ \t-\r]+")


def plain_runs(x, times=4, least=6):
    out = []
    for q in range(1, len(x) // times + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(least, times * q) and not any(all(x[k] == x[k + p] for k in range(s, e - p)) for p in range(1, q)):
                out.append((s, e - s, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(draw):
    out = []
    for _ in range(draw.randint(1, 7)):
        kind = draw.random()
        if kind < 0.5:
            out += ([draw.randint(0, 3) for _ in range(draw.randint(1, 6))] * draw.randint(1, 9))[: draw.randint(1, 60)]
        elif kind < 0.7:
            unit = [draw.randint(0, 30) for _ in range(draw.randint(10, 40))]
            out += unit * draw.randint(3, 6) + unit[: draw.randint(0, 5)]
        else:
            out += [draw.randint(0, 9) for _ in range(draw.randint(1, 40))]
    return out


@pytest.mark.parametrize("long", [4096, 8, 16])
def test_runs_whole_and_sampled(long, monkeypatch):
    monkeypatch.setattr(runs, "LONG", long)
    draw = random.Random(long)
    for _ in range(60):
        x = repetitive(draw)
        for times, least in ((4, 6), (2, 2), (3, 5)):
            assert list(map(tuple, runs.find(np.array(x, np.uint32), times, least).tolist())) == plain_runs(x, times, least)
    assert runs.find(np.zeros(0, np.uint32)).shape == (0, 3)
    with pytest.raises(ValueError):
        runs.find(np.zeros(3, np.uint32), 1)


def test_long_text_has_its_runs():
    x = np.random.default_rng(1).integers(0, 3000, 60_000).astype(np.uint32)
    x[20_000:50_000] = np.resize(x[20_000:27_000], 30_000)
    x[55_000:55_100] = 7
    got = runs.find(x)
    assert [list(r[:1]) + [r[2]] for r in got.tolist() if r[1] > 50] == [[20_000, 7000], [55_000, 1]] and abs(got[0][1] - 30_000) < 5


def plain_digest(doc, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc).encode())
    if doc is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in found), " ".join(x for i, x in enumerate(w) if i not in gone))]
    return (doc, len(found), *best, 1000 * best[1] // best[2] if found else None, *sha, len(w))


def test_run_digests(crowded, corpus):
    short = [(d, t) for d, t, _ in corpus if len(t or "") < 6000]
    ids = [d for d, _ in short]
    got = [tuple(r) for r in runs.digest(runs.periodic_runs(runs.with_repeats(crowded.filter(F.coalesce(F.length("text"), F.lit(0)) < 6000)))).collect()]
    assert Counter(got) == Counter(plain_digest(*r) for r in short) and len(ids) == len(got)
    assert any(r[1] for r in got)


def test_edited_texts_and_collapsed_ones(spark, nothing):
    rows = [(k, " ".join(f"w{(k * 31 + i * i) % 97}" for i in range(10 + k % 50))) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: tuple(r) for r in runs.digest(runs.periodic_runs(runs.with_repeats(df))).collect()}
    assert all(got[k] == plain_digest(k, t) for k, t in rows)
    assert sum(zlib.crc32(str(k).encode()) % 10 == 0 for k in range(300)) > 10
    one = spark.createDataFrame([(1, "a b a b a b a b\tc c c c c c", "x"), (2, None, "x"), (3, " \n", "x")], "doc_id long, text string, runs string")
    found = {r.doc_id: r for r in runs.periodic_runs(one).collect()}
    assert [tuple(x) for x in found[1].runs] == [(0, 8, 2), (8, 6, 1)] and found[1].collapsed == "a b c"
    assert (found[2].runs, found[2].collapsed, found[3].n_words) == ([], "", 0)
    assert runs.digest(runs.periodic_runs(runs.with_repeats(nothing))).collect() == []
    with pytest.raises(ValueError):
        runs.periodic_runs(one, ("doc_id", "runs"))


def one_apart(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    u, v = sorted((u, v), key=len)
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def test_automata_find_each_near_word_once():
    draw = random.Random(3)
    for _ in range(60):
        words = sorted({bytes(draw.choice(b"abc") for _ in range(draw.randint(1, 6))) for _ in range(draw.randint(0, 60))})
        back = sorted(w[::-1] for w in words)
        ahead, behind = spelling.Automaton(words), spelling.Automaton(back)
        assert [ahead.number(w) for w in words] == list(range(len(words))) and ahead.number(b"zz") is None
        for u in words:
            cuts = sorted({0, len(u), *(draw.randint(0, len(u)) for _ in range(3))})
            got = []
            for a, b in zip(cuts, cuts[1:]):
                if draw.random() < 0.5:
                    got += [words[k] for k in ahead.one_error(u, a, b)]
                else:
                    got += [back[k][::-1] for k in behind.one_error(u[::-1], len(u) - b, len(u) - a, False)]
            assert sorted(got) == [v for v in words if one_apart(u, v)]


def plain_variants(rows, damaged):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = 1 if doc is None else zlib.crc32(f"{doc}:{run}".encode())
            at = h % len(run)
            n[run[:at] + run[at + 1 :] if damaged and h % damaged == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {w: max(sorted(v), key=n.get) for w, v in near.items() if v}
    form = {w: v for w, v in form.items() if n[v] >= 2 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return Counter(out)


@pytest.fixture(scope="module")
def spelled():
    draw = random.Random(5)
    base = ["".join(draw.choice("abcdéàx") for _ in range(draw.randint(5, 11))) for _ in range(60)] + ["Ébaab", "ÀÀÀÀÀÀ", "straße"]
    rows = []
    for k in range(250):
        some = []
        for _ in range(draw.randint(5, 90)):
            w = base[min(int(draw.expovariate(0.06)), len(base) - 1)]
            if draw.random() < 0.25:
                at = draw.randrange(len(w) + 1)
                w = draw.choice([w[:at] + w[at + 1 :], w[:at] + draw.choice("ab") + w[at:], w[:at] + draw.choice("ab") + w[at + 1 :]])
            some.append(w.upper() if draw.random() < 0.1 and w.isascii() else w)
        rows.append((k, draw.choice([" ", ", ", "1", "Ω"]).join(some)))
    return rows + [(None, "straße straße straße strase"), (7, None), (8, ""), (None, "longword " * 40 + "longwora " * 15 + "longwera " * 4), rows[3], rows[3]]


@pytest.mark.parametrize("hot", [30_000, 6])
def test_variants(spark, spelled, hot, monkeypatch):
    """As many large groups as there can be give the same words."""
    monkeypatch.setattr(spelling, "BUCKET", 500)
    df = spark.createDataFrame([(d, t, 5, "x") for d, t in spelled], "doc_id long, text string, n long, word string").repartition(3)
    monkeypatch.setattr(spelling.near_words, "__defaults__", (2, hot))
    got = Counter(tuple(r) for r in spelling.variants(df, 11).collect())
    assert got == plain_variants(spelled, 11)
    assert sum(r[1] is not None for r in got) > 20 and any(r[1] not in (None, r[2]) for r in got)


def test_variants_of_nothing(spark, nothing):
    assert spelling.variants(nothing, 97).collect() == []
    nulls = spark.createDataFrame([(1, None), (None, "!? 12")], "doc_id long, text string")
    assert spelling.variants(nulls, 97).collect() == []
    alone = spark.createDataFrame([("a" * 3000, 4), ("a" * 2999, 9), ("ab", 3)], "word string, n long")
    assert {(len(r.word), r.n_near, len(r.form or "")) for r in spelling.near_words(alone).collect()} == {(3000, 1, 2999), (2999, 1, 0), (2, 0, 0)}


def lz(text):
    seen, a = set(), 0
    for b in range(1, len(text) + 1):
        if text[a:b] not in seen:
            seen.add(text[a:b])
            a = b
    return seen


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_parse_gives_the_shortest_new_phrases():
    draw, parser = random.Random(4), phrases.Parser()
    for _ in range(500):
        text = "".join(draw.choice("abé") for _ in range(draw.randint(0, 40)))
        ends, root = [], {}
        parser._parse(text, 0, (root, None), root, ends, [])
        assert {text[i:j] for i, j in zip([0, *ends], ends)} == lz(text)


@pytest.mark.parametrize("span", [2**22, 7])
def test_common_start_is_parsed_once(span, monkeypatch):
    monkeypatch.setattr(phrases, "SPAN", span)
    draw, parser = random.Random(6), phrases.Parser()
    for _ in range(300):
        a, b = ("".join(draw.choice("ab😀") for _ in range(draw.randint(0, 30))) for _ in range(2))
        place = len(a) - len(a) // 2
        one, other = parser.sign_both(a, place, b[: len(a) // 2])
        assert (one == parser.sign(a)).all() and (other == parser.sign(a[:place] + b[: len(a) // 2])).all()


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))


@pytest.mark.parametrize("part", [16_000_000, 4_000])
def test_beside_next(crowded, corpus, part, monkeypatch):
    """Each text beside the next and its edit, in one range or many; likeness is near that of the sets of phrases."""
    monkeypatch.setattr(phrases, "PART", part)
    got = phrases.beside_next(crowded).collect()
    assert len(got) == len(corpus)
    rows = [(d, t or "") for d, t, _ in corpus]
    sure = [d for d, k in Counter(d for d, _ in rows).items() if k == 1 and d is not None]
    line = in_order(rows)
    shas, errors = {r.doc_id: r for r in got}, []
    for (d, t), (_, after) in zip(line, [*line[1:], line[0]]):
        if d not in sure or line[(line.index((d, t)) + 1) % len(line)][0] not in sure:
            continue
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = shas[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == phrases.written(phrases.Parser().sign(t)) and r.edited_fingerprint == phrases.written(phrases.Parser().sign(edited))
        errors += [r.near_edited - jaccard(lz(t), lz(edited)), r.near_next - jaccard(lz(t), lz(after))]
    assert len(errors) > 50 and np.abs(errors).max() < 0.2 and abs(np.mean(errors)) < 0.03
    by_text = {}
    for r in got:
        by_text.setdefault(r.fingerprint, set()).add(r.n_chars)
    assert len(got) == sum(Counter(r.doc_id for r in got).values())


def test_ranges_do_not_change_the_result(docs, monkeypatch):
    want = Counter(map(tuple, phrases.beside_next(docs).collect()))
    for part in (300, 20_000):
        monkeypatch.setattr(phrases, "PART", part)
        assert Counter(map(tuple, phrases.beside_next(docs).collect())) == want


def test_order_of_nulls_repeats_and_a_single_row(spark, nothing):
    assert phrases.beside_next(nothing).collect() == []
    one = phrases.beside_next(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.near_edited < 1, r.near_next) for r in one] == [(5, True, 1.0)]
    assert one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    rows = [(None, "null at the end"), (9, None), (7, "same same"), (7, "same same"), (3, "xyz" * 9)]
    got = phrases.beside_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert Counter((r.doc_id, r.edited_sha256) for r in got) == Counter([(9, sha("")), (7, sha("same same"[:5] + "same")), (7, sha("same xyzx")), (3, sha("xyz" * 9)[:0] + sha(("xyz" * 9)[:14] + "null at the e")), (None, sha("null at "))])
    empty = next(r for r in got if r.doc_id == 9)
    assert empty.n_chars == 0 and empty.near_edited == 1.0 and empty.near_next == 0.0 and set(empty.fingerprint) == {"f"}


def test_fingerprints_and_likeness(spark, crowded, corpus):
    found = phrases.fingerprints(crowded.select("doc_id", "text", "source"), ("doc_id", "source"))
    assert found.columns == ["doc_id", "source", "n_chars", "fingerprint"]
    by_id = {r.doc_id: r for r in found.collect()}
    by_text = {}
    for d, t, _ in corpus:
        by_text.setdefault(t or "", set()).add(by_id[d].fingerprint if Counter(x for x, _, _ in corpus)[d] == 1 else None)
    assert all(len(x - {None}) <= 1 for x in by_text.values())
    pairs = [(a.fingerprint, b.fingerprint) for a in list(by_id.values())[:12] for b in list(by_id.values())[:12]]
    sign = lambda x: np.frombuffer(bytes.fromhex(x), ">u4").astype(np.uint32)
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", phrases.likeness("a", "b").alias("x")).collect()
    assert all(r.x == pytest.approx(phrases.alike(sign(r.a), sign(r.b))) for r in rows)
    assert all(r.x == 1.0 for r in rows if r.a == r.b)
    with pytest.raises(ValueError):
        phrases.fingerprints(spark.createDataFrame([(1, "x", 3)], "doc_id long, text string, n_chars long"), ("doc_id", "n_chars"))
