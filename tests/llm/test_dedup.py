import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corvane.llm import graph, simhash, substring, suffixes

WORD = re.compile(rb"[^ \t-\r]+")
LAST = 2**63 - 1


def words(text, lower=False):
    data = (text or "").encode()
    return WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in data) if lower else data)


def kept_words(corpus, window):
    least = {}
    for d, t, _ in corpus:
        w = words(t)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(least.get(k, LAST), LAST if d is None else d)
    out = []
    for d, t, _ in corpus:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < (LAST if d is None else d):
                gone[i : i + window] = [True] * window
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("window", [50, 3])
def test_word_windows(docs, corpus, window):
    got = [tuple(r) for r in substring.digest(substring.repeated_word_spans(docs, window)).collect()]
    assert Counter(got) == Counter(kept_words(corpus, window))
    assert any(r[2] for r in got)


def test_many_small_blocks_and_buckets(docs, corpus, monkeypatch):
    monkeypatch.setattr(substring, "BUCKET", 50)
    monkeypatch.setattr(substring, "FLUSH", 300)
    got = [tuple(r) for r in substring.digest(substring.repeated_word_spans(docs, 5)).collect()]
    assert Counter(got) == Counter(kept_words(corpus, 5))


def test_cut_texts(crowded, corpus):
    found = substring.cut(substring.repeated_word_spans(crowded))
    assert found.columns == crowded.columns
    left = defaultdict(list)
    for r in found.collect():
        left[r.doc_id].append(r.text)
    want = {d: (n, gone, sha) for d, n, gone, sha in kept_words(corpus, 50)}
    texts = {d: t for d, t, _ in corpus}
    for d, (n, gone, sha) in want.items():
        if d is None:
            continue
        if n and n == gone:
            assert d not in left
        else:
            assert all(hashlib.sha256(b" ".join(words(t))).hexdigest() == sha for t in left[d])
            assert gone or left[d][0] == texts[d]


def byte_result(corpus, length):
    data = [(d, (t or "").encode()) for d, t, _ in corpus]
    seen = Counter(b[i : i + length] for _, b in data for i in range(len(b) - length + 1))
    out = []
    for d, b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("length,anchor", [(200, 100), (12, 5), (6, 6), (7, 1)])
def test_byte_strings(docs, corpus, length, anchor):
    got = [tuple(r) for r in suffixes.digest(suffixes.repeated_byte_spans(docs, length, anchor)).collect()]
    assert Counter(got) == Counter(byte_result(corpus, length))
    assert any(r[2] for r in got)


def test_bytes_in_small_blocks(docs, corpus, monkeypatch):
    monkeypatch.setattr(suffixes, "FLUSH", 500)
    monkeypatch.setattr(suffixes, "BUCKET", 20)
    got = [tuple(r) for r in suffixes.digest(suffixes.repeated_byte_spans(docs, 30, 12)).collect()]
    assert Counter(got) == Counter(byte_result(corpus, 30))


def test_nothing(nothing, spark):
    assert substring.digest(substring.repeated_word_spans(nothing)).collect() == []
    assert substring.cut(substring.repeated_word_spans(nothing)).collect() == []
    assert suffixes.digest(suffixes.repeated_byte_spans(nothing)).collect() == []
    assert simhash.groups(nothing).collect() == [] and simhash.one_of_each(nothing).collect() == []
    nulls = spark.createDataFrame([(1, None), (None, None)], "doc_id long, text string")
    assert [r.n_removed for r in substring.digest(substring.repeated_word_spans(nulls)).collect()] == [0, 0]
    assert [r.n_bytes for r in suffixes.digest(suffixes.repeated_byte_spans(nulls)).collect()] == [0, 0]
    assert {r.component_id for r in simhash.groups(nulls).collect()} == {1}


def plain_fingerprint(text, width=3):
    w = words(text, lower=True)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + width]), 42) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, near):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= near:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_fingerprints_and_components(docs, corpus):
    fps = [plain_fingerprint(t) for _, t, _ in corpus]
    part = plain_components(fps, 3)
    least = defaultdict(list)
    for p, (d, _, _) in zip(part, corpus):
        least[p] += [d] * (d is not None)
    want = Counter((d, f"{f:016X}", min(least[p], default=None)) for (d, _, _), f, p in zip(corpus, fps, part))
    got = Counter((r.doc_id, r.fp, r.component_id) for r in simhash.groups(docs).withColumn("fp", F.hex("fp")).collect())
    assert got == want


@pytest.mark.parametrize("most,hot", [(20_000, 8_000_000), (6, 8_000_000), (20_000, 2500), (10, 1500)])
def test_dense_fingerprints(spark, monkeypatch, most, hot):
    """Many fingerprints around a few centres, compared whole, in blocks and in cut buckets, with brute force."""
    monkeypatch.setattr(simhash, "MOST", most)
    monkeypatch.setattr(simhash, "HOT", hot)
    draw = np.random.default_rng(3)
    fps = set()
    for c in draw.integers(0, 2**63, 4).tolist():
        for _ in range(60):
            f = c
            for b in draw.integers(0, 64, draw.integers(0, 7)).tolist():
                f ^= 1 << b
            fps.add(f)
    fps = sorted(fps)
    part = plain_components(fps, 3)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    nodes = spark.createDataFrame([(bytearray(f.to_bytes(8, "big")), s) for f, s in zip(fps, signed)], "fp binary, node long")
    links = simhash.links_between(nodes, simhash.EXACT)
    pairs = links.collect()
    assert all(((r.a ^ r.b) % 2**64).bit_count() <= 3 for r in pairs)
    label = {r.node: r.label for r in graph.components(links).collect()}
    groups = defaultdict(set)
    for s, p in zip(signed, part):
        groups[p].add(label.get(s, s))
    assert all(len(g) == 1 for g in groups.values()) and len({x for g in groups.values() for x in g}) == len(groups)


def test_one_of_each(crowded, corpus, docs):
    kept = simhash.one_of_each(crowded)
    assert kept.columns == crowded.columns
    rows = Counter((r.doc_id, r.text) for r in kept.collect())
    assert max(rows.values()) == 1
    by_text = defaultdict(set)
    for d, t, _ in corpus:
        by_text[tuple(words(t, lower=True))].add(d)
    left = defaultdict(set)
    for d, t in rows:
        left[tuple(words(t, lower=True))].add(d)
    assert set(left) < set(by_text) and all(len(x) == 1 for x in left.values())
    # no two that stay are much alike, and who goes is like one that stays, or like one that goes and so on
    sets = {t: {t[i : i + 5] for i in range(max(1, len(t) - 4))} if t else set() for t in by_text}
    alike = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
    assert all(alike(a, b) < 0.85 for a in left for b in left if a != b)
    near, found = set(left), True
    while found:
        found = {t for t in by_text if t not in near and any(alike(t, x) >= 0.8 for x in near)}
        near |= found
    assert near == set(by_text)


def test_spanning_links():
    draw = np.random.default_rng(0)
    for _ in range(200):
        n, m = int(draw.integers(1, 60)), int(draw.integers(0, 120))
        a, b = draw.integers(0, n, m), draw.integers(0, n, m)
        kept, label = simhash.spanning(a, b, n)
        assert (label[a] == label[b]).all()

        def parts(a, b):
            label = list(range(n))
            for x, y in zip(a.tolist(), b.tolist()):
                label = [label[x] if k == label[y] else k for k in label]
            return {frozenset(i for i in range(n) if label[i] == k) for k in label}

        assert parts(a, b) == parts(a[kept], b[kept]) and kept.sum() == n - len(parts(a, b))


def test_components_of_chains_stars_and_loops(spark):
    chain = [(k, k + 1) for k in range(200)]
    star = [(1000, 1000 + k) for k in range(1, 300)]
    df = spark.createDataFrame([*chain, *star, (5000, 5000), (None, 3)], "a long, b long")
    found = {r.node: r.label for r in graph.components(df).collect()}
    assert len({found[k] for k in range(201)}) == 1 and len({found[1000 + k] for k in range(300)}) == 1
    assert found[5000] == 5000 and len(set(found.values())) == 3
    assert graph.components(df.filter("false")).collect() == []


def similar_nodes(spark, fps):
    """Fingerprints of many words, each a row of 0 and 1."""
    raw = np.packbits(fps, axis=1)
    nodes = simhash.node_of(raw.view(">u8").astype(np.uint64)).view(np.int64)
    return spark.createDataFrame([(bytearray(x.tobytes()), n) for x, n in zip(raw, nodes.tolist())], "fp binary, node long"), nodes


def test_hub_does_not_hide_links(spark):
    """A hub is near others in the first word only; those others are near each other in all words."""
    draw = np.random.default_rng(5)
    hub = draw.integers(0, 2, 768).astype(np.uint8)
    fps, want = [hub], set()
    for k in range(40):
        x = hub.copy()
        x[draw.choice(np.arange(16, 64), 6, replace=False)] ^= 1
        x[64:] = draw.integers(0, 2, 704)
        y = x.copy()
        y[draw.choice(np.arange(64, 768), 60, replace=False)] ^= 1
        fps += [x, y]
        want.add((2 * k + 1, 2 * k + 2))
    df, nodes = similar_nodes(spark, np.array(fps))
    at = {n: k for k, n in enumerate(nodes.tolist())}
    assert {tuple(sorted((at[r.a], at[r.b]))) for r in simhash.links_between(df, simhash.SIMILAR).collect()} == want


@pytest.mark.parametrize("size", [3000, 40_000])
def test_pairs_meet_in_a_table_of_any_size(spark, size):
    """Pairs whose bits differ as at a similarity of 0.8, among many other fingerprints."""
    draw = np.random.default_rng(6)
    fps = draw.integers(0, 2, (size, 768)).astype(np.uint8)
    pairs = fps[:1000].copy()
    pairs ^= draw.random(pairs.shape) < 0.151
    df, nodes = similar_nodes(spark, np.concatenate([fps, pairs]))
    want = {tuple(sorted(x)) for x in zip(nodes[:1000].tolist(), nodes[size:].tolist())}
    got = {tuple(sorted((r.a, r.b))) for r in simhash.links_between(df, simhash.SIMILAR).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)


@pytest.fixture(scope="module")
def alike_in_16_bits():
    """Null-id texts whose hashes agree in 16 bits; the passages of one are repeated elsewhere, the other is clean."""
    passage = " ".join(f"p{k}" for k in range(60))
    first = f"a b c {passage} d"
    low = xxhash.xxh64_intdigest(first.encode(), 42) & 0xFFFF
    clean = " ".join(f"q{k}" for k in range(70))
    clean = next(x for k in range(2_000_000) if xxhash.xxh64_intdigest((x := f"{clean} {k}").encode(), 42) & 0xFFFF == low)
    return [(1, f"{passage} e f", "a"), (None, first, "a"), (None, clean, "a")]


def test_texts_of_null_ids_keep_their_own_marks(spark, alike_in_16_bits):
    df = spark.createDataFrame(alike_in_16_bits, "doc_id long, text string, source string")
    got = [tuple(r) for r in substring.digest(substring.repeated_word_spans(df)).collect()]
    assert Counter(got) == Counter(kept_words(alike_in_16_bits, 50))
    got = [tuple(r) for r in suffixes.digest(suffixes.repeated_byte_spans(df)).collect()]
    assert Counter(got) == Counter(byte_result(alike_in_16_bits, 200))


def test_rows_that_share_an_id(spark):
    """500 rows without an id, ids with several texts, passages between them, and a row repeated 300 times."""
    draw = np.random.default_rng(12)
    passages = [" ".join(f"p{k}x{j}" for j in range(55)) for k in range(20)]
    own = lambda: " ".join(f"w{x}" for x in draw.integers(0, 10**6, draw.integers(1, 60)))
    texts = [f"{own()} {passages[draw.integers(20)]} {own()}" if draw.random() < 0.3 else own() for _ in range(900)]
    rows = [(None if k < 500 else k % 40, t, "a") for k, t in enumerate(texts)] + [(3, texts[0], "a")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    got = [tuple(r) for r in substring.digest(substring.repeated_word_spans(df)).collect()]
    assert Counter(got) == Counter(kept_words(rows, 50)) and any(r[2] for r in got)
    got = [tuple(r) for r in suffixes.digest(suffixes.repeated_byte_spans(df)).collect()]
    assert Counter(got) == Counter(byte_result(rows, 200)) and any(r[2] for r in got)


@pytest.mark.parametrize("sent", [500_000, 0])
def test_near_copies_by_similarity(spark, monkeypatch, sent):
    """Copies with more and more words changed, around 0.8: who goes has a copy of 0.8 or more, who stays hardly ever."""
    monkeypatch.setattr(simhash, "MOST_SENT", sent)
    draw = np.random.default_rng(21)
    texts = []
    for k in range(120):
        base = [f"w{x}" for x in draw.integers(0, 5000, 250)]
        texts.append(base)
        for _ in range(3):
            copy = list(base)
            for i in draw.choice(250, int(draw.integers(1, 14)), replace=False):
                copy[i] = f"n{draw.integers(10**6)}"
            texts.append(copy)
    df = spark.createDataFrame([(k, " ".join(t), "a") for k, t in enumerate(texts)], "doc_id long, text string, source string").repartition(4)
    left = {r.doc_id for r in simhash.one_of_each(df).collect()}
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    alike = [{j: len(sets[k] & sets[j]) / len(sets[k] | sets[j]) for j in range(k // 4 * 4, k // 4 * 4 + 4) if j != k} for k in range(len(texts))]
    assert all(max(alike[k].values()) >= 0.8 for k in set(range(len(texts))) - left)
    pairs = [(k, j) for k in left for j, a in alike[k].items() if j in left and a >= 0.8]
    assert len(pairs) <= 0.05 * sum(a >= 0.8 for x in alike for a in x.values())
    assert 130 < len(left) < 400


def test_a_large_group_of_near_copies(spark):
    """Over 64 members in one signature, most pairs of them around 0.75: what links of 0.83 join has one left."""
    draw = np.random.default_rng(22)
    base = [f"w{x}" for x in draw.integers(0, 5000, 250)]
    texts = []
    for _ in range(220):
        copy = list(base)
        for i in draw.choice(250, int(draw.integers(1, 16)), replace=False):
            copy[i] = f"n{draw.integers(10**6)}"
        texts.append(copy)
    df = spark.createDataFrame([(k, " ".join(t), "a") for k, t in enumerate(texts)], "doc_id long, text string, source string").repartition(4)
    left = {r.doc_id for r in simhash.one_of_each(df).collect()}
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    alike = [[len(x & y) / len(x | y) for y in sets] for x in sets]
    group = list(range(len(texts)))
    for k in range(len(texts)):
        for j in range(k):
            if group[k] != group[j] and alike[k][j] >= 0.83:
                group = [group[j] if g == group[k] else g for g in group]
    assert max(Counter(group[k] for k in left).values()) == 1 < max(Counter(group).values())
    assert all(any(a >= 0.8 for j, a in enumerate(alike[k]) if j != k) for k in set(range(len(texts))) - left)


def test_bucket_of_windows_holds_ids_by_row():
    """A bucket's ids and tags are held once a row: 1,000,000 windows took 74 MB when each had its own, and take 50."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from corvane.llm import substring

    rows, each = 500, 2_000
    n = rows * each
    h = np.random.default_rng(5).integers(0, 2**62, n).astype(np.uint64)
    h[-1] = h[0]
    row, pos = np.repeat(np.arange(rows), each), np.tile(np.arange(each, dtype=np.int32), rows)
    blocks = list(substring.packed_by_bucket(np.zeros(n, np.int32), h, row, pos, np.arange(rows), np.zeros(rows, np.int64)))
    group = substring.sent(blocks, [])
    del h, row, pos
    tracemalloc.start()
    found = substring.reducer(50, 1)(pa.Table.from_batches([group]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    marks = substring.merge_marks(found)
    assert marks.to_pylist() == [{"id": rows - 1, "tag": 0, "spans": [each - 1, each + 49], "covered": 50}]
    assert peak < 60e6, peak
