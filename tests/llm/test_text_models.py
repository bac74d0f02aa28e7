import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_dedup import words

from corvane.llm import common, language_model, licenses, mixing, pieces, quality


def counts(text):
    w, lines = words(text), (text or "").split("\n")
    seen, dup = set(), 0
    for line in lines:
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(len(x.decode()) for x in w), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(cover)


def test_quality_counts(docs, corpus):
    rows = quality.score(docs).collect()
    got = Counter((r.doc_id, *(r[c] for c in quality.COUNTS), r.base_failed) for r in rows)
    want = Counter((d, *(c := counts(t)), c[0] < 10 or 100 * c[4] > 20 * c[0]) for d, t, _ in corpus)
    assert got == want
    assert not any(r.kept and r.base_failed for r in rows)


def test_votes_find_bad_texts_and_leave_good_ones(spark):
    good = [f"the cat number {k} sat on the mat and it was happy, as it is in the house of the man with a hat that he has from his son of old." for k in range(300)]
    bad = [" | ".join(f"menu{k}x{j}" for j in range(20)) for k in range(20)] + [" ".join(f"W{k}{j}***" for j in range(30)) for k in range(20)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(good + bad)], "doc_id long, text string")
    kept = {r.doc_id for r in quality.score(df).filter("kept").collect()}
    assert kept == set(range(300))
    clean = df.filter("doc_id < 300").withColumn("quality", F.lit("x"))
    assert quality.keep_good(clean).count() == 300 and quality.keep_good(clean).columns == ["doc_id", "text", "quality"]


def test_kept_follows_from_the_votes(docs):
    """EM written out document by document: a rule that abstains is left out, votes are smoothed by the prior."""
    rows = quality.score(docs).collect()
    votes = [[r[f"v_{x}"] for x in quality.RULES] for r in rows]
    fit = [v for v, r in zip(votes, rows) if not r.base_failed]
    strength = max(20.0, quality.WEIGHT * len(fit))
    share, right = quality.GOOD, [{1: quality.ACCURACY, 0: quality.ACCURACY} for _ in quality.RULES]  # of good and of bad documents

    def odds(v):
        x = share / (1 - share)
        for vote, a in zip(v, right):
            x *= a[1] / (1 - a[0]) if vote > 0 else (1 - a[1]) / a[0] if vote < 0 else 1
        return x

    for _ in range(200):
        p = [odds(v) / (1 + odds(v)) for v in fit]
        new = []
        for k in range(len(quality.RULES)):
            good = sum(x for v, x in zip(fit, p) if v[k] > 0), sum(x for v, x in zip(fit, p) if v[k])
            bad = sum(1 - x for v, x in zip(fit, p) if v[k] < 0), sum(1 - x for v, x in zip(fit, p) if v[k])
            new.append({1: (good[0] + strength * quality.ACCURACY) / (good[1] + strength), 0: (bad[0] + strength * quality.ACCURACY) / (bad[1] + strength)})
        share, right = (sum(p) + quality.GOOD * strength) / (len(fit) + strength), new
    for v, r in zip(votes, rows):
        assert r.quality == pytest.approx(odds(v) / (1 + odds(v)), abs=1e-5)
        assert r.kept == (not r.base_failed and r.quality >= 0.5)
    assert {x for v in votes for x in v} == {-1, 0, 1}


def test_quality_of_nothing(nothing, crowded):
    assert quality.score(nothing).collect() == [] and quality.keep_good(nothing).collect() == []
    assert quality.keep_good(crowded).columns == crowded.columns


def test_em_finds_accuracies():
    draw = np.random.default_rng(0)
    truth = draw.random(20_000) < 0.8
    votes = np.stack([np.where(draw.random(20_000) < 0.3, 0, np.where((draw.random(20_000) < a) == truth, 1, -1)) for a in (0.95, 0.9, 0.75)], axis=1)
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    model = quality.Model(patterns, n.astype(float))
    assert list(model.accuracies().values()) == pytest.approx([0.95, 0.9, 0.75], abs=0.03) and model.good == pytest.approx(0.8, abs=0.03)


def base_scores(corpus):
    training = [t for d, t, _ in corpus if zlib.crc32(b"" if d is None else str(d).encode()) % 5 != 1]
    c = Counter(w for t in training for w in [*words(t, lower=True), b""])
    n, z = sum(c.values()), math.log10(sum(c.values()) + 0.5 * (len(c) + 1))
    out = []
    for d, t, _ in corpus:
        w = [*words(t, lower=True), b""]
        out.append((d, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10(c[x] + 0.5) - z for x in w)))
    return out


@pytest.mark.parametrize("heavy", [400_000, 40])
def test_base_scores(docs, corpus, monkeypatch, heavy):
    monkeypatch.setattr(language_model, "HEAVY", heavy)
    rows = language_model.score(docs).collect()
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows))
    want = sorted((d is None, d or 0, *x) for d, *x in base_scores(corpus))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-9)
    assert all(r.score < 0 for r in rows)


def small_vocabulary():
    kinds = np.array([1, 1, 1, 2, 5, 5], np.int32)
    rare, distinct = np.zeros(language_model.CLASSES + 1), np.zeros(language_model.CLASSES + 1)
    rare[[1, 2, 9]], distinct[[1, 2, 9]] = (4, 1, 2), (3, 1, 2)
    return language_model.Vocabulary(np.arange(11, 17, dtype=np.uint64), kinds, np.array([5, 9, 3, 2, 4, 7]), 6, rare, distinct)


def test_normaliser_and_training():
    draw = np.random.default_rng(0)
    v = small_vocabulary()
    members, n = np.flatnonzero(v.weight > 1), len(v.weight)
    model, follows = language_model.LogBilinear(v), draw.permutation(members)
    tokens = [0]
    for _ in range(60_000):
        at = int(np.searchsorted(members, tokens[-1]))
        tokens.append(int(follows[at]) if draw.random() < 0.9 else int(draw.choice(members)))
    rows = language_model.rows_of_tokens(np.array(tokens), np.array([0, len(tokens)]))

    def mean():
        w1, w2 = (np.repeat(x, n) for x in rows[100:140, :2].T)
        every = np.exp(model.log_probabilities(w1, w2, np.tile(np.arange(n), 40))).reshape(40, n)
        assert np.allclose(every.sum(1), 1, atol=1e-4)
        return float(model.log_probabilities(*rows.T).mean())

    before = mean()
    for k in range(3):
        model.train(rows, np.random.default_rng(k))
    assert mean() > before + 0.5


def plain_probability(model, w1, w2, w):
    """log10 of P(class) P(member within it), each a softmax written out."""
    v = model.v
    q = model.before[w1].astype(float) + model.last[w2].astype(float)
    kind = next(c for c in range(len(v.first)) if v.first[c] <= w < v.first[c] + v.size[c])
    kinds = [math.exp(q @ r + b) for r, b in zip(model.kinds.astype(float), model.kind_bias.astype(float))]
    own = range(v.first[kind], v.first[kind] + v.size[kind])
    members = {k: math.exp(q @ model.words[k].astype(float) + model.word_bias[k]) for k in own}
    return math.log10(kinds[kind] / sum(kinds)) + math.log10(members[w] / sum(members.values()))


@pytest.mark.parametrize("heavy", [400_000, 40])
def test_scores_are_those_of_the_model(crowded, docs, corpus, monkeypatch, heavy):
    """Scores recomputed word by word from the model's parameters and plain counts; the same for any partitions."""
    monkeypatch.setattr(language_model, "HEAVY", heavy)
    monkeypatch.setattr(language_model, "SHARD", 2000)
    monkeypatch.setattr(language_model, "ADDED_AT_ONCE", 2)
    slim = docs.select("doc_id", "text")
    model, *_ = language_model.learned(slim, language_model.counts(slim).cache())
    training = [t for d, t, _ in corpus if zlib.crc32(b"" if d is None else str(d).encode()) % 5 != 1]
    c = Counter(w for t in training for w in words(t, lower=True))
    kind = lambda w: int(language_model.SHAPES[(w[-2] if len(w) > 1 else 0) * 256 + w[-1]])
    v = model.v
    known = {}
    for w in c:
        t = language_model.Tokens(pa.array([w.decode()]))
        k = int(v.numbers(t)[0])
        if k != v.first[kind(w)]:
            known[w] = k
    rest = {k: [n for w, n in c.items() if kind(w) == k and w not in known] for k in range(1, language_model.CLASSES + 1)}
    want = []
    for d, t, _ in corpus:
        if len(words(t)) > 300:
            continue
        at, total = [0, 0], 0.0
        for w in [*words(t, lower=True), b""]:
            number = 0 if not w else known.get(w, v.first[kind(w)] if w else 0)
            total += plain_probability(model, at[-2], at[-1], number)
            if w and w not in known:
                total += math.log10((c[w] + 0.5) / (sum(rest[kind(w)]) + 0.5 * (len(rest[kind(w)]) + 1)))
            at.append(number)
        want.append((d is None, d or 0, len(words(t)), total))
    for df in (crowded.repartition(1), docs.repartition(8)):
        got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens - 1, r.score) for r in language_model.score(df).collect() if r.n_tokens <= 301)
        assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
        assert [g[3] for g in got] == pytest.approx([w[3] for w in sorted(want)], rel=1e-4)


def test_model_beats_counts_on_held_out_text(spark):
    draw = np.random.default_rng(2)
    vocabulary = [f"w{k}" for k in range(60)]
    follows = draw.permutation(60)

    def text():
        at, out = int(draw.integers(60)), []
        for _ in range(200):
            at = int(follows[at]) if draw.random() < 0.8 else int(draw.integers(60))
            out.append(vocabulary[at])
        return " ".join(out)

    df = spark.createDataFrame([(k, text()) for k in range(400)], "doc_id long, text string")
    rows = [r for r in language_model.score(df).collect() if r.held_out]
    assert len(rows) > 40 and all(r.score > r.base_score for r in rows)


def test_no_documents_to_score_or_to_learn_from(spark, nothing):
    assert language_model.score(nothing).collect() == []
    only = next(k for k in range(100) if not language_model.in_training(k))
    r = language_model.score(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and r.base_score == pytest.approx(0.0)


def water(sizes, weights):
    target, left, free = [0.0] * len(sizes), 1.5 * sum(sizes), set(range(len(sizes)))
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > 2 * sizes[i]]
        if not over:
            for i in free:
                target[i] = left * weights[i] / total
            break
        for i in over:
            target[i] = 2.0 * sizes[i]
            free.discard(i)
        left -= sum(2 * sizes[i] for i in over)
    return target


def test_mix(docs, corpus, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 300)
    rows = mixing.mix(docs).collect()
    assert rows == mixing.mix(docs).collect() or Counter(map(str, rows)) == Counter(map(str, mixing.mix(docs).collect()))
    size = {s: sum(len(words(t)) for _, t, x in corpus if x == s) for s in {x for _, _, x in corpus}}
    names = sorted(size, key=lambda s: (s is None, s or ""))
    target = dict(zip(names, water([size[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))])))
    source = {(d, len(words(t))): s for d, t, s in corpus}
    taken = Counter()
    for r in rows:
        s = source[r.doc_id, r["size"]]
        assert r.source_size == size[s] and r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 2 * r["size"] and len(r.shards) == -(-r.taken // max(1, r["size"])) or not r["size"]
        taken[s] += r.taken
    assert len(rows) == len(corpus)
    for s in names:
        assert taken[s] == math.floor(target[s] + 1e-6)


@pytest.mark.parametrize("most", [100_000, 0])
def test_target_ends_among_equal_rows(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "MOST_SENT", most)
    rows = [(None, " ".join(f"w{j}" for j in range(10)), "a")] * 3 + [(None, "x y z", "b")] * 1001
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    taken = {"a": [], "b": []}
    for r in mixing.mix(df).collect():
        assert r["size"] <= r.taken <= 2 * r["size"] and len(r.shards) == -(-r.taken // r["size"])
        taken["a" if r["size"] == 10 else "b"].append(r.taken)
    target = water([30, 3003], [5, 2])
    assert {s: sum(x) for s, x in taken.items()} == {"a": math.floor(target[0]), "b": math.floor(target[1])}
    words_out = Counter(r.source for r in mixing.mixed_documents(df).collect() for _ in words(r.text))
    assert words_out == {s: sum(x) for s, x in taken.items()}


def test_mixed_documents(crowded, docs):
    out = mixing.mixed_documents(crowded)
    assert out.columns == crowded.columns
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id] += r.taken
    got = Counter()
    for r in out.collect():
        got[r.doc_id] += len(words(r.text))
    assert +got == +want


def test_splitting_tree_uses_quotas_up():
    quota = np.array([100, 7, 0, 33])
    shards = mixing.Shards.of(int(quota.sum()), 16)
    leaves = sorted(mixing.split_quota(quota, shards, (1, 0, shards.number)), key=lambda x: x[0])
    assert [x[0] for x in leaves] == list(range(shards.number)) and shards.number == 9
    assert (sum(x[1] for x in leaves) == quota).all() and all(x[1].sum() == shards.capacity(x[0], x[0] + 1) <= 16 for x in leaves)
    for s in range(4):
        units = [u for _, got, first in leaves for u in range(first[s], first[s] + got[s])]
        assert units == list(range(quota[s]))


def test_mix_of_nothing(nothing, spark):
    assert mixing.mix(nothing).collect() == [] and mixing.mixed_documents(nothing).collect() == []
    empty = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r["size"], r.taken, r.target) for r in mixing.mix(empty).collect()] == [(0, 0, 0.0)] * 2
    assert mixing.mixed_documents(empty).collect() == []


def best_score(v, text):
    """Plain dynamic programming over all pieces."""
    best = [0] + [None] * len(text)
    for j in range(1, len(text) + 1):
        options = [best[j - len(p)] + s for p, s in zip(v.pieces, v.scores) if p and text[:j].endswith(p) and j >= len(p)]
        if text[j - 1] not in v.table:
            options.append(best[j - 1] + v.unknown)
        best[j] = max(options)
    return best[-1]


def plain_pieces(v, text):
    """Plain dynamic programming that keeps whole paths: the best total, then the longest last piece, the one before it."""
    best = [(0, (), ())]
    for j in range(1, len(text) + 1):
        options = []
        for n in range(1, min(j, v.longest) + 1):
            score, lengths, ids = best[j - n]
            x = v.table.get(text[j - n : j])
            if x:
                options.append((score + x[0], (n, *lengths), (*ids, x[1])))
            elif n == 1:
                c = {pieces.OWN_MARK: pieces.MARK, pieces.MARK: " "}.get(text[j - 1], text[j - 1])
                options.append((score + v.unknown, (n, *lengths), (*ids, *[v.byte[b] for b in c.encode()])))
        best.append(max(options))
    return best[-1][0], list(best[-1][2])


def text_of(v, ids):
    return pieces.as_text(np.array(ids, np.int32), np.array([0, len(ids)]), v)[0].tobytes().decode().removeprefix(" ")


def test_segmentation_is_best_however_it_is_cut():
    draw = np.random.default_rng(4)
    pick = lambda letters, n: "".join(draw.choice(list(letters), n))
    tied = 0
    for trial in range(300):
        texts = {pick("ab", draw.integers(1, 6)) for _ in range(8)} | {pieces.MARK + x for x in ("", "a", "ab", "ba")} | ({pieces.MARK * 3} if trial % 2 else set())
        texts = sorted(p for p in texts if draw.random() < 0.9)
        scores = tuple(-int(draw.integers(1, 50 if trial % 3 else 3)) * pieces.UNIT for _ in texts) + (-99 * pieces.UNIT,) * 256
        v = pieces.Vocabulary((*texts, *[None] * 256), scores, tuple(range(len(texts), len(texts) + 256)))
        lattice, text = pieces.Lattice(v), pick("aaabbé▁" if trial % 5 == 0 else "aaabb " if trial % 2 else "aaaaab", draw.integers(1, 50))
        score, ids = lattice.whole(pieces.marked(text))
        assert score == best_score(v, pieces.marked(text)) and text_of(v, ids) == text
        assert (score, ids) == plain_pieces(v, pieces.marked(text))
        size, raw = int(draw.integers(1, 12)), " " + text
        chunks = [(pieces.as_marks(raw[i : i + size + v.longest - 1]), min(size, len(raw) - i)) for i in range(0, len(raw), size)]
        matrices = [lattice.transfer(*c) for c in chunks]
        states = pieces.scan(matrices)
        assert sum(int(m[a, b]) for (m, _), a, b in zip(matrices, states, states[1:])) == score
        parts = [k for c, a, b in zip(chunks, states, states[1:]) for k in lattice.backtrace(*c, a, b)]
        assert parts == ids
        tied += len(chunks) > 2 and trial % 3 == 0
    assert tied > 50


def test_products_of_matrices_are_associative():
    draw = np.random.default_rng(8)
    v = pieces.Vocabulary(("a", "aa", "aaa", *[None] * 256), tuple(-pieces.UNIT * k for k in (1, 2, 3)) + (-99 * pieces.UNIT,) * 256, tuple(range(3, 259)))
    lattice, text = pieces.Lattice(v), "a" * 30
    cuts = [0, *sorted(draw.choice(np.arange(1, 30), 4, replace=False).tolist()), 30]
    m = [lattice.transfer(text[a : b + v.longest - 1], b - a) for a, b in zip(cuts, cuts[1:])]
    left, right = m[0], m[-1]
    for x in m[1:]:
        left = pieces.product(left, x)
    for x in reversed(m[:-1]):
        right = pieces.product(x, right)
    reached = left[0] > pieces.WORST // 2
    assert (left[0] == right[0])[reached].all() and reached.any()
    for b in range(v.longest):
        r = reached[:, b]
        assert (np.argsort(left[1][r, b], kind="stable") == np.argsort(right[1][r, b], kind="stable")).all()


def test_stretches_are_forgotten_and_hashes_may_agree(monkeypatch):
    v, texts = pieces.load(), [f"w{k} x{k % 7} the  of" for k in range(400)]
    want = [pieces.Lattice(v).whole(pieces.marked(t)) for t in texts]
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    few = pieces.Lattice(v)
    assert [few.whole(pieces.marked(t)) for t in texts] == want and few.count <= 50
    few.hashed.spans = lambda prefix, start, end: np.zeros(len(start), np.uint64)  # all stretches look alike
    few.forget()
    assert [few.whole(pieces.marked(t)) for t in texts] == want


def test_round_trip(crowded, spark, nothing):
    odd = spark.createDataFrame([(1, "  two  ▁ marks\t\n é 漢字 😀 "), (2, "x" * 3000), (3, " " * 3000), (4, ""), (5, None), (6, "�\U0010ffff"), (7, "漢字かな交じり文" * 300), (8, "aaaaaaaaab" * 90)], "doc_id long, text string")
    v = pieces.load()
    for df in (crowded, odd):
        for chunk in (pieces.CHUNK, 100):
            found = pieces.decode(pieces.encode(df, v, chunk), v, into="decoded")
            assert found.columns == [*df.columns, "pieces", "score", "decoded"]
            assert found.filter("not decoded <=> text").count() == 0 and found.count() == df.count()
            again = pieces.encode(df, v, chunk, restored="decoded")
            assert again.columns == found.columns and again.filter("not decoded <=> text").count() == 0
    a, b = (pieces.encode(odd, v, c).orderBy("doc_id").collect() for c in (100_000, 100))
    assert a == b and a[3].pieces == [] and a[4].pieces is None
    assert [r.pieces for r in a if r.text] == [plain_pieces(v, pieces.marked(r.text))[1] for r in a if r.text]
    assert pieces.encode(nothing, v).collect() == [] and pieces.decode(pieces.encode(nothing, v), v).collect() == []
    wrong = spark.createDataFrame([([v.byte[0xFF]],)], "pieces array<int>")
    assert pieces.decode(wrong, v).first().text == "\ufffd"


def plain_words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        c = c.lower() if c.isascii() else c
        if c.isascii() and not c.isalnum():
            out += [word] * bool(word)
            word = ""
        else:
            word += c
    return out


LICENSED = [
    "Released under the MIT License.\nmore",
    "mit-license mit\nLICENSE, and the General  Public License; apache license",
    "We release it under the mit license or so\nLicensed under CC BY-NC 4.0.",
    "submit license. mit licenses",
    "under the MIT Release, License.",
    "This program is free software you can redistribute it and or modify it under the terms of the GNU Licence as published by the Free Software Foundation and so on",
    "x\nPermission is hereby granted, free of charge, to any\nperson obtaining a copy of this software and\nassociated documentation files (the Software)\ny",
    "Redistribution and use in source and binary forms,\nwith or without modification, are permitted provided\nthat the following conditions are met:",
    "Redistribution and use in source and binary forms,\n\n\nwith or without modification, are permitted provided\n\nthat the following conditions are met:",
    "Licensed under the GNU General Public License, version 3.", "Licensed under the GNU Lesser General Public License, version 3.",
    "released under the license; the version 3 of this work under the terms and conditions of the general use of this source code, by a person",
    "mİt license K", "apache", None, "", "Apache license " * 700, "Released under\nthe\nMIT\nLicense",
]


@pytest.mark.parametrize("threshold", [0.8, 0.5])
def test_licenses(spark, threshold):
    rows = [*enumerate(LICENSED), (0, LICENSED[0]), (None, "mit license"), (None, "hello world"), (None, "Licensed under CC BY-NC 4.0."), (7, "other text of the same id")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, found string").repartition(5)
    got = Counter(tuple(r) for r in licenses.scan(df, threshold).collect())
    want = Counter()
    for d, t in rows:
        w, places, base = plain_words(t), [], set()
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += at
            base |= {label} if at else set()
        best, labels, lines = 0.0, set(base), (t or "").split("\n")
        for i in range(len(lines)):
            block = set(plain_words(" ".join(lines[i : i + licenses.LINES])))
            for label, template, must in licenses.TEMPLATES:
                goal = set(plain_words(template))
                if len(goal & block) >= math.ceil(len(goal) * threshold) and block >= set(must.split()):
                    best, labels = max(best, len(goal & block) / len(goal)), labels | {label}
        want[d, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if places else best] += 1
    assert got == want
    if threshold == 0.8:
        by_text = {LICENSED[k[0]]: k[6] for k in want if k[0] is not None and k[0] != 7}
        assert by_text[LICENSED[6]] == "mit" and by_text[LICENSED[9]] == "gpl" and "lgpl" in by_text[LICENSED[10]] and by_text[LICENSED[8]] == ""
    assert licenses.scan(df.filter("false")).collect() == []


def test_positional_filter_rejects_only_what_cannot_match(spark):
    df = spark.createDataFrame(list(enumerate(LICENSED)), "doc_id long, text string")
    wanted = licenses.templates(threshold=0.5)
    rows = licenses.measured(df, wanted).withColumn("text", F.lit(None).cast("string")).drop("text").join(df, "doc_id")
    order, wanted = licenses.in_order(rows, wanted)
    met = licenses.pairs(licenses.blocks(rows), order, wanted)
    rejected = met.filter(~licenses.possible())
    assert 0 < rejected.count() < met.count()
    assert rejected.filter(F.size("shared") >= F.col("need")).count() == 0


def test_a_task_holds_few_chunks_of_giants(spark, monkeypatch):
    """Of 300 chunks in one batch: the piece numbers of each are Python objects until they are sent."""
    steps = {}
    monkeypatch.setattr(common, "released", lambda run: steps.setdefault(run.__name__, run))
    pieces.encode(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))
    size, text = 300, " some words and more of them here"
    columns = {"row": pa.array([1] * size), "k": pa.array(range(size), pa.int32()), "part": pa.array([text] * size), "n": pa.array([len(text)] * size, pa.int32()), "begin": pa.array([0] * size, pa.int32()), "end": pa.array([0] * size, pa.int32()), "part_score": pa.array([0] * size)}
    for step in ("transfers", "pieces"):
        found = list(steps[step](iter([pa.RecordBatch.from_pydict(columns)])))
        assert [k for b in found for k in b["k"].to_pylist()] == list(range(size)) and max(map(len, found)) <= 32
