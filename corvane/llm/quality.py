"""Quality rules as weak supervision: rules vote or abstain, EM estimates their accuracies, a posterior decides.

Each rule looks at counts of one document and votes good, bad or not at all. Only how often each pattern of votes
occurs leaves Spark, at most 3**9 patterns at any corpus size. EM over the patterns estimates the share of good
documents and, for each rule, how likely each vote is on good and on bad documents (priors that favour right votes
keep the two classes from swapping or splitting a uniform corpus). A rule that abstains counts for neither class. The posterior is a logistic function of the votes,
evaluated as a native expression.

A null or empty text has no words and fails the base rules. Repeated rows and null ids are rows like any other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm import common

LEAST_WORDS, MOST_REPEATED = 10, 20
SYMBOLS = b"#*$%&|<>"
# The most frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for on was with as be by this from or are have not an at but "
    "le la les de des du et un une que qui dans pour sur pas au est par avec "
    "der die das und ist nicht ein eine zu den von mit im dem des auf für sich "
    "el los las del en y que un una por con para se no es al lo como"
).split()
RULES = ("symbols", "duplicate_lines", "repeats", "stop_words", "capitals", "punctuation", "variety", "exclamation", "word_length")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Assumed share of good documents and accuracy of a rule, and the weight of both as a share of all documents.
GOOD, ACCURACY, WEIGHT = 0.85, 0.95, 0.02
_STOP = frozenset(w.encode() for w in STOP_WORDS)
_END = frozenset(b".,!?;:")


def repeated_positions(words: list[bytes], n: int) -> int:
    """Words inside windows of n words that occur twice or more, the first occurrence included."""
    count = len(words) - n + 1
    if count < 2:
        return 0
    v = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h, base = np.zeros(count, np.uint64), np.uint64(0x9E3779B97F4A7C15)
    for j in range(n):
        h = h * base + v[j : j + count]
    h = common.mixed(h)
    _, back, times = np.unique(h, return_inverse=True, return_counts=True)
    again = times[back] > 1
    if not again.any():
        return 0
    cover = np.zeros(len(words) + 1, np.int64)
    cover[:count] += again
    cover[n : n + count] -= again
    return int((np.cumsum(cover) > 0).sum())


def measure(data: bytes | None) -> tuple[list[int], list[int]]:
    """The base counts of a text, and the vote of each rule: 1 good, -1 bad, 0 none."""
    data = data or b""
    words = data.split()
    n = len(words)
    lines: dict[bytes, None] = {}
    dup = n_lines = 0
    for line in data.split(b"\n"):
        if line and not line.isspace():
            n_lines += 1
            if line in lines:
                dup += 1
            lines[line] = None
    symbols = sum(data.count(bytes([c])) for c in SYMBOLS)
    chars = len(data.decode()) if not data.isascii() else len(data)
    chars -= sum(data.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    repeated = repeated_positions(words, 5)
    counts = [n, chars, symbols, dup, repeated]
    if not n:
        return counts, [0] * len(RULES)
    stop = sum(w in _STOP for w in data.lower().split())
    upper = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    ended = sum(w[-1] in _END for w in words)
    distinct, exclaimed = len(set(words)), data.count(b"!")
    return counts, [
        _vote(symbols * 10 > n, n >= 20 and symbols * 50 <= n),
        _vote(dup > 1 and dup * 10 > n_lines * 3),
        _vote(repeated * 10 > n),
        _vote(n >= 20 and stop * 100 < n * 3, n >= 20 and stop * 100 >= n * 8),
        _vote(upper * 10 > chars * 4),
        _vote(n >= 30 and (ended * 200 < n or ended * 2 > n), n >= 30 and ended * 50 >= n and ended * 3 <= n),
        _vote(n >= 50 and distinct * 10 < n),
        _vote(exclaimed * 10 > n),
        _vote(chars <= n * 2 or chars >= n * 25),
    ]


def _vote(bad: bool, good: bool = False) -> int:
    return -1 if bad else int(good)


def _votes(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns to keep with the counts and votes of each row."""
    names = [f"v_{r}" for r in RULES]
    clash = set(keep) & {*COUNTS, *names}
    if clash:
        raise ValueError(f"columns to keep have the names of results: {sorted(clash)}")
    schema = docs.select(keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [measure(x) for x in common.binary(b["_text"])]
            columns = {c: b[c] for c in keep}
            columns |= {c: pa.array([x[0][k] for x in found], pa.int64()) for k, c in enumerate(COUNTS)}
            columns |= {c: pa.array([x[1][k] for x in found], pa.int8()) for k, c in enumerate(names)}
            yield pa.RecordBatch.from_pydict(columns)

    ddl = docs.select(keep).sparkSession.createDataFrame([], schema).select(*keep, *[F.lit(0).cast("long").alias(c) for c in COUNTS], *[F.lit(0).cast("byte").alias(c) for c in names]).schema
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(common.released(run), ddl)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


class Model:
    """Class share and, of the rules that vote, the probability of each vote (bad, good) on bad and good documents.

    A rule that abstains says nothing of the class.
    """

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> None:
        rules = patterns.shape[1] if patterns.size else len(RULES)
        total = float(counts.sum())
        strength = max(20.0, WEIGHT * total)
        #: Prior: a vote is right with ACCURACY.
        prior = strength * np.tile(np.array([[ACCURACY, 1 - ACCURACY], [1 - ACCURACY, ACCURACY]]), (rules, 1, 1))
        self.good, self.table = GOOD, prior / prior.sum(2, keepdims=True)
        if not total:
            return
        one_hot = np.stack([patterns < 0, patterns > 0], axis=-1).astype(float)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(self.log_odds(patterns), -500, 500)))
            weight = np.stack([counts * (1 - p), counts * p])
            table = np.einsum("cn,nrv->rcv", weight, one_hot) + prior
            table /= table.sum(2, keepdims=True)
            good = (weight[1].sum() + GOOD * strength) / (total + strength)
            done = abs(good - self.good) < 1e-9 and np.abs(table - self.table).max() < 1e-9
            self.good, self.table = good, table
            if done:
                break

    def weights(self) -> np.ndarray:
        """What a bad vote, none and a good vote of each rule add to the log odds of good."""
        bad, good = np.log(self.table[:, 1] / self.table[:, 0]).T
        return np.stack([bad, np.zeros(len(bad)), good], axis=1)

    def log_odds(self, patterns: np.ndarray) -> np.ndarray:
        w = self.weights()
        return math.log(self.good / (1 - self.good)) + w[np.arange(len(w)), patterns + 1].sum(1)

    def accuracies(self) -> dict[str, float]:
        """How often each rule is right on bad and good documents alike, where it votes."""
        return dict(zip(RULES, (((1 - self.good) * self.table[:, 0, 0] + self.good * self.table[:, 1, 1])).tolist()))

    def posterior(self) -> Column:
        """The probability of good, from the vote columns."""
        z = F.lit(math.log(self.good / (1 - self.good)))
        for name, (bad, none, good) in zip(RULES, self.weights().tolist()):
            v = F.col(f"v_{name}")
            z = z + F.when(v < 0, F.lit(bad)).when(v > 0, F.lit(good)).otherwise(F.lit(none))
        return 1 / (1 + F.exp(-z))


def fit(votes: DataFrame) -> Model:
    """EM over how often each pattern of votes occurs among documents that pass the base rules."""
    names = [f"v_{r}" for r in RULES]
    rows = votes.filter(~base_failed()).groupBy(names).count().orderBy(names).collect()  # at most 3**9 patterns
    return Model(np.array([r[:-1] for r in rows], np.int64).reshape(len(rows), len(names)), np.array([r[-1] for r in rows], float))


def judged(votes: DataFrame, model: Model) -> DataFrame:
    return votes.withColumns({"base_failed": base_failed(), "quality": model.posterior()}).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


def score(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, the votes, base_failed, quality (posterior) and kept, for each row of ``docs``."""
    votes = common.stored(_votes(docs, ["doc_id"]))
    return judged(votes, fit(votes))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, unchanged. Texts are read twice rather than shuffled or stored."""
    model = fit(_votes(docs, []))
    inner = docs.select(F.struct(*docs.columns).alias("_doc"), "text")
    return judged(_votes(inner, ["_doc"]), model).filter("kept").select("_doc.*")
