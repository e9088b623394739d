"""Quality classifier from weak labels.

Several overlapping heuristics vote on each document: good, bad or no vote.  The votes of all
documents are counted by pattern; expectation-maximisation over these counts estimates the share of
good documents and each heuristic's accuracies, without any given label.  The posterior of a
document's pattern is its label; on a bounded sample of documents these labels train a linear
scorer over hashed words, word shapes and binned measures of the text.  The scorer's probability
alone decides: documents below the threshold are rejected.

The sample is the ``sample`` documents with the smallest hashes of id and text, so the model does
not depend on how the rows are partitioned; of rows that agree in both, one is enough.

Defined results
    null text counts as the empty text, which no heuristic votes on: it is kept; repeated rows are
    scored alike; an empty table gives an empty result; columns other than the id and the text are
    ignored by ``score_quality`` and kept by ``keep_good``, whatever their names.
"""

from __future__ import annotations

import math
import operator
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm._shared import settled, table, text_or_empty

#: Documents that the scorer is trained on, at most.
SAMPLE = 4000
FEATURES = 1 << 16
THRESHOLD = 0.5
CACHED = 200_000
#: Words in a window that distinct words are counted in.
WINDOW = 50
ROUNDS, EPOCHS, RATE, DECAY = 60, 12, 0.5, 1e-5


class Facts(NamedTuple):
    """What the heuristics look at, each a share from 0 on and none depending on the text's length."""

    symbols: float  # characters that are neither letters, digits, white space nor plain punctuation, bars aside
    bars: float  # words that are a bar
    repeats: float  # words equal to the word before
    distinct: float  # different words in a window of ``WINDOW`` words, on average
    capitals: float  # words in capitals
    shouts: float  # doubled exclamation marks to a word
    plain: float  # words of letters that are not in capitals, with at most a mark of punctuation behind
    sentences: float  # lines that end like a sentence


#: Symbols, and words that repeat others or aren't plain, that any text may have.
ALLOWED = 3


def facts(text: str, words: list[str] | None = None) -> Facts | None:
    """The facts of a text; None if it has no words."""
    words = text.split() if words is None else words
    if not words:
        return None
    n = len(words)
    odd = max(0, sum(map(text.count, "#$%&*~^<>{}[]\\=+@_")) - ALLOWED)
    lines = [x for x in text.split("\n") if x.strip()] or [""]
    windows = [words[k : k + WINDOW] for k in range(0, n, WINDOW)]
    return Facts(
        symbols=odd / len(text),
        bars=words.count("|") / n,
        repeats=max(0, sum(map(operator.eq, words, words[1:])) - ALLOWED) / n,
        distinct=min(1.0, (sum(len(set(w)) for w in windows) + ALLOWED) / n),
        capitals=sum(map(str.isupper, words)) / n,
        shouts=text.count("!!") / n,
        plain=min(1.0, (sum(map(is_plain, words)) + ALLOWED) / n),
        sentences=sum(x.rstrip()[-1:] in ".!?…\"'" for x in lines) / len(lines),
    )


def votes(f: Facts | None) -> tuple[int, ...]:
    """1 good, -1 bad, 0 no vote, of each heuristic in turn."""
    if f is None:
        return (0,) * HEURISTICS
    return (
        -1 if f.symbols > 0.05 else 0,
        -1 if f.bars > 0.08 else 0,
        -1 if f.repeats > 0.12 else 0,
        -1 if f.distinct < 0.4 else 1 if f.distinct > 0.55 else 0,
        -1 if f.capitals > 0.25 else 0,
        -1 if f.shouts > 0.1 else 0,
        -1 if f.plain < 0.7 else 1 if f.plain > 0.9 else 0,
        1 if f.sentences > 0.7 else 0,
    )


HEURISTICS = len(Facts._fields)


def is_plain(word: str) -> bool:
    return (word.isalpha() or word[:-1].isalpha()) and not (word.isupper() and len(word) > 1)


def place(word: str) -> int:
    """A word's place in the weights: the hash of its letters in lower case, or of what closes it
    if that is a symbol, with whether it is in capitals."""
    shown = f"\0{word[-1]}" if word[-1] in SYMBOLS else word.lower()
    return zlib.crc32(f"{shown}\0{word.isupper()}".encode()) % FEATURES


SYMBOLS = frozenset("#$%&*|~!")


def word_places(words: Iterable[str]) -> list[int]:
    """The different places of a text's words."""
    return sorted({place(w) for w in set(words)})


def fact_places(f: Facts) -> list[int]:
    """A place for the bin of each fact: halvings from 1 on."""
    bins = (min(8, int(-math.log2(max(value, 2**-8)))) if value < 1 else -1 for value in f)
    return [zlib.crc32(f"{name}\0{k}".encode()) % FEATURES for name, k in zip(Facts._fields, bins, strict=True)]


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[float, np.ndarray]:
    """The share of good documents, and of each class (bad, good), heuristic and vote (-1, 0, 1) the
    probability, from vote patterns and how often each occurs.

    It starts from majority votes, so the class that heuristics call good keeps its name.
    """
    good = 1 / (1 + np.exp(-1.5 * patterns.sum(1) - 1.5 * np.minimum(patterns.min(1), 0) * patterns.shape[1]))
    share, table_ = 0.5, np.full((2, patterns.shape[1], 3), 1 / 3)
    for _ in range(rounds):
        weight = np.stack((1 - good, good)) * counts
        share = float(weight[1].sum() / weight.sum())
        for vote in (-1, 0, 1):
            table_[:, :, vote + 1] = weight @ (patterns == vote) + 0.5
        table_ /= table_.sum(2, keepdims=True)
        good = 1 / (1 + np.exp(-log_odds(patterns, share, table_)))
    return share, table_


def log_odds(patterns: np.ndarray, share: float, table_: np.ndarray) -> np.ndarray:
    share = min(max(share, 1e-6), 1 - 1e-6)
    each = np.log(table_[1]) - np.log(table_[0])
    return math.log(share / (1 - share)) + sum(each[j, patterns[:, j] + 1] for j in range(patterns.shape[1]))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer over the mean of word places and the sum of fact places, by stochastic gradients."""
    weights, bias, rng = np.zeros(FEATURES), 0.0, np.random.default_rng(11)
    for epoch in range(EPOCHS):
        rate = RATE / (1 + epoch)
        for i in rng.permutation(len(rows)):
            by_word, by_fact = rows[i]
            n = max(1, len(by_word))
            gap = labels[i] - _sigmoid(weights[by_word].sum() / n * 10 + weights[by_fact].sum() + bias)
            np.add.at(weights, by_word, rate * gap * 10 / n)
            np.add.at(weights, by_fact, rate * gap)
            bias += rate * gap * 0.1
        weights *= 1 - DECAY
    return weights, bias


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def _tagged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and votes (a string of -, 0 and +) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spelled = ["".join("-0+"[v + 1] for v in votes(facts(t))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spelled)], names=["id", "votes"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, votes string")


def _read(spelled: list[str]) -> np.ndarray:
    return np.array([["-0+".index(c) - 1 for c in s] for s in spelled], int).reshape(len(spelled), HEURISTICS)


@dataclass
class Model:
    share: float
    table: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self._votes: dict[tuple[int, ...], float] = {}
        self._words: dict[str, float] = {}

    def _by_votes(self, pattern: tuple[int, ...]) -> float:
        if pattern not in self._votes:
            self._votes[pattern] = float(log_odds(np.array([pattern]), self.share, self.table)[0])
        return self._votes[pattern]

    def _weight(self, word: str) -> float:
        found = self._words.get(word)
        if found is None:
            if len(self._words) > CACHED:
                self._words.clear()
            found = self._words[word] = float(self.weights[place(word)])
        return found

    def score(self, text: str) -> tuple[float, float]:
        """The posterior of the votes, which is only the weak label, and the scorer's probability that a text is good."""
        words = text.split()
        found = facts(text, words)
        if found is None:
            return 1.0, 1.0
        seen = set(words)
        by_words = sum(map(self._weight, seen)) / len(seen) * 10
        by_facts = float(self.weights[fact_places(found)].sum())
        return _sigmoid(self._by_votes(votes(found))), _sigmoid(by_words + by_facts + self.bias)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Accuracies from the votes of all documents; the scorer from at most ``sample`` of them."""
    counted = settled(_tagged(docs, id_col, text_col).groupBy("votes").count(), "votes").collect()  # 3^9 rows at most
    if not counted:
        return Model(0.5, np.full((2, HEURISTICS, 3), 1 / 3), np.zeros(FEATURES), 0.0)
    patterns = _read([r["votes"] for r in counted])
    share, table_ = expectation_maximisation(patterns, np.array([r["count"] for r in counted], float))
    # Rows that hash alike in id and text are equal rows.
    chosen = docs.select(text_or_empty(text_col).alias("text"), F.xxhash64(F.lit(3), F.col(id_col).cast("long"), text_col).alias("h"))
    total = sum(r["count"] for r in counted)
    part = min(1.0, 1.5 * sample / total + 200 / total)
    # A share by the hash first, so that few texts are sorted; then exactly the smallest hashes of all.
    low = chosen.where(F.col("h") <= F.lit(int((part - 0.5) * (2**64 - 2**12))))
    low = low.orderBy("h").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = text.split()
                found = facts(text, words)
                made.append((h, "".join("-0+"[v + 1] for v in votes(found)), word_places(words), fact_places(found) if found else []))
            shape = (pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            columns = [pa.array([m[k] for m in made], kind) for k, kind in enumerate(shape)]
            yield pa.RecordBatch.from_arrays(columns, names=["h", "votes", "by_word", "by_fact"])

    found = low.select("text", "h").mapInArrow(run, "h long, votes string, by_word array<int>, by_fact array<int>").collect()
    rows = sorted((r for r in found if r["by_fact"]), key=lambda r: (r["h"], r["votes"]))
    labels = 1 / (1 + np.exp(-log_odds(_read([r["votes"] for r in rows]), share, table_))) if rows else np.zeros(0)
    weights, bias = train([(np.array(r["by_word"], np.int64), np.array(r["by_fact"], np.int64)) for r in rows], labels)
    return Model(share, table_, weights, bias)


def score_quality(docs: DataFrame, model: Model | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, weak_label (posterior of the votes), score (the scorer's probability) and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shared.value.score(t) for t in batch.column(1).to_pylist()]
            weak, score = ([round(m[k], 6) for m in made] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weak, pa.float64()), pa.array(score, pa.float64())], names=["id", "weak_label", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    found = rows.mapInArrow(run, "id long, weak_label double, score double")
    return found.withColumn("kept", F.col("score") >= threshold)


def keep_good(docs: DataFrame, model: Model | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs, id_col, text_col))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [shared.value.score(t or "")[1] >= threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
