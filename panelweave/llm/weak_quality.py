"""Quality classifier from weak labels: overlapping heuristics, their accuracies by EM, and a hashed linear scorer."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import keep, ship

LABELLERS = ("symbols", "capitals", "bars", "phrases", "neighbours", "lines", "plain", "flow", "fresh")
FEATURES = 1 << 14
TRAIN_ROWS = 20_000  # documented bound of the sample that the scorer is fitted on
SYMBOL_BYTES = b"#$%&*@^~=<>{}[]\\_`+|!"
SYMBOLS = frozenset(SYMBOL_BYTES)


PUNCTUATION = b".,;:!?)\"'"
RUN = re.compile(rb"(.)\1+", re.S)
SHAPE = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))


class _Reading(NamedTuple):
    """What one look at a text gives: votes (1 junk, 0 sound, -1 no opinion), words, and how much recurs."""

    votes: list[int]
    words: list[bytes]
    neighbours: float
    recurring: float


def _read(text: bytes | None) -> _Reading:
    """The first six labellers each know one defect and have no opinion without it. The last three also vouch for sound texts:
    words without odd marks, words that begin small, and word sequences that do not recur. Every defect is seen by two or more.
    """
    words = text.split() if text else []
    n = len(words)
    if n < 4:  # too little to judge
        return _Reading([-1] * len(LABELLERS), words, 0.0, 0.0)
    marked = sum([w[-1] in SYMBOLS and w[-2:-1] != b"" and w[-2] in SYMBOLS for w in words]) / n
    upper = sum([w.isupper() and len(w) > 1 for w in words]) / n
    bars = words.count(b"|") / n
    fresh = len(set(zip(words, words[1:], words[2:], words[3:]))) / (n - 3)
    neighbours = sum(map(bytes.__eq__, words, words[1:])) / n
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 1 - len(set(lines)) / len(lines)
    bare = [w[:-1] if w[-1] in PUNCTUATION else w for w in words]
    plain = sum(map(bytes.__eq__, bare, [w.translate(None, SYMBOL_BYTES) for w in bare])) / n
    small = sum([w[0] >= 97 for w in words]) / n
    enough = n >= 12
    junk_over = lambda x, limit: 1 if x > limit else -1
    level = lambda x, junk, sound: 1 if x < junk else 0 if x >= sound else -1
    votes = [
        junk_over(marked, 0.2),
        junk_over(upper, 0.6),
        junk_over(bars, 0.1),
        junk_over(1 - fresh, 0.45) if enough else -1,
        junk_over(neighbours, 0.3) if enough else -1,
        junk_over(repeated, 0.6) if len(lines) >= 4 else -1,
        level(plain, 0.7, 0.9),
        level(small, 0.15, 0.4),
        level(fresh, 0.55, 0.85) if enough else -1,
    ]
    return _Reading(votes, words, neighbours, 1 - fresh)


class _Features:
    """Hashed features of a text: word shapes, word ends, repetition; the same for every length."""

    LIMIT = 200_000

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.hashed: dict[bytes, int] = {}

    def _slot(self, piece: bytes) -> int:
        value = self.hashed.get(piece)
        if value is None:
            if len(self.hashed) >= self.LIMIT:
                self.hashed.clear()
            value = self.hashed[piece] = xxhash.xxh3_64_intdigest(piece) % FEATURES
        return value

    def _of(self, word: bytes) -> int:
        """The slots of the word's shape (runs of one class of characters) and of its last two bytes, in one number."""
        value = self._slot(b"s" + RUN.sub(rb"\1", word.translate(SHAPE))) * FEATURES + self._slot(b"e" + word[-2:])
        if len(self.known) >= self.LIMIT:
            self.known.clear()
        self.known[word] = value
        return value

    def vector(self, seen: _Reading) -> tuple[np.ndarray, np.ndarray]:
        """Indices and values: shares of shapes and ends among the words, and coarse levels of repetition and length."""
        n = len(seen.words)
        if not n:
            return np.array([0]), np.array([1.0])
        found = list(map(self.known.get, seen.words))
        if None in found:
            found = [self._of(w) if p is None else p for w, p in zip(seen.words, found)]
        codes = np.array(found, dtype=np.int64)
        counts = np.bincount(codes // FEATURES, minlength=FEATURES) + np.bincount(codes % FEATURES, minlength=FEATURES)
        index = np.flatnonzero(counts)
        extra = [self._slot(b"%s:%d" % (k, v)) for k, v in ((b"same", int(seen.neighbours * 10)), (b"copied", int(seen.recurring * 10)), (b"length", int(math.log2(n))))]
        return np.concatenate([index, extra, [0]]), np.concatenate([np.sqrt(counts[index] / n), np.ones(len(extra) + 1)])


@dataclass
class LabelModel:
    """Share of junk, and per labeller the probabilities of its votes given the class."""

    prior: float
    given: np.ndarray  # [labeller, class, vote + 1]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of junk for rows of votes."""
        odds = np.tile(np.log([1 - self.prior, self.prior]), (len(votes), 1))
        for k in range(votes.shape[1]):
            seen = votes[:, k] >= 0  # an abstention says nothing
            odds[seen] += np.log(self.given[k][:, votes[seen, k] + 1]).T
        return 1 / (1 + np.exp(np.clip(odds[:, 0] - odds[:, 1], -500, 500)))

    def accuracy(self) -> np.ndarray:
        """Per labeller: probability that the document is of the class it votes for, when it votes."""
        joint = self.given[:, :, 1:] * np.array([1 - self.prior, self.prior])[None, :, None]
        return joint[:, [0, 1], [0, 1]].sum(axis=1) / np.maximum(joint.sum(axis=(1, 2)), 1e-12)


def fit_labels(votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over distinct vote patterns and how often each occurs."""
    m = votes.shape[1]
    start = np.where((votes == 1).any(axis=1), 0.9, np.where((votes == 0).any(axis=1), 0.05, 0.2))
    model, before = None, None
    for _ in range(rounds):
        if model is not None:
            start = model.posterior(votes)
        mass = np.stack([(1 - start) * counts, start * counts], axis=1)
        given = np.full((m, 2, 3), 0.5)  # smoothing
        for v in (-1, 0, 1):
            given[:, :, v + 1] += (votes == v).T.astype(float) @ mass
        given /= given.sum(axis=2, keepdims=True)
        prior = float(np.clip((mass[:, 1].sum() + 0.5) / (mass.sum() + 1), 1e-4, 0.5))
        model = LabelModel(prior, given)
        if before is not None and abs(prior - before) < 1e-9:
            break
        before = prior
    return model


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], junk: np.ndarray, epochs: int = 60, ridge: float = 1e-5) -> np.ndarray:
    """Logistic regression on hashed features against posterior labels (Adagrad over mini-batches, fixed order)."""
    weights, grown = np.zeros(FEATURES), np.full(FEATURES, 1e-6)
    if not rows:
        return weights
    order = np.random.Generator(np.random.PCG64(7)).permutation(len(rows))
    balance = np.where(junk > 0.5, 0.5 / max(junk.mean(), 1e-3), 0.5 / max(1 - junk.mean(), 1e-3))
    for _ in range(epochs):
        for at in range(0, len(order), 256):
            part = order[at : at + 256]
            index = np.concatenate([rows[i][0] for i in part])
            value = np.concatenate([rows[i][1] for i in part])
            owner = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
            z = np.bincount(owner, weights[index] * value, minlength=len(part))
            error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - junk[part]) * balance[part] / len(part)
            gradient = np.bincount(index, error[owner] * value, minlength=FEATURES) + ridge * weights
            grown += gradient * gradient
            weights -= 0.3 * gradient / np.sqrt(grown)
    return weights


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def vote_table(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``pattern`` (the votes as characters j, s and -), ``draw`` (a hash of the id that orders the sample)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            patterns = ["".join("-sj"[v + 1] for v in _read(t).votes) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(patterns, pa.string())], names=["doc_id", "pattern"])

    return _slim(docs).mapInArrow(run, "doc_id bigint, pattern string")


def _as_votes(patterns: list[str]) -> np.ndarray:
    return np.array([["-sj".index(c) - 1 for c in p] for p in patterns], dtype=np.int64).reshape(len(patterns), len(LABELLERS))


@dataclass
class QualityModel:
    labels: LabelModel
    weights: np.ndarray


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> QualityModel:
    """The label model from the vote patterns of all documents, and the scorer from a bounded sample of them.

    Votes are counted per pattern (3 to the power of the labellers at most) before they reach the driver. The sample is the
    documents whose hash of id and text falls under a threshold, ``train_rows`` of them on average.
    """
    ship(docs.sparkSession)
    votes = keep(vote_table(docs).groupBy("pattern").agg(F.count(F.lit(1)).alias("n")), "votes").collect()
    patterns = _as_votes([r.pattern for r in votes])
    total = sum(r.n for r in votes)
    if not total:
        return QualityModel(LabelModel(0.1, np.full((len(LABELLERS), 2, 3), 1 / 3)), np.zeros(FEATURES))
    labels = fit_labels(patterns, np.array([r.n for r in votes], dtype=float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = _Features()
        for batch in batches:
            index, value, junk = [], [], []
            for text in batch.column(1).to_pylist():
                seen = _read(text)
                i, v = features.vector(seen)
                index.append(i.astype(np.int32).tobytes())
                value.append(v.astype(np.float32).tobytes())
                junk.append(float(labels.posterior(np.array([seen.votes]))[0]))
            yield pa.RecordBatch.from_arrays([pa.array(index, pa.binary()), pa.array(value, pa.binary()), pa.array(junk, pa.float64())], names=["i", "v", "junk"])

    share = min(1.0, train_rows / total)
    # by the text too: ids may be missing, few or all the same
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    sample = _slim(docs).filter(drawn).mapInArrow(run, "i binary, v binary, junk double").limit(2 * train_rows).collect()
    rows = [(np.frombuffer(r.i, np.int32).astype(np.int64), np.frombuffer(r.v, np.float32).astype(np.float64)) for r in sample]
    return QualityModel(labels, fit_scorer(rows, np.array([r.junk for r in sample])))


def scored(docs: DataFrame, model: QualityModel) -> DataFrame:
    """Per row: ``doc_id``, ``junk_votes``, ``votes``, ``posterior`` (of the label model), ``score`` (junk, by the linear
    scorer) and ``kept``.

    A document goes when the scorer calls it junk; one on which no labeller has an opinion (under four words, null or empty)
    is kept. Rows that repeat get the same result; null doc_ids pass through; extra columns are ignored; an empty table
    gives no rows.
    """
    ship(docs.sparkSession)
    labels, weights = model.labels, model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = _Features()
        for batch in batches:
            if not batch.num_rows:
                continue
            votes, scores = [], []
            for text in batch.column(1).to_pylist():
                seen = _read(text)
                index, value = features.vector(seen)
                votes.append(seen.votes)
                scores.append(1 / (1 + math.exp(-max(-50.0, min(50.0, float(weights[index] @ value))))))
            table = np.array(votes)
            cast = (table >= 0).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array((table == 1).sum(axis=1).astype(np.int32)),
                    pa.array(cast.astype(np.int32)),
                    pa.array(labels.posterior(table)),
                    pa.array(scores, pa.float64()),
                    pa.array((np.array(scores) < 0.5) | (cast == 0)),
                ],
                names=["doc_id", "junk_votes", "votes", "posterior", "score", "kept"],
            )

    return _slim(docs).mapInArrow(run, "doc_id bigint, junk_votes int, votes int, posterior double, score double, kept boolean")


def sound_documents(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of ``docs`` that the scorer keeps, with all their columns, in one pass without a shuffle."""
    ship(docs.sparkSession)
    weights, at = model.weights, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = _Features()
        for batch in batches:
            good = []
            for text in batch.column(at).cast(pa.binary()).to_pylist():
                seen = _read(text)
                index, value = features.vector(seen)
                good.append(max(seen.votes) < 0 or float(weights[index] @ value) < 0)
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
