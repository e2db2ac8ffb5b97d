"""Toxicity scores learned from confirmed toxic texts and unlabelled text alone.

Non-negative positive-unlabelled learning: with p(f) the mean logistic loss of the positives taken
as positive, q(f) that of the positives taken as negative, u(f) that of unlabelled text taken as negative, and
the class prior c, the risk of a linear classifier f is c p(f) + max(0, u(f) - c q(f)). Where the
second part falls below zero, which only over-fitting does, its gradient is turned around. Labels other than
the toxic ones are not used, nor for the prior: that is estimated from the two samples.

Features are the distinct words of the whole text and their beginnings, so the length of a text does not dilute a
single insult. Near copies share one weight, or the words of one often-copied text would look like signs of
toxicity. An L1 penalty that shrinks with the number of positives leaves few words with a weight.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop_table, in_arrow, written
from .word_pool import slices

POSITIVES = 4000  # sampled toxic texts, at most
UNLABELLED = 8000  # sampled texts of the training rows, whatever their label, at most
MOST_WORDS = 4_000_000  # distinct words of each text, added up over a sample, at most
STEPS = 400
RATE = 0.05
PENALTY = 0.03
HASHES = 8
RARE = 0.01  # share of the sample's texts that a rare word occurs in, at most
LEAST_DOCS = 3  # positive texts of the sample that a feature must occur in
LIFT = 1.5  # and how many times more often there than in unlabelled text
FIRST_PRIOR = 0.1  # of the classifier that the prior is estimated with
LEAST_PRIOR = 1e-3

STEMS = (4, 5, 6)  # letters of the beginnings of words that count as features beside the words

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def with_stems(words: set[str]) -> set[str]:
    """Words and the beginnings of longer ones, led by a mark, so that inflected words share a feature."""
    return words | {"^" + w[:n] for w in words for n in STEMS if len(w) > n}


def features_of(text: str | None) -> set[str]:
    return with_stems(words_of(text))


@dataclass
class Linear:
    """Weights of words and an offset; the score is the logistic function of their sum."""

    weight: dict[str, float]
    offset: float

    def score_of(self, features: set[str]) -> float:
        z = self.offset + math.fsum(self.weight[w] for w in features & self.weight.keys())
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0

    def score(self, texts: list[str | None]) -> list[float]:
        return [self.score_of(features_of(t)) for t in texts]


class _Rows:
    """Word numbers of a set of texts, one after another, each text led by the constant feature 0."""

    def __init__(self, texts: list[list[str]], number: dict[str, int], weight: np.ndarray):
        rows = [[0, *sorted(number[w] for w in t if w in number)] for t in texts]
        size = np.array([len(r) for r in rows], np.int64)
        self.start = np.cumsum(size) - size
        self.size = size
        self.word = np.concatenate([np.array(r, np.int64) for r in rows])
        self.weight = weight / weight.sum()

    def loss(self, z: np.ndarray) -> float:
        """Weighted mean of the logistic loss."""
        return float(np.logaddexp(0, -z) @ self.weight)

    def logits(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(w[self.word], self.start)

    def gradient(self, each: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(self.word, np.repeat(each * self.weight, self.size), n)


def family_weights(texts: list[list[str]], rare: set[str]) -> np.ndarray:
    """Less weight for texts that share their rare words with others, so that near copies count about once.

    A text's weight is the mean, over ``HASHES`` orders of the rare words, of one over the number of
    texts that have the same first word.
    """
    number = {w: zlib.crc32(w.encode()) for w in rare}
    own = [[number[w] for w in t if w in number] for t in texts]
    size = np.array([len(t) for t in own])
    start, some = (np.cumsum(size) - size)[size > 0], size > 0
    flat = np.array([x for t in own for x in t], np.uint64)
    total = np.ones(len(texts)) * HASHES  # a text without rare words is like no other
    total[some] = 0
    for k in range(HASHES if len(flat) else 0):
        first = np.minimum.reduceat(flat * np.uint64((2 * k + 3) * 2654435761) & np.uint64(0xFFFFFFFF), start)
        _, which, alike = np.unique(first, return_inverse=True, return_counts=True)
        total[some] += 1 / alike[which]
    return total / HASHES


def _slope(z: np.ndarray) -> np.ndarray:
    """Derivative of the logistic loss."""
    return -1 / (1 + np.exp(np.clip(z, -60, 60)))


def train(positive: list[list[str]], unlabelled: list[list[str]], prior: float | None = None) -> Linear:
    """Minimises the non-negative risk; without either kind of text every score is the same and low.

    Without a ``prior`` it is estimated from the two samples: a classifier fitted to every other text is tried on the rest.
    """
    if not positive or not unlabelled:
        return Linear({}, math.log(LEAST_PRIOR / (1 - LEAST_PRIOR)))
    if prior is None:
        first = _fitted(positive[::2], unlabelled[::2], FIRST_PRIOR)
        prior = estimated_prior(*(np.array([first.score_of(set(t)) for t in x[1::2]]) for x in (positive, unlabelled)))
    return _fitted(positive, unlabelled, min(max(prior, LEAST_PRIOR), 0.5))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The largest share of positives that the unlabelled scores leave room for: the least ratio, over thresholds, of the unlabelled
    and the positive texts above the threshold, taken where half of the positives are above it."""
    if not len(positive) or not len(unlabelled):
        return FIRST_PRIOR
    at = np.unique(np.quantile(positive, np.linspace(0, 0.5, 26)))
    above = lambda x: 1 - np.searchsorted(np.sort(x), at) / len(x)
    p, u = above(positive), above(unlabelled)
    return float(((u + 1 / len(unlabelled)) / p).min())


def _fitted(positive: list[list[str]], unlabelled: list[list[str]], prior: float) -> Linear:
    often = Counter(w for t in positive for w in t)
    other = Counter(w for t in unlabelled for w in t if w in often)
    least = LIFT * len(positive) / len(unlabelled)
    words = sorted(w for w, k in often.items() if k >= LEAST_DOCS and k >= least * other[w])  # others are no sign of anything
    number = {w: i + 1 for i, w in enumerate(words)}
    n, rare = len(words) + 1, {w for w, k in often.items() if w[0] != "^" and k + other[w] <= RARE * (len(positive) + len(unlabelled))}
    p, u = (_Rows(t, number, family_weights(t, rare)) for t in (positive, unlabelled))
    families = 1 / (p.weight**2).sum()
    shrink = PENALTY * prior * math.sqrt(math.log(n + 1) / families)
    w, mean, square = np.zeros(n), np.zeros(n), np.zeros(n)
    w[0] = math.log(prior / (1 - prior))
    for step in range(1, STEPS + 1):
        g = gradient(p, u, w, prior)
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        pace = RATE / (np.sqrt(square / (1 - 0.999**step)) + 1e-3)
        w = w - pace * mean / (1 - 0.9**step)
        w[1:] = np.sign(w[1:]) * np.maximum(0, np.abs(w[1:]) - pace[1:] * shrink)
    return Linear({x: float(w[i]) for x, i in number.items() if w[i]}, float(w[0]))


def risk(p: _Rows, u: _Rows, w: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk: that of the positives, and that of the negatives before it is kept from falling below zero."""
    zp, zu = p.logits(w), u.logits(w)
    return prior * p.loss(zp), u.loss(-zu) - prior * p.loss(-zp)


def gradient(p: _Rows, u: _Rows, w: np.ndarray, prior: float) -> np.ndarray:
    """Of the whole risk; where its second part is below zero, that part's gradient turned around."""
    zp, zu = p.logits(w), u.logits(w)
    down = u.gradient(-_slope(-zu), len(w)) - prior * p.gradient(-_slope(-zp), len(w))
    return prior * p.gradient(_slope(zp), len(w)) + down if risk(p, u, w, prior)[1] >= 0 else -down


def in_fold(id_: Column) -> Column:
    """Rows that learning may not see."""
    return F.crc32(id_.cast("string")) % 5 == 0


def _sample(rows: DataFrame, most: int) -> list[list[str]]:
    """Features of the distinct texts of a sample, in order of their places, ``most`` texts and ``MOST_WORDS`` words at most."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch, 1)):
            found = [sorted(words_of(t)) for t in part.column(1).to_pylist()]
            columns = [part.column(0), pa.array([len(w) for w in found], pa.int64()), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["place", "size", "words"])

    found, path = written(rows.select("place", "text").transform(in_arrow, work, "place double, size long, words array<string>"), "toxicity-sample")
    order = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row for each sampled text
    last = found.select("place", F.sum("size").over(order).alias("upto"), F.row_number().over(Window.orderBy("place")).alias("n"))
    last = last.where((F.col("n") <= most + most // 4) & (F.col("upto") <= MOST_WORDS)).agg(F.max("place").alias("last")).first()["last"]
    texts: dict[tuple[str, ...], float] = {}
    one: dict[str, str] = {}  # a word is held once
    for batch in found.where(F.col("place") <= F.lit(last)).select("place", "words").toArrow().to_batches(max_chunksize=256) if last is not None else []:
        for place, words in zip(batch["place"].to_pylist(), batch["words"].to_pylist(), strict=True):
            text = tuple(one.setdefault(w, w) for w in words)
            texts[text] = min(place, texts.get(text, 2.0))
    drop_table(rows.sparkSession, path)
    held = sorted(texts, key=lambda t: (texts[t], t))[:most]
    return [[one.setdefault(w, w) for w in sorted(with_stems(set(t)))] for t in held]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Linear:
    """Learns from rows whose crc32 of the id, as text, is not a multiple of 5: from texts labelled as toxic, and from texts
    whatever their label. That a text is labelled as not toxic is not used.

    A hash of the id decides which texts are sampled, so the same tables give the same model. An id that is
    labelled more than once counts as toxic if any of its labels says so. The ids of the toxic sample, bounded by ``POSITIVES``,
    are broadcast, so no text is moved to find its label.
    """
    place = (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / (1 << 30)).alias("place")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.where(F.col("id").isNotNull() & ~in_fold(F.col("id"))).select("id", "text", place)
    toxic = labels.where((F.col("toxic") >= 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id")).where(~in_fold(F.col("id"))).distinct()
    n_toxic, n_docs = toxic.count(), rows.count()
    if not n_toxic or not n_docs:
        return train([], [])
    margin = lambda most, n: min(1.0, (most + 4 * math.sqrt(most)) / n)
    chosen = toxic.select("id", place).where(F.col("place") < margin(POSITIVES, n_toxic)).select("id")
    confirmed = rows.where(F.col("place") < margin(POSITIVES, n_toxic)).join(F.broadcast(chosen), "id", "left_semi")
    anything = rows.where(F.col("place") < margin(UNLABELLED, n_docs))
    return train(_sample(confirmed, POSITIVES), _sample(anything, UNLABELLED))


def score(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", learn_from: DataFrame | None = None
) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from 0.5 on) of every row of ``docs``.

    Null and empty texts get the score of a text without words. A null id takes no part in learning and has
    held_out null. Without labels every score is the same, below 0.5. Only the text enters a score.
    """
    model = fit(docs if learn_from is None else learn_from, labels, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most the words of the bounded sample

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2)):
            found = shared.value.score(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.float64()), pa.array([int(s >= 0.5) for s in found], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), in_fold(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.transform(in_arrow, work, f"doc_id {kind}, held_out boolean, score double, predicted int")
