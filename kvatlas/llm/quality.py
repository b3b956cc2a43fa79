"""Quality by positive-unlabelled learning.

Only documents with label 1 are trusted; all other text of the web is unlabelled, and label 0 is never learned from.
A linear model f over a document's features is fitted to the non-negative unbiased risk with the logistic loss,

    prior * R_positives(+1) + max(0, R_unlabelled(-1) - prior * R_positives(-1)),

by minibatches: where the part in max() falls below 0, the step goes back up along it. The score is sigmoid(f), an estimate of
the probability of label 1. The class prior is estimated first: a plain classifier of positives against
unlabelled texts is fitted on one half of the sample, and on the other half the prior is the least ratio, over all
thresholds, of the shares of unlabelled and positive texts above a threshold, with confidence margins (the best bin).

Features, all of the whole text: the shapes of words (letters, capitals, digits, each mark, with runs as one) and pairs of
neighbouring shapes as shares in ``BUCKETS`` hashed buckets, and shares that say how much repeats (words that
equal the one before, distinct words and pairs of words, the commonest word, repeated lines), what characters there are, and sizes.

The fit uses a bounded sample (parameters): ``most_positives`` documents of label 1 and ``most_unlabelled`` documents of any
kind, each the first by a hash of id (positives) or of id and text (unlabelled). What comes to the driver are numbers, a row of
``BUCKETS`` and some more for each sampled document, however long the texts are.

Results for odd input: null text counts as empty, and empty texts get the score of a text without words; long texts are
scored whole; repeated rows get the same result; a document that has both labels isn't trusted; ids without a row teach nothing;
without any positive document all scores are 0; an empty table gives an empty result. Extra columns are left out, so names can't clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvatlas.llm.langid import fold
from kvatlas.llm.shared import dropped, stored, table

MOST_POSITIVES, MOST_UNLABELLED, BUCKETS, EPOCHS, BATCHES, RATE, RIDGE, DELTA = 3000, 6000, 512, 40, 12, 0.02, 1e-4, 0.1
STATISTICS = 14
CUT = 0.7
_LETTERS, _RUNS = re.compile(r"[^\W\d_]+"), re.compile(r"(.)\1+", re.DOTALL)


def shape(word: str) -> str:
    """The word with A, Aa or a for a run of letters, 0 for digits, and runs of one mark as one."""
    said = lambda m: "a" if m.group().islower() else "A" if m.group().isupper() else "Aa" if m.group()[0].isupper() and m.group()[1:].islower() else "aA"
    return _RUNS.sub(r"\1", re.sub(r"\d+", "0", _LETTERS.sub(said, word)))[:32]


class Words(dict):
    """word -> its row of ``known``: hash of the shape, and its letters in lower and upper case, digits and other code points."""

    def __init__(self, limit: int = 200_000) -> None:
        super().__init__()
        self.limit, self.known, self.shapes = limit, np.zeros((1024, 5), np.int64), {}

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        if at == len(self.known):
            self.known = np.concatenate((self.known, np.zeros_like(self.known)))
        n = len(word)
        low = n if word.isalpha() and word.islower() else sum(map(str.islower, word))
        high, digits = (0, 0) if low == n else (sum(map(str.isupper, word)), sum(map(str.isdigit, word)))
        own = "a" if low == n else shape(word)
        if own not in self.shapes:
            self.shapes[own] = xxhash.xxh64_intdigest(own.encode("utf-8", "surrogatepass")) & (1 << 56) - 1
        self.known[at] = self.shapes[own], low, high, digits, n - low - high - digits
        return at

    def of(self, words: list[str]) -> np.ndarray:
        """The words' places in ``known``. Between texts, what is known is forgotten beyond ``limit`` words."""
        if len(self) > self.limit:
            self.clear()
            self.shapes.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def features(text: str, kept: Words) -> np.ndarray:
    """Statistics, then square roots of the shares of shapes and of pairs of shapes."""
    out = np.zeros(STATISTICS + BUCKETS, np.float32)
    words = text.split()
    if not words:
        return out
    word = kept.of(words)
    rows = kept.known[word]
    form, (low, high, digits, marks) = rows[:, 0], rows[:, 1:].sum(0).tolist()
    n, chars = len(words), len(text)
    pair = np.concatenate((form[:1], form)) * 31 + np.concatenate((form, form[-1:])) * 7 + 1
    half = BUCKETS // 2
    out[STATISTICS : STATISTICS + half] = np.sqrt(np.bincount(form % half, minlength=half) / n)
    out[STATISTICS + half :] = np.sqrt(np.bincount((pair ^ (pair >> 29)) % half, minlength=half) / (n + 1))
    count = np.diff(_starts(np.sort(word)))
    pairs = len(_starts(np.sort(word[1:] << 32 | word[:-1]))) - 1
    line_count = Counter(x for x in text.split("\n") if x)
    lines = max(1, line_count.total())
    repeated = sum(c * len(x) for x, c in line_count.items() if c > 1)
    out[:STATISTICS] = (
        np.log1p(n), np.log1p(chars / n), np.log1p(n / lines),
        np.count_nonzero(word[1:] == word[:-1]) / n, len(count) / n, count.max() / n, np.log(len(count)) / np.log1p(n), pairs / max(1, n - 1),
        len(line_count) / lines, repeated / chars, low / chars, high / chars, digits / chars, marks / chars,
    )
    return out


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values start, and the end."""
    return np.concatenate((np.flatnonzero(np.concatenate((np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1]))), [len(ordered)]))


class Model:
    """Standardised features, weighted."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, bias: float, prior: float) -> None:
        self.mean, self.scale, self.weights, self.bias, self.prior = mean, scale, weights, bias, prior

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6).astype(np.float64) @ self.weights + self.bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.margin(x))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def risks(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """Both parts of the risk, before max(): of positives, and of negatives as unlabelled less positives."""
    soft = lambda z: np.logaddexp(0, z).mean()
    return prior * soft(-zp), soft(zu) - prior * soft(zp)


def slopes(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """By how much the step's target changes with each margin; the part of negatives is turned round where it is below 0."""
    below = risks(zp, zu, prior)[1] < 0
    p, u = prior * _sigmoid(zp) / len(zp), _sigmoid(zu) / len(zu)
    return (p, -u) if below else (-prior * _sigmoid(-zp) / len(zp) - p, u)


def descend(positives: np.ndarray, unlabelled: np.ndarray, step, seed: int, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias by minibatches (Adam). ``step``: margins of both to slopes of both."""
    rng = np.random.default_rng(seed)
    w = np.zeros(positives.shape[1] + 1)
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    parts = max(1, min(BATCHES, len(positives) // 20, len(unlabelled) // 20))
    for epoch in range(epochs):
        for p, u in zip(np.array_split(rng.permutation(len(positives)), parts), np.array_split(rng.permutation(len(unlabelled)), parts), strict=True):
            xp, xu = positives[p], unlabelled[u]
            gp, gu = step(xp @ w[:-1] + w[-1], xu @ w[:-1] + w[-1])
            g = np.append(gp @ xp + gu @ xu + RIDGE * w[:-1], gp.sum() + gu.sum())
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - RATE * (1 - epoch / epochs) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def class_prior(zp: np.ndarray, zu: np.ndarray, delta: float = DELTA) -> float:
    """Share of positives among the unlabelled: the best bin of scores, by its upper confidence bound."""
    cuts = np.unique(np.concatenate((zp, zu)))
    qp, qu = (1 - np.searchsorted(np.sort(z), cuts) / len(z) for z in (zp, zu))
    margin = np.sqrt(np.log(4 / delta) / 2 / len(zp)) + np.sqrt(np.log(4 / delta) / 2 / len(zu))
    with np.errstate(divide="ignore", invalid="ignore"):
        best = np.argmin(np.where(qp > 0, (qu + 1.01 * margin) / qp, np.inf))
    return float(np.clip(qu[best] / qp[best], 0.01, 1))


def fit(positives: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, seed: int = 5) -> Model:
    """Fit on features of trusted and unlabelled texts, each in a fixed order; the prior is estimated unless given."""
    every = np.concatenate((positives, unlabelled))
    mean, scale = every.mean(0), np.maximum(every.std(0), 1e-3)
    xp, xu = (np.clip((x - mean) / scale, -6, 6).astype(np.float64) for x in (positives, unlabelled))
    if prior is None:
        plain = lambda zp, zu: (-_sigmoid(-zp) / len(zp) / 2, _sigmoid(zu) / len(zu) / 2)
        if min(len(xp), len(xu)) < 4:
            prior = 0.5
        else:
            w, b = descend(xp[::2], xu[::2], plain, seed, EPOCHS // 4)
            prior = class_prior(xp[1::2] @ w + b, xu[1::2] @ w + b)
    w, b = descend(xp, xu, lambda zp, zu: slopes(zp, zu, prior), seed)
    return Model(mean, scale, w, b, prior)


def _featured(rows: DataFrame) -> DataFrame:
    """``rows`` (.., text) with ``x``, the features, in place of the text."""
    names = [c for c in rows.columns if c != "text"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Words()
        for batch in batches:
            x = [features(t.as_py() or "", kept) for t in batch.column("text")]
            flat = pa.array(np.concatenate(x) if x else np.empty(0, np.float32))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * (STATISTICS + BUCKETS), flat)], [*names, "x"])

    types = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in names]
    return rows.select(*names, "text").mapInArrow(read, ", ".join([*types, "x array<float>"]))


def _sampled(rows: DataFrame, most: int) -> np.ndarray:
    """Features of ``most`` rows (spot, text) at most, in order of spot."""
    last = rows.select("spot").distinct().orderBy("spot").limit(most).agg(F.max("spot")).head()[0]
    if last is None:
        return np.empty((0, STATISTICS + BUCKETS), np.float32)
    own = stored(_featured(rows.where(F.col("spot") <= last).dropDuplicates(["spot"])), "sample")
    got = own.toArrow().sort_by("spot")
    dropped(own)
    return got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, STATISTICS + BUCKETS)


def train(docs: DataFrame, labels: DataFrame, usable: Column, most_positives: int = MOST_POSITIVES, most_unlabelled: int = MOST_UNLABELLED,
          id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """Fit on bounded samples of the rows where ``usable`` holds (a condition on doc_id)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(usable & F.col("doc_id").isNotNull())
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(usable & F.col("doc_id").isNotNull())
    trusted = marks.groupBy("doc_id").agg(F.min("y").alias("y")).where("y = 1")
    spot = F.xxhash64(F.col("doc_id").cast("string"), F.lit(13))
    # most_positives rows at most, which is what bounds the broadcast; of rows with one id, one
    chosen = trusted.select("doc_id", spot.alias("spot")).orderBy("spot", "doc_id").limit(most_positives)
    positives = rows.join(F.broadcast(chosen), "doc_id").groupBy("spot").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    xp = _sampled(positives, most_positives)
    if not len(xp):
        return None
    return fit(xp, _sampled(rows.select(F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(17)).alias("spot"), "text"), most_unlabelled))


def scored(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = Words()
        for batch in batches:
            x = [features(t or "", kept) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": model.scores(np.array(x).reshape(-1, STATISTICS + BUCKETS)) if model else 0.0})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(score, "doc_id long, score double")


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels, ~fold("doc_id", 4, 2))
    return scored(docs, model).select("doc_id", fold("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
