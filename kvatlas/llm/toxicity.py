"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence scores p = sigmoid(bias + sum of the weights of its distinct words),
a word's weight being its own and those of its first four and five letters, which stand for its stem. Weights
aren't negative, so a long sentence can't talk an offending word down. The document's score is the noisy-or
1 - product(1 - p). Weights are learned from document labels alone, by gradient steps on the log-loss of the
noisy-or with a small L1 term, and the sentence scores then locate what offends.

The fit uses a bounded sample of labelled rows, the first ``most_rows`` by a hash of the id, of at most ``most_chars``
code points each, and of these as many as hold ``most_features`` features; only features of ``least_docs`` documents
count. Words and stems are 64-bit hashes, made in the tasks: what comes to the driver are the sampled documents as
numbers of their features, never texts. Weights that end at 0 are left out, no others. Texts are scored whole.

Results for odd input: null and empty texts have no sentences and score 0; long texts are scored whole; repeated
rows get the same result; rows without a label aren't learned from; without any label all scores are 0; an empty
table gives an empty result, and a table without texts trains nothing. Extra columns are left out, so names can't clash.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvatlas.llm.langid import fold
from kvatlas.llm.shared import dropped, stored, table

MOST_ROWS, MOST_CHARS, MOST_FEATURES, LEAST_DOCS, STEPS, RATE, LASSO, FIRST_BIAS = 5000, 20_000, 4_000_000, 4, 100, 0.1, 1e-5, -7.0
SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n+")
WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence, in code points."""
    out, start = [], 0
    for m in SENTENCE_END.finditer(text):
        if m.start() > start:
            out.append((start, m.start()))
        start = m.end()
    if start < len(text):
        out.append((start, len(text)))
    return out


def features(word: str) -> tuple[int, ...]:
    """Hashes of the word and of its stems; a hyphen marks a stem."""
    names = (word, word[:4] + "-", word[:5] + "-") if len(word) > 4 else (word, word + "-")
    return tuple(xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63) for x in names)


class Kept(dict):
    """word -> ``of(word)``, kept between texts; emptied when it holds ``limit`` words."""

    def __init__(self, of, limit: int = 200_000) -> None:
        super().__init__()
        self.of, self.limit = of, limit

    def __missing__(self, word: str):
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.of(word)
        return value


def words_of(text: str) -> Iterator[tuple[int, int, set[str]]]:
    """Start, end and distinct words of each sentence."""
    low = text.lower()
    same = len(low) == len(text)
    for a, b in sentences(text):
        yield a, b, set(WORD.findall(low[a:b] if same else text[a:b].lower()))


def bag(text: str, kept: Kept) -> tuple[list[int], list[int]]:
    """The number of features of each sentence, and all these features, one behind the other."""
    sizes, found = [], []
    for _, _, words in words_of(text):
        before = len(found)
        for w in sorted(words):
            found += kept[w]
        sizes.append(len(found) - before)
    return sizes, found


class Model:
    """``codes``: ascending hashes of features; ``weights``: theirs."""

    def __init__(self, codes: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.codes, self.weights, self.bias = codes, weights, bias
        own = dict(zip(codes.tolist(), weights.tolist(), strict=True))
        self.words = Kept(lambda word: sum(own.get(f, 0.0) for f in features(word)))

    def __reduce__(self):
        return Model, (self.codes, self.weights, self.bias)

    def sentence_scores(self, text: str) -> list[tuple[int, int, float]]:
        """Start, end and sum of weights of each sentence; the sum doesn't depend on the words' order."""
        return [(a, b, math.fsum(map(self.words.__getitem__, words))) for a, b, words in words_of(text)]

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The noisy-or over sentences, and each sentence's start, end and score."""
        if not text:
            return 0.0, []
        spans = self.sentence_scores(text)
        z = np.array([s[2] for s in spans]) + self.bias
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())), [(a, b, float(q)) for (a, b, _), q in zip(spans, p, strict=True)]


def fit(codes: np.ndarray, labels: list[int], n_sentences: np.ndarray, sizes: np.ndarray, word_of: np.ndarray, steps: int = STEPS) -> Model:
    """Noisy-or by gradient descent (Adam) over all the sample at once.

    Documents have ``n_sentences`` each, sentences have ``sizes`` features each, ``word_of`` are their places in ``codes``.
    """
    words = codes
    doc_of = np.repeat(np.arange(len(labels)), n_sentences)
    sent_of = np.repeat(np.arange(len(sizes)), sizes)
    word_of = word_of.astype(np.int64)
    y = np.array(labels, float)
    weight = np.full(len(y), 1.0 / len(y))
    bias = FIRST_BIAS
    m, v = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    # start from the words' smoothed log-odds, which the bags' gradient then sharpens
    in_doc = np.unique(doc_of[sent_of] * max(1, len(words)) + word_of) if len(word_of) else np.empty(0, np.int64)
    has = np.bincount(in_doc % max(1, len(words)), minlength=len(words))
    bad = np.bincount(in_doc % max(1, len(words)), weights=y[in_doc // max(1, len(words))], minlength=len(words))
    base = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    w = np.clip(np.log((bad + 0.5) / (has - bad + 0.5)) - base, 0, 6) * (has >= 8)
    for t in range(1, steps + 1):
        z = np.bincount(sent_of, weights=w[word_of], minlength=len(doc_of)) + bias
        p = np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))), 1e-9, 1 - 1e-9)
        log_none = np.bincount(doc_of, weights=np.log1p(-p), minlength=len(y))
        doc = np.clip(-np.expm1(log_none), 1e-9, 1 - 1e-9)
        # d loss / d z of a sentence: p if the label is 0, and -p (1 - P) / P if it is 1
        up = (weight * np.where(y == 1, -(1 - doc) / doc, 1.0))[doc_of] * p
        grad = np.concatenate((np.bincount(word_of, weights=up[sent_of], minlength=len(words)) + np.full(len(words), LASSO), [up.sum()]))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, bias = np.maximum(w - step[:-1], 0), bias - step[-1]  # words add evidence and never take it away
    good = w > 0
    return Model(codes[good], w[good], float(bias))


def fit_bags(bags: list[tuple[list[int], list[int]]], labels: list[int], least_docs: int = LEAST_DOCS, steps: int = STEPS) -> Model:
    """``fit`` from each document's ``bag``, of which features of ``least_docs`` documents count."""
    codes, count = np.unique(np.concatenate([np.unique(np.array(f, np.int64)) for _, f in bags]), return_counts=True)
    codes = codes[count >= least_docs]
    own = [known(codes, np.array(s, np.int64), np.array(f, np.int64)) for s, f in bags]
    return fit(codes, labels, np.array([len(s) for s, _ in own]), np.concatenate([s for s, _ in own]), np.concatenate([f for _, f in own]), steps)


def known(codes: np.ndarray, sizes: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bag's sizes and features, with only features of ``codes`` left and named by their places there."""
    at = np.searchsorted(codes, found)
    at[at == len(codes)] = 0
    good = codes[at] == found if len(codes) else np.zeros(len(found), bool)
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    return np.bincount(sentence[good], minlength=len(sizes)), at[good].astype(np.int32)


def train(docs: DataFrame, labels: DataFrame, usable: Column, most_rows: int = MOST_ROWS, most_chars: int = MOST_CHARS, most_features: int = MOST_FEATURES,
          least_docs: int = LEAST_DOCS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """Fit on a bounded sample of the labelled rows where ``usable`` holds (a condition on doc_id)."""
    labelled = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(usable & F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    spot = F.xxhash64(F.col("doc_id").cast("string"), F.lit(11)).alias("spot")
    chosen = labelled.distinct().select("doc_id", "y", spot).orderBy("spot", "doc_id", "y").limit(most_rows)
    # the sample has most_rows rows at most, which is what bounds the broadcast
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.length("text").between(1, most_chars)).join(F.broadcast(chosen), "doc_id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Kept(features)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                own = [bag(t, kept) for t in part.column("text").to_pylist()]
                columns = [part.column(c) for c in ("doc_id", "y", "spot", "second")]
                columns += [pa.array([s for s, _ in own], pa.list_(pa.int32())), pa.array([f for _, f in own], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "y", "spot", "second", "sizes", "found"])

    rows = texts.select("doc_id", "y", "spot", F.xxhash64("text").alias("second"), "text")
    bags = stored(rows.mapInArrow(read, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, y int, spot long, second long, sizes array<int>, found array<long>"), "bags")
    key = ["spot", "doc_id", "y", "second"]
    order = bags.select(*key, F.size("found").alias("n")).distinct().orderBy(*key).limit(most_rows).collect()
    ends = np.cumsum([r["n"] for r in order])
    order = order[: max(1, int(np.searchsorted(ends, most_features, side="right")))]
    if not order:
        return None
    last = order[-1]
    ahead = F.struct(*key) <= F.struct(*[F.lit(last[c]).cast(bags.schema[c].dataType) for c in key])
    sample = bags.where(ahead).dropDuplicates(key)
    counts = sample.select(F.explode(F.array_distinct("found")).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    codes = np.sort(counts.where(F.col("n") >= least_docs).select("code").toArrow().column("code").to_numpy())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [known(codes, np.array(s, np.int64), np.array(f, np.int64)) for s, f in zip(batch.column("sizes").to_pylist(), batch.column("found").to_pylist(), strict=True)]
            columns = [batch.column(c) for c in ("spot", "id", "y", "second")]
            columns += [pa.array([x[k].astype(np.int32) for x in own], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, ["spot", "id", "y", "second", "sizes", "found"])

    numbered = sample.select("spot", F.col("doc_id").cast("string").alias("id"), "y", "second", "sizes", "found")
    got = numbered.mapInArrow(number, "spot long, id string, y int, second long, sizes array<int>, found array<int>").toArrow()
    dropped(bags)
    got = got.sort_by([(c, "ascending") for c in ("spot", "id", "y", "second")])
    sizes, found = (got.column(c).combine_chunks() for c in ("sizes", "found"))
    n_sentences = np.diff(sizes.offsets.to_numpy())
    return fit(codes, got.column("y").to_pylist(), n_sentences, sizes.flatten().to_numpy(), found.flatten().to_numpy())


def scored(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, offending: array of (start, end, score) of the sentences that score 0.5 or more."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [model.score(t or "") if model else (0.0, []) for t in batch["text"]]
            offending = [[{"start": a, "end": b, "score": p} for a, b, p in spans if p >= 0.5] for _, spans in rows]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": [s for s, _ in rows], "offending": offending})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(score, "doc_id long, score double, offending array<struct<start:int,end:int,score:double>>")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels, ~fold("doc_id", 3, 1))
    return scored(docs, model).select(
        "doc_id",
        fold("doc_id", 3, 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
        F.size("offending").alias("n_offending"),
    )
