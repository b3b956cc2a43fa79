"""Positive-unlabelled quality: the risk's gradient by numbers, the class prior, held-out rows, odd rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from kvatlas.llm import quality

ODD = [(0, None), (1, ""), (2, "  \n\t "), (3, "Zażółć İΣς 12,5 %% ... あ"), (4, "word " * 3000), (5, "same"), (5, "same"), (None, "no id"), (6, "\n".join(["a line of text"] * 50_000))]


def numeric(f, z):
    out = np.zeros_like(z)
    for i in range(len(z)):
        e = np.zeros_like(z)
        e[i] = 1e-5
        out[i] = (f(z + e) - f(z - e)) / 2e-5
    return out


@pytest.mark.parametrize("prior", [0.2, 0.9])
def test_slopes_are_those_of_the_risk(prior):
    rng, seen = np.random.default_rng(1), set()
    for shift in (-3, 0, 3):
        zp, zu = rng.normal(shift, 1, 7), rng.normal(-shift, 2, 9)

        def soft(z):
            return float(np.mean([np.log(1 + np.exp(v)) for v in z]))

        def whole(p, u):
            negative = soft(u) - prior * soft(p)
            return -negative if soft(zu) - prior * soft(zp) < 0 else prior * soft(-p) + negative

        seen.add(soft(zu) - prior * soft(zp) < 0)
        gp, gu = quality.slopes(zp, zu, prior)
        np.testing.assert_allclose(gp, numeric(lambda p: whole(p, zu), zp), atol=1e-6)
        np.testing.assert_allclose(gu, numeric(lambda u: whole(zp, u), zu), atol=1e-6)
        np.testing.assert_allclose(sum(quality.risks(zp, zu, prior)), prior * soft(-zp) + soft(zu) - prior * soft(zp))
    assert prior < 0.5 or seen == {True, False}


@pytest.mark.parametrize("prior", [0.3, 0.6, 0.9])
def test_prior_and_risk_on_planted_mixtures(prior):
    rng = np.random.default_rng(2)
    p = rng.normal(1.5, 1, (2000, 3)).astype(np.float32)
    good = rng.random(4000) < prior
    u = np.where(good[:, None], rng.normal(1.5, 1, (4000, 3)), rng.normal(-1.5, 1, (4000, 3))).astype(np.float32)
    model = quality.fit(p, u)
    assert abs(model.prior - prior) < 0.08
    s = model.scores(u)
    assert ((s >= 0.5) == good).mean() > 0.97
    # the score is the probability of the label: about as many are good as it says
    assert abs(s.mean() - prior) < 0.08


def test_features_are_shares():
    text = "The cat, the cat, the CAT 12 %%\nThe cat\nThe cat\n"
    x = quality.features(text, quality.Words())
    words = text.split()
    count, lines = Counter(words), [y for y in text.split("\n") if y]
    pairs = set(zip(words, words[1:], strict=False))
    want = [
        np.log1p(len(words)), np.log1p(len(text) / len(words)), np.log1p(len(words) / 3), 0, len(count) / len(words), max(count.values()) / len(words),
        np.log(len(count)) / np.log1p(len(words)), len(pairs) / (len(words) - 1), len(set(lines)) / 3, 2 * 7 / len(text),
        *[len(re.findall(k, text)) / len(text) for k in ("[a-z]", "[A-Z]", r"\d", r"[,%]")],
    ]
    np.testing.assert_allclose(x[: quality.STATISTICS], want, rtol=1e-6)
    half = quality.BUCKETS // 2
    np.testing.assert_allclose([(x[quality.STATISTICS :][k : k + half] ** 2).sum() for k in (0, half)], [1, 1], rtol=1e-5)
    assert [quality.shape(w) for w in ("The", "cat,,", "CAT", "12.5%%", "iPhone7", "été")] == ["Aa", "a,", "A", "0.0%", "aA0", "a"]
    small = quality.Words(2)
    again = [quality.features(text, small) for _ in range(3)]
    assert all((y == x).all() for y in again)


def prose(rng, junk):
    words = ["".join(rng.choices("aeioulnrst", k=rng.randint(2, 8))) for _ in range(rng.randint(20, 60))]
    if junk == 1:
        return " | ".join(words)
    if junk == 2:
        return " ".join(w.upper() + "!!" for w in words)
    return ". ".join(" ".join(words[i : i + 7]).capitalize() for i in range(0, len(words), 7)) + "."


def test_held_out_labels(spark):
    rng = random.Random(3)
    junk = {i: rng.choice((0, 0, 0, 1, 2)) for i in range(1500)}
    docs = spark.createDataFrame([(i, prose(rng, k), "x") for i, k in junk.items()], "doc_id long, text string, score string").repartition(4)
    labels = spark.createDataFrame([(i, int(k == 0), 0) for i, k in junk.items() if i % 2], "doc_id long, quality int, toxic int")
    usable = ~quality.fold("doc_id", 4, 2)
    model = quality.train(docs, labels, usable)
    assert abs(model.prior - 0.6) < 0.08
    rows = {r["doc_id"]: r["score"] for r in quality.scored(docs, model).collect()}
    held = [i for i in junk if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(rows[i] >= quality.CUT) == (junk[i] == 0) for i in held]) > 0.98
    # labels 0, and what isn't usable, teach nothing; nor does the order of rows
    other = labels.where("quality = 1").unionByName(spark.createDataFrame([(10**6, 1, 0)], labels.schema))
    same = quality.train(docs.repartition(3), other, usable)
    assert np.array_equal(same.weights, model.weights) and same.bias == model.bias
    assert quality.train(docs, labels.where("quality = 0"), usable) is None
    few = quality.train(docs, labels, usable, most_positives=50, most_unlabelled=100)
    assert few is not None and quality.train(docs, labels.limit(0), usable) is None


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in ODD], "doc_id long, text string, score string, x int")
    labels = spark.createDataFrame([(3, 1), (4, 1), (4, 0), (None, 1), (5, 1), (5, None), (77, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels, ~quality.fold("doc_id", 4, 2))
    rows = quality.scored(docs, model).collect()
    assert sorted(map(repr, (r["doc_id"] for r in rows))) == sorted(repr(i) for i, _ in ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (0, 1, 2)}) == 1 and len({r["score"] for r in rows if r["doc_id"] == 5}) == 1
    assert quality.scored(docs.limit(0), model).count() == 0 and quality.train(docs.limit(0), labels, ~quality.fold("doc_id", 4, 2)) is None
    assert {r["score"] for r in quality.scored(docs, None).collect()} == {0.0}
