"""Dedup, mixing, packing, the Jaccard join and the pipeline against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from kvatlas.llm import exact_dedup, mixing, ngram_jaccard, packing
from kvatlas.llm.components import components
from kvatlas.llm.shingles import WordHashes, shingle_set

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, norm string, size int"


def corpus(seed=0, n=160):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " \t\n", "one", "one two three", "One TWO three", "x " * 4000, "é ü"]
    for _ in range(n // 4):
        base = rng.choices(words, k=rng.choice([5, 9, 20, 60, 200]))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            near = list(base)
            for _ in range(rng.randint(0, 3)):
                near[rng.randrange(len(near))] = rng.choice(words)
            texts.append(rng.choice([" ", "  \n"]).join(near))
    rows = [(i, t, "en", rng.choice(["s1", "s2", "s3", None, "S"]), 0, "clash", 7) for i, t in enumerate(texts)]
    return rows + [rows[5], rows[9], (None, "no id", "en", "s1", 0, "clash", 7)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_exact_groups(docs):
    rows = corpus()
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i))
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(docs, salts=3).collect())
    want = Counter()
    for i, t, *_ in rows:
        g = groups[norm(t)]
        best = min(g, key=lambda x: (x[0], x[1], x[2] or 0))
        want[i, best[2], len(g), (-len(t or ""), i) == (best[0], best[2])] += 1
    assert got == want
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0 and exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_exact_keeps_the_longest_of_rows_that_share_an_id(spark):
    for rows in ([(1, "ab"), (1, "a   b")], [(1, "a   b"), (1, "ab")], [(None, "ab"), (None, "a   b"), (None, "a   b")]):
        df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, _sha string, best string")
        for n in (1, 4):
            assert [r["text"] for r in exact_dedup.exact_dedup(df.repartition(n)).collect()] == ["a   b"]


def test_exact_hot_group_and_long_text(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT", 3)
    long = "ab c" * 700_000
    rows = [(i, " hot text" + " " * (i % 3)) for i in range(4000)] + [(9000, long), (9001, long + "\n"), (9002, None), (9003, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(df).collect()}
    assert len(got) == len(rows) and all(got[i] == (2, 4000, i == 2) for i in range(4000))
    assert got[9000] == (9001, 2, False) and got[9001] == (9001, 2, True) and got[9002] == (9002, 1, True) and got[9003] == (9003, 1, True)
    assert sorted(r["doc_id"] for r in exact_dedup.exact_dedup(df).select("doc_id").collect()) == [2, 9001, 9002, 9003]


def water_fill(sizes, weights):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while True:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total >= 2 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            open_.discard(s)
        left = 1.5 * sum(sizes.values()) - sum(target.values())
        if not open_:
            break
    return target | {s: left * w[s] / sum(w[x] for x in open_) for s in open_}


def test_mixing(docs):
    rows = [r for r in mixing.copies(docs).collect()]
    assert len(rows) == len(corpus())
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert 0 <= r["copies"] <= 2
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
    want = water_fill(dict(sizes), mixing.WEIGHTS)
    largest = max(r["size"] for r in rows)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 2 * largest
    again = sorted((r["doc_id"] or -1, r["copies"]) for r in mixing.copies(docs.repartition(7)).collect())
    assert again == sorted((r["doc_id"] or -1, r["copies"]) for r in rows)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in rows)
    assert mixing.copies(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_mix_repeated_rows_and_rows_without_id(spark):
    rows = [(None, "a b c", "s1", "x")] * 300 + [(None, "d e f", "s1", f"y{i}") for i in range(40)] + [(7, "g h", "s2", "z")] * 9 + [(8, "g h", "s2", "z"), (9, None, None, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _size string")
    taken, had = Counter(), Counter(rows)
    for r in mixing.mix(df.repartition(5)).collect():
        taken[r["doc_id"], r["text"], r["source"], r["_size"]] += 1
    assert all(taken[r] <= 2 * had[r] for r in taken) and set(taken) <= set(had)
    want = Counter()
    for r in mixing.copies(df).collect():
        want[r["source"]] += r["copies"]
    got = Counter()
    for r, n in taken.items():
        got[r[2]] += n
    assert got == +want
    again = Counter(tuple(r) for r in mixing.mix(df).collect())
    assert again == taken


def test_mixing_buckets_and_counted_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STEP", 7)
    rows = [(None, "a b c", "s1")] * 300 + [(None, f"w{i} x", "s1") for i in range(50)] + [(i, "a " * (i % 9), "s2") for i in range(60)] + [(3, None, None)] * 15
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    result = lambda b: sorted(map(repr, mixing.copies(df, buckets=b).collect()))
    assert len(result(1)) == len(rows) and result(1) == result(5) == result(100_000) == result(None)
    of_source, taken = Counter(), Counter()
    for r in mixing.placed(df).collect():
        assert r["n"] in (1, 15, 300)
        of_source[r["source"]] += r["n"]
    assert of_source == Counter(r[2] for r in rows)
    for r in mixing.copies(df).where("source = 's1'").collect():
        taken[r["size"]] += r["copies"]
    for size, n in ((3, 300), (2, 50)):  # each size class has its share to within a copy
        rate = mixing.placed(df).where("source = 's1'").selectExpr("max(rate)").head()[0]
        assert abs(taken[size] - n * rate) <= 1


def test_exact_dedup_picks_alike_rows_the_same_way(spark):
    rows = [(1, "a b", f"s{i % 40}", {"k": i}) for i in range(200)] + [(2, "c", "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra map<string,int>").select("doc_id", "text", "source", "extra")
    first = {(r["doc_id"], r["source"]) for r in exact_dedup.exact_dedup(df).collect()}
    assert len(first) == 2
    for parts in (1, 3, 11):
        assert {(r["doc_id"], r["source"]) for r in exact_dedup.exact_dedup(df.repartition(parts).orderBy("source")).collect()} == first


def test_packing(docs):
    lengths = (32, 64, 256)
    rows = packing.packed(docs, lengths=lengths, shard_docs=40).collect()
    want = Counter()
    for i, t, *_ in corpus():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1
        want[i] += n
    got, bins = Counter(), {}
    for r in rows:
        got[r["doc_id"]] += r["n_tokens"]
        bins.setdefault(r["bin_id"], []).append(r)
    assert got == want
    for own in bins.values():
        own.sort(key=lambda r: r["bin_offset"])
        used = sum(r["n_tokens"] for r in own)
        assert {r["bin_used"] for r in own} == {used} and {r["bin_length"] for r in own} == {min(c for c in lengths if c >= used)}
        assert [r["bin_offset"] for r in own] == [sum(x["n_tokens"] for x in own[:k]) for k in range(len(own))]
    pieces = [(r["doc_id"], r["piece"]) for r in rows if r["doc_id"] == 6]  # 4,001 tokens
    assert sorted(p for _, p in pieces) == list(range(16))
    assert packing.packed(docs.limit(0)).count() == 0


def cheapest(sizes, lengths, open_cost):
    """The least cost of any packing, over all ways to part the sizes into bins."""

    def go(rest, bins):
        if not rest:
            return sum(min(c for c in lengths if c >= b) + open_cost for b in bins)
        out = go(rest[1:], bins + [rest[0]])
        for k in range(len(bins)):
            if bins[k] + rest[0] <= lengths[-1]:
                out = min(out, go(rest[1:], bins[:k] + [bins[k] + rest[0]] + bins[k + 1 :]))
        return out

    return go(list(sizes), [])


def test_best_fit_by_brute_force():
    """The same rule by plain searches over all bins and all sizes to come."""
    rng = random.Random(3)
    for _ in range(50):
        sizes = sorted((rng.randint(1, 60) for _ in range(40)), reverse=True)
        down = lambda used: min(c for c in (16, 32, 64) if c >= used) + 4
        for may in ((64,), (32, 64), (16, 32, 64)):
            cost, bins = packing.Shard(sizes, (16, 32, 64), 4).pack(may)
            room, contents = [], []
            for i, s in enumerate(sizes):
                fits = [(r, b) for b, r in enumerate(room) if r >= s]
                if fits:
                    b = min(fits)[1]
                else:
                    trial = []
                    for length in [c for c in may if c >= s]:
                        held = s
                        for later in sizes[i + 1 :]:
                            held += later if held + later <= length else 0
                        trial.append((down(held) / held, length))
                    room.append(min(trial)[1])
                    contents.append([])
                    b = len(room) - 1
                room[b] -= s
                contents[b].append(i)
            assert contents == bins and cost == sum(down(sum(sizes[i] for i in own)) for own in bins)


def test_packing_optimises_lengths_jointly():
    better = optimal = 0
    for seed in range(150):
        rng = random.Random(seed)
        lengths, open_cost = rng.choice([(4, 7, 12), (3, 10), (5, 6, 9, 16)]), rng.randint(0, 3)
        sizes = sorted([rng.randint(1, lengths[-1]) for _ in range(rng.randint(1, 7))], reverse=True)
        shard = packing.Shard(sizes, lengths, open_cost)
        cost, bins = shard.best()
        assert sorted(m for b in bins for m in b) == list(range(len(sizes)))
        used = [sum(sizes[m] for m in b) for b in bins]
        assert cost == sum(min(c for c in lengths if c >= u) + open_cost for u in used)
        single = min(shard.pack((c,))[0] for c in lengths if c >= sizes[0])
        least = cheapest(sizes, lengths, open_cost)
        assert least <= cost <= single and cost <= 1.35 * least
        better += cost < single
        optimal += cost == least
    assert better >= 1 and optimal >= 120
    # planted: fours fill bins of four, tens those of ten; one length alone can't do as well
    shard = packing.Shard([10] * 6 + [4] * 10, (4, 10), 1)
    assert shard.best()[0] == 6 * 11 + 10 * 5 < shard.pack((10,))[0]


def test_packing_spreads_equal_rows(spark):
    rows = [(None, "a b c")] * 3000 + [(7, "a b")] * 1500 + [(8, "w " * 30_000), (8, "w " * 30_000)]
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, text string"), shard_docs=100)
    shards = got.where("bin_id not like 'full-%'").selectExpr("split(bin_id, '-')[0] as shard").groupBy("shard").count().collect()
    assert max(r["count"] for r in shards) < 200 and sum(r["count"] for r in shards) == 4502
    own = got.where("doc_id = 8").collect()
    assert Counter((r["piece"], r["n_tokens"]) for r in own) == Counter({(0, 8192): 2, (1, 8192): 2, (2, 8192): 2, (3, 30_001 - 3 * 8192): 2})
    assert len({r["bin_id"] for r in own if r["piece"] < 3}) == 6

def brute_components(rows, k, num, den):
    words = WordHashes()
    sets = [set(shingle_set(t, k, words).tolist()) for _, t, *_ in rows]
    parent = {i: i for i, *_ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a][0], rows[b][0]
            if x is None or y is None or not sets[a] or not sets[b]:
                continue
            i = len(sets[a] & sets[b])
            if i * den >= len(sets[a] | sets[b]) * num:
                p, q = root(x), root(y)
                parent[max(p, q)] = min(p, q)
    return Counter((i, len(s), None if i is None else root(i)) for (i, *_), s in zip(rows, sets, strict=True))


@pytest.mark.parametrize("k, num, small, block", [(4, 85, 16, 512), (1, 60, 1, 4)])
def test_jaccard_components(docs, k, num, small, block):
    got = ngram_jaccard.jaccard_components(docs, k=k, numerator=num, denominator=100, small=small, block=block)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute_components(corpus(), k, num, 100)


def chained(n=60):
    """Documents around a common half: walks of small steps, so families are large and their ends far apart."""
    rng = random.Random(12)
    common = [f"c{i}" for i in range(60)]
    rows, i = [], 0
    for walk in range(6):
        own = [f"w{walk}x{j}" for j in range(rng.choice([20, 60, 90]))]
        for _ in range(n // 6):
            own[rng.randrange(len(own))] = f"n{rng.randint(0, 40)}"
            rows.append((i, " ".join(common + own), "en", "s", 0, "clash", 7))
            i += 1
    rng.shuffle(rows)
    return rows + rows[:5] + rows[:2]


@pytest.mark.parametrize("rounds, block, shingles, hot, k, num", [(0, 8, 10**6, 65536, 1, 80), (3, 7, 500, 3, 3, 85)])
def test_jaccard_families(spark, monkeypatch, rounds, block, shingles, hot, k, num):
    monkeypatch.setattr(ngram_jaccard, "HOT", hot)
    rows = chained()
    df = spark.createDataFrame(rows, SCHEMA)
    got = ngram_jaccard.jaccard_components(df, k=k, numerator=num, small=2, block=block, block_shingles=shingles, rounds=rounds)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute_components(rows, k, num, 100)


def test_jaccard_empty_and_dedup(docs):
    assert ngram_jaccard.jaccard_components(docs.limit(0)).count() == 0
    kept = ngram_jaccard.near_dedup(docs)
    want = {c for (_, _, c) in brute_components(corpus(), 5, 80, 100) if c is not None}
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == want | {None}


def test_linked_sets_agree_in_a_fragment():
    rng = np.random.default_rng(7)
    for num in (60, 80, 85):
        levels = ngram_jaccard.Levels(num, 100)
        for _ in range(400):
            n = int(rng.integers(2, 300))
            base = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
            m = int(rng.integers(0, max(1, levels.differ(n, n)) + 1))
            other = np.concatenate((base[m // 2 :], rng.integers(0, 1 << 63, m - m // 2, dtype=np.uint64) * np.uint64(2)))
            a, b = np.unique(base), np.unique(other)
            i = len(np.intersect1d(a, b))
            if i * 100 >= (len(a) + len(b) - i) * num and not np.array_equal(a, b):
                emitted = [set(np.concatenate([ngram_jaccard.signatures(s, v, levels)[0] for v in range(max(0, levels.of(len(s)) - 1), levels.of(len(s)) + 1)]).tolist()) for s in (a, b)]
                assert emitted[0] & emitted[1]


def test_agreeing_runs_over_batches():
    sig = np.repeat([1, 2, 3, 4, 5, 6], [1, 3, 1, 9, 2, 2])
    ids = np.concatenate([np.arange(c) for c in (1, 3, 1, 9, 2, 2)])
    for step in (1, 2, 5, 50):
        batches = [pd.DataFrame({"signature": sig[i : i + step], "doc_id": ids[i : i + step]}) for i in range(0, len(sig), step)]
        out = pd.concat(list(ngram_jaccard._agreeing(iter(batches), 4)))
        pairs = sorted(map(tuple, out[out.kind < 2][["a", "b"]].to_numpy().tolist()))
        assert pairs == [(0, 1), (0, 1), (0, 2), (1, 2)]  # of signatures 2 and 5
        members = Counter(out[out.kind == 2]["a"].tolist())
        assert members == {1: 1, 4: 9, 6: 2}  # edges and the large run


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 312)] + [(500, 500 + i) for i in range(1, 60)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "mix", "pack"]
    df = docs.select("doc_id", "text", "lang", "source", "n_chars")
    stages = dict(corpus_pipeline.STAGES)
    first = stages["language"](spark, df, "")
    want = Counter(i for i, t, *_ in corpus() if t and re.search("[^\\W\\d_]", t))
    assert Counter(r["doc_id"] for r in first.collect()) == want and first.columns == df.columns
    second = stages["exact"](spark, first, "")
    third = stages["near"](spark, second, "")
    fourth = stages["mix"](spark, third, "")
    assert second.columns == third.columns == fourth.columns == df.columns
    assert second.count() == len({norm(t) for i, t, *_ in corpus() if i in want})
    rows = [(r["doc_id"], r["text"]) for r in second.collect()]
    assert {r["doc_id"] for r in third.collect()} - {None} == {c for (_, _, c) in brute_components(rows, 5, 80, 100) if c is not None}
    none = df.limit(0)
    assert all(f(spark, none, "").count() == 0 for _, f in corpus_pipeline.STAGES if f is not stages["near"])
    last = stages["pack"](spark, fourth, "")
    assert Counter(r["doc_id"] for r in last.where("piece = 0").collect()) == Counter(r["doc_id"] for r in fourth.collect())


def test_pipeline_run(spark, tmp_path):
    """The whole run against its parts by brute force, with odd rows, a text of megabytes, and clashing columns."""
    import corpus_pipeline
    from kvatlas.llm import langid

    rng, rows = random.Random(5), []
    say = lambda lang, n: " ".join(rng.choices({"en": "the and of house river stone".split(), "de": "der und von haus fluss stein".split()}[lang], k=n))
    for i in range(80):
        lang = rng.choice(["en", "de"])
        rows.append((i, say(lang, 40), lang, rng.choice(["s1", "s2", None]), i))
    rows += [(100, rows[0][1], "en", "s1", 0), (101, rows[1][1].replace(" ", "  "), "en", "s1", 0), (102, None, "en", "s1", 0), (103, "123 !!", "en", "s1", 0)]
    rows += [(104, rows[2][1] + " extra", "en", "s2", 0), (None, say("en", 50), None, "s1", 0), (105, say("de", 300_000), "de", "s3", 0), rows[3], rows[3]]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _keep string, size int")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = [r for r in rows if r[1] and re.search("[a-z]", r[1])]
    best: dict = {}
    for r in kept:
        k = norm(r[1])
        rank = (-len(r[1]), r[0] is None, r[0] or 0)
        if k not in best or rank < best[k][0]:
            best[k] = (rank, r)
    unique = [r for _, r in best.values()]
    firsts = {c for _, _, c in brute_components(unique, 5, 80, 100) if c is not None}
    near = [r for r in unique if r[0] is None or r[0] in firsts]
    copies = Counter()
    mixed = spark.createDataFrame(near, "doc_id long, text string, lang string, source string, n_chars long")
    for r in mixing.copies(mixed).collect():
        copies[r["doc_id"]] += r["copies"]
    want = Counter()
    for r in near:
        n = len(r[1].split()) + 1
        for k in range(-(-n // 8192)):
            want[r[0], k, min(8192, n - 8192 * k)] += copies[r[0]]
    assert Counter((r["doc_id"], r["piece"], r["n_tokens"]) for r in got) == +want
    assert langid.UNKNOWN == "und" and len(near) < len(rows) - 5
