"""PII, toxicity, language, JPEG, tokens and chat against brute force, round trips and held-out labels."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kvatlas.llm import chat, jpeg, langid, media, pii, tokens, toxicity

ODD = [(0, None), (1, ""), (2, "  \n\t "), (3, "Zażółć <|endoftext|> 'll İΣς"), (4, "word " * 3000), (5, "same"), (5, "same"), (None, "no id"), (6, "12345 !!")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, a long text, repeated rows and columns whose names clash."""
    rows = [(i, t, "x", 1) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, media string, n_bytes int")


def test_merkle_fold_equals_the_whole_tree():
    for n in range(70):
        leaves, fold = [bytes([i]) * 16 for i in range(n)], tokens.MerkleFold()
        for leaf in leaves:
            fold.add(leaf)
        assert fold.root() == tokens.merkle(leaves) and sum(x is not None for x in fold.levels) <= 7


def test_pii_equals_plain_patterns():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    anchors, rng = pii.automaton(), random.Random(1)
    for _ in range(20_000):
        t = "".join(rng.choices(list("0123456789" * 3 + ".. -@+()aZ_%,İé\n\t"), k=rng.randint(0, 40)))
        if rng.random() < 0.3:
            t = t.replace("a", "4111111111111111").replace("Z", "x@y.zz@q.ww")
        got = pii.find_spans(t, anchors)
        digits = lambda m: re.sub("[^0-9]", "", m.group())
        assert got["email"] == [m.span() for m in email.finditer(t)]
        assert got["ip"] == [m.span() for m in pii.IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
        assert got["card"] == [m.span() for m in pii.CARD.finditer(t) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
        assert got["phone"] == [m.span() for m in pii.PHONE.finditer(t) if 9 <= len(digits(m)) <= 15]


def test_pii_extra_kinds():
    t = 'IBAN DE89 3704 0044 0532 0130 00 see https://a.b/c?d. token = "24be64439e3e49cf" account no: 12345678, ibanez'
    got = pii.find_spans(t, pii.automaton())
    texts = {k: [t[a:b] for a, b in v] for k, v in got.items()}
    assert texts["account"] == ["DE89 3704 0044 0532 0130 00", "12345678"]
    assert texts["url"] == ["https://a.b/c?d"] and texts["secret"] == ["24be64439e3e49cf"]


def test_pii_odd_rows(odd):
    assert pii.pii_spans(odd).count() == len(ODD) and pii.pii_spans(odd.limit(0)).count() == 0


def test_jpeg_round_trip():
    rng = np.random.default_rng(0)
    payloads = [rng.integers(0, 256, 64 * k, dtype=np.uint8).tobytes() for k in (1, 2, 7, 8, 9, 63, 64, 65, 200)] + [bytes(64), b"\xff" * 128]
    images = [jpeg.parse(x) for x in jpeg.encode_payloads(payloads)]
    for p, m, c in zip(payloads, images, jpeg.decode(images), strict=True):
        assert jpeg.BYTE[c[1].ravel() + 256].tobytes()[: len(p)] == p
        assert jpeg.thumbnail(m, c).shape == (-(-m.height // 8), -(-m.width // 8))


def test_jpeg_colour_with_subsampling_and_no_restart():
    """A 4:2:0 image coded by hand: four luminance blocks to an MCU, runs of zeros, early ends of blocks."""
    dc, ac = ([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], list(range(12))), ([0, 2, 1, 2, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0], [0x01, 0x00, 0x22, 0xF0, 0x13])
    dcc, acc = jpeg.codes_of(dc), jpeg.codes_of(ac)
    rng, bits, want, last = random.Random(2), "", {1: [], 2: [], 3: []}, {1: 0, 2: 0, 3: 0}

    def put(code, n):
        nonlocal bits
        bits += format(code, f"0{n}b")

    def value(v):
        size = abs(v).bit_length()
        if size:
            put(v if v > 0 else v + (1 << size) - 1, size)

    for _ in range(4):  # 32 x 32 pixels are 2 x 2 MCUs
        for c, blocks in ((1, 4), (2, 1), (3, 1)):
            for _ in range(blocks):
                block = [0] * 64
                block[0] = rng.randint(-60, 60)
                d, last[c] = block[0] - last[c], block[0]
                put(*dcc[abs(d).bit_length()])
                value(d)
                block[3] = rng.choice((-3, -2, 2, 3))
                put(*acc[0x22])  # two zeros, then two bits
                value(block[3])
                if rng.random() < 0.5:
                    put(*acc[0xF0])  # sixteen zeros
                    block[3 + 18] = rng.choice((-7, -4, 4, 7))
                    put(*acc[0x13])
                    value(block[21])
                put(*acc[0x00])
                want[c].append(block)
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    seg = jpeg._segment
    data = (
        b"\xff\xd8" + seg(0xDB, bytes([0]) + bytes([4] * 64)) + seg(0xC0, bytes([8, 0, 32, 0, 32, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
        + seg(0xC4, bytes([0x00]) + bytes(dc[0]) + bytes(dc[1]) + bytes([0x10]) + bytes(ac[0]) + bytes(ac[1]))
        + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    )
    image = jpeg.parse(data)
    (got,) = jpeg.decode([image])
    assert all(got[c].tolist() == want[c] for c in want)
    thumb = jpeg.thumbnail(image, got[0] if isinstance(got, list) else got)
    assert thumb.shape == (4, 4) and thumb[0, 0] == min(255, max(0, want[1][0][0] * 4 // 8 + 128)) and thumb[1, 0] == min(255, max(0, want[1][2][0] * 4 // 8 + 128))


def test_jpeg_of_one_scan_for_each_component():
    rng = random.Random(11)
    payloads = [rng.randbytes(64 * 64) for _ in range(3)]  # 8 x 8 blocks each
    grey = [jpeg.parse(x) for x in jpeg.encode_payloads(payloads)]
    whole, seg = jpeg.encode_payloads(payloads[:1])[0], jpeg._segment
    sof = seg(0xC0, bytes([8, 0, 64, 0, 64, 3, 1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0]))
    head = whole[: whole.index(b"\xff\xc0")] + sof + whole[whole.index(b"\xff\xc4") : whole.index(b"\xff\xda")]
    scans = b"".join(seg(0xDA, bytes([1, c, 0, 0, 63, 0])) + grey[c - 1].scan for c in (2, 1, 3))
    image = jpeg.parse(head + scans + b"\xff\xd9")
    (got,) = jpeg.decode([image])
    assert list(got) == [1] and jpeg.BYTE[got[1].ravel() + 256].tobytes() == payloads[0]
    assert jpeg.thumbnail(image, got).tolist() == jpeg.thumbnail(grey[0], jpeg.decode(grey[:1])[0]).tolist()


def test_jpeg_pieces(monkeypatch):
    rng = random.Random(12)
    payloads = [bytes(rng.choices(b"plain text \xff\x00\n", k=64 * n)) for n in (1, 7, 8, 9, 300, 64, 65)]
    images = jpeg.encode_payloads(payloads)
    monkeypatch.setattr(jpeg, "PIECE", 1500)
    assert jpeg.encode_payloads(payloads) == images
    parsed = [jpeg.parse(x) for x in images]
    for p, m, c in zip(payloads, parsed, jpeg.decode(parsed), strict=True):
        assert jpeg.BYTE[c[1].ravel() + 256].tobytes()[: len(p)] == p
    big = b"a long text " * 500_000 + bytes(-12 * 500_000 % 64)
    monkeypatch.setattr(jpeg, "PIECE", 1 << 21)
    (image,) = jpeg.encode_payloads([big])
    (c,) = jpeg.decode([jpeg.parse(image)])
    assert jpeg.BYTE[c[1].ravel() + 256].tobytes()[: len(big)] == big


def test_media_odd_rows(spark, odd):
    rows = media.media_features(media.store_texts(odd)).collect()
    assert len(rows) == len(ODD) and all(r["error"] is None for r in rows)
    for doc, text in ODD:
        b = (text or "").encode()
        p = b + bytes((-len(b) % 64) or (0 if b else 64))
        r = next(r for r in rows if r["doc_id"] == doc)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    bad = spark.createDataFrame([(1, 0, None), (2, 0, bytearray(b"no image")), (3, 0, bytearray(jpeg.encode_payloads([bytes(64)])[0][:-20]))], "doc_id long, n_bytes long, media binary")
    assert [r["error"] is not None for r in media.media_features(bad).orderBy("doc_id").collect()] == [True, True, True]
    assert media.media_features(media.store_texts(odd.limit(0))).count() == 0


def test_words_encode_like_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole, by_word, rng = Tokenizer.from_file(path), tokens.encoder(path).arrays, random.Random(3)
    letters = list("aZ'sdtÉé́İßΣς  \x1c\x85​<|endoftext|>09٣.,-_ \n\t\x0b") + ["<|endoftext|>", "<|ENDOFTEXT|>", "'ll", "é"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 14))) for _ in range(5000)]
    for t, ids in zip(texts, by_word(texts), strict=True):
        assert whole.encode(t, add_special_tokens=False).ids + [tokens.END_ID] == ids.tolist()


def test_chunks_move_with_their_text():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 49_000, 20_000).astype(np.uint32), rng.integers(0, 49_000, 777).astype(np.uint32)
    pieces = lambda x: {x[s:e].tobytes() for s, e in zip([0, *tokens.cuts(x)[0][:-1]], tokens.cuts(x)[0], strict=True)}
    both = pieces(a) & pieces(np.concatenate((b, a)))
    assert len(both) > 0.9 * len(pieces(a)) and tokens.cuts(a)[0][-1] == len(a)
    # texts side by side are cut as each is alone
    one = tokens.cuts(np.concatenate((b, a, b[:5])), np.array([0, 777, 20_777, 20_782]))
    assert [[c - o for c in own] for own, o in zip(one, (0, 777, 20_777), strict=True)] == [tokens.cuts(b)[0], tokens.cuts(a)[0], [5]]


def test_store_reconstructs(spark, odd):
    import public_tokenizers

    from kvatlas.llm.shared import scratch

    path = scratch(spark, "test")
    encode = tokens.encoder(public_tokenizers.path("word_bpe_49k.json")).arrays
    tokens.write_store(odd, path, public_tokenizers.path("word_bpe_49k.json"))
    sums = tokens.document_sums(spark, path).collect()
    assert len(sums) == len(ODD) and all(r["verified"] for r in sums)
    order, start = sorted(ODD, key=lambda x: (x[0] is not None, x[0] or 0)), 0
    for (doc, text), r in zip(order, sorted(sums, key=lambda r: r["start"]), strict=True):
        ids = encode([text])[0].astype("<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    whole = {(r["doc_id"], r["start"]): bytes(r["ids"]) for r in tokens.reconstruct(spark, path).collect()}
    assert whole[4, next(r["start"] for r in sums if r["doc_id"] == 4)] == encode(["word " * 3000])[0].astype("<u4").tobytes()
    assert tokens.chunks(spark, path).count() == tokens.chunks(spark, path).select("digest").distinct().count()
    assert tokens.reconstruct(spark, path, spark.createDataFrame([(4,)], "doc_id long")).count() == 1
    empty = scratch(spark, "test")
    tokens.write_store(odd.limit(0), empty, public_tokenizers.path("word_bpe_49k.json"))
    assert tokens.document_sums(spark, empty).count() == 0


def test_crc_of_parts():
    rng = random.Random(4)
    for _ in range(50):
        a, b = rng.randbytes(rng.randint(0, 300)), rng.randbytes(rng.randint(0, 300))
        moved = tokens.crc_moved(np.array([zlib.crc32(a)]), np.array([len(b)]))
        assert int(moved[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_known_words_are_forgotten_when_too_many(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(tokens, "WORDS_KEPT", 3)
    path = public_tokenizers.path("word_bpe_49k.json")
    small, texts = tokens.Encoder(path), ["one two three four, 12 x", None, "five two. one", "été a-b"]
    assert [x.tolist() for t in texts for x in small.arrays([t])] == [x.tolist() for x in tokens.encoder(path).arrays(texts)]


WORDS = {"xx": "alpha bravo charlie delta echo", "yy": "uno dos tres cuatro cinco seis"}


def sample(n):
    rng = random.Random(6)
    return [(i, " ".join(rng.choices(WORDS[y].split(), k=rng.randint(3, 30))), y) for i in range(n) for y in [rng.choice(["xx", "yy"])]]


def test_language_held_out(spark):
    docs = spark.createDataFrame(sample(300), "doc_id long, text string, lang string")
    model = langid.train(docs, ~langid.fold("doc_id", 4, 2))
    rows = {r["doc_id"]: r for r in langid.predicted(docs, model).collect()}
    held = [(i, y) for i, _, y in sample(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(rows[i]["lang_pred"] == y and 0 <= rows[i]["score"] <= 1 for i, y in held) and held


def test_language_kernel_by_brute_force():
    texts = [t for _, t, _ in sample(40)]
    labels = [y for _, _, y in sample(40)]
    model = langid.fit(texts, labels, landmarks=16)
    known = set(model.codes.tolist())
    for t in texts[:5]:
        g = langid.grams(t)
        b = t.lower().encode()
        plain = {int.from_bytes(b"\x01" + b[i : i + n], "big") for n in (1, 2, 3) for i in range(len(b) - n + 1)}
        assert set(g.tolist()) == plain
        rows = [i for i, c in enumerate(model.codes.tolist()) if c in plain & known]
        want = model.weights[rows].sum(0) / np.sqrt(len(plain)) + model.bias
        assert np.allclose(model.scores([t])[0], want, atol=1e-4)


def test_language_model_equals_nystrom_ridge():
    """The folded weights against kernels from plain sets, and the ridge solution written out."""
    texts, labels = [t for _, t, _ in sample(60)], [y for _, _, y in sample(60)]
    sets = []
    for t in texts:
        b = t.lower().encode()
        sets.append({b[i : i + n] for n in (1, 2, 3) for i in range(len(b) - n + 1)})
    kernel = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    seen, turn = {}, []
    for y in labels:
        seen[y] = seen.get(y, 0) + 1
        turn.append(seen[y])
    z = sorted(range(60), key=lambda i: (turn[i], i))[:16]
    values, vectors = np.linalg.eigh(kernel[np.ix_(z, z)])
    good = values > 1e-6 * values[-1]
    x = kernel[:, z] @ (vectors[:, good] / np.sqrt(values[good]))
    names = sorted(set(labels))
    y = np.array([[1.0 if a == b else -1.0 for b in names] for a in labels])
    weight = np.array([60 / len(names) / labels.count(a) for a in labels])
    xm, ym = np.average(x, 0, weight), np.average(y, 0, weight)
    w = np.linalg.solve((x - xm).T @ ((x - xm) * weight[:, None]) + langid.RIDGE * 60 * np.eye(x.shape[1]) * 0.1, (x - xm).T @ ((y - ym) * weight[:, None]))
    want = (x - xm) @ w + ym
    assert np.allclose(langid.fit(texts, labels, landmarks=16).scores(texts)[0], want, atol=1e-3)


def test_language_has_no_cap_on_languages(spark):
    rng, rows = random.Random(2), []
    for k in range(230):
        own = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(5)]
        rows += [(8 * k + j, " ".join(rng.choices(own, k=12)), f"l{k}") for j in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, ~langid.fold("doc_id", 4, 2))
    assert len(model.languages) == 230
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predicted(docs, model).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i] == y for i, y in held) > 0.95 * len(held)


def test_language_odd_rows(spark, odd):
    rows = {r["doc_id"]: r for r in langid.predicted(odd, langid.fit(["ab cd", "uv xy"], ["a", "b"])).collect()}
    assert {rows[i]["lang_pred"] for i in (0, 1, 2, 6)} == {"und"} and rows[4]["lang_pred"] in ("a", "b")
    unlabelled = odd.selectExpr("doc_id", "text", "cast(null as string) lang")
    assert langid.train(unlabelled, langid.fold("doc_id", 1, 0)) is None
    assert {r["lang_pred"] for r in langid.predicted(unlabelled, None).collect()} == {"und"}
    kept = langid.accepted(odd, langid.fit(["ab cd", "uv xy"], ["a", "b"]), 0.0)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 4
    model, none = langid.fit(["ab cd", "uv xy"], ["a", "b"]), odd.limit(0)
    assert langid.predicted(none, model).count() == 0 and langid.accepted(none, model, 0.5).count() == 0
    # hot ids and repeated rows don't fill the sample
    hot = spark.createDataFrame([(None, "same text", "a")] * 3000 + [(i, f"uvw {i}", "b") for i in range(50)], "doc_id long, text string, lang string")
    assert langid.train(hot, F.lit(True), per_language=20).languages == ["a", "b"]
    long = spark.createDataFrame([(1, "ab cd " * 400_000)], "doc_id long, text string")
    assert langid.predicted(long, model).head()["lang_pred"] == "a"


def test_toxicity_learns_from_document_labels():
    rng = random.Random(8)
    plain = [f"w{rng.randint(0, 80)}" for _ in range(4000)]
    plain = [re.sub(r"\d", lambda m: "abcdefghij"[int(m.group())], w) for w in plain]
    docs, labels = [], []
    for i in range(400):
        own = [" ".join(rng.choices(plain, k=8)) for _ in range(6)]
        if i % 4 == 0:
            own[rng.randrange(6)] += rng.choice([" vilestuff", " vilething", " grossword"])
        docs.append(". ".join(own) + ".")
        labels.append(int(i % 4 == 0))
    kept = toxicity.Kept(toxicity.features)
    model = toxicity.fit_bags([toxicity.bag(t, kept) for t in docs[:300]], labels[:300])
    for t, y in zip(docs[300:], labels[300:], strict=True):
        score, spans = model.score(t)
        assert (score >= 0.7) == bool(y)
        none = np.prod([1 - p for _, _, p in spans])
        assert abs(score - (1 - none)) < 1e-6
        if y:  # and the sentence is found
            assert [("vile" in t[a:b] or "gross" in t[a:b]) for a, b, p in spans if p >= 0.5] == [True]


def test_toxicity_odd_rows(odd):
    model = toxicity.Model(np.array([toxicity.features("same")[0]]), np.array([20.0]), -7.0)
    rows = [(r["doc_id"], r["score"]) for r in toxicity.scored(odd, model).collect()]
    assert len(rows) == len(ODD) and all(0 <= s <= 1 for _, s in rows) and sum(s > 0.7 for _, s in rows) == 2
    assert toxicity.scored(odd, None).count() == len(ODD) and toxicity.scored(odd.limit(0), model).count() == 0


def test_toxicity_training_in_tasks_equals_training_at_hand(spark):
    rng, rows = random.Random(3), []
    for i in range(120):
        text = ". ".join(" ".join(rng.choices(["alpha", "bravo", "charlie", "delta"], k=6)) for _ in range(3))
        rows.append((i, text + " vilest" * (i % 3 == 0), int(i % 3 == 0)))
    rows += [rows[0], rows[0], (None, "no id", 1), (500, None, 1), (501, "", 0), (502, "w " * 20_000, 1)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(7, None), (8, 5), (999, 1)], "doc_id long, toxic int")
    every = F.lit(True)
    model, again = toxicity.train(docs, labels, every), toxicity.train(docs.repartition(7), labels.repartition(3), every)
    assert np.array_equal(model.codes, again.codes) and np.array_equal(model.weights, again.weights) and model.bias == again.bias
    kept = toxicity.Kept(toxicity.features)
    here = toxicity.fit_bags([toxicity.bag(t, kept) for _, t, _ in rows[:120]], [y for _, _, y in rows[:120]])
    assert np.array_equal(model.codes, here.codes) and np.allclose(model.weights, here.weights, atol=1e-6)
    assert all((model.score(t)[0] >= 0.7) == bool(y) for _, t, y in rows[:120])
    # bounds: rows, features; nothing to learn from
    assert toxicity.train(docs, labels, every, most_rows=60) is not None and toxicity.train(docs, labels, every, most_features=300) is not None
    assert toxicity.train(docs, labels, F.lit(False)) is None and toxicity.train(docs.limit(0), labels, every) is None and toxicity.train(docs, labels.limit(0), every) is None


def test_texts_that_no_language_claims_go(spark):
    docs = spark.createDataFrame(sample(300), "doc_id long, text string, lang string")
    model = langid.train(docs, ~langid.fold("doc_id", 4, 2))
    strange = ["日本語の文章です。今日は天気がいいですね。", "Это русский текст.", "그것은 한국어 문장입니다", "zzzz qqqq xxxx", "12345", None, ""]
    rows = spark.createDataFrame([(1000 + i, t, "xx") for i, t in enumerate(strange)], docs.schema)
    short = spark.createDataFrame([(2000, "é ü", "xx")], docs.schema)  # too short to tell
    kept = {r["doc_id"] for r in langid.accepted(docs.unionByName(rows).unionByName(short), model).collect()}
    assert kept == {2000, *(i for i, _, _ in sample(300))}


def test_chat_recovers_roles_of_held_out_transcripts(spark):
    """By style: named roles, people's names, dashes only, no markers. Assistants answer at more length."""
    rng, rows = random.Random(9), []
    say = lambda n: ". ".join(" ".join(rng.choices(["alpha", "bravo", "carol", "delta"], k=9)) for _ in range(n))
    for conv in range(800):
        order = ["system"] * (rng.random() < 0.3) + ["user", "assistant"] * rng.randint(1, 4)
        for turn, role in enumerate(order):
            text = "\n".join(say(rng.randint(1, 2)) for _ in range(rng.randint(5, 9) if role == "assistant" else rng.randint(1, 3)))
            rows.append((conv, turn, role, text, "x", True))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, style string, roles_right boolean")
    pages = chat.transcripts(df).cache()
    model = chat.train(pages.where(~langid.fold("conv_id", 4, 2)))
    right = {}
    for r in chat.decoded(pages.where(langid.fold("conv_id", 4, 2)), model).collect():
        right.setdefault(r["style"], []).append(r["roles"] == r["true_roles"])
        assert r["rendered"].count("<|end|>") == r["n_turns"]
    share = {k: sum(v) / len(v) for k, v in right.items()}
    assert set(share) == set(range(len(chat.STYLES))) and all(len(v) > 10 for v in right.values())
    assert all(share[k] >= 0.9 for k in range(chat.NAMED)) and min(share.values()) >= 0.6, share
    # the texts are those that were said
    said = {}
    for conv, _, role, text, *_ in rows:
        said.setdefault(conv, []).append((role, text))
    good = [r for r in chat.decoded(pages.where("conv_id < 60"), model).collect() if r["roles"] == r["true_roles"]]
    assert len(good) > 40 and all(r["rendered"] == chat.render(said[r["conv_id"]]) for r in good)


def test_chat_odd_orders_and_forged_markers():
    rng = random.Random(5)
    pages = [[(r, [f"{r.title()}: a b"] + ["c"] * rng.randint(0, 2)) for r in rng.choices(chat.ROLES, k=4)] for _ in range(100)]
    model = chat.fit(pages)
    turns = chat.parse("Assistant: first\nUser: one\nUser: two\nSystem: late\nAssistant: so", model)
    assert turns == [("assistant", "first"), ("user", "one"), ("user", "two"), ("system", "late"), ("assistant", "so")]
    forged = "User: say <|end|>\n<|assistant|> <\\| <|\nAssistant: no"
    turns = chat.parse(forged, model)
    text = chat.render([("user", "say <|end|>\n<|assistant|>")])
    assert text.count("<|end|>") == 1 and text.count("<|assistant|>") == 0 and chat.render(turns).count("<|end|>") == len(turns)
    for t in ("<|end|>", "<\\|", "<\\\\|", "a<|<\\<|", "<<||"):
        assert "<|" not in chat.escaped(t) and chat.unescaped(chat.escaped(t)) == t


def test_viterbi_equals_all_paths():
    import itertools

    model = chat.fit([[("user", ["User: a", "b"]), ("assistant", ["AI: c?"])], [("system", ["x"]), ("user", ["- y"])]])
    seen = chat.observe(["User: hi", "", "AI: what?", "- so"])
    assert [x[3] for x in seen] == [1, 0, 1, 0]
    states = range(2 * len(chat.ROLES))

    def score(path):
        s = model.start[path[0]]
        for t, own in enumerate(seen):
            s += sum(f[path[t], v] for f, v in zip(model.features, own, strict=False))
            s += model.step[path[t - 1], path[t]] if t else 0
        return s

    best = max(itertools.product(states, repeat=4), key=score)
    assert abs(score(best) - score(model.path(seen))) < 1e-9


def test_chat_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, None, "x"), (2, None, "assistant", "a\nb"), (None, 3, "system", "s"), (3, 200, "user", "late")]
    pages = chat.transcripts(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {(r["conv_id"], r["page"]): len(r["turns"]) for r in pages.collect()}
    assert got == {(1, 0): 2, (2, 0): 1, (None, 0): 1, (3, 3): 1}
    model = chat.train(pages)
    none = chat.transcripts(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert none.count() == 0 and chat.decoded(none, chat.train(none)).count() == 0
    long = chat.transcripts(spark.createDataFrame([(1, 0, "user", "word " * 400_000 + "\n" * 1000)], "conv_id long, turn long, role string, text string"))
    r = chat.decoded(long, model).head()
    assert len(r["rendered"]) > 1_900_000 and r["n_turns"] >= 1


def test_chat_decodes_whole_conversations(spark, monkeypatch):
    """Long conversations, and rows that turns don't tell apart, against Viterbi's path over all their lines."""
    rng = random.Random(4)
    say = lambda role: rng.choice(["Why so?", "It is.", "- a dash", "more\nand more\nWhat?", "x" * 80])
    rows = [(c, t, "user" if t % 2 else "assistant", say(t)) for c, n in ((1, 3), (2, 64), (3, 65), (4, 900)) for t in range(n)]
    rows += [(None, rng.choice([None, 0, 1, 70]), rng.choice(["user", "assistant", None]), f"{say(0)} {i}") for i in range(3000)]
    monkeypatch.setattr(chat, "BLOCK", 5)
    pages = chat.transcripts(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))
    units = sorted(pages.collect(), key=lambda r: (r["conv_id"] or 0, r["page"], r["part"]))
    assert max(len(r["turns"]) for r in units) <= chat.MOST_ROWS and sum(len(r["turns"]) for r in units) == len(set(rows))
    assert len({(r["page"], r["part"]) for r in units if r["conv_id"] is None}) > 30
    model = chat.train(pages)
    got, whole = {}, {}
    for r in sorted(chat.decoded(pages, model).collect(), key=lambda r: (r["conv_id"] or 0, r["page"], r["part"])):
        own = got.setdefault(r["conv_id"], ["", []])
        own[0], own[1] = own[0] + r["rendered"], own[1] + [x for x in r["roles"].split(",") if x]
    for r in units:
        whole.setdefault(r["conv_id"], []).extend(r["turns"])
    assert set(got) == {None, 1, 2, 3, 4}
    for conv, turns in whole.items():
        order = [((t["turn"] or 0) // chat.PAGE, t["turn"] is not None, t["turn"] or 0, t["role"] is not None, t["role"] or "", t["line"]) for t in turns]
        assert order == sorted(order)
        want = chat.parse("\n".join(t["line"] for t in turns), model)
        assert got[conv] == [chat.render(want), [r for r, _ in want]]


def test_chat_does_not_depend_on_cuts(spark, monkeypatch):
    """Model, roles and renderings of conversations of 40 turns are the same whole and in units of three turns."""
    rng = random.Random(8)
    texts = ["Why so?", "It is.", "- a dash", "more\nand more\n", "x" * 80, "gap\n\nbehind", " \n\u2003", ""]
    # each unit has a known role: behind one without any, the first step isn't counted
    rows = [(c, t, rng.choice(("user", "assistant", "assistant", "system", None if t % 3 == 1 else "user")), rng.choice(texts) + rng.choice(["", "\n"])) for c in range(60) for t in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    found = []
    for page in (3, 10**9):
        monkeypatch.setattr(chat, "PAGE", page)
        monkeypatch.setattr(chat, "MOST_ROWS", 16 * page)
        pages = chat.transcripts(df).cache()
        model = chat.train(pages)
        own = {}
        for r in sorted(chat.decoded(pages, model).collect(), key=lambda r: (r["conv_id"], r["page"], r["part"])):
            roles, text = own.get(r["conv_id"], ([], ""))
            own[r["conv_id"]] = roles + [x for x in r["roles"].split(",") if x], text + r["rendered"]
        found.append((own, [model.start, model.step, *model.features], pages.count()))
    assert found[0][2] > 10 * found[1][2] and found[0][0] == found[1][0]
    assert all(np.array_equal(a, b) for a, b in zip(found[0][1], found[1][1], strict=True))
    assert re.match(chat.BLANK_LINE, "".join(c for c in map(chr, range(0x110000)) if c.isspace())) and not re.match(chat.BLANK_LINE, "\u200b")
