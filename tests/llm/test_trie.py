"""The prefix trie against a plain one."""

import hashlib
import random
import zlib

import pytest

from kvatlas.llm import trie
from kvatlas.llm.shared import stored

SCHEMA = "conv_id long, turn long, role string, text string, depth string, length int"


def in_order(rows):
    """conv_id -> its turns (role, text)."""
    digest = lambda r: hashlib.sha256(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest()
    out = {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, digest(r))):
        out.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return out


def joined(convs):
    """The same with first turns taken over."""
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c > 0 else -1)
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def plain(convs):
    members = {}
    for c, own in convs.items():
        for d in range(len(own) + 1):
            members.setdefault(tuple(own[:d]), []).append(c)
    out = []
    for node, convs_of in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(y[: len(x)] == x and len(y) > len(x) for y in below)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        ends = ",".join(str(c) for c in sorted(convs_of) if len(convs[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs_of), len(node), parent, len(convs_of), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def rows_of(rng, n, most=9):
    """Conversations that share beginnings, with ties, nulls and repeated rows."""
    rows = []
    for c in rng.sample(range(-250, 450), n):
        kind = rng.randint(0, 3)
        for t in range(rng.choice((1, 1, 2, 3, most))):
            role, text = rng.choice(("user", "user", "bot")), rng.choice(("hi", "hi", "oh 😀"))
            role, text = ("user", f"same {kind}") if t < 3 else (role, text)
            rows.append((c, rng.choice((t, t, t, None)), rng.choice((role,) * 9 + (None,)), rng.choice((text,) * 9 + (None,)), "x", 1))
    return rows + rng.choices(rows, k=5) + [(None, 0, "user", "none", "x", 1)]


def got(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r) for r in df.collect())


def test_trie_equals_a_plain_one(spark, monkeypatch):
    rng = random.Random(5)
    rows = rows_of(rng, 120)
    sequences = stored(trie.turns(spark.createDataFrame(rows, SCHEMA).repartition(5)), "test")
    assert got(trie.trie(sequences)) == plain(in_order(rows))
    rebuilt = stored(trie.rebuilt(sequences), "test")
    want = plain(joined(in_order(rows)))
    assert got(trie.trie(rebuilt)) == want
    # long conversations by blocks, ids by pieces, parents with many children by broadcast, and a sketch that proves nothing
    monkeypatch.setattr(trie, "BLOCK", 2)
    monkeypatch.setattr(trie, "PIECE", 8)
    monkeypatch.setattr(trie, "LEAST_HOT", 1)
    assert got(trie.trie(stored(trie.rebuilt(sequences), "test"), most_bits=4)) == want


def test_screen_never_counts_too_little(spark):
    rng = random.Random(6)
    names = [(rng.randrange(-(1 << 63), 1 << 63), rng.randrange(-(1 << 63), 1 << 63)) for _ in range(3000)]
    rows = [(1, *n, 0, 0) for n in names + names[:500]]
    flagged = trie.screened(spark.createDataFrame(rows, "depth long, x1 long, x2 long, p1 long, p2 long").repartition(6)).collect()
    several = {(r["x1"], r["x2"]) for r in flagged if r["shared"]}
    assert several >= set(names[:500]) and len(several) < 520


def test_long_conversations_and_odd_tables(spark):
    long = [("user", "x" * (i % 3)) for i in range(9000)]
    convs = {1: long, 2: long, 3: long[:5000] + [("user", "other")], 4: [], 7: [("bot", "y" * 200_000)]}
    rows = [(c, i, r, t, "x", 1) for c, own in convs.items() for i, (r, t) in enumerate(own)]
    sequences = stored(trie.turns(spark.createDataFrame(rows, SCHEMA)), "test")
    nodes = {(r[0], r[1]): r for r in got(trie.trie(sequences))}
    assert len(nodes) == 9001 + 1 + 1
    assert nodes[1, 0][3:6] == (4, 2, 3) and nodes[1, 5000][3:6] == (3, 2, 2) and nodes[3, 5001][2:6] == (1, 1, 0, 1)
    assert nodes[1, 0][6] == sum(2 * (i % 3) for i in range(5000)) + sum(i % 3 for i in range(5000, 9000))
    assert nodes[1, 9000][7] == hashlib.sha256(b"1,2").hexdigest() and nodes[1, 0][7] == hashlib.sha256(b"").hexdigest()
    empty = spark.createDataFrame([(None, 0, "user", "none", "x", 1)], SCHEMA)
    assert trie.trie(stored(trie.turns(empty), "test")).count() == 0


def test_turnless_conversations_end_at_the_root(spark):
    few = [(c, 0, "user", "a", "x", 1) for c in range(101, 140)]  # their conversation 100 isn't there
    rows = got(trie.trie(stored(trie.rebuilt(trie.turns(spark.createDataFrame(few, SCHEMA))), "test")))
    assert rows == plain(joined(in_order(few)))
    one = [(101, 0, "user", "a", "x", 1)]
    assert got(trie.trie(stored(trie.turns(spark.createDataFrame(one, SCHEMA)), "test"))) == plain(in_order(one))


def test_one_name_for_two_prefixes_stops(spark, monkeypatch):
    bad = spark.createDataFrame([(1, 0, 1, None, 0), (2, 0, 1, None, 0), (1, 1, 1, bytearray(b"a"), 1), (2, 1, 1, bytearray(b"b"), 1)], "conv_id long, depth long, length long, item binary, chars long")
    named = trie.named
    monkeypatch.setattr(trie, "named", lambda s: named(s).selectExpr("conv_id", "depth", "length", "item", "chars", "depth x1", "depth x2", "0L p1", "0L p2"))
    with pytest.raises(Exception, match="one name"):
        trie.trie(bad).collect()
