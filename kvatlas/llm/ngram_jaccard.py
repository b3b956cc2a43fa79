"""N-gram Jaccard join by vertical partitioning.

Global order: word shingles ordered by a 64-bit hash. The order is cut into fragments.

1. Documents with equal shingle sets form classes; only one document of each class goes on.
2. Two sets whose Jaccard is at least the threshold differ in at most D shingles, D depending on their sizes.
   Sizes are put into levels such that partners lie in the same level or in neighbouring ones; the order is
   cut into more than D fragments for each level, so partners agree in at least one whole fragment. A document
   emits a signature of each of its fragments, for its own level and the one below.
3. Signatures are range-partitioned together with the ids, so even a signature that a third of all documents
   share is spread over tasks. Signatures of up to ``small`` documents give pairs at once, with the number of
   fragments in which a pair agrees, and pairs that agree in too few are dropped (a bound, so no link is lost).
   In larger ones, documents that agree with others there in enough fragments at all give one pair each, with
   the first of them, and a family.
4. Pairs are verified exactly: shingle sets are cut into ``parts`` fragments, partial overlaps are counted
   fragment by fragment, and summed for each pair.
5. Links form components. Where a large signature's documents lie in several components, one more of them is drawn, and
   each document is verified against one that was drawn from another component, for up to ``rounds`` rounds, while they
   help; a round verifies no more pairs than there are documents.
6. In families (of signatures with common documents) that are still split, a shingle counts only if several
   components have it, and a document stays only if enough of its shingles count to link it to another component;
   families of which that leaves one component or none are done. What is left is compared block by block, again
   summing partial overlaps over fragments; a pair of blocks returns only as many links as join its components.

So all pairs of a large group are never emitted, and no link between different components is lost. Steps 1 to 5 and
the sieve of step 6 are linear. Only documents that pass the sieve, yet can't be joined by the rounds, are compared
in pairs, inside tasks: for these the number of compared pairs of one family may grow with the square of their
number. Blocks are bounded by documents and by shingles.

Results for odd input: without words (null, empty, blank) a set is empty and linked with nothing; with fewer
words than ``k`` the whole sequence is one shingle; long texts are used whole; repeated rows and ties are one
class; rows that share an id are one document, linked by any of their texts; a row without id has no links and
no component; an empty table gives an empty result. Extra columns are left out, so names can't clash.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvatlas.llm.components import components
from kvatlas.llm.shared import dropped, stored, table
from kvatlas.llm.shingles import WordHashes, mix, set_digest, shingle_set

K, NUMERATOR, DENOMINATOR = 5, 80, 100
SMALL, PARTS, BLOCK, BLOCK_SHINGLES, ROUNDS = 16, 4, 512, 1_000_000, 3
#: Rows of one key beyond which its rows are spread over tasks; keys beyond it are broadcast (at most 1 in HOT rows).
HOT = 65_536
_TOP = np.uint64(1 << 63)


class Levels:
    """Levels of set sizes, and into how many fragments each cuts the order."""

    def __init__(self, numerator: int, denominator: int, top: int = 1 << 31) -> None:
        self.numerator, self.denominator = numerator, denominator
        self.starts = [1]
        while self.starts[-1] < top:  # a level ends before the largest partner of its smallest size
            self.starts.append(self.starts[-1] * denominator // numerator + 1)
        self.fragments = []
        for after in self.starts[1:]:
            d = self.differ(after - 1, (after - 1) * denominator // numerator)
            self.fragments.append(0 if d == 0 else d + 2 + d // 8)

    def differ(self, n: int, m: int) -> int:
        """The most shingles in which linked sets of n and m shingles differ."""
        return (self.denominator - self.numerator) * (n + m) // (self.denominator + self.numerator)

    def of(self, n: int) -> int:
        return bisect_right(self.starts, n) - 1

    def most_differ(self, level: int) -> int:
        largest = self.starts[level + 1] - 1
        return self.differ(largest, largest * self.denominator // self.numerator)

    def least_agree(self, level: int, empty: int) -> int:
        """In how many fragments, not empty, a set with ``empty`` empty ones agrees with a partner at least."""
        return max(1, self.fragments[level] - self.most_differ(level) - empty)


def signatures(s: np.ndarray, level: int, levels: Levels) -> tuple[np.ndarray, int]:
    """Signatures of the fragments of one level, the lowest bit telling odd levels; and empty fragments."""
    count = levels.fragments[level]
    if not count:  # no two different sets of such sizes link
        return np.empty(0, np.uint64), 0
    cut = ((s >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
    starts = np.flatnonzero(np.concatenate(([True], cut[1:] != cut[:-1])))
    sums = np.add.reduceat(mix(s), starts)
    which = cut[starts]
    empty = count - len(starts)
    if empty >= count - levels.most_differ(level):  # partners might agree in empty fragments only: emit these too
        gaps = np.setdiff1d(np.arange(count, dtype=np.uint64), which)
        sums, which = np.concatenate((sums, np.zeros(len(gaps), np.uint64))), np.concatenate((which, gaps))
    place = which + np.uint64(level << 40)
    return mix(sums + mix(place)) & ~np.uint64(1) | np.uint64(level & 1), empty


def _signed(x: np.ndarray) -> np.ndarray:
    return (x ^ _TOP).view(np.int64)


def shingled(docs: DataFrame, k: int, levels: Levels, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, d1, d2 (a digest of the set), level, fragments, empty (of its level), signatures; and in how many
    fragments of its level (``need_own``), and of the one below, it agrees with any partner at least."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for batch in batches:
            rows = []
            for text in batch["text"]:
                s = shingle_set(text, k, words)
                level = levels.of(len(s)) if len(s) else 0
                own, empty = signatures(s, level, levels) if len(s) else (np.empty(0, np.uint64), 0)
                below, empty_below = signatures(s, level - 1, levels) if level else (own[:0], 0)
                need = levels.least_agree(level, empty), levels.least_agree(max(level - 1, 0), empty_below)
                rows.append((len(s), *set_digest(s), level, levels.fragments[level], empty, *need, _signed(np.concatenate((own, below)))))
            out = pd.DataFrame(rows, columns=["n", "d1", "d2", "level", "fragments", "empty", "need_own", "need_below", "signatures"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None))
            yield out

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n long, d1 long, d2 long, level int, fragments int, empty int, need_own int, need_below int, signatures array<long>"
    return rows.mapInPandas(read, schema)


def _agreeing(batches: Iterator[pd.DataFrame], small: int) -> Iterator[pd.DataFrame]:
    """From rows ordered by (signature, id): pairs of small runs (kind 0 or 1: the level's parity, a, b), and
    members of large runs and of those at the task's edges, which may go on elsewhere (kind 2, signature, id)."""
    parity = lambda sig: sig & 1
    held_sig: np.ndarray = np.empty(0, np.int64)
    held_id: np.ndarray = np.empty(0, np.int64)
    first = True
    spilling = None  # a run that is known to be large: its rows pass through

    def frame(kind, a, b) -> pd.DataFrame:
        return pd.DataFrame({"kind": np.asarray(kind, np.int32), "a": a, "b": b})

    for batch in batches:
        sig = np.concatenate((held_sig, batch["signature"].to_numpy(np.int64)))
        ids = np.concatenate((held_id, batch["doc_id"].to_numpy(np.int64)))
        if spilling is not None:
            n = int(np.searchsorted(sig, spilling, side="right"))
            if n:
                yield frame(np.full(n, 2), sig[:n], ids[:n])
            sig, ids = sig[n:], ids[n:]
            if not len(sig):
                held_sig, held_id = sig, ids
                continue
            spilling = None
        if not len(sig):
            continue
        starts = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        sizes = np.diff(np.append(starts, len(sig)))
        last = int(starts[-1])
        inner, inner_size = starts[:-1], sizes[:-1]
        if first and len(inner):
            yield frame(np.full(inner_size[0], 2), sig[: inner_size[0]], ids[: inner_size[0]])
            inner, inner_size, first = inner[1:], inner_size[1:], False
        for c in np.unique(inner_size[(inner_size > 1) & (inner_size <= small)]).tolist():
            at = inner[inner_size == c]
            i, j = np.triu_indices(c, 1)
            a, b = ids[at[:, None] + i].ravel(), ids[at[:, None] + j].ravel()
            kind = np.repeat(parity(sig[at]), len(i))
            keep = a != b
            yield frame(kind[keep], a[keep], b[keep])
        for at, c in zip(inner[inner_size > small].tolist(), inner_size[inner_size > small].tolist(), strict=True):
            yield frame(np.full(c, 2), sig[at : at + c], ids[at : at + c])
        held_sig, held_id = sig[last:], ids[last:]
        if len(held_sig) > small:
            spilling, first = int(held_sig[0]), False
            yield frame(np.full(len(held_sig), 2), held_sig, held_id)
            held_sig, held_id = held_sig[:0], held_id[:0]
    if len(held_sig):
        yield frame(np.full(len(held_sig), 2), held_sig, held_id)


def _sets(docs: DataFrame, wanted: DataFrame, repeated: DataFrame, k: int, parts: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, t (which of its texts), n, part, shingles: the sets of the documents of ``wanted``, cut into ``parts`` fragments.

    Ids of ``repeated`` have several rows; of those that agree in the text one counts.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for batch in batches:
            rows = []
            for doc, t, text in zip(batch["doc_id"], batch["t"], batch["text"], strict=True):
                s = shingle_set(text, k, words)
                cut = np.searchsorted((s >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1))
                whole = _signed(s)
                rows += [(doc, t, len(s), p, whole[cut[p] : cut[p + 1]]) for p in range(parts) if not p or cut[p] < cut[p + 1]]
            yield pd.DataFrame(rows, columns=["doc_id", "t", "n", "part", "shingles"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text")).join(wanted, "doc_id", "left_semi")
    if not repeated.isEmpty():
        rows = rows.join(repeated, "doc_id", "left_anti").union(rows.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "t"]))
    return stored(rows.mapInPandas(read, "doc_id long, t long, n long, part int, shingles array<long>"), "sets")


def _at_key(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each key and its number of rows in ``m``; rows of hot keys stay where they are."""
    most = table.agg(F.max("m")).head()[0] or 0
    if most <= HOT:
        return rows.join(table.drop("m"), key)
    hot = F.broadcast(table.where(F.col("m") > HOT).drop("m"))
    cold = rows.join(hot.select(key), key, "left_anti").join(table.where(F.col("m") <= HOT).drop("m"), key)
    return cold.unionByName(rows.join(hot, key))


def _with_sets(pairs: DataFrame, sets: DataFrame, hot: DataFrame | None, side: str, other: str, columns: list) -> DataFrame:
    """``pairs`` joined with the sets of ``side``; a document of very many pairs (``hot``: doc_id, salts) is spread by a hash of the other one."""
    key = [side] + (["part"] if "part" in pairs.columns else [])
    own = sets.select(F.col("doc_id").alias(side), *columns)
    if hot is None:
        return pairs.join(own, key)
    hot = F.broadcast(hot.withColumnRenamed("doc_id", side))
    rows = pairs.join(hot, side, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(other), F.col("salts")), F.lit(0)).cast("int")).drop("salts")
    own = own.join(hot, side, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return rows.join(own, [*key, "salt"]).drop("salt")


def _verified(pairs: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The pairs (a, b) that link: partial overlaps by fragment, summed.

    The first fragment goes alone. A pair whose overlap there can't be made up for by the sizes of the rest is
    done with, so whole sets travel for pairs that are likely links only.
    """
    of = lambda x: ["part", F.col("t").alias(f"t_{x}"), F.col("n").alias(f"n_{x}"), F.col("shingles").alias(f"s_{x}")]
    enough = lambda i: i * denominator >= (F.col("n_a") + F.col("n_b") - i) * numerator
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("m"))
    hot = stored(ends.where(F.col("m") > HOT).select("doc_id", F.ceil(F.col("m") / HOT).cast("int").alias("salts")), "hot")
    hot = None if hot.isEmpty() else hot
    start = sets.where("part = 0")
    first = _with_sets(_with_sets(pairs, start, hot, "a", "b", of("a")[1:]), start, hot, "b", "a", of("b")[1:])
    rest = F.least(F.col("n_a") - F.size("s_a"), F.col("n_b") - F.size("s_b"))
    hopeful = stored(first.where(enough(F.size(F.array_intersect("s_a", "s_b")) + rest)).select("a", "b").distinct(), "hopeful")
    both = _with_sets(_with_sets(hopeful, sets, hot, "a", "b", of("a")), sets, hot, "b", "a", of("b"))
    texts = ["a", "b", "t_a", "t_b", "n_a", "n_b"]
    partial = both.select(*texts, F.size(F.array_intersect("s_a", "s_b")).alias("overlap"))
    return partial.groupBy(*texts).agg(F.sum("overlap").alias("i")).where(enough(F.col("i"))).select("a", "b").distinct()


def _merged(components_: DataFrame, links: DataFrame) -> DataFrame:
    """doc_id, component with components joined by links between them."""
    joined = components(links).select(F.col("node").alias("component"), F.col("component").alias("final"))
    return components_.join(joined, "component", "left").select("doc_id", F.coalesce("final", "component").alias("component"))


def _another_round(members: DataFrame, of_doc: DataFrame, sets: DataFrame, turn: int, numerator: int, denominator: int) -> DataFrame | None:
    """``of_doc`` (doc_id, component) after documents of split signatures have met one of another component; None if that changes nothing."""
    rows = stored(members.join(of_doc, "doc_id"), "round")
    pick = F.min(F.struct(F.xxhash64("doc_id", F.lit(turn)).alias("h"), "doc_id", "component")).alias("pick")
    groups = rows.groupBy("signature").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), pick, F.count(F.lit(1)).alias("m"))
    split = groups.where("lo <> hi").select("signature", F.col("pick.doc_id").alias("pivot"), F.col("pick.component").alias("own"), "m")
    split = stored(split, "split")
    if split.isEmpty():
        return None
    # of all signatures, a document meets one pivot a round
    met = _at_key(rows, split, "signature").where("component <> own").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("pivot", F.lit(turn)).alias("h"), "pivot")).alias("p"))
    pairs = stored(met.select(F.least("p.pivot", "doc_id").alias("a"), F.greatest("p.pivot", "doc_id").alias("b")).distinct(), "pairs")
    links = stored(_verified(pairs, sets, numerator, denominator), "links")
    if links.isEmpty():
        return None
    ends = links.join(of_doc.select(F.col("doc_id").alias("a"), F.col("component").alias("c_a")), "a").join(of_doc.select(F.col("doc_id").alias("b"), F.col("component").alias("c_b")), "b")
    return stored(_merged(of_doc, ends.select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))), "of_doc")


def _sieved(families: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """family, doc_id, component, n, shingles: of families that may still join, the documents that may, with those of
    their shingles that several components of the family have."""
    rows = families.join(sets.select("doc_id", "t", "n", F.explode("shingles").alias("shingle")), "doc_id")
    rows = stored(rows, "exploded")
    common = rows.groupBy("family", "shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo <> hi").select("family", "shingle", "m")
    key = F.xxhash64("family", "shingle").alias("key")
    common = stored(common.groupBy(key).agg(F.max("m").alias("m")), "common")  # a clash of keys keeps a shingle more
    kept = _at_key(rows.withColumn("key", key), common, "key").groupBy("family", "doc_id", "t", "component", "n").agg(F.collect_list("shingle").alias("shingles"))
    kept = stored(kept.where(F.size("shingles") * denominator >= F.col("n") * numerator), "kept")
    dropped(rows)
    left = kept.groupBy("family").agg(F.count(F.lit(1)).alias("size"), F.sum(F.size("shingles")).alias("total"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    return kept.join(stored(left.where("lo <> hi").drop("lo", "hi"), "left"), "family")


def _family_links(rows: DataFrame, numerator: int, denominator: int, block: int, block_shingles: int) -> DataFrame:
    """Links that join components of one family. ``rows``: those of ``_sieved``, with size and total (shingles) of the family."""
    blocks = F.ceil(F.greatest(F.col("size") / F.lit(block), F.col("total") / F.lit(block_shingles))).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "component", "n", "shingles"
    )

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        n, own = group["n"].to_numpy(), group["component"].to_numpy()
        size = np.array([len(s) for s in group["shingles"]])
        row = np.repeat(np.arange(len(group)), size)
        order, column = np.unique(np.concatenate(group["shingles"].to_list()), return_inverse=True)
        common = np.bincount(column) > 1
        new = np.cumsum(common) - 1
        keep = common[column]
        row, column = row[keep], new[column[keep]]
        overlap = np.zeros((len(group), len(group)), np.float32)
        for f in range(0, int(common.sum()), 4096):  # fragments of the order
            part = np.zeros((len(group), 4096), np.float32)
            here = (column >= f) & (column < f + 4096)
            part[row[here], column[here] - f] = 1
            overlap += part @ part.T
        link = overlap * denominator >= (n[:, None] + n[None, :] - overlap) * numerator
        link &= own[:, None] < own[None, :]
        parent = {c: c for c in set(own.tolist())}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for x, y in {(int(own[x]), int(own[y])) for x, y in zip(*np.nonzero(link), strict=True)}:
            if (p := root(x)) != (q := root(y)):
                parent[max(p, q)] = min(p, q)
                out.append((x, y))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return dealt.groupBy("family", "i", "j").applyInPandas(compare, "a long, b long")


def jaccard_components(
    docs: DataFrame,
    k: int = K,
    numerator: int = NUMERATOR,
    denominator: int = DENOMINATOR,
    id_col: str = "doc_id",
    text_col: str = "text",
    small: int = SMALL,
    parts: int = PARTS,
    block: int = BLOCK,
    block_shingles: int = BLOCK_SHINGLES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each input row; linked: |intersection| * denominator >= |union| * numerator."""
    levels = Levels(numerator, denominator)
    whole = stored(shingled(docs, k, levels, id_col, text_col), "shingled")
    read = stored(whole.drop("signatures"), "facts")
    known = read.where("n > 0 and doc_id is not null")
    classes = stored(
        known.groupBy("d1", "d2", "n").agg(*[F.max(c).alias(c) for c in ("level", "fragments", "empty", "need_own", "need_below")], F.min("doc_id").alias("first")),
        "classes",
    )
    # copies: all but the first document of each class (an id that is first in some class stays)
    of_class = known.select("doc_id", "d1", "d2").join(classes.select("d1", "d2", "first"), ["d1", "d2"])
    copies = of_class.where("doc_id <> first").select("doc_id").distinct().join(classes.select(F.col("first").alias("doc_id")), "doc_id", "left_anti")
    emitted = whole.where("n > 0 and doc_id is not null").select("doc_id", "signatures").join(stored(copies, "copies"), "doc_id", "left_anti")
    emitted = emitted.select(F.explode("signatures").alias("signature"), "doc_id")
    ordered = emitted.repartitionByRange("signature", "doc_id").sortWithinPartitions("signature", "doc_id")
    agreeing = stored(ordered.mapInPandas(lambda batches: _agreeing(batches, small), "kind int, a long, b long"), "agreeing")
    dropped(whole)  # the signatures are the largest table here

    members = stored(agreeing.where("kind = 2").select(F.col("a").alias("signature"), F.col("b").alias("doc_id")).distinct(), "members")
    several = stored(members.groupBy("signature").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "several")
    members = stored(_at_key(members, several, "signature"), "members")

    # pairs of small runs, with the fragments in which they agree at even and odd levels
    counted = agreeing.where("kind < 2").groupBy("a", "b").agg(F.sum(1 - F.col("kind")).alias("even"), F.sum("kind").alias("odd"))
    odd = F.col("signature").bitwiseAND(1)
    large = members.groupBy("doc_id").agg(F.sum(1 - odd).alias("even"), F.sum(odd).alias("odd"))
    needs = [F.min(c).alias(c) for c in ("need_own", "need_below")]
    facts = classes.groupBy("first").agg(*[F.max(c).alias(c) for c in ("n", "level", "fragments", "empty")], *needs, F.count(F.lit(1)).alias("texts"))
    facts = facts.join(large.withColumnRenamed("doc_id", "first"), "first", "left")
    facts = stored(facts.select("first", "n", "level", "fragments", "empty", "need_own", "need_below", "texts", F.coalesce("even", F.lit(0)).alias("even"), F.coalesce("odd", F.lit(0)).alias("odd")), "facts")
    side = lambda x: facts.select(F.col("first").alias(x), F.struct("n", "level", "fragments", "empty", "texts", "even", "odd").alias(f"f_{x}"))
    lesser = F.when(F.col("f_a.n") <= F.col("f_b.n"), F.col("f_a")).otherwise(F.col("f_b"))
    most = F.floor((F.col("f_a.n") + F.col("f_b.n")) * F.lit(denominator - numerator) / F.lit(denominator + numerator)) + 1
    at_level = lambda even, odd_: F.when(F.col("lesser.level") % 2 == 0, even).otherwise(odd_)
    agree = at_level(F.col("even"), F.col("odd")) + at_level(F.least("f_a.even", "f_b.even"), F.least("f_a.odd", "f_b.odd"))
    fits = (F.least("f_a.n", "f_b.n") * denominator >= F.greatest("f_a.n", "f_b.n") * numerator) & (
        agree >= F.col("lesser.fragments") - most - F.col("lesser.empty")
    )
    mixed = (F.col("f_a.texts") > 1) | (F.col("f_b.texts") > 1)  # an id with different texts: no bound holds
    likely = counted.join(side("a"), "a").join(side("b"), "b").withColumn("lesser", lesser).where(fits | mixed).select("a", "b")

    # partners that share no small run agree in large runs only, and in enough of them
    own = F.col("level") % 2 == odd
    shared = F.when(odd == 1, F.col("odd")).otherwise(F.col("even"))
    enough = (shared >= F.when(own, F.col("need_own")).otherwise(F.col("need_below"))) | (F.col("texts") > 1)
    members = stored(members.join(facts.withColumnRenamed("first", "doc_id"), "doc_id").where(enough).select("signature", "doc_id"), "members")
    heads = stored(members.groupBy("signature").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("m")), "heads")
    stars = _at_key(members, heads, "signature").where("head <> doc_id").select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct()
    stars = stored(stars, "stars")

    pairs = stored(likely.union(stars).distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    repeated = stored(known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("doc_id"), "repeated")
    sets = _sets(docs, stored(wanted, "wanted"), repeated, k, parts, id_col, text_col)
    linked = components(_verified(pairs, sets, numerator, denominator))

    family = components(stars).select(F.col("node").alias("doc_id"), F.col("component").alias("family"))
    nodes = family.select("doc_id").union(linked.select(F.col("node").alias("doc_id"))).distinct()
    of_doc = nodes.join(linked.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))
    of_doc = stored(of_doc, "of_doc")
    for turn in range(rounds):
        after = _another_round(members, of_doc, sets, turn, numerator, denominator)
        if after is None:
            break
        of_doc = after
    families = stored(family.join(of_doc, "doc_id"), "families")
    split = families.groupBy("family").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("m"))
    split = stored(split.where("lo <> hi").select("family", "m"), "split")
    if not split.isEmpty():
        sieved = _sieved(_at_key(families, split, "family"), sets, numerator, denominator)
        of_doc = _merged(of_doc, _family_links(sieved, numerator, denominator, block, block_shingles))
    of_doc = of_doc.withColumnRenamed("doc_id", "node")
    of_class = classes.select("d1", "d2", "first").join(of_doc.withColumnRenamed("node", "first"), "first", "left")
    of_class = stored(of_class.select("d1", "d2", F.coalesce("component", "first").alias("component_id")), "of_class")
    rows = read.select("doc_id", "n", "d1", "d2")
    return rows.join(of_class, ["d1", "d2"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), F.col("doc_id"))).alias("component_id"),
    )


def near_dedup(docs: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """``docs`` with one document of each component: its smallest id. Rows without id stay."""
    own = "_" * (1 + max(map(len, docs.columns)))  # a name that the input doesn't have
    keep = jaccard_components(docs, id_col=id_col, **settings).where("doc_id = component_id").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(stored(keep, "keep"), F.col(id_col) == F.col(own), "left_semi").unionByName(docs.where(F.col(id_col).isNull()))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=4, numerator=85, denominator=100)
