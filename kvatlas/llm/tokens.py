"""Token ids in a content-addressed store.

Format (all parquet, under one folder):

* ``chunks``: ``digest binary, n_ids int, width int, body binary``. Each different chunk stands here once.
  ``body`` is the zstd-compressed little-endian ids, of ``width`` bytes each (2, or 4 if an id needs it);
  ``digest`` is BLAKE2b-128 of the ids as 4-byte integers, so it doesn't depend on ``width``.
* ``recipes``: ``doc_id, shard, start_in_shard, n_tokens, root, digests``: a document is the chunks named by
  ``digests`` (16 bytes each), in order; ``root`` is the Merkle root over them. Rows ascend by doc_id within
  a shard, and shards ascend.
* ``manifests``: ``shard, n_docs, n_ids, root``: the Merkle root over the records of a shard's documents.

Chunks end where a rolling hash of the last ``WINDOW`` ids has its top ``CUT_BITS`` bits zero, so equal
passages share chunks wherever they stand. Words are encoded by the tokenizer one by one and kept: it never
joins text across ASCII white space, so this equals encoding the whole text (see the tests).

Results for odd input: null and empty texts are the end id alone; long texts have more chunks; repeated rows
have a recipe each; rows without id come first, in the order of their recipes; an empty table gives an empty
store and result; extra columns aren't read, so names can't clash.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvatlas.llm.shared import scratch, stored, table

END_ID = 1
WINDOW, CUT_BITS, LEAST, MOST = 8, 9, 64, 8192
WORDS_KEPT, SLICE, HOT = 400_000, 4 << 20, 1000
CHUNK, RECIPE = "chunk", "recipe"
PARTS_SCHEMA = "key binary, doc_id long, n int, width int, body binary, copies long, kind string"
RECIPES_SCHEMA = "doc_id long, shard int, start_in_shard long, n_tokens long, root binary, digests array<binary>"
MANIFESTS_SCHEMA = "shard int, n_docs long, n_ids long, root binary"


#: Letters: a-z, and Latin letters that normalising leaves single letters. The tokenizer cuts plain words into
#: runs of letters, single digits, and runs of the rest.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017f"
PLAIN = re.compile(f"[!-&(-~{LETTERS}]+")
PARTS = re.compile(f"[{LETTERS}]+|[0-9]|[^0-9{LETTERS}]+")
ALL_LETTERS, ENDED = f"^[{LETTERS}]+$", f"^[{LETTERS}]+[.,;:!?]$"


def ragged(store: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pieces of ``store`` that begin at ``starts``, one behind the other."""
    ends = np.cumsum(sizes)
    return store[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)]


def _strings(array: pa.Array) -> list[str]:
    return array.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """Texts to ids, end id included. Words are encoded once and kept, between tasks too.

    A batch is split at white space and its distinct words are found by Arrow; only those are looked at one by one.
    Words of letters, with or without one mark behind, come from the table of letter runs. New letter runs are
    encoded many at a time: each ends in a token with the end-of-word suffix, which tells where its ids end. They
    need neither normalising nor the splitting pattern, so a copy of the tokenizer without these encodes them.
    Words that aren't plain go to the whole tokenizer one by one.
    """

    def __init__(self, path: str, end_id: int = END_ID) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism here
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.end_id, self.whole, self.runs = end_id, Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.runs.normalizer = normalizers.Sequence([])
        self.runs.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.whole.get_vocab()
        self.ends_run = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_run[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {"": 0}  # word or letter run -> its row in starts and sizes
        self.store, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.sizes = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def keep(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.store):
            self.store = np.concatenate((self.store, np.zeros_like(self.store)))
        self.store[self.used : self.used + len(ids)] = ids
        self.place.update(zip(words, range(len(self.starts), len(self.starts) + len(words)), strict=True))
        self.starts = np.concatenate((self.starts, self.used + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.used += len(ids)

    def learn_whole(self, words: list[str]) -> None:
        found = [e.ids for e in self.whole.encode_batch_fast(words, add_special_tokens=False)]
        self.keep(words, np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64))

    def learn_runs(self, runs: list[str]) -> None:
        """Lower-case runs of letters, and runs of marks."""
        texts = [" ".join(runs[i : i + 512]) for i in range(0, len(runs), 512)]
        found = self.runs.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in found]) if found else np.empty(0, np.uint32)
        ends = np.flatnonzero(self.ends_run[ids]) + 1
        if len(ends) == len(runs):
            self.keep(runs, ids, np.diff(ends, prepend=0))
        else:
            self.learn_whole(runs)

    def places(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))

    def learn_others(self, words: list[str]) -> None:
        """Words that aren't one run of letters: from their parts where they are plain, else as a whole."""
        plain = [(w, PARTS.findall(w.lower())) for w in words if PLAIN.fullmatch(w) and "<|" not in w]
        done = {w for w, _ in plain}
        self.learn_runs(list({p for _, parts in plain for p in parts if p not in self.place}))
        at = self.places([p for _, parts in plain for p in parts])
        sizes = self.sizes[at]
        count = np.array([len(parts) for _, parts in plain], np.int64)
        if len(plain):
            self.keep([w for w, _ in plain], ragged(self.store, self.starts[at], sizes), np.add.reduceat(sizes, np.cumsum(count) - count))
        self.learn_whole([w for w in words if w not in done])

    def word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words: a store, and where each word's ids begin in it and how many they are."""
        if len(self.place) > WORDS_KEPT:
            self.clear()
        ended = pc.match_substring_regex(words, ENDED)
        runs = pc.if_else(ended, pc.utf8_slice_codeunits(words, 0, -1), words)
        letters = pc.match_substring_regex(runs, ALL_LETTERS)
        runs = pc.if_else(letters, pc.utf8_lower(runs), runs).dictionary_encode()
        first = np.zeros(len(runs.dictionary), bool)
        first[runs.indices.to_numpy()[letters.to_numpy(zero_copy_only=False)]] = True
        distinct = _strings(runs.dictionary)
        at = self.places(distinct)
        for learn, wanted in ((self.learn_runs, first), (self.learn_others, ~first)):
            new = np.flatnonzero(wanted & (at < 0))
            if len(new):
                own = [distinct[i] for i in new.tolist()]
                learn(own)
                at[new] = self.places(own)
        marks = pc.if_else(ended, pc.utf8_slice_codeunits(words, -1), "").dictionary_encode()
        if new := [w for w in _strings(marks.dictionary) if w not in self.place]:
            self.learn_runs(new)
        run_at, mark_at = at[runs.indices.to_numpy()], self.places(_strings(marks.dictionary))[marks.indices.to_numpy()]
        both = np.column_stack((run_at, mark_at)).ravel()
        sizes = self.sizes[both]
        whole = sizes[0::2] + sizes[1::2]
        return ragged(self.store, self.starts[both], sizes), np.cumsum(whole) - whole, whole

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an array of strings, and where each text's ids begin and end in them."""
        texts = pc.fill_null(texts, "")
        # the tokenizer lower-cases too; but a special token's name isn't to be made from capitals
        words = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
        known = words.flatten().dictionary_encode()
        store, starts, sizes = self.word_ids(known.dictionary)
        # one more word ends each text: the end id
        store = np.append(store, np.uint32(self.end_id))
        starts, sizes = np.append(starts, len(store) - 1), np.append(sizes, 1)
        ends = words.offsets.to_numpy() - words.offsets[0].as_py()
        at = np.insert(known.indices.to_numpy().astype(np.int64), ends[1:], len(sizes) - 1)
        size = sizes[at]
        total = np.concatenate(([0], np.cumsum(size)))
        return ragged(store, starts[at], size), total[ends + np.arange(len(ends))]

    def arrays(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        array = pa.array(texts, pa.string())
        out = []
        for at, count in slices(array):
            ids, offsets = self.encode(array.slice(at, count))
            out += np.split(ids, offsets[1:-1])
        return out


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int = END_ID) -> Encoder:
    """One for each Python worker, which Spark uses for many tasks."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of texts of about ``most`` bytes, one text at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right")))
        yield start, stop - start
        start = stop


def cuts(ids: np.ndarray, offsets: np.ndarray | None = None) -> list[list[int]]:
    """Where the chunks of each text end in ``ids``: where the rolling hash says so, none under LEAST or over MOST ids.

    The hash of the last 8 ids is (sum of 3^k times the mixed id k back), from sums of 2, 4 and 8. A chunk has LEAST
    ids, so no end depends on ids of another text.
    """
    offsets = np.array([0, len(ids)]) if offsets is None else offsets
    roll = ids.astype(np.uint32) * np.uint32(0x9E3779B1)
    roll ^= roll >> np.uint32(15)
    for back in (1, 2, 4):
        roll[back:] = roll[back:] + roll[:-back] * np.uint32(3**back)
    roll *= np.uint32(0x85EBCA6B)
    ends = np.flatnonzero(roll >> np.uint32(32 - CUT_BITS) == 0) + 1
    bounds = np.searchsorted(ends, offsets, side="right").tolist()
    ends, out = ends.tolist(), []
    for last, stop, lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), bounds[:-1], bounds[1:], strict=True):
        own: list[int] = []
        for c in ends[lo:hi] + [stop]:
            while c - last > MOST:
                own.append(last := last + MOST)
            if c - last >= LEAST or (c == stop and c > last):
                own.append(last := c)
        out.append(own)
    return out


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """The root over 16-byte leaves; an odd one moves up as it is."""
    level = leaves or [_digest(b"")]
    while len(level) > 1:
        level = [_digest(b"\x01" + b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


class MerkleFold:
    """The root that ``merkle`` gives, of leaves that come one by one; keeps one node a level."""

    def __init__(self) -> None:
        self.levels: list[bytes | None] = []

    def add(self, node: bytes) -> None:
        for i, left in enumerate(self.levels):
            if left is None:
                self.levels[i] = node
                return
            self.levels[i], node = None, _digest(b"\x01" + left + node)
        self.levels.append(node)

    def root(self) -> bytes:
        right = None
        for left in self.levels:
            if left is not None:
                right = left if right is None else _digest(b"\x01" + left + right)
        return merkle([]) if right is None else right


def _pack(ids: np.ndarray, squeeze: zstandard.ZstdCompressor) -> tuple[int, bytes]:
    width = 2 if int(ids.max()) < 1 << 16 else 4
    return width, squeeze.compress(ids.astype(f"<u{width}").tobytes())


def unpack(body: bytes, width: int) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(body), f"<u{width}").astype("<u4")


def write_store(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Encode all texts once; one shuffle merges equal chunks; then recipes are put in order."""
    spark = docs.sparkSession
    schema = "kind string, key binary, doc_id long, n int, width int, body binary"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, squeeze = encoder(tokenizer_path, end_id).encode, zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for at, count in slices(batch.column(1)):
                docs = batch.column(0).slice(at, count).to_pylist()
                ids, offsets = encode(batch.column(1).slice(at, count))
                rows, seen = [], set()
                for doc, start, ends in zip(docs, offsets[:-1].tolist(), cuts(ids, offsets), strict=True):
                    first, names = start, []
                    for end in ends:
                        own, start = ids[start:end], end
                        name = _digest(own.tobytes())
                        names.append(name)
                        if name not in seen:
                            seen.add(name)
                            rows.append((CHUNK, name, None, len(own), *_pack(own, squeeze)))
                    recipe = b"".join(names)
                    rows.append((RECIPE, _digest(f"{doc}|".encode() + recipe), doc, start - first, 0, recipe))
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow, strict=True)], fields)

    fields = ["kind", "key", "doc_id", "n", "width", "body"]
    arrow = [pa.string(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(split, schema)
    # equal chunks are equal rows; equal recipes are repeated rows, which count
    first = [F.first(c).alias(c) for c in ("doc_id", "n", "width", "body")]
    rows.groupBy("kind", "key").agg(*first, F.count(F.lit(1)).alias("copies")).write.partitionBy("kind").parquet(f"{path}/parts")

    parts = spark.read.schema(PARTS_SCHEMA).parquet(f"{path}/parts")
    recipes = parts.where(F.col("kind") == RECIPE).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start = 0
        for batch in batches:
            names = [[bytes(b)[i : i + 16] for i in range(0, len(b), 16)] for b in batch["body"]]
            n = batch["n"].astype("int64")
            ends = start + n.cumsum()
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype("Int64"),
                    "shard": batch["shard"],
                    "start_in_shard": ends - n,
                    "n_tokens": n,
                    "root": [merkle(x) for x in names],
                    "digests": names,
                }
            )
            start = int(ends.iloc[-1]) if len(ends) else start

    ordered = recipes.repartitionByRange(F.col("doc_id").asc_nulls_first(), "key").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "key")
    ordered.select("doc_id", "n", "body", F.spark_partition_id().alias("shard")).mapInPandas(number, RECIPES_SCHEMA).write.parquet(f"{path}/recipes")

    # a shard's documents are one task's rows here too; they pass in a stream
    def seal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["shard", "n_docs", "n_ids", "root"]
        shard, n_docs, n_ids, fold = None, 0, 0, MerkleFold()
        for batch in batches:
            done = []
            for own_shard, doc, n, root in zip(batch["shard"], batch["doc_id"], batch["n_tokens"], batch["root"], strict=True):
                if own_shard != shard:
                    if n_docs:
                        done.append((shard, n_docs, n_ids, fold.root()))
                    shard, n_docs, n_ids, fold = own_shard, 0, 0, MerkleFold()
                fold.add(_record(doc, n, root))
                n_docs, n_ids = n_docs + 1, n_ids + int(n)
            yield pd.DataFrame(done, columns=columns)
        if n_docs:
            yield pd.DataFrame([(shard, n_docs, n_ids, fold.root())], columns=columns)

    own = spark.read.schema(RECIPES_SCHEMA).parquet(f"{path}/recipes").select("shard", "doc_id", "start_in_shard", "n_tokens", "root")
    own.repartition("shard").sortWithinPartitions("shard", "start_in_shard").mapInPandas(seal, MANIFESTS_SCHEMA).write.parquet(f"{path}/manifests")


def _record(doc, n: int, root: bytes) -> bytes:
    return _digest(f"{None if pd.isna(doc) else int(doc)}|{int(n)}|".encode() + bytes(root))


def chunks(spark: SparkSession, path: str) -> DataFrame:
    stored = spark.read.schema(PARTS_SCHEMA).parquet(f"{path}/parts").where(F.col("kind") == CHUNK)
    return stored.select(F.col("key").alias("digest"), F.col("n").alias("n_ids"), "width", "body")


def recipes(spark: SparkSession, path: str) -> DataFrame:
    """The recipes with ``start``, the ids of all documents before. Only one row a shard meets in one task."""
    own = spark.read.schema(RECIPES_SCHEMA).parquet(f"{path}/recipes")
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = spark.read.schema(MANIFESTS_SCHEMA).parquet(f"{path}/manifests").select("shard", F.coalesce(F.sum("n_ids").over(ahead), F.lit(0)).alias("before"))
    return own.join(totals, "shard").withColumn("start", F.col("before") + F.col("start_in_shard")).drop("before")


def reconstruct(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """doc_id, start, ids (little-endian 4-byte integers): the documents of ``wanted`` (doc_id), or all."""
    own = recipes(spark, path)
    if wanted is not None:
        own = own.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    named = own.select("doc_id", "start", F.posexplode("digests").alias("k", "digest"))
    found = named.join(chunks(spark, path), "digest")
    whole = found.groupBy("doc_id", "start").agg(F.sort_array(F.collect_list(F.struct("k", "width", "body"))).alias("parts"))

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = [b"".join(unpack(bytes(p["body"]), p["width"]).tobytes() for p in parts) for parts in batch["parts"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "start": batch["start"], "ids": ids})

    return whole.mapInPandas(join, "doc_id long, start long, ids binary")


def _times(a: int, b: int) -> int:
    """Product of polynomials over GF(2) modulo that of CRC-32, bits reflected."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


@cache
def _shifts(bits: int = 40) -> np.ndarray:
    """bits x 4 x 256: for each power of two of bytes that follow, what each byte of a CRC-32 turns into."""
    out, square = np.zeros((bits, 4, 256), np.uint32), 0x00800000  # x^8
    value = np.arange(256, dtype=np.uint32)
    for k in range(bits):
        for byte in range(4):
            for bit in range(8):
                moved = _times(square, 1 << (8 * byte + bit))
                out[k, byte] ^= np.where(value >> bit & 1, np.uint32(moved), np.uint32(0))
        square = _times(square, square)
    return out


def crc_moved(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """CRC-32s as parts of that of a longer text, in which ``n_bytes`` follow: these, combined by xor, are its own."""
    crc, n_bytes = crc.astype(np.uint32), n_bytes.astype(np.int64)
    for k, table in enumerate(_shifts()):
        at = np.flatnonzero(n_bytes >> k & 1)
        if len(at):
            c = crc[at]
            crc[at] = table[0][c & 255] ^ table[1][c >> 8 & 255] ^ table[2][c >> 16 & 255] ^ table[3][c >> 24]
        elif not (n_bytes >> k).any():
            break
    return crc


def document_sums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, verified, read back from the files.

    Each stored chunk is read once, unpacked, held against its digest and summed; a document's sum comes
    from those of its chunks by the algebra of CRC-32, so the ids needn't be shuffled a second time.
    ``verified``: all chunks are there with the right ids, their number and the Merkle root agree.
    """

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for digest, width, body in zip(batch["digest"], batch["width"], batch["body"], strict=True):
                ids = unpack(bytes(body), width).tobytes()
                rows.append((bytes(digest), len(ids) // 4, zlib.crc32(ids), _digest(ids) == bytes(digest)))
            yield pd.DataFrame(rows, columns=["digest", "m", "crc", "whole"])

    sums = chunks(spark, path).select("digest", "width", "body").mapInPandas(check, "digest binary, m int, crc long, whole boolean")
    sums = stored(sums, "sums")
    own = recipes(spark, path).withColumn("row", F.struct("shard", "start_in_shard"))
    named = own.select("row", "doc_id", "start", "n_tokens", "root", F.posexplode("digests").alias("k", "digest"))
    # chunks that very many documents name: at most 1 in HOT of all names, so their rows are few and go to every task
    count = named.groupBy("digest").agg(F.count(F.lit(1)).alias("uses"))
    total = spark.read.schema(RECIPES_SCHEMA).parquet(f"{path}/recipes").agg(F.coalesce(F.sum(F.size("digests")), F.lit(0))).head()[0]
    hot = stored(count.where(F.col("uses") > max(total // HOT, 1000)).join(sums, "digest", "left").drop("uses"), "hot")
    cold = named.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(sums, "digest", "left")
    found = cold.unionByName(named.join(F.broadcast(hot), "digest"))
    parts = F.sort_array(F.collect_list(F.struct("k", "m", "crc", "whole", "digest"))).alias("parts")
    whole = found.groupBy("row", "doc_id", "start", "n_tokens", "root").agg(parts).drop("row")

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("parts")
            firsts = parts.offsets.to_numpy() - parts.offsets[0].as_py()  # every text has a chunk at least
            if not len(batch):
                continue
            of = dict(zip(["k", "m", "crc", "whole", "digest"], parts.flatten().flatten(), strict=True))
            there = pc.fill_null(of["whole"], False).to_numpy(zero_copy_only=False)
            m = np.where(there, pc.fill_null(of["m"], 0).to_numpy(), 0).astype(np.int64)
            crc = np.where(there, pc.fill_null(of["crc"], 0).to_numpy(), 0).astype(np.uint32)
            n = np.add.reduceat(m, firsts[:-1])
            after = np.repeat(np.cumsum(n), np.diff(firsts)) - np.cumsum(m)
            crc = np.bitwise_xor.reduceat(crc_moved(crc, 4 * after), firsts[:-1])
            good = np.logical_and.reduceat(there, firsts[:-1]) & (n == batch.column("n_tokens").to_numpy())
            names = of["digest"].to_pylist()
            roots = [merkle(names[x:y]) for x, y in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)]
            good &= np.array([x == y for x, y in zip(roots, batch.column("root").to_pylist(), strict=True)])
            columns = [batch.column("doc_id"), batch.column("start"), pa.array(n), pa.array(crc.astype(np.int64)), pa.array(good)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "verified"])

    return whole.mapInArrow(combine, "doc_id long, start long, n_tokens long, ids_crc32 long, verified boolean")


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "tokens")
    write_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return document_sums(spark, path)
