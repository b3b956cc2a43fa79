"""A prefix trie of conversations, with count-min screening.

``turns`` numbers each conversation's turns; ``trie`` returns one row for each distinct prefix of turns (role, text).

1. Turns become digests, and a prefix of d turns is named by the xor of 128-bit hashes of (digest, position). An xor over
   slices of a conversation can be put together, so a conversation of any length is read in slices.
2. Screening: a count-min sketch of all prefix names is counted in tasks and merged by blocks. It never counts too
   little, so an estimate of one proves that a prefix has one member. Such rows are emitted where they are: their
   values follow from their own conversation, but for the first of them, which looks up its parent.
3. Only prefixes with a higher estimate are shuffled and grouped exactly (those let through by mistake are groups
   of one). Groups are held together by depth, name, parent's name and the SHA-256 of the last turn; two prefixes of
   one name stop the job.
4. Sums over subtrees need no walk. Each node is represented by its smallest member, and is counted in that
   conversation's credit; a node's sum is the credit of all its members, less what its own representative has above it.

The sketch has ``CELLS`` cells for each prefix in each of ``SKETCH_ROWS`` rows, a bit for each cell, and ``MOST_BITS`` in all:
that bounds the broadcast. With more prefixes it lets more of them through, and the result stays the same.
Long conversations are scanned by blocks of ``BLOCK`` turns; parents with many children are looked up by a broadcast of
``HOT`` rows at most; members that end in a node are written in pieces of ``PIECE`` bytes before they are hashed in order.

Results for odd input: a null role or text counts as empty; rows without conv_id belong to no conversation and are left
out; turns are in order of ``turn``, null first, and equal numbers in order of the SHA-256 of role and text (repeated rows
are turns of their own); very long texts are hashed whole; an empty table gives an empty result, even without a root.
Extra columns are left out, so names can't clash. Ids are cast to long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvatlas.llm.shared import dropped, stored, table

CELLS, SKETCH_ROWS, MOST_BITS, BLOCK, HOT, LEAST_HOT, PIECE = 4, 4, 1 << 29, 4096, 1000, 1000, 1 << 16
NAME = ["depth", "x1", "x2"]
_BITS = 16  # of a place within a block of the sketch


# --- sequences: conv_id, depth (0 and on), length, item (digest of the turn, null at depth 0), chars ---


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Sequences of a table of turns. Turns are dealt out in ranges, so no task holds more of a conversation than of any other."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("item"),
        F.length(text).cast("long").alias("chars"),
        F.monotonically_increasing_id().alias("copy"),  # lets a range end between equal rows
    )
    rows = stored(rows, "turns")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "item", "copy"]
    slices = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "item", "chars", F.monotonically_increasing_id().alias("at")), "slices")
    dropped(rows)
    slices = slices.withColumn("slice", F.shiftright("at", 33))
    runs = slices.groupBy("conv_id", "slice").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("conv_id")
    before = F.coalesce(F.sum("n").over(own.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("conv_id", "slice", "first", before.alias("before"), F.sum("n").over(own).alias("length"))
    tops = runs.where("before = 0").select("conv_id", F.lit(0).cast("long").alias("depth"), "length", F.lit(None).cast("binary").alias("item"), F.lit(0).cast("long").alias("chars"))
    depth = (F.col("before") + F.col("at") - F.col("first") + 1).alias("depth")
    return slices.join(runs, ["conv_id", "slice"]).select("conv_id", depth, "length", "item", "chars").unionByName(tops)


def block(depth: str | Column = "depth") -> Column:
    return F.floor((F.col(depth) if isinstance(depth, str) else depth) / BLOCK)


def by_conversation(rows: DataFrame, convs: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` (conv_id, depth) with the columns of ``convs`` (conv_id, length); a block of a conversation is a key of its own."""
    blocks = convs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), block("length")))).drop("length")
    return rows.withColumn("block", block()).join(blocks, ["conv_id", "block"], how).drop("block")


def running(rows: DataFrame, ident: str, values: dict[str, str], function, both, down: bool = False) -> DataFrame:
    """Running aggregates along depth (from the end if ``down``) of each group, first in blocks, then over the blocks before."""
    rows = rows.withColumn("block", block())
    turned = (lambda c: F.col(c).desc()) if down else F.col
    inside = Window.partitionBy(ident, "block").orderBy(turned("depth")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(ident).orderBy(turned("block")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(ident, "block").agg(*[function(v).alias(v) for v in values])
    carried = totals.select(ident, "block", *[function(v).over(ahead).alias(f"{c}_before") for v, c in values.items()])
    carried = carried.where(" or ".join(f"{c}_before is not null" for c in values.values()))
    found = rows.select("*", *[function(v).over(inside).alias(c) for v, c in values.items()]).join(carried, [ident, "block"], "left")
    for c in values.values():
        found = found.withColumn(c, both(F.col(c), F.coalesce(f"{c}_before", F.lit(0)))).drop(f"{c}_before")
    return found.drop("block")


def named(sequences: DataFrame) -> DataFrame:
    """Sequences with the name of each prefix (x1, x2) and of the one before it (p1, p2)."""
    keys = {"k1": F.xxhash64("item", "depth"), "k2": F.xxhash64(F.lit(1), "depth", "item")}
    rows = sequences.select("*", *[F.when(F.col("depth") == 0, F.lit(0)).otherwise(k).cast("long").alias(c) for c, k in keys.items()])
    rows = running(rows, "conv_id", {"k1": "x1", "k2": "x2"}, F.bit_xor, lambda a, b: a.bitwiseXOR(b))
    return rows.select("conv_id", "depth", "length", "item", "chars", "x1", "x2", *[F.col(f"x{i}").bitwiseXOR(F.col(f"k{i}")).alias(f"p{i}") for i in (1, 2)])


# --- the sketch ---


def cells(a: np.ndarray, b: np.ndarray, width: int) -> list[np.ndarray]:
    """The cell of each name in each row of the sketch, counted through all rows."""
    a, b = a.view(np.uint64), b.view(np.uint64) | np.uint64(1)
    return [((a + np.uint64(r) * b) >> np.uint64(7) & np.uint64(width - 1)) + np.uint64(r * width) for r in range(SKETCH_ROWS)]


def _columns(batch: pa.RecordBatch, names: tuple[str, ...]) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for c in names]


def sketch(names: DataFrame, width: int) -> np.ndarray:
    """Bits of the cells that were counted more than once. ``names``: x1, x2.

    Tasks count their own names and send, for each block of cells, which were met once and which more often.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            found, n = np.unique(np.concatenate(cells(*_columns(batch, ("x1", "x2")), width)), return_counts=True)
            blocks, starts = np.unique(found >> np.uint64(_BITS), return_index=True)
            places, ends = (found & np.uint64((1 << _BITS) - 1)).astype("<u2"), [*starts[1:], len(found)]
            once = [places[s:e][n[s:e] == 1].tobytes() for s, e in zip(starts, ends, strict=True)]
            more = [places[s:e][n[s:e] > 1].tobytes() for s, e in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(blocks.astype(np.int64)), pa.array(once, pa.binary()), pa.array(more, pa.binary())], ["block", "once", "more"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seen = None, np.zeros(1 << _BITS, np.uint8)
        done = lambda: pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), pa.array([np.packbits(seen > 1).tobytes()], pa.binary())], ["block", "bits"])
        for batch in batches:
            for b, once, more in zip(*[batch.column(c).to_pylist() for c in ("block", "once", "more")], strict=True):
                if b != current:
                    if current is not None:
                        yield done()
                    current, seen = b, np.zeros(1 << _BITS, np.uint8)
                at = np.frombuffer(once, "<u2")
                seen[at] = np.minimum(seen[at] + 1, 2)
                seen[np.frombuffer(more, "<u2")] = 2
        if current is not None:
            yield done()

    parts = names.select("x1", "x2").mapInArrow(count, "block long, once binary, more binary")
    merged = parts.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block long, bits binary").toArrow()
    bits = np.zeros(max(SKETCH_ROWS * width, 1 << _BITS) >> 3, np.uint8)
    size = 1 << _BITS - 3
    for b, own in zip(merged.column("block").to_pylist(), merged.column("bits").to_pylist(), strict=True):
        bits[b * size : (b + 1) * size] = np.frombuffer(own, np.uint8)
    return bits


def screened(rows: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """Named sequences with ``shared`` (the prefix may have several members) and ``below_shared`` (the one before it may)."""
    spark, n = rows.sparkSession, rows.count()
    width = min(1 << max(_BITS, (CELLS * n).bit_length()), 1 << max(3, (most_bits // SKETCH_ROWS).bit_length() - 1))
    bits = spark.sparkContext.broadcast(sketch(rows, width))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_of = bits.value
        for batch in batches:
            several = []
            for names in (("x1", "x2"), ("p1", "p2")):
                all_met = np.ones(len(batch), bool)
                for at in cells(*_columns(batch, names), width):
                    all_met &= (table_of[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8) & 1).astype(bool)
                several.append(all_met)
            several[1] &= batch.column("depth").to_numpy() > 0
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, several)], [*batch.schema.names, "shared", "below_shared"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(look, f"{types}, shared boolean, below_shared boolean")


# --- nodes ---


def ends(rows: DataFrame) -> DataFrame:
    """depth, x1, x2, ends_sha256 of the conversations (conv_id) that end in each node.

    Ids are joined to pieces in sorted ranges of all rows, and only pieces of a node meet, in order and one at a time.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ids, size = None, [], 0
        kinds = [pa.int64()] * 4 + [pa.binary()]
        done = lambda: pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((*name, ids[0], ",".join(map(str, ids)).encode()), kinds, strict=True)], [*NAME, "first", "piece"])
        for batch in batches:
            for *own, conv in zip(*[batch.column(c).to_pylist() for c in (*NAME, "conv_id")], strict=True):
                if ids and (own != name or size >= PIECE):
                    yield done()
                    ids, size = [], 0
                name = own
                ids.append(conv)
                size += len(str(conv)) + 1
        if ids:
            yield done()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, so_far = None, None
        done = lambda: pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in name], pa.array([so_far.hexdigest()])], [*NAME, "ends_sha256"])
        for batch in batches:
            for *own, piece in zip(*[batch.column(c).to_pylist() for c in (*NAME, "piece")], strict=True):
                if own != name:
                    if name is not None:
                        yield done()
                    name, so_far = own, hashlib.sha256(piece)
                else:
                    so_far.update(b"," + piece)
        if name is not None:
            yield done()

    order = [*NAME, "conv_id"]
    pieces = rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, "depth long, x1 long, x2 long, first long, piece binary")
    return pieces.repartition(*NAME).sortWithinPartitions(*NAME, "first").mapInArrow(digest, "depth long, x1 long, x2 long, ends_sha256 string")


def with_parents(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows`` (depth, p1, p2, conv_id) with parent_conv_id; ``nodes``: depth, x1, x2, conv_id, n_children.

    A parent that isn't in ``nodes`` has one member, the row's own. Of parents with more than one in ``HOT`` of all children there are ``HOT`` at most.
    """
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent"), "n_children")
    most = max(nodes.agg(F.coalesce(F.sum("n_children"), F.lit(0))).head()[0] // HOT, LEAST_HOT)
    hot, rest = parents.where(F.col("n_children") > most).drop("n_children"), parents.where(F.col("n_children") <= most).drop("n_children")
    key = ["depth", "p1", "p2"]
    found = rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(rest, key, "left"), allowMissingColumns=True)
    return found.withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id"))).drop("parent")


def trie(sequences: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row for each node of the trie."""
    sequences = stored(sequences, "sequences")
    rows = stored(named(sequences), "named")
    dropped(sequences)
    flagged = stored(screened(rows, most_bits), "screened")
    dropped(rows)
    shared, alone = flagged.where("shared"), flagged.where("not shared")

    # exact groups of the prefixes that may be shared
    same = ("item", "p1", "p2")
    groups = shared.groupBy(*NAME).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("length").alias("longest"), F.max("chars").alias("chars"),
        *[f(c).alias(c if f is F.min else f"{c}_max") for c in same for f in (F.min, F.max)],
    )
    clash = F.lit(False)
    for c in same:
        clash |= ~F.col(c).eqNullSafe(F.col(f"{c}_max"))
    groups = groups.select(
        *NAME, "p1", "p2", "conv_id",
        F.when(clash, F.raise_error(F.lit("two prefixes have one name"))).otherwise(F.col("n_convs")).alias("n_convs"),
        (F.col("longest") == F.col("depth")).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
    )
    groups = stored(groups, "groups")

    # children: groups, and rows that were proved single right below a group
    born = groups.where("depth > 0").select("depth", "p1", "p2").unionByName(alone.where("below_shared").select("depth", "p1", "p2"))
    children = born.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count(F.lit(1)).alias("n_children"))

    # each conversation's credit: the nodes that it represents
    convs = flagged.where("depth = length").select("conv_id", "length", (~F.col("shared")).cast("long").alias("leaf"), F.lit(0).cast("long").alias("saved"))
    own = groups.select("conv_id", F.lit(None).cast("long").alias("length"), "leaf", "saved")
    credit = convs.unionByName(own).groupBy("conv_id").agg(F.max("length").alias("length"), F.sum("leaf").alias("leaf_credit"), F.sum("saved").alias("saved_credit"))
    members = by_conversation(shared.select("conv_id", *NAME), credit)
    sums = members.groupBy(*NAME).agg(
        F.sum("leaf_credit").alias("n_leaves"), F.sum("saved_credit").alias("of_members"),
        F.max_by("saved_credit", -F.col("conv_id")).alias("of_own"),
    )
    below = running(groups, "conv_id", {"saved": "saved_below"}, F.sum, lambda a, b: a + b, down=True)
    nodes = (
        below.join(children, NAME, "left").join(sums, NAME).join(ends(shared.where("depth = length")), NAME, "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0)))
        .withColumn("saved_tokens", F.col("of_members") - F.col("of_own") + F.col("saved_below"))
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
    )
    result = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nodes = stored(nodes.select(*NAME[1:], "p1", "p2", *result), "nodes")
    last = F.col("depth") == F.col("length")
    singles = alone.select(
        "conv_id", "depth", F.lit(1).cast("long").alias("n_convs"), (~last).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"), F.sha2(F.when(last, F.col("conv_id").cast("string")).otherwise(F.lit("")), 256).alias("ends_sha256"), "p1", "p2", "below_shared",
    )
    tails = singles.where("not below_shared").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    asking = nodes.select(*result, "p1", "p2").unionByName(singles.where("below_shared").drop("below_shared"))
    result.insert(2, "parent_conv_id")
    return with_parents(asking, nodes).select(*result).unionByName(tails.select(*result))


# --- the query ---


def rebuilt(sequences: DataFrame) -> DataFrame:
    """Each conversation c with the first h turns of conversation c - c % 100 in place of its own; h = crc32(c) % 6."""
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).alias("taken")
    base = F.col("conv_id") - F.col("conv_id") % 100
    heads = (
        sequences.where((F.col("conv_id") % 100 == 0) & F.col("depth").between(1, 5))
        .groupBy(F.col("conv_id").alias("base"))
        .agg(F.sort_array(F.collect_list(F.struct("depth", "item", "chars"))).alias("head"))
    )
    convs = sequences.where("depth = 0").select("conv_id", F.col("length").alias("own"), taken, base.alias("base")).join(heads, "base", "left")
    convs = convs.select("conv_id", "own", F.slice(F.coalesce("head", F.array().cast("array<struct<depth:bigint,item:binary,chars:bigint>>")), F.lit(1), F.col("taken").cast("int")).alias("head"))
    convs = convs.withColumn("before", F.size("head").cast("long"))
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    convs = convs.withColumn("length", F.col("before") + F.greatest(F.col("own") - taken, F.lit(0)))
    top = F.array(F.struct(F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("item"), F.lit(0).cast("long").alias("chars")))
    first = convs.select("conv_id", "length", F.inline(F.concat(top, "head")))
    # blocks are those of the conversation's own turns
    after = by_conversation(sequences.where(F.col("depth") > taken).drop("length"), convs.select("conv_id", "before", F.col("length").alias("new_length"), F.col("own").alias("length")))
    after = after.select("conv_id", F.col("new_length").alias("length"), (F.col("depth") - taken + F.col("before")).alias("depth"), "item", "chars")
    columns = ["conv_id", "depth", "length", "item", "chars"]
    return first.select(*columns).unionByName(after.select(*columns))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(stored(turns(table(spark, sf_dir, "conversations")), "numbered")))


OP12_SQL = r"""
with recursive byte as (select range::ubigint n from range(256)),
shifted as (
  select n, 0 k, n v from byte
  union all
  select n, k + 1, case when v % 2 = 1 then xor(v >> 1, 3988292384::ubigint) else v >> 1 end from shifted where k < 8),
lookup as (select list(v order by n) l from shifted where k = 8),
ids as (select distinct conv_id from conversations where conv_id is not null),
hashed as (
  select conv_id, xor(list_reduce(list_prepend(4294967295::ubigint, [ascii(x)::ubigint for x in string_split(conv_id::varchar, '')]),
                         lambda c, b: xor(c >> 8, l[(xor(c, b) & 255)::int + 1])), 4294967295::ubigint) % 6 h
  from ids, lookup),
own as (
  select conv_id, coalesce(role, '') r, coalesce(text, '') t,
         row_number() over (partition by conv_id order by turn nulls first, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) p
  from conversations where conv_id is not null),
parts as (
  select h.conv_id, 0 side, o.p, o.r, o.t from hashed h join own o on o.conv_id = h.conv_id - h.conv_id % 100 and o.p <= h.h
  union all
  select h.conv_id, 1, o.p, o.r, o.t from hashed h join own o on o.conv_id = h.conv_id and o.p > h.h),
turns as (
  select conv_id, t, r, row_number() over (partition by conv_id order by side, p) depth, count(*) over (partition by conv_id) len from parts),
chained as (
  select conv_id, depth, len, t,
         sha256(string_agg(sha256(length(r) || ':' || r || t), '') over (partition by conv_id order by depth)) k from turns),
prefixes as (
  select conv_id, 0 depth, coalesce(len, 0) len, '' t, '' k, null::varchar up from ids left join (select distinct conv_id, len from turns) using (conv_id)
  union all
  select conv_id, depth, len, t, k, coalesce(lag(k) over (partition by conv_id order by depth), '') from chained),
nodes as (
  select depth, k, min(up) up, min(conv_id) conv_id, count(*) n_convs, (count(*) - 1) * max(length(t)) saved, max(len) = depth childless,
         sha256(coalesce(string_agg(case when len = depth then conv_id::varchar end, ',' order by conv_id), '')) ends_sha256
  from prefixes group by depth, k),
below as (
  select p.depth, p.k, sum(saved) saved_tokens, sum(childless::int) n_leaves
  from nodes n join prefixes p on p.conv_id = n.conv_id and p.depth <= n.depth
  group by all)
select n.conv_id, n.depth::bigint depth, u.conv_id parent_conv_id, n.n_convs,
       (select count(*) from nodes c where c.depth = n.depth + 1 and c.up = n.k) n_children,
       b.n_leaves::bigint n_leaves, b.saved_tokens::bigint saved_tokens, n.ends_sha256
from nodes n join below b using (depth, k) left join nodes u on u.depth = n.depth - 1 and u.k = n.up
"""
