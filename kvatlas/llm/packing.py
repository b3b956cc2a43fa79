"""Best-fit packing into sequences of several permitted lengths.

A document's whole pieces of the largest length fill a bin each. Its rest is packed: rests are dealt by a hash
into shards of about ``shard_docs`` each, and every shard is packed on its own, so no task ever holds more than
one shard. Inside a shard rests go in order of falling size into the open bin with the least room that still holds
them; if there is none, a new bin is opened.

The cost of a bin is its length plus ``open_cost``. Lengths are optimised jointly. A bin is opened at the length whose
cost for each token is least, by a look ahead: the bin is filled, on trial, with the largest rests to come that
fit, and charged at the smallest permitted length that holds these. One packing is made for each mix of permitted
lengths that may be opened, single lengths among them, and the cheapest one stays. At last every bin is cut down to the
smallest permitted length that holds its contents. So a shard never costs more than with its best single length.

Results for odd input: a document's tokens are its words and one end mark, so null and empty texts are
pieces of size 1; a row without id is packed like any other; repeated rows are packed once each, and are spread over
shards like other rows; a long text has many pieces; nothing is dropped; an empty table gives an empty result; extra
columns are left out of the result, so names can't clash. Ids are cast to long.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvatlas.llm.shared import stored, table, word_count

LENGTHS, OPEN_COST, SHARD_DOCS, RUN = (512, 1024, 2048, 4096, 8192), 16, 1024, 1024
SCHEMA = "doc_id long, piece int, n_tokens long, bin_id string, bin_length int, bin_used long, bin_offset long"


class Shard:
    """Sizes in falling order, and packings of them."""

    def __init__(self, sizes: list[int], lengths: tuple[int, ...], open_cost: int) -> None:
        self.sizes, self.lengths, self.open_cost = sizes, lengths, open_cost
        self.rising = [-s for s in sizes]
        self.filled: dict[tuple[int, int], int] = {}

    def cost(self, used: int) -> int:
        return self.lengths[bisect_left(self.lengths, used)] + self.open_cost

    def fill(self, i: int, length: int) -> int:
        """What a bin that piece i opens would hold, if the largest pieces to come that fit went there."""
        if (i, length) not in self.filled:
            room, j = length - self.sizes[i], i
            while room and (j := bisect_left(self.rising, -room, j + 1)) < len(self.sizes):
                room -= self.sizes[j]
            self.filled[i, length] = length - room
        return self.filled[i, length]

    def pack(self, may: tuple[int, ...]) -> tuple[int, list[list[int]]]:
        """The cost, and bins as lists of indices into the sizes, opening lengths of ``may`` only."""
        room: list[tuple[int, int]] = []
        bins: list[list[int]] = []
        used: list[int] = []
        for i, size in enumerate(self.sizes):
            k = bisect_left(room, (size, -1))
            if k < len(room):
                left, b = room.pop(k)
            else:
                trial = [(f, c) for c in may if c >= size for f in [self.fill(i, c)]]
                left = min(trial, key=lambda x: (self.cost(x[0]) / x[0], x[1]))[1]
                b = len(bins)
                bins.append([])
                used.append(0)
            bins[b].append(i)
            used[b] += size
            if left > size:
                insort(room, (left - size, b))
        return sum(map(self.cost, used)), bins

    def best(self) -> tuple[int, list[list[int]]]:
        """The cheapest packing over all mixes of lengths; ties go to the mix of fewer and smaller lengths."""
        if not self.sizes:
            return 0, []
        mixes = [m for k in range(1, len(self.lengths) + 1) for m in combinations(self.lengths, k) if m[-1] >= self.sizes[0]]
        return min(map(self.pack, mixes), key=lambda x: x[0])


def pack_shard(shard: int, rests: list[tuple[int, object, int]], lengths: tuple[int, ...], open_cost: int) -> Iterator[tuple]:
    """Result rows of a shard's (size, id, piece), which come in falling order of size."""
    _, bins = Shard([r[0] for r in rests], lengths, open_cost).best()
    for b, members in enumerate(bins):
        used, offset = sum(rests[m][0] for m in members), 0
        length = lengths[bisect_left(lengths, used)]
        for m in members:
            size, doc, piece = rests[m]
            yield doc, piece, size, f"{shard}-{b}", length, used, offset
            offset += size


def packed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lengths: tuple[int, ...] = LENGTHS,
    open_cost: int = OPEN_COST,
    shard_docs: int = SHARD_DOCS,
) -> DataFrame:
    """One row for each piece: its bin, the bin's length and use, and the piece's place in the bin."""
    lengths = tuple(sorted(lengths))
    top = lengths[-1]
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), (word_count(text_col) + 1).alias("n"))
    # rows that agree in id and size are counted, so that copies of one row can be told apart and spread
    counted = stored(sized.groupBy("doc_id", "n").agg(F.count(F.lit(1)).alias("copies")), "sizes")
    total = counted.agg(F.coalesce(F.sum("copies"), F.lit(0))).head()[0]
    runs = counted.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / RUN))))
    copy = F.sequence(F.col("run") * RUN, F.least((F.col("run") + 1) * RUN, "copies") - 1)
    rows = runs.select("doc_id", "n", F.explode(copy).alias("copy"))

    whole = F.floor(F.col("n") / top)
    blocks = rows.where(whole > 0).withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((whole - 1) / RUN))))
    full = blocks.select("doc_id", "n", "copy", F.explode(F.sequence(F.col("block") * RUN, F.least((F.col("block") + 1) * RUN, whole) - 1)).alias("piece"))
    own_bin = F.concat_ws("-", F.lit("full"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "n", "copy", "piece")
    full = full.select("doc_id", F.col("piece").cast("int"), F.lit(top).cast("long").alias("n_tokens"), own_bin.alias("bin_id"), F.lit(top).alias("bin_length"), F.lit(top).cast("long").alias("bin_used"), F.lit(0).cast("long").alias("bin_offset"))

    shards = max(1, -(-total // shard_docs))
    rests = rows.select("doc_id", (F.col("n") % top).alias("size"), whole.cast("int").alias("piece"), F.pmod(F.xxhash64("doc_id", "n", "copy"), F.lit(shards)).alias("shard")).where("size > 0")

    def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "doc_id", "piece"], ascending=[False, True, True], na_position="last")
        ids = [None if pd.isna(x) else int(x) for x in group["doc_id"]]
        rows = pack_shard(int(key[0]), list(zip(group["size"].tolist(), ids, group["piece"].tolist(), strict=True)), lengths, open_cost)
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"doc_id": "Int64"})

    return full.unionByName(rests.groupBy("shard").applyInPandas(one, SCHEMA))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
