"""Mixing sources to target weights by systematic sampling (built-in functions only).

Every document of a source is expected ``rate = target / source size`` times. The documents of a source
stand in a fixed order; the running sum of their expected copies plus one random offset of the source
crosses integers, and a document is emitted once for each integer crossed while it is added. The order
goes by size first, so each stretch of the running sum holds documents of like size and the words taken
stay within about one document of each size class of the target.

The order is (size class, hash of id and text, size, id). The running sum is two-level: documents are counted by
(source, size class, hash bucket), those counts are summed within each source, and ranks are taken inside one
bucket only. Buckets are ranges of the hash and as many as the number of rows asks for (``PER_BUCKET``), so they hold
alike numbers of rows at every size, and the result doesn't depend on them. Rows that agree in id, source and text are
counted first and take one place in the order, ``n`` long. Per source there is one row of weights and targets; those
rows, not documents, meet in a single window.

Results for odd input: null or blank text has size 0 and may be taken, adding no words; a null source is a
source of its own, last in order; a source of size 0 has target 0 and takes nothing; rows that agree in id,
source and text tie, and which of them is repeated doesn't show (rows without id are spread by their texts); long texts count whole; an empty table gives an empty result.
Extra columns never clash: the operator projects first, or takes names longer than all there are. One row for each
source meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvatlas.llm.shared import table, word_count

#: Weights dealt to the sources in order, again and again; the words wanted as a fraction of all words; the
#: most copies a document may have.
WEIGHTS, SHARE, MOST = (3, 1, 2), (3, 2), 2
LEAST_BUCKETS, PER_BUCKET, SEED = 64, 1_000_000, 20240229
#: Alike rows are written out in steps of so many, so that no array grows with their number.
STEP = 100_000


def _hash31(*parts: Column) -> Column:
    """31 bits that every engine with md5 can compute."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("long") % F.lit(1 << 31)


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target of each source, from rows with source and size.

    Targets are proportional to the weights but stop at ``most`` times the source's size. Sources reach that
    stop in the order of most * size / weight; with the sources before it stopped, a source stops if its own
    ratio is no larger than the level that the rest would get. All sums are of integers, hence exact.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    dealt = F.array(*[F.lit(w) for w in weights])[F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))]
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("w", dealt.cast("long"))
    up, down = share
    level = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").isNull(), "source")
    before, every = level.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stopped = (
        by_source.withColumn("cap", F.col("source_size") * most)
        .withColumn("rest", F.sum("source_size").over(every) * up - down * F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("w_rest", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("stops", F.col("cap") * down * F.col("w_rest") <= F.col("rest") * F.col("w"))
    )
    open_rest = F.sum("source_size").over(every) * up - down * F.sum(F.when(F.col("stops"), F.col("cap")).otherwise(0)).over(every)
    open_w = F.sum(F.when(F.col("stops"), 0).otherwise(F.col("w"))).over(every)
    return stopped.withColumn("open_rest", open_rest).withColumn("open_w", open_w).select(
        "source",
        "source_size",
        F.when(F.col("stops"), F.col("cap").cast("double"))
        .otherwise((F.col("open_rest") * F.col("w")).cast("double") / (F.col("open_w") * down).cast("double"))
        .alias("target"),
    )


def placed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: tuple[int, int] = SHARE,
    most: int = MOST,
    buckets: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, source, size, t, n, source_size, target, before, rate, offset: one row for each id, source and text.

    ``n`` rows agree in these (``t`` is a hash of the text); ``before`` rows of the source stand before them. ``buckets``
    is derived from the number of rows, which is counted here, unless it is given.
    """
    if buckets is None:
        buckets = LEAST_BUCKETS + docs.count() // PER_BUCKET
    rows = (
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            word_count(text_col).alias("size"),
            _hash31(F.col(id_col), F.col(text_col)).alias("h"),
            F.xxhash64(text_col).alias("t"),
        )
        .groupBy("doc_id", "source", "size", "h", "t")
        .agg(F.count(F.lit(1)).alias("n"))
        # size classes: eight to an octave; small sizes have one each
        .withColumn("size_class", F.floor(F.log2(F.col("size") + 1) * 8).cast("int"))
        .withColumn("bucket", F.shiftright(F.col("h") * F.lit(buckets), 31).cast("int"))
    )
    per_source = targets(rows.select("source", (F.col("size") * F.col("n")).alias("size")), weights, share, most)
    per_source = per_source.select(F.col("source").alias("t_source"), "source_size", "target")
    group = ["source", "size_class", "bucket"]
    ahead = Window.partitionBy("source").orderBy("size_class", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy(*group)
        .agg(F.sum("n").alias("in_group"))
        .withColumn("start", F.coalesce(F.sum("in_group").over(ahead), F.lit(0)))
        .join(per_source, F.col("source").eqNullSafe(F.col("t_source")))
        .select(*[F.col(c).alias(f"g_{c}") for c in group], "start", "source_size", "target")
    )
    within = Window.partitionBy(*group).orderBy("h", "size", F.col("doc_id").isNull(), "doc_id", "t")
    ranked = rows.withColumn("upto", F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # null-safe throughout: no filter is inferred for one side, so all three readers of ``rows`` share one exchange
    same = F.lit(True)
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"g_{c}"))
    offset = _hash31(F.lit(str(seed)), F.col("source").isNull(), F.col("source")).cast("double") / F.lit(float(1 << 31))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    return ranked.join(starts, same).select(
        "doc_id", "source", "size", "t", "n", "source_size", "target", (F.col("start") + F.col("upto") - F.col("n")).alias("before"), rate.alias("rate"), offset.alias("offset")
    )


def _crossed(place: Column) -> Column:
    """Integers crossed up to a place of the order."""
    return F.floor(place.cast("double") * F.col("rate") + F.col("offset")).cast("long")


def copies(docs: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """doc_id, source, size, source_size, target, copies: one row for each input row. ``settings`` are those of ``placed``.

    Alike rows come out of one counted row, by a generator that holds no more than ``STEP`` of them.
    """
    steps = placed(docs, id_col, **settings).withColumn("first", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(STEP).cast("long"))))
    rows = steps.withColumn("i", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + (STEP - 1), F.col("n")))))
    place = F.col("before") + F.col("i")
    return rows.select("doc_id", "source", "size", "source_size", "target", (_crossed(place) - _crossed(place - 1)).alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """``docs`` with each row as often as the mix takes it.

    Identical rows are counted first, in their tasks too, so that they never meet as rows; they share the copies of all
    of them. Rows that agree in id, source and text, but not in other columns, share theirs in the order of a hash.
    Columns must be of types that can be grouped by (no maps, no variants).
    """
    names, source, text = docs.columns, settings.get("source_col", "source"), settings.get("text_col", "text")
    own = {k: f"_{k}{'_' * max(map(len, names))}" for k in ("no_id", "id", "no_source", "source", "size", "t", "n", "all", "copies", "before", "again")}
    key = [own[k] for k in ("no_id", "id", "no_source", "source", "size", "t")]

    def keys(doc_id: Column, of_source: Column, size: Column, t: Column) -> list[Column]:
        plain = lambda c: F.coalesce(c.cast("string"), F.lit(""))
        return [c.alias(k) for c, k in zip((doc_id.isNull(), plain(doc_id), of_source.isNull(), plain(of_source), size, t), key, strict=True)]

    taken = placed(docs, id_col, **settings).withColumn("copies", _crossed(F.col("before") + F.col("n")) - _crossed(F.col("before")))
    taken = taken.select(*keys(*map(F.col, ("doc_id", "source", "size", "t"))), "n", "copies")
    taken = taken.groupBy(*key).agg(F.sum("n").alias(own["all"]), F.sum("copies").alias(own["copies"])).where(F.col(own["copies"]) > 0)
    rows = docs.groupBy(*names).agg(F.count(F.lit(1)).alias(own["n"]))
    rows = rows.select("*", *keys(F.col(id_col), F.col(source), word_count(text), F.xxhash64(text))).join(taken, key)
    order = Window.partitionBy(*key).orderBy(F.xxhash64(*names)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = lambda n: F.floor(F.col(own["copies"]) * n / F.col(own["all"]))
    rows = rows.withColumn(own["before"], F.sum(own["n"]).over(order) - F.col(own["n"]))
    rows = rows.withColumn(own["again"], (share(F.col(own["before"]) + F.col(own["n"])) - share(F.col(own["before"]))).cast("int"))
    rows = rows.where(F.col(own["again"]) > 0).select(*names, F.explode(F.sequence(F.lit(1), F.col(own["again"]))).alias(own["again"]))
    return rows.select(*names)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = copies(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP4_SQL = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size,
         (('0x' || substr(md5(coalesce(doc_id::varchar, '~') || '|' || coalesce(text, '~')), 1, 8))::bigint) % 2147483648 h
  from documents),
s0 as (select source, sum(size)::bigint source_size from sized group by source),
s1 as (select *, [3, 1, 2][1 + (row_number() over (order by source is null, source) - 1) % 3]::bigint w, source_size * 2 cap from s0),
s2 as (select *, (sum(source_size) over () * 3 - 2 * coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0))::bigint rest,
              (sum(w) over () - coalesce(sum(w) over (o rows between unbounded preceding and 1 preceding), 0))::bigint w_rest
       from s1 window o as (order by cap::double / w::double, source is null, source)),
s3 as (select *, cap * 2 * w_rest <= rest * w stops from s2),
s4 as (select *, (sum(source_size) over () * 3 - 2 * sum(case when stops then cap else 0 end) over ())::bigint open_rest,
              sum(case when stops then 0 else w end) over ()::bigint open_w from s3),
t as (select source, source_size, case when stops then cap::double else (open_rest * w)::double / (open_w * 2)::double end target from s4),
p as (select *, row_number() over (partition by source order by floor(log2(size + 1) * 8)::int, h, size, doc_id is null, doc_id) place from sized),
x as (select p.doc_id, p.size, t.source_size, t.target, place,
             case when t.source_size > 0 then t.target / t.source_size::double else 0 end rate,
             ((('0x' || substr(md5('20240229|' || (p.source is null)::varchar || '|' || coalesce(p.source, '~')), 1, 8))::bigint) % 2147483648)::double / 2147483648 off
      from p join t on p.source is not distinct from t.source)
select doc_id, size, source_size, target,
       ((floor(place::double * rate + off) - floor((place - 1)::double * rate + off)) * size)::bigint taken from x
"""
