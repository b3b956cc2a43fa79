"""Exact dedup by skew-safe combining (built-in functions only).

1. Each task combines its own rows of one text (Spark's partial aggregate).
2. The survivors meet by (digest, salt, text), so a text that a third of all rows repeat is spread over
   ``salts`` groups.
3. The winners of the salts meet by (digest, text): at most ``salts`` rows a text.

Every stage groups by the whole normalised text beside its digest, so texts are compared in full and a
clash of digests can't merge two of them. Only digests, lengths and ids travel back to the rows; groups of more than
one row in ``HOT`` go back by a broadcast of at most ``HOT`` rows, and their own rows are dealt out by a salt.

Results for odd input: null text counts as empty, and all texts that are empty after normalising form one
group; a row without id ranks after those with ids; rows that agree in text, length and id tie, and each of
them counts in ``group_size`` and is marked like the winner (``exact_dedup`` returns the one with the least hash of
its columns: the texts then differ in white space only and are equally long); long texts are compared whole; an empty
table gives an empty result. Extra columns never clash: the input is projected first, or its columns are told apart
by names that it doesn't have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvatlas.llm.shared import BLANK, stored, table

SALTS, HOT = 64, 1000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{BLANK}]+", "")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, chars, norm, and digests of norm: with these alone, results travel back without the text."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.length(F.coalesce(text_col, F.lit(""))).alias("chars"),
        normalised(F.col(text_col)).alias("norm"),
    )
    return rows.select("doc_id", "chars", "norm", F.sha2("norm", 256).alias("sha"), F.xxhash64("norm").alias("second"))


def winners(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """sha, second, keep_id, keep_chars, group_size: one row for each different text of ``rows`` (``_keyed``)."""
    best = F.min(F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id"))
    salted = (
        rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "chars"), F.lit(salts)))
        .groupBy("sha", "second", "salt", "norm")
        .agg(best.alias("best"), F.count(F.lit(1)).alias("n"))
    )
    return (
        salted.groupBy("sha", "second", "norm")
        .agg(F.min("best").alias("best"), F.sum("n").alias("group_size"))
        .select("sha", "second", F.col("best.doc_id").alias("keep_id"), (-F.col("best.less")).alias("keep_chars"), "group_size")
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each input row."""
    rows = _keyed(docs, id_col, text_col)
    best = stored(winners(rows, salts), "exact")
    total = best.agg(F.coalesce(F.sum("group_size"), F.lit(0))).head()[0]
    found = ["keep_id", "keep_chars", "group_size"]
    hot = best.where(F.col("group_size") > max(total // HOT, 1000)).select("sha", "second", F.struct(*found).alias("hot"))
    rest = best.select(F.col("sha").alias("at"), F.col("second").alias("at_second"), F.struct(*found).alias("own"))
    # a row that the broadcast served meets no row of the rest, and a salt spreads such rows
    at = F.when(F.col("hot").isNull(), F.col("sha")).otherwise(F.concat_ws("-", "sha", F.pmod(F.xxhash64("doc_id", "chars"), F.lit(997))))
    rows = rows.select("doc_id", "chars", "sha", "second").join(F.broadcast(hot), ["sha", "second"], "left").withColumn("key", at)
    rows = rows.join(rest, (F.col("key") == F.col("at")) & (F.col("second") == F.col("at_second")), "left").withColumn("best", F.coalesce("hot", "own"))
    return rows.select(
        "doc_id",
        F.col("best.keep_id").alias("keep_id"),
        F.col("best.group_size").alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.col("best.keep_id")) & (F.col("chars") == F.col("best.keep_chars"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of equal winning rows, one.

    Rows are told apart by id, length and digests; of rows alike in these, the one with the least hash of all columns
    that can be hashed stays, so reruns agree. Repeated rows are merged in their tasks before they meet, and the
    join with the winners keeps that partitioning.
    """
    names = docs.columns
    plain = [f.name for f in docs.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    key = {
        "no_id": F.col(id_col).isNull(),
        "id": F.coalesce(F.col(id_col).cast("string"), F.lit("")),
        "chars": F.length(F.coalesce(text_col, F.lit(""))),
        "sha": F.sha2(normalised(F.col(text_col)), 256),
    }
    own = {k: f"_{k}{'_' * max(map(len, names), default=0)}" for k in key}  # longer than all names
    pick = f"_pick{'_' * max(map(len, names), default=0)}"
    rows = docs.select("*", *[c.alias(own[k]) for k, c in key.items()]).groupBy(*own.values())
    rows = rows.agg(F.min_by(F.struct(*names), F.xxhash64(*plain)).alias(pick)).select(*own.values(), f"{pick}.*")
    best = winners(_keyed(docs, id_col, text_col), salts).select(
        F.col("keep_id").isNull().alias(own["no_id"]), F.coalesce(F.col("keep_id").cast("string"), F.lit("")).alias(own["id"]), F.col("keep_chars").alias(own["chars"]), F.col("sha").alias(own["sha"])
    )
    return rows.join(best, list(own.values()), "left_semi").select(*names)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
with d as (
  select doc_id, length(coalesce(text, '')) chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') norm
  from documents)
select doc_id,
       first_value(doc_id) over (partition by norm order by chars desc, doc_id
                                 rows between unbounded preceding and unbounded following) keep_id,
       count(*) over (partition by norm) group_size,
       doc_id = first_value(doc_id) over (partition by norm order by chars desc, doc_id
                                 rows between unbounded preceding and unbounded following) kept,
       sha256(norm) text_sha256
from d
"""
