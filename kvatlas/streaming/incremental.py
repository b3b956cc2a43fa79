"""Statistics of a stream of configurations, kept up to date by batches.

Each micro-batch writes its own counts, in a folder named by its id, so a batch that is replayed writes the same folder
again and counts once. The state is the sum of these counts; ``compact`` writes it as a base and later reads take the
base and the batches after it. What is counted (values, contexts, pairs, configurations) gives the tables of statistics,
contexts and co-occurrence without a look at the corpus. A configuration comes whole in one batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvatlas.operators import configs as C
from kvatlas.operators.fulltext import opened


def counts_of(kv: DataFrame, configs: DataFrame, keys: tuple[str, ...] = C.CONTEXT_KEYS) -> DataFrame:
    """kind, a, b, n of some configurations: 'value' (tag, value), 'context' (tag, context), 'pair' (two tags), 'configs'."""
    named = lambda kind, df, a, b, n: df.select(F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(b).cast("string").alias("b"), F.col(n).cast("long").alias("n"))
    values = kv.groupBy("tag", "value").agg(F.count(F.lit(1)).alias("n"))
    total = configs.agg(F.count(F.lit(1)).alias("n")).select(F.lit("").alias("a"), F.lit("").alias("b"), "n")
    return (
        named("value", values, "tag", "value", "n")
        .unionByName(named("context", C.context_counts(kv, keys), "tag", "context", "n"))
        .unionByName(named("pair", C.cooccurrence(kv), "a", "b", "n"))
        .unionByName(named("configs", total, "a", "b", "n"))
    )


def updates(path: str, keys: tuple[str, ...] = C.CONTEXT_KEYS) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` of a stream of config_id, config_json."""

    def update(batch: DataFrame, batch_id: int) -> None:
        if batch_id <= _base(batch.sparkSession, path):
            return  # replayed, and in the base already
        configs = batch.select("config_id", "config_json").persist()
        kv = C.exploded(configs).select("config_id", "tag", F.col("value_json").alias("value"))
        counts_of(kv, configs, keys).write.mode("overwrite").parquet(f"{path}/batches/batch={batch_id}")
        configs.unpersist()

    return update


def _base(spark: SparkSession, path: str) -> int:
    """The last batch that the newest base has, or -1."""
    bases = opened(spark, f"{path}/bases")
    return -1 if bases is None else bases.agg(F.max("upto")).head()[0]


def state(spark: SparkSession, path: str) -> DataFrame | None:
    """kind, a, b, n of all batches, or None before the first."""
    upto, batches = _base(spark, path), opened(spark, f"{path}/batches")
    parts = [] if batches is None else [batches.where(F.col("batch") > upto).drop("batch")]
    if upto >= 0:
        parts.append(spark.read.parquet(f"{path}/base-{upto}"))
    if not parts:
        return None
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


def compact(spark: SparkSession, path: str) -> None:
    """Write the state as a base. It counts from the moment it is listed, which comes last."""
    batches, upto = opened(spark, f"{path}/batches"), _base(spark, path)
    last = upto if batches is None else batches.agg(F.max("batch")).head()[0]
    if last > upto:
        state(spark, path).write.mode("overwrite").parquet(f"{path}/base-{last}")
        spark.createDataFrame([(last,)], "upto long").coalesce(1).write.mode("append").parquet(f"{path}/bases")


def _of(counts: DataFrame, kind: str, a: str, b: str, n: str) -> DataFrame:
    return counts.where(F.col("kind") == kind).select(F.col("a").alias(a), F.col("b").alias(b), F.col("n").alias(n))


def tag_stats(counts: DataFrame, k: int | None = 5) -> DataFrame:
    return C.stats_of_counts(_of(counts, "value", "tag", "value", "c"), _of(counts, "configs", "_a", "_b", "total_configs").select("total_configs"), k)


def contexts(counts: DataFrame, k: int = 5) -> DataFrame:
    return C.contexts_of_counts(_of(counts, "context", "tag", "context", "n"), k)


def cooccurrence(counts: DataFrame) -> DataFrame:
    return _of(counts, "pair", "a", "b", "n")
