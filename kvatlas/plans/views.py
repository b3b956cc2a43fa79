"""The tables of a folder, in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PER_PART = 250_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dealt_parts(df: DataFrame, per_part: int = PER_PART) -> int:
    """Into how many parts a table is dealt, so that one has about ``per_part`` rows and a task's memory doesn't grow with the table."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // per_part))


def config_kv(spark: SparkSession, folder: str) -> DataFrame:
    """An order is a configuration, a brand a key, and the least type of its parts the value.

    Parts grow with the lines, so they are never collected for a broadcast.
    """
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, folder, "part").select("p_partkey", "p_brand", "p_type")
    rows = lines.join(parts.hint("merge"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("l_orderkey").alias("config_id"), F.col("p_brand").alias("tag")).agg(F.min("p_type").alias("value"))


KV = """kv as (select l_orderkey config_id, p_brand tag, min(p_type) value
  from lineitem join part on l_partkey = p_partkey group by 1, 2)"""


def event_configs(spark: SparkSession, folder: str) -> DataFrame:
    """An event's properties with its type and user, as a variant."""
    e = table(spark, folder, "events")
    body = F.concat(F.regexp_replace("props", r"\}\s*$", ', "type": "'), "event_type", F.lit('", "user": '), F.col("user_id").cast("string"), F.lit("}"))
    return e.select("event_id", F.try_parse_json(body).alias("config"))


def order_configs(spark: SparkSession, folder: str) -> DataFrame:
    """An order as a configuration of real keys: map from key to JSON text."""
    o = table(spark, folder, "orders")
    key = F.col("o_orderkey")
    pick = lambda n, *options: F.element_at(F.array(*[F.lit(x) for x in options]), (F.floor(key / n) % len(options) + 1).cast("int"))
    entries = F.array(
        *[
            F.struct(F.lit(k).alias("key"), v.alias("value"))
            for k, v in {
                "GGA": pick(1, '"PE"', '"PS"', '"RP"', None),
                "IBRION": pick(3, "2", "6", "0", "-1", None),
                "ISIF": pick(5, "2", "3", None),
                "ISPIN": pick(2, "1", "2", None),
                "NUPDOWN": pick(7, None, "2", "0.5"),
                "LHFCALC": pick(4, "true", "false", None),
                "HFSCREEN": pick(11, "0.2", "0", None),
                "LSORBIT": pick(6, "true", None),
                "ISYM": pick(13, "0", "-1", "2", None),
                "ENCUT": pick(1, "520", "400"),
            }.items()
        ]
    )
    return o.select("o_orderkey", F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("config"))


def injected(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as pages whose content has the markup that cleaning must deal with."""
    d = table(spark, folder, "documents")
    n = F.col("doc_id").cast("string")
    kinds = F.array(*[F.lit(x) for x in ("Tutorial ", "How to ", "Best practices ", "FAQ ", "Pseudopotential ", "Category:", "Page_")])
    title = F.concat(F.element_at(kinds, (F.col("doc_id") % 7 + 1).cast("int")), n)
    content = F.concat(
        F.lit("  Intro\\n[math]x \\n y[/math]a \t  b\\n\\n\\n\\nWarning: "), F.coalesce("text", F.lit("")), F.lit("\\nENCUT = "), n, F.lit("\\nStep 1: end\\nRetrieved from \"x\"  ")
    )
    return d.select(F.col("doc_id").alias("page_idx"), title.alias("title"), F.concat(F.lit("http://h/"), n).alias("url"), content.alias("content"))


def key_content(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as pages that define keys; every fifth lacks the definition.

    A part is a few bytes, but its page takes long to parse, so parts are dealt to all cores: a file of them may be one task.
    """
    p = table(spark, folder, "part").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    n = F.col("p_partkey").cast("string")
    definition = F.when(F.col("p_partkey") % 5 == 4, "no definition").otherwise(F.concat(F.lit("= "), "p_type"))
    content = F.concat(
        F.lit("KEY"), n, F.lit("\\n"), definition, F.lit("\\nDefault:\\nKEY\\n"), F.when(F.col("p_partkey") % 5 == 4, "none").otherwise(F.concat(F.lit("= "), "p_size")), F.lit("\\nDescription: "), "p_name",
        F.lit(" of\\n"), "p_brand", F.lit("\\nRelated tags and articles\\nISMEAR\\nnot one\\nSIGMA\\nISMEAR\\nReferences\\nLATER"),
    )
    return p.select(F.col("p_partkey").alias("page_idx"), F.concat(F.lit("KEY"), n).alias("title"), F.concat(F.lit("u"), n).alias("url"), content.alias("content"))
