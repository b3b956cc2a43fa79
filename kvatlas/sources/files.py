"""Sources and sinks."""

from __future__ import annotations

import tempfile
import uuid
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kvatlas import model
from kvatlas.functions import values
from kvatlas.functions.text import html_text, html_title, links


def pages(spark: SparkSession, path: str) -> DataFrame:
    """PAGE from a JSON list (or lines) of title, url and content. ``page_idx`` keeps file order."""
    rows = spark.read.schema("title string, url string, content string").option("multiLine", True).json(path)
    return rows.select(F.monotonically_increasing_id().alias("page_idx"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "url", "content")])


def configs(spark: SparkSession, path: str, key: str = "config") -> DataFrame:
    """CONFIG from lines of JSON objects with ``directory`` and a map under ``key``; keys stay dynamic."""
    rows = spark.read.schema(f"directory string, `{key}` string").json(path)
    return rows.select(F.monotonically_increasing_id().alias("config_id"), "directory", F.parse_json(F.col(key)).alias("config"), F.col(key).alias("config_json"))


def config_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """path, config (key to JSON text) of all files called ``name`` (a glob) under ``root``; unreadable ones go."""
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(root, wholetext=True)
    rows = texts.select(F.col("_metadata.file_path").alias("path"), values.parse_config_text(F.col("value")).alias("config"))
    return rows.where("config is not null")


def config_keys(spark: SparkSession, root: str, name: str) -> DataFrame:
    """tag: all keys that any file has; an unreadable file has none."""
    return config_files(spark, root, name).select(F.explode(F.map_keys("config")).alias("tag")).distinct()


def structure_symbols(spark: SparkSession, path: str) -> DataFrame:
    """path, symbols: the element symbols on line six of structure files."""
    texts = spark.read.text(path, wholetext=True)
    line = F.trim(F.get(F.split("value", "\n"), F.lit(5)))
    return texts.select(F.col("_metadata.file_path").alias("path"), F.split(line, r"\s+").alias("symbols"))


def version_of(spark: SparkSession, path: str) -> str | None:
    """The version of a JSON file, or None for a bare list; another one than this engine's is warned of."""
    row = spark.read.schema("_version string").option("multiLine", True).json(path).where("_version is not null").select("_version").first()
    if row and row[0] != model.FORMAT_VERSION:
        warnings.warn(f"{path} has format {row[0]}, not {model.FORMAT_VERSION}", stacklevel=2)
    return row[0] if row else None


def envelope(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows under ``data`` of a versioned JSON file, or of a bare list; another version than this engine's is warned of."""
    version_of(spark, path)
    wrapped = spark.read.schema(f"_version string, data array<struct<{_fields(schema)}>>").option("multiLine", True).json(path)
    if wrapped.where("data is not null").isEmpty():
        return spark.read.schema(schema).option("multiLine", True).json(path)
    return wrapped.select(F.explode("data").alias("d")).select("d.*")


def checked(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rows`` with ``errors``: the names of the rules that don't hold (a rule that is null doesn't), in order."""
    failed = [F.when(F.coalesce(rule, F.lit(False)), None).otherwise(F.lit(name)) for name, rule in rules.items()]
    return rows.withColumn("errors", F.array_compact(F.array(*failed)))


def validated(spark: SparkSession, path: str, schema: str, rules: dict[str, Column], mode: str = "quarantine", lines: bool = True) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Rows of JSON (lines, or whole files) against a schema and rules for its fields, in one pass over the input.

    ``quarantine``: two tables of one written one, the good rows, and the bad ones with ``errors`` and, where the text
    isn't of the schema (error ``schema``), ``record``, the text. ``fail``: the good rows; the first bad one stops the job that reads them.
    """
    names = StructType.fromDDL(schema).fieldNames()
    reader = spark.read.schema(f"{schema}, record string").option("columnNameOfCorruptRecord", "record").option("multiLine", not lines)
    rows = checked(reader.json(path), {"schema": F.col("record").isNull(), **rules})
    # what isn't of the schema isn't judged by rules
    rows = rows.withColumn("errors", F.when(F.col("record").isNotNull(), F.array(F.lit("schema"))).otherwise(F.col("errors")))
    if mode == "fail":
        text = F.concat(F.lit("bad row: "), F.array_join("errors", ", "), F.lit(": "), F.coalesce("record", F.to_json(F.struct(*names))))
        good = F.when(F.size("errors") == 0, F.lit(True)).otherwise(F.raise_error(text).cast("boolean"))
        return rows.where(good).select(*names)
    if mode != "quarantine":
        raise ValueError(f"mode {mode!r} is neither quarantine nor fail")
    rows = kept(rows, "validated")
    return rows.where(F.size("errors") == 0).select(*names), rows.where(F.size("errors") > 0).select(*names, "errors", "record")


def _fields(ddl: str) -> str:
    return ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in StructType.fromDDL(ddl).fields)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir); without it, local sessions only get one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='kvatlas-')}"
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/kvatlas/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """The table, written to the shared folder once and read from there: for what several parts of a plan use."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write(df: DataFrame, path: str) -> None:
    """A table in a folder; the version of its format is a column of its own small table beside it."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    df.sparkSession.createDataFrame([(model.FORMAT_VERSION,)], "version string").write.mode("overwrite").json(f"{path}/version")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/data")


def write_config_texts(df: DataFrame, path: str, config: str = "config") -> None:
    df.select(values.config_text(F.col(config)).alias("value")).write.mode("overwrite").text(path)


def sample_rows(df: DataFrame, share: float, most: int, seed: int = 17) -> DataFrame:
    """A Bernoulli sample, cut at ``most`` rows (the feature of this operator), numbered from 1."""
    from pyspark.sql import Window

    rows = df.sample(share, seed).limit(most)
    return rows.withColumn("number", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())))


def from_html(raw: DataFrame) -> DataFrame:
    """PAGE from page_id, url, html: heading, text with literal line breaks, file order from the id."""
    return raw.select(F.col("page_id").alias("page_idx"), html_title(F.col("html")).alias("title"), "url", html_text(F.col("html")).alias("content"))


def page_links(raw: DataFrame) -> DataFrame:
    """page_id, pos, href of every link; a crawl follows those without ``Special:``, ``#`` and ``?``."""
    rows = raw.select("page_id", F.posexplode(links(F.col("html"))).alias("pos", "href"))
    followed = ~F.contains("href", F.lit("Special:")) & ~F.contains("href", F.lit("#")) & ~F.contains("href", F.lit("?"))
    return rows.withColumn("followed", followed)


def fetch_meta(pages_: DataFrame, last_modified: str) -> DataFrame:
    """FETCH_META of a crawl: its titles in order, and their digest."""
    titles = F.transform(F.sort_array(F.collect_list(F.struct("page_idx", "title"))), lambda x: x["title"])
    row = pages_.agg(titles.alias("page_titles"), F.count(F.lit(1)).alias("page_count"))
    return row.select(
        F.current_timestamp().alias("last_fetch"),
        F.lit(last_modified).alias("last_modified"),
        "page_count",
        F.md5(F.array_join("page_titles", "")).alias("page_titles_md5"),
        "page_titles",
    )
