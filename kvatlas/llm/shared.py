"""Helpers of the llm operators: reading inputs, and tables in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that every contract here means, as a Java/RE2 character class body.
BLANK = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's checkpoint folder. Only a local session gets one where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='kvatlas-')}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/kvatlas/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends here, and lost executors cost nothing before it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete a table that ``stored`` wrote and that nothing reads any more; other tables are left alone."""
    spark = df.sparkSession
    plain = lambda x: re.sub(r"^(\w+):/+", r"\1:/", x if re.match(r"\w+:/", x) else f"file:{x}")
    own = plain(f"{shared_dir(spark)}/kvatlas/")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if plain(folder).startswith(own):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def word_count(text: str | Column) -> Column:
    """Number of maximal runs of non-blanks; null counts as 0."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(F.coalesce(col, F.lit("")), F.lit(f"[^{BLANK}]+")).cast("long")
