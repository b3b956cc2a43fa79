"""A positional index that grows: segments of postings, deletes by tombstones, merging, snapshots.

A segment has the postings and lengths of one batch of documents. A document that comes again, or is deleted, leaves a
tombstone in the newer segment, which kills its copies in older ones; searches and statistics see live copies only, so
scores are those of an index built anew. The manifest names the segments in order; each change writes a new version
of it, last of all, so a reader sees a whole state and a repeated append (by its batch id) changes nothing.
Merging rewrites the live rows of all segments into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvatlas.operators import fulltext as X
from kvatlas.operators.search import tokens
from kvatlas.sources.files import kept

_ENTRY = "place long, folder string, batch string, fields array<string>"


def _manifest(spark: SparkSession, path: str) -> tuple[int, list]:
    """The last version, and its segments in order (a row a segment)."""
    found = X.opened(spark, f"{path}/manifest")
    if found is None:
        return 0, []
    version = found.agg(F.max("version")).head()[0] or 0
    return version, found.where(F.col("version") == version).orderBy("place").collect()


def _publish(spark: SparkSession, path: str, version: int, entries: list[tuple]) -> None:
    spark.createDataFrame(entries, _ENTRY).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={version}")


def _read(spark: SparkSession, path: str, entries: list, part: str) -> DataFrame | None:
    out = None
    for e in entries:
        rows = spark.read.parquet(f"{path}/{e['folder']}/{part}").withColumn("place", F.lit(e["place"]).cast("long"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _write(folder: str, postings: DataFrame, lengths: DataFrame, dead: DataFrame) -> None:
    order = ["field", "term", "doc_id"]
    postings.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{folder}/postings")
    lengths.write.mode("overwrite").parquet(f"{folder}/lengths")
    dead.write.mode("overwrite").parquet(f"{folder}/dead")


def append(docs: DataFrame, path: str, batch: str, deleted: DataFrame | None = None, fields: tuple[str, ...] = ("text",)) -> None:
    """A new segment of ``docs`` (doc_id, ``fields``), which replace documents of their ids; those of ``deleted`` (doc_id) go.

    Nothing happens if a segment of this ``batch`` is there. Of rows with one id in a batch, the index has all.
    """
    spark = docs.sparkSession
    version, entries = _manifest(spark, path)
    if any(batch in e["batch"].split("\n") for e in entries):
        return
    docs = kept(docs.select("doc_id", *fields), "batch")
    names = F.array(*[F.struct(F.lit(f).alias("field"), F.size(tokens(F.coalesce(F.col(f), F.lit("")))).alias("dl")) for f in fields])
    gone = docs.select("doc_id") if deleted is None else docs.select("doc_id").union(deleted.select("doc_id"))
    before = _read(spark, path, entries, "lengths")
    dead = gone.distinct().limit(0) if before is None else gone.distinct().join(before.select("doc_id"), "doc_id", "left_semi")
    folder = f"segment-{version + 1}"
    _write(f"{path}/{folder}", X.positions(docs, fields), docs.select("doc_id", F.inline(names)), dead)
    place = entries[-1]["place"] + 1 if entries else 1
    old = [(e["place"], e["folder"], e["batch"], e["fields"]) for e in entries]
    _publish(spark, path, version + 1, [*old, (place, folder, batch, list(fields))])


def _alive(spark: SparkSession, path: str, entries: list, part: str) -> DataFrame:
    """Live rows of all segments. Only segments with tombstones after them are compared with these, so the others' rows stay where they are."""
    out, dead = None, None
    for e in reversed(entries):
        rows = spark.read.parquet(f"{path}/{e['folder']}/{part}")
        if dead is not None:
            rows = rows.join(dead.distinct().withColumn("killed", F.lit(True)), "doc_id", "left").where("killed is null").drop("killed")
        out = rows if out is None else rows.unionByName(out)
        own = spark.read.parquet(f"{path}/{e['folder']}/dead").select("doc_id")
        if not own.isEmpty():
            dead = own if dead is None else dead.union(own)
    return out


def live(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | tuple[None, None]:
    """Postings and sizes (as ``fulltext.search`` takes them) of the documents that are there now; None without an index."""
    _, entries = _manifest(spark, path)
    if not entries:
        return None, None
    sizes = _alive(spark, path, entries, "lengths").groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    return _alive(spark, path, entries, "postings"), sizes


def merge(spark: SparkSession, path: str) -> None:
    """One segment in place of all: live rows only, and no tombstones. Readers of the version before aren't disturbed."""
    version, entries = _manifest(spark, path)
    if len(entries) < 2:
        return
    folder = f"segment-{version + 1}"
    none = _read(spark, path, entries[:1], "dead").select("doc_id").limit(0)
    _write(f"{path}/{folder}", _alive(spark, path, entries, "postings"), _alive(spark, path, entries, "lengths"), none)
    _publish(spark, path, version + 1, [(entries[-1]["place"], folder, "\n".join(e["batch"] for e in entries), entries[-1]["fields"])])
