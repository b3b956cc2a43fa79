"""Search: BM25, dense vectors, reciprocal-rank fusion, keyword scores, and the tiers that use them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvatlas.functions import text as T

K1, B, RRF, PER_SIGNAL, BOOST, LONGEST_TOKEN = 1.2, 0.75, 60, 5, 1.5, 40


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; very long ones are dropped."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda t: F.length(t) <= LONGEST_TOKEN)


def postings(docs: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """term, doc_id, tf, dl: the inverted index; with ``terms``, only their part of it."""
    own = docs.select("doc_id", tokens(F.coalesce("text", F.lit(""))).alias("t")).withColumn("dl", F.size("t"))
    if terms is not None:  # other tokens aren't exploded
        own = own.withColumn("t", F.filter("t", lambda x: x.isin(*terms)))
    return own.select(F.explode("t").alias("term"), "doc_id", "dl").groupBy("term", "doc_id", "dl").agg(F.count(F.lit(1)).alias("tf"))


def counted(rows: DataFrame, names: list[str], places: bool = False, most: int = 1 << 20) -> DataFrame:
    """``names``, dl, term, tf (and places, ascending) from ``names`` and ``t``, the tokens of a whole text: a row a term.

    A text's tokens are in one row, so they are counted where they are and nothing is shuffled; ``most`` tokens at a time.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            ends = np.cumsum(whole.column("t").value_lengths().to_numpy(zero_copy_only=False)) if len(whole) else np.empty(0, int)
            at = 0
            while at < len(whole):
                until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
                batch, at = whole.slice(at, until - at), until
                size = batch.column("t").value_lengths().to_numpy(zero_copy_only=False)
                flat = batch.column("t").flatten().dictionary_encode()
                if not len(flat):
                    continue
                row = np.repeat(np.arange(len(batch)), size)
                key = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(batch) + row  # like terms side by side
                order = np.argsort(key, kind="stable")
                first = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) > 0)))
                tf, own = np.diff(np.append(first, len(key))), pa.array(row[order[first]])
                columns = [*[batch.column(c).take(own) for c in names], pa.array(size[row[order[first]]], pa.int32()), flat.dictionary.take(flat.indices.take(pa.array(order[first]))), pa.array(tf, pa.int64())]
                if places:
                    place = (np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size))[order].astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), pa.array(place)))
                yield pa.RecordBatch.from_arrays(columns, [*names, "dl", "term", "tf", *["places"] * places])

    kinds = dict(rows.dtypes)
    fields = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "dl int, term string, tf long", *["places array<int>"] * places])
    return rows.select(*names, "t").mapInArrow(count, fields)


def lengths(docs: DataFrame) -> DataFrame:
    """One row: n documents, and their mean length."""
    return docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(tokens(F.coalesce("text", F.lit(""))))).alias("avgdl"))


def bm25(docs: DataFrame | None, query: str, index: DataFrame | None = None, corpus: DataFrame | None = None) -> DataFrame:
    """doc_id, score of the documents with a term of the query (a bag of words)."""
    terms = sorted(set(re.findall(r"[^\W_]+", query.lower())))
    own = (index if index is not None else postings(docs, terms)).where(F.col("term").isin(*terms))
    df = own.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = own.join(F.broadcast(df), "term").crossJoin(F.broadcast(corpus if corpus is not None else lengths(docs)))  # a row a term; one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return rows.groupBy("doc_id").agg(F.round(F.sum(part), 6).alias("score"))


def write_index(docs: DataFrame, path: str) -> None:
    """An inverted index: postings ordered by term, so a query's row groups are few, and the corpus's sizes. An id is one document."""
    own = counted(docs.select("doc_id", tokens(F.coalesce("text", F.lit(""))).alias("t")), ["doc_id"]).select("term", "doc_id", "dl", "tf")
    own.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    lengths(docs).write.mode("overwrite").parquet(f"{path}/corpus")


def bm25_indexed(spark: SparkSession, path: str, query: str) -> DataFrame:
    """Like ``bm25``, from a written index; the terms are pushed down to its files."""
    return bm25(None, query, spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/corpus"))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def dense(vectors: DataFrame, query: list[float]) -> DataFrame:
    """doc_id, score: dot products with one vector."""
    literal = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select("doc_id", F.round(dot(F.col("embedding"), literal), 6).alias("score"))


def ranked(scores: DataFrame, k: int = PER_SIGNAL) -> DataFrame:
    """The k best, with ``rank`` from 0; ties go to the smaller id. Ranks are taken over k rows."""
    best = scores.orderBy(F.desc("score"), "doc_id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")) - 1)


def fused(signals: list[tuple[DataFrame, float]], k: int = 10, constant: int = RRF) -> DataFrame:
    """doc_id, score: reciprocal-rank fusion of ranked signals with weights."""
    parts = [s.select("doc_id", (F.lit(w) / (constant + F.col("rank"))).alias("part")) for s, w in signals]
    both = parts[0]
    for p in parts[1:]:
        both = both.union(p)
    return both.groupBy("doc_id").agg(F.round(F.sum("part"), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


def hybrid(docs: DataFrame, vectors: DataFrame, boosted: Column, query: str, vector: list[float], k: int = 10, per_signal: int = PER_SIGNAL) -> DataFrame:
    """BM25, all vectors, and once more the vectors where ``boosted`` holds; each signal gives ``per_signal`` documents."""
    signals = [
        (ranked(bm25(docs, query), per_signal), 1.0),
        (ranked(dense(vectors, vector), per_signal), 1.0),
        (ranked(dense(vectors.where(boosted), vector), per_signal), BOOST),
    ]
    return fused(signals, k)


def with_entries(hits: DataFrame, entries: DataFrame) -> DataFrame:
    """Hits with what is known of them; a hit without an entry goes, after the limit."""
    return hits.join(entries, "doc_id")


def search_docs(tags: DataFrame, pages: DataFrame, partners: DataFrame) -> DataFrame:
    """SEARCH_DOC rows of key entries (with their commonest partners) and of other pages."""
    near = partners.groupBy(F.col("a").alias("title")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "b"))), lambda x: x["b"]), " ").alias("near"))
    of_tags = tags.join(near, "title", "left").select(
        F.concat(F.lit("tag:"), "title").alias("doc_id"),
        "title",
        F.concat_ws(" ", "title", "description", "default", "value", "near").alias("text"),
        F.lit("tag").alias("type"),
    )
    of_pages = pages.select(F.concat(F.lit("page:"), "title").alias("doc_id"), "title", F.concat_ws(" ", "title", "summary").alias("text"), F.col("type"))
    return of_tags.unionByName(of_pages)


def keyword_scores(keyword: str, tags: DataFrame, pages: DataFrame) -> DataFrame:
    """title, type, score of the last tier: scored by keyword in titles, descriptions and summaries; above 0 only."""
    kw = keyword.lower().strip()
    title, description = F.lower("title"), F.lower(F.coalesce("description", F.lit("")))
    base = F.when(title == kw, 100).when(F.contains(title, F.lit(kw)), 50).otherwise(0)
    by_text = F.when(T.keyword_matches(kw, description), T.keyword_score(kw, description)).otherwise(0)
    of_tags = tags.select("title", F.lit("tag").alias("type"), F.greatest(base, by_text).alias("score"))
    summary = F.lower(F.coalesce("summary", F.lit("")))
    by_title = F.when(T.keyword_matches(kw, title), F.when(F.col("is_file_page"), 80).otherwise(40)).otherwise(0)
    of_pages = pages.where(~F.startswith("title", F.lit("Category:"))).select(
        "title", "type", F.greatest(by_title, F.when(T.keyword_matches(kw, summary), 25).otherwise(0)).alias("score")
    )
    return of_tags.union(of_pages).where("score > 0").withColumn("score", F.col("score").cast("int"))


def tiered(keyword: str, tags: DataFrame, pages: DataFrame, aliases: DataFrame, hits: DataFrame | None = None, type_: str | None = None, limit: int = 20) -> DataFrame:
    """tier, title, type, score: the first tier that finds anything. ``hits`` (title, type, score) is the hybrid tier.

    The type filter comes after the hybrid tier's limit; in the keyword tier it comes before.
    """
    from kvatlas.operators.lookup import ALIAS, EXACT, FILE, resolve

    name = tags.sparkSession.createDataFrame([(keyword,)], "name string")
    direct = resolve(name, tags, aliases, pages.where("is_file_page")).where(F.col("stage").isin(EXACT, ALIAS, FILE))
    found = direct.select(F.col("stage").alias("tier"), "title", F.when(F.col("stage") == FILE, "file").otherwise("tag").alias("type"), F.lit(100.0).alias("score"))
    if not found.isEmpty():
        return found
    if hits is not None:
        own = hits if type_ is None else hits.where(F.col("type") == type_)
        if not own.isEmpty():
            return own.select(F.lit("hybrid").alias("tier"), "title", "type", F.col("score").cast("double")).limit(limit)
    scored = keyword_scores(keyword, tags, pages).select(F.lit("keyword").alias("tier"), "title", "type", F.col("score").cast("double"))
    scored = scored if type_ is None else scored.where(F.col("type") == type_)
    return scored.orderBy(F.desc("score"), "title").limit(limit)
