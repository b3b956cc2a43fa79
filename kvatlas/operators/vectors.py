"""A vector index: coarse centroids, inverted lists, probing, and exact distances within the lists.

Centroids are fitted by k-means on a bounded sample, the first ``MOST_SAMPLE`` vectors by a hash of their key; every
vector is assigned to its nearest centroid and written in its list. A query looks at the ``probes`` lists whose centroids are nearest, where
distances are exact, so the only loss is a neighbour in a list that isn't looked at; with all lists probed the answer is that of
``rag.nearest``, which stays the exact way. Long lists are read in parts of ``PART`` vectors. How many lists to look at is measured when
the index is written: for a sample of ``MOST_TRIED`` vectors, the exact neighbours' lists show which number finds ``LEAST_RECALL`` of them.

Vectors that are null, have nulls or another length than the first of the sample are in no list and near to nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_SAMPLE, MOST_LISTS, PART, STEPS = 20_000, 2_000, 16_384, 12
MOST_LISTED = 16_384
MOST_TRIED, LEAST_RECALL, TRIED_K = 200, 0.95, 10


def _whole(df: DataFrame, dim: int | None = None) -> DataFrame:
    df = df.where(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull()))
    return df if dim is None else df.where(F.size("embedding") == dim)


def _squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] + (centroids * centroids).sum(1)[None, :] - 2 * x @ centroids.T


def fit(vectors: DataFrame, lists: int, key: str = "vec_id", most_sample: int = MOST_SAMPLE, seed: int = 3) -> np.ndarray:
    """``lists`` centroids at most, from a bounded sample: k-means++ and Lloyd's steps, the same for each run."""
    rows = _whole(vectors).select(F.xxhash64(key, F.lit(seed)).alias("spot"), key, F.col("embedding").cast("array<double>").alias("embedding"))
    sample = rows.orderBy("spot", key).limit(most_sample).toArrow().column("embedding").combine_chunks()
    size = len(sample[0]) if len(sample) else 0
    if not size:
        return np.zeros((0, 0))
    x = np.array([v for v in sample.to_pylist() if len(v) == size], np.float64)
    rng, chosen = np.random.default_rng(seed), x[:1]
    while len(chosen) < min(lists, MOST_LISTS, len(x)):
        far = np.maximum(_squared(x, chosen[-1:])[:, 0], 0) if len(chosen) == 1 else np.minimum(far, np.maximum(_squared(x, chosen[-1:])[:, 0], 0))  # noqa: F821
        if not far.sum():
            break  # no more different vectors
        chosen = np.concatenate((chosen, x[[rng.choice(len(x), p=far / far.sum())]]))
    for _ in range(STEPS):
        nearest = _squared(x, chosen).argmin(1) if len(x) else np.empty(0, int)
        count = np.bincount(nearest, minlength=len(chosen))
        sums = np.zeros_like(chosen)
        np.add.at(sums, nearest, x)
        chosen = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], chosen)
    return chosen


def _listed(df: DataFrame, centroids: np.ndarray, n: int, names: list[str]) -> DataFrame:
    """``names``, embedding, ``list`` and ``place`` (from 0): the n nearest centroids of each row, a row each."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, MOST_LISTED // max(1, min(n, len(centroids))))  # rows at a time: each becomes n of them
        for whole in batches:
            for at in range(0, len(whole), step):
                batch = whole.slice(at, step)
                x = batch.column("embedding").flatten().to_numpy().reshape(len(batch), -1)
                near = np.argsort(_squared(x, centroids), axis=1, kind="stable")[:, :n]
                row = pa.array(np.repeat(np.arange(len(batch)), near.shape[1]))
                place = np.tile(np.arange(near.shape[1], dtype=np.int32), len(batch))
                yield pa.RecordBatch.from_arrays([*[c.take(row) for c in batch.columns], pa.array(near.ravel().astype(np.int32)), pa.array(place)], [*batch.schema.names, "list", "place"])

    rows = _whole(df, centroids.shape[1]).select(*names, F.col("embedding").cast("array<double>").alias("embedding"))
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(assign, f"{types}, list int, place int")


def write_index(vectors: DataFrame, path: str, lists: int | None = None, key: str = "vec_id", most_sample: int = MOST_SAMPLE, least_recall: float = LEAST_RECALL) -> None:
    """Lists in files ordered by list and key, their sizes, the centroids, and the probes for ``least_recall``.

    ``lists``: the root of the number of vectors, unless given.
    """
    spark = vectors.sparkSession
    lists = lists or max(1, round(_whole(vectors).count() ** 0.5))
    centroids = fit(vectors, lists, key, most_sample)
    empty = _whole(vectors).limit(0).select(key, F.col("embedding").cast("array<double>").alias("embedding"), F.lit(0).alias("list"))
    rows = _listed(vectors, centroids, 1, [key]).drop("place") if len(centroids) else empty
    rows.repartitionByRange("list", key).sortWithinPartitions("list", key).write.mode("overwrite").parquet(f"{path}/lists")
    listed = spark.read.parquet(f"{path}/lists")
    listed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/sizes")
    rows = [(i, c.tolist()) for i, c in enumerate(centroids)]
    spark.createDataFrame(rows, "list int, centroid array<double>").write.mode("overwrite").parquet(f"{path}/centroids")
    probes = _probes_for(listed, centroids, key, least_recall) if len(centroids) else 1
    spark.createDataFrame([(probes, least_recall)], "probes int, least_recall double").write.mode("overwrite").parquet(f"{path}/probes")


def _probes_for(listed: DataFrame, centroids: np.ndarray, key: str, least_recall: float) -> int:
    """How many nearest lists hold ``least_recall`` of the exact neighbours of a sample of vectors (apart from themselves)."""
    from kvatlas.operators.rag import nearest

    tried = listed.orderBy(F.xxhash64(key, F.lit(9)), key).limit(MOST_TRIED).select(F.col(key).cast("long").alias("query_id"), "embedding")
    found = nearest(tried, listed, TRIED_K + 1, keys=(key,), carried=("list",)).where(F.col("query_id") != F.col(key)).select("query_id", "list")
    places = _listed(tried, centroids, len(centroids), ["query_id"]).select("query_id", "list", "place")
    rows = found.join(places, ["query_id", "list"]).groupBy("place").agg(F.count(F.lit(1)).alias("n")).orderBy("place").collect()  # a row a list
    total, so_far = sum(r["n"] for r in rows), 0
    for r in rows:
        so_far += r["n"]
        if so_far >= least_recall * total:
            return r["place"] + 1
    return 1


def probed(queries: DataFrame, path: str, k: int = 10, probes: int | None = None, key: str = "vec_id", block: int = 4096) -> DataFrame:
    """query_id, ``key``, distance, rn: the k nearest vectors of each query in its ``probes`` nearest lists (as measured, unless given), ties to the smaller key."""
    from kvatlas.operators.rag import nearest_in_blocks

    spark: SparkSession = queries.sparkSession
    # one row a list: MOST_LISTS at most
    centroids = np.array([r["centroid"] for r in spark.read.parquet(f"{path}/centroids").orderBy("list").collect()])
    sizes = spark.read.parquet(f"{path}/sizes").select("list", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    if not len(centroids):
        return spark.createDataFrame([], f"query_id long, {key} long, distance double, rn int")
    probes = probes or spark.read.parquet(f"{path}/probes").head()["probes"]
    n = max(1, -(-queries.count() // block))
    left = _listed(queries, centroids, probes, ["query_id"]).drop("place").join(F.broadcast(sizes), "list")
    left = left.select("query_id", "embedding", F.pmod(F.xxhash64("query_id"), F.lit(n)).alias("_i"), "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("_j"))
    right = spark.read.parquet(f"{path}/lists").join(F.broadcast(sizes), "list")
    right = right.select(key, "embedding", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("_i"), "list", F.pmod(F.xxhash64(key), F.col("parts")).cast("int").alias("_j"))
    return nearest_in_blocks(left, right, ["list", "_i", "_j"], k, (key,))
