"""A corpus from ``documents`` to packed sequences; each stage works on all that the one before it kept.

1. language ID: documents without letters go, and those that no language claims (fewer known grams than langid.LEAST_KNOWN);
2. exact dedup: one document of each group of equal texts stays;
3. n-gram Jaccard join: one document of each group linked at 0.8 over five-word shingles stays;
4. mixing: each document stays as often as its source's target asks for;
5. best-fit packing: one row for each piece, with its bin.

All stages but the last return the columns that they get. ``run`` deletes each stage's table once the next one stands.

Results for odd input: documents with null or blank text have no letters and go in the first stage, so all others have
words; without a row with text and language nothing can be learned and every document goes; rows without id pass
the first four stages like others (in the third each of them is a document of its own) and are packed; repeated rows
are one from the second stage on, and the fourth may repeat them; very long texts are read whole in each stage, and the
last cuts them into pieces; an empty table gives an empty result; extra columns pass through all stages but the last, and
their names may be those that an operator uses itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kvatlas.llm import exact_dedup, langid, mixing, ngram_jaccard, packing
from kvatlas.llm.shared import dropped, stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs, langid.train(docs, ~langid.fold("doc_id", 4, 2)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_jaccard.near_dedup(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("exact", exact),
    ("near", near),
    ("mix", mixed),
    ("pack", packed),
]
#: The language stage is a fitted model, which SQL can't express; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
