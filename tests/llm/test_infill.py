"""Fill-in-the-middle against plain Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from kvatlas.llm import fim

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def plain(doc, text):
    """n, form and output by the rules, unit by unit."""
    text, units = text or "", UNIT.findall(text or "")
    h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    if not text or any(m in text for m in fim.MARKS) or h3 % 100 >= 90:
        return n, "plain", text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    return (n, "spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", f"<P>{p}<S>{s}<M>{m}")


TEXTS = ["", None, " ", "a", "<", "P>", "a<P>b", "x<S", "<P<S<M", "$1 \\ {2}", "Zażółć gęślą", "😀😀 a😀b", "one\r\ntwo\n", " \x00\x85", "word, " * 4000, "a" * 50_000, "7" * 50_000]


def test_infill_equals_units(spark):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(60 * len(TEXTS))] + [(None, "no id at all"), (7, "same"), (7, "same"), (-5, "below zero")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, form string, n int").repartition(8)
    got = fim.infilled(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).withColumn("own", fim.pieces(F.col("output"), F.col("form")))
    got = got.collect()
    want = sorted(((i, *plain(i, t), t or "") for i, t in rows), key=repr)
    assert sorted(((r["doc_id"], r["n"], r["form"], r["output"], r["back"]) for r in got), key=repr) == want
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert all((r["own"] is None) == (r["form"] == "plain") for r in got)
    assert fim.infilled(docs.limit(0)).count() == 0


def test_infill_of_a_very_long_text(spark):
    docs = spark.createDataFrame([(i, "") for i in range(1, 9)], "doc_id long, text string").withColumn("text", F.expr("repeat('word 12, ', 500000)"))
    got = fim.infilled(docs).select("n", "form", F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("back")).collect()
    assert {r["back"] for r in got} == {hashlib.sha256(b"word 12, " * 500_000).hexdigest()}
    assert {r["n"] for r in got} == {6 * 500_000} and {r["form"] for r in got} > {"plain"}


def test_infill_shares_and_marks(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"))
    forms = {r["form"]: r["count"] for r in fim.infilled(docs, plain_share=50, spm_share=50, seed="s").groupBy("form").count().collect()}
    assert abs(forms["plain"] - 2000) < 200 and abs(forms["spm"] - 1000) < 150
    own = ("$1[", "\\", "{2}")
    rows = fim.infilled(docs, marks=own).select(F.col("form"), fim.restored(F.col("output"), F.col("form"), own).alias("back")).distinct().collect()
    assert {r["back"] for r in rows} == {"a b c"} and len(rows) == 3
    for marks in (("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("aa", "b", "c"), ("", "b", "c"), ("abc", "b", "x")):
        with pytest.raises(ValueError, match="overlap"):
            fim.infilled(docs, marks=marks)
