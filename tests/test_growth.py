"""Plans whose cost must not outgrow their input: what is computed once, and what is never joined or broadcast."""

import re

import numpy as np
from pyspark.sql import functions as F

from kvatlas.functions import text as T
from kvatlas.operators import configs as C
from kvatlas.operators import fulltext as X
from kvatlas.operators import lookup as L
from kvatlas.operators import pages as P
from kvatlas.operators import rag as G
from kvatlas.operators import search as S
from kvatlas.operators import segments as I
from kvatlas.operators import vectors as V


def plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_pages_are_split_once(spark):
    pages = spark.createDataFrame([(0, "KEY", "u", "Key\\n= 1\\nDefault:\\nx\\n= 2\\nDescription: d\\nRelated tags and articles\\nISMEAR\\nx\\nSIGMA")], "page_idx long, title string, url string, content string")
    edges = P.related_edges(P.key_pages(pages))
    assert [(r["related"], r["pos"]) for r in edges.orderBy("pos").collect()] == [("ISMEAR", 0), ("SIGMA", 1)]
    assert len(re.findall(r"\bsplit\(", plan(edges))) == 1


def test_reformatting_splits_once(spark):
    df = spark.createDataFrame([("a\nENCUT = 1\nb",), (None,), ("",), ("x\nALGO = 2",)], "raw string").select(T.reformat(F.col("raw")).alias("t"))
    assert [r["t"] for r in df.collect()] == ["a\n```\nENCUT = 1\n```\nb", None, "", "x\n```\nALGO = 2\n```"]
    assert len(re.findall(r"\bsplit\(", plan(df))) == 1


def test_pairs_of_tags_without_a_join(spark):
    kv = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (1, None), (2, "a"), (2, "c"), (2, "b"), (3, "a"), (None, "a"), (None, "b")], "config_id long, tag string")
    pairs = C.cooccurrence(kv)
    assert {(r["a"], r["b"]): r["n"] for r in pairs.collect()} == {(x, y): n for a, b, n in (("a", "b", 2), ("a", "c", 1), ("b", "c", 1)) for x, y in ((a, b), (b, a))}
    assert "Join" not in plan(pairs)


def test_index_without_a_shuffle(spark, tmp_path):
    texts = ["the cat the", "", None, "cat, The dog", "x" * 41]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = X.positions(docs)
    assert "Exchange" not in plan(own, "sparkPlan") and "Aggregate" not in plan(own)
    got = sorted((r["term"], r["doc_id"], r["dl"], r["tf"], r["places"]) for r in own.collect())
    assert got == [("cat", 0, 3, 1, [1]), ("cat", 3, 3, 1, [0]), ("dog", 3, 3, 1, [2]), ("the", 0, 3, 2, [0, 2]), ("the", 3, 3, 1, [1])]
    assert sorted((r["term"], r["doc_id"], r["dl"], r["tf"]) for r in X.counts(docs).collect()) == [x[:4] for x in got]
    rows = S.counted(docs.select("doc_id", S.tokens(F.coalesce("text", F.lit(""))).alias("t")), ["doc_id"], places=True, most=2)  # cut between documents
    assert sorted((r["term"], r["doc_id"], r["dl"], r["tf"], r["places"]) for r in rows.collect()) == got


def test_tasks_get_a_bounded_number_of_documents(spark):
    docs = spark.createDataFrame([(i, "the cat") for i in range(90)], "doc_id long, text string")
    own = X.counts(docs, per_task=10)
    assert own.rdd.getNumPartitions() == 9 and own.count() == 180
    asked = X.bag(spark.createDataFrame([(1, "the cat"), (2, "dog")], "query_id int, question string"))
    found = X.search(asked, own, X.sizes(docs))
    assert found.count() == 90 and "hashpartitioning(query_id" not in plan(found, "executedPlan")  # sums stay with their documents


def test_ranks_are_cut_before_they_are_shuffled(spark):
    rows = spark.createDataFrame([(1, i, float(i % 7)) for i in range(40)], "query_id int, doc_id long, score double")
    top = X.best(rows, 3)
    assert [(r["doc_id"], r["rank"]) for r in top.orderBy("rank").collect()] == [(6, 0), (13, 1), (20, 2)]
    assert "WindowGroupLimit" in plan(top)


def test_chunks_come_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(G, "MOST_CHARS", 50)
    docs = spark.createDataFrame([(i, "word " * 60) for i in range(5)] + [(9, None)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["chunk_idx"], r["start_index"], r["chunk"]) for r in G.chunks(docs, 100, 20).collect())
    assert [x[3] for x in got if x[0] == 3] == G.split_text("word " * 60, 100, 20) and len({x[0] for x in got}) == 5


def test_rows_become_lists_in_steps(spark, monkeypatch):
    monkeypatch.setattr(V, "MOST_LISTED", 6)
    df = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(11)], "vec_id long, embedding array<double>")
    sizes = V._listed(df.coalesce(1), np.array([[0.0, 0.0], [5.0, 0.0], [10.0, 0.0]]), 3, ["vec_id"])
    got = {(r["vec_id"], r["place"]): r["list"] for r in sizes.collect()}
    assert len(got) == 33 and [got[8, p] for p in range(3)] == [2, 1, 0] and [got[0, p] for p in range(3)] == [0, 1, 2]


def test_segments_without_later_tombstones_are_not_joined(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"w{i} the") for i in range(6)], "doc_id long, text string")
    I.append(docs.where("doc_id < 3"), str(tmp_path), "a")
    I.append(docs.where("doc_id >= 3"), str(tmp_path), "b")
    assert "Join" not in plan(I.live(spark, str(tmp_path))[0])
    I.append(docs.where("doc_id = 1").withColumn("text", F.lit("new")), str(tmp_path), "c")
    index, sizes = I.live(spark, str(tmp_path))
    assert sorted(r["term"] for r in index.where("doc_id = 1").collect()) == ["new"] and sizes.head()["n"] == 6


def test_names_meet_only_titles_that_contain_them(spark):
    titles = [f"KEY{i}" for i in range(300)] + ["x" * 20 + "LONG NAME OF A KEY" + str(i) for i in range(3)] + ["", None, "É" * 17]
    names = [f"EY{i}" for i in range(0, 400, 7)] + ["K", "0", "LONG NAME OF A KEY1", "x" * 17, "x" * 18 + "LONG", "É", "ÉÉ", "É" * 17, "É" * 18, "", None]
    own = spark.createDataFrame([(n, n) for n in names], "name string, up string")
    short = L.containing(own.where("length(up) <= 16"), spark.createDataFrame([(t,) for t in titles], "title string"))
    assert "contains(" not in plan(short).lower()  # equal runs, not candidates to be searched
    both = L.containing(own, spark.createDataFrame([(t,) for t in titles], "title string"))
    assert sorted((r["name"], r["title"]) for r in both.collect()) == sorted((n, t) for n in names if n for t in titles if t and n in t)
    assert L.containing(own.where("up = ''"), spark.createDataFrame([("a",)], "title string")).collect() == []


def test_pages_of_related_keys_are_parsed_once(spark):
    pages = spark.createDataFrame([(i, f"KEY{i}", "u", "Key\\n= 1\\nDescription: d\\nRelated tags and articles\\nISMEAR") for i in (1, 2, 12)], "page_idx long, title string, url string, content string")
    rows = L.related_of(spark.createDataFrame([("key1",), ("ey2",), ("EY1",), ("none",), (None,)], "name string"), P.key_pages(pages))
    got = {r["name"]: (r["outcome"], r["titles"], r["related"]) for r in rows.collect()}
    assert got == {"key1": ("entry", ["KEY1"], ["ISMEAR"]), "ey2": ("entry", ["KEY2"], ["ISMEAR"]), "EY1": ("several", ["KEY1", "KEY12"], None), "none": ("missing", [], None)}
    assert "split(" not in plan(rows)


def test_few_questions_are_searched_where_texts_are(spark, monkeypatch):
    questions = spark.createDataFrame([(1, "red cat"), (2, "CAT"), (3, "?!"), (4, "  "), (5, None), (6, "a.b c"), (7, "dog")], "query_id int, question string")
    tags = spark.createDataFrame([("RED CAT", "a cat"), ("CAT", "red"), ("X", None)], "title string, description string")
    texts = ["the red cat", "cat is red", "concatenate", "what?!", "", None, "a.b c", "a b c", "x" * 70 + "dog" + "y" * 70]
    pages = spark.createDataFrame([(f"Page {i}", "en", t, i == 0) for i, t in enumerate(texts)] + [("Category:cat", "en", "cat", False)], "title string, type string, summary string, is_file_page boolean")
    few = X.keyword_scores(questions, tags, pages)
    assert "SortMergeJoin" not in plan(few, "executedPlan") and "_key" not in plan(few)
    monkeypatch.setattr(X, "MOST_ASKED", 0)
    many = X.keyword_scores(questions, tags, pages)
    got = sorted(map(tuple, few.collect()))
    assert got == sorted(map(tuple, many.collect())) and (7, "Page 8", "en", 25) in got and {x[0] for x in got} == {1, 2, 3, 6, 7}
