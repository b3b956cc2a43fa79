"""Full-text search for tables of questions, against plain Python."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from kvatlas.operators import fulltext as X
from kvatlas.operators import search as S


@pytest.mark.parametrize(
    ("question", "want"),
    [
        ("a b", [(0, "optional", "text", "a"), (0, "optional", "text", "b")]),
        ('+"a b" -c', [(0, "required", "text", "a b"), (0, "forbidden", "text", "c")]),
        ("a AND b OR NOT c d", [(0, "required", "text", "a"), (0, "required", "text", "b"), (1, "forbidden", "text", "c"), (1, "optional", "text", "d")]),
        ('title:"x y" +title:z', [(0, "optional", "title", "x y"), (0, "required", "title", "z")]),
        ("dft+u 3-1", [(0, "optional", "text", "dft+u"), (0, "optional", "text", "3-1")]),
        ("a AND NOT b", [(0, "required", "text", "a"), (0, "forbidden", "text", "b")]),
        *[(q, None) for q in ("", "  ", '"open', 'a"b"', "+", "a -", "OR a", "a OR", "a AND", "AND a", "NOT", "a NOT", "a OR OR b", "where:a", "NOT -a", "a OR AND b", None)],
    ],
)
def test_query_language(question, want):
    got = X.clauses(question or "", ("text", "title"))
    assert (got and [(g, o, f, w) for g, _, o, f, w in got]) == want


def answers(question, docs, fields=("text", "title")):
    """Scores by the rules, document by document."""
    cut = lambda t: [w for w in re.findall(r"[^\W_]+", (t or "").lower()) if len(w) <= 40]
    tokens = {f: {d["doc_id"]: cut(d[f]) for d in docs} for f in fields}
    out = {}
    for alternative in {c[0] for c in X.clauses(question, fields) or []}:
        own = [(o, f, cut(w)) for g, _, o, f, w in X.clauses(question, fields) if g == alternative and cut(w)]
        for d in docs:
            parts = []
            for occurs, f, terms in own:
                t = tokens[f][d["doc_id"]]
                tf = sum(t[i : i + len(terms)] == terms for i in range(len(t)))
                idf = sum(math.log(1 + (len(docs) - n + 0.5) / (n + 0.5)) for w in terms for n in [sum(w in x for x in tokens[f].values())])
                mean = sum(map(len, tokens[f].values())) / len(docs)
                parts.append((occurs, tf, idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean)) if tf else 0))
            good = all(tf for o, tf, _ in parts if o == "required") and not any(tf for o, tf, _ in parts if o == "forbidden")
            if good and any(tf for o, tf, _ in parts if o != "forbidden"):
                out[d["doc_id"]] = out.get(d["doc_id"], 0) + sum(s for o, _, s in parts if o != "forbidden")
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    words = "the the of in a b cat dog İx dft u".split() + ["y" * 41]
    docs = [{"doc_id": i, "text": " ".join(rng.choices(words, k=rng.randint(0, 30))), "title": " ".join(rng.choices(words, k=3))} for i in range(80)]
    return [*docs, {"doc_id": 80, "text": None, "title": None}]


QUESTIONS = ['"the of"', '+"the the" -cat', "cat OR dog", "a AND b", "+a b", "-cat", "title:cat the", 'title:"the of" OR "of the" -in', "dft+u", "zebra +cat", '"the zebra"', "the the", "?!", "cat ?!", 'bad "', "İX"]


def test_search_equals_plain_matching(spark, texts, tmp_path):
    docs = spark.createDataFrame([(d["doc_id"], d["text"], d["title"], "x") for d in texts], "doc_id long, text string, title string, dl string")
    X.write_positions(docs, str(tmp_path / "index"), ("text", "title"))
    index, corpus = (X.opened(spark, str(tmp_path / "index" / p)) for p in ("positions", "sizes"))
    questions = spark.createDataFrame([*enumerate(QUESTIONS), (99, None)], "query_id int, question string")
    for per_part in (X.PER_PART, 7):
        got = X.search(X.parsed(questions, ("text", "title")), index, corpus, per_part).collect()
        own = {(r["query_id"], r["doc_id"]): r["score"] for r in got}
        want = {(q, d): s for q, text in enumerate(QUESTIONS) for d, s in answers(text, texts).items()}
        assert own.keys() == want.keys() and len(got) == len(own) and all(abs(own[k] - want[k]) < 2e-6 for k in want)
    assert X.search(X.parsed(questions.limit(0), ("text", "title")), index, corpus).count() == 0
    # a bag of words is what the search for one question gives
    one = {r["doc_id"]: r["score"] for r in S.bm25(docs, "the cat of").collect()}
    assert {r["doc_id"]: r["score"] for r in X.search(X.bag(spark.createDataFrame([(1, "The cat, of the")], "query_id int, question string")), index, corpus).collect()} == one


def test_absent_backends_are_skipped(spark, texts, tmp_path):
    docs = spark.createDataFrame([(d["doc_id"], d["text"]) for d in texts], "doc_id long, text string")
    rng = random.Random(5)
    vectors = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)], i % 3) for i in range(81)] + [(81, None, 0), (82, [1.0, None, 1.0, 1.0], 0), (83, [1.0], 0)], "doc_id long, embedding array<double>, kind int")
    questions = spark.createDataFrame([(1, "cat the"), (2, "dog"), (3, "nothing here")], "query_id long, question string")
    embedded = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.5]), (2, [0.0, -1.0, 0.0, 0.0])], "query_id long, embedding array<double>")
    asked, index, corpus, boosted = X.bag(questions), X.positions(docs), X.sizes(docs), F.col("kind") == 1
    rows = {r["doc_id"]: r for r in vectors.collect()}

    def ranks(query, with_words, with_vectors):
        signals = []
        if with_words:
            text = {1: "cat the", 2: "dog", 3: "nothing here"}[query]
            signals.append((sorted(((-round(s, 6), d) for d, s in answers(text, texts, ("text", "title")).items())), 1.0))
        if with_vectors and query < 3:
            v = {1: [1.0, 0.0, 0.0, 0.5], 2: [0.0, -1.0, 0.0, 0.0]}[query]
            dots = sorted((-round(sum(a * b for a, b in zip(v, rows[d]["embedding"], strict=True)), 6), d) for d in range(81))
            signals += [(dots, 1.0), ([x for x in dots if rows[x[1]]["kind"] == 1], 1.5)]
        score = {}
        for found, w in signals:
            for rank, (_, d) in enumerate(found[:5]):
                score[d] = score.get(d, 0) + w / (60 + rank)
        return [(d, round(s, 6)) for s, d in sorted((-round(s, 6), d) for d, s in score.items())[:10]]

    for words, dense in ((True, True), (True, False), (False, True)):
        found = X.hybrid(asked, index if words else None, corpus, embedded, vectors if dense else None, boosted)
        got = {}
        for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
            got.setdefault(r["query_id"], []).append((r["doc_id"], -r["score"]))
        want = {q: ranks(q, words, dense) for q in (1, 2, 3) if ranks(q, words, dense)}
        assert got == want
    assert X.hybrid(asked, None, None, None, None, None) is None and X.opened(spark, str(tmp_path / "no such index")) is None
    with pytest.raises(Exception, match=r"(?i)parquet"):
        (tmp_path / "bad.parquet").write_text("no parquet")
        X.opened(spark, str(tmp_path / "bad.parquet")).collect()


def test_tiers_of_many_questions(spark):
    tags = spark.createDataFrame([("ISMEAR", "how to smear a band"), ("SIGMA", "width of the smearing"), ("NSW", None)], "title string, description string")
    pages = spark.createDataFrame([("POSCAR", "file", "structure of cells", True), ("Category:Smearing", "c", "smearing", False), ("Smearing methods", "theory", "a smear of width x", False), ("Other", "theory", "x" * 300 + "smearing" + "y" * 300, False)],
                                  "title string, type string, summary string, is_file_page boolean")
    aliases = spark.createDataFrame([("steps", "NSW")], "alias string, target string")
    questions = ["ismear", " Steps ", "poscar", "smearing", "width smear", "of", "42", "", None, "nothing at all", "smear a", "s" * 100, "x" * 100]
    df = spark.createDataFrame(list(enumerate(questions)), "query_id int, question string")

    def single(q, hits, **more):
        rows = S.tiered(q, tags, pages, aliases, hits, **more).collect() if q and q.strip() else []
        return sorted((r["tier"], r["title"], r["type"], r["score"]) for r in rows)

    hits = spark.createDataFrame([(3, "Other", "theory", 0.5), (3, "SIGMA", "tag", 0.25), (0, "Other", "theory", 0.5)], "query_id int, title string, type string, score double")
    for found, type_ in ((None, None), (hits, "theory")):
        got = {}
        for r in X.tiered(df, tags, pages, aliases, found, type_).collect():
            got.setdefault(r["query_id"], []).append((r["tier"], r["title"], r["type"], r["score"]))
        for q, text in enumerate(questions):
            own = None if found is None else found.where(F.col("query_id") == q).drop("query_id")
            assert sorted(got.get(q, [])) == single(text, own, type_=type_), (text, type_)


def test_segments_answer_like_a_rebuilt_index(spark, texts, tmp_path):
    from kvatlas.operators import segments as G

    path = str(tmp_path / "segments")
    assert G.live(spark, path) == (None, None)
    schema = "doc_id long, text string, title string"
    df = lambda rows: spark.createDataFrame([(d["doc_id"], d["text"], d["title"]) for d in rows], schema)
    asked = X.parsed(spark.createDataFrame(list(enumerate(QUESTIONS)), "query_id int, question string"))

    def answers_of(index, corpus):
        return {(r["query_id"], r["doc_id"]): r["score"] for r in X.search(asked, index, corpus).collect()}

    moved = [{**d, "text": f"cat {d['text']} the of"} for d in texts[10:30]]
    now = {d["doc_id"]: d for d in texts[:40]}
    G.append(df(texts[:40]), path, "one")
    G.append(df(moved), path, "two", spark.createDataFrame([(0,), (999,)], "doc_id long"))
    G.append(df(moved), path, "two")  # again
    now |= {d["doc_id"]: d for d in moved}
    del now[0]
    G.append(df(texts[40:]), path, "three", spark.createDataFrame([(11,), (45,)], "doc_id long"))
    now |= {d["doc_id"]: d for d in texts[40:]}
    del now[11]
    want = answers_of(X.positions(df(now.values())), X.sizes(df(now.values())))
    index, corpus = G.live(spark, path)
    assert answers_of(index, corpus) == want and want and corpus.head()["n"] == len(now)
    G.merge(spark, path)
    assert answers_of(index, corpus) == want  # the version before
    assert answers_of(*G.live(spark, path)) == want
    G.append(df(texts[:1]), path, "three")  # a batch that the merged segment has
    G.append(df(texts[:1]), path, "four", spark.createDataFrame([(12,)], "doc_id long"))
    now[0] = texts[0]
    del now[12]
    assert answers_of(*G.live(spark, path)) == answers_of(X.positions(df(now.values())), X.sizes(df(now.values())))
