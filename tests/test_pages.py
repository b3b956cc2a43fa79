"""Pages, names, search and retrieval on small fixtures."""

import pytest
from pyspark.sql import functions as F

from kvatlas.functions import text as T
from kvatlas.operators import lookup as L
from kvatlas.operators import pages as P
from kvatlas.operators import rag as G
from kvatlas.operators import search as S
from kvatlas.sources import files
from kvatlas.streaming.counts import windowed

GOOD = r"ENCUT\n= [real]\nDefault:\nENCUT\n= 1\nDefault:\nENCUT\n= largest\nDescription: cutoff\nenergy\nRelated tags and articles\nPREC\nnot a key\nENAUG\nPREC\nReferences\nLATER"
PAGES = [
    ("ENCUT", GOOD),
    ("NOMARK", r"NOMARK\n= x\nnothing here"),
    ("LATEDEF", "LATEDEF" + r"\nline" * 12 + r"\n= x\nDescription: y"),
    ("POSCAR", "A file page. " * 9),
    ("Tutorial one", "Learn [math]x\\ny[/math] it. " * 5),
    ("Short", "tiny"),
    ("Category:All", "All of it. " * 9),
    ("Tutorial one", "Second text of the same title. " * 4),
    ("Old name", "Redirect to: ENCUT"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, t, f"u{i}", c) for i, (t, c) in enumerate(PAGES)], "page_idx long, title string, url string, content string")


def test_key_pages(pages):
    (r,) = P.key_pages(pages).collect()
    assert (r["title"], r["value"], r["default"], r["description"]) == ("ENCUT", "[real]", "largest", "cutoff energy")
    assert r["related"] == ["PREC", "ENAUG"]


def test_other_pages(pages):
    rows = {(r["title"], r["page_idx"]): r for r in P.other_pages(pages).collect()}
    assert set(rows) == {("POSCAR", 3), ("Tutorial one", 4), ("Category:All", 6), ("Tutorial one", 7)}
    assert rows["POSCAR", 3]["is_file_page"] and rows["Tutorial one", 4]["type"] == "tutorial" and "[math]" not in rows["Tutorial one", 4]["summary"]


def test_first_and_last_of_a_title(pages):
    of = lambda df: {r["title"]: r["page_idx"] for r in df.collect()}["Tutorial one"]
    assert of(P.first_by_title(pages)) == 4 and of(P.last_by_title(pages)) == 7


def test_redirects_go(pages):
    assert G.usable(pages).count() == len(PAGES) - 1


@pytest.mark.parametrize(
    "raw, want",
    [(r"a\n\n\n\nb", "a\n\nb"), ("a \t b", "a b"), ("x[math]1\n2[/math]y", "xy"), (" \n z \n", "z"), ("[math]a[/math]b[math]c[/math]", "b"), ("", "")],
)
def test_clean(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "t string").select(T.clean(F.col("t"))).first()[0] == want


def test_reformat(spark):
    raw = r"Intro\nTip: go\nENCUT = 3\nALGO\ntext [math]x[/math]\n\n\n\nStep 2: do\nRetrieved from " + '"a\nb"'
    got = spark.createDataFrame([(raw,)], "t string").select(T.reformat(F.col("t"))).first()[0]
    assert got == "Intro\n💡 **Tip:** go\n```\nENCUT = 3\nALGO\n```\ntext $$x$$\n\n**Step 2:** do"


def test_title_key(spark):
    got = spark.createDataFrame([("A_b%20C+d ",)], "t string").select(T.title_key(F.col("t"))).first()[0]
    assert got == "a b c+d"


def resolve(spark, name, **more):
    index = spark.createDataFrame([("LSORBIT",), ("ENCUT",), ("ENAUG",), ("ISMEAR",)], "title string")
    aliases = spark.createDataFrame([("soc", "LSORBIT"), ("gw", "ALGO")], "alias string, target string")
    names = spark.createDataFrame([(name,)], "name string")
    return sorted((r["stage"], r["title"]) for r in L.resolve(names, index, aliases, spark.createDataFrame([("POSCAR",)], "title string"), **more).collect())


def test_resolution_stages(spark):
    assert resolve(spark, " encut ") == [("exact", "ENCUT")]
    assert resolve(spark, "SOC") == [("term_map", "LSORBIT")]
    assert resolve(spark, "gw") == []  # the alias's target isn't indexed
    assert resolve(spark, "poscar") == [("file_page", "POSCAR")]
    assert resolve(spark, "EN") == [("substring", "ENAUG"), ("substring", "ENCUT")]
    assert resolve(spark, "ISMAER", fuzzy=True) == [("fuzzy", "ISMEAR")]


def test_aliases_of_the_user_win(spark):
    built_in = spark.createDataFrame(list(L.ALIASES.items()), "alias string, target string")
    user = spark.createDataFrame([(" SOC ", "OTHER"), ("mine", "ENCUT")], "alias string, target string")
    got = {r["alias"]: r["target"] for r in L.overlaid_aliases(built_in, user).collect()}
    assert got["soc"] == "OTHER" and got["mine"] == "ENCUT" and len(got) == len(L.ALIASES) + 1


def test_tiers(spark):
    tags = spark.createDataFrame([("ENCUT", "cutoff energy of waves")], "title string, description string")
    pages = spark.createDataFrame([("POSCAR", "other", "atoms", True), ("Category:x", "other", "energy", False)], "title string, type string, summary string, is_file_page boolean")
    aliases = spark.createDataFrame([("cut", "ENCUT")], "alias string, target string")
    tier = lambda k, **m: [(r["tier"], r["title"], r["score"]) for r in S.tiered(k, tags, pages, aliases, **m).collect()]
    assert tier("encut") == [("exact", "ENCUT", 100.0)] and tier("cut")[0][0] == "term_map" and tier("poscar")[0][0] == "file_page"
    assert tier("energy cutoff") == [("keyword", "ENCUT", 70.0)]  # and no page of a category
    hits = spark.createDataFrame([("A", "tag", 0.5), ("B", "other", 0.4)], "title string, type string, score double")
    assert tier("waves", hits=hits, type_="other") == [("hybrid", "B", 0.4)]
    assert tier("waves", hits=hits, type_="none") == []


def test_substring_stage_finds_what_a_plain_search_finds(spark):
    import random

    rng = random.Random(7)
    titles = ["".join(rng.choices("ABC_", k=rng.randint(1, 9))) for _ in range(150)] + [None, ""]
    names = ["".join(rng.choices("ABC_", k=rng.randint(0, 4))) for _ in range(80)] + ["Z", "AZB"]
    got = L.containing(spark.createDataFrame([(n, n) for n in set(names)], "name string, up string"), spark.createDataFrame([(x,) for x in titles], "title string").distinct())
    want = {(n, x) for n in set(names) if n for x in set(titles) if x and n in x}
    assert {(r["name"], r["title"]) for r in got.collect()} == want and got.count() == len(want)


def test_close_titles_equal_plain_matching(spark):
    import difflib
    import random

    rng = random.Random(8)
    word = lambda letters, n: "".join(rng.choices(letters, k=n))
    titles = sorted({word("ABCDE", rng.randint(3, 8)) for _ in range(60)} | {word("ABCDEFGHIJ_É", rng.randint(1, 40)) for _ in range(200)} | {word("AB", 230), ""})
    names = sorted({word("abcde", rng.randint(3, 8)) for _ in range(25)} | {word("abcdefghij_é", rng.randint(1, 30)) for _ in range(40)} | {"", "  ", "zzz", word("ab", 220)})
    df = lambda c, rows: spark.createDataFrame([(x,) for x in [*rows, None]], f"{c} string")
    for k, cutoff in ((3, 0.5), (1, 0.8)):
        got: dict = {}
        for r in L.close_titles(df("name", names), df("title", titles), k, cutoff, block=7, titles_block=20).collect():
            got.setdefault(r["name"], []).append((r["ratio"], r["title"]))
        for n in names:
            want = difflib.get_close_matches(n.strip().upper(), titles, k, cutoff)
            assert [x for _, x in sorted(got.get(n, []), reverse=True)] == want, n
    work = L.close_work(df("name", names), df("title", titles)).head()
    assert work["names"] == len(names) and work["pairs"] == len(names) * len(titles) and 0 < work["verified"] < work["pairs"] / 4
    assert L.close_titles(df("name", names), df("title", titles).limit(0)).count() == 0


def test_entry_or_hint(spark):
    index = spark.createDataFrame([("ENCUT",), ("ENCUTGW",), ("SIGMA",), ("Mixed Page",)], "title string")
    names = spark.createDataFrame([(n,) for n in ("encut", "CUTG", "ENC", "nope", "Mixed Page", "page", None)], "name string")
    got = {r["name"]: (r["outcome"], r["titles"]) for r in L.entry_or_hint(names, index).collect()}
    assert got["encut"] == ("entry", ["ENCUT"]) and got["CUTG"] == ("entry", ["ENCUTGW"]) and got["ENC"] == ("several", ["ENCUT", "ENCUTGW"])
    assert got["nope"] == ("missing", []) and got["page"] == ("missing", []) and None not in got
    got = {r["name"]: (r["outcome"], r["titles"]) for r in L.entry_or_hint(names, index, upper=False).collect()}
    assert got["Mixed Page"] == ("entry", ["Mixed Page"]) and got["page"] == ("several", ["Mixed Page"]) and got["encut"] == ("several", ["ENCUT", "ENCUTGW"])


def test_title_keys(spark):
    rows = [("A%20b_C", "a b c"), ("100% x", "100% x"), ("a+b", "a+b"), (" Caf%C3%A9 ", "café"), ("%zz%41", "%zza"), ("%ff", "\ufffd"), (None, None)]
    got = [r[0] for r in spark.createDataFrame([(a,) for a, _ in rows], "t string").select(T.title_key(F.col("t"))).collect()]
    assert got == [b for _, b in rows]


def test_chunk_store_and_results(spark, tmp_path):
    import json

    rows = [(i, f"T{i}", f"u{i}", f"page {i} " + f"word{i} " * 300) for i in range(5)] + [(9, "Old", "u9", "Redirect to: T1 word1"), (10, "None", "u10", None)]
    pages = spark.createDataFrame(rows, "page_idx long, title string, url string, content string")
    G.write_chunks(spark, pages, str(tmp_path / "store"), G.hashing_embedder)
    assert {r["title"] for r in spark.read.parquet(str(tmp_path / "store")).select("title").distinct().collect()} == {f"T{i}" for i in range(5)}
    hits = G.retrieved(spark, str(tmp_path / "store"), spark.createDataFrame([(1, "word3 word3"), (2, "word0")], "query_id long, question string"), G.hashing_embedder, k=2)
    assert {(r["query_id"], r["title"]) for r in hits.where("rn = 1").collect()} == {(1, "T3"), (2, "T0")}
    G.write_results(hits, str(tmp_path / "out"))
    lines = [json.loads(x) for f in (tmp_path / "out").glob("*.json") for x in f.read_text().splitlines()]
    assert sorted(x["query_id"] for x in lines) == [1, 2] and all(len(x["results"]) == 2 for x in lines)


def test_written_index_answers_like_the_corpus(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["the cat", "the dog and the cat", "", None, "a bird"])], "doc_id long, text string")
    S.write_index(docs, str(tmp_path / "index"))
    rows = lambda df: sorted((r["doc_id"], r["score"]) for r in df.collect())
    for q in ("cat", "the bird", "nothing"):
        assert rows(S.bm25_indexed(spark, str(tmp_path / "index"), q)) == rows(S.bm25(docs, q))


def test_change_of_titles(spark):
    df = lambda *x: spark.createDataFrame([(t,) for t in x], "title string")
    assert not P.has_changed(df("A b", "C"), df("A_b", "C"), "1", "1")
    assert P.has_changed(df("A b", "C"), df("A_b"), "1", "1") and P.has_changed(df("A"), df("A"), "1", "2")


def test_structures_samples_and_written_texts(spark, tmp_path):
    (tmp_path / "P").write_text("title\n1.0\na\nb\nc\n Zn  O \n2 2\n")
    assert files.structure_symbols(spark, str(tmp_path / "P")).head()["symbols"] == ["Zn", "O"]
    rows = files.sample_rows(spark.range(500), 1.0, 40).collect()
    assert sorted(r["number"] for r in rows) == list(range(1, 41))
    df = spark.createDataFrame([({"A": "1", "B": "x"},)], "config map<string,string>")
    files.write_config_texts(df, str(tmp_path / "out"))
    assert "A = 1\nB = x" in "".join(f.read_text() for f in (tmp_path / "out").glob("*.txt"))


def test_recursive_chunks():
    text = "\n\n".join(f"Paragraph {i} " + "word " * 60 for i in range(8))
    parts = G.split_text(text, 400, 80)
    assert all(len(p) <= 400 for p in parts) and parts[0].startswith("Paragraph 0") and all(f"Paragraph {i}" in " ".join(parts) for i in range(8))
    assert G.split_text("x" * 950, 400, 80)[0] == "x" * 400 and G.split_text("", 400, 80) == []


def plain_chunks(text, size, overlap, marks=("\n\n", "\n", " ", "")):
    """Recursive splitting, by joining pieces anew for each question."""
    mark = [m for m in marks if m in text][0]
    rest = marks[marks.index(mark) + 1 :]
    pieces = text.split(mark) if mark else list(text)
    out, held = [], []
    for piece in pieces:
        if len(piece) > size:
            out, held = out + [mark.join(held).strip()] * bool(held), []
            out += plain_chunks(piece, size, overlap, rest) if rest else [piece]
            continue
        if held and len(mark.join([*held, piece])) > size:
            out.append(mark.join(held).strip())
            while held and (len(mark.join(held)) > overlap or len(mark.join([*held, piece])) > size):
                held.pop(0)
        held.append(piece)
    out += [mark.join(held).strip()] * bool(held)
    return [x for x in out if x]


def test_recursive_chunks_equal_plain_ones(spark):
    import random

    rng = random.Random(12)
    texts = ["".join(rng.choices(["a", "bc", "def", " ", " ", "\n", "\n\n", "x" * 30], k=rng.randint(0, 200))) for _ in range(150)] + [None, "", " \n\n "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size, overlap in ((20, 5), (50, 49), (7, 0)):
        got = {}
        for r in G.chunks(docs, size, overlap).collect():
            got.setdefault(r["doc_id"], []).append((r["chunk_idx"], r["start_index"], r["chunk"]))
        for i, text in enumerate(texts):
            own = sorted(got.get(i, []))
            assert [c for _, _, c in own] == plain_chunks(text or "", size, overlap)
            assert all(text[at : at + len(c)] == c for _, at, c in own) and [n for n, _, _ in own] == list(range(len(own)))
            for (_, a, x), (_, b, y) in zip(own, own[1:], strict=False):
                assert b == text.find(y, max(0, a + len(x) - overlap))


def test_readers(spark, tmp_path):
    (tmp_path / "pages.json").write_text('[{"title": "A", "url": "u", "content": "x"}, {"title": "B"}, {"content": "y", "more": 1}]')
    rows = files.pages(spark, str(tmp_path / "pages.json")).orderBy("page_idx").collect()
    assert [(r["title"], r["url"], r["content"]) for r in rows] == [("A", "u", "x"), ("B", "", ""), ("", "", "y")]
    (tmp_path / "configs.json").write_text('{"directory": "d", "config": {"B": 1.50, "A": [1, true]}}\n{"directory": "e", "config": null}\n')
    rows = files.configs(spark, str(tmp_path / "configs.json")).orderBy("config_id").collect()
    assert [r["directory"] for r in rows] == ["d", "e"] and rows[0]["config"].toPython()["A"] == [1, True] and rows[1]["config"] is None
    df = spark.createDataFrame([(0, None, "u", "z" * 60)], "page_idx long, title string, url string, content string")
    assert [r["title"] for r in P.other_pages(df).collect()] == [""]


def test_nearest_equals_brute_force(spark):
    import numpy as np

    v = np.random.default_rng(5).normal(size=(60, 8)).astype(np.float32)
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = {}
    for r in G.nearest(vectors.where("vec_id < 7").selectExpr("vec_id query_id", "embedding"), vectors, 3, block=4).orderBy("rn").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    for q in range(7):
        assert got[q] == np.argsort(((v - v[q]) ** 2).sum(1), kind="stable")[:3].tolist()


def test_vector_index(spark, tmp_path):
    """Recall of 0.9 at the measured probes, exact with all of them, rows that can't be compared, hot lists in parts."""
    import random

    from kvatlas.operators import vectors as V

    rng = random.Random(3)
    centres = [[rng.gauss(0, 3) for _ in range(8)] for _ in range(12)]
    rows = [(i, [rng.gauss(c, 1) for c in centres[min(i % 20, 11)]]) for i in range(3000)]
    odd = [(3000, None), (3001, [1.0, None] + [0.0] * 6), (3002, [1.0]), (3003, rows[0][1]), (3004, rows[0][1])]
    v = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(5)
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    path = str(tmp_path / "index")
    V.write_index(v, path)
    exact = {(r["query_id"], r["rn"]): (r["vec_id"], r["distance"]) for r in G.nearest(q, v.where("vec_id <> 3002"), 10).collect()}
    rows_of = lambda df: {(r["query_id"], r["rn"]): (r["vec_id"], r["distance"]) for r in df.collect()}
    assert rows_of(V.probed(q, path, 10, probes=10**6)) == exact and exact[0, 2][0] == 3003
    found = {(q_, x[0]) for (q_, _), x in rows_of(V.probed(q, path, 10)).items()}
    probes = spark.read.parquet(f"{path}/probes").head()["probes"]
    assert len(found & {(q_, x[0]) for (q_, _), x in exact.items()}) >= 0.9 * len(exact) and 1 <= probes < 40
    assert spark.read.parquet(f"{path}/lists").count() == 3002
    none = str(tmp_path / "none")
    V.write_index(v.limit(0), none)
    assert V.probed(q, none, 10).count() == 0
    same = str(tmp_path / "same")
    V.write_index(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(50)], v.schema), same, lists=5)
    assert [r["vec_id"] for r in V.probed(q.limit(0).union(spark.createDataFrame([(1, [1.0, 2.0])], q.schema)), same, 3).collect()] == [0, 1, 2]


def test_nearest_keeps_the_smallest_ids_of_equal_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    v = rng.normal(size=(1500, 8)).astype(np.float32)
    same = rng.permutation(1500)[:400]
    v[same[:200]] = v[same[0]]
    v[same[200:]] = v[same[0]] + np.float32(1e-5) * rng.normal(size=(200, 8))  # as near, once rounded
    order = rng.permutation(1500).tolist()
    vectors = spark.createDataFrame([(i, v[i].tolist()) for i in order], "vec_id long, embedding array<float>").coalesce(1)
    own = [int(same[0]), *range(5)]
    got = {}
    for r in G.nearest(vectors.where(f"vec_id in ({', '.join(map(str, own))})").selectExpr("vec_id query_id", "embedding"), vectors, 5).orderBy("rn").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    for q in set(own):
        d = ((v.astype(float) - v[q].astype(float)) ** 2).sum(1).round(6)
        assert got[q] == np.lexsort((np.arange(1500), d))[:5].tolist()


def test_prompts_come_from_whole_texts(spark, tmp_path):
    import numpy as np

    from kvatlas.plans import catalogue

    filler = "\n\n".join(" ".join(f"w{i}x{j}" for j in range(60)) for i in range(30))
    docs = [(i, filler.replace("x", f"y{i}z")) for i in range(6)] + [(6, filler + "\n\n" + "The cutoff of zinc oxide is 520 eV. " * 27), (7, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    asked = "the cutoff of zinc oxide is"
    spark.createDataFrame([(0, asked), (1, "w3y2z7 w3y2z8")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["query_id"]: r["prompt"] for r in catalogue.QUERIES["chunk_prompts"](spark, str(tmp_path)).collect()}
    parts = [(d, i, c) for d, t in docs for i, c in enumerate(G.split_text(t or "", 1000, 200))]
    embed = G.hashing_embedder()
    v = embed([c for _, _, c in parts]).astype(float)
    for q, question in enumerate((asked, "w3y2z7 w3y2z8")):
        d = ((v - embed([question])[0].astype(float)) ** 2).sum(1).round(6)
        best = sorted(range(len(parts)), key=lambda i: (d[i], parts[i][:2]))[:5]
        assert got[q] == G.PROMPT % ("\n\n".join(parts[i][2] for i in best), question)
    assert len(filler) > 1000 and "520 eV" in got[0]


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "CFG").write_text("A = 1\n")
    (tmp_path / "CFG").write_text("B = x = y\n")
    (tmp_path / "CFG2").write_text("C = 2\nD = 3\n")
    assert [r["config"] for r in files.config_files(spark, str(tmp_path), "CFG").collect()] == [{"A": "1"}]
    assert files.config_files(spark, str(tmp_path), "CFG2").head()["config"] == {"C": "2", "D": "3"}
    assert sorted(r["tag"] for r in files.config_keys(spark, str(tmp_path), "CFG*").collect()) == ["A", "C", "D"]
    (tmp_path / "e.json").write_text('{"_version": "0.2.0", "data": [{"alias": "a", "target": "b"}]}')
    assert files.envelope(spark, str(tmp_path / "e.json"), "alias string, target string").collect()[0]["target"] == "b"
    (tmp_path / "old.json").write_text('{"_version": "0.1.0", "data": [{"alias": "a", "target": "c"}]}')
    with pytest.warns(UserWarning, match="0.1.0"):
        assert files.envelope(spark, str(tmp_path / "old.json"), "alias string, target string").collect()[0]["target"] == "c"
    (tmp_path / "bare.json").write_text('[{"alias": "a", "target": "d"}]')
    assert files.version_of(spark, str(tmp_path / "bare.json")) is None
    assert files.envelope(spark, str(tmp_path / "bare.json"), "alias string, target string").collect()[0]["target"] == "d"
    df = spark.range(3)
    files.write(df, str(tmp_path / "t"))
    assert files.read(spark, str(tmp_path / "t")).count() == 3


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, "a" if i % 3 else "b", float(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "i long, event_type string, value double").selectExpr("timestamp_seconds(1700000000 + i * 600) ts", "event_type", "value")
    df.write.parquet(str(tmp_path / "in"))
    stream = windowed(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, windowed(df).collect()))
