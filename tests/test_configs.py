"""Hand-written configurations: typed equality, statistics, edits and differences."""

import json
import random

import pytest
from pyspark.sql import functions as F

from kvatlas.functions import values
from kvatlas.operators import configs as C
from kvatlas.operators import rules as R

CONFIGS = [
    {"ENCUT": 520, "ISMEAR": 0, "SIGMA": 0.2, "ALGO": "Fast"},
    {"ENCUT": 520.0, "ISMEAR": 0, "EDIFF": 1e-05},
    {"ENCUT": "520", "LWAVE": True},
    {"LWAVE": 1, "MAGMOM": [1, 2, 3]},
    {"MAGMOM": [[1, 5], [0]], "ALGO": "Fast"},
    {},
    {"ALGO": "Fast", "SIGMA": 0.2, "ISMEAR": 0, "ENCUT": 520},
    {"XKEY": "a"},
]


@pytest.fixture(scope="module")
def configs(spark):
    rows = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(CONFIGS)], "config_id long, config_json string")
    return rows.withColumn("config", F.parse_json("config_json"))


def ids(df):
    return sorted(r["config_id"] for r in df.collect())


def test_typed_equality(configs):
    assert ids(C.matching(configs, {"ENCUT": "520"})) == [0, 1, 6]  # a string of digits isn't a number
    assert ids(C.matching(configs, {"ENCUT": "520.0", "ISMEAR": "0"})) == [0, 1, 6]
    assert ids(C.matching(configs, {"LWAVE": "1"})) == [2, 3]  # true equals 1
    assert ids(C.matching(configs, {"ALGO": "Fast", "LWAVE": "1"}, any_match=True)) == [0, 2, 3, 4, 6]
    assert ids(C.matching(configs, {"NONE": "1"})) == []
    assert len(ids(C.matching(configs, {}))) == len(CONFIGS)


def test_list_membership(configs):
    assert ids(C.by_example(configs, [("MAGMOM", "2")])) == [3]
    assert ids(C.by_example(configs, [("MAGMOM", "5")])) == [4]  # one level down
    assert ids(C.by_example(configs, [("MAGMOM", "1"), ("ALGO", "Fast")])) == [4]
    assert ids(C.by_example(configs, [("MAGMOM", "1"), ("ALGO", "Fast")], match_all=False)) == [0, 3, 4, 6]
    assert len(ids(C.by_example(configs, []))) == len(CONFIGS)


def variants(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "config_id long, j string")
    return rows.select("config_id", F.lit("T").alias("tag"), F.parse_json("j").alias("value"))


def test_a_string_is_no_member_of_a_list(spark):
    df = variants(spark, ['["a", "b"]', '"a"', "[true, 2]", "[[1, 5], 7]"])
    hits = lambda x: [r[0] for r in df.select(values.member(F.col("value"), x)).collect()]
    assert hits("a") == [False, True, False, False] and hits(1) == [False, False, True, True]
    assert hits(7.0) == [False, False, False, True] and hits(True) == [False, False, True, True]


def test_keys_that_a_path_cannot_name(spark):
    keys = ["it's", 'say "x"', "a[0]", "a.b"]
    df = spark.createDataFrame([(0, json.dumps({k: i for i, k in enumerate(keys)}))], "config_id long, j string").withColumn("config", F.parse_json("j"))
    for i, k in enumerate(keys):
        assert ids(C.matching(df, {k: str(i)})) == [0] and ids(C.by_example(df, [(k, str(i + 1))])) == []


def test_canonical_text_of_decimals(spark):
    numbers = [1e-05, 0.00001, 0.0001, 0.00012, 0.001, 1.5e-7, 520.0, 1234567.25, 12345678.5, 1e7, 1e15, 123456789012345.6, 1e16, 1.5e30, -2e-9, 0.0, 0.1 + 0.2, 1e100]
    texts = [json.dumps(x) for x in numbers] + ["0.00001", "520", "2.50", "[1e-05, 0.00001, 3]"]
    got = [r[0] for r in variants(spark, texts).select(values.canonical(F.col("value"))).collect()]
    assert got == [repr(x) for x in numbers] + ["1e-05", "520", "2.5", "[1e-05,1e-05,3]"]


def test_values_as_python_shows_them(spark):
    things = [True, False, None, 1, 1e-05, 520.0, "text", [1, 2.5], ["a", True], [[1], ["x"]], []]
    got = [r[0] for r in variants(spark, [json.dumps(x) for x in things]).select(values.shown(F.col("value"))).collect()]
    assert got == [str(x) for x in things]


def test_typed_text_follows_equality(spark):
    things = [1, 1.0, True, "1", [1, 2], [1.0, 2], [2, 1], 0, -0.0, False, "true", None, {"a": 1}, [[1], [2]], [[True], [2.0]], "n1.0"]
    got = [r[0] for r in variants(spark, [json.dumps(x) for x in things]).select(values.typed(F.col("value"))).collect()]
    for a, x in zip(got, things, strict=True):
        for b, y in zip(got, things, strict=True):
            assert (a == b) == (x == y), (x, y)


def test_list_values(spark):
    df = variants(spark, ['[["a"], [1, 2]]', '[["a"], ["b"]]', "[1, 1.0, true]", "[]", '"x"', '["p", "q"]', "[[0.5], [true]]"])
    got = {}
    for r in C.list_values(df).collect():
        got.setdefault(r["config_id"], []).append(r["value"])
    assert got == {0: ["1", "2"], 1: ['[["a"],["b"]]'], 2: ["1", "1.0", "true"], 4: ['"x"'], 5: ['"p"', '"q"'], 6: ["0.5", "true"]}


def test_same_compares_columns(spark):
    rows = [("1", "1.0", True), ("true", "1", True), ('"1"', "1", False), ("[1,2]", "[1,2]", True), ("[1,2]", "[2,1]", False), ('"a"', '"a"', True)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean").select(values.same(F.parse_json("a"), F.parse_json("b")).alias("got"), "want")
    assert all(r["got"] == r["want"] for r in df.collect())


def test_statistics_count_empty_configurations(configs):
    kv = C.exploded(configs).select("config_id", "tag", F.col("value_json").alias("value"))
    rows = {(r["tag"], r["value"]): r for r in C.tag_stats(kv, configs).collect()}
    assert rows["ALGO", '"Fast"']["c"] == 3 and rows["ALGO", '"Fast"']["total_configs"] == 8 and rows["ALGO", '"Fast"']["freq"] == 37.5
    assert rows["ENCUT", "520"]["c"] == 2 and rows["ENCUT", "520.0"]["c"] == 1 and rows["ENCUT", '"520"']["c"] == 1
    nested = {r["tag"]: r for r in C.nested_stats(C.tag_stats(kv, configs)).collect()}
    assert [(v["value"], v["count"]) for v in nested["ENCUT"]["top_values"]][0] == ("520", 2)


def test_exploded_keeps_order(configs):
    rows = C.exploded(configs).where("config_id = 6").orderBy("pos").collect()
    assert [r["tag"] for r in rows] == ["ALGO", "SIGMA", "ISMEAR", "ENCUT"]


def test_deduplicated_ignores_order(configs):
    kv = C.exploded(configs).select("config_id", "tag", F.col("value_json").alias("value"))
    got = {r["config_id"]: (r["first_id"], r["copies"]) for r in C.deduplicated(kv).collect()}
    assert got[0] == (0, 2) and got[6] == (0, 2) and got[1] == (1, 1)


def test_deduplicated_keeps_keys_and_values_apart(spark):
    rows = [(0, "a", "1\nb=2"), (1, "a", "1"), (1, "b", "2"), (2, "a=b", "c"), (3, "a", "b=c")]
    got = C.deduplicated(spark.createDataFrame(rows, "config_id long, tag string, value string")).collect()
    assert sorted((r["config_id"], r["first_id"], r["copies"]) for r in got) == [(i, i, 1) for i in range(4)]


def test_dedupe_difference_and_allowed_values_are_typed(spark, configs):
    kv = C.exploded(configs).select("config_id", "tag", "value")
    got = {r["config_id"]: (r["first_id"], r["copies"]) for r in C.deduplicated(kv).collect()}
    assert got[0] == (0, 2) and got[6] == (0, 2) and got[2] == (2, 1)
    rows = [(0, "A", "1"), (0, "B", "[1, 2]"), (1, "B", "[1.0, 2.0]"), (1, "A", "true"), (2, "A", '"1"'), (2, "B", "[2, 1]")]
    kv = spark.createDataFrame(rows, "config_id long, tag string, j string").select("config_id", "tag", F.parse_json("j").alias("value"))
    got = {r["config_id"]: (r["first_id"], r["copies"]) for r in C.deduplicated(kv).collect()}
    assert got == {0: (0, 2), 1: (0, 2), 2: (2, 1)}
    states = {r["tag"]: r["state"] for r in C.difference(kv.where("config_id = 0"), kv.where("config_id = 1")).collect()}
    assert states == {"A": "common", "B": "common"}
    states = {r["tag"]: r["state"] for r in C.difference(kv.where("config_id = 0"), kv.where("config_id = 2 and tag = 'A'")).collect()}
    assert states == {"A": "different", "B": "only_1"}
    allowed = spark.range(1).select(F.lit("A").alias("tag"), F.array(F.parse_json(F.lit("1.0")), F.parse_json(F.lit('"x"'))).alias("allowed"))
    assert ids(C.not_allowed(kv, allowed)) == [2]


def test_pair_answer(configs, spark):
    kv = C.exploded(configs).select("config_id", "tag", F.col("value_json").alias("value"))
    related = spark.createDataFrame([("ISMEAR", ["SIGMA", "ENCUT"]), ("ALGO", [])], "title string, related array<string>")
    (r,) = C.pair_answer(kv, "ENCUT", "ISMEAR", related).collect()
    assert r["both"] == 3 and r["wiki_related"] and [(x["value"], x["count"]) for x in r["top_a_values"]] == [("520", 2), ('"520"', 1), ("520.0", 1)]
    assert [(x["value"], x["count"]) for x in r["top_pairs"]] == [("520=0", 2), ("520.0=0", 1)] and r["top_b_values"][0]["count"] == 3
    (r,) = C.pair_answer(kv, "ENCUT", "NONE").collect()
    assert (r["count_b"], r["both"], r["wiki_related"], r["top_b_values"], r["top_pairs"]) == (0, 0, False, [], [])


def test_preview(spark):
    assert C.preview(spark.range(100), "id").where("note is null").count() == 100
    rows = C.preview(spark.range(101), "id").collect()
    assert [r["id"] for r in rows] == [0, 1, 2] and {r["note"] for r in rows} == {"Showing 3 of 101 matches."}


def test_cooccurrence_is_symmetric_without_diagonal(configs):
    kv = C.exploded(configs).select("config_id", "tag", F.col("value_json").alias("value"))
    got = {(r["a"], r["b"]): r["n"] for r in C.cooccurrence(kv).collect()}
    assert got["ENCUT", "ISMEAR"] == 3 and all(got[b, a] == n for (a, b), n in got.items())
    assert not any(a == b for a, b in got) and not any("XKEY" in k for k in got)


def test_contexts_may_be_empty(configs):
    kv = C.exploded(configs).select("config_id", "tag", F.col("value_json").alias("value"))
    got = [r for r in C.contexts(kv).collect() if r["tag"] == "XKEY"]
    assert [(r["context"], r["n"], r["total"]) for r in got] == [("", 1, 1)]


def test_example_config_keeps_every_alternative(spark):
    rows = [("E", f"{i:04}", 3 if i == 7 else 2 if i < 1400 else 1, False) for i in range(2500)] + [("E", "nan", 9, True)]
    analysis = spark.createDataFrame(rows, "tag string, value string, n long, absent boolean")
    for least, want in ((1, 2499), (2, 1399), (4, 0)):
        (r,) = C.example_config(analysis, least).collect()
        others = r["alternatives"].split(", ") if r["alternatives"] else []
        assert (r["value"], r["commented"], r["occurrences"]) == ("0007", True, sum(x[2] for x in rows))
        assert others == [f"{v} ({n}x)" for _, v, n, _ in sorted(rows[:2500], key=lambda x: (-x[2], x[1]))[1:]][:want]


def test_literals():
    assert values.filter_literal("1e-5") == 1e-5 and values.filter_literal("true") == "true" and values.filter_literal("3") == 3
    assert values.example_literal("1e-5") == "1e-5" and values.example_literal("true") is True and values.example_literal("2.5") == 2.5
    assert values.edit_literal("1e3") == 1000 and values.edit_literal(".FALSE.") is False and values.edit_literal("Fast") == "Fast"


def test_config_text(spark):
    texts = ["A = 1 ; B = .TRUE.\n# c = 3\nD = x y # n\n", "A = B = C", "", "E = 1e-5\nF = 2.50", "SYSTEM = hi! there\n  G\t= .t.", "A = 1 # B = 2", "#A = 1 = 2\nH = f"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(values.parse_config_text(F.col("t"))).collect()]
    assert got[0] == {"A": "1", "B": "true", "D": '"x y"'} and got[1] is None and got[2] == {}
    assert float(got[3]["E"]) == 1e-5 and float(got[3]["F"]) == 2.5
    assert got[4] == {"SYSTEM": '"hi! there"', "G": '".t."'} and got[5] is None and got[6] == {"H": "false"}


def test_edit_tokens(spark):
    df = spark.createDataFrame([(["soc", "nelect=7.0", "spin=TRUE", "pbe=t", "soc=false"],)], "t array<string>")
    assert df.select(values.edit_tokens(F.col("t")).alias("m")).head()["m"] == {"soc": "false", "nelect": "7", "spin": "true", "pbe": '"t"'}


def edit(spark, config, **wanted):
    df = spark.createDataFrame([(config,)], "config map<string,string>")
    return R.edited(df, wanted).collect()[0]["edited"]


def test_rules(spark):
    assert edit(spark, {}, soc=True) == {"LSORBIT": "true"}
    assert edit(spark, {"GGA": '"RP"', "IBRION": "0", "NSW": "9"}) == {}  # keys that no feature claims go
    assert edit(spark, {}, hse0=True) == {"LHFCALC": "true", "HFSCREEN": "0.2", "ALGO": '"All"', "PRECFOCK": '"Fast"'}
    assert edit(spark, {"LHFCALC": "true", "HFSCREEN": "0.2"}, hse0=False, pbe0=True)["LHFCALC"] == "true"
    assert "HFSCREEN" not in edit(spark, {"LHFCALC": "true", "HFSCREEN": "0.2"}, hse0=False, pbe0=True)
    assert edit(spark, {}, spin=2) == {"ISPIN": "2", "NUPDOWN": "2"}
    assert edit(spark, {"ISPIN": "2", "NUPDOWN": "2"}, spin=False) == {}
    assert edit(spark, {}, phonon=True, relax3=True) == {"IBRION": "2", "ISIF": "3", "NSW": "25"}  # later rules win
    assert edit(spark, {}, scan=True, nosym=True, nelect=7, nothing=True) == {"METAGGA": '"r2SCAN"', "ISYM": "-1", "NELECT": "7"}


def test_changes_report_removed_keys(spark):
    df = spark.createDataFrame([({"A": "1", "B": "2"}, {"B": "3", "C": "4"})], "a map<string,string>, b map<string,string>")
    got = df.select(R.changes(F.col("a"), F.col("b")).alias("c")).collect()[0]["c"]
    assert [(r["key"], r["old"], r["new"]) for r in got] == [("A", "1", None), ("B", "2", "3"), ("C", None, "4")]


def test_active_features(spark):
    df = spark.createDataFrame([({"IBRION": "2", "ISPIN": "2", "NUPDOWN": "0.5", "NELECT": "9"},)], "config map<string,string>")
    assert R.active(df).head()["features"] == ["relax2", "spin=0.5", "nelect=9"]


def thing(rng, depth=0):
    kinds = [lambda: rng.choice([0, 1, -1, 2**53, 2**53 + 1, 10**20, 7]), lambda: rng.choice([0.0, 1.0, 2.0**53, 1e20, 0.1, 1e-5, 1e300, -0.5]), lambda: rng.choice([True, False, None]), lambda: rng.choice(["", "1", "true", "é\t", "null"])]
    if depth < 5:
        kinds += [lambda: [thing(rng, depth + 1) for _ in range(rng.randint(0, 2))], lambda: {rng.choice("ab"): thing(rng, depth + 1) for _ in range(rng.randint(0, 2))}] * 2
    return rng.choice(kinds)()


def other(x, rng):
    """An equal value in other words, or nearly so."""
    if isinstance(x, list):
        return [other(y, rng) for y in x]
    if isinstance(x, dict):
        return {k: other(x[k], rng) for k in reversed(x)}
    forms = {0: [0, False, 0.0], 1: [1, True, 1.0], 2**53: [2**53, 2.0**53, 2**53 + 1]}
    return rng.choice(forms.get(x, [x])) if isinstance(x, (int, float)) else x


def test_equality_is_that_of_python(spark):
    rng = random.Random(3)
    pairs = [(a, other(a, rng) if rng.random() < 0.7 else thing(rng)) for a in (thing(rng) for _ in range(10_000))]
    df = spark.createDataFrame([(i, json.dumps(a), json.dumps(b)) for i, (a, b) in enumerate(pairs)], "i int, a string, b string").repartition(4)
    got = df.select("i", values.same(F.parse_json("a"), F.parse_json("b")).alias("same"), values.canonical(F.parse_json("a")).alias("text"), values.shown(F.parse_json("a")).alias("shown")).collect()
    equal = 0
    for r in got:
        a, b = pairs[r["i"]]
        assert r["same"] == (a == b), (a, b)
        equal += a == b
        assert json.loads(r["text"] or "null") == a and (a is None or r["shown"] == str(json.loads(json.dumps(a, sort_keys=True)))), (a, r)
    assert 1000 < equal < 9000
    one = variants(spark, ["[[[1]]]", "[[[true]]]", "[[[1.0]]]", '{"x":1}', '{"x":1.0}', '{"x":1e-5}', '{"x":0.00001}']).select(values.typed(F.col("value")), values.canonical(F.col("value"))).collect()
    assert len({r[0] for r in one[:3]}) == 1 and len({r[0] for r in one[3:5]}) == 1 and one[5] == one[6] and len({r[1] for r in one[:5]}) == 5
    big = variants(spark, ["9007199254740993", "9007199254740992", "9007199254740992.0", "true", "[1,{\"a\":2.0}]"])
    hits = lambda x: [r[0] for r in big.select(values.equals(F.col("value"), x)).collect()]
    assert hits(2**53) == [False, True, True, False, False] and hits(2**53 + 1) == [True] + [False] * 4 and hits(1.0) == [False] * 3 + [True, False] and hits([True, {"a": 2}]) == [False] * 4 + [True]


def test_repeated_keys_count_once(spark):
    kv = C.exploded(spark.createDataFrame([(1, '{"a":1,"b":2,"a":3}'), (2, '{"a":3}'), (3, "{}")], "config_id long, config_json string"))
    assert sorted((r["config_id"], r["pos"], r["tag"], r["value_json"]) for r in kv.collect()) == [(1, 0, "a", "3"), (1, 1, "b", "2"), (2, 0, "a", "3")]
    configs = spark.createDataFrame([(i,) for i in (1, 2, 3)], "config_id long")
    stats = {r["tag"]: r for r in C.tag_stats(kv.drop("value").withColumnRenamed("value_json", "value"), configs).collect()}
    assert stats["a"]["freq"] == 66.7 and stats["b"]["total_configs"] == 3
    made = C.missing_tags(kv.drop("value").withColumnRenamed("value_json", "value"), spark.createDataFrame([("b",)], "title string"), min_count=1, always=(), configs=configs).collect()
    assert [(r["title"], r["n"]) for r in made] == [("a", 2)] and "2 of 3 configurations (66.7%)" in made[0]["description"]
    many = spark.createDataFrame([(i, "t", str(i % 7)) for i in range(20)], "config_id long, tag string, value string")
    assert [C.tag_stats(many, k=k).count() for k in (0, None, 3)] == [7, 7, 3]


def test_numbers_of_a_configurations_text(spark):
    texts = ["5d", "1.5f", "inf", "-Infinity", "nan", "1_000", "1__0", "_1", ".5", "5.", ".", "+7", "1e3", "1E400", "0x10", "a\tb", 'q"\\', "12345678901234567", "1e20", "2.50", "1e-7", "T", ".FALSE.", "", "１"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(values.edit_json(F.col("t"))).collect()]
    for text, own in zip(texts[:-1], got[:-1], strict=True):
        assert json.dumps(values.edit_literal(text)) == own or float(own) == values.edit_literal(text), (text, own)


def test_example_text_in_order(spark, tmp_path):
    rows = [("A", False, 5, "A = 1"), ("B", True, 9, "# B = 2"), ("C", False, 7, "C = 3"), ("D", False, 7, "D = 4"), ("E", True, 2, "# E = 5")]
    df = spark.createDataFrame(rows, "tag string, commented boolean, occurrences long, line string").repartition(3)
    C.write_example(df, str(tmp_path / "out"))
    (file,) = (tmp_path / "out").glob("part-*")
    assert file.read_text() == "C = 3\nD = 4\nA = 1\n\n# B = 2\n# E = 5\n"
    assert [r["line"] for r in C.example_text(df.where("not commented")).orderBy("number").collect()] == ["C = 3", "D = 4", "A = 1"]


def test_baskets_are_dealt_by_their_number(spark, monkeypatch):
    from kvatlas.plans import catalogue, views

    folder = "/root/testdata/sf0.001"
    monkeypatch.setattr(catalogue, "dealt_parts", lambda df: views.dealt_parts(df, 500))
    rows = catalogue.list_values(spark, folder)
    lines = views.table(spark, folder, "lineitem")
    assert views.dealt_parts(lines, 500) == -(-lines.count() // 500) > 4 and views.dealt_parts(lines) == 4
    assert rows.rdd.getNumPartitions() == views.dealt_parts(lines, 500) and rows.agg(F.sum("n")).head()[0] == 2 * lines.count()


def test_members_of_baskets_equal_sql(spark, tmp_path):
    import duckdb

    from kvatlas.plans import catalogue

    one = [(i, 3, q, "A") for i, q in enumerate((17.0, 16.5, 17.5, 16.6, 17.4, 17.9, None, -17.0))]  # rounded half to even
    more = [(10, 3, 17.0, None), (11, 3, 17.0, "AA"), (12, 3, 17.0, "N"), (12, 4, 1.0, "A"), (13, 4, 17.0, "A"), (14, 3, 1.0, "A"), (14, 5, 17.0, "R"), (None, 3, 1.0, "B"), (None, 5, 17.0, "A"), (15, None, None, None)]
    many = [(20, i % 7, float(i % 50), "A") for i in range(5000)]
    spark.createDataFrame(one + more + many, "l_orderkey long, l_linenumber int, l_quantity double, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    for folder, files in (("/root/testdata/sf0.001", "lineitem.parquet"), (str(tmp_path), "lineitem.parquet/*.parquet")):
        con = duckdb.connect()
        con.execute(f"create view lineitem as select * from '{folder}/{files}'")
        rows = catalogue.config_list_member(spark, folder)
        got = [r["l_orderkey"] for r in rows.collect()]
        assert sorted(got, key=str) == sorted((x for (x,) in con.execute(catalogue.SQL["config_list_member"]).fetchall()), key=str)
    assert set(got) == {0, 3, 4, 12, 14, 20, None} and "collect_list" not in rows._jdf.queryExecution().optimizedPlan().toString()
