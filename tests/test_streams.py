"""Incremental statistics, change detection, validated reading and the following of links, against plain versions."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kvatlas.operators import configs as C
from kvatlas.sources import crawl, files
from kvatlas.streaming import changes, incremental


def rows_of(df, *columns):
    return sorted(map(repr, (tuple(r) for r in df.select(*(columns or df.columns)).collect())))


def test_replayed_batches_count_once(spark, tmp_path):
    rng = random.Random(2)
    configs = [(i, json.dumps({k: rng.choice([1, 2, 2.0, "x"]) for k in rng.sample(["ENCUT", "ALGO", "ISPIN", "X", "Y"], rng.randint(0, 4))})) for i in range(90)]
    df = lambda rows: spark.createDataFrame(rows, "config_id long, config_json string")
    path = str(tmp_path / "counts")
    assert incremental.state(spark, path) is None
    (tmp_path / "in").mkdir()
    for part in range(3):
        (tmp_path / "in" / f"{part}.json").write_text("\n".join(json.dumps({"config_id": i, "config_json": c}) for i, c in configs[part * 30 : part * 30 + 30]))
    stream = spark.readStream.schema("config_id long, config_json string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = stream.writeStream.foreachBatch(incremental.updates(path)).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    kv = C.exploded(df(configs)).select("config_id", "tag", F.col("value_json").alias("value"))

    def check():
        counts = incremental.state(spark, path)
        assert rows_of(incremental.tag_stats(counts)) == rows_of(C.tag_stats(kv, df(configs)))
        assert rows_of(incremental.contexts(counts)) == rows_of(C.contexts(kv))
        assert rows_of(incremental.cooccurrence(counts)) == rows_of(C.cooccurrence(kv))

    check()
    batch = spark.read.parquet(f"{path}/batches").agg(F.max("batch")).head()[0]
    assert batch == 2
    files_in = [json.loads(x)["config_id"] for x in (tmp_path / "in" / "1.json").read_text().split("\n")]
    # which file was which batch: replay them all, with what they had
    parts = {b: df([c for c in configs if c[0] // 30 == b]) for b in range(3)}
    incremental.updates(str(tmp_path / "again"))(parts[0], 0)
    for b in (0, 1, 1, 0, 2):
        incremental.updates(str(tmp_path / "again"))(parts[b], b)
    assert rows_of(incremental.state(spark, str(tmp_path / "again"))) == rows_of(incremental.state(spark, path)) and len(files_in) == 30
    incremental.compact(spark, path)
    incremental.compact(spark, path)
    incremental.updates(path)(parts[2], 2)  # in the base already
    check()
    incremental.updates(path)(df([(900, '{"X":1}')]), 3)
    assert incremental.state(spark, path).where("kind = 'configs'").head()["n"] == 91


START = datetime(2024, 1, 1)


def test_stream_of_changes_equals_the_table(spark, tmp_path):
    rng = random.Random(7)
    seen = [(f"p{rng.randint(0, 5)}", START + timedelta(minutes=m), rng.choice("ab")) for m in range(0, 400, 3)]
    seen += [("once", START, "a"), ("null", START + timedelta(minutes=5), None), (None, START, "x"), ("no time", None, "x")]
    seen.sort(key=lambda r: r[1] or START)
    gone, late = timedelta(minutes=25), timedelta(minutes=10)
    schema = "title string, at timestamp, digest string"
    (tmp_path / "in").mkdir()
    step = 20
    for i in range(0, len(seen), step):
        rows = [{"title": t, "at": a and a.isoformat(), "digest": d} for t, a, d in seen[i : i + step]]
        (tmp_path / "in" / f"{i:04}.json").write_text("\n".join(map(json.dumps, rows)))
        import os

        os.utime(tmp_path / "in" / f"{i:04}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = changes.changes(stream, gone, "10 minutes").writeStream.format("memory").queryName("changes").outputMode("append")
    query = out.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    until = max(a for _, a, _ in seen if a) - late
    table = spark.createDataFrame(seen, schema)
    assert rows_of(spark.table("changes")) == rows_of(changes.observed_changes(table, gone, until))
    kinds = {r["change"] for r in spark.table("changes").collect()}
    assert kinds == {"new", "changed", "removed"}
    # and the table's are those of plain Python
    want = []
    for title in {t for t, a, _ in seen if t and a}:
        last = None
        for at, digest in sorted((a, d or "null") for t, a, d in seen if t == title and a):
            if last and at - last[0] > gone:
                want.append((title, "removed", last[0] + gone))
                last = None
            if not last or last[1] != digest:
                want.append((title, "changed" if last else "new", at))
            last = at, digest
        if last[0] + gone < until:
            want.append((title, "removed", last[0] + gone))
    assert rows_of(spark.table("changes")) == sorted(map(repr, want))


def test_late_sights_change_nothing(spark, tmp_path):
    at = lambda m: (START + timedelta(minutes=m)).isoformat()
    (tmp_path / "in").mkdir()
    for i, rows in enumerate(([("p", at(10), "a")], [("p", at(5), "b"), ("q", at(12), "a")], [("p", at(11), "a")])):
        import os

        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("title", "at", "digest"), r, strict=True))) for r in rows))
        os.utime(tmp_path / "in" / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema("title string, at timestamp, digest string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = changes.changes(stream, timedelta(hours=1)).writeStream.format("memory").queryName("late").trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert sorted((r["title"], r["change"]) for r in spark.table("late").collect()) == [("p", "new"), ("q", "new")]


def test_validated_reading(spark, tmp_path):
    lines = ['{"title": "a", "n": 1}', '{"title": "", "n": 2}', '{"title": "b", "n": "x"}', '{"title":', '{"n": -1}', '{"title": "c", "n": null, "more": 1}', '{"title": "d", "n": 5}']
    (tmp_path / "rows.json").write_text("\n".join(lines))
    rules = {"title": F.col("title") != "", "n": F.col("n").isNull() | (F.col("n") > 0)}
    good, bad = files.validated(spark, str(tmp_path / "rows.json"), "title string, n long", rules)
    assert sorted(map(tuple, good.collect()), key=repr) == [("a", 1), ("c", None), ("d", 5)]
    got = {(r["record"] or r["n"]): r["errors"] for r in bad.collect()}
    assert got == {2: ["title"], '{"title": "b", "n": "x"}': ["schema"], '{"title":': ["schema"], -1: ["title", "n"]}
    assert good.count() + bad.count() == len(lines)
    with pytest.raises(Exception, match="bad row"):
        files.validated(spark, str(tmp_path / "rows.json"), "title string, n long", rules, "fail").collect()
    (tmp_path / "good.json").write_text('[{"title": "a", "n": 1}, {"title": "b"}]')
    assert files.validated(spark, str(tmp_path / "good.json"), "title string, n long", rules, "fail", lines=False).count() == 2
    with pytest.raises(ValueError, match="neither"):
        files.validated(spark, str(tmp_path / "good.json"), "title string", {}, "skip")


def test_walk_equals_a_plain_one(spark):
    rng = random.Random(5)
    links = [(f"n{a}", p, f"n{rng.randint(0, 60)}") for a in range(50) for p in range(rng.randint(0, 3))] + [("n1", 9, None), (None, 0, "n2")]
    links += [(f"c{i}", 0, f"c{i + 1}") for i in range(12)]  # a chain of listing pages
    starts = ["n0", "n7", "c0", "lone", "n0"]
    order, queue = {}, []
    for s in starts:
        if s not in order:
            order[s] = 0
            queue.append(s)
    level, rounds = list(queue), [list(queue)]
    while level:
        new = []
        for a in level:
            for _, d in sorted((p, d) for s, p, d in links if s == a and d):
                if d not in order:
                    order[d] = len(rounds)
                    new.append(d)
        rounds.append(new)
        level = new
    df = spark.createDataFrame(links, "src string, pos int, dst string").repartition(3)
    got = crawl.walk(df, spark.createDataFrame(list(zip(starts, range(5), strict=True)), "node string, pos int"))
    seen = {}
    for r in sorted(got.collect(), key=lambda r: (r["round"], r["place"])):
        seen.setdefault(r["round"], []).append(r["node"])
    assert [seen[k] for k in sorted(seen)] == [x for x in rounds if x]
    assert crawl.walk(df, spark.createDataFrame([], "node string, pos int")).count() == 0
