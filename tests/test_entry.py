"""The driver's contract."""

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_queries_agree_with_sql(spark):
    import duckdb

    from kvatlas.plans import catalogue

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    for name in ("tag_stats", "tag_contexts", "cooccur_top5", "apply_rules", "missing_tags", "rrf_hybrid", "resolve_names", "key_pages"):
        got = catalogue.QUERIES[name](spark, SMALL)
        names = sorted(got.columns)
        want = con.execute(f"select {', '.join(chr(34) + n + chr(34) for n in names)} from ({catalogue.SQL[name]})").fetchall()
        assert sorted(map(str, ((*r,) for r in got.select(*names).collect()))) == sorted(map(str, want)), name
