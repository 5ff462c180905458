import json
from datetime import datetime, timezone

from pyspark.sql import functions as F

from quireflow.functions import text as T
from quireflow.operators import instants, nested


def us(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp() * 1e6)


def read_times(spark, rows):
    d = spark.createDataFrame(rows, "id long, raw string, writer string, home string, midnight boolean")
    got = instants.normalise_instants(d, ["id"], "raw", "writer", "home", day_is_midnight="midnight").collect()
    return {r.id: (r.status, r.instant_us) for r in got}


def test_instants(spark):
    cases = [
        ("D:20190807234913+02'00'", None, False, ("exact", us(2019, 8, 7, 21, 49, 13))),
        ("D:20240420202843", "Europe/Berlin", False, ("exact", us(2024, 4, 20, 18, 28, 43))),
        ("D:20240420202843", None, False, ("no_zone", None)),
        ("2021-10-31 01:50:05 Europe/London", None, False, ("twice", None)),
        ("2017-03-12 02:02:00", "America/New_York", False, ("never", None)),
        ("2023-02-30T10:00:00Z", None, False, ("not_a_date", None)),
        ("29/05/2013 12:07", "UTC", False, ("exact", us(2013, 5, 29, 12, 7))),
        ("05/05/2013 12:07", "UTC", False, ("exact", us(2013, 5, 5, 12, 7))),
        ("04/05/2013 12:07", "UTC", False, ("ambiguous", None)),
        ("13.04.2013 22:04:16", "Asia/Tokyo", False, ("exact", us(2013, 4, 13, 13, 4, 16))),
        ("12/19/2024 12:48:08 AM", "UTC", False, ("exact", us(2024, 12, 19, 0, 48, 8))),
        ("Mon, 03 Feb 2025 16:59:22 +0900", None, False, ("exact", us(2025, 2, 3, 7, 59, 22))),
        ("Tue, 03 Feb 2025 16:59:22 +0900", None, False, ("not_a_date", None)),
        ("30. März 2025, 12:46 Uhr", "Europe/Paris", False, ("exact", us(2025, 3, 30, 10, 46))),
        ("170208050843Z", "UTC", True, ("exact", us(2017, 2, 8, 5, 8, 43))),
        ("520208050843Z", "UTC", True, ("exact", us(1952, 2, 8, 5, 8, 43))),
        ("Apr  4 17:23:08 1998 GMT", "UTC", True, ("exact", us(1998, 4, 4, 17, 23, 8))),
        ("2016-07-02", "UTC", True, ("exact", us(2016, 7, 2))),
        ("2016-07-02", "UTC", False, ("no_time", None)),
        ("1747378473", None, False, ("exact", 1747378473000000)),
        ("2018-05-28T14:09:14,263Z", None, False, ("exact", us(2018, 5, 28, 14, 9, 14) + 263000)),
        (None, "UTC", True, ("not_a_date", None)),
        ("", "UTC", True, ("not_a_date", None)),
        ("x" * 5000, "UTC", True, ("not_a_date", None)),
    ]
    got = read_times(spark, [(i, c[0], "w", c[1], c[2]) for i, c in enumerate(cases)])
    assert [got[i] for i in range(len(cases))] == [c[3] for c in cases]


def test_mixture_chooses_by_source(spark):
    rows = [(i, f"{d}/05/2013 10:00", "dmy", "UTC", False) for i, d in enumerate(range(13, 29))] + [(99, "04/05/2013 10:00", "dmy", "UTC", False)]
    d = spark.createDataFrame(rows, "id long, raw string, writer string, home string, midnight boolean")
    r = instants.normalise_instants(d, ["id"], "raw", "writer", "home", day_is_midnight="midnight").where("id = 99").collect()[0]
    assert r.status == "ambiguous" and r.likely_us == us(2013, 5, 4, 10) and r.likely_posterior > 0.9


def test_empty_instants(spark):
    assert read_times(spark, []) == {}


def test_outlines(spark):
    deep = "[" * 3000 + "]" * 3000
    bodies = [
        ('[{"title":"a","children":[{"title":null},{"title":"","children":null}]},{"title":"b"}]', [(1, 0), (2, 1), (3, 1), (4, 0)]),
        ('{"bookmarks":{"0":{"title":"a","children":{"0":{"title":"c"}}},"1":{"title":"b"}}}', [(1, 0), (2, 1), (3, 0)]),
        ('{"title":"a","children":{"title":"b"},"style":{"title":"bold","children":2}}', [(1, 0), (2, 1)]),
        ('[{"title":"a","children":"[{\\"title\\":\\"b\\"}]"}]', [(1, 0), (2, 1)]),
        ('[{"title":"a"', []), ("", []), (None, []), ("no outline", []), ("null", []), ("[NaN]", []), (deep, []),
    ]
    d = spark.createDataFrame([(i, b, "clash") for i, (b, _) in enumerate(bodies)] + [(0, bodies[0][0], "again")], "k long, body string, node string")
    got = {}
    for r in nested.flatten_outlines(d, "k", "body").collect():
        got.setdefault(r.k, []).append((r.node, r.parent))
    assert {k: sorted(v) for k, v in got.items()} == {i: w for i, (_, w) in enumerate(bodies) if w}


def test_deep_parser_agrees():
    for t in ('{"a": [1, -2.5e3, "x\\u00e9", {"b": null}], "c": {}, "d": []}', "[]", "{}", ' [ true , false ] ', '"s"', "3"):
        assert nested._parse_deep(t) == json.loads(t)
    for t in ("[1,]", "{", "[1 2]", '{"a" 1}', "[]]", "", "tru"):
        try:
            nested._parse_deep(t)
        except ValueError:
            continue
        raise AssertionError(t)
    depth = 200_000
    assert nested.parse_json("[" * depth + "]" * depth)[0]


def test_dewey(spark):
    d = spark.createDataFrame([(1, '{"a":[{"b":1},{"b":2}]}')], "k long, body string")
    rows = {(r.schema_path, tuple(r.path)): (r.value, r.parent_path) for r in nested.flatten_json(d, "k", "body").collect()}
    assert rows[("$.a[].b", (1, 2, 1))] == ("2", [1, 2]) and rows[("$", ())][1] is None


def test_tables(spark):
    d = spark.createDataFrame([(1, '{"a":[{"b":1,"c":[{"x":null},{"x":"y"}]},{"b":2}],"n":{"z":true},"s":[3,[4]]}'), (1, "{}"), (2, "[]"), (3, '{"a'), (4, None), (5, "7")], "k long, body string").limit(6)
    one = nested.flatten_tables(d.where("body like '%z%' or k > 1"), "k", "body").collect()
    rows = {(r.k, tuple(r.label)): (r.table_name, None if r.parent_label is None else tuple(r.parent_label), r.fields) for r in one}
    assert rows == {
        (1, ()): ("$", None, {}), (1, (1,)): ("$.a[]", (), {"b": "1"}), (1, (1, 1)): ("$.a[].c[]", (1,), {"x": None}), (1, (1, 2)): ("$.a[].c[]", (1,), {"x": "y"}), (1, (2,)): ("$.a[]", (), {"b": "2"}),
        (1, (3,)): ("$.n", (), {"z": "true"}), (1, (4,)): ("$.s[]", (), {"value": "3"}), (1, (5,)): ("$.s[][]", (), {"value": "4"}), (5, ()): ("$", None, {"value": "7"}),
    }
    long = "9" * 6000
    assert [x[1]["page"] for x in nested.bookmark_nodes('[{"title":"a","page":' + long + "}]")] == [long]
    assert nested.parse_json("[" * 5000 + long + "]" * 5000)[0]


def test_functions(spark):
    d = spark.createDataFrame([("CN=A B,OU=x", 1536, "fox foxes unfox fox.", "a & <b>")], "s string, n long, t string, x string")
    r = d.select(T.common_name(F.col("s")).alias("cn"), T.human_size(F.col("n")).alias("size"), F.regexp_count("t", F.lit(T.whole_word("fox"))).alias("whole"), T.xml_escaped(F.col("x")).alias("x"), T.truncated(F.col("t"), 3).alias("cut")).collect()[0]
    assert (r.cn, r.size, r.whole, r.x, r.cut) == ("A B", "1.5 KB", 2, "a &amp; &lt;b&gt;", "fox…")


def test_streaming(spark, tmp_path):
    from quireflow.streaming.versions import newest_only

    spark.createDataFrame([("k", 1, 1), ("k", 3, 2), ("k", 2, 3), ("k", 3, 4), ("j", 1, 5)], "key string, gen long, item long").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("key string, gen long, item long").parquet(str(tmp_path / "in"))
    q = newest_only(s, "key", "gen", "item").writeStream.format("memory").queryName("newest").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.item for r in spark.table("newest").collect()) == [1, 2, 4, 5]
