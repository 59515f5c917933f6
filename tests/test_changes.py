"""Patches, XML, schemas, arguments, saves and pages in small cases."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.functions.process import Args, user_function
from sparkloom.operators import graph as G
from sparkloom.operators import kv as KV
from sparkloom.operators import vector as V
from sparkloom.operators.model import Model, Models
from sparkloom.plans.run import decode
from sparkloom.sources.catalog import Catalog


def test_patches():
    pick = random.Random(3)
    for _ in range(200):
        a, b = ("".join(pick.choice(["a\n", "b\n", "\n", "c"]) for _ in range(pick.randrange(12))) for _ in range(2))
        said, done = X.apply_patch(a, X.make_patch(a, b))
        assert said == b and all(done), (a, b)
    patch = X.make_patch("a\nb\nc\n", "a\nB\nc\n")
    assert X.apply_patch("new\nnew\na\nb\nc\n", patch) == ("new\nnew\na\nB\nc\n", [True])
    assert X.apply_patch("x\ny\n", patch) == ("x\ny\n", [False])


def test_xml():
    assert X.xml_encode({"a": 1, "b": "<x>"}) == "<xml>\n    <a>1</a>\n    <b>&lt;x&gt;</b>\n</xml>"
    assert X.xml_decode(X.xml_encode({"a": 1, "b": "<x>"})) == {"xml": {"a": "1", "b": "<x>"}}
    assert X.xml_decode('<r n="2"><i>a</i><i>b</i><i>c</i></r>') == {"r": {"-n": "2", "i": ["a", "b", "c"]}}
    with pytest.raises(ValueError, match="document types"):
        X.xml_decode("<!DOCTYPE a><a/>")


@pytest.mark.parametrize(
    ("value", "schema", "ok"),
    [
        (1, {"type": "integer"}, True), (1.0, {"type": "integer"}, True), (True, {"type": "integer"}, False), ("a", {"enum": ["a", 1]}, True), (True, {"enum": [1]}, False), ([1, 1], {"uniqueItems": True}, False), ([1, "a"], {"items": {"type": "number"}}, False),
        ({"a": 1}, {"additionalProperties": False, "properties": {"a": {}}}, True), ({"b": 1}, {"additionalProperties": False}, False), ({}, {"required": ["a"]}, False), ("abc", {"pattern": "^b"}, False), ("abc", {"minLength": 3, "maxLength": 3}, True), (5, {"oneOf": [{"minimum": 1}, {"maximum": 9}]}, False),
        (5, {"not": {"type": "string"}}, True), (None, {"type": ["null", "string"]}, True), (3, {"anyOf": [{"const": 3}, False]}, True),
    ],
)
def test_schemas(value, schema, ok):
    assert (not X.schema_errors(value, schema)) == ok


def test_arguments(spark):
    a = Args("3", None, "true", '{"k": 1}', [1, 2], "select=a&limit=2", "x")
    assert (a.integer(0), a.string(1, "d"), a.boolean(2), a.mapping(3), a.array(4), a.strings(4), a.query(5)) == (3, "d", True, {"k": 1}, [1, 2], ["1", "2"], {"select": ["a"], "limit": 2})
    assert a.integer(6, 7) == 7 and a.integer(99, 1) == 1
    with pytest.raises(ValueError, match="argument 7"):
        a.integer(6)
    with pytest.raises(ValueError, match="records"):
        a.records(4)
    user_function(spark, "twice_of", lambda s: s * 2, "long")
    assert spark.sql("SELECT twice_of(id) AS x FROM range(3)").agg(F.sum("x")).first()[0] == 6


def test_save_with_time_stamps(spark):
    rows = "id int, name string, created_at timestamp, updated_at timestamp, deleted_at timestamp"
    c = Catalog(spark).register("t", spark.sql("SELECT 1 AS id, 'a' AS name, timestamp'2020-01-01' AS created_at, cast(null as timestamp) AS updated_at, cast(null as timestamp) AS deleted_at"))
    m = Models(c, Model("t", "t", {}, timestamps=True))
    out = {r.id: r for r in m.save("t", spark.createDataFrame([(1, "b", None, None, None), (2, "c", None, None, None), (None, "d", None, None, None)], rows)).collect()}
    assert out[1].name == "b" and out[1].created_at.year == 2020 and out[1].updated_at is not None
    assert out[2].created_at is not None and out[2].updated_at is None and out[None].name == "d"
    assert m.save("t", spark.createDataFrame([], "name string")).count() == 1


def test_pages(spark):
    df = spark.range(25)
    p = V.page_of(df, ["id"], 3, 10)
    assert (p.total, p.pages, p.has_next, p.next_page, p.previous_page, [r.id for r in p.items.collect()]) == (25, 3, False, None, 2, list(range(20, 25)))
    assert V.page_of(df, ["id"], 1, 0, total=False).has_next and not V.page_of(df, ["id"], 3, 10, total=False).has_next
    seen, at = [], None
    while True:
        p = V.cursor_page(df, 10, at)
        seen += [r.id for r in p.items.collect()]
        if (at := p.next_cursor) is None:
            break
    assert seen == list(range(25))
    seen, at = [], None
    while True:
        p = V.scroll_page(df, 10, at, key="id")
        seen += [r.id for r in p.items.collect()]
        if (at := p.next_cursor) is None:
            break
    assert seen == list(range(25))
    assert V.scroll_page(df.limit(0), 10, key="id").next_cursor is None


def test_errors(spark):
    df = spark.createDataFrame([(1, [1, 2], "{")], "k int, v array<int>, j string")
    with pytest.raises(Exception, match="out of range"):
        df.select(KV.array_get(F.col("v"), 2)).collect()
    with pytest.raises(Exception, match="no JSON"):
        decode(df, {"j": "map<string,int>"}).collect()
    with pytest.raises(ValueError):
        V.hybrid(df)
    nodes, edges = spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("a", "b")], "src string, dst string")
    with pytest.raises(ValueError, match="edges"):
        G.delete_nodes(nodes, edges, F.col("id") == "a", detach=False)
    left = G.delete_nodes(nodes, edges, F.col("id") == "a")
    assert [r.id for r in left[0].collect()] == ["b"] and left[1].count() == 0


def test_collections(spark, tmp_path):
    from sparkloom.sources.collections import Collections

    c = Collections(spark, f"{tmp_path}/all")
    assert c.list() == []
    c.create("one", spark.range(5), {"lang": "en", "n": 1})
    c.create("two", spark.range(3))
    assert c.list() == ["one", "two"] and c.list({"lang": "en"}) == ["one"] and c.list({"n": True}) == [] and c.list({"x": 1}) == []
    with pytest.raises(ValueError, match="is there"):
        c.create("one", spark.range(1))
    with pytest.raises(ValueError, match="no name"):
        c.exists("../x")
    c.replace("one", c.rows("one").filter("id > 1"))
    c.update_metadata("one", {"lang": "dé"})
    assert c.describe("one") == {"name": "one", "metadata": {"lang": "dé", "n": 1}, "count": 3, "columns": {"id": "bigint"}}
    c.backup("one", f"{tmp_path}/copy")
    assert c.drop("one") and not c.drop("one") and not c.exists("one")
    with pytest.raises(KeyError):
        c.rows("one")
    c.restore("one", f"{tmp_path}/copy")
    assert c.rows("one").count() == 3


def test_stream_over_several_batches(spark, tmp_path):
    from sparkloom.streaming.tables import batches, current, upsert_kv

    for i in range(5):
        spark.sql(f"SELECT concat('k', id % {i + 2}) AS key, 'v{i}' AS value, cast(id + {i} * 100 as bigint) AS updated_at FROM range(10)").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("key string, value string, updated_at long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    upsert_kv(stream, f"{tmp_path}/kv", f"{tmp_path}/state", compact=3).awaitTermination()
    assert [k for _, k in batches(spark, f"{tmp_path}/kv")] == ["delta", "delta", "full", "delta", "delta"]
    got = {r.key: (r.value, r.updated_at) for r in current(spark, f"{tmp_path}/kv").collect()}
    want = {}
    for i in range(5):
        for n in range(10):
            want[f"k{n % (i + 2)}"] = (f"v{i}", n + i * 100)
    assert got == want
