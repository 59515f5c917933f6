"""Expressions, documents, binding and the linter, without tables."""

import pytest

from sparkloom.functions import expr as E
from sparkloom.functions.process import Processes
from sparkloom.functions.text import chunk_sizes, markdown, repair_json, replace_blocks, strip_comments
from sparkloom.operators.model import url_param
from sparkloom.plans import lint
from sparkloom.plans.bind import bind
from sparkloom.plans.flow import waves
from sparkloom.sources.catalog import Engines
from sparkloom.sources.schema import diff, struct


@pytest.mark.parametrize("text", ["name", "t.name", "$user.name", "名称", "*", "t.*", "1", "-1", "12.5", "'a b'", "?:x", "doc$.a.b", "doc$", "arr[0]", "arr[0].k", "arr[*].k", "f*", ":fn(a,:g(b,'x,y'))", "x as y", "arr[0](decimal 11,2) as d"])
def test_round_trip(text):
    assert str(E.parse(str(E.parse(text)))) == str(E.parse(text))


def test_parts():
    assert E.parse("arr@").path == ("[*]",) and E.parse("arr@.k").path == ("[*]", "k")
    assert E.parse("f(string 50)").type == "string 50"
    assert E.parse(":COUNT(x) as n").aggregates and not E.parse(":UPPER(x)").aggregates
    assert E.sql(E.parse(":IFNULL(a, 'it\\'s')")) == "coalesce(`a`, 'it\\'s')"
    assert len(E.fold_key("a key of more than sixteen bytes")) == 16


@pytest.mark.parametrize("text", ["", "a b", "x as y as z", ":fn(", "f(thing 3)", "a..b"])
def test_errors(text):
    with pytest.raises(E.ExpressionError):
        E.parse(text)


def test_bind():
    data = {"n": 3, "s": "x", "l": [1], "m": {"k": 5}}
    assert bind("{{ n }}", data) == 3 and bind("?:l", data) == [1]
    assert bind("a {{ s }} b", data) == "a x b" and bind("a {{ n }} b", data) == 3
    assert bind("{{ s }}-{{ n }}", data) == "x-3" and bind("?:none", data) is None
    assert bind({"a": ["{{ m.k }}"]}, data) == {"a": [5]}


def test_conditions():
    assert lint.condition({":name": "comment", "=": 1}) == {"field": "name", "op": "=", "value": 1}
    assert lint.condition({"or :name": "c", "like": "x"})["or"] is True
    assert lint.condition({"field": "a", "value": 1})["op"] == "="
    with pytest.raises(E.ExpressionError):
        lint.condition({"field": "a", "=": 1, ">": 0})
    assert lint.orders("id desc , type") == [("id", True), ("type", False)]
    assert lint.groups("kind rollup all kinds, city")[0] == {"field": "kind", "rollup": "all kinds"}


@pytest.mark.parametrize(
    ("doc", "code"),
    [
        ({"from": "t"}, "E100"), ({"select": ["a b"], "from": "t"}, "E101"), ({"select": ["a"]}, "E110"), ({"select": ["a"], "from": "a-b"}, "E111"), ({"select": ["a"], "from": "t", "wheres": [{"=": 1}]}, "E120"), ({"select": ["a"], "from": "t", "wheres": [{"wheres": [{"field": "a", "op": "?"}]}]}, "E120"),
        ({"select": ["a"], "from": "t", "orders": [{"field": "a", "sort": "up"}]}, "E130"), ({"select": ["a"], "from": "t", "groups": ["b"]}, "E140"), ({"select": ["a"], "from": "t", "havings": [{"field": "a", "=": 1}]}, "E150"), ({"select": ["a"], "from": "t", "groups": ["a"], "havings": [{"field": "a", "in": [1]}]}, "E151"),
        ({"select": ["a"], "from": "t", "unions": [{"select": ["a"]}]}, "E160"), ({"select": ["a"], "from": "t", "joins": [{"from": "u", "foreign": "a"}]}, "E170"), ({"select": ["a"], "from": "t", "joins": [{"from": "u", "key": "a"}]}, "E171"), ({"select": ["a"], "from": "t", "joins": [{"key": "a", "foreign": "b"}]}, "E172"),
        ({"sql": {"args": []}}, "E180"), ({"select": ["a"], "query": {"select": ["a"]}}, "E190"), ({"select": ["a"], "from": "t", "wat": 1}, "E002"),
    ],
)
def test_lint(doc, code):
    assert code in {p.code for p in lint.lint(doc)}


def test_lint_places():
    assert lint.lint_text("{")[0].code == "E001"
    found = [p for p in lint.lint_text('{\n "select": ["a"],\n "from": "a-b"\n}') if p.code == "E111"]
    assert found[0].line == 3


def test_small_things():
    assert url_param("select=a,b&where.c.gt=1&order=d.desc&with=r&r.select=x&limit=3") == {"select": ["a", "b"], "wheres": [{"column": "c", "op": "gt", "value": "1", "method": "where"}], "orders": [{"column": "d", "option": "desc"}], "withs": {"r": {"select": ["x"]}}, "limit": 3}
    assert replace_blocks("a\nb", "<<<<<<< SEARCH\nb\n=======\nc\n>>>>>>> REPLACE") == "a\nc"
    with pytest.raises(ValueError, match="not found"):
        replace_blocks("a", "<<<<<<< SEARCH\nz\n=======\nc\n>>>>>>> REPLACE")
    assert strip_comments('{"a": "//x"} // y') == '{"a": "//x"} ' and repair_json("{a: 1,}") == {"a": 1} and repair_json('{"a": [1') == {"a": [1]}
    assert chunk_sizes(100, 3) == [600, 300, 100] and markdown("<h2>T</h2><p>a <b>b</b></p>") == "## T\n\na **b**"
    assert waves([(2, lambda: "b"), (1, lambda: "a")]) == ["a", "b"]
    e = Engines()
    e.register("Main", "x")
    e.alias("main", "Other")
    assert e.select("OTHER") == "x"
    p = Processes()
    p.register_group("models", {"Find": lambda name, k: (name, k)})
    assert p.run("models.user.pet.Find", 3) == ("user.pet", 3)
    assert diff({"columns": [{"name": "a", "type": "string"}]}, {"columns": [{"name": "a", "type": "text"}]}) == [("alt", "column", "a")]


def test_pages(spark):
    from sparkloom.plans.compile import Query
    from sparkloom.plans.run import first, get, paginate
    from sparkloom.sources.catalog import Catalog

    assert [f.name for f in struct({"columns": [{"name": "a", "type": "decimal"}], "option": {"soft_deletes": True}})] == ["a", "deleted_at"]
    c = Catalog(spark).register("t", spark.createDataFrame([(1, "Alice"), (2, "Bob"), (3, "Charlie")], "id int, name string"))
    doc = {"select": ["id", "name"], "from": "t", "orders": ["id"], "page": 1, "pagesize": 2}
    page = paginate(Query(c, doc))
    assert (page.total, page.pagecnt, page.next, page.prev, page.items.count()) == (3, 2, 2, -1, 2)
    last = paginate(Query(c, {**doc, "page": 2}))
    assert (last.next, last.prev, last.items.count()) == (-1, 1, 1)
    assert first(Query(c, doc)) == {"id": 1, "name": "Alice"} and get(Query(c, {"select": ["id"], "from": "t"})).count() == 3
    assert first(Query(c, {**doc, "wheres": [{"field": "id", ">": 9}]})) is None


def test_date_patterns_and_keys(spark):
    E.sql(E.parse(":DATE_FORMAT(a, '%Y')"))
    with pytest.raises(E.ExpressionError):
        E.sql(E.parse(":DATE_FORMAT(a, '%U')"))
    key = "schlüssel"
    df = spark.createDataFrame([("grüße",)], "a string").selectExpr(f"hex(aes_encrypt(a, X'{E.fold_key(key).encode('latin-1').hex()}', 'ECB', 'PKCS')) AS a")
    assert df.selectExpr(E.sql(E.parse("a*"), key=key)).first()[0] == "grüße"


def test_a_late_process_is_not_waited_for():
    import time

    found = Processes()
    found.register("slow.one", lambda: time.sleep(3))
    began = time.perf_counter()
    with pytest.raises(TimeoutError):
        found.run("slow.one", timeout=0.2)
    assert time.perf_counter() - began < 2
