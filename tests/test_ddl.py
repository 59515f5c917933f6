"""Changes of tables: what they keep, what they refuse, what reaches the scan."""

import pytest

from sparkloom.functions.process import Processes
from sparkloom.sources.ddl import Invalid, Schema, migrate, processes

USER = {
    "columns": [{"name": "id", "type": "ID"}, {"name": "name", "type": "string", "length": 10, "nullable": False}, {"name": "mobile", "type": "string", "unique": True}, {"name": "n", "type": "integer"}],
    "indexes": [{"name": "both", "type": "index", "columns": ["name", "mobile"]}],
    "option": {"timestamps": True},
}


@pytest.fixture
def schema(spark, tmp_path):
    s = Schema(spark, f"db_{tmp_path.name}", str(tmp_path))
    s.create()
    yield s
    s.drop()


def rows(schema, *columns, table="user"):
    return sorted(map(tuple, schema.scan(table).select(*columns).collect()), key=str)


@pytest.fixture
def user(schema, spark):
    schema.table_create("user", USER)
    schema.insert("user", spark.createDataFrame([("a", "1", 1), ("b", "2", None)], "name string, mobile string, n int"))
    return schema


def test_processes(spark, schema):
    found = Processes()
    found.register_group("schemas.default", processes(schema))
    run = found.run
    run("schemas.default.TableSave", "user", USER)
    assert run("schemas.default.TableDiff", USER, USER) == []
    run("schemas.default.TableRename", "user", "user_re")
    assert run("schemas.default.TableExists", "user_re") and not run("schemas.default.TableExists", "user")
    assert run("schemas.default.Tables") == ["user_re"]
    run("schemas.default.ColumnAdd", "user_re", {"name": "new_column", "type": "string"})
    run("schemas.default.ColumnAlt", "user_re", {"name": "new_column", "type": "string", "length": 20, "index": True})
    run("schemas.default.IndexAdd", "user_re", {"name": "new_index", "type": "index", "columns": ["mobile", "new_column"]})
    got = run("schemas.default.TableGet", "user_re")
    assert [c["name"] for c in got["columns"]] == ["id", "name", "mobile", "n", "created_at", "updated_at", "new_column"]
    assert [i["name"] for i in got["indexes"]] == ["both", "new_index"] and got["columns"][-1]["length"] == 20
    run("schemas.default.IndexDel", "user_re", "new_index")
    run("schemas.default.ColumnDel", "user_re", "new_column")
    run("schemas.default.TableDrop", "user_re")
    run("schemas.default.TableDrop", "user_re")
    assert run("schemas.default.Tables") == []


def test_numbers_and_defaults(user, spark):
    ids = [r[0] for r in rows(user, "id")]
    assert len(set(ids)) == 2 and min(ids) > 0
    user.column_add("user", {"name": "g", "type": "string", "default": "it's \\ ${x}"})
    user.insert("user", spark.createDataFrame([("c", "3")], "name string, mobile string"))
    user.insert("user", spark.createDataFrame([("d", None)], "name string, g string"))
    assert rows(user, "name", "g") == [("a", "it's \\ ${x}"), ("b", "it's \\ ${x}"), ("c", "it's \\ ${x}"), ("d", None)]
    assert len({r[0] for r in rows(user, "id")}) == 4


def test_dropped_values_do_not_come_back(user):
    user.column_del("user", "n")
    user.column_add("user", {"name": "n", "type": "double"})
    assert rows(user, "name", "n") == [("a", None), ("b", None)]
    user.column_del("user", "mobile")
    assert user.table_get("user")["indexes"] == []


def test_types_one_after_the_other(user, spark):
    user.column_alt("user", {"name": "n", "type": "double"})
    user.insert("user", spark.createDataFrame([("c", 2.5)], "name string, n double"))
    user.column_alt("user", {"name": "n", "type": "string", "length": 5})
    user.insert("user", spark.createDataFrame([("d", "many"), ("e", None)], "name string, n string"))
    want = [("a", "1.0"), ("b", None), ("c", "2.5"), ("d", "many"), ("e", None)]
    assert rows(user, "name", "n") == want
    with pytest.raises(Invalid) as e:
        user.column_alt("user", {"name": "n", "type": "integer"})
    assert e.value.found[("n", "type")] >= 1
    user.compact("user")
    assert rows(user, "name", "n") == want and user.table_get("user")["columns"][3]["type"] == "string"
    assert [f.name for f in spark.table(user.full("user")).schema] == ["id", "name", "mobile", "n", "created_at", "updated_at"]


@pytest.mark.parametrize("row,found", [((None, "9"), ("name", "null")), (("x" * 11, "9"), ("name", "length")), (("x", "1"), ("mobile", "unique"))])
def test_inserts_that_break_rules(user, spark, row, found):
    before = rows(user, "name", "mobile")
    with pytest.raises(Invalid) as e:
        user.insert("user", spark.createDataFrame([row, ("fine", "7")], "name string, mobile string"))
    assert e.value.found == {found: 1} and rows(user, "name", "mobile") == before


def test_changes_that_rows_break(user, spark):
    for column, rule in (({"name": "n", "type": "integer", "nullable": False}, ("n", "null")), ({"name": "name", "type": "enum", "option": ["a"]}, ("name", "option"))):
        with pytest.raises(Invalid) as e:
            user.column_alt("user", column)
        assert rule in e.value.found
    with pytest.raises(Invalid):
        user.column_add("user", {"name": "must", "type": "integer", "nullable": False})
    user.insert("user", spark.createDataFrame([("a", "5")], "name string, mobile string"))
    with pytest.raises(Invalid):
        user.index_add("user", {"name": "u", "type": "unique", "columns": ["name"]})
    assert [c["type"] for c in user.table_get("user")["columns"]][:4] == ["ID", "string", "string", "integer"]


def test_errors(user):
    for wrong in (lambda: user.column_add("user", {"name": "N", "type": "text"}), lambda: user.column_rename("user", "n", "NAME"), lambda: user.table_create("user", USER), lambda: user.column_del("user", "id", "name", "mobile", "n", "created_at", "updated_at"), lambda: user.index_add("user", {"name": "both", "columns": ["n"]})):
        with pytest.raises(ValueError):
            wrong()
    for wrong in (lambda: user.column_del("user", "none"), lambda: user.scan("none"), lambda: user.column_rename("user", "none", "x")):
        with pytest.raises(KeyError):
            wrong()


def test_filters_reach_the_scan(user):
    user.column_rename("user", "name", "title")
    plan = user.scan("user").where("title = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(name,a)" in plan and "ReadSchema: struct<id:bigint,name:string" in plan


def test_migrate(schema, spark):
    model = {"table": {"name": "pet"}, **USER, "values": [{"name": "Tommy", "mobile": "1"}, {"name": "Lucy", "n": 4}]}
    migrate(schema, model)
    assert rows(schema, "name", "mobile", "n", table="pet") == [("Lucy", None, 4), ("Tommy", "1", None)]
    schema.insert("pet", spark.createDataFrame([("Rex", 5)], "name string, n int"))
    new = {**model, "columns": [*USER["columns"][:3], {"name": "kind", "type": "string", "default": "dog"}], "indexes": []}
    changes = migrate(schema, new)
    assert changes == [("add", "column", "kind"), ("del", "column", "n"), ("del", "index", "both")]
    assert rows(schema, "name", "kind", table="pet") == [("Lucy", "dog"), ("Rex", "dog"), ("Tommy", "dog")]
    assert migrate(schema, new) == []
    migrate(schema, new, force=True)
    assert rows(schema, "name", "kind", table="pet") == [("Lucy", "dog"), ("Tommy", "dog")]
    migrate(schema, new, force=True, values=False)
    assert rows(schema, "name", table="pet") == []
