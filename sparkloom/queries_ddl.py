"""Queries of table changes and migrations over copies of whole tables, with the same results in SQL."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from .queries_ops import _scratch
from .sources.ddl import Schema, migrate

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def add(key, run, sql):
    QUERIES[key] = run
    ORACLE_SQL[key] = sql


def _schema(s) -> Schema:
    """A database of its own in a folder of the run."""
    schema = Schema(s, f"sparkloom_{uuid.uuid4().hex}", _scratch(s))
    schema.create()
    return schema


def _given(s, d) -> Schema:
    """The given tables, where they are."""
    schema = _schema(s)
    for t in TABLES:
        s.sql(f"CREATE TABLE {schema.full(t)} USING parquet LOCATION '{d}/{t}.parquet'")
    return schema


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_IN = "table_name IN ('" + "','".join(TABLES) + "')"


def _rows(s, rows, schema):
    return s.createDataFrame(rows, schema)


def _tables(s, d):
    schema = _given(s, d)
    return _rows(s, [(t, len(schema.table_get(t)["columns"]), schema.table_exists(t)) for t in schema.tables()], "name string, n int, found boolean")


add("schema_tables", _tables, f"SELECT table_name AS name, CAST(count(*) AS INTEGER) AS n, true AS found FROM information_schema.columns WHERE {_IN} GROUP BY 1")
add("schema_tables_prefix", lambda s, d: _rows(s, [(t,) for t in _given(s, d).tables("p")], "name string"), f"SELECT DISTINCT table_name AS name FROM information_schema.columns WHERE {_IN} AND table_name LIKE 'p%'")


def _get(s, d):
    schema = _given(s, d)
    return _rows(s, [(t, c["name"], c["type"]) for t in schema.tables() for c in schema.table_get(t)["columns"]], "table string, name string, type string")


_TYPE = "CASE data_type WHEN 'BIGINT' THEN 'bigInteger' WHEN 'INTEGER' THEN 'integer' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'text' WHEN 'TIMESTAMP' THEN 'datetime' ELSE 'json' END"
add("schema_get", _get, f"SELECT table_name AS \"table\", column_name AS name, {_TYPE} AS type FROM information_schema.columns WHERE {_IN}")


def _diff(s, d):
    """What would make each given table the next one, their columns' prefixes taken off."""
    schema, out = _given(s, d), []

    def bare(t):
        got = schema.table_get(t)
        return {"columns": [{**c, "name": re.sub("^[a-z]{1,2}_", "", c["name"])} for c in got["columns"]]}

    for one, other in zip(TABLES[:-1], TABLES[1:], strict=True):
        out += [(one, other, *c) for c in schema.table_diff(bare(one), bare(other))]
    return _rows(s, out, "one string, other string, action string, kind string, name string")


_PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in zip(TABLES[:-1], TABLES[1:], strict=True))
_BARE = f"(SELECT table_name AS t, regexp_replace(column_name, '^[a-z]{{1,2}}_', '') AS name, {_TYPE} AS type FROM information_schema.columns WHERE {_IN})"
add("schema_diff", _diff, f"""WITH c AS (SELECT * FROM {_BARE}), p(one, other) AS (VALUES {_PAIRS})
SELECT p.one, p.other, 'column' AS kind, coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'add' WHEN b.name IS NULL THEN 'del' ELSE 'alt' END AS action
FROM p JOIN (SELECT p.one AS o, c.* FROM p JOIN c ON c.t = p.one) a ON a.o = p.one FULL JOIN (SELECT p.one AS o, c.* FROM p JOIN c ON c.t = p.other) b ON b.o = a.o AND b.name = a.name
WHERE a.name IS NOT NULL AND (b.name IS NULL OR a.type <> b.type AND a.type <> 'json')
UNION ALL SELECT p.one, p.other, 'column', c.name, 'add' FROM p JOIN c ON c.t = p.other WHERE NOT EXISTS (SELECT 1 FROM c AS x WHERE x.t = p.one AND x.name = c.name)""")  # fmt: skip

ORDER = {
    "columns": [{"name": "o_orderkey", "type": "bigInteger", "primary": True, "nullable": False}, {"name": "o_custkey", "type": "bigInteger", "nullable": False}, {"name": "o_orderstatus", "type": "enum", "option": ["F", "O", "P"]}, {"name": "o_totalprice", "type": "decimal", "precision": 14, "scale": 2}, {"name": "o_orderpriority", "type": "string", "length": 20}],
    "option": {"soft_deletes": True},
}


def _create(s, d):
    schema = _schema(s)
    schema.table_create("orders", ORDER)
    schema.insert("orders", s.read.parquet(f"{d}/orders.parquet").drop("o_orderdate"))
    return schema.scan("orders").withColumn("o_totalprice", F.col("o_totalprice").cast("double")).withColumn("deleted_at", F.col("deleted_at").isNull())


add("ddl_create", _create, "SELECT o_orderkey, o_custkey, o_orderstatus, CAST(CAST(o_totalprice AS DECIMAL(14, 2)) AS DOUBLE) AS o_totalprice, o_orderpriority, true AS deleted_at FROM orders")


def _copy(s, d, name):
    """A table made of a given one's columns and rows."""
    df, schema = s.read.parquet(f"{d}/{name}.parquet"), _given(s, d)
    schema.table_create("copy", schema.table_get(name))
    schema.insert("copy", df, check=False)
    return schema, df


def _column_add(s, d):
    schema, df = _copy(s, d, "customer")
    schema.column_add("copy", {"name": "tier", "type": "string", "default": "old"})
    schema.insert("copy", df.withColumn("c_custkey", F.col("c_custkey") + 10**9).withColumn("tier", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment"))))
    schema.insert("copy", df.withColumn("c_custkey", F.col("c_custkey") + 2 * 10**9))
    return schema.scan("copy").select("c_custkey", "c_name", "tier")


add("ddl_column_add", _column_add, "SELECT c_custkey, c_name, 'old' AS tier FROM customer UNION ALL SELECT c_custkey + 1000000000, c_name, CASE WHEN c_acctbal > 0 THEN c_mktsegment END FROM customer UNION ALL SELECT c_custkey + 2000000000, c_name, 'old' FROM customer")


def _column_del(s, d):
    schema, df = _copy(s, d, "part")
    schema.column_del("copy", "p_size", "p_retailprice")
    schema.column_add("copy", {"name": "p_size", "type": "string"})
    schema.insert("copy", df.select((F.col("p_partkey") + 10**9).alias("p_partkey"), F.concat(F.lit("size "), F.col("p_size")).alias("p_size")))
    return schema.scan("copy")


add("ddl_column_del", _column_del, "SELECT p_partkey, p_name, p_brand, p_type, CAST(NULL AS VARCHAR) AS p_size FROM part UNION ALL SELECT p_partkey + 1000000000, NULL, NULL, NULL, concat('size ', p_size) FROM part")


def _rename(s, d):
    schema, df = _copy(s, d, "supplier")
    schema.column_rename("copy", "s_acctbal", "balance")
    schema.column_rename("copy", "s_name", "s_acctbal")
    schema.table_rename("copy", "firms")
    schema.insert("firms", df.select((F.col("s_suppkey") + 10**9).alias("s_suppkey"), F.col("s_acctbal").alias("balance")))
    return schema.scan("firms").where("balance > 1000").select("s_suppkey", "s_acctbal", "balance")


add("ddl_rename", _rename, "SELECT s_suppkey, s_name AS s_acctbal, s_acctbal AS balance FROM supplier WHERE s_acctbal > 1000 UNION ALL SELECT s_suppkey + 1000000000, NULL, s_acctbal FROM supplier WHERE s_acctbal > 1000")


def _alter(s, d):
    schema, df = _copy(s, d, "lineitem")
    schema.column_alt("copy", {"name": "l_quantity", "type": "integer"})
    schema.column_alt("copy", {"name": "l_linenumber", "type": "string", "length": 12})
    schema.column_alt("copy", {"name": "l_quantity", "type": "text"})
    schema.insert("copy", df.select((F.col("l_orderkey") + 10**9).alias("l_orderkey"), F.concat(F.lit("no. "), F.col("l_linenumber")).alias("l_linenumber"), F.lit("many").alias("l_quantity")))
    schema.compact("copy")
    return schema.scan("copy").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


add("ddl_column_alt", _alter, "SELECT l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS l_quantity, l_returnflag FROM lineitem UNION ALL SELECT l_orderkey + 1000000000, concat('no. ', l_linenumber), 'many', NULL FROM lineitem")

FIRST = {"table": {"name": "happened"}, "columns": [{"name": "event_id", "type": "ID", "primary": True}, {"name": "event_type", "type": "string", "length": 10}, {"name": "user_id", "type": "integer"}, {"name": "value", "type": "double"}], "values": [{"event_id": -1, "event_type": "none", "user_id": 0}]}
SECOND = {**FIRST, "columns": [FIRST["columns"][0], {"name": "event_type", "type": "enum", "option": ["click", "error", "purchase", "signup", "view", "none"]}, {"name": "user_id", "type": "bigInteger"}, {"name": "props", "type": "json", "default": "{}"}], "indexes": [{"name": "by_user", "columns": ["user_id"], "type": "index"}]}


def _migrate(s, d, force=False):
    schema, df = _schema(s), s.read.parquet(f"{d}/events.parquet")
    migrate(schema, FIRST)
    schema.insert("happened", df.select("event_id", "event_type", "user_id", "value"))
    migrate(schema, SECOND, force=force)
    schema.insert("happened", df.select((F.col("event_id") + 10**9).alias("event_id"), "event_type", (F.col("user_id") + 2**40).alias("user_id"), "props"))
    return schema.scan("happened")


_AFTER = "SELECT event_id + 1000000000 AS event_id, event_type, user_id + 1099511627776 AS user_id, props FROM events"
_VALUES = "SELECT -1 AS event_id, 'none' AS event_type, 0 AS user_id, '{}' AS props"
add("model_migrate", _migrate, f"{_AFTER} UNION ALL SELECT event_id, event_type, user_id, '{{}}' FROM events UNION ALL {_VALUES}")
add("model_migrate_force", lambda s, d: _migrate(s, d, True), f"{_AFTER} UNION ALL {_VALUES}")
