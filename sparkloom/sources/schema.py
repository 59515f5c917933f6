"""Declared column types and schema differences."""

from __future__ import annotations

from pyspark.sql import types as T

#: Declared types and Spark's.
TYPES = {
    "string": "string", "char": "string", "text": "string", "mediumText": "string", "longText": "string", "binary": "binary", "date": "date", "datetime": "timestamp_ntz", "datetimeTz": "timestamp_ntz", "time": "string", "timeTz": "string", "timestamp": "timestamp", "timestampTz": "timestamp",
    "tinyInteger": "tinyint", "unsignedTinyInteger": "smallint", "tinyIncrements": "smallint", "smallInteger": "smallint", "unsignedSmallInteger": "int", "smallIncrements": "int", "integer": "int", "unsignedInteger": "bigint", "increments": "bigint", "bigInteger": "bigint", "unsignedBigInteger": "decimal(20,0)", "bigIncrements": "bigint", "id": "bigint", "ID": "bigint",
    "float": "float", "unsignedFloat": "float", "double": "double", "unsignedDouble": "double", "boolean": "boolean", "enum": "string", "json": "string", "jsonb": "string", "JSON": "string", "JSONB": "string", "uuid": "string", "ipAddress": "string", "macAddress": "string", "year": "int",
}


def spark_type(column: dict) -> str:
    kind = column["type"]
    if kind in ("decimal", "unsignedDecimal"):
        return f"decimal({column.get('precision', 10)},{column.get('scale', 2)})"
    if kind not in TYPES:
        raise ValueError(f"unknown column type {kind!r}")
    return TYPES[kind]


def columns_of(model: dict) -> list[dict]:
    """Declared columns and those that options add."""
    option, out = model.get("option") or {}, list(model["columns"])
    if option.get("timestamps"):
        out += [{"name": "created_at", "type": "timestamp", "nullable": True}, {"name": "updated_at", "type": "timestamp", "nullable": True}]
    if option.get("soft_deletes"):
        out.append({"name": "deleted_at", "type": "timestamp", "nullable": True})
    if option.get("permission"):
        out += [{"name": n, "type": "string", "nullable": True} for n in ("__created_by", "__updated_by", "__team_id", "__tenant_id")]
    return out


def struct(model: dict) -> T.StructType:
    return T.StructType([T.StructField(c["name"], T._parse_datatype_string(spark_type(c)), c.get("nullable", True), {"comment": c.get("comment", "")}) for c in columns_of(model)])


_SAME = ("type", "length", "precision", "scale", "option", "default", "nullable", "index", "unique", "primary")
_LEFT = ("created_at", "updated_at", "deleted_at")


def diff(old: dict, new: dict) -> list[tuple[str, str, str]]:
    """(action, kind, name) that make the old schema the new one: add, del, alt of columns and indexes."""
    out = []
    a, b = ({c["name"]: c for c in m["columns"] if c["name"] not in _LEFT} for m in (old, new))
    out += [("add", "column", n) for n in b if n not in a] + [("del", "column", n) for n in a if n not in b]
    for n in a.keys() & b.keys():
        if a[n]["type"] not in ("id", "ID", "json", "JSON") and any(a[n].get(k) != b[n].get(k) for k in _SAME):
            out.append(("alt", "column", n))
    a, b = ({i["name"]: i for i in m.get("indexes") or []} for m in (old, new))
    out += [("add", "index", n) for n in b if n not in a] + [("del", "index", n) for n in a if n not in b] + [("alt", "index", n) for n in a.keys() & b.keys() if a[n] != b[n]]
    return sorted(out)
