"""Tables whose columns can be added, dropped, renamed and altered, and migration of models.

The session catalog adds columns to Parquet tables and renames tables, but drops,
renames and retypes no column. So a table's properties hold its declared schema with
a mapping from each declared column to the stored columns that hold its values, and
`Schema.scan` applies it: all changes touch metadata alone, no row is rewritten.

* A dropped column is taken out of the mapping; one added later under its name gets a
  stored column of its own, so old values do not come back.
* A new column's default is the stored column's existing default, which the scan gives
  to rows that were written before it.
* A column of another type gets a new stored column; rows written before have null there
  and their old value, cast, counts. Inserts write the newest stored column alone.

Filters on renamed columns reach the Parquet scan, as the mapping is a projection.
"""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import TYPES, columns_of, diff, spark_type

_KEY, _PIECE = "sparkloom.schema", 3000
_TEXT = ("string", "char")
#: What a type of Spark's is declared as where nothing was declared.
_DECLARED = {"bigint": "bigInteger", "int": "integer", "smallint": "smallInteger", "tinyint": "tinyInteger", "string": "text", "timestamp": "timestamp", "timestamp_ntz": "datetime", "date": "date", "double": "double", "float": "float", "boolean": "boolean", "binary": "binary"}


class Invalid(ValueError):
    """Rows that break what a table declares; `found` has the number of rows by (column, rule)."""

    def __init__(self, table: str, found: dict):
        super().__init__(f"{table}: " + ", ".join(f"{c} {rule}: {n}" for (c, rule), n in sorted(found.items())))
        self.found = found


def _name(name: str) -> str:
    if not name or "`" in name:
        raise ValueError(f"no name: {name!r}")
    return f"`{name}`"


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (bool, int, float)):
        return str(value).upper() if isinstance(value, bool) else str(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'").replace("$", "\\u0024") + "'"


class Schema:
    """The tables of one database. Declared tables are dicts {columns, indexes, option, ...}, as in `schema.columns_of`."""

    def __init__(self, spark: SparkSession, database: str, location: str | None = None):
        self.spark, self.database, self.location = spark, database, location

    # ---- databases and tables ----
    def create(self) -> None:
        at = f" LOCATION {_literal(self.location)}" if self.location else ""
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {_name(self.database)}{at}")

    def drop(self) -> None:
        self.spark.sql(f"DROP DATABASE IF EXISTS {_name(self.database)} CASCADE")

    def full(self, table: str) -> str:
        return f"{_name(self.database)}.{_name(table)}"

    def tables(self, prefix: str = "") -> list[str]:
        rows = self.spark.sql(f"SHOW TABLES IN {_name(self.database)}").where("not isTemporary").collect()
        return sorted(r.tableName for r in rows if r.tableName.startswith(prefix))

    def table_exists(self, table: str) -> bool:
        return self.spark.catalog.tableExists(self.full(table))

    def table_create(self, table: str, declared: dict) -> None:
        if self.table_exists(table):
            raise ValueError(f"table {table} is there")
        columns = [{**c, "stored": [c["name"]]} for c in columns_of(declared)]
        if not columns:
            raise ValueError(f"table {table} has no columns")
        if len({c["name"].lower() for c in columns}) < len(columns):
            raise ValueError(f"table {table} names a column twice")
        self.spark.sql(f"CREATE TABLE {self.full(table)} ({', '.join(f'{_name(c["name"])} {spark_type(c)}' for c in columns)}) USING parquet")
        self._keep(table, {"columns": columns, "indexes": declared.get("indexes") or [], "option": declared.get("option") or {}})

    def table_drop(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.full(table)}")

    def table_rename(self, table: str, new: str) -> None:
        self.spark.sql(f"ALTER TABLE {self.full(table)} RENAME TO {self.full(new)}")

    def table_get(self, table: str) -> dict:
        """The declared table; one that was not made here is declared by its types."""
        r = self._record(table)
        return {"columns": [{k: v for k, v in c.items() if k != "stored"} for c in r["columns"]], "indexes": r["indexes"], "option": r["option"]}

    def table_diff(self, old: dict, new: dict) -> list[tuple[str, str, str]]:
        return diff(old, new)

    def table_save(self, table: str, declared: dict) -> list[tuple[str, str, str]]:
        """Creates a table or makes it what is declared; the changes that were made."""
        if not self.table_exists(table):
            self.table_create(table, declared)
            return [("add", "table", table)]
        wanted = {**declared, "columns": columns_of(declared)}
        changes = diff(self.table_get(table), wanted)
        columns, indexes = ({x["name"]: x for x in wanted.get(k) or []} for k in ("columns", "indexes"))
        # what goes makes room first, indexes before columns
        for action, kind, name in sorted(changes, key=lambda c: (c[0] != "del", c[1] != "index" if c[0] == "del" else c[1] == "index", c[2])):
            if kind == "index":
                if action != "add":
                    self.index_del(table, name)
                if action != "del":
                    self.index_add(table, indexes[name])
            elif action == "del":
                self.column_del(table, name)
            else:
                self.column_alt(table, columns[name])
        return changes

    # ---- columns and indexes ----
    def column_add(self, table: str, column: dict) -> None:
        r = self._record(table)
        if self._find(r, column["name"]) is not None:
            raise ValueError(f"{table} has a column {column['name']}")
        default = column.get("default")
        if not column.get("nullable", True) and default is None and not self.scan(table).isEmpty():
            raise Invalid(table, {(column["name"], "null"): self.scan(table).count()})
        stored = self._store(table, column, default)
        r["columns"].append({**column, "stored": [stored]})
        self._keep(table, r)

    def column_alt(self, table: str, column: dict) -> None:
        """Changes a column, or adds it; rows that would break it make it fail, and leave all as it was."""
        r = self._record(table)
        at = self._find(r, column["name"])
        if at is None:
            return self.column_add(table, column)
        old = r["columns"][at]
        self._check(table, self.scan(table), [column], was=True)
        stored = old["stored"]
        if spark_type(old) != spark_type(column):
            stored = [*stored, self._store(table, column, None)]
        r["columns"][at] = {**column, "name": old["name"], "stored": stored}
        self._keep(table, r)

    def column_del(self, table: str, *names: str) -> None:
        """Takes columns, and the indexes they are in, out of the table."""
        r = self._record(table)
        gone = [self._need(r, table, n) for n in names]
        if len(set(gone)) == len(r["columns"]):
            raise ValueError(f"{table} would have no column")
        lost = {r["columns"][i]["name"] for i in gone}
        r["columns"] = [c for i, c in enumerate(r["columns"]) if i not in gone]
        r["indexes"] = [x for x in r["indexes"] if not lost & set(x["columns"])]
        self._keep(table, r)

    def column_rename(self, table: str, old: str, new: str) -> None:
        r = self._record(table)
        at = self._need(r, table, old)
        if self._find(r, new) not in (None, at):
            raise ValueError(f"{table} has a column {new}")
        was = r["columns"][at]["name"]
        r["columns"][at]["name"] = new
        for x in r["indexes"]:
            x["columns"] = [new if c == was else c for c in x["columns"]]
        self._keep(table, r)

    def index_add(self, table: str, index: dict) -> None:
        """Indexes are metadata; a unique or primary one is checked on the rows that are there, and on inserts."""
        r = self._record(table)
        if any(x["name"] == index["name"] for x in r["indexes"]):
            raise ValueError(f"{table} has an index {index['name']}")
        index = {**index, "columns": [r["columns"][self._need(r, table, c)]["name"] for c in index["columns"]]}
        if index.get("type") in ("unique", "primary"):
            self._unique(table, self.scan(table), index["columns"], index["name"])
        r["indexes"].append(index)
        self._keep(table, r)

    def index_del(self, table: str, *names: str) -> None:
        r = self._record(table)
        r["indexes"] = [x for x in r["indexes"] if x["name"] not in names]
        self._keep(table, r)

    # ---- rows ----
    def scan(self, table: str) -> DataFrame:
        """The rows with the columns that are declared now."""
        r, df = self._record(table), self.spark.table(self.full(table))
        types = {n.lower(): t for n, t in df.dtypes}

        def value(c: dict) -> Column:
            out = None
            for stored in c["stored"]:  # from the oldest
                own = F.col(_name(stored))
                out = own if out is None else F.coalesce(own, out.try_cast(types[stored.lower()]))
            return out.alias(c["name"])

        return df.select(*map(value, r["columns"]))

    def insert(self, table: str, rows: DataFrame, check: bool = True) -> None:
        """Appends rows by the names of their columns; columns that they lack get their default or null.

        A column that numbers rows (ID, increments) and is not given goes on above the
        greatest number there, in steps of its own. check: rows that break what is
        declared (null, length, option, unique) raise Invalid, and none is written.
        """
        r = self._record(table)
        given = {c.lower(): c for c in rows.columns}
        if unknown := set(given) - {c["name"].lower() for c in r["columns"]}:
            raise ValueError(f"{table} has no column {', '.join(sorted(unknown))}")
        values = []
        for c in r["columns"]:
            own, kind = given.get(c["name"].lower()), spark_type(c)
            if own is not None:
                value = F.col(_name(own)).cast(kind)
            elif c["type"].lower() == "id" or c["type"].lower().endswith("increments"):
                last = self.scan(table).agg(F.max(_name(c["name"]))).first()[0] or 0
                value = (F.monotonically_increasing_id() + last + 1).cast(kind)
            else:
                value = F.lit(c.get("default")).cast(kind)
            values.append(value.alias(c["name"]))
        rows = rows.select(*values)
        if check:
            self._check(table, rows, r["columns"])
            for name, keys in self._keys(r):
                self._unique(table, self.scan(table).unionByName(rows), keys, name)
        newest = {c["stored"][-1].lower(): c["name"] for c in r["columns"]}
        stored = self.spark.table(self.full(table)).schema
        rows.select(*[(F.col(_name(newest[f.name.lower()])) if f.name.lower() in newest else F.lit(None).cast(f.dataType)).alias(f.name) for f in stored]).write.insertInto(self.full(table))

    def compact(self, table: str) -> None:
        """Rewrites the rows in their declared columns alone: dropped and former stored columns go."""
        r = self._record(table)
        spare = f"{table}__compacted"
        self.table_drop(spare)
        self.scan(table).write.format("parquet").saveAsTable(self.full(spare))
        for c in r["columns"]:
            c["stored"] = [c["name"]]
        self._keep(spare, r)
        self.table_drop(table)
        self.table_rename(spare, table)

    # ---- inside ----
    def _record(self, table: str) -> dict:
        if not self.table_exists(table):
            raise KeyError(f"no table {table}")
        found = {p.key: p.value for p in self.spark.sql(f"SHOW TBLPROPERTIES {self.full(table)}").collect()}
        if _KEY not in found:
            return {"columns": [{"name": n, **self._declared(t), "nullable": True, "stored": [n]} for n, t in self.spark.table(self.full(table)).dtypes], "indexes": [], "option": {}}
        text = "".join(found[f"{_KEY}.{i}"] for i in range(int(found[_KEY])))
        return json.loads(base64.b64decode(text))

    @staticmethod
    def _declared(kind: str) -> dict:
        if kind.startswith("decimal("):
            precision, scale = kind[8:-1].split(",")
            return {"type": "decimal", "precision": int(precision), "scale": int(scale)}
        return {"type": _DECLARED.get(kind, "json")}  # arrays, maps and records are read as they are

    def _keep(self, table: str, record: dict) -> None:
        text = base64.b64encode(json.dumps(record, ensure_ascii=False).encode()).decode()
        pieces = [text[i : i + _PIECE] for i in range(0, len(text), _PIECE)]
        pairs = {_KEY: str(len(pieces))} | {f"{_KEY}.{i}": p for i, p in enumerate(pieces)}
        # one statement, so readers meet the old mapping or the new one
        self.spark.sql(f"ALTER TABLE {self.full(table)} SET TBLPROPERTIES ({', '.join(f'{_literal(k)}={_literal(v)}' for k, v in pairs.items())})")

    def _store(self, table: str, column: dict, default) -> str:
        """Adds a stored column under a name that none ever had."""
        taken, name, n = {c.lower() for c in self.spark.table(self.full(table)).columns}, column["name"], 1
        while name.lower() in taken:
            n += 1
            name = f"{column['name']}__{n}"
        given = f" DEFAULT CAST({_literal(default)} AS {spark_type(column)})" if default is not None else ""
        self.spark.sql(f"ALTER TABLE {self.full(table)} ADD COLUMNS ({_name(name)} {spark_type(column)}{given})")
        return name

    @staticmethod
    def _find(record: dict, name: str) -> int | None:
        return next((i for i, c in enumerate(record["columns"]) if c["name"].lower() == name.lower()), None)

    def _need(self, record: dict, table: str, name: str) -> int:
        at = self._find(record, name)
        if at is None:
            raise KeyError(f"{table} has no column {name}")
        return at

    @staticmethod
    def _keys(record: dict) -> list[tuple[str, list[str]]]:
        """(name, columns) of what must be unique."""
        out = [(c["name"], [c["name"]]) for c in record["columns"] if c.get("unique") or c.get("primary")]
        return out + [(x["name"], x["columns"]) for x in record["indexes"] if x.get("type") in ("unique", "primary")]

    def _check(self, table: str, rows: DataFrame, columns: list[dict], was: bool = False) -> None:
        """Counts rows that break a column's rules, in one job; was: values may still be of another type, or of the old default."""
        rules = {}
        for c in columns:
            own, kind = F.col(_name(c["name"])), spark_type(c)
            now = own.try_cast(kind) if was else own
            if was:
                rules[c["name"], "type"] = own.isNotNull() & now.isNull()
            if not c.get("nullable", True) and (was or c.get("default") is None):
                rules[c["name"], "null"] = own.isNull()
            if c["type"] in _TEXT and c.get("length"):
                rules[c["name"], "length"] = F.length(now) > c["length"]
            if c["type"] == "enum" and c.get("option"):
                rules[c["name"], "option"] = ~now.isin(list(c["option"]))
        if rules:
            got = rows.agg(*[F.count_if(rule).alias(str(i)) for i, rule in enumerate(rules.values())]).first()
            if bad := {k: got[i] for i, k in enumerate(rules) if got[i]}:
                raise Invalid(table, bad)
        for c in columns if was else []:
            if c.get("unique") or c.get("primary"):
                self._unique(table, rows, [c["name"]], c["name"])

    def _unique(self, table: str, rows: DataFrame, keys: list[str], name: str) -> None:
        """Null is like no other value, as in databases."""
        twice = rows.dropna(subset=[_name(k) for k in keys]).groupBy(*[_name(k) for k in keys]).count().where("count > 1")
        if n := twice.count():
            raise Invalid(table, {(name, "unique"): n})


def migrate(schema: Schema, model: dict, force: bool = False, values: bool = True) -> list[tuple[str, str, str]]:
    """Makes a model's table what the model declares; force drops it first. A table made new gets the model's values."""
    table = (model.get("table") or {}).get("name")
    if not table:
        raise ValueError("a model needs a table's name")
    if force:
        schema.table_drop(table)
    made = not schema.table_exists(table)
    changes = schema.table_save(table, model)
    if made and values and model.get("values"):
        columns = {c["name"]: spark_type(c) for c in columns_of(model)}
        names = [c for c in columns if any(c in v for v in model["values"])]
        rows = schema.spark.createDataFrame([tuple(None if v.get(n) is None else str(v[n]) for n in names) for v in model["values"]], ", ".join(f"{_name(n)} string" for n in names))
        schema.insert(table, rows)
    return changes


def processes(schema: Schema) -> dict:
    """Handlers for a process registry, by the lower-cased names of schema processes."""
    return {
        "create": schema.create, "drop": schema.drop, "tables": schema.tables, "tableget": schema.table_get, "tableexists": schema.table_exists, "tablecreate": schema.table_create, "tabledrop": schema.table_drop, "tablerename": schema.table_rename, "tablediff": schema.table_diff, "tablesave": schema.table_save,
        "columnadd": schema.column_add, "columnalt": schema.column_alt, "columndel": schema.column_del, "indexadd": schema.index_add, "indexdel": schema.index_del,
    }


__all__ = ["Invalid", "Schema", "TYPES", "migrate", "processes"]
