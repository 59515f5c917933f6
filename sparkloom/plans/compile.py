"""Query documents to lazy DataFrames.

A document is checked (plans.lint), bound (plans.bind) and lowered here in one
pass without any action: scan, joins, filters, JSON unnesting, grouping with
labelled roll-ups, having, order, projection, unions. Sub-queries are temporary
views of their own plans, so Catalyst sees and decorrelates them.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from ..sources.catalog import Catalog
from . import lint
from .bind import bind

#: Rows returned where a document has no limit (only by run.get and the like).
DEFAULT_LIMIT = 100


class QueryError(ValueError):
    pass


class Query:
    """A checked document, ready to be compiled with parameters."""

    def __init__(self, catalog: Catalog, document: dict):
        self.catalog, self.document = catalog, document
        problems = [p for p in lint.lint(document) if p.severity == "error"]
        if problems:
            raise QueryError("; ".join(f"{p.code} {p.path}: {p.message}" for p in problems))

    def frame(self, params: dict | None = None, limit: bool = True, nested: bool = False) -> DataFrame:
        # expressions keep their ?:name, which compiles to a literal; all other parts are bound here
        doc = {k: v if k in ("select", "groups", "orders") else bind(v, params) for k, v in self.document.items()} if params else self.document
        return _Compiler(self.catalog, doc, params or {}).run(limit and not nested)


def compile(catalog: Catalog, document: dict, params: dict | None = None) -> DataFrame:
    return Query(catalog, document).frame(params)


class _Compiler:
    def __init__(self, catalog: Catalog, doc: dict, params: dict):
        self.catalog, self.doc, self.params = catalog, doc, params
        self.tables: dict[str, str] = {}
        self.unnested: dict[tuple, str] = {}

    def sql(self, e: E.Expression) -> str:
        if e.kind == "json" and self._unnest_key(e) in self.unnested:
            return E.quote(self.unnested[self._unnest_key(e)])
        if e.kind == "function":
            args = ", ".join(self.sql(a) for a in e.args)
            marked = replace(e, args=tuple(E.Expression("column", f"\0{i}") for i in range(len(e.args))))
            if e.name.lower() not in ("group_concat", "date_format") and args:
                out = E.sql(marked, self.tables, self.params, self.catalog.key)
                for i, a in enumerate(e.args):
                    out = out.replace(E.quote(f"\0{i}"), self.sql(a))
                return out
        return E.sql(e, self.tables, self.params, self.catalog.key)

    @staticmethod
    def _unnest_key(e: E.Expression) -> tuple:
        return (e.table, e.name, e.path)

    # ---- sources ----

    def _source(self, text: str) -> DataFrame:
        e = lint.table(text)
        name = self.catalog.model_table(e.name) if e.model else e.name
        alias = e.alias or name
        self.tables[e.name] = alias
        return self.catalog.scan(name).alias(alias)

    def _joins(self, df: DataFrame) -> DataFrame:
        for j in self.doc.get("joins") or []:
            right = self._source(j["from"])
            kind = "left" if j.get("left") else "right" if j.get("right") else "inner"
            on = F.expr(f"{self.sql(E.parse(j['key']))} = {self.sql(E.parse(j['foreign']))}")
            df = df.join(right, on, kind)
        return df

    # ---- predicates ----

    def _subquery(self, doc: dict) -> str:
        view = f"sub_{uuid.uuid4().hex}"
        _Compiler(self.catalog, doc, self.params).run(False).createOrReplaceTempView(view)
        return f"(SELECT * FROM {view})"

    def _value(self, cond: dict) -> str:
        if cond.get("query"):
            return self._subquery(cond["query"])
        v = cond.get("value")
        if isinstance(v, str) and len(v) > 2 and v.startswith("{") and v.endswith("}"):
            return self.sql(E.parse(v[1:-1]))
        if isinstance(v, (list, tuple)):
            return "(" + ", ".join(E.literal(x) for x in v) + ")" if v else "(NULL)"
        if isinstance(v, str) and v.startswith("?:"):
            return self.sql(E.parse(v))
        return E.literal(v)

    def predicate(self, conditions: list, named=None) -> str | None:
        """AND binds before OR: a new group of ANDs begins at every `or`."""
        groups: list[list[str]] = []
        for raw in conditions or []:
            c = lint.condition(raw)
            if c.get("wheres"):
                one = self.predicate(c["wheres"], named)
                if one is None:
                    continue
                one = f"({one})"
            else:
                one = self._one(c, named)
            if c.get("or") and groups:
                groups.append([one])
            elif groups:
                groups[-1].append(one)
            else:
                groups.append([one])
        return " OR ".join(" AND ".join(g) for g in groups) or None

    def _one(self, c: dict, named=None) -> str:
        left = (named or self.sql)(E.parse(c["field"]))
        op = c["op"]
        if op == "is":
            return f"{left} IS {'NOT ' if 'not' in str(c.get('value')).lower() else ''}NULL"
        if op in ("null", "notnull"):
            return f"{left} IS {'NOT ' if op == 'notnull' else ''}NULL"
        if op == "match":
            return f"{left} LIKE {E.literal('%' + str(c.get('value')) + '%')}"
        if op == "in":
            v = c.get("value")
            if not c.get("query") and isinstance(v, str) and not v.startswith("{"):
                c = c | {"value": v.split(",")}
            return f"{left} IN {self._value(c)}"
        return f"{left} {op.upper()} {self._value(c)}"

    # ---- select, group, order ----

    def run(self, limited: bool) -> DataFrame:
        doc = self.doc
        if doc.get("sql"):
            return self._raw(doc["sql"])
        if doc.get("query"):
            name = doc.get("name") or "_SUB_"
            self.tables[name] = name
            df = _Compiler(self.catalog, doc["query"], self.params).run(False).alias(name)
        else:
            df = self._source(doc["from"])
        df = self._joins(df)
        if where := self.predicate(doc.get("wheres")):
            df = df.filter(F.expr(where))
        select = [E.parse(s) for s in lint.listed(doc.get("select") or ["*"])]
        groups = lint.groups(doc.get("groups"))
        orders = lint.orders(doc.get("orders"))
        if groups or any(e.aggregates for e in select):
            df = self._grouped(df, select, groups, orders)
        else:
            df = self._plain(df, select, orders)
        for other in doc.get("unions") or []:
            df = df.unionAll(_Compiler(self.catalog, other, self.params).run(False))
        if limited:
            df = paged(df, doc)
        return df

    def _raw(self, raw) -> DataFrame:
        raw = {"stmt": raw} if isinstance(raw, str) else raw
        for name in raw.get("tables") or _mentioned(raw["stmt"]):
            try:
                self.catalog.views(name)
            except Exception:  # noqa: BLE001 - a word of the statement that is no table
                continue
        args = raw.get("args") or []
        return self.catalog.spark.sql(raw["stmt"], args=list(args)) if args else self.catalog.spark.sql(raw["stmt"])

    def _columns(self, df: DataFrame, select: list[E.Expression]) -> list[Column]:
        out = []
        for e in select:
            if e.kind == "star":
                out.append(F.col(f"{self.tables.get(e.table, e.table)}.*") if e.table else F.col("*"))
            else:
                out.append(F.expr(self.sql(e)).alias(e.output))
        return out

    def _plain(self, df, select, orders) -> DataFrame:
        by_name = {e.output: e for e in select if e.alias}
        keys = []
        for i, (text, desc) in enumerate(orders):
            e = by_name.get(text) or E.parse(text)
            keys.append((f"__o{i}", F.expr(self.sql(replace(e, alias=None))), desc))
        if not keys:
            return df.select(*self._columns(df, select))
        wide = df.select(*self._columns(df, select), *[c.alias(n) for n, c, _ in keys])
        wide = wide.orderBy(*[F.col(n).desc() if d else F.col(n).asc() for n, _, d in keys])
        return wide.drop(*[n for n, _, _ in keys])

    def _unnest(self, df: DataFrame, e: E.Expression) -> DataFrame:
        """One row for each element of a JSON array; a row without elements goes."""
        key = self._unnest_key(e)
        if key in self.unnested:
            return df
        star = e.path.index("[*]")
        column = E.sql(replace(e, path=e.path[:star], type=None), self.tables)
        keys = e.path[star + 1 :]
        name = f"__u{len(self.unnested)}"
        element = F.explode(F.from_json(F.expr(column), "array<string>"))
        df = df.withColumn(name, element)
        value = F.get_json_object(name, E.json_path(keys)) if keys else F.col(name)
        df = df.withColumn(name, F.expr(f"try_cast({E.quote(name)} as {E.spark_type(e.type)})") if not keys else value.try_cast(E.spark_type(e.type)))
        self.unnested[key] = name
        return df

    def _grouped(self, df, select, groups, orders) -> DataFrame:
        by_name = {e.output: e for e in select}
        by_plain = {str(replace(e, alias=None, type=None)): e for e in select}
        keys = []
        for g in groups:
            e = by_name.get(g["field"]) or by_plain.get(g["field"])
            if e is None:
                parsed = E.parse(g["field"])
                e = by_plain.get(str(replace(parsed, alias=None, type=None)))
                if e is None:
                    raise QueryError(f"group {g['field']!r} is not in the select list")
            if e.is_array:
                df = self._unnest(df, e)
            keys.append((replace(e, alias=None), g.get("rollup")))
        df = df.select("*", *[F.expr(self.sql(e)).alias(f"__k{i}") for i, (e, _) in enumerate(keys)])
        at = {self.sql(e): i for i, (e, _) in enumerate(keys)}
        names = [f"__k{i}" for i in range(len(keys))]
        rolled = [i for i, (_, label) in enumerate(keys) if label is not None]

        def shown(e: E.Expression) -> Column:
            i = at.get(self.sql(replace(e, alias=None)))
            if i is None:
                return F.expr(self.sql(replace(e, alias=None)))
            label = keys[i][1]
            if label is None:
                return F.col(names[i])
            return F.when(F.grouping(names[i]) == 1, F.lit(label)).otherwise(F.col(names[i]).cast("string"))

        extra: list[Column] = []

        def hidden(e: E.Expression) -> str:
            e = by_name.get(e.output, e) if e.kind == "column" and e.table is None else e
            extra.append(shown(e).alias(f"__h{len(extra)}"))
            return E.quote(f"__h{len(extra) - 1}")

        having = self.predicate(lint.havings(self.doc.get("havings")), hidden)
        order = [(hidden(by_name.get(text) or E.parse(text)), desc) for text, desc in orders]
        items = [shown(e).alias(f"__s{i}") for i, e in enumerate(select)]
        if rolled:
            plain = [n for i, n in enumerate(names) if i not in rolled]
            sets = [[*plain, *[names[i] for i in rolled[:k]]] for k in range(len(rolled), -1, -1)]
            got = df.groupingSets([[F.col(n) for n in s] for s in sets], *[F.col(n) for n in names])
        else:
            got = df.groupBy(*names)
        got = got.agg(*items, *extra)
        if having:
            got = got.filter(F.expr(having))
        if order:
            got = got.orderBy(*[F.expr(k).desc() if d else F.expr(k).asc() for k, d in order])
        return got.select(*[F.col(f"__s{i}").alias(e.output) for i, e in enumerate(select)])


def _mentioned(stmt: str) -> list[str]:
    import re

    return list(dict.fromkeys(m[1] for m in re.finditer(r"\b(?:from|join)\s+([A-Za-z_]\w*)", stmt, re.IGNORECASE)))


def paged(df: DataFrame, doc: dict) -> DataFrame:
    """Limit and offset of the outermost document; those of nested ones have no effect."""
    if doc.get("first"):
        return df.limit(1)
    if doc.get("offset"):
        df = df.offset(int(doc["offset"]))
    if doc.get("limit") is not None:
        df = df.limit(int(doc["limit"]))
    return df
