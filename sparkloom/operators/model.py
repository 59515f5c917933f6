"""Models: declared tables with columns, relations, soft deletes, scopes, reads and writes as DataFrames.

Writes return the table as it is afterwards: storage without transactions is
replaced by a new snapshot (sources.io), so every write is a plan of its own.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import literal, quote

OPS = {"eq": "=", "ne": "<>", "gt": ">", "ge": ">=", "lt": "<", "le": "<=", "like": "like", "=": "=", "<>": "<>", ">": ">", ">=": ">=", "<": "<", "<=": "<=", "match": "match", "null": "null", "notnull": "notnull", "in": "in"}
DEFAULT_LIMIT = 100


@dataclass
class Relation:
    """kind: one (a left join), many (nested lists) or through (a chain of left joins); key: the related table's, foreign: ours."""

    kind: str
    model: str
    key: str
    foreign: str
    query: dict = field(default_factory=dict)
    links: list["Relation"] = field(default_factory=list)


@dataclass
class Model:
    name: str
    table: str
    columns: dict[str, str]
    primary: str = "id"
    relations: dict[str, Relation] = field(default_factory=dict)
    unique: list[str] = field(default_factory=list)
    json: list[str] = field(default_factory=list)
    soft_deletes: bool = False
    timestamps: bool = False


class Models:
    """Models over a catalog."""

    def __init__(self, catalog, *models: Model):
        self.catalog = catalog
        self.found = {m.name: m for m in models}

    def scan(self, name: str, deleted: bool = False) -> DataFrame:
        m = self.found[name]
        df = self.catalog.scan(m.table)
        return df.filter("deleted_at IS NULL") if m.soft_deletes and not deleted else df

    def predicate(self, m: Model, wheres: list[dict], alias: str) -> str | None:
        groups: list[list[str]] = []
        for w in wheres or []:
            method = w.get("method", "where").lower()
            if w.get("wheres"):
                one = self.predicate(m, w["wheres"], alias)
                if one is None:
                    continue
                one = f"({one})"
            else:
                at = "__".join([alias, *w["rel"].split("."), "rel"]) if w.get("rel") else alias
                one = _condition(m, f"{quote(at)}.{quote(w['column'])}", w, method)
            if method.startswith("or") and groups:
                groups.append([one])
            elif groups:
                groups[-1].append(one)
            else:
                groups.append([one])
        return " OR ".join(" AND ".join(g) for g in groups) or None

    def query(self, name: str, param: dict | None = None, limited: bool = False) -> DataFrame:
        """select, wheres, orders, limit, withs of a query parameter; relations come as rel_column columns or nested lists."""
        p, m = param or {}, self.found[name]
        df = self.scan(name).alias(name)
        columns = [c for c in p.get("select") or m.columns if c in m.columns or " " in c]
        out = [F.col(f"{name}.{c}") if c in m.columns else F.expr(c) for c in columns]
        many = []
        for rel, own in (p.get("withs") or {}).items():
            r = m.relations[rel]
            wanted = (own or {}).get("query", own or {})
            if r.kind == "many":
                many.append((rel, r, wanted))
                continue
            df, alias, last = self._join(df, name, rel, r, wanted)
            chosen = [c for c in wanted.get("select") or self.found[last].columns if c in self.found[last].columns]
            out += [F.col(f"{alias}.{c}").alias(f"{rel}_{c}") for c in chosen]
        if w := self.predicate(m, p.get("wheres"), name):
            df = df.filter(F.expr(w))
        keys = []
        for i, o in enumerate(p.get("orders") or []):
            at = "__".join([name, *o["rel"].split("."), "rel"]) if o.get("rel") else name
            keys.append((F.col(f"{at}.{o['column']}").alias(f"__o{i}"), str(o.get("option", "asc")).lower() == "desc"))
        if many and (p.get("limit") is not None or limited):  # the rows at hand are read twice: the key makes their order total
            keys.append((F.col(f"{name}.{m.primary}").alias(f"__o{len(keys)}"), False))
        parents = [F.col(f"{name}.{r.foreign}").alias(f"__p{i}") for i, (_, r, _) in enumerate(many)]
        df = df.select(*out, *parents, *[k for k, _ in keys])
        if keys:
            df = df.orderBy(*[F.col(f"__o{i}").desc() if d else F.col(f"__o{i}").asc() for i, (_, d) in enumerate(keys)])
        if p.get("limit") is not None or limited:
            df = df.limit(int(p.get("limit") or DEFAULT_LIMIT))
        for i, (rel, r, wanted) in enumerate(many):
            df = self._nest(df, f"__p{i}", rel, r, wanted)
        return df.drop(*[f"__o{i}" for i in range(len(keys))], *[f"__p{i}" for i in range(len(many))])

    def _join(self, df: DataFrame, name: str, rel: str, r: Relation, wanted: dict):
        alias, last = name, r.model
        for k, link in enumerate(r.links or [r]):
            right = self.scan(link.model)
            conditions = [*(link.query.get("wheres") or []), *(wanted.get("wheres") or [])] if link is (r.links or [r])[-1] else link.query.get("wheres")
            if w := self.predicate(self.found[link.model], conditions, link.model):
                right = right.alias(link.model).filter(F.expr(w))
            to = f"{name}__{rel}__rel" if k == len(r.links or [r]) - 1 else f"{name}__{rel}__{k}"
            df = df.join(right.alias(to), F.col(f"{to}.{link.key}") == F.col(f"{alias}.{link.foreign}"), "left")
            alias, last = to, link.model
        return df, alias, last

    def _nest(self, df: DataFrame, parent: str, rel: str, r: Relation, wanted: dict) -> DataFrame:
        """Children of the rows at hand only, as a sorted list; no child: an empty list."""
        child, m = self.query(r.model, {**wanted, "limit": None, "select": list(dict.fromkeys([r.key, *(wanted.get("select") or self.found[r.model].columns)]))}), self.found[r.model]
        child = child.join(df.select(F.col(parent).alias(r.key)).distinct(), r.key, "left_semi")
        first = [m.primary] if m.primary in child.columns else []
        lists = child.groupBy(F.col(r.key).alias("__k")).agg(F.sort_array(F.collect_list(F.struct(*first, *[c for c in child.columns if c not in first]))).alias(rel))
        out = df.join(lists, df[parent] == lists["__k"], "left").drop("__k")
        return out.withColumn(rel, F.coalesce(rel, F.expr(f"cast(array() as {lists.schema[rel].dataType.simpleString()})")))

    # ---- reads ----

    def get(self, name, param=None):
        return self.query(name, param, True)

    def find(self, name, key, param=None):
        m = self.found[name]
        return self.query(name, {**(param or {}), "wheres": [*((param or {}).get("wheres") or []), {"column": m.primary, "value": key}], "limit": 1})

    def count(self, name, param=None) -> DataFrame:
        return self.query(name, {k: v for k, v in (param or {}).items() if k == "wheres"}).agg(F.count("*").alias("total"))

    def paginate(self, name, param, page: int, size: int):
        from ..plans.run import Page

        page, size = max(1, page), size if size >= 1 else 20
        df = self.query(name, {k: v for k, v in param.items() if k != "limit"})
        total = df.count()
        pages = -(-total // size) if total else -1
        return Page(df.offset((page - 1) * size).limit(size), total, page, size, pages, page + 1 if pages <= 0 or page < pages else -1, page - 1 if page > 1 else -1)

    def select_option(self, name, keyword: str, label: str, value: str | None = None, limit: int = 20) -> DataFrame:
        m = self.found[name]
        return self.scan(name).filter(F.col(label).contains(keyword)).select(F.col(label).alias("name"), F.col(value or m.primary).alias("id")).orderBy("id").limit(limit)

    # ---- writes: the table afterwards ----

    def insert(self, name, rows: DataFrame) -> DataFrame:
        df = self.catalog.scan(self.found[name].table)
        return df.unionByName(rows.withColumn("created_at", F.current_timestamp()) if self.found[name].timestamps and "created_at" not in rows.columns else rows, allowMissingColumns=True)

    def update_where(self, name, wheres, values: dict[str, Column]) -> DataFrame:
        m = self.found[name]
        df = self.catalog.scan(m.table).alias(name)
        w = F.coalesce(F.expr(self.predicate(m, wheres, name) or "true"), F.lit(False))
        if m.timestamps:
            values = {"updated_at": F.current_timestamp(), **values}
        return df.select(*[F.when(w, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns], *[F.when(w, v).alias(c) for c, v in values.items() if c not in df.columns])

    def destroy_where(self, name, wheres) -> DataFrame:
        m = self.found[name]
        w = self.predicate(m, wheres, name) or "true"
        return self.catalog.scan(m.table).alias(name).filter(~F.coalesce(F.expr(w), F.lit(False)))

    def delete_where(self, name, wheres, stamp: Column | None = None) -> DataFrame:
        """Soft delete: a time stamp, a suffix on unique strings, and what was there as JSON."""
        m = self.found[name]
        stamp = F.current_timestamp() if stamp is None else stamp
        df = self.catalog.scan(m.table).alias(name)
        w = F.coalesce(F.expr(self.predicate(m, wheres, name) or "true"), F.lit(False)) & F.col("deleted_at").isNull()
        out = []
        for c, kind in df.dtypes:
            if c == "deleted_at":
                out.append(F.when(w, stamp.cast(kind)).otherwise(F.col(c)).alias(c))
            elif c in m.unique and kind == "string":
                out.append(F.when(w, F.concat(c, F.lit("_"), F.date_format(stamp, "yyyyMMddHHmmss"), F.lit("_"), F.col(m.primary).cast("string"))).otherwise(F.col(c)).alias(c))
            elif c in m.unique and c != m.primary:
                out.append(F.when(~w, F.col(c)).alias(c))
            elif c != "__restore_data":
                out.append(F.col(c))
        kept = F.when(w, F.to_json(F.struct(*[c for c in df.columns if c in m.unique]))) if m.unique else F.lit(None).cast("string")
        return df.select(*out, kept.alias("__restore_data"))

    def upsert(self, name, rows: DataFrame, by: list[str], update: list[str] | None = None) -> DataFrame:
        """Rows whose key is there update it, the others are added; of several new rows of a key one (the greatest) counts."""
        df = self.catalog.scan(self.found[name].table)
        update = update or [c for c in rows.columns if c not in by]
        rest = [c for c in rows.columns if c not in by]
        new = rows.groupBy(*by).agg(F.max(F.struct(*rest)).alias("__new")) if rest else rows.distinct().withColumn("__new", F.struct(F.lit(1)))
        both = df.withColumn("__there", F.lit(True)).join(new, by, "full")
        out = []
        for c in df.columns:
            if c in by:
                out.append(F.col(c))
            elif c in rest:
                fresh = F.col(f"__new.{c}")
                out.append((F.when(F.col("__new").isNull(), F.col(c)).when(F.col("__there").isNotNull() & ~F.lit(c in update), F.col(c)).otherwise(fresh)).alias(c))
            else:
                out.append(F.col(c))
        return both.select(*out)

    def save(self, name, rows: DataFrame) -> DataFrame:
        """Rows with a primary key that is there update that row's given columns, those with a new key or none are added.
        With time stamps, an update sets updated_at and an insert created_at; what rows say of created_at, deleted_at is left out.
        Of several rows of one key the greatest by the other columns counts."""
        m = self.found[name]
        df = self.catalog.scan(m.table)
        if m.timestamps:
            rows = rows.drop("created_at", "deleted_at", "updated_at")
        key = m.primary if m.primary in rows.columns else None
        keyed = rows.filter(F.col(key).isNotNull()) if key else rows.limit(0)
        loose = rows.filter(F.col(key).isNull()) if key else rows
        rest = [c for c in rows.columns if c != m.primary]
        if key:
            new = keyed.groupBy(key).agg(F.max(F.struct(F.lit(1).alias("__one"), *rest)).alias("__new"))
            both = df.withColumn("__there", F.lit(True)).join(new, key, "full")
            out = []
            for c in df.columns:
                old = F.col(c)
                if c == key:
                    out.append(old)
                elif c in rest:
                    out.append(F.when(F.col("__new").isNull(), old).otherwise(F.col(f"__new.{c}")).alias(c))
                elif m.timestamps and c == "updated_at":
                    out.append(F.when(F.col("__new").isNotNull() & F.col("__there").isNotNull(), F.current_timestamp().cast(df.schema[c].dataType)).otherwise(old).alias(c))
                elif m.timestamps and c == "created_at":
                    out.append(F.when(F.col("__there").isNull(), F.current_timestamp().cast(df.schema[c].dataType)).otherwise(old).alias(c))
                else:
                    out.append(old)
            df = both.select(*out)
        if m.timestamps and "created_at" in df.columns:
            loose = loose.withColumn("created_at", F.current_timestamp().cast(df.schema["created_at"].dataType))
        return df.unionByName(loose.select(*[c for c in loose.columns if c in df.columns]), allowMissingColumns=True)

    def insert_checked(self, name, rows: DataFrame, rules: list, line: str) -> tuple[DataFrame, DataFrame]:
        """(the table with the rows, a report): rows go in only where all are valid. The report has a row (line, messages) of each
        row that breaks rules (column, method, arguments, message); line is the column that numbers the rows."""
        from ..functions.text import violations

        report = rows.select(F.col(line).alias("line"), violations(rules).alias("messages")).filter(F.size("messages") > 0)
        none_bad = report.isEmpty()
        return (self.insert(name, rows.drop(line)) if none_bad else self.catalog.scan(self.found[name].table)), report

    def each_save(self, name, rows: DataFrame, line: str, each: dict | None = None, rules: list | None = None) -> tuple[DataFrame, DataFrame]:
        """(the table afterwards, errors): every valid row is saved, one that breaks a rule is in errors(line, messages).
        each sets columns of all rows; the value "$index" stands for the row's number, the column line."""
        from ..functions.text import violations

        for c, v in (each or {}).items():
            rows = rows.withColumn(c, F.col(line) if v == "$index" else F.lit(v))
        bad = F.size(violations(rules)) > 0 if rules else F.lit(False)
        errors = rows.filter(bad).select(F.col(line).alias("line"), (violations(rules) if rules else F.array().cast("array<string>")).alias("messages"))
        kept = rows.filter(~bad)
        return self.save(name, kept if each and "$index" in each.values() and line in each else kept.drop(line)), errors

    def each_save_after_delete(self, name, gone: list, rows: DataFrame, line: str, each: dict | None = None) -> tuple[DataFrame, DataFrame]:
        """each_save on the table without the rows of these keys."""
        m, before = self.found[name], self.catalog
        left = before.scan(m.table).filter(~F.coalesce(F.col(m.primary).isin(gone), F.lit(False)))
        from ..sources.catalog import Catalog

        after = Models(Catalog(before.spark, before.folder).register(m.table, left), m)
        return after.each_save(name, rows, line, each)

    def nested(self, df: DataFrame, relations: list[str], name: str | None = None) -> DataFrame:
        """Columns rel_column of relations as one struct rel each; null where all of them are.

        name: the model whose own columns stay, also such as begin with a relation's name.
        The longest relation that a column's name begins with has it.
        """
        out, stay = [], set(self.catalog.scan(self.found[name].table).columns) if name else set()

        def owner(c: str) -> str | None:
            return max((r for r in relations if c.startswith(f"{r}_") and c not in stay), key=len, default=None)

        for rel in relations:
            own = [c for c in df.columns if owner(c) == rel]
            if not own:
                continue
            some = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in own])
            out.append(F.when(some, F.struct(*[F.col(c).alias(c[len(rel) + 1 :]) for c in own])).alias(rel))
        left = [c for c in df.columns if owner(c) is None]
        return df.select(*left, *out)


def _condition(m: Model, column: str, w: dict, method: str) -> str:
    op = OPS.get(str(w.get("op", "eq")).lower(), "=")
    if method in ("wherein", "orwherein"):
        op = "in"
    v = w.get("value")
    if op in ("null", "notnull"):
        return f"{column} IS {'NOT ' if op == 'notnull' else ''}NULL"
    if op == "in":
        vs = v.split(",") if isinstance(v, str) else list(v)
        return f"{column} IN ({', '.join(map(literal, vs)) or 'NULL'})"
    if w["column"] in m.json and op in ("match", "like"):
        return f"array_contains(from_json({column}, 'array<string>'), {literal(v)})"
    if op == "match":
        return f"{column} LIKE {literal(f'%{v}%')}"
    return f"{column} {op} {literal(v)}"


# ---- access scopes -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Scope:
    team: str | None = None
    creator: str | None = None
    editor: str | None = None
    tenant: str | None = None


TEAM, CREATOR, EDITOR, TENANT = "__team_id", "__created_by", "__updated_by", "__tenant_id"


def scope_filter(kind: str, scope: Scope) -> Column:
    """kind: wheres (all that is set), team_only, creator_only, editor_only, creator_and_editor, creator_or_editor,
    team_or_creator, team_or_editor, any. What is not set admits nothing in an alternative; nothing set admits all."""
    parts = {"team": (TEAM, scope.team), "creator": (CREATOR, scope.creator), "editor": (EDITOR, scope.editor), "tenant": (TENANT, scope.tenant)}
    ask = {"wheres": ("team", "creator", "editor", "tenant"), "team_only": ("team",), "creator_only": ("creator",), "editor_only": ("editor",), "creator_and_editor": ("creator", "editor"), "creator_or_editor": ("creator", "editor"), "team_or_creator": ("team", "creator"), "team_or_editor": ("team", "editor"), "any": ("team", "creator", "editor")}[kind]
    conditions = [F.col(c) == F.lit(v) for c, v in map(parts.get, ask) if v is not None]
    if not conditions:
        return F.lit(True)
    return reduce(lambda a, b: a | b if "or" in kind.split("_") or kind == "any" else a & b, conditions)


def scope_stamp(rows: DataFrame, scope: Scope) -> DataFrame:
    return rows.withColumns({c: F.lit(v) for c, v in ((TEAM, scope.team), (CREATOR, scope.creator), (EDITOR, scope.editor), (TENANT, scope.tenant)) if v is not None})


# ---- parameters from URLs ------------------------------------------------------------------------


def url_param(text: str) -> dict:
    """A query parameter from select, order, where.c.op, orwhere.c.op, group.g.where.c.op, with, rel.select, rel.where..., limit, page, pagesize."""
    from urllib.parse import parse_qsl

    out: dict = {}
    groups: dict[str, list] = {}
    for k, v in parse_qsl(text.lstrip("?"), keep_blank_values=True):
        parts = k.split(".")
        if k == "select":
            out["select"] = [x.strip() for x in v.split(",")]
        elif k == "order":
            out["orders"] = []
            for x in v.split(","):
                c, *way = x.strip().rsplit(".", 1) if x.strip().rsplit(".", 1)[-1] in ("asc", "desc") else (x.strip(),)
                *rel, column = c.split(".")
                out["orders"].append({"column": column, "option": way[0] if way else "asc", **({"rel": ".".join(rel)} if rel else {})})
        elif k == "with":
            for x in v.split(","):
                out.setdefault("withs", {}).setdefault(x.strip(), {})
        elif k in ("limit", "page", "pagesize"):
            out[k] = int(v)
        elif "where" in parts or "orwhere" in parts or "wherein" in parts or "orwherein" in parts:
            at = next(i for i, p in enumerate(parts) if p in ("where", "orwhere", "wherein", "orwherein"))
            column, op = parts[at + 1 : -1], parts[-1]
            if not column:
                column, op = [op], "in" if parts[at].endswith("in") else "eq"
            w = {"column": column[-1], "op": op, "value": v, "method": parts[at], **({"rel": ".".join(column[:-1])} if len(column) > 1 else {})}
            if at >= 2 and parts[0] == "group":
                groups.setdefault(parts[1], []).append(w)
            elif at:
                out.setdefault("withs", {}).setdefault(".".join(parts[:at]), {}).setdefault("wheres", []).append(w)
            else:
                out.setdefault("wheres", []).append(w)
        elif len(parts) > 1 and parts[-1] in ("select", "limit"):
            out.setdefault("withs", {}).setdefault(".".join(parts[:-1]), {})[parts[-1]] = v.split(",") if parts[-1] == "select" else int(v)
    for own in groups.values():
        out.setdefault("wheres", []).append({"wheres": own, "method": own[0]["method"]})
    return out
