"""Reading and checking the parts of query documents.

lint() returns every problem with its code and place; documents with errors are
not compiled. Conditions, orders, groups and tables have short forms, which the
readers here bring to one form.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from ..functions import expr as E

OPERATORS = {"=": "=", ">": ">", ">=": ">=", "<": "<", "<=": "<=", "<>": "<>", "like": "like", "match": "match", "in": "in", "is": "is", "null": "null", "notnull": "notnull"}
_HAVING = frozenset(OPERATORS) - {"in", "is", "null", "notnull"}
_TABLE = re.compile(r"^(\$)?([A-Za-z0-9_一-龥]+)(?:\s+as\s+([A-Za-z0-9_一-龥]+))?$", re.IGNORECASE)
_KNOWN = frozenset("select from wheres orders groups havings first limit offset page pagesize data-only unions query name joins sql comment debug".split())


@dataclass(frozen=True)
class Problem:
    code: str
    message: str
    path: str
    severity: str = "error"
    line: int = 0
    column: int = 0


@dataclass(frozen=True)
class Table:
    name: str
    alias: str | None = None
    model: bool = False


def table(text: str) -> Table:
    m = _TABLE.match(str(text).strip())
    if not m:
        raise E.ExpressionError(f"not a table: {text!r}")
    return Table(m[2], m[3], bool(m[1]))


def listed(value) -> list[str]:
    return E.split(value) if isinstance(value, str) else [str(v) for v in value or []]


def condition(raw: dict) -> dict:
    """field, op, value, query, or, wheres of a condition in any of its forms."""
    out = {k: v for k, v in raw.items() if k in ("field", "op", "value", "query", "or", "wheres", "havings", "comment")}
    ops = []
    for k, v in raw.items():
        low = k.strip().lower()
        if low.startswith(":"):
            out["field"] = k.strip()[1:]
        elif low.startswith("or :"):
            out["field"], out["or"] = k.strip()[4:], True
        elif low in OPERATORS:
            ops.append(low)
            out["op"] = OPERATORS[low]
            if isinstance(v, dict) and ("from" in v or "select" in v or "sql" in v):
                out["query"] = v
            else:
                out["value"] = v
    if len(ops) > 1:
        raise E.ExpressionError(f"more than one operator: {', '.join(ops)}")
    if "wheres" not in out:
        out["op"] = OPERATORS.get(str(out.get("op", "=")).lower(), str(out.get("op", "=")).lower())
    return out


def orders(raw) -> list[tuple[str, bool]]:
    """(expression, descending) of each order key."""
    out = []
    for item in [raw] if isinstance(raw, (str, dict)) else raw or []:
        if isinstance(item, dict):
            out.append((item["field"], str(item.get("sort", "asc")).lower() == "desc"))
            continue
        for part in E.split(item):
            m = re.match(r"^(.*\S)\s+(asc|desc)$", part, re.IGNORECASE)
            out.append((m[1], m[2].lower() == "desc") if m else (part, False))
    return out


def groups(raw) -> list[dict]:
    out = []
    for item in [raw] if isinstance(raw, (str, dict)) else raw or []:
        if isinstance(item, dict):
            out.append({"field": item["field"], "rollup": item.get("rollup")})
            continue
        for part in E.split(item):
            m = re.match(r"^(.*\S)\s+rollup\s+(.+)$", part, re.IGNORECASE)
            out.append({"field": m[1], "rollup": m[2].strip()} if m else {"field": part, "rollup": None})
    for g in out:
        if g["field"].startswith("@"):  # @name is name@
            g["field"] = g["field"][1:] + "@"
    return out


def havings(raw) -> list[dict]:
    """in, is and nesting are not for havings."""
    out = []
    for c in map(condition, raw or []):
        if "havings" in c or "wheres" in c or c["op"] not in _HAVING:
            raise E.ExpressionError(f"not for havings: {c.get('op') or 'nesting'}")
        out.append(c)
    return out


def lint_text(text: str) -> list[Problem]:
    """Problems of a document's text; E001: it is no JSON object."""
    try:
        doc = json.loads(text)
    except ValueError as e:
        return [Problem("E001", f"not JSON: {e}", "", line=getattr(e, "lineno", 0), column=getattr(e, "colno", 0))]
    found = lint(doc)
    return [_placed(p, text) for p in found]


def _placed(p: Problem, text: str) -> Problem:
    """Line and column of the last named part of a problem's path, as far as it is found."""
    at = 0
    for part in re.findall(r"[^.\[\]]+", p.path):
        if not part.isdigit():
            k = text.find(f'"{part}"', at)
            at = k if k >= 0 else at
    line = text.count("\n", 0, at) + 1
    return Problem(p.code, p.message, p.path, p.severity, line, at - (text.rfind("\n", 0, at) + 1) + 1)


def lint(doc, path: str = "") -> list[Problem]:
    out: list[Problem] = []

    def bad(code: str, message: str, at: str, severity: str = "error") -> None:
        out.append(Problem(code, message, f"{path}.{at}".strip(".") if at else path, severity))

    def expression(code: str, text, at: str) -> None:
        try:
            E.parse(text)
        except E.ExpressionError as e:
            bad(code, str(e), at)

    if not isinstance(doc, dict):
        return [Problem("E001", "a document is a JSON object", path)]
    for k in doc:
        if k not in _KNOWN:
            bad("E002", f"unknown field {k!r}", k, "warning")
    if doc.get("sql"):
        stmt = doc["sql"] if isinstance(doc["sql"], str) else doc["sql"].get("stmt") if isinstance(doc["sql"], dict) else None
        if not stmt:
            bad("E180", "sql needs a stmt", "sql")
        return out
    if not doc.get("from") and not doc.get("query"):
        bad("E110", "from, query or sql is needed", "from")
    if doc.get("from"):
        try:
            table(doc["from"])
        except E.ExpressionError as e:
            bad("E111", str(e), "from")
    if not doc.get("select"):
        bad("E100", "select is empty: all columns", "select", "warning")
    for i, s in enumerate(listed(doc.get("select"))):
        expression("E101", s, f"select[{i}]")

    def conditions(raw, at: str, having: bool) -> None:
        if not isinstance(raw, list):
            bad("E151" if having else "E120", "a list of conditions is needed", at)
            return
        for i, c in enumerate(raw):
            place, code = f"{at}[{i}]", "E151" if having else "E120"
            if not isinstance(c, dict):
                bad(code, "a condition is an object", place)
                continue
            try:
                one = condition(c)
            except E.ExpressionError as e:
                bad(code, str(e), place)
                continue
            if one.get("wheres") is not None:
                if having:
                    bad(code, "havings do not nest", place)
                else:
                    conditions(one["wheres"], f"{place}.wheres", False)
                continue
            if not one.get("field"):
                bad(code, "a condition needs a field", place)
            else:
                expression(code, one["field"], place)
            if one["op"] not in OPERATORS.values() or (having and one["op"] not in _HAVING):
                bad(code, f"operator {one['op']!r}", place)
            if one.get("query"):
                out.extend(lint(one["query"], f"{path}.{place}.query".strip(".")))
            elif "value" not in one and one["op"] not in ("null", "notnull"):
                bad(code, "a condition needs a value or a query", place)
            elif one["op"] == "is" and str(one.get("value")).lower() not in ("null", "not null"):
                bad(code, "is takes null or not null", place)

    if doc.get("wheres") is not None:
        conditions(doc["wheres"], "wheres", False)
    if doc.get("havings") is not None:
        conditions(doc["havings"], "havings", True)
    try:
        for i, (text, _) in enumerate(orders(doc.get("orders"))):
            expression("E130", text, f"orders[{i}]")
        for i, o in enumerate(doc["orders"] if isinstance(doc.get("orders"), list) else []):
            if isinstance(o, dict) and str(o.get("sort", "asc")).lower() not in ("asc", "desc"):
                bad("E130", "sort is asc or desc", f"orders[{i}]")
    except (KeyError, TypeError):
        bad("E130", "an order needs a field", "orders")
    try:
        names = {e.output for e in map(E.parse, listed(doc.get("select")))} | {s.split("(")[0] for s in listed(doc.get("select"))}
    except E.ExpressionError:
        names = None
    try:
        for i, g in enumerate(groups(doc.get("groups"))):
            if not g["field"]:
                bad("E140", "a group needs a field", f"groups[{i}]")
            elif names is not None and g["field"] not in names and g["field"].split("(")[0] not in {re.sub(r"\(.*", "", n) for n in names} and not any(str(g["field"]) in s for s in listed(doc.get("select"))):
                bad("E140", f"group {g['field']!r} is not in the select list", f"groups[{i}]")
    except (KeyError, TypeError):
        bad("E140", "a group needs a field", "groups")
    for k in ("limit", "offset", "page", "pagesize"):
        v = doc.get(k)
        if v is not None and not (isinstance(v, int) and v >= 0) and not (isinstance(v, str) and (v.isdigit() or v.startswith("?:") or "{{" in v)):
            bad("E195", f"{k} is a whole number", k)
    for i, j in enumerate(doc.get("joins") or []):
        if not isinstance(j, dict) or not j.get("from"):
            bad("E172", "a join needs from", f"joins[{i}]")
            continue
        for code, k in (("E170", "key"), ("E171", "foreign")):
            if not j.get(k):
                bad(code, f"a join needs {k}", f"joins[{i}]")
            else:
                expression(code, j[k], f"joins[{i}].{k}")
    for i, u in enumerate(doc.get("unions") or []):
        found = lint(u, f"{path}.unions[{i}]".strip("."))
        out.extend(found)
        if any(p.severity == "error" for p in found):
            bad("E160", "a union has errors", f"unions[{i}]")
    if doc.get("query"):
        found = lint(doc["query"], f"{path}.query".strip("."))
        out.extend(found)
        if any(p.severity == "error" for p in found):
            bad("E190", "the sub-query has errors", "query")
    if doc.get("havings") and not doc.get("groups"):
        bad("E150", "havings need groups", "havings")
    return out
