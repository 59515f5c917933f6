"""The expression language of query documents: parsing and lowering to Spark columns.

    name  t.name  $user.name  *          columns (any letters, CJK too)
    12  -0.5  'text'                     literals
    :fn(a, :g(b, 'x,y'))                 function calls, nested
    ?:name                               a bound parameter
    doc$.a.b  doc$                       path into a JSON object
    arr[0]  arr[0].k  arr@  arr[*].k     path into a JSON array
    field(decimal 11,2)                  a declared type for a JSON element
    field*                               a stored encrypted field
    ... as alias
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

_NAME = r"[A-Za-z0-9_一-龥]+"
_ALIAS = re.compile(r"^(.*\S)\s+as\s+(\S+)$", re.IGNORECASE | re.DOTALL)
_NUMBER = re.compile(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$")
_TYPE = re.compile(r"^(.+?)\(\s*([A-Za-z]+)(?:\s+(\d+)(?:\s*,\s*(\d+))?)?\s*\)$")
_COLUMN = re.compile(rf"^(\$)?(?:({_NAME})\.)?({_NAME}|\*)(\*)?$")
_JSON = re.compile(rf"^(\$)?(?:({_NAME})\.)?({_NAME})((?:\$|@|\[(?:\d+|\*)\]).*|(?:\.{_NAME})+\[.*)$")

#: Names of other SQL dialects and what Spark calls them.
FUNCTIONS = {
    "ifnull": "coalesce", "nvl": "coalesce", "ucase": "upper", "lcase": "lower", "len": "length", "char_length": "char_length", "unix_timestamp": "unix_timestamp", "now": "current_timestamp", "curdate": "current_date",
    "group_concat": "string_agg", "json_extract": "get_json_object", "substr": "substring", "mid": "substring", "rand": "rand", "json_length": "json_array_length", "std": "stddev_pop", "stddev": "stddev_pop",
}
AGGREGATES = frozenset("count sum avg min max group_concat string_agg std stddev stddev_pop stddev_samp variance var_pop var_samp approx_count_distinct first last collect_list collect_set count_if any every median mode percentile bool_and bool_or grouping max_by min_by mean".split())
#: Declared element types and their defaults.
TYPES = {
    "string": "string", "char": "string", "text": "string", "integer": "int", "int": "int", "bigint": "bigint", "boolean": "boolean", "date": "date", "time": "string", "datetime": "timestamp_ntz", "timestamp": "timestamp",
    "double": "double", "float": "float", "decimal": "decimal(10,2)",
}


class ExpressionError(ValueError):
    pass


@dataclass(frozen=True)
class Expression:
    """A parsed expression. kind: column, star, number, string, function, bind, json, encrypted."""

    kind: str
    name: str = ""
    table: str | None = None
    model: bool = False
    args: tuple["Expression", ...] = ()
    path: tuple[str, ...] = ()
    type: str | None = None
    alias: str | None = None
    text: str = field(default="", compare=False)

    @property
    def is_array(self) -> bool:
        """A whole JSON array, or one field of all its elements."""
        return self.kind == "json" and "[*]" in self.path

    @property
    def aggregates(self) -> bool:
        return self.kind == "function" and (self.name.lower() in AGGREGATES or any(a.aggregates for a in self.args))

    @property
    def output(self) -> str:
        """The result column's name."""
        if self.alias:
            return self.alias
        if self.kind in ("column", "encrypted"):
            return self.name
        return str(replace(self, alias=None, type=None))

    def __str__(self) -> str:
        dot = ("$" if self.model else "") + (f"{self.table}." if self.table else "")
        body = {
            "column": lambda: dot + self.name,
            "star": lambda: dot + "*",
            "number": lambda: self.name,
            "string": lambda: "'" + self.name.replace("'", "\\'") + "'",
            "function": lambda: f":{self.name}({','.join(map(str, self.args))})",
            "bind": lambda: f"?:{self.name}",
            "json": lambda: dot + self.name + _show_path(self.path),
            "encrypted": lambda: dot + self.name + "*",
        }[self.kind]()
        return body + (f"({self.type})" if self.type else "") + (f" as {self.alias}" if self.alias else "")


def _show_path(path: tuple[str, ...]) -> str:
    if path and not path[0].startswith("["):
        return "$" + "".join(p if p.startswith("[") else f".{p}" for p in path)
    return "".join(p if p.startswith("[") else f".{p}" for p in path) or "$"


def split(text: str, mark: str = ",") -> list[str]:
    """Parts at top-level marks; quotes and brackets hold theirs."""
    out, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            if c == quote and text[i - 1] != "\\":
                quote = ""
        elif c in "'\"":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == mark and depth == 0:
            out.append(text[start:i])
            start = i + 1
    out.append(text[start:])
    return [p.strip() for p in out]


def parse(text: str) -> Expression:
    text = str(text).strip()
    if not text:
        raise ExpressionError("empty expression")
    alias = None
    parts = re.split(r"\s+as\s+", text, flags=re.IGNORECASE) if "'" not in text else [text]
    if len(parts) > 2:
        raise ExpressionError(f"more than one alias in {text!r}")
    if m := _ALIAS.match(text):
        if m[2].count("'") == 0:
            text, alias = m[1].strip(), m[2].strip()
    return replace(_parse(text), alias=alias, text=text)


def _parse(text: str) -> Expression:
    if text.startswith("'"):
        if len(text) < 2 or not text.endswith("'"):
            raise ExpressionError(f"string without end: {text}")
        return Expression("string", text[1:-1].replace("\\'", "'"))
    if _NUMBER.match(text):
        return Expression("number", text)
    if text.startswith("?:"):
        return Expression("bind", text[2:])
    if text.startswith(":"):
        m = re.match(r"^:([A-Za-z_][A-Za-z0-9_]*)\((.*)\)$", text, re.DOTALL)
        if not m:
            raise ExpressionError(f"not a function call: {text}")
        inner = m[2].strip()
        return Expression("function", m[1], args=tuple(_parse(a) for a in split(inner)) if inner else ())
    if (m := _TYPE.match(text)) and m[2].lower() in TYPES:
        size = f" {m[3]}" + (f",{m[4]}" if m[4] else "") if m[3] else ""
        return replace(_parse(m[1].strip()), type=m[2].lower() + size)
    if (m := _TYPE.match(text)) and not text.startswith(":"):
        raise ExpressionError(f"unknown type {m[2]!r} in {text!r}")
    if re.search(r"\s", text):
        raise ExpressionError(f"white space in a field: {text!r}")
    if text == "*":
        return Expression("star")
    if m := _COLUMN.match(text):
        kind = "star" if m[3] == "*" else "encrypted" if m[4] else "column"
        return Expression(kind, "" if kind == "star" else m[3], m[2], bool(m[1]))
    if m := _JSON.match(text):
        return Expression("json", m[3], m[2], bool(m[1]), path=_path(m[4], text))
    raise ExpressionError(f"cannot read {text!r}")


def _path(rest: str, text: str) -> tuple[str, ...]:
    rest = rest.removeprefix("$")
    out, at = [], 0
    step = re.compile(rf"\.({_NAME})|\[(\d+|\*)\]|(@)")
    while at < len(rest):
        m = step.match(rest, at)
        if not m:
            raise ExpressionError(f"cannot read the path of {text!r}")
        out.append(m[1] if m[1] else f"[{m[2]}]" if m[2] else "[*]")
        at = m.end()
    return tuple(out)


def spark_type(declared: str | None, default: str = "string") -> str:
    if not declared:
        return default
    name, _, size = declared.partition(" ")
    if name not in TYPES:
        raise ExpressionError(f"unknown type {declared!r}")
    return f"decimal({size})" if name == "decimal" and size else TYPES[name]


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def json_path(path: tuple[str, ...]) -> str:
    return "$" + "".join(p if p.startswith("[") else f".{p}" for p in path)


def sql(e: Expression, tables: dict[str, str] | None = None, params: dict | None = None, key: str | None = None) -> str:
    """Spark SQL text of an expression. tables: model or table name -> alias in the plan; key: for encrypted fields."""
    tables = tables or {}
    dot = quote(tables.get(e.table, e.table)) + "." if e.table else ""
    if e.kind == "column":
        out = dot + quote(e.name)
    elif e.kind == "star":
        out = dot + "*"
    elif e.kind == "number":
        out = e.name
    elif e.kind == "string":
        out = literal(e.name)
    elif e.kind == "bind":
        if params is None or e.name not in params:
            raise ExpressionError(f"no value for ?:{e.name}")
        out = literal(params[e.name])
    elif e.kind == "function":
        name, args = e.name.lower(), [sql(a, tables, params, key) for a in e.args]
        if name == "group_concat":
            out = f"array_join(collect_list({args[0]}), {args[1] if len(args) > 1 else literal(',')})"
        elif name == "truncate" and args:
            scale = f"pow(10, {args[1] if len(args) > 1 else 0})"
            out = f"(case when {args[0]} < 0 then ceil({args[0]} * {scale}) else floor({args[0]} * {scale}) end / {scale})"
        elif name == "date_format" and len(e.args) == 2 and e.args[1].kind == "string" and "%" in e.args[1].name:
            out = f"date_format({args[0]}, {literal(_date_pattern(e.args[1].name))})"
        else:
            out = f"{FUNCTIONS.get(name, name)}({', '.join(args)})"
    elif e.kind == "json":
        column = dot + quote(e.name)
        out = column if not e.path or e.path == ("[*]",) else f"get_json_object({column}, {literal(json_path(e.path))})"
    else:
        if key is None:
            raise ExpressionError(f"no key for the encrypted field {e.name}")
        out = f"cast(aes_decrypt(unhex({dot}{quote(e.name)}), X'{fold_key(key).encode("latin-1").hex()}', 'ECB', 'PKCS') as string)"
    if e.type and not e.is_array:
        out = f"try_cast({out} as {spark_type(e.type)})"
    return out


#: Date format letters of the percent style and Spark's patterns.
_DATE = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "i": "mm", "s": "ss", "S": "ss", "M": "MMMM", "b": "MMM", "e": "d", "c": "M", "j": "DDD", "h": "hh", "I": "hh", "k": "H", "l": "h", "p": "a", "T": "HH:mm:ss", "r": "hh:mm:ss a",
    "W": "EEEE", "a": "EEE", "f": "SSSSSS",
}
#: Weeks and days with endings, for which Spark has no pattern.
_NO_DATE = frozenset("DUuVvwXx")


def _date_pattern(pattern: str) -> str:
    out = ""
    for m in re.finditer(r"%(.)|([^%]+)|%", pattern, re.DOTALL):
        if m[1] and m[1] in _NO_DATE:
            raise ExpressionError(f"no date pattern for %{m[1]}")
        if m[1] and m[1] in _DATE:
            out += _DATE[m[1]]
        else:
            text = (m[1] or m[2] or "%").replace("'", "''")
            out += f"'{text}'" if re.search(r"[A-Za-z\[\]{}#]", text) else text
    return out


def fold_key(key: str) -> str:
    """A key of any length folded to 16 bytes by exclusive or."""
    out = bytearray(16)
    for i, b in enumerate(key.encode()):
        out[i % 16] ^= b
    return out.decode("latin-1")
