"""Scalar functions on text: validation, similarity, JSON, code blocks, chunks, diffs."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EMAIL = r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$"
#: The forms of mobile numbers.
MOBILE = {"cn": r"^1[3-9]\d{9}$", "us": r"^[0-9]{3}-[0-9]{3}-[0-9]{4}$"}


def validator(method: str, column: Column, *args) -> Column:
    """True where a value is valid; a null is (only supplied values are checked)."""
    check = {
        "min": lambda: column >= args[0],
        "max": lambda: column <= args[0],
        "enum": lambda: column.isin(list(args)),
        "pattern": lambda: column.rlike(args[0]),
        "minLength": lambda: F.length(column) >= args[0],
        "maxLength": lambda: F.length(column) <= args[0],
        "email": lambda: column.rlike(EMAIL),
        "mobile": lambda: column.rlike("|".join(MOBILE[a] for a in args or ("cn",))),
        "typeof": lambda: F.typeof(column).isin(_KINDS[args[0]]),
    }[method]()
    return F.coalesce(check, F.lit(True))


_KINDS = {"string": ["string"], "integer": ["int", "bigint", "smallint", "tinyint"], "float": ["double", "float"], "number": ["int", "bigint", "smallint", "tinyint", "double", "float"], "bool": ["boolean"], "datetime": ["timestamp", "timestamp_ntz", "date"]}


def violations(rules: list[tuple[str, str, tuple, str]]) -> Column:
    """Messages of the rules (column, method, args, message) that a row breaks."""
    return F.filter(F.array(*[F.when(~validator(m, F.col(c), *a), F.lit(msg)) for c, m, a, msg in rules]), lambda x: x.isNotNull())


def word_similarity(a: Column, b: Column) -> Column:
    """2 * common / (words of a + words of b), lower-cased; common counts words of b that a has."""
    x, y = (F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "") for c in (a, b))
    total = F.size(x) + F.size(y)
    return F.when(total > 0, 2.0 * F.size(F.filter(y, lambda w: F.array_contains(x, w))) / total).otherwise(0.0)


def hash_id(c: Column) -> Column:
    """The first 8 bytes of MD5 as an unsigned number."""
    return F.conv(F.substring(F.md5(c), 1, 16), 16, 10).cast("decimal(20,0)")


def json_is_valid(c: Column) -> Column:
    """One JSON value and nothing after it: the parser stops at the end of the first, so it is read as a list's only item."""
    one = F.concat(F.lit("["), c, F.lit("]"))
    return F.coalesce(F.try_parse_json(one).isNotNull() & (F.json_array_length(one) == 1), F.lit(False))


def detect_format(c: Column) -> Column:
    t = F.trim(c)
    jsonish = t.startswith("{") | t.startswith("[")
    return F.when(jsonish & json_is_valid(t), "json").when(jsonish, "jsonc").otherwise("yaml")


def strip_comments(text: str) -> str:
    """JSON without // and /* */ comments outside strings."""
    return re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.DOTALL)


def _mapped(f, column) -> Column:
    """A text function without a built-in form, by Arrow batches."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else f(t))

    return F.pandas_udf(run, "string")(column)


def json_strip_comments(column) -> Column:
    return _mapped(strip_comments, column)


_TOKEN = re.compile(r'''\s+|//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\])*"?|'(?:\\.|[^'\\])*'?|[{}\[\],:]|[^\s{}\[\],:"']+''', re.DOTALL)
_WORDS = {"true": "true", "false": "false", "null": "null", "None": "null", "True": "true", "False": "false", "undefined": "null"}


def repair_json(text: str):
    """A value from JSON with comments, single quotes, bare keys and words, missing or trailing commas, or brackets left open or closed by the wrong kind."""
    try:
        return json.loads(text)
    except ValueError:
        pass
    out, open_ = [], []
    for token in _TOKEN.findall(text):
        if token.isspace() or token.startswith(("//", "/*")):
            continue
        if token in "}]":
            while out and out[-1] == ",":
                out.pop()
            if out and out[-1] == ":":
                out.append("null")
            # a bracket of the other kind closes what stands open within its own
            if token in open_:
                while open_[-1] != token:
                    out.append(open_.pop())
                out.append(open_.pop())
            continue
        if token == "," and (not out or out[-1] in ",{[:"):
            continue
        if token not in ",:" and out and out[-1] not in ",{[:":
            out.append(",")
        if token in "{[":
            open_.append("}" if token == "{" else "]")
        elif token[0] in "\"'":
            body = token[1:-1] if len(token) > 1 and token[-1] == token[0] else token[1:]
            token = json.dumps(json.loads('"' + re.sub(r'(\\.)|(")', lambda m: m[1].replace("\\'", "'") if m[1] else '\\"', body).replace("\n", "\\n").replace("\t", "\\t") + '"'))
        elif token not in ",:":
            try:
                json.loads(token)
            except ValueError:
                token = _WORDS.get(token) or json.dumps(token)
        out.append(token)
    while out and out[-1] == ",":
        out.pop()
    if out and out[-1] == ":":
        out.append("null")
    try:
        return json.loads("".join(out + open_[::-1]))
    except ValueError:
        raise ValueError("cannot be repaired") from None


def json_repair(column) -> Column:
    """Repaired JSON as text; null where it cannot be."""

    def fix(text: str):
        try:
            return json.dumps(repair_json(text), ensure_ascii=False)
        except (ValueError, RecursionError):
            return None

    return _mapped(fix, column)


BLOCK = r"(?s)```(\w*)[ \t]*\n?(.*?)\n?```"


def code_blocks(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, pos, type, content): fenced blocks in order, or the whole text as one text block."""
    kinds, bodies = (F.regexp_extract_all(column, F.lit(BLOCK), F.lit(i)) for i in (1, 2))
    found = F.when(F.size(kinds) > 0, F.arrays_zip(kinds.alias("type"), bodies.alias("content"))).otherwise(F.array(F.struct(F.lit("text").alias("type"), F.trim(column).alias("content"))))
    return df.select(key, F.posexplode(found).alias("pos", "x")).select(key, "pos", F.when(F.col("x.type") == "", "text").otherwise(F.col("x.type")).alias("type"), "x.content")


def detect_language(c: Column) -> Column:
    """A guess at the language of a snippet from its first five lines; the first rule that fits."""
    head = F.lower(F.array_join(F.slice(F.split(c, "\n"), 1, 5), "\n"))
    t = F.trim(head)
    rules = [
        ("json", t.rlike(r"^[\[{]")), ("html", t.rlike(r"<!doctype html|<html|<div|<body")), ("xml", t.startswith("<?xml")), ("sql", t.rlike(r"^\s*(select|insert|update|delete|create)\s")), ("python", t.rlike(r"(?m)^(def |import |from \w+ import|class \w+.*:)")),
        ("go", t.rlike(r"(?m)^(package |func )")), ("javascript", t.rlike(r"(?m)^\s*(const |let |var |function )|=>")), ("markdown", t.rlike(r"(?m)^#{1,6} ")), ("yaml", t.rlike(r"(?m)^[\w-]+:\s")),
    ]
    out = F.when(rules[0][1], rules[0][0])
    for name, cond in rules[1:]:
        out = out.when(cond, name)
    return out.otherwise("text")


def markdown(html: str) -> str:
    """A small HTML to Markdown conversion: headings, emphasis, links, items, paragraphs."""
    import html as H

    t = re.sub(r"(?is)<(script|style|head)\b.*?</\1>|<!--.*?-->", "", html)
    t = re.sub(r"(?is)<h([1-6])[^>]*>(.*?)</h\1>", lambda m: "\n\n" + "#" * int(m[1]) + " " + m[2] + "\n\n", t)
    t = re.sub(r'(?is)<a\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>', r"[\2](\1)", t)
    t = re.sub(r"(?is)<(b|strong)>(.*?)</\1>", r"**\2**", t)
    t = re.sub(r"(?is)<(i|em)>(.*?)</\1>", r"*\2*", t)
    t = re.sub(r"(?i)<li[^>]*>", "\n- ", t)
    t = re.sub(r"(?i)<br\s*/?>", "\n", t)
    t = re.sub(r"(?i)</?(p|div|ul|ol|table|tr|article|section|nav|footer|header)[^>]*>", "\n\n", t)
    return re.sub(r"\n{3,}", "\n\n", H.unescape(re.sub(r"<[^>]+>", "", t))).strip()


def html_to_markdown(column) -> Column:
    return _mapped(markdown, column)


def make_patch(a: str, b: str, context: int = 3) -> str:
    """The unified difference that makes b of a; empty where they are equal."""
    import difflib

    return "".join(line if line.endswith("\n") else line + "\n\\ No newline at end of file\n" for line in difflib.unified_diff(_lines(a), _lines(b), "a", "b", n=context))


def _lines(text: str) -> list[str]:
    return re.findall(r"[^\n]*\n|[^\n]+$", text)


def apply_patch(text: str, patch: str) -> tuple[str, list[bool]]:
    """The text with the hunks of a unified difference, and which of them applied: each at its place or at the nearest one where
    its old lines stand, else not at all."""
    lines, shift, done = _lines(text), 0, []
    for hunk in re.split(r"(?m)^(?=@@ )", patch)[1:]:
        head, *body = hunk.splitlines(keepends=True)
        old, new = [], []
        for line in body:
            if line.startswith("\\"):
                for side in sides:
                    side[-1] = side[-1].removesuffix("\n")
                continue
            sides = [side for side, marks in ((old, " -"), (new, " +")) if line[0] in marks]
            for side in sides:
                side.append(line[1:])
        first = int(re.match(r"@@ -(\d+)", head)[1])
        want = max(0, first - (1 if old else 0)) + shift
        places = [i for i in range(len(lines) - len(old) + 1) if lines[i : i + len(old)] == old]
        done.append(bool(places))
        if places:
            at = min(places, key=lambda i: abs(i - want))
            lines[at : at + len(old)] = new
            shift += len(new) - len(old)
    return "".join(lines), done


def xml_encode(data: dict) -> str:
    """A flat map as elements of <xml>, a line each, in the order of the map."""
    from xml.sax.saxutils import escape

    return "<xml>\n" + "\n".join(f"    <{k}>{escape(str(v))}</{k}>" for k, v in data.items()) + "\n</xml>"


def xml_decode(text: str) -> dict:
    """A document as nested maps: repeated elements are lists, attributes have a minus before their names, text beside them is #text."""
    import xml.etree.ElementTree as ET

    if "<!DOCTYPE" in text.upper():
        raise ValueError("document types are not read")

    def value(e):
        out: dict = {f"-{k}": v for k, v in e.attrib.items()}
        for c in e:
            v = value(c)
            out[c.tag] = [*(out[c.tag] if isinstance(out[c.tag], list) else [out[c.tag]]), v] if c.tag in out else v
        words = (e.text or "").strip()
        if not out:
            return words
        return {**out, "#text": words} if words else out

    root = ET.fromstring(text)
    return {root.tag: value(root)}


def schema_errors(value, schema, place: str = "$") -> list[str]:
    """What a value breaks of a JSON schema: type, enum, const, bounds, lengths, pattern, items, properties, required,
    additionalProperties, uniqueItems, allOf, anyOf, oneOf, not."""
    if isinstance(schema, bool):
        return [] if schema else [f"{place}: nothing is allowed"]
    out, number = [], isinstance(value, (int, float)) and not isinstance(value, bool)
    kinds = {"object": isinstance(value, dict), "array": isinstance(value, list), "string": isinstance(value, str), "number": number, "integer": number and float(value).is_integer(), "boolean": isinstance(value, bool), "null": value is None}
    wanted = schema.get("type")
    if wanted is not None and not any(kinds[k] for k in ([wanted] if isinstance(wanted, str) else wanted)):
        return [f"{place}: not of type {wanted}"]

    def check(ok, what):
        if not ok:
            out.append(f"{place}: {what}")

    same = lambda a, b: json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True)
    if "enum" in schema:
        check(any(same(value, v) for v in schema["enum"]), "not one of enum")
    if "const" in schema:
        check(same(value, schema["const"]), "not the constant")
    if number:
        for k, f in (("minimum", lambda a, b: a >= b), ("maximum", lambda a, b: a <= b), ("exclusiveMinimum", lambda a, b: a > b), ("exclusiveMaximum", lambda a, b: a < b), ("multipleOf", lambda a, b: float(a / b).is_integer())):
            check(k not in schema or f(value, schema[k]), k)
    for kind, low, high in ((str, "minLength", "maxLength"), (list, "minItems", "maxItems"), (dict, "minProperties", "maxProperties")):
        if isinstance(value, kind):
            check(schema.get(low, 0) <= len(value) <= schema.get(high, len(value)), f"{low} or {high}")
    if isinstance(value, str) and "pattern" in schema:
        check(re.search(schema["pattern"], value), "pattern")
    if isinstance(value, list):
        if schema.get("uniqueItems"):
            check(len({json.dumps(v, sort_keys=True) for v in value}) == len(value), "uniqueItems")
        for i, v in enumerate(value):
            out += schema_errors(v, schema.get("items", True), f"{place}[{i}]")
    if isinstance(value, dict):
        own = schema.get("properties", {})
        for k in schema.get("required", []):
            check(k in value, f"{k} is required")
        for k, v in value.items():
            out += schema_errors(v, own.get(k, schema.get("additionalProperties", True)), f"{place}.{k}")
    for s in schema.get("allOf", []):
        out += schema_errors(value, s, place)
    if "anyOf" in schema:
        check(any(not schema_errors(value, s) for s in schema["anyOf"]), "anyOf")
    if "oneOf" in schema:
        check(sum(not schema_errors(value, s) for s in schema["oneOf"]) == 1, "oneOf")
    if "not" in schema:
        check(schema_errors(value, schema["not"]), "not")
    return out


def json_matches(column, schema: dict) -> Column:
    """True where a text is JSON that a schema allows; null for null."""

    def one(text: str) -> bool:
        try:
            return not schema_errors(json.loads(text), schema)
        except ValueError:
            return False

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else one(t)).astype("object")

    return F.pandas_udf(run, "boolean")(column)


def replace_blocks(text: str, patch: str) -> str:
    """SEARCH/REPLACE blocks in order, each at its first place; one that is missing is an error."""
    for a, b in re.findall(r"<{5,} SEARCH\n(.*?)\n?={5,}\n(.*?)\n?>{5,} REPLACE", patch, re.DOTALL):
        if a not in text:
            raise ValueError(f"not found: {a[:40]!r}")
        text = text.replace(a, b, 1)
    return text


#: Bytes of the pieces that a text is cut into, and these again, before windows are: cutting copies the whole of what it cuts from.
LEVELS = (8 << 20, 256 << 10, 8 << 10)


def _cutter(by: int, length: int):
    """The piece with a number, of pieces that begin so many bytes apart."""
    return lambda i: F.struct(i.alias("i"), F.col("__w").substr(i * by + 1, F.lit(length)).alias("w"))


def _windows(df: DataFrame, column: str, size: int, overlap: int) -> DataFrame:
    """A row of each window of bytes of a text, with the columns of df but the text, __w (its bytes), index, start, stop.

    A text is cut into pieces of whole windows, these into smaller ones, and so on to the windows, each time as
    an array that is exploded. So no row of a window carries its text, and time grows with the text's length.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be under size")
    step = size - overlap
    rest = [c for c in df.columns if c != column]
    n = F.octet_length(F.col(column))
    count = F.when(n <= size, F.when(n > 0, 1)).otherwise(F.ceil((n - overlap) / F.lit(step)).cast("int"))
    at = df.select(*rest, F.encode(F.col(column), "UTF-8").alias("__w"), n.cast("long").alias("__n"), F.lit(0).alias("__from"), count.alias("__to")).where("__to > 0")
    for many in sorted({max(1, b // step) for b in LEVELS} | {1}, reverse=True):
        last = ((F.col("__to") - F.col("__from") - 1) / many).cast("int")
        at = at.select(*rest, "__n", "__from", "__to", F.explode(F.transform(F.sequence(F.lit(0), last), _cutter(many * step, (many - 1) * step + size))).alias("__x"))
        first = F.col("__from") + F.col("__x.i") * many
        at = at.select(*rest, "__n", F.col("__x.w").alias("__w"), first.alias("__from"), F.least(F.col("__to"), first + many).alias("__to"))
    start = F.col("__from").cast("long") * step
    return at.select(*rest, F.col("__from").alias("index"), "__w", start.alias("start"), F.least(start + size, F.col("__n")).alias("stop"))


#: Hex of what a window holds of characters cut at its edges: bytes that go on with a character before it, and one begun at its end.
_HEAD, _TAIL = "^([89AB][0-9A-F])+", "([CD][0-9A-F]|E[0-9A-F]([89AB][0-9A-F])?|F[0-7]([89AB][0-9A-F]){0,2})$"
_HEAD_BYTES = f"(CASE WHEN substring(__w, 1, 1) < X'80' THEN 0 ELSE length(regexp_extract(hex(substring(__w, 1, 3)), '{_HEAD}', 0)) div 2 END)"
_TAIL_BYTES = f"(CASE WHEN substring(__w, -1, 1) < X'80' THEN 0 ELSE length(regexp_extract(hex(substring(__w, greatest(octet_length(__w) - 2, 1))), '{_TAIL}', 0)) div 2 END)"


def _piece() -> Column:
    return F.expr(f"decode(substring(__w, cast({_HEAD_BYTES} + 1 as int), cast(octet_length(__w) - {_HEAD_BYTES} - {_TAIL_BYTES} as int)), 'UTF-8')")


def _feeds(data: str) -> Column:
    """Line feeds of bytes; no other character's bytes hold theirs."""
    return F.expr(f"cast(octet_length({data}) - octet_length(replace(cast({data} as string), '\n', '')) as long)")


def fixed_chunks(df: DataFrame, key: str, column: str, size: int, overlap: int = 0) -> DataFrame:
    """(key, index, start, stop, text): windows of bytes of the whole text; characters cut at the edges go from text. Null and empty texts have none."""
    return _windows(df.select(key, column), column, size, overlap).select(key, "index", "start", "stop", _piece().alias("text"))


def line_chunks(df: DataFrame, key: str, column: str, size: int, overlap: int = 0) -> DataFrame:
    """(key, index, start, stop, start_line, end_line): the lines (from 1) that each window of bytes begins and ends on. Rows that share a key and a text count once."""
    cut = _windows(df.select(key, column, F.xxhash64(column).alias("__h")).distinct(), column, size, overlap)
    before = Window.partitionBy(key, "__h").orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    line = F.lit(1) + F.coalesce(F.sum(_feeds(f"substring(__w, 1, {size - overlap})")).over(before), F.lit(0))
    return cut.select(key, "index", "start", "stop", line.alias("start_line"), (line + _feeds("__w")).alias("end_line"))


def chunk_options(kind: str) -> dict:
    """Size, overlap and depth by kind of text."""
    return {"size": 800, "overlap": 100, "depth": 3} if kind in ("code", "json") else {"size": 300, "overlap": 20, "depth": 1}


def chunk_tree(df: DataFrame, key: str, column: str, size: int = 300, overlap: int = 20, depth: int = 1, factor: int = 3) -> DataFrame:
    """Chunks of all levels: (key, id, parent_id, parents, depth, index, leaf, root, status, start, stop, start_line, end_line, text).

    Level 1 has the largest windows, each cut again into those of the next level, down to the base size at level depth.
    A chunk no longer than the next level's size is a leaf and is not cut again. start and stop are bytes of the whole text,
    lines count from 1; id is key:path, parents the ids from the root down; a leaf is completed, others are pending.
    Rows that share a key and a text have the same chunks, once each; null and empty texts have none."""
    sizes = chunk_sizes(size, depth, factor)
    level = df.where(F.octet_length(column) > 0).select(key, F.col(column).alias("text"), F.lit("").alias("path"), F.array().cast("array<string>").alias("parents"), F.lit(0).cast("long").alias("from"), F.lit(1).cast("long").alias("line")).distinct()
    out = None
    for d, width in enumerate(sizes, 1):
        step = width - overlap
        cut = _windows(level.withColumn("__h", F.xxhash64("text")), "text", width, overlap)
        # line feeds of each window's own step, summed over the windows before it
        feeds = _feeds(f"substring(__w, 1, {step})")
        before = Window.partitionBy(key, "path", "__h").orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
        cut = cut.withColumn("line", F.col("line") + F.coalesce(F.sum(feeds).over(before), F.lit(0)))
        cut = cut.withColumn("text", _piece()).withColumn("__lines", _feeds("__w"))
        head = F.expr(_HEAD_BYTES)
        name = F.concat("path", F.when(F.col("path") == "", "").otherwise("."), F.col("index").cast("string"))
        leaf = F.lit(True) if d == depth else F.octet_length("text") <= sizes[d]
        made = cut.select(
            key, F.concat(F.col(key).cast("string"), F.lit(":"), name).alias("id"), F.element_at("parents", -1).alias("parent_id") if d > 1 else F.lit(None).cast("string").alias("parent_id"), "parents", F.lit(d).alias("depth"), "index", leaf.alias("leaf"), F.lit(d == 1).alias("root"),
            F.when(leaf, "completed").otherwise("pending").alias("status"), (F.col("from") + F.col("start")).alias("start"), (F.col("from") + F.col("stop")).alias("stop"), F.col("line").alias("start_line"), (F.col("line") + F.col("__lines")).alias("end_line"), "text", name.alias("path"), head.alias("__head"),
        )
        out = made.drop("path", "__head") if out is None else out.unionByName(made.drop("path", "__head"))
        # places in a piece count from behind the bytes cut off its beginning
        level = made.where(~F.col("leaf")).select(key, "text", "path", F.concat("parents", F.array("id")).alias("parents"), (F.col("start") + F.col("__head")).alias("from"), F.col("start_line").alias("line"))
    return out


def complete_parents(chunks: DataFrame) -> DataFrame:
    """Chunks of a tree with every parent completed whose children all are, from the lowest level up (at most 5 levels)."""
    out = chunks
    for d in range(4, 0, -1):
        done = out.where(F.col("depth") == d + 1).groupBy(F.col("parent_id").alias("__id")).agg(F.bool_and(F.col("status") == "completed").alias("__all")).where("__all")
        out = out.join(done, (F.col("id") == F.col("__id")) & (F.col("depth") == d), "left").withColumn("status", F.when(F.col("__all"), "completed").otherwise(F.col("status"))).drop("__id", "__all")
    return out


def chunk_sizes(size: int, depth: int, factor: int = 3) -> list[int]:
    """Sizes of the levels from the root (level 1) to the leaves (level `depth`, the base size)."""
    if not 1 <= depth <= 5:
        raise ValueError("depth is 1 to 5")
    return [size * max(1, (depth - d) * factor) for d in range(1, depth + 1)]


def grouped_chunks(chunks: DataFrame, key: str, width: int) -> DataFrame:
    """Parents of `width` consecutive chunks each, texts joined by line feeds."""
    g = chunks.groupBy(key, F.floor(F.col("index") / width).cast("int").alias("parent")).agg(F.sort_array(F.collect_list(F.struct("index", "text"))).alias("x"), F.min("start").alias("start"), F.max("stop").alias("stop"))
    return g.select(key, "parent", "start", "stop", F.array_join(F.transform("x", lambda c: c["text"]), "\n").alias("text"))
