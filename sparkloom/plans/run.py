"""Running documents: get, first, paginate and the dispatch among them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bind import bind
from .compile import DEFAULT_LIMIT, Query


@dataclass
class Page:
    items: DataFrame
    total: int
    page: int
    pagesize: int
    pagecnt: int
    next: int
    prev: int


def get(query: Query, params: dict | None = None) -> DataFrame:
    doc = query.document
    df = query.frame(params)
    return df if doc.get("limit") is not None or doc.get("sql") or doc.get("first") else df.limit(DEFAULT_LIMIT)


def first(query: Query, params: dict | None = None):
    rows = query.frame(params, limit=False).limit(1).collect()
    return rows[0].asDict() if rows else None


def paginate(query: Query, params: dict | None = None) -> Page:
    """One page. The document should order its rows totally, else pages may overlap."""
    doc = bind(query.document, params or {})
    page, size = max(1, int(doc.get("page") or 1)), int(doc.get("pagesize") or 0)
    size = size if size >= 1 else 20
    df = query.frame(params, limit=False)
    total = df.count()
    count = -(-total // size) if total > 0 else -1
    return Page(df.offset((page - 1) * size).limit(size), total, page, size, count, page + 1 if count <= 0 or page < count else -1, page - 1 if page > 1 else -1)


def run(query: Query, params: dict | None = None):
    doc = query.document
    if doc.get("page") is not None:
        return paginate(query, params)
    return first(query, params) if doc.get("first") else get(query, params)


def decode(df: DataFrame, schemas: dict[str, str]) -> DataFrame:
    """JSON texts of select items as values of the given types; an empty text is null, one that is no JSON an error."""
    out = {}
    for name, schema in schemas.items():
        text = F.when(F.trim(name) != "", F.col(name))
        value = F.from_json(text, schema, {"mode": "PERMISSIVE"})
        bad = text.isNotNull() & F.try_parse_json(text).isNull()
        out[name] = F.when(bad, F.raise_error(F.concat(F.lit(f"{name}: no JSON: "), text)).cast(schema)).otherwise(value)
    return df.withColumns(out)
