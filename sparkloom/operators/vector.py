"""Vector search over a table of dense vectors: exact, by Spark expressions, and by block products for many queries."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_RESULTS = 1000


def _sum(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), f), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: x * y)


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ or a vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(a, b, lambda x, y: (x - y) * (x - y)))


def manhattan(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: F.abs(x - y))


#: Scores: the more the better, so distances count negatively.
METRICS = {"cosine": cosine, "dot": dot, "euclidean": lambda a, b: -euclidean(a, b), "manhattan": lambda a, b: -manhattan(a, b)}


def metadata_filter(conditions: dict) -> Column:
    """All of the equalities; values that are no string, number or truth value are left out, none left is an error."""
    parts = [F.col(k) == F.lit(v) for k, v in conditions.items() if isinstance(v, (str, int, float, bool))]
    if not parts:
        raise ValueError("no usable condition")
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def scored(rows: DataFrame, query: list[float], metric: str = "cosine", vector: str = "embedding") -> DataFrame:
    return rows.withColumn("score", METRICS[metric](F.col(vector), F.lit([float(x) for x in query]).cast("array<double>")))


def top_k(rows, query, k: int = 10, metric: str = "cosine", least: float | None = None, page: int = 1, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    df = scored(rows, query, metric, vector)
    if least is not None:
        df = df.filter(F.col("score") >= least)
    return df.orderBy(F.desc("score"), key).offset((max(1, page) - 1) * k).limit(min(k, MAX_RESULTS))


def threshold(rows, query, least: float, metric: str = "cosine", vector: str = "embedding") -> DataFrame:
    return scored(rows, query, metric, vector).filter(F.col("score") >= least)


#: Bytes of a piece of rows and of a block of queries that meet in a group, queries that are multiplied at once.
PIECE, BLOCK, AT_ONCE = 4 << 20, 8 << 20, 64


def batch_top_k(rows: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", vector: str = "embedding", key: str = "vec_id", broadcast_rows: int = 20_000) -> DataFrame:
    """queries(query_id, query). A stated query set against all rows. Rows and queries meet in groups of a piece of rows and a
    block of queries, both bounded by bytes; a group multiplies them, chooses who may be among the k best of a query and
    scores these as METRICS does, number for number. Rows and queries whose vector is null, of another length than most
    or has components that are null, not finite or extreme are scored by the expression itself, against queries that
    are broadcast in blocks of broadcast_rows."""
    dim = rows.where(F.size(vector) > 0).agg(F.mode(F.size(vector))).first()[0] or 0
    good, fit = rows.where(_plain(vector, dim)), queries.where(_plain("query", dim))
    odd, other = rows.where(~_plain(vector, dim)), queries.where(~_plain("query", dim))
    n, m = good.count(), fit.count()
    out = _by_blocks(good, fit, n, m, dim, k, metric, vector, key)
    for some, asked in ((odd, queries), (good, other)):
        if some.isEmpty():
            continue
        blocks = -(-asked.count() // broadcast_rows)
        for b in range(blocks):
            part = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
            out = out.unionByName(some.select(key, vector).crossJoin(F.broadcast(part)).select("query_id", key, METRICS[metric](F.col(vector), F.col("query")).alias("score")))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _plain(vector: str, dim: int) -> Column:
    """Whether the products of a vector's components are neither infinite nor vanish."""
    fine = F.forall(vector, lambda x: F.coalesce((x == 0) | F.abs(x).cast("double").between(1e-100, 1e100), F.lit(False)))
    return F.coalesce((F.size(vector) == dim) & F.lit(dim > 0) & fine, F.lit(False))


def _numbers(vector: str, kind: str) -> Column:
    return F.col(vector) if kind in ("array<float>", "array<double>") else F.col(vector).cast("array<double>")


def _by_blocks(rows: DataFrame, queries: DataFrame, n: int, m: int, dim: int, k: int, metric: str, vector: str, key: str) -> DataFrame:
    """(query_id, key, score): the k best of every piece of rows."""
    parts, blocks = (max(1, -(-count * 8 * max(dim, 1) // size)) for count, size in ((n, PIECE), (m, BLOCK)))
    kinds, qkinds = dict(rows.dtypes), dict(queries.dtypes)
    piece = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int")
    left = rows.select(piece.alias("__part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("__block"), F.col(key).alias("__key"), _numbers(vector, kinds[vector]).alias("__v"))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("__part"), block.alias("__block"), "query_id", _numbers("query", qkinds["query"]).alias("query"))

    def best(rows: pa.Table, queries: pa.Table) -> pa.Table:
        kq, kk = queries.column("query_id"), rows.column("__key")
        q, v = (_columns(c, dim) for c in (queries.column("query"), rows.column("__v")))
        order = np.empty(len(kk), np.int64)
        order[np.asarray(pc.sort_indices(kk, null_placement="at_start"))] = np.arange(len(kk))
        lq, lv = (np.sqrt(_fold(x, x)) for x in (q, v))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for at in range(0, len(kq) if len(kk) and k > 0 else 0, AT_ONCE):
            i, j = _candidates(q[:, at : at + AT_ONCE], v, lq[at : at + AT_ONCE], lv, k, metric)
            i = i + at
            s = _exact(q, v, i, j, lq, lv, metric)
            o = np.lexsort((order[j], -s, i))
            i, j, s = i[o], j[o], s[o]
            first = np.arange(len(i)) - np.searchsorted(i, i) < k
            found.append((i[first], j[first], s[first]))
        i, j, s = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"query_id": kq.take(pa.array(i)), key: kk.take(pa.array(j)), "score": pa.array(s)})

    on = ["__part", "__block"]
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(best, f"query_id {qkinds['query_id']}, `{key}` {kinds[key]}, score double")


def _columns(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Vectors as a matrix with a row a component."""
    return np.ascontiguousarray(np.asarray(column.combine_chunks().flatten(), float).reshape(-1, dim).T)


def _fold(a: np.ndarray, b: np.ndarray, i=slice(None), j=slice(None)) -> np.ndarray:
    """Inner products, summed in the order of the components."""
    s = 0.0
    for x, y in zip(a, b, strict=True):
        s = s + x[i] * y[j]
    return s


def _candidates(q: np.ndarray, v: np.ndarray, lq: np.ndarray, lv: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a query and a row that may be among its k best: a rough score not under the k-th by more than rounding."""
    if metric == "manhattan":
        rough, slack = np.zeros((q.shape[1], v.shape[1])), 1e-9 * (np.abs(q).sum(0) + np.abs(v).sum(0).max())
        for x, y in zip(q, v, strict=True):
            rough -= np.abs(x[:, None] - y)
    else:
        rough, slack = q.T @ v, 1e-9 * lq * lv.max()
        if metric == "cosine":
            rough, slack = np.divide(rough, lv, out=np.zeros_like(rough), where=lv > 0), 1e-9 * lq
        elif metric == "euclidean":
            rough, slack = rough - 0.5 * lv * lv, 1e-9 * (lq + lv.max()) ** 2
    at = v.shape[1] - min(k, v.shape[1])
    return np.nonzero(rough >= np.partition(rough, at, axis=1)[:, at : at + 1] - slack[:, None])


def _exact(q: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray, lq: np.ndarray, lv: np.ndarray, metric: str) -> np.ndarray:
    """Scores of pairs, as METRICS has them."""
    if metric in ("euclidean", "manhattan"):
        s = np.zeros(len(i))
        for x, y in zip(q, v, strict=True):
            off = y[j] - x[i]
            s = s + (off * off if metric == "euclidean" else np.abs(off))
        return -(np.sqrt(s) if metric == "euclidean" else s)
    s = _fold(q, v, i, j)
    norm = lq[i] * lv[j]
    return s if metric == "dot" else np.divide(s, norm, out=np.zeros(len(s)), where=norm > 0)


def mmr(rows, query, k: int = 10, fetch: int | None = None, trade: float = 0.5, metric: str = "cosine", vector: str = "embedding", key: str = "vec_id") -> list[tuple[int, float]]:
    """Maximal marginal relevance over the fetch (3k by default) best candidates; at most MAX_RESULTS reach the driver."""
    fetch = min(fetch or (3 * k if k else 30), MAX_RESULTS)
    cand = top_k(rows, query, fetch, metric, vector=vector, key=key).select(key, "score", vector).collect()
    if k >= len(cand):
        return [(r[key], r["score"]) for r in cand]
    x = np.array([r[vector] for r in cand], float)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    score, left, taken = np.array([r["score"] for r in cand]), list(range(1, len(cand))), [0]
    while left and len(taken) < k:
        worst = np.maximum((unit[left] @ unit[taken].T).max(axis=1), 0.0)
        taken.append(left.pop(int(np.argmax(trade * score[left] - (1 - trade) * worst))))
    return [(cand[i][key], float(score[i])) for i in taken]


def fuse(a: DataFrame, b: DataFrame, limit: int, how: str = "rrf", key: str = "vec_id", constant: int = 60) -> DataFrame:
    """Two result lists (key, score) in one. rrf: sum of 1 / (constant + rank); dbsf: scores scaled by mean and three deviations, summed."""
    def ranked(df):
        if how == "rrf":
            return df.select(key, (1.0 / (constant + F.row_number().over(Window.orderBy(F.desc("score"), key)))).alias("s"))
        stats = df.agg(F.avg("score").alias("m"), F.stddev_samp("score").alias("d"))
        scaled = F.when(F.col("d") > 0, (F.col("score") - (F.col("m") - 3 * F.col("d"))) / (6 * F.col("d"))).otherwise(0.5)
        return df.crossJoin(F.broadcast(stats)).select(key, F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)).alias("s"))

    both = ranked(a.orderBy(F.desc("score"), key).limit(2 * limit)).unionByName(ranked(b.orderBy(F.desc("score"), key).limit(2 * limit)))
    return both.groupBy(key).agg(F.sum("s").alias("score")).orderBy(F.desc("score"), key).limit(limit)


def scroll(rows: DataFrame, limit: int, cursor: int | None = None, key: str = "vec_id") -> DataFrame:
    """A page by key and, as the last row of limit + 1, where the next one begins."""
    df = rows if cursor is None else rows.filter(F.col(key) >= cursor)
    return df.orderBy(key).limit(limit + 1)


# ---- sparse vectors: struct<indices: array<bigint>, values: array<double>> ----


def sparse(dense: Column, least: float) -> Column:
    """The components of a dense vector that are at least so large, as a sparse one."""
    parts = F.filter(F.transform(dense, lambda x, i: F.struct(i.cast("long").alias("i"), x.cast("double").alias("x"))), lambda p: F.abs(p["x"]) >= least)
    return F.struct(F.transform(parts, lambda p: p["i"]).alias("indices"), F.transform(parts, lambda p: p["x"]).alias("values"))


def sparse_dot(vector: Column, indices: list[int], values: list[float]) -> Column:
    """Inner product with a stated sparse vector; indices that either lacks count as 0."""
    if len(indices) != len(values) or len(set(indices)) != len(indices):
        raise ValueError("one value for each of distinct indices")
    if not indices:
        return F.lit(0.0)
    query = F.create_map(*[F.lit(x) for i, v in zip(indices, values, strict=True) for x in (int(i), float(v))])
    parts = F.zip_with(vector["indices"], vector["values"], lambda i, v: v * F.coalesce(F.try_element_at(query, i.cast("int")), F.lit(0.0)))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def hybrid(rows: DataFrame, dense: list[float] | None = None, query: tuple[list[int], list[float]] | None = None, limit: int = 10, how: str = "rrf", vector: str = "embedding", sparse_vector: str = "sparse", metric: str = "cosine", key: str = "vec_id") -> DataFrame:
    """Dense and sparse search in one: each takes its 2 * limit best, and the lists are fused. A sparse vector that shares no index
    with the query is not found by it. With one of the two queries only, that list alone is fused."""
    if dense is None and query is None:
        raise ValueError("a dense or a sparse query is needed")
    limit = min(limit if limit > 0 else 10, MAX_RESULTS)
    found = []
    if dense is not None:
        found.append(scored(rows, dense, metric, vector).select(key, "score"))
    if query is not None:
        meets = F.arrays_overlap(F.col(sparse_vector)["indices"], F.array(*[F.lit(int(i)).cast("long") for i in query[0]]))
        found.append(rows.filter(meets).select(key, sparse_dot(F.col(sparse_vector), *query).alias("score")))
    return fuse(found[0], found[1] if len(found) > 1 else found[0].limit(0), limit, how, key)


# ---- pages, several searches, and changes of a collection ----


@dataclass
class Found:
    """A page of results and what is said of it; next_cursor is the key at which the next page begins."""

    items: DataFrame
    page: int = 0
    pagesize: int = 10
    total: int | None = None
    pages: int | None = None
    has_next: bool = False
    has_previous: bool = False
    next_page: int | None = None
    previous_page: int | None = None
    next_cursor: object = None


def page_of(rows: DataFrame, orders: list, page: int = 1, pagesize: int = 10, total: bool = True) -> Found:
    """A page of rows in a total order. Whether there is a next one comes from the true count, or without it from one row more."""
    page, size = max(1, page), pagesize if pagesize > 0 else 10
    items = rows.orderBy(*orders).offset((page - 1) * size).limit(size)
    if total:
        n = rows.count()
        more, count = page * size < n, -(-n // size)
    else:
        n = count = None
        more = rows.orderBy(*orders).offset(page * size).limit(1).count() > 0
    return Found(items, page, size, n, count, more, page > 1, page + 1 if more else None, page - 1 if page > 1 else None)


def cursor_page(rows: DataFrame, limit: int = 20, cursor=None, key: str = "id", most: int = 100) -> Found:
    """Rows after a cursor (the last key of the page before), limit (20 by default, at most 100) of them."""
    limit = min(limit if limit > 0 else 20, most)
    df = rows if cursor is None else rows.filter(F.col(key) > F.lit(cursor))
    ahead = [r[0] for r in df.select(key).orderBy(key).limit(limit + 1).collect()]
    more = len(ahead) > limit
    return Found(df.orderBy(key).limit(limit), pagesize=limit, has_next=more, has_previous=cursor is not None, next_cursor=ahead[limit - 1] if more else None)


def scroll_page(rows: DataFrame, limit: int = 100, cursor=None, order: str | None = None, key: str = "vec_id") -> Found:
    """A page of limit rows, by key or, on a first page only, by one field ("field" or "field:desc"); next_cursor is the row after it."""
    limit = limit if limit > 0 else 100
    name, _, way = (order or "").partition(":")
    by = [F.desc(name) if way.lower() == "desc" else F.asc(name), key] if name and cursor is None else [key]
    df = rows if cursor is None else rows.filter(F.col(key) >= F.lit(cursor))
    ahead = [r[0] for r in df.select(key, *([name] if name and name != key else [])).orderBy(*by).limit(limit + 1).collect()]
    more = len(ahead) > limit
    return Found(df.orderBy(*by).limit(limit), pagesize=limit, has_next=more, has_previous=cursor is not None, next_cursor=ahead[limit] if more else None)


def multi_search(searches: dict[str, DataFrame]) -> DataFrame:
    """Named searches of one form as one table with the column search; Spark runs them side by side."""
    out = None
    for name, df in searches.items():
        one = df.withColumn("search", F.lit(name))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no search")
    return out


def upsert(rows: DataFrame, new: DataFrame, key: str = "vec_id") -> DataFrame:
    """The collection with new rows in place of those of the same key. Of several new rows of a key the greatest by the other
    columns stays; a column that new rows lack is null in them."""
    rest = [c for c in new.columns if c != key]
    one = new.groupBy(key).agg(F.max(F.struct(*rest)).alias("__x")).select(key, *[F.col(f"__x.{c}").alias(c) for c in rest]) if rest else new.distinct()
    return rows.join(one.select(key), key, "left_anti").select(*rows.columns).unionByName(one, allowMissingColumns=True)


def delete(rows: DataFrame, ids: list | None = None, where: dict | None = None, key: str = "vec_id", dry_run: bool = False) -> DataFrame:
    """The collection without these ids, or without what fulfils all equalities; a dry run counts what would go."""
    if (ids is None) == (where is None):
        raise ValueError("ids or where")
    hit = F.coalesce(F.col(key).isin(list(ids)) if where is None else metadata_filter(where), F.lit(False))
    return rows.filter(hit).agg(F.count("*").alias("n")) if dry_run else rows.filter(~hit)


def update_metadata(rows: DataFrame, changes: DataFrame, key: str = "vec_id") -> DataFrame:
    """The collection with the columns of changes(key, ...) set where a key is there; keys that are not are left out."""
    named = changes.select(F.col(key), F.struct(*[c for c in changes.columns if c != key]).alias("__new"))
    named = named.groupBy(key).agg(F.max("__new").alias("__new"))
    fields = [c for c in changes.columns if c != key]
    return rows.join(named, key, "left").select(*[F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns])
