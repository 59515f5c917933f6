"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

Rotations of the centred principal components are learned (iterative
quantisation) on a bounded sample; the signs of the rotated vector are its code
of BITS bits (vectors of fewer components are rotated several times). Codes are
cut into substrings, each with its own inverted index. A code within Hamming
radius R of the query's is within a smaller radius in one substring at least, so
probing each index for the values within that radius and checking the whole code
of what it gives retrieves every code within R; these are ranked by the exact
inner product.

R is the RECALL quantile of the codes' distances between sample rows and their
true neighbours in the sample. Codes are cut into as many substrings as leave the
probed share of the sample under PROBED: many short ones, probed by flipping bits,
where neighbours are close; few long ones, probed by comparing the index's values,
where they are far, as in data without any structure. Vectors of each length have
an index of their own.

Queries meet the index in blocks: a shard of index rows and a block of queries,
both bounded, are one task's work. A query that finds fewer than k is searched
again in all rows.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stage import keep

#: Rows that rotations and radius are learned on; rows of a shard and of a query block; bits of a code.
SAMPLE, SHARD, BLOCK, BITS = 8_000, 65_536, 16_384, 256
#: Shards have at least so many rows, and vectors of a length with fewer rows than that are compared without an index.
LEAST_SHARD, FEW = 4_096, 256
RECALL, PROBED = 0.97, 0.2
#: Numbers that a step holds at once.
_STEP = 4_000_000


class MultiIndex:
    """Codes of a shard: for each substring its values, in order, and the rows that have them."""

    def __init__(self, codes: np.ndarray, cuts: int = 8):
        self.codes, self.cuts = codes.reshape(len(codes), -1), cuts
        self.width = self.codes.shape[1] * 8 // cuts
        self.values, self.which = [], []
        for own in self._parts(self.codes):
            order = np.lexsort(own.T[::-1])
            new = np.concatenate([[True], (own[order][1:] != own[order][:-1]).any(axis=1)])[: len(order)]
            which = np.empty(len(order), np.int64)
            which[order] = np.cumsum(new) - 1
            self.values.append(own[order[new]]), self.which.append(which)

    def _parts(self, codes: np.ndarray) -> list[np.ndarray]:
        """Each substring as one or more words a row."""
        kind = np.dtype(f"u{min(8, self.width)}")
        flat = np.ascontiguousarray(codes).view(kind)
        return np.split(flat, self.cuts, axis=1) if flat.shape[1] else [flat] * self.cuts

    def probe(self, queries: np.ndarray, radius: int) -> np.ndarray:
        """Which rows (columns) are within a substring's share of the radius of each query (rows)."""
        got = np.zeros((len(queries), len(self.codes)), bool)
        whole, over = divmod(radius, self.cuts)
        for j, own in enumerate(self._parts(queries)):
            # over + 1 substrings are probed at the whole share of the radius, the others at one less
            near = whole if j <= over else whole - 1
            if near < 0 or not len(self.codes):
                continue
            values, bits = self.values[j], 8 * self.width
            if bits <= 64 and (n := sum(comb(bits, i) for i in range(min(near, bits) + 1))) <= len(values) // 8:
                masks = np.array([sum(1 << b for b in c) for i in range(near + 1) for c in combinations(range(bits), i)], own.dtype)
                asked = own ^ masks[None, :]
                at = np.minimum(np.searchsorted(values[:, 0], asked), len(values) - 1)
                hit = np.zeros((len(queries), len(values)), bool)
                q = np.repeat(np.arange(len(queries)), n).reshape(at.shape)
                good = values[at, 0] == asked
                hit[q[good], at[good]] = True
            else:
                apart = np.zeros((len(queries), len(values)), np.uint16)
                for w in range(values.shape[1]):
                    apart += np.bitwise_count(own[:, w, None] ^ values[None, :, w])
                hit = apart <= near
            got |= hit[:, self.which[j]]
        return got

    def pairs(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of all codes at most radius bits apart."""
        q, row = np.nonzero(self.probe(queries, radius))
        apart = np.zeros(len(q), np.uint16)
        for w in range(self.codes.shape[1]):
            apart += np.bitwise_count(queries[q, w] ^ self.codes[row, w])
        return q[apart <= radius], row[apart <= radius]

    def within(self, code, radius: int) -> np.ndarray:
        """Rows whose code is at most radius bits from the given one."""
        return self.pairs(np.asarray(code, np.uint64).reshape(1, -1), radius)[1]


class Coder:
    """Centre, rotations, search radius and the number of substrings."""

    def __init__(self, x: np.ndarray, k: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.scale = np.abs(x).max() or 1.0
        c = x / self.scale
        self.mean = c.mean(axis=0)
        c -= self.mean
        kept = min(BITS, x.shape[1])
        values, vectors = np.linalg.eigh(c.T @ c)
        p = vectors[:, np.argsort(-values, kind="stable")[:kept]]
        v, turns = c @ p, []
        for _ in range(-(-BITS // kept)):
            r = np.linalg.qr(rng.normal(size=(kept, kept)))[0]
            for _ in range(30):
                u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
                r = (u @ w).T
            turns.append(p @ r)
        self.turn = np.concatenate(turns, axis=1)[:, :BITS]
        own = self.code(x)
        q = np.arange(0, len(x), max(1, len(x) // 400))
        score = (x[q] / self.scale) @ (x / self.scale).T
        score[np.arange(len(q)), q] = -np.inf
        near = np.argsort(-score, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
        apart = np.bitwise_count(own[q][:, None] ^ own[near]).sum(axis=2)
        self.radius = int(np.quantile(apart, RECALL, method="higher")) if apart.size else BITS
        for self.cuts in (32, 16, 8, 4, 2, 1):
            self.probed = float(MultiIndex(own, self.cuts).probe(own[q], self.radius).mean())
            if self.probed <= PROBED:
                break

    def code(self, x: np.ndarray) -> np.ndarray:
        on = ((x / self.scale - self.mean) @ self.turn) > 0
        return np.packbits(on, axis=1, bitorder="little").view(np.uint64)



def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


OUT = "query_id long, vec_id long, score double"


def _search(shared, k: int):
    """shared: the coder, None where all rows are compared."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """left: queries; right: index rows."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            q, x = _matrix(left.column("v")), _matrix(right.column("v"))
            qid, xid = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
            coder = shared.value if shared else None
            if coder:
                codes, index = coder.code(q), MultiIndex(coder.code(x), coder.cuts)
            step = max(1, _STEP // len(x))
            for a in range(0, len(q), step):
                own = np.arange(a, min(a + step, len(q)))
                i, j = index.pairs(codes[own], coder.radius) if coder else (np.repeat(np.arange(len(own)), len(x)), np.tile(np.arange(len(x)), len(own)))
                i = own[i]
                on = qid[i] != xid[j]
                i, j = i[on], j[on]
                size = max(1, _STEP // x.shape[1])
                score = np.concatenate([np.zeros(0), *((q[i[b : b + size]] * x[j[b : b + size]]).sum(axis=1) for b in range(0, len(i), size))])
                order = np.lexsort((xid[j], -score, i))
                i, j, score = i[order], j[order], score[order]
                first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])[: len(i)])
                rank = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
                on = rank < k
                out.append((qid[i[on]], xid[j[on]], score[on]))
        query, vec, score = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"query_id": pa.array(query), "vec_id": pa.array(vec), "score": pa.array(score)})

    return run


def _blocks(queries: DataFrame, rows: DataFrame, nq: int, nx: int, run) -> DataFrame:
    """queries and rows (vec_id, v, n) of a length n (or of several with few rows) against each other."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(-(-nx // SHARD), min(tasks, -(-nx // LEAST_SHARD)))
    blocks = max(1, -(-nq // BLOCK))
    left = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = rows.withColumn("shard", F.pmod(F.hash("vec_id"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    key = ["n", "shard", "block"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, OUT)


def nearest(table: DataFrame, queries: str = "vec_id % 20 = 0", k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest rows of table(vec_id, embedding, ...).

    queries: SQL that picks the query rows. Nearness is the largest inner product
    of the original vectors in double precision; ties go to the smaller vec_id.
    Rows with a null vec_id or a vector that is null, empty, zero or holds null
    or non-finite components take no part. Vectors of different lengths have no
    inner product: each length is searched by itself. Rows that repeat a vec_id
    are one row (the vector least in order). All candidates come back where there
    are fewer than k; an empty table gives an empty result. Other columns are
    ignored.
    """
    spark = table.sparkSession
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), fine.alias("fine")).where("vec_id is not null and fine").groupBy("vec_id").agg(F.min("v").alias("v"))
    rows = keep(rows.withColumn("n", F.size("v")), "vectors")
    asked = rows.where(queries)
    # one row a length of vectors
    lengths = {r["n"]: (r["rows"], r["asked"] or 0) for r in rows.groupBy("n").agg(F.count("*").alias("rows"), F.sum(F.when(F.expr(queries), 1)).alias("asked")).collect()}
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    few = [n for n, (nx, _) in lengths.items() if nx < FEW]
    parts = []
    if few:
        some = F.col("n").isin(few)
        parts.append(_blocks(asked.where(some), rows.where(some), FEW, FEW, _search(None, k)))
    for n, (nx, nq) in lengths.items():
        if nx >= FEW and nq:
            own = rows.where(F.col("n") == n)
            sample = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
            coder = spark.sparkContext.broadcast(Coder(_matrix(sample.column("v")), k))
            parts.append(_blocks(asked.where(F.col("n") == n), own, nq, nx, _search(coder, k)))
    found = parts[0] if parts else spark.createDataFrame([], OUT)
    for part in parts[1:]:
        found = found.unionByName(part)
    found = keep(found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), "found")
    got = asked.join(found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("got")), "vec_id", "left")
    size = F.create_map(*[F.lit(x) for n, (nx, _) in lengths.items() for x in (n, nx)])
    short = keep(got.where(F.coalesce("got", F.lit(0)) < F.least(F.lit(k), size[F.col("n")] - 1)).drop("got"), "short")
    if count := short.count():
        again = _blocks(short, rows, count, max(nx for nx, _ in lengths.values()), _search(None, k))
        again = again.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        found = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_mih_search(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def brute_force(x: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int = 20) -> dict[int, list[int]]:
    """The true neighbours of queries (positions in x), for tests."""
    out = {}
    for i in queries:
        score = (x * x[i]).sum(axis=1)
        score[ids == ids[i]] = -np.inf
        out[int(ids[i])] = ids[np.lexsort((ids, -score))[: min(k, len(ids) - 1)]].tolist()
    return out
