"""An inverted file over dense vectors: cells of k-means, rows stored by cell, searches that read few cells.

Building. Cells are learned by k-means on a sample of expected `sample` rows (SAMPLE by default, all rows where there are
fewer); every row is stored in the partition of its nearest cell. Large cells are several files, as rows are dealt out by
ranges of (cell, slot). For each cell its centre, number of rows and radius (greatest distance of a row from the centre)
are kept. The number of cells is the root of the number of rows, up to LISTS, and fewer where centres would take over
CENTRES bytes. How many cells a search probes is measured on the sample: the fewest that hold TARGET of true neighbours.

Searching. `search` reads the cells nearest to each query. `exact` goes on with every cell whose bound (by radius) says
that it may hold a better row than the k-th found, so its rows are those of a search of everything. Rows and queries of a
cell meet in pieces of at most CHUNK rows and about QUERIES queries, whatever a cell's size; nothing passes through the
driver but the centres and two numbers a cell.

Defined cases: rows and queries whose vector is null, has another length than most or a component that is null or not
finite take no part; a zero vector has the cosine 0 to all; ties go to the smaller key; repeated rows are found each; an
empty table gives an empty index, whose searches find nothing; fewer than k rows give all.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAMPLE = 200_000
#: Rows of the sample that the number of probes is measured on (the driver reads these alone), and queries among them.
MEASURED, ASKED = 4096, 256
LISTS = 4096
CENTRES = 64 << 20
TARGET = 0.95
CHUNK, QUERIES = 8192, 1024
#: Queries that are measured against all centres at once, bytes of the copies of their vectors that are sent at once.
ASKED_AT_ONCE, PAIRS = 256, 4 << 20
#: Queries whose products with a piece of rows are held at once.
ROUGH = 64
ROWS_A_FILE = 1 << 20
METRICS = ("cosine", "dot", "euclidean")


def _usable(vector: str, dim: int) -> Column:
    good = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce((F.size(vector) == dim) & good, F.lit(False))


def _placed(vector: Column, metric: str) -> Column:
    """The vector by which cells are chosen: of length 1 for the cosine."""
    v = vector.cast("array<double>")
    if metric != "cosine":
        return v
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), float).reshape(-1, dim)


def _near(q: np.ndarray, centres: np.ndarray, metric: str) -> np.ndarray:
    """How near each cell is to each query: the more the nearer."""
    if metric == "euclidean":
        return -np.sqrt(np.maximum((q * q).sum(1)[:, None] + (centres * centres).sum(1) - 2 * q @ centres.T, 0.0))
    return q @ centres.T


def _bounds(q: np.ndarray, centres: np.ndarray, radius: np.ndarray, metric: str) -> np.ndarray:
    """The best score that a row of each cell may have, rounding included."""
    near = _near(q, centres, metric)
    length = np.sqrt((q * q).sum(1))[:, None]
    room = 1e-7 * (1.0 + length * (np.sqrt((centres * centres).sum(1)) + radius))
    if metric == "euclidean":
        room = 1e-6 * (1.0 + length + np.sqrt((centres * centres).sum(1)) + radius)
        return np.minimum(near + radius, 0.0) + room
    return near + length * radius + room


def scores(q: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """Scores of rows for one query; equal rows have equal scores wherever they stand."""
    if metric == "euclidean":
        return -np.sqrt(((rows - q) ** 2).sum(1))
    s = (rows * q).sum(1)
    if metric == "dot":
        return s
    norm = np.sqrt((rows * rows).sum(1)) * np.sqrt((q * q).sum())
    return np.divide(s, norm, out=np.zeros(len(rows)), where=norm > 0)


def build(rows: DataFrame, path: str, lists: int | None = None, metric: str = "cosine", vector: str = "embedding", key: str = "vec_id", sample: int = SAMPLE, dim: int | None = None, seed: int = 7) -> Index:
    """Writes an index of rows under path, with all their columns."""
    if metric not in METRICS:
        raise ValueError(f"metric is one of {METRICS}")
    if clash := {"__cell", "__slot"} & set(rows.columns):
        raise ValueError(f"columns that the index needs: {sorted(clash)}")
    spark = rows.sparkSession
    dim = dim or rows.where(F.size(vector) > 0).agg(F.mode(F.size(vector))).first()[0] or 0
    good = rows.where(_usable(vector, dim))
    n = good.count()
    placed = good.withColumn("__p", array_to_vector(_placed(F.col(vector), metric)))
    lists = max(1, min(lists or round(math.sqrt(n)), LISTS, CENTRES // (8 * max(dim, 1))))
    share = min(1.0, sample / max(n, 1))
    drawn = placed.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) < int(share * (1 << 30))).select(key, "__p").persist()
    # a table whose few keys all miss the sample is learned from as a whole
    drawn = drawn if not n or drawn.limit(1).count() else placed.select(key, "__p").persist()
    if n:
        # the solver by rows, as that by blocks fails where there are fewer distinct vectors than cells
        model = KMeans(k=max(2, lists), maxIter=15, seed=seed, featuresCol="__p", predictionCol="__cell", solver="row").fit(drawn)
        centres = np.array(model.clusterCenters(), float)
        celled = model.transform(placed)
    else:
        centres, celled = np.zeros((0, dim)), placed.withColumn("__cell", F.lit(0))
    probes = _measure(drawn, centres, metric, key) if n else 1
    drawn.unpersist()
    # slots say nothing but the piece of a cell that a row is in, so repeated rows part as well
    slots = celled.drop("__p").withColumn("__slot", F.xxhash64(F.monotonically_increasing_id()))
    files = max(1, -(-n // ROWS_A_FILE), min(len(centres), 8))
    slots.repartitionByRange(files, "__cell", "__slot").write.partitionBy("__cell").parquet(f"{path}/rows")
    if n:
        stored = spark.read.schema(f"{_ddl(slots, '__cell')}, __cell int").parquet(f"{path}/rows")
        table = F.broadcast(spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "__cell int, __c array<double>"))
        off = F.sqrt(F.aggregate(F.zip_with(_placed(F.col(vector), metric), "__c", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
        cells = {r[0]: (r[1], r[2]) for r in stored.join(table, "__cell").groupBy("__cell").agg(F.count("*"), F.max(off)).collect()}
    else:
        cells = {}
    about = [(i, c.tolist(), *map(lambda x, t: t(x), cells.get(i, (0, 0.0)), (int, float))) for i, c in enumerate(centres)]
    spark.createDataFrame(about, "cell int, centre array<double>, n bigint, radius double").coalesce(1).write.parquet(f"{path}/cells")
    said = {"metric": metric, "vector": vector, "key": key, "dim": dim, "probes": probes, "schema": _ddl(slots, "__cell")}
    # written last: an index without it is none
    spark.createDataFrame([(json.dumps(said),)], "about string").coalesce(1).write.text(f"{path}/about")
    return Index(spark, path)


def _ddl(df: DataFrame, leave: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != leave)


def _measure(drawn: DataFrame, centres: np.ndarray, metric: str, key: str, k: int = 10) -> int:
    """The fewest cells that hold TARGET of the k nearest of a query, over queries of the sample and neighbours in it."""
    x = np.array([r[0].toArray() for r in drawn.orderBy(F.xxhash64(F.lit(1), key)).limit(MEASURED).select("__p").collect()], float)
    q = x[:ASKED]
    s = _near(q, x, metric)
    s[np.arange(len(q)), np.arange(len(q))] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return 1
    best = np.argpartition(-s, k - 1, axis=1)[:, :k]
    cell = _near(x, centres, "euclidean").argmax(1)
    place = np.argsort(np.argsort(-_near(q, centres, metric), axis=1), axis=1)
    at = np.sort(np.take_along_axis(place, cell[best], axis=1).ravel())
    return int(at[min(len(at) - 1, math.ceil(TARGET * len(at)) - 1)]) + 1


def _spread(batches, ids: np.ndarray, centres: np.ndarray, radius: np.ndarray, metric: str, probes: int, beyond: bool, pairs: int):
    """Queries and the cells that each asks, at most `pairs` rows at once, as a query's vector is copied once a cell."""
    for whole in batches:
        for b in (whole.slice(i, ASKED_AT_ONCE) for i in range(0, whole.num_rows if len(ids) else 0, ASKED_AT_ONCE)):
            p = _matrix(b.column("__p"), centres.shape[1])
            order = np.argsort(-_near(p, centres, metric), axis=1, kind="stable")
            hit = np.zeros(order.shape, bool)
            np.put_along_axis(hit, order[:, :probes], True, axis=1)
            if beyond:
                floor = np.array([-np.inf if x is None else x for x in b.column("__least").to_pylist()])
                hit = ~hit & (_bounds(p, centres, radius, metric) >= floor[:, None])
            row, cell = np.nonzero(hit)
            for i in range(0, len(row), pairs):
                at = pa.array(row[i : i + pairs])
                yield pa.RecordBatch.from_arrays([b.column("query_id").take(at), b.column("query").take(at), pa.array(ids[cell[i : i + pairs]].astype(np.int32))], ["query_id", "query", "__cell"])


class Index:
    """An index that build has written."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.about = json.loads(spark.read.text(f"{path}/about").first()[0])
        cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
        self.dim, self.metric, self.key, self.vector = (self.about[k] for k in ("dim", "metric", "key", "vector"))
        self.probes = self.about["probes"]
        self.centres = np.array([c["centre"] for c in cells], float).reshape(len(cells), self.dim)
        self.sizes = np.array([c["n"] for c in cells], np.int64)
        self.radius = np.array([c["radius"] for c in cells], float)

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        """What is stored, or what is stored in some cells: no other files are read."""
        df = self.spark.read.schema(f"{self.about['schema']}, __cell int").parquet(f"{self.path}/rows")
        return df if cells is None else df.where(F.col("__cell").isin(cells))

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, where: Column | None = None, least: float | None = None) -> DataFrame:
        """(query_id, rank, key, score) of queries(query_id, query): the k best rows in the nearest cells, of rows that a
        condition holds for and that have a score of at least `least`. A row may be its own query's neighbour."""
        return self._ranked(self._found(self._probed(queries, probes or self.probes), k, where, least), k)

    def exact(self, queries: DataFrame, k: int = 10, where: Column | None = None, least: float | None = None) -> DataFrame:
        """As search, with the rows of a search of everything."""
        first = self.search(queries, k, None, where, least).persist()
        floor = first.where(F.col("rank") == k).select(F.col("query_id"), F.col("score").alias("__least"))
        rest = self._found(self._probed(queries.join(floor, "query_id", "left"), self.probes, True), k, where, least)
        return self._ranked(first.drop("rank").unionByName(rest), k)

    def _ranked(self, found: DataFrame, k: int) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), self.key)
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", self.key, "score")

    def _probed(self, queries: DataFrame, probes: int, beyond: bool = False) -> DataFrame:
        """(query_id, query, cell): the nearest cells, or beyond them those that may hold better rows than the k-th."""
        metric, dim = self.metric, self.dim
        full = self.sizes > 0
        ids, centres, radius = np.flatnonzero(full), self.centres[full], self.radius[full]
        kind, pairs = dict(queries.dtypes)["query_id"], max(1, PAIRS // (8 * max(dim, 1)))

        def cells(batches):
            return _spread(batches, ids, centres, radius, metric, probes, beyond, pairs)

        good = queries.where(_usable("query", dim)).select("query_id", F.col("query").cast("array<double>").alias("query"), _placed(F.col("query"), metric).alias("__p"), *(["__least"] if beyond else []))
        return good.mapInArrow(cells, f"query_id {kind}, query array<double>, __cell int")

    def _found(self, probed: DataFrame, k: int, where: Column | None, least: float | None) -> DataFrame:
        """(query_id, key, score): the k best of every piece of a probed cell."""
        asked = {r[0]: r[1] for r in probed.groupBy("__cell").count().collect()}
        kinds = dict(self.rows().dtypes)
        qkind = dict(probed.dtypes)["query_id"]
        pieces = [(c, max(1, -(-int(self.sizes[c]) // CHUNK)), max(1, -(-m // QUERIES))) for c, m in sorted(asked.items())]
        table = F.broadcast(self.spark.createDataFrame(pieces, "__cell int, __parts int, __blocks int"))
        rows = self.rows([c for c, _, _ in pieces])
        rows = rows if where is None else rows.where(where)
        left = rows.select("__cell", F.col(self.key).alias("__key"), F.col(self.vector).cast("array<double>").alias("__v"), "__slot").join(table, "__cell")
        left = left.select("__cell", F.pmod("__slot", "__parts").cast("int").alias("__part"), F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)).alias("__block"), "__key", "__v")
        right = probed.join(table, "__cell").select("__cell", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("__part"), F.pmod(F.xxhash64("query_id"), F.col("__blocks")).cast("int").alias("__block"), "query_id", "query")
        metric, dim, name = self.metric, self.dim, self.key

        def best(rows: pa.Table, queries: pa.Table) -> pa.Table:
            kq, kk = queries.column("query_id"), rows.column("__key")
            qs, vs = _matrix(queries.column("query"), dim), _matrix(rows.column("__v"), dim)
            which, take, score = [], [], []
            if len(vs):
                rank = np.empty(len(vs), np.int64)
                rank[np.asarray(pa.compute.sort_indices(kk))] = np.arange(len(vs))
                length = np.sqrt((vs * vs).sum(1))
                for i, (q, rough) in enumerate(zip(qs, (r for at in range(0, len(qs), ROUGH) for r in _rough(qs[at : at + ROUGH], vs, length, metric)), strict=True)):
                    # the block's products choose who may be among the k best; scores are then summed alike for all
                    slack = 1e-9 * (1.0 + np.abs(rough).max())
                    may = np.arange(len(vs)) if len(vs) <= k else np.flatnonzero(rough >= np.partition(rough, len(vs) - k)[len(vs) - k] - slack)
                    s = scores(q, vs[may], metric)
                    o = np.lexsort((rank[may], -s))[:k]
                    o = o if least is None else o[s[o] >= least]
                    which.append(np.full(len(o), i))
                    take.append(may[o])
                    score.append(s[o])
            which, take, score = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((which, int), (take, int), (score, float)))
            return pa.table({"query_id": kq.take(pa.array(which)), name: kk.take(pa.array(take)), "score": pa.array(score)})

        on = ["__cell", "__part", "__block"]
        return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(best, f"query_id {qkind}, `{self.key}` {kinds[self.key]}, score double")


def _rough(q: np.ndarray, v: np.ndarray, length: np.ndarray, metric: str) -> np.ndarray:
    """Numbers in the order of the scores, but for rounding."""
    s = q @ v.T
    if metric == "cosine":
        return np.divide(s, length, out=np.zeros_like(s), where=length > 0)
    return s if metric == "dot" else s - 0.5 * length * length
