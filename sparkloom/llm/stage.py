"""Materialised intermediate tables, filters of fixed size and connected components."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as K

U = np.uint64
#: Bits (as a power of two) of a filter.
FILTER_BITS = 25
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset a temporary one, but only if Spark runs on this machine alone."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        found = sc._jsc.sc().getCheckpointDir()
        named = found.get() if found.isDefined() else None
    if not named:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="sparkloom-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


@atexit.register
def _tidy() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):
            discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def keep(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column of df has, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bit_filter(df: DataFrame, hashes) -> np.ndarray:
    """2**FILTER_BITS bits, of which those of hashes(batch) of all rows are set; so much reaches the driver."""

    def run(batches):
        for batch in batches:
            x = hashes(batch) >> U(64 - FILTER_BITS)
            word, bits = x >> U(6), U(1) << (x & U(63))
            order = np.argsort(word)
            word, bits = word[order], bits[order]
            at = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
            bits = np.bitwise_or.reduceat(bits, at) if len(at) else bits
            yield pa.RecordBatch.from_arrays([pa.array(word[at].astype(np.int32)), pa.array(bits.view(np.int64))], names=["word", "bits"])

    got = df.mapInArrow(run, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), U)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(U)
    return out


def holds(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which hashes a filter holds: all that were put in, and few others as long as those are few against its size."""
    x = x >> U(64 - FILTER_BITS)
    return (bits[(x >> U(6)).astype(np.int64)] >> (x & U(63))) & U(1) == 1


def _own(batch) -> np.ndarray:
    return K.mix(batch.column(0).to_numpy().view(U))


def rows_of(docs: DataFrame, ids: DataFrame, then=None, schema=None) -> DataFrame:
    """The rows of docs(doc_id, ...) with an id of ids (one column), and few others, by a scan with a filter in place of a shuffle of texts.

    then: what else to do with the batches, giving rows of schema.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(ids, _own))

    def run(batches):
        def some():
            for batch in batches:
                batch = batch.filter(batch.column("doc_id").is_valid())
                batch = batch.filter(pa.array(holds(shared.value, K.mix(batch.column("doc_id").to_numpy().view(U)))))
                if batch.num_rows:
                    yield batch

        return then(some()) if then else some()

    return docs.mapInArrow(run, schema or docs.schema)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id that links reach, for every id in edges(a, b).

    Alternating large and small stars: each round is two joins and two
    aggregations with map-side combining, and the number of rounds grows with
    the logarithm of the longest chain. Nothing goes to the driver but one
    number per round.
    """
    e = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = keep(small.select("x.u", "x.v").where("u <> v").distinct(), "edges")
        if e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError("components have not settled")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
