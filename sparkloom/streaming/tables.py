"""Streams into tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import kv


#: Every so many batches one is written together with all before it.
COMPACT = 16


def upsert_kv(stream: DataFrame, path: str, checkpoint: str, compact: int = COMPACT):
    """A streaming query that keeps the latest row of each key of a stream with the KV columns.

    Batch n is written as delta-n, its own latest rows only; every compact-th as full-n, with all before it. A batch that
    is run again writes the same place. current(path) puts the last full one and the deltas after it together.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, epoch: int) -> None:
        full = epoch % compact == compact - 1
        before = current(spark, path, epoch) if full else None
        table = kv.put(batch.limit(0), batch) if before is None else kv.put(before, batch)
        table.write.mode("overwrite").parquet(f"{path}/{'full' if full else 'delta'}-{epoch}")
        if full:
            sweep(spark, path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batches(spark, path: str) -> list[tuple[int, str]]:
    """(number, kind) of the batches written, in order."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName().partition("-") for s in fs.listStatus(p) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))] if fs.exists(p) else []
    return sorted((int(n), kind) for kind, _, n in names if kind in ("full", "delta") and n.isdigit())


def sweep(spark, path: str) -> None:
    """Deletes batches before the last full one but one. What is between the last two stays: a rerun of the last batch
    begins with it, and so may readers that have listed it already."""
    found = batches(spark, path)
    fulls = [n for n, kind in found if kind == "full"]
    if len(fulls) < 2:
        return
    jvm = spark.sparkContext._jvm
    for n, kind in found:
        if n < fulls[-2]:
            p = jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}-{n}")
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def current(spark, path: str, before: int | None = None) -> DataFrame | None:
    """The table after the last batch, or after the last one before that of a number; None where there is none."""
    found = [(n, kind) for n, kind in batches(spark, path) if before is None or n < before]
    last = max((n for n, kind in found if kind == "full"), default=-1)
    parts = [f"{path}/{kind}-{n}" for n, kind in found if n > last or (n == last and kind == "full")]
    if not parts:
        return None
    rows = spark.read.parquet(*parts)
    return rows if len(parts) == 1 else kv.put(rows.limit(0), rows)


def window_counts(events: DataFrame, minutes: int = 60, late: str = "1 hour") -> DataFrame:
    """Events by tumbling window and type; works on streams (with a watermark) and on tables."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("ts", late)
    return e.groupBy(F.window("ts", f"{minutes} minutes"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
