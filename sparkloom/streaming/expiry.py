"""Key-value stores on streams whose entries end by themselves.

A stream of rows (key, ..., expired_at, updated_at) becomes a table of the latest live row of each key. The state of a key
is its latest row and a timer; the state store is on disk, so that neither keys nor rows need fit in memory.

The order of a key's rows is updated_at, which is the event time too. An entry's timer is set to the later of its two
times: when it fires, the watermark has passed updated_at, so every older row of the key is late and dropped, and no
older row can bring an entry back. Rows later than `late` behind the newest are dropped, as watermarks do.

Defined cases: rows without updated_at take no part; rows without a key only move the clock; an entry that is already over
when it arrives replaces what is there and ends at once; of rows of one time the greatest one stays (nulls are least), as
in kv.put; an entry without expired_at stays for ever; a batch that runs again writes the same place.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from .tables import COMPACT, batches, sweep

#: What a session is kept for after its last use, in seconds.
SESSION = 3600
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Entries(StatefulProcessor):
    """The latest row of a key, until its end; gives out changes: the new row, or the old one marked as gone."""

    def __init__(self, names: list[str], schema: StructType):
        self.names, self.schema = names, schema
        self.change = Row("key", *names, "gone")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", self.schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[0] is None:
            for _ in rows:
                pass
            return
        old = self.entry.get()
        best = old = None if old is None else tuple(old)
        for row in rows:
            new = tuple(row[n] for n in self.names)
            if best is None or _after(new, best):
                best = new
        if best == old:
            return
        if old is not None and old[1] is not None:
            self.handle.deleteTimer(old[1])
        if best[1] is not None:
            self.handle.registerTimer(best[1])
        self.entry.update(best)
        yield self.change(*key, *best, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        old = self.entry.get()
        # a timer of a row that has been replaced since says nothing
        if old is not None and old[1] == expiredTimerInfo.getExpiryTimeInMs():
            self.entry.clear()
            yield self.change(*key, *old, True)

    def close(self) -> None:
        pass


def _after(a: tuple, b: tuple) -> bool:
    def rank(t):
        return tuple((x is not None, x) for x in (t[0], *t[2:]))

    return rank(a) > rank(b)


def changes(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream's changes to the store: its columns and gone. Needs key, expired_at and updated_at; other columns may be
    of any type that can be compared."""
    times = [f.name for f in stream.schema if f.dataType.typeName() == "timestamp"]
    if not {"expired_at", "updated_at"} <= set(times):
        raise ValueError("expired_at and updated_at are timestamps")
    rest = [c for c in stream.columns if c not in ("key", "updated_at")]
    end = F.when(F.col("expired_at").isNotNull(), F.unix_millis(F.greatest("updated_at", "expired_at")))
    # times go through Python as whole numbers, which no time zone touches; a timer's milliseconds are rounded up
    end = F.when(F.unix_micros(F.greatest("updated_at", "expired_at")) % 1000 > 0, end + 1).otherwise(end)
    rows = stream.where("updated_at IS NOT NULL").withWatermark("updated_at", late)
    rows = rows.select(
        "key", "updated_at", F.unix_micros("updated_at").alias("__order"), end.alias("__end"),
        *[(F.unix_micros(c) if c in times else F.col(c)).alias(f"__{i}") for i, c in enumerate(rest)],
    )
    names = ["__order", "__end", *[f"__{i}" for i in range(len(rest))]]
    fields = {f.name: f.dataType for f in rows.schema}
    schema = StructType([StructField(n, fields[n]) for n in names])
    out = StructType([StructField("key", fields["key"]), *schema.fields, StructField("gone", BooleanType())])
    assert isinstance(fields["__order"], LongType)
    done = rows.groupBy("key").transformWithState(Entries(names, schema), out, "Update", "EventTime")
    back = [(F.timestamp_micros(f"__{i}") if c in times else F.col(f"__{i}")).alias(c) for i, c in enumerate(rest)]
    return done.select("key", *back, F.timestamp_micros("__order").alias("updated_at"), "gone").select(*stream.columns, "gone")


def keep(stream: DataFrame, path: str, checkpoint: str, late: str = "1 hour", compact: int = COMPACT):
    """A streaming query that keeps a store under path. A batch writes its changes; every compact-th writes all that is
    live, and what no reader or rerun needs any more is deleted."""
    spark = stream.sparkSession

    def write(batch: DataFrame, epoch: int) -> None:
        full = epoch % compact == compact - 1
        table = batch
        if full:
            before = _changes(spark, path, epoch)
            table = _fold(batch if before is None else before.unionByName(batch)).withColumn("gone", F.lit(False))
        table.write.mode("overwrite").parquet(f"{path}/{'full' if full else 'delta'}-{epoch}")
        if full:
            sweep(spark, path)

    writer = changes(stream, late).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STORE)
    try:
        return writer.start()  # the query keeps the settings it is started with
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _changes(spark, path: str, before: int | None = None) -> DataFrame | None:
    found = [(n, kind) for n, kind in batches(spark, path) if before is None or n < before]
    last = max((n for n, kind in found if kind == "full"), default=-1)
    parts = [f"{path}/{kind}-{n}" for n, kind in found if n > last or (n == last and kind == "full")]
    return spark.read.parquet(*parts) if parts else None


def _fold(rows: DataFrame) -> DataFrame:
    rest = [c for c in rows.columns if c not in ("key", "updated_at", "gone", "expired_at")]
    # of one entry the row that says it is gone is the later one
    newest = rows.groupBy("key").agg(F.max(F.struct("updated_at", *[c for c in rows.columns if c in rest or c == "expired_at"], "gone")).alias("__x"))
    return newest.where("NOT __x.gone").select(*[F.col("key") if c == "key" else F.col(f"__x.{c}").alias(c) for c in rows.columns if c != "gone"])


def entries(spark, path: str, now: Column | None = None) -> DataFrame | None:
    """The store after the last batch, and of it what is live at a time; None before the first batch."""
    rows = _changes(spark, path)
    if rows is None:
        return None
    table = _fold(rows)
    return table if now is None else table.where(F.col("expired_at").isNull() | (F.col("expired_at") > now))


def sessions(uses: DataFrame, prefix: str = "", seconds: int = SESSION) -> DataFrame:
    """Rows of a store from uses(session, ..., updated_at): a session ends so many seconds after its last use."""
    rest = [c for c in uses.columns if c not in ("session", "updated_at")]
    return uses.select(F.concat(F.lit(prefix), F.col("session").cast("string")).alias("key"), *rest, (F.col("updated_at") + F.make_dt_interval(secs=F.lit(float(seconds)).cast("decimal(18,6)"))).alias("expired_at"), "updated_at")
