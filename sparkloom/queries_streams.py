"""Queries of stores on streams whose entries end by themselves, with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .queries_ops import NOW, _scratch, view
from .streaming import expiry

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_ROWS = "SELECT concat(event_type, ':', user_id % 50) AS key, concat('v', event_id) AS value, CASE WHEN event_id % 4 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' WHEN event_id % 4 = 1 THEN TIMESTAMP '2030-01-01 00:00:00' END AS expired_at, CAST(ts AS TIMESTAMP) AS updated_at FROM events"
_USES = "SELECT user_id AS session, event_type AS value, CAST(ts AS TIMESTAMP) AS updated_at FROM events"


def fed(s, rows, clock, parts: int = 3):
    """The store of rows that come in so many parts by time, each read by a query that starts from the checkpoint of the
    one before; in the end the clock is moved on."""
    at = _scratch(s)
    cuts = rows.agg(F.percentile_approx("updated_at", [k / parts for k in range(1, parts)], 10_000)).first()[0] or []
    part = F.lit(0)
    for c in cuts:
        part = part + (F.col("updated_at") > F.lit(c)).cast("int")
    tick = rows.agg(F.max("updated_at").alias("t")).select(*[(F.greatest("t", clock) if c == "updated_at" else F.lit(None)).cast(t).alias(c) for c, t in rows.dtypes])
    for k in range(parts + 1):
        (rows.where(part == k) if k < parts else tick).write.mode("append").parquet(f"{at}/in")
        query = expiry.keep(s.readStream.schema(rows.schema).parquet(f"{at}/in"), f"{at}/store", f"{at}/state", late="0 seconds")
        query.awaitTermination()
    return expiry.entries(s, f"{at}/store", clock)


def _ttl(s, d):
    return fed(s, view(s, d, _ROWS), F.expr(NOW)).select("key", "value", "expired_at")


def _sessions(s, d):
    uses = view(s, d, _USES)
    end = uses.agg(F.max("updated_at")).first()[0]
    return fed(s, expiry.sessions(uses, "session:"), F.lit(end).cast("timestamp")).select("key", "value", F.date_format("expired_at", "yyyy-MM-dd HH:mm:ss").alias("ends"))


_LAST = "row_number() OVER (PARTITION BY key ORDER BY updated_at DESC, value DESC, expired_at DESC NULLS LAST) AS rn"
QUERIES["stream_ttl_live"] = _ttl
ORACLE_SQL["stream_ttl_live"] = f"SELECT key, value, expired_at FROM (SELECT *, {_LAST} FROM ({_ROWS})) WHERE rn = 1 AND (expired_at IS NULL OR expired_at > {NOW})"
QUERIES["stream_sessions_live"] = _sessions
ORACLE_SQL["stream_sessions_live"] = f"SELECT key, value, strftime(updated_at + INTERVAL 3600 SECOND, '%Y-%m-%d %H:%M:%S') AS ends FROM (SELECT *, {_LAST.replace(', expired_at DESC NULLS LAST', '')} FROM (SELECT concat('session:', session) AS key, value, updated_at FROM ({_USES}))) WHERE rn = 1 AND updated_at + INTERVAL 3600 SECOND > (SELECT max(CAST(ts AS TIMESTAMP)) FROM events)"
