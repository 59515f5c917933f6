"""Stores on streams whose entries end by themselves, against a plain replay."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.streaming import expiry
from sparkloom.streaming.tables import batches

T0 = dt.datetime(2024, 3, 1)
SCHEMA = "key string, value string, n bigint, expired_at timestamp, updated_at timestamp"


def at(minutes):
    return None if minutes is None else T0 + dt.timedelta(minutes=minutes)


def feed(spark, folder, rows, **more):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    query = expiry.keep(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in"), f"{folder}/store", f"{folder}/state", **more)
    query.awaitTermination()
    return {r["key"]: r for r in expiry.entries(spark, f"{folder}/store").collect()}


def test_against_a_replay(spark, tmp_path):
    """Batches in order of time, a restart before each; what is left is what a replay leaves, without a look at the clock."""
    rng = random.Random(5)
    latest, clock = {}, 0
    for b in range(5):
        rows = []
        for _ in range(60):
            t = rng.randint(b * 100 + 1, b * 100 + 99)
            key, life = f"k{rng.randint(0, 12)}", rng.choice([None, -30, 5, 150, 400])
            rows.append((key, f"v{rng.randint(0, 9)}", rng.choice([None, 1, 2**62 + 1]), at(None if life is None else t + life), at(t)))
        rows.append((None, None, None, None, at((b + 1) * 100)))
        clock = at((b + 1) * 100)
        got = feed(spark, str(tmp_path), rows, late="0 seconds", compact=3)
        for key, value, n, end, t in rows:
            rank = (t, value, (n is not None, n or 0), (end is not None, end or T0))
            if key and (key not in latest or rank > latest[key][0]):
                latest[key] = (rank, (value, n, end))
        want = {k: v for k, (_, v) in latest.items() if v[2] is None or v[2] > clock}
        assert {k: (r["value"], r["n"], r["expired_at"]) for k, r in got.items() if r["expired_at"] != clock} == want
    kinds = batches(spark, f"{tmp_path}/store")
    assert kinds[0][1] == "full" and sum(k == "full" for _, k in kinds) == 2


def test_late_rows_bring_nothing_back(spark, tmp_path):
    feed(spark, str(tmp_path), [("a", "old", 1, at(10), at(5)), ("b", "stays", 1, None, at(5)), (None, None, None, None, at(60))], late="0 seconds")
    got = feed(spark, str(tmp_path), [("a", "late", 1, at(500), at(4)), ("c", "now", 1, at(500), at(61)), ("d", "no time", 1, None, None)], late="0 seconds")
    assert sorted(got) == ["b", "c"]


def test_empty_and_wrong_inputs(spark, tmp_path):
    assert expiry.entries(spark, f"{tmp_path}/none") is None
    assert feed(spark, str(tmp_path), []) == {}
    with pytest.raises(ValueError):
        expiry.changes(spark.createDataFrame([], "key string, expired_at string, updated_at timestamp"))


def test_sessions(spark):
    uses = spark.createDataFrame([(7, "x", at(0)), (None, "y", at(1))], "session bigint, value string, updated_at timestamp")
    rows = expiry.sessions(uses, "s:").collect()
    assert rows[0]["key"] == "s:7" and rows[0]["expired_at"] == at(60) and rows[1]["key"] is None


def test_nothing_gone_is_live(spark, tmp_path):
    """The clock of entries() cuts what no batch has ended yet."""
    feed(spark, str(tmp_path), [("a", "x", 1, at(10), at(5))])
    assert expiry.entries(spark, f"{tmp_path}/store", F.lit(at(20))).count() == 0
    assert expiry.entries(spark, f"{tmp_path}/store", F.lit(at(9))).count() == 1
