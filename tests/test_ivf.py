"""The inverted file against a search of everything."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import ivf

D = 8


def clustered(n=1500, seed=3):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(12, D)) * 3
    return middles[rng.integers(0, 12, n)] + rng.normal(size=(n, D)) * 0.3


def table(spark, x, more=()):
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)] + list(more)
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")


def asked(df, every=20):
    return df.where(f"vec_id % {every} = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def brute(x, q, k, metric):
    s = ivf.scores(q, x, metric)
    return [int(i) for i in np.lexsort((np.arange(len(x)), -s))[:k]]


def lists_of(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


@pytest.mark.parametrize("metric", ivf.METRICS)
def test_exact_is_a_search_of_everything(spark, tmp_path, metric, monkeypatch):
    monkeypatch.setattr(ivf, "CHUNK", 50)
    monkeypatch.setattr(ivf, "QUERIES", 7)
    x = clustered()
    x[40:60] = x[0]  # ties
    df = table(spark, x)
    index = ivf.build(df, f"{tmp_path}/i", metric=metric)
    assert lists_of(index.exact(asked(df), 25)) == {i: brute(x, x[i], 25, metric) for i in range(0, len(x), 20)}
    got, want = lists_of(index.search(asked(df), 10)), {i: brute(x, x[i], 10, metric) for i in range(0, len(x), 20)}
    assert sum(len(set(got[i]) & set(want[i])) for i in want) >= 0.9 * 10 * len(want)


def test_files_are_pruned(spark, tmp_path):
    df = table(spark, clustered())
    index = ivf.build(df, f"{tmp_path}/i")
    assert index.probes < len(index.centres) / 2
    cells = [int(c) for c in np.flatnonzero(index.sizes > 0)[:2]]
    some = index.rows(cells)
    assert len(some.inputFiles()) == len(index.rows().inputFiles())  # files listed, not read
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "__cell" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert some.select(F.input_file_name()).distinct().count() < index.rows().select(F.input_file_name()).distinct().count()
    assert some.count() == index.sizes[cells].sum() and index.rows().count() == index.sizes.sum() == 1500


def test_conditions_and_least(spark, tmp_path):
    x = clustered()
    df = table(spark, x)
    index = ivf.build(df, f"{tmp_path}/i", metric="euclidean")
    rows = index.exact(asked(df, 100), 5, where=F.col("label") == 1, least=-1.0).collect()
    assert rows and all(r["vec_id"] % 3 == 1 and r["score"] >= -1.0 for r in rows)
    for i in range(0, 1500, 100):
        near = [j for j in brute(x, x[i], 1500, "euclidean") if j % 3 == 1][:5]
        assert [r["vec_id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == i] == [j for j in near if np.linalg.norm(x[i] - x[j]) <= 1.0]


def test_odd_rows(spark, tmp_path):
    odd = [(9000, None, 1), (9001, [math.nan] * D, 1), (9002, [1.0] * (D - 1), 1), (9003, [0.0] * D, None), (None, [1.0] * D, 1), (9004, [math.inf] + [0.0] * (D - 1), 1), (9005, [None] + [0.0] * (D - 1), 1)]
    df = table(spark, clustered(200), odd)
    index = ivf.build(df, f"{tmp_path}/i")
    assert index.sizes.sum() == 202
    queries = spark.createDataFrame([(1, None), (2, [0.0] * D), (3, [math.nan] * D), (4, [1.0])], "query_id int, query array<double>")
    rows = index.exact(queries, 300).collect()
    assert {r["query_id"] for r in rows} == {2} and len(rows) == 202 and {r["score"] for r in rows} == {0.0}


def test_empty_small_and_wrong(spark, tmp_path):
    none = table(spark, np.zeros((0, D)))
    index = ivf.build(none, f"{tmp_path}/none")
    assert index.search(asked(none)).count() == 0 == index.exact(asked(none)).count()
    one = table(spark, np.ones((1, D)))
    index = ivf.build(one, f"{tmp_path}/one")
    assert [r["vec_id"] for r in index.exact(asked(one)).collect()] == [0]
    same = table(spark, np.ones((400, D)))
    assert lists_of(ivf.build(same, f"{tmp_path}/same").search(asked(same, 200), 3)) == {0: [0, 1, 2], 200: [0, 1, 2]}
    few = table(spark, np.eye(D)[np.arange(400) % 5])
    assert lists_of(ivf.build(few, f"{tmp_path}/few").search(asked(few, 200), 3)) == {0: [0, 5, 10], 200: [0, 5, 10]}
    with pytest.raises(ValueError):
        ivf.build(one, f"{tmp_path}/x", metric="manhattan")
    with pytest.raises(ValueError):
        ivf.build(one.withColumn("__cell", F.lit(1)), f"{tmp_path}/x")


def test_copies_of_queries_are_sent_in_bounded_pieces():
    n, cells = 2000, 300
    x = np.random.default_rng(1).normal(size=(n, D))
    vectors = pa.array(x.tolist())
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), vectors, vectors, pa.array([None] * n, pa.float64())], ["query_id", "query", "__p", "__least"])
    centres = x[:cells]
    got = list(ivf._spread([batch], np.arange(cells), centres, np.ones(cells), "euclidean", 10, True, 5000))
    assert sum(b.num_rows for b in got) == n * (cells - 10) and max(b.num_rows for b in got) <= 5000
    assert len({(q, c) for b in got for q, c in zip(b.column("query_id").to_pylist(), b.column("__cell").to_pylist(), strict=True)}) == n * (cells - 10)
