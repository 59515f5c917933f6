"""Many queries at once: the rows of the expressions, and no pair of a row and a query in the plan."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from sparkloom.operators import vector as V


def plain(rows, queries, k, metric):
    pairs = rows.crossJoin(queries).select("query_id", "vec_id", V.METRICS[metric](F.col("embedding"), F.col("query")).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def told(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], repr(r["score"])) for r in df.collect())


def table(spark, kind):
    x = [[(i * 37 + j * 11) % 13 - 6 + i % 3 / 7 for j in range(4)] for i in range(60)]
    odd = [None, [0.0] * 4, [1.0, None, 2.0, 3.0], [1.0, 2.0], [], [float("nan"), 1.0, 1.0, 1.0], [float("inf"), 1.0, 0.0, 1.0], [1e-30] * 4]
    return spark.createDataFrame(list(enumerate([*x, *odd, *x[:9], *[x[3]] * 20])), f"vec_id bigint, embedding array<{kind}>")


@pytest.mark.parametrize("metric,kind", [("cosine", "float"), ("dot", "double"), ("euclidean", "float"), ("manhattan", "double")])
def test_the_same_rows_and_numbers(spark, monkeypatch, metric, kind):
    monkeypatch.setattr(V, "PIECE", 32 * 40)
    monkeypatch.setattr(V, "BLOCK", 32 * 15)
    monkeypatch.setattr(V, "AT_ONCE", 3)
    rows = table(spark, kind)
    queries = rows.where("vec_id % 5 = 0 OR vec_id BETWEEN 60 AND 67").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    for k in (4, 200):
        assert told(V.batch_top_k(rows, queries, k, metric)) == told(plain(rows, queries, k, metric))
    assert V.batch_top_k(rows.where("false"), queries, 3, metric).isEmpty() and V.batch_top_k(rows, queries.where("false"), 3, metric).isEmpty()


def test_pairs_are_not_rows_of_the_plan(spark):
    rows = table(spark, "double").where("vec_id < 60")
    said = io.StringIO()
    with redirect_stdout(said):
        V.batch_top_k(rows, rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 3).explain()
    assert "NestedLoop" not in said.getvalue() and "Cartesian" not in said.getvalue()
