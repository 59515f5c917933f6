"""Queries cover their whole inputs, not a subset that query and SQL share."""

import os

from sparkloom.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_graph_has_the_edges_of_all_orders(spark, duck):
    want = duck.sql("SELECT count(*) FROM (SELECT DISTINCT o_custkey, l_suppkey, l_returnflag FROM orders JOIN lineitem ON l_orderkey = o_orderkey)").fetchall()[0][0]
    assert QUERIES["graph_degree"](spark, SF).agg({"degree": "sum"}).first()[0] == 2 * want


def test_segments_are_all_enriched(spark, duck):
    orders, pairs = duck.sql("SELECT count(DISTINCT l_orderkey), count(DISTINCT (l_orderkey, l_suppkey)) FROM lineitem").fetchall()[0]
    assert QUERIES["segment_graph_enrich"](spark, SF).count() == orders
    assert QUERIES["segment_entities"](spark, SF).count() == pairs


def test_parents_to_the_last_level(spark, tmp_path):
    keys = [0, 7, 42, 499, 500, 19_999, 12_345_678]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(map(tuple, QUERIES["segment_parents"](spark, str(tmp_path)).select("id", "parent", "depth").collect()))
    assert got == sorted((k, k // 10**i, i) for k in keys for i in range(1, len(str(k))))


def test_batch_asks_the_whole_query_set(spark, duck):
    want = {r[0] for r in duck.sql("SELECT vec_id FROM embeddings WHERE vec_id % 20 = 0").fetchall()}
    assert {r.query_id for r in QUERIES["vec_batch_topk"](spark, SF).collect()} == want
