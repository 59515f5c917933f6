"""Queries of models, scopes, vectors, graphs, segments, stores and text, with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as X
from .operators import graph as G
from .operators import kv as KV
from .operators import vector as V
from .operators.model import Model, Models, Relation, Scope, scope_filter, url_param
from .sources.catalog import Catalog

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
NOW = "TIMESTAMP '2024-06-01 00:00:00'"

# ---- fixtures: the same expressions in Spark and in SQL ----
CUSTOMER = f"SELECT *, CASE WHEN c_custkey % 10 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' END AS deleted_at, concat('t', c_custkey % 3) AS __team_id, concat('u', c_custkey % 7) AS __created_by, concat('u', c_custkey % 5) AS __updated_by, concat('[\"', c_mktsegment, '\",\"x\"]') AS tags FROM customer"
EDGES = "SELECT DISTINCT concat('c', o_custkey) AS src, concat('s', l_suppkey) AS dst, l_returnflag AS type FROM orders JOIN lineitem ON l_orderkey = o_orderkey"
NODES = "SELECT concat('c', c_custkey) AS id, 'customer' AS label, c_name AS name, c_mktsegment AS kind FROM customer UNION ALL SELECT concat('s', s_suppkey), 'supplier', s_name, 'none' FROM supplier"
SEGMENTS = "SELECT l_orderkey AS segment, l_linenumber AS id, CASE WHEN l_returnflag = 'R' THEN 'negative' ELSE 'positive' END AS vote, l_quantity AS score, concat('n', l_suppkey) AS node, l_partkey AS part FROM lineitem"
KVT = "SELECT concat(event_type, ':', user_id % 50) AS key, concat('v', event_id) AS value, CASE WHEN event_id % 4 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' WHEN event_id % 4 = 1 THEN TIMESTAMP '2030-01-01 00:00:00' END AS expired_at, event_id AS updated_at FROM events"
LISTS = "SELECT user_id AS key, min(event_id) AS a, max(event_id) AS b, count(*) AS n FROM events GROUP BY user_id"


def view(spark, folder, stmt):
    c = Catalog(spark, folder)
    from .plans.compile import Query

    return Query(c, {"sql": {"stmt": stmt}}).frame()


def models(spark, folder) -> Models:
    c = Catalog(spark, folder)
    c.register("buyers", lambda: view(spark, folder, CUSTOMER))
    cols = lambda *names: dict.fromkeys(names, "string")
    return Models(
        c,
        Model("customer", "customer", cols("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), "c_custkey", {"nation": Relation("one", "nation", "n_nationkey", "c_nationkey"), "orders": Relation("many", "orders", "o_custkey", "c_custkey"), "region": Relation("through", "region", "", "", links=[Relation("one", "nation", "n_nationkey", "c_nationkey"), Relation("one", "region", "r_regionkey", "n_regionkey")])}),
        Model("buyer", "buyers", cols("c_custkey", "c_name", "c_mktsegment", "tags", "deleted_at"), "c_custkey", {}, ["c_name"], ["tags"], True),
        Model("nation", "nation", cols("n_nationkey", "n_name", "n_regionkey"), "n_nationkey"),
        Model("region", "region", cols("r_regionkey", "r_name"), "r_regionkey"),
        Model("orders", "orders", cols("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"), "o_orderkey"),
    )


def add(key, run, sql=None):
    QUERIES[key] = run
    if sql:
        ORACLE_SQL[key] = sql


def model_query(key, name, param, sql):
    add(key, lambda s, d: models(s, d).query(name, param), sql)


C4 = "c_custkey, c_name, c_acctbal"
SEL = ["c_custkey", "c_name", "c_acctbal"]
model_query("model_select", "customer", {"select": [*SEL, "unknown"]}, f"SELECT {C4} FROM customer")
model_query("model_select_all", "nation", {}, "SELECT n_nationkey, n_name, n_regionkey FROM nation")
for _name, _op, _v in (("eq", "=", "'BUILDING'"), ("ne", "<>", "'BUILDING'"), ("like", "LIKE", "'%A%'")):
    model_query(f"model_where_{_name}", "customer", {"select": SEL, "wheres": [{"column": "c_mktsegment", "op": _name, "value": _v.strip("'")}]}, f"SELECT {C4} FROM customer WHERE c_mktsegment {_op} {_v}")
for _name, _op in (("gt", ">"), ("lt", "<"), ("ge", ">="), ("le", "<=")):
    model_query(f"model_where_{_name}", "customer", {"select": SEL, "wheres": [{"column": "c_acctbal", "op": _name, "value": 1000}]}, f"SELECT {C4} FROM customer WHERE c_acctbal {_op} 1000")
model_query("model_where_null", "customer", {"select": SEL, "wheres": [{"column": "c_name", "op": "notnull"}]}, f"SELECT {C4} FROM customer WHERE c_name IS NOT NULL")
model_query("model_where_in_csv", "customer", {"select": SEL, "wheres": [{"column": "c_mktsegment", "op": "in", "value": "BUILDING,MACHINERY"}]}, f"SELECT {C4} FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
model_query("model_orwhere", "customer", {"select": SEL, "wheres": [{"column": "c_acctbal", "op": "gt", "value": 9000}, {"column": "c_acctbal", "op": "lt", "value": 0, "method": "orwhere"}]}, f"SELECT {C4} FROM customer WHERE c_acctbal > 9000 OR c_acctbal < 0")
model_query("model_where_group", "customer", {"select": SEL, "wheres": [{"column": "c_mktsegment", "value": "BUILDING"}, {"wheres": [{"column": "c_acctbal", "op": "gt", "value": 9000}, {"column": "c_acctbal", "op": "lt", "value": 0, "method": "orwhere"}]}]}, f"SELECT {C4} FROM customer WHERE c_mktsegment = 'BUILDING' AND (c_acctbal > 9000 OR c_acctbal < 0)")
model_query("model_json_contains", "buyer", {"select": ["c_custkey"], "wheres": [{"column": "tags", "op": "match", "value": "BUILDING"}]}, "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 10 <> 0")
model_query("model_soft_delete_filter", "buyer", {"select": ["c_custkey", "c_name"]}, "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 10 <> 0")
_ONE = "FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey"
model_query("model_has_one", "customer", {"select": ["c_custkey", "c_name"], "withs": {"nation": {"select": ["n_name"]}}}, f"SELECT c_custkey, c_name, n_name AS nation_n_name {_ONE}")
model_query("model_has_one_where", "customer", {"select": ["c_custkey"], "withs": {"nation": {"select": ["n_name"], "wheres": [{"column": "n_regionkey", "value": 1}]}}}, "SELECT c_custkey, n_name AS nation_n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 1) n ON n_nationkey = c_nationkey")
model_query("model_has_one_through", "customer", {"select": ["c_custkey"], "withs": {"region": {"select": ["r_name"]}}}, f"SELECT c_custkey, r_name AS region_r_name {_ONE} LEFT JOIN region ON r_regionkey = n_regionkey")
model_query("model_where_rel", "customer", {"select": ["c_custkey"], "withs": {"nation": {"select": ["n_name"]}}, "wheres": [{"rel": "nation", "column": "n_regionkey", "op": "gt", "value": 2}]}, f"SELECT c_custkey, n_name AS nation_n_name {_ONE} WHERE n_regionkey > 2")
model_query("model_order", "customer", {"select": ["c_custkey", "c_acctbal"], "orders": [{"column": "c_acctbal", "option": "desc"}, {"column": "c_custkey"}], "limit": 10}, "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
model_query("model_order_rel", "customer", {"select": ["c_custkey"], "withs": {"nation": {"select": ["n_name"]}}, "orders": [{"rel": "nation", "column": "n_name", "option": "desc"}, {"column": "c_custkey"}], "limit": 10}, f"SELECT c_custkey, n_name AS nation_n_name {_ONE} ORDER BY n_name DESC NULLS LAST, c_custkey LIMIT 10")
model_query("model_limit", "customer", {"select": ["c_custkey"], "orders": [{"column": "c_custkey"}], "limit": 5}, "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 5")


def _has_many(s, d):
    df = models(s, d).query("customer", {"select": ["c_custkey"], "wheres": [{"column": "c_acctbal", "op": "gt", "value": 5000}], "withs": {"orders": {"select": ["o_orderkey", "o_totalprice"]}}})
    return df.select("c_custkey", F.size("orders").cast("long").alias("n"), F.explode_outer("orders").alias("o")).select("c_custkey", "n", "o.o_orderkey", "o.o_totalprice")


add("model_has_many", _has_many, "SELECT c_custkey, (SELECT count(*) FROM orders x WHERE x.o_custkey = c.c_custkey) AS n, o_orderkey, o_totalprice FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey WHERE c_acctbal > 5000")
add("model_count", lambda s, d: models(s, d).count("customer", {"wheres": [{"column": "c_acctbal", "op": "gt", "value": 0}]}), "SELECT count(*) AS total FROM customer WHERE c_acctbal > 0")
add("model_find", lambda s, d: models(s, d).find("customer", 42, {"select": SEL}), f"SELECT {C4} FROM customer WHERE c_custkey = 42")
add("model_get", lambda s, d: models(s, d).get("customer", {"select": ["c_custkey"], "orders": [{"column": "c_custkey"}]}), "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 100")
add("model_paginate", lambda s, d: models(s, d).paginate("customer", {"select": ["c_custkey"], "orders": [{"column": "c_custkey"}]}, 2, 15).items, "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 15 OFFSET 15")
add("model_select_option", lambda s, d: models(s, d).select_option("customer", "1", "c_name"), "SELECT c_name AS name, c_custkey AS id FROM customer WHERE c_name LIKE '%1%' ORDER BY c_custkey LIMIT 20")
add("url_query", lambda s, d: models(s, d).query("customer", url_param("select=c_custkey,c_acctbal&where.c_acctbal.gt=0&group.g.where.c_mktsegment.eq=BUILDING&group.g.orwhere.c_mktsegment.eq=MACHINERY&order=c_acctbal.desc,c_custkey&limit=30")), "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0 AND (c_mktsegment = 'BUILDING' OR c_mktsegment = 'MACHINERY') ORDER BY c_acctbal DESC, c_custkey LIMIT 30")
add("paginate_total", lambda s, d: s.range(1).select(F.lit(_total(s, d)).cast("long").alias("total")), "SELECT count(*) AS total FROM (SELECT o_custkey FROM orders GROUP BY o_custkey)")


def _total(s, d):
    from .plans.compile import Query
    from .plans.run import paginate

    return paginate(Query(Catalog(s, d), {"select": ["o_custkey", ":COUNT(o_orderkey) as n"], "from": "orders", "groups": ["o_custkey"], "orders": ["o_custkey"], "page": 1})).total


# ---- writes ----
add("model_create", lambda s, d: models(s, d).insert("nation", s.createDataFrame([(900, "NOWHERE", 1)], "n_nationkey int, n_name string, n_regionkey int")), "SELECT * FROM nation UNION ALL SELECT 900, 'NOWHERE', 1")
add("model_insert", lambda s, d: models(s, d).insert("region", s.createDataFrame([(90, "A"), (91, "B")], "r_regionkey int, r_name string")), "SELECT * FROM region UNION ALL SELECT 90, 'A' UNION ALL SELECT 91, 'B'")
add("model_update_where", lambda s, d: models(s, d).update_where("customer", [{"column": "c_acctbal", "op": "lt", "value": 0}], {"c_mktsegment": F.lit("DEBT"), "c_acctbal": F.lit(0.0)}), "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment FROM customer")
add("model_destroy_where", lambda s, d: models(s, d).destroy_where("customer", [{"column": "c_mktsegment", "value": "BUILDING"}]).select("c_custkey", "c_name"), "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment <> 'BUILDING' OR c_mktsegment IS NULL")
add("model_soft_delete", lambda s, d: models(s, d).delete_where("buyer", [{"column": "c_custkey", "op": "lt", "value": 50}], F.expr(NOW)).select("c_custkey", "c_name", F.col("deleted_at").cast("string").alias("deleted_at")), "SELECT c_custkey, CASE WHEN c_custkey < 50 AND c_custkey % 10 <> 0 THEN c_name || '_20240601000000_' || c_custkey ELSE c_name END AS c_name, CASE WHEN c_custkey % 10 = 0 THEN '2024-01-01 00:00:00' WHEN c_custkey < 50 THEN '2024-06-01 00:00:00' END AS deleted_at FROM customer")
add("model_upsert", lambda s, d: models(s, d).upsert("region", s.createDataFrame([(1, "NEW"), (77, "MORE")], "r_regionkey int, r_name string"), ["r_regionkey"]), "SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN 'NEW' ELSE r_name END AS r_name FROM region UNION ALL SELECT 77, 'MORE'")
add("model_each_save", lambda s, d: models(s, d).upsert("nation", s.range(3).selectExpr("cast(id as int) as n_nationkey", "concat('N', id) as n_name", "cast(0 as int) as n_regionkey"), ["n_nationkey"]), "SELECT n_nationkey, CASE WHEN n_nationkey < 3 THEN concat('N', n_nationkey) ELSE n_name END AS n_name, CASE WHEN n_nationkey < 3 THEN 0 ELSE n_regionkey END AS n_regionkey FROM nation")

# ---- scopes ----
_S = Scope("t1", "u2", "u3")
for _kind, _sql in (("wheres", "__team_id = 't1' AND __created_by = 'u2' AND __updated_by = 'u3'"), ("team_only", "__team_id = 't1'"), ("creator_only", "__created_by = 'u2'"), ("editor_only", "__updated_by = 'u3'"), ("creator_and_editor", "__created_by = 'u2' AND __updated_by = 'u3'"), ("creator_or_editor", "__created_by = 'u2' OR __updated_by = 'u3'"), ("team_or_creator", "__team_id = 't1' OR __created_by = 'u2'"), ("team_or_editor", "__team_id = 't1' OR __updated_by = 'u3'"), ("any", "__team_id = 't1' OR __created_by = 'u2' OR __updated_by = 'u3'")):
    add(f"scope_{_kind}", lambda s, d, k=_kind: view(s, d, CUSTOMER).filter(scope_filter(k, _S)).select("c_custkey"), f"SELECT c_custkey FROM ({CUSTOMER}) WHERE {_sql}")


# ---- vectors ----
def emb(s, d):
    return s.read.parquet(f"{d}/embeddings.parquet")


def _q(s, d, i=7):
    return list(emb(s, d).filter(F.col("vec_id") == i).first()["embedding"])


_QV = "(SELECT embedding FROM embeddings WHERE vec_id = 7)"
_DUCK = {"cosine": "list_cosine_similarity(embedding, {q})", "dot": "list_inner_product(embedding, {q})", "euclidean": "-list_distance(embedding, {q})", "manhattan": "-list_sum(list_transform(list_zip(embedding, {q}), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE)))"}


def _score_sql(m):
    return "round(" + _DUCK[m].format(q=_QV + "::DOUBLE[]").replace("(embedding,", "(embedding::DOUBLE[],") + ", 5)"


for _m in V.METRICS:
    add(f"vec_topk_{_m}", lambda s, d, m=_m: V.top_k(emb(s, d), _q(s, d), 10, m).select("vec_id", F.round("score", 5).alias("score")), f"SELECT vec_id, {_score_sql(_m)} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10")
add("vec_topk", lambda s, d: V.top_k(emb(s, d), _q(s, d), 10).select("vec_id", F.round("score", 5).alias("score")), f"SELECT vec_id, {_score_sql('cosine')} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10")
add("cosine_similarity", lambda s, d: V.scored(emb(s, d), _q(s, d)).select("vec_id", F.round("score", 5).alias("score")), f"SELECT vec_id, {_score_sql('cosine')} AS score FROM embeddings")
add("vec_score_threshold", lambda s, d: V.threshold(emb(s, d), _q(s, d), 0.2).select("vec_id"), "SELECT vec_id FROM embeddings WHERE list_cosine_similarity(embedding::DOUBLE[], " + _QV + "::DOUBLE[]) >= 0.2")
add("vec_filter_eq", lambda s, d: emb(s, d).filter(V.metadata_filter({"label": 3, "vec": None})).select("vec_id"), "SELECT vec_id FROM embeddings WHERE label = 3")
add("vec_get_by_ids", lambda s, d: emb(s, d).filter(F.col("vec_id").isin([3, 1, 4])).select("vec_id", "label"), "SELECT vec_id, label FROM embeddings WHERE vec_id IN (3, 1, 4)")
add("vec_count_filter", lambda s, d: emb(s, d).filter(V.metadata_filter({"label": 3})).agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM embeddings WHERE label = 3")
add("vec_scroll", lambda s, d: V.scroll(emb(s, d), 20, 100).select("vec_id", "label"), "SELECT vec_id, label FROM embeddings WHERE vec_id >= 100 ORDER BY vec_id LIMIT 21")


def _batch(s, d):
    q = emb(s, d).filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return V.batch_top_k(emb(s, d), q, 3).select("query_id", "rank", "vec_id", F.round("score", 5).alias("score"))


add("vec_batch_topk", _batch, "SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(s, 5) AS score FROM (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0) WHERE rank <= 3")
add("vec_mmr", lambda s, d: s.createDataFrame([(int(i), float(x)) for i, x in V.mmr(emb(s, d), _q(s, d), 5)], "vec_id long, score double"))


def _hybrid(how):
    def run(s, d):
        a = V.scored(emb(s, d), _q(s, d)).select("vec_id", "score")
        b = V.scored(emb(s, d), _q(s, d, 8), "dot").select("vec_id", "score")
        return V.fuse(a, b, 10, how).select("vec_id", F.round("score", 6).alias("score"))

    return run


_AB = "a AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 7)::DOUBLE[]) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 20), b AS (SELECT vec_id, list_inner_product(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 8)::DOUBLE[]) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 20)"
add("vec_hybrid_rrf", _hybrid("rrf"), f"WITH {_AB}, r AS (SELECT vec_id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, vec_id)) AS s FROM a UNION ALL SELECT vec_id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, vec_id)) FROM b) SELECT vec_id, round(sum(s), 6) AS score FROM r GROUP BY vec_id ORDER BY sum(s) DESC, vec_id LIMIT 10")
_DB = "SELECT vec_id, greatest(0.0, least(1.0, (score - (avg(score) OVER () - 3 * stddev_samp(score) OVER ())) / (6 * stddev_samp(score) OVER ()))) AS s FROM "
add("vec_hybrid_dbsf", _hybrid("dbsf"), f"WITH {_AB}, r AS ({_DB} a UNION ALL {_DB} b) SELECT vec_id, round(sum(s), 6) AS score FROM r GROUP BY vec_id ORDER BY sum(s) DESC, vec_id LIMIT 10")
add("vec_to_segments", lambda s, d: V.top_k(emb(s, d), _q(s, d), 10).select(F.col("vec_id").alias("segment"), F.concat(F.lit("label-"), "label").alias("tag"), F.round("score", 5).alias("score")), f"SELECT vec_id AS segment, concat('label-', label) AS tag, {_score_sql('cosine')} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10")
add("rag_search", lambda s, d: V.top_k(emb(s, d).filter("label = 3"), _q(s, d), 10, least=0.0).join(s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("vec_id"), "source"), "vec_id", "left").select("vec_id", "source", F.round("score", 5).alias("score")))

# ---- graphs ----
nodes = lambda s, d: view(s, d, NODES)
#: EDGES with the rows told apart before names are made of their keys, which are shorter.
_PLAIN = "SELECT concat('c', o_custkey) AS src, concat('s', l_suppkey) AS dst, l_returnflag AS type FROM (SELECT DISTINCT o_custkey, l_suppkey, l_returnflag FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"
edges = lambda s, d: view(s, d, _PLAIN)
_W2 = f"e AS ({EDGES}), n AS ({NODES}), b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)"
add("graph_get_nodes", lambda s, d: nodes(s, d).filter((F.col("label") == "customer") & (F.col("kind") == "BUILDING")).select("id", "name"), f"SELECT id, name FROM ({NODES}) WHERE label = 'customer' AND kind = 'BUILDING'")
for _way, _sql in (("out", "src IN ('c1', 'c4')"), ("in", "dst IN ('s1', 's4')"), ("both", "src IN ('c1', 's4') OR dst IN ('c1', 's4')")):
    _ids = {"out": ["c1", "c4"], "in": ["s1", "s4"], "both": ["c1", "s4"]}[_way]
    add(f"graph_get_rels_{_way}", lambda s, d, w=_way, i=_ids: G.relations(edges(s, d), i, w), f"SELECT * FROM ({EDGES}) WHERE {_sql}")
add("graph_get_rels", lambda s, d: G.relations(edges(s, d), ["s1"], "both", ["R"]), f"SELECT * FROM ({EDGES}) WHERE type = 'R' AND (src = 's1' OR dst = 's1')")
add("graph_traverse_1hop", lambda s, d: G.hop(edges(s, d), s.createDataFrame([("s1", "s1"), ("s2", "s2")], "start string, id string")), f"WITH {_W2} SELECT DISTINCT src AS start, dst AS id FROM b WHERE src IN ('s1', 's2')")
add("graph_traverse_khop", lambda s, d: G.reachable(edges(s, d), s.createDataFrame([("s1",)], "id string"), 1, 3, "both"), f"WITH RECURSIVE {_W2}, w AS (SELECT 's1' AS id, 0 AS depth UNION SELECT dst, depth + 1 FROM w JOIN b ON src = id WHERE depth < 3) SELECT 's1' AS start, id, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY id HAVING min(depth) BETWEEN 1 AND 3")


def _path(s, d):
    p = G.shortest_path(edges(s, d), "s1", "s2")
    return s.createDataFrame([(len(p) - 1 if p else -1,)], "steps int")


add("graph_shortest_path", _path, f"WITH RECURSIVE {_W2}, w AS (SELECT 's1' AS id, 0 AS depth UNION SELECT dst, depth + 1 FROM w JOIN b ON src = id WHERE depth < 6) SELECT CAST(coalesce(min(depth), -1) AS INTEGER) AS steps FROM w WHERE id = 's2'")
_DEG = f"WITH {_W2}, g AS (SELECT id, (SELECT count(*) FROM b WHERE src = id) AS degree FROM n)"
add("graph_degree", lambda s, d: G.degrees(nodes(s, d), edges(s, d)), f"WITH {_W2} SELECT id, count(src) AS degree FROM n LEFT JOIN b ON src = id GROUP BY id")
add("graph_basic_stats", lambda s, d: G.degrees(nodes(s, d), edges(s, d)), f"WITH {_W2} SELECT id, count(src) AS degree FROM n LEFT JOIN b ON src = id GROUP BY id")
add("graph_pagerank_approx", lambda s, d: G.rank_by_degree(nodes(s, d), edges(s, d)), f"WITH {_W2} SELECT id, count(src)::DOUBLE / (count(src) + 1) AS score FROM n LEFT JOIN b ON src = id GROUP BY id")
add("graph_betweenness_stub", lambda s, d: G.constant_centrality(nodes(s, d)), f"SELECT id, 0.0::DOUBLE AS score FROM ({NODES})")
add("graph_closeness_stub", lambda s, d: G.constant_centrality(nodes(s, d)), f"SELECT id, 0.0::DOUBLE AS score FROM ({NODES})")
add("graph_communities_bucket", lambda s, d: G.communities(edges(s, d)), f"WITH {_W2} SELECT src AS id, count(DISTINCT dst) AS degree, count(DISTINCT dst) % 10 AS community FROM b GROUP BY src")
add("graph_search_ids", lambda s, d: G.reachable(edges(s, d), s.createDataFrame([("s3",)], "id string"), 0, 2, "both").select("id"), f"WITH RECURSIVE {_W2}, w AS (SELECT 's3' AS id, 0 AS depth UNION SELECT dst, depth + 1 FROM w JOIN b ON src = id WHERE depth < 2) SELECT DISTINCT id FROM w")
add("graph_search_names", lambda s, d: nodes(s, d).filter(F.lower("name").contains("00000001") | F.lower("name").contains("supplier")).select("id"), f"SELECT id FROM ({NODES}) WHERE lower(name) LIKE '%00000001%' OR lower(name) LIKE '%supplier%'")
add("graph_labels", lambda s, d: nodes(s, d).select("label").distinct(), f"SELECT DISTINCT label FROM ({NODES})")
add("graph_rel_types", lambda s, d: edges(s, d).select("type").distinct(), f"SELECT DISTINCT type FROM ({EDGES})")
add("graph_delete_dry_run", lambda s, d: nodes(s, d).filter("kind = 'BUILDING'").agg(F.count("*").alias("n")), f"SELECT count(*) AS n FROM ({NODES}) WHERE kind = 'BUILDING'")
_ENT = "SELECT concat('p', p_size) AS id, p_brand AS name, p_type AS kind, p_partkey AS seq, concat('d', p_partkey % 5) AS doc FROM part"
add("entity_dedup", lambda s, d: G.first_of(view(s, d, _ENT), ["name", "kind"], "seq").select("name", "kind", "seq", "id"), f"SELECT name, kind, seq, id FROM (SELECT *, row_number() OVER (PARTITION BY name, kind ORDER BY seq) AS rn FROM ({_ENT})) WHERE rn = 1")
add("relationship_dedup", lambda s, d: G.first_of(view(s, d, "SELECT o_custkey AS a, l_suppkey AS b, l_returnflag AS type, l_orderkey * 10 + l_linenumber AS seq FROM orders JOIN lineitem ON l_orderkey = o_orderkey"), ["a", "b", "type"], "seq"), "SELECT o_custkey AS a, l_suppkey AS b, l_returnflag AS type, min(l_orderkey * 10 + l_linenumber) AS seq FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3")
add("entity_merge_sources", lambda s, d: view(s, d, _ENT).groupBy("name", "kind").agg(F.array_join(F.array_sort(F.collect_set("doc")), ",").alias("docs"), F.count("*").alias("version")), f"SELECT name, kind, string_agg(DISTINCT doc, ',' ORDER BY doc) AS docs, count(*) AS version FROM ({_ENT}) GROUP BY name, kind")
add("graph_remove_doc_sources", lambda s, d: G.without_sources(view(s, d, _ENT).groupBy("name").agg(F.collect_set("doc").alias("sources")), ["d1", "d2"]).select("name", F.array_join(F.array_sort("sources"), ",").alias("sources")), f"SELECT name, string_agg(DISTINCT doc, ',' ORDER BY doc) AS sources FROM ({_ENT}) WHERE doc NOT IN ('d1', 'd2') GROUP BY name")

# ---- segments ----
seg = lambda s, d: view(s, d, SEGMENTS)
add("vote_counts", lambda s, d: seg(s, d).groupBy("segment").agg(F.count_if(F.col("vote") == "positive").alias("positive"), F.count_if(F.col("vote") == "negative").alias("negative")), f"SELECT segment, count(*) FILTER (vote = 'positive') AS positive, count(*) FILTER (vote = 'negative') AS negative FROM ({SEGMENTS}) GROUP BY segment")
add("hit_counts", lambda s, d: seg(s, d).groupBy("segment").agg(F.count("*").alias("hits")), f"SELECT segment, count(*) AS hits FROM ({SEGMENTS}) GROUP BY segment")
add("segment_count", lambda s, d: seg(s, d).agg(F.countDistinct("segment").alias("n")), f"SELECT count(DISTINCT segment) AS n FROM ({SEGMENTS})")
add("segment_score_merge", lambda s, d: G.latest(seg(s, d).select("segment", "id", "score"), ["segment"], "id"), f"SELECT segment, id, score FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY id DESC, score DESC) AS rn FROM ({SEGMENTS})) WHERE rn = 1")
add("segment_graph_enrich", lambda s, d: seg(s, d).groupBy("segment").agg(F.array_join(F.array_sort(F.collect_set("node")), ",").alias("nodes")), f"SELECT segment, string_agg(DISTINCT node, ',' ORDER BY node) AS nodes FROM ({SEGMENTS}) GROUP BY segment")
add("segment_entities", lambda s, d: seg(s, d).select("segment", "node").distinct(), f"SELECT DISTINCT segment, node FROM ({SEGMENTS})")
add("graph_nodes_to_segments", lambda s, d: seg(s, d).filter(F.col("node").isin("n1", "n2")).select("segment").distinct(), f"SELECT DISTINCT segment FROM ({SEGMENTS}) WHERE node IN ('n1', 'n2')")
add("segment_assemble", lambda s, d: view(s, d, "SELECT p_partkey AS id, p_name AS text, 1.0D AS score FROM part").join(seg(s, d).groupBy(F.col("part").alias("id")).agg(F.max("score").alias("stored")), "id", "left").select("id", F.coalesce("stored", "score").alias("score")), f"SELECT p_partkey AS id, coalesce(max(s.score), 1.0) AS score FROM part LEFT JOIN ({SEGMENTS}) s ON s.part = p_partkey GROUP BY p_partkey")
for _k, _f in (("vote_scroll", "vote = 'positive'"), ("hit_scroll", "true")):
    add(_k, lambda s, d, f=_f: seg(s, d).filter(f).selectExpr("segment * 10 + id AS key").filter("key > 200").orderBy("key").limit(20), f"SELECT segment * 10 + id AS key FROM ({SEGMENTS}) WHERE {_f} AND segment * 10 + id > 200 ORDER BY key LIMIT 20")
add("segment_parents", lambda s, d: _parents(s, d), "WITH RECURSIVE w AS (SELECT p_partkey AS id, p_partkey AS up, 0 AS depth FROM part UNION ALL SELECT id, up // 10, depth + 1 FROM w WHERE up >= 10) SELECT id, up AS parent, CAST(depth AS INTEGER) AS depth FROM w WHERE depth > 0")


def _parents(s, d):
    """Ancestors in a tree whose parent of k is k // 10, a level at a time."""
    level = view(s, d, "SELECT p_partkey AS id, p_partkey AS up FROM part")
    out, depth = level.selectExpr("id", "up AS parent", "0 AS depth").limit(0), 0
    while not (level := level.filter("up >= 10").selectExpr("id", "up div 10 AS up")).isEmpty():
        depth += 1
        out = out.unionByName(level.select("id", F.col("up").alias("parent"), F.lit(depth).alias("depth")))
    return out


# ---- stores ----
kvt = lambda s, d: KV.put(view(s, d, KVT).limit(0), view(s, d, KVT))
_KV = f"(SELECT key, value, expired_at, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY updated_at DESC) AS rn FROM ({KVT})) WHERE rn = 1)"
_LIVE = f"(SELECT * FROM {_KV} WHERE expired_at IS NULL OR expired_at > {NOW})"
now = lambda: F.expr(NOW)
add("kv_live_entries", lambda s, d: KV.live(kvt(s, d), now()).select("key", "value"), f"SELECT key, value FROM {_LIVE}")
add("kv_get", lambda s, d: KV.get(kvt(s, d), "click:3", now()).select("key", "value"), f"SELECT key, value FROM {_LIVE} WHERE key = 'click:3'")
add("kv_del_prefix", lambda s, d: KV.delete(kvt(s, d), "click*").select("key", "value"), f"SELECT key, value FROM {_KV} WHERE key NOT LIKE 'click%'")
add("kv_len", lambda s, d: KV.live(kvt(s, d), now()).agg(F.count("*").alias("n")), f"SELECT count(*) AS n FROM {_LIVE}")
add("kv_keys", lambda s, d: KV.keys(kvt(s, d), "view*", now()), f"SELECT key FROM {_LIVE} WHERE key LIKE 'view%'")
lists = lambda s, d: view(s, d, LISTS).withColumn("v", F.array("a", "b", "n"))
_L = f"(SELECT *, [a, b, n] AS v FROM ({LISTS}))"
for _k, _f, _sql in (
    ("kv_push", lambda v: KV.push(v, 7), "list_append(v, 7)"),
    ("kv_pop", lambda v: KV.pop(v), "v[1:2]"),
    ("kv_pull", lambda v: KV.pull(v, 1), "list_filter(v, lambda x: x <> 1)"),
    ("kv_add_to_set", lambda v: KV.add_to_set(v, 1, 2), "list_concat(v, list_filter([1, 2], lambda x: NOT list_contains(v, x)))"),
    ("kv_array_slice", lambda v: KV.array_slice(v, 1, 5), "v[2:6]"),
    ("kv_array_page", lambda v: KV.array_page(v, 2, 2), "v[3:4]"),
):
    add(_k, lambda s, d, f=_f: lists(s, d).select("key", F.array_join(f(F.col("v")).cast("array<string>"), ",").alias("v")), f"SELECT key, array_to_string({_sql}, ',') AS v FROM {_L}")

# ---- text ----
docs = lambda s, d: s.read.parquet(f"{d}/documents.parquet")
for _k, _m, _a, _c, _sql in (
    ("min", "min", (0,), "c_acctbal", "c_acctbal >= 0"), ("max", "max", (5000,), "c_acctbal", "c_acctbal <= 5000"), ("enum", "enum", ("BUILDING", "MACHINERY"), "c_mktsegment", "c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    ("pattern", "pattern", ("^[A-Z]+$",), "c_mktsegment", "regexp_matches(c_mktsegment, '^[A-Z]+$')"), ("min_length", "minLength", (9,), "c_mktsegment", "length(c_mktsegment) >= 9"), ("max_length", "maxLength", (9,), "c_mktsegment", "length(c_mktsegment) <= 9"),
):
    add(f"validate_{_k}", lambda s, d, m=_m, a=_a, c=_c: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", X.validator(m, F.col(c), *a).alias("ok")), f"SELECT c_custkey, {_sql} AS ok FROM customer")
_MAIL = "concat('user', c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '@' END, 'mail.com')"
add("validate_email", lambda s, d: view(s, d, f"SELECT c_custkey, {_MAIL} AS m FROM customer").select("c_custkey", X.validator("email", F.col("m")).alias("ok")), "SELECT c_custkey, c_custkey % 3 <> 0 AS ok FROM customer")
add("validate_mobile_us", lambda s, d: view(s, d, "SELECT c_custkey, concat(if(c_custkey % 3 = 0, '(415)', '415'), '-555-', lpad(cast(c_custkey % 10000 as string), 4, '0')) AS m FROM customer").select("c_custkey", X.validator("mobile", F.col("m"), "us").alias("ok")), "SELECT c_custkey, c_custkey % 3 <> 0 AS ok FROM customer")
add("validate_mobile", lambda s, d: view(s, d, "SELECT c_custkey, concat('138', lpad(cast(c_custkey as string), 8, '0')) AS m FROM customer").select("c_custkey", X.validator("mobile", F.col("m"), "cn").alias("ok")), "SELECT c_custkey, true AS ok FROM customer")
add("validate_typeof", lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", X.validator("typeof", F.col("c_acctbal"), "float").alias("ok")), "SELECT c_custkey, true AS ok FROM customer")
_J = "CASE WHEN event_id % 3 = 0 THEN concat(props, '}') ELSE props END"
add("json_is_valid", lambda s, d: view(s, d, f"SELECT event_id, {_J} AS j FROM events").select("event_id", X.json_is_valid(F.col("j")).alias("ok")), f"SELECT event_id, coalesce(json_valid({_J}), false) AS ok FROM events")
add("json_detect_format", lambda s, d: view(s, d, "SELECT event_id, CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN concat('{ // x\n', props) ELSE 'a: 1' END AS j FROM events").select("event_id", X.detect_format(F.col("j")).alias("format")), "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'json' WHEN 1 THEN 'jsonc' ELSE 'yaml' END AS format FROM events")
add("json_strip_comments", lambda s, d: view(s, d, "SELECT event_id, concat(props, ' // note') AS j FROM events").select("event_id", X.json_strip_comments("j").alias("j")), "SELECT event_id, concat(props, ' ') AS j FROM events")
add("enc_base64", lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.base64(F.encode("c_name", "UTF-8")).alias("b")), "SELECT c_custkey, base64(encode(c_name)) AS b FROM customer")
add("enc_hex", lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.hex("c_name").alias("h"), F.unhex(F.hex("c_name")).cast("string").alias("back")), "SELECT c_custkey, hex(c_name) AS h, c_name AS back FROM customer")
add("hash_id", lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", X.hash_id(F.col("c_name")).cast("string").alias("h")), "SELECT c_custkey, CAST(CAST('0x' || substr(md5(c_name), 1, 16) AS UBIGINT) AS VARCHAR) AS h FROM customer")
add("safe_cast", lambda s, d: view(s, d, "SELECT p_partkey, coalesce(try_cast(p_brand AS int), -1) AS x, coalesce(try_cast(cast(p_size as string) AS int), -1) AS y FROM part"), "SELECT p_partkey, coalesce(TRY_CAST(p_brand AS INTEGER), -1) AS x, p_size AS y FROM part")
add("lang_replace", lambda s, d: s.read.parquet(f"{d}/customer.parquet").join(F.broadcast(s.createDataFrame([("BUILDING", "Bau"), ("MACHINERY", "Maschinen")], "k string, w string")), F.col("c_mktsegment") == F.col("k"), "left").select("c_custkey", F.coalesce("w", "c_mktsegment").alias("word")), "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Bau' WHEN 'MACHINERY' THEN 'Maschinen' ELSE c_mktsegment END AS word FROM customer")
_MD = "concat('intro\n```sql\nSELECT ', p_partkey, '\n```\nmid\n```\n', p_brand, '\n```')"
add("text_extract_blocks", lambda s, d: X.code_blocks(view(s, d, f"SELECT p_partkey, {_MD} AS t FROM part"), "p_partkey", "t"), "SELECT p_partkey, 0 AS pos, 'sql' AS type, concat('SELECT ', p_partkey) AS content FROM part UNION ALL SELECT p_partkey, 1, 'text', p_brand FROM part")
add("text_extract_by_type", lambda s, d: X.code_blocks(view(s, d, f"SELECT p_partkey, {_MD} AS t FROM part"), "p_partkey", "t").filter("type = 'sql'").select("p_partkey", "content"), "SELECT p_partkey, concat('SELECT ', p_partkey) AS content FROM part")
add("text_detect_language", lambda s, d: view(s, d, f"SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'SELECT 1' WHEN 1 THEN 'import os' ELSE '[1]' END AS t FROM part").select("p_partkey", X.detect_language(F.col("t")).alias("language")), "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'sql' WHEN 1 THEN 'python' ELSE 'json' END AS language FROM part")
add("text_word_similarity", lambda s, d: view(s, d, "SELECT p_partkey, concat(p_brand, ' ', p_type) AS a, concat(p_type, ' x') AS b FROM part").select("p_partkey", F.round(X.word_similarity(F.col("a"), F.col("b")), 6).alias("similarity")), "SELECT p_partkey, round(2.0::DOUBLE * len(list_filter(string_split_regex(lower(concat(p_type, ' x')), '\\s+'), lambda w: list_contains(string_split_regex(lower(concat(p_brand, ' ', p_type)), '\\s+'), w))) / (len(string_split_regex(concat(p_brand, ' ', p_type), '\\s+')) + len(string_split_regex(concat(p_type, ' x'), '\\s+'))), 6) AS similarity FROM part")
add("html_to_markdown", lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", X.html_to_markdown("html").alias("markdown")))
add("diff_replace", lambda s, d: s.createDataFrame([(X.replace_blocks("a\nb\nc", "<<<<<<< SEARCH\nb\n=======\nB\n>>>>>>> REPLACE"),)], "t string"), "SELECT concat('a', chr(10), 'B', chr(10), 'c') AS t")
add("chunk_text_lines", lambda s, d: docs(s, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t")).select("doc_id", "line", F.md5("t").alias("t")), "SELECT doc_id, CAST(i - 1 AS INTEGER) AS line, md5(l[i]) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)")
_CUT = "^([89AB][0-9A-F])+|([CD][0-9A-F]|E[0-9A-F]([89AB][0-9A-F])?|F[0-7]([89AB][0-9A-F]){0,2})$"
_BYTES = "SELECT doc_id, encode(text) AS t, octet_length(encode(text)) AS n FROM documents"
add("chunk_fixed", lambda s, d: X.fixed_chunks(docs(s, d), "doc_id", "text", 300, 20).select("doc_id", "index", "start", "stop", F.md5("text").alias("h")), f"SELECT doc_id, CAST(i AS INTEGER) AS index, i * 280 AS start, least(i * 280 + 300, n) AS stop, md5(decode(unhex(regexp_replace(hex(array_slice(t, i * 280 + 1, least(i * 280 + 300, n))), '{_CUT}', '', 'g')))) AS h FROM (SELECT doc_id, t, n, unnest(range(0, CAST(CASE WHEN n = 0 THEN 0 WHEN n <= 300 THEN 1 ELSE ceil((n - 20) / 280.0) END AS BIGINT))) AS i FROM ({_BYTES}))")
_AT = "SELECT doc_id, t, n, unnest(range(0, CAST(CASE WHEN n = 0 THEN 0 WHEN n <= 300 THEN 1 ELSE ceil((n - 20) / 280.0) END AS BIGINT))) AS i"
_FEEDS = "SELECT doc_id, sum(strlen(l) + 1) OVER (PARTITION BY doc_id ORDER BY k) - 1 AS at FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS k, len(string_split(text, chr(10))) AS last FROM documents) QUALIFY k < last"
add("chunk_lines", lambda s, d: X.line_chunks(docs(s, d), "doc_id", "text", 300, 20), f"SELECT c.doc_id, CAST(c.i AS INTEGER) AS index, c.i * 280 AS start, least(c.i * 280 + 300, c.n) AS stop, 1 + count(*) FILTER (WHERE f.at < c.i * 280) AS start_line, 1 + count(*) FILTER (WHERE f.at < least(c.i * 280 + 300, c.n)) AS end_line FROM ({_AT} FROM ({_BYTES})) c LEFT JOIN ({_FEEDS}) f USING (doc_id) GROUP BY c.doc_id, c.i, c.n")
add("chunk_hierarchy", lambda s, d: X.grouped_chunks(X.fixed_chunks(docs(s, d), "doc_id", "text", 300), "doc_id", 3).select("doc_id", "parent", "start", "stop"), f"SELECT doc_id, CAST(i // 3 AS INTEGER) AS parent, min(i * 300) AS start, max(least(i * 300 + 300, n)) AS stop FROM (SELECT doc_id, n, unnest(range(0, CAST(ceil(n / 300.0) AS BIGINT))) AS i FROM ({_BYTES})) GROUP BY doc_id, i // 3")


def _aes(s, d):
    from .functions.expr import fold_key
    from .plans.compile import Query

    key = "a short key"
    c = Catalog(s, d)
    c.key = key
    c.register("secret", lambda: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.hex(F.aes_encrypt("c_name", F.lit(fold_key(key)), F.lit("ECB"), F.lit("PKCS"))).alias("c_name")))
    return Query(c, {"select": ["c_custkey", "c_name*"], "from": "secret"}).frame()


add("select_aes", _aes, "SELECT c_custkey, c_name FROM customer")


def _flow(s, d):
    from .plans.flow import Flow

    f = Flow("two", Catalog(s, d), [{"name": "rich", "query": {"select": ["c_custkey", "c_nationkey"], "from": "customer", "wheres": [{"field": "c_acctbal", ">": "{{ least }}"}]}}, {"name": "by", "query": {"select": ["c_nationkey", ":COUNT(c_custkey) as n"], "from": "rich", "groups": ["c_nationkey"]}}])
    return f.run({"least": 5000})


add("flow_two_step", _flow, "SELECT c_nationkey, count(c_custkey) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY c_nationkey")


# ---- files, schemas, streams ----
def _scratch(s):
    """A folder all nodes see: that of spark.checkpoint.dir, or a temporary one in local runs."""
    import tempfile
    import uuid

    base = s.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not s.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
    base = base or tempfile.gettempdir()
    return f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def _export(s, d, back: bool):
    from .sources import io

    df = s.read.parquet(f"{d}/nation.parquet")
    path = _scratch(s)
    io.export(df, path, "nation", "n_nationkey", 10)
    return io.load(s, path, df) if back else s.read.json(path).select("model", F.explode("values").alias("v")).select("model", F.col("v")[0].alias("k"), F.col("v")[1].alias("name"))


add("model_export", lambda s, d: _export(s, d, False), "SELECT 'nation' AS model, CAST(n_nationkey AS VARCHAR) AS k, n_name AS name FROM nation")
add("model_import", lambda s, d: _export(s, d, True), "SELECT * FROM nation")


def _snapshot(s, d):
    from .sources.io import Snapshots

    snaps = Snapshots(s, _scratch(s))
    snaps.take(s.read.parquet(f"{d}/region.parquet"), "one")
    return snaps.restore("one")


add("model_snapshot", _snapshot, "SELECT * FROM region")
def _stream(s, d):
    from .streaming.tables import current, upsert_kv

    path = _scratch(s)
    table = s.read.parquet(f"{d}/events.parquet")
    table.write.parquet(f"{path}/in")
    stream = s.readStream.schema(table.schema).parquet(f"{path}/in").selectExpr("concat(event_type, ':', user_id % 50) AS key", "concat('v', event_id) AS value", "event_id AS updated_at")
    q = upsert_kv(stream, f"{path}/kv", f"{path}/state")
    q.awaitTermination()
    return current(s, f"{path}/kv")


add("stream_kv_upsert", _stream, f"SELECT key, value, updated_at FROM {_KV}")


def _windows(s, d):
    from .streaming.tables import window_counts

    return window_counts(s.read.parquet(f"{d}/events.parquet")).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


add("stream_window_counts", _windows, "SELECT strftime(time_bucket(INTERVAL 60 MINUTE, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
