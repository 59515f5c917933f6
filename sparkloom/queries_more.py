"""Queries of store, vector and graph changes, searches by sparse vectors, pages and checks, with the same results in SQL."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import functions as F

from .functions import encoding
from .functions import text as X
from .operators import graph as G
from .operators import kv as KV
from .operators import vector as V
from .operators.model import Scope, scope_filter, scope_stamp
from .plans.compile import Query
from .plans.run import decode
from .queries_ops import _ENT, _KV, _L, _LIVE, CUSTOMER, EDGES, NODES, _q, _scratch, docs, edges, emb, kvt, lists, models, nodes, now, view
from .sources.catalog import Catalog

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def add(key, run, sql=None):
    QUERIES[key] = run
    if sql:
        ORACLE_SQL[key] = sql


# ---- stores ----
_WANTED = "SELECT DISTINCT concat(event_type, ':', user_id % 60) AS key FROM events"
_NEW = "SELECT DISTINCT concat(event_type, ':', user_id % 60) AS key, 'new' AS value, CAST(NULL AS TIMESTAMP) AS expired_at, CAST(-1 AS BIGINT) AS updated_at FROM events"
add("kv_has", lambda s, d: KV.get(kvt(s, d), "view:2", now()).agg((F.count("*") > 0).alias("has")), f"SELECT count(*) > 0 AS has FROM {_LIVE} WHERE key = 'view:2'")
add("kv_set_multi", lambda s, d: KV.put(kvt(s, d), view(s, d, _NEW).withColumn("updated_at", F.lit(10**12).cast("long"))).select("key", "value"), f"SELECT key, 'new' AS value FROM ({_WANTED}) UNION SELECT key, value FROM {_KV} WHERE key NOT IN ({_WANTED})")
add("kv_get_multi", lambda s, d: KV.get_multi(kvt(s, d), view(s, d, _WANTED), now()), f"SELECT w.key, l.value FROM ({_WANTED}) w LEFT JOIN {_LIVE} l ON l.key = w.key")
add("kv_get_set", lambda s, d: KV.get_set_multi(kvt(s, d), view(s, d, _NEW), now())[0], f"SELECT w.key, coalesce(l.value, 'new') AS value FROM ({_WANTED}) w LEFT JOIN {_LIVE} l ON l.key = w.key")
add("kv_get_set_table", lambda s, d: KV.get_set_multi(kvt(s, d), view(s, d, _NEW), now())[1].select("key", "value"), f"SELECT w.key, coalesce(l.value, 'new') AS value FROM ({_WANTED}) w LEFT JOIN {_LIVE} l ON l.key = w.key UNION ALL SELECT key, value FROM {_KV} WHERE key NOT IN ({_WANTED})")
add("kv_get_del", lambda s, d: KV.get_del(kvt(s, d), "view:2", now())[1].select("key", "value"), f"SELECT key, value FROM {_KV} WHERE key <> 'view:2'")
add("kv_del_multi", lambda s, d: KV.del_multi(kvt(s, d), ["view:2", "click:3", "none"]).select("key", "value"), f"SELECT key, value FROM {_KV} WHERE key NOT IN ('view:2', 'click:3')")
add("kv_clear", lambda s, d: KV.clear(kvt(s, d)).agg(F.count("*").alias("n")), "SELECT 0 AS n")
_NUM = f"(SELECT key, CAST(updated_at AS VARCHAR) AS value, expired_at, updated_at FROM {_KV})"
for _k, _by in (("kv_incr", 5), ("kv_decr", -5)):
    add(_k, lambda s, d, b=_by: KV.incr(kvt(s, d).withColumn("value", F.col("updated_at").cast("string")), "view:2", b).select("key", "value", "expired_at"), f"SELECT key, CASE WHEN key = 'view:2' THEN CAST(CAST(value AS BIGINT) + {_by} AS VARCHAR) ELSE value END AS value, CASE WHEN key <> 'view:2' THEN expired_at END AS expired_at FROM {_NUM}")
for _k, _f, _sql in (
    ("kv_pull_all", lambda v: KV.pull_all(v, [1, 2, 3]), "list_filter(v, lambda x: x NOT IN (1, 2, 3))"),
    ("kv_pop_first", lambda v: KV.pop(v, False), "v[2:]"),
    ("kv_array_set", lambda v: KV.array_set(v, 1, 99), "[v[1], 99, v[3]]"),
):
    add(_k, lambda s, d, f=_f: lists(s, d).select("key", F.array_join(f(F.col("v")).cast("array<string>"), ",").alias("v")), f"SELECT key, array_to_string({_sql}, ',') AS v FROM {_L}")
add("kv_array_get", lambda s, d: lists(s, d).select("key", KV.array_get(F.col("v"), 2).alias("v")), f"SELECT key, v[3] AS v FROM {_L}")
add("kv_array_len", lambda s, d: lists(s, d).select("key", KV.array_len(F.col("v")).alias("n")), f"SELECT key, CAST(len(v) AS INTEGER) AS n FROM {_L}")
add("kv_array_all", lambda s, d: lists(s, d).select("key", F.explode("v").alias("item")), f"SELECT key, unnest(v) AS item FROM {_L}")

# ---- vectors ----
SPARSE = ([1, 5, 9, 20, 33], [0.5, 1.0, -0.75, 2.0, 1.5])
LEAST = 0.15
_SP = "(SELECT vec_id, embedding::DOUBLE[] AS embedding, list_sum([" + ", ".join(f"CASE WHEN abs(embedding[{i + 1}]::DOUBLE) >= {LEAST} THEN embedding[{i + 1}]::DOUBLE * {v} ELSE 0.0 END" for i, v in zip(*SPARSE, strict=True)) + f"]) AS score FROM embeddings WHERE " + " OR ".join(f"abs(embedding[{i + 1}]::DOUBLE) >= {LEAST}" for i in SPARSE[0]) + ")"
_DENSE = "(SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 7)::DOUBLE[]) AS score FROM embeddings)"


def _sparse(s, d):
    return emb(s, d).withColumn("sparse", V.sparse(F.col("embedding"), LEAST))


add("vec_sparse_dot", lambda s, d: _sparse(s, d).select("vec_id", F.size("sparse.indices").alias("n"), F.round(V.sparse_dot(F.col("sparse"), *SPARSE), 6).alias("score")), f"SELECT e.vec_id, CAST(len(list_filter(e.embedding, lambda x: abs(x::DOUBLE) >= {LEAST})) AS INTEGER) AS n, round(coalesce(p.score, 0.0), 6) AS score FROM embeddings e LEFT JOIN {_SP} p ON p.vec_id = e.vec_id")


def _fused(how):
    part = {"rrf": "SELECT vec_id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, vec_id)) AS s FROM ", "dbsf": "SELECT vec_id, greatest(0.0, least(1.0, (score - (avg(score) OVER () - 3 * stddev_samp(score) OVER ())) / (6 * stddev_samp(score) OVER ()))) AS s FROM "}[how]
    best = "(SELECT vec_id, score FROM {} ORDER BY score DESC, vec_id LIMIT 20)"
    return f"SELECT vec_id, round(sum(s), 6) AS score FROM ({part}{best.format(_DENSE)} UNION ALL {part}{best.format(_SP)}) GROUP BY vec_id ORDER BY sum(s) DESC, vec_id LIMIT 10"


for _how in ("rrf", "dbsf"):
    add(f"vec_hybrid_sparse_{_how}", lambda s, d, h=_how: V.hybrid(_sparse(s, d), _q(s, d), SPARSE, 10, h).select("vec_id", F.round("score", 6).alias("score")), _fused(_how))
add("vec_multi_search", lambda s, d: V.multi_search({f"q{i}": V.top_k(emb(s, d), _q(s, d, i), 5, "dot").select("vec_id", F.round("score", 5).alias("score")) for i in (7, 8)}), " UNION ALL ".join(f"(SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = {i})::DOUBLE[]), 5) AS score, 'q{i}' AS search FROM embeddings ORDER BY list_inner_product(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = {i})::DOUBLE[]) DESC, vec_id LIMIT 5)" for i in (7, 8)))
_flat = lambda s, d: emb(s, d).select("vec_id", "label")
add("vec_upsert", lambda s, d: V.upsert(_flat(s, d), _flat(s, d).selectExpr("vec_id * 3 AS vec_id", "label + 100 AS label")), "SELECT vec_id, label FROM embeddings WHERE vec_id % 3 <> 0 OR vec_id NOT IN (SELECT vec_id * 3 FROM embeddings) UNION ALL SELECT vec_id * 3, label + 100 FROM embeddings")
add("vec_delete_ids", lambda s, d: V.delete(_flat(s, d), [1, 2, 3]), "SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (1, 2, 3)")
add("vec_delete_filter", lambda s, d: V.delete(_flat(s, d), where={"label": 3}), "SELECT vec_id, label FROM embeddings WHERE label <> 3")
add("vec_delete_dry_run", lambda s, d: V.delete(_flat(s, d), where={"label": 3}, dry_run=True), "SELECT count(*) AS n FROM embeddings WHERE label = 3")
add("vec_update_metadata", lambda s, d: V.update_metadata(_flat(s, d), _flat(s, d).filter("vec_id % 2 = 0").selectExpr("vec_id", "label * 10 AS label")), "SELECT vec_id, CAST(CASE WHEN vec_id % 2 = 0 THEN label * 10 ELSE label END AS INTEGER) AS label FROM embeddings")


def _said(s, page):
    return s.createDataFrame([(page.total, page.pages, page.has_next, page.has_previous)], "total long, pages int, has_next boolean, has_previous boolean")


add("vec_page_metadata", lambda s, d: _said(s, V.page_of(_flat(s, d).filter("label = 3"), ["vec_id"], 2, 7)), "SELECT count(*) AS total, CAST(ceil(count(*) / 7.0) AS INTEGER) AS pages, count(*) > 14 AS has_next, true AS has_previous FROM embeddings WHERE label = 3")
add("vec_page_items", lambda s, d: V.page_of(_flat(s, d).filter("label = 3"), ["vec_id"], 2, 7).items, "SELECT vec_id, label FROM embeddings WHERE label = 3 ORDER BY vec_id LIMIT 7 OFFSET 7")
add("vec_scroll_ordered", lambda s, d: V.scroll_page(_flat(s, d), 15, order="label:desc").items, "SELECT vec_id, label FROM embeddings ORDER BY label DESC, vec_id LIMIT 15")
add("vec_scroll_cursor", lambda s, d: s.createDataFrame([(V.scroll_page(_flat(s, d), 15, 30).next_cursor,)], "next_cursor long"), "SELECT min(vec_id) AS next_cursor FROM (SELECT vec_id FROM embeddings WHERE vec_id >= 30 ORDER BY vec_id OFFSET 15)")
_KEYS = "SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag FROM lineitem"
add("vote_page", lambda s, d: V.cursor_page(view(s, d, _KEYS).filter("l_returnflag = 'R'"), 500, 200).items, f"SELECT * FROM ({_KEYS}) WHERE l_returnflag = 'R' AND id > 200 ORDER BY id LIMIT 100")
add("vote_page_cursor", lambda s, d: s.createDataFrame([(V.cursor_page(view(s, d, _KEYS), 500, 200).next_cursor,)], "next_cursor long"), f"SELECT max(id) AS next_cursor FROM (SELECT id FROM ({_KEYS}) WHERE id > 200 ORDER BY id LIMIT 100)")

# ---- graphs ----
_gone = lambda: F.col("kind") == "BUILDING"
_KEPT = f"(SELECT id FROM ({NODES}) WHERE kind <> 'BUILDING')"
add("graph_delete_nodes", lambda s, d: G.delete_nodes(nodes(s, d), edges(s, d), _gone())[0].select("id"), f"SELECT id FROM {_KEPT}")
add("graph_delete_detach", lambda s, d: G.delete_nodes(nodes(s, d), edges(s, d), _gone())[1], f"SELECT e.* FROM ({EDGES}) e WHERE src NOT IN (SELECT id FROM ({NODES}) WHERE kind = 'BUILDING')")
add("graph_delete_rels", lambda s, d: G.delete_edges(edges(s, d), F.col("type") == "R"), f"SELECT * FROM ({EDGES}) WHERE type <> 'R'")
add("graph_add_nodes", lambda s, d: G.latest(view(s, d, f"SELECT id, name, 0 AS at FROM ({NODES})").unionByName(view(s, d, "SELECT concat('c', c_custkey * 2) AS id, upper(c_mktsegment) AS name, 1 AS at FROM customer")), ["id"], "at").select("id", "name"), f"SELECT id, name FROM ({NODES}) WHERE id NOT IN (SELECT concat('c', c_custkey * 2) FROM customer) UNION ALL SELECT concat('c', c_custkey * 2), upper(c_mktsegment) FROM customer")
_PART = "SELECT concat('p', p_partkey) AS id, p_brand AS name, p_type AS kind, p_partkey AS seq FROM part"
_CANON = f"(SELECT id, first_value(id) OVER (PARTITION BY name, kind ORDER BY seq) AS too FROM ({_PART}))"
_RELS = "SELECT concat('s', l_suppkey) AS src, concat('p', l_partkey) AS dst, l_returnflag AS type, l_orderkey * 10 + l_linenumber AS seq FROM lineitem"


def _remapped(s, d):
    canon = G.canonical_ids(view(s, d, _PART), ["name", "kind"], "seq")
    return G.first_of(G.remap(view(s, d, _RELS), canon), ["src", "dst", "type"], "seq")


add("entity_canonical", lambda s, d: G.canonical_ids(view(s, d, _PART), ["name", "kind"], "seq").select("id", F.col("to").alias("too")), f"SELECT id, too FROM {_CANON}")
add("relationship_remap", _remapped, f"SELECT src, coalesce(c.too, dst) AS dst, type, min(seq) AS seq FROM ({_RELS}) r LEFT JOIN {_CANON} c ON c.id = r.dst GROUP BY 1, 2, 3")
_OLD = f"SELECT name, kind, string_agg(DISTINCT doc, ',' ORDER BY doc) AS docs FROM ({_ENT}) WHERE seq % 3 <> 0 GROUP BY name, kind"
_FRESH = f"SELECT name, kind, string_agg(DISTINCT doc, ',' ORDER BY doc) AS docs FROM ({_ENT}) WHERE seq % 2 = 0 GROUP BY name, kind"


def _merged(s, d):
    def side(where):
        return view(s, d, _ENT).filter(where).groupBy("name", "kind").agg(F.array_sort(F.collect_set("doc")).alias("docs"))

    out = G.merge_entities(side("seq % 3 <> 0").withColumn("version", F.lit(4)), side("seq % 2 = 0"), ["name", "kind"], ["docs"])
    return out.select("name", "kind", F.array_join("docs", ",").alias("docs"), "version")


add("entity_merge_stored", _merged, f"SELECT coalesce(a.name, b.name) AS name, coalesce(a.kind, b.kind) AS kind, array_to_string(list_concat(string_split(a.docs, ','), list_filter(string_split(b.docs, ','), lambda x: NOT coalesce(list_contains(string_split(a.docs, ','), x), false))), ',') AS docs, CAST(CASE WHEN a.name IS NULL THEN 1 WHEN b.name IS NULL THEN 4 ELSE 5 END AS INTEGER) AS version FROM ({_OLD}) a FULL JOIN ({_FRESH}) b ON a.name = b.name AND a.kind = b.kind")
add("graph_search_text", lambda s, d: G.search_text(nodes(s, d), "Who is Supplier#000000001 ?", lambda q: [w for w in q.split() if "#" in w]).select("id"), f"SELECT id FROM ({NODES}) WHERE lower(name) LIKE '%supplier#000000001%'")


def _backup(s, d):
    path = _scratch(s)
    G.backup(nodes(s, d), edges(s, d), path)
    n, e = G.restore(s, path, "id string, label string, name string, kind string", "src string, dst string, type string")
    return n.selectExpr("id AS a", "name AS b", "kind AS c").unionByName(e.selectExpr("src AS a", "dst AS b", "type AS c"))


add("graph_backup_restore", _backup, f"SELECT id AS a, name AS b, kind AS c FROM ({NODES}) UNION ALL SELECT * FROM ({EDGES})")
add("graph_export_statements", lambda s, d: G.cypher(nodes(s, d).select("id", "label"), edges(s, d)), f"SELECT 0 AS place, concat('CREATE (n:`', label, '` {{id: ''', id, '''}})') AS statement FROM ({NODES}) UNION ALL SELECT 1, concat('MATCH (a {{id: ''', src, '''}}), (b {{id: ''', dst, '''}}) CREATE (a)-[:`', type, '`]->(b)') FROM ({EDGES})")

# ---- models ----
_ROWS = "SELECT CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey END AS o_orderkey, 'Z' AS o_orderstatus, o_orderkey AS line FROM orders WHERE o_orderkey % 2 = 0"
_TWO = "o_orderkey, o_custkey, o_orderstatus, o_orderpriority"
_SAVED = f"SELECT o.o_orderkey, o.o_custkey, coalesce(n.o_orderstatus, o.o_orderstatus) AS o_orderstatus, o.o_orderpriority FROM orders o LEFT JOIN (SELECT * FROM ({_ROWS}) WHERE {{ok}}) n ON n.o_orderkey = o.o_orderkey UNION ALL SELECT NULL, NULL, 'Z', NULL FROM ({_ROWS}) WHERE o_orderkey IS NULL AND {{ok}}"
add("model_save", lambda s, d: models(s, d).save("orders", view(s, d, _ROWS).drop("line")).selectExpr(*_TWO.split(", ")), _SAVED.format(ok="true"))
_RULES = [("line", "max", (900,), "too great"), ("o_orderkey", "pattern", ("^[0-9]+$",), "no number")]
add("model_each_save_errors", lambda s, d: models(s, d).each_save("orders", view(s, d, _ROWS), "line", {"o_orderstatus": "Z"}, _RULES)[1].select("line", F.array_join("messages", ";").alias("messages")), f"SELECT line, 'too great' AS messages FROM ({_ROWS}) WHERE line > 900")
add("model_each_save_valid", lambda s, d: models(s, d).each_save("orders", view(s, d, _ROWS), "line", {"o_orderstatus": "Z"}, _RULES)[0].selectExpr(*_TWO.split(", ")), _SAVED.format(ok="line <= 900"))
add("model_each_save_index", lambda s, d: models(s, d).each_save("nation", view(s, d, "SELECT n_nationkey AS line, n_nationkey + 20 AS n_nationkey, upper(n_name) AS n_name FROM nation"), "line", {"n_regionkey": "$index"})[0], "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey < 20 UNION ALL SELECT n_nationkey + 20, upper(n_name), n_nationkey FROM nation")
add("model_each_save_after_delete", lambda s, d: models(s, d).each_save_after_delete("nation", [1, 2, 3], view(s, d, "SELECT n_nationkey AS line, n_nationkey, 'again' AS n_name FROM nation WHERE n_nationkey IN (3, 4)"), "line")[0], "SELECT n_nationkey, CASE WHEN n_nationkey IN (3, 4) THEN 'again' ELSE n_name END AS n_name, CASE WHEN n_nationkey <> 3 THEN n_regionkey END AS n_regionkey FROM nation WHERE n_nationkey NOT IN (1, 2)")
_BULK = "SELECT n_nationkey AS line, n_nationkey + 100 AS n_nationkey, n_name, n_regionkey FROM nation"
add("model_insert_report", lambda s, d: models(s, d).insert_checked("nation", view(s, d, _BULK), [("n_regionkey", "max", (3,), "region"), ("n_name", "maxLength", (9,), "name")], "line")[1].select("line", F.array_join("messages", ";").alias("messages")), f"SELECT line, concat_ws(';', CASE WHEN n_regionkey > 3 THEN 'region' END, CASE WHEN length(n_name) > 9 THEN 'name' END) AS messages FROM ({_BULK}) WHERE n_regionkey > 3 OR length(n_name) > 9")
add("model_insert_checked", lambda s, d: models(s, d).insert_checked("nation", view(s, d, _BULK), [("n_regionkey", "min", (0,), "region")], "line")[0], f"SELECT * FROM nation UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM ({_BULK})")


def _nested(s, d):
    m = models(s, d)
    df = m.query("customer", {"select": ["c_custkey"], "withs": {"nation": {"select": ["n_nationkey", "n_name"]}}})
    return m.nested(df, ["nation"]).select("c_custkey", F.to_json("nation").alias("nation"))


add("model_nested_relation", _nested, """SELECT c_custkey, CASE WHEN n_nationkey IS NOT NULL THEN concat('{"n_nationkey":', n_nationkey, ',"n_name":"', n_name, '"}') END AS nation FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""")
_TENANT = f"SELECT *, concat('x', c_custkey % 2) AS __tenant_id FROM ({CUSTOMER})"
add("scope_tenant", lambda s, d: view(s, d, _TENANT).filter(scope_filter("wheres", Scope(team="t1", tenant="x1"))).select("c_custkey"), f"SELECT c_custkey FROM ({_TENANT}) WHERE __team_id = 't1' AND __tenant_id = 'x1'")
add("scope_append", lambda s, d: scope_stamp(view(s, d, "SELECT c_custkey FROM customer"), Scope("t", "c", "e", "n")), "SELECT c_custkey, 't' AS __team_id, 'c' AS __created_by, 'e' AS __updated_by, 'n' AS __tenant_id FROM customer")

# ---- texts ----
add("json_decoded_output", lambda s, d: decode(Query(Catalog(s, d), {"select": ["event_id", "props"], "from": "events"}).frame(), {"props": "map<string,bigint>"}).select("event_id", F.col("props").getItem("k").alias("k")), "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
_SCHEMA = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 0, "maximum": 49}}}
add("json_validate_schema", lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", X.json_matches("props", _SCHEMA).alias("ok")), "SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT) BETWEEN 0 AND 49, false) AS ok FROM events")


# ---- entries that are missing, expired or emptied; own columns like a relation's; JSON that is broken ----
_ROW = "SELECT 'none:0' AS key, '5' AS value, CAST(NULL AS TIMESTAMP) AS expired_at"
add("kv_incr_missing", lambda s, d: KV.incr(kvt(s, d), "none:0", 5, now()).select("key", "value", "expired_at"), f"SELECT key, value, expired_at FROM {_KV} UNION ALL {_ROW}")


def _incr_expired(s, d):
    table = kvt(s, d).withColumn("value", F.col("updated_at").cast("string")).withColumn("expired_at", F.when(F.col("key") == "view:2", F.lit("2000-01-01").cast("timestamp_ntz")).otherwise(F.col("expired_at")))
    return KV.incr(table, "view:2", 7, now()).select("key", "value", "expired_at")


add("kv_incr_expired", _incr_expired, f"SELECT key, CASE WHEN key = 'view:2' THEN '7' ELSE value END AS value, CASE WHEN key <> 'view:2' THEN expired_at END AS expired_at FROM {_NUM}")


def _list(df):
    return df.select("key", F.array_join(F.col("v").cast("array<string>"), ",").alias("v"))


add("kv_push_missing", lambda s, d: _list(KV.push_key(KV.push_key(lists(s, d), -1, 8, 9), -1, 7)), f"SELECT key, array_to_string(v, ',') AS v FROM {_L} UNION ALL SELECT -1, '8,9,7'")


def _emptied(s, d):
    df = KV.push_key(lists(s, d), -1, 1)
    return _list(KV.pop_key(KV.pop_key(KV.push_key(df, -2, 1, 2), -1), -2, last=False))


add("kv_pop_emptied", _emptied, f"SELECT key, array_to_string(v, ',') AS v FROM {_L} UNION ALL SELECT -2, '2'")


def _nested_own(s, d):
    """The model's own column nation_key begins with the relation's name and stays."""
    m = models(s, d)
    own = m.catalog.scan("customer").withColumn("nation_key", F.col("c_nationkey") * 10)
    m.catalog.register("customer", own)
    m.found["customer"].columns["nation_key"] = "string"
    df = m.query("customer", {"select": ["c_custkey", "nation_key"], "withs": {"nation": {"select": ["n_name"]}}})
    return m.nested(df, ["nation"], "customer").select("c_custkey", "nation_key", F.to_json("nation").alias("nation"))


add("model_nested_own_column", _nested_own, """SELECT c_custkey, c_nationkey * 10 AS nation_key, CASE WHEN n_name IS NOT NULL THEN concat('{"n_name":"', n_name, '"}') END AS nation FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""")


def _repaired(s, d):
    """Events' properties in single quotes, with a trailing comma, without their last bracket, behind a comment."""
    broken = F.expr("concat('/* ', event_id, ' */ ', replace(substr(props, 1, length(props) - 1), '\"', ''''), ', last: [1, {b: ''it\\\\''s''],')")
    fixed = X.json_repair(broken)
    return s.read.parquet(f"{d}/events.parquet").select("event_id", F.get_json_object(fixed, "$.k").cast("long").alias("k"), F.get_json_object(fixed, "$.last[1].b").alias("b"))


add("json_repair", _repaired, "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 'it''s' AS b FROM events")


def _encoded(s, d):
    """Every document in one of eight encodings (in UTF-8 where its own lacks a letter), some compressed, and read again from the bytes alone."""
    names = ("utf-8", "utf-8-sig", "utf-16", "utf-16-le", "utf-16-be", "iso-8859-1", "windows-1252", "utf-32")

    @F.pandas_udf("binary")
    def written(ids: pd.Series, texts: pd.Series) -> pd.Series:
        def one(i, t):
            if t is None:
                return None
            try:
                data = t.encode(names[i % 8])
            except UnicodeEncodeError:
                data = t.encode()
            return gzip.compress(data) if i % 3 == 0 else data

        return pd.Series([one(int(i), t) for i, t in zip(ids, texts, strict=True)], dtype=object)

    read = docs(s, d).select("doc_id", encoding.to_text(written("doc_id", "text")).alias("x"))
    return read.select("doc_id", F.md5("x.text").alias("h"), F.col("x.gzipped").alias("gzipped"))


add("text_encodings", _encoded, "SELECT doc_id, md5(text) AS h, CASE WHEN text IS NOT NULL THEN doc_id % 3 = 0 END AS gzipped FROM documents")
