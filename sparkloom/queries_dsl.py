"""Query documents over the driver tables, each with the same result in SQL."""

from __future__ import annotations

from .plans.compile import Query
from .sources.catalog import Catalog

L5 = "l_orderkey, l_linenumber, l_quantity"
_ARR = "concat('[\"',p_brand,'\",\"',p_type,'\"]')"
_OBJ = "concat('[{\"k\":\"',p_brand,'\",\"n\":',p_size,'},{\"k\":\"',p_type,'\",\"n\":',p_size + 1,'}]')"
_DUCK_ARR = "concat('[\"',p_brand,'\",\"',p_type,'\"]')"


def parts_json(spark, folder):
    """part with JSON columns: tags (array of strings), items (array of objects), doc (object)."""
    return spark.read.parquet(f"{folder}/part.parquet").selectExpr("*", f"{_ARR} AS tags", f"{_OBJ} AS items", "concat('{\"a\":{\"b\":\"',p_brand,'\"},\"n\":',p_size,'}') AS doc")


PARTS_SQL = f"(SELECT *, {_DUCK_ARR} AS tags, {_OBJ} AS items, concat('{{\"a\":{{\"b\":\"',p_brand,'\"}},\"n\":',p_size,'}}') AS doc FROM part)"


def catalog(spark, folder) -> Catalog:
    c = Catalog(spark, folder)
    c.register("parts", lambda: parts_json(spark, folder))
    c.model("buyer", "customer").model("line", "lineitem")
    return c


def _where(field, cond, extra=""):
    return {"select": ["o_orderkey", "o_orderstatus", "o_totalprice"], "from": "orders", "wheres": [{"field": field, **cond}]}


_W = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE "
_A = {"from": "lineitem", "groups": ["l_returnflag"]}

#: key -> (document, SQL) or (document, SQL, parameters)
DOCUMENTS = {
    "scan_table": ({"select": ["n_nationkey", "n_name", "n_regionkey"], "from": "nation"}, "SELECT n_nationkey, n_name, n_regionkey FROM nation"),
    "scan_alias": ({"select": ["n.n_nationkey", "n.n_name"], "from": "nation as n"}, "SELECT n.n_nationkey, n.n_name FROM nation n"),
    "scan_model": ({"select": ["c_custkey", "c_name"], "from": "$buyer"}, "SELECT c_custkey, c_name FROM customer"),
    "subquery_from": ({"select": ["c_custkey", "_SUB_.c_name"], "query": {"select": ["c_custkey", "c_name"], "from": "customer", "wheres": [{"field": "c_acctbal", ">": 0}]}}, "SELECT c_custkey, c_name FROM (SELECT * FROM customer WHERE c_acctbal > 0)"),
    "subquery_named": ({"select": ["x.n", "x.k"], "name": "x", "query": {"select": ["c_nationkey as k", ":COUNT(c_custkey) as n"], "from": "customer", "groups": ["k"]}}, "SELECT count(c_custkey) AS n, c_nationkey AS k FROM customer GROUP BY c_nationkey"),
    "raw_sql": ({"sql": {"stmt": "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > ? AND c_mktsegment = ?", "args": [5000.0, "BUILDING"]}}, "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'"),
    "select_cols": ({"select": ["p_partkey", "p_brand", "p_size"], "from": "part"}, "SELECT p_partkey, p_brand, p_size FROM part"),
    "select_star": ({"select": ["*"], "from": "region"}, "SELECT * FROM region"),
    "select_model_cols": ({"select": ["$buyer.c_custkey", "$buyer.c_name"], "from": "$buyer"}, "SELECT c_custkey, c_name FROM customer"),
    "select_alias": ({"select": ["p_partkey as id", "p_name AS name"], "from": "part"}, "SELECT p_partkey AS id, p_name AS name FROM part"),
    "select_number_literal": ({"select": ["r_regionkey", "1 as one", "0.618 as ratio", "12.5 as half", "-1 as minus"], "from": "region"}, "SELECT r_regionkey, 1 AS one, 0.618 AS ratio, 12.5 AS half, -1 AS minus FROM region"),
    "select_string_literal": ({"select": ["r_regionkey", "'foo' as s", "'it\\'s' as q"], "from": "region"}, "SELECT r_regionkey, 'foo' AS s, 'it''s' AS q FROM region"),
    "bind_select": ({"select": ["r_regionkey", "?:tag as tag"], "from": "region"}, "SELECT r_regionkey, 'blue' AS tag FROM region", {"tag": "blue"}),
    "bind_where": ({"select": ["o_orderkey"], "from": "orders", "wheres": [{"field": "o_totalprice", ">": "?:least"}, {"field": "o_orderstatus", "=": "{{status}}"}]}, "SELECT o_orderkey FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'O'", {"least": 200000, "status": "O"}),
    "json_object_path": ({"select": ["event_id", "props$.k as k"], "from": "events"}, "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events"),
    "json_array_index": ({"select": ["p_partkey", "tags[0] as t", "items[1].k as k"], "from": "parts"}, f"SELECT p_partkey, json_extract_string(tags, '$[0]') AS t, json_extract_string(items, '$[1].k') AS k FROM {PARTS_SQL}"),
    "json_array_star": ({"select": ["p_partkey", "tags@ as t", "tags[*] as u"], "from": "parts"}, f"SELECT p_partkey, tags AS t, tags AS u FROM {PARTS_SQL}"),
    "json_typed_cast": ({"select": ["p_partkey", "doc$.n(integer) as n", "items[0].n(decimal 11,2) as d"], "from": "parts"}, f"SELECT p_partkey, CAST(json_extract_string(doc, '$.n') AS INTEGER) AS n, CAST(json_extract_string(items, '$[0].n') AS DECIMAL(11,2)) AS d FROM {PARTS_SQL}"),
    "where_eq": (_where("o_orderstatus", {"=": "F"}), _W + "o_orderstatus = 'F'"),
    "where_gt": (_where("o_totalprice", {">": 200000}), _W + "o_totalprice > 200000"),
    "where_ge": (_where("o_totalprice", {">=": 200000}), _W + "o_totalprice >= 200000"),
    "where_lt": (_where("o_totalprice", {"<": 20000}), _W + "o_totalprice < 20000"),
    "where_le": (_where("o_totalprice", {"<=": 20000}), _W + "o_totalprice <= 20000"),
    "where_ne": (_where("o_orderstatus", {"<>": "F"}), _W + "o_orderstatus <> 'F'"),
    "where_like": (_where("o_orderpriority", {"like": "1-%"}), _W + "o_orderpriority LIKE '1-%'"),
    "where_match": (_where("o_orderpriority", {"match": "URG"}), _W + "o_orderpriority LIKE '%URG%'"),
    "where_in_list": (_where("o_orderstatus", {"in": ["O", "P"]}), _W + "o_orderstatus IN ('O', 'P')"),
    "where_in_subquery": (_where("o_custkey", {"in": {"select": ["c_custkey"], "from": "customer", "wheres": [{"field": "c_mktsegment", "=": "BUILDING"}]}}), _W + "o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"),
    "where_scalar_subquery": (_where("o_totalprice", {">": {"select": [":AVG(o_totalprice) as a"], "from": "orders"}}), _W + "o_totalprice > (SELECT avg(o_totalprice) FROM orders)"),
    "where_is_null": (_where("o_orderstatus", {"is": "null"}), _W + "o_orderstatus IS NULL"),
    "where_is_not_null": (_where("o_orderstatus", {"is": "not null"}), _W + "o_orderstatus IS NOT NULL"),
    "where_column": ({"select": ["l_orderkey", "l_linenumber"], "from": "lineitem", "wheres": [{"field": "l_discount", "<": "{l_tax}"}]}, "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount < l_tax"),
    "where_or": ({"select": ["o_orderkey"], "from": "orders", "wheres": [{":o_orderstatus": "status", "=": "F"}, {":o_totalprice": "price", ">": 100000}, {"or :o_orderpriority": "priority", "=": "1-URGENT"}]}, "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 OR o_orderpriority = '1-URGENT'"),
    "where_group": ({"select": ["o_orderkey"], "from": "orders", "wheres": [{":o_orderstatus": "s", "=": "O"}, {"wheres": [{":o_totalprice": "p", "<": 50000}, {"or": True, "field": "o_totalprice", "op": ">", "value": 250000}]}]}, "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND (o_totalprice < 50000 OR o_totalprice > 250000)"),
    "where_shorthand": ({"select": ["c_custkey"], "from": "customer", "wheres": [{":c_mktsegment": "segment", "=": "BUILDING"}]}, "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "join_inner": ({"select": ["o.o_orderkey", "c.c_name"], "from": "orders as o", "joins": [{"from": "customer as c", "key": "c.c_custkey", "foreign": "o.o_custkey"}]}, "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey"),
    "join_left": ({"select": ["c.c_custkey", "o.o_orderkey"], "from": "customer as c", "joins": [{"from": "orders as o", "key": "o.o_custkey", "foreign": "c.c_custkey", "left": True}]}, "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey"),
    "join_right": ({"select": ["c.c_custkey", "n.n_name"], "from": "customer as c", "joins": [{"from": "nation as n", "key": "n.n_nationkey", "foreign": "c.c_nationkey", "right": True}]}, "SELECT c.c_custkey, n.n_name FROM customer c RIGHT JOIN nation n ON n.n_nationkey = c.c_nationkey"),
    "join_chain": (
        {"select": ["l.l_orderkey", "l.l_linenumber", "c.c_name", "n.n_name", "r.r_name"], "from": "lineitem as l", "joins": [{"from": "orders as o", "key": "o.o_orderkey", "foreign": "l.l_orderkey"}, {"from": "customer as c", "key": "c.c_custkey", "foreign": "o.o_custkey"}, {"from": "nation as n", "key": "n.n_nationkey", "foreign": "c.c_nationkey", "left": True}, {"from": "region as r", "key": "r.r_regionkey", "foreign": "n.n_regionkey", "left": True}]},
        "SELECT l.l_orderkey, l.l_linenumber, c.c_name, n.n_name, r.r_name FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey",
    ),
    "join_self": ({"select": ["a.n_name as x", "b.n_name as y"], "from": "nation as a", "joins": [{"from": "nation as b", "key": "b.n_regionkey", "foreign": "a.n_regionkey"}]}, "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON b.n_regionkey = a.n_regionkey"),
    "join_expr_key": ({"select": ["e.event_id", "p.p_partkey"], "from": "events as e", "joins": [{"from": "parts as p", "key": ":CONCAT('', p.p_partkey)", "foreign": "e.props$.k"}]}, "SELECT e.event_id, p.p_partkey FROM events e JOIN part p ON CAST(p.p_partkey AS VARCHAR) = json_extract_string(e.props, '$.k')"),
    "join_semi": ({"select": ["c_custkey", "c_name"], "from": "customer", "wheres": [{"field": "c_custkey", "in": {"select": ["o_custkey"], "from": "orders", "wheres": [{"field": "o_totalprice", ">": 250000}]}}]}, "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)"),
    "unnest_json_scalar": ({"select": ["p_partkey", "tags@(string 50) as tag", ":COUNT(p_size) as n"], "from": "parts", "groups": ["p_partkey", "tag"]}, f"SELECT p_partkey, tag, count(p_size) AS n FROM (SELECT p_partkey, p_size, unnest(from_json(tags, '[\"VARCHAR\"]')) AS tag FROM {PARTS_SQL}) GROUP BY p_partkey, tag"),
    "unnest_json_object": ({"select": ["items[*].n(integer) as size", ":COUNT(p_partkey) as n"], "from": "parts", "groups": ["size"]}, f"SELECT size, count(p_partkey) AS n FROM (SELECT p_partkey, CAST(json_extract_string(unnest(from_json(items, '[\"JSON\"]')), '$.n') AS INTEGER) AS size FROM {PARTS_SQL}) GROUP BY size"),
    "group_by": ({"select": ["l_returnflag", ":ROUND(:SUM(l_quantity), 2) as sum_qty", ":COUNT(l_orderkey) as n"], "from": "lineitem", "wheres": [{"field": "l_discount", ">": 0.05}], "groups": ["l_returnflag"], "orders": ["l_returnflag"]}, "SELECT l_returnflag, round(sum(l_quantity), 2) AS sum_qty, count(l_orderkey) AS n FROM lineitem WHERE l_discount > 0.05 GROUP BY l_returnflag"),
    "agg_count": ({"select": ["l_returnflag", ":COUNT(l_orderkey) as n"], **_A}, "SELECT l_returnflag, count(l_orderkey) AS n FROM lineitem GROUP BY l_returnflag"),
    "agg_sum": ({"select": ["l_returnflag", ":ROUND(:SUM(l_quantity),2) as s"], **_A}, "SELECT l_returnflag, round(sum(l_quantity), 2) AS s FROM lineitem GROUP BY l_returnflag"),
    "agg_avg": ({"select": ["l_returnflag", ":ROUND(:AVG(l_quantity),4) as a"], **_A}, "SELECT l_returnflag, round(avg(l_quantity), 4) AS a FROM lineitem GROUP BY l_returnflag"),
    "agg_min": ({"select": ["l_returnflag", ":MIN(l_extendedprice) as m"], **_A}, "SELECT l_returnflag, min(l_extendedprice) AS m FROM lineitem GROUP BY l_returnflag"),
    "agg_max": ({"select": ["l_returnflag", ":MAX(l_extendedprice) as m"], **_A}, "SELECT l_returnflag, max(l_extendedprice) AS m FROM lineitem GROUP BY l_returnflag"),
    "agg_global": ({"select": [":COUNT(o_orderkey) as n", ":ROUND(:AVG(o_totalprice),4) as a"], "from": "orders"}, "SELECT count(o_orderkey) AS n, round(avg(o_totalprice), 4) AS a FROM orders"),
    "group_by_alias": ({"select": ["c_mktsegment as segment", ":COUNT(c_custkey) as n"], "from": "customer", "groups": ["segment"]}, "SELECT c_mktsegment AS segment, count(c_custkey) AS n FROM customer GROUP BY c_mktsegment"),
    "group_rollup_one": ({"select": ["l_returnflag as flag", ":COUNT(l_orderkey) as n"], "from": "lineitem", "groups": ["flag rollup all"]}, "SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'all' ELSE l_returnflag END AS flag, count(l_orderkey) AS n FROM lineitem GROUP BY ROLLUP(l_returnflag)"),
    "group_rollup_multi": ({"select": ["l_returnflag as flag", "l_linestatus as status", ":COUNT(l_orderkey) as n"], "from": "lineitem", "groups": "flag rollup all flags, status rollup all statuses"}, "SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'all flags' ELSE l_returnflag END AS flag, CASE WHEN grouping(l_linestatus) = 1 THEN 'all statuses' ELSE l_linestatus END AS status, count(l_orderkey) AS n FROM lineitem GROUP BY ROLLUP(l_returnflag, l_linestatus)"),
    "group_rollup_partial": ({"select": ["l_returnflag as flag", "l_linestatus as status", ":COUNT(l_orderkey) as n"], "from": "lineitem", "groups": [{"field": "flag"}, {"field": "status", "rollup": "all"}]}, "SELECT l_returnflag AS flag, CASE WHEN grouping(l_linestatus) = 1 THEN 'all' ELSE l_linestatus END AS status, count(l_orderkey) AS n FROM lineitem GROUP BY l_returnflag, ROLLUP(l_linestatus)"),
    "group_json_array": ({"select": ["tags@(string 50) as tag", ":COUNT(p_partkey) as n"], "from": "parts", "groups": ["tag"]}, f"SELECT tag, count(p_partkey) AS n FROM (SELECT p_partkey, unnest(from_json(tags, '[\"VARCHAR\"]')) AS tag FROM {PARTS_SQL}) GROUP BY tag"),
    "group_json_array_rollup": ({"select": ["p_brand as brand", "tags@(string 50) as tag", ":COUNT(p_partkey) as n"], "from": "parts", "groups": ["brand", "tag rollup all"]}, f"SELECT p_brand AS brand, CASE WHEN grouping(tag) = 1 THEN 'all' ELSE tag END AS tag, count(p_partkey) AS n FROM (SELECT p_partkey, p_brand, unnest(from_json(tags, '[\"VARCHAR\"]')) AS tag FROM {PARTS_SQL}) GROUP BY p_brand, ROLLUP(tag)"),
    "having_agg": ({"select": ["o_custkey", ":COUNT(o_orderkey) as n"], "from": "orders", "groups": ["o_custkey"], "havings": [{"field": ":COUNT(o_orderkey)", ">": 12}]}, "SELECT o_custkey, count(o_orderkey) AS n FROM orders GROUP BY o_custkey HAVING count(o_orderkey) > 12"),
    "having_alias": ({"select": ["o_custkey", ":COUNT(o_orderkey) as n"], "from": "orders", "groups": ["o_custkey"], "havings": [{"field": "n", ">=": 14}]}, "SELECT o_custkey, count(o_orderkey) AS n FROM orders GROUP BY o_custkey HAVING count(o_orderkey) >= 14"),
    "having_or": ({"select": ["o_custkey", ":COUNT(o_orderkey) as n"], "from": "orders", "groups": ["o_custkey"], "havings": [{"field": "n", ">": 15}, {"or :n": "few", "=": 3}]}, "SELECT o_custkey, count(o_orderkey) AS n FROM orders GROUP BY o_custkey HAVING count(o_orderkey) > 15 OR count(o_orderkey) = 3"),
    "having_subquery": ({"select": ["c_nationkey", ":COUNT(c_custkey) as n"], "from": "customer", "groups": ["c_nationkey"], "havings": [{"field": "n", ">": {"select": [":COUNT(n_nationkey) as m"], "from": "nation"}}]}, "SELECT c_nationkey, count(c_custkey) AS n FROM customer GROUP BY c_nationkey HAVING count(c_custkey) > (SELECT count(*) FROM nation)"),
    "order_by": ({"select": ["p_partkey", "p_retailprice"], "from": "part", "orders": ["p_retailprice desc", "p_partkey"], "limit": 25}, "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25"),
    "order_multi": ({"select": ["p_brand", "p_size", "p_partkey"], "from": "part", "orders": ["p_brand desc, p_size", {"field": "p_partkey", "sort": "desc"}], "limit": 40}, "SELECT p_brand, p_size, p_partkey FROM part ORDER BY p_brand DESC, p_size, p_partkey DESC LIMIT 40"),
    "order_expr": ({"select": ["c_custkey", "c_acctbal"], "from": "customer", "orders": [":ABS(c_acctbal) desc", "c_custkey"], "limit": 20}, "SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 20"),
    "order_json": ({"select": ["event_id", "props$.k(integer) as k"], "from": "events", "orders": ["props$.k(integer) desc", "event_id"], "limit": 20}, "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events ORDER BY k DESC NULLS LAST, event_id LIMIT 20"),
    "limit": ({"select": ["o_orderkey"], "from": "orders", "orders": ["o_orderkey"], "limit": 7}, "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7"),
    "limit_offset": ({"select": ["o_orderkey"], "from": "orders", "orders": ["o_orderkey"], "limit": 7, "offset": 5}, "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7 OFFSET 5"),
    "first": ({"select": ["o_orderkey", "o_totalprice"], "from": "orders", "orders": ["o_totalprice desc", "o_orderkey"], "first": True}, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1"),
    "paginate": ({"select": ["c_custkey"], "from": "customer", "orders": ["c_custkey"], "page": 3, "pagesize": 15}, "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 15 OFFSET 30"),
    "nested_limit_ignored": ({"select": ["r_regionkey"], "query": {"select": ["r_regionkey"], "from": "region", "limit": 2}}, "SELECT r_regionkey FROM region"),
    "union_all": ({"select": ["c_custkey as id", "c_name as name"], "from": "customer", "unions": [{"select": ["s_suppkey as id", "s_name as name"], "from": "supplier"}, {"select": ["s_suppkey as id", "s_name as name"], "from": "supplier"}]}, "SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT s_suppkey, s_name FROM supplier"),
    "fn_upper": ({"select": ["c_custkey", ":UPPER(c_name) as u"], "from": "customer"}, "SELECT c_custkey, upper(c_name) AS u FROM customer"),
    "fn_concat": ({"select": ["c_custkey", ":CONCAT(c_name, ', ', c_mktsegment) as u"], "from": "customer"}, "SELECT c_custkey, c_name || ', ' || c_mktsegment AS u FROM customer"),
    "fn_substr": ({"select": ["c_custkey", ":SUBSTR(c_name, 1, 4) as u"], "from": "customer"}, "SELECT c_custkey, substr(c_name, 1, 4) AS u FROM customer"),
    "fn_length": ({"select": ["c_custkey", ":LENGTH(c_name) as u"], "from": "customer"}, "SELECT c_custkey, CAST(length(c_name) AS INTEGER) AS u FROM customer"),
    "fn_round": ({"select": ["c_custkey", ":ROUND(c_acctbal, 0) as u"], "from": "customer"}, "SELECT c_custkey, round(c_acctbal, 0) AS u FROM customer"),
    "fn_abs": ({"select": ["c_custkey", ":ABS(c_acctbal) as u"], "from": "customer"}, "SELECT c_custkey, abs(c_acctbal) AS u FROM customer"),
    "fn_year": ({"select": ["o_orderkey", ":YEAR(o_orderdate) as u"], "from": "orders"}, "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS u FROM orders"),
    "fn_if": ({"select": ["c_custkey", ":IF(:ISNULL(c_name), 'none', :IFNULL(c_name, 'x')) as u"], "from": "customer"}, "SELECT c_custkey, CASE WHEN c_name IS NULL THEN 'none' ELSE coalesce(c_name, 'x') END AS u FROM customer"),
    "fn_coalesce": ({"select": ["c_custkey", ":COALESCE(:NULLIF(c_mktsegment, 'BUILDING'), 'b') as u"], "from": "customer"}, "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'b') AS u FROM customer"),
    "fn_datetime_normalize": ({"select": ["o_orderkey", ":DATE_FORMAT(o_orderdate, '%Y-%m-%d %H:%i:%s') as d"], "from": "orders"}, "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS d FROM orders"),
    "fn_truncate": ({"select": ["c_custkey", ":ROUND(:TRUNCATE(c_acctbal, 1), 4) as u", ":TRUNCATE(c_acctbal, 0) as v"], "from": "customer"}, "SELECT c_custkey, round(trunc(c_acctbal * 10) / 10, 4) AS u, trunc(c_acctbal) AS v FROM customer"),
    "fn_date_words": ({"select": ["o_orderkey", ":DATE_FORMAT(o_orderdate, '%W, day %e of %M %Y at 100%%') as d"], "from": "orders"}, "SELECT o_orderkey, strftime(o_orderdate, '%A, day %-d of %B %Y at 100%%') AS d FROM orders"),
    "agg_stddev": ({"select": ["l_returnflag", ":ROUND(:STDDEV(l_quantity), 5) as s", ":ROUND(:STD(l_discount), 5) as t"], "from": "lineitem", "groups": ["l_returnflag"]}, "SELECT l_returnflag, round(stddev_pop(l_quantity), 5) AS s, round(stddev_pop(l_discount), 5) AS t FROM lineitem GROUP BY l_returnflag"),
    "window_row_number": ({"sql": {"stmt": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders"}}, "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rn FROM orders"),
    "window_rank": ({"sql": {"stmt": "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r FROM part"}}, "SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS INTEGER) AS r FROM part"),
    "window_running_sum": ({"sql": {"stmt": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS s FROM orders"}}, "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS s FROM orders"),
    "join_full_sql": ({"sql": {"stmt": "SELECT n.n_nationkey, s.s_suppkey FROM nation n FULL JOIN supplier s ON s.s_nationkey = n.n_nationkey"}}, "SELECT n.n_nationkey, s.s_suppkey FROM nation n FULL JOIN supplier s ON s.s_nationkey = n.n_nationkey"),
    "join_anti_sql": ({"sql": {"stmt": "SELECT c_custkey FROM customer c LEFT ANTI JOIN orders o ON o.o_custkey = c.c_custkey"}}, "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)"),
    "union_distinct_sql": ({"sql": {"stmt": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"}}, "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "agg_distinct_sql": ({"sql": {"stmt": "SELECT l_returnflag, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_returnflag"}}, "SELECT l_returnflag, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_returnflag"),
}


def _runner(entry):
    doc, params = entry[0], entry[2] if len(entry) > 2 else None

    def run(spark, folder):
        from .plans import run as R

        q = Query(catalog(spark, folder), doc)
        return R.paginate(q, params).items if doc.get("page") else q.frame(params)

    return run


QUERIES = {k: _runner(v) for k, v in DOCUMENTS.items()}
ORACLE_SQL = {k: v[1] for k, v in DOCUMENTS.items()}
