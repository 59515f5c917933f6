"""Queries of paths and communities over whole graphs, with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import community as C
from .operators import graph as G
from .operators import paths as P
from .queries_ops import EDGES, edges, view

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def add(key, run, sql=None):
    QUERIES[key] = run
    if sql:
        ORACLE_SQL[key] = sql


# ---- paths ----
_TREE = "SELECT p_partkey AS src, CAST(floor(p_partkey / 10) AS BIGINT) AS dst, 'up' AS type FROM part WHERE p_partkey >= 10"


def _one(s, name):
    return s.createDataFrame([(name,)], "id string")


def _shown(found):
    return found.select(F.array_join(F.col("nodes").cast("array<string>"), ">").alias("path"), "steps")


def _walk(source: str, start: str, most: int, both: bool) -> str:
    """All paths without a repeated edge, as SQL."""
    back = " UNION ALL SELECT dst, src, concat(src, '|', dst, '|', type) FROM e" if both else ""
    return (
        f"WITH RECURSIVE e AS ({source}), b AS (SELECT src AS f, dst AS t, concat(src, '|', dst, '|', type) AS k FROM e{back}), "
        f"w AS (SELECT id AS first, id AS last, [id] AS nodes, []::VARCHAR[] AS ks, 0 AS steps FROM ({start}) UNION ALL "
        f"SELECT first, t, list_append(nodes, t), list_append(ks, k), steps + 1 FROM w JOIN b ON f = last WHERE steps < {most} AND NOT list_contains(ks, k)) "
    )


add("graph_paths_to_goal", lambda s, d: _shown(P.paths(edges(s, d), _one(s, "c1"), 1, 3, "both", goals=_one(s, "s1"))), _walk(EDGES, "SELECT 'c1' AS id", 3, True) + "SELECT array_to_string(nodes, '>') AS path, steps FROM w WHERE last = 's1' AND steps >= 1")
add("graph_paths_of_types", lambda s, d: _shown(P.paths(edges(s, d), _one(s, "c1"), 2, 2, "both", ["R", "A"])), _walk(f"SELECT * FROM ({EDGES}) WHERE type IN ('R', 'A')", "SELECT 'c1' AS id", 2, True) + "SELECT array_to_string(nodes, '>') AS path, steps FROM w WHERE steps = 2")
_STARTS = "SELECT p_partkey AS id FROM part"
add("graph_paths_all_starts", lambda s, d: _shown(P.paths(view(s, d, _TREE), view(s, d, _STARTS), 1, 4, "out")), _walk(_TREE, _STARTS, 4, False) + "SELECT array_to_string(nodes, '>') AS path, steps FROM w WHERE steps >= 1")
add("graph_path_ends", lambda s, d: P.ends(P.paths(view(s, d, _TREE), view(s, d, _STARTS), 0, 2, "both")).select(F.col("start").alias("a"), F.col("end").alias("b"), "steps", "paths"), _walk(_TREE, _STARTS, 2, True) + "SELECT first AS a, last AS b, steps, count(*) AS paths FROM w GROUP BY ALL")

# ---- communities ----
_BOTH = f"g AS (SELECT a, b, count(*)::DOUBLE AS w FROM (SELECT src AS a, dst AS b FROM ({EDGES}) UNION ALL SELECT dst, src FROM ({EDGES})) GROUP BY a, b)"


def _labels_sql(rounds: int) -> str:
    parts = [_BOTH.replace("g AS (", "g AS MATERIALIZED (", 1), "l0 AS MATERIALIZED (SELECT DISTINCT a AS id, a AS community FROM g)"]
    for r in range(rounds):
        votes = f"SELECT a AS id, community, w FROM g JOIN l{r} ON id = b UNION ALL SELECT id, community, 1 FROM l{r}"
        parts.append(f"l{r + 1} AS MATERIALIZED (SELECT id, community FROM (SELECT id, community, row_number() OVER (PARTITION BY id ORDER BY sum(w) DESC, community) AS rn FROM ({votes}) GROUP BY id, community) WHERE rn = 1)")
    return f"WITH {', '.join(parts)} SELECT id, community FROM l{rounds}"


add("graph_communities_labels", lambda s, d: C.labels(edges(s, d), 3), _labels_sql(3))
add("graph_communities_louvain", lambda s, d: C.louvain(edges(s, d)))
add(
    "graph_modularity",
    lambda s, d: C.modularity(edges(s, d), G.communities(edges(s, d))).select(F.round("modularity", 6).alias("modularity")),
    f"WITH {_BOTH}, d AS (SELECT a AS id, count(*) % 10 AS c FROM g GROUP BY a), x AS (SELECT da.c AS ca, db.c AS cb, w FROM g JOIN d da ON da.id = a JOIN d db ON db.id = b), "
    "t AS (SELECT ca, sum(w) AS k FROM x GROUP BY ca) SELECT round((SELECT sum(w) FILTER (WHERE ca = cb) / sum(w) FROM x) - (SELECT sum(k * k) FROM t) / (SELECT sum(w) * sum(w) FROM x), 6) AS modularity",
)
