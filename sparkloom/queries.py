"""All queries of the engine, and the same results as DuckDB SQL."""

from __future__ import annotations

from . import queries_ddl, queries_dsl, queries_graph, queries_index, queries_knowledge, queries_more, queries_ops, queries_streams

QUERIES = queries_dsl.QUERIES | queries_ops.QUERIES | queries_more.QUERIES | queries_ddl.QUERIES | queries_knowledge.QUERIES | queries_streams.QUERIES | queries_index.QUERIES | queries_graph.QUERIES
ORACLE_SQL = queries_dsl.ORACLE_SQL | queries_ops.ORACLE_SQL | queries_more.ORACLE_SQL | queries_ddl.ORACLE_SQL | queries_knowledge.ORACLE_SQL | queries_streams.ORACLE_SQL | queries_index.ORACLE_SQL | queries_graph.ORACLE_SQL
