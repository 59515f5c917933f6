"""Queries of an inverted file over all vectors; those of the exact way with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import ivf
from .queries_ops import _scratch, emb

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _search(metric: str, exact: bool, k: int = 10):
    def run(s, d):
        index = ivf.build(emb(s, d), f"{_scratch(s)}/ivf", metric=metric)
        queries = emb(s, d).where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
        found = index.exact(queries, k) if exact else index.search(queries, k)
        return found.select("query_id", "rank", "vec_id", F.round("score", 5).alias("score"))

    return run


_SCORE = {"cosine": "list_cosine_similarity(e.v, q.v)", "dot": "list_inner_product(e.v, q.v)", "euclidean": "-list_distance(e.v, q.v)"}
for _m, _s in _SCORE.items():
    QUERIES[f"vec_ivf_exact_{_m}"] = _search(_m, True)
    ORACLE_SQL[f"vec_ivf_exact_{_m}"] = f"WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL) SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(s, 5) AS score FROM (SELECT q.vec_id AS query_id, e.vec_id, {_s} AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_s} DESC, e.vec_id) AS rank FROM x e, x q WHERE q.vec_id % 20 = 0) WHERE rank <= 10"
QUERIES["vec_ivf_search"] = _search("cosine", False)


def _cells(s, d):
    """What is stored: every vector once."""
    return ivf.build(emb(s, d), f"{_scratch(s)}/ivf").rows().select("vec_id", "label")


QUERIES["vec_ivf_rows"] = _cells
ORACLE_SQL["vec_ivf_rows"] = "SELECT vec_id, label FROM embeddings WHERE embedding IS NOT NULL"
