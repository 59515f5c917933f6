"""Queries of collections that change as a whole, over all documents' lines, with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .queries_ops import _scratch
from .sources.knowledge import Knowledge

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def add(key, run, sql):
    QUERIES[key] = run
    ORACLE_SQL[key] = sql


_WORD = "[A-Z][a-z]{5,}"


def _extract(segments):
    """Long capitalised words are entities; those that follow each other in a line are related."""
    words = segments.select(F.col("id").alias("segment_id"), F.regexp_extract_all("text", F.lit(f"({_WORD})"), 1).alias("w"))
    entities = words.select("segment_id", F.explode("w").alias("name"), F.lit("word").alias("entity_type"))
    pairs = words.where("size(w) > 1").select("segment_id", F.explode(F.expr("transform(sequence(1, size(w) - 1), i -> struct(w[i - 1] AS a, w[i] AS b))")).alias("p"))
    return entities, pairs.select("segment_id", F.lit("next").alias("type"), F.col("p.a").alias("start_name"), F.lit("word").alias("start_type"), F.col("p.b").alias("end_name"), F.lit("word").alias("end_type"))


def _parts(s, d, where="true"):
    docs = s.read.parquet(f"{d}/documents.parquet").where("text is not null").where(where).withColumn("doc_id", F.col("doc_id").cast("string"))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("index", "text"))
    return docs.select("doc_id", F.col("lang").alias("title")), lines.withColumn("id", F.concat_ws(":", "doc_id", "index"))


def _base(s, d):
    base = Knowledge(s, _scratch(s), _extract)
    base.add_documents(*_parts(s, d, "lang = 'en'"))
    base.add_documents(*_parts(s, d, "lang <> 'en' or lang is null"))
    return base


_SEG = "(SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, k - 1 AS i, l[k] AS t FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM documents WHERE text IS NOT NULL))"


def _words(text="t", where="true"):
    return f"SELECT DISTINCT doc_id, i, unnest(regexp_extract_all({text}, '{_WORD}')) AS name FROM {_SEG} WHERE {where}"


def _counts(sql):
    return f"SELECT name, count(*) AS n_segments, count(DISTINCT doc_id) AS n_documents FROM ({sql}) GROUP BY name"


def _nodes(base):
    return base.references().select("name", "n_segments", "n_documents")


add("knowledge_add", lambda s, d: _nodes(_base(s, d)), _counts(_words()))


def _removed(s, d):
    base = _base(s, d)
    base.remove_documents(_parts(s, d, "lang = 'fr'")[0])
    base.remove_segments(_parts(s, d)[1].where("index = 0").select("id"))
    return base


_LEFT = "lang IS DISTINCT FROM 'fr' AND i > 0"
add("knowledge_remove", lambda s, d: _nodes(_removed(s, d)), _counts(_words(where=_LEFT)))


def _edges(s, d):
    base = _removed(s, d)
    names = base.table("nodes").select("id", "name")
    return base.references("edge").join(names.toDF("start_node", "a"), "start_node").join(names.toDF("end_node", "b"), "end_node").select("a", "b", "n_segments")


add("knowledge_relations", _edges, f"SELECT a, b, count(*) AS n_segments FROM (SELECT DISTINCT doc_id, i, w[k] AS a, w[k + 1] AS b FROM (SELECT doc_id, i, w, unnest(range(1, len(w))) AS k FROM (SELECT doc_id, i, regexp_extract_all(t, '{_WORD}') AS w FROM {_SEG} WHERE {_LEFT}))) GROUP BY 1, 2")


def _updated(s, d):
    base = _base(s, d)
    base.update_segments(_parts(s, d)[1].where("index = 0").select("id", F.expr("upper(text)").alias("text")))
    base.compact()
    return _nodes(base)


add("knowledge_update", _updated, _counts(_words("CASE WHEN i = 0 THEN upper(t) ELSE t END")))


def _restored(s, d):
    base, saved = _base(s, d), _scratch(s)
    base.backup(saved)
    base.remove_documents(_parts(s, d)[0])
    base.restore(saved)
    return _nodes(base)


add("knowledge_restore", _restored, _counts(_words()))
