"""Property graphs as two tables: nodes(id, ...) and edges(src, dst, type, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rounds import settled


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def relations(edges: DataFrame, ids: list, way: str = "both", types: list[str] | None = None) -> DataFrame:
    df = edges.filter(F.col("type").isin(types)) if types else edges
    return df.filter({"out": F.col("src").isin(ids), "in": F.col("dst").isin(ids), "both": F.col("src").isin(ids) | F.col("dst").isin(ids)}[way])


def hop(edges: DataFrame, start: DataFrame, way: str = "both") -> DataFrame:
    """(start, id) of neighbours of start(start, id)."""
    e = {"out": edges.select("src", "dst"), "in": edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "both": both_ways(edges)}[way]
    return start.join(e, start["id"] == e["src"]).select("start", F.col("dst").alias("id")).distinct()


def reachable(edges: DataFrame, start: DataFrame, least: int = 1, most: int = 2, way: str = "out") -> DataFrame:
    """(start, id, depth): nodes at their least number of steps; each round joins only what the round before found."""
    if not 0 <= least <= most <= 10:
        raise ValueError("0 <= least <= most <= 10")
    front = start.select(F.col("id").alias("start"), "id").distinct()
    seen = front.withColumn("depth", F.lit(0))
    for d in range(1, most + 1):
        front = hop(edges, front, way).join(seen, ["start", "id"], "left_anti")
        seen = seen.unionByName(front.withColumn("depth", F.lit(d)))
    return seen.filter(F.col("depth").between(least, most))


def shortest_path(edges: DataFrame, a, b, most: int = 10, way: str = "both") -> list | None:
    """Nodes of a shortest path (of several the one that is first in order); the search ends where b is met."""
    spark = edges.sparkSession
    fix = _fixed(spark)  # a round then starts from the one before, not from the first, and edges are made once
    e = fix(edges.select("src", "dst"))
    e = both_ways(e) if way == "both" else e
    kind = dict(edges.dtypes)["src"]
    front = spark.range(1).select(F.array(F.lit(a).cast(kind)).alias("path"), F.lit(a).cast(kind).alias("id"))
    seen = front.select("id")
    for _ in range(most + 1):
        if hit := front.filter(F.col("id") == F.lit(b)).select("path").limit(1).collect():
            return list(hit[0]["path"])
        step = front.join(e, front["id"] == e["src"]).select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("id"))
        front = fix(step.groupBy("id").agg(F.min("path").alias("path")).join(seen, "id", "left_anti").select("path", "id"))
        seen = seen.unionByName(front.select("id"))  # what is in front is in none before
    return None


def _fixed(spark):
    """How a table of a round is kept: as one that is written, by Spark's checkpoint or, without a folder that all nodes share, not at all."""
    if spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.master.startswith("local"):
        return settled
    return DataFrame.checkpoint if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else lambda df: df


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree) of every node, edges counted at both ends."""
    ends = both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def rank_by_degree(nodes, edges) -> DataFrame:
    return degrees(nodes, edges).select("id", (F.col("degree") / (F.col("degree") + 1)).alias("score"))


def constant_centrality(nodes) -> DataFrame:
    return nodes.select("id", F.lit(0.0).alias("score"))


def communities(edges: DataFrame, buckets: int = 10) -> DataFrame:
    """(id, degree, community): distinct neighbours, and their number modulo the buckets; nodes without edges are left out."""
    d = both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("degree"))
    return d.withColumn("community", F.col("degree") % buckets)


def page_rank(nodes: DataFrame, edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """Extension: iterated PageRank, checkpointed where a checkpoint folder is set."""
    n = nodes.count()
    out = edges.groupBy("src").agg(F.count("*").alias("n"))
    links = edges.join(out, "src").select("src", "dst", "n")
    rank = nodes.select("id", F.lit(1.0 / max(n, 1)).alias("rank"))
    for k in range(rounds):
        sent = links.join(rank, links["src"] == rank["id"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("n")).alias("got"))
        rank = nodes.select("id").join(sent, "id", "left").select("id", ((1 - damping) / max(n, 1) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if k % 5 == 4 and nodes.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            rank = rank.checkpoint()
    return rank


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Upsert by latest wins: one row of each key, the one with the greatest order."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    return rows.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("__x")).select(*keys, f"__x.{order}", *[f"__x.{c}" for c in rest])


def first_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Dedup by first occurrence, with map-side combining."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    return rows.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("__x")).select(*keys, f"__x.{order}", *[f"__x.{c}" for c in rest])


def without_sources(entities: DataFrame, gone: list[str]) -> DataFrame:
    """Entities without these source documents; those with none left go."""
    left = F.array_except("sources", F.array(*map(F.lit, gone)))
    return entities.withColumn("sources", left).filter(F.size("sources") > 0)


def delete_nodes(nodes: DataFrame, edges: DataFrame, where, detach: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without the nodes that a condition holds for and, detached, without their edges.
    Without detach a node that still has edges is an error."""
    hit = F.coalesce(where, F.lit(False))
    gone = nodes.filter(hit).select(F.col("id").alias("__gone"))
    left = edges.join(gone, F.col("src") == F.col("__gone"), "left_anti").join(gone, F.col("dst") == F.col("__gone"), "left_anti")
    if not detach:
        bound = edges.join(gone, (F.col("src") == F.col("__gone")), "left_semi").limit(1).count() or edges.join(gone, F.col("dst") == F.col("__gone"), "left_semi").limit(1).count()
        if bound:
            raise ValueError("nodes that go still have edges")
    return nodes.filter(~hit), left


def delete_edges(edges: DataFrame, where) -> DataFrame:
    return edges.filter(~F.coalesce(where, F.lit(False)))


def remap(edges: DataFrame, canonical: DataFrame) -> DataFrame:
    """Edges with both ends replaced by canonical(id, to) where they are in it."""
    out = edges
    for end in ("src", "dst"):
        to = canonical.select(F.col("id").alias("__id"), F.col("to").alias("__to"))
        out = out.join(to, F.col(end) == F.col("__id"), "left").withColumn(end, F.coalesce("__to", end)).drop("__id", "__to")
    return out


def canonical_ids(entities: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(id, to): every entity's id and that of the first one with the same keys; an id in several groups goes to its first one's."""
    first = first_of(entities.select("id", order, *keys), keys, order).select(*keys, F.col("id").alias("to"))
    same = [F.col(f"e.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    both = entities.alias("e").join(first.alias("f"), same)
    return both.groupBy(F.col("e.id").alias("id")).agg(F.min_by("to", order).alias("to"))


def merge_entities(stored: DataFrame, new: DataFrame, keys: list[str], lists: list[str]) -> DataFrame:
    """Stored entities with new ones: lists are united without repeats and empty names, stored items first; the version of one
    that both have rises by 1, a new one begins at 1. Each side has one row of each key; other columns are the new one's."""
    rest = [c for c in stored.columns if c not in (*keys, *lists, "version")]
    a, b = stored.withColumn("__there", F.lit(1)).alias("a"), new.withColumn("__there", F.lit(1)).alias("b")
    both = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full")
    here, there = F.col("b.__there").isNotNull(), F.col("a.__there").isNotNull()
    none = F.array().cast("array<string>")
    united = [F.filter(F.array_distinct(F.concat(F.coalesce(f"a.{c}", none), F.coalesce(f"b.{c}", none))), lambda x: x != "").alias(c) for c in lists]
    version = F.when(~there, 1).when(here, F.col("a.version") + 1).otherwise(F.col("a.version"))
    given = {c for c in rest if c in new.columns}
    others = [(F.when(here, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")) if c in given else F.col(f"a.{c}")).alias(c) for c in rest]
    return both.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], *united, *others, version.cast("int").alias("version"))


def search_text(nodes: DataFrame, question: str, extract) -> DataFrame:
    """Nodes named in a question: extract(question) gives names, each looked for in node names without regard to case."""
    names = [n for n in extract(question) if n]
    hit = F.lit(False)
    for n in names:
        hit = hit | F.lower("name").contains(n.lower())
    return nodes.filter(hit)


def backup(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as JSON lines of {kind, data}, in the folder path."""
    lines = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct("*")).alias("data")).unionByName(edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct("*")).alias("data")))
    lines.write.mode("errorifexists").json(path)


def restore(spark, path: str, nodes_schema: str, edges_schema: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a backup."""
    raw = spark.read.schema("kind string, data string").json(path)
    return tuple(raw.filter(F.col("kind") == k).select(F.from_json("data", s).alias("x")).select("x.*") for k, s in (("node", nodes_schema), ("edge", edges_schema)))


def cypher(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(statement): a graph as CREATE statements, nodes before edges."""
    def quoted(c):
        return F.concat(F.lit("'"), F.regexp_replace(F.col(c).cast("string"), r"(['\\])", r"\\$1"), F.lit("'"))

    def properties(df, leave):
        parts = [F.concat(F.lit(f"{c}: "), quoted(c)) for c in df.columns if c not in leave]
        return F.array_join(F.array_compact(F.array(*parts)), ", ")

    label = F.concat(F.lit(":`"), "label", F.lit("`")) if "label" in nodes.columns else F.lit("")
    made = nodes.select(F.lit(0).alias("place"), F.concat(F.lit("CREATE (n"), label, F.lit(" {"), properties(nodes, ("label",)), F.lit("})")).alias("statement"))
    ends = F.concat(F.lit("MATCH (a {id: "), quoted("src"), F.lit("}), (b {id: "), quoted("dst"), F.lit("}) CREATE (a)-[:`"), F.col("type"), F.lit("`]->(b)"))
    return made.unionByName(edges.select(F.lit(1).alias("place"), ends.alias("statement")))
