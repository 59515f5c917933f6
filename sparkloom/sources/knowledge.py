"""Documents, their segments with vectors, the graph drawn from them and a store of values, changed together or not at all.

A table is a list of changes in order: files of rows that were added, and files of keys
that were removed. One version record names the changes of all tables; a change writes
its files first and then the next record, so readers meet all of it or nothing, and a
writer that is lost half way leaves the last record as it was. Done again under the
same name, a change takes over what was written, and one that is in the record is not
done twice. Adding never rewrites what is there; `compact` does, now and then.

The graph's nodes and relations live as long as a segment mentions them. Mentions are a
table (kind, ref, segment_id, doc_id), not lists in each node, so a name that a third of
all segments holds is no long row, and counting references is an aggregation.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = {
    "documents": "doc_id string, title string, metadata map<string,string>",
    "segments": "id string, doc_id string, index int, text string, embedding array<double>, metadata map<string,string>",
    "nodes": "id string, name string, entity_type string",
    "edges": "id string, type string, start_node string, end_node string",
    "mentions": "kind string, ref string, segment_id string, doc_id string",
    "store": "segment_id string, key string, value string",
}


class Conflict(RuntimeError):
    """Another writer made the next version first."""


def node_id(name, entity_type):
    return F.md5(F.concat_ws("\0", entity_type, name))


def edge_id(kind, start, end):
    return F.md5(F.concat_ws("\0", kind, start, end))


class Knowledge:
    """One collection under a folder. extract(segments) gives (entities, relations):

    entities(segment_id, name, entity_type), relations(segment_id, type, start_name,
    start_type, end_name, end_type); both may be None. Ends of relations are entities too.
    Nulls and empty names are left out; what repeats in a segment is one mention.
    """

    def __init__(self, spark: SparkSession, root: str, extract: Callable[[DataFrame], tuple] | None = None):
        self.spark, self.root, self.extract = spark, root.rstrip("/"), extract
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # ---- versions ----
    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self._conf)

    def version(self) -> int:
        """The number of the last record; 0 where there is none."""
        fs, at = self._fs(), self._path("_log")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return max((int(n[:-5]) for n in names if re.fullmatch(r"\d+\.json", n)), default=0)

    def record(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "op": None, "ops": [], "tables": {t: [] for t in TABLES}}
        return self._read("_log", f"{version:012d}.json")

    def _read(self, *parts: str) -> dict:
        inp = self._fs().open(self._path(*parts))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(inp, "UTF-8"))
        finally:
            inp.close()

    def _write(self, value: dict, *parts: str) -> None:
        """A whole file under its name, or none."""
        fs, spare = self._fs(), self._path(*parts[:-1], f".{uuid.uuid4().hex}")
        out = fs.create(spare, True)
        try:
            out.write(bytearray(json.dumps(value).encode()))
        finally:
            out.close()
        if fs.exists(self._path(*parts)) or not fs.rename(spare, self._path(*parts)):
            fs.delete(spare, False)
            raise Conflict("/".join(parts))

    def table(self, name: str, version: int | None = None) -> DataFrame:
        return self._rows(name, self.record(version)["tables"][name])

    def _rows(self, name: str, changes: list[dict]) -> DataFrame:
        out = None
        for c in changes:
            if "add" in c:
                rows = self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{c['add']}")
                out = rows if out is None else out.unionByName(rows)
            elif out is not None:
                gone = self.spark.read.schema("k string").parquet(f"{self.root}/{c['del']}").withColumnRenamed("k", c["on"])
                out = out.join(gone, c["on"], "left_anti")
        return self._empty(name) if out is None else out.select(*[c.split()[0] for c in TABLES[name].split(", ")])

    def _empty(self, name: str) -> DataFrame:
        return self.spark.sql("SELECT " + ", ".join("CAST(NULL AS {1}) AS {0}".format(*c.split(" ", 1)) for c in TABLES[name].split(", ")) + " WHERE false")

    def _change(self, op: str | None, plan: Callable, most: int = 64) -> int:
        """Makes a plan's changes and the record of them; the version that holds them.

        plan(tables) is a generator of (table, "add" or the key's column, rows); it gets back
        (path, rows as written), and may give such a path again in place of rows. A table of
        None is a step between, of no record. Removals of a change come before its additions;
        "clear" removes all that was there, without rows.
        """
        op = op or uuid.uuid4().hex
        if not re.fullmatch(r"[A-Za-z0-9_-]+", op):
            raise ValueError(f"no name of a change: {op!r}")
        head = self.record()
        if op in head["ops"]:
            return head["version"]
        fs, note = self._fs(), ("_ops", f"{op}.json")
        # what a lost writer wrote counts only if the tables are still as it found them
        if fs.exists(self._path(*note)) and self._read(*note)["base"] != head["version"]:
            fs.delete(self._path(*note), False)
            for t in (*TABLES, "_steps"):
                fs.delete(self._path(t, op), True)
        if not fs.exists(self._path(*note)):
            self._write({"base": head["version"]}, *note)
        steps, back, n = plan({t: self._rows(t, c) for t, c in head["tables"].items()}), None, 0
        gone, new, was = {t: [] for t in TABLES}, {t: [] for t in TABLES}, dict(head["tables"])
        while True:
            try:
                table, how, rows = steps.send(back)
            except StopIteration:
                break
            if how == "clear":
                was[table], back = [], None
                continue
            kind = TABLES[table] if how == "add" else "k string" if table else ", ".join(f"{c} {t}" for c, t in rows.dtypes)
            at = rows if isinstance(rows, str) else f"{table or '_steps'}/{op}/{n}"
            if not isinstance(rows, str) and not fs.exists(self._path(at, "_SUCCESS")):
                rows.selectExpr(*["CAST({0} AS {1}) AS {0}".format(*c.split(" ", 1)) for c in kind.split(", ")]).write.mode("overwrite").parquet(f"{self.root}/{at}")
            if table:
                (new if how == "add" else gone)[table].append({"add": at} if how == "add" else {"del": at, "on": how})
            back, n = (at, self.spark.read.schema(kind).parquet(f"{self.root}/{at}")), n + 1
        tables = {t: [*c, *gone[t], *new[t]] for t, c in was.items()}
        self._write({"version": head["version"] + 1, "op": op, "ops": [*head["ops"][-999:], op], "tables": tables}, "_log", f"{head['version'] + 1:012d}.json")
        fs.delete(self._path(*note), False)
        fs.delete(self._path("_steps", op), True)
        return self.compact() if max(map(len, tables.values())) > most else head["version"] + 1

    def compact(self) -> int:
        """Writes each table that has more than one change anew, as one."""
        head, op = self.record(), f"compact-{uuid.uuid4().hex}"
        tables = dict(head["tables"])
        for t, changes in head["tables"].items():
            if len(changes) > 1:
                self._rows(t, changes).write.parquet(f"{self.root}/{t}/{op}/0")
                tables[t] = [{"add": f"{t}/{op}/0"}]
        new = {**head, "version": head["version"] + 1, "op": op, "tables": tables}
        self._write(new, "_log", f"{new['version']:012d}.json")
        return new["version"]

    def vacuum(self, keep: int = 1) -> int:
        """Deletes the files that none of the last records names, and older records; how many files went. No writer may be at work."""
        fs, last = self._fs(), self.version()
        named = {c.get("add") or c.get("del") for v in range(max(1, last - keep + 1), last + 1) for t in self.record(v)["tables"].values() for c in t}
        gone = 0
        for t in TABLES:
            for op in fs.listStatus(self._path(t)) if fs.exists(self._path(t)) else []:
                for part in fs.listStatus(op.getPath()):
                    if f"{t}/{op.getPath().getName()}/{part.getPath().getName()}" not in named:
                        gone += bool(fs.delete(part.getPath(), True))
        for v in range(1, last - keep + 1):
            fs.delete(self._path("_log", f"{v:012d}.json"), False)
        return gone

    # ---- documents and segments ----
    def _drawn(self, segments: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(nodes, edges, mentions) of segments."""
        nothing = tuple(map(self._empty, ("nodes", "edges", "mentions")))
        if self.extract is None:
            return nothing
        entities, relations = self.extract(segments)
        named = []
        if entities is not None:
            named.append(entities.select("segment_id", "name", "entity_type"))
        edges, mentions = nothing[1], nothing[2]
        if relations is not None:
            r = relations.where("type <> '' and start_name <> '' and end_name <> ''")
            r = r.select("segment_id", "type", "start_name", "start_type", "end_name", "end_type", node_id("start_name", "start_type").alias("start_node"), node_id("end_name", "end_type").alias("end_node")).withColumn("id", edge_id("type", "start_node", "end_node"))
            named += [r.select("segment_id", r[f"{end}_name"].alias("name"), r[f"{end}_type"].alias("entity_type")) for end in ("start", "end")]
            edges = r.select("id", "type", "start_node", "end_node").distinct()
            mentions = r.select(F.lit("edge").alias("kind"), F.col("id").alias("ref"), "segment_id")
        if not named:
            return nothing
        n = named[0]
        for other in named[1:]:
            n = n.unionByName(other)
        n = n.where("name <> ''").withColumn("id", node_id("name", "entity_type"))
        own = n.select(F.lit("node").alias("kind"), F.col("id").alias("ref"), "segment_id")
        mentions = (mentions.drop("doc_id").unionByName(own) if relations is not None else own).distinct().join(segments.select(F.col("id").alias("segment_id"), "doc_id"), "segment_id")
        return n.select("id", "name", "entity_type").distinct(), edges, mentions

    @staticmethod
    def _removed(tables: dict, gone: DataFrame, mentioned: DataFrame | None = None, values: bool = True):
        """Removes segments (k), and what neither another segment mentions nor those mentioned anew."""
        at, gone = yield "segments", "id", gone
        if gone.isEmpty():
            return
        yield "mentions", "segment_id", at
        if values:
            yield "store", "segment_id", at
        keyed = gone.select(F.col("k").alias("segment_id"), F.lit(True).alias("gone"))
        # lost is what all mentions of are gone: one join and one grouping of the mentions
        all_gone = F.min(F.col("gone").isNotNull()).alias("gone")
        lost = tables["mentions"].join(keyed, "segment_id", "left").groupBy("kind", "ref").agg(all_gone).where("gone").select("kind", "ref")
        if mentioned is not None:
            lost = lost.join(mentioned.select("kind", "ref"), ["kind", "ref"], "left_anti")
        _, lost = yield None, "lost", lost
        _, nodes = yield "nodes", "id", lost.where("kind = 'node'").select(F.col("ref").alias("k"))
        # relations go with their ends
        edges = lost.where("kind = 'edge'").select(F.col("ref").alias("k"))
        for end in ("start_node", "end_node"):
            edges = edges.unionByName(tables["edges"].join(nodes.select(F.col("k").alias(end)), end, "left_semi").select(F.col("id").alias("k")))
        at, _ = yield "edges", "id", edges.distinct()
        yield "mentions", "ref", at

    def _added(self, tables: dict, segments: DataFrame):
        """Adds segments and what they mention; the mentions."""
        _, own = yield "segments", "add", segments
        if self.extract is None:
            return self._empty("mentions")
        nodes, edges, mentions = self._drawn(own)
        for name, rows in (("nodes", nodes), ("edges", edges)):
            yield name, "add", rows.join(tables[name].select("id"), "id", "left_anti")
        return (yield "mentions", "add", mentions)[1]

    @staticmethod
    def _segments(rows: DataFrame) -> DataFrame:
        """Rows with an id each, with all columns of segments."""
        found = set(rows.columns)
        kinds = dict(c.split(" ", 1) for c in TABLES["segments"].split(", "))
        rows = rows.select(*[(F.col(c) if c in found else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()]).where("id is not null and doc_id is not null")
        return rows.dropDuplicates(["id"])

    def add_documents(self, docs: DataFrame, segments: DataFrame, op: str | None = None) -> int:
        """Adds docs(doc_id, ...) with their segments(id, doc_id, index, text, ...), replacing documents of the same id."""

        def plan(tables):
            kinds = dict(c.split(" ", 1) for c in TABLES["documents"].split(", "))
            rows = docs.select(*[(F.col(c) if c in docs.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()]).where("doc_id is not null").dropDuplicates(["doc_id"])
            _, rows = yield "documents", "add", rows
            yield "documents", "doc_id", rows.select(F.col("doc_id").alias("k"))
            mentions = yield from self._added(tables, self._segments(segments).join(rows.select("doc_id"), "doc_id", "left_semi"))
            yield from self._removed(tables, tables["segments"].join(rows.select("doc_id"), "doc_id", "left_semi").select(F.col("id").alias("k")), mentions)

        return self._change(op, plan)

    def add_segments(self, segments: DataFrame, op: str | None = None) -> int:
        """Adds segments of documents that are there; those whose id is taken are left out."""

        def plan(tables):
            own = self._segments(segments).join(tables["documents"].select("doc_id"), "doc_id", "left_semi").join(tables["segments"].select("id"), "id", "left_anti")
            yield from self._added(tables, own)

        return self._change(op, plan)

    def update_segments(self, segments: DataFrame, op: str | None = None) -> int:
        """New texts and vectors for segments(id, ...) that are there; document, index and stored values stay."""

        def plan(tables):
            found = [c for c in ("text", "embedding", "metadata") if c in segments.columns]
            given = segments.where("id is not null").dropDuplicates(["id"]).select("id", *[F.col(c).alias(f"new_{c}") for c in found])
            own = tables["segments"].join(given, "id")
            own = self._segments(own.select("id", "doc_id", "index", *[F.col(f"new_{c}" if c in found else c).alias(c) for c in ("text", "embedding", "metadata")]))
            mentions = yield from self._added(tables, own)
            yield from self._removed(tables, own.select(F.col("id").alias("k")), mentions, values=False)

        return self._change(op, plan)

    def remove_segments(self, ids: DataFrame, op: str | None = None) -> int:
        """ids(id): segments that go, with their values, and what only they mention."""
        return self._change(op, lambda tables: self._removed(tables, ids.select(F.col("id").cast("string").alias("k")).distinct()))

    def remove_documents(self, ids: DataFrame, op: str | None = None) -> int:
        """ids(doc_id): documents that go, with their segments."""

        def plan(tables):
            gone = ids.select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
            segments = tables["segments"].join(gone, "doc_id", "left_semi").select(F.col("id").alias("k"))
            yield "documents", "doc_id", gone.select(F.col("doc_id").alias("k"))
            yield from self._removed(tables, segments)

        return self._change(op, plan)

    def put_values(self, values: DataFrame, op: str | None = None) -> int:
        """values(segment_id, key, value): weights, scores and the like of segments that are there; the last of a key counts."""

        def plan(tables):
            rows = values.select("segment_id", "key", F.col("value").cast("string").alias("value")).dropDuplicates(["segment_id", "key"])
            rows = rows.join(tables["segments"].select(F.col("id").alias("segment_id")), "segment_id", "left_semi")
            kept = tables["store"].join(rows.select("segment_id"), "segment_id", "left_semi").join(rows.select("segment_id", "key"), ["segment_id", "key"], "left_anti")
            yield "store", "add", rows.unionByName(kept)
            yield "store", "segment_id", rows.select(F.col("segment_id").alias("k")).distinct()

        return self._change(op, plan)

    # ---- views ----
    def references(self, kind: str = "node", version: int | None = None) -> DataFrame:
        """The nodes (or edges) with the numbers of segments and documents that mention them."""
        counts = self.table("mentions", version).where(F.col("kind") == kind).groupBy(F.col("ref").alias("id")).agg(F.count("*").alias("n_segments"), F.count_distinct("doc_id").alias("n_documents"))
        return self.table({"node": "nodes", "edge": "edges"}[kind], version).join(counts, "id")

    def drawn_from(self, segment_ids: list[str]) -> tuple[DataFrame, DataFrame]:
        """The nodes and edges that segments mention."""
        seen = self.table("mentions").where(F.col("segment_id").isin(segment_ids)).select(F.col("ref").alias("id"), "kind").distinct()
        return tuple(self.table(t).join(seen.where(F.col("kind") == kind).select("id"), "id", "left_semi") for t, kind in (("nodes", "node"), ("edges", "edge")))

    # ---- backups ----
    def backup(self, path: str) -> dict:
        """All tables of one version as files under a new folder, and what they hold in its manifest, written last."""
        head = self.record()
        counts = {}
        for t in TABLES:
            rows = self._rows(t, head["tables"][t])
            rows.write.mode("errorifexists").parquet(f"{path}/{t}")
            counts[t] = self.spark.read.schema(TABLES[t]).parquet(f"{path}/{t}").count()
        manifest = {"version": head["version"], "tables": counts}
        Knowledge(self.spark, path)._write(manifest, "manifest.json")
        return manifest

    def restore(self, path: str, op: str | None = None) -> int:
        """Replaces all tables by those of a backup; one that is not whole is refused and changes nothing."""
        other = Knowledge(self.spark, path)
        if not other._fs().exists(other._path("manifest.json")):
            raise ValueError(f"no whole backup in {path}")
        manifest = other._read("manifest.json")
        rows = {t: self.spark.read.schema(TABLES[t]).parquet(f"{path}/{t}") for t in TABLES}
        if bad := [t for t in TABLES if rows[t].count() != manifest["tables"][t]]:
            raise ValueError(f"the backup lacks rows of {', '.join(bad)}")

        def plan(tables):
            for t in TABLES:
                yield t, "clear", None
                yield t, "add", rows[t]

        return self._change(op, plan)
