"""Collections of vectors with metadata: a Parquet folder each under one root, and what is known of each as JSON beside it."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


class Collections:
    """Folders are written as versions and the JSON record names the one that counts, so readers never meet half a table."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self._conf)

    def _name(self, name: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9_]+", name):
            raise ValueError(f"no name of a collection: {name!r}")
        return name

    def _record(self, name: str) -> dict:
        if not self.exists(name):
            raise KeyError(f"no collection {name}")
        inp = self._fs().open(self._path(name, "record.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(inp, "UTF-8"))
        finally:
            inp.close()

    def _keep(self, name: str, record: dict) -> None:
        out = self._fs().create(self._path(name, "record.json"), True)
        try:
            out.write(bytearray(json.dumps(record, ensure_ascii=False).encode()))
        finally:
            out.close()

    def exists(self, name: str) -> bool:
        return self._fs().exists(self._path(self._name(name), "record.json"))

    def create(self, name: str, rows: DataFrame, metadata: dict | None = None) -> None:
        if self.exists(name):
            raise ValueError(f"collection {name} is there")
        self._replace(name, rows, {"name": name, "metadata": metadata or {}, "version": None})

    def _replace(self, name: str, rows: DataFrame, record: dict) -> None:
        version, old = uuid.uuid4().hex, record["version"]
        rows.write.parquet(f"{self.root}/{name}/{version}")
        self._keep(name, {**record, "version": version})
        if old:
            self._fs().delete(self._path(name, old), True)

    def rows(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/{self._record(name)['version']}")

    def replace(self, name: str, rows: DataFrame) -> None:
        """New rows for a collection; rows may be made of what it holds now."""
        self._replace(name, rows, self._record(name))

    def describe(self, name: str) -> dict:
        r, df = self._record(name), self.rows(name)
        return {"name": name, "metadata": r["metadata"], "count": df.count(), "columns": dict(df.dtypes)}

    def list(self, where: dict | None = None) -> list[str]:
        """Names in order; where: equalities on metadata, a key that is missing fails."""
        fs = self._fs()
        if not fs.exists(self._path()):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(self._path()) if fs.exists(self._path(s.getPath().getName(), "record.json")))
        return [n for n in names if matches(self._record(n)["metadata"], where)]

    def update_metadata(self, name: str, metadata: dict) -> None:
        r = self._record(name)
        self._keep(name, {**r, "metadata": {**r["metadata"], **metadata}})

    def drop(self, name: str) -> bool:
        """False where there is none."""
        return self._fs().delete(self._path(self._name(name)), True)

    def backup(self, name: str, path: str) -> None:
        self.rows(name).write.mode("errorifexists").parquet(path)

    def restore(self, name: str, path: str, metadata: dict | None = None) -> None:
        self.drop(name)
        self.create(name, self.spark.read.parquet(path), metadata)


def matches(metadata: dict | None, where: dict | None) -> bool:
    return not where or (metadata is not None and all(k in metadata and metadata[k] == v and type(metadata[k]) is type(v) for k, v in where.items()))
