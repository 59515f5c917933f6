"""Tables and models by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Catalog:
    """Resolves table names to DataFrames: registered ones first, then Parquet files of a folder, then the session's tables."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder
        self._tables: dict[str, DataFrame | Callable[[], DataFrame]] = {}
        self.models: dict = {}
        self.key: str | None = None

    def register(self, name: str, table: DataFrame | Callable[[], DataFrame]) -> "Catalog":
        self._tables[name] = table
        return self

    def model(self, name: str, model) -> "Catalog":
        self.models[name] = model
        return self

    def scan(self, name: str) -> DataFrame:
        if name in self._tables:
            t = self._tables[name]
            return t() if callable(t) else t
        if self.folder is not None:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self.spark.table(name)

    def model_table(self, name: str) -> str:
        model = self.models.get(name)
        if model is None:
            raise KeyError(f"no model {name}")
        return model if isinstance(model, str) else model.table

    def views(self, *names: str) -> None:
        """Makes tables visible to raw SQL as temporary views."""
        for name in names:
            self.scan(name).createOrReplaceTempView(name)


class Engines:
    """Named engines; names are lower-cased, aliases point to engines."""

    def __init__(self):
        self._found: dict[str, Catalog] = {}

    def register(self, name: str, engine: Catalog) -> None:
        self._found[name.lower()] = engine

    def unregister(self, name: str) -> None:
        self._found.pop(name.lower(), None)

    def alias(self, name: str, other: str) -> None:
        self._found[other.lower()] = self._found[name.lower()]

    def select(self, name: str) -> Catalog:
        if name.lower() not in self._found:
            raise KeyError(f"no engine {name}")
        return self._found[name.lower()]
