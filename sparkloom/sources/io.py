"""Exports, imports, snapshots and external sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def export(df: DataFrame, path: str, model: str, key: str, chunk: int = 5000) -> None:
    """JSON lines of {model, columns, values}, a chunk of rows each, in the order of the key."""
    columns = df.columns
    text = [F.date_format(c, "yyyy-MM-dd HH:mm:ss") if t.startswith("timestamp") else F.col(c).cast("string") for c, t in df.dtypes]
    n = df.count()
    # ranges of the key come out in order; each partition cuts its own chunks
    ranged = df.repartitionByRange(max(1, -(-n // chunk)), key).select(F.spark_partition_id().alias("__p"), F.col(key).alias("__key"), F.array(*text).alias("v"))
    rows = ranged.groupBy("__p").agg(F.sort_array(F.collect_list(F.struct("__key", "v"))).alias("x"))
    rows.select(F.lit(model).alias("model"), F.array(*map(F.lit, columns)).alias("columns"), F.transform("x", lambda r: r["v"]).alias("values"), F.col("__p").alias("chunk")).write.mode("overwrite").json(path)


def load(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Rows of an export, as they were, with the columns and types of a table like theirs."""
    raw = spark.read.schema("model string, columns array<string>, values array<array<string>>").json(path)
    rows = raw.select("columns", F.explode("values").alias("v"))
    return rows.select(*[F.expr(f"try_cast(element_at(v, cast(array_position(columns, '{c}') as int)) as {t})").alias(c) for c, t in like.dtypes])


class Snapshots:
    """Copies of a table under a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def take(self, df: DataFrame, name: str) -> str:
        df.write.mode("errorifexists").parquet(self._path(name))
        return name

    def exists(self, name: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self._path(name))
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def restore(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._path(name))

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self._path(name))
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 32, **options) -> DataFrame:
    """A table of an external database, read in key ranges where bounds are given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of text files; bytes that are no UTF-8 are replaced."""
    return spark.read.format("binaryFile").load(path).select("path", F.expr("make_valid_utf8(cast(content as string))").alias("text"))
