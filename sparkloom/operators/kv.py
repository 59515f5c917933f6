"""Key-value store operations over a table (key, value, type, expired_at, created_at, updated_at)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def live(kv: DataFrame, now: Column) -> DataFrame:
    return kv.filter(F.col("expired_at").isNull() | (F.col("expired_at") > now))


def get(kv, key, now):
    return live(kv, now).filter(F.col("key") == F.lit(key))


def matching(pattern: str) -> Column:
    """Only a star at the end is a wild card."""
    return F.col("key").startswith(pattern[:-1]) if pattern.endswith("*") else F.col("key") == pattern


def keys(kv, pattern, now):
    return live(kv, now).filter(matching(pattern)).select("key")


def delete(kv, pattern):
    return kv.filter(~matching(pattern))


def put(kv: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert of rows with the same columns: the latest updated_at of a key stays."""
    rest = [c for c in kv.columns if c not in ("key", "updated_at")]
    both = kv.unionByName(new)
    return both.groupBy("key").agg(F.max(F.struct("updated_at", *rest)).alias("x")).select(*[F.col("key") if c == "key" else F.col(f"x.{c}").alias(c) for c in kv.columns])


def incr(kv, key, by: int = 1, now=None):
    """The entry of key counted on; a missing or (by now) expired one begins at 0, as does a value that is no number. The time to live is dropped."""
    on = F.col("key") == key
    number = F.expr("try_cast(value AS bigint)")
    alive = on if now is None else on & (F.col("expired_at").isNull() | (F.col("expired_at") > now))
    made = {"key": F.lit(key), "value": (F.coalesce(F.max(F.when(alive, number)), F.lit(0)) + by).cast("string"), "expired_at": F.lit(None)}
    # one row, whether the key is there or not
    one = kv.where(on).agg(*[made.get(c, F.max(c)).cast(t).alias(c) for c, t in kv.dtypes])
    return kv.where(~on).unionByName(one)


def push_key(kv: DataFrame, key: str, *items) -> DataFrame:
    """The lists (key, v) with items behind those of key; a missing key is made."""
    kind, name = dict(kv.dtypes)["v"], F.lit(key).cast(dict(kv.dtypes)["key"])
    on = F.col("key") == name
    one = kv.where(on).agg(*[name.alias("key") if c == "key" else F.concat(F.coalesce(F.first("v", ignorenulls=True), F.array().cast(kind)), F.array(*map(F.lit, items)).cast(kind)).alias("v") if c == "v" else F.first(c).alias(c) for c in kv.columns])
    return kv.where(~on).unionByName(one)


def pop_key(kv: DataFrame, key: str, last: bool = True) -> DataFrame:
    """The lists (key, v) without the last or first item of key; an emptied list goes with its key."""
    on = F.col("key") == key
    return kv.withColumn("v", F.when(on, pop(F.col("v"), last)).otherwise(F.col("v"))).where(~on | F.col("v").isNotNull())


def push(value: Column, *items) -> Column:
    return F.concat(value, F.array(*map(F.lit, items)))


def pop(value: Column, last: bool = True) -> Column:
    """The list without its last or first item; null (the key goes) when nothing is left."""
    n = F.size(value)
    return F.when(n > 1, F.slice(value, F.lit(1) if last else F.lit(2), n - 1))


def pull(value: Column, item) -> Column:
    return F.filter(value, lambda x: x.cast("string") != F.lit(item).cast("string"))


def pull_all(value: Column, items) -> Column:
    return F.filter(value, lambda x: ~x.cast("string").isin([str(i) for i in items]))


def add_to_set(value: Column, *items) -> Column:
    return F.concat(value, F.filter(F.array_distinct(F.array(*map(F.lit, items))), lambda x: ~F.array_contains(value, x)))


def array_slice(value: Column, skip: int, limit: int) -> Column:
    return F.when(F.size(value) > skip, F.slice(value, skip + 1, limit)).otherwise(F.slice(value, 1, 0))


def array_page(value: Column, page: int, size: int) -> Column:
    return array_slice(value, (max(1, page) - 1) * size, size)


def array_set(value: Column, index: int, item) -> Column:
    return F.when(F.size(value) > index, F.transform(value, lambda x, i: F.when(i == index, F.lit(item)).otherwise(x))).otherwise(F.raise_error(F.lit("index out of range")))


def array_len(value: Column) -> Column:
    return F.coalesce(F.size(value), F.lit(0))


def array_get(value: Column, index: int) -> Column:
    """The item at an index from 0; one out of range is an error."""
    return F.when((F.size(value) > index) & F.lit(index >= 0), F.get(value, F.lit(index))).otherwise(F.raise_error(F.lit("index out of range")))


def decr(kv: DataFrame, key: str, by: int = 1) -> DataFrame:
    return incr(kv, key, -by)


def get_multi(kv: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """(key, value) of every key of wanted(key); a key that is not there, or late, has a null value."""
    return wanted.select("key").distinct().join(live(kv, now).select("key", "value"), "key", "left")


def get_set_multi(kv: DataFrame, wanted: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(values, table afterwards) of wanted(key, value, ...) with the store's columns: what is there is kept, else the row given is written."""
    there = live(kv, now).join(wanted.select("key"), "key", "left_semi")
    fresh = wanted.join(there.select("key"), "key", "left_anti").select(*kv.columns)
    gone = kv.join(fresh.select("key"), "key", "left_anti")
    return there.unionByName(fresh).select("key", "value"), gone.unionByName(fresh)


def get_del(kv: DataFrame, key: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(the entry, the table without it)."""
    return get(kv, key, now), kv.filter(F.col("key") != F.lit(key))


def del_multi(kv: DataFrame, names: list[str]) -> DataFrame:
    return kv.filter(~F.col("key").isin(names))


def clear(kv: DataFrame) -> DataFrame:
    return kv.limit(0)
