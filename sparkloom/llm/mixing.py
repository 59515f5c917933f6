"""Mixing to target weights: iterative proportional fitting (raking) and calibrated sampling.

The corpus becomes a table of cells (source, language, topic) with their tokens.
Raking scales the cells' weights to each marginal's targets in turn until all
marginals hold. A document's probability is its cell's weight for its tokens,
times the common factor with which the `keep` share of tokens is kept. Where
some probability would pass 1, it is 1, and raking goes on with what the other
cells can give; a target beyond all tokens of its value is met as far as they go
and the rest is spread over the other values. Targets that are not met are
reported in a warning.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import fresh, keep

#: Up to so many cells are raked on the driver (a few numbers each); more are raked as a distributed table.
DRIVER_CELLS = 500_000
TOPICS = 8
ROUNDS, CLOSE = 100, 1e-9
TEMPER = 0.7
#: Stands for null among a dimension's values.
NONE = "\0null"


def topic(text) -> F.Column:
    """A topic in 0..TOPICS-1 from the whole text: its greatest word of 6 characters or more, by hash; a stand-in where no topic model is at hand."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: F.length(w) >= 6)
    return F.pmod(F.crc32(F.coalesce(F.array_max(words), F.lit(""))), F.lit(TOPICS)).cast("int")


def tempered(cells: DataFrame, dim: str, power: float = TEMPER) -> DataFrame:
    """Targets (value, share) of a dimension: its shares of tokens to a power under 1, so that small ones gain."""
    sums = cells.groupBy(F.col(dim).alias("value")).agg(F.sum("tokens").alias("t")).where("t > 0")
    total = sums.agg(F.sum(F.pow("t", F.lit(power))).alias("s"))
    return sums.crossJoin(F.broadcast(total)).select("value", (F.pow("t", F.lit(power)) / F.col("s")).alias("share"))


def rake_local(cells: pd.DataFrame, targets: dict[str, dict], rounds: int = ROUNDS, close: float = CLOSE) -> pd.Series:
    """Weights of cells(dims..., tokens), summing to 1, whose marginals are the targets (value -> share)."""
    w = cells["tokens"] / cells["tokens"].sum()
    for _ in range(rounds):
        worst = 0.0
        for dim, share in targets.items():
            now = w.groupby(cells[dim], dropna=False).transform("sum")
            want = cells[dim].map(share).astype(float)
            factor = (want / now).where(now > 0, 0.0)
            worst = max(worst, float((factor - 1).abs().where(w > 0, 0.0).max()))
            w = w * factor
        if worst < close:
            break
    return w / w.sum()


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, close: float = CLOSE) -> DataFrame:
    """The same for a table of any number of cells: each step is an aggregation and a join with its marginal."""
    total = cells.agg(F.sum("tokens").alias("total"))
    w = keep(cells.crossJoin(F.broadcast(total)).withColumn("w", F.col("tokens") / F.col("total")).drop("total"), "rake")
    for _ in range(rounds):
        w = w.withColumn("off", F.lit(0.0))
        for dim, share in targets.items():
            now = w.groupBy(dim).agg(F.sum("w").alias("now")).join(share.withColumnRenamed("value", dim), dim).select(dim, F.when(F.col("now") > 0, F.col("share") / F.col("now")).otherwise(0.0).alias("factor"))
            w = w.join(now, dim).withColumn("off", F.greatest("off", F.when(F.col("w") > 0, F.abs(F.col("factor") - 1)).otherwise(0.0))).withColumn("w", F.col("w") * F.col("factor")).drop("factor")
        w = keep(w, "rake")
        if (w.agg(F.max("off")).first()[0] or 0.0) < close:
            break
        w = w.drop("off")
    return w.drop("off")


def complete(cells: DataFrame, dim: str, goal: DataFrame) -> DataFrame:
    """A target for every value: those that goal(value, share) does not name take what it leaves of 1, by their tokens.

    Where it leaves nothing they get none. All shares are scaled to sum to 1, so both ways of raking see the same table.
    """
    own = cells.groupBy(F.col(dim).alias("value")).agg(F.sum("tokens").alias("t"))
    every = own.join(goal.groupBy("value").agg(F.sum("share").alias("share")), "value", "full")
    sums = every.agg(F.coalesce(F.sum("share"), F.lit(0.0)).alias("named"), F.coalesce(F.sum(F.when(F.col("share").isNull(), F.col("t"))), F.lit(0)).alias("rest"))
    left = F.when(F.col("rest") > 0, F.greatest(F.lit(0.0), 1 - F.col("named"))).otherwise(0.0)
    share = F.coalesce("share", left * F.col("t") / F.col("rest")) / F.when(F.col("named") + left > 0, F.col("named") + left)
    return every.crossJoin(F.broadcast(sums)).select("value", share.alias("share")).where("share is not null")


def _goal(spark, dim: str, shares: dict) -> DataFrame:
    if not all(math.isfinite(v) and v >= 0 for v in shares.values()):
        raise ValueError(f"shares of {dim} must be finite and not negative: {shares}")
    kind = int if dim == "topic" else lambda v: NONE if v is None else str(v)
    return spark.createDataFrame([(kind(k), float(v)) for k, v in shares.items()], f"value {'int' if dim == 'topic' else 'string'}, share double")


def level(total: float, at) -> float:
    """The factor g with sum(least(t, g * x)) = total; at(g): sum of t where g * x >= t, and of x elsewhere. Without one: where all are full."""
    g = 0.0
    for _ in range(ROUNDS):
        full, free = at(g)
        if not free or (new := (total - full) / free) <= g * (1 + 1e-12):
            break
        g = new
    return g


def _factor(np_or_f, want, full, free):
    """What a value's cells are scaled with: those at probability 1 stay so where the others can give the rest."""
    where = np.where if np_or_f is np else lambda c, a, b: F.when(c, a).otherwise(b)
    one = 1.0 if np_or_f is np else F.lit(1.0)
    safe = where(free > 0, free, one)
    both = where(full + free > 0, full + free, one)
    return where(want > full, where(free > 0, (want - full) / safe, one), want / both)


def bound_local(cells: pd.DataFrame, targets: dict[str, dict], share: float, rounds: int = ROUNDS, close: float = CLOSE) -> pd.Series:
    """Probabilities of cells(dims..., tokens, w), w raked without bounds, that keep the share of tokens."""
    t = cells["tokens"].astype(float)
    w = cells["w"].fillna(0.0)
    total = share * t[w > 0].sum()
    u = total * w / t
    if not (u > 1).any():
        return u
    wanted = {}
    for dim, goal in targets.items():
        own = t[w > 0].groupby(cells[dim]).sum()
        goal = own.index.to_series().map(goal).fillna(0.0).astype(float)
        g = level(total, lambda g: (own[g * goal >= own].sum(), goal[g * goal < own].sum()))
        wanted[dim] = cells[dim].map(np.minimum(own, g * goal)).fillna(0.0)
    for _ in range(rounds):
        worst = 0.0
        for dim, want in wanted.items():
            full, free = (x.groupby(cells[dim]).transform("sum") for x in (t.where(u >= 1, 0.0), (t * u).where(u < 1, 0.0)))
            worst = max(worst, float(((full + free - want).abs() / total).max()))
            u = u * _factor(np, want, full, free)
        if worst < close:
            break
    g = level(total, lambda g: (t[g * u >= 1].sum(), (t * u)[g * u < 1].sum()))
    return np.minimum(1.0, g * u)


def bound(cells: DataFrame, targets: dict[str, DataFrame], share: float, rounds: int = ROUNDS, close: float = CLOSE) -> DataFrame:
    """The same for a table of any number of cells, with the probability as p."""
    sums = cells.where("w > 0").agg(F.sum("tokens"), F.max(F.col("w") / F.col("tokens"))).first()
    total = share * (sums[0] or 0)
    t = F.col("tokens")
    u = cells.withColumn("u", F.lit(total) * F.col("w") / t)
    if total * (sums[1] or 0.0) <= 1:
        return u.withColumnRenamed("u", "p")

    def two(df, full, a, b):
        r = df.agg(F.sum(F.when(full, a)), F.sum(F.when(~full, b))).first()
        return r[0] or 0.0, r[1] or 0.0

    wanted = {}
    for dim, goal in targets.items():
        own = keep(cells.where("w > 0").groupBy(dim).agg(F.sum("tokens").cast("double").alias("own")).join(goal.withColumnRenamed("value", dim), dim), "goals")
        g = level(total, lambda g, own=own: two(own, F.lit(g) * F.col("share") >= F.col("own"), F.col("own"), F.col("share")))
        wanted[dim] = own.select(dim, F.least("own", F.lit(g) * F.col("share")).alias("want"))
    for _ in range(rounds):
        u = u.withColumn("off", F.lit(0.0))
        for dim, want in wanted.items():
            now = u.groupBy(dim).agg(F.coalesce(F.sum(F.when(F.col("u") >= 1, t)), F.lit(0.0)).alias("full"), F.coalesce(F.sum(F.when(F.col("u") < 1, t * F.col("u"))), F.lit(0.0)).alias("free")).join(want, dim)
            now = now.select(dim, _factor(F, F.col("want"), F.col("full"), F.col("free")).alias("factor"), (F.abs(F.col("full") + F.col("free") - F.col("want")) / total).alias("far"))
            u = u.join(now, dim).withColumn("u", F.col("u") * F.col("factor")).withColumn("off", F.greatest("off", "far")).drop("factor", "far")
        u = keep(u, "bound")
        if (u.agg(F.max("off")).first()[0] or 0.0) < close:
            break
    g = level(total, lambda g: two(u, F.lit(g) * F.col("u") >= 1, t.cast("double"), t * F.col("u")))
    return keep(u.drop("off").withColumn("p", F.least(F.lit(1.0), F.lit(g) * F.col("u"))).drop("u"), "bound")


def unmet(weights: DataFrame, targets: dict[str, DataFrame], by: float = 1e-3) -> DataFrame:
    """dim, value, share, got: the targets that the probabilities p of weights(dims..., tokens, p) miss by more than that."""
    total = weights.agg(F.sum(F.col("tokens") * F.col("p")).alias("total"))
    out = None
    for dim, goal in targets.items():
        now = weights.groupBy(F.col(dim).alias("value")).agg(F.sum(F.col("tokens") * F.col("p")).alias("got")).crossJoin(F.broadcast(total))
        own = goal.join(now, "value", "left").select(F.lit(dim).alias("dim"), F.col("value").cast("string").alias("value"), "share", F.coalesce(F.col("got") / F.col("total"), F.lit(0.0)).alias("got"))
        out = own if out is None else out.unionByName(own)
    return out.where(F.abs(F.col("got") - F.col("share")) > by)


def calibrated(docs: DataFrame, share: float = 0.5, targets: dict[str, dict] | None = None, seed: int = 7, topic_of=None) -> DataFrame:
    """docs with __p (probability) and __take (drawn by it), by raked weights of source, lang and topic.

    docs(doc_id, text, lang, source, ...). Tokens are white-space words. targets:
    value -> share for any of source, lang and topic; without them, tempered
    shares. Values that a dimension's targets do not name share what is left of 1
    by their tokens (nothing, if the named ones sum to 1 or more); shares are
    scaled to sum to 1, negative ones are an error. A dimension without targets is
    left as raking the others makes it. Nulls are values like others. A document without tokens has weight 0
    and is not drawn. The draw is a hash of doc_id and seed: rows that repeat a
    doc_id are drawn or not together, a null doc_id counts as one value. An empty
    table stays empty. Marginals that contradict each other, and such as are not
    met after ROUNDS rounds, end nearest to the last one and are in the warning.
    topic_of gives a document's topic (a whole number) from its text, or a column
    in its place. Columns of docs whose names begin with two underscores may clash.
    """
    none = F.lit(NONE)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = docs.withColumn("__tokens", F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long"))
    marked = marked.withColumn("__s", F.coalesce(F.col("source").cast("string"), none)).withColumn("__l", F.coalesce(F.col("lang").cast("string"), none)).withColumn("__t", (topic_of or topic)(F.col("text").cast("string")))
    dims = {"source": "__s", "lang": "__l", "topic": "__t"}
    cells = keep(marked.groupBy(*dims.values()).agg(F.sum("__tokens").alias("tokens")).where("tokens > 0"), "cells")
    spark = docs.sparkSession
    if targets is None:
        wanted = {c: tempered(cells, c) for c in dims.values()}
    else:
        wanted = {dims[d]: keep(complete(cells, dims[d], _goal(spark, d, t)), "targets") for d, t in targets.items()}
    if cells.count() <= DRIVER_CELLS:
        own = cells.toPandas()
        if len(own):
            shares = {c: {r["value"]: r["share"] for r in t.collect()} for c, t in wanted.items()}
            own["w"] = rake_local(own, shares)
            own["p"] = bound_local(own, shares, share)
        else:
            own["w"] = own["p"] = []
        weights = spark.createDataFrame([tuple(r) for r in own.astype(object).itertuples(index=False)], "__s string, __l string, __t int, tokens long, w double, p double")
    else:
        weights = bound(rake(cells, wanted), wanted, share)
    if missed := unmet(weights, wanted).orderBy(F.desc(F.abs(F.col("got") - F.col("share")))).limit(20).collect():
        names = {c: d for d, c in dims.items()}
        warnings.warn("targets not met (the first 20 at most): " + ", ".join(f"{names[r['dim']]} {r['value']!r} {r['got']:.4f} of {r['share']:.4f}" for r in missed), stacklevel=2)
    p = weights.select("__s", "__l", "__t", F.col("p").alias("__p"))
    u = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    out = marked.join(p, list(dims.values()), "left").withColumn("__p", F.when(F.col("__tokens") > 0, F.coalesce("__p", F.lit(0.0))).otherwise(0.0))
    return out.withColumn("__take", u < F.col("__p"))


def mixed(docs: DataFrame, share: float = 0.5, targets: dict[str, dict] | None = None, seed: int = 7) -> DataFrame:
    """The drawn rows of docs, with weight: how many documents each stands for (1 / probability); it replaces a column of that name."""
    # columns with the names that are used inside are set aside
    aside = {}
    for c in docs.columns:
        if c.lower() in ("__tokens", "__s", "__l", "__t", "__p", "__take"):
            aside[c] = fresh(docs, f"kept{c}")
    out = calibrated(docs.withColumnsRenamed(aside), share, targets, seed).where("__take")
    return out.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns if c != "weight"], (1 / F.col("__p")).alias("weight"))


def op9_raking(spark, sf_dir: str) -> DataFrame:
    out = calibrated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.col("__t").alias("topic"), F.col("__tokens").alias("tokens"), F.round("__p", 9).alias("probability"), F.col("__take").alias("taken"))
