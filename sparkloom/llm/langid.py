"""Language identification in two steps: family, then one-versus-one linear SVMs within it.

Features are hashed byte trigrams and bigrams of the lower-cased text with all
that is no letter as a space, as shares of the text's positions, so a decision
value is the mean of looked-up weights and a text is one pass of lookups. All
languages are learned. The SVMs are trained by dual coordinate descent on whole
texts, chosen by a hash of doc_id: PER_LANG documents or so of each language, or
fewer where languages are so many that it would be over SAMPLE in all, but LEAST.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .stage import fresh

#: Language codes of each family. Any other code is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la", "ast"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz", "ky", "tt"],
    "indic": ["hi", "ur", "bn", "mr", "ne", "gu", "pa"],
    "semitic": ["ar", "he", "mt", "am"],
    "malayic": ["id", "ms"],
}
PER_LANG, SAMPLE, LEAST = 1000, 60_000, 20
BITS = 15
_SCALE = 40.0

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_TEXT = np.where(_LETTER[K.LOWER], K.LOWER, 32).astype(np.uint8)


def family(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes), lang)


def features(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two weight positions for each place (2**BITS: none), each row's first place, and how many places count."""
    rows = len(ends) - 1
    at = ends + 2 * np.arange(rows + 1)
    s = np.full(at[-1] + 2, 32, np.uint32)
    s[np.arange(len(data)) + 2 * np.repeat(np.arange(rows), np.diff(ends)) + 1] = _TEXT[data]
    two = s[:-1] | (s[1:] << np.uint32(8))
    three = two[:-1] | (s[2:] << np.uint32(16))
    counts = s[1:-1] != 32
    h = lambda x, salt: ((x + np.uint32(salt)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    none = np.uint32(1 << BITS)
    n = at[-1]
    place = np.stack([np.where(counts, h(three, 0), none), np.where(counts, h(two[:-1], 1 << 25), none)], axis=1)[:n]
    return place, at[:-1], np.add.reduceat(counts[:n].astype(np.int64), at[:-1]) if rows else np.zeros(0, np.int64)


def _sparse(batches):
    for batch in batches:
        data, ends = K.buffers(batch.column("text"))
        place, at, count = features(data, ends)
        idx, val = [], []
        for i in range(batch.num_rows):
            stop = at[i + 1] if i + 1 < len(at) else len(place)
            k, n = np.unique(place[at[i] : stop].ravel(), return_counts=True)
            on = k < 1 << BITS
            idx.append(k[on].astype(np.int32)), val.append((n[on] / max(1, count[i]) * _SCALE).astype(np.float32))
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32()))], names=["lang", "idx", "val"])


def svm(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, c: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Weights (the last is the bias) of a linear SVM with hinge loss; classes weigh the same."""
    w, a = np.zeros((1 << BITS) + 1), np.zeros(len(x))
    most = c * len(y) / (2 * np.where(y > 0, max(1, (y > 0).sum()), max(1, (y < 0).sum())))
    norm = np.array([float(v @ v) + 1 for _, v in x])
    rng = np.random.default_rng(0)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(x)):
            k, v = x[i]
            new = min(max(a[i] - (y[i] * (w[k] @ v + w[-1]) - 1) / norm[i], 0.0), most[i])
            if step := (new - a[i]) * y[i]:
                w[k] += step * v
                w[-1] += step
                moved, a[i] = max(moved, abs(step)), new
        if moved < 1e-3:
            break
    return w


class Classifier:
    """Family SVMs (one against the others) and, within each family, one SVM for every two languages."""

    def __init__(self, rows: list[tuple[str, np.ndarray, np.ndarray]]):
        rows = sorted(rows, key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))
        self.langs = sorted({r[0] for r in rows})
        self.families = sorted({family(x) for x in self.langs})
        of = np.array([self.families.index(family(r[0])) for r in rows], np.int64)
        lang = np.array([self.langs.index(r[0]) for r in rows], np.int64)
        x = [(k, v) for _, k, v in rows]
        columns = []
        if len(self.families) > 1:
            columns = [svm(x, np.where(of == f, 1.0, -1.0)) for f in range(len(self.families))]
        self.pairs = []
        self.members = [[i for i, c in enumerate(self.langs) if family(c) == f] for f in self.families]
        for own in self.members:
            for a, b in combinations(own, 2):
                on = np.flatnonzero((lang == a) | (lang == b))
                self.pairs.append((a, b))
                columns.append(svm([x[i] for i in on], np.where(lang[on] == a, 1.0, -1.0)))
        w = np.array(columns).T if columns else np.zeros(((1 << BITS) + 1, 0))
        self.bias = w[-1]
        self.weights = np.vstack([w[:-1] * _SCALE, np.zeros((1, w.shape[1]))]).astype(np.float32)

    def predict(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position in langs and score of each row."""
        rows = len(ends) - 1
        place, at, count = features(data, ends)
        value = np.zeros((rows, self.weights.shape[1]))
        for j in range(self.weights.shape[1]):
            w = self.weights[:, j]
            value[:, j] = np.add.reduceat(w[place[:, 0]].astype(np.float64) + w[place[:, 1]], at) / np.maximum(count, 1) + self.bias[j]
        sure = lambda m: 1 / (1 + np.exp(-3 * np.clip(m, -50, 50)))
        best, score = np.zeros(rows, np.int64), np.ones(rows)
        fam = np.zeros(rows, np.int64)
        shift = 0
        if len(self.families) > 1:
            shift = len(self.families)
            own = value[:, :shift]
            fam = own.argmax(axis=1)
            others = own.copy()
            others[np.arange(rows), fam] = -np.inf
            score = sure((own.max(axis=1) - others.max(axis=1)) / 2)
        for f, members in enumerate(self.members):
            on = np.flatnonzero(fam == f)
            votes, margin = np.zeros((len(on), len(members))), np.zeros((len(on), len(members)))
            for j, (a, b) in enumerate(self.pairs):
                if a in members:
                    m, p, q = value[on, shift + j], members.index(a), members.index(b)
                    votes[:, p] += m >= 0
                    votes[:, q] += m < 0
                    margin[:, p] += m
                    margin[:, q] -= m
            win = np.lexsort((np.arange(len(members))[None, ::-1].repeat(len(on), 0), margin, votes), axis=1)[:, -1] if len(members) > 1 else np.zeros(len(on), np.int64)
            best[on] = np.array(members)[win] if len(on) else 0
            if len(members) > 1:
                score[on] *= sure(margin[np.arange(len(on)), win] / (len(members) - 1))
        return best, score


def _named(model: Classifier, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each text; `und` and 0 where it is null or has no letter or nothing was learned."""
    data, ends = K.buffers(column)
    lang, score = np.full(len(column), "und", object), np.zeros(len(column))
    for a, b in K.slices(ends, 1 << 19):
        own, cut = data[ends[a] : ends[b]], ends[a : b + 1] - ends[a]
        low = K.LOWER[own]
        ascii_ = np.add.reduceat(np.append((low >= 97) & (low <= 122), False).astype(np.int64), cut[:-1]) * (np.diff(cut) > 0)
        letter = ascii_ > 0
        for i in np.flatnonzero(~letter & (np.diff(cut) > 0)):
            letter[i] = any(map(str.isalpha, own[cut[i] : cut[i + 1]].tobytes().decode("utf-8", "replace").replace("�", "")))
        if model.langs:
            best, s = model.predict(own, cut)
            lang[a:b] = np.where(letter, np.array(model.langs, object)[best], "und")
            score[a:b] = np.where(letter, s, 0.0)
    return lang, score


def _label(shared):
    def run(batches):
        for batch in batches:
            lang, score = _named(shared.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def train(docs: DataFrame) -> Classifier:
    """A classifier of all languages of docs(doc_id, text, lang), from a sample of rows of each by hash of doc_id."""
    count = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    if not count:
        return Classifier([])
    per = max(LEAST, min(PER_LANG, SAMPLE // len(count)))
    share = docs.sparkSession.createDataFrame([(lang, per / n) for lang, n in count.items()], "lang string, __share double")
    # rows without a doc_id are drawn by their texts
    draw = F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text")), F.lit(1)), F.lit(1 << 30))
    drawn = docs.join(F.broadcast(share), "lang").where(draw < F.col("__share") * (1 << 30))
    got = drawn.select("lang", "text").mapInArrow(_sparse, "lang string, idx array<int>, val array<float>").limit(2 * per * len(count)).toArrow().combine_chunks()
    if not got.num_rows:
        return Classifier([])
    # views of the Arrow buffers: the sample's features stay as compact as they came
    lists = [got.column(c).combine_chunks() if isinstance(got.column(c), pa.ChunkedArray) else got.column(c) for c in ("idx", "val")]
    at = lists[0].offsets.to_numpy()
    idx, val = (x.values.to_numpy() for x in lists)
    return Classifier([(lang, idx[a:b], val[a:b]) for lang, a, b in zip(got.column("lang").to_pylist(), at[:-1], at[1:], strict=True)])


def identify(docs: DataFrame, held_out: str = "crc32(cast(doc_id as string)) % 5 = 0") -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs(doc_id, text, lang, ...).

    Learns from text and non-null lang of rows where held_out (SQL over doc_id) is
    false. lang_pred is a learned language, `und` (score 0) if the text is null or
    has no letter or nothing could be learned. A null doc_id makes held_out null:
    such rows are labelled and not learned from. Repeated rows are each labelled;
    the number of copies changes the sample only. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).withColumn("held_out", F.expr(held_out))
    model = train(docs.where("not held_out and lang is not null and text is not null").select("doc_id", "text", "lang"))
    shared = spark.sparkContext.broadcast(model)
    return docs.select("doc_id", "text", "held_out").mapInArrow(_label(shared), "doc_id long, held_out boolean, lang_pred string, score double")


def known_language(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """The rows of docs whose language is known, with lang_pred and score (or, where docs has such columns, with `_` after the names).

    It is known if lang_pred is not `und` and the score at least `least`. Learns from all rows with a text and a non-null lang,
    held out ones and such without a doc_id included. A row is judged by its own text, so of rows that share a doc_id, or have
    none, those without a known language go and the others stay.
    """
    spark = docs.sparkSession
    model = train(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null"))
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang: string, score: double>")
    def named(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            lang, score = _named(shared.value, column)
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score)], names=["lang", "score"])
            # the stages after this one share the workers' memory
            K.release()

    # only texts go to the workers; nondeterministic, or they would go there once for the filter and once for the columns
    found, lang, score = fresh(docs, "__found"), fresh(docs, "lang_pred"), fresh(docs, "score")
    known = docs.withColumn(found, named.asNondeterministic()(F.col("text").cast("string"))).where((F.col(found)["lang"] != "und") & (F.col(found)["score"] >= least))
    return known.select(*docs.columns, F.col(found)["lang"].alias(lang), F.col(found)["score"].alias(score))


def op1_langid(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
