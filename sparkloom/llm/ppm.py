"""LM scoring: prediction by partial matching over bytes, with escapes and symbol exclusion.

The model is a trie of byte contexts up to ORDER bytes, trained on the learning
rows. A symbol seen in the longest known context is coded there with c / (T + d)
(T: the context's count, d: its distinct symbols; escape method C). Otherwise the
escape d / (T + d) is coded and the next shorter context follows, without the
symbols that were excluded by being seen in the longer one. Every context's
symbols are seen in its suffix too, so the excluded mass is one number a context
and all of it is looked up in bulk. Last comes a uniform choice of what is left
of 256 bytes and the end. Texts start with ORDER start symbols.

Counts come from all learning rows, and every counted context is used. Contexts
of two symbols or more lie in parts by a hash of their last two, so a part holds
all contexts a string can fall back to but those of one symbol and of none, which
the alphabet bounds (258**2) and which are broadcast. Texts are put into chunks
of about CHUNK bytes; a chunk asks each part once for each of its distinct
strings and sums the answers along its texts.

The unigram base score needs the count of every token. The HEAVY commonest
tokens are looked up in the scoring pass; all others are joined.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .stage import keep

U = np.uint64
ORDER = 5
#: Bytes of text (a longer one is alone) whose distinct strings are looked up together, and tokens whose counts are broadcast.
CHUNK = 1 << 23
HEAVY = 1 << 18
START, END = 256, 257
_BITS = 9
_HELD = 1_500_000
#: Strings and counts that scoring tasks hold before they merge them.
_ASKED = 300_000


def symbols(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed strings of ORDER symbols and the coded one, for every byte and every row's end; their rows' ranges."""
    rows = len(ends) - 1
    at = ends + np.arange(rows + 1) * (ORDER + 1)
    s = np.full(at[-1], START, U)
    row = np.repeat(np.arange(rows), np.diff(ends))
    s[np.arange(len(data)) + row * (ORDER + 1) + ORDER] = K.LOWER[data]
    s[at[1:] - 1] = END
    packed = s.copy()
    for j in range(1, ORDER + 1):
        packed[j:] |= s[:-j] << U(_BITS * j)
    coded = np.ones(len(s), bool)
    for j in range(ORDER):
        coded[at[:-1] + j] = False
    return packed[coded], ends + np.arange(rows + 1)


_ZSTD = pa.Codec("zstd", compression_level=1)


def squeeze(x: np.ndarray) -> bytes:
    return len(x).to_bytes(8, "little") + (_ZSTD.compress(K.planes(x), asbytes=True) if len(x) else b"")


def unsqueeze(data: bytes, kind: str) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return K.values(_ZSTD.decompress(data[8:], n * np.dtype(kind).itemsize, asbytes=True), kind) if n else np.zeros(0, kind)


# ---- counting ------------------------------------------------------------------------------------


class _Sum:
    """Counts by key, merged as they come."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, x, n=None):
        self.parts.append(K.tally(x, n))
        self.size += len(self.parts[-1][0])
        if self.size > _HELD and len(self.parts) > 1:
            self.merge()

    def merge(self):
        if len(self.parts) > 1:
            keys, counts = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            self.parts = []
            self.parts = [K.tally(keys, counts)]
            self.size = len(self.parts[0][0])
            del keys, counts
            K.release()

    def take(self, kind: int, bits: int):
        """A row for each part: its keys in order as differences, and their counts, both squeezed: Spark sorts and sends a sixth of the bytes."""
        self.merge()
        for k, c in self.parts:
            order, cut = split(k >> U(_BITS) & _TWO if kind == GRAMS else k, bits)
            k, c = k[order], c[order]
            used = np.flatnonzero(np.diff(cut)).tolist()
            keys = [squeeze(np.diff(k[cut[p] : cut[p + 1]], prepend=U(0))) for p in used]
            counts = [squeeze(c[cut[p] : cut[p + 1]].astype(np.int64)) for p in used]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), kind, np.int32)), pa.array(np.array(used, np.int32)), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], names=["kind", "part", "keys", "counts"])
        self.parts, self.size = [], 0


#: Parts are 2**7 at least and so many that one has the strings of about PART_BYTES bytes of text, up to 2**16 (there are 258**2 pairs).
PART_BITS, PART_BYTES = (7, 16), 1 << 25
TOKENS, GRAMS, DOCS, PAIRS = range(4)
_TWO = U((1 << (2 * _BITS)) - 1)


def split(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of x by part, in order within each, and where each part begins (and the last ends)."""
    part = (K.mix(x) >> U(64 - bits)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange((1 << bits) + 1))


@K.releasing
def _unpack(batches):
    """A row for each key of packed counts."""
    for batch in batches:
        for kind, keys, counts in zip(*(batch.column(c) for c in ("kind", "keys", "counts")), strict=True):
            k, n = np.cumsum(unsqueeze(keys.as_py(), "u8"), dtype=U), unsqueeze(counts.as_py(), "i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind.as_py(), np.int32)), pa.array(k.view(np.int64)), pa.array(n)], names=["kind", "key", "n"])


def _count(bits: int):
    def run(batches):
        tokens, grams, pairs, docs = _Sum(), _Sum(), _Sum(), 0
        for batch in batches:
            docs += batch.num_rows
            data, ends = K.buffers(batch.column("text"))
            for a, b in K.slices(ends, 1 << 19):
                own, cut = data[ends[a] : ends[b]], ends[a : b + 1] - ends[a]
                tokens.add(K.words(own, cut)[2])
                packed = symbols(own, cut)[0]
                grams.add(packed)
                pairs.add(packed & _TWO)
                if pairs.size > _HELD:
                    pairs.merge()
            for kind, x in ((TOKENS, tokens), (GRAMS, grams)):
                if x.size > _HELD:
                    yield from x.take(kind, bits if kind == GRAMS else 0)
        yield from tokens.take(TOKENS, 0)
        yield from grams.take(GRAMS, bits)
        yield from pairs.take(PAIRS, 0)
        ends_ = _Sum()
        ends_.parts = [(np.zeros(1, U), np.array([docs]))]
        yield from ends_.take(DOCS, 0)

    return K.releasing(run)


# ---- the model -----------------------------------------------------------------------------------


class Model:
    """The trie as one hash table of symbols and one of contexts for each order."""

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]]):
        """grams[k]: packed strings of k + 1 symbols whose contexts the model knows, sorted, and their counts."""
        self.count, self.total, self.kinds, self.excluded, self.symbol, self.context = [], [], [], [], [], []
        for k, (key, n) in enumerate(grams):
            ctx = key >> U(_BITS)
            at = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(ctx) else np.zeros(0, np.int64)
            self.symbol.append(K.Lookup(key))
            self.context.append(K.Lookup(ctx[at]))
            self.count.append(n.astype(np.float64))
            self.total.append(np.add.reduceat(n, at).astype(np.float64) if len(at) else np.zeros(0))
            self.kinds.append(np.diff(np.append(at, len(ctx))).astype(np.float64))
            if k:
                short = self.symbol[k - 1].find(key & U((1 << (_BITS * k)) - 1))
                mass = np.where(short >= 0, np.append(self.count[k - 1], 0)[short], 0)
                self.excluded.append(np.add.reduceat(mass, at) if len(at) else np.zeros(0))
            else:
                self.excluded.append(np.zeros(len(at)))
        top = len(grams) - 1
        where = self.context[top].find(grams[top][0] >> U(_BITS))
        self.direct = np.append(np.log10(self.count[top] / (self.total[top] + self.kinds[top])[where]), 0) if len(where) else np.zeros(1)

    def log10(self, packed: np.ndarray) -> np.ndarray:
        """log10 probability of each packed string's last symbol after the others."""
        top = len(self.count) - 1
        hit = self.symbol[top].find(packed)
        out = self.direct[hit]
        left = np.flatnonzero(hit < 0)
        out[left] = 0
        mass, kinds = np.zeros(len(left)), np.zeros(len(left))
        for k in range(top, -1, -1):
            own = packed[left] & U((1 << (_BITS * (k + 1))) - 1)
            ctx = self.context[k].find(own >> U(_BITS))
            known = ctx >= 0
            total, d = (np.where(known, np.append(x[k], 0)[ctx], 0) for x in (self.total, self.kinds))
            total, d = np.where(known, total - mass, 0), np.where(known, d - kinds, 0)
            here = self.symbol[k].find(own) if k < top else np.full(len(left), -1)
            coded = (here >= 0) & known
            count = np.append(self.count[k], 0)[here]
            escape = known & ~coded & (d > 0)
            out[left[coded]] += np.log10(count[coded] / (total + d)[coded])
            out[left[escape]] += np.log10(d[escape] / (total + d)[escape])
            mass, kinds = np.where(known, np.append(self.excluded[k], 0)[ctx], 0), np.where(known, np.append(self.kinds[k], 0)[ctx], 0)
            left, mass, kinds = left[~coded], mass[~coded], kinds[~coded]
        if len(left):
            out[left] += np.log10(1 / (257 - kinds_of_root(self)))
        return out


def kinds_of_root(model: Model) -> float:
    return min(256.0, float(model.kinds[0][0])) if len(model.kinds[0]) else 0.0


def part_model(key: np.ndarray, n: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> Model:
    """The model of one part: its packed strings, sorted, with their counts, and all strings of two symbols with theirs."""
    grams = [K.tally(pairs[0] & U((1 << _BITS) - 1), pairs[1]), pairs]
    return Model([*grams, *[K.tally(key & U((1 << (_BITS * (k + 1))) - 1), n) for k in range(2, ORDER)], (key, n)])


# ---- scoring -------------------------------------------------------------------------------------

SCORED = "rid long, doc_id long, held_out boolean, kind int, h long, n long, n_tokens long, known long, base double, score double"
CHUNKS = "chunk long, rid array<long>, doc_id array<long>, held_out array<boolean>, ends binary, text binary"
def texts_of(ends: bytes, text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's bytes and row offsets."""
    return unsqueeze(text, "u1"), unsqueeze(ends, "i8")


@K.releasing
def _pack(batches):
    """Rows of CHUNKS; a chunk is named by its first row."""
    for batch in batches:
        data, ends = K.buffers(batch.column("text"))
        cuts = list(K.slices(ends, CHUNK))
        first = np.array([a for a, _ in cuts], np.int32)
        offsets = pa.array(np.append(first, batch.num_rows).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, batch.column(c)) for c in ("rid", "doc_id", "held_out")]
        packed = [pa.array([squeeze(x) for x in own], pa.binary()) for own in ((ends[a : b + 1] - ends[a] for a, b in cuts), (data[ends[a] : ends[b]] for a, b in cuts))]
        yield pa.RecordBatch.from_arrays([batch.column("rid").take(pa.array(first)), *lists, *packed], names=[x.split()[0] for x in CHUNKS.split(", ")])


def strings(data: np.ndarray, ends: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's distinct packed strings by part, in order within each, and where each part begins."""
    parts, held = [], 0
    for a, b in K.slices(ends, 1 << 18):
        parts.append(K.distinct(symbols(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a])[0]))
        held += len(parts[-1])
        if held > 2 * len(parts[0]) + _ASKED:
            parts, held = [K.distinct(np.concatenate(parts))], 0
    k = K.distinct(np.concatenate(parts)) if parts else np.zeros(0, U)
    order, cut = split(k >> U(_BITS) & _TWO, bits)
    return k[order], cut


def _ask(bits: int):
    def run(batches):
        """A row for each chunk and part: the chunk's strings there, as differences."""
        for batch in batches:
            for i in range(batch.num_rows):
                k, cut = strings(*texts_of(batch.column("ends")[i].as_py(), batch.column("text")[i].as_py()), bits)
                used = np.flatnonzero(np.diff(cut)).tolist()
                keys = [squeeze(np.diff(k[cut[p] : cut[p + 1]], prepend=U(0))) for p in used]
                yield pa.RecordBatch.from_arrays([pa.array(np.array(used, np.int32)), pa.array([batch.column("chunk")[i].as_py()] * len(used), pa.int64()), pa.array(keys, pa.binary())], names=["part", "chunk", "keys"])

    return K.releasing(run)


def _answer(shared):
    """log10 of the strings asked for; of each part the counts come first, then what is asked."""

    def run(batches):
        now, held, model = None, None, None
        for batch in batches:
            for part, chunk, keys, counts in zip(*(batch.column(c) for c in ("part", "chunk", "keys", "counts")), strict=True):
                if part != now:
                    now, held, model = part, _Sum(), None
                if counts.is_valid:
                    held.add(np.cumsum(unsqueeze(keys.as_py(), "u8"), dtype=U), unsqueeze(counts.as_py(), "i8"))
                    if held.size > 2 * len(held.parts[0][0]) + _ASKED:
                        held.merge()
                    continue
                if model is None:
                    held.merge()
                    model = part_model(*(held.parts or [(np.zeros(0, U), np.zeros(0, np.int64))])[0], shared.value)
                # few distinct values: their bits in order as differences, and which one each string has
                kinds, which = np.unique(model.log10(np.cumsum(unsqueeze(keys.as_py(), "u8"), dtype=U)).view(U), return_inverse=True)
                kinds = np.diff(kinds, prepend=U(0))
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()], pa.int32()), pa.array([chunk.as_py()], pa.int64()), pa.array([squeeze(kinds)], pa.binary()), pa.array([squeeze(which.astype(np.uint32))], pa.binary())], names=["part", "chunk", "kinds", "which"])

    return K.releasing(run)


def _score(shared, bits: int):
    names = [x.split()[0] for x in SCORED.split(", ")]

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        keys, counts, log_z, end = shared.value
        table, logs = K.Lookup(keys), np.append(np.log10(counts + 1.0), 0.0)
        rids, doc_ids, held = (chunk.column(c).chunk(0)[0].values for c in ("rid", "doc_id", "held_out"))
        data, ends = texts_of(chunk.column("ends")[0].as_py(), chunk.column("text")[0].as_py())
        found = K.Lookup(strings(data, ends, bits)[0])
        by_part = np.argsort(answers.column("part").to_numpy())
        value = np.concatenate([np.cumsum(unsqueeze(answers.column("kinds")[int(i)].as_py(), "u8"), dtype=U)[unsqueeze(answers.column("which")[int(i)].as_py(), "u4")] for i in by_part]).view(float)
        out = []
        for a, b in K.slices(ends, 1 << 18):
            own, cut = data[ends[a] : ends[b]], ends[a : b + 1] - ends[a]
            rows = b - a
            rid = rids.slice(a, rows)
            packed, at = symbols(own, cut)
            score = np.add.reduceat(value[found.find(packed)], at[:-1])
            h, at = K.words(own, cut)[2:]
            size = np.diff(at)
            row = np.repeat(np.arange(rows), size)
            hit = table.find(h)
            known = np.bincount(row[hit >= 0], minlength=rows)
            base = np.bincount(row, logs[hit], rows) - size * log_z + math.log10(end + 1) - log_z
            none = pa.nulls(rows, pa.int64())
            out.append(pa.RecordBatch.from_arrays([rid, doc_ids.slice(a, rows), held.slice(a, rows), pa.array(np.ones(rows, np.int32)), rid, none, pa.array(size + 1), pa.array(known + int(end > 0)), pa.array(base), pa.array(score)], names=names))
            rare = np.flatnonzero(hit < 0)
            if len(rare):
                order = rare[np.lexsort((h[rare], row[rare]))]
                new = np.flatnonzero(np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])]))
                m, ints = len(new), pa.nulls(len(new), pa.int64())
                out.append(
                    pa.RecordBatch.from_arrays(
                        [rid.take(pa.array(row[order[new]])), ints, pa.nulls(m, pa.bool_()), pa.array(np.zeros(m, np.int32)), pa.array(h[order[new]].view(np.int64)), pa.array(np.diff(np.append(new, len(order)))), ints, ints, pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64())],
                        names=names,
                    )
                )
        return pa.Table.from_batches(out)

    return run


def score_documents(docs: DataFrame, held_out: str = "crc32(cast(doc_id as string)) % 7 = 2") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs(doc_id, text, ...).

    Learns from the rows where held_out (SQL over doc_id) is false; a null
    doc_id makes it null: such rows are scored and not learned from. Null texts
    are empty: their one token is the end. Repeated rows are each scored. With
    nothing to learn from, bytes are uniform and the base score is 0 a token.
    Texts are lower-cased (A-Z) for both scores. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", F.expr(held_out))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(np.clip((size // PART_BYTES).bit_length(), *PART_BITS))
    raw = keep(docs.where("not held_out").select("text").mapInArrow(_count(bits), "kind int, part int, keys binary, counts binary"), "partial")
    counts = raw.where(F.col("kind") != GRAMS).mapInArrow(_unpack, "kind int, key long, n long")
    counts = keep(counts.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    tokens = counts.where(F.col("kind") == TOKENS).select("key", "n")
    sums = tokens.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    end = counts.where(F.col("kind") == DOCS).agg(F.sum("n").alias("n")).first()["n"] or 0
    total, kinds = (sums["n"] or 0) + end, sums["v"] + int(end > 0)

    def on_driver(df):
        got = df.toArrow()
        return got.column("key").to_numpy().view(U), got.column("n").to_numpy()

    pairs = spark.sparkContext.broadcast(on_driver(counts.where(F.col("kind") == PAIRS).select("key", "n").orderBy("key")))
    chunks = keep(docs.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(_pack, CHUNKS), "chunks")
    asked = chunks.select("chunk", "ends", "text").mapInArrow(_ask(bits), "part int, chunk long, keys binary").withColumn("counts", F.lit(None).cast("binary"))
    parts = raw.where(F.col("kind") == GRAMS).select("part", F.lit(None).cast("long").alias("chunk"), "keys", "counts").unionByName(asked)
    answers = parts.repartition("part").sortWithinPartitions("part", F.col("counts").isNull()).mapInArrow(_answer(pairs), "part int, chunk long, kinds binary, which binary")
    shared = spark.sparkContext.broadcast((*on_driver(tokens.orderBy(F.desc("n"), "key").limit(HEAVY)), math.log10(total + kinds + 1), end))
    rows = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score(shared, bits), SCORED)
    rest = tokens.select(F.col("key").alias("h"), F.lit(0).alias("kind"), F.col("n").alias("c"))
    more = F.sum(F.col("n") * F.log10(F.col("c") + 1))
    out = rows.join(rest, ["kind", "h"], "left").groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), (F.max("known") + F.coalesce(F.sum(F.when(F.col("c") > 0, F.col("n"))), F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.max("base") + F.coalesce(more, F.lit(0.0))).alias("base_score"), F.max("score").alias("score"),
    )
    return out.drop("rid")


def op4_ppm_score(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
