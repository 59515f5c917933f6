"""Quality of texts by votes of the nearest labelled texts in a latent space.

A text's features are its byte trigrams in 2**BITS bins, weighed by the logarithm of
their number and by how rare they are in all documents (latent semantic analysis of
trigrams: it sees words, repetition, capitals and strange marks, in any language).
The latent space is that of the largest singular directions of the labelled texts,
found by subspace iteration: each round is one job that adds up what every task's
texts make of the current directions, in bands of bins that are added up by Spark.

The labelled texts' unit vectors are broadcast. Every document's vector is multiplied
with all of them, in blocks, which gives exact cosines; the NEIGHBOURS nearest (and
all that tie with the last of them, cosines rounded to five places) vote with the
POWER-th power of their cosine. A vote for the overall share, as strong as a cosine
of 0.42, is added, so a text without features, or unlike all others, gets that share.

What is learned is bounded: at most VOTERS // 2 labelled texts of each class, taken by a
hash of doc_id, with weights that restore the shares of the classes. The rarity of
trigrams is counted over all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .stage import keep, rows_of

#: Bins (as a power of two), directions, extra ones while they are sought, rounds.
BITS, DIM, EXTRA, ROUNDS = 13, 64, 16, 5
#: Labelled texts that vote, at most; nearest ones that do so; the power of a cosine in a vote; the score from which a text is good.
VOTERS, NEIGHBOURS, POWER, GOOD = 16_384, 30, 8, 0.7
#: Strength of the vote for the overall share.
PRIOR = 1e-3
#: Rows of a block of features, rows and voters of a block of products, bytes that are counted at once.
ROWS, BLOCK, VOTER_BLOCK, PIECE = 64, 256, 4_096, 1 << 20
#: Tasks that learn, each of which makes one matrix of 2**BITS x (DIM + EXTRA); bands of its rows, whose sums alone reach the driver.
TASKS, BANDS = 8, 32


def trigrams(text: np.ndarray) -> np.ndarray:
    """How often each bin is met in a text's bytes with a space before and after; an empty text has none."""
    total = np.zeros(1 << BITS, np.int64)
    if not len(text):
        return total
    b = np.full(len(text) + 2, 32, np.uint8)
    b[1:-1] = text
    for at in range(0, len(text), PIECE):
        x = b[at : at + PIECE + 2].astype(np.uint32)
        total += np.bincount(((x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS), minlength=1 << BITS)
    return total


def _texts(column):
    """The bytes of each row; null is empty."""
    data, ends = K.buffers(column)
    for i in range(len(ends) - 1):
        yield data[ends[i] : ends[i + 1]]


def _features(column, rarity: np.ndarray):
    """Unit feature vectors, ROWS at a time (zero where a text is empty)."""
    texts = list(_texts(column))
    for at in range(0, len(texts), ROWS):
        x = np.stack([trigrams(t) for t in texts[at : at + ROWS]]).astype(np.float32)
        x = np.log(x + 1) * rarity
        size = np.sqrt((x * x).sum(axis=1, keepdims=True))
        yield at, x / np.where(size > 0, size, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(size > 1e-6, size, np.inf)


def rarity_of(docs: DataFrame) -> np.ndarray:
    """The weight of each bin: 1 + log of (documents + 1) / (documents that have it + 1)."""

    def run(batches):
        n, held = 0, np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for text in _texts(batch.column("text")):
                held += trigrams(text) > 0
            n += batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, 1 << BITS)), pa.array(np.concatenate([[n], held]))], names=["bin", "n"])

    got = docs.select("text").mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros((1 << BITS) + 1)
    n[got.column("bin").to_numpy() + 1] = got.column("n").to_numpy()
    return (1 + np.log((n[0] + 1) / (n[1:] + 1))).astype(np.float32)


def _directions(sample: DataFrame, rarity: np.ndarray, seed: int = 0) -> np.ndarray:
    """The DIM largest right singular directions of the sample's features."""
    context = sample.sparkSession.sparkContext
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.normal(size=(1 << BITS, DIM + EXTRA)))[0]
    for _ in range(ROUNDS):
        shared = context.broadcast((rarity, q.astype(np.float32)))

        def run(batches, shared=shared):
            weight, turn = shared.value
            total = np.zeros(turn.shape)
            for batch in batches:
                for _, x in _features(batch.column("text"), weight):
                    total += x.T @ (x @ turn)
            task = TaskContext.get().partitionId()
            for band, part in enumerate(np.split(total, BANDS)):
                yield pa.RecordBatch.from_arrays([pa.array([band]), pa.array([task]), pa.array([part.tobytes()], pa.binary())], names=["band", "task", "z"])

        def added(group):
            # in the order of the tasks, whatever the shuffle's
            parts = [group.column("z")[i].as_buffer() for i in np.argsort(group.column("task").to_numpy())]
            z = sum(np.frombuffer(x) for x in parts)
            return pa.table({"band": group.column("band")[:1], "z": pa.array([z.tobytes()], pa.binary())})

        # the files of the sample may be many more than TASKS
        parts = sample.select("text").coalesce(TASKS).mapInArrow(run, "band long, task long, z binary")
        got = parts.groupBy("band").applyInArrow(added, "band long, z binary").toArrow().sort_by("band")
        z = np.frombuffer(b"".join(got.column("z").to_pylist())).reshape(q.shape) if len(got) else np.zeros(q.shape)
        shared.unpersist()
        q, r = np.linalg.qr(z)
    # z is the features' square times the last directions: its left singular vectors are those of the features
    u, _, _ = np.linalg.svd(r)
    return (q @ u)[:, :DIM].astype(np.float32)


class Voters:
    """What is learned: rarity of bins, directions, the voters' unit vectors, labels and weights, and the overall share of label 1."""

    def __init__(self, rarity, turn, vectors, labels, weights):
        self.rarity, self.turn, self.vectors, self.labels, self.weights = rarity, turn, vectors, labels, weights
        self.share = float((labels * weights).sum() / weights.sum()) if len(labels) else 0.5

    def latent(self, column) -> np.ndarray:
        return np.concatenate([np.zeros((0, DIM), np.float32), *(_unit(x @ self.turn) for _, x in _features(column, self.rarity))])

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The share of votes for label 1 for unit (or zero) vectors."""
        out = np.full(len(x), self.share)
        for at in range(0, len(x) if len(self.labels) else 0, BLOCK):
            own = x[at : at + BLOCK]
            near = np.empty((len(own), len(self.labels)), np.float32)
            for v in range(0, len(self.labels), VOTER_BLOCK):
                near[:, v : v + VOTER_BLOCK] = own @ self.vectors[v : v + VOTER_BLOCK].T
            near = np.rint(near * np.float32(1e5))
            k = min(NEIGHBOURS, near.shape[1])
            last = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
            i, j = np.nonzero((near >= last[:, None]) & (near > 0))
            vote = (near[i, j].astype(np.float64) / 1e5) ** POWER * self.weights[j]
            good, all_ = (np.bincount(i, w, len(own)) for w in (vote * self.labels[j], vote))
            out[at : at + BLOCK] = (good + PRIOR * self.share) / (all_ + PRIOR)
        return np.clip(out, 0, 1)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Voters:
    """Voters from the rows of docs(doc_id, text, ...) that labels(doc_id, label, ...) names; features are weighed over all docs.

    Labels other than 0 and 1 and rows without a doc_id are left out; where labels of a
    document differ, 0 holds. Of each class at most VOTERS // 2 labels are used, chosen by a
    hash of doc_id. Empty texts learn nothing, but count for the overall share.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.min("y").alias("y"))
    own = keep(own, "labels")
    sizes = {r.y: r.n for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    most = VOTERS // 2
    picked = [own.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    picked = keep(picked[0].unionByName(picked[1]), "picked")
    rarity = rarity_of(docs)
    sample = rows_of(docs, picked.select("doc_id")).join(F.broadcast(picked), "doc_id")
    sample = keep(sample.repartition(TASKS, "doc_id"), "sample")
    turn = _directions(sample, rarity) if sizes else np.zeros((1 << BITS, DIM), np.float32)
    shared = spark.sparkContext.broadcast(Voters(rarity, turn, None, np.zeros(0), np.zeros(0)))

    def run(batches):
        for batch in batches:
            x = shared.value.latent(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "y", "v"])

    got = sample.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, v binary").toArrow().combine_chunks()
    vectors = np.frombuffer(b"".join(got.column("v").to_pylist()), np.float32).reshape(-1, DIM)
    y = got.column("y").to_numpy().astype(np.float64)
    weights = np.array([max(1.0, sizes.get(c, 0) / most) for c in (0, 1)])[y.astype(int)] if len(y) else y
    # an order of their own, so that sums do not depend on how tasks end
    order = np.lexsort((*vectors.T[:2], y, got.column("doc_id").to_numpy()))
    shared.unpersist()
    return Voters(rarity, turn, vectors[order], y[order], weights[order])


def quality(docs: DataFrame, voters: Voters) -> DataFrame:
    """doc_id, score (0 to 1) for each row of docs(doc_id, text, ...), repeated ones included, from the text alone.

    Null and empty texts get the overall share of label 1 (0.5 where nothing was learned).
    Texts are bytes, so any are taken, whole. An empty table gives no rows; other columns
    are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.scores(shared.value.latent(batch.column("text"))))], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def op12_quality_votes(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    voters = learn(docs, labels.where(~held))
    scored = quality(docs, voters)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def brute_force(texts: list[bytes], voters: Voters) -> list[float]:
    """Scores of texts one by one, from the definition, for tests."""
    out = []
    for text in texts:
        b = b" " + text + b" " if text else b""
        x = np.zeros(1 << BITS)
        for i in range(len(b) - 2):
            x[(int.from_bytes(b[i : i + 3], "little") * 0x9E3779B1 % 2**32) >> (32 - BITS)] += 1
        x = np.log(x + 1) * voters.rarity
        x = x @ voters.turn / (np.linalg.norm(x) or 1)
        x = x / (np.linalg.norm(x) or 1)
        near = np.rint(voters.vectors @ x * 1e5)
        last = sorted(near)[-min(NEIGHBOURS, len(near))]
        vote = np.where((near >= last) & (near > 0), (near / 1e5) ** POWER * voters.weights, 0)
        out.append(float((vote @ voters.labels + PRIOR * voters.share) / (vote.sum() + PRIOR)))
    return out
