"""Votes of nearest labelled texts against a second computation and on held-out rows."""

import random
import zlib

import numpy as np
import pytest

from sparkloom.llm import quality
from sparkloom.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus():
    """Good texts of words; bad ones that repeat a word, or put marks behind every word."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(600):
        say = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        bad = i % 5 == 0
        text = " ".join([words[i % 3]] * len(say) if i % 10 == 0 else [f"{w}##" for w in say]) if bad else " ".join(say)
        rows.append((i, text, "en", "s", len(text)))
        if i % 3:
            labels.append((i, int(not bad), 0))
    return rows + [(1000, None, None, None, None), (1001, "", "en", "s", 0), (1002, "x", "en", "s", 1), (1003, "word ## " * 250_000, "en", "s", 2_000_000)], labels


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(corpus[0], DOCS).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(corpus[1] + [(5000, 1, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_query(spark, corpus, folder):
    rows, labels = corpus
    got = {r.doc_id: r for r in QUERIES["op12_quality_votes"](spark, folder).collect()}
    assert set(got) == {r[0] for r in rows}
    true = {i: y for i, y, _ in labels}
    for i, *_ in rows:
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [i for i in true if got[i].held_out]
    assert len(held) > 60 and np.mean([got[i].predicted == true[i] for i in held]) > 0.95
    learned = [y for i, y in true.items() if not got[i].held_out]
    # a text without features gets the overall share (the label without a document learns nothing)
    assert got[1000].score == got[1001].score == pytest.approx(np.mean(learned), abs=1e-9)


def test_scores_against_definition(spark, corpus, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    voters = quality.learn(docs, labels)
    texts = [t.encode() for _, t, *_ in corpus[0][:80]] + [b"", b"\xff\xfe\x00", b"a"]
    df = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)], "doc_id long, text binary")
    got = {r.doc_id: r.score for r in quality.quality(df, voters).collect()}
    want = quality.brute_force(texts, voters)
    near = sum(abs(got[i] - w) < 1e-3 for i, w in enumerate(want))
    assert near >= len(want) - 1  # a cosine at the edge of rounding may tie or not


def test_directions_are_those_of_the_features(spark, corpus, folder):
    """Subspace iteration holds as much of the features as the exact directions, but for a hundredth."""
    docs = spark.createDataFrame([(i, bytearray(t.encode())) for i, t, *_ in corpus[0][:300]], "doc_id long, text binary")
    rarity = quality.rarity_of(docs)
    turn = quality._directions(docs, rarity)
    x = np.stack([np.log(quality.trigrams(np.frombuffer(t.encode(), np.uint8)) + 1.0) * rarity for _, t, *_ in corpus[0][:300]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    best = np.linalg.svd(x, compute_uv=False)[: quality.DIM]
    assert ((x @ turn) ** 2).sum() > 0.99 * (best**2).sum()
    assert np.allclose(turn.T @ turn, np.eye(quality.DIM), atol=1e-3)


def test_classes_are_weighed_by_their_shares(spark, corpus, folder, monkeypatch):
    monkeypatch.setattr(quality, "VOTERS", 60)
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    voters = quality.learn(docs, labels)
    assert len(voters.labels) <= 60
    assert voters.share == pytest.approx(np.mean([y for _, y, _ in corpus[1]]), abs=0.02)


def test_nothing(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    voters = quality.learn(empty, labels)
    assert quality.quality(empty, voters).collect() == []
    df = spark.createDataFrame([(1, "a b", 9), (1, "a b", 9), (None, None, 9)], "doc_id long, text string, score int")
    assert [r.score for r in quality.quality(df, voters).collect()] == [0.5, 0.5, 0.5]


def test_few_matrices_reach_the_driver(spark, monkeypatch):
    rows = spark.createDataFrame([(f"some text {i}",) for i in range(80)], "text string").select(quality.F.col("text").cast("binary").alias("text"))
    got, read = [], np.frombuffer
    monkeypatch.setattr(quality.np, "frombuffer", lambda x, *a: got.append(len(x)) or read(x, *a))
    monkeypatch.setattr(quality, "ROUNDS", 1)
    quality._directions(rows.repartition(40), np.ones(1 << quality.BITS, np.float32))
    assert 0 < sum(n == 8 * (quality.DIM + quality.EXTRA) << quality.BITS for n in got) <= quality.TASKS


def test_matrices_are_added_up_by_tasks(spark, monkeypatch):
    """One matrix reaches the driver in a round, not one of each task, and it is the sum of all."""
    texts = [f"some text {i}".encode() for i in range(80)]
    rows = spark.createDataFrame([(bytearray(t),) for t in texts], "text binary").repartition(40)
    sent, kind = [], type(rows)

    def counted(name, size):
        def run(self, f=getattr(kind, name)):
            sent.append(size(got := f(self)))
            return got

        monkeypatch.setattr(kind, name, run)

    counted("toArrow", lambda t: t.nbytes)
    counted("collect", lambda rows: sum(len(r.z) for r in rows))
    monkeypatch.setattr(quality, "ROUNDS", 2)
    turn = quality._directions(rows, np.ones(1 << quality.BITS, np.float32))
    assert len(sent) == 2 and max(sent) < 1.1 * (8 * (quality.DIM + quality.EXTRA) << quality.BITS)
    x = np.log(np.stack([quality.trigrams(np.frombuffer(t, np.uint8)) for t in texts]) + 1.0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    best = np.linalg.svd(x, compute_uv=False)[: quality.DIM]
    assert ((x @ turn) ** 2).sum() > 0.98 * (best**2).sum()
