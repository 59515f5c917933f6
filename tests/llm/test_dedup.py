"""Near duplicates, line and suffix dedup against brute force."""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from sparkloom.llm import jaccard_join, line_dedup, suffix_dedup
from sparkloom.llm import textkit as K


def test_words_do_not_depend_on_pieces(monkeypatch):
    import pyarrow as pa

    data, ends = K.buffers(pa.array(["The quick  brown\tFOX", None, "", "a" * 500 + " b", "the"]))
    want = K.words(data, ends)
    for size in (3, 64):
        monkeypatch.setattr(K, "_PIECE", size)
        for a, b in zip(K.words(data, ends), want, strict=True):
            assert (a == b).all()
    assert want[2][0] == want[2][-1]


def test_lookup():
    keys = K.distinct(np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64))
    t = K.Lookup(keys)
    assert (t.find(keys) == np.arange(len(keys))).all() and (t.find(keys + np.uint64(1)) < 0).all()


@pytest.mark.parametrize("block", [256, 2])
def test_near_duplicates(docs, rows, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", block)
    monkeypatch.setattr(jaccard_join, "PART_DOCS", block)
    got = jaccard_join.near_duplicate_groups(docs).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = jaccard_join.brute_force([r[:2] for r in rows]).sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want, check_dtype=False)
    assert (got.doc_id != got.component_id).sum() > 5


def test_near_duplicates_odd_rows(spark, empty):
    assert jaccard_join.near_duplicate_groups(empty).count() == 0
    text = "a b c d e f g"
    df = spark.createDataFrame([(None, text), (2, text), (2, text), (1, text), (5, None)], "doc_id long, text string")
    got = sorted(map(tuple, jaccard_join.near_duplicate_groups(df).collect()), key=str)
    assert got == sorted([(None, 3, None), (2, 3, 1), (2, 3, 1), (1, 3, 1), (5, 0, 5)], key=str)
    assert sorted(r.doc_id or 0 for r in jaccard_join.first_of_groups(df).collect()) == [0, 1, 5]


def test_trie_is_exact():
    rng = np.random.default_rng(3)
    base = np.sort(rng.choice(400, 60, replace=False))
    sets = [np.sort(rng.choice(400, 50, replace=False)) for _ in range(10)]
    for _ in range(40):
        s = base.copy()
        s[rng.integers(0, 60, rng.integers(0, 14))] = rng.integers(0, 400, 1)
        sets.append(np.unique(s))
    trie = jaccard_join.Trie(sets, [len(s) for s in sets], 400)
    for i, a in enumerate(sets):
        want = {j for j, b in enumerate(sets) if j != i and 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b))}
        assert set(trie.probe(i, 75)) == want


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffixes(docs, rows, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    from pyspark.sql import functions as F

    out = suffix_dedup.remove_repeats(docs)
    got = out.select("doc_id", "n_bytes", F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"]).alias("gone"), F.size("spans").alias("n"), F.sha2("kept", 256).alias("sha")).collect()
    assert sorted(map(tuple, got)) == sorted(suffix_dedup.brute_force([r[:2] for r in rows]))
    assert sum(r.gone for r in got) > 1000


@pytest.mark.parametrize("parts", [256, 4096])
def test_suffixes_of_few_letters(spark, monkeypatch, parts):
    """Texts of two letters cut from two strings with changed bytes: long runs, many equal leads, windows on both sides of an anchor."""
    monkeypatch.setattr(suffix_dedup, "PARTS", parts)
    rng = np.random.default_rng(5)
    base = ["".join(rng.choice(["a", "b"], 400)), "ab" * 150 + "a" * 200]
    texts = []
    for _ in range(60):
        x = list(base[int(rng.integers(2))])
        for i in rng.integers(0, len(x), rng.integers(0, 6)):
            x[i] = "c"
        a = int(rng.integers(0, 200))
        texts.append("".join(x[a : a + int(rng.integers(40, 260))]))
    texts += ["x" * int(rng.integers(0, 9)) + "he. Is on" * int(rng.integers(5, 60)) + "y" * int(rng.integers(0, 60)) for _ in range(20)]
    rows = list(enumerate(texts))
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_bytes", "spans", "kept").collect()
    got = [(r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got]
    assert sorted(got) == sorted(suffix_dedup.brute_force(rows))


def test_suffixes_odd_rows(spark, empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0
    text = "é" * 30
    df = spark.createDataFrame([(None, text), (2, text), (2, text), (1, text), (5, None), (6, "short")], "doc_id long, text string")
    got = sorted(((r.doc_id, len(r.kept)) for r in suffix_dedup.remove_repeats(df).collect()), key=str)
    assert got == sorted([(None, 60), (2, 0), (2, 0), (1, 60), (5, 0), (6, 5)], key=str)


def test_stretches():
    text = np.frombuffer(b"start " + b"he. Is on" * 40 + b" mid " + b"he. Is on" * 30 + b" end", np.uint8)
    place = np.array([6 + 9 * i for i in range(40)] + [371 + 9 * i for i in range(30)])
    padded = np.concatenate([np.zeros(26, np.uint8), text, np.zeros(50, np.uint8)])
    block = np.lib.stride_tricks.sliding_window_view(padded, 76)[place]
    same = np.full(len(place), 4)
    one, step, count = suffix_dedup._stretches(np.zeros(len(place), int), place, same, same, block)
    assert len(one) < 25 and count.max() > 20
    assert np.concatenate([place[a] + s * np.arange(n) for a, s, n in zip(one, step, count)]).tolist() == place.tolist()
    assert all((block[a : a + n] == block[a]).all() for a, n in zip(one, count))


def test_multikey_quicksort():
    x = np.random.default_rng(0).integers(0, 4, (5000, 3)).astype(np.uint64)
    got = x[suffix_dedup.multikey_quicksort(x, small=16)]
    assert (got == x[np.lexsort(x.T[::-1])]).all()


def test_lines(docs, rows):
    got = {(r.doc_id, r.line) for r in line_dedup.repeated_lines(docs).collect()}
    want = line_dedup.brute_force([r[:2] for r in rows])
    assert got == want and len(want) > 10
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    for d, text, *_ in rows:
        if text is None:
            assert out[d].text is None
        else:
            assert out[d].text == "\n".join(x for k, x in enumerate(text.split("\n")) if (d, k) not in want)


def test_lines_odd_rows(spark, empty):
    assert line_dedup.dedup_lines(empty).count() == 0
    df = spark.createDataFrame([(None, "a b"), (2, "a b\n\nc"), (1, "B A"), (3, None), (4, "")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in line_dedup.dedup_lines(df).collect()), key=str)
    assert got == sorted([(None, "a b"), (2, "\nc"), (1, "B A"), (3, None), (4, "")], key=str)


@pytest.mark.parametrize(("pivots", "step"), [(8, 32), (1, 2), (0, 2)])
def test_lines_of_near_copies(spark, monkeypatch, pivots, step):
    """Groups of lines at all distances from one another, so that some need every round."""
    import random

    monkeypatch.setattr(line_dedup, "PIVOTS", pivots)
    monkeypatch.setattr(line_dedup, "STEP", step)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    base = [rng.sample(words, k) for k in (4, 12, 20)]
    texts = []
    for i in range(240):
        own = list(rng.choice(base))
        for _ in range(rng.randrange(1 + len(own) // 3)):
            own[rng.randrange(len(own))] = rng.choice(words)
        texts.append((i // 3 * 7 % 83 + 100 * (i % 3), " ".join(own)))
    rows = [(d, "\n".join(t for e, t in texts if e == d)) for d in dict.fromkeys(d for d, _ in texts)]
    got = {(r.doc_id, r.line) for r in line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == line_dedup.brute_force(rows) and 20 < len(got) < 240


def test_copies_are_settled_in_slices_and_ranges():
    texts = ["a b\nb A\nx", "x\n\na b", "y z\nz y z"]
    batch = pa.RecordBatch.from_pydict({"doc_id": [7, 3, 3], "text": texts})
    rows = [r for b in line_dedup._first_pass([batch]) for r in b.to_pylist() if r["print"] is not None]
    # of each set only a slice's earliest line is left to settle; rows that share an id and a number are one line
    assert sorted((r["doc_id"], r["line"]) for r in rows if r["copy"]) == [(3, 1), (7, 0), (7, 1), (7, 2)]
    rest = pa.Table.from_pylist([{"part": 0} | r for r in rows])
    assert sorted(map(tuple, (r.values() for r in line_dedup._settle(rest).to_pylist()))) == [(3, 1), (7, 0), (7, 1), (7, 2)]
    assert line_dedup._settle(rest.slice(0, 0)).num_rows == 0


@pytest.mark.parametrize("far", [1, 1 << 40])
def test_order_of_tokens_and_lines(far):
    rng = np.random.default_rng(2)
    token, doc, line = rng.integers(0, 1 << 32, 3000) >> 28 << 28, (rng.integers(0, 50, 3000) - 20) * far, rng.integers(0, 9, 3000)
    token, line = token.astype("u4"), line.astype("i4")
    order, want = line_dedup._in_order(token, doc, line), np.lexsort((line, doc, token))
    for x in (token, doc, line):
        assert (x[order] == x[want]).all()
    empty = np.zeros(0, np.int64)
    assert not len(line_dedup._in_order(empty.astype("u4"), empty, empty.astype("i4")))


def test_near_sets_are_told_from_the_tokens_after_the_shared_one():
    """With enough of these in both sets, sizes and places fit: what one comparison now decides."""
    for percent in (60, 75, 100):
        for a, b, p, q in ((a, b, p, q) for a in range(1, 14) for b in range(1, 14) for p in range(a) for q in range(b)):
            need = -(-percent * (a + b) // (100 + percent))
            long = p + q <= a + b - 2 * need and min(a - p, b - q) >= need and 100 * min(a, b) >= percent * max(a, b)
            assert long == (min(a - p, b - q) >= need)


def test_further_rounds_read_only_the_lines_that_take_part(spark, monkeypatch):
    kept, keep = {}, line_dedup.keep

    def watched(df, name="t"):
        kept.setdefault(name, []).append(keep(df, name))
        return kept[name][-1]

    monkeypatch.setattr(line_dedup, "keep", watched)
    monkeypatch.setattr(line_dedup, "PIVOTS", 0)
    monkeypatch.setattr(line_dedup, "STEP", 2)
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    base = [rng.choice(words, k, replace=False) for k in (4, 12, 20)]

    def near():
        own = base[rng.integers(3)].copy()
        for _ in range(rng.integers(1 + len(own) // 3)):
            own[rng.integers(len(own))] = rng.choice(words)
        return " ".join(own)

    rows = [(d, "\n".join(near() for _ in range(3)) + f"\nalone {d}x {d % 7}y") for d in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {(r.doc_id, r.line) for r in line_dedup.repeated_lines(df).collect()}
    assert got == line_dedup.brute_force(rows)
    assert kept["part"]
    first = {(r.doc_id, r.line): bytes(r.text).decode() for r in kept["part"][0].collect()}
    texts = dict(rows)
    assert first and all(texts[d].split("\n")[k] == t for (d, k), t in first.items())
    assert not any(k == 3 for _, k in first)
