"""Token alignment against whole texts, pair by pair."""

import random

import pytest

from sparkloom.llm import align
from sparkloom.llm.queries import QUERIES

BITS = ["a", "b", " ", "  ", "\n", "\n\n", " \n", "\t", "é", "ñ", "中文", "日本語", "🙂", " ", "　", " ", "▁", "_", "123", "4567", "'s", "!!", "=====", "<|endoftext|>", "<s>", "\u0085", "\x1c", "The", "\r\n", "<0x0A>", "ﬁ", "é", "﻿", "\0", "word"]


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(BITS) for _ in range(rng.randint(0, 30)))) for i in range(700)]
    rows += [(9001, None), (9002, ""), (9003, " "), (9004, "   "), (9005, "\n"), (9006, "a "), (9007, "a  "), (None, "x y"), (None, "x y"), (9008, "=" * 3000 + "a"), (9009, "ab" * 5000), (9010, "x y"), (9010, "x y")]
    return rows


@pytest.mark.parametrize("cut", [True, False])
def test_odd_texts(spark, odd, cut):
    df = spark.createDataFrame(odd, "doc_id long, text string").selectExpr("*", "1 AS batch", "2 AS stripe", "3 AS doc", "4 AS salt").repartition(3)
    assert order(align.Alignment(df, cut=cut).documents().collect()) == order(align.brute_force(odd))


def test_many_slices(spark, odd, monkeypatch):
    """Several salts, bands and slices give what one gives."""
    for name, value in (("SALT", 1), ("SLICE_ROWS", 60), ("CACHE", 100)):
        monkeypatch.setattr(align, name, value)
    df = spark.createDataFrame(odd, "doc_id long, text string").repartition(5)
    found = align.Alignment(df)
    assert found.salts > 3
    assert order(found.documents().collect()) == order(align.brute_force(odd))


def test_query(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op11_token_align"](spark, str(tmp_path))
    assert order(got.collect()) == order(align.brute_force([r[:2] for r in rows]))


def test_best(spark):
    df = spark.createDataFrame([(1, "one two"), (2, "one three"), (3, "one")], "doc_id long, text string")
    got = {(r.a_id, r.b_id, r.n_docs) for r in align.Alignment(df).best().collect()}
    one = align.Aligner(*(open(p, "rb").read() for p in (align.A_PATH, align.B_PATH)))
    a, b, _ = one.encode([b" one"])
    assert (a[0][0], b[0][0], 3) in got and all(n in (1, 3) for *_, n in got)


def test_nothing_and_bad_bytes(spark, empty):
    assert align.Alignment(empty).documents().collect() == []
    df = spark.sql("SELECT 1L AS doc_id, cast(X'FF61' AS string) AS text UNION ALL SELECT 2L, 'a b'")
    got = {r.doc_id: r for r in align.Alignment(df).documents().collect()}
    assert got[1][1:] == (0, 0, 0, 0, 0, 0, "") and got[2].n_groups == 2
