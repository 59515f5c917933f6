"""Words made to collide, bytes that are no text, repeated words, clashing columns, stages on odd tables."""

import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from sparkloom.llm import decontaminate, html_text, jaccard_join, line_dedup, mixing, ppm, suffix_dedup, token_counts
from sparkloom.llm import textkit as K

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def swapped(text):
    return text.translate(str.maketrans("ab", "ba"))


@pytest.fixture(scope="module")
def pair():
    """A word of 1,024 letters and its complement, which every polynomial modulo 2**64 gives one hash."""
    word = "a"
    for _ in range(10):
        word += swapped(word)
    return word, swapped(word)


def hashes(*texts, space=K.SPACE):
    return K.words(*K.buffers(pa.array(texts)), space)[2].tolist()


def test_words_have_hashes_of_their_own(pair):
    rng = random.Random(8)
    some = {"".join(rng.choice("ab\0é") for _ in range(rng.randint(1, 40))) for _ in range(5000)} | {w[:n] for w in pair for n in (7, 8, 9, 15, 16, 17, 64, 255, 256, 257)} | set(pair)
    some |= {"x" * n for n in range(1, 600)} | {"x" * n + "\0" for n in range(1, 300)}
    assert len(set(hashes(*some))) == len(some)
    assert hashes(" ".join(some)) == hashes(*[w.upper() if w.isascii() else w for w in some])


def test_colliding_words_in_lines_documents_counts_and_leaks(spark, pair):
    one, other = pair
    texts = [f"{one} {one}x\nsame line of words", f"{one} {other}x", f"{other} {one}x\nsame line of words", f"{other} {other}x"]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, "en", "s", len(r[1])) for r in rows], DOCS)
    gone = {(r.doc_id, r.line) for r in line_dedup.repeated_lines(df).collect()}
    assert gone == line_dedup.brute_force(rows) == {(2, 1)}
    words = [(i, " ".join([w, *"bcdefghijk"])) for i, w in enumerate((one, other, one))]
    got = jaccard_join.near_duplicate_groups(spark.createDataFrame(words, "doc_id long, text string")).collect()
    want = jaccard_join.brute_force(words)
    assert {(r.doc_id, r.component_id) for r in got} == set(want[["doc_id", "component_id"]].itertuples(index=False, name=None))
    items = spark.createDataFrame([(1, f"{one} x y")], "item_id long, text string")
    leaks = spark.createDataFrame([(1, f"a {one} x y b"), (2, f"a {other} x y b")], "doc_id long, text string")
    assert {r.doc_id for r in decontaminate.contaminated(leaks, items).collect()} == {1}
    scored = {r.doc_id: r for r in ppm.score_documents(spark.createDataFrame([(1, one), (2, other)], "doc_id long, text string"), "doc_id = 2").collect()}
    assert (scored[1].n_known, scored[2].n_known) == (2, 1)


def test_bytes_that_are_no_text(spark):
    df = spark.sql("SELECT 1L AS doc_id, 1L AS page_id, cast(X'FF6120C3' AS string) AS text, cast(X'3C703E61FF' AS string) AS html UNION ALL SELECT 2L, 2L, 'a b', '<p>b'")
    assert {r.page_id: r.text for r in html_text.extract_pages(df).collect()} == {1: "a�", 2: "b"}
    count = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df).collect()}
    assert count == {1: token_counts.Counter(token_counts.pieces()).count("�a �")[1], 2: 2}
    body = bytes(range(128, 256)) * 2
    twice = spark.createDataFrame([(1, bytearray(body)), (2, bytearray(b"xy" + body))], "doc_id long, b binary").selectExpr("doc_id", "cast(b AS string) AS text")
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(twice).collect()}
    assert bytes(got[1].kept) == body and bytes(got[2].kept) == b"xy"


def test_repeated_words_against_an_item_of_them():
    """Cost does not grow with the product of both lengths times a hit's own cost."""
    items = decontaminate.Items(np.array([5]), pa.array([" ".join(["go"] * 200)]))
    text = " ".join(["go"] * 20_000)
    _, _, h, rows = K.words(*K.buffers(pa.array([text])), decontaminate._BREAK)
    t = time.process_time()
    found = items.candidates(h, rows)
    assert found.tolist() == [[0, 0, decontaminate.NONE]]
    assert items.best(h, 0) == (0, 199, 200)
    assert time.process_time() - t < 10


def test_all_diagonals_are_the_best_of_single_ones():
    rng = random.Random(4)
    for _ in range(60):
        item = [rng.choice("ab") for _ in range(rng.randint(8, 30))]
        text = [rng.choice("ab") for _ in range(rng.randint(5, 60))]
        items = decontaminate.Items(np.array([1]), pa.array([" ".join(item)]))
        h = K.words(*K.buffers(pa.array([" ".join(text)])), decontaminate._BREAK)[2]
        every = [got for s in range(-len(item), len(text)) if (got := items.overlap(h, 0, s))]
        want = max(every, key=lambda g: (g[2], -g[0], g[1]), default=None)
        assert items.best(h, 0) == want


def test_short_items_only_whole(spark):
    items = spark.createDataFrame([(1, "red green blue"), (2, "too short"), (3, "One, two. Three four!"), (4, "one two three four")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a red green blue b red green blue"), (2, "red green x blue"), (3, "too short"), (4, "one two three four five"), (5, "red green"), (None, "red green blue")], "doc_id long, text string")
    got = {tuple(r) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(1, 1, 1, 3, 3), (4, 3, 0, 3, 4), (4, 4, 0, 3, 4), (None, 1, 0, 2, 3)}


NAMES = ["__gone", "__removed", "__lines", "__id", "__tokens", "__s", "__l", "__t", "__p", "__take", "h", "n", "component_id", "score", "lang_pred"]


def odd(spark, tmp_path):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(200)]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage = say(40)
    rows = [(i, f"{say(30)}\n{passage if i % 9 == 0 else say(20)}", ["en", "de", None][i % 3], f"s{i % 2}", 5) for i in range(40)]
    rows += [(3, rows[3][1], "en", "s0", 5), (50, rows[4][1], "en", "s0", 5), (51, rows[4][1], "en", "s0", 5), (60, None, None, None, None), (61, "", "en", "s0", 0), (62, "  \n ", "en", "s0", 4), (63, "!!", "en", "s0", 2), (None, "no id here at all", "en", None, 5), (None, None, None, None, None), (70, say(6000), "de", "s1", 1)]
    spark.createDataFrame([(1, passage), (2, None), (3, "")], "item_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    return spark.createDataFrame(rows, DOCS).selectExpr("*", *[f"concat('{n}', doc_id) AS {n}" for n in NAMES]).repartition(3)


def test_stages_keep_odd_rows_and_columns(spark, tmp_path):
    docs = odd(spark, tmp_path)
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), stage(spark, docs, str(tmp_path)).schema)
        after = docs.collect()
        assert set(docs.columns) >= set(DOCS.replace(" long", "").replace(" string", "").split(", ")) | set(NAMES)
        for r in after:
            assert all(r[n] == (None if r.doc_id is None else f"{n}{r.doc_id}") for n in NAMES), name
        ids = [r.doc_id for r in after]
        if name == "language_id":
            assert {60, 61, 62, 63}.isdisjoint(ids) and ids.count(3) == 2 and None in ids
        elif name == "near_duplicates":
            assert {50, 51}.isdisjoint(ids) and 4 in ids
        assert len(after) <= len(before)


def test_stages_on_an_empty_table(spark, empty, tmp_path):
    odd(spark, tmp_path)
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.collect() == []
