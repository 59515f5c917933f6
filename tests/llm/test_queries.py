"""The registered queries on a small folder of tables against brute force."""

import hashlib
import random
import re
import zlib

import pytest

from sparkloom.llm import jaccard_join, line_dedup, suffix_dedup
from sparkloom.llm.decontaminate import LEAST, PERCENT, WINDOW
from sparkloom.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items(rows), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def items(rows):
    """Passages of documents with every so many words another, and some of no document."""
    rng, out = random.Random(4), []
    texts = [t.split() for _, t, *_ in rows if t and len(t.split()) > 40]
    for k in range(40):
        ws = list(rng.choice(texts))
        at = rng.randrange(len(ws) - 30)
        ws = ws[at : at + rng.randrange(5, 30)]
        for i in range(rng.randrange(5), len(ws), rng.choice([3, 4, 5, 9])):
            ws[i] = f"other{k}"
        out.append((k, " ".join(ws)))
    return [*out, (100, None), (101, ""), (102, "of no document is this passage of ten words ever")]


def tokens(text):
    return re.findall(r"[0-9a-z\x80-\xff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().decode("latin-1"))


def test_op8(spark, rows, folder):
    want = set()
    for i, item in items(rows):
        a = tokens(item)
        if len(a) < LEAST:
            continue
        width = min(WINDOW, len(a))
        for d, text, *_ in rows:
            b = tokens(text)
            for shift in range(width - len(a), len(b) - width + 1):
                lo, hi = max(0, -shift), min(len(a), len(b) - shift)
                same = [a[j] == b[j + shift] for j in range(lo, hi)]
                if any(100 * sum(same[k : k + width]) >= PERCENT * width for k in range(len(same) - width + 1)):
                    want.add((d, i))
                    break
    got = QUERIES["op8_spaced_seeds"](spark, folder).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 10 and len(got) == len(want)


def test_op6(spark, rows, folder):
    gone = line_dedup.brute_force([r[:2] for r in rows])
    got = {r.doc_id: r for r in QUERIES["op6_line_dedup"](spark, folder).collect()}
    assert set(got) == {r[0] for r in rows}
    for d, text, *_ in rows:
        if text is not None:
            lines = text.split("\n")
            kept = "\n".join(x for k, x in enumerate(lines) if (d, k) not in gone)
            assert (got[d].n_lines, got[d].n_removed, got[d].kept_sha256) == (len(lines), sum((d, k) in gone for k in range(len(lines))), hashlib.sha256(kept.encode()).hexdigest())


def test_op7(spark, rows, folder):
    want = jaccard_join.brute_force([r[:2] for r in rows])
    got = QUERIES["op7_ngram_jaccard"](spark, folder).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(want[["doc_id", "n_shingles", "component_id"]].itertuples(index=False, name=None))


def test_op10(spark, rows, folder):
    got = QUERIES["op10_suffix_dedup"](spark, folder).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(suffix_dedup.brute_force([r[:2] for r in rows]))


def test_op1(spark, rows, folder):
    got = {r.doc_id: r for r in QUERIES["op1_langid"](spark, folder).collect()}
    assert set(got) == {r[0] for r in rows}
    learned = {lang for d, _, lang, *_ in rows if lang and zlib.crc32(str(d).encode()) % 5}
    for d, text, *_ in rows:
        r = got[d]
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert r.lang_pred in learned if any(c.isalpha() for c in text or "") else r.lang_pred == "und"
