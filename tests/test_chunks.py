"""Chunks of whole texts against a plain version."""

import pytest

from sparkloom.functions import text as X

TEXTS = [(1, "ab\ncdé\n\nfgh" * 7), (2, "日本語のテキスト。\n" * 9), (3, ""), (4, None), (5, "x"), (6, "�" * 20), (7, "😀é\n" * 30), (7, "😀é\n" * 30)]


def cut(data: bytes) -> str:
    return data.decode("utf-8", "ignore")


def windows(n, size, overlap):
    if n <= size:
        return [(0, n)] if n else []
    step = size - overlap
    return [(i * step, min(i * step + size, n)) for i in range(-(-(n - overlap) // step))]


@pytest.mark.parametrize(("size", "overlap"), [(10, 0), (13, 4), (1000, 20), (5, 4)])
def test_windows(spark, size, overlap):
    df = spark.createDataFrame(TEXTS, "k int, text string")
    got = sorted(tuple(r) for r in X.fixed_chunks(df, "k", "text", size, overlap).collect())
    want = sorted((k, i, a, b, cut(t.encode()[a:b])) for k, t in TEXTS if t for i, (a, b) in enumerate(windows(len(t.encode()), size, overlap)))
    assert got == want


@pytest.mark.parametrize("depth", [1, 3])
def test_tree(spark, depth):
    texts = [(k, t) for k, t in TEXTS if k in (1, 2, 3, 4, 5)] + [(8, "a line\n" * 60), (9, "é😀\n" * 60)]
    sizes = X.chunk_sizes(20, depth)
    want = {}

    def walk(k, data, d, path, parents, at):
        for i, (a, b) in enumerate(windows(len(data), sizes[d - 1], 5)):
            name = f"{path}.{i}" if path else str(i)
            piece = cut(data[a:b])
            leaf = d == depth or len(piece.encode()) <= sizes[d]
            whole = dict(texts)[k].encode()
            want[f"{k}:{name}"] = (parents[-1] if parents else None, parents, d, leaf, d == 1, at + a, at + b, 1 + whole[: at + a].count(b"\n"), 1 + whole[: at + b].count(b"\n"), piece)
            if not leaf:
                head = next((i for i, c in enumerate(data[a:b]) if c & 0xC0 != 0x80), 0)
                walk(k, piece.encode(), d + 1, name, [*parents, f"{k}:{name}"], at + a + head)

    for k, t in texts:
        if t:
            walk(k, t.encode(), 1, "", [], 0)
    df = spark.createDataFrame(texts, "k int, text string")
    tree = X.chunk_tree(df, "k", "text", 20, 5, depth)
    got = {r["id"]: (r.parent_id, r.parents, r.depth, r.leaf, r.root, r.start, r.stop, r.start_line, r.end_line, r.text) for r in tree.collect()}
    assert got == want
    assert {r.status for r in X.complete_parents(tree).collect()} == {"completed"}
    assert {r.status for r in tree.where("not leaf").collect()} <= {"pending"}
    assert X.chunk_options("json") == {"size": 800, "overlap": 100, "depth": 3} and X.chunk_options("text")["depth"] == 1
