"""Benchmark decontamination by spaced-seed hashing.

Each mask looks at some of a run of tokens and ignores the others, so a
substitution at an ignored place leaves the hash as it was. The test items'
hashes are looked up at every place of every training text. A hit fixes how item
and text lie against each other; along that diagonal all tokens are compared,
and a window of tokens with enough equal ones is evidence. The masks are chosen
by enumeration: whatever tokens of a window differ, as long as it is evidence,
some mask lies inside it on equal tokens only, so no evidence is missed.

Tokens are lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII bytes:
punctuation and white space do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .stage import fresh

U = np.uint64
#: 1: the token counts, 0: it is ignored.
MASKS = ("111011", "11001011", "11111", "101111", "11110001", "10100111", "11010101")
#: A window of so many tokens (all of a shorter item) with at least so many percent equal is evidence. Items of fewer tokens than LEAST
#: are evidence only where all their tokens stand in a row; items of fewer than SHORTEST are none.
WINDOW, PERCENT, LEAST, SHORTEST = 12, 75, 8, 3
#: Test items are broadcast in blocks of about so many characters.
BLOCK_CHARS = 16_000_000
#: Hits that are looked at together, and numbers of a step along whole diagonals.
_HITS, _CELLS = 1 << 15, 1 << 21
#: Hits of an item in a text, over the text's tokens, from which all diagonals are compared in place of single hits.
_DENSE = 4

#: In place of a shift: all diagonals.
NONE = np.iinfo(np.int64).min

_BREAK = np.ones(256, bool)
_BREAK[48:58] = _BREAK[65:91] = _BREAK[97:123] = _BREAK[128:] = False
_SHAPES = [np.flatnonzero([c == "1" for c in m]) for m in MASKS]


def runs(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of so many tokens."""
    out = np.full(max(len(h) - size + 1, 0), U(size << 8))
    for j in range(size):
        out += h[j : j + len(out)] * K._COEFFICIENTS[j]
    return K.mix(out)


def seeds(h: np.ndarray, mask: int) -> np.ndarray:
    """The mask's hash at every place of a run of token hashes."""
    n = len(h) - len(MASKS[mask]) + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.full(n, U(mask + 1))
    for j, k in enumerate(_SHAPES[mask]):
        out += h[k : k + n] * K._COEFFICIENTS[j]
    return K.mix(out)


class Items:
    """Seeds of test items."""

    def __init__(self, ids: np.ndarray, texts: pa.Array):
        data, ends = K.buffers(texts)
        _, _, h, rows = K.words(data, ends, _BREAK)
        size = np.diff(rows)
        self.short = {}
        for n in range(SHORTEST, LEAST):
            on = np.flatnonzero(size == n)
            if len(on):
                key = np.concatenate([runs(h[rows[i] : rows[i + 1]], n) for i in on])
                order = np.argsort(key, kind="stable")
                key, own = key[order], ids[on[order]]
                start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                self.short[n] = (K.Lookup(key[start]), start, np.append(start[1:], len(key)), own)
        on = np.flatnonzero(size >= LEAST)
        self.ids, self.tokens = ids[on], [h[rows[i] : rows[i + 1]] for i in on]
        keys, item, place = [], [], []
        for i, t in enumerate(self.tokens):
            for m in range(len(MASKS)):
                s = seeds(t, m)
                keys.append(s), item.append(np.full(len(s), i)), place.append(np.arange(len(s)))
        k, i, p = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, item, place))
        order = np.argsort(k, kind="stable")
        self.item, self.place, k = i[order], p[order], k[order].astype(U)
        self.start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        self.table = K.Lookup(k[self.start])
        self.stop = np.append(self.start[1:], len(k))

        self.length = np.array([len(t) for t in self.tokens], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.flat = np.concatenate([*self.tokens, np.zeros(1, U)])

    def candidates(self, h: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Distinct (row, item, shift) of hits with evidence around them; h: tokens of texts, rows: each text's range.

        Where an item has more hits in a text than _DENSE times the text's tokens (both repeat
        words), its row has the shift NONE: best() compares all its diagonals.
        """
        out, dense = [], self._dense(h, rows)
        if len(dense):
            out.append(np.stack([dense[:, 0], dense[:, 1], np.full(len(dense), NONE)], axis=1))
        for m, mask in enumerate(MASKS):
            found = self.table.find(seeds(h, m))
            at = np.flatnonzero(found >= 0)
            row = np.searchsorted(rows, at, side="right") - 1
            on = at + len(mask) <= rows[row + 1]
            at, row, found = at[on], row[on], found[at[on]]
            size = self.stop[found] - self.start[found]
            ends = np.cumsum(size)
            for a in range(0, int(size.sum()), _HITS):
                n = np.arange(a, min(a + _HITS, ends[-1]))
                hit = np.searchsorted(ends, n, side="right")
                k = self.start[found[hit]] + n - (ends - size)[hit]
                own, place, where = row[hit], self.place[k], at[hit]
                if len(dense):
                    single = ~np.isin(own * len(self.length) + self.item[k], dense[:, 0] * len(self.length) + dense[:, 1])
                    k, own, place, where = k[single], own[single], place[single], where[single]
                good = self._evident(h, rows, own, self.item[k], place, where)
                out.append(np.stack([own, self.item[k], where - place - rows[own]], axis=1)[good])
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)

    def _dense(self, h: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """(row, item) with so many hits, from the numbers of each seed in text and item."""
        keys, counts = [], []
        for m, mask in enumerate(MASKS):
            found = self.table.find(seeds(h, m))
            at = np.flatnonzero(found >= 0)
            row = np.searchsorted(rows, at, side="right") - 1
            on = at + len(mask) <= rows[row + 1]
            pair, n = K.tally(row[on] * np.int64(len(self.start)) + found[at[on]])
            row, found = np.divmod(pair, max(1, len(self.start)))
            size = self.stop[found] - self.start[found]
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.start[found], size)
            keys.append(np.repeat(row, size) * len(self.length) + self.item[place]), counts.append(np.repeat(n, size))
        key, n = K.tally(np.concatenate(keys), np.concatenate(counts))
        row, item = np.divmod(key, max(1, len(self.length)))
        on = n > _DENSE * np.diff(rows)[row]
        return np.stack([row[on], item[on]], axis=1)

    def best(self, h: np.ndarray, item: int) -> tuple[int, int, int] | None:
        """overlap() of the diagonal with the most equal tokens (then the earliest), from all diagonals."""
        t, best = self.tokens[item], None
        n, width = len(t), min(WINDOW, len(t))
        padded = np.concatenate([np.zeros(n, U), h, np.zeros(n, U)])
        view = np.lib.stride_tricks.sliding_window_view(padded, n)
        place = np.arange(n)
        for lo in range(0, len(view), step := max(1, _CELLS // n)):
            own = view[lo : lo + step]
            at = place + np.arange(lo, lo + len(own))[:, None]
            inside = (at >= n) & (at < n + len(h))
            same, inside = (np.cumsum(np.pad(x, ((0, 0), (1, 0))), axis=1, dtype=np.int32) for x in (inside & (own == t), inside))
            good = (100 * (same[:, width:] - same[:, :-width]) >= PERCENT * width) & (inside[:, width:] - inside[:, :-width] == width)
            some = np.flatnonzero(good.any(axis=1))
            if not len(some):
                continue
            first, last = good[some].argmax(axis=1), n - good[some][:, ::-1].argmax(axis=1)
            equal = same[some, last] - same[some, first]
            shift = some + lo - n
            k = np.lexsort((-last - shift, first + shift, -equal))[0]
            got = (int(equal[k]), -int(first[k] + shift[k]), int(last[k] + shift[k] - 1))
            best = max(best or got, got)
        return best and (-best[1], best[2], best[0])

    def _evident(self, h, rows, row, item, place, where) -> np.ndarray:
        """Whether a window around each hit is evidence."""
        step = np.arange(1 - WINDOW, WINDOW)
        j, t = place[:, None] + step, where[:, None] + step
        inside = (j >= 0) & (j < self.length[item][:, None]) & (t >= rows[row][:, None]) & (t < rows[row + 1][:, None])
        same = inside & (self.flat[np.where(inside, j + self.first[item][:, None], -1)] == h[np.where(inside, t, 0)])
        same, inside = (np.cumsum(np.pad(x, ((0, 0), (1, 0))), axis=1, dtype=np.int16) for x in (same, inside))
        good, width = np.zeros(len(item), bool), np.minimum(WINDOW, self.length[item])
        for w in np.unique(width).tolist():
            evident = (100 * (same[:, w:] - same[:, :-w]) >= PERCENT * w) & (inside[:, w:] - inside[:, :-w] == w)
            good |= (width == w) & evident.any(axis=1)
        return good

    def exact(self, h: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(row, item id, place, tokens) where a short item first stands in a text."""
        out = []
        for n, (table, start, stop, ids) in self.short.items():
            found = table.find(runs(h, n))
            at = np.flatnonzero(found >= 0)
            row = np.searchsorted(rows, at, side="right") - 1
            on = at + n <= rows[row + 1]
            at, row, found = at[on], row[on], found[at[on]]
            _, first = np.unique(row * np.int64(len(start)) + found, return_index=True)
            out += [(int(row[k]), int(i), int(at[k] - rows[row[k]]), n) for k in first for i in ids[start[found[k]] : stop[found[k]]]]
        return out

    def overlap(self, h: np.ndarray, item: int, shift: int) -> tuple[int, int, int] | None:
        """First and last token in the text of the evidence along a diagonal, and its equal tokens."""
        t = self.tokens[item]
        a, b = max(0, -shift), min(len(t), len(h) - shift)
        width = min(WINDOW, len(t))
        if b - a < width:
            return None
        same = np.concatenate([[0], np.cumsum(t[a:b] == h[a + shift : b + shift])])
        good = np.flatnonzero(100 * (same[width:] - same[:-width]) >= PERCENT * width)
        if not len(good):
            return None
        lo, hi = int(good[0]), int(good[-1]) + width
        return lo + a + shift, hi + a + shift - 1, int(same[hi] - same[lo])


FOUND = "doc_id long, item_id long, first_word long, last_word long, equal_words long"


def _scan(shared):
    def run(batches):
        items = shared.value
        for batch in batches:
            data, ends = K.buffers(batch.column("text"))
            ids = batch.column("doc_id")
            out = []
            for a, b in K.slices(ends):
                _, _, h, rows = K.words(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a], _BREAK)
                best = {}
                for i, item, shift in items.candidates(h, rows).tolist():
                    own = h[rows[i] : rows[i + 1]]
                    if got := items.best(own, item) if shift == NONE else items.overlap(own, item, shift):
                        best[i, item] = max(best.get((i, item), (0, 0, 0)), (got[2], -got[0], got[1]))
                out += [(ids[a + i].as_py(), int(items.ids[k]), -v[1], v[2], v[0]) for (i, k), v in best.items()]
                out += [(ids[a + i].as_py(), item, at, at + n - 1, n) for i, item, at, n in items.exact(h, rows)]
            yield pa.RecordBatch.from_pydict({n: [r[j] for r in out] for j, n in enumerate(x.split()[0] for x in FOUND.split(", "))}, schema=pa.schema([(x.split()[0], pa.int64()) for x in FOUND.split(", ")]))

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word, last_word, equal_words: the best evidence of each item in each row of docs(doc_id, text, ...).

    benchmark(item_id, text, ...): items of fewer than SHORTEST tokens, null texts and
    null ids are no evidence; items of fewer than LEAST only as a whole and unchanged.
    Null and empty texts have none, empty tables give no rows. Rows that repeat are
    each reported, rows with a null doc_id too. Any number of items is handled,
    in broadcast blocks of bounded size; one scan of docs a block.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tests = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    chars = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS)
    found = None
    for k in range(blocks):
        part = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).distinct().orderBy("item_id", "text").toArrow()
        items = spark.sparkContext.broadcast(Items(part.column("item_id").to_numpy(), part.column("text")))
        got = docs.mapInArrow(_scan(items), FOUND)
        found = got if found is None else found.unionByName(got)
    return found if found is not None else spark.createDataFrame([], FOUND)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no evidence of an item; rows that share a doc_id go together, rows without one stay."""
    own = fresh(docs, "__gone")
    gone = contaminated(docs, benchmark).select(F.col("doc_id").alias(own)).where(F.col(own).isNotNull()).distinct()
    return docs.join(gone, docs["doc_id"] == gone[own], "left_anti")


def op8_spaced_seeds(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
