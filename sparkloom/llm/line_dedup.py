"""Line dedup: an exact set-similarity join over the lines' word sets.

A line's tokens are its distinct words (lower-cased), ordered by rarity. Two
lines match when 100 * |A & B| >= percent * |A | B|; a line goes if it matches an
earlier line, judged on the input (earlier: smaller doc_id, then line number).
A word is known by 64 bits of hash, a set by 128.

1.  A pass counts words in hash counters for the order, and prints all sets.
    Lines with equal sets are settled by their prints: within a slice at once,
    the rest by ranges of prints, which get one line of a set from each slice.
2.  A second pass makes each line's prefix (its rarest n - ceil(t * n) + 1
    tokens) and sends it as compact columns by token ranges, whose number grows
    with the words counted; of equal sets a task sends the first line only.
3.  In a range, lines that share a prefix token meet. Two sets' first common
    token has p and q tokens before it, all of which differ; 128 parities of the
    tokens after it (by hash class: a parity that differs is a token that differs)
    bound the rest. A line needs one earlier match, not all: it is held against the
    first PIVOTS lines of its token, and where none of these is likely to match,
    against all earlier ones; it leaves a range with its likeliest partner only.
    So a group of near copies makes as many rows as it has lines.
4.  Pairs are verified on the words themselves. Lines without a match whose ranges
    hold more partners go another round, with STEP times as many each, until none
    is held back. Two bit filters of fixed size pick what takes part in it; its
    lines are written out once, and what follows reads these only.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .stage import bit_filter, fresh, holds, keep

U = np.uint64
COUNTER_BITS = 22
#: Token ranges are 2**8 at least and so many that one has about PART_WORDS words of the input.
PART_BITS, PART_WORDS = (8, 20), 4_000_000
PIVOTS, STEP = 8, 1024
_HELD = 600_000
_LINE_SLICE = 1 << 20
#: The level of a count of 1.
_ONCE = 8


def lines(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, number within the row and first byte of each line (a row of n line feeds has n + 1)."""
    feed = np.flatnonzero(data == 10)
    row = np.searchsorted(ends, feed, side="right") - 1
    # by row, then by place: a slice is far under 2**40 bytes and 2**23 rows
    both = np.sort(np.concatenate([np.arange(len(ends) - 1), row]) << 40 | np.concatenate([ends[:-1], feed + 1]))
    row, at = both >> 40, both & ((1 << 40) - 1)
    return row, np.arange(len(row)) - np.searchsorted(row, row), at


def _lines_of(at: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The line of each word: rows without bytes put several lines at one place, of which the last has the words."""
    return np.repeat(np.arange(len(at)), np.diff(np.append(np.searchsorted(s, at), len(s))))


def _sets(line: np.ndarray, h: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each line's distinct words in the order of (level, hash): line, hash, level."""
    packed = (line.astype(U) << U(44)) | (level.astype(U) << U(36)) | (h >> U(28))
    order = np.argsort(packed)
    same = packed[order[1:]] == packed[order[:-1]]
    if len(line) and (line[-1] >= 1 << 20 or (same & (h[order[1:]] != h[order[:-1]])).any()):
        order = np.lexsort((h, level, line))
        same = (line[order[1:]] == line[order[:-1]]) & (h[order[1:]] == h[order[:-1]])
    order = order[np.concatenate([[True], ~same])] if len(order) else order
    return line[order], h[order], level[order]


def _prints(h: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each line's set; start: where its words begin."""
    m = K.mix(h)
    first = K.mix(np.add.reduceat(m, start) ^ K.mix(np.bitwise_xor.reduceat(K.mix(m), start) + size.astype(U)))
    return first, K.mix(np.add.reduceat(K.mix(h ^ U(0x5851F42D4C957F2D)), start) + size.astype(U))


FIRST = "part int, at binary, n binary, doc_id long, line int, print long, print2 long, copy boolean"
_FIRST = pa.schema([("part", pa.int32()), ("at", pa.binary()), ("n", pa.binary()), ("doc_id", pa.int64()), ("line", pa.int32()), ("print", pa.int64()), ("print2", pa.int64()), ("copy", pa.bool_())])


def _copies(doc: np.ndarray, line: np.ndarray, prints: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which lines have the prints of an earlier one of these."""
    order = np.lexsort((line, doc, *prints))
    doc, line, x, y = (v[order] for v in (doc, line, *prints))
    new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])[: len(order)]
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    out = np.zeros(len(order), bool)
    out[order] = (doc != doc[first]) | (line != line[first])
    return out


def _settle(group: pa.Table) -> pa.Table:
    on = _copies(*(group.column(c).to_numpy() for c in ("doc_id", "line")), tuple(group.column(c).to_numpy() for c in ("print", "print2")))
    return group.select(["doc_id", "line"]).filter(pa.array(on))


def _first_pass(batches):
    """Prints of all lines with words, with those that are copies within a slice marked, and last the counts of words."""
    total = np.zeros(1 << COUNTER_BITS, np.int64)
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        data, ends = K.buffers(batch.column("text"))
        for a, b in K.slices(ends, _LINE_SLICE):
            row, number, at = lines(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a])
            s, _, h, _ = K.words(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a])
            if not len(h):
                continue
            np.add.at(total, (h >> U(64 - COUNTER_BITS)).astype(np.int64), 1)
            line, h, _ = _sets(_lines_of(at, s), h, np.zeros(len(h), np.uint8))
            start = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
            prints = _prints(h, start, np.diff(np.append(start, len(line))))
            on, none = line[start], [None] * len(start)
            doc, number = ids[a + row[on]].astype(np.int64), number[on].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(none, pa.int32()), pa.array(none, pa.binary()), pa.array(none, pa.binary()), pa.array(doc), pa.array(number), *[pa.array(p.view(np.int64)) for p in prints], pa.array(_copies(doc, number, prints))], schema=_FIRST)
    for part, x in enumerate(np.split(total, 64)):
        if x.any():
            yield pa.RecordBatch.from_pydict({"part": [part], **{k: [v] for k, v in _sparse(x).items()}, "doc_id": [None], "line": [None], "print": [None], "print2": [None], "copy": [None]}, schema=_FIRST)


def _sparse(x: np.ndarray) -> dict[str, bytes]:
    k = np.flatnonzero(x)
    return {"at": k.astype(np.int32).tobytes(), "n": x[k].astype(np.int64).tobytes()}


def _added(group: pa.Table) -> np.ndarray:
    total = np.zeros((1 << COUNTER_BITS) // 64, np.int64)
    for at, n in zip(group.column("at"), group.column("n"), strict=True):
        total[np.frombuffer(at.as_py(), np.int32)] += np.frombuffer(n.as_py(), np.int64)
    return total


def _add(group: pa.Table) -> pa.Table:
    return pa.table({"part": group.column("part")[:1], **{k: pa.array([v], pa.binary()) for k, v in _sparse(_added(group)).items()}})


def _levels(group: pa.Table) -> pa.Table:
    total = _added(group)
    level = np.minimum(255, 8 * np.log2(1 + total.astype(np.float64))).astype(np.uint8)
    return pa.table({"part": group.column("part")[:1], "levels": pa.array([level.tobytes()], pa.binary()), "words": pa.array([int(total.sum())], pa.int64())})


class Lines:
    """Ordered word sets of a slice's lines: per line its size and print; per element its line, its place and the parities of those after it."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, levels: np.ndarray, wanted=None):
        """wanted(hashes): lines without such a word are left empty."""
        self.row, self.number, self.at = lines(data, ends)
        s, _, h, _ = K.words(data, ends)
        if wanted:
            some = K.distinct(np.searchsorted(self.at, s[wanted(h)], side="right") - 1)
            cut = np.append(np.searchsorted(s, self.at), len(s))
            size = cut[some + 1] - cut[some]
            line, h = np.repeat(some, size), h[np.arange(size.sum()) + np.repeat(cut[some] - np.cumsum(size) + size, size)]
        else:
            line = _lines_of(self.at, s)
        self.line, self.token, self.level = _sets(line, h, levels[(h >> U(64 - COUNTER_BITS)).astype(np.int64)])
        count = len(self.row)
        self.size = np.bincount(self.line, minlength=count)
        start = np.cumsum(self.size) - self.size
        self.place = np.arange(len(self.line)) - start[self.line]
        self.print = np.zeros(count, U)
        self.even, self.odd = (np.zeros(len(self.line), U) for _ in range(2))
        on = np.flatnonzero(self.size)
        if len(on):
            self.print[on] = _prints(self.token, start[on], self.size[on])[0]
            m = K.mix(self.token)
            bit, low = U(1) << ((m >> U(57)) & U(63)), m & U(1) == 0
            last = (start + self.size - 1)[self.line]
            even = np.bitwise_xor.accumulate(np.where(low, bit, U(0)))
            odd = np.bitwise_xor.accumulate(bit) ^ even
            self.even, self.odd = even ^ even[last], odd ^ odd[last]


# ---- what the filters of fixed size hold ---------------------------------------------------------


def _place(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    return K.mix(K.mix(doc.astype(np.int64).view(U)) + line.astype(np.int64).view(U))


# ---- prefixes to token ranges --------------------------------------------------------------------

_TYPES = {"tokens": "u4", "docs": "i8", "lines": "i4", "sizes": "i4", "places": "i4", "even": "u8", "odd": "u8", "prints": "u4", "asks": "u1"}
BLOB_SCHEMA = "part int, " + ", ".join(f"{n} binary" for n in _TYPES)


def _numbers(batch: pa.RecordBatch, row: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The lines' numbers: where rows are lines, they have them."""
    return batch.column("line").to_numpy()[row] if "line" in batch.schema.names else number


def _wanted(again):
    return lambda h: holds(again.value[0], K.mix(h))


def _prefixes(L: Lines, doc: np.ndarray, percent: int) -> np.ndarray:
    """Elements of the lines' prefixes, but of equal sets in a slice only the first line's."""
    order = np.lexsort((L.number, doc, L.print))
    first = np.zeros(len(order), bool)
    first[order] = np.concatenate([[True], L.print[order][1:] != L.print[order][:-1]])
    return np.flatnonzero(first[L.line] & (L.level > _ONCE) & (L.place < (L.size - (percent * L.size + 99) // 100 + 1)[L.line]))


def _send(shared, percent: int, bits: int, again=None):
    """again: broadcast filters of the tokens that take part in a further round and of the sets that ask in it."""

    def run(batches):
        levels, held, count = shared.value, [], 0
        for batch in batches:
            batch = batch.filter(batch.column("doc_id").is_valid())
            ids = batch.column("doc_id").to_numpy()
            data, ends = K.buffers(batch.column("text"))
            for a, b in K.slices(ends, _LINE_SLICE):
                L = Lines(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a], levels, again and _wanted(again))
                if not len(L.token):
                    continue
                doc, L.number = ids[a + L.row], _numbers(batch, a + L.row, L.number)
                k = _prefixes(L, doc, percent)
                key = K.mix(L.token[k])
                if again:
                    good = holds(again.value[0], key)
                    k, key = k[good], key[good]
                n = L.line[k]
                asks = holds(again.value[1], _print_hash(L.print[n] >> U(32))) if again else np.ones(len(k), bool)
                held.append((key, doc[n], L.number[n], L.size[n], L.place[k], L.even[k], L.odd[k], L.print[n] >> U(32), asks))
                count += len(k)
                if count > _HELD:
                    yield _packed(held, bits)
                    held, count = [], 0
        if count:
            yield _packed(held, bits)

    return run


def _token_hash(held: np.ndarray, bits: int) -> np.ndarray:
    """The upper bits of the hash of a token that is written as (range, token)."""
    return held.view(U) << U(32 - bits)


def _print_hash(print_: np.ndarray) -> np.ndarray:
    return K.mix(print_.astype(U))


def _firsts(key: np.ndarray, c: dict[str, np.ndarray]) -> np.ndarray:
    """Of rows with the same token and set those of the earliest line."""
    same = K.mix(key.astype(U) + K.mix(c["prints"].astype(U))) ^ K.mix(c["even"] + K.mix(c["odd"] + K.mix(c["sizes"].astype(U))))
    order = np.argsort(same)
    same = same[order]
    at = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]])) if len(order) else order
    count = np.diff(np.append(at, len(order)))
    # only rows that are not alone need the order of their lines
    some = np.repeat(count > 1, count)
    k = order[some]
    order[some] = k[np.lexsort((c["lines"][k], c["docs"][k], np.repeat(np.arange(len(at)), count)[some]))]
    return order[at]


def _in_order(token: np.ndarray, doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Positions by token (32 bits), then by line; one sort of one number, where that has room for them."""
    low = int(doc.min()) if len(doc) else 0
    bits = int(line.max()).bit_length() if len(line) else 0
    if len(doc) and (int(doc.max()) - low).bit_length() + bits > 32:
        return np.lexsort((line, doc, token))
    return np.argsort(token.astype(U) << U(32) | (doc - low).astype(U) << U(bits) | line.astype(U))


def _packed(held, bits: int) -> pa.RecordBatch:
    key, *cols = (np.concatenate(x) for x in zip(*held, strict=True))
    c = dict(zip(list(_TYPES)[1:], cols, strict=True))
    on = _firsts(key, c)
    key = key[on]
    part = (key >> U(64 - bits)).astype(np.int64)
    c = {"tokens": key >> U(32 - bits) & U(0xFFFFFFFF)} | {n: x[on] for n, x in c.items()}
    order = np.argsort(part.astype(np.uint16) if bits <= 16 else part, kind="stable")
    part = part[order]
    at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    stop = np.append(at[1:], len(part))
    cols = [c[n].astype(t)[order] for n, t in _TYPES.items()]
    arrays = [pa.array(part[at].astype(np.int32))] + [pa.array([K.planes(x[a:b]) for a, b in zip(at, stop, strict=True)], pa.binary()) for x in cols]
    return pa.RecordBatch.from_arrays(arrays, names=["part", *_TYPES])


# ---- ranges --------------------------------------------------------------------------------------

PAIRS = "doc_id long, line int, doc2 long, line2 int, apart int, print long, held array<long>"
_PAIR_STEP = 2_000_000


def _meet(percent: int, most: int):
    """Of each asking line in a range its `most` likeliest earlier partners; held: its tokens (range and token) that have more."""

    def run(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        c = {n: np.concatenate([K.values(x.as_py(), t) for x in group.column(n)]) for n, t in _TYPES.items()}
        on = _firsts(c["tokens"], c)
        on = on[_in_order(c["tokens"][on], c["docs"][on], c["lines"][on])]
        token = c["tokens"][on]
        edge = np.concatenate([[True], token[1:] != token[:-1]])
        on = on[~(edge & np.append(edge[1:], True))]  # tokens of one set meet nothing
        c = {n: x[on] for n, x in c.items()}
        token, size, place = c["tokens"], c["sizes"].astype(np.int64), c["places"].astype(np.int64)
        after = (size - place).astype(np.int32)  # tokens from the shared one on
        size32 = size.astype(np.int32)
        widest = int(size.max(initial=0)) * 2 + 2
        needs = -(-percent * np.arange(widest) // (100 + percent)).astype(np.int32)  # tokens in common, by the sizes' sum
        edge = np.concatenate([[True], token[1:] != token[:-1]])[: len(token)]
        bucket = np.cumsum(edge) - 1
        first = np.flatnonzero(edge)[bucket]
        rank = np.arange(len(token)) - first  # how many earlier ones the token has

        def apart(i, j):
            """Where i and j can match: which of the pairs, how far apart they are at least and may be at most."""
            # with so many tokens left in both, sizes and places fit too
            both = size32[i] + size32[j]
            on = np.flatnonzero(np.minimum(after[i], after[j]) >= needs[both])
            i, j, both = i[on], j[on], both[on].astype(np.int64)
            far, limit = place[i] + place[j], both - 2 * needs[both].astype(np.int64)
            far = far + np.bitwise_count(c["even"][i] ^ c["even"][j]) + np.bitwise_count(c["odd"][i] ^ c["odd"][j])
            good = far <= limit
            return on[good], far[good], limit[good]

        asks = (c["asks"] > 0) & (rank > 0)
        near, pivot = np.full(len(token), 1 << 30), np.zeros(len(token), np.int64)
        left = np.flatnonzero(asks)
        for p in range(PIVOTS if most == 1 else 0):
            left = left[rank[left] > p]
            on, far, limit = apart(left, first[left] + p)
            i = left[on]
            better = (2 * far <= limit) & (far < near[i])
            near[i[better]], pivot[i[better]] = far[better], first[i[better]] + p
            left = left[near[left] > 0]
        likely = np.flatnonzero(near < 1 << 30)
        found = [np.stack([likely, pivot[likely], near[likely]], axis=1)]
        more = np.zeros(len(token), bool)
        more[likely] = rank[likely] > 1

        # the others ask all earlier lines of fitting size
        ask = np.flatnonzero(asks & (near == 1 << 30))
        if len(ask):
            key = bucket * widest + size
            by_size = np.argsort(key)
            key = key[by_size]
            # only its first tokens can be a set's first common one with a larger set
            wide = place[ask] <= size[ask] - -(-2 * percent * size[ask] // (100 + percent))
            lo = np.searchsorted(key, bucket[ask] * widest + (percent * size[ask] + 99) // 100)
            hi = np.searchsorted(key, bucket[ask] * widest + np.where(wide, size[ask] * 100 // percent, size[ask]), side="right")
            count = hi - lo
            total = np.cumsum(count)
            at = 0
            while at < len(ask):
                base = total[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(total, base + _PAIR_STEP, side="right")))
                n = count[at:to]
                i = np.repeat(ask[at:to], n)
                j = by_size[np.repeat(lo[at:to] + n - np.cumsum(n), n) + np.arange(len(i))]
                on = j < i
                i, j = i[on], j[on]
                on, far, _ = apart(i, j)
                found.append(np.stack([i[on], j[on], far], axis=1))
                at = to
        i, j, far = np.concatenate(found).T
        doc, line = c["docs"], c["lines"].astype(np.int64)
        order = np.lexsort((far, line[j], doc[j], line[i], doc[i]))
        x = np.stack([doc[i], line[i], doc[j], line[j]], axis=1)[order]
        order = order[np.concatenate([[True], (x[1:] != x[:-1]).any(axis=1)])] if len(order) else order
        order = order[np.lexsort((line[j[order]], doc[j[order]], far[order], line[i[order]], doc[i[order]]))]
        x = np.stack([doc[i], line[i]], axis=1)[order]
        new = np.concatenate([[True], (x[1:] != x[:-1]).any(axis=1)])[: len(order)]
        who = np.cumsum(new) - 1
        nth = np.arange(len(order)) - np.flatnonzero(new)[who]
        # the tokens of a line that has more partners than it leaves with
        some = np.zeros(int(new.sum()), bool)
        some[who[nth >= most]] = True
        own = np.full(len(token), -1)
        own[i[order]] = who
        of_line = {}
        known = np.flatnonzero(own >= 0)
        for k in known[more[known] | some[own[known]]]:
            of_line.setdefault(int(own[k]), []).append((part << 32) | int(token[k]))
        kept = order[nth < most]
        held = [of_line.get(int(w)) if n == 0 else None for w, n in zip(who[nth < most], nth[nth < most], strict=True)]
        i, j = i[kept], j[kept]
        return pa.table({"doc_id": doc[i], "line": c["lines"][i], "doc2": doc[j], "line2": c["lines"][j], "apart": far[kept].astype(np.int32), "print": c["prints"][i].astype(np.int64), "held": pa.array(held, pa.list_(pa.int64()))})

    return run


# ---- verification --------------------------------------------------------------------------------


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            sides = []
            for name in ("text", "text2"):
                data, ends = K.buffers(batch.column(name))
                _, _, h, rows = K.words(data, ends)
                sides.append((h, rows))
            (h, r), (g, s) = sides
            for i in range(batch.num_rows):
                a, b = K.distinct(h[r[i] : r[i + 1]]), K.distinct(g[s[i] : s[i + 1]])
                same = len(a) + len(b) - len(K.distinct(np.concatenate([a, b])))
                good[i] = same > 0 and 100 * same >= percent * (len(a) + len(b) - same)
            yield batch.select(["doc_id", "line"]).filter(pa.array(good))

    return run


LINES = "doc_id long, line int, text binary"


def _rows_of_lines(data: np.ndarray, row: np.ndarray, at: np.ndarray, on: np.ndarray, ids: np.ndarray, number: np.ndarray) -> pa.RecordBatch:
    """The lines at positions `on`, without their line feeds, as rows of LINES."""
    stop = np.append(at[1:] - (row[1:] == row[:-1]), len(data))[on]
    size = stop - at[on]
    offsets = np.concatenate([[0], np.cumsum(size)])
    own = data[np.arange(offsets[-1]) + np.repeat(at[on] - offsets[:-1], size)]
    text = pa.Array.from_buffers(pa.large_binary(), len(on), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(own)])
    return pa.RecordBatch.from_arrays([pa.array(ids[row[on]]), pa.array(number[on].astype(np.int32)), text.cast(pa.binary())], names=["doc_id", "line", "text"])


def _fetch(wanted):
    """The lines that the filter holds."""

    def run(batches):
        for batch in batches:
            batch = batch.filter(batch.column("doc_id").is_valid())
            ids = batch.column("doc_id").to_numpy()
            data, ends = K.buffers(batch.column("text"))
            for a, b in K.slices(ends, _LINE_SLICE):
                own = data[ends[a] : ends[b]]
                row, number, at = lines(own, ends[a : b + 1] - ends[a])
                number = _numbers(batch, a + row, number)
                on = np.flatnonzero(holds(wanted.value, _place(ids[a + row], number)))
                if len(on):
                    yield _rows_of_lines(own, row, at, on, ids[a:b], number)

    return run


def _partakers(shared, percent: int, again):
    """The lines with a token in their prefix that takes part in a further round."""

    def run(batches):
        for batch in batches:
            batch = batch.filter(batch.column("doc_id").is_valid())
            ids = batch.column("doc_id").to_numpy()
            data, ends = K.buffers(batch.column("text"))
            for a, b in K.slices(ends, _LINE_SLICE):
                own = data[ends[a] : ends[b]]
                L = Lines(own, ends[a : b + 1] - ends[a], shared.value, _wanted(again))
                if not len(L.token):
                    continue
                L.number = _numbers(batch, a + L.row, L.number)
                k = _prefixes(L, ids[a + L.row], percent)
                on = K.distinct(L.line[k[_wanted(again)(L.token[k])]])
                if len(on):
                    yield _rows_of_lines(own, L.row, L.at, on, ids[a:b], L.number)

    return run


def repeated_lines(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, line) of every line of docs(doc_id, text, ...) that matches an earlier one; lines count from 0."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    first = keep(known.mapInArrow(_first_pass, FIRST), "lines")
    # as many salts as the square root of the tasks: neither step gathers more than that of a part
    counts = first.where("part is not null").select("part", "at", "n", F.pmod(F.xxhash64("at", "n"), F.lit(max(1, isqrt(known.rdd.getNumPartitions())))).alias("salt"))
    counted = counts.groupBy("part", "salt").applyInArrow(_add, "part int, at binary, n binary").groupBy("part").applyInArrow(_levels, "part int, levels binary, words long")
    levels, words = np.zeros((64, (1 << COUNTER_BITS) // 64), np.uint8), 0
    for r in counted.collect():  # 2**COUNTER_BITS bytes in all
        levels[r["part"]], words = np.frombuffer(r["levels"], np.uint8), words + r["words"]
    levels = share(levels.ravel())
    bits = int(np.clip((words // PART_WORDS).bit_length(), *PART_BITS))

    own = first.where("print is not null")
    met = own.where("not copy").withColumn("part", F.shiftrightunsigned("print", 64 - bits).cast("int"))
    copies = met.select("part", "doc_id", "line", "print", "print2").groupBy("part").applyInArrow(_settle, "doc_id long, line int")
    copies = copies.unionByName(own.where("copy").select("doc_id", "line"))

    out, again, most, part = copies, None, 1, known
    while True:
        sent = part.mapInArrow(_send(levels, percent, bits, again), BLOB_SCHEMA)
        raw = keep(sent.groupBy("part").applyInArrow(_meet(percent, most), PAIRS), "pairs")
        ends = raw.select("doc_id", "line").unionByName(raw.select(F.col("doc2").alias("doc_id"), F.col("line2").alias("line")))
        wanted = share(bit_filter(ends, lambda b: _place(b.column("doc_id").to_numpy(), b.column("line").to_numpy())))
        cut = keep(part.mapInArrow(_fetch(wanted), LINES), "cut")

        def verified(some: DataFrame, cut: DataFrame = cut) -> DataFrame:
            sides = some.select("doc_id", "line", "doc2", "line2").join(cut, ["doc_id", "line"])
            sides = sides.join(cut.select(F.col("doc_id").alias("doc2"), F.col("line").alias("line2"), F.col("text").alias("text2")), ["doc2", "line2"])
            return keep(sides.select("doc_id", "line", "text", "text2").mapInArrow(_verify(percent), "doc_id long, line int").distinct(), "matches")

        best = raw.groupBy("doc_id", "line").agg(F.min(F.struct("apart", "doc2", "line2")).alias("p"))
        match = verified(best.select("doc_id", "line", "p.doc2", "p.line2"))
        match = match.unionByName(verified(raw.select("doc_id", "line", "doc2", "line2").join(match, ["doc_id", "line"], "left_anti").distinct()))
        out = out.unionByName(match)
        rest = keep(raw.where("held is not null").join(match, ["doc_id", "line"], "left_anti").select("print", F.explode("held").alias("token")), "rest")
        if rest.isEmpty():
            return out.distinct()
        tokens = bit_filter(rest, lambda b: _token_hash(b.column("token").to_numpy(), bits))
        again, most = share((tokens, bit_filter(rest, lambda b: _print_hash(b.column("print").to_numpy())))), most * STEP
        part = keep(part.mapInArrow(_partakers(levels, percent, again), LINES), "part")


def dedup_lines(docs: DataFrame, percent: int = 75, n_lines: str = "n_lines", n_removed: str = "n_removed") -> DataFrame:
    """docs with text without its repeated lines, and n_lines, n_removed (of the input text).

    Lines end at line feeds; lines without words stay, null and empty texts too.
    Rows with a null doc_id have no place in the order: they stay whole and
    remove nothing. Rows that repeat a doc_id lose the same lines by number.
    Other columns pass through, but one that has the name of a count (which can
    be chosen) gives way to it. An empty table gives an empty result.
    """
    own_id, own_gone = fresh(docs, "__id"), fresh(docs, "__gone")
    gone = repeated_lines(docs, percent).groupBy(F.col("doc_id").alias(own_id)).agg(F.collect_set("line").alias(own_gone))
    out = docs.join(gone, docs["doc_id"] == gone[own_id], "left")
    every = F.split(F.col("text").cast("string"), "\n")
    kept = F.filter(every, lambda x, i: ~F.array_contains(F.col(own_gone), i))
    text = F.when(F.col(own_gone).isNull(), F.col("text").cast("string")).otherwise(F.array_join(kept, "\n"))
    feeds = F.octet_length(F.col("text").cast("string")) - F.octet_length(F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit("")))
    counts = {n_lines: F.coalesce(feeds + 1, F.lit(0)), n_removed: F.greatest(F.coalesce(F.size(own_gone), F.lit(0)), F.lit(0))}
    return out.select(*[text.alias("text") if c == "text" else docs[c] for c in docs.columns if c not in counts], *[n.cast("long").alias(c) for c, n in counts.items()])


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], percent: int = 75) -> set[tuple[int, int]]:
    """(doc_id, line) that match an earlier line, from all pairs, for tests."""
    import re

    seen, out = [], set()
    for d, text in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        for k, line in enumerate(text.split("\n")):
            s = frozenset(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), line)))
            if not s:
                continue
            if any(min(len(s), len(t)) * 100 >= percent * max(len(s), len(t)) and 100 * len(s & t) >= percent * len(s | t) for t in seen):
                out.add((d, k))
            seen.append(s)
    return out
