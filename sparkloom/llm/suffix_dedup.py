"""Suffix-array dedup: byte spans that a document with a smaller id has as well.

A byte goes if some `width`-byte string that covers it also starts in a document
with a smaller doc_id, judged on the input.

Sorting every suffix of the corpus would move each text width times. Suffixes
are therefore sorted at anchors only: each window of `width` bytes is answered
for by its least 24-byte string (leftmost of those with the least hash), so equal
windows have equal anchors at equal places, one in about 14 positions.

1.  Anchors meet as compact columns of hashes, cut by hash ranges; those of a
    single document can have no match and end here.
2.  The others' suffixes (with the bytes before them that their windows need)
    go to buckets by sampled splitters over the anchor's 24 bytes. Equal anchors
    are in one bucket, so no match crosses a boundary, and what cannot be split
    is one anchor's rows, of at most HOT documents. Where a text has a period,
    an anchor recurs with the same bytes around it; such a stretch is one row.
3.  A bucket sorts its suffixes by multikey quicksort over 8-byte symbols, and
    the bytes before them, read backwards, in the same way. The lengths that
    sorted neighbours share decide what matches: windows are equal if they begin
    as far before their anchors and share enough bytes on both sides of them.
4.  Anchors of over HOT documents are dealt out by whole windows instead; each
    task sends only its first document of every such window, and a bucket sorts
    the windows and compares neighbours.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .stage import keep

U = np.uint64
GRAM = 24
#: Anchors meet in so many hash ranges at least, and in one for each PART_BYTES of text (rounded up to a power of two). A range tells
#: 2**32 hashes apart, so longer hashes meet as the text grows.
PARTS, PART_BYTES = 256, 64 << 20
#: An anchor in more documents than this is dealt out by windows.
HOT = 20_000
#: Anchors that a task holds before it sends them on.
HELD = 1_000_000
_SEGMENT = 1 << 20
#: Marks hashes of anchors in over HOT documents.
_HOT = U(1 << 63)


def _words_at(data: np.ndarray, shift: int, count: int) -> np.ndarray:
    return np.ndarray((count,), "<u8", data, offset=shift, strides=(1,)).astype(U)


def anchors(data: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Row, hash, place, first and last window start of each anchor; places count from the start of data."""
    out = []
    span = width - GRAM + 1
    for a, b in K.slices(ends, _SEGMENT):
        if ends[b] - ends[a] <= 2 * _SEGMENT:
            pieces = [(ends[a], ends[b])]
        else:
            pieces = [(x, min(x + _SEGMENT + width - 1, ends[b])) for x in range(ends[a], ends[b], _SEGMENT)]
        for lo, hi in pieces:
            n = hi - lo
            if n < width:
                continue
            own = np.ascontiguousarray(data[lo:hi])
            grams = n - GRAM + 1
            h = K.mix(_words_at(own, 0, grams) * U(0x9E3779B97F4A7C15) + K.mix(_words_at(own, 8, grams)) * U(0xC2B2AE3D27D4EB4F) + _words_at(own, 16, grams) * U(0x165667B19E3779F9))
            m = (h & ~U(0xFFFFFF)) | np.arange(grams, dtype=U)
            size = 1
            while 2 * size <= span:
                m = np.minimum(m[:-size], m[size:])
                size *= 2
            if size < span:
                m = np.minimum(m[: len(m) - (span - size)], m[span - size :])
            starts = np.arange(len(m))
            row = np.searchsorted(ends[a : b + 1], starts + lo, side="right") - 1 + a
            fits = starts + lo + width <= ends[row + 1]
            m, starts, row = m[fits], starts[fits], row[fits]
            if not len(m):
                continue
            new = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (row[1:] != row[:-1])]))
            last = np.concatenate([new[1:], [len(m)]]) - 1
            at = (m[new] & U(0xFFFFFF)).astype(np.int64)
            out.append((row[new], h[at], at + lo, starts[new] + lo, starts[last] + lo))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none.astype(U), none, none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


# ---- 1. which anchors more than one document has -------------------------------------------------


def _send(width: int, bits: int):
    def run(batches):
        held, count = [], 0
        for batch in batches:
            batch = batch.filter(batch.column("doc_id").is_valid())
            if not batch.num_rows:
                continue
            data, ends = K.buffers(batch.column("text"))
            ids, rs = batch.column("doc_id").to_numpy(), batch.column("r").to_numpy()
            for a, b in K.slices(ends):
                row, h, *_ = anchors(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a], width)
                held.append((h >> U(32 - bits), ids[a:b][row], rs[a:b][row]))
                count += len(h)
                if count >= HELD:
                    yield from _packed(held)
                    held, count = [], 0
        if count:
            yield from _packed(held)

    return run


def _packed(held):
    """Rows of anchors by range; held: hashes of 32 bits and the range's."""
    h, d, r = (np.concatenate(x) for x in zip(*held, strict=True))
    # of equal texts only the first one's anchors go on
    docs = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (r[1:] != r[:-1])]))
    order = docs[np.lexsort((d[docs], r[docs]))]
    least = np.concatenate([[True], r[order][1:] != r[order][:-1]])
    keep_doc = np.zeros(len(d), bool)
    keep_doc[order[least]] = True
    size = np.diff(np.concatenate([docs, [len(d)]]))
    on = np.repeat(keep_doc[docs], size)
    h, d = h[on], d[on]
    order = np.argsort(h, kind="stable")
    h, d = h[order], d[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])[: len(h)]
    h, d = h[new], d[new]
    used = K.distinct(h >> U(32))
    cut = np.append(np.searchsorted(h, used << U(32)), len(h))
    rows = {"part": [], "hashes": [], "base": [], "bytes": [], "docs": []}
    for p, a, b in zip(used.tolist(), cut[:-1], cut[1:], strict=True):
        own = d[a:b]
        kind = next(x for x in ("u2", "u4", "i8") if x == "i8" or int(own.max()) - int(own.min()) < 1 << (8 * int(x[1])))
        base = own.min() if kind != "i8" else 0
        rows["part"].append(p), rows["base"].append(int(base)), rows["bytes"].append(int(kind[1]))
        rows["hashes"].append((h[a:b] & U(0xFFFFFFFF)).astype("u4").tobytes()), rows["docs"].append((own - base).astype(kind).tobytes())
    yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("part", pa.int32()), ("hashes", pa.binary()), ("base", pa.int64()), ("bytes", pa.int32()), ("docs", pa.binary())]))


def _meet(group: pa.Table) -> pa.Table:
    part = group.column("part")[0].as_py()
    h = np.concatenate([np.frombuffer(x.as_py(), "u4") for x in group.column("hashes")])
    d = np.concatenate([np.frombuffer(x.as_py(), {2: "u2", 4: "u4", 8: "i8"}[n.as_py()]).astype(np.int64) + b.as_py() for x, n, b in zip(group.column("docs"), group.column("bytes"), group.column("base"), strict=True)])
    packed = np.sort((h.astype(U) << U(32)) | np.arange(len(h), dtype=U))
    h, d = packed >> U(32), d[(packed & U(0xFFFFFFFF)).astype(np.int64)]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    size = np.diff(np.concatenate([at, [len(h)]]))
    many = np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at)
    on = np.repeat(many, size)
    h, d = h[on] | (U(part) << U(32)) | np.where(np.repeat(size > HOT, size)[on], _HOT, U(0)), d[on]
    order = np.argsort(d, kind="stable")
    h, d = h[order], d[order]
    at = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]])) if len(d) else np.zeros(0, np.int64)
    stop = np.append(at[1:], len(d))[: len(at)]
    return pa.table({"doc_id": pa.array(d[at]), "met": pa.array([h[a:b].tobytes() for a, b in zip(at, stop, strict=True)], pa.binary())})


# ---- 2. suffixes to buckets ----------------------------------------------------------------------

ROWS = "bucket int, kind int, d long, r long, pos int, windows long, again long, bytes binary"
#: windows holds first and last, again holds step and count, 32 bits each: a row is no wider for them.
NAMES = ["bucket", "kind", "d", "r", "pos", "windows", "again", "bytes"]


def _big(x: np.ndarray) -> np.ndarray:
    """Rows of 8k bytes as k integers that sort like the bytes."""
    return np.ascontiguousarray(x).view(">u8").astype(U)


def _leads(block: np.ndarray) -> np.ndarray:
    """The anchors' own bytes, in an order in which equal ones are equal (it does not tell final zeros, which only balance suffers)."""
    return np.ascontiguousarray(block[:, :GRAM]).view(f"S{GRAM}").ravel()


def _own_anchors(batch: pa.RecordBatch, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which anchors met those of other documents, and which of them are in over HOT documents."""
    met, hot = np.zeros(len(h), bool), np.zeros(len(h), bool)
    cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
    for i in range(batch.num_rows):
        own = np.concatenate([np.frombuffer(x, U) for x in batch.column("met")[i].as_py()])
        mine = h[cut[i] : cut[i + 1]]
        met[cut[i] : cut[i + 1]] = np.isin(mine, own & ~_HOT)
        if (own >= _HOT).any():
            hot[cut[i] : cut[i + 1]] = np.isin(mine, own[own >= _HOT] ^ _HOT)
    return met & ~hot, met & hot


def _stretches(row, place, left, right, block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first of each run of equal neighbours in one text at equal distances, that distance and how many they are.

    Text with a period has the same anchor with the same bytes around it once a period: what holds for one holds for all.
    """
    like = np.concatenate([[False], (row[1:] == row[:-1]) & (left[1:] == left[:-1]) & (right[1:] == right[:-1])])
    on = np.flatnonzero(like)
    like[on] = (block[on] == block[on - 1]).all(axis=1)
    gap = np.diff(place, prepend=0)
    turn = np.concatenate([[False], like[:-1] & (gap[1:] != gap[:-1])])
    one = np.flatnonzero(~like | turn)
    count = np.diff(np.append(one, len(row)))
    return one, np.where(count > 1, gap[np.minimum(one + 1, len(row) - 1)], 0), count


def _deal(width: int, bits: int, splitters: np.ndarray, buckets: int):
    before = width - GRAM

    def run(batches):
        for batch in batches:
            data, ends = K.buffers(batch.column("text"))
            ids, rs = batch.column("doc_id").to_numpy(), batch.column("r").to_numpy()
            row, h, place, first, last = anchors(data, ends, width)
            h >>= U(32 - bits)
            met, hot = _own_anchors(batch, h, row)
            padded = np.concatenate([np.zeros(before, np.uint8), data, np.zeros(width, np.uint8)])
            on = np.flatnonzero(met)
            for at in range(0, len(on), 50_000):
                k = on[at : at + 50_000]
                view = np.lib.stride_tricks.sliding_window_view(padded, before + width)
                block = view[place[k]]  # `before` bytes, then `width` from the anchor on
                one, step, count = _stretches(row[k], place[k], place[k] - first[k], place[k] - last[k], block)
                k, block = k[one], block[one]
                yield _rows(np.searchsorted(splitters, _leads(block[:, before:]), side="right"), 0, ids[row[k]], rs[row[k]], place[k] - ends[row[k]], first[k] - ends[row[k]], last[k] - ends[row[k]], block, step, count)
            on = np.flatnonzero(hot)
            if len(on):
                count = last[on] - first[on] + 1
                start = np.repeat(first[on], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                r = np.repeat(row[on], count)
                block = np.lib.stride_tricks.sliding_window_view(padded, width)[start + before]
                order = np.lexsort((ids[r], *_symbols(block).T[::-1]))
                block, start, r = block[order], start[order], r[order]
                new = np.concatenate([[True], (block[1:] != block[:-1]).any(axis=1)])
                low = ids[r][np.flatnonzero(new)][np.cumsum(new) - 1]
                same = ids[r] == low  # the task's first document of the window is compared with the others' first
                where = buckets + (K.mix(_symbols(block)[:, 0] + K.mix(_symbols(block)[:, 2])) % U(buckets)).astype(np.int64)
                s = start - ends[r]
                yield _rows(where[same], 1, ids[r][same], rs[r][same], s[same], s[same], s[same], block[same])
                gone = np.flatnonzero(~same)
                gone = gone[np.lexsort((s[gone], r[gone]))]
                if len(gone):
                    s, r = s[gone], r[gone]
                    cutx = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1] + 1) | (r[1:] != r[:-1])]))
                    stop = np.concatenate([cutx[1:], [len(s)]]) - 1
                    yield _rows(buckets + ids[r[cutx]] % buckets, 2, ids[r[cutx]], rs[r[cutx]], s[cutx], s[cutx], s[stop], None)

    return run


def _rows(bucket, kind, d, r, pos, first, last, block, step=None, count=None) -> pa.RecordBatch:
    n = len(d)
    step, count = np.zeros(n) if step is None else step, np.ones(n) if count is None else count
    data = pa.nulls(n, pa.binary()) if block is None else pa.Array.from_buffers(pa.binary(block.shape[1]), n, [None, pa.py_buffer(np.ascontiguousarray(block))]).cast(pa.binary())
    windows, again = ((np.asarray(x, np.int64) << 32) | np.asarray(y, np.int64) for x, y in ((first, last), (step, count)))
    ints = [pa.array(np.asarray(x, kind_)) for x, kind_ in ((bucket, np.int32), (np.full(n, kind), np.int32), (d, np.int64), (r, np.int64), (pos, np.int32), (windows, np.int64), (again, np.int64))]
    return pa.RecordBatch.from_arrays([*ints, data], names=NAMES)


# ---- 3. buckets ----------------------------------------------------------------------------------


def _symbols(block: np.ndarray) -> np.ndarray:
    pad = -block.shape[1] % 8
    return _big(np.pad(block, ((0, 0), (0, pad))) if pad else block)


def multikey_quicksort(symbols: np.ndarray, small: int = 4096) -> np.ndarray:
    """The order of rows of symbols: three-way partitions on one symbol at a time, equal ones go on to the next."""
    out, at = np.empty(len(symbols), np.int64), 0
    todo = [(np.arange(len(symbols)), 0)]
    while todo:
        own, k = todo.pop()
        if k == symbols.shape[1] or len(own) <= 1:
            out[at : at + len(own)] = own
            at += len(own)
        elif len(own) <= small:
            out[at : at + len(own)] = own[np.lexsort(symbols[own, k:].T[::-1])]
            at += len(own)
        else:
            x = symbols[own, k]
            pivot = np.sort(x[:: max(1, len(x) // 31)])[min(15, len(x) // 2)]
            todo += [(own[x > pivot], k), (own[x == pivot], k + 1), (own[x < pivot], k)]
    return out


def _bucket(width: int):
    before = width - GRAM

    def runs(d, r, start, stop):
        order = np.lexsort((start, r, d))
        d, r, start, stop = d[order], r[order], start[order], stop[order]
        at = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (r[1:] != r[:-1])])) if len(d) else np.zeros(0, np.int64)
        to = np.append(at[1:], len(d))[: len(at)]
        pairs = np.stack([start, stop], axis=1).astype("i4")
        return pa.table({"doc_id": pa.array(d[at], pa.int64()), "r": pa.array(r[at], pa.int64()), "gone": pa.array([pairs[a:b].tobytes() for a, b in zip(at, to, strict=True)], pa.binary())})

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        col = {x: group.column(x).to_numpy() for x in NAMES[1:-1]}
        col |= {x: col[y] >> 32 for x, y in (("first", "windows"), ("step", "again"))} | {x: col[y] & 0xFFFFFFFF for x, y in (("last", "windows"), ("count", "again"))}
        found = []
        plain = np.flatnonzero(col["kind"] == 2)
        found.append((plain, col["first"][plain], col["last"][plain] + 1))
        for kind, size in ((0, before + width), (1, width)):
            k = np.flatnonzero(col["kind"] == kind)
            if len(k) < 2:
                continue
            k = k[np.argsort(col["d"][k], kind="stable")]
            data, _ = K.buffers(group.column("bytes").take(pa.array(k)))
            block = data.reshape(len(k), size)
            found += _suffixes(k, block, col, before, width) if kind == 0 else _windows(k, block, col)
        k, start, stop = (np.concatenate(x) for x in zip(*found, strict=True))
        count = col["count"][k]
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        k, start, stop = (np.repeat(x, count) for x in (k, start, stop))
        start, stop = start + nth * col["step"][k], stop + nth * col["step"][k]
        return runs(col["d"][k], col["r"][k], start, stop)

    return run


def _windows(k, block, col):
    order = multikey_quicksort(_symbols(block))
    order = order[np.lexsort((col["d"][k][order], _groups((block[order][1:] != block[order][:-1]).any(axis=1))))]
    new = np.concatenate([[True], (block[order][1:] != block[order][:-1]).any(axis=1)])
    d = col["d"][k][order]
    gone = k[order[d > d[np.flatnonzero(new)][np.cumsum(new) - 1]]]
    return [(gone, col["first"][gone], col["first"][gone] + 1)]


def _groups(differ: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(differ)])


def _shared(block: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many leading bytes each row of an order (but the first) shares with the one before it."""
    own = block[order]
    differ = own[1:] != own[:-1]
    return np.where(differ.any(axis=1), differ.argmax(axis=1), block.shape[1])


def _ranks(order: np.ndarray, shared: np.ndarray, least: int) -> np.ndarray:
    """Equal numbers for rows whose first `least` bytes are equal, as the shared lengths of sorted neighbours tell."""
    out = np.empty(len(order), np.int64)
    out[order] = _groups(shared < least)
    return out


def _later(d: np.ndarray, rows: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Those of rows (by rising d) that agree in all keys with a row of a smaller d."""
    order = np.lexsort([x[rows] for x in keys])  # stable: d still rises within a group
    differ = np.zeros(max(len(rows) - 1, 0), bool)
    for x in keys:
        differ |= np.diff(x[rows][order]) != 0
    rows, group = rows[order], _groups(differ)
    return rows[d[rows] > d[rows][np.flatnonzero(np.concatenate([[True], differ]))][group]]


def _suffixes(k, block, col, before, width):
    """Rows come by rising d. Windows that sorted neighbours show to be an earlier document's go.

    A window that begins t bytes before an anchor is another's if they share
    width - t bytes from the anchor on and t bytes before it. Both lengths are
    read off two sorted orders, of the suffixes and of the bytes before them
    backwards: rows whose neighbours all share so many bytes are one group.
    """
    order = multikey_quicksort(_symbols(block[:, before:]))
    near = np.concatenate([[False], _shared(block[:, before:], order) >= GRAM, [False]])
    near = near[1:] | near[:-1]
    on = np.sort(order[near])  # anchors that stand alone end here
    if not len(on):
        return []
    ahead = np.searchsorted(on, order[near])
    k, block = k[on], block[on]
    after, back = block[:, before:], np.ascontiguousarray(block[:, :before][:, ::-1])
    behind = multikey_quicksort(_symbols(back))
    shared_after, shared_back = _shared(after, ahead), _shared(back, behind)
    first, last, pos, d = (col[x][k] for x in ("first", "last", "pos", "d"))
    left, right = pos - first, pos - last
    # whole equal rows (with equal window ranges) first: for most copies this settles all windows
    gone = _later(d, np.arange(len(k)), left, right, _ranks(behind, shared_back, before), _ranks(ahead, shared_after, width))
    found = [(k[gone], first[gone], last[gone] + 1)]
    rest = np.ones(len(k), bool)
    rest[gone] = False
    for t in range(before + 1):
        on = np.flatnonzero(rest & (left >= t) & (right <= t))
        if len(on) > 1:
            gone = _later(d, on, _ranks(behind, shared_back, t), _ranks(ahead, shared_after, width - t))
            found.append((k[gone], pos[gone] - t, pos[gone] - t + 1))
    return found


# ---- the operator --------------------------------------------------------------------------------


def _cut(width: int):
    def run(batches):
        for batch in batches:
            texts, rs, marks = (batch.column(x) for x in ("text", "r", "marks"))
            n, spans, kept = [], [], []
            for i in range(batch.num_rows):
                text, r = texts[i].as_py() or b"", rs[i].as_py()
                own = [x["gone"] for x in marks[i].as_py() or [] if x["r"] == r]
                found = []
                if None in own:
                    found = [(0, len(text))] if len(text) >= width else []
                elif own:
                    x = np.concatenate([np.frombuffer(x, "i4").reshape(-1, 2) for x in own])
                    x = x[np.argsort(x[:, 0])]
                    stop = np.maximum.accumulate(x[:, 1] - 1 + width)
                    new = np.flatnonzero(np.concatenate([[True], x[1:, 0] > stop[:-1]]))
                    found = list(zip(x[new, 0].tolist(), stop[np.concatenate([new[1:], [len(x)]]) - 1].tolist(), strict=True))
                at, parts = 0, []
                for a, b in found:
                    parts.append(text[at:a])
                    at = b
                n.append(len(text)), spans.append([{"start": a, "stop": b} for a, b in found]), kept.append(b"".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return run


_ALIVE = "skip is null or not array_contains(skip, r)"


def _dealt(met: DataFrame, copies: DataFrame) -> DataFrame:
    """Anchors by document, with the texts of it that are whole copies and need none dealt."""
    return met.join(copies.groupBy("doc_id").agg(F.collect_set("r").alias("skip")), "doc_id", "left")


def _splitters(known: DataFrame, met: DataFrame, copies: DataFrame, width: int, bits: int, buckets: int, sample: int = 2000) -> np.ndarray:
    """Quantiles of the dealt anchors' own bytes in `sample` documents, at most 128 a document; they only balance the buckets."""

    def leads(batches):
        for batch in batches:
            data, ends = K.buffers(batch.column("text"))
            row, h, place, *_ = anchors(data, ends, width)
            place = place[_own_anchors(batch, h >> U(32 - bits), row)[0]]
            if len(place):
                place = place[:: max(1, len(place) // (64 * batch.num_rows))]
                yield pa.RecordBatch.from_arrays([pa.array([_leads(np.lib.stride_tricks.sliding_window_view(data, GRAM)[place]).tobytes()])], names=["x"])

    ids = F.broadcast(met.select("doc_id").orderBy(F.xxhash64("doc_id")).limit(sample))  # each table is cut to these rows before it moves
    some = known.join(ids, "doc_id").join(_dealt(met.join(ids, "doc_id"), copies.join(ids, "doc_id")), "doc_id").where(_ALIVE)
    got = some.select("text", "met").mapInArrow(leads, "x binary").collect()
    x = np.sort(np.frombuffer(b"".join(r[0] for r in got), f"S{GRAM}"))
    return K.distinct(x[(np.arange(1, buckets) * len(x)) // buckets]) if len(x) else x


def remove_repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """doc_id, n_bytes, spans (removed: start, stop in bytes), kept (the other bytes) for each row of docs(doc_id, text, ...).

    Null texts are empty. Texts of fewer than `width` bytes lose and match
    nothing. Matches never cross documents; a string that only one document (or
    only rows with one doc_id) holds stays. Rows with a null doc_id have no
    place in the order: they stay whole and remove nothing. Repeated rows are
    each returned. Kept bytes may end within a character, as cuts are by bytes.
    An empty table gives an empty result; other columns are ignored.
    """
    if not GRAM < width <= 256:
        raise ValueError(f"width must be over {GRAM} and at most 256")
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = docs.where("doc_id is not null").withColumn("r", F.xxhash64(F.coalesce("text", F.lit(""))))
    own = known.select("doc_id", "r", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    first = own.groupBy("sha").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    copies = keep(own.join(first, "sha").where("doc_id > low").select("doc_id", "r").distinct(), "copies")

    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = (max(PARTS, -(-size // PART_BYTES)) - 1).bit_length()  # of a hash range; at most 31
    sent = known.mapInArrow(_send(width, bits), "part int, hashes binary, base long, bytes int, docs binary")
    met = sent.groupBy("part").applyInArrow(_meet, "doc_id long, met binary")
    met = keep(met.groupBy("doc_id").agg(F.collect_list("met").alias("met")), "met")
    alive = known.join(_dealt(met, copies), "doc_id").where(_ALIVE).select("doc_id", "text", "r", "met")
    splitters = _splitters(known, met, copies, width, bits, buckets)
    rows = alive.mapInArrow(_deal(width, bits, splitters, buckets), ROWS)
    gone = rows.groupBy("bucket").applyInArrow(_bucket(width), "doc_id long, r long, gone binary")
    gone = gone.select("doc_id", "r", "gone").unionByName(copies.withColumn("gone", F.lit(None).cast("binary")))  # null: all of it
    marks = gone.groupBy("doc_id").agg(F.collect_list(F.struct("r", "gone")).alias("marks"))
    schema = "doc_id long, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary"
    # both joins deal the texts out by doc_id: Spark shuffles them once and reuses the exchange
    out = known.join(marks, "doc_id", "left").select("doc_id", F.col("text").cast("binary").alias("text"), "r", "marks").mapInArrow(_cut(width), schema)
    rest = docs.where("doc_id is null").select("doc_id", F.col("text").cast("binary").alias("text"), F.lit(0).cast("long").alias("r"), F.array().cast("array<struct<r: long, gone: binary>>").alias("marks")).mapInArrow(_cut(width), schema)
    return out.unionByName(rest)


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], width: int = 50) -> list[tuple]:
    """The same columns from a dictionary of all windows, for tests."""
    low: dict[bytes, int] = {}
    texts = [(d, (t or "").encode()) for d, t in rows]
    for d, t in texts:
        for i in range(len(t) - width + 1):
            w = t[i : i + width]
            low[w] = min(low.get(w, d), d)
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if low[t[i : i + width]] < d:
                gone[i : i + width] = b"\1" * width
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
