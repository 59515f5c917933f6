"""Alignment of two tokenizers by counts of id pairs in id-striped dense matrices.

Each text is encoded by a byte-level BPE (A) and a sentencepiece model (B). Places
where a token of both ends cut the tokens into groups; all A-B token pairs of a
group are links. The count of an id pair is the number of documents that hold it
linked; a link is best if its count is the highest of its A id.

Texts are cut into chunks where both tokenizers must have a border: before a space
or a line feed that follows no white space. Both give a chunk the tokens that it
has within its text, so each distinct chunk is encoded once, in a bounded cache, and
what follows is arithmetic on chunk numbers. Where a vocabulary allows no such cut
the whole text is one chunk. A group's links are kept as distinct id pairs with
multiplicities, so a long text without common borders emits no pair twice.

A ids are dealt round robin to stripes. A document's distinct pairs go to their
stripe; a stripe's counts are summed by np.add.at into a dense block of its A ids by
all B ids, in parts of bounded numbers of rows, whose sparse sums are summed again.
The links then meet their stripe's block, co-partitioned with it by a band of
stripes and a salt of texts; row maxima give the best links. Sums by document are
held by a task for a salt's texts only and added up by text.

Memory: a block (STRIPE x B ids), a slice of texts and its links, both bounded but
for a single long text, which takes about 60 bytes a byte.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .stage import keep

A_PATH, B_PATH = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: A ids of a stripe, bands of stripes, slices of text to a salt, bytes and rows of a slice, chunks that a worker remembers.
STRIPE, BANDS, SALT, SLICE, SLICE_ROWS, CACHE = 128, 16, 128, 4 << 20, 1 << 16, 250_000
#: Pairs of a group beyond which its ids are first made distinct.
WIDE = 256
#: Bytes of both vocabulary files together that may be broadcast.
LARGEST = 64 << 20


def letters() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Aligner:
    """Both tokenizers and a cache of chunks: their numbers of tokens, groups and links, their groups as text and their pairs."""

    def __init__(self, a: bytes, b: bytes, cut: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are what runs side by side
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        of = letters()
        size = max(self.a.get_vocab(with_added_tokens=True).values()) + 1
        entries = [self.a.id_to_token(i) or "" for i in range(size)]
        self.bytes_a = [bytes(of[c] for c in t) if all(c in of for c in t) else t.encode() for t in entries]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-Fa-f]{2}>", p) else p.replace(MARK, " ").encode() for p in pieces]
        self.na, self.nb = len(self.bytes_a), len(self.bytes_b)
        self.size_a, self.size_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        self.text_a, self.text_b = [str(i) for i in range(self.na)], [str(i) for i in range(self.nb)]
        cuts = self._cuts(json.loads(a), [p.replace(MARK, " ") for p in pieces]) if cut else ""
        self.cuts = np.zeros(256, bool)
        self.cuts[[ord(c) for c in cuts]] = True
        self.number: dict[bytes, int] = {}
        self.clear()

    @staticmethod
    def _cuts(a: dict, pieces: list[str]) -> str:
        """Before which of space and line feed both tokenizers must have a border, if no white space stands before it."""
        own, rest = a.get("pre_tokenizer") or {}, a.get("added_tokens") or []
        usual = own.get("type") == "ByteLevel" and own.get("use_regex", True) and not own.get("add_prefix_space") and not a.get("normalizer")
        if not usual or any(not t.get("special") or t.get("lstrip") or t.get("rstrip") for t in rest):
            return ""
        free = [c for c in " \n" if not any(re.search(rf"[^ \n]{c}", p) for p in pieces)]
        # a chunk that begins with a line feed is encoded after a mark of its own, which must stay alone
        return "".join(c for c in free if c == " " or not any(" \n" in p for p in pieces))

    def clear(self) -> None:
        self.number.clear()
        self.groups: list[bytes] = []
        self.used = np.zeros(0, np.int64)
        # tokens of A and B, groups, links, and whether the bytes agree
        self.facts = np.zeros((0, 5), np.int64)
        self.first, self.pairs, self.times = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def forget(self) -> None:
        """Keeps the half of the cache that was used most."""
        if len(self.number) <= CACHE:
            return
        kept = np.sort(np.argpartition(-self.used, CACHE // 2)[: CACHE // 2])
        names, many = list(self.number), np.diff(self.first)[kept]
        at = np.repeat(self.first[:-1][kept], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        self.number = {names[i]: k for k, i in enumerate(kept.tolist())}
        self.groups = [self.groups[i] for i in kept.tolist()]
        self.facts, self.used, self.pairs, self.times = self.facts[kept], self.used[kept] // 2, self.pairs[at], self.times[at]
        self.first = np.concatenate([[0], np.cumsum(many)])

    def encode(self, chunks: list[bytes]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """Ids of both for each chunk, and whether the bytes of both are the chunk's; a chunk is the added space and a text, or a part of that."""
        texts, fine = [], []
        for c in chunks:
            try:
                texts.append(c.decode())
                fine.append(True)
            except UnicodeDecodeError:
                texts.append("")
                fine.append(False)
        a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        asked, extra = [], []
        for t in texts:
            if t.startswith("\n"):
                asked.append(t)
                extra.append(1)  # the mark that B adds
            elif t and not t.strip(" ") and len(t) > 1:
                asked.append("x" + t)
                extra.append(len(self.b.encode("x")))
            elif t == " ":
                asked.append("x ")
                extra.append(len(self.b.encode("x")))
            else:
                asked.append(t[1:])
                extra.append(0)
        b = [ids[n:] for ids, n in zip(self.b.encode(asked, num_threads=1), extra, strict=True)]
        for ids, own in ((a, self.bytes_a), (b, self.bytes_b)):
            said = list(map(own.__getitem__, chain.from_iterable(ids)))
            if b"".join(said) == b"".join(chunks) and all(map(len, ids)):
                # all bytes agree; a token may still go over a chunk's end where a chunk before it differs
                size = np.add.reduceat(np.fromiter(map(len, said), np.int64, len(said)), np.cumsum([0, *map(len, ids[:-1])])) if said else np.zeros(0, np.int64)
                if (size == np.fromiter(map(len, chunks), np.int64, len(chunks))).all():
                    continue
            fine = [ok and b"".join(map(own.__getitem__, x)) == c for ok, c, x in zip(fine, chunks, ids, strict=True)]
        return a, b, fine

    def learn(self, chunks: list[bytes]) -> None:
        """Adds chunks that are not known yet."""
        start = len(self.number)
        self.number.update(zip(chunks, range(start, start + len(chunks)), strict=True))
        ids_a, ids_b, fine = self.encode(chunks)
        for i, ok in enumerate(fine):
            if not ok:
                ids_a[i], ids_b[i] = [], []
        count_a, count_b = np.array([len(x) for x in ids_a], np.int64), np.array([len(x) for x in ids_b], np.int64)
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, n) for x, n in ((ids_a, count_a.sum()), (ids_b, count_b.sum())))
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        border = np.intersect1d(end_a, end_b, assume_unique=True)
        to_a, to_b = np.searchsorted(end_a, border, side="right"), np.searchsorted(end_b, border, side="right")
        of_a, of_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        # chunks end at a border, so a group is in one chunk
        last = np.searchsorted(to_a, np.cumsum(count_a), side="left") + 1
        last = np.where(np.cumsum(count_a) > 0, last, 0)
        groups = np.diff(last, prepend=0)
        links = np.concatenate([[0], np.cumsum(of_a * of_b)])
        links = np.diff(links[last], prepend=0)
        self.facts = np.concatenate([self.facts, np.stack([count_a, count_b, groups, links, np.array(fine, np.int64)], axis=1).reshape(-1, 5)])
        ta, tb = [self.text_a[i] for i in a.tolist()], [self.text_b[i] for i in b.tolist()]
        said, pa_, pb_ = [], 0, 0
        for x, y in zip(to_a.tolist(), to_b.tolist(), strict=True):
            said.append(f"{ta[pa_]}|{tb[pb_]}" if x - pa_ == 1 == y - pb_ else f"{','.join(ta[pa_:x])}|{','.join(tb[pb_:y])}")
            pa_, pb_ = x, y
        at = 0
        for to in last.tolist():
            self.groups.append(";".join(said[at:to]).encode())
            at = to
        keys, times, owner = self._pairs(a, b, to_a, to_b, of_a, of_b)
        self.pairs, self.times = np.concatenate([self.pairs, keys]), np.concatenate([self.times, times])
        upto = np.searchsorted(owner, last, side="left")
        self.first = np.concatenate([self.first, self.first[-1] + upto])

    def _pairs(self, a, b, to_a, to_b, of_a, of_b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pair keys with multiplicities and their groups, in the order of groups."""
        sizes = of_a * of_b
        wide = np.flatnonzero(sizes > WIDE)
        flat = np.where(sizes > WIDE, 0, sizes)
        group = np.repeat(np.arange(len(flat)), flat)
        place = np.arange(len(group)) - np.repeat(np.cumsum(flat) - flat, flat)
        i, j = np.divmod(place, np.maximum(of_b[group], 1))
        keys = a[(to_a - of_a)[group] + i] * self.nb + b[(to_b - of_b)[group] + j]
        times = np.ones(len(keys), np.int64)
        if len(wide):
            found = [(keys, times, group)]
            for g in wide.tolist():
                x, nx = np.unique(a[to_a[g] - of_a[g] : to_a[g]], return_counts=True)
                y, ny = np.unique(b[to_b[g] - of_b[g] : to_b[g]], return_counts=True)
                found.append(((x[:, None] * self.nb + y).ravel(), (nx[:, None] * ny).ravel(), np.full(len(x) * len(y), g)))
            keys, times, group = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.argsort(group, kind="stable")
            keys, times, group = keys[order], times[order], group[order]
        return keys, times, group

    def chunks(self, data: np.ndarray, row_start: np.ndarray) -> np.ndarray:
        """Where chunks begin in texts that each begin with the added space."""
        cut = self.cuts[data]
        if len(data) > 1:
            before = data[:-1]
            solid = (before > 32) & (before < 127)
            # characters of two, three and four bytes of which none is white space
            solid[1:] |= (before[1:] > 127) & (data[:-2] >= 0xC3) & (data[:-2] < 0xE0)
            solid[2:] |= (before[2:] > 127) & (data[:-3] >= 0xE4) & (data[:-3] < 0xF0)
            solid[3:] |= (before[3:] > 127) & (data[:-4] >= 0xF0)
            cut[1:] &= solid
        cut[row_start] = True
        return np.flatnonzero(cut)

    def known(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Numbers of the chunks that begin at starts, learning those that are new."""
        out, stops = [], np.append(starts[1:], len(data))
        at = 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(stops, starts[at] + SLICE, side="right")))
            base, raw = int(starts[at]), data[starts[at] : stops[to - 1]].tobytes()
            own = [raw[x:y] for x, y in zip((starts[at:to] - base).tolist(), (stops[at:to] - base).tolist(), strict=True)]
            new = list({c for c in own if c not in self.number})
            for k in range(0, len(new), 20_000):
                self.learn(new[k : k + 20_000])
            out.append(np.fromiter(map(self.number.__getitem__, own), np.int64, len(own)))
            at = to
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def rows(self, data: np.ndarray, ends: np.ndarray):
        """(facts by row, groups_sha256 by row) and the distinct pairs by row: (row, pair, times), in the order of rows."""
        n = len(ends) - 1
        full = np.flatnonzero(np.diff(ends) > 0)
        facts, said = np.zeros((n, 4), np.int64), [""] * n
        if not len(full):
            none = np.zeros(0, np.int64)
            return facts, said, (none, none, none)
        text = np.insert(data, ends[:-1][full], 32)
        row_start = ends[:-1][full] + np.arange(len(full))
        starts = self.chunks(text, row_start)
        self.forget()
        ids = self.known(text, starts)
        self.used = np.bincount(ids, minlength=len(self.groups)) + np.pad(self.used, (0, len(self.groups) - len(self.used)))
        first = np.searchsorted(starts, row_start)
        own = self.facts[ids]
        fine = np.minimum.reduceat(own[:, 4], first) == 1
        facts[full] = np.where(fine[:, None], np.add.reduceat(own[:, :4], first, axis=0), 0)
        bounds = np.append(first, len(ids)).tolist()
        for k in np.flatnonzero(fine).tolist():
            sha, lo, hi = hashlib.sha256(), bounds[k], bounds[k + 1]
            for x in range(lo, hi, 1 << 20):
                sha.update(b";" * (x > lo) + b";".join(map(self.groups.__getitem__, ids[x : min(hi, x + (1 << 20))].tolist())))
            said[full[k]] = sha.hexdigest()
        row = np.repeat(np.arange(len(full)), np.diff(bounds))
        key, n_same = K.tally((row * len(self.groups) + ids)[fine[row]])
        row, ids = np.divmod(key, len(self.groups))
        many = np.diff(self.first)[ids]
        at = np.repeat(self.first[:-1][ids], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return facts, said, (np.repeat(full[row], many), self.pairs[at], self.times[at] * np.repeat(n_same, many))


_loaded: dict[int, Aligner] = {}


def _aligner(shared, cut: bool) -> Aligner:
    """One for each worker and pair of vocabularies; workers are used again."""
    key = hash((shared.value, cut))
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Aligner(*shared.value, cut)
    return _loaded[key]


OUT = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
LINKS = f"batch long, stripe int, places binary, cells binary, times binary, rows int, doc struct<doc_id: long, {OUT.replace(' long', ': long').replace(' string', ': string')}>, place int"


def _links(shared, cut: bool, stripes: int):
    """Rows with their digest, and packed distinct pairs of each slice of texts by stripe."""

    def run(batches):
        from pyspark import TaskContext

        aligner, number = _aligner(shared, cut), TaskContext.get().partitionId() << 32
        cells_of = -(-aligner.na // stripes) * aligner.nb
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32()]
        names = ["batch", "stripe", "places", "cells", "times", "rows", "doc", "place"]
        for batch in batches:
            data, ends = K.buffers(batch.column("text"))
            for lo, hi in K.slices(ends, SLICE):
                for lo_, hi_ in ((x, min(hi, x + SLICE_ROWS)) for x in range(lo, hi, SLICE_ROWS)):
                    own = ends[lo_ : hi_ + 1]
                    facts, said, (row, pair, times) = aligner.rows(data[own[0] : own[-1]], own - own[0])
                    n = hi_ - lo_
                    doc = pa.StructArray.from_arrays([batch.column("doc_id").slice(lo_, n), *(pa.array(facts[:, k]) for k in range(4)), pa.array(said, pa.string())], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), *(pa.nulls(n, k) for k in kinds[1:5]), pa.array(np.full(n, n, np.int32)), doc, pa.array(np.arange(n, dtype=np.int32))], names=names)
                    a, b = np.divmod(pair, aligner.nb)
                    line, stripe = np.divmod(a, stripes)
                    key, times = K.tally((stripe * n + row) * cells_of + line * aligner.nb + b, times)
                    key, cell = np.divmod(key, cells_of)
                    stripe, row = np.divmod(key, n)
                    at = np.flatnonzero(np.diff(stripe, prepend=-1))
                    out = []
                    for x, y in zip(at.tolist(), np.append(at[1:], len(stripe)).tolist()[: len(at)], strict=True):
                        out.append((number, int(stripe[x]), K.planes(np.diff(row[x:y], prepend=0).astype(np.uint32)), K.planes(cell[x:y].astype(np.uint32)), K.planes(times[x:y]), n))
                    if out:
                        yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)), pa.nulls(len(out), doc.type), pa.nulls(len(out), pa.int32())], names=names)
                    number += 1

    return K.releasing(run)


def _distinct(batches):
    """The cells of packed links with their numbers of documents."""
    for batch in batches:
        out = [K.tally(K.values(c, "u4")) for c in batch.column("cells").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("stripe"), batch.column("salt"), pa.array([K.planes(c) for c, _ in out], pa.binary()), pa.array([K.planes(n.astype(np.int64)) for _, n in out], pa.binary())], names=["stripe", "salt", "cells", "counts"])


def _summed(width: int):
    """Packed counts, rows of a key together, as one row a key: a dense block is filled by np.add.at and read off."""

    def run(batches):
        block, now = np.zeros(width, np.int64), None

        def read():
            cells = np.flatnonzero(block)
            row = pa.RecordBatch.from_pydict({"stripe": pa.array([now[0]], pa.int32()), "salt": pa.array([now[1]], pa.int32()), "cells": pa.array([K.planes(cells.astype(np.uint32))], pa.binary()), "counts": pa.array([K.planes(block[cells])], pa.binary())})
            block[cells] = 0
            return row

        for batch in batches:
            for key, cells, counts in zip(zip(batch.column("stripe").to_pylist(), batch.column("salt").to_pylist(), strict=True), batch.column("cells").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                if now is not None and key != now:
                    yield read()
                now = key
                np.add.at(block, K.values(cells, "u4"), K.values(counts, "i8"))
        if now is not None:
            yield read()

    return K.releasing(run)


COUNTS = "stripe int, salt int, cells binary, counts binary"


def _scored(width: int, nb: int):
    """Sums by document of links that meet their stripe's block; rows come by (band, salt), then stripe, the block first."""

    def run(batches):
        block = np.zeros(width, np.int64)
        best, filled, group, held = None, np.zeros(0, np.int64), None, {}

        def told():
            for batch, (n_best, total) in held.items():
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_pydict({"batch": pa.array([batch], pa.int64()), "places": pa.array([K.planes(at.astype(np.uint32))], pa.binary()), "n_best": pa.array([K.planes(n_best[at])], pa.binary()), "count_sum": pa.array([K.planes(total[at])], pa.binary())})
            held.clear()

        names = ["band", "salt", "batch", "rows", "places", "cells", "times", "counts"]
        for part in batches:
            for band, salt, batch, rows, places, cells, times, counts in zip(*(part.column(c).to_pylist() for c in names), strict=True):
                if (band, salt) != group:
                    yield from told()
                    group = (band, salt)
                cells = K.values(cells, "u4")
                if batch is None:
                    block[filled] = 0
                    filled = cells
                    block[cells] = K.values(counts, "i8")
                    best = block.reshape(-1, nb).max(axis=1)
                    continue
                doc, times, count = np.cumsum(K.values(places, "u4"), dtype=np.int64), K.values(times, "i8"), block[cells]
                n_best, total = held.setdefault(batch, (np.zeros(rows, np.int64), np.zeros(rows, np.int64)))
                np.add.at(n_best, doc, np.where(count == best[cells // nb], times, 0))
                np.add.at(total, doc, times * count)
        yield from told()

    return K.releasing(run)


def _joined(batches):
    """Rows of documents with the sums of their slice, whose rows come first."""
    now, n_best, total = None, None, None
    for part in (x for x in batches if x.num_rows):
        batch, kind = part.column("batch").to_numpy(), part.column("kind").to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], (batch[1:] != batch[:-1]) | (kind[1:] != kind[:-1])]))
        for x, y in zip(edge.tolist(), np.append(edge[1:], len(batch)).tolist(), strict=True):
            own = part.slice(x, y - x)
            if batch[x] != now:
                now, size = batch[x], own.column("rows")[0].as_py()
                n_best, total = np.zeros(size, np.int64), np.zeros(size, np.int64)
            if kind[x] == 0:
                for places, b, t in zip(*(own.column(c).to_pylist() for c in ("places", "n_best", "count_sum")), strict=True):
                    at = K.values(places, "u4")
                    n_best[at] += K.values(b, "i8")
                    total[at] += K.values(t, "i8")
                continue
            at, doc = own.column("place").to_numpy(), own.column("doc")
            sums = [doc.field(k) for k in range(doc.type.num_fields)]
            yield pa.RecordBatch.from_arrays([*sums[:5], pa.array(n_best[at]), pa.array(total[at]), sums[5]], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


class Alignment:
    """Links of docs(doc_id, text, ...) under two vocabularies: `documents()` by document, `best()` by A id.

    Null and empty texts, texts that are no UTF-8 and texts whose joined token bytes
    differ from a space and the text (the second model normalises or lacks something)
    have no tokens: zeros and an empty digest. Rows that repeat, also such without a
    doc_id, are documents of their own and each count. An empty table gives no rows;
    other columns are ignored. Vocabularies are read by the driver and broadcast, at
    most LARGEST bytes.
    """

    def __init__(self, docs: DataFrame, a: str = A_PATH, b: str = B_PATH, cut: bool = True):
        spark = docs.sparkSession
        files = Path(a).read_bytes(), Path(b).read_bytes()
        if sum(map(len, files)) > LARGEST:
            raise ValueError("vocabularies of over 64 MB are not broadcast")
        aligner = Aligner(*files, cut)
        self.nb, self.stripes = aligner.nb, -(-aligner.na // STRIPE)
        self.width = STRIPE * self.nb
        shared = spark.sparkContext.broadcast(files)
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
        self.table = keep(rows.mapInArrow(_links(shared, cut, self.stripes), LINKS), "links")
        self.slices = self.table.where("place = 0").count()
        salts = max(1, -(-self.slices // SALT))
        self.salts = salts
        self.links = self.table.where("stripe is not null").withColumn("salt", F.pmod(F.xxhash64("batch"), F.lit(salts)).cast("int"))
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        cells = self.links.select("stripe", "salt", "cells").mapInArrow(_distinct, COUNTS)
        sums = cells.repartitionById(tasks, F.pmod(F.col("stripe") + self.stripes * F.col("salt"), F.lit(tasks)).cast("int"))
        sums = sums.sortWithinPartitions("salt", "stripe").mapInArrow(_summed(self.width), COUNTS)
        if salts > 1:
            sums = sums.withColumn("salt", F.lit(0)).repartitionById(tasks, F.pmod("stripe", F.lit(tasks)).cast("int"))
            sums = sums.sortWithinPartitions("stripe").mapInArrow(_summed(self.width), COUNTS)
        self.counts, self.tasks = keep(sums, "counts"), tasks

    def documents(self) -> DataFrame:
        """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row."""
        per = -(-self.stripes // BANDS)
        blocks = self.counts.select("stripe", F.explode(F.sequence(F.lit(0), F.lit(self.salts - 1))).alias("salt"), "cells", "counts")
        rows = self.links.select("stripe", "salt", "batch", "rows", "places", "cells", "times").unionByName(blocks, allowMissingColumns=True)
        rows = rows.withColumn("band", F.floor(F.col("stripe") / per).cast("int"))
        rows = rows.repartitionById(self.tasks, F.pmod(F.col("band") + BANDS * F.col("salt"), F.lit(self.tasks)).cast("int"))
        sums = rows.sortWithinPartitions("band", "salt", "stripe", F.col("batch").asc_nulls_first()).mapInArrow(_scored(self.width, self.nb), "batch long, places binary, n_best binary, count_sum binary")
        docs = self.table.where("place is not null").select("batch", "rows", "doc", "place", F.lit(1).alias("kind"))
        size = docs.where("place = 0").select("batch", "rows")
        sums = sums.join(size, "batch").withColumn("kind", F.lit(0))
        both = docs.unionByName(sums, allowMissingColumns=True).repartition(self.tasks, "batch").sortWithinPartitions("batch", "kind")
        return both.mapInArrow(_joined, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")

    def best(self) -> DataFrame:
        """a_id, b_id, n_docs: for each A id that occurs, the B ids it is linked to in the most documents."""
        stripes, nb = self.stripes, self.nb

        def run(batches):
            for batch in batches:
                for stripe, cells, counts in zip(*(batch.column(c).to_pylist() for c in ("stripe", "cells", "counts")), strict=True):
                    cells, counts = K.values(cells, "u4").astype(np.int64), K.values(counts, "i8")
                    line, b = np.divmod(cells, nb)
                    if not len(cells):
                        continue
                    at = np.flatnonzero(np.diff(line, prepend=-1))
                    top = np.repeat(np.maximum.reduceat(counts, at), np.diff(np.append(at, len(line))))
                    on = counts == top
                    yield pa.RecordBatch.from_arrays([pa.array(line[on] * stripes + stripe), pa.array(b[on]), pa.array(counts[on])], names=["a_id", "b_id", "n_docs"])

        return self.counts.mapInArrow(run, "a_id long, b_id long, n_docs long")


def op11_token_align(spark, sf_dir: str) -> DataFrame:
    return Alignment(spark.read.parquet(f"{sf_dir}/documents.parquet")).documents()


def brute_force(rows: list[tuple[int | None, str | None]], a: str = A_PATH, b: str = B_PATH) -> list[tuple]:
    """The result of documents() from whole texts, pair by pair, for tests."""
    from collections import Counter

    import sentencepiece
    from tokenizers import Tokenizer

    ta, tb = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
    ta.encode_special_tokens = True
    of, held, counts = letters(), [], Counter()
    for doc, text in rows:
        groups, links = [], []
        if text:
            ia, ib = ta.encode(" " + text, add_special_tokens=False).ids, tb.encode(text)
            own = [bytes(of[c] for c in ta.id_to_token(i)) for i in ia]
            other = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace(MARK, " ").encode() for p in map(tb.id_to_piece, ib)]
            if b"".join(own) == b"".join(other) == (" " + text).encode():
                at_a, at_b = list(np.cumsum([len(x) for x in own])), list(np.cumsum([len(x) for x in other]))
                x = y = 0
                for end in sorted(set(at_a) & set(at_b)):
                    p, q = at_a.index(end, x) + 1, at_b.index(end, y) + 1
                    groups.append((ia[x:p], ib[y:q]))
                    links += [(i, j) for i in ia[x:p] for j in ib[y:q]]
                    x, y = p, q
            else:
                ia, ib = [], []
        else:
            ia, ib = [], []
        counts.update(set(links))
        held.append((doc, ia, ib, groups, links))
    top: dict[int, int] = {}
    for (i, _), n in counts.items():
        top[i] = max(top.get(i, 0), n)
    out = []
    for doc, ia, ib, groups, links in held:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc, len(ia), len(ib), len(groups), len(links), sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return out
