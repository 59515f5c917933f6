"""N-gram Jaccard join: prefix-tree (trie) join over globally ordered shingle sets.

Every document becomes its set of distinct shingle hashes in one global order,
rarest first. Two sets that reach the threshold share an element within the
first n - ceil(t * n) + 1 of each, so only these prefixes are shuffled.

1.  One pass counts shingles in a fixed-size table of hash counters (the order:
    any order is correct, the counters only make rare shingles come first) and
    takes each set's 128-bit fingerprint; equal sets are one class.
2.  Prefix entries (shingle, document) meet by shingle. An entry whose shingle
    nobody else has is dropped. The others link each document with the first
    one of its shingle: a star, linear in the entries.
3.  Stars are cut into blocks of bounded size. In each block a trie stores the
    ordered sets; every document walks it, sharing the partial overlap of
    common paths and leaving subtrees which cannot reach the threshold any more.
4.  Shingles whose documents are still in different components: their hubs'
    documents are cut into parts, and every two parts meet in a block where the
    trie looks for links between components; subtrees within the document's own
    component are left out. Components over all links are the result.
    Before texts move to a block, counts of shingles by hash class do: sets that
    differ in more counts than the threshold allows cannot link.

Links between documents that one component already holds are not looked for;
every link between different components is found, so components are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .stage import components, keep, rows_of

#: Hash counters for the global order: 2**20 of 8 bytes in a task, one byte each when broadcast.
COUNTER_BITS = 20
#: A block holds at most about so many documents and shingles.
BLOCK_DOCS, BLOCK_SHINGLES = 256, 1_000_000
#: The same for the parts that meet in the last round, two at a time.
PART_DOCS, PART_SHINGLES = 512, 1_500_000


def needed(n: np.ndarray | int, percent: int):
    """The least overlap that a set of n needs with any other: ceil(percent * n / 100)."""
    return (percent * n + 99) // 100


# ---- 1. sets, counters, fingerprints ------------------------------------------------------------


def doc_sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each row with words."""
    data, ends = K.buffers(batch.column("text"))
    for a, b in K.slices(ends):
        _, _, h, rows = K.words(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a])
        s, at = K.shingles(h, rows, width)
        for i in range(b - a):
            if at[i + 1] > at[i]:
                yield a + i, K.distinct(s[at[i] : at[i + 1]])


def _profile(width: int):
    def run(batches):
        counters = np.zeros(1 << COUNTER_BITS, np.int64)
        for batch in batches:
            size, f1, f2 = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for i, s in doc_sets(batch, width):
                size[i] = len(s)
                f1[i] = s.sum(dtype=np.uint64).view(np.int64)
                f2[i] = np.bitwise_xor.reduce(K.mix(s + np.uint64(0x5851F42D4C957F2D))).view(np.int64)
                np.add.at(counters, (s >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, -1)), batch.column("doc_id"), pa.array(size), pa.array(f1), pa.array(f2), pa.nulls(batch.num_rows, pa.binary())], names=["part", "doc_id", "n", "f1", "f2", "counts"])
        parts = np.split(counters.astype(np.int64), 64)
        used = [i for i, x in enumerate(parts) if x.any()]
        if used:
            none = pa.nulls(len(used), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.array(used, np.int64)), none, none, none, none, pa.array([parts[i].astype(np.int32).tobytes() for i in used], pa.binary())], names=["part", "doc_id", "n", "f1", "f2", "counts"])

    return run


def _level(counts: np.ndarray) -> np.ndarray:
    return np.minimum(127, 4 * np.log2(1 + counts.astype(np.float64))).astype(np.uint8)


def order_table(parts: DataFrame) -> np.ndarray:
    """One byte a counter, by summing the tasks' counters part by part; 2**COUNTER_BITS bytes reach the driver."""

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int32).astype(np.int64) for x in group.column("counts"))
        return pa.table({"part": group.column("part")[:1], "levels": pa.array([_level(total).tobytes()], pa.binary())})

    def halve(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int32).astype(np.int64) for x in group.column("counts"))
        return pa.table({"part": group.column("part")[:1], "counts": pa.array([np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()], pa.binary())})

    salted = parts.select("part", "counts", F.pmod(F.xxhash64("counts"), F.lit(16)).alias("salt"))
    first = salted.groupBy("part", "salt").applyInArrow(halve, "part long, counts binary")
    out = np.zeros((64, (1 << COUNTER_BITS) // 64), np.uint8)
    for row in first.groupBy("part").applyInArrow(add, "part long, levels binary").collect():
        out[row["part"]] = np.frombuffer(row["levels"], np.uint8)
    return out.ravel()


def ordered(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Elements as integers whose natural order is the global order: 7 bits of frequency, then 56 of the hash."""
    level = levels[(s >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)].astype(np.uint64)
    return np.sort((level << np.uint64(56)) | (s & np.uint64((1 << 56) - 1)))


# ---- 2. prefixes ---------------------------------------------------------------------------------


def _prefixes(width: int, percent: int, table):
    def run(batches):
        levels, seen = table.value, set()
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            known = np.array(batch.column("doc_id").is_valid())
            out: list[tuple[np.ndarray, int, int]] = []
            total = 0
            for i, s in doc_sets(batch, width):
                if not known[i]:
                    continue
                key = (int(s.sum(dtype=np.uint64)), len(s), int(s[0]), int(s[-1]), int(np.bitwise_xor.reduce(K.mix(s))))
                if key in seen:  # an equal set of this task has gone before
                    continue
                if len(seen) < 2_000_000:  # a bound on memory; a set sent twice does no harm
                    seen.add(key)
                s = ordered(s, levels)
                p = s[: len(s) - needed(len(s), percent) + 1]
                out.append((p, int(ids[i]), len(s)))
                total += len(p)
                if total > 500_000:
                    yield _entries(out)
                    out, total = [], 0
            if out:
                yield _entries(out)

    return run


def _entries(out: list[tuple[np.ndarray, int, int]]) -> pa.RecordBatch:
    n = [len(p) for p, _, _ in out]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([p for p, _, _ in out]).view(np.int64)),
            pa.array(np.repeat(np.array([d for _, d, _ in out], np.int64), n)),
            pa.array(np.repeat(np.array([s for _, _, s in out], np.int32), n)),
        ],
        names=["h", "d", "n"],
    )


# ---- 3. the trie ---------------------------------------------------------------------------------


class Trie:
    """A path-compressed trie over sets whose elements are ordered numbers, and their threshold join.

    sets: sorted arrays of numbers below `universe`; sizes: the sets' full sizes
    (elements that no other set of the block has may be left out of the arrays);
    known: components found before; held: the sets in the trie, all if None.
    """

    def __init__(self, sets: list[np.ndarray], sizes: list[int], universe: int, known: list[int] | None = None, held: list[int] | None = None):
        self.sets, self.sizes, self.universe, self.known = sets, sizes, universe, known
        self.edge: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.kids: list[list[int]] = [[]]
        self.ends: list[list[int]] = [[]]
        self.depth = [0]
        path = [0]  # the nodes from the root to the last set
        order = sorted(range(len(sets)) if held is None else held, key=lambda i: sets[i].astype(">u4").tobytes())
        last = np.zeros(0, np.int64)
        for i in order:
            s = sets[i]
            m = min(len(s), len(last))
            differ = np.flatnonzero(s[:m] != last[:m])
            common = int(differ[0]) if len(differ) else m
            child = -1
            while self.depth[path[-1]] > common:
                child = path.pop()
            node = path[-1]
            if self.depth[node] < common:  # cut the edge to child
                mid = self._node(self.edge[child][: common - self.depth[node]], common)
                self.edge[child] = self.edge[child][common - self.depth[node] :]
                self.kids[node][-1] = mid
                self.kids[mid].append(child)
                path.append(node := mid)
            if len(s) > common:
                leaf = self._node(s[common:], len(s))
                self.kids[node].append(leaf)
                path.append(node := leaf)
            self.ends[node].append(i)
            last = s
        count = len(self.edge)
        self.deepest, self.least, self.most = list(self.depth), [1 << 60] * count, [0] * count
        self.under: list[set[int]] = [set() for _ in range(count)]  # up to two of the known components below
        for node in self._postorder():
            for i in self.ends[node]:
                self.least[node], self.most[node] = min(self.least[node], sizes[i]), max(self.most[node], sizes[i])
                if known and len(self.under[node]) < 2:
                    self.under[node].add(known[i])
            for c in self.kids[node]:
                self.deepest[node] = max(self.deepest[node], self.deepest[c])
                self.least[node], self.most[node] = min(self.least[node], self.least[c]), max(self.most[node], self.most[c])
                if len(self.under[node]) < 2:
                    self.under[node] |= self.under[c]

    def _node(self, edge: np.ndarray, depth: int) -> int:
        self.edge.append(edge), self.kids.append([]), self.ends.append([]), self.depth.append(depth)
        return len(self.edge) - 1

    def _postorder(self) -> list[int]:
        out, todo = [], [0]
        while todo:
            out.append(node := todo.pop())
            todo += self.kids[node]
        return out[::-1]

    def probe(self, i: int, percent: int) -> Iterator[int]:
        """The other sets j with 100 * overlap >= percent * union."""
        mark = np.zeros(self.universe, bool)
        mark[self.sets[i]] = True
        own, size = len(self.sets[i]), self.sizes[i]
        todo, mine = [(0, 0)], {self.known[i]} if self.known else None
        while todo:
            node, overlap = todo.pop()
            if self.under[node] == mine:
                continue
            if 100 * self.most[node] < percent * size or percent * self.least[node] > 100 * size:
                continue
            least = max(self.least[node], needed(size, percent))
            # the least overlap with a set of that size, and what this path can still add
            want = -(-percent * (size + least) // (100 + percent))
            if overlap + min(own - overlap, self.deepest[node] - self.depth[node] + len(self.edge[node])) < want:
                continue
            if len(self.edge[node]):
                overlap += int(np.count_nonzero(mark[self.edge[node]]))
                if overlap + min(own - overlap, self.deepest[node] - self.depth[node]) < want:
                    continue
            for j in self.ends[node]:
                if j != i and 100 * overlap >= percent * (size + self.sizes[j] - overlap):
                    yield j
            todo += [(c, overlap) for c in self.kids[node]]


def link_block(ids: np.ndarray, sets: list[np.ndarray], percent: int, walks: list[tuple[list[int], list[int] | None]], known: list[int] | None = None) -> list[tuple[int, int]]:
    """Links between the sets of a block: (id, smallest id of its component in the block).

    walks: sets that walk a trie, in this order, and the sets it holds (None: all), until everything is connected.
    known: components found before; sets that share one need no link.
    """
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    new = np.concatenate([[True], every[order][1:] != every[order][:-1]])
    number = np.cumsum(new) - 1
    count = np.bincount(number)
    rank = np.empty(len(count), np.int64)  # frequent elements first: paths are shared
    rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
    flat = np.empty(len(every), np.int64)
    flat[order] = np.where(count[number] > 1, rank[number], -1)
    cut, at = [], 0
    for s in sets:
        x = flat[at : at + len(s)]
        cut.append(np.sort(x[x >= 0]))
        at += len(s)
    up, first = list(range(len(sets))), {}

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for i, c in enumerate(known or []):
        up[i] = first.setdefault(c, i)
    before = [root(i) for i in range(len(sets))]
    left = len(set(before)) - 1
    for probes, held in walks:
        trie = Trie(cut, [len(s) for s in sets], max(1, int((count > 1).sum())), known, held)
        for i in probes:
            if not left:
                break
            for j in trie.probe(i, percent):
                a, b = root(i), root(j)
                if a != b:
                    up[max(a, b)] = min(a, b)
                    left -= 1
    low: dict[int, int] = {}
    for i in range(len(sets)):
        low[root(i)] = min(low.get(root(i), 1 << 62), int(ids[i]))
    return [(int(ids[i]), low[root(i)]) for i in range(len(sets)) if int(ids[i]) != low[root(i)] and (known is None or root(i) != before[i])]


LINKS = "a long, b long"


def _sets(block: pa.Table, width: int) -> tuple[list[int], list[np.ndarray]]:
    rows, sets, at = [], [], 0
    for batch in block.combine_chunks().to_batches():
        for i, s in doc_sets(batch, width):
            rows.append(at + i), sets.append(s)
        at += batch.num_rows
    return rows, sets


def _links(found: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def star_blocks(stars: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Verified links of stars(hub, d, n): each hub's documents in blocks of bounded size, the hub in each."""
    load = stars.groupBy("hub").agg(F.count("*").alias("docs"), F.sum("n").alias("load"))
    load = load.select("hub", F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("load") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    cut = stars.join(load, "hub").select("hub", "d", F.pmod(F.xxhash64("d"), "blocks").cast("int").alias("block"))
    hubs = load.select("hub", F.col("hub").alias("d"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    rows = cut.unionByName(hubs).join(docs.select(F.col("doc_id").alias("d"), "text"), "d").select("hub", "block", "d", "text")

    def run(block: pa.Table) -> pa.Table:
        rows, sets = _sets(block, width)
        if len(sets) < 2:
            return _links([])
        ids, hub = block.column("d").to_numpy()[rows], block.column("hub")[0].as_py()
        return _links(link_block(ids, sets, percent, [(sorted(range(len(sets)), key=lambda i: ids[i] != hub), None)]))

    return rows.groupBy("hub", "block").applyInArrow(run, LINKS)


def part_pairs(members: DataFrame, payload: DataFrame, percent: int) -> DataFrame:
    """Rows of members(hub, d, n, c) with payload(d, ...) for blocks (hub, band, lo, hi) in which every two documents
    of a hub meet that sizes allow: its documents are cut into parts of bounded size, and every two parts meet.

    Sizes are banded so that linked sets are in one band or neighbours: a band's documents (`own`) meet those of
    their band and the one below. Bands without a second component need no block. No pair is written out.
    """
    band = F.floor(F.log("n") / F.lit(float(np.log(100 / percent)) if percent < 100 else 1e-9)).cast("long")
    banded = members.withColumn("own_band", band).withColumn("band", F.explode(F.array("own_band", F.col("own_band") + 1))).withColumn("own", F.col("own_band") == F.col("band"))
    load = banded.groupBy("hub", "band").agg(F.count("*").alias("docs"), F.sum("n").alias("load"), F.min("c").alias("x"), F.max("c").alias("y"), F.max("own").alias("any")).where("x <> y and any")
    load = load.select("hub", "band", F.greatest(F.ceil(F.col("docs") / PART_DOCS), F.ceil(F.col("load") / PART_SHINGLES)).cast("int").alias("parts"))
    cut = banded.join(load, ["hub", "band"]).select("hub", "band", "own", "d", "n", "c", F.pmod(F.xxhash64("d"), "parts").cast("int").alias("part"), "parts")
    cut = cut.join(payload, "d").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return cut.withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other")).drop("parts", "other")


def pair_blocks(members: DataFrame, vectors: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Verified links between the components of members(hub, d, n, c): first count vectors meet, and the texts of
    those documents only that have a possible partner; these walk tries as in the first round."""
    near = part_pairs(members, vectors, percent).groupBy("hub", "band", "lo", "hi").applyInArrow(_near_members(percent), "hub long, d long").distinct()
    members = keep(members.join(near, ["hub", "d"], "left_semi"), "near")
    rows = part_pairs(members, rows_of(docs, members.select("d")).select(F.col("doc_id").alias("d"), "text"), percent)

    def run(block: pa.Table) -> pa.Table:
        rows, sets = _sets(block, width)
        if len(sets) < 2:
            return _links([])
        ids, known = block.column("d").to_numpy()[rows], block.column("c").to_numpy()[rows].tolist()
        own = block.column("own").to_numpy(zero_copy_only=False)[rows]
        lo, hi, part = (block.column(x).to_numpy()[rows] for x in ("lo", "hi", "part"))
        low = part == lo
        walks = [(own, None)] if lo[0] == hi[0] else [(own & low, ~low), (own & ~low, low & ~own)]
        walks = [(np.flatnonzero(a).tolist(), b if b is None else np.flatnonzero(b).tolist()) for a, b in walks]
        return _links(link_block(ids, sets, percent, [(a, b) for a, b in walks if a and b != []], known))

    return rows.groupBy("hub", "band", "lo", "hi").applyInArrow(run, LINKS)


# ---- count vectors: an exact filter before texts are moved ---------------------------------------


def _vectors(width: int):
    """Of each text how many of its shingles are in each of max(64, n / 4) hash classes (255 at most)."""

    def run(batches):
        for batch in batches:
            out = [b""] * batch.num_rows
            for i, s in doc_sets(batch, width):
                classes = max(64, 1 << (max(1, len(s) // 4) - 1).bit_length())
                count = np.bincount((s & np.uint64(classes - 1)).astype(np.int64), minlength=classes)
                out[i] = np.minimum(count, 255).astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["d", "vec"])

    return run


def _fold(v: bytes, classes: int) -> np.ndarray:
    return np.frombuffer(v, np.uint8).reshape(-1, classes).sum(axis=0, dtype=np.int32)


def _near(n, m, apart, percent: int):
    """False where sets of n and m, apart in so many counts at least, cannot reach the threshold."""
    return ((100 + percent) * apart <= (100 - percent) * (n + m)) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))


def _near_stars(percent: int):
    def run(batches):
        for batch in batches:
            n, m = (batch.column(x).to_numpy().astype(np.int64) for x in ("n", "hub_n"))
            apart = np.zeros(batch.num_rows, np.int64)
            for i, (a, b) in enumerate(zip(batch.column("vec"), batch.column("hub_vec"), strict=True)):
                a, b = a.as_py(), b.as_py()
                classes = min(len(a), len(b))
                apart[i] = np.abs(_fold(a, classes) - _fold(b, classes)).sum() if classes else 0
            yield batch.select(["hub", "d", "n"]).filter(pa.array(_near(n, m, apart, percent)))

    return run


def _near_members(percent: int):
    """Of a block's documents those with a partner in another component that counts allow."""

    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        n, c, d = (block.column(x).to_numpy().astype(np.int64) for x in ("n", "c", "d"))
        own = block.column("own").to_numpy(zero_copy_only=False)
        vec = [v.as_py() for v in block.column("vec")]
        on = np.zeros(len(n), bool)
        if len(n) > 1:
            classes = min(map(len, vec))
            if classes:
                x = np.array([_fold(v, classes) for v in vec])
                for i in np.flatnonzero(own):
                    good = _near(n, n[i], np.abs(x - x[i]).sum(axis=1), percent) & (c != c[i])
                    if good.any():
                        on |= good
                        on[i] = True
            else:
                on[:] = True
        k = np.flatnonzero(on)
        return pa.table({"hub": block.column("hub").take(pa.array(k)), "d": pa.array(d[k])})

    return run


# ---- the operator --------------------------------------------------------------------------------


def near_duplicate_groups(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs(doc_id, text, ...).

    Two documents link when 100 * |A & B| >= percent * |A | B| over their sets of
    distinct word shingles; component_id is the smallest doc_id that links reach.
    Null, empty and wordless texts have an empty set, which links with nothing.
    Fewer words than `width` make one shingle of all. Rows that share a doc_id
    are one node; a null doc_id takes no part and its component_id is null.
    Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profile = keep(docs.mapInArrow(_profile(width), "part long, doc_id long, n long, f1 long, f2 long, counts binary"), "profile")
    own = profile.where("part < 0").select("doc_id", "n", "f1", "f2")
    table = spark.sparkContext.broadcast(order_table(profile.where("part >= 0").select("part", "counts")))

    firsts = own.where("n > 0 and doc_id is not null").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    shared = keep(firsts.where("first < last").drop("last"), "shared")
    twice = own.where("n > 0").groupBy("doc_id").agg(F.min("f1").alias("x"), F.max("f1").alias("y")).where("x <> y").select("doc_id")
    copies = keep(own.join(shared, ["f1", "f2", "n"]).where("doc_id <> first").select(F.col("doc_id").alias("d"), "first").distinct(), "copies")

    # a shingle's least and greatest document are combined before the shuffle; the join with those of several can be split
    entries = keep(docs.mapInArrow(_prefixes(width, percent, table), "h long, d long, n int"), "entries")
    several = entries.groupBy("h").agg(F.min("d").alias("x"), F.max("d").alias("y")).where("x <> y").select("h")
    met = entries.join(keep(several, "several"), "h")
    met = met.join(copies, "d", "left").select("h", F.coalesce("first", "d").alias("d"), "n").distinct()
    met = keep(met, "met")
    vectors = keep(rows_of(docs, met.select("d"), _vectors(width), "d long, vec binary"), "vectors")
    # a text that copies were made from shares most of its prefix, a copy has edits of its own there: the fullest is the hub
    share = met.groupBy("d").agg((F.count("*") / (F.max("n") - F.expr(f"floor(({percent} * max(n) + 99) / 100)") + 1)).alias("share"))
    full = met.join(share, "d")
    low = full.groupBy("h").agg(F.max(F.struct("share", -F.col("d"), "n")).alias("low")).select("h", (-F.col("low.col2")).alias("hub"), F.col("low.n").alias("hub_n"))
    low = keep(low, "hubs")
    near = f"100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)"
    stars = met.join(low, "h").where("d <> hub").where(near).groupBy("hub", "d").agg(F.max("n").alias("n"), F.max("hub_n").alias("hub_n"))
    stars = stars.join(vectors, "d").join(vectors.select(F.col("d").alias("hub"), F.col("vec").alias("hub_vec")), "hub")
    stars = keep(stars.mapInArrow(_near_stars(percent), "hub long, d long, n int"), "stars")
    texts = rows_of(docs, stars.select("d").unionByName(stars.select(F.col("hub").alias("d"))))
    links = keep(star_blocks(stars, texts, width, percent).unionByName(copies.join(twice, copies.d == twice.doc_id, "left_semi").select(F.col("d").alias("a"), F.col("first").alias("b"))), "links")

    labels = components(links)
    named = met.join(labels.withColumnRenamed("id", "d"), "d", "left").select("h", "d", "n", F.coalesce("component", "d").alias("c"))
    open_ = named.groupBy("h").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("h")
    hubs = named.join(open_, "h", "left_semi").join(low.select("h", "hub"), "h")
    rest = keep(hubs.groupBy("hub", "d", "c").agg(F.max("n").alias("n")), "rest")
    more = keep(pair_blocks(rest, vectors, docs, width, percent), "links")
    labels = keep(components(links.unionByName(more)), "labels") if not more.isEmpty() else labels
    labels = labels.withColumnRenamed("id", "rep")
    reps = copies.groupBy("d").agg(F.min("first").alias("first"))
    out = own.join(reps, own.doc_id == reps.d, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("first", "doc_id").alias("rep"))
    return out.join(labels, "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))


def first_of_groups(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """The rows of docs that are the first (smallest doc_id) of their group; rows without a doc_id stay."""
    groups = near_duplicate_groups(docs, width, percent).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone"))
    return docs.join(groups, docs["doc_id"] == groups["__gone"], "left_anti")


# ---- the query -----------------------------------------------------------------------------------


def op7_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def brute_force(rows: list[tuple[int, str | None]], width: int = 5, percent: int = 75) -> pd.DataFrame:
    """The same result from all pairs, for tests."""
    import re

    sets = {}
    for d, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        ws = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[d] = {tuple(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))} if ws else set()
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return pd.DataFrame([(d, len(sets[d]), root(d)) for d, _ in rows], columns=["doc_id", "n_shingles", "component_id"])
