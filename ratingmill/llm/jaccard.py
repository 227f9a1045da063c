"""N-gram Jaccard join: which documents share almost all of their word shingles.

1. Every document becomes the set of its shingles' 64-bit names; equal sets are one *node*.
2. Shingle names fall into groups (ranges of the hash). Two sets that link differ in a limited
   number of shingles, so all groups but so many hold the same in both: each set sends one
   row for each of its largest groups, one more than may differ, keyed by what the group holds, and sets
   that meet under no key cannot link. Rows grow with the text, never with the square of anything.
3. Keys under which the same sets meet count once. The sets of each such meeting are put into
   a count-vector R-tree: points are numbers of shingles in groups (about ``A_GROUP`` shingles each, so that
   larger sets have more coordinates), and a box's summed coordinate minima with the query
   bound the overlap from above. Only sets stay together that bounds that reach the threshold
   connect; so a shared passage alone doesn't join documents. A key with more than ``MOST``
   sets keeps them all together.
4. Sets that stay together, directly or through others, form a block, dealt to chunks of a
   bounded size. In a chunk the R-tree finds each set's possible partners, and the surviving
   pairs are verified on the sets themselves, but for pairs that are connected already.
   verified() tells how the chunks of one block are compared.
5. Links are joined into components; the smallest ``doc_id`` names each.

Shingles that a bounded sample of documents shows to be common are left out of the keys of sets
that keep enough others. Leaving out a fixed list of shingles never adds differences, so that
changes how many sets meet, not which links are found.

Results: null or wordless texts have an empty set and link with nothing; their component is
their own ``doc_id``. Repeated rows each keep their row. A null ``doc_id`` links like any other and
never names a component, unless nothing else does. Ties need no rule: results are sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratingmill.llm.base import drop, in_arrow, settle, small
from ratingmill.llm.text import SPACED, mix, runs, whole, words

#: Documents in the sample that shows common shingles, and in how many of them these occur.
SAMPLE_DOCS = 2000
COMMON_IN = 4
COMMON_MOST = 200_000
#: Shingles of the sets that one chunk of a block holds.
CHUNK = 1 << 20
#: Shingles that a group of a count vector holds on average, and least and most bits that name groups.
A_GROUP = 4
BITS = (3, 13)
#: Sets of a key whose bounds are looked at; more are kept together.
MOST = 8192
#: Sets that a task remembers, so that their exact copies send no keys.
SEEN = 1_000_000
#: Candidate ids up to which their table is broadcast.
BROADCAST_ROWS = 1_000_000
LEAF = 32
FAN = 8
#: Share of uncommon shingles from which a set is keyed by them, at both of its members.
UNCOMMON = 0.6


def sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct names of its shingles."""
    for w in words(column, SPACED):
        long = runs(w.hash, width)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(long[a : b - width + 1])
            else:
                yield whole(w.hash[a:b]) if b > a else np.zeros(0, np.uint64)


def name(names: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(names.tobytes(), len(names)) - (1 << 63)


@lru_cache(None)
def bands(percent: int) -> np.ndarray:
    """Sizes at which bands begin. Sets that link are of one band or of adjoining ones."""
    at = [1]
    while at[-1] < 1 << 40:
        at.append(at[-1] * 100 // percent + 1)
    return np.array(at)


@lru_cache(None)
def cuts(band: int, percent: int) -> tuple[np.ndarray, int]:
    """Where groups begin, for pairs whose smaller set is of ``band``; and in how many groups two
    sets that link may differ, at most.

    All groups but those are the same in both. The more groups, the more of the smallest ones need
    no key, but the smaller is the average; there are as many as leave out those of a
    shingle or none."""
    small_ = int(bands(percent)[band + 1]) - 1
    differ = (small_ + small_ * 100 // percent) * (100 - percent) // (100 + percent)
    n = differ + 3
    while n < 2 * differ:
        mean = 0.92 * small_ / n
        if n * math.exp(-mean) * (1 + mean) <= n - differ - 1:
            break
        n += max(1, differ // 50)
    return np.array([(k << 64) // n for k in range(1, n)], np.uint64), differ


def keys(names: np.ndarray, size: int, percent: int, family: int) -> list[np.ndarray]:
    """Keys of a set of ``size`` shingles, of which ``names`` are used: for each band, those of the
    largest groups, one more than may differ. Two sets that link have all groups but these in
    common, and order groups alike, so that one of those that they have in common has a key in both."""
    band = int(np.searchsorted(bands(percent), size, "right")) - 1
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(names))])
    out = [np.zeros(0, np.uint64)]
    for b in (band, band - 1) if band else (band,):
        edges, differ = cuts(b, percent)
        if not differ:  # only equal sets link
            continue
        at = np.concatenate([[0], np.searchsorted(names, edges), [len(names)]])
        held = np.diff(at)
        key = total[at[1:]] - total[at[:-1]] + held.astype(np.uint64)
        key = mix(key + np.arange(len(held), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(b << 8 | family))
        out.append(key[np.lexsort((key, -held))[: differ + 1]])
    return out


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for the nodes of the ``edges`` (``a``, ``b``): labels are the smallest
    node that can be reached. Every round links each node's larger neighbours, then its
    smaller ones, to the smallest; rounds follow the logarithm of the longest path."""
    edges = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = edges.union(edges.select("b", "a")).toDF("a", "b")
        # the smallest neighbour by partial sums, so that a node with very many of them is no single task's
        least = both.groupBy("a").agg(F.min("b").alias("least"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "least").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        new = lower.select("a", F.col("m").alias("b")).union(large.join(lower, "a").where("b <> m").select("b", "m"))
        before, edges = edges, settle(new.where("a <> b").distinct())
        drop(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select("b", "b").distinct())


class CountTree:
    """R-tree over count vectors; search() gives all points whose overlap with a query can
    reach the threshold."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, percent: int):
        self.counts, self.sizes, self.percent = counts, sizes, percent
        self.root = self.build(np.arange(len(sizes)))

    def build(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        own = self.counts[rows]
        order = np.lexsort((own[:, np.argmax(own.max(0) - own.min(0))], self.sizes[rows])) if np.ptp(self.sizes[rows]) * 8 > self.sizes[rows].max() else np.argsort(own[:, np.argmax(own.max(0) - own.min(0))], kind="stable")
        parts = np.array_split(rows[order], min(FAN, -(-len(rows) // LEAF)))
        box = np.stack([self.counts[p].max(0) for p in parts])
        low, high = (np.array([f(self.sizes[p]) for p in parts]) for f in (np.min, np.max))
        return box, low, high, [self.build(p) for p in parts]

    def may(self, box: np.ndarray, low: np.ndarray, high: np.ndarray, query: np.ndarray, size: int):
        """Which boxes may hold a partner, and the bounds of the overlap."""
        bound = np.minimum(box, query).sum(1, dtype=np.int64)
        p = self.percent
        return (bound * (100 + p) >= p * (size + low)) & (100 * high >= p * size) & (p * low <= 100 * size), bound

    def search(self, query: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        found, bounds, stack = [], [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                box, low, high, kids = node
                fits, _ = self.may(box, low, high, query, size)
                stack += [kids[k] for k in np.flatnonzero(fits)]
            else:
                n = self.sizes[node]
                fits, bound = self.may(self.counts[node], n, n, query, size)
                found.append(node[fits])
                bounds.append(bound[fits])
        return np.concatenate(found), np.concatenate(bounds)


def point(names: np.ndarray) -> bytes:
    """A set's count vector: numbers of its shingles in groups by the leading bits of their names,
    about ``A_GROUP`` in each. The first byte is the logarithm of the groups, the second that of
    a count's unit; counts are rounded up, so that bounds hold."""
    bits = int(np.clip(math.ceil(math.log2(max(1, len(names) / A_GROUP))), *BITS))
    counts = np.bincount((names >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    unit = max(0, int(counts.max()).bit_length() - 8)
    if -(-int(counts.max()) >> unit) > 255:
        unit += 1
    return bytes([bits, unit]) + (-(-counts >> unit)).astype(np.uint8).tobytes()


def vectors(points: list[bytes]) -> np.ndarray:
    """Points as rows of one matrix, in as many groups as the coarsest has."""
    bits = min(p[0] for p in points)
    rows = [(np.frombuffer(p, np.uint8, offset=2).astype(np.int32) << p[1]).reshape(1 << bits, -1).sum(1) for p in points]
    return np.stack(rows).astype(np.int32)


def together(counts: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """For each set the number of the first one that bounds connect it with."""
    label = np.arange(len(sizes))
    if len(sizes) <= LEAF:  # one leaf: all its bounds at once
        bound = np.minimum(counts[:, None], counts[None]).sum(2)
        low, high = np.minimum.outer(sizes, sizes), np.maximum.outer(sizes, sizes)
        fits = (bound * (100 + percent) >= percent * (low + high)) & (percent * high <= 100 * low)
        search = lambda x: np.flatnonzero(fits[x])
    else:
        tree = CountTree(counts, sizes, percent)
        search = lambda x: tree.search(counts[x], int(sizes[x]))[0]
    for x in range(len(sizes) - 1):
        if not label.any():
            break
        near = search(x)
        met = label[near[near > x]]
        if len(met) and (met != label[x]).any():
            met = np.append(np.unique(met), label[x])
            label[np.isin(label, met)] = met.min()
    return label


def links(members: list[np.ndarray], percent: int, asks: np.ndarray | None = None, label: np.ndarray | None = None) -> np.ndarray:
    """For each set of a block the number of the first set that links connect it with, by the
    count-vector tree and a comparison of the pairs it leaves. With ``asks``, those sets are compared
    with the others only; ``label`` has what is connected already."""
    sizes = np.array([len(m) for m in members])
    counts = vectors([point(m) for m in members])
    label = np.arange(len(members)) if label is None else label
    held = np.arange(len(members)) if asks is None else np.flatnonzero(~asks)
    tree = CountTree(counts[held], sizes[held], percent)
    for x in range(len(members)) if asks is None else np.flatnonzero(asks).tolist():
        if (label == label[0]).all():
            break
        near, bound = tree.search(counts[x], int(sizes[x]))
        near = held[near]
        fits = label[near] != label[x]
        if asks is None:
            fits &= near > x
        near = near[fits][np.argsort(-bound[fits], kind="stable")]
        while len(near):
            y, near = near[0], near[1:]
            shared = len(np.intersect1d(members[x], members[y], assume_unique=True))
            if 100 * shared >= percent * (sizes[x] + sizes[y] - shared):
                a, b = sorted((label[x], label[y]))
                label[label == b] = a
                near = near[label[near] != a]
    return label


def _profiles(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, node, counts = [], [], []
            for s in sets(batch.column(0), width):
                size.append(len(s))
                node.append(name(s) if len(s) else None)
                counts.append(point(s) if len(s) else None)
            new = [pa.array(size, pa.int64()), pa.array(node, pa.int64()), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *new], [*batch.schema.names[1:], "n_shingles", "node", "point"])

    return run


def _shingles(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in sets(batch.column(0), width):
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], ["shingle"])

    return run


def _signatures(width: int, percent: int, common):
    differ = (100 - percent) / percent
    least = (UNCOMMON - differ) / (1 + differ) - 0.01

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = common.value
        seen: set[int] = set()
        for batch in batches:
            out, of, held = [], [], 0
            for s in sets(batch.column(0), width):
                if not len(s) or (own := name(s)) in seen:  # an exact copy
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(own)
                rare = s[known[np.minimum(np.searchsorted(known, s), len(known) - 1)] != s] if len(known) else s
                share = len(rare) / len(s)
                made = keys(rare, len(s), percent, 1) if share >= least else []
                if share < UNCOMMON:
                    made += keys(s, len(s), percent, 0)
                out += made
                of.append((own, n := sum(map(len, made))))
                held += n
                if held > 200_000:
                    yield _rows(out, of)
                    out, of, held = [], [], 0
            if of:
                yield _rows(out, of)

    return run


def _rows(keys_: list[np.ndarray], of: list[tuple[int, int]]) -> pa.RecordBatch:
    nodes, n = (np.array(x, np.int64) for x in zip(*of, strict=True))
    # 48 bits: keys that agree by chance cost a bound, and the shuffle is smaller
    made = (np.concatenate(keys_) >> np.uint64(16)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(made), pa.array(np.repeat(nodes, n))], ["key", "node"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``key, node`` sorted by both; the sets that meet under a key out. They are ``node``s with one
    ``meeting``, named by all of them, so that the same sets meet once; and where they are
    more than ``MOST``, edges from each to the first, the ``head``."""

    def out(meeting, node, head) -> pa.RecordBatch:
        none = pa.nulls(len(node), pa.int64())
        return pa.RecordBatch.from_arrays([none if meeting is None else pa.array(meeting), pa.array(node), none if head is None else pa.array(head)], ["meeting", "node", "head"])

    def runs_of(key: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        """All sets of some keys."""
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        many = np.diff(start, append=len(key))
        named = np.add.reduceat(mix(node.view(np.uint64)), start).view(np.int64)
        on = np.repeat((many > 1) & (many <= MOST), many)
        yield out(np.repeat(named, many)[on], node[on], None)
        on = np.repeat(many > MOST, many)
        if on.any():
            yield out(None, node[on], np.repeat(node[start], many)[on])

    key, node, head = np.zeros(0, np.int64), np.zeros(0, np.int64), None  # rows of a key that may go on
    for batch in batches:
        key, node = (np.append(a, c) for a, c in zip((key, node), batch.columns, strict=True))
        if not len(key):
            continue
        fresh = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
        key, node = key[fresh], node[fresh]
        end = int(np.searchsorted(key, head[0], "right")) if head else 0
        if end:  # more of a very common key
            yield out(None, node[:end], np.full(end, head[1]))
        last = max(end, int(np.searchsorted(key, key[-1])))
        if last > end:
            yield from runs_of(key[end:last], node[end:last])
        key, node = key[last:], node[last:]
        if len(key) > MOST:
            head = key[0], node[0]
            yield out(None, node, np.full(len(node), head[1]))
            key, node = key[:0], node[:0]
    if len(key):
        yield from runs_of(key, node)


def _bounded(percent: int):
    """Rows ``meeting, node, n, point`` sorted by the first and n; edges of what stays together out."""

    def solve(nodes: list[int], sizes: list[int], points: list[bytes]) -> Iterator[tuple[int, int]]:
        n = np.array(sizes)
        if len(n) == 2:
            if percent * n.max() > 100 * n.min():
                return
            counts = vectors(points)
            if np.minimum(counts[0], counts[1]).sum() * (100 + percent) >= percent * n.sum():
                yield nodes[1], nodes[0]
            return
        for x, first in enumerate(together(vectors(points), n, percent).tolist()):
            if x != first:
                yield nodes[x], nodes[first]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int]] = set()
        held, of = ([], [], []), None
        for batch in batches:
            for meeting, node, n, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if meeting != of:
                    if len(held[0]) > 1:
                        found.update(solve(*held))
                    held, of = ([], [], []), meeting
                for values, v in zip(held, (node, n, counts), strict=True):
                    values.append(v)
            if len(found) > 20_000:
                yield _edges(found)
                found = set()
        if len(held[0]) > 1:
            found.update(solve(*held))
        yield _edges(found)

    return run


def _edges(found: set[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])


def _placed(width: int):
    """Rows ``text, node, label, chunk, large``; the set beside the others out, one row for each node
    of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            names = batch.column(1).to_pylist()
            picked, made, held = [], [], 0
            for k, s in enumerate(sets(batch.column(0), width)):
                if len(s) and names[k] not in sent and name(s) == names[k]:
                    sent.add(names[k])
                    picked.append(k)
                    made.append(s.tobytes())
                    held += len(s)
                if held > 500_000 or k == batch.num_rows - 1:
                    part = batch.take(pa.array(picked, pa.int64()))
                    yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(made, pa.binary())], ["node", "label", "chunk", "large", "set"])
                    picked, made, held = [], [], 0

    return run


def _blocks(percent: int):
    """Rows ``label, chunk, node, large, set`` sorted by the first three; each node with the first one that links
    connect it with in its chunk (``rep``). Only of large labels are the nodes without links
    given, and the sets."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        rows = list({r[2]: r for r in rows}.values())
        label = links([np.frombuffer(r[4], np.uint64) for r in rows], percent).tolist()
        kept = [k for k, r in enumerate(rows) if r[3] or label[k] != k]
        values = [[rows[k][0] for k in kept], [rows[k][1] for k in kept], [rows[k][2] for k in kept], [rows[label[k]][2] for k in kept]]
        held = pa.array([rows[k][4] if rows[k][3] else None for k in kept], pa.binary())
        return pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in values), held], ["label", "chunk", "node", "rep", "set"])

    return _by_block(solve, 2, lambda rows: len(rows) > 1 or rows[0][3])


def _strays(percent: int):
    """Rows ``label, chunk, piece, stray, node, comp, set`` sorted by the first three: strays are compared
    with the chunk's sets; edges out."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        asks = np.array([r[3] for r in rows])
        _, first, back = np.unique(np.array([r[5] for r in rows]), return_index=True, return_inverse=True)
        before = first[back]
        after = links([np.frombuffer(r[6], np.uint64) for r in rows], percent, asks, before.copy())
        return _edges({(rows[k][4], rows[after[k]][4]) for k in np.flatnonzero(after != before).tolist()})

    return _by_block(solve, 3, lambda rows: len({r[3] for r in rows}) > 1)


def _by_block(solve, width: int, worth):
    """Runs ``solve`` over the rows of each block, named by the first ``width`` columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:width] != of:
                    if held and worth(held):
                        yield solve(held)
                    held, of = [], row[:width]
                held.append(row)
        if held and worth(held):
            yield solve(held)

    return run


def common_shingles(docs: DataFrame, width: int) -> np.ndarray:
    """Sorted names of shingles that many documents of a bounded sample hold."""
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    picked = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    counts = in_arrow(picked.select("text"), _shingles(width), "shingle long").groupBy("shingle").count()
    rows = counts.where(F.col("count") >= COMMON_IN).orderBy(F.desc("count"), "shingle").select("shingle").limit(COMMON_MOST).collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def placed(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """``nodes`` with their ``set``. A node's text is that of one row, which is found by its id and the hash of its
    text, so that ids that repeat or are null bring no other rows; of equal rows each task sends one."""
    same = F.col("doc_id").eqNullSafe(F.col("row.doc_id")) & (F.col("mark") == F.col("row.mark"))
    texts = docs.join(small(nodes, BROADCAST_ROWS), same)
    return in_arrow(texts.select("text", "node", "label", "chunk", "large"), _placed(width), "node long, label long, chunk long, large boolean, set binary")


def verified(docs: DataFrame, meet: DataFrame, sized: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges (``a``, ``b``) that connect what links connect among the sets of each label of ``meet``.

    A label's sets are dealt to chunks of about ``CHUNK`` shingles. Chunks are solved each; then the first
    sets of the connected parts of all chunks; then what still isn't in the label's largest part
    (its strays) is compared with all of its chunks. In a group of near copies strays are few,
    so that work follows the group's size."""
    meet = settle(meet)
    members = meet.join(sized.select("node", "n", "row"), "node")
    large = members.groupBy("label").agg(F.ceil(F.sum("n") / CHUNK).alias("chunks")).where("chunks > 1")
    large = settle(large)
    members = members.join(small(large, BROADCAST_ROWS), "label", "left")
    chunk = F.pmod(F.xxhash64("node"), F.coalesce("chunks", F.lit(1)))
    nodes = settle(members.select("row", "node", "label", chunk.alias("chunk"), F.col("chunks").isNotNull().alias("large")))
    held = placed(docs, nodes, width)

    def solved(rows: DataFrame) -> DataFrame:
        rows = rows.select("label", "chunk", "node", "large", "set").repartition("label", "chunk").sortWithinPartitions("label", "chunk", "node")
        return settle(rows.mapInArrow(_blocks(percent), "label long, chunk long, node long, rep long, set binary"))

    first = solved(held)
    edges = first.where("node <> rep").select("node", "rep").toDF("a", "b")
    drop(meet, nodes)
    if large.isEmpty():
        return edges
    parts = first.where("set is not null")
    reps = parts.where("node = rep").drop("chunk")
    many = reps.groupBy("label").agg(F.ceil(F.sum(F.octet_length("set")) / 8 / CHUNK).alias("chunks"))
    reps = reps.join(small(many, BROADCAST_ROWS), "label").withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks")).withColumn("large", F.lit(False))
    second = solved(reps)
    edges = settle(edges.union(second.where("node <> rep").select("node", "rep")))
    comps = settle(parts.select("label", "node").join(components(edges).withColumnRenamed("label", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    main = comps.groupBy("label", "comp").agg(F.count("*").alias("n")).groupBy("label").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"))
    named = parts.join(comps.drop("label"), "node").join(main, "label")
    strays = named.where("comp <> main")
    pieces = strays.groupBy("label").agg(F.ceil(F.sum(F.octet_length("set")) / 8 / CHUNK).alias("pieces"))
    pieces = settle(pieces.join(large, "label"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    near = small(pieces, BROADCAST_ROWS)
    side = ["label", "chunk", "piece", "stray", "node", "comp", "set"]
    own = named.join(near, "label").withColumn("piece", each("pieces")).withColumn("stray", F.lit(False)).select(*side)
    asks = strays.drop("chunk").join(near, "label").withColumn("piece", F.pmod(F.xxhash64("node"), "pieces")).withColumn("chunk", each("chunks")).withColumn("stray", F.lit(True)).select(*side)
    rows = own.union(asks).repartition("label", "chunk", "piece").sortWithinPartitions("label", "chunk", "piece", "stray")
    return edges.union(rows.mapInArrow(_strays(percent), "a long, b long"))


def groups(docs: DataFrame, width: int = 4, percent: int = 85, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns ``keep``, ``n_shingles, group, component_id`` for each row of ``docs`` (``doc_id``,
    ``text``): sets of ``width``-word shingles link where 100 times the intersection is at least
    ``percent`` times the union. ``group`` names what links connect, null for an empty set."""
    kept = [F.col(c).alias(f"keep_{k}") for k, c in enumerate(keep)]
    types = "".join(f"keep_{k} {docs.schema[c].dataType.simpleString()}, " for k, c in enumerate(keep))
    docs = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), *kept)
    spark = docs.sparkSession
    profiles = settle(in_arrow(docs, _profiles(width), f"doc_id long, mark long, {types}n_shingles long, node long, point binary"))
    sized = profiles.where("node is not null").groupBy("node")
    sized = settle(sized.agg(F.min("doc_id").alias("doc_id"), F.first(F.struct("doc_id", "mark")).alias("row"), F.first("n_shingles").alias("n"), F.first("point").alias("point")))
    common = spark.sparkContext.broadcast(common_shingles(docs, width))
    rows = in_arrow(docs.select("text"), _signatures(width, percent, common), "key long, node long")
    met = rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_met, "meeting long, node long, head long")
    met = settle(met.distinct())
    shared = met.where("meeting is not null").join(sized.select("node", "n", "point"), "node").select("meeting", "node", "n", "point")
    shared = shared.repartition("meeting").sortWithinPartitions("meeting", "n", "node")
    bounded = settle(shared.mapInArrow(_bounded(percent), "a long, b long").union(met.where("head is not null").select("node", "head")))
    edges = settle(verified(docs, components(bounded), sized, width, percent))
    drop(met, bounded)
    found = components(edges)
    # the smallest id of each component, by node; sets without links are their own component
    named = sized.select("node", "doc_id").join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.where("label <> node").select("label").distinct().join(named, "label").groupBy("label").agg(F.min("doc_id").alias("least"))
    named = named.join(small(settle(least), BROADCAST_ROWS), "label", "left").select("node", "label", F.coalesce("least", "doc_id").alias("least"))
    out = profiles.join(small(settle(named), BROADCAST_ROWS), "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", *[F.col(f"keep_{k}").alias(c) for k, c in enumerate(keep)], "n_shingles", F.col("label").alias("group"), component.alias("component_id"))


def join(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs``, as groups() finds them."""
    return groups(docs, width, percent).select("doc_id", "n_shingles", "component_id")
