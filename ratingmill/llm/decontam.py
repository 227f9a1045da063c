"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of the benchmark items; the alphabet is words, a block is two of them.
For patterns of one length m a table, looked up by the block that ends at the search position,
tells how far the position can move without passing an occurrence. Where it can't move, the
block is the last one of some pattern: the bucket of that suffix gives the patterns, and direct
comparison of all their words confirms an occurrence. Searches of many stretches of text advance
in step, one numpy call for each move of them all.

Windows have 10 words, or as many as a shorter item has: there is one search for each length.

A benchmark of up to ``TABLE_BYTES`` is made into tables once and broadcast; texts don't move. For a larger one only the
shift tables are, summed up by Spark to a bounded size whatever the benchmark's; what they let pass is joined with all windows by its words, so
that the buckets and the comparison are spread over the cluster.

Results: null or wordless texts have no words, items or hits. Benchmark rows without words or
with a null id count for nothing; rows that repeat an id add windows to that item. A document
word is hit if any occurrence covers it. Repeated rows each keep their row.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingmill.llm.base import in_arrow, settle
from ratingmill.llm.text import ALNUM, Words, mix, runs, words

WIDTH = 10
#: Words of a stretch that one search position walks through.
STRETCH = 512
#: Bytes of benchmark text up to which all tasks get its tables; a larger one is searched for by a join.
TABLE_BYTES = 32 << 20
#: Most bits of a block's name that find its place in the shift tables, for the one and the other.
BITS, JOIN_BITS = 26, 22
_MORE = np.uint64(0x9E3779B97F4A7C15)


def blocks(hashes: np.ndarray, size: int) -> np.ndarray:
    """Names of the blocks of ``size`` words (1 or 2), by their last word."""
    if size == 1:
        return mix(hashes)
    out = np.zeros_like(hashes)
    out[1:] = mix(hashes[:-1] * _MORE + hashes[1:])
    return out


def slot(names: np.ndarray, bits: int) -> np.ndarray:
    return (names >> np.uint64(64 - bits)).astype(np.int64)


def joined(w: Words, first: int, length: int) -> bytes:
    """A window's words, joined by spaces."""
    return b" ".join(w.data[x:y].tobytes() for x, y in zip(w.start[first : first + length].tolist(), w.end[first : first + length].tolist(), strict=True))


def stops(w: Words, names: np.ndarray, length: int, shift: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and words at which a search by ``shift`` can't move: a window may end there."""
    many = np.diff(w.first)
    parts = np.maximum(0, -(-(many - length + 1) // STRETCH))
    doc = np.repeat(np.arange(len(many)), parts)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
    at = w.first[doc] + length - 1 + nth * STRETCH
    stop = np.minimum(at + STRETCH, w.first[doc + 1])
    slots, hits = slot(names, bits), [np.zeros((2, 0), np.int64)]
    while len(at):
        move = shift[slots[at]].astype(np.int64)
        stuck = move == 0
        if stuck.any():
            hits.append(np.stack([doc[stuck], at[stuck]]))
        at = at + np.maximum(move, 1)
        on = at < stop
        if not on.all():
            at, stop, doc = at[on], stop[on], doc[on]
    return tuple(np.concatenate(hits, axis=1))


class Patterns:
    """Shift table and suffix buckets of the windows of one length, as arrays: about seven bytes for each byte of benchmark.

    ``suffixes`` has the last block of each different window of an item, ascending, so that a bucket is a range of it;
    ``at`` the window's first word."""

    def __init__(self, length: int, at: np.ndarray, hashes: np.ndarray, text: "Benchmark"):
        self.length, self.block, self.text = length, min(2, length), text
        self.bits = int(np.clip(np.ceil(np.log2(len(at) + length)) + 3, 12, BITS))
        most = length - self.block + 1
        self.shift = np.full(1 << self.bits, most, np.min_scalar_type(most))
        made = blocks(hashes, self.block)
        for end in range(self.block - 1, length):
            np.minimum.at(self.shift, slot(made[at + end], self.bits), np.array(length - 1 - end, self.shift.dtype))
        whole_, item = runs(hashes, length)[at], text.item(at)
        order = np.lexsort((item, whole_, made[at + length - 1]))
        at, whole_, item = at[order], whole_[order], item[order]
        # windows that an item repeats, by their bytes
        again = np.flatnonzero((whole_[1:] == whole_[:-1]) & (item[1:] == item[:-1])) + 1
        gone = [k for k in again.tolist() if text.window(at[k], length) == text.window(at[k - 1], length)]
        self.at = np.delete(at, gone).astype(np.uint32)
        self.suffixes = made[self.at + np.uint32(length - 1)]

    def search(self, w: Words) -> Iterator[tuple[int, int, list[str]]]:
        """``(document, first word, items)`` of every occurrence in the documents of ``w``."""
        m = self.length
        names = blocks(w.hash, self.block)
        doc, at = stops(w, names, m, self.shift, self.bits)
        low, high = (np.searchsorted(self.suffixes, names[at], side) for side in ("left", "right"))
        there = low < high
        for d, end, a, b in zip(*(x[there].tolist() for x in (doc, at, low, high)), strict=True):
            first = end - m + 1
            own = joined(w, first, m)
            found = [k for k in self.at[a:b].tolist() if self.text.window(k, m) == own]
            if found:
                yield d, first, [self.text.ids[k] for k in self.text.item(np.array(found)).tolist()]


class Benchmark:
    """Words of the items, joined by single spaces, with where they begin and the first word of each item."""

    def __init__(self, ids: list[str], texts: list[str]):
        self.ids = ids
        data, size, many, self.hashes = [], [], [], []
        for w in words(pa.array(texts, pa.large_string()), ALNUM):
            length = w.end - w.start
            joined = np.full(int(length.sum()) + len(length), 32, np.uint8)
            joined[np.arange(length.sum()) + np.repeat(np.arange(len(length)), length)] = w.data[ALNUM[w.data]]
            data.append(joined)
            size.append(length + 1)
            many.append(np.diff(w.first))
            self.hashes.append(w.hash)
        none = np.zeros(0, np.int64)
        self.data = np.concatenate([none.astype(np.uint8), *data]).tobytes()
        self.start = np.concatenate([[0], np.cumsum(np.concatenate([none, *size]))]).astype(np.uint32)
        self.first = np.concatenate([[0], np.cumsum(np.concatenate([none, *many]))])

    def item(self, at: np.ndarray) -> np.ndarray:
        """The items that words are of."""
        return np.searchsorted(self.first, at, "right") - 1

    def window(self, at: int, length: int) -> bytes:
        return self.data[self.start[at] : self.start[at + length] - 1]


def tables(items: list[tuple[str, str]], width: int = WIDTH) -> list[Patterns]:
    """Search tables of the items (id, text), one for each length of windows."""
    text = Benchmark([x for x, _ in items], [t for _, t in items])
    hashes = np.concatenate([np.zeros(0, np.uint64), *text.__dict__.pop("hashes")])
    return [Patterns(m, at, hashes, text) for m, at in windows(text, width)]


def windows(text: "Benchmark", width: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each length of windows the first words of all of them."""
    many = np.diff(text.first)
    for m in sorted(set(np.minimum(many, width).tolist()) - {0}):
        own = (many == m) if m < width else (many >= m)
        count = many[own] - m + 1
        yield m, np.repeat(text.first[:-1][own] - (np.cumsum(count) - count), count) + np.arange(count.sum())


def search(docs: DataFrame, keep: list[str], benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``n_words, n_hit, n_items, items_sha256, contaminated``."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("item_id"))).first()[0] or 0
    return _by_table(docs, keep, items, width) if size <= TABLE_BYTES else _by_join(docs, keep, items, width)


def _types(docs: DataFrame, keep: list[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)


def _by_table(docs: DataFrame, keep: list[str], items: DataFrame, width: int) -> DataFrame:
    """One pass over the texts with all tables; ``items`` are of a checked size."""
    held = docs.sparkSession.sparkContext.broadcast(tables([tuple(r) for r in items.collect()], width))
    names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = held.value
        for batch in batches:
            n_words, hits, items_ = [], [set() for _ in range(batch.num_rows)], [set() for _ in range(batch.num_rows)]
            for w in words(batch.column(batch.num_columns - 1), ALNUM):
                n_words += np.diff(w.first).tolist()
                for patterns in found:
                    for d, first, ids in patterns.search(w):
                        at = first - int(w.first[d])
                        hits[w.low + d].update(range(at, at + patterns.length))
                        items_[w.low + d].update(ids)
            shas = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items_]
            new = [pa.array(n_words, pa.int64()), pa.array(list(map(len, hits)), pa.int64()), pa.array(list(map(len, items_)), pa.int64()), pa.array(shas, pa.string()), pa.array([bool(h) for h in hits], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], [*keep, *names])

    return in_arrow(docs.select(*keep, docs["text"].alias("__text")), run, f"{_types(docs, keep)}n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def _by_join(docs: DataFrame, keep: list[str], items: DataFrame, width: int) -> DataFrame:
    """The same by shift tables of all windows and a join of what they let pass with the windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple["Benchmark", int, np.ndarray]]:
        for batch in batches:
            text = Benchmark(*(c.to_pylist() for c in batch.columns))
            for m, at in windows(text, width):
                yield text, m, at

    def shifts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text, m, at in cut(batches):
            made = blocks(np.concatenate(text.hashes), min(2, m))
            ends = range(m - 1, min(2, m) - 2, -1)  # the smallest moves first
            places = np.concatenate([slot(made[at + end], JOIN_BITS) for end in ends])
            place, first = np.unique(places, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), m)), pa.array(place), pa.array(first // len(at))], ["length", "place", "move"])

    def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text, m, at in cut(batches):
            for low in range(0, len(at), 50_000):
                own = at[low : low + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([text.window(k, m) for k in own.tolist()], pa.binary()), pa.array([text.ids[k] for k in text.item(own).tolist()])], ["window", "item"])

    # at most 2^JOIN_BITS rows for each length
    moves = in_arrow(items, shifts, "length long, place long, move long").groupBy("length", "place").agg(F.min("move").cast("short").alias("move")).toArrow()
    tables_ = {}
    for m in sorted(set(moves.column("length").to_pylist())):
        own = moves.filter(pc.equal(moves.column("length"), m))
        tables_[m] = np.full(1 << JOIN_BITS, m - min(2, m) + 1, np.int16)
        tables_[m][own.column("place").to_numpy()] = own.column("move").to_numpy()
    held = docs.sparkSession.sparkContext.broadcast(tables_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth, task = 0, uuid.uuid4().hex
        for batch in batches:
            n_words, spans = [], [[] for _ in range(batch.num_rows)]
            for w in words(batch.column(batch.num_columns - 1), ALNUM):
                n_words += np.diff(w.first).tolist()
                for m, shift in held.value.items():
                    doc, end = stops(w, blocks(w.hash, min(2, m)), m, shift, JOIN_BITS)
                    for d, first in zip(doc.tolist(), (end - m + 1).tolist(), strict=True):
                        spans[w.low + d].append({"at": first - int(w.first[d]), "length": m, "window": joined(w, first, m)})
            rows = pa.array([f"{task}-{nth + k}" for k in range(batch.num_rows)])
            nth += batch.num_rows
            kind = pa.list_(pa.struct([("at", pa.int64()), ("length", pa.int64()), ("window", pa.binary())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], rows, pa.array(n_words, pa.int64()), pa.array(spans, kind)], [*keep, "__row", "n_words", "__spans"])

    seen = settle(in_arrow(docs.select(*keep, docs["text"].alias("__text")), run, f"{_types(docs, keep)}__row string, n_words long, __spans array<struct<at: bigint, length: bigint, window: binary>>"))
    asked = seen.select("__row", F.explode("__spans").alias("s")).select("__row", "s.*")
    met = asked.join(in_arrow(items, spelt, "window binary, item string").distinct(), "window")
    spot = F.struct("at", "length")
    found = met.groupBy("__row").agg(F.collect_set(spot).alias("spots"), F.array_sort(F.collect_set("item")).alias("items"))
    hit = F.size(F.array_distinct(F.flatten(F.transform("spots", lambda x: F.sequence(x.at, x.at + x.length - 1)))))
    out = seen.drop("__spans").join(found.select("__row", hit.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")), "__row", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(*keep, "n_words", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_hit", "n_items")], F.coalesce("items_sha256", F.lit(nothing)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))
