"""Document fingerprints by winnowing.

Every run of ``WIDTH`` code points has a rolling hash; of each ``WINDOW`` consecutive ones the smallest is
chosen, the rightmost of equal ones, and the chosen hashes with their positions are the fingerprint.
Two texts that share a passage of ``WIDTH + WINDOW - 1`` code points share a chosen hash; passages
under ``WIDTH`` never match. Likeness is the share of the different hashes of two fingerprints that both have.

The rolling hash is a polynomial modulo 2^64: a difference of running sums, moved back to place 0 by a power of
the base's inverse, mixed, and cut to 32 bits. All texts of a slice are hashed and winnowed by a few numpy calls.

``beside_next`` needs each document's successor by id. Ranges of ids, as Spark's range partitioning finds them, are
handed out whole: a range goes with the first document of the next one, as compressed text, and is read in order.
So each text moves once, but for one document a range; the driver gets the first id of each range.

Results: null and empty texts have empty fingerprints, alike to each other (1) and to nothing else (0). A text of fewer than
``WIDTH`` code points has one hash, of itself; one of fewer than ``WINDOW`` hashes has one window. Equal ids follow each other by
a hash of the text; a null id comes before all others. A single document is its own next one. An empty table gives an empty
result; repeated rows each get a row; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingmill.llm.base import in_arrow
from ratingmill.llm.text import mix

WIDTH, WINDOW = 16, 48
#: Text bytes of a range of ids, and the most ranges.
RANGE_BYTES, RANGES = 1 << 22, 1 << 15
#: Code points that are winnowed together.
SLICE = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, _U)
    while len(out) < n:
        out = np.concatenate([out, out * _U(pow(base, len(out), 1 << 64))])
    return out[:n]


_UP, _DOWN = _powers(_BASE, SLICE + 1), _powers(_INVERSE, SLICE + 1)


def chosen(texts: list[str], width: int = WIDTH, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The fingerprints of ``texts``: number of chosen hashes of each text, their positions and the hashes."""
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes)
    up, down = (_UP, _DOWN) if n <= SLICE else (_powers(_BASE, n + 1), _powers(_INVERSE, n + 1))
    total = np.zeros(n + 1, _U)
    np.cumsum((codes.astype(_U) + _U(1)) * up[:n], out=total[1:])
    first = np.cumsum(sizes) - sizes
    grams = np.where(sizes > 0, np.maximum(sizes - width + 1, 1), 0)
    # a text's hashes stand where its code points do; what lies across its end is never looked at
    last = np.minimum(np.arange(n) + width, np.repeat(first + sizes, sizes))
    name = mix((total[last] - total[:n]) * down[:n]) & _U(0xFFFFFFFF00000000)
    key = name | (_U(0xFFFFFFFF) - np.arange(n, dtype=_U))  # of equal hashes the rightmost is smaller
    whole = grams >= window
    low, span = key, 1
    while whole.any() and span < window:
        step = min(span, window - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    there = np.zeros(n, bool)
    count = np.where(whole, grams - window + 1, 0)
    starts = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
    place = lambda k: (_U(0xFFFFFFFF) - (k & _U(0xFFFFFFFF))).astype(np.int64)
    there[place(low[starts])] = True
    for f, g in zip(first[~whole & (grams > 0)].tolist(), grams[~whole & (grams > 0)].tolist(), strict=True):
        there[place(key[f : f + g].min())] = True
    at = np.flatnonzero(there)
    owner = np.searchsorted(first + sizes, at, "right")
    return np.bincount(owner, minlength=len(texts)), at - first[owner], (key[at] >> _U(32)).astype(np.int64)


def sliced(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``SLICE`` code points; a longer one stands alone."""
    low = size = 0
    for k, t in enumerate(texts):
        if k > low and size + len(t) > SLICE:
            yield low, k
            low, size = k, 0
        size += len(t)
    if low < len(texts):
        yield low, len(texts)


def fingerprints(texts: list[str], width: int = WIDTH, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``chosen`` of any number of texts."""
    found = [chosen(texts[low:high], width, window) for low, high in sliced(texts)]
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def likeness(counts: np.ndarray, hashes: np.ndarray, other_counts: np.ndarray, other_hashes: np.ndarray) -> np.ndarray:
    """Of each text and its other one: different hashes in both over those in either."""
    n = len(counts)
    own = np.unique((np.repeat(np.arange(n, dtype=_U), counts) << _U(32)) | hashes.astype(_U))
    other = np.unique((np.repeat(np.arange(n, dtype=_U), other_counts) << _U(32)) | other_hashes.astype(_U))
    per = lambda x: np.bincount((x >> _U(32)).astype(np.int64), minlength=n)
    both = per(np.intersect1d(own, other, assume_unique=True))
    either = per(own) + per(other) - both
    return np.where(either == 0, 1.0, both / np.maximum(either, 1))


def as_text(counts: np.ndarray, places: np.ndarray, hashes: np.ndarray) -> pa.Array:
    """Each fingerprint as ``position:hash``, joined by commas."""
    entry = pc.binary_join_element_wise(pa.array(places).cast(pa.string()), pa.array(hashes).cast(pa.string()), ":")
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), entry)
    return pc.binary_join(lists, ",")


def fingerprint(docs: DataFrame, keep: list[str], width: int = WIDTH, window: int = WINDOW) -> DataFrame:
    """The columns ``keep`` with ``n_chars, positions, hashes`` of each row's fingerprint; map only."""
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)
    names = [*keep, "n_chars", "positions", "hashes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            counts, places, hashes = fingerprints(texts, width, window)
            cuts = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (places, hashes)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([len(t) for t in texts], pa.int64()), *lists], names)

    return in_arrow(docs.select(*keep, docs["text"].alias("__text")), run, f"{types}n_chars long, positions array<long>, hashes array<long>")


def _ranges(docs: DataFrame) -> np.ndarray:
    """The first order key of each range of ids, ascending: at most ``RANGES`` numbers."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, min(RANGES, -(-size // RANGE_BYTES)))
    dealt = docs.select(_order()).repartitionByRange(n, "place")
    return np.array(sorted(r[1] for r in dealt.groupBy(F.spark_partition_id()).agg(F.min("place")).collect()), np.int64)


def _order() -> "F.Column":
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("place")


def _in_order(docs: DataFrame, firsts: np.ndarray) -> DataFrame:
    """``range, ahead, doc_id, text`` with each range of ids together and in order; the first documents of
    the next range (``ahead``) come last, and those of the first range after the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            place, mark, doc_id, text = batch.columns
            at = np.searchsorted(firsts, place.to_numpy(), "right") - 1
            ahead = np.flatnonzero(firsts[at] == place.to_numpy())
            rows = np.concatenate([np.arange(len(at)), ahead])
            packed = pa.array([None if t is None else packer.compress(t) for t in text.cast(pa.binary()).to_pylist()], pa.binary())
            range_ = np.concatenate([at, (at[ahead] - 1) % len(firsts)])
            late = np.arange(len(rows)) >= len(at)
            yield pa.RecordBatch.from_arrays([pa.array(range_), pa.array(late), *(x.take(pa.array(rows)) for x in (place, mark, doc_id, packed))], ["range", "ahead", "place", "mark", "doc_id", "packed"])

    rows = docs.select(_order(), F.xxhash64("text").alias("mark"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = in_arrow(rows, run, "range long, ahead boolean, place long, mark long, doc_id long, packed binary")
    return dealt.repartition("range").sortWithinPartitions("range", "ahead", "place", "mark")


def beside_next(docs: DataFrame, width: int = WIDTH, window: int = WINDOW, tail: int = 4) -> DataFrame:
    """Each document beside an edited text, whose last ``1/tail`` is the beginning of the next document, and beside the next
    document: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def result(ids: list, texts: list[str]) -> pa.RecordBatch:
        """Rows of all texts but the last."""
        n = len(ids)
        cut = [len(t) // tail for t in texts[:n]]
        edited = [t[: len(t) - k] + after[:k] for t, after, k in zip(texts, texts[1:], cut, strict=False)]
        counts, places, hashes = fingerprints(texts, width, window)
        e_counts, e_places, e_hashes = fingerprints(edited, width, window)
        own, skipped = counts[:n].sum(), counts[0]
        near_edited = likeness(counts[:n], hashes[:own], e_counts, e_hashes)
        near_next = likeness(counts[:n], hashes[:own], counts[1:], hashes[skipped:])
        sha = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]
        columns = [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts[:n]], pa.int64()), pa.array(sha), as_text(counts[:n], places[:own], hashes[:own]), as_text(e_counts, e_places, e_hashes), pa.array(near_edited), pa.array(near_next)]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        ids, texts, size, now, over = [], [], 0, None, False
        for batch in batches:
            for range_, ahead, doc_id, packed in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if range_ != now:
                    ids, texts, size, now, over = [], [], 0, range_, False
                if over:
                    continue  # equals of the next range's first document
                texts.append("" if packed is None else unpacker.decompress(packed).decode("utf-8", "replace"))
                size += len(texts[-1])
                over = ahead
                if over or size > SLICE:
                    if ids:
                        yield result(ids, texts)
                    ids, texts = [], texts[-1:]
                    size = len(texts[-1])
                ids.append(doc_id)

    if docs.isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    dealt = _in_order(docs, _ranges(docs)).select("range", "ahead", "doc_id", "packed")
    return in_arrow(dealt, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
