"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a doubly linked list of byte runs. Every mergeable pair waits, by the place
of its left run, in the bucket of its merge rank. A bitmap over ranks, with summary bitmaps
above it, gives the lowest rank in use by find-first-set. Within a bucket places go from left to
right. A merge may spoil entries of its neighbours; they stay, and are skipped when met.
A pre-token of n bytes takes O(n log n) time, where scanning all pairs again after each merge
takes O(n^2). All new pre-tokens of a slice of text share one queue; a bucket with many places is
merged by numpy at once, where no such merge can make a pair of a lower rank.

Texts are cut into stretches before each space that no white space precedes; the pattern's
pre-tokens never reach over such a cut. Within a slice short stretches are told apart by 64-bit
names, so that each is looked up once, and a worker remembers the ids of those it met.

Results: null text counts as empty; an empty text has no ids. Texts of any length are encoded
whole, one pre-token at a time.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ratingmill.llm.base import in_arrow
from ratingmill.llm.text import hashed, slices, utf8

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
BITS = 64
#: Bytes of each of the two generations of a worker's memory of stretches, what one takes besides
#: its text and ids, and the longest one remembered. They change speed, never results.
REMEMBERED = 16 << 20
ENTRY = 200
LONGEST = 64
#: Bytes of text that are encoded together; a longer text stands alone.
GROUP = 2 << 20
#: Places from which numpy merges a bucket.
MANY = 24
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class RankQueue:
    """Buckets of places by rank; the lowest rank in use is found by find-first-set."""

    def __init__(self, ranks: int):
        self.levels = []
        while True:
            ranks = -(-ranks // BITS)
            self.levels.append([0] * ranks)
            if ranks == 1:
                break
        self.buckets: dict[int, list[int]] = {}

    def open(self, rank: int, places: list[int]) -> None:
        """Starts the bucket of a rank that has none."""
        self.buckets[rank] = places
        for level in self.levels:
            word, bit = divmod(rank, BITS)
            held = level[word]
            level[word] = held | 1 << bit
            if held:
                return
            rank = word

    def take(self) -> tuple[int, list[int]]:
        """The lowest rank and its places from left to right; its bucket is gone then."""
        rank = 0
        for level in reversed(self.levels):
            held = level[rank]
            rank = rank * BITS + (held & -held).bit_length() - 1
        at = rank
        for level in self.levels:
            at, bit = divmod(at, BITS)
            level[at] &= ~(1 << bit)
            if level[at]:
                break
        places = self.buckets.pop(rank)
        places.sort()
        return rank, places


def ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers begin[k] .. begin[k] + size[k] - 1 for all k in a row."""
    end = np.cumsum(size)
    return np.arange(int(end[-1]) if len(end) else 0) + np.repeat(begin - (end - size), size)


def after_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the byte before each place ends a white-space character."""
    one, two, three = (data[np.maximum(at - k, 0)] for k in (1, 2, 3))
    wide = (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
    wide |= (three == 0xE1) & (two == 0x9A) & (one == 0x80)
    wide |= (three == 0xE2) & (two == 0x80) & ((one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF))
    wide |= (three == 0xE2) & (two == 0x81) & (one == 0x9F)
    return _SPACES[one] | wide | ((three == 0xE3) & (two == 0x80) & (one == 0x80))


class Encoder:
    """Encodes and decodes by a table of ranks, as public tokenizers for it do."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.wall = max(ranks.values(), default=-1) + 1
        tokens = [b""] * self.wall
        for token, rank in ranks.items():
            tokens[rank] = token
        self.raw = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.width = self.wall + 1
        self.pairs = {
            ranks[token[:k]] * self.width + ranks[token[k:]]: rank
            for token, rank in ranks.items()
            for k in range(1, len(token))
            if token[:k] in ranks and token[k:] in ranks
        }
        self.keys = np.array(sorted(self.pairs) or [-1], np.int64)
        self.made = np.array([self.pairs.get(k, -1) for k in self.keys.tolist()], np.int64)
        left, right = np.divmod(self.keys, self.width)
        #: Ranks after which a merge may give a pair of a lower rank.
        self.falls = set(left[self.made < left].tolist()) | set(right[self.made < right].tolist())
        self.byte = np.array([ranks.get(bytes([b]), self.wall) for b in range(256)])
        self.first = np.array([[self.pairs.get(a * self.width + b, -1) for b in self.byte.tolist()] for a in self.byte.tolist()])
        self.queue = RankQueue(max(1, self.wall))
        self.split = regex.compile(pattern).findall
        self.young, self.old, self.held = {}, {}, 0

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge ranks of pairs of tokens, -1 without one."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], -1)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens in a row, and how many each has. All pre-tokens go through
        one queue; a wall that pairs with nothing stands before, between and after them."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        begin = np.cumsum(sizes + 1) - sizes
        n = int(sizes.sum()) + len(pieces) + 1
        inside = np.ones(n, bool)
        inside[np.append(0, begin + sizes)] = False
        raw = np.zeros(n, np.uint8)
        raw[inside] = np.frombuffer(b"".join(pieces), np.uint8)
        # the same memory as quick Python arrays and as numpy ones
        lists = [array("q", bytes(8 * n)) for _ in range(4)]
        token, pair, after, before = lists
        tokens, pairs, afters, befores = (np.frombuffer(x, np.int64) for x in lists)
        tokens[:] = np.where(inside, self.byte[raw], self.wall)
        pairs[:] = -1
        pairs[:-1] = np.where(inside[:-1] & inside[1:], self.first[raw[:-1], raw[1:]], -1)
        afters[:], befores[:] = np.arange(1, n + 1), np.arange(-1, n - 1)
        gone = np.zeros(n, bool)
        order = np.flatnonzero(pairs >= 0)
        order = order[np.argsort(pairs[order], kind="stable")]
        used, at = np.unique(pairs[order], return_index=True)
        queue, known, width, falls = self.queue, self.pairs.get, self.width, self.falls
        for rank, places in zip(used.tolist(), np.split(order, at[1:]), strict=True) if len(used) else ():
            queue.open(rank, places.tolist())
        buckets = queue.buckets
        dead = []
        while buckets:
            rank, places = queue.take()
            if len(places) > MANY and rank not in falls:
                place = np.array(places)
                place = place[(pairs[place] == rank) & np.append(True, place[1:] != place[:-1])]  # not stale
                if not len(place):
                    continue
                # of a chain of places that overlap, the first, third and so on
                spot = np.arange(len(place))
                chained = np.append(False, afters[place[:-1]] == place[1:])
                place = place[(spot - np.maximum.accumulate(np.where(chained, 0, spot))) % 2 == 0]
                right = afters[place]
                follow = afters[right]
                tokens[place], pairs[right], afters[place], befores[follow], gone[right] = rank, -1, follow, place, True
                left = befores[place]
                low, made = self.rank_of(tokens[left], tokens[place]), self.rank_of(tokens[place], tokens[follow])
                pairs[left], pairs[place] = low, made
                for new, where in ((low, left), (made, place)):
                    fits = new >= 0
                    for x, place_ in zip(new[fits].tolist(), where[fits].tolist(), strict=True):
                        if x in buckets:
                            buckets[x].append(place_)
                        else:
                            queue.open(x, [place_])
                continue
            for k, place in enumerate(places):
                if pair[place] != rank:  # stale
                    continue
                right = after[place]
                follow = after[right]
                token[place], pair[right], after[place], before[follow] = rank, -1, follow, place
                dead.append(right)
                left = before[place]
                low = pair[left] = known(token[left] * width + rank, -1)
                if low >= 0:
                    if low in buckets:
                        buckets[low].append(left)
                    else:
                        queue.open(low, [left])
                made = pair[place] = known(rank * width + token[follow], -1)
                if made >= 0:
                    if made in buckets:
                        buckets[made].append(place)
                    else:
                        queue.open(made, [place])
                if 0 <= low < rank or 0 <= made < rank:  # a lower rank has come up; the rest of this bucket waits
                    if rest := places[k + 1 :]:
                        queue.open(rank, rest) if rank not in buckets else buckets[rank].extend(rest)
                    break
        gone[dead] = True
        keep = np.flatnonzero(inside & ~gone)
        many = np.searchsorted(keep, begin + sizes) - np.searchsorted(keep, begin)
        return tokens[keep].astype("<u4"), many

    def learn(self, stretches: list[bytes]) -> list[bytes]:
        """Ids of stretches of text that are split on their own."""
        if not stretches:
            return []
        # those that begin with a space and end without white space can be split in a row
        plain = [s[:1] == b" " and (s[-1] < 128 and not _SPACES[s[-1]]) for s in stretches]
        row = iter(self.split(b"".join(s for s, p in zip(stretches, plain, strict=True) if p).decode()))
        pieces, ends = [], []
        for s, p in zip(stretches, plain, strict=True):
            if p:
                left = len(s)
                while left:
                    pieces.append(next(row).encode())
                    left -= len(pieces[-1])
            else:
                pieces += [x.encode() for x in self.split(s.decode())]
            ends.append(len(pieces))
        number = {}
        for x in pieces:
            number.setdefault(x, len(number))
        own = list(number)
        whole = [self.ranks.get(x, -1) for x in own]
        ids, many = self.merge([x for x, rank in zip(own, whole, strict=True) if rank < 0])
        raw, at = ids.tobytes(), (4 * np.cumsum(many)).tolist()
        made, low = [], 0
        rest = iter(at)
        for rank in whole:
            if rank < 0:
                high = next(rest)
                made.append(raw[low:high])
                low = high
            else:
                made.append(rank.to_bytes(4, "little"))
        out, low = [], 0
        for high in ends:
            out.append(made[number[pieces[low]]] if high - low == 1 else b"".join([made[number[x]] for x in pieces[low:high]]))
            low = high
        return out

    def look_up(self, stretches: list[bytes]) -> list[bytes]:
        """Ids of stretches, from memory where it has them."""
        young, old = self.young, self.old
        out = [young.get(s) for s in stretches]
        fresh = [s for s, ids in zip(stretches, out, strict=True) if ids is None]
        if fresh:
            fresh = list(dict.fromkeys(fresh))
            found = {s: old.get(s) for s in fresh}
            new = [s for s, ids in found.items() if ids is None]
            found.update(zip(new, self.learn(new), strict=True))
            out = [found[s] if ids is None else ids for s, ids in zip(stretches, out, strict=True)]
            for s, ids in found.items():
                if len(s) <= LONGEST:
                    young[s] = ids
                    self.held += len(s) + len(ids) + ENTRY
            if self.held > REMEMBERED:
                self.old, self.young, self.held = young, {}, 0
        return out

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For ranges of a column's texts: the first, the one behind the last, the ids of all
        in a row, and where each text's begin (one more entry than texts)."""
        data, at = utf8(column)
        for low, high in slices(at, GROUP):
            part, text = data[at[low] : at[high]], at[low : high + 1] - at[low]
            space = np.flatnonzero(part == 32)
            start = np.union1d(space[~after_space(part, space)], text[:-1][np.diff(text) > 0])
            size = np.diff(start, append=len(part))
            name = stretch_names(part, start, size)
            short = np.flatnonzero(size <= LONGEST)
            _, pick, back = np.unique(name[short], return_index=True, return_inverse=True)
            # stretches that share a name with others but not their bytes stand alone, like long ones
            long = np.concatenate([np.flatnonzero(size > LONGEST), short[unlike(part, start, size, short, short[pick][back])]])
            shown = np.concatenate([short[pick], long])
            raw = part.tobytes()
            ids = self.look_up([raw[a:b] for a, b in zip(start[shown].tolist(), (start + size)[shown].tolist(), strict=True)])
            of = np.empty(len(start), np.int64)
            of[short], of[long] = back, len(pick) + np.arange(len(long))
            many = np.array([len(x) for x in ids], np.int64) >> 2
            flat = np.frombuffer(b"".join(ids), "<u4")
            total = np.concatenate([np.zeros(1, np.int64), np.cumsum(many[of])])
            yield low, high, flat[ragged((np.cumsum(many) - many)[of], many[of])], total[np.searchsorted(start, text)]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.raw[ragged(self.begin[ids], self.size[ids])].tobytes()


def stretch_names(data: np.ndarray, start: np.ndarray, size: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """A 64-bit name for each stretch; ``step`` of them are named at a time."""
    out = [np.zeros(0, np.uint64)]
    for k in range(0, len(start), step):
        low, own = start[k], start[k : k + step]
        high = own[-1] + size[k : k + step][-1]
        out.append(hashed(data[low:high], None, own - low, own - low + size[k : k + step]))
    return np.concatenate(out)


def unlike(data: np.ndarray, start: np.ndarray, size: np.ndarray, own: np.ndarray, other: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """Places of those stretches of ``own`` whose bytes aren't those of the stretch beside them in ``other``."""
    found = [np.zeros(0, np.int64)]
    for k in range(0, len(own), step):
        pair = k + np.flatnonzero(own[k : k + step] != other[k : k + step])
        a, b = own[pair], other[pair]
        bad = size[a] != size[b]
        same = np.flatnonzero(~bad)
        off = data[ragged(start[a[same]], size[a[same]])] != data[ragged(start[b[same]], size[b[same]])]
        if off.any():
            bad[np.repeat(same, size[a[same]])[off]] = True
        found.append(pair[bad])
    return np.concatenate(found)


_LOADED: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each Python worker."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Encoder(load_ranks(path), pattern)
    return _LOADED[path, pattern]


def vocabulary(name: str = VOCABULARY) -> tuple[str, str]:
    """Path and splitting pattern of a public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def encode(docs: DataFrame, keep: list[str], path: str, pattern: str, ids: bool = False, decode: bool = True) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``n_tokens``, ``ids_sha256``, with ``decode``
    the ``decoded_sha256`` of the ids decoded again, and with ``ids`` the ids themselves
    (array of int). One row for each row of ``docs``; the vocabulary must be installed on
    every executor at ``path``."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    schema += ", n_tokens long, ids_sha256 string" + ", decoded_sha256 string" * decode + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        sha = lambda raw, at: pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string())
        for batch in batches:
            for low, high, coded, at in coder.encode(batch.column(batch.num_columns - 1)):
                out = [c.slice(low, high - low) for c in batch.columns[:-1]]
                out += [pa.array(np.diff(at)), sha(coded.tobytes(), 4 * at)]
                if decode:
                    size = np.concatenate([np.zeros(1, np.int64), np.cumsum(coder.size[coded])])
                    out.append(sha(coder.decode(coded), size[at]))
                if ids:
                    out.append(pa.LargeListArray.from_arrays(pa.array(at), pa.array(coded.view("<i4"))).cast(pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, [*keep, "n_tokens", "ids_sha256", *["decoded_sha256"] * decode, *["ids"] * ids])

    return in_arrow(docs.select(*keep, docs["text"].alias("__text")), run, schema)
