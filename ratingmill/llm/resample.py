"""Target-distribution importance resampling by bit-sliced aggregation.

A text's features are its runs of one to ``most`` words, hashed into buckets. How often each bucket
occurs in the documents and in a target corpus gives the bucket's gain, an integer. A document's
bucket counts become planes of one bit for each bucket, gains become planes of their
two's-complement bits; each pair of planes is joined by AND and its bits are counted, and the counts
times powers of two add up to the exact sum of gains. Documents are then drawn without replacement by
Gumbel noise from a hash of their ids: the highest scores are the sample.

Only sums for each bucket (``buckets`` rows at most) come to the driver. The draw needs no global sort:
a histogram of the integer scores tells how many documents stand above each score, and only documents
that may be drawn are put in order within their score. A score is a mean of gains, each within 1000 * ln(2^63)
of zero, plus noise between -3,131 and 22,874, so that the histogram has under 120,000 rows at any size.

Results: null texts have no words; a document without features has weight 0. Documents of too few words are
scored but never drawn. A null id is hashed as an empty one and comes last in ties; equal rows are each ranked. An empty
table gives an empty result, an empty target counts 0 everywhere. Other columns don't matter.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratingmill.llm.base import in_arrow, settle, small
from ratingmill.llm.text import ALNUM, words

BUCKETS, MOST, SEED, PERCENT, LEAST_WORDS = 10_000, 1, 2024, 10, 20
#: Documents whose planes are made together, and scores in a block of the histogram.
ROWS, BLOCK = 256, 512
#: Bytes of a word that are hashed beside those of other words; zlib takes the rest.
ABREAST = 64
_ONES = np.uint32(0xFFFFFFFF)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


_CRC = _crc_table()


def crc_feed(state: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 registers after the bytes of ``data`` from each start to its end: all words' first bytes, then
    all second bytes, and so on."""
    length = end - start
    order = np.argsort(-length, kind="stable")
    at, register = start[order], state[order]
    falling = -length[order]
    for k in range(min(ABREAST, int(length.max(initial=0)))):
        n = int(np.searchsorted(falling, -k))  # words longer than k
        register[:n] = _CRC[(register[:n] ^ data[at[:n] + k]) & np.uint32(255)] ^ (register[:n] >> np.uint32(8))
    for i in range(int(np.searchsorted(falling, -ABREAST))):
        rest = data[at[i] + ABREAST : at[i] + length[order[i]]].tobytes()
        register[i] = zlib.crc32(rest, int(register[i] ^ _ONES)) ^ 0xFFFFFFFF
    out = np.empty_like(register)
    out[order] = register
    return out


def features(column: pa.Array, most: int, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice of ``column``: number of texts, words of each, and all features as text and bucket."""
    for part in words(column, ALNUM):
        sizes = np.diff(part.first)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        last = np.repeat(part.first[1:], sizes)
        at = np.arange(len(owner))
        state = np.full(len(owner), _ONES)
        texts, found = [], []
        for r in range(most):
            at = at[at + r < last[at]]
            state = state[: len(at)] if r == 0 else state
            if r:
                state = _CRC[(kept[at] ^ np.uint32(32)) & np.uint32(255)] ^ (kept[at] >> np.uint32(8))
            state = crc_feed(state, part.data, part.start[at + r], part.end[at + r])
            kept = np.zeros(len(owner), np.uint32)
            kept[at] = state
            texts.append(owner[at])
            found.append((state ^ _ONES).astype(np.int64) % buckets)
        yield len(sizes), sizes, np.concatenate(texts), np.concatenate(found)


def bucket_counts(texts: DataFrame, most: int = MOST, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts; a task sends one row for each of its buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for *_, bucket in features(batch.column(0), most, buckets):
                total += np.bincount(bucket, minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in in_arrow(texts.select("text"), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():  # at most ``buckets`` rows
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log ratio of the smoothed shares, for each bucket."""
    n = len(source)
    over, under = float(source.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((t + 1) * over / ((s + 1) * under))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


class Planes:
    """Gains as bit planes; the last plane is the sign's and counts negative."""

    def __init__(self, gain: np.ndarray):
        self.width = -(-len(gain) // 64) * 64
        bits = int(np.abs(gain).max(initial=1)).bit_length() + 1
        on = np.zeros((bits, self.width), bool)
        for j in range(bits):
            on[j, : len(gain)] = (gain >> j) & 1
        self.planes = np.packbits(on, axis=1, bitorder="little").view(np.uint64)
        self.value = [1 << j for j in range(bits - 1)] + [-(1 << (bits - 1))]

    def sums(self, texts: int, owner: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """The sum of gains over each text's features."""
        key, count = np.unique(owner * self.width + bucket, return_counts=True)
        row, column = key // self.width, key % self.width
        out = np.zeros(texts, np.int64)
        for k in range(int(count.max(initial=0)).bit_length()):
            on = np.flatnonzero((count >> k) & 1)
            rows, place = np.unique(row[on], return_inverse=True)
            for low in range(0, len(rows), ROWS):
                a, b = np.searchsorted(place, (low, low + ROWS))  # places ascend
                bits = np.zeros((min(ROWS, len(rows) - low), self.width), bool)
                bits[place[a:b] - low, column[on[a:b]]] = True
                plane = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
                total = sum(v * np.bitwise_count(plane & g).sum(axis=1, dtype=np.int64) for g, v in zip(self.planes, self.value, strict=True))
                out[rows[low : low + ROWS]] += total << k
        return out


def weigh(docs: DataFrame, keep: list[str], gain: np.ndarray, most: int = MOST) -> DataFrame:
    """The columns ``keep`` with ``n_words``, ``n_features`` and ``weight``, the floored mean gain of the features."""
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)
    names = [*keep, "n_words", "n_features", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = Planes(gain)
        for batch in batches:
            sizes, counts, weights = [], [], []
            for texts, n_words, owner, bucket in features(batch.column(batch.num_columns - 1), most, len(gain)):
                n = np.bincount(owner, minlength=texts)
                sizes.append(n_words)
                counts.append(n)
                weights.append(planes.sums(texts, owner, bucket) // np.maximum(n, 1))
            new = [pa.array(np.concatenate([np.zeros(0, np.int64), *x]), pa.int64()) for x in (sizes, counts, weights)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names)

    return in_arrow(docs.select(*keep, docs["text"].alias("__text")), run, f"{types}n_words long, n_features long, weight long")


def noise(doc_id, seed: int) -> "F.Column":
    """Floored thousandths of Gumbel noise that the id and ``seed`` determine."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def draw(weighed: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Adds ``score`` and ``rank``: 1, 2, ... over the drawn ``percent`` of the documents of at least ``least_words``
    words, highest score first, then the smaller ``doc_id``; null for all others."""
    scored = settle(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("able", F.col("n_words") >= least_words))
    hist = settle(scored.where("able").groupBy("score").agg(F.count("*").alias("n"))).withColumn("block", F.floor(F.col("score") / BLOCK))
    above = lambda w: F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    blocks = hist.groupBy("block").agg(F.sum("n").alias("n"))
    blocks = blocks.select("block", above(Window.orderBy(F.desc("block"))).alias("before"))  # a few hundred rows
    drawn = hist.agg(F.floor(F.lit(percent) * F.coalesce(F.sum("n"), F.lit(0)) / 100).alias("drawn"))  # one row
    scores = hist.withColumn("within", above(Window.partitionBy("block").orderBy(F.desc("score")))).join(blocks, "block")
    scores = scores.select("score", (F.col("before") + F.col("within")).alias("above")).crossJoin(F.broadcast(drawn)).where("above < drawn")
    both = scored.join(small(scores, 200_000), "score", "left")
    # documents that stand alike are counted before they move
    like = [c for c in both.columns if c != "n"]
    near = both.where("able and above is not null").groupBy(*like).agg(F.count("*").alias("n"))
    near = near.withColumn("first", F.col("above") + above(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "weight", "n_features", "n_words")))
    near = near.select(*like, F.posexplode(F.array_repeat(F.lit(0), F.col("n").cast("int"))).alias("nth", "_"), "first")
    place = F.col("first") + F.col("nth") + 1
    ranked = near.withColumn("rank", F.when(place <= F.col("drawn"), place))
    out = ranked.drop("nth", "_", "first").unionByName(both.where("not able or above is null").withColumn("rank", F.lit(None).cast("long")))
    return out.drop("able", "above", "drawn")


def resample(docs: DataFrame, target: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of each row of ``docs``, drawn to look like ``target``."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    return draw(weigh(docs, ["doc_id"], gain))


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UP = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: CRC-32 of the distinct values ``of`` of a table as ``value, crc``; needs ``tab``.
CRC_SQL = """select value, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(value))),
    lambda k: ('0x' || substr(hex(encode(value)), (2 * k + 1)::int, 2))::bigint)), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) as crc
  from (select distinct {of} as value from {table}), tab"""
TAB_SQL = """tab as (select list(list_reduce(list_prepend(i, range(8)),
    lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as tab from range(256) r(i))"""
ORACLE_SQL = f"""
with {TAB_SQL},
d as (select doc_id, regexp_extract_all({_UP}, '{_WORD}') as words from documents),
dw as (select doc_id, word, count(*) as n from (select doc_id, unnest(words) as word from d) group by all),
bw as (select word, count(*) as n from (select unnest(regexp_extract_all({_UP}, '{_WORD}')) as word from benchmark) group by all),
every as (select word from dw union select word from bw),
crc as ({CRC_SQL.format(of="word", table="every")}),
s as (select crc % {BUCKETS} as b, sum(n) as s from dw join crc on value = word group by 1),
t as (select crc % {BUCKETS} as b, sum(n) as t from bw join crc on value = word group by 1),
totals as (select (select coalesce(sum(s), 0) from s)::double as big_s, (select coalesce(sum(t), 0) from t)::double as big_t),
gain as (
  select b, floor(1000 * ln((coalesce(t, 0) + 1) * (big_s + {BUCKETS}) / ((coalesce(s, 0) + 1) * (big_t + {BUCKETS}))))::bigint as g
  from (select unnest(range({BUCKETS})) as b) left join s using (b) left join t using (b), totals),
w as (select doc_id, sum(n)::bigint as n_features, floor(sum(n * g)::double / sum(n))::bigint as weight
  from dw join crc on value = word join gain on b = crc % {BUCKETS} group by 1),
scored as (
  select d.doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || d.doc_id), 1, 8))::bigint + 0.5::double) / 4294967296.0::double)))::bigint as score
  from d left join w using (doc_id)),
able as (select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n from scored where n_features >= {LEAST_WORDS})
select s.doc_id, s.n_features, s.weight, s.score, a.rank
from scored s left join able a on a.doc_id = s.doc_id and a.rank <= {PERCENT} * a.n // 100
"""
