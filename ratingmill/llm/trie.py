"""Prefix tries of conversations, from vertical bitmaps.

Conversations of ``SHARD`` consecutive ids make a shard. In a shard, each (position, turn) has the bitset of
the conversations that have this turn there. From the bitset of all conversations, the intersections of a
node's bitset with the postings of the next position are its children, found depth first; the number of bits
tells how many conversations a node has, and the bits of conversations that end at it are its end list. A
shard's trie is a part of the whole one: parts of a node meet by a digest of the path, one row for each shard
that has it, so that a first turn that all conversations share costs a row a shard. Texts don't move; a
turn is known by the SHA-256 of role and text.

What a subtree sums up is summed where it lies. Every node has its smallest conversation in one shard, and that
shard has all nodes above it too; there alone the node counts. A shard lists its nodes depth first, so
that a subtree is a range of the list, and its sum a difference of running sums. The parts are then added.

Results: null role and text are empty; rows without ``conv_id`` belong to no conversation and are left out. Turns
with the same number, and repeated rows, all count, in the order of their digests. An empty table has no nodes,
not even a root. Other columns don't matter. A task holds a shard's turns as digests and numbers, and streams
the ids that end at a node: these are hashed one after another, as the digest asks for.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingmill.llm.base import in_arrow, settle
from ratingmill.llm.resample import CRC_SQL, TAB_SQL

#: Consecutive ids of a shard; a multiple of GROUP.
SHARD = 1000
#: Conversations that borrow from one, and the most turns less one that they take.
GROUP, TURNS = 100, 6
#: Rows of one Arrow batch that a task hands over.
ROWS = 20_000

#: A turn is its digest and the code points of its text.
Turn = tuple[bytes, int]
_ROOT = hashlib.sha256(b"").digest()


def borrowed(turns: dict[int, list[Turn]]) -> dict[int, list[Turn]]:
    """Each conversation's first turns, some of them, from the first conversation of its group of ``GROUP`` ids."""
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % TURNS
        out[c] = turns.get(c - c % GROUP, [])[:h] + own[h:]
    return out


def shard_nodes(turns: dict[int, list[Turn]]) -> Iterator[tuple]:
    """A shard's nodes, depth first: place of the node and of its parent in the list, path, depth, code points of
    the last text, number of conversations, smallest one, whether there are children, and the ids that end here."""
    ids = sorted(turns)
    postings: dict[tuple[int, bytes], int] = {}
    ends: dict[int, int] = {}
    for k, c in enumerate(ids):
        own, bit = turns[c], 1 << k
        ends[len(own)] = ends.get(len(own), 0) | bit
        for position, (digest, _) in enumerate(own):
            postings[position, digest] = postings.get((position, digest), 0) | bit
    lowest = lambda bits: ids[(bits & -bits).bit_length() - 1]
    at, stack = 0, [(-1, 0, (1 << len(ids)) - 1, _ROOT, 0)]
    while stack:
        up, depth, members, path, chars = stack.pop()
        ended = members & ends.get(depth, 0)
        rest = left = members & ~ended
        while rest:
            digest, size = turns[lowest(rest)][depth]
            child = left & postings[depth, digest]
            stack.append((at, depth + 1, child, hashlib.sha256(path + digest).digest(), size))
            rest &= ~child
        here = []
        while ended:
            here.append(str(lowest(ended)))
            ended &= ended - 1
        yield at, up, path, depth, chars, members.bit_count(), lowest(members), left > 0, ",".join(here) or None
        at += 1


def _in_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(x.to_pylist() for x in batch.columns), strict=True)


_NODES = pa.schema([("shard", pa.int64()), ("at", pa.int64()), ("up", pa.int64()), ("path", pa.binary()), ("depth", pa.int64()), ("chars", pa.int64()), ("n", pa.int64()), ("first", pa.int64()), ("inner", pa.bool_()), ("ends", pa.string())])


def parts(conversations: DataFrame, rebuild: Callable[[dict], dict] | None = None) -> DataFrame:
    """The tries of all shards, one row for each node and shard. ``rebuild`` changes the turns of a shard."""
    c, role, text = F.col("conv_id"), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    narrow = conversations.where("conv_id is not null").select((c - F.pmod(c, F.lit(SHARD))).alias("shard"), c.cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    # keys of a few thousand rows at most, unless a conversation is longer
    dealt = narrow.repartition("shard").sortWithinPartitions("shard", "conv_id", F.col("turn").asc_nulls_first(), "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for shard, group in groupby(_rows(batches), itemgetter(0)):
                turns: dict[int, list[Turn]] = {}
                for _, conv, digest, chars in group:
                    turns.setdefault(conv, []).append((digest, chars))
                for node in shard_nodes(turns if rebuild is None else rebuild(turns)):
                    yield shard, *node

        yield from _in_batches(rows(), _NODES)

    return in_arrow(dealt.select("shard", "conv_id", "digest", "chars"), run, "shard long, at long, up long, path binary, depth long, chars long, n long, first long, inner boolean, ends string")


def _summed(nodes: DataFrame) -> DataFrame:
    """For each node and shard what the nodes at home there add: ``path, parent_conv_id, children, leaves, saved``."""
    names = ["path", "parent_conv_id", "children", "leaves", "saved"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shards() -> Iterator[pa.Table]:
            """The rows of one shard after another."""
            held, last = [], None
            for batch in batches:
                shard = batch.column(0).to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
                for low, high in zip(cuts, cuts[1:]):  # noqa: B905
                    if low < high:
                        if held and shard[low] != last:
                            yield pa.Table.from_batches(held)
                            held = []
                        held.append(batch.slice(low, high - low))
                        last = shard[low]
            if held:
                yield pa.Table.from_batches(held)

        for table in shards():
            up, depth, conv, home, leaf, value = (table.column(c).to_numpy() for c in ("up", "depth", "conv_id", "home", "leaf", "value"))
            n = len(up)
            # a subtree ends before the next node that isn't deeper
            end, open_ = np.full(n, n), []
            for k, d in enumerate(depth.tolist()):
                while open_ and depth[open_[-1]] >= d:
                    end[open_.pop()] = k
                open_.append(k)
            total = lambda x: (run_ := np.concatenate([[0], np.cumsum(x)]))[end] - run_[:-1]
            children = np.bincount(up[1:][home[1:]], minlength=n)
            parent = pa.array(conv[np.maximum(up, 0)], mask=up < 0)
            new = [parent, pa.array(children, pa.int64()), *(pa.array(total(x), pa.int64()) for x in (leaf.astype(np.int64), value))]
            yield from pa.table([table.column("path"), *new], names).combine_chunks().to_batches(ROWS)

    dealt = nodes.select("shard", "at", "up", "path", "depth", "conv_id", "home", "leaf", "value").repartition("shard").sortWithinPartitions("shard", "at")
    return in_arrow(dealt, run, "path binary, parent_conv_id long, children long, leaves long, saved long")


def _end_digests(nodes: DataFrame) -> DataFrame:
    """``path, ends_sha256`` of the nodes at which conversations end; shards ascend as their ids do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for path, group in groupby(_rows(batches), itemgetter(0)):
                digest, between = hashlib.sha256(), b""
                for _, ids in group:
                    digest.update(between + ids.encode())
                    between = b","
                yield path, digest.hexdigest()

        yield from _in_batches(rows(), pa.schema([("path", pa.binary()), ("ends_sha256", pa.string())]))

    dealt = nodes.where("ends is not null").select("path", "shard", "ends").repartition("path").sortWithinPartitions("path", "shard")
    return in_arrow(dealt.select("path", "ends"), run, "path binary, ends_sha256 string")


def build(conversations: DataFrame, rebuild: Callable[[dict], dict] | None = None) -> DataFrame:
    """One row for each node: ``path`` (digest), ``conv_id`` (smallest conversation), ``depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256``."""
    part = settle(parts(conversations, rebuild))
    whole = settle(part.groupBy("path").agg(F.sum("n").alias("n_convs"), F.min("first").alias("conv_id"), F.max("inner").alias("inner")))
    home = F.col("first") == F.col("conv_id")
    saves = F.when(home, (F.col("n_convs") - 1) * F.col("chars")).otherwise(0)
    met = part.select("shard", "at", "up", "path", "depth", "chars", "first").join(whole, "path")
    met = met.withColumn("home", home).withColumn("leaf", home & ~F.col("inner")).withColumn("value", saves)
    sums = _summed(met).groupBy("path").agg(F.min("parent_conv_id").alias("parent_conv_id"), F.sum("children").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    depth = part.groupBy("path").agg(F.min("depth").alias("depth"))
    out = whole.drop("inner").join(depth, "path").join(sums, "path").join(_end_digests(part), "path", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("path", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


ORACLE_SQL = f"""
with {TAB_SQL},
crc as ({CRC_SQL.format(of="cast(conv_id as varchar)", table="conversations")}),
turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first) as pos,
         sha256(cast(strlen(coalesce(role, '')) as varchar) || ':' || coalesce(role, '') || coalesce(text, '')) as digest, length(coalesce(text, '')) as chars
  from conversations where conv_id is not null),
convs as (select conv_id, conv_id - conv_id % {GROUP} as base, crc % {TURNS} as h from (select distinct conv_id from turns) join crc on value = cast(conv_id as varchar)),
taken as (select c.conv_id, c.h, t.pos, t.digest, t.chars from convs c join turns t on t.conv_id = c.base and t.pos <= c.h),
rebuilt as (
  select conv_id, row_number() over (partition by conv_id order by part, pos) as d, digest, chars from (
    select conv_id, 0 as part, pos, digest, chars from taken
    union all select conv_id, 1, pos, digest, chars from turns join convs using (conv_id) where pos > h)),
paths as (
  select conv_id, 0 as d, '' as path, null as parent, 0 as chars from convs
  union all
  select conv_id, d, sha256(string_agg(digest, '/') over w) as path, coalesce(sha256(string_agg(digest, '/') over (w rows between unbounded preceding and 1 preceding)), '') as parent, chars
  from rebuilt window w as (partition by conv_id order by d)),
deep as (select conv_id, max(d) as len from paths group by 1),
nodes as (
  select p.path, any_value(p.parent) as parent, p.d, any_value(chars) as chars, min(p.conv_id) as conv_id, count(*) as n_convs, max(case when len > p.d then 1 else 0 end) as inner_,
         sha256(coalesce(string_agg(cast(p.conv_id as varchar), ',' order by p.conv_id) filter (where len = p.d), '')) as ends_sha256
  from paths p join deep using (conv_id) group by p.path, p.d),
own as (
  select p.conv_id, p.path, p.d, sum(case when n.conv_id = p.conv_id and inner_ = 0 then 1 else 0 end) over w as leaves,
         sum(case when n.conv_id = p.conv_id then (n.n_convs - 1) * n.chars else 0 end) over w as saved
  from paths p join nodes n on n.path = p.path and n.d = p.d
  window w as (partition by p.conv_id order by p.d desc)),
sums as (select path, d, sum(leaves)::bigint as n_leaves, sum(saved)::bigint as saved_tokens from own group by 1, 2),
kids as (select parent, d - 1 as d, count(*) as n_children from nodes where d > 0 group by 1, 2)
select n.conv_id, n.d::bigint as depth, u.conv_id as parent_conv_id, n.n_convs, coalesce(n_children, 0) as n_children, n_leaves, saved_tokens, n.ends_sha256
from nodes n join sums s on s.path = n.path and s.d = n.d
left join nodes u on n.d > 0 and u.path = n.parent and u.d = n.d - 1
left join kids k on k.parent = n.path and k.d = n.d
"""
