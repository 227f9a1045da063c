"""Sharding by extendible hashing.

A document's 60-bit hash prefix leads it through a directory. A bucket whose documents exceed
the byte limit splits on one more bit, and only such a bucket; its halves are looked at again.
A document's shard is therefore its shortest prefix whose bucket fits. All of it is SQL: buckets
are counted with partial sums ``BITS_A_ROUND`` bits at a time, and a round goes only over
documents whose bucket is still too large.

Results: null texts have 0 bytes. Rows of one ``doc_id`` (null ids together) have one hash and
stay in one shard; if they, or one document, exceed the limit alone, their shard ends at
60 bits and is marked ``oversize``. An empty table has no shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingmill.llm.base import settle

LIMIT_BYTES = 1 << 20
BITS = 60
BITS_A_ROUND = 12


def hash60(doc_id) -> "F.Column":
    """The first 15 hexadecimal digits of the id's MD5 as a number."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def shard(docs: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """``doc_id, bytes, depth, shard, shard_bytes, oversize`` for each row of ``docs``; ``shard`` is the
    prefix as ``depth`` binary digits."""
    left = settle(
        docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), hash60(F.col("doc_id")).alias("hash"))
    )
    done, low = None, 0
    while True:
        high = min(BITS, low + BITS_A_ROUND)
        prefix = lambda depth: F.shiftright("hash", BITS - depth)
        cells = left.groupBy(prefix(high).alias("cell")).agg(F.sum("bytes").alias("cell_bytes"))
        depths = F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")
        spread = cells.select("cell", "cell_bytes", depths).withColumn("bucket", F.expr(f"shiftright(cell, {high} - depth)"))
        sums = spread.groupBy("depth", "bucket").agg(F.sum("cell_bytes").alias("shard_bytes"))
        fits = sums.where((F.col("shard_bytes") <= limit) | (F.col("depth") == BITS))
        # of a cell's buckets that fit, the shortest prefix
        chosen = (
            spread.join(fits, ["depth", "bucket"])
            .groupBy("cell")
            .agg(F.min(F.struct("depth", "bucket", "shard_bytes")).alias("x"))
            .select("cell", "x.*")
        )
        placed = left.withColumn("cell", prefix(high)).join(chosen, "cell")
        done = placed if done is None else done.unionByName(placed)
        if high == BITS:
            break
        rest = left.withColumn("cell", prefix(high)).join(chosen, "cell", "left_anti").drop("cell")
        if rest.isEmpty():
            break
        left, low = settle(rest), high
    return done.select(
        "doc_id",
        "bytes",
        F.col("depth").cast("int").alias("depth"),
        F.expr("substring(lpad(bin(bucket), 60, '0'), 61 - depth, depth)").alias("shard"),
        "shard_bytes",
        (F.col("shard_bytes") > limit).alias("oversize"),
    )

def directory(shards: DataFrame) -> DataFrame:
    """``shard, n_docs, bytes`` for each shard."""
    return shards.groupBy("shard").agg(F.count("*").alias("n_docs"), F.sum("bytes").alias("bytes"))


ORACLE_SQL = f"""
with d as (
  select doc_id, coalesce(strlen(text), 0) as bytes,
         cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as h
  from documents),
b as (
  select depth, h >> (60 - depth) as bucket, sum(bytes) as total
  from d, (select unnest(range(0, 61)) as depth) group by 1, 2),
p as (
  select d.h, b.depth, b.bucket, b.total,
         row_number() over (partition by d.h order by b.depth) as n
  from (select distinct h from d) d join b on b.bucket = d.h >> (60 - b.depth)
  where b.total <= {LIMIT_BYTES} or b.depth = 60)
select d.doc_id, d.bytes, cast(p.depth as int) as depth,
       right(lpad(bin(p.bucket), 60, '0'), p.depth) as shard,
       cast(p.total as bigint) as shard_bytes, p.total > {LIMIT_BYTES} as oversize
from d join p on p.h = d.h and p.n = 1
"""
