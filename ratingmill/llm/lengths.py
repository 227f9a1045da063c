"""Token counts: the exact histogram of encoded lengths.

Documents are encoded and counted by their number of tokens, with partial counts before the
shuffle. Suffix sums over the lengths then answer, for every context limit L that is some
document's length, how many documents reach it, how many tokens remain if each is cut to L, and
at which rank the length stands; between two lengths all of these are linear. Suffix sums are made
in three levels, over zones of blocks, blocks of lengths and within each, so that no task needs all
lengths; zones are few, since a text has under 2^31 tokens.

Results: null and empty texts have length 0. An empty table has an empty histogram. Repeated rows
each count; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratingmill.llm import bpe
from ratingmill.llm.base import in_arrow, settle

#: Lengths in a block, and blocks in a zone.
BLOCK = 512


def count_tokens(docs: DataFrame, keep: list[str], path: str, pattern: str) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``n_tokens``."""
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.encoder(path, pattern)
        for batch in batches:
            sizes = [np.diff(at) for *_, at in coder.encode(batch.column(batch.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate([np.zeros(0, np.int64), *sizes]))], [*keep, "n_tokens"])

    return in_arrow(docs.select(*keep, docs["text"].alias("__text")), run, ", ".join(x for x in (types, "n_tokens long") if x))


def histogram(lengths: DataFrame) -> DataFrame:
    """From a column ``n_tokens``: ``n_tokens, n_docs, docs_at_least, tokens_at_least, total_if_cut,
    rank`` (documents up to this length) for each length that occurs."""
    block, zone = F.floor(F.col("n_tokens") / BLOCK), F.floor(F.col("block") / BLOCK)
    # kept, so that texts are encoded once
    counts = settle(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))).withColumn("block", block).withColumn("zone", zone)
    counts = counts.select("*", F.col("n_docs").alias("d"), (F.col("n_tokens") * F.col("n_docs")).alias("t"))
    sums = [F.sum("d").alias("d"), F.sum("t").alias("t")]
    blocks = counts.groupBy("zone", "block").agg(*sums)
    zones = blocks.groupBy("zone").agg(*sums).withColumn("top", F.lit(0))

    def later(df: DataFrame, part: str, order: str) -> list["F.Column"]:
        """Sums over what is longer within ``part``."""
        up = Window.partitionBy(part).orderBy(F.col(order).desc())
        return [(F.sum(c).over(up) - F.col(c)).alias(f"{order}_{c}") for c in "dt"]

    every = Window.partitionBy("top")
    zones = zones.select("zone", *later(zones, "top", "zone"), F.sum("d").over(every).alias("all_docs"), F.sum("t").over(every).alias("all_tokens"))
    blocks = blocks.select("zone", "block", *later(blocks, "zone", "block")).join(zones, "zone").drop("zone")
    out = counts.select("n_tokens", "n_docs", "block", "d", "t", *later(counts, "block", "n_tokens")).join(blocks, "block")
    docs, tokens = (F.col(c) + F.col(f"n_tokens_{c}") + F.col(f"block_{c}") + F.col(f"zone_{c}") for c in "dt")
    return out.select(
        "n_tokens",
        "n_docs",
        docs.alias("docs_at_least"),
        tokens.alias("tokens_at_least"),
        (F.col("all_tokens") - tokens + F.col("n_tokens") * docs).alias("total_if_cut"),
        (F.col("all_docs") - docs + F.col("n_docs")).alias("rank"),
    )


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """``share, n_tokens``: the smallest length that this share of documents doesn't exceed."""
    spark = hist.sparkSession
    wanted = spark.createDataFrame([(s,) for s in shares], "share double")
    all_docs = hist.agg(F.sum("n_docs").alias("all_docs"))
    return (
        hist.crossJoin(F.broadcast(all_docs))
        .join(F.broadcast(wanted), F.col("rank") >= F.col("share") * F.col("all_docs"))
        .groupBy("share")
        .agg(F.min("n_tokens").alias("n_tokens"))
    )
