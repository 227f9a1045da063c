"""A corpus pipeline of five stages; each stage's result is the next one's ``docs``.

Quality classifier, n-gram Jaccard join, benchmark decontamination, personal data, byte-level BPE.
All stages but the last return the columns of ``documents``; rows that a stage rejects are gone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingmill.llm import bpe, decontam, jaccard, pii, quality
from ratingmill.llm.base import drop, settle, small, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near copies: five-word shingles, similarity of 0.8 or more.
NEAR_WIDTH, NEAR_PERCENT = 5, 80
#: Ids up to which their table is broadcast.
BROADCAST_ROWS = 1_000_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier doesn't reject."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, COLUMNS, model).where("predicted = 1").select(*COLUMNS)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: that of the smallest ``doc_id`` (null last), then of
    the smallest hash of the text. Rows without words have no group and stay. Drops go by ``doc_id``
    and text together, so that repeated and null ids don't take other texts along."""
    docs = docs.select(*COLUMNS, F.xxhash64("text").alias("mark"))
    found = settle(jaccard.groups(docs, NEAR_WIDTH, NEAR_PERCENT, keep=("mark",)).where("group is not null"))
    row = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "mark")
    first = found.groupBy("group").agg(F.min(row).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    held = settle(found.join(small(settle(first), BROADCAST_ROWS), "group").select("doc_id", "mark", (row == F.col("first")).alias("stays")))
    same = lambda other: F.col("doc_id").eqNullSafe(other["gone_id"]) & (F.col("mark") == other["gone_mark"])
    ids = lambda df: df.select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark"))
    gone = small(settle(ids(held.where("not stays")).distinct()), BROADCAST_ROWS)
    # texts stay where they lie as long as the ids are few
    kept = docs.join(gone, same(gone), "left_anti")
    again = settle(ids(held.where("stays").groupBy("doc_id", "mark").count().where("count > 1")))
    if not again.isEmpty():  # rows that repeat the one that stays
        few = small(again, BROADCAST_ROWS)
        kept = kept.join(few, same(few), "left_anti").unionByName(kept.join(few, same(few), "left_semi").dropDuplicates(["doc_id", "mark"]))
    return kept.select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item."""
    return decontam.search(docs, COLUMNS, table(spark, sf_dir, "benchmark")).where("not contaminated").select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by tags; ``n_chars`` follows the text."""
    found = pii.find(docs, ["doc_id", "lang", "source"], redacted="text")
    return found.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts and decodes the ids; ``ids`` has the tokens."""
    return bpe.encode(docs, ["doc_id", "lang", "source"], *bpe.vocabulary(), ids=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_copies_stage),
    ("benchmark decontamination", decontamination_stage),
    ("personal data", pii_stage),
    ("byte-level BPE", encoding_stage),
]
#: The classifier and the encoder have no SQL form; a brute-force version tests the pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result kept until the next one's is."""
    docs, kept = table(spark, sf_dir, "documents"), []
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs)
            drop(*kept)
            kept = [docs]
    return docs
