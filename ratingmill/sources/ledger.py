"""A log of predictions that later batches complete and correct."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingmill.operators.games import small_side
from ratingmill.sources.shared import delete, exists, replace_partitions, stage


def merge_batch(batch: DataFrame, path: str, writer: str, batch_id: int, key: str = "game_id", part: str = "date") -> bool:
    """Merges ``batch`` into the log under ``path``: known keys take the batch's values where it has any, new ones are added.

    Only the partitions (by ``part``) that hold a key of the batch before or after are read whole and written
    over; to find them, the log's keys are scanned. A ledger of batches tells which have been taken in; such a
    batch changes nothing (False). The ledger is written last, and a merge that is repeated gives the same rows, so that each batch counts
    once. Of rows of one key in a batch the one with most values counts, then the greatest."""
    spark, log, ledger = batch.sparkSession, f"{path}/log", f"{path}/ledger"
    if exists(spark, ledger) and not spark.read.parquet(ledger).where((F.col("writer") == writer) & (F.col("batch_id") == batch_id)).isEmpty():
        return False
    values = [c for c in batch.columns if c != key]
    filled = sum((F.col(c).isNotNull().cast("int") for c in values), F.lit(0))
    new = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*values), F.struct(filled, *values)).alias("x")).select(key, "x.*")
    new = stage(new, path)
    if exists(spark, log):
        old = spark.read.schema(batch.schema).parquet(log)
        where = old.join(small_side(new.select(key)), key, "left_semi").select(part)
        touched = stage(where.union(new.select(part)).where(F.col(part).isNotNull()).distinct(), path)
        held = old.join(small_side(touched), part, "left_semi")
        both = held.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
        merged = both.select(*[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in batch.columns])
        merged = stage(merged, path)
        replace_partitions(merged, log, [part])
        for (left,) in touched.join(merged.select(part).distinct(), part, "left_anti").collect():  # dates whose last game has moved
            delete(spark, f"{log}/{part}={left}")
    else:
        replace_partitions(new.select(*batch.columns), log, [part])
    spark.createDataFrame([(writer, batch_id)], "writer string, batch_id long").write.mode("append").parquet(ledger)
    return True
