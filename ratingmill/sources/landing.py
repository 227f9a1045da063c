"""Landed JSON files as a stream of games, with what can't be used in quarantine (IO3, IO11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingmill.functions.parse import parse_date, season_start
from ratingmill.sources.shared import replace_partitions

#: A landed line; numbers are read as text, so that one bad field doesn't void the line.
LINE = "game_id string, date string, home_team_id string, away_team_id string, home_score string, away_score string, season_type string, _corrupt_record string"


def read_lines(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """A stream of the lines of the JSON files that land in ``folder``; a line that is no JSON is ``_corrupt_record``."""
    reader = spark.readStream.schema(LINE).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    return reader.option("maxFilesPerTrigger", files_a_batch).json(folder)


def checked(lines: DataFrame) -> DataFrame:
    """Lines with typed columns and the ``reason`` for which one can't be used, null if it can."""
    number = lambda c: F.col(c).try_cast("bigint")
    ids, scores = ("game_id", "home_team_id", "away_team_id"), ("home_score", "away_score")
    rows = lines.select("_corrupt_record", F.to_json(F.struct(*[c for c in lines.columns if c != "_corrupt_record"])).alias("line"), *[number(c).alias(c) for c in ids], parse_date(F.col("date")).alias("date"), *[number(c).alias(c) for c in scores], F.coalesce("season_type", F.lit("regular")).alias("season_type"))
    reason = F.when(F.col("_corrupt_record").isNotNull(), "no JSON")
    for c in (*ids, "date", *scores):
        reason = reason.when(F.col(c).isNull(), f"bad {c}")
    reason = reason.when((F.col("home_score") < 0) | (F.col("away_score") < 0), "negative score").when(F.col("home_team_id") == F.col("away_team_id"), "one team")
    return rows.withColumn("reason", reason).withColumn("line", F.coalesce("_corrupt_record", "line")).drop("_corrupt_record")


def land_games(path: str):
    """A ``foreachBatch`` function: good lines go to ``games`` under ``path``, by season, the others to ``quarantine`` with their
    reason. Both are partitioned by the batch, so that a batch that is repeated writes over itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = checked(batch).withColumn("batch", F.lit(batch_id).cast("long")).persist()
        good = rows.where("reason is null").drop("reason", "line").withColumn("season", season_start(F.col("date")))
        replace_partitions(good, f"{path}/games", ["batch", "season"])
        replace_partitions(rows.where("reason is not null").select("batch", "reason", "line"), f"{path}/quarantine", ["batch"])
        rows.unpersist()

    return write


def ingest(spark: SparkSession, folder: str, path: str, files_a_batch: int = 1000) -> int:
    """Takes in all files that have landed since the last call; returns how many lines it read."""
    query = read_lines(spark, folder, files_a_batch).writeStream.foreachBatch(land_games(path)).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p.numInputRows for p in query.recentProgress)
