"""Reading, writing and extending stored tables (IO1, IO2, IO10, IO11, S1, S2, S4, J7)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ratingmill.sources.shared import replace_partitions


def read_table(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    """A stored table under an explicit schema; Spark fails if the path is missing."""
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, fmt: str = "parquet", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def append_predictions(pred: DataFrame, path: str, keys: tuple[str, ...] = ("game_id",)) -> None:
    """Adds the predictions whose keys the log at ``path`` doesn't hold yet."""
    spark = pred.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        pred = new_rows(pred, spark.read.schema(pred.schema).parquet(path), keys)
    pred.write.mode("append").parquet(path)


def new_since(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows later than the last stored date; all of them if nothing is stored."""
    last = stored.agg(F.max("date").alias("last_date"))
    return incoming.join(F.broadcast(last), F.col("last_date").isNull() | (F.col("date") > F.col("last_date"))).drop("last_date")


def new_rows(incoming: DataFrame, stored: DataFrame, keys: tuple[str, ...] = ("game_id",)) -> DataFrame:
    return incoming.join(stored.select(*keys), list(keys), "left_anti")


def merge_games(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union with one row for a game, the stored one first; within one source the earliest."""
    both = old.withColumn("_rank", F.lit(0)).unionByName(new.withColumn("_rank", F.lit(1)))
    first = Window.partitionBy("game_id").orderBy("_rank", "date", "home_team_id", "away_team_id", "home_score", "away_score")
    return both.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_rank", "_n")


def replace_dates(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stored rows of the dates that ``new`` has give way to the new rows."""
    return old.join(new.select("date").distinct(), "date", "left_anti").unionByName(new)


def overwrite_dates(new: DataFrame, path: str) -> None:
    """``replace_dates`` in place, in a table that is partitioned by ``date``: the partitions of ``new`` are written over,
    no other file is touched (S2)."""
    replace_partitions(new, path, ["date"])


def id_diff(a: DataFrame, b: DataFrame, key: str = "game_id") -> DataFrame:
    """Ids of only one side: ``side`` is ``missing`` (in a, not in b) or ``extra``."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    only = lambda x, y, name: x.join(y, key, "left_anti").select(key, F.lit(name).alias("side"))
    return only(left, right, "missing").unionByName(only(right, left, "extra"))


def between(games: DataFrame, start: date | None = None, end: date | None = None, season_type: str | None = None) -> DataFrame:
    """Rows of a closed date range and a season type; plain filters, so that files are pruned."""
    for condition, value in (("date >= :v", start), ("date <= :v", end), ("season_type = :v", season_type)):
        if value is not None:
            games = games.where(F.expr(condition.replace(":v", f"'{value}'")))
    return games
