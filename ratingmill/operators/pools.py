"""Pools of teams that play each other, where games don't tell them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingmill.operators.games import small_side
from ratingmill.sources.shared import shared_folder, stage


def team_pools(games: DataFrame) -> DataFrame:
    """``team_id, pool``: the connected components of teams over all their games; a pool is named by its smallest team.

    Games become distinct pairs of teams first, so that rounds go over pairs, not games. Every round joins each team to the
    smallest team that its neighbours know and then jumps to that team's own; rounds follow the logarithm of the longest chain."""
    folder = shared_folder(games.sparkSession)
    pairs = games.select(F.least("home_team_id", "away_team_id").alias("a"), F.greatest("home_team_id", "away_team_id").alias("b")).distinct()
    pairs = stage(pairs.where("a is not null and b is not null"), folder)
    both = stage(pairs.union(pairs.select("b", "a")).toDF("team_id", "other").distinct(), folder)
    label = both.groupBy("team_id").agg(F.least(F.min("other"), F.col("team_id")).alias("pool"))
    label = stage(label, folder)
    while True:
        known = label.select(F.col("team_id").alias("other"), F.col("pool").alias("near"))
        least = both.join(small_side(known), "other").groupBy("team_id").agg(F.min("near").alias("near"))
        new = label.join(least, "team_id").select("team_id", F.col("pool").alias("was"), F.least("pool", "near").alias("pool"))
        jump = label.select(F.col("team_id").alias("pool"), F.col("pool").alias("far"))
        new = stage(new.join(small_side(jump), "pool", "left").select("team_id", "was", F.least("pool", F.coalesce("far", "pool")).alias("pool")), folder)
        label = new.select("team_id", "pool")
        if new.where("was <> pool").isEmpty():
            return label


def find_pools(games: DataFrame) -> DataFrame:
    """``games`` with the pool that its home team is found in."""
    found = team_pools(games).withColumnRenamed("team_id", "home_team_id")
    return games.drop("pool").join(small_side(found), "home_team_id")
