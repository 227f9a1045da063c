"""Stored team ratings that take late and corrected games.

A store has the rating history by pool and season, and beside it each pool's state at the end of every season. New
games that are later than a pool's last one are folded onto its last state and appended. A game that comes too late, or
again with another score, can change every rating after it: its pool is folded anew from the state of the
season before, over the stored games from there on and the new ones, and those seasons of that pool are written over. Earlier seasons
and other pools are neither read nor written.

States are written before the history, and a batch leaves out games that the history has. So a batch that
is repeated after a failure, at whichever step, ends as if it had come once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingmill.operators.games import small_side
from ratingmill.operators.ratings import BASE, HISTORY, Fold, _fold_games, _usable
from ratingmill.sources.shared import exists, replace_partitions, stage

STATES = "pool long, season long, team_id long, rating double, games long, last_date date"
_ROWS = f"{HISTORY}, season long, games long, last_date date"
_KEYS = ["pool", "season"]


@dataclass(frozen=True)
class Rating:
    """Parameters of the fold."""

    k: float = 20
    home_advantage: float = 20
    use_mov: bool = True
    reversion: float = 0.75
    base: float = BASE

    def fold(self) -> Fold:
        return Fold(self.k, self.home_advantage, self.use_mov, self.reversion, self.base)


def season_of(date: str = "date") -> "F.Column":
    return (F.year(date) - F.when(F.month(date) < 10, 1).otherwise(0)).cast("long")


def fold_onto(states: DataFrame, games: DataFrame, rating: Rating = Rating()) -> DataFrame:  # noqa: B008  frozen
    """History rows of ``games`` folded onto ``states``, and the states at the end of each season that has games: those are
    rows without a ``game_id``. A pool's rows stream by in order, its state first; a task holds one pool's ratings."""
    at = games.select("pool", F.lit(1).alias("kind"), "date", "game_id", "home_team_id", "away_team_id", "home_score", "away_score", F.lit(None).cast("double").alias("rating"), F.lit(None).cast("long").alias("games"), season_of().alias("season"))
    held = states.select("pool", F.lit(0).alias("kind"), F.lit(None).cast("date").alias("date"), F.lit(None).cast("long").alias("game_id"), F.col("team_id").alias("home_team_id"), *[F.lit(None).cast("long").alias(c) for c in ("away_team_id", "home_score", "away_score")], "rating", "games", "season")
    rows = held.unionByName(at).repartition("pool").sortWithinPartitions("pool", "kind", "date", "game_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold, pool, last = None, None, None

        def state() -> pd.DataFrame:
            teams = list(fold.rating)
            return pd.DataFrame({"pool": pool, "season": fold.season, "team_id": teams, "rating_after": [fold.rating[t] for t in teams], "games": [fold.games[t] for t in teams], "last_date": last})

        for batch in batches:
            for key, part in batch.groupby("pool", sort=False):
                if fold is None or key != pool:
                    if last is not None:
                        yield state()
                    fold, pool, last = rating.fold(), key, None
                known = part[part["kind"] == 0]
                if len(known):
                    fold.rating.update(zip(known["home_team_id"].astype("int64"), known["rating"], strict=True))
                    fold.games.update(zip(known["home_team_id"].astype("int64"), known["games"].astype("int64"), strict=True))
                    fold.season = int(known["season"].iloc[0])
                for season, own in part[part["kind"] == 1].groupby("season"):
                    if last is not None and season != fold.season:
                        yield state()
                    for c in ("game_id", "home_team_id", "away_team_id", "home_score", "away_score"):
                        own = own.assign(**{c: own[c].astype("int64")})
                    yield _fold_games(fold, own).assign(season=season)
                    last = own["date"].max()
        if last is not None:
            yield state()

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split()[0] for c in _ROWS.split(",")]
        for out in run(batches):
            missing = {c: pd.Series([None] * len(out), index=out.index, dtype=object) for c in names if c not in out}
            yield out.assign(**missing)[names]

    return rows.mapInPandas(whole, _ROWS)


class RatingStore:
    """Rating history and season states under ``path``."""

    def __init__(self, spark: SparkSession, path: str, rating: Rating = Rating()):  # noqa: B008  frozen
        self.spark, self.path, self.rating = spark, path.rstrip("/"), rating

    def _read(self, name: str, schema: str) -> DataFrame:
        if not exists(self.spark, f"{self.path}/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def history(self) -> DataFrame:
        return self._read("history", f"{HISTORY}, season long")

    def states(self) -> DataFrame:
        return self._read("states", STATES)

    def suffix(self, since: DataFrame) -> DataFrame:
        """Stored games of the pools of ``since`` from its seasons on. Partitions before the earliest of these, and of other
        pools, aren't read."""
        first = since.agg(F.min("season")).first()[0]
        rows = self.history().where(F.col("is_home") & (F.col("season") >= (9999 if first is None else first)))
        kept = rows.join(small_side(since.select("pool", F.col("season").alias("first"))), "pool").where("season >= first")
        return kept.select("game_id", "pool", "date", F.col("team_id").alias("home_team_id"), F.col("opponent_id").alias("away_team_id"), F.col("team_score").alias("home_score"), F.col("opponent_score").alias("away_score"))

    def add(self, games: DataFrame) -> None:
        """Takes completed ``games`` in, on time or late; of a game that comes again the new score counts. Games of
        ``null`` pool need ``find_pools`` first. A date that moves to another season counts as a game of its own."""
        new = _usable(games).where("pool is not null").dropDuplicates(["game_id"]).withColumn("season", season_of())
        touched = new.groupBy("pool").agg(F.min("season").alias("season"), F.min("date").alias("first_date"))
        states = self.states()
        ends = states.groupBy("pool").agg(F.max("last_date").alias("last_date"), F.max("season").alias("last_season"))
        touched = stage(touched.join(ends, "pool", "left"), self.path)  # a row for each pool
        late = touched.where("last_date is not null and first_date <= last_date")
        old = self.suffix(late)
        same = ["game_id", "date", "home_team_id", "away_team_id", "home_score", "away_score"]
        known = old.select(*same, F.lit(True).alias("known"))
        fresh = new.join(known, same, "left").where("known is null").drop("known")
        fresh = stage(fresh, self.path)
        if fresh.isEmpty():
            return
        # pools whose late rows are all known already need nothing
        late = stage(late.drop("season").join(fresh.groupBy("pool").agg(F.min("season").alias("season")), "pool"), self.path)
        kept = self.suffix(late).join(fresh.select("game_id"), "game_id", "left_anti")
        replayed = small_side(late.select("pool", F.col("season").alias("since")))
        before = states.join(replayed, "pool").where("season < since")
        latest = before.groupBy("pool").agg(F.max("season").alias("season"))
        start = before.drop("since").join(small_side(latest), _KEYS)
        ontime = states.join(small_side(touched.select("pool", F.col("last_season").alias("season"))), _KEYS).join(replayed, "pool", "left_anti")
        out = stage(fold_onto(start.unionByName(ontime), _usable(fresh).unionByName(kept), self.rating), self.path)
        ends = out.where("game_id is null").select("pool", "season", "team_id", F.col("rating_after").alias("rating"), "games", "last_date")
        replace_partitions(ends, f"{self.path}/states", _KEYS)
        rows = out.where("game_id is not null").drop("games", "last_date")
        replace_partitions(rows.join(replayed, "pool", "left_semi"), f"{self.path}/history", _KEYS)
        rows.join(replayed, "pool", "left_anti").hint("rebalance", *[F.col(c) for c in _KEYS]).write.mode("append").partitionBy(*_KEYS).parquet(f"{self.path}/history")
