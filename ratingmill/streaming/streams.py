"""Streaming twins of the daily increments (K1-K4)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ratingmill.operators.ratings import HISTORY, Fold, _fold_games, _usable, held_in_order, some_at_a_time, state_of
from ratingmill.operators.replay import Rating, RatingStore
from ratingmill.sources.ledger import merge_batch
from ratingmill.sources.tables import append_predictions


def stream_games(stream: DataFrame, delay: str = "7 days", key: str = "game_id", ts: str = "ts") -> DataFrame:
    """Each id once; copies and rows later than the watermark are dropped (K1)."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def stream_accuracy(stream: DataFrame, window: str = "7 days", slide: str | None = "1 day", delay: str = "7 days") -> DataFrame:
    """Trailing accuracy of ``ts, correct`` rows; tumbling without a slide (K2). In batch mode the watermark does nothing."""
    on = stream.withWatermark("ts", delay) if stream.isStreaming else stream
    t = on.groupBy(F.window("ts", window, slide) if slide else F.window("ts", window)).agg(F.count("*").alias("games"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
    return t.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "games", "accuracy")


_STATE = "teams array<long>, ratings array<double>, games array<long>, season long, last_date date"


def stream_ratings(stream: DataFrame, k: float = 20, home_advantage: float = 20, use_mov: bool = True, reversion: float = 0.75, base: float = 1500.0) -> DataFrame:
    """Team ratings with one state for each pool (K3). Games of one batch are folded in order. A game that
    isn't later than the pool's last date would need a replay; its rows come out as ``late``, without
    ratings (in batch: ``late_games``). ``rate_games`` replays them."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold, last = Fold(k, home_advantage, use_mov, reversion, base), None
        if state.exists:
            teams, ratings, games, season, last = state.get
            fold.rating, fold.games, fold.season = dict(zip(teams, ratings, strict=True)), dict(zip(teams, games, strict=True)), season
        new = held_in_order(batches)
        if last is not None:
            late, new = new[new["date"] <= pd.Timestamp(last)], new[new["date"] > pd.Timestamp(last)]
            none = dict.fromkeys(["rating_before", "rating_after", "rating_change", "expected_score"], math.nan)
            for part in some_at_a_time(late):
                yield _fold_games(Fold(k, home_advantage, use_mov, reversion, base), part).assign(**none, late=True)
        for part in some_at_a_time(new):
            yield _fold_games(fold, part).assign(late=False)
        if len(new):
            teams = list(fold.rating)
            state.update(([int(t) for t in teams], [float(fold.rating[t]) for t in teams], [int(fold.games[t]) for t in teams], int(fold.season), new["date"].max().date()))

    return _usable(stream).groupBy("pool").applyInPandasWithState(run, f"{HISTORY}, late boolean", _STATE, "append", GroupStateTimeout.NoTimeout)


#: State of a pool and of each of its teams; ``seasons`` counts the pool's seasons up to then.
POOL_STATE, TEAM_STATE = "season long, seasons long, last_date date", "rating double, games long, seasons long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class PoolRatings(StatefulProcessor):
    """Ratings of a pool with a map from teams to their state: a batch reads and writes the teams that play in it, no others.

    What a season's start takes from the ratings of teams that don't play is caught up with when they do: a team's state
    says at which of the pool's seasons it stands, and the step towards the base is applied as often as it has missed."""

    def __init__(self, rating: Rating):
        self.rating = rating

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.teams = handle.getMapState("teams", "team_id long", TEAM_STATE)
        self.pool = handle.getValueState("pool", POOL_STATE)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803  Spark's names
        """Rows of ``initial_states``."""
        for r in initialState.itertuples():
            self.teams.updateValue((int(r.team_id),), (float(r.rating), int(r.games), int(r.team_seasons)))
        self.pool.update((int(r.season), int(r.seasons), r.last_date))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new, fold = held_in_order(rows), self.rating.fold()
        season, seasons, last = self.pool.get() if self.pool.exists() else (None, 0, None)
        if last is not None:
            late, new = new[new["date"] <= pd.Timestamp(last)], new[new["date"] > pd.Timestamp(last)]
            none = dict.fromkeys(["rating_before", "rating_after", "rating_change", "expected_score"], math.nan)
            for part in some_at_a_time(late):
                yield _fold_games(self.rating.fold(), part).assign(**none, late=True)
        if not len(new):
            return
        for team in set(new["home_team_id"].unique().tolist()) | set(new["away_team_id"].unique().tolist()):
            if self.teams.containsKey((team,)):
                value, games, then = self.teams.getValue((team,))
                fold.rating[team] = self.rating.base + (value - self.rating.base) * self.rating.reversion ** (seasons - then)
                fold.games[team] = games
        fold.season = season
        for part in some_at_a_time(new):
            yield _fold_games(fold, part).assign(late=False)
        days = new["date"]
        seasons += len(set((days.dt.year - (days.dt.month < 10)).unique().tolist()) - {season})
        for team, value in fold.rating.items():
            self.teams.updateValue((int(team),), (float(value), int(fold.games[team]), int(seasons)))
        self.pool.update((int(fold.season), int(seasons), days.max().date()))

    def close(self) -> None:
        pass


def initial_states(history: DataFrame) -> DataFrame:
    """What a stream starts from after a history: each team's last state (``state_of``), with the number of the pool's seasons
    up to it (``team_seasons``) and up to now."""
    season = F.year("date") - F.when(F.month("date") < 10, 1).otherwise(0)
    known = history.select("pool", season.cast("long").alias("own_season")).distinct()
    known = known.withColumn("team_seasons", F.row_number().over(Window.partitionBy("pool").orderBy("own_season")).cast("long"))
    every = known.groupBy("pool").agg(F.max("team_seasons").alias("seasons"))
    state = state_of(history).withColumnRenamed("last_season", "season")
    return state.join(known, ["pool", "own_season"]).join(every, "pool").select("pool", "team_id", "rating", "games", "team_seasons", "season", "seasons", "last_date")


def stream_team_states(stream: DataFrame, rating: Rating = Rating(), initial: DataFrame | None = None) -> DataFrame:  # noqa: B008  frozen
    """Team ratings with a keyed state for each team (K3), from ``initial`` (``initial_states``) on. Rows and late games as in
    ``stream_ratings``. Needs the state store ``ROCKS`` in ``spark.sql.streaming.stateStore.providerClass`` when it starts."""
    grouped = None if initial is None else initial.groupBy("pool")
    schema = stream.sparkSession.createDataFrame([], f"{HISTORY}, late boolean").schema
    return _usable(stream).groupBy("pool").transformWithStateInPandas(PoolRatings(rating), schema, "Append", "None", grouped)


def rate_games(path: str):
    """A ``foreachBatch`` function that takes a batch of games into the rating store at ``path``, late ones too (K3)."""

    def write(batch: DataFrame, _: int) -> None:
        RatingStore(batch.sparkSession, path).add(batch)

    return write


def merge_predictions(path: str, writer: str):
    """A ``foreachBatch`` function that completes and corrects the log at ``path``, each batch of ``writer`` once (K4)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        merge_batch(batch, path, writer, batch_id)

    return write


def upsert_predictions(path: str):
    """A ``foreachBatch`` function that adds a batch's unknown games to the log at ``path`` (K4)."""

    def write(batch: DataFrame, _: int) -> None:
        append_predictions(batch, path)

    return write
