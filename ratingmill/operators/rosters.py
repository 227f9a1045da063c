"""Roster and injury figures of each team as of each of its games (R5, R7 with dates).

Everything that changes a roster is an event: a player's first game for a team, which ends any earlier
membership, the rating after each game, an absence that begins or ends. Events and games go into one stream for each
team, by date, and are swept once: no range join, one exchange. On a date, absences come first, then the team's game,
then what that game has changed, so that no figure knows of its own game or a later one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratingmill.operators.ratings import BASE

#: Order of events of one date.
ABSENCE, GAME, CHANGE = 0, 1, 2
#: What a point below the mean costs by rank, and the most that one player and all cost; fixed values.
RANKS, ONE, ALL = ((3, 1.5), (7, 1.0), (10, 0.5)), -80.0, -150.0


def events(ratings: DataFrame, absences: DataFrame) -> DataFrame:
    """``team_id, date, turn, nth, player_id, rating, away``: changes of rosters; ``nth`` orders those of one date. ``ratings`` has a row for each game of
    a player (``player_id, team_id, date, game_id, rating_after``), ``absences`` has ``player_id, team_id, start_date, end_date``
    (the first day back; null if open)."""
    none = lambda kind: F.lit(None).cast(kind)
    order = Window.partitionBy("player_id").orderBy("date", "game_id")
    rated = ratings.withColumn("before", F.lag("team_id").over(order))
    side = lambda df, team, date, turn, nth, rating, away: df.select(team.alias("team_id"), date.alias("date"), F.lit(turn).alias("turn"), nth.alias("nth"), "player_id", rating.alias("rating"), away.alias("away"))
    out = side(rated, F.col("team_id"), F.col("date"), CHANGE, F.col("game_id"), F.col("rating_after"), none("int"))
    left = rated.where("before <> team_id")
    out = out.unionByName(side(left, F.col("before"), F.col("date"), CHANGE, F.col("game_id"), none("double"), none("int")))
    for column, step in (("start_date", 1), ("end_date", -1)):
        out = out.unionByName(side(absences.where(F.col(column).isNotNull()), F.col("team_id"), F.col(column), ABSENCE, none("long"), none("double"), F.lit(step)))
    return out


def figures(ranked: list[tuple[float, bool]], n: int) -> tuple[float, float]:
    """Weighted mean of the best ``n`` that are there, and what the absent cost; ``ranked`` has rating and absence, best first."""
    there = [r for r, away in ranked if not away][:n]
    weights = [1 - 0.05 * k for k in range(len(there))]
    elo = sum(r * w for r, w in zip(there, weights, strict=True)) / sum(weights) if there else BASE
    top = [r for r, _ in ranked[:10]]
    mean, cost = sum(top) / len(top) if top else BASE, 0.0
    for rank, (r, away) in enumerate(ranked, 1):
        if away:
            cost += max(ONE, -(r - mean) / 10 * next((f for edge, f in RANKS if rank <= edge), 0.25))
    return elo, round(max(ALL, cost), 7)  # players at the mean cost nothing


def roster_figures(games: DataFrame, ratings: DataFrame, absences: DataFrame, n: int = 10) -> DataFrame:
    """``game_id, team_id, roster_elo, injury_adjustment`` for both teams of each of ``games``. Players are on the team of their latest
    game before; equal ratings go by player id. A team without players has the base rating."""
    asks = games.select("game_id", "date", F.explode(F.array("home_team_id", "away_team_id")).alias("team_id"))
    asks = asks.select("team_id", "date", F.lit(GAME).alias("turn"), "game_id", *[F.lit(None).cast(t).alias(c) for c, t in (("nth", "long"), ("player_id", "long"), ("rating", "double"), ("away", "int"))])
    rows = events(ratings, absences).withColumn("game_id", F.lit(None).cast("long")).unionByName(asks)
    # a date's changes in the order of its games
    rows = rows.repartition("team_id").sortWithinPartitions("team_id", "date", "turn", "nth", F.col("rating").asc_nulls_first(), "player_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        held: list[tuple] = []
        for team, own in groupby(each(), itemgetter(0)):
            rating: dict[int, float] = {}
            away: dict[int, int] = {}
            for _, game, player, value, step in own:
                if game is not None:
                    ranked = sorted(((r, -p) for p, r in rating.items()), reverse=True)
                    held.append((game, team, *figures([(r, away.get(-p, 0) > 0) for r, p in ranked], n)))
                elif step is not None:
                    away[player] = away.get(player, 0) + step
                elif value is None:
                    rating.pop(player, None)
                else:
                    rating[player] = value
                if len(held) == 10_000:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in held])
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in held])

    names = ["game_id", "team_id", "roster_elo", "injury_adjustment"]
    return rows.select("team_id", "game_id", "player_id", "rating", "away").mapInArrow(run, "game_id long, team_id long, roster_elo double, injury_adjustment double")
