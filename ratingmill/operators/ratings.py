"""Rating jobs (R1-R10, R22): team and player ratings and what rosters add to them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratingmill.operators.games import small_side

BASE = 1500.0
HISTORY = (
    "game_id long, pool long, date date, team_id long, opponent_id long, is_home boolean, team_score long, opponent_score long, won boolean, "
    "rating_before double, rating_after double, rating_change double, expected_score double"
)
STATE = "pool long, team_id long, rating double, games long, last_date date, last_season long"


class Fold:
    """Ratings of one pool, game after game in order of date and id.

    At the first game of a new season (October) every known team goes back towards the base."""

    def __init__(self, k: float, home_advantage: float, use_mov: bool, reversion: float, base: float):
        self.k, self.home_advantage, self.use_mov, self.reversion, self.base = k, home_advantage, use_mov, reversion, base
        self.rating: dict[int, float] = {}
        self.games: dict[int, int] = {}
        self.season: int | None = None

    def game(self, season: int, home: int, away: int, home_score: int, away_score: int) -> tuple[float, float, float, float]:
        """Both ratings before the game, the home side's change and expectation."""
        if self.season is not None and season != self.season:
            for team, r in self.rating.items():
                self.rating[team] = self.reversion * r + (1 - self.reversion) * self.base
        self.season = season
        h, a = self.rating.get(home, self.base), self.rating.get(away, self.base)
        expected = 1 / (1 + 10 ** ((a - h - self.home_advantage) / 400))
        played = (self.games.get(home, 0) + self.games.get(away, 0)) / 2
        early = min(1.2, max(1.0, 1.2 - 0.2 * played / 82))
        level = min(1.15, max(0.9, 1 + 0.1 * ((h + a) / 2 - 1500) / 500))
        mov = math.log(abs(home_score - away_score) + 1) / math.log(15) if self.use_mov else 1.0
        change = self.k * early * level * mov * ((home_score > away_score) - expected)
        self.rating[home], self.rating[away] = h + change, a - change
        self.games[home], self.games[away] = self.games.get(home, 0) + 1, self.games.get(away, 0) + 1
        return h, a, change, expected


def _fold_games(fold: Fold, games: pd.DataFrame) -> pd.DataFrame:
    games = games.sort_values(["date", "game_id"])
    day = pd.to_datetime(games["date"])
    season = (day.dt.year - (day.dt.month < 10)).tolist()
    steps = [fold.game(*x) for x in zip(season, games["home_team_id"].tolist(), games["away_team_id"].tolist(), games["home_score"].tolist(), games["away_score"].tolist(), strict=True)]
    h, a, change, expected = (list(x) for x in zip(*steps, strict=True)) if steps else ([], [], [], [])
    change, expected = pd.Series(change, dtype=float), pd.Series(expected, dtype=float)
    games = games.reset_index(drop=True)
    win = games["home_score"] > games["away_score"]
    out = []
    for own, other, before, sign, wins, chance in (("home", "away", h, 1, win, expected), ("away", "home", a, -1, ~win, 1 - expected)):
        out.append(
            pd.DataFrame(
                {
                    "game_id": games["game_id"], "pool": games["pool"], "date": games["date"],
                    "team_id": games[f"{own}_team_id"], "opponent_id": games[f"{other}_team_id"], "is_home": own == "home",
                    "team_score": games[f"{own}_score"], "opponent_score": games[f"{other}_score"], "won": wins,
                    "rating_before": before, "rating_after": pd.Series(before, dtype=float) + sign * change, "rating_change": sign * change, "expected_score": chance,
                }
            )
        )
    return pd.concat(out)


def held_in_order(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """One pool's games of a batch by date and id, as plain numbers: about 60 bytes a game."""
    games = pd.concat([b.assign(date=pd.to_datetime(b["date"])) for b in batches], ignore_index=True)
    return games.iloc[np.lexsort((games["game_id"], games["date"]))]


def some_at_a_time(games: pd.DataFrame, rows: int = 10_000) -> Iterator[pd.DataFrame]:
    """Slices of ``held_in_order`` for ``_fold_games``, whose rows are ten times as large as the games."""
    for at in range(0, len(games), rows):
        part = games.iloc[at : at + rows]
        yield part.assign(date=part["date"].dt.date)


def _usable(games: DataFrame) -> DataFrame:
    done = games.where("(home_score > 0 or away_score > 0) and date is not null")
    return done.select("game_id", "pool", "date", "home_team_id", "away_team_id", "home_score", "away_score")


def team_elo(games: DataFrame, k: float = 20, home_advantage: float = 20, use_mov: bool = True, reversion: float = 0.75, base: float = BASE) -> DataFrame:
    """Two history rows for each completed game (R1). The fold is sequential within a pool of teams
    that play each other; pools run in parallel. Games without a pool are a pool of their own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold, pool = None, None
        for batch in batches:
            for key, part in batch.groupby(batch["pool"].fillna(-1), sort=False):
                if fold is None or key != pool:
                    fold, pool = Fold(k, home_advantage, use_mov, reversion, base), key
                yield _fold_games(fold, part)

    # games stream by in order; a task holds the ratings of one pool and one batch of games
    ordered = _usable(games).repartition("pool").sortWithinPartitions("pool", "date", "game_id")
    return ordered.mapInPandas(run, HISTORY)


def state_of(hist: DataFrame) -> DataFrame:
    """Each team's state after a history: what an increment starts from."""
    last = hist.groupBy("pool", "team_id").agg(F.max_by("rating_after", F.struct("date", "game_id")).alias("rating"), F.count("*").alias("games"), F.max("date").alias("own"))
    when = hist.groupBy("pool").agg(F.max("date").alias("last_date"))
    season = F.year("last_date") - F.when(F.month("last_date") < 10, 1).otherwise(0)
    own = F.year("own") - F.when(F.month("own") < 10, 1).otherwise(0)
    return last.join(when, "pool").select("pool", "team_id", "rating", "games", "last_date", season.cast("long").alias("last_season"), own.cast("long").alias("own_season"))


def team_elo_increment(state: DataFrame, games: DataFrame, k: float = 20, home_advantage: float = 20, use_mov: bool = True, reversion: float = 0.75, base: float = BASE, seasons: DataFrame | None = None) -> DataFrame:
    """History rows of new games, folded onto a state (R2). ``state`` ratings are as of the pool's last
    season; ``state_of`` leaves teams that sat out seasons at their last rating, and ``seasons`` (``pool,
    season``: seasons with games so far) says how often they went back since. Games not later than
    the pool's last date are left out: they need a replay (see ``late_games``)."""
    held = state
    if seasons is not None:
        s = seasons.select("pool", "season").distinct()
        missed = state.select("pool", "team_id", "own_season").join(s, "pool").where("season > own_season").groupBy("pool", "team_id").count()
        held = state.join(missed, ["pool", "team_id"], "left").withColumn("rating", F.lit(base) + (F.col("rating") - base) * F.pow(F.lit(reversion), F.coalesce("count", F.lit(0))))
    held = held.select("pool", "team_id", "rating", "games", "last_date", "last_season")

    def run(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        fold = Fold(k, home_advantage, use_mov, reversion, base)
        if len(old):
            fold.rating = dict(zip(old["team_id"], old["rating"], strict=True))
            fold.games = dict(zip(old["team_id"], old["games"], strict=True))
            fold.season = int(old["last_season"].iloc[0])
            new = new[pd.to_datetime(new["date"]) > pd.to_datetime(old["last_date"].iloc[0])]
        return _fold_games(fold, new)

    return held.groupBy("pool").cogroup(_usable(games).groupBy("pool")).applyInPandas(run, HISTORY)


def late_games(state: DataFrame, games: DataFrame) -> DataFrame:
    """Games that come too late to be folded onto the state."""
    return games.join(state.select("pool", "last_date").distinct(), "pool").where("date <= last_date").drop("last_date")


def player_elo(box: DataFrame, k: float = 20, regression: float = 0.33, metric: str = "plus_minus", base: float = BASE) -> DataFrame:
    """Rating of each player after each game (R3), without a loop.

    A game's change never depends on a rating, and the yearly step towards the base is affine, so
    with c the number of a calendar year among those with games and q = 1 - regression, the rating
    is base + q^c times the running sum of the changes times q^-c: one window over a player's rows."""
    on = box.where("minutes > 0 and not didNotPlay")
    years = box.select(F.year("date").alias("year")).distinct()
    years = years.withColumn("c", F.dense_rank().over(Window.orderBy("year")) - 1)  # a row for each year
    limit = 10.0 if metric == "bpm" else 30.0
    value = F.col("bpm") if metric == "bpm" else F.col("plus_minus") / F.col("minutes") * 48
    perf = (F.greatest(F.lit(-limit), F.least(F.lit(limit), value)) + limit) / (2 * limit)
    q = 1 - regression
    on = on.withColumn("year", F.year("date")).join(F.broadcast(years), "year")
    on = on.withColumn("delta", k * F.least(F.lit(1.0), F.col("minutes") / 48) * (perf - 0.5))
    w = Window.partitionBy("player_id").orderBy("date", "game_id").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.col("delta") * F.pow(F.lit(q), -F.col("c"))).over(w)
    after = base + F.pow(F.lit(q), F.col("c")) * total
    return on.select("game_id", "date", "player_id", "team_id", "minutes", "plus_minus", "year", "c", (after - F.col("delta")).alias("rating_before"), after.alias("rating_after"), F.col("delta").alias("rating_change"))


# Names whose ratings box scores overstate (rim protectors) or understate (shot creators), and by how much.
RIM_PROTECTORS = [
    "Rudy Gobert", "Jarrett Allen", "Ivica Zubac", "Brook Lopez", "Mitchell Robinson", "Clint Capela", "Walker Kessler", "Mark Williams",
    "Isaiah Hartenstein", "Onyeka Okongwu", "Robert Williams III", "Precious Achiuwa", "Bismack Biyombo", "Nerlens Noel",
]
RIM_PROTECTOR_MULTIPLIER = 0.90
SHOT_CREATORS = ["Stephen Curry", "Steph Curry", "James Harden", "Damian Lillard", "Trae Young", "De'Aaron Fox", "Tyrese Haliburton", "LaMelo Ball"]
SHOT_CREATOR_MULTIPLIER = 1.08


def name_multipliers(players: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``player_id, position_multiplier`` of the ``players`` (``player_id, player_name``) whose name, letters of either case,
    is one of ``names`` (``player_name, position_multiplier``; of a repeated name the largest), by default the fixed ones (R4)."""
    if names is None:
        key = F.lower("player_name")
        fixed = F.when(key.isin([n.lower() for n in SHOT_CREATORS]), SHOT_CREATOR_MULTIPLIER).when(key.isin([n.lower() for n in RIM_PROTECTORS]), RIM_PROTECTOR_MULTIPLIER)
        found = players.select("player_id", fixed.alias("position_multiplier")).where("position_multiplier is not null")
    else:
        names = names.groupBy(F.lower("player_name").alias("name_key")).agg(F.max("position_multiplier").alias("position_multiplier"))
        found = players.select("player_id", F.lower("player_name").alias("name_key")).join(names, "name_key").drop("name_key")
    return found.groupBy("player_id").agg(F.max("position_multiplier").alias("position_multiplier"))


def player_ratings(history: DataFrame, multipliers: DataFrame | None = None, regression: float = 0.33, base: float = BASE) -> DataFrame:
    """Each player's rating as of the last year (R4), with the position's multiplier by name."""
    now = history.agg(F.max("c").alias("now"))
    last = history.groupBy("player_id").agg(F.max_by(F.struct("rating_after", "c", "year", "team_id"), F.struct("date", "game_id")).alias("x"), F.count("*").alias("games_played"))
    last = last.crossJoin(F.broadcast(now))  # one row
    raw = base + (F.col("x.rating_after") - base) * F.pow(F.lit(1 - regression), F.col("now") - F.col("x.c"))
    out = last.select("player_id", "games_played", F.col("x.team_id").alias("team_id"), F.col("x.year").alias("last_season"), raw.alias("raw_rating"))
    if multipliers is None:
        out = out.withColumn("position_multiplier", F.lit(1.0))
    else:
        out = out.join(small_side(multipliers.select("player_id", "position_multiplier")), "player_id", "left").fillna(1.0, ["position_multiplier"])
    return out.withColumn("rating", F.col("raw_rating") * F.col("position_multiplier"))


def _ranked(roster: DataFrame, ratings: DataFrame, default: float = BASE) -> DataFrame:
    """Roster rows with rating and rank in the team; ties go to the smaller player id."""
    rated = roster.join(ratings.select("player_id", "rating"), "player_id", "left").withColumn("rating", F.coalesce("rating", F.lit(default)))
    return rated.withColumn("rank", F.row_number().over(Window.partitionBy("team_id").orderBy(F.desc("rating"), "player_id")))


def healthy(roster: DataFrame, injured: DataFrame) -> DataFrame:
    """Roster without the injured, by name; players without a name stay."""
    names = injured.select("player_name").where("player_name is not null").distinct()
    return roster.join(names, "player_name", "left_anti")


def roster_elo(roster: DataFrame, ratings: DataFrame, injured: DataFrame | None = None, n: int = 10) -> DataFrame:
    """Weighted mean of the team's best ``n`` healthy players (R5): weight 1 - 0.05 for each rank."""
    on = _ranked(roster if injured is None else healthy(roster, injured), ratings).where(F.col("rank") <= n)
    weight = 1 - 0.05 * (F.col("rank") - 1)
    out = on.groupBy("team_id").agg((F.sum(F.col("rating") * weight) / F.sum(weight)).alias("roster_elo"))
    return roster.select("team_id").distinct().join(out, "team_id", "left").withColumn("roster_elo", F.coalesce("roster_elo", F.lit(BASE)))


def hybrid_rating(team: DataFrame, roster: DataFrame, blend: float = 0.75) -> DataFrame:
    out = team.join(roster, "team_id", "left")
    return out.withColumn("hybrid", blend * F.col("rating") + (1 - blend) * F.coalesce("roster_elo", F.lit(BASE)))


def injury_adjustment(roster: DataFrame, ratings: DataFrame, injured: DataFrame) -> DataFrame:
    """Points that each team loses by its injured players (R7), and how many of each role are out."""
    ranked = _ranked(roster, ratings)
    mean = ranked.where("rank <= 10").groupBy("team_id").agg(F.avg("rating").alias("mean"))
    out = ranked.join(injured.select("player_name").distinct(), "player_name", "left_semi").join(mean, "team_id")
    factor = F.when(F.col("rank") <= 3, 1.5).when(F.col("rank") <= 7, 1.0).when(F.col("rank") <= 10, 0.5).otherwise(0.25)
    own = F.greatest(F.lit(-80.0), -(F.col("rating") - F.col("mean")) / 10 * factor)
    role = lambda lo, hi, name: F.count_if(F.col("rank").between(lo, hi)).alias(name)
    found = out.groupBy("team_id").agg(F.greatest(F.lit(-150.0), F.sum(own)).alias("injury_adjustment"), role(1, 3, "stars_out"), role(4, 7, "starters_out"), role(8, 10, "rotation_out"), role(11, 10**6, "bench_out"))
    return roster.select("team_id").distinct().join(found, "team_id", "left").fillna(0)


def injury_impact(roster: DataFrame, ratings: DataFrame, injured: DataFrame) -> DataFrame:
    """Roster rating with all players and without the injured."""
    full, now = roster_elo(roster, ratings), roster_elo(roster, ratings, injured)
    out = full.withColumnRenamed("roster_elo", "full_elo").join(now.withColumnRenamed("roster_elo", "injured_elo"), "team_id")
    return out.withColumn("impact", F.col("injured_elo") - F.col("full_elo"))


def player_impact(injured: DataFrame, ratings: DataFrame, share: float = 0.3, default: float = BASE) -> DataFrame:
    """What each injured player's absence costs by rating alone."""
    out = injured.join(ratings.select("player_id", "rating"), "player_id", "left").withColumn("rating", F.coalesce("rating", F.lit(default)))
    return out.withColumn("player_impact", (F.col("rating") - BASE) * share)


def concentration(roster: DataFrame, ratings: DataFrame) -> DataFrame:
    """How much a team leans on its best player."""
    r = roster.join(ratings.select("player_id", "rating"), "player_id")
    r = r.withColumn("rank", F.row_number().over(Window.partitionBy("team_id").orderBy(F.desc("rating"), "player_id")))
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("rating")))
    t = r.groupBy("team_id").agg(at(1).alias("top_player_elo"), F.coalesce(at(2), F.lit(BASE)).alias("second_player_elo"), F.avg("rating").alias("mean"), F.avg(F.when(F.col("rank") <= 5, F.col("rating"))).alias("five"))
    top = F.col("top_player_elo")
    share = F.when(top >= 2000, 0.4).when(top >= 1900, 0.3).otherwise(0.2)
    t = t.withColumn("top_player_bonus", (top - F.col("mean")) * share).withColumn("concentration_risk", F.least((top - F.col("second_player_elo")) / 200, F.lit(1.0)))
    t = t.withColumn("top_5_depth", F.col("five") - 1500).withColumn("concentration_ratio", (top - F.col("mean")) / F.col("mean")).withColumn("team_has_superstar", top >= 2000)
    kind = F.when(F.col("concentration_risk") > 0.6, "Star-Dependent").when(F.col("concentration_risk") > 0.3, "Top-Heavy").otherwise("Balanced")
    depth = F.when(F.col("top_5_depth") > 200, "Elite").when(F.col("top_5_depth") > 100, "Good").when(F.col("top_5_depth") > 0, "Average").otherwise("Poor")
    return t.withColumn("construction_type", kind).withColumn("depth_rating", depth).drop("mean", "five")


def with_concentration(pred: DataFrame, metrics: DataFrame) -> DataFrame:
    """Beside each game what bonus and depth add to either side, and its risk; 0 for unknown teams."""
    for s in ("home", "away"):
        m = metrics.select(F.col("team_id").alias(f"{s}_team_id"), (F.col("top_player_bonus") + 0.1 * F.col("top_5_depth")).alias(f"{s}_add"), F.col("concentration_risk").alias(f"{s}_risk"))
        pred = pred.join(small_side(m), f"{s}_team_id", "left").fillna(0.0, [f"{s}_add", f"{s}_risk"])
    return pred


def apply_concentration(pred: DataFrame, metrics: DataFrame) -> DataFrame:
    """Ratings with bonus and depth of both teams, and the confidence that their risk leaves."""
    pred = with_concentration(pred, metrics)
    for s in ("home", "away"):
        pred = pred.withColumn(f"{s}_adjusted", F.col(f"{s}_rating") + F.col(f"{s}_add"))
    risk = F.when(F.col("home_win_prob") > 0.5, F.col("home_risk")).otherwise(F.col("away_risk"))
    return pred.withColumn("adjusted_confidence", F.col("confidence") * (1 - 0.2 * risk)).drop("home_add", "away_add")


def infer_roster(box: DataFrame, days: int = 30) -> DataFrame:
    """Players of each team's rows in the ``days`` days up to the team's last game."""
    last = box.groupBy("team_id").agg(F.max("date").alias("last_date"))
    return box.join(last, "team_id").where(F.col("date") >= F.date_sub("last_date", days)).select("player_id", "team_id").distinct()
