"""Landed JSON feeds as flat tables (IO3-IO9): explicit schemas, explodes, no Python per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingmill.functions.parse import game_key, made_attempted, minutes
from ratingmill.operators.games import small_side
from ratingmill.sources import schemas as S


def _json(raw: DataFrame, schema, column: str = "value") -> DataFrame:
    return raw.select(F.from_json(F.col(column), schema).alias("j"))


def parse_scoreboard(raw: DataFrame) -> DataFrame:
    """Games of a scoreboard: exactly two competitors, one at home; a tie has no winner."""
    e = _json(raw, S.SCOREBOARD).select(F.explode("j.events").alias("e")).where(F.size("e.competitors") == 2)
    side = lambda s: F.get(F.filter("e.competitors", lambda c: c.homeAway == s), F.lit(0))
    e = e.select("e.id", "e.date", "e.season", side("home").alias("h"), side("away").alias("a")).where("h is not null and a is not null")
    hs, as_ = F.expr("try_cast(h.score as bigint)"), F.expr("try_cast(a.score as bigint)")
    return e.select(
        F.col("id").alias("game_id"),
        F.to_date(F.substring("date", 1, 10)).alias("date"),
        F.col("h.team.id").alias("home_team_id"),
        F.col("h.team.displayName").alias("home_team_name"),
        F.col("a.team.id").alias("away_team_id"),
        F.col("a.team.displayName").alias("away_team_name"),
        hs.alias("home_score"),
        as_.alias("away_score"),
        F.when(hs > as_, F.col("h.team.id")).when(as_ > hs, F.col("a.team.id")).alias("winner_team_id"),
        F.when(F.col("season.type") == 3, "playoff").otherwise("regular").alias("season_type"),
    )


def parse_boxscore(raw: DataFrame) -> DataFrame:
    """One row for each player of a box score, its stats looked up by their labels."""
    t = _json(raw, S.BOXSCORE_FEED).select("j.game_id", F.explode("j.teams").alias("t"))
    g = t.select("game_id", "t.team", F.explode("t.statistics").alias("g"))
    p = g.select("game_id", "team", F.col("g.labels").alias("labels"), F.explode("g.athletes").alias("p"))
    n = F.least(F.size("labels"), F.size("p.stats"))
    p = p.withColumn("m", F.map_from_arrays(F.slice("labels", F.lit(1), F.greatest(n, F.lit(0))), F.slice("p.stats", F.lit(1), F.greatest(n, F.lit(0)))))
    stat = lambda k: F.coalesce(F.try_element_at("m", F.lit(k)).try_cast("bigint"), F.lit(0))
    pair = lambda k: made_attempted(F.try_element_at("m", F.lit(k)))
    out = [
        "game_id",
        F.col("team.id").alias("team_id"),
        F.col("team.displayName").alias("team_name"),
        F.col("p.athlete.id").alias("player_id"),
        F.col("p.athlete.displayName").alias("player_name"),
        F.coalesce("p.starter", F.lit(False)).alias("starter"),
        F.coalesce("p.didNotPlay", F.lit(False)).alias("didNotPlay"),
        minutes(F.try_element_at("m", F.lit("MIN"))).alias("minutes"),
        stat("PTS").alias("points"),
    ]
    for label, name in (("FG", "fg"), ("3PT", "fg3"), ("FT", "ft")):
        made, attempted = pair(label)
        out += [made.alias(f"{name}_made"), attempted.alias(f"{name}_attempted")]
    for label, name in (("REB", "rebounds"), ("OREB", "offensive_rebounds"), ("DREB", "defensive_rebounds"), ("AST", "assists"), ("STL", "steals"), ("BLK", "blocks"), ("TO", "turnovers"), ("PF", "fouls")):
        out.append(stat(label).alias(name))
    plus = F.regexp_replace(F.try_element_at("m", F.lit("+/-")), r"^\+", "").try_cast("bigint")
    return p.select(*out, F.coalesce(plus, F.lit(0)).alias("plus_minus"))


def parse_schedule(raw: DataFrame, crosswalk: DataFrame, start: str, end: str) -> DataFrame:
    """Finished games (status 3) of a date range between teams that ``crosswalk`` (``code``, ``team_id``) knows. The visitor wins
    a game that the home side doesn't; a game without an id is named by date and teams."""
    d = _json(raw, S.SCHEDULE_FEED).select(F.explode("j.gameDates").alias("d"))
    g = d.select(F.to_date(F.substring("d.gameDate", 1, 10), "MM/dd/yyyy").alias("date"), F.explode("d.games").alias("g"))
    g = g.where((F.col("g.gameStatus") == 3) & F.col("date").between(start, end)).where("not (g.homeTeam.score = 0 and g.awayTeam.score = 0)")
    team = lambda s: small_side(crosswalk.select(F.col("code").alias(f"{s}_code"), F.col("team_id").alias(f"{s}_team_id")))
    g = g.select("date", F.col("g.gameId").alias("game_id"), F.col("g.homeTeam.teamTricode").alias("home_code"), F.col("g.awayTeam.teamTricode").alias("away_code"), F.col("g.homeTeam.score").alias("home_score"), F.col("g.awayTeam.score").alias("away_score"))
    return g.join(team("home"), "home_code").join(team("away"), "away_code").select(
        F.coalesce("game_id", game_key(F.col("date"), F.col("home_team_id"), F.col("away_team_id"))).alias("game_id"), "date", "home_team_id", "away_team_id", "home_score", "away_score",
        F.when(F.col("home_score") > F.col("away_score"), F.col("home_team_id")).otherwise(F.col("away_team_id")).alias("winner_team_id"),
    )


def pair_team_rows(rows: DataFrame) -> DataFrame:
    """Two team rows (``game_id, date, team_id, matchup, points``) to one game; ``@`` marks the visitor.
    Games that lack a side are dropped; the visitor wins a game that the home side doesn't."""
    away = F.contains("matchup", F.lit("@"))
    pick = lambda at, c: F.max(F.when(away if at else ~away, F.col(c)))
    games = rows.groupBy("game_id").agg(
        F.max("date").alias("date"),
        pick(False, "team_id").alias("home_team_id"),
        pick(True, "team_id").alias("away_team_id"),
        pick(False, "points").alias("home_score"),
        pick(True, "points").alias("away_score"),
    )
    games = games.dropna(subset=["home_team_id", "away_team_id", "home_score", "away_score"])
    return games.withColumn("winner_team_id", F.when(F.col("home_score") > F.col("away_score"), F.col("home_team_id")).otherwise(F.col("away_team_id")))


def parse_injuries(raw: DataFrame, include_questionable: bool = False) -> DataFrame:
    wanted = ["out", "doubtful"] + ["questionable"] * include_questionable
    t = _json(raw, S.INJURY_FEED).select(F.col("j.date").alias("date"), F.explode("j.teams").alias("team_id", "t"))
    i = t.select("date", "team_id", F.explode("t.injuries").alias("i"))
    return i.select("date", "team_id", "i.player_name", F.lower(F.trim("i.status")).alias("status")).where(F.col("status").isin(wanted))


def parse_odds(raw: DataFrame, market: str = "h2h") -> DataFrame:
    b = _json(raw, S.ODDS_FEED).select("j.id", "j.home_team", "j.away_team", F.explode("j.bookmakers").alias("b"))
    m = b.select("id", "home_team", "away_team", F.col("b.key").alias("book"), F.explode("b.markets").alias("m")).where(F.col("m.key") == market)
    o = m.select("id", "home_team", "away_team", "book", F.explode("m.outcomes").alias("o"))
    return o.select(F.col("id").alias("game_id"), "home_team", "away_team", "book", F.col("o.name").alias("outcome"), F.col("o.price").alias("price"))


def quarter_lines(rows: DataFrame) -> DataFrame:
    """Team lines (``game_id, is_home, q1..q4, total``) to one row for a game. A game with a missing or
    non-positive quarter is rejected; overtime is what the total has beyond the quarters."""
    quarters = [f"q{k}" for k in range(1, 5)]
    bad = F.lit(False)
    for q in quarters:
        bad = bad | F.coalesce(F.col(q) <= 0, F.lit(True))
    ot = F.greatest(F.lit(0), F.col("total") - sum((F.col(q) for q in quarters[1:]), F.col("q1")))
    rows = rows.withColumn("bad", bad).withColumn("ot", ot)
    pick = [F.max(F.when(F.col("is_home") == (s == "home"), F.col(c))).alias(f"{s}_{c}") for s in ("home", "away") for c in [*quarters, "ot"]]
    games = rows.groupBy("game_id").agg(F.max("bad").alias("bad"), F.count_distinct("is_home").alias("sides"), *pick)
    return games.where("not bad and sides = 2").drop("bad", "sides")
