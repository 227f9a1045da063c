"""Projections, filters and joins over games (P*, J*, S3)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratingmill.functions.parse import season_label, season_start


def small_side(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` marked for broadcasting if a count shows at most ``rows`` rows; as it is otherwise."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def completed(games: DataFrame, rule: str = "any") -> DataFrame:
    """Games with a score: either side's (``any``) or both sides' (``both``)."""
    return games.where("home_score > 0 or away_score > 0" if rule == "any" else "home_score > 0 and away_score > 0")


def active_only(df: DataFrame, teams: DataFrame, key: str = "team_id") -> DataFrame:
    return df.join(teams.select(F.col("team_id").alias(key)), key, "left_semi")


def to_long(games: DataFrame) -> DataFrame:
    """Two team rows for each game, from one pass. A tie counts as a win of the visitor."""
    win = F.col("home_score") > F.col("away_score")
    extra = [c for c in ("pool", "season_type") if c in games.columns]

    def side(own: str, other: str, at_home: bool):
        return F.struct(
            F.col(f"{own}_team_id").alias("team_id"),
            F.col(f"{other}_team_id").alias("opponent_id"),
            F.lit(at_home).alias("is_home"),
            F.col(f"{own}_score").alias("team_score"),
            F.col(f"{other}_score").alias("opponent_score"),
            (F.col(f"{own}_score") - F.col(f"{other}_score")).alias("margin"),
            (win if at_home else ~win).alias("won"),
        )

    return games.select("game_id", "date", *extra, F.explode(F.array(side("home", "away", True), side("away", "home", False))).alias("s")).select("game_id", "date", *extra, "s.*")


def search_players(ratings: DataFrame, q: str, limit: int = 20) -> DataFrame:
    """Players whose name contains ``q`` (at least two characters), best first."""
    if len(q.strip()) < 2:
        return ratings.limit(0)
    found = ratings.where(F.contains(F.lower("player_name"), F.lit(q.strip().lower())))
    return found.orderBy(F.desc("rating"), "player_id").limit(limit)


def compare(ratings: DataFrame, ids: list[int], key: str = "player_id") -> DataFrame:
    return ratings.where(F.col(key).isin(ids))


def with_season(df: DataFrame, kind: str = "oct") -> DataFrame:
    return df.withColumn("season", season_start(F.col("date"), kind)).withColumn("season_label", season_label(F.col("date")))


def remaining(games: DataFrame, as_of: date, keep_played: bool = False) -> DataFrame:
    """Games after ``as_of`` in its season, without those that have a score."""
    out = games.where((F.col("date") > F.lit(as_of)) & (season_start(F.col("date")) == season_start(F.lit(as_of))))
    return out if keep_played else out.where("coalesce(home_score, 0) = 0 and coalesce(away_score, 0) = 0")


def remaining_by_team(games: DataFrame, as_of: date) -> DataFrame:
    return to_long(remaining(games, as_of)).groupBy("team_id").agg(
        F.count("*").alias("remaining"), F.count_if("is_home").alias("home_remaining"), F.count_if(~F.col("is_home")).alias("away_remaining")
    )


def history_of(hist: DataFrame, team_id: int, season: int | None = None) -> DataFrame:
    """A team's rating rows with its rest and a back-to-back mark, in order of date."""
    own = hist.where(F.col("team_id") == team_id)
    own = own.withColumn("rest_days", F.datediff("date", F.lag("date").over(Window.partitionBy("team_id").orderBy("date", "game_id"))) - 1)
    own = own.withColumn("b2b", F.coalesce(F.col("rest_days") <= 0, F.lit(False)))
    return (own if season is None else own.where(season_start(F.col("date")) == season)).orderBy("date", "game_id")


def player_history(hist: DataFrame, player_id: int, season: int | None = None) -> DataFrame:
    """A player's rating rows with minutes and plus-minus, in order of date."""
    own = hist.where(F.col("player_id") == player_id).select("game_id", "date", "rating_after", "minutes", "plus_minus")
    return (own if season is None else own.where(season_start(F.col("date")) == season)).orderBy("date", "game_id")


def past_predictions(pred: DataFrame, as_of: date | None = None, days: int | None = None) -> DataFrame:
    """Predictions of the last ``days`` days up to ``as_of``, or of the latest date, newest first."""
    if days is not None:
        out = pred.where(F.col("date").between(F.date_sub(F.lit(as_of), days), F.lit(as_of)))
    else:
        seen = pred if as_of is None else pred.where(F.col("date") <= F.lit(as_of))
        out = seen.join(F.broadcast(seen.agg(F.max("date").alias("date"))), "date", "left_semi")
    return out.orderBy(F.desc("date"), F.desc("game_id"))


def past_summary(pred: DataFrame, as_of: date | None = None, days: int | None = None) -> DataFrame:
    """Games, right picks and accuracy of ``past_predictions`` (P10)."""
    on = past_predictions(pred, as_of, days)
    return on.agg(F.count("correct").alias("games"), F.count_if("correct").alias("right"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.max("date").alias("last_date"))


def elo_training_set(games: DataFrame, hist: DataFrame) -> DataFrame:
    """Rating difference and margin of each game, from its two history rows by one pivot."""
    pick = lambda at, c: F.max(F.when(F.col("is_home") == at, F.col(c)))
    sides = hist.groupBy("game_id").agg(pick(True, "rating_before").alias("home_rating"), pick(False, "rating_before").alias("away_rating"))
    out = games.join(sides.where("home_rating is not null and away_rating is not null"), "game_id")
    return out.select(
        "game_id", "date", "home_score", "away_score", (F.col("home_rating") - F.col("away_rating")).alias("elo_diff"), (F.col("home_score") - F.col("away_score")).alias("actual_margin")
    )


def left_default(df: DataFrame, ratings: DataFrame, key: str = "player_id", default: float = 1500.0) -> DataFrame:
    return df.join(ratings.select(key, "rating"), key, "left").withColumn("rating", F.coalesce("rating", F.lit(default)))


def asof_ratings(games: DataFrame, hist: DataFrame, inclusive: bool = False, default: float = 1500.0) -> DataFrame:
    """Both teams' latest rating before each game; ``inclusive`` takes rows of its date too.

    Ratings and requests go into one stream for each team and season, in date order, and the last
    rating is carried on: one exchange, no range join. Seasons begin with the last rating before
    them, so that no task holds a team's whole history."""
    parts = lambda df: df.withColumn("season", F.when(F.month("date") >= 10, F.year("date")).otherwise(F.year("date") - 1))
    rows = parts(hist.select("team_id", "date", "game_id", F.col("rating_after").alias("rating")))
    asks = [games.select(F.col(f"{s}_team_id").alias("team_id"), "date", "game_id", F.lit(s).alias("side")) for s in ("home", "away")]
    asks = parts(asks[0].unionByName(asks[1]))
    last = rows.groupBy("team_id", "season").agg(F.max_by("rating", F.struct("date", "game_id")).alias("rating"))
    starts = asks.select("team_id", "season").distinct().unionByName(last.select("team_id", "season")).distinct().join(last, ["team_id", "season"], "left")
    before = Window.partitionBy("team_id").orderBy("season").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("team_id", "season", F.last("rating", ignorenulls=True).over(before).alias("start"))
    order = F.lit(0) if inclusive else F.lit(1)
    stream = rows.select("team_id", "season", "date", order.alias("turn"), "game_id", "rating", F.lit(None).cast("string").alias("side"))
    stream = stream.unionByName(asks.select("team_id", "season", "date", (1 - order).alias("turn"), "game_id", F.lit(None).cast("double").alias("rating"), "side"))
    upto = Window.partitionBy("team_id", "season").orderBy("date", "turn", "game_id").rowsBetween(Window.unboundedPreceding, 0)
    seen = stream.withColumn("seen", F.last("rating", ignorenulls=True).over(upto)).where("side is not null").join(starts, ["team_id", "season"], "left")
    seen = seen.select("game_id", "side", F.coalesce("seen", "start", F.lit(default)).alias("rating"))
    pick = lambda s: F.max(F.when(F.col("side") == s, F.col("rating"))).alias(f"{s}_rating")
    return games.join(seen.groupBy("game_id").agg(pick("home"), pick("away")), "game_id")


def name_join(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join on the normalised player name; names of ``b`` must be unique under it."""
    from ratingmill.functions.parse import normalized_names

    right = normalized_names(b).drop("player_name")
    return normalized_names(a).join(right, "name_key", how)


def map_codes(df: DataFrame, crosswalk: DataFrame, column: str = "code") -> DataFrame:
    """Rows with the team of their code; unknown codes go."""
    return df.join(small_side(crosswalk.select(F.col("code").alias(column), "team_id")), column)


def lookup_by_date(df: DataFrame, hist: DataFrame) -> DataFrame:
    """The team's first row of the date, by game."""
    first = Window.partitionBy("team_id", "date").orderBy("game_id")
    own = hist.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("team_id", "date", "rating_before")
    return df.join(own, ["team_id", "date"])


def recent_players(box: DataFrame, days: int, as_of: date) -> DataFrame:
    """Players with a row in the last ``days`` days (the box rows carry the date)."""
    seen = box.where(F.col("date").between(F.date_sub(F.lit(as_of), days), F.lit(as_of)))
    return seen.select("player_id", "team_id").distinct()


def pair_key(games: DataFrame) -> DataFrame:
    return games.withColumn("team_a", F.least("home_team_id", "away_team_id")).withColumn("team_b", F.greatest("home_team_id", "away_team_id"))


def player_pairs(box: DataFrame, players: DataFrame | None = None) -> DataFrame:
    """Opposing players of one game, both with minutes. ``players`` narrows both sides before the
    self-join, whose output is bounded by the square of a game's players, not of a player's games."""
    on = box.where("minutes > 0 and not didNotPlay")
    if players is not None:
        on = on.join(small_side(players.select("player_id").distinct()), "player_id", "left_semi")
    side = lambda k: on.select("game_id", F.col("date").alias(f"date{k}"), *[F.col(c).alias(f"{c}{k}") for c in ("player_id", "team_id", "plus_minus", "points")])
    pairs = side(1).join(side(2).drop("date2"), "game_id").where("team_id1 <> team_id2 and player_id1 < player_id2")
    return pairs.withColumnRenamed("date1", "date")


def full_team_names(df: DataFrame, names: DataFrame, column: str = "team") -> DataFrame:
    """``column`` with short codes (up to three characters, case aside) replaced by the name that ``names``
    (``code, name``) has for them; others stay."""
    known = names.select(F.upper("code").alias("_code"), F.col("name").alias("_name"))
    key = F.when(F.length(column) <= 3, F.upper(column))
    return df.withColumn("_key", key).join(known, F.col("_key") == F.col("_code"), "left").withColumn(column, F.coalesce("_name", F.col(column))).drop("_key", "_code", "_name")


def roster_diff(old: DataFrame, new: DataFrame, key: str = "player_id", team: str = "team_id", names: DataFrame | None = None) -> DataFrame:
    """Players that moved, were added or removed. With ``names`` teams are compared by their full names,
    so that a code on one side is no move (J11)."""
    if names is not None:
        old, new = (full_team_names(df, names, team) for df in (old, new))
    a, b = (df.select(key, F.col(team).alias(c)) for df, c in ((old, "old_team"), (new, "new_team")))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("old_team").isNull(), "added").when(F.col("new_team").isNull(), "removed").when(F.col("old_team") != F.col("new_team"), "moved")
    return both.withColumn("change", change).where("change is not null")


def containing_names(names: DataFrame, others: DataFrame, q: int = 3) -> DataFrame:
    """``name, other``: names of which one contains the other, case aside. Both sides have one column of that name.

    A name that lies in another has all its runs of ``q`` characters there, so it is looked up by its rarest one alone in an
    inverted index of the longer names, and then compared. Shorter names have one run, of their own
    length; an empty name lies in every one."""
    a, b = (df.select(F.col(c), F.lower(c).alias(f"_{c}")).where(F.col(c).isNotNull()).distinct() for df, c in ((names, "name"), (others, "other")))
    runs = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda k: F.substring(c, k, n))

    def index(df: DataFrame, c: str) -> DataFrame:
        """All runs of up to ``q`` characters, with the number of names that have them."""
        every = F.array_distinct(F.concat(*[F.when(F.length(c) >= n, runs(F.col(c), F.lit(n))).otherwise(F.array().cast("array<string>")) for n in range(q + 1)]))
        return df.select("*", F.explode(every).alias("gram"))

    def found(short: DataFrame, s: str, long: DataFrame, t: str) -> DataFrame:
        table = index(long, f"_{t}")
        often = table.groupBy("gram").agg(F.count("*").alias("n"))
        own = short.select("*", F.explode(F.array_distinct(runs(F.col(f"_{s}"), F.least(F.lit(q), F.length(f"_{s}"))))).alias("gram"))
        rarest = own.join(often, "gram").groupBy(s, f"_{s}").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
        return rarest.join(table, "gram").where(F.contains(f"_{t}", f"_{s}")).select("name", "other")

    return found(b, "other", a, "name").unionByName(found(a, "name", b, "other")).distinct()


def match_odds(games: DataFrame, odds: DataFrame, by_date: bool = True) -> DataFrame:
    """Odds of games by team names that contain each other, case aside: of the game's date, or with ``by_date=False`` of any.
    Pairs of names are found once for all games (``containing_names``); the rest are joins on equal keys."""
    o = odds.withColumnsRenamed({"date": "odds_date", "home_team": "odds_home", "away_team": "odds_away"})
    both = lambda df, home, away, c: df.select(F.col(home).alias(c)).union(df.select(F.col(away).alias(c)))
    pairs = containing_names(both(games, "home_team_name", "away_team_name", "name"), both(odds, "home_team", "away_team", "other"))
    side = lambda s: pairs.toDF(f"{s}_team_name", f"odds_{s}")
    g = games.join(side("home"), "home_team_name").join(side("away"), "away_team_name")
    keys = ["odds_home", "odds_away"]
    if by_date:
        out = g.withColumn("odds_date", F.col("date")).join(o, ["odds_date", *keys])
    else:
        out = g.join(o, keys)
    rest = [c for c in o.columns if c not in (*keys, "odds_date")]
    return out.select(*games.columns, *keys, *([] if by_date else ["odds_date"]), *rest)


def count_in_days(gl: DataFrame, n: int) -> DataFrame:
    """Games of the team in the ``n`` days before each game's date."""
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy("team_id").orderBy("day").rangeBetween(-n, -1)
    return gl.withColumn("day", day).withColumn(f"games_in_{n}", F.count("*").over(w)).drop("day")


def coverage(box: DataFrame, games: DataFrame) -> DataFrame:
    """Completed games, those with box rows, and their share."""
    done = completed(games)
    has = box.select("game_id").distinct().withColumn("has", F.lit(1))
    out = done.select("game_id").join(has, "game_id", "left").agg(F.count("*").alias("n_games"), F.count("has").alias("n_covered"))
    return out.withColumn("share", F.col("n_covered") / F.col("n_games"))


def all_teams(games: DataFrame) -> DataFrame:
    return games.select(F.col("home_team_id").alias("team_id")).union(games.select("away_team_id")).distinct()
