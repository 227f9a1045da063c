"""Per-team and per-pair features as of each game (W1-W20, W22), in a few shared windows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratingmill.functions.scores import haversine
from ratingmill.operators.games import small_side

def _team():
    return Window.partitionBy("team_id").orderBy("date", "game_id")


def _before(n: int):
    return _team().rowsBetween(-n, -1)


def _day(column: str = "date"):
    return F.datediff(column, F.lit("1970-01-01").cast("date"))


def over_days(aggregate: str, start: int | None, end: int = -1) -> Column:
    """An SQL ``aggregate`` over a team's rows of the days from ``start`` (null: all before) to ``end``, counted from the row's own. Its order
    is the date, so that rows in the order of the team's other windows need no sort of their own, as they would by a day number."""
    first = "unbounded preceding" if start is None else f"{-start} preceding"
    return F.expr(f"{aggregate} over (partition by team_id order by date range between {first} and {-end} preceding)")


def form(gl: DataFrame, n: int = 5, weight: float = 0.1) -> DataFrame:
    """Mean margin of the ``n`` rows before, scaled; 1.2 times for an unbroken run of three or more.
    ``streak_type`` is ``none`` without games and ``insufficient_data`` below three."""
    w = _before(n)
    wins, games = F.sum(F.col("won").cast("int")).over(w), F.count("*").over(w)
    # a tie breaks a run of either kind
    beaten, won = (F.coalesce(c, F.lit(False)) for c in (F.max("margin").over(w) < 0, F.min("margin").over(w) > 0))
    unbroken = (F.col("form_games") >= 3) & (won | beaten)
    out = gl.withColumn("form_games", games).withColumn("form_wins", F.coalesce(wins, F.lit(0))).withColumn("form_margin", F.coalesce(F.avg("margin").over(w), F.lit(0.0)))
    few = F.when(F.col("form_games") == 0, "none").when(F.col("form_games") < 3, "insufficient_data")
    kind = few.when(~unbroken, "mixed").when(beaten, "losing").otherwise("winning")
    return out.withColumn("form", F.col("form_margin") * weight * 50 * F.when(unbroken, 1.2).otherwise(1.0)).withColumn("streak_type", kind)


def _last_by_date(gl: DataFrame, n: int) -> DataFrame:
    """The last ``n`` games of strictly earlier dates as an array of structs, newest last.

    Each date takes the array that the last row of the dates before it has seen."""
    seen = F.collect_list(F.struct("date", "game_id", "won", "margin", "opponent_id")).over(_team().rowsBetween(-n + 1, 0))
    gl = gl.withColumn("_seen", seen)
    return gl.withColumn("recent", F.coalesce(over_days("last(_seen)", None), F.array().cast("array<struct<date:date,game_id:bigint,won:boolean,margin:bigint,opponent_id:bigint>>"))).drop("_seen")


def momentum(gl: DataFrame, n: int = 5, cap: float = 30, days: int = 10) -> DataFrame:
    """Points by wins in the last ``n`` games of earlier dates (W2); a tie is no win. ``late_wins`` and ``late_games``
    count those of the last ``days`` days only."""
    won, late = (lambda g: g.margin > 0), (lambda g: g.date >= F.date_sub("date", days))
    out = _last_by_date(gl, n).withColumn("wins", F.size(F.filter("recent", won))).withColumn("games", F.size("recent"))
    out = out.withColumn("late_wins", F.size(F.filter("recent", lambda g: won(g) & late(g)))).withColumn("late_games", F.size(F.filter("recent", late)))
    points = F.when(F.col("wins") >= 4, F.least((F.col("wins") - 3) * 15.0, F.lit(float(cap)))).when(F.col("wins") <= 1, F.greatest((F.col("wins") - 2) * 15.0, F.lit(-float(cap)))).otherwise(0.0)
    return out.withColumn("momentum", F.when(F.col("games") == 0, 0.0).otherwise(points)).drop("recent")


def momentum_tiers(gl: DataFrame, n: int = 5) -> DataFrame:
    """Points by wins and mean margin of the ``n`` rows before."""
    w = _before(n)
    out = gl.withColumn("games", F.count("*").over(w)).withColumn("wins", F.coalesce(F.sum(F.col("won").cast("int")).over(w), F.lit(0))).withColumn("avg_margin", F.avg("margin").over(w))
    wins, m = F.col("wins"), F.col("avg_margin")
    hot = F.when(m > 10, 35).when(m > 5, 25).otherwise(15)
    cold = F.when(m < -10, -35).when(m < -5, -25).otherwise(-15)
    level = F.when((wins == 3) & (m > 5), 10).when((wins == 2) & (m < -5), -10).otherwise(0)
    return out.withColumn("tier_points", F.when(F.col("games") == 0, 0).when(wins >= 4, hot).when(wins <= 1, cold).otherwise(level))


def welo(gl: DataFrame, ratings: DataFrame | None = None, n: int = 4, decay: float = 0.5, cap: float = 30) -> DataFrame:
    """Recency- and opponent-weighted results of the last ``n`` games of earlier dates.
    ``ratings`` (``game_id, team_id, rating_before``) rates the opponents; without, a column ``opp_rating``, or 1500."""
    if ratings is None:
        gl = gl if "opp_rating" in gl.columns else gl.withColumn("opp_rating", F.lit(1500.0))
    else:
        gl = gl.join(ratings.select("game_id", F.col("team_id").alias("opponent_id"), F.col("rating_before").alias("opp_rating")), ["game_id", "opponent_id"], "left").fillna(1500.0, ["opp_rating"])
    seen = F.collect_list(F.struct("won", "opp_rating")).over(_team().rowsBetween(-n + 1, 0))
    gl = gl.withColumn("_seen", seen)
    gl = gl.withColumn("_r", F.reverse(over_days("last(_seen)", None)))
    weight = lambda g, i: F.pow(F.lit(decay), i) * g.opp_rating / 1500
    total = lambda f: F.aggregate(F.transform("_r", f), F.lit(0.0), lambda a, x: a + x)
    score = total(lambda g, i: F.when(g.won, 1.0).otherwise(-1.0) * weight(g, i)) / total(weight)
    gl = gl.withColumn("welo_score", F.coalesce(score, F.lit(0.0))).withColumn("welo", F.col("welo_score") * cap)
    wins = F.size(F.filter("_r", lambda g: g.won))
    record = F.when(F.col("_r").isNull(), "0-0").otherwise(F.concat_ws("-", wins.cast("string"), (F.size("_r") - wins).cast("string")))
    return gl.withColumn("welo_record", record).drop("_seen", "_r")


def rest(gl: DataFrame, b2b: float = 46, one_day: float = 15) -> DataFrame:
    """Rest days since the row before, with penalty and category; the first game has -1."""
    gap = F.datediff("date", F.lag("date").over(_team()))
    days = F.when(gap.isNull(), -1).otherwise(F.greatest(F.lit(0), gap - 1))
    out = gl.withColumn("rest_days", days)
    kind = F.when(F.col("rest_days") < 0, "first_game").when(F.col("rest_days") == 0, "back_to_back").when(F.col("rest_days") == 1, "one_day_rest").when(F.col("rest_days") <= 3, "normal_rest").otherwise("extended_rest")
    penalty = F.when(F.col("rest_days") == 0, -float(b2b)).when(F.col("rest_days") == 1, -float(one_day)).otherwise(0.0)
    return out.withColumn("rest_category", kind).withColumn("rest_penalty", penalty)


def back_to_back(gl: DataFrame) -> DataFrame:
    return rest(gl).where("rest_days = 0")


def rest_fatigue(gl: DataFrame) -> DataFrame:
    """Back-to-back, schedule density and days of rest by earlier dates."""
    last = over_days("max(date)", None)
    out = gl.withColumn("fatigue_rest", F.when(last.isNull(), 7).otherwise(F.greatest(F.lit(0), F.datediff("date", last) - 1)))
    for n in (1, 4, 5):
        out = out.withColumn(f"in_{n}", over_days("count(*)", -n))
    density = F.when(F.col("in_4") >= 3, -30.0).when(F.col("in_5") >= 4, -40.0).when(F.col("in_5") + 1 >= 4, -20.0).otherwise(0.0)
    return out.withColumn("b2b_penalty", F.when(F.col("in_1") > 0, -50.0).otherwise(0.0)).withColumn("density_penalty", density).drop("in_1")


def rest_differential(home, away):
    """What much more rest adds to the home and to the away side."""
    side = lambda x, y: F.when((x >= 3) & (y <= 1), 30.0).when((x >= 2) & (y == 0), 15.0).otherwise(0.0)
    return side(home, away), F.when(side(home, away) > 0, 0.0).otherwise(side(away, home))


def _pair():
    return Window.partitionBy("team_a", "team_b").orderBy("date", "game_id")


def _pairs(games: DataFrame, n: int) -> DataFrame:
    """Games with the last ``n`` meetings before them, newest first, margins for the home team of now."""
    g = games.withColumn("team_a", F.least("home_team_id", "away_team_id")).withColumn("team_b", F.greatest("home_team_id", "away_team_id"))
    margin = F.when(F.col("home_team_id") == F.col("team_a"), 1).otherwise(-1) * (F.col("home_score") - F.col("away_score"))
    won = (F.col("home_team_id") == F.col("team_a")) == (F.col("home_score") > F.col("away_score"))
    g = g.withColumn("_m", F.collect_list(F.struct("date", "game_id", margin.alias("margin"), won.alias("won"))).over(_pair().rowsBetween(-n, -1)))
    first = F.col("home_team_id") == F.col("team_a")
    own = F.transform(F.reverse("_m"), lambda x: F.struct(x.date.alias("date"), x.game_id.alias("game_id"), F.when(first, x.margin).otherwise(-x.margin).alias("margin"), (x.won == first).alias("won")))
    return g.withColumn("meetings", own).drop("_m")


def _wins(meetings: str = "meetings"):
    return F.size(F.filter(meetings, lambda x: x.won))


def _sum(values):
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def h2h(games: DataFrame, n: int = 5, cap: float = 50, min_games: int = 3) -> DataFrame:
    """Adjustment for the home team by its share of the last ``n`` meetings."""
    g = _pairs(games, n).withColumn("h2h_games", F.size("meetings")).withColumn("h2h_wins", _wins())
    raw = (F.col("h2h_wins") / F.col("h2h_games") - 0.5) * 2 * 50 * F.least(F.col("h2h_games") / 5, F.lit(1.0))
    adjustment = F.when(F.col("h2h_games") >= min_games, F.greatest(F.lit(-float(cap)), F.least(F.lit(float(cap)), raw))).otherwise(0.0)
    games, rate = F.col("h2h_games"), F.col("h2h_wins") / F.col("h2h_games")
    rival = F.when(games < 3, "insufficient_data").when((games >= 5) & ((rate >= 0.8) | (rate <= 0.2)), "strong_dominance")
    rival = rival.when((rate >= 0.7) | (rate <= 0.3), "moderate_dominance").otherwise("balanced")
    sure = F.when(games == 0, "none").when(games < 3, "low").when(games < 5, "medium").otherwise("high")
    return g.withColumn("h2h_adjustment", adjustment).withColumn("h2h_class", rival).withColumn("h2h_confidence", sure).drop("meetings")


def h2h_recency(games: DataFrame, n: int = 5, cap: float = 15) -> DataFrame:
    """Mean margin of the last meetings, weighted by age, and a recent blowout."""
    g = _pairs(games, n)
    age = lambda x: F.datediff(F.col("date"), x.date)
    weight = lambda x: F.when(age(x) < 30, 1.0).when(age(x) < 90, 0.75).when(age(x) < 180, 0.5).when(age(x) < 365, 0.25).otherwise(0.1)
    score = F.coalesce(_sum(F.transform("meetings", lambda x: x.margin * weight(x))) / _sum(F.transform("meetings", weight)), F.lit(0.0))
    blowout = F.exists("meetings", lambda x: (age(x) < 60) & (F.abs(x.margin) >= 15))
    g = g.withColumn("h2h_score", F.when(F.size("meetings") > 0, score).otherwise(0.0)).withColumn("recent_blowout", blowout)
    return g.withColumn("h2h_recency", F.greatest(F.lit(-float(cap)), F.least(F.lit(float(cap)), F.col("h2h_score")))).drop("meetings")


def h2h_margin(games: DataFrame, n: int = 5, cap: float = 50, min_games: int = 3) -> DataFrame:
    """Adjustment by share of wins and mean margin of the last meetings."""
    g = _pairs(games, n).withColumn("h2h_games", F.size("meetings"))
    mean = _sum(F.transform("meetings", lambda x: x.margin.cast("double"))) / F.col("h2h_games")
    raw = (_wins() / F.col("h2h_games") - 0.5) * 100 + mean / 10 * 12.5
    return g.withColumn("h2h_margin", F.when(F.col("h2h_games") >= min_games, F.greatest(F.lit(-float(cap)), F.least(F.lit(float(cap)), raw))).otherwise(0.0)).drop("meetings")


def h2h_games(games: DataFrame, n: int = 5) -> DataFrame:
    """Each pair's last ``n`` games, seen from both sides."""
    g = games.withColumn("team_a", F.least("home_team_id", "away_team_id")).withColumn("team_b", F.greatest("home_team_id", "away_team_id"))
    g = g.withColumn("nth", F.row_number().over(Window.partitionBy("team_a", "team_b").orderBy(F.desc("date"), F.desc("game_id")))).where(F.col("nth") <= n)
    a = F.when(F.col("home_team_id") == F.col("team_a"), F.col("home_score") - F.col("away_score")).otherwise(F.col("away_score") - F.col("home_score"))
    return g.select("team_a", "team_b", "nth", "game_id", "date", a.alias("margin_a"), (-a).alias("margin_b"))


def recent_form(gl: DataFrame, n: int = 10) -> DataFrame:
    """Each team's last ``n`` games: record, means, results as text (newest first), current streak."""
    last = gl.withColumn("nth", F.row_number().over(Window.partitionBy("team_id").orderBy(F.desc("date"), F.desc("game_id")))).where(F.col("nth") <= n)
    t = last.groupBy("team_id").agg(
        F.count("*").alias("games"),
        F.count_if("won").alias("wins"),
        F.avg("team_score").alias("avg_points"),
        F.avg("opponent_score").alias("avg_allowed"),
        F.avg("margin").alias("avg_margin"),
        F.array_sort(F.collect_list(F.struct("nth", "won"))).alias("_r"),
    )
    t = t.withColumn("results", F.array_join(F.transform("_r", lambda x: F.when(x.won, "W").otherwise("L")), ""))
    t = t.withColumn("streak_type", F.left("results", F.lit(1)))
    length = F.length("results") - F.length(F.ltrim(F.col("results"), F.col("streak_type")))
    return t.withColumn("streak_length", length).withColumn("win_pct", F.col("wins") / F.col("games")).drop("_r")


def compare_form(games: DataFrame, form: DataFrame) -> DataFrame:
    """Games (``game_id, home_team_id, away_team_id``) whose sides both have ``recent_form``: who is in better form and by
    how much, who scores more and who allows less, and whether each side is on the rise (W12)."""
    side = lambda s: form.select(F.col("team_id").alias(f"{s}_team_id"), *[F.col(c).alias(f"{s}_{c}") for c in ("win_pct", "streak_type", "avg_points", "avg_allowed")])
    g = games.select("game_id", "home_team_id", "away_team_id").join(small_side(side("home")), "home_team_id").join(small_side(side("away")), "away_team_id")
    home, away = F.col("home_win_pct"), F.col("away_win_pct")
    ahead = lambda by: F.when(home > away + by, F.col("home_team_id")).when(away > home + by, F.col("away_team_id"))
    text = F.when(ahead(0.15).isNotNull(), "significantly better").when(ahead(0.05).isNotNull(), "slightly better").otherwise("similar")
    up = lambda s: F.when(F.col(f"{s}_streak_type") == "W", "up").otherwise("down")
    better = lambda on: F.when(on, F.col("home_team_id")).otherwise(F.col("away_team_id"))
    return g.select(
        "game_id",
        ahead(0.05).alias("form_advantage"),
        text.alias("form_text"),
        up("home").alias("home_momentum"),
        up("away").alias("away_momentum"),
        better(F.col("home_avg_points") > F.col("away_avg_points")).alias("scoring_advantage"),
        better(F.col("home_avg_allowed") < F.col("away_avg_allowed")).alias("defense_advantage"),
    )


def pick_streak(pred: DataFrame) -> DataFrame:
    """How many of the latest predictions in a row were right (or wrong)."""
    at = F.struct("date", "game_id")
    last = pred.agg(F.max_by("correct", at).alias("now"), F.max(F.when(F.col("correct"), at)).alias("r"), F.max(F.when(~F.col("correct"), at)).alias("w"))
    other = F.when(F.col("now"), F.col("w")).otherwise(F.col("r"))
    return pred.crossJoin(F.broadcast(last)).where(other.isNull() | (at > other)).groupBy(F.col("now").alias("correct")).agg(F.count("*").alias("streak"))  # one row


def travel(gl: DataFrame, arenas: DataFrame, long_km: float = 1500, mode: str = "reference") -> DataFrame:
    """Kilometres travelled to each game (W14). ``reference`` takes the previous opponent's arena as the
    start of a trip, and for away games as its end measured from home; ``itinerary`` follows the venues."""
    arenas = small_side(arenas.select("team_id", "latitude", "longitude"))
    place = lambda k: arenas.select(F.col("team_id").alias(f"{k}_at"), F.col("latitude").alias(f"{k}_lat"), F.col("longitude").alias(f"{k}_lon"))
    venue = F.when(F.col("is_home"), F.col("team_id")).otherwise(F.col("opponent_id"))
    if mode == "itinerary":
        gl = gl.withColumn("to_at", venue).withColumn("from_at", F.lag(venue).over(_team()))
    else:
        gl = gl.withColumn("from_at", F.lag("opponent_id").over(_team())).withColumn("to_at", F.col("team_id"))
    out = gl.join(place("from"), "from_at", "left").join(place("to"), "to_at", "left")
    km = haversine(F.col("from_lat"), F.col("from_lon"), F.col("to_lat"), F.col("to_lon"))
    out = out.withColumn("travel_km", F.coalesce(km, F.lit(0.0)))
    return out.withColumn("long_travel", F.col("travel_km") > long_km).drop("from_at", "to_at", "from_lat", "from_lon", "to_lat", "to_lon")


def travel_fatigue(gl: DataFrame, arenas: DataFrame, days: int = 7) -> DataFrame:
    """Penalty for the miles of the away games in the ``days`` days before a game, the first trip
    from home (W15): none below 1000 miles, up to -15 before 3000, -30 from there on."""
    return with_travel_fatigue(gl, arenas, days).select("team_id", "game_id", "travel_miles", "travel_fatigue")


def with_travel_fatigue(gl: DataFrame, arenas: DataFrame, days: int = 7) -> DataFrame:
    """All columns of ``gl`` with ``travel_miles`` and ``travel_fatigue``; its windows are by team."""
    arenas, kept = small_side(arenas.select("team_id", "latitude", "longitude")), gl.columns
    place = lambda k: arenas.select(F.col("team_id").alias(f"_{k}"), F.col("latitude").alias(f"{k}_lat"), F.col("longitude").alias(f"{k}_lon"))
    miles = lambda a, b: haversine(F.col(f"{a}_lat"), F.col(f"{a}_lon"), F.col(f"{b}_lat"), F.col(f"{b}_lon"), 3956.0)
    away = ~F.col("is_home")
    before = F.last(F.when(away, F.col("opponent_id")), ignorenulls=True).over(_team().rowsBetween(Window.unboundedPreceding, -1))
    rows = gl.withColumn("_to", F.when(away, F.col("opponent_id"))).withColumn("_home", F.col("team_id")).withColumn("_from", F.when(away, before))
    for k in ("to", "home", "from"):
        rows = rows.join(place(k), f"_{k}", "left")
    # a frame's trips: its first away game from home, the others from the away game before
    base = miles("home", "to")
    rows = rows.withColumn("base_hop", base).withColumn("hop", F.when(base.isNotNull(), F.coalesce(miles("from", "to"), F.lit(0.0)))).withColumn("_day", _day())
    rows = rows.withColumn("_trip", F.when(F.col("base_hop").isNotNull(), F.struct("_day", "game_id", "base_hop", "hop")))
    rows = rows.withColumn("_f", over_days("min(_trip)", -days)).withColumn("_all", over_days("sum(hop)", -days))
    total = F.when(F.col("_f").isNull(), 0.0).otherwise(F.col("_all") - F.col("_f.hop") + F.col("_f.base_hop"))
    penalty = F.when(total < 1000, 0.0).when(total < 3000, -15.0 * (total - 1000) / 2000).otherwise(-30.0)
    return rows.select(*kept, total.alias("travel_miles"), penalty.alias("travel_fatigue"))


def road_streak(gl: DataFrame) -> DataFrame:
    """Length of the home or road streak up to each game, it included."""
    start = (F.coalesce(F.lag("is_home").over(_team()) != F.col("is_home"), F.lit(True))).cast("int")
    out = gl.withColumn("_start", start).withColumn("_island", F.sum("_start").over(_team()))
    return out.withColumn("venue_streak", F.row_number().over(Window.partitionBy("team_id", "_island").orderBy("date", "game_id"))).drop("_start", "_island")


def elo_change_games(hist: DataFrame, n: int = 5) -> DataFrame:
    """Rating change over each team's last ``n`` games, and the record in them, of teams of as many."""
    last = hist.withColumn("nth", F.row_number().over(Window.partitionBy("team_id").orderBy(F.desc("date"), F.desc("game_id")))).where(F.col("nth") <= n + 1)
    at = lambda k, c: F.max(F.when(F.col("nth") == k, F.col(c)))
    oldest = F.max_by("rating_before", "nth")
    return last.groupBy("team_id").agg(
        (at(1, "rating_after") - F.coalesce(at(n + 1, "rating_after"), oldest)).alias("change"),
        F.count_if((F.col("nth") <= n) & F.col("won")).alias("wins"),
        F.count_if((F.col("nth") <= n) & ~F.col("won")).alias("losses"),
        F.count("*").alias("_games"),
    ).where(F.col("_games") >= n).drop("_games")


def elo_change_days(hist: DataFrame, as_of: date, days: int = 7, key: str = "team_id") -> DataFrame:
    """Rating change between ``days`` days before ``as_of`` and then: two as-of picks in one pass."""
    at = F.struct("date", "game_id")
    seen = hist.where(F.col("date") <= F.lit(as_of)).groupBy(key)
    old = F.col("date") <= F.date_sub(F.lit(as_of), days)
    out = seen.agg(F.max_by("rating_after", at).alias("now"), F.max_by(F.when(old, F.col("rating_after")), F.when(old, at)).alias("then"))
    return out.where("then is not null").withColumn("change", F.col("now") - F.col("then"))


def recent_rating(hist: DataFrame, n: int, key: str = "team_id") -> DataFrame:
    last = hist.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("date"), F.desc("game_id")))).where(F.col("nth") <= n)
    return last.groupBy(key).agg(F.avg("rating_after").alias("recent_rating"))


def games_before(gl: DataFrame, scope: str = "season") -> DataFrame:
    """Games of the team before each game: of its season, or of all."""
    season = F.when(F.month("date") >= 10, F.year("date")).otherwise(F.year("date") - 1)
    keys = ["team_id", season] if scope == "season" else ["team_id"]
    return gl.withColumn("games_before", F.count("*").over(Window.partitionBy(*keys).orderBy("date", "game_id").rowsBetween(Window.unboundedPreceding, -1)))


def recovery(returns: DataFrame, games: DataFrame) -> DataFrame:
    """Boost of players since their return (``player_id, return_date, rating``) at each later game of
    theirs (``player_id, date, game_id``) (W22)."""
    g = returns.join(games, "player_id").where("date >= return_date")
    g = g.withColumn("since", F.row_number().over(Window.partitionBy("player_id", "return_date").orderBy("date", "game_id")))
    share = F.when(F.col("since") == 1, 0.75).when(F.col("since") == 2, 0.85).when(F.col("since") == 3, 0.95).otherwise(1.0)
    return g.withColumn("recovery", share).withColumn("boost", (F.col("rating") - 1500) / 10 * share)


def team_game_features(gl: DataFrame) -> DataFrame:
    """Form, momentum tiers, rest, fatigue and games played of every team and game. All windows are
    partitioned by team, so that they share one exchange."""
    out = rest_fatigue(rest(momentum_tiers(form(gl)).drop("games", "wins", "avg_margin")))
    return games_before(out, "all")
