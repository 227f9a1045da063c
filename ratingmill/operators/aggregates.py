"""Aggregates (A*), rankings (T*) and data-quality jobs (Q*)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratingmill.operators.games import completed, to_long


def _share(on: Column, of: Column | None = None) -> Column:
    """Share of right predictions where ``of`` holds."""
    hit = on.cast("double")
    return F.avg(hit if of is None else F.when(of, hit))


def standings(games: DataFrame, as_of: date) -> DataFrame:
    gl = to_long(completed(games).where(F.col("date") <= F.lit(as_of)))
    t = gl.groupBy("team_id").agg(F.count_if("won").alias("wins"), F.count_if(~F.col("won")).alias("losses"), F.count("*").alias("games_played"))
    return t.withColumn("win_pct", F.col("wins") / F.col("games_played"))


def season_summary(games: DataFrame, as_of: date, full: int = 1230) -> DataFrame:
    played = F.count_if(((F.col("home_score") > 0) | (F.col("away_score") > 0)) & (F.col("date") <= F.lit(as_of)))
    t = games.agg(played.alias("played"), F.greatest(F.count("*"), F.lit(full)).alias("total"))
    return t.withColumn("remaining", F.col("total") - F.col("played")).withColumn("pct_complete", F.col("played") / F.col("total") * 100)


def record_before(games: DataFrame) -> DataFrame:
    """Each team's regular-season record before each of its games, by the recorded winner: ties count for none."""
    gl = to_long(completed(games).where("season_type = 'regular'"))
    before = Window.partitionBy("team_id").orderBy(F.datediff("date", F.lit("1970-01-01").cast("date"))).rangeBetween(Window.unboundedPreceding, -1)
    total = lambda on: F.coalesce(F.sum(on.cast("long")).over(before), F.lit(0))
    return gl.select("game_id", "date", "team_id", total(F.col("margin") > 0).alias("wins"), total(F.col("margin") < 0).alias("losses"))


def latest_per(df: DataFrame, key: str) -> DataFrame:
    """Each key's latest row; of every column the last value that isn't null."""
    at = F.struct("date", "game_id")
    return df.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in df.columns if c != key])


def team_from_players(box: DataFrame, ratings: DataFrame, default: float = 1500.0) -> DataFrame:
    """Minutes-weighted player rating of each team and game."""
    on = box.where("minutes > 0").join(ratings.select("player_id", "rating"), "player_id", "left").withColumn("rating", F.coalesce("rating", F.lit(default)))
    return on.groupBy("game_id", "team_id").agg((F.sum(F.col("rating") * F.col("minutes")) / F.sum("minutes")).alias("team_rating"))


def performance_summary(pred: DataFrame, start: date | None = None, end: date | None = None, min_games: int = 10, as_of: date | None = None) -> DataFrame:
    """Accuracy of every cut in one pass; null below ``min_games``, for all, large differences and the
    last week only without games (A6). An upset is any miss."""
    if start is not None:
        pred = pred.where(F.col("date") >= F.lit(start))
    if end is not None:
        pred = pred.where(F.col("date") <= F.lit(end))
    d, c = F.abs("elo_diff"), F.col("confidence")
    cuts = {
        "overall": F.lit(True),
        "home_pick": F.col("picked_home"),
        "away_pick": ~F.col("picked_home"),
        "close": d < 100,
        "toss_up": d < 50,
        "large": d >= 100,
        "enhanced": F.col("enhanced"),
        "home_b2b": F.col("home_b2b"),
        "away_b2b": F.col("away_b2b"),
        "high_confidence": c >= 0.70,
        "low_confidence": c < 0.60,
    }
    if as_of is not None:
        cuts["recent"] = F.col("date") >= F.date_sub(F.lit(as_of), 7)
    aggs = []
    for name, on in cuts.items():
        least = 1 if name in ("overall", "large", "recent") else min_games
        aggs += [F.count_if(on).alias(f"{name}_games"), F.when(F.count_if(on) >= least, _share(F.col("correct"), on)).alias(f"{name}_accuracy")]
    home_won = F.col("home_score") > F.col("away_score")
    aggs += [_share(home_won).alias("home_win_rate"), F.count_if(F.col("picked_home") & home_won).alias("home_predicted_correct"), F.count_if(~F.col("picked_home") & ~home_won).alias("away_predicted_correct")]
    return pred.agg(*aggs, F.avg(c).alias("avg_confidence"), F.count_if(~F.col("correct")).alias("upsets"), _share(~F.col("correct")).alias("upset_rate"))


def daily_stats(pred: DataFrame, close: float = 100) -> DataFrame:
    """Each day's predictions, those with an outcome (``correct`` isn't null) and how many of these are right, close games and
    enhanced predictions (A7)."""
    return pred.groupBy("date").agg(
        F.count("*").alias("games"), F.count("correct").alias("completed"), F.count_if("correct").alias("correct"), _share(F.col("correct")).alias("accuracy"),
        F.count_if(F.abs("elo_diff") < close).alias("close_games"), F.count_if("enhanced").alias("enhanced_games"), F.avg("confidence").alias("avg_confidence"),
    )


def by_confidence(pred: DataFrame, edges: list[float], right_closed: bool = False) -> DataFrame:
    """Accuracy by bins [lo, hi) or, with ``right_closed``, (lo, hi] with the lowest edge included."""
    c, bin_ = F.col("confidence"), None
    for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        on = ((c > lo) | ((c == lo) if k == 0 else F.lit(False))) & (c <= hi) if right_closed else (c >= lo) & (c < hi)
        bin_ = F.when(on, lo) if bin_ is None else bin_.when(on, lo)
    return pred.withColumn("bin", bin_).where("bin is not null").groupBy("bin").agg(F.count("*").alias("games"), _share(F.col("correct")).alias("accuracy"), F.avg("confidence").alias("avg_confidence"))


def by_season(pred: DataFrame, last: int = 5) -> DataFrame:
    s = F.when(F.month("date") >= 10, F.year("date")).otherwise(F.year("date") - 1)
    return pred.groupBy(s.alias("season")).agg(F.count("*").alias("games"), _share(F.col("correct")).alias("accuracy")).orderBy(F.desc("season")).limit(last)


def by_week(pred: DataFrame, as_of: date, last: int = 4, days: int = 30) -> DataFrame:
    on = pred.where(F.col("date").between(F.date_sub(F.lit(as_of), days), F.lit(as_of)))
    weeks = on.groupBy(F.date_trunc("week", "date").cast("date").alias("week")).agg(F.count("*").alias("games"), _share(F.col("correct")).alias("accuracy"))
    return weeks.orderBy(F.desc("week")).limit(last)


def recent_vs_all(pred: DataFrame, days: int = 5) -> DataFrame:
    last = pred.agg(F.max("date").alias("last_date"))
    on = F.col("date") >= F.date_sub("last_date", days)
    return pred.crossJoin(F.broadcast(last)).agg(F.count_if(on).alias("recent_games"), _share(F.col("correct"), on).alias("recent_accuracy"), F.count("*").alias("games"), _share(F.col("correct")).alias("accuracy"))  # one row


def rest_impact(rested: DataFrame) -> DataFrame:
    """Home win rate where a side plays the second of two days, whatever the other does, and where both have rested
    two days; without first games (A12). From ``rest`` rows of both sides."""
    pick = lambda at, c: F.max(F.when(F.col("is_home") == at, F.col(c)))
    g = rested.groupBy("game_id").agg(pick(True, "rest_days").alias("h"), pick(False, "rest_days").alias("a"), pick(True, "won").alias("home_won"))
    found = [("home_b2b", F.col("h") == 0), ("away_b2b", F.col("a") == 0), ("both_rested", (F.col("h") >= 2) & (F.col("a") >= 2))]
    each = F.explode(F.array_compact(F.array(*[F.when(on, name) for name, on in found])))
    g = g.where("h >= 0 and a >= 0").select(each.alias("situation"), "home_won")
    return g.groupBy("situation").agg(F.count("*").alias("games"), F.avg(F.col("home_won").cast("double")).alias("home_win_rate"))


def travel_bins(travelled: DataFrame, edges: tuple[float, ...] = (0, 500, 1000, 1500, 2000, 5000)) -> DataFrame:
    """Wins, rating changes and expected scores by distance, right-closed bins; no distance, no bin."""
    km, bin_ = F.col("travel_km"), None
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        on, name = (km > lo) & (km <= hi), f"{lo}-{hi}"
        bin_ = F.when(on, name) if bin_ is None else bin_.when(on, name)
    means = [F.avg(F.col("won").cast("double")).alias("win_rate"), F.avg("rating_change").alias("avg_change"), F.avg("expected_score").alias("avg_expected")]
    return travelled.withColumn("bin", bin_).where("bin is not null").groupBy("bin").agg(F.count("*").alias("games"), *means)


def travel_impact(travelled: DataFrame) -> DataFrame:
    """Win rates after long trips and after others, what the long ones cost, mean distance, and how distance goes
    with the change of the rating (A13, A14)."""
    won = F.col("won").cast("double")
    rate = lambda on, name: F.avg(F.when(on, won)).alias(name)
    out = travelled.agg(rate(F.col("long_travel"), "long_win_rate"), rate(~F.col("long_travel"), "normal_win_rate"), F.count_if("long_travel").alias("long_games"), F.avg("travel_km").alias("avg_km"), F.corr("travel_km", "rating_change").alias("correlation"))
    return out.withColumn("impact", F.col("long_win_rate") - F.col("normal_win_rate"))


def travel_corr(travelled: DataFrame) -> DataFrame:
    return travelled.agg(F.corr("travel_km", "rating_change").alias("correlation"), F.count("*").alias("games"))


def rating_stats(df: DataFrame, column: str = "rating") -> DataFrame:
    c = F.col(column)
    return df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.percentile(c, F.lit(0.5)).alias("median"), F.stddev_samp(c).alias("std"), F.min(c).alias("low"), F.max(c).alias("high"))


#: Tiers of ratings, box plus-minus and experience, from high to low; fixed by the reports that show them.
RATING_TIERS = {"MVP candidates": 1700, "All-Stars": 1650, "Above Average": 1600}
BPM_TIERS = {"Elite": 8, "Excellent": 5, "Good": 2, "Average": -2, "Below": -5}
EXPERIENCE_TIERS = {"Veterans": 600, "Prime": 300, "Developing": 100}


def tier_counts(df: DataFrame, edges: dict[str, float], column: str = "rating", below: str = "below", nudge: float = 0.0) -> DataFrame:
    """Rows by the highest tier whose edge they reach, with their share; ``edges`` from high to low (A16). ``nudge`` lifts
    values that are computed a last bit short of an edge onto it."""
    tier, value = F.lit(below), F.round(F.col(column) + nudge, 12) if nudge else F.col(column)
    for name, edge in sorted(edges.items(), key=lambda x: x[1]):
        tier = F.when(value >= edge, name).otherwise(tier)
    t = df.groupBy(tier.alias("tier")).agg(F.count("*").alias("n"))
    return t.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))  # a row for each tier


def tiers_reached(df: DataFrame, edges: dict[str, float] = RATING_TIERS, column: str = "rating") -> DataFrame:
    """How many rows reach each edge."""
    counts = df.agg(*[F.count_if(F.col(column) >= edge).alias(name) for name, edge in edges.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(name).alias("tier"), F.col(f"`{name}`").alias("n")) for name in edges])).alias("x")).select("x.*")


def entity_counts(box: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return box.agg(F.count("*").alias("rows"), *[count(F.col(f"{c}_id")).alias(f"{c}s") for c in ("game", "player", "team")])


def minutes_check(box: DataFrame, lo: float = 200, hi: float = 280, by: tuple[str, ...] = ("game_id", "team_id")) -> DataFrame:
    """How many sums of minutes are low or high, and whether their mean is plausible (A18). Sums are of a team in a
    game, or of a whole game (``by`` game alone) where box scores hold one side only."""
    per = box.groupBy(*by).agg(F.sum("minutes").alias("m"))
    return per.agg(F.count("*").alias("team_games"), F.avg("m").alias("mean_minutes"), F.count_if(F.col("m") < lo).alias("low"), F.count_if(F.col("m") > hi).alias("high"), F.avg("m").between(235, 245).alias("plausible"))


def fit_score_model(train: DataFrame, holdout_start: date) -> DataFrame:
    """Least squares of margin on rating difference before ``holdout_start``, with R2 and mean error
    on both sides of it (A19): one pass for the line, one for the residuals."""
    y, x = F.col("actual_margin").cast("double"), F.col("elo_diff")
    early = F.col("date") < F.lit(holdout_start)
    line = train.where(early).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    err = train.crossJoin(F.broadcast(line)).withColumn("err", y - F.col("slope") * x - F.col("intercept"))  # one row
    side = lambda on: [1 - F.sum(F.when(on, F.col("err") ** 2)) / (F.var_pop(F.when(on, y)) * F.count_if(on)), F.avg(F.when(on, F.abs("err"))), F.count_if(on)]
    names = [f"{s}_{m}" for s in ("train", "holdout") for m in ("r2", "mae", "n")]
    return err.groupBy("slope", "intercept").agg(*[c.alias(n) for c, n in zip([*side(early), *side(~early)], names, strict=True)])


def quarters_long(quarters: DataFrame) -> DataFrame:
    """One row for each team, game and quarter."""
    return quarters.select("game_id", "date", "team_id", "is_home", F.posexplode(F.array("q1", "q2", "q3", "q4")).alias("k", "points")).withColumn("quarter", F.col("k") + 1).drop("k")


def fit_quarter_models(quarters: DataFrame, hist: DataFrame) -> DataFrame:
    """A line for each quarter: home margin on rating difference, its mean error on the games it is fitted to, and
    the mean points (A20)."""
    q = quarters.join(hist.select("game_id", "team_id", "rating_before"), ["game_id", "team_id"])
    pick = lambda at, c: F.max(F.when(F.col("is_home") == at, F.col(c)))
    ks = range(1, 5)
    # a row for each game through the exchanges, its quarters apart only after them
    g = q.groupBy("game_id").agg((pick(True, "rating_before") - pick(False, "rating_before")).alias("x"), *[(pick(True, f"q{k}") - pick(False, f"q{k}")).cast("double").alias(f"y{k}") for k in ks], *[F.avg(f"q{k}").alias(f"mean{k}") for k in ks])
    g = g.select("game_id", "x", F.explode(F.array(*[F.struct(F.lit(k).alias("quarter"), F.col(f"y{k}").alias("y"), F.col(f"mean{k}").alias("mean")) for k in ks])).alias("s")).select("game_id", "x", "s.*")
    lines = g.groupBy("quarter").agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"), F.avg("mean").alias("league_average"), F.count("*").alias("games"))
    off = g.join(F.broadcast(lines), "quarter").groupBy("quarter").agg(F.avg(F.abs(F.col("y") - F.col("slope") * F.col("x") - F.col("intercept"))).alias("mae"))  # four rows
    return lines.join(F.broadcast(off), "quarter")


def league_average(games: DataFrame, holdout_start: date, least: int = 50) -> DataFrame:
    """Mean points of a side in regular games since ``holdout_start`` if there are enough, else since three years before."""
    done = games.where("season_type = 'regular' and home_score > 0").withColumn("points", (F.col("home_score") + F.col("away_score")) / 2)
    new = F.col("date") >= F.lit(holdout_start)
    old = F.col("date") >= F.add_months(F.lit(holdout_start), -36)
    t = done.agg(F.count_if(new).alias("n"), F.avg(F.when(new, F.col("points"))).alias("a"), F.avg(F.when(old, F.col("points"))).alias("b"))
    return t.select(F.when(F.col("n") >= least, F.col("a")).otherwise(F.col("b")).alias("league_average"), (F.col("n") >= least).alias("from_holdout"))


def quarter_distribution(quarters: DataFrame) -> DataFrame:
    """Points by side and quarter, by quarter, and in all."""
    q = quarters_long(quarters).withColumn("side", F.when(F.col("is_home"), "home").otherwise("away"))
    q = q.groupingSets([["side", "quarter"], ["quarter"], []], "side", "quarter")
    return q.agg(F.count("*").alias("n"), F.avg("points").alias("mean"), F.stddev_samp("points").alias("std"), F.min("points").alias("low"), F.max("points").alias("high"))


def quarter_averages(quarters: DataFrame) -> DataFrame:
    """Mean and deviation of a game's points of a side in each quarter, and how much the fourth is above the first."""
    g = quarters.groupBy("game_id").agg(*[F.avg(f"q{k}").alias(f"q{k}") for k in range(1, 5)])
    t = g.agg(*[f(f"q{k}").alias(f"{n}_q{k}") for k in range(1, 5) for n, f in (("mean", F.avg), ("std", F.stddev_samp))])
    return t.withColumn("late_delta", F.col("mean_q4") - F.col("mean_q1"))


def odds_consensus(odds: DataFrame) -> DataFrame:
    """Mean probability and price of each game and side over the books, and all probabilities."""
    from ratingmill.functions.scores import american_to_probability

    o = odds.withColumn("p", american_to_probability(F.col("price")))
    return o.groupBy("game_id", "is_home").agg(F.avg("p").alias("probability"), F.avg("price").alias("price"), F.count_distinct("book").alias("books"), F.array_sort(F.collect_list(F.round("p", 6))).alias("probabilities"))


def score_errors(pred: DataFrame) -> DataFrame:
    """Mean absolute errors of predicted points and margins by confidence tier."""
    tier = F.when(F.col("confidence") >= 0.7, "high").when(F.col("confidence") >= 0.6, "medium").otherwise("low")
    err = lambda s: F.avg(F.abs(F.col(f"pred_{s}_score") - F.col(f"{s}_score")))
    margin = F.avg(F.abs(F.col("pred_home_score") - F.col("pred_away_score") - F.col("home_score") + F.col("away_score")))
    return pred.groupBy(tier.alias("tier")).agg(F.count("*").alias("games"), err("home").alias("home_mae"), err("away").alias("away_mae"), margin.alias("margin_mae"))


def accuracy_cuts(pred: DataFrame) -> DataFrame:
    """Accuracy by rating difference, by month, by segment and in all: one rollup."""
    d = F.abs("elo_diff")
    bucket = F.when(d < 50, "0-50").when(d < 100, "50-100").when(d < 150, "100-150").otherwise("150+")
    p = pred.withColumn("bucket", bucket).withColumn("month", F.month("date")).withColumnRenamed("season_type", "segment")
    p = p.groupingSets([["bucket"], ["month"], ["segment"], []], "bucket", "month", "segment")
    return p.agg(F.count("*").alias("games"), _share(F.col("correct")).alias("accuracy"))


def pair_counts(games: DataFrame) -> DataFrame:
    return games.groupBy(F.least("home_team_id", "away_team_id").alias("team_a"), F.greatest("home_team_id", "away_team_id").alias("team_b")).agg(F.count("*").alias("games"))


def injury_load(injuries: DataFrame, roster_size: int = 13) -> DataFrame:
    """Injured and, at half weight, returning players as a share of a roster."""
    hurt, back = F.count_if(F.col("status").isin("out", "doubtful")), F.count_if(F.col("status") == "returning")
    return injuries.groupBy("team_id").agg(hurt.alias("injured"), back.alias("returning"), ((hurt + 0.5 * back) / roster_size).alias("load"))


def injury_counts(injuries: DataFrame, as_of: date, days: int = 365, threshold: int = 3) -> DataFrame:
    """Injuries of each player (``player_id, date``) in the last ``days`` days; prone from ``threshold`` on."""
    on = injuries.where(F.col("date").between(F.date_sub(F.lit(as_of), days), F.lit(as_of)))
    return on.groupBy("player_id").agg(F.count("*").alias("injuries"), (F.count("*") >= threshold).alias("prone"))


def results_with_predictions(games: DataFrame, hist: DataFrame, start: date, end: date, home_advantage: float = 30) -> DataFrame:
    """Completed games of a window with predictions from current ratings; an upset is a favourite above 0.6 that lost."""
    from ratingmill.functions.scores import expected_score

    now = hist.groupBy("team_id").agg(F.max_by("rating_after", F.struct("date", "game_id")).alias("rating"))
    g = completed(games, "both").where(F.col("date").between(F.lit(start), F.lit(end)))
    for s in ("home", "away"):
        g = g.join(now.select(F.col("team_id").alias(f"{s}_team_id"), F.col("rating").alias(f"{s}_rating")), f"{s}_team_id")
    p = expected_score(F.col("home_rating"), F.col("away_rating"), home_advantage)
    g = g.withColumn("p", p).withColumn("correct", (F.col("p") > 0.5) == (F.col("home_score") > F.col("away_score")))
    return g.select("game_id", "date", "p", "correct", (~F.col("correct") & (F.greatest(F.col("p"), 1 - F.col("p")) > 0.6)).alias("upset"))


# rankings


def top_players(ratings: DataFrame, n: int = 20, min_games: int = 10) -> DataFrame:
    return ratings.where(F.col("games_played") >= min_games).orderBy(F.desc("rating"), "player_id").limit(n)


def top_by(df: DataFrame, by: list[str], n: int, order: str = "rating", tie: str = "player_id") -> DataFrame:
    """The best ``n`` rows of each group, with their rank."""
    w = Window.partitionBy(*by).orderBy(F.desc(order), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def top_contributors(box: DataFrame, ratings: DataFrame, n: int = 3) -> DataFrame:
    on = box.where("minutes > 0").join(ratings.select("player_id", "rating"), "player_id")
    return top_by(on.withColumn("contribution", F.col("rating") * F.col("minutes")), ["game_id", "team_id"], n, "contribution")


def hot_cold(changes: DataFrame, n: int = 5) -> DataFrame:
    hot = changes.orderBy(F.desc("change"), "team_id").limit(n).withColumn("kind", F.lit("hot"))
    return hot.unionByName(changes.orderBy("change", "team_id").limit(n).withColumn("kind", F.lit("cold")))


#: First and last season of each era.
ERAS = {"2000s Era": (2000, 2009), "2010s Era": (2010, 2019), "2020s Era (Current)": (2020, 2025)}


def top_by_era(ratings: DataFrame, eras: dict[str, tuple[int, int]] = ERAS, n: int = 10, min_games: int = 100) -> DataFrame:
    """The best of each era by ``last_season``, among players of ``min_games`` games."""
    era = F.lit(None).cast("string")
    for name, (first, last) in eras.items():
        era = F.when(F.col("last_season").between(first, last), name).otherwise(era)
    return top_by(ratings.where(F.col("games_played") >= min_games).withColumn("era", era).where("era is not null"), ["era"], n)


def did_not_play(box: DataFrame) -> DataFrame:
    """Players of each game and team who did not play (T4)."""
    return box.where("didNotPlay").groupBy("game_id", "team_id").agg(F.array_sort(F.collect_list("player_id")).alias("did_not_play"))


def key_injuries(injuries: DataFrame, ratings: DataFrame, n: int = 3) -> DataFrame:
    """Each team's injured players of the highest ratings; unknown ones rate 0."""
    hurt = injuries.join(ratings.select("player_id", "rating"), "player_id", "left").withColumn("rating", F.coalesce("rating", F.lit(0.0)))
    impact = F.when(F.col("rating") > 1600, "star").when(F.col("rating") > 1400, "starter").otherwise("role")
    return top_by(hurt.withColumn("impact", impact), ["team_id"], n)


def closest_games(pred: DataFrame, n: int = 5) -> DataFrame:
    return pred.orderBy(F.abs(F.col("home_win_prob") - 0.5), "game_id").limit(n)


def featured(pred: DataFrame, n: int = 3) -> DataFrame:
    """The most lopsided games of at least 80 % for a side, and the closest within 60 to 40."""
    spread = F.round(F.abs(F.col("home_win_prob") - 0.5), 9)
    p = pred.withColumn("spread", spread).withColumn("kind", F.when(spread >= 0.30, "blowout").when(spread <= 0.10, "competitive")).where("kind is not null")
    key = F.when(F.col("kind") == "blowout", -F.col("spread")).otherwise(F.col("spread"))
    return p.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(key, "game_id"))).where(F.col("rank") <= n)


def upset_candidates(pred: DataFrame, lo: float = 0.5, hi: float = 0.65) -> DataFrame:
    """Games with a favourite in this range, the closest first, with both sides and the potential."""
    home = F.col("home_win_prob") > 0.5
    sides = [F.when(home, F.col(f"{a}_team_id")).otherwise(F.col(f"{b}_team_id")) for a, b in (("home", "away"), ("away", "home"))]
    close = pred.where(F.col("confidence").between(lo, hi))
    return close.withColumns({"favorite": sides[0], "underdog": sides[1], "upset_potential": 100 - F.col("confidence") * 100}).orderBy("confidence", "game_id")


def ranking(hist: DataFrame, as_of: date) -> DataFrame:
    now = hist.where(F.col("date") <= F.lit(as_of)).groupBy("team_id").agg(F.max_by("rating_after", F.struct("date", "game_id")).alias("rating"))
    return now.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("rating"), "team_id")))  # a row for each team


def slate(pred: DataFrame) -> DataFrame:
    """A day's games by status, then the most lopsided first."""
    status = F.when((F.col("home_score") > 0) | (F.col("away_score") > 0), 2).otherwise(0)
    return pred.withColumn("status", status).orderBy("date", "status", F.desc(F.abs(F.col("home_win_prob") - 0.5)), "game_id")


def slate_places(pred: DataFrame) -> DataFrame:
    """Each game's place among its date's games (T12): in the summary by ``tipoff`` and then the most lopsided, on the
    page by ``status_code`` (1 scheduled, 2 live, 3 final; unknown as 1) and then ``tipoff``. A missing probability counts as 0.5,
    a missing tip-off as the earliest; ties go to the smaller id."""
    day = Window.partitionBy("date")
    status = F.when(F.col("status_code").isin(1, 2, 3), F.col("status_code")).otherwise(1)
    lopsided = F.abs(F.coalesce("home_win_prob", F.lit(0.5)) - 0.5)
    by = lambda *keys: F.row_number().over(day.orderBy(*keys, "game_id"))
    return pred.withColumn("summary_place", by(F.asc_nulls_first("tipoff"), F.desc(lopsided))).withColumn("page_place", by(status, F.asc_nulls_first("tipoff")))


# data quality


def check_schema(df: DataFrame, required: list[str]) -> DataFrame:
    found = df.columns
    return df.sparkSession.createDataFrame([(c, c in found) for c in required], "column string, present boolean")


def nulls(df: DataFrame) -> DataFrame:
    counts = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in df.columns]))
    return counts.select("rows", pairs.alias("x")).select("x.column", "x.nulls", "rows")


def duplicates(df: DataFrame, key: str = "game_id") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def season_counts(games: DataFrame, expected: int = 1230) -> DataFrame:
    s = F.when(F.month("date") >= 10, F.year("date")).otherwise(F.year("date") - 1)
    return games.groupBy(s.alias("season")).agg(F.count("*").alias("games")).withColumn("difference", F.col("games") - expected)


def status(games: DataFrame, as_of: date) -> DataFrame:
    done = (F.col("home_score") > 0) | (F.col("away_score") > 0)
    t = games.agg(F.count("*").alias("games"), F.count_if(done).alias("completed"), F.count_if(~done).alias("scheduled"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.max(F.when(done, F.col("date"))).alias("latest_completed"), F.min(F.when(~done, F.col("date"))).alias("first_scheduled"), F.max(F.when(~done, F.col("date"))).alias("last_scheduled"))
    behind = F.datediff(F.lit(as_of), "latest_completed")
    state = F.when(behind == 0, "UP TO DATE").when(behind == 1, "CURRENT").when(behind <= 3, "MOSTLY CURRENT").when(behind.isNotNull(), "OUTDATED")
    return t.withColumn("days_behind", behind).withColumn("state", state)


def verdict(box: DataFrame, games: DataFrame) -> DataFrame:
    """One word for the state of the player data: coverage, mean minutes of a team's game, and, for the
    best, no missing values; without statistics it is incomplete (Q5)."""
    from ratingmill.operators.games import coverage

    if not {"plus_minus", "points", "rebounds", "assists"} <= set(box.columns):
        return coverage(box, games).withColumn("verdict", F.lit("INCOMPLETE"))
    missing = box.agg(F.sum(sum((F.col(c).isNull().cast("long") for c in box.columns), F.lit(0))).alias("missing"))
    both = coverage(box, games).crossJoin(minutes_check(box)).crossJoin(missing)  # one row each
    covered, mean = F.col("share"), F.col("mean_minutes")
    best = (covered >= 0.95) & mean.between(235, 245) & (F.col("missing") == 0)
    word = F.when(best, "EXCELLENT").when((covered >= 0.90) & mean.between(230, 250), "GOOD").otherwise("NEEDS ATTENTION")
    return both.select("n_games", "n_covered", "share", "mean_minutes", "missing", word.alias("verdict"))


def freshness(tables: dict[str, DataFrame], as_of: date, days: int = 3) -> DataFrame:
    """Age of each table's last date, and whether it is OK, a WARNING after ``days`` days, or MISSING without rows (Q6)."""
    out = None
    for name, df in tables.items():
        t = df.agg(F.max("date").alias("last_date")).select(F.lit(name).alias("table"), "last_date", F.datediff(F.lit(as_of), "last_date").alias("age"))
        out = t if out is None else out.unionByName(t)
    status = F.when(F.col("age").isNull(), "MISSING").when(F.col("age") > days, "WARNING").otherwise("OK")
    return out.withColumn("stale", F.coalesce(F.col("age") > days, F.lit(True))).withColumn("status", status)


def extent(a: DataFrame, b: DataFrame) -> DataFrame:
    side = lambda df, k: df.agg(F.min("date").alias(f"first_{k}"), F.max("date").alias(f"last_{k}"))
    both = side(a, "a").crossJoin(side(b, "b"))  # one row each
    return both.withColumn("same", F.col("first_a").eqNullSafe(F.col("first_b")) & F.col("last_a").eqNullSafe(F.col("last_b")))


def plausible(games: DataFrame, least: int = 50) -> DataFrame:
    """Games without a score, and shares of games with more than ``least`` points of the home side, the visitor, and both (Q8)."""
    home, away = F.coalesce(F.col("home_score") > least, F.lit(False)), F.coalesce(F.col("away_score") > least, F.lit(False))
    shares = [F.avg(on.cast("double")).alias(f"{name}_share") for name, on in (("home", home), ("away", away), ("plausible", home & away))]
    missing = F.col("home_score").isNull() | F.col("away_score").isNull()
    return games.agg(F.count("*").alias("games"), F.count_if(missing).alias("null_scores"), *shares)
