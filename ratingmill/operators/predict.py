"""Predictions, tracking, betting and drift."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratingmill.functions import scores as S
from ratingmill.operators import windows as W
from ratingmill.operators.games import asof_ratings, small_side, to_long
from ratingmill.operators.ratings import with_concentration
from ratingmill.sources.shared import shared_folder, stage

_BOTH = ("home", "away")


def sides(features: DataFrame, columns: list[str]) -> DataFrame:
    """Team rows back to one row for each game: each column for the home and the away side."""
    pick = lambda at, c: F.max(F.when(F.col("is_home") == at, F.col(c)))
    return features.groupBy("game_id").agg(*[pick(s == "home", c).alias(f"{s}_{c}") for s in _BOTH for c in columns])


def outcome(pred: DataFrame) -> DataFrame:
    """Capped probability, pick, confidence and the reason where a rating is missing."""
    diff = F.col("home_final") - F.col("away_final")
    p = pred.withColumn("home_win_prob", S.capped_probability(F.col("p"), diff)).withColumn("picked_home", F.col("home_win_prob") > 0.5)
    p = p.withColumn("confidence", F.greatest(F.col("home_win_prob"), 1 - F.col("home_win_prob")))
    return p.withColumn("reason", F.when(F.col("home_win_prob").isNull(), "no rating"))


def predict_team(schedule: DataFrame, hist: DataFrame, games: DataFrame, home_advantage: float = 20, metrics: DataFrame | None = None, inclusive: bool = False) -> DataFrame:
    """Team predictions (R11): as-of rating, form and rest, with ``metrics`` (``concentration``) also what a team's best
    players add, then expectation and cap. A pick whose team leans on one player loses confidence.
    ``schedule`` is a part of ``games``; features come from the games before each."""
    features = sides(W.rest(W.form(to_long(games))), ["form", "rest_penalty"])
    g = asof_ratings(schedule, hist, inclusive, None).join(features, "game_id")
    for s in _BOTH:
        g = g.withColumn(f"{s}_final", F.col(f"{s}_rating") + F.col(f"{s}_form") + F.col(f"{s}_rest_penalty"))
    if metrics is not None:
        g = with_concentration(g, metrics)
        for s in _BOTH:
            g = g.withColumn(f"{s}_final", F.col(f"{s}_final") + F.col(f"{s}_add"))
    g = outcome(g.withColumn("p", S.expected_score(F.col("home_final"), F.col("away_final"), home_advantage)))
    if metrics is not None:
        risk = F.when(F.col("picked_home"), F.col("home_risk")).otherwise(F.col("away_risk"))
        g = g.withColumn("confidence", F.col("confidence") * (1 - 0.2 * risk))
        g = g.withColumn("home_win_prob", F.when(F.col("picked_home"), F.col("home_win_prob")).otherwise(1 - F.col("confidence"))).drop("home_add", "away_add")
    return g


def with_ratings(gl: DataFrame, hist: DataFrame, default: float = 1500.0) -> DataFrame:
    """Team rows with the opponent's rating before the game (``opp_rating``) and the team's own after the games of earlier dates
    (``rating``), from the history of the same games: one row for each game is joined, then all is in the team's windows."""
    pick = lambda at, c: F.max(F.when(F.col("is_home") == at, F.col(c)))
    both = hist.groupBy("game_id").agg(pick(True, "rating_before").alias("_home"), pick(False, "rating_before").alias("_away"), pick(True, "rating_after").alias("_h"), pick(False, "rating_after").alias("_a"))
    out = gl.join(both, "game_id", "left").withColumn("opp_rating", F.coalesce(F.when(F.col("is_home"), F.col("_away")).otherwise(F.col("_home")), F.lit(default)))
    out = out.withColumn("_day", F.datediff("date", F.lit("1970-01-01").cast("date"))).withColumn("_after", F.when(F.col("is_home"), F.col("_h")).otherwise(F.col("_a")))
    out = out.withColumn("_last", F.when(F.col("_after").isNotNull(), F.struct("_day", "game_id", "_after")))
    # one sort for this and the team's other windows
    out = out.repartition("team_id").sortWithinPartitions("team_id", "date", "game_id")
    last = W.over_days("max(_last)", None)
    return out.withColumn("rating", F.coalesce(last["_after"], F.lit(default))).drop("_home", "_away", "_h", "_a", "_day", "_after", "_last")


def predict_hybrid(schedule: DataFrame, hist: DataFrame, games: DataFrame, roster_elos: DataFrame, injuries: DataFrame, arenas: DataFrame, blend: float = 0.75, home_advantage: float = 60) -> DataFrame:
    """Hybrid predictions (R12), all adjustments in one select. ``schedule`` is a part of ``games``, which ``hist`` rates.

    Team and roster rating are blended; a close game adds meetings and travel; then come rest and
    density, weighted results (less where ratings are close), and injuries. Toss-ups are drawn to one
    half by the blended ratings without home advantage. Upset probability, context, score follow.
    ``roster_elos`` and ``injuries`` are figures of teams, or with a ``game_id`` of each team's games (``roster_figures``)."""
    gl = with_ratings(to_long(games), hist)
    # all features of a team and the figures of its roster beside its games, then one pivot to games
    team = W.games_before(W.with_travel_fatigue(W.rest_fatigue(W.momentum(W.welo(gl))), arenas), "season")
    keys = ["game_id", "team_id"] if "game_id" in roster_elos.columns else ["team_id"]
    figures = roster_elos if roster_elos is injuries else roster_elos.select(*keys, "roster_elo").join(injuries.select(*keys, "injury_adjustment"), keys, "full_outer")
    figures = figures.select(*keys, "roster_elo", "injury_adjustment")
    team = team.join(figures if len(keys) > 1 else small_side(figures), keys, "left").fillna({"roster_elo": 1500.0, "injury_adjustment": 0.0}).withColumnsRenamed({"roster_elo": "roster", "injury_adjustment": "injury"})
    cols = ["rating", "welo", "fatigue_rest", "b2b_penalty", "density_penalty", "travel_fatigue", "late_wins", "late_games", "games_before", "roster", "injury"]
    g = schedule.join(sides(team, cols), "game_id")
    g = g.join(W.h2h_recency(games).select("game_id", "h2h_recency"), "game_id")
    for s in _BOTH:
        g = g.withColumn(f"{s}_hybrid", blend * F.col(f"{s}_rating") + (1 - blend) * F.col(f"{s}_roster"))
    raw = F.col("home_hybrid") - F.col("away_hybrid")
    more_home, more_away = W.rest_differential(F.col("home_fatigue_rest"), F.col("away_fatigue_rest"))
    damp = F.least(F.lit(1.0), F.abs("raw_diff") / 30)
    g = g.withColumn("raw_diff", raw)
    met = {"home": 0.15 * F.col("h2h_recency"), "away": F.lit(0.0)}  # meetings count for the home side only
    for s, more in (("home", more_home), ("away", more_away)):
        close = F.when(F.abs("raw_diff") < 50, met[s] + F.col(f"{s}_travel_fatigue")).otherwise(0.0)
        tired = F.col(f"{s}_b2b_penalty") + F.col(f"{s}_density_penalty") + more
        g = g.withColumn(f"{s}_final", F.col(f"{s}_hybrid") + close + tired + F.col(f"{s}_welo") * damp + F.col(f"{s}_injury"))
    g = g.withColumn("p", S.toss_up(S.expected_score(F.col("home_final"), F.col("away_final"), home_advantage), F.col("raw_diff")))
    diff = F.col("home_final") - F.col("away_final")
    favourite = F.when(F.col("p") > 0.5, F.col("home_late_wins")).otherwise(F.col("away_late_wins"))
    underdog = F.when(F.col("p") > 0.5, F.col("away_late_wins")).otherwise(F.col("home_late_wins"))
    enough = (F.col("home_late_games") >= 3) & (F.col("away_late_games") >= 3)
    context = S.game_context(F.col("date"), F.col("home_games_before"), F.col("away_games_before"))
    g = g.withColumn("upset_probability", S.upset_probability(diff, F.col("p"), favourite, underdog, enough)).withColumn("upset_alert", F.col("upset_probability") > S.UPSET_ALERT).withColumn("context", context)
    g = g.withColumn("confidence", S.calibrated_confidence(F.greatest(F.col("p"), 1 - F.col("p"))))
    score = S.confidence_score(diff, F.col("home_fatigue_rest"), F.col("away_fatigue_rest"), F.col("home_injury"), F.col("away_injury"), F.col("home_welo"), F.col("away_welo"), F.col("context.is_post_christmas"), F.col("context.is_season_opener"), F.col("context.is_playoff_push"))
    home, away = S.score_split(diff)
    return g.withColumn("confidence_score", score).withColumn("pred_home_score", home).withColumn("pred_away_score", away)


def predict_adaptive(g: DataFrame, close: float = 100) -> DataFrame:
    """Weights by closeness (R13); ``g`` has team, roster, form and rest figures of both sides, the last two as points."""
    diff = F.abs(F.col("home_rating") - F.col("away_rating"))
    for s in _BOTH:
        near = 0.5 * F.col(f"{s}_rating") + 0.2 * F.col(f"{s}_roster") + 0.2 * F.col(f"{s}_form") + 0.1 * F.col(f"{s}_rest_penalty")
        g = g.withColumn(f"{s}_final", F.when(diff < close, near).otherwise(0.7 * F.col(f"{s}_rating") + 0.3 * F.col(f"{s}_roster")))
    return g.withColumn("home_win_prob", S.expected_score(F.col("home_final"), F.col("away_final"), 60)).withColumn("picked_home", F.col("home_win_prob") > 0.5)


def predict_light(schedule: DataFrame, hist: DataFrame, games: DataFrame, h2h_w: float = 0.07, mom_w: float = 0.05, home_advantage: float = 60) -> DataFrame:
    """As-of ratings, a little of the momentum, and for the home side of the meetings."""
    g = asof_ratings(schedule, hist).join(sides(W.momentum_tiers(to_long(games)), ["tier_points"]), "game_id")
    g = g.join(W.h2h_margin(games).select("game_id", "h2h_margin"), "game_id")
    home = F.col("home_rating") + h2h_w * F.col("h2h_margin") + mom_w * F.col("home_tier_points")
    away = F.col("away_rating") + mom_w * F.col("away_tier_points")
    g = g.withColumn("home_final", home).withColumn("away_final", away)
    return g.withColumn("home_win_prob", S.expected_score(F.col("home_final"), F.col("away_final"), home_advantage))


def backtest(pred: DataFrame) -> DataFrame:
    """Predictions of completed games beside their outcomes (R15), as the log has them."""
    return pred.where("home_score > 0 or away_score > 0").withColumn("correct", (F.col("home_win_prob") > 0.5) == (F.col("home_score") > F.col("away_score")))


def backtest_summary(models: dict[str, DataFrame]) -> DataFrame:
    """Games, right picks, accuracy and mean squared error of several models' predictions of completed games."""
    every = None
    for name, pred in models.items():
        rows = backtest(pred).select(F.lit(name).alias("model"), "correct", (F.col("home_win_prob") - (F.col("home_score") > F.col("away_score")).cast("int")).alias("off"))
        every = rows if every is None else every.unionByName(rows)
    on = every.groupBy("model").agg(F.count("*").alias("games"), F.count_if("correct").alias("right"), F.avg(F.pow("off", F.lit(2.0))).alias("brier"))
    return on.withColumn("accuracy", F.col("right") / F.col("games"))


def track(pred: DataFrame, stored: DataFrame, as_of: date, days: int = 7) -> DataFrame:
    """Outcomes of the last ``days`` days that the log doesn't hold yet."""
    new = backtest(pred.where(F.col("date").between(F.date_sub(F.lit(as_of), days), F.lit(as_of))))
    return new.join(stored.select("game_id"), "game_id", "left_anti")


def player_h2h(games: DataFrame, box: DataFrame, tops: DataFrame, n: int = 10, cap: float = 30, least: int = 3) -> DataFrame:
    """Adjustment of team pairs by how their top players did against each other (R17). ``tops`` (``player_id,
    team_id, rating``) keeps the self-join to a few players of each team; both teams need two."""
    from ratingmill.operators.games import player_pairs

    tops = tops.withColumn("known", F.count("*").over(Window.partitionBy("team_id"))).where("known >= 2").drop("known")
    tops = stage(tops.select("player_id", "team_id", "rating"), shared_folder(tops.sparkSession))  # read four times, a few rows a team
    pairs = player_pairs(box, tops)
    w = Window.partitionBy("player_id1", "player_id2").orderBy(F.desc("game_id"))
    last = pairs.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)
    met = last.groupBy("player_id1", "player_id2").agg(F.count("*").alias("met"), F.avg((F.col("plus_minus1") - F.col("plus_minus2")).cast("double")).alias("diff")).where(F.col("met") >= least)
    t = lambda k: tops.select(F.col("player_id").alias(f"player_id{k}"), F.col("team_id").alias(f"team{k}"), F.col("rating").alias(f"r{k}"))
    both = met.join(small_side(t(1)), "player_id1").join(small_side(t(2)), "player_id2").where("team1 <> team2")
    first = F.col("team1") < F.col("team2")
    weight = (F.col("r1") + F.col("r2")) / 4000
    value = F.when(first, 1).otherwise(-1) * F.col("diff") / 5 * 10
    out = both.groupBy(F.least("team1", "team2").alias("team_a"), F.greatest("team1", "team2").alias("team_b")).agg((F.sum(value * weight) / F.sum(weight)).alias("raw"), F.count("*").alias("matchups"))
    return out.withColumn("player_h2h", F.greatest(F.lit(-float(cap)), F.least(F.lit(float(cap)), F.col("raw"))))


def betting_report(pred: DataFrame) -> DataFrame:
    """Risk, fair price and recommendation of each game."""
    c = F.col("confidence")
    p = pred.withColumn("risk", S.risk_level(c)).withColumn("fair_price", S.probability_to_american(c)).withColumn("category", S.game_category(c))
    return p.withColumn("recommended", (c >= 0.60) & F.col("risk").isin("VERY LOW RISK", "LOW RISK"))


def betting_summary(report: DataFrame, n: int = 5) -> DataFrame:
    """Each day's counts by risk, its recommended games, mean confidence in whole percents, and its ``n``
    surest games of the two lowest risks (R18)."""
    rank = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("confidence"), "game_id"))
    r = report.withColumn("_low", F.col("risk").isin("VERY LOW RISK", "LOW RISK")).withColumn("_rank", rank)  # risk follows confidence
    top = F.array_sort(F.collect_list(F.when(F.col("_low") & (F.col("_rank") <= n), F.struct("_rank", "game_id"))))
    counts = [F.count_if(F.col("risk") == k).alias(k.lower().replace(" risk", "").replace(" ", "_") + "_count") for k in ("VERY LOW RISK", "LOW RISK", "MODERATE RISK", "HIGH RISK")]
    t = r.groupBy("date").agg(F.count("*").alias("total_games"), F.count_if("recommended").alias("total_recommended"), F.avg(F.floor(F.col("confidence") * 100)).alias("avg_confidence"), *counts, top.alias("_top"))
    return t.withColumn("top_games", F.array_join(F.transform("_top", lambda x: x.game_id.cast("string")), ",")).drop("_top")


def best_parlays(report: DataFrame, most: int = 3) -> DataFrame:
    """Each day's two surest games of very low risk together, its three surest, and so on up to ``most`` (R18): joint probability,
    its risk, and the American odds of the product of the legs' decimal odds, which follow their whole fair prices."""
    sure = report.where("risk = 'VERY LOW RISK'").withColumn("_rank", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("confidence"), "game_id"))).where(F.col("_rank") <= most)
    legs = sure.groupBy("date").agg(F.array_sort(F.collect_list(F.struct("_rank", "game_id", "confidence", "fair_price"))).alias("_legs")).where(F.size("_legs") >= 2)
    each = legs.withColumn("num_bets", F.explode(F.sequence(F.lit(2), F.size("_legs")))).withColumn("_legs", F.slice("_legs", F.lit(1), F.col("num_bets")))
    odds = F.aggregate("_legs", F.lit(1.0), lambda a, x: a * S.american_to_decimal(x.fair_price.cast("double")))
    each = each.withColumn("probability", S.parlay(F.transform("_legs", lambda x: x.confidence))).withColumn("decimal_odds", odds)
    american = F.when(F.col("decimal_odds") >= 2, (F.col("decimal_odds") - 1) * 100).otherwise(-100 / (F.col("decimal_odds") - 1)).cast("int")
    games = F.array_join(F.transform("_legs", lambda x: x.game_id.cast("string")), "+")
    return each.select("date", "num_bets", games.alias("games"), "probability", S.risk_level(F.col("probability")).alias("risk"), "decimal_odds", american.alias("combined_odds"))


def parlays(report: DataFrame, legs: int = 2, n: int = 5) -> DataFrame:
    """Joint probabilities of each day's ``n`` surest recommended games, ``legs`` at a time."""
    top = report.where("recommended").withColumn("rank", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("confidence"), "game_id"))).where(F.col("rank") <= n)
    out = top.select("date", F.array("rank").alias("ranks"), F.array("game_id").alias("games"), F.array("confidence").alias("p"))
    for _ in range(legs - 1):
        more = top.select("date", F.col("rank").alias("r"), F.col("game_id").alias("g"), F.col("confidence").alias("c"))
        out = out.join(more, "date").where(F.col("r") > F.element_at("ranks", -1))
        out = out.select("date", F.array_append("ranks", F.col("r")).alias("ranks"), F.array_append("games", F.col("g")).alias("games"), F.array_append("p", F.col("c")).alias("p"))
    return out.select("date", F.array_join(F.col("games").cast("array<string>"), "+").alias("games"), S.parlay(F.col("p")).alias("probability"), (1 / S.parlay(F.col("p"))).alias("decimal_odds"))


def drift(pred: DataFrame, as_of: date, drop: float = 0.05, wrong: int = 3, least: tuple[int, int] = (5, 10)) -> DataFrame:
    """Trailing accuracies and whether they call for an alert."""
    on = lambda d: F.col("date") >= F.date_sub(F.lit(as_of), d)
    season = F.when(F.month("date") >= 10, F.year("date")).otherwise(F.year("date") - 1) == (as_of.year if as_of.month >= 10 else as_of.year - 1)
    hit, at = F.col("correct").cast("double"), F.struct("date", "game_id")
    seen = pred.where(F.col("date") <= F.lit(as_of))
    a = seen.agg(
        F.count_if(on(7)).alias("n7"), F.avg(F.when(on(7), hit)).alias("acc7"), F.count_if(on(30)).alias("n30"), F.avg(F.when(on(30), hit)).alias("acc30"),
        F.avg(F.when(season, hit)).alias("season_accuracy"), F.max(F.when(F.col("correct"), at)).alias("last_right"),
    )
    streak = seen.crossJoin(F.broadcast(a)).groupBy(*[c for c in a.columns if c != "last_right"]).agg(F.count_if(F.col("last_right").isNull() | (at > F.col("last_right"))).alias("wrong_streak"))  # one row
    fell = (F.col("n7") >= least[0]) & (F.col("n30") >= least[1]) & (F.col("acc30") - F.col("acc7") >= drop)
    return streak.withColumn("accuracy_drop", F.coalesce(fell, F.lit(False))).withColumn("alert", F.col("accuracy_drop") | (F.col("wrong_streak") >= wrong))


def add_scores(pred: DataFrame, column: str = "elo_diff", quarters: bool = False) -> DataFrame:
    """Predicted points of both sides (R23), and with ``quarters`` those of each quarter."""
    home, away = S.score_split(F.col(column))
    new = {"pred_home_score": home, "pred_away_score": away}
    for k, model in enumerate(S.QUARTER_MODELS if quarters else (), 1):
        new[f"pred_home_q{k}"], new[f"pred_away_q{k}"] = S.quarter_points(F.col(column), **model)
    return pred.withColumns(new)


def prob_to_diff(pred: DataFrame) -> DataFrame:
    """Rating difference that a probability stands for, and the score of it."""
    return add_scores(pred.withColumn("implied_diff", S.probability_to_diff(F.col("home_win_prob"))), "implied_diff")
