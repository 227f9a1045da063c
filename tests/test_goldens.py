"""Worked values of the rules that the rated reports follow, each from its own description."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from ratingmill.functions import scores as S
from ratingmill.operators import aggregates as A
from ratingmill.operators import games as G
from ratingmill.operators import predict as P
from ratingmill.operators import ratings as R
from ratingmill.operators import windows as W

DAY = date(2020, 1, 31)


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column).collect()]


def test_featured_games(spark):
    pred = spark.createDataFrame([(1, 0.557), (2, 0.908), (3, 0.682), (4, 0.61)], "game_id long, home_win_prob double")
    assert {(r.game_id, r.kind) for r in A.featured(pred).collect()} == {(1, "competitive"), (2, "blowout")}


def test_risk_category_and_price(spark):
    c = [(0.80,), (0.75,), (0.70,), (0.65,), (0.60,), (0.55,), (0.54,)]
    assert values(spark, S.risk_level(F.col("c")), c, "c double") == ["VERY LOW RISK"] * 2 + ["LOW RISK"] * 2 + ["MODERATE RISK"] * 2 + ["HIGH RISK"]
    assert values(spark, S.game_category(F.col("c")), c, "c double") == ["Blowout", "Strong Favorite", "Strong Favorite", "Moderate Favorite", "Moderate Favorite", "Slight Favorite", "Toss-up"]
    want = [int(-(p / (1 - p)) * 100) if p >= 0.5 else int((1 - p) / p * 100) for p in (0.8, 0.6, 0.5, 0.25, 0.3)]
    assert values(spark, S.probability_to_american(F.col("c")), [(0.8,), (0.6,), (0.5,), (0.25,), (0.3,)], "c double") == want


def test_travel_penalty(spark):
    penalty = S.travel_penalty(F.col("m"), F.col("z"), F.col("s"))
    assert values(spark, penalty, [(2000.0, 0, 0), (2500.0, 0, 0), (9000.0, 0, 0), (100.0, 2, 5), (2500.0, 1, 9)], "m double, z int, s int") == [0.0, -6.0, -15.0, -26.0, -44.0]


@pytest.mark.parametrize("degrees,penalty", [(10, 0.0), (20, -2.857), (40, -13.213), (50, -30.0)])
def test_travel_fatigue(spark, degrees, penalty):
    """Below 1000 miles none, from 3000 on 30, 15 for the 2000 between."""
    arenas = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, float(degrees))], "team_id long, latitude double, longitude double")
    rows = [(1, 1, 2, False, DAY - timedelta(2)), (2, 1, 2, True, DAY)]
    gl = spark.createDataFrame(rows, "game_id long, team_id long, opponent_id long, is_home boolean, date date")
    assert {r.game_id: round(r.travel_fatigue, 3) for r in W.travel_fatigue(gl, arenas).collect()}[2] == pytest.approx(penalty, abs=2e-3)


def test_no_travel_to_a_first_game(spark):
    arenas = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 30.0)], "team_id long, latitude double, longitude double")
    gl = spark.createDataFrame([(1, 1, 2, False, DAY), (2, 1, 9, False, DAY + timedelta(1)), (3, 1, 2, True, DAY + timedelta(2))], "game_id long, team_id long, opponent_id long, is_home boolean, date date")
    for mode in ("reference", "itinerary"):
        out = {r.game_id: (r.travel_km, r.long_travel) for r in W.travel(gl, arenas, mode=mode).collect()}
        assert out[1] == out[3] == (0.0, False)


@pytest.mark.parametrize(
    "won,kind,sure",
    [("", "insufficient_data", "none"), ("WL", "insufficient_data", "low"), ("WWL", "balanced", "medium"), ("WWW", "moderate_dominance", "medium"), ("WWWL", "moderate_dominance", "medium"), ("WWWWL", "strong_dominance", "high"), ("LLLLW", "strong_dominance", "high"), ("WWWLL", "balanced", "high")],
)
def test_head_to_head(spark, won, kind, sure):
    rows = [(k, DAY + timedelta(k), 1, 2, 100 + (10 if w == "W" else -10), 100) for k, w in enumerate(won)] + [(99, DAY + timedelta(99), 1, 2, 100, 90)]
    games = spark.createDataFrame(rows, "game_id long, date date, home_team_id long, away_team_id long, home_score long, away_score long")
    last = W.h2h(games).where("game_id = 99").first()
    assert (last.h2h_class, last.h2h_confidence) == (kind, sure)


def test_market_blend(spark):
    rows = spark.createDataFrame([(0.558, 0.524, 0.476), (0.68, 0.55, 0.45), (0.62, 0.49, 0.51)], "p double, h double, a double").coalesce(1)
    out = [r[0] for r in rows.select(S.market_blend(F.col("p"), F.col("h"), F.col("a"))).collect()]
    assert (round(out[0].blended, 4), round(out[0].divergence, 3), out[0].agreement, out[0].upset_alert) == (0.5529, 0.034, "high", False)
    assert [(r.upset_alert, r.alert_reason) for r in out[1:]] == [(True, "same favorite"), (True, "different favorites")]


def test_pace(spark):
    pace, defence = S.pace_style(F.col("p"), F.col("a"))
    rows = [(115.1, 110.9), (115.0, 111.0), (108.1, 115.9), (108.0, 116.0)]
    assert values(spark, pace, rows, "p double, a double") == ["Fast-paced", "Moderate", "Moderate", "Slow-paced"]
    assert values(spark, defence, rows, "p double, a double") == ["Elite defense", "Average defense", "Average defense", "Weak defense"]
    note = S.tempo_note(F.col("h"), F.col("a"))
    assert values(spark, note, [(116.0, 117.0), (107.0, 100.0), (120.0, 109.0), (110.0, 109.0)], "h double, a double") == ["HIGH-SCORING POTENTIAL", "LOW-SCORING GAME", "PACE CLASH", "BALANCED MATCHUP"]


def test_injury_severity(spark):
    rows = [("Out", 0), ("out", 8), ("doubtful", 7), ("questionable", 1), ("probable", 1), ("available", 1), ("day-to-day", 1), ("returning", 9)]
    assert values(spark, F.round(S.injury_severity(F.col("s"), F.col("d")), 6), rows, "s string, d int") == [1.0, 0.9, 0.8, 0.5, 0.2, 0.0, 0.5, 0.45]


PRED = "game_id long, date date, season_type string, home_score long, away_score long, home_win_prob double, confidence double, elo_diff double, picked_home boolean, correct boolean, enhanced boolean, home_b2b boolean, away_b2b boolean"


def predictions(spark):
    rows = []
    for k in range(40):
        home, picked = k % 3 > 0, k % 2 == 0
        rows.append((k, DAY - timedelta(k), "regular", 100 + 5 * home, 102, 0.6, 0.5 + k / 100, 5.0 * k, picked, home == picked, k % 4 == 0, k % 3 == 0, k % 20 == 0))
    return rows, spark.createDataFrame(rows, PRED)


def test_performance_summary(spark):
    rows, df = predictions(spark)
    out = A.performance_summary(df, as_of=DAY).first()
    share = lambda on: sum(r[9] for r in on) / len(on)
    week = [r for r in rows if r[1] >= DAY - timedelta(7)]
    assert (out.recent_games, out.recent_accuracy) == (8, share(week))
    sure, unsure = [r for r in rows if r[6] >= 0.70], [r for r in rows if r[6] < 0.60]
    assert (out.high_confidence_games, out.high_confidence_accuracy, out.low_confidence_games) == (len(sure), share(sure), len(unsure))
    assert (out.large_games, out.toss_up_games) == (20, 10)
    assert out.home_b2b_games == 14 and out.home_b2b_accuracy is not None and out.away_b2b_games == 2 and out.away_b2b_accuracy is None
    assert out.upsets == sum(not r[9] for r in rows) and out.upset_rate == pytest.approx(out.upsets / 40)
    assert out.home_predicted_correct == sum(r[8] and r[3] > r[4] for r in rows)


def test_recent_days_include_the_first(spark):
    rows, df = predictions(spark)
    assert A.recent_vs_all(df, 5).first().recent_games == 6
    out = P.drift(df, DAY).first()
    assert (out.n7, out.n30) == (8, 31)


def test_tiers(spark):
    df = spark.createDataFrame([(1700.0,), (1699.0,), (1650.0,), (1600.0,), (1500.0,)], "rating double")
    assert {r.tier: r.n for r in A.tiers_reached(df).collect()} == {"MVP candidates": 1, "All-Stars": 3, "Above Average": 4}
    bpm = spark.createDataFrame([(8.0,), (5.0,), (7.9,), (2.0,), (-2.0,), (-5.0,), (-5.1,)], "bpm double")
    assert {r.tier: r.n for r in A.tier_counts(bpm, A.BPM_TIERS, "bpm", "Poor").collect()} == {"Elite": 1, "Excellent": 2, "Good": 1, "Average": 1, "Below": 1, "Poor": 1}
    games = spark.createDataFrame([(99,), (100,), (299,), (300,), (600,)], "n int")
    assert {r.tier: r.n for r in A.tier_counts(games, A.EXPERIENCE_TIERS, "n", "Rookies/Young").collect()} == {"Rookies/Young": 1, "Developing": 2, "Prime": 1, "Veterans": 1}


def test_bpm_on_an_edge(spark):
    """-5 and -2 but for the last bit."""
    names = "minutes points fg_attempted ft_attempted assists rebounds turnovers steals blocks defensive_rebounds plus_minus".split()
    box = spark.createDataFrame([(40.0, 0, 15, 4, 6, 1, 3, 0, 0, 0, 22), (25.0, 25, 10, 0, 6, 5, 2, 0, 1, 3, -28)], names)
    assert {r.tier: r.n for r in A.tier_counts(S.bpm(box), A.BPM_TIERS, "bpm", "Poor", nudge=1e-8).collect()} == {"Below": 1, "Average": 1}


def test_quarters_come_apart_after_the_exchanges(spark):
    q = spark.createDataFrame([(g, DAY, 2 * g + h, h == 0, 20 + g, 21, 22 + h, 23 + g * h) for g in range(9) for h in (0, 1)], "game_id long, date date, team_id long, is_home boolean, q1 long, q2 long, q3 long, q4 long")
    hist = q.select("game_id", "team_id", (1500.0 + F.col("team_id") % 5).alias("rating_before"))
    out = A.fit_quarter_models(q, hist)
    assert {r.quarter: (r.games, r.league_average) for r in out.collect()} == {1: (9, 24.0), 2: (9, 21.0), 3: (9, 22.5), 4: (9, 25.0)}
    plan = A.fit_quarter_models(q, hist)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(game_id" in plan
    for line in (x for x in plan.splitlines() if "hashpartitioning(game_id" in x):
        assert "quarter" not in line.split("hashpartitioning")[1]


def test_eras(spark):
    rows = [(k, 1500.0 + k, 100 if k % 4 else 99, (2005, 2009, 2030, 2020)[k % 4]) for k in range(80)]
    out = A.top_by_era(spark.createDataFrame(rows, "player_id long, rating double, games_played int, last_season int")).collect()
    assert {r.era: sum(o.era == r.era for o in out) for r in out} == {"2000s Era": 10, "2020s Era (Current)": 10}
    for r in out:
        first, last = A.ERAS[r.era]
        assert first <= r.last_season <= last and r.games_played >= 100 and r.rank <= 10


def test_key_injuries(spark):
    injuries = spark.createDataFrame([(1, 7, "out"), (2, 7, "out"), (3, 7, "doubtful"), (4, 7, "out"), (5, 8, "out")], "player_id long, team_id long, status string")
    ratings = spark.createDataFrame([(1, 1600.0), (2, 1601.0), (3, 1401.0), (4, 1400.0)], "player_id long, rating double")
    out = {r.player_id: (r.impact, r["rank"]) for r in A.key_injuries(injuries, ratings).collect()}
    assert out == {2: ("star", 1), 1: ("starter", 2), 3: ("starter", 3), 5: ("role", 1)}


@pytest.mark.parametrize("behind,state", [(0, "UP TO DATE"), (1, "CURRENT"), (2, "MOSTLY CURRENT"), (3, "MOSTLY CURRENT"), (4, "OUTDATED")])
def test_data_status(spark, behind, state):
    rows = [(1, DAY, 100, 90), (2, DAY + timedelta(9), 0, 0), (3, DAY + timedelta(20), 0, 0)]
    out = A.status(spark.createDataFrame(rows, "game_id long, date date, home_score long, away_score long"), DAY + timedelta(behind)).first()
    assert (out.state, out.first_scheduled, out.last_scheduled) == (state, DAY + timedelta(9), DAY + timedelta(20))


@pytest.mark.parametrize("covered,minutes,word", [(20, 240.0, "EXCELLENT"), (19, 235.0, "EXCELLENT"), (19, 250.0, "GOOD"), (18, 240.0, "GOOD"), (17, 240.0, "NEEDS ATTENTION"), (20, 251.0, "NEEDS ATTENTION")])
def test_verdict(spark, covered, minutes, word):
    games = spark.createDataFrame([(k, 100, 90) for k in range(20)], "game_id long, home_score long, away_score long")
    box = spark.createDataFrame([(k, 1, minutes, 1, 1, 1, 1) for k in range(covered)], "game_id long, team_id long, minutes double, plus_minus int, points int, rebounds int, assists int")
    assert A.verdict(box, games).first().verdict == word
    assert A.verdict(box.drop("points"), games).first().verdict == "INCOMPLETE"


def test_form_run_of_losses(spark):
    """A tie among the losses is no unbroken run; three losses are, and count 1.2 times."""
    for margins, streak, factor in (([-3, -3, -3], "losing", 1.2), ([-3, 0, -3], "mixed", 1.0), ([3, 3, 3], "winning", 1.2)):
        rows = [(k, 1, DAY + timedelta(k), m, m > 0) for k, m in enumerate([*margins, 1])]
        last = W.form(spark.createDataFrame(rows, "game_id long, team_id long, date date, margin long, won boolean")).where("game_id = 3").first()
        assert last.streak_type == streak and last.form == pytest.approx(sum(margins) / 3 * 0.1 * 50 * factor)


def test_quarter_points(spark):
    home, away = S.quarter_points(F.col("d"), **S.QUARTER_MODELS[0])
    rows = [(0.0,), (100.0,), (-5000.0,)]
    margin = lambda d: -0.5825 + 0.013153 * d
    assert values(spark, home, rows, "d double") == [max(15, round(28.531 + margin(d) / 2)) for (d,) in rows]
    assert values(spark, away, rows, "d double") == [max(15, round(28.531 - margin(d) / 2)) for (d,) in rows]


def test_player_head_to_head_needs_two_known_players(spark):
    box = spark.createDataFrame([(g, DAY, p, 1 if p < 20 else 2, 30.0, False, p % 7, 10) for g in range(4) for p in (10, 11, 20, 21)], "game_id long, date date, player_id long, team_id long, minutes double, didNotPlay boolean, plus_minus long, points long")
    tops = lambda ids: spark.createDataFrame([(p, 1 if p < 20 else 2, 1800.0) for p in ids], "player_id long, team_id long, rating double")
    assert P.player_h2h(None, box, tops([10, 11, 20, 21])).count() == 1
    assert P.player_h2h(None, box, tops([10, 11, 20])).count() == 0


def test_players_who_did_not_play(spark):
    box = spark.createDataFrame([(1, 5, 9, True), (1, 5, 8, True), (1, 5, 7, False), (1, 6, 1, False)], "game_id long, team_id long, player_id long, didNotPlay boolean")
    assert [(r.game_id, r.team_id, r.did_not_play) for r in A.did_not_play(box).collect()] == [(1, 5, [8, 9])]


# predictions


def _two_games(spark):
    """A past game of teams 1 and 2, and one between them with what the models take."""
    rows = [(9, DAY, 1, 2, 1520.0, 1490.0, 12.0, 1600.0, 1400.0, 10.0, -5.0, -46.0, 0.0)]
    return spark.createDataFrame(rows, "game_id long, date date, home_team_id long, away_team_id long, home_rating double, away_rating double, h2h_adjustment double, home_roster double, away_roster double, home_form double, away_form double, home_rest_penalty double, away_rest_penalty double")


def test_adaptive_weights(spark):
    """Close games: half team, fifths of roster and form points, a tenth of rest points; no cap."""
    out = P.predict_adaptive(_two_games(spark)).first()
    home = 0.5 * 1520 + 0.2 * 1600 + 0.2 * 10 + 0.1 * -46
    away = 0.5 * 1490 + 0.2 * 1400 + 0.2 * -5
    assert (out.home_final, out.away_final) == (pytest.approx(home), pytest.approx(away))
    assert out.home_win_prob == pytest.approx(1 / (1 + 10 ** ((away - home - 60) / 400)))
    far = P.predict_adaptive(_two_games(spark).withColumn("away_rating", F.lit(1300.0))).first()
    assert far.home_final == pytest.approx(0.7 * 1520 + 0.3 * 1600)


GAMES = "game_id long, date date, home_team_id long, away_team_id long, home_score long, away_score long"
HIST = "game_id long, date date, team_id long, rating_before double, rating_after double, is_home boolean"


def _met(spark, scores=((120, 100), (118, 100), (119, 100))):
    """Games of 1 at home against 2, months apart, and one more; ratings of both."""
    days = [DAY - timedelta(100 * (len(scores) - k)) for k in range(len(scores))]
    games = [(k, d, 1, 2, *s) for k, (d, s) in enumerate(zip(days, scores, strict=True))] + [(99, DAY, 1, 2, 100, 90)]
    hist = [(k, d, t, 1500.0, 1510.0 if t == 1 else 1490.0, t == 1) for k, d in enumerate(days) for t in (1, 2)] + [(99, DAY, t, 1500.0, 1500.0, t == 1) for t in (1, 2)]
    return spark.createDataFrame(games, GAMES), spark.createDataFrame(hist, HIST)


def test_meetings_count_for_the_home_side_only(spark):
    games, hist = _met(spark)
    last = games.where("game_id = 99")
    light = P.predict_light(last, hist, games).first()
    met = W.h2h_margin(games).where("game_id = 99").first().h2h_margin
    assert met == 50 and light.home_final == pytest.approx(1510 + 0.07 * met + 0.05 * light.home_tier_points)
    assert light.away_final == pytest.approx(1490 + 0.05 * light.away_tier_points)
    none = spark.createDataFrame([], "team_id long, roster_elo double")
    hurt, arenas = spark.createDataFrame([], "team_id long, injury_adjustment double"), spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 1.0)], "team_id long, latitude double, longitude double")
    out = P.predict_hybrid(last, hist, games, none, hurt, arenas).first()
    rest = lambda s: out[f"{s}_b2b_penalty"] + out[f"{s}_density_penalty"] + out[f"{s}_welo"] * min(1, abs(out.raw_diff) / 30) + out[f"{s}_injury"] + out[f"{s}_travel_fatigue"]
    assert out.home_final == pytest.approx(out.home_hybrid + rest("home") + 0.15 * out.h2h_recency) and out.h2h_recency == 15
    assert out.away_final == pytest.approx(out.away_hybrid + rest("away"))


def test_concentration_moves_ratings_before_the_cap(spark):
    games, hist = _met(spark)
    metrics = spark.createDataFrame([(1, 80.0, 100.0, 0.9), (2, 0.0, 0.0, 0.1)], "team_id long, top_player_bonus double, top_5_depth double, concentration_risk double")
    plain = P.predict_team(games.where("game_id = 99"), hist, games).first()
    out = P.predict_team(games.where("game_id = 99"), hist, games, metrics=metrics).first()
    assert out.home_final == pytest.approx(plain.home_final + 90) and out.away_final == pytest.approx(plain.away_final)
    diff = out.home_final - out.away_final
    p = 1 / (1 + 10 ** ((-diff - 20) / 400))
    cap = next((c for edge, c in ((50, 0.55), (100, 0.65), (150, 0.75), (200, 0.82)) if abs(diff) < edge), 0.9)
    assert out.home_win_prob == pytest.approx(min(p, cap)) and out.confidence == pytest.approx(min(p, cap) * (1 - 0.2 * 0.9))


def test_upset_form_is_of_ten_days(spark):
    days = [30, 20, 10, 4, 2]
    rows = [(k, 1, DAY - timedelta(d), 5, True) for k, d in enumerate(days)] + [(9, 1, DAY, 0, False)]
    gl = spark.createDataFrame([(g, t, d, m, w, 2) for g, t, d, m, w in rows], "game_id long, team_id long, date date, margin long, won boolean, opponent_id long")
    out = W.momentum(gl).where("game_id = 9").first()
    assert (out.wins, out.games, out.late_wins, out.late_games) == (5, 5, 3, 3)


def test_rest_impact(spark):
    """Back-to-backs count whatever the other side has; first games are out; two days make rested."""
    sides = [(1, 0, 0, True), (2, 0, 3, False), (3, 2, 2, True), (4, 1, 2, True), (5, -1, 0, True), (6, 3, 0, True)]
    rows = [(g, True, h, won) for g, h, _, won in sides] + [(g, False, a, not won) for g, _, a, won in sides]
    out = {r.situation: (r.games, r.home_win_rate) for r in A.rest_impact(spark.createDataFrame(rows, "game_id long, is_home boolean, rest_days int, won boolean")).collect()}
    assert out == {"home_b2b": (2, 0.5), "away_b2b": (2, 1.0), "both_rested": (1, 1.0)}


def test_rest_categories(spark):
    at = [0, 1, 3, 6, 10, 15]
    gl = spark.createDataFrame([(k, 1, DAY + timedelta(d)) for k, d in enumerate(at)], "game_id long, team_id long, date date")
    assert [r.rest_category for r in W.rest(gl).orderBy("game_id").collect()] == ["first_game", "back_to_back", "one_day_rest", "normal_rest", "normal_rest", "extended_rest"]


def test_form_of_few_games(spark):
    rows = [(k, 1, DAY + timedelta(k), 5, True) for k in range(5)]
    out = W.form(spark.createDataFrame(rows, "game_id long, team_id long, date date, margin long, won boolean")).orderBy("game_id")
    assert [r.streak_type for r in out.collect()] == ["none", "insufficient_data", "insufficient_data", "winning", "winning"]


def _forms(spark):
    rows = [(k, t, DAY + timedelta(k), won, 110 if won else 90, 100, 10 if won else -10) for t, text in ((1, "LLWWW"), (2, "WWWLL"), (3, "WWLWW")) for k, won in enumerate(c == "W" for c in text)]
    return W.recent_form(spark.createDataFrame(rows, "game_id long, team_id long, date date, won boolean, team_score long, opponent_score long, margin long"))


def test_recent_results_are_newest_first(spark):
    out = {r.team_id: (r.results, r.streak_type, r.streak_length) for r in _forms(spark).collect()}
    assert out == {1: ("WWWLL", "W", 3), 2: ("LLWWW", "L", 2), 3: ("WWLWW", "W", 2)}


def test_compare_form(spark):
    games = spark.createDataFrame([(1, 1, 2), (2, 3, 2), (3, 1, 7)], "game_id long, home_team_id long, away_team_id long")
    out = {r.game_id: r for r in W.compare_form(games, _forms(spark)).collect()}
    assert sorted(out) == [1, 2]
    assert (out[1].form_advantage, out[1].form_text, out[1].home_momentum, out[1].away_momentum) == (None, "similar", "up", "down")
    assert (out[2].form_advantage, out[2].form_text, out[2].scoring_advantage) == (3, "significantly better", 3)


def test_change_needs_five_games(spark):
    rows = [(k, t, DAY + timedelta(k), 1500.0 + k, 1501.0 + k, True) for t, n in ((1, 4), (2, 5), (3, 9)) for k in range(n)]
    out = {r.team_id: (r.change, r.wins) for r in W.elo_change_games(spark.createDataFrame(rows, "game_id long, team_id long, date date, rating_before double, rating_after double, won boolean")).collect()}
    assert out == {2: (5.0, 5), 3: (5.0, 5)}


def test_parlays_of_very_low_risk(spark):
    pred = spark.createDataFrame([(1, DAY, 0.9), (2, DAY, 0.8), (3, DAY, 0.76), (4, DAY, 0.7), (5, DAY + timedelta(1), 0.8)], "game_id long, date date, confidence double")
    report = P.betting_report(pred)
    out = {r.num_bets: r for r in P.best_parlays(report).collect()}
    fair = [int(-(p / (1 - p)) * 100) for p in (0.9, 0.8, 0.76)]
    two = (1 + 100 / -fair[0]) * (1 + 100 / -fair[1])
    assert sorted(out) == [2, 3] and out[2].games == "1+2" and out[2].probability == pytest.approx(0.72) and out[2].risk == "LOW RISK"
    assert out[2].decimal_odds == pytest.approx(two) and out[2].combined_odds == int(-100 / (two - 1))
    day = P.betting_summary(report).orderBy("date").first()
    assert (day.total_games, day.total_recommended, day.very_low_count, day.low_count, day.top_games) == (4, 4, 3, 1, "1,2,3,4")


def test_league_average(spark):
    """Regular games with home points only; too few since the start, then all since three years before it."""
    rows = [(date(2024, 11, 1), "regular", 110, 100), (date(2024, 11, 2), "playoff", 150, 150), (date(2024, 11, 3), "regular", 0, 20), (date(2022, 1, 1), "regular", 90, 80), (date(2021, 1, 1), "regular", 10, 10)]
    games = spark.createDataFrame(rows, "date date, season_type string, home_score long, away_score long")
    few, enough = (A.league_average(games, date(2024, 10, 1), n).first() for n in (2, 1))
    assert (few.league_average, few.from_holdout) == (95.0, False) and (enough.league_average, enough.from_holdout) == (105.0, True)


def test_daily_statistics(spark):
    rows = [(DAY, True, 99.0, True, 0.6), (DAY, False, -100.0, False, 0.7), (DAY, None, -5.0, True, 0.8)]
    out = A.daily_stats(spark.createDataFrame(rows, "date date, correct boolean, elo_diff double, enhanced boolean, confidence double")).first()
    assert (out.games, out.completed, out.correct, out.accuracy, out.close_games, out.enhanced_games, out.avg_confidence) == (3, 2, 1, 0.5, 2, 2, pytest.approx(0.7))


def test_quarter_averages(spark):
    rows = [(1, 20, 25, 25, 30), (1, 30, 25, 25, 30), (2, 20, 25, 27, 24), (2, 20, 25, 27, 24)]
    out = A.quarter_averages(spark.createDataFrame(rows, "game_id long, q1 int, q2 int, q3 int, q4 int")).first()
    assert (out.mean_q1, out.std_q1, out.mean_q4, out.late_delta) == (22.5, pytest.approx(12.5**0.5), 27.0, 4.5)


def test_travel_impact(spark):
    rows = [(0.0, False, True, 5.0, 0.5), (400.0, False, False, -5.0, 0.4), (1600.0, True, False, -10.0, 0.3), (1700.0, True, True, 10.0, 0.7)]
    t = spark.createDataFrame(rows, "travel_km double, long_travel boolean, won boolean, rating_change double, expected_score double")
    bins = {r.bin: (r.games, r.win_rate, r.avg_change, round(r.avg_expected, 9)) for r in A.travel_bins(t).collect()}
    assert bins == {"0-500": (1, 0.0, -5.0, 0.4), "1500-2000": (2, 0.5, 0.0, 0.5)}  # no trip, no bin
    got = A.travel_impact(t).first()
    assert (got.long_win_rate, got.normal_win_rate, got.impact, got.long_games, got.avg_km) == (0.5, 0.5, 0.0, 2, 925.0)
    assert A.travel_impact(t.limit(0)).first().impact is None


def test_minutes_of_whole_games(spark):
    box = spark.createDataFrame([(1, 1, 150.0), (1, 2, 95.0), (2, 1, 300.0)], "game_id long, team_id long, minutes double")
    assert A.minutes_check(box, by=("game_id",)).first()[:] == (2, 272.5, 0, 1, False)
    assert A.minutes_check(box).first()[:2] == (3, 545 / 3)


def test_slate_places(spark):
    """Page: scheduled, live, final, each by time. Summary: time, then the most lopsided."""
    rows = [(1, 3, "19:00", 0.5), (2, 1, "20:00", 0.6), (3, 1, "20:00", 0.2), (4, 2, "19:00", 0.9), (5, None, None, None), (6, 9, "18:00", 0.6)]
    g = spark.createDataFrame(rows, "game_id long, status_code int, tipoff string, home_win_prob double").withColumn("date", F.lit("2000-01-01").cast("date"))
    got = A.slate_places(g).collect()
    assert [r.game_id for r in sorted(got, key=lambda r: r.page_place)] == [5, 6, 2, 3, 4, 1]
    assert [r.game_id for r in sorted(got, key=lambda r: r.summary_place)] == [5, 6, 4, 1, 3, 2]


def test_multipliers_by_name(spark):
    players = spark.createDataFrame([(1, "RUDY GOBERT"), (2, "Steph Curry"), (3, "De'Aaron Fox"), (4, "Rudy Gobert Jr"), (5, None), (1, "Rudy Gobert")], "player_id long, player_name string")
    assert {r.player_id: r.position_multiplier for r in R.name_multipliers(players).collect()} == {1: 0.9, 2: 1.08, 3: 1.08}
    names = spark.createDataFrame([("rudy gobert jr", 0.5), ("Rudy Gobert JR", 0.7), (None, 2.0)], "player_name string, position_multiplier double")
    assert [tuple(r) for r in R.name_multipliers(players, names).collect()] == [(4, 0.7)]


def test_missing_tables_are_stale(spark):
    days = spark.sql("select date '2001-08-01' as date")
    got = A.freshness({"a": days, "b": days.limit(0)}, date(2001, 8, 4)), A.freshness({"a": days}, date(2001, 8, 5))
    assert [(r.table, r.stale, r.status) for df in got for r in df.collect()] == [("a", False, "OK"), ("b", True, "MISSING"), ("a", True, "WARNING")]


def test_history_of_a_player_in_a_season(spark):
    rows = [(1, 7, "2000-04-01"), (3, 7, "2000-11-02"), (2, 7, "2000-11-01"), (4, 8, "2000-11-01")]
    h = spark.createDataFrame(rows, "game_id long, player_id long, date string").withColumn("date", F.to_date("date")).withColumns({"rating_after": F.lit(1.0), "minutes": F.lit(2.0), "plus_minus": F.lit(3)})
    assert [r.game_id for r in G.player_history(h, 7, 2000).collect()] == [2, 3]
    assert [r.game_id for r in G.player_history(h, 7).collect()] == [1, 2, 3]
