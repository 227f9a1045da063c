"""Rating, odds, probability and geography functions (F4-F15, F17-F21) as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

lit = F.lit


def _steps(x: Column, steps: list[tuple[float, float]], last: float) -> Column:
    """The value of the first step whose limit lies above ``x``, else ``last``."""
    out = None
    for limit, value in steps:
        out = F.when(x < limit, lit(value)) if out is None else out.when(x < limit, lit(value))
    return out.otherwise(lit(last))


def expected_score(own: Column, opponent: Column, home_advantage: float = 0.0) -> Column:
    return 1 / (1 + F.pow(lit(10.0), (opponent - own - home_advantage) / 400))


def mov_multiplier(margin: Column) -> Column:
    return F.log(F.abs(margin) + 1) / F.log(lit(15.0))


def score_split(diff: Column, average: float = 114.15, intercept: float = 2.8437, slope: float = 0.034507) -> tuple[Column, Column]:
    """Home and away points of a rating difference: at least 70 each, halves to even."""
    margin = lit(intercept) + slope * diff
    side = lambda s: F.greatest(lit(70.0), F.bround(lit(average) + s * margin / 2)).cast("int")
    return side(1), side(-1)


#: Lines of the home margin of quarters 1 to 4 on the rating difference, and mean points; fixed values.
QUARTER_MODELS = (
    {"intercept": -0.5825, "slope": 0.013153, "average": 28.531},
    {"intercept": -0.3412, "slope": 0.010222, "average": 28.3485},
    {"intercept": -0.636, "slope": 0.00939, "average": 28.443},
    {"intercept": -0.1658, "slope": 0.00546, "average": 27.2341},
)


def quarter_points(diff: Column, average: float, intercept: float, slope: float) -> tuple[Column, Column]:
    margin = lit(intercept) + slope * diff
    side = lambda s: F.greatest(lit(15.0), F.bround(lit(average) + s * margin / 2)).cast("int")
    return side(1), side(-1)


def confidence_cap(diff: Column) -> Column:
    return _steps(F.abs(diff), [(50, 0.55), (100, 0.65), (150, 0.75), (200, 0.82)], 0.90)


def capped_probability(p: Column, diff: Column) -> Column:
    """Home probability whose favourite is capped."""
    cap = confidence_cap(diff)
    return F.when(p > 0.5, F.least(p, cap)).when(p.isNotNull(), 1 - F.least(1 - p, cap))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    """Great-circle distance: radius 6371 for km, 3956 for miles; null where a place is unknown."""
    a1, a2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((a2 - a1) / 2), lit(2.0)) + F.cos(a1) * F.cos(a2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), lit(2.0))
    return F.when(a.isNotNull(), 2 * radius * F.asin(F.sqrt(F.least(a, lit(1.0)))))  # least() passes over nulls


def travel_penalty(miles: Column, zones: Column, road_streak: Column) -> Column:
    """Trips beyond 2000 miles (5 to 15 points), time zones crossed, and long road streaks."""
    far = F.when(miles > 2000, -F.least(lit(15.0), 5.0 + (miles - 2000) / 500)).otherwise(lit(0.0))
    road = F.when(road_streak > 4, -F.least((road_streak - 4) * 10.0, lit(30.0))).otherwise(0.0)
    return far - zones * 8.0 + road


def american_to_probability(price: Column) -> Column:
    return F.when(price < 0, -price / (100 - price)).otherwise(100 / (price + 100))


def american_to_decimal(price: Column) -> Column:
    return F.when(price < 0, 1 + 100 / -price).otherwise(1 + price / 100)


def probability_to_american(p: Column) -> Column:
    """Whole American odds, cut towards zero."""
    return F.when(p >= 0.5, -(p / (1 - p)) * 100).otherwise((1 - p) / p * 100).cast("int")


def parlay(probabilities: Column) -> Column:
    """Joint probability of an array of legs."""
    return F.aggregate(probabilities, lit(1.0), lambda a, x: a * x)


def season_confidence(games: Column) -> Column:
    return F.least(lit(1.0), 0.7 + 0.3 * games / 20)


def season_calibrated(p: Column, games: Column) -> Column:
    return 0.5 + (p - 0.5) * season_confidence(games)


def estimated_games(date: Column) -> Column:
    """Games played by a date, at one every second day from October 20."""
    start = F.make_date(F.when(F.month(date) >= 10, F.year(date)).otherwise(F.year(date) - 1), lit(10), lit(20))
    return F.greatest(lit(0), (F.datediff(date, start) * 0.5).cast("int"))


def game_context(date: Column, home_games: Column, away_games: Column, season_games: int = 82, in_race: Column | None = None) -> Column:
    """A struct of flags, their array and summary, and the capped penalty."""
    after = lambda m, d: F.datediff(date, F.make_date(F.year(date), lit(m), lit(d))).between(1, 3)
    most = F.greatest(home_games, away_games)
    flags = [
        ("is_post_christmas", "Post-Christmas", after(12, 25), 30.0),
        ("is_post_allstar", "Post-All-Star", (F.month(date) == 2) & F.dayofmonth(date).between(20, 23), 15.0),
        ("is_post_thanksgiving", "Post-Thanksgiving", after(11, 28), 10.0),
        ("is_season_opener", "Season Opener", (home_games < 5) | (away_games < 5), 20.0),
        ("is_playoff_push", "Playoff Push", (season_games - most <= 15) & (lit(True) if in_race is None else in_race), 10.0),
    ]
    names = F.array_compact(F.array(*[F.when(on, name) for _, name, on, _ in flags]))
    penalty = sum((F.when(on, v).otherwise(0.0) for _, _, on, v in flags), lit(0.0))
    text = F.when(F.size(names) == 0, "Normal game conditions").otherwise(F.concat(lit("Special circumstances: "), F.array_join(names, ", ")))
    return F.struct(*[on.alias(c) for c, _, on, _ in flags], names.alias("contextual_flags"), text.alias("context_summary"), F.least(penalty, lit(50.0)).alias("confidence_penalty"))


def confidence_score(diff: Column, rest_home: Column, rest_away: Column, injury_home: Column, injury_away: Column, form_home: Column, form_away: Column, holiday: Column, opener: Column, push: Column) -> Column:
    """Weighted score of five factors, its parts and its level."""
    elo = F.least(lit(100.0), 50 + 40 * F.tanh(F.abs(diff) / 150))
    gap = F.abs(rest_home - rest_away)
    rest = F.when(gap == 0, 100.0).when(gap == 1, 85.0).when(gap == 2, 70.0).otherwise(60.0)
    hurt = F.abs(injury_home) + F.abs(injury_away)
    injury = F.when(hurt == 0, 100.0).when(hurt <= 30, 85.0).when(hurt <= 60, 70.0).when(hurt <= 100, 60.0).otherwise(50.0)
    swing = F.abs(form_home) + F.abs(form_away)
    form = F.when(swing <= 20, 95.0).when(swing <= 40, 80.0).when(swing <= 60, 65.0).otherwise(50.0)
    off = lambda c, v: F.when(c, v).otherwise(0.0)
    context = F.greatest(lit(40.0), 100.0 - off(holiday, 30.0) - off(opener, 20.0) - off(push, 10.0))
    total = elo * 0.35 + rest * 0.15 + injury * 0.25 + form * 0.15 + context * 0.10
    level = F.when(total >= 75, "High").when(total >= 55, "Medium").otherwise("Low")
    return F.struct(total.alias("overall_confidence"), level.alias("confidence_level"), elo.alias("elo_confidence"), rest.alias("rest_confidence"), injury.alias("injury_confidence"), form.alias("form_confidence"), context.alias("contextual_confidence"))


def risk_level(confidence: Column) -> Column:
    return F.when(confidence >= 0.75, "VERY LOW RISK").when(confidence >= 0.65, "LOW RISK").when(confidence >= 0.55, "MODERATE RISK").otherwise("HIGH RISK")


def game_category(confidence: Column) -> Column:
    """By the favourite's probability."""
    steps = [(0.80, "Blowout"), (0.70, "Strong Favorite"), (0.60, "Moderate Favorite"), (0.55, "Slight Favorite")]
    out = lit("Toss-up")
    for edge, name in reversed(steps):
        out = F.when(confidence >= edge, name).otherwise(out)
    return out


def market_blend(model: Column, home: Column, away: Column, weight: float = 0.15) -> Column:
    """Model probability moved towards the normalised market, with divergence and alert."""
    market = home / (home + away)
    gap = model - market
    level = F.when(F.abs(gap) < 0.05, "high").when(F.abs(gap) < 0.10, "medium").otherwise("low")
    alert = F.abs(gap) >= 0.10
    reason = F.when(alert & ((model > 0.5) != (market > 0.5)), "different favorites").when(alert, "same favorite").otherwise("")
    return F.struct((model + weight * (market - model)).alias("blended"), gap.alias("divergence"), level.alias("agreement"), alert.alias("upset_alert"), reason.alias("alert_reason"))


def injury_severity(status: Column, days: Column) -> Column:
    s = F.lower(status)
    base = F.when(s == "out", 1.0).when(s == "doubtful", 0.8).when(s == "questionable", 0.5).when(s == "probable", 0.2).when(s == "available", 0.0).otherwise(0.5)
    return base * F.when(days > 7, 0.9).otherwise(1.0)


#: Upset probability beyond which a game is flagged.
UPSET_ALERT = 0.30


def upset_probability(diff: Column, p: Column, favourite_wins: Column, underdog_wins: Column, enough: Column) -> Column:
    base = _steps(F.abs(diff), [(50, 0.45), (100, 0.35), (150, 0.28), (200, 0.20)], 0.12)
    base = base + F.when(F.greatest(p, 1 - p) < 0.60, 0.10).otherwise(0.0)
    cold = enough & (favourite_wins <= 2)
    base = base + F.when(cold & (underdog_wins >= 4), 0.15).when(cold & (underdog_wins >= 3), 0.10).otherwise(0.0)
    return F.least(base, lit(0.55))


def calibrated_confidence(c: Column) -> Column:
    return F.when((c >= 0.70) & (c < 0.80), c * 0.9).when(c < 0.60, F.least(c * 1.05, lit(0.65))).otherwise(c)


def toss_up(p: Column, raw_diff: Column) -> Column:
    """Probability drawn to one half where the ratings differ by less than 30."""
    d = F.abs(raw_diff)
    return F.when(d < 30, 0.5 + (p - 0.5) * (d / 30)).otherwise(p)


def pace_style(points: Column, allowed: Column) -> tuple[Column, Column]:
    """Pace by mean points, defence by mean points allowed."""
    pace = F.when(points > 115, "Fast-paced").when(points > 108, "Moderate").otherwise("Slow-paced")
    defence = F.when(allowed < 111, "Elite defense").when(allowed < 116, "Average defense").otherwise("Weak defense")
    return pace, defence


def tempo_note(home: Column, away: Column) -> Column:
    """How two sides' paces meet, by their mean points."""
    note = F.when((home > 115) & (away > 115), "HIGH-SCORING POTENTIAL").when((home < 108) & (away < 108), "LOW-SCORING GAME")
    return note.when(F.abs(home - away) > 10, "PACE CLASH").otherwise("BALANCED MATCHUP")


def probability_to_diff(p: Column) -> Column:
    q = F.greatest(lit(1e-6), F.least(lit(1 - 1e-6), p))
    return -400 * F.log10(1 / q - 1)


def bpm(box: DataFrame) -> DataFrame:
    """Box rows with bpm, obpm and dbpm; 0 without minutes."""
    m = F.col("minutes")
    per = lambda c: F.col(c) / m * 36
    shots = F.col("fg_attempted") + 0.44 * F.col("ft_attempted")
    ts = F.when(shots > 0, F.col("points") / (2 * shots)).otherwise(0.55)
    off = (per("points") - 15) * 0.12 + (ts - 0.55) * 15 + (per("assists") - 3) * 0.6 + (per("rebounds") - 7) * 0.3 - (per("turnovers") - 2) * 0.8
    own = (per("steals") - 1.2) * 1.2 + (per("blocks") - 0.8) + (per("defensive_rebounds") - 5) * 0.2 + (per("plus_minus") - off) * 0.3
    clip = lambda x, lo, hi: F.when(m > 0, F.greatest(lit(lo), F.least(lit(hi), x))).otherwise(0.0)
    return box.select("*", clip(off + own, -12.0, 15.0).alias("bpm"), clip(off, -10.0, 12.0).alias("obpm"), clip(own, -8.0, 8.0).alias("dbpm"))


def rated(df: DataFrame, key: str = "team_id") -> Window:
    """The window that all per-team features share: one exchange on the key."""
    return Window.partitionBy(key).orderBy("date", "game_id")
