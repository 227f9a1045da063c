"""Queries over games, joins, aggregates and rankings."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ratingmill.functions import parse
from ratingmill.operators import aggregates as A
from ratingmill.operators import games as G
from ratingmill.operators import summaries as U
from ratingmill.plans.base import AS_OF, DAY, EXP, SEASON, query, rounded
from ratingmill.sources import tables as T


def _quarter_moments(f):
    """Lines of each quarter's home margin before a day, from moments by day and quarter."""
    q = f.quarters.select("game_id", "date", "is_home", F.posexplode(F.array("q1", "q2", "q3", "q4")).alias("k", "points"))
    margin = q.groupBy("game_id", "date", "k").agg(F.sum(F.when(F.col("is_home"), F.col("points")).otherwise(-F.col("points"))).alias("margin"))
    diff = f.hist.groupBy("game_id").agg(F.sum(F.when(F.col("is_home"), F.col("rating_before")).otherwise(-F.col("rating_before"))).alias("diff"))
    rows = margin.join(diff, "game_id").withColumn("quarter", F.col("k") + 1)
    by = ("date", "quarter")
    old, new = (U.daily_moments(rows.where(on), "diff", "margin", by) for on in ("game_id % 2 = 0", "game_id % 2 = 1"))
    return U.fit_moments(U.add_moments(old, new, by), U.before(AS_OF), ("quarter",)).select("quarter", "slope", "intercept", "train_r2", "train_n")


# P: projections and filters
query("p1_completed", lambda f: G.completed(f.games).select("game_id", "home_score", "away_score"), "done", "select game_id, home_score, away_score from done")
query("p1_completed_both", lambda f: G.completed(f.games, "both").agg(F.count("*").alias("n")), "games", "select count(*) as n from games where home_score > 0 and away_score > 0")
query("p2_between", lambda f: T.between(f.games, date(1999, 10, 1), AS_OF, "playoff").select("game_id", "date"), "games", f"select game_id, date from games where date between date '1999-10-01' and {DAY} and season_type = 'playoff'")
query("p3_active_only", lambda f: G.active_only(f.long, f.roster.where("position = 'G'").select("team_id").distinct()).groupBy("team_id").agg(F.count("*").alias("n")), "long roster", "select team_id, count(*) as n from long where team_id in (select team_id from roster where position = 'G') group by 1")
query("p4_long_form", lambda f: G.to_long(f.done).select("game_id", "team_id", "opponent_id", "is_home", "margin", "won"), "long", "select game_id, team_id, opponent_id, is_home, margin, won from long")
query("p5_search_players", lambda f: G.search_players(f.ratings, "ayer 10").select("player_id", "player_name", "rating"), "ratings", "select player_id, player_name, rating from ratings where contains(lower(player_name), 'ayer 10') order by rating desc, player_id limit 20")
query("p6_compare", lambda f: G.compare(f.ratings, [1, 1001, 5003, 20011]).select("player_id", "rating", "games_played"), "ratings", "select player_id, rating, games_played from ratings where player_id in (1, 1001, 5003, 20011)")
query("p7_seasons", lambda f: G.with_season(f.games).groupBy("season", "season_label").agg(F.count("*").alias("n")), "games", f"select season, season || '-' || lpad(cast((season + 1) % 100 as varchar), 2, '0') as season_label, count(*) as n from (select {SEASON} as season from games) g group by 1, 2")
query("p8_remaining", lambda f: G.remaining_by_team(f.games, AS_OF), "games", f"""
, r as (select * from games where date > {DAY} and {SEASON} = 1999 and home_score = 0 and away_score = 0),
l as (select home_team_id as team_id, 1 as h from r union all select away_team_id, 0 from r)
select team_id, count(*) as remaining, cast(sum(h) as bigint) as home_remaining, cast(sum(1 - h) as bigint) as away_remaining from l group by 1""")
query("p9_history", lambda f: G.history_of(f.hist, 100).select("game_id", "date", "rating_after", "rest_days", "b2b"), "hist", """
select game_id, date, rating_after, date_diff('day', lag(date) over w, date) - 1 as rest_days, coalesce(date_diff('day', lag(date) over w, date) <= 1, false) as b2b
from hist where team_id = 100 window w as (order by date, game_id)""")
query("p10_past_predictions", lambda f: G.past_predictions(f.pred, AS_OF, 14).select("game_id", "date", "home_win_prob", "correct"), "pred", f"select game_id, date, home_win_prob, correct from pred where date between {DAY} - 14 and {DAY}")

query("p10_summary", lambda f: rounded(G.past_summary(f.pred, AS_OF, 14), "accuracy"), "pred", f"select count(correct) as games, count(*) filter (correct) as right, round(avg(cast(correct as int)), 6) as accuracy, max(date) as last_date from pred where date between {DAY} - 14 and {DAY}")

# J: joins
query("j1_training_set", lambda f: G.elo_training_set(f.done, f.hist).select("game_id", "elo_diff", "actual_margin"), "hist", "select h.game_id, h.rating_before - a.rating_before as elo_diff, h.team_score - a.team_score as actual_margin from hist h join hist a on a.game_id = h.game_id and h.is_home and not a.is_home")
query("j2_left_default", lambda f: G.left_default(f.roster, f.ratings.where("player_id % 3 <> 0")).select("player_id", "rating"), "ratings", "select r.player_id, coalesce(x.rating, 1500) as rating from roster r left join ratings x on x.player_id = r.player_id and x.player_id % 3 <> 0")
for inclusive, op in ((False, "<"), (True, "<=")):
    query(f"j3_asof_ratings{'_inclusive' * inclusive}", lambda f, i=inclusive: G.asof_ratings(f.done, f.hist, i).select("game_id", "home_rating", "away_rating"), "hist", f"""
, x as (select team_id, date, max_by(rating_after, game_id) as r from hist group by 1, 2),
o as (select g.game_id, g.side, coalesce(x.r, 1500) as r from (
  select game_id, date, home_team_id as team_id, 'h' as side from done union all select game_id, date, away_team_id, 'a' from done) g
  asof left join x on x.team_id = g.team_id and g.date {'>' if op == '<' else '>='} x.date)
select game_id, max(r) filter (side = 'h') as home_rating, max(r) filter (side = 'a') as away_rating from o group by 1""")  # noqa: S608
query("j4_name_join", lambda f: G.name_join(f.ratings.select("player_name", "rating"), f.roster.select("player_name", "team_id").withColumn("player_name", F.concat(F.upper("player_name"), F.lit(".")))).select("name_key", "rating", "team_id"), "ratings", "select lower(player_name) as name_key, x.rating, r.team_id from ratings x join roster r using (player_name)")
query("j5_map_codes", lambda f: G.map_codes(f.long.select("game_id", F.concat(F.lit("T"), F.col("team_id")).alias("code")), f.arenas.where("team_id % 5 <> 0").select(F.concat(F.lit("T"), F.col("team_id")).alias("code"), "team_id")).groupBy("team_id").agg(F.count("game_id").alias("n")), "long", "select team_id, count(*) as n from long where team_id % 5 <> 0 group by 1")
query("j6_lookup_by_date", lambda f: G.lookup_by_date(f.quarters.select("game_id", "team_id", "date", "q1"), f.hist).select("game_id", "team_id", "q1", "rating_before"), "quarters hist", """
, x as (select team_id, date, min_by(rating_before, game_id) as rating_before from hist group by 1, 2)
select q.game_id, q.team_id, q.q1, x.rating_before from quarters q join x using (team_id, date)""")
query("j7_new_rows", lambda f: T.new_rows(f.games, f.games.where("game_id % 3 = 0")).select("game_id"), "games", "select game_id from games where game_id % 3 <> 0")
query("j8_recent_players", lambda f: G.recent_players(f.box, 30, AS_OF), "box", f"select distinct player_id, team_id from box where date between {DAY} - 30 and {DAY}")
query("j9_pair_key", lambda f: G.pair_key(f.games).groupBy("team_a", "team_b").agg(F.count("*").alias("n"), F.max("date").alias("last_date")), "games", "select least(home_team_id, away_team_id) as team_a, greatest(home_team_id, away_team_id) as team_b, count(*) as n, max(date) as last_date from games group by 1, 2")
query("j10_player_pairs", lambda f: G.player_pairs(f.box).groupBy("player_id1", "player_id2").agg(F.count("*").alias("n"), F.sum(F.col("plus_minus1") - F.col("plus_minus2")).alias("diff")), "box", """
, b as (select * from box where minutes > 0 and not didNotPlay)
select x.player_id as player_id1, y.player_id as player_id2, count(*) as n, cast(sum(x.plus_minus - y.plus_minus) as bigint) as diff
from b x join b y on x.game_id = y.game_id and x.team_id <> y.team_id and x.player_id < y.player_id group by 1, 2""")
query("j11_roster_diff", lambda f: G.roster_diff(f.roster.where("player_id % 5 <> 0"), f.roster.where("player_id % 7 <> 0").withColumn("team_id", F.col("team_id") + F.when(F.col("player_id") % 11 == 0, 1).otherwise(0))), "roster", """
, d as (select a.player_id as p, a.team_id as old_team, b.player_id as q, b.team_id + case when b.player_id % 11 = 0 then 1 else 0 end as new_team
  from (select * from roster where player_id % 5 <> 0) a full outer join (select * from roster where player_id % 7 <> 0) b on a.player_id = b.player_id)
select coalesce(p, q) as player_id, old_team, new_team, case when p is null then 'added' when q is null then 'removed' else 'moved' end as change
from d where p is null or q is null or old_team <> new_team""")
def _named_rosters(f):
    name = lambda t: F.concat(F.lit("Team "), t)
    names = f.arenas.select(F.hex("team_id").alias("code"), name(F.col("team_id").cast("string")).alias("name"))
    old = f.roster.select("player_name", F.when(F.col("player_id") % 2 == 0, F.lower(F.hex("team_id"))).otherwise(name(F.col("team_id").cast("string"))).alias("team"))
    new = f.roster.select("player_name", name((F.col("team_id") + F.when(F.col("player_id") % 11 == 0, 1).otherwise(0)).cast("string")).alias("team"))
    return G.roster_diff(old, new, "player_name", "team", names)


query("j11_roster_diff_by_name", _named_rosters, "roster", "select player_name, 'Team ' || team_id as old_team, 'Team ' || (team_id + 1) as new_team, 'moved' as change from roster where player_id % 11 = 0")
query("j12_match_odds", lambda f: G.match_odds(
    f.done.select("game_id", "date", F.concat(F.lit("Team "), F.col("home_team_id"), F.lit(" Stars")).alias("home_team_name"), F.concat(F.lit("Team "), F.col("away_team_id"), F.lit(" Stars")).alias("away_team_name")),
    f.done.select("date", F.concat(F.lit("TEAM "), F.col("home_team_id"), F.lit(" ")).alias("home_team"), F.concat(F.lit("team "), F.col("away_team_id"), F.lit(" ")).alias("away_team"), F.col("game_id").alias("odds_id"))).select("game_id", "odds_id"), "done",
    "select g.game_id, o.game_id as odds_id from done g join done o on g.date = o.date and g.home_team_id = o.home_team_id and g.away_team_id = o.away_team_id")
query("j12_match_any_date", lambda f: G.match_odds(
    f.done.select("game_id", "date", F.concat(F.lit("Team "), F.col("home_team_id")).alias("home_team_name"), F.concat(F.lit("Team "), F.col("away_team_id"), F.lit(" Stars")).alias("away_team_name")),
    f.done.select("date", F.concat(F.lit("the TEAM "), F.col("home_team_id"), F.lit(" of 9")).alias("home_team"), F.concat(F.lit("team "), F.col("away_team_id"), F.lit(" ")).alias("away_team")).distinct().withColumn("odds_id", F.xxhash64("date", "home_team", "away_team") % 1000), by_date=False).groupBy("game_id").agg(F.count("*").alias("n")), "done", """
, o as (select distinct date, home_team_id as h, away_team_id as a from done),
c as (select 'team ' || n.h as name, 'the team ' || o.h || ' of 9' as other, n.h as nh, o.h as oh from (select distinct h from o) n, (select distinct h from o) o where contains('the team ' || o.h || ' of 9', 'team ' || n.h)),
k as (select c.nh, o.a, count(*) as n from c join o on o.h = c.oh group by 1, 2)
select game_id, n from done join k on k.nh = home_team_id and k.a = away_team_id""")
query("j13_games_in_days", lambda f: G.count_in_days(f.long, 10).select("game_id", "team_id", "games_in_10"), "long", "select game_id, team_id, count(*) over (partition by team_id order by date range between interval 10 days preceding and interval 1 day preceding) as games_in_10 from long")
query("j14_coverage", lambda f: rounded(G.coverage(f.box, f.games), "share"), "box", "select (select count(*) from done) as n_games, (select count(distinct game_id) from box) as n_covered, round((select count(distinct game_id) from box) / (select count(*) from done), 6) as share")

# A: aggregates
query("a1_standings", lambda f: rounded(A.standings(f.games, AS_OF), "win_pct"), "long", f"select team_id, count(*) filter (won) as wins, count(*) filter (not won) as losses, count(*) as games_played, round(avg(cast(won as int)), 6) as win_pct from long where date <= {DAY} group by 1")
query("a2_season_summary", lambda f: rounded(A.season_summary(T.between(f.games, date(1999, 10, 1), date(2000, 9, 30)), AS_OF), "pct_complete"), "games", f"select played, total, total - played as remaining, round(100 * played / total, 6) as pct_complete from (select count(*) filter ((home_score > 0 or away_score > 0) and date <= {DAY}) as played, greatest(count(*), 1230) as total from games where date between date '1999-10-01' and date '2000-09-30')")
query("a3_record_before", lambda f: A.record_before(f.games).select("game_id", "team_id", "wins", "losses"), "long", """
select game_id, team_id, cast(coalesce(sum(cast(margin > 0 as int)) over w, 0) as bigint) as wins, cast(coalesce(sum(cast(margin < 0 as int)) over w, 0) as bigint) as losses from long where season_type = 'regular'
window w as (partition by team_id order by date range between unbounded preceding and interval 1 day preceding)""")
query("a4_latest_per", lambda f: A.latest_per(f.hist.select("team_id", "date", "game_id", "rating_after", F.when(F.col("game_id") % 2 == 0, F.col("team_score")).alias("even_score")), "team_id").select("team_id", "game_id", "rating_after", "even_score"), "hist", "select team_id, arg_max(game_id, (date, game_id)) as game_id, arg_max(rating_after, (date, game_id)) as rating_after, arg_max(team_score, (date, game_id)) filter (game_id % 2 = 0) as even_score from hist group by 1")
query("a5_team_from_players", lambda f: rounded(A.team_from_players(f.box, f.ratings), "team_rating"), "box ratings", "select game_id, b.team_id, round(sum(rating * minutes) / sum(minutes), 6) as team_rating from box b join ratings using (player_id) where minutes > 0 group by 1, 2")

_CUTS = {"overall": "true", "home_pick": "picked_home", "away_pick": "not picked_home", "close": "abs(elo_diff) < 100", "toss_up": "abs(elo_diff) < 50", "large": "abs(elo_diff) >= 100", "enhanced": "enhanced", "home_b2b": "home_b2b", "away_b2b": "away_b2b", "high_confidence": "confidence >= 0.70", "low_confidence": "confidence < 0.60", "recent": f"date >= {DAY} - 7"}
query("a6_performance", lambda f: rounded(A.performance_summary(f.pred, end=AS_OF, as_of=AS_OF), *[f"{k}_accuracy" for k in _CUTS], "home_win_rate", "avg_confidence", "upset_rate"), "pred", "select " + ", ".join(f"count(*) filter ({c}) as {k}_games, case when count(*) filter ({c}) >= {1 if k in ('overall', 'large', 'recent') else 10} then round(avg(cast(correct as int)) filter ({c}), 6) end as {k}_accuracy" for k, c in _CUTS.items()) + f""",
 round(avg(cast(home_score > away_score as int)), 6) as home_win_rate, count(*) filter (picked_home and home_score > away_score) as home_predicted_correct, count(*) filter (not picked_home and home_score <= away_score) as away_predicted_correct,
 round(avg(confidence), 6) as avg_confidence, count(*) filter (not correct) as upsets, round(avg(cast(not correct as int)), 6) as upset_rate from pred where date <= {DAY}""")
query("a7_daily", lambda f: rounded(A.daily_stats(f.pred), "accuracy", "avg_confidence"), "pred", "select date, count(*) as games, count(correct) as completed, count(*) filter (correct) as correct, round(avg(cast(correct as int)), 6) as accuracy, count(*) filter (abs(elo_diff) < 100) as close_games, count(*) filter (enhanced) as enhanced_games, round(avg(confidence), 6) as avg_confidence from pred group by 1")
query("a8_by_confidence", lambda f: rounded(A.by_confidence(f.pred, [0.5, 0.55, 0.6, 0.7, 0.8, 1.0]), "accuracy", "avg_confidence"), "pred", "select case when confidence < 0.55 then 0.5 when confidence < 0.6 then 0.55 when confidence < 0.7 then 0.6 when confidence < 0.8 then 0.7 else 0.8 end::double as bin, count(*) as games, round(avg(cast(correct as int)), 6) as accuracy, round(avg(confidence), 6) as avg_confidence from pred where confidence < 1 group by 1")
query("a8_by_confidence_closed", lambda f: rounded(A.by_confidence(f.pred, [k / 20 for k in range(10, 21)], True), "accuracy", "avg_confidence"), "pred", """
select greatest(0.5, (cast(ceil(round(confidence * 100) / 5) as int) - 1) * 5 / 100)::double as bin, count(*) as games, round(avg(cast(correct as int)), 6) as accuracy, round(avg(confidence), 6) as avg_confidence from pred group by 1""")
query("a9_by_season", lambda f: rounded(A.by_season(f.pred), "accuracy"), "pred", f"select {SEASON} as season, count(*) as games, round(avg(cast(correct as int)), 6) as accuracy from pred group by 1 order by 1 desc limit 5")
query("a10_by_week", lambda f: rounded(A.by_week(f.pred, AS_OF), "accuracy"), "pred", f"select cast(date_trunc('week', date) as date) as week, count(*) as games, round(avg(cast(correct as int)), 6) as accuracy from pred where date between {DAY} - 30 and {DAY} group by 1 order by 1 desc limit 4")
query("a11_recent_vs_all", lambda f: rounded(A.recent_vs_all(f.pred), "recent_accuracy", "accuracy"), "pred", "select count(*) filter (date >= m - 5) as recent_games, round(avg(cast(correct as int)) filter (date >= m - 5), 6) as recent_accuracy, count(*) as games, round(avg(cast(correct as int)), 6) as accuracy from pred, (select max(date) as m from pred)")
query("a15_rating_stats", lambda f: rounded(A.rating_stats(f.ratings), "mean", "std"), "ratings", "select count(rating) as n, round(avg(rating), 6) as mean, quantile_cont(rating, 0.5) as median, round(stddev_samp(rating), 6) as std, min(rating) as low, max(rating) as high from ratings")
query("a16_tiers", lambda f: A.tiers_reached(f.ratings), "ratings", "select unnest(['MVP candidates', 'All-Stars', 'Above Average']) as tier, unnest([count(*) filter (rating >= 1700), count(*) filter (rating >= 1650), count(*) filter (rating >= 1600)]) as n from ratings")
query("a16_experience_tiers", lambda f: rounded(A.tier_counts(f.box.groupBy("player_id").agg(F.count("*").alias("games_played")), A.EXPERIENCE_TIERS, "games_played", "Rookies/Young"), "share"), "box", """
, g as (select player_id, count(*) as n from box group by 1)
select case when n >= 600 then 'Veterans' when n >= 300 then 'Prime' when n >= 100 then 'Developing' else 'Rookies/Young' end as tier, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from g group by 1""")
query("a17_entities", lambda f: A.entity_counts(f.box), "box", "select count(*) as rows, count(distinct game_id) as games, count(distinct player_id) as players, count(distinct team_id) as teams from box")
query("a18_minutes", lambda f: rounded(A.minutes_check(f.box), "mean_minutes"), "box", "select count(*) as team_games, round(avg(m), 6) as mean_minutes, count(*) filter (m < 200) as low, count(*) filter (m > 280) as high, avg(m) between 235 and 245 as plausible from (select sum(minutes) as m from box group by game_id, team_id)")
query("a18_minutes_by_game", lambda f: rounded(A.minutes_check(f.box, by=("game_id",)), "mean_minutes"), "box", "select count(*) as team_games, round(avg(m), 6) as mean_minutes, count(*) filter (m < 200) as low, count(*) filter (m > 280) as high, avg(m) between 235 and 245 as plausible from (select sum(minutes) as m from box group by game_id)")
query("a19_score_model", lambda f: rounded(A.fit_score_model(G.elo_training_set(f.done, f.hist), AS_OF), "slope", "intercept", "train_r2", "train_mae", "holdout_r2", "holdout_mae", digits=5), "hist", f"""
, t as (select h.date, h.rating_before - a.rating_before as x, cast(h.team_score - a.team_score as double) as y from hist h join hist a on a.game_id = h.game_id and h.is_home and not a.is_home),
m as (select regr_slope(y, x) as s, regr_intercept(y, x) as i from t where date < {DAY}),
e as (select y, y - s * x - i as err, date < {DAY} as early from t, m)
select (select round(s, 5) from m) as slope, (select round(i, 5) from m) as intercept,
 round(1 - sum(err * err) filter (early) / (var_pop(y) filter (early) * count(*) filter (early)), 5) as train_r2, round(avg(abs(err)) filter (early), 5) as train_mae, count(*) filter (early) as train_n,
 round(1 - sum(err * err) filter (not early) / (var_pop(y) filter (not early) * count(*) filter (not early)), 5) as holdout_r2, round(avg(abs(err)) filter (not early), 5) as holdout_mae, count(*) filter (not early) as holdout_n from e""")
query("a19_from_moments", lambda f: rounded(U.fit_moments(U.daily_moments(G.elo_training_set(f.done, f.hist).join(f.done.select("game_id", F.col("date").alias("day")), "game_id").withColumn("date", F.col("day")), "elo_diff", "actual_margin"), U.before(AS_OF)), "slope", "intercept", "train_r2", "holdout_r2", digits=5), "hist", f"""
, t as (select h.date, h.rating_before - a.rating_before as x, cast(h.team_score - a.team_score as double) as y from hist h join hist a on a.game_id = h.game_id and h.is_home and not a.is_home),
m as (select regr_slope(y, x) as s, regr_intercept(y, x) as i from t where date < {DAY}), e as (select y, y - s * x - i as err, date < {DAY} as early from t, m)
select (select round(s, 5) from m) as slope, (select round(i, 5) from m) as intercept, round(1 - sum(err * err) filter (early) / (var_pop(y) filter (early) * count(*) filter (early)), 5) as train_r2, count(*) filter (early) as train_n,
 round(1 - sum(err * err) filter (not early) / (var_pop(y) filter (not early) * count(*) filter (not early)), 5) as holdout_r2, count(*) filter (not early) as holdout_n from e""")
query("a20_from_moments", lambda f: rounded(_quarter_moments(f), "slope", "intercept", "train_r2", digits=5), "quarters hist", f"""
, q as (select game_id, is_home, date, unnest([1, 2, 3, 4]) as quarter, unnest([q1, q2, q3, q4]) as points from quarters),
t as (select h.quarter, r.rating_before - s.rating_before as x, cast(h.points - a.points as double) as y from q h join q a on a.game_id = h.game_id and a.quarter = h.quarter and h.is_home and not a.is_home join hist r on r.game_id = h.game_id and r.is_home join hist s on s.game_id = h.game_id and not s.is_home where h.date < {DAY})
select quarter, round(regr_slope(y, x), 5) as slope, round(regr_intercept(y, x), 5) as intercept, round(regr_r2(y, x), 5) as train_r2, count(*) as train_n from t group by 1""")
query("a20_quarter_models", lambda f: rounded(A.fit_quarter_models(f.quarters, f.hist), "slope", "intercept", "r2", "league_average", "mae", digits=5), "quarters hist", """
, q as (select game_id, team_id, is_home, unnest([1, 2, 3, 4]) as quarter, unnest([q1, q2, q3, q4]) as points from quarters),
g as (select quarter, q.game_id, cast(max(points) filter (q.is_home) - max(points) filter (not q.is_home) as double) as y, max(rating_before) filter (q.is_home) - max(rating_before) filter (not q.is_home) as x, avg(points) as mean
 from q join hist using (game_id, team_id) group by 1, 2),
l as (select quarter, regr_slope(y, x) as s, regr_intercept(y, x) as i from g group by 1)
select quarter, round(any_value(s), 5) as slope, round(any_value(i), 5) as intercept, round(regr_r2(y, x), 5) as r2, round(avg(mean), 5) as league_average, count(*) as games, round(avg(abs(y - s * x - i)), 5) as mae from g join l using (quarter) group by 1""")
query("a21_league_average", lambda f: rounded(A.league_average(f.games, AS_OF), "league_average"), "done", f"""
, r as (select date, (home_score + away_score) / 2 as p from done where season_type = 'regular' and home_score > 0)
select round(case when count(*) filter (date >= {DAY}) >= 50 then avg(p) filter (date >= {DAY}) else avg(p) filter (date >= {DAY} - interval 36 months) end, 6) as league_average, count(*) filter (date >= {DAY}) >= 50 as from_holdout from r""")
query("a21_sparse", lambda f: rounded(A.league_average(f.games, date(2005, 1, 1), 10**9).drop("from_holdout"), "league_average").unionByName(rounded(A.league_average(f.games, AS_OF, 10**9).drop("from_holdout"), "league_average")), "done", f"""
, r as (select date, (home_score + away_score) / 2 as p from done where season_type = 'regular' and home_score > 0)
select round(avg(p), 6) as league_average from r where date >= date '2002-01-01' union all select round(avg(p), 6) from r where date >= {DAY} - interval 36 months""")
query("a22_quarter_averages", lambda f: rounded(A.quarter_averages(f.quarters), *[f"{n}_q{k}" for n in ("mean", "std") for k in range(1, 5)], "late_delta"), "quarters", """
, g as (select game_id, avg(q1) as q1, avg(q2) as q2, avg(q3) as q3, avg(q4) as q4 from quarters group by 1)
select """ + ", ".join(f"round(avg(q{k}), 6) as mean_q{k}, round(stddev_samp(q{k}), 6) as std_q{k}" for k in range(1, 5)) + ", round(avg(q4) - avg(q1), 6) as late_delta from g")
query("a22_quarter_distribution", lambda f: rounded(A.quarter_distribution(f.quarters), "mean", "std"), "quarters", """
, q as (select case when is_home then 'home' else 'away' end as side, unnest([1, 2, 3, 4]) as quarter, unnest([q1, q2, q3, q4]) as points from quarters)
select side, quarter, count(*) as n, round(avg(points), 6) as mean, round(stddev_samp(points), 6) as std, min(points) as low, max(points) as high from q group by grouping sets ((side, quarter), (quarter), ())""")
query("a23_odds_consensus", lambda f: rounded(A.odds_consensus(f.odds).drop("probabilities"), "probability", "price"), "odds", "select game_id, is_home, round(avg(case when price < 0 then -price / (100 - price) else 100 / (price + 100) end), 6) as probability, round(avg(price), 6) as price, count(distinct book) as books from odds group by 1, 2")
query("a24_score_errors", lambda f: rounded(A.score_errors(f.pred), "home_mae", "away_mae", "margin_mae"), "pred", "select case when confidence >= 0.7 then 'high' when confidence >= 0.6 then 'medium' else 'low' end as tier, count(*) as games, round(avg(abs(pred_home_score - home_score)), 6) as home_mae, round(avg(abs(pred_away_score - away_score)), 6) as away_mae, round(avg(abs(pred_home_score - pred_away_score - home_score + away_score)), 6) as margin_mae from pred group by 1")
query("a25_accuracy_cuts", lambda f: rounded(A.accuracy_cuts(f.pred), "accuracy"), "pred", """
, p as (select case when abs(elo_diff) < 50 then '0-50' when abs(elo_diff) < 100 then '50-100' when abs(elo_diff) < 150 then '100-150' else '150+' end as bucket, cast(month(date) as int) as month, season_type as segment, correct from pred)
select bucket, month, segment, count(*) as games, round(avg(cast(correct as int)), 6) as accuracy from p group by grouping sets ((bucket), (month), (segment), ())""")
query("a26_pair_counts", lambda f: A.pair_counts(f.games), "games", "select least(home_team_id, away_team_id) as team_a, greatest(home_team_id, away_team_id) as team_b, count(*) as games from games group by 1, 2")
query("a27_injury_load", lambda f: rounded(A.injury_load(f.injuries), "load"), "injuries", "select team_id, count(*) filter (status in ('out', 'doubtful')) as injured, count(*) filter (status = 'returning') as returning, round((count(*) filter (status in ('out', 'doubtful')) + 0.5 * count(*) filter (status = 'returning')) / 13, 6) as load from injuries group by 1")
query("a28_injury_counts", lambda f: A.injury_counts(f.box.where("didNotPlay").select("player_id", "date"), AS_OF), "box", f"select player_id, count(*) as injuries, count(*) >= 3 as prone from box where didNotPlay and date between {DAY} - 365 and {DAY} group by 1")
query("a29_results", lambda f: rounded(A.results_with_predictions(f.games, f.hist, date(2000, 1, 1), AS_OF), "p"), "hist", f"""
, r as (select team_id, arg_max(rating_after, (date, game_id)) as r from hist group by 1),
g as (select game_id, date, home_score, away_score, {EXP.format(a='h.r', b='a.r', ha=30)} as p from done d join r h on h.team_id = d.home_team_id join r a on a.team_id = d.away_team_id where home_score > 0 and away_score > 0 and date between date '2000-01-01' and {DAY})
select game_id, date, round(p, 6) as p, (p > 0.5) = (home_score > away_score) as correct, (p > 0.5) <> (home_score > away_score) and greatest(p, 1 - p) > 0.6 as upset from g""")

# T: rankings
query("t1_top_players", lambda f: A.top_players(f.ratings).select("player_id", "rating"), "ratings", "select player_id, rating from ratings where games_played >= 10 order by rating desc, player_id limit 20")
_ERAS = {"1990s Era": (1990, 1999), **A.ERAS}


def _last_seasons(f):
    seasons = f.box.groupBy("player_id").agg(F.count("*").alias("games_played"), F.max(F.when(F.month("date") >= 10, F.year("date")).otherwise(F.year("date") - 1)).alias("last_season"))
    return f.ratings.drop("games_played").join(seasons, "player_id")


query("t2_top_by_era", lambda f: A.top_by_era(_last_seasons(f), _ERAS, min_games=10).select("era", "player_id", "rank"), "box ratings", f"""
, s as (select player_id, max({SEASON}) as last_season from box group by 1 having count(*) >= 10),
e as (select player_id, rating, case when last_season between 1990 and 1999 then '1990s Era' when last_season between 2000 and 2009 then '2000s Era' end as era from ratings join s using (player_id))
select * from (select era, player_id, row_number() over (partition by era order by rating desc, player_id) as rank from e where era is not null) where rank <= 10""")
query("t3_contributors", lambda f: A.top_contributors(f.box, f.ratings).select("game_id", "team_id", "player_id", "rank"), "box ratings", "select * from (select game_id, b.team_id, player_id, row_number() over (partition by game_id, b.team_id order by rating * minutes desc, player_id) as rank from box b join ratings using (player_id) where minutes > 0) where rank <= 3")
query("t4_scorers", lambda f: A.top_by(f.box.where("not didNotPlay"), ["game_id", "team_id"], 3, "points").select("game_id", "team_id", "player_id", "points", "rank"), "box", "select * from (select game_id, team_id, player_id, points, row_number() over (partition by game_id, team_id order by points desc, player_id) as rank from box where not didNotPlay) where rank <= 3")
query("t4_did_not_play", lambda f: A.did_not_play(f.box).select("game_id", "team_id", F.array_join(F.col("did_not_play").cast("array<string>"), ",").alias("did_not_play")), "box", "select game_id, team_id, string_agg(cast(player_id as varchar), ',' order by player_id) as did_not_play from box where didNotPlay group by 1, 2")
query("t6_closest", lambda f: A.closest_games(f.pred).select("game_id", "home_win_prob"), "pred", "select game_id, home_win_prob from pred order by abs(home_win_prob - 0.5), game_id limit 5")
query("t7_featured", lambda f: A.featured(f.pred).select("game_id", "kind", "rank"), "pred", """
, s as (select game_id, round(abs(home_win_prob - 0.5), 9) as s from pred),
k as (select game_id, s, case when s >= 0.30 then 'blowout' when s <= 0.10 then 'competitive' end as kind from s)
select * from (select game_id, kind, row_number() over (partition by kind order by case when kind = 'blowout' then -s else s end, game_id) as rank from k where kind is not null) where rank <= 3""")
query("t8_upsets", lambda f: rounded(A.upset_candidates(f.pred).select("game_id", "confidence", "favorite", "underdog", "upset_potential"), "upset_potential"), "pred", "select game_id, confidence, case when home_win_prob > 0.5 then home_team_id else away_team_id end as favorite, case when home_win_prob > 0.5 then away_team_id else home_team_id end as underdog, round(100 - confidence * 100, 6) as upset_potential from pred where confidence between 0.5 and 0.65")
query("t9_current_top", lambda f: A.top_by(f.roster.join(G.recent_players(f.box, 60, AS_OF), ["player_id", "team_id"], "left_semi").join(f.ratings.select("player_id", "rating"), "player_id"), ["team_id"], 3).select("team_id", "player_id", "rank"), "box ratings", f"select * from (select r.team_id, r.player_id, row_number() over (partition by r.team_id order by rating desc, r.player_id) as rank from roster r join ratings x using (player_id) where (r.player_id, r.team_id) in (select player_id, team_id from box where date between {DAY} - 60 and {DAY})) where rank <= 3")
query("t10_key_injuries", lambda f: A.key_injuries(f.injuries, f.ratings).select("team_id", "player_id", "status", "rank", "impact"), "injuries ratings", "select * from (select i.team_id, i.player_id, status, row_number() over (partition by i.team_id order by rating desc, i.player_id) as rank, case when rating > 1600 then 'star' when rating > 1400 then 'starter' else 'role' end as impact from injuries i join ratings using (player_id)) where rank <= 3")
query("t11_ranking", lambda f: A.ranking(f.hist, AS_OF), "hist", f"select team_id, rating, row_number() over (order by rating desc, team_id) as rank from (select team_id, arg_max(rating_after, (date, game_id)) as rating from hist where date <= {DAY} group by 1)")
query("t12_slate", lambda f: A.slate(f.pred.where(F.col("date") == F.lit(date(2000, 1, 15)))).select("game_id", "status"), "pred", "select game_id, 2 as status from pred where date = date '2000-01-15'")

_CODED = {"status_code": f"case when date < {DAY} then 3 when date = {DAY} then 2 when game_id % 10 > 0 then 1 end", "tipoff": "case when game_id % 9 > 0 then 12 + game_id % 9 end"}
query("t12_slate_places", lambda f: A.slate_places(f.pred.withColumns({k: F.expr(v) for k, v in _CODED.items()})).select("date", "game_id", "summary_place", "page_place"), "pred", f"""
, c as (select *, {_CODED["status_code"]} as status_code, {_CODED["tipoff"]} as tipoff from pred)
select date, game_id, row_number() over (partition by date order by tipoff nulls first, abs(home_win_prob - 0.5) desc, game_id) as summary_place, row_number() over (partition by date order by coalesce(status_code, 1), tipoff nulls first, game_id) as page_place from c""")

# S: set operations
query("s1_merge_games", lambda f: T.merge_games(f.games.where("game_id % 3 <> 0"), f.games.where("game_id % 2 = 0").withColumn("home_score", F.lit(0).cast("bigint"))).select("game_id", "home_score"), "games", "select game_id, case when game_id % 3 <> 0 then home_score else 0 end as home_score from games where game_id % 3 <> 0 or game_id % 2 = 0")
query("s2_replace_dates", lambda f: T.replace_dates(f.games, f.games.where("day(date) = 5 and game_id % 2 = 0")).groupBy("date").agg(F.count("*").alias("n")), "games", "select date, count(*) as n from games where not (date in (select date from games where day(date) = 5 and game_id % 2 = 0) and game_id % 2 <> 0) group by 1")
query("s3_all_teams", lambda f: G.all_teams(f.games), "games", "select home_team_id as team_id from games union select away_team_id from games")
query("s4_id_diff", lambda f: T.id_diff(f.games.where("game_id % 2 = 0"), f.games.where("game_id % 3 = 0")), "games", "select game_id, case when game_id % 2 = 0 then 'missing' else 'extra' end as side from games where (game_id % 2 = 0) <> (game_id % 3 = 0)")
query("io11_new_since", lambda f: T.new_since(f.games.where(F.col("date") <= F.lit(AS_OF)), f.games).select("game_id", "date"), "games", f"select game_id, date from games where date > (select max(date) from games where date <= {DAY})")

# Q: data quality
query("q1_nulls", lambda f: A.nulls(f.long.select("game_id", F.when(F.col("margin") != 0, F.col("margin")).alias("margin"))), "long", "select unnest(['game_id', 'margin']) as column, unnest([0, count(*) filter (margin = 0)]) as nulls, count(*) as rows from long")
query("q1_check_schema", lambda f: A.check_schema(f.games, ["game_id", "date", "home_team_id", "winner_team_id", "arena"]), "games", "select unnest(['game_id', 'date', 'home_team_id', 'winner_team_id', 'arena']) as column, unnest([true, true, true, false, false]) as present from (select 1 from games limit 1)")
query("q2_duplicates", lambda f: A.duplicates(f.long, "team_id").orderBy("team_id"), "long", "select team_id, count(*) as n from long group by 1 having count(*) > 1")
query("q3_season_counts", lambda f: A.season_counts(f.done), "done", f"select {SEASON} as season, count(*) as games, count(*) - 1230 as difference from done group by 1")
query("q4_status", lambda f: A.status(f.games, date(2001, 8, 3)), "games", """
, s as (select count(*) as games, count(*) filter (home_score > 0 or away_score > 0) as completed, count(*) filter (home_score = 0 and away_score = 0) as scheduled, min(date) as first_date, max(date) as last_date, max(date) filter (home_score > 0 or away_score > 0) as latest_completed,
 min(date) filter (home_score = 0 and away_score = 0) as first_scheduled, max(date) filter (home_score = 0 and away_score = 0) as last_scheduled from games)
select *, date_diff('day', latest_completed, date '2001-08-03') as days_behind, case date_diff('day', latest_completed, date '2001-08-03') when 0 then 'UP TO DATE' when 1 then 'CURRENT' when 2 then 'MOSTLY CURRENT' when 3 then 'MOSTLY CURRENT' else 'OUTDATED' end as state from s""")
query("q5_verdict", lambda f: rounded(A.verdict(f.box, f.games), "share", "mean_minutes"), "box", """
, m as (select avg(m) as m from (select sum(minutes) as m from box group by game_id, team_id)),
x as (select (select count(*) from done) as n_games, (select count(distinct game_id) from box) as n_covered, m from m)
select n_games, n_covered, round(n_covered / n_games, 6) as share, round(m, 6) as mean_minutes, 0::bigint as missing, case when n_covered / n_games >= 0.95 and m between 235 and 245 then 'EXCELLENT' when n_covered / n_games >= 0.9 and m between 230 and 250 then 'GOOD' else 'NEEDS ATTENTION' end as verdict from x""")
query("q6_freshness", lambda f: A.freshness({"games": f.done, "box": f.box}, date(2001, 8, 3)), "box", "select *, age > 3 as stale, case when age > 3 then 'WARNING' else 'OK' end as status from (select 'games' as \"table\", max(date) as last_date, date_diff('day', max(date), date '2001-08-03') as age from done union all select 'box', max(date), date_diff('day', max(date), date '2001-08-03') from box)")
query("q7_extent", lambda f: A.extent(f.done, f.box), "box", "select first_a, last_a, first_b, last_b, first_a = first_b and last_a = last_b as same from (select min(date) as first_a, max(date) as last_a from done), (select min(date) as first_b, max(date) as last_b from box)")
query("q8_plausible", lambda f: rounded(A.plausible(f.games), "plausible_share", "home_share", "away_share"), "games", "select round(avg(cast(home_score > 50 as int)), 6) as home_share, round(avg(cast(away_score > 50 as int)), 6) as away_share, count(*) as games, count(*) filter (home_score is null or away_score is null) as null_scores, round(avg(cast(home_score > 50 and away_score > 50 as int)), 6) as plausible_share from games")
query("f1_names", lambda f: parse.normalized_names(f.names).where("name_key is not null").select("player_name", "name_key"), "names", r"select player_name, trim(regexp_replace(regexp_replace(strip_accents(lower(player_name)), '[^\w\s]', '', 'g'), '\s+', ' ', 'g')) as name_key from names")
query("f16_dates", lambda f: f.games.select("game_id", parse.parse_date(F.date_format("date", "yyyyMMdd")).alias("a"), parse.parse_date(F.date_format("date", "MM/dd/yyyy HH:mm:ss")).alias("b"), parse.parse_date(F.lit("oops")).alias("c"), parse.days_between(F.col("date"), F.lit(AS_OF)).alias("days")), "games", f"select game_id, date as a, date as b, cast(null as date) as c, date_diff('day', date, {DAY}) as days from games")
query("f16_date_range", lambda f: parse.date_range(f.games.groupBy("pool").agg(F.min("date").alias("first"), F.date_add(F.min("date"), 40).alias("last")), "first", "last").groupBy(F.month("date").alias("month")).agg(F.count("*").alias("days")), "games", """
, r as (select unnest(generate_series(first, first + interval 40 days, interval 1 day)) as d from (select pool, min(date) as first from games group by 1))
select cast(month(d) as int) as month, count(*) as days from r group by 1""")
query("f16_holidays", lambda f: f.games.select(F.year("date").alias("year")).distinct().select("year", F.explode(parse.holiday_schedule(F.col("year"))).alias("h")).join(f.games, F.col("date").between(F.col("h.post_period_start"), F.col("h.post_period_end"))).groupBy("year", "h.name", "h.penalty").agg(F.count("*").alias("games_after")), "games", """
, y as (select distinct cast(year(date) as int) as year from games),
h as (select year, name, penalty, make_date(year, m, d) as day from y, (values ('Christmas', 12, 25, 30.0::double), ('Thanksgiving', 11, 23, 10.0), ('All-Star Break', 2, 18, 15.0)) as t(name, m, d, penalty))
select year, name, penalty, count(*) as games_after from h join games on date between day + 1 and day + 3 group by 1, 2, 3""")
query("f22_matchups", lambda f: f.done.withColumn("m", F.when(F.col("game_id") % 2 == 0, F.concat(F.lit("H"), "home_team_id", F.lit(" vs. A"), "away_team_id")).otherwise(F.concat(F.lit("A"), "away_team_id", F.lit("  @ H"), "home_team_id"))).select("game_id", parse.matchup_teams(F.col("m"))[0].alias("home"), parse.matchup_teams(F.col("m"))[1].alias("away")), "done", "select game_id, 'H' || home_team_id as home, 'A' || away_team_id as away from done")
query("f22_keys", lambda f: f.done.select("game_id", parse.feed_id(F.col("game_id")).alias("feed_id"), parse.game_key(F.col("date"), F.col("home_team_id"), F.col("away_team_id")).alias("key")), "done", "select game_id, lpad(cast(game_id as varchar), 10, '0') as feed_id, strftime(date, '%Y%m%d') || '_' || home_team_id || '_' || away_team_id as key from done")
