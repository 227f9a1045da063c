"""Queries over per-team and per-pair windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ratingmill.operators import aggregates as A
from ratingmill.operators import windows as W
from ratingmill.plans.base import AS_OF, DAY, SEASON, part, query, rounded

_W5 = "(partition by team_id order by date, game_id rows between 5 preceding and 1 preceding)"
_EARLIER = "partition by team_id order by date range between unbounded preceding and interval 1 day preceding"
_DIST = "case when {a}.latitude is not null and {b}.latitude is not null then 2 * {r} * asin(sqrt(least(1.0, pow(sin((radians({b}.latitude) - radians({a}.latitude)) / 2), 2) + cos(radians({a}.latitude)) * cos(radians({b}.latitude)) * pow(sin(radians({b}.longitude - {a}.longitude) / 2), 2)))) end"

query("w1_form", lambda f: rounded(W.form(f.long).select("game_id", "team_id", "form_games", "form_wins", "form", "streak_type"), "form"), "long", f"""
, x as (select game_id, team_id, count(*) over w as n, coalesce(sum(cast(won as int)) over w, 0) as wins, coalesce(avg(margin) over w, 0) as m, max(margin) over w as top, min(margin) over w as low from long window w as {_W5}),
y as (select *, n >= 3 and (low > 0 or top < 0) as run from x)
select game_id, team_id, n as form_games, cast(wins as bigint) as form_wins, round(m * 0.1 * 50 * case when run then 1.2 else 1 end, 6) as form, case when n = 0 then 'none' when n < 3 then 'insufficient_data' when not run then 'mixed' when top < 0 then 'losing' else 'winning' end as streak_type from y""")
_LAST_N = """
, r as (select *, row_number() over (partition by team_id order by date, game_id) as rn from long),
e as (select team_id, date, min(rn) as first from r group by 1, 2),
x as (select g.game_id, g.team_id, p.won, p.margin, p.date >= g.date - 10 as late, p.game_id as pg, p.opponent_id as po, e.first - p.rn as age from r g join e using (team_id, date) left join r p on p.team_id = g.team_id and p.rn between e.first - {n} and e.first - 1)"""
query("w2_momentum", lambda f: W.momentum(f.long).select("game_id", "team_id", "wins", "games", "late_wins", "late_games", "momentum"), "long", _LAST_N.format(n=5) + """
, c as (select game_id, team_id, count(*) filter (margin > 0) as wins, count(pg) as games, count(*) filter (margin > 0 and late) as late_wins, count(*) filter (late) as late_games from x group by 1, 2)
select *, case when games = 0 then 0 when wins >= 4 then least((wins - 3) * 15.0, 30) when wins <= 1 then greatest((wins - 2) * 15.0, -30) else 0 end::double as momentum from c""")
query("w3_momentum_tiers", lambda f: W.momentum_tiers(f.long).select("game_id", "team_id", "tier_points"), "long", f"""
, x as (select game_id, team_id, count(*) over w as n, coalesce(sum(cast(won as int)) over w, 0) as wins, avg(margin) over w as m from long window w as {_W5})
select game_id, team_id, case when n = 0 then 0 when wins >= 4 then case when m > 10 then 35 when m > 5 then 25 else 15 end when wins <= 1 then case when m < -10 then -35 when m < -5 then -25 else -15 end when wins = 3 and m > 5 then 10 when wins = 2 and m < -5 then -10 else 0 end as tier_points from x""")
query("w4_welo", lambda f: rounded(W.welo(f.long, f.hist).select("game_id", "team_id", "welo", "welo_record"), "welo"), "long hist", _LAST_N.format(n=4) + """
, s as (select x.game_id, x.team_id, x.won, pow(0.5, age - 1) * coalesce(h.rating_before, 1500) / 1500 as wt, pg from x left join hist h on h.game_id = x.pg and h.team_id = x.po)
select game_id, team_id, coalesce(round(30 * sum(case when won then wt else -wt end) filter (pg is not null) / sum(wt) filter (pg is not null), 6), 0) as welo, count(*) filter (won) || '-' || count(*) filter (not won) as welo_record from s group by 1, 2""")
query("w5_rest", lambda f: W.rest(f.long).select("game_id", "team_id", "rest_days", "rest_category", "rest_penalty"), "long", """
, x as (select game_id, team_id, coalesce(greatest(0, date_diff('day', lag(date) over (partition by team_id order by date, game_id), date) - 1), -1) as d, lag(date) over (partition by team_id order by date, game_id) is null as f from long)
select game_id, team_id, case when f then -1 else d end as rest_days, case when f then 'first_game' when d = 0 then 'back_to_back' when d = 1 then 'one_day_rest' when d <= 3 then 'normal_rest' else 'extended_rest' end as rest_category, case when f then 0 when d = 0 then -46 when d = 1 then -15 else 0 end::double as rest_penalty from x""")
query("w6_back_to_back", lambda f: W.back_to_back(f.long).select("game_id", "team_id"), "long", "select game_id, team_id from (select *, lag(date) over (partition by team_id order by date, game_id) as p from long) where date_diff('day', p, date) <= 1")
query("w7_rest_fatigue", lambda f: W.rest_fatigue(f.long).select("game_id", "team_id", "fatigue_rest", "in_4", "in_5", "b2b_penalty", "density_penalty"), "long", f"""
, x as (select game_id, team_id, date, max(date) over ({_EARLIER}) as p,
 count(*) over (partition by team_id order by date range between interval 1 day preceding and interval 1 day preceding) as in_1,
 count(*) over (partition by team_id order by date range between interval 4 days preceding and interval 1 day preceding) as in_4,
 count(*) over (partition by team_id order by date range between interval 5 days preceding and interval 1 day preceding) as in_5 from long)
select game_id, team_id, case when p is null then 7 else greatest(0, date_diff('day', p, date) - 1) end as fatigue_rest, in_4, in_5, case when in_1 > 0 then -50 else 0 end::double as b2b_penalty,
 case when in_4 >= 3 then -30 when in_5 >= 4 then -40 when in_5 >= 3 then -20 else 0 end::double as density_penalty from x""")
_MEET = """
, g as (select *, least(home_team_id, away_team_id) as a, greatest(home_team_id, away_team_id) as b, home_score - away_score as m from done),
n as (select *, row_number() over (partition by a, b order by date, game_id) as rn from g),
x as (select n.game_id, p.game_id as pg, case when p.home_team_id = n.home_team_id then p.m else -p.m end as m,
  case when p.home_team_id = n.home_team_id then p.home_score > p.away_score else p.home_score <= p.away_score end as won, date_diff('day', p.date, n.date) as age
  from n left join n p on p.a = n.a and p.b = n.b and p.rn between n.rn - 5 and n.rn - 1)"""
query("w8_h2h", lambda f: rounded(W.h2h(f.done).select("game_id", "h2h_games", "h2h_wins", "h2h_adjustment", "h2h_class", "h2h_confidence"), "h2h_adjustment"), "done", _MEET + """
, c as (select game_id, count(pg) as n, count(*) filter (won) as w from x group by 1)
select game_id, n as h2h_games, w as h2h_wins, case when n >= 3 then round(greatest(-50, least(50, (w / n - 0.5) * 100 * least(n / 5, 1))), 6) else 0 end as h2h_adjustment,
 case when n < 3 then 'insufficient_data' when n >= 5 and (w / n >= 0.8 or w / n <= 0.2) then 'strong_dominance' when w / n >= 0.7 or w / n <= 0.3 then 'moderate_dominance' else 'balanced' end as h2h_class,
 case when n = 0 then 'none' when n < 3 then 'low' when n < 5 then 'medium' else 'high' end as h2h_confidence from c""")
query("w9_h2h_recency", lambda f: rounded(W.h2h_recency(f.done).select("game_id", "h2h_recency", "recent_blowout"), "h2h_recency"), "done", _MEET + """
, v as (select *, case when age < 30 then 1.0 when age < 90 then 0.75 when age < 180 then 0.5 when age < 365 then 0.25 else 0.1 end::double as wt from x)
select game_id, case when count(pg) = 0 then 0 else round(greatest(-15, least(15, sum(m * wt) / (sum(wt) filter (pg is not null)))), 6) end as h2h_recency, count(*) filter (age < 60 and abs(m) >= 15) > 0 as recent_blowout from v group by 1""")
query("w10_h2h_margin", lambda f: rounded(W.h2h_margin(f.done).select("game_id", "h2h_margin"), "h2h_margin"), "done", _MEET + """
select game_id, case when count(pg) >= 3 then round(greatest(-50, least(50, (count(*) filter (won) / count(pg) - 0.5) * 100 + avg(m) / 10 * 12.5)), 6) else 0 end as h2h_margin from x group by 1""")
query("w11_h2h_games", lambda f: W.h2h_games(f.done).select("team_a", "team_b", "nth", "game_id", "margin_a"), "done", """
select * from (select least(home_team_id, away_team_id) as team_a, greatest(home_team_id, away_team_id) as team_b, row_number() over (partition by least(home_team_id, away_team_id), greatest(home_team_id, away_team_id) order by date desc, game_id desc) as nth, game_id,
 case when home_team_id < away_team_id then home_score - away_score else away_score - home_score end as margin_a from done) where nth <= 5""")
query("w12_recent_form", lambda f: rounded(W.recent_form(f.long), "avg_points", "avg_allowed", "avg_margin", "win_pct"), "long", """
, x as (select *, row_number() over (partition by team_id order by date desc, game_id desc) as nth from long), l as (select * from x where nth <= 10),
s as (select team_id, string_agg(case when won then 'W' else 'L' end, '' order by nth) as results, count(*) as games, count(*) filter (won) as wins, round(avg(team_score), 6) as avg_points, round(avg(opponent_score), 6) as avg_allowed, round(avg(margin), 6) as avg_margin from l group by 1)
select *, left(results, 1) as streak_type, length(results) - length(ltrim(results, left(results, 1))) as streak_length, round(wins / games, 6) as win_pct from s""")
query("w12_compare_form", lambda f: W.compare_form(f.games.where("home_score = 0 and away_score = 0"), W.recent_form(f.long)), "long", part("form", "w12_recent_form") + """
, g as (select g.*, h.win_pct as hw, a.win_pct as aw, h.streak_type as hs, a.streak_type as as_, h.avg_points > a.avg_points as more, h.avg_allowed < a.avg_allowed as less
  from games g join form h on h.team_id = home_team_id join form a on a.team_id = away_team_id where home_score = 0 and away_score = 0)
select game_id, case when hw > aw + 0.05::double then home_team_id when aw > hw + 0.05::double then away_team_id end as form_advantage,
 case when hw > aw + 0.15::double or aw > hw + 0.15::double then 'significantly better' when hw > aw + 0.05::double or aw > hw + 0.05::double then 'slightly better' else 'similar' end as form_text,
 case when hs = 'W' then 'up' else 'down' end as home_momentum, case when as_ = 'W' then 'up' else 'down' end as away_momentum, case when more then home_team_id else away_team_id end as scoring_advantage, case when less then home_team_id else away_team_id end as defense_advantage from g""")
query("w13_pick_streak", lambda f: W.pick_streak(f.pred), "pred", """
, x as (select *, row_number() over (order by date desc, game_id desc) as n from pred), l as (select correct from x where n = 1)
select l.correct, count(*) as streak from x, l where n < coalesce((select min(n) from x, l where x.correct <> l.correct), 1e18) group by 1""")
query("w14_travel", lambda f: rounded(W.travel(f.long, f.arenas).select("game_id", "team_id", "travel_km", "long_travel"), "travel_km", digits=3), "long arenas", f"""
, x as (select *, lag(opponent_id) over (partition by team_id order by date, game_id) as p from long), y as (select x.game_id, x.team_id, coalesce({_DIST.format(r='6371', a='a', b='b')}, 0) as km from x left join arenas a on a.team_id = p left join arenas b on b.team_id = x.team_id)
select game_id, team_id, round(km, 3) as travel_km, km > 1500 as long_travel from y""")
query("w14_travel_itinerary", lambda f: rounded(W.travel(f.long, f.arenas, mode="itinerary").select("game_id", "team_id", "travel_km"), "travel_km", digits=3), "long arenas", f"""
, v as (select *, case when is_home then team_id else opponent_id end as venue from long), x as (select *, lag(venue) over (partition by team_id order by date, game_id) as p from v)
select x.game_id, x.team_id, round(coalesce({_DIST.format(r='6371', a='a', b='b')}, 0), 3) as travel_km from x left join arenas a on a.team_id = p left join arenas b on b.team_id = venue""")
query("w15_travel_fatigue", lambda f: rounded(W.travel_fatigue(f.long, f.arenas), "travel_miles", "travel_fatigue", digits=3), "long arenas", f"""
, w as (select team_id, game_id, date, opponent_id from long where not is_home),
p as (select g.team_id, g.game_id, w.date, w.game_id as wg, w.opponent_id as o, lag(w.opponent_id) over (partition by g.team_id, g.game_id order by w.date, w.game_id) as before from long g join w on w.team_id = g.team_id and w.date between g.date - 7 and g.date - 1),
d as (select p.team_id, p.game_id, sum({_DIST.format(r='3956', a='a', b='b')}) as miles from p join arenas a on a.team_id = coalesce(before, p.team_id) join arenas b on b.team_id = o group by 1, 2),
t as (select l.team_id, l.game_id, coalesce(miles, 0) as m from long l left join d using (team_id, game_id))
select team_id, game_id, round(m, 3) as travel_miles, round(case when m < 1000 then 0 when m < 3000 then -15 * (m - 1000) / 2000 else -30 end, 3) as travel_fatigue from t""")
query("w16_road_streak", lambda f: W.road_streak(f.long).select("game_id", "team_id", "venue_streak"), "long", """
, x as (select *, row_number() over (partition by team_id order by date, game_id) - row_number() over (partition by team_id, is_home order by date, game_id) as island from long)
select game_id, team_id, row_number() over (partition by team_id, is_home, island order by date, game_id) as venue_streak from x""")
query("w17_elo_change_games", lambda f: W.elo_change_games(f.hist), "hist", """
, x as (select *, row_number() over (partition by team_id order by date desc, game_id desc) as n from hist)
select team_id, max(rating_after) filter (n = 1) - coalesce(max(rating_after) filter (n = 6), arg_max(rating_before, n)) as change, count(*) filter (n <= 5 and won) as wins, count(*) filter (n <= 5 and not won) as losses from x where n <= 6 group by 1 having count(*) >= 5""")
query("w18_elo_change_days", lambda f: W.elo_change_days(f.hist, AS_OF), "hist", f"""
, n as (select team_id, arg_max(rating_after, (date, game_id)) as now from hist where date <= {DAY} group by 1), t as (select team_id, arg_max(rating_after, (date, game_id)) as "then" from hist where date <= {DAY} - 7 group by 1)
select team_id, now, "then", now - "then" as change from n join t using (team_id)""")
query("w19_recent_rating", lambda f: rounded(W.recent_rating(f.hist, 10), "recent_rating"), "hist", "select team_id, round(avg(rating_after), 6) as recent_rating from (select *, row_number() over (partition by team_id order by date desc, game_id desc) as n from hist) where n <= 10 group by 1")
query("w20_games_before", lambda f: W.games_before(f.long).select("game_id", "team_id", "games_before"), "long", f"select game_id, team_id, row_number() over (partition by team_id, {SEASON} order by date, game_id) - 1 as games_before from long")
query("w22_recovery", lambda f: rounded(W.recovery(f.box.where("didNotPlay").groupBy("player_id").agg(F.min("date").alias("return_date")).join(f.ratings.select("player_id", "rating"), "player_id"), f.box.where("not didNotPlay").select("player_id", "date", "game_id")).select("player_id", "game_id", "since", "recovery", "boost"), "boost"), "box ratings", """
, r as (select player_id, min(date) as d from box where didNotPlay group by 1),
x as (select b.player_id, b.game_id, rating, row_number() over (partition by b.player_id order by b.date, b.game_id) as since from box b join r using (player_id) join ratings using (player_id) where not didNotPlay and b.date >= d)
select player_id, game_id, since, case since when 1 then 0.75 when 2 then 0.85 when 3 then 0.95 else 1 end::double as recovery, round((rating - 1500) / 10 * case since when 1 then 0.75 when 2 then 0.85 when 3 then 0.95 else 1 end, 6) as boost from x""")
query("w_team_game_features", lambda f: rounded(W.team_game_features(f.long).select("game_id", "team_id", "form", "tier_points", "rest_days", "density_penalty", "games_before"), "form"), "long", part("f", "w1_form") + part("m", "w3_momentum_tiers") + part("r", "w5_rest") + part("d", "w7_rest_fatigue") + ", n as (select game_id, team_id, row_number() over (partition by team_id order by date, game_id) - 1 as games_before from long) select game_id, team_id, round(form, 6) as form, tier_points, rest_days, density_penalty, games_before from f join m using (game_id, team_id) join r using (game_id, team_id) join d using (game_id, team_id) join n using (game_id, team_id)")
query("a12_rest_impact", lambda f: rounded(A.rest_impact(W.rest(f.long)), "home_win_rate"), "long", """
, x as (select game_id, is_home, won, coalesce(greatest(0, date_diff('day', p, date) - 1), -1) as d, p from (select *, lag(date) over (partition by team_id order by date, game_id) as p from long)),
y as (select game_id, is_home, won, case when p is null then -1 else d end as d from x),
g as (select h.won, h.d as h, a.d as a from y h join y a on a.game_id = h.game_id and h.is_home and not a.is_home)
select situation, count(*) as games, round(avg(cast(won as int)), 6) as home_win_rate from (select 'home_b2b' as situation, won from g where h = 0 and a >= 0 union all select 'away_b2b', won from g where a = 0 and h >= 0 union all select 'both_rested', won from g where h >= 2 and a >= 2) group by 1""")
_TRAVELLED = f"""
, x as (select *, lag(opponent_id) over (partition by team_id order by date, game_id) as p from long), e as (select game_id, team_id, rating_change, 1 / (1 + pow(10.0, (sum(rating_before) over (partition by game_id) - 2 * rating_before - case when is_home then 20 else -20 end) / 400)) as expected from hist), t as (select x.won, h.rating_change, h.expected, coalesce({_DIST.format(r='6371', a='a', b='b')}, 0) as km from x join e h using (game_id, team_id) left join arenas a on a.team_id = p left join arenas b on b.team_id = x.team_id)"""


def _travelled(f):
    """Team rows with their trips, changes of the rating, and expected scores from both sides' ratings before the game."""
    both = F.sum("rating_before").over(Window.partitionBy("game_id"))
    ahead = 2 * F.col("rating_before") - both + F.when(F.col("is_home"), 20).otherwise(-20)
    rated = f.hist.select("game_id", "team_id", "rating_change", (1 / (1 + F.pow(F.lit(10.0), -ahead / 400))).alias("expected_score"))
    return W.travel(f.long, f.arenas).join(rated, ["game_id", "team_id"])


query("a13_travel_bins", lambda f: rounded(A.travel_bins(_travelled(f)), "win_rate", "avg_change", "avg_expected"), "long hist arenas", _TRAVELLED + """
select case when km <= 500 then '0-500' when km <= 1000 then '500-1000' when km <= 1500 then '1000-1500' when km <= 2000 then '1500-2000' else '2000-5000' end as bin, count(*) as games, round(avg(cast(won as int)), 6) as win_rate, round(avg(rating_change), 6) as avg_change, round(avg(expected), 6) as avg_expected from t where km > 0 and km <= 5000 group by 1""")
query("a13_travel_impact", lambda f: rounded(A.travel_impact(_travelled(f)), "long_win_rate", "normal_win_rate", "avg_km", "correlation", "impact"), "long hist arenas", _TRAVELLED + """
, r as (select avg(cast(won as int)) filter (km > 1500) as a, avg(cast(won as int)) filter (km <= 1500) as b, count(*) filter (km > 1500) as long_games, avg(km) as k, corr(km, rating_change) as c from t)
select round(a, 6) as long_win_rate, round(b, 6) as normal_win_rate, long_games, round(k, 6) as avg_km, round(c, 6) as correlation, round(a - b, 6) as impact from r""")
query("a14_travel_corr", lambda f: rounded(A.travel_corr(_travelled(f)), "correlation"), "long hist arenas", _TRAVELLED + " select round(corr(km, rating_change), 6) as correlation, count(*) as games from t")
query("t5_hot_cold", lambda f: A.hot_cold(W.elo_change_games(f.hist).select("team_id", "change")), "hist", """
, x as (select *, row_number() over (partition by team_id order by date desc, game_id desc) as n from hist),
c as (select team_id, max(rating_after) filter (n = 1) - coalesce(max(rating_after) filter (n = 6), arg_max(rating_before, n)) as change from x where n <= 6 group by 1 having count(*) >= 5)
select * from (select team_id, change, 'hot' as kind from c order by change desc, team_id limit 5) union all select * from (select team_id, change, 'cold' from c order by change, team_id limit 5)""")
