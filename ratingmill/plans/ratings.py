"""Queries over ratings, rosters, predictions and projections."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ratingmill.functions import scores as S
from ratingmill.operators import games as G
from ratingmill.operators import predict as P
from ratingmill.operators import ratings as R
from ratingmill.operators import windows as W
from ratingmill.operators.aggregates import BPM_TIERS, tier_counts
from ratingmill.plans import games as _games  # noqa: F401  its SQL is used below
from ratingmill.plans import windows as _windows  # noqa: F401
from ratingmill.operators.rosters import roster_figures
from ratingmill.plans.base import AS_OF, BODIES, DAY, EXP, SEASON, part, query, rounded

_INJURED = "(select player_name from injuries where status in ('out', 'doubtful'))"


def _out(f):
    return f.injuries.where("status in ('out', 'doubtful')")


def _team_hist(f):
    return R.team_elo(f.games)


query("r1_team_elo", lambda f: rounded(_team_hist(f).select("game_id", "team_id", "rating_before", "rating_after"), "rating_before", "rating_after", digits=4), "done", f"""
, s as (select row_number() over (partition by pool order by date, game_id) as n, pool, game_id, home_team_id as h, away_team_id as a, home_score as hs, away_score as s, {SEASON} as season from done),
l as (select *, lag(season) over (partition by pool order by n) as before from s),
i as (select *, before is not null and before <> season as turn from l),
z as materialized (select * from i),
w as (
  with recursive r as (
    select 0::bigint as n, pool, list_value({', '.join(['1500.0::double'] * 12)}) as v, list_value({', '.join(['0'] * 12)}) as g, 0::bigint as game_id, 0::bigint as h, 0::bigint as a, 0.0::double as hb, 0.0::double as ab, 0.0::double as c from (select distinct pool from z)
    union all
    select n, pool, list_transform(v1, lambda x, k: case when k = h % 100 + 1 then x + c when k = a % 100 + 1 then x - c else x end), list_transform(g, lambda x, k: case when k = h % 100 + 1 or k = a % 100 + 1 then x + 1 else x end), game_id, h, a, hb, ab, c
    from (
      select *, 20 * least(1.2, greatest(1, 1.2 - 0.2 * p / 82)) * least(1.15, greatest(0.9, 1 + 0.1 * ((hb + ab) / 2 - 1500) / 500)) * ln(abs(hs - s) + 1) / ln(15.0) * (case when hs > s then 1 else 0 end - {EXP.format(a='hb', b='ab', ha=20)}) as c
      from (select *, v1[h % 100 + 1] as hb, v1[a % 100 + 1] as ab, (g[h % 100 + 1] + g[a % 100 + 1]) / 2 as p
        from (select z.n, z.pool, z.game_id, z.h, z.a, z.hs, z.s, r.g, case when z.turn then list_transform(r.v, lambda x: 0.75 * x + 375) else r.v end as v1 from r join z on z.pool = r.pool and z.n = r.n + 1))))
  select * from r where n > 0)
select game_id, h as team_id, round(hb, 4) as rating_before, round(hb + c, 4) as rating_after from w union all select game_id, a, round(ab, 4), round(ab - c, 4) from w""")


def _increment(f):
    early = f.games.where(F.col("date") <= F.lit(AS_OF))
    hist = R.team_elo(early)
    seasons = early.where("home_score > 0 or away_score > 0").select("pool", F.when(F.month("date") >= 10, F.year("date")).otherwise(F.year("date") - 1).alias("season"))
    return rounded(R.team_elo_increment(R.state_of(hist), f.games.where(F.col("date") > F.lit(AS_OF)), seasons=seasons).select("game_id", "team_id", "rating_after"), "rating_after", digits=4)


query("r2_team_elo_increment", _increment, "done", part("x", "r1_team_elo") + f" select x.game_id, team_id, round(rating_after, 4) as rating_after from x join done d on d.game_id = x.game_id and d.date > {DAY}")
_R3 = """
, y as (select yr, dense_rank() over (order by yr) - 1 as c from (select distinct year(date) as yr from box)),
d as (select b.*, c, yr, 20 * least(1, minutes / 48) * ((greatest(-30, least(30, plus_minus / minutes * 48)) + 30) / 60 - 0.5) as delta from box b join y on yr = year(b.date) where minutes > 0 and not didNotPlay),
p as (select *, 1500 + pow(0.67, c) * sum(delta * pow(0.67, -c)) over (partition by player_id order by date, game_id rows unbounded preceding) as after from d)"""
query("r3_player_elo", lambda f: rounded(R.player_elo(f.box).select("game_id", "player_id", "rating_before", "rating_after"), "rating_before", "rating_after", nudge=1e-8), "box", _R3 + " select game_id, player_id, round(after - delta + 1e-8, 6) as rating_before, round(after + 1e-8, 6) as rating_after from p")
query("r3_top_players", lambda f: rounded(R.player_ratings(R.player_elo(f.box)).orderBy(F.desc("rating"), "player_id").limit(20).select("player_id", "rating", "games_played"), "rating", digits=5), "box", _R3 + """
, l as (select player_id, arg_max(after, (date, game_id)) as r, arg_max(c, (date, game_id)) as c, count(*) as games_played from p group by 1)
select player_id, round(1500 + (r - 1500) * pow(0.67, (select max(c) from p) - c), 5) as rating, games_played from l order by 1500 + (r - 1500) * pow(0.67, (select max(c) from p) - c) desc, player_id limit 20""")
query("r4_player_ratings", lambda f: rounded(R.player_ratings(R.player_elo(f.box), f.roster.where("position = 'C'").select("player_id", F.lit(1.08).alias("position_multiplier"))).select("player_id", "raw_rating", "rating", "last_season"), "raw_rating", "rating", digits=5), "box roster", _R3 + """
, l as (select player_id, arg_max(after, (date, game_id)) as r, arg_max(c, (date, game_id)) as c, arg_max(yr, (date, game_id)) as last_season from p group by 1), x as (select player_id, 1500 + (r - 1500) * pow(0.67, (select max(c) from p) - c) as raw, last_season from l)
select player_id, round(raw, 5) as raw_rating, round(raw * case when player_id in (select player_id from roster where position = 'C') then 1.08 else 1 end, 5) as rating, last_season from x""")
query("r4_ratings_by_name", lambda f: rounded(R.player_ratings(R.player_elo(f.box), R.name_multipliers(f.roster, f.roster.where("position <> 'F'").select(F.upper("player_name").alias("player_name"), F.when(F.col("position") == "C", R.RIM_PROTECTOR_MULTIPLIER).otherwise(R.SHOT_CREATOR_MULTIPLIER).alias("position_multiplier")))).select("player_id", "rating", "position_multiplier", "games_played"), "rating", digits=5), "box roster", _R3 + """
, l as (select player_id, arg_max(after, (date, game_id)) as r, arg_max(c, (date, game_id)) as c, count(*) as games_played from p group by 1), m as (select player_id, max(case position when 'C' then 0.9 when 'G' then 1.08 else 1 end)::double as m from roster group by 1)
select player_id, round((1500 + (r - 1500) * pow(0.67, (select max(c) from p) - c)) * m, 5) as rating, m as position_multiplier, games_played from l join m using (player_id)""")
query("p9_player_history", lambda f: rounded(G.player_history(R.player_elo(f.box), 1001), "rating_after", nudge=1e-8), "box", _R3 + " select game_id, date, round(after + 1e-8, 6) as rating_after, minutes, plus_minus from p where player_id = 1001")
query("w18_player_change_days", lambda f: rounded(W.elo_change_days(R.player_elo(f.box), AS_OF, 30, "player_id"), "now", "then", "change", nudge=1e-8), "box", _R3 + f"""
, n as (select player_id, arg_max(after, (date, game_id)) as n from p where date <= {DAY} group by 1), t as (select player_id, arg_max(after, (date, game_id)) as t from p where date <= {DAY} - 30 group by 1)
select player_id, round(n + 1e-8, 6) as now, round(t + 1e-8, 6) as "then", round(n - t + 1e-8, 6) as change from n join t using (player_id)""")
query("f21_bpm", lambda f: rounded(S.bpm(f.box).select("game_id", "player_id", "bpm", "obpm", "dbpm"), "bpm", "obpm", "dbpm", digits=5, nudge=1e-8), "box", """
, o as (select *, (points / minutes * 36 - 15) * 0.12 + (case when fg_attempted + 0.44 * ft_attempted > 0 then points / (2 * (fg_attempted + 0.44 * ft_attempted)) else 0.55 end - 0.55) * 15 + (assists / minutes * 36 - 3) * 0.6 + (rebounds / minutes * 36 - 7) * 0.3 - (turnovers / minutes * 36 - 2) * 0.8 as o from box),
d as (select *, (steals / minutes * 36 - 1.2) * 1.2 + (blocks / minutes * 36 - 0.8) + (defensive_rebounds / minutes * 36 - 5) * 0.2 + (plus_minus / minutes * 36 - o) * 0.3 as d from o)
select game_id, player_id, round(greatest(-12, least(15, o + d)) + 1e-8, 5) as bpm, round(greatest(-10, least(12, o)) + 1e-8, 5) as obpm, round(greatest(-8, least(8, d)) + 1e-8, 5) as dbpm from d""")
query("r3_by_bpm", lambda f: rounded(R.player_elo(S.bpm(f.box), metric="bpm").groupBy("player_id").agg(F.sum("rating_change").alias("total"), F.count("*").alias("games")), "total", digits=4, nudge=1e-7), "box", part("m", "f21_bpm").replace("1e-8", "0") + "select player_id, round(sum(20 * least(1, minutes / 48) * ((greatest(-10, least(10, m.bpm)) + 10) / 20 - 0.5)) + 1e-7, 4) as total, count(*) as games from box join m using (game_id, player_id) where minutes > 0 and not didNotPlay group by 1")
query("a16_bpm_tiers", lambda f: rounded(tier_counts(S.bpm(f.box).where("minutes >= 10"), BPM_TIERS, "bpm", "Poor", nudge=1e-8), "share"), "box", part("b", "f21_bpm").rstrip() + """, t as (select b.bpm from b join box using (game_id, player_id) where minutes >= 10)
select case when bpm >= 8 then 'Elite' when bpm >= 5 then 'Excellent' when bpm >= 2 then 'Good' when bpm >= -2 then 'Average' when bpm >= -5 then 'Below' else 'Poor' end as tier, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from t group by 1""")
_RANKED = ", k as (select r.*, x.rating, row_number() over (partition by r.team_id order by x.rating desc, r.player_id) as rk from roster r join ratings x using (player_id))"
_ROSTER_ELO = "select team_id, sum(rating * (1 - 0.05 * (rk - 1))) / sum(1 - 0.05 * (rk - 1)) as e from (select team_id, rating, row_number() over (partition by team_id order by rating desc, player_id) as rk from k {w}) where rk <= 10 group by 1"
query("r5_roster_elo", lambda f: rounded(R.roster_elo(f.roster, f.ratings, _out(f)), "roster_elo"), "ratings injuries", _RANKED + f", e as ({_ROSTER_ELO.format(w=f'where player_name not in {_INJURED}')}) select t.team_id, round(coalesce(e, 1500), 6) as roster_elo from (select distinct team_id from roster) t left join e using (team_id)")
query("r6_hybrid_rating", lambda f: rounded(R.hybrid_rating(f.hist.groupBy("team_id").agg(F.max_by("rating_after", F.struct("date", "game_id")).alias("rating")), R.roster_elo(f.roster, f.ratings)).select("team_id", "hybrid"), "hybrid"), "hist ratings", _RANKED + f", e as ({_ROSTER_ELO.format(w='')}) select t.team_id, round(0.75 * r + 0.25 * coalesce(e, 1500), 6) as hybrid from (select team_id, arg_max(rating_after, (date, game_id)) as r from hist group by 1) t left join e using (team_id)")
_INJ = _RANKED + f""", m as (select team_id, avg(rating) as m from k where rk <= 10 group by 1),
j as (select k.team_id, rk, greatest(-80, -(rating - m) / 10 * case when rk <= 3 then 1.5 when rk <= 7 then 1 when rk <= 10 then 0.5 else 0.25 end) as v from k join m using (team_id) where player_name in {_INJURED}),
s as (select team_id, greatest(-150, sum(v)) as adj, count(*) filter (rk <= 3) as a, count(*) filter (rk between 4 and 7) as b, count(*) filter (rk between 8 and 10) as c, count(*) filter (rk > 10) as d from j group by 1)"""
query("r7_injury_adjustment", lambda f: rounded(R.injury_adjustment(f.roster, f.ratings, _out(f)), "injury_adjustment"), "ratings injuries", _INJ + " select t.team_id, round(coalesce(adj, 0), 6) as injury_adjustment, coalesce(a, 0) as stars_out, coalesce(b, 0) as starters_out, coalesce(c, 0) as rotation_out, coalesce(d, 0) as bench_out from (select distinct team_id from roster) t left join s using (team_id)")
query("r8_injury_impact", lambda f: rounded(R.injury_impact(f.roster, f.ratings, _out(f)), "full_elo", "injured_elo", "impact"), "ratings injuries", _RANKED + f", a as ({_ROSTER_ELO.format(w='')}), b as ({_ROSTER_ELO.format(w=f'where player_name not in {_INJURED}')}) select a.team_id, round(a.e, 6) as full_elo, round(coalesce(b.e, 1500), 6) as injured_elo, round(coalesce(b.e, 1500) - a.e, 6) as impact from a left join b using (team_id)")
query("r8_player_impact", lambda f: rounded(R.player_impact(_out(f), f.ratings.where("player_id % 2 = 0")).select("player_id", "team_id", "player_impact"), "player_impact"), "ratings injuries", "select i.player_id, team_id, round((coalesce(rating, 1500) - 1500) * 0.3, 6) as player_impact from injuries i left join ratings r on r.player_id = i.player_id and r.player_id % 2 = 0 where status in ('out', 'doubtful')")
_CON = _RANKED + """, c as (select team_id, max(rating) as t, coalesce(max(rating) filter (rk = 2), 1500) as s, avg(rating) as m, avg(rating) filter (rk <= 5) as v from k group by 1),
q as (select *, (t - m) * case when t >= 2000 then 0.4 when t >= 1900 then 0.3 else 0.2 end as bonus, least((t - s) / 200, 1) as risk, v - 1500 as depth from c)"""
query("r9_concentration", lambda f: rounded(R.concentration(f.roster, f.ratings), "top_player_bonus", "concentration_risk", "top_5_depth", "concentration_ratio"), "ratings", _CON + """
select team_id, t as top_player_elo, s as second_player_elo, round(bonus, 6) as top_player_bonus, round(risk, 6) as concentration_risk, round(depth, 6) as top_5_depth, round((t - m) / m, 6) as concentration_ratio, t >= 2000 as team_has_superstar,
 case when risk > 0.6 then 'Star-Dependent' when risk > 0.3 then 'Top-Heavy' else 'Balanced' end as construction_type, case when depth > 200 then 'Elite' when depth > 100 then 'Good' when depth > 0 then 'Average' else 'Poor' end as depth_rating from q""")
query("r10_apply_concentration", lambda f: rounded(R.apply_concentration(f.pred.withColumn("home_rating", 1500 + F.col("elo_diff")).withColumn("away_rating", F.lit(1500.0)), R.concentration(f.roster, f.ratings)).select("game_id", "home_adjusted", "away_adjusted", "adjusted_confidence"), "home_adjusted", "away_adjusted", "adjusted_confidence"), "pred ratings", _CON + """
select game_id, round(1500 + elo_diff + coalesce(h.bonus + 0.1 * h.depth, 0), 6) as home_adjusted, round(1500 + coalesce(a.bonus + 0.1 * a.depth, 0), 6) as away_adjusted,
 round(confidence * (1 - 0.2 * coalesce(case when home_win_prob > 0.5 then h.risk else a.risk end, 0)), 6) as adjusted_confidence from pred p left join q h on h.team_id = home_team_id left join q a on a.team_id = away_team_id""")
_CAP = "case when {p} > 0.5 then least({p}, {c}) else 1 - least(1 - {p}, {c}) end"
_CAPS = "case when abs({d}) < 50 then 0.55 when abs({d}) < 100 then 0.65 when abs({d}) < 150 then 0.75 when abs({d}) < 200 then 0.82 else 0.9 end"
_R11 = part("rated", "j3_asof_ratings", "coalesce(x.r, 1500)", "x.r") + part("form", "w1_form") + part("rest", "w5_rest") + """
, t as (select d.game_id, home_team_id, away_team_id, home_rating + hf.form + hr.rest_penalty as h, away_rating + af.form + ar.rest_penalty as a from done d join rated using (game_id)
  join form hf on hf.game_id = d.game_id and hf.team_id = home_team_id join form af on af.game_id = d.game_id and af.team_id = away_team_id
  join rest hr on hr.game_id = d.game_id and hr.team_id = home_team_id join rest ar on ar.game_id = d.game_id and ar.team_id = away_team_id)"""
_R11_COLUMNS = ["game_id", "home_final", "away_final", "home_win_prob", "confidence", "reason"]
query("r11_predict_team", lambda f: rounded(P.predict_team(f.done, f.hist, f.done).select(*_R11_COLUMNS), "home_final", "away_final", "home_win_prob", "confidence", digits=5, nudge=1e-8), "long hist", _R11 + f""",
p as (select *, {EXP.format(a='h', b='a', ha=20)} as p, {_CAPS.format(d='(h - a)')} as c from t), q as (select *, case when p is not null then {_CAP.format(p='p', c='c')} end as w from p)
select game_id, round(h + 1e-8, 5) as home_final, round(a + 1e-8, 5) as away_final, round(w + 1e-8, 5) as home_win_prob, case when w is not null then round(greatest(w, 1 - w) + 1e-8, 5) end as confidence, case when w is null then 'no rating' end as reason from q""")
query("r11_with_concentration", lambda f: rounded(P.predict_team(f.done, f.hist, f.done, metrics=R.concentration(f.roster, f.ratings)).select(*_R11_COLUMNS), "home_final", "away_final", "home_win_prob", "confidence", digits=5, nudge=1e-8), "long hist ratings", _R11 + _CON.replace("\nq as", "\nlean as") + f""",
u as (select t.game_id, t.h + coalesce(x.bonus + 0.1 * x.depth, 0) as h, t.a + coalesce(y.bonus + 0.1 * y.depth, 0) as a, coalesce(x.risk, 0) as hr, coalesce(y.risk, 0) as ar from t left join lean x on x.team_id = home_team_id left join lean y on y.team_id = away_team_id),
p as (select *, {EXP.format(a='h', b='a', ha=20)} as p, {_CAPS.format(d='(h - a)')} as c from u), w as (select *, case when p is not null then {_CAP.format(p='p', c='c')} end as w from p),
z as (select *, greatest(w, 1 - w) * (1 - 0.2 * case when w > 0.5 then hr else ar end) as k from w where w is not null)
select w.game_id, round(w.h + 1e-8, 5) as home_final, round(w.a + 1e-8, 5) as away_final, round(case when w.w > 0.5 then w.w else 1 - k end + 1e-8, 5) as home_win_prob, round(k + 1e-8, 5) as confidence, case when w.w is null then 'no rating' end as reason from w left join z using (game_id)""")


def _hybrid(f):
    return P.predict_hybrid(f.done, f.hist, f.done, R.roster_elo(f.roster, f.ratings, _out(f)), R.injury_adjustment(f.roster, f.ratings, _out(f)), f.arenas)


query("r12_predict_hybrid", lambda f: rounded(_hybrid(f).select("game_id", "home_final", "away_final", "p", "confidence", "upset_probability", "upset_alert", "pred_home_score", "pred_away_score", "context.confidence_penalty", "confidence_score.overall_confidence"), "home_final", "away_final", "p", "confidence", "overall_confidence", digits=5, nudge=1e-8), "long hist ratings injuries arenas", part("rated", "j3_asof_ratings") + part("welo", "w4_welo") + part("tired", "w7_rest_fatigue") + part("trip", "w15_travel_fatigue") + part("mom", "w2_momentum") + part("played", "w20_games_before") + part("relo", "r5_roster_elo") + part("hurt", "r7_injury_adjustment") + part("meet", "w9_h2h_recency") + f"""
, s as (select l.game_id, l.team_id, is_home, welo, fatigue_rest as r, b2b_penalty + density_penalty as tired, travel_fatigue as trip, late_wins as wins, late_games as games, games_before as n, coalesce(roster_elo, 1500) as e, coalesce(injury_adjustment, 0) as i
  from long l join welo using (game_id, team_id) join tired using (game_id, team_id) join trip using (game_id, team_id) join mom using (game_id, team_id) join played using (game_id, team_id) left join relo on relo.team_id = l.team_id left join hurt on hurt.team_id = l.team_id),
g as (select d.game_id, d.date, h2h_recency as m, 0.75 * home_rating + 0.25 * h.e as hh, 0.75 * away_rating + 0.25 * a.e as ah, h.welo as hw, a.welo as aw, h.r as hr, a.r as ar, h.tired as ht, a.tired as at_, h.trip as htr, a.trip as atr, h.i as hi, a.i as ai, h.wins as hwins, a.wins as awins, h.games as hg, a.games as ag, h.n as hn, a.n as an
  from done d join rated using (game_id) join meet using (game_id) join s h on h.game_id = d.game_id and h.is_home join s a on a.game_id = d.game_id and not a.is_home),
m as (select *, hh - ah as raw, case when hr >= 3 and ar <= 1 then 30 when hr >= 2 and ar = 0 then 15 else 0 end as mh, case when ar >= 3 and hr <= 1 then 30 when ar >= 2 and hr = 0 then 15 else 0 end as ma from g),
t as (select *, hh + case when abs(raw) < 50 then 0.15 * m + htr else 0 end + ht + mh + hw * least(1, abs(raw) / 30) + hi as h, ah + case when abs(raw) < 50 then atr else 0 end + at_ + case when mh > 0 then 0 else ma end + aw * least(1, abs(raw) / 30) + ai as a from m),
e as (select *, {EXP.format(a='h', b='a', ha=60)} as x, h - a as d from t),
p as (select *, case when abs(raw) < 30 then 0.5 + (x - 0.5) * abs(raw) / 30 else x end as p, date_diff('day', make_date(year(date), 12, 25), date) between 1 and 3 as c1, hn < 5 or an < 5 as c4, 82 - greatest(hn, an) <= 15 as c5 from e),
k as (select *, greatest(p, 1 - p) as c, case when p > 0.5 then hwins else awins end as fw, case when p > 0.5 then awins else hwins end as uw from p),
v as (select *, least(0.55, case when abs(d) < 50 then 0.45::double when abs(d) < 100 then 0.35 when abs(d) < 150 then 0.28 when abs(d) < 200 then 0.2 else 0.12 end + case when c < 0.6 then 0.1::double else 0 end + case when hg >= 3 and ag >= 3 and fw <= 2 and uw >= 4 then 0.15::double when hg >= 3 and ag >= 3 and fw <= 2 and uw >= 3 then 0.1 else 0 end) as u from k)
select game_id, round(h + 1e-8, 5) as home_final, round(a + 1e-8, 5) as away_final, round(p + 1e-8, 5) as p, round(case when c >= 0.7 and c < 0.8 then c * 0.9 when c < 0.6 then least(c * 1.05, 0.65) else c end + 1e-8, 5) as confidence,
 u as upset_probability, u > 0.3::double as upset_alert,
 cast(greatest(70, round_even(114.15 + (2.8437 + 0.034507 * d) / 2, 0)) as int) as pred_home_score, cast(greatest(70, round_even(114.15 - (2.8437 + 0.034507 * d) / 2, 0)) as int) as pred_away_score,
 least(50, case when c1 then 30 else 0 end + case when month(date) = 2 and day(date) between 20 and 23 then 15 else 0 end + case when date_diff('day', make_date(year(date), 11, 28), date) between 1 and 3 then 10 else 0 end + case when c4 then 20 else 0 end + case when c5 then 10 else 0 end)::double as confidence_penalty,
 round(0.35 * least(100, 50 + 40 * (1 - exp(-abs(d) / 75)) / (1 + exp(-abs(d) / 75))) + 0.15 * case abs(hr - ar) when 0 then 100 when 1 then 85 when 2 then 70 else 60 end + 0.25 * case when abs(hi) + abs(ai) = 0 then 100 when abs(hi) + abs(ai) <= 30 then 85 when abs(hi) + abs(ai) <= 60 then 70 when abs(hi) + abs(ai) <= 100 then 60 else 50 end
  + 0.15 * case when abs(hw) + abs(aw) <= 20 then 95 when abs(hw) + abs(aw) <= 40 then 80 when abs(hw) + abs(aw) <= 60 then 65 else 50 end + 0.1 * greatest(40, 100 - case when c1 then 30 else 0 end - case when c4 then 20 else 0 end - case when c5 then 10 else 0 end) + 1e-8, 5) as overall_confidence from v""")


_DATED = part("rated_p", "r3_player_elo") + """
, asked as (select game_id, date, home_team_id as team_id from done union all select game_id, date, away_team_id from done),
moves as (select player_id, b.team_id, b.date, b.game_id, rating_after - 1e-8 as rating_after from rated_p join box b using (game_id, player_id)),
last_ as (select player_id, date, arg_max(team_id, game_id) as on_, arg_max(rating_after, game_id) as r from moves group by 1, 2),
member as (select q.*, player_id from asked q join (select distinct team_id, player_id from moves) using (team_id)),
now as (select m.game_id, m.team_id, m.date, m.player_id, l.r from member m asof join last_ l on l.player_id = m.player_id and m.date > l.date where l.on_ = m.team_id),
away as (select n.*, exists (select 1 from absences a where a.player_id = n.player_id and a.team_id = n.team_id and a.start_date <= n.date and (a.end_date is null or a.end_date > n.date)) as out_,
  row_number() over (partition by game_id, team_id order by r desc, player_id) as rk from now n),
there as (select *, row_number() over (partition by game_id, team_id order by rk) as k from away where not out_),
ros as (select game_id, team_id, sum(r * (1 - 0.05 * (k - 1))) / sum(1 - 0.05 * (k - 1)) as e from there where k <= 10 group by 1, 2),
top_ as (select game_id, team_id, avg(r) as m from away where rk <= 10 group by 1, 2),
inj as (select game_id, team_id, round(greatest(-150, sum(greatest(-80, -(r - m) / 10 * case when rk <= 3 then 1.5 when rk <= 7 then 1 when rk <= 10 then 0.5 else 0.25 end))), 7) as i from away join top_ using (game_id, team_id) where out_ group by 1, 2),
dated as (select q.game_id, q.team_id, coalesce(e, 1500) as roster_elo, coalesce(i, 0) as injury_adjustment from asked q left join ros using (game_id, team_id) left join inj using (game_id, team_id))
"""


def _dated(f):
    """Roster and injury figures as of each game."""
    return roster_figures(f.done, R.player_elo(f.box).select("player_id", "team_id", "date", "game_id", "rating_after"), f.absences)


query("r5_r7_dated", lambda f: rounded(_dated(f), "roster_elo", "injury_adjustment", digits=4, nudge=1e-7), "box absences", _DATED + "select game_id, team_id, round(roster_elo + 1e-7, 4) as roster_elo, round(injury_adjustment + 1e-7, 4) as injury_adjustment from dated")


def _hybrid_dated(f):
    figures = _dated(f)
    return P.predict_hybrid(f.done, f.hist, f.done, figures, figures, f.arenas)


_HYBRID_COLUMNS = ["game_id", "home_final", "away_final", "p", "confidence", "upset_probability", "upset_alert", "pred_home_score", "pred_away_score", "context.confidence_penalty", "confidence_score.overall_confidence"]
_DATED_HYBRID = BODIES["r12_predict_hybrid"].replace(part("relo", "r5_roster_elo"), _DATED).replace(part("hurt", "r7_injury_adjustment"), "").replace("left join relo on relo.team_id = l.team_id left join hurt on hurt.team_id = l.team_id", "left join dated on dated.team_id = l.team_id and dated.game_id = l.game_id")
query("r12_dated_rosters", lambda f: rounded(_hybrid_dated(f).select(*_HYBRID_COLUMNS), "home_final", "away_final", "p", "confidence", "overall_confidence", digits=4, nudge=1e-7), "long hist box absences arenas", _DATED_HYBRID.replace("1e-8, 5)", "1e-7, 4)"))


def _rostered(f):
    """As-of ratings with form and rest points and roster ratings of both sides."""
    g = G.asof_ratings(f.done, f.hist).join(P.sides(W.rest(W.form(f.long)), ["form", "rest_penalty"]), "game_id")
    for s in ("home", "away"):
        g = g.join(R.roster_elo(f.roster, f.ratings).select(F.col("team_id").alias(f"{s}_team_id"), F.col("roster_elo").alias(f"{s}_roster")), f"{s}_team_id", "left").fillna(1500.0, [f"{s}_roster"])
    return g


_ADAPTIVE = part("rated", "j3_asof_ratings") + part("form", "w1_form") + part("rest", "w5_rest") + _RANKED + f""", relo as ({_ROSTER_ELO.format(w='')})
, g as (select d.game_id, d.home_score > d.away_score as hwon, home_rating as hr, away_rating as ar, coalesce(h.e, 1500) as he, coalesce(a.e, 1500) as ae, hf.form as hf, af.form as af, hq.rest_penalty as hp, aq.rest_penalty as ap from done d join rated using (game_id)
  join rest hq on hq.game_id = d.game_id and hq.team_id = home_team_id join rest aq on aq.game_id = d.game_id and aq.team_id = away_team_id
  join form hf on hf.game_id = d.game_id and hf.team_id = home_team_id join form af on af.game_id = d.game_id and af.team_id = away_team_id left join relo h on h.team_id = home_team_id left join relo a on a.team_id = away_team_id),
ta as (select *, case when abs(hr - ar) < 100 then 0.5 * hr + 0.2 * he + 0.2 * hf + 0.1 * hp else 0.7 * hr + 0.3 * he end as h, case when abs(hr - ar) < 100 then 0.5 * ar + 0.2 * ae + 0.2 * af + 0.1 * ap else 0.7 * ar + 0.3 * ae end as a from g),
pa as (select *, {EXP.format(a='h', b='a', ha=60)} as p from ta)
"""
query("r13_predict_adaptive", lambda f: rounded(P.predict_adaptive(_rostered(f)).select("game_id", "home_final", "away_final", "home_win_prob"), "home_final", "away_final", "home_win_prob", digits=5, nudge=1e-8), "long hist ratings", _ADAPTIVE + "select game_id, round(h + 1e-8, 5) as home_final, round(a + 1e-8, 5) as away_final, round(p + 1e-8, 5) as home_win_prob from pa")
_LIGHT = part("rated", "j3_asof_ratings") + part("tier", "w3_momentum_tiers") + part("meet", "w10_h2h_margin") + f"""
, t as (select d.game_id, home_score > away_score as hw, home_rating + 0.07 * h2h_margin + 0.05 * h.tier_points as h, away_rating + 0.05 * a.tier_points as a from done d join rated using (game_id) join meet using (game_id)
  join tier h on h.game_id = d.game_id and h.team_id = home_team_id join tier a on a.game_id = d.game_id and a.team_id = away_team_id), p as (select *, {EXP.format(a='h', b='a', ha=60)} as p from t)
"""
query("r14_predict_light", lambda f: rounded(P.predict_light(f.done, f.hist, f.done).select("game_id", "home_final", "home_win_prob"), "home_final", "home_win_prob", digits=5, nudge=1e-8), "long hist", _LIGHT + "select game_id, round(h + 1e-8, 5) as home_final, round(p + 1e-8, 5) as home_win_prob from p")
query("r15_backtest", lambda f: P.backtest(P.predict_light(f.done, f.hist, f.done)).agg(F.count("*").alias("games"), F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy")), "long hist", _LIGHT + "select count(*) as games, round(avg(cast((p > 0.5) = hw as int)), 6) as accuracy from p")


def _backtests(f):
    """The team, hybrid, adaptive and light models over all completed games; the hybrid one with rosters of the day."""
    hybrid = _hybrid_dated(f).withColumn("home_win_prob", F.col("p"))
    models = {"team": P.predict_team(f.done, f.hist, f.done).where("home_win_prob is not null"), "hybrid": hybrid, "adaptive": P.predict_adaptive(_rostered(f)), "light": P.predict_light(f.done, f.hist, f.done)}
    return rounded(P.backtest_summary(models), "brier", "accuracy")


_MODEL = " union all select '{m}', p, w from (select {p} - {e} as p, home_score > away_score as w from {t} join done using (game_id) where {p} is not null)"
query("r15_backtests", _backtests, "long hist ratings box absences arenas", part("mt", "r11_predict_team") + part("mh", "r12_dated_rosters") + part("ma", "r13_predict_adaptive") + part("ml", "r14_predict_light") + """
, x as (select 'x' as model, 0.0::double as p, true as w where false""" + "".join(_MODEL.format(m=m, p=p, t=t, e="1e-7" if m == "hybrid" else "1e-8") for m, p, t in (("team", "home_win_prob", "mt"), ("hybrid", "p", "mh"), ("adaptive", "home_win_prob", "ma"), ("light", "home_win_prob", "ml"))) + """)
select model, count(*) as games, count(*) filter ((p > 0.5) = w) as right, round(avg(pow(p - cast(w as int), 2)), 6) as brier, round(avg(cast((p > 0.5) = w as int)), 6) as accuracy from x group by 1""")
query("r16_track", lambda f: P.track(f.pred.drop("correct"), f.pred.where("game_id % 3 = 0"), AS_OF, 30).select("game_id", "correct"), "pred", f"select game_id, (home_win_prob > 0.5) = (home_score > away_score) as correct from pred where game_id % 3 <> 0 and date between {DAY} - 30 and {DAY}")


def _tops(f):
    from ratingmill.operators.aggregates import top_by

    return top_by(f.ratings.join(f.roster.select("player_id", "team_id"), "player_id"), ["team_id"], 3).select("player_id", "team_id", "rating")


query("r17_player_h2h", lambda f: rounded(P.player_h2h(f.done, f.box, _tops(f)).select("team_a", "team_b", "matchups", "player_h2h"), "player_h2h", digits=5), "box ratings", """
, t as (select * from (select x.player_id, r.team_id, rating, row_number() over (partition by r.team_id order by rating desc, x.player_id) as k from ratings x join roster r using (player_id)) where k <= 3),
b as (select * from box where minutes > 0 and not didNotPlay and player_id in (select player_id from t)),
m as (select x.player_id as p1, y.player_id as p2, x.plus_minus - y.plus_minus as d, row_number() over (partition by x.player_id, y.player_id order by x.game_id desc) as n from b x join b y on x.game_id = y.game_id and x.team_id <> y.team_id and x.player_id < y.player_id),
a as (select p1, p2, avg(d) as d from m where n <= 10 group by 1, 2 having count(*) >= 3),
v as (select least(t1.team_id, t2.team_id) as team_a, greatest(t1.team_id, t2.team_id) as team_b, case when t1.team_id < t2.team_id then d else -d end / 5 * 10 as v, (t1.rating + t2.rating) / 4000 as w from a join t t1 on t1.player_id = p1 join t t2 on t2.player_id = p2 where t1.team_id <> t2.team_id)
select team_a, team_b, count(*) as matchups, round(greatest(-30, least(30, sum(v * w) / sum(w))), 5) as player_h2h from v group by 1, 2""")
query("r18_betting", lambda f: P.betting_report(f.pred).select("game_id", "risk", "fair_price", "category", "recommended"), "pred", """
select game_id, case when confidence >= 0.75 then 'VERY LOW RISK' when confidence >= 0.65 then 'LOW RISK' when confidence >= 0.55 then 'MODERATE RISK' else 'HIGH RISK' end as risk,
 cast(trunc(case when confidence >= 0.5 then -(confidence / (1 - confidence)) * 100 else (1 - confidence) / confidence * 100 end) as int) as fair_price,
 case when confidence >= 0.80 then 'Blowout' when confidence >= 0.70 then 'Strong Favorite' when confidence >= 0.60 then 'Moderate Favorite' when confidence >= 0.55 then 'Slight Favorite' else 'Toss-up' end as category, confidence >= 0.65 as recommended from pred""")
_FAIR = "cast(trunc(case when confidence >= 0.5 then -(confidence / (1 - confidence)) * 100 else (1 - confidence) / confidence * 100 end) as int)"
query("r18_summary", lambda f: rounded(P.betting_summary(P.betting_report(f.pred)), "avg_confidence"), "pred", """
, r as (select *, row_number() over (partition by date order by confidence desc, game_id) as k from pred)
select date, count(*) as total_games, count(*) filter (confidence >= 0.65) as total_recommended, round(avg(floor(confidence * 100)), 6) as avg_confidence, count(*) filter (confidence >= 0.75) as very_low_count, count(*) filter (confidence >= 0.65 and confidence < 0.75) as low_count,
 count(*) filter (confidence >= 0.55 and confidence < 0.65) as moderate_count, count(*) filter (confidence < 0.55) as high_count, coalesce(string_agg(cast(game_id as varchar), ',' order by k) filter (confidence >= 0.65 and k <= 5), '') as top_games from r group by 1""")
query("r18_best_parlays", lambda f: rounded(P.best_parlays(P.betting_report(f.pred)), "probability", "decimal_odds"), "pred", f"""
, t as (select * from (select date, game_id, confidence as c, 1 + 100.0::double / abs({_FAIR}) as d, row_number() over (partition by date order by confidence desc, game_id) as k from pred where confidence >= 0.75) where k <= 3),
l as (select date, n as num_bets, string_agg(cast(game_id as varchar), '+' order by k) as games, product(c) as p, product(d) as d from t, (select unnest([2, 3]) as n) where k <= n group by 1, 2 having count(*) = n)
select date, num_bets, games, round(p, 6) as probability, case when p >= 0.75 then 'VERY LOW RISK' when p >= 0.65 then 'LOW RISK' when p >= 0.55 then 'MODERATE RISK' else 'HIGH RISK' end as risk, round(d, 6) as decimal_odds, cast(trunc(case when d >= 2 then (d - 1) * 100 else -100 / (d - 1) end) as int) as combined_odds from l""")
query("r18_parlays", lambda f: rounded(P.parlays(P.betting_report(f.pred)), "probability", "decimal_odds"), "pred", """
, t as (select * from (select date, game_id, confidence as c, row_number() over (partition by date order by confidence desc, game_id) as k from pred where confidence >= 0.65) where k <= 5)
select x.date, x.game_id || '+' || y.game_id as games, round(x.c * y.c, 6) as probability, round(1 / (x.c * y.c), 6) as decimal_odds from t x join t y on x.date = y.date and x.k < y.k""")
query("r19_drift", lambda f: rounded(P.drift(f.pred, AS_OF), "acc7", "acc30", "season_accuracy"), "pred", f"""
, p as (select * from pred where date <= {DAY}),
a as (select count(*) filter (date >= {DAY} - 7) as n7, avg(cast(correct as int)) filter (date >= {DAY} - 7) as a7, count(*) filter (date >= {DAY} - 30) as n30, avg(cast(correct as int)) filter (date >= {DAY} - 30) as a30, avg(cast(correct as int)) filter ({SEASON} = 1999) as s, max((date, game_id)) filter (correct) as l from p),
w as (select count(*) as w from p, a where (date, game_id) > l)
select n7, round(a7, 6) as acc7, n30, round(a30, 6) as acc30, round(s, 6) as season_accuracy, w as wrong_streak, coalesce(n7 >= 5 and n30 >= 10 and a30 - a7 >= 0.05, false) as accuracy_drop, coalesce(n7 >= 5 and n30 >= 10 and a30 - a7 >= 0.05, false) or w >= 3 as alert from a, w""")


query("r22_infer_roster", lambda f: R.infer_roster(f.box, 60), "box", "select distinct b.player_id, b.team_id from box b join (select team_id, max(date) as m from box group by 1) l using (team_id) where b.date >= m - 60")
_QUARTERS = [(k, side, "+" if side == "home" else "-", m) for k, m in enumerate(S.QUARTER_MODELS, 1) for side in ("home", "away")]
query("r23_add_scores", lambda f: P.add_scores(f.pred.select("game_id", "elo_diff"), quarters=True).drop("elo_diff"), "pred", "select game_id, cast(greatest(70, round_even(114.15 + (2.8437 + 0.034507 * elo_diff) / 2, 0)) as int) as pred_home_score, cast(greatest(70, round_even(114.15 - (2.8437 + 0.034507 * elo_diff) / 2, 0)) as int) as pred_away_score, " + ", ".join(f"cast(greatest(15, round_even({m['average']} {sign} ({m['intercept']} + {m['slope']} * elo_diff) / 2, 0)) as int) as pred_{side}_q{k}" for k, side, sign, m in _QUARTERS) + " from pred")
query("r24_prob_to_diff", lambda f: rounded(P.prob_to_diff(f.pred.select("game_id", "home_win_prob")).select("game_id", "implied_diff"), "implied_diff"), "pred", "select game_id, round(-400 * log10(1 / home_win_prob - 1), 6) as implied_diff from pred")

# F: functions over whole tables
query("f4_f5_elo_math", lambda f: rounded(f.pred.select("game_id", S.expected_score(1500 + F.col("elo_diff"), F.lit(1500.0), 30).alias("e"), S.mov_multiplier(F.col("home_score") - F.col("away_score")).alias("m")), "e", "m"), "pred", f"select game_id, round({EXP.format(a='1500 + elo_diff', b='1500', ha=30)}, 6) as e, round(ln(abs(home_score - away_score) + 1) / ln(15.0), 6) as m from pred")
query("f7_caps", lambda f: rounded(f.pred.select("game_id", S.confidence_cap(F.col("elo_diff")).alias("cap"), S.capped_probability(F.col("home_win_prob"), F.col("elo_diff")).alias("p")), "p"), "pred", """
, c as (select *, case when abs(elo_diff) < 50 then 0.55 when abs(elo_diff) < 100 then 0.65 when abs(elo_diff) < 150 then 0.75 when abs(elo_diff) < 200 then 0.82 else 0.9 end::double as cap from pred)
select game_id, cap, round(case when home_win_prob > 0.5 then least(home_win_prob, cap) else 1 - least(1 - home_win_prob, cap) end, 6) as p from c""")
query("f8_f9_travel", lambda f: rounded(f.long.where("not is_home").join(f.arenas.select("team_id", F.col("latitude").alias("a1"), F.col("longitude").alias("o1"), F.col("timezone").alias("z1")), "team_id").join(f.arenas.select(F.col("team_id").alias("opponent_id"), F.col("latitude").alias("a2"), F.col("longitude").alias("o2"), F.col("timezone").alias("z2")), "opponent_id").withColumn("miles", S.haversine(F.col("a1"), F.col("o1"), F.col("a2"), F.col("o2"), 3956.0)).select("game_id", "miles", S.travel_penalty(F.col("miles"), F.abs(F.col("z1") - F.col("z2")), F.lit(6)).alias("penalty")), "miles", "penalty", digits=3), "long arenas", """
, d as (select game_id, abs(a.timezone - b.timezone) as z, 2 * 3956 * asin(sqrt(least(1.0, pow(sin((radians(b.latitude) - radians(a.latitude)) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2)))) as m from long l join arenas a on a.team_id = l.team_id join arenas b on b.team_id = l.opponent_id where not is_home)
select game_id, round(m, 3) as miles, round(case when m > 2000 then -least(15, 5 + (m - 2000) / 500) else 0 end - z * 8 - 20, 3) as penalty from d""")
query("f10_odds", lambda f: rounded(f.odds.select("game_id", "book", "is_home", S.american_to_probability(F.col("price")).alias("p"), S.american_to_decimal(F.col("price")).alias("d")), "p", "d"), "odds", "select game_id, book, is_home, round(case when price < 0 then -price / (100 - price) else 100 / (price + 100) end, 6) as p, round(case when price < 0 then 1 + 100 / -price else 1 + price / 100 end, 6) as d from odds")
query("f11_season_calibration", lambda f: rounded(f.pred.select("game_id", S.estimated_games(F.col("date")).alias("n"), S.season_calibrated(F.col("home_win_prob"), S.estimated_games(F.col("date"))).alias("p")), "p"), "pred", f"""
, n as (select *, greatest(0, cast(trunc(date_diff('day', make_date({SEASON}, 10, 20), date) * 0.5) as int)) as n from pred)
select game_id, n, round(0.5 + (home_win_prob - 0.5) * least(1, 0.7 + 0.3 * n / 20), 6) as p from n""")
def _context(f):
    played = P.sides(W.games_before(f.long), ["games_before"])
    return f.pred.join(played, "game_id").select("game_id", S.game_context(F.col("date"), F.col("home_games_before"), F.col("away_games_before")).alias("c")).select("game_id", "c.is_post_christmas", "c.is_season_opener", "c.is_playoff_push", "c.context_summary", "c.confidence_penalty")


_PLAYED = part("played", "w20_games_before")
query("f12_context", _context, "pred long", _PLAYED + """
, n as (select p.game_id, p.date, h.games_before as hn, a.games_before as an from pred p join played h on h.game_id = p.game_id and h.team_id = home_team_id join played a on a.game_id = p.game_id and a.team_id = away_team_id),
x as (select game_id, date_diff('day', make_date(year(date), 12, 25), date) between 1 and 3 as a, month(date) = 2 and day(date) between 20 and 23 as b, date_diff('day', make_date(year(date), 11, 28), date) between 1 and 3 as c, hn < 5 or an < 5 as d, 82 - greatest(hn, an) <= 15 as e from n),
y as (select *, concat_ws(', ', case when a then 'Post-Christmas' end, case when b then 'Post-All-Star' end, case when c then 'Post-Thanksgiving' end, case when d then 'Season Opener' end, case when e then 'Playoff Push' end) as s from x)
select game_id, a as is_post_christmas, d as is_season_opener, e as is_playoff_push, case when s = '' then 'Normal game conditions' else 'Special circumstances: ' || s end as context_summary,
 least(50, case when a then 30 else 0 end + case when b then 15 else 0 end + case when c then 10 else 0 end + case when d then 20 else 0 end + case when e then 10 else 0 end)::double as confidence_penalty from y""")


def _confidence(f):
    team = P.sides(W.form(W.rest_fatigue(f.long)).withColumn("form", F.round("form", 6)), ["fatigue_rest", "form"])
    hurt = R.injury_adjustment(f.roster, f.ratings, _out(f)).select("team_id", "injury_adjustment")
    g = f.pred.join(team, "game_id")
    for s in ("home", "away"):
        g = g.join(hurt.toDF(f"{s}_team_id", f"{s}_injury"), f"{s}_team_id", "left").fillna(0.0, [f"{s}_injury"])
    c = S.game_context(F.col("date"), F.lit(40), F.lit(40))
    score = S.confidence_score(F.col("elo_diff"), F.col("home_fatigue_rest"), F.col("away_fatigue_rest"), F.col("home_injury"), F.col("away_injury"), F.col("home_form"), F.col("away_form"), c["is_post_christmas"], c["is_season_opener"], c["is_playoff_push"])
    return rounded(g.select("game_id", score.alias("s")).select("game_id", "s.overall_confidence", "s.confidence_level"), "overall_confidence", digits=5, nudge=1e-8)


query("f13_confidence_score", _confidence, "pred long ratings injuries", part("tired", "w7_rest_fatigue") + part("form", "w1_form") + part("hurt", "r7_injury_adjustment") + """
, x as (select p.game_id, elo_diff, abs(th.fatigue_rest - ta.fatigue_rest) as g, abs(coalesce(ih.injury_adjustment, 0)) + abs(coalesce(ia.injury_adjustment, 0)) as i, abs(round(fh.form, 6)) + abs(round(fa.form, 6)) as v, date_diff('day', make_date(year(date), 12, 25), date) between 1 and 3 as c from pred p
  join tired th on th.game_id = p.game_id and th.team_id = home_team_id join tired ta on ta.game_id = p.game_id and ta.team_id = away_team_id join form fh on fh.game_id = p.game_id and fh.team_id = home_team_id join form fa on fa.game_id = p.game_id and fa.team_id = away_team_id
  left join hurt ih on ih.team_id = home_team_id left join hurt ia on ia.team_id = away_team_id),
t as (select game_id, 0.35 * least(100, 50 + 40 * (1 - exp(-abs(elo_diff) / 75)) / (1 + exp(-abs(elo_diff) / 75))) + 0.15 * case g when 0 then 100 when 1 then 85 when 2 then 70 else 60 end + 0.25 * case when i = 0 then 100 when i <= 30 then 85 when i <= 60 then 70 when i <= 100 then 60 else 50 end + 0.15 * case when v <= 20 then 95 when v <= 40 then 80 when v <= 60 then 65 else 50 end + 0.1 * greatest(40, 100 - case when c then 30 else 0 end) as t from x)
select game_id, round(t + 1e-8, 5) as overall_confidence, case when t >= 75 then 'High' when t >= 55 then 'Medium' else 'Low' end as confidence_level from t""")


def _market(f):
    from ratingmill.operators.aggregates import odds_consensus

    side = odds_consensus(f.odds).groupBy("game_id").agg(*[F.max(F.when(F.col("is_home") == at, F.col("probability"))).alias(c) for at, c in ((True, "home"), (False, "away"))])
    return rounded(f.pred.join(side, "game_id").select("game_id", S.market_blend(F.col("home_win_prob"), F.col("home"), F.col("away")).alias("m")).select("game_id", "m.*"), "blended", "divergence", nudge=1e-9)


query("f15_market_blend", _market, "pred odds", """
, o as (select game_id, avg(case when price < 0 then -price / (100 - price) else 100 / (price + 100) end) filter (is_home) as h, avg(case when price < 0 then -price / (100 - price) else 100 / (price + 100) end) filter (not is_home) as a from odds group by 1),
x as (select game_id, home_win_prob as p, h / (h + a) as m from pred join o using (game_id))
select game_id, round(p + 0.15 * (m - p) + 1e-9, 6) as blended, round(p - m + 1e-9, 6) as divergence, case when abs(p - m) < 0.05 then 'high' when abs(p - m) < 0.1 then 'medium' else 'low' end as agreement, abs(p - m) >= 0.1 as upset_alert,
 case when abs(p - m) < 0.1 then '' when (p > 0.5) <> (m > 0.5) then 'different favorites' else 'same favorite' end as alert_reason from x""")


def _severity(f):
    last = f.box.where("not didNotPlay").groupBy("player_id").agg(F.datediff(F.lit(AS_OF), F.max("date")).alias("days"))
    return f.injuries.join(last, "player_id", "left").select("player_id", F.round(S.injury_severity(F.col("status"), F.coalesce("days", F.lit(0))), 6).alias("severity"))


query("f17_severity", _severity, "box injuries", f"""
, l as (select player_id, date_diff('day', max(date), {DAY}) as days from box where not didNotPlay group by 1)
select i.player_id, round(case status when 'out' then 1 when 'doubtful' then 0.8 when 'questionable' then 0.5 when 'probable' then 0.2 when 'available' then 0 else 0.5 end * case when coalesce(days, 0) > 7 then 0.9 else 1 end, 6)::double as severity from injuries i left join l using (player_id)""")
def _upset(f):
    won = P.sides(W.momentum(f.long), ["late_wins", "late_games"])
    home = F.col("home_win_prob") > 0.5
    wins = [F.when(home, F.col(f"{a}_late_wins")).otherwise(F.col(f"{b}_late_wins")) for a, b in (("home", "away"), ("away", "home"))]
    enough = (F.col("home_late_games") >= 3) & (F.col("away_late_games") >= 3)
    upset = S.upset_probability(F.col("elo_diff"), F.col("home_win_prob"), *wins, enough)
    return rounded(f.pred.join(won, "game_id").select("game_id", upset.alias("upset"), (upset > S.UPSET_ALERT).alias("upset_alert"), S.calibrated_confidence(F.col("confidence")).alias("c"), S.toss_up(F.col("home_win_prob"), F.col("elo_diff")).alias("t")), "upset", "c", "t")


query("f18_f19_upset", _upset, "pred long", part("mom", "w2_momentum") + """
, x as (select p.*, h.late_games >= 3 and a.late_games >= 3 as enough, case when home_win_prob > 0.5 then h.late_wins else a.late_wins end as fw, case when home_win_prob > 0.5 then a.late_wins else h.late_wins end as uw from pred p join mom h on h.game_id = p.game_id and h.team_id = home_team_id join mom a on a.game_id = p.game_id and a.team_id = away_team_id),
y as (select *, (least(0.55::double, case when abs(elo_diff) < 50 then 0.45::double when abs(elo_diff) < 100 then 0.35 when abs(elo_diff) < 150 then 0.28 when abs(elo_diff) < 200 then 0.2 else 0.12 end + case when greatest(home_win_prob, 1 - home_win_prob) < 0.6 then 0.1::double else 0 end + case when enough and fw <= 2 and uw >= 4 then 0.15::double when enough and fw <= 2 and uw >= 3 then 0.1 else 0 end))::double as u from x)
select game_id, round(u, 6) as upset, u > 0.3::double as upset_alert,
 round(case when confidence >= 0.7 and confidence < 0.8 then confidence * 0.9 when confidence < 0.6 then least(confidence * 1.05, 0.65) else confidence end, 6) as c, round(case when abs(elo_diff) < 30 then 0.5 + (home_win_prob - 0.5) * abs(elo_diff) / 30 else home_win_prob end, 6) as t from y""")


def _pace(f):
    from pyspark.sql import Window

    last = Window.partitionBy("team_id").orderBy("date", "game_id").rowsBetween(-10, -1)
    means = f.long.select("game_id", "is_home", *[F.coalesce(F.avg(c).over(last), F.lit(0.0)).alias(k) for c, k in (("team_score", "points"), ("opponent_score", "allowed"))])
    g = P.sides(means, ["points", "allowed"])
    style = {f"{s}_{k}": S.pace_style(F.col(f"{s}_points"), F.col(f"{s}_allowed"))[n] for s in ("home", "away") for n, k in enumerate(("pace", "defence"))}
    return g.withColumns(style).select("game_id", *style, S.tempo_note(F.col("home_points"), F.col("away_points")).alias("tempo_note"))


_PACE = "case when {p} > 115 then 'Fast-paced' when {p} > 108 then 'Moderate' else 'Slow-paced' end as {s}_pace, case when {a} < 111 then 'Elite defense' when {a} < 116 then 'Average defense' else 'Weak defense' end as {s}_defence"
query("f20_pace", _pace, "long", f"""
, m as (select game_id, is_home, coalesce(avg(team_score) over w, 0) as p, coalesce(avg(opponent_score) over w, 0) as a from long window w as (partition by team_id order by date, game_id rows between 10 preceding and 1 preceding)),
g as (select h.game_id, h.p as hp, h.a as ha, a.p as ap, a.a as aa from m h join m a on a.game_id = h.game_id and h.is_home and not a.is_home)
select game_id, {_PACE.format(p='hp', a='ha', s='home')}, {_PACE.format(p='ap', a='aa', s='away')},
 case when hp > 115 and ap > 115 then 'HIGH-SCORING POTENTIAL' when hp < 108 and ap < 108 then 'LOW-SCORING GAME' when abs(hp - ap) > 10 then 'PACE CLASH' else 'BALANCED MATCHUP' end as tempo_note from g""")
