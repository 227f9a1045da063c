"""Sports tables derived from the driver's tables by integer arithmetic (FIXTURES.md).

Each recipe is one SELECT that Spark and DuckDB read alike but for integer division, written
``//`` here. ``frames`` gives Spark DataFrames, ``with_`` the same as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("orders", "lineitem", "events", "documents")

RECIPES = {
    "games": """
        select o_orderkey as game_id, o_custkey % 25 as pool, cast(o_orderdate as date) as date,
               (o_custkey % 25) * 100 + (o_custkey // 25) % 12 as home_team_id,
               (o_custkey % 25) * 100 + ((o_custkey // 25) % 12 + 1 + o_orderkey % 11) % 12 as away_team_id,
               case when o_orderstatus = 'P' then 0 else 80 + (o_orderkey * 37 + o_custkey * 11) % 61 end as home_score,
               case when o_orderstatus = 'P' then 0 else 80 + (o_orderkey * 53 + o_custkey * 7) % 61 end as away_score,
               case when o_orderpriority = '1-URGENT' then 'playoff' else 'regular' end as season_type
        from orders""",
    "done": "select * from games where home_score > 0 or away_score > 0",
    "long": """
        select game_id, pool, date, season_type, home_team_id as team_id, away_team_id as opponent_id, true as is_home,
               home_score as team_score, away_score as opponent_score, home_score - away_score as margin, home_score > away_score as won
        from done
        union all
        select game_id, pool, date, season_type, away_team_id, home_team_id, false,
               away_score, home_score, away_score - home_score, home_score <= away_score
        from done""",
    "hist": """
        select game_id, pool, date, team_id, opponent_id, is_home, team_score, opponent_score, won,
               cast(1350 + (game_id * 31 + team_id * 17) % 300 as double) as rating_before,
               cast(1350 + (game_id * 31 + team_id * 17) % 300 + (game_id * 13 + team_id * 7) % 41 - 20 as double) as rating_after,
               cast((game_id * 13 + team_id * 7) % 41 - 20 as double) as rating_change
        from long""",
    "box": """
        select l.l_orderkey as game_id, g.date as date, g.pool as pool,
               case when l.l_partkey % 2 = 0 then g.home_team_id else g.away_team_id end as team_id,
               case when l.l_partkey % 2 = 0 then g.home_team_id else g.away_team_id end * 10 + l.l_linenumber as player_id,
               min(l.l_returnflag) = 'R' as didNotPlay,
               cast(least(48, max(cast(floor(l.l_quantity) as bigint))) as double) as minutes,
               max(cast(floor(l.l_extendedprice) as bigint) % 45) as points,
               max((cast(floor(l.l_extendedprice) as bigint) // 7) % 61) - 30 as plus_minus,
               max((cast(floor(l.l_extendedprice) as bigint) // 11) % 15) as rebounds,
               max((cast(floor(l.l_extendedprice) as bigint) // 13) % 12) as assists,
               max((cast(floor(l.l_extendedprice) as bigint) // 17) % 5) as steals,
               max((cast(floor(l.l_extendedprice) as bigint) // 19) % 4) as blocks,
               max((cast(floor(l.l_extendedprice) as bigint) // 23) % 6) as turnovers,
               max((cast(floor(l.l_extendedprice) as bigint) // 29) % 25) as fg_attempted,
               least(max((cast(floor(l.l_extendedprice) as bigint) // 29) % 25), max((cast(floor(l.l_extendedprice) as bigint) // 31) % 15)) as fg_made,
               max((cast(floor(l.l_extendedprice) as bigint) // 37) % 10) as ft_attempted,
               (max((cast(floor(l.l_extendedprice) as bigint) // 11) % 15) * 7) // 10 as defensive_rebounds
        from lineitem l join done g on l.l_orderkey = g.game_id
        group by 1, 2, 3, 4, 5""",
    "roster": """
        select distinct player_id, team_id, concat('Player ', cast(player_id as varchar(20))) as player_name,
               case player_id % 3 when 0 then 'G' when 1 then 'F' else 'C' end as position
        from box""",
    "ratings": """
        select player_id, player_name, cast(1400 + (player_id * 37) % 700 as double) as rating, 5 + player_id % 60 as games_played
        from roster""",
    "arenas": """
        select distinct team_id, 25 + (team_id * 37 % 240) / 10.0e0 as latitude, -122 + (team_id * 53 % 500) / 10.0e0 as longitude, team_id % 4 as timezone
        from long""",
    "quarters": """
        select game_id, pool, date, team_id, is_home, team_score // 4 as q1, team_score // 4 + team_score % 3 as q2,
               team_score // 4 - team_score % 2 as q3,
               team_score - 3 * (team_score // 4) - team_score % 3 + team_score % 2 as q4, team_score as total
        from long""",
    "odds": """
        select game_id, b as book, true as is_home, cast(-(105 + (game_id * b) % 200) as double) as price from done, (select 1 as b union all select 2 union all select 3) books
        union all
        select game_id, b, false, cast(100 + (game_id * b) % 200 as double) from done, (select 1 as b union all select 2 union all select 3) books""",
    "injuries": """
        select player_id, team_id, player_name,
               case player_id % 5 when 0 then 'out' when 1 then 'doubtful' when 2 then 'questionable' when 3 then 'probable' else 'returning' end as status
        from roster where player_id % 17 = 0""",
    "absences": """
        select player_id, team_id, date_add(date '1993-01-01', cast(player_id * 37 % 1500 as int)) as start_date,
               case when player_id % 9 = 0 then null else date_add(date '1993-01-01', cast(player_id * 37 % 1500 + 40 + player_id % 400 as int)) end as end_date
        from roster where player_id % 4 = 0""",
    "pred": """
        select game_id, pool, date, season_type, home_team_id, away_team_id, home_score, away_score,
               (20 + (game_id * 7919) % 61) / 100.0e0 as home_win_prob,
               greatest((20 + (game_id * 7919) % 61) / 100.0e0, (80 - (game_id * 7919) % 61) / 100.0e0) as confidence,
               cast((game_id * 31) % 400 - 200 as double) as elo_diff,
               game_id % 7 = 0 as is_b2b, game_id % 7 = 0 as home_b2b, game_id % 11 = 0 as away_b2b, game_id % 5 = 0 as enhanced,
               cast(90 + (game_id * 17) % 40 as double) as pred_home_score, cast(90 + (game_id * 19) % 40 as double) as pred_away_score,
               (20 + (game_id * 7919) % 61) >= 50 as picked_home,
               ((20 + (game_id * 7919) % 61) >= 50) = (home_score > away_score) as correct
        from done""",
    "names": """
        select distinct word as player_name from (select explode_(split(text, ' ')) as word from documents) w where length(word) > 1""",
}
NEEDS = {
    "games": ("orders",),
    "done": ("games",),
    "long": ("done",),
    "hist": ("long",),
    "box": ("lineitem", "done"),
    "roster": ("box",),
    "ratings": ("roster",),
    "arenas": ("long",),
    "quarters": ("long",),
    "odds": ("done",),
    "injuries": ("roster",),
    "absences": ("roster",),
    "pred": ("done",),
    "names": ("documents",),
}


def _order(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for name in names:
        if name in RECIPES:
            for x in [*_order(NEEDS[name]), name]:
                if x not in out:
                    out.append(x)
    return out


class Frames:
    """Derived tables of one data folder, each built when it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.made:
            if name in RECIPES:
                text = RECIPES[name].replace("//", "div").replace("explode_(", "explode(").replace("varchar(20)", "string")
                for need in NEEDS[name]:
                    for word in ("from", "join"):
                        text = text.replace(f"{word} {need}", f"{word} {{{need}}}")
                self.made[name] = self.spark.sql(text, **{n: getattr(self, n) for n in NEEDS[name]})
            else:
                self.made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.made[name]


def with_(*names: str) -> str:
    """``with ...`` of the derived tables and all that they need, for DuckDB."""
    return "with " + ",\n".join(f"{n} as ({RECIPES[n].replace('explode_(', 'unnest(')})" for n in _order(names))
