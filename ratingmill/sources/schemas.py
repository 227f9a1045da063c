"""Explicit schemas of the tables; nothing is ever inferred."""

from pyspark.sql import types as T


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_S, _I, _L, _D, _B, _DATE = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.DateType()

GAMES = _table(
    game_id=_L, pool=_L, date=_DATE, home_team_id=_L, away_team_id=_L, home_score=_L, away_score=_L, season_type=_S, winner_team_id=_L
)
BOXSCORES = _table(
    game_id=_L, player_id=_L, player_name=_S, team_id=_L, didNotPlay=_B, minutes=_D, points=_L, plus_minus=_L, rebounds=_L,
    assists=_L, steals=_L, blocks=_L, turnovers=_L, fg_made=_L, fg_attempted=_L, ft_attempted=_L, defensive_rebounds=_L,
)
TEAM_HISTORY = _table(
    game_id=_L, pool=_L, date=_DATE, team_id=_L, opponent_id=_L, is_home=_B, team_score=_L, opponent_score=_L, won=_B,
    rating_before=_D, rating_after=_D, rating_change=_D, expected_score=_D,
)
SCOREBOARD = _table(
    events=T.ArrayType(
        _table(
            id=_S,
            date=_S,
            season=_table(type=_I),
            competitors=T.ArrayType(_table(homeAway=_S, team=_table(id=_S, displayName=_S), score=_S)),
        )
    )
)
BOXSCORE_FEED = _table(
    game_id=_S,
    teams=T.ArrayType(
        _table(
            team=_table(id=_S, displayName=_S),
            statistics=T.ArrayType(
                _table(
                    labels=T.ArrayType(_S),
                    athletes=T.ArrayType(
                        _table(athlete=_table(id=_S, displayName=_S), starter=_B, didNotPlay=_B, stats=T.ArrayType(_S))
                    ),
                )
            ),
        )
    ),
)
SCHEDULE_FEED = _table(
    gameDates=T.ArrayType(
        _table(
            gameDate=_S,
            games=T.ArrayType(
                _table(
                    gameId=_S, gameStatus=_I, homeTeam=_table(teamTricode=_S, score=_I), awayTeam=_table(teamTricode=_S, score=_I)
                )
            ),
        )
    )
)
INJURY_FEED = _table(
    teams=T.MapType(_S, _table(injuries=T.ArrayType(_table(player_name=_S, status=_S)))), date=_S
)
ODDS_FEED = _table(
    id=_S,
    home_team=_S,
    away_team=_S,
    bookmakers=T.ArrayType(
        _table(key=_S, markets=T.ArrayType(_table(key=_S, outcomes=T.ArrayType(_table(name=_S, price=_D)))))
    ),
)
