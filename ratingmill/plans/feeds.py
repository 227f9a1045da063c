"""Queries over landed JSON: feeds made of the derived tables, parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratingmill.functions import parse
from ratingmill.plans import ratings as _ratings  # noqa: F401  its SQL is used below
from ratingmill.plans.base import AS_OF, BODIES, part, query, rounded
from ratingmill.operators import pools, replay, summaries
from ratingmill.operators import ratings as R
from ratingmill.sources import feeds, landing, ledger, schemas, tables
from ratingmill.sources.shared import shared_folder
from ratingmill.streaming import streams


def _team(c: str):
    return F.struct(F.col(c).cast("string").alias("id"), F.concat(F.lit("Team "), c).alias("displayName"))


def _scoreboard(f):
    side = lambda s: F.struct(F.lit(s).alias("homeAway"), _team(f"{s}_team_id").alias("team"), F.col(f"{s}_score").cast("string").alias("score"))
    both = F.when(F.col("game_id") % 9 == 0, F.array(side("home"))).otherwise(F.array(side("away"), side("home")))
    event = F.struct(F.col("game_id").cast("string").alias("id"), F.date_format("date", "yyyy-MM-dd'T'HH:mm'Z'").alias("date"), F.struct(F.when(F.col("season_type") == "playoff", 3).otherwise(2).alias("type")).alias("season"), both.alias("competitors"))
    return f.done.groupBy("date").agg(F.collect_list(event).alias("events")).select(F.to_json(F.struct("events")).alias("value"))


query("io3_scoreboard", lambda f: feeds.parse_scoreboard(_scoreboard(f)).select(F.col("game_id").cast("long"), "date", F.col("home_team_id").cast("long"), "home_score", F.col("winner_team_id").cast("long"), "season_type"), "done", "select game_id, date, home_team_id, home_score, case when home_score > away_score then home_team_id when away_score > home_score then away_team_id end as winner_team_id, season_type from done where game_id % 9 <> 0")


def _boxscore(f):
    labels = F.array(*[F.lit(x) for x in ("MIN", "FG", "PTS", "REB", "+/-")])
    clock = F.concat(F.col("minutes").cast("int").cast("string"), F.lit(":30"))
    plus = F.when(F.col("plus_minus") > 0, F.concat(F.lit("+"), "plus_minus")).otherwise(F.col("plus_minus").cast("string"))
    stats = F.array(F.when(F.col("didNotPlay"), "--").otherwise(clock), F.concat_ws("-", "fg_made", "fg_attempted"), F.col("points").cast("string"), F.col("rebounds").cast("string"), plus)
    player = F.struct(F.struct(F.col("player_id").cast("string").alias("id"), F.concat(F.lit("Player "), "player_id").alias("displayName")).alias("athlete"), F.lit(True).alias("starter"), "didNotPlay", stats.alias("stats"))
    teams = f.box.groupBy("game_id", "team_id").agg(F.collect_list(player).alias("athletes")).withColumn("statistics", F.array(F.struct(labels.alias("labels"), "athletes")))
    games = teams.groupBy("game_id").agg(F.collect_list(F.struct(_team("team_id").alias("team"), "statistics")).alias("teams"))
    return games.select(F.to_json(F.struct(F.col("game_id").cast("string").alias("game_id"), "teams")).alias("value"))


query("io4_boxscore", lambda f: feeds.parse_boxscore(_boxscore(f)).select(F.col("game_id").cast("long"), F.col("player_id").cast("long"), F.col("team_id").cast("long"), "minutes", "points", "fg_made", "fg_attempted", "rebounds", "plus_minus"), "box", "select game_id, player_id, team_id, case when didNotPlay then 0 else minutes + 0.5 end as minutes, points, fg_made, fg_attempted, rebounds, plus_minus from box")


def _schedule(f):
    side = lambda s: F.struct(F.concat(F.lit("T"), f"{s}_team_id").alias("teamTricode"), F.col(f"{s}_score").alias("score"))
    game = F.struct(F.col("game_id").cast("string").alias("gameId"), F.when(F.col("game_id") % 7 == 0, 1).otherwise(3).alias("gameStatus"), side("home").alias("homeTeam"), side("away").alias("awayTeam"))
    days = f.games.groupBy("date").agg(F.collect_list(game).alias("games"))
    day = F.struct(F.date_format("date", "MM/dd/yyyy HH:mm:ss").alias("gameDate"), "games")
    return days.select(F.to_json(F.struct(F.array(day).alias("gameDates"))).alias("value"))


query("io5_schedule", lambda f: feeds.parse_schedule(_schedule(f), f.arenas.where("team_id % 10 <> 3").select(F.concat(F.lit("T"), "team_id").alias("code"), "team_id"), "1999-10-01", str(AS_OF)).select(F.col("game_id").cast("long"), "date", "home_team_id", "away_team_id", "winner_team_id"), "done", f"select game_id, date, home_team_id, away_team_id, case when home_score > away_score then home_team_id else away_team_id end as winner_team_id from done where date between date '1999-10-01' and date '{AS_OF}' and game_id % 7 <> 0 and home_team_id % 10 <> 3 and away_team_id % 10 <> 3")
query("io6_team_rows", lambda f: feeds.pair_team_rows(f.long.where("not (game_id % 8 = 0 and is_home)").select("game_id", "date", "team_id", F.when(F.col("is_home"), "AAA vs. BBB").otherwise("BBB @ AAA").alias("matchup"), F.col("team_score").alias("points"))), "done", "select game_id, date, home_team_id, away_team_id, home_score, away_score, case when home_score > away_score then home_team_id else away_team_id end as winner_team_id from done where game_id % 8 <> 0")


def _injury_feed(f):
    teams = f.injuries.groupBy("team_id").agg(F.collect_list(F.struct("player_name", F.initcap("status").alias("status"))).alias("injuries"))
    return teams.select(F.to_json(F.struct(F.create_map(F.col("team_id").cast("string"), F.struct("injuries")).alias("teams"), F.lit("2000-02-15").alias("date"))).alias("value"))


query("io7_injuries", lambda f: feeds.parse_injuries(_injury_feed(f), True).select(F.col("team_id").cast("long"), "player_name", "status"), "injuries", "select team_id, player_name, status from injuries where status in ('out', 'doubtful', 'questionable')")


def _odds_feed(f):
    o = f.odds.withColumn("name", F.when(F.col("is_home"), "home").otherwise("away"))
    market = F.struct(F.when(F.col("book") == 3, "spreads").otherwise("h2h").alias("key"), "outcomes")
    books = o.groupBy("game_id", "book").agg(F.collect_list(F.struct("name", "price")).alias("outcomes")).withColumn("markets", F.array(market))
    games = books.groupBy("game_id").agg(F.collect_list(F.struct(F.col("book").cast("string").alias("key"), "markets")).alias("bookmakers"))
    return games.select(F.to_json(F.struct(F.col("game_id").cast("string").alias("id"), F.lit("home").alias("home_team"), F.lit("away").alias("away_team"), "bookmakers")).alias("value"))


query("io8_odds", lambda f: feeds.parse_odds(_odds_feed(f)).select(F.col("game_id").cast("long"), F.col("book").cast("int"), "outcome", "price"), "odds", "select game_id, book, case when is_home then 'home' else 'away' end as outcome, price from odds where book <> 3")
query("io9_quarters", lambda f: feeds.quarter_lines(f.quarters.withColumn("total", F.col("total") + F.col("game_id") % 3 * 4).withColumn("q4", F.when(F.col("game_id") % 11 == 0, F.lit(0)).otherwise(F.col("q4")))).select("game_id", "home_q1", "home_q4", "home_ot", "away_q3", "away_ot"), "quarters", """
, g as (select * from quarters where game_id % 11 <> 0 and q1 > 0 and q2 > 0 and q3 > 0 and q4 > 0)
select h.game_id, h.q1 as home_q1, h.q4 as home_q4, h.game_id % 3 * 4 as home_ot, a.q3 as away_q3, a.game_id % 3 * 4 as away_ot from g h join g a on a.game_id = h.game_id and h.is_home and not a.is_home""")
query("f2_f3_parse", lambda f: rounded(f.box.select("game_id", "player_id", parse.minutes(F.when(F.col("didNotPlay"), "--").otherwise(F.concat_ws(":", F.col("minutes").cast("int").cast("string"), (F.col("points") % 60).cast("string")))).alias("m"), parse.made_attempted(F.when(F.col("didNotPlay"), "x").otherwise(F.concat_ws("-", "fg_made", "fg_attempted")))[0].alias("made")), "m"), "box", "select game_id, player_id, round(case when didNotPlay then 0 else minutes + points % 60 / 60 end, 6) as m, case when didNotPlay then 0 else fg_made end as made from box")


def _stream_rows(f):
    return f.events.select("ts", ((F.col("event_id") * 7919) % 10 < 6).alias("correct"))


_SLIDES = """
select s as start, s + interval {w} as "end", count(*) as games, round(avg(cast((event_id * 7919) % 10 < 6 as int)), 6) as accuracy
from events, (select unnest(range(0, {n})) as k), lateral (select time_bucket(interval {d}, ts::timestamp, timestamp '1970-01-01') - k * interval {d} as s) group by 1, 2"""
query("k2_trailing_accuracy", lambda f: rounded(streams.stream_accuracy(_stream_rows(f)), "accuracy"), "", _SLIDES.format(w="7 days", d="1 day", n=7))
query("k2_daily_accuracy", lambda f: rounded(streams.stream_accuracy(_stream_rows(f), "1 day", None), "accuracy"), "", _SLIDES.format(w="1 day", d="1 day", n=1))


def _drained(stream, path: str):
    """What a stream has written when it has read all that there is."""
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def _written_games(f, path: str):
    tables.write_table(parse_season(f.games), f"{path}/games", ["season"])
    return f.spark.readStream.schema(parse_season(f.games).schema).parquet(f"{path}/games").drop("season")


def parse_season(games):
    return games.withColumn("season", parse.season_start(F.col("date")))


def _round_trip(f):
    path = shared_folder(f.spark)
    for fmt in ("parquet", "csv"):
        tables.write_table(f.games.select([c.name for c in schemas.GAMES if c.name in f.games.columns]), f"{path}/{fmt}", fmt=fmt)
    kept = [c for c in schemas.GAMES if c.name in f.games.columns]
    a, b = (tables.read_table(f.spark, f"{path}/{fmt}", type(schemas.GAMES)(kept), fmt) for fmt in ("parquet", "csv"))
    return a.intersectAll(b.select(a.columns)).select("game_id", "date", "home_score", "season_type")


def _appended(f):
    path = shared_folder(f.spark)
    for part in ("game_id % 2 = 0", "true"):  # known games are not appended again
        tables.append_predictions(f.pred.where(part).select("game_id", "home_win_prob"), path)
    return f.spark.read.parquet(path)


query("io1_io2_round_trip", _round_trip, "games", "select game_id, date, home_score, season_type from games")
query("io10_append", _appended, "pred", "select game_id, home_win_prob from pred")


def _once(f):
    path = shared_folder(f.spark)
    rows = f.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    rows.unionAll(rows.where("event_id % 3 = 0")).write.parquet(f"{path}/in")
    stream = f.spark.readStream.schema(rows.schema).parquet(f"{path}/in")
    return _drained(streams.stream_games(stream, "3650 days", "event_id"), path).select("event_id")


def _stream_ratings(f):
    path = shared_folder(f.spark)
    out = _drained(streams.stream_ratings(_written_games(f, path)), path)
    return rounded(out.where("not late").select("game_id", "team_id", "rating_before", "rating_after"), "rating_before", "rating_after", digits=4)


def _upserted(f):
    path = shared_folder(f.spark)
    stream = _written_games(f, path).select("game_id", "pool")
    for _ in range(2):
        stream.writeStream.foreachBatch(streams.upsert_predictions(f"{path}/log")).trigger(availableNow=True).start().awaitTermination()
    return f.spark.read.parquet(f"{path}/log")


query("k1_stream_once", _once, "", "select distinct event_id from events")
query("k3_stream_ratings", _stream_ratings, "done", BODIES["r1_team_elo"])
query("k4_upsert", _upserted, "games", "select game_id, pool from games")


_LATE = "date >= '1997-10-01' and game_id % 7 = 0 and pool % 3 = 0"


def _replayed(f):
    """Games in two parts, some with a wrong score, then late ones and corrections."""
    store = replay.RatingStore(f.spark, shared_folder(f.spark))
    wrong = f.games.withColumn("home_score", F.when((F.col("game_id") % 41 == 0) & (F.col("home_score") > 0), F.col("home_score") + 9).otherwise(F.col("home_score")))
    for part in (f"date < '1996-01-01' and not ({_LATE})", f"date >= '1996-01-01' and not ({_LATE})"):
        store.add(wrong.where(part))
    store.add(f.games.where(f"game_id % 41 = 0 or ({_LATE})"))
    return rounded(store.history().select("game_id", "team_id", "rating_before", "rating_after"), "rating_before", "rating_after", digits=4)


def _rated_stream(f):
    """A stream whose files come in no order of dates, in two batches."""
    path = shared_folder(f.spark)
    games = f.games.select("game_id", "pool", "date", "home_team_id", "away_team_id", "home_score", "away_score")
    tables.write_table(games.repartition(24, "game_id"), f"{path}/in")
    stream = f.spark.readStream.schema(games.schema).option("maxFilesPerTrigger", 16).parquet(f"{path}/in")
    stream.writeStream.foreachBatch(streams.rate_games(f"{path}/store")).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    return rounded(replay.RatingStore(f.spark, f"{path}/store").history().select("game_id", "team_id", "rating_after"), "rating_after", digits=4)


def _team_states(f):
    """Ratings up to a day in batch, from there on in a stream that is stopped in between and taken up again."""
    path, key = shared_folder(f.spark), "spark.sql.streaming.stateStore.providerClass"
    early = R.team_elo(f.games.where(F.col("date") <= F.lit(AS_OF)))
    rest = f.games.where(F.col("date") > F.lit(AS_OF)).select("game_id", "pool", "date", "home_team_id", "away_team_id", "home_score", "away_score")
    cut = F.add_months(F.lit(AS_OF), 6)
    held = f.spark.conf.get(key)
    f.spark.conf.set(key, streams.ROCKS)
    try:
        for part_ in (F.col("date") <= cut, F.col("date") > cut):
            rest.where(part_).write.mode("append").parquet(f"{path}/in")
            rows = streams.stream_team_states(f.spark.readStream.schema(rest.schema).parquet(f"{path}/in"), initial=streams.initial_states(early))
            out = _drained(rows, path)
    finally:
        f.spark.conf.set(key, held)
    return rounded(out.where("not late").select("game_id", "team_id", "rating_after"), "rating_after", digits=4)


def _found_pools(f):
    games = pools.find_pools(f.games.drop("pool"))
    return rounded(R.team_elo(games).select("game_id", "team_id", "rating_before", "rating_after"), "rating_before", "rating_after", digits=4)


def _merged(f):
    """Predictions, then outcomes (twice the same batch), then corrections with games that move. Parts of the log are months."""
    path = shared_folder(f.spark)
    p = f.pred.select("game_id", "date", "home_win_prob", F.lit(None).cast("boolean").alias("correct"))
    outcomes = f.pred.where("game_id % 2 = 0").select("game_id", "date", F.lit(None).cast("double").alias("home_win_prob"), "correct")
    moved = p.where("game_id % 10 = 0").withColumn("home_win_prob", F.lit(0.5)).withColumn("date", F.date_add("date", 1))
    for n, batch in ((0, p), (1, outcomes), (1, outcomes), (2, moved)):
        ledger.merge_batch(batch.withColumn("month", F.trunc("date", "month")), path, "plan", n, part="month")
    return f.spark.read.parquet(f"{path}/log").select("game_id", "date", "home_win_prob", "correct")


def _landed(f):
    """Games as JSON lines, some of them broken, in two batches of files; good games and counts of reasons."""
    path = shared_folder(f.spark)
    fields = ["game_id", "date", "home_team_id", "away_team_id", "home_score", "away_score", "season_type"]
    text = lambda c: F.col(c).cast("string").alias(c)
    bad = {"date": F.when(F.col("game_id") % 19 == 0, "soon").otherwise(F.col("date").cast("string")), "away_team_id": F.when(F.col("game_id") % 23 == 0, F.col("home_team_id")).otherwise(F.col("away_team_id"))}
    line = F.to_json(F.struct(*[bad[c].cast("string").alias(c) if c in bad else text(c) for c in fields]))
    f.games.repartition(24, "game_id").select(F.when(F.col("game_id") % 17 == 0, F.substring(line, 1, 30)).otherwise(line)).write.text(f"{path}/in")
    for _ in range(2):
        landing.ingest(f.spark, f"{path}/in", path, 12)
    good = f.spark.read.parquet(f"{path}/games").groupBy("season").agg(F.count("*").alias("n")).select(F.concat(F.lit("season "), "season").alias("what"), "n")
    return good.unionByName(f.spark.read.parquet(f"{path}/quarantine").groupBy("reason").agg(F.count("*").alias("n")).select(F.col("reason").alias("what"), "n"))


def _streamed_accuracy(f):
    """Thirty days, sliding by a day, in a stream: windows come out when the watermark has passed them."""
    path = shared_folder(f.spark)
    _stream_rows(f).withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{path}/in")
    rows = f.spark.readStream.schema("ts timestamp, correct boolean").parquet(f"{path}/in")
    return rounded(_drained(streams.stream_accuracy(rows, "30 days"), path), "accuracy")


query("k3_late_replay", _replayed, "done", BODIES["r1_team_elo"])
query("k3_stream_late", _rated_stream, "done", part("x", "r1_team_elo") + "select game_id, team_id, round(rating_after, 4) as rating_after from x")
query("k3_team_states", _team_states, "done", part("x", "r1_team_elo") + f"select x.game_id, team_id, round(rating_after, 4) as rating_after from x join done d on d.game_id = x.game_id and d.date > date '{AS_OF}'")
query("r1_found_pools", _found_pools, "done", BODIES["r1_team_elo"])
query("k4_merge_log", _merged, "pred", "select game_id, case when game_id % 10 = 0 then date + 1 else date end::date as date, case when game_id % 10 = 0 then 0.5 else home_win_prob end as home_win_prob, case when game_id % 2 = 0 then correct end as correct from pred")
query("io11_file_stream", _landed, "games", """
, g as (select *, case when game_id % 17 = 0 then 'no JSON' when game_id % 19 = 0 then 'bad date' when game_id % 23 = 0 then 'one team' else 'season ' || case when month(date) >= 10 then year(date) else year(date) - 1 end end as what from games)
select what, count(*) as n from g group by 1""")
query("k2_stream_30_days", _streamed_accuracy, "", "select * from (" + _SLIDES.format(w="30 days", d="1 day", n=30) + """) where "end" <= (select max(ts)::timestamp from events) - interval 7 days""")


def _in_place(f):
    """A table by months, some of which come again with other scores."""
    path = shared_folder(f.spark)
    games = f.games.select("game_id", "home_score", F.trunc("date", "month").alias("date"))
    tables.write_table(games.repartition("date"), path, ["date"])
    tables.overwrite_dates(games.where("month(date) = 3 and game_id % 2 = 0").withColumn("home_score", F.col("home_score") + 1), path)
    return f.spark.read.schema(games.schema).parquet(path)


query("s2_in_place", _in_place, "games", """
, g as (select game_id, home_score, cast(date_trunc('month', date) as date) as date from games),
d as (select distinct date from g where month(date) = 3 and game_id % 2 = 0)
select game_id, home_score + case when date in (select date from d) then 1 else 0 end as home_score, date from g where date not in (select date from d) or game_id % 2 = 0""")


def _sketched(f):
    """Players and ratings by season from kept sketches, one season of them added later, against the exact figures."""
    path = shared_folder(f.spark)
    on = f.box.select("player_id", "points", parse.season_start(F.col("date")).alias("season"))
    for part_ in ("season < 1998", "season >= 1998"):
        summaries.keep_sketches(summaries.season_sketches(on.where(part_), F.col("season"), "player_id", "points"), path)
    like = summaries.season_sketches(on, F.col("season"), "player_id", "points")
    got = summaries.merged(summaries.kept_sketches(like, path))
    q = F.col("quantiles")
    ranks = [((F.count_if(F.col("points") < q[k]) / F.count("*") <= r + summaries.KLL_ERROR) & (F.count_if(F.col("points") <= q[k]) / F.count("*") >= r - summaries.KLL_ERROR)).alias(f"q{k}") for k, r in enumerate((0.25, 0.5, 0.75))]
    exact = on.crossJoin(F.broadcast(got)).groupBy("rows", "entities", "quantiles").agg(F.count("*").alias("n"), F.count_distinct("player_id").alias("players"), *ranks)  # one row
    near = F.abs(F.col("entities") - F.col("players")) <= summaries.HLL_ERROR * F.col("players")
    return exact.select("n", "players", (F.col("rows") == F.col("n")).alias("all_rows"), near.alias("players_near"), (F.col("q0") & F.col("q1") & F.col("q2")).alias("quantiles_near"))


query("a15_a17_sketches", _sketched, "box", "select count(*) as n, count(distinct player_id) as players, true as all_rows, true as players_near, true as quantiles_near from box")
