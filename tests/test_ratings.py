"""Properties and worked examples of ratings and features."""

import datetime
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ratingmill.functions import parse
from ratingmill.functions import scores as S
from ratingmill.operators import games as G
from ratingmill.operators import predict as P
from ratingmill.operators import ratings as R
from ratingmill.operators import replay
from ratingmill.operators import windows as W
from ratingmill.sources import feeds, tables
from ratingmill.sources.fixtures import Frames
from ratingmill.streaming import streams

GAMES = "game_id long, pool long, date date, home_team_id long, away_team_id long, home_score long, away_score long, season_type string"


def game(i, day, home, away, hs, as_, pool=0):
    return (i, pool, datetime.date.fromisoformat(day), home, away, hs, as_, "regular")


def history(df):
    return {(r.game_id, r.team_id): r for r in df.collect()}


@pytest.fixture(scope="module")
def frames(spark, sf_dir):
    return Frames(spark, sf_dir)


def test_team_elo_is_zero_sum_and_continuous(frames):
    h = R.team_elo(frames.games).toPandas().sort_values(["date", "game_id"])
    assert abs(h.groupby("game_id")["rating_change"].sum()).max() < 1e-9
    day = h["date"].map(lambda d: d.year - (d.month < 10))
    h["season"] = day
    for _, own in h.groupby(["team_id", "season"]):
        assert (abs(own["rating_after"].shift() - own["rating_before"]).dropna() < 1e-9).all()


def test_team_elo_does_not_depend_on_partitions_or_order(frames):
    one = history(R.team_elo(frames.games.coalesce(1).orderBy("game_id")))
    other = history(R.team_elo(frames.games.repartition(7).orderBy(F.desc("away_score"))))
    assert {k: r.rating_after for k, r in one.items()} == {k: r.rating_after for k, r in other.items()}


def test_ties_zero_scores_and_october(spark):
    rows = [game(1, "1999-09-30", 1, 2, 100, 90), game(2, "1999-10-01", 3, 4, 100, 100), game(3, "1999-10-02", 1, 2, 0, 0), game(4, "1999-10-03", 1, 2, 90, 100)]
    h = history(R.team_elo(spark.createDataFrame(rows, GAMES)))
    assert (3, 1) not in h
    assert h[2, 3].rating_change == 0 and not h[2, 3].won and h[2, 4].won
    assert h[4, 1].rating_before == pytest.approx(0.75 * h[1, 1].rating_after + 375)


def test_increment_equals_rebuild(frames):
    cut = F.lit(datetime.date(1998, 11, 1))
    early, all_ = frames.games.where(F.col("date") <= cut), R.team_elo(frames.games)
    hist = R.team_elo(early)
    seasons = hist.select("pool", (F.year("date") - (F.month("date") < 10).cast("int")).alias("season"))
    new = history(R.team_elo_increment(R.state_of(hist), frames.games.where(F.col("date") > cut), seasons=seasons))
    old = history(all_.where(F.col("date") > cut))
    assert new.keys() == old.keys()
    assert max(abs(new[k].rating_after - old[k].rating_after) for k in new) < 1e-9


def test_player_elo_equals_the_loop(frames):
    box = frames.box
    out = {(r.player_id, r.game_id): r.rating_after for r in R.player_elo(box).collect()}
    rating, seen, last = {}, set(), None
    for r in sorted(box.collect(), key=lambda r: (r.date, r.game_id)):
        if r.date.year != last:
            last = r.date.year
            rating = {p: 1500 + (x - 1500) * 0.67 for p, x in rating.items()}
        if r.minutes > 0 and not r.didNotPlay:
            perf = (max(-30, min(30, r.plus_minus / r.minutes * 48)) + 30) / 60
            rating[r.player_id] = rating.get(r.player_id, 1500) + 20 * min(1, r.minutes / 48) * (perf - 0.5)
            seen.add((r.player_id, r.game_id))
            assert out[r.player_id, r.game_id] == pytest.approx(rating[r.player_id], abs=1e-8)
    assert seen == out.keys()


def test_features_do_not_see_later_games(frames):
    cut = F.lit(datetime.date(1998, 1, 1))
    a = W.team_game_features(frames.long.where(F.col("date") < cut))
    b = W.team_game_features(frames.long).where(F.col("date") < cut)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))


def test_first_game_has_no_history(spark):
    gl = G.to_long(spark.createDataFrame([game(1, "2000-01-01", 1, 2, 100, 90), game(2, "2000-01-02", 2, 1, 80, 90)], GAMES))
    r = {(x.game_id, x.team_id): x for x in W.rest_fatigue(W.rest(W.form(gl))).collect()}
    assert (r[1, 1].rest_days, r[1, 1].rest_category, r[1, 1].fatigue_rest, r[1, 1].form) == (-1, "first_game", 7, 0)
    assert (r[2, 1].rest_days, r[2, 1].rest_penalty, r[2, 1].b2b_penalty, r[2, 1].form) == (0, -46, -50, 50)


def test_one_exchange_for_all_team_features(frames):
    plan = W.team_game_features(frames.long)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(team_id") == 1


def test_hybrid_prediction_has_few_exchanges(spark, frames, tmp_path):
    """One join brings ratings to the team rows, one exchange serves all team windows, one pivot leads back to games."""
    kept = {}
    for name in ("done", "hist", "arenas"):  # without the exchanges of the derived tables
        getattr(frames, name).write.parquet(str(tmp_path / name))
        kept[name] = spark.read.parquet(str(tmp_path / name))
    team = spark.createDataFrame([(1, 1500.0, 0.0)], "team_id long, roster_elo double, injury_adjustment double")
    plan = P.predict_hybrid(kept["done"], kept["hist"], kept["done"], team, team, kept["arenas"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(team_id") == 1
    assert plan.count("Exchange hashpartitioning(") <= 8 and "Cartesian" not in plan


def test_team_windows_of_the_hybrid_share_a_sort(spark, frames):
    """By date for all of a team's windows, and once more by season: each sort holds a task's rows anew."""
    team = spark.createDataFrame([(1, 1500.0, 0.0)], "team_id long, roster_elo double, injury_adjustment double")
    plan = P.predict_hybrid(frames.done, frames.hist, frames.done, team, team, frames.arenas)._jdf.queryExecution().executedPlan().toString()
    sorts = [line for line in plan.splitlines() if "Sort [team_id" in line and ("date" in line or "day" in line)]
    assert len(sorts) == 2


def test_worked_examples(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    for diff, m in ((1, 0.256), (5, 0.662), (15, 1.024), (30, 1.268)):
        assert value(S.mov_multiplier(F.lit(diff))) == pytest.approx(m, abs=1e-3)
    for price, p in ((-110, 0.5238), (150, 0.4), (-200, 0.6667), (200, 0.3333)):
        assert value(S.american_to_probability(F.lit(price))) == pytest.approx(p, abs=1e-4)
    assert value(S.season_calibrated(F.lit(0.7), F.lit(5))) == pytest.approx(0.655)
    assert value(S.toss_up(F.lit(0.6), F.lit(0))) == 0.5
    assert value(S.market_blend(F.lit(0.558), F.lit(0.524), F.lit(0.476))["blended"]) == pytest.approx(0.5529)
    assert value(S.parlay(F.array(F.lit(0.5), F.lit(0.4)))) == pytest.approx(0.2)
    assert [value(S.score_split(F.lit(d))[0]) for d in (0.0, -5000.0)] == [116, 70]
    for name, key in (("Nikola Jokić", "nikola jokic"), ("Luka  Dončić ", "luka doncic"), ("O'Neal, Jr.", "oneal jr")):
        assert value(parse.normalize_name(F.lit(name))) == key
    for text, m in (("34:30", 34.5), ("12", 12), ("--", 0), ("", 0)):
        assert value(parse.minutes(F.lit(text))) == m
    for text, pair in (("6-18", (6, 18)), ("--", (0, 0)), ("x", (0, 0))):
        assert tuple(value(c) for c in parse.made_attempted(F.lit(text))) == pair
    assert [value(c) for c in parse.matchup_teams(F.lit("BOS @ NYK"))] == ["NYK", "BOS"]


def test_welo_example(spark):
    days = ["2000-01-01", "2000-01-03", "2000-01-05", "2000-01-07"]
    rows = [game(i + 1, d, 1, 10 + i, 100, s) for i, (d, s) in enumerate(zip(days, (90, 90, 110, 90), strict=True))]
    rows.append(game(9, "2000-01-09", 1, 20, 100, 90))
    opponents = [(i + 1, 10 + i, float(x)) for i, x in enumerate((1500, 1600, 1400, 1700))]
    ratings = spark.createDataFrame(opponents, "game_id long, team_id long, rating_before double")
    out = W.welo(G.to_long(spark.createDataFrame(rows, GAMES)), ratings).where("game_id = 9 and team_id = 1").first()
    assert out.welo_score == pytest.approx(0.5314, abs=1e-4) and out.welo == pytest.approx(15.94, abs=1e-2) and out.welo_record == "3-1"


def test_star_injury(spark):
    roster = spark.createDataFrame([(i, 1, f"P{i}") for i in range(10)], "player_id long, team_id long, player_name string")
    ratings = spark.createDataFrame([(0, 2050.0)] + [(i, 1550.0) for i in range(1, 10)], "player_id long, rating double")
    hurt = spark.createDataFrame([("P0",), ("nobody",)], "player_name string")
    r = R.injury_adjustment(roster, ratings, hurt).first()
    assert (r.injury_adjustment, r.stars_out, r.bench_out) == (-67.5, 1, 0)


def test_edge_feeds(spark):
    raw = spark.createDataFrame([('{"events": [{"id": "1", "date": "2000-01-02T00:00Z", "competitors": [{"homeAway": "home", "team": {"id": "7"}, "score": null}]}]}',), ("not json",)], "value string")
    assert feeds.parse_scoreboard(raw).count() == 0
    odds = spark.createDataFrame([('{"id": "1", "bookmakers": [{"key": "b", "markets": [{"key": "totals", "outcomes": []}]}]}',)], "value string")
    assert feeds.parse_odds(odds).count() == 0


def test_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(1, 0.5), (2, 0.6)], "game_id long, p double")
    for _ in range(2):
        tables.append_predictions(rows, path)
    assert spark.read.parquet(path).count() == 2


def test_streams(spark, frames, tmp_path):
    frames.games.where("date < '1998-01-01'").coalesce(1).write.parquet(str(tmp_path / "in"))
    frames.games.where("date >= '1998-01-01'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.games.schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in"))
    q = streams.stream_ratings(stream).writeStream.format("memory").queryName("rated").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    a, b = history(spark.table("rated").where("not late")), history(R.team_elo(frames.games))
    assert a.keys() == b.keys() and all(math.isclose(a[k].rating_after, b[k].rating_after) for k in a)

    events = str(tmp_path / "events")
    rows = spark.createDataFrame([(1, "2000-01-01 00:00:00"), (1, "2000-01-01 01:00:00"), (2, "2000-01-02 00:00:00")], "game_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(events)
    q = streams.stream_games(spark.readStream.schema(rows.schema).parquet(events)).writeStream.format("memory").queryName("once").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == 2
    log = str(tmp_path / "log")
    for _ in range(2):
        q = spark.readStream.schema(rows.schema).parquet(events).dropDuplicates(["game_id"]).writeStream.foreachBatch(streams.upsert_predictions(log)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.read.parquet(log).count() == 2


def test_stream_folds_slices_as_one():
    """A pool's batch is held as plain numbers; history rows are made of slices, with the ratings of one fold over all."""
    rows = [(k * 7 % 100, 0, datetime.date(2000, 9, 1) + datetime.timedelta(days=k * 7 % 100), k % 5, k % 5 + 1, 80 + k % 9, 84) for k in range(100)]
    games = pd.DataFrame(rows, columns=["game_id", "pool", "date", "home_team_id", "away_team_id", "home_score", "away_score"])
    held = R.held_in_order(iter([games.iloc[:30], games.iloc[30:]]))
    assert not [c for c in held if held[c].dtype == object] and held["game_id"].tolist() == list(range(100))
    parts, fold = list(R.some_at_a_time(held, 32)), replay.Rating().fold()
    assert [len(p) for p in parts] == [32, 32, 32, 4]
    got = pd.concat([R._fold_games(fold, p) for p in parts])
    want = R._fold_games(replay.Rating().fold(), games)
    by = ["game_id", "team_id"]
    pd.testing.assert_frame_equal(got.sort_values(by).reset_index(drop=True), want.sort_values(by).reset_index(drop=True))


def test_stream_gives_late_games(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [game(1, "2000-01-01", 1, 2, 100, 90), game(2, "2000-01-05", 1, 2, 90, 100)]
    spark.createDataFrame(rows, GAMES).coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(spark.createDataFrame([], GAMES).schema).parquet(path)
    q = streams.stream_ratings(stream).writeStream.format("memory").queryName("tardy").outputMode("append").start()
    q.processAllAvailable()
    spark.createDataFrame([game(3, "2000-01-05", 1, 2, 99, 98), game(4, "2000-01-06", 1, 2, 99, 98)], GAMES).coalesce(1).write.mode("append").parquet(path)
    q.processAllAvailable()
    q.stop()
    out = spark.table("tardy").collect()
    assert {r.game_id for r in out if r.late} == {3} and all(r.rating_after is None or math.isnan(r.rating_after) for r in out if r.late)
    kept = spark.createDataFrame([*rows, game(4, "2000-01-06", 1, 2, 99, 98)], GAMES)
    want = {(r.game_id, r.team_id): r.rating_after for r in R.team_elo(kept).collect()}
    assert {(r.game_id, r.team_id): pytest.approx(r.rating_after) for r in out if not r.late} == want
