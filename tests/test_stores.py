"""Stored tables that later data changes: ratings with late games, the prediction log, landed files, dated rosters."""

import os
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratingmill.operators import games as G
from ratingmill.operators import pools, replay
from ratingmill.operators import ratings as R
from ratingmill.operators import summaries as U
from ratingmill.operators.rosters import figures, roster_figures
from ratingmill.sources import landing, ledger, tables
from ratingmill.streaming import streams

DAY = date(2000, 1, 31)
GAMES = "game_id long, pool long, date date, home_team_id long, away_team_id long, home_score long, away_score long"


def files(path):
    """Data files and their times."""
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def league(pools_=2, seasons=3, days=8):
    rows = []
    for p in range(pools_):
        for s in range(seasons):
            for k in range(days):
                n = len(rows)
                home, away = p * 10 + k % 4, p * 10 + (k + 1 + s) % 4
                if home != away:
                    rows.append((n, p, date(1998 + s, 11, 1) + timedelta(9 * k), home, away, 90 + n * 7 % 31, 90 + n * 11 % 29))
    return rows


def same_ratings(store, spark, rows):
    want = {(r.game_id, r.team_id): r.rating_after for r in R.team_elo(spark.createDataFrame(rows, GAMES)).collect()}
    got = store.history().collect()
    assert len(got) == len(want) and {(r.game_id, r.team_id): pytest.approx(r.rating_after) for r in got} == want


def test_late_games_are_replayed(spark, tmp_path, monkeypatch):
    rows = league()
    late = [r for r in rows if r[1] == 1 and r[2] >= date(2000, 10, 1)][:2]
    store = replay.RatingStore(spark, str(tmp_path / "store"))
    add = lambda own: store.add(spark.createDataFrame(own, GAMES))
    add([r for r in rows if r not in late])
    before = files(tmp_path / "store" / "history")
    since = spark.createDataFrame([(1, 2000)], "pool long, season long")
    plan = store.suffix(since)._jdf.queryExecution().executedPlan().toString()
    assert "season" in plan.split("PartitionFilters: [")[1].split("]")[0] and ">= 2000" in plan
    real, calls = replay.replace_partitions, []

    def fails(df, path, by):
        if path.endswith("history") and not calls:
            calls.append(path)
            raise OSError("lost")
        real(df, path, by)

    monkeypatch.setattr(replay, "replace_partitions", fails)
    with pytest.raises(OSError, match="lost"):
        add(late)  # states are written, the history isn't
    add(late)
    same_ratings(store, spark, rows)
    after = files(tmp_path / "store" / "history")
    changed = {f for f in before.keys() | after.keys() if before.get(f) != after.get(f)}
    assert changed and all("pool=1/season=2000" in f for f in changed)
    add(late)  # known games change nothing
    assert files(tmp_path / "store" / "history") == after
    corrected = [(*late[0][:5], 150, 80)]
    add(corrected)
    same_ratings(store, spark, [corrected[0] if r[0] == late[0][0] else r for r in rows])


def test_states_carry_teams_that_sit_out(spark, tmp_path):
    rows = [(1, 0, date(1998, 11, 1), 1, 2, 120, 90), (2, 0, date(1999, 11, 1), 3, 2, 99, 91), (3, 0, date(2000, 11, 1), 1, 3, 100, 80)]
    store = replay.RatingStore(spark, str(tmp_path))
    for r in rows:
        store.add(spark.createDataFrame([r], GAMES))
    same_ratings(store, spark, rows)
    assert {(r.season, r.team_id) for r in store.states().collect()} == {(1998, 1), (1998, 2), (1999, 1), (1999, 2), (1999, 3), (2000, 1), (2000, 2), (2000, 3)}


def test_pools_are_found(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (102, 101), (103, 104)]
    games = spark.createDataFrame([(n, a, b) for n, (a, b) in enumerate(edges)], "game_id long, home_team_id long, away_team_id long")
    found = {r.team_id: r.pool for r in pools.team_pools(games).collect()}
    assert found == {**dict.fromkeys(range(1, 41), 1), 100: 100, 101: 100, 102: 100, 103: 103, 104: 103}
    assert pools.find_pools(games).where("game_id = 41").first().pool == 103
    assert pools.team_pools(games.limit(0)).count() == 0


LOG = "game_id long, date date, home_win_prob double, correct boolean"


def test_log_takes_outcomes_and_corrections_once(spark, tmp_path):
    path = str(tmp_path)
    merge = lambda rows, n: ledger.merge_batch(spark.createDataFrame(rows, LOG), path, "w", n)
    log = lambda: {r.game_id: tuple(r) for r in spark.read.schema(LOG).parquet(f"{path}/log").select("game_id", "date", "home_win_prob", "correct").collect()}
    days = [DAY + timedelta(k) for k in range(4)]
    assert merge([(k, days[k % 3], 0.6, None) for k in range(6)], 0)
    before = files(f"{path}/log")
    assert merge([(1, days[1], None, True), (1, days[1], None, None), (9, days[1], 0.7, None)], 1)
    assert log()[1] == (1, days[1], 0.6, True) and log()[9] == (9, days[1], 0.7, None) and log()[2] == (2, days[2], 0.6, None)
    kept = files(f"{path}/log")
    assert {f for f in before if before[f] == kept.get(f)} == {f for f in before if f"date={days[1]}" not in f}
    assert not merge([(1, days[1], 0.1, False)], 1)  # a batch that comes again
    assert files(f"{path}/log") == kept
    assert merge([(0, days[3], None, None), (3, days[3], None, None)], 2)  # all games of a date move
    assert log()[0] == (0, days[3], 0.6, None) and len(log()) == 7 and not any(f"date={days[0]}" in f for f in files(f"{path}/log"))
    assert ledger.merge_batch(spark.createDataFrame([(1, None, 0.2, None)], LOG), path, "other", 1) and log()[1] == (1, days[1], 0.2, True)


def test_landed_files_and_quarantine(spark, tmp_path):
    good = '{"game_id": "1", "date": "20000131", "home_team_id": 5, "away_team_id": "6", "home_score": "90", "away_score": "80", "extra": 1}'
    bad = [
        ('{"game_id": "2", "date"', "no JSON"),
        (good.replace('"1"', '"x"'), "bad game_id"),
        (good.replace("20000131", "soon"), "bad date"),
        (good.replace('"80"', "null"), "bad away_score"),
        (good.replace('"80"', '"-3"'), "negative score"),
        (good.replace('"6"', '"5"'), "one team"),
        ("{}", "bad game_id"),
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join([good, *[line for line, _ in bad]]))
    out = str(tmp_path / "out")
    assert landing.ingest(spark, str(tmp_path / "in"), out) == 8
    game = spark.read.parquet(f"{out}/games").first()
    assert (game.game_id, game.date, game.season, game.season_type, game.away_score) == (1, DAY, 1999, "regular", 80)
    held = spark.read.parquet(f"{out}/quarantine").collect()
    assert sorted(r.reason for r in held) == sorted(reason for _, reason in bad)
    assert '{"game_id": "2", "date"' in {r.line for r in held}
    before = files(out)
    assert landing.ingest(spark, str(tmp_path / "in"), out) == 0 and files(out) == before
    (tmp_path / "in" / "b.json").write_text(good.replace('"1"', '"7"'))
    assert landing.ingest(spark, str(tmp_path / "in"), out) == 1 and spark.read.parquet(f"{out}/games").count() == 2
    again = spark.createDataFrame([("7", "2000-01-31", "1", "2", "3", "4", None, None)], landing.LINE)
    landing.land_games(out)(again, 1)  # a batch that is repeated writes over itself
    assert spark.read.parquet(f"{out}/games").count() == 2


def test_dates_are_written_over_in_place(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(k, DAY + timedelta(k % 3), k) for k in range(9)], "game_id long, date date, home_score int")
    tables.write_table(df.repartition("date"), path, ["date"])
    before = files(path)
    tables.overwrite_dates(spark.createDataFrame([(50, DAY, 1)], df.schema), path)
    after = files(path)
    assert {f: t for f, t in before.items() if f"date={DAY}" not in f}.items() <= after.items()
    assert sorted(r.game_id for r in spark.read.schema(df.schema).parquet(path).collect()) == [1, 2, 4, 5, 7, 8, 50]


def test_names_that_contain_each_other(spark):
    names = ["Los Angeles Lakers", "lakers", "LA", "l", "", None, "Utah Jazz", "Jazz of Utah", "aaa", "aaaa", "é", "Café"]
    a, b = spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(n,) for n in [*names, "The LAKERS", "xyz"]], "other string")
    found = G.containing_names(a, b)
    got = sorted(tuple(r) for r in found.collect())
    known = [n for n in names if n is not None]
    want = sorted((x, y) for x in known for y in [*known, "The LAKERS", "xyz"] if x.lower() in y.lower() or y.lower() in x.lower())
    assert got == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_roster_figures_know_no_later_game(spark):
    """Player 1 moves from team 7 to 8 with its game of the third day; player 2 is away for two days."""
    d = [DAY + timedelta(k) for k in range(6)]
    rated = [(1, 7, d[0], 1, 1700.0), (2, 7, d[0], 1, 1500.0), (1, 8, d[2], 3, 1710.0), (2, 7, d[3], 4, 1520.0), (3, 8, d[0], 1, 1400.0)]
    ratings = spark.createDataFrame(rated, "player_id long, team_id long, date date, game_id long, rating_after double")
    absences = spark.createDataFrame([(2, 7, d[1], d[3]), (3, 8, d[5], None)], "player_id long, team_id long, start_date date, end_date date")
    games = spark.createDataFrame([(k + 1, day, 7, 8) for k, day in enumerate(d)], "game_id long, date date, home_team_id long, away_team_id long")
    out = {(r.game_id, r.team_id): (r.roster_elo, r.injury_adjustment) for r in roster_figures(games, ratings, absences).collect()}
    assert out[1, 7] == out[1, 8] == (1500.0, 0.0)  # nobody has played yet
    assert out[2, 7] == (1700.0, pytest.approx(10 * 1.5))  # player 2 is away; below the mean of 1600, so that it gains
    assert out[3, 7] == out[2, 7] and out[3, 8] == (1400.0, 0.0)  # the move shows after the game
    assert out[4, 7] == (1500.0, 0.0) and out[4, 8] == (pytest.approx((1710 + 0.95 * 1400) / 1.95), 0.0)
    assert out[5, 7] == (1520.0, 0.0)
    assert out[6, 8] == (1710.0, pytest.approx(155 / 10 * 1.5))


def test_figures():
    ranked = [(1800.0, False), (1700.0, True), (1600.0, False)]
    assert figures(ranked, 10) == (pytest.approx((1800 + 0.95 * 1600) / 1.95), 0.0)
    assert figures([(2400.0, True)] + [(1400.0, False)] * 9, 10)[1] == pytest.approx(-80)
    assert figures([], 10) == (1500.0, 0.0)


def test_summaries_add_up(spark, tmp_path):
    rows = [(DAY + timedelta(k % 7), float(k * 37 % 101), float(k * 11 % 53) if k % 9 else None, k % 7) for k in range(200)]
    df = spark.createDataFrame(rows, "date date, a double, b double, part int")
    old, new = (U.daily_moments(df.where(on), "a", "b") for on in ("part < 3", "part >= 2"))
    whole = U.fit_moments(U.add_moments(old, U.daily_moments(df.where("part >= 3"), "a", "b")), U.before(DAY + timedelta(4))).first()
    on = [(a, b) for d, a, b, _ in rows if b is not None and d < DAY + timedelta(4)]
    off = [(a, b) for d, a, b, _ in rows if b is not None and d >= DAY + timedelta(4)]
    slope, intercept = np.polyfit(*zip(*on, strict=True), 1)
    share = lambda x: 1 - sum((b - slope * a - intercept) ** 2 for a, b in x) / (np.var([b for _, b in x]) * len(x))
    assert (whole.slope, whole.intercept, whole.train_r2, whole.holdout_r2) == tuple(pytest.approx(v) for v in (slope, intercept, share(on), share(off)))
    assert (whole.train_n, whole.holdout_n) == (len(on), len(off)) and new.count() == 5
    flat = U.fit_moments(U.daily_moments(df.withColumn("a", F.lit(1.0)), "a", "b"), U.before(DAY)).first()
    assert flat.slope is None and flat.train_n == 0


def test_new_seasons_leave_other_sketches_alone(spark, tmp_path):
    path = str(tmp_path / "s")
    df = spark.createDataFrame([(1990 + k % 4, k % 700, float(k % 50)) for k in range(4000)], "season int, player long, points double")
    make = lambda on: U.season_sketches(df.where(on), F.col("season"), "player", "points")
    U.keep_sketches(make("season < 1993"), path)
    before = files(path)
    U.keep_sketches(make("season = 1993"), path)
    assert before.items() <= files(path).items()
    got = U.merged(U.kept_sketches(make("true"), path)).first()
    assert got.rows == 4000 and abs(got.entities - 700) <= U.HLL_ERROR * 700 and all(abs(q - w) <= 50 * U.KLL_ERROR + 1 for q, w in zip(got.quantiles, (12, 25, 37), strict=True))


def test_team_states_take_up_a_stream(spark, tmp_path):
    """A stream that is stopped and taken up again; a game that comes late has no rating and changes none."""
    rows = league(1)
    late, rows = rows[5], [r for r in rows if r != rows[5]]
    key = "spark.sql.streaming.stateStore.providerClass"
    held = spark.conf.get(key)
    spark.conf.set(key, streams.ROCKS)
    try:
        for n, part in enumerate((rows[:12], [*rows[12:], late])):
            spark.createDataFrame(part, GAMES).write.parquet(f"{tmp_path}/in/{n}")
            stream = spark.readStream.schema(GAMES).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
            streams.stream_team_states(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, held)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    want = {(r.game_id, r.team_id): r.rating_after for r in R.team_elo(spark.createDataFrame(rows, GAMES)).collect()}
    assert {(r.game_id, r.team_id): pytest.approx(r.rating_after) for r in got if not r.late} == want
    assert {r.game_id for r in got if r.late} == {late[0]} and all(r.rating_after is None for r in got if r.late)


def test_streams_land_in_many_files(spark, sf_dir, tmp_path, monkeypatch):
    """No task writes or reads all games that a stream takes in."""
    from ratingmill.plans import feeds as plans
    from ratingmill.sources.fixtures import Frames

    for run, reader in ((plans._rated_stream, spark.read.parquet), (plans._landed, spark.read.text)):
        path = str(tmp_path / run.__name__)
        monkeypatch.setattr(plans, "shared_folder", lambda _, path=path: path)
        run(Frames(spark, sf_dir))
        sizes = [r["count"] for r in reader(f"{path}/in").groupBy(F.input_file_name()).count().collect()]
        assert max(sizes) * 8 < sum(sizes)
