"""Streaming jobs equal the batch answer on the same rows."""

import pytest
from pyspark.sql import functions as F

from arenalake.operators import history as H
from arenalake.streaming import jobs


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events"))
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "ts", "user_id", "event_type", "value")
    rows.unionByName(rows.limit(50)).repartition(3).write.mode("overwrite").parquet(path)
    return path


def collect(stream, tmp_path, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def test_deduplicated_stream(spark, source, tmp_path):
    out = collect(jobs.deduplicated(jobs.read_events(spark, source, 10), "60 days"), tmp_path, "dedup")
    assert out.count() == out.select("event_id").distinct().count() == spark.read.parquet(source).select("event_id").distinct().count()


@pytest.mark.parametrize("job", [jobs.latest_per_minute, jobs.rolling_activity, jobs.sessions])
def test_windowed_stream_equals_batch(spark, source, tmp_path, job):
    mode = "append" if job is jobs.sessions else "complete"
    live = collect(job(jobs.read_events(spark, source, 10)), tmp_path, job.__name__, mode)
    batch = job(spark.read.schema(jobs.SCHEMA).parquet(source))
    rows = lambda df: {tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()}
    got, want = rows(live), rows(batch)
    assert got <= want if mode == "append" else got == want
    assert len(got) > len(want) // 2


def test_refresh_writes_serving_table(spark, source, tmp_path):
    seen = []
    jobs.refresh(jobs.within_lookback(jobs.read_events(spark, source, 1), "2024-02-01", 20), str(tmp_path / "c"), lambda batch, i: seen.append(batch.count()))
    want = spark.read.parquet(source).where("ts >= timestamp'2024-02-01' - interval 20 days").count()
    assert len(seen) >= 3 and sum(seen) == want


def test_online_ratings_equal_the_fold(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [("p", f"g{i:02d}", f"2024-01-{1 + i // 3:02d}", "abc"[i % 3], "abc"[(i + 1) % 3], i % 2, 0.1 * (i % 4)) for i in range(24)]
    df = spark.createDataFrame(rows, "pool string, game_id string, day string, team1_key string, team2_key string, team1_win int, margin double").withColumn("ts", F.to_timestamp("day"))
    path = str(tmp_path / "games")
    df.coalesce(1).write.parquet(path)
    live = collect(jobs.online_ratings(spark.readStream.schema(df.schema).parquet(path)), tmp_path, "ratings", "append")
    fold = H.elo(df.withColumn("event_date", F.to_date("day")), "pool")
    rows = lambda x: {r.game_id: (round(r.team1_rating, 6), round(r.team2_rating, 6)) for r in x.collect()}
    assert rows(live) == rows(fold) and len(rows(live)) == 24


def landed_games(spark, n=400):
    """Games of two pools over 40 days, some without a result, day 20 with a quarter of them."""
    i = F.col("id")
    day = F.when(i % 4 == 0, 20).otherwise((i * 7 % 40).cast("int"))
    return spark.range(n).select(F.concat(F.lit("p"), i % 2).alias("league_code"), F.format_string("g%04d", i).alias("game_id"), (F.lit("2024-01-01").cast("date") + day.cast("int")).alias("event_date"), F.concat(F.lit("t"), i * 5 % 11).alias("team1_key"), F.concat(F.lit("t"), 20 + i * 3 % 7).alias("team2_key"), F.when(i % 17 != 0, (i * 13 % 5 < 2).cast("int")).alias("team1_win"), (i % 4 / 10).alias("margin"))


def by_game(df):
    return {r.game_id: (r.pool, round(r.team1_rating, 6), round(r.team2_rating, 6)) for r in df.collect()}


def plain_ratings(rows):
    rating, out = {}, {}
    for day in sorted({r.event_date for r in rows}):
        moves = []
        for r in (r for r in rows if r.event_date == day):
            a, b = (r.league_code, r.team1_key), (r.league_code, r.team2_key)
            ra, rb = rating.get(a, 1500.0), rating.get(b, 1500.0)
            out[r.game_id] = (r.league_code, round(ra, 6), round(rb, 6))
            if r.team1_win is not None:
                moves.append((a, b, 32 * (1 + r.margin) * (r.team1_win - 1 / (1 + 10 ** ((rb - ra) / 400)))))
        for a, b, d in moves:
            rating[a], rating[b] = rating.get(a, 1500.0) + d, rating.get(b, 1500.0) - d
    return out


def test_ratings_by_period_equal_the_recurrence(spark):
    games = landed_games(spark)
    want = plain_ratings(games.collect())
    assert by_game(H.elo(games)) == want
    per_day = games.groupBy("league_code", "event_date").count().agg(F.max("count")).first()[0]
    for most in (60, 12):  # several periods; day 20 is wider than a period
        spans = H.periods([(r.event_date, r.n) for r in games.groupBy("event_date", "league_code").count().groupBy("event_date").agg(F.max("count").alias("n")).orderBy("event_date").collect()], most)
        assert len(spans) > 3 and any(wide for *_, wide in spans) == (per_day > most)
        assert by_game(H.elo(games, most=most)) == want
    assert H.elo(games.limit(0)).count() == 0


def test_landed_games_are_rated_once_and_late_ones_are_told(spark, tmp_path):
    games = H.rating_games(landed_games(spark))
    want = plain_ratings(landed_games(spark).collect())
    root = str(tmp_path)
    source = lambda: spark.readStream.schema(games.schema).parquet(f"{root}/landed")
    for a, b in (("2024-01-01", "2024-01-12"), ("2024-01-13", "2024-01-21"), ("2024-01-22", "2024-02-20")):
        games.where(F.col("event_date").between(a, b)).write.mode("append").parquet(f"{root}/landed")
        jobs.rate_landed(source(), f"{root}/rated")
        jobs.rate_landed(source(), f"{root}/rated")  # nothing new
    assert by_game(jobs.landed_ratings(spark, f"{root}/rated")) == want
    games.where("game_id < 'g0010'").withColumn("game_id", F.concat(F.lit("late"), "game_id")).write.mode("append").parquet(f"{root}/landed")
    jobs.rate_landed(source(), f"{root}/rated")
    assert by_game(jobs.landed_ratings(spark, f"{root}/rated")) == want
    assert spark.read.option("recursiveFileLookup", True).parquet(f"{root}/rated/late").count() == 10
