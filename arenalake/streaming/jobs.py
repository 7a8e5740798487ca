"""Structured Streaming jobs over an event stream (event_id, ts, user_id, event_type, value)."""

from __future__ import annotations

import threading
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from arenalake.operators import history as H
from arenalake.sources import files

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def read_events(spark: SparkSession, path: str, files_per_batch: int = 1, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", pattern).parquet(path)


def to_table(stream: DataFrame, path: str) -> DataFrame:
    """Run an append-mode stream over what is there into Parquet under path, and read that back."""
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def deduplicated(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First event of each id, among those within the watermark's delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def _watermarked(events: DataFrame, delay: str | None) -> DataFrame:
    return events if delay is None else events.withWatermark("ts", delay)


def in_time(events: DataFrame, delay: str) -> DataFrame:
    """Events that the watermark still takes, each id once: what counted() reports as late is dropped here, row by row.

    The windowed jobs below follow it with delay=None, and then drop nothing more.
    """
    return deduplicated(events, delay)


def latest_per_minute(events: DataFrame, delay: str | None = "10 minutes") -> DataFrame:
    """Last value per user and minute of event time."""
    last = F.max_by("value", F.struct("ts", "event_id"))
    return _watermarked(events, delay).groupBy(F.window("ts", "1 minute"), "user_id").agg(last.alias("last_value"), F.count("*").alias("n"))


def rolling_activity(events: DataFrame, span: str = "7 days", step: str = "1 day", delay: str | None = "1 day") -> DataFrame:
    """Events and value per type over sliding windows."""
    return _watermarked(events, delay).groupBy(F.window("ts", span, step), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str | None = "1 hour") -> DataFrame:
    """Sessions of users, ended by a gap."""
    return _watermarked(events, delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


FRAMES = "game_id string, fetched_at timestamp, frames array<struct<ts:timestamp,blue_gold:bigint,red_gold:bigint,blue_kills:bigint,red_kills:bigint>>"


def live_frames(documents: DataFrame) -> DataFrame:
    """Frames of live-stat documents (FRAMES): game_id, fetched_at, and the frame's columns."""
    return documents.select("game_id", "fetched_at", F.explode("frames").alias("f")).select("game_id", "fetched_at", "f.*")


def live_difference(frames: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Gold and kill difference of the sides per game and minute of event time, by the minute's last frame.

    A frame that is sent again, as long as the watermark takes it, replaces what was fetched before.
    """
    last = F.max_by(F.struct("blue_gold", "red_gold", "blue_kills", "red_kills"), F.struct("ts", "fetched_at"))
    per = frames.withWatermark("ts", delay).groupBy(F.window("ts", "1 minute"), "game_id").agg(last.alias("f"), F.count("*").alias("frames"))
    return per.select("game_id", "window", "frames", (F.col("f.blue_gold") - F.col("f.red_gold")).alias("gold_diff"), (F.col("f.blue_kills") - F.col("f.red_kills")).alias("kill_diff"))


class _Late(StreamingQueryListener):
    """Rows that the watermark dropped, per run of a query, over all its progress reports."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.ended: dict[str, threading.Event] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        run = str(event.progress.runId)
        self.rows[run] = self.rows.get(run, 0) + sum(o.numRowsDroppedByWatermark for o in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.setdefault(str(event.runId), threading.Event()).set()


def counted(stream: DataFrame, path: str) -> tuple[DataFrame, int]:
    """to_table(), and how many rows the watermark dropped as late, as the progress reports tell.

    Exact where the first stateful step takes rows one by one, as in_time() does; an aggregation
    reports groups that were formed before it.
    """
    spark, late = stream.sparkSession, _Late()
    spark.streams.addListener(late)
    try:
        query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        run = str(query.runId)
        if not late.ended.setdefault(run, threading.Event()).wait(60):  # reports come after the fact
            raise TimeoutError("the stream's last report did not arrive")
    finally:
        spark.streams.removeListener(late)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows"), late.rows.get(run, 0)


def within_lookback(events: DataFrame, now: str, days: int) -> DataFrame:
    """Late-data rule: the watermark is the lookback, and rows older than the cutoff go."""
    cutoff = F.lit(now).cast("timestamp") - F.make_dt_interval(days=F.lit(days))
    return events.withWatermark("ts", f"{days} days").where(F.col("ts") >= cutoff)


def refresh(source: DataFrame, checkpoint: str, write, mode: str = "append") -> None:
    """Run what is there through write(batch, id), then stop: serving tables by foreachBatch."""
    query = source.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


class RatingState(StatefulProcessor):
    """Ratings of one pool, kept as a map state: each game moves both sides.

    Games of one batch are taken in time order; ratings live in state between batches.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ratings = handle.getMapState("ratings", "team string", "rating double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        games = pd.concat(list(rows)).sort_values(["ts", "game_id"])
        read = lambda k: self.ratings.getValue((k,))[0] if self.ratings.containsKey((k,)) else 1500.0
        out = []
        for _, day in games.groupby("ts", sort=True):  # games of one time read the ratings before it
            known = {k: read(k) for k in {*day["team1_key"], *day["team2_key"]}}
            moved = dict(known)
            for g in day.itertuples(index=False):
                ra, rb = known[g.team1_key], known[g.team2_key]
                delta = 32.0 * (1 + g.margin) * (g.team1_win - 1 / (1 + 10 ** ((rb - ra) / 400)))
                moved[g.team1_key] += delta
                moved[g.team2_key] -= delta
                out.append((key[0], g.game_id, ra, rb))
            for k, v in moved.items():
                self.ratings.updateValue((k,), (v,))
        yield pd.DataFrame(out, columns=["pool", "game_id", "team1_rating", "team2_rating"])

    def close(self) -> None:
        pass


def online_ratings(games: DataFrame) -> DataFrame:
    """Ratings before each game of a stream (pool, game_id, ts, team1_key, team2_key, team1_win, margin)."""
    return games.groupBy("pool").transformWithStateInPandas(
        RatingState(), "pool string, game_id string, team1_rating double, team2_rating double", "append", "none"
    )


def rate_landed(games: DataFrame, root: str) -> None:
    """Rates what has landed since the last run: a stream of rating_games() columns, each batch a period.

    Under root lie games/<batch> (games with the ratings before them), ratings/<batch> (one row per team
    after it), late/<batch> (games of days that were rated already: they move nothing) and the stream's
    checkpoint. A batch reads the ratings of the batch before it and replaces its own folders, so one that is repeated
    after a crash gives the same. A task holds one pool's games of the batch; a batch of one day
    with more than GAMES_AT_ONCE of them is rated by joins and sums.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        earlier = [n for n in (int(f) for f in files.folders(spark, f"{root}/ratings")) if n < number]
        ratings = spark.read.schema("pool string, team_key string, rating double, last_day date").parquet(f"{root}/ratings/{max(earlier)}") if earlier else None
        done = ratings.agg(F.max("last_day")).first()[0] if ratings is not None else None
        rows = files.materialise(batch, "landed")
        late = F.lit(False) if done is None else F.col("event_date") <= F.lit(done)
        rows.where(late).write.mode("overwrite").parquet(f"{root}/late/{number}")
        fresh = rows.where(~late)
        about = fresh.groupBy("pool").agg(F.count("*").alias("n"), F.min("event_date").alias("a"), F.max("event_date").alias("b")).agg(F.max("n").alias("n"), F.min("a").alias("a"), F.max("b").alias("b")).first()
        wide = about["n"] is not None and about["n"] > H.GAMES_AT_ONCE and about["a"] == about["b"]
        known = None if ratings is None else ratings.drop("last_day")
        H.rate_period(fresh, known, wide).write.mode("overwrite").parquet(f"{root}/games/{number}")
        after = H.carried(known, spark.read.parquet(f"{root}/games/{number}"))
        after.withColumn("last_day", F.lit(about["b"] or done).cast("date")).write.mode("overwrite").parquet(f"{root}/ratings/{number}")

    refresh(games, f"{root}/checkpoint", write)


def landed_ratings(spark: SparkSession, root: str) -> DataFrame:
    """All games rated so far: game_id, pool, both ratings, expected share."""
    rows = spark.read.option("recursiveFileLookup", True).parquet(f"{root}/games")
    return rows.where("game_id is not null").select("game_id", "pool", "team1_rating", "team2_rating", "team1_expected")
