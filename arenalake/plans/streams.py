"""Queries: the streaming jobs' transformations in batch mode, and reads of written tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from arenalake.plans.registry import query
from arenalake.sources import files
from arenalake.sources.standin import table
from arenalake.streaming import jobs


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


@query("SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS minute, user_id, arg_max(value, (ts, event_id)) AS last_value, count(*) AS n FROM events GROUP BY 1, 2")
def live_latest_per_minute(spark, sf_dir):
    return jobs.latest_per_minute(events(spark, sf_dir)).select(F.col("window.start").alias("minute"), "user_id", "last_value", "n")


@query("""WITH d AS (SELECT *, unnest(range(7)) AS k FROM events) SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) - CAST(k AS INT) * INTERVAL 1 DAY AS start, event_type, count(*) AS n, floor(sum(value) * 100 + 0.5) / 100 AS total FROM d GROUP BY 1, 2""")
def live_rolling_activity(spark, sf_dir):
    out = jobs.rolling_activity(events(spark, sf_dir).where("value is not null"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", (F.floor(F.col("total") * 100 + 0.5) / 100).alias("total"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, session""")
def live_sessions(spark, sf_dir):
    return jobs.sessions(events(spark, sf_dir)).select("user_id", F.col("session_window.start").alias("start"), "n")


@query("SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-02-01' - INTERVAL 14 DAY")
def live_within_lookback(spark, sf_dir):
    return jobs.within_lookback(events(spark, sf_dir), "2024-02-01", 14).select("event_id", "user_id")


@query("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts) = 1")
def live_deduplicated(spark, sf_dir):
    return events(spark, sf_dir).dropDuplicates(["event_id"]).select("event_id", "user_id", "event_type")


# Events that arrive in batches, some of them late. Batches hold a fourteenth of the events each, in order of time;
# one event in 20 comes a batch later, which the watermark of a day still takes, and one in 20 comes
# three batches later, when it has passed.
BATCHES, DELAY = 14, "1 day"
_ARRIVING = f"""WITH o AS (SELECT *, (row_number() OVER (ORDER BY ts, event_id) - 1) * {BATCHES} // count(*) OVER () AS chunk FROM events),
b AS (SELECT *, chunk + CASE event_id % 20 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END AS batch FROM o),
ends AS (SELECT batch, max(ts) AS last FROM b GROUP BY 1), numbered AS (SELECT batch, row_number() OVER (ORDER BY batch) AS n, date_trunc('milliseconds', max(last) OVER (ORDER BY batch)) AS seen FROM ends),
w AS (SELECT b.*, m.seen - INTERVAL 1 DAY AS passed FROM b JOIN numbered USING (batch) LEFT JOIN numbered m ON m.n = numbered.n - 2),
taken AS (SELECT * FROM w WHERE passed IS NULL OR ts > passed), final AS (SELECT max(seen) - INTERVAL 1 DAY AS at FROM numbered), late AS (SELECT count(*) AS late_rows FROM w WHERE ts <= passed)"""


def arriving(spark, sf_dir):
    """The events as files of one batch each, and a stream that takes a file at a time."""
    e = files.materialise(events(spark, sf_dir), "events")
    # Numbers by day and within it, so no task holds all events.
    day = e.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    before = day.select("day", F.coalesce(F.sum("n").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row per day
    number = F.row_number().over(W.partitionBy("day").orderBy("ts", "event_id")) - 1
    chunk = F.floor((F.col("at") + F.col("before")) * BATCHES / F.lit(e.count()))
    late = F.when(F.col("event_id") % 20 == 0, 3).when(F.col("event_id") % 20 == 1, 1).otherwise(0)
    dealt = e.withColumn("day", F.to_date("ts")).withColumn("at", number).join(before, "day").select("event_id", "ts", "user_id", "event_type", "value", (chunk + late).cast("int").alias("batch"))
    dealt = files.materialise(dealt, "dealt")
    root = files.scratch_dir(spark, "arriving")
    for i in range(BATCHES + 3):  # written one after the other, as they would land
        dealt.where(F.col("batch") == i).drop("batch").coalesce(1).write.mode("append").parquet(root)
    return jobs.in_time(jobs.read_events(spark, root), DELAY)


def _counted(spark, sf_dir, job, name):
    rows, late = jobs.counted(job(arriving(spark, sf_dir), delay=None), files.scratch_dir(spark, name))
    return rows.withColumn("late_rows", F.lit(late).cast("long"))


@query(f"""{_ARRIVING} SELECT minute, user_id, last_value, n, late_rows FROM (SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS minute, user_id, arg_max(value, (ts, event_id)) AS last_value, count(*) AS n FROM taken GROUP BY 1, 2), final, late WHERE minute + INTERVAL 1 MINUTE <= final.at""")
def stream_latest_per_minute(spark, sf_dir):
    """A stream of batches with late events: closed minutes, from what came in time; the late rows are counted."""
    return _counted(spark, sf_dir, jobs.latest_per_minute, "minutes").select(F.col("window.start").alias("minute"), "user_id", "last_value", "n", "late_rows")


@query(f"""{_ARRIVING}, d AS (SELECT *, unnest(range(7)) AS k FROM taken) SELECT start, event_type, n, total, late_rows FROM (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) - CAST(k AS INT) * INTERVAL 1 DAY AS start, event_type, count(*) AS n, floor(sum(value) * 100 + 0.5) / 100 AS total FROM d GROUP BY 1, 2), final, late WHERE start + INTERVAL 7 DAY <= final.at""")
def stream_rolling_activity(spark, sf_dir):
    out = _counted(spark, sf_dir, jobs.rolling_activity, "rolling")
    return out.select(F.col("window.start").alias("start"), "event_type", "n", (F.floor(F.col("total") * 100 + 0.5) / 100).alias("total"), "late_rows")


@query(f"""{_ARRIVING}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM taken),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, start, n, late_rows FROM (SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, session), final, late WHERE last + INTERVAL 30 MINUTE <= final.at""")
def stream_sessions(spark, sf_dir):
    return _counted(spark, sf_dir, jobs.sessions, "sessions").select("user_id", F.col("session_window.start").alias("start"), "n", "late_rows")


# Live documents: an hour of a user's events is a document of frames. They land in loads of three days; one frame in
# ten is sent again, changed, with the next load.
_FIRST, _LOADS = "2024-01-01", 11


@query(f"""WITH f AS (SELECT 'U' || user_id AS game_id, ts, event_id, 0 AS again, CAST(floor(value) AS BIGINT) AS gold, event_id % 30 AS kills FROM events
  UNION ALL SELECT 'U' || user_id, ts, event_id, 1, CAST(floor(value) AS BIGINT) + 500, event_id % 30 + 2 FROM events WHERE event_id % 10 = 0)
SELECT * FROM (SELECT game_id, time_bucket(INTERVAL 1 MINUTE, ts) AS minute, count(*) AS frames, arg_max(gold - event_id % 1000, (ts, again)) AS gold_diff, arg_max(kills - event_id % 17, (ts, again)) AS kill_diff FROM f GROUP BY 1, 2)
WHERE minute + INTERVAL 1 MINUTE <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 4 DAY FROM events)""")
def live_gold_difference(spark, sf_dir):
    """Closed minutes of a stream over landed JSON documents, run after each load; frames sent again replace the first ones."""
    e = events(spark, sf_dir).withColumn("load", F.floor(F.datediff("ts", F.lit(_FIRST).cast("date")) / 3))
    frame = lambda gold, kills: F.struct("ts", (F.floor("value") + gold).alias("blue_gold"), (F.col("event_id") % 1000).alias("red_gold"), (F.col("event_id") % 30 + kills).alias("blue_kills"), (F.col("event_id") % 17).alias("red_kills"))
    root = files.scratch_dir(spark, "live")
    out = None
    for load in range(_LOADS):
        first = e.where(F.col("load") == load).withColumns({"f": frame(0, 0), "again": F.lit(0)})
        again = e.where((F.col("load") == load - 1) & (F.col("event_id") % 10 == 0)).withColumns({"f": frame(500, 2), "again": F.lit(1)})
        docs = first.unionByName(again).groupBy(F.concat(F.lit("U"), "user_id").alias("game_id"), F.date_trunc("hour", "ts").alias("hour"), "again").agg(F.collect_list("f").alias("frames"))  # an hour of a game
        fetched = F.lit(_FIRST).cast("timestamp") + F.make_dt_interval(days=F.lit(3 * load + 3))
        docs.select("game_id", fetched.alias("fetched_at"), "frames").write.mode("append").json(f"{root}/landing")
        out = jobs.to_table(jobs.live_difference(jobs.live_frames(spark.readStream.schema(jobs.FRAMES).json(f"{root}/landing")), "4 days"), f"{root}/out")
    return out.select("game_id", F.col("window.start").alias("minute"), "frames", "gold_diff", "kill_diff")


@query("SELECT o_orderkey, o_custkey, CAST(o_orderstatus AS VARCHAR) AS status, CAST(NULL AS DOUBLE) AS missing FROM orders")
def conformed_orders(spark, sf_dir):
    """Explicit schema over a table: missing columns null, types cast."""
    wanted = spark.createDataFrame([], "o_orderkey bigint, o_custkey bigint, o_orderstatus string, missing double").schema
    return files.conform(table(spark, sf_dir, "orders"), wanted).withColumnRenamed("o_orderstatus", "status")


@query("SELECT c_custkey, c_name FROM customer WHERE upper(c_mktsegment) IN ('BUILDING', 'MACHINERY')")
def league_subset(spark, sf_dir):
    """Column-pruned read of the leagues wanted, case-insensitively."""
    return table(spark, sf_dir, "customer").where(F.upper("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_name")
