"""Queries: feeds and tables written, read again, and used; streams run over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from arenalake.operators import bronze as B
from arenalake.plans import gold as GP
from arenalake.plans.registry import query
from arenalake.sources import files
from arenalake.sources import standin as S
from arenalake.streaming import jobs


@query(f"{GP.E_SQL} SELECT game_id, side, team_key, season_year, split_name, win, dragons FROM entrants")
def csv_box_scores(spark, sf_dir):
    """CSV feeds whose headers differ, all strings, united by name, then typed."""
    bronze, path = S.bronze_entrants(spark, sf_dir, "region"), files.scratch_dir(spark, "csv")
    bronze.where("year < '1998'").drop("inhibitors").write.option("header", True).csv(f"{path}/a")
    bronze.where("year >= '1998'").write.option("header", True).csv(f"{path}/b")
    rows = files.read_box_scores(spark, [f"{path}/a", f"{path}/b"])
    return B.typed_entrants(rows).select("game_id", "side", "team_key", "season_year", "split_name", "win", "dragons")


@query(f"{GP.E_SQL} SELECT game_id, side, team_key, season_year, split_name, win, dragons FROM entrants")
def csv_mixed_headers(spark, sf_dir):
    """One folder whose files have their columns in different orders."""
    bronze, path = S.bronze_entrants(spark, sf_dir, "region"), files.scratch_dir(spark, "csv")
    bronze.where("year < '1998'").drop("inhibitors").write.option("header", True).csv(path)
    bronze.where("year >= '1998'").select(*reversed(bronze.columns)).write.mode("append").option("header", True).csv(path)
    return B.typed_entrants(files.read_box_scores(spark, [path])).select("game_id", "side", "team_key", "season_year", "split_name", "win", "dragons")


@query("SELECT o_orderkey, o_orderdate::DATE AS day, o_totalprice, o_orderpriority FROM orders")
def csv_inferred_types(spark, sf_dir):
    """Files of a name pattern, types inferred over all their rows."""
    path = files.scratch_dir(spark, "csv")
    orders = S.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), "o_totalprice", "o_orderpriority")
    orders.write.option("header", True).csv(path)
    return files.read_typed_csv(spark, path, "part-*.csv").select("o_orderkey", "day", "o_totalprice", "o_orderpriority")


@query("SELECT 'M' || o_orderkey AS id, o_orderpriority AS league, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END::INT AS teams FROM orders")
def nested_json_matches(spark, sf_dir):
    """Nested match documents as JSON, read by an explicit schema at any depth."""
    k = F.col("o_orderkey")
    team = lambda n: F.struct(F.concat(F.lit(n), k.cast("string")).alias("id"))
    docs = S.table(spark, sf_dir, "orders").select(F.concat(F.lit("M"), k.cast("string")).alias("id"), F.struct(F.col("o_orderpriority").alias("name")).alias("league"), F.when(k % 2 == 0, F.array(team("a"), team("b"))).otherwise(F.array(team("a"))).alias("teams"))
    path = files.scratch_dir(spark, "json")
    docs.write.json(f"{path}/deep/er")
    back = files.read_nested_json(spark, path, "id string, league struct<name:string>, teams array<struct<id:string>>")
    return back.select("id", F.col("league.name").alias("league"), F.size("teams").alias("teams"))


@query(f"{GP.PAIRS_SQL} SELECT game_id, league_code, season_year, team1_win FROM pairs WHERE season_year >= 1999")
def partitioned_games(spark, sf_dir):
    """Hive partitions by year and league, ordered inside; the filter prunes partitions."""
    path = files.scratch_dir(spark, "games")
    files.write_partitioned(GP.pairs(spark, sf_dir).select("game_id", "league_code", "season_year", "team1_win"), path, ["season_year", "league_code"], ["game_id"])
    return spark.read.parquet(path).where("season_year >= 1999").select("game_id", "league_code", "season_year", "team1_win")


@query(f"{GP.E_SQL} SELECT league_code, count(*) AS rows FROM entrants GROUP BY 1")
def snapshot_tables(spark, sf_dir):
    """Immutable snapshot with a manifest and a pointer that moves last, then read through the pointer."""
    root = files.scratch_dir(spark, "gold")
    files.write_snapshot({"entrants": GP.entrants(spark, sf_dir)}, root, "run")
    return spark.read.parquet(f"{files.latest_snapshot(spark, root)}/entrants").groupBy("league_code").agg(F.count("*").alias("rows"))


@query(f"""{GP.EP_SQL}, t AS (SELECT 'entrants' AS table_name, count(*) AS total, count(*) FILTER (team_id IS NULL) AS a, count(*) FILTER (split_name IS NULL) AS b, count(*) FILTER (dragons < 0) AS c FROM entrants),
p AS (SELECT count(*) AS total, count(*) FILTER (player_id IS NULL) AS a FROM participants),
r AS (SELECT table_name, 'missing_team_id' AS check_name, 'warning' AS severity, a AS failing, total, 5.0 AS threshold_pct FROM t UNION ALL SELECT table_name, 'missing_split', 'warning', b, total, 50.0 FROM t UNION ALL SELECT table_name, 'negative_dragons', 'error', c, total, 0.0 FROM t UNION ALL SELECT 'participants', 'missing_player_id', 'warning', a, total, 1.0 FROM p)
SELECT *, floor(failing * 10000 / total + 0.5) / 100 AS failing_pct, floor(failing * 10000 / total + 0.5) / 100 <= threshold_pct AS passed FROM r""")
def snapshot_report(spark, sf_dir):
    """Validation report of a snapshot, observed while its tables were written."""
    root = files.scratch_dir(spark, "gold")
    missing = lambda c: F.col(c).isNull()
    checks = {
        "entrants": {"missing_team_id": ("warning", missing("team_id"), 5), "missing_split": ("warning", missing("split_name"), 50), "negative_dragons": ("error", F.col("dragons") < 0, 0)},
        "participants": {"missing_player_id": ("warning", missing("player_id"), 1)},
    }
    files.write_snapshot({"entrants": GP.entrants(spark, sf_dir), "participants": GP.participants(spark, sf_dir)}, root, "run", checks=checks)
    return files.validation_report(spark, files.latest_snapshot(spark, root))


@query("SELECT o_orderkey AS id, o_totalprice AS price, year(o_orderdate)::INT AS year FROM orders")
def landed_years(spark, sf_dir):
    """Landing by year with recorded progress: the second year fails on its first try, the next call lands what is missing."""
    root = files.scratch_dir(spark, "years")
    rows = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.year("o_orderdate").alias("year"))
    years = list(range(1995, 2002))
    failed = []

    def fetch(year):
        if year == years[1] and not failed:
            failed.append(year)
            raise ConnectionError("the feed broke off")
        return rows.where(F.col("year") == year).drop("year")

    try:
        files.land_pending(spark, root, years, fetch)
    except ConnectionError:
        files.land_pending(spark, root, years, fetch)
    return files.read_landed_years(spark, root, "id bigint, price double")


@query(f"""{GP.E_SQL} SELECT 'old reader' AS reader, league_code, count(*) AS rows FROM entrants WHERE season_year < 1999 GROUP BY 2 UNION ALL SELECT 'new reader', league_code, count(*) FROM entrants GROUP BY 2""")
def served_table(spark, sf_dir):
    """A serving table replaced while it is read: a reader that planned before keeps the old rows, a later one has the new."""
    root, name = files.scratch_dir(spark, "serving"), f"standings_{files.uuid.uuid4().hex}"
    e = GP.entrants(spark, sf_dir).select("game_id", "league_code", "season_year")
    files.publish(e.where("season_year < 1999"), name, root)
    before = spark.table(name)
    files.publish(e, name, root)
    after = spark.table(name)
    count = lambda df, who: df.groupBy("league_code").agg(F.count("*").alias("rows")).select(F.lit(who).alias("reader"), "league_code", "rows")
    spark.sql(f"DROP VIEW {name}")  # both frames know their folders
    return count(before, "old reader").unionByName(count(after, "new reader"))


# Wiki feeds from line items and customers: pages of 500 rows as JSON lists, page 1 cut off in the middle; some values are bad by modulus.
_PAGED = "o_orderkey // 500 <> 1"
_BAD_GAME = "CASE WHEN k % 31 = 0 THEN 'game_id is missing' WHEN k % 37 = 0 THEN 'kills is no int' WHEN k % 41 = 0 THEN 'win is no flag' END"


def _landed(spark, rows, page, name):
    """Rows as JSON lists, one file a page, compressed: the names of the fields stand in every row."""
    root = files.scratch_dir(spark, name)
    lists = rows.withColumn("page", page).groupBy("page").agg(F.concat(F.lit("["), F.concat_ws(",\n", F.collect_list("json")), F.lit("]")).alias("text"))  # 500 ids, a few rows each
    cut = F.when(F.col("page") == 1, F.substring("text", 1, 40)).otherwise(F.col("text"))
    lists.select("page", cut.alias("text")).write.partitionBy("page").option("compression", "gzip").text(root)
    return root


def wiki_games(spark, sf_dir):
    k, n = F.col("o_orderkey"), F.col("rn")
    s = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    row = F.struct(
        F.when(k % 31 == 0, " ").otherwise(F.concat(F.lit("G"), s(k))).alias("GameId"), F.concat(F.lit("M"), s(k)).alias("MatchId"), F.date_format("event_date", "yyyy-MM-dd HH:mm:ss").alias("DateTime UTC"), F.col("s_name").alias("Link"), F.col("s_name").alias("Name"),
        F.col("n_name").alias("Team"), F.col("p_brand").alias("Champion"), s(n % 2 + 1).alias("Side"), F.when(k % 41 == 0, "maybe").when(n % 2 == 0, "Yes").otherwise("No").alias("PlayerWin"), F.when(k % 37 == 0, "n/a").otherwise(s(F.col("l_quantity").cast("int"))).alias("Kills"), F.lit("x").alias("Unknown"),
    )
    rows = S.lines(spark, sf_dir).select("o_orderkey", F.to_json(row).alias("json"))
    return files.read_wiki(spark, _landed(spark, rows, F.floor(k / 500), "wiki"), "player_games")


_WIKI_GAMES = f"WITH {S._LINES.strip()}, w AS (SELECT *, o_orderkey AS k FROM lines), t AS (SELECT *, {_BAD_GAME} AS reason FROM w WHERE {_PAGED})"


@query(f"{_WIKI_GAMES} SELECT 'G' || k AS game_id, 'M' || k AS match_id, CAST(event_date AS TIMESTAMP) AS played_at, s_name AS player_link, n_name AS team_name, p_brand AS champion_name, CAST(rn % 2 + 1 AS INT) AS side, rn % 2 = 0 AS win, CAST(l_quantity AS INT) AS kills, CAST(NULL AS INT) AS deaths FROM t WHERE reason IS NULL")
def wiki_player_games(spark, sf_dir):
    return wiki_games(spark, sf_dir)[0].select("game_id", "match_id", "played_at", "player_link", "team_name", "champion_name", "side", "win", "kills", "deaths")


@query(f"{_WIKI_GAMES} SELECT reason, count(*) AS rows FROM t WHERE reason IS NOT NULL GROUP BY 1 UNION ALL SELECT 'not JSON', 1 WHERE EXISTS (SELECT 1 FROM w WHERE NOT ({_PAGED}))")
def wiki_rejects(spark, sf_dir):
    return wiki_games(spark, sf_dir)[1].groupBy("reason").agg(F.count("*").alias("rows"))


@query("""SELECT 'C' || c_custkey AS player_id, c_name AS full_name, CASE WHEN c_custkey % 9 > 0 THEN DATE '1990-01-01' + CAST(c_custkey % 5000 AS INT) END AS birthdate, c_custkey % 4 = 0 AS retired FROM customer WHERE c_custkey // 500 <> 1 AND c_custkey % 13 <> 0""")
def wiki_profiles(spark, sf_dir):
    """Player profiles; blank birthdates are null, unreadable ones reject the row."""
    k = F.col("c_custkey")
    born = F.when(k % 13 == 0, "unknown").when(k % 9 == 0, "").otherwise(F.date_add(F.lit("1990-01-01").cast("date"), (k % 5000).cast("int")).cast("string"))
    row = F.struct(F.concat(F.lit("C"), k.cast("string")).alias("ID"), F.col("c_name").alias("Name"), born.alias("Birthdate"), F.when(k % 4 == 0, "1").otherwise("0").alias("IsRetired"))
    rows = S.table(spark, sf_dir, "customer").select("c_custkey", F.to_json(row).alias("json"))
    return files.read_wiki(spark, _landed(spark, rows, F.floor(k / 500), "profiles"), "profiles")[0].select("player_id", "full_name", "birthdate", "retired")


@query("""SELECT 'M' || o_orderkey AS match_id, o_orderdate AS match_time, CAST(o_orderkey % 2 + 1 AS INT) AS winner, CAST(o_orderkey % 4 AS INT) AS team1_score, CASE WHEN o_orderkey % 3 > 0 THEN 5 END::INT AS best_of FROM orders WHERE o_orderkey // 500 <> 1 AND o_orderkey % 43 <> 0""")
def wiki_matches(spark, sf_dir):
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    when = F.when(k % 43 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    row = F.struct(F.concat(F.lit("M"), s(k)).alias("MatchId"), when.alias("DateTime UTC"), s(k % 2 + 1).alias("Winner"), s(k % 4).alias("Team1Score"), F.when(k % 3 > 0, "5").otherwise("").alias("BestOf"))
    rows = S.table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(row).alias("json"))
    return files.read_wiki(spark, _landed(spark, rows, F.floor(k / 500), "matches"), "matches")[0].select("match_id", "match_time", "winner", "team1_score", "best_of")


@query("SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderkey % 3 > 0")
def landing_zone(spark, sf_dir):
    """Envelope with lineage, JSON folders by type and date, read by a date filter."""
    path, rows = files.scratch_dir(spark, "landing"), S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    for i in range(3):
        files.land(rows.where(F.col("id") % 3 == i), path, "orders", "feed", F.lit(f"2024-02-0{i + 1}"))
    return files.read_landing(spark, path, "struct<id:bigint,price:double>", "orders", (2024, 2, 2)).select("data.id", "data.price")


@query("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts) = 1")
def stream_deduplicated(spark, sf_dir):
    """The event table as a stream: first event of each id within the watermark."""
    stream = jobs.deduplicated(jobs.read_events(spark, sf_dir, pattern="events.parquet"), "60 days")
    return jobs.to_table(stream.select("event_id", "user_id", "event_type"), files.scratch_dir(spark, "stream"))


@query("SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-02-01' - INTERVAL 14 DAY")
def stream_within_lookback(spark, sf_dir):
    stream = jobs.within_lookback(jobs.read_events(spark, sf_dir, pattern="events.parquet"), "2024-02-01", 14)
    return jobs.to_table(stream.select("event_id", "user_id"), files.scratch_dir(spark, "stream"))
