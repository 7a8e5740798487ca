"""Queries: pages as sets of report tables, and reads of official JSON feeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arenalake.functions import columns as C
from arenalake.operators import features as X
from arenalake.operators import quality as Q
from arenalake.operators import reports as R
from arenalake.operators import schedules as O
from arenalake.plans import gold as GP
from arenalake.plans import registry
from arenalake.plans.registry import query
from arenalake.sources import files
from arenalake.sources.standin import table

#: Sections of a page: report query to (what a row is about, its number of games, the column that the page's key is in).
PAGES = {
    "player": {
        "player_career": ("'career'", "games", "player_key"), "player_by_season_and_team": ("concat_ws('/', season_year, team_key)", "games", "player_key"), "player_by_champion": ("champion_name", "games", "player_key"),
        "signature_champions": ("champion_name", "games", "player_key"), "role_percentiles": ("role", "games", "player_key"),
    },
    "team": {
        "team_by_split": ("split_name", "games", "team_key"), "patch_profile": ("patch_version", "games", "team_key"), "over_under_rates": ("league_code", "games", "team_key"), "team_roster": ("player_key", "games", "team_key"),
        "player_impact": ("player_key", "games", "team_key"), "last_ten_games": ("game_id", "1", "team_key"),
    },
}


def page(spark, sf_dir, kind: str, keys: list[str]) -> dict[str, DataFrame]:
    """The tables of a page for one key, or several to be compared: each report, filtered to the keys. The
    filter reaches the reports' grouping keys, so a report is computed for those keys alone."""
    return {name: registry.queries()[name](spark, sf_dir).where(F.col(key).isin(keys)) for name, (_, _, key) in PAGES[kind].items()}


def listed(spark, sf_dir, kind: str, keys: list[str]) -> DataFrame:
    """A page as one table: section, key, what the row is about, its games."""
    parts = [df.select(F.lit(name).alias("section"), F.col(PAGES[kind][name][2]).alias("key"), F.expr(PAGES[kind][name][0]).alias("item"), F.expr(PAGES[kind][name][1]).cast("long").alias("games")) for name, df in page(spark, sf_dir, kind, keys).items()]
    return reduce(DataFrame.unionByName, parts)


def _listed_sql(kind: str, keys: list[str]) -> str:
    wanted = ", ".join(f"'{k}'" for k in keys)
    return " UNION ALL ".join(f"SELECT '{name}' AS section, {key} AS key, {item} AS item, CAST({games} AS BIGINT) AS games FROM ({registry._SQL[name]}) WHERE {key} IN ({wanted})" for name, (item, games, key) in PAGES[kind].items())


_PLAYER, _TEAM, _COMPARED = ["player:P-1"], ["team:T-ASIA"], ["team:T-ASIA", "team:T-EUROPE"]


@query(_listed_sql("player", _PLAYER))
def player_page(spark, sf_dir):
    return listed(spark, sf_dir, "player", _PLAYER)


@query(_listed_sql("team", _TEAM))
def team_page(spark, sf_dir):
    return listed(spark, sf_dir, "team", _TEAM)


@query(_listed_sql("team", _COMPARED))
def compare_page(spark, sf_dir):
    return listed(spark, sf_dir, "team", _COMPARED)


@query(f"{GP.P_SQL} SELECT game_id, side, array_to_string(list(player_key ORDER BY CASE role WHEN 'top' THEN 1 WHEN 'jng' THEN 2 WHEN 'mid' THEN 3 WHEN 'bot' THEN 4 WHEN 'sup' THEN 5 ELSE 9 END, participant_id), ',') AS lineup FROM participants GROUP BY 1, 2")
def game_lineups(spark, sf_dir):
    """Players of each side in the order of roles."""
    return R.lineups(GP.participants(spark, sf_dir)).select("game_id", "side", F.array_join("lineup", ",").alias("lineup"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate + INTERVAL 90 MINUTE ELSE CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END AS event_time FROM orders WHERE o_orderkey % 6 > 0")
def event_times(spark, sf_dir):
    """Start time where there is one, else the day; rows without either are left out."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 3 > 0, F.col("o_orderdate") + F.expr("INTERVAL 90 MINUTES")).alias("start"), F.when(k % 6 > 0, F.to_date("o_orderdate")).alias("day"))
    return rows.select("o_orderkey", C.event_time(F.col("start"), F.col("day")).alias("event_time")).where("event_time is not null")


@query(f"""{GP.SERIES_SQL},{GP.S.participants_sql()}, g AS (SELECT 'entrants' AS table_name, count(*) AS keys, count(*) FILTER (n > 1) AS failing FROM (SELECT count(*) AS n FROM entrants GROUP BY game_id, side)
UNION ALL SELECT 'participants', count(*), count(*) FILTER (n > 1) FROM (SELECT count(*) AS n FROM participants GROUP BY game_id, player_key) UNION ALL SELECT 'series', count(*), count(*) FILTER (n > 1) FROM (SELECT count(*) AS n FROM series GROUP BY series_key))
SELECT *, floor(failing * 10000 / keys + 0.5) / 100 AS failing_pct, failing = 0 AS passed FROM g""")
def quality_unique_grains(spark, sf_dir):
    """Three tables and the keys that should be unique in them."""
    return Q.unique_grains({"entrants": (GP.entrants(spark, sf_dir), ["game_id", "side"]), "participants": (GP.participants(spark, sf_dir), ["game_id", "player_key"]), "series": (GP.series(spark, sf_dir), ["series_key"])})


_CONTEXT = """m AS (SELECT o_orderkey AS match_id, CASE o_orderkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE '14.' || o_orderkey % 9 END AS patch FROM orders)"""


@query(f"WITH {_CONTEXT} SELECT match_id, coalesce(nullif(trim(patch), ''), (SELECT max(trim(patch)) FROM m WHERE trim(patch) <> '')) AS patch_version, 'X' AS league_code FROM m")
def match_context_patches(spark, sf_dir):
    """Match contexts with their patch: own, else the latest seen."""
    k, none = F.col("o_orderkey"), F.lit(None).cast("string")
    m = table(spark, sf_dir, "orders").select(k.alias("match_id"), F.lit("x").alias("league"), F.lit("s").alias("slug"), none.alias("league_code"), none.alias("split_name"), none.alias("phase"), none.cast("int").alias("best_of"), F.when(k % 4 == 0, " ").when(k % 4 > 1, F.concat(F.lit("14."), (k % 9).cast("string"))).alias("patch"))
    return X.match_context(m, spark.createDataFrame([], "slug string, code string")).select("match_id", "patch_version", "league_code")


# Official feeds as JSON lists.


def _lists(rows: DataFrame, path: str) -> None:
    """A list per 500 rows, each a file."""
    pages = rows.groupBy("page").agg(F.concat(F.lit("["), F.concat_ws(",", F.collect_list("json")), F.lit("]")).alias("text"))
    pages.write.partitionBy("page").text(path)


@query("SELECT CAST(c_custkey AS VARCHAR) AS official_league_id, lower(c_name) AS official_league_slug, c_name AS official_league_name, c_mktsegment AS official_region, CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 100 END::INT AS official_priority FROM customer")
def official_leagues(spark, sf_dir):
    k = F.col("c_custkey")
    doc = F.struct(k.alias("id"), F.upper("c_name").alias("slug"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("region"), F.when(k % 5 > 0, (k % 100).cast("string")).otherwise("high").alias("priority"), F.lit("x").alias("image"))
    path = files.scratch_dir(spark, "leagues")
    _lists(table(spark, sf_dir, "customer").select(F.floor(k / 500).alias("page"), F.to_json(doc).alias("json")), path)
    return files.read_official(spark, path, "leagues").select("official_league_id", "official_league_slug", "official_league_name", "official_region", "official_priority")


@query("SELECT 'T' || o_orderkey AS official_tournament_id, CAST(o_custkey AS VARCHAR) AS official_league_id, CASE WHEN o_orderkey % 7 > 0 THEN o_orderdate END AS official_start_time, o_orderdate + INTERVAL 30 DAY AS official_end_time FROM orders")
def official_tournaments(spark, sf_dir):
    k = F.col("o_orderkey")
    start = F.when(k % 7 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    doc = F.struct(F.concat(F.lit("T"), k.cast("string")).alias("id"), F.lit("s").alias("slug"), F.lit("n").alias("name"), F.col("o_custkey").alias("league_id"), start.alias("start_date"), F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"), "yyyy-MM-dd").alias("end_date"))
    path = files.scratch_dir(spark, "tournaments")
    _lists(table(spark, sf_dir, "orders").select(F.floor(k / 500).alias("page"), F.to_json(doc).alias("json")), path)
    return files.read_official(spark, path, "tournaments").select("official_tournament_id", "official_league_id", "official_start_time", "official_end_time")


@query("SELECT 'M' || o_orderkey AS MatchId, 'A' AS Team1, CAST(o_orderdate AS VARCHAR) AS DateTime_UTC, CAST(NULL AS VARCHAR) AS Patch, CASE WHEN o_orderkey // 500 % 2 = 0 THEN '3' END AS BestOf FROM orders")
def wiki_payloads(spark, sf_dir):
    """Schedules in both published shapes, some without a column: fifteen columns, renamed and filled."""
    k = F.col("o_orderkey")
    doc = F.struct(F.concat(F.lit("M"), k.cast("string")).alias("MatchId"), F.lit("A").alias("Team1"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("DateTime UTC"), F.when(F.floor(k / 500) % 2 == 0, "3").alias("BestOf"))
    path = files.scratch_dir(spark, "payloads")
    pages = table(spark, sf_dir, "orders").select(F.floor(k / 500).alias("page"), F.to_json(doc).alias("json")).groupBy("page").agg(F.concat(F.lit("["), F.concat_ws(",", F.collect_list("json")), F.lit("]")).alias("text"))
    wrapped = F.when(F.col("page") % 3 == 0, F.concat(F.lit('{"rows": '), "text", F.lit("}"))).otherwise(F.col("text"))
    pages.select("page", wrapped.alias("text")).write.partitionBy("page").text(path)
    return files.read_wiki_schedule(spark, path).select("MatchId", "Team1", "DateTime_UTC", "Patch", "BestOf")
