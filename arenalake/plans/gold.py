"""Queries: typing, dimensions, facts, series."""

from __future__ import annotations

from pyspark.sql import functions as F

from arenalake.functions import columns as C
from arenalake.operators import bronze as B
from arenalake.operators import gold as G
from arenalake.plans.registry import query
from arenalake.sources import standin as S

#: League code, region, core flag: stand-in for the curated league list.
CURATED = [("AUTOMOBILE", "EU", 1), ("BUILDING", "NA", 1), ("FURNITURE", "KR", 0)]


def entrants(spark, sf_dir, grain="region"):
    return B.typed_entrants(S.bronze_entrants(spark, sf_dir, grain))


def participants(spark, sf_dir):
    return B.typed_participants(S.bronze_participants(spark, sf_dir))


def pairs(spark, sf_dir, grain="region"):
    return B.game_pairs(entrants(spark, sf_dir, grain))


def series(spark, sf_dir, grain="region", mode="chained"):
    return G.merge_days(G.daily_series(pairs(spark, sf_dir, grain)), mode)


def curated(spark):
    return spark.createDataFrame(CURATED, "league_code string, region string, core int")


E_SQL, P_SQL = f"WITH {S.entrants_sql('region')}", f"WITH {S._LINES.strip()},{S.participants_sql()}"
EP_SQL = f"{E_SQL},{S.participants_sql()}"
PAIRS_SQL = f"{E_SQL},{B.PAIRS_SQL}"
DAILY_SQL = f"""{PAIRS_SQL},
daily AS (
  SELECT league_code, season_year, event_date, team1_key, team2_key, count(*) AS games, CAST(sum(team1_win) AS BIGINT) AS team1_wins,
    CAST(sum(team2_win) AS BIGINT) AS team2_wins, max(split_name) AS split_name, max(playoffs) AS playoffs,
    list(game_id ORDER BY game_number, game_id) AS game_ids, avg(game_length_seconds) AS mean_length
  FROM pairs GROUP BY ALL
)"""
_FACE = """'series:' || league_code || ':' || season_year || ':' || event_date || ':' || team1_key || ':' || team2_key AS series_key,
    CASE WHEN greatest(team1_wins, team2_wins) = 1 THEN 'Bo1' WHEN greatest(team1_wins, team2_wins) * 2 - 1 BETWEEN 2 AND 3 THEN 'Bo3'
      WHEN greatest(team1_wins, team2_wins) * 2 - 1 BETWEEN 4 AND 5 THEN 'Bo5' ELSE 'Unknown' END AS series_format,
    greatest(team1_wins, team2_wins) || '-' || least(team1_wins, team2_wins) AS score,
    CASE WHEN team1_wins > team2_wins THEN team1_key WHEN team2_wins > team1_wins THEN team2_key END AS winner_key"""
SERIES_SQL = f"""{DAILY_SQL},
flagged AS (
  SELECT *, event_date - lag(event_date) OVER (PARTITION BY league_code, season_year, team1_key, team2_key ORDER BY event_date) AS gap FROM daily
), islands AS (
  SELECT *, sum(CASE WHEN gap = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY league_code, season_year, team1_key, team2_key ORDER BY event_date) AS island FROM flagged
), merged AS (
  SELECT league_code, season_year, team1_key, team2_key, min(event_date) AS event_date, count(*) AS days, CAST(sum(games) AS BIGINT) AS games,
    CAST(sum(team1_wins) AS BIGINT) AS team1_wins, CAST(sum(team2_wins) AS BIGINT) AS team2_wins, max(playoffs) AS playoffs,
    flatten(list(game_ids ORDER BY event_date)) AS game_ids
  FROM islands GROUP BY league_code, season_year, team1_key, team2_key, island
), series AS (SELECT *, {_FACE} FROM merged)"""


@query(f"{E_SQL} SELECT * FROM entrants")
def typed_entrant_rows(spark, sf_dir):
    return entrants(spark, sf_dir)


@query(f"{P_SQL} SELECT * REPLACE (CAST(season_year AS INT) AS season_year) FROM participants")
def typed_participant_rows(spark, sf_dir):
    return participants(spark, sf_dir)


@query(f"""{E_SQL} SELECT a.game_id, a.side, a.team_key, b.team_key AS opponent_key, b.team_name AS opponent_name, b.kills AS opponent_kills
FROM entrants a LEFT JOIN entrants b ON a.game_id = b.game_id AND a.side <> b.side""")
def opponent_join(spark, sf_dir):
    return B.with_opponent(entrants(spark, sf_dir)).select("game_id", "side", "team_key", "opponent_key", "opponent_name", "opponent_kills")


@query(f"{PAIRS_SQL} SELECT * FROM pairs")
def game_pairs(spark, sf_dir):
    return pairs(spark, sf_dir)


@query(f"""{E_SQL} SELECT l.*, c.region, c.core, CASE WHEN core = 1 THEN 'core' WHEN region IS NOT NULL THEN 'known' ELSE 'uncurated' END AS status
FROM (SELECT league_code, min(event_date) AS first_seen, max(event_date) AS last_seen, count(DISTINCT game_id) AS games, count(DISTINCT season_year) AS seasons FROM entrants GROUP BY 1) l
LEFT JOIN (VALUES ('AUTOMOBILE', 'EU', 1), ('BUILDING', 'NA', 1), ('FURNITURE', 'KR', 0)) c(league_code, region, core) USING (league_code)""")
def league_dimension(spark, sf_dir):
    return G.league_dimension(entrants(spark, sf_dir), curated(spark))


@query(f"""{E_SQL} SELECT team_key, arg_max(team_name, (event_date, game_number, side)) AS team_name, array_to_string(list_sort(list(DISTINCT league_code)), ',') AS leagues,
count(DISTINCT team_name) AS name_variants, count(*) FILTER (team_id IS NULL) AS missing_id_rows, count(DISTINCT game_id) AS games, min(event_date) AS first_seen, max(event_date) AS last_seen
FROM entrants GROUP BY 1""")
def team_dimension(spark, sf_dir):
    return G.team_dimension(entrants(spark, sf_dir))


@query(f"""{P_SQL}, roles AS (SELECT player_key, role, count(*) AS n, row_number() OVER (PARTITION BY player_key ORDER BY count(*) DESC, role) AS r FROM participants GROUP BY 1, 2)
SELECT p.player_key, arg_max(player_name, (event_date, game_id, participant_id)) AS player_name, count(DISTINCT game_id) AS games, count(DISTINCT champion_name) AS champions,
min(event_date) AS first_seen, any_value(t.role) AS primary_role, any_value(t.n) AS role_games
FROM participants p LEFT JOIN roles t ON t.player_key = p.player_key AND t.r = 1 GROUP BY 1""")
def player_dimension(spark, sf_dir):
    return G.player_dimension(participants(spark, sf_dir))


@query(f"""{EP_SQL} SELECT p.game_id, p.side, p.participant_id, p.player_key, e.team_key, e.win,
floor((CASE WHEN coalesce(p.deaths, 0) = 0 THEN p.kills + p.assists ELSE (p.kills + p.assists) / p.deaths END) * 1000 + 0.5) / 1000 AS kda,
floor(p.damage * 60.0 / e.game_length_seconds * 100 + 0.5) / 100 AS dpm
FROM participants p LEFT JOIN entrants e ON p.game_id = e.game_id AND p.side = e.side""")
def player_facts(spark, sf_dir):
    f = G.player_facts(participants(spark, sf_dir), entrants(spark, sf_dir))
    return f.select("game_id", "side", "participant_id", "player_key", "team_key", "win", C.rounded(F.col("kda"), 3).alias("kda"), C.rounded(F.col("dpm"), 2).alias("dpm"))


_PICKS = ", ".join(f"min(champion_name) FILTER (role = '{r}') AS pick_{r}" for r in S.ROLES)


@query(f"""{P_SQL} SELECT *, {" AND ".join(f"pick_{r} IS NOT NULL" for r in S.ROLES)} AS draft_complete
FROM (SELECT game_id, side, {_PICKS}, count(*) AS picks FROM participants GROUP BY 1, 2)""")
def draft_facts(spark, sf_dir):
    return G.draft_facts(participants(spark, sf_dir))


@query(f"{DAILY_SQL} SELECT * REPLACE (array_to_string(game_ids, ',') AS game_ids, floor(mean_length * 100 + 0.5) / 100 AS mean_length) FROM daily")
def daily_series(spark, sf_dir):
    d = G.daily_series(pairs(spark, sf_dir))
    return d.withColumn("game_ids", F.array_join("game_ids", ",")).withColumn("mean_length", C.rounded(F.col("mean_length"), 2))


@query(f"{SERIES_SQL} SELECT * REPLACE (array_to_string(game_ids, ',') AS game_ids) FROM series")
def series_chained(spark, sf_dir):
    return series(spark, sf_dir).withColumn("game_ids", F.array_join("game_ids", ","))


@query(f"""{DAILY_SQL}, w AS (SELECT *, coalesce(event_date - lag(event_date) OVER p = 1, false) AS follows, coalesce(lead(event_date) OVER p - event_date = 1, false) AS first_day,
  lag(event_date) OVER p AS p_date, lag(games) OVER p AS p_games, lag(team1_wins) OVER p AS p_w1, lag(team2_wins) OVER p AS p_w2, lag(game_ids) OVER p AS p_ids
  FROM daily WINDOW p AS (PARTITION BY league_code, season_year, team1_key, team2_key ORDER BY event_date)),
merged AS (SELECT league_code, season_year, team1_key, team2_key, CASE WHEN follows THEN p_date ELSE event_date END AS event_date, CASE WHEN follows THEN 2 ELSE 1 END::BIGINT AS days,
  games + CASE WHEN follows THEN p_games ELSE 0 END AS games, team1_wins + CASE WHEN follows THEN p_w1 ELSE 0 END AS team1_wins,
  team2_wins + CASE WHEN follows THEN p_w2 ELSE 0 END AS team2_wins, playoffs, array_to_string(CASE WHEN follows THEN list_concat(p_ids, game_ids) ELSE game_ids END, ',') AS game_ids
  FROM w WHERE NOT first_day)
SELECT *, {_FACE} FROM merged""")
def series_pairwise(spark, sf_dir):
    return series(spark, sf_dir, mode="pairwise").withColumn("game_ids", F.array_join("game_ids", ","))


@query(f"""{SERIES_SQL}, placed AS (SELECT *, row_number() OVER (PARTITION BY league_code, season_year ORDER BY event_date DESC, series_key DESC) AS from_end,
  count(*) OVER (PARTITION BY league_code, season_year, event_date) AS same_day, max(event_date) FILTER (playoffs = 1) OVER (PARTITION BY league_code, season_year) AS last_playoff FROM series)
SELECT series_key, CAST(from_end AS INT) AS from_end, same_day, CASE WHEN playoffs = 1 AND last_playoff = event_date AND same_day = 1 THEN 'Final' WHEN playoffs = 1 AND last_playoff - event_date <= 7 THEN 'Semifinal'
  WHEN playoffs = 1 THEN 'Playoffs' ELSE 'Regular Season' END AS phase FROM placed""")
def tournament_phases(spark, sf_dir):
    return G.tournament_phases(series(spark, sf_dir)).select("series_key", "from_end", "same_day", "phase")


_ABROAD = ["BUILDING", "MACHINERY"]
_PLACED = f"""{SERIES_SQL}, q AS (SELECT *, 'Q' || quarter(event_date) AS split_name, max(event_date) OVER (PARTITION BY league_code, season_year) - event_date AS days_from_end, count(*) OVER (PARTITION BY league_code, season_year, event_date) AS same_day FROM series),
abroad AS (SELECT *, row_number() OVER (PARTITION BY league_code, season_year ORDER BY event_date DESC, games DESC, series_key DESC) AS r FROM q WHERE league_code IN ('BUILDING', 'MACHINERY')),
home AS (SELECT *, row_number() OVER (PARTITION BY league_code, season_year, split_name ORDER BY event_date DESC, games DESC, series_key DESC) AS r FROM q WHERE league_code NOT IN ('BUILDING', 'MACHINERY'))"""


@query(f"""{_PLACED} SELECT series_key, CAST(days_from_end AS INT) AS days_from_end, CASE WHEN r = 1 AND games >= 3 THEN 'Final' WHEN days_from_end = 0 AND same_day = 1 THEN 'Final' WHEN r IN (2, 3) AND games >= 3 AND days_from_end <= 10 THEN 'Semifinal'
WHEN r BETWEEN 4 AND 8 AND games >= 3 AND days_from_end <= 20 THEN 'Quarterfinal' WHEN games <= 2 AND same_day >= 2 THEN 'Swiss/Groups' WHEN days_from_end > 25 THEN 'Play-in' ELSE 'Group Stage' END AS phase FROM abroad
UNION ALL SELECT series_key, CAST(days_from_end AS INT), CASE WHEN playoffs = 1 AND r = 1 AND games >= 3 THEN 'Final' WHEN playoffs = 1 AND r IN (2, 3) AND games >= 3 THEN 'Semifinal' WHEN playoffs = 1 THEN 'Playoffs' ELSE 'Regular Season' END FROM home""")
def competition_phases(spark, sf_dir):
    """Phases by the rule of international tournaments for two leagues and by that of leagues for the others."""
    s = series(spark, sf_dir).withColumn("split_name", F.concat(F.lit("Q"), F.quarter("event_date").cast("string")))
    return G.competition_phases(s, _ABROAD).select("series_key", "days_from_end", "phase")


@query(f"""{SERIES_SQL} SELECT league_code, season_year, event_date, winner_key AS champion_key, CASE WHEN winner_key = team1_key THEN team2_key ELSE team1_key END AS runner_up_key, score
FROM series WHERE winner_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY league_code, season_year ORDER BY event_date DESC, series_key DESC) = 1""")
def season_champions(spark, sf_dir):
    return G.champions_of(series(spark, sf_dir))


@query(f"""{EP_SQL} SELECT game_id, any_value(n) AS sides, CAST(sum(players) AS BIGINT) AS players, CAST(sum(k) AS BIGINT) AS player_kills FROM (
SELECT e.game_id, e.side, count(*) OVER (PARTITION BY e.game_id) AS n, players, k FROM entrants e
LEFT JOIN (SELECT game_id, side, count(*) AS players, sum(kills) AS k FROM participants GROUP BY 1, 2) p ON e.game_id = p.game_id AND e.side = p.side) WHERE n = 2 GROUP BY 1""")
def nested_games(spark, sf_dir):
    doc = G.game_document(entrants(spark, sf_dir), participants(spark, sf_dir))
    every = F.flatten(F.transform("sides", lambda s: s["players"]))
    kills = F.aggregate(every, F.lit(0).cast("long"), lambda a, p: a + p["kills"])
    return doc.select("game_id", F.size("sides").cast("long").alias("sides"), F.size(every).cast("long").alias("players"), kills.alias("player_kills"))
