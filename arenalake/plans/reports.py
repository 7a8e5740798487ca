"""Queries: reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from arenalake.functions import columns as C
from arenalake.operators import gold as G
from arenalake.operators import reports as R
from arenalake.plans import gold as GP
from arenalake.plans.registry import query

AS_OF = "2001-01-01"
FACTS_SQL = f"""{GP.EP_SQL},
facts AS (SELECT p.*, e.team_key, e.win, e.game_length_seconds, CASE WHEN coalesce(p.deaths, 0) = 0 THEN (p.kills + p.assists)::DOUBLE ELSE (p.kills + p.assists) / p.deaths END AS kda
  FROM participants p LEFT JOIN entrants e ON p.game_id = e.game_id AND p.side = e.side)"""
PCT = "CASE WHEN count(*) = 0 THEN 0.0 ELSE floor(sum(win) * 1000 / count(*) + 0.5) / 10 END"
_KDA = "avg(CAST(floor(kda * 1000 + 0.5) AS BIGINT)) / 1000"
RECORD = f"count(*) AS games, CAST(sum(win) AS BIGINT) AS wins, CAST(count(*) - sum(win) AS BIGINT) AS losses, {PCT} AS win_pct"


def facts(spark, sf_dir):
    return G.player_facts(GP.participants(spark, sf_dir), GP.entrants(spark, sf_dir))


def r2(c):
    return C.rounded(F.col(c), 2).alias(c)


def _r2(x, name):
    return f"floor(({x}) * 100 + 0.5) / 100 AS {name}"


@query(f"{GP.E_SQL} SELECT team_key, split_name, {RECORD} FROM entrants GROUP BY 1, 2")
def team_by_split(spark, sf_dir):
    return R.record(GP.entrants(spark, sf_dir), ["team_key", "split_name"])


@query(f"{GP.E_SQL} SELECT team_key, patch_version, {RECORD} FROM entrants GROUP BY 1, 2 HAVING count(*) >= 3")
def patch_profile(spark, sf_dir):
    return R.record(GP.entrants(spark, sf_dir), ["team_key", "patch_version"], 3)


@query(f"{GP.E_SQL} SELECT team_key, league_code, season_year, {RECORD} FROM entrants WHERE playoffs = 1 AND league_code IN ('BUILDING', 'MACHINERY') AND (split_name IS NULL OR trim(split_name) = '' OR split_name = 'Q4') GROUP BY 1, 2, 3")
def filtered_record(spark, sf_dir):
    """Filter builder: several criteria from values."""
    rows = GP.entrants(spark, sf_dir).where(C.matches_all({"playoffs": 1, "league_code": ["BUILDING", "MACHINERY"], "season_year": None}))
    return R.record(rows.where(C.matches_all({"split_name": "N/A"}) | C.matches_all({"split_name": "Q4"})), ["team_key", "league_code", "season_year"])


def _career_sql(keys):
    return f"""{FACTS_SQL} SELECT {keys}, count(*) AS games, CAST(sum(win) AS BIGINT) AS wins, CAST(sum(kills) AS BIGINT) AS kills, CAST(sum(deaths) AS BIGINT) AS deaths,
{_r2(f"{_KDA}", "mean_kda")}, {_r2("avg(damage)", "mean_damage")}, count(DISTINCT champion_name) AS champions FROM facts GROUP BY {keys}"""


def _career(spark, sf_dir, keys):
    return R.career(facts(spark, sf_dir), keys).select(*keys, "games", "wins", "kills", "deaths", r2("mean_kda"), r2("mean_damage"), "champions")


@query(_career_sql("player_key"))
def player_career(spark, sf_dir):
    return _career(spark, sf_dir, ["player_key"])


@query(_career_sql("player_key, season_year, team_key"))
def player_by_season_and_team(spark, sf_dir):
    return _career(spark, sf_dir, ["player_key", "season_year", "team_key"])


@query(_career_sql("player_key, champion_name"))
def player_by_champion(spark, sf_dir):
    return _career(spark, sf_dir, ["player_key", "champion_name"])


@query(f"""{FACTS_SQL}, g AS (SELECT player_key, champion_name, count(*) AS games, CAST(sum(win) AS BIGINT) AS wins FROM facts GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT player_key, champion_name, games, wins, row_number() OVER (PARTITION BY player_key ORDER BY games DESC, wins DESC NULLS LAST, champion_name)::INT AS rank FROM g QUALIFY rank <= 3""")
def signature_champions(spark, sf_dir):
    g = facts(spark, sf_dir).groupBy("player_key", "champion_name").agg(F.count("*").alias("games"), F.sum("win").alias("wins")).where("games >= 2")
    return R.top_per(g, ["player_key"], [F.desc("games"), F.desc_nulls_last("wins"), F.col("champion_name")], 3)


@query(f"""{FACTS_SQL} SELECT team_key, player_key, arg_max(role, (event_date, game_id, participant_id)) AS role, count(*) AS games FROM facts
WHERE team_key IS NOT NULL AND event_date BETWEEN DATE '{AS_OF}' - 90 AND DATE '{AS_OF}' - 1 GROUP BY 1, 2""")
def team_roster(spark, sf_dir):
    age = F.datediff(F.lit(AS_OF).cast("date"), F.col("event_date"))
    rows = facts(spark, sf_dir).where("team_key is not null").where(age.between(1, 90))
    return rows.groupBy("team_key", "player_key").agg(G.latest("role", "event_date", "game_id", "participant_id").alias("role"), F.count("*").alias("games"))


_OU = {"kills": 25.5, "dragons": 2.5, "towers": 5.5, "barons": 0.5, "inhibitors": 1.5}


@query(f"{GP.E_SQL} SELECT team_key, league_code, count(*) AS games, " + ", ".join(f"{_r2(f'avg({m})', m + '_mean')}, {_r2(f'avg(CASE WHEN {m} > {x} THEN 100.0 WHEN {m} IS NOT NULL THEN 0 END)', m + '_over_pct')}" for m, x in _OU.items()) + " FROM entrants GROUP BY 1, 2")
def over_under_rates(spark, sf_dir):
    out = R.over_under(GP.entrants(spark, sf_dir), _OU, ["team_key", "league_code"])
    return out.select("team_key", "league_code", "games", *[r2(f"{m}_{k}") for m in _OU for k in ("mean", "over_pct")])


_H2H = f"count(*) AS games, CAST(sum(team1_win) AS BIGINT) AS team1_wins, CAST(sum(team2_win) AS BIGINT) AS team2_wins, {_r2('avg(game_length_seconds)', 'mean_length')}, max(event_date) AS last_met FROM pairs"


@query(f"{GP.PAIRS_SQL} SELECT team1_key, team2_key, {_H2H} GROUP BY 1, 2")
def head_to_head_summary(spark, sf_dir):
    return R.head_to_head_summary(GP.pairs(spark, sf_dir)).withColumn("mean_length", r2("mean_length"))


@query(f"{GP.PAIRS_SQL} SELECT team1_key, team2_key, split_name, {_H2H} GROUP BY 1, 2, 3")
def head_to_head_by_split(spark, sf_dir):
    return R.head_to_head_summary(GP.pairs(spark, sf_dir), ("split_name",)).withColumn("mean_length", r2("mean_length"))


@query(f"""{FACTS_SQL} SELECT a.player_key AS p1, b.player_key AS p2, count(*) AS meetings, CAST(sum(a.win) AS BIGINT) AS p1_wins FROM facts a JOIN facts b ON a.game_id = b.game_id AND a.side <> b.side AND a.player_key < b.player_key GROUP BY 1, 2""")
def participant_head_to_head(spark, sf_dir):
    return R.participant_head_to_head(facts(spark, sf_dir))


@query(f"""{GP.E_SQL} SELECT game_id, side, team_key, win FROM entrants WHERE game_id IN (SELECT game_id FROM entrants WHERE team_key = 'team:T-ASIA' INTERSECT SELECT game_id FROM entrants WHERE team_key = 'team:T-EUROPE')""")
def common_games(spark, sf_dir):
    return R.common_games(GP.entrants(spark, sf_dir), "team:T-ASIA", "team:T-EUROPE").select("game_id", "side", "team_key", "win")


@query(f"""{GP.E_SQL} SELECT a.game_id, a.team_key, b.team_key AS opponent_key, a.win, row_number() OVER (PARTITION BY a.team_key ORDER BY a.event_date DESC, a.game_number DESC, a.game_id DESC)::INT AS rank
FROM entrants a LEFT JOIN entrants b ON a.game_id = b.game_id AND a.side <> b.side QUALIFY rank <= 10""")
def last_ten_games(spark, sf_dir):
    out = GP.B.with_opponent(GP.entrants(spark, sf_dir))
    return R.top_per(out, ["team_key"], [F.desc("event_date"), F.desc("game_number"), F.desc("game_id")], 10).select("game_id", "team_key", "opponent_key", "win", "rank")


@query(f"""{GP.PAIRS_SQL}, g AS (SELECT league_code, season_year, count(*) AS games, avg(game_length_seconds) AS l, avg(team1_kills + team2_kills) AS k FROM pairs GROUP BY 1, 2 HAVING count(*) >= 10)
SELECT league_code, season_year, games, {_r2("l", "mean_length")}, {_r2("k", "mean_kills")}, CASE WHEN k / (l / 60) >= 1.6 THEN 'frantic' WHEN k / (l / 60) >= 1.5 THEN 'fast' WHEN k / (l / 60) >= 1.4 THEN 'steady' ELSE 'slow' END AS tempo FROM g""")
def league_trends(spark, sf_dir):
    return R.league_trends(GP.pairs(spark, sf_dir)).select("league_code", "season_year", "games", r2("mean_length"), r2("mean_kills"), "tempo")


@query(f"""{GP.E_SQL} SELECT count(DISTINCT game_id) FILTER (event_date >= DATE '{AS_OF}' - 30) AS games_30d, count(DISTINCT game_id) FILTER (event_date >= DATE '{AS_OF}' - 90) AS games_90d,
count(DISTINCT team_key) FILTER (event_date >= DATE '{AS_OF}' - 90) AS teams_90d, count(DISTINCT league_code) FILTER (event_date >= DATE '{AS_OF}' - 90) AS leagues_90d, count(DISTINCT game_id) AS games, max(event_date) AS latest FROM entrants WHERE event_date < DATE '{AS_OF}'""")
def headline_metrics(spark, sf_dir):
    e = GP.entrants(spark, sf_dir).where(F.col("event_date") < F.lit(AS_OF).cast("date"))
    age = F.datediff(F.lit(AS_OF).cast("date"), F.col("event_date"))
    count = lambda c, days: F.countDistinct(F.when(age <= days, F.col(c)))
    return e.agg(count("game_id", 30).alias("games_30d"), count("game_id", 90).alias("games_90d"), count("team_key", 90).alias("teams_90d"), count("league_code", 90).alias("leagues_90d"), F.countDistinct("game_id").alias("games"), F.max("event_date").alias("latest"))


@query(f"{GP.E_SQL} SELECT league_code, season_year, count(DISTINCT game_id) AS games, count(DISTINCT team_key) AS teams FROM entrants GROUP BY 1, 2")
def league_filters(spark, sf_dir):
    return GP.entrants(spark, sf_dir).groupBy("league_code", "season_year").agg(F.countDistinct("game_id").alias("games"), F.countDistinct("team_key").alias("teams"))


@query(f"""{GP.E_SQL}, w AS (SELECT *, row_number() OVER (PARTITION BY team_key ORDER BY event_date DESC, game_number DESC, game_id DESC) AS back FROM entrants WHERE event_date < DATE '{AS_OF}' AND DATE '{AS_OF}' - event_date <= 365),
g AS (SELECT team_key, count(*) AS games, CAST(sum(win) AS BIGINT) AS wins, count(*) FILTER (back <= 5) AS last_games, CAST(sum(win) FILTER (back <= 5) AS BIGINT) AS last_wins FROM w GROUP BY 1),
p AS (SELECT *, floor((wins / games * 70 + last_wins / last_games * 30) * 100 + 0.5) / 100 AS power, CASE WHEN last_wins / last_games - wins / games >= 0.15 THEN 'rising' WHEN wins / games - last_wins / last_games >= 0.15 THEN 'falling' ELSE 'steady' END AS trend FROM g)
SELECT *, row_number() OVER (ORDER BY power DESC, games DESC, team_key)::INT AS rank FROM p""")
def power_rankings(spark, sf_dir):
    return R.power_rank(GP.entrants(spark, sf_dir), AS_OF)


@query(f"""{FACTS_SQL}, c AS (SELECT player_key, role, count(*) AS games, {_r2("avg(kills)", "mean_kills")} FROM facts GROUP BY 1, 2)
SELECT *, floor((rank() OVER (PARTITION BY role ORDER BY mean_kills) + (count(*) OVER (PARTITION BY role, mean_kills) - 1) / 2) / count(*) OVER (PARTITION BY role) * 1000 + 0.5) / 10 AS percentile FROM c""")
def role_percentiles(spark, sf_dir):
    c = facts(spark, sf_dir).groupBy("player_key", "role").agg(F.count("*").alias("games"), C.rounded(F.avg("kills"), 2).alias("mean_kills"))
    return R.role_percentiles(c, "mean_kills")


@query(f"""{FACTS_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY player_key ORDER BY event_date DESC, game_id DESC, participant_id DESC) AS back FROM facts),
g AS (SELECT player_key, count(*) FILTER (back <= 10) AS recent_games, count(*) FILTER (back > 10) AS previous_games, avg(CAST(floor(kda * 1000 + 0.5) AS BIGINT)) FILTER (back <= 10) / 1000 AS r, avg(CAST(floor(kda * 1000 + 0.5) AS BIGINT)) FILTER (back > 10) / 1000 AS p FROM b WHERE back <= 20 GROUP BY 1)
SELECT player_key, recent_games, previous_games, {_r2("r", "recent_kda")}, {_r2("p", "previous_kda")}, CASE WHEN r - p >= 1 THEN 'improving' WHEN r - p <= -1 THEN 'declining' WHEN r - p IS NULL THEN 'new' ELSE 'stable' END AS trend FROM g""")
def player_trend(spark, sf_dir):
    return R.recent_against_previous(facts(spark, sf_dir)).select("player_key", "recent_games", "previous_games", r2("recent_kda"), r2("previous_kda"), "trend")


@query(f"""{GP.E_SQL}, a AS (SELECT *, DATE '{AS_OF}' - event_date AS age FROM entrants),
g AS (SELECT team_key, count(*) FILTER (age <= 180) AS recent_games, count(*) FILTER (age > 180) AS previous_games, avg(win) FILTER (age <= 180) AS rr, avg(win) FILTER (age > 180) AS pr, avg(kills) FILTER (age <= 180) AS rk, avg(kills) FILTER (age > 180) AS pk FROM a WHERE age BETWEEN 1 AND 360 GROUP BY 1)
SELECT team_key, recent_games, previous_games, {_r2("rr", "recent_rate")}, {_r2("pr", "previous_rate")}, {_r2("rk", "recent_kills")}, {_r2("pk", "previous_kills")},
CASE WHEN rr - pr IS NULL THEN 'insufficient' WHEN rr - pr >= 0.1 THEN 'surging' WHEN rr - pr <= -0.1 THEN 'sliding' ELSE 'level' END AS label FROM g""")
def team_trend(spark, sf_dir):
    return R.team_trend(GP.entrants(spark, sf_dir), AS_OF).select("team_key", "recent_games", "previous_games", *map(r2, ("recent_rate", "previous_rate", "recent_kills", "previous_kills")), "label")


@query(f"""{GP.PAIRS_SQL}, s AS (SELECT game_id, CASE WHEN team1_win = 1 THEN team1_key ELSE team2_key END AS winner_key, (team1_kills - team2_kills) * CASE WHEN team1_win = 1 THEN 1 ELSE -1 END AS kill_diff,
(team1_gold - team2_gold) * CASE WHEN team1_win = 1 THEN 1 ELSE -1 END AS gold_diff, CASE WHEN team1_win = 1 THEN team1_towers ELSE team2_towers END AS wt, team1_towers + team2_towers AS tt, game_length_seconds AS len FROM pairs)
SELECT game_id, winner_key, kill_diff, gold_diff, CASE WHEN coalesce(tt, 0) = 0 THEN 0.0 ELSE floor(wt * 1000 / tt + 0.5) / 10 END AS tower_share_pct,
CASE WHEN kill_diff >= 20 AND len < 1800 THEN 'stomp' WHEN kill_diff >= 10 THEN 'controlled' WHEN kill_diff < 0 THEN 'comeback' ELSE 'close' END AS script,
CASE WHEN abs(gold_diff) >= 40000 THEN 'economy' WHEN abs(kill_diff) >= 15 THEN 'fights' WHEN abs(wt * 2 - tt) >= 6 THEN 'objectives' ELSE 'balanced' END AS decisive_edge FROM s""")
def game_summary(spark, sf_dir):
    return R.game_summary(GP.pairs(spark, sf_dir))


@query(f"""{FACTS_SQL}, s AS (SELECT game_id, role, side, sum(kills) AS k, sum(assists) AS a, sum(damage) AS d FROM facts GROUP BY 1, 2, 3),
p AS (SELECT b.game_id, b.role, (b.k - r.k) * 0.5::DOUBLE AS ek, (b.a - r.a) * 0.25::DOUBLE AS ea, (b.d - r.d) / 5000.0 AS ed FROM s b JOIN s r ON b.game_id = r.game_id AND b.role = r.role AND b.side = 'blue' AND r.side = 'red')
SELECT game_id, role, {_r2("ek + ea + ed", "edge")}, CASE WHEN ek + ea + ed >= 3 THEN 'blue' WHEN ek + ea + ed <= -3 THEN 'red' ELSE 'even' END AS lane_winner,
list_max([{{'s': abs(ek), 'n': 'kills'}}, {{'s': abs(ea), 'n': 'assists'}}, {{'s': abs(ed), 'n': 'damage'}}]).n AS top_driver FROM p""")
def lane_matchups(spark, sf_dir):
    return R.lane_matchups(facts(spark, sf_dir)).withColumn("edge", r2("edge"))


_ROSTER = f"""{GP.SERIES_SQL},{GP.S.participants_sql()}, sg AS (SELECT series_key, event_date AS d, unnest(game_ids) AS game_id FROM series),
pl AS (SELECT series_key, d AS event_date, e.team_key, p.player_key, count(*) AS n FROM participants p JOIN sg ON sg.game_id = p.game_id JOIN entrants e ON e.game_id = p.game_id AND e.side = p.side GROUP BY ALL),
top AS (SELECT * FROM pl QUALIFY row_number() OVER (PARTITION BY series_key, team_key ORDER BY n DESC, player_key) <= 5),
rosters AS (SELECT series_key, event_date, team_key, list_sort(list(player_key)) AS roster FROM top GROUP BY 1, 2, 3)"""


def rosters(spark, sf_dir):
    games = GP.series(spark, sf_dir).select("series_key", F.col("event_date").alias("d"), F.explode("game_ids").alias("game_id"))
    return R.series_rosters(facts(spark, sf_dir).drop("event_date"), games.withColumnRenamed("d", "event_date"))


@query(f"{_ROSTER} SELECT series_key, team_key, array_to_string(roster, ',') AS roster FROM rosters")
def series_rosters(spark, sf_dir):
    return rosters(spark, sf_dir).select("series_key", "team_key", F.array_join("roster", ",").alias("roster"))


_OV = ", ".join(f"CASE WHEN lag(roster, {i}) OVER w IS NOT NULL THEN len(list_intersect(roster, lag(roster, {i}) OVER w)) END AS o{i}" for i in (1, 2, 3))


@query(f"""{_ROSTER}, o AS (SELECT series_key, team_key, {_OV} FROM rosters WINDOW w AS (PARTITION BY team_key ORDER BY event_date, series_key))
SELECT series_key, team_key, CAST(o1 AS INT) AS overlap_previous, {_r2("(coalesce(o1, 0) + coalesce(o2, 0) + coalesce(o3, 0)) / nullif((o1 IS NOT NULL)::INT + (o2 IS NOT NULL)::INT + (o3 IS NOT NULL)::INT, 0)", "overlap_mean")} FROM o""")
def roster_overlap(spark, sf_dir):
    return R.roster_overlap(rosters(spark, sf_dir)).select("series_key", "team_key", "overlap_previous", r2("overlap_mean"))


@query(f"""{FACTS_SQL}, g AS (SELECT team_key, event_date, game_id, list(champion_name) AS picks FROM facts WHERE team_key IS NOT NULL GROUP BY 1, 2, 3),
n AS (SELECT *, row_number() OVER (PARTITION BY team_key ORDER BY event_date, game_id) AS i FROM g),
x AS (SELECT team_key, i, unnest(picks) AS c FROM n),
d AS (SELECT n.team_key, n.game_id, x.c, count(*) AS k, count(*) FILTER (n.i - x.i <= 10) AS k10 FROM n JOIN x ON x.team_key = n.team_key AND x.i BETWEEN n.i - 25 AND n.i - 1 GROUP BY 1, 2, 3),
t AS (SELECT *, row_number() OVER (PARTITION BY team_key, game_id ORDER BY k DESC, c) AS r FROM d),
s AS (SELECT team_key, game_id, count(*) FILTER (k10 > 0) AS u10, count(*) AS u25, sum(k) FILTER (r <= 5) / sum(k) AS share FROM t GROUP BY 1, 2)
SELECT n.team_key, n.game_id, CAST(coalesce(u10, 0) AS INT) AS unique_10, CAST(coalesce(u25, 0) AS INT) AS unique_25, {_r2("coalesce(share, 0)", "top5_share")} FROM n LEFT JOIN s USING (team_key, game_id)""")
def draft_pool(spark, sf_dir):
    return R.draft_pool(facts(spark, sf_dir)).select("team_key", "game_id", "unique_10", "unique_25", r2("top5_share"))


@query(f"""{FACTS_SQL}, c AS (SELECT player_key, count(*) AS games, {_r2(f"{_KDA}", "value")} FROM facts GROUP BY 1 HAVING count(*) >= 20) SELECT *, row_number() OVER (ORDER BY value DESC, player_key)::INT AS rank FROM c ORDER BY rank LIMIT 25""")
def player_rankings(spark, sf_dir):
    c = facts(spark, sf_dir).groupBy("player_key").agg(F.count("*").alias("games"), C.rounded(R.exact_mean(F.col("kda")), 2).alias("value")).where("games >= 20")
    top = c.orderBy(F.desc("value"), "player_key").limit(25)  # a top-k report: 25 rows are ranked
    return top.withColumn("rank", F.row_number().over(R.W.orderBy(F.desc("value"), "player_key")))


@query(f"{GP.SERIES_SQL} SELECT series_key, event_date, league_code, score FROM series ORDER BY event_date DESC, series_key DESC LIMIT 40")
def recent_series(spark, sf_dir):
    return GP.series(spark, sf_dir).orderBy(F.desc("event_date"), F.desc("series_key")).limit(40).select("series_key", "event_date", "league_code", "score")


@query(f"""{GP.E_SQL} SELECT regexp_replace(lower(team_name), '[^a-z0-9]+', '', 'g') AS folded, arg_max(team_key, (event_date, game_number, side)) AS team_key, count(*) AS games FROM entrants WHERE contains(lower(team_name), 'a') GROUP BY 1""")
def team_search(spark, sf_dir):
    e = GP.entrants(spark, sf_dir).where(F.lower("team_name").contains("a")).withColumn("folded", C.normalise(F.col("team_name")))
    return e.groupBy("folded").agg(G.latest("team_key", "event_date", "game_number", "side").alias("team_key"), F.count("*").alias("games"))
