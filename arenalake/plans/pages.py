"""Queries: joined report parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from arenalake.functions import columns as C
from arenalake.operators import features as X
from arenalake.operators import pages as P
from arenalake.plans import gold as GP
from arenalake.plans import reports as RP
from arenalake.plans.registry import query
from arenalake.sources.standin import table


@query(f"""{GP.PAIRS_SQL}, a AS (SELECT *, DATE '{RP.AS_OF}' - event_date AS age FROM entrants), g AS (SELECT team_key, avg(win) FILTER (age <= 180) AS rr, avg(win) FILTER (age > 180) AS pr FROM a WHERE age BETWEEN 1 AND 360 GROUP BY 1),
t AS (SELECT team_key, rr, CASE WHEN rr - pr IS NULL THEN 'insufficient' WHEN rr - pr >= 0.1 THEN 'surging' WHEN rr - pr <= -0.1 THEN 'sliding' ELSE 'level' END AS label FROM g)
SELECT team1_key, team2_key, x.label AS team1_label, y.label AS team2_label, CASE WHEN x.rr - y.rr >= 0.05 THEN 'team1' WHEN x.rr - y.rr <= -0.05 THEN 'team2' WHEN x.rr - y.rr IS NULL THEN 'unknown' ELSE 'even' END AS edge
FROM (SELECT DISTINCT team1_key, team2_key FROM pairs) LEFT JOIN t x ON x.team_key = team1_key LEFT JOIN t y ON y.team_key = team2_key""")
def game_backdrop(spark, sf_dir):
    return P.game_backdrop(GP.pairs(spark, sf_dir), GP.entrants(spark, sf_dir), RP.AS_OF).drop("team1_rate", "team2_rate")


@query(f"""{RP.FACTS_SQL}, t AS (SELECT team_key, game_id, sum(kills) AS tk FROM facts WHERE team_key IS NOT NULL GROUP BY 1, 2),
p AS (SELECT f.team_key, player_key, count(DISTINCT f.game_id) AS games, CAST(sum(kills) AS BIGINT) AS kills, CAST(sum(tk) AS BIGINT) AS team_kills FROM facts f JOIN t ON t.team_key = f.team_key AND t.game_id = f.game_id GROUP BY 1, 2 HAVING count(DISTINCT f.game_id) >= 5)
SELECT *, floor(kills * 1000 / team_kills + 0.5) / 10 AS kill_share_pct FROM p""")
def player_impact(spark, sf_dir):
    return P.player_impact(RP.facts(spark, sf_dir))


_SHEET = """s AS (SELECT o_orderkey AS match_id, CASE WHEN o_orderkey % 11 <> 0 THEN CASE WHEN o_orderkey % 13 = 0 THEN 1.0 ELSE 1.5 END END::DOUBLE AS team1_odds, 2.5::DOUBLE AS team2_odds FROM orders),
p AS (SELECT o_orderkey AS match_id, (1 + o_orderkey % 63) / 64.0::DOUBLE AS p FROM orders WHERE o_orderkey % 5 <> 0)"""


def sheet(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    odds = F.when(k % 11 != 0, F.when(k % 13 == 0, 1.0).otherwise(1.5))
    return o.select(k.alias("match_id"), odds.alias("team1_odds"), F.lit(2.5).alias("team2_odds")), o.where(k % 5 != 0).select(k.alias("match_id"), ((1 + k % 63) / 64.0).alias("p"))


@query(f"""WITH {_SHEET} SELECT match_id, CASE WHEN team1_odds IS NULL THEN 'missing odds' WHEN team1_odds <= 1 THEN 'odds must exceed 1' WHEN p IS NULL THEN 'no prediction' END AS score_error,
team1_odds > 1 AND p IS NOT NULL AND team1_odds IS NOT NULL AS score_available, CASE WHEN team1_odds > 1 THEN floor((p * team1_odds - 1) * 10000 + 0.5) / 10000 END AS ev FROM s LEFT JOIN p USING (match_id)""")
def scored_sheet(spark, sf_dir):
    out = P.score_sheet(*sheet(spark, sf_dir))
    return out.select("match_id", "score_error", "score_available", C.rounded(F.col("ev"), 4).alias("ev"))


@query(f"WITH {_SHEET} SELECT match_id, team1_odds, p FROM s LEFT JOIN p USING (match_id) WHERE match_id % 2 = 0")
def upcoming_with_predictions(spark, sf_dir):
    s, p = sheet(spark, sf_dir)
    return P.with_predictions(s.where("match_id % 2 = 0"), p).select("match_id", "team1_odds", "p")


@query("""WITH h AS (SELECT o_orderkey AS match_id, 'kills' AS market, 0.5::DOUBLE AS over FROM orders), m AS (SELECT o_orderkey AS match_id, 'kills' AS market, (o_orderkey % 9) / 10.0::DOUBLE AS over FROM orders WHERE o_orderkey % 3 = 0)
SELECT match_id, market, coalesce(m.over, h.over) AS over, CASE WHEN m.over IS NOT NULL THEN 'model' ELSE 'heuristic' END AS source FROM h LEFT JOIN m USING (match_id, market)""")
def quotes_with_fallback(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(k.alias("match_id"), F.lit("kills").alias("market"), F.lit(0.5).alias("over"))
    return X.quotes_with_fallback(o.where("match_id % 3 = 0").withColumn("over", F.col("match_id") % 9 / 10.0), o)


@query(f"{GP.E_SQL} SELECT game_id, side, team_key, win FROM entrants WHERE game_number IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def match_lookup(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("game_number"))
    return P.lookup(GP.entrants(spark, sf_dir), "game_number", wanted).select("game_id", "side", "team_key", "win")


@query(f"""{GP.EP_SQL} SELECT 'entrants' AS source, count(*) AS rows, max(event_date) AS latest, '["' || array_to_string(list_sort(list(DISTINCT league_code)), '","') || '"]' AS leagues_json FROM entrants
UNION ALL SELECT 'participants', count(*), max(event_date), '["' || array_to_string(list_sort(list(DISTINCT league_code)), '","') || '"]' FROM participants""")
def source_metadata(spark, sf_dir):
    return P.source_metadata({"entrants": (GP.entrants(spark, sf_dir), "event_date"), "participants": (GP.participants(spark, sf_dir), "event_date")})


@query(f"{GP.SERIES_SQL} SELECT league_code, season_year, count(*) AS series, CAST(sum(games) AS BIGINT) AS games, count(DISTINCT winner_key) AS winners, count(*) FILTER (winner_key IS NULL) AS draws FROM series WHERE playoffs = 1 GROUP BY 1, 2")
def tournament_results(spark, sf_dir):
    s = GP.series(spark, sf_dir).where("playoffs = 1")
    return s.groupBy("league_code", "season_year").agg(F.count("*").alias("series"), F.sum("games").alias("games"), F.countDistinct("winner_key").alias("winners"), F.count(F.when(F.col("winner_key").isNull(), 1)).alias("draws"))
