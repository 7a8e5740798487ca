"""Queries: reconciliation with schedules, and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from arenalake.functions import columns as C
from arenalake.operators import quality as Q
from arenalake.operators import reconcile as R
from arenalake.plans import gold as GP
from arenalake.plans.registry import query

CORE = ["AUTOMOBILE", "BUILDING", "MACHINERY"]

# Stand-in schedules are daily series sampled by the smallest game number: 80% official, 70% wiki.
_SCHEDULE_SQL = f"""{GP.DAILY_SQL},
base AS (
  SELECT 'series:' || league_code || ':' || event_date || ':' || team1_key || ':' || team2_key AS series_key, league_code, event_date,
    regexp_replace(lower(team1_key), '[^a-z0-9]+', '', 'g') AS name1, regexp_replace(lower(team2_key), '[^a-z0-9]+', '', 'g') AS name2,
    CASE WHEN games = 1 THEN 1 WHEN games <= 3 THEN 3 ELSE 5 END AS best_of, team1_wins AS wins1, team2_wins AS wins2,
    CAST(substr(game_ids[1], 2) AS BIGINT) AS n FROM daily
),
official AS (SELECT 'M' || n AS match_id, event_date + CAST(n % 24 AS INT) * INTERVAL 1 HOUR AS start_time, event_date, league_code, name1, name2, CASE WHEN n % 9 = 0 THEN NULL ELSE best_of END AS best_of FROM base WHERE n % 10 < 8),
wiki AS (SELECT 'W' || n AS wiki_id, event_date + CAST(n % 2 AS INT) AS event_date, name1, name2, greatest(wins1, wins2) + CASE WHEN n % 13 = 0 THEN 1 ELSE 0 END AS winner_wins, least(wins1, wins2) AS loser_wins FROM base WHERE n % 10 < 7),
with_official AS (
  SELECT b.*, match_id FROM base b LEFT JOIN official o ON b.event_date = o.event_date AND b.league_code = o.league_code
    AND least(b.name1, b.name2) = least(o.name1, o.name2) AND greatest(b.name1, b.name2) = greatest(o.name1, o.name2) AND (b.best_of IS NULL OR o.best_of IS NULL OR b.best_of = o.best_of)
  QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY start_time NULLS LAST, match_id NULLS LAST) = 1
),
nearest AS (
  SELECT b.series_key, wiki_id, abs(w.event_date - b.event_date) AS days_apart, count(*) OVER (PARTITION BY b.series_key) AS candidates, winner_wins, loser_wins
  FROM base b JOIN wiki w ON least(b.name1, b.name2) = least(w.name1, w.name2) AND greatest(b.name1, b.name2) = greatest(w.name1, w.name2) AND abs(w.event_date - b.event_date) <= 1
  QUALIFY row_number() OVER (PARTITION BY b.series_key ORDER BY abs(w.event_date - b.event_date), wiki_id) = 1
),
reconciled AS (
  SELECT o.*, wiki_id, days_apart, candidates, CASE WHEN match_id IS NOT NULL AND wiki_id IS NOT NULL THEN 'both' WHEN match_id IS NOT NULL THEN 'official_only' WHEN wiki_id IS NOT NULL THEN 'wiki_only' ELSE 'unmatched' END AS status,
    CASE WHEN wiki_id IS NOT NULL THEN greatest(wins1, wins2) = winner_wins AND least(wins1, wins2) = loser_wins END AS score_agrees,
    coalesce(NOT (greatest(wins1, wins2) = winner_wins AND least(wins1, wins2) = loser_wins), false) AS score_conflict
  FROM with_official o LEFT JOIN nearest n USING (series_key)
)"""


def schedules(spark, sf_dir):
    daily = GP.G.daily_series(GP.pairs(spark, sf_dir))
    n = F.substring(F.col("game_ids")[0], 2, 20).cast("bigint")
    best = F.when(F.col("games") == 1, 1).when(F.col("games") <= 3, 3).otherwise(5)
    base = daily.select(
        F.concat_ws(":", F.lit("series"), "league_code", "event_date", "team1_key", "team2_key").alias("series_key"), "league_code", "event_date",
        C.normalise(F.col("team1_key")).alias("name1"), C.normalise(F.col("team2_key")).alias("name2"), best.alias("best_of"),
        F.col("team1_wins").alias("wins1"), F.col("team2_wins").alias("wins2"), n.alias("n"),
    )
    start = F.col("event_date").cast("timestamp") + F.make_dt_interval(hours=(F.col("n") % 24).cast("int"))
    official = base.where("n % 10 < 8").select(F.concat(F.lit("M"), "n").alias("match_id"), start.alias("start_time"), "event_date", "league_code", "name1", "name2", F.when(F.col("n") % 9 != 0, F.col("best_of")).alias("best_of"))
    wiki = base.where("n % 10 < 7").select(
        F.concat(F.lit("W"), "n").alias("wiki_id"), F.date_add("event_date", (F.col("n") % 2).cast("int")).alias("event_date"), "name1", "name2",
        (F.greatest("wins1", "wins2") + F.when(F.col("n") % 13 == 0, 1).otherwise(0)).alias("winner_wins"), F.least("wins1", "wins2").alias("loser_wins"),
    )
    return base, official, wiki


def reconciled(spark, sf_dir):
    return R.reconciliation(*schedules(spark, sf_dir))


@query(f"{_SCHEDULE_SQL} SELECT series_key, match_id FROM with_official")
def official_match(spark, sf_dir):
    base, official, _ = schedules(spark, sf_dir)
    return R.match_official(base, official).select("series_key", "match_id")


@query(f"{_SCHEDULE_SQL} SELECT b.series_key, wiki_id, CAST(days_apart AS INT) AS days_apart, candidates FROM base b LEFT JOIN nearest USING (series_key)")
def wiki_match(spark, sf_dir):
    base, _, wiki = schedules(spark, sf_dir)
    return R.match_wiki(base, wiki).select("series_key", "wiki_id", "days_apart", "candidates")


@query(f"{_SCHEDULE_SQL} SELECT series_key, match_id, wiki_id, status, score_agrees, score_conflict FROM reconciled")
def external_reconciliation(spark, sf_dir):
    return reconciled(spark, sf_dir).select("series_key", "match_id", "wiki_id", "status", "score_agrees", "score_conflict")


_COVER = "count(*) AS series, count(match_id) AS official, count(wiki_id) AS wiki, count(*) FILTER (score_conflict) AS conflicts FROM reconciled"


@query(f"{_SCHEDULE_SQL} SELECT league_code, {_COVER} GROUP BY 1 UNION ALL SELECT 'ALL', {_COVER}")
def source_coverage(spark, sf_dir):
    return R.source_coverage(reconciled(spark, sf_dir))


@query(f"""{_SCHEDULE_SQL}, span AS (SELECT league_code, min(event_date) + 30 AS first_day, max(event_date) - 30 AS last_day FROM official GROUP BY 1)
SELECT b.series_key, coalesce(b.event_date BETWEEN first_day AND last_day, false) AS covered FROM base b LEFT JOIN span USING (league_code)""")
def coverage_interval(spark, sf_dir):
    base, official, _ = schedules(spark, sf_dir)
    span = official.groupBy("league_code").agg(F.date_add(F.min("event_date"), 30).alias("first_day"), F.date_sub(F.max("event_date"), 30).alias("last_day"))
    return R.attach_coverage(base, span).select("series_key", "covered")


@query(f"""{_SCHEDULE_SQL} SELECT series_key, league_code, CASE WHEN wins1 > wins2 THEN 1 ELSE 0 END AS label_team1_win FROM reconciled
WHERE league_code IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY') AND wins1 <> wins2 AND status <> 'unmatched'""")
def model_core_series(spark, sf_dir):
    return R.model_core(reconciled(spark, sf_dir), CORE).select("series_key", "league_code", "label_team1_win")


ALIASES = [("supplier000000003", "supplier000000004"), ("bestsupplier", "supplier000000005")]


@query("""WITH q AS (SELECT c_custkey AS query_id, CASE c_custkey % 4 WHEN 0 THEN 'Supplier#' || lpad(CAST(c_custkey % 150 AS VARCHAR), 9, '0') WHEN 1 THEN 'Best-Supplier' WHEN 2 THEN 'The ' || 'SUPPLIER#' || lpad(CAST(c_custkey % 150 AS VARCHAR), 9, '0') ELSE 'Supplier' END AS name FROM customer),
n AS (SELECT query_id, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS norm FROM q),
k AS (SELECT DISTINCT s_suppkey AS entity_key, regexp_replace(lower(s_name), '[^a-z0-9]+', '', 'g') AS k_norm FROM supplier),
a(alias, canonical) AS (VALUES ('supplier000000003', 'supplier000000004'), ('bestsupplier', 'supplier000000005')),
f AS (SELECT query_id, entity_key, 1 AS step FROM n JOIN k ON norm = k_norm UNION ALL SELECT query_id, entity_key, 2 FROM n JOIN a ON norm = alias JOIN k ON canonical = k_norm
  UNION ALL SELECT query_id, entity_key, 3 FROM n JOIN k ON contains(norm, k_norm) OR contains(k_norm, norm)),
b AS (SELECT query_id, step, count(DISTINCT entity_key) AS c, min(entity_key) AS entity_key FROM (SELECT *, min(step) OVER (PARTITION BY query_id) AS first FROM f) WHERE step = first GROUP BY 1, 2)
SELECT q.query_id, CASE WHEN c = 1 THEN entity_key END AS entity_key, CASE WHEN c > 1 THEN 'ambiguous' WHEN step = 1 THEN 'exact' WHEN step = 2 THEN 'alias' WHEN step = 3 THEN 'contains' ELSE 'unknown' END AS status
FROM q LEFT JOIN b USING (query_id)""")
def entity_resolution(spark, sf_dir):
    t = lambda n: GP.S.table(spark, sf_dir, n)
    key = F.col("c_custkey")
    code = F.lpad((key % 150).cast("string"), 9, "0")
    name = F.when(key % 4 == 0, F.concat(F.lit("Supplier#"), code)).when(key % 4 == 1, "Best-Supplier").when(key % 4 == 2, F.concat(F.lit("The SUPPLIER#"), code)).otherwise("Supplier")
    return R.resolve_names(t("customer").select(key.alias("query_id"), name.alias("name")), t("supplier").select(F.col("s_suppkey").alias("entity_key"), F.col("s_name").alias("name")), spark.createDataFrame(ALIASES, "alias string, canonical string"))


@query(f"""{GP.E_SQL}, a(alias, canonical) AS (VALUES ('middleeast', 'mideast'), ('america', 'americas'))
SELECT game_id, side, coalesce(canonical, regexp_replace(lower(team_name), '[^a-z0-9]+', '', 'g')) AS team_canonical FROM entrants LEFT JOIN a ON alias = regexp_replace(lower(team_name), '[^a-z0-9]+', '', 'g')""")
def alias_canonicalisation(spark, sf_dir):
    aliases = spark.createDataFrame([("middleeast", "mideast"), ("america", "americas")], "alias string, canonical string")
    return R.with_aliases(GP.entrants(spark, sf_dir), "team_name", aliases, "team_canonical").select("game_id", "side", "team_canonical")


# Data quality.

_CHECK = "SELECT '{n}' AS check_name, '{s}' AS severity, count(*) FILTER ({c}) AS failing, count(*) AS total, {t}::DOUBLE AS threshold_pct FROM {f}"
_PCT = "SELECT *, failing_pct <= threshold_pct AS passed FROM (SELECT *, CASE WHEN total = 0 THEN 0.0 ELSE floor(failing * 10000.0 / total + 0.5) / 100 END::DOUBLE AS failing_pct FROM ({}))"
_MISSING = [("missing_team_id", "error", "team_id IS NULL", 10), ("missing_split", "warning", "split_name IS NULL", 5), ("missing_dragons", "warning", "dragons IS NULL", 5), ("missing_date", "error", "event_date IS NULL", 0)]


@query(f"{GP.E_SQL} " + _PCT.format(" UNION ALL ".join(_CHECK.format(n=n, s=s, c=c, t=t, f="entrants") for n, s, c, t in _MISSING)))
def quality_missing_values(spark, sf_dir):
    return Q.check_rows(GP.entrants(spark, sf_dir), {n: (s, F.expr(c), t) for n, s, c, t in _MISSING})


@query(f"""{GP.EP_SQL}, shape AS (SELECT game_id, count(*) AS sides FROM entrants GROUP BY 1), people AS (SELECT game_id, count(*) AS people FROM participants GROUP BY 1)
SELECT game_id, sides, coalesce(people, 0) AS people, sides = 2 AND coalesce(people, 0) = 10 AS shape_ok FROM shape LEFT JOIN people USING (game_id)""")
def quality_game_shape(spark, sf_dir):
    return Q.game_shape(GP.entrants(spark, sf_dir), GP.participants(spark, sf_dir))


@query("SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def quality_duplicate_grain(spark, sf_dir):
    return Q.duplicates(GP.S.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(f"{GP.P_SQL} SELECT game_id, player_key, count(DISTINCT side) AS sides FROM participants GROUP BY 1, 2 HAVING count(DISTINCT side) > 1")
def quality_both_sides(spark, sf_dir):
    return Q.same_key_both_sides(GP.participants(spark, sf_dir))


_COVERAGE = [("official_coverage", "warning", "match_id IS NULL", 25), ("wiki_coverage", "warning", "wiki_id IS NULL", 25), ("score_conflicts", "error", "score_conflict", 5)]


@query(f"{_SCHEDULE_SQL} " + _PCT.format(" UNION ALL ".join(_CHECK.format(n=n, s=s, c=c, t=t, f="reconciled") for n, s, c, t in _COVERAGE)))
def quality_reconciliation(spark, sf_dir):
    return Q.check_rows(reconciled(spark, sf_dir), {n: (s, F.expr(c), t) for n, s, c, t in _COVERAGE})


@query(f"""{GP.EP_SQL}
SELECT 'missing_team_id' AS issue_type, game_id AS entity, team_name AS detail FROM entrants WHERE team_id IS NULL
UNION ALL SELECT 'missing_split', game_id, league_code FROM entrants WHERE split_name IS NULL
UNION ALL SELECT 'missing_player_id', game_id, player_name FROM participants WHERE player_id IS NULL
UNION ALL SELECT 'both_sides', game_id, player_key FROM participants GROUP BY game_id, player_key HAVING count(DISTINCT side) > 1
UNION ALL SELECT 'game_shape', game_id, 'sides ' || count(*) FROM entrants GROUP BY game_id HAVING count(*) <> 2""")
def quality_issue_rows(spark, sf_dir):
    e, p = GP.entrants(spark, sf_dir), GP.participants(spark, sf_dir)
    return Q.issue_rows({
        "missing_team_id": (e.where("team_id is null"), "game_id", F.col("team_name")), "missing_split": (e.where("split_name is null"), "game_id", F.col("league_code")),
        "missing_player_id": (p.where("player_id is null"), "game_id", F.col("player_name")), "both_sides": (Q.same_key_both_sides(p), "game_id", F.col("player_key")),
        "game_shape": (e.groupBy("game_id").agg(F.count("*").alias("n")).where("n <> 2"), "game_id", F.concat(F.lit("sides "), F.col("n").cast("string"))),
    })
