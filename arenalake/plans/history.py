"""Queries: history strictly before an event, rolling features, ratings."""

from __future__ import annotations

from pyspark.sql import functions as F

from arenalake.functions import columns as C
from arenalake.operators import history as H
from arenalake.plans import gold as GP
from arenalake.plans.registry import query
from arenalake.sources.files import materialise, scratch_dir
from arenalake.streaming import jobs

_SIDE = "game_id, game_number, league_code, season_year, split_name, patch_version, event_date, game_length_seconds"


def _sides_sql(grain: str) -> str:
    return f"""WITH {GP.S.entrants_sql(grain)},{GP.B.PAIRS_SQL},
sides AS (
  SELECT {_SIDE}, 1 AS slot, team1_key AS team_key, team1_win AS win, team1_kills AS kills, team2_key AS opponent_key, team2_kills AS kills_against FROM pairs
  UNION ALL SELECT {_SIDE}, 2, team2_key, team2_win, team2_kills, team1_key, team1_kills FROM pairs
)"""


SIDES_SQL = _sides_sql("nation")
ROUND = "floor({} * 10000 + 0.5) / 10000"


def r4(c):
    return C.rounded(F.col(c), 4).alias(c)


def sides(spark, sf_dir, grain="nation"):
    return H.sides(GP.pairs(spark, sf_dir, grain))


def _prior_sql(keys: str) -> str:
    on = " AND ".join(f"p.{k} IS NOT DISTINCT FROM s.{k}" for k in keys.split(", "))
    return f"""{SIDES_SQL} SELECT s.game_id, s.team_key, count(p.game_id) AS prior_games, CAST(coalesce(sum(p.win), 0) AS BIGINT) AS prior_wins,
CAST(s.event_date - max(p.event_date) AS INT) AS prior_days_since, {ROUND.format("CASE WHEN count(p.game_id) = 0 THEN 0.5 ELSE sum(p.win) / count(p.game_id) END")} AS prior_win_rate
FROM sides s LEFT JOIN sides p ON {on} AND p.event_date < s.event_date GROUP BY s.game_id, s.team_key, s.event_date"""


_PRIOR = ("game_id", "team_key", "prior_games", "prior_wins", "prior_days_since")


@query(_prior_sql("team_key"))
def prior_form(spark, sf_dir):
    return H.prior_totals(sides(spark, sf_dir), ["team_key"]).select(*_PRIOR, r4("prior_win_rate"))


@query(_prior_sql("team_key, patch_version"))
def prior_form_by_patch(spark, sf_dir):
    return H.prior_totals(sides(spark, sf_dir), ["team_key", "patch_version"]).select(*_PRIOR, r4("prior_win_rate"))


@query(_prior_sql("team_key, split_name"))
def prior_form_by_split(spark, sf_dir):
    return H.prior_totals(sides(spark, sf_dir), ["team_key", "split_name"]).select(*_PRIOR, r4("prior_win_rate"))


@query(f"""{SIDES_SQL}, prior AS (
  SELECT s.game_id, s.team_key, p.win, row_number() OVER (PARTITION BY s.game_id, s.team_key ORDER BY p.event_date DESC, p.game_number DESC, p.game_id DESC) AS back
  FROM sides s JOIN sides p ON p.team_key = s.team_key AND p.event_date < s.event_date
), summed AS (
  SELECT game_id, team_key, count(*) AS n_prior, sum(win) FILTER (back <= 5) AS w5, arg_min(win, back) AS last_win, min(back) FILTER (win = 1) AS first_win, min(back) FILTER (win = 0) AS first_loss FROM prior GROUP BY 1, 2
)
SELECT s.game_id, s.team_key, coalesce(n_prior, 0) AS n_prior, {ROUND.format("CASE WHEN n_prior IS NULL THEN 0.5 ELSE w5 / least(n_prior, 5) END")} AS recent_rate,
  CAST(CASE WHEN n_prior IS NULL THEN 0 WHEN last_win = 1 THEN coalesce(first_loss - 1, n_prior) ELSE -coalesce(first_win - 1, n_prior) END AS INT) AS streak
FROM sides s LEFT JOIN summed USING (game_id, team_key)""")
def recent_form_and_streak(spark, sf_dir):
    return H.recent_and_streak(sides(spark, sf_dir)).select("game_id", "team_key", "n_prior", r4("recent_rate"), F.col("streak").cast("int").alias("streak"))


_SERIES_SIDES = f"""{GP.SERIES_SQL}, ss AS (SELECT series_key, event_date, team1_key AS team_key, CASE WHEN winner_key IS NOT NULL THEN (winner_key = team1_key)::INT END AS win FROM series UNION ALL SELECT series_key, event_date, team2_key, CASE WHEN winner_key IS NOT NULL THEN (winner_key = team2_key)::INT END FROM series),
prior AS (SELECT s.series_key, s.team_key, p.win, p.event_date, row_number() OVER (PARTITION BY s.series_key, s.team_key ORDER BY p.event_date DESC, p.series_key DESC) AS back FROM ss s JOIN ss p ON p.team_key = s.team_key AND p.event_date < s.event_date AND p.win IS NOT NULL),
summed AS (SELECT series_key, team_key, count(*) AS n, sum(win) AS w, max(event_date) AS last, sum(win) FILTER (back <= 5) AS w5, arg_min(win, back) AS last_win, min(back) FILTER (win = 1) AS first_win, min(back) FILTER (win = 0) AS first_loss FROM prior GROUP BY 1, 2)"""


@query(f"""{_SERIES_SIDES} SELECT s.series_key, s.team_key, coalesce(n, 0) AS prior_series, CAST(coalesce(w, 0) AS BIGINT) AS prior_series_wins, {ROUND.format("CASE WHEN n IS NULL THEN 0.5 ELSE w / n END")} AS prior_series_win_rate, CAST(s.event_date - last AS INT) AS days_since_last_series,
{ROUND.format("CASE WHEN n IS NULL THEN 0.5 ELSE w5 / least(n, 5) END")} AS recent5_series_win_rate, CAST(CASE WHEN n IS NULL THEN 0 WHEN last_win = 1 THEN coalesce(first_loss - 1, n) ELSE -coalesce(first_win - 1, n) END AS INT) AS series_streak FROM ss s LEFT JOIN summed USING (series_key, team_key)""")
def series_prior_form(spark, sf_dir):
    """Prior totals, last five and streak at the grain of series; draws look back like others and are seen by none."""
    rows = GP.G.series_sides(GP.series(spark, sf_dir)).withColumns({"game_id": F.col("series_key"), "game_number": F.lit(0)})
    out = H.recent_and_streak(H.prior_totals(rows, ["team_key"], "prior_series"))
    names = {"prior_series_games": "prior_series", "prior_series_days_since": "days_since_last_series", "recent_rate": "recent5_series_win_rate", "streak": "series_streak"}
    return out.withColumnsRenamed(names).select("series_key", "team_key", "prior_series", "prior_series_wins", r4("prior_series_win_rate"), "days_since_last_series", r4("recent5_series_win_rate"), F.col("series_streak").cast("int").alias("series_streak"))


_NPAIRS = f"WITH {GP.S.entrants_sql('nation')},{GP.B.PAIRS_SQL}"


@query(f"""{_NPAIRS} SELECT s.game_id, count(p.game_id) AS h2h_games, CAST(coalesce(sum(p.team1_win), 0) AS BIGINT) AS h2h_team1_wins,
{ROUND.format("CASE WHEN count(p.game_id) = 0 THEN 0.5 ELSE sum(p.team1_win) / count(p.game_id) END")} AS h2h_team1_rate
FROM pairs s LEFT JOIN pairs p ON p.team1_key = s.team1_key AND p.team2_key = s.team2_key AND p.event_date < s.event_date GROUP BY 1""")
def head_to_head_before(spark, sf_dir):
    return H.head_to_head(GP.pairs(spark, sf_dir, "nation")).select("game_id", "h2h_games", "h2h_team1_wins", r4("h2h_team1_rate"))


@query(f"""{_NPAIRS}, side AS (SELECT game_id, event_date, team1_key AS team_key, team1_win AS win FROM pairs UNION ALL SELECT game_id, event_date, team2_key, team2_win FROM pairs),
form AS (SELECT s.game_id, s.team_key, count(p.game_id) AS n, coalesce(sum(p.win), 0) AS w FROM side s LEFT JOIN side p ON p.team_key = s.team_key AND p.event_date < s.event_date GROUP BY 1, 2),
h AS (SELECT s.game_id, count(p.game_id) AS n, coalesce(sum(p.team1_win), 0) AS w FROM pairs s LEFT JOIN pairs p ON p.team1_key = s.team1_key AND p.team2_key = s.team2_key AND p.event_date < s.event_date GROUP BY 1)
SELECT g.game_id, g.team1_key, g.team2_key, a.n AS team1_prior_games, b.n AS team2_prior_games,
  floor((CASE WHEN a.n = 0 THEN 0.5 ELSE a.w / a.n END - CASE WHEN b.n = 0 THEN 0.5 ELSE b.w / b.n END) * 10000 + 0.5) / 10000 AS diff_win_rate,
  h.n AS h2h_games, g.team1_win AS label_team1_win
FROM pairs g JOIN form a ON a.game_id = g.game_id AND a.team_key = g.team1_key JOIN form b ON b.game_id = g.game_id AND b.team_key = g.team2_key JOIN h ON h.game_id = g.game_id""")
def prior_form_head_to_head(spark, sf_dir):
    """Flagship: both sides' form before a game, joined with the pair's history."""
    pairs = GP.pairs(spark, sf_dir, "nation")
    form = H.prior_totals(H.sides(pairs), ["team_key"]).select("game_id", "slot", "prior_games", "prior_win_rate")
    wide = form.groupBy("game_id").agg(*[F.max(F.when(F.col("slot") == i, F.col(c))).alias(f"team{i}_{c}") for i in (1, 2) for c in ("prior_games", "prior_win_rate")])
    diff = F.col("team1_prior_win_rate") - F.col("team2_prior_win_rate")
    return H.head_to_head(pairs).join(wide, "game_id").select(
        "game_id", "team1_key", "team2_key", "team1_prior_games", "team2_prior_games", C.rounded(diff, 4).alias("diff_win_rate"), "h2h_games", F.col("team1_win").alias("label_team1_win")
    )


_ROLL = ", ".join(f"{ROUND.format(f'coalesce({f}({m}) OVER w{n}, 0)')} AS {m}_{a}_{n}" for n in (5, 10, 30) for m in ("kills", "kills_against") for f, a in (("avg", "mean"), ("var_pop", "var")))


@query(f"""{SIDES_SQL} SELECT game_id, team_key, {_ROLL}, {", ".join(f"count(*) OVER w{n} AS games_{n}" for n in (5, 10, 30))} FROM sides
WINDOW {", ".join(f"w{n} AS (PARTITION BY team_key ORDER BY event_date, game_number, game_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in (5, 10, 30))}""")
def rolling_form(spark, sf_dir):
    out = H.rolling(sides(spark, sf_dir), ["kills", "kills_against"])
    return out.select("game_id", "team_key", *[r4(f"{m}_{a}_{n}") for n in (5, 10, 30) for m in ("kills", "kills_against") for a in ("mean", "var")], *[f"games_{n}" for n in (5, 10, 30)])


@query(f"""{_NPAIRS}, b AS (SELECT *, team1_kills + team2_kills AS total_kills FROM pairs),
t AS (SELECT game_id, avg(total_kills) OVER g AS gm, count(*) OVER g AS gc, avg(total_kills) OVER p AS pm, count(*) OVER p AS pc, avg(total_kills) OVER l AS lm, count(*) OVER l AS lc FROM b
WINDOW g AS (ORDER BY event_date, game_number, game_id ROWS BETWEEN 400 PRECEDING AND 1 PRECEDING), p AS (PARTITION BY patch_version ORDER BY event_date, game_number, game_id ROWS BETWEEN 400 PRECEDING AND 1 PRECEDING),
l AS (PARTITION BY league_code ORDER BY event_date, game_number, game_id ROWS BETWEEN 400 PRECEDING AND 1 PRECEDING))
SELECT game_id, gc AS trailing_count, pc AS patch_count, lc AS league_count, {ROUND.format("CASE WHEN pc >= 50 THEN pm WHEN lc >= 50 THEN lm ELSE coalesce(gm, 0) END")} AS baseline_mean,
CASE WHEN pc >= 50 THEN 'patch' WHEN lc >= 50 THEN 'league' ELSE 'global' END AS baseline_source FROM t""")
def totals_baseline(spark, sf_dir):
    games = GP.pairs(spark, sf_dir, "nation").withColumn("total_kills", F.col("team1_kills") + F.col("team2_kills"))
    return H.baseline(games, "total_kills").select("game_id", "trailing_count", "patch_count", "league_count", r4("baseline_mean"), "baseline_source")


@query(f"""{SIDES_SQL}, w AS (SELECT team_key, exp(-(DATE '2001-01-01' - event_date) / 90.0) AS w, kills::DOUBLE AS x FROM sides WHERE event_date < DATE '2001-01-01')
SELECT team_key, count(*) AS games, {ROUND.format("sum(w * x) / sum(w)")} AS weighted_mean, {ROUND.format("greatest(sum(w * x * x) / sum(w) - (sum(w * x) / sum(w)) ** 2, 0)")} AS weighted_var FROM w GROUP BY 1""")
def recency_weighted_form(spark, sf_dir):
    out = H.recency_weighted(sides(spark, sf_dir), ["team_key"], "kills", "2001-01-01", 90)
    return out.select("team_key", "games", r4("weighted_mean"), r4("weighted_var"))


_ELO = f"""{_NPAIRS.replace('WITH', 'WITH RECURSIVE', 1)},
m AS (SELECT *, dense_rank() OVER (PARTITION BY league_code ORDER BY event_date) AS step, least(abs(team1_kills - team2_kills), 10) / 10.0 AS margin FROM pairs),
e AS (SELECT league_code, step, list({{'g': game_id, 'a': team1_key, 'b': team2_key, 'w': team1_win, 'm': margin}} ORDER BY game_id) AS games FROM m GROUP BY 1, 2),
r AS (
  SELECT league_code, 0::BIGINT AS step, MAP([]::VARCHAR[], []::DOUBLE[]) AS ratings, []::STRUCT(g VARCHAR, a VARCHAR, b VARCHAR, ra DOUBLE, rb DOUBLE, d DOUBLE)[] AS done FROM (SELECT DISTINCT league_code FROM pairs)
  UNION ALL
  SELECT league_code, step, map_concat(ratings, map_from_entries(list_transform(list_distinct(flatten(list_transform(done, lambda x: [x.a, x.b]))),
      lambda k: {{'key': k, 'value': coalesce(ratings[k], 1500.0) + list_sum(list_transform(done, lambda x: CASE WHEN x.a = k THEN x.d WHEN x.b = k THEN -x.d ELSE 0.0 END))}}))) AS ratings, done
  FROM (
    SELECT r.league_code, e.step, r.ratings, list_transform(e.games, lambda x: {{'g': x.g, 'a': x.a, 'b': x.b, 'ra': coalesce(r.ratings[x.a], 1500.0), 'rb': coalesce(r.ratings[x.b], 1500.0),
      'd': 32.0 * (1 + x.m) * (x.w - 1 / (1 + 10 ** ((coalesce(r.ratings[x.b], 1500.0) - coalesce(r.ratings[x.a], 1500.0)) / 400)))}}) AS done
    FROM r JOIN e ON e.league_code = r.league_code AND e.step = r.step + 1
  )
)
SELECT u.g AS game_id, league_code AS pool, floor(u.ra * 100 + 0.5) / 100 AS team1_rating, floor(u.rb * 100 + 0.5) / 100 AS team2_rating FROM (SELECT league_code, unnest(done) AS u FROM r)"""


def rated(spark, sf_dir):
    margin = F.least(F.abs(F.col("team1_kills") - F.col("team2_kills")), F.lit(10)) / 10.0
    return GP.pairs(spark, sf_dir, "nation").withColumn("margin", margin)


def _ratings(out):
    return out.select("game_id", "pool", C.rounded(F.col("team1_rating"), 2).alias("team1_rating"), C.rounded(F.col("team2_rating"), 2).alias("team2_rating"))


@query(_ELO)
def elo_ratings(spark, sf_dir):
    return _ratings(H.elo(rated(spark, sf_dir)))


@query(_ELO)
def online_ratings(spark, sf_dir):
    """Games land year by year; a run of the stream after each rates them from the ratings the last one left."""
    games = materialise(H.rating_games(rated(spark, sf_dir)), "games")
    root = scratch_dir(spark, "online-ratings")
    for year in range(1995, 2003):
        games.where(F.year("event_date") == year).write.mode("append").parquet(f"{root}/landed")
        jobs.rate_landed(spark.readStream.schema(games.schema).parquet(f"{root}/landed"), f"{root}/rated")
    return _ratings(jobs.landed_ratings(spark, f"{root}/rated"))
