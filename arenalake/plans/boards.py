"""Queries: boards, comparisons, bet records and the full list of quality issues."""

from __future__ import annotations

from pyspark.sql import functions as F

from arenalake.functions import columns as C
from arenalake.operators import market as L
from arenalake.operators import pages as P
from arenalake.operators import quality as Q
from arenalake.operators import reconcile as R
from arenalake.operators import reports as O
from arenalake.operators import schedules as X
from arenalake.plans import gold as GP
from arenalake.plans import market as MP
from arenalake.plans import pages as PP
from arenalake.plans import reconcile as RC
from arenalake.plans import reports as RP
from arenalake.plans import scoring as SP
from arenalake.plans.registry import query
from arenalake.sources import files
from arenalake.sources.standin import table

# Market sheet with both sides.

_EACH = ", ".join(f"CASE WHEN ok THEN floor({m}{i} * 1000000 + 0.5) / 10000 END AS team{i}_{n}_pct" for i in (1, 2) for m, n in (("g", "edge"), ("v", "ev"), ("k", "kelly")))
_BOARD = f"""WITH {PP._SHEET}, j AS (SELECT *, CASE WHEN team1_odds IS NULL THEN 'missing odds' WHEN team1_odds <= 1 THEN 'odds must exceed 1' WHEN p IS NULL THEN 'no prediction' END AS score_error FROM s LEFT JOIN p USING (match_id)),
m AS (SELECT *, score_error IS NULL AS ok, p - (1 / team1_odds) / (1 / team1_odds + 1 / team2_odds) AS g1, (1 - p) - (1 / team2_odds) / (1 / team1_odds + 1 / team2_odds) AS g2, p * team1_odds - 1 AS v1, (1 - p) * team2_odds - 1 AS v2 FROM j),
n AS (SELECT *, greatest(0, v1 / (team1_odds - 1)) AS k1, greatest(0, v2 / (team2_odds - 1)) AS k2, CASE WHEN NOT ok THEN NULL WHEN v1 >= 0 AND g1 >= 0 AND NOT (v2 >= 0 AND g2 >= 0 AND v2 > v1) THEN 'team1' WHEN v2 >= 0 AND g2 >= 0 THEN 'team2' END AS recommended_selection FROM m),
board AS (SELECT match_id, score_error, ok AS score_available, recommended_selection, recommended_selection IS NOT NULL AS recommend_bet, CASE recommended_selection WHEN 'team1' THEN team1_odds WHEN 'team2' THEN team2_odds END AS recommended_odds, {_EACH} FROM n)"""
_BOARD_COLUMNS = ["match_id", "score_error", "score_available", "recommended_selection", "recommend_bet", "recommended_odds"]


def board(spark, sf_dir):
    out = L.score_both_sides(*PP.sheet(spark, sf_dir))
    return out.select(*_BOARD_COLUMNS, *[C.rounded(F.col(c), 4).alias(c) for c in (f"team{i}_{m}_pct" for i in (1, 2) for m in ("edge", "ev", "kelly"))])


@query(f"{_BOARD} SELECT * FROM board")
def scored_sheet_sides(spark, sf_dir):
    return board(spark, sf_dir)


@query(f"{_BOARD} SELECT count(*) AS rows, count(*) FILTER (score_available) AS scored, count(*) FILTER (recommend_bet) AS recommended, count(*) FILTER (score_error = 'missing odds') AS missing_odds, floor(sum(team1_ev_pct) * 100 + 0.5) / 100 AS team1_ev FROM board")
def scored_sheet_files(spark, sf_dir):
    """Scored rows as CSV, their summary as JSON, and the summary read back."""
    path = files.scratch_dir(spark, "board")
    files.write_scored(board(spark, sf_dir), path)
    return spark.read.schema("rows bigint, scored bigint, recommended bigint, missing_odds bigint, team1_ev double").json(f"{path}/summary")


@query(f"""{MP._SIDES}, b AS (SELECT * FROM v WHERE edge >= 0.03 AND ev >= 0.02 AND odds <= 5 QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY ev DESC, edge DESC, kelly DESC, probability DESC, selection) = 1)
SELECT match_id, day AS match_time, selection, b.odds FROM b JOIN m USING (match_id) ORDER BY ev DESC, edge DESC, day, match_id LIMIT 5""")
def edge_highlights(spark, sf_dir):
    market = MP.market(spark, sf_dir)
    best = L.recommend(L.evaluate_sides(market)).join(market.select("match_id", F.col("day").alias("match_time")), "match_id")
    return L.highlights(best).select("match_id", "match_time", "selection", "odds")


# Bet records from orders: odds, stakes, fair odds and probabilities, some of them refused.

_PROPOSED = f"""WITH {MP._MARKET}, q AS (SELECT match_id AS bet_id, team1_odds AS odds, (match_id % 17)::DOUBLE AS stake, CASE WHEN match_id % 3 = 0 THEN (1 + match_id % 5 / 2.0)::DOUBLE END AS fair, CASE WHEN match_id % 4 <> 0 THEN (match_id % 23 / 20.0)::DOUBLE END AS prob FROM m),
r AS (SELECT *, CASE WHEN odds <= 1 THEN 'odds must exceed 1' WHEN stake <= 0 THEN 'stake must exceed 0' WHEN fair IS NULL AND prob IS NULL THEN 'no fair odds or model probability'
  WHEN fair <= 1 THEN 'fair odds must exceed 1' WHEN prob <= 0 OR prob >= 1 THEN 'model probability must be between 0 and 1' END AS reason FROM q)"""
_DERIVED = ("model_probability", "fair_odds", "market_implied_probability", "edge_probability", "ev_per_unit", "potential_payout", "potential_profit")


def proposed(spark, sf_dir):
    k = F.col("match_id")
    return MP.market(spark, sf_dir).select(
        k.alias("bet_id"), F.col("team1_odds").alias("odds"), (k % 17).cast("double").alias("stake"), F.when(k % 3 == 0, 1 + k % 5 / 2.0).alias("fair_odds"), F.when(k % 4 != 0, k % 23 / 20.0).alias("model_probability"),
    )


@query(f"""{_PROPOSED}, d AS (SELECT bet_id, odds, stake, coalesce(prob, 1 / fair) AS model_probability, coalesce(fair, 1 / prob) AS fair_odds FROM r WHERE reason IS NULL),
x AS (SELECT *, 1 / odds AS market_implied_probability, model_probability - 1 / odds AS edge_probability, model_probability * odds - 1 AS ev_per_unit, stake * odds AS potential_payout, stake * (odds - 1) AS potential_profit FROM d)
SELECT bet_id, odds, stake, 'open' AS status, {", ".join(map(MP._R.format, _DERIVED))} FROM x""")
def bet_records(spark, sf_dir):
    good, _ = L.bet_records(proposed(spark, sf_dir))
    return good.select("bet_id", "odds", "stake", "status", *[C.rounded(F.col(c), 5).alias(c) for c in _DERIVED])


@query(f"{_PROPOSED} SELECT bet_id, reason FROM r WHERE reason IS NOT NULL")
def bet_rejects(spark, sf_dir):
    return L.bet_records(proposed(spark, sf_dir))[1]


# Comparisons.

_COMPARED = ("kills", "deaths", "towers", "dragons", "barons")
_SIDE = "SELECT team1_key, team2_key, game_length_seconds, team{0}_key AS team_key, team{0}_win AS win, " + ", ".join(f"team{{0}}_{m} AS {m}" for m in _COMPARED) + " FROM pairs"


@query(f"""{GP.PAIRS_SQL}, c AS ({_SIDE.format(1)} UNION ALL {_SIDE.format(2)})
SELECT team1_key, team2_key, team_key, count(*) AS games, CAST(sum(win) AS BIGINT) AS wins, {RP.PCT} AS win_pct, {RP._r2("avg(game_length_seconds)", "mean_length")}, {", ".join(RP._r2(f"avg({m})", f"mean_{m}") for m in _COMPARED)} FROM c GROUP BY 1, 2, 3""")
def team_comparison(spark, sf_dir):
    out = O.compare_teams(GP.pairs(spark, sf_dir), _COMPARED)
    return out.select("team1_key", "team2_key", "team_key", "games", "wins", "win_pct", *[RP.r2(c) for c in ("mean_length", *(f"mean_{m}" for m in _COMPARED))])


@query(f"""{RP.FACTS_SQL}, w AS (SELECT player_key FROM facts GROUP BY 1 ORDER BY count(*) DESC, player_key LIMIT 2)
SELECT player_key, count(*) AS games, CAST(sum(win) AS BIGINT) AS wins, CAST(sum(kills) AS BIGINT) AS kills, CAST(sum(deaths) AS BIGINT) AS deaths, {RP._r2(RP._KDA, "mean_kda")}, {RP._r2("avg(damage)", "mean_damage")}, count(DISTINCT champion_name) AS champions
FROM facts WHERE player_key IN (SELECT player_key FROM w) GROUP BY 1""")
def player_comparison(spark, sf_dir):
    """The two players with most games, side by side."""
    facts = RP.facts(spark, sf_dir)
    two = facts.groupBy("player_key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "player_key").limit(2)
    return O.compare_players(facts, two).withColumns({c: C.rounded(F.col(c), 2) for c in ("mean_kda", "mean_damage")})


# Lists of matches to come.

_UPCOMING = f"""WITH {SP._WIKI}, u AS (SELECT MatchId AS match_id, t AS match_time, CASE WHEN OverviewPage <> '' THEN regexp_replace(split_part(OverviewPage, '/', 1), '^\\d{{4}}\\s+', '') ELSE 'P' END AS league, trim(Team1) AS team1, trim(Team2) AS team2
FROM w WHERE t >= TIMESTAMP '{SP.NOW}' AND Team1 <> 'TBD' AND Team2 <> 'nan' AND Winner = '' AND Team1Score IS NULL)"""


@query(f"{_UPCOMING} SELECT * FROM u WHERE lower(league) = '1-urgent' ORDER BY match_time, league, team1, team2, match_id LIMIT 200")
def upcoming_of_league(spark, sf_dir):
    return X.upcoming_list(X.upcoming_wiki(SP.wiki_rows(spark, sf_dir), SP.NOW), "1-URGENT", 200).select("match_id", "match_time", "league", "team1", "team2")


@query(f"{_UPCOMING} SELECT league, count(*) AS matches, min(match_time) AS first_time, max(match_time) AS last_time FROM u GROUP BY 1")
def upcoming_by_league(spark, sf_dir):
    return X.upcoming_by_league(X.upcoming_wiki(SP.wiki_rows(spark, sf_dir), SP.NOW))


@query(f"{_UPCOMING} SELECT match_id, match_time, league, team1, team2 FROM u")
def schedule_snapshot(spark, sf_dir):
    """Matches to come, published as JSON with ISO times and loaded back, typed."""
    path = files.scratch_dir(spark, "schedule")
    files.write_schedule(X.upcoming_wiki(SP.wiki_rows(spark, sf_dir), SP.NOW).select("match_id", "match_time", "league", "team1", "team2"), path)
    return files.read_schedule(spark, path, "match_id string, match_time timestamp, league string, team1 string, team2 string")


@query("SELECT o_orderpriority AS bookmaker, count(*) AS quotes, CAST(max(o_orderdate) AS DATE) AS latest FROM orders GROUP BY 1")
def bookmakers(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("bookmaker")).agg(F.count("*").alias("quotes"), F.max(F.to_date("o_orderdate")).alias("latest"))


# All eight kinds of issue.

_ISSUE = "SELECT '{0}' AS issue_type, '{1}' AS severity, {2} AS entity_key, {3} AS game_id, {4} AS series_key, {5} AS issue_detail FROM {6}"
_NO, _OF_GAME, _OF_SERIES = "CAST(NULL AS VARCHAR)", ("game_id", "game_id", "CAST(NULL AS VARCHAR)"), ("series_key", "CAST(NULL AS VARCHAR)", "series_key")
_KINDS = [
    ("game_team_count", "error", *_OF_GAME, "'Expected 2 team rows, found ' || count(*)", "entrants GROUP BY game_id HAVING count(*) <> 2"),
    ("game_same_team_key_both_sides", "warning", *_OF_GAME, "'Both sides have the same team_key.'", "entrants GROUP BY game_id HAVING count(DISTINCT team_key) < 2"),
    ("game_player_count", "error", *_OF_GAME, "'Expected 10 player rows, found ' || count(*)", "people GROUP BY game_id HAVING count(*) <> 10"),
    ("game_unknown_player_collisions", "warning", *_OF_GAME, "'Several rows of the game have the unknown player.'", "people WHERE player_key = 'playername:unknown' GROUP BY game_id HAVING count(*) > 1"),
    ("series_missing_team_id", "warning", *_OF_SERIES, "'At least one side has no team id.'", "series WHERE team1_key LIKE 'teamname:%' OR team2_key LIKE 'teamname:%'"),
    ("official_series_unmatched", "warning", *_OF_SERIES, "'Inside official coverage, without official match.'", "reconciled JOIN span USING (league_code) WHERE match_id IS NULL AND event_date BETWEEN o1 AND o2"),
    ("wiki_series_unmatched", "warning", *_OF_SERIES, "'Inside wiki coverage, without wiki match.'", "reconciled, wspan WHERE wiki_id IS NULL AND event_date BETWEEN w1 AND w2"),
    ("multi_source_score_conflict", "warning", *_OF_SERIES, "'The wiki has another score.'", "reconciled WHERE score_conflict"),
]


@query(f"""{RC._SCHEDULE_SQL}, {GP.SERIES_SQL[len(GP.DAILY_SQL):].lstrip(",")}, {GP.S.participants_sql()}, people AS (SELECT * REPLACE (CASE WHEN player_id IS NULL THEN 'playername:unknown' ELSE player_key END AS player_key) FROM participants),
span AS (SELECT league_code, min(event_date) AS o1, max(event_date) AS o2 FROM official GROUP BY 1), wspan AS (SELECT min(event_date) AS w1, max(event_date) AS w2 FROM wiki)
{" UNION ALL ".join(_ISSUE.format(*k) for k in _KINDS)}""")
def quality_issues(spark, sf_dir):
    base, official, wiki = RC.schedules(spark, sf_dir)
    people = GP.participants(spark, sf_dir)
    people = people.withColumn("player_key", F.when(F.col("player_id").isNull(), "playername:unknown").otherwise(F.col("player_key")))
    o = official.groupBy("league_code").agg(F.min("event_date").alias("first_day"), F.max("event_date").alias("last_day"))
    first, last = (wiki.agg(f("event_date")).scalar() for f in (F.min, F.max))
    covered = R.attach_coverage(R.reconciliation(base, official, wiki), o).withColumnRenamed("covered", "official_covered")
    covered = covered.withColumn("wiki_covered", F.coalesce(F.col("event_date").between(first, last), F.lit(False)))
    return Q.quality_issues(GP.entrants(spark, sf_dir), people, GP.series(spark, sf_dir), covered)


# A bookmaker's sheet as CSV with headers of its own, from orders.

_SHEETS = """s AS (SELECT o_orderkey AS k, o_orderdate, CASE o_orderkey % 9 WHEN 0 THEN 'maybe' WHEN 1 THEN '' WHEN 2 THEN 'No' ELSE 'TRUE' END AS flag, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE (12 + o_orderkey % 30) / 10.0 END::DOUBLE AS odds FROM orders)"""


def sheets(spark, sf_dir):
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    flag = F.when(k % 9 == 0, "maybe").when(k % 9 == 1, "").when(k % 9 == 2, "No").otherwise("TRUE")
    rows = table(spark, sf_dir, "orders").select(
        s(k).alias("ID"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("Kickoff Time"), F.col("o_orderpriority").alias("Competition"), F.lit("Cup").alias("Tournament"), F.lit("Week 1").alias("Stage"), F.concat(F.lit("A"), s(k)).alias("Home Team"), F.concat(F.lit("B"), s(k)).alias("Away Team"),
        F.when(k % 7 == 0, "n/a").otherwise(s((12 + k % 30) / 10)).alias("Home Odds"), F.lit("2.5").alias("Odds (Team2)"), F.lit("3").alias("BO"), flag.alias("Is Playoffs"), F.lit("Book").alias("Sportsbook"), F.lit("1.5").alias("Unit-Stake"), F.lit("m").alias("Memo"), F.lit("x").alias("Other"),
    )
    path = files.scratch_dir(spark, "sheet")
    rows.withColumnRenamed("Odds (Team2)", "odds team2").write.option("header", True).csv(path)
    return L.conform_sheet(files.read_box_scores(spark, [path]))


@query(f"""WITH {_SHEETS} SELECT CAST(k AS VARCHAR) AS match_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS match_time, 'Cup' AS event_name, 'Week 1' AS phase_label, 'A' || k AS team1, 'B' || k AS team2, odds AS team1_odds, 2.5::DOUBLE AS team2_odds, 3.0::DOUBLE AS best_of, CAST(NULL AS VARCHAR) AS patch,
CASE flag WHEN 'TRUE' THEN true WHEN 'No' THEN false END AS playoffs, 'Book' AS bookmaker, 1.5::DOUBLE AS stake, 'm' AS notes FROM s WHERE flag <> 'maybe'""")
def market_sheet(spark, sf_dir):
    """A sheet read from CSV and brought to the published columns."""
    return sheets(spark, sf_dir)[0].select("match_id", "match_time", "event_name", "phase_label", "team1", "team2", "team1_odds", "team2_odds", "best_of", "patch", "playoffs", "bookmaker", "stake", "notes")


@query(f"WITH {_SHEETS} SELECT CAST(k AS VARCHAR) AS match_id, 'playoffs flag can''t be read' AS reason FROM s WHERE flag = 'maybe'")
def market_sheet_rejects(spark, sf_dir):
    return sheets(spark, sf_dir)[1].select("match_id", "reason")


@query("""SELECT o_orderkey AS bet_id, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 4 ELSE 2 END::DOUBLE AS stake, 'from the sheet' || CASE WHEN o_orderkey % 3 = 0 THEN ' | own note' ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE ' | edge' END AS notes FROM orders""")
def recommended_bets(spark, sf_dir):
    """Recommendations appended to an empty ledger: stake default, notes from prefix, note and reason."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("bet_id"), (k % 4).cast("double").alias("stake"), F.lit(1.5).alias("odds"), F.lit("open").alias("status"), k.cast("string").alias("match_time"), *[F.lit("x").alias(c) for c in L.DEDUP_KEYS if c != "match_time"],
        F.when(k % 3 == 0, " own note ").otherwise("").alias("notes"), F.when(k % 5 != 0, "edge").alias("recommendation_reason"),
    )
    return L.append_bets(rows.limit(0), rows, 2.0, "from the sheet").select("bet_id", "stake", "notes")


# Probabilities and totals quotes of matches to come, flat, with what failed.

_BOARDS = """w AS (SELECT o_orderkey AS match_id, CASE WHEN o_orderkey % 5 > 0 THEN (1 + o_orderkey % 63) / 64.0 END::DOUBLE AS p, CASE WHEN o_orderkey % 5 = 0 THEN 'unknown team' END AS error, CASE WHEN o_orderkey % 4 = 0 THEN ['patch not seen'] ELSE [] END AS warnings FROM orders WHERE o_orderkey % 7 > 0),
t AS (SELECT o_orderkey AS match_id, unnest(CASE WHEN o_orderkey % 3 > 0 THEN ['kills', 'towers'] ELSE [NULL] END) AS market, CASE WHEN o_orderkey % 3 = 0 THEN 'no history' END AS error, (1 + o_orderkey % 15) / 16.0::DOUBLE AS over FROM orders WHERE o_orderkey % 11 > 0),
m AS (SELECT o_orderkey AS match_id, o_orderpriority AS league FROM orders WHERE o_orderkey % 2 = 0),
b AS (SELECT m.*, p, CASE WHEN p IS NULL THEN coalesce(w.error, 'not scored') END AS winner_error, warnings, CASE WHEN coalesce(q.n, 0) = 0 THEN coalesce(q.error, 'not scored') END AS totals_error FROM m LEFT JOIN w USING (match_id) LEFT JOIN (SELECT match_id, count(market) AS n, max(error) AS error FROM t GROUP BY 1) q USING (match_id))"""


def _board_tables(spark, sf_dir):
    k, o = F.col("o_orderkey"), table(spark, sf_dir, "orders")
    none = F.lit(None).cast("string")
    winner = o.where(k % 7 > 0).select(k.alias("match_id"), F.when(k % 5 > 0, (1 + k % 63) / 64.0).alias("p"), F.when(k % 4 == 0, F.array(F.lit("patch not seen"))).otherwise(F.array().cast("array<string>")).alias("warnings"), F.when(k % 5 == 0, "unknown team").alias("error"))
    market = F.explode(F.when(k % 3 > 0, F.array(F.lit("kills"), F.lit("towers"))).otherwise(F.array(none)))
    totals = o.where(k % 11 > 0).select(k.alias("match_id"), market.alias("market"), F.lit(9.5).alias("line"), F.lit(9.0).alias("mean"), ((1 + k % 15) / 16.0).alias("over"), F.when(k % 3 == 0, "no history").alias("error"))
    return P.prob_win_board(o.where(k % 2 == 0).select(k.alias("match_id"), F.col("o_orderpriority").alias("league")), winner, totals)


@query(f"""WITH {_BOARDS} SELECT match_id, league, p IS NOT NULL AS winner_available, winner_error, floor(p * 100000 + 0.5) / 100000 AS team1_win_prob, floor(100000 / (1 - p) + 0.5) / 100000 AS team2_fair_odds, CASE WHEN p >= 0.5 THEN 'team1' WHEN p < 0.5 THEN 'team2' END AS favorite, totals_error IS NULL AS totals_available, totals_error,
'[' || array_to_string(list_transform(list_filter(list_concat(coalesce(warnings, []), [winner_error, CASE WHEN totals_error IS DISTINCT FROM winner_error THEN totals_error END]), lambda x: x IS NOT NULL), lambda x: '"' || x || '"'), ',') || ']' AS warnings_json FROM b""")
def prob_win_matches(spark, sf_dir):
    r = lambda c: C.rounded(F.col(c), 5).alias(c)
    return _board_tables(spark, sf_dir)[0].select("match_id", "league", "winner_available", "winner_error", r("team1_win_prob"), r("team2_fair_odds"), "favorite", "totals_available", "totals_error", "warnings_json")


@query(f"WITH {_BOARDS} SELECT match_id, market AS market_key, 9.5::DOUBLE AS line, over AS over_prob, floor(100000 / (1 - over) + 0.5) / 100000 AS under_fair_odds FROM t JOIN m USING (match_id) WHERE market IS NOT NULL")
def prob_win_totals(spark, sf_dir):
    return _board_tables(spark, sf_dir)[1].select("match_id", "market_key", "line", "over_prob", C.rounded(F.col("under_fair_odds"), 5).alias("under_fair_odds"))
