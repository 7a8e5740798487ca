"""Queries: assembled features, quotes, contexts, drill-downs."""

from __future__ import annotations

from pyspark.sql import functions as F

from arenalake.functions import columns as C
from arenalake.operators import features as X
from arenalake.operators import history as H
from arenalake.plans import gold as GP
from arenalake.plans import history as HP
from arenalake.plans import reports as RP
from arenalake.plans.registry import query
from arenalake.sources.files import materialise
from arenalake.sources.standin import table


def r4(c):
    return C.rounded(F.col(c), 4).alias(c)


R4 = "floor(({}) * 10000 + 0.5) / 10000"


@query(f"""{GP.EP_SQL}, s AS (SELECT DISTINCT p.game_id, p.side, p.player_key, p.event_date, e.win FROM participants p LEFT JOIN entrants e ON e.game_id = p.game_id AND e.side = p.side),
d AS (SELECT player_key, event_date, count(*) AS n, sum(win) AS w, count(win) AS k FROM s GROUP BY 1, 2),
c AS (SELECT player_key, event_date, coalesce(sum(n) OVER o, 0) AS prior, coalesce(sum(w) OVER o, 0) AS wins, coalesce(sum(k) OVER o, 0) AS known FROM d WINDOW o AS (PARTITION BY player_key ORDER BY event_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT game_id, side, {R4.format("avg(prior)")} AS mean_experience, {R4.format("avg(CASE WHEN known = 0 THEN 0.5 ELSE wins / known END)")} AS mean_player_win_rate, count(*) FILTER (prior = 0) AS new_players FROM s JOIN c USING (player_key, event_date) GROUP BY 1, 2""")
def player_experience(spark, sf_dir):
    facts = GP.G.player_facts(GP.participants(spark, sf_dir), GP.entrants(spark, sf_dir))
    return X.player_experience(facts).select("game_id", "side", r4("mean_experience"), r4("mean_player_win_rate"), "new_players")


_FUTURE = "event_date >= DATE '2001-01-01'"
_PREMATCH = f"""{HP._NPAIRS.replace('pairs AS', 'all_pairs AS')},
pairs AS (SELECT * REPLACE (CASE WHEN {_FUTURE} THEN NULL ELSE team1_win END AS team1_win, CASE WHEN {_FUTURE} THEN NULL ELSE team2_win END AS team2_win) FROM all_pairs),
side AS (SELECT game_id, event_date, team1_key AS team_key, team1_win AS win FROM pairs UNION ALL SELECT game_id, event_date, team2_key, team2_win FROM pairs),
form AS (SELECT s.game_id, s.team_key, count(p.game_id) AS n, coalesce(sum(p.win), 0) AS w, CAST(s.event_date - max(p.event_date) AS INT) AS days FROM side s LEFT JOIN side p ON p.team_key = s.team_key AND p.event_date < s.event_date AND p.win IS NOT NULL GROUP BY s.game_id, s.team_key, s.event_date),
h AS (SELECT s.game_id, count(p.game_id) AS n, coalesce(sum(p.team1_win), 0) AS w FROM pairs s LEFT JOIN pairs p ON p.team1_key = s.team1_key AND p.team2_key = s.team2_key AND p.event_date < s.event_date AND p.team1_win IS NOT NULL GROUP BY 1)"""


@query(f"""{_PREMATCH} SELECT g.game_id, {_FUTURE} AS is_future, a.n AS team1_prior_games, b.n AS team2_prior_games, a.days - b.days AS diff_prior_days_since,
{R4.format("CASE WHEN a.n = 0 THEN 0.5 ELSE a.w / a.n END - CASE WHEN b.n = 0 THEN 0.5 ELSE b.w / b.n END")} AS diff_prior_win_rate, h.n AS h2h_games, {R4.format("CASE WHEN h.n = 0 THEN 0.5 ELSE h.w / h.n END")} AS h2h_team1_rate, team1_win AS label_team1_win
FROM pairs g JOIN form a ON a.game_id = g.game_id AND a.team_key = g.team1_key JOIN form b ON b.game_id = g.game_id AND b.team_key = g.team2_key JOIN h ON h.game_id = g.game_id""")
def prematch_features(spark, sf_dir):
    """Training and future rows through one path; the last half year stands in for the future."""
    pairs = GP.pairs(spark, sf_dir, "nation")
    later = F.col("event_date") >= F.lit("2001-01-01").cast("date")
    blank = {c: F.lit(None).cast("int") for c in ("team1_win", "team2_win")}
    out = X.prematch(pairs.where(~later), pairs.where(later).withColumns(blank))
    return out.select("game_id", "is_future", "team1_prior_games", "team2_prior_games", "diff_prior_days_since", r4("diff_prior_win_rate"), "h2h_games", r4("h2h_team1_rate"), "label_team1_win")


LATER = "2001-01-01"


def played_and_coming(spark, sf_dir):
    """Pairs before LATER, and those from then on without what only a played game has."""
    pairs = GP.pairs(spark, sf_dir, "nation")
    later = F.col("event_date") >= F.lit(LATER).cast("date")
    unknown = [f"team{i}_{m}" for i in (1, 2) for m in ("win", "kills", "deaths", "gold", *H.MEASURES)] + ["game_length_seconds"]
    kinds = dict(pairs.dtypes)
    return pairs.where(~later), pairs.where(later).withColumns({c: F.lit(None).cast(kinds[c]) for c in unknown})


def assembled(spark, sf_dir):
    """All feature groups, from written pairs and facts, as a dozen branches read them."""
    played, coming = (materialise(df, "pairs") for df in played_and_coming(spark, sf_dir))
    facts = GP.G.player_facts(GP.participants(spark, sf_dir), GP.entrants(spark, sf_dir, "nation")).where(F.col("event_date") < F.lit(LATER).cast("date"))
    return X.assembled(played, materialise(facts.select("game_id", "side", "team_key", "event_date", "player_key", "champion_name", "win"), "facts"), coming)


_LATER_SIDES = f"""{_PREMATCH.replace("pairs AS (SELECT * REPLACE", GP.S.participants_sql().strip() + ", pairs AS (SELECT * REPLACE", 1)},
s AS (SELECT game_id, event_date, 1 AS slot, team1_key AS team_key, team1_win AS win, patch_version, split_name FROM pairs UNION ALL SELECT game_id, event_date, 2, team2_key, team2_win, patch_version, split_name FROM pairs),
f AS (SELECT p.*, e.team_key, e.win FROM participants p LEFT JOIN entrants e USING (game_id, side) WHERE p.event_date < DATE '{LATER}')"""
_LAGS = ", ".join(f"CASE WHEN lag(roster, {i}) OVER r IS NOT NULL THEN len(list_intersect(roster, lag(roster, {i}) OVER r)) END AS o{i}" for i in (1, 2, 3))
# Games to come all lie after the facts, so a team's state there is that of its last game.
_ASSEMBLED = f"""{_LATER_SIDES},
pf AS (SELECT s.game_id, s.slot, count(p.game_id) AS n FROM s LEFT JOIN s p ON p.team_key = s.team_key AND p.patch_version IS NOT DISTINCT FROM s.patch_version AND p.event_date < s.event_date AND p.win IS NOT NULL GROUP BY 1, 2),
sf AS (SELECT s.game_id, s.slot, CASE WHEN count(p.game_id) = 0 THEN 0.5 ELSE sum(p.win) / count(p.game_id) END AS r FROM s LEFT JOIN s p ON p.team_key = s.team_key AND p.split_name IS NOT DISTINCT FROM s.split_name AND p.event_date < s.event_date AND p.win IS NOT NULL GROUP BY 1, 2),
ro AS (SELECT *, (coalesce(o1, 0) + coalesce(o2, 0) + coalesce(o3, 0)) / nullif((o1 IS NOT NULL)::INT + (o2 IS NOT NULL)::INT + (o3 IS NOT NULL)::INT, 0) AS om FROM (
  SELECT game_id, event_date, team_key, roster, {_LAGS} FROM (SELECT game_id, event_date, team_key, list(DISTINCT player_key) AS roster FROM f WHERE team_key IS NOT NULL GROUP BY 1, 2, 3) WINDOW r AS (PARTITION BY team_key ORDER BY event_date, game_id))),
last AS (SELECT * FROM ro QUALIFY row_number() OVER (PARTITION BY team_key ORDER BY event_date DESC, game_id DESC) = 1),
rs AS (SELECT game_id, team_key, o1, om, 'played' AS source FROM ro UNION ALL SELECT s.game_id, s.team_key, l.o1, l.om, CASE WHEN l.roster IS NOT NULL THEN 'last' END FROM s LEFT JOIN last l ON l.team_key = s.team_key WHERE s.event_date >= DATE '{LATER}'),
ap AS (SELECT DISTINCT game_id, side, player_key, event_date, win FROM f),
fielded AS (SELECT DISTINCT game_id, team_key, player_key, event_date FROM f WHERE team_key IS NOT NULL UNION ALL SELECT s.game_id, s.team_key, unnest(l.roster), s.event_date FROM s JOIN last l ON l.team_key = s.team_key WHERE s.event_date >= DATE '{LATER}'),
days AS (SELECT player_key, event_date, count(*) AS n, sum(win) AS w, count(win) AS k FROM ap GROUP BY 1, 2),
pr AS (SELECT x.game_id, x.team_key, x.player_key, coalesce(sum(n), 0) AS n, coalesce(sum(w), 0) AS w, coalesce(sum(k), 0) AS k FROM fielded x LEFT JOIN days d ON d.player_key = x.player_key AND d.event_date < x.event_date GROUP BY 1, 2, 3),
ex AS (SELECT game_id, team_key, avg(n) AS m, avg(CASE WHEN k = 0 THEN 0.5 ELSE w / k END) AS r, count(*) FILTER (n = 0) AS fresh FROM pr GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY team_key ORDER BY event_date, game_id) AS i FROM (SELECT team_key, event_date, game_id, list(champion_name) AS picks FROM f WHERE team_key IS NOT NULL GROUP BY 1, 2, 3)),
ask AS (SELECT team_key, game_id, i FROM n UNION ALL SELECT s.team_key, s.game_id, coalesce(m.i, 0) + 1 FROM s LEFT JOIN (SELECT team_key, max(i) AS i FROM n GROUP BY 1) m ON m.team_key = s.team_key WHERE s.event_date >= DATE '{LATER}'),
x AS (SELECT team_key, i, unnest(picks) AS c FROM n),
g25 AS (SELECT a.team_key, a.i, x.c, count(*) AS k, count(*) FILTER (a.i - x.i <= 10) AS k10 FROM (SELECT DISTINCT team_key, i FROM ask) a JOIN x ON x.team_key = a.team_key AND x.i BETWEEN a.i - 25 AND a.i - 1 GROUP BY 1, 2, 3),
top AS (SELECT *, row_number() OVER (PARTITION BY team_key, i ORDER BY k DESC, c) AS r FROM g25),
pool AS (SELECT ask.game_id, ask.team_key, coalesce(u10, 0) AS u10, coalesce(u25, 0) AS u25, coalesce(share, 0) AS share FROM ask LEFT JOIN (SELECT team_key, i, count(*) FILTER (k10 > 0) AS u10, count(*) AS u25, sum(k) FILTER (r <= 5) / sum(k) AS share FROM top GROUP BY 1, 2) USING (team_key, i)),
fp AS (SELECT game_id, team_key, event_date, max((side = 'blue')::INT) AS b FROM f WHERE team_key IS NOT NULL GROUP BY 1, 2, 3),
fr AS (SELECT game_id, team_key, avg(b) FILTER (r <= 10) AS r10, avg(b) FILTER (r <= 25) AS r25 FROM (SELECT s.game_id, s.team_key, fp.b, row_number() OVER (PARTITION BY s.game_id, s.team_key ORDER BY fp.event_date DESC, fp.game_id DESC) AS r FROM s JOIN fp ON fp.team_key = s.team_key AND fp.event_date < s.event_date) GROUP BY 1, 2),
each AS (SELECT s.game_id, s.slot, pf.n AS patch_games, sf.r AS split_rate, rs.*, ex.*, pool.*, coalesce(fr.r10, 0.5) AS r10, coalesce(fr.r25, 0.5) AS r25 FROM s JOIN pf USING (game_id, slot) JOIN sf USING (game_id, slot)
  LEFT JOIN rs USING (game_id, team_key) LEFT JOIN ex USING (game_id, team_key) LEFT JOIN pool USING (game_id, team_key) LEFT JOIN fr USING (game_id, team_key))"""


@query(f"""{_ASSEMBLED} SELECT g.game_id, {_FUTURE} AS is_future, a.patch_games AS team1_patch_games, {R4.format("a.split_rate - b.split_rate")} AS diff_split_win_rate, CAST(a.o1 AS BIGINT) AS team1_roster_shared, {R4.format("b.om")} AS team2_roster_shared_mean,
a.source AS team1_roster_source, {R4.format("b.m")} AS team2_mean_experience, {R4.format("a.r")} AS team1_mean_player_win_rate, CAST(b.fresh AS BIGINT) AS team2_new_players, CAST(a.u10 AS BIGINT) AS team1_unique_10, CAST(b.u25 AS BIGINT) AS team2_unique_25, {R4.format("a.share")} AS team1_top5_share,
{R4.format("b.r10")} AS team2_first_pick_rate_10, {R4.format("a.r25 - b.r25")} AS diff_first_pick_rate_25, team1_win AS label_team1_win FROM pairs g JOIN each a ON a.game_id = g.game_id AND a.slot = 1 JOIN each b ON b.game_id = g.game_id AND b.slot = 2""")
def prematch_assembled(spark, sf_dir):
    """All pre-match feature groups joined, games to come by each team's latest games; ratings have a query of their own."""
    long = lambda c: F.col(c).cast("long").alias(c)
    return assembled(spark, sf_dir).select(
        "game_id", "is_future", "team1_patch_games", r4("diff_split_win_rate"), long("team1_roster_shared"), r4("team2_roster_shared_mean"), "team1_roster_source", r4("team2_mean_experience"), r4("team1_mean_player_win_rate"),
        long("team2_new_players"), long("team1_unique_10"), long("team2_unique_25"), r4("team1_top5_share"), r4("team2_first_pick_rate_10"), r4("diff_first_pick_rate_25"), "label_team1_win",
    )


_TOTALS = "kills dragons towers barons inhibitors".split()
_BEFORE = {"patch": "p.patch_version IS NOT DISTINCT FROM g.patch_version", "league": "p.league_code = g.league_code", "global": "true"}


def _level_sql(m: str, level: str) -> str:
    """For every match to come: number and mean of the last 400 values before its day, by looking at them all."""
    return f"""SELECT game_id, count(*) AS n, avg(v) AS m FROM (SELECT g.game_id, p.v, row_number() OVER (PARTITION BY g.game_id ORDER BY p.event_date DESC, p.game_number DESC, p.game_id DESC) AS r
    FROM coming g JOIN (SELECT *, team1_{m} + team2_{m} AS v FROM played WHERE team1_{m} + team2_{m} IS NOT NULL) p ON p.event_date < g.event_date AND {_BEFORE[level]}) WHERE r <= 400 GROUP BY 1"""


def _coming_sql(m: str) -> str:
    return f"""SELECT g.game_id, '{m}' AS market, CASE WHEN p.n >= 50 THEN 'patch' WHEN l.n >= 50 THEN 'league' ELSE 'global' END AS source, {R4.format("CASE WHEN p.n >= 50 THEN p.m WHEN l.n >= 50 THEN l.m ELSE coalesce(a.m, 0) END")} AS baseline
    FROM coming g LEFT JOIN ({_level_sql(m, "patch")}) p USING (game_id) LEFT JOIN ({_level_sql(m, "league")}) l USING (game_id) CROSS JOIN (SELECT avg(v) AS m FROM (SELECT team1_{m} + team2_{m} AS v FROM played WHERE team1_{m} + team2_{m} IS NOT NULL ORDER BY event_date DESC, game_number DESC, game_id DESC LIMIT 400)) a"""


@query(f"""{HP._NPAIRS}, played AS (SELECT * FROM pairs WHERE event_date < DATE '{LATER}'), coming AS (SELECT * FROM pairs WHERE event_date >= DATE '{LATER}') {" UNION ALL ".join(map(_coming_sql, _TOTALS))}""")
def coming_totals_baselines(spark, sf_dir):
    """Baselines of all five markets for matches to come; none of them changes what the next one looks back on."""
    played, coming = played_and_coming(spark, sf_dir)
    games = played.withColumn("ahead", F.lit(False)).unionByName(coming.withColumn("ahead", F.lit(True)))
    out = H.baselines(games.withColumns({f"total_{m}": F.col(f"team1_{m}") + F.col(f"team2_{m}") for m in _TOTALS}), [f"total_{m}" for m in _TOTALS], asked="ahead")
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("market"), F.col(f"total_{m}_source").alias("source"), F.col(f"total_{m}_baseline").alias("baseline")) for m in _TOTALS]))
    return out.select("game_id", rows.alias("q")).select("game_id", "q.market", "q.source", C.rounded(F.col("q.baseline"), 4).alias("baseline"))


@query(f"""{HP.SIDES_SQL}, r AS (SELECT game_id, slot, coalesce(avg(kills) OVER w, 0) AS k, coalesce(avg(kills_against) OVER w, 0) AS a FROM sides WINDOW w AS (PARTITION BY team_key ORDER BY event_date, game_number, game_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
SELECT x.game_id, {R4.format("x.k")} AS team1_kills_mean_10, {R4.format("(x.k + y.k) / 2")} AS avg_kills_mean_10, {R4.format("x.a - y.a")} AS diff_kills_against_mean_10, team1_kills + team2_kills AS target_total_kills
FROM r x JOIN r y ON x.game_id = y.game_id AND x.slot = 1 AND y.slot = 2 JOIN pairs p ON p.game_id = x.game_id""")
def totals_features(spark, sf_dir):
    out = X.totals_features(GP.pairs(spark, sf_dir, "nation"), markets=("kills",))
    return out.select("game_id", r4("team1_kills_mean_10"), r4("avg_kills_mean_10"), r4("diff_kills_against_mean_10"), "target_total_kills")


_M = tuple(X.LINES)


@query(f"""{GP.E_SQL}, s AS (SELECT league_code || ':' || team_key AS match_id, count(*) AS games, {", ".join(f"avg({m}) AS {m}_mean, var_pop({m}) AS {m}_var" for m in _M)} FROM entrants GROUP BY 1),
q AS ({" UNION ALL ".join(f"SELECT match_id, games, '{m}' AS market, {x} AS line, {m}_mean * 2 AS mean, {m}_var * 2 AS variance, {x}::DOUBLE AS prior FROM s" for m, x in X.LINES.items())})
SELECT match_id, market, line::DOUBLE AS line, {R4.format("(mean * games + prior * 8) / (games + 8)")} AS mean, floor((variance * games + prior * 8) / (games + 8) * 100 + 0.5) / 100 AS variance, CASE WHEN games < 10 THEN 'small sample' END AS warning FROM q""")
def totals_quotes(spark, sf_dir):
    e = GP.entrants(spark, sf_dir)
    s = e.groupBy(F.concat_ws(":", "league_code", "team_key").alias("match_id")).agg(F.count("*").alias("games"), *[x for m in _M for x in ((F.avg(m) * 2).alias(f"{m}_mean"), (C.whole_variance(F.col(m)) * 2).alias(f"{m}_var"))])
    out = X.totals_quotes(s.withColumns({f"{m}_prior": F.lit(x) for m, x in X.LINES.items()}))
    return out.select("match_id", "market", "line", r4("mean"), C.rounded(F.col("variance"), 2).alias("variance"), "warning")


@query("""WITH m AS (SELECT o_orderkey AS match_id, o_orderpriority AS league, 's' || o_orderkey % 5 AS slug, CASE WHEN o_orderkey % 7 = 0 THEN 'XX' ELSE '' END AS league_code, CASE WHEN o_orderkey % 6 = 0 THEN 'Own' END AS split_name,
CASE o_orderkey % 4 WHEN 0 THEN 'Summer Playoffs' WHEN 1 THEN 'Split 4' WHEN 2 THEN 'Grand Final' ELSE 'Week 2' END AS phase, CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 5 END AS best_of FROM orders)
SELECT match_id, CASE WHEN league_code <> '' THEN league_code WHEN slug = 's1' THEN 'ONE' WHEN slug = 's2' THEN 'TWO' ELSE upper(league) END AS league_code, CASE WHEN split_name IS NOT NULL THEN split_name WHEN phase LIKE 'Summer%' THEN 'Summer' WHEN phase = 'Split 4' THEN 'Split 4' WHEN league_code <> '' THEN league_code WHEN slug = 's1' THEN 'ONE' WHEN slug = 's2' THEN 'TWO' ELSE upper(league) END AS split_name,
phase IN ('Summer Playoffs', 'Grand Final') AS playoffs, greatest(coalesce(best_of, 3), 1) AS best_of FROM m""")
def match_context(spark, sf_dir):
    k = F.col("o_orderkey")
    phase = F.when(k % 4 == 0, "Summer Playoffs").when(k % 4 == 1, "Split 4").when(k % 4 == 2, "Grand Final").otherwise("Week 2")
    m = table(spark, sf_dir, "orders").select(
        k.alias("match_id"), F.col("o_orderpriority").alias("league"), F.concat(F.lit("s"), (k % 5).cast("string")).alias("slug"), F.when(k % 7 == 0, "XX").otherwise("").alias("league_code"),
        F.when(k % 6 == 0, "Own").alias("split_name"), phase.alias("phase"), F.when(k % 3 == 0, 0).when(k % 3 == 1, 5).alias("best_of"),
    )
    return X.match_context(m, spark.createDataFrame([("s1", "ONE"), ("s2", "TWO")], "slug string, code string"))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Building League' WHEN 'MACHINERY' THEN 'Machine Cup' ELSE c_mktsegment END AS label FROM customer")
def league_labels(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", X.league_label(F.col("c_mktsegment"), {"BUILDING": "Building League", "MACHINERY": "Machine Cup"}).alias("label"))


@query(f"""{GP.P_SQL} SELECT game_id, participant_id, array_to_string(list_filter([CASE WHEN deaths < 0 OR deaths IS NULL THEN 'deaths below zero or missing' END, CASE WHEN role NOT IN ('top', 'mid', 'bot') THEN 'role not allowed' END], lambda x: x IS NOT NULL), '; ') AS violations FROM participants WHERE deaths < 0 OR role NOT IN ('top', 'mid', 'bot')""")
def record_violations(spark, sf_dir):
    out = X.record_violations(GP.participants(spark, sf_dir), ["deaths"], {"role": ("top", "mid", "bot")})
    return out.select("game_id", "participant_id", F.array_join("violations", "; ").alias("violations"))


@query("""SELECT match_id, floor(abs(p - 0.5) * 200 * 10 + 0.5) / 10 AS gap_pct, CASE WHEN abs(p - 0.5) * 200 >= 60 THEN 'lopsided' WHEN abs(p - 0.5) * 200 >= 30 THEN 'clear favourite' WHEN abs(p - 0.5) * 200 >= 10 THEN 'lean' ELSE 'coin flip' END AS angle
FROM (SELECT o_orderkey AS match_id, (1 + o_orderkey * 7 % 63) / 64.0::DOUBLE AS p FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01') ORDER BY abs(p - 0.5) DESC, match_id LIMIT 20""")
def watch_list(spark, sf_dir):
    k = F.col("o_orderkey")
    p = table(spark, sf_dir, "orders").where("o_orderdate >= timestamp'2001-01-01'").select(k.alias("match_id"), ((1 + k * 7 % 63) / 64.0).alias("p"))
    return X.watch_list(p).select("match_id", C.rounded(F.col("gap_pct"), 1).alias("gap_pct"), "angle")


@query("""WITH s AS (SELECT o_custkey % 20 AS a, 20 + o_custkey % 17 AS b, CASE o_orderkey % 3 WHEN 0 THEN '1' WHEN 1 THEN '2' ELSE '' END AS w FROM orders), r AS (SELECT 'T' || a AS team, CASE WHEN w = '1' THEN 1 ELSE 0 END AS won FROM s WHERE w <> '' UNION ALL SELECT 'T' || b, CASE WHEN w = '2' THEN 1 ELSE 0 END FROM s WHERE w <> '')
SELECT team, count(*) AS games, CAST(sum(won) AS BIGINT) AS wins FROM r GROUP BY 1""")
def schedule_win_rates(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = lambda x: F.concat(F.lit("T"), x.cast("string"))
    s = table(spark, sf_dir, "orders").select(name(c % 20).alias("team1"), name(20 + c % 17).alias("team2"), F.when(k % 3 == 0, "1").when(k % 3 == 1, "2").otherwise("").alias("winner"))
    return X.schedule_win_rates(s)


@query(f"""{GP.SERIES_SQL},{GP.S.participants_sql()}, g AS (SELECT series_key, unnest(game_ids) AS game_id, unnest(range(len(game_ids))) AS pos FROM series)
SELECT g.series_key, g.game_id, CAST(g.pos AS INT) AS pos, p.team1_win, (SELECT count(*) FROM participants x WHERE x.game_id = g.game_id) AS players FROM g JOIN pairs p ON p.game_id = g.game_id""")
def series_drilldown(spark, sf_dir):
    out = X.series_drilldown(GP.series(spark, sf_dir), GP.pairs(spark, sf_dir), GP.participants(spark, sf_dir))
    return out.select("series_key", "game_id", F.col("at").alias("pos"), "team1_win", F.size("players").cast("long").alias("players"))


@query(f"{GP.EP_SQL} SELECT 'entrants' AS table_name, count(*) AS rows FROM entrants UNION ALL SELECT 'participants', count(*) FROM participants")
def table_counts(spark, sf_dir):
    return X.table_counts({"entrants": GP.entrants(spark, sf_dir), "participants": GP.participants(spark, sf_dir)})


_RATES = ", ".join(R4.format(f"coalesce(avg(b) FILTER (r <= {n}), 0.5)") + f" AS first_pick_rate_{n}" for n in (10, 25))


@query(f"""{HP._NPAIRS}, p AS (SELECT game_id, team_key, event_date, (side = 'blue')::INT AS b FROM entrants)
SELECT game_id, team_key, {_RATES} FROM (SELECT s.game_id, s.team_key, p.b, row_number() OVER (PARTITION BY s.game_id, s.team_key ORDER BY p.event_date DESC, p.game_id DESC) AS r FROM p s LEFT JOIN p ON p.team_key = s.team_key AND p.event_date < s.event_date) GROUP BY 1, 2""")
def first_pick_rate(spark, sf_dir):
    """Share of first picks in the last 10 and 25 games; games of the same day are not seen."""
    e = GP.entrants(spark, sf_dir, "nation")
    return X.first_pick_rates(e.select("game_id", "team_key", "event_date", (F.col("side") == "blue").cast("int").alias("first_pick"))).select("game_id", "team_key", r4("first_pick_rate_10"), r4("first_pick_rate_25"))


@query(f"""{RP.FACTS_SQL} SELECT count(*) AS rows, count(DISTINCT game_id) AS games, count(DISTINCT player_key) AS players, count(DISTINCT team_key) AS teams, min(event_date) AS first_day, max(event_date) AS last_day FROM facts""")
def silver_totals(spark, sf_dir):
    f = RP.facts(spark, sf_dir)
    return f.agg(F.count("*").alias("rows"), F.countDistinct("game_id").alias("games"), F.countDistinct("player_key").alias("players"), F.countDistinct("team_key").alias("teams"), F.min("event_date").alias("first_day"), F.max("event_date").alias("last_day"))


@query(f"""{GP.E_SQL} SELECT DISTINCT game_id, league_code FROM entrants WHERE game_id IN (SELECT game_id FROM entrants WHERE team_key = 'team:T-ASIA') AND team_key <> 'team:T-ASIA'""")
def games_against(spark, sf_dir):
    """Semi join on one team's games."""
    e = GP.entrants(spark, sf_dir)
    return e.where("team_key <> 'team:T-ASIA'").join(e.where("team_key = 'team:T-ASIA'").select("game_id"), "game_id", "left_semi").select("game_id", "league_code").distinct()
