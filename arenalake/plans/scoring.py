"""Queries: schedules, splits, metrics, models, explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from arenalake.functions import columns as C
from arenalake.operators import history as H
from arenalake.operators import ml as M
from arenalake.operators import schedules as X
from arenalake.functions import market
from arenalake.operators import features as X_FEATURES
from arenalake.plans import features as FP
from arenalake.plans import gold as GP
from arenalake.plans.registry import query
from arenalake.sources import files
from arenalake.sources.files import materialise
from arenalake.sources.standin import table

NOW = "2000-06-01 00:00:00"

# Orders as wiki schedule rows: unknown teams, winners and scores by modulus.
_WIKI = """w AS (SELECT 'P/' || o_orderkey || '_1' AS MatchId, CASE o_orderkey % 19 WHEN 0 THEN 'TBD' ELSE ' Team ' || o_custkey % 50 END AS Team1, CASE o_orderkey % 23 WHEN 0 THEN 'nan' ELSE 'Team ' || o_custkey % 31 END AS Team2,
  CASE WHEN o_orderkey % 3 = 0 THEN '1' ELSE '' END AS Winner, CASE WHEN o_orderkey % 5 = 0 THEN '2' END AS Team1Score, NULL AS Team2Score, o_orderdate AS t, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '3.0' ELSE '5' END AS BestOf,
  CASE o_orderkey % 6 WHEN 0 THEN '' ELSE year(o_orderdate) || ' ' || o_orderpriority || '/Main' END AS OverviewPage, CASE o_orderkey % 2 WHEN 0 THEN 'Round 1' ELSE 'Final' END AS Tab, CASE o_orderkey % 3 WHEN 1 THEN 'Round 1' ELSE '1' END AS MatchDay, '14.' || o_orderkey % 9 AS Patch FROM orders)"""


def wiki_rows(spark, sf_dir):
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("P/"), s(k), F.lit("_1")).alias("MatchId"), F.when(k % 19 == 0, "TBD").otherwise(F.concat(F.lit(" Team "), s(F.col("o_custkey") % 50))).alias("Team1"),
        F.when(k % 23 == 0, "nan").otherwise(F.concat(F.lit("Team "), s(F.col("o_custkey") % 31))).alias("Team2"), F.when(k % 3 == 0, "1").otherwise("").alias("Winner"),
        F.when(k % 5 == 0, "2").alias("Team1Score"), F.lit(None).cast("string").alias("Team2Score"), s(F.col("o_orderdate")).alias("DateTimeUTC"),
        F.when(k % 4 == 0, "").when(k % 4 == 1, "3.0").otherwise("5").alias("BestOf"), F.when(k % 6 == 0, "").otherwise(F.concat(s(F.year("o_orderdate")), F.lit(" "), "o_orderpriority", F.lit("/Main"))).alias("OverviewPage"),
        F.when(k % 2 == 0, "Round 1").otherwise("Final").alias("Tab"), F.when(k % 3 == 1, "Round 1").otherwise("1").alias("MatchDay"), F.concat(F.lit("14."), s(k % 9)).alias("Patch"),
    )


@query(f"""WITH {_WIKI} SELECT MatchId AS match_id, t AS match_time, CAST(t AS DATE) AS match_date, CASE WHEN OverviewPage <> '' THEN regexp_replace(split_part(OverviewPage, '/', 1), '^\\d{{4}}\\s+', '') ELSE 'P' END AS league,
CASE WHEN OverviewPage = '' THEN MatchId ELSE OverviewPage END AS event_name, CASE WHEN Tab = MatchDay THEN Tab ELSE Tab || ' · ' || MatchDay END AS phase_label, trim(Team1) AS team1, trim(Team2) AS team2,
CASE BestOf WHEN '' THEN NULL WHEN '3.0' THEN 3 ELSE 5 END AS best_of, Patch AS patch FROM w WHERE t >= TIMESTAMP '{NOW}' AND Team1 <> 'TBD' AND Team2 <> 'nan' AND Winner = '' AND Team1Score IS NULL""")
def upcoming_wiki_matches(spark, sf_dir):
    return X.upcoming_wiki(wiki_rows(spark, sf_dir), NOW)


_EVENT_FIELDS = """o_orderkey AS k, o_orderdate AS start_time, CASE WHEN o_orderdate < TIMESTAMP '2000-06-01' THEN 'completed' ELSE 'unstarted' END AS state"""


def official_events(spark, sf_dir):
    """Orders as nested official events: wins on the teams, in the games, or nowhere."""
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    none = F.lit(None).cast("string")
    done = F.col("o_orderdate") < F.lit(NOW).cast("timestamp")
    wins = lambda m: F.when(done & (k % 3 == 0), s(k % m))
    def team(n, m):
        return F.struct(
            F.concat(F.lit(f"t{n}-"), s(k)).alias("id"), F.when(k % 4 != 0, F.concat(F.lit(f"Team{n} "), s(F.col("o_custkey")))).otherwise("").alias("name"), F.concat(F.lit(f"C{n}-"), s(F.col("o_custkey"))).alias("code"), none.alias("slug"), none.alias("outcome"),
            F.struct(F.when(done & (k % 12 == n), "win").alias("outcome"), wins(m).alias("gameWins"), none.alias("wins")).alias("result"), F.struct(none.alias("wins")).alias("record"), none.alias("gameWins"), none.alias("score"),
        ).cast(X.TEAM)
    game = lambda i: F.struct(F.lit("completed").alias("state"), F.when(done & (k % 3 == 1), F.concat(F.when((k + i) % 2 == 0, "t1-").otherwise("t2-"), s(k))).alias("winnerId"), F.when(k % 5 == i, F.concat(F.lit("26."), s(k % 7))).otherwise("").alias("patch"))
    e = F.struct(
        F.concat(F.lit("E"), s(k)).alias("id"), F.when(k % 13 == 0, "show").otherwise("match").alias("type"), F.when(done, "completed").otherwise("unstarted").alias("state"), F.col("o_orderdate").alias("startTime"),
        F.when(k % 8 == 0, "Playoffs").when(k % 8 == 1, "Spring Split 2").otherwise("Split 3 Week").alias("blockName"), F.struct(F.col("o_orderpriority").alias("name"), F.lit("slug").alias("slug")).alias("league"),
        F.struct(F.concat(F.lit("M"), s(k)).alias("id"), F.struct(F.when(k % 2 == 0, 5).alias("count")).alias("strategy"), F.array(team(1, 4), team(2, 3)).alias("teams")).alias("match"), F.array(game(0), game(1), game(2)).alias("games"),
    ).cast(X.EVENT)
    return table(spark, sf_dir, "orders").select(e.alias("e"))


@query("""WITH b AS (SELECT *, o_orderkey AS k, o_orderdate < TIMESTAMP '2000-06-01' AS done FROM orders WHERE o_orderkey % 13 <> 0),
s AS (SELECT *, CASE WHEN done AND k % 3 = 0 THEN k % 4 WHEN done AND k % 3 = 1 THEN CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END END::INT AS score1,
 CASE WHEN done AND k % 3 = 0 THEN k % 3 WHEN done AND k % 3 = 1 THEN CASE WHEN k % 2 = 0 THEN 1 ELSE 2 END END::INT AS score2,
 CASE WHEN k % 4 <> 0 THEN 'Team1 ' || o_custkey ELSE 'C1-' || o_custkey END AS team1, CASE WHEN k % 4 <> 0 THEN 'Team2 ' || o_custkey ELSE 'C2-' || o_custkey END AS team2 FROM b)
SELECT 'M' || k AS match_id, o_orderdate AS start_time, CASE WHEN done THEN 'completed' ELSE 'unstarted' END AS state, o_orderpriority AS league, CASE WHEN k % 8 = 0 THEN 'Playoffs' WHEN k % 8 = 1 THEN 'Spring Split 2' ELSE 'Split 3 Week' END AS phase,
CASE WHEN k % 2 = 0 THEN 5 ELSE 3 END AS best_of, team1, team2, score1, score2, CASE WHEN k % 5 < 3 THEN '26.' || k % 7 END AS patch, CASE WHEN k % 8 = 0 THEN NULL WHEN k % 8 = 1 THEN 'Spring' ELSE 'Split 3' END AS split_name, k % 8 = 0 AS playoffs,
CASE WHEN done AND k % 12 = 1 THEN team1 WHEN done AND k % 12 = 2 THEN team2 WHEN score1 > score2 THEN team1 WHEN score2 > score1 THEN team2 END AS winner FROM s""")
def official_event_rows(spark, sf_dir):
    return X.normalise_events(official_events(spark, sf_dir))


@query("SELECT 'M' || o_orderkey AS match_id, 'recent' AS kind FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderdate < TIMESTAMP '2000-06-01' AND o_orderdate >= TIMESTAMP '2000-06-01' - INTERVAL 30 DAY UNION ALL SELECT 'M' || o_orderkey, 'upcoming' FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderdate >= TIMESTAMP '2000-06-01'")
def schedule_refresh(spark, sf_dir):
    recent, coming = X.recent_and_upcoming(X.normalise_events(official_events(spark, sf_dir)), NOW, 30)
    return recent.select("match_id", F.lit("recent").alias("kind")).unionByName(coming.select("match_id", F.lit("upcoming").alias("kind")))


@query("""WITH m AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 < 3 THEN '26.' || o_orderkey % 7 END AS patch FROM orders WHERE o_orderkey % 13 <> 0) SELECT 'M' || k AS match_id, coalesce(patch, (SELECT max(patch) FROM m)) AS patch FROM m""")
def inferred_patches(spark, sf_dir):
    return X.infer_patch(X.normalise_events(official_events(spark, sf_dir))).select("match_id", "patch")


@query("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def first_event_by_id(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("page_key", F.concat_ws("|", "user_id", "event_type"))
    return X.first_by_id(e.withColumnRenamed("event_id", "own").withColumnRenamed("page_key", "event_id"), ["ts", "own"]).select(F.col("own").alias("event_id"), "user_id", "event_type")


@query("SELECT p_partkey, replace(list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ''), ' ', '') AS asset FROM part")
def champion_assets(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.asset_id(F.col("p_name")).alias("asset"))


@query("""SELECT o_orderkey, o_orderkey || CASE WHEN o_orderkey % 100 BETWEEN 11 AND 13 THEN 'th' WHEN o_orderkey % 10 = 1 THEN 'st' WHEN o_orderkey % 10 = 2 THEN 'nd' WHEN o_orderkey % 10 = 3 THEN 'rd' ELSE 'th' END AS place,
CASE WHEN v < 0 THEN '-' ELSE '+' END || CAST(CAST(abs(v) AS DECIMAL(18, 1)) AS VARCHAR) AS change FROM (SELECT o_orderkey, floor((o_orderkey % 400 - 200) / 8.0 * 10 + 0.5) / 10 AS v FROM orders)""")
def text_labels(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", C.ordinal(k).alias("place"), C.signed((k % 400 - 200) / 8.0).alias("change"))


@query("""SELECT o_orderkey, CASE WHEN f IN ('1', 'true', 'yes') THEN true WHEN f IN ('0', 'no') THEN false END AS flag, f = 'maybe' AS rejected FROM (SELECT o_orderkey, (['1', 'true', 'yes', '0', 'no', 'maybe', ''])[CAST(o_orderkey % 7 + 1 AS INT)] AS f FROM orders)""")
def optional_flags(spark, sf_dir):
    text = F.element_at(F.array(*map(F.lit, ("1", "TRUE", " yes ", "0", "No", "maybe", ""))), (F.col("o_orderkey") % 7 + 1).cast("int"))
    value, bad = X.optional_bool(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", value.alias("flag"), bad.alias("rejected"))


# What a match page says, from the assembled features of played games and games to come.

_TITLES = tuple(t for t in M.SIGNALS if t != "Base rating edge")
_SIGNAL_SQL = {
    "Recent form": ("(x.rr - y.rr) * 100", 10, "least(a.n, 5) + least(b.n, 5) >= 4"), "Long-run form": ("(x.pr - y.pr) * 100", 8, "a.n + b.n >= 12"), "Patch fit": ("(x.patch_rate - y.patch_rate) * 100", 8, "x.patch_games + y.patch_games >= 4"),
    "Split fit": ("(x.split_rate - y.split_rate) * 100", 8, "x.split_games + y.split_games >= 4"), "Head-to-head": ("(CASE WHEN h.n = 0 THEN 0.5 ELSE h.w / h.n END - 0.5) * 100", 10, "h.n >= 2"),
    "Roster continuity": ("x.om - y.om", 1, "abs(x.om - y.om) > 0.01"), "Roster stability": ("-(x.fresh - y.fresh)", 1, "abs(x.fresh - y.fresh) > 0.01"),
}
_STRUCTS = ", ".join(f"CASE WHEN {gate} AND ({diff}) IS NOT NULL THEN {{'o': -round(abs({diff}) / {scale}.0, 9), 'i': {i}, 't': '{t}', 's': CASE WHEN ({diff}) >= 0 THEN 1 ELSE 2 END}} END" for i, (t, (diff, scale, gate)) in enumerate(_SIGNAL_SQL.items()))


@query(f"""{FP._ASSEMBLED}, rate AS (SELECT s.game_id, s.slot, count(p.game_id) AS n, coalesce(sum(p.win), 0) AS w, count(p.game_id) FILTER (p.patch_version IS NOT DISTINCT FROM s.patch_version) AS pn, coalesce(sum(p.win) FILTER (p.patch_version IS NOT DISTINCT FROM s.patch_version), 0) AS pw,
  count(p.game_id) FILTER (p.split_name IS NOT DISTINCT FROM s.split_name) AS sn FROM s LEFT JOIN s p ON p.team_key = s.team_key AND p.event_date < s.event_date AND p.win IS NOT NULL GROUP BY 1, 2),
num AS (SELECT s.*, g.game_number FROM s JOIN pairs g USING (game_id)),
rec AS (SELECT game_id, slot, avg(win) AS rr FROM (SELECT s.game_id, s.slot, p.win, row_number() OVER (PARTITION BY s.game_id, s.slot ORDER BY p.event_date DESC, p.game_number DESC, p.game_id DESC) AS r FROM s JOIN num p ON p.team_key = s.team_key AND p.event_date < s.event_date AND p.win IS NOT NULL) WHERE r <= 5 GROUP BY 1, 2),
side2 AS (SELECT each.game_id, each.slot, om, fresh, split_rate, rate.sn AS split_games, rate.pn AS patch_games, CASE WHEN rate.pn = 0 THEN 0.5 ELSE rate.pw / rate.pn END AS patch_rate, CASE WHEN rate.n = 0 THEN 0.5 ELSE rate.w / rate.n END AS pr, coalesce(rr, 0.5) AS rr FROM each JOIN rate ON rate.game_id = each.game_id AND rate.slot = each.slot LEFT JOIN rec ON rec.game_id = each.game_id AND rec.slot = each.slot),
t AS (SELECT g.game_id, g.team1_key, g.team2_key, x.pr - y.pr AS gap, [z.t || ':' || z.s FOR z IN list_sort(list_filter([{_STRUCTS}], lambda q: q IS NOT NULL))[1:4]] AS said
  FROM pairs g JOIN form a ON a.game_id = g.game_id AND a.team_key = g.team1_key JOIN form b ON b.game_id = g.game_id AND b.team_key = g.team2_key JOIN h ON h.game_id = g.game_id JOIN side2 x ON x.game_id = g.game_id AND x.slot = 1 JOIN side2 y ON y.game_id = g.game_id AND y.slot = 2)
SELECT game_id, array_to_string(said, ',') AS signals, CASE WHEN abs(gap) * 100 >= 28 THEN 'High conviction' WHEN abs(gap) * 100 >= 16 THEN 'Solid edge' WHEN abs(gap) * 100 <= 8 THEN 'Fragile read' ELSE 'Leaning favorite' END AS confidence_label,
CASE WHEN gap >= 0 THEN team1_key ELSE team2_key END || CASE WHEN len(said) > 0 THEN ' projects as the favorite mainly through ' || lower(array_to_string([split_part(z, ':', 1) FOR z IN said[1:2]], ', ')) || '.' ELSE ' projects as the favorite on the current prematch inputs.' END AS summary FROM t""")
def match_explanations(spark, sf_dir):
    """Seven of the eight published signals (ratings have SQL of their own) from real columns, confidence by the gap in win rates, and the summary."""
    rows = FP.assembled(spark, sf_dir).where("diff_prior_win_rate is not null")
    round_ = {c: F.round(c, 11) for c in ("diff_recent_rate", "diff_prior_win_rate", "diff_patch_win_rate", "diff_split_win_rate", "h2h_team1_rate", "diff_roster_shared_mean")}  # differences of like rates may differ in the last bit
    out = M.explain_matches(rows.withColumns(round_), 0.5 + F.col("diff_prior_win_rate") / 2, titles=_TITLES)
    told = F.transform("signals", lambda s: F.concat(s["title"], F.lit(":"), F.when(s["side"] == "team1", "1").otherwise("2")))
    return out.select("game_id", F.array_join(told, ",").alias("signals"), "confidence_label", "summary")


# Splits and metrics over the prior-form table.

_SCORED = f"""WITH {GP.S.entrants_sql('nation')},{GP.B.PAIRS_SQL},
scored AS (SELECT game_id, league_code, event_date, team1_win AS label, (1 + game_number * 37 % 98) / 100.0::DOUBLE AS p, team1_kills + team2_kills AS y, (20 + game_number % 40)::DOUBLE AS mu FROM pairs)"""


def scored(spark, sf_dir):
    g = F.col("game_number")
    return GP.pairs(spark, sf_dir, "nation").select("game_id", "league_code", "event_date", F.col("team1_win").alias("label"), ((1 + g * 37 % 98) / 100.0).alias("p"), (F.col("team1_kills") + F.col("team2_kills")).alias("y"), (20.0 + g % 40).alias("mu"))


@query(f"{_SCORED} SELECT CASE WHEN event_date < DATE '1999-01-01' THEN 'train' WHEN event_date < DATE '2000-01-01' THEN 'validation' ELSE 'test' END AS split, count(*) AS n, min(event_date) AS first_day, max(event_date) AS last_day FROM scored GROUP BY 1")
def calendar_split(spark, sf_dir):
    s = M.calendar_split(scored(spark, sf_dir), "1999-01-01", "2000-01-01")
    return s.groupBy("split").agg(F.count("*").alias("n"), F.min("event_date").alias("first_day"), F.max("event_date").alias("last_day"))


@query(f"""{_SCORED}, d AS (SELECT event_date, row_number() OVER (ORDER BY event_date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT event_date FROM scored)),
g AS (SELECT event_date, CASE WHEN i < n % 6 * (n // 6 + 1) THEN i // (n // 6 + 1) ELSE n % 6 + (i - n % 6 * (n // 6 + 1)) // (n // 6) END::INT AS segment FROM d)
SELECT segment, count(*) AS n, min(event_date) AS first_day, max(event_date) AS last_day FROM scored JOIN g USING (event_date) GROUP BY 1""")
def expanding_folds(spark, sf_dir):
    return M.expanding_folds(scored(spark, sf_dir), 5).groupBy("segment").agg(F.count("*").alias("n"), F.min("event_date").alias("first_day"), F.max("event_date").alias("last_day"))


@query(f"""{_SCORED}, d AS (SELECT event_date, row_number() OVER (ORDER BY event_date) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT event_date FROM scored))
SELECT CASE WHEN i <= greatest(floor(n * (1 - 0.15)), 1) THEN 'train' ELSE 'test' END AS split, count(*) AS n, min(event_date) AS first_day, max(event_date) AS last_day FROM scored JOIN d USING (event_date) GROUP BY 1""")
def holdout_split(spark, sf_dir):
    s = M.holdout_by_days(scored(spark, sf_dir), 0.15)
    return s.groupBy("split").agg(F.count("*").alias("n"), F.min("event_date").alias("first_day"), F.max("event_date").alias("last_day"))


def _round5(*cols):
    return [C.rounded(F.col(c), 5).alias(c) for c in cols]


@query(f"""{_SCORED}, r AS (SELECT *, rank() OVER (PARTITION BY league_code ORDER BY p) + (count(*) OVER (PARTITION BY league_code, p) - 1) / 2 AS rk FROM scored)
SELECT league_code, count(*) AS n, floor(avg(-(label * ln(p) + (1 - label) * ln(1 - p))) * 100000 + 0.5) / 100000 AS log_loss, floor(avg((p - label) ** 2) * 100000 + 0.5) / 100000 AS brier,
floor((sum(rk) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))) * 100000 + 0.5) / 100000 AS roc_auc FROM r GROUP BY 1""")
def metrics_by_league(spark, sf_dir):
    return M.classification_metrics(scored(spark, sf_dir), ["league_code"]).select("league_code", "n", *_round5("log_loss", "brier", "roc_auc"))


@query(f"{_SCORED} SELECT greatest(ceil(p * 10), 1)::INT AS bin, count(*) AS n, floor(avg(p) * 100000 + 0.5) / 100000 AS mean_p, floor(avg(label) * 100000 + 0.5) / 100000 AS observed FROM scored GROUP BY 1")
def calibration_bins(spark, sf_dir):
    return M.calibration_bins(scored(spark, sf_dir)).select("bin", "n", *_round5("mean_p", "observed"))


@query(f"""{_SCORED} SELECT league_code, count(*) AS n, floor(avg(abs(y - mu)) * 100000 + 0.5) / 100000 AS mae, floor(sqrt(avg((y - mu) ** 2)) * 100000 + 0.5) / 100000 AS rmse, floor(avg(y) * 100000 + 0.5) / 100000 AS target_mean,
floor(avg(greatest((y - mu) ** 2 - mu, 0)) / avg(mu * mu) * 100000 + 0.5) / 100000 AS alpha FROM scored GROUP BY 1""")
def totals_metrics(spark, sf_dir):
    return M.regression_metrics(scored(spark, sf_dir), ["league_code"], "y", "mu").select("league_code", "n", *_round5("mae", "rmse", "target_mean", "alpha"))


def training_rows(spark, sf_dir):
    pairs = GP.pairs(spark, sf_dir, "nation")
    form = H.prior_totals(H.sides(pairs), ["team_key"]).groupBy("game_id").agg(*[F.max(F.when(F.col("slot") == i, F.col(c))).alias(f"team{i}_{c}") for i in (1, 2) for c in ("prior_games", "prior_win_rate")])
    rows = H.head_to_head(pairs).join(form, "game_id")
    return rows.select("game_id", "event_date", "league_code", F.col("team1_win").cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in NUMERIC])


NUMERIC = ["team1_prior_games", "team2_prior_games", "team1_prior_win_rate", "team2_prior_win_rate", "h2h_team1_rate"]


@query()
def win_model_predictions(spark, sf_dir):
    """Refit on train and validation, probabilities and fair odds for the test window."""
    rows = materialise(M.calendar_split(training_rows(spark, sf_dir), "1999-01-01", "2000-01-01"), "training")
    model = M.win_model("logistic", NUMERIC, ["league_code"], "label").fit(rows.where("split <> 'test'"))
    p = M.probability()
    return model.transform(rows.where("split = 'test'")).select("game_id", "label", p.alias("p"), (1 / p).alias("fair_odds"))


PREMATCH = [
    f"{p}_{c}" for c in ("prior_games", "prior_win_rate", "prior_days_since", "recent_rate", "streak", "patch_games", "patch_win_rate", "split_games", "split_win_rate", "roster_shared", "roster_shared_mean", "mean_experience", "mean_player_win_rate", "new_players", "unique_10", "unique_25", "top5_share", "first_pick_rate_10", "first_pick_rate_25")
    for p in ("team1", "team2", "diff")
] + ["team1_rating", "team2_rating", "diff_rating", "team1_expected", "h2h_games", "h2h_team1_rate"]


def prematch_rows(spark, sf_dir):
    """Assembled features of played games and games to come, as a written table of doubles with its categories."""
    rows = FP.assembled(spark, sf_dir).select("game_id", "event_date", "league_code", "split_name", "patch_version", "team1_key", "team2_key", "is_future", F.col("label_team1_win").cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in PREMATCH])
    return materialise(rows.withColumn("split_name", F.coalesce("split_name", "league_code")), "prematch")


@query()
def future_win_scores(spark, sf_dir):
    """Matches to come: fitted on all played games, saved as a run, loaded by its pointer. A split that the model hasn't
    seen counts as the league; what it hasn't seen is told."""
    rows = prematch_rows(spark, sf_dir)
    played = rows.where("not is_future")
    seen = {c: sorted(r[0] for r in played.select(c).distinct().collect() if r[0]) for c in ("league_code", "split_name", "patch_version")}  # dimensions
    teams = played.select(F.explode(F.array("team1_key", "team2_key")).alias("team")).distinct()
    root = files.scratch_dir(spark, "win-model")
    M.save_run(M.win_model("logistic", PREMATCH, ["league_code", "split_name"], "label").fit(played), root, "run", seen | {"features": PREMATCH})
    model, about = M.load_run(root)
    p = M.probability()
    coming = rows.where("is_future")
    for i in (1, 2):
        coming = coming.join(teams.select(F.col("team").alias(f"team{i}_key"), F.lit(True).alias(f"known{i}")), f"team{i}_key", "left")
    split = M.known_or(F.col("split_name"), about["split_name"], F.col("league_code"))
    told = F.array_compact(F.array(
        F.when(split != F.col("split_name"), F.concat(F.lit("split "), "split_name", F.lit(" not seen, league taken"))), F.when(~split.isin(about["split_name"]), F.concat(F.lit("split "), split, F.lit(" not seen"))),
        F.when(F.col("known1").isNull(), F.concat("team1_key", F.lit(" not seen"))), F.when(F.col("known2").isNull(), F.concat("team2_key", F.lit(" not seen"))),
        F.when(~F.col("league_code").isin(about["league_code"]), F.concat(F.lit("league "), "league_code", F.lit(" not seen"))), F.when(~F.col("patch_version").isin(about["patch_version"]), F.concat(F.lit("patch "), "patch_version", F.lit(" not seen"))),
    ))
    scored = model.transform(coming.withColumns({"warnings": told, "split_name": split})).withColumn("p", p)
    return scored.select("game_id", "p", market.fair_odds(F.col("p")).alias("fair_team1"), market.fair_odds(1 - F.col("p")).alias("fair_team2"), F.array_join("warnings", "; ").alias("warnings"))


@query()
def future_kills_quotes(spark, sf_dir):
    """Matches to come: ridge on total kills, quotes at the default line with the market's overdispersion."""
    played, coming = FP.played_and_coming(spark, sf_dir)
    rows = materialise(X_FEATURES.totals_features(played, (10,), ("kills", "kills_against"), ("kills",), coming), "totals")
    numeric = [c for c in rows.columns if c.startswith(("avg_", "diff_")) and "_mean_" in c] + ["baseline_kills"]
    cast = rows.select("game_id", "league_code", "is_future", *[F.col(c).cast("double").alias(c) for c in (*numeric, "target_total_kills")])
    model = M.totals_model("ridge", numeric, ["league_code"], "target_total_kills").fit(cast.where("not is_future"))
    predicted = model.transform(cast).withColumnRenamed("prediction", "mu_kills")
    alpha = M.regression_metrics(predicted.where("not is_future"), [], "target_total_kills", "mu_kills").first()["alpha"]
    return X_FEATURES.model_quotes(predicted.where("is_future"), {"kills": alpha or 0.0}, {"kills": X_FEATURES.LINES["kills"]})


def totals_rows(spark, sf_dir):
    """What the models of all markets look at, of played games and of matches to come, and the targets, as a written table."""
    played, coming = (materialise(df, "pairs") for df in FP.played_and_coming(spark, sf_dir))
    rows = X_FEATURES.totals_features(played, future=coming)
    used = [c for m in X_FEATURES.LINES for c in (*totals_numeric(rows, m), f"target_total_{m}")]  # the others are never made
    return materialise(rows.select("game_id", "event_date", "league_code", "is_future", *[F.col(c).cast("double").alias(c) for c in dict.fromkeys(used)]), "totals")


def totals_numeric(rows, market):
    """What a market's model looks at: pair averages and differences of all rolled means, and the market's baseline."""
    return [c for c in rows.columns if c.startswith(("avg_", "diff_")) and "_mean_" in c] + [f"baseline_{market}"]


@query()
def future_totals_quotes(spark, sf_dir):
    """Matches to come: ridge per market on all rolled means, quotes at the default lines with each market's overdispersion."""
    rows = totals_rows(spark, sf_dir)
    predicted, alpha = rows.where("is_future").select("game_id"), {}
    for m in X_FEATURES.LINES:  # five fits, each over its own columns; what it predicts is written, so that no plan holds two of them
        y, numeric = f"target_total_{m}", totals_numeric(rows, m)
        own = rows.where(f"is_future or {y} is not null").select("game_id", "league_code", "is_future", y, *numeric)
        model = M.totals_model("ridge", numeric, ["league_code"], y).fit(own.where("not is_future"))
        scored = materialise(model.transform(own).select("game_id", "is_future", F.col(y), F.col("prediction").alias(f"mu_{m}")), "quoted")
        alpha[m] = M.regression_metrics(scored.where("not is_future"), [], y, f"mu_{m}").first()["alpha"] or 0.0
        predicted = predicted.join(scored.where("is_future").select("game_id", f"mu_{m}"), "game_id")
    return X_FEATURES.model_quotes(predicted, alpha)


#: Boosted trees of the registered evaluations, as published.
TREES = 300
KINDS, FOLDS = ("logistic", "boosted"), 3


def fold_rows(spark, sf_dir):
    """Metrics of both kinds of win model on every fold, over the assembled features of played games."""
    rows = prematch_rows(spark, sf_dir).where("not is_future").select("game_id", "event_date", "league_code", "split_name", "label", *PREMATCH)
    return M.evaluate_folds(rows, KINDS, FOLDS, PREMATCH, ["league_code"], "label", TREES)


@query()
def win_model_selection(spark, sf_dir):
    """Both kinds of win model by their mean metrics over the folds, best first, with what they rest on."""
    folds = materialise(fold_rows(spark, sf_dir), "fold-metrics")
    return folds.join(M.select_model(folds).select("model", "place", F.col("log_loss").alias("mean_log_loss")), "model")


@query()
def win_model_holdout(spark, sf_dir):
    """Refit on train and validation: holdout metrics of each kind of model and league, from the written predictions."""
    rows = M.calendar_split(prematch_rows(spark, sf_dir).where("not is_future"), "1999-01-01", "2000-01-01").select("game_id", "event_date", "split", "league_code", "label", *PREMATCH)
    kept = M.save_evaluation(M.holdout_predictions(rows, KINDS, PREMATCH, ["league_code"], "label", TREES), files.scratch_dir(spark, "run"))
    return kept["league_metrics"].unionByName(kept["metrics"].withColumn("league_code", F.lit("all")))


@query()
def totals_model_predictions(spark, sf_dir):
    """Ridge and boosted trees for all five targets on all rolled means: metrics of the test window per market and model."""
    rows = M.calendar_split(totals_rows(spark, sf_dir).where("not is_future"), "1999-01-01", "2000-01-01")
    targets = {f"target_total_{m}": totals_numeric(rows, m) for m in X_FEATURES.LINES}
    predicted = M.totals_predictions(rows, targets, ("ridge", "boosted"), ["league_code"], TREES)
    return M.regression_metrics(predicted.where("split = 'test'"), ["market", "model"], "y", "mu")


@query(f"""{_SCORED}, t AS (SELECT *, abs(p - 0.5) * 200 AS gap, (y % 13)::DOUBLE AS spread FROM scored) SELECT game_id, CASE WHEN gap >= 28 AND spread <= 4 THEN 'High conviction' WHEN gap >= 16 AND spread <= 7.5 THEN 'Solid edge' WHEN gap <= 8 OR spread >= 10 THEN 'Fragile read' ELSE 'Leaning favorite' END AS tier,
array_to_string(list_transform(list_sort(list_filter([CASE WHEN y >= 10 THEN {{'o': -abs(p - 0.5) / 0.2, 't': 'form'}} END, {{'o': -abs(mu - 40) / 10, 't': 'pace'}}], lambda x: x IS NOT NULL)), lambda x: x.t), ',') AS titles FROM t""")
def explanations(spark, sf_dir):
    s = scored(spark, sf_dir)
    out = M.explain(s, {"form": (F.col("p") - 0.5, 0.2, F.col("y") >= 10), "pace": (F.col("mu") - 40, 10.0, F.lit(True))})
    return out.select("game_id", M.confidence_tier(F.abs(F.col("p") - 0.5) * 200, (F.col("y") % 13).cast("double")).alias("tier"), F.array_join(F.transform("signals", lambda x: x["title"]), ",").alias("titles"))
