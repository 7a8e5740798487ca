"""Assembled pre-match features, totals features and quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from arenalake.functions import columns as C
from arenalake.functions import market as M
from arenalake.functions.columns import first_text, infer_split, is_playoffs
from arenalake.operators import history as H
from arenalake.operators import reports as R
from arenalake.operators.schedules import infer_patch

#: Default lines of the totals markets.
# Fixed values, as published.
LINES = {"kills": 29.5, "dragons": 4.5, "towers": 12.5, "barons": 1.5, "inhibitors": 1.5}


def player_experience(facts: DataFrame, coming: DataFrame | None = None) -> DataFrame:
    """Per game and side of the players' earlier games: their mean number, the mean of the players' win rates (0.5
    without a result), and how many players have none. Games of the same day don't count.

    facts: game_id, side, player_key, event_date, and win if rates are wanted. coming: rosters of games
    without facts (game_id, side, player_key, event_date); they look back likewise and are seen by none.
    """
    won = F.max("win") if "win" in facts.columns else F.lit(None).cast("int")
    seen = facts.groupBy("game_id", "side", "player_key", "event_date").agg(won.alias("win")).withColumn("played", F.lit(1))
    if coming is not None:
        seen = seen.unionByName(coming.select("game_id", "side", "player_key", "event_date").distinct(), allowMissingColumns=True)
    w = H.before(["player_key"])
    rate = C.rate(F.coalesce(F.sum("win").over(w), F.lit(0)), F.count("win").over(w))
    known = seen.withColumns({"prior": F.count("played").over(w), "rate": rate})
    return known.groupBy("game_id", "side").agg(
        F.avg("prior").alias("mean_experience"), F.avg("rate").alias("mean_player_win_rate"), F.count(F.when(F.col("prior") == 0, 1)).alias("new_players")
    )


def rosters_of_coming(rosters: DataFrame, coming: DataFrame, announced: DataFrame | None = None, back: int = 3) -> DataFrame:
    """Roster of each team of games to come, and what it shares with the team's last rosters: coming's columns with roster,
    roster_source ('announced', 'last' or null), overlap_previous, overlap_mean.

    rosters: team_key, event_date, series_key, roster of what was played. coming: game_id, team_key, event_date.
    announced: game_id, team_key, roster. Without an announced roster the last one stands in, and its
    overlap is the one it had with those before it, as compared with itself it would always be full.
    """
    along = W.partitionBy("team_key").orderBy("event_date", "series_key")
    recent = F.array_compact(F.array(*[F.lag("roster", i).over(along) if i else F.col("roster") for i in range(back)]))
    state = R.roster_overlap(rosters, back).withColumn("recent", recent)
    at = H.as_of(state, coming, "team_key", ("event_date", "series_key"), ["roster", "recent", "overlap_previous", "overlap_mean"])
    if announced is None:
        return at.withColumn("roster_source", F.when(F.col("roster").isNotNull(), "last")).drop("recent")
    told = announced.select("game_id", "team_key", F.col("roster").alias("told"))
    shared = F.transform("recent", lambda r: F.size(F.array_intersect(r, "told")))
    mean = F.when(F.size("recent") > 0, F.aggregate(shared, F.lit(0.0), lambda x, y: x + y) / F.size("recent"))
    both, has = at.join(told, ["game_id", "team_key"], "left"), F.col("told").isNotNull()
    return both.withColumns({
        "overlap_previous": F.when(has, F.try_element_at(shared, F.lit(1))).otherwise(F.col("overlap_previous")), "overlap_mean": F.when(has, mean).otherwise(F.col("overlap_mean")),
        "roster_source": F.when(has, "announced").when(F.col("roster").isNotNull(), "last"), "roster": F.coalesce("told", "roster"),
    }).drop("told", "recent")


def prematch(pairs: DataFrame, future: DataFrame | None = None) -> DataFrame:
    """Feature rows of games: both sides' prior totals, recent form, streak, pair history, differences.

    future: pairs without results (team1_win null). They are taken along as events that add nothing,
    so one path serves training and scoring; their rows come back with a null label.
    """
    rows = pairs.withColumn("is_future", F.lit(False))
    if future is not None:
        rows = rows.unionByName(future.withColumn("is_future", F.lit(True)), allowMissingColumns=True)
    sides = H.sides(rows).join(rows.select("game_id", "is_future"), "game_id")
    form = H.recent_and_streak(H.prior_totals(sides, ["team_key"]))
    cols = ("prior_games", "prior_win_rate", "prior_days_since", "recent_rate", "streak")
    wide = form.groupBy("game_id").agg(*[F.max(F.when(F.col("slot") == i, F.col(c))).alias(f"team{i}_{c}") for i in (1, 2) for c in cols])
    diffs = {f"diff_{c}": F.col(f"team1_{c}") - F.col(f"team2_{c}") for c in cols}
    base = H.head_to_head(rows)
    out = base.join(wide, "game_id").withColumns(diffs)
    return out.select("game_id", "event_date", "league_code", "split_name", "patch_version", "team1_key", "team2_key", "is_future", *wide.columns[1:], *diffs, "h2h_games", "h2h_team1_rate", F.col("team1_win").alias("label_team1_win"))


#: Columns of a side that come from its players and picks, beside the form columns.
ROSTER_COLUMNS = ("roster_shared", "roster_shared_mean", "mean_experience", "mean_player_win_rate", "new_players", "unique_10", "unique_25", "top5_share", "first_pick_rate_10", "first_pick_rate_25")
SIDE_COLUMNS = ("patch_games", "patch_win_rate", "split_games", "split_win_rate", *ROSTER_COLUMNS)


def assembled(pairs: DataFrame, facts: DataFrame, future: DataFrame | None = None, announced: DataFrame | None = None) -> DataFrame:
    """prematch() with ratings, form on the patch and in the split, roster overlap, experience, draft pools and first picks.

    facts: game_id, side, team_key, event_date, player_key, champion_name, win of played games. Rows of future
    have the state of each team's latest played games: its last roster (or the announced one, game_id,
    team_key, roster) with its players' games so far, and its last picks. team<i>_roster_source says
    which ('played' for games that were).
    """
    base = prematch(pairs, future)
    rows = pairs if future is None else pairs.unionByName(future, allowMissingColumns=True)
    margin = F.least(F.abs(F.col("team1_kills") - F.col("team2_kills")), F.lit(10)) / 10.0
    ratings = H.elo(rows.withColumn("margin", margin)).drop("pool").withColumn("diff_rating", F.col("team1_rating") - F.col("team2_rating"))
    sides = H.sides(rows)
    form = H.prior_totals(H.prior_totals(sides, ["team_key", "patch_version"], "patch"), ["team_key", "split_name"], "split")
    own = facts.where("team_key is not null")
    rosters = own.groupBy(F.col("game_id").alias("series_key"), "event_date", "team_key").agg(F.array_sort(F.collect_set("player_key")).alias("roster"))
    overlap = R.roster_overlap(rosters).select(F.col("series_key").alias("game_id"), "team_key", F.col("overlap_previous").alias("roster_shared"), F.col("overlap_mean").alias("roster_shared_mean"), F.lit("played").alias("roster_source"))
    first = own.groupBy("game_id", "team_key", "event_date").agg(F.max((F.col("side") == "blue").cast("int")).alias("first_pick"))
    asks = fielded = None
    if future is not None:
        asks = H.sides(future).select("game_id", "team_key", "event_date")
        ahead = rosters_of_coming(rosters, asks, announced)
        overlap = overlap.unionByName(ahead.select("game_id", "team_key", F.col("overlap_previous").alias("roster_shared"), F.col("overlap_mean").alias("roster_shared_mean"), "roster_source"))
        # A team stands for a side of a game to come.
        fielded = ahead.select("game_id", F.col("team_key").alias("side"), "event_date", F.explode("roster").alias("player_key"))
    players = player_experience(facts, fielded)
    teams = own.select("game_id", "side", "team_key").distinct()
    if asks is not None:
        teams = teams.unionByName(asks.select("game_id", F.col("team_key").alias("side"), "team_key"))
    players = players.join(teams, ["game_id", "side"]).drop("side")
    each = form
    for more in (overlap, players, R.draft_pool(facts, coming=asks), first_pick_rates(first, asks)):
        each = each.join(more, ["game_id", "team_key"], "left")
    cols = [*SIDE_COLUMNS, "roster_source"]
    wide = each.groupBy("game_id").agg(*[F.max(F.when(F.col("slot") == i, F.col(c))).alias(f"team{i}_{c}") for i in (1, 2) for c in cols])
    diffs = {f"diff_{c}": F.col(f"team1_{c}") - F.col(f"team2_{c}") for c in SIDE_COLUMNS}
    return base.join(ratings, "game_id").join(wide, "game_id").withColumns(diffs)


#: What the totals features roll: markets for and against, and the length of games.
METRICS = tuple(f"{m}{x}" for m in LINES for x in ("", "_against")) + ("game_length_seconds",)


def totals_features(pairs: DataFrame, spans: tuple[int, ...] = (5, 10, 30), metrics: tuple[str, ...] = METRICS, markets: tuple[str, ...] = tuple(LINES), future: DataFrame | None = None) -> DataFrame:
    """Both sides' rolling metrics, averages and differences, targets and trailing baselines of the markets.

    Rows without a target go, but for the rows of future, whose targets are null; those look back on
    the last played games before their day, for the baselines too, however many of them there are.
    """
    rolled = H.rolling(H.sides(pairs), list(metrics), spans).withColumn("is_future", F.lit(False))
    games = pairs.withColumn("is_future", F.lit(False))
    if future is not None:
        ahead = H.rolling_ahead(H.sides(pairs), H.sides(future), list(metrics), spans).withColumn("is_future", F.lit(True))
        rolled = rolled.unionByName(ahead, allowMissingColumns=True)
        games = games.unionByName(future.withColumn("is_future", F.lit(True)), allowMissingColumns=True)
    names = [f"{m}_{a}_{n}" for n in spans for m in metrics for a in ("mean", "var")] + [f"games_{n}" for n in spans]
    both = rolled.groupBy("game_id").agg(*[F.max(F.when(F.col("slot") == i, F.struct(*names))).alias(f"__team{i}") for i in (1, 2)])
    wide = both.select("game_id", *[F.col(f"__team{i}.{c}").alias(f"team{i}_{c}") for i in (1, 2) for c in names])
    targets = {f"target_total_{m}": F.col(f"team1_{m}") + F.col(f"team2_{m}") for m in markets}
    out = games.withColumns(targets).where(F.col("is_future") | F.col(f"target_total_{markets[0]}").isNotNull())
    out = H.baselines(out, list(targets))
    out = out.withColumnsRenamed({f"target_total_{m}_{old}": f"baseline_{m}{new}" for m in markets for old, new in (("baseline", ""), ("source", "_source"))})
    pairwise = {f"avg_{c}": (F.col(f"team1_{c}") + F.col(f"team2_{c}")) / 2 for c in names} | {f"diff_{c}": F.col(f"team1_{c}") - F.col(f"team2_{c}") for c in names}
    kept = [c for m in markets for c in (f"baseline_{m}", f"baseline_{m}_source", f"target_total_{m}")]
    return out.join(wide, "game_id").withColumns(pairwise).select("game_id", "event_date", "league_code", "is_future", *wide.columns[1:], *pairwise, *kept)


def model_quotes(predicted: DataFrame, alpha: dict[str, float], lines: dict[str, float] = LINES) -> DataFrame:
    """Quotes of totals models: one row per match and market, from predicted means mu_<market>.

    The variance is mu + alpha mu^2, alpha being the market's overdispersion on the rows it was fitted on.
    """
    market = lambda m, x: F.struct(F.lit(m).alias("market"), F.lit(x).alias("line"), F.greatest(F.col(f"mu_{m}"), F.lit(0.01)).alias("mu"), F.lit(float(alpha[m])).alias("alpha"))
    rows = predicted.select("game_id", F.explode(F.array(*[market(m, x) for m, x in lines.items()])).alias("q")).select("game_id", "q.*")
    variance = F.col("mu") + F.col("alpha") * F.col("mu") ** 2
    quoted = rows.withColumns({"variance": variance, "over": M.over_probability(F.col("mu"), variance, F.col("line"))})
    return quoted.withColumns({"fair_over": M.fair_odds(F.col("over")), "fair_under": M.fair_odds(1 - F.col("over"))}).drop("alpha")


def totals_quotes(stats: DataFrame, lines: dict[str, float] = LINES) -> DataFrame:
    """One row per match and market: shrunk mean and variance, chance over the line, fair odds, sample warning.

    stats: match_id, games, and for each market <m>_mean, <m>_var, <m>_prior.
    """
    market = lambda m, line: F.struct(F.lit(m).alias("market"), F.lit(line).alias("line"), F.col(f"{m}_mean").alias("mean"), F.col(f"{m}_var").alias("variance"), F.col(f"{m}_prior").alias("prior"))
    rows = stats.select("match_id", "games", F.explode(F.array(*[market(m, x) for m, x in lines.items()])).alias("q")).select("match_id", "games", "q.*")
    mean = M.shrink(F.col("mean"), F.col("games"), F.col("prior"))
    variance = M.shrink(F.col("variance"), F.col("games"), F.col("prior"))
    out = rows.select("match_id", "games", "market", "line", mean.alias("mean"), variance.alias("variance"))
    p = M.over_probability(F.col("mean"), F.col("variance"), F.col("line"))
    return out.withColumn("over", p).withColumns({"fair_over": M.fair_odds(F.col("over")), "fair_under": M.fair_odds(1 - F.col("over")), "warning": F.when(F.col("games") < 10, "small sample")})


def quotes_with_fallback(model: DataFrame, heuristic: DataFrame) -> DataFrame:
    """Model quote where there is one, else the heuristic: match_id, market, over, source."""
    m = model.select("match_id", "market", F.col("over").alias("m_over"))
    both = heuristic.select("match_id", "market", F.col("over").alias("h_over")).join(m, ["match_id", "market"], "full")
    return both.select("match_id", "market", F.coalesce("m_over", "h_over").alias("over"), F.when(F.col("m_over").isNotNull(), "model").otherwise("heuristic").alias("source"))


def match_context(matches: DataFrame, aliases: DataFrame) -> DataFrame:
    """League code (explicit, slug or alias, else the name), split, playoffs and best-of of a match.

    matches: match_id, league, slug, league_code, split_name, phase, best_of. aliases: slug, code.
    Explicit values override inferred ones; best_of is 3 unless given, and at least 1. Matches with a column
    patch get a patch_version: their own, else the latest seen.
    """
    text = F.concat_ws(" ", "phase", "league")
    own = infer_patch(matches) if "patch" in matches.columns else matches
    known = own.join(F.broadcast(aliases.withColumnRenamed("code", "alias_code")), "slug", "left")
    code = first_text(F.col("league_code"), F.col("alias_code"), F.upper("league"))
    return known.select(
        "match_id", code.alias("league_code"), F.coalesce(first_text(F.col("split_name")), infer_split(text, code)).alias("split_name"), is_playoffs(text).alias("playoffs"),
        F.greatest(F.coalesce("best_of", F.lit(3)), F.lit(1)).alias("best_of"), *([F.col("patch").alias("patch_version")] if own is not matches else []),
    )


def league_label(code: Column, labels: dict[str, str]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), code), code)


def record_violations(rows: DataFrame, counts: list[str], enums: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows that break a record rule, with the rules: negative or missing counts, values outside an enum, untrimmed text."""
    rules = [F.when(F.col(c).isNull() | (F.col(c) < 0), F.lit(f"{c} below zero or missing")) for c in counts]
    rules += [F.when(~F.col(c).isin(*allowed) | F.col(c).isNull(), F.lit(f"{c} not allowed")) for c, allowed in enums.items()]
    return rows.withColumn("violations", F.array_compact(F.array(*rules))).where(F.size("violations") > 0)


def watch_list(predictions: DataFrame, n: int = 20) -> DataFrame:
    """Matches with the widest gap between the sides, with an angle label."""
    gap = F.abs(F.col("p") - 0.5) * 200
    angle = F.when(gap >= 60, "lopsided").when(gap >= 30, "clear favourite").when(gap >= 10, "lean").otherwise("coin flip")
    return predictions.withColumns({"gap_pct": gap, "angle": angle}).orderBy(F.desc("gap_pct"), "match_id").limit(n)


def schedule_win_rates(schedule: DataFrame) -> DataFrame:
    """Win rate per team of a schedule whose winner is '1' or '2'; undecided rows count as no game."""
    side = lambda t, w: F.struct(F.col(t).alias("team"), (F.col("winner") == w).cast("int").alias("won"))
    rows = schedule.where("winner in ('1', '2')").select(F.explode(F.array(side("team1", "1"), side("team2", "2"))).alias("s")).select("s.*")
    return rows.groupBy("team").agg(F.count("*").alias("games"), F.sum("won").alias("wins"))


def series_drilldown(series: DataFrame, pairs: DataFrame, players: DataFrame) -> DataFrame:
    """Games of each series with both sides and their players, in one join."""
    games = series.select("series_key", F.posexplode("game_ids").alias("at", "game_id"))
    listed = players.groupBy("game_id").agg(F.array_sort(F.collect_list(F.struct("side", "participant_id", "player_key"))).alias("players"))
    return games.join(pairs.drop("league_code", "event_date"), "game_id").join(listed, "game_id", "left")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table, as a table."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def first_pick_rates(drafts: DataFrame, coming: DataFrame | None = None, spans: tuple[int, ...] = (10, 25)) -> DataFrame:
    """Share of a team's last n games before each game's day in which it picked first, 0.5 without any.

    drafts: game_id, team_key, event_date, first_pick (0 or 1). coming: game_id, team_key, event_date of games
    without a draft. Returns game_id, team_key, first_pick_rate_<n>.
    """
    order = ("event_date", "game_id")
    state = drafts.withColumns({f"first_pick_rate_{n}": F.avg("first_pick").over(W.partitionBy("team_key").orderBy(*order).rowsBetween(-n + 1, 0)) for n in spans})
    asks = drafts.select("game_id", "team_key", "event_date")
    asks = asks if coming is None else asks.unionByName(coming.select(*asks.columns))
    known = H.as_of(state, asks, "team_key", order, [f"first_pick_rate_{n}" for n in spans])
    return known.select("game_id", "team_key", *[F.coalesce(f"first_pick_rate_{n}", F.lit(0.5)).alias(f"first_pick_rate_{n}") for n in spans])
