"""Offered odds against model probabilities, and the bet ledger."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from arenalake.functions import market as M
from arenalake.operators.schedules import optional_bool

# Columns of a market sheet, the headers that stand for each (the first one present counts), and what must be there.
HEADERS = {
    "match_id": ("match_id", "id"), "match_time": ("match_time", "start_time", "kickoff_time", "commence_time", "date_time"), "league": ("league", "competition", "tournament_league"),
    "event_name": ("event_name", "event", "tournament", "competition_name"), "phase_label": ("phase_label", "phase", "stage", "round"),
    "team1": ("team1", "home_team", "team_a", "participant1", "selection1"), "team2": ("team2", "away_team", "team_b", "participant2", "selection2"),
    "team1_odds": ("team1_odds", "odds_team1", "home_odds", "team_a_odds", "odds1"), "team2_odds": ("team2_odds", "odds_team2", "away_odds", "team_b_odds", "odds2"),
    "best_of": ("best_of", "bo", "series_best_of"), "patch": ("patch", "patch_version"), "league_code": ("league_code",), "split_name": ("split_name", "split"),
    "playoffs": ("playoffs", "is_playoffs"), "bookmaker": ("bookmaker", "sportsbook", "book"), "stake": ("stake", "unit_stake", "bet_size"), "notes": ("notes", "comment", "memo"),
}
REQUIRED = ("match_time", "team1", "team2", "team1_odds", "team2_odds")
#: Type of the columns that aren't text.
SHEET_TYPES = {"team1_odds": "double", "team2_odds": "double", "best_of": "double", "stake": "double"}


def conform_sheet(sheet: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A sheet of text or typed columns with all columns of HEADERS, and its rejects (the same columns and a reason).

    Headers are matched in lower case with '_' for other characters. Missing optional columns are null;
    a missing required one, or neither league nor league_code, raises ValueError. Numbers that can't be
    read are null; a playoffs flag that can't be read rejects the row.
    """
    known = {re.sub(r"[^a-z0-9]+", "_", c.strip().lower()).strip("_"): c for c in sheet.columns}
    picked = {name: next((known[a] for a in options if a in known), None) for name, options in HEADERS.items()}
    if missing := [n for n in REQUIRED if picked[n] is None]:
        raise ValueError("missing columns: " + ", ".join(missing))
    if picked["league"] is None and picked["league_code"] is None:
        raise ValueError("missing columns: league or league_code")
    text = sheet.select(*[(F.col(f"`{c}`").cast("string") if c else F.lit(None).cast("string")).alias(n) for n, c in picked.items()])
    flag, bad = optional_bool(F.col("playoffs"))
    typed = text.withColumns({"__bad": F.coalesce(bad, F.lit(False)), "playoffs": flag} | {n: F.trim(n).try_cast(t) for n, t in SHEET_TYPES.items()})
    reject = typed.where("__bad").drop("__bad").withColumn("reason", F.lit("playoffs flag can't be read"))
    return typed.where("not __bad").drop("__bad"), reject


def evaluate_sides(market: DataFrame) -> DataFrame:
    """Two rows per match: odds, model and market probability, edge, EV, Kelly fraction.

    market: match_id, team1_odds, team2_odds, team1_probability. Odds of 1 or less give null measures.
    """
    p = F.col("team1_probability")
    side = lambda n, odds, other, p: F.struct(F.lit(n).alias("selection"), F.col(odds).alias("odds"), F.col(other).alias("other_odds"), p.alias("probability"))
    rows = market.select("match_id", F.explode(F.array(side("team1", "team1_odds", "team2_odds", p), side("team2", "team2_odds", "team1_odds", 1 - p))).alias("s")).select("match_id", "s.*")
    return rows.withColumns({
        "fair_odds": M.fair_odds(F.col("probability")), "market_probability": M.devig(F.col("odds"), F.col("other_odds")), "overround": M.overround(F.col("odds"), F.col("other_odds")),
        "ev": F.when(F.col("odds") > 1, M.expected_value(F.col("probability"), F.col("odds"))), "kelly": M.kelly(F.col("probability"), F.col("odds")),
    }).withColumn("edge", F.col("probability") - F.col("market_probability"))


def recommend(sides: DataFrame, least_edge: float = 0.03, least_ev: float = 0.02, most_odds: float = 5.0) -> DataFrame:
    """The best side of each match within thresholds: by EV, edge, Kelly, probability, then name."""
    fit = sides.where((F.col("edge") >= least_edge) & (F.col("ev") >= least_ev) & (F.col("odds") <= most_odds))
    order = W.partitionBy("match_id").orderBy(F.desc("ev"), F.desc("edge"), F.desc("kelly"), F.desc("probability"), "selection")
    return fit.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def score_both_sides(sheet: DataFrame, predictions: DataFrame, least_edge: float = 0.0, least_ev: float = 0.0, least_kelly: float = 0.0) -> DataFrame:
    """Each sheet row with the measures of both sides and the recommended one, in board order; no row is lost.

    sheet: match_id, team1_odds, team2_odds; predictions: match_id, p. A row that can't be scored has
    score_error and no measures. Both sides are in one row, so nothing is grouped. Recommended
    rows come first, by EV, edge and match_id.
    """
    j = sheet.join(predictions, "match_id", "left")
    error = (
        F.when(F.col("team1_odds").isNull() | F.col("team2_odds").isNull(), "missing odds").when((F.col("team1_odds") <= 1) | (F.col("team2_odds") <= 1), "odds must exceed 1")
        .when(F.col("p").isNull(), "no prediction")
    )

    def side(i: int, p: Column) -> Column:
        odds, other = F.col(f"team{i}_odds"), F.col(f"team{3 - i}_odds")
        edge = p - M.devig(odds, other)
        return F.struct(M.expected_value(p, odds).alias("ev"), edge.alias("edge"), M.kelly(p, odds).alias("kelly"), p.alias("probability"), F.lit(-i).alias("rank"), F.lit(f"team{i}").alias("selection"), odds.alias("odds"))

    scored = j.withColumn("score_error", error).withColumn("sides", F.when(error.isNull(), F.array(side(1, F.col("p")), side(2, 1 - F.col("p")))))
    fits = lambda s: (s["ev"] >= least_ev) & (s["edge"] >= least_edge) & (s["kelly"] >= least_kelly)
    best = scored.withColumn("best", F.array_max(F.filter("sides", fits)))
    measures = {f"team{i}_{m}_pct": F.col("sides")[i - 1][m] * 100 for i in (1, 2) for m in ("edge", "ev", "kelly")}
    chosen = {"recommended_selection": F.col("best.selection"), "recommended_odds": F.col("best.odds"), "recommended_ev_pct": F.col("best.ev") * 100, "recommended_edge_pct": F.col("best.edge") * 100}
    out = best.withColumns({"score_available": F.col("score_error").isNull(), "recommend_bet": F.col("best").isNotNull()} | measures | chosen).drop("sides", "best")
    return out.orderBy(F.desc("recommend_bet"), F.desc_nulls_last("recommended_ev_pct"), F.desc_nulls_last("recommended_edge_pct"), "match_id")


def highlights(recommended: DataFrame, n: int = 5) -> DataFrame:
    """The n best recommended sides: by EV, edge, then the earlier match."""
    return recommended.orderBy(F.desc("ev"), F.desc("edge"), "match_time", "match_id").limit(n)


def bet_records(proposals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Open bets with the columns derived from their odds, and proposals that are refused with the reason.

    proposals: bet_id, odds, stake, and fair_odds or model_probability; the one that is missing comes
    from the other. Null odds or stakes are refused.
    """
    odds, fair, p, stake = (F.col(c) for c in ("odds", "fair_odds", "model_probability", "stake"))
    no = lambda good: ~F.coalesce(good, F.lit(False))
    reason = (
        F.when(no(odds > 1), "odds must exceed 1").when(no(stake > 0), "stake must exceed 0").when(fair.isNull() & p.isNull(), "no fair odds or model probability")
        .when(fair <= 1, "fair odds must exceed 1").when((p <= 0) | (p >= 1), "model probability must be between 0 and 1")
    )
    tested = proposals.withColumn("reason", reason)
    good = tested.where("reason is null").drop("reason").withColumns({"model_probability": F.coalesce(p, 1 / fair), "fair_odds": F.coalesce(fair, 1 / p)})
    good = good.withColumns({
        "status": F.lit("open"), "market_implied_probability": 1 / odds, "edge_probability": p - 1 / odds, "ev_per_unit": p * odds - 1,
        "potential_payout": stake * odds, "potential_profit": stake * (odds - 1),
    })
    return good, tested.where("reason is not null").select("bet_id", "reason")


DEDUP_KEYS = ("match_time", "team1_name", "team2_name", "bookmaker", "selection", "league_code", "model_name")


def _folded(df: DataFrame) -> DataFrame:
    keys = {f"__{k}": F.lower(F.trim(F.coalesce(F.col(k).cast("string"), F.lit("")))) for k in DEDUP_KEYS}
    return df.withColumns(keys | {"__odds": F.round("odds", 4)})


def append_bets(ledger: DataFrame, proposals: DataFrame, stake: float = 1.0, prefix: str | None = None) -> DataFrame:
    """Proposals that aren't open in the ledger yet, once each, as open bets. Keys are compared in lower case, odds to 4 places.

    A stake that isn't above 0 becomes `stake`. With prefix, notes say where the bets come from: the prefix,
    the proposal's notes and its recommendation_reason, as far as there are any.
    """
    if stake <= 0:
        raise ValueError("stake must exceed 0")
    keys = [f"__{k}" for k in DEDUP_KEYS] + ["__odds"]
    open_bets = _folded(ledger.where("status = 'open'")).select(*keys).distinct()
    once = _folded(proposals).withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy("bet_id"))).where("r = 1").drop("r")
    fresh = once.join(open_bets, keys, "left_anti").drop(*keys)
    out = fresh.withColumns({"stake": F.when(F.col("stake") > 0, F.col("stake")).otherwise(F.lit(stake)), "status": F.lit("open")})
    if prefix is None:
        return out
    told = [F.col(c) if c in out.columns else F.lit(None).cast("string") for c in ("notes", "recommendation_reason")]
    return out.withColumn("notes", M.joined_notes(M.joined_notes(F.lit(prefix), told[0]), told[1]))


def settle(bets: DataFrame, settlements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Open bets with their outcome, and settlements that are refused (unknown bet or already settled).

    Outcome is win, loss, push or void; profit is stake x (odds - 1), -stake, or 0. Where settlements
    have settlement_notes, they are joined to the notes of the bet.
    """
    joined = settlements.join(bets, "bet_id", "left")
    if "settlement_notes" in settlements.columns:
        old = F.col("notes") if "notes" in bets.columns else F.lit(None).cast("string")
        joined = joined.withColumn("notes", M.joined_notes(old, F.col("settlement_notes"))).drop("settlement_notes")
    profit = F.when(F.col("outcome") == "win", F.col("stake") * (F.col("odds") - 1)).when(F.col("outcome") == "loss", -F.col("stake")).otherwise(F.lit(0.0))
    good = joined.where("status = 'open' and outcome in ('win', 'loss', 'push', 'void')").withColumns({"profit": profit, "status": F.lit("settled")}).withColumn("roi_pct", F.when(F.col("stake") > 0, F.col("profit") / F.col("stake") * 100))
    reason = F.when(F.col("status").isNull(), "unknown bet").when(F.col("status") != "open", "already settled").otherwise("unknown outcome")
    bad = joined.where("status is null or status <> 'open' or outcome is null or outcome not in ('win', 'loss', 'push', 'void')").select("bet_id", "outcome", reason.alias("reason"))
    return good, bad


def current_state(events: DataFrame) -> DataFrame:
    """Last event of each bet in an append-only ledger (bet_id, seq, ...)."""
    return events.withColumn("r", F.row_number().over(W.partitionBy("bet_id").orderBy(F.desc("seq")))).where("r = 1").drop("r")


def ledger_summary(ledger: DataFrame) -> DataFrame:
    """One row: counts, stake, profit, ROI, hit rate, mean edge, expected value of open bets."""
    done = F.col("status") == "settled"
    decided = done & F.col("outcome").isin("win", "loss")
    stake = F.sum(F.when(done, F.col("stake")))
    return ledger.agg(
        F.count("*").alias("bets"), F.count(F.when(F.col("status") == "open", 1)).alias("open_bets"), F.count(F.when(done, 1)).alias("settled_bets"),
        F.coalesce(stake, F.lit(0.0)).alias("staked"), F.coalesce(F.sum(F.when(done, F.col("profit"))), F.lit(0.0)).alias("profit"),
        F.try_divide(F.sum(F.when(done, F.col("profit"))) * 100, stake).alias("roi_pct"),
        F.try_divide(F.count(F.when(decided & (F.col("outcome") == "win"), 1)) * 100.0, F.count(F.when(decided, 1))).alias("hit_rate_pct"),
        F.avg("edge").alias("mean_edge"), F.coalesce(F.sum(F.when(F.col("status") == "open", F.col("ev") * F.col("stake"))), F.lit(0.0)).alias("open_ev"),
    )
