"""Joined report parts: backdrops, impact, lookups, scored sheets, source metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arenalake.functions import market as M
from arenalake.functions.columns import percent
from arenalake.operators.reports import team_trend


def game_backdrop(pairs: DataFrame, entrants: DataFrame, as_of: str, days: int = 180) -> DataFrame:
    """Both sides' trend at as_of for each pair of teams that met: rates, labels, who comes in stronger."""
    t = team_trend(entrants, as_of, days).select("team_key", "recent_rate", "label")
    side = lambda i: t.select(F.col("team_key").alias(f"team{i}_key"), F.col("recent_rate").alias(f"team{i}_rate"), F.col("label").alias(f"team{i}_label"))
    met = pairs.select("team1_key", "team2_key").distinct().join(side(1), "team1_key", "left").join(side(2), "team2_key", "left")
    gap = F.col("team1_rate") - F.col("team2_rate")
    return met.withColumn("edge", F.when(gap >= 0.05, "team1").when(gap <= -0.05, "team2").when(gap.isNull(), "unknown").otherwise("even"))


def player_impact(facts: DataFrame, least_games: int = 5) -> DataFrame:
    """Share of the team's kills and assists that a player takes part in, by team."""
    team = facts.where("team_key is not null").groupBy("team_key", "game_id").agg(F.sum("kills").alias("team_kills"))
    p = facts.join(team, ["team_key", "game_id"]).groupBy("team_key", "player_key").agg(F.countDistinct("game_id").alias("games"), F.sum("kills").alias("kills"), F.sum("team_kills").alias("team_kills"))
    return p.where(F.col("games") >= least_games).withColumn("kill_share_pct", percent(F.col("kills"), F.col("team_kills")))


def with_predictions(matches: DataFrame, predictions: DataFrame, required: bool = False) -> DataFrame:
    """Upcoming matches with their prediction, if any (or only those that have one)."""
    return matches.join(predictions, "match_id", "inner" if required else "left")


def lookup(table: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of a serving table for a list of keys, by a semi join."""
    return table.join(wanted.select(key).distinct(), key, "left_semi")


def score_sheet(sheet: DataFrame, predictions: DataFrame) -> DataFrame:
    """Each sheet row with its EV on the first side, or the reason why it has none; no row is lost."""
    j = sheet.join(predictions, "match_id", "left")
    error = (
        F.when(F.col("team1_odds").isNull() | F.col("team2_odds").isNull(), "missing odds").when((F.col("team1_odds") <= 1) | (F.col("team2_odds") <= 1), "odds must exceed 1")
        .when(F.col("p").isNull(), "no prediction")
    )
    return j.withColumn("score_error", error).withColumn("score_available", error.isNull()).withColumn("ev", F.when(F.col("score_available"), M.expected_value(F.col("p"), F.col("team1_odds"))))


def source_metadata(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """One row per source: rows, latest day, and its leagues as JSON text. tables: name to (rows, day column)."""
    parts = [df.agg(F.count("*").alias("rows"), F.max(day).alias("latest"), F.to_json(F.array_sort(F.collect_set("league_code"))).alias("leagues_json")).select(F.lit(n).alias("source"), "*") for n, (df, day) in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def prob_win_board(matches: DataFrame, winner: DataFrame, totals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matches with their winner market, and totals markets, as two flat tables; what failed is a row with its error.

    matches: match_id and anything else. winner: match_id, p, warnings (array), error (null where p is). totals: match_id,
    market, line, mean, over, error (market null where a match has none). A match that is missing in winner or
    totals has the error 'not scored'.
    """
    w = winner.select("match_id", "p", F.col("warnings").alias("__w"), F.col("error").alias("__e"), F.lit(True).alias("__scored"))
    quoted = totals.groupBy("match_id").agg(F.count("market").alias("__markets"), F.max("error").alias("__t"))
    p, missing = F.col("p"), F.lit("not scored")
    winner_error = F.when(p.isNull(), F.coalesce("__e", missing))
    totals_error = F.when(F.coalesce("__markets", F.lit(0)) == 0, F.coalesce("__t", missing))
    board = matches.join(w, "match_id", "left").join(quoted, "match_id", "left").withColumns({
        "winner_available": p.isNotNull(), "winner_error": winner_error, "team1_win_prob": p, "team2_win_prob": 1 - p, "team1_fair_odds": M.fair_odds(p), "team2_fair_odds": M.fair_odds(1 - p),
        "favorite": F.when(p >= 0.5, "team1").when(p < 0.5, "team2"), "favorite_prob_pct": F.greatest(p, 1 - p) * 100, "totals_available": totals_error.isNull(), "totals_error": totals_error,
        "warnings_json": F.to_json(F.array_distinct(F.array_compact(F.concat(F.coalesce("__w", F.array().cast("array<string>")), F.array(winner_error, totals_error))))),
    }).drop("p", "__w", "__e", "__scored", "__markets", "__t")
    over = F.col("over")
    flat = totals.where("market is not null").select(
        "match_id", F.col("market").alias("market_key"), "line", F.col("mean").alias("predicted_mean"), over.alias("over_prob"), (1 - over).alias("under_prob"),
        M.fair_odds(over).alias("over_fair_odds"), M.fair_odds(1 - over).alias("under_fair_odds"),
    )
    return board, flat.join(matches.select("match_id"), "match_id", "left_semi")
