"""Data-quality checks and issue rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_rows(df: DataFrame, checks: dict[str, tuple[str, Column, float]]) -> DataFrame:
    """One row per check, from one pass over df. checks: name to (severity, failing condition, threshold percent)."""
    counted = df.agg(F.count("*").alias("total"), *[F.count(F.when(c, 1)).alias(n) for n, (_, c, _) in checks.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), F.lit(s).alias("severity"), F.col(n).alias("failing"), F.col("total").alias("total"), F.lit(float(t)).alias("threshold_pct")) for n, (s, _, t) in checks.items()]))
    out = counted.select(rows.alias("r")).select("r.*")
    pct = F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.floor(F.col("failing") * 10000.0 / F.col("total") + 0.5) / 100)
    return out.withColumn("failing_pct", pct).withColumn("passed", F.col("failing_pct") <= F.col("threshold_pct"))


def game_shape(entrants: DataFrame, participants: DataFrame, players: int = 10) -> DataFrame:
    """Per game: sides and participants, and whether both counts are as they should be."""
    sides = entrants.groupBy("game_id").agg(F.count("*").alias("sides"))
    people = participants.groupBy("game_id").agg(F.count("*").alias("people"))
    return sides.join(people, "game_id", "left").withColumn("people", F.coalesce("people", F.lit(0))).withColumn("shape_ok", (F.col("sides") == 2) & (F.col("people") == players))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def unique_grains(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """One row per table: keys, those that occur more than once, their percent, passed. tables: name to (rows, key columns)."""
    parts = []
    for name, (df, keys) in tables.items():
        counted = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.count("*").alias("keys"), F.count(F.when(F.col("n") > 1, 1)).alias("failing"))
        parts.append(counted.select(F.lit(name).alias("table_name"), "*"))
    pct = F.when(F.col("keys") == 0, F.lit(0.0)).otherwise(F.floor(F.col("failing") * 10000 / F.col("keys") + 0.5) / 100)
    return reduce(DataFrame.unionByName, parts).withColumns({"failing_pct": pct, "passed": F.col("failing") == 0})


def same_key_both_sides(participants: DataFrame) -> DataFrame:
    """Participants who appear on both sides of one game."""
    return participants.groupBy("game_id", "player_key").agg(F.countDistinct("side").alias("sides")).where("sides > 1")


def issue_rows(issues: dict[str, tuple[DataFrame, str, Column]]) -> DataFrame:
    """Union of issue queries: name to (failing rows, key column, detail)."""
    parts = [df.select(F.lit(n).alias("issue_type"), F.col(k).cast("string").alias("entity"), detail.alias("detail")) for n, (df, k, detail) in issues.items()]
    return reduce(DataFrame.unionByName, parts)


def quality_issues(entrants: DataFrame, participants: DataFrame, series: DataFrame, reconciled: DataFrame, players: int = 10) -> DataFrame:
    """The eight kinds of issue as rows issue_type, severity, entity_key, game_id, series_key, issue_detail.

    Games and series are grouped once each, whatever the number of kinds. reconciled holds the
    series with match_id, wiki_id, score_conflict and whether each source covers their day
    (official_covered, wiki_covered). A key that was made from a name stands for a missing id.
    """
    n = lambda what: F.concat(F.lit(f"Expected {what} rows, found "), F.col("n").cast("string"))
    kind = lambda name, severity, failing, detail: F.when(failing, F.struct(F.lit(name).alias("issue_type"), F.lit(severity).alias("severity"), detail.alias("issue_detail")))

    def rows(df: DataFrame, key: str, kinds: list[Column]) -> DataFrame:
        found = df.select(F.col(key).alias("entity_key"), F.explode(F.array_compact(F.array(*kinds))).alias("i"))
        ids = [(F.col("entity_key") if c == key else F.lit(None).cast("string")).alias(c) for c in ("game_id", "series_key")]
        return found.select("i.issue_type", "i.severity", "entity_key", *ids, "i.issue_detail")

    games = entrants.groupBy("game_id").agg(F.count("*").alias("n"), F.countDistinct("team_key").alias("teams"))
    people = participants.groupBy("game_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("player_key") == "playername:unknown", 1)).alias("unknown"))
    no_id = lambda c: F.col(c).isNull() | F.col(c).startswith("teamname:")
    parts = [
        rows(games, "game_id", [
            kind("game_team_count", "error", F.col("n") != 2, n("2 team")),
            kind("game_same_team_key_both_sides", "warning", F.col("teams") < 2, F.lit("Both sides have the same team_key.")),
        ]),
        rows(people, "game_id", [
            kind("game_player_count", "error", F.col("n") != players, n(f"{players} player")),
            kind("game_unknown_player_collisions", "warning", F.col("unknown") > 1, F.lit("Several rows of the game have the unknown player.")),
        ]),
        rows(series, "series_key", [kind("series_missing_team_id", "warning", no_id("team1_key") | no_id("team2_key"), F.lit("At least one side has no team id."))]),
        rows(reconciled, "series_key", [
            kind("official_series_unmatched", "warning", F.col("official_covered") & F.col("match_id").isNull(), F.lit("Inside official coverage, without official match.")),
            kind("wiki_series_unmatched", "warning", F.col("wiki_covered") & F.col("wiki_id").isNull(), F.lit("Inside wiki coverage, without wiki match.")),
            kind("multi_source_score_conflict", "warning", F.col("score_conflict"), F.lit("The wiki has another score.")),
        ]),
    ]
    return reduce(DataFrame.unionByName, parts)


class PublishBlocked(RuntimeError):
    """An error-level check failed; the pointer to the latest snapshot stays where it was."""


def publish_gate(checks: DataFrame) -> None:
    """Raise if an error-level check failed. Checks are a handful of rows."""
    failed = [r["check_name"] for r in checks.where("severity = 'error' and not passed").collect()]
    if failed:
        raise PublishBlocked(", ".join(sorted(failed)))
