"""Dimensions, game facts and series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from arenalake.functions.columns import kda, score_text, series_format, winner


def latest(value: str, *order: str):
    """Value of the last row by a total order, among rows where it isn't null."""
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order)))


def league_dimension(entrants: DataFrame, curated: DataFrame) -> DataFrame:
    """Leagues with first and last day, games, seasons, and a curated status (league_code, region, core)."""
    seen = entrants.groupBy("league_code").agg(
        F.min("event_date").alias("first_seen"), F.max("event_date").alias("last_seen"),
        F.countDistinct("game_id").alias("games"), F.countDistinct("season_year").alias("seasons"),
    )
    status = F.when(F.col("core") == 1, "core").when(F.col("region").isNotNull(), "known").otherwise("uncurated")
    return seen.join(F.broadcast(curated), "league_code", "left").withColumn("status", status)


def team_dimension(entrants: DataFrame) -> DataFrame:
    """Teams with their latest name, all names and leagues, and rows that lack an id."""
    return entrants.groupBy("team_key").agg(
        latest("team_name", "event_date", "game_number", "side").alias("team_name"),
        F.array_join(F.array_sort(F.collect_set("league_code")), ",").alias("leagues"),
        F.countDistinct("team_name").alias("name_variants"), F.count(F.when(F.col("team_id").isNull(), 1)).alias("missing_id_rows"),
        F.countDistinct("game_id").alias("games"), F.min("event_date").alias("first_seen"), F.max("event_date").alias("last_seen"),
    )


def player_dimension(participants: DataFrame) -> DataFrame:
    """Players with their latest name and the role they played most (ties by role name)."""
    roles = participants.groupBy("player_key", "role").agg(F.count("*").alias("role_games"))
    top = roles.withColumn("r", F.row_number().over(W.partitionBy("player_key").orderBy(F.desc("role_games"), "role"))).where("r = 1")
    who = participants.groupBy("player_key").agg(
        latest("player_name", "event_date", "game_id", "participant_id").alias("player_name"),
        F.countDistinct("game_id").alias("games"), F.countDistinct("champion_name").alias("champions"), F.min("event_date").alias("first_seen"),
    )
    return who.join(top.select("player_key", F.col("role").alias("primary_role"), "role_games"), "player_key", "left")


def player_facts(participants: DataFrame, entrants: DataFrame) -> DataFrame:
    """Participant rows with their team, the result, and per-row ratios."""
    side = entrants.select("game_id", "side", "team_key", "win", "game_length_seconds")
    return participants.join(side, ["game_id", "side"], "left").withColumn("kda", kda(F.col("kills"), F.col("deaths"), F.col("assists"))).withColumn(
        "dpm", F.when(F.col("game_length_seconds") > 0, F.col("damage") * 60.0 / F.col("game_length_seconds"))
    )


def draft_facts(participants: DataFrame) -> DataFrame:
    """One row per game and side: champions by role, and whether all five roles are present."""
    pick = lambda r: F.min(F.when(F.col("role") == r, F.col("champion_name"))).alias(f"pick_{r}")
    roles = ("top", "jng", "mid", "bot", "sup")
    complete = F.lit(True)
    for r in roles:
        complete &= F.col(f"pick_{r}").isNotNull()
    return participants.groupBy("game_id", "side").agg(*map(pick, roles), F.count("*").alias("picks")).withColumn("draft_complete", complete)


def daily_series(pairs: DataFrame) -> DataFrame:
    """Games of a pair on one day: wins of both, ordered game ids, mean length."""
    listed = F.array_sort(F.collect_list(F.struct("game_number", "game_id")))
    return pairs.groupBy("league_code", "season_year", "event_date", "team1_key", "team2_key").agg(
        F.count("*").alias("games"), F.sum("team1_win").alias("team1_wins"), F.sum("team2_win").alias("team2_wins"),
        F.max("split_name").alias("split_name"), F.max("playoffs").alias("playoffs"), F.transform(listed, lambda g: g["game_id"]).alias("game_ids"),
        F.avg("game_length_seconds").alias("mean_length"),
    )


PAIR = ("league_code", "season_year", "team1_key", "team2_key")


def merge_days(daily: DataFrame, mode: str = "chained") -> DataFrame:
    """Series of a pair over following days.

    chained: any run of days without a gap is one series (gaps and islands). pairwise: a day joins
    the day before it, looking one row back only, as the published pipeline does; a day that is
    both the second of one and the first of another keeps the role of a first day.
    """
    along = W.partitionBy(*PAIR).orderBy("event_date")
    follows = F.coalesce(F.datediff("event_date", F.lag("event_date").over(along)) == 1, F.lit(False))
    d = daily.withColumn("follows", follows)
    if mode == "chained":
        island = d.withColumn("island", F.sum(F.when(F.col("follows"), 0).otherwise(1)).over(along.rowsBetween(W.unboundedPreceding, 0)))
        parts = F.array_sort(F.collect_list(F.struct("event_date", "game_ids")))
        merged = island.groupBy(*PAIR, "island").agg(
            F.min("event_date").alias("event_date"), F.count("*").alias("days"), F.sum("games").alias("games"),
            F.sum("team1_wins").alias("team1_wins"), F.sum("team2_wins").alias("team2_wins"), F.max("playoffs").alias("playoffs"),
            F.flatten(F.transform(parts, lambda p: p["game_ids"])).alias("game_ids"),
        ).drop("island")
    else:
        before = lambda c: F.when(F.col("follows"), F.lag(c).over(along))
        joined = d.withColumns({
            "first_day": F.coalesce(F.lead("follows").over(along), F.lit(False)), "p_date": before("event_date"), "p_games": before("games"),
            "p_w1": before("team1_wins"), "p_w2": before("team2_wins"), "p_ids": before("game_ids"),
        })
        zero = lambda c: F.coalesce(c, F.lit(0))
        merged = joined.where("not first_day").select(
            *PAIR, F.coalesce("p_date", "event_date").alias("event_date"), F.when(F.col("follows"), 2).otherwise(1).cast("long").alias("days"),
            (F.col("games") + zero("p_games")).alias("games"), (F.col("team1_wins") + zero("p_w1")).alias("team1_wins"),
            (F.col("team2_wins") + zero("p_w2")).alias("team2_wins"), "playoffs",
            F.when(F.col("follows"), F.concat("p_ids", "game_ids")).otherwise(F.col("game_ids")).alias("game_ids"),
        )
    k1, k2, w1, w2 = map(F.col, ("team1_key", "team2_key", "team1_wins", "team2_wins"))
    return merged.withColumns({
        "series_key": F.concat_ws(":", F.lit("series"), "league_code", "season_year", "event_date", k1, k2),
        "series_format": series_format(F.greatest(w1, w2) * 2 - 1), "score": score_text(w1, w2), "winner_key": winner(w1, w2, k1, k2),
    })


def tournament_phases(series: DataFrame) -> DataFrame:
    """Phase of each series by its place from the season's end: the last playoff day holds the final."""
    season = W.partitionBy("league_code", "season_year")
    day = W.partitionBy("league_code", "season_year", "event_date")
    back = F.row_number().over(season.orderBy(F.desc("event_date"), F.desc("series_key")))
    last = F.max(F.when(F.col("playoffs") == 1, F.col("event_date"))).over(season)
    s = series.withColumns({"from_end": back, "same_day": F.count("*").over(day), "last_playoff": last})
    left = F.datediff("last_playoff", "event_date")
    phase = (
        F.when((F.col("playoffs") == 1) & (left == 0) & (F.col("same_day") == 1), "Final").when((F.col("playoffs") == 1) & (left <= 7), "Semifinal")
        .when(F.col("playoffs") == 1, "Playoffs").otherwise("Regular Season")
    )
    return s.withColumn("phase", phase).drop("last_playoff")


def competition_phases(series: DataFrame, international: list[str]) -> DataFrame:
    """Phase of each series, by one rule for international tournaments and one for leagues: series with from_end, days_from_end, phase.

    International: by place and distance from the tournament's end and the number of games. Leagues: playoffs
    by place from the end of the split; a null split is a split. Places follow date, games and key, latest first.
    """
    last = F.max("event_date").over(W.partitionBy("league_code", "season_year"))
    s = series.withColumns({"days_from_end": F.datediff(last, "event_date"), "same_day": F.count("*").over(W.partitionBy("league_code", "season_year", "event_date"))})
    order = (F.desc("event_date"), F.desc("games"), F.desc("series_key"))
    abroad = F.coalesce(F.col("league_code").isin(international), F.lit(False))
    games, days, place = F.col("games"), F.col("days_from_end"), F.col("from_end")
    tournament = (
        F.when((place == 1) & (games >= 3), "Final").when((days == 0) & (F.col("same_day") == 1), "Final").when(place.isin(2, 3) & (games >= 3) & (days <= 10), "Semifinal")
        .when(place.between(4, 8) & (games >= 3) & (days <= 20), "Quarterfinal").when((games <= 2) & (F.col("same_day") >= 2), "Swiss/Groups").when(days > 25, "Play-in").otherwise("Group Stage")
    )
    playoffs = F.col("playoffs") == 1
    league = F.when(playoffs & (place == 1) & (games >= 3), "Final").when(playoffs & place.isin(2, 3) & (games >= 3), "Semifinal").when(playoffs, "Playoffs").otherwise("Regular Season")
    world = s.where(abroad).withColumn("from_end", F.row_number().over(W.partitionBy("league_code", "season_year").orderBy(*order))).withColumn("phase", tournament)
    home = s.where(~abroad).withColumn("from_end", F.row_number().over(W.partitionBy("league_code", "season_year", "split_name").orderBy(*order))).withColumn("phase", league)
    return world.unionByName(home)


def series_sides(series: DataFrame) -> DataFrame:
    """Team-centric rows of series: each once per side, with win (null for a draw), games won and played."""
    shared = ("series_key", "league_code", "season_year", "event_date", "games")
    side = lambda a, b: F.struct(F.lit(a).alias("slot"), F.col(f"team{a}_key").alias("team_key"), F.col(f"team{b}_key").alias("opponent_key"), (F.col("winner_key") == F.col(f"team{a}_key")).cast("int").alias("win"), F.col(f"team{a}_wins").alias("games_won"))
    return series.select(*shared, F.explode(F.array(side(1, 2), side(2, 1))).alias("s")).select(*shared, "s.*")


def champions_of(series: DataFrame) -> DataFrame:
    """Winner and runner-up of the last series of each league and season, with the score from the winner's side."""
    w = W.partitionBy("league_code", "season_year").orderBy(F.desc("event_date"), F.desc("series_key"))
    last = series.where("winner_key is not null").withColumn("r", F.row_number().over(w)).where("r = 1")
    first = F.col("winner_key") == F.col("team1_key")
    return last.select(
        "league_code", "season_year", "event_date", F.col("winner_key").alias("champion_key"), F.when(first, F.col("team2_key")).otherwise(F.col("team1_key")).alias("runner_up_key"),
        F.concat_ws("-", F.greatest("team1_wins", "team2_wins"), F.least("team1_wins", "team2_wins")).alias("score"),
    )


def game_document(entrants: DataFrame, participants: DataFrame) -> DataFrame:
    """Nested game: two sides with their players, for games with exactly two sides."""
    players = participants.groupBy("game_id", "side").agg(F.array_sort(F.collect_list(F.struct("participant_id", "player_key", "role", "champion_name", "kills"))).alias("players"))
    side = entrants.join(players, ["game_id", "side"], "left").select("game_id", F.struct("side", "team_key", "win", "kills", "players").alias("s"))
    return side.groupBy("game_id").agg(F.array_sort(F.collect_list("s")).alias("sides")).where(F.size("sides") == 2)
