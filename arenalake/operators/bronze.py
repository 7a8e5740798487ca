"""Typed rows from string feeds, and schedule normalisers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arenalake.functions.columns import blank_to_null, normalise, parse_result, surrogate_key, to_int


def typed_entrants(bronze: DataFrame) -> DataFrame:
    """Entrant rows (position = team) with types, blanks as null, and keys."""
    n = lambda c, name=None: to_int(F.col(c)).alias(name or c)
    team = blank_to_null(F.col("team_id"))
    return bronze.where("position = 'team'").select(
        "game_id", "side", team.alias("team_id"), "team_name", surrogate_key("team", team, F.col("team_name")).alias("team_key"),
        "league_code", n("year", "season_year"), blank_to_null(F.col("split")).alias("split_name"), F.col("patch").alias("patch_version"),
        F.col("date").try_cast("date").alias("event_date"), n("playoffs"), F.col("game_number").try_cast("bigint").alias("game_number"),
        parse_result(F.col("result")).alias("win"), *[n(c) for c in ("kills", "deaths", "assists", "dragons", "barons", "towers", "inhibitors")],
        n("game_length", "game_length_seconds"), n("gold"),
    )


def typed_participants(bronze: DataFrame) -> DataFrame:
    """Participant rows (any position but team) with types and keys."""
    n = lambda c, name=None: to_int(F.col(c)).alias(name or c)
    player = blank_to_null(F.col("player_id"))
    return bronze.where("position <> 'team'").select(
        "game_id", "side", F.col("position").alias("role"), n("participant_id"), player.alias("player_id"), "player_name",
        surrogate_key("player", player, F.col("player_name")).alias("player_key"), F.col("champion").alias("champion_name"), "league_code",
        n("year", "season_year"), F.col("date").try_cast("date").alias("event_date"), n("kills"), n("deaths"), n("assists"), n("damage"),
    )


# Box scores at the published width. The feed's columns, ours, and how they are read: text (blank is null), raw,
# lower, day, time, result, flag (0 if missing), int, double.
_GAME_COLUMNS = (
    ("gameid", "game_id", "raw"), ("datacompleteness", "data_completeness", "raw"), ("date", "game_datetime", "time"), ("date", "game_date", "day"), ("year", "season_year", "int"), ("split", "split_name", "text"),
    ("playoffs", "playoffs", "flag"), ("league", "league_code", "raw"), ("patch", "patch_version", "text"), ("game", "game_number", "int"),
)
_EVENTS = ("towers", "dragons", "heralds", "barons", "elders", "void_grubs", "atakhans", "inhibitors")
BOX_SCORE_TEAMS = (
    *_GAME_COLUMNS, ("teamid", "source_team_id", "text"), ("teamname", "team_name", "text"), ("side", "side", "lower"), ("result", "win", "result"), ("gamelength", "game_length_seconds", "double"),
    ("teamkills", "team_kills", "int"), ("teamdeaths", "team_deaths", "int"), ("firstPick", "first_pick", "int"), *[(f"pick{i}", f"pick_{i}", "text") for i in range(1, 6)], *[(f"ban{i}", f"ban_{i}", "text") for i in range(1, 6)],
    *[(f"first{x}", f"first_{x}", "int") for x in ("blood", "tower", "dragon", "herald", "baron")], *[(x, x, "int") for x in _EVENTS], *[(f"opp_{x}", f"opp_{x}", "int") for x in _EVENTS], ("source_file", "source_file", "raw"),
)
_AT = tuple((f"{x}at{m}", f"{y}_at_{m}", "double") for m in (10, 15) for x, y in (("gold", "gold"), ("xp", "xp"), ("cs", "cs"), ("golddiff", "gold_diff"), ("xpdiff", "xp_diff"), ("csdiff", "cs_diff"), ("kills", "kills"), ("assists", "assists"), ("deaths", "deaths")))
BOX_SCORE_PLAYERS = (
    *_GAME_COLUMNS, ("playerid", "source_player_id", "text"), ("playername", "player_name", "text"), ("participantid", "participant_id", "int"), ("teamid", "source_team_id", "text"), ("teamname", "team_name", "text"), ("side", "side", "lower"),
    ("position", "role", "lower"), ("champion", "champion_name", "text"), ("result", "win", "result"), ("gamelength", "game_length_seconds", "double"), ("kills", "kills", "int"), ("deaths", "deaths", "int"), ("assists", "assists", "int"),
    *[(x, y, "double") for x, y in (
        ("damagetochampions", "damage_to_champions"), ("dpm", "dpm"), ("damageshare", "damage_share"), ("damagetakenperminute", "damage_taken_per_minute"), ("damagemitigatedperminute", "damage_mitigated_per_minute"), ("damagetotowers", "damage_to_towers"),
        ("totalgold", "total_gold"), ("earnedgold", "earned_gold"), ("earned gpm", "earned_gpm"), ("earnedgoldshare", "earned_gold_share"), ("goldspent", "gold_spent"), ("minionkills", "minion_kills"), ("monsterkills", "monster_kills"), ("total cs", "total_cs"),
        ("cspm", "cs_per_minute"), ("monsterkillsenemyjungle", "enemy_jungle_cs"), ("monsterkillsownjungle", "own_jungle_cs"), ("visionscore", "vision_score"), ("vspm", "vision_score_per_minute"), ("wardsplaced", "wards_placed"),
        ("wardskilled", "wards_killed"), ("controlwardsbought", "control_wards_bought"),
    )], *_AT, *[(f"{x}kills", f"{x}_kills", "int") for x in ("double", "triple", "quadra", "penta")], ("firstbloodkill", "first_blood_kill", "int"), ("firstbloodassist", "first_blood_assist", "int"), ("firstbloodvictim", "first_blood_victim", "int"),
    ("source_file", "source_file", "raw"),
)


def _read_as(x: Column, how: str) -> Column:
    time = lambda c: c.try_cast("timestamp")
    return {
        "raw": lambda: x, "text": lambda: F.nullif(x, F.lit("")), "lower": lambda: F.lower(x), "time": lambda: time(x), "day": lambda: time(x).cast("date"), "result": lambda: parse_result(x),
        "int": lambda: to_int(x), "flag": lambda: F.coalesce(to_int(x), F.lit(0)), "double": lambda: x.try_cast("double"),
    }[how]()


def _box_scores(raw: DataFrame, columns: tuple, kind: str, identifier: str, name: str) -> DataFrame:
    have = set(raw.columns)
    typed = raw.select(*[_read_as(F.col(f"`{feed}`") if feed in have else F.lit(None).cast("string"), how).alias(ours) for feed, ours, how in columns])
    known = F.coalesce(name, F.lit("unknown"))
    return typed.withColumns({f"{kind}_key": surrogate_key(kind, F.col(identifier), known), f"{kind}_name_norm": normalise(known)})


def box_score_teams(raw: DataFrame) -> DataFrame:
    """Team rows of string box scores with all published columns, typed, and keys. Columns that the feed lacks are null."""
    return _box_scores(raw.where("lower(coalesce(position, '')) = 'team'"), BOX_SCORE_TEAMS, "team", "source_team_id", "team_name")


def box_score_players(raw: DataFrame) -> DataFrame:
    """Player rows of string box scores (any position but team) with all published columns, typed, and keys."""
    return _box_scores(raw.where("lower(coalesce(position, '')) <> 'team'"), BOX_SCORE_PLAYERS, "player", "source_player_id", "player_name")


def with_opponent(entrants: DataFrame) -> DataFrame:
    """Left self-join: the other side of the same game."""
    other = entrants.select(F.col("game_id").alias("o_game"), F.col("team_key").alias("opponent_key"), F.col("team_name").alias("opponent_name"), F.col("kills").alias("opponent_kills"), F.col("side").alias("o_side"))
    return entrants.join(other, (F.col("game_id") == F.col("o_game")) & (F.col("side") != F.col("o_side")), "left").drop("o_game", "o_side")


#: Measures that a pair row carries for both sides.
MEASURES = ("win", "kills", "deaths", "dragons", "barons", "towers", "inhibitors", "gold")


def game_pairs(entrants: DataFrame) -> DataFrame:
    """One row per game: the side with the smaller key first. One aggregation, no self-join.

    Games without exactly two sides are left out.
    """
    side = F.struct("team_key", "side", "team_name", *MEASURES)
    grouped = entrants.groupBy(
        "game_id", "league_code", "season_year", "split_name", "patch_version", "event_date", "playoffs", "game_number", "game_length_seconds"
    ).agg(F.min(side).alias("t1"), F.max(side).alias("t2"), F.count("*").alias("n"))
    cols = [F.col(f"t{i}.{c}").alias(f"team{i}_{c.removeprefix('team_')}") for i in (1, 2) for c in ("team_key", "team_name", "side", *MEASURES)]
    return grouped.where("n = 2").drop("n").select(*[c for c in grouped.columns if c not in ("t1", "t2", "n")], *cols)


PAIRS_SQL = """
pairs AS (
  SELECT a.game_id, a.league_code, a.season_year, a.split_name, a.patch_version, a.event_date, a.playoffs, a.game_number, a.game_length_seconds,
    """ + ", ".join(f"{s}.{c} AS team{i}_{c.removeprefix('team_')}" for i, s in ((1, "a"), (2, "b")) for c in ("team_key", "team_name", "side", *MEASURES)) + """
  FROM entrants a JOIN entrants b ON a.game_id = b.game_id AND (a.team_key < b.team_key OR (a.team_key = b.team_key AND a.side < b.side))
)"""
