"""Schedule feeds: wiki rows and official events to recent and upcoming matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arenalake.functions.columns import blank_to_null, clean_text, first_text, infer_split, is_playoffs, phase_label, to_int, wiki_league

#: Names that stand for a team not known yet.
UNKNOWN_TEAMS = ("", "tbd", "tba", "unknown")

TEAM = "struct<id:string,name:string,code:string,slug:string,outcome:string,result:struct<outcome:string,gameWins:string,wins:string>,record:struct<wins:string>,gameWins:string,score:string>"
#: An official event as the feed nests it.
EVENT = (
    "struct<id:string,type:string,state:string,startTime:timestamp,blockName:string,league:struct<name:string,slug:string>,"
    f"match:struct<id:string,strategy:struct<count:int>,teams:array<{TEAM}>>,games:array<struct<state:string,winnerId:string,patch:string>>>"
)


def unknown_team(name: Column) -> Column:
    return F.lower(clean_text(name)).isin(*UNKNOWN_TEAMS)


def upcoming_wiki(rows: DataFrame, now: str) -> DataFrame:
    """Future matches of a wiki schedule: both teams known, no winner, no score.

    rows: all-text columns MatchId, Team1, Team2, Winner, Team1Score, Team2Score, DateTimeUTC, BestOf,
    OverviewPage, Tab, MatchDay, Patch.
    """
    t = {c: clean_text(F.col(c)) for c in rows.columns}
    at = F.col("DateTimeUTC").try_cast("timestamp")
    open_match = (t["Winner"] == "") & (t["Team1Score"] == "") & (t["Team2Score"] == "")
    league = F.coalesce(first_text(wiki_league(t["OverviewPage"]), wiki_league(F.split(t["MatchId"], "_")[0])), F.lit("Unknown"))
    return rows.where((at >= F.lit(now).cast("timestamp")) & ~unknown_team(F.col("Team1")) & ~unknown_team(F.col("Team2")) & open_match).select(
        t["MatchId"].alias("match_id"), at.alias("match_time"), at.cast("date").alias("match_date"), league.alias("league"),
        F.coalesce(blank_to_null(t["OverviewPage"]), t["MatchId"]).alias("event_name"), phase_label(F.col("Tab"), F.col("MatchDay")).alias("phase_label"),
        t["Team1"].alias("team1"), t["Team2"].alias("team2"), to_int(t["BestOf"]).alias("best_of"), t["Patch"].alias("patch"),
    )


def upcoming_list(matches: DataFrame, league: str | None = None, most: int | None = None) -> DataFrame:
    """Upcoming matches by time, league and teams, optionally of one league and the first ones only."""
    rows = matches if league is None else matches.where(F.lower("league") == league.lower())
    ordered = rows.orderBy("match_time", "league", "team1", "team2", "match_id")
    return ordered if most is None else ordered.limit(most)


def upcoming_by_league(matches: DataFrame) -> DataFrame:
    """Matches to come by league, with the first and last time."""
    return matches.groupBy("league").agg(F.count("*").alias("matches"), F.min("match_time").alias("first_time"), F.max("match_time").alias("last_time"))


def team_name(team: Column) -> Column:
    return F.coalesce(first_text(team["name"], team["code"], team["slug"]), F.lit(""))


def team_wins(team: Column) -> Column:
    """Wins from the first field that has a number."""
    fields = (team["result"]["gameWins"], team["result"]["wins"], team["record"]["wins"], team["gameWins"], team["score"])
    return F.coalesce(*map(to_int, fields))


def series_score(team1: Column, team2: Column, games: Column) -> tuple[Column, Column]:
    """Wins of both: from the teams, else counted over the games' winners; null without either."""
    w1, w2 = team_wins(team1), team_wins(team2)
    told = w1.isNotNull() | w2.isNotNull()
    by_games = lambda team: F.size(F.filter(F.coalesce(games, F.array()), lambda g: (g["winnerId"] == team["id"]) & (team["id"] != "")))
    g1, g2 = by_games(team1), by_games(team2)
    counted = (g1 > 0) | (g2 > 0)
    return tuple(F.when(told, F.coalesce(w, F.lit(0))).when(counted, g) for w, g in ((w1, g1), (w2, g2)))


def series_winner(team1: Column, team2: Column, w1: Column, w2: Column) -> Column:
    """Winner's name by declared outcome, else by wins."""
    won = lambda t: F.lower(F.coalesce(t["result"]["outcome"], t["outcome"], F.lit(""))).isin("win", "won")
    return F.when(won(team1), team_name(team1)).when(won(team2), team_name(team2)).when(w1 > w2, team_name(team1)).when(w2 > w1, team_name(team2))


def normalise_events(events: DataFrame) -> DataFrame:
    """Flat match rows of official events (column e of type EVENT), one per event; see first_by_id for events that pages repeat."""
    teams, games = F.col("e.match.teams"), F.col("e.games")
    a, b = teams[0], teams[1]
    s1, s2 = series_score(a, b, games)
    best = F.coalesce(F.col("e.match.strategy.count"), F.when(F.size(games) > 0, F.size(games)), F.lit(1))
    patch = F.try_element_at(F.filter(F.transform(F.coalesce(games, F.array()), lambda g: F.trim(F.coalesce(g["patch"], F.lit("")))), lambda p: p != ""), F.lit(1))
    text = F.concat_ws(" ", "e.blockName", "e.league.name")
    kept = events.where((F.col("e.type") == "match") & (F.size(teams) == 2))
    flat = kept.select(
        F.coalesce("e.match.id", "e.id").alias("match_id"), F.col("e.startTime").alias("start_time"), F.col("e.state").alias("state"),
        first_text(F.col("e.league.name"), F.col("e.league.slug")).alias("league"), F.col("e.blockName").alias("phase"), best.alias("best_of"),
        team_name(a).alias("team1"), team_name(b).alias("team2"), s1.alias("score1"), s2.alias("score2"), patch.alias("patch"),
        infer_split(text).alias("split_name"), is_playoffs(text).alias("playoffs"), series_winner(a, b, s1, s2).alias("winner"),
    )
    return flat


def first_by_id(events: DataFrame, order: list[str]) -> DataFrame:
    """Events once per id across pages: the first by order."""
    from pyspark.sql import Window as W

    return events.withColumn("r", F.row_number().over(W.partitionBy("event_id").orderBy(*order))).where("r = 1").drop("r")


def recent_and_upcoming(matches: DataFrame, now: str, lookback_days: int) -> tuple[DataFrame, DataFrame]:
    """Completed matches of the last days, and matches to come with known teams."""
    at = F.lit(now).cast("timestamp")
    recent = matches.where((F.col("state") == "completed") & (F.col("start_time") >= at - F.make_dt_interval(days=F.lit(lookback_days))) & (F.col("start_time") <= at))
    coming = matches.where((F.col("state") != "completed") & (F.col("start_time") >= at) & ~unknown_team(F.col("team1")) & ~unknown_team(F.col("team2")))
    return recent, coming


def infer_patch(matches: DataFrame) -> DataFrame:
    """Own patch, else the greatest patch seen, as text."""
    latest = matches.agg(F.max(F.nullif(F.trim("patch"), F.lit(""))).alias("latest_patch"))  # one row
    return matches.join(F.broadcast(latest)).withColumn("patch", F.coalesce(F.nullif(F.trim("patch"), F.lit("")), "latest_patch")).drop("latest_patch")


#: Names whose asset id is not their title-cased compound.
IRREGULAR_ASSETS = {
    "aurelionsol": "AurelionSol", "belveth": "Belveth", "chogath": "Chogath", "drmundo": "DrMundo", "jarvaniv": "JarvanIV", "kaisa": "KaiSa",
    "khazix": "Khazix", "kogmaw": "KogMaw", "ksante": "KSante", "leblanc": "Leblanc", "masteryi": "MasterYi", "missfortune": "MissFortune",
    "monkeyking": "MonkeyKing", "nunu": "Nunu", "nunuwillump": "Nunu", "reksai": "RekSai", "renata": "Renata", "renataglasc": "Renata",
    "tahmkench": "TahmKench", "twistedfate": "TwistedFate", "velkoz": "Velkoz", "wukong": "MonkeyKing", "xinzhao": "XinZhao",
}


def asset_id(name: Column) -> Column:
    """Asset id of a champion name: the irregular table, else its words in title case, joined.

    A word with a capital beyond its first letter stays as it is. Blank names have none.
    """
    norm = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", "")
    table = F.create_map(*[F.lit(x) for kv in IRREGULAR_ASSETS.items() for x in kv])
    word = lambda w: F.when(F.substring(w, 2, 1000).rlike("[A-Z]"), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1000))))
    titled = F.array_join(F.transform(F.regexp_extract_all(name, F.lit("[A-Za-z0-9]+"), F.lit(0)), word), "")
    return F.when(norm != "", F.coalesce(F.try_element_at(table, norm), titled))


def optional_bool(text: Column) -> tuple[Column, Column]:
    """(value, is it unknown text?): the usual words for true and false in any case; blank is null."""
    t = F.lower(F.trim(text.cast("string")))
    value = F.when(t.isin("1", "true", "t", "yes", "y"), True).when(t.isin("0", "false", "f", "no", "n"), False)
    return value, t.isNotNull() & (t != "") & value.isNull()
