"""Report tables, computed for all teams or players at once; a page is a filter on them."""

from __future__ import annotations

from collections import Counter, deque
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from arenalake.functions.columns import kda, ladder, percent

ROLE_ORDER = {"top": 1, "jng": 2, "mid": 3, "bot": 4, "sup": 5}


def role_order(role: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ROLE_ORDER.items() for x in kv]), role), F.lit(9))


def lineups(participants: DataFrame) -> DataFrame:
    """Players of each game and side in the order of roles, unknown roles last, then by participant."""
    listed = F.array_sort(F.collect_list(F.struct(role_order(F.col("role")).alias("o"), "participant_id", "player_key")))
    return participants.groupBy("game_id", "side").agg(F.transform(listed, lambda p: p["player_key"]).alias("lineup"))


def exact_mean(value: Column) -> Column:
    """Mean of values in whole thousandths: such sums are exact, so their order doesn't matter."""
    return F.avg(F.floor(value * 1000 + 0.5)) / 1000


def record(df: DataFrame, keys: list[str], least_games: int = 1) -> DataFrame:
    """Games, wins, losses and win percentage by keys."""
    g = df.groupBy(*keys).agg(F.count("*").alias("games"), F.sum("win").alias("wins"))
    return g.where(F.col("games") >= least_games).withColumns({"losses": F.col("games") - F.col("wins"), "win_pct": percent(F.col("wins"), F.col("games"))})


def career(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Games, wins, sums and the mean of per-game KDA by keys."""
    per_game = kda(F.col("kills"), F.col("deaths"), F.col("assists"))
    return facts.groupBy(*keys).agg(
        F.count("*").alias("games"), F.sum("win").alias("wins"), F.sum("kills").alias("kills"), F.sum("deaths").alias("deaths"),
        exact_mean(per_game).alias("mean_kda"), F.avg("damage").alias("mean_damage"), F.countDistinct("champion_name").alias("champions"),
    )


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First n rows of each key, with their rank. order must be total."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def over_under(entrants: DataFrame, measures: dict[str, float], keys: list[str]) -> DataFrame:
    """Mean of measures and the percentage of rows over a line, by keys."""
    cols = []
    for m, line in measures.items():
        cols += [F.avg(m).alias(f"{m}_mean"), F.avg(F.when(F.col(m).isNotNull(), (F.col(m) > line).cast("int")) * 100.0).alias(f"{m}_over_pct")]
    return entrants.groupBy(*keys).agg(F.count("*").alias("games"), *cols)


def head_to_head_summary(pairs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Games and wins of both sides of each pair, optionally by further keys."""
    return pairs.groupBy("team1_key", "team2_key", *keys).agg(
        F.count("*").alias("games"), F.sum("team1_win").alias("team1_wins"), F.sum("team2_win").alias("team2_wins"),
        F.avg("game_length_seconds").alias("mean_length"), F.max("event_date").alias("last_met"),
    )


def compare_teams(pairs: DataFrame, measures: tuple[str, ...]) -> DataFrame:
    """Two rows for each pair that met: both teams' record and means over their common games. Both sides come from one row of pairs."""
    side = lambda i: F.struct(F.col(f"team{i}_key").alias("team_key"), F.col(f"team{i}_win").alias("win"), *[F.col(f"team{i}_{m}").alias(m) for m in measures])
    rows = pairs.select("team1_key", "team2_key", "game_length_seconds", F.explode(F.array(side(1), side(2))).alias("s")).select("team1_key", "team2_key", "game_length_seconds", "s.*")
    g = rows.groupBy("team1_key", "team2_key", "team_key").agg(F.count("*").alias("games"), F.sum("win").alias("wins"), F.avg("game_length_seconds").alias("mean_length"), *[F.avg(m).alias(f"mean_{m}") for m in measures])
    return g.withColumn("win_pct", percent(F.col("wins"), F.col("games")))


def compare_players(facts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Career rows, side by side, of the wanted players (player_key)."""
    return career(facts.join(wanted.select("player_key").distinct(), "player_key", "left_semi"), ["player_key"])


def participant_head_to_head(facts: DataFrame) -> DataFrame:
    """Participants who met in one game on different sides: games and wins of the first."""
    a = facts.select("game_id", F.col("player_key").alias("p1"), F.col("side").alias("s1"), F.col("win").alias("w1"))
    b = facts.select("game_id", F.col("player_key").alias("p2"), F.col("side").alias("s2"))
    met = a.join(b, "game_id").where((F.col("s1") != F.col("s2")) & (F.col("p1") < F.col("p2")))
    return met.groupBy("p1", "p2").agg(F.count("*").alias("meetings"), F.sum("w1").alias("p1_wins"))


def common_games(entrants: DataFrame, a: str, b: str) -> DataFrame:
    """Games that both teams played: the intersection of two game sets, as a semi join."""
    of = lambda k: entrants.where(F.col("team_key") == k).select("game_id")
    return entrants.join(of(a).intersect(of(b)), "game_id", "left_semi")


def league_trends(pairs: DataFrame, least_games: int = 10) -> DataFrame:
    """Pace of leagues by season, with a tempo label."""
    g = pairs.groupBy("league_code", "season_year").agg(F.count("*").alias("games"), F.avg("game_length_seconds").alias("mean_length"), F.avg(F.col("team1_kills") + F.col("team2_kills")).alias("mean_kills"))
    minutes = F.col("mean_length") / 60
    return g.where(F.col("games") >= least_games).withColumn("tempo", ladder(F.col("mean_kills") / minutes, [(1.6, "frantic"), (1.5, "fast"), (1.4, "steady")], "slow"))


def power_rank(entrants: DataFrame, as_of: str, days: int = 365, n: int = 5) -> DataFrame:
    """Teams by form in the days before as_of: window record, last n games, score, rank, trend label."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col("event_date"))
    rows = entrants.where((age > 0) & (age <= days))
    back = F.row_number().over(W.partitionBy("team_key").orderBy(F.desc("event_date"), F.desc("game_number"), F.desc("game_id")))
    g = rows.withColumn("back", back).groupBy("team_key").agg(
        F.count("*").alias("games"), F.sum("win").alias("wins"), F.count(F.when(F.col("back") <= n, 1)).alias("last_games"),
        F.sum(F.when(F.col("back") <= n, F.col("win"))).alias("last_wins"),
    )
    season, form = F.col("wins") / F.col("games"), F.col("last_wins") / F.col("last_games")
    g = g.withColumn("power", F.floor((season * 70 + form * 30) * 100 + 0.5) / 100).withColumn("trend", F.when(form - season >= 0.15, "rising").when(season - form >= 0.15, "falling").otherwise("steady"))
    # One row per team is left, a dimension-sized table, so the global rank is cheap.
    return g.withColumn("rank", F.row_number().over(W.orderBy(F.desc("power"), F.desc("games"), "team_key")))


def role_percentiles(career_rows: DataFrame, value: str) -> DataFrame:
    """Share of peers of one role at or under a player's value, ties at their average rank."""
    by_value = W.partitionBy("role").orderBy(value)
    share = (F.rank().over(by_value) + (F.count("*").over(W.partitionBy("role", value)) - 1) / 2) / F.count("*").over(W.partitionBy("role"))
    return career_rows.withColumn("percentile", F.floor(share * 1000 + 0.5) / 10)


def recent_against_previous(facts: DataFrame, n: int = 10) -> DataFrame:
    """Mean KDA and wins of each player's last n games against the n before them."""
    back = F.row_number().over(W.partitionBy("player_key").orderBy(F.desc("event_date"), F.desc("game_id"), F.desc("participant_id")))
    score = kda(F.col("kills"), F.col("deaths"), F.col("assists"))
    now, then = F.col("back") <= n, (F.col("back") > n) & (F.col("back") <= 2 * n)
    g = facts.withColumns({"back": back, "score": score}).where(F.col("back") <= 2 * n).groupBy("player_key").agg(
        F.count(F.when(now, 1)).alias("recent_games"), F.count(F.when(then, 1)).alias("previous_games"),
        exact_mean(F.when(now, F.col("score"))).alias("recent_kda"), exact_mean(F.when(then, F.col("score"))).alias("previous_kda"),
    )
    change = F.col("recent_kda") - F.col("previous_kda")
    return g.withColumn("trend", F.when(change >= 1, "improving").when(change <= -1, "declining").when(change.isNull(), "new").otherwise("stable"))


def team_trend(entrants: DataFrame, as_of: str, days: int = 180) -> DataFrame:
    """Record and kills of each team in the last days against the days before them, with a label."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col("event_date"))
    now, then = age.between(1, days), age.between(days + 1, 2 * days)
    g = entrants.where(age.between(1, 2 * days)).groupBy("team_key").agg(
        F.count(F.when(now, 1)).alias("recent_games"), F.count(F.when(then, 1)).alias("previous_games"),
        F.avg(F.when(now, F.col("win"))).alias("recent_rate"), F.avg(F.when(then, F.col("win"))).alias("previous_rate"),
        F.avg(F.when(now, F.col("kills"))).alias("recent_kills"), F.avg(F.when(then, F.col("kills"))).alias("previous_kills"),
    )
    change = F.col("recent_rate") - F.col("previous_rate")
    return g.withColumn("label", F.when(change.isNull(), "insufficient").when(change >= 0.1, "surging").when(change <= -0.1, "sliding").otherwise("level"))


def game_summary(pairs: DataFrame) -> DataFrame:
    """One row per game: winner, differences, objective share, script, decisive edge."""
    won = F.when(F.col("team1_win") == 1, 1).otherwise(-1)
    kills, gold = (F.col("team1_kills") - F.col("team2_kills")) * won, (F.col("team1_gold") - F.col("team2_gold")) * won
    towers = F.col("team1_towers") + F.col("team2_towers")
    winner_towers = F.when(F.col("team1_win") == 1, F.col("team1_towers")).otherwise(F.col("team2_towers"))
    script = F.when((kills >= 20) & (F.col("game_length_seconds") < 1800), "stomp").when(kills >= 10, "controlled").when(kills < 0, "comeback").otherwise("close")
    edge = F.when(F.abs(gold) >= 40000, "economy").when(F.abs(kills) >= 15, "fights").when(F.abs(winner_towers * 2 - towers) >= 6, "objectives").otherwise("balanced")
    return pairs.select(
        "game_id", F.when(F.col("team1_win") == 1, F.col("team1_key")).otherwise(F.col("team2_key")).alias("winner_key"), kills.alias("kill_diff"), gold.alias("gold_diff"),
        percent(winner_towers, towers).alias("tower_share_pct"), script.alias("script"), edge.alias("decisive_edge"),
    )


def lane_matchups(facts: DataFrame) -> DataFrame:
    """Role against role in each game: weighted edge of the blue side, and what drives it most."""
    side = lambda s, p: facts.where(F.col("side") == s).groupBy("game_id", "role").agg(*[F.sum(c).alias(f"{p}_{c}") for c in ("kills", "assists", "damage")])
    both = side("blue", "b").join(side("red", "r"), ["game_id", "role"])
    parts = {"kills": (F.col("b_kills") - F.col("r_kills")) * 0.5, "assists": (F.col("b_assists") - F.col("r_assists")) * 0.25, "damage": (F.col("b_damage") - F.col("r_damage")) / 5000.0}
    edge = sum(parts.values(), F.lit(0.0))
    driver = F.array_max(F.array(*[F.struct(F.abs(v).alias("size"), F.lit(k).alias("name")) for k, v in parts.items()]))["name"]
    return both.select("game_id", "role", edge.alias("edge"), F.when(edge >= 3, "blue").when(edge <= -3, "red").otherwise("even").alias("lane_winner"), driver.alias("top_driver"))


def series_rosters(facts: DataFrame, series_games: DataFrame, size: int = 5) -> DataFrame:
    """Roster of each series and team: the players with most games, ties by key. series_games: series_key, game_id."""
    played = facts.join(series_games, "game_id").where("team_key is not null").groupBy("series_key", "event_date", "team_key", "player_key").agg(F.count("*").alias("n"))
    top = played.withColumn("r", F.row_number().over(W.partitionBy("series_key", "team_key").orderBy(F.desc("n"), "player_key"))).where(F.col("r") <= size)
    return top.groupBy("series_key", "event_date", "team_key").agg(F.array_sort(F.collect_list("player_key")).alias("roster"))


def roster_overlap(rosters: DataFrame, back: int = 3) -> DataFrame:
    """Players shared with the previous roster, and the mean over up to `back` rosters before."""
    w = W.partitionBy("team_key").orderBy("event_date", "series_key")
    shared = [F.size(F.array_intersect("roster", F.lag("roster", i).over(w))) for i in range(1, back + 1)]
    known = [F.when(F.lag("roster", i).over(w).isNotNull(), s) for i, s in enumerate(shared, 1)]
    values = F.array_compact(F.array(*known))
    mean = F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))
    return rosters.withColumns({"overlap_previous": known[0], "overlap_mean": mean})


#: Games of a team that a task of draft pools goes through at once.
POOL_GAMES = 20_000


def _pools(games: int, block: int):
    """Function of one team's block of games, with the games before it that its first ones look back on: the counts before each row."""

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "asks"], ascending=[True, False], kind="stable")  # a game to come before the game of its number
        first = int(pdf["block"].iloc[0]) * block + 1  # of the rows that are this block's own
        held: Counter = Counter()
        last: deque = deque()
        out = []
        for game, at, asks, picks in zip(pdf["game_id"], pdf["at"], pdf["asks"], pdf["picks"], strict=True):
            while last and last[0][0] < at - games:
                for c in last.popleft()[1]:
                    held[c] -= 1
                    if not held[c]:
                        del held[c]
            if at >= first:
                near = Counter(c for n, chosen in islice(reversed(last), 10) if n >= at - 10 for c in chosen)
                total = sum(held.values())
                out.append((game, len(near), len(held), sum(sorted(held.values(), reverse=True)[:5]) / total if total else 0.0))
            if not asks:
                chosen = [] if picks is None else list(picks)
                held.update(chosen)
                last.append((at, chosen))
        made = pd.DataFrame(out, columns=["game_id", "unique_10", "unique_25", "top5_share"])
        made.insert(0, "team_key", pdf["team_key"].iloc[0])
        return made

    return count


def draft_pool(facts: DataFrame, games: int = 25, coming: DataFrame | None = None, block: int = POOL_GAMES) -> DataFrame:
    """Per team and game: different champions in the last 10 and `games` games before it, and the share of the five most played.

    coming: game_id, team_key, event_date of games without picks; they look back on the team's last games
    before their day, and no game looks back on them.

    A team's games are numbered and dealt in blocks of `block` games; the last `games` of a block also go to the
    next one, so a task holds a block, and every pick is sent once or twice.
    """
    own = facts.where("team_key is not null")
    rows = own.groupBy("team_key", "event_date", "game_id").agg(F.collect_list("champion_name").alias("picks")).withColumn("asks", F.lit(False))
    if coming is not None:
        rows = rows.unionByName(coming.select("team_key", "event_date", "game_id", F.lit(None).cast("array<string>").alias("picks"), F.lit(True).alias("asks")))
    # Games to come stand before the games of their day, and read the number that has been reached.
    along = W.partitionBy("team_key").orderBy("event_date", F.desc("asks"), "game_id").rowsBetween(W.unboundedPreceding, 0)
    numbered = rows.withColumn("at", F.count(F.when(~F.col("asks"), 1)).over(along) + F.col("asks").cast("int"))
    home, place = F.floor((F.col("at") - 1) / block), (F.col("at") - 1) % block
    dealt = numbered.withColumn("block", F.explode(F.when(~F.col("asks") & (place >= block - games), F.array(home, home + 1)).otherwise(F.array(home))))
    return dealt.select("team_key", "game_id", "picks", "asks", "at", "block").groupBy("team_key", "block").applyInPandas(_pools(games, block), "team_key string, game_id string, unique_10 int, unique_25 int, top5_share double")
