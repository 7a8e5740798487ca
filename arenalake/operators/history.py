"""What was known before an event: prior totals, recent form, streaks, head-to-head, ratings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from arenalake.functions.columns import rate
from arenalake.sources.files import materialise, scratch_dir


def before(keys: list[str], time: str = "event_date"):
    """All rows of the keys strictly before the row's day: equal times see nothing of each other."""
    return W.partitionBy(*keys).orderBy(F.datediff(F.col(time), F.lit("1970-01-01").cast("date"))).rangeBetween(W.unboundedPreceding, -1)


#: Objectives of a game beside kills.
MEASURES = ("dragons", "towers", "barons", "inhibitors")


def sides(pairs: DataFrame) -> DataFrame:
    """Team-centric rows: each game once per side, with what it scored and gave up, for the MEASURES that pairs hold."""
    more = [m for m in MEASURES if f"team1_{m}" in pairs.columns]
    shared = ("game_id", "game_number", "league_code", "season_year", "split_name", "patch_version", "event_date", "game_length_seconds")
    def side(a: int, b: int) -> Column:
        return F.struct(F.lit(a).alias("slot"), *[F.col(f"team{a}_{c}").alias(n) for c, n in (("key", "team_key"), ("win", "win"), ("kills", "kills"), ("gold", "gold"))], F.col(f"team{b}_key").alias("opponent_key"), F.col(f"team{b}_kills").alias("kills_against"), *[c for m in more for c in (F.col(f"team{a}_{m}").alias(m), F.col(f"team{b}_{m}").alias(f"{m}_against"))])
    return pairs.select(*shared, F.explode(F.array(side(1, 2), side(2, 1))).alias("s")).select(*shared, "s.*")


def prior_totals(rows: DataFrame, keys: list[str], prefix: str = "prior") -> DataFrame:
    """Games, wins and win rate of the keys before each row, and days since the last one.

    Rows without a result (win null) look back like others and are seen by none.
    """
    w = before(keys)
    games, wins = F.count("win").over(w), F.coalesce(F.sum("win").over(w), F.lit(0))
    last = F.max(F.when(F.col("win").isNotNull(), F.col("event_date"))).over(w)
    out = rows.withColumns({f"{prefix}_games": games, f"{prefix}_wins": wins, f"{prefix}_days_since": F.datediff("event_date", last)})
    return out.withColumn(f"{prefix}_win_rate", rate(F.col(f"{prefix}_wins"), F.col(f"{prefix}_games")))


def recent_and_streak(rows: DataFrame, n: int = 5) -> DataFrame:
    """Win rate of the last n games and the signed streak before each row's day.

    Rows with a result are numbered along a total order; what a row may know is read at the last
    number before its day, so that a game of the same day is never seen, nor one without a result.
    """
    order = ["event_date", "game_number", "game_id"]
    along = W.partitionBy("team_key").orderBy(*order)
    running = along.rowsBetween(W.unboundedPreceding, 0)
    state = rows.where("win is not null").withColumns({"idx": F.row_number().over(along), "cum": F.sum("win").over(running), "turn": F.coalesce((F.lag("win").over(along) != F.col("win")).cast("int"), F.lit(0))})
    state = state.withColumn("island", F.sum("turn").over(running))
    run = F.row_number().over(W.partitionBy("team_key", "island").orderBy(*order))
    state = state.withColumn("run", F.when(F.col("win") == 1, run).otherwise(-run))
    known = rows.withColumn("n_prior", F.count("win").over(before(["team_key"])))
    at = state.select(F.col("team_key").alias("k"), F.col("idx").alias("i"), F.col("cum").alias("c"), F.col("run").alias("r"))
    now, then = at.alias("now"), at.alias("then")
    joined = known.join(now, (F.col("team_key") == F.col("now.k")) & (F.col("n_prior") == F.col("now.i")), "left").join(then, (F.col("team_key") == F.col("then.k")) & (F.col("n_prior") - n == F.col("then.i")), "left")
    wins = F.coalesce("now.c", F.lit(0)) - F.coalesce("then.c", F.lit(0))
    return joined.select(*rows.columns, "n_prior", rate(wins, F.least("n_prior", F.lit(n))).alias("recent_rate"), F.coalesce("now.r", F.lit(0)).alias("streak"))


def head_to_head(pairs: DataFrame) -> DataFrame:
    """Games and wins of the first side over the same pair before each game; games without a result are not seen."""
    w = before(["team1_key", "team2_key"])
    out = pairs.withColumns({"h2h_games": F.count("team1_win").over(w), "h2h_team1_wins": F.coalesce(F.sum("team1_win").over(w), F.lit(0))})
    return out.withColumn("h2h_team1_rate", rate(F.col("h2h_team1_wins"), F.col("h2h_games")))


def _spanned(rows: DataFrame, measures: list[str], spans: tuple[int, ...], own: bool) -> DataFrame:
    """rows with mean, population variance and number of the last n games of the team before each row (own: up to and with it).

    Whole numbers (int) are added up once along the team's games; a span is the difference of two such sums, which is exact, so that the
    work doesn't grow with the spans. Other measures go through a frame of their own.
    """
    along = W.partitionBy("team_key").orderBy("event_date", "game_number", "game_id")
    whole = [m for m in measures if dict(rows.dtypes)[m] in ("tinyint", "smallint", "int")]
    running, skip = along.rowsBetween(W.unboundedPreceding, 0), 0 if own else 1
    square = lambda m: F.col(m).cast("decimal(10,0)") * F.col(m).cast("decimal(10,0)")
    parts = [x for i, m in enumerate(whole) for x in (F.count(m).over(running).alias(f"n{i}"), F.sum(F.col(m).cast("bigint")).over(running).alias(f"s{i}"), F.sum(square(m)).over(running).alias(f"q{i}"))]
    summed = rows.withColumn("__sums", F.struct(F.row_number().over(running).alias("rows"), *parts))
    at = summed.withColumns({f"__at_{k}": F.lag("__sums", k).over(along) if k else F.col("__sums") for k in {skip, *[n + skip for n in spans]}})
    cols = {}
    for n in spans:
        now, then = F.col(f"__at_{skip}"), F.col(f"__at_{n + skip}")
        since = lambda f, now=now, then=then: F.coalesce(now[f], F.lit(0)) - F.coalesce(then[f], F.lit(0))
        for i, m in enumerate(whole):
            k, total, squares = since(f"n{i}"), since(f"s{i}"), since(f"q{i}").cast("decimal(22,0)")
            apart = k.cast("decimal(9,0)") * squares - total.cast("decimal(15,0)") * total.cast("decimal(15,0)")  # exact
            cols[f"{m}_mean_{n}"] = F.when(k > 0, total / k)
            cols[f"{m}_var_{n}"] = F.when(k > 0, apart.cast("double") / (k * k))
        w = along.rowsBetween(-n + 1 - skip, -skip)
        for m in measures:
            if m not in whole:
                cols |= {f"{m}_mean_{n}": F.avg(m).over(w), f"{m}_var_{n}": F.var_pop(m).over(w)}
        cols[f"games_{n}"] = since("rows").cast("bigint")
    named = [f"{m}_{a}_{n}" for n in spans for m in measures for a in ("mean", "var")] + [f"games_{n}" for n in spans]
    return at.select(*rows.columns, *[cols[c].alias(c) for c in named])


def rolling(rows: DataFrame, measures: list[str], spans: tuple[int, ...] = (5, 10, 30)) -> DataFrame:
    """Mean and population variance over the last n games, by game order (0 without any)."""
    out = _spanned(rows, measures, spans, own=False)
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in out.columns[len(rows.columns) :] if not c.startswith("games_")})


def rolling_ahead(played: DataFrame, coming: DataFrame, measures: list[str], spans: tuple[int, ...] = (5, 10, 30)) -> DataFrame:
    """rolling() for rows without a result: the last n played games before each row's day (0 without any)."""
    along = W.partitionBy("team_key").orderBy("event_date", "game_number", "game_id")
    spanned = _spanned(played, measures, spans, own=True)
    state = spanned.columns[len(played.columns) :]
    after = spanned.withColumn("idx", F.row_number().over(along)).select("team_key", "idx", *state)
    keys = ["team_key", "event_date"]
    both = coming.withColumn("__own", F.lit(True)).unionByName(played.select(*keys).withColumn("__own", F.lit(False)), allowMissingColumns=True)
    at = both.withColumn("idx", F.sum(F.when(F.col("__own"), 0).otherwise(1)).over(before(["team_key"]))).where("__own").drop("__own")
    known = at.join(after, ["team_key", "idx"], "left").drop("idx")
    return known.withColumns({c: F.coalesce(c, F.lit(0)) for c in state})


#: What a trailing mean is taken over: everything, the row's patch, its league.
LEVELS = (("trailing", None), ("patch", "patch_version"), ("league", "league_code"))


def trailing_means(games: DataFrame, values: list[str], size: int = 400, levels=LEVELS, order: tuple[str, ...] = ("event_date", "game_number", "game_id"), asked: str = "true", block: int = 8_000) -> DataFrame:
    """games with <value>_<level>_mean and _count: mean and number of the last `size` values before each row, at each level.

    Rows with a value see those before them in the order; rows without one (matches to come) see
    those of earlier days, add nothing and count nothing, so any number of them looks back on the
    same last values. All values and levels go through one pass of narrow rows: values are numbered
    within a day, days get the count of all earlier days (the only wider window is over one row per
    day), and every value stands in its own bucket of `block` values (`size` at least), the last `size` of a bucket also in the next,
    so that a bucket holds all that its own rows look back on, and a large key is many buckets. Within a
    bucket a mean is a difference of two running sums. The last column of `order` names a row.
    asked: condition over games; only such games come back, though all are looked back on.
    """
    at_, name = [f"__o{i}" for i in range(len(order))], order[-1]
    day, row = at_[0], at_[-1]  # columns of games keep out of the way of the working columns
    key = lambda k: F.struct((F.col(k).cast("string") if k else F.lit(None).cast("string")).alias("k"))  # noqa: E731  a struct is never null, so it can be joined on
    level = F.explode(F.array(*[F.struct(F.lit(i).cast("tinyint").alias("level"), key(k).alias("key")) for i, (_, k) in enumerate(levels)]))
    value = F.array(*[F.struct(F.lit(i).cast("tinyint").alias("name"), F.col(v).cast("double").alias("v")) for i, v in enumerate(values)])
    narrow = games.select(*[F.col(c).alias(o) for c, o in zip(order, at_, strict=True)], F.coalesce(F.expr(asked), F.lit(False)).alias("asked"), level.alias("l"), value.alias("vs"))
    long = narrow.select(*at_, "asked", "l.*", F.explode("vs").alias("x")).select(*at_, "asked", "level", "key", "x.*")
    by = ["level", "key", "name"]
    per_day = long.groupBy(*by, day).agg(F.count("v").alias("n_day"))
    previous = W.partitionBy(*by).orderBy(day).rowsBetween(W.unboundedPreceding, -1)
    offset = per_day.select(*by, day, F.coalesce(F.sum("n_day").over(previous), F.lit(0)).alias("earlier"))
    in_day = F.count("v").over(W.partitionBy(*by, day).orderBy(*at_[1:]).rowsBetween(W.unboundedPreceding, -1))
    at = long.withColumn("in_day", in_day).join(offset, [*by, day])
    valued = at.where("v is not null").select(*by, row, "asked", "v", (F.col("earlier") + F.col("in_day")).alias("seen"))
    block = max(block, size)
    own, late = F.floor(F.col("seen") / block), F.col("seen") % block >= block - size
    halo = valued.withColumn("own", own).withColumn("bucket", F.explode(F.when(late, F.array(F.col("own"), F.col("own") + 1)).otherwise(F.array(F.col("own")))))
    along = W.partitionBy(*by, "bucket").orderBy("seen")
    summed = halo.withColumn("s", F.sum("v").over(along.rowsBetween(W.unboundedPreceding, 0)))
    back = lambda n: F.coalesce(F.lag("s", n).over(along), F.lit(0.0))
    state = summed.withColumns({"before": back(1) - back(size + 1), "after": F.col("s") - back(size)}).where("own = bucket")
    mean = lambda s, n: F.when(n > 0, F.col(s) / n)
    n_before, n_after = F.least("seen", F.lit(size)), F.least(F.col("seen") + 1, F.lit(size))
    known = state.where("asked").select("level", "name", row, mean("before", n_before).alias("m"), n_before.alias("n"))
    last = state.select(*by, (F.col("seen") + 1).alias("earlier"), mean("after", n_after).alias("m"), n_after.alias("n"))
    waiting = at.where("v is null and asked").select(*by, row, "earlier").join(last, [*by, "earlier"], "left").select("level", "name", row, "m", F.coalesce("n", F.lit(0)).alias("n"))
    found = known.unionByName(waiting)
    this = lambda v, n, c: F.max(F.when((F.col("name") == values.index(v)) & (F.col("level") == n), F.col(c)))
    wide = found.groupBy(F.col(row).alias(name)).agg(*[this(v, i, c).alias(f"{v}_{n}_{a}") for v in values for i, (n, _) in enumerate(levels) for a, c in (("mean", "m"), ("count", "n"))])
    return games.where(asked).join(wide, name)


def baselines(games: DataFrame, values: list[str], size: int = 400, enough: int = 50, asked: str = "true") -> DataFrame:
    """trailing_means() and, from them, <value>_baseline and <value>_source: the patch's mean if it has enough games, else the league's, else that of all."""
    out = trailing_means(games, values, size, asked=asked)
    for v in values:
        patch, league = F.col(f"{v}_patch_count") >= enough, F.col(f"{v}_league_count") >= enough
        best = F.when(patch, F.col(f"{v}_patch_mean")).when(league, F.col(f"{v}_league_mean")).otherwise(F.coalesce(f"{v}_trailing_mean", F.lit(0.0)))
        out = out.withColumns({f"{v}_baseline": best, f"{v}_source": F.when(patch, "patch").when(league, "league").otherwise("global")})
    return out


def baseline(games: DataFrame, value: str, size: int = 400, enough: int = 50) -> DataFrame:
    """baselines() of one value, as trailing_mean, trailing_count (patch_, league_ likewise), baseline_mean and baseline_source."""
    out = baselines(games, [value], size, enough)
    named = {f"{value}_{n}_{a}": f"{n}_{a}" for n, _ in LEVELS for a in ("mean", "count")}
    return out.withColumnsRenamed(named | {f"{value}_baseline": "baseline_mean", f"{value}_source": "baseline_source"})


def as_of(state: DataFrame, asks: DataFrame, key: str, order: tuple[str, ...], cols: list[str]) -> DataFrame:
    """asks with `cols` of the last row of state before each ask's day (nulls if there is none): state carried forward.

    State rows are numbered along `order` (its first column is the day); an ask reads the number
    that had been reached before its day. asks keep their columns, and need the key and the day.
    """
    day = order[0]
    at = state.withColumn("__i", F.row_number().over(W.partitionBy(key).orderBy(*order))).select(key, "__i", *cols)
    both = asks.withColumn("__own", F.lit(True)).unionByName(state.select(key, day, F.lit(False).alias("__own")), allowMissingColumns=True)
    known = both.withColumn("__i", F.sum(F.when(F.col("__own"), 0).otherwise(1)).over(before([key], day))).where("__own")
    return known.join(at, [key, "__i"], "left").select(*asks.columns, *cols)


def recency_weighted(rows: DataFrame, keys: list[str], value: str, as_of: str, days: float) -> DataFrame:
    """Mean and variance per key with weight exp(-age / days), of rows before the day as_of."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col("event_date"))
    w, x = F.exp(-age / F.lit(float(days))), F.col(value).cast("double")
    sums = rows.where(age > 0).groupBy(*keys).agg(F.sum(w).alias("sw"), F.sum(w * x).alias("sx"), F.sum(w * x * x).alias("sxx"), F.count("*").alias("games"))
    mean = F.col("sx") / F.col("sw")
    return sums.select(*keys, "games", mean.alias("weighted_mean"), F.greatest(F.col("sxx") / F.col("sw") - mean * mean, F.lit(0.0)).alias("weighted_var"))


START, K = 1500.0, 32.0
#: Games of one pool that a task rates at most; more days than that are several periods.
GAMES_AT_ONCE = 200_000
_RATED = "pool string, game_id string, team1_rating double, team2_rating double, team1_expected double, team_key string, rating double"
_RATINGS = "pool string, team_key string, rating double"
_GAME = ("pool", "game_id", "event_date", "team1_key", "team2_key", "team1_win", "margin")


def rating_games(pairs: DataFrame, pool: str = "league_code") -> DataFrame:
    """The columns of games that ratings read; pool and keys as text, a null pool as a pool of its own. Games without a day go."""
    text = lambda c, n: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n)
    return pairs.where("event_date is not null").select(text(pool, "pool"), F.col("game_id").cast("string").alias("game_id"), "event_date", text("team1_key", "team1_key"), text("team2_key", "team2_key"), F.col("team1_win").cast("double").alias("team1_win"), F.col("margin").cast("double").alias("margin"))


def _fold(pdf: pd.DataFrame) -> pd.DataFrame:
    """Games of a pool and period, and the ratings at its end. All games of one day read the ratings before it, then all move them.

    start1 and start2 are the sides' ratings before the period, null for START.
    """
    rating: dict[str, float] = {}
    out = []
    pdf = pdf.sort_values(["event_date", "game_id"], kind="stable")
    for side in ("1", "2"):
        known = pdf[pdf[f"start{side}"].notna()]
        rating |= dict(zip(known[f"team{side}_key"], known[f"start{side}"], strict=True))
    for _, day in pdf.groupby("event_date", sort=True):
        moves: dict[str, float] = {}
        for g, a, b, won, margin in zip(day["game_id"], day["team1_key"], day["team2_key"], day["team1_win"], day["margin"], strict=True):
            ra, rb = rating.get(a, START), rating.get(b, START)
            expected = 1 / (1 + 10 ** ((rb - ra) / 400))
            out.append((g, ra, rb, expected, None, None))
            if won != won:  # no result yet: it reads the ratings and moves none
                continue
            delta = K * (1 + margin) * (won - expected)
            moves[a] = moves.get(a, 0.0) + delta
            moves[b] = moves.get(b, 0.0) - delta
        for k, m in moves.items():
            rating[k] = rating.get(k, START) + m
    out += [(None, None, None, None, k, r) for k, r in rating.items()]
    frame = pd.DataFrame(out, columns=["game_id", "team1_rating", "team2_rating", "team1_expected", "team_key", "rating"])
    frame.insert(0, "pool", pdf["pool"].iloc[0])
    return frame


def _rated_day(games: DataFrame) -> DataFrame:
    """_fold() of one day by columns and sums, for days with more games of a pool than a task should hold."""
    ra, rb = (F.coalesce(f"start{i}", F.lit(START)) for i in (1, 2))
    at = games.withColumns({"team1_rating": ra, "team2_rating": rb}).withColumn("team1_expected", 1 / (1 + F.pow(F.lit(10.0), (F.col("team2_rating") - F.col("team1_rating")) / 400)))
    delta = F.coalesce(K * (1 + F.col("margin")) * (F.col("team1_win") - F.col("team1_expected")), F.lit(0.0))
    side = lambda i, d: F.struct(F.col(f"team{i}_key").alias("team_key"), F.col(f"team{i}_rating").alias("r"), d.alias("d"))
    moved = at.select("pool", F.explode(F.array(side(1, delta), side(2, -delta))).alias("s")).groupBy("pool", "s.team_key").agg((F.max("s.r") + F.sum("s.d")).alias("rating"))
    none = lambda *names: {n: F.lit(None).cast("string" if n.endswith(("id", "key")) else "double") for n in names}
    order = [c.split()[0] for c in _RATED.split(", ")]
    ended = moved.withColumns(none("game_id", "team1_rating", "team2_rating", "team1_expected")).select(*order)
    return at.withColumns(none("team_key", "rating")).select(*order).unionByName(ended)


def rate_period(games: DataFrame, ratings: DataFrame | None, wide: bool = False) -> DataFrame:
    """Games with the ratings before them (game_id set), and the ratings of their teams at the end (team_key set).

    games: rating_games() of a period that follows all that `ratings` (pool, team_key, rating) come from. A
    task holds one pool's games of the period; wide: the period is one day, and no task holds a pool.
    """
    started = games.select(*_GAME)
    for i in (1, 2):
        if ratings is None:
            started = started.withColumn(f"start{i}", F.lit(None).cast("double"))
        else:
            started = started.join(ratings.select("pool", F.col("team_key").alias(f"team{i}_key"), F.col("rating").alias(f"start{i}")), ["pool", f"team{i}_key"], "left")
    return _rated_day(started) if wide else started.groupBy("pool").applyInPandas(_fold, _RATED)


def carried(ratings: DataFrame | None, rated: DataFrame) -> DataFrame:
    """Ratings of all teams after a period."""
    new = rated.where("game_id is null").select("pool", "team_key", "rating")
    return new if ratings is None else new.unionByName(ratings.join(new, ["pool", "team_key"], "left_anti"))


def periods(days: list[tuple[object, int]], most: int) -> list[tuple[object, object, bool]]:
    """(first day, last day, wide) of runs of days with `most` games of a pool at most; a fuller day is a wide period."""
    out: list[tuple[object, object, bool]] = []
    held = most + 1
    for day, n in days:
        if n > most:
            out.append((day, day, True))
            held = most + 1
        elif held + n > most:
            out.append((day, day, False))
            held = n
        else:
            out[-1] = (out[-1][0], day, False)
            held += n
    return out


def elo(pairs: DataFrame, pool: str = "league_code", most: int | None = None) -> DataFrame:
    """Ratings before each game: game_id, pool, both ratings, expected share of the first side.

    A game reads the ratings before its day, so days follow each other; what follows in one task is one
    pool's games of a period with `most` of them at most (GAMES_AT_ONCE), whatever the size of the
    pool. Between periods the ratings lie in the shared folder, one row per team. margin (0 to 1)
    enlarges a step. Games without a result read ratings and move none; games without a day go.
    """
    games = materialise(rating_games(pairs, pool), "rating-games")
    per_day = games.groupBy("event_date", "pool").agg(F.count("*").alias("n")).groupBy("event_date").agg(F.max("n").alias("n"))
    spans = periods([(r["event_date"], r["n"]) for r in per_day.orderBy("event_date").collect()], most or GAMES_AT_ONCE)  # one row per day
    cols = ("pool", "game_id", "team1_rating", "team2_rating", "team1_expected")
    if len(spans) <= 1:
        return rate_period(games, None, bool(spans) and spans[0][2]).where("game_id is not null").select(*cols)
    spark, ratings, root = games.sparkSession, None, scratch_dir(games.sparkSession, "rated")
    for i, (first, last, wide) in enumerate(spans):
        rate_period(games.where(F.col("event_date").between(F.lit(first), F.lit(last))), ratings, wide).write.parquet(f"{root}/{i}")
        ratings = materialise(carried(ratings, spark.read.schema(_RATED).parquet(f"{root}/{i}")), "ratings")
    done = spark.read.schema(_RATED).option("recursiveFileLookup", True).parquet(root)
    return done.where("game_id is not null").select(*cols)
