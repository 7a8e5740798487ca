"""Matching series with outside schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from arenalake.functions.columns import normalise


def with_aliases(names: DataFrame, column: str, aliases: DataFrame, out: str) -> DataFrame:
    """Normalised name, replaced by its canonical form where the alias table (alias, canonical) has it."""
    keyed = names.withColumn("alias", normalise(F.col(column)))
    return keyed.join(F.broadcast(aliases), "alias", "left").withColumn(out, F.coalesce("canonical", "alias")).drop("alias", "canonical")


def _pair(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.withColumns({"lo": F.least(a, b), "hi": F.greatest(a, b)})


def match_official(series: DataFrame, official: DataFrame) -> DataFrame:
    """Official match of a series: same day, league and pair; best-of agrees or is unknown.

    series: series_key, event_date, league_code, name1, name2, best_of. official: match_id and the
    same columns. One match is kept per series, the first by start minute and id.
    """
    o = _pair(official, "name1", "name2").select("match_id", "start_time", F.col("event_date").alias("o_date"), F.col("league_code").alias("o_league"), F.col("lo").alias("o_lo"), F.col("hi").alias("o_hi"), F.col("best_of").alias("o_best"))
    s = _pair(series, "name1", "name2")
    on = (s.event_date == o.o_date) & (s.league_code == o.o_league) & (s.lo == o.o_lo) & (s.hi == o.o_hi) & (s.best_of.isNull() | o.o_best.isNull() | (s.best_of == o.o_best))
    first = F.row_number().over(W.partitionBy("series_key").orderBy(F.asc_nulls_last("start_time"), F.asc_nulls_last("match_id")))
    return s.join(o, on, "left").withColumn("r", first).where("r = 1").select(*series.columns, "match_id")


def match_wiki(series: DataFrame, wiki: DataFrame) -> DataFrame:
    """Wiki match of a series: same pair, a day apart at most, nearest day first, then id; with the number of candidates.

    The band is an equi-join: each series stands on its day and both neighbours.
    """
    s = _pair(series, "name1", "name2").withColumn("day", F.explode(F.array(F.date_sub("event_date", 1), F.col("event_date"), F.date_add("event_date", 1))))
    w = _pair(wiki, "name1", "name2").select("wiki_id", "winner_wins", "loser_wins", F.col("event_date").alias("w_date"), F.col("lo").alias("w_lo"), F.col("hi").alias("w_hi"))
    joined = s.join(w, (s.day == w.w_date) & (s.lo == w.w_lo) & (s.hi == w.w_hi))
    apart = F.abs(F.datediff("w_date", "event_date"))
    all_of = W.partitionBy("series_key")
    ranked = joined.withColumns({"days_apart": apart, "candidates": F.count("*").over(all_of)}).withColumn("r", F.row_number().over(all_of.orderBy("days_apart", "wiki_id")))
    best = ranked.where("r = 1").select("series_key", "wiki_id", "days_apart", "candidates", "winner_wins", "loser_wins")
    return series.join(best, "series_key", "left")


def reconciliation(series: DataFrame, official: DataFrame, wiki: DataFrame) -> DataFrame:
    """Series with both matches, a status, and whether the wiki's score agrees."""
    both = match_wiki(match_official(series, official), wiki)
    agrees = F.when(F.col("wiki_id").isNull(), None).otherwise((F.greatest("wins1", "wins2") == F.col("winner_wins")) & (F.least("wins1", "wins2") == F.col("loser_wins")))
    status = (
        F.when(F.col("match_id").isNotNull() & F.col("wiki_id").isNotNull(), "both").when(F.col("match_id").isNotNull(), "official_only")
        .when(F.col("wiki_id").isNotNull(), "wiki_only").otherwise("unmatched")
    )
    return both.withColumns({"status": status, "score_agrees": agrees, "score_conflict": F.coalesce(~agrees, F.lit(False))})


def source_coverage(reconciled: DataFrame) -> DataFrame:
    """Matched shares by league, and a row ALL."""
    counts = lambda df: df.agg(F.count("*").alias("series"), F.count("match_id").alias("official"), F.count("wiki_id").alias("wiki"), F.count(F.when(F.col("score_conflict"), 1)).alias("conflicts"))
    return counts(reconciled.groupBy("league_code")).unionByName(counts(reconciled.groupBy(F.lit("ALL").alias("league_code"))))


def attach_coverage(series: DataFrame, coverage: DataFrame) -> DataFrame:
    """Is the series' day inside the span that the source covers for its league? coverage: league_code, first_day, last_day."""
    inside = F.col("event_date").between(F.col("first_day"), F.col("last_day"))
    return series.join(F.broadcast(coverage), "league_code", "left").withColumn("covered", F.coalesce(inside, F.lit(False)))


def model_core(reconciled: DataFrame, leagues: list[str]) -> DataFrame:
    """Series fit for training: core league, a winner, a match in some source; with the label."""
    return reconciled.where(F.col("league_code").isin(leagues) & (F.col("wins1") != F.col("wins2")) & (F.col("status") != "unmatched")).withColumn(
        "label_team1_win", (F.col("wins1") > F.col("wins2")).cast("int")
    )


def _held(texts: DataFrame, column: str, wholes: DataFrame, whole: str) -> DataFrame:
    """Pairs of texts and the wholes that they hold: the texts' substrings, of the lengths that wholes have, met by equality."""
    sizes = wholes.agg(F.collect_set(F.length(whole)).alias("sizes"))  # one row: as many numbers as names have lengths
    c = F.col(column)
    cut = F.flatten(F.transform("sizes", lambda n: F.transform(F.when(n <= F.length(c), F.sequence(F.lit(1), F.length(c) - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(c, i, n))))
    return texts.join(F.broadcast(sizes)).select(column, F.explode(F.array_distinct(cut)).alias(whole)).join(wholes, whole)


def resolve_names(queries: DataFrame, known: DataFrame, aliases: DataFrame) -> DataFrame:
    """Free-text names to entities: exact key, alias, then containment either way.

    queries: query_id, name; known: entity_key, name. Containment joins the distinct substrings
    of each name with the whole names of the other side, so it is exact at every length. Status is exact, alias, contains, ambiguous or
    unknown; an ambiguous name has no entity.

    All of it runs over the distinct names, and a name keeps the smallest and the largest entity of a step only (it is
    ambiguous if they differ), so a name that many queries have and that is part of every known one costs one row for each of these.
    """
    q = queries.withColumn("norm", normalise(F.col("name"))).drop("name")
    k = known.select("entity_key", normalise(F.col("name")).alias("k_norm")).groupBy("k_norm").agg(F.min("entity_key").alias("low"), F.max("entity_key").alias("high"))
    names = q.select("norm").distinct()
    told, whole = names.where("norm <> ''"), k.where("k_norm <> ''").select("k_norm")
    exact = names.join(k, names["norm"] == k["k_norm"]).select("norm", F.lit(1).alias("step"), "low", "high")
    alias = names.join(aliases, names["norm"] == aliases["alias"]).join(k, F.col("canonical") == F.col("k_norm")).select("norm", F.lit(2).alias("step"), "low", "high")
    met = _held(told, "norm", whole, "k_norm").unionByName(_held(whole, "k_norm", told, "norm"))
    near = met.join(k, "k_norm").select("norm", F.lit(3).alias("step"), "low", "high")

    def first_step(df: DataFrame, key: str) -> DataFrame:
        steps = df.groupBy(key, "step").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        return steps.groupBy(key).agg(F.min(F.struct("step", "low", "high")).alias("best")).select(key, "best.*")

    found = first_step(exact.unionByName(alias).unionByName(near), "norm")
    best = first_step(q.join(found, "norm"), "query_id")
    name = F.when(F.col("low") < F.col("high"), "ambiguous").when(F.col("step") == 1, "exact").when(F.col("step") == 2, "alias").when(F.col("step") == 3, "contains").otherwise("unknown")
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", F.when(F.col("low") == F.col("high"), F.col("low")).alias("entity_key"), name.alias("status"))
