"""Column expressions for keys, names, results, series and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(name: Column) -> Column:
    """Lower case, only a-z and 0-9."""
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def clean_text(text: Column) -> Column:
    """Trimmed; the text 'nan' counts as blank, and null as blank."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.lower(t) == "nan", "").otherwise(t)


def to_int(text: Column) -> Column:
    """Integer from text such as '4', '4.0' or '3.7' (rounded), else null."""
    return F.round(blank_to_null(text).try_cast("double")).try_cast("int")


def parse_result(text: Column) -> Column:
    """1 or 0 from a number or from the words win and loss, else null."""
    word = F.lower(F.trim(text))
    return F.when(word == "win", 1).when(word == "loss", 0).otherwise(to_int(text))


def surrogate_key(prefix: str, identifier: Column, name: Column) -> Column:
    """prefix:<id>, or prefixname:<normalised name> without an id."""
    return F.when(identifier.isNotNull(), F.concat(F.lit(f"{prefix}:"), identifier)).otherwise(F.concat(F.lit(f"{prefix}name:"), normalise(name)))


def event_time(start: Column, day: Column) -> Column:
    return F.coalesce(start, day.cast("timestamp"))


def kda(kills: Column, deaths: Column, assists: Column) -> Column:
    """(kills + assists) per death; without deaths their sum."""
    total = (kills + assists).cast("double")
    return F.when(F.coalesce(deaths, F.lit(0)) == 0, total).otherwise(total / deaths)


def series_format(games: Column) -> Column:
    return F.when(games == 1, "Bo1").when(games.between(2, 3), "Bo3").when(games.between(4, 5), "Bo5").otherwise("Unknown")


def score_text(a: Column, b: Column) -> Column:
    return F.concat_ws("-", F.greatest(a, b).cast("string"), F.least(a, b).cast("string"))


def winner(a_wins: Column, b_wins: Column, a: Column, b: Column, draw: str | None = None) -> Column:
    return F.when(a_wins > b_wins, a).when(b_wins > a_wins, b).otherwise(F.lit(draw))


def rate(part: Column, whole: Column, neutral: float = 0.5) -> Column:
    """part / whole, or a neutral value where there is nothing to divide by."""
    return F.when(F.coalesce(whole, F.lit(0)) == 0, F.lit(neutral)).otherwise(part / whole)


def whole_variance(value: Column) -> Column:
    """Aggregate: population variance of integers, from their exact count, sum and sum of squares, so that the order
    in which rows meet can't move its last digits; null without values."""
    x = value.cast("bigint")
    exact = lambda c: c.cast("decimal(19,0)")
    n, total, squares = exact(F.count(x)), exact(F.sum(x)), F.sum(exact(x * x))
    return (n * squares - total * total).cast("double") / F.nullif(n * n, F.lit(0)).cast("double")


def percent(part: Column, whole: Column) -> Column:
    """Percent to one decimal, half up on the scaled value; 0 without rows."""
    return F.when(F.coalesce(whole, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.floor(part * 1000 / whole + 0.5) / 10)


def rounded(value: Column, digits: int) -> Column:
    """Half-up rounding by scaling, the same in every engine."""
    k = 10**digits
    return F.floor(value * k + 0.5) / k


def ladder(value: Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """The label of the first threshold that value reaches; thresholds descend."""
    (first, label), *rest = steps
    out = F.when(value >= first, label)
    for least, name in rest:
        out = out.when(value >= least, name)
    return out.otherwise(otherwise)


def ordinal(n: Column) -> Column:
    suffix = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), suffix)


def signed(value: Column, digits: int = 1) -> Column:
    """Rounded text with a sign, such as +1.5."""
    v = rounded(value, digits)
    return F.concat(F.when(v < 0, "-").otherwise("+"), F.abs(v).cast(f"decimal(18,{digits})").cast("string"))


def matches_all(criteria: dict[str, object]) -> Column:
    """Conjunction of equalities from values, never from text: lists are alternatives, and the
    split 'N/A' stands for null or blank. A None value sets no condition."""
    conditions = [F.lit(True)]
    for name, value in criteria.items():
        c = F.col(name)
        if value is None:
            continue
        if name == "split_name" and value == "N/A":
            conditions.append(c.isNull() | (F.trim(c) == ""))
        elif isinstance(value, (list, tuple, set)):
            conditions.append(c.isin(list(value)))
        else:
            conditions.append(c == value)
    return reduce(lambda a, b: a & b, conditions)


def first_text(*candidates: Column) -> Column:
    """First candidate that isn't blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in candidates])


def infer_split(text: Column, league_code: Column | None = None) -> Column:
    """Split from free text: a season word, 'split N', the season finals; else the league's code if given."""
    t = F.lower(F.coalesce(text, F.lit("")))
    number = F.regexp_extract(t, r"split\s+([0-9])", 1)
    out = F.when(t.contains("winter"), "Winter").when(t.contains("spring"), "Spring").when(t.contains("summer"), "Summer")
    out = out.when(number != "", F.concat(F.lit("Split "), number)).when(t.contains("season finals"), "Season Finals")
    return out if league_code is None else out.otherwise(league_code)


def is_playoffs(text: Column) -> Column:
    # Fixed words of late rounds.
    return F.lower(F.coalesce(text, F.lit(""))).rlike("bracket|elimination|final|gauntlet|knockout|playoff|quarter|semi")


def wiki_league(page: Column) -> Column:
    """The part before '/', without a leading year."""
    return F.trim(F.regexp_replace(F.split(F.coalesce(page, F.lit("")), "/")[0], r"^\d{4}\s+", ""))


def phase_label(*parts: Column) -> Column:
    """Distinct parts that aren't blank, joined by a middle dot."""
    return F.array_join(F.array_distinct(F.filter(F.array(*[F.trim(F.coalesce(p, F.lit(""))) for p in parts]), lambda x: x != "")), " · ")
