"""Market mathematics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fair_odds(p: Column) -> Column:
    """Odds without margin; infinite where the probability is not positive."""
    return F.when(p <= 0, F.lit(float("inf"))).otherwise(1 / p)


def devig(odds: Column, other: Column) -> Column:
    """Implied probability with the two-way margin taken out; null unless both odds exceed 1."""
    return F.when((odds > 1) & (other > 1), (1 / odds) / (1 / odds + 1 / other))


def overround(odds: Column, other: Column) -> Column:
    return F.when((odds > 1) & (other > 1), 1 / odds + 1 / other - 1)


def expected_value(p: Column, odds: Column) -> Column:
    return p * odds - 1


def kelly(p: Column, odds: Column) -> Column:
    """Kelly fraction of the stake, 0 at least; null for odds that can't win."""
    return F.when(odds > 1, F.greatest(F.lit(0.0), (p * odds - 1) / (odds - 1)))


def shrink(value: Column, games: Column, prior: Column, weight: float = 8.0) -> Column:
    """Towards a prior that counts as `weight` games."""
    return (value * games + prior * weight) / (games + weight)


def joined_notes(old: Column, new: Column) -> Column:
    """Notes one after the other; blank ones add nothing, and without any the text is empty."""
    filled = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.concat_ws(" | ", filled(old), filled(new))


#: Lines above this give no probability.
HIGHEST_LINE = 100_000


def over_probability(mean: Column, variance: Column, line: Column) -> Column:
    """Chance that a count exceeds a line: negative binomial if the variance exceeds the mean, else
    Poisson; within 1e-6 of 0 and 1. The distribution function is a recurrence over 0..floor(line),
    in logarithms, so large means don't vanish. Null for lines above HIGHEST_LINE.
    """
    mu = F.greatest(mean, F.lit(1e-9))
    over = variance > mu
    r = mu * mu / F.greatest(variance - mu, F.lit(1e-12))
    q = r / (r + mu)
    first = F.when(over, r * F.log(q)).otherwise(-mu)
    state = lambda p, total: F.struct(p.alias("p"), total.alias("total"), mu.alias("mu"), r.alias("r"), q.alias("q"), over.alias("over"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] + F.when(s["over"], F.log((k - 1 + s["r"]) / k * (1 - s["q"]))).otherwise(F.log(s["mu"] / k))
        return F.struct(p.alias("p"), (s["total"] + F.exp(p)).alias("total"), s["mu"].alias("mu"), s["r"].alias("r"), s["q"].alias("q"), s["over"].alias("over"))

    last = F.floor(F.least(line, F.lit(float(HIGHEST_LINE)))).cast("int")
    steps = F.when(line < 1, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(1), last), lambda k: k.cast("double")))
    below = F.aggregate(steps, state(first, F.exp(first)), step, lambda s: s["total"])
    p = F.least(F.greatest(F.when(line < 0, F.lit(1.0)).otherwise(1 - below), F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.when(line <= HIGHEST_LINE, p)
