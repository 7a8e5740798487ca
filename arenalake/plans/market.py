"""Queries: market mathematics and ledger. Orders stand in for matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from arenalake.functions import columns as C
from arenalake.functions import market as M
from arenalake.operators import market as L
from arenalake.plans.registry import query
from arenalake.sources.standin import table

_MARKET = """m AS (SELECT o_orderkey AS match_id, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 41 = 0 THEN 1.0 ELSE 1.2 + (o_orderkey * 7 % 29) / 10.0 END::DOUBLE AS team1_odds,
  (1.2 + (o_orderkey * 11 % 29) / 10.0)::DOUBLE AS team2_odds, (0.05 + (o_orderkey * 13 % 91) / 100.0)::DOUBLE AS team1_probability, o_custkey, o_totalprice FROM orders)"""
_SIDES = f"""WITH {_MARKET}, s AS (
  SELECT match_id, 'team1' AS selection, team1_odds AS odds, team2_odds AS other_odds, team1_probability AS probability FROM m
  UNION ALL SELECT match_id, 'team2', team2_odds, team1_odds, 1 - team1_probability FROM m),
e AS (SELECT *, CASE WHEN probability <= 0 THEN 'Infinity'::DOUBLE ELSE 1 / probability END AS fair_odds, CASE WHEN odds > 1 AND other_odds > 1 THEN (1 / odds) / (1 / odds + 1 / other_odds) END AS market_probability,
  CASE WHEN odds > 1 AND other_odds > 1 THEN 1 / odds + 1 / other_odds - 1 END AS overround, CASE WHEN odds > 1 THEN probability * odds - 1 END AS ev, CASE WHEN odds > 1 THEN greatest(0, (probability * odds - 1) / (odds - 1)) END AS kelly FROM s),
v AS (SELECT *, probability - market_probability AS edge FROM e)"""
_R = "floor({0} * 100000 + 0.5) / 100000 AS {0}"
_MEASURES = ("fair_odds", "market_probability", "overround", "ev", "kelly", "edge")


def market(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("match_id"), F.to_date("o_orderdate").alias("day"), F.when(k % 41 == 0, 1.0).otherwise(1.2 + (k * 7 % 29) / 10.0).alias("team1_odds"),
        (1.2 + (k * 11 % 29) / 10.0).alias("team2_odds"), (0.05 + (k * 13 % 91) / 100.0).alias("team1_probability"), "o_custkey", "o_totalprice",
    )


@query(f"{_SIDES} SELECT match_id, selection, odds, {', '.join(map(_R.format, _MEASURES))} FROM v")
def market_sides(spark, sf_dir):
    out = L.evaluate_sides(market(spark, sf_dir))
    return out.select("match_id", "selection", "odds", *[C.rounded(F.col(c), 5).alias(c) for c in _MEASURES])


@query(f"""{_SIDES} SELECT match_id, selection, odds FROM v WHERE edge >= 0.03 AND ev >= 0.02 AND odds <= 5
QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY ev DESC, edge DESC, kelly DESC, probability DESC, selection) = 1""")
def market_recommendations(spark, sf_dir):
    return L.recommend(L.evaluate_sides(market(spark, sf_dir))).select("match_id", "selection", "odds")


@query(f"""{_SIDES} SELECT match_id, selection, odds, edge >= 0.03 AND ev >= 0.02 AS recommended FROM v WHERE ev IS NOT NULL
ORDER BY (edge >= 0.03 AND ev >= 0.02) DESC NULLS LAST, ev DESC NULLS LAST, edge DESC NULLS LAST, match_id, selection LIMIT 50""")
def edge_board(spark, sf_dir):
    flag = (F.col("edge") >= 0.03) & (F.col("ev") >= 0.02)
    out = L.evaluate_sides(market(spark, sf_dir)).where("ev is not null").withColumn("recommended", flag)
    return out.orderBy(F.desc_nulls_last("recommended"), F.desc_nulls_last("ev"), F.desc_nulls_last("edge"), "match_id", "selection").limit(50).select("match_id", "selection", "odds", "recommended")


@query("""WITH p AS (SELECT p_partkey, (p_size + 1) / 3.0 AS mean, (p_size + 1) / 3.0 * (0.8 + p_partkey % 9 / 5.0) AS variance, p_size % 12 + 0.5 AS line FROM part),
k AS (SELECT p.*, k, CASE WHEN variance > mean THEN lgamma(k + mean * mean / (variance - mean)) - lgamma(mean * mean / (variance - mean)) - lgamma(k + 1)
  + mean * mean / (variance - mean) * ln((mean * mean / (variance - mean)) / (mean * mean / (variance - mean) + mean)) + k * ln(mean / (mean * mean / (variance - mean) + mean)) ELSE -mean + k * ln(mean) - lgamma(k + 1) END AS lp FROM p, range(12) r(k) WHERE k <= line)
SELECT p_partkey, floor(least(greatest(1 - sum(exp(lp)), 1e-6), 1 - 1e-6) * 100000 + 0.5) / 100000 AS over_probability FROM k GROUP BY 1""")
def totals_over_probability(spark, sf_dir):
    mean = (F.col("p_size") + 1) / 3.0
    p = M.over_probability(mean, mean * (0.8 + F.col("p_partkey") % 9 / 5.0), F.col("p_size") % 12 + 0.5)
    return table(spark, sf_dir, "part").select("p_partkey", C.rounded(p, 5).alias("over_probability"))


@query("""SELECT p_partkey, floor((p_size * (p_partkey % 30) + 12.5 * 8) / (p_partkey % 30 + 8) * 10000 + 0.5) / 10000 AS shrunk FROM part""")
def shrunk_means(spark, sf_dir):
    value = M.shrink(F.col("p_size"), F.col("p_partkey") % 30, F.lit(12.5))
    return table(spark, sf_dir, "part").select("p_partkey", C.rounded(value, 4).alias("shrunk"))


# Ledger: every third order is a bet; those of old are settled.
_BETS = f"""{_SIDES}, bets AS (SELECT v.match_id AS bet_id, (10 + v.match_id % 7)::DOUBLE AS stake, odds, ev, edge, day, CASE WHEN day < DATE '1999-01-01' THEN 'settled' ELSE 'open' END AS status,
  CASE WHEN day < DATE '1999-01-01' THEN (['win', 'loss', 'push', 'loss', 'void'])[CAST(v.match_id % 5 + 1 AS INT)] END AS outcome FROM v JOIN m ON m.match_id = v.match_id WHERE selection = 'team2' AND v.match_id % 3 = 0),
ledger AS (SELECT *, CASE outcome WHEN 'win' THEN stake * (odds - 1) WHEN 'loss' THEN -stake WHEN 'push' THEN 0 WHEN 'void' THEN 0 END AS profit FROM bets)"""


def bets(spark, sf_dir):
    m = market(spark, sf_dir)
    rows = L.evaluate_sides(m).where("selection = 'team2' and match_id % 3 = 0").join(m.select("match_id", "day"), "match_id")
    old = F.col("day") < F.lit("1999-01-01").cast("date")
    outcome = F.element_at(F.array(*map(F.lit, ("win", "loss", "push", "loss", "void"))), (F.col("match_id") % 5 + 1).cast("int"))
    return rows.select(F.col("match_id").alias("bet_id"), (10.0 + F.col("match_id") % 7).alias("stake"), "odds", "ev", "edge", "day", F.when(old, "settled").otherwise("open").alias("status"), F.when(old, outcome).alias("outcome"))


def ledger(spark, sf_dir):
    profit = F.when(F.col("outcome") == "win", F.col("stake") * (F.col("odds") - 1)).when(F.col("outcome") == "loss", -F.col("stake")).when(F.col("outcome").isNotNull(), 0.0)
    return bets(spark, sf_dir).withColumn("profit", profit)


@query(f"""{_BETS} SELECT count(*) AS bets, count(*) FILTER (status = 'open') AS open_bets, count(*) FILTER (status = 'settled') AS settled_bets, coalesce(sum(stake) FILTER (status = 'settled'), 0) AS staked,
floor(sum(profit) FILTER (status = 'settled') * 100 + 0.5) / 100 AS profit, floor(sum(profit) FILTER (status = 'settled') * 100 / sum(stake) FILTER (status = 'settled') * 100 + 0.5) / 100 AS roi_pct,
floor(count(*) FILTER (outcome = 'win') * 100.0 / count(*) FILTER (outcome IN ('win', 'loss')) * 100 + 0.5) / 100 AS hit_rate_pct, floor(avg(edge) * 100000 + 0.5) / 100000 AS mean_edge,
floor(sum(ev * stake) FILTER (status = 'open') * 100 + 0.5) / 100 AS open_ev FROM ledger""")
def ledger_summary(spark, sf_dir):
    s = L.ledger_summary(ledger(spark, sf_dir))
    return s.select("bets", "open_bets", "settled_bets", "staked", *[C.rounded(F.col(c), 2).alias(c) for c in ("profit", "roi_pct", "hit_rate_pct")], C.rounded(F.col("mean_edge"), 5).alias("mean_edge"), C.rounded(F.col("open_ev"), 2).alias("open_ev"))


@query(f"""{_BETS}, st AS (SELECT bet_id, CASE bet_id % 4 WHEN 0 THEN 'win' WHEN 1 THEN 'loss' WHEN 2 THEN 'push' ELSE 'void' END AS outcome FROM bets WHERE bet_id % 2 = 0)
SELECT b.bet_id, st.outcome, floor(CASE st.outcome WHEN 'win' THEN stake * (odds - 1) WHEN 'loss' THEN -stake ELSE 0 END * 100 + 0.5) / 100 AS profit FROM st JOIN bets b USING (bet_id) WHERE status = 'open'""")
def ledger_settlement(spark, sf_dir):
    b = bets(spark, sf_dir)
    names = F.element_at(F.array(*map(F.lit, ("win", "loss", "push", "void"))), (F.col("bet_id") % 4 + 1).cast("int"))
    good, _ = L.settle(b.drop("outcome"), b.where("bet_id % 2 = 0").select("bet_id", names.alias("outcome")))
    return good.select("bet_id", "outcome", C.rounded(F.col("profit"), 2).alias("profit"))


@query(f"""{_BETS}, st AS (SELECT bet_id, status, CASE WHEN bet_id % 2 = 0 THEN ' opened ' END AS a, CASE bet_id % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE 'closed' END AS b FROM bets)
SELECT bet_id, CASE WHEN a IS NULL THEN CASE WHEN trim(b) <> '' THEN b ELSE '' END ELSE 'opened' || CASE WHEN trim(b) <> '' THEN ' | closed' ELSE '' END END AS notes FROM st WHERE status = 'open'""")
def ledger_settlement_notes(spark, sf_dir):
    k = F.col("bet_id")
    b = bets(spark, sf_dir).drop("outcome").withColumn("notes", F.when(k % 2 == 0, " opened "))
    said = F.when(k % 5 == 0, None).when(k % 5 == 1, " ").otherwise("closed")
    return L.settle(b, b.select("bet_id", F.lit("win").alias("outcome"), said.alias("settlement_notes")))[0].select("bet_id", "notes")


@query(f"""{_BETS}, st AS (SELECT bet_id + CASE WHEN bet_id % 5 = 0 THEN 1 ELSE 0 END AS bet_id, CASE WHEN bet_id % 7 = 0 THEN 'maybe' ELSE 'win' END AS outcome FROM bets)
SELECT st.bet_id, st.outcome, CASE WHEN b.status IS NULL THEN 'unknown bet' WHEN b.status <> 'open' THEN 'already settled' ELSE 'unknown outcome' END AS reason FROM st LEFT JOIN bets b USING (bet_id) WHERE b.status IS NULL OR b.status <> 'open' OR st.outcome = 'maybe'""")
def ledger_rejects(spark, sf_dir):
    b = bets(spark, sf_dir)
    k = F.col("bet_id")
    st = b.select((k + F.when(k % 5 == 0, 1).otherwise(0)).alias("bet_id"), F.when(k % 7 == 0, "maybe").otherwise("win").alias("outcome"))
    return L.settle(b.drop("outcome"), st)[1]


@query(f"""{_BETS} SELECT bet_id, seq, status FROM (SELECT bet_id, bet_id % 3 + k AS seq, CASE WHEN k = bet_id % 4 THEN 'settled' ELSE 'open' END AS status FROM bets, range(4) r(k) WHERE k <= bet_id % 4)
QUALIFY row_number() OVER (PARTITION BY bet_id ORDER BY seq DESC) = 1""")
def ledger_current_state(spark, sf_dir):
    b = bets(spark, sf_dir).select("bet_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bet_id") % 4)).alias("k"))
    events = b.select("bet_id", (F.col("bet_id") % 3 + F.col("k")).alias("seq"), F.when(F.col("k") == F.col("bet_id") % 4, "settled").otherwise("open").alias("status"))
    return L.current_state(events)


_PROPOSALS = "SELECT bet_id, CASE WHEN bet_id % 2 = 0 THEN ' BOOK ' ELSE 'book' END AS bookmaker, bet_id % 500 AS grp, round(odds, 4) AS odds, stake, status FROM bets"


@query(f"""{_BETS}, p AS ({_PROPOSALS}), o AS (SELECT DISTINCT lower(trim(bookmaker)) b, grp, odds FROM p WHERE status = 'open' AND bet_id % 2 = 0),
f AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(bookmaker)), grp, odds ORDER BY bet_id) AS r FROM p WHERE bet_id % 2 = 1)
SELECT bet_id, stake, 'open' AS status FROM f WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM o WHERE o.b = lower(trim(f.bookmaker)) AND o.grp = f.grp AND o.odds = f.odds)""")
def ledger_append(spark, sf_dir):
    k = F.col("bet_id")
    rows = bets(spark, sf_dir).withColumns({
        "bookmaker": F.when(k % 2 == 0, " BOOK ").otherwise("book"), "match_time": (k % 500).cast("string"), "team1_name": F.lit("a"), "team2_name": F.lit("b"),
        "selection": F.lit("team2"), "league_code": F.lit("x"), "model_name": F.lit("m"),
    })
    return L.append_bets(rows.where("bet_id % 2 = 0"), rows.where("bet_id % 2 = 1")).select("bet_id", "stake", "status")
