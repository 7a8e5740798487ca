"""Rules on hand-written rows: expected numbers, nulls, ties, empty inputs."""

import pytest
from pyspark.sql import functions as F

from arenalake.functions import columns as C
from arenalake.functions import market as M
from arenalake.operators import gold as G
from arenalake.operators import history as H
from arenalake.operators import market as L
from arenalake.operators import ml
from arenalake.operators import quality as Q
from arenalake.operators import schedules as X


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_names_and_labels(spark):
    r = one(
        spark, C.normalise(F.lit("Médio-Team 1!")).alias("n"), C.wiki_league(F.lit("2026 First Stand Tournament/Main")).alias("league"),
        C.phase_label(F.lit("Round 1"), F.lit("Round 1"), F.lit(""), F.lit("1")).alias("phase"), C.to_int(F.lit("3.7")).alias("i"), C.to_int(F.lit("x")).alias("bad"),
        C.parse_result(F.lit("Win")).alias("w"), C.infer_split(F.lit("LCK Split 2")).alias("split"), C.score_text(F.lit(1), F.lit(3)).alias("score"),
    )
    assert tuple(r) == ("mdioteam1", "First Stand Tournament", "Round 1 · 1", 4, None, 1, "Split 2", "3-1")


def test_asset_names(spark):
    names = ["Kai'Sa", "LeBlanc", "miss fortune", "K'Sante", "Ahri", "  ", None]
    got = [r.a for r in spark.createDataFrame([(n,) for n in names], "n string").select(X.asset_id(F.col("n")).alias("a")).collect()]
    assert got == ["KaiSa", "Leblanc", "MissFortune", "KSante", "Ahri", None, None]


def test_official_score_and_patch_come_from_games(spark):
    event = {
        "id": "E1", "type": "match", "state": "completed", "blockName": "Playoffs", "league": {"name": "L", "slug": "l"},
        "match": {"id": "M1", "strategy": {"count": 5}, "teams": [{"id": "a", "name": "A"}, {"id": "b", "code": "B"}]},
        "games": [{"winnerId": "a", "patch": ""}, {"winnerId": "b", "patch": "26.05"}, {"winnerId": "a", "patch": "26.06"}, {"winnerId": "a", "patch": ""}],
    }
    row = X.normalise_events(spark.createDataFrame([(event,)], f"e {X.EVENT}")).first()
    assert (row.score1, row.score2, row.patch, row.winner, row.team2, row.playoffs, row.best_of) == (3, 1, "26.05", "A", "B", True, 5)


def daily(spark, days):
    rows = [("L", 2024, d, "a", "b", 1, 1, 0, "Q1", 0, [f"g{d[-2:]}"], 1800.0) for d in days]
    schema = "league_code string, season_year int, event_date string, team1_key string, team2_key string, games long, team1_wins long, team2_wins long, split_name string, playoffs int, game_ids array<string>, mean_length double"
    return spark.createDataFrame(rows, schema).withColumn("event_date", F.to_date("event_date"))


def test_three_day_series(spark):
    days = ["2024-01-01", "2024-01-02", "2024-01-03", "2024-01-09"]
    chained = sorted((r.days, r.games, r.game_ids) for r in G.merge_days(daily(spark, days)).collect())
    assert chained == [(1, 1, ["g09"]), (3, 3, ["g01", "g02", "g03"])]
    pairwise = sorted((r.days, r.game_ids) for r in G.merge_days(daily(spark, days), "pairwise").collect())
    assert pairwise == [(1, ["g09"]), (2, ["g02", "g03"])]


def games(spark, rows):
    return spark.createDataFrame(rows, "game_id string, game_number long, team_key string, event_date string, win int").withColumn("event_date", F.to_date("event_date"))


def test_same_day_games_see_nothing_of_each_other(spark):
    rows = games(spark, [("g1", 1, "a", "2024-01-01", 1), ("g2", 2, "a", "2024-01-02", 1), ("g3", 3, "a", "2024-01-02", 0), ("g4", 4, "a", "2024-01-03", 1)])
    got = {r.game_id: (r.prior_games, r.prior_wins) for r in H.prior_totals(rows, ["team_key"]).collect()}
    assert got == {"g1": (0, 0), "g2": (1, 1), "g3": (1, 1), "g4": (3, 2)}
    streaks = {r.game_id: (r.n_prior, r.streak) for r in H.recent_and_streak(rows).collect()}
    assert streaks == {"g1": (0, 0), "g2": (1, 1), "g3": (1, 1), "g4": (3, -1)}


def test_future_rows_change_no_past_feature(spark):
    base = [(f"g{i}", i, "a", f"2024-01-{1 + i // 2:02d}", i % 2) for i in range(10)]
    before = {r.game_id: r.recent_rate for r in H.recent_and_streak(games(spark, base)).collect()}
    after = {r.game_id: r.recent_rate for r in H.recent_and_streak(games(spark, [*base, ("z", 99, "a", "2024-03-01", 1)])).collect()}
    assert all(after[k] == v for k, v in before.items())


def test_devig_kelly_and_totals(spark):
    r = one(spark, M.devig(F.lit(1.8), F.lit(2.2)).alias("a"), M.devig(F.lit(2.2), F.lit(1.8)).alias("b"), M.kelly(F.lit(0.4), F.lit(2.0)).alias("k"), M.devig(F.lit(1.0), F.lit(2.0)).alias("bad"), M.over_probability(F.lit(1.2), F.lit(1.2), F.lit(1.5)).alias("o"))
    assert r.a + r.b == pytest.approx(1) and r.k == 0 and r.bad is None and r.o == pytest.approx(0.337373, abs=1e-5)


def test_variance_on_a_rounding_tie_is_the_same_in_any_order(spark, monkeypatch):
    from arenalake.plans import features as P

    towers = [0] * 4 + [1] * 4 + [2] * 5 + [3] * 3 + [4] + [5] * 3 + [6] + [7] * 2 + [8] * 2 + [9] * 2 + [10] * 3 + [11] * 2
    for order in (towers, towers[::-1], towers[::2] + towers[1::2]):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(order)], "i int, towers int").coalesce(1)
        e = rows.select(F.lit("L").alias("league_code"), F.lit("t").alias("team_key"), "towers", *[F.lit(None).cast("int").alias(m) for m in ("kills", "dragons", "barons")], F.lit(3).alias("inhibitors"))
        monkeypatch.setattr(P.GP, "entrants", lambda *_, e=e: e)
        got = {r.market: (r["mean"], r.variance) for r in P.totals_quotes(spark, "").collect()}
        # (2 * 13552 / 1024 * 32 + 12.5 * 8) / 40 is 23.675.
        assert got == {"kills": (None, None), "dragons": (None, None), "barons": (None, None), "towers": (9.9, 23.68), "inhibitors": (5.1, 0.3)}


def test_settlement_profit(spark):
    bets = spark.createDataFrame([(1, 10.0, 1.42, "open"), (2, 5.0, 2.0, "settled")], "bet_id int, stake double, odds double, status string")
    good, bad = L.settle(bets, spark.createDataFrame([(1, "win"), (2, "win"), (3, "loss")], "bet_id int, outcome string"))
    assert [(round(r.profit, 2), round(r.roi_pct, 2)) for r in good.collect()] == [(4.20, 42.00)]
    assert sorted((r.bet_id, r.reason) for r in bad.collect()) == [(2, "already settled"), (3, "unknown bet")]


def test_sheet_headers(spark):
    sheet = spark.createDataFrame([("t", "L", "A", "B", 1.5, 2.5, "y", "x"), ("t", "L", "A", "B", 1.5, 2.5, "perhaps", "5")], ["Start Time", "Competition", "Home Team", "Away Team", "Home Odds", "Away  Odds!", " is playoffs", "BO"])
    rows, rejects = L.conform_sheet(sheet)
    got = {k: v for k, v in rows.first().asDict().items() if v is not None}
    assert got == {"match_time": "t", "league": "L", "team1": "A", "team2": "B", "team1_odds": 1.5, "team2_odds": 2.5, "playoffs": True} and set(rows.columns) == set(L.HEADERS)
    assert [(r.best_of, r.reason) for r in rejects.collect()] == [(5.0, "playoffs flag can't be read")] and rows.count() == 1
    with pytest.raises(ValueError, match="team2_odds"):
        L.conform_sheet(sheet.drop("Away  Odds!"))
    with pytest.raises(ValueError, match="league"):
        L.conform_sheet(sheet.drop("Competition"))
    assert L.conform_sheet(sheet.limit(0))[0].count() == 0


def test_eight_signals_with_their_samples(spark):
    from arenalake.operators import ml

    cols = "team1_key string, team2_key string, team1_expected double, diff_recent_rate double, diff_prior_win_rate double, diff_patch_win_rate double, diff_split_win_rate double, h2h_team1_rate double, h2h_games long, diff_roster_shared_mean double, diff_new_players long, " + ", ".join(f"team{i}_{c} long" for i in (1, 2) for c in ("prior_games", "patch_games", "split_games"))
    rows = [("a", "b", 0.7, -0.1, 0.2, 0.5, 0.5, 1.0, 2, 1.5, -3, 6, 1, 4, 6, 2, 0), ("a", "b", None, 0.9, 0.9, 0.9, 0.9, 0.9, 1, None, None, 1, 1, 1, 1, 1, 1)]
    got = ml.explain_matches(spark.createDataFrame(rows, cols), F.lit(0.65), F.lit(7.0)).collect()
    # Scores: rating 2.5, recent 1.0, long-run 2.5, split 6.25, pair 5, continuity 1.5, stability 3; no patch sample.
    assert [(s.title, s.side, s.strength, round(s.size, 6)) for s in got[0].signals] == [("Split fit", "team1", "Strong", 50), ("Head-to-head", "team1", "Strong", 50), ("Roster stability", "team1", "Strong", 3), ("Base rating edge", "team1", "Strong", 20)]
    assert got[0].summary == "a projects as the favorite mainly through split fit, head-to-head." and got[0].confidence_label == "Solid edge" and got[0].agreement_label == "High disagreement"
    assert got[1].signals == [] and got[1].summary == "a projects as the favorite on the current prematch inputs."


def test_folds_are_strictly_ordered(spark):
    rows = spark.range(100).select((F.lit("2024-01-01").cast("date") + (F.col("id") % 17).cast("int")).alias("event_date"))
    spans = sorted((r.segment, r.a, r.b) for r in ml.expanding_folds(rows, 4).groupBy("segment").agg(F.min("event_date").alias("a"), F.max("event_date").alias("b")).collect())
    assert [s[0] for s in spans] == [0, 1, 2, 3, 4] and all(x[2] < y[1] for x, y in zip(spans, spans[1:], strict=False))


def test_publish_gate(spark):
    checks = Q.check_rows(spark.range(10), {"none_odd": ("error", F.col("id") % 2 == 1, 10), "ok": ("error", F.col("id") < 0, 0)})
    with pytest.raises(Q.PublishBlocked, match="none_odd"):
        Q.publish_gate(checks)
    Q.publish_gate(checks.where("passed"))


def test_trailing_window_over_all_rows(spark):
    rows = spark.range(300).select((F.lit("2024-01-01").cast("date") + (F.col("id") / 7).cast("int")).alias("event_date"), F.col("id").alias("n"), (F.col("id") * 37 % 101).alias("v"))
    got = {r.n: r for r in H.trailing_means(rows, ["v"], 40, (("all", None),), ("event_date", "n")).collect()}
    v = [i * 37 % 101 for i in range(300)]
    assert got[0].v_all_mean is None and all(got[i].v_all_mean == pytest.approx(sum(v[max(0, i - 40) : i]) / len(v[max(0, i - 40) : i])) for i in range(1, 300))
    assert all(got[i].v_all_count == min(i, 40) for i in range(300))


def test_a_thousand_games_to_come_have_the_baseline_of_the_first(spark):
    day = lambda n: (F.lit("2024-01-01").cast("date") + n.cast("int"))
    i = F.col("id")
    played = spark.range(100).select(day(i / 3).alias("event_date"), i.alias("game_number"), F.concat(F.lit("G"), i).alias("game_id"), F.lit("P1").alias("patch_version"), F.when(i % 2 == 0, "L").alias("league_code"), F.when(i % 10 != 9, i % 7 + 20).alias("v"), F.lit(3).alias("w"))
    ahead = spark.range(1000).select(day(F.lit(40) + i / 50).alias("event_date"), (i + 1000).alias("game_number"), F.concat(F.lit("F"), i).alias("game_id"), F.when(i % 4 == 0, "P1").otherwise("P2").alias("patch_version"), F.when(i % 3 == 0, "L").when(i % 3 == 1, "M").alias("league_code"))
    got = {r.game_id: r for r in H.baselines(played.unionByName(ahead, allowMissingColumns=True), ["v", "w"], 60, 20).collect()}
    assert len(got) == 1100
    v = [(n % 7 + 20, n % 2 == 0) for n in range(100) if n % 10 != 9]
    every, league, none = [x for x, _ in v][-60:], [x for x, even in v if even][-60:], [x for x, even in v if not even][-60:]
    mean = lambda x: pytest.approx(sum(x) / len(x))
    for n in range(1000):
        r = got[f"F{n}"]
        assert r.v_trailing_mean == mean(every) and r.v_trailing_count == 60 and r.w_trailing_mean == 3
        want = ("patch", every) if n % 4 == 0 else ("league", league) if n % 3 == 0 else ("global", every) if n % 3 == 1 else ("league", none)
        assert (r.v_source, r.v_baseline) == (want[0], mean(want[1]))
    early = {n: [x % 7 + 20 for x in range(n) if x % 10 != 9][-60:] for n in range(1, 100)}
    for n in range(1, 100):  # a played game without a value looks back on earlier days only
        known = early[n] if n % 10 != 9 else [x % 7 + 20 for x in range(n - n % 3) if x % 10 != 9][-60:]
        assert got[f"G{n}"].v_trailing_mean == mean(known)


def test_state_carried_forward_to_games_to_come(spark):
    from arenalake.operators import features as X
    from arenalake.operators import reports as R

    rows = [("a", 1, "s1", "ABCDE"), ("a", 3, "s2", "ABCDF"), ("a", 3, "s3", "ABCGF"), ("a", 6, "s4", "ABXYZ"), ("b", 2, "s5", "KLMNO")]
    rosters = spark.createDataFrame([(t, f"2024-01-0{d}", s, list(r)) for t, d, s, r in rows], "team_key string, event_date string, series_key string, roster array<string>").withColumn("event_date", F.to_date("event_date"))
    coming = spark.createDataFrame([("f1", "a", 4), ("f2", "a", 6), ("f3", "a", 8), ("f4", "b", 2), ("f5", "b", 9), ("f6", "c", 9)], "game_id string, team_key string, d int").select("game_id", "team_key", F.to_date(F.concat(F.lit("2024-01-0"), "d")).alias("event_date"))
    told = spark.createDataFrame([("f3", "a", list("ABCXQ"))], "game_id string, team_key string, roster array<string>")
    got = {r.game_id: ("".join(r.roster or []), r.roster_source, r.overlap_previous, r.overlap_mean) for r in X.rosters_of_coming(rosters, coming, told).collect()}
    # On day 4 and on day 6 itself the last roster is that of s3, which shared 4 with s2 and 3 with s1.
    assert got == {"f1": ("ABCGF", "last", 4, 3.5), "f2": ("ABCGF", "last", 4, 3.5), "f3": ("ABCXQ", "announced", 3, pytest.approx((3 + 3 + 3) / 3)), "f4": ("", None, None, None), "f5": ("KLMNO", "last", None, None), "f6": ("", None, None, None)}
    assert X.rosters_of_coming(rosters, coming.limit(0)).count() == 0
    picks = spark.createDataFrame([(t, f"2024-01-0{d}", s, c) for t, d, s, r in rows for c in r], "team_key string, event_date string, game_id string, champion_name string").withColumn("event_date", F.to_date("event_date"))
    pool = {r.game_id: (r.unique_10, round(r.top5_share, 4)) for r in R.draft_pool(picks, coming=coming).collect()}
    assert pool["f1"] == pool["f2"] == (7, round(13 / 15, 4)) and pool["f3"] == (10, round(15 / 20, 4)) and pool["f4"] == (0, 0) and pool["f5"] == (5, 1) and pool["s4"] == (7, round(13 / 15, 4))
    first = spark.createDataFrame([(s, t, d, i % 2) for i, (t, d, s, _) in enumerate(rows)], "game_id string, team_key string, d int, first_pick int").withColumn("event_date", F.to_date(F.concat(F.lit("2024-01-0"), "d")))
    rate = {r.game_id: r.first_pick_rate_2 for r in X.first_pick_rates(first, coming, (2,)).collect()}
    assert rate == {"s1": 0.5, "s2": 0, "s3": 0, "s4": 0.5, "s5": 0.5, "f1": 0.5, "f2": 0.5, "f3": 0.5, "f4": 0.5, "f5": 0, "f6": 0.5}


def test_short_names_resolve_by_containment(spark):
    from arenalake.operators.reconcile import resolve_names

    known = spark.createDataFrame([(1, "G2 Esports"), (2, "T1"), (3, "T1 Academy"), (4, "X")], "entity_key long, name string")
    asked = spark.createDataFrame([(1, "G2"), (2, "T1 Rookies"), (3, "T1 Academy B"), (4, "Xy"), (5, "")], "query_id long, name string")
    none = spark.createDataFrame([], "alias string, canonical string")
    got = {r.query_id: (r.entity_key, r.status) for r in resolve_names(asked, known, none).collect()}
    assert got == {1: (1, "contains"), 2: (2, "contains"), 3: (None, "ambiguous"), 4: (4, "contains"), 5: (None, "unknown")}


def test_future_games_add_nothing(spark):
    import datetime

    from arenalake.operators import features as X

    cols = "game_id string, game_number long, league_code string, season_year int, split_name string, patch_version string, event_date date, game_length_seconds int, team1_key string, team2_key string, team1_win int, team2_win int, team1_kills int, team2_kills int, team1_gold int, team2_gold int"
    row = lambda i, won: (f"g{i}", i, "L", 2024, None, "14.1", datetime.date(2024, 1, 1 + i), 1800, "a", "b", won, None if won is None else 1 - won, 5, 5, 1, 1)
    got = X.prematch(spark.createDataFrame([row(0, 1), row(1, 1)], cols), spark.createDataFrame([row(i, None) for i in (2, 3, 4)], cols)).orderBy("game_id").collect()
    assert [(r.team1_prior_games, r.team1_prior_win_rate, r.team1_streak, r.h2h_games) for r in got[2:]] == [(2, 1.0, 2, 2)] * 3
    assert [r.team1_prior_days_since for r in got[2:]] == [1, 2, 3] and [r.is_future for r in got] == [False, False, True, True, True]


def test_over_probability_of_high_lines(spark):
    import math

    from arenalake.functions import market as M

    poisson = lambda mu, line: 1 - sum(math.exp(-mu + k * math.log(mu) - math.lgamma(k + 1)) for k in range(int(line) + 1))
    df = spark.createDataFrame([(260.0, 250.5), (900.0, 890.5), (3.0, 2.5), (3.0, -1.0), (3.0, 1e6)], "mu double, line double")
    got = [r.p for r in df.select(M.over_probability(F.col("mu"), F.col("mu") * 0.9, F.col("line")).alias("p")).collect()]
    assert [round(x, 6) for x in got[:3]] == [round(poisson(260, 250.5), 6), round(poisson(900, 890.5), 6), round(poisson(3, 2.5), 6)]
    assert got[3] > 0.99 and got[4] is None


def test_published_split_and_playoff_rules(spark):
    text = {"2026 First Stand Groups Day 2": ("FST", False), "Season Finals": ("Season Finals", True), "LTA Split 2 Quarters": ("Split 2", True), "Regional Gauntlet": ("FST", True), "Fall Week 1": ("FST", False)}
    rows = spark.createDataFrame(list(text), "string").select("value", C.infer_split(F.col("value"), F.lit("FST")).alias("s"), C.is_playoffs(F.col("value")).alias("p")).collect()
    assert {r.value: (r.s, r.p) for r in rows} == text


def test_bet_records_refuse_and_derive(spark):
    rows = [(1, 2.5, 10.0, None, 0.5), (2, 2.5, 10.0, 2.0, None), (3, 1.0, 10.0, None, 0.5), (4, 2.5, 0.0, None, 0.5), (5, 2.5, 10.0, None, None), (6, 2.5, 10.0, 1.0, None), (7, 2.5, 10.0, None, 1.0), (8, None, 10.0, None, 0.5), (9, 2.5, None, None, 0.5)]
    good, bad = L.bet_records(spark.createDataFrame(rows, "bet_id int, odds double, stake double, fair_odds double, model_probability double"))
    got = {r["bet_id"]: r for r in good.collect()}
    assert set(got) == {1, 2}
    for r in got.values():
        assert (r["model_probability"], r["fair_odds"], r["market_implied_probability"], r["edge_probability"], r["ev_per_unit"]) == pytest.approx((0.5, 2.0, 0.4, 0.1, 0.25))
        assert (r["potential_payout"], r["potential_profit"], r["status"]) == (25.0, 15.0, "open")
    assert {r["bet_id"]: r["reason"].split(" must")[0] for r in bad.collect()} == {
        3: "odds", 4: "stake", 5: "no fair odds or model probability", 6: "fair odds", 7: "model probability", 8: "odds", 9: "stake",
    }


def test_scored_sheet_keeps_every_row_and_puts_recommended_first(spark):
    sheet = spark.createDataFrame([(1, 2.0, 2.0), (2, 3.0, 1.5), (3, None, 2.0), (4, 1.0, 2.0), (5, 1.5, 2.0), (6, 1.9, 1.9)], "match_id int, team1_odds double, team2_odds double")
    p = spark.createDataFrame([(1, 0.6), (2, 0.5), (3, 0.5), (4, 0.5), (6, 0.5)], "match_id int, p double")
    got = L.score_both_sides(sheet, p).collect()
    assert [r["match_id"] for r in got[:2]] == [2, 1] and sorted(r["match_id"] for r in got) == [1, 2, 3, 4, 5, 6]
    by = {r["match_id"]: r for r in got}
    assert (by[2]["recommended_selection"], by[2]["recommended_odds"]) == ("team1", 3.0) and by[2]["recommended_ev_pct"] == pytest.approx(50)
    assert {k: by[k]["score_error"] for k in (3, 4, 5)} == {3: "missing odds", 4: "odds must exceed 1", 5: "no prediction"}
    assert by[6]["score_available"] and not by[6]["recommend_bet"] and by[3]["team1_ev_pct"] is None


def test_all_kinds_of_issue(spark):
    teams = spark.createDataFrame([("g1", "a"), ("g1", "a"), ("g2", "a")], "game_id string, team_key string")
    people = spark.createDataFrame([("g1", "playername:unknown")] * 2 + [("g1", f"p{i}") for i in range(8)], "game_id string, player_key string")
    series = spark.createDataFrame([("s1", "team:1", "teamname:x"), ("s2", "team:1", "team:2")], "series_key string, team1_key string, team2_key string")
    known = spark.createDataFrame([("s1", None, None, False, True, True), ("s2", "m", "w", True, True, True), ("s3", None, None, False, False, False)], "series_key string, match_id string, wiki_id string, score_conflict boolean, official_covered boolean, wiki_covered boolean")
    got = sorted((r["issue_type"], r["entity_key"]) for r in Q.quality_issues(teams, people, series, known).collect())
    assert got == [
        ("game_same_team_key_both_sides", "g1"), ("game_same_team_key_both_sides", "g2"), ("game_team_count", "g2"), ("game_unknown_player_collisions", "g1"),
        ("multi_source_score_conflict", "s2"), ("official_series_unmatched", "s1"), ("series_missing_team_id", "s1"), ("wiki_series_unmatched", "s1"),
    ]


def most_rows(df):
    """The largest number of rows that a step of the plan that ran made."""

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            yield from walk(node.executedPlan())
            return
        if kind.endswith("QueryStageExec"):
            yield from walk(node.plan())
            return
        made = node.metrics().get("numOutputRows")
        if made.isDefined():
            yield made.get().value()
        for i in range(node.children().size()):
            yield from walk(node.children().apply(i))

    df.collect()
    return max(walk(df._jdf.queryExecution().executedPlan()))


def test_a_name_that_all_known_ones_hold_is_no_product(spark):
    """many queries of one name that is part of every known name; rows grow with their sum."""
    from arenalake.operators.reconcile import resolve_names

    none = spark.createDataFrame([], "alias string, canonical string")
    asked = spark.range(400).select(F.col("id").alias("query_id"), F.when(F.col("id") == 7, "Supplier 00012").otherwise("The Supplier").alias("name"))
    known = spark.range(400).select(F.col("id").alias("entity_key"), F.format_string("the supplier %05d", "id").alias("name"))
    out = resolve_names(asked, known, none)
    assert most_rows(out) < 20_000
    got = {r.query_id: (r.entity_key, r.status) for r in out.collect()}
    assert len(got) == 400 and got[7] == (12, "contains") and got[8] == (None, "ambiguous")


def test_several_names_of_one_query_and_entities_without_a_key(spark):
    from arenalake.operators.reconcile import resolve_names

    none = spark.createDataFrame([], "alias string, canonical string")
    asked = spark.createDataFrame([(1, "ab"), (1, "cd"), (2, "ab"), (3, None)], "query_id int, name string")
    known = spark.createDataFrame([(10, "ab"), (11, "cd"), (None, "zz")], "entity_key int, name string")
    got = sorted((r.query_id, r.entity_key, r.status) for r in resolve_names(asked, known, none).distinct().collect() if r.query_id != 1)
    assert got == [(2, 10, "exact"), (3, None, "unknown")]
    assert {(r.entity_key, r.status) for r in resolve_names(asked, known, none).where("query_id = 1").collect()} == {(None, "ambiguous")}


def test_draft_pools_across_blocks_send_a_pick_twice_at_most(spark):
    """F8: the last 25 games by brute force over small blocks, games to come too; no pick goes to each game that looks back on it."""
    from arenalake.operators import reports as R

    played = [(f"t{t}", 1 + i // 3, f"g{t}{i:03d}", [f"c{(i * 7 + j * j + t) % 13}" for j in range(5)]) for t in (1, 2) for i in range(150)]
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("d"))
    picks = spark.createDataFrame([(t, d, g, c) for t, d, g, chosen in played for c in chosen], "team_key string, d int, game_id string, champion_name string").withColumn("event_date", day)
    coming = spark.createDataFrame([("t1", 11, "f1"), ("t1", 90, "f2"), ("t3", 5, "f3")], "team_key string, d int, game_id string").withColumn("event_date", day)
    want = {}
    for team, d, game, asks in [(t, d, g, False) for t, d, g, _ in played] + [("t1", 11, "f1", True), ("t1", 90, "f2", True), ("t3", 5, "f3", True)]:
        before = [c for t, n, g, c in played if t == team and (n < d if asks else (n, g) < (d, game))]
        last = [c for chosen in before[-25:] for c in chosen]
        most = sorted((last.count(c) for c in set(last)), reverse=True)[:5]
        want[game] = (len({c for chosen in before[-10:] for c in chosen}), len(set(last)), round(sum(most) / len(last), 9) if last else 0.0)
    out = R.draft_pool(picks, coming=coming, block=40)
    assert {r.game_id: (r.unique_10, r.unique_25, round(r.top5_share, 9)) for r in out.collect()} == want
    assert most_rows(R.draft_pool(picks, coming=coming)) <= 2 * len(played) * 5


def test_trailing_means_of_asked_games_over_small_blocks(spark):
    """blocks of any size give the same means, and only what is asked for comes back."""
    from arenalake.operators import history as H

    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") / 3).cast("int"))
    games = spark.range(200).select(
        F.format_string("g%03d", "id").alias("game_id"), F.col("id").alias("game_number"), day.alias("event_date"), F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("league_code"), F.lit("1").alias("patch_version"),
        F.when((F.col("id") % 5 != 0) & (F.col("id") < 180), F.col("id") * 7 % 31).alias("v"), (F.col("id") >= 170).alias("ahead"),
    )
    rows = games.orderBy("game_id").collect()
    for block in (7, 50, 8000):
        got = {r.game_id: r for r in H.trailing_means(games, ["v"], 7, asked="ahead", block=block).collect()}
        assert sorted(got) == [r.game_id for r in rows if r.ahead]
        for r in rows[170:]:
            for name, same in (("trailing", lambda x: True), ("league", lambda x, r=r: x.league_code == r.league_code)):
                before = [x.v for x in rows if x.v is not None and same(x) and ((x.game_number < r.game_number) if r.v is not None else x.event_date < r.event_date)][-7:]
                assert got[r.game_id][f"v_{name}_count"] == len(before) and abs(got[r.game_id][f"v_{name}_mean"] - sum(before) / len(before)) < 1e-9


def test_rolling_spans_by_brute_force(spark):
    """whole numbers by running sums, exact for large values too; others by frames; rows ahead see the same."""
    from arenalake.operators import history as H

    i = F.col("id")
    rows = spark.range(60).select(
        F.format_string("g%03d", "id").alias("game_id"), i.alias("game_number"), F.date_add(F.lit("2024-01-01").cast("date"), i.cast("int")).alias("event_date"), F.when(i % 3 == 0, "a").otherwise("b").alias("team_key"),
        F.when(i % 7 != 0, 2_000_000_000 + i * 13 % 5).cast("int").alias("m"), (i * 5 % 11 / 4.0).alias("x"),
    )
    all_rows = rows.orderBy("game_number").collect()

    def spans(before, n):
        out = [len(before[-n:])]
        for c in ("m", "x"):
            v = [r[c] for r in before[-n:] if r[c] is not None]
            mean = sum(v) / len(v) if v else 0.0
            out += [mean, sum((k - mean) ** 2 for k in v) / len(v) if v else 0.0]
        return out

    for r in H.rolling(rows, ["m", "x"], (3, 8)).collect():
        before = [o for o in all_rows if o.team_key == r.team_key and o.game_number < r.game_number]
        for n in (3, 8):
            want = spans(before, n)
            got = [r[f"games_{n}"], r[f"m_mean_{n}"], r[f"m_var_{n}"], r[f"x_mean_{n}"], r[f"x_var_{n}"]]
            assert got[0] == want[0] and abs(got[1] - want[1]) < 1e-6 and abs(got[3] - want[3]) < 1e-9 and abs(got[4] - want[4]) < 1e-9
            assert abs(got[2] - want[2]) < 1e-6
    ahead = spark.createDataFrame([("f", "a", 30), ("h", "c", 30)], "game_id string, team_key string, d int").select("game_id", "team_key", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")).alias("event_date"))
    got = {r.game_id: r for r in H.rolling_ahead(rows, ahead, ["m"], (8,)).collect()}
    assert got["f"].games_8 == 8 and abs(got["f"].m_mean_8 - spans([o for o in all_rows if o.team_key == "a" and o.game_number < 30], 8)[1]) < 1e-6 and got["h"].games_8 == 0


def test_totals_rows_hold_what_the_models_use(spark):
    """variances and single sides are not made for models that don't look at them."""
    from arenalake.plans import scoring

    rows = scoring.totals_rows(spark, "/root/testdata/sf0.001")
    assert not [c for c in rows.columns if "_var_" in c or c.startswith("team")] and len(scoring.totals_numeric(rows, "kills")) == 67
