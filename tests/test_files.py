"""Readers and writers: write, read, compare."""

import gzip
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arenalake.operators import quality as Q
from arenalake.sources import files


def test_box_scores_with_different_headers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "2023.csv").write_text("gameid,side\ng1,blue\ng1,red,extra\n")
    (tmp_path / "b" / "2024.csv").write_text("gameid,side,patch\ng2,blue,14.1\n")
    rows = files.read_box_scores(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).collect()
    assert sorted((r.gameid, r.side, r.patch, r.source_file) for r in rows) == [("g1", "blue", None, "2023.csv"), ("g1", "red", None, "2023.csv"), ("g2", "blue", "14.1", "2024.csv")]


def test_box_scores_of_one_folder_with_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("gameid,side,patch\ng1,blue,14.1\n")
    (tmp_path / "b.csv").write_text("gameid,patch,side\ng2,14.2,red\n")
    (tmp_path / "c.csv").write_text("side,gameid\nblue,g3\n")
    rows = files.read_box_scores(spark, [str(tmp_path)]).collect()
    assert sorted((r.gameid, r.side, r.patch or "") for r in rows) == [("g1", "blue", "14.1"), ("g2", "red", "14.2"), ("g3", "blue", "")]


def test_types_are_inferred_over_all_files(spark, tmp_path):
    (tmp_path / "x1.csv").write_text("id,score,day,name\n1,2,2024-01-01,a\n")
    (tmp_path / "x2.csv").write_text("score,id,day,name\n2.5,3,2024-01-02,7\n")
    (tmp_path / "other.txt").write_text("id\nno\n")
    rows = files.read_typed_csv(spark, str(tmp_path), "x*.csv")
    assert dict(rows.dtypes) == {"id": "bigint", "score": "double", "day": "date", "name": "string", "source_file": "string"} and rows.count() == 2


def test_schedule_payload_shapes(spark, tmp_path):
    (tmp_path / "list.json").write_text(json.dumps([{"MatchId": "a"}, {"MatchId": "b"}]))
    (tmp_path / "rows.json").write_text(json.dumps({"rows": [{"MatchId": "c"}]}))
    row = T.StructType([T.StructField("MatchId", T.StringType())])
    assert sorted(r.MatchId for r in files.read_schedule_payload(spark, str(tmp_path), row).collect()) == ["a", "b", "c"]


def test_partitioned_write_replaces_only_its_partitions(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "year int, league string, v int")
    files.write_partitioned(rows((2023, "x", 1), (2024, "x", 2)), str(tmp_path / "t"), ["year", "league"], ["v"])
    files.write_partitioned(rows((2024, "x", 3)), str(tmp_path / "t"), ["year", "league"], ["v"])
    assert sorted((r.year, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(2023, 1), (2024, 3)]
    assert files.register_views(spark, str(tmp_path), ["t", "absent"]) == ["t"] and spark.table("t").count() == 2


def test_snapshot_pointer_moves_last(spark, tmp_path):
    root = str(tmp_path)
    assert files.write_snapshot({"a": spark.range(3)}, root, "s1")["tables"] == {"a": 3}

    def gate(_):
        raise Q.PublishBlocked("no")

    with pytest.raises(Q.PublishBlocked):
        files.write_snapshot({"a": spark.range(4)}, root, "s2", gate)
    assert files.latest_snapshot(spark, root).endswith("s1")


def test_landing_by_date(spark, tmp_path):
    for day in ("2024-01-31", "2024-02-01"):
        files.land(spark.createDataFrame([(1, "x")], "id int, name string"), str(tmp_path / "l"), "matches", "feed", F.lit(day))
    back = files.read_landing(spark, str(tmp_path / "l"), "struct<id:int,name:string>", "matches", (2024, 2, 1)).collect()
    assert [(r.data.id, r._meta.source, r.day) for r in back] == [(1, "feed", 1)]


def test_live_frames(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"game_id": "g", "frames": [{"ts": "2024-01-01T00:00:00Z", "blue_gold": 5, "red_gold": 3}], "events": []}))
    frames, events = files.read_live_frames(spark, str(tmp_path))
    assert [(r.game_id, r.blue_gold - r.red_gold) for r in frames.collect()] == [("g", 2)] and events.count() == 0


def test_years_to_fetch(spark):
    progress = spark.createDataFrame([(2023, True), (2024, False)], "year int, complete boolean")
    assert [r.year for r in files.pending_years(spark.createDataFrame([(2023,), (2024,), (2025,)], "year int"), progress).orderBy("year").collect()] == [2024, 2025]


def test_report_is_written_and_a_failing_check_leaves_the_pointer(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, None), (None, "d")], "id int, name string")
    checks = {"t": {"no_id": ("error", F.col("id").isNull(), 30.0), "no_name": ("warning", F.col("name").isNull(), 10.0)}}
    made = files.write_snapshot({"t": rows, "u": rows.limit(0)}, root, "s1", checks=checks | {"u": {"any": ("error", F.col("id") > 0, 0)}})
    assert made == {"snapshot_id": "s1", "tables": {"t": 4, "u": 0}, "validation": {"total_checks": 3, "failed_checks": 1, "failed_check_names": ["no_name"]}}
    strict = {"t": {"no_id": ("error", F.col("id").isNull(), 20.0)}}
    with pytest.raises(Q.PublishBlocked, match="no_id"):
        files.write_snapshot({"t": rows}, root, "s2", checks=strict)
    assert files.latest_snapshot(spark, root).endswith("s1")
    told = files.validation_report(spark, f"{root}/snapshots/s2").collect()
    assert [(r.check_name, r.failing, r.total, r.failing_pct, r.passed) for r in told] == [("no_id", 1, 4, 25.0, False)]


def test_a_crash_between_rows_and_record_repeats_the_year_alone(spark, tmp_path, monkeypatch):
    root, asked = str(tmp_path), []

    def fetch(year):
        asked.append(year)
        return spark.range(year - 2020).toDF("id")

    real = files._rename_into

    def broken(s, path, text):
        if path.endswith("2023.json") and asked.count(2023) == 1:
            raise KeyboardInterrupt
        real(s, path, text)

    monkeypatch.setattr(files, "_rename_into", broken)
    with pytest.raises(KeyboardInterrupt):
        files.land_pending(spark, root, [2022, 2023, 2024], fetch)
    rows = lambda: {r.year: r.n for r in files.read_landed_years(spark, root, "id bigint").groupBy("year").agg(F.count("*").alias("n")).collect()}
    assert files.years_landed(spark, root) == [2022] and rows() == {2022: 2}  # rows of 2023 are there, and not seen
    assert files.land_pending(spark, root, [2022, 2023, 2024], fetch) == [2023, 2024]
    assert asked == [2022, 2023, 2023, 2024] and rows() == {2022: 2, 2023: 3, 2024: 4}
    files.land_year(spark.range(9).toDF("id"), root, 2022)
    assert rows()[2022] == 9 and files.land_pending(spark, root, [2022], fetch) == []
    assert files.read_landed_years(spark, str(tmp_path / "none"), "id bigint").count() == 0


def test_serving_table_is_replaced_whole(spark, tmp_path):
    root = str(tmp_path)
    files.publish(spark.range(3).toDF("a"), "served", root)
    old = spark.table("served")
    files.publish(spark.range(5).select(F.col("id").alias("a"), F.lit("x").alias("b")), "served", root)
    assert old.count() == 3 and spark.table("served").count() == 5 and spark.table("served").columns == ["a", "b"]
    with pytest.raises(Exception):
        files.publish(spark.range(2).select(F.raise_error(F.lit("broken")).alias("a")), "served", root)
    assert spark.table("served").count() == 5
    files.publish(spark.range(1).toDF("a"), "served", root)
    assert len(files.expire(spark, "served", root, 1)) >= 2 and spark.table("served").count() == 1
    spark.sql("DROP VIEW served")


def test_wiki_rows_and_rejects(spark, tmp_path):
    good = {"ID": "p1", "Name": " Ann ", "Birthdate": "2000-02-29", "IsRetired": "No", "More": "x"}
    (tmp_path / "1.json").write_text(json.dumps([good, good | {"ID": ""}, good | {"ID": "p2", "Birthdate": "soon"}, good | {"ID": "p3", "Birthdate": "", "IsRetired": "Yes"}], indent=2))
    (tmp_path / "2.json").write_text('[{"ID": "p4", "Na')
    (tmp_path / "3.json").write_text("[]")
    rows, rejects = files.read_wiki(spark, str(tmp_path), "profiles")
    assert sorted((r.player_id, r.full_name, str(r.birthdate), r.retired, r.team_name) for r in rows.collect()) == [("p1", "Ann", "2000-02-29", False, None), ("p3", "Ann", "None", True, None)]
    assert sorted((r.source_file, r.reason) for r in rejects.collect()) == [("1.json", "birthdate is no date"), ("1.json", "player_id is missing"), ("2.json", "not JSON")]


def test_wiki_row_with_several_faults_has_the_first_reason(spark, tmp_path):
    good = {"GameId": "g", "DateTime UTC": "2024-01-01 00:00:00", "Link": "Ann", "Side": "1", "PlayerWin": "Yes", "Kills": "3"}
    bad = [{"Link": "both", "Kills": "n/a", "PlayerWin": "maybe"}, {"Link": "flag", "PlayerWin": "maybe"}, {"Link": "side", "Side": "left", "PlayerWin": "maybe"}, {"Link": "all", "GameId": " ", "Kills": "n/a", "PlayerWin": "maybe"}]
    (tmp_path / "1.json").write_text(json.dumps([good, *[good | b for b in bad]]))
    rows, rejects = files.read_wiki(spark, str(tmp_path), "player_games")
    assert [(r.player_link, r.side, r.win, r.kills) for r in rows.collect()] == [("Ann", 1, True, 3)]
    assert sorted((json.loads(r.record)["Link"], r.reason) for r in rejects.collect()) == [("all", "game_id is missing"), ("both", "kills is no int"), ("flag", "win is no flag"), ("side", "side is no int")]


@pytest.mark.parametrize("name", ["wiki_player_games", "box_score_team_files"])
def test_landed_feeds_are_compressed(spark, tmp_path, monkeypatch, name):
    """the text of a feed takes a fraction of its plain size on disk, and all its rows come back."""
    from arenalake.plans import registry
    from arenalake.sources import files

    monkeypatch.setattr(files, "scratch_dir", lambda spark, folder: str(tmp_path / folder))
    assert registry.queries()[name](spark, "/root/testdata/sf0.001").count() > 1000
    landed = [p for p in tmp_path.rglob("part-*")]
    plain = sum(len(gzip.decompress(p.read_bytes())) for p in landed)
    assert landed and plain > 3 * sum(p.stat().st_size for p in landed)
