"""Readers and writers of feeds, tables, snapshots and landing zones."""

from __future__ import annotations

import json
import math
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arenalake.operators.quality import PublishBlocked

_own_dir: dict[str, str] = {}


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which executors share; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_dir:
            _own_dir[app] = tempfile.mkdtemp(prefix="arenalake-")
        root = _own_dir[app]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it back with the same schema."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of schema in order: missing ones null, others cast; bad values become null."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def read_box_scores(spark: SparkSession, paths: list[str], pattern: str = "*.csv") -> DataFrame:
    """CSV files whose headers differ: every column a string, union by name, bad lines tolerated, with the file's name.

    Headers are read file by file (one line each), within one folder too, and files of one header are
    read together, so a column never takes the place of another. Files without a line give no rows.
    """
    by_header: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        for file in spark.read.option("pathGlobFilter", pattern).text(path).inputFiles():
            by_header.setdefault(tuple(spark.read.option("header", True).csv(file).columns), []).append(file)
    by_header.pop((), None)
    if not by_header:
        return spark.createDataFrame([], "source_file string")
    parts = []
    for header, files in by_header.items():
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
        rows = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(files)
        parts.append(rows.withColumn("source_file", F.element_at(F.split("_metadata.file_path", "/"), -1)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_typed_csv(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """CSV files of a name pattern with inferred types, united by name, with the file's name.

    Types are inferred over all rows of the files that share a header; where two headers disagree on
    a column's type, it is a string.
    """
    rows = read_box_scores(spark, [path], pattern)
    typed = {}
    for c in (c for c in rows.columns if c != "source_file"):
        x = F.nullif(F.trim(f"`{c}`"), F.lit(""))
        known = F.count(x)
        typed[c] = [known.alias(f"{c}|n"), F.count(x.try_cast("bigint")).alias(f"{c}|bigint"), F.count(x.try_cast("double")).alias(f"{c}|double"), F.count(x.try_cast("date")).alias(f"{c}|date")]
    if not typed:
        return rows
    seen = rows.agg(*[a for parts in typed.values() for a in parts]).first()
    kind = {c: next((t for t in ("bigint", "double", "date") if seen[f"{c}|n"] and seen[f"{c}|{t}"] == seen[f"{c}|n"]), "string") for c in typed}
    return rows.select(*[F.nullif(F.trim(f"`{c}`"), F.lit("")).try_cast(t).alias(c) if t != "string" else F.col(f"`{c}`") for c, t in kind.items()], "source_file")


def read_nested_json(spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool = False) -> DataFrame:
    """Nested JSON documents under path, at any depth, by an explicit schema."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("multiLine", multi_line).json(path)


def read_schedule_payload(spark: SparkSession, path: str, row: T.StructType) -> DataFrame:
    """A schedule that is a list of rows, or an object with a list under `rows`."""
    listed = spark.read.schema(T.StructType([*row.fields, T.StructField("rows", T.ArrayType(row))])).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    flat = listed.where("rows is null").select(*[F.col(f"`{c}`") for c in row.names])
    return flat.unionByName(listed.where("rows is not null").select(F.explode("rows").alias("r")).select("r.*"))


# Official feeds: the feed's field, our column, its type. Names of the published feeds.
OFFICIAL = {
    "leagues": (("id", "official_league_id", "string"), ("slug", "official_league_slug", "string"), ("name", "official_league_name", "string"), ("region", "official_region", "string"), ("image_url", "official_image_url", "string"), ("priority", "official_priority", "int")),
    "tournaments": (("id", "official_tournament_id", "string"), ("slug", "official_tournament_slug", "string"), ("name", "official_tournament_name", "string"), ("league_id", "official_league_id", "string"), ("start_date", "official_start_time", "timestamp"), ("end_date", "official_end_time", "timestamp")),
}


def read_official(spark: SparkSession, path: str, feed: str) -> DataFrame:
    """Leagues or tournaments of the official feed, typed: JSON objects or lists of them; what can't be read is null; league slugs in lower case."""
    schema = T.StructType([T.StructField(f, T.StringType()) for f, *_ in OFFICIAL[feed]])
    rows = read_nested_json(spark, path, schema, multi_line=True)
    typed = rows.select(*[F.col(f).try_cast(kind).alias(c) if kind != "string" else F.col(f).alias(c) for f, c, kind in OFFICIAL[feed]])
    return typed.withColumn("official_league_slug", F.lower("official_league_slug")) if feed == "leagues" else typed


# Columns of a wiki schedule.
WIKI_SCHEDULE = ("MatchId", "Team1", "Team2", "Winner", "Team1Score", "Team2Score", "DateTime_UTC", "BestOf", "OverviewPage", "ShownName", "Patch", "Round", "Phase", "Tab", "MatchDay")


def read_wiki_schedule(spark: SparkSession, path: str) -> DataFrame:
    """Rows of wiki schedules, a list or an object with `rows`: the columns of WIKI_SCHEDULE as text; a column that a file lacks is null."""
    feed = lambda c: "DateTime UTC" if c == "DateTime_UTC" else c
    row = T.StructType([T.StructField(feed(c), T.StringType()) for c in WIKI_SCHEDULE])
    return read_schedule_payload(spark, path, row).select(*[F.col(f"`{feed(c)}`").alias(c) for c in WIKI_SCHEDULE])


def read_live_frames(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Live-stat documents as frames and as events."""
    schema = "game_id string, frames array<struct<ts:timestamp,blue_gold:bigint,red_gold:bigint>>, events array<struct<ts:timestamp,type:string,team:string>>"
    docs = read_nested_json(spark, path, schema)
    return docs.select("game_id", F.explode("frames").alias("f")).select("game_id", "f.*"), docs.select("game_id", F.explode("events").alias("e")).select("game_id", "e.*")


def write_partitioned(df: DataFrame, path: str, keys: list[str], order: list[str]) -> None:
    """Hive-partitioned Parquet; only the partitions that df holds are replaced.

    Rows of a partition are dealt by a few salts, so that a large one has several writers.
    """
    salted = df.repartition(*keys, F.pmod(F.xxhash64(*order), F.lit(4))).sortWithinPartitions(*keys, *order)
    salted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders under path; none if it isn't there."""
    if not _exists(spark, path):
        return []
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return sorted(f.getPath().getName() for f in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p) if f.isDirectory())


def register_views(spark: SparkSession, root: str, names: list[str]) -> list[str]:
    """Temporary views of the Parquet tables under root; absent ones are skipped."""
    found = [n for n in names if _exists(spark, f"{root}/{n}")]
    for n in found:
        spark.read.parquet(f"{root}/{n}").createOrReplaceTempView(n)
    return found


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def _rename_into(spark: SparkSession, path: str, text: str) -> None:
    """A small text file that is there whole or not at all: written beside its place, then renamed."""
    beside = f"{path}.{uuid.uuid4().hex}"
    _write_text(spark, beside, text)
    new, old = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (beside, path))
    system = new.getFileSystem(spark._jsc.hadoopConfiguration())
    system.delete(old, False)
    if not system.rename(new, old):
        raise OSError(f"{path} could not be written")


#: Name to (severity, failing condition, threshold percent), over the rows of one table.
Checks = dict[str, tuple[str, Column, float]]


def _observed(df: DataFrame, name: str, path: str, checks: Checks) -> tuple[int, list[dict]]:
    """Writes a table and returns its number of rows and check rows, all from the one pass that writes it.

    Metrics come from the writing stage, whose tasks count once each, also if one of them is repeated.
    """
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    metrics = [F.count(F.lit(1)).alias("rows"), *[F.count(F.when(c, 1)).alias(f"check_{i}") for i, (_, c, _) in enumerate(checks.values())]]
    df.observe(seen, *metrics).write.mode("errorifexists").parquet(path)
    got = seen.get
    out = []
    for i, (check, (severity, _, threshold)) in enumerate(checks.items()):
        failing = got[f"check_{i}"]
        pct = math.floor(failing * 10000 / got["rows"] + 0.5) / 100 if got["rows"] else 0.0
        out.append({"table_name": name, "check_name": check, "severity": severity, "failing": failing, "total": got["rows"], "failing_pct": pct, "threshold_pct": float(threshold), "passed": pct <= threshold})
    return got["rows"], out


def write_snapshot(tables: dict[str, DataFrame], root: str, snapshot_id: str, gate=None, checks: dict[str, Checks] | None = None) -> dict:
    """Immutable snapshot: Parquet tables, a JSON manifest with row counts, a validation report, then the pointer, last.

    Counts and checks (by table) are observed while a table is written; none is read again. A failed check of
    severity 'error' raises PublishBlocked, and gate, if given, is called with the manifest and may
    raise; either way the report is there and the pointer stays where it was.
    """
    spark = next(iter(tables.values())).sparkSession
    base = f"{root}/snapshots/{snapshot_id}"
    counts, report = {}, []
    for name, df in tables.items():
        counts[name], rows = _observed(df, name, f"{base}/{name}", (checks or {}).get(name, {}))
        report += rows
    failed = [r["check_name"] for r in report if not r["passed"]]
    manifest = {"snapshot_id": snapshot_id, "tables": counts, "validation": {"total_checks": len(report), "failed_checks": len(failed), "failed_check_names": sorted(failed)}}
    _write_text(spark, f"{base}/manifest.json", json.dumps(manifest))
    _write_text(spark, f"{base}/validation_report.json", "\n".join(json.dumps(r) for r in report))
    if stop := sorted(r["check_name"] for r in report if not r["passed"] and r["severity"] == "error"):
        raise PublishBlocked(", ".join(stop))
    if gate is not None:
        gate(manifest)
    _rename_into(spark, f"{root}/latest.json", json.dumps({"snapshot_id": snapshot_id, "path": base}))
    return manifest


def validation_report(spark: SparkSession, snapshot: str) -> DataFrame:
    """The check rows of a snapshot, by its path."""
    return spark.read.schema("table_name string, check_name string, severity string, failing bigint, total bigint, failing_pct double, threshold_pct double, passed boolean").json(f"{snapshot}/validation_report.json")


def latest_snapshot(spark: SparkSession, root: str) -> str:
    """Path of the snapshot that the pointer names."""
    return json.loads(_read_text(spark, f"{root}/latest.json"))["path"]


def write_scored(board: DataFrame, path: str) -> None:
    """A scored sheet as CSV with header under path/rows, and its one-row summary as JSON under path/summary.

    The summary counts the rows that were written, so the two agree.
    """
    board.write.option("header", True).csv(f"{path}/rows")
    rows = board.sparkSession.read.schema(board.schema).option("header", True).csv(f"{path}/rows")
    flag = lambda c: F.count(F.when(c, 1))
    ev = F.floor(F.sum("team1_ev_pct") * 100 + 0.5) / 100
    summary = rows.agg(F.count("*").alias("rows"), flag(F.col("score_available")).alias("scored"), flag(F.col("recommend_bet")).alias("recommended"), flag(F.col("score_error") == "missing odds").alias("missing_odds"), ev.alias("team1_ev"))
    summary.write.json(f"{path}/summary")


def write_schedule(matches: DataFrame, path: str) -> None:
    """A schedule as JSON lines, times as ISO text in the session's zone."""
    times = {f.name: F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ssXXX") for f in matches.schema if f.dataType.typeName() == "timestamp"}
    matches.withColumns(times).write.json(path)


def read_schedule(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A published schedule with its types; a time that can't be read is null."""
    return spark.read.schema(schema).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ssXXX").json(path)


def publish(df: DataFrame, name: str, root: str) -> str:
    """Create or replace a serving table: a new folder of its own, then the view that names it, replaced at once.

    Readers that planned before go on with the folder they know; others see the old rows or the new
    ones, never a part. (Plain Spark has no catalog whose tables can be replaced atomically.) Returns the folder.
    """
    path = f"{root}/{name}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    df.sparkSession.sql(f"CREATE OR REPLACE VIEW `{name}` AS SELECT * FROM parquet.`{path}`")
    return path


def expire(spark: SparkSession, name: str, root: str, keep: int = 2) -> list[str]:
    """Removes the folders of a serving table but for the last `keep`; returns the names of those that went."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    system = p.getFileSystem(spark._jsc.hadoopConfiguration())
    listed = sorted(((f.getModificationTime(), f.getPath().getName()) for f in system.listStatus(p)), reverse=True)
    gone = [n for _, n in listed[keep:]]
    for n in gone:
        system.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/{n}"), True)
    return gone


def land(df: DataFrame, path: str, data_type: str, source: str, fetched_at: Column) -> None:
    """Bronze landing: rows as `data` with a `_metadata` envelope, JSON by type and fetch date."""
    at = fetched_at.cast("timestamp")
    wrapped = df.select(F.struct(*df.columns).alias("data"), F.struct(F.lit(source).alias("source"), at.alias("fetched_at"), F.lit(data_type).alias("data_type")).alias("_meta"))
    dated = wrapped.withColumns({"data_type": F.lit(data_type), "year": F.year("_meta.fetched_at"), "month": F.month("_meta.fetched_at"), "day": F.day("_meta.fetched_at")})
    dated.write.mode("append").partitionBy("data_type", "year", "month", "day").json(path)


def read_landing(spark: SparkSession, path: str, schema: str, data_type: str | None = None, since: tuple[int, int, int] | None = None) -> DataFrame:
    """Landed rows by type and date; partition filters, so other folders are not read."""
    df = spark.read.schema(f"data {schema}, _meta struct<source:string,fetched_at:timestamp,data_type:string>, data_type string, year int, month int, day int").json(path)
    if data_type is not None:
        df = df.where(F.col("data_type") == data_type)
    if since is not None:
        df = df.where(F.struct("year", "month", "day") >= F.struct(*map(F.lit, since)))
    return df


def pending_years(years: DataFrame, progress: DataFrame) -> DataFrame:
    """Years that the progress table doesn't call complete."""
    return years.join(progress.where("complete").select("year"), "year", "left_anti")


def years_landed(spark: SparkSession, root: str) -> list[int]:
    """Years whose landing is recorded as complete."""
    if not _exists(spark, f"{root}/progress"):
        return []
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/progress")
    names = [f.getPath().getName() for f in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def land_year(rows: DataFrame, root: str, year: int) -> None:
    """Rows replace the folder of their year; then the year is recorded, by one rename.

    A year that is landed again is taken off the record first, so that readers never see half of it. A crash
    between the two leaves the year off the record: it is landed again, and nothing else is.
    """
    spark = rows.sparkSession
    record = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/progress/{year}.json")
    record.getFileSystem(spark._jsc.hadoopConfiguration()).delete(record, False)
    rows.write.mode("overwrite").parquet(f"{root}/rows/year={year}")
    _rename_into(spark, f"{root}/progress/{year}.json", json.dumps({"year": year, "complete": True}))


def land_pending(spark: SparkSession, root: str, years: list[int], fetch) -> list[int]:
    """Lands the years that the record lacks, one after the other, by fetch(year); returns them."""
    done = set(years_landed(spark, root))
    todo = [y for y in years if y not in done]
    for year in todo:
        land_year(fetch(year), root, year)
    return todo


def read_landed_years(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Rows of the years on record, with their year; others are not read."""
    done = years_landed(spark, root)
    if not done:
        return spark.createDataFrame([], f"{schema}, year int")
    return spark.read.schema(f"{schema}, year int").parquet(f"{root}/rows").where(F.col("year").isin(done))


# Wiki feeds: the feed's field, our column, its type, and whether a row is nothing without it; keys first, then in the feed's order.
# Names of the published feeds.
WIKI = {
    "player_games": (
        ("GameId", "game_id", "string", True), ("MatchId", "match_id", "string", False), ("DateTime UTC", "played_at", "timestamp", True), ("Tournament", "tournament", "string", False), ("Link", "player_link", "string", True),
        ("Name", "player_name", "string", False), ("Team", "team_name", "string", False), ("Champion", "champion_name", "string", False), ("Role", "role", "string", False),
        ("Kills", "kills", "int", False), ("Deaths", "deaths", "int", False), ("Assists", "assists", "int", False), ("CS", "cs", "int", False), ("Gold", "gold", "int", False), ("DamageToChampions", "damage", "int", False), ("VisionScore", "vision_score", "int", False),
        ("Side", "side", "int", False), ("PlayerWin", "win", "flag", False),
    ),
    "profiles": (
        ("ID", "player_id", "string", True), ("Player", "player_page", "string", False), ("Name", "full_name", "string", False), ("NationalityPrimary", "nationality", "string", False), ("Birthdate", "birthdate", "date", False),
        ("Team", "team_name", "string", False), ("Role", "role", "string", False), ("IsRetired", "retired", "flag", False), ("Residency", "residency", "string", False),
    ),
    "matches": (
        ("MatchId", "match_id", "string", True), ("DateTime UTC", "match_time", "timestamp", True), ("Team1", "team1", "string", False), ("Team2", "team2", "string", False), ("Winner", "winner", "int", False), ("Team1Score", "team1_score", "int", False),
        ("Team2Score", "team2_score", "int", False), ("BestOf", "best_of", "int", False), ("Tournament", "tournament", "string", False), ("MatchDay", "match_day", "string", False),
    ),
}


def _typed(field: Column, kind: str) -> Column:
    x = F.nullif(F.trim(field), F.lit(""))
    if kind == "flag":
        low = F.lower(x)
        return F.when(low.isin("yes", "1", "true"), True).when(low.isin("no", "0", "false"), False)
    return x if kind == "string" else x.try_cast(kind)


def read_wiki(spark: SparkSession, path: str, feed: str) -> tuple[DataFrame, DataFrame]:
    """Typed rows of a wiki feed of WIKI, and rejects (source_file, reason, record).

    Files are JSON lists of rows whose values are text. A file that is no JSON is one reject; a row that lacks a
    field it needs, or has a value that is not of its type, is one reject with the first such reason (missing
    fields before bad values, each in the order of WIKI), and is not among the rows. Fields that the feed
    doesn't have are ignored.
    """
    fields = WIKI[feed]
    schema = T.StructType([T.StructField(f, T.StringType()) for f, *_ in fields] + [T.StructField("_corrupt", T.StringType())])
    raw = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    raw = raw.withColumn("source_file", F.element_at(F.split("_metadata.file_path", "/"), -1))
    blank = lambda f: F.nullif(F.trim(F.col(f"`{f}`")), F.lit("")).isNull()
    reasons = [F.when(F.col("_corrupt").isNotNull(), F.lit("not JSON"))]
    reasons += [F.when(blank(f), F.lit(f"{c} is missing")) for f, c, _, needed in fields if needed]
    reasons += [F.when(~blank(f) & _typed(F.col(f"`{f}`"), kind).isNull(), F.lit(f"{c} is no {kind}")) for f, c, kind, _ in fields if kind != "string"]
    told = raw.withColumn("reason", F.coalesce(*reasons))
    rows = told.where("reason is null").select(*[_typed(F.col(f"`{f}`"), kind).alias(c) for f, c, kind, _ in fields], "source_file")
    record = F.coalesce("_corrupt", F.to_json(F.struct(*[F.col(f"`{f}`") for f, *_ in fields])))
    return rows, told.where("reason is not null").select("source_file", "reason", record.alias("record"))
