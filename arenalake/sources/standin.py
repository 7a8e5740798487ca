"""Competition tables made from the star schema: entrant rows, participant rows, schedules, odds.

Each has a Spark form and, for the reference SQL, a common table expression of the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

GRAINS = {"region": "r_name", "nation": "n_name", "supplier": "s_name"}
ROLES = ("top", "jng", "mid", "bot", "sup")
_ORDER = (
    "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", "l_quantity",
    "l_shipdate", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with its timestamps as TIMESTAMP, whatever the file says."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ntz = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


#: Bytes of the files of a dimension table that is sent to all executors whole, so that what joins it isn't dealt once more.
SMALL_BYTES = 16 << 20


def small(dimension: DataFrame) -> DataFrame:
    """A dimension table, marked for a broadcast if its files are small."""
    read = dimension._jdf.queryExecution().analyzed().collectLeaves()
    size = sum(int(str(read.apply(i).stats().sizeInBytes())) for i in range(read.size()))
    return F.broadcast(dimension) if size <= SMALL_BYTES else dimension


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items numbered anew inside their order, with the dimensions a competition row needs."""
    t = lambda n: table(spark, sf_dir, n)
    suppliers = (
        t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "s_name", "n_name", "r_name")
    )
    orders = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.to_date("o_orderdate").alias("event_date"), F.col("c_mktsegment").alias("league_code")
    )
    suppliers = small(suppliers)
    rn = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*_ORDER))
    return (
        t("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .withColumn("rn", rn)
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    )


def bronze_entrants(spark: SparkSession, sf_dir: str, grain: str) -> DataFrame:
    """Box-score rows of both sides, every column a string, as a CSV feed has them."""
    s = lambda c: c.cast("string")
    name, qty = F.col(GRAINS[grain]), F.col("l_quantity").cast("int")
    game = W.partitionBy("o_orderkey")
    best = F.row_number().over(game.orderBy(F.desc("l_quantity"), F.desc("l_extendedprice"), "rn")) == 1
    month, key = F.month("event_date"), F.col("o_orderkey")
    both = lines(spark, sf_dir).where("rn <= 2").withColumns({"name": name, "won": best, "low": F.min(name).over(game), "high": F.max(name).over(game)})
    return both.where("low <> high").select(
        F.concat(F.lit("G"), s(key)).alias("game_id"), F.when(F.col("rn") == 1, "blue").otherwise("red").alias("side"),
        F.lit("team").alias("position"),
        F.when(key % 17 != 0, F.concat(F.lit("T-"), F.col("name"))).otherwise("").alias("team_id"), F.col("name").alias("team_name"),
        F.col("league_code"), s(F.year("event_date")).alias("year"),
        F.when(month % 5 == 0, "").otherwise(F.concat(F.lit("Q"), s(F.quarter("event_date")))).alias("split"),
        F.concat(s(F.year("event_date")), F.lit("."), s(month)).alias("patch"), s(F.col("event_date")).alias("date"),
        F.when(month == 12, "1").otherwise("0").alias("playoffs"), s(key).alias("game_number"),
        F.when(key % 7 == 0, F.when(F.col("won"), "Win").otherwise("loss")).when(F.col("won"), "1").otherwise("0").alias("result"),
        s(qty).alias("kills"), s(F.round(F.col("l_discount") * 100).cast("int")).alias("deaths"), s(F.round(F.col("l_tax") * 100).cast("int")).alias("assists"),
        F.when(key % 23 == 0, "").otherwise(s(qty % 5)).alias("dragons"), s(qty % 3).alias("barons"), s(qty % 12).alias("towers"), s(qty % 4).alias("inhibitors"),
        s(1200 + key % 1500).alias("game_length"), s(F.floor("l_extendedprice").cast("int")).alias("gold"),
    )


def bronze_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box-score rows of participants, every column a string."""
    s = lambda c: c.cast("string")
    qty, key = F.col("l_quantity").cast("int"), F.col("o_orderkey")
    roles = F.array(*map(F.lit, ROLES))
    return lines(spark, sf_dir).select(
        F.concat(F.lit("G"), s(key)).alias("game_id"), F.when(F.col("rn") % 2 == 1, "blue").otherwise("red").alias("side"),
        F.element_at(roles, F.col("rn") % 5 + 1).alias("position"), s(F.col("rn")).alias("participant_id"),
        F.when(F.col("l_suppkey") % 11 != 0, F.concat(F.lit("P-"), s(F.col("l_suppkey")))).otherwise("").alias("player_id"), F.col("s_name").alias("player_name"),
        F.col("p_brand").alias("champion"), F.col("league_code"), s(F.year("event_date")).alias("year"), s(F.col("event_date")).alias("date"),
        s(qty).alias("kills"), s(F.round(F.col("l_discount") * 100).cast("int")).alias("deaths"), s(F.round(F.col("l_tax") * 100).cast("int")).alias("assists"),
        s(F.floor("l_extendedprice").cast("int")).alias("damage"),
    )


_LINES = f"""
lines AS (
  SELECT l.*, o_orderkey, CAST(o_orderdate AS DATE) AS event_date, c_mktsegment AS league_code, s_name, n_name, r_name, p_brand
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(_ORDER)}) AS rn FROM lineitem) l
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey
)"""


def bronze_entrants_sql(grain: str) -> str:
    """CTEs lines, both_sides and bronze."""
    return f"""{_LINES},
both_sides AS (
  SELECT *, {GRAINS[grain]} AS name,
    row_number() OVER (PARTITION BY o_orderkey ORDER BY l_quantity DESC, l_extendedprice DESC, rn) = 1 AS won,
    min({GRAINS[grain]}) OVER (PARTITION BY o_orderkey) AS low, max({GRAINS[grain]}) OVER (PARTITION BY o_orderkey) AS high
  FROM lines WHERE rn <= 2
),
bronze AS (
  SELECT 'G' || o_orderkey AS game_id, CASE WHEN rn = 1 THEN 'blue' ELSE 'red' END AS side, 'team' AS position,
    CASE WHEN o_orderkey % 17 <> 0 THEN 'T-' || name ELSE '' END AS team_id, name AS team_name, league_code,
    CAST(year(event_date) AS VARCHAR) AS year,
    CASE WHEN month(event_date) % 5 = 0 THEN '' ELSE 'Q' || quarter(event_date) END AS split,
    year(event_date) || '.' || month(event_date) AS patch, CAST(event_date AS VARCHAR) AS date,
    CASE WHEN month(event_date) = 12 THEN '1' ELSE '0' END AS playoffs, CAST(o_orderkey AS VARCHAR) AS game_number,
    CASE WHEN o_orderkey % 7 = 0 THEN CASE WHEN won THEN 'Win' ELSE 'loss' END WHEN won THEN '1' ELSE '0' END AS result,
    CAST(CAST(l_quantity AS INT) AS VARCHAR) AS kills, CAST(CAST(round(l_discount * 100) AS INT) AS VARCHAR) AS deaths,
    CAST(CAST(round(l_tax * 100) AS INT) AS VARCHAR) AS assists,
    CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE CAST(CAST(l_quantity AS INT) % 5 AS VARCHAR) END AS dragons,
    CAST(CAST(l_quantity AS INT) % 3 AS VARCHAR) AS barons, CAST(CAST(l_quantity AS INT) % 12 AS VARCHAR) AS towers,
    CAST(CAST(l_quantity AS INT) % 4 AS VARCHAR) AS inhibitors, CAST(1200 + o_orderkey % 1500 AS VARCHAR) AS game_length,
    CAST(CAST(floor(l_extendedprice) AS INT) AS VARCHAR) AS gold
  FROM both_sides WHERE low <> high
)"""


def entrants_sql(grain: str) -> str:
    """CTEs up to entrants: typed rows of both sides."""
    number = lambda c, n=None: f"TRY_CAST(nullif({c}, '') AS INT) AS {n or c}"
    return f"""{bronze_entrants_sql(grain)},
entrants AS (
  SELECT game_id, side, nullif(team_id, '') AS team_id, team_name,
    CASE WHEN nullif(team_id, '') IS NOT NULL THEN 'team:' || team_id ELSE 'teamname:' || regexp_replace(lower(team_name), '[^a-z0-9]+', '', 'g') END AS team_key,
    league_code, {number("year", "season_year")}, nullif(split, '') AS split_name, patch AS patch_version, TRY_CAST(date AS DATE) AS event_date,
    {number("playoffs")}, CAST(game_number AS BIGINT) AS game_number,
    CASE lower(result) WHEN 'win' THEN 1 WHEN 'loss' THEN 0 ELSE CAST(round(TRY_CAST(result AS DOUBLE)) AS INT) END AS win,
    {", ".join(map(number, ("kills", "deaths", "assists", "dragons", "barons", "towers", "inhibitors")))},
    {number("game_length", "game_length_seconds")}, {number("gold")}
  FROM bronze WHERE position = 'team'
)"""


def participants_sql() -> str:
    """CTEs up to participants: typed participant rows (after entrants_sql, without its lines)."""
    return """
participants AS (
  SELECT 'G' || o_orderkey AS game_id, CASE WHEN rn % 2 = 1 THEN 'blue' ELSE 'red' END AS side,
    (['top', 'jng', 'mid', 'bot', 'sup'])[CAST(rn % 5 + 1 AS INT)] AS role, CAST(rn AS INT) AS participant_id,
    CASE WHEN l_suppkey % 11 <> 0 THEN 'P-' || l_suppkey END AS player_id, s_name AS player_name,
    CASE WHEN l_suppkey % 11 <> 0 THEN 'player:P-' || l_suppkey ELSE 'playername:' || regexp_replace(lower(s_name), '[^a-z0-9]+', '', 'g') END AS player_key,
    p_brand AS champion_name, league_code, year(event_date) AS season_year, event_date,
    CAST(l_quantity AS INT) AS kills, CAST(round(l_discount * 100) AS INT) AS deaths, CAST(round(l_tax * 100) AS INT) AS assists,
    CAST(floor(l_extendedprice) AS INT) AS damage
  FROM lines
)"""
