"""Shared helpers: scratch tables, joins apart of hot keys, row keys."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = tempfile.mkdtemp(prefix="arenalake-")
    return _own_dir[app]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it back with the same schema.

    A lost executor loses nothing of it. The files may be removed when the application ends, or
    with discard() as soon as no frame reads them any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/arenalake/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def discard(table: DataFrame) -> None:
    """Remove the files of a table that materialise() returned; nothing may read it afterwards."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_apart(rows: DataFrame, of_key: DataFrame, keys: list[str], n: str, limit: int) -> DataFrame:
    """rows.join(of_key, keys), where rows of keys with n over `limit` stay where they are.

    What of_key says of such keys is broadcast: at most (sum of n) / limit keys, so a limit that is
    a share of all rows bounds it. All other keys are joined by a shuffle.
    """
    hot = F.broadcast(of_key.where(F.col(n) > limit))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(of_key.where(F.col(n) <= limit), keys)
    return rows.join(hot, keys).unionByName(rest)


def hot_limit(rows: int) -> int:
    """Rows of one key that are too many for one task: one in a thousand, so at most a thousand keys have them."""
    return max(1000, rows // 1000)


def give_back() -> None:
    """What this process has freed goes back to the system; else a worker, or the driver, holds it as long as it lives."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(doc_id: Column, text: Column) -> Column:
    """A key that keeps rows apart which share a doc_id but not a text. Never null."""
    return F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), F.hex(F.xxhash64(text)))
