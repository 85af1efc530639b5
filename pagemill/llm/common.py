"""What the training-data operators share: scratch tables in the cluster's shared folder, and small column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.scratch import folder, spread

#: ASCII white space as the contracts define it.
SPACE = r"\x20\x09-\x0D"


def new_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    return folder(spark, label)


def write_table(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, so a lost executor costs one file read."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._pagemill_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete a table of write_table that nothing will read again."""
    path = getattr(df, "_pagemill_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def unused(name: str, columns: list[str]) -> str:
    """name, or the like, that isn't among columns (letter case doesn't tell columns apart)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def word_count(text: Column) -> Column:
    """Number of runs of characters that are no ASCII white space, null as 0; no array of words is built."""
    marks = F.regexp_replace(text, rf"[{SPACE}]*[^{SPACE}]+", "x")
    return F.coalesce(F.length(F.regexp_replace(marks, rf"[{SPACE}]+", "")), F.lit(0)).cast("long")


def hash_sample(rows: DataFrame, count: int, limit: int, keys: list[str], columns: list[str]) -> DataFrame:
    """columns of the limit rows (of count) with the smallest hashes of keys: the same ones under any partitioning.

    A bound on the hash keeps about twice as many first, so that no partition sends the driver more than its share.
    """
    hashed = rows.select(F.xxhash64(*keys).alias("_hash"), *columns)
    if count > 2 * limit:
        hashed = hashed.where(F.col("_hash") < int(2 * limit / count * 2**64) - 2**63)
    return hashed.orderBy("_hash", *columns).limit(limit).drop("_hash")


_worker: dict = {}


def worker_cache(key, make):
    """What a Python worker keeps from task to task: one thing at a time, so that memory holds the last one alone."""
    if key not in _worker:
        _worker.clear()
        _worker[key] = make()
    return _worker[key]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table documents, dealt out only if the session says so (scratch.TASKS)."""
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
