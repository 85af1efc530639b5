"""Tables between steps, in the folder that the cluster shares (spark.checkpoint.dir)."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The setting that says into how many tasks a scan is dealt out before work that the CPU bounds; unset: as it is.
TASKS = "spark.pagemill.scanTasks"


def folder(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; only a local session without one uses the machine's own temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        root = "file://" + os.path.join(tempfile.gettempdir(), f"pagemill-scratch-{os.getuid()}")
    return f"{root.rstrip('/')}/pagemill/{label}-{uuid.uuid4().hex}"


def spread(scan: DataFrame) -> DataFrame:
    """A scan dealt out into as many tasks as TASKS says, for tables of one small file; large ones have splits enough."""
    tasks = scan.sparkSession.conf.get(TASKS, None)
    return scan.repartition(int(tasks)) if tasks else scan


def fan_out(rows: DataFrame, *keys: str) -> DataFrame:
    """Few bytes that become much work, such as numbers that pages are made of: a scan's splits go by bytes and would
    leave them to one task, so they are dealt out by their keys into several tasks a core, whatever the table's size."""
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return rows.repartition(tasks, *keys)


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """df written and read again: its lineage ends there."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
