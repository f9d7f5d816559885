"""The folder that all executors share, and tables written there."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

#: Rows of a partition in loops of small jobs.
PART = 50_000


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of the session, spark.checkpoint.dir. Where that is unset, a temporary
    folder is made and set on one machine, as in tests; on a cluster that is an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="tallyweave-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again: its lineage ends there, and what reads it
    several times doesn't make it again."""
    spark = df.sparkSession
    path = work_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def handed(df: DataFrame, session: SparkSession) -> DataFrame:
    """df written in the shared folder and read by another session of the same application."""
    path = work_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return session.read.schema(df.schema).parquet(path)


def looping(spark: SparkSession, parts: int) -> SparkSession:
    """A session with the settings of this one for rounds of small jobs whose partitions are fixed: plans aren't made
    again after each shuffle, which takes longer there than the shuffle."""
    session = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if session.conf.get(key, None) != value:
            session.conf.set(key, value)
    session.conf.set("spark.sql.adaptive.enabled", "false")
    session.conf.set("spark.sql.shuffle.partitions", str(parts))
    return session


def dealt(df: DataFrame, parts: int, key: str) -> DataFrame:
    """df in so many partitions by key. A single one holds all keys as it is, so what meets there isn't shuffled."""
    return df.coalesce(1) if parts == 1 else df.repartition(parts, key)


def together(*makes: Callable):
    """The results of functions that run jobs of their own, run at the same time: loops of small jobs leave most
    cores idle, and don't wait for each other."""
    with ThreadPoolExecutor(len(makes)) as pool:
        return [f.result() for f in [pool.submit(make) for make in makes]]
