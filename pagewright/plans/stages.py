"""Durable intermediate tables and checked broadcasts.

An intermediate result that several later stages read is written as Parquet under ``spark.checkpoint.dir``: all
executors share that folder, so the loss of one costs no recomputation, and a narrow columnar table is far smaller
than a cached row set.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if the number of its rows, counted first, is at most this.
BROADCAST_ROWS = 200_000

_written: list[str] = []


def stage_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the cluster's own. Only a local session without one gets a folder of
    its own; on a cluster a folder of one machine would be lost to the others, so it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="pagewright-stage-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there goes when the program ends or ``clear_stages`` is called."""
    if not _written:
        atexit.register(_clear_last)
    path = f"{stage_dir(spark).rstrip('/')}/pagewright/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: one computation, however many readers. ``by`` names a column
    of few values that readers select by: they read its folders only."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_stages(spark: SparkSession) -> int:
    """Delete the intermediate tables that this program has written; results that read them must be done. Returns how many."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    done = 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        done += bool(path.getFileSystem(conf).delete(path, True))
    return done


def _clear_last() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    try:
        clear_stages(spark)
    except Exception:  # the session is going down already: its folder is left as it is
        return


def join_small(left: DataFrame, right: DataFrame, on, how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a side that is expected to be small: broadcast if a count proves it, else a shuffled join.

    The count stops at ``rows + 1``; beyond it Catalyst plans an ordinary join, where AQE splits skewed keys.
    """
    if right.limit(rows + 1).count() <= rows:
        return left.join(F.broadcast(right), on, how)
    return left.join(right, on, how)


def once(df: DataFrame, key: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per key of a table in which few keys are repeated with the same content.

    Keys alone are counted first. Rows of keys that occur once pass without a shuffle; only those of repeated keys are
    made unique. The repeated keys are broadcast if they are few enough, else joined. A null key is no key: its rows stay.
    """
    again = df.groupBy(key).count().where("count > 1").select(key)
    found = again.limit(rows + 1).count()
    if not found:
        return df
    again = F.broadcast(again) if found <= rows else again
    return df.join(again, key, "left_anti").unionByName(df.join(again, key, "left_semi").dropDuplicates([key]))
