"""Session helpers: where checkpoints go, and proven bounds for what is broadcast."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage with files in the shared folder of ``spark.checkpoint.dir``.

    Only where that is unset, and only in local mode (tests), is a temporary folder used; a cluster must name one.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        configured = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not configured and not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir is not set; on a cluster it must name a folder that all executors share")
        sc.setCheckpointDir(configured or _own_folder())
    return df.checkpoint(eager)


def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="relgrain-checkpoint-")
    atexit.register(shutil.rmtree, folder, True)
    return folder


#: Views and folders that ``release`` removes, by application.
_held: dict[str, tuple[set[str], set[str]]] = {}


def _holds(spark: SparkSession) -> tuple[set[str], set[str]]:
    return _held.setdefault(spark.sparkContext.applicationId, (set(), set()))


def as_view(df: DataFrame, name: str) -> DataFrame:
    """A view of the session over ``df``, replaced where there is one; gives ``df`` back."""
    df.createOrReplaceTempView(name)
    _holds(df.sparkSession)[0].add(name)
    return df


def work_folder(spark: SparkSession) -> str:
    """A new folder, in that of checkpoints, which all executors share."""
    sc = spark.sparkContext
    checkpoint(spark.range(0))  # sees to it that there is one
    folder = f"{sc.getCheckpointDir()}/relgrain-{uuid.uuid4().hex}"
    _holds(spark)[1].add(folder)
    return folder


def release(spark: SparkSession) -> None:
    """Drop the views and delete the folders made so far. What was made of them can't be read afterwards.

    Checkpoints are Spark's own: ``spark.cleaner.referenceTracking.cleanCheckpoints=true`` deletes each when nothing
    refers to it any more.
    """
    views, folders = _held.pop(spark.sparkContext.applicationId, (set(), set()))
    for name in views:
        spark.catalog.dropTempView(name)
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _few(df: DataFrame, max_rows: int) -> DataFrame | None:
    """The rows themselves, if there are at most ``max_rows``. At most one more is read."""
    rows = df.limit(max_rows + 1).collect()
    return df.sparkSession.createDataFrame(rows, df.schema) if len(rows) <= max_rows else None


def looked_up(df: DataFrame, table: DataFrame, key: str, how: str = "inner", spread: str | None = None, salts: int = 64) -> DataFrame:
    """``df`` with the columns of ``table``, which has a row for each value of ``key``: for tables that are nearly always
    small, beside rows of which one key may hold a third.

    A table of a checked size is broadcast. A larger one is joined by key and a salt made of ``spread`` (a column of
    ``df``), so that no key gathers in one task; the table is repeated ``salts`` times for it. The result is the same.
    """
    few = _few(table, 10_000)
    if few is not None:
        return df.join(F.broadcast(few), key, how)
    salted = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.xxhash64(spread) if spread else F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    return df.withColumn("__salt", salt).join(salted, [key, "__salt"], how).drop("__salt")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
