"""What the operators share: small Arrow batches, checkpoints in the shared folder, and joins that hot keys don't slow."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts in one Arrow batch; long texts make large batches.
ROWS_PER_BATCH = 1000
#: Rows of a table in one task and file, where the number of rows is known; larger tables keep their partitions.
ROWS_PER_FILE = 16_000
#: Rows of up to 50 bytes that may be broadcast after a count; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: A key is hot beyond so many rows, or beyond that share of all rows; so there are at most as many hot keys.
HOT_ROWS, HOT_KEYS = 256, 100_000


def prepared(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches that Python tasks get.

    The session's setting is lowered if it is higher, and stays so, as Spark reads it when a result is computed.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ROWS_PER_BATCH:
        spark.conf.set(name, str(ROWS_PER_BATCH))
    return spark


def settled(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in ``spark.checkpoint.dir``.

    Only a local session without that setting, such as a test's, gets a folder of its own.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="furrow-checkpoint-"))
    return df.checkpoint()


def parallelism(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def files_for(rows: int) -> int:
    """How many tasks and files so many rows are worth."""
    return max(1, -(-rows // ROWS_PER_FILE))


def few(rows: DataFrame, files: int | None = None) -> DataFrame:
    """The rows, settled, for a join: broadcast if they are few enough."""
    rows = settled(rows if files is None else rows.coalesce(files))
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def joined_by_size(rows: DataFrame, groups: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows`` with the columns of ``groups``, which has each key once and, as ``n``, how many rows have it.

    Rows of hot keys meet their group by broadcast; there are at most ``HOT_KEYS`` of them among ``total`` rows, so
    no key brings more than ``total / HOT_KEYS`` rows, or ``HOT_ROWS``, to one task.
    """
    most = max(HOT_ROWS, total // HOT_KEYS)
    hot, cold = F.broadcast(groups.where(F.col("n") > most).drop("n")), groups.where(F.col("n") <= most).drop("n")
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys))
