"""Materialising derived tables in the shared checkpoint folder.

Catalyst's size estimate of an aggregate is bounded by its input scan, so a
distribution table of a few thousand cells built from terabytes of records
looks terabyte-sized and is never broadcast. Written as Parquet into the
shared checkpoint folder (reliable: survives executor loss and cuts the
lineage) its real size is known, and Spark broadcasts it or not by its own
threshold.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetally.operators.joins import estimated_bytes
from casetally.session import checkpoint_dir


#: Rows that a task has on the average after its rows are repeated per imputation.
REPEATED_ROWS = 1 << 19


def materialize(df: DataFrame, file_rows: int = 0) -> DataFrame:
    """Write ``df`` as Parquet under ``spark.checkpoint.dir`` and read it back.

    A written table in the shared folder: survives executor loss, cuts the
    lineage, and is columnar (faster to write and read than a serialised RDD
    checkpoint). Eager. ``file_rows``: rows of a file at most (0: no limit).
    """
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.mode("overwrite").option("maxRecordsPerFile", file_rows).parquet(path)
    return spark.read.parquet(path)


def new_folder(spark) -> str:
    """A path for files of this application in the shared checkpoint folder; nothing is there yet."""
    return f"{_app_folder(spark)}/{uuid.uuid4().hex}"


def _app_folder(spark) -> str:
    """All tables materialised by one application live under one folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/casetally-{spark.sparkContext.applicationId}"


def release_materialized(spark) -> bool:
    """Delete the tables this application materialised (call when the job is done).

    Uses the Hadoop FileSystem API, so it works on any cluster file system.
    DataFrames built on those tables must not be used afterwards.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_app_folder(spark))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(path) and fs.delete(path, True))


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote (``df`` reads nothing else), which nothing reads any more."""
    jvm, own = df.sparkSession.sparkContext._jvm, _app_folder(df.sparkSession)
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if path.getParent().getName() == own.rpartition("/")[2]:
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def saved_with_stats(df: DataFrame, stats: dict) -> DataFrame:
    """Materialise ``df`` and compute ``stats`` (name -> aggregate Column) over it; their values replace the Columns.

    The table carries no broadcast hint: Spark knows its written size and
    broadcasts it below ``spark.sql.autoBroadcastJoinThreshold``, else joins
    by shuffle with skew splitting.
    """
    saved = materialize(df)
    row = saved.agg(*[c.alias(k) for k, c in stats.items()]).first()
    stats.update({k: row[k] for k in stats})
    return saved


def _max_partition_bytes(spark) -> int:
    try:
        return int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    except Exception:  # noqa: BLE001
        return 128 * 1024 * 1024


def input_bytes(df: DataFrame) -> int | None:
    """Total size of the relations a plan reads (file sizes for file scans).

    Unlike the estimate of the plan's output (which multiplies the sides of
    a join without statistics), this is the real input volume, which decides
    how many splits the scans produce.
    """
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    except Exception:  # noqa: BLE001
        return estimated_bytes(df)


def spread_small(df: DataFrame) -> DataFrame:
    """Spread a small input over the cluster's default parallelism.

    A plan whose inputs total less than ``maxPartitionBytes x parallelism``
    arrives in a handful of splits (one small file is one task); before it is
    expanded m times and every row is hashed, it is round-robined over all
    cores. The shuffle is cheap because the input is small. Large inputs
    already have at least that many splits, and data coming out of a shuffle
    is already spread; both are returned unchanged.
    """
    spark = df.sparkSession
    par = spark.sparkContext.defaultParallelism
    if _after_shuffle(df):
        return df  # already spread over the shuffle partitions
    size = input_bytes(df)
    if size is not None and size < _max_partition_bytes(spark) * par:
        return df.repartition(par)
    return df


def spread_repeated(df: DataFrame, copies: int, rows: int) -> DataFrame:
    """``df``, of ``rows`` rows at most, dealt evenly over so many tasks that each sorts a bounded number once its rows are repeated.

    The number of shuffle partitions does not grow with the input; a task's sort would."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows * copies // REPEATED_ROWS)))


def _after_shuffle(df: DataFrame) -> bool:
    """Does the plan already pass through a (non single-partition) shuffle?"""
    try:
        plan = df._jdf.queryExecution().executedPlan().toString()
    except Exception:  # noqa: BLE001
        return False
    return any(k in plan for k in ("Exchange hashpartitioning", "Exchange rangepartitioning",
                                   "Exchange RoundRobinPartitioning"))
