"""Helpers shared by the corpus operators: lineage cuts and row keys.

``store`` writes a table into the folder that the cluster names in
``spark.checkpoint.dir`` and reads it back. The table survives lost executors
and cuts the lineage. ``release`` deletes everything one application stored.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_LONG = 2**63 - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a local master without a setting gets a scratch folder."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="run-corpus-")
        sc.setCheckpointDir(path)
    return f"{path.rstrip('/')}/corpus-{sc.applicationId}"


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back (eager)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete every table this application stored. Call it when no result is still needed."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def computed_once(df: DataFrame) -> DataFrame:
    """``df`` with a filter that always holds but that the optimiser cannot move.

    A caller's filter on a computed column is otherwise pushed below the projections, and every use of a column in it
    becomes a copy of that column's whole expression."""
    return df.withColumn("__row", F.monotonically_increasing_id()).filter(F.col("__row") >= 0).drop("__row")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(id_col: Column) -> Column:
    """The contract's split: crc32 of the id as text, modulo 4, is 2. A null id counts as learnable."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def row_key(id_col: Column, text_col: Column) -> list[Column]:
    """Two non-null longs that identify a document: its id (nulls last) and a hash of its text.

    Rows with the same id and the same text are one document to the operators.
    """
    return [F.coalesce(id_col.cast("long"), F.lit(MAX_LONG)).alias("d"),
            F.xxhash64(text_col, text_col.isNull(), id_col.isNull()).alias("k")]


def keep_columns(df: DataFrame, new: list[str]) -> list[str]:
    """Input columns that survive beside result columns named ``new`` (results win a clash)."""
    taken = {n.lower() for n in new}
    return [c for c in df.columns if c.lower() not in taken]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of one column that a Python step turns into Python objects at a time (one longer text is taken alone).
SLICE_BYTES = 4 << 20


def sliced(batches: Iterator[pa.RecordBatch], column: int, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces whose texts in ``column`` hold about ``max_bytes``, none without rows.

    When a task's rows end, Arrow's pool gives its unused memory back, so an idle reused worker holds little."""
    for b in batches:
        lo = 0
        while lo < b.num_rows:
            n = b.num_rows - lo
            while n > 1 and b.column(column).slice(lo, n).nbytes > max_bytes:
                n = (n + 1) // 2
            yield b.slice(lo, n)
            lo += n
        del b
    pa.default_memory_pool().release_unused()
