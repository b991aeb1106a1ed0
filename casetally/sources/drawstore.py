"""Multiple imputations stored as draws: the records once, and the drawn values of those that miss some.

A completed long table of m imputations repeats every record m times. The store keeps two Parquet tables and a list:

* ``observed``: every record once, missing targets as NULL, partitioned by the ``by`` columns (the year);
* ``draws``: per record with a missing target and imputation the row key and the targets' completed values, partitioned
  by the ``by`` columns and the imputation;
* ``imputations``: the imputation numbers and the types of both tables.

Readers rebuild the long form, one imputation, or the pair (records without a missing target, completed records of the
others) that the compositions count without repeating anything. A filter on the ``by`` columns reaches both tables as a
partition filter, the choice of an imputation the draws. Writing some years again replaces their partitions alone.

Defined cases: a target stays NULL where its draw is NULL; a NULL in a row key or ``by`` column is a value like any other;
a record that misses a target and has no draw makes readers raise; draws of records that miss nothing (left from an
earlier write of their year) are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

IMP = "imp"


@dataclass(frozen=True)
class DrawStore:
    path: str
    targets: Sequence[str]
    row_key: Sequence[str]
    by: Sequence[str] = ("year",)
    imp_col: str = IMP

    def _part(self, name: str) -> str:
        return f"{self.path.rstrip('/')}/{name}"

    def _missing(self) -> Column:
        return reduce(lambda a, b: a | b, [F.col(t).isNull() for t in self.targets])

    def write(self, records: DataFrame, completed: DataFrame, m: int) -> None:
        """``records``: every record once; ``completed``: the records with a missing target, once per imputation, completed.

        Partitions of the ``by`` values present are replaced, others stay. All writes to a store have the same ``m``."""
        spark = records.sparkSession
        draws = completed.select(*self.by, *self.row_key, *self.targets, F.col(self.imp_col).cast("int").alias(self.imp_col))
        if self._exists(spark):
            if (known := self._numbers(spark)) != list(range(1, m + 1)):
                raise ValueError(f"the store has imputations {known}, not 1 to {m}")
        else:
            types = [F.lit(df.schema.json()).alias(name) for name, df in (("observed", records), ("draws", draws))]
            numbers = spark.range(1, m + 1).select(F.col("id").cast("int").alias(self.imp_col), *types)
            numbers.coalesce(1).write.parquet(self._part("imputations"))
        self._replace(records, "observed", self.by)
        self._replace(draws, "draws", [*self.by, self.imp_col])

    def _replace(self, df: DataFrame, name: str, partitions: Sequence[str]) -> None:
        # rows of one partition meet in few tasks, a partition with many rows is dealt over many (adaptive rebalancing)
        (df.hint("rebalance", *partitions).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
           .partitionBy(*partitions).parquet(self._part(name)))

    def _exists(self, spark: SparkSession) -> bool:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._part("imputations"))
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def _numbers(self, spark: SparkSession) -> list[int]:
        return sorted(r[0] for r in spark.read.parquet(self._part("imputations")).select(self.imp_col).collect())  # m rows

    def _read(self, spark: SparkSession, name: str, where: Column | str | None) -> DataFrame:
        types = spark.read.parquet(self._part("imputations")).select(name).first()[0]
        df = spark.read.schema(T.StructType.fromJson(json.loads(types))).parquet(self._part(name))
        return df if where is None else df.filter(where)

    def split(self, spark: SparkSession, where: Column | str | None = None, imp: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(records without a missing target, once; completed records of the others, per imputation).

        ``where`` may use the ``by`` columns only; ``imp`` reads one imputation."""
        records = self._read(spark, "observed", where)
        draws = self._read(spark, "draws", where)
        if imp is not None:
            draws = draws.filter(F.col(self.imp_col) == imp)
        keys = [*self.by, *self.row_key]
        tagged = draws.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col(self.imp_col).alias("__imp"),
                              *[F.col(t).alias(f"__d_{t}") for t in self.targets])
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
        both = records.filter(self._missing()).join(tagged, same, "left")
        number = F.coalesce("__imp", F.raise_error(F.lit("a record misses a target and has no draw in the store")).cast("int"))
        filled = {t: F.coalesce(F.col(t), F.col(f"__d_{t}")) for t in self.targets}
        completed = both.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in records.columns], number.alias(self.imp_col))
        return records.filter(~self._missing()), completed

    def long(self, spark: SparkSession, where: Column | str | None = None, imp: int | None = None) -> DataFrame:
        """The completed long form: every record once per imputation, or for one imputation."""
        full, completed = self.split(spark, where, imp)
        numbers = self._numbers(spark) if imp is None else [imp]
        return full.withColumn(self.imp_col, F.explode(F.array(*[F.lit(n) for n in numbers]))).unionByName(completed)
