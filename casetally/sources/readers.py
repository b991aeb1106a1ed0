"""Readers and writers with explicit types.

No reader infers a schema from the data: delimited files are read as text
columns and cast by name to declared types (robust to header case and column
order between yearly files), fixed-width files are cut by declared widths.
"""

from __future__ import annotations

import csv
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casetally.operators.materialize import materialize


def _cast(col, dtype: T.DataType, strict: bool, date_format: str | None = None):
    c = F.col(col) if isinstance(col, str) else col
    if date_format and isinstance(dtype, T.DateType):
        return F.to_date(c, date_format) if strict else F.try_to_timestamp(c, F.lit(date_format)).cast("date")
    return c.cast(dtype) if strict else c.try_cast(dtype)


def list_files(spark: SparkSession, paths: str | Sequence[str]) -> list[str]:
    """Expand files, directories and globs to a sorted list of files.

    Spark's file index lists them (in a job once there are many folders), on any
    cluster file system; hidden and marker files (``_``, ``.``) are skipped.
    """
    wanted = [paths] if isinstance(paths, str) else list(paths)
    try:
        found = spark.read.format("text").load(wanted).inputFiles()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = []
    if not found:
        raise FileNotFoundError(f"no input files in {paths}")
    return sorted({unquote(f) for f in found})


def first_lines(spark: SparkSession, files: Sequence[str], threads: int = 16) -> list[str]:
    """The first line of each file, by the Hadoop FileSystem API (compressed files by their extension).

    A few kilobytes are read of a file, whatever its size, so the headers of ten thousand files take seconds.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def first(name: str) -> str:
        path = jvm.org.apache.hadoop.fs.Path(name)
        stream = path.getFileSystem(conf).open(path)
        try:
            codec = codecs.getCodec(path)
            data = codec.createInputStream(stream) if codec is not None else stream
            line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(data, "UTF-8")).readLine()
        finally:
            stream.close()
        return (line or "").removeprefix("\ufeff")

    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(first, files))


def header_layouts(spark: SparkSession, paths: str | Sequence[str], sep: str = "\t") -> dict[tuple[str, ...], list[str]]:
    """The files of each header (lower-cased names in file order), in the order of the files; files without a line are left out."""
    files = list_files(spark, paths)
    layouts: dict[tuple[str, ...], list[str]] = {}
    for name, line in zip(files, first_lines(spark, files), strict=True):
        if line:
            header = next(csv.reader([line], delimiter=sep))
            layouts.setdefault(tuple(h.strip().lower() for h in header), []).append(name)
    return layouts


def read_delimited(spark: SparkSession, paths: str | Sequence[str], columns: dict[str, T.DataType],
                   sep: str = "\t", null_values: str | None = None, strict: bool = True, date_format: str | None = None,
                   year_pattern: str | None = None, year_col: str = "file_year") -> DataFrame:
    """Delimited files with a header line, one or more per year, stacked by column name.

    Files are grouped by their header: one relation per layout, so the plan
    grows with the number of layouts and not with the number of files (yearly
    files may order or case their columns differently). Header names are
    lower-cased, only ``columns`` are kept and cast. Text that does not fit its
    type raises; with ``strict=False`` it becomes NULL (which later steps would
    impute). ``date_format`` is the pattern of date columns. The CSV reader
    prunes the other columns. With ``year_pattern`` (a regex with one group)
    the year is taken from each file's name rather than from its position in a
    listing. Files without a line add no rows; if no file has one, the result is
    empty. A wanted name that stands twice in a header raises.
    """
    reader = spark.read.option("header", True).option("enforceSchema", True).option("sep", sep)
    if null_values is not None:
        reader = reader.option("nullValue", null_values)
    frames = []
    for header, files in header_layouts(spark, paths, sep).items():
        if missing := [c for c in columns if c not in header]:
            raise KeyError(f"columns {missing} not in the header of {files[0]}")
        if twice := [c for c in columns if header.count(c) > 1]:
            raise KeyError(f"columns {twice} stand twice in the header of {files[0]}")
        names = [h if h in columns else f"__{i}" for i, h in enumerate(header)]
        raw = reader.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(files)
        year = [F.regexp_extract(F.col("_metadata.file_name"), year_pattern, 1).cast("int").alias(year_col)] if year_pattern else []
        frames.append(raw.select(*[_cast(c, t, strict, date_format).alias(c) for c, t in columns.items()], *year))
    if not frames:
        empty = [T.StructField(c, t) for c, t in columns.items()]
        return spark.createDataFrame([], T.StructType(empty + ([T.StructField(year_col, T.IntegerType())] if year_pattern else [])))
    out = frames[0]
    for fr in frames[1:]:
        out = out.unionByName(fr)
    return out


def write_delimited_years(df: DataFrame, folder: str, year: str, name: str = "CF{year}v1", header: Sequence[str] | None = None,
                          sep: str = "\t", null_value: str = "") -> None:
    """One or more files with a header line for each year, named ``name`` and a part number; the inverse of ``read_delimited``.

    The files of a year are written in parallel by the tasks that hold its rows, then given their names; files of other
    names in ``folder`` stay. ``header`` gives the columns written, in order and case (all but the year by default).
    """
    spark = df.sparkSession
    header = list(header or [c for c in df.columns if c != year])
    scratch = f"{folder.rstrip('/')}/_{uuid.uuid4().hex}"
    (df.select(F.col(year).alias("__year"), *[F.col(c.lower()).alias(c) for c in header])
       .write.partitionBy("__year").option("header", True).option("sep", sep).option("nullValue", null_value)
       .option("emptyValue", "").csv(scratch))
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(scratch)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for of_year in fs.listStatus(root):
        if not of_year.isDirectory():
            continue
        value = of_year.getPath().getName().removeprefix("__year=")
        for i, part in enumerate(fs.listStatus(of_year.getPath())):
            target = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name.format(year=value)}-{i:05d}.tab")
            if not fs.rename(part.getPath(), target):
                raise FileExistsError(f"{target} is there already")
    fs.delete(root, True)


def delimited_columns(value_col, header: Sequence[str], columns: dict[str, T.DataType], sep: str = "\t",
                      null_values: str | None = None, strict: bool = True, date_format: str | None = None) -> list:
    """Column expressions that parse lines of text, with the CSV parser and the casts of ``read_delimited``."""
    names = [h.lower() for h in header]
    if missing := [c for c in columns if c not in names]:
        raise KeyError(f"columns {missing} not in the header {list(header)}")
    options = {"sep": sep, **({} if null_values is None else {"nullValue": null_values})}
    row = F.from_csv(F.col(value_col), ", ".join(f"`{n}` string" for n in names), options)
    return [_cast(row[c], t, strict, date_format).alias(c) for c, t in columns.items()]


def read_csv_na(spark: SparkSession, paths, columns: dict[str, T.DataType], strict: bool = True) -> DataFrame:
    """Comma-separated result/index files where the text ``NA`` means missing."""
    return read_delimited(spark, paths, columns, sep=",", null_values="NA", strict=strict)


def fixed_width_columns(value_col, fields: Sequence[tuple[str, int, T.DataType]],
                        strict: bool = True) -> list:
    """Column expressions that cut one text column by declared widths."""
    v = F.col(value_col) if isinstance(value_col, str) else value_col
    out, start = [], 1
    for name, width, dtype in fields:
        piece = F.trim(F.substring(v, start, width))
        piece = F.when(piece == "", F.lit(None)).otherwise(piece)
        out.append((piece if isinstance(dtype, T.StringType) else _cast(piece, dtype, strict)).alias(name))
        start += width
    return out


def read_fixed_width(spark: SparkSession, paths, fields: Sequence[tuple[str, int, T.DataType]],
                     strict: bool = True) -> DataFrame:
    """Fixed-width text (no header): one record per line, fields by width."""
    lines = spark.read.text(list(paths) if not isinstance(paths, str) else paths)
    return lines.select(*fixed_width_columns("value", fields, strict))


def pack_fixed_width(fields: Sequence[tuple[str, int, T.DataType]], pad: str = "0") -> Column:
    """Inverse of ``fixed_width_columns``: left-padded fields concatenated. A value wider than its field raises."""
    def field(name: str, width: int) -> Column:
        value = F.coalesce(F.col(name).cast("string"), F.lit(""))
        wide = F.raise_error(F.concat(F.lit(f"{name} is wider than {width} characters: "), value)).cast("string")
        return F.when(F.length(value) > width, wide).otherwise(F.lpad(value, width, pad))
    return F.concat(*[field(n, w) for n, w, _ in fields])


def write_checkpoint(df: DataFrame, path: str, partition_by: Sequence[str] = ("year",)) -> None:
    """Hand-off between stages as Parquet, partitioned (e.g. one folder per year).

    Dynamic partition overwrite replaces only the partitions being written, so
    re-running one year does not delete the others.
    """
    (df.write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic")
       .partitionBy(*partition_by)
       .parquet(path))


def read_checkpoint(spark: SparkSession, path: str, where=None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.filter(where) if where is not None else df


def write_result_csv(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Result table as CSV with a header, ``NA`` for missing values: one file for every ``rows_per_file`` rows, so a small
    result is one file and no task takes more than about that many. The rows are computed once, in parallel."""
    saved = materialize(df)
    files = max(1, -(-saved.count() // rows_per_file))
    saved.repartition(files).write.mode("overwrite").option("header", True).option("nullValue", "NA").csv(path)
