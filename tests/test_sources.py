"""Readers with explicit types, fixed width, year from file name, checkpoints."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casetally.sources import readers as SRC
from casetally.sources import schemas as SC
from helpers import rows


def test_delimited_header_case_and_year_from_name(spark, tmp_path):
    for yr, body in [(2016, "STATERR\tCHID\tCHAGE\tEXTRA\nAK\t001\t77\tz\nAL\t002\t\tz\n"),
                     (2017, "chage\tStaterr\tChid\nxx\tAZ\t003\n")]:
        (tmp_path / f"CF{yr}v3.tab").write_text(body)
    columns = {"staterr": T.StringType(), "chid": T.StringType(), "chage": T.IntegerType()}
    df = SRC.read_delimited(spark, str(tmp_path), columns, strict=False, year_pattern=SC.CASE_FILE_YEAR)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        SRC.read_delimited(spark, str(tmp_path), columns).collect()
    assert rows(df, "staterr", "chid", "chage", "file_year") == [
        ("AK", "001", 77, 2016), ("AL", "002", None, 2016), ("AZ", "003", None, 2017)]


def test_dates_in_another_format(spark, tmp_path):
    (tmp_path / "CF2012v1.tab").write_text("id\trptdt\n1\t03/15/2012\n2\t\n")
    columns = {"id": T.IntegerType(), "rptdt": T.DateType()}
    df = SRC.read_delimited(spark, str(tmp_path), columns, date_format="MM/dd/yyyy")
    assert [str(r.rptdt) for r in df.orderBy("id").collect()] == ["2012-03-15", "None"]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        SRC.read_delimited(spark, str(tmp_path), columns).collect()


def test_fixed_width_population_line(spark, tmp_path):
    (tmp_path / "pop.txt").write_text("2019AK02001991010000000123\n2019AL01003991211000001000\n")
    df = SRC.read_fixed_width(spark, str(tmp_path / "pop.txt"), SC.POPULATION_FIELDS)
    r = df.orderBy("state").first()
    assert (r.year, r.state, r.st_fips, r.cnty_fips, r.reg, r.race, r.hisp, r.sex, r.age, r.pop) == \
        (2019, "AK", "02", "001", "99", 1, 0, 1, 0, 123)
    assert df.schema["pop"].dataType == T.LongType()


def test_fixed_width_roundtrip(spark):
    fields = [("a", 4, T.IntegerType()), ("b", 3, T.LongType())]
    df = spark.createDataFrame([(12, 5), (7, 123)], "a int, b long")
    packed = df.select(SRC.pack_fixed_width(fields).alias("value"))
    assert rows(packed) == [("0007123",), ("0012005",)]
    assert rows(packed.select(*SRC.fixed_width_columns("value", fields))) == [(7, 123), (12, 5)]
    with pytest.raises(Exception, match="wider than"):
        df.select((F.col("a") * 100_000).alias("a"), "b").select(SRC.pack_fixed_width(fields).alias("value")).collect()


def test_csv_na_values(spark, tmp_path):
    (tmp_path / "q.csv").write_text("staterr,subyr,flag_1\nAK,2019,TRUE\nAL,2019,NA\n")
    df = SRC.read_csv_na(spark, str(tmp_path / "q.csv"), {"staterr": T.StringType(), "subyr": T.IntegerType(),
                                                          "flag_1": T.BooleanType()})
    assert rows(df) == [("AK", 2019, True), ("AL", 2019, None)]


def test_checkpoint_overwrites_only_written_years(spark, tmp_path):
    path = str(tmp_path / "imps")
    a = spark.createDataFrame([(2018, 1), (2019, 2)], "year int, v int")
    SRC.write_checkpoint(a, path)
    SRC.write_checkpoint(spark.createDataFrame([(2019, 9)], "year int, v int"), path)
    back = SRC.read_checkpoint(spark, path)
    assert rows(back, "year", "v") == [(2018, 1), (2019, 9)]
    assert rows(SRC.read_checkpoint(spark, path, F.col("year") == 2018), "v") == [(1,)]


def test_result_csv(spark, tmp_path):
    df = spark.createDataFrame([("a", None)], "k string, v double")
    SRC.write_result_csv(df, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert text.splitlines() == ["k,v", "a,NA"]


def test_files_are_grouped_by_header(spark, tmp_path):
    """One relation per layout, whatever the number of files; compressed, empty and marker files."""
    import gzip
    for i in range(60):
        header, body = ("A\tb\n", f"{i}\tx{i}\n") if i % 2 else ("B\textra\ta\n", f"x{i}\t\t{i}\n")
        (tmp_path / f"CF20{i:02d}v1 part.tab").write_text(header + body)
    with gzip.open(tmp_path / "CF2060v1.tab.gz", "wt") as f:
        f.write("\ufeffa\tb\n60\tx60\n")
    (tmp_path / "CF2061v1.tab").write_text("")
    (tmp_path / "_marker").write_text("no header")
    layouts = SRC.header_layouts(spark, str(tmp_path))
    assert {k: len(v) for k, v in layouts.items()} == {("a", "b"): 31, ("b", "extra", "a"): 30}
    df = SRC.read_delimited(spark, str(tmp_path), {"a": T.IntegerType(), "b": T.StringType()}, year_pattern=SC.CASE_FILE_YEAR)
    assert df._jdf.queryExecution().analyzed().toString().count("Relation") == 2
    assert rows(df, "a", "b", "file_year") == [(i, f"x{i}", 2000 + i) for i in range(61)]


def test_missing_and_repeated_columns(spark, tmp_path):
    columns = {"a": T.IntegerType()}
    (tmp_path / "one.tab").write_text("a\tA\n1\t2\n")
    with pytest.raises(KeyError, match="twice"):
        SRC.read_delimited(spark, str(tmp_path), columns)
    with pytest.raises(KeyError, match="not in the header"):
        SRC.read_delimited(spark, str(tmp_path), {"c": T.IntegerType()})
    with pytest.raises(FileNotFoundError):
        SRC.read_delimited(spark, str(tmp_path / "none*.tab"), columns)
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "e.tab").write_text("")
    assert SRC.read_delimited(spark, str(tmp_path / "empty"), columns, year_pattern="(1)").columns == ["a", "file_year"]


def test_yearly_files_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(2016, 1, "x\ty"), (2016, 2, None), (2017, 3, "q\"uote")], "year int, id int, v string")
    SRC.write_delimited_years(df.repartition(3), str(tmp_path), "year", header=["V", "ID"])
    SRC.write_delimited_years(df.withColumn("year", F.col("year") + 2), str(tmp_path), "year")
    with pytest.raises(FileExistsError):
        SRC.write_delimited_years(df, str(tmp_path), "year")
    names = {p.name[:8] for p in tmp_path.iterdir() if not p.name.startswith((".", "_"))}
    assert names == {f"CF{y}v1" for y in (2016, 2017, 2018, 2019)}
    back = SRC.read_delimited(spark, str(tmp_path), {"id": T.IntegerType(), "v": T.StringType()}, year_pattern=SC.CASE_FILE_YEAR)
    first = [(2016, 1, "x\ty"), (2016, 2, None), (2017, 3, "q\"uote")]
    assert rows(back, "file_year", "id", "v") == sorted(first + [(y + 2, i, v) for y, i, v in first])


def test_result_csv_in_bounded_files(spark, tmp_path):
    SRC.write_result_csv(spark.range(25), str(tmp_path / "out"), rows_per_file=10)
    files = list((tmp_path / "out").glob("part-*.csv"))
    assert len(files) == 3
    back = SRC.read_csv_na(spark, str(tmp_path / "out"), {"id": T.LongType()})
    assert rows(back) == [(i,) for i in range(25)]
