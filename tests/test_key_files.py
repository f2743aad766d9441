"""Files of partition folders written by Arrow: the same table as by Spark's writer, whole or not at all."""

import pytest
from pyspark.sql import functions as F

from rackmeter.sinks import key_files, writers
from rackmeter.sources import tables

ODD = [None, "", "0711", "a/b", "a=b", "ä b", "50%", "x+y", "{[^]}", "t\tq\"'"]
COLUMNS = """
    n BIGINT, t STRING, d DOUBLE, f FLOAT, b BOOLEAN, i INT, s SMALLINT, y TINYINT, m DECIMAL(20, 3), day DATE, at TIMESTAMP,
    local TIMESTAMP_NTZ, run STRING, host STRING"""


def table(spark):
    rows = spark.range(200).select(
        F.col("id").alias("n"),
        F.get(F.array(*[F.lit(v) for v in (None, "", ' a"b, c\\', "x\ty", "ü")]), F.col("id").cast("int") % 5).alias("t"),
        F.when(F.col("id") % 9 > 0, F.col("id") / 7).alias("d"), (F.col("id") / 3).cast("float").alias("f"),
        (F.col("id") % 2 == 0).alias("b"), F.col("id").cast("int").alias("i"), F.col("id").cast("smallint").alias("s"),
        (F.col("id") % 100).cast("tinyint").alias("y"), (F.col("id") / 8).cast("decimal(20,3)").alias("m"),
        F.date_add(F.lit("1400-02-28").cast("date"), F.col("id").cast("int") * 1300).alias("day"),
        F.expr("timestamp'1400-01-01 01:02:03' + make_dt_interval(id * 1300, 0, 0, id / 1000)").alias("at"),
        F.expr("timestamp_ntz'1400-01-01 01:02:03' + make_dt_interval(id * 1300)").alias("local"),
        F.get(F.array(*[F.lit(v) for v in ODD]), (F.col("id") % len(ODD)).cast("int")).alias("run"),
        F.concat(F.lit("h"), F.col("id") % 3).alias("host"),
    )
    return rows


def folders(path):
    return {str(f.parent.relative_to(path)) for f in path.glob("run=*/host=*/part-*")}


def by_row(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_files_are_those_of_sparks_writer(spark, tmp_path, fmt):
    df = table(spark)
    writers.write_new_partitions(df, str(tmp_path / "new"), fmt=fmt)
    df.write.partitionBy("run", "host").format(fmt).option("header", True).save(str(tmp_path / "own"))
    assert folders(tmp_path / "new") == folders(tmp_path / "own") and len(folders(tmp_path / "new")) == 27
    read = lambda name: spark.read.format(fmt).option("header", True).load(str(tmp_path / name))
    assert by_row(read("new")) == by_row(read("own"))
    if fmt == "parquet":
        assert read("new").schema == read("own").schema
        given = spark.read.schema(COLUMNS).parquet(str(tmp_path / "new"))
        assert by_row(given) == by_row(df.withColumn("run", F.nullif("run", F.lit(""))))
    else:
        lines = lambda name: sorted((str(f.parent.name), x) for f in (tmp_path / name).glob("run=*/host=*/part-*") for x in set(f.read_text().split("\n")))
        assert set(lines("new")) == set(lines("own"))


def test_a_server_has_one_file_and_no_process_sets_its_rights(spark, tmp_path):
    """Spark's writer puts a checksum beside each file, and starts three processes for both and their folder."""
    df = spark.range(3000).select(F.col("id").alias("n"), F.lit("r").alias("run"), (F.col("id") % 600).cast("string").alias("host"))
    writers.write_new_partitions(df, str(tmp_path / "t"))
    found = [f for f in (tmp_path / "t").rglob("*") if f.is_file() and f.name != "_SUCCESS"]
    assert len(found) == 600 and all(f.name.startswith("part-") for f in found)
    writers.write_new_partitions(df.withColumn("n", F.lit(-1)).unionByName(df.select("n", "run", F.lit("new").alias("host"))), str(tmp_path / "t"))
    assert tuple(spark.read.parquet(str(tmp_path / "t")).agg(F.count("*"), F.min("n")).first()) == (6000, 0)


def test_a_failed_writer_leaves_nothing(spark, tmp_path):
    df = spark.range(40, numPartitions=4).select(F.col("id").alias("n"), F.lit("r").alias("run"), F.col("id").cast("string").alias("host"))
    writers.write_new_partitions(df.where("n < 5"), str(tmp_path / "t"))
    before = sorted(f for f in (tmp_path / "t").rglob("*") if f.is_file())
    bad = df.withColumn("n", F.when(F.col("n") == 39, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("n")))
    with pytest.raises(Exception, match="stop"):
        writers.write_new_partitions(bad, str(tmp_path / "t"))
    assert sorted(f for f in (tmp_path / "t").rglob("*") if f.is_file()) == before


def test_a_hot_key_may_come_in_several_files_and_batches(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(100).select(F.col("id").alias("n"), F.lit("r").alias("run"), F.when(F.col("id") < 90, "hot").otherwise(F.col("id").cast("string")).alias("host"))
        writers.write_new_partitions(df, str(tmp_path / "t"), fmt="csv")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(folders(tmp_path / "t")) == 11
    assert tables._csv(spark, f"{tmp_path}/t/*/*").agg(F.sum("n")).first()[0] == 4950


def test_other_columns_and_places_are_left_to_spark(spark, tmp_path):
    df = spark.range(3).select("id", F.array("id").alias("a"), F.lit("r").alias("run"), F.lit("h").alias("host"))
    assert not key_files.can_write(df, str(tmp_path), ["run", "host"], "parquet")
    plain = df.drop("a")
    assert key_files.can_write(plain, f"file://{tmp_path}", ["run", "host"], "parquet")
    assert not key_files.can_write(plain, "hdfs://x/y", ["run", "host"], "parquet")
    assert not key_files.can_write(plain, str(tmp_path), ["run", "host"], "orc")
    writers.write_new_partitions(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).where("size(a) = 1 and host = 'h'").count() == 3


def test_names_of_a_layout_are_read_from_one_file(spark, tmp_path, monkeypatch):
    """Without a given schema Spark lists all files once more to find the names."""
    df = spark.range(50).select(F.col("id").alias("n"), F.lit("x").alias("t"), F.lit("r").alias("run"), F.col("id").cast("string").alias("host"))
    writers.write_new_partitions(df, str(tmp_path / "t"), fmt="csv")
    kind, calls = type(spark.read), []
    real = kind.csv
    monkeypatch.setattr(kind, "csv", lambda self, path, schema=None, **k: calls.append((1 if isinstance(path, str) else len(path), self)) or real(self, path, schema, **k))
    given = []
    real_schema = kind.schema
    monkeypatch.setattr(kind, "schema", lambda self, s: given.append(self) or real_schema(self, s))
    read = tables._csv(spark, f"{tmp_path}/t/*/*")
    assert read.columns == ["n", "t", "file"] and read.where("t = 'x'").count() == 50
    assert [n for n, reader in calls if reader not in given] == [1]
